"""Incremental indexing with Structured Streaming.

New files are chunked as they come. Each micro-batch writes its chunks under its own batch folder, overwriting what
a failed try left, so a batch counts once; readers take the last row of each id. Nothing that was written before is
rewritten, so a batch costs what it brings.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import classify, text as T
from ..operators import chunks, documents, memory, points


def chunk_rows(files: DataFrame, size: int = 120, overlap: int = 20) -> DataFrame:
    """files (repo, path, text) to id, repo, path, content_type, content_hash, start_line, end_line, text."""
    found = chunks.windows(files.withColumn("path", F.concat_ws("\u0001", "repo", "path")), size, overlap)
    parts = F.split("path", "\u0001")
    found = found.withColumn("repo", F.element_at(parts, 1)).withColumn("path", F.element_at(parts, 2))
    identity = T.chunk_id(F.col("path"), F.col("start_line"), F.col("end_line"), classify.language(F.col("path")))
    return found.select(
        T.point_id(F.col("repo"), F.lit(""), identity).alias("id"), "repo", "path", classify.collection(classify.content_type(F.col("path"))).alias("content_type"),
        T.content_hash(F.col("content")).alias("content_hash"), "start_line", "end_line", F.col("content").alias("text"),
    )


def ingest(files: DataFrame, table: str, checkpoint: str, size: int = 120, overlap: int = 20) -> StreamingQuery:
    """Starts a query that takes all files (repo, path, text) that are there, then stops."""

    def write(batch: DataFrame, number: int) -> None:
        chunk_rows(batch, size, overlap).withColumn("seq", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str) -> DataFrame:
    """The table as it stands: the last row of each id."""
    return points.last_by(spark.read.parquet(table).drop("batch"), ["id"], ["seq"]).drop("seq")


def index(events: DataFrame, table: str, checkpoint: str, root: str = "", size: int = 120, overlap: int = 20) -> StreamingQuery:
    """Starts an index run over a stream of file events (repo, path, text; a null text means that the file is gone), then stops.

    Each micro-batch takes the last event of a file in it (by ``at``, if there is such a column), leaves out files whose text is the
    one that is indexed, cuts the others by the dispatcher (``documents.chunk_files``) and writes their points and a row for
    each file, both under the batch's number. A batch that is tried again writes the same folders, and reads only
    earlier ones. Points of a file's earlier versions, and of files that are gone, are stale by that; nothing is rewritten.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        order = F.col("at") if "at" in batch.columns else F.monotonically_increasing_id()
        last = batch.groupBy("repo", "path").agg(F.max_by("text", order).alias("text"), F.max_by(F.sha2("text", 256), order).alias("hash"))
        known = versions(spark, table, number)
        before = known.select("repo", "path", F.col("hash").alias("_hash")) if known is not None else spark.createDataFrame([], "repo string, path string, _hash string")
        changed = last.join(before, ["repo", "path"], "left").where(~F.col("hash").eqNullSafe(F.col("_hash"))).drop("_hash")
        # stored, so that what is cut is what the row for the file says
        changed.write.mode("overwrite").parquet(f"{table}/changed/batch={number}")
        changed = spark.read.schema(changed.schema).parquet(f"{table}/changed/batch={number}")
        found = documents.chunk_files(changed, size, overlap)
        point = T.point_id(F.col("repo"), F.lit(root), F.col("chunk_id")).alias("id")
        rows = found.select(point, "repo", F.lit(root).alias("repo_root"), "path", F.col("collection").alias("content_type"), "chunk_id", "content_hash", "start_line", "end_line", F.col("content").alias("text"), "chunk_schema_version", F.struct("start_line", "end_line", "content_hash").alias("seq"))
        points.last_by(rows, ["id"], ["seq"]).drop("seq").write.mode("overwrite").parquet(f"{table}/points/batch={number}")
        changed.select("repo", "path", "hash").write.mode("overwrite").parquet(f"{table}/files/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versions(spark: SparkSession, table: str, before: int | None = None) -> DataFrame | None:
    """The last version of each file (repo, path, hash, batch), of batches before a number; None if nothing is written yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table}/files")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    rows = spark.read.schema("repo string, path string, hash string, batch long").parquet(f"{table}/files")
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    return rows.groupBy("repo", "path").agg(F.max_by("hash", "batch").alias("hash"), F.max("batch").alias("batch"))


def indexed(spark: SparkSession, table: str) -> DataFrame:
    """The points as they stand: those of each file's last version, told by small rows of files, not by points."""
    last = versions(spark, table).where("hash IS NOT NULL").select("repo", "path", "batch")
    return spark.read.parquet(f"{table}/points").join(last, ["repo", "path", "batch"], "left_semi").drop("batch")


def recent_turns(turns: DataFrame, most: int = 32) -> DataFrame:
    """A stream of turns (conv_id, turn, text) to each session's buffer of its last ``most`` turns, after every batch.

    The state is a session's buffer, so it is bounded.
    """

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for frame in frames:
            held += list(zip(frame["turn"].tolist(), frame["text"].tolist(), strict=True))
        held = sorted(held)[-most:]
        state.update(([t for t, _ in held], [x for _, x in held]))
        yield pd.DataFrame({"conv_id": [key[0]], "turns": [len(held)], "first_turn": [held[0][0]], "last_turn": [held[-1][0]]})

    return turns.groupBy("conv_id").applyInPandasWithState(keep, "conv_id long, turns long, first_turn long, last_turn long", "turn array<long>, text array<string>", "update", GroupStateTimeout.NoTimeout)


def reconcile(statements: DataFrame, scope: list[str], high: float = 0.60) -> DataFrame:
    """A stream of statements (scope, seq, kind, topic, value, confidence) folded per arrival, as ``memory.reconcile`` folds a table.

    The state of a key is its ``memory.MOST_ACTIVE`` latest active entries, never its history. Each micro-batch gives the
    entries that it changed, with the number of the statement that did (version); ``memory.latest`` reads them as a table.
    Statements of a key must come in the order of seq between batches; within one they are sorted.
    """
    keys = [*scope, "kind", "topic"]
    schema = ", ".join([*[f"`{k}` {statements.schema[k].dataType.simpleString()}" for k in keys], memory.ENTRY, "version long"])
    columns = [*keys, *[x.split()[0] for x in memory.ENTRY.split(", ")], "version"]

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        live = [memory.Entry(**e) for e in json.loads(state.get[0])] if state.exists else []
        changed: dict[int, memory.Entry] = {}
        rows = [r for frame in frames for r in frame[["seq", "value", "confidence"]].itertuples(index=False)]
        for r in sorted(rows, key=lambda r: (r.seq, r.value or "")):
            for e in memory.take(live, int(r.seq), r.value, None if pd.isna(r.confidence) else float(r.confidence), high)[0]:
                changed[e.id] = e
        state.update((json.dumps([vars(e) for e in live]),))
        out = pd.DataFrame([[*key, e.id, e.value, e.confidence, e.times_reinforced, e.active, e.supersedes, e.updated] for e in changed.values()], columns=columns)
        yield out.astype({"supersedes": "Int64", "confidence": "float64"})

    return statements.groupBy(*keys).applyInPandasWithState(fold, schema, "entries string", "update", GroupStateTimeout.NoTimeout)


def remember(statements: DataFrame, table: str, checkpoint: str, scope: list[str]) -> StreamingQuery:
    """Starts a query that reconciles all statements that are there and writes changed entries, each micro-batch under its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    changed = reconcile(statements, scope)
    return changed.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
