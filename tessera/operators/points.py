"""The life of the point table: upsert, delete, pages, stale cleanup, preflight checks, coverage.

Tables are DataFrames in and out; a caller writes the result. Keys are spread by hash, so no step holds a whole
repository in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def last_by(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. max_by over a struct is a partial aggregate, so hot keys are reduced before the exchange."""
    others = [c for c in rows.columns if c not in key]
    packed = rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_last"))
    return packed.select(*key, "_last.*").select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, key: str = "id", order: str = "seq", unique: bool = False) -> DataFrame:
    """Old rows whose id isn't among the new ones, and the last emission of each new id (``unique``: there is one of each)."""
    latest = (new if unique else last_by(new, [key], [order])).drop(order)
    return old.join(latest.select(key), key, "left_anti").unionByName(latest)


def delete(points: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return points.join(ids.select(key).distinct(), key, "left_anti")


def page(points: DataFrame, after: str | int | None, size: int, key: str = "id") -> DataFrame:
    """The next ``size`` points behind a key: a range filter, so earlier pages aren't read again."""
    found = points if after is None else points.where(F.col(key) > F.lit(after))
    return found.orderBy(key).limit(size)


def batches(rows: DataFrame, group: str, size: int) -> DataFrame:
    """How many batches of ``size`` each group makes."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("rows"), F.ceil(F.count(F.lit(1)) / size).cast("long").alias("batches"))


def stale(existing: DataFrame, scanned: DataFrame, indexed: DataFrame, current: DataFrame) -> DataFrame:
    """Points to delete after a complete scan.

    existing: id, path, content_type, chunk_id; scanned and indexed: path; current: path, content_type, chunk_id.
    A point goes if its path wasn't scanned, or was indexed and no longer gives this chunk for this type. Points of
    files that were scanned but failed, and points without a path, stay.
    """
    located = existing.where(F.col("path").isNotNull())
    missing = located.join(scanned.select("path").distinct(), "path", "left_anti")
    there = located.join(scanned.select("path").distinct(), "path", "left_semi").join(indexed.select("path").distinct(), "path", "left_semi")
    outdated = there.join(current.select("path", "content_type", "chunk_id").distinct(), ["path", "content_type", "chunk_id"], "left_anti")
    return missing.select("id", "path", "content_type", "chunk_id").unionByName(outdated.select("id", "path", "content_type", "chunk_id"))


def coverage(scanned: DataFrame, indexed: DataFrame, least: float = 0.95) -> DataFrame:
    """scanned, indexed, coverage (1 when nothing was scanned), status."""
    marked = scanned.select("path").distinct().join(indexed.select("path").distinct().withColumn("_ok", F.lit(1)), "path", "left")
    share = F.coalesce(F.avg(F.coalesce("_ok", F.lit(0))), F.lit(1.0))
    found = marked.agg(F.count(F.lit(1)).alias("scanned"), F.coalesce(F.sum("_ok"), F.lit(0)).cast("long").alias("indexed"), F.round(share, 4).alias("coverage"))
    return found.withColumn("status", F.when(F.col("scanned") == 0, "empty").when(F.col("coverage") < least, "insufficient_coverage").otherwise("success"))


def by_type(rows: DataFrame, types: tuple[str, ...] = ("code", "docs")) -> DataFrame:
    """Rows per content type in one aggregate, zero for types without rows."""
    counted = rows.agg(*[F.count_if(F.col("content_type") == t).alias(t) for t in types])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(t).alias("content_type"), F.col(t).alias("rows")) for t in types])).alias("x")).select("x.*")


def legacy(points: DataFrame, version: str) -> DataFrame:
    """Points per type that lack the schema version, whether it differs or is missing."""
    return points.where(~F.col("chunk_schema_version").eqNullSafe(F.lit(version))).groupBy("content_type").agg(F.count(F.lit(1)).alias("legacy"))


def collisions(points: DataFrame, repo: str, root: str) -> DataFrame:
    """Points per type of the same repository name under another root."""
    return points.where((F.col("repo") == repo) & ~F.col("repo_root").eqNullSafe(F.lit(root))).groupBy("content_type").agg(F.count(F.lit(1)).alias("colliding"))


def open_range(texts: DataFrame, start: Column | int, end: Column | int, most_lines: int = 200, most_bytes: int | None = None) -> DataFrame:
    """path, start_line, end_line, text, truncated: lines start to end, at most ``most_lines``, within a byte budget.

    Whole lines are kept while their bytes and line feeds fit. Texts are independent; a text's lines are folded
    in place.
    """
    from ..functions.text import lines

    start, end = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    last = F.least(end, start + most_lines - 1)
    rows = texts.withColumn("_lines", lines(F.col("text"))).withColumn("_part", F.slice("_lines", start, F.greatest(last - start + 1, F.lit(0))))
    if most_bytes is not None:
        begin = F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("kept"), F.lit(True).alias("open"))

        def step(acc: Column, line: Column) -> Column:
            size = acc["bytes"] + F.octet_length(line) + F.when(acc["kept"] > 0, 1).otherwise(0)
            fits = acc["open"] & (size <= most_bytes)
            return F.struct(F.when(fits, size).otherwise(acc["bytes"]).alias("bytes"), (acc["kept"] + fits.cast("int")).alias("kept"), fits.alias("open"))

        kept = F.aggregate("_part", begin, step, lambda acc: acc["kept"])
    else:
        kept = F.size("_part")
    rows = rows.withColumn("_kept", kept)
    cut = (F.col("_kept") < F.size("_part")) | (last < F.least(end, F.size("_lines")))
    return rows.select(
        "path", start.alias("start_line"), (start + F.col("_kept") - 1).alias("end_line"), F.when(~cut, F.size("_lines")).alias("total_lines"),
        F.array_join(F.slice("_part", F.lit(1), F.col("_kept")), "\n").alias("text"), cut.alias("truncated"),
    )


def first_by(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a key by an order of columns; tasks keep one row a key before the exchange."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_nth = 1").drop("_nth")
