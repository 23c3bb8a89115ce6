"""Exact search by cosine that reads little: vectors stored by their nearest pivot, blocks told to be too far by the triangle inequality.

The angle between two vectors is a metric. A block keeps how far its vectors are from its pivot at least and at most, so a query's
angle to the pivot bounds its angle to all of them. Blocks are folders of a partitioned table: those that can't hold one of the k best
are never opened. How many that are depends on the vectors: clustered ones leave a few blocks, isotropic ones nearly all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from . import search as S

#: Pivots of a table at most; their vectors and a row for each block come to the driver.
MOST_PIVOTS = 4096
#: Radians by which a bound is loosened, far more than what rounding takes from an angle.
SLACK = 1e-6


def build(points: DataFrame, path: str, width: int, pivots: int = 64) -> None:
    """Writes points (id, vector and what searches filter by) to a new table at ``path``, in blocks.

    Pivots are the ``pivots`` vectors whose ids have the smallest hashes (fewer if there are fewer), so the same points give the same
    blocks. Vectors that are null, zero, of another width or not finite have no angle and are left out. A block of many
    vectors is several files, written by several tasks.
    """
    if not 0 < pivots <= MOST_PIVOTS:
        raise ValueError(f"1 to {MOST_PIVOTS} pivots")
    vector = F.col("vector").cast("array<double>")
    usable = points.where(F.col("vector").isNotNull() & S.valid_vector(F.col("vector"), width) & F.exists("vector", lambda x: x != 0))
    chosen = usable.orderBy(F.xxhash64("id"), "id").limit(pivots).select(vector.alias("vector")).collect()
    at = _unit(np.array([r.vector for r in chosen], dtype=float).reshape(-1, width))

    names = list(points.columns)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index("_vector")).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            blocks, angles = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            if batch.num_rows:
                cosines = _unit(vectors) @ at.T
                blocks = cosines.argmax(1).astype(np.int32)
                angles = np.arccos(np.clip(cosines.max(1), -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["_vector"]).columns, pa.array(angles), pa.array(blocks)], [*names, "angle", "block"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)
    told = usable.select(*points.columns, vector.alias("_vector")).mapInArrow(near, f"{kept}, angle double, block int")
    # evens out files: small blocks share tasks, large ones are dealt to several
    told.hint("rebalance", "block").write.partitionBy("block").parquet(f"{path}/points")
    spark = points.sparkSession
    stored = _points(spark, path, f"{kept}, angle double, block int")
    bounds = stored.groupBy("block").agg(F.min("angle").alias("least"), F.max("angle").alias("most"), F.count(F.lit(1)).alias("rows"))
    named = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(at)], "block int, pivot array<double>")
    bounds.join(F.broadcast(named), "block").coalesce(1).write.parquet(f"{path}/bounds")


def _unit(vectors: np.ndarray) -> np.ndarray:
    # by the largest component first, so that squares neither vanish nor overflow
    scaled = vectors / np.abs(vectors).max(1, keepdims=True) if len(vectors) else vectors
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True)) if len(vectors) else vectors


def _points(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(f"{path}/points")


@dataclass(frozen=True)
class Found:
    """The k best rows, best first, and how much was read for them."""

    hits: list[Row]
    blocks_read: int
    blocks: int
    rows_read: int
    rows: int


def top_k(spark: SparkSession, path: str, query: Sequence[float], k: int, conditions: dict[str, object] | None = None, first: int = 1) -> Found:
    """The k best points by cosine after the filter, as ``search.top_k`` finds them, with their score.

    Blocks are read in the order of their bounds, ``first`` of them, then twice as many each time, until the next bound is below the
    k-th score; so there are few jobs, and what is read never misses a hit. k rows come to the driver each time.
    """
    if not 0 < k <= S.WRITTEN_HITS:
        raise ValueError(f"1 to {S.WRITTEN_HITS} hits")
    asked = np.array([S.query_vector(query)])
    if not asked.any():
        raise ValueError("a query vector of zeros has no cosine")
    bounds = spark.read.parquet(f"{path}/bounds").collect()
    total = sum(b.rows for b in bounds)
    if not bounds:
        return Found([], 0, 0, 0, 0)
    angles = np.arccos(np.clip(np.array([b.pivot for b in bounds]) @ _unit(asked)[0], -1, 1))
    nearest = [max(0.0, b.least - a - SLACK, a - b.most - SLACK) for b, a in zip(bounds, angles.tolist(), strict=True)]
    order = sorted(zip([math.cos(x) for x in nearest], bounds, strict=True), key=lambda x: (-x[0], x[1].block))
    rows = _points(spark, path).where(S.payload_filter(conditions or {}))
    held: list[Row] = []
    read = seen = 0
    while read < len(order):
        part = [b for bound, b in order[read : read + first] if len(held) < k or bound >= held[-1].score]
        if not part:
            break
        scored = rows.where(F.col("block").isin([b.block for b in part])).withColumn("score", S.score(F.col("vector"), asked[0].tolist()))
        held = sorted([*held, *S.best(scored.drop("angle", "block", "vector"), k).collect()], key=lambda r: (-r.score, r.id))[:k]
        read, seen, first = read + len(part), seen + sum(b.rows for b in part), first * 2
    return Found(held, read, len(order), seen, total)
