"""Lloyd's clustering on integer vectors, with distance bounds kept between rounds (geometric drift tightening).

For each vector an upper bound of the distance to its own centroid and a lower bound of that to each other
centroid are kept. When centroids move, the upper bound grows by the whole drift of its centroid. A lower bound is
loosened by less: all vectors of a cluster lie in a sphere around its centroid, and for a centroid that moves from
``a`` to ``b`` the plane through ``a``, ``b`` and the sphere's centre shows how much nearer it can come to any point of the
sphere (``approach``). A vector whose upper bound stays below all its lower bounds keeps its cluster unseen; one whose
bounds overlap is ambiguous: its own distance is taken exactly, and if bounds still overlap all distances are.

*Layout.* Vectors are written once, in blocks of ``BLOCK`` rows as one integer matrix each, in a table bucketed by block
number. What changes (cluster, bounds, and each block's sums for the new centroids) is a second, much smaller table bucketed
alike, so that a round joins the two without any exchange and writes the small one only; the older one is then removed. A
block's sums change by its ambiguous vectors alone. Only sums, counts and radii of the k clusters reach the driver.

*Exact results.* Components are floor(1024 x); where they are so large that a squared distance would pass a long (|x| of
185,000 and more) there is no result, but an error that says so. Distances are exact integers, ties go to the smaller number, and
bounds are compared with a margin above their rounding. Sums are decimals on the way to the driver.

Vectors that are null, of another length or hold null or non-finite components take no part. Equal vectors go to one cluster. Fewer
kept rows than centroids give fewer centroids; none gives an empty result. A null id is a row like any other, but no start.
Rows that share an id are rows of their own. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import map_arrow, shared_folder

SCALE = 1024
#: Vectors of a block.
BLOCK = 4096
def kept(vector: Column, size: int) -> Column:
    """Whether a vector has ``size`` components, none of them null or non-finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == size) & fine, F.lit(False))


def _widest(top: int, size: int) -> int:
    """What squared distances of ``size`` components up to ``top`` in magnitude stay below."""
    return 4 * (int(top) + 1) ** 2 * size


def integers(values: np.ndarray, size: int) -> np.ndarray:
    """floor(1024 x) of doubles, as rows of ``size``; an error where a squared distance could pass a long."""
    scaled = np.floor(values.astype(np.float64) * SCALE)
    top = np.abs(scaled).max(initial=0)
    if top >= 2**31 or _widest(top, size) >= 2**63:
        raise ValueError(f"a component of {top / SCALE:g} in magnitude: squared distances don't fit in a long")
    return scaled.astype(np.int32).reshape(-1, size)


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances as longs, a column for each centroid."""
    if _widest(max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)), vectors.shape[1]) < 2**53:
        # every product and sum is an integer that a double holds
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        return ((v * v).sum(1)[:, None] + (c * c).sum(1) - 2 * (v @ c.T)).astype(np.int64)
    wide = vectors.astype(np.int64)
    return np.stack([((wide - c) ** 2).sum(1) for c in centroids.astype(np.int64)], 1)


def approach(old: np.ndarray, new: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """For each sphere i around old centroid i (of a radius) and each centroid j: by how much j's move can lessen its distance to a point of the sphere.

    With m the middle of the move and p its length, |x - a| - |x - b| = 2 (b - a)(x - m) / (|x - a| + |x - b|), and the
    sum below is 2 |x - m| at least: the difference is p cos t at most, t being the angle at m between the move and x. Seen
    from m in the plane of the move and the sphere's centre, the sphere spans an angle of asin(r / d) either side of
    its centre, so t is at least the centre's angle less that. A point behind m only gets farther away: 0.
    """
    move = (new - old).astype(np.float64)
    length = np.sqrt((move * move).sum(1))
    middle = (new + old) / 2
    away = old[:, None, :].astype(np.float64) - middle[None, :, :]
    distance = np.sqrt((away * away).sum(2))
    with np.errstate(divide="ignore", invalid="ignore"):
        angle = np.arccos(np.clip((away * move).sum(2) / (distance * length), -1, 1))
        spans = np.arcsin(np.clip(radii[:, None] / distance, 0, 1))
        least = np.where((distance > radii[:, None]) & (length > 0), np.maximum(angle - spans, 0), 0)
    return length * np.maximum(np.cos(least), 0)


@dataclass
class Round:
    """What a round's tasks need of the round before: centroids, and how bounds change."""

    centroids: np.ndarray
    drift: np.ndarray
    loosened: np.ndarray


#: Bounds are moved outwards by so much of their size (and compared with it), far above their rounding.
MARGIN = 1e-9


def first_bounds(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster, upper bound and lower bounds by all exact distances."""
    found = squared(vectors, centroids)
    cluster = found.argmin(1)
    exact = np.sqrt(found.astype(np.float64))
    return cluster.astype(np.int32), exact[np.arange(len(cluster)), cluster], exact


def moved(vectors: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, step: Round) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Cluster and bounds after centroids moved, and how many vectors were scanned against all of them."""
    rows = np.arange(len(cluster))
    upper = (upper + step.drift[cluster]) * (1 + MARGIN)
    lower = np.maximum(lower - step.loosened[cluster], 0) * (1 - MARGIN)
    others = lower.copy()
    others[rows, cluster] = np.inf
    nearest = others.min(1) * (1 - MARGIN)
    doubtful = np.flatnonzero(upper >= nearest)
    if len(doubtful):
        # the own distance first
        for c in np.unique(cluster[doubtful]):
            own = doubtful[cluster[doubtful] == c]
            upper[own] = np.sqrt(squared(vectors[own], step.centroids[c : c + 1])[:, 0].astype(np.float64))
        doubtful = doubtful[upper[doubtful] >= nearest[doubtful]]
    if len(doubtful):
        cluster = cluster.copy()
        cluster[doubtful], upper[doubtful], lower[doubtful] = first_bounds(vectors[doubtful], step.centroids)
    return cluster, upper, lower, len(doubtful)


def _sums(vectors: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    sums = np.zeros((k, vectors.shape[1]), np.int64)
    for c in np.unique(cluster):
        sums[c] = vectors[cluster == c].sum(0, dtype=np.int64)
    return sums


#: ``totals``: rows of each cluster, vectors scanned, then the sums of each cluster's components.
STATE = "block long, cluster binary, upper binary, lower binary, totals array<long>, radii array<double>"
_STATE = pa.schema([("block", pa.int64()), ("cluster", pa.binary()), ("upper", pa.binary()), ("lower", pa.binary()), ("totals", pa.list_(pa.int64())), ("radii", pa.list_(pa.float64()))])


def _state_row(block: int, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, sums: np.ndarray, k: int, scanned: int) -> pa.RecordBatch:
    radii = np.zeros(k)
    np.maximum.at(radii, cluster, upper)
    # stored as floats, rounded outwards
    up, low = np.nextafter(upper.astype(np.float32), np.float32(np.inf)), np.nextafter(lower.astype(np.float32), np.float32(-np.inf))
    totals = [*np.bincount(cluster, minlength=k).tolist(), scanned, *sums.reshape(-1).tolist()]
    row = {"block": block, "cluster": cluster.astype(np.int32).tobytes(), "upper": up.tobytes(), "lower": np.maximum(low, 0).tobytes(), "totals": totals, "radii": radii.tolist()}
    return pa.RecordBatch.from_pylist([row], _STATE)


def _matrix(value: pa.Scalar, size: int) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.int32).reshape(-1, size)


class _Tables:
    """Tables of one run, bucketed by block in the shared folder; each can be removed once nothing reads it any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.buckets = spark, int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = f"{shared_folder(spark)}/centroids-{uuid.uuid4().hex}"
        self.names: list[str] = []

    def write(self, df: DataFrame) -> str:
        name = f"tessera_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, "block").option("path", f"{self.path}/{name}").saveAsTable(name)
        self.names.append(name)
        return name

    def remove(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _blocks(df: DataFrame, size: int) -> DataFrame:
    """block, ids, vectors (a matrix of 32-bit integers): the rows of each task in blocks. ``df`` has id and vector."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a block's number is its task's and its place there
        number = TaskContext.get().partitionId() << 36
        ids: list[pa.Array] = []
        rows: list[np.ndarray] = []

        def full() -> pa.RecordBatch:
            nonlocal number
            matrix = np.concatenate(rows)
            row = [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(matrix)], pa.int32()), pa.concat_arrays(ids)), pa.array([matrix.tobytes()], pa.binary())]
            number += 1
            ids.clear(), rows.clear()
            return pa.RecordBatch.from_arrays(row, ["block", "ids", "vectors"])

        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                if held and held + part.num_rows > BLOCK:
                    yield full()
                    held = 0
                ids.append(part.column(0))
                rows.append(integers(part.column(1).flatten().to_numpy(zero_copy_only=False), size))
                held += part.num_rows
        if held:
            yield full()

    return map_arrow(df, walk, "block long, ids array<long>, vectors binary")


def _starts(df: DataFrame, k: int) -> np.ndarray:
    """The first k kept vectors by sha256 of ``3:<id>``; rows that share an id by their components. k rows reach the driver."""
    key = F.sha2(F.concat(F.lit("3:"), F.col("id").cast("string")), 256)
    rows = df.where("id IS NOT NULL").orderBy(key, "vector").limit(k).select("vector").collect()
    return np.array([integers(np.array(r.vector, np.float64), len(r.vector))[0] for r in rows], np.int64)


def _totals(state: DataFrame, k: int, size: int) -> tuple[list[list[int]], list[int], np.ndarray, int]:
    """Sums, counts and radii of the clusters over all blocks, and vectors scanned: k rows of ``size`` numbers reach the driver."""
    parts = state.select("radii", F.posexplode("totals").alias("at", "n")).select("at", F.col("n").cast("decimal(20,0)").alias("n"), F.get("radii", "at").alias("r"))
    found, radii = [0] * (k + 1 + k * size), np.zeros(k)
    for r in parts.groupBy("at").agg(F.sum("n").alias("n"), F.max("r").alias("r")).collect():
        found[r["at"]] = int(r.n)
        if r["at"] < k:
            radii[r["at"]] = r.r
    return [found[k + 1 + c * size : k + 1 + (c + 1) * size] for c in range(k)], found[:k], radii, found[k]


@dataclass
class Clusters:
    """A finished run: assigned rows, final centroids, and how many vectors each round scanned against all centroids."""

    rows: DataFrame
    centroids: np.ndarray
    inertia: list[int] = field(default_factory=list)
    scanned: list[int] = field(default_factory=list)


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10, size: int = 64) -> Clusters:
    """Rows are id, cluster int, distance long (squared, to the final centroid)."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where(kept(F.col("vector"), size))
    centroids = _starts(rows, k)
    if not len(centroids):
        return Clusters(spark.createDataFrame([], "id long, cluster int, distance long"), centroids)
    k = len(centroids)
    tables = _Tables(spark)
    vectors = spark.table(tables.write(_blocks(rows, size).repartition(tables.buckets, "block")))

    def begin(batches: Iterator[pa.RecordBatch], centroids: np.ndarray = centroids) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                matrix = _matrix(value, size)
                found = first_bounds(matrix, centroids)
                yield _state_row(block, *found, _sums(matrix, found[0], k), k, len(matrix))

    def follow(step: Round):
        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = [batch.column(n) for n in ("block", "vectors", "cluster", "upper", "lower", "totals")]
                for block, value, cluster, upper, lower, totals in zip(*columns, strict=True):
                    matrix = _matrix(value, size)
                    before = np.frombuffer(cluster.as_buffer(), np.int32)
                    up = np.frombuffer(upper.as_buffer(), np.float32).astype(np.float64)
                    low = np.frombuffer(lower.as_buffer(), np.float32).astype(np.float64).reshape(-1, k)
                    after, up, low, scanned = moved(matrix, before, up, low, step)
                    # sums change by the vectors that went elsewhere
                    went = np.flatnonzero(after != before)
                    total = np.array(totals.as_py()[k + 1 :], np.int64).reshape(k, size) + _sums(matrix[went], after[went], k) - _sums(matrix[went], before[went], k)
                    yield _state_row(block.as_py(), after, up, low, total, k, scanned)

        return walk

    name = tables.write(map_arrow(vectors.select("block", "vectors"), begin, STATE).repartition(tables.buckets, "block"))
    scans = []
    for _ in range(rounds):
        state = spark.table(name)
        sums, counts, radii, scanned = _totals(state, k, size)
        scans.append(scanned)
        new = np.array([[s // n for s in row] if n else old for row, n, old in zip(sums, counts, centroids.tolist(), strict=True)], np.int64)
        step = Round(new, np.sqrt(((new - centroids) ** 2).sum(1).astype(np.float64)), approach(centroids, new, radii) * (1 + MARGIN))
        centroids = new
        before, name = name, tables.write(map_arrow(vectors.join(state.hint("shuffle_hash"), "block"), follow(step), STATE))
        tables.remove(before)

    def finish(batches: Iterator[pa.RecordBatch], centroids: np.ndarray = centroids) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, value, cluster in zip(batch.column("ids"), batch.column("vectors"), batch.column("cluster"), strict=True):
                matrix, where = _matrix(value, size), np.frombuffer(cluster.as_buffer(), np.int32)
                distance = np.zeros(len(where), np.int64)
                for c in np.unique(where):
                    distance[where == c] = squared(matrix[where == c], centroids[c : c + 1])[:, 0]
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(where), pa.array(distance)], ["id", "cluster", "distance"])

    state = spark.table(name)
    scans.append(_totals(state, k, size)[3])
    found = map_arrow(vectors.join(state.select("block", "cluster").hint("shuffle_hash"), "block"), finish, "id long, cluster int, distance long")
    inertia = [0] * k
    for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("x")).collect():
        inertia[r.cluster] = int(r.x)
    return Clusters(found, centroids, inertia, scans)


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def assigned(df: DataFrame, **settings) -> DataFrame:
    """``cluster``'s rows with cluster_inertia, inertia and centroid_sha256, which are k literals."""
    found = cluster(df, **settings)
    if not len(found.centroids):
        nothing = F.lit(None)
        return found.rows.withColumns({"cluster_inertia": nothing.cast("long"), "inertia": nothing.cast("long"), "centroid_sha256": nothing.cast("string")})
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("cluster"))
    return found.rows.withColumns({"cluster_inertia": pick(found.inertia).cast("long"), "inertia": F.lit(sum(found.inertia)).cast("long"), "centroid_sha256": pick([digest(c) for c in found.centroids])})
