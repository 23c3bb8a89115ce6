"""Embedding near-dedup: an epsilon grid order join under cosine similarity.

Vectors of equal length are compared as unit vectors, where a cosine of s is a distance of sqrt(2 - 2 s) = eps.
They are put into grid order: sorted by their cells of side eps on the leading principal dimensions, then by their
coordinates. The sequence is cut into blocks. Pairs of sequence intervals are refined level by level, from the
whole sequence down to blocks, and pairs whose bounding boxes lie more than eps apart are skipped, as a projection
never lengthens a distance. Block pairs that are left are joined in tasks: the two intervals are halved in the
same way down to small ones, which are compared by matrix products.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
different lengths. Equal vectors are one node with a count, and a task gives counts and a spanning forest, so
dense groups make no pair rows. Cosines within 1e-5 of the limit are computed again in double precision. Rows with
a null id are left out; rows that share an id are vectors of their own. Other columns are ignored and an empty
table gives an empty result. The principal axes come from a bounded sample and decide about speed only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpointed, components, forest, grouped, map_arrow

AXES = 6
FANOUT = 4
LEAF = 512
#: Bytes of vectors that a block holds, if that is fewer than its rows.
BLOCK_BYTES = 32 << 20
NEAR = 1e-5


def packed(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, vec: the components as little-endian doubles, null where the vector can't be compared."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            values = lists.values
            # a null component becomes NaN, so that it makes its vector unfit
            flat = pc.fill_null(values.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
            at, null = lists.offsets.to_numpy(), lists.is_null().to_numpy(zero_copy_only=False)
            out = []
            for i in range(len(lists)):
                x = flat[at[i] : at[i + 1]]
                out.append(x.tobytes() if not null[i] and len(x) and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "vec"])

    source = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"))
    return map_arrow(source, walk, "id long, vec binary")


def unit(rows: list[bytes]) -> np.ndarray:
    """Unit vectors of packed ones; scaling first keeps very large and very small components finite."""
    x = np.stack([np.frombuffer(r, np.float64) for r in rows])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def principal_axes(nodes: DataFrame, rows: int = 4096) -> dict[int, np.ndarray]:
    """For each vector size (in bytes) in a random sample of at most ``rows`` nodes: axes of the largest spread, as columns."""
    share = min(1.0, 1.5 * rows / max(1, nodes.count()))
    sample = nodes.select("vec").sample(fraction=share, seed=7).limit(rows).collect()
    by_size: dict[int, list[bytes]] = {}
    for r in sample:
        by_size.setdefault(len(r.vec), []).append(bytes(r.vec))
    axes = {}
    for size, own in by_size.items():
        x = unit(own)
        _, vectors = np.linalg.eigh(np.cov(x.T).reshape(x.shape[1], x.shape[1]) if len(x) > 1 else np.eye(x.shape[1]))
        axes[size] = np.ascontiguousarray(vectors[:, ::-1][:, :AXES])
    return axes


def _axes(axes: dict[int, np.ndarray], size: int) -> np.ndarray:
    """The axes of a vector size; sizes outside the sample take their first coordinates."""
    return axes[size] if size in axes else np.eye(size // 8)[:, :AXES]


def placed(nodes: DataFrame, axes: dict[int, np.ndarray], eps: float) -> DataFrame:
    """Nodes with their size, cells and coordinates on the axes (missing axes count as 0)."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("vec").to_pylist()
            where = np.zeros((len(rows), AXES))
            sizes = np.array([len(r) for r in rows])
            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                a = _axes(axes, size)
                where[own, : a.shape[1]] = unit([rows[i] for i in own]) @ a
            cells = np.floor(where / eps).astype(np.int32)
            lists = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), AXES).cast(pa.list_(pa.array(x[:0].ravel()).type))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes.astype(np.int32)), lists(cells), lists(where)], [*batch.schema.names, "size", "cells", "at"])

    return map_arrow(nodes, walk, "vec binary, node long, copies long, size int, cells array<int>, at array<double>")


def sequenced(nodes: DataFrame, block: int) -> DataFrame:
    """The nodes with ``seq``, their place in grid order, and ``block``; sizes never share a block's boxes, as size sorts first.

    Places are numbered by weight: 1, or more for vectors so wide that ``block`` of them pass BLOCK_BYTES.
    """
    order = [F.col("size"), F.col("cells"), F.col("at"), F.col("node")]
    dealt = nodes.repartitionByRange(*order).sortWithinPartitions(*order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            weight = np.maximum(1, -(-batch.column("size").to_numpy().astype(np.int64) * block // BLOCK_BYTES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(weight), part, np.int32)), pa.array(n + np.cumsum(weight) - weight), pa.array(weight)], [*batch.schema.names, "part", "within", "weight"])
            n += int(weight.sum())

    numbered = checkpointed(map_arrow(dealt, number, "vec binary, node long, copies long, size int, cells array<int>, at array<double>, part int, within long, weight long"))
    # one row for each partition that has rows: as many as there are tasks
    counts = sorted((r.part, r.n) for r in numbered.groupBy("part").agg(F.sum("weight").alias("n")).collect())
    before, total = [], 0
    for part, n in counts:
        before.append((part, total))
        total += n
    starts = nodes.sparkSession.createDataFrame(before, "part int, before long")
    return numbered.join(F.broadcast(starts), "part").withColumn("seq", F.col("before") + F.col("within")).withColumn("block", F.floor(F.col("seq") / block).cast("long")).drop("part", "within", "before", "cells", "weight")


def _gap(low: Column, high: Column, other_low: Column, other_high: Column) -> Column:
    """Squared distance of two boxes."""
    sides = F.transform(F.sequence(F.lit(1), F.lit(AXES)), lambda k: F.greatest(F.lit(0.0), F.element_at(low, k) - F.element_at(other_high, k), F.element_at(other_low, k) - F.element_at(high, k)))
    return F.aggregate(sides, F.lit(0.0), lambda s, x: s + x * x)


def block_pairs(rows: DataFrame, eps: float) -> DataFrame:
    """a, b (a <= b): the block pairs that may hold vectors within eps, refined from the whole sequence down."""
    low = F.array(*[F.min(F.element_at("at", k + 1)) for k in range(AXES)])
    high = F.array(*[F.max(F.element_at("at", k + 1)) for k in range(AXES)])
    boxes = checkpointed(rows.groupBy("block").agg(low.alias("low"), high.alias("high"), F.min("size").alias("size_low"), F.max("size").alias("size_high")))
    last = boxes.agg(F.max("block")).first()[0]
    if last is None:
        return rows.sparkSession.createDataFrame([], "a long, b long")
    levels = 0
    while FANOUT**levels <= last:
        levels += 1
    pairs = rows.sparkSession.createDataFrame([(0, 0)], "a long, b long")
    for level in range(levels - 1, -1, -1):
        own = boxes.withColumn("i", F.floor(F.col("block") / FANOUT**level).cast("long"))
        merged = own.groupBy("i").agg(
            F.array(*[F.min(F.element_at("low", k + 1)) for k in range(AXES)]).alias("low"), F.array(*[F.max(F.element_at("high", k + 1)) for k in range(AXES)]).alias("high"),
            F.min("size_low").alias("size_low"), F.max("size_high").alias("size_high"),
        )
        children = pairs.withColumn("a", F.explode(F.transform(F.sequence(F.lit(0), F.lit(FANOUT - 1)), lambda k: F.col("a") * FANOUT + k)))
        children = children.withColumn("b", F.explode(F.transform(F.sequence(F.lit(0), F.lit(FANOUT - 1)), lambda k: F.col("b") * FANOUT + k))).where("a <= b")
        left = merged.select(*[F.col(c).alias(f"{c}_a") for c in merged.columns])
        right = merged.select(*[F.col(c).alias(f"{c}_b") for c in merged.columns])
        near = children.join(left, F.col("a") == F.col("i_a")).join(right, F.col("b") == F.col("i_b"))
        near = near.where((F.col("size_low_a") <= F.col("size_high_b")) & (F.col("size_low_b") <= F.col("size_high_a")))
        pairs = checkpointed(near.where(_gap(F.col("low_a"), F.col("high_a"), F.col("low_b"), F.col("high_b")) <= eps * eps + 1e-9).select("a", "b"))
    return pairs


def interval_pairs(left: np.ndarray, right: np.ndarray, same: bool, eps: float) -> Iterator[tuple[int, int, int, int]]:
    """Pairs of intervals of at most LEAF rows that may be within eps, by halving; rows of ``left`` and ``right`` are coordinates."""
    waiting = [(0, len(left), 0, len(right))]
    while waiting:
        a, b, c, d = waiting.pop()
        if a == b or c == d or same and c >= b and a >= d or same and a >= d:
            continue
        gap = np.maximum(0, np.maximum(left[a:b].min(0) - right[c:d].max(0), right[c:d].min(0) - left[a:b].max(0)))
        if (gap * gap).sum() > eps * eps + 1e-9:
            continue
        if max(b - a, d - c) <= LEAF:
            yield a, b, c, d
            continue
        m, n = (a + b) // 2, (c + d) // 2
        waiting += [(a, m, c, n), (a, m, n, d), (m, b, n, d)] + ([] if same and (a, b) == (c, d) else [(m, b, c, n)])


def similar(x: np.ndarray, y: np.ndarray, same: bool, cosine: float, left: np.ndarray, right: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of unit vectors with the cosine or more; for the same block each unordered pair once."""
    small_x, small_y = x.astype(np.float32), y.astype(np.float32)
    first, second = [], []
    for a, b, c, d in interval_pairs(left, right, same, eps):
        near = small_x[a:b] @ small_y[c:d].T
        i, j = np.nonzero(near >= cosine - NEAR)
        if not len(i):
            continue
        unsure = np.flatnonzero(near[i, j] < cosine + NEAR)
        i, j = i + a, j + c
        keep = np.ones(len(i), bool)
        keep[unsure] = (x[i[unsure]] * y[j[unsure]]).sum(1) >= cosine
        if same:
            keep &= i < j
        first.append(i[keep])
        second.append(j[keep])
    none = np.zeros(0, np.int64)
    return (np.concatenate(first), np.concatenate(second)) if first else (none, none)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, block: int = 8192) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept."""
    eps = float(np.sqrt(2 - 2 * cosine))
    rows = checkpointed(packed(vectors, id_col, vector_col))
    fit = rows.where("vec is not null")
    nodes = checkpointed(fit.groupBy("vec").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).withColumn("node", F.monotonically_increasing_id()))
    axes = principal_axes(nodes)
    sequence = checkpointed(sequenced(placed(nodes.select("vec", "node", "copies"), axes, eps), block))
    pairs = block_pairs(sequence, eps)
    # a row goes to each of its block's pairs; which of the two is the left one does not matter to the counts
    wanted = pairs.withColumn("block", F.explode(F.array_distinct(F.array("a", "b"))))
    dealt = sequence.drop("at").join(wanted, "block")

    def join(table: pa.Table) -> pa.RecordBatch | None:
        blocks = table.column("block").to_numpy()
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        sizes = table.column("size").to_numpy()
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        links, found = np.zeros(len(node), np.int64), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        vec = table.column("vec").to_pylist()
        for size in np.unique(sizes).tolist():
            p, q = np.flatnonzero((blocks == a) & (sizes == size)), np.flatnonzero((blocks == b) & (sizes == size))
            if not len(p) or not len(q):
                continue
            x = unit([vec[i] for i in p])
            y = x if a == b else unit([vec[i] for i in q])
            own = _axes(axes, size)
            i, j = similar(x, y, a == b, cosine, x @ own, y @ own, eps)
            i, j = p[i], q[j]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            found.append((i, j))
        kept = np.array(forest(len(node), *map(np.concatenate, zip(*found, strict=True))), np.int64).reshape(-1, 2)
        some = np.flatnonzero(links)
        if not len(some):
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([node[some], node[kept[:, 0]]])), pa.array(np.concatenate([node[some], node[kept[:, 1]]])), pa.array(np.concatenate([links[some], np.zeros(len(kept), np.int64)]))], ["u", "v", "links"])

    met = checkpointed(grouped(dealt, ["a", "b"], ["seq"], join, "u long, v long, links long"))
    counts = met.where("links > 0").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    groups = components(met.where("links = 0").select("u", "v"))
    named = nodes.join(groups, "node", "left").join(counts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "component").select("vec", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.join(named, "vec", "left")
    return out.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"),
        (F.col("id") == F.coalesce("component_id", "id")).alias("kept"),
    )
