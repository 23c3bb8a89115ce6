"""What several operators share: Arrow text buffers, word hashes, grouped Arrow kernels, checkpoints, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.shared import map_arrow

U64 = np.uint64
#: Bytes of text that a vectorised step handles at once; a longer single text makes a longer step.
STEP_BYTES = 1 << 20
#: Bytes of one text that are hashed at once.
LONG_TEXT = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only where that setting and the context's own folder are unset and all runs on this machine (as in tests) a
    local folder is taken; on a cluster that is an error, as each machine would write its own disk.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder as Parquet and read back: no lineage, and sizes as they are.

    (``DataFrame.checkpoint`` keeps a plan's size estimates, which loops of joins multiply without end.) The tables
    belong to the application and can be removed with its folder when it has ended.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the stored table that ``df`` reads, if it is one of ``checkpointed``'s; nothing may read it afterwards."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    for file in df.inputFiles()[:1]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if path.getName().startswith("table-") and folder.rpartition("/")[2] == path.getParent().getName():
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a fixed public mixing of 64-bit values."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string array; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together, one text at least."""
    at = 0
    while at < len(offsets) - 1:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end
        at = end


def _word_bytes() -> np.ndarray:
    is_word = np.zeros(256, bool)
    is_word[ord("0") : ord("9") + 1] = is_word[ord("a") : ord("z") + 1] = True
    is_word[128:] = True
    return is_word


IS_WORD = _word_bytes()
_BYTE_CODES = mix(np.arange(1, 257, dtype=U64))
STEP, UNSTEP = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of a 64-bit number, kept between calls."""
    if len(_powers.get(base, ())) < n:
        size = max(n, STEP_BYTES + (1 << 17))
        _powers[base] = np.concatenate([np.ones(1, U64), np.multiply.accumulate(np.full(size - 1, base, U64))])
    return _powers[base][:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of lower-cased texts, and each text's n+1 offsets into them.

    A word is a longest run of ASCII letters, digits and bytes of non-ASCII characters. A word's hash is the
    difference of two prefix sums of one polynomial over the buffer, brought to a common power and mixed. A single
    text beyond ``LONG_TEXT`` bytes is hashed in parts that end behind separators, so that only its hashes are held
    whole (a word of more bytes than that is cut).
    """
    n = len(data)
    if len(offsets) == 2 and n > LONG_TEXT:
        found, at = [], 0
        while at < n:
            gaps = np.flatnonzero(~IS_WORD[data[at : at + LONG_TEXT]])
            end = n if n - at <= LONG_TEXT else at + (int(gaps[-1]) + 1 if len(gaps) else LONG_TEXT)
            found.append(word_hashes(data[at:end], np.array([0, end - at]))[0])
            at = end
        hashes = np.concatenate(found)
        return hashes, np.array([0, len(hashes)])
    if not n:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    inside = IS_WORD[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    cuts = offsets[1:-1]
    after[cuts[(cuts > 0) & (cuts < n)] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    sums = np.zeros(n + 1, U64)
    np.cumsum(_BYTE_CODES[data] * powers(STEP, n), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * powers(UNSTEP, n)[starts])
    return hashes, np.searchsorted(starts, offsets)


def gram_hashes(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within each text, and n+1 offsets; a text with fewer words but one at least gives one for all its words."""
    counts = np.diff(offsets)
    n = len(words)
    if n == 0:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    runs = np.zeros(n, U64)
    for j in range(k):
        runs[: max(0, n - j)] += words[j:] * U64(mix(np.array([j + 1], U64))[0] | U64(1))
    short = (counts > 0) & (counts < k)
    kept = np.where(counts >= k, counts - k + 1, short)
    out = np.concatenate([[0], np.cumsum(kept)]).astype(np.int64)
    within = np.arange(out[-1]) - np.repeat(out[:-1], kept)
    grams = runs[np.repeat(offsets[:-1], kept) + within]
    for i in np.flatnonzero(short):
        own = words[offsets[i] : offsets[i + 1]]
        grams[out[i]] = sum(int(w) * int(mix(np.array([j + 1], U64))[0] | U64(1)) for j, w in enumerate(own)) % (1 << 64)
    return mix(grams), out


def grouped(df: DataFrame, keys: list[str], order: list[str], kernel: Callable[[pa.Table], pa.RecordBatch | pa.Table | None], schema: str, partitions: int | None = None) -> DataFrame:
    """Applies ``kernel`` to the rows of each key, as an Arrow table sorted by ``order``.

    Rows are dealt by key and sorted, and one task walks its runs of equal keys: a task holds one group at a
    time, so groups must have a bounded size (see ``in_cells``), and there may be millions of small ones. Rows are
    dealt to as many partitions as the session shuffles into, unless told otherwise: kernels cost far more than
    their bytes tell, so partitions shouldn't be put together by size.
    """
    dealt = df.repartition(partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def groups(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            edges = _edges(rows, keys)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                made = kernel(rows.slice(a, b - a))
                if made is not None:
                    yield from made.to_batches() if isinstance(made, pa.Table) else [made]

        for batch in batches:
            if not batch.num_rows:
                continue
            last = _edges(pa.Table.from_batches([batch]), keys)[-2]
            if last == 0 and waiting and _same(waiting[-1], batch, keys):
                waiting.append(batch)
                continue
            whole, rest = batch.slice(0, last), batch.slice(last)
            ready = [*waiting, *([whole] if whole.num_rows else [])]
            if ready:
                yield from groups(pa.Table.from_batches(ready))
            waiting = [rest]
        if waiting:
            yield from groups(pa.Table.from_batches(waiting))

    return map_arrow(dealt.sortWithinPartitions(*keys, *order), walk, schema)


def _edges(rows: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(max(0, rows.num_rows - 1), bool)
    for key in keys:
        column = rows.column(key).combine_chunks().to_numpy(zero_copy_only=False)
        change |= column[1:] != column[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [rows.num_rows]])


def _same(a: pa.RecordBatch, b: pa.RecordBatch, keys: list[str]) -> bool:
    return all(a.column(k)[a.num_rows - 1] == b.column(k)[0] for k in keys)


#: Bytes of rows that a block of a cell holds, or a single row that has more.
BLOCK_BYTES = 32 << 20


def in_cells(df: DataFrame, keys: list[str], member: str, block: int, size: Column | None = None) -> DataFrame:
    """Adds cell_a and cell_b so that any two rows of a key meet in exactly one cell of at most about two blocks.

    A block has about ``block`` rows at most, and ``BLOCK_BYTES`` if ``size`` tells a row's bytes. A key with one block keeps one cell (0, 0). A larger one is dealt into b blocks by the hash of
    ``member``; a row of block i goes to the b cells (min(i, j), max(i, j)); ``own`` is its block. No row is
    dropped and no task holds more than two blocks, so a key that holds a third of all rows is spread.
    """
    blocks = F.ceil(F.count(F.lit(1)) / block)
    if size is not None:
        blocks = F.greatest(blocks, F.ceil(F.sum(size) / BLOCK_BYTES))
    sizes = df.groupBy(*keys).agg(blocks.cast("int").alias("_blocks")).where("_blocks > 1")
    # stored, so that the few large keys are joined by their true size and a hot key's rows can be split
    rows = df.join(checkpointed(sizes), keys, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return rows.withColumn("cell_a", F.least("own", "_j")).withColumn("cell_b", F.greatest("own", "_j")).drop("_blocks", "_j")


def joined(n: int, left: np.ndarray, right: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A spanning forest of n nodes that joins what the given pairs join, and each node's root, the smallest of its tree.

    In rounds: each tree that meets one with a smaller root is hooked to the smallest such; depths are flattened.
    """
    parent = np.arange(n)
    kept: list[tuple[int, int]] = []
    while len(left):
        a, b = parent[left], parent[right]
        apart = a != b
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        if not len(left):
            break
        low, high = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((low, high))
        first = order[np.concatenate([[True], high[order][1:] != high[order][:-1]])]
        parent[high[first]] = low[first]
        kept += zip(left[first].tolist(), right[first].tolist(), strict=True)
        while (parent[parent] != parent).any():
            parent = parent[parent]
    return kept, parent


def forest(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """The edges of ``joined``: n - 1 at most."""
    return joined(n, left, right)[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u long, v long): the smallest node that it reaches.

    In rounds: each node points to its smallest neighbour; pointers are doubled until all lead to a local
    minimum; each tree becomes one node, and labels are composed. A round at least halves the nodes that still
    have edges, and a chain of n pointers takes log2 n doublings. Each step is cut off by a checkpoint in the shared
    folder. Nothing is collected but whether something is left to do.
    """
    live = checkpointed(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    labels = None
    while True:
        both = live.union(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        points = checkpointed(both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p")))
        while True:
            ahead = points.select(F.col("u").alias("p"), F.col("p").alias("q"))
            doubled = checkpointed(points.join(ahead, "p").select("u", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")))
            points = doubled.select("u", "p")
            if doubled.where("moved").isEmpty():
                break
        if labels is None:
            labels = points.select(F.col("u").alias("node"), F.col("p").alias("component"))
        else:
            labels = checkpointed(labels.join(points, labels["component"] == points["u"], "left").select("node", F.coalesce("p", "component").alias("component")))
        ends = points.select(F.col("u").alias("v"), F.col("p").alias("q"))
        live = checkpointed(live.join(points, "u").join(ends, "v").where("p <> q").select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct())
        if live.isEmpty():
            return labels
