"""N-gram Jaccard join: a MinHash LSH forest finds candidates, exact Jaccard of five-word shingles decides.

Each tree of the forest is a prefix trie of signatures of ``DEPTH`` MinHash values. Rows are dealt by the subtrie that
the shortest allowed prefix names and sorted by signature, so a task sees each subtrie as a sorted run. There it
matches the longest prefixes first and shortens them value by value, comparing whole signatures of what is not
joined yet, until all of the subtrie is joined or the prefix length that gives the target recall is done.

Words are longest runs of ASCII letters, digits and non-ASCII characters of the lower-cased text. A text with
fewer than five words, but one at least, has one shingle of all its words; a text without words has none and
links with nothing, not even with its copies. Null texts count as empty. Repeated rows of one doc_id count as
one row each in copies, and their links are those of their text. Columns other than the two named are ignored,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import U64, checkpointed, components, forest, gram_hashes, grouped, in_cells, joined, map_arrow, mix, steps, text_buffer, word_hashes

WORDS = 5
#: Values in a tree's signature: the longest prefix, which the forest matches first.
DEPTH = 8
TREES = 16


def forest_depth(similarity: float, trees: int, longest: int, recall: float) -> int:
    """The prefix length at which descending the trees may stop.

    Matching starts with the longest prefix and is shortened by one value at a time until pairs of the asked
    similarity meet in some tree with the target recall, 1 - (1 - s^depth)^trees.
    """
    depth = longest
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=U64))
    return seeds[:n] | U64(1), seeds[n:]


def signatures(values: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """MinHash values (uint32) of each set of 64-bit values; sets without values get the largest number."""
    counts = np.diff(offsets)
    full = np.flatnonzero(counts > 0)
    out = np.full((len(counts), size), 0xFFFFFFFF, np.uint32)
    if len(full):
        high = (values >> U64(32)).astype(np.uint32)
        low = values.astype(np.uint32)
        a, b = _coefficients(size)
        for k in range(size):
            hashed = (low * np.uint32(a[k] & U64(0xFFFFFFFF)) + high * np.uint32((a[k] >> U64(32)) | U64(1))) ^ np.uint32(b[k] & U64(0xFFFFFFFF))
            hashed *= np.uint32(0x85EBCA6B)
            hashed ^= hashed >> np.uint32(15)
            out[full, k] = np.minimum.reduceat(hashed, offsets[:-1][full])
    return out


def shingle_sets(texts: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, shingle hashes, offsets) for steps of the texts; hashes of one text may repeat."""
    data, offsets = text_buffer(pc.utf8_lower(texts))
    for a, b in steps(offsets):
        hashes, at = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        yield a, *gram_hashes(hashes, at, words)


def signed(docs: DataFrame, id_col: str, text_col: str, words: int, trees: int, depth: int) -> DataFrame:
    """doc, digest of its shingle set, n shingles, the subtrie of each tree (a hash of the first ``depth`` values) and one byte of every MinHash value."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, grams, at in shingle_sets(batch.column(1), words):
                n = len(at) - 1
                sets = [np.unique(grams[at[i] : at[i + 1]]) for i in range(n)]
                sizes = np.array([len(s) for s in sets], np.int64)
                whole = signatures(np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)]), trees * DEPTH)
                prefixes = np.empty((n, trees), np.int64)
                for t in range(trees):
                    key = np.full(n, t + 1, U64)
                    for d in range(depth):
                        key = mix(key * U64(31) + whole[:, t * DEPTH + d].astype(U64))
                    prefixes[:, t] = key.view(np.int64)
                kept = np.flatnonzero(sizes)
                rows = pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, n).take(pa.array(kept)),
                        pa.array([hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest() for i in kept], pa.binary()),
                        pa.array(sizes[kept]),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1, dtype=np.int32) * trees), pa.array(prefixes[kept].ravel())),
                        pa.array([x.tobytes() for x in whole[kept].astype(np.uint8)], pa.binary()),
                    ],
                    ["doc", "digest", "n", "prefixes", "sig"],
                )
                yield rows

    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return map_arrow(source, sign, "doc long, digest binary, n long, prefixes array<long>, sig binary")


def _agreement(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many signature bytes each pair of rows shares."""
    if len(left) * len(right) <= 1024:
        return (left[:, None] == right[None]).sum(2, dtype=np.int16)
    out = np.zeros((len(left), len(right)), np.int16)
    for k in range(left.shape[1]):
        out += left[:, k, None] == right[None, :, k]
    return out


def _sides(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the two blocks of a cell; the same rows twice within one block."""
    a, b, own = rows.column("cell_a")[0].as_py(), rows.column("cell_b")[0].as_py(), rows.column("own").to_numpy()
    return np.flatnonzero(own == a), np.flatnonzero(own == b)


def _matrix(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_py(), dtype) for x in column])


def _pairs(rows: pa.Table, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs across the cell's blocks whose signatures share ``least`` bytes; each unordered pair once."""
    left, right = _sides(rows)
    sig = _matrix(rows.column("sig"), np.uint8)
    a, b = np.nonzero(_agreement(sig[left], sig[right]) >= least)
    a, b = left[a], right[b]
    once = a < b if len(left) == len(right) and (left == right).all() else a != b
    return a[once], b[once]


def descend(rows: pa.Table, least: int, shortest: int) -> list[tuple[int, int]]:
    """A forest over a subtrie's rows (sorted by path) that joins every pair whose signatures share ``least`` bytes.

    Runs of rows with a common prefix are compared, from the longest prefix to the shortest; runs that are joined
    already are passed over.
    """
    left, right = _sides(rows)
    sides = np.zeros((2, rows.num_rows), bool)
    sides[0, left] = sides[1, right] = True
    sig, path = _matrix(rows.column("sig"), np.uint8), _matrix(rows.column("path"), np.uint8)
    root, kept = np.arange(rows.num_rows), []
    for depth in range(DEPTH, shortest - 1, -1):
        new = np.flatnonzero((path[1:, :depth] != path[:-1, :depth]).any(1)) + 1
        begin, end = np.concatenate([[0], new]), np.concatenate([new, [len(root)]])
        open_ = np.minimum.reduceat(root, begin) != np.maximum.reduceat(root, begin)
        first, second = [], []
        for x, y in zip(begin[open_].tolist(), end[open_].tolist(), strict=True):
            l, r = x + np.flatnonzero(sides[0, x:y]), x + np.flatnonzero(sides[1, x:y])
            i, j = np.nonzero((_agreement(sig[l], sig[r]) >= least) & (root[l][:, None] != root[r][None]))
            first.append(l[i])
            second.append(r[j])
        if first:
            # roots are rows of the tree, so an edge between roots joins the same trees
            more, parent = joined(len(root), root[np.concatenate(first)], root[np.concatenate(second)])
            kept += more
            root = parent[root]
    return kept


def _intersections(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (a, b) of sorted sets."""
    if len(a) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b, strict=True)], np.int64)
    everything = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, code, times = np.unique(everything, return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    keep = shared[code]
    code, owner = place[code[keep]], owner[keep]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(shared.sum()), 4096):
        i, j = np.searchsorted(code, [low, low + 4096])
        present = np.zeros((len(sets), 4096), np.float32)
        present[owner[i:j], code[i:j] - low] = 1
        total += present @ present.T
    return total[a, b].astype(np.int64)


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, words: int = WORDS, trees: int = TREES, recall: float = 0.9999, slack: float = 0.25, block: int = 512) -> DataFrame:
    """One row per document that has words: doc, class_id, n_links, kept.

    n_links counts the other documents whose shingle Jaccard is ``similarity`` or more, copies included;
    class_id is the smallest document reached by links, itself included; kept marks that one.

    Documents with equal shingle sets are one node. In each tree, nodes with an equal signature prefix of the
    depth that meets ``recall`` are compared by whole signatures; pairs within ``slack`` below the similarity
    join candidate groups, and inside each group all pairs with such signatures are verified on the exact sets.
    Large prefixes and groups are dealt into cells of bounded size in rows and bytes, so no task holds a whole hot group and no
    pair rows are made: a cell gives counts and a spanning forest.
    """
    depth = forest_depth(similarity, trees, DEPTH, recall)
    least = math.floor(max(0.0, similarity - slack) * trees * DEPTH)
    # a text's signature row is small, so it is kept and its text is read again only for candidates
    rows = checkpointed(signed(docs, id_col, text_col, words, trees, depth))
    # stored, so that the joins by digest are between exchanges and a text of very many copies can be split
    nodes = checkpointed(rows.groupBy("digest", "n").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies")))
    member = rows.select("doc", "digest", "n").join(nodes, ["digest", "n"])
    # several rows may carry one doc_id; the node's own row is one of them
    heads = rows.join(nodes.select("digest", "n", F.col("rep").alias("doc"), "copies"), ["doc", "digest", "n"]).groupBy("doc", "digest").agg(F.first("prefixes").alias("prefixes"), F.first("sig").alias("sig"), F.first("copies").alias("copies"), F.first("n").alias("n"))
    # a number of its own for each node, stored, so that unlike sets are never one node
    heads = checkpointed(heads.withColumn("node", F.monotonically_increasing_id()))

    prefixes = heads.select("node", F.posexplode("prefixes").alias("tree", "prefix"))
    # stored, so that the join below is between two exchanges and a prefix of many near copies can be split
    met = checkpointed(prefixes.groupBy("prefix").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("prefix"))
    meeting = prefixes.join(met, "prefix").join(heads.select("node", "sig"), "node")
    meeting = meeting.withColumn("path", F.substring("sig", F.col("tree") * DEPTH + 1, F.lit(DEPTH)))

    def link(rows: pa.Table) -> pa.RecordBatch | None:
        kept = descend(rows, least, depth)
        if not kept:
            return None
        node = rows.column("node").to_numpy()
        edges = np.array([(node[x], node[y]) for x, y in kept], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["u", "v"])

    edges = grouped(in_cells(meeting, ["prefix"], "node", block), ["prefix", "cell_a", "cell_b"], ["path", "node"], link, "u long, v long")
    candidates = components(edges)

    group = heads.join(candidates, "node").select("doc", "node", "component", "copies", "n", "sig", "digest")
    sets = _sets(docs, id_col, text_col, words, group)

    def verify(rows: pa.Table) -> pa.RecordBatch | None:
        a, b = _pairs(rows, least)
        if not len(a):
            return None
        node, copies = rows.column("node").to_numpy(), rows.column("copies").to_numpy()
        sets = [np.frombuffer(x.as_py(), U64) for x in rows.column("shingles")]
        sizes = np.array([len(s) for s in sets])
        common = _intersections(sets, a, b)
        # integers, so that a Jaccard of exactly the limit counts
        linked = common * 1_000_000 >= round(similarity * 1_000_000) * (sizes[a] + sizes[b] - common)
        a, b = a[linked], b[linked]
        links = np.zeros(len(node), np.int64)
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        some = np.flatnonzero(links)
        kept = np.array(forest(len(node), a, b), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([node[some], node[kept[:, 0]]])), pa.array(np.concatenate([node[some], node[kept[:, 1]]])), pa.array(np.concatenate([links[some], np.zeros(len(kept), np.int64)]))],
            ["u", "v", "links"],
        )

    found = checkpointed(grouped(in_cells(sets, ["component"], "node", block // 2, F.col("n") * 8), ["component", "cell_a", "cell_b"], ["node"], verify, "u long, v long, links long"))
    counts = found.where("links > 0").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    group_of = components(found.where("links = 0").select("u", "v"))

    named = heads.select("node", "doc", "digest").join(group_of, "node", "left").join(counts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = named.groupBy("component").agg(F.min("doc").alias("class_id"))
    named = named.join(first, "component").select("digest", "class_id", F.coalesce("links", F.lit(0)).alias("links"))
    return member.join(named, "digest").select("doc", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), (F.col("doc") == F.col("class_id")).alias("kept"))


def _sets(docs: DataFrame, id_col: str, text_col: str, words: int, group: DataFrame) -> DataFrame:
    """The candidates' sorted distinct shingle hashes, eight bytes each; one row per node."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.drop_columns(["text"])
            for first, grams, at in shingle_sets(batch.column("text"), words):
                n = len(at) - 1
                sets = [np.unique(grams[at[i] : at[i + 1]]).tobytes() for i in range(n)]
                own = [hashlib.blake2b(x, digest_size=16).digest() for x in sets]
                part = rest.slice(first, n)
                same = pc.equal(part.column("digest"), pa.array(own, pa.binary()))
                rows = pa.RecordBatch.from_arrays([*part.columns, pa.array(sets, pa.binary())], [*part.schema.names, "shingles"]).filter(same)
                yield rows.drop_columns(["digest"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    read = group.join(texts, "doc").select("doc", "node", "component", "copies", "n", "sig", "digest", "text")
    return map_arrow(read, cut, "doc long, node long, component long, copies long, n long, sig binary, shingles binary").dropDuplicates(["node"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document, those without words included (null id or no words: no links, kept).

    Returns doc_id, class_id, n_links, kept. Rows with a null id are left out, as they can't be named.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null")
    joined = jaccard_join(docs.where(F.col(id_col).isNotNull()), id_col, text_col, **options)
    joined = joined.groupBy("doc").agg(F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"))
    return ids.distinct().join(joined, ids["doc_id"] == joined["doc"], "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept")
    )
