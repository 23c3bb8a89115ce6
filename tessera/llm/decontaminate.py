"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are word sequences (longest runs of ASCII letters, digits and non-ASCII characters of
the lower-cased text). Seeds are runs of ``least`` words that a document shares with an item. For each document
and item with enough seeds, tiles are marked: again and again the longest match between words that are unmarked on
both sides, found by Karp-Rabin passes over run lengths that fall down to ``least`` words. A document is contaminated
by an item if its tiles cover ``coverage`` of the item's words or more; the order of the tiles does not matter, so reordered passages are
found. Items of fewer words than ``least`` need a whole match.

The benchmark's size is checked: up to ``most_words`` words it travels with the tasks and documents are read once,
without a shuffle; beyond that documents' word runs are joined with the seeds by a shuffle. Both give the same
rows. Null texts count as empty and match nothing; items without words neither. Repeated rows give repeated
results; columns other than those named are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import STEP, U64, UNSTEP, checkpointed, gram_hashes, map_arrow, powers, steps, text_buffer, word_hashes

LEAST = 5
COVERAGE = 0.5
#: Places of shared seeds in the benchmark that a step looks at together.
MOST_PLACES = 1 << 20
SCHEMA = "doc long, item_id long, n_tiles long, covered long, item_words long, coverage double"


def word_lists(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, word hashes, offsets) for steps of the texts."""
    data, offsets = text_buffer(pc.utf8_lower(texts))
    for a, b in steps(offsets):
        yield a, *word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of exactly k words of one text."""
    if len(words) < k:
        return np.zeros(0, U64)
    return gram_hashes(words, np.array([0, len(words)]), k)[0]


class Sequence:
    """One word sequence with its unmarked words; Karp-Rabin hashes of its runs of any length come from one polynomial's prefix sums."""

    def __init__(self, words: np.ndarray, free: np.ndarray):
        self.words, self.free = words, free
        self.sums = np.zeros(len(words) + 1, U64)
        np.cumsum(words * powers(STEP, len(words)), out=self.sums[1:])

    def open_runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of n unmarked words start, and their hashes."""
        marked = np.concatenate([[0], np.cumsum(~self.free)])
        at = np.flatnonzero(marked[n:] == marked[: len(marked) - n])
        return at, (self.sums[at + n] - self.sums[at]) * powers(UNSTEP, len(self.words))[at]


def _share_a_run(item: Sequence, doc: Sequence, n: int) -> bool:
    own, other = item.open_runs(n)[1], doc.open_runs(n)[1]
    return bool(len(own) and len(other) and np.isin(own, other).any())


def _longest(item: Sequence, doc: Sequence, least: int, most: int) -> int:
    """The length of the longest run that both have unmarked, from ``least`` to ``most``; 0 if there is none.

    A shared run of n words holds one of n - 1, so the length is found by halving.
    """
    if most < least or not _share_a_run(item, doc, least):
        return 0
    if _share_a_run(item, doc, most):
        return most
    while most - least > 1:
        middle = (least + most) // 2
        least, most = (middle, most) if _share_a_run(item, doc, middle) else (least, middle)
    return least


def _mark(item: Sequence, doc: Sequence, n: int) -> int:
    """Marks matches of n words that don't overlap, by item, then document position; returns how many."""
    (places, own), (others, theirs) = item.open_runs(n), doc.open_runs(n)
    order = np.argsort(theirs, kind="stable")
    others, theirs = others[order], theirs[order]
    low, high = np.searchsorted(theirs, own, "left"), np.searchsorted(theirs, own, "right")
    found = 0
    for p, at, end in zip(places[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
        if not item.free[p : p + n].all():
            continue
        while at < end:
            q = int(others[at])
            taken = np.flatnonzero(~doc.free[q : q + n])
            if not len(taken) and (item.words[p : p + n] == doc.words[q : q + n]).all():
                item.free[p : p + n] = doc.free[q : q + n] = False
                found += 1
                break
            # on to the first run behind the last marked word
            behind = q + int(taken[-1]) + 1 if len(taken) else q + 1
            at += max(1, int(np.searchsorted(others[at:end], behind)))
    return found


def tile(doc: np.ndarray, item: np.ndarray, least: int) -> tuple[int, int]:
    """(number of tiles, words of the item that they cover), longest unmarked matches first; ties by item, then document position.

    Run lengths fall from the longest shared one to ``least``, each by a Karp-Rabin pass over both sequences, so memory
    follows their lengths, however often their words repeat.
    """
    least = min(least, len(item))
    if not least or len(doc) < least:
        return 0, 0
    # only words in shared runs of ``least`` can be covered; one word between stretches of them keeps them apart
    shared = np.flatnonzero(np.isin(runs(doc, least), runs(item, least)))
    change = np.zeros(len(doc) + 1, np.int64)
    np.add.at(change, shared, 1)
    np.add.at(change, shared + least, -1)
    near = np.cumsum(change)[:-1] > 0
    kept = near.copy()
    kept[1:] |= near[:-1]
    a, b = Sequence(item, np.ones(len(item), bool)), Sequence(doc[kept], near[kept])
    tiles = covered = 0
    longest = min(len(item), int(near.sum()))
    while longest := _longest(a, b, least, longest):
        found = _mark(a, b, longest)
        tiles, covered, longest = tiles + found, covered + found * longest, longest - 1
    return tiles, covered


class Benchmark:
    """Items' words and the sorted seeds with the items that hold them."""

    def __init__(self, ids: list[int], words: list[np.ndarray], least: int):
        self.ids, self.words, self.least = ids, words, least
        self.lengths = sorted({min(least, len(w)) for w in words if len(w)})
        self.seeds, self.items = {}, {}
        for k in self.lengths:
            pairs = [(runs(w, k), n) for n, w in enumerate(words) if len(w) and min(least, len(w)) == k]
            seeds = np.concatenate([s for s, _ in pairs])
            items = np.concatenate([np.full(len(s), n) for s, n in pairs])
            order = np.argsort(seeds, kind="stable")
            self.seeds[k], self.items[k] = seeds[order], items[order]

    def candidates(self, words: np.ndarray, offsets: np.ndarray, coverage: float) -> Iterator[tuple[int, int]]:
        """(text, item) with enough places of shared seeds in the item to reach the coverage: a place covers k words at most."""
        for k in self.lengths:
            grams, first = gram_hashes(words, offsets, k)
            seeds = self.seeds[k]
            where = np.minimum(np.searchsorted(seeds, grams), len(seeds) - 1)
            hit = np.flatnonzero(seeds[where] == grams)
            if not len(hit):
                continue
            text = np.searchsorted(first, hit, "right") - 1
            # texts with fewer than k words have a gram of their own length, which is no seed of length k
            hit, text = hit[np.diff(offsets)[text] >= k], text[np.diff(offsets)[text] >= k]
            # a seed counts once for a text, but as often as it stands in the item
            text, low = np.unique(np.stack([text, np.searchsorted(seeds, grams[hit], "left")], 1), axis=0).T
            times = np.searchsorted(seeds, seeds[low], "right") - low
            # texts together as long as their places stay few; one text has no more places than the benchmark
            starts = np.concatenate([[0], np.flatnonzero(np.diff(text)) + 1, [len(text)]])
            total = np.concatenate([[0], np.cumsum(times)])[starts]
            at = 0
            while at < len(starts) - 1:
                end = max(at + 1, int(np.searchsorted(total, total[at] + MOST_PLACES, "right")) - 1)
                own = slice(starts[at], starts[end])
                place = np.repeat(low[own] - np.cumsum(times[own]) + times[own], times[own]) + np.arange(total[end] - total[at])
                pairs, n = np.unique(np.stack([np.repeat(text[own], times[own]), self.items[k][place]], 1), axis=0, return_counts=True)
                for (t, item), shared in zip(pairs.tolist(), n.tolist(), strict=True):
                    if shared * k >= coverage * len(self.words[item]):
                        yield t, item
                at = end


def _found(doc: int | None, words: np.ndarray, item_id: int | None, item: np.ndarray, least: int, coverage: float) -> tuple | None:
    tiles, covered = tile(words, item, least)
    return (doc, item_id, tiles, covered, len(item), covered / len(item)) if covered >= coverage * len(item) and covered else None


def _rows(found: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 5 + [pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), types, strict=True)], ["doc", "item_id", "n_tiles", "covered", "item_words", "coverage"])


def _listed(df: DataFrame) -> DataFrame:
    """key, words (array of hashes), of texts with words."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, words, at in word_lists(batch.column(1)):
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(words.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(at) - 1), lists], ["key", "words"])

    return map_arrow(df, walk, "key long, words array<long>").where(F.size("words") > 0)


def _items(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    return _listed(benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("key"), F.col(item_text_col).alias("text")).dropDuplicates())


def _words(items: DataFrame) -> int:
    return items.agg(F.sum(F.size("words"))).first()[0] or 0


def _collected(items: DataFrame, least: int) -> Benchmark | None:
    """The items of a benchmark of checked size, None if it has none."""
    listed = items.orderBy("key").collect()
    return Benchmark([r.key for r in listed], [np.array(r.words, np.int64).view(U64) for r in listed], least) if listed else None


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST, coverage: float = COVERAGE, most_words: int = 2_000_000) -> DataFrame:
    """One row per document row and benchmark item that contaminates it."""
    items = _items(benchmark, item_col, item_text_col)
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    if _words(items) > most_words:
        return _overlaps_by_join(source, items, least, coverage)
    known = _collected(items, least)
    if known is None:
        return docs.sparkSession.createDataFrame([], SCHEMA)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, words, at in word_lists(batch.column(1)):
                found = []
                for t, item in known.candidates(words, at, coverage):
                    row = _found(ids[first + t].as_py(), words[at[t] : at[t + 1]], known.ids[item], known.words[item], least, coverage)
                    if row:
                        found.append(row)
                if found:
                    yield _rows(found)

    return map_arrow(source, walk, SCHEMA)


def _overlaps_by_join(source: DataFrame, items: DataFrame, least: int, coverage: float) -> DataFrame:
    """For benchmarks too large to send out: seeds are joined by a shuffle, then pairs are tiled."""
    items = checkpointed(items.withColumn("item", F.monotonically_increasing_id()).withColumn("k", F.least(F.size("words"), F.lit(least))))
    lengths = sorted(r.k for r in items.select("k").distinct().collect())  # at most ``least`` rows

    def cut(rows: DataFrame, name: str, every: list[int] | None) -> DataFrame:
        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n, key in enumerate(batch.column(0).to_pylist()):
                    words = np.array(batch.column(1)[n].as_py(), np.int64).view(U64)
                    for k in every if every is not None else [min(least, len(words))]:
                        seeds, times = np.unique(runs(words, k), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([key] * len(seeds), pa.int64()), pa.array(np.full(len(seeds), k, np.int32)), pa.array(seeds.view(np.int64)), pa.array(times)], [name, "k", "seed", "times"])

        return map_arrow(rows, walk, f"{name} long, k int, seed long, times long")

    rows = checkpointed(source.withColumn("row", F.monotonically_increasing_id()))
    texts = checkpointed(_listed(rows.select("row", "text")))
    seeds = cut(items.select("item", "words"), "item", None)
    shared = cut(texts, "row", lengths).drop("times").join(seeds, ["k", "seed"]).groupBy("row", "item", "k").agg(F.sum("times").alias("n"))
    pairs = shared.join(items.select("item", F.col("key").alias("item_id"), F.col("words").alias("item_words")), "item").where(F.col("n") * F.col("k") >= coverage * F.size("item_words"))
    pairs = pairs.join(texts.withColumnRenamed("key", "row"), "row").join(rows.select("row", "doc"), "row").select("doc", "words", "item_id", "item_words")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                row = _found(r["doc"], np.array(r["words"], np.int64).view(U64), r["item_id"], np.array(r["item_words"], np.int64).view(U64), least, coverage)
                if row:
                    yield _rows([row])

    return map_arrow(pairs, walk, SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST, coverage: float = COVERAGE, most_words: int = 2_000_000) -> DataFrame:
    """The rows of ``docs`` that no benchmark item contaminates; each row is judged by its own text, whatever its id."""
    items = _items(benchmark, item_col, item_text_col)
    if _words(items) > most_words:
        # stored, so that a row keeps its key however often it is read; columns of the input can't clash with it
        key = f"_row_{uuid.uuid4().hex}"
        rows = checkpointed(docs.withColumn(key, F.monotonically_increasing_id()))
        source = rows.select(F.col(key).alias("doc"), F.col(text_col).alias("text"))
        bad = _overlaps_by_join(source, items, least, coverage).select(F.col("doc").alias(f"{key}_bad")).distinct()
        return rows.join(bad, F.col(key) == F.col(f"{key}_bad"), "left_anti").drop(key)
    known = _collected(items, least)
    if known is None:
        return docs
    position = docs.columns.index(text_col)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for first, words, at in word_lists(batch.column(position)):
                for t, item in known.candidates(words, at, coverage):
                    if clean[first + t] and _found(None, words[at[t] : at[t + 1]], None, known.words[item], least, coverage):
                        clean[first + t] = False
            yield batch.filter(pa.array(clean))

    return map_arrow(docs, walk, docs.schema)
