"""Spelling variants: words that differ by one code point, found in a trie of letter-group counts.

*Words.* Longest runs of ASCII letters and the code points U+00C0 to U+00FF in whole texts, A-Z lower-cased, counted by partial
aggregation. (``occurrences`` can also damage a fixed share of runs by one code point, as the query's contract asks.)

*Trie.* Letters are dealt into ``GROUPS`` groups of about equal weight. A word's frequency vector says how many of its
letters each group has; the trie's levels are the counts of one group after the other. One inserted, deleted or replaced code
point adds at most one to one count (surplus) and takes at most one from another (deficit), so a depth-first search from a
word spends a budget of one each, and all words that it can reach are in the subtries it doesn't leave. Words at its leaves are verified by comparing them.

*Distribution.* The trie is cut at the first depth at which no subtrie holds more than ``SUBTRIE`` words. A word is dealt to
its own subtrie and, as a visitor with what is left of its budget, to those behind its own that the upper levels allow; a pair of words
meets in exactly one subtrie. Within a task all words and visitors of a subtrie descend together. A subtrie that
no depth makes smaller (anagrams) is dealt into cells of pairs of blocks. A task gives one row a word: its
number of near words there and the best of them; rows are merged by aggregation.

*Forms.* A word's form is its near word of largest n (ties: smallest in code-point order) if that n is at least twice its own. Forms are
followed to the last by doubling: n doubles along a chain, so it has log2 n steps, and the doubling log2 of that.

Null and empty texts have no runs. Repeated rows count each time. A null id damages no run. Words of any length are handled, in steps of
bounded bytes or one pair. Other columns are not read. No words give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpointed, discard, grouped, in_cells, map_arrow, text_buffer

GROUPS = 16
#: Words of a subtrie.
SUBTRIE = 8192
#: Words of a trie node that are compared without going deeper.
LEAF = 24
#: Bytes of words that are compared at once.
STEP = 8 << 20
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int | None = None) -> DataFrame:
    """word, n: how often each run occurs. With ``damage``, a run whose crc32 of ``<id>:<run>`` it divides loses the code point at crc32 % length."""
    lowered = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    runs = docs.select(F.col(id_col).cast("string").alias("_id"), F.explode(F.regexp_extract_all(lowered, F.lit(f"({RUN})"), 1)).alias("word"))
    if damage:
        h = F.crc32(F.concat("_id", F.lit(":"), "word").cast("binary"))
        at = (F.col("_h") % F.length("word")).cast("int")
        rest = F.concat(F.col("word").substr(F.lit(1), at), F.col("word").substr(at + 2, F.length("word")))
        runs = runs.withColumn("_h", h).withColumn("word", F.when(F.col("_h") % damage == 0, rest).otherwise(F.col("word")))
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


class Letters:
    """The letters' groups: each letter goes to the lightest group so far, the most frequent first."""

    def __init__(self, weights: dict[int, int], groups: int = GROUPS):
        self.groups = groups
        self.group = np.zeros(256, np.int64)
        load = np.zeros(groups)
        for letter, weight in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
            self.group[letter] = load.argmin()
            load[self.group[letter]] += weight

    def vectors(self, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Counts of each word's letters by group; beyond 255 all are 255, which no edit sees as more than one step."""
        lengths = np.diff(offsets)
        places = np.repeat(np.arange(len(lengths)), lengths) * self.groups + self.group[codes]
        return np.minimum(np.bincount(places, minlength=len(lengths) * self.groups), 255).astype(np.uint8).reshape(-1, self.groups)


def weights(words: DataFrame) -> dict[int, int]:
    """How many words' places each letter takes: one row a letter reaches the driver."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''").groupBy("letter").count()
    return {ord(r.letter): r["count"] for r in letters.collect()}


def codes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a string array (all below U+0100) one after the other, and each word's n+1 offsets."""
    data, offsets = text_buffer(words)
    lead = data == 0xC3  # the first byte of U+00C0 to U+00FF; the second is 0x40 less than the code point
    codes = np.where(data >= 0x80, data + 0x40, data).astype(np.uint8)[~lead]
    before = np.concatenate([[0], np.cumsum(~lead)])
    return codes, before[offsets]


def near(codes: np.ndarray, offsets: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether words left[i] and right[i] differ by exactly one inserted, deleted or replaced code point."""
    lengths = np.diff(offsets)
    swap = lengths[left] > lengths[right]
    a, b = np.where(swap, right, left), np.where(swap, left, right)  # a is the shorter
    found = np.zeros(len(left), bool)
    possible = np.flatnonzero(lengths[b] - lengths[a] <= 1)
    possible = possible[np.argsort(lengths[b[possible]], kind="stable")]
    sizes = lengths[b[possible]]
    at = 0
    while at < len(possible):
        width = int(sizes[at])
        # as many pairs as fit, by the longest of them
        reach = np.searchsorted(sizes[at:], width * 2, "right")
        end = at + max(1, min(int(reach), STEP // max(1, 2 * width * 2)))
        part = possible[at:end]
        width = int(lengths[b[part]].max())
        columns = np.arange(width)
        x = codes[np.minimum(offsets[a[part]][:, None] + columns, len(codes) - 1)]
        y = codes[np.minimum(offsets[b[part]][:, None] + columns, len(codes) - 1)]
        short, long = lengths[a[part]][:, None], lengths[b[part]][:, None]
        same = (x == y) & (columns < short)
        prefix = (~same).argmax(1)
        shifted = codes[np.minimum(offsets[b[part]][:, None] + columns + (long - short), len(codes) - 1)]
        # behind the first difference the rest must agree, moved by one if lengths differ
        start = prefix[:, None] + (long == short)
        rest = ((x == shifted) | (columns < start) | (columns >= short)).all(1)
        found[part] = rest & ((long > short)[:, 0] | (prefix < short[:, 0]))
        at = end
    return found


def _allowed(vector: np.ndarray, counts: int, surplus: np.ndarray, deficit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which searches may enter the child of a count, and what they have then spent."""
    change = vector.astype(np.int16) - counts
    s, d = surplus + np.maximum(change, 0), deficit + np.maximum(-change, 0)
    return (s <= 1) & (d <= 1), s, d


def search(vectors: np.ndarray, stored: np.ndarray, seekers: np.ndarray, surplus: np.ndarray, deficit: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs (seeker, stored word) that a depth-first search of the trie over ``stored`` reaches, in bounded portions.

    All seekers descend together: a node is entered once, by those whose budget allows it.
    """
    groups = vectors.shape[1]
    order = stored[np.lexsort(vectors[stored][:, ::-1].T)]
    sorted_vectors = vectors[order]
    stack = [(depth, 0, len(order), seekers, surplus.astype(np.int16), deficit.astype(np.int16))]
    while stack:
        level, low, high, who, s, d = stack.pop()
        if level == groups or high - low <= LEAF:
            # what is left of the levels, at once
            per = max(1, (1 << 18) // (high - low))
            for i in range(0, len(who), per):
                change = vectors[who[i : i + per]][:, None, level:].astype(np.int16) - sorted_vectors[None, low:high, level:]
                fits = (s[i : i + per, None] + np.maximum(change, 0).sum(2) <= 1) & (d[i : i + per, None] + np.maximum(-change, 0).sum(2) <= 1)
                x, y = np.nonzero(fits)
                if len(x):
                    yield who[i : i + per][x], order[low + y]
            continue
        column = sorted_vectors[low:high, level]
        edges = low + np.concatenate([[0], np.flatnonzero(np.diff(column)) + 1, [high - low]])
        own = vectors[who, level]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            enters, s2, d2 = _allowed(own, int(sorted_vectors[a, level]), s, d)
            if enters.any():
                stack.append((level + 1, a, b, who[enters], s2[enters], d2[enters]))


def _routes(words: DataFrame, letters: Letters, depth: int) -> DataFrame:
    """A row for each word in its own subtrie, and one for each subtrie behind it that its budget reaches; key: the counts that lead there."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                top = letters.vectors(*codes_of(part.column(0)))[:, :depth].astype(np.int16)
                rows = np.arange(len(top))
                ways = [(rows, top, np.zeros(len(top), np.int16), np.zeros(len(top), np.int16), False)]
                for up in [None, *range(depth)]:  # the count of the other word is one more in ``up``, one less in ``down``
                    for down in [None, *range(depth)]:
                        if up == down:
                            continue
                        # behind the own subtrie: the first count that differs is larger
                        if up is None or (down is not None and down < up):
                            continue
                        other = top.copy()
                        other[:, up] += 1
                        fits = other[:, up] <= 255
                        if down is not None:
                            other[:, down] -= 1
                            fits &= other[:, down] >= 0
                        go = rows[fits]
                        ways.append((go, other[go], np.full(len(go), int(down is not None), np.int16), np.ones(len(go), np.int16), True))
                for who, key, s, d, visitor in ways:
                    found = pa.Array.from_buffers(pa.binary(depth), len(who), [None, pa.py_buffer(key.astype(np.uint8).tobytes())]) if depth else pa.array([b""] * len(who), pa.binary())
                    yield pa.RecordBatch.from_arrays([found.cast(pa.binary()), part.column(0).take(pa.array(who)), part.column(1).take(pa.array(who)), pa.array(np.full(len(who), visitor)), pa.array(s), pa.array(d)], ["key", "word", "n", "visitor", "surplus", "deficit"])

    return map_arrow(words.select("word", "n"), walk, "key binary, word string, n long, visitor boolean, surplus short, deficit short")


def _depth(words: DataFrame, letters: Letters) -> int:
    """The first depth at which no subtrie holds more than ``SUBTRIE`` words; one row a depth is looked at."""

    def keys(depth: int):
        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                top = letters.vectors(*codes_of(batch.column(0)))[:, :depth]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in top], pa.binary())], ["key"])

        return walk

    depth = 0
    most = words.count()
    while most > SUBTRIE and depth < letters.groups:
        depth += 1
        most = map_arrow(words.select("word"), keys(depth), "key binary").groupBy("key").count().agg(F.max("count").alias("n")).first().n or 0
    return depth


def near_counts(words: DataFrame) -> DataFrame:
    """word, n_near, best (n, word): for each word that has near words. ``words`` has distinct word and n, stored."""
    letters = Letters(weights(words))
    depth = _depth(words, letters)

    def kernel(rows: pa.Table) -> pa.RecordBatch | None:
        said = rows.column("word").combine_chunks()
        visitor = rows.column("visitor").to_numpy()
        stored = np.flatnonzero(~visitor)
        if not len(stored):
            return None
        n, own = rows.column("n").to_numpy(), rows.column("own").to_numpy()
        codes, offsets = codes_of(said)
        spread = rows.column("cell_a")[0].as_py() != rows.column("cell_b")[0].as_py()
        order = np.argsort(np.array([bytes(codes[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], object), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        vectors = letters.vectors(codes, offsets)
        count, best = np.zeros(len(said), np.int64), np.full(len(said), -1)

        def told(x: np.ndarray, y: np.ndarray) -> None:
            """Word y[i] is near x[i]."""
            np.add.at(count, x, 1)
            by = np.lexsort((rank[y], -n[y], x))
            x, y = x[by], y[by]
            first = np.concatenate([[True], x[1:] != x[:-1]])
            x, y = x[first], y[first]
            old = best[x]
            better = (old < 0) | (n[y] > n[old]) | ((n[y] == n[old]) & (rank[y] < rank[old]))
            best[x[better]] = y[better]

        for x, y in search(vectors, stored, np.arange(len(said)), rows.column("surplus").to_numpy(), rows.column("deficit").to_numpy(), depth):
            meet = x != y
            if spread:
                meet &= own[x] != own[y]
            x, y = x[meet], y[meet]
            close = near(codes, offsets, x, y)
            x, y = x[close], y[close]
            if len(x):
                told(x, y)
                come = visitor[x]  # words of the subtrie search themselves; a visitor's finds count for both
                if come.any():
                    told(y[come], x[come])
        some = np.flatnonzero(count)
        if not len(some):
            return None
        return pa.RecordBatch.from_arrays([said.take(pa.array(some)), pa.array(count[some]), pa.array(n[best[some]]), said.take(pa.array(best[some]))], ["word", "n_near", "form_n", "form"])

    cells = in_cells(checkpointed(_routes(words, letters, depth)), ["key"], "word", SUBTRIE * 16)
    found = grouped(cells, ["key", "cell_a", "cell_b"], [], kernel, "word string, n_near long, form_n long, form string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("m"), "form")).alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root for every word that has a form (``word``, ``form``): pointers are doubled until all lead to a word without one."""
    live = checkpointed(forms.select("word", F.col("form").alias("to")))
    while True:
        ahead = live.select(F.col("word").alias("to"), F.col("to").alias("_next"))
        doubled = checkpointed(live.join(ahead, "to", "left").select("word", F.coalesce("_next", "to").alias("to"), F.col("_next").isNotNull().alias("moved")))
        discard(live)
        live = doubled.select("word", "to")
        if doubled.where("moved").isEmpty():
            return live.select("word", F.col("to").alias("root"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_n: int = 3, damage: int | None = None) -> DataFrame:
    """word, n, n_near, form, form_n, root for every word of at least ``least_length`` code points and ``least_n`` occurrences."""
    counted = occurrences(docs, id_col, text_col, damage)
    words = checkpointed(counted.where((F.length("word") >= least_length) & (F.col("n") >= least_n)))
    close = checkpointed(near_counts(words))
    joined = words.join(close, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), (-F.col("best.m")).alias("form_n"), F.col("best.form").alias("form"))
    is_form = F.col("form_n") >= 2 * F.col("n")
    known = checkpointed(joined.withColumns({"form": F.when(is_form, F.col("form")), "form_n": F.when(is_form, F.col("form_n"))}))
    roots = _roots(known.where("form IS NOT NULL"))
    return known.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
