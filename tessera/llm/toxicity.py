"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text.

*Training.* Both dictionaries come from a bounded sample of labelled rows (those with the smallest hashes of doc_id,
``max_rows`` at most, half of each class; a text that doesn't fit into what is left of ``max_bytes`` is passed over).
The ordinary dictionary is trained on whole texts. Toxic texts are mostly made of ordinary words, so a dictionary of
whole texts would hold little else: theirs is trained on the passages whose grams of ``GRAMS`` bytes stand in far
more toxic than ordinary texts (on whole texts if there are none).

*Windows.* A window is one word of the lower-cased text with a blank on either side; windows cover the whole text. Each
is compressed with both dictionaries, and the difference of the lengths says which text it resembles, and by how many
bytes. Literals are stored raw (the fast strategy with a target length), so that a window which neither
dictionary knows has the same length in both. Every window is compressed behind ``OPENING``, a string that both
dictionaries hold: else zstandard would store short windows raw and a length would tell nothing.

*Thresholds.* A text's features are how many windows reach each of ``THRESHOLDS`` bytes either way, and its length. A
logistic function turns them into a probability; it is calibrated on the third of the sample that the dictionaries were
not trained on, with the classes weighed by their share among the labelled rows.

Everything learnt is a few thousand bytes and travels with the tasks; scoring shuffles nothing. Null and empty
texts have no windows and get the score of a text without any sign. Without any training row of one class the score is the
constant share of label 1. Repeated rows give repeated results, ids may be null; other columns pass by. An empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import IS_WORD, map_arrow, steps, text_buffer

#: Lengths of grams in bytes (8 at most).
GRAMS = (5, 8)
#: A gram tells a class if it stands there at least ``TIMES`` as often as in the other, and chance would do that with a probability below exp(-EVIDENCE).
TIMES, EVIDENCE = 5, 15
#: A passage is learnt if so many texts hold it; so many are put into a sample of the trainer.
SEVERAL, TOGETHER = 3, 8
#: Bytes of a dictionary.
DICTIONARY = 8192
#: Differences in bytes at which windows are counted, for toxic and for ordinary.
THRESHOLDS = (2, 3, 4, 5, 6, 7)
#: What stands before each window and in both dictionaries; no word holds its characters.
OPENING = b"[%~#{0}@=<^>]"
#: What stands behind each window: the fast strategy looks for no match in a block's last bytes.
CLOSING = b";!&$*+,?:/-_"
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Bytes of one text that are looked at together.
PART = 4 << 20
#: Distinct words whose differences a task keeps, and the longest of them in bytes.
KEPT, KEPT_BYTES = 1 << 18, 64


def _spaced(text: bytes) -> bytes:
    """A text's words with a blank on either side of each."""
    return b" " + b" ".join(_WORD.findall(text)) + b" "


def _grams(text: bytes, length: int) -> np.ndarray:
    data = np.frombuffer(text, np.uint8).astype(np.uint64)
    n = max(0, len(data) - length + 1)
    keys = np.zeros(n, np.uint64)
    for j in range(length):
        keys = keys * np.uint64(256) + data[j : j + n]
    return keys


def _held(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Where each key stands in a sorted array, and -1 for the others."""
    if not len(among):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return np.where(among[at] == keys, at, -1)


def _counts(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams and in how many texts each stands."""
    return np.unique(np.concatenate([np.unique(_grams(x, length)) for x in texts]), return_counts=True)


def _telling(grams: np.ndarray, n: np.ndarray, total: int, others: np.ndarray, m: np.ndarray, other_total: int) -> np.ndarray:
    """The grams that stand in far more texts of their class than of the other; Chernoff's bound of the binomial tail measures by chance."""
    at = _held(grams, others)
    m = np.where(at >= 0, m[at], 0) if len(m) else np.zeros(len(grams))
    expected, share = total / (total + other_total), n / (n + m)
    with np.errstate(divide="ignore", invalid="ignore"):
        evidence = n * np.log(share / expected) + np.where(m > 0, m * np.log((1 - share) / (1 - expected)), 0)
    return grams[(share > expected) & (evidence >= EVIDENCE) & (n * other_total >= TIMES * m * total)]


def _passages(text: bytes, telling: dict[int, np.ndarray]) -> set[bytes]:
    """The stretches of a text that telling grams cover."""
    change = np.zeros(len(text) + 1, np.int64)
    for length, grams in telling.items():
        hits = np.flatnonzero(_held(_grams(text, length), grams) >= 0)
        change[hits] += 1
        change[hits + length] -= 1
    edges = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(change)[:-1] > 0, [False]]).astype(np.int8)))
    return {text[a:b] for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)}


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """The dictionaries of toxic and of ordinary texts; one that finds too little to be trained on holds the opening alone."""
    toxic, ordinary = [_spaced(x) for x in toxic], [_spaced(x) for x in ordinary]
    telling = {n: _telling(*_counts(toxic, n), len(toxic), *_counts(ordinary, n), len(ordinary)) for n in GRAMS}
    found = Counter(x for text in toxic for x in _passages(text, telling))
    # each passage that several texts hold counts alike: else a few words would fill the dictionary with copies
    several = sorted(x for x, n in found.items() if n >= SEVERAL)
    parts = [several[i : i + TOGETHER] for i in range(0, len(several), TOGETHER)]
    passages = [b" ".join(part[r:] + part[:r]) for r in range(TOGETHER) for part in parts]

    def trained(samples: list[bytes], size: int) -> bytes:
        try:
            made = zstandard.train_dictionary(max(512, min(DICTIONARY, size)), [OPENING + x + OPENING for x in samples], level=3).as_bytes()
        except zstandard.ZstdError:  # too few or too short samples
            return OPENING * 2
        return made if OPENING in made else OPENING * 2

    own = trained(passages, sum(map(len, several)) + 256) if several else trained(toxic, DICTIONARY)
    return own, trained(ordinary, DICTIONARY)


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    settings = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=14, chain_log=14, search_log=1, min_match=6, target_length=1, strategy=zstandard.STRATEGY_FAST, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    return zstandard.ZstdCompressor(compression_params=settings, dict_data=zstandard.ZstdCompressionDict(content))


class Windows:
    """Differences of compressed lengths of words, kept for words that come again."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = _compressor(toxic), _compressor(ordinary)
        #: The difference that the dictionaries' own tables make.
        self.base = 0
        self.base = self.difference(b"")
        self.known: dict[bytes, int] = {}

    def difference(self, word: bytes) -> int:
        """By how many bytes the toxic dictionary says the window shorter than the ordinary one."""
        window = OPENING + b" " + word + b" " + CLOSING
        return len(self.ordinary.compress(window)) - len(self.toxic.compress(window)) - self.base

    def differences(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > KEPT:
            self.known.clear()
        found = np.empty(len(words), np.int64)
        for i, word in enumerate(words):
            value = self.known.get(word)
            if value is None:
                value = self.difference(word)
                if len(word) <= KEPT_BYTES:
                    self.known[word] = value
            found[i] = value
        return found

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each lower-cased text: windows, windows at each threshold either way."""
        inside = np.concatenate([[False], IS_WORD[data], [False]])
        # a text's first byte starts a word of its own
        step = np.diff(inside.astype(np.int8))
        edges = offsets[1:-1]
        edges = np.unique(edges[(edges > 0) & (edges < len(data))])
        edges = edges[inside[edges] & inside[edges + 1]]
        starts, ends = np.sort(np.concatenate([np.flatnonzero(step == 1), edges])), np.sort(np.concatenate([np.flatnonzero(step == -1), edges]))
        raw = data.tobytes()
        numbers: dict[bytes, int] = {}
        which = np.fromiter((numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.int64, len(starts))
        found = self.differences(list(numbers))[which] if len(which) else np.zeros(0, np.int64)
        text = np.searchsorted(offsets, starts, "right") - 1
        n = len(offsets) - 1
        columns = [np.ones(len(found), bool), *(found >= t for t in THRESHOLDS), *(found <= -t for t in THRESHOLDS)]
        return np.stack([np.bincount(text[c], minlength=n) for c in columns], 1).astype(np.float64)


def _features(counts: np.ndarray) -> np.ndarray:
    """Log counts, and log counts for each thousand windows, so that long texts may hold more chance hits."""
    rates = np.log1p(1000 * counts[:, 1:] / np.maximum(counts[:, :1], 50))
    return np.concatenate([np.log1p(counts), rates], 1)


@dataclass
class Model:
    """The two dictionaries and the calibrated logistic function."""

    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def probability(self, counts: np.ndarray) -> np.ndarray:
        z = (_features(counts) - self.mean) / self.scale @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _parts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A text beyond ``PART`` bytes in parts that end behind a separator (a longer word is cut); others as they are."""
    if len(offsets) > 2 or len(data) <= PART:
        yield data, offsets
        return
    at = 0
    while at < len(data):
        gaps = np.flatnonzero(~IS_WORD[data[at : at + PART]])
        end = len(data) if len(data) - at <= PART else at + (int(gaps[-1]) + 1 if len(gaps) else PART)
        yield data[at:end], np.array([0, end - at])
        at = end


def _count_texts(windows: Windows, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return sum(windows.counts(d, o) for d, o in _parts(data, offsets))


def _buffer(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)


def train(texts: list[bytes], labels: np.ndarray, share: float) -> Model:
    """From lower-cased texts with both labels; ``share`` is the share of label 1 that the scores are calibrated to."""
    unseen = np.zeros(len(texts), bool)
    for label in (0, 1):
        unseen[np.flatnonzero(labels == label)[1::3]] = True
    pick = lambda label: [x for x, y, u in zip(texts, labels, unseen, strict=True) if y == label and not u]
    learnt = dictionaries(pick(1), pick(0))
    windows = Windows(*learnt)
    counts = np.concatenate([_count_texts(windows, *_buffer([texts[i]])) for i in np.flatnonzero(unseen)])
    labels = labels[unseen]
    x = _features(counts)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    x = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], 1)
    positive = labels.mean()
    weigh = np.where(labels == 1, share / positive, (1 - share) / (1 - positive))
    ridge = np.ones(x.shape[1])
    ridge[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(60):  # Newton steps, damped
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (weigh * np.maximum(p * (1 - p), 1e-4))) @ x + np.diag(ridge), x.T @ (weigh * (p - labels)) + ridge * w)
        w -= step * min(1.0, 2.0 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return Model(*learnt, mean, scale, w[:-1], float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 4000, max_bytes: int = 64 << 20) -> Model | float:
    """The model for ``docs`` with ``labels`` (0 and 1; others are left out), or a constant if one class is missing.

    Rows that share an id count once, with the smallest of their labels and texts. Driver memory is bounded by ``max_rows``
    and ``max_bytes``; sizes are known before a text is fetched.
    """
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marks = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    known = marks.join(texts.groupBy("id").agg(F.max(F.octet_length("text")).alias("size")), "id")
    of_class = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(of_class) < 2:
        return float(next(iter(of_class), 0.5))
    share = of_class[1] / (of_class[0] + of_class[1])
    picked: dict[int, int] = {}
    for label in (0, 1):
        room = max_bytes // 2
        # at most max_rows / 2 rows of three numbers; a class keeps one row at least, its shortest, whatever its size
        rows = known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(max_rows // 2).collect()
        for r in rows:
            if r.size <= room:
                picked[r.id] = label
                room -= r.size
        if label not in picked.values():
            picked[min(rows, key=lambda r: (r.size, r.id)).id] = label
    wanted = docs.sparkSession.createDataFrame([(i,) for i in picked], texts.select("id").schema)
    # a broadcast of at most max_rows ids
    said = {r.id: r.text.encode() for r in texts.join(F.broadcast(wanted), "id").groupBy("id").agg(F.lower(F.min("text")).alias("text")).collect()}
    return train([said[i] for i in picked], np.array(list(picked.values()), np.int64), share)


def score(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, n_windows, n_toxic (windows that the toxic dictionary says at least 4 bytes shorter) for every row of ``docs``."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = None if isinstance(model, float) else Windows(model.toxic, model.ordinary)
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b in steps(offsets, 1 << 20):
                part = offsets[a : b + 1]
                if windows is None:
                    found, counts = np.full(b - a, model), np.zeros((b - a, 6))
                else:
                    counts = _count_texts(windows, data[part[0] : part[-1]], part - part[0])
                    found = model.probability(counts)
                n = counts[:, [0, 1 + THRESHOLDS.index(4)]].astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found), pa.array(n[:, 0]), pa.array(n[:, 1])], ["id", "score", "n_windows", "n_toxic"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.lower(F.col(text_col)).alias("text")), walk, "id long, score double, n_windows long, n_toxic long")
