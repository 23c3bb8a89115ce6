"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded; learned filters of 8 bytes run over them at every fourth byte; their rectified
outputs are max-pooled over overlapping chunks of ``POOL`` positions (half a chunk apart) that together cover the
whole document; each chunk gives hidden activations, their mean and their largest values over all chunks give one
probability. Empty and null texts have one chunk of padding and so a score as well.

The network is fitted on the driver by Adam on a bounded sample of labelled rows: those with the smallest hashes of
doc_id, ``max_rows`` at most, half of each class, whole texts; one that doesn't fit into what is left of its class's half
of ``max_bytes`` is passed over, and a class keeps its shortest one at least. It is a few thousand numbers, so it travels with the tasks. Scoring reads every text whole, in steps of bounded memory.
Without any training row of one class the score is the constant share of label 1. Repeated rows give repeated
results; other columns pass by. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_arrow, steps, text_buffer

STRIDE, POOL, EMBED, FILTERS, HIDDEN = 4, 64, 8, 24, 16
PAD = 256
#: Chunks that training works on at once, so that memory doesn't follow a text's length.
BLOCK = 2048


class Network:
    """Embedding, one convolution, chunk-wise max-pooling, one hidden layer, mean and max over chunks, one output."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.embed = r.normal(0, 0.5, (257, EMBED)).astype(np.float32)
        self.filters = r.normal(0, 1 / np.sqrt(2 * STRIDE * EMBED), (2 * STRIDE * EMBED, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.inner = r.normal(0, 1 / np.sqrt(FILTERS), (FILTERS, HIDDEN)).astype(np.float32)
        self.inner_bias = np.zeros(HIDDEN, np.float32)
        self.outer = r.normal(0, 0.1, 2 * HIDDEN).astype(np.float32)
        self.outer_bias = np.zeros(1, np.float32)

    NAMES = ("embed", "filters", "bias", "inner", "inner_bias", "outer", "outer_bias")

    def chunks(self, data: np.ndarray) -> np.ndarray:
        """Codes of one text as rows of POOL + 1 pieces of STRIDE bytes; the last is the next chunk's first half's edge."""
        half = POOL // 2
        pieces = max(POOL, -(-len(data) // STRIDE))
        rows = 1 + max(0, -(-(pieces - POOL) // half))
        padded = np.full((((rows - 1) * half + POOL) + 1) * STRIDE, PAD, np.int16)
        padded[: len(data)] = data
        return np.lib.stride_tricks.as_strided(padded, (rows, POOL + 1, STRIDE), (half * STRIDE * 2, STRIDE * 2, 2))

    def pooled(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Max-pooled filter outputs of each chunk, and where they were."""
        width = STRIDE * EMBED
        weights = np.concatenate([self.filters[:width], self.filters[width:]], 1)
        tops, places = np.empty((len(codes), FILTERS), self.filters.dtype), np.empty((len(codes), FILTERS), np.int64)
        for i in range(0, len(codes), BLOCK):
            part = codes[i : i + BLOCK]
            both = (self.embed[part.reshape(-1)].reshape(-1, width) @ weights).reshape(len(part), POOL + 1, 2 * FILTERS)
            out = both[:, :POOL, :FILTERS] + both[:, 1:, FILTERS:]
            places[i : i + BLOCK] = out.argmax(1)
            tops[i : i + BLOCK] = np.take_along_axis(out, places[i : i + BLOCK, None], 1)[:, 0] + self.bias
        return np.maximum(tops, 0), places

    def hidden(self, pooled: np.ndarray) -> np.ndarray:
        return np.tanh(pooled @ self.inner + self.inner_bias)

    def probability(self, hidden_sum: np.ndarray, hidden_max: np.ndarray, chunks: np.ndarray) -> np.ndarray:
        z = np.concatenate([hidden_sum / chunks[:, None], hidden_max], 1) @ self.outer + self.outer_bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30).astype(np.float64)))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A probability for each text of a buffer. Half-overlapping chunks share their halves' maxima, so every byte is seen once."""
        half = POOL // 2
        sums, peaks, counts = [], [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            pieces = max(POOL, -(-(b - a) // STRIDE))
            rows = 1 + max(0, -(-(pieces - POOL) // half))
            counts.append(rows)
        counts = np.array(counts, np.int64)
        # each text as (rows + 1) halves, and one more piece that the last filter position reaches into
        halves = counts + 1
        places = np.concatenate([[0], np.cumsum(halves)])
        size = half * STRIDE
        padded = np.full(int(places[-1]) * size + STRIDE, PAD, np.int16)
        for place, a, b in zip((places[:-1] * size).tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            padded[place : place + b - a] = data[a:b]
        tops = np.empty((int(places[-1]), FILTERS), np.float32)
        width = STRIDE * EMBED
        weights = np.concatenate([self.filters[:width], self.filters[width:]], 1)
        block = 4096
        last = np.zeros(len(tops), bool)
        last[places[1:] - 1] = True
        pad_piece = np.tile(self.embed[PAD], STRIDE) @ self.filters[width:]
        for i in range(0, len(tops), block):
            j = min(len(tops), i + block)
            codes = padded[i * size : j * size + STRIDE]
            both = self.embed[codes].reshape(-1, width) @ weights
            out = (both[:-1, :FILTERS] + both[1:, FILTERS:]).reshape(j - i, half, FILTERS)
            # a text's last position looks into padding, not into the next text
            ends = np.flatnonzero(last[i:j])
            out[ends, -1] = both[:-1, :FILTERS].reshape(j - i, half, FILTERS)[ends, -1] + pad_piece
            tops[i:j] = out.max(1)
        chunk = np.flatnonzero(~last)
        hidden = self.hidden(np.maximum(np.maximum(tops[chunk], tops[chunk + 1]) + self.bias, 0))
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        return self.probability(np.add.reduceat(hidden, starts), np.maximum.reduceat(hidden, starts), counts.astype(np.float32))

    def gradients(self, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        parts = [self.chunks(x) for x in texts]
        counts = np.array([len(p) for p in parts])
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        codes = np.concatenate(parts)
        pooled, where = self.pooled(codes)
        hidden = self.hidden(pooled)
        mean = np.add.reduceat(hidden, starts) / counts[:, None]
        peak = np.maximum.reduceat(hidden, starts)
        p = self.probability(np.add.reduceat(hidden, starts), peak, counts.astype(np.float32))
        d = ((p - labels) * weights / weights.sum()).astype(np.float32)
        grads = {"outer": np.concatenate([mean, peak], 1).T @ d, "outer_bias": d.sum(keepdims=True)}
        row = np.repeat(np.arange(len(texts)), counts)
        d_hidden = np.outer(d / counts, self.outer[:HIDDEN])[row]
        first_peak = np.zeros_like(hidden)
        for t, (s, c) in enumerate(zip(starts, counts, strict=True)):
            first_peak[s + hidden[s : s + c].argmax(0), np.arange(HIDDEN)] = d[t] * self.outer[HIDDEN:]
        d_hidden = (d_hidden + first_peak) * (1 - hidden**2)
        grads["inner"], grads["inner_bias"] = pooled.T @ d_hidden, d_hidden.sum(0)
        d_pool = (d_hidden @ self.inner.T) * (pooled > 0)
        grads["bias"] = d_pool.sum(0)
        grads["filters"] = np.zeros_like(self.filters)
        # for each byte, place in the window and filter: the sum of what comes back to it
        back = np.zeros(257 * 2 * STRIDE * FILTERS)
        cell = np.arange(FILTERS)[:, None] * (2 * STRIDE) + np.arange(2 * STRIDE)
        for i in range(0, len(codes), BLOCK):
            part, at, own = codes[i : i + BLOCK], where[i : i + BLOCK], d_pool[i : i + BLOCK]
            rows = np.arange(len(part))[:, None]
            used = np.concatenate([part[rows, at], part[rows, at + 1]], 2)
            window = self.embed[used].reshape(len(part), FILTERS, -1)
            grads["filters"] += np.einsum("nfw,nf->wf", window, own, optimize=True)
            back += np.bincount((used.astype(np.int64) * (2 * STRIDE * FILTERS) + cell).ravel(), np.repeat(own.ravel(), 2 * STRIDE), len(back))
        by_place = self.filters.reshape(2 * STRIDE, EMBED, FILTERS).transpose(2, 0, 1).reshape(-1, EMBED)
        grads["embed"] = (back.reshape(257, -1) @ by_place).astype(self.embed.dtype)
        return grads


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 10, batch: int = 32, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam with a falling rate; classes weigh alike."""
    net, r = Network(seed), np.random.default_rng(seed)
    arrays = [np.frombuffer(t, np.uint8) for t in texts]
    share = labels.mean()
    weights = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) if 0 < share < 1 else np.ones(len(labels))
    moments = {k: (np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))) for k in net.NAMES}
    rounds, t = epochs * -(-len(arrays) // batch), 0
    for _ in range(epochs):
        order = r.permutation(len(arrays))
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            grads = net.gradients([arrays[k] for k in own], labels[own].astype(np.float64), weights[own])
            t += 1
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                step = rate * (1 - t / (rounds + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
                getattr(net, k).__isub__(step.astype(np.float32))
    return net


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 1200, max_bytes: int = 64 << 20) -> Network | float:
    """The network for ``docs`` with ``labels`` (0 and 1; others are left out), or a constant if one class is missing.

    Rows that share an id count once, with the smallest of their texts.
    """
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marks = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    known = marks.join(texts.select("id"), "id", "left_semi")
    order = [F.xxhash64("id"), "id"]
    half = lambda label: known.where(F.col("label") == label).orderBy(*order).limit(max_rows // 2)
    # at most max_rows rows of two numbers
    picked = [(r.id, r.label) for r in half(0).unionAll(half(1)).orderBy(*order).collect()]
    if not picked:
        return 0.5

    def of(ids: list) -> DataFrame:
        """The text of each id; a broadcast of at most max_rows ids."""
        wanted = docs.sparkSession.createDataFrame([(i,) for i in ids], texts.select("id").schema)
        return texts.join(F.broadcast(wanted), "id").groupBy("id").agg(F.min("text").alias("text"))

    sizes = {r.id: r.size for r in of([i for i, _ in picked]).select("id", F.octet_length("text").alias("size")).collect()}
    label_of: dict[int, int] = {}
    for label in {y for _, y in picked}:
        own, room = [i for i, y in picked if y == label], max_bytes // 2
        for i in own:
            if sizes[i] <= room:
                label_of[i] = label
                room -= sizes[i]
        if label not in label_of.values():
            label_of[min(own, key=lambda i: (sizes[i], i))] = label
    label_of = {i: y for i, y in picked if i in label_of}
    marked = np.array(list(label_of.values()), np.int64)
    if marked.min() == marked.max():
        return float(marked.mean())
    said = {r.id: r.text.encode() for r in of(list(label_of)).collect()}
    return train([said[i] for i in label_of], marked)


def score(docs: DataFrame, model: Network | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score for every row of ``docs``."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b in steps(offsets, 1 << 20):
                found = np.full(b - a, model) if isinstance(model, float) else model.score(data, offsets[a : b + 1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found)], ["id", "score"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), walk, "id long, score double")
