"""Packing: documents become token sequences of a fixed length by vector bin packing.

Each text is tokenised whole and gets an end id. Pieces of a full sequence's length are sequences of their own;
what remains is placed under three limits at once (tokens, segments, loss-bearing tokens) by the dot-product
heuristic: the open sequence takes the waiting piece whose demand has the largest dot product with what is left,
both as shares of the limits, among those that fit. When none fits and room is left, the largest waiting piece is
cut to fill it, so only a task's last sequence is padded.

A task packs the rows it reads, in order, with at most ``window`` pieces waiting, so nothing is shuffled and
memory is bounded; a lost task is packed again by itself. Sequence ids carry the task's partition in their high
bits. Null texts count as empty and give their end id alone. Rows that repeat are packed each. Other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import map_arrow, steps, text_buffer

SEQUENCE_BITS = 38
#: Characters for which the two tokenizer libraries are known to cut alike; others take the slower one.
_PLAIN = re.compile(r"[\x00-ɏ‐-‧]*")
#: A run of white space that the faster library may not survive: its look-ahead goes back one step a character.
_GAP = re.compile(r"\s{1000}")


def token_encoder(path: str) -> Callable[[list[str]], list[np.ndarray]]:
    """Ids (uint32) of texts by the byte-level BPE vocabulary file at ``path``, without special tokens added.

    The file is read by ``tokenizers``, whose ids count. The same vocabulary and merges are handed to
    ``tiktoken``, several times faster; it serves texts of Latin letters without special strings and without white
    space runs of a thousand characters, and gives the same ids there. All other texts go to ``tokenizers``, as do
    all texts if the file doesn't cut words by the byte-level rule that ``pattern`` states, or normalises texts.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    vocabulary, special = whole["model"]["vocab"], [t["content"] for t in whole["added_tokens"]]
    # the byte-level alphabet: printable bytes stand for themselves, others for characters from 256 on
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if token not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    cut = whole["pre_tokenizer"] or {}
    alike = whole["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    slow = functools.cache(lambda: Tokenizer.from_file(path))

    def encode(texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            if alike and _PLAIN.fullmatch(text) and not any(s in text for s in special) and not _GAP.search(text):
                out.append(np.array(fast.encode_ordinary(text), np.uint32))
            else:
                out.append(np.array(slow().encode(text, add_special_tokens=False).ids, np.uint32))
        return out

    return encode


class Packer:
    """Pieces in, placed pieces out. A piece: (document, start, length, loss-bearing tokens)."""

    def __init__(self, tokens: int, segments: int, loss: int, window: int):
        self.limits = np.array([tokens, segments, loss], np.float64)
        self.window = window
        self.waiting: list[tuple] = []
        self.demand = np.zeros((0, 3))
        self.sequence = 0

    def add(self, pieces: list[tuple]) -> Iterator[tuple]:
        """pieces: (key, start, length, loss_start); yields (key, start, length, loss_start, sequence, offset)."""
        whole = int(self.limits[0])
        for key, start, length, loss_start in pieces:
            while length >= whole and min(whole, max(0, start + whole - max(start, loss_start))) <= self.limits[2]:
                yield key, start, whole, loss_start, self._next(), 0
                start, length = start + whole, length - whole
            while length:
                # a piece too rich in loss-bearing tokens for any sequence is cut down to one that fits
                part = min(length, whole)
                free = max(0, loss_start - start)
                part = min(part, free + int(self.limits[2]))
                self._wait((key, start, part, loss_start))
                start, length = start + part, length - part
        while len(self.waiting) > self.window:
            yield from self._fill()

    def finish(self) -> Iterator[tuple]:
        while self.waiting:
            yield from self._fill()

    def _next(self) -> int:
        self.sequence += 1
        return self.sequence - 1

    @staticmethod
    def _needs(piece: tuple) -> list[float]:
        _, start, length, loss_start = piece
        return [length, 1, max(0, start + length - max(start, loss_start))]

    def _wait(self, *pieces: tuple) -> None:
        self.waiting.extend(pieces)

    def _fill(self) -> Iterator[tuple]:
        """Closes one sequence, opened with the oldest piece so that none waits for ever."""
        needs = np.array([self._needs(p) for p in self.waiting], np.float64)
        left, offset, number = self.limits.copy(), 0, self._next()
        gone = np.zeros(len(self.waiting), bool)
        pick = 0
        rest = None
        while pick is not None:
            piece = self.waiting[pick]
            gone[pick] = True
            yield *piece, number, offset
            left -= needs[pick]
            offset += piece[2]
            fits = ~gone & (needs <= left).all(1)
            if fits.any():
                alike = np.where(fits, (needs / self.limits) @ (left / self.limits), -1.0)
                pick = int(alike.argmax())
                continue
            pick = None
            # nothing fits: cut the largest piece to fill what is left, where the other limits allow it
            open_ = np.flatnonzero(~gone & (needs[:, 0] > left[0]))
            if left[0] >= 1 and left[1] >= 1 and len(open_):
                source = int(open_[needs[open_, 0].argmax()])
                key, start, length, loss_start = self.waiting[source]
                part = min(int(left[0]), max(0, loss_start - start) + int(left[2]))
                if part >= 1:
                    gone[source] = True
                    yield key, start, part, loss_start, number, offset
                    rest = (key, start + part, length - part, loss_start)
        self.waiting = [p for p, g in zip(self.waiting, gone, strict=True) if not g]
        if rest:
            self.waiting.append(rest)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None, tokens: int = 2048, segments: int = 64, loss_tokens: int | None = None, end_id: int = 1, window: int = 256, keep_ids: bool = True) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, loss_tokens, sequence_id, offset, and ids (array) with ``keep_ids``.

    ids_crc32 is the CRC-32 of the piece's ids as little-endian unsigned 32-bit numbers.

    With ``prompt_col`` the prompt's tokens come first and bear no loss, as for instruction data; otherwise every
    token bears loss. ``tokenizer`` is the path of a byte-level BPE vocabulary file, readable by the executors.
    """
    most_loss = tokens if loss_tokens is None else loss_tokens

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_encoder(tokenizer)
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << SEQUENCE_BITS
        packer = Packer(tokens, segments, most_loss, window)
        held: dict[int, list] = {}
        number = 0

        def rows(placed: Iterator[tuple]) -> pa.RecordBatch | None:
            out: list[list] = [[] for _ in NAMES]
            lists: list[np.ndarray] = []
            for key, start, length, loss_start, sequence, offset in placed:
                doc, ids, left = held[key]
                own = ids[start : start + length]
                row = (doc, start, length, zlib.crc32(own.astype("<u4").tobytes()), len(ids), max(0, start + length - max(start, loss_start)), base + sequence, offset)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
                if keep_ids:
                    lists.append(own)
                held[key][2] = left - length
                if not held[key][2]:
                    del held[key]
            if not out[0]:
                return None
            columns = [pa.array(x, pa.int64()) for x in out]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)), pa.array(np.concatenate(lists).astype(np.int32))))
            return pa.RecordBatch.from_arrays(columns, [*NAMES, "ids"][: len(columns)])

        for batch in batches:
            texts = batch.column("text")
            _, offsets = text_buffer(texts)
            for a, b in steps(offsets, 1 << 20):
                ids = encode([x or "" for x in texts.slice(a, b - a).to_pylist()])
                prompts = encode([x or "" for x in batch.column("prompt").slice(a, b - a).to_pylist()]) if prompt_col else [np.zeros(0, np.uint32)] * (b - a)
                pieces = []
                for doc, own, prompt in zip(batch.column("id").slice(a, b - a).to_pylist(), ids, prompts, strict=True):
                    whole = np.concatenate([prompt, own, [np.uint32(end_id)]])
                    held[number] = [doc, whole, len(whole)]
                    pieces.append((number, 0, len(whole), len(prompt)))
                    number += 1
                found = rows(packer.add(pieces))
                if found is not None:
                    yield found
        found = rows(packer.finish())
        if found is not None:
            yield found

    columns = [F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *([F.col(prompt_col).alias("prompt")] if prompt_col else [])]
    return map_arrow(docs.select(*columns), walk, ", ".join(f"{n} long" for n in NAMES) + (", ids array<int>" if keep_ids else ""))


NAMES = ["id", "start", "length", "ids_crc32", "doc_tokens", "loss_tokens", "sequence_id", "offset"]


def piece_digests(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """``pack`` without the ids themselves, for checks of where each piece went."""
    return pack(docs, tokenizer, keep_ids=False, **options).select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
