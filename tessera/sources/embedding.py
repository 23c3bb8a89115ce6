"""Embedding texts through a provider, in batches inside tasks."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from .shared import map_arrow


class ProviderError(RuntimeError):
    """A provider's answer with a status; from 500 on it is worth another try."""

    def __init__(self, status: int, message: str = ""):
        super().__init__(f"status {status}: {message}")
        self.status = status

    def __reduce__(self) -> tuple:
        return type(self), (self.status, str(self))


class Provider(Protocol):
    """Anything that gives one vector per text; it must pickle, as tasks hold copies."""

    width: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingProvider:
    """Signed feature hashing of words to unit vectors; needs no model and no network."""

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.width))
        for i, text in enumerate(texts):
            for word in text.lower().split():
                code = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[i, code % self.width] += 1 if code >> 63 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(size, size, 1)).tolist()


def with_retries(provider: Provider, texts: list[str], tries: int = 5, base_seconds: float = 0.5) -> list[list[float]]:
    """Tries again after time-outs, lost connections and statuses from 500 on, waiting twice as long each time; checks count and width."""
    for attempt in range(tries):
        try:
            found = provider.embed(texts)
            break
        except (TimeoutError, ConnectionError, ProviderError) as failure:
            if attempt == tries - 1 or (isinstance(failure, ProviderError) and failure.status < 500):
                raise
            time.sleep(base_seconds * 2**attempt)
    if len(found) != len(texts) or any(len(v) != provider.width for v in found):
        raise ValueError("a provider gives one vector of its width per text")
    return found


def embed(texts: DataFrame, provider: Provider, id_col: str = "id", text_col: str = "text", batch: int = 16) -> DataFrame:
    """id, vector for each row; one provider per task, ``batch`` texts per call."""
    kind = texts.schema[id_col].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            # only a call's texts become Python strings
            for a in range(0, rows.num_rows, batch):
                part = rows.slice(a, batch)
                found = with_retries(provider, [t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.float64()))], ["id", "vector"])

    return map_arrow(texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), walk, f"id {kind}, vector array<double>")


def unseen(texts: DataFrame, known: DataFrame, text_col: str = "text") -> DataFrame:
    """content_hash, text of each content of ``texts`` that has no row in ``known`` (content_hash): equal texts count once."""
    hashed = texts.select(T.content_hash(F.col(text_col)).alias("content_hash"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    fresh = hashed.join(known.select("content_hash").distinct(), "content_hash", "left_anti")
    return fresh.groupBy("content_hash").agg(F.first("text").alias("text"))


def embed_new(texts: DataFrame, store: str, provider: Provider, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, vector for each row with a text; only contents that ``store`` (a folder of vectors by content_hash) lacks reach the provider.

    What is embedded is written to the store under a folder of its own, so a run costs its new contents, and a run that failed
    half-way leaves what it had finished writing.
    """
    spark = texts.sparkSession
    schema = "content_hash string, vector array<double>"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    read = lambda: spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(store)
    known = read() if there else spark.createDataFrame([], schema)
    made = embed(unseen(texts, known, text_col), provider, "content_hash", "text").select(F.col("id").alias("content_hash"), "vector")
    made.write.parquet(f"{store}/{uuid.uuid4().hex}")
    # two runs at once may both have embedded a content: one row of each is taken
    vectors = read().groupBy("content_hash").agg(F.first("vector").alias("vector"))
    return texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), T.content_hash(F.col(text_col)).alias("content_hash")).join(vectors, "content_hash").select("id", "vector")
