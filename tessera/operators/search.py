"""Exact filtered vector search, rank fusion and result guards over a table of points.

A point has id, repo, path, content_type and vector among its columns. The query vector is a literal, so scoring is
a projection without a join; top-k per type keeps k rows per task before its one small exchange.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as T


#: Up to this width a product is written out term by term, which Spark compiles (about nine times as fast as a fold).
WRITTEN_OUT = 512


def query_vector(values: Sequence[float]) -> list[float]:
    """A checked vector: not empty, finite."""
    out = [float(v) for v in values]
    if not out or not all(math.isfinite(v) for v in out):
        raise ValueError("a query vector has finite components")
    return out


def valid_vector(vector: Column, width: int) -> Column:
    return (F.size(vector) == width) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def _total(terms: list[Column]) -> Column:
    """Terms added in pairs, so that the expression stays shallow."""
    while len(terms) > 1:
        terms = [x + y for x, y in zip(terms[::2], terms[1::2], strict=False)] + terms[len(terms) - len(terms) % 2 :]
    return terms[0]


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _over(vector: Column, query: Sequence[float], term) -> Column:
    """The sum of ``term`` (of a component and the query's) over all components."""
    if len(query) <= WRITTEN_OUT:
        return _total([term(F.get(vector, F.lit(i)).cast("double"), F.lit(q)) for i, q in enumerate(query)])
    return _fold(F.zip_with(vector, F.array(*[F.lit(q) for q in query]), lambda x, q: term(x.cast("double"), q)))


def norm(vector: Column) -> Column:
    return F.sqrt(_fold(F.transform(vector, lambda x: x.cast("double") * x.cast("double"))))


def score(vector: Column, query: Sequence[float], distance: str = "cosine") -> Column:
    """Higher is better for cosine and dot, lower for euclid and manhattan; null for a zero vector's cosine."""
    if distance == "cosine":
        size = math.sqrt(sum(q * q for q in query))
        return F.try_divide(_over(vector, query, lambda x, q: x * q), F.sqrt(_over(vector, query, lambda x, q: x * x)) * F.lit(size))
    if distance == "dot":
        return _over(vector, query, lambda x, q: x * q)
    if distance == "euclid":
        return F.sqrt(_over(vector, query, lambda x, q: (x - q) * (x - q)))
    if distance == "manhattan":
        return _over(vector, query, lambda x, q: F.abs(x - q))
    raise ValueError(f"unknown distance: {distance}")


def best_first(distance: str, by: str = "score") -> Column:
    return F.asc(by) if distance in ("euclid", "manhattan") else F.desc(by)


def payload_filter(conditions: dict[str, object]) -> Column:
    """All of the conditions: a list means any of its values, None is left out, ``path_prefix`` is a prefix of path."""
    out = F.lit(True)
    for name, value in conditions.items():
        if value is None:
            continue
        if name == "path_prefix":
            out = out & F.col("path").startswith(str(value))
        elif isinstance(value, (list, tuple)):
            out = out & F.col(name).isin(*value)
        else:
            out = out & (F.col(name) == value)
    return out


def lacks(name: str, value: object) -> Column:
    """Rows whose field differs from the value or is missing."""
    return ~F.col(name).eqNullSafe(F.lit(value))


def top_k(points: DataFrame, query: Sequence[float], k: int, distance: str = "cosine", conditions: dict[str, object] | None = None, min_score: float | None = None) -> DataFrame:
    """The k best points after the filter; the least score applies to those, so fewer may come."""
    return best(points.where(payload_filter(conditions or {})).withColumn("score", score(F.col("vector"), query, distance)), k, distance, min_score)


def best(scored: DataFrame, k: int, distance: str = "cosine", min_score: float | None = None) -> DataFrame:
    """``top_k`` of rows that have their score."""
    found = scored.orderBy(best_first(distance), F.asc("id")).limit(k)
    return found if min_score is None else found.where(F.col("score") >= min_score)


def top_k_by(points: DataFrame, query: Sequence[float], k: int, group: str, distance: str = "cosine") -> DataFrame:
    """The k best points of each group, ranked from 1; tasks keep k rows a group before the exchange."""
    return ranked_by(points.withColumn("score", score(F.col("vector"), query, distance)), k, group, distance)


def ranked_by(scored: DataFrame, k: int, group: str, distance: str = "cosine") -> DataFrame:
    """``top_k_by`` of rows that have their score."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(best_first(distance), F.asc("id"))))
    return ranked.where(F.col("rank") <= k)


#: Numbers of a batch of queries that travel with the tasks (256 MB), and scores that a task holds at once.
BATCH_NUMBERS, SCORES_AT_ONCE = 32 << 20, 4 << 20


def top_k_batch(points: DataFrame, queries: DataFrame, k: int, distance: str = "cosine") -> DataFrame:
    """The k best points (id, vector) for each of many queries (query_id, vector): query_id, rank, id, score.

    Queries travel with the tasks as one matrix, whose size is checked; a task multiplies it with a matrix of the vectors it reads,
    a block at a time, and gives k rows a query, so nothing else is shuffled. Vectors and queries that are null, of another width
    than the first query's or not finite take no part, nor do zero vectors for cosine. Ties go to the smaller id.
    """
    if distance not in ("cosine", "dot", "euclid"):
        raise ValueError(f"no batch of distance: {distance}")
    asked = queries.where(F.col("vector").isNotNull()).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    if (size.n or 0) * (size.d or 0) > BATCH_NUMBERS:
        raise ValueError(f"{size.n} queries of up to {size.d} components: ask for fewer at once")
    rows = sorted(((r.query_id, r.vector) for r in asked.collect()), key=lambda r: str(r[0]))
    width = len(rows[0][1]) if rows else 0
    rows = [(i, v) for i, v in rows if len(v) == width and width and all(x is not None and math.isfinite(x) for x in v) and (distance != "cosine" or any(v))]
    kind = queries.schema["query_id"].dataType
    schema = f"query_id {kind.simpleString()}, id {points.schema['id'].dataType.simpleString()}, score double"
    if not rows:
        return points.sparkSession.createDataFrame([], f"query_id {kind.simpleString()}, rank int, id {points.schema['id'].dataType.simpleString()}, score double")
    names, matrix = [i for i, _ in rows], np.array([v for _, v in rows])
    sign = -1.0 if distance == "euclid" else 1.0
    lengths = (matrix * matrix).sum(1)

    def scores(vectors: np.ndarray) -> np.ndarray:
        """A row for each query; higher is better."""
        product = matrix @ vectors.T
        own = (vectors * vectors).sum(1)
        if distance == "cosine":
            return product / np.sqrt(lengths[:, None] * np.maximum(own, 1e-300))
        return product if distance == "dot" else -np.sqrt(np.maximum(lengths[:, None] + own - 2 * product, 0))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, list]] = [(np.zeros(0), []) for _ in names]
        ids_type = None
        for batch in batches:
            ids_type = batch.column(0).type
            for at in range(0, batch.num_rows, max(1, SCORES_AT_ONCE // len(names))):
                part = batch.slice(at, max(1, SCORES_AT_ONCE // len(names)))
                if not part.num_rows:
                    continue
                vectors = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width)
                ids = part.column(0).to_pylist()
                for q, found in enumerate(scores(vectors)):
                    held, named = best[q]
                    least = held[-1] if len(held) == k else -np.inf
                    # those that tie with the k-th may still come first by their id
                    some = np.flatnonzero(found >= max(least, np.partition(found, -k)[-k] if len(found) > k else -np.inf))
                    if len(some):
                        pairs = sorted([*zip(-held, named, strict=True), *((-found[i], ids[i]) for i in some.tolist())])[:k]
                        best[q] = (np.array([-s for s, _ in pairs]), [i for _, i in pairs])
        if ids_type is not None:
            flat = [(names[q], i, sign * s) for q, (held, named) in enumerate(best) for s, i in zip(held.tolist(), named, strict=True)]
            columns = zip(*flat, strict=True) if flat else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (to_arrow_type(kind), ids_type, pa.float64()), strict=True)], ["query_id", "id", "score"])

    whole = F.col("vector").isNotNull() & valid_vector(F.col("vector"), width)
    read = points.where(whole).select("id", F.col("vector").cast("array<double>").alias("vector"))
    if distance == "cosine":
        read = read.where(F.exists("vector", lambda x: x != 0))
    ranked = read.mapInArrow(walk, schema).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(best_first(distance), F.asc("id"))))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


@dataclass(frozen=True)
class Collected:
    """Hits of several collections, and a row for each: collection, hits, latency_ms, status (ok, partial, unavailable) and error."""

    hits: DataFrame
    collections: DataFrame


class SearchFailed(RuntimeError):
    """A collection failed in strict mode, or all did."""


def search_collections(spark: SparkSession, runs: dict[str, Callable[[], DataFrame]], strict: bool = False) -> Collected:
    """Runs the search of each collection (at most some k rows each) side by side; a failure of one doesn't stop the others.

    With ``strict`` any failure raises; else the others' hits are kept and their status is ``partial``; if all fail, that raises. All
    searches give the same columns, to which collection is added.
    """

    def run(name: str) -> tuple[str, list | None, object, float, str | None]:
        began = time.perf_counter()
        try:
            df = runs[name]()
            rows, schema, error = df.collect(), df.schema, None
        except Exception as failure:  # whatever a collection fails with is its row's error
            rows, schema, error = None, None, f"{type(failure).__name__}: {str(failure).splitlines()[0] if str(failure) else ''}"
        return name, rows, schema, round((time.perf_counter() - began) * 1000, 1), error

    with ThreadPoolExecutor(max(1, len(runs))) as pool:
        done = list(pool.map(run, runs))
    failed = [(name, error) for name, _, _, _, error in done if error]
    if failed and (strict or len(failed) == len(done)):
        raise SearchFailed("; ".join(f"{name}: {error}" for name, error in failed))
    state = [(name, len(rows or []), latency, "unavailable" if error else "partial" if failed else "ok", error) for name, rows, _, latency, error in done]
    found = [spark.createDataFrame(rows, schema).withColumn("collection", F.lit(name)) for name, rows, schema, _, error in done if not error]
    hits = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "collection string")
    return Collected(hits, spark.createDataFrame(state, "collection string, hits int, latency_ms double, status string, error string"))


#: Hits whose ids are written into a filter; more are joined.
WRITTEN_HITS = 1000


def with_payload(hits: DataFrame, payload: DataFrame, key: str) -> DataFrame:
    """Hits with the columns of ``payload``, whose ``key`` is the hits' id.

    Up to ``WRITTEN_HITS`` of them come to the driver first (never more than one beyond that), so that their ids are a filter
    on the payload's scan and no text of other rows is read, let alone shuffled. More hits are joined.
    """
    rows = hits.limit(WRITTEN_HITS + 1).collect()
    if len(rows) > WRITTEN_HITS:
        return hits.join(payload, F.col("id") == F.col(key)).drop(key)
    found = payload.where(F.col(key).isin([r.id for r in rows]))
    return hits.sparkSession.createDataFrame(rows, hits.schema).join(found, F.col("id") == F.col(key)).drop(key)


def fused(hits: DataFrame, k: int, floor: int = 1, constant: int = 60, types: tuple[str, ...] = ("code", "docs")) -> DataFrame:
    """Reciprocal rank fusion of ranked hits per content type, with a floor for each type.

    The first ``min(floor, k div 2)`` of each type come in first, the others by fused score; ties go to the type
    named first, then to the better rank. The result is in final order under ``position``. Hits are at most k rows
    a type, so the one-partition windows have a bound.
    """
    least = min(max(floor, 1), k // 2)
    order = F.array_position(F.array(*[F.lit(t) for t in types]), F.col("content_type"))
    scored = hits.withColumn("rrf", F.lit(1.0) / (F.lit(constant) + F.col("rank"))).withColumn("_type", order)
    scored = scored.withColumn("_first", F.when(F.col("rank") <= least, 0).otherwise(1))
    picked = scored.orderBy("_first", F.desc("rrf"), "_type", "rank").limit(k)
    return picked.withColumn("position", F.row_number().over(Window.orderBy(F.desc("rrf"), "_type", "rank"))).drop("_type", "_first")


def merged_by_score(hits: DataFrame, k: int, distance: str = "cosine") -> DataFrame:
    """The union of several hit lists by raw score."""
    return hits.orderBy(best_first(distance), "content_type", "id").limit(k)


def quota(results: DataFrame, most: int, k: int, order: list[Column], by: str = "repo") -> DataFrame:
    """At most ``most`` rows of each ``by`` in result order, then the first k."""
    kept = results.withColumn("_nth", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_nth") <= most)
    return kept.drop("_nth").orderBy(*order).limit(k)


def snippet(text: Column, most: int = 300) -> Column:
    """Collapsed and cut text, or a note that there is none."""
    shown = T.truncated(T.collapsed(text), most)
    return F.when(F.coalesce(shown, F.lit("")) != "", shown).otherwise(F.lit("(no snippet)"))


def result(hits: DataFrame) -> DataFrame:
    """Hits in the shape that callers get, with defaults for what is missing."""
    have = set(hits.columns)
    column = lambda *names: F.coalesce(*[F.col(n) for n in names if n in have], F.lit(None))
    start = F.try_to_number(F.trim(column("start_line", "startLine").cast("string")), F.lit("9999999999")).cast("int")
    end = F.try_to_number(F.trim(column("end_line", "endLine").cast("string")), F.lit("9999999999")).cast("int")
    path = F.substring(F.coalesce(column("path").cast("string"), F.lit("(unknown)")), 1, 200)
    lowered = F.lower(column("path").cast("string"))
    guessed = F.when(lowered.endswith(".md") | lowered.endswith(".mdx") | lowered.contains("/docs/"), "docs").otherwise("code")
    kind = column("content_type").cast("string")
    return hits.select(
        F.coalesce(F.nullif(F.trim(column("repo").cast("string")), F.lit("")), F.lit("(unknown)")).alias("repo"), path.alias("path"),
        F.coalesce(F.nanvl(F.col("score").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("score"),
        F.when(start > 0, start).alias("start_line"), F.when((start > 0) & (end >= start), end).alias("end_line"), snippet(column("text").cast("string")).alias("snippet"),
        F.when(kind.isin("code", "docs"), kind).otherwise(guessed).alias("content_type"),
    )


def header(repo: Column, path: Column, start: Column, end: Column) -> Column:
    """``[repo] path:start-end`` with question marks for what is missing."""
    or_mark = lambda x: F.coalesce(x.cast("string"), F.lit("?"))
    named = F.when(F.trim(F.coalesce(repo, F.lit(""))) != "", F.concat(F.lit("["), repo, F.lit("] "))).otherwise(F.lit(""))
    return F.concat(named, or_mark(path), F.lit(":"), or_mark(start), F.lit("-"), or_mark(end))


def result_block(position: Column, shown_score: Column, head: Column, text: Column) -> Column:
    """A hit as two lines of text."""
    bare = F.replace(T.truncated(T.collapsed(text), 300), F.lit('"'), F.lit("'"))
    quoted = F.when(F.coalesce(bare, F.lit("")) != "", bare).otherwise(F.lit("(no text payload)"))
    return F.concat(F.lit("["), position.cast("string"), F.format_string("] score=%.4f  ", shown_score), head, F.lit('\n    snippet: "'), quoted, F.lit('"'))


def enriched(hits: DataFrame, files: DataFrame, most: int = 300) -> DataFrame:
    """Hits with the lines of their files as snippets; hits without a file or a range keep their own.

    hits: repo, path, start_line, end_line, snippet; files: repo, path, text. Only files that hits name are joined.
    """
    wanted = files.select(F.col("repo"), F.col("path"), F.col("text").alias("_text"))
    part = F.slice(T.lines(F.col("_text")), F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0)))
    shown = T.truncated(T.collapsed(F.array_join(part, "\n")), most)
    fits = F.col("_text").isNotNull() & (F.col("start_line") > 0) & F.col("end_line").isNotNull()
    return hits.join(wanted, ["repo", "path"], "left").withColumn("snippet", F.coalesce(F.nullif(F.when(fits, shown), F.lit("")), F.col("snippet"))).drop("_text")
