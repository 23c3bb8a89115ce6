"""Batches of queries, guarded collections, and the index run on a stream."""

from __future__ import annotations

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import chunks, documents, memory, paths, search
from tessera.plans import sql
from tessera.sources import embedding, shared
from tessera.streaming import ingest


@pytest.mark.parametrize("distance", ["cosine", "dot", "euclid"])
def test_a_batch_of_queries_equals_single_ones(spark, monkeypatch, distance):
    monkeypatch.setattr(search, "SCORES_AT_ONCE", 64)
    r = np.random.default_rng(1)
    vectors = [(i, r.normal(0, 1, 8).tolist()) for i in range(300)] + [(300 + i, [0.5] * 8) for i in range(30)]
    odd = [(900, None), (901, [0.0] * 8), (902, [1.0]), (903, [float("nan")] * 8), (904, [None] + [1.0] * 7)]
    points = spark.createDataFrame(vectors + odd, "id long, vector array<double>").repartition(5)
    asked = [(f"q{i}", r.normal(0, 1, 8).tolist()) for i in range(9)] + [("same", [0.5] * 8)]
    queries = spark.createDataFrame(asked + [("none", None), ("nan", [float("nan")] * 8)], "query_id string, vector array<double>")
    found = search.top_k_batch(points, queries, 7, distance).collect()
    assert {x.query_id for x in found} == {i for i, _ in asked}
    clean = points.where("id < 900" if distance == "cosine" else "id < 900 OR id = 901")
    for name, vector in asked:
        single = [(x.id, round(x.score, 9)) for x in search.top_k(clean, vector, 7, distance).collect()]
        assert [(x.id, round(x.score, 9)) for x in sorted((x for x in found if x.query_id == name), key=lambda x: x.rank)] == single


def test_batches_have_a_bound(spark, monkeypatch):
    points = spark.createDataFrame([(1, [1.0, 0.0])], "id long, vector array<double>")
    none = spark.createDataFrame([], "query_id string, vector array<double>")
    assert search.top_k_batch(points, none, 3).count() == 0 and search.top_k_batch(points.limit(0), spark.createDataFrame([("a", [1.0, 0.0])], none.schema), 3).count() == 0
    monkeypatch.setattr(search, "BATCH_NUMBERS", 3)
    with pytest.raises(ValueError, match="fewer at once"):
        search.top_k_batch(points, spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0])], none.schema), 3)
    with pytest.raises(ValueError):
        search.top_k_batch(points, none, 3, "manhattan")


def test_collections_fail_apart(spark):
    good = lambda: spark.createDataFrame([(1, 0.5)], "id long, score double")
    bad = lambda: spark.createDataFrame([(1, 0.5)], "id long, score double").select(F.raise_error(F.lit("down")).cast("long").alias("id"), "score")
    both = search.search_collections(spark, {"code": good, "docs": good})
    assert [(r.collection, r.hits, r.status) for r in both.collections.collect()] == [("code", 1, "ok"), ("docs", 1, "ok")] and both.hits.count() == 2
    part = search.search_collections(spark, {"code": good, "docs": bad})
    assert {r.collection: (r.hits, r.status) for r in part.collections.collect()} == {"code": (1, "partial"), "docs": (0, "unavailable")}
    assert [(r.id, r.collection) for r in part.hits.collect()] == [(1, "code")]
    with pytest.raises(search.SearchFailed, match="docs"):
        search.search_collections(spark, {"code": good, "docs": bad}, strict=True)
    with pytest.raises(search.SearchFailed):
        search.search_collections(spark, {"code": bad, "docs": bad})


def test_more_hits_than_are_written_out_are_joined(spark, monkeypatch):
    monkeypatch.setattr(search, "WRITTEN_HITS", 5)
    hits, payload = spark.range(20), spark.range(50).select(F.col("id").alias("doc"), (F.col("id") * 2).alias("x"))
    assert sorted(r.x for r in search.with_payload(hits, payload, "doc").collect()) == [2 * i for i in range(20)]
    assert sorted(r.x for r in search.with_payload(hits.limit(5), payload, "doc").collect()) == [2 * i for i in range(5)]


def test_index_run_on_a_stream(spark, tmp_path):
    """New, changed, unchanged and gone files over three batches equal a run over what is left; a batch that is tried again counts once."""
    source, table, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    os.makedirs(source)
    schema = "repo string, path string, text string, at long"
    code = "def load(\n    path,\n):\n    return path\n\nclass A:\n    def m(self):\n        return load(1)\n"
    batches = [
        [("r", "src/a.py", code), ("r", "docs/b.md", "# One\ntext\n# Two\nmore"), ("r", "docs/c.md", "# Three\nx"), ("s", "src/a.py", "x = 1")],
        [("r", "src/a.py", code), ("r", "docs/b.md", "# One\nother"), ("r", "docs/d.md", "# Late"), ("r", "docs/d.md", "# Later")],
        [("r", "docs/c.md", None), ("s", "src/a.py", None), ("s", "src/a.py", "x = 2")],
    ]

    def run(number: int) -> None:
        name = f"{source}/{number}.json"
        with open(name, "w") as out:
            out.writelines(json.dumps({"repo": r, "path": p, "text": t, "at": i}) + "\n" for i, (r, p, t) in enumerate(batches[number]))
        os.utime(name, (1_700_000_000 + number, 1_700_000_000 + number))
        ingest.index(spark.readStream.schema(schema).json(source), table, checkpoint, "/code").awaitTermination(300)

    for number in range(3):
        run(number)
    left = {("r", "src/a.py"): code, ("r", "docs/b.md"): "# One\nother", ("r", "docs/d.md"): "# Later", ("s", "src/a.py"): "x = 2"}
    whole = documents.chunk_files(spark.createDataFrame([(*k, v) for k, v in left.items()], "repo string, path string, text string"))
    columns = ["repo", "path", "chunk_id", "content_hash", "start_line", "end_line"]
    now = ingest.indexed(spark, table)
    assert sorted(map(tuple, now.select(*columns).collect())) == sorted(map(tuple, whole.select(*columns).collect()))
    # unchanged files were not cut again
    assert {(r.repo, r.path) for r in spark.read.parquet(f"{table}/files/batch=1").collect()} == {("r", "docs/b.md"), ("r", "docs/d.md")}


class Unsteady:
    width = 1

    def __init__(self, *statuses):
        self.statuses = list(statuses)

    def embed(self, texts):
        if self.statuses:
            raise embedding.ProviderError(self.statuses.pop(0))
        return [[1.0]] * len(texts)


def test_statuses_from_500_on_are_tried_again():
    assert embedding.with_retries(Unsteady(500, 503), ["a"], base_seconds=0) == [[1.0]]
    with pytest.raises(embedding.ProviderError, match="404"):
        embedding.with_retries(Unsteady(404), ["a"], base_seconds=0)
    with pytest.raises(embedding.ProviderError, match="500"):
        embedding.with_retries(Unsteady(500, 500), ["a"], tries=2, base_seconds=0)


def test_only_new_contents_reach_the_provider(spark, tmp_path):
    store, schema = str(tmp_path / "vectors"), "id long, text string"
    first = [(1, "a b"), (2, "a b"), (3, "c"), (4, None), (5, "")]
    found = {r.id: r.vector for r in embedding.embed_new(spark.createDataFrame(first, schema), store, embedding.HashingProvider(8)).collect()}
    assert set(found) == {1, 2, 3, 5} and found[1] == found[2] == embedding.HashingProvider(8).embed(["a b"])[0]
    second = [(1, "a b"), (3, "c changed"), (6, "c"), (7, "a\r\nb")]
    assert {r.id for r in embedding.embed_new(spark.createDataFrame(second, schema), store, embedding.HashingProvider(8)).collect()} == {1, 3, 6, 7}
    # each content was embedded once: three in the first run, two in the second
    assert sorted(spark.read.parquet(str(folder)).count() for folder in (tmp_path / "vectors").iterdir()) == [2, 3]


def test_path_tokens(spark):
    rows = [(i, p) for i, p in enumerate(["src/Auth/login.py", "docs/auth.md", "src/author.py", "tests/auth/test_login.py", None, ""])] + [(40_000, "src/auth/late.py"), (-70_000, "src/auth/early.py"), (None, "src/auth/x.py")]
    points = spark.createDataFrame(rows, "id long, path string")
    found = paths.index(points)
    match = lambda text: sorted(r.id for r in paths.holds(points, paths.matched(found, text)).collect())
    assert match("auth") == [-70_000, 0, 1, 3, 40_000]
    assert match("SRC/auth") == [-70_000, 0, 40_000] and match("login.py auth tests") == [3]
    assert match("auth nowhere") == [] and match("/") == []


def test_table_functions_equal_the_dataframe_calls(spark):
    sql.register(spark)
    code = "def load(\n    path,\n):\n    return path\r\n\nclass A:\n    def m(self):\n        return load(1)\n"
    files = spark.createDataFrame([("a.py", code), ("b.py", "def broken(\n"), ("c.py", ""), ("d.py", None), ("e.py", "x\n" * 7)], "path string, text string")
    columns = ["path", "qualified", "start_line", "end_line", "content"]
    said = spark.sql("SELECT f.path, s.* FROM {files} f, LATERAL code_symbols(f.text, 'python') s", files=files)
    assert sorted(map(tuple, said.select(*columns).collect())) == sorted(map(tuple, chunks.symbols(files, "python").select(*columns).collect()))
    columns = ["path", "chunk_index", "start_line", "end_line", "content"]
    said = spark.sql("SELECT f.path, w.* FROM {files} f, LATERAL line_windows(f.text, 3, 1) w", files=files)
    assert sorted(map(tuple, said.select(*columns).collect())) == sorted(map(tuple, chunks.windows(files.where("text IS NOT NULL"), 3, 1).select(*columns).collect()))
    rows = [("u", i, "preference", "t", f"use {w} in code", 0.5) for i, w in enumerate(["tabs", "tabs", "jest", "tabs", "types"])] + [("w", 9, "preference", "t", "use tabs", None)]
    statements = spark.createDataFrame(rows, "user string, seq long, kind string, topic string, value string, confidence double")
    said = spark.sql("SELECT * FROM remembered(TABLE({statements}) PARTITION BY (user, kind, topic) ORDER BY seq)", statements=statements)
    expected = memory.reconcile(statements, ["user"])
    assert sorted(map(str, said.select(*expected.columns).collect())) == sorted(map(str, expected.collect()))


def test_embedding_holds_few_texts_at_once(spark):
    """128 texts of four megabytes in one task: few of them are in Python at once while a provider works, and none as a frame."""

    class Held:
        width = 1

        def embed(self, texts):
            import pyarrow

            return [[pyarrow.total_allocated_bytes() / 2**20] for _ in texts]

    rows = spark.range(128).coalesce(1).select("id", F.when(F.col("id") > 0, F.concat(F.col("id").cast("string"), F.repeat(F.lit("a b "), 1 << 20))).alias("text"))
    made = embedding.embed(rows, Held(), batch=1)
    assert "MapInPandas" not in made._jdf.queryExecution().toString() and int(spark.conf.get(shared.BATCH_BYTES)) <= 4 << 20
    found = {r.id: r.vector[0] for r in made.collect()}
    assert len(found) == 128 and max(found.values()) < 24
