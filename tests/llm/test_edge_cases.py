"""Nulls, empty and long texts, repeated rows, ties, empty tables and clashing columns, for every operator."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_format, decontaminate, embedding_dedup, jaccard_join, language_id, license_scan, line_dedup, packing, quality_cnn, secret_scan
from tessera.llm.queries_common import tokenizer_path

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 4000
#: Names that operators use inside; as columns of the input they must not matter.
CLASHING = ["id", "key", "doc", "node", "component", "rep", "line", "site", "at", "n", "_n", "_key", "_drop", "label", "size", "seq", "block", "a", "b", "u", "v", "links", "own", "sig", "digest", "entropy", "rejected", "_doc", "prompt", "t", "turns", "class_id", "kept", "row", "base", "added", "sentence_ids"]
ROWS = [(1, "one two three four five six seven", "en", "s0"), (1, "one two three four five six seven", "en", "s0"), (2, None, None, None), (3, "", "en", "s1"), (4, "!!! ... 123", "de", "s2"), (5, LONG, "en", "s0"), (6, LONG, "fr", "s1"), (7, "ein zwei drei", "de", "s1"), (None, "no id here at all", "en", "s0")]


def frame(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in CLASHING:
        df = df.withColumn(name, F.lit("x"))
    return df


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("rows", [ROWS, []], ids=["rows", "empty"])
class TestEveryOperator:
    def test_quality(self, spark, rows):
        docs = frame(spark, rows)
        model = quality_cnn.fit(docs, labels(spark, [(1, 1, 0), (5, 0, 0), (7, 1, None), (None, 1, 0), (3, None, 0)] if rows else []))
        found = quality_cnn.score(docs, model).collect()
        assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
        one_class = quality_cnn.fit(docs, labels(spark, [(1, 1, 0)]))
        assert isinstance(one_class, float)

    def test_lines(self, spark, rows):
        found = line_dedup.drop_boilerplate(frame(spark, rows), min_sites=2)
        assert sorted(found.columns) == sorted([*frame(spark, []).columns, "n_lines", "n_removed"])
        texts = {(r.doc_id, r.source): r.text for r in found.collect()}
        assert found.count() == len(rows)
        if rows:
            assert texts[5, "s0"] == LONG and texts[6, "s1"] == "" and texts[2, None] is None

    def test_language(self, spark, rows):
        docs = frame(spark, rows)
        models = language_id.fit(docs)
        found = {r.id: r for r in language_id.identify(docs, models).collect()}
        assert language_id.identify(docs, models).count() == len(rows)
        if rows:
            assert found[2].lang_pred == found[3].lang_pred == found[4].lang_pred == "und" and found[4].rejected
            assert found[7].lang_pred == "de" and not found[7].rejected
        assert set(language_id.keep_known(docs, models).columns) == set(docs.columns)

    def test_benchmark(self, spark, rows):
        items = spark.createDataFrame([(0, "two three four five six"), (1, None), (2, "zwei drei"), (None, "a b c d e"), (3, "")] if rows else [], "item_id long, text string")
        docs = frame(spark, rows)
        found = sorted((r.doc, r.item_id) for r in decontaminate.overlaps(docs, items).collect())
        assert found == ([(1, 0), (1, 0), (7, 2)] if rows else [])
        joined = sorted((r.doc, r.item_id) for r in decontaminate.overlaps(docs, items, most_words=0).collect())
        assert joined == found
        assert decontaminate.decontaminate(docs, items).count() == len(rows) - len(found)

    def test_jaccard(self, spark, rows):
        found = {r.doc_id: r for r in jaccard_join.near_duplicates(frame(spark, rows)).collect()}
        assert len(found) == len({r[0] for r in rows if r[0]})
        if rows:
            assert found[5].n_links == found[6].n_links == 1 and found[6].class_id == 5 and not found[6].kept
            assert found[2].kept and found[3].kept and found[2].n_links == found[3].n_links == 0

    def test_packing(self, spark, rows):
        found = packing.pack(frame(spark, rows), tokenizer_path()).collect()
        assert sum(r.length for r in found) == sum(r.doc_tokens for r in found if r.start == 0)
        assert sum(r.start == 0 for r in found) == len(rows)
        assert sorted(r.doc_tokens for r in found if r.id in (2, 3)) == ([1, 1] if rows else [])

    def test_secrets_and_licenses(self, spark, rows):
        assert secret_scan.secret_digests(frame(spark, rows)).count() == len(rows)
        assert license_scan.scan_licenses(frame(spark, rows)).count() == len(rows)


@pytest.mark.parametrize("rows", [[(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, None, None), (2, None, "assistant", ""), (2, 1, "assistant", "<|close|>&lt;"), (None, 0, "user", "x")], []], ids=["rows", "empty"])
def test_chats(spark, rows):
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("t", F.lit(1)).withColumn("turns", F.lit(1))
    found = {r.conv_id: r for r in chat_format.parse_chats(chat_format.format_chats(turns)).collect()}
    if rows:
        assert [(t.role, t.text) for t in found[1].turns] == [("user", "a"), ("user", "a"), ("", "")]
        assert found[2].loss_text == "<|close|>&lt;" and found[None].formatted == "<|open|>user<|text|>x<|close|>"
    else:
        assert not found


@pytest.mark.parametrize("rows", [[(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 0.0, 0.0]), (9, [1e308, 1e300]), (None, [1.0, 0.0]), (10, [0.0, 1.0])], []], ids=["rows", "empty"])
def test_vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in CLASHING:
        df = df.withColumn(name, F.lit("x"))
    found = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect())
    assert found == ([(1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 3, 1), (10, 0, 10)] if rows else [])


@pytest.mark.parametrize("rows", [ROWS, []], ids=["rows", "empty"])
def test_pipeline_stages_keep_odd_columns(spark, tmp_path, rows):
    import corpus_pipeline

    docs = frame(spark, rows).withColumn("n_chars", F.length("text").cast("long")).withColumn("n_removed", F.lit("mine")).withColumn("n_lines", F.lit(7))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(str(tmp_path / name))
        found = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert found.columns == docs.columns
            assert {r.n_removed for r in found.collect()} <= {"mine"}
            docs = found
    kept = sorted((r.doc_id or 0, r.text or "") for r in docs.collect())
    # texts without letters are rejected, copies go but for one
    assert [k for k, _ in kept] == ([0, 1, 5, 7] if rows else []) or [k for k, _ in kept] == ([0, 1, 1, 5, 7] if rows else [])


def test_pipeline_filters_judge_rows_by_themselves(spark):
    """Repeated rows, one id with several texts, and null ids, in the stages that remove documents."""
    import corpus_pipeline

    copied, clean, item = ("the quick brown fox jumps over the lazy dog again", "a wholly different text that says nothing of animals", "one two three four five six seven eight nine ten")
    rows = [(1, "same words here in every row of it"), (1, "same words here in every row of it"), (3, copied), (5, clean), (5, copied), (None, copied), (6, item), (6, "what stands here is no part of any item"), (None, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(map(tuple, left.collect()), key=str) == sorted([rows[1], rows[2], rows[3], rows[6], rows[7]], key=str)
    items = spark.createDataFrame([(0, item)], "item_id long, text string")
    want = sorted([r for r in rows if r[1] != item], key=str)
    for most_words in (2_000_000, 0):
        assert sorted(map(tuple, decontaminate.decontaminate(docs, items, most_words=most_words).collect()), key=str) == want


def test_repeated_rows_leave_exactly_one_in_the_pipeline(spark):
    import corpus_pipeline

    found = corpus_pipeline.drop_near_duplicates(spark, frame(spark), "").collect()
    assert sum(r.doc_id == 1 for r in found) == 1
