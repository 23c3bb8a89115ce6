"""Search by blocks gives what a full scan gives and reads less where vectors are clustered."""

from __future__ import annotations

import random

import pytest

from tessera.operators import blocks, search as S

SCHEMA = "id long, repo string, vector array<double>, block_name string"


def clustered(n: int, width: int, centres: int, spread: float, seed: int) -> list[tuple]:
    r = random.Random(seed)
    middles = [[r.gauss(0, 1) for _ in range(width)] for _ in range(centres)]
    return [(i, f"r{i % 3}", [m + r.gauss(0, spread) for m in middles[i % centres]], "x") for i in range(n)]


def same(spark, path, df, query, k, **conditions):
    found = blocks.top_k(spark, path, query, k, conditions)
    want = [(r.id, r.score) for r in S.top_k(df.where("vector IS NOT NULL"), query, k, conditions=conditions).collect() if r.score is not None]
    assert [(r.id, r.score) for r in found.hits] == want
    return found


def test_clusters_leave_most_blocks_unread(spark, tmp_path):
    data = clustered(2000, 16, 20, 0.05, 1)
    df = spark.createDataFrame(data, SCHEMA)
    path = str(tmp_path / "t")
    blocks.build(df, path, 16, 60)
    for at in (0, 777):
        found = same(spark, path, df, data[at][2], 10)
        assert found.rows == 2000 and found.rows_read < 500 and found.blocks_read < found.blocks / 2
    same(spark, path, df, data[5][2], 30, repo="r1")
    # fewer hits than asked for: all that the filter leaves
    assert len(same(spark, path, df, data[5][2], 900, repo="r2").hits) == 666


def test_isotropic_ties_and_unusable_vectors(spark, tmp_path):
    r = random.Random(2)
    data = [(i, "r", [r.gauss(0, 1) for _ in range(8)], "x") for i in range(300)]
    data += [(1000 + i, "r", data[0][2], "x") for i in range(20)]  # ties
    bad = [(5000, "r", None, "x"), (5001, "r", [0.0] * 8, "x"), (5002, "r", [float("nan")] * 8, "x"), (5003, "r", [1.0], "x"), (5004, "r", [1.0] * 7 + [None], "x")]
    path = str(tmp_path / "t")
    blocks.build(spark.createDataFrame(data + bad, SCHEMA), path, 8, 16)
    good = spark.createDataFrame(data, SCHEMA)
    assert same(spark, path, good, data[0][2], 7).rows == 320
    same(spark, path, good, [-x for x in data[3][2]], 320)


def test_empty_tables_and_wrong_requests(spark, tmp_path):
    path = str(tmp_path / "t")
    blocks.build(spark.createDataFrame([], SCHEMA), path, 4)
    assert blocks.top_k(spark, path, [1, 0, 0, 0], 3).hits == []
    for query, k in (([0, 0, 0, 0], 3), ([], 3), ([1, 0, 0, 0], 0)):
        with pytest.raises(ValueError):
            blocks.top_k(spark, path, query, k)
    with pytest.raises(ValueError):
        blocks.build(spark.createDataFrame([], SCHEMA), path, 4, 0)
