"""Statements folded as a table and per arrival: the same entries, with bounded state, over restarts."""

from __future__ import annotations

import os
import random

import pytest

from tessera.operators import memory
from tessera.streaming import ingest

SCHEMA = "user string, seq long, kind string, topic string, value string, confidence double"


def statements(n: int, seed: int) -> list[tuple]:
    r = random.Random(seed)
    words = ["tabs", "spaces", "pytest", "jest", "redux", "types", "small", "functions"]
    return [(r.choice(["u", "w", None]), i, "preference", r.choice(["a", "b"]), r.choice(["", "nao ", "never "]) + " ".join(r.sample(words, 3)) if i % 17 else None, 0.5 + i % 5 / 10) for i in range(n)]


def plain(rows: list[tuple]) -> dict:
    """The fold over whole histories, with all active entries at hand."""
    live: dict = {}
    made: dict = {}
    for user, seq, kind, topic, value, confidence in sorted(rows, key=lambda r: r[1]):
        entries = live.setdefault((user, kind, topic), [])
        new = memory.Entry(seq, value or "", confidence, updated=seq)
        best, chosen = -1.0, None
        for e in sorted(entries, key=lambda e: -e.updated)[:40]:
            a, b = new.words(), e.words()
            alike = len(a & b) / len(a | b) if a and b else 0.0
            if alike > best:
                best, chosen = alike, e
        if chosen is not None and best >= 0.6:
            chosen.updated = seq
            if chosen.against() == new.against():
                chosen.times_reinforced += 1
                continue
            chosen.active = False
            new.supersedes = chosen.id
            entries.remove(chosen)
        entries.append(new)
        made[user, topic, seq] = new
    return {k: (e.value, e.confidence, e.times_reinforced, e.active, e.supersedes) for k, e in made.items()}


def told(df) -> dict:
    return {(r.user, r.topic, r.id): (r.value, r.confidence, r.times_reinforced, r.active, r.supersedes) for r in df.collect()}


def test_a_table_equals_the_plain_fold(spark):
    rows = statements(900, 1)
    found = memory.reconcile(spark.createDataFrame(rows, SCHEMA).repartition(5), ["user"])
    assert told(found) == plain(rows) and len(plain(rows)) == found.count()
    assert memory.reconcile(spark.createDataFrame([], SCHEMA), ["user"]).count() == 0


def test_a_topic_of_many_entries_keeps_bounded_state():
    live, gone = [], 0
    for i in range(500):
        changed, left = memory.take(live, i, f"w{i} x{i} y{i}", 0.5)
        gone += len(left)
        assert len(live) <= memory.MOST_ACTIVE and changed[0].id == i
    assert gone == 500 - memory.MOST_ACTIVE


@pytest.mark.parametrize("restart", [False, True], ids=["once", "restarted"])
def test_arrivals_in_batches_equal_the_table(spark, tmp_path, restart):
    rows = statements(240, 2)
    source, table, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    os.makedirs(source)

    def put(number: int) -> None:
        name = f"{source}/{number}.json"
        spark.createDataFrame(rows[number * 60 : number * 60 + 60], SCHEMA).toPandas().to_json(name, orient="records", lines=True)
        os.utime(name, (1_700_000_000 + number, 1_700_000_000 + number))

    def run() -> None:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(source)
        ingest.remember(stream, table, checkpoint, ["user"]).awaitTermination(300)

    for number in range(4):
        put(number)
        if restart:
            run()
    run()
    versions = spark.read.parquet(table)
    assert versions.select("batch").distinct().count() == 4
    assert told(memory.latest(versions, ["user", "kind", "topic"])) == plain(rows)
