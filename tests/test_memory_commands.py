"""Forgetting, clearing and explaining what is remembered."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import memory

SCHEMA = "id string, user string, kind string, topic string, value string, confidence double, active boolean, updated_at timestamp, last_confirmed_at timestamp, times_reinforced int, supersedes_entry_id string, disabled_at timestamp, disabled_reason string"
DAY = dt.datetime(2024, 1, 1)
ONE, TWO = "0b7c6a2e-0000-4000-8000-000000000001", "0b7c6a2e-0000-4000-8000-000000000002"


def entry(id_, user="u", value="tabs", active=True, supersedes=None, topic="indent", day=0):
    return (id_, user, "fact", topic, value, 0.8, active, DAY + dt.timedelta(days=day), DAY, 0, supersedes, None, None)


def now():
    return F.lit("2024-01-11 00:00:00").cast("timestamp")


@pytest.fixture
def entries(spark):
    rows = [entry(ONE, value="spaces", active=False), entry(TWO, supersedes=ONE, day=1), entry("c", active=False, day=2), entry("d", user="w"), entry("e", user=None), entry("f", value=None, topic="lint", day=3)]
    return spark.createDataFrame(rows, SCHEMA)


def test_explain_by_term_and_by_id(entries):
    rows = memory.explain(entries, {"user": "u"}, " INDENT ", now()).collect()
    assert {r.id: r.status for r in rows} == {ONE: "superseded", TWO: "active", "c": "disabled"}
    assert all(abs(r.effective_confidence - 0.8 * 2.718281828459045 ** (-0.1)) < 1e-9 for r in rows)
    assert [(r.id, r.status) for r in memory.explain(entries, {"user": "u"}, ONE, now()).collect()] == [(ONE, "superseded")]
    # an id of another isolation, or one without its form, is told from none
    assert memory.explain(entries, {"user": "w"}, ONE, now()).count() == 0
    assert [r.id for r in memory.explain(entries, {"user": "w"}, "d", now(), by_id=True).collect()] == ["d"]
    assert memory.explain(entries, {"user": "u"}, "  ", now()).count() == 0 and memory.explain(entries.limit(0), {"user": "u"}, "tabs", now()).count() == 0


def test_explain_shows_the_latest_twenty(spark):
    df = spark.createDataFrame([entry(f"x{i:02d}", day=i) for i in range(30)], SCHEMA)
    assert {r.id for r in memory.explain(df, {"user": "u"}, "tabs", now()).collect()} == {f"x{i:02d}" for i in range(10, 30)}


def test_clear_and_forget_keep_all_rows_and_other_isolations(entries):
    cleared = {r.id: r for r in memory.clear(entries, {"user": "u"}, now()).collect()}
    assert {i for i, r in cleared.items() if r.active} == {"d", "e"} and len(cleared) == 6
    assert cleared[TWO].disabled_reason == "manual_clear" and cleared["c"].disabled_reason is None
    nobody = {r.id for r in memory.clear(entries, {"user": None}, now()).collect() if not r.active}
    assert nobody == {ONE, "c", "e"}
    gone = {r.id: r for r in memory.forget(entries, {"user": "u"}, "TABS", now()).collect()}
    assert {i for i, r in gone.items() if r.disabled_reason == "manual_forget"} == {TWO} and len(gone) == 6 and gone["f"].active
