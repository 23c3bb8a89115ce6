"""Search, points, memory, answers, sources and streaming on literal cases; all queries against their SQL."""

import datetime
import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.config import DecayConfig, ScanConfig, Scope, SearchRequest, csv, positive_int, share, truth, valid_path
from tessera.functions import text as T
from tessera.operators import memory, points, rag, search
from tessera.plans import catalogue
from tessera.sources import embedding, repository
from tessera.streaming import ingest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    db = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return db


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, sql, name):
    found = catalogue.QUERIES[name](spark, SMALL)
    rows = found.collect()
    assert len(set(found.columns)) == len(found.columns)
    if name in catalogue.ORACLES:
        relation = sql.sql(catalogue.ORACLES[name])
        order = sorted(found.columns)
        assert order == sorted(relation.columns)
        mine = sorted(str([plain(r[c]) for c in order]) for r in rows)
        theirs = sorted(str([plain(r[relation.columns.index(c)]) for c in order]) for r in relation.fetchall())
        assert mine == theirs


def hits(spark, rows):
    return spark.createDataFrame(rows, "id int, content_type string, rank int, repo string")


def test_fusion_and_floor(spark):
    rows = [(i, "code", i, "a") for i in range(1, 6)] + [(10 + i, "docs", i, "b") for i in range(1, 3)]
    assert [r.id for r in search.fused(hits(spark, rows), 4, 1).orderBy("position").collect()] == [1, 11, 2, 12]
    assert [r.id for r in search.fused(hits(spark, rows), 1, 5).orderBy("position").collect()] == [1]
    only_code = [r for r in rows if r[1] == "code"]
    assert [r.id for r in search.fused(hits(spark, only_code), 3, 9).orderBy("position").collect()] == [1, 2, 3]


def test_quota_keeps_order(spark):
    rows = [(i, "code", i, "a" if i < 6 else "b") for i in range(1, 9)]
    assert [r.id for r in search.quota(hits(spark, rows), 3, 5, [F.asc("rank")]).orderBy("rank").collect()] == [1, 2, 3, 6, 7]


def test_result_shape(spark):
    rows = [("r", "a/docs/x", float("nan"), "3", "2", "", None), ("", None, 0.5, "0", None, "x " * 400, "docs"), (None, "a.mdx", None, "bad", "9", None, "odd")]
    found = search.result(spark.createDataFrame(rows, "repo string, path string, score double, startLine string, endLine string, text string, content_type string")).collect()
    assert [tuple(r)[:5] + (r.content_type,) for r in found] == [("r", "a/docs/x", 0.0, 3, None, "docs"), ("(unknown)", "(unknown)", 0.5, None, None, "docs"), ("(unknown)", "a.mdx", 0.0, None, None, "docs")]
    assert found[0].snippet == found[2].snippet == "(no snippet)" and len(found[1].snippet) <= 300 and found[1].snippet.endswith("...")


@pytest.mark.parametrize("distance", ["cosine", "dot", "euclid", "manhattan"])
def test_scores_written_out_and_folded(spark, monkeypatch, distance):
    rows = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [0.5, -1.0, 0.25]), (3, [0.0, 0.0, 0.0])], "id int, vector array<float>")
    query = search.query_vector([0.5, 0.25, -2.0])
    out = [r[0] for r in rows.orderBy("id").select(search.score(F.col("vector"), query, distance)).collect()]
    monkeypatch.setattr(search, "WRITTEN_OUT", 0)
    folded = [r[0] for r in rows.orderBy("id").select(search.score(F.col("vector"), query, distance)).collect()]
    assert all(a == b or abs(a - b) < 1e-12 for a, b in zip(out, folded, strict=True))
    assert (out[2] is None) == (distance == "cosine")


def test_query_vectors_are_checked():
    for bad in ([], [float("nan")], [float("inf")]):
        with pytest.raises(ValueError):
            search.query_vector(bad)


def test_upsert_keeps_the_last_emission(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 5), (3, "e", 2)], "id int, v string, seq int")
    assert sorted(map(tuple, points.upsert(old, new).collect())) == [(1, "a"), (2, "d"), (3, "e")]


def test_stale_rules(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    existing = make([("keep", "a", "code", "1"), ("old", "a", "code", "9"), ("retyped", "a", "docs", "1"), ("gone", "z", "code", "1"), ("failed", "f", "code", "7"), ("nowhere", None, "code", "1")], "id string, path string, content_type string, chunk_id string")
    one = lambda *paths: make([(p,) for p in paths], "path string")
    current = make([("a", "code", "1")], "path string, content_type string, chunk_id string")
    assert sorted(r.id for r in points.stale(existing, one("a", "f"), one("a"), current).collect()) == ["gone", "old", "retyped"]
    empty = one("a").where("false")
    assert sorted(r.id for r in points.stale(existing, empty, empty, current.where("false")).collect()) == ["failed", "gone", "keep", "old", "retyped"]


def test_coverage_without_files(spark):
    none = spark.createDataFrame([], "path string")
    assert tuple(points.coverage(none, none).first()) == (0, 0, 1.0, "empty")


def test_open_range(spark):
    df = spark.createDataFrame([("p", "\n".join(f"line {i}" for i in range(1, 31)))], "path string, text string")
    row = points.open_range(df, 10, 20).first()
    assert (row.end_line, row.text.count("\n"), row.truncated) == (20, 10, False)
    cut = points.open_range(df, 1, 30, most_bytes=13).first()
    assert (cut.text, cut.truncated, cut.total_lines) == ("line 1\nline 2", True, None)
    assert points.open_range(df, 40, 50).first().text == ""
    assert points.open_range(df, 1, 30, most_lines=5).first().truncated


def test_decay(spark):
    now = F.lit("2024-01-11").cast("timestamp")
    row = spark.range(1).select(
        memory.effective_confidence(F.lit(0.8), F.lit(" Preference"), F.lit("2024-01-01").cast("timestamp"), F.lit(0), now).alias("a"),
        memory.effective_confidence(F.lit(0.9), F.lit("fact"), F.lit("2024-02-01").cast("timestamp"), F.lit(50), now, DecayConfig()).alias("b"),
    ).first()
    assert abs(row.a - 0.8 * 2.718281828459045**-0.8) < 1e-9 and row.b == 1.0


def test_conflicts(spark):
    cases = [("use tabs in code", "nao use tabs in code", "contradiction"), ("use tabs in code", "use tabs in code always", "reinforcement"), ("use tabs in code", "tabs in files", "complement"), ("use tabs", "spaces", "independent"), ("", "x", "independent")]
    df = spark.createDataFrame(cases, "a string, b string, want string").withColumn("got", memory.conflict(F.col("a"), F.col("b")))
    assert all(r.want == r.got for r in df.collect())


def test_reconcile_fold(spark):
    rows = [("u", i, "convention", "style", v, 0.7) for i, v in enumerate(["use tabs in code", "use tabs in code", "nao use tabs in code", "something else"])] + [("w", 9, "convention", "style", "use tabs in code", 0.7)]
    found = {(r.user, r.id): r for r in memory.reconcile(spark.createDataFrame(rows, "user string, seq long, kind string, topic string, value string, confidence double"), ["user"]).collect()}
    assert found["u", 0].times_reinforced == 1 and not found["u", 0].active
    assert found["u", 2].supersedes == 0 and found["u", 2].active and found["u", 3].supersedes is None and found["w", 9].active
    assert len(found) == 4


def test_preload_skips_what_does_not_fit(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = [("s", "1", "a", "w " * 100, 0.9, t), ("s", "2", "b", "w " * 100, 0.8, t), ("s", "3", "c", "w", 0.7, t), ("s", "4", "d", "w", 0.6, t)]
    df = spark.createDataFrame(rows, "scope string, id string, topic string, value string, effective double, recent timestamp")
    assert [r.id for r in memory.preload(df, ["scope"], 3, 130).orderBy("position").collect()] == ["1", "3", "4"]


def test_first_turns(spark):
    rows = [(1, t, "user") for t in range(30)] + [(2, 0, "user"), (2, 0, "user"), (2, None, "user"), (None, 5, "user")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string")
    found = memory.first_turns(df, 3)
    assert sorted((r.conv_id, r.n, r.turn) for r in found.collect() if r.conv_id == 1) == [(1, 1, 0), (1, 2, 1), (1, 3, 2)]
    assert [r.turn for r in found.where("conv_id = 2").orderBy("n").collect()] == [0, 0, None]
    assert [r.n for r in found.where("conv_id IS NULL").collect()] == [1]
    assert memory.first_turns(df.limit(0), 3).count() == 0
    # limited before the exchange, so a long session isn't gathered whole
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()


def test_context_falls_back_to_the_tail(spark):
    pairs = spark.createDataFrame([(1, 1, "u" * 50, "a" * 50), (2, 1, "hi", "yo"), (2, 3, "q", "r")], "conv_id int, turn int, user_text string, assistant_text string")
    found = {r.conv_id: r for r in memory.context(pairs, 8, 60).collect()}
    assert len(found[1].context) == 60 and found[1].turns_used == 0
    assert found[2].context.startswith("[Turno 2]") and found[2].turns_used == 1


def plain_statements(text):
    """Extraction as a loop over Python's own patterns."""
    import re
    import unicodedata

    bare = lambda x: "".join(c for c in unicodedata.normalize("NFKD", x.casefold()) if not unicodedata.combining(c))

    def usual(value):
        value = " ".join(value.split()).strip(" .,:;-'\"()[]{}")
        return memory.ALIASES.get(bare(value)) or (value.upper() if value.upper() in memory.ACRONYMS else value)

    said, found = " ".join(text.split()), []
    if not 1 <= len(said) <= 500:
        return []
    for kind, topic, confidence, pattern in memory.STATEMENTS:
        for m in re.finditer(pattern, said, re.I):
            value, verb = usual(m[2]), m[1].lower()
            if not value or len(value) > 120 or value.count(",") >= 2 or any(d in f" {bare(value)} " for d in memory.DOUBTS):
                continue
            avoid = {"odeio", "detesto", "i hate"} | ({"não gosto de", "nao gosto de", "i dislike"} if topic == "framework_preference" else set())
            stance = "identity" if kind == "profile" else "avoid" if topic == "development_convention" else "require" if kind == "convention" else "avoid" if verb in avoid else "prefer"
            found.append((m.start(), m.end(), kind, topic, value, stance, confidence))
    best = {}
    for f in found:
        key = (f[2], f[3], f[5], bare(f[4]))
        if key not in best or f[6] > best[key][6]:
            best[key] = f
    kept = []
    for f in sorted(best.values(), key=lambda f: (f[0], f[0] - f[1], -int(f[6] * 100))):
        if all(f[1] <= k[0] or f[0] >= k[1] for k in kept):
            kept.append(f)
    return sorted(f for f in kept if f[6] >= 0.7)


def test_extraction(spark):
    import random

    r = random.Random(4)
    bits = ["my name is", "Meu nome é", "Ana Souza", "prefiro", "i hate", "I prefer", "gosto de", "não gosto de", "redux", "context api", "ts", "como linguagem", "for state", "framework", "always use", "camelcase", "for naming", "use", "jest", "for tests", "never use", "var", "maybe", "a, b, c", "rest", ",", ".", "and", "api"]
    said = ["my name is Ana Souza", "Prefiro ts como linguagem", "i hate redux for state", "always use camelcase for naming", "never use var", "i prefer maybe react", "x" * 600, "nothing here", "", *(" ".join(r.choices(bits, k=r.randint(1, 12))) for _ in range(400))]
    found = {}
    for q in memory.extract(spark.createDataFrame(list(enumerate(said)), "id int, text string")).collect():
        found.setdefault(q.id, []).append((q.start, q.end, q.kind, q.topic, q.value, q.stance, q.confidence))
    for i, text in enumerate(said):
        assert sorted(found.get(i, [])) == plain_statements(text), text
    assert found[3][0][4] == "camelCase" and found[0][0][4] == "Ana Souza" and 5 not in found


def test_answers(spark):
    rows = [(1, 1, "a.py", 1, 5, "x = 1", "why"), (1, 2, "b.py", None, None, " ", "why")]
    df = spark.createDataFrame(rows, "q int, position int, path string, start_line int, end_line int, snippet string, question string")
    answer = rag.grounded_answer(df, "q").first().answer
    assert answer.split("\n")[2:] == ["- a.py (linhas 1-5)", "```", "x = 1", "```", "- b.py (linhas ?-?)", "```", rag.NOTHING, "```"]
    text = rag.prompt(df.withColumn("talk", F.lit("before")), "q", "question", "talk").first().prompt
    assert "### Arquivo 2: b.py" in text and "## Contexto da conversa atual:\nbefore\n\n## Pergunta:\nwhy" in text
    kinds = [spark.range(1).select(rag.answer_kind(F.lit(n), g, k)).first()[0] for n, g, k in ((0, False, "all"), (0, True, "all"), (0, False, "strict"), (2, True, "all"), (2, False, "all"))]
    assert kinds == ["general", "fallback", "fallback", "grounded", "model"]


def test_repository_scan(spark, tmp_path):
    for name, data in {"src/a.py": b"x = 1\r\n", "src/b.bin": b"x", "node_modules/c.py": b"x", "docs/d.md": "\ufeffé".encode(), "src/e.py": b"a\0b", "src/f.txt": b"\xe9t\xe9", "src/gen/g.py": b"y"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = {r.path: r.text for r in repository.scan(spark, str(tmp_path), ScanConfig(ignored_patterns=("*/gen/*",))).collect()}
    assert found == {"src/a.py": "x = 1\n", "docs/d.md": "é", "src/f.txt": "été"}
    assert repository.scan(spark, str(tmp_path), ScanConfig(max_files=1)).count() == 1


class Flaky:
    width = 2

    def __init__(self, fails):
        self.fails = fails

    def embed(self, texts):
        self.fails -= 1
        if self.fails >= 0:
            raise TimeoutError
        return [[1.0, 0.0]] * len(texts)


def test_embedding_retries():
    assert embedding.with_retries(Flaky(2), ["a"], base_seconds=0) == [[1.0, 0.0]]
    with pytest.raises(TimeoutError):
        embedding.with_retries(Flaky(9), ["a"], tries=3, base_seconds=0)
    wrong = Flaky(0)
    wrong.width = 3
    with pytest.raises(ValueError):
        embedding.with_retries(wrong, ["a"], base_seconds=0)


def test_stream_takes_new_files_once(spark, tmp_path):
    folder, table, check = (str(tmp_path / x) for x in ("in", "table", "check"))
    schema = "repo string, path string, text string"
    for n, rows in enumerate([[("r", "a.py", "one\ntwo")], [("r", "b.md", "three"), ("r", "a.py", "one\ntwo")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        ingest.ingest(spark.readStream.schema(schema).parquet(folder), table, check).awaitTermination()
        assert ingest.current(spark, table).count() == n + 1


def test_memory_queries_read_whole_turns(spark, tmp_path):
    long = "we talked about the tables " * 20
    rows = [
        (5, 0, "user", "First we look at the tables of the week. After that I prefer jest"),
        (5, 1, "user", "First we look at the tables and leave early today with all of our own things"),
        (5, 2, "assistant", "I prefer pytest"),
        (55, 0, "user", "First we look at the tables of the week. After that I prefer jest"),
        (11, 0, "user", long + ". I prefer jest"),
        (17, 0, "user", None),
    ]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    kept = {(r.conv_id, r.id): r.value for r in catalogue.memory_remember(spark, str(tmp_path)).collect()}
    assert kept == {(5, 5000): rows[0][3], (5, 5001): rows[1][3], (55, 55000): rows[3][3], (11, 11000): rows[4][3], (17, 17000): ""}
    found = sorted((r.id, r.topic, r.value) for r in catalogue.memory_extract(spark, str(tmp_path)).collect())
    assert found == [(5000, "language_preference", "Jest"), (55000, "language_preference", "Jest")]


def test_stream_keeps_recent_turns(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([(c, t, "x") for c in (1, 2) for t in range(10 * c)], "conv_id long, turn long, text string").write.parquet(folder)
    out = []
    stream = ingest.recent_turns(spark.readStream.schema("conv_id long, turn long, text string").parquet(folder), 5)
    stream.writeStream.outputMode("update").foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(out) == [(1, 5, 5, 9), (2, 5, 15, 19)]


def test_settings():
    assert csv(" a, ,b ") == ["a", "b"] and positive_int("x", 3) == 3 and positive_int("-1", 3) == 3 and positive_int(" 7 ", 3) == 7
    assert truth("Yes") and not truth("0", True) and truth(None, True) and share("0", 0.95) == 0.95 and share("1", 0.5) == 1.0
    assert Scope.of("repos", ["a", "a", "b"]).repos == ("a", "b") and SearchRequest.of(" q ", 200).top_k == 20 and SearchRequest.of("q").top_k == 10
    assert valid_path("a/./b") == "a/b" and "x" in ScanConfig.load(("x",)).ignored_dirs and ScanConfig.load(extensions=("py",)).extensions == (".py",)
    for bad in ("../a", "/a", "C:\\a", "\\\\s\\a", "a\0"):
        with pytest.raises(ValueError):
            valid_path(bad)
    for kind, repos in (("all", []), ("repo", ["a", "b"]), ("repos", [str(i) for i in range(11)]), ("repo", ["a/b"])):
        with pytest.raises(ValueError):
            Scope.of(kind, repos)
    with pytest.raises(ValueError):
        SearchRequest.of(" ")


def test_word_sets_are_those_of_the_class_spelt_out_and_quick(spark):
    """Tokens of odd characters, and about the time of a plain split: the class spelt out took ten times that."""
    import re
    import time

    odd = ["Não SEI_9 o-que  é", "\u212aelvin \u0130x straße", "", "  ", "a\u2028b\u00a0c\tA a_1 \U0001f600z", None]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string").select("i", F.lower("t").alias("low"), T.word_set(F.col("t")).alias("w")).orderBy("i").collect()
    assert [r.w for r in found] == [None if r.low is None else list(dict.fromkeys(x for x in re.split("[^a-zA-Z0-9_]+", r.low) if x)) for r in found]
    rows = spark.range(40_000).repartition(8).select(F.concat(F.col("id").cast("string"), F.repeat(F.lit(" some words"), 25)).alias("t")).cache()
    rows.count()

    def seconds(column):
        took = []
        for _ in range(4):
            began = time.perf_counter()
            rows.agg(F.sum(F.size(column))).collect()
            took.append(time.perf_counter() - began)
        return min(took)

    quick, plain = seconds(T.word_set(F.col("t"))), seconds(F.array_distinct(F.split(F.lower("t"), " ", -1)))
    rows.unpersist()
    assert quick < 5 * plain, (quick, plain)
