"""Operators against plain versions of themselves on small inputs, whole tables and made cases."""

import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import chat_format, common, decontaminate, embedding_dedup, jaccard_join, language_id, license_scan, line_dedup, packing, quality_cnn
from tessera.llm.queries import QUERIES
from tessera.llm.queries_common import tokenizer_path

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def shingles(text):
    words = WORD.findall((text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_links(sets, least=0.8):
    links = defaultdict(set)
    items = list(sets.items())
    for i, (a, x) in enumerate(items):
        for b, y in items[i + 1 :]:
            if x and y and len(x & y) >= least * len(x | y) - 1e-12:
                links[a].add(b)
                links[b].add(a)
    return links


def smallest_reached(nodes, links):
    out = {}
    for n in sorted(nodes):
        if n not in out:
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = n
                    todo += links[x]
    return out


def near_copies(seed=5, groups=12):
    """Texts with copies at many distances, a large group of near copies, and a passage in common."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=r.randint(3, 9)))
    passage = [word() for _ in range(40)]
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(r.choice([3, 6, 40, 120, 300]))]
        for _ in range(r.randint(1, 8)):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
                own[r.randrange(len(own))] = word()
            texts.append(" ".join(own + (passage if r.random() < 0.3 else [])))
    base = [word() for _ in range(200)]
    for _ in range(60):
        own = list(base)
        for _ in range(r.randint(0, 3)):
            own[r.randrange(len(own))] = word()
        texts.append(" ".join(own))
    return [*texts, "", None, "!!"]


@pytest.mark.parametrize("block", [512, 16])
def test_jaccard_join_loses_no_link(spark, block):
    texts = near_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    links = plain_links(sets)
    classes = smallest_reached(sets, links)
    found = {r.doc_id: r for r in jaccard_join.near_duplicates(docs, block=block).collect()}
    assert {i: (r.n_links, r.class_id) for i, r in found.items()} == {i: (len(links[i]), classes[i]) for i in sets}


def test_cells_are_bounded_by_bytes(spark):
    rows = spark.range(100).select(F.lit(1).alias("key"), "id", F.lit(1 << 20).cast("long").alias("size"))
    cells = common.in_cells(rows, ["key"], "id", 1000, F.col("size"))
    most = cells.groupBy("cell_a", "cell_b").agg(F.sum("size").alias("bytes")).agg(F.max("bytes")).first()[0]
    assert most < 3 * common.BLOCK_BYTES and cells.select("cell_a", "cell_b").distinct().count() == 4 * 5 // 2
    pairs = cells.alias("x").join(cells.alias("y"), ["key", "cell_a", "cell_b"]).where("x.id < y.id AND NOT (x.own = y.own AND cell_a <> cell_b)").select("x.id", "y.id")
    assert pairs.count() == pairs.distinct().count() == 100 * 99 // 2


def test_forest_depth_meets_the_recall():
    assert jaccard_join.forest_depth(0.8, 16, 8, 0.9999) == 3
    assert jaccard_join.forest_depth(0.8, 16, 8, 0.5) > 3


@pytest.mark.parametrize("block", [2048, 64])
def test_embedding_join_is_exact(spark, block):
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 16))
    x[100:200] = x[:100] + r.normal(scale=0.12, size=(100, 16))
    x[200:300] = x[0] + r.normal(scale=0.08, size=(100, 16))
    x[300:320] = x[5]
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = (unit @ unit.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    links = defaultdict(set, {i: set(np.flatnonzero(near[i]).tolist()) for i in range(len(x))})
    classes = smallest_reached(range(len(x)), links)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(7)
    found = {q.vec_id: (q.n_links, q.component_id, q.kept) for q in embedding_dedup.near_duplicates(df, block=block).collect()}
    assert found == {i: (len(links[i]), classes[i], classes[i] == i) for i in range(len(x))}


def test_blocks_of_wide_vectors_are_bounded_by_bytes(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=4096).tolist()) for i in range(40)] + [(100 + i, r.normal(size=4).tolist()) for i in range(40)]
    nodes = embedding_dedup.packed(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding").withColumnRenamed("id", "node").withColumn("copies", F.lit(1).cast("long")).select("vec", "node", "copies")
    # 32 MB hold 1,024 vectors of 32 KB, so each weighs as much as 8 of the 8,192 rows of a block
    found = embedding_dedup.sequenced(embedding_dedup.placed(nodes, {}, 0.4), 8192).orderBy("seq").collect()
    assert [b.seq - a.seq for a, b in zip(found, found[1:])] == [1] * 40 + [8] * 39
    assert [len(r.vec) for r in found] == [32] * 40 + [32768] * 40


def test_distant_intervals_are_skipped():
    left = np.repeat(np.arange(4096.0)[:, None], 2, 1)
    pairs = list(embedding_dedup.interval_pairs(left, left, True, 0.5))
    assert 8 <= len(pairs) <= 16


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(3000), r.randrange(3000)) for _ in range(2000)] + [(i, i + 1) for i in range(5000, 5200)]
    links = defaultdict(set)
    for a, b in edges:
        links[a].add(b)
        links[b].add(a)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    found = {q.node: q.component for q in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {k: v for k, v in smallest_reached(nodes, links).items()}


def test_word_hashes_of_long_texts(monkeypatch):
    text = ("Alpha beta, gamma-delta é " * 40 + "x" * 90 + " end").lower().encode()
    data, at = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole, _ = common.word_hashes(data, at)
    assert len(whole) == len(WORD.findall(text.decode())) and len(set(whole.tolist())) == len(set(WORD.findall(text.decode())))
    monkeypatch.setattr(common, "LONG_TEXT", 100)
    parts, offsets = common.word_hashes(data, at)
    assert parts.tolist() == whole.tolist() and offsets.tolist() == [0, len(whole)]


def test_forest_joins_all_and_no_more():
    r = np.random.default_rng(0)
    for n in (1, 2, 10, 200):
        a, b = r.integers(0, n, 3 * n // 2), r.integers(0, n, 3 * n // 2)
        kept = common.forest(n, a, b)
        links, other = defaultdict(set), defaultdict(set)
        for store, pairs in ((links, zip(a.tolist(), b.tolist(), strict=True)), (other, kept)):
            for x, y in pairs:
                store[x].add(y)
                store[y].add(x)
        assert smallest_reached(range(n), links) == smallest_reached(range(n), other)
        assert len(kept) == n - len(set(smallest_reached(range(n), links).values()))


def plain_tiles(doc, item, least):
    least = min(least, len(item))
    free_item, free_doc, tiles, covered = [True] * len(item), [True] * len(doc), 0, 0
    while True:
        best, matches = least - 1, []
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and free_item[i + k] and free_doc[j + k]:
                    k += 1
                if k > best:
                    best, matches = k, [(i, j)]
                elif k == best and k >= least:
                    matches.append((i, j))
        if best < least:
            return tiles, covered
        for i, j in matches:
            if all(free_item[i : i + best]) and all(free_doc[j : j + best]):
                free_item[i : i + best] = free_doc[j : j + best] = [False] * best
                tiles, covered = tiles + 1, covered + best


def test_tiling_by_definition():
    r = np.random.default_rng(0)
    for _ in range(400):
        doc = r.integers(0, r.integers(1, 6), r.integers(0, 40)).astype(np.uint64)
        item = r.integers(0, r.integers(1, 6), r.integers(1, 20)).astype(np.uint64)
        assert decontaminate.tile(doc, item, 3) == plain_tiles(doc.tolist(), item.tolist(), 3)


@pytest.mark.parametrize("most_words", [2_000_000, 0])
def test_texts_of_few_words_lose_no_item(spark, most_words):
    """Random texts of few distinct words, where seeds repeat everywhere, against tiling of all pairs."""
    r = random.Random(8)
    said = lambda n: " ".join(r.choices(["yes", "no", "so"][: r.randint(1, 3)], k=n))
    docs, items = [said(r.randint(0, 60)) for _ in range(60)], [said(r.randint(1, 30)) for _ in range(12)]
    want = {}
    for d, doc in enumerate(docs):
        for i, item in enumerate(items):
            tiles, covered = plain_tiles(doc.split(), item.split(), 5)
            if covered >= 0.5 * len(item.split()):
                want[d, i] = (tiles, covered)
    found = decontaminate.overlaps(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), most_words=most_words).collect()
    assert {(q.doc, q.item_id): (q.n_tiles, q.covered) for q in found} == want and len(found) == len(want)


def test_candidates_in_steps(monkeypatch):
    r = np.random.default_rng(4)
    words = [r.integers(0, 3, 40).astype(np.uint64) for _ in range(30)]
    known = decontaminate.Benchmark(list(range(30)), words, 5)
    texts, at = np.concatenate(words), np.arange(31) * 40
    whole = list(known.candidates(texts, at, 0.5))
    monkeypatch.setattr(decontaminate, "MOST_PLACES", 50)
    assert list(known.candidates(texts, at, 0.5)) == whole and len(whole) > 30


def test_tiling_of_repetitive_long_texts():
    """Half a million equal words: memory follows the lengths, not the number of pairs of equal runs."""
    tracemalloc.start()
    item = np.ones(2000, np.uint64)
    assert decontaminate.tile(np.ones(500_000, np.uint64), item, 5) == (1, 2000)
    doc = np.concatenate([np.ones(700, np.uint64), np.full(50, 2, np.uint64)] * 600)
    assert decontaminate.tile(doc, item, 5) == (3, 2000)
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


def test_reordered_and_cut_benchmark_passages(spark):
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").collect()]
    words = [t.split() for t in items]
    filler = "nothing of this passage stands in any benchmark item at all ".split()
    cases = {0: filler + words[0] + filler, 1: filler * 50 + words[1][15:] + filler + words[1][:15], 2: filler + words[2][: len(words[2]) * 2 // 3], 3: filler * 3, 4: words[3][:6] + filler}
    docs = spark.createDataFrame([(k, " ".join(v)) for k, v in cases.items()], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for most_words in (10**6, 0):
        found = {(r.doc, r.item_id): r.coverage for r in decontaminate.overlaps(docs, bench, most_words=most_words).collect()}
        assert {0, 1, 2} == {d for d, _ in found} and (1, 1) in found and found[1, 1] > 0.8
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()) == [3, 4]


@pytest.mark.parametrize("most_words", [2_000_000, 0])
def test_items_of_one_repeated_phrase(spark, most_words):
    """A seed that repeats in an item covers words each time it stands there."""
    bench = spark.createDataFrame([(0, "a b " * 15), (1, "c " * 12)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b " * 15), (2, "before " + "a b " * 8 + "after"), (3, "a b a b a and more"), (4, "c " * 40)], "doc_id long, text string")
    found = sorted((r.doc, r.item_id, r.covered) for r in decontaminate.overlaps(docs, bench, most_words=most_words).collect())
    assert found == [(1, 0, 30), (2, 0, 16), (4, 1, 12)]


def test_decontamination_of_whole_table(spark):
    docs, bench = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    expected = set()
    for b in bench.collect():
        item = WORD.findall(b.text.lower())
        for d in docs.collect():
            doc = WORD.findall(d.text.lower())
            grams = {tuple(doc[i : i + 5]) for i in range(len(doc))}
            if any(tuple(item[i : i + 5]) in grams for i in range(len(item) - 4)) and plain_tiles(doc, item, 5)[1] >= 0.5 * len(item):
                expected.add((d.doc_id, b.item_id))
    assert {(r.doc_id, r.item_id) for r in QUERIES["op4_decontamination"](spark, SMALL).collect()} == expected


def test_line_spread_near_and_far_from_the_threshold(spark):
    rows = []
    for sites in (1, 8, 9, 10, 11, 12, 40, 300):
        rows += [(1000 * sites + s, f"line on {sites}\nown {sites} {s}\n\n  line on {sites} ", f"s{s}") for s in range(sites)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    found = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(docs).collect()}
    for i, text, _ in rows:
        sites, s = divmod(i, 1000)
        own = f"own {sites} {s}\n"
        assert found[i] == (text if sites < 10 else (f"line on {sites}\n" if s == 0 else "") + own), i


def test_quality_on_held_out_rows(spark):
    found = QUERIES["op1_quality_cnn"](spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in found) / len(found) > 0.93


def test_quality_gradients(monkeypatch):
    monkeypatch.setattr(quality_cnn, "BLOCK", 7)
    r = np.random.default_rng(1)
    net = quality_cnn.Network(3)
    for name in net.NAMES:
        setattr(net, name, getattr(net, name).astype(np.float64))
    texts = [r.integers(0, 256, n).astype(np.uint8) for n in (0, 5, 300, 1500)]
    y, w = np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 1, 1])

    def loss():
        total = 0.0
        for t, label, weight in zip(texts, y, w, strict=True):
            c = net.chunks(t)
            h = net.hidden(net.pooled(c)[0])
            p = net.probability(h.sum(0)[None], h.max(0)[None], np.array([len(c)], np.float64))[0]
            total -= weight * (label * np.log(p) + (1 - label) * np.log(1 - p))
        return total / w.sum()

    grads = net.gradients(texts, y, w)
    for name in net.NAMES:
        array = getattr(net, name)
        flat = np.argsort(-np.abs(grads[name].ravel()))[:4]
        for i in flat:
            old = array.ravel()[i]
            array.ravel()[i] = old + 1e-5
            up = loss()
            array.ravel()[i] = old - 1e-5
            down = loss()
            array.ravel()[i] = old
            assert abs((up - down) / 2e-5 - grads[name].ravel()[i]) < 1e-3 * max(1e-2, abs(grads[name].ravel()[i])), name


def test_quality_sample_takes_long_texts_and_whole_ids(spark, monkeypatch):
    """Rows of any length are drawn; an id counts once however often it stands there; the bound on bytes ends the sample."""
    seen = []
    monkeypatch.setattr(quality_cnn, "train", lambda texts, labels: seen.append((texts, labels.tolist())) or 0.25)
    docs = spark.createDataFrame([(1, "x" * 100_000), (2, "b"), (2, "a"), (2, "a"), (3, None), (4, "unlabelled"), (None, "z")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (9, 1), (None, 1)], "doc_id long, quality int")
    assert quality_cnn.fit(docs, labels) == 0.25
    texts, marks = seen.pop()
    assert sorted(zip(map(len, texts), marks, strict=True)) == [(0, 0), (1, 1), (100_000, 0)] and b"a" in texts
    quality_cnn.fit(docs, labels, max_bytes=10)
    assert not seen or sum(map(len, seen.pop()[0])) <= 10


def test_quality_scores_whole_texts():
    net = quality_cnn.Network(5)
    texts = [b"", b"a", bytes(range(256)) * 9, b"x" * 70000 + b"$$$ &&&"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for t, score in zip(texts, net.score(data, offsets), strict=True):
        c = net.chunks(np.frombuffer(t, np.uint8))
        h = net.hidden(net.pooled(c)[0])
        assert abs(net.probability(h.sum(0)[None], h.max(0)[None], np.array([len(c)], np.float32))[0] - score) < 1e-4


def test_language_on_held_out_rows(spark):
    found = QUERIES["op3_language_id"](spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in found) / len(found) > 0.98 and not any(r.rejected for r in found)


def test_kneser_ney_adds_up_to_one_and_follows_its_formula():
    texts = {"x": ["abcabd abc", "abd"], "y": ["zab"]}
    counts = {}
    for k, own in texts.items():
        packed, _ = language_id.text_grams(own)
        counts[k] = np.unique(packed, return_counts=True)
    models = language_id.estimate(counts)
    context = (ord("a") << 32 | ord("b") << 16) + np.arange(1 << 16, dtype=np.uint64)
    assert np.allclose(np.exp(models.log_probability(context)).sum(0), 1)
    # by hand for language x: P(c|_ab) with the boundary before the word
    def plain(gram, order):
        if order == 0:
            return 1 / (1 << 16)
        events = [tuple(int(g) >> (16 * j) & 0xFFFF for j in range(3, -1, -1)) for g in np.repeat(*counts["x"])]
        table = Counter(events)
        for k in range(3, order - 1, -1):
            table = Counter({g[1:] for g in table} and [g[1:] for g in table])
        own = gram[4 - order :]
        here = {g: n for g, n in table.items() if g[:-1] == own[:-1]}
        once, twice = sum(n == 1 for n in table.values()), sum(n == 2 for n in table.values())
        d = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
        lower = plain(gram, order - 1)
        return (max(table.get(own, 0) - d, 0) + d * len(here) * lower) / sum(here.values()) if here else lower

    for gram in [(0, 97, 98, 99), (97, 98, 99, 97), (0, 0, 97, 98), (98, 99, 97, 122)]:
        code = np.array([sum(c << 16 * (3 - j) for j, c in enumerate(gram))], np.uint64)
        assert np.isclose(np.exp(models.log_probability(code))[0, 0], plain(gram, 4)), gram


def test_models_in_arrays_and_in_tables_agree(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(1000, "Это русский текст, которого никто не учил", None), (1001, None, None), (1002, "", None), (1003, "123 !", None), (1004, "𐐀𐐁 zq", None)], docs.schema)
    docs = docs.union(odd)
    arrays, tables = language_id.fit(docs), language_id.fit(docs, most_values=0)
    assert isinstance(tables, language_id.StoredModels) and tables.languages == arrays.languages
    assert np.allclose(arrays.limits, tables.limits)
    one, other = ({r.id: r for r in language_id.identify(docs, m).collect()} for m in (arrays, tables))
    assert one.keys() == other.keys() and len(one) == docs.count()
    for i, r in one.items():
        assert (r.lang_pred, r.rejected) == (other[i].lang_pred, other[i].rejected) and abs(r.score - other[i].score) < 1e-6
    kept = [sorted(r.doc_id for r in language_id.keep_known(docs, m).collect()) for m in (arrays, tables)]
    assert kept[0] == kept[1] and 0 < len(kept[0]) < docs.count()


def test_counts_are_whole_however_they_are_held(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("text", "lang")
    found = {(r.lang, r.gram): r.n for r in language_id.count_grams(docs).collect()}
    want = Counter()
    for r in docs.where("lang IS NOT NULL").collect():
        for g in language_id.text_grams([r.text])[0].view(np.int64).tolist():
            want[r.lang, g] += 1
    assert found == want


def test_long_texts_count_piece_by_piece(monkeypatch):
    text = "abc def, ghi jklmnop qr " * 30 + "z" * 90
    whole = language_id.tallied([text])
    models = language_id.estimate({"x": whole})
    entropy, n = models.of_texts([text, "abc", None])
    original = language_id.pieces
    monkeypatch.setattr(language_id, "pieces", lambda t: original(t, 50))
    assert len(original(text, 50)) > 10 and "".join(original(text, 50)) == text
    parted = language_id.tallied([text])
    # only the word of 90 letters is cut within
    assert abs(int(parted[1].sum()) - int(whole[1].sum())) <= 2
    again, m = models.of_texts([text, "abc", None])
    assert np.abs(again - entropy).max() < 0.05 and np.abs(m - n).max() <= 2 and m[1:].tolist() == [4 - 1, 0]


def test_unknown_languages_are_rejected(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    models = language_id.fit(docs)
    odd = spark.createDataFrame([(1, "Это русский текст, которого никто не учил, совсем другой язык"), (2, "qzxv wkjq zzxv pqrx vvkz xqjz kzwx qqpz xkcd wvxz"), (3, "the and of ing tion the and")], "doc_id long, text string")
    assert [r.rejected for r in language_id.identify(odd, models).orderBy("id").collect()] == [True, True, False]


def test_rare_languages_have_rejection_limits(spark):
    """A language of 20 rows among many, and one of 3, reject what is unlike them."""
    r = random.Random(3)
    said = lambda letters, n=12: " ".join("".join(r.choices(letters, k=r.randint(2, 6))) for _ in range(n))
    rows = [(i, said("abcde"), "big") for i in range(3000)] + [(10_000 + i, said("klmno"), "rare") for i in range(20)] + [(20_000 + i, said("uvwxy"), "few") for i in range(3)]
    models = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), calibration_rows=100)
    assert models.languages == ["big", "few", "rare"] and np.isfinite(models.limits).all()
    entropy = np.array([[9.0, 9.0, 8.0], [9.0, 8.0, 9.0]]) + 4
    assert models.decide(entropy, np.array([60, 60]))[2].all()


def test_rejection_limits_come_from_every_training_row(spark):
    """More rows than were once drawn, one repeated, one language of too few texts: limits equal those worked out over all of them."""
    r = random.Random(4)
    said = lambda letters: " ".join("".join(r.choices(letters, k=r.randint(2, 6))) for _ in range(r.randint(1, 30)))
    rows = [(i, said("abcde" if i % 50 else "abcdevwxyz"), "big") for i in range(5000)] + [(9000 + i, said("klmno"), "small") for i in range(60)] + [(9900 + i, said("pqrst"), "few") for i in range(3)] + [(9999, None, "big")]
    models = language_id.fit(spark.createDataFrame([*rows, *[rows[0]] * 40], "doc_id long, text string, lang string"))
    assert models.languages == ["big", "few", "small"]
    entropy, n = models.of_texts([t for _, t, _ in rows])
    place = np.array([models.languages.index(x) for _, _, x in rows])
    h = entropy[np.arange(len(rows)), place]

    def limit(own):
        mean = np.average(h[own], weights=n[own])
        far, long = np.abs(h[own] - mean), n[own] >= np.median(n[own])
        return mean, np.sqrt(np.mean(far[long] ** 2)), np.sqrt(np.mean(far[~long] ** 2 * n[own][~long]))

    full = n > 0
    assert np.allclose(models.limits, [limit(full & (place == 0)), limit(full), limit(full & (place == 2))], rtol=1e-9)


def check_pieces(rows, ids, tokens=2048, segments=64):
    at = Counter()
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
        at[r.doc_id] += r.length
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert at == {k: len(v) for k, v in ids.items()}
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= tokens and len(own) <= segments
    return sum(r.length for r in rows) / (tokens * len(by))


def test_packing_holds_every_id_once_with_little_padding(spark):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text").collect()
    ids = {r.doc_id: np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in docs}
    assert check_pieces(QUERIES["op7_packing"](spark, MIDDLE).collect(), ids) > 0.99


def test_packing_limits_for_instruction_data(spark):
    rows = [(i, "tell me a story " * (i % 9), "once upon a time " * (i % 13)) for i in range(400)]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, prompt string, text string").coalesce(1), tokenizer_path(), prompt_col="prompt", tokens=256, segments=7, loss_tokens=150).collect()
    by = defaultdict(list)
    for r in found:
        by[r.sequence_id].append(r)
    assert all(sum(r.length for r in own) <= 256 and len(own) <= 7 and sum(r.loss_tokens for r in own) <= 150 for own in by.values())
    assert sum(r.length for r in found) == sum(r.doc_tokens for r in found if r.start == 0)


def test_both_tokenizers_agree():
    encode, slow = packing.token_encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    r = random.Random(1)
    pool = [*map(chr, range(0x250)), *map(chr, range(0x2010, 0x2028)), *[" "] * 200, *["\n"] * 50, *"abcdefghijklmnopqrstuvwxyz'" * 20]
    texts = ["".join(r.choices(pool, k=r.randint(0, 90))) for _ in range(1500)] + ["<|endoftext|> x", "日本語 текст", "a" * 5000, "", "🙂 x", "  　"]
    for text in texts:
        assert encode([text])[0].tolist() == slow.encode(text, add_special_tokens=False).ids, text[:40]


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "a" + " \n\t" * 300_000 + "b", "x " * 300_000, "^" * 300_000], ids=["blanks", "feeds", "mixed", "words", "marks"])
def test_packing_of_long_runs(spark, text):
    """A million white-space characters pack with the ids of the tokenizer whose ids count."""
    ids = {1: np.array([*Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids, 1], "<u4")}
    rows = packing.piece_digests(spark.createDataFrame([(1, text)], "doc_id long, text string"), tokenizer_path()).collect()
    check_pieces(rows, ids)


def test_chat_round_trip(spark):
    r = random.Random(2)
    bits = ["<|open|>", "<|close|>", "<|part|>", "<|text|>", "&lt;", "&amp;", "&", "<", "</s>[INST]", "hi ", "\n", "é🙂"]
    rows = [(c, t, r.choice(["user", "assistant", "system", "a<b&"]), "".join(r.choices(bits, k=r.randint(0, 6)))) for c in range(60) for t in range(r.randint(1, 9))]
    chats = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(4))
    want = defaultdict(list)
    for c, _, role, text in sorted(rows):
        want[c].append((role, text))
    for q in chat_format.parse_chats(chats).collect():
        assert [(t.role, t.text) for t in q.turns] == want[q.conv_id]
        assert q.loss_text == "".join(x for role, x in want[q.conv_id] if role == "assistant")
        blocks = 1 + sum(a[0] != b[0] for a, b in zip(want[q.conv_id], want[q.conv_id][1:]))
        assert q.formatted.count(chat_format.OPEN) == blocks


def test_chats_of_many_turns(spark):
    """Tens of thousands of turns, alternating and of one role, take seconds."""
    n = 30_000
    turns = spark.range(2 * n).select((F.col("id") % 2).alias("conv_id"), F.col("id").alias("turn"), F.when((F.col("id") % 2 == 0) | (F.col("id") % 4 == 1), "user").otherwise("assistant").alias("role"), F.lit("a<b").alias("text"))
    began = time.perf_counter()
    found = {r.conv_id: r for r in chat_format.chat_digests(chat_format.format_chats(turns)).collect()}
    assert time.perf_counter() - began < 60
    assert found[0].n_turns == found[1].n_turns == n and (found[0].loss_chars, found[1].loss_chars) == (0, 3 * n // 2)


def test_shared_folder_is_asked_for_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(Session)


def test_license_rules(spark):
    texts = [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0",
        "some prose. Released under the MIT License. more prose",
        "Copyright (c) 2020 Somebody. Some other line.\nAll rights reserved.",
        "This work is licensed under the GNU General Public License, version 3.",
        "The licence plate was blue; all rights were reserved by nobody.",
        "All rights reserved. Licensed under CC BY-NC 4.0.",
    ]
    found = [tuple(r.licenses) for r in license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("id").collect()]
    assert found == [("apache-2.0",), ("mit",), ("proprietary",), ("gpl-3.0",), (), ("cc-by-nc-4.0",)]


MIT_TEXT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.
"""
APACHE_TEXT = """Copyright 2021 Somebody

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
BSD2_TEXT = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3_TEXT = BSD2_TEXT + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL_TEXT = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""
GPL2_TEXT = """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.
"""
LGPL_TEXT = GPL2_TEXT.replace("This program", "This library").replace("GNU General", "GNU Lesser General").replace("version 2", "version 2.1")
AGPL_TEXT = GPL_TEXT.replace("GNU General", "GNU Affero General")
MPL_TEXT = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.
"""
ISC_TEXT = """Copyright (c) 2019, Somebody

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
GPL3_HEAD = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation
"""
MPL_HEAD = """Mozilla Public License Version 2.0
==================================

1. Definitions
"""


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_wrapped_license_texts(spark, mark):
    """Hard-wrapped canonical texts, plain and in comments, and known lines without a stop between others."""
    texts = [MIT_TEXT, BSD_TEXT, GPL_TEXT, "at your option any later\nversion", "SPDX-License-Identifier: MIT\nimport os", "import os\nCopyright 2020 Somebody\nAll rights reserved\nimport re", "permission is hereby granted, free of charge,\n\nto any person obtaining a copy"]
    texts += [APACHE_TEXT, BSD2_TEXT, BSD3_TEXT, GPL2_TEXT, LGPL_TEXT, AGPL_TEXT, MPL_TEXT, ISC_TEXT, GPL3_HEAD, MPL_HEAD, "All rights reserved\n" + BSD2_TEXT.split("\n\n")[1]]
    texts = ["\n".join(mark + line for line in t.split("\n")) for t in texts]
    rows = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("id").collect()
    assert [r.sentence_ids for r in rows] == ["NEFG", "OP", "IJ", "J", "D", "NM", "", "NABCp", "Oqr", "OqrP", "ab", "cd", "e", "lm", "Nt", "gN", "n", "Mq"]
    licenses = [",".join(r.licenses) for r in rows]
    assert licenses[:7] == ["mit", "bsd-3-clause", "gpl-3.0", "", "mit", "proprietary", ""]
    assert licenses[7:17] == ["apache-2.0", "bsd-2-clause", "bsd-3-clause", "gpl-2.0", "lgpl-2.1", "agpl-3.0", "mpl-2.0", "isc", "gpl-3.0", "mpl-2.0"]


def test_pipeline_stages(spark, tmp_path):
    """Each stage on what the one before kept, against plain versions."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            after = {r.doc_id: r for r in rows}
            assert len(after) == len(rows)
        if name == "language_id":
            assert after == before
        elif name == "line_dedup":
            sites, first = defaultdict(set), {}
            for i in sorted(before):
                for at, x in enumerate(before[i].text.split("\n")):
                    sites[x.strip(" ")].add(before[i].source)
                    first.setdefault(x.strip(" "), (i, at))
            for i, r in before.items():
                own = [x for at, x in enumerate(r.text.split("\n")) if not x.strip(" ") or len(sites[x.strip(" ")]) < 10 or first[x.strip(" ")] == (i, at)]
                kept = "\n".join(own)
                assert (after[i].text == kept) if kept.strip() or kept == r.text else i not in after
        elif name == "ngram_jaccard_join":
            sets = {i: shingles(r.text) for i, r in before.items()}
            classes = smallest_reached(sets, plain_links(sets))
            assert set(after) == {i for i in sets if classes[i] == i}
        elif name == "benchmark_decontamination":
            bad = {r.doc for r in decontaminate.overlaps(spark.createDataFrame(list(before.values())), spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
            assert bad and set(after) == set(before) - bad
        else:
            tokenizer = Tokenizer.from_file(tokenizer_path())
            check_pieces(rows, {i: np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 1], "<u4") for i, r in before.items()})
        before = after
    assert docs.count() == corpus_pipeline.run(spark, SMALL).count()


def test_pipeline_rejects_by_limits_from_every_training_row(spark, monkeypatch):
    """The stage's limits don't depend on a number of rows to draw."""
    import corpus_pipeline

    r = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join("".join(r.choices("abcde", k=r.randint(2, 6))) for _ in range(r.randint(1, 30))), "big") for i in range(4000)], "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(language_id, "keep_known", lambda rows, models: seen.append(models) or rows)
    corpus_pipeline.identify_language(spark, docs, MIDDLE)
    rows = docs.where(~corpus_pipeline.held_out())
    fewer = language_id.fit(rows, calibration_rows=1)
    assert np.allclose(seen[0].limits, fewer.limits, rtol=1e-9)
