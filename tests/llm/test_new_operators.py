"""Spelling variants, centroid clustering and toxicity against plain versions, on small and awkward input."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import centroids, spelling, toxicity

# ---------------------------------------------------------------- spelling variants


def plain_near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(docs: list[tuple], damage: int | None) -> dict[str, tuple]:
    import re

    counts: collections.Counter = collections.Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if damage and doc_id is not None and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [o for o in words if o != w and plain_near(w, o)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        if best and words[best] >= 2 * words[w]:
            form[w] = best

    def root(w: str) -> str:
        while w in form:
            w = form[w]
        return w

    return {w: (n, len(near[w]), form.get(w), words.get(form.get(w)), root(w)) for w, n in words.items()}


def compare(spark, docs: list[tuple], damage: int | None = None) -> None:
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS word", "2 AS n", "3 AS key")
    rows = spelling.variants(df, damage=damage).collect()
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows} == plain_variants(docs, damage)
    assert len(rows) == len({r.word for r in rows})


def spelling_docs(seed: int) -> list[tuple]:
    r = random.Random(seed)
    base = ["".join(r.choice("abcdeé") for _ in range(r.randint(5, 9))) for _ in range(60)]
    words = []
    for word in base:
        words += [word] * r.randint(3, 40)
        for _ in range(4):  # variants, and variants of variants
            at = r.randrange(len(word))
            word = r.choice([word[:at] + word[at + 1 :], word[:at] + r.choice("abcdeéÿ") + word[at:], word[:at] + r.choice("abcdeé") + word[at + 1 :]])
            words += [word] * r.randint(1, 12)
    r.shuffle(words)
    parts = [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)]
    return [(i if i % 7 else None, p.upper() if i % 5 == 0 else p) for i, p in enumerate(parts)] + [(1000, None), (1001, ""), (1002, "12 !"), (1000, parts[0]), (1000, parts[0])]


def test_variants_equal_brute_force(spark):
    compare(spark, spelling_docs(1), damage=7)


def test_small_subtries_cells_and_anagrams_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SUBTRIE", 4)
    monkeypatch.setattr(spelling, "LEAF", 2)
    r = random.Random(3)
    anagrams = {"".join(r.sample("abcdef", 6)) for _ in range(150)}
    compare(spark, [*spelling_docs(2), (5000, " ".join(w for w in sorted(anagrams) for _ in range(3)))])


def test_long_words_and_chains(spark):
    long = "a" * 30_000
    chain = " ".join(["abcdefgh"] * 3 + ["abcdefghi"] * 6 + ["abcdefghij"] * 12 + ["abcdefghijk"] * 24 + ["abcdefghijkl"] * 48 + ["abcdefghijklm"] * 96)
    compare(spark, [(1, f"{long} {long} {long} {long}b {long}b {long}b"), (2, chain)])


def test_no_words(spark):
    compare(spark, [])
    compare(spark, [(1, None), (2, "abc abc abc")])


def test_near_pairs_by_code_points():
    r = random.Random(5)
    words = sorted({"".join(r.choice("abé") for _ in range(r.randint(5, 8))) for _ in range(120)})
    codes, offsets = spelling.codes_of(pa.array(words))
    assert bytes(codes).decode("latin-1") == "".join(words)
    left, right = (x.ravel() for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    apart = left != right
    left, right = left[apart], right[apart]
    assert spelling.near(codes, offsets, left, right).tolist() == [plain_near(words[a], words[b]) for a, b in zip(left, right, strict=True)]


# ---------------------------------------------------------------- centroid clustering


def plain_lloyd(rows: list[tuple], k: int = 8, rounds: int = 10, size: int = 64):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return {}, None
    vectors = np.array([v for _, v in kept], np.int64)
    named = [n for n, (i, _) in enumerate(kept) if i is not None]
    start = sorted(named, key=lambda n: (hashlib.sha256(f"3:{kept[n][0]}".encode()).hexdigest(), kept[n][1]))[:k]
    c = vectors[start].copy()
    nearest = lambda: np.stack([((vectors - x) ** 2).sum(1) for x in c], 1)
    for _ in range(rounds):
        where = nearest().argmin(1)
        for j in range(len(c)):
            if (where == j).any():
                c[j] = vectors[where == j].sum(0) // (where == j).sum()
    found = nearest()
    return sorted(((i if i is not None else -1), int(a), int(d)) for (i, _), a, d in zip(kept, found.argmin(1), found.min(1), strict=True)), c


def clustered(spark, rows: list[tuple], **settings):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS vector", "3 AS block")
    return centroids.cluster(df, **settings)


def same_clusters(spark, rows: list[tuple]):
    found = clustered(spark, rows)
    expected, c = plain_lloyd(rows)
    assert sorted(((r.id if r.id is not None else -1), r.cluster, r.distance) for r in found.rows.collect()) == (expected or [])
    if c is not None:
        assert found.centroids.tolist() == c.tolist()
        totals = collections.Counter()
        for _, where, distance in expected:
            totals[where] += distance
        assert found.inertia == [totals[j] for j in range(len(c))]
    return found


def test_clusters_equal_lloyd_with_odd_rows(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(0, 0.2, 64).tolist()) for i in range(300)]
    rows += [(300 + i, [0.25] * 64) for i in range(40)]  # equal vectors
    rows += [(400, None), (401, [1.0] * 63), (402, [None] + [0.0] * 63), (403, [float("nan")] * 64), (404, [float("inf")] + [0.0] * 63), (405, []), (None, [0.1] * 64), (7, [0.3] * 64), (7, [-0.3] * 64)]
    same_clusters(spark, rows)


def test_fewer_rows_than_centroids_and_none(spark):
    same_clusters(spark, [(1, [0.5] * 64), (2, [0.25] * 64), (3, [0.25] * 64)])
    same_clusters(spark, [(1, None)])
    same_clusters(spark, [])
    assert centroids.assigned(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_large_components_stay_exact_and_too_large_ones_are_told(spark):
    r = np.random.default_rng(2)
    same_clusters(spark, [(i, (r.normal(0, 1, 64) * 40_000).tolist()) for i in range(60)])
    with pytest.raises(Exception, match="fit in a long"):
        clustered(spark, [(i, [1e9] * 64) for i in range(9)])


def test_bounds_save_scans_on_separated_groups(spark, monkeypatch):
    monkeypatch.setattr(centroids, "BLOCK", 256)
    r = np.random.default_rng(4)
    middles = r.normal(0, 1, (8, 64))
    rows = [(i, (middles[i % 8] + r.normal(0, 0.05, 64)).tolist()) for i in range(2000)]
    found = same_clusters(spark, rows)
    assert found.scanned[0] == 2000
    assert sum(found.scanned[4:]) < 2000


def test_no_point_of_a_sphere_comes_nearer_than_the_plane_allows():
    r = np.random.default_rng(6)
    looser = 0
    for _ in range(200):
        old = r.normal(0, 1, (3, 5))
        new = old + r.normal(0, 0.3, (3, 5))
        radii = np.abs(r.normal(0, 0.7, 3))
        most = centroids.approach(old, new, radii)
        drift = np.sqrt(((new - old) ** 2).sum(1))
        assert (most <= drift + 1e-12).all()
        looser += (most < drift * 0.9).sum()
        for i in range(3):
            away = r.normal(0, 1, (300, 5))
            points = old[i] + away / np.sqrt((away**2).sum(1))[:, None] * radii[i] * r.uniform(0, 1, 300)[:, None]
            for j in range(3):
                nearer = np.sqrt(((points - old[j]) ** 2).sum(1)) - np.sqrt(((points - new[j]) ** 2).sum(1))
                assert nearer.max() <= most[i, j] + 1e-9
    assert looser > 300


# ---------------------------------------------------------------- toxicity


def toxic_docs(n: int, seed: int) -> tuple[list[tuple], list[tuple]]:
    r = random.Random(seed)
    syllables = ["tha", "ing", "er", "on", "at", "re", "the", "nd", "st", "ou", "wh", "ly"]
    docs, labels = [], []
    for i in range(n):
        words = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(r.randint(40, 300))]
        bad = i % 4 == 0
        if bad:
            for _ in range(3 + len(words) // 40):
                words[r.randrange(len(words))] = r.choice(["Grumpfl", "zorkwitz", "bimbalux", "quadrofen"])
        docs.append((i, " ".join(words).capitalize() + "."))
        labels.append((i, int(bad)))
    return docs, labels


@pytest.fixture(scope="module")
def toxic_model(spark):
    docs, labels = toxic_docs(600, 1)
    return toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_toxic_texts_are_told_on_unseen_rows(spark, toxic_model):
    docs, labels = toxic_docs(300, 2)
    found = {r.id: r.score for r in toxicity.score(spark.createDataFrame(docs, "doc_id long, text string"), toxic_model).collect()}
    assert np.mean([found[i] >= 0.7 for i, y in labels if y]) > 0.95
    assert np.mean([found[i] >= 0.7 for i, y in labels if not y]) < 0.01


def test_windows_tell_known_words_by_bytes(toxic_model):
    windows = toxicity.Windows(toxic_model.toxic, toxic_model.ordinary)
    assert min(windows.difference(w) for w in (b"grumpfl", b"zorkwitz", b"bimbalux", b"quadrofen")) >= 3
    assert windows.difference(b"") == 0
    assert abs(windows.difference(b"\xe4\xb8\xad\xe6\x96\x87")) <= 1


def test_odd_rows_and_long_texts(spark, toxic_model, monkeypatch):
    long = "thaing grumpfl " * 20_000
    rows = [(1, None), (2, ""), (3, "!!! ..."), (None, "zorkwitz"), (4, long), (4, long), (5, "x" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS score")
    found = toxicity.score(df, toxic_model).collect()
    assert len(found) == len(rows)
    assert all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.id in (1, 2, 3)}) == 1
    assert [r.n_windows for r in found if r.id == 4] == [40_000, 40_000]
    # parts of a long text give the counts of the whole
    windows = toxicity.Windows(toxic_model.toxic, toxic_model.ordinary)
    data = np.frombuffer(long.encode(), np.uint8)
    whole = toxicity._count_texts(windows, data, np.array([0, len(data)]))
    monkeypatch.setattr(toxicity, "PART", 1000)
    assert (toxicity._count_texts(windows, data, np.array([0, len(data)])) == whole).all()
    assert toxicity.score(spark.createDataFrame([], "doc_id long, text string"), toxic_model).count() == 0


def test_words_at_text_edges_stay_apart(toxic_model):
    windows = toxicity.Windows(toxic_model.toxic, toxic_model.ordinary)
    texts = [b"ab", b"cd ef", b"", b"gh", b" ij "]
    data, offsets = toxicity._buffer(texts)
    assert windows.counts(data, offsets)[:, 0].tolist() == [1, 2, 0, 1, 1]


def test_one_class_is_a_constant_and_long_texts_are_passed_over(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    only = toxicity.fit(docs, spark.createDataFrame([(1, 0), (2, 0), (3, 1), (2, None)], "doc_id long, toxic int"))
    assert only == 0.0
    assert [r.score for r in toxicity.score(docs, only).collect()] == [0.0, 0.0]
    assert toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int")) == 0.5
    rows, labels = toxic_docs(200, 3)
    rows = [(i, t * 50 if i % 8 == 0 else t) for i, t in rows]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), max_bytes=100_000)
    assert isinstance(model, toxicity.Model)
