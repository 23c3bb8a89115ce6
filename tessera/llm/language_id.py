"""Language ID: interpolated Kneser-Ney character models per language in sorted hash arrays.

Texts are lower-cased; every run of characters that aren't letters is one boundary. Each letter and each boundary
after a word is predicted from up to three characters before it in its word, so a model is a set of 4-grams. A
model's log probabilities stand in one array per order, sorted by gram hash, with one column per language; a gram
that no language has seen backs off by context weights stored the same way. A text goes to the language of lowest
cross-entropy per event. It is rejected when that is above what training texts of that language and length show
(see ``calibrate``), or when it has no letter.

4-gram counts and rejection limits are gathered by Spark over all training rows and none is left out. Models of up to ``most_values``
numbers (distinct grams times languages, checked) travel with the tasks as sorted hash arrays, and texts are scored where
they are read. Beyond that the same numbers stand in tables of the shared folder and texts' grams are joined with them.
Both ways give the same entropies. Null and empty texts have no letter: ``und``, score 0.
Equal cross-entropies go to the alphabetically first language. With no training row at all every text is
``und``. Repeated rows give repeated results; other columns pass by; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import U64, checkpointed, map_arrow, mix, steps, text_buffer

ORDER = 4
#: Nats per event above the calibrated band within which a text still counts as its language.
SLACK = 1.5
#: Characters outside the 16-bit plane are folded into it; the space of symbols for the uniform end of the back-off.
SYMBOLS = 1 << 16
#: Distinct grams of a language that a task holds while it counts, and a quarter of what it holds of all.
HELD = 300_000
_letters = np.array([chr(c).isalpha() for c in range(SYMBOLS)])


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters as numbers, 0 for a boundary; each text starts with one. With n+1 offsets."""
    low = ["\0" + t.lower() for t in texts]
    sizes = np.array([len(t) for t in low], np.int64)
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    astral = np.flatnonzero(codes >= SYMBOLS)
    if len(astral):
        codes = codes.copy()
        codes[astral] = [(x * 40503) % (SYMBOLS - 1) + 1 if chr(x).isalpha() else 0 for x in codes[astral].tolist()]
        letter = _letters[codes]
        letter[astral] = codes[astral] > 0
    else:
        letter = _letters[codes]
    codes = np.where(letter, codes, 0)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[offsets[:-1]] = True
    places = np.concatenate([[0], np.cumsum(keep)])
    return codes[keep].astype(U64), places[offsets]


def grams(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed 4-grams (the predicted symbol in the low 16 bits) of all events, and n+1 offsets; contexts end at word starts."""
    before = np.zeros((3, len(codes)), U64)
    before[0, 1:] = codes[:-1]
    before[1, 1:] = np.where(before[0, 1:] > 0, before[0, :-1], 0)
    before[2, 1:] = np.where(before[1, 1:] > 0, before[1, :-1], 0)
    packed = (before[2] << U64(48)) | (before[1] << U64(32)) | (before[0] << U64(16)) | codes
    event = np.ones(len(codes), bool)
    event[offsets[:-1]] = False
    return packed[event], offsets - np.arange(len(offsets))


def text_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Grams and offsets of a list of texts, null as empty."""
    return grams(*symbols([t or "" for t in texts]))


def pieces(text: str | None, most: int = 2_000_000) -> list[str]:
    """A text in pieces that are worked on one by one, cut behind characters that aren't letters, so that no word is parted.

    Only a word of more than ``most`` letters is cut within.
    """
    text, out, at = text or "", [], 0
    while len(text) - at > most:
        end = at + most
        while end > at and text[end - 1].isalpha():
            end -= 1
        end = end if end > at else at + most
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


@dataclass
class Models:
    languages: list[str]
    #: for each order from 1: sorted gram hashes, log probabilities (a column per language)
    keys: list[np.ndarray]
    logs: list[np.ndarray]
    #: for each order from 2: sorted context hashes, log back-off weights
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    #: for each language: mean, spread between texts and spread of one event of the training texts' cross-entropy
    limits: np.ndarray | None = None

    def log_probability(self, packed: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Rows of log probabilities of distinct grams (their low 16 * order bits)."""
        if order == 0:
            return np.full((len(packed), len(self.languages)), -np.log(SYMBOLS))
        own = packed & U64((1 << 16 * order) - 1) if order < 4 else packed
        found, at = _find(self.keys[order - 1], mix(own))
        out = np.empty((len(packed), len(self.languages)))
        out[found] = self.logs[order - 1][at[found]]
        rest = np.flatnonzero(~found)
        if len(rest):
            lower = self.log_probability(own[rest], order - 1)
            known, where = _find(self.contexts[order - 1], mix(own[rest] >> U64(16)))
            lower[known] += self.weights[order - 1][where[known]]
            out[rest] = lower
        return out

    def entropies(self, packed: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per event of each text (a column per language), and its number of events."""
        n = np.diff(offsets)
        out = np.zeros((len(n), len(self.languages)))
        full = np.flatnonzero(n)
        if len(full):
            distinct, code = np.unique(packed, return_inverse=True)
            logs = self.log_probability(distinct).astype(np.float32)
            for k in range(len(self.languages)):
                out[full, k] = -np.add.reduceat(logs[:, k][code], offsets[:-1][full], dtype=np.float64) / n[full]
        return out, n

    def of_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """``entropies`` of texts; long ones are scored piece by piece, so memory doesn't follow a text's length."""
        cut = [pieces(t) for t in texts]
        if all(len(c) == 1 for c in cut):
            return self.entropies(*text_grams([c[0] for c in cut]))
        entropy, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for i, own in enumerate(cut):
            for piece in own:
                h, k = self.entropies(*text_grams([piece]))
                entropy[i] += h[0] * k[0]
                n[i] += k[0]
        return entropy / np.maximum(n, 1)[:, None], n

    def decide(self, entropy: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the best language (-1 if there is no letter), its share (0 to 1), and whether it is rejected."""
        if not self.languages:
            return np.full(len(n), -1), np.zeros(len(n)), np.ones(len(n), bool)
        best = entropy.argmin(1)
        least = entropy[np.arange(len(n)), best]
        # the posterior of equal priors, with at most 50 events counted as independent
        share = 1 / np.exp(-np.minimum(n, 50)[:, None] * (entropy - least[:, None])).sum(1)
        rejected = n == 0
        if self.limits is not None:
            mean, between, within = self.limits[best].T
            rejected |= least > mean + 6 * np.sqrt(between**2 + within**2 / np.maximum(n, 1)) + SLACK
        return np.where(n == 0, -1, best), np.where(n == 0, 0.0, share), rejected


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


def _discount(counts: np.ndarray) -> float:
    """Ney's estimate from the numbers of grams seen once and twice, kept within (0, 1)."""
    return _ney(int((counts == 1).sum()), int((counts == 2).sum()))


def _ney(once: int, twice: int) -> float:
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5


def estimate(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Models:
    """Models from each language's packed 4-grams and their counts."""
    languages = sorted(counts)
    tables = []
    for language in languages:
        packed, times = counts[language]
        orders = {ORDER: (packed, times.astype(np.float64))}
        for order in range(ORDER - 1, 0, -1):
            # continuation counts: how many different symbols stand before the shorter gram
            shorter = orders[order + 1][0] & U64((1 << 16 * order) - 1)
            values, n = np.unique(shorter, return_counts=True)
            orders[order] = (values, n.astype(np.float64))
        contexts = {}
        for order, (values, n) in orders.items():
            keys, code = np.unique(values >> U64(16), return_inverse=True)
            contexts[order] = (keys, np.bincount(code, n), np.bincount(code), _discount(n))
        tables.append((orders, contexts))

    union = [np.unique(np.concatenate([t[0][o][0] for t in tables])) if tables else np.zeros(0, U64) for o in range(1, ORDER + 1)]
    union_contexts = [np.unique(np.concatenate([t[1][o][0] for t in tables])) if tables else np.zeros(0, U64) for o in range(1, ORDER + 1)]
    probabilities: list[np.ndarray] = []
    weights: list[np.ndarray] = []
    for order in range(1, ORDER + 1):
        grams_here, contexts_here = union[order - 1], union_contexts[order - 1]
        p = np.empty((len(grams_here), len(languages)))
        w = np.ones((len(contexts_here), len(languages)))
        for k, (orders, contexts) in enumerate(tables):
            keys, totals, kinds, discount = contexts[order]
            gamma = discount * kinds / totals
            w[np.searchsorted(contexts_here, keys), k] = gamma
            seen, at = _find(orders[order][0], grams_here)
            known, where = _find(keys, grams_here >> U64(16))
            if order == 1:
                lower = np.full(len(grams_here), 1 / SYMBOLS)
            else:
                lower = probabilities[-1][np.searchsorted(union[order - 2], grams_here & U64((1 << 16 * (order - 1)) - 1)), k]
            own = np.where(seen & known, np.maximum(orders[order][1][at] - discount, 0) / totals[where], 0.0)
            p[:, k] = own + np.where(known, gamma[where], 1.0) * lower
        probabilities.append(p)
        weights.append(w)

    def by_hash(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes = mix(values)
        order = np.argsort(hashes)
        return hashes[order], np.log(rows[order])

    stored = [by_hash(v, p) for v, p in zip(union, probabilities, strict=True)]
    backed = [by_hash(v, w) for v, w in zip(union_contexts, weights, strict=True)]
    return Models(languages, [k for k, _ in stored], [x for _, x in stored], [k for k, _ in backed], [x for _, x in backed])


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of grams added up."""
    values, code = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
    return values, np.bincount(code, np.concatenate([n for _, n in parts])).astype(np.int64)


def tallied(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of texts and their counts, long texts piece by piece."""
    cut = [pieces(t) for t in texts]
    if all(len(c) == 1 for c in cut):
        return np.unique(text_grams([c[0] for c in cut])[0], return_counts=True)
    return added([np.unique(text_grams([p])[0], return_counts=True) for own in cut for p in own])


def count_grams(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, gram, n: counts of all 4-grams of all rows, added up within tasks before they are dealt."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        sizes: dict[str, int] = {}

        def rows_of(lang: str) -> pa.RecordBatch:
            del sizes[lang]
            values, n = added(held.pop(lang))
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

        for batch in batches:
            by_lang: dict[str, list[int]] = {}
            for i, lang in enumerate(batch.column(0).to_pylist()):
                by_lang.setdefault(lang, []).append(i)
            for lang, own in by_lang.items():
                texts = batch.column(1).take(pa.array(own))
                _, offsets = text_buffer(texts)
                for a, b in steps(offsets, 1 << 20):
                    part = tallied(texts.slice(a, b - a).to_pylist())
                    held.setdefault(lang, []).append(part)
                    sizes[lang] = sizes.get(lang, 0) + len(part[0])
                    if sizes[lang] > HELD:
                        # parts are added up once they are many; what stays long goes on
                        held[lang] = [added(held[lang])]
                        sizes[lang] = len(held[lang][0][0])
                        if sizes[lang] > HELD // 2:
                            yield rows_of(lang)
                    while sum(sizes.values()) > 4 * HELD:
                        yield rows_of(max(sizes, key=sizes.get))
        for lang in list(held):
            yield rows_of(lang)

    own = rows.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return map_arrow(own, tally, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class StoredModels:
    """The same models as tables, for more numbers than travel with the tasks."""

    languages: list[str]
    #: for each order from 1: gram, p (probabilities, one per language)
    grams: list[DataFrame]
    #: for each order from 1: context, w (back-off weights, one per language)
    contexts: list[DataFrame]
    limits: np.ndarray | None = None

    decide = Models.decide


def _low(gram: str, order: int) -> Column:
    """A gram's last ``order`` symbols."""
    return F.col(gram).bitwiseAND(F.lit((1 << 16 * order) - 1)) if order < ORDER else F.col(gram)


def _before(gram: Column) -> Column:
    return F.shiftrightunsigned(gram, 16)


def estimate_stored(counted: DataFrame, languages: list[str]) -> StoredModels:
    """``estimate`` over tables: one join with contexts and one with the order below for each order."""
    per_language = lambda value: F.array(*[F.coalesce(F.sum(F.when(F.col("lang") == x, value)), F.lit(0)).cast("double") for x in languages])
    each = F.sequence(F.lit(0), F.lit(len(languages) - 1))
    counts = {ORDER: counted.select("lang", "gram", "n")}
    for order in range(ORDER - 1, 0, -1):
        counts[order] = checkpointed(counts[order + 1].select("lang", _low("gram", order).alias("gram")).groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n")))
    models = StoredModels(languages, [], [])
    for order in range(1, ORDER + 1):
        rows = counts[order]
        # a row per language
        seen = {r.lang: _ney(r.once, r.twice) for r in rows.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).collect()}
        discount = F.array(*[F.lit(seen[x]) for x in languages])
        contexts = rows.groupBy(_before(F.col("gram")).alias("context")).agg(per_language(F.col("n")).alias("total"), per_language(F.lit(1)).alias("kinds"))
        weight = F.transform(each, lambda k: F.when(F.get("total", k) > 0, F.get(discount, k) * F.get("kinds", k) / F.get("total", k)).otherwise(F.lit(1.0)))
        contexts = checkpointed(contexts.select("context", "total", weight.alias("w")))
        own = rows.groupBy("gram").agg(per_language(F.col("n")).alias("n")).withColumn("context", _before(F.col("gram"))).join(contexts, "context")
        if order == 1:
            own = own.withColumn("below", F.array_repeat(F.lit(1 / SYMBOLS), len(languages)))
        else:
            own = own.join(models.grams[-1].select(F.col("gram").alias("_low"), F.col("p").alias("below")), _low("gram", order - 1) == F.col("_low"))
        seen_share = lambda k: F.when(F.get("total", k) > 0, F.greatest(F.get("n", k) - F.get(discount, k), F.lit(0.0)) / F.get("total", k)).otherwise(F.lit(0.0))
        models.grams.append(checkpointed(own.select("gram", F.transform(each, lambda k: seen_share(k) + F.get("w", k) * F.get("below", k)).alias("p"))))
        models.contexts.append(contexts.select("context", "w"))
    return models


def _entropies_by_join(rows: DataFrame, models: StoredModels) -> DataFrame:
    """key, entropy, n of rows (key, text) that have events: their grams are joined with the tables, longest first."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values, n = tallied([text.as_py()])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), key)), pa.array(values.view(np.int64)), pa.array(n)], ["key", "gram", "times"])

    none = F.array_repeat(F.lit(0.0), len(models.languages))
    plus = lambda log, p: F.zip_with(log, p, lambda x, y: x + F.log(y))
    left = checkpointed(map_arrow(rows.select("key", "text"), cut, "key long, gram long, times long")).withColumn("log", none)
    done = None
    for order in range(ORDER, 0, -1):
        # stored, so that each join stands between exchanges and a gram that most texts hold can be split
        found = checkpointed(left.join(models.grams[order - 1].withColumnRenamed("gram", "_gram"), _low("gram", order) == F.col("_gram"), "left").drop("_gram"))
        part = found.where("p IS NOT NULL").select("key", "times", plus("log", "p").alias("log"))
        done = part if done is None else done.unionByName(part)
        backed = found.where("p IS NULL").drop("p").join(models.contexts[order - 1], _before(_low("gram", order)) == F.col("context"), "left")
        left = backed.select("key", "gram", "times", F.when(F.col("w").isNull(), F.col("log")).otherwise(plus("log", "w")).alias("log"))
    done = done.unionByName(left.select("key", "times", F.transform("log", lambda x: x - math.log(SYMBOLS)).alias("log")))
    total = F.sum("times")
    return done.groupBy("key").agg(F.array(*[-F.sum(F.get("log", F.lit(k)) * F.col("times")) / total for k in range(len(models.languages))]).alias("entropy"), total.alias("n"))


def fit(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", calibration_rows: int = 3000, most_values: int = 8_000_000) -> Models | StoredModels:
    """Models of all languages of ``rows``, with rejection limits from all of its texts (see ``calibrate``).

    Counts and limits take every training row; ``calibration_rows`` is accepted for older callers and has no effect. A row
    repeated with its id, text and language counts once for the limits. Models of more than ``most_values`` numbers stay in tables.
    """
    counted = checkpointed(count_grams(rows, text_col, lang_col))
    # a row per language
    languages = sorted(r.lang for r in counted.select("lang").distinct().collect())
    if counted.select("gram").distinct().count() * len(languages) > most_values:
        models = estimate_stored(counted, languages)
    else:
        counts = {}
        for lang, own in counted.toPandas().groupby("lang"):
            values, n = own["gram"].to_numpy().view(U64), own["n"].to_numpy()
            order = np.argsort(values)
            counts[lang] = (values[order], n[order])
        models = estimate(counts)
    if languages:
        # what tells a row rides along instead of its text
        row = F.concat_ws(":", F.col(id_col).cast("string"), F.md5(F.col(text_col).cast("binary")))
        own = rows.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), row.alias("row"))
        places = F.create_map(*[F.lit(x) for k, lang in enumerate(languages) for x in (lang, k)])
        scored = entropies(own, models, ["lang", "row"]).where("n > 0")
        scored = scored.select("lang", "row", F.get("entropy", F.try_element_at(places, F.col("lang"))).alias("h"), "n").where("h IS NOT NULL")
        models.limits = calibrate(languages, checkpointed(scored.groupBy("lang", "row").agg(F.min("h").alias("h"), F.min("n").alias("n"))))
    else:
        models.limits = np.zeros((0, 3))
    return models


def calibrate(languages: list[str], scored: DataFrame) -> np.ndarray:
    """For each language the mean cross-entropy of its own texts, its spread between long texts, and that of one event.

    ``scored`` has a row per text: lang, h (cross-entropy in its own language), n (events). A text of n events is rejected
    beyond mean + 6 sqrt(between^2 + within^2 / n) + SLACK, far out of what training
    texts of its language show, so clean texts and mixtures of known languages stay. A language of fewer than 8 texts
    takes the limit of all languages' texts together; with fewer than 8 in all, nothing is rejected by its entropy.
    Only sums over texts of a language, and over all (null), come to the driver.
    """
    both = scored.withColumn("lang", F.explode(F.array("lang", F.lit(None).cast("string"))))
    told = {r.lang: r for r in both.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"), (F.sum(F.col("h") * F.col("n")) / F.sum("n")).alias("mean"), F.median("n").alias("middle")).collect()}
    if not told:
        return np.tile([np.inf, 0.0, 0.0], (len(languages), 1))
    # a row per language, and one for all
    known = scored.sparkSession.createDataFrame([(lang, r["mean"], float(r["middle"])) for lang, r in told.items()], "key string, mean double, middle double")
    far = both.join(F.broadcast(known), F.col("lang").eqNullSafe(F.col("key"))).select("lang", (F.col("h") - F.col("mean")).alias("far"), "n", (F.col("n") >= F.col("middle")).alias("long"))
    square = F.col("far") * F.col("far")
    spread = far.groupBy("lang").agg(F.sqrt(F.avg(F.when(F.col("long"), square))).alias("between"), F.sqrt(F.avg(F.when(~F.col("long"), square * F.col("n")))).alias("within"))
    spreads = {r.lang: (r.between, 3.0 if r.within is None else r.within) for r in spread.collect()}

    def limit(lang: str | None) -> tuple[float, float, float]:
        return (told[lang]["mean"], *spreads[lang]) if told[lang].texts >= 8 else (np.inf, 0.0, 0.0)

    return np.array([limit(lang if lang in told and told[lang].texts >= 8 else None) for lang in languages], np.float64).reshape(-1, 3)


def _keyed(docs: DataFrame, key: str) -> DataFrame:
    """The rows with a key of their own; stored, so that a row keeps its key however often it is read."""
    return checkpointed(docs.withColumn(key, F.monotonically_increasing_id()))


def entropies(docs: DataFrame, models: Models | StoredModels, also: list[str]) -> DataFrame:
    """``also`` (strings), entropy (array, a value per language) and n (events) of each row's text."""
    if isinstance(models, StoredModels):
        rows = _keyed(docs.select("text", *also), "key")
        return rows.join(_entropies_by_join(rows, models), "key").select(*also, "entropy", "n")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            _, offsets = text_buffer(texts)
            for a, b in steps(offsets, 1 << 20):
                entropy, n = models.of_texts(texts.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in also], pa.array(list(entropy), pa.list_(pa.float64())), pa.array(n)], [*also, "entropy", "n"])

    return map_arrow(docs.select("text", *also), walk, ", ".join(f"{c} string" for c in also) + ", entropy array<double>, n long")


def _decided(rows: DataFrame, models: StoredModels) -> DataFrame:
    """id, lang_pred, score, rejected of rows (id, key, text)."""
    languages, limits = models.languages, models.limits

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*languages, "und"], object)
        plain = StoredModels(languages, [], [], limits)
        for batch in batches:
            n = batch.column(2).to_numpy(zero_copy_only=False)
            entropy = np.zeros((len(n), len(languages)))
            entropy[n > 0] = np.array([x for x in batch.column(1).to_pylist() if x is not None], np.float64).reshape(-1, len(languages))
            best, share, rejected = plain.decide(entropy, n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(share), pa.array(rejected)], ["id", "lang_pred", "score", "rejected"])

    found = rows.select("id", "key").join(_entropies_by_join(rows, models), "key", "left")
    return map_arrow(found.select("id", "entropy", F.coalesce("n", F.lit(0)).alias("n")), walk, "id long, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, models: Models | StoredModels, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, rejected for every row of ``docs``."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if isinstance(models, StoredModels):
        return _decided(_keyed(source, "key"), models)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*models.languages, "und"], object)
        for batch in batches:
            texts = batch.column(1)
            _, offsets = text_buffer(texts)
            for a, b in steps(offsets, 1 << 20):
                best, share, rejected = models.decide(*models.of_texts(texts.slice(a, b - a).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(names[best], pa.string()), pa.array(share), pa.array(rejected)], ["id", "lang_pred", "score", "rejected"])

    return map_arrow(source, walk, "id long, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, models: Models | StoredModels, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose texts are not rejected, unchanged; filtered where they are read, without a shuffle, unless models are tables."""
    if isinstance(models, StoredModels):
        key = f"_row_{uuid.uuid4().hex}"
        rows = _keyed(docs, key)
        source = rows.select(F.col(key).alias("id"), F.col(key).alias("key"), F.col(text_col).alias("text"))
        rejected = _decided(source, models).where("rejected").select(F.col("id").alias(f"{key}_bad"))
        return rows.join(rejected, F.col(key) == F.col(f"{key}_bad"), "left_anti").drop(key)
    position = docs.columns.index(text_col)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(position)
            _, offsets = text_buffer(texts)
            for a, b in steps(offsets, 1 << 20):
                _, _, rejected = models.decide(*models.of_texts(texts.slice(a, b - a).to_pylist()))
                yield batch.slice(a, b - a).filter(pa.array(~rejected))

    return map_arrow(docs, walk, docs.schema)
