"""Secret scans with Spark expressions only: fixed patterns plus sliding-window entropy.

Spans are (kind, start, end) in code points, end exclusive. Three base kinds come from patterns; the kind
``entropy`` adds candidate strings of which some window looks random:

* base spans and harmless strings (the allow-list: UUIDs and placeholder words) are blanked first, so that neither
  silences what stands beside it;
* a candidate is a longest run of ``[A-Za-z0-9+/_=-]`` of 20 characters or more in what is left;
* every window of 20 characters is scored by the Shannon entropy of its characters, kept up to date from the
  counts of the window before (one character leaves, one enters). Counts of character classes are kept the same
  way, and a window is judged by the narrowest class that holds all its characters: hexadecimal, letters of one case
  and digits, letters and digits, or base64;
* a candidate is a span if some window with a digit and a letter reaches its class's limit, unless the candidate
  is made of words with at most four digits behind each (the allow-list again).

The work is linear in a text's length, however long its candidates and however many its spans. Null texts count as
empty, and every text is scanned whole. Null ids are kept as rows. Rows that repeat give repeated results. An empty
table gives an empty result, and other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .expressions import let, totals_before

# The base patterns and their least lengths.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Bits a character that a window of 20 must reach, by class: about what 99 of 100 uniformly random windows reach.
LIMITS = {"hexadecimal": 2.9, "one case": 3.4, "two cases": 3.64, "base64": 3.68}
#: Harmless strings that look random or stand in for a secret.
HARMLESS = r"(?<![0-9A-Za-z])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![0-9A-Za-z])|(?i:example|placeholder|changeme|xxxx|abcdefgh|0123456789)"
#: Words, each with at most four digits behind it. Possessive, so that long candidates are read once.
WORDS = r"(?:[A-Za-z]++[0-9]{0,4}+[+/_=-]++)*+[A-Za-z]*+[0-9]{0,4}+"


def _pieces(text: Column, pattern: str, group: int, keep) -> Column:
    """The text as an array of gap (before a match), match (null at the end) and kept (``keep`` of the match's group)."""
    gaps = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kept = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), keep)
    return F.arrays_zip(gaps.alias("gap"), whole.alias("match"), kept.alias("kept"))


def _spans(text: Column, pattern: str, kind: str, rank: int, group: int, keep) -> Column:
    """Spans of the matches of which ``keep`` (of the group's text) holds; places follow from the lengths of gaps and matches."""

    def placed(pieces: Column) -> Column:
        sizes = F.transform(pieces, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["match"]), F.lit(0)))
        wanted = F.filter(F.arrays_zip(pieces.alias("piece"), totals_before(sizes).alias("at")), lambda x: F.coalesce(x["piece"]["kept"], F.lit(False)))
        start = lambda x: x["at"] + F.length(x["piece"]["gap"])
        return F.transform(wanted, lambda x: F.struct(start(x).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (start(x) + F.length(x["piece"]["match"])).alias("end")))

    return let(_pieces(text, pattern, group, keep), placed)


def _none() -> Column:
    return F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")


def _blanked(text: Column, pattern: str, group: int, keep) -> Column:
    """The text with the matches of which ``keep`` holds as blanks, so that all places stay."""
    shown = lambda x: F.when(F.coalesce(x["kept"], F.lit(False)), F.repeat(F.lit(" "), F.length(x["match"]))).otherwise(F.coalesce(x["match"], F.lit("")))
    return F.array_join(F.transform(_pieces(text, pattern, group, keep), lambda x: F.concat(x["gap"], shown(x))), "")


#: What is counted in a window besides its characters, of a character's place in the alphabet.
_CLASSES = {
    "upper": lambda c: c <= 26,
    "lower": lambda c: (c > 26) & (c <= 52),
    "beyond": lambda c: c.between(7, 26) | c.between(33, 52),
    "digits": lambda c: c.between(53, 62),
    "marks": lambda c: c > 62,
}


def _looks_random(run: Column) -> Column:
    """Whether some window of a run reaches its class's entropy; each step changes two counts."""
    # sum of n log2 n over the counts; the entropy is log2 of the window minus this over the window
    weight = lambda n: F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))
    most = lambda name: F.lit(WINDOW * (math.log2(WINDOW) - LIMITS[name]) + 1e-9)

    def random(s: Column) -> Column:
        limit = F.when(s["marks"] > 0, most("base64")).when((s["upper"] > 0) & (s["lower"] > 0), most("two cases")).when(s["beyond"] > 0, most("one case")).otherwise(most("hexadecimal"))
        return (s["digits"] > 0) & (s["upper"] + s["lower"] > 0) & (s["sum"] <= limit)

    def changed(counts: Column, code: Column, by: int) -> Column:
        return F.concat(F.slice(counts, F.lit(1), code - 1), F.array(F.element_at(counts, code) + by), F.slice(counts, code + 1, F.lit(len(ALPHABET))))

    def slide(acc: Column, pair: Column) -> Column:
        last = acc["last"]
        out_n, in_n = F.element_at(last["counts"], pair["out"]), F.element_at(last["counts"], pair["in"])
        total = last["sum"] + F.when(pair["out"] == pair["in"], F.lit(0.0)).otherwise(weight(out_n - 1) - weight(out_n) + weight(in_n + 1) - weight(in_n))
        classes = [(last[k] - is_(pair["out"]).cast("int") + is_(pair["in"]).cast("int")).alias(k) for k, is_ in _CLASSES.items()]
        now = F.struct(changed(changed(last["counts"], pair["out"], -1), pair["in"], 1).alias("counts"), total.alias("sum"), *classes)
        # a run that was found random needs no further steps
        return F.when(acc["found"], acc).otherwise(let(now, lambda s: F.struct(s.alias("last"), random(s).alias("found"))))

    def walked(codes: Column) -> Column:
        first = F.slice(codes, 1, WINDOW)
        counts = F.transform(F.sequence(F.lit(1), F.lit(len(ALPHABET))), lambda k: F.size(F.filter(first, lambda c: c == k)))
        classes = [F.size(F.filter(first, is_)).alias(k) for k, is_ in _CLASSES.items()]
        start = let(F.struct(counts.alias("counts"), F.aggregate(counts, F.lit(0.0), lambda s, n: s + weight(n)).alias("sum"), *classes), lambda s: F.struct(s.alias("last"), random(s).alias("found")))
        steps = F.transform(F.sequence(F.lit(1), F.size(codes) - WINDOW), lambda i: F.struct(F.element_at(codes, i).alias("out"), F.element_at(codes, i + WINDOW).alias("in")))
        steps = F.when(F.size(codes) > WINDOW, steps).otherwise(F.array().cast("array<struct<out:int,in:int>>"))
        return F.aggregate(steps, start, slide, lambda acc: acc["found"])

    return let(F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c)), walked)


def _random(run: Column) -> Column:
    mixed = run.rlike("[0-9]") & run.rlike("[A-Za-z]")
    return F.when(mixed & ~run.rlike(f"^(?:{WORDS})$"), _looks_random(run)).otherwise(F.lit(False))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base, added: arrays of start, rank, kind, end, each by start, then kind as listed."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    # a text without any of these four needs no further look; most have none
    maybe = text.rlike(r"[:=]") & text.rlike(ASSIGN)
    hexes = text.rlike(r"[0-9a-f]{16}")
    long = lambda kind: lambda x: F.length(x) >= LEAST[kind]
    # runs are longest by nature, so one of 16 or more starts where the pattern with + starts
    kinds = {"assign": (maybe, ASSIGN, 1), "access": (text.contains("AKIA"), ACCESS, 0), "hex": (hexes, HEX[:-1] + "{16,}", 0)}
    base = [F.when(there, _spans(text, pattern, kind, rank, group, long(kind))).otherwise(_none()) for rank, (kind, (there, pattern, group)) in enumerate(kinds.items())]
    rest = text
    for kind, (there, pattern, group) in kinds.items():
        rest = F.when(there, _blanked(rest, pattern, group, long(kind))).otherwise(rest)
    rest = _blanked(rest, HARMLESS, 0, lambda x: F.lit(True))
    added = F.when(text.rlike(CANDIDATE), let(rest, lambda t: _spans(t, CANDIDATE, "entropy", 3, 0, _random))).otherwise(_none())
    return rows.withColumn("base", F.array_sort(F.concat(*base))).withColumn("added", added).select("id", "base", "added")


def secret_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts by kind, the digest of the base spans, and all spans as text."""
    shown = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_secrets(docs, id_col, text_col).select(
        F.col("id").alias("doc_id"),
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(shown(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        shown(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_entropy"),
    )
