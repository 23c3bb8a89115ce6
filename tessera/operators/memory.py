"""Memory over conversation turns: pairs, context budgets, decay, similarity, conflicts, preloading, reconciliation, extraction."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..config import DecayConfig
from ..functions import text as T
from ..functions.arrays import let


def turn_pairs(turns: DataFrame, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """session, turn, user_text, assistant_text: each answer with the user turn right before it, other roles ignored."""
    talk = turns.where(F.col("role").isin("user", "assistant"))
    w = Window.partitionBy(session).orderBy(order)
    paired = talk.withColumn("_role", F.lag("role").over(w)).withColumn("user_text", F.lag("text").over(w))
    return paired.where("role = 'assistant' AND _role = 'user' AND user_text <> ''").select(session, order, "user_text", F.col("text").alias("assistant_text"))


def context(pairs: DataFrame, most_turns: int = 8, most_chars: int = 3000, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """One block of text per session: its last turns, oldest first, as many as fit from the newest back.

    The first turn that doesn't fit ends the block. If even the newest doesn't fit, its tail is taken.
    """
    newest = Window.partitionBy(session).orderBy(F.desc(order))
    recent = pairs.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= most_turns)
    recent = recent.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(session))).withColumn("_index", F.col("_n") - F.col("_back") + 1)
    block = F.concat(F.lit("[Turno "), F.col("_index").cast("string"), F.lit("]\nUsuario: "), F.col("user_text"), F.lit("\nAssistente: "), F.col("assistant_text"))
    recent = recent.withColumn("_block", block)
    running = F.sum(F.length("_block") + F.when(F.col("_back") > 1, 2).otherwise(0)).over(newest)
    # the running sum only grows, so what fits is a prefix
    sized = recent.withColumn("_fits", running <= most_chars)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_fits"), F.struct("_index", "_block")))), lambda x: x["_block"]), "\n\n")
    tail = F.max(F.when(F.col("_back") == 1, F.expr(f"right(_block, {most_chars})")))
    return sized.groupBy(session).agg(F.when(F.count_if("_fits") > 0, joined).otherwise(tail).alias("context"), F.count_if("_fits").alias("turns_used"))


def first_turns(turns: DataFrame, most: int = 20, session: str = "conv_id", order: tuple[str, ...] = ("turn", "role")) -> DataFrame:
    """The first ``most`` turns of every session, numbered from 1 (n long); rows that tie in ``order`` are numbered in any order.

    Spark limits each session in the tasks that read it, so a session of very many turns isn't gathered whole.
    """
    w = Window.partitionBy(session).orderBy(*[F.asc_nulls_last(c) for c in order])
    return turns.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).withColumn("n", F.col("n").cast("long"))


def effective_confidence(confidence: Column, kind: Column, last: Column, reinforced: Column, now: Column, config: DecayConfig | None = None) -> Column:
    """Confidence after exponential decay since the last confirmation, raised by confirmations, within 0 and 1."""
    c = config or DecayConfig()
    name = F.lower(F.trim(kind))
    rate = F.when(name.isin("preference", "opinion"), c.preference).when(name.isin("convention", "decision"), c.convention).when(name.isin("fact", "profile"), c.fact).otherwise(c.convention)
    days = F.greatest(F.unix_micros(now) - F.unix_micros(last), F.lit(0)) / F.lit(86_400_000_000.0)
    raised = F.least(F.lit(1.0) + F.greatest(reinforced, F.lit(0)) * c.step, F.lit(c.cap))
    return F.greatest(F.lit(0.0), F.least(confidence * F.exp(-rate * days) * raised, F.lit(1.0)))


# Words that turn a statement round.
NEGATIONS = (" nao ", " não ", " never ", " not ", " dont ", " don't ", " sem ")


def negated(value: Column) -> Column:
    return T.contains_any(F.concat(F.lit(" "), F.lower(value), F.lit(" ")), NEGATIONS)


def conflict(existing: Column, new: Column, high: float = 0.60, medium: float = 0.30) -> Column:
    """contradiction, reinforcement, complement or independent, by shared words and negation."""
    medium = min(medium, high)

    def told(n: Column) -> Column:
        # of sets, the union is what both hold less what they share
        similarity = F.when((n["left"] == 0) | (n["right"] == 0), F.lit(0.0)).otherwise(n["common"] / (n["left"] + n["right"] - n["common"]))
        against = (n["common"] >= 2) & (negated(existing) != negated(new))
        return let(similarity, lambda s: F.when(s >= high, F.when(against, "contradiction").otherwise("reinforcement")).when(s >= medium, "complement").otherwise("independent"))

    # word sets are worked out once for all that is asked of them
    sets = F.struct(T.word_set(existing).alias("left"), T.word_set(new).alias("right"))
    sizes = lambda x: F.struct(F.size(x["left"]).alias("left"), F.size(x["right"]).alias("right"), F.size(F.array_intersect(x["left"], x["right"])).alias("common"))
    return let(let(sets, sizes), told)


def preload(entries: DataFrame, scope: list[str], most_entries: int = 20, most_tokens: int = 1500) -> DataFrame:
    """The entries to start a session with, per scope: best effective confidence first, then the most recent.

    An entry that would pass the token budget is skipped, the first never. Needs id, topic, value, effective,
    recent among the columns. Only the best 100 or five times ``most_entries`` of a scope are looked at, as the store's listing does,
    so the fold's array has a bound.
    """
    cost = T.token_estimate(F.concat_ws(": ", "topic", "value"))
    order = [F.desc("effective"), F.desc("recent"), F.asc("id")]
    listed = entries.withColumn("_listed", F.row_number().over(Window.partitionBy(*scope).orderBy(F.desc("recent"), "id"))).where(F.col("_listed") <= max(100, 5 * most_entries))
    ranked = listed.withColumn("_cost", cost).withColumn("_rank", F.row_number().over(Window.partitionBy(*scope).orderBy(*order)))
    grouped = ranked.groupBy(*scope).agg(F.array_sort(F.collect_list(F.struct("_rank", "id", "_cost"))).alias("_all"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<position:int,id:string,tokens:int>>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        n = F.size(acc["kept"])
        takes = (n < most_entries) & ((n == 0) | (acc["used"] + x["_cost"] <= most_tokens))
        row = F.struct((n + 1).alias("position"), x["id"].cast("string").alias("id"), x["_cost"].alias("tokens"))
        return F.struct((acc["used"] + F.when(takes, x["_cost"]).otherwise(0)).alias("used"), F.when(takes, F.array_append(acc["kept"], row)).otherwise(acc["kept"]).alias("kept"))

    return grouped.select(*scope, F.explode(F.aggregate("_all", start, step, lambda acc: acc["kept"])).alias("x")).select(*scope, "x.*")


def preload_lines(entries: DataFrame, scope: list[str]) -> DataFrame:
    line = F.format_string("- %s/%s: %s (effective_confidence=%.2f)", F.col("kind"), F.col("topic"), F.col("value"), F.col("effective"))
    return entries.groupBy(*scope).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))), lambda x: x["line"]), "\n").alias("block"))


def _within(isolation: dict[str, object]) -> Column:
    """Rows of one isolation; a null there asks for rows without a value."""
    out = F.lit(True)
    for name, value in isolation.items():
        out = out & F.col(name).eqNullSafe(F.lit(value))
    return out


def listed(entries: DataFrame, isolation: dict[str, object], term: str | None = None, most: int = 50, active_only: bool = True) -> DataFrame:
    """Entries of one isolation (the active ones) whose topic or value holds the term, the latest first."""
    out = (entries.where("active") if active_only else entries).where(_within(isolation))
    if term:
        like = f"%{term.lower()}%"
        out = out.where(F.lower("topic").like(like) | F.lower("value").like(like))
    return out.orderBy(F.desc("updated_at"), "id").limit(max(1, most))


def status(entries: DataFrame) -> DataFrame:
    """active, superseded (another entry names it as replaced) or disabled."""
    replaced = entries.where("supersedes_entry_id IS NOT NULL").select(F.col("supersedes_entry_id").alias("id")).distinct().withColumn("_replaced", F.lit(True))
    return entries.join(replaced, "id", "left").withColumn("status", F.when(F.col("active"), "active").when(F.col("_replaced"), "superseded").otherwise("disabled")).drop("_replaced")


#: Active entries of a topic that a statement is compared with, the latest updated first. One that falls behind so many others
#: stays active and is never compared again, as a topic's active entries don't become fewer.
MOST_ACTIVE = 40
ENTRY = "id long, value string, confidence double, times_reinforced long, active boolean, supersedes long"


@dataclass
class Entry:
    """What is remembered of a statement, with the number of the statement that changed it last."""

    id: int
    value: str
    confidence: float | None
    times_reinforced: int = 0
    active: bool = True
    supersedes: int | None = None
    updated: int = 0

    def words(self) -> set[str]:
        return {w for w in re.split(r"[^a-zA-Z0-9_]+", self.value.lower()) if w}

    def against(self) -> bool:
        return any(n in f" {self.value.lower()} " for n in NEGATIONS)


def take(live: list[Entry], seq: int, value: str | None, confidence: float | None, high: float = 0.60) -> tuple[list[Entry], list[Entry]]:
    """Folds a statement into the active entries of its topic (``live``, the latest updated first; changed in place).

    The most alike entry decides (the latest in ties): it is reinforced, or contradicted and superseded; else the statement is kept
    beside it. Returns the entries that changed, and those that left ``live``, which nothing changes any more.
    """
    new = Entry(seq, value or "", confidence, updated=seq)
    own, best, chosen = new.words(), -1.0, None
    for entry in live:
        other = entry.words()
        alike = len(own & other) / len(own | other) if own and other else 0.0
        if alike > best:
            best, chosen = alike, entry
    if chosen is not None and best >= high:
        live.remove(chosen)
        chosen.updated = seq
        if chosen.against() == new.against() or len(chosen.words() & own) < 2:
            chosen.times_reinforced += 1
            live.insert(0, chosen)
            return [chosen], []
        chosen.active = False
        new.supersedes = chosen.id
        live.insert(0, new)
        return [chosen, new], [chosen]
    live.insert(0, new)
    return [new], [live.pop()] if len(live) > MOST_ACTIVE else []


def reconcile(statements: DataFrame, scope: list[str], high: float = 0.60) -> DataFrame:
    """Statements (scope, seq, kind, topic, value, confidence) folded in order into entries, per scope, kind and topic (see ``take``).

    Entries: id (of the statement that made it), value, confidence, times_reinforced, active, supersedes. The fold depends on its
    order, so a key's statements pass through one task, but one by one: it holds ``MOST_ACTIVE`` entries whatever a key's
    history is, and an entry is given out when it leaves them. Statements without a value have no words and are kept.
    """
    keys = [*scope, "kind", "topic"]
    names = [*keys, *[x.split()[0] for x in ENTRY.split(", ")]]
    ordered = statements.select(*keys, "seq", "value", "confidence").repartition(*keys).sortWithinPartitions(*keys, "seq", "value")
    schema = ", ".join([f"`{k}` {statements.schema[k].dataType.simpleString()}" for k in keys] + [ENTRY])
    kinds = [f.dataType for f in ordered.select(*keys).schema]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [*[to_arrow_type(k) for k in kinds], pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.bool_(), pa.int64()]
        key, live, rows = None, [], []

        def give(entries: list[Entry]) -> None:
            rows.extend((*key, e.id, e.value, e.confidence, e.times_reinforced, e.active, e.supersedes) for e in entries)

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
            rows.clear()
            return made

        for part in batches:
            for *own, seq, value, confidence in zip(*[c.to_pylist() for c in part.columns], strict=True):
                if own != key:
                    give(live)
                    key, live = own, []
                give(take(live, seq, value, confidence, high)[1])
            if rows:
                yield batch()
        give(live)
        if rows:
            yield batch()

    return ordered.mapInArrow(walk, schema)


def latest(versions: DataFrame, keys: list[str]) -> DataFrame:
    """The last version of each entry of a stream's reconciliation (keys, entry, version), by partial aggregation."""
    columns = [x.split()[0] for x in ENTRY.split(", ") if not x.startswith("id ")]
    last = versions.groupBy(*keys, "id").agg(F.max_by(F.struct(*columns), "version").alias("_e"))
    return last.select(*keys, "id", "_e.*")


# What a user says about themselves and how, as kind, topic, confidence and pattern (group 1 the verb, group 2 the value).
STATEMENTS = (
    ("profile", "name", 0.95, r"\b(meu nome e|meu nome é|my name is)\s+([A-Za-zÀ-ÿ0-9_\- ]{2,80})\b"),
    ("preference", "language_preference", 0.80, r"\b(prefiro|odeio|detesto|i prefer|i hate)\s+([^.!?,]{1,80})(?=\s+(?:como linguagem|para linguagem|as a language|for language)|$)"),
    ("preference", "framework_preference", 0.79, r"\b(prefiro|odeio|detesto|gosto de|não gosto de|nao gosto de|i prefer|i hate|i love|i dislike)\s+([^.!?,]{1,80})(?=\s+(?:framework|library|lib|para api|for api|ao inves de|ao invés de|instead of)|$)"),
    ("preference", "state_management_preference", 0.78, r"\b(prefiro|odeio|detesto|i prefer|i hate)\s+([^.!?,]{1,80})(?=\s+(?:para estado|for state|state management)|$)"),
    ("preference", "state_management_preference", 0.78, r"\b(prefiro|odeio|detesto|i prefer|i hate)\s+(redux toolkit|redux|zustand|context api|context)\b"),
    ("convention", "naming_convention", 0.76, r"\b(use sempre|sempre uso|always use|i always use)\s+(camelcase|pascalcase|snake_case|kebab-case|[^.!?,]{1,60})(?=\s+(?:para nome|para nomear|for naming|nos nomes|in names)|$)"),
    ("convention", "testing_convention", 0.76, r"\b(uso|use|i use|i prefer)\s+(vitest|jest|pytest|rtl|react testing library|[^.!?,]{1,60})(?=\s+(?:para teste|para testes|for tests|for testing)|$)"),
    ("convention", "development_convention", 0.74, r"\b(nunca use|não use|nao use|never use|do not use|avoid)\s+([^.!?]{1,80})$"),
)
# Words of doubt, without accents, and names in their usual spelling.
DOUBTS = (" mas ", " porem ", " however ", " but ", " depends ", " depende ", " as vezes ", " sometimes ", " talvez ", " maybe ", " geralmente ", " usually ", " acho que ", " i think ", " pode ser ", " might ")
ALIASES = {
    "ts": "TypeScript", "typescript": "TypeScript", "js": "JavaScript", "javascript": "JavaScript", "node": "Node.js", "nodejs": "Node.js", "node.js": "Node.js", "react js": "React", "reactjs": "React",
    "nestjs": "NestJS", "nextjs": "Next.js", "vitest": "Vitest", "jest": "Jest", "rtl": "React Testing Library", "react testing library": "React Testing Library", "zustand": "Zustand",
    "redux toolkit": "Redux Toolkit", "redux": "Redux", "context api": "Context API", "context": "Context", "camelcase": "camelCase", "pascalcase": "PascalCase", "snake_case": "snake_case", "kebab-case": "kebab-case",
}
ACRONYMS = ("API", "SQL", "JWT", "REST", "TDD")


def usual(value: Column) -> Column:
    """A value trimmed of marks and in its usual spelling."""
    bare = F.btrim(T.collapsed(value), F.lit(" .,:;-'\"()[]{}"))
    names = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, T.plain_letters(bare)), F.when(F.upper(bare).isin(*ACRONYMS), F.upper(bare)).otherwise(bare))


def _matches(text: Column, order: int, kind: str, topic: str, confidence: float, pattern: str) -> Column:
    """One pattern's matches in a text with their places: a match starts after the gaps and matches before it."""
    whole = "(?iu)" + pattern
    found = [F.regexp_extract_all(text, F.lit(whole), F.lit(group)) for group in range(3)]
    gaps = F.transform(F.split(text, whole, -1), lambda x: F.length(x))
    sizes = F.transform(found[0], lambda x: F.length(x))
    total = lambda x: F.aggregate(x, F.lit(0), lambda acc, n: acc + n)

    def shaped(x: Column, i: Column) -> Column:
        start = total(F.slice(gaps, F.lit(1), i + 1)) + total(F.slice(sizes, F.lit(1), i))
        return F.struct(
            start.alias("start"), (start + F.length(x["whole"])).alias("end"), F.lit(confidence).alias("confidence"), (F.lit(order * 1000) + i).alias("order"),
            F.lit(kind).alias("kind"), F.lit(topic).alias("topic"), F.lower(x["verb"]).alias("verb"), x["whole"].alias("whole"), usual(x["raw"]).alias("value"),
        )

    return F.transform(F.arrays_zip(found[0].alias("whole"), found[1].alias("verb"), found[2].alias("raw")), shaped)


def _statements(text: Column) -> Column:
    """All patterns' matches in a text, in order of pattern and place."""
    return F.concat(*[_matches(text, n, *spec) for n, spec in enumerate(STATEMENTS)])


def extract(texts: DataFrame, least: float = 0.7) -> DataFrame:
    """id, start, end, kind, topic, value, stance, confidence, excerpt: what users state about themselves.

    White space is collapsed first; texts over 500 characters give nothing. Values over 120 characters, with two
    commas or words of doubt are dropped. Of equal statements the surest stays, of overlapping ones the first, then
    the longest, then the surest. All of it happens within a text's row.
    """
    said = texts.withColumn("_said", T.collapsed(F.col("text"))).where(F.length("_said").between(1, 500)).withColumn("_all", _statements(F.col("_said")))
    avoids = ("odeio", "detesto", "i hate")
    dislikes = (*avoids, "não gosto de", "nao gosto de", "i dislike")

    def sound(x: Column) -> Column:
        doubt = T.contains_any(F.concat(F.lit(" "), T.plain_letters(x["value"]), F.lit(" ")), DOUBTS)
        return (x["value"] != "") & (F.length(x["value"]) <= 120) & ~doubt & (F.length(x["value"]) - F.length(F.replace(x["value"], F.lit(","), F.lit(""))) < 2)

    def shaped(x: Column) -> Column:
        against = F.when(x["topic"] == "framework_preference", x["verb"].isin(*dislikes)).otherwise(x["verb"].isin(*avoids))
        stance = F.when(x["kind"] == "profile", "identity").when(x["topic"] == "development_convention", "avoid").when(x["kind"] == "convention", "require").when(against, "avoid").otherwise("prefer")
        return F.struct(
            x["start"].alias("start"), (x["start"] - x["end"]).alias("shorter"), (-F.floor(x["confidence"] * 100)).alias("unsure"), x["order"].alias("order"), x["end"].alias("end"),
            x["kind"].alias("kind"), x["topic"].alias("topic"), x["value"].alias("value"), stance.alias("stance"), x["confidence"].alias("confidence"), x["whole"].alias("whole"),
        )

    rows = said.withColumn("_all", F.transform(F.filter("_all", sound), shaped))
    same = lambda x, y: (x["kind"] == y["kind"]) & (x["topic"] == y["topic"]) & (x["stance"] == y["stance"]) & (T.plain_letters(x["value"]) == T.plain_letters(y["value"]))
    better = lambda y, x: (y["confidence"] > x["confidence"]) | ((y["confidence"] == x["confidence"]) & (y["order"] < x["order"]))
    rows = rows.withColumn("_all", F.array_sort(F.filter("_all", lambda x: ~F.exists("_all", lambda y: same(x, y) & better(y, x)))))
    apart = lambda x, y: (x["end"] <= y["start"]) | (x["start"] >= y["end"])
    kept = F.aggregate("_all", F.slice("_all", 1, 0), lambda acc, x: F.when(F.forall(acc, lambda y: apart(x, y)), F.array_append(acc, x)).otherwise(acc))
    out = rows.select("id", F.explode(kept).alias("x")).where(F.col("x.confidence") >= least)
    excerpt = F.when(F.length("x.whole") > 160, F.concat(F.substring("x.whole", 1, 159), F.lit("…"))).otherwise(F.col("x.whole"))
    return out.select("id", *[F.col(f"x.{c}").alias(c) for c in ("start", "end", "kind", "topic", "value", "stance", "confidence")], excerpt.alias("excerpt"))


def disable(entries: DataFrame, where: Column, now: Column, reason: str) -> DataFrame:
    """Active entries for which ``where`` holds become inactive; a time set before stays."""
    hit = F.col("active") & where
    return entries.withColumns({"active": F.col("active") & ~hit, "disabled_at": F.when(hit, F.coalesce("disabled_at", now)).otherwise(F.col("disabled_at")), "disabled_reason": F.when(hit, F.lit(reason)).otherwise(F.col("disabled_reason")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))})


#: Entries that one call to forget puts off at most, the latest first; a second call goes on with the others.
MOST_FORGOTTEN = 200
#: Entries that an explanation shows.
MOST_EXPLAINED = 20
_ID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


def forget(entries: DataFrame, isolation: dict[str, object], term: str, now: Column) -> DataFrame:
    """Active entries of one isolation that hold the term become inactive, the latest ``MOST_FORGOTTEN`` at most; all rows come back."""
    hits = F.broadcast(listed(entries, isolation, term, MOST_FORGOTTEN).select("id").distinct().withColumn("_hit", F.lit(True)))
    return disable(entries.join(hits, "id", "left"), F.coalesce("_hit", F.lit(False)) & _within(isolation), now, "manual_forget").drop("_hit")


def clear(entries: DataFrame, isolation: dict[str, object], now: Column) -> DataFrame:
    """All active entries of one isolation become inactive."""
    return disable(entries, _within(isolation), now, "manual_clear")


def explain(entries: DataFrame, isolation: dict[str, object], selector: str, now: Column, by_id: bool | None = None, config: DecayConfig | None = None) -> DataFrame:
    """Why an entry is remembered: entries of one isolation, active or not, with status and effective_confidence.

    A selector that is an id (told by its form unless ``by_id`` says) picks that entry, any other the latest ``MOST_EXPLAINED``
    whose topic or value holds it; a blank one nothing. Needs kind, confidence, last_confirmed_at, times_reinforced and
    supersedes_entry_id among the columns. Status looks at the isolation's entries alone.
    """
    wanted = selector.strip()
    own = entries.where(_within(isolation))
    if not wanted:
        picked = own.limit(0)
    elif by_id if by_id is not None else _ID.fullmatch(wanted) is not None:
        picked = own.where(F.col("id").cast("string") == wanted)
    else:
        picked = listed(entries, isolation, wanted, MOST_EXPLAINED, active_only=False)
    replaced = own.where("supersedes_entry_id IS NOT NULL").select(F.col("supersedes_entry_id").alias("id")).distinct().withColumn("_replaced", F.lit(True))
    told = F.when(F.col("active"), "active").when(F.col("_replaced"), "superseded").otherwise("disabled")
    sure = effective_confidence(F.col("confidence"), F.col("kind"), F.col("last_confirmed_at"), F.col("times_reinforced"), now, config)
    return picked.join(replaced, "id", "left").withColumns({"status": told, "effective_confidence": sure}).drop("_replaced")


def supersede(entries: DataFrame, old_id: object, now: Column, reason: str = "semantic_contradiction") -> DataFrame:
    """An active entry gives way to another one; its time is set anew."""
    hit = F.col("active") & (F.col("id") == old_id)
    return entries.withColumns({"active": F.col("active") & ~hit, "disabled_at": F.when(hit, now).otherwise(F.col("disabled_at")), "disabled_reason": F.when(hit, F.lit(reason)).otherwise(F.col("disabled_reason")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))})


def confirm(entries: DataFrame, where: Column, now: Column) -> DataFrame:
    """Entries, active or not, are confirmed once more."""
    return entries.withColumns({"times_reinforced": F.col("times_reinforced") + F.when(where, 1).otherwise(0), "last_confirmed_at": F.when(where, now).otherwise(F.col("last_confirmed_at")), "updated_at": F.when(where, now).otherwise(F.col("updated_at"))})


def value_hash(value: Column) -> Column:
    """Identity of a value, whatever its case and white space."""
    return F.sha2(F.lower(T.collapsed(value)).cast("binary"), 256)


def user_key(tenant: Column, user: Column) -> Column:
    return F.sha2(F.concat_ws(":", tenant, user).cast("binary"), 256)
