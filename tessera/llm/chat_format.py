"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted, and merged where neighbours share a role; blocks are
concatenated into one string:

    <|open|>role<|text|>first text<|part|>second text of the same role<|close|>

Reversible: inside roles and texts ``&`` becomes ``&amp;`` and ``<`` becomes ``&lt;``, so that no text can hold a
control string (all of them start with ``<``), whatever it says. ``loss`` lists the spans of the formatted string
(code points, end exclusive) that a model is trained on: each text of a loss-bearing role.

Null texts and roles count as empty. Repeated rows of a turn are turns of their own, ordered by turn, role and
text; null turns come first. The work is linear in a conversation's turns. A conversation with many turns is one output string, so it is held whole; nothing
else is. An empty table gives an empty result, and other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .expressions import let, totals_before

OPEN, TEXT, PART, CLOSE = "<|open|>", "<|text|>", "<|part|>", "<|close|>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss (array of start, end)."""
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    # adjacent turns of one role become one block with an array of texts: a block ends where the next one opens
    def merged(turns: Column) -> Column:
        opens = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: ~F.coalesce(F.get(turns, i - 1)["role"] == F.get(turns, i)["role"], F.lit(False)))
        own = lambda starts, s, k: F.slice(turns, s + 1, F.coalesce(F.get(starts, k + 1), F.size(turns)) - s)
        return let(opens, lambda starts: F.transform(starts, lambda s, k: F.struct(F.get(turns, s)["role"].alias("role"), F.transform(own(starts, s, k), lambda t: escaped(t["text"])).alias("texts"))))

    chats = chats.select("conv_id", let(F.col("turns"), merged).alias("blocks"))
    shown = F.transform("blocks", lambda b: F.concat(F.lit(OPEN), escaped(b["role"]), F.lit(TEXT), F.array_join(b["texts"], PART), F.lit(CLOSE)))

    # where each text starts: the total of what stands before
    pieces = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.transform(
                b["texts"],
                lambda x, i: F.struct(
                    F.when(i == 0, F.length(escaped(b["role"])) + len(OPEN) + len(TEXT)).otherwise(F.lit(len(PART))).alias("lead"),
                    F.length(x).alias("size"),
                    F.when(i == F.size(b["texts"]) - 1, F.lit(len(CLOSE))).otherwise(F.lit(0)).alias("trail"),
                    b["role"].isin(*loss_roles).alias("loss"),
                ),
            ),
        )
    )

    def spans(pieces: Column) -> Column:
        before = totals_before(F.transform(pieces, lambda p: p["lead"] + p["size"] + p["trail"]))
        bearing = F.filter(F.arrays_zip(pieces.alias("piece"), before.alias("at")), lambda x: x["piece"]["loss"])
        start = lambda x: x["at"] + x["piece"]["lead"]
        return F.transform(bearing, lambda x: F.struct(start(x).alias("start"), (start(x) + x["piece"]["size"]).alias("end")))

    return chats.select("conv_id", F.array_join(shown, "").alias("formatted"), let(pieces, spans).alias("loss"))


def parse_chats(chats: DataFrame) -> DataFrame:
    """Back from ``formatted``: conv_id, turns (array of role, text), loss_text."""
    blocks = F.filter(F.split("formatted", r"<\|open\|>", -1), lambda x: x != "")
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substring_index(F.replace(b, F.lit(CLOSE), F.lit("")), TEXT, -1), r"<\|part\|>", -1),
                lambda x: F.struct(unescaped(F.substring_index(b, TEXT, 1)).alias("role"), unescaped(x).alias("text")),
            ),
        )
    )
    loss = F.array_join(F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    return chats.select("*", turns.alias("turns"), loss.alias("loss_text"))


def chat_digests(chats: DataFrame) -> DataFrame:
    """Digests of what is read back from the formatted strings."""
    shown = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parse_chats(chats).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(shown.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
