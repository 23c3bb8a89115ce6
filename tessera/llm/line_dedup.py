"""Line dedup: boilerplate lines that spread over many sites are removed, all but their first occurrence.

A line is a piece of a text between line feeds, compared without the spaces (U+0020) at its ends; lines of spaces
alone are never removed. A line's spread is its number of distinct sites. Tasks sketch the sites of the lines they
read (HyperLogLog) and the sketches are merged per line hash; only for lines whose estimate lies within ``margin`` of
the threshold are distinct sites told apart and counted. Lines that reach
``min_sites`` stay only where they occur first (smallest document, then position), so their content is kept once.

Null texts count as empty, null sites as one site of their own. Rows that share an id keep their own texts: lines
are addressed by a key of id, site and text, and rows equal in all three are treated alike. An empty table gives an empty
result. Columns other than the three named pass through ``drop_boilerplate`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpointed
from .expressions import let

#: HyperLogLog precision: 2^11 registers, about 2 % error, and exact in practice for a few hundred sites.
LOG_REGISTERS = 11


def _key(id_col: str, text_col: str, site_col: str) -> Column:
    """One long for a row's identity; the text's hash tells rows with one id apart."""
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(site_col).cast("string"), F.lit("")), F.col(site_col).isNull(), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))


def lines_of(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """id, key, site, at (position), line (hash of the trimmed line); blank lines are left out."""
    pieces = docs.select(
        F.col(id_col).alias("id"),
        _key(id_col, text_col, site_col).alias("key"),
        F.coalesce(F.xxhash64(F.col(site_col).cast("string")), F.lit(0)).alias("site"),
        F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n", -1)).alias("at", "piece"),
    )
    return pieces.select("id", "key", "site", "at", F.trim("piece").alias("piece")).where("piece <> ''").select("id", "key", "site", "at", F.xxhash64("piece").alias("line"))


def spread_lines(lines: DataFrame, min_sites: int, margin: float = 0.15) -> DataFrame:
    """line for the lines on ``min_sites`` sites or more: sketches first, exact counts near the threshold."""
    # a line of a hot site is one sketch a task, so nothing but sketches is shuffled for most lines
    sketched = checkpointed(lines.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(LOG_REGISTERS)).alias("sketch")).select("line", F.hll_sketch_estimate("sketch").alias("estimate")).where(F.col("estimate") >= min_sites * (1 - margin)))
    sure = sketched.where(F.col("estimate") > min_sites * (1 + margin)).select("line")
    near = sketched.where(F.col("estimate") <= min_sites * (1 + margin)).select("line")
    sites = lines.join(near, "line").groupBy("line", "site").agg(F.count(F.lit(1)).alias("_n"))
    exact = sites.groupBy("line").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites).select("line")
    return sure.unionByName(exact)


def boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 10, margin: float = 0.15) -> DataFrame:
    """key, drop (positions to remove) for each row that loses lines.

    A line with fewer than ``min_sites`` occurrences can't reach so many sites, so only the others are carried
    on; they are written to the shared folder once and read for sketches, exact counts and first occurrences.
    """
    lines = lines_of(docs, id_col, text_col, site_col)
    # stored, so that the join is between two exchanges (or a broadcast, by true size) and a hot line can be split
    often = checkpointed(lines.groupBy("line").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_sites).select("line"))
    lines = checkpointed(lines.join(often, "line"))
    # first occurrences come from a partial aggregate over the stored lines; the few wide lines are stored too, and the
    # join below feeds an exchange by another key, so Spark can split a line that a third of all documents share
    first = lines.groupBy("line").agg(F.min(F.struct("id", "at", "key")).alias("first"))
    wide = checkpointed(spread_lines(lines, min_sites, margin).join(first, "line"))
    gone = lines.join(wide, "line").where(~((F.col("key") == F.col("first.key")) & (F.col("at") == F.col("first.at"))))
    return gone.groupBy("key").agg(F.collect_set("at").alias("drop"))


def drop_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 10, margin: float = 0.15) -> DataFrame:
    """The rows of ``docs`` with boilerplate lines taken out of their texts, and n_lines and n_removed added.

    A text without such lines is unchanged, null included. Columns named n_lines or n_removed are replaced.
    """
    gone = boilerplate(docs, id_col, text_col, site_col, min_sites, margin)
    # the row travels as one struct, so that no name of its columns can clash
    rows = docs.select(F.struct("*").alias("row"), _key(id_col, text_col, site_col).alias("key")).join(gone, "key", "left")
    text = F.col("row").getField(text_col)
    pieces = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    # the positions that stay come from a set difference, so many lines with many removals cost their sum
    stay = lambda p: F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col("drop"))
    left = let(pieces, lambda p: F.array_join(F.transform(stay(p), lambda i: F.get(p, i)), "\n"))
    new = {
        text_col: F.when(F.col("drop").isNull(), text).otherwise(left),
        "n_lines": F.size(pieces).cast("long"),
        "n_removed": F.coalesce(F.size("drop"), F.lit(0)).cast("long"),
    }
    names = list(dict.fromkeys([*docs.columns, *new]))
    return rows.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in names])
