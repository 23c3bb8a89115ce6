"""Text match on paths through an inverted index: each token has bitmaps of the points whose path holds it.

A path's tokens are its longest runs of letters and digits, lower-cased. The index is a table (token, bucket, bits), built by
partial aggregation: bits of points whose numbers share a bucket of 32,768. A match of several tokens is the conjunction of
their bitmaps, bucket by bucket, so a filter on paths reads rows of the index and never a path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def tokens(path: Column) -> Column:
    """The distinct tokens of a path; none for null."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(path, F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda x: x != ""))


def index(points: DataFrame, id_col: str = "id", path_col: str = "path") -> DataFrame:
    """token, bucket, bits of ``points``; ids are numbers, those of points without a path or an id have no row."""
    rows = points.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.explode(tokens(F.col(path_col))).alias("token"))
    return rows.groupBy("token", F.bitmap_bucket_number("_id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_id")).alias("bits"))


def matched(found: DataFrame, text: str) -> DataFrame:
    """bucket, bits of the points whose path holds every token of ``text``; a text without tokens matches nothing."""
    wanted = sorted({x for x in "".join(c if c.isalnum() else " " for c in text.lower()).split()})
    rows = found.where(F.col("token").isin(wanted)) if wanted else found.limit(0)
    both = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"), F.bitmap_and_agg("bits").alias("bits"))
    return both.where(F.col("_n") == len(wanted)).select("bucket", "bits")


def holds(points: DataFrame, match: DataFrame, id_col: str = "id") -> DataFrame:
    """The rows of ``points`` whose number is in a match. The match has a row for each bucket that holds one, 4 KB each."""
    bit = F.bitmap_bit_position(F.col(id_col).cast("long"))
    byte = F.conv(F.hex(F.substring("bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = points.join(match, F.bitmap_bucket_number(F.col(id_col).cast("long")) == F.col("bucket"))
    return met.where(F.shiftrightunsigned(byte, 0).bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (bit % 8 + 1).cast("int"))) != 0).drop("bucket", "bits")
