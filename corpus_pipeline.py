"""The corpus pipeline: five stages from raw documents to packed token sequences.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next
stage's documents. Stages that filter keep all columns of their input; texts that a stage changes stay changed.
Stages that filter judge each row by itself, whether its id is null, repeated or neither.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import decontaminate, jaccard_join, language_id, line_dedup, packing
from tessera.llm.common import checkpointed, shared_folder, table
from tessera.llm.queries_common import held_out, tokenizer_path

def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects go: those without letters, and those unlike every learnt language, by limits from all training rows."""
    models = language_id.fit(docs.where(~F.coalesce(held_out(), F.lit(True))))
    return language_id.keep_known(docs, models)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that spread over many sources stay at their first occurrence only; n_chars follows the text.

    A document that loses every line goes: all it said stands where it occurred first. Documents that were
    empty before stay.
    """
    # columns of these names would be replaced by the operator's own
    aside = {c: f"_own_{c}" for c in ("n_lines", "n_removed") if c in docs.columns}
    found = line_dedup.drop_boilerplate(docs.withColumnsRenamed(aside))
    left = found.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return left.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, the one with the smallest id (null last), then row key.

    Rows are told by a key of their own, so repeated ids and null ids are judged by their own text.
    """
    # stored, so that a row keeps its key however often it is read; columns of the input can't clash with it
    key = f"_row_{uuid.uuid4().hex}"
    rows = checkpointed(docs.withColumn(key, F.monotonically_increasing_id()))
    classes = jaccard_join.near_duplicates(rows, key).select(F.col("doc_id").alias("_key"), "class_id")
    several = checkpointed(classes.join(rows.select(F.col(key).alias("_key"), F.col("doc_id").alias("_id")), "_key"))
    order = F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_key"))
    # stored, so that the join is between exchanges and a class of very many rows can be split
    first = checkpointed(several.groupBy("class_id").agg(F.min(order)["_key"].alias("_first")))
    gone = several.join(first, "class_id").where("_key <> _first").select(F.col("_key").alias(f"{key}_gone"))
    return rows.join(gone, F.col(key) == F.col(f"{key}_gone"), "left_anti").drop(key)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item's words go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids' digests."""
    return packing.piece_digests(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Learnt models, sketches and tokenisation are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{n}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
