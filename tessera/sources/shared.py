"""Where intermediate tables go: a folder that driver and executors share; and how rows go to Python inside tasks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def folder(spark: SparkSession) -> str:
    """The application's folder in spark.checkpoint.dir, or a local one where that is unset and all runs on this machine (as in tests).

    On a cluster an unset folder is an error, as each machine would write its own disk.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tessera-"))
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back: computed once, without lineage."""
    path = f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with batches of about 4 MB, unless the session says otherwise: 10,000 long texts would be far more."""
    spark = df.sparkSession
    if spark.sparkContext.getConf().get(BATCH_BYTES) is None:
        spark.conf.set(BATCH_BYTES, str(4 << 20))
    return df.mapInArrow(kernel, schema)
