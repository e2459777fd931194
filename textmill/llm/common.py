"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions.storage import checkpoint, checkpoint_folder, remove

__all__ = ["ASCII_SPACE", "BROADCAST_ROWS", "checkpoint", "small", "table", "text_or_empty", "without_ids", "written"]

#: Rows of a key list that may be broadcast: at 16 bytes a key this is 8 MB.
BROADCAST_ROWS = 500_000

#: The white space that the contracts name: [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the cluster's shared folder, packed tightly and deleted when
    Python ends."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    atexit.register(remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def small(keys: DataFrame, rows: int | None = None) -> DataFrame:
    """Mark ``keys`` for a broadcast if a count proves it small; else leave the join to shuffle."""
    limit = BROADCAST_ROWS if rows is None else rows
    return F.broadcast(keys) if keys.limit(limit + 1).count() <= limit else keys


def without_ids(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id isn't in ``dropped``; a null id is compared as a value."""
    gone = dropped.select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(small(gone), docs[id_col].eqNullSafe(F.col("_gone")), "left_anti")


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
