"""Answers of a service, kept in a table, so that each question is asked once.

A question is known by the hash of all that its answer depends on. What the table doesn't have
yet is asked, each question once, and written before anybody reads it: an answer that a lost
executor would have to ask for again, and might get otherwise, comes from the table. Failed
requests (null answers) aren't kept and are asked again the next time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

from textmill.functions.providers import Embedder


@dataclass(frozen=True)
class Answers:
    """A table of (question, answer) in a folder that all executors share: a folder within it for
    each writing, which counts when it is complete."""

    folder: str
    kind: DataType = StringType()

    def _table(self, like: DataFrame) -> DataFrame:
        spark = like.sparkSession
        sc = spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path
        fs = path(self.folder).getFileSystem(sc._jsc.hadoopConfiguration())
        # Folders by name: Spark takes two readings of one folder for the same, whatever was added between them.
        found = fs.listStatus(path(self.folder)) if fs.exists(path(self.folder)) else []
        whole = [f.getPath().toString() for f in found if fs.exists(path(f.getPath(), "_SUCCESS"))]
        schema = StructType([StructField("_question", StringType()), StructField("_answer", self.kind)])
        return spark.read.schema(schema).parquet(*whole) if whole else spark.createDataFrame([], schema)

    def answered(self, rows: DataFrame, parts: list[Column], ask: Callable[[DataFrame], Column], when: Column) -> DataFrame:
        """``rows`` with ``_answer``, null where ``when`` isn't true or the request failed.

        ``parts`` is what a question's answer depends on; ``ask`` makes the answer of its columns.
        """
        digest = F.sha2(F.concat_ws("\x1f", *[F.sha2(F.coalesce(p.cast("string"), F.lit("")), 256) for p in parts]), 256)
        keyed = rows.withColumn("_question", F.when(when, digest))
        new = keyed.where("_question IS NOT NULL").join(self._table(rows).select("_question"), "_question", "left_anti").dropDuplicates(["_question"])
        new.select("_question", ask(new).alias("_answer")).where("_answer IS NOT NULL").write.parquet(f"{self.folder}/{uuid.uuid4().hex}")
        # A question that two writers asked has one answer all the same.
        known = self._table(rows).groupBy("_question").agg(F.min("_answer").alias("_answer"))
        return keyed.join(known, "_question", "left").drop("_question")


@dataclass(frozen=True)
class StoredEmbedder:
    """An embedder whose vectors are kept by the hash of their text: a text that was embedded
    before, in this run or an earlier one, isn't sent again."""

    embedder: Embedder
    folder: str

    @property
    def name(self) -> str:
        return self.embedder.name

    @property
    def dimensions(self) -> int:
        return self.embedder.dimensions

    def embed(self, text: Column) -> Column:
        return self.embedder.embed(text)
