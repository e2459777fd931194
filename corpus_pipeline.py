"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns what it kept with the columns of
``documents``; the last returns the packed pieces. ``run`` writes each stage as Parquet in
the cluster's checkpoint folder and reads it again for the next.

A stage decides by doc_id. Where rows of its input repeat a doc_id, the row that an
operator keeps stands for all of them: they stay or go together, but for rows that are
equal in id and text, of which one stays.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions.storage import checkpoint_folder, remove
from textmill.llm.common import checkpoint, without_ids
from textmill.llm.exact_dedup import exact_dedup
from textmill.llm.language_id import fit_language_model, keep_identified, remainder
from textmill.llm.packing import pack_documents
from textmill.llm.simhash import near_duplicates

#: A document goes if no language is told from it, or none with this score at least.
MIN_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; the model learns from the labelled rows of the stage's input."""
    model = fit_language_model(docs.where(remainder("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    return keep_identified(docs, model, MIN_SCORE)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    found = checkpoint(exact_dedup(docs).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("kept").alias("kept")))
    rest = without_ids(docs, found.where(~F.col("kept")).select("doc_id"))
    repeated = found.where("kept AND n > 1").select("doc_id")
    if repeated.isEmpty():
        return rest
    once = docs.join(repeated, docs["doc_id"].eqNullSafe(repeated["doc_id"]), "left_semi").dropDuplicates(["doc_id", "text"])
    return without_ids(rest, repeated).unionByName(once)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates: texts whose
    shingles of five words have a similarity of 0.8 or more, as their fingerprints tell it."""
    found = checkpoint(near_duplicates(docs))
    return without_ids(docs, found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), special_tokens=True)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_dedup", simhash_dedup),
    ("packing", packing),
]

#: SQL can't express the trained language model, the fingerprints or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that all stages together make of ``documents``. What a stage wrote is deleted when
    the next has read it, what the last wrote when Python ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    atexit.register(remove, spark, folder)
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, f"{folder}/{before}")
        before = name
    return docs
