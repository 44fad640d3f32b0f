"""The corpus pipeline: quality, near-dedup, repeated passages, mixing and packing, one stage after another.

Every stage takes whole texts of any length, gives an empty table for an empty one, and reads
only the columns of ``documents``: others, whatever their names, do not matter and do not come out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, remove, remove_at_exit, shared_dir
from tessera.llm.minhash import near_duplicates
from tessera.llm.mixing import mix_sources
from tessera.llm.packing import pack_documents
from tessera.llm.quality_classifier import classify_quality
from tessera.llm.suffix_dedup import PASSAGE_WORDS, remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are rejected; a null id, source or language is no reason to go; repeated rows share their fate.
    """
    return classify_quality(docs, columns=COLUMNS).filter("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id stays; a document without an id stays.

    Different texts that share an id are documents of their own; rows that repeat both are
    one.  Null and empty texts are copies of each other.  Of equal ids the text of least hash stays.
    """
    known = docs.filter("doc_id IS NOT NULL")
    if known.groupBy("doc_id").count().filter("count > 1").isEmpty():
        kept = near_duplicates(docs).filter("class_id IS NULL OR doc_id = class_id").select("doc_id").distinct()
        return docs.join(kept, docs.doc_id.eqNullSafe(kept.doc_id), "left_semi").select(*COLUMNS)
    rows = materialize(known.select(*COLUMNS).dropDuplicates(["doc_id", "text"]).withColumn("node", F.monotonically_increasing_id()))
    places = rows.select("node", F.struct("doc_id", F.xxhash64("text").alias("h"), "node").alias("place"))
    kept = near_duplicates(rows, "node").join(places, "node").groupBy("class_id").agg(F.min("place").alias("place")).select("place.node")
    return docs.filter("doc_id IS NULL").select(*COLUMNS).union(rows.join(kept, "node", "left_semi").select(*COLUMNS))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of over 50 words or of 400 bytes go from the texts; a character that a cut splits goes with it.

    No document goes: null texts stay null, and what is repeated as a whole becomes empty.  All copies of a passage go.
    """
    cut = remove_repeats(docs, words=PASSAGE_WORDS)
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(
        F.replace(F.try_validate_utf8(F.make_valid_utf8(F.col("kept_bytes").cast("string"))), F.lit("�"), F.lit(""))
    )
    return cut.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document appears as often as its source's target weight asks; files and their rows are in a global random order.

    A null source is a source of its own, a null id draws as the word null does.
    """
    return mix_sources(docs).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: where each piece of each document goes; null and empty texts are their end alone, repeated rows are packed each."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: The classifier's fit, signatures and packing are beyond SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to ``documents``; what one returns is written, read again, and the next one's input.

    A stage's table is deleted once the next one's is written, the last one's when the driver's process ends.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            remove(spark, f"{folder}/{k - 1}")
    remove_at_exit(spark, folder)
    return docs
