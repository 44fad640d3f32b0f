"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.html_extract import extract_html

    return extract_html(_table(spark, sf_dir, "pages"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.suffix_dedup import PASSAGE_WORDS, repeats_digest

    return repeats_digest(_table(spark, sf_dir, "documents"), words=PASSAGE_WORDS)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sharding import shard_documents

    return shard_documents(_table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality_classifier import classify_quality

    return classify_quality(_table(spark, sf_dir, "documents"), columns=["doc_id"])


def op5_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.lattice_lm import score_texts

    return score_texts(_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "source", "text", "replica", "position")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tessera.llm.minhash import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def op9_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.multi_index import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality_rules import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def queries() -> dict:
    return {f.__name__: f for f in (op1_html_extract, op2_suffix_dedup, op3_sharding, op4_quality_classifier, op5_lattice_lm, op6_mixing, op7_packing, op8_minhash, op9_multi_index, op10_quality_rules)}


def oracle_sql() -> dict[str, str]:
    from tessera.llm.mixing import mix_sql
    from tessera.llm.quality_rules import rules_sql

    return {"op6_mixing": mix_sql(), "op10_quality_rules": rules_sql()}
