"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import html_extract, lattice_lm, minhash, mixing, multi_index, packing, quality_classifier, quality_rules, sharding, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["k1", "k2", "node", "shard", "slot", "size", "kept", "score", "position", "replica", "rate", "cdf", "n_words", "class_id", "quality_score", "raw", "n_removed", "kept_bytes", "word", "rid"]


@pytest.fixture(scope="module")
def odd(spark):
    prose = "the cat of the house and the dog in the garden " * 30
    rows = [
        (1, None, "en", "a", 0), (2, "", None, None, None), (3, " \n\t ", "en", "a", 4), (4, "word", "en", "b", 4), (5, prose, "en", "a", 9),
        (6, prose, "en", "a", 9), (6, prose, "en", "a", 9), (None, "no id here but a text", "de", "b", 5), (None, None, None, None, None),
        (7, "x" * 300_000, "en", "a", 300_000), (8, ("long words " * 40_000), "en", "a", 1), (9, "ünïcödé €😀 　 end", "fr", "c", 3), (-5, "negative id", "fr", "c", 3),
    ]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


OPERATORS = {
    "repeats": lambda d: suffix_dedup.repeats_digest(d),
    "removed": lambda d: suffix_dedup.remove_repeats(d),
    "shards": lambda d: sharding.shard_documents(d),
    "quality": lambda d: quality_classifier.classify_quality(d),
    "lm": lambda d: lattice_lm.score_texts(d),
    "packing": lambda d: packing.pack_documents(d),
    "minhash": lambda d: minhash.near_duplicates(d),
    "rules": lambda d: quality_rules.quality_rules(d),
    "html": lambda d: html_extract.extract_html(d.withColumn("html", F.col("text"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(odd, name):
    out = OPERATORS[name](odd)
    got = out.collect()
    ids = sorted({r["doc_id"] for r in got}, key=str)
    assert ids == sorted({r["doc_id"] for r in odd.select("doc_id").collect()}, key=str)
    if name != "packing":
        assert len(got) == odd.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).collect() == []


def test_mixing_odd_rows(odd, empty):
    got = mixing.mix_sources(odd, total=40).collect()
    assert sorted(r["position"] for r in got) == list(range(len(got)))
    assert mixing.mix_sources(empty).collect() == []


def test_defined_results(odd):
    digest = {r["doc_id"]: r for r in OPERATORS["repeats"](odd).filter("doc_id IS NOT NULL").collect()}
    assert (digest[1]["n_bytes"], digest[1]["n_removed"]) == (0, 0)
    assert digest[5]["n_removed"] == digest[5]["n_bytes"] and digest[7]["n_removed"] == 300_000
    quality = {r["doc_id"]: r for r in OPERATORS["quality"](odd).collect()}
    assert not quality[1]["kept"] and not quality[2]["kept"] and quality[3]["quality_score"] == 0
    classes = {r["doc_id"]: r["class_id"] for r in OPERATORS["minhash"](odd).collect()}
    assert classes[5] == classes[6] == 5 and classes[1] == classes[2] == 1 and classes[None] is None
    shards = OPERATORS["shards"](odd).filter("doc_id = 1").first()
    assert (shards["size"], shards["text_crc32"]) == (8, 0)
    lm = {r["doc_id"]: r for r in OPERATORS["lm"](odd).collect()}
    assert lm[1]["n_tokens"] == 1
    rules = {r["doc_id"]: r for r in OPERATORS["rules"](odd).collect()}
    assert rules[1]["base_failed"] and rules[1]["n_words"] == 0 and rules[4]["n_words"] == 1


def test_vectors_odd_rows(spark):
    rows = [
        (1, [1.0, 0.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0, 0.0]), (3, None), (4, [0.0] * 4), (5, [float("nan"), 1.0, 0.0, 0.0]), (6, [float("inf"), 0.0, 0.0, 0.0]),
        (7, []), (8, [1e300, 1e300, 0.0, 0.0]), (9, [1e-300, 1e-300, 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0]), (10, [None, 1.0, 0.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit(1))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in multi_index.near_vectors(df).collect()}
    assert got[1] == (1, 1, True) and got[2] == (1, 1, False) and got[8] == (1, 8, True) and got[9] == (1, 8, False)
    assert all(got[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 10)) and got[None] == (0, None, False)
    assert multi_index.near_vectors(df.limit(0)).collect() == []


@pytest.mark.parametrize("partitions", [1, 4])
def test_vectors_of_several_lengths(spark, partitions):
    rng = np.random.default_rng(6)
    rows = []
    for width, n in ((4, 30), (1, 8), (2, 25), (9, 3)):
        centre = rng.normal(size=width)
        rows += [(len(rows) + i, (centre + 0.2 * rng.normal(size=width)).tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(partitions)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in multi_index.near_vectors(df).collect()}
    unit = [np.array(v) / np.linalg.norm(v) for _, v in rows]
    links = [[j for j in range(len(rows)) if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9] for i in range(len(rows))]
    least = list(range(len(rows)))
    for _ in rows:
        least = [min([least[i], *(least[j] for j in links[i])]) for i in range(len(rows))]
    assert got == {i: (len(links[i]), least[i]) for i in range(len(rows))}


def test_vectors_few_of_which_are_usable(spark):
    rows = [(i, [float("nan"), 1.0]) for i in range(3000)] + [(5000 + i, [1.0, 0.001 * i]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = multi_index.near_vectors(df, sample_rows=100).toPandas()
    assert got.n_links.sum() == 20 and got[got.n_links > 0].component_id.eq(5000).all()


def test_columns_with_the_names_used_inside(spark):
    names = ["__words", "__text", "__html", "__k1", "__raw", "__key", "__source", "__i", "__range"]
    df = spark.createDataFrame([(1, "some words of a text " * 40, "a"), (2, None, None)], "doc_id long, text string, source string")
    df = df.withColumns({c: F.lit(c) for c in names})
    for operator in (quality_rules.quality_rules, quality_classifier.classify_quality, suffix_dedup.remove_repeats, lambda d: mixing.mix_sources(d, total=20),
                     lambda d: html_extract.extract_html(d.withColumn("html", F.col("text")))):
        got = operator(df).collect()
        assert got and all(r[c] == c for r in got for c in names)


def test_hot_text_without_ids_is_split(spark):
    df = spark.createDataFrame([(None if i % 2 else 7, "hot text " * 20) for i in range(3000)] + [(i, f"own {i} " * 9) for i in range(3000)], "doc_id long, text string")
    got = sharding.shard_documents(df).toPandas()
    rows = got.groupby("shard").size()
    assert len(rows) == 24 and rows.max() < 1.1 * rows.mean()
    assert all(sorted(p.slot) == list(range(len(p))) for _, p in got.groupby("shard"))


def test_vectors_in_a_batch_of_another_length():
    class Shared:
        value = ((np.array([[1.0, 0.0], [0.0, 1.0]]), np.array([[1.0, 0.0], [0.0, 1.0]])), 1, 4)

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([[1.0] * 3, [2.0] * 3, [1.0, 0.0, 0.0, 1.0]])], ["node", "v"])
    (out,) = multi_index._assign(Shared)([batch])
    assert out.column(0).to_pylist() == [3]
