"""The pipeline's stages on their own inputs, and its run from end to end."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    folder = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage"))
        stage(spark, docs, folder).write.mode("overwrite").parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return out


def test_stages(steps):
    names = [n for n, _, _ in steps]
    assert names == ["quality classifier", "MinHash near-dedup", "suffix-array dedup", "mixing", "packing"]
    for _, before, after in steps[:-1]:
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"] == before.columns
    before, after = steps[1][1], steps[1][2]
    assert after.select("doc_id").distinct().count() == after.count() <= before.count()
    assert steps[2][1].count() == steps[2][2].count()
    assert steps[0][2].count() > 0.7 * steps[0][1].count()


def test_repeats_are_gone(steps):
    rows = [r["text"].encode() for r in steps[2][1].collect()]
    seen = Counter(b[i : i + 400] for b in rows for i in range(len(b) - 399))
    left = [r["text"].encode() for r in steps[2][2].collect()]
    repeated = {k for k, n in seen.items() if n > 1}
    whole = {b for b in left if any(b[i : i + 400] in repeated for i in range(len(b) - 399))}
    assert not whole


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "a text without an id", "en", "a", 1), (2, "", "en", "a", 0), (3, "same text here " * 40, "en", "a", 5), (3, "same text here " * 40, "en", "a", 5)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("node", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, odd, "").collect()
        assert stage(spark, odd.limit(0), "").collect() == []
    kept = corpus_pipeline.near_dedup(spark, odd, "").collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "3", "None"]  # 1 and 2 are both empty


def test_run(spark):
    import os

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and "sequence_id" in out.columns
    folder = os.path.dirname(os.path.dirname(out.inputFiles()[0].removeprefix("file://")))
    assert os.listdir(folder) == [str(len(corpus_pipeline.STAGES) - 1)]


def test_mixed_documents_lie_in_order(spark, steps):
    from tessera.llm.mixing import mix_sources

    before, after = steps[3][1], corpus_pipeline.mixing(spark, steps[3][1], "")
    assert [r["doc_id"] for r in after.collect()] == [r["doc_id"] for r in mix_sources(before).orderBy("position").collect()]


def test_repeated_passage_of_51_words(spark):
    own = lambda k, n: " ".join(f"t{k}w{i}" for i in range(n))
    passage, short = [f"p{i}" for i in range(51)], " ".join(f"q{i}" for i in range(50))
    assert len(" ".join(passage)) < 400
    texts = [f"{own(1, 60)} {' '.join(passage)} {own(2, 60)}", f"{own(3, 90)}\n{'  '.join(passage)}\n{own(4, 5)}", f"{own(5, 20)} {short} {own(6, 20)}", f"{short} {own(7, 9)}"]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.suffix_dedup(spark, docs, "").collect()}
    assert left == {0: f"{own(1, 60)}  {own(2, 60)}", 1: f"{own(3, 90)}\n\n{own(4, 5)}", 2: texts[2], 3: texts[3]}


def test_texts_that_share_an_id(spark):
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(60))
    rows = [(7, text(1)), (7, text(2)), (7, text(2)), (9, text(2) + " more"), (5, text(3)), (7, text(3)), (None, text(1))]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([(7, text(1)), (7, text(2)), (5, text(3)), (None, text(1))], key=str)
