"""Components, gapless numbers and word hashing."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.words import Words, text_chunks


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(1000, int(x)) for x in rng.integers(0, 60, 40)] + [(i, i + 1) for i in range(200, 230)] + [(int(a), int(b)) for a, b in rng.integers(300, 400, (40, 2))]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in root}


def test_gapless(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    got = common.gapless(df, ["g"], F.pmod(F.xxhash64("id"), F.lit(7)), ["id"], "n").toPandas()
    assert all(sorted(p.n) == list(range(len(p))) for _, p in got.groupby("g"))


def test_words():
    texts = ["a bc  a", None, "", " \x0b", "bc", "ünï a"]
    for _, _, data, bounds in text_chunks(pa.array(texts)):
        words = Words(data, bounds)
        found = [bytes(data[s:e]) for s, e in zip(words.starts, words.ends)]
        assert found == [b"a", b"bc", b"a", b"bc", "ünï".encode(), b"a"] and words.counts.tolist() == [3, 0, 0, 0, 1, 2]
        h = words.hashes()
        assert h[0] == h[2] == h[5] and h[1] == h[3] and len(set(h.tolist())) == 3
