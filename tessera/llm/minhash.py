"""MinHash near-dedup: BagMinHash signatures of word-shingle multisets, bands, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import connected_components, materialize, release
from tessera.llm.words import Words, mix64, text_chunks

SHINGLE = 5
SIMILARITY = 0.8
#: Registers of a signature: a pair of similarity 0.8 shares no band in 3 of 100,000 cases.
BANDS, ROWS = 20, 4
#: What a task compares in memory: so many texts and shingles, or about so many where a larger group is cut into blocks.
GROUP_TEXTS, GROUP_SHINGLES = 8_000, 3_000_000
CHUNK_BYTES = 1 << 20
_U = np.uint64


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of five words; a text of one to four words is one shingle."""
    own, first, counts = words.hashes(), words.first, words.counts
    full = np.maximum(counts - SHINGLE + 1, 0)
    text = np.repeat(np.arange(len(counts)), full)
    begin = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(full)[:-1])), full) + np.arange(len(text))
    h = np.zeros(len(text), dtype=np.uint64)
    for k in range(SHINGLE):
        h = h * _U(0x2545F4914F6CDD1D) + own[begin + k]
    few = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    short = np.zeros(len(few), dtype=np.uint64)
    for k in range(SHINGLE - 1):
        more = counts[few] > k
        short[more] = short[more] * _U(0x2545F4914F6CDD1D) + own[first[few[more]] + k]
    return np.concatenate([text, few]), mix64(np.concatenate([h, short + _U(0x9E3779B97F4A7C15)]))


def bag(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The multisets: (text, hash, how often), sorted."""
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(fresh)
    return text[at], h[at], np.diff(np.append(at, len(h)))


def bag_minhash(text: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, registers: int = BANDS * ROWS) -> np.ndarray:
    """Signatures (n x registers, bits of times) whose registers agree with probability sum(min) / sum(max).

    Every element has Poisson processes over its weight axis, on the dyadic intervals
    [0, 1), [1, 2), [2, 4), ...  A point has a time, a register and a place on the axis,
    all hashed from the element, the interval and the point's number; halving the interval
    by one bit after another gives the place.  Points placed at or above the element's
    weight do not count, and intervals that begin there are never opened.  A register
    keeps its earliest point.  Times beyond which all registers are nearly surely taken
    are not generated; texts for which one is still free go on to later times.
    """
    best = np.full((n, registers), np.inf)
    total = np.bincount(text, weights=weight, minlength=n)
    limit = registers * (np.log(registers) + 8.0) / np.maximum(total, 1)
    levels = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    owner = np.repeat(np.arange(len(text)), levels)
    level = np.arange(len(owner)) - np.repeat(np.cumsum(levels) - levels, levels)
    seed = mix64(h[owner] + level.astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    length = np.where(level < 2, 1, 1 << np.maximum(level - 1, 0))
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    todo = np.arange(len(owner))
    while len(todo):
        active, now, point = todo, np.zeros(len(todo)), 0
        while len(active):
            point += 1
            bits = mix64(seed[active] + np.full(1, point, np.uint64) * _U(0x9E3779B97F4A7C15))
            now = now - np.log(((bits >> _U(11)).astype(np.float64) + 0.5) / (1 << 53)) / length[active]
            in_time = now <= limit[text[owner[active]]]
            active, now, bits = active[in_time], now[in_time], bits[in_time]
            where = mix64(bits ^ _U(0xA0761D6478BD642F))
            place = low[active] + ((where >> _U(40)).astype(np.int64) & (length[active] - 1))
            hit = place < weight[owner[active]]
            slot = text[owner[active[hit]]] * registers + ((where[hit] & _U(0xFFFFFFFF)) % _U(registers)).astype(np.int64)
            np.minimum.at(best.ravel(), slot, now[hit])
        open_texts = np.isinf(best).any(axis=1) & (total > 0)
        limit = np.where(open_texts, limit * 2, limit)
        todo = np.flatnonzero(open_texts[text[owner]])
    return best.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, bounds in text_chunks(batch.column(3), CHUNK_BYTES):
            found = bag(*shingles(Words(data, bounds)))
            signature = bag_minhash(*found, b - a).view(np.uint64)
            bands = np.zeros((b - a, BANDS), dtype=np.uint64)
            for r in range(ROWS):
                bands = mix64(bands * _U(3) + signature[:, r::ROWS])
            size = np.bincount(found[0], weights=found[2], minlength=b - a).astype(np.int64)
            offsets = np.arange(b - a + 1, dtype=np.int32) * BANDS
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).slice(a, b - a) for i in range(3)), pa.array(size),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.ravel().view(np.int64)))],
                ["node", "k1", "k2", "size", "bands"],
            )


def overlaps(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Of each pair of texts sum(min) / sum(max) of their shingle counts; 0 where either has no word."""
    out = np.zeros(len(left))
    both = pa.concat_arrays([left.cast(pa.large_binary()), right.cast(pa.large_binary())])
    sizes = np.zeros(2 * len(left))
    parts = []
    for a, b, data, bounds in text_chunks(both, CHUNK_BYTES):
        text, h, n = bag(*shingles(Words(data, bounds)))
        sizes[a:b] = np.bincount(text, weights=n, minlength=b - a)
        parts.append((text + a, h, n))
    text, h, n = (np.concatenate(x) for x in zip(*parts))
    pair = text % len(left)
    order = np.lexsort((h, pair))
    pair, h, n = pair[order], h[order], n[order]
    same = np.flatnonzero((pair[1:] == pair[:-1]) & (h[1:] == h[:-1]))
    shared = np.bincount(pair[same], weights=np.minimum(n[same], n[same + 1]), minlength=len(left))
    union = sizes[: len(left)] + sizes[len(left) :] - shared
    np.divide(shared, union, out=out, where=union > 0)
    return out


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 512
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                close = overlaps(part.column(2), part.column(3)) >= similarity - 1e-12
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(close)], ["src", "dst", "close"]
                )

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, bounds in text_chunks(batch.column(1), CHUNK_BYTES):
            text, h, n = bag(*shingles(Words(data, bounds)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a).take(pa.array(text)), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))],
                ["node", "s", "n"],
            )


def _own_shingles(nodes: DataFrame, bodies: DataFrame) -> DataFrame:
    """(node, own): how many shingles of a text no other text of ``nodes`` has.

    They bound every overlap: what a pair shares is at most the rest of either text.
    """
    spread = bodies.join(nodes, "node", "left_semi").select("node", "raw").mapInArrow(_spread, "node long, s long, n long")
    once = spread.groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node"), F.min("n").alias("n")).filter("c = 1")
    return once.groupBy("node").agg(F.sum("n").alias("own"))


class _Shared:
    """How many columns rows share; ``row`` and ``column`` name each cell that is set, once.

    Columns that a sixteenth of the rows have are counted by a matrix product, rarer ones
    through lists of their rows.
    """

    def __init__(self, row: np.ndarray, column: np.ndarray, m: int):
        _, column, often = np.unique(column, return_inverse=True, return_counts=True)
        common = often >= max(2, m // 16)
        dense = common[column]
        self.m, number = m, np.cumsum(common) - 1
        self.table = np.zeros((m, int(common.sum())), dtype=np.float32)
        self.table[row[dense], number[column[dense]]] = 1
        row, column = row[~dense], column[~dense]
        order = np.argsort(column, kind="stable")
        self.rows, self.start = row[order], np.searchsorted(column[order], np.arange(len(often) + 1))
        order = np.argsort(row, kind="stable")
        self.columns, self.own = column[order], np.searchsorted(row[order], np.arange(m + 1))

    def against(self, at: int, to: int) -> np.ndarray:
        """For rows at .. to - 1 and all rows the number of columns that both have."""
        mine = self.columns[self.own[at] : self.own[to]]
        whose = np.repeat(np.arange(to - at), np.diff(self.own[at : to + 1]))
        lengths = self.start[mine + 1] - self.start[mine]
        place = np.repeat(self.start[mine] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        rare = np.bincount(np.repeat(whose, lengths) * self.m + self.rows[place], minlength=(to - at) * self.m)
        return rare.reshape(to - at, self.m) + self.table[at:to] @ self.table.T


def group_links(
    raws: list[bytes], component: np.ndarray, side: np.ndarray, buckets: list[list[int]], similarity: float
) -> list[tuple[int, int]]:
    """Links between classes among texts: each joins two classes that no link before it has joined.

    Texts are compared that share a bucket (``buckets`` empty: all do) and, if some are of
    side 1, that lie on different sides.  Overlaps come from counting shared shingles.
    """
    text, h, n = bag(*shingles(Words(*_joined(raws))))
    size = np.bincount(text, weights=n, minlength=len(raws))
    # the k-th copy of a shingle is an element of its own: shared elements are the smaller count
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    text, h = np.repeat(text, n), mix64(np.repeat(h, n) + k.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    _, column, often = np.unique(h, return_inverse=True, return_counts=True)
    kept = often[column] >= 2
    text, column = text[kept], column[kept]
    rest = np.bincount(text, minlength=len(raws))
    alive = np.flatnonzero(rest >= similarity * size - 1e-9)
    alive = alive[np.argsort(side[alive], kind="stable")]
    row = np.full(len(raws), -1)
    row[alive] = np.arange(len(alive))
    kept = row[text] >= 0
    size, component, side, m = size[alive], component[alive], side[alive], len(alive)
    first = int((side == 0).sum())
    if m < 2 or not first:
        return []
    counts = _Shared(row[text[kept]], column[kept], m)
    own = [buckets[i] for i in alive.tolist()] if buckets else []
    met = _Shared(np.repeat(np.arange(m), [len(b) for b in own]), np.concatenate(own), m) if own else None
    root = {c: c for c in component.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    links, step = [], max(1, min(256, (1 << 24) // m))
    for at in range(0, first, step):
        to = min(first, at + step)
        shared = counts.against(at, to)
        close = shared >= similarity * (size[at:to, None] + size[None, :] - shared) - 1e-6
        close &= component[at:to, None] != component[None, :]
        if first < m:
            close[:, :first] = False
        if met is not None and close.any():
            close &= met.against(at, to) > 0
        for i, j in zip(*np.nonzero(close)):
            a, b = find(int(component[at + i])), find(int(component[j]))
            if a != b:
                root[a] = b
                links.append((int(alive[at + i]), int(alive[j])))
    return links


def _joined(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.concatenate(([0], np.cumsum([len(r) for r in raws])))
    return np.frombuffer(b"".join(raws), dtype=np.uint8), bounds


def _groups(similarity: float):
    """Rows (u1, u2, i, j, side, node, component, buckets, raw) come sorted by block, the first four."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None

        def flush() -> pa.RecordBatch:
            side, nodes, components, buckets, raws = zip(*held)
            found = group_links(list(raws), np.array(components), np.array(side), list(buckets) if last[0] < 0 else [], similarity)
            return pa.RecordBatch.from_arrays(
                [pa.array([nodes[a] for a, _ in found], pa.int64()), pa.array([nodes[b] for _, b in found], pa.int64())], ["src", "dst"]
            )

        for batch in batches:
            for u1, u2, i, j, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (u1, u2, i, j) != last and held:
                    yield flush()
                    held = []
                last = u1, u2, i, j
                held.append(row)
        if held:
            yield flush()

    return run


def _blocks(rest: DataFrame, bodies: DataFrame, similarity: float, texts: int, shingles: int) -> DataFrame:
    """(u1, u2, i, j, side, node, component, buckets): what ``_groups`` compares, so that all texts of a bucket meet that are of different classes.

    Buckets that share texts form clusters; one that fits a task is a block (-1, cluster, 0, 0).
    Buckets of larger clusters are cut by hash into slices, apart for the texts of the
    class that has most; pairs of slices are blocks (band, h, i, j), but for two slices of
    that one class.
    """
    low = rest.groupBy("node").agg(F.min("first").alias("low"))
    marked = materialize(rest.join(low, "node"))
    least = marked.groupBy("band", "h").agg(F.min("low").alias("least"))
    met = materialize(marked.join(least, ["band", "h"]).select(F.col("low").alias("src"), F.col("least").alias("dst")).distinct())
    clusters = connected_components(met).toDF("low", "cluster")
    nodes = marked.groupBy("node").agg(
        F.first("low").alias("low"), F.first("size").alias("size"), F.first("component").alias("component"),
        F.collect_list(F.xxhash64("band", "h")).alias("buckets"),
    )
    nodes = materialize(nodes.join(clusters, "low", "left").withColumn("cluster", F.coalesce("cluster", "low")).drop("low"))
    loads = nodes.groupBy("cluster").agg(F.count(F.lit(1)).alias("texts"), F.sum("size").alias("shingles"))
    large = loads.filter((F.col("texts") > texts) | (F.col("shingles") > shingles)).select("cluster")
    fit = nodes.join(large, "cluster", "left_anti").select(
        F.lit(-1).alias("u1"), F.col("cluster").alias("u2"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).alias("side"), "node", "component", "buckets"
    )
    cut = materialize(nodes.join(large, "cluster", "left_semi").select("node"))
    release(met)
    if cut.isEmpty():
        return fit
    own = _own_shingles(cut, bodies)
    members = rest.join(cut, "node").join(own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    # a text with more shingles of its own than this has no near copy at all
    members = materialize(members.filter((F.col("size") - F.col("own")) >= F.lit(similarity - 1e-9) * F.col("size")).drop("own", "first"))
    kinds = members.groupBy("band", "h", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    need = lambda n, s: F.greatest(F.lit(1), F.ceil(n * F.lit(2 / texts)), F.ceil(s * F.lit(2 / shingles))).cast("long")
    sizes = kinds.groupBy("band", "h").agg(F.max(F.struct("n", "s", "component")).alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s")).select(
        "band", "h", F.col("top.component").alias("main"), need(F.col("top.n"), F.col("top.s")).alias("mains"),
        need(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s")).alias("others"),
    )
    # slices 0 .. others - 1, then the main class's
    slot = F.shiftrightunsigned(F.xxhash64(F.lit(3), "node"), 1)
    is_main = F.col("component") == F.col("main")
    sliced = members.join(sizes, ["band", "h"]).withColumn("slice", F.when(is_main, F.col("others") + slot % F.col("mains")).otherwise(slot % F.col("others")))
    mates = F.sequence(F.lit(0).cast("long"), F.col("others") + F.when(is_main, F.lit(0)).otherwise(F.col("mains")) - 1)
    dealt = sliced.withColumn("mate", F.explode(mates)).select(
        F.col("band").alias("u1"), F.col("h").alias("u2"), F.least("slice", "mate").alias("i"), F.greatest("slice", "mate").alias("j"),
        (F.col("slice") > F.col("mate")).cast("int").alias("side"), "node", "component", F.array().cast("array<long>").alias("buckets"),
    )
    return fit.union(dealt)


def _links(pairs: DataFrame, bodies: DataFrame, similarity: float) -> DataFrame:
    """The pairs (src, dst) that are similar, verified on their whole texts."""
    a, b = bodies.select(F.col("node").alias("src"), F.col("raw").alias("x")), bodies.select(F.col("node").alias("dst"), F.col("raw").alias("y"))
    # merge joins at any size: what is moved then grows as the input does
    joined = pairs.join(a.hint("merge"), "src").join(b.hint("merge"), "dst").select("src", "dst", "x", "y")
    return joined.mapInArrow(_verify(similarity), "src long, dst long, close boolean").filter("close").drop("close")


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
    group_texts: int = GROUP_TEXTS,
    group_shingles: int = GROUP_SHINGLES,
) -> DataFrame:
    """(id, class_id) of every row: the smallest id that a chain of near copies leads to.

    Two texts are near copies if the multisets of their five-word shingles overlap by
    ``similarity`` or more (sum of the smaller counts over sum of the larger).

    Equal texts are one class from the start and go on as one.  Signatures are cut into
    bands; texts with an equal band share a bucket.  In a bucket all texts are first
    compared with the one that shares most buckets, not with each other: as many pairs as
    texts.  Buckets whose texts are then one class are done.  Texts that share other
    buckets form groups.  Tasks compare those of a group that share a bucket and are of
    different classes, and return at most a link a text; a group of more than
    ``group_texts`` texts or ``group_shingles`` shingles is cut into blocks, in which the
    same pairs meet.  So all texts that share a band are compared, at any size, unless a
    chain of links joins them already.  Every link is verified exactly.

    Texts are read whole, however long; ties need no breaking, as the result depends on the links alone.

    A null text counts as empty; texts without words equal only each other.  Rows with a
    null id stay alone, with a null class.  Repeated rows share a class; an empty table
    gives an empty result; other columns are not read.
    """
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = df.select(
        F.col(id_col).cast("long").alias("node"), F.xxhash64(raw).alias("k1"), F.xxhash64(F.lit("2"), raw).alias("k2"), raw.alias("raw")
    )
    known = rows.filter("node IS NOT NULL")
    signed = known.mapInArrow(_sign, "node long, k1 long, k2 long, size long, bands array<long>")
    texts = materialize(
        signed.groupBy("k1", "k2").agg(F.min("node").alias("node"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    )
    banded = texts.filter("size > 0").select("node", "size", F.posexplode("bands").alias("band", "h"))
    crowds = banded.groupBy("band", "h").agg(F.count(F.lit(1)).alias("c")).filter("c >= 2")
    shared = materialize(banded.join(crowds, ["band", "h"]))
    popular = shared.groupBy("node").agg(F.sum("c").alias("popular"))
    members = materialize(shared.drop("c").join(popular, "node"))
    release(shared)
    bodies = materialize(
        known.join(members.select("node").distinct().hint("merge"), "node").groupBy("node").agg(F.first("raw").alias("raw"))
    )

    alike = F.least("size", "size2") >= F.lit(similarity - 1e-9) * F.greatest("size", "size2")
    pivot = members.groupBy("band", "h").agg(F.max(F.struct("popular", -F.col("node"), "size")).alias("p"))
    pivot = pivot.select("band", "h", (-F.col("p.col2")).alias("dst"), F.col("p.size").alias("size2"))
    starred = members.join(pivot, ["band", "h"]).filter("node <> dst")
    pairs = starred.filter(alike).select(F.least("node", "dst").alias("src"), F.greatest("node", "dst").alias("dst"))
    links = materialize(_links(pairs.distinct(), bodies, similarity))
    classes = materialize(connected_components(links))

    # what the first round leaves: buckets with several classes, but for their pivots, who have met all
    rest = starred.select("band", "h", "node", "size").join(classes, "node", "left")
    rest = materialize(rest.withColumn("component", F.coalesce("component", "node")))
    several = rest.groupBy("band", "h").agg(
        F.min("component").alias("c1"), F.max("component").alias("c2"), F.min("node").alias("first")
    ).filter("c1 <> c2")
    mixed = materialize(rest.join(several.select("band", "h", "first"), ["band", "h"]))
    release(members, rest)
    if not mixed.isEmpty():
        block = ["u1", "u2", "i", "j"]
        more = materialize(
            _blocks(mixed, bodies, similarity, group_texts, group_shingles).join(bodies.hint("merge"), "node")
            .select(*block, "side", "node", "component", "buckets", "raw").repartition(*block).sortWithinPartitions(*block)
            .mapInArrow(_groups(similarity), "src long, dst long")
        )
        if not more.isEmpty():
            classes = materialize(connected_components(materialize(links.union(more))))
    release(bodies, mixed)
    own = texts.select("k1", "k2", "node").join(classes, "node", "left").select(
        "k1", "k2", F.coalesce("component", "node").alias("class_id")
    )
    found = rows.select("node", "k1", "k2").filter("node IS NOT NULL").join(own, ["k1", "k2"]).select(F.col("node").alias(id_col), "class_id")
    alone = rows.filter("node IS NULL").select(F.col("node").alias(id_col), F.lit(None).cast("long").alias("class_id"))
    return found.union(alone)
