"""Embedding near-dedup: an inverted multi-index over vector halves, multi-sequence probing, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import connected_components, materialize
from tessera.llm.words import mix64

COSINE = 0.9
#: Rows (about) that the codebooks and the number of probes are fitted on: a sample by hash.
SAMPLE_ROWS = 20_000
#: Probes are raised until this share of each kind of test pair is found; the shortest list of probes, and the first length tried.
TARGET_RECALL, LEAST_PROBES, FIRST_PROBES = 0.995, 4, 128
#: Sample vectors that pairs are made of to fit the probes.
TEST_VECTORS = 2_048
#: Codes of a book at most: the grid's cells are counted in a broadcast table.
MAX_CODES = 512
#: Vectors of a cell, and queries to a block, that one task compares.
BLOCK_MEMBERS, BLOCK_QUERIES = 2_000, 16_000
#: Vectors of neighbouring cells that share a block: a query goes once to a block, however many of its cells it probes.
GROUP_MEMBERS = 8_000


def normalised(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(usable, unit vectors): a vector that is null, zero, of another length, or holds null or non-finite numbers is not usable.

    Vectors of one number get a zero beside it, so that there are two halves.
    """
    n = len(column)
    sizes = np.array([len(v) if v.is_valid else 0 for v in column])
    out = np.zeros((n, max(width, 2)))
    usable = sizes == width
    for i in np.flatnonzero(usable):
        value = column[int(i)].values
        if value.null_count:
            usable[i] = False
        else:
            out[i, :width] = value.to_numpy(zero_copy_only=False)
    usable &= np.isfinite(out).all(axis=1)
    out[~usable] = 0
    peak = np.abs(out).max(axis=1, keepdims=True)  # scaled first: squares must not overflow
    out = np.divide(out, peak, out=np.zeros_like(out), where=peak > 0)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    usable &= norm[:, 0] > 0
    return usable, np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ book.T + (book * book).sum(1)[None, :], 0)


def codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Lloyd's k-means from a sample of different points."""
    points = np.unique(x, axis=0)
    k = min(k, len(points))
    book = points[rng.choice(len(points), k, replace=False)]
    for _ in range(rounds):
        near = distances(x, book).argmin(1)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(book)
        np.add.at(total, near, x)
        book = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], book)
    return book


def multi_sequence(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], probes: int) -> np.ndarray:
    """Of each vector its ``probes`` nearest cells of the product grid, nearest first.

    The sum of the halves' distances orders the cells.  A cell can be among the first P
    only if its places a and b in the two sorted lists satisfy (a + 1) (b + 1) <= P: the
    cells that the multi-sequence algorithm would come to.
    """
    half = x.shape[1] // 2
    d1, d2 = distances(x[:, :half], books[0]), distances(x[:, half:], books[1])
    o1, o2 = np.argsort(d1, axis=1, kind="stable"), np.argsort(d2, axis=1, kind="stable")
    a, b = np.meshgrid(np.arange(len(books[0])), np.arange(len(books[1])), indexing="ij")
    front = (a + 1) * (b + 1) <= probes
    a, b = a[front], b[front]
    rows = np.arange(len(x))[:, None]
    total = d1[rows, o1[:, a]] + d2[rows, o2[:, b]]
    cells = o1[:, a] * len(books[1]) + o2[:, b]
    first = np.argsort(total, axis=1, kind="stable")[:, :probes]
    return np.take_along_axis(cells, first, axis=1)


def _places(x: np.ndarray, y: np.ndarray, books: tuple[np.ndarray, np.ndarray], most: int) -> np.ndarray:
    """For each pair of rows the probes with which one end comes to the other's cell; ``most`` if more are needed."""
    out = np.full(len(x), most)
    step = max(16, (1 << 16) // most)
    for at in range(0, len(x), step):
        a, b = multi_sequence(x[at : at + step], books, most), multi_sequence(y[at : at + step], books, most)
        for hit in (a == b[:, :1], b == a[:, :1]):
            found = np.where(hit.any(1), hit.argmax(1), most)
            out[at : at + step] = np.minimum(out[at : at + step], found)
    return out


def _test_pairs(x: np.ndarray, cosine: float, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """Kinds of pairs to fit probes on: at ``cosine`` exactly, each sample vector moved at random, within a half, or
    towards another vector; and the sample's own links, one link a vector, so no large group outweighs the rest."""
    q = x[rng.choice(len(x), min(len(x), TEST_VECTORS), replace=False)]
    half = x.shape[1] // 2
    left, right = rng.normal(size=q.shape), rng.normal(size=q.shape)
    left[:, half:] = 0
    right[:, :half] = 0
    pairs = []
    for move in (rng.normal(size=q.shape), left, right, x[rng.integers(0, len(x), len(q))]):
        move = move - (move * q).sum(1, keepdims=True) * q
        norm = np.linalg.norm(move, axis=1)
        use = norm > 1e-6
        pairs.append((q[use], cosine * q[use] + np.sqrt(max(0.0, 1 - cosine * cosine)) * move[use] / norm[use, None]))
    ends = []
    for at in range(0, len(q), 512):
        close = q[at : at + 512] @ x.T
        close[close > 1 - 1e-9] = -1  # the vector itself and exact copies share its cell
        draw = np.where(close >= cosine, rng.random(close.shape), -1)
        best = draw.argmax(1)
        found = np.flatnonzero(draw[np.arange(len(draw)), best] >= 0)
        ends.append(np.stack([found + at, best[found]], axis=1))
    ends = np.concatenate(ends)
    pairs.append((q[ends[:, 0]], x[ends[:, 1]]))
    return [p for p in pairs if len(p[0])]


def fit_index(x: np.ndarray, rows: float, cosine: float = COSINE, seed: int = 9) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """(codebooks, probes) from unit vectors of a sample; ``rows`` is the size of the whole.

    Probes are the fewest with which every kind of ``_test_pairs`` is found at the target
    rate on this very grid; if need be all cells, which is exact.
    """
    rng = np.random.default_rng(seed)
    k = int(np.clip(np.sqrt(max(rows, 1) / 16), 4, MAX_CODES))  # some sixteen vectors a cell, while codes last
    half = x.shape[1] // 2
    first, second = codebook(x[:, :half], k, rng), codebook(x[:, half:], k, rng)
    if half and len(first) > 2:  # neighbours in the order of codes are near each other, for blocks of cells
        centred = first - first.mean(0)
        first = first[np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0], kind="stable")]
    books = first, second
    cells = len(first) * len(second)
    probes = min(LEAST_PROBES, cells)
    for a, b in _test_pairs(x, cosine, rng):
        most = min(max(FIRST_PROBES, probes), cells)
        while True:
            share = np.cumsum(np.bincount(_places(a, b, books, most), minlength=most + 1)[:most]) / len(a)
            enough = np.flatnonzero(share >= TARGET_RECALL)
            if len(enough) or most == cells:
                probes = max(probes, int(enough[0]) + 1 if len(enough) else most)
                break
            most = min(2 * most, cells)
    return books, probes


def _assign(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, probes, width = shared.value
        step = max(16, (1 << 16) // probes)
        for batch in batches:
            usable, x = normalised(batch.column(1), width)
            at = np.flatnonzero(usable)
            cells = np.concatenate([multi_sequence(x[at[i : i + step]], books, probes) for i in range(0, len(at), step)]) if len(at) else np.zeros((0, 1), dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array(list(x[at]), pa.list_(pa.float64())), pa.array(list(cells.astype(np.int32)), pa.list_(pa.int32()))],
                ["node", "x", "cells"],
            )

    return run


def group_cells(cell: np.ndarray, members: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(group of each cell number, by how much each group's members are cut): neighbouring cells share a group, crowded cells have their own."""
    of, cuts, held = np.full(size, -1, dtype=np.int32), [], 0
    current = -1
    for c, n in sorted(zip(cell.tolist(), members.tolist())):
        if n > BLOCK_MEMBERS:
            of[c] = len(cuts)
            cuts.append(-(-n // BLOCK_MEMBERS))
            continue
        if current < 0 or held + n > GROUP_MEMBERS:
            current, held = len(cuts), 0
            cuts.append(1)
        of[c] = current
        held += n
    return of, np.array(cuts, dtype=np.int64)


def _visits(cells: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, group, offsets, cells): each row's probed cells that have members, by group; offsets cut ``cells`` into the visits' lists."""
    group = of[cells]
    row, column = np.nonzero(group >= 0)
    group, cell = group[row, column], cells[row, column]
    order = np.lexsort((group, row))
    row, group, cell = row[order], group[order], cell[order]
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = (row[1:] != row[:-1]) | (group[1:] != group[:-1])
    starts = np.flatnonzero(fresh)
    return row[starts], group[starts], np.append(starts, len(row)), cell


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _asked(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([pa.array(_visits(_matrix(batch.column(0)), shared.value)[1], pa.int32())], ["g"])

    return run


def _deal(shared):
    """Rows (node, x, cells) to blocks (group, cut of the members, cut of the queries)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, ms, qs = shared.value

        def rows(part: pa.RecordBatch, row, group, m, q, cells, query: bool) -> pa.RecordBatch:
            own = pa.array(_matrix(part.column(2))[:, 0]).take(pa.array(row))
            block = pa.array(group.astype(np.int64) << 40 | m << 20 | q)
            columns = [block, part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), own, cells, pa.array(np.full(len(row), query))]
            return pa.RecordBatch.from_arrays(columns, ["block", "node", "x", "own", "cells", "query"])

        def times(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            which = np.repeat(np.arange(len(n)), n)
            return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)

        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                cells = _matrix(part.column(2))
                slot = mix64(part.column(0).to_numpy().astype(np.int64).view(np.uint64)) >> np.uint64(1)
                slot = slot.astype(np.int64)
                own = of[cells[:, 0]]
                which, q = times(qs[own])
                yield rows(part, which, own[which], slot[which] % ms[own[which]], q, part.column(2).take(pa.array(which)), False)
                row, group, offsets, cell = _visits(cells, of)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(cell.astype(np.int32)))
                which, m = times(ms[group])
                yield rows(part, row[which], group[which], m, slot[row[which]] % qs[group[which]], lists.take(pa.array(which)), True)

    return run


class _Forest:
    """Union-find over the rows of a block."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.root[i] = j
        return i != j


def _compare(cosine: float):
    """A block is the members of cells against queries to them: rows (block, node, x, own cell, probed cells, is a query), by block.

    A query's probed cells are those of the block, a member's are all.  Emits (node,
    other, n): with other null, n links of the node; else a link that joins what no link
    of the block joined before.  A link that both ends would find is counted where the
    smaller id is the query.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: list[tuple] = []
        members: list[tuple] = []
        last = None

        def flush() -> pa.RecordBatch | None:
            if not queries or not members:
                return None
            qn, mn = np.array([q[0] for q in queries]), np.array([m[0] for m in members])
            qx, mx = np.stack([q[1] for q in queries]), np.stack([m[1] for m in members])
            qo, mo, probed = np.array([q[2] for q in queries]), np.array([m[2] for m in members]), np.stack([m[3] for m in members])
            asked = np.concatenate([q[3] for q in queries])
            asker = np.repeat(np.arange(len(queries)), [len(q[3]) for q in queries])
            order = np.argsort(asked, kind="stable")
            asked, asker = asked[order], asker[order]
            of_query, of_member = np.zeros(len(qn), np.int64), np.zeros(len(mn), np.int64)
            forest, seen, links = _Forest(len(qn) + len(mn)), {}, []
            number = np.array([seen.setdefault(v, len(seen)) for v in [*qn.tolist(), *mn.tolist()]])
            by_cell = np.argsort(mo, kind="stable")
            for here in np.split(by_cell, np.flatnonzero(np.diff(mo[by_cell])) + 1):
                at, to = np.searchsorted(asked, [mo[here[0]], mo[here[0]] + 1])
                if at == to:
                    continue
                # does the member probe the query's cell as well?
                kinds, which = np.unique(qo[asker[at:to]], return_inverse=True)
                place = np.minimum(np.searchsorted(kinds, probed[here]), len(kinds) - 1)
                hit, column = np.nonzero(kinds[place] == probed[here])
                back = np.zeros((len(kinds), len(here)), dtype=bool)
                back[place[hit, column], hit] = True
                for start in range(at, to, 512):
                    some = asker[start : min(start + 512, to)]
                    close = qx[some] @ mx[here].T >= cosine
                    close &= np.where(back[which[start - at : start - at + len(some)]], qn[some, None] < mn[None, here], qn[some, None] != mn[None, here])
                    of_query[some] += close.sum(1)
                    of_member[here] += close.sum(0)
                    for i, j in zip(*(v.tolist() for v in np.nonzero(close))):
                        if forest.join(int(number[some[i]]), int(number[len(qn) + here[j]])):
                            links.append((int(qn[some[i]]), int(mn[here[j]])))
            q, m = np.flatnonzero(of_query), np.flatnonzero(of_member)
            node = np.concatenate([qn[q], mn[m], [a for a, _ in links]]).astype(np.int64)
            other = [None] * (len(q) + len(m)) + [b for _, b in links]
            count = np.concatenate([of_query[q], of_member[m], np.zeros(len(links))]).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(other, pa.int64()), pa.array(count)], ["node", "other", "n"])

        for batch in batches:
            vectors = batch.column(2)
            for i, (block, node, own, probed, query) in enumerate(
                zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5).to_pylist())
            ):
                if block != last:
                    if (out := flush()) is not None:
                        yield out
                    queries, members, last = [], [], block
                x = vectors[i].values.to_numpy()
                (queries if query else members).append((node, x, own, probed.values.to_numpy()))
        if (out := flush()) is not None:
            yield out

    return run


def near_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row; vectors link at ``cosine`` or more, in double precision.

    Two codebooks, one for each half of the vector, span a grid of cells.  Every vector
    lies in its nearest cell and queries the cells that come first in its multi-sequence.
    The codebooks and the number of probes are fitted on a sample of about ``sample_rows``
    vectors; all vectors are indexed and all are queries.  Neighbouring cells form blocks,
    crowded cells and their queries are cut into blocks of bounded size; a block counts links in memory and returns counts and a
    spanning forest, so a cell of close vectors costs no row a pair.

    Vectors of each length have an index of their own and link only with each other.
    Vectors that are null, empty, zero, or hold null or non-finite numbers link with
    nothing: no links, their own component, kept.  A row with a null id likewise, with a
    null component.  Ids identify vectors: rows that repeat an id are one vector (the least
    that is not null).  A cosine of ``cosine`` itself links.  An empty table gives an empty result; other columns are not read.
    """
    rows = df.select(F.col(id_col).cast("long").alias("node"), F.col(vector_col).cast("array<double>").alias("v"))
    known = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("v").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = known.filter(F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    # as many rounds as there are lengths: one, in tables of one model's vectors
    widths = sorted(rows.filter("node IS NOT NULL AND size(v) > 0").groupBy(F.size("v").alias("w")).count().collect())
    tables = [_links(usable.filter(F.size("v") == r["w"]), r["w"], r["count"], cosine, sample_rows) for r in widths]
    tables = [t for t in tables if t is not None]
    if not tables:
        return rows.select(
            F.col("node").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("node").alias("component_id"), F.col("node").isNotNull().alias("kept")
        )
    found = tables[0]
    for t in tables[1:]:
        found = found.union(t)
    counts = found.filter("other IS NULL").groupBy("node").agg(F.sum("n").alias("n_links"))
    parts = connected_components(found.filter("other IS NOT NULL").select(F.col("node").alias("src"), F.col("other").alias("dst")))
    out = rows.select("node").join(counts, "node", "left").join(parts, "node", "left")
    component = F.coalesce("component", "node")
    return out.select(
        F.col("node").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("node"), F.lit(False)).alias("kept"),
    )


def _links(known: DataFrame, width: int, total: int, cosine: float, sample_rows: int) -> DataFrame | None:
    """(node, other, n) of ``_compare`` for usable vectors of one length, about ``total`` of them; None if there are none."""
    spark = known.sparkSession
    share = min(1.0, sample_rows / max(1, total))
    sample = known.filter(F.pmod(F.xxhash64(F.lit(9), "node"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).toArrow()
    if share < 1 and sample.num_rows < sample_rows // 4:  # most vectors are not usable: as good a sample of the rest
        total = known.count()
        share = min(1.0, sample_rows / max(1, total))
        sample = known.filter(F.pmod(F.xxhash64(F.lit(9), "node"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).toArrow()
    if not sample.num_rows:
        return None
    x = normalised(sample.column(1).combine_chunks(), width)[1]
    fitted = fit_index(x, total, cosine)
    shared = spark.sparkContext.broadcast((*fitted, width))
    indexed = materialize(known.mapInArrow(_assign(shared), "node long, x array<double>, cells array<int>"))

    # at most one row a cell of the grid
    loads = indexed.groupBy(F.col("cells")[0].alias("cell")).agg(F.count(F.lit(1)).alias("in_cell")).toArrow()
    of, ms = group_cells(loads.column(0).to_numpy(), loads.column(1).to_numpy(), len(fitted[0][0]) * len(fitted[0][1]))
    visits = indexed.select("cells").mapInArrow(_asked(spark.sparkContext.broadcast(of)), "g int").groupBy("g").agg(F.count(F.lit(1)).alias("n")).toArrow()
    qs = np.ones(len(ms), dtype=np.int64)
    qs[visits.column(0).to_numpy()] = -(-visits.column(1).to_numpy() // BLOCK_QUERIES)
    dealt = _deal(spark.sparkContext.broadcast((of, ms, qs)))
    return materialize(
        indexed.mapInArrow(dealt, "block long, node long, x array<double>, own int, cells array<int>, query boolean")
        .repartition("block").sortWithinPartitions("block")
        .mapInArrow(_compare(cosine), "node long, other long, n long")
    )
