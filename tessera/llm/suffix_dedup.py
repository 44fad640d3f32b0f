"""Suffix-array dedup: removes every byte that lies in a long string which also starts elsewhere."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, put_back, release, set_aside
from tessera.llm.suffix_array import permuted_lcp, suffix_array
from tessera.llm.words import _RANDOM, Words, mix64, text_chunks

LENGTH = 400
#: Words of a repeated passage: over 50.
PASSAGE_WORDS = 51
#: Bytes of a gram whose hash anchors windows.
GRAM = 64
#: A shard's suffix array covers about so many bytes; groups of more pieces take the exact way for crowds.
SHARD_BYTES = 500_000
CROWD = 1_000
#: Windows of a piece at most.
MOST_WINDOWS = 4_096
_POSITION_BITS = np.uint64(31)


def _gram(length: int) -> int:
    gram = 1
    while gram * 2 <= min(GRAM, max(1, length // 4)):
        gram *= 2
    return gram


def anchors(data: np.ndarray, bounds: np.ndarray, length: int):
    """Cuts the windows of ``length`` symbols within texts into runs that share an anchor.

    ``data`` has the texts' bytes, or 64-bit hashes of their words.  A window's anchor is the gram of least hash in it (the first of equals), so equal
    windows have equal anchors wherever they occur.  A run goes on where the same gram comes
    again, up to ``MOST_WINDOWS``.  Returns arrays (text, start in the
    text, number of windows, the anchor's hash, whether it lies in the run more than once).
    """
    gram, n = _gram(length), len(data)
    none = np.zeros(0, dtype=np.int64)
    if n < length:
        return none, none, none, none, none.astype(bool)
    h, step, power = _RANDOM[data] if data.dtype == np.uint8 else data, 1, np.uint64(0x9E3779B97F4A7C15)
    while step < gram:
        h = h[:-step] * power + h[step:]
        power, step = np.uint64(int(power) ** 2 & 0xFFFFFFFFFFFFFFFF), step * 2
    h = mix64(h)
    width = length - gram + 1
    key = (h >> _POSITION_BITS << _POSITION_BITS) | np.arange(len(h), dtype=np.uint64)
    rows = -(-len(key) // width)
    grid = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    grid[: len(key)] = key
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    least = np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows])
    place = (least & ((np.uint64(1) << _POSITION_BITS) - np.uint64(1))).astype(np.int64)

    sizes = np.diff(bounds)
    fits = np.maximum(sizes - length + 1, 0)
    anchor = h[place]
    fresh = np.ones(windows, dtype=bool)
    fresh[1:] = anchor[1:] != anchor[:-1]
    fresh[bounds[:-1][fits > 0]] = True
    valid = np.zeros(windows, dtype=bool)
    change = np.zeros(windows + 1, dtype=np.int64)
    np.add.at(change, bounds[:-1][fits > 0], 1)
    np.add.at(change, (bounds[:-1] + fits)[fits > 0], -1)
    valid = np.cumsum(change[:-1]) > 0
    starts = np.flatnonzero(fresh & valid)
    if not len(starts):
        return none, none, none, none, none.astype(bool)
    text = np.searchsorted(bounds, starts, side="right") - 1
    stops = np.append(starts[1:], windows)
    stops = np.minimum(stops, bounds[text] + fits[text])
    # long runs, as of one symbol over and over, are cut into equal parts
    parts = -(-(stops - starts) // MOST_WINDOWS)
    text, ends = np.repeat(text, parts), np.repeat(stops, parts)
    starts = np.repeat(starts, parts) + MOST_WINDOWS * (np.arange(len(ends)) - np.repeat(np.cumsum(parts) - parts, parts))
    n = np.minimum(ends - starts, MOST_WINDOWS)
    return text, starts - bounds[text], n, anchor[starts].view(np.int64), place[starts] != place[starts + n - 1]


def _cut(length: int, words: bool = False):
    """Pieces of each text; of words also their place ``at`` and ``size`` in bytes, and marks that white space does not change."""
    fields = ["k1", "k2", "anchor", "s1", "s2", "start", "n", "again"] + ["at", "size"] * words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, bounds in text_chunks(batch.column(2)):
                raw = data.tobytes()
                if words:
                    found = Words(data, bounds)
                    text, start, n, anchor, again = anchors(found.hashes(), found.first, length)
                    first = found.first[text] + start
                    at, to = found.starts[first], found.ends[first + n + length - 2]
                    bodies = [b" ".join(raw[x:y].split()) for x, y in zip(at.tolist(), to.tolist())]
                else:
                    text, start, n, anchor, again = anchors(data, bounds, length)
                    at = bounds[text] + start
                    bodies = [raw[x:y] for x, y in zip(at.tolist(), (at + n + length - 1).tolist())]
                marks = b"".join([blake2b(body, digest_size=16).digest() for body in bodies])
                marks = np.frombuffer(marks, dtype=np.int64).reshape(-1, 2)
                per = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=b - a)))).astype(np.int32)
                lists = [anchor, marks[:, 0], marks[:, 1], start.astype(np.int32), n.astype(np.int32), again.astype(np.int32)]
                if words:
                    lists += [(at - bounds[text]).astype(np.int32), (to - at).astype(np.int32)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)]
                    + [pa.ListArray.from_arrays(pa.array(per), pa.array(np.ascontiguousarray(x))) for x in lists],
                    fields,
                )

    return run


def repeated_windows(blobs: list[bytes], length: int, words: bool = False) -> list[list[int]]:
    """For each blob the windows that occur more than once in all blobs, as [from, to, from, to, ...].

    One suffix array over the blobs end to end; equal windows are neighbours in it, and
    the permuted common prefixes tell where neighbours share a whole window.  With ``words``
    its symbols are the words, numbered as they come, so white space between them does not count.
    """
    if words:
        known: dict[bytes, int] = {}
        rows = [np.array([known.setdefault(w, len(known) + 1) for w in b.split()], dtype=np.int64) for b in blobs]
        k = len(known) + 1
    else:
        rows, k = [np.frombuffer(b, dtype=np.uint8).astype(np.int64) + 1 for b in blobs], 257
    sizes = np.array([len(row) + 1 for row in rows])
    ends = np.cumsum(sizes)
    s = np.zeros(ends[-1], dtype=np.int64)
    fill = np.ones(ends[-1], dtype=bool)
    fill[ends - 1] = False  # symbol 0 ends every blob
    s[fill] = np.concatenate(rows)
    plcp, phi = permuted_lcp(s, suffix_array(s, k, entries=words))
    deep = np.flatnonzero(plcp >= length)
    hit = np.zeros(len(s), dtype=bool)
    hit[deep] = True
    hit[phi[deep]] = True
    out = []
    for begin, end in zip((ends - sizes).tolist(), ends.tolist()):
        flags = np.zeros(max(0, end - begin - length) + 2, dtype=np.int8)
        flags[1:-1] = hit[begin : begin + len(flags) - 2]
        out.append(np.flatnonzero(np.diff(flags)).tolist())
    return out


def _shards(length: int, words: bool = False):
    """Rows (anchor, s1, s2, blob) come sorted by anchor; a shard is a run of whole anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            runs = repeated_windows([b for _, _, b in held], length, words)
            return pa.RecordBatch.from_arrays(
                [pa.array([a for a, _, _ in held], pa.int64()), pa.array([b for _, b, _ in held], pa.int64()),
                 pa.array(runs, pa.list_(pa.int32()))],
                ["s1", "s2", "runs"],
            )

        for batch in batches:
            for anchor, s1, s2, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if anchor != last and size >= SHARD_BYTES:
                    yield flush()
                    held, size = [], 0
                held.append((s1, s2, blob))
                size += len(blob) + 1
                last = anchor
        if held:
            yield flush()

    return run


def _word_windows(length: int):
    """Of each blob (s1, s2, blob) its windows of words with a 128-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s1, s2, blob in zip(*(c.to_pylist() for c in batch.columns)):
                found = blob.split()
                n = len(found) - length + 1
                marks = b"".join([blake2b(b" ".join(found[w : w + length]), digest_size=16).digest() for w in range(n)])
                marks = np.frombuffer(marks, dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s1] * n, pa.int64()), pa.array([s2] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)),
                     pa.array(np.ascontiguousarray(marks[:, 0])), pa.array(np.ascontiguousarray(marks[:, 1]))],
                    ["s1", "s2", "w", "h1", "h2"],
                )

    return run


def merge_spans(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Maximal runs that the spans cover."""
    out: list[list[int]] = []
    for b, e in sorted(zip(starts, ends)):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [(b, e) for b, e in out]


def _remove(apart: bool):
    """What stays of each text; with ``apart`` without the spans of words, and then, as ``passage_*``, without those of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[list, list, list, list]] = [([], [], [], []) for _ in range(1 + apart)]
            for text, begins, ends, of_words in zip(*(batch.column(i) for i in (2, 3, 4, 5))):
                raw = text.as_py()
                begins, ends, of_words = begins.as_py(), ends.as_py(), of_words.as_py()
                bare = [(b, e) for b, e, w in zip(begins, ends, of_words) if not w]
                every = bare
                if any(of_words):
                    at = Words(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))
                    every = bare + [(int(at.starts[b]), int(at.ends[e - 1])) for b, e, w in zip(begins, ends, of_words) if w]
                for spans, (removed, n_spans, kept, marks) in zip([bare, every] if apart else [every], found):
                    runs = merge_spans(*map(list, zip(*spans))) if spans else []
                    parts, done = [], 0
                    for b, e in runs:
                        parts.append(raw[done:b])
                        done = e
                    left = b"".join([*parts, raw[done:]])
                    removed.append(len(raw) - len(left))
                    n_spans.append(len(runs))
                    kept.append(left)
                    marks.append(sha256(left).hexdigest())
            removed, n_spans, kept, marks = found[0]
            columns = [pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary()), pa.array(marks)]
            names = ["k1", "k2", "n_removed", "n_spans", "kept_bytes", "kept_sha256"]
            if apart:
                removed, n_spans, _, marks = found[1]
                columns += [pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(marks)]
                names += ["passage_removed", "passage_spans", "passage_sha256"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)

    return run


def _keys(text):
    return F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("2"), text).alias("k2")


def _places(base: DataFrame, length: int, words: bool) -> DataFrame:
    """Steps 1 and 2 of ``repeated_texts``: where the pieces that can hold a repeat of ``length`` bytes or words lie."""
    names = ["anchor", "s1", "s2", "start", "n", "again"] + ["at", "size"] * words
    lists = "anchor array<long>, s1 array<long>, s2 array<long>, " + ", ".join(f"{c} array<int>" for c in names[3:])
    cut = base.mapInArrow(_cut(length, words), f"k1 long, k2 long, {lists}")
    texts = materialize(
        cut.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("m"), *[F.first(c).alias(c) for c in names])
    )
    found = texts.select("k1", "k2", "m", F.inline(F.arrays_zip(*names)))
    pieces = found.groupBy("anchor", "s1", "s2").agg(F.sum("m").alias("times"), F.max("again").alias("again"))
    shared = pieces.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds >= 2")
    wanted = materialize(
        pieces.join(shared, "anchor", "left")
        .filter("times >= 2 OR kinds >= 2 OR again = 1")
        .select("anchor", "s1", "s2", (F.col("times") >= 2).alias("whole"), F.coalesce("kinds", F.lit(1) + F.col("again")).alias("kinds"))
    )
    places = materialize(found.drop("m", "again").join(wanted, ["anchor", "s1", "s2"]))
    release(texts, wanted)
    return places


def _spans(places: DataFrame, bodies: DataFrame, length: int, crowd: int, words: bool) -> DataFrame:
    """Step 3 of ``repeated_texts``: (k1, k2, b, e, words), spans of bytes or words of the texts."""
    at, size = ("at", "size") if words else ("start", f"n + {length} - 1")
    one = places.filter("kinds >= 2").groupBy("anchor", "s1", "s2").agg(
        F.min(F.struct("k1", "k2", "start", "n", *["at", "size"] * words)).alias("first"), F.first("whole").alias("whole"), F.first("kinds").alias("kinds")
    ).select("anchor", "s1", "s2", "whole", "kinds", "first.*")
    blobs = one.join(bodies, ["k1", "k2"]).select(
        "anchor", "s1", "s2", "whole", "kinds", "n", F.expr(f"substring(raw, {at} + 1, {size})").alias("blob")
    )
    few = blobs.filter(F.col("kinds") <= crowd).select("anchor", "s1", "s2", "blob")
    by_array = few.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_shards(length, words), "s1 long, s2 long, runs array<int>")
    crowds = blobs.filter(F.col("kinds") > crowd)
    if words:
        windows = crowds.select("s1", "s2", "blob").mapInArrow(_word_windows(length), "s1 long, s2 long, w int, h1 long, h2 long")
    else:
        windows = (
            crowds.select("s1", "s2", "blob", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("w"))
            .select("s1", "s2", "w", F.expr(f"substring(blob, w + 1, {length})").alias("x"))
            .select("s1", "s2", "w", F.xxhash64("x").alias("h1"), F.xxhash64(F.lit("2"), "x").alias("h2"))
        )
    twice = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c")).filter("c >= 2").drop("c")
    # a row a piece, not a window: windows that follow each other are one run
    by_hash = (
        windows.join(twice, ["h1", "h2"]).groupBy("s1", "s2").agg(F.array_sort(F.collect_list("w")).alias("ws"))
        .withColumn("b", F.expr("filter(ws, (w, i) -> coalesce(get(ws, i - 1), -2) <> w - 1)"))
        .withColumn("e", F.expr("filter(ws, (w, i) -> coalesce(get(ws, i + 1), -2) <> w + 1)"))
        .select("s1", "s2", F.expr("flatten(transform(b, (w, i) -> array(w, get(e, i) + 1)))").alias("runs"))
    )
    runs = by_array.filter("size(runs) > 0").union(by_hash)

    whole = places.filter("whole").select("k1", "k2", F.col("start").alias("b"), (F.col("start") + F.col("n") + length - 1).alias("e"))
    part = (
        places.filter("NOT whole AND kinds >= 2")
        .join(runs, ["s1", "s2"])
        .select("k1", "k2", "start", "runs", F.explode(F.expr("sequence(0, size(runs) - 2, 2)")).alias("i"))
        .selectExpr("k1", "k2", "start + runs[i] AS b", f"start + runs[i + 1] + {length} - 1 AS e")
    )
    return whole.union(part).withColumn("words", F.lit(words))


def repeated_texts(
    df: DataFrame, text_col: str = "text", length: int = LENGTH, crowd: int = CROWD, drop: tuple[str, ...] = (), words: int | None = None,
    apart: bool = False,
) -> DataFrame:
    """(k1, k2, n_removed, n_spans, kept_bytes, kept_sha256) of each different text that loses bytes, without ``drop``.

    1. A scan cuts each text into runs of windows that share an anchor: a piece of text
       from the first window's start to the last one's end, known by its hash.  Texts that
       are equal are taken once, with their number.
    2. A piece found more than once is repeated as a whole.  Of the rest only those matter
       whose anchor some other piece has, or that have it more than once.
    3. The bytes of one occurrence of each such piece go to the shard of its anchor, where
       a suffix array and permuted common prefixes find the windows that pieces share.
       Equal windows have equal anchors, so they meet there.  An anchor that more than
       ``crowd`` different pieces have is no shard for one task: its windows are compared
       by 128-bit hash in an aggregation instead, which spreads them over all tasks.
    4. Windows become spans, per text they are merged, and the rest of the text is kept.

    With ``words``, steps 1 to 3 are done for windows of so many words as well, on the same
    texts; step 4 merges the spans of both.  With ``apart`` the columns are those of ``length``
    alone, and (passage_removed, passage_spans, passage_sha256) those of both.
    """
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    base = df.select(*_keys(raw), raw.alias("raw")).filter(F.octet_length("raw") >= min(length, 2 * words - 1 if words else length))
    ways = [(length, False)] + ([(words, True)] if words else [])
    places = [_places(base, n, of_words) for n, of_words in ways]

    candidates = places[0].select("k1", "k2")
    for other in places[1:]:
        candidates = candidates.union(other.select("k1", "k2"))
    bodies = base.groupBy("k1", "k2").agg(F.first("raw").alias("raw"))
    bodies = materialize(bodies.join(candidates.distinct(), ["k1", "k2"], "left_semi"))

    spans = [_spans(p, bodies, n, crowd, of_words) for p, (n, of_words) in zip(places, ways)]
    if words:
        spans = [materialize(s) for s in spans]
    every = spans[0]
    for other in spans[1:]:
        every = every.union(other)
    every = every.groupBy("k1", "k2").agg(*[F.collect_list(c).alias(c) for c in ("b", "e", "words")])
    cut = bodies.join(every, ["k1", "k2"]).select("k1", "k2", "raw", "b", "e", "words").mapInArrow(
        _remove(apart), "k1 long, k2 long, n_removed long, n_spans long, kept_bytes binary, kept_sha256 string"
        + ", passage_removed long, passage_spans long, passage_sha256 string" * apart
    )
    out = materialize(cut.drop(*drop))
    release(*places, *spans, bodies)
    return out


def remove_repeats(
    df: DataFrame, text_col: str = "text", length: int = LENGTH, crowd: int = CROWD, words: int | None = None
) -> DataFrame:
    """Adds ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_bytes`` (binary) to every row of ``df``.

    A text is its UTF-8 bytes (null: empty).  A byte goes if a string of ``length`` bytes
    that covers it also starts anywhere else, the same text included; matches never cross
    texts, and all is judged on the input, of texts of any length.  Of equal strings none is
    kept.  Repeated rows are repeats of each other, so
    of texts as long as ``length`` nothing stays; shorter texts stay whole; an empty table
    gives an empty result.  Columns of ``df`` that bear the new names are replaced.

    With ``words``, a byte goes as well if it lies in a run of so many words that also
    starts anywhere else; white space between words may differ.
    """
    df, own = set_aside(df)
    text_col = own.get(text_col, text_col)
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    k1, k2 = _keys(raw)
    cut = repeated_texts(df, text_col, length, crowd, ("kept_sha256",), words)
    added = ["n_bytes", "n_removed", "n_spans", "kept_bytes"]
    rows = df.drop(*added).withColumns({"__k1": k1, "__k2": k2, "__raw": raw})
    cut = cut.toDF("__c1", "__c2", "__removed", "__spans", "__kept")
    joined = rows.join(cut, (F.col("__k1") == F.col("__c1")) & (F.col("__k2") == F.col("__c2")), "left")
    out = joined.select(
        *[c for c in df.columns if c not in added],
        F.octet_length("__raw").cast("long").alias("n_bytes"),
        F.coalesce("__removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("__spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("__kept", "__raw").alias("kept_bytes"),
    )
    return put_back(out, own)


def repeats_digest(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, crowd: int = CROWD, words: int | None = None
) -> DataFrame:
    """What ``remove_repeats`` does to each row, as counts and the SHA-256 of what stays.

    These are of ``length`` alone.  With ``words``, ``passage_removed``, ``passage_spans`` and ``passage_sha256`` follow:
    the same where runs of so many words go as well.
    """
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    cut = repeated_texts(df, text_col, length, crowd, ("kept_bytes",), words, words is not None)
    rows = df.select(F.col(id_col), *_keys(raw), F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("own"))
    more = []
    if words is not None:
        counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("passage_removed", "passage_spans")]
        more = [*counts, F.coalesce("passage_sha256", "own").alias("passage_sha256")]
    return rows.join(cut, ["k1", "k2"], "left").select(
        id_col,
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "own").alias("kept_sha256"),
        *more,
    )
