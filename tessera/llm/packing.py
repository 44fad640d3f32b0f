"""Best-fit packing of tokenised documents with swap-based local search."""

from __future__ import annotations

import functools
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import gapless, materialize

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: Of all pieces, a task numbers about this share at most, however many have one length.
BUCKET_SHARE = 1 / 512
#: Swaps that the local search looks for at most; one swap acts on all bins of two patterns at once.
MAX_SWAPS = 4000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """text -> ids as the vocabulary file gives them through ``tokenizers``, without added tokens.

    A plain byte-level BPE is run by tiktoken, which gives the same ids several times
    faster.  Texts that hold an added token, and any text it refuses, go to ``tokenizers``.
    """
    import json

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = [t["content"] for t in spec.get("added_tokens", [])]

    def plain(text: str) -> list[int]:
        return slow.encode(text, add_special_tokens=False).ids

    if spec["model"]["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
        return plain
    # byte-level vocabularies write each byte as one printable character
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes(table[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if any(a in text for a in added):
            return plain(text)
        try:
            return fast.encode_ordinary(text)
        except Exception:
            return plain(text)

    return encode


def _cutter(path: str | None, window: int, end_id: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path or default_vocabulary())
        for batch in batches:
            rows, pieces, starts, lengths, sums = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.asarray([*encode(text.as_py() or ""), end_id], dtype="<u4")
                first = len(ids) % window or window
                at, piece = 0, 0
                while at < len(ids):
                    to = min(len(ids), at + (window if piece else first))
                    rows.append(i)
                    pieces.append(piece)
                    starts.append(at)
                    lengths.append(to - at)
                    sums.append(zlib.crc32(ids[at:to].tobytes()))
                    at, piece = to, piece + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()),
                 pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                ["__id", "piece", "start", "length", "ids_crc32"],
            )

    return cut


def best_fit(counts: dict[int, int], window: int) -> dict[tuple[int, ...], int]:
    """Patterns (lengths that share a bin, longest first) and how many bins have each.

    Best-fit decreasing over the histogram of lengths: what it does to equal lengths is
    the same for each, so whole runs are placed at once and the work depends on the
    number of different lengths, not of documents.
    """
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by residual
    residuals: list[int] = []
    full: dict[tuple[int, ...], int] = defaultdict(int)

    def put(pattern: tuple[int, ...], n: int) -> None:
        left = window - sum(pattern)
        if not left:
            full[pattern] += n
            return
        if not open_bins[left]:
            insort(residuals, left)
        open_bins[left].append((pattern, n))

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            k = bisect_left(residuals, length)
            if k < len(residuals):
                left = residuals[k]
                pattern, n = open_bins[left].pop()
                if not open_bins[left]:
                    residuals.pop(k)
            else:
                left, pattern, n = window, (), todo
            each = left // length
            if todo < each:
                each, bins = todo, 1
            else:
                bins = min(n, todo // each)
            if pattern and bins < n:
                put(pattern, n - bins)
            todo -= each * bins
            put(pattern + (length,) * each, bins)
    for group in open_bins.values():
        for pattern, n in group:
            full[pattern] += n
    return dict(full)


def _improve(a: tuple[int, ...], b: tuple[int, ...], gap: int):
    """The exchange between bins a (fuller) and b that fills a most: (from a, from b), or None."""
    best, found = 0, None
    bs = sorted(set(b), reverse=True)
    pairs = [(x, y) for i, x in enumerate(bs) for y in bs[i:] if x != y or b.count(x) > 1]
    for out in ((), *((x,) for x in sorted(set(a)))):
        for into in (*((y,) for y in bs), *(pairs if out else ())):
            gain = sum(into) - sum(out)
            if best < gain <= gap:
                best, found = gain, (out, into)
        # two of a for one of b
    as_ = sorted(set(a))
    for i, x in enumerate(as_):
        for y in as_[i:]:
            if x == y and a.count(x) < 2:
                continue
            for z in bs:
                if best < z - x - y <= gap:
                    best, found = z - x - y, ((x, y), (z,))
    return found


def _without(items: tuple[int, ...], gone: tuple[int, ...]) -> list[int]:
    left = list(items)
    for x in gone:
        left.remove(x)
    return left


def local_search(bins: dict[tuple[int, ...], int], window: int, max_swaps: int = MAX_SWAPS) -> dict[tuple[int, ...], int]:
    """Exchanges one for one, two for one, or moves lengths between underfull bins.

    Each exchange fills the fuller bin further at the cost of the emptier one, which
    raises the sum of squared fills; emptier bins run dry and vanish.  It stops at the
    lower bound ceil(tokens / window), when nothing helps, or after ``max_swaps``.  Only the
    200 emptiest kinds of bins give and the 400 fullest underfull kinds take: other pairs
    may still help when it stops.
    """
    bins = dict(bins)
    least = -(-sum(sum(p) * n for p, n in bins.items()) // window)
    swaps, settled = 0, set()
    while swaps < max_swaps and sum(bins.values()) > least:
        under = sorted((p for p in bins if sum(p) < window), key=lambda p: (sum(p), p))
        done = False
        for donor in under[:200]:
            for target in reversed(under[-400:]):
                if (target, donor) in settled or sum(target) < sum(donor) or target == donor and bins[donor] < 2:
                    continue
                found = _improve(target, donor, window - sum(target))
                if not found:
                    settled.add((target, donor))
                    continue
                out, into = found
                n = bins[donor] // 2 if target == donor else min(bins[donor], bins[target])
                for p in (target, donor):
                    bins[p] -= n
                for p in (
                    tuple(sorted([*_without(target, out), *into], reverse=True)),
                    tuple(sorted([*_without(donor, into), *out], reverse=True)),
                ):
                    if p:
                        bins[p] = bins.get(p, 0) + n
                bins = {p: k for p, k in bins.items() if k}
                swaps += 1
                done = True
                break
            if done:
                break
        if not done:
            break
    return bins


def pack_plan(counts: dict[int, int], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the r-th piece of each length goes: sorted keys (length << 44 | first rank), first sequence, offset, bins."""
    bins = local_search(best_fit(counts, window), window)
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for pattern in sorted(bins, reverse=True):
        n, offset = bins[pattern], 0
        for length in pattern:
            rows.append(((length << 44) | used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2], sequence


def _assigner(shared):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sequences, offsets = shared.value
        for batch in batches:
            names = batch.schema.names
            length = batch.column(names.index("length")).to_numpy()
            rank = batch.column(names.index("rank")).to_numpy()
            wanted = (length << 44) | rank
            at = np.searchsorted(keys, wanted, side="right") - 1
            columns = [batch.column(i) for i, n in enumerate(names) if n != "rank"]
            columns += [pa.array(sequences[at] + wanted - keys[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays(columns, [*(n for n in names if n != "rank"), "sequence_id", "offset"])

    return assign


def pack_documents(
    df: DataFrame,
    window: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    end_id: int = END_ID,
) -> DataFrame:
    """Packs all rows into as few sequences of at most ``window`` tokens as it can; one row a piece.

    A document is its ids and then ``end_id``; only a longer one is cut, into pieces of
    ``window`` tokens of which the first may be shorter.  The plan is made on the
    histogram of lengths (``window`` numbers, whatever the input's size): best-fit
    decreasing, then swaps between underfull bins.  It is a list of patterns; the r-th
    piece of a length takes the r-th place of that length, so pieces find their sequence
    by rank, in parallel.  Pieces are written once to the shared folder and tokenised once.

    A null or empty text is the end id alone; repeated rows and null ids are packed each
    on its own; an empty table gives an empty result; other columns are not read.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    cut_schema = f"__id {kind}, piece int, start long, length long, ids_crc32 long"
    source = df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    pieces = materialize(source.mapInArrow(_cutter(vocabulary, window, end_id), cut_schema))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most window rows
    keys, sequences, offsets, _ = pack_plan(counts, window)
    shared = spark.sparkContext.broadcast((keys, sequences, offsets))
    most = max(1, int(sum(counts.values()) * BUCKET_SHARE))
    # only lengths that many pieces have are cut: at most window + 1 / BUCKET_SHARE buckets in all
    cuts = spark.createDataFrame([(k, -(-n // most)) for k, n in counts.items()], "length long, cuts long")
    row = ["__id", "piece", "start", "ids_crc32"]
    cut = pieces.join(F.broadcast(cuts), "length")
    ranked = gapless(cut, ["length"], F.pmod(F.xxhash64(*row), F.col("cuts")), row, "rank")
    ranked = ranked.select("__id", "piece", "start", "length", "ids_crc32", "rank")
    placed = ranked.mapInArrow(_assigner(shared), f"{cut_schema}, sequence_id long, offset long")
    return placed.withColumnRenamed("__id", id_col)
