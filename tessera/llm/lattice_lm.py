"""LM scoring: the likelihood of a text over all its segmentations into the pieces of an existing vocabulary."""

from __future__ import annotations

import functools
import math
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, release

VOCABULARY = "byte_bpe_50k.tiktoken"
#: So many of the most frequent words of at most ``LONG_WORD`` bytes are broadcast (some ten MB); all others are joined.
FREQUENT_WORDS = 150_000
#: Rounds of expectation-maximisation before the last one.  Each sees all training words: there is no bound on them.
WARM_WORDS, WARM_ROUNDS = math.inf, 4
#: Added to each piece's expected count.
SMOOTH = 0.05
#: Longer words go through the recursion one by one.
LONG_WORD = 64
FLUSH_WORDS, FLUSH_BYTES = 300_000, 1 << 26
#: Words go through the recursions so many, or so many bytes of them, at a time.
GATHER_WORDS, GATHER_BYTES = 100_000, 1 << 23
_SPACE = b" "
_M = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 22


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces that words can hold, and the vocabulary's own scores: log probabilities by rank.

    A word is lower case and begins with a space in place of the white space before it.
    """
    import base64

    found = []
    with open(path, "rb") as f:
        for line in f:
            token, rank = line.split()
            found.append((int(rank), base64.b64decode(token)))
    known = {t for _, t in found}
    found += [(len(found) + b, bytes([b])) for b in range(256) if bytes([b]) not in known]
    usable = [
        (r, t) for r, t in found
        if t == t.lower() and not t[1:].strip() != t[1:] and (t == _SPACE or t.strip()) and t[:1] not in b"\t\n\x0b\x0c\r"
        and not any(c in t[1:] for c in b" \t\n\x0b\x0c\r")
    ]
    ranks = np.array([r for r, _ in usable], dtype=float)
    score = -np.log(ranks + 10)
    return [t for _, t in usable], score - np.log(np.exp(score).sum())


class Lattice:
    """All segmentations of words into pieces."""

    def __init__(self, path: str):
        self.pieces, self.scores = pieces(path)
        self.number = {t: i for i, t in enumerate(self.pieces)}
        self.longest = max(map(len, self.pieces))
        self.prefixes = {t[:k] for t in self.pieces for k in range(1, len(t))}
        # hashed are the pieces, by number, and after them what only begins some
        known = self.pieces + sorted(self.prefixes.difference(self.number))
        self.goes_on = np.array([t in self.prefixes for t in known] + [False])  # the last one: not found
        hashes = np.array([self._hash(t) for t in known], dtype=np.uint64)
        slot = (hashes >> np.uint64(64 - _SLOTS)).astype(np.int64)
        self.table = np.full(1 << _SLOTS, -1, dtype=np.int32)
        self.table[slot] = np.arange(len(slot))  # of pieces with one slot the last has it
        self.hashes = hashes
        self.rest = np.flatnonzero(self.table[slot] != np.arange(len(slot)))
        self.rest = self.rest[np.argsort(hashes[self.rest])]

    @staticmethod
    def _hash(t: bytes) -> int:
        h = 0
        for b in t:
            h = ((h + b + 1) * int(_M)) & 0xFFFFFFFFFFFFFFFF
            h ^= h >> 29
        return h

    def _find(self, h: np.ndarray) -> np.ndarray:
        at = self.table[(h >> np.uint64(64 - _SLOTS)).astype(np.int64)]
        found = np.where((at >= 0) & (self.hashes[at] == h), at, -1)
        if len(self.rest):
            left = np.flatnonzero((at >= 0) & (found < 0))
            keys = self.hashes[self.rest]
            place = np.minimum(np.searchsorted(keys, h[left]), len(keys) - 1)
            hit = keys[place] == h[left]
            found[left[hit]] = self.rest[place[hit]]
        return found

    def arcs(self, words: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """For equally long words (a matrix of bytes): (start, end) -> (words, pieces) of the arcs there."""
        n, size = words.shape
        columns, out = words.T.astype(np.uint64) + np.uint64(1), {}
        for i in range(size):
            rows, h = np.arange(n), np.zeros(n, dtype=np.uint64)
            for j in range(i + 1, min(size, i + self.longest) + 1):
                h = (h + columns[j - 1, rows]) * _M
                h ^= h >> np.uint64(29)
                found = self._find(h)
                hit = np.flatnonzero((found >= 0) & (found < len(self.pieces)))
                if len(hit):
                    out[i, j] = rows[hit], found[hit]
                left = np.flatnonzero(self.goes_on[found])  # no piece begins with the others
                if not len(left):
                    break
                rows, h = rows[left], h[left]
        return out

    def forward(self, arcs: dict, n: int, size: int, logp: np.ndarray) -> np.ndarray:
        """log of the summed probability of all segmentations of each word's first j bytes, by j."""
        alpha = np.full((size + 1, n), -np.inf)
        alpha[0] = 0
        for j in range(1, size + 1):
            for i in range(max(0, j - self.longest), j):
                if (i, j) in arcs:
                    rows, piece = arcs[i, j]
                    alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + logp[piece])
        return alpha

    def expected(self, arcs: dict, n: int, size: int, logp: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece in words that occur ``count`` times."""
        alpha = self.forward(arcs, n, size, logp)
        beta = np.full((size + 1, n), -np.inf)
        beta[size] = 0
        for i in range(size - 1, -1, -1):
            for j in range(i + 1, min(size, i + self.longest) + 1):
                if (i, j) in arcs:
                    rows, piece = arcs[i, j]
                    beta[i, rows] = np.logaddexp(beta[i, rows], beta[j, rows] + logp[piece])
        which, weight = [], []
        for (i, j), (rows, piece) in arcs.items():
            which.append(piece)
            weight.append(count[rows] * np.exp(alpha[i, rows] + logp[piece] + beta[j, rows] - alpha[size, rows]))
        if not which:
            return np.zeros(len(logp))
        return np.bincount(np.concatenate(which), weights=np.concatenate(weight), minlength=len(logp))

    def by_length(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers, matrix of bytes) of words of one length, each with its space in front."""
        sizes = np.array([len(w) for w in words])
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            step = 1 if size > LONG_WORD else max(1, (1 << 20) // (size + 1) // 16)
            for k in range(0, len(at), step):
                part = at[k : k + step]
                raw = b"".join([_SPACE + words[i] for i in part.tolist()])
                yield part, np.frombuffer(raw, dtype=np.uint8).reshape(len(part), size + 1)

    def likelihood(self, words: list[bytes], logp: np.ndarray) -> np.ndarray:
        """log of each word's probability, summed over all segmentations."""
        out, plain = np.zeros(len(words)), logp.tolist()
        for at, block in self.by_length(words):
            if block.shape[1] > LONG_WORD + 1:
                out[at] = self._long_forward(block[0].tobytes(), plain)[-1]
            else:
                out[at] = self.forward(self.arcs(block), *block.shape, logp)[-1]
        return out

    def _walk(self, word: bytes, i: int) -> Iterator[tuple[int, int]]:
        """(end, piece) of the arcs that begin at ``i``."""
        number, prefixes, n, j = self.number, self.prefixes, len(word), i
        while j < n:
            j += 1
            part = word[i:j]
            if part in number:
                yield j, number[part]
            if part not in prefixes:
                return

    def _long_forward(self, word: bytes, logp: list[float]) -> array:
        alpha = array("d", [-math.inf]) * (len(word) + 1)
        alpha[0] = 0.0
        for i in range(len(word)):
            here = alpha[i]  # finite: every byte is a piece
            for j, piece in self._walk(word, i):
                alpha[j] = _add(alpha[j], here + logp[piece])
        return alpha

    def _long(self, word: bytes, logp: np.ndarray) -> float:
        return self._long_forward(word, logp.tolist())[-1]

    def _long_expected(self, word: bytes, logp: list[float], count: float, total: np.ndarray) -> None:
        """Adds to ``total`` what ``expected`` gives for one word, in time and memory linear in its length."""
        alpha = self._long_forward(word, logp)
        beta = array("d", [-math.inf]) * (len(word) + 1)
        beta[-1] = 0.0
        for i in range(len(word) - 1, -1, -1):
            here, left = -math.inf, alpha[i] - alpha[-1]
            for j, piece in self._walk(word, i):
                right = logp[piece] + beta[j]
                here = _add(here, right)
                total[piece] += count * math.exp(min(0.0, left + right))
            beta[i] = here

    def counts(self, words: list[bytes], count: np.ndarray, logp: np.ndarray) -> np.ndarray:
        total, plain = np.zeros(len(logp)), logp.tolist()
        for at, block in self.by_length(words):
            if block.shape[1] > LONG_WORD + 1:
                self._long_expected(block[0].tobytes(), plain, float(count[at[0]]), total)
            else:
                total += self.expected(self.arcs(block), *block.shape, logp, count[at])
        return total


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


@functools.lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    return Lattice(path)


def _maximise(expected: np.ndarray) -> np.ndarray:
    """Log probabilities of the pieces; a space in front ends the word before, so words' probabilities sum to one."""
    smooth = expected + SMOOTH
    return np.log(smooth / smooth.sum())


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    train: Counter = Counter()
    held: Counter = Counter()
    size = 0

    def flush() -> pa.RecordBatch:
        words = list(train.keys() | held.keys())
        out = pa.RecordBatch.from_arrays(
            [pa.array(words, pa.binary()), pa.array([train[w] for w in words], pa.int64()), pa.array([held[w] for w in words], pa.int64())],
            ["word", "c", "h"],
        )
        train.clear()
        held.clear()
        return out

    for batch in batches:
        for text, out in zip(batch.column(0), batch.column(1).to_pylist()):
            found = tokens(text.as_py())
            (held if out else train).update(found)
            size += sum(len(w) for w in found if len(w) > LONG_WORD)
            if len(train) + len(held) >= FLUSH_WORDS or size >= FLUSH_BYTES:
                yield flush()
                size = 0
    if train or held:
        yield flush()


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in larger batches, as the lattices of many words of one length cost less a word."""
    some, rows, size = [], 0, 0
    for batch in batches:
        some.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= GATHER_WORDS or size >= GATHER_BYTES:
            yield pa.concat_batches(some)
            some, rows, size = [], 0, 0
    if some:
        yield pa.concat_batches(some)


def _expect(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, logp = shared.value
        own = lattice(path or default_vocabulary())
        total = np.zeros(len(logp))
        for batch in _gathered(batches):
            total += own.counts(batch.column(0).to_pylist(), np.ones(batch.num_rows), logp)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(logp))), pa.array(total)], ["piece", "uses"])

    return run


def _rate(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, logp, discount, n_all, rest = shared.value
        own = lattice(path or default_vocabulary())
        for batch in _gathered(batches):
            found = own.likelihood(batch.column(0).to_pylist(), logp) + np.log(rest)
            whole = np.maximum(batch.column(1).to_numpy() - discount, 0) / max(n_all, 1)
            with np.errstate(divide="ignore"):
                found = np.logaddexp(found, np.log(whole)) / np.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], ["word", "c", "h", "logp"])

    return run


def _sum_up(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, base, logp, known = shared.value
        get, no = number.get, repeat(-1)
        for batch in batches:
            n, k, b, s, rare, uses = [], [], [], [], [], []
            for text in batch.column(3):
                words = tokens(text.as_py())
                ids = np.fromiter(map(get, words, no), dtype=np.int64, count=len(words))
                found = ids[ids >= 0]
                left = Counter([w for w, i in zip(words, ids.tolist()) if i < 0]) if len(found) < len(words) else {}
                n.append(len(words) + 1)
                k.append(int(known[found].sum()))
                b.append(float(base[found].sum()))
                s.append(float(logp[found].sum()))
                rare.append(list(left))
                uses.append(list(left.values()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(b, pa.float64()),
                 pa.array(s, pa.float64()), pa.array(rare, pa.list_(pa.binary())), pa.array(uses, pa.list_(pa.int32()))],
                ["rid", "__id", "held_out", "n_tokens", "k", "b", "s", "rare", "uses"],
            )

    return run


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Scores every text with two models learned from the training rows; one row out for each in.

    A row trains unless crc32 of its id as text leaves 1 on division by 5 (a null id: the
    empty text).  Tokens are words in ASCII lower case and one end.  ``base_score`` is the
    smoothed word model; ``score`` the log10 probability of the text as words with a space
    in front and an end, summed over all segmentations: the words' log-space forward
    recursions, as no piece reaches across a space.  A segmentation is into pieces of the
    vocabulary, or the whole word if the training rows have it.  The whole word has its
    count less a discount (n1 / (n1 + 2 n2), of words found once and twice), and what the
    discounts leave is the weight of the pieces, so the probabilities of all words and the
    end sum to one.

    The vocabulary file gives the pieces and their first scores.  Scores are refitted by
    five rounds of expectation-maximisation, each on all different training words.  Word
    counts and likelihoods are computed once for each different word and expected uses
    once a round, in parallel; texts look the most frequent words up in a bounded
    broadcast and join the rest.

    A null text counts as empty (the end alone); texts and words are scored whole, a long word
    in time linear in its length; repeated rows are scored each, ties need no breaking; without
    training rows the vocabulary's own scores hold; an empty table gives an empty result.
    """
    spark = df.sparkSession
    held = (F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1)
    source = df.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("__id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text")
    )
    counted = source.select("text", "held_out").mapInArrow(_count, "word binary, c long, h long")
    words = materialize(counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("h").alias("h")))
    ends = source.filter(~F.col("held_out")).count()
    sums = words.agg(
        F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v"),
        F.sum((F.col("c") == 1).cast("long")).alias("n1"), F.sum((F.col("c") == 2).cast("long")).alias("n2"),
    ).first()
    n_all, v_all = int(sums["n"] or 0) + ends, int(sums["v"] or 0) + (ends > 0)
    below = n_all + 0.5 * (v_all + 1)

    path, kinds = vocabulary, v_all - (ends > 0)
    own = lattice(path or default_vocabulary())
    logp, discount, rest, log_end = own.scores, 0.0, 0.5, float(np.log(0.5))
    if kinds:
        trained = words.filter("c > 0").select("word")
        for _ in range(WARM_ROUNDS + 1):
            shared = spark.sparkContext.broadcast((path, logp))
            uses = trained.mapInArrow(_expect(shared), "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toArrow()  # one row a piece
            total = np.zeros(len(logp))
            total[uses.column(0).to_numpy()] = uses.column(1).to_numpy()
            logp = _maximise(total)
            shared.unpersist()
        once, twice = int(sums["n1"] or 0), int(sums["n2"] or 0)
        discount = (once + 1) / (once + 2 * twice + 2)
        rest = discount * kinds / n_all
    if ends:
        log_end = float(np.log(ends / n_all))
    fitted = spark.sparkContext.broadcast((path, logp, discount, n_all, rest if kinds or not ends else 1e-9))
    rated = materialize(words.mapInArrow(_rate(fitted), "word binary, c long, h long, logp double"))
    release(words)

    frequent = rated.filter(F.octet_length("word") <= LONG_WORD).orderBy(F.desc(F.col("c") + F.col("h")), "word").limit(FREQUENT_WORDS).toArrow()
    c = frequent.column(1).to_numpy()
    lookup = spark.sparkContext.broadcast((
        {bytes(w): i for i, w in enumerate(frequent.column(0).to_pylist())},
        np.log10((c + 0.5) / below), frequent.column(3).to_numpy(), (c > 0).astype(np.int64),
    ))
    kind = df.schema[id_col].dataType.simpleString()
    texts = materialize(source.mapInArrow(
        _sum_up(lookup),
        f"rid long, __id {kind}, held_out boolean, n_tokens long, k long, b double, s double, rare array<binary>, uses array<int>",
    ))
    rare = texts.select("rid", F.inline(F.arrays_zip("rare", "uses"))).join(rated.select("word", "c", "logp"), F.col("rare") == F.col("word"))
    extra = rare.groupBy("rid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("uses")).otherwise(0)).cast("long").alias("k2"),
        F.sum(F.col("uses") * F.log10((F.col("c") + F.lit(0.5)) / F.lit(float(below)))).alias("b2"),
        F.sum(F.col("uses") * F.col("logp")).alias("s2"),
    )
    end_base, end_score = float(np.log10((ends + 0.5) / below)), log_end / float(np.log(10))
    zero = F.lit(0.0)
    return texts.drop("rare", "uses").join(extra, "rid", "left").select(
        F.col("__id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("k") + F.coalesce("k2", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("b") + F.coalesce("b2", zero) + F.lit(end_base)).alias("base_score"),
        (F.col("s") + F.coalesce("s2", zero) + F.lit(end_score)).alias("score"),
    )
