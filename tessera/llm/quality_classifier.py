"""Quality classifier: a weak-label model over heuristic labellers teaches a hashed linear scorer."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, release
from tessera.llm.words import _IS_SPACE, Words, mix64, text_chunks

GOOD, BAD = 1, -1
#: Features of the scorer, and how many rows (about) it is fitted on: a sample by hash of the id.
FEATURES = 1 << 14
SAMPLE_ROWS = 8_000
EM_ROUNDS = 200
THRESHOLD = 0.5


#: Labellers vote GOOD, BAD or 0 (abstains) on a text.  They overlap and none is right alone.
LABELLERS = ("symbols", "marked", "upper", "capital", "exclaims", "stop_words", "echoes", "variety", "sentences", "word_length", "length")
_STOPS = "The the of and to in a is Der der Die die und das ein den la le les de des et est que y el los en un".split()


def _among(characters: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(characters.encode())] = True
    return table


_SYMBOL, _MARK, _UPPER = _among("#*$%&|<>{}=~^\\_@"), _among("#*$%&|<>{}=~^\\_@!"), _among("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_CALL, _END, _PAUSE = _among("!?"), _among(".!?"), _among(",.")


def _stop_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(_STOPS).encode(), dtype=np.uint8)
    return Words(data, np.array([0, len(data)])).hashes()


def vote(words: Words) -> np.ndarray:
    """Of each text the votes of LABELLERS."""
    data, starts, ends, n = words.data, words.starts, words.ends, np.maximum(words.counts, 1)
    own, texts = words.hashes(), words.text_of()
    letters = (data & 0xC0) != 0x80  # code points begin there
    chars = np.maximum(words.per_text(letters & ~_IS_SPACE[data]), 1)
    last = data[ends - 1]
    pauses = np.append(np.flatnonzero(_PAUSE[data]), len(data))
    stems = np.minimum(ends, pauses[np.searchsorted(pauses, starts)])  # a stop word may have a comma or full stop after it
    stops = words.words_per_text(np.isin(words.hashes_of(starts, stems), _stop_hashes())) / n
    twice = np.zeros(len(own), dtype=bool)
    twice[:-1] = (own[1:] == own[:-1]) & (texts[1:] == texts[:-1])
    echoes = words.words_per_text(twice) / n
    closes = words.words_per_text(_END[last]) / n
    long = ends - starts >= 2
    capital = words.words_per_text(long & _UPPER[data[starts]] & _UPPER[data[np.minimum(starts + 1, len(data) - 1)]]) / n if len(starts) else np.zeros(len(n))
    order = np.lexsort((own, texts))
    fresh = np.ones(len(own), dtype=bool)
    fresh[1:] = (own[order][1:] != own[order][:-1]) | (texts[order][1:] != texts[order][:-1])
    variety = np.maximum(np.bincount(texts[order][fresh], minlength=len(n)), 1) / n
    length = chars / n
    bad_good = {
        "symbols": (words.per_text(_SYMBOL[data]) / n > 0.3, False),
        "marked": (words.words_per_text(_MARK[last]) / n > 0.25, False),
        "upper": (words.per_text(_UPPER[data]) / chars > 0.4, False),
        "capital": (capital > 0.4, False),
        "exclaims": (words.per_text(_CALL[data]) / n > 0.25, False),
        "stop_words": ((stops < 0.03) & (n >= 20), (stops > 0.1) & (variety > 0.2)),
        "echoes": ((echoes > 0.2) & (n >= 10), False),
        "variety": ((variety < 0.15) & (n >= 20), (variety > 0.3) & (n >= 2)),
        "sentences": ((closes < 0.01) & (n > 50) | (closes > 0.5) & (n > 20), (closes > 0.03) & (closes < 0.4) & (echoes < 0.1)),
        "word_length": (((length < 2) | (length > 14)) & (n >= 5), False),
        "length": (n < 2, False),
    }
    return np.stack([np.where(bad, BAD, np.where(good, GOOD, 0)) for bad, good in (bad_good[k] for k in LABELLERS)], axis=1)


def fit_labellers(votes: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over vote patterns: (posterior of good for each pattern, accuracies, prior).

    Labellers are independent given the class; each has its own chance of every vote in
    each class.  The patterns with their counts are all that the data have to say, so the
    fit covers every document.  It starts at the majority of the votes cast; none count as good.
    """
    if not len(votes):
        return np.zeros(0), np.zeros((votes.shape[1], 2, 3)), 0.5
    bad, good = (votes == BAD).sum(axis=1), (votes == GOOD).sum(axis=1)
    post = np.where(bad == 0, 0.95, np.clip(0.5 + 0.15 * (good - 1.5 * bad), 0.05, 0.95))
    index, m = votes + 1, votes.shape[1]
    chance, prior = np.zeros((m, 2, 3)), 0.5
    for _ in range(rounds):
        weight = np.stack([counts * (1 - post), counts * post])
        prior = (weight[1].sum() + 1) / (weight.sum() + 2)
        for j in range(m):
            for c in range(2):
                tally = np.bincount(index[:, j], weights=weight[c], minlength=3) + 0.5
                chance[j, c] = tally / tally.sum()
        logs = np.log([1 - prior, prior])[:, None] + sum(np.log(chance[j][:, index[:, j]]) for j in range(m))
        now = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        moved, post = np.abs(now - post).max(), now
        if moved < 1e-9:
            break
    return post, chance, float(prior)


_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[128:] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs: each word's shape, that and the next word's, its last two bytes, and whether it repeats its neighbour."""
    texts = words.text_of()
    own, shape = words.hashes(), words.hashes(_SHAPE)
    tails = np.zeros(len(own), dtype=np.uint64)
    for k in range(1, 3):
        at = words.ends - k
        tails = tails * np.uint64(257) + np.where(at >= words.starts, _SHAPE[words.data[np.maximum(at, 0)]], 0).astype(np.uint64)
    same, after = np.zeros(len(own), dtype=np.uint64), np.zeros(len(own), dtype=np.uint64)
    if len(own) > 1:
        joined = texts[1:] == texts[:-1]
        same[1:] = (own[1:] == own[:-1]) & joined
        after[:-1] = np.where(joined, shape[1:], 0)
    kinds = [shape, mix64(shape * np.uint64(3) + after), mix64(tails + np.uint64(1 << 40)), mix64(same + np.uint64(1 << 50))]
    mask = np.uint64(FEATURES - 1)
    return np.tile(texts, len(kinds)), np.concatenate([k & mask for k in kinds]).astype(np.int64)


def train_scorer(row: np.ndarray, col: np.ndarray, share: np.ndarray, labels: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on hashed shares (of feature ``col`` in ``row``) with soft labels, the classes weighted alike; full-batch Adam."""
    if not len(labels):
        return np.zeros(FEATURES), 0.0
    val = (share * 10).astype(np.float32)
    by_row, by_col = np.argsort(row, kind="stable"), np.argsort(col, kind="stable")
    cells = [(idx[o], val[o], *np.unique(key[o], return_index=True)) for o, key, idx in ((by_row, row, col), (by_col, col, row))]
    (row_cols, row_vals, rows, row_at), (col_rows, col_vals, cols, col_at) = cells
    y = np.clip(labels, 0.0, 1.0)
    weight = np.where(y >= 0.5, 0.5 / max(1, (y >= 0.5).sum()), 0.5 / max(1, (y < 0.5).sum()))
    w, bias = np.zeros(FEATURES), 0.0
    m, v = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
    z, grad = np.zeros(len(y)), np.zeros(FEATURES + 1)
    for t in range(1, rounds + 1):
        z[rows] = np.add.reduceat(w.astype(np.float32)[row_cols] * row_vals, row_at)
        err = (1 / (1 + np.exp(-np.clip(z + bias, -50, 50))) - y) * weight
        grad[:-1], grad[-1] = 1e-4 * w, err.sum()
        grad[cols] += np.add.reduceat(err.astype(np.float32)[col_rows] * col_vals, col_at)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    return w * 10, float(bias)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts with a flag: how many have each pattern of votes (rows without cols), and features of those flagged."""
    powers = 3 ** np.arange(len(LABELLERS))
    for batch in batches:
        for a, b, data, bounds in text_chunks(batch.column(0)):
            words = Words(data, bounds)
            codes = (vote(words) + 1) @ powers
            kinds, n = np.unique(codes, return_counts=True)
            chosen = np.flatnonzero(batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False).astype(bool) & (words.counts > 0))
            cols, vals = [None] * len(kinds), [None] * len(kinds)
            if len(chosen):
                text, feature = features(words)
                wanted = np.isin(text, chosen)
                pair, uses = np.unique(text[wanted] * FEATURES + feature[wanted], return_counts=True)
                share = uses / words.counts[pair // FEATURES]
                for i in chosen.tolist():
                    x, y = np.searchsorted(pair, (i * FEATURES, (i + 1) * FEATURES))
                    cols.append((pair[x:y] % FEATURES).astype(np.int32))
                    vals.append(share[x:y].astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([kinds, codes[chosen]])), pa.array(np.concatenate([n, np.zeros(len(chosen), dtype=np.int64)])),
                 pa.array(cols, pa.list_(pa.int32())), pa.array(vals, pa.list_(pa.float32()))],
                ["code", "n", "cols", "vals"],
            )


def _score(shared):
    """The last column is the text; in its place comes its score."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = shared.value
        for batch in batches:
            scores = []
            for _, _, data, bounds in text_chunks(batch.column(batch.num_columns - 1)):
                words = Words(data, bounds)
                text, feature = features(words)
                total = np.bincount(text, weights=w[feature], minlength=len(bounds) - 1)
                n = words.counts
                z = total / np.maximum(n, 1) + bias
                scores.append(np.where(n > 0, 1 / (1 + np.exp(-np.clip(z, -50, 50))), 0.0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(np.concatenate(scores) if scores else np.zeros(0))], [*batch.schema.names[:-1], "quality_score"]
            )

    return score


def classify_quality(
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    columns: list[str] | None = None,
    sample_rows: int = SAMPLE_ROWS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Adds ``quality_score`` (0 to 1) and ``kept`` to ``columns`` (default: all) of every row.

    Heuristic labellers vote on every text; expectation-maximisation over all vote
    patterns estimates how far each can be trusted; the posterior then labels a sample of
    about ``sample_rows`` rows, chosen by hash of id and length, on which the driver fits a
    linear scorer over hashed word features.  That scorer judges every row.  Texts are read
    twice: for votes and the sample's features, and for scores.

    Texts are judged whole, however long; a score of ``threshold`` is kept.  A null or empty
    text, or one without words, scores 0 and is not kept.  Repeated rows score alike; null ids
    are fine; an empty table gives an empty result.  Columns named quality_score or kept are replaced.
    """
    spark = df.sparkSession
    text = F.col(text_col).cast("string")
    rows = df.count()
    share = min(1.0, sample_rows / max(1, rows))
    flag = F.pmod(F.xxhash64(F.lit(4), F.col(id_col), F.length(F.coalesce(text, F.lit("")))), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    found = materialize(df.select(text.alias("text"), flag.alias("flag")).mapInArrow(_survey, "code long, n long, cols array<int>, vals array<float>"))
    table = found.filter("cols IS NULL").groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # at most 3 ** labellers rows
    codes, counts = table.column(0).to_numpy(), table.column(1).to_numpy().astype(float)
    votes = codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1
    post, chance, prior = fit_labellers(votes, counts)

    sample = found.filter("cols IS NOT NULL").select("code", "cols", "vals").toArrow().combine_chunks()
    release(found)
    order = np.argsort(codes)
    labels = post[order][np.searchsorted(codes[order], sample.column(0).to_numpy())]
    lists = sample.column(1).combine_chunks()
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    w, bias = train_scorer(row, lists.flatten().to_numpy().astype(np.int64), sample.column(2).combine_chunks().flatten().to_numpy().astype(float), labels)
    shared = spark.sparkContext.broadcast((w, bias))
    kept = [c for c in (df.columns if columns is None else columns) if c not in ("quality_score", "kept")]
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    scored = df.select(*kept, text.alias(f"text_{uuid.uuid4().hex}")).mapInArrow(_score(shared), f"{fields}, quality_score double")
    return scored.withColumn("kept", F.col("quality_score") >= F.lit(threshold))
