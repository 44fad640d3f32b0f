"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WORD, gapless, materialize, text_key

#: A group of equal texts is split if it holds more of a shard than this in any measure.
SPLIT_SHARE = 0.5
#: Into so many pieces, by a hash of the row's number.
PIECES = 64
#: Groups that one bucket packs, and the most buckets; a bucket is packed as a stream, so its size is not bounded.
GROUPS_PER_BUCKET = 2_000
MAX_BUCKETS = 512
#: Bundles for each shard, in all buckets and in one at least: finer ones even out better above.
BUNDLES, LEAST_BUNDLES = 64, 4
#: Rows that one task numbers, and the most such buckets a shard has: their offsets are broadcast.
ROWS_PER_SLOT_BUCKET, MAX_SLOT_BUCKETS = 50_000, 1024
DIMS = ["bytes", "tokens", "rows"]


def place(items: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """For each item (a row of shares of a bin's capacity) the bin where item . residual is highest.

    ``residual`` is updated in place.  Ties go to the first bin.
    """
    out = np.empty(len(items), dtype=np.int32)
    for i, item in enumerate(items):
        j = int((residual @ item).argmax())
        out[i] = j
        residual[j] -= item
    return out


def _packer(capacity: dict[int, list[float]], n_bins: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        residual: dict[int, np.ndarray] = {}
        for batch in batches:
            bins = np.empty(batch.num_rows, dtype=np.int32)
            vectors = np.stack([batch.column(batch.schema.names.index(d)).to_numpy() for d in DIMS], axis=1).astype(float)
            buckets = batch.column(batch.schema.names.index("bucket")).to_numpy()
            for b in np.unique(buckets):
                mine = np.flatnonzero(buckets == b)
                left = residual.setdefault(int(b), np.ones((n_bins, len(DIMS))))
                bins[mine] = place(vectors[mine] / np.maximum(capacity[int(b)], 1e-9), left)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bins)], [*batch.schema.names, "bundle"])

    return pack


def shard_documents(df: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Puts every row into a shard (0 .. n_shards - 1) so that bytes, tokens and rows are near equal.

    Returns id, ``size`` (UTF-8 bytes plus 8), ``text_crc32``, ``law``, ``shard``, ``slot`` and
    ``grown_shard`` (null under the law ``bytes``).

    Equal texts form a group, which is placed as one item; a group of more than half a
    shard in any measure cannot be and is split by a hash of its rows' numbers, whatever their
    ids.  Placing is done on
    two levels.  Groups are dealt to buckets by their hash; each bucket streams its groups,
    largest first, into several bundles a shard, choosing the one where the dot product of
    the group and the residual capacity is highest.  The driver then places the bundles
    (buckets x bundles of them) and the few groups too large for a bucket the same way.

    A null text counts as empty (size 8); null ids and repeated rows are rows like others;
    ties go to the first of equal shards; texts of any length are measured whole;
    an empty table gives an empty result; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("string")
    base = materialize(
        df.select(
            F.col(id_col).alias("__id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
            text_key(text).alias("g"),
            F.monotonically_increasing_id().alias("rid"),
        )
    )
    salt = F.pmod(F.xxhash64("rid"), F.lit(PIECES)).cast("int")
    base = base.withColumn("salt", salt)  # the written rows keep their numbers
    measured = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    totals = base.agg(*measured).first()
    n_rows = int(totals["rows"])
    capacity = np.array([max(float(totals[d] or 0), 1.0) for d in DIMS]) / n_shards

    pieces = base.groupBy("g", "salt").agg(*measured)
    summed = [F.sum(d).alias(d) for d in DIMS]
    over = " OR ".join(f"{d} > {SPLIT_SHARE * c}" for d, c in zip(DIMS, capacity))
    whole = materialize(pieces.groupBy("g").agg(*summed))
    # at most 3 * n_shards / SPLIT_SHARE groups are so large
    hot = F.broadcast(whole.filter(over).select("g", F.lit(True).alias("hot")))
    split = pieces.join(hot, "g").select("g", F.col("salt").alias("piece"), *DIMS)
    items = whole.filter(f"NOT ({over})").select("g", F.lit(-1).alias("piece"), *DIMS).union(split)

    n_items = whole.count()
    buckets = max(1, min(MAX_BUCKETS, -(-n_items // GROUPS_PER_BUCKET)))
    per_shard = max(LEAST_BUNDLES, -(-BUNDLES // buckets))
    n_bundles = per_shard * n_shards
    big = " OR ".join(f"{d} > {c / (2 * per_shard * buckets)}" for d, c in zip(DIMS, capacity))
    large = items.filter(big).toPandas()  # at most 3 * 2 * buckets * n_bundles of them
    dealt = items.filter(f"NOT ({big})").withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(buckets)).cast("int"))
    loads = dealt.groupBy("bucket").agg(*summed).collect()
    room = {r["bucket"]: [r[d] / n_bundles for d in DIMS] for r in loads}
    packed = materialize(
        dealt.repartition(buckets, "bucket")
        .sortWithinPartitions("bucket", F.desc("bytes"), "g")
        .mapInArrow(
            _packer(room, n_bundles),
            "g binary, piece int, bytes long, tokens long, rows long, bucket int, bundle int",
        )
    )
    bundles = packed.groupBy("bucket", "bundle").agg(*summed).toPandas()

    vectors = np.vstack([large[DIMS].to_numpy(float), bundles[DIMS].to_numpy(float)]) / capacity
    order = np.lexsort((np.arange(len(vectors)), -vectors.max(axis=1, initial=0.0)))
    shards = np.empty(len(vectors), dtype=np.int32)
    shards[order] = place(vectors[order], np.ones((n_shards, len(DIMS))))
    spark = df.sparkSession
    large_at = [(bytes(g), int(p), int(s)) for g, p, s in zip(large["g"], large["piece"], shards)]
    bundle_at = [(int(b), int(x), int(s)) for b, x, s in zip(bundles["bucket"], bundles["bundle"], shards[len(large):])]
    placed = (
        packed.join(F.broadcast(spark.createDataFrame(bundle_at, "bucket int, bundle int, shard int")), ["bucket", "bundle"])
        .select("g", "piece", "shard")
        .union(spark.createDataFrame(large_at, "g binary, piece int, shard int"))
    )
    rows = base.join(hot, "g", "left").withColumn("piece", F.when(F.col("hot"), F.col("salt")).otherwise(F.lit(-1)))
    sharded = rows.join(placed, ["g", "piece"]).select("__id", "size", "text_crc32", "tokens", "shard", "rid")
    per_slot = min(MAX_SLOT_BUCKETS, max(8, -(-n_rows // (n_shards * ROWS_PER_SLOT_BUCKET))))
    slotted = gapless(
        sharded,
        ["shard"],
        F.pmod(F.xxhash64(F.lit(7), "rid"), F.lit(per_slot)),
        ["rid"],
        "slot",
    )
    return slotted.select(
        F.col("__id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "tokens",
    )
