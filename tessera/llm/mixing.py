"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import put_back, set_aside

#: Below so many sources their table (some hundred bytes a row) is broadcast; beyond, it is joined with salt.
BROADCAST_SOURCES = 20_000
SALTS = 32
#: The global order is cut by the leading bits of the shuffle key into ranges of about so many rows, a task each, so many at least and at most.
ROWS_PER_RANGE, LEAST_RANGES, MAX_RANGES = 32_768, 16, 1 << 18


def _hex_digits(seed: str, digits: int, *parts: Column) -> Column:
    named = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(named), 1, digits), 16, 10).cast("long")


def uniform(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) with 52 random bits, decided by the seed and the parts alone."""
    return (_hex_digits(f"u{seed}", 13, *parts) + F.lit(0.5)) / F.lit(float(1 << 52))


def _with_cdf(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in parts:
        cdfs = []
        for rate in rows["__rate"]:
            if rate <= 0:
                cdfs.append([1.0])
                continue
            k = np.arange(int(rate + 12 * np.sqrt(rate) + 40))
            steps = np.log(rate) - np.log(np.maximum(k, 1))
            steps[0] = -rate
            cdfs.append(np.cumsum(np.exp(np.cumsum(steps))))
        yield rows.assign(__cdf=cdfs)


def source_rates(df: DataFrame, source_col: str, weights: Mapping[str | None, float] | None, total: int | None, temper: float) -> DataFrame:
    """(__source, __n, __rate, __cdf): the rate is the mean number of times that a row of the source is to appear."""
    spark = df.sparkSession
    counts = df.groupBy(F.col(source_col).alias("__source")).agg(F.count(F.lit(1)).alias("__n"))
    if weights is None:
        counts = counts.withColumn("__w", F.pow(F.col("__n").cast("double"), F.lit(temper)))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "s string, w double")
        counts = (
            counts.join(given, F.col("__source").eqNullSafe(F.col("s")), "left")
            .withColumn("__w", F.coalesce("w", F.lit(0.0)))
            .drop("s", "w")
        )
    sums = counts.agg(F.sum("__w").alias("w"), F.sum("__n").alias("n"), F.count(F.lit(1)).alias("k")).first()
    want, all_w = float(total if total is not None else sums["n"] or 0), float(sums["w"] or 0.0)
    rate = F.col("__w") / F.lit(all_w or 1.0) * F.lit(want) / F.col("__n")
    kind = df.schema[source_col].dataType.simpleString()
    rates = counts.select("__source", "__n", rate.alias("__rate")).mapInPandas(
        _with_cdf, f"__source {kind}, __n long, __rate double, __cdf array<double>"
    )
    rates.n_sources, rates.n_rows = int(sums["k"]), int(sums["n"] or 0)
    return rates


def mix_sources(
    df: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    total: int | None = None,
    source_col: str = "source",
    id_col: str = "doc_id",
    seed: int = 17,
    temper: float = 0.5,
) -> DataFrame:
    """Repeats each row a Poisson number of times so that sources reach their weights, shuffled globally.

    ``weights`` gives each source's share of the ``total`` rows (default: as many rows as
    come in); None takes the share in proportion to rows ** ``temper``.  A source without
    a weight gets no rows.  The count is the inverse of the Poisson distribution at a
    uniform number hashed from the seed and the id: the same id always gets the same
    count, on any cluster.  Adds ``replica`` (from 0) and ``position`` (the place in the
    global order, gapless from 0), and returns partitions and their rows in that order.

    Each row is moved once, to the task of its range of keys, which sorts it; the ranges'
    sizes, counted without the other columns, say where each range's positions begin.

    A null source is a source of its own; a null id hashes as the word null; repeated rows
    are replicated each, and among replicas with one id the order is open; texts are moved
    whole; an empty table gives an empty result.  Columns of ``df`` named replica or position are replaced.
    """
    df, own = set_aside(df.drop("replica", "position"))
    source_col, id_col = own.get(source_col, source_col), own.get(id_col, id_col)
    rates = source_rates(df, source_col, weights, total, temper)
    n_rows = rates.n_rows if total is None else total
    u = uniform(seed, F.col(id_col))
    if rates.n_sources <= BROADCAST_SOURCES:
        joined = df.join(F.broadcast(rates), F.col(source_col).eqNullSafe(F.col("__source")))
    else:
        salted = rates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = df.withColumn("__s", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int")).join(
            salted, F.col(source_col).eqNullSafe(F.col("__source")) & (F.col("__s") == F.col("__salt"))
        ).drop("__s", "__salt")
    copies = joined.withColumn("__copies", F.size(F.filter("__cdf", lambda c: c <= u))).drop("__cdf", "__rate", "__n", "__source")
    rows = (
        copies.filter("__copies > 0")
        .withColumn("replica", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
        .drop("__copies")
        .withColumn("__key", _hex_digits(f"s{seed}", 15, F.col(id_col), F.col("replica")))
    )
    ranges = LEAST_RANGES
    while ranges < MAX_RANGES and ranges * ROWS_PER_RANGE < n_rows:
        ranges *= 2
    bucket = F.shiftright("__key", 60 - ranges.bit_length() + 1).cast("int")
    sizes = rows.groupBy(bucket.alias("__range")).agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = sizes.select("__range", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__at"))
    # the partition's number is the range: the sort's order gives the places in it
    ordered = rows.repartitionById(ranges, bucket).sortWithinPartitions("__key", id_col, "replica").withColumn("__i", F.monotonically_increasing_id())
    placed = ordered.join(F.broadcast(starts), F.shiftright("__i", 33) == F.col("__range"))
    placed = placed.withColumn("position", F.col("__at") + F.col("__i").bitwiseAND(F.lit((1 << 33) - 1)))
    return put_back(placed.drop("__key", "__i", "__range", "__at"), own)


def mix_sql(seed: int = 17, temper: float = 0.5) -> str:
    """The default mix of ``documents`` as DuckDB SQL."""
    return f"""
WITH c AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {temper}) AS w FROM documents GROUP BY source),
r AS (SELECT source, w / (SELECT sum(w) FROM c) * (SELECT sum(n) FROM c)::DOUBLE / n AS rate FROM c),
k AS (SELECT source, rate, k,
        sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
      FROM r, range(0, 80) AS t(k)),
d AS (SELECT doc_id, text, source,
        (('0x' || substr(md5('u{seed}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
      FROM documents),
n AS (SELECT d.doc_id, any_value(d.text) AS text, any_value(d.source) AS source, count(*) AS copies
      FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source AND k.cdf <= d.u GROUP BY d.doc_id),
e AS (SELECT doc_id, text, source, unnest(range(0, copies))::INTEGER AS replica FROM n),
h AS (SELECT *, ('0x' || substr(md5('s{seed}:' || doc_id || ':' || replica), 1, 15))::BIGINT AS key FROM e)
SELECT doc_id, source, text, replica, row_number() OVER (ORDER BY key, doc_id, replica) - 1 AS position FROM h"""
