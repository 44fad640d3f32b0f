"""Helpers shared by the operators of this package."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space of every contract here: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
#: A word, for Java's, Python's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"

_own_dirs: dict[str, tempfile.TemporaryDirectory] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session without that setting (a local test) gets a temporary folder.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = _own_dirs.setdefault(sc.applicationId, tempfile.TemporaryDirectory(prefix="tessera-"))
    return f"file://{own.name}"


#: What holds while a table is written: a query's shuffle files go at its end, and Python workers take
#: texts in batches of so many bytes, as the buffers of larger ones count several times beside the heap.
_WHILE_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def materialize(df: DataFrame) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back.

    This cuts the lineage at a table that survives the loss of any executor, and
    pins rows that later steps read more than once; the query's shuffle files go with its end.
    The table goes by ``release`` or when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in _WHILE_WRITING}
    for k, v in _WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    remove_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    weakref.finalize(out, _paths.pop, id(out), None)
    return out


#: Where live tables from ``materialize`` are.
_paths: dict[int, str] = {}


def release(*tables: DataFrame) -> None:
    """Deletes tables from ``materialize`` that nothing will read again: every reader has itself been written."""
    for t in tables:
        path = _paths.pop(id(t), None)
        if path:
            remove(t.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    _delete(*_files(spark), path)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    atexit.register(_delete, *_files(spark), path)


def _files(spark: SparkSession) -> tuple:
    """What deletes files, also once the session has been stopped."""
    return spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()


def _delete(jvm, conf, path: str) -> None:
    try:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    except Exception:  # the driver's JVM has ended
        pass


def text_key(text: Column) -> Column:
    """128 bits that stand for a whole text; a null text counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def set_aside(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns that begin with two underscores under names that nothing here uses, and the old names' new ones."""
    mark = uuid.uuid4().hex
    names = {c: f"own_{mark}_{i}" for i, c in enumerate(df.columns) if c.startswith("__")}
    return df.withColumnsRenamed(names) if names else df, names


def put_back(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Gives the columns of ``set_aside`` their names again."""
    return df.withColumnsRenamed({new: old for old, new in names.items()}) if names else df


def gapless(df: DataFrame, by: list[str], bucket: Column, order: list, out: str) -> DataFrame:
    """Adds ``out``: numbers from 0 without gaps within each ``by``, in order of (bucket, order).

    No task ever holds a whole group: rows are numbered within (by, bucket), and the
    buckets' sizes, a table of (groups x buckets) rows, give the offsets.  ``bucket``
    must depend on the row alone, so ``df`` may be computed twice.
    """
    marked = df.withColumn("__b", bucket.cast("long"))
    sizes = marked.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)],
        F.col("__b").alias("__b2"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__at"),
    )
    on = F.col("__b") == F.col("__b2")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    ranked = marked.withColumn("__r", F.row_number().over(Window.partitionBy(*by, "__b").orderBy(*order)))
    return (
        ranked.join(F.broadcast(starts), on)
        .withColumn(out, F.col("__at") + F.col("__r") - 1)
        .drop("__b", "__b2", "__n", "__at", "__r", *[f"__k{i}" for i in range(len(by))])
    )


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of undirected ``edges`` (src, dst); component: the smallest node reachable.

    First every node is replaced by the least of itself and its neighbours: whoever is
    linked still is, and of stars nothing is left.  What remains goes through the large-star
    and small-star steps of Kiveris et al. (2014): each is one aggregation over the edges,
    the number of edges never grows, and O(log n) rounds settle.  Minima are combined
    before they are shuffled; the joins are of edges with one row a node, so Spark's
    adaptive skew join splits a hub's edges.  ``edges`` is read three times: pass a written table.
    """
    pairs = edges.filter("src <> dst").select("src", "dst")
    both = pairs.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(pairs.select(F.col("dst").alias("u"), F.col("src").alias("v")))
    parents = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("parent")))
    joined = pairs.join(parents.toDF("src", "a"), "src").join(parents.toDF("dst", "b"), "dst").filter("a <> b")
    now = materialize(joined.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    for _ in range(max_rounds):
        state = now.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if state == last or not state["n"]:
            break
        last = state
        sym = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        # large star: every larger neighbour of a node is linked to the node's minimum
        large = sym.filter("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours are linked to the smallest of them
        floor = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        joined = large.join(floor, large.u == floor.c)
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            joined.select("u", F.col("m").alias("v"))
        )
        before, now = now, materialize(small.filter("u <> v").distinct())
        release(before)
    else:
        raise RuntimeError("components have not settled")
    if not state["n"]:
        return parents.withColumnRenamed("parent", "component")
    # settled: every edge leads to its component's least node
    found = parents.join(now.toDF("parent", "component"), "parent", "left")
    return found.select("node", F.coalesce("component", "parent").alias("component"))
