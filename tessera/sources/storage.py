"""Where managed tables live: Parquet folders, of which a version of a table is a list."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_own: dict[str, tempfile.TemporaryDirectory] = {}


def default_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share; a temporary folder only for a local session without it."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share, or give the engine a root")
    return "file://" + _own.setdefault(sc.applicationId, tempfile.TemporaryDirectory(prefix="tessera-tables-")).name


def write_part(df: DataFrame, root: str, table: str) -> str:
    """Writes rows of a table to a folder of their own; what was there before stays as it is."""
    path = f"{root}/{table}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def read_parts(spark: SparkSession, schema: StructType, paths: list[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


class Files:
    """Deletes folders of the shared file system, also once the session has been stopped."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def delete(self, path: str) -> None:
        target = self.jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.conf).delete(target, True)

    def at_exit(self, paths) -> None:
        """Deletes what the call ``paths`` names, if the driver's JVM still runs."""
        try:
            for p in paths():
                self.delete(p)
        except Exception:  # nothing is left to delete with
            pass


def backup(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def restore(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
