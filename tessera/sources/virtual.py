"""Virtual tables: Python data sources with filter push-down, and incremental reads of binary columns."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _SeriesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.start, self.stop = int(options.get("start", 0)), int(options.get("stop", 0))
        self.parts = int(options.get("partitions", 4))

    def pushFilters(self, filters):
        """Bounds on ``value`` narrow what is generated; other filters go back to Spark."""
        for f in filters:
            if getattr(f, "attribute", None) != ("value",) or not isinstance(getattr(f, "value", None), int):
                yield f
            elif isinstance(f, EqualTo):
                self.start, self.stop = max(self.start, f.value), min(self.stop, f.value)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.start = max(self.start, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self.stop = min(self.stop, f.value - isinstance(f, LessThan))
            else:
                yield f

    def partitions(self):
        n = self.stop - self.start + 1
        if n <= 0:
            return [_Range(0, -1)]
        step = -(-n // self.parts)
        return [_Range(a, min(a + step - 1, self.stop)) for a in range(self.start, self.stop + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple[int]]:
        for v in range(partition.low, partition.high + 1):
            yield (v,)


class SeriesSource(DataSource):
    """The integers from option ``start`` to ``stop``: a model for virtual tables."""

    @classmethod
    def name(cls) -> str:
        return "tessera_series"

    def schema(self) -> str:
        return "value long"

    def reader(self, schema) -> DataSourceReader:
        return _SeriesReader(self.options)


def create_module(spark: SparkSession, source: type[DataSource]) -> None:
    """Makes a module available to ``spark.read.format``."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)


def virtual_table(spark: SparkSession, source: type[DataSource], **options: object) -> DataFrame:
    create_module(spark, source)
    return spark.read.format(source.name()).options(**{k: str(v) for k, v in options.items()}).load()


def blob_read(column: Column | str, offset: int, n: int) -> Column:
    """``n`` bytes of a binary value from ``offset`` (from 0)."""
    return F.substring(F.col(column) if isinstance(column, str) else column, offset + 1, n)


def blob_write(column: Column | str, offset: int, data: bytes) -> Column:
    """The value with ``data`` written over it at ``offset``; its size stays, so data beyond the end is refused as NULL."""
    c = F.col(column) if isinstance(column, str) else column
    fits = F.octet_length(c) >= offset + len(data)
    return F.when(fits, F.overlay(c, F.lit(data), F.lit(offset + 1), F.lit(len(data))))
