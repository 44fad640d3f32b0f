"""Delimited text: import as the shell does it, and export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.lexer import SqlError


def read_delimited(spark: SparkSession, path: str, columns: list[str], separator: str = "|") -> DataFrame:
    """Lines split at the separator, without quoting, all text; a line of another width fails the whole import."""
    import re

    if not separator:
        raise SqlError("non-null separator required for import")
    lines = spark.read.text(path)
    parts = F.split("value", re.escape(separator), -1)
    bad = lines.filter(F.size(parts) != len(columns)).limit(1).collect()
    if bad:
        raise SqlError(f"expected {len(columns)} columns of data: {bad[0][0]!r}")
    return lines.select(*[parts[i].alias(c) for i, c in enumerate(columns)])


def import_delimited(engine, path: str, table: str, separator: str = "|") -> int:
    """All lines go in, or none."""
    t = engine.table(table)
    return engine.insert_rows(table, read_delimited(engine.spark, path, [c["name"] for c in t.columns], separator))


def write_delimited(df: DataFrame, path: str, separator: str = "|", header: bool = False, null_text: str = "", quoted: bool = False) -> None:
    """One folder of text files, written in parallel."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(null_text)) for c in df.columns]
    if quoted:
        df.select(*[c.alias(n) for c, n in zip(cells, df.columns)]).write.csv(path, sep=separator, header=header, mode="overwrite")
        return
    lines = df.select(F.array_join(F.array(*cells), separator).alias("value"))
    if header:
        spark = df.sparkSession
        lines = spark.createDataFrame([(separator.join(df.columns),)], "value string").coalesce(1).union(lines)
    lines.write.mode("overwrite").text(path)
