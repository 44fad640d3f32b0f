"""Streams into managed tables: each micro-batch is one conflict-aware change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.engine import Engine


def write_to_table(engine: Engine, table: str, policy: str = "REPLACE") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that inserts a batch under a conflict policy.

    With REPLACE or IGNORE and a key a batch that is delivered twice changes nothing the
    second time.
    """

    def batch(rows: DataFrame, number: int) -> None:
        engine.insert_rows(table, rows, policy)

    return batch


def apply_changes(engine: Engine, table: str, key: str, op: str = "op", order: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for change records: rows whose ``op`` is 'D' are deleted by key, others replaced.

    Of several changes of a key in a batch the one with the largest ``order`` holds; without
    that column the last by partition and place, which is their order in one partition only.
    """

    def batch(rows: DataFrame, number: int) -> None:
        place = F.monotonically_increasing_id()
        placed = rows.withColumn("__at", F.struct(F.col(order), place) if order else place)
        last = placed.groupBy(key).agg(F.max_by(F.struct(*rows.columns), "__at").alias("r")).select("r.*")
        if order and order.lower() not in [c["name"].lower() for c in engine.table(table).columns]:
            last = last.drop(order)
        last.persist()
        try:
            engine.insert_rows(table, last.filter(F.col(op) != "D").drop(op), "REPLACE")
            gone = last.filter(F.col(op) == "D").select(key)
            if not gone.isEmpty():
                view = f"tessera_stream_{table}"
                engine.register(view, gone)
                engine.sql(f"DELETE FROM {table} WHERE {key} IN (SELECT {key} FROM {view})")
        finally:
            last.unpersist()

    return batch
