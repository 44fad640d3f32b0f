"""The ordered key-value view of a table: lookup, scan, insert, update, delete by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.engine import Engine


class Tree:
    """A managed table seen as a map from an integer key to one value, in key order.

    Reads are filters that reach the Parquet statistics; each change is one rewritten version.
    """

    def __init__(self, engine: Engine, table: str):
        self.engine, self.table = engine, table
        if table.lower() not in engine.tables:
            engine.sql(f"CREATE TABLE {table} (key INTEGER PRIMARY KEY, value BLOB)")

    def lookup(self, key: int) -> DataFrame:
        return self.engine.table(self.table).df.filter(F.col("key") == key).select("value")

    def scan(self, key: int, n: int) -> DataFrame:
        """The first ``n`` pairs from ``key`` on."""
        return self.engine.table(self.table).df.filter(F.col("key") >= key).orderBy("key").limit(n)

    def insert(self, pairs: DataFrame) -> int:
        """Adds (key, value) rows; a key that is there is a conflict."""
        return self.engine.insert_rows(self.table, pairs.select("key", "value"))

    def update(self, pairs: DataFrame) -> int:
        """Adds (key, value) rows in place of those with the same key."""
        return self.engine.insert_rows(self.table, pairs.select("key", "value"), "REPLACE")

    def delete(self, key: int) -> int:
        self.engine.sql(f"DELETE FROM {self.table} WHERE key = ?1", [key])
        return self.engine.changes
