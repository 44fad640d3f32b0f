"""The engine: a session that takes the dialect's statements and runs them as Spark plans."""

from __future__ import annotations

import atexit
import copy
import uuid
import weakref
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.shims import COLLATIONS, affinity, quote, value
from tessera.plans.compiler import ROWID, Compiler, Scope, Source, ident
from tessera.plans.lexer import SqlError, split_statements
from tessera.plans.parser import parse
from tessera.sources.storage import Files, default_root, read_parts, write_part
from tessera.sources.virtual import SeriesSource, virtual_table


class ConstraintError(SqlError):
    """A row that a constraint does not allow."""


_SPARK = {"int": T.LongType(), "real": T.DoubleType(), "text": T.StringType(), "blob": T.BinaryType(), "numeric": T.DoubleType()}
_RETURNS = {"int": "bigint", "real": "double", "text": "string", "blob": "binary"}


def kind_of(t: T.DataType) -> str:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "real"
    if isinstance(t, T.StringType):
        return "text"
    if isinstance(t, T.BinaryType):
        return "blob"
    if isinstance(t, T.BooleanType):
        return "bool"
    return "time" if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)) else "null" if isinstance(t, T.NullType) else "any"


@dataclass
class Table:
    name: str
    df: DataFrame
    columns: list[dict]
    view: str
    managed: bool = True
    temp: bool = False
    sql: str = ""
    unique: list[tuple[list[str], str]] = field(default_factory=list)  # columns, policy
    checks: list = field(default_factory=list)
    foreign: list[tuple[list[str], dict]] = field(default_factory=list)
    key: str | None = None  # the column that is the rowid
    parts: list[tuple[str, int]] = field(default_factory=list)  # folder, how often its rows were merged
    top: int | None = None  # the largest rowid, if known
    module: str | None = None  # of a virtual table
    auto: int | None = None  # AUTOINCREMENT: the largest rowid that ever was


#: So many parts of one age are merged into one, so appends cost their own rows and a logarithm.
MERGE_PARTS = 16


def number_rows(df: DataFrame, name: str, start: int) -> DataFrame:
    """Adds start, start + 1, ...: places within partitions plus the sizes of the partitions before, no single task.

    ``df`` is read twice and must be the same both times: a written table, or some of its rows.
    """
    marked = df.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    sizes = sorted((r["__p"], r["count"]) for r in marked.groupBy("__p").count().collect())  # a row a partition
    offsets, at = [], start
    for p, n in sizes:
        offsets.append((p, at))
        at += n
    known = df.sparkSession.createDataFrame(offsets, "__q int, __o long")
    inside = F.col("__i") - F.shiftleft(F.col("__p").cast("long"), 33)
    return marked.join(F.broadcast(known), F.col("__p") == F.col("__q")).withColumn(name, F.col("__o") + inside).drop("__p", "__i", "__q", "__o")


class Engine:
    """Tables, views, transactions and functions of one connection.

    Registered tables (Parquet or DataFrames) are read in place.  Tables that statements
    create are managed: a version is a list of Parquet folders under ``root``.  INSERT adds a
    folder, UPDATE and DELETE write the table anew in one pass, and the change is a switch to
    the new list, so rollback and savepoints are pointers to earlier ones.  COMMIT deletes the
    versions that only the transaction saw, VACUUM all that are not current, and the end of
    the process what is left; DataFrames that read a deleted version no longer can.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, widen: bool = False):
        self.spark, self._root, self.widen = spark, root, widen
        self.tables: dict[str, Table] = {}
        self.views: dict[str, tuple[dict, str]] = {}
        self.indexes: dict[str, dict] = {}
        self.triggers: dict[str, dict] = {}
        self.hooks: list[tuple[str, str, Callable]] = []
        self.udfs: dict[tuple[str, int | None], tuple[str, str]] = {}
        self.aggregates: dict[str, dict[int | None, tuple[str, str]]] = {}
        self.overloads: dict[tuple[str, str], tuple[str, str]] = {}
        self.attached: list[str] = []
        self.last_insert_rowid = self.changes = self.total_changes = 0
        self.foreign_keys = False
        self._stack: list[tuple[str, tuple]] = []
        self._fts: dict[str, object] = {}
        self._expanding: set[str] = set()
        self._id = id(self)
        self.collations = dict(COLLATIONS)
        self.modules: dict[str, Callable[..., DataFrame]] = {
            "series": lambda start="0", stop="0": virtual_table(self.spark, SeriesSource, start=start, stop=stop)
        }
        self.stats: dict[str, int] = {}
        self._owned: set[str] = set()
        self._scratch: list[str] = []
        self._depth = 0
        self._postings: dict[str, str] = {}
        self._failure: str | None = None
        self._started: set[str] = set()
        self._deferred: list[tuple[str, list[str], dict]] = []
        self._files, self._home = Files(spark), ""

    # catalog

    @property
    def root(self) -> str:
        """The engine's own folder: gone when the process ends, but for the current tables under a root that was given."""
        if not self._home:
            self._home = f"{(self._root or default_root(self.spark)).rstrip('/')}/engine-{uuid.uuid4().hex}"
            held, home = weakref.ref(self), self._home
            last = (lambda: held()._owned - held()._live() if held() else []) if self._root else (lambda: [home])
            atexit.register(self._files.at_exit, last)
        return self._home

    def register(self, name: str, data: DataFrame | str) -> None:
        """A table that is read in place; its columns keep their Spark types."""
        df = self.spark.read.parquet(data) if isinstance(data, str) else data
        view = f"tessera_{self._id}_{name}".replace(".", "_")
        df.createOrReplaceTempView(view)
        columns = [{"name": f.name, "type": kind_of(f.dataType).upper(), "collate": None} for f in df.schema]
        self.tables[name.lower()] = Table(name, df, columns, view, managed=False)

    def register_folder(self, folder: str, names: list[str]) -> Engine:
        for n in names:
            self.register(n, f"{folder}/{n}.parquet")
        return self

    def _lookup(self, name: str) -> str:
        low = name.lower()
        for prefix in ("main.", "temp."):
            if low.startswith(prefix):
                low = low[len(prefix) :]
        return low

    def table(self, name: str) -> Table:
        found = self.tables.get(self._lookup(name))
        if not found:
            raise SqlError(f"no such table: {name}")
        return found

    def resolve(self, name: str) -> tuple[str, list[tuple[str, str]], str | None]:
        """(what to read, columns, the rowid column) of a table or view."""
        low = self._lookup(name)
        if low in ("sqlite_master", "sqlite_temp_master"):
            df = self.master(low == "sqlite_temp_master")
            df.createOrReplaceTempView(f"tessera_{self._id}_{low}")
            return f"tessera_{self._id}_{low}", [(f.name, kind_of(f.dataType)) for f in df.schema], None
        if low == "sqlite_stat1":
            if not self.stats:
                raise SqlError("no such table: sqlite_stat1")
            rows = [(n, None, str(k)) for n, k in self.stats.items()]
            self.spark.createDataFrame(rows, "tbl string, idx string, stat string").createOrReplaceTempView(f"tessera_{self._id}_{low}")
            return f"tessera_{self._id}_{low}", [("tbl", "text"), ("idx", "text"), ("stat", "text")], None
        if low in self.views:
            if low in self._expanding:
                raise SqlError(f"view {name} is circularly defined")
            self._expanding.add(low)
            try:
                sql, columns, _ = Compiler(self).select(self.views[low][0])
            finally:
                self._expanding.discard(low)
            return f"({sql})", columns, None
        t = self.table(name)
        columns = [(f.name, kind_of(f.dataType)) for f in t.df.schema if f.name != ROWID]
        rowid = t.key or (ROWID if ROWID in t.df.columns else None)
        return ident(t.view), columns, rowid

    def master(self, temp: bool = False) -> DataFrame:
        rows = [("table", t.name, t.name, 0, t.sql) for t in self.tables.values() if t.temp == temp]
        if not temp:
            rows += [("view", n, n, 0, f"CREATE VIEW {n} AS {s}") for n, (_, s) in self.views.items()]
            rows += [("index", n, i["table"], 0, i["sql"]) for n, i in self.indexes.items()]
            rows += [("trigger", n, t["table"], 0, t["sql"]) for n, t in self.triggers.items()]
        return self.spark.createDataFrame(rows, "type string, name string, tbl_name string, rootpage long, sql string")

    def has_index(self, name: str) -> bool:
        return name.lower() in self.indexes

    def collation_of(self, column: str) -> str | None:
        found = {c.get("collate") for t in self.tables.values() for c in t.columns if c["name"].lower() == column.lower()}
        return found.pop() if len(found) == 1 else None

    def match(self, compiler: Compiler, column, pattern, scope: Scope | None) -> str:
        """MATCH on a full-text table: the rowids that the full-text plan finds."""
        known, query = compiler.constant(pattern)
        if column[0] != "col" or scope is None or not known:
            raise SqlError("unable to use function MATCH in the requested context")
        for s in scope.sources:
            name = (s.name or s.alias).lower()
            if name not in self._fts or column[1] and column[1].lower() not in (s.alias.lower(), name):
                continue
            fts = self.full_text(name)
            only = None if column[2].lower() in (name, s.alias.lower()) else column[2]
            s.matched = fts, str(query), only
            view = f"tessera_{self._id}_match_{compiler.fresh('m')}"
            fts.match(str(query), only).createOrReplaceTempView(view)
            return f"({ident(s.alias)}.`docid` IN (SELECT docid FROM {view}))"
        raise SqlError("unable to use function MATCH in the requested context")

    def auxiliary(self, compiler: Compiler, name: str, args: list, scope: Scope | None) -> tuple[str, str]:
        """snippet(t, ...), offsets(t), matchinfo(t, ...) and optimize(t) of a full-text table."""
        found = [s for s in (scope.sources if scope else []) if args and args[0][0] == "col" and args[0][2].lower() in ((s.name or s.alias).lower(), s.alias.lower())]
        if not found or (found[0].name or found[0].alias).lower() not in self._fts:
            raise SqlError(f"unable to use function {name} in the requested context")
        source, rest = found[0], [compiler.constant(a) for a in args[1:]]
        if name == "optimize":
            return quote(self.optimize(source.name or source.alias)), "text"
        if not all(known for known, _ in rest):
            raise SqlError(f"{name}() needs literal arguments")
        if source.matched is None:
            return quote("" if name != "matchinfo" else b""), "text" if name != "matchinfo" else "blob"
        fts, query, only = source.matched
        rest = [v for _, v in rest]
        if name == "snippet":
            if len(rest) > 5:
                raise SqlError("wrong number of arguments to function snippet()")
            df = fts.snippet(query, *rest, only=only)
        elif name == "offsets":
            df = fts.offsets(query, only)
        else:
            df = fts.matchinfo_blob(query, str(rest[0]) if rest else "pcx", only)
        view = f"tessera_{self._id}_{name}_{compiler.fresh('x')}"
        df.createOrReplaceTempView(view)
        return f"(SELECT first({df.columns[1]}) FROM {view} WHERE {view}.docid = {ident(source.alias)}.`docid`)", "blob" if name == "matchinfo" else "text"

    # functions

    def create_function(self, name: str, fn, returns: str = "text", n_args: int | None = None) -> None:
        """A scalar function: a Python callable or a pandas UDF, by the type it returns.

        With ``n_args`` it serves calls with so many arguments only, beside others of its name.
        """
        if not hasattr(fn, "evalType"):
            fn = F.udf(fn, _RETURNS[returns], useArrow=True)  # rows go to Python in batches
        called = name.lower() if n_args is None else f"{name.lower()}__{n_args}"
        self.spark.udf.register(called, fn)
        self.udfs[name.lower(), n_args] = called, returns

    def create_collation(self, name: str, key: Callable[[str], str]) -> None:
        """A collation by its sort key: Spark SQL text of a value to Spark SQL text of what is compared instead."""
        self.collations[name.upper()] = key

    def create_aggregate(self, name: str, fn, returns: str = "real", n_args: int | None = None) -> None:
        """An aggregate: a grouped-aggregate pandas UDF; with ``n_args`` beside others of its name, as for functions."""
        called = name.lower() if n_args is None else f"{name.lower()}__{n_args}"
        self.spark.udf.register(called, fn)
        self.aggregates.setdefault(name.lower(), {})[n_args] = called, returns

    def create_module(self, name: str, make: Callable[..., DataFrame], functions: dict[str, tuple[object, str]] | None = None) -> None:
        """A module for CREATE VIRTUAL TABLE: ``make`` gets its arguments as texts and returns the rows.

        ``functions`` (name: function and the type it returns) take the place of others of
        their name where the first argument is a column of such a table.
        """
        self.modules[name.lower()] = make
        for f, (fn, returns) in (functions or {}).items():
            called = f"{name.lower()}__{f.lower()}"
            self.spark.udf.register(called, fn if hasattr(fn, "evalType") else F.udf(fn, _RETURNS[returns], useArrow=True))
            self.overloads[name.lower(), f.lower()] = called, returns

    # statements

    def sql(self, statement: str, params=None) -> DataFrame:
        """Runs one statement.  Changes come back as a row with their number."""
        return self._run(parse(statement), params, statement)

    execute = sql

    def script(self, text: str) -> list[DataFrame]:
        return [self.sql(s) for s in split_statements(text)]

    def query(self, statement: str, params=None) -> str:
        """The Spark SQL that a SELECT becomes."""
        return Compiler(self, params).select(parse(statement)["select"])[0]

    def _run(self, s: dict, params, text: str) -> DataFrame:
        self._depth += 1
        try:
            return getattr(self, f"_do_{s['kind']}")(s, params, text)
        finally:
            self._depth -= 1
            if not self._depth:
                self._delete(self._scratch)
                self._scratch = []

    def _delete(self, paths) -> None:
        for p in list(paths):
            self._files.delete(p)
            self._owned.discard(p)
            if found := self._postings.pop(p, None):
                self._files.delete(found)

    def _live(self) -> set[str]:
        """The folders of current versions and of those that rollbacks may return to."""
        states = [self.tables, *(state[0] for _, state in self._stack)]
        return {p for tables in states for t in tables.values() for p, _ in t.parts}

    def _pin(self, df: DataFrame, name: str) -> DataFrame:
        """Rows written down, the same whenever they are read until the statement ends."""
        path = write_part(df, self.root, f"{name.replace('.', '_')}-rows")
        self._owned.add(path)
        self._scratch.append(path)
        return read_parts(self.spark, df.schema, [path])

    def _count(self, n: int) -> DataFrame:
        self.changes = n
        self.total_changes += n
        return self.spark.createDataFrame([(n,)], "changes long")

    def _done(self) -> DataFrame:
        return self.spark.createDataFrame([], "changes long")

    def _do_select(self, s, params, text) -> DataFrame:
        return self.spark.sql(Compiler(self, params).select(s["select"])[0])

    def _do_explain(self, s, params, text) -> DataFrame:
        inner = s["statement"]
        if inner["kind"] != "select":
            return self.spark.createDataFrame([(inner["kind"],)], "detail string")
        df = self._do_select(inner, params, text)
        return self.spark.createDataFrame([(x,) for x in df._jdf.queryExecution().simpleString().split("\n") if x.strip()], "detail string")

    # DDL

    def _do_create_table(self, s, params, text) -> DataFrame:
        name = self._lookup(s["name"])
        if name in self.tables or name in self.views:
            if s["if_not_exists"]:
                return self._done()
            raise SqlError(f"table {s['name']} already exists")
        if s["select"] is not None:
            df = self._do_select({"select": s["select"]}, params, text)
            columns = [self._plain(f.name, kind_of(f.dataType)) for f in df.schema]
            self._store(Table(s["name"], df, columns, "", temp=s["temp"], sql=text), number_rows(self._pin(df, s["name"]), ROWID, 1))
            return self._done()
        columns = s["columns"]
        fields = [T.StructField(c["name"], _SPARK[affinity(c["type"])]) for c in columns]
        t = Table(s["name"], None, columns, "", temp=s["temp"], sql=text)  # type: ignore[arg-type]
        for c in columns:
            if c["primary"]:
                if c["type"].upper() == "INTEGER":
                    t.key = c["name"]
                    t.auto = 0 if c["auto"] else None
                else:
                    t.unique.append(([c["name"]], c["primary"]))
            if c["unique"]:
                t.unique.append(([c["name"]], c["unique"]))
            if c["check"]:
                t.checks.append(c["check"])
            if c["references"]:
                t.foreign.append(([c["name"]], c["references"]))
        for k in s["constraints"]:
            if k["kind"] == "check":
                t.checks.append(k["expr"])
            elif k["kind"] == "foreign":
                t.foreign.append((k["columns"], k["references"]))
            else:
                only = [c for c in columns if k["columns"] == [c["name"]] and c["type"].upper() == "INTEGER"]
                if k["kind"] == "primary" and only:
                    t.key = only[0]["name"]
                else:
                    t.unique.append((k["columns"], k["policy"]))
        if not t.key:
            fields.append(T.StructField(ROWID, T.LongType()))
        self._publish(t, T.StructType(fields), [], 0)
        return self._done()

    def _plain(self, name: str, kind: str) -> dict:
        return {"name": name, "type": kind.upper(), "primary": False, "not_null": None, "unique": None, "default": None, "check": None, "collate": None, "references": None}

    def _store(self, t: Table, df: DataFrame) -> None:
        """Publishes a new version of a managed table."""
        path = write_part(df, self.root, t.name.replace(".", "_"))
        self._owned.add(path)
        self._publish(t, df.schema, [(path, 0)])

    def _publish(self, t: Table, schema: T.StructType, parts: list[tuple[str, int]], top: int | None = None) -> None:
        t = copy.copy(t)
        t.parts, t.top = parts, top
        t.df = read_parts(self.spark, schema, [p for p, _ in parts])
        t.view = f"tessera_{self._id}_{t.name}".replace(".", "_")
        t.df.createOrReplaceTempView(t.view)
        self.tables[t.name.lower()] = t

    def _append(self, t: Table, path: str, top: int | None) -> None:
        """Publishes the table with one folder more; the youngest folders of one age are merged once there are many."""
        schema, parts = t.df.schema, [*t.parts, (path, 0)]
        while len(parts) >= MERGE_PARTS and len({age for _, age in parts[-MERGE_PARTS:]}) == 1:
            tail, age = [p for p, _ in parts[-MERGE_PARTS:]], parts[-1][1]
            merged = read_parts(self.spark, schema, tail)
            merged = merged.coalesce(max(1, merged.rdd.getNumPartitions() // MERGE_PARTS))
            merged_path = write_part(merged, self.root, t.name.replace(".", "_"))
            self._owned.add(merged_path)
            parts = [*parts[:-MERGE_PARTS], (merged_path, age + 1)]
        self._publish(t, schema, parts, top)

    def _do_create_view(self, s, params, text) -> DataFrame:
        name = self._lookup(s["name"])
        if name in self.views or name in self.tables:
            if s["if_not_exists"]:
                return self._done()
            raise SqlError(f"table {s['name']} already exists")
        self.views[name] = (s["select"], s["sql"])
        return self._done()

    def _do_create_index(self, s, params, text) -> DataFrame:
        name = self._lookup(s["name"])
        if name in self.indexes:
            if s["if_not_exists"]:
                return self._done()
            raise SqlError(f"index {s['name']} already exists")
        t = self.table(s["table"])
        columns = [c[2] if c[0] == "col" else c[1][2] for c in s["columns"]]
        if s["unique"]:
            if self._repeated(t.df, columns):
                raise ConstraintError("indexed columns are not unique")
            t.unique.append((columns, "ABORT"))
        self.indexes[name] = {"table": t.name, "columns": columns, "unique": s["unique"], "sql": text}
        return self._done()

    def _do_create_trigger(self, s, params, text) -> DataFrame:
        name, on = self._lookup(s["name"]), self._lookup(s["table"])
        if name in self.triggers:
            if s["if_not_exists"]:
                return self._done()
            raise SqlError(f"trigger {s['name']} already exists")
        if on in self.views and s["timing"] != "INSTEAD OF":
            raise SqlError(f"cannot create {s['timing']} trigger on view: {s['table']}")
        if on not in self.views and s["timing"] == "INSTEAD OF":
            raise SqlError(f"cannot create INSTEAD OF trigger on table: {s['table']}")
        self.triggers[name] = s | {"sql": text}
        return self._done()

    def _do_create_virtual(self, s, params, text) -> DataFrame:
        from tessera.operators.fulltext import FullText

        name = self._lookup(s["name"])
        if name in self.tables or name in self.views:
            if s["if_not_exists"]:
                return self._done()
            raise SqlError(f"table {s['name']} already exists")
        if s["module"] in self.modules:
            self.register(s["name"], self.modules[s["module"]](*[a.strip("'\"") for a in s["args"]]))
            self.tables[name].sql, self.tables[name].module = text, s["module"]
            return self._done()
        if s["module"] not in ("fts3", "fts4"):
            raise SqlError(f"no such module: {s['module']}")
        tokenizers = [a.partition("=")[2].split() or a.split()[1:] for a in s["args"] if a.lower().startswith("tokenize")]
        for found in tokenizers:
            if found and found[0].strip("'\"").lower() not in ("simple", "porter"):
                raise SqlError(f"unknown tokenizer: {found[0]}")
        columns = [a.split()[0].strip("'\"") for a in s["args"] if a and "=" not in a and not a.lower().startswith("tokenize")] or ["content"]
        porter = any(found and found[0].strip("'\"").lower() == "porter" for found in tokenizers)
        df = self.spark.createDataFrame([], T.StructType([T.StructField("docid", T.LongType()), *[T.StructField(c, T.StringType()) for c in columns]]))
        t = Table(s["name"], df, [self._plain("docid", "int"), *[self._plain(c, "text") for c in columns]], "", sql=text, key="docid")
        self._publish(t, df.schema, [])
        self._fts[name] = lambda df, postings=None: FullText(df, "docid", columns, porter, postings)
        return self._done()

    def full_text(self, name: str):
        """The full-text operators (match, snippet, offsets, matchinfo) of a full-text table, over its version of the moment.

        Every part of the table has its postings, in order of terms, made when they are first
        asked for: an INSERT costs the postings of its own rows.
        """
        low = self._lookup(name)
        t, make = self.table(low), self._fts[low]
        paths = []
        for path, _ in t.parts:
            if path not in self._postings:
                self._postings[path] = f"{path}-postings"
                make(read_parts(self.spark, t.df.schema, [path])).save(f"{path}-postings")
            paths.append(self._postings[path])
        return make(t.df, self.spark.read.parquet(*paths) if paths else None)

    def optimize(self, name: str) -> str:
        """All postings of a full-text table as one."""
        t = self.table(name)
        if len(t.parts) < 2:
            return "Index already optimal"
        self._store(t, t.df)
        self.full_text(name)
        return "Index optimized"

    def _do_drop(self, s, params, text) -> DataFrame:
        name = self._lookup(s["name"])
        held = {"TABLE": self.tables, "VIEW": self.views, "INDEX": self.indexes, "TRIGGER": self.triggers}[s["what"]]
        if name not in held:
            if s["if_exists"]:
                return self._done()
            raise SqlError(f"no such {s['what'].lower()}: {s['name']}")
        del held[name]
        if s["what"] == "TABLE":
            self._fts.pop(name, None)
            for k in [k for k, i in self.indexes.items() if i["table"].lower() == name]:
                del self.indexes[k]
            for k in [k for k, i in self.triggers.items() if i["table"].lower() == name]:
                del self.triggers[k]
        return self._done()

    def _do_rename(self, s, params, text) -> DataFrame:
        t = copy.copy(self.table(s["table"]))
        if s["to"].lower() in self.tables:
            raise SqlError(f"there is already another table or index with this name: {s['to']}")
        del self.tables[self._lookup(s["table"])]
        t.name, t.view = s["to"], f"tessera_{self._id}_{s['to']}"
        t.df.createOrReplaceTempView(t.view)
        self.tables[s["to"].lower()] = t
        return self._done()

    def _do_add_column(self, s, params, text) -> DataFrame:
        t, c = self.table(s["table"]), s["column"]
        if c["primary"] or c["unique"]:
            raise SqlError("Cannot add a UNIQUE or PRIMARY KEY column")
        if c["not_null"] and c["default"] is None:
            raise SqlError("Cannot add a NOT NULL column with default value NULL")
        if any(c["name"].lower() == x["name"].lower() for x in t.columns):
            raise SqlError(f"duplicate column name: {c['name']}")
        t.columns.append(c)
        rest = [ROWID] if ROWID in t.df.columns else []
        default = F.expr(quote(Compiler(self).constant(c["default"])[1]) if c["default"] else "NULL").cast(_SPARK[affinity(c["type"])])
        self._store(t, t.df.select(*[x for x in t.df.columns if x not in rest], default.alias(c["name"]), *rest))
        return self._done()

    # DML

    def restore(self, name: str, rows: DataFrame) -> None:
        """Puts rows in place of a table's, if they have its columns and meet its constraints."""
        t = self._managed(name)
        if {(f.name, f.dataType) for f in rows.schema} - {(f.name, f.dataType) for f in t.df.schema} or set(t.df.columns) - set(rows.columns) - {ROWID}:
            raise SqlError(f"the rows to restore do not have the columns of {t.name}")
        rows = self._pin(rows, t.name)
        if ROWID in t.df.columns and ROWID not in rows.columns:
            rows = number_rows(rows, ROWID, 1)
        rows = self._check(t, rows.select(*t.df.columns), "ABORT")
        for columns in [*([[t.key]] if t.key else []), *(c for c, _ in t.unique)]:
            if self._repeated(rows, columns):
                raise ConstraintError(f"columns {', '.join(columns)} are not unique")
        self._references(t, rows)
        self._store(t, rows)

    def _typed(self, t: Table, name: str) -> T.DataType:
        return t.df.schema[name].dataType

    def _column(self, t: Table, name: str) -> str:
        for f in t.df.columns:
            if f.lower() == name.lower():
                return f
        raise SqlError(f"table {t.name} has no column named {name}")

    def _managed(self, name: str) -> Table:
        t = self.table(name)
        if not t.managed:
            # the first change makes a managed version; the registered data stay as they are
            df = t.df.withColumn(ROWID, F.monotonically_increasing_id() + 1)  # in order, not without gaps: one pass
            columns = [self._plain(f.name, kind_of(f.dataType)) for f in t.df.schema]
            self._store(Table(t.name, df, columns, ""), df)
            t = self.table(name)
        return t

    def _do_insert(self, s, params, text) -> DataFrame:
        if self._lookup(s["table"]) in self.views:
            return self._count(self._instead(s, params, "INSERT"))
        t = self._managed(s["table"])
        visible = [c["name"] for c in t.columns]
        names = [self._column(t, c) for c in s["columns"]] if s["columns"] else visible
        rows = self._given(s, params, t.name, names)
        return self._count(self.insert_rows(t.name, rows, s["policy"]))

    def _given(self, s: dict, params, table: str, names: list[str]) -> DataFrame:
        """The rows of an INSERT."""
        compiler = Compiler(self, params)
        if s["select"] is not None:
            rows = self.spark.sql(compiler.select(s["select"])[0])
        elif s["values"]:
            rows = self.spark.sql("SELECT " + ", ".join(f"{value(compiler.expr(e, Scope([])))[0]} AS c{i}" for i, e in enumerate(s["values"])))
        else:
            rows, names = self.spark.range(1).select(), []
        if len(rows.columns) != len(names):
            raise SqlError(f"table {table} has {len(names)} columns but {len(rows.columns)} values were supplied")
        return rows.toDF(*names)

    def _instead(self, s: dict, params, event: str) -> int:
        """A change of a view: its INSTEAD OF triggers get the rows."""
        sql, columns, _ = self.resolve(s["table"])
        name, names = s["table"].rpartition(".")[2], [c for c, _ in columns]
        t = Table(name, self.spark.sql(f"SELECT * FROM {sql}"), [self._plain(c, k) for c, k in columns], "", managed=False, key="__k")
        if not any(True for _ in self._matching(t, event, "INSTEAD OF", {c for c, _ in s.get("sets", [])} or None)):
            raise SqlError(f"cannot modify {name} because it is a view")
        if event == "INSERT":
            rows = self._given(s, params, name, [self._column(t, c) for c in s["columns"]] if s["columns"] else names)
            new = rows.select(*[F.col(ident(c)) if c in rows.columns else F.lit(None).cast(t.df.schema[c].dataType).alias(c) for c in names])
            old, new = None, self._pin(new.withColumn("__k", F.monotonically_increasing_id()), name)
        else:
            scope = Scope([Source(name, name, columns)])
            test = Compiler(self, params).boolean(s["where"], scope) if s["where"] else "true"
            own = {c: f"{ident(name)}.{ident(c)}" for c in names}
            sets = self._sets(t, s, Compiler(self, params), scope) if event == "UPDATE" else {}
            items = [f"{own[c]} AS {ident(c)}" for c in names] + [f"{e} AS {ident('__new_' + c)}" for c, e in sets.items()]
            both = self.spark.sql(f"SELECT {', '.join(items)} FROM {sql} AS {ident(name)} WHERE coalesce({test}, false)")
            both = self._pin(both.withColumn("__k", F.monotonically_increasing_id()), name)
            old = both.select(*names, "__k")
            new = both.select(*[F.col(f"__new_{c}").alias(c) if c in sets else F.col(c) for c in names], "__k") if event == "UPDATE" else None
        self._fire(t, event, "INSTEAD OF", old, new, set(sets) if event == "UPDATE" else None)
        return (old if new is None else new).count()

    def insert_rows(self, table: str, rows: DataFrame, policy: str = "ABORT") -> int:
        """Appends rows, by column name, under a conflict policy; returns how many went in."""
        t = self._managed(table)
        out = []
        for c in t.columns:
            if c["name"] in rows.columns:
                out.append(self._affine(F.col(ident(c["name"])), rows.schema[c["name"]].dataType, self._typed(t, c["name"])).alias(c["name"]))
            else:
                default = Compiler(self).constant(c["default"])[1] if c.get("default") else None
                out.append(F.expr(quote(default)).cast(self._typed(t, c["name"])).alias(c["name"]))
        rows = self._pin(rows.select(*out), t.name)  # what is numbered must not change when read again
        top = max(self._top(t), t.auto or 0)
        if t.key:
            missing = rows.filter(F.col(t.key).isNull())
            given = rows.filter(F.col(t.key).isNotNull())
            top = max(top, given.agg(F.max(t.key)).first()[0] or 0)
            rows = given.unionByName(number_rows(missing, t.key, top + 1).select(*rows.columns))
        else:
            rows = number_rows(rows, ROWID, top + 1)
        rows = self._check(t, rows, policy)
        rows, kept = self._conflicts(t, rows, policy)
        if self._stops(t, "INSERT", None, rows):
            return 0
        self._fire(t, "INSERT", "BEFORE", None, rows)
        path = write_part(rows.select(*t.df.columns), self.root, t.name.replace(".", "_"))
        self._owned.add(path)
        rows = read_parts(self.spark, t.df.schema, [path])
        n, last = rows.agg(F.count(F.lit(1)), F.max(t.key or ROWID)).first()
        if not n:
            self._raise_failure()
            return 0
        t = self.table(t.name)
        if t.auto is not None:
            t.auto = max(t.auto, int(last))
        if kept is None:
            self._append(t, path, max(top, int(last)))
        else:
            self._store(t, kept)
            self._append(self.table(t.name), path, None)
        self.last_insert_rowid = int(last)
        self._references(t, rows)
        self._fire(t, "INSERT", "AFTER", None, rows)
        self._raise_failure()
        return n

    def _raise_failure(self) -> None:
        failure, self._failure = self._failure, None
        if failure:
            raise ConstraintError(failure)

    def _affine(self, c: Column, have: T.DataType, want: T.DataType) -> Column:
        if have == want or kind_of(have) == kind_of(want):
            return c.cast(want)
        if isinstance(want, (T.LongType, T.DoubleType)) and isinstance(have, T.StringType):
            return c.try_cast(want)
        return c.cast(want)

    def _top(self, t: Table) -> int:
        if t.top is None:
            t.top = int(t.df.agg(F.max(t.key or ROWID)).first()[0] or 0)
        return t.top

    def _check(self, t: Table, rows: DataFrame, policy: str) -> DataFrame:
        """NOT NULL and CHECK: IGNORE drops the rows, REPLACE takes defaults for NULLs, others raise."""
        rules = []
        for c in t.columns:
            if c.get("not_null"):
                default = Compiler(self).constant(c["default"])[1] if c.get("default") else None
                if policy == "REPLACE" and default is not None:
                    rows = rows.withColumn(c["name"], F.coalesce(F.col(c["name"]), F.expr(quote(default)).cast(self._typed(t, c["name"]))))
                rules.append((F.col(c["name"]).isNotNull(), f"{t.name}.{c['name']} may not be NULL"))
        scope = Scope([Source("__t", t.name, [(f.name, kind_of(f.dataType)) for f in rows.schema])])
        for e in t.checks:
            test = Compiler(self).boolean(e, scope).replace("`__t`.", "")
            rules.append((F.expr(f"coalesce({test}, true)"), "constraint failed"))
        for rule, message in rules:
            if policy == "IGNORE":
                rows = rows.filter(rule)
            elif not rows.filter(~rule).isEmpty():
                self._give_up(policy)
                raise ConstraintError(message)
        return rows

    def _give_up(self, policy: str) -> None:
        """What a failed statement does to its transaction: under ROLLBACK it ends."""
        if policy == "ROLLBACK" and self._stack:
            before = self._stack[0][1]
            self._restore(before)
            self._deferred = []
            self._end(before)

    def _before_failure(self, t: Table, rows: DataFrame, columns: list[str], known: DataFrame) -> DataFrame:
        """FAIL: the rows before the first, in order of row ids, that conflicts; the error follows once they are in."""
        key = t.key or ROWID
        whole = rows.dropna(subset=columns)
        again = whole.groupBy(*columns).agg(F.min(key).alias("__first"), F.count(F.lit(1)).alias("__n"))
        later = whole.join(again, columns).filter(F.col(key) > F.col("__first") if columns != [key] else F.col("__n") > 1)
        first = whole.join(known, columns, "left_semi").select(key).union(later.select(key)).agg(F.min(key)).first()[0]
        if first is None:
            return rows
        self._failure = "PRIMARY KEY must be unique" if columns == [t.key] else f"column{'s' * (len(columns) > 1)} {', '.join(columns)} {'are' if len(columns) > 1 else 'is'} not unique"
        return rows.filter(F.col(key) < first)

    def _repeated(self, df: DataFrame, columns: list[str]) -> bool:
        return not df.dropna(subset=columns).groupBy(*columns).count().filter("count > 1").isEmpty()

    def _conflicts(self, t: Table, rows: DataFrame, policy: str) -> tuple[DataFrame, DataFrame | None]:
        """(rows that go in, rows that stay, None if all do) under uniqueness."""
        kept, all_stay = t.df, True
        keys = [([t.key], "ABORT")] if t.key else []
        for columns, own in [*keys, *t.unique]:
            use = own if policy == "ABORT" and own != "ABORT" else policy
            known = kept.select(*columns).dropna()
            if use == "IGNORE":
                rows = self._one_each(rows, columns, t.key or ROWID, first=True)
                rows = rows.join(known, columns, "left_anti").select(*rows.columns)
            elif use == "REPLACE":
                rows = self._one_each(rows, columns, t.key or ROWID, first=False)
                kept, all_stay = kept.join(rows.select(*columns).dropna(), columns, "left_anti").select(*t.df.columns), False
            elif use == "FAIL":
                rows = self._before_failure(t, rows, columns, known)
            elif self._repeated(rows, columns) or not rows.join(known, columns, "left_semi").isEmpty():
                self._give_up(use)
                what = f"column {columns[0]} is" if len(columns) == 1 else f"columns {', '.join(columns)} are"
                raise ConstraintError("PRIMARY KEY must be unique" if columns == [t.key] else f"{what} not unique")
        return rows, None if all_stay else kept

    def _one_each(self, rows: DataFrame, columns: list[str], rowid: str, first: bool) -> DataFrame:
        pick = (F.min_by if first else F.max_by)(F.struct(*rows.columns), F.col(rowid))
        whole = rows.dropna(subset=columns)
        nulls = rows.filter(" OR ".join(f"{ident(c)} IS NULL" for c in columns))
        return whole.groupBy(*columns).agg(pick.alias("__r")).select("__r.*").unionByName(nulls)

    def _scope(self, t: Table) -> Scope:
        columns = [(f.name, kind_of(f.dataType)) for f in t.df.schema if f.name != ROWID]
        return Scope([Source(t.view, t.name, columns, rowid=t.key or ROWID)])

    def _plainly(self, t: Table, event: str, columns: set[str] | None = None) -> bool:
        """Whether nothing but the table itself sees a change: no trigger, hook, foreign key or key."""
        if any(True for timing in ("BEFORE", "AFTER") for _ in self._matching(t, event, timing, columns)):
            return False
        if any(ev == event and table == t.name.lower() for ev, table, _ in self.hooks):
            return False
        if self.foreign_keys and (t.foreign or any(ref["table"].lower() == t.name.lower() for c in self.tables.values() for _, ref in c.foreign)):
            return False
        return columns is None or not columns & {t.key, *(c for names, _ in t.unique for c in names)}

    def _rewrite(self, t: Table, marked: DataFrame, after) -> int:
        """One pass: ``marked`` has the table's rows and whether each is ``__hit``; ``after`` makes the new rows of it."""
        seen, top = Observation(), t.top if "__new_" in str(marked.columns) else None
        path = write_part(after(marked.observe(seen, F.count_if("__hit").alias("n"))), self.root, t.name.replace(".", "_"))
        self._owned.add(path)
        n = seen.get["n"]
        if n:
            self._publish(t, t.df.schema, [(path, 0)], top)
        else:
            self._delete([path])
        return n

    def _do_update(self, s, params, text) -> DataFrame:
        if self._lookup(s["table"]) in self.views:
            return self._count(self._instead(s, params, "UPDATE"))
        t = self._managed(s["table"])
        scope = self._scope(t)
        test = Compiler(self, params).boolean(s["where"], scope) if s["where"] else "true"
        names = {self._column(t, name) for name, _ in s["sets"]}
        if s["policy"] not in ("IGNORE", "REPLACE") and self._plainly(t, "UPDATE", names):
            sets = self._sets(t, s, Compiler(self, params), scope)
            own = {c: f"{ident(t.view)}.{ident(c)}" for c in t.df.columns}
            items = [f"{own[c]} AS {ident(c)}" for c in t.df.columns] + [f"{e} AS {ident('__new_' + c)}" for c, e in sets.items()]
            if any(c.get("not_null") for c in t.columns if c["name"] in sets) or t.checks:
                changed = ", ".join(f"{sets.get(c, own[c])} AS {ident(c)}" for c in t.df.columns)
                self._check(t, self.spark.sql(f"SELECT {changed} FROM {ident(t.view)} WHERE coalesce({test}, false)"), s["policy"])
            marked = self.spark.sql(f"SELECT {', '.join(items)}, coalesce({test}, false) AS `__hit` FROM {ident(t.view)}")
            new = [F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in t.df.columns]
            return self._count(self._rewrite(t, marked, lambda d: d.select(*new)))
        return self._count(self._update_rows(t, s, Compiler(self, params), scope, f"{ident(t.view)} WHERE coalesce({test}, false)"))

    def _sets(self, t: Table, s: dict, compiler: Compiler, scope: Scope) -> dict[str, str]:
        sets = {}
        for name, e in s["sets"]:
            column = self._column(t, name)
            sets[column] = f"CAST({value(compiler.expr(e, scope))[0]} AS {self._typed(t, column).simpleString()})"
        return sets

    def _update_rows(self, t: Table, s: dict, compiler: Compiler, scope: Scope, source: str) -> int:
        s = s | {"policy": "ABORT" if s["policy"] == "FAIL" else s["policy"]}  # all rows change at once
        sets = self._sets(t, s, compiler, scope)
        own = {c: f"{ident(t.view)}.{ident(c)}" for c in t.df.columns}
        columns = [f"{own[c]} AS {ident('__old_' + c)}" for c in t.df.columns]
        changed = [f"{sets.get(c, own[c])} AS {ident(c)}" for c in t.df.columns]
        both = self.spark.sql(f"SELECT {', '.join(changed + columns)} FROM {source}")
        both = self._pin(both, t.name)
        new = both.select(*t.df.columns)
        old = both.select(*[F.col(f"__old_{c}").alias(c) for c in t.df.columns])
        n = both.count()
        if not n:
            return 0
        if " JOIN " in source and self._repeated(old, [t.key or ROWID]):
            raise SqlError("a trigger's UPDATE may change a row once for each statement")
        if self._stops(t, "UPDATE", old, new, set(sets)):
            return 0
        self._fire(t, "UPDATE", "BEFORE", old, new, set(sets))
        rest = t.df.join(old.select(F.col(t.key or ROWID)), t.key or ROWID, "left_anti").select(*t.df.columns)
        new = self._check(t, new, s["policy"])
        moved = copy.copy(t)
        moved.df = rest
        new, kept = self._conflicts(moved, new, s["policy"])
        kept = rest if kept is None else kept
        if s["policy"] == "IGNORE":  # rows that may not change stay as they were
            lost = old.join(both.join(new.select(F.col(t.key or ROWID)), t.key or ROWID, "left_semi").select(F.col(f"__old_{t.key or ROWID}").alias(t.key or ROWID)), t.key or ROWID, "left_anti")
            kept = kept.unionByName(lost.select(*t.df.columns))
        self._store(t, kept.unionByName(new))
        self._references(t, new)
        self._parents(t, old, new)
        self._fire(t, "UPDATE", "AFTER", old, new, set(sets))
        return n

    def _do_delete(self, s, params, text) -> DataFrame:
        if self._lookup(s["table"]) in self.views:
            return self._count(self._instead(s, params, "DELETE"))
        t = self._managed(s["table"])
        test = Compiler(self, params).boolean(s["where"], self._scope(t)) if s["where"] else "true"
        if self._plainly(t, "DELETE"):
            marked = self.spark.sql(f"SELECT *, coalesce({test}, false) AS `__hit` FROM {ident(t.view)}")
            return self._count(self._rewrite(t, marked, lambda d: d.filter("NOT __hit").drop("__hit")))
        old = self._pin(self.spark.sql(f"SELECT * FROM {ident(t.view)} WHERE coalesce({test}, false)"), t.name)
        return self._count(self._delete_rows(t, old))

    def _delete_rows(self, t: Table, old: DataFrame) -> int:
        n = old.count()
        if not n:
            return 0
        if self._stops(t, "DELETE", old, None):
            return 0
        self._fire(t, "DELETE", "BEFORE", old, None)
        key = t.key or ROWID
        self._store(t, t.df.join(old.select(key), key, "left_anti").select(*t.df.columns))
        self._parents(self.table(t.name), old, None)
        self._fire(t, "DELETE", "AFTER", old, None)
        return n

    # foreign keys

    def _references(self, t: Table, rows: DataFrame) -> None:
        if not self.foreign_keys:
            return
        for columns, ref in t.foreign:
            parent = self.table(ref["table"])
            to = ref["columns"] or [parent.key or parent.unique[0][0][0]]
            keys = parent.df.select(*[F.col(p).alias(c) for p, c in zip(to, columns)])
            if ref.get("deferred") and self._stack:
                self._deferred.append((t.name, columns, ref))
            elif not rows.dropna(subset=columns).join(keys, columns, "left_anti").isEmpty():
                raise ConstraintError("foreign key constraint failed")

    def _check_deferred(self) -> None:
        """At the end of a transaction: every row of the children that were touched has its parent."""
        for name, columns, ref in self._deferred:
            if name.lower() not in self.tables:
                continue
            parent = self.table(ref["table"])
            to = ref["columns"] or [parent.key or parent.unique[0][0][0]]
            keys = parent.df.select(*[F.col(p).alias(c) for p, c in zip(to, columns)])
            if not self.table(name).df.dropna(subset=columns).join(keys, columns, "left_anti").isEmpty():
                raise ConstraintError("foreign key constraint failed")
        self._deferred = []

    def _parents(self, t: Table, old: DataFrame, new: DataFrame | None) -> None:
        """What children do when rows they refer to go or change their keys."""
        if not self.foreign_keys:
            return
        for child in list(self.tables.values()):
            for columns, ref in child.foreign:
                if ref["table"].lower() != t.name.lower():
                    continue
                to = ref["columns"] or [t.key or t.unique[0][0][0]]
                gone = old.select(*[F.col(p).alias(c) for p, c in zip(to, columns)]).dropna()
                gone = gone.join(self.table(t.name).df.select(*[F.col(p).alias(c) for p, c in zip(to, columns)]), columns, "left_anti")
                hit = child.df.join(gone, columns, "left_semi").select(*child.df.columns)
                if hit.isEmpty():
                    continue
                action = ref["DELETE" if new is None else "UPDATE"]
                if action == "NO ACTION" and ref.get("deferred") and self._stack:
                    self._deferred.append((child.name, columns, ref))
                    continue
                if action in ("NO ACTION", "RESTRICT"):
                    raise ConstraintError("foreign key constraint failed")
                if action == "CASCADE" and new is None:
                    self._delete_rows(child, self._pin(hit, child.name))
                    continue
                key = child.key or ROWID
                rest = child.df.join(hit.select(key), key, "left_anti").select(*child.df.columns)
                if action == "CASCADE":
                    row = t.key or ROWID
                    pairs = old.select(row, *[F.col(p).alias(f"__a{i}") for i, p in enumerate(to)]).join(
                        new.select(row, *[F.col(p).alias(f"__b{i}") for i, p in enumerate(to)]), row
                    ) if row not in to else None
                    if pairs is None:
                        raise SqlError("ON UPDATE CASCADE needs a key that is not the rowid")
                    on = [F.col(c) == F.col(f"__a{i}") for i, c in enumerate(columns)]
                    moved = hit.alias("h").join(pairs.drop(row), on).select(
                        *[F.col(f"__b{columns.index(c)}").alias(c) if c in columns else F.col(c) for c in child.df.columns]
                    )
                else:
                    defaults = {c["name"]: Compiler(self).constant(c["default"])[1] if c.get("default") and action == "SET DEFAULT" else None for c in child.columns}
                    moved = hit.select(*[F.expr(quote(defaults[c])).cast(self._typed(child, c)).alias(c) if c in columns else F.col(c) for c in child.df.columns])
                self._store(child, rest.unionByName(moved))

    # triggers and hooks

    def on(self, event: str, table: str, hook: Callable[[DataFrame | None, DataFrame | None], None]) -> None:
        """Calls hook(old rows, new rows) after each INSERT, UPDATE or DELETE on a table."""
        self.hooks.append((event.upper(), table.lower(), hook))

    def _matching(self, t: Table, event: str, timing: str, columns: set[str] | None):
        for s in self.triggers.values():
            if s["table"].lower() == t.name.lower() and s["event"] == event and s["timing"] == timing:
                if s["of"] and columns is not None and not {c.lower() for c in s["of"]} & {c.lower() for c in columns}:
                    continue
                yield s

    def _rows_of(self, old: DataFrame | None, new: DataFrame | None, key: str) -> tuple[DataFrame, Scope]:
        parts, sources = [], []
        for name, df in (("old", old), ("new", new)):
            if df is not None:
                parts.append(df.select(F.col(key).alias("__k"), *[F.col(c).alias(f"{name}_{c}") for c in df.columns]))
        rows = parts[0] if len(parts) == 1 else parts[0].join(parts[1], "__k")
        view = f"tessera_{self._id}_fired"
        rows.createOrReplaceTempView(view)
        return rows, view

    def _renamed(self, e):
        if isinstance(e, list):
            return [self._renamed(x) for x in e]
        if not isinstance(e, tuple):
            return e
        if len(e) == 3 and e[0] == "col" and str(e[1]).lower() in ("old", "new"):
            return ("col", "__fired", f"{e[1].lower()}_{e[2]}")
        return tuple(self._renamed(x) if isinstance(x, (tuple, list)) else x for x in e)

    def _joined_select(self, select: dict, rows: DataFrame, when) -> DataFrame:
        """A trigger's SELECT for all rows that fired at once: they are a source of it."""
        core = select["cores"][0]
        compiler = Compiler(self)
        plain = len(select["cores"]) == 1 and not core["group"] and not core["distinct"] and select["limit"] is None
        if not plain or any(c[0] == "expr" and compiler.has_aggregate(c[1]) for c in core["columns"]):
            raise SqlError("a trigger's INSERT may select rows, but not group, limit or combine them")
        self.register("__fired", rows)
        fired = ("table", "__fired", None, None)
        tests = [self._renamed(e) for e in (core["where"], when) if e]
        try:
            joined = core | {
                "columns": [("star", c[1]) if c[0] == "star" else (c[0], self._renamed(c[1]), *c[2:]) for c in core["columns"]],
                "from": ("join", "inner", False, fired, self._renamed(core["from"]), None, None) if core["from"] else fired,
                "where": ("bin", "AND", *tests) if len(tests) == 2 else tests[0] if tests else None,
            }
            return self.spark.sql(compiler.select(select | {"cores": [joined], "order": []})[0])
        finally:
            del self.tables["__fired"]

    def _stops(self, t: Table, event: str, old, new, columns=None) -> bool:
        """RAISE(IGNORE) in a BEFORE trigger that some row meets gives up the change."""
        return self._fire(t, event, "BEFORE", old, new, columns, only_raise=True)

    def _fire(self, t: Table, event: str, timing: str, old, new, columns=None, only_raise: bool = False) -> bool:
        for s in self._matching(t, event, timing, columns):
            rows, view = self._rows_of(old, new, t.key or ROWID)
            scope = Scope([Source("__fired", None, [(f.name, kind_of(f.dataType)) for f in rows.schema])])
            compiler = Compiler(self)
            when = compiler.boolean(self._renamed(s["when"]), scope) if s["when"] else "true"
            source = f"{ident(view)} AS `__fired`"
            for step in s["steps"]:
                if step["kind"] == "select":
                    core = step["select"]["cores"][0]
                    for c in core["columns"]:
                        tests = [when] + ([compiler.boolean(self._renamed(core["where"]), scope)] if core["where"] else [])
                        action = c[1] if c[0] == "expr" and c[1][0] == "raise" else None
                        if c[0] == "expr" and c[1][0] == "case":
                            for cond, result in c[1][2]:
                                if result[0] == "raise":
                                    action = result
                                    tests.append(compiler.boolean(self._renamed(cond), scope))
                        if action is None or self.spark.sql(f"SELECT 1 FROM {source} WHERE {' AND '.join(tests)} LIMIT 1").isEmpty():
                            continue
                        if action[1] == "IGNORE":
                            return True
                        self._give_up(action[1])
                        raise ConstraintError(action[2] or "constraint failed")
                elif only_raise:
                    continue
                elif step["kind"] == "insert" and step["values"] is not None:
                    target = self._managed(step["table"])
                    names = step["columns"] or [c["name"] for c in target.columns]
                    items = ", ".join(f"{value(compiler.expr(self._renamed(e), scope))[0]} AS {ident(n)}" for e, n in zip(step["values"], names))
                    self.insert_rows(step["table"], self.spark.sql(f"SELECT {items} FROM {source} WHERE {when}"), step["policy"])
                elif step["kind"] == "insert" and step["select"] is not None:
                    target = self._managed(step["table"])
                    found = self._joined_select(step["select"], rows, s["when"])
                    names = step["columns"] or [c["name"] for c in target.columns]
                    self.insert_rows(step["table"], found.toDF(*names), step["policy"])
                elif step["kind"] in ("update", "delete"):
                    # all rows that fired at once: each row of the target that some of them meets
                    target = self._managed(step["table"])
                    own = self._scope(target).sources[0]
                    both = Scope([own, scope.sources[0]])
                    test = compiler.boolean(self._renamed(step["where"]), both) if step["where"] else "true"
                    meets = f"coalesce(({when}) AND ({test}), false)"
                    if step["kind"] == "update":
                        renamed = step | {"sets": [(c, self._renamed(e)) for c, e in step["sets"]]}
                        self._update_rows(target, renamed, compiler, both, f"{ident(target.view)} JOIN {source} ON {meets}")
                    else:
                        gone = self.spark.sql(f"SELECT {ident(target.view)}.* FROM {ident(target.view)} LEFT SEMI JOIN {source} ON {meets}")
                        self._delete_rows(target, self._pin(gone, target.name))
                else:
                    raise SqlError("a trigger's steps may be INSERT, UPDATE, DELETE or SELECT RAISE(); use Engine.on() for others")
        if timing == "AFTER":
            for ev, table, hook in self.hooks:
                if ev == event and table == t.name.lower():
                    hook(old, new)
        return False

    # transactions

    def _snapshot(self) -> tuple:
        return (
            {k: copy.copy(t) for k, t in self.tables.items()}, dict(self.views), dict(self.indexes), dict(self.triggers), dict(self._fts)
        )

    def _restore(self, state: tuple) -> None:
        tables, self.views, self.indexes, self.triggers, self._fts = (dict(x) for x in state)
        self.tables = {k: copy.copy(t) for k, t in tables.items()}
        for t in self.tables.values():
            t.df.createOrReplaceTempView(t.view)

    def _do_begin(self, s, params, text) -> DataFrame:
        if self._stack:
            raise SqlError("cannot start a transaction within a transaction")
        self._stack.append(("", self._snapshot()))
        self._started = set(self._owned)
        return self._done()

    def _do_commit(self, s, params, text) -> DataFrame:
        if not self._stack:
            raise SqlError("cannot commit - no transaction is active")
        self._check_deferred()
        self._end(self._stack[0][1])
        return self._done()

    def _end(self, before: tuple) -> None:
        """Leaves the transaction: versions that only it has seen go."""
        old = {p for t in before[0].values() for p, _ in t.parts}
        self._stack.clear()
        self._delete(p for p in self._owned - self._live() - old - self._started - set(self._scratch) if p)

    def _do_rollback(self, s, params, text) -> DataFrame:
        if not self._stack:
            raise SqlError("cannot rollback - no transaction is active")
        self._restore(self._stack[0][1])
        self._deferred = []
        self._end(self._stack[0][1])
        return self._done()

    def _do_savepoint(self, s, params, text) -> DataFrame:
        if not self._stack:
            self._started = set(self._owned)
        self._stack.append((s["name"].lower(), self._snapshot()))
        return self._done()

    def _point(self, name: str) -> int:
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i][0] == name.lower():
                return i
        raise SqlError(f"no such savepoint: {name}")

    def _do_release(self, s, params, text) -> DataFrame:
        at = self._point(s["name"])
        if at == 0:
            self._check_deferred()
            self._end(self._stack[0][1])
        else:
            del self._stack[at:]
        return self._done()

    def _do_rollback_to(self, s, params, text) -> DataFrame:
        i = self._point(s["name"])
        self._restore(self._stack[i][1])
        del self._stack[i + 1 :]
        return self._done()

    # administration

    def _do_attach(self, s, params, text) -> DataFrame:
        """A folder of Parquet tables becomes tables name.table."""
        known, path = Compiler(self, params).constant(s["path"])
        if len(self.attached) >= 10:
            raise SqlError("too many attached databases - max 10")
        self.attached.append(s["name"])
        if known and path and path != ":memory:":
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            for f in fs.listStatus(p):
                n = f.getPath().getName()
                if n.endswith(".parquet"):
                    self.register(f"{s['name']}.{n[:-8]}", f"{path}/{n}")
        return self._done()

    def _do_detach(self, s, params, text) -> DataFrame:
        if s["name"] not in self.attached:
            raise SqlError(f"no such database: {s['name']}")
        self.attached.remove(s["name"])
        for k in [k for k in self.tables if k.startswith(s["name"].lower() + ".")]:
            del self.tables[k]
        return self._done()

    def _do_pragma(self, s, params, text) -> DataFrame:
        name, arg = s["name"].rpartition(".")[2], s["value"]
        make = self.spark.createDataFrame
        if name == "table_info":
            t = self.table(arg)
            rows = [
                (i, c["name"], c["type"], int(bool(c.get("not_null"))), str(Compiler(self).constant(c["default"])[1]) if c.get("default") else None,
                 int(bool(c.get("primary")) or c["name"] == t.key))
                for i, c in enumerate(t.columns)
            ]
            return make(rows, "cid long, name string, type string, notnull long, dflt_value string, pk long")
        if name == "index_list":
            rows = [(i, n, int(x["unique"])) for i, (n, x) in enumerate(self.indexes.items()) if x["table"].lower() == arg.lower()]
            return make(rows, "seq long, name string, unique long")
        if name == "index_info":
            x = self.indexes[arg.lower()]
            at = [c["name"] for c in self.table(x["table"]).columns]
            return make([(i, at.index(c), c) for i, c in enumerate(x["columns"])], "seqno long, cid long, name string")
        if name == "database_list":
            return make([(0, "main", self._home), *[(i + 2, n, "") for i, n in enumerate(self.attached)]], "seq long, name string, file string")
        if name == "foreign_key_list":
            rows = [
                (k, i, r["table"], c, (r["columns"] or [None] * len(cs))[i], r["UPDATE"], r["DELETE"], "NONE")
                for k, (cs, r) in enumerate(self.table(arg).foreign) for i, c in enumerate(cs)
            ]
            return make(rows, "id long, seq long, `table` string, `from` string, `to` string, on_update string, on_delete string, match string")
        if name == "foreign_keys":
            if arg is not None:
                self.foreign_keys = arg.lower() in ("1", "on", "true", "yes")
                return self._done()
            return make([(int(self.foreign_keys),)], "foreign_keys long")
        if name == "encoding":
            return make([("UTF-8",)], "encoding string")
        return self._done()

    def _do_vacuum(self, s, params, text) -> DataFrame:
        """Every managed table as one part; folders that no version needs are deleted."""
        if self._stack:
            raise SqlError("cannot VACUUM from within a transaction")
        for t in list(self.tables.values()):
            if t.managed and len(t.parts) > 1:
                self._store(t, t.df)
        self._delete(self._owned - self._live())
        return self._done()

    def _do_reindex(self, s, params, text) -> DataFrame:
        return self._done()  # indexes are metadata

    def _do_analyze(self, s, params, text) -> DataFrame:
        """Row counts by table, which ``sqlite_stat1`` shows; the sizes that Catalyst plans with come from the files."""
        names = [s["name"]] if s["name"] else [t.name for t in self.tables.values()]
        found = [(n, self.table(n).df.count()) for n in names]
        self.stats.update(found)
        return self.spark.createDataFrame(found, "tbl string, stat long")
