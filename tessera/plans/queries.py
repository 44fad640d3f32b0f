"""The engine's registered queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.engine import Engine
from tessera.operators.fulltext import FullText
from tessera.plans import wiki
from tessera.plans.inventory import CHANGES, SELECTS, TABLES
from tessera.plans.lexer import SqlError, tokenize


def engine(spark: SparkSession, sf_dir: str, text: str = "") -> Engine:
    """An engine over the tables that ``text`` names."""
    names = {str(t.value).lower() for t in tokenize(text) if t.kind == "id"} if text else set(TABLES)
    return Engine(spark).register_folder(sf_dir, [t for t in TABLES if t in names])


def _select(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir, sql).sql(sql)


def _change(steps: list[str], sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir, " ; ".join([*steps, sql]))
        for s in steps:
            e.sql(s)
        return e.sql(sql)

    return run


def bind_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "customer")
    return e.sql("SELECT c_custkey, :tag AS tag FROM customer WHERE c_nationkey = ?2 AND c_acctbal > ?1", {1: 1000.0, 2: 4, "tag": "t"})


def widened_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "orders")
    e.widen = True
    return e.sql("SELECT o_orderkey, o_orderkey * 9223372036854775807 AS x FROM orders WHERE o_orderkey IN (1, 2, 3)")


def explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, "orders").sql("EXPLAIN QUERY PLAN SELECT o_orderkey FROM orders WHERE o_orderkey = 7")


def scalar_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "nation")

    @F.pandas_udf("string")
    def flip(s: pd.Series) -> pd.Series:
        return s.str[::-1]

    e.create_function("flip", flip, "text")
    return e.sql("SELECT n_nationkey, flip(n_name) AS f FROM nation")


def aggregate_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "customer")

    @F.pandas_udf("double")
    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    e.create_aggregate("spread", spread)
    return e.sql("SELECT c_nationkey, round(spread(c_acctbal), 2) AS s FROM customer GROUP BY c_nationkey")


def virtual_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.sources.virtual import SeriesSource, virtual_table

    e = Engine(spark)
    e.register("series", virtual_table(spark, SeriesSource, start=1, stop=1000))
    return e.sql("SELECT value FROM series WHERE value > 990")


def incremental_blob(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.sources.virtual import blob_read, blob_write

    names = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.col("n_name").cast("binary").alias("b"))
    return names.select("n_nationkey", blob_read("b", 2, 3).cast("string").alias("part"), blob_write("b", 0, b"XY").cast("string").alias("over"))


def _lines(spark: SparkSession, lines) -> DataFrame:
    return spark.createDataFrame(list(enumerate(lines, 1)), "line long, text string")


def _outcomes(e: Engine, statements: list[str]) -> DataFrame:
    """What each statement says: its error, or ok."""
    found = []
    for s in statements:
        try:
            e.sql(s).collect()
            found.append("ok")
        except SqlError as error:
            found.append(str(error))
    return _lines(e.spark, found)


def refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "nation region")
    return _outcomes(e, [
        "SELECT 1 FROM nation RIGHT JOIN region ON 1", "SELECT 1 FROM nation FULL OUTER JOIN region ON 1", "SELECT load_extension('x')", "SELECT 1 FROM nation INDEXED BY none",
        "SELECT match('a', 'b')", "CREATE VIRTUAL TABLE v USING nothing(1)", "SELECT 1 UNION SELECT 1, 2", "SELECT glob('a')",
    ])


def constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark)
    return _outcomes(e, [
        "CREATE TABLE t (a INTEGER PRIMARY KEY, b TEXT UNIQUE, c INT CHECK (c < 10), d REAL NOT NULL)", "INSERT INTO t VALUES (1, 'x', 1, 1)", "INSERT INTO t VALUES (1, 'y', 1, 1)", "INSERT INTO t VALUES (2, 'x', 1, 1)",
        "INSERT INTO t VALUES (2, 'y', 10, 1)", "INSERT INTO t VALUES (2, 'y', 1, NULL)", "INSERT INTO t VALUES (2, 'y', NULL, 1)", "UPDATE t SET c = 50", "UPDATE t SET a = 5", "UPDATE t SET d = d + 1",
    ])


def conflict_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FAIL keeps what came before the conflict, ROLLBACK ends the transaction, ABORT undoes the statement."""
    e = engine(spark, sf_dir, "nation")
    e.script("CREATE TABLE t (k INTEGER PRIMARY KEY, v TEXT); INSERT INTO t VALUES (5, 'old')")
    _outcomes(e, ["INSERT OR FAIL INTO t SELECT n_nationkey, n_name FROM nation WHERE n_nationkey > 2 AND n_nationkey < 9"])
    e.sql("BEGIN")
    e.sql("DELETE FROM t")
    said = _outcomes(e, ["INSERT OR ROLLBACK INTO t VALUES (1, NULL)", "INSERT OR ROLLBACK INTO t VALUES (1, 'again')", "COMMIT", "INSERT OR ABORT INTO t SELECT 4 + n_nationkey, 'z' FROM nation"])
    return said.unionByName(e.sql("SELECT 100 + k AS line, v AS text FROM t"))


def attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark)
    e.sql("ATTACH ? AS other", [sf_dir])
    return e.sql("SELECT n_name, r_name FROM other.nation JOIN other.region ON n_regionkey = r_regionkey")


def text_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from tessera.sources import delimited

    e = engine(spark, sf_dir, "nation")
    path = f"{e.root}/import-{uuid.uuid4().hex}"
    delimited.write_delimited(e.sql("SELECT n_nationkey, n_name FROM nation"), path, "|")
    e.sql("CREATE TABLE t (k INTEGER, name TEXT)")
    delimited.import_delimited(e, path, "t", "|")
    return e.sql("SELECT k, name FROM t")


def script(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "nation")
    return e.script("CREATE TABLE t AS SELECT n_name FROM nation; -- ; in a comment\nDELETE FROM t WHERE n_name LIKE '%;%'; SELECT count(*) AS n FROM t")[-1]


def dump_and_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.sources import formats

    e = engine(spark, sf_dir, "region")
    e.script("CREATE TABLE t AS SELECT r_regionkey, r_name FROM region; CREATE TABLE log (k INTEGER); CREATE TRIGGER tr AFTER DELETE ON t BEGIN INSERT INTO log VALUES (old.r_regionkey); END")
    lines = [x.replace("CREATE TABLE t AS SELECT r_regionkey, r_name FROM region", "CREATE TABLE t (r_regionkey INTEGER, r_name TEXT)") for x in formats.dump(e, ["t", "log"])]
    again = Engine(spark)
    again.script("\n".join(lines))
    again.sql("DELETE FROM t WHERE r_regionkey = 2")
    return again.sql("SELECT r_regionkey, r_name FROM t UNION ALL SELECT k, 'logged' FROM log")


def output_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.sources import formats

    df = engine(spark, sf_dir, "region").sql("SELECT r_regionkey AS k, r_name || '\"' AS name, NULL AS gone FROM region WHERE r_regionkey = 1")
    return _lines(spark, [f"{mode}: {x}" for mode in formats.MODES for x in formats.render(df, mode, header=mode in ("column", "csv"), null="-")])


def shell_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    import io

    from tessera.shell import Shell

    shell = Shell(engine(spark, sf_dir, "nation region"))
    shell.out = io.StringIO()
    shell.run([".header on\n", ".nullvalue nil\n", "SELECT n_name, NULL AS x FROM nation\n", "WHERE n_nationkey = 3;\n", ".tables reg\n", ".separator ,\n", "SELECT 1, 2;\n", ".nothing\n", ".quit\n"])
    return _lines(spark, shell.out.getvalue().splitlines())


def backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from tessera.sources import storage

    e = engine(spark, sf_dir, "nation")
    path = f"{e.root}/backup-{uuid.uuid4().hex}"
    storage.backup(e.table("nation").df, path)
    e.sql("DELETE FROM nation WHERE n_nationkey > 3")
    e.restore("nation", storage.restore(spark, path))
    out = e.sql("SELECT n_nationkey, n_name, n_regionkey FROM nation")
    return out


def functions_by_arity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "nation")
    e.create_function("glue", lambda a: f"{a}!", "text", 1)
    e.create_function("glue", lambda a, b: f"{a}-{b}", "text", 2)

    @F.pandas_udf("double")
    def most(v: pd.Series) -> float:
        return float(v.max())

    @F.pandas_udf("double")
    def most_of_two(v: pd.Series, w: pd.Series) -> float:
        return float((v + w).max())

    e.create_aggregate("most", most, n_args=1)
    e.create_aggregate("most", most_of_two, n_args=2)
    return e.sql("SELECT n_regionkey, a, b, m, m2 FROM (SELECT n_regionkey, min(glue(n_name)) AS a, min(glue(n_name, n_regionkey)) AS b FROM nation GROUP BY n_regionkey) JOIN (SELECT n_regionkey AS k, most(n_nationkey) AS m, most(n_nationkey, n_regionkey) AS m2 FROM nation GROUP BY n_regionkey) ON k = n_regionkey")


def user_collation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "nation")
    e.create_collation("TAIL", lambda sql: f"substring_index({sql}, '_', -1)")
    return e.sql("SELECT n_nationkey FROM nation WHERE n_name = 'x_7' COLLATE TAIL OR n_name COLLATE TAIL = 'y_11'")


def module_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark)
    e.create_module("squares", lambda n: spark.range(int(n)).select((F.col("id") * F.col("id")).alias("square")), {"length": (lambda v: int(v**0.5), "int")})
    e.sql("CREATE VIRTUAL TABLE sq USING squares(10)")
    return e.sql("SELECT square, length(square) AS root, length('four') AS n FROM sq")


def tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.tree import Tree

    tree = Tree(Engine(spark), "kv")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    tree.insert(orders.select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").cast("binary").alias("value")))
    tree.update(spark.createDataFrame([(502, b"new")], "key long, value binary"))
    tree.delete(503)
    found = tree.scan(500, 20).unionByName(tree.lookup(7).select(F.lit(7).cast("long").alias("key"), "value"))
    return found.select("key", F.col("value").cast("string").alias("value"))


def _wiki(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = wiki.QUERIES[name]
        used = {v: sql for v, sql in wiki.VIEWS.items() if v in {str(t.value) for t in tokenize(text)}}
        e = engine(spark, sf_dir, " ".join(used.values()))
        e.script("; ".join(f"CREATE VIEW {v} AS {sql}" for v, sql in used.items()))
        return e.sql(text)

    return run


def _wiki_update(steps: list[str], sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir, "part region")
        e.sql(f"CREATE VIEW page AS {wiki.VIEWS['page']}")
        e.script("; ".join(steps))
        return e.sql(sql)

    return run


def _pages(spark: SparkSession, sf_dir: str) -> Engine:
    """A full-text table of all documents, in two inserts."""
    e = engine(spark, sf_dir, "documents")
    e.sql("CREATE VIRTUAL TABLE pages USING fts4(body)")
    e.sql("INSERT INTO pages (docid, body) SELECT doc_id, text FROM documents WHERE doc_id % 2 = 0")
    e.sql("INSERT INTO pages (docid, body) SELECT doc_id, text FROM documents WHERE doc_id % 2 <> 0")
    return e


def fts_offsets_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).sql("SELECT docid, offsets(pages) AS o FROM pages WHERE pages MATCH '\"of the\"'")


def fts_snippet_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).sql("SELECT docid, snippet(pages, '[', ']', '...', -1, 6) AS s FROM pages WHERE body MATCH 'which'")


def fts_matchinfo_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).sql("SELECT docid, hex(matchinfo(pages, 'pcnlx')) AS m FROM pages WHERE pages MATCH 'this'")


def fts_optimize_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _pages(spark, sf_dir)
    said = e.sql("SELECT optimize(pages) AS o FROM pages LIMIT 1").first()[0]
    again = e.sql("SELECT optimize(pages) AS o FROM pages LIMIT 1").first()[0]
    return e.sql("SELECT docid, ? AS first, ? AS then FROM pages WHERE pages MATCH 'which'", [said, again])


def _fts(spark: SparkSession, sf_dir: str) -> FullText:
    return FullText(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", ["text", "source"])


def _match(query: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _fts(spark, sf_dir).match(query)


def fts_match_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "documents")
    e.sql("CREATE VIRTUAL TABLE pages USING fts4(body, origin)")
    e.sql("INSERT INTO pages (docid, body, origin) SELECT doc_id, text, source FROM documents")
    return e.sql("SELECT docid FROM pages WHERE body MATCH 'the AND this NOT for'")


def fts_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fts(spark, sf_dir).snippet('"of the"')


def fts_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fts(spark, sf_dir).offsets('"of the"')


def fts_matchinfo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fts(spark, sf_dir).matchinfo("this from")


def fts_porter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/part.parquet")
    return FullText(docs, "p_partkey", ["p_name", "p_type"], stem=True).match("p_type:polishing OR p_type:plating")


_W = "list_transform(regexp_extract_all(text, '[0-9A-Za-z\\x{80}-\\x{10FFFF}]+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"
_DOCS = f"WITH d AS (SELECT doc_id AS docid, source, {_W} AS w FROM documents)"
_POSTINGS = _DOCS + ", p AS (SELECT docid, i, w[i] AS t FROM d, unnest(range(1, len(w) + 1)) AS r(i))"
FTS: dict[str, tuple[str, str]] = {
    "fts_term": ("this", f"{_DOCS} SELECT docid FROM d WHERE list_contains(w, 'this')"),
    "fts_prefix": ("whic*", f"{_POSTINGS} SELECT DISTINCT docid FROM p WHERE starts_with(t, 'whic')"),
    "fts_column": ("source:src3", "SELECT doc_id AS docid FROM documents WHERE source = 'src3'"),
    "fts_phrase": ('"of the"', f"{_POSTINGS} SELECT DISTINCT a.docid FROM p a JOIN p b ON a.docid = b.docid AND b.i = a.i + 1 WHERE a.t = 'of' AND b.t = 'the'"),
    "fts_and": ("this from", f"{_DOCS} SELECT docid FROM d WHERE list_contains(w, 'this') AND list_contains(w, 'from')"),
    "fts_or": ("und OR les", f"{_DOCS} SELECT docid FROM d WHERE list_contains(w, 'und') OR list_contains(w, 'les')"),
    "fts_not": ("the NOT this", f"{_DOCS} SELECT docid FROM d WHERE list_contains(w, 'the') AND NOT list_contains(w, 'this')"),
    "fts_near": ("this NEAR/3 from", f"{_POSTINGS} SELECT DISTINCT a.docid FROM p a JOIN p b ON a.docid = b.docid AND abs(a.i - b.i) - 1 <= 3 WHERE a.t = 'this' AND b.t = 'from'"),
}

_T = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]+"
_PARTS = f"""{_DOCS}, q AS (SELECT docid, text, w, regexp_extract_all(text, '{_T}') AS raw, regexp_extract_all(text, '[^0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]*{_T}') AS parts FROM d JOIN documents ON doc_id = docid),
b AS (SELECT docid, i, w[i] AS t, strlen(raw[i]) AS size, sum(strlen(parts[i])) OVER (PARTITION BY docid ORDER BY i) - strlen(raw[i]) AS at FROM q, unnest(range(1, len(w) + 1)) AS r(i))"""
_OFFSETS = f"""{_PARTS}, h AS (SELECT a.docid, a.i, a.at AS at1, a.size AS s1, b.at AS at2, b.size AS s2 FROM b a JOIN b ON a.docid = b.docid AND b.i = a.i + 1 WHERE a.t = 'of' AND b.t = 'the')
SELECT docid, string_agg('0 0 ' || at1::BIGINT || ' ' || s1 || ' 0 1 ' || at2::BIGINT || ' ' || s2, ' ' ORDER BY i) AS"""
_SNIPPET = f"""{_PARTS}, h AS (SELECT docid, list(i - 1 ORDER BY i) AS hits FROM b WHERE t = 'which' GROUP BY docid),
p AS (SELECT q.docid, text, raw, parts, hits, len(raw) AS n, hits[1] AS p, list_max(list_filter(hits, lambda x: x < hits[1] + 6)) AS u FROM q JOIN h ON q.docid = h.docid),
f AS (SELECT *, greatest(0, least(p - (6 - (u - p + 1)) // 2, n - 6)) AS first FROM p),
g AS (SELECT *, least(n, first + 6) - 1 AS last FROM f)
SELECT docid, CASE WHEN first = 0 THEN '' ELSE '...' END || list_aggregate(list_transform(range(first, last + 1), lambda i: CASE WHEN i = first AND first > 0 THEN '' ELSE substr(parts[i + 1], 1, length(parts[i + 1]) - length(raw[i + 1])) END
  || CASE WHEN list_contains(hits, i) THEN '[' || raw[i + 1] || ']' ELSE raw[i + 1] END), 'string_agg', '') || CASE WHEN last = n - 1 THEN substr(text, length(list_aggregate(parts, 'string_agg', '')) + 1) ELSE '...' END AS s FROM g"""
_INT = lambda sql: f"(lpad(to_hex(({sql}) % 256), 2, '0') || lpad(to_hex(({sql}) // 256 % 256), 2, '0') || lpad(to_hex(({sql}) // 65536 % 256), 2, '0') || lpad(to_hex(({sql}) // 16777216), 2, '0'))"
_MATCHINFO = f"""{_DOCS}, n AS (SELECT docid, len(w) AS l, len(list_filter(w, lambda x: x = 'this')) AS h FROM d), g AS (SELECT count(*) AS n, sum(h)::BIGINT AS t, count(*) FILTER (h > 0) AS m FROM n)
SELECT docid, upper('0100000001000000' || {_INT('g.n')} || {_INT('l')} || {_INT('h')} || {_INT('t')} || {_INT('m')}) AS m FROM n, g WHERE h > 0"""


def _values(*lines: str) -> str:
    """DuckDB SQL of numbered lines."""
    rows = ", ".join("({}::BIGINT, '{}')".format(i, x.replace("'", "''")) for i, x in enumerate(lines, 1))
    return f"SELECT * FROM (VALUES {rows}) v(line, text)"


SPECIAL = {
    "refused": (refused, _values("RIGHT and FULL OUTER JOINs are not currently supported", "RIGHT and FULL OUTER JOINs are not currently supported", "not authorized", "no such index: none", "unable to use function MATCH in the requested context",
        "no such module: nothing", "SELECTs to the left and right do not have the same number of result columns", "wrong number of arguments to function glob()")),
    "constraints": (constraints, _values("ok", "ok", "PRIMARY KEY must be unique", "column b is not unique", "constraint failed", "t.d may not be NULL", "ok", "constraint failed", "PRIMARY KEY must be unique", "ok")),
    "conflict_policies": (conflict_policies, _values("ok", "PRIMARY KEY must be unique", "cannot commit - no transaction is active", "PRIMARY KEY must be unique") + " UNION ALL SELECT 105, 'old' UNION ALL SELECT 100 + n_nationkey, n_name FROM nation WHERE n_nationkey IN (3, 4)"),
    "attach": (attach, "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "text_import": (text_import, "SELECT n_nationkey::BIGINT AS k, n_name AS name FROM nation"),
    "script": (script, "SELECT count(*) AS n FROM nation"),
    "dump_and_restore": (dump_and_restore, "SELECT r_regionkey::BIGINT AS r_regionkey, CASE WHEN r_regionkey = 2 THEN 'logged' ELSE r_name END AS r_name FROM region"),
    "output_modes": (output_modes, _values("line:     k = 1", 'line:  name = AMERICA"', "line:  gone = -", "column: k           name        gone      ", "column: ----------  ----------  ----------", 'column: 1           AMERICA"    -         ',
        'explain: 1           AMERICA"    -         ', 'list: 1|AMERICA"|-', 'semi: 1|AMERICA"|-;', "html: <TR><TD>1</TD>\n<TD>AMERICA&quot;</TD>\n<TD>-</TD>\n</TR>", "insert: INSERT INTO table VALUES(1,'AMERICA\"',NULL);", 'tcl: "1" "AMERICA\\"" "-"', "csv: k,name,gone", 'csv: 1,"AMERICA""",-', 'tabs: 1\tAMERICA"\t-')),
    "shell_commands": (shell_commands, _values("n_name|x", "NATION_3|nil", "region", "1,2", "1,2", 'Error: unknown command or invalid arguments: "nothing". Enter ".help" for help')),
    "backup_restore": (backup, "SELECT n_nationkey, n_name, n_regionkey FROM nation"),
    "functions_by_arity": (functions_by_arity, "SELECT n_regionkey, min(n_name || '!') AS a, min(n_name || '-' || n_regionkey) AS b, max(n_nationkey)::DOUBLE AS m, max(n_nationkey + n_regionkey)::DOUBLE AS m2 FROM nation GROUP BY n_regionkey"),
    "user_collation": (user_collation, "SELECT n_nationkey FROM nation WHERE n_name IN ('NATION_7', 'NATION_11')"),
    "module_functions": (module_functions, "SELECT range * range AS square, range AS root, 4::BIGINT AS n FROM range(10)"),
    "tree_scan": (tree_scan, "SELECT * FROM (SELECT o_orderkey AS key, CASE WHEN o_orderkey = 502 THEN 'new' ELSE o_orderstatus END AS value FROM orders WHERE o_orderkey >= 500 AND o_orderkey <> 503 ORDER BY o_orderkey LIMIT 20) UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = 7"),
    "fts_offsets_sql": (fts_offsets_sql, f"{_OFFSETS} o FROM h GROUP BY docid"),
    "fts_snippet_sql": (fts_snippet_sql, _SNIPPET),
    "fts_matchinfo_sql": (fts_matchinfo_sql, _MATCHINFO),
    "fts_optimize_sql": (fts_optimize_sql, f"{_DOCS} SELECT docid, 'Index optimized' AS first, 'Index already optimal' AS then FROM d WHERE list_contains(w, 'which')"),
    "bind_parameters": (bind_parameters, "SELECT c_custkey, 't' AS tag FROM customer WHERE c_nationkey = 4 AND c_acctbal > 1000"),
    "widened_overflow": (widened_overflow, "SELECT o_orderkey, CASE WHEN o_orderkey = 1 THEN 9223372036854775807::DOUBLE ELSE o_orderkey * 9223372036854775807::DOUBLE END AS x FROM orders WHERE o_orderkey IN (1, 2, 3)"),
    "explain_query_plan": (explain, None),
    "scalar_udf": (scalar_udf, "SELECT n_nationkey, reverse(n_name) AS f FROM nation"),
    "aggregate_udf": (aggregate_udf, "SELECT c_nationkey, round(max(c_acctbal) - min(c_acctbal), 2) AS s FROM customer GROUP BY c_nationkey"),
    "virtual_table": (virtual_table_scan, "SELECT range::BIGINT AS value FROM range(991, 1001)"),
    "incremental_blob": (incremental_blob, "SELECT n_nationkey, substr(n_name, 3, 3) AS part, 'XY' || substr(n_name, 3) AS over FROM nation"),
    "fts_match_sql": (fts_match_sql, f"{_DOCS} SELECT docid FROM d WHERE list_contains(w, 'the') AND list_contains(w, 'this') AND NOT list_contains(w, 'for')"),
    "fts_snippet": (fts_snippet, None),
    "fts_offsets": (fts_offsets, f"{_OFFSETS} offsets FROM h GROUP BY docid"),
    "fts_matchinfo": (fts_matchinfo, f"{_POSTINGS}, n AS (SELECT docid, CASE t WHEN 'this' THEN 0 ELSE 1 END AS term, count(*) AS hits FROM p WHERE t IN ('this', 'from') GROUP BY 1, 2), g AS (SELECT term, sum(hits)::BIGINT AS all_hits, count(*) AS docs_with_hits FROM n GROUP BY term) SELECT n.docid, n.term, 0 AS col, n.hits, g.all_hits, g.docs_with_hits FROM n JOIN g ON n.term = g.term WHERE n.docid IN (SELECT docid FROM n GROUP BY docid HAVING count(*) = 2)"),
    "fts_porter": (fts_porter, "SELECT p_partkey AS docid FROM part WHERE regexp_matches(lower(p_type), '\\b(polish|plate)')"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: _select(sql) for name, (sql, _) in SELECTS.items()}
    out |= {name: _change(steps, sql) for name, (steps, sql, _) in CHANGES.items()}
    out |= {name: _match(query) for name, (query, _) in FTS.items()}
    out |= {f"wiki_{name}": _wiki(name) for name in wiki.QUERIES}
    out |= {f"wiki_{name}": _wiki_update(steps, sql) for name, (steps, sql, _) in wiki.UPDATES.items()}
    return out | {name: f for name, (f, _) in SPECIAL.items()}


def oracle_sql() -> dict[str, str]:
    out = {name: duck or sql for name, (sql, duck) in SELECTS.items()}
    out |= {name: duck for name, (_, _, duck) in CHANGES.items()}
    out |= {name: duck for name, (_, duck) in FTS.items()}
    out |= {f"wiki_{name}": wiki.duck(name) for name in wiki.QUERIES}
    out |= {f"wiki_{name}": duck for name, (_, _, duck) in wiki.UPDATES.items()}
    return out | {name: duck for name, (_, duck) in SPECIAL.items() if duck}
