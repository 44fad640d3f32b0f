"""Statements, constraints, transactions, full text, sources and the shell."""

import io

import pytest
from pyspark.sql import functions as F

from tessera.engine import ConstraintError, Engine
from tessera.functions.shims import glob_regex
from tessera.operators.fulltext import FullText, parse_match, porter
from tessera.operators.tree import Tree
from tessera.plans.lexer import SqlError, split_statements
from tessera.shell import Shell
from tessera.sources import delimited, formats, storage
from tessera.sources.virtual import SeriesSource, blob_write, virtual_table
from tessera.streaming.sink import apply_changes


@pytest.fixture
def engine(spark, data):
    return Engine(spark).register_folder(data, ["region", "nation", "customer", "orders", "lineitem"])


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_counts_and_sort(engine):
    """As many rows as went in, in order of a column that is not the key."""
    engine.sql("CREATE TABLE t1 (a INTEGER PRIMARY KEY, b INT)")
    engine.insert_rows("t1", engine.spark.range(5000).selectExpr("id AS a", "4999 - id AS b"))
    got = rows(engine.sql("SELECT a, b FROM t1 ORDER BY b"))
    assert got == [(4999 - i, i) for i in range(5000)]
    assert rows(engine.sql("SELECT count(*) FROM t1")) == [(5000,)]


def test_transfers_keep_the_sum(engine):
    engine.script("CREATE TABLE acc (kind VARCHAR(10) PRIMARY KEY, balance INTEGER); INSERT INTO acc VALUES ('CHECKING', 1000); INSERT INTO acc VALUES ('SAVINGS', 1000);")
    for amount in (10, 250):
        engine.sql("BEGIN")
        engine.sql("UPDATE acc SET balance = balance - ? WHERE kind = 'CHECKING'", [amount])
        engine.sql("UPDATE acc SET balance = balance + ? WHERE kind = 'SAVINGS'", [amount])
        engine.sql("COMMIT" if amount == 10 else "ROLLBACK")
    assert sorted(rows(engine.sql("SELECT * FROM acc"))) == [("CHECKING", 990), ("SAVINGS", 1010)]


@pytest.mark.parametrize(
    "expr,value",
    [
        ("7 / 2", 3), ("-7 / 2", -3), ("7 / 0", None), ("7 % 0", None), ("7.5 % 2", 1.0), ("1 << 64", 0), ("-1 >> 70", -1), ("1 << -1", 0), ("8 >> -2", 32),
        ("'12abc' + 1", 13.0), ("CAST('12abc' AS INT)", 12), ("NULL IN ()", 0), ("2 NOT IN (1, NULL)", None), ("NULL AND 0", 0), ("NOT NULL", None),
        ("'abc' LIKE 'A_C'", 1), ("'a_c' LIKE 'a\\_c'", 0), ("'10%' LIKE '10#%' ESCAPE '#'", 1), ("'abc' GLOB 'a*'", 1), ("'Abc' GLOB 'a*'", 0), ("'a]' GLOB 'a[]]'", 1),
        ("max(1, NULL, 3)", None), ("min(3, 1.5)", 1.5), ("substr('hello', -3, 2)", "ll"), ("substr('hello', 0, 2)", "h"), ("round(2.5)", 3.0), ("round(-2.5)", -3.0),
        ("1 < 'a'", 1), ("'a' < X'00'", 1), ("'ab  ' COLLATE RTRIM = 'ab'", 1), ("'AB' = 'ab' COLLATE NOCASE", 1), ("'É' = 'é' COLLATE NOCASE", 0),
        ("9223372036854775807 + 1", 9223372036854775808.0), ("1 IS NOT 2", 1), ("NULL IS NULL", 1), ("2 BETWEEN 1 AND 3", 1), ("CASE 3 WHEN 1 THEN 'a' ELSE 'b' END", "b"),
        ("date('2004-02-29', '+1 year')", "2005-03-01"), ("date('2004-01-31', '+1 month')", "2004-03-02"), ("strftime('%Y-%j', '2004-12-31')", "2004-366"),
        ("typeof(NULL)", "null"), ("quote('it''s')", "'it''s'"), ("coalesce(NULL, NULL, 4)", 4), ("nullif(1, 1)", None), ("trim('xaxx', 'x')", "a"), ("length(X'0102')", 2),
        ("replace('aaa', '', 'b')", "aaa"), ("hex(zeroblob(2))", "0000"), ("soundex('')", "?000"), ("+'7'", "7"), ("- '3x'", -3.0), ("~5", -6), ("'a' || NULL", None),
    ],
)
def test_expressions(engine, expr, value):
    got = rows(engine.sql(f"SELECT {expr}"))[0][0]
    assert got == value and type(got) is type(value)


@pytest.mark.parametrize(
    "bad,error",
    [
        ("SELECT * FROM nation RIGHT JOIN region ON 1", "not currently supported"), ("SELECT * FROM nowhere", "no such table"), ("SELECT zz FROM nation", "no such column"),
        ("SELECT sum(n_nationkey) FROM nation WHERE sum(n_nationkey) > 1", "misuse of aggregate"), ("SELECT n_name FROM nation INDEXED BY nix", "no such index"),
        ("SELECT 1 UNION SELECT 1, 2", "same number of result columns"), ("SELEC 1", "syntax error"), ("SELECT nofn(1)", "no such function"), ("COMMIT", "no transaction"),
        ("SELECT length()", "wrong number of arguments"), ("ROLLBACK TO x", "no such savepoint"), ("SELECT 'open", "unrecognized token"), ("SELECT 1 LIMIT 'x'", "datatype mismatch"),
    ],
)
def test_errors(engine, bad, error):
    with pytest.raises(SqlError, match=error):
        engine.sql(bad).collect()


def test_constraints(engine):
    engine.script("""CREATE TABLE t (a INTEGER PRIMARY KEY, b TEXT UNIQUE, c INT DEFAULT 5 CHECK (c < 100), d REAL NOT NULL DEFAULT 1.5);
        INSERT INTO t (b) VALUES ('x'); INSERT INTO t (b, c) VALUES ('y', 7)""")
    for bad in ("INSERT INTO t (b) VALUES ('x')", "INSERT INTO t (a) VALUES (1)", "INSERT INTO t (b, c) VALUES ('z', 500)", "INSERT INTO t (b, d) VALUES ('z', NULL)", "UPDATE t SET b = 'y'"):
        with pytest.raises(ConstraintError):
            engine.sql(bad)
    engine.sql("INSERT OR IGNORE INTO t (b) VALUES ('x')")
    assert engine.changes == 0
    engine.sql("REPLACE INTO t (b, c, d) VALUES ('x', 50, NULL)")
    assert sorted(rows(engine.sql("SELECT b, c, d FROM t"))) == [("x", 50, 1.5), ("y", 7, 1.5)]
    engine.sql("UPDATE OR IGNORE t SET b = 'y' WHERE b = 'x'")
    assert sorted(rows(engine.sql("SELECT b FROM t"))) == [("x",), ("y",)]


def test_registered_data_stay(engine, spark, data):
    before = spark.read.parquet(f"{data}/nation.parquet").count()
    engine.sql("DELETE FROM nation WHERE n_nationkey < 10")
    assert rows(engine.sql("SELECT count(*) FROM nation")) == [(before - 10,)]
    assert spark.read.parquet(f"{data}/nation.parquet").count() == before


def test_triggers_raise_and_hooks(engine):
    seen = []
    engine.script("""CREATE TABLE t (a INTEGER PRIMARY KEY, b INT); CREATE TABLE log (a INT);
        CREATE TRIGGER guard BEFORE INSERT ON t BEGIN SELECT CASE WHEN new.b < 0 THEN RAISE(ABORT, 'negative') END; END;
        CREATE TRIGGER note AFTER DELETE ON t BEGIN INSERT INTO log VALUES (old.a); END;""")
    engine.on("INSERT", "t", lambda old, new: seen.append(new.count()))
    engine.sql("INSERT INTO t VALUES (1, 5)")
    with pytest.raises(ConstraintError, match="negative"):
        engine.sql("INSERT INTO t VALUES (2, -1)")
    engine.sql("DELETE FROM t")
    assert seen == [1] and rows(engine.sql("SELECT a FROM log")) == [(1,)]


@pytest.mark.parametrize("action,left", [("CASCADE", []), ("SET NULL", [(1, None)]), ("SET DEFAULT", [(1, 2)])])
def test_foreign_key_actions(engine, action, left):
    engine.script(f"""PRAGMA foreign_keys = ON; CREATE TABLE p (id INTEGER PRIMARY KEY); INSERT INTO p VALUES (1); INSERT INTO p VALUES (2);
        CREATE TABLE c (id INTEGER PRIMARY KEY, p INTEGER DEFAULT 2 REFERENCES p (id) ON DELETE {action}); INSERT INTO c VALUES (1, 1)""")
    with pytest.raises(ConstraintError):
        engine.sql("INSERT INTO c VALUES (2, 99)")
    engine.sql("DELETE FROM p WHERE id = 1")
    assert [r for r in rows(engine.sql("SELECT id, p FROM c")) if r[0] == 1] == left


def test_attach_views_pragmas(engine, data):
    engine.sql(f"ATTACH '{data}' AS other")
    assert rows(engine.sql("SELECT count(*) FROM other.nation")) == [(25,)]
    engine.sql("DETACH other")
    engine.sql("CREATE VIEW v AS SELECT n_name FROM nation WHERE n_regionkey = 1")
    assert rows(engine.sql("SELECT count(*) FROM v")) == [(5,)]
    engine.sql("CREATE UNIQUE INDEX u ON nation (n_name)")
    assert rows(engine.sql("PRAGMA index_list(nation)")) == [(0, "u", 1)]
    assert rows(engine.sql("SELECT n_nationkey FROM nation INDEXED BY u WHERE n_name = 'NATION_3'")) == [(3,)]
    engine.sql("DROP VIEW v")
    with pytest.raises(SqlError):
        engine.sql("SELECT * FROM v")


def test_plans(engine):
    plan = engine.sql("SELECT o_totalprice FROM orders WHERE o_orderkey = 7")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,7)]" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_functions(engine):
    engine.create_function("twice", lambda x: None if x is None else 2 * x, "int")
    engine.create_function("join2", lambda a, b: f"{a}-{b}", "text", 2)
    engine.create_function("join2", lambda a: f"{a}!", "text", 1)
    got = engine.sql("SELECT twice(n_nationkey), join2(n_nationkey, 'x'), join2(n_name) FROM nation WHERE n_nationkey = 4")
    assert rows(got) == [(8, "4-x", "NATION_4!")]
    engine.create_collation("BACK", lambda sql: f"reverse({sql})")
    got = engine.sql("SELECT x FROM (SELECT 'az' AS x UNION ALL SELECT 'ba') ORDER BY x COLLATE BACK")
    assert rows(got) == [("ba",), ("az",)]
    with pytest.raises(SqlError, match="no such collation"):
        engine.sql("SELECT 'a' = 'b' COLLATE NONE")


def test_trigger_updates_and_deletes(engine):
    engine.script("""CREATE TABLE t (a INTEGER PRIMARY KEY, b INT); CREATE TABLE total (k INTEGER PRIMARY KEY, n INT); CREATE TABLE copy (a INT);
        INSERT INTO total VALUES (1, 0); INSERT INTO copy VALUES (5); INSERT INTO copy VALUES (6);
        CREATE TRIGGER up AFTER INSERT ON t BEGIN UPDATE total SET n = n + new.b WHERE k = 1; END;
        CREATE TRIGGER down AFTER DELETE ON t BEGIN DELETE FROM copy WHERE a = old.b; END;
        INSERT INTO t VALUES (1, 5)""")
    assert rows(engine.sql("SELECT n FROM total")) == [(5,)]
    engine.sql("DELETE FROM t")
    assert rows(engine.sql("SELECT a FROM copy")) == [(6,)]


def test_full_text(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox", "a"), (2, "Quick! the fox, brown", "b"), (3, "lazy dogs", "quick"), (4, None, None)], "id long, body string, title string")
    fts = FullText(docs, "id", ["body", "title"])

    def ids(q, column=None):
        return sorted(r[0] for r in fts.match(q, column).collect())

    assert ids("quick") == [1, 2, 3] and ids("quick", "body") == [1, 2] and ids("title:quick") == [3]
    assert ids('"quick brown"') == [1] and ids("qui* NOT lazy") == [1, 2] and ids("fox OR dogs") == [1, 2, 3] and ids("fox lazy") == []
    assert ids("quick NEAR/0 brown") == [1] and ids("quick NEAR/2 brown") == [1, 2] and ids("(fox OR dogs) AND quick") == [1, 2, 3]
    assert dict(rows(fts.offsets("fox"))) == {1: "0 0 16 3", 2: "0 0 11 3"}
    assert dict(rows(fts.snippet("fox")))[1] == "the quick brown <b>fox</b>"
    assert sorted(rows(fts.matchinfo("fox"))) == [(1, 0, 0, 1, 2, 2), (2, 0, 0, 1, 2, 2)]
    with pytest.raises(SqlError):
        parse_match("(a")


def test_saved_postings(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the quick fox"), (2, "a quick dog")], "id long, body string")
    fts = FullText(docs, "id", ["body"]).save(str(tmp_path / "postings"))
    assert sorted(r[0] for r in fts.match('"quick dog" OR the').collect()) == [1, 2]
    plan = fts.match("quick")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,quick)" in plan


@pytest.mark.parametrize("word,stem", [("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("relational", "relat"), ("happy", "happi"), ("plating", "plate"), ("controlling", "control"), ("at", "at")])
def test_porter(word, stem):
    assert porter(word) == stem


def test_import_formats_dump(engine, tmp_path):
    path = tmp_path / "in.txt"
    path.write_text("1|a|2.5\n2|b c|x\n")
    engine.sql("CREATE TABLE t (a INTEGER, b TEXT, c REAL)")
    assert delimited.import_delimited(engine, str(path), "t") == 2
    df = engine.sql("SELECT a, b FROM t ORDER BY a")
    assert list(formats.render(df, "csv", header=True)) == ["a,b", "1,a", '2,"b c"']
    assert list(formats.render(df, "insert", table="t"))[0] == "INSERT INTO t VALUES(1,'a');"
    assert list(formats.render(df, "line"))[:2] == ["    a = 1", "    b = a"]
    assert list(formats.render(df, "html"))[0] == "<TR><TD>1</TD>\n<TD>a</TD>\n</TR>"
    for mode in formats.MODES:
        assert list(formats.render(df, mode, header=True))
    path.write_text("1|a|2\n1|a\n")
    with pytest.raises(SqlError, match="expected 3 columns"):
        delimited.import_delimited(engine, str(path), "t")
    assert rows(engine.sql("SELECT count(*) FROM t")) == [(2,)]
    again = Engine(engine.spark)
    again.script("\n".join(formats.dump(engine, ["t"])))
    assert rows(again.sql("SELECT count(*), max(b) FROM t")) == [(2, "b c")]
    delimited.write_delimited(df, str(tmp_path / "out"), "|", header=True)
    storage.backup(df, str(tmp_path / "bak"))
    assert storage.restore(engine.spark, str(tmp_path / "bak")).count() == 2


def test_shell(engine):
    shell = Shell(engine)
    shell.out = io.StringIO()
    shell.run([".header on\n", ".mode csv\n", "SELECT n_nationkey, n_name FROM nation\n", "WHERE n_nationkey < 2 ORDER BY 1;\n", ".tables nat\n", "SELECT nope;\n", ".bogus\n", ".quit\n"])
    lines = shell.out.getvalue().splitlines()
    assert lines[:4] == ["n_nationkey,n_name", "0,NATION_0", "1,NATION_1", "nation"] and lines[4].startswith("Error: no such column") and lines[5].startswith("Error: unknown command")


def test_split_statements():
    assert split_statements("SELECT ';'; -- x;\n/* ; */ CREATE TRIGGER t AFTER INSERT ON a BEGIN SELECT 1; SELECT 2; END; SELECT 3") == [
        "SELECT ';'", "-- x;\n/* ; */ CREATE TRIGGER t AFTER INSERT ON a BEGIN SELECT 1; SELECT 2; END", "SELECT 3"
    ]


def test_glob_regex():
    assert glob_regex("a[^b-c]?*.") == "(?s)\\Aa[^b-c]..*\\.\\z"


def test_virtual_table_and_blobs(spark):
    df = virtual_table(spark, SeriesSource, start=1, stop=100).filter("value >= 98")
    assert sorted(r[0] for r in df.collect()) == [98, 99, 100]
    got = spark.createDataFrame([(bytearray(b"abcdef"),)], "b binary").select(blob_write("b", 2, b"XY"), blob_write("b", 5, b"XY")).first()
    assert bytes(got[0]) == b"abXYef" and got[1] is None


def test_tree(engine):
    tree = Tree(engine, "kv")
    pairs = engine.spark.range(20).select(F.col("id").alias("key"), F.col("id").cast("string").cast("binary").alias("value"))
    assert tree.insert(pairs) == 20
    assert bytes(tree.lookup(7).first()[0]) == b"7"
    assert tree.delete(7) == 1 and tree.lookup(7).isEmpty()
    assert [r["key"] for r in tree.scan(6, 3).collect()] == [6, 8, 9]
    with pytest.raises(ConstraintError):
        tree.insert(pairs)
    tree.update(pairs)
    assert tree.scan(0, 100).count() == 20


def test_stream_of_changes(engine, spark, tmp_path):
    engine.sql("CREATE TABLE t (k INTEGER PRIMARY KEY, v TEXT)")
    spark.createDataFrame([(1, "a", "U"), (2, "b", "U")], "k long, v string, op string").coalesce(1).write.json(str(tmp_path / "in"))
    step = apply_changes(engine, "t", "k")
    query = spark.readStream.schema("k long, v string, op string").json(str(tmp_path / "in")).writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    step(spark.createDataFrame([(1, None, "D"), (2, "c", "U"), (3, "d", "U")], "k long, v string, op string"), 1)
    assert sorted(rows(engine.sql("SELECT k, v FROM t"))) == [(2, "c"), (3, "d")]


def _folders(engine, name):
    import os

    top = f"{engine.root.removeprefix('file://')}/{name}"
    return sorted(os.listdir(top)) if os.path.isdir(top) else []


def test_plain_changes_are_one_pass(engine, monkeypatch):
    plans = []
    engine.sql("CREATE TABLE one_pass AS SELECT c_custkey, c_acctbal, c_name FROM customer")
    rewrite = engine._rewrite
    monkeypatch.setattr(engine, "_rewrite", lambda t, marked, after: plans.append(after(marked)._jdf.queryExecution().executedPlan().toString()) or rewrite(t, marked, after))
    engine.sql("UPDATE one_pass SET c_acctbal = 0 WHERE c_custkey < 10")
    assert engine.changes == 10
    engine.sql("DELETE FROM one_pass WHERE c_custkey < 4")
    assert engine.changes == 4
    assert len(plans) == 2 and not any("Join" in p or "Exchange" in p for p in plans)
    assert rows(engine.sql("SELECT count(*), sum(c_acctbal = 0) FROM one_pass WHERE c_custkey < 10")) == [(6, 6)]
    before = engine.table("one_pass").parts
    engine.sql("UPDATE one_pass SET c_acctbal = 1 WHERE c_custkey < 0")
    assert engine.changes == 0 and engine.table("one_pass").parts == before


def test_inserts_add_folders(engine):
    engine.sql("CREATE TABLE appended (a INTEGER PRIMARY KEY, b INT)")
    for k in range(20):
        first = dict(engine.table("appended").parts)
        engine.insert_rows("appended", engine.spark.range(10).selectExpr(f"id + {10 * k} AS a", "id AS b"))
        assert k >= 15 or set(first) < set(dict(engine.table("appended").parts))
    assert len(engine.table("appended").parts) < 16
    assert [r[0] for r in rows(engine.sql("SELECT a FROM appended ORDER BY a"))] == list(range(200))


def test_vacuum_leaves_one_folder(engine):
    engine.script("CREATE TABLE kept_small (a INTEGER); INSERT INTO kept_small VALUES (1); INSERT INTO kept_small VALUES (2); UPDATE kept_small SET a = a + 1; DELETE FROM kept_small WHERE a = 2")
    assert len(_folders(engine, "kept_small")) > 1 and not _folders(engine, "kept_small-rows")
    engine.sql("VACUUM")
    assert len(_folders(engine, "kept_small")) == 1 and rows(engine.sql("SELECT a FROM kept_small")) == [(3,)]
    engine.sql("BEGIN")
    for _ in range(3):
        engine.sql("UPDATE kept_small SET a = a + 1")
    with pytest.raises(SqlError, match="within a transaction"):
        engine.sql("VACUUM")
    engine.sql("COMMIT")
    assert len(_folders(engine, "kept_small")) == 2 and rows(engine.sql("SELECT a FROM kept_small")) == [(6,)]
    engine.script("BEGIN; DELETE FROM kept_small; ROLLBACK")
    assert rows(engine.sql("SELECT a FROM kept_small")) == [(6,)]


def test_row_ids_of_created_tables(engine):
    before = engine.spark.conf.get("spark.sql.shuffle.partitions")
    engine.spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        engine.sql("CREATE TABLE numbered AS SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY o_custkey")
    finally:
        engine.spark.conf.set("spark.sql.shuffle.partitions", before)
    n = rows(engine.sql("SELECT count(*) FROM numbered"))[0][0]
    assert sorted(r[0] for r in rows(engine.sql("SELECT rowid FROM numbered"))) == list(range(1, n + 1))


def test_collations_are_of_one_engine(engine):
    engine.create_collation("MINE", lambda sql: f"reverse({sql})")
    with pytest.raises(SqlError, match="no such collation"):
        Engine(engine.spark).sql("SELECT 'a' = 'b' COLLATE MINE")


def test_bare_columns_are_of_one_row(engine):
    got = rows(engine.sql("SELECT n_regionkey, n_name, n_nationkey FROM nation GROUP BY n_regionkey ORDER BY n_name || n_nationkey"))
    assert len(got) == 5 and all(name == f"NATION_{key}" for _, name, key in got)


def test_fail_and_deferred_keys(engine):
    engine.script("PRAGMA foreign_keys = ON; CREATE TABLE p (id INTEGER PRIMARY KEY); CREATE TABLE c (id INTEGER PRIMARY KEY, p INTEGER REFERENCES p (id) DEFERRABLE INITIALLY DEFERRED)")
    with pytest.raises(ConstraintError):
        engine.sql("INSERT INTO c VALUES (1, 9)")
    engine.sql("DELETE FROM c")
    engine.script("BEGIN; INSERT INTO c VALUES (1, 9)")
    with pytest.raises(ConstraintError):
        engine.sql("COMMIT")
    engine.script("INSERT INTO p VALUES (9); COMMIT")
    assert rows(engine.sql("SELECT count(*) FROM c")) == [(1,)]


def test_views_without_triggers_do_not_change(engine):
    engine.sql("CREATE VIEW v AS SELECT n_name FROM nation")
    for s in ("INSERT INTO v VALUES ('x')", "UPDATE v SET n_name = 'x'", "DELETE FROM v"):
        with pytest.raises(SqlError, match="cannot modify v because it is a view"):
            engine.sql(s)
    with pytest.raises(SqlError, match="cannot create INSTEAD OF trigger on table"):
        engine.sql("CREATE TRIGGER tr INSTEAD OF DELETE ON nation BEGIN SELECT RAISE(IGNORE); END")


@pytest.mark.parametrize("pattern", ["a*", "[]]x", "[^]]x", "a?c", "[a", "*[0-9]", "\\Q.*", "[\\]x", "a.c", "", "[^a-c]*"])
def test_glob_of_a_column(engine, pattern):
    texts = ["abc", "a.c", "]x", "[a", "\\x", "\\Q.*", "x9", "", "zz", "a"]
    df = engine.spark.createDataFrame([(t, pattern) for t in texts], "t string, p string")
    engine.register("globs", df)
    got = [bool(r[0]) for r in rows(engine.sql("SELECT t GLOB p FROM globs"))]
    assert got == [bool(r[0]) for r in rows(engine.sql("SELECT t GLOB ? FROM globs", [pattern]))]


def test_full_text_postings_follow_changes(engine):
    engine.script("CREATE VIRTUAL TABLE notes USING fts4(body, tokenize=porter); INSERT INTO notes (docid, body) VALUES (1, 'running dogs'); INSERT INTO notes (docid, body) VALUES (2, 'a dog runs')")
    assert sorted(rows(engine.sql("SELECT docid FROM notes WHERE notes MATCH 'run'"))) == [(1,), (2,)]
    assert len(engine._postings) >= 2
    engine.sql("UPDATE notes SET body = 'cats' WHERE docid = 1")
    assert rows(engine.sql("SELECT docid, offsets(notes) FROM notes WHERE body MATCH 'dogs'")) == [(2, "0 0 2 3")]
    assert rows(engine.sql("SELECT snippet(notes) FROM notes WHERE docid = 1")) == [("",)]
    engine.sql("DELETE FROM notes")
    assert rows(engine.sql("SELECT docid FROM notes WHERE notes MATCH 'run'")) == []
    for bad, error in (("SELECT offsets(nation) FROM nation", "unable to use function offsets"), ("CREATE VIRTUAL TABLE x USING fts4(a, tokenize=icu)", "unknown tokenizer"), ("SELECT matchinfo(notes, 'z') FROM notes WHERE notes MATCH 'a'", "unrecognized matchinfo")):
        with pytest.raises(SqlError, match=error):
            engine.sql(bad)


def test_changes_in_order_of_a_column(engine, spark):
    engine.sql("CREATE TABLE streamed (k INTEGER PRIMARY KEY, v TEXT)")
    changes = spark.createDataFrame([(1, "late", "U", 9), (1, "early", "U", 1), (2, "x", "U", 1), (2, None, "D", 2)], "k long, v string, op string, at long").repartition(4)
    apply_changes(engine, "streamed", "k", order="at")(changes, 0)
    assert rows(engine.sql("SELECT k, v FROM streamed")) == [(1, "late")]


def test_restore_is_checked(engine):
    engine.script("CREATE TABLE checked (a INTEGER PRIMARY KEY, b INT CHECK (b > 0)); INSERT INTO checked VALUES (1, 1)")
    with pytest.raises(ConstraintError):
        engine.restore("checked", engine.spark.createDataFrame([(1, -1)], "a long, b long"))
    with pytest.raises(SqlError):
        engine.restore("checked", engine.spark.createDataFrame([(1, "x")], "a long, b string"))
    engine.restore("checked", engine.spark.createDataFrame([(7, 2)], "a long, b long"))
    assert rows(engine.sql("SELECT a, b FROM checked")) == [(7, 2)]
