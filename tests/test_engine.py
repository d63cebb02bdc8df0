"""The engine: statements, constraints, transactions, history, full-text search, reactive views."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlwick.engine import Engine
from marlwick.functions import json_paths
from marlwick.functions.scalar import DialectError
from marlwick.operators import fts
from marlwick.plans.syntax import Parser
from marlwick.plans.translate import Translator
from marlwick.streaming import ivm


@pytest.fixture
def db(spark, tmp_path):
    return Engine(spark, str(tmp_path / "db"))


def rows(db, sql, *args):
    return [tuple(r) for r in db.query(sql, *args).collect()]


def one(db, sql):
    return rows(db, f"SELECT {sql}")[0]


def test_expressions(db):
    assert one(db, "7/2, -7/2, 7.0/2, 5%0, 1<<70, -8>>1, 'a'||1") == (3, -3, 3.5, None, 0, -4, "a1")
    assert one(db, "3='3', 3<'a', x'00'>'z', NULL=1, NULL AND 0, NULL OR 1") == (0, 1, 1, None, 0, 1)
    assert one(db, "'ABC' LIKE 'a_c', 'a\\b' LIKE 'a\\b', 'abc' GLOB 'A*', 'a[b' GLOB 'a[?'") == (1, 1, 0, 1)
    assert one(db, "CAST('3.7abc' AS INTEGER), CAST('x' AS INTEGER), CAST('1e2z' AS REAL), CAST(-2.9 AS INTEGER)") == (3, 0, 100.0, -2)
    assert one(db, "hex(255), hex(NULL), char(9731, 65), unicode('☃'), unicode(''), length(5), typeof(x'00')") == ("323535", "", "☃A", 9731, None, None, "blob")
    assert one(db, "date('2024-02-03 04:05:06'), date('2024-02-03', '+1 day'), date('x'), strftime('%j', '2024-02-03')") == ("2024-02-03", None, None, "034")
    assert one(db, "json_type('[1,{}]', '$[1]'), json_extract('{\"a\":true}', '$.a'), json_insert('[1,2]', '$[1]', 9), json_valid('{')") == ("object", "1", "[1,9,2]", 0)
    assert one(db, "CASE NULL WHEN NULL THEN 1 ELSE 2 END, 9007199254740993 = 9007199254740992.0, NULLIF(2, 2), IIF(0, 1, 2)") [0::2] == (2, None)
    assert one(db, "2 IN (1, NULL), 1 IN (1, NULL), 2 BETWEEN 1 AND 2, NOT 0, ~5") == (None, 1, 1, 1, -6)


def test_refusals(db):
    db.execute("CREATE TABLE t (a INTEGER, b TEXT)")
    for sql in ("SELECT a, COUNT(*) FROM t", "SELECT SUM(b) FROM t", "SELECT nope FROM t", "SELECT a FROM t ORDER BY 3", "SELECT 1 UNION SELECT 1, 2", "SELECT * FROM t RIGHT JOIN t AS u ON 1", "SELECT a FROM t GROUP BY a + 1",
                "SELECT LAG(a) OVER (ORDER BY a ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM t", "SELECT COUNT(DISTINCT a) OVER () FROM t", "SELECT nofunc(a) FROM t", "SELECT 1 FROM missing"):
        with pytest.raises(DialectError):
            db.query(sql)
    with pytest.raises(DialectError):
        db.execute("INSERT INTO t VALUES (1.0, 'x')")


def test_division_by_zero_raises(db):
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        db.query("SELECT 1/0").collect()


def test_recursion_without_the_session_factory_settings(spark, tmp_path):
    plain = spark.newSession()
    for limit in ("Level", "Row"):
        plain.conf.set(f"spark.sql.cteRecursion{limit}Limit", "100")
    db = Engine(plain, str(tmp_path / "db"))
    got = rows(db, "WITH RECURSIVE f AS (SELECT 0 AS i, 0 AS v UNION ALL SELECT i + 1, v + i FROM f WHERE i < 150) SELECT i, v FROM f")
    assert sorted(got) == [(i, i * (i - 1) // 2) for i in range(151)]


def test_constraints(db):
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, u TEXT UNIQUE, n INTEGER NOT NULL CHECK (n > 0))")
    db.execute("INSERT INTO t VALUES (1, 'a', 1), (2, NULL, 2), (3, NULL, 3)")
    for sql in ("INSERT INTO t VALUES (1, 'b', 1)", "INSERT INTO t VALUES (4, 'a', 1)", "INSERT INTO t VALUES (4, 'c', 0)", "INSERT INTO t VALUES (4, 'c', NULL)", "UPDATE t SET id = 2 WHERE id = 1"):
        with pytest.raises(DialectError):
            db.execute(sql)
    assert rows(db, "SELECT COUNT(*) FROM t") == [(3,)]
    db.execute("INSERT OR IGNORE INTO t VALUES (9, 'z', NULL), (1, 'y', 5), (8, 'w', 5)")
    assert rows(db, "SELECT id FROM t ORDER BY id") == [(1,), (2,), (3,), (8,)]
    assert rows(db, "PRAGMA integrity_check") == [("ok",)]
    with pytest.raises(DialectError):
        db.execute("CREATE UNIQUE INDEX i ON t (n % 2)")


def test_change_counts_returning_and_hooks(db):
    seen = []
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, v INTEGER)")
    db.hook("t", "after", "update", lambda feed: seen.extend(tuple(r) for r in feed.collect()))

    def veto(feed):
        if feed.where("old_v > 100").count():
            raise DialectError("kept")

    db.hook("t", "before", "delete", veto)
    assert db.execute("INSERT INTO t VALUES (1, 10), (2, 200)").count == 2
    changed = db.execute("UPDATE t SET v = v + 1 WHERE id = 1 RETURNING v")
    assert changed.count == 1 and changed.returned.first()[0] == 11
    assert seen == [("update", 1, 1, 10, 1, 11)]
    with pytest.raises(DialectError):
        db.execute("DELETE FROM t")
    assert rows(db, "SELECT COUNT(*) FROM t") == [(2,)]
    assert rows(db, "SELECT CHANGES()") == [(1,)] and rows(db, "SELECT LAST_INSERT_ROWID()") == [(2,)]


def test_transactions_and_history(spark, tmp_path):
    now = [100.0]
    db = Engine(spark, str(tmp_path / "db"), clock=lambda: now[0])
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY)")
    for k in range(3):
        now[0] += 10
        db.execute("INSERT INTO t VALUES (?)", k)
    with pytest.raises(RuntimeError), db.transaction():
        db.execute("DELETE FROM t")
        raise RuntimeError
    assert rows(db, "SELECT COUNT(*) FROM t") == [(3,)]
    assert db.query_as_of("SELECT COUNT(*) FROM t", ts=115).first()[0] == 1
    assert db.query_as_of("SELECT COUNT(*) FROM t", txn=3).first()[0] == 2
    with pytest.raises(DialectError):
        db.query_as_of("SELECT COUNT(*) FROM t", ts=1)
    db.execute("VACUUM")
    again = Engine(spark, str(tmp_path / "db"))
    assert rows(again, "SELECT id FROM t ORDER BY id") == [(0,), (1,), (2,)]
    dump = list(again.dump())
    copy = Engine(spark, str(tmp_path / "copy"))
    for sql in dump:
        copy.execute(sql)
    assert list(copy.dump()) == dump


def test_full_text(db):
    db.execute("CREATE VIRTUAL TABLE f USING fts5(title, body)")
    db.execute("INSERT INTO f VALUES ('One', 'The Quick brown fox'), ('Two', 'quick quick dog. Brown fox'), ('Straße', 'nothing')")
    assert rows(db, "SELECT title FROM f WHERE f MATCH 'quick'") == [("Two",), ("One",)]
    assert rows(db, "SELECT title FROM f WHERE f MATCH 'quick -dog'") == [("One",)]
    assert rows(db, "SELECT title FROM f WHERE f MATCH '\"brown fox\" OR strasse' ORDER BY title") == [("One",), ("Straße",), ("Two",)]
    assert rows(db, "SELECT snippet(f, 1, '[', ']', '...', 2) FROM f WHERE f MATCH 'bro*' LIMIT 1 OFFSET 1")[0][0].count("[") == 1
    assert fts.parse("a -b OR \"c d\" e*") == [[fts.Term(("a",)), fts.Term(("b",), negated=True)], [fts.Term(("c", "d")), fts.Term(("e",), prefix=True)]]


def test_reactive_views_match_recompute(db):
    changes = []
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, g TEXT, v INTEGER)")
    db.execute("INSERT INTO t VALUES (1, 'a', 5), (2, 'a', NULL), (3, 'b', -4)")
    db.execute("CREATE REACTIVE VIEW s AS SELECT g, SUM(v) AS s FROM t GROUP BY g")
    db.execute("CREATE REACTIVE VIEW m AS SELECT g, MAX(v) AS m FROM t GROUP BY g")
    ivm.on_change(db, "s", lambda z: changes.append({(r.g, r.s, r._w) for r in z.collect()}))
    for sql in ("INSERT INTO t VALUES (4, 'b', 4), (5, NULL, 1)", "UPDATE t SET g = 'c' WHERE id = 1", "DELETE FROM t WHERE g = 'b'"):
        db.execute(sql)
        for view, f in (("s", "SUM"), ("m", "MAX")):
            assert sorted(rows(db, f"SELECT * FROM {view}"), key=str) == sorted(rows(db, f"SELECT g, {f}(v) FROM t GROUP BY g"), key=str)
    assert changes[0] == {("b", -4, -1), ("b", 0, 1), (None, 1, 1)}
    with pytest.raises(DialectError):
        db.execute("CREATE REACTIVE VIEW x AS SELECT g, COUNT(v) AS n FROM t GROUP BY g REFRESH DELTA")


def test_incremental_join_equals_recompute(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, x string")
    right = spark.createDataFrame([(1, "p"), (2, "q"), (3, "r")], "k int, y string")
    l0, r0 = ivm.weighted(left.limit(2)), ivm.weighted(right.limit(2))
    l1, r1 = ivm.weighted(left), ivm.weighted(right.where("k <> 1"))
    before = ivm.step_join(l0.limit(0), r0.limit(0), l0, r0, ["k"])
    after = ivm.add(before, ivm.step_join(l0, r0, ivm.subtract(l1, l0), ivm.subtract(r1, r0), ["k"]))
    assert {tuple(r) for r in after.collect()} == {(2, "b", "q", 1), (2, "c", "q", 1)}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="SELECT abc'\"(),*=<>1.5?:", max_size=40))
def test_parser_never_crashes(text):
    try:
        Parser(text).query()
    except DialectError:
        pass


@settings(max_examples=100, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers(-99, 99) | st.text(max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("ab", min_size=1, max_size=2), x, max_size=3), max_leaves=8))
def test_json_paths(value):
    text = json_paths.dump(value)
    assert json_paths.kind(text) == ("null" if value is None else json_paths.kind(text))
    if isinstance(value, list):
        assert json_paths.edit("set", text, [f"$[{len(value)}]", "7"]) == json_paths.dump([*value, 7])
        assert json_paths.edit("insert", text, ["$[0]", "7"]) == json_paths.dump([7, *value])
        assert json_paths.edit("set", text, [f"$[{len(value) + 1}]", "7"]) == text


def test_set_operations_are_left_associative():
    sql = Translator(lambda n: None).translate("SELECT 1 UNION SELECT 2 INTERSECT SELECT 3")
    assert sql.index("UNION") < sql.index("INTERSECT") and sql.startswith("((")


def test_plans(spark):
    """Filters and columns reach the scan, and top-k and semi joins stay what they should be."""
    from marlwick.plans.catalogue import QUERIES

    spark.conf.set("spark.sql.maxMetadataStringLength", "3000")  # else the list of pushed filters is cut
    plan = lambda n: QUERIES[n](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    scan = plan("tpch_q6")
    assert "LessThan(l_quantity,24.0)" in scan and "GreaterThanOrEqual(l_shipdate" in scan and "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double,l_shipdate:timestamp_ntz>" in scan
    assert "LeftSemi" in plan("b18_exists") and "LeftAnti" in plan("b18_not_exists")
    assert "TakeOrderedAndProject" in plan("f5_top_k")
    assert "CartesianProduct" not in plan("tpch_q5")


def taken(db, sql, *args):
    return sorted(map(tuple, db.query(sql, *args).collect()))


def test_trigger_bodies(db):
    for sql in (
        "CREATE TABLE t(n INTEGER, s TEXT)",
        "CREATE TABLE total(s TEXT, sum INTEGER, last INTEGER)",
        "CREATE TABLE log(what TEXT, n INTEGER)",
        "INSERT INTO total VALUES ('a', 0, NULL), ('b', 100, NULL), ('c', 7, NULL)",
        "CREATE TRIGGER add_up AFTER INSERT ON t BEGIN UPDATE total SET sum = sum + NEW.n, last = NEW.n WHERE s = NEW.s; "
        "INSERT INTO log SELECT 'over ' || total.s, NEW.n FROM total WHERE total.s = NEW.s AND sum > 5; END",
        "CREATE TRIGGER take_off AFTER DELETE ON t WHEN OLD.n > 1 BEGIN DELETE FROM total WHERE s = OLD.s; END",
        "INSERT INTO t VALUES (1, 'a'), (2, 'a'), (3, 'b')",
    ):
        db.execute(sql)
    # Changes of one row are applied in their order; all of them before the next statement of the body.
    assert taken(db, "SELECT * FROM total WHERE last IS NOT NULL") == [("a", 3, 2), ("b", 103, 3)]
    assert taken(db, "SELECT * FROM total WHERE last IS NULL") == [("c", 7, None)]
    assert taken(db, "SELECT * FROM log") == [("over b", 3)]
    db.execute("DELETE FROM t WHERE s = 'a'")
    assert taken(db, "SELECT s FROM total") == [("b",), ("c",)]


def test_folds_of_a_trigger_go_in_parts(db, monkeypatch):
    monkeypatch.setattr("marlwick.engine.TRIGGER_FOLD", 3)
    db.execute("CREATE TABLE t(n INTEGER)")
    db.execute("CREATE TABLE digits(v INTEGER)")
    db.execute("INSERT INTO digits VALUES (0), (9)")
    db.execute("CREATE TRIGGER append AFTER INSERT ON t BEGIN UPDATE digits SET v = v * 10 + NEW.n WHERE v = 0; END")
    db.execute("INSERT INTO t VALUES (1), (2), (3), (4), (5), (6), (7)")
    assert taken(db, "SELECT v FROM digits") == [(9,), (1234567,)]


def test_triggers_nest_to_a_depth(db):
    db.execute("CREATE TABLE t(n INTEGER)")
    db.execute("CREATE TRIGGER again AFTER INSERT ON t WHEN NEW.n < 3 BEGIN INSERT INTO t VALUES (NEW.n + 1); END")
    db.execute("INSERT INTO t VALUES (1)")
    assert taken(db, "SELECT n FROM t") == [(1,), (2,)]  # a trigger doesn't start itself
    db.execute("PRAGMA recursive_triggers = on")
    db.execute("INSERT INTO t VALUES (1)")
    assert taken(db, "SELECT n FROM t") == [(1,), (1,), (2,), (2,), (3,)]
    db.execute("CREATE TRIGGER forever AFTER INSERT ON t WHEN NEW.n > 9 BEGIN INSERT INTO t VALUES (NEW.n + 1); END")
    with pytest.raises(DialectError, match="nested"):
        db.execute("INSERT INTO t VALUES (10)")
    assert taken(db, "SELECT COUNT(*) FROM t") == [(5,)]


def test_views_take_changes_through_triggers(db):
    db.execute("CREATE TABLE t(n INTEGER, s TEXT)")
    db.execute("INSERT INTO t VALUES (1, 'a'), (2, 'b')")
    db.execute("CREATE VIEW v(ten) AS SELECT n * 10 FROM t")
    with pytest.raises(DialectError, match="INSTEAD OF INSERT"):
        db.execute("INSERT INTO v VALUES (30)")
    with pytest.raises(DialectError, match="for views"):
        db.execute("CREATE TRIGGER x INSTEAD OF DELETE ON t BEGIN DELETE FROM t; END")
    db.execute("CREATE TRIGGER i INSTEAD OF INSERT ON v BEGIN INSERT INTO t VALUES (NEW.ten / 10, 'via'); END")
    db.execute("CREATE TRIGGER u INSTEAD OF UPDATE ON v BEGIN UPDATE t SET s = s || NEW.ten WHERE n = OLD.ten / 10; END")
    db.execute("CREATE TRIGGER d INSTEAD OF DELETE ON v BEGIN DELETE FROM t WHERE n = OLD.ten / 10; END")
    assert db.execute("INSERT INTO v VALUES (30), (40)").count == 2
    db.execute("UPDATE v SET ten = ten + 1 WHERE ten = 20")
    db.execute("DELETE FROM v WHERE ten < 20")
    assert taken(db, "SELECT * FROM t") == [(2, "b21"), (3, "via"), (4, "via")]


def test_session_functions_and_row_ids(db):
    db.execute("CREATE TABLE t(id INTEGER PRIMARY KEY AUTOINCREMENT, s TEXT)")
    db.execute("INSERT INTO t(s) VALUES ('x'), ('y'), ('z')")
    assert taken(db, "SELECT CHANGES() + 0, LAST_INSERT_ROWID(), TOTAL_CHANGES()") == [(3, 3, 3)]
    db.execute("INSERT INTO t(s) SELECT s || s FROM t")
    assert taken(db, "SELECT id FROM t") == [(i,) for i in range(1, 7)]
    assert taken(db, "SELECT * FROM sqlite_sequence") == [("t", 6)]


def test_failed_statement_in_a_transaction_is_undone_alone(db):
    db.execute("CREATE TABLE t(a INTEGER, b INTEGER NOT NULL, PRIMARY KEY (a, b DESC)) WITHOUT ROWID")
    with db.transaction():
        db.execute("INSERT INTO t VALUES (1, 1)")
        with pytest.raises(DialectError):
            db.execute("INSERT OR REPLACE INTO t VALUES (1, 1), (2, NULL)")
    assert taken(db, "SELECT * FROM t") == [(1, 1)]


def test_settings_and_columnstore(db):
    assert taken(db, "PRAGMA user_version") == [(0,)]
    db.execute("PRAGMA user_version = 7")
    db.execute("PRAGMA foreign_keys = off")
    assert taken(db, "PRAGMA user_version") + taken(db, "PRAGMA foreign_keys") == [(7,), (0,)]
    with pytest.raises(DialectError):
        db.execute("PRAGMA recursive_triggers = maybe")
    db.execute("CREATE TABLE c(a INTEGER) USING COLUMNSTORE")
    for sql in ("CREATE INDEX i ON c(a)", "ALTER TABLE c ADD COLUMN b TEXT", "CREATE TABLE d(a INTEGER, b INTEGER AS (a + 1)) USING COLUMNSTORE"):
        with pytest.raises(DialectError, match="columnstore"):
            db.execute(sql)


def test_concatenation_beside_distinct_aggregates(db):
    db.execute("CREATE TABLE t(n INTEGER, s TEXT)")
    db.execute("INSERT INTO t VALUES (1, 'b'), (1, 'a'), (2, 'a'), (3, NULL)")
    sql = "SELECT GROUP_CONCAT(s, '-'), GROUP_CONCAT(DISTINCT s), COUNT(DISTINCT s), SUM(DISTINCT n) FROM t"
    assert taken(db, sql) == [("a-a-b", "a,b", 2, 6)]
    assert taken(db, sql + " WHERE n > 2") == [(None, None, 0, 3)]


def test_keys_with_nulls_are_kept_apart(db):
    db.execute("CREATE TABLE t(a INTEGER, b TEXT UNIQUE)")
    db.execute("INSERT OR IGNORE INTO t VALUES (1, NULL), (2, NULL), (3, 'x'), (4, 'x')")
    db.execute("INSERT OR REPLACE INTO t VALUES (5, NULL), (6, 'x')")
    assert sorted(a for (a,) in taken(db, "SELECT a FROM t")) == [1, 2, 5, 6]


def brute_insert(rows, how, first=()):
    """(a, b, v) rows by the row-at-a-time rules; a and b are unique, null like no other."""
    held = list(first)
    for row in rows:
        met = [x for x in held if any(x[k] is not None and x[k] == row[k] for k in (0, 1))]
        if how == "IGNORE" and met:
            continue
        held = [x for x in held if x not in met] + [row]
    return sorted(held, key=str)


def test_ignore_and_replace_go_row_by_row(spark):
    """Repeated keys over several partitions, one key and two."""
    import random

    r = random.Random(8)
    rows = [(r.choice([None, *range(25)]), r.choice([None, *range(30)]), i) for i in range(300)]
    first = [(1, 2, -1), (None, 3, -2), (4, None, -3)]
    src = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i long, a long, b long, v long").repartitionByRange(6, "i").sortWithinPartitions("i")
    for how in ("IGNORE", "REPLACE"):
        db = Engine(spark)
        db.register("src", src)
        db.execute("CREATE TABLE t (a INTEGER UNIQUE, b INTEGER, v INTEGER)")
        db.execute("CREATE UNIQUE INDEX ub ON t (b)")
        db.execute("INSERT INTO t VALUES (1, 2, -1), (NULL, 3, -2), (4, NULL, -3)")
        db.execute(f"INSERT OR {how} INTO t SELECT a, b, v FROM src")
        assert sorted((tuple(x) for x in db.query("SELECT a, b, v FROM t").collect()), key=str) == brute_insert(rows, how, first)
        db = Engine(spark)
        db.register("src", src)
        db.execute("CREATE TABLE t (a INTEGER PRIMARY KEY, v INTEGER)")
        db.execute(f"INSERT OR {how} INTO t SELECT a, v FROM src WHERE a IS NOT NULL")
        want = {}
        for a, _, v in rows:
            if a is not None and (how == "REPLACE" or a not in want):
                want[a] = v
        assert {x.a: x.v for x in db.query("SELECT a, v FROM t").collect()} == want


def test_upsert_on_a_unique_index_folds_in_order(spark, monkeypatch):
    from marlwick import engine

    monkeypatch.setattr(engine, "TRIGGER_FOLD", 2)
    db = Engine(spark)
    db.execute("CREATE TABLE u (id INTEGER PRIMARY KEY, k TEXT, v TEXT)")
    with pytest.raises(DialectError):
        db.execute("INSERT INTO u VALUES (1, 'a', 'b') ON CONFLICT(k) DO UPDATE SET v = excluded.v")
    db.execute("CREATE UNIQUE INDEX u_k ON u (k)")
    db.execute("INSERT INTO u VALUES (1, 'key', 'a')")
    out = db.execute("INSERT INTO u VALUES (2, 'key', 'b'), (3, 'new', 'c'), (4, 'key', 'd'), (5, 'new', 'e'), (6, 'key', 'f'), (7, 'new', 'g'), (8, NULL, 'h'), (9, NULL, 'i') ON CONFLICT(k) DO UPDATE SET v = v || excluded.v")
    assert sorted(map(tuple, db.query("SELECT * FROM u").collect())) == [(1, "key", "abdf"), (3, "new", "ceg"), (8, None, "h"), (9, None, "i")]
    assert out.count == 4 and {(x["_op"], x["_rowid"]) for x in out.feed.collect()} == {("update", 1), ("insert", 3), ("insert", 8), ("insert", 9)}


def test_replace_reaches_reactive_views(spark):
    db = Engine(spark)
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, g TEXT)")
    db.execute("INSERT INTO t VALUES (1, 'a'), (2, 'a'), (3, 'b')")
    out = db.execute("INSERT OR REPLACE INTO t VALUES (1, 'b'), (4, 'c')")
    assert {(x["_op"], x["_rowid"]) for x in out.feed.collect()} == {("delete", 1), ("insert", 1), ("insert", 4)}


def test_a_change_touches_only_its_parts(spark):
    db = Engine(spark)
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT)")
    for i in range(4):
        db.execute(f"INSERT INTO t VALUES ({i}, 'x')")
    before = list(db.store.state.tables["t"].parts)
    db.execute("UPDATE t SET v = 'y' WHERE id = 2")
    db.execute("DELETE FROM t WHERE id = 0")
    after = db.store.state.tables["t"].parts
    assert set(before) & set(after) == {before[1], before[3]}
    assert sorted(map(tuple, db.query("SELECT * FROM t").collect())) == [(1, "x"), (2, "y"), (3, "x")]


def test_an_insert_does_not_shuffle_the_table(spark):
    db = Engine(spark)
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT UNIQUE)")
    spark.range(5000).selectExpr("id", "'v' || id AS v").createOrReplaceTempView("_src5000")
    db.register("src", spark.table("_src5000"))
    db.execute("INSERT INTO t SELECT id, v FROM src")
    t, rest = db.store.state.tables["t"], db.store.rows("t")
    new = db._fixed(spark.createDataFrame([(9000, 9000, "v9000")], "_rowid long, id long, v string"))
    for value, _ in db._uniques(t):
        keys = new.alias("t").select(value.alias("_k"))
        plan = rest.alias("t").select(value.alias("_k")).join(keys, "_k", "left_semi")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert not db.violations("t", new, rest)
    with pytest.raises(DialectError):
        db.execute("INSERT INTO t VALUES (9001, 'v17')")


def test_a_killed_commit_leaves_the_last_version(spark, tmp_path):
    db = Engine(spark, str(tmp_path))
    db.execute("CREATE TABLE t (a INTEGER)")
    db.execute("INSERT INTO t VALUES (1)")
    (tmp_path / "_commits" / "_killed").write_text("")  # what a writer leaves that was killed before its rename
    again = Engine(spark, str(tmp_path))
    assert again.query("SELECT a FROM t").collect() == [(1,)]
    again.execute("INSERT INTO t VALUES (2)")
    with pytest.raises(Exception):  # noqa: B017
        db.execute("INSERT INTO t VALUES (3)")  # another writer was first
    assert sorted(x.a for x in Engine(spark, str(tmp_path)).query("SELECT a FROM t").collect()) == [1, 2]
    assert again.query_as_of("SELECT COUNT(*) AS n FROM t", txn=2).first().n == 1
    again.execute("VACUUM")
    assert not (tmp_path / "_staged").exists() and again.query("SELECT COUNT(*) AS n FROM t").first().n == 2


def test_attached_databases_are_apart(spark, tmp_path):
    db = Engine(spark)
    db.execute("CREATE TABLE t (n INTEGER)")
    db.execute("INSERT INTO t VALUES (1), (2), (3)")
    db.execute(f"ATTACH DATABASE '{tmp_path}' AS aux")
    assert db.query("PRAGMA active_database").first()[0] == "main"
    db.execute("PRAGMA active_database = 'aux'")
    assert db.query("PRAGMA active_database").first()[0] == "aux" and db.query("PRAGMA database_list").count() == 2
    db.execute("CREATE TABLE t (n INTEGER)")
    db.execute("INSERT INTO t VALUES (10)")
    assert [x.n for x in db.query("SELECT n FROM t").collect()] == [10]
    db.execute("PRAGMA active_database = main")
    assert db.query("SELECT COUNT(*) AS c FROM t").first().c == 3
    db.execute("PRAGMA active_database = aux")
    db.execute("DETACH DATABASE aux")
    assert db.query("PRAGMA active_database").first()[0] == "main" and db.query("SELECT COUNT(*) AS c FROM t").first().c == 3
    for sql in ("DETACH DATABASE main", "DETACH DATABASE aux", "PRAGMA active_database = nope"):
        with pytest.raises(DialectError):
            db.execute(sql)
    assert Engine(spark, str(tmp_path)).query("SELECT n FROM t").first().n == 10


@pytest.mark.parametrize(("text", "wanted", "n", "out"), [
    ("foo food foobar football", ("foo", True), 8, "[foo] [food] [foobar] [football]"),
    ("foo a b c d e f", ("foo", False), 3, "[foo] a b..."),
    ("a b c d e foo", ("foo", False), 3, "...d e [foo]"),
    ("aaa bbb ccc foo a b c d e f g h i j foo bar foo baz qux", ("foo", False), 4, "aaa bbb ccc [foo]..."),
    ("w1 w2 w3 w4 w5 w6 w7 w8 w9 wa wb wc wd we wf foo bar foo baz qux", ("foo", False), 5, "...wf [foo] bar [foo] baz..."),
    ("learn programming here today", ("ocaml", False), 3, "learn programming here..."),
    ("", ("x", False), 3, ""),
])
def test_snippets(text, wanted, n, out):
    assert fts.snippet_of(text, (wanted,), "[", "]", "...", n) == out


def test_an_index_finds_what_a_scan_finds(db):
    db.execute("CREATE VIRTUAL TABLE f USING fts5(title, body)")
    db.execute("INSERT INTO f VALUES ('One', 'a b a b c'), ('Two', 'b a. B A!'), ('ΑΣ', 'ﬁne straße'), (NULL, ''), ('Six', 'ab abc')")
    db.execute("INSERT INTO f VALUES ('One', 'a b a b c')")
    for q in ('a', '"a b"', '"a b a"', 'ab* -abc', 'FINE OR strasse', 'ας', 'a -c OR six', '-a', 'none'):
        found = {(r.title, round(r.rank, 9)) for r in db.query(f"SELECT title, rank FROM f WHERE f MATCH '{q}'").collect()}
        scan = fts.search(db.store.rows("f"), ["title", "body"], q, ["title"])
        assert found == {(r.title, round(r["rank"], 9)) for r in scan.collect()}, q


def test_dump_makes_the_database_again(spark, tmp_path):
    from marlwick.__main__ import Shell

    db = Engine(spark, str(tmp_path / "a"))
    for sql in (
        "CREATE TABLE c (id INTEGER PRIMARY KEY AUTOINCREMENT, pid INTEGER REFERENCES p (id) ON DELETE CASCADE, twice INTEGER GENERATED ALWAYS AS (pid * 2))",
        "CREATE TABLE p (id INTEGER PRIMARY KEY, name TEXT CHECK (LENGTH(name) < 9), UNIQUE (name))",
        "INSERT INTO p VALUES (1, 'it''s'), (2, NULL)", "INSERT INTO c (pid) VALUES (2), (1)",
        "CREATE UNIQUE INDEX low ON p (LOWER(name)) WHERE id > 0", "CREATE VIEW v AS SELECT id FROM c",
        "CREATE TRIGGER g AFTER INSERT ON p WHEN new.id > 5 BEGIN DELETE FROM c; END",
    ):
        db.execute(sql)
    lines = list(db.dump())
    shell = Shell(spark, str(tmp_path / "b"))
    assert list(shell.answers(f"{x}\n" for x in lines)) == []
    assert list(shell.db.dump()) == lines
    assert list(shell.answers([".tables\n", "SELECT id, pid,\n", "twice FROM c ORDER BY id;\n", "nonsense;\n"]))[:6] == ["c", "p", "v", "id|pid|twice", "1|2|4", "2|1|2"]


def test_prepared_slots(db):
    made = db.prepare("SELECT :low + ? AS a, :seg AS b")
    assert made.param_slot("seg") == 2 and made.param_slot(":low") == 0 and made.param_slot("x") is None
    assert made.params_of_named({"seg": 1, "x": 2}) == {"low": None, "seg": 1}
