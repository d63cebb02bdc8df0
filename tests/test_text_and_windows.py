"""Full-text steps whose cost must stay in proportion to the text, and searches against SQL on odd texts."""

from __future__ import annotations

import re
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from marlwick.engine import Engine
from marlwick.operators import fts
from marlwick.plans.catalogue import ORACLE_SQL, QUERIES

TEXTS = ["A thing, a Thing: THING", "", "Worthless trash\nthing", "worthless thing", "Straße ﬁn ΣΑΣ ς trash", "licensed under; licensed, under thing", "... --", "under licensed"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_fold_matches_each_text_once(spark):
    assert str(fts.folded(F.col("text"))).count("rlike(") == 2  # one for all texts, one for those it finds
    with_ranges = fts.ranges("".join(map("".join, fts.folds())).replace("ß", ""), 64)
    assert with_ranges.count("-") <= 12
    chars = [c for c in map(chr, range(1, 0x1E000)) if c.lower() != c or c.casefold() != c]
    mine = spark.createDataFrame([(f"a{c}b",) for c in chars], "text string").select("text", fts.folded(F.col("text")).alias("low"))
    later = {r.text for r in mine.collect() if r.low != r.text.casefold()}  # than the JVM's Unicode, or in Python's lower() by context
    assert not [t for t in later if ord(t[1]) < 0x1C89 and not 0x10D0 <= ord(t[1]) < 0x1100 and t[1] != "İ"], later


def test_index_shuffles_nothing(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k long, text string").repartition(2)
    made = fts.index(df, "k", ["text"])
    assert "Exchange hashpartitioning" not in plan(made) and "Exchange rangepartitioning" not in plan(made)
    want = defaultdict(list)
    for k, text in enumerate(TEXTS):
        for i, w in enumerate(fts.words(text)):
            want[(w, k, len(fts.words(text)))].append(i)
        if not fts.words(text):
            want[(None, k, 0)] = []
    assert {(r.term, r.k, r.len): list(r.places) for r in made.collect()} == want


def test_delete_from_a_full_text_table_is_that_of_its_sql(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("k7_fts_delete", "k5_bm25_index", "k5_bm25", "k3_phrase"):
        found = sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()))
        assert found == sorted(con.sql(ORACLE_SQL[name]).fetchall()) and found, name


def test_frames_to_the_last_row(spark, tmp_path):
    db, con = Engine(spark, str(tmp_path / "db")), duckdb.connect()
    rows = [(i, i % 3, None if i % 4 == 0 else (i * 7) % 11, (i * 5) % 13 / 2) for i in range(40)]
    db.register("t", spark.createDataFrame(rows, "k long, g long, x long, r double"))
    con.execute("CREATE TABLE t (k BIGINT, g BIGINT, x BIGINT, r DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", rows)
    for call in ("COUNT(*)", "COUNT(x)", "SUM(x)", "MIN(r)", "MAX(x)", "AVG(r)"):
        for low in ("CURRENT ROW", "1 FOLLOWING", "3 FOLLOWING", "2 PRECEDING", "0 PRECEDING", "50 PRECEDING", "50 FOLLOWING"):
            for keys in ("k", "k DESC", "x NULLS LAST, k", "x DESC NULLS FIRST, r, k"):
                sql = f"SELECT k, {call} OVER (PARTITION BY g ORDER BY {keys} ROWS BETWEEN {low} AND UNBOUNDED FOLLOWING) AS v FROM t"
                if keys != "k" and low not in ("CURRENT ROW", "3 FOLLOWING"):
                    continue
                df = db.query(sql)
                assert not re.search(r"-?\d+, unboundedfollowing|currentrow\$\(\), unboundedfollowing", plan(df)), sql
                norm = lambda found: sorted((k, None if v is None else round(float(v), 9)) for k, v in found)
                assert norm(map(tuple, df.collect())) == norm(con.sql(sql).fetchall()), sql


def test_pairs_of_one_key_are_dealt_to_many_tasks(spark, tmp_path):
    db = Engine(spark, str(tmp_path / "db"))
    rows = [(i, 7 if i < 300 else None, i % 5) for i in range(320)]
    db.register("t", spark.createDataFrame(rows, "k long, g long, x long"))
    df = db.query("SELECT a.k AS a, b.k AS b FROM t AS a JOIN t AS b ON a.g = b.g AND a.x < b.x")
    assert "_deal" in plan(df) and "Broadcast" not in plan(df)
    found = sorted(map(tuple, df.collect()))
    assert found == sorted((i, j) for i in range(300) for j in range(300) if i % 5 < j % 5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which makes one task of so few rows
    assert db.query("SELECT a.k AS a, b.k AS b FROM t AS a JOIN t AS b ON a.g = b.g AND a.x < b.x").select(F.spark_partition_id()).distinct().count() > 1
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert db.query("SELECT * FROM t AS a JOIN t AS b ON a.g = b.g AND a.x < b.x").columns == ["k", "g", "x", "k_1", "g_1", "x_1"]
    assert "_deal" not in plan(db.query("SELECT a.k FROM t AS a JOIN t AS b ON a.k = b.k"))
