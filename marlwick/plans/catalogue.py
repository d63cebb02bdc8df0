"""One query per row of the operator inventory, each with SQL that DuckDB runs on the same tables.

Most are dialect text, run by the engine. Where the dialect's text means the same in
DuckDB it is its own oracle; otherwise the second text spells out the difference.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine, open_tables
from ..operators import fts, ordering, recursive
from ..sources.tables import table
from ..streaming import ivm

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
_engines: dict[tuple, Engine] = {}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    key = (id(spark), sf_dir)
    if key not in _engines:
        _engines[key] = open_tables(spark, sf_dir)
    return _engines[key]


def dialect(name: str, sql: str, oracle: str | None = None, **params) -> None:
    QUERIES[name] = lambda spark, sf_dir: engine(spark, sf_dir).query(sql, **params)
    ORACLE_SQL[name] = oracle or sql


def frame(name: str, oracle: str | None = None):
    def wrap(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return wrap


# ---- A: scans and sinks ------------------------------------------------------------------------
dialect("a1_seq_scan", "SELECT x.c_custkey, x.c_name, x.c_mktsegment FROM customer AS x")
dialect("a2_columnar_scan", "SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem")
dialect("a3_index_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey BETWEEN 100 AND 200")
dialect("a4_range", "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_quantity >= 45 AND l_quantity < 48 AND l_discount > 0.05")
dialect("a5_key_lookup", "SELECT * FROM part WHERE p_partkey = 77")
dialect("a6_cte_scan", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000) SELECT o_custkey, COUNT(*) AS n FROM big GROUP BY o_custkey")
dialect("a7_const_select", "SELECT 1 AS a, 'x' AS b, 2.5 AS c, NULL AS d", "SELECT 1 AS a, 'x' AS b, 2.5::DOUBLE AS c, NULL::VARCHAR AS d")


@frame("a8_literal_rows", "SELECT * FROM (VALUES (1, 'a'), (2, NULL), (3, 'c')) AS v(k, s)")
def a8(spark, sf_dir):
    return spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k bigint, s string")


dialect("a9_catalog", "SELECT name, type FROM sqlite_master WHERE name IN ('nation', 'region', 'orders')", "SELECT table_name AS name, 'table' AS type FROM (VALUES ('nation'), ('region'), ('orders')) AS t(table_name)")


@frame("a10_fts_scan", "SELECT lang, text FROM documents")
def a10(spark, sf_dir):
    db = Engine(spark)
    db.register("src", lambda: table(spark, sf_dir, "documents"))
    db.execute("CREATE VIRTUAL TABLE f USING fts5(lang, text)")
    db.execute("INSERT INTO f SELECT lang, text FROM src")
    return db.query("SELECT lang, text FROM f")


@frame("a12_dump", "SELECT 'INSERT INTO \"region\" VALUES (' || r_regionkey || ', ''' || r_name || ''');' AS line FROM region")
def a12(spark, sf_dir):
    db = Engine(spark)
    db.register("src", lambda: table(spark, sf_dir, "region"))
    db.execute("CREATE TABLE region (r_regionkey INTEGER PRIMARY KEY, r_name TEXT)")
    db.execute("INSERT INTO region SELECT r_regionkey, r_name FROM src")
    return spark.createDataFrame([(line,) for line in db.dump(data_only=True)], "line string")


@frame("a11_pull_sink", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def a11(spark, sf_dir):
    return spark.createDataFrame(list(engine(spark, sf_dir).rows("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")), "n_nationkey long, n_name string")


# ---- B: projection, filters, expressions -------------------------------------------------------
dialect("b1_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
dialect("b2_projection", "SELECT n_name, n_regionkey FROM nation")
dialect("b3_expressions", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
dialect("b4_star", "SELECT * FROM supplier")
dialect("b5_comparisons", "SELECT p_partkey, p_size = 10 AS e, p_size <> 10 AS ne, p_size < 10 AS l, p_size >= p_partkey AS g, p_retailprice > 1000 AS r FROM part",
        "SELECT p_partkey, (p_size = 10)::BIGINT AS e, (p_size <> 10)::BIGINT AS ne, (p_size < 10)::BIGINT AS l, (p_size >= p_partkey)::BIGINT AS g, (p_retailprice > 1000)::BIGINT AS r FROM part")
dialect("b6_logic", "SELECT p_partkey FROM part WHERE NOT (p_size > 20 OR p_brand = 'Brand#13') AND (p_type = 'PROMO' OR p_type = 'SMALL')")
dialect("b6_kleene", "SELECT d.doc_id, l.quality AND 1 AS a, l.quality OR 0 AS o FROM documents AS d LEFT JOIN labels AS l ON d.doc_id = l.doc_id",
        "SELECT d.doc_id, CAST(l.quality <> 0 AND true AS BIGINT) AS a, CAST(l.quality <> 0 OR false AS BIGINT) AS o FROM documents AS d LEFT JOIN labels AS l ON d.doc_id = l.doc_id")
dialect("b7_is_null", "SELECT d.doc_id, l.toxic IS NULL AS missing FROM documents AS d LEFT JOIN labels AS l ON d.doc_id = l.doc_id WHERE d.lang IS NOT NULL",
        "SELECT d.doc_id, (l.toxic IS NULL)::BIGINT AS missing FROM documents AS d LEFT JOIN labels AS l ON d.doc_id = l.doc_id WHERE d.lang IS NOT NULL")
dialect("b8_between", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_discount NOT BETWEEN 0.02 AND 0.09")
dialect("b9_in_list", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)")
dialect("b9_in_null", "SELECT l.doc_id, l.quality IN (NULL, 1) AS x FROM labels AS l", "SELECT l.doc_id, CASE WHEN l.quality = 1 THEN 1 END AS x FROM labels AS l")
dialect("b10_like", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'pr%' OR p_brand LIKE 'BRAND#_3'", "SELECT p_partkey, p_type FROM part WHERE p_type ILIKE 'pr%' OR p_brand ILIKE 'BRAND#_3'")
dialect("b11_glob", "SELECT p_partkey FROM part WHERE p_brand GLOB 'Brand#?3' AND p_type NOT GLOB 'S*'", "SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand#_3' AND p_type NOT LIKE 'S%'")
dialect("b12_case", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code FROM orders")
dialect("b13_cast", "SELECT DISTINCT CAST(p_brand AS INTEGER) AS zero, CAST(substr(p_brand, 7) AS INTEGER) AS num, CAST(substr(p_brand, 7) || '.5x' AS REAL) AS r, CAST(2.9 AS INTEGER) AS t, CAST(p_size AS TEXT) AS s FROM part",
        "SELECT DISTINCT 0 AS zero, CAST(substr(p_brand, 7) AS BIGINT) AS num, CAST(substr(p_brand, 7) AS DOUBLE) + 0.5 AS r, 2 AS t, CAST(p_size AS VARCHAR) AS s FROM part")
dialect("b14_nullif_iif", "SELECT n_nationkey, NULLIF(n_regionkey, 2) AS nr, IIF(n_nationkey % 2 = 0, 'even', 'odd') AS p FROM nation", "SELECT n_nationkey, NULLIF(n_regionkey, 2) AS nr, CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS p FROM nation")
dialect("b15_collate", "SELECT c_custkey FROM customer WHERE c_mktsegment COLLATE NOCASE = 'building'", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'")
dialect("b16_parameters", "SELECT o_orderkey FROM orders WHERE o_custkey = :cust AND o_totalprice > @least", "SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_totalprice > 1000", cust=7, least=1000.0)
dialect("b17_scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.8 FROM orders)")
dialect("b18_exists", "SELECT c_custkey FROM customer AS c WHERE EXISTS (SELECT 1 FROM orders AS o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)")
dialect("b18_not_exists", "SELECT doc_id FROM documents AS d WHERE NOT EXISTS (SELECT 1 FROM labels AS l WHERE l.doc_id = d.doc_id)")
dialect("b19_in_select", "SELECT c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 350000)")
dialect("b19_not_in_select", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
dialect("b20_correlated", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem AS l WHERE l_quantity > (SELECT 1.7 * AVG(i.l_quantity) FROM lineitem AS i WHERE i.l_partkey = l.l_partkey)")
dialect("b20_correlated_projection", "SELECT c_custkey, (SELECT COUNT(*) FROM orders AS o WHERE o.o_custkey = c.c_custkey) AS n FROM customer AS c")
dialect("b20_two_levels", "SELECT r_name FROM region AS r WHERE EXISTS (SELECT 1 FROM nation AS n WHERE n.n_regionkey = r.r_regionkey AND EXISTS (SELECT 1 FROM supplier AS s WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000))")
dialect("b21_arithmetic", "SELECT p_partkey, p_partkey / 7 AS d, -p_partkey / 7 AS nd, p_partkey % 7 AS m, p_size % 0 AS z, p_partkey * 2 - 1 AS x, p_retailprice / 4 AS q FROM part",
        "SELECT p_partkey, p_partkey // 7 AS d, CAST(trunc(-p_partkey / 7.0) AS BIGINT) AS nd, p_partkey % 7 AS m, NULL::BIGINT AS z, p_partkey * 2 - 1 AS x, p_retailprice / 4 AS q FROM part")
dialect("b22_unary", "SELECT n_nationkey, -n_nationkey AS neg, ~n_nationkey AS inv FROM nation")
dialect("b23_bits", "SELECT p_partkey, p_partkey & 12 AS a, p_partkey | 5 AS o, p_size << 3 AS l, p_partkey >> 2 AS r, p_size << 70 AS z FROM part", "SELECT p_partkey, p_partkey & 12 AS a, p_partkey | 5 AS o, p_size * 8 AS l, p_partkey >> 2 AS r, 0 AS z FROM part")
dialect("b24_concat", "SELECT n_name || '-' || n_regionkey AS tag, n_name || NULL AS nothing FROM nation", "SELECT n_name || '-' || n_regionkey AS tag, NULL::VARCHAR AS nothing FROM nation")
dialect("b25_truth", "SELECT r_name, TRUE AS t, FALSE AS f FROM region WHERE TRUE", "SELECT r_name, 1 AS t, 0 AS f FROM region")

# ---- C: joins ----------------------------------------------------------------------------------
dialect("c1_inner_join", "SELECT o.o_orderkey, c.c_name FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING'")
dialect("c2_left_join", "SELECT d.doc_id, d.lang, l.quality FROM documents AS d LEFT JOIN labels AS l ON d.doc_id = l.doc_id AND l.toxic = 0")
dialect("c3_cross_join", "SELECT r.r_name, n.n_name FROM region AS r CROSS JOIN nation AS n")
dialect("c3_comma_join", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name <> 'ASIA'")
dialect("c4_hash_join", "SELECT l.l_orderkey, l.l_linenumber, p.p_brand FROM lineitem AS l JOIN part AS p ON l.l_partkey = p.p_partkey WHERE p.p_size = 15")
dialect("c4_mixed_keys", "SELECT n.n_name, COUNT(*) AS n FROM lineitem AS l JOIN nation AS n ON l.l_quantity = n.n_nationkey GROUP BY n.n_name")
dialect("c5_theta_join", "SELECT a.n_name AS x, b.n_name AS y FROM nation AS a JOIN nation AS b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey")
dialect("c5_left_theta", "SELECT r.r_name, n.n_name FROM region AS r LEFT JOIN nation AS n ON n.n_nationkey > r.r_regionkey * 6")
dialect("c6_lookup_join", "SELECT o.o_orderkey, o.o_totalprice, c.c_name FROM customer AS c JOIN orders AS o ON o.o_custkey = c.c_custkey WHERE c.c_custkey = 42")
dialect("c7_where_key", "SELECT s_name, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey AND s_acctbal > 0")
dialect("c8_self_join", "SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer AS a JOIN customer AS b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey")
dialect("c9_multi_join", "SELECT r.r_name, COUNT(*) AS n, round(SUM(o.o_totalprice), 2) AS total FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey JOIN nation AS n ON c.c_nationkey = n.n_nationkey JOIN region AS r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name")
dialect("c10_semi", "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.1)")


@frame("c11_mixed_storage_join", "SELECT d.lang, COUNT(*) AS n FROM documents AS d JOIN labels AS l ON l.doc_id = d.doc_id GROUP BY d.lang")
def c11(spark, sf_dir):
    db = Engine(spark)
    for name in ("documents", "labels"):
        db.register(f"src_{name}", lambda name=name: table(spark, sf_dir, name))
    db.execute("CREATE TABLE d (doc_id INTEGER PRIMARY KEY, lang TEXT)")
    db.execute("CREATE TABLE l (doc_id INTEGER) USING COLUMNSTORE")
    db.execute("INSERT INTO d SELECT doc_id, lang FROM src_documents")
    db.execute("INSERT INTO l SELECT doc_id FROM src_labels")
    return db.query("SELECT d.lang, COUNT(*) AS n FROM d JOIN l ON l.doc_id = d.doc_id GROUP BY d.lang")


@frame("c12_incremental_join", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def c12(spark, sf_dir):
    """The join of half the rows, plus the change that the other half brings."""
    left = ivm.weighted(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("k")))
    right = ivm.weighted(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), "r_name"))
    l0, l1, r0, r1 = left.where("n_nationkey < 12"), left.where("n_nationkey >= 12"), right.where("k < 3"), right.where("k >= 3")
    none = lambda z: z.where("false")
    first = ivm.step_join(none(left), none(right), l0, r0, ["k"])
    return ivm.add(first, ivm.step_join(l0, r0, l1, r1, ["k"])).select("n_nationkey", "n_name", "r_name")


# ---- D: aggregates -----------------------------------------------------------------------------
dialect("d1_aggregate", "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS qty, COUNT(*) AS n, round(AVG(l_extendedprice), 4) AS price FROM lineitem GROUP BY l_returnflag, l_linestatus")
dialect("d2_group_columns", "SELECT o.o_custkey, o.o_orderstatus, COUNT(*) AS n FROM orders AS o GROUP BY o.o_custkey, o.o_orderstatus")
dialect("d4_count", "SELECT COUNT(*) AS rows_, COUNT(l.quality) AS labelled FROM documents AS d LEFT JOIN labels AS l ON d.doc_id = l.doc_id")
dialect("d5_sum", "SELECT SUM(p_size) AS s, SUM(NULLIF(p_size, p_size)) AS nothing FROM part", "SELECT CAST(SUM(p_size) AS BIGINT) AS s, NULL::BIGINT AS nothing FROM part")
dialect("d6_avg", "SELECT p_brand, round(AVG(p_size), 6) AS a FROM part GROUP BY p_brand")
dialect("d7_min_max", "SELECT c_mktsegment, MIN(c_acctbal) AS lo, MAX(c_acctbal) AS hi, MIN(c_name) AS first_, MAX(c_custkey) AS last_ FROM customer GROUP BY c_mktsegment")
dialect("d8_group_concat", "SELECT n_regionkey, GROUP_CONCAT(n_name, '|') AS names, STRING_AGG(n_name, ',') AS s FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names, string_agg(n_name, ',' ORDER BY n_name) AS s FROM nation GROUP BY n_regionkey")
dialect("d9_distinct_aggregates", "SELECT o_orderpriority, COUNT(DISTINCT o_custkey) AS c, SUM(DISTINCT o_custkey) AS s, MIN(DISTINCT o_orderstatus) AS m FROM orders GROUP BY o_orderpriority",
        "SELECT o_orderpriority, COUNT(DISTINCT o_custkey) AS c, CAST(SUM(DISTINCT o_custkey) AS BIGINT) AS s, MIN(o_orderstatus) AS m FROM orders GROUP BY o_orderpriority")
dialect("d9_distinct_concat", "SELECT c_nationkey, GROUP_CONCAT(DISTINCT c_mktsegment) AS segs FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segs FROM customer GROUP BY c_nationkey")
dialect("d10_expression_argument", "SELECT l_returnflag, round(SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge, SUM(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS big FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, round(SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge, CAST(SUM(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT) AS big FROM lineitem GROUP BY l_returnflag")
dialect("d11_post_aggregate", "SELECT l_linestatus, round(SUM(l_extendedprice) / SUM(l_quantity), 6) AS unit, COUNT(*) * 2 AS twice FROM lineitem GROUP BY l_linestatus")
dialect("d12_having", "SELECT l_orderkey, SUM(l_quantity) AS q FROM lineitem GROUP BY l_orderkey HAVING SUM(l_quantity) > 300")
dialect("d13_single_group", "SELECT COUNT(*) AS n, MAX(o_totalprice) AS m FROM orders WHERE o_orderkey < 0")
dialect("d15_window_over_aggregate", "SELECT c_nationkey, COUNT(*) AS n, RANK() OVER (ORDER BY COUNT(*) DESC) AS r FROM customer GROUP BY c_nationkey")
dialect("d16_scan_aggregate", "SELECT COUNT(*) AS n, MIN(o_orderkey) AS lo, MAX(o_orderkey) AS hi FROM orders")


@frame("d17_incremental_aggregate", "SELECT event_type, COUNT(*) AS n, CAST(SUM(user_id) AS BIGINT) AS s FROM events WHERE event_id % 5 <> 0 GROUP BY event_type")
def d17(spark, sf_dir):
    """All events come, then every fifth leaves again."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    state = spark.createDataFrame([], "event_type string, _n long, _s long, _m long")
    state = ivm.step_aggregate(state, ivm.weighted(rows.select("event_type", "user_id")), "event_type", "user_id")
    gone = ivm.weighted(rows.where("event_id % 5 = 0").select("event_type", "user_id"), -1)
    return ivm.step_aggregate(state, gone, "event_type", "user_id").select("event_type", F.col("_n").alias("n"), F.col("_s").alias("s"))


# ---- E: windows --------------------------------------------------------------------------------
_W = "OVER (PARTITION BY o_custkey ORDER BY o_orderkey"
dialect("e1_row_number", f"SELECT o_orderkey, ROW_NUMBER() {_W}) AS r FROM orders")
dialect("e2_ranks", "SELECT c_custkey, RANK() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS r, DENSE_RANK() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment DESC) AS d FROM customer")
dialect("e3_ntile", "SELECT p_partkey, NTILE(7) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS t FROM part")
dialect("e4_lag_lead", f"SELECT o_orderkey, LAG(o_totalprice) {_W}) AS p, LEAD(o_orderkey, 2, -1) {_W}) AS n FROM orders")
dialect("e5_first_last", f"SELECT o_orderkey, FIRST_VALUE(o_totalprice) {_W}) AS f, LAST_VALUE(o_totalprice) {_W}) AS l FROM orders")
dialect("e6_nth_value", f"SELECT o_orderkey, NTH_VALUE(o_orderkey, 3) {_W}) AS v FROM orders")
dialect("e7_percent_rank", "SELECT c_custkey, round(PERCENT_RANK() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal), 9) AS p, round(CUME_DIST() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal), 9) AS c FROM customer")
dialect("e8_aggregates", f"SELECT o_orderkey, COUNT(*) {_W}) AS n, round(SUM(o_totalprice) {_W}), 2) AS s, MAX(o_totalprice) {_W}) AS m, round(AVG(o_totalprice) {_W}), 4) AS a FROM orders")
dialect("e9_partition_expression", "SELECT event_id, COUNT(*) OVER (PARTITION BY user_id % 10, event_type) AS n FROM events")
dialect("e10_rows_frames", "SELECT event_id, SUM(user_id) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS s, COUNT(*) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM events",
        "SELECT event_id, CAST(SUM(user_id) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s, COUNT(*) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM events")
dialect("e12_default_frame", "SELECT event_id, SUM(user_id) OVER (PARTITION BY event_type ORDER BY event_id) AS running, SUM(user_id) OVER (PARTITION BY event_type) AS total FROM events",
        "SELECT event_id, CAST(SUM(user_id) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running, CAST(SUM(user_id) OVER (PARTITION BY event_type) AS BIGINT) AS total FROM events")

dialect("e10_range_frames", "SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s FROM orders",
        "SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s FROM orders")

# ---- F: order, limit, distinct -----------------------------------------------------------------
dialect("f1_sort", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
dialect("f2_order_names", "SELECT c_nationkey AS k, COUNT(*) AS n FROM customer GROUP BY c_nationkey ORDER BY 2 DESC, k LIMIT 5")
dialect("f3_null_order", "SELECT d.doc_id, l.quality FROM documents AS d LEFT JOIN labels AS l ON d.doc_id = l.doc_id ORDER BY l.quality NULLS LAST, d.doc_id")
dialect("f3_null_default", "SELECT d.doc_id, l.quality FROM documents AS d LEFT JOIN labels AS l ON d.doc_id = l.doc_id ORDER BY l.quality, d.doc_id",
        "SELECT d.doc_id, l.quality FROM documents AS d LEFT JOIN labels AS l ON d.doc_id = l.doc_id ORDER BY l.quality NULLS FIRST, d.doc_id")
dialect("f4_limit_offset", "SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 20 OFFSET 15")
dialect("f5_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
dialect("f7_distinct", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")


@frame("f1_nan_order", "SELECT * FROM (VALUES (1, 1), (2, 2), (3, 3), (4, 4)) AS v(place, id)")
def f1_nan(spark, sf_dir):
    """Null, then NaN, then numbers."""
    from pyspark.sql import Window

    rows = spark.createDataFrame([(3, 1.0), (2, float("nan")), (1, None), (4, 2.0)], "id long, x double")
    return rows.select(F.row_number().over(Window.orderBy(*ordering.nan_first("x"))).cast("long").alias("place"), "id")


# ---- G: set operations and CTEs ----------------------------------------------------------------
dialect("g1_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
dialect("g2_union_all", "SELECT n_name AS s FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT r_name FROM region")
dialect("g3_intersect", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW'")
dialect("g4_except", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
dialect("g5_left_associative", "SELECT 1 AS x UNION SELECT r_regionkey FROM region INTERSECT SELECT n_nationkey FROM nation WHERE n_nationkey > 2",
        "SELECT * FROM (SELECT 1 AS x UNION SELECT r_regionkey FROM region) INTERSECT SELECT n_nationkey FROM nation WHERE n_nationkey > 2")
dialect("g6_compound_order", "SELECT n_name AS s FROM nation UNION SELECT r_name FROM region ORDER BY s DESC LIMIT 7")
dialect("g7_cte", "WITH per AS (SELECT o_custkey AS k, SUM(o_totalprice) AS t FROM orders GROUP BY o_custkey) SELECT c.c_name, round(per.t, 2) AS t FROM per JOIN customer AS c ON c.c_custkey = per.k WHERE per.t > 2500000")
dialect("g8_recursive", "WITH RECURSIVE f AS (SELECT 0 AS i, 1 AS v UNION ALL SELECT i + 1, v * 2 FROM f WHERE i < 20) SELECT i, v FROM f", "WITH RECURSIVE f(i, v) AS (SELECT 0::BIGINT, 1::BIGINT UNION ALL SELECT i + 1, v * 2 FROM f WHERE i < 20) SELECT i, v FROM f")


@frame("g8_recursive_union", "WITH RECURSIVE r(k) AS (SELECT 1 UNION SELECT (k * 7 + 3) % 25 FROM r) SELECT k, n_name FROM r JOIN nation ON k = n_nationkey")
def g8_union(spark, sf_dir):
    from ..sources.store import Store

    folder = engine(spark, sf_dir).store.root
    keep = lambda df: _written(df, Store, folder)
    found = recursive.fixpoint(spark.sql("SELECT 1L AS k"), lambda d: d.select(((F.col("k") * 7 + 3) % 25).alias("k")), keep)
    return found.join(table(spark, sf_dir, "nation"), F.col("k") == F.col("n_nationkey")).select("k", "n_name")


def _written(df: DataFrame, _store, folder: str) -> DataFrame:
    import uuid

    path = f"{folder}/_rounds/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


dialect("g8_recursive_deep", "WITH RECURSIVE f AS (SELECT 0 AS i, 0 AS v UNION ALL SELECT i + 1, v + i FROM f WHERE i < 150) SELECT i, v FROM f",
        "WITH RECURSIVE f(i, v) AS (SELECT 0::BIGINT, 0::BIGINT UNION ALL SELECT i + 1, v + i FROM f WHERE i < 150) SELECT i, v FROM f")
dialect("g9_derived", "SELECT t.k, t.n FROM (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey) AS t WHERE t.n > 15")

# ---- H: scalar functions -----------------------------------------------------------------------
dialect("h_string", "SELECT p_partkey, LENGTH(p_name) AS a, LOWER(p_type) AS b, UPPER(p_name) AS c, SUBSTR(p_name, 2, 3) AS d, SUBSTR(p_name, 3) AS e, REPLACE(p_brand, 'Brand', 'B') AS f, INSTR(p_brand, '#') AS g, TRIM('  ' || p_type || ' ') AS h, LTRIM(p_type, 'PS') AS i, RTRIM(p_type, 'ODM') AS j FROM part")
dialect("h_string_types", "SELECT n_nationkey, LENGTH(n_nationkey) AS l, LOWER(n_nationkey) AS w, LENGTH(X'0102') AS b, REPLACE(n_name, '', 'x') AS r FROM nation", "SELECT n_nationkey, NULL::BIGINT AS l, NULL::VARCHAR AS w, 2 AS b, n_name AS r FROM nation")
dialect("h_null", "SELECT d.doc_id, COALESCE(l.quality, l.toxic, -1) AS c, IFNULL(l.toxic, 9) AS i FROM documents AS d LEFT JOIN labels AS l ON d.doc_id = l.doc_id")
dialect("h_typeof", "SELECT d.doc_id, TYPEOF(d.doc_id) AS a, TYPEOF(d.text) AS b, TYPEOF(1.5) AS c, TYPEOF(X'00') AS d, TYPEOF(l.quality) AS e FROM documents AS d LEFT JOIN labels AS l ON d.doc_id = l.doc_id",
        "SELECT d.doc_id, 'integer' AS a, 'text' AS b, 'real' AS c, 'blob' AS d, CASE WHEN l.quality IS NULL THEN 'null' ELSE 'integer' END AS e FROM documents AS d LEFT JOIN labels AS l ON d.doc_id = l.doc_id")
dialect("h_hex_char", "SELECT n_name, HEX(n_name) AS h, HEX(n_nationkey) AS i, HEX(NULL) AS z, CHAR(9731, 65 + n_nationkey) AS c, UNICODE(n_name) AS u, UNICODE('') AS e FROM nation",
        "SELECT n_name, hex(n_name) AS h, hex(CAST(n_nationkey AS VARCHAR)) AS i, '' AS z, chr(9731) || chr(65 + n_nationkey) AS c, unicode(n_name) AS u, NULL::BIGINT AS e FROM nation")
dialect("h_printf", "SELECT n_nationkey, PRINTF('%d:%s:%%:%q', n_nationkey, n_name, 'it''s') AS f FROM nation", "SELECT n_nationkey, n_nationkey || ':' || n_name || ':%:it''''s' AS f FROM nation")
dialect("h_blob", "SELECT ZEROBLOB(3) AS z, LENGTH(RANDOMBLOB(9)) AS n, X'4142' AS b", "SELECT '\\x00\\x00\\x00'::BLOB AS z, 9 AS n, '\\x41\\x42'::BLOB AS b")
dialect("h_round", "SELECT c_custkey, ABS(c_acctbal) AS a, ABS(-c_custkey) AS i, ROUND(c_acctbal) AS r, ROUND(c_acctbal, 1) AS r1, CEIL(c_acctbal) AS c, FLOOR(c_acctbal) AS f, TRUNC(c_acctbal) AS t, SIGN(c_acctbal) AS s FROM customer",
        "SELECT c_custkey, abs(c_acctbal) AS a, c_custkey AS i, round(c_acctbal) AS r, round(c_acctbal, 1) AS r1, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, trunc(c_acctbal) AS t, CAST(sign(c_acctbal) AS BIGINT) AS s FROM customer")
dialect("h_power", "SELECT p_partkey, ROUND(SQRT(p_size), 9) AS a, POW(p_size, 2) AS b, ROUND(EXP(p_size / 10.0), 6) AS c, ROUND(LN(p_size), 9) AS d, ROUND(LOG(p_size), 9) AS e, ROUND(LOG(2, p_size), 9) AS f, ROUND(LOG2(p_size), 9) AS g, ROUND(LOG10(p_size), 9) AS h FROM part",
        "SELECT p_partkey, round(sqrt(p_size), 9) AS a, pow(p_size, 2) AS b, round(exp(p_size / 10.0), 6) AS c, round(ln(p_size), 9) AS d, round(ln(p_size), 9) AS e, round(log2(p_size), 9) AS f, round(log2(p_size), 9) AS g, round(log10(p_size), 9) AS h FROM part")
dialect("h_trigonometry", "SELECT p_size, ROUND(SIN(p_size), 9) AS a, ROUND(COS(p_size), 9) AS b, ROUND(TAN(p_size), 9) AS c, ROUND(ASIN(p_size / 100.0), 9) AS d, ROUND(ACOS(p_size / 100.0), 9) AS e, ROUND(ATAN(p_size), 9) AS f, ROUND(ATAN2(p_size, 3), 9) AS g, ROUND(DEGREES(p_size), 6) AS h, ROUND(RADIANS(p_size), 9) AS i, ROUND(PI(), 9) AS j FROM part")
dialect("h_random", "SELECT COUNT(*) AS n FROM nation WHERE RANDOM() IS NOT NULL", "SELECT COUNT(*) AS n FROM nation")
dialect("h_date", "SELECT o_orderkey, DATE(o_orderdate) AS d, TIME(o_orderdate) AS t, DATETIME(o_orderdate) AS dt, UNIXEPOCH(o_orderdate) AS u, JULIANDAY(o_orderdate) AS j FROM orders",
        "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%H:%M:%S') AS t, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS dt, CAST(epoch(o_orderdate) AS BIGINT) AS u, epoch(o_orderdate) / 86400.0 + 2440587.5 AS j FROM orders")
dialect("h_strftime", "SELECT event_id, STRFTIME('%Y/%m/%d %H-%M %j %s %%', ts) AS s FROM events", "SELECT event_id, strftime(ts, '%Y/%m/%d %H-%M %j ') || CAST(floor(epoch(ts)) AS BIGINT) || ' %' AS s FROM events")
dialect("h_date_text", "SELECT n_nationkey, DATE('2024-02-03 04:05:06') AS a, TIME('04:05') AS b, DATE('nope') AS c, DATE('2024-02-03', '+1 day') AS d, DATETIME('86400') AS e, STRFTIME('%d', '2024-02-09') AS f FROM nation",
        "SELECT n_nationkey, '2024-02-03' AS a, '04:05:00' AS b, NULL::VARCHAR AS c, NULL::VARCHAR AS d, '1970-01-02 00:00:00' AS e, '09' AS f FROM nation")
dialect("h_date_filter", "SELECT COUNT(*) AS n FROM orders WHERE o_orderdate >= '1997-01-01' AND o_orderdate < '1998-01-01'")
dialect("h_json_extract", "SELECT event_id, CAST(JSON_EXTRACT(props, '$.k') AS INTEGER) AS k, JSON_EXTRACT(props, '$.missing') AS m, JSON_TYPE(props) AS t, JSON_TYPE(props, '$.k') AS tk, JSON_VALID(props) AS v FROM events",
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, NULL::VARCHAR AS m, 'object' AS t, 'integer' AS tk, 1 AS v FROM events")
dialect("h_json_make", "SELECT n_nationkey, JSON_OBJECT('k', n_nationkey, 's', n_name, 'z', NULL) AS o, JSON_ARRAY(n_nationkey, n_name, NULL, 1.5) AS a FROM nation",
        "SELECT n_nationkey, '{\"k\":' || n_nationkey || ',\"s\":\"' || n_name || '\",\"z\":null}' AS o, '[' || n_nationkey || ',\"' || n_name || '\",null,1.5]' AS a FROM nation")
dialect("h_json_edit", "SELECT n_nationkey, JSON_SET('{\"a\":1}', '$.b', n_nationkey) AS s, JSON_INSERT('[1,2]', '$[0]', 9) AS i, JSON_REPLACE('{\"a\":1}', '$.a', 'x', '$.q', 2) AS r, JSON_REMOVE('[1,2,3]', '$[1]') AS d, JSON_EXTRACT('[1,2,3]', '$[-1]') AS e, JSON_SET('[1]', '$[1]', 2) AS p FROM nation",
        "SELECT n_nationkey, '{\"a\":1,\"b\":' || n_nationkey || '}' AS s, '[9,1,2]' AS i, '{\"a\":\"x\"}' AS r, '[1,3]' AS d, '3' AS e, '[1,2]' AS p FROM nation")


# ---- I, J, L: data changes, definitions, history, reactive views --------------------------------
def _loaded(spark: SparkSession, sf_dir: str, sql: str) -> Engine:
    """A fresh database with the customers' keys, names, segments and balances."""
    db = Engine(spark)
    db.register("src", lambda: table(spark, sf_dir, "customer"))
    db.execute("CREATE TABLE cust (id INTEGER PRIMARY KEY, name TEXT NOT NULL, seg TEXT, bal REAL DEFAULT 0.0)")
    db.execute(f"INSERT INTO cust {sql}")
    return db


_LOAD = "SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM src"
_CUST = "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS seg, c_acctbal AS bal FROM customer"


@frame("i1_insert_values", "SELECT * FROM (VALUES (1, 'x', 1.5), (2, NULL, 0.5)) AS v(a, b, c)")
def i1(spark, sf_dir):
    db = Engine(spark)
    db.execute("CREATE TABLE t (a INTEGER PRIMARY KEY, b TEXT, c REAL DEFAULT 0.5)")
    db.execute("INSERT INTO t VALUES (?, 'x', 1.5)", 1)
    return db.query("SELECT * FROM t").unionAll(db.execute("INSERT INTO t (b) VALUES (NULL) RETURNING a, b, c").returned)


@frame("i2_insert_select", _CUST)
def i2(spark, sf_dir):
    return _loaded(spark, sf_dir, _LOAD).query("SELECT * FROM cust")


@frame("i3_insert_or", f"SELECT id, CASE WHEN seg = 'BUILDING' THEN 'new' ELSE name END AS name, CASE WHEN seg = 'BUILDING' THEN NULL ELSE seg END AS seg, CASE WHEN seg = 'BUILDING' THEN 0 ELSE bal END AS bal FROM ({_CUST})")
def i3(spark, sf_dir):
    db = _loaded(spark, sf_dir, f"{_LOAD} WHERE c_acctbal >= 0")
    db.execute("INSERT OR REPLACE INTO cust (id, name) SELECT c_custkey, 'new' FROM src WHERE c_mktsegment = 'BUILDING'")
    db.execute(f"INSERT OR IGNORE INTO cust {_LOAD}")
    return db.query("SELECT * FROM cust")


@frame("i4_upsert", f"SELECT id, CASE WHEN bal >= 0 THEN name || '!' ELSE name END AS name, seg, CASE WHEN bal >= 0 THEN 2 * bal ELSE bal END AS bal FROM ({_CUST})")
def i4(spark, sf_dir):
    db = _loaded(spark, sf_dir, f"{_LOAD} WHERE c_acctbal >= 0")
    db.execute(f"INSERT INTO cust {_LOAD} ON CONFLICT(id) DO UPDATE SET name = cust.name || '!', bal = excluded.bal + cust.bal")
    return db.query("SELECT * FROM cust")


_REPEATS = "SELECT c_custkey % 50, 'n' || c_custkey, c_mktsegment, 1.0 * c_custkey FROM src"


def _repeated(spark, sf_dir, sql):
    """A table with every second key from 0 to 48, and rows that meet its 50 keys over and over, in the order of c_custkey."""
    db = Engine(spark)
    # File order is what a statement's row order stands for, so rows are spread over several partitions in that order.
    db.register("src", lambda: table(spark, sf_dir, "customer").repartitionByRange(8, "c_custkey").sortWithinPartitions("c_custkey"))
    db.execute("CREATE TABLE cust (id INTEGER PRIMARY KEY, name TEXT NOT NULL, seg TEXT, bal REAL DEFAULT 0.0)")
    db.execute("INSERT INTO cust SELECT c_custkey, 'old', 'none', 0.0 FROM src WHERE c_custkey < 50 AND c_custkey % 2 = 0")
    db.execute(sql)
    return db.query("SELECT * FROM cust")


_FOLD = "SELECT c_custkey % 50 AS id, {f}(c_custkey) AS c FROM customer GROUP BY 1"
_OLD = "SELECT c_custkey AS id FROM customer WHERE c_custkey < 50 AND c_custkey % 2 = 0"


@frame("i3_ignore_repeats", f"""SELECT id, 'old' AS name, 'none' AS seg, 0.0::DOUBLE AS bal FROM ({_OLD}) UNION ALL
    SELECT f.id, 'n' || c AS name, c_mktsegment AS seg, (1.0 * c)::DOUBLE AS bal FROM ({_FOLD.format(f='min')}) AS f JOIN customer ON c_custkey = c WHERE f.id NOT IN ({_OLD})""")
def i3_ignore(spark, sf_dir):
    return _repeated(spark, sf_dir, f"INSERT OR IGNORE INTO cust {_REPEATS}")


@frame("i3_replace_repeats", f"""SELECT f.id, 'n' || c AS name, c_mktsegment AS seg, (1.0 * c)::DOUBLE AS bal FROM ({_FOLD.format(f='max')}) AS f JOIN customer ON c_custkey = c
    UNION ALL SELECT id, 'old' AS name, 'none' AS seg, 0.0::DOUBLE AS bal FROM ({_OLD}) AS o WHERE id NOT IN (SELECT c_custkey % 50 FROM customer)""")
def i3_replace(spark, sf_dir):
    return _repeated(spark, sf_dir, f"INSERT OR REPLACE INTO cust {_REPEATS}")


@frame("i4_upsert_repeats", f"""SELECT f.id, CASE WHEN o.id IS NULL THEN 'n' || a ELSE 'old' END || repeat('!', CASE WHEN o.id IS NULL THEN n - 1 ELSE n END::INT) AS name, c_mktsegment AS seg, s AS bal
    FROM (SELECT c_custkey % 50 AS id, min(c_custkey) AS a, max(c_custkey) AS z, count(*) AS n, sum(c_custkey)::DOUBLE AS s FROM customer GROUP BY 1) AS f
    JOIN customer ON c_custkey = z LEFT JOIN ({_OLD}) AS o ON o.id = f.id
    UNION ALL SELECT id, 'old' AS name, 'none' AS seg, 0.0::DOUBLE AS bal FROM ({_OLD}) AS o WHERE id NOT IN (SELECT c_custkey % 50 FROM customer)""")
def i4_repeats(spark, sf_dir):
    return _repeated(spark, sf_dir, f"INSERT INTO cust {_REPEATS} ON CONFLICT(id) DO UPDATE SET name = name || '!', seg = excluded.seg, bal = cust.bal + excluded.bal")


@frame("i5_update", f"SELECT id, name, lower(seg) AS seg, CASE WHEN seg = 'BUILDING' THEN bal + 100 ELSE bal END AS bal FROM ({_CUST}) WHERE seg = 'BUILDING' UNION ALL SELECT id, name, seg, bal FROM ({_CUST}) WHERE seg <> 'BUILDING'")
def i5(spark, sf_dir):
    db = _loaded(spark, sf_dir, _LOAD)
    db.execute("UPDATE cust SET seg = lower(seg), bal = bal + 100 WHERE seg = 'BUILDING'")
    return db.query("SELECT * FROM cust")


@frame("i6_delete", f"SELECT * FROM ({_CUST}) WHERE NOT coalesce(bal < 0, false)")
def i6(spark, sf_dir):
    db = _loaded(spark, sf_dir, _LOAD)
    db.execute("DELETE FROM cust WHERE bal < 0")
    return db.query("SELECT * FROM cust")


@frame("i6_delete_limit", "SELECT c_custkey AS id FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def i6_limit(spark, sf_dir):
    return _loaded(spark, sf_dir, _LOAD).execute("DELETE FROM cust ORDER BY bal DESC, id LIMIT 25 RETURNING id").returned


@frame("i7_returning", "SELECT c_custkey AS id, c_acctbal * 2 AS twice FROM customer WHERE c_mktsegment = 'BUILDING'")
def i7(spark, sf_dir):
    return _loaded(spark, sf_dir, _LOAD).execute("UPDATE cust SET seg = 'X' WHERE seg = 'BUILDING' RETURNING id, bal * 2 AS twice").returned


@frame("j2_generated", "SELECT c_custkey AS id, c_acctbal AS bal, c_acctbal * 1.5 AS more FROM customer")
def j2(spark, sf_dir):
    db = Engine(spark)
    db.register("src", lambda: table(spark, sf_dir, "customer"))
    db.execute("CREATE TABLE g (id INTEGER PRIMARY KEY, bal REAL CHECK (bal > -100000.0), more REAL GENERATED ALWAYS AS (bal * 1.5) STORED)")
    db.execute("INSERT INTO g (id, bal) SELECT c_custkey, c_acctbal FROM src")
    return db.query("SELECT * FROM g")


@frame("j3_foreign_keys", "SELECT n_nationkey AS id, CASE WHEN n_regionkey = 2 THEN NULL ELSE n_regionkey END AS rid FROM nation WHERE n_regionkey <> 1")
def j3(spark, sf_dir):
    db = Engine(spark)
    for name in ("nation", "region"):
        db.register(f"src_{name}", lambda name=name: table(spark, sf_dir, name))
    db.execute("CREATE TABLE r (id INTEGER PRIMARY KEY)")
    db.execute("CREATE TABLE n (id INTEGER PRIMARY KEY, rid INTEGER REFERENCES r(id) ON DELETE CASCADE)")
    db.execute("CREATE TABLE m (id INTEGER PRIMARY KEY, rid INTEGER REFERENCES r(id) ON DELETE SET NULL)")
    db.execute("INSERT INTO r SELECT r_regionkey FROM src_region")
    db.execute("INSERT INTO n SELECT n_nationkey, n_regionkey FROM src_nation WHERE n_regionkey <> 2")
    db.execute("INSERT INTO m SELECT n_nationkey, n_regionkey FROM src_nation WHERE n_regionkey = 2")
    db.execute("DELETE FROM r WHERE id IN (1, 2)")
    return db.query("SELECT * FROM n UNION ALL SELECT * FROM m")


@frame("j5_alter", "SELECT n_nationkey AS key, n_name AS name, 'none' AS note FROM nation")
def j5(spark, sf_dir):
    db = Engine(spark)
    db.register("src", lambda: table(spark, sf_dir, "nation"))
    db.execute("CREATE TABLE a (id INTEGER PRIMARY KEY, name TEXT, gone INTEGER)")
    db.execute("INSERT INTO a SELECT n_nationkey, n_name, n_regionkey FROM src")
    for sql in ("ALTER TABLE a ADD COLUMN note TEXT DEFAULT 'none'", "ALTER TABLE a DROP COLUMN gone", "ALTER TABLE a RENAME COLUMN id TO key", "ALTER TABLE a RENAME TO b"):
        db.execute(sql)
    return db.query("SELECT * FROM b")


@frame("j7_view", "SELECT c_mktsegment AS seg, COUNT(*) AS n FROM customer GROUP BY c_mktsegment")
def j7(spark, sf_dir):
    db = _loaded(spark, sf_dir, _LOAD)
    db.execute("CREATE VIEW per (seg, n) AS SELECT seg, COUNT(*) FROM cust GROUP BY seg")
    return db.query("SELECT * FROM per")


@frame("j8_trigger", "SELECT c_custkey AS id, 'added ' || c_name AS what FROM customer WHERE c_acctbal > 5000")
def j8(spark, sf_dir):
    db = Engine(spark)
    db.register("src", lambda: table(spark, sf_dir, "customer"))
    db.execute("CREATE TABLE cust (id INTEGER PRIMARY KEY, name TEXT, bal REAL)")
    db.execute("CREATE TABLE log (id INTEGER, what TEXT)")
    db.execute("CREATE TRIGGER tr AFTER INSERT ON cust WHEN NEW.bal > 5000 BEGIN INSERT INTO log VALUES (NEW.id, 'added ' || NEW.name); END")
    db.execute("INSERT INTO cust SELECT c_custkey, c_name, c_acctbal FROM src")
    return db.query("SELECT * FROM log")


@frame("j8_trigger_update", "SELECT c_nationkey AS nation, COUNT(*) AS n, ROUND(SUM(c_acctbal), 2) AS bal FROM customer GROUP BY c_nationkey HAVING COUNT(*) > 0")
def j8_update(spark, sf_dir):
    db = Engine(spark)
    db.register("src", lambda: table(spark, sf_dir, "customer"))
    db.execute("CREATE TABLE cust (id INTEGER PRIMARY KEY, nation INTEGER, bal REAL)")
    db.execute("CREATE TABLE total (nation INTEGER, n INTEGER, bal REAL)")
    db.execute("INSERT INTO total SELECT DISTINCT c_nationkey, 0, 0.0 FROM src")
    db.execute("CREATE TRIGGER tr AFTER INSERT ON cust BEGIN UPDATE total SET n = n + 1, bal = bal + NEW.bal WHERE nation = NEW.nation; END")
    db.execute("INSERT INTO cust SELECT c_custkey, c_nationkey, c_acctbal FROM src")
    return db.query("SELECT nation, n, ROUND(bal, 2) AS bal FROM total")


@frame("j9_savepoints", "SELECT COUNT(*) AS n FROM customer WHERE c_acctbal >= 0")
def j9(spark, sf_dir):
    db = _loaded(spark, sf_dir, _LOAD)
    for sql in ("BEGIN", "DELETE FROM cust WHERE bal < 0", "SAVEPOINT s", "DELETE FROM cust", "ROLLBACK TO s", "RELEASE s", "COMMIT"):
        db.execute(sql)
    return db.query("SELECT COUNT(*) AS n FROM cust")


@frame("j11_table_info", "SELECT * FROM (VALUES (0, 'id', 'INTEGER', 1, 1), (1, 'name', 'TEXT', 1, 0), (2, 'seg', 'TEXT', 0, 0), (3, 'bal', 'REAL', 0, 0)) AS v(cid, name, type, \"notnull\", pk)")
def j11(spark, sf_dir):
    return _loaded(spark, sf_dir, _LOAD).query("PRAGMA table_info(cust)").drop("dflt_value")


@frame("j4_drop", "SELECT * FROM (VALUES ('table', 'kept'), ('index', 'kept_i')) AS v(type, name)")
def j4(spark, sf_dir):
    db = Engine(spark)
    for sql in ("CREATE TABLE kept (a INTEGER, b TEXT)", "CREATE INDEX kept_i ON kept (a)", "CREATE INDEX gone_i ON kept (b)", "CREATE TABLE gone (a INTEGER)", "CREATE VIEW v AS SELECT a FROM kept",
                "CREATE TRIGGER g AFTER INSERT ON kept BEGIN DELETE FROM gone; END", "DROP INDEX gone_i", "DROP TRIGGER g", "DROP VIEW v", "DROP TABLE gone", "DROP TABLE IF EXISTS gone"):
        db.execute(sql)
    return db.query("SELECT type, name FROM sqlite_master")


@frame("j6_index", "SELECT * FROM (VALUES (0, 'by_low', 1), (1, 'by_bal', 0)) AS v(seq, name, \"unique\")")
def j6(spark, sf_dir):
    """An expression index that is unique among some rows, and a plain one."""
    db = _loaded(spark, sf_dir, _LOAD)
    db.execute("CREATE UNIQUE INDEX by_low ON cust (LOWER(name)) WHERE bal > 0")
    db.execute("CREATE INDEX by_bal ON cust (bal)")
    return db.query("PRAGMA index_list(cust)")


@frame("j10_transaction", "SELECT COUNT(*) AS n FROM customer WHERE c_acctbal >= 0")
def j10(spark, sf_dir):
    """What one transaction does stays; what another does, which fails, doesn't."""
    db = _loaded(spark, sf_dir, _LOAD)
    with db.transaction():
        db.execute("DELETE FROM cust WHERE bal < 0")
    try:
        with db.transaction():
            db.execute("DELETE FROM cust")
            raise KeyError
    except KeyError:
        return db.query("SELECT COUNT(*) AS n FROM cust")


@frame("j12_explain_rows", "SELECT 'root' AS node, COUNT(*) AS n FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'scan', COUNT(*) FROM customer")
def j12_rows(spark, sf_dir):
    """EXPLAIN ANALYZE counts the rows of every operator: here the root's, and those of the scan below."""
    found = engine(spark, sf_dir).query("EXPLAIN ANALYZE SELECT c_custkey FROM customer WHERE c_acctbal + 0 > 0")
    kind = F.when(F.col("parent") == -1, "root").when(F.col("detail").startswith("FileScan"), "scan")
    return found.select(kind.alias("node"), F.col("rows").alias("n")).where("node IS NOT NULL")


@frame("j13_attach", "SELECT 'main' AS db, COUNT(*) AS n FROM customer UNION ALL SELECT 'other', COUNT(*) FROM customer WHERE c_acctbal > 0")
def j13(spark, sf_dir):
    """Statements go to the active database, which has tables of its own."""
    db = _loaded(spark, sf_dir, _LOAD)
    db.execute(f"ATTACH '{db.store.root}/_other' AS other")
    db.attached["other"].register("src", lambda: table(spark, sf_dir, "customer"))
    db.execute("PRAGMA active_database = other")
    db.execute("CREATE TABLE cust (id INTEGER PRIMARY KEY)")
    db.execute("INSERT INTO cust SELECT c_custkey FROM src WHERE c_acctbal > 0")
    there = db.query("SELECT 'other' AS db, COUNT(*) AS n FROM cust")
    db.execute("PRAGMA active_database = main")
    return db.query("SELECT 'main' AS db, COUNT(*) AS n FROM cust").unionAll(there)


@frame("j14_vacuum", f"SELECT 1 AS parts, id, bal FROM ({_CUST}) WHERE NOT coalesce(bal < 0, false)")
def j14(spark, sf_dir):
    db = _loaded(spark, sf_dir, f"{_LOAD} WHERE c_acctbal > 5000")
    db.execute(f"INSERT INTO cust {_LOAD} WHERE c_acctbal <= 5000 OR c_acctbal IS NULL")
    db.execute("DELETE FROM cust WHERE bal < 0")
    db.execute("VACUUM")
    return db.query("SELECT id, bal FROM cust").select(F.lit(len(db.store.state.tables["cust"].parts)).alias("parts"), "id", "bal")


@frame("j16_statistics", "SELECT COUNT(*) AS rows_examined, COUNT(DISTINCT o_custkey) AS rows_returned FROM orders")
def j16(spark, sf_dir):
    cost = engine(spark, sf_dir).stats("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey")
    return spark.createDataFrame([(cost.rows_examined, cost.rows_returned)], "rows_examined long, rows_returned long")


@frame("j17_prepared", "SELECT c_custkey, c_mktsegment FROM customer WHERE (c_acctbal > 5000 AND c_mktsegment = 'BUILDING') OR (c_acctbal > 0 AND c_mktsegment = 'MACHINERY')")
def j17(spark, sf_dir):
    made = engine(spark, sf_dir).prepare("SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > :low AND c_mktsegment = :seg")
    return made(low=5000, seg="BUILDING").unionAll(made(low=0, seg="MACHINERY"))


@frame("j12_explain")
def j12(spark, sf_dir):
    return engine(spark, sf_dir).query("EXPLAIN ANALYZE SELECT COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey")


@frame("j15_as_of", "SELECT COUNT(*) AS then_, (SELECT COUNT(*) FROM customer WHERE c_acctbal >= 0) AS now_ FROM customer")
def j15(spark, sf_dir):
    db = _loaded(spark, sf_dir, _LOAD)
    txn = len(db.store.log)
    db.execute("DELETE FROM cust WHERE bal < 0")
    return db.query_as_of("SELECT COUNT(*) AS then_ FROM cust", txn=txn).crossJoin(db.query("SELECT COUNT(*) AS now_ FROM cust"))


@frame("l2_reactive_delta", "SELECT c_mktsegment AS seg, COUNT(*) AS n FROM customer WHERE c_acctbal < 9000 AND c_mktsegment <> 'FURNITURE' GROUP BY c_mktsegment")
def l2(spark, sf_dir):
    db = _loaded(spark, sf_dir, f"{_LOAD} WHERE c_acctbal >= 0")
    db.execute("CREATE REACTIVE VIEW v AS SELECT seg, COUNT(*) AS n FROM cust GROUP BY seg REFRESH DELTA")
    db.execute(f"INSERT INTO cust {_LOAD} WHERE c_acctbal < 0")
    db.execute("DELETE FROM cust WHERE bal >= 9000 OR seg = 'FURNITURE'")
    return db.query("SELECT seg, n FROM v")


@frame("l3_reactive_full", "SELECT c_mktsegment AS seg, MAX(c_acctbal) AS top FROM customer WHERE c_acctbal < 9000 GROUP BY c_mktsegment")
def l3(spark, sf_dir):
    db = _loaded(spark, sf_dir, _LOAD)
    db.execute("CREATE REACTIVE VIEW v AS SELECT seg, MAX(bal) AS top FROM cust GROUP BY seg REFRESH FULL")
    db.execute("DELETE FROM cust WHERE bal >= 9000")
    return db.query("SELECT seg, top FROM v")


@frame("l5_zset", "SELECT n_regionkey AS k, COUNT(*) AS _w FROM nation WHERE n_nationkey > 4 GROUP BY n_regionkey")
def l5(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("k"))
    z = ivm.subtract(ivm.weighted(rows), ivm.weighted(rows.where("n_nationkey <= 4")))
    return ivm.mapped(ivm.filtered(ivm.distinct(ivm.scale(z, 3)), "n_nationkey >= 0"), F.col("k"))


@frame("l9_change_feed", "SELECT 'update' AS _op, c_custkey AS old_id, c_acctbal AS old_bal, c_acctbal + 1 AS new_bal FROM customer WHERE c_mktsegment = 'FURNITURE'")
def l9(spark, sf_dir):
    feed = _loaded(spark, sf_dir, _LOAD).execute("UPDATE cust SET bal = bal + 1 WHERE seg = 'FURNITURE'").feed
    return feed.select("_op", "old_id", "old_bal", "new_bal")


@frame("l10_callbacks", "SELECT c_mktsegment AS seg, COUNT(*) AS n, -1 AS _w FROM customer GROUP BY c_mktsegment HAVING COUNT(*) FILTER (WHERE c_acctbal < 0) > 0 UNION ALL SELECT c_mktsegment, COUNT(*) FILTER (WHERE coalesce(c_acctbal >= 0, true)), 1 FROM customer GROUP BY c_mktsegment HAVING COUNT(*) FILTER (WHERE c_acctbal < 0) > 0")
def l10(spark, sf_dir):
    """What a view's callback is told of a deletion: old rows with weight -1, new ones with 1."""
    db, told = _loaded(spark, sf_dir, _LOAD), []
    db.execute("CREATE REACTIVE VIEW v AS SELECT seg, COUNT(*) AS n FROM cust GROUP BY seg REFRESH DELTA")
    end = ivm.on_change(db, "v", told.append, ivm.generation(db, "v"))
    db.execute("DELETE FROM cust WHERE bal < 0")
    end()
    return told[0].select("seg", "n", "_w")


# ---- K: full-text search ------------------------------------------------------------------------
def _tokens(c: str) -> str:
    return rf"regexp_extract_all(replace(lower({c}), 'ß', 'ss'), '[\p{{L}}\p{{N}}\p{{M}}\p{{Pc}}]+')"


_SCORE = f"""
    WITH t AS (SELECT doc_id, {_tokens('text')} AS w FROM documents),
    c AS (SELECT doc_id, len(w) AS n, len([x FOR x IN w IF x = 'thing']) AS a, len([x FOR x IN w IF x = 'trash']) AS b FROM t),
    s AS (SELECT COUNT(*) AS docs, AVG(n) AS mean, COUNT(*) FILTER (WHERE a > 0) AS da, COUNT(*) FILTER (WHERE b > 0) AS db FROM c)
    SELECT doc_id, round(ln((docs - da + 0.5) / (da + 0.5) + 1) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean))
                       + ln((docs - db + 0.5) / (db + 0.5) + 1) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)), 6) AS rank
    FROM c, s WHERE a > 0 OR b > 0"""


@frame("k1_postings", f"SELECT doc_id, CAST(unnest(range(len(w))) AS INTEGER) AS pos, unnest(w) AS term FROM (SELECT doc_id, {_tokens('text')} AS w FROM documents)")
def k1(spark, sf_dir):
    """The inverted index of all documents."""
    engine(spark, sf_dir)
    return fts.postings(table(spark, sf_dir, "documents"), "doc_id", "text")


@frame("k3_match", f"SELECT doc_id FROM (SELECT doc_id, {_tokens('text')} AS w FROM documents) WHERE (list_contains(w, 'trash') AND NOT list_contains(w, 'worthless')) OR len([x FOR x IN w IF starts_with(x, 'licens')]) > 0")
def k3(spark, sf_dir):
    engine(spark, sf_dir)
    return fts.search(table(spark, sf_dir, "documents"), ["text"], "trash -worthless OR licens*", ["doc_id"]).select("doc_id")


@frame("k3_phrase", "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}\\p{M}\\p{Pc}])licensed[^\\p{L}\\p{N}\\p{M}\\p{Pc}]+under([^\\p{L}\\p{N}\\p{M}\\p{Pc}]|$)')")
def k3_phrase(spark, sf_dir):
    engine(spark, sf_dir)
    return fts.search(table(spark, sf_dir, "documents"), ["text"], '"licensed under"', ["doc_id"]).select("doc_id")


@frame("k5_bm25", _SCORE)
def k5(spark, sf_dir):
    engine(spark, sf_dir)
    return fts.search(table(spark, sf_dir, "documents"), ["text"], "thing OR trash", ["doc_id"]).select("doc_id", F.round("rank", 6).alias("rank"))


@frame("k6_snippet")
def k6(spark, sf_dir):
    engine(spark, sf_dir)
    found = fts.search(table(spark, sf_dir, "documents"), ["text"], "trash", ["doc_id", "text"])
    return found.select("doc_id", fts.snippet("text", "trash", "<b>", "</b>", "...", 8).alias("snippet"))


_libraries: dict[tuple, Engine] = {}


def _library(spark: SparkSession, sf_dir: str) -> Engine:
    """A database with all documents in a full-text table, made once for a folder; the searches then read its index."""
    key = (id(spark), sf_dir)
    if key not in _libraries:
        db = Engine(spark)
        db.register("src", lambda: table(spark, sf_dir, "documents"))
        db.execute("CREATE VIRTUAL TABLE docs USING fts5(doc_id, text)")
        db.execute("INSERT INTO docs SELECT CAST(doc_id AS TEXT), text FROM src")
        _libraries[key] = db
    return _libraries[key]


# The id is a column of the table, and so one more word of a document.
_MATCHED = _SCORE.replace("SELECT doc_id, len(w) AS n", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, len(w) + 1 AS n")


@frame("k4_match_sql", f"SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM ({ORACLE_SQL['k3_match']}) UNION ALL SELECT 'phrase ' || doc_id FROM ({ORACLE_SQL['k3_phrase']})")
def k4(spark, sf_dir):
    db = _library(spark, sf_dir)
    phrase = db.query("SELECT doc_id FROM docs WHERE docs MATCH '\"licensed under\"'")
    return db.query("SELECT doc_id FROM docs WHERE docs MATCH 'trash -worthless OR licens*'").unionAll(phrase.select(F.concat(F.lit("phrase "), "doc_id")))


@frame("k5_bm25_index", _MATCHED)
def k5_index(spark, sf_dir):
    return _library(spark, sf_dir).query("SELECT doc_id, rank FROM docs WHERE docs MATCH 'thing OR trash'").select("doc_id", F.round("rank", 6).alias("rank"))


@frame("k7_fts_delete", _MATCHED.replace("FROM documents)", "FROM documents WHERE text NOT LIKE '%worthless%')"))
def k7(spark, sf_dir):
    """Ranks after rows have gone: the totals are those of the rows left."""
    db = Engine(spark)
    db.register("src", lambda: table(spark, sf_dir, "documents"))
    db.execute("CREATE VIRTUAL TABLE docs USING fts5(doc_id, text)")
    db.execute("INSERT INTO docs SELECT CAST(doc_id AS TEXT), text FROM src")
    db.execute("DELETE FROM docs WHERE text GLOB '*worthless*'")  # the dialect's LIKE folds case, which the SQL's doesn't
    return db.query("SELECT doc_id, rank FROM docs WHERE docs MATCH 'thing OR trash'").select("doc_id", F.round("rank", 6).alias("rank"))


# ---- TPC-H shapes ------------------------------------------------------------------------------
Q1 = """SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, round(SUM(l_extendedprice), 2) AS sum_base, round(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
    round(SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(AVG(l_quantity), 6) AS avg_qty, round(AVG(l_extendedprice), 4) AS avg_price, round(AVG(l_discount), 6) AS avg_disc, COUNT(*) AS n
    FROM lineitem WHERE l_shipdate <= '2001-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus"""
dialect("tpch_q1", Q1)
dialect("tpch_q3", """SELECT l_orderkey, round(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
    AND o_orderdate < '1998-03-15' AND l_shipdate > '1998-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""")
dialect("tpch_q4_shape", """SELECT o_orderpriority, COUNT(*) AS n FROM orders WHERE o_orderdate >= '1997-07-01' AND o_orderdate < '1997-10-01'
    AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40) GROUP BY o_orderpriority ORDER BY o_orderpriority""")
dialect("tpch_q5", """SELECT n_name, round(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey
    AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND o_orderdate >= '1996-01-01' AND o_orderdate < '1999-01-01' GROUP BY n_name""")
dialect("tpch_q6", "SELECT round(SUM(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= '1996-01-01' AND l_shipdate < '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
dialect("tpch_q7", """SELECT a.n_name AS supp, b.n_name AS cust, round(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM supplier, lineitem, orders, customer, nation AS a, nation AS b WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey
    AND c_custkey = o_custkey AND s_nationkey = a.n_nationkey AND c_nationkey = b.n_nationkey AND ((a.n_name = 'NATION_1' AND b.n_name = 'NATION_2') OR (a.n_name = 'NATION_2' AND b.n_name = 'NATION_1')) GROUP BY a.n_name, b.n_name""",
        """SELECT a.n_name AS supp, b.n_name AS cust, round(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM supplier, lineitem, orders, customer, nation AS a, nation AS b WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey
    AND c_custkey = o_custkey AND s_nationkey = a.n_nationkey AND c_nationkey = b.n_nationkey AND ((a.n_name = 'NATION_1' AND b.n_name = 'NATION_2') OR (a.n_name = 'NATION_2' AND b.n_name = 'NATION_1')) GROUP BY a.n_name, b.n_name""")
dialect("tpch_q8", """SELECT y, round(SUM(CASE WHEN nat = 'NATION_3' THEN vol ELSE 0 END) / SUM(vol), 6) AS share FROM (SELECT STRFTIME('%Y', o_orderdate) AS y, l_extendedprice * (1 - l_discount) AS vol, s.n_name AS nat
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation AS c ON c_nationkey = c.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation AS s ON s_nationkey = s.n_nationkey
    JOIN part ON p_partkey = l_partkey WHERE p_type = 'PROMO') AS v GROUP BY y""",
        """SELECT y, round(SUM(CASE WHEN nat = 'NATION_3' THEN vol ELSE 0 END) / SUM(vol), 6) AS share FROM (SELECT strftime(o_orderdate, '%Y') AS y, l_extendedprice * (1 - l_discount) AS vol, s.n_name AS nat
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation AS c ON c_nationkey = c.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation AS s ON s_nationkey = s.n_nationkey
    JOIN part ON p_partkey = l_partkey WHERE p_type = 'PROMO') AS v GROUP BY y""")
dialect("tpch_q10", """SELECT c_custkey, c_name, round(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, n_name FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_returnflag = 'R'
    AND o_orderdate >= '1996-10-01' AND o_orderdate < '1997-01-01' AND c_nationkey = n_nationkey GROUP BY c_custkey, c_name, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""")
dialect("tpch_q12_shape", """SELECT l_linestatus, SUM(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS high, SUM(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS low
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate >= '1996-01-01' AND l_shipdate < '1997-01-01' GROUP BY l_linestatus""",
        """SELECT l_linestatus, CAST(COUNT(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS BIGINT) AS high, CAST(COUNT(*) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS BIGINT) AS low
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate >= '1996-01-01' AND l_shipdate < '1997-01-01' GROUP BY l_linestatus""")
dialect("tpch_q13", "SELECT n, COUNT(*) AS customers FROM (SELECT c_custkey, COUNT(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 GROUP BY c_custkey) AS c GROUP BY n ORDER BY customers DESC, n DESC")
dialect("tpch_q14", "SELECT round(100.0 * SUM(CASE WHEN p_type = 'PROMO' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / SUM(l_extendedprice * (1 - l_discount)), 6) AS promo FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= '1996-09-01' AND l_shipdate < '1996-10-01'")
dialect("tpch_q15", """WITH revenue AS (SELECT l_suppkey AS no, SUM(l_extendedprice * (1 - l_discount)) AS total FROM lineitem WHERE l_shipdate >= '1996-01-01' AND l_shipdate < '1996-04-01' GROUP BY l_suppkey)
    SELECT s_suppkey, s_name, round(total, 2) AS total FROM supplier JOIN revenue ON s_suppkey = no WHERE total > (SELECT 0.999999 * MAX(total) FROM revenue)""")
dialect("tpch_q17", "SELECT round(SUM(l_extendedprice) / 7.0, 2) AS yearly FROM lineitem, part WHERE p_partkey = l_partkey AND p_brand = 'Brand#13' AND l_quantity < (SELECT 0.4 * AVG(l.l_quantity) FROM lineitem AS l WHERE l.l_partkey = p_partkey)")
dialect("tpch_q18", """SELECT c_name, c_custkey, o_orderkey, o_totalprice, SUM(l_quantity) AS q FROM customer, orders, lineitem WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING SUM(l_quantity) > 300)
    AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY c_name, c_custkey, o_orderkey, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
dialect("tpch_q19_shape", """SELECT round(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem, part WHERE (p_partkey = l_partkey AND p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 25)
    OR (p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30)""")
dialect("tpch_q22_shape", "SELECT c_nationkey, COUNT(*) AS n, round(SUM(c_acctbal), 2) AS bal FROM customer AS c WHERE c_acctbal > (SELECT AVG(x.c_acctbal) FROM customer AS x WHERE x.c_acctbal > 0.0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_totalprice > 420000) GROUP BY c_nationkey")


# ---- extensions: event time ---------------------------------------------------------------------
@frame("x_stream_reactive", "SELECT event_type, COUNT(*) AS n, CAST(SUM(user_id) AS BIGINT) AS s FROM events GROUP BY event_type")
def x_stream(spark, sf_dir):
    """The delta aggregate fed by a stream of the events file."""
    import uuid

    root = f"{engine(spark, sf_dir).store.root}/_stream/{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir).select("event_type", "user_id", F.lit(1).cast("long").alias("_w"))
    run = ivm.stream_aggregate(stream, "event_type", "user_id", f"{root}/state", f"{root}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    last = run.lastProgress.batchId if run.lastProgress else 0
    return spark.read.parquet(f"{root}/state/v{last}").select("event_type", F.col("_n").alias("n"), F.col("_s").alias("s"))
