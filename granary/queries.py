"""One query for each operator of the engine over the test tables, with its SQL for comparison."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary import report
from granary.operators import joins, ordering, spatial
from granary.plans.nodes import Name, Near
from granary.plans.parser import parse
from granary.services import DeadlockError, Journal, SharedLock, TableLocks, summary
from granary.session import Session
from granary.functions.types import Field
from granary.sources import layout, pages
from granary.sources.csv_source import load_points, seed_demo, with_row_numbers
from granary.sources.files import shared_root

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def _dialect(name: str, statement: str, columns: str, oracle: str, strategy: str = "auto") -> None:
    """A query in the dialect; columns: the names of its result."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _session(spark, sf_dir).sql_df(statement, strategy).toDF(*columns.split())

    _query(name, oracle)(run)


def _session(spark: SparkSession, sf_dir: str) -> Session:
    session = Session.over(spark, sf_dir)
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    session.register(
        "supplier_points", read("supplier").select("s_suppkey", "s_name", F.col("s_nationkey").cast("double").alias("px"), (F.col("s_acctbal") / 100).alias("py")), ("px", "py")
    )
    session.register(
        "customer_points", read("customer").select("c_custkey", "c_name", F.col("c_nationkey").cast("double").alias("px"), (F.col("c_acctbal") / 100).alias("py")), ("px", "py")
    )
    return session


def _workspace(spark: SparkSession) -> Session:
    """A session in a workspace of its own, in a folder that all of a cluster sees."""
    return Session.open(spark, f"{shared_root(spark)}/granary-workspaces", f"w{uuid.uuid4().hex}")


SUPPLIER = "(SELECT s_suppkey, s_name, CAST(s_nationkey AS DOUBLE) AS px, s_acctbal / 100 AS py FROM supplier)"
CUSTOMER = "(SELECT c_custkey, c_name, CAST(c_nationkey AS DOUBLE) AS px, c_acctbal / 100 AS py FROM customer)"

# Scans and projections.
_dialect("scan_star", "SELECT * FROM region", "r_regionkey r_name", "SELECT * FROM region")
_dialect("project_cols", "SELECT c_name, c_acctbal FROM customer", "c_name c_acctbal", "SELECT c_name, c_acctbal FROM customer")
_dialect(
    "star_with_others", "SELECT n_name, * FROM nation", "name n_nationkey n_name n_regionkey",
    "SELECT n_name AS name, n_nationkey, n_name, n_regionkey FROM nation",
)
_dialect("table_alias", "SELECT e.n_name FROM nation e WHERE e.n_regionkey = 2", "n_name", "SELECT n_name FROM nation WHERE n_regionkey = 2")

# Conditions.
for _name, _where, _sql in (
    ("filter_eq", "o_orderstatus = 'F'", None),
    ("filter_eq_double", "o_orderstatus == \"F\"", "o_orderstatus = 'F'"),
    ("filter_ne", "o_orderstatus != 'F'", None),
    ("filter_lt_string", "o_orderpriority < '3'", None),
    ("filter_name_as_string", "o_orderstatus = F", "o_orderstatus = 'F'"),
):
    _dialect(_name, f"SELECT o_orderkey, o_orderstatus FROM orders WHERE {_where}", "o_orderkey o_orderstatus", f"SELECT o_orderkey, o_orderstatus FROM orders WHERE {_sql or _where}")
for _name, _where, _sql in (
    ("filter_lt", "l_quantity < 5", None),
    ("filter_gt", "l_quantity > 45", None),
    ("filter_le", "l_quantity <= 5", None),
    ("filter_ge", "l_quantity >= 46", None),
    ("filter_between", "l_quantity BETWEEN 5 AND 10", None),
    ("filter_and", "l_quantity > 40 AND l_returnflag = 'A' AND l_linenumber = 1", None),
    ("filter_and_or_leftassoc", "l_linenumber = 1 OR l_returnflag = 'A' AND l_quantity > 40", "(l_linenumber = 1 OR l_returnflag = 'A') AND l_quantity > 40"),
    ("filter_between_or", "l_quantity BETWEEN 1 AND 2 OR l_linenumber = 7", "(l_quantity BETWEEN 1 AND 2) OR l_linenumber = 7"),
    ("filter_two_columns", "l_orderkey = l_partkey", None),
):
    _columns = "l_orderkey l_linenumber l_quantity l_returnflag"
    _list = ", ".join(_columns.split())
    _dialect(_name, f"SELECT {_list} FROM lineitem WHERE {_where}", _columns, f"SELECT {_list} FROM lineitem WHERE {_sql or _where}")
_dialect("filter_neg_literal", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < -500", "c_custkey c_acctbal", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < -500")
_dialect("filter_string_coerce", "SELECT p_partkey FROM part WHERE p_size = '11'", "p_partkey", "SELECT p_partkey FROM part WHERE p_size = 11")
_dialect("filter_string_no_number", "SELECT p_partkey FROM part WHERE p_size = 'big'", "p_partkey", "SELECT p_partkey FROM part WHERE false")

# Joins.
_ORDERS = "SELECT orders.o_orderkey, customer.c_name FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey"
for _name, _strategy in (("join_inner", "auto"), ("join_merge", "merge"), ("join_shuffle_hash", "hash"), ("join_broadcast", "broadcast")):
    _dialect(_name, _ORDERS, "o_orderkey c_name", _ORDERS, _strategy)
_dialect(
    "join_pushdown_both",
    "SELECT o_orderkey, c_name FROM orders INNER JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0 AND o_totalprice > 100000",
    "o_orderkey c_name",
    "SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0 AND o_totalprice > 100000",
)
_dialect(
    "join_residual_or",
    "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0 OR o_orderstatus = 'P'",
    "o_orderkey c_name",
    "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0 OR o_orderstatus = 'P'",
)
_dialect(
    "join_alias",
    "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 9000",
    "o_orderkey c_name",
    "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 9000",
)
_dialect(
    "self_join", "SELECT a.n_name, b.n_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < 10", "a_name b_name",
    "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < 10",
)
_dialect(
    "join_star", "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey", "n_nationkey n_name n_regionkey r_regionkey r_name",
    "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey",
)
_dialect(
    "join_order_by", "SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9500 ORDER BY n_name, c_name", "c_name n_name",
    "SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9500",
)


@_query("join_theta", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey")
def _join_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session.over(spark, sf_dir)
    return joins.theta_join(s.table("nation"), s.table("region"), F.col("n_regionkey") < F.col("r_regionkey")).select("n_name", "r_name")


# Aggregates.
FLAGSHIP = (
    "SELECT n_name, COUNT(c_custkey) FROM customer JOIN nation ON customer.c_nationkey = nation.n_nationkey "
    "WHERE c_acctbal > 0 GROUP BY n_name"
)
_dialect(
    "join_group", FLAGSHIP, "n_name n", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY n_name"
)
_dialect(
    "group_multi", "SELECT l_returnflag, l_linestatus, COUNT(*), SUM(l_quantity), AVG(l_quantity), MIN(l_shipdate), MAX(l_extendedprice) FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "l_returnflag l_linestatus n sum_qty avg_qty first_ship max_price",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS sum_qty, avg(l_quantity) AS avg_qty, min(l_shipdate) AS first_ship, max(l_extendedprice) AS max_price FROM lineitem GROUP BY ALL",
)
_dialect("group_distinct", "SELECT c_mktsegment FROM customer GROUP BY c_mktsegment", "c_mktsegment", "SELECT DISTINCT c_mktsegment FROM customer")
_dialect(
    "group_order_by", "SELECT o_orderpriority, COUNT(o_orderkey) FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority ORDER BY o_orderpriority", "o_orderpriority n",
    "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1",
)
_ALL = "COUNT(l_orderkey), SUM(l_quantity), AVG(l_quantity), MIN(l_quantity), MAX(l_returnflag)"
_SQL_ALL = "count(*) AS n, coalesce(sum(l_quantity), 0) AS s, coalesce(avg(l_quantity), 0.0) AS a, min(l_quantity) AS lo, max(l_returnflag) AS hi"
_dialect("agg_global", f"SELECT {_ALL} FROM lineitem", "n s a lo hi", f"SELECT {_SQL_ALL} FROM lineitem")
_dialect("agg_global_empty", f"SELECT {_ALL} FROM lineitem WHERE l_quantity > 1000", "n s a lo hi", f"SELECT {_SQL_ALL} FROM lineitem WHERE l_quantity > 1000")
_dialect("agg_sum_integers", "SELECT SUM(p_size), MIN(p_name) FROM part", "s lo", "SELECT CAST(sum(p_size) AS BIGINT) AS s, min(p_name) AS lo FROM part")

# Sorting.
_dialect("order_by_multi", "SELECT o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderkey", "o_custkey o_orderkey", "SELECT o_custkey, o_orderkey FROM orders")
_dialect("order_unprojected", "SELECT c_name FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal", "c_name", "SELECT c_name FROM customer WHERE c_acctbal > 0")


@_query("external_sort", "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem")
def _external_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Session.over(spark, sf_dir).table("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return ordering.ascending(rows, "l_shipdate", "l_orderkey", "l_linenumber")


@_query("top_k", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10")
def _top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.top(Session.over(spark, sf_dir).table("customer").select("c_custkey", "c_acctbal"), 10, "c_acctbal", "c_custkey")


# Points.
_CIRCLE = "sqrt((px - 10.0) * (px - 10.0) + (py - 50.0) * (py - 50.0))"
_dialect("spatial_radius", "SELECT s_suppkey FROM supplier_points WHERE (px, py) IN (POINT(10, 50), RADIUS 20)", "s_suppkey", f"SELECT s_suppkey FROM {SUPPLIER} WHERE {_CIRCLE} <= 20")
_dialect("spatial_single_column", "SELECT s_suppkey FROM supplier_points WHERE px IN (POINT(10, 50), RADIUS 20)", "s_suppkey", f"SELECT s_suppkey FROM {SUPPLIER} WHERE {_CIRCLE} <= 20")
_dialect(
    "spatial_radius_filter", "SELECT s_suppkey FROM supplier_points WHERE s_suppkey < 50 AND (px, py) IN (POINT(10, 50), RADIUS 20)", "s_suppkey",
    f"SELECT s_suppkey FROM {SUPPLIER} WHERE s_suppkey < 50 AND {_CIRCLE} <= 20",
)
_dialect(
    "spatial_radius_group", "SELECT px, COUNT(s_suppkey) FROM supplier_points WHERE (px, py) IN (POINT(10, 50), RADIUS 40) GROUP BY px", "px n",
    f"SELECT px, count(*) AS n FROM {SUPPLIER} WHERE {_CIRCLE} <= 40 GROUP BY px",
)
_dialect("spatial_knn", "SELECT c_custkey FROM customer_points WHERE (px, py) IN (POINT(10, 50), K 10)", "c_custkey", f"SELECT c_custkey FROM {CUSTOMER} ORDER BY {_CIRCLE}, c_custkey LIMIT 10")
_dialect(
    "spatial_knn_filter", "SELECT c_custkey FROM customer_points WHERE c_custkey > 100 AND (px, py) IN (POINT(10, 50), K 5)", "c_custkey",
    f"SELECT c_custkey FROM {CUSTOMER} WHERE c_custkey > 100 ORDER BY {_CIRCLE}, c_custkey LIMIT 5",
)


@_query("spatial_payload", f"SELECT c_custkey AS id, px AS x, py AS y, c_name AS label, {_CIRCLE} AS distance FROM {CUSTOMER} ORDER BY distance, c_custkey LIMIT 7")
def _spatial_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir).spatial_search("customer_points", Near((Name("px"), Name("py")), 10.0, 50.0, k=7))[0]


# Lookups and ranges by key.
@_query("point_lookup", "SELECT * FROM orders WHERE o_orderkey = 42")
def _point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Session.over(spark, sf_dir).lookup("orders", 42)


@_query("range_search", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 100 AND 300")
def _range_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Session.over(spark, sf_dir).range_search("orders", 100, 300).select("o_orderkey", "o_custkey")


# Tables that statements make and change.
_NATION = "id INTEGER, name VARCHAR(25), region INTEGER"


def _with_nations(spark: SparkSession, sf_dir: str, index: str = "") -> Session:
    session = _workspace(spark)
    session._create(_parsed(f"CREATE TABLE t ({_NATION}) {index}"))
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    session.catalog.append("t", nations.selectExpr("n_nationkey AS id", "n_name AS name", "n_regionkey AS region"))
    return session


def _parsed(sql: str):
    return parse(sql)[0]


@_query("insert_then_select", "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation UNION ALL SELECT 100, 'O''Land', 3 UNION ALL SELECT 101, 'x', -1")
def _insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _with_nations(spark, sf_dir)
    session.execute("INSERT INTO t VALUES (100, 'O''Land', 3); INSERT INTO t VALUES ('101', \"x\", -1.9)")
    return session.table("t")


@_query("delete_where", "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation WHERE NOT ((n_regionkey = 1 OR n_regionkey = 2) AND n_nationkey < 20)")
def _delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _with_nations(spark, sf_dir)
    session.execute("DELETE FROM t WHERE region = 1 OR region = 2 AND id < 20")
    return session.table("t")


for _kind in ("SEQUENTIAL", "BTREE", "HASH"):

    @_query(f"layout_{_kind.lower()}", "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation WHERE n_nationkey BETWEEN 5 AND 12")
    def _layout(spark: SparkSession, sf_dir: str, kind: str = _kind) -> DataFrame:
        return _with_nations(spark, sf_dir, f"INDEX ({kind} id)").sql_df("SELECT * FROM t WHERE id BETWEEN 5 AND 12").toDF("id", "name", "region")


@_query("layout_hash_lookup", "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation WHERE n_nationkey = 7")
def _hash_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_nations(spark, sf_dir, "INDEX (HASH id)").lookup("t", 7)


@_query("layout_rtree", f"SELECT CAST(s_suppkey AS INTEGER) AS id FROM {SUPPLIER} WHERE {_CIRCLE} <= 20")
def _layout_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _workspace(spark)
    session._create(_parsed("CREATE TABLE p (id INT, x FLOAT, y FLOAT) INDEX (RTREE x)"))
    points = _session(spark, sf_dir).table("supplier_points")
    session.catalog.append("p", points.selectExpr("CAST(s_suppkey AS INT) AS id", "CAST(px AS FLOAT) AS x", "CAST(py AS FLOAT) AS y"))
    return session.sql_df("SELECT id FROM p WHERE (x, y) IN (POINT(10, 50), RADIUS 20)")


_CSV = (
    "id,name,amount,big,free text\n1,one,1.5,3000000000,\"a, \"\"b\"\"\nc\"\n2, two ,x,1,\n3.9,three,2,nope,é\n,,,,\n"
    # what follows the 20 rows that decide the types
    + "".join(f"{i},n{i},{i}.25,{i},t\n" for i in range(4, 21)) + "bad,last,bad,9,z\n"
)
_CSV_SQL = (
    "SELECT CAST(id AS REAL) AS id, name, amount, big, \"free text\" FROM (VALUES "
    "(1.0, 'one', '1.5', '3000000000', 'a, \"b\"' || chr(10) || 'c'), (2.0, 'two', 'x', '1', ''), (3.9, 'three', '2', 'nope', 'é'), (0.0, '', '', '', ''), "
    + ", ".join(f"({i}.0, 'n{i}', '{i}.25', '{i}', 't')" for i in range(4, 21))
    + ", (0.0, 'last', 'bad', '9', 'z')) v(id, name, amount, big, \"free text\")"
)


def _csv_file(session: Session, text: str) -> str:
    path = f"{session.catalog.path}/in.csv"
    session.catalog.files.write(path, text)
    return path


@_query("csv_ingest_infer", _CSV_SQL)
def _csv_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _workspace(spark)
    session.ingest(_csv_file(session, _CSV), "made")
    return session.table("made")


@_query(
    "csv_ingest_coerce",
    "SELECT * FROM (VALUES (CAST(1 AS INTEGER), 'one', CAST(1.5 AS REAL), CAST(3000000000 AS BIGINT), ''), (2, 'two', 0, 1, ''), (3, 'thre', 2, 0, ''), (0, '', 0, 0, ''), "
    + ", ".join(f"({i}, 'n{i}', {i}.25, {i}, '')" for i in range(4, 21))
    + ", (0, 'last', 0, 9, '')) v(id, name, amount, big, missing)",
)
def _csv_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _workspace(spark)
    path = _csv_file(session, _CSV)
    session._create(_parsed(f"CREATE TABLE d (id INT, name CHAR(4), amount DOUBLE, big BIGINT, missing TEXT) FROM FILE '{path}'"))
    return session.table("d")


@_query("csv_points", "SELECT * FROM (VALUES (CAST(1 AS INTEGER), 'a', CAST(1.5 AS REAL), CAST(-2 AS REAL)), (2, 'c', 3, 4)) v(\"ID\", \"Name\", \"Lat\", \"Lon\")")
def _csv_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _workspace(spark)
    path = _csv_file(session, "city;la;lo\na;1.5;-2\nb;north;1\nc;3;4\n")
    return load_points(spark, path, "city", "la", "lo", sep=";")


@_query("list_tables", "SELECT * FROM (VALUES (0, 't', 'BTREE', 'id', 1)) v(position, name, layout, key, parts)")
def _list_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_nations(spark, sf_dir, "INDEX (BTREE id)").catalog.list_tables()


@_query("describe_table", "SELECT * FROM (VALUES (0, 'id', 'INTEGER', NULL), (1, 'name', 'STRING', 25), (2, 'region', 'INTEGER', NULL)) v(position, \"column\", type, size)")
def _describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_nations(spark, sf_dir).catalog.describe("t")


@_query("soft_keywords", "SELECT 1 AS k, 2 AS radius, 'p' AS point")
def _soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _workspace(spark)
    session.execute("CREATE TABLE rtree (k INT, radius INT, point TEXT); INSERT INTO rtree VALUES (1, 2, 'p')")
    return session.sql_df("SELECT k, radius, point FROM rtree WHERE radius = 2")


@_query("layout_btree_lookup", "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation WHERE n_nationkey = 7")
def _btree_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_nations(spark, sf_dir, "INDEX (BTREE id)").lookup("t", 7)


@_query("layout_btree_order", "SELECT row_number() OVER (ORDER BY n_nationkey DESC) - 1 AS position, n_nationkey AS id FROM nation")
def _btree_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each row in the files of a table that is sorted by a column."""
    session = _workspace(spark)
    session._create(_parsed("CREATE TABLE t (back INT, id INT) INDEX (BTREE back)"))
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    session.catalog.append("t", nations.selectExpr("-n_nationkey AS back", "n_nationkey AS id"))
    return with_row_numbers(session.table("t").select("id"), "position").select((F.col("position") - 1).alias("position"), "id")


@_query("order_by_position", "SELECT row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) AS position, l_orderkey, l_linenumber FROM lineitem")
def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order itself: every row's place in the sorted result."""
    session = Session.over(spark, sf_dir)
    return with_row_numbers(session.sql_df("SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_shipdate, l_orderkey, l_linenumber"), "position")


@_query("join_theta_large", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey")
def _theta_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As two sides that are too large to broadcast are joined."""
    s = Session.over(spark, sf_dir)
    return joins.theta_join(s.table("nation"), s.table("region"), F.col("n_regionkey") < F.col("r_regionkey"), limit=0).select("n_name", "r_name")


@_query("seed_demo", "SELECT * FROM (VALUES ('Ciudades', 1, 'Lima'), ('Ciudades', 2, 'Oslo'), ('Paises', 1, 'Peru'), ('Paises', 2, 'Chad')) v(name, id, label)")
def _seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _workspace(spark)
    files = {}
    for name, text in (("Paises", "country,region\nPeru,America\nChad,Africa\n"), ("Ciudades", "City,Latitude,Longitude\nLima,-12,-77\nOslo,60,11\n")):
        files[name] = f"{session.catalog.path}/{name}.csv"
        session.catalog.files.write(files[name], text)
    made = [(name, session.table(name)) for name in seed_demo(session.catalog, files)]
    one, two = (df.select(F.lit(name).alias("name"), F.col("ID").alias("id"), F.col(df.columns[1]).alias("label")) for name, df in made)
    return one.unionByName(two)


@_query("reorganise", "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region, 1 AS parts FROM nation UNION ALL SELECT 100 + range, 'x', 0, 1 FROM range(3)")
def _reorganise(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _with_nations(spark, sf_dir)
    for i in range(3):
        session.execute(f"INSERT INTO t VALUES ({100 + i}, 'x', 0)")
    session.catalog.compact("t")
    return session.table("t").withColumn("parts", F.lit(len(session.catalog.table("t").parts)))


@_query("small_parts_merge", "SELECT count(*) + 7 AS n, 4 AS parts, true AS first_stays FROM nation")
def _merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small additions become one; a large part is left alone."""
    session = _with_nations(spark, sf_dir)
    _as_large(session, "t")
    first = session.catalog.table("t").parts[0].path
    session.catalog.compact_after = 5
    for i in range(7):
        session.catalog.append_values("t", [(100 + i, "x", 0)])
    parts = session.catalog.table("t").parts
    rows = session.table("t").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("n", F.lit(len(parts)).alias("parts"), F.lit(first in [p.path for p in parts]).alias("first_stays"))


def _as_large(session: Session, name: str) -> None:
    """Let a table's parts count as ones of many rows."""
    from dataclasses import replace

    parts = session.catalog.table(name).parts
    session.catalog._swap(name, parts, [replace(p, rows=10**9) for p in parts])


@_query("hash_buckets_grow", "SELECT * FROM (VALUES (1, 32), (128000000, 32), (128000001, 64), (1000000000, 256), (1000000000000, 262144)) v(\"rows\", buckets)")
def _buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, layout.buckets_for(n)) for n in (1, 128_000_000, 128_000_001, 10**9, 10**12)], "rows bigint, buckets int")


@_query("rejected", "SELECT * FROM (VALUES ('SELECT name, COUNT(id) FROM t', 'error'), ('SELECT * FROM t GROUP BY id', 'error'), ('SELECT nothing FROM t', 'error'), ('INSERT INTO t VALUES (1)', 'error'), ('SELECT id FROM t WHERE id = 3', 'table')) v(statement, kind)")
def _rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _with_nations(spark, sf_dir)
    statements = ("SELECT name, COUNT(id) FROM t", "SELECT * FROM t GROUP BY id", "SELECT nothing FROM t", "INSERT INTO t VALUES (1)", "SELECT id FROM t WHERE id = 3")
    return spark.createDataFrame([(x, session.execute(x).kind) for x in statements], "statement string, kind string")


@_query("execute_program", "SELECT * FROM (VALUES (0, 'message', 'Table ''p'' created', 0), (1, 'message', '2 row(s) inserted into ''p''\n1 row(s) deleted from ''p''', 0), (2, 'table', '', 1), (3, 'message', 'Table ''p'' already exists', 0), (4, 'message', 'Empty query', 0), (5, 'error', 'Table ''q'' not found', 0)) v(step, kind, message, n)")
def _execute(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _workspace(spark)
    programs = (
        "CREATE TABLE p (id INT)", "INSERT INTO p VALUES (1); INSERT INTO p VALUES (2); DELETE FROM p WHERE id = 1", "SELECT * FROM p", "CREATE TABLE p (id INT)", " ",
        "SELECT * FROM q",
    )
    found = [session.execute(x) for x in programs]
    return spark.createDataFrame([(i, r.kind, r.message, len(r.rows)) for i, r in enumerate(found)], "step int, kind string, message string, n int")


@_query("message_summary", "SELECT * FROM (VALUES (0, 'OK'), (1, '1 row inserted into ''t'''), (2, '2 row(s) inserted into ''t''\n5 row(s) deleted from ''u''\nTable ''u'' created')) v(step, message)")
def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = [[], [("insert", "t", 1)], [("create", "Table 'u' created", 0), ("insert", "t", 1), ("insert", "t", 1), ("delete", "u", 2), ("delete", "u", 3)]]
    return spark.createDataFrame([(i, summary(c)) for i, c in enumerate(cases)], "step int, message string")


@_query("workspaces_apart", "SELECT * FROM (VALUES ('one', 'table', 2), ('two', 'error', 0), ('one again', 'table', 2)) v(session, kind, n)")
def _apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{shared_root(spark)}/granary-workspaces/r{uuid.uuid4().hex}"
    one, two = Session.open(spark, root, "one"), Session.open(spark, root, "two")
    one.execute("CREATE TABLE t (id INT); INSERT INTO t VALUES (1); INSERT INTO t VALUES (2)")
    found = [(n, s.execute("SELECT id FROM t")) for n, s in (("one", one), ("two", two), ("one again", Session.open(spark, root, "one")))]
    return spark.createDataFrame([(n, r.kind, len(r.rows)) for n, r in found], "session string, kind string, n int")


@_query("telemetry", "SELECT 2 AS statements, count(*) AS rows_scanned, 0 AS rows_written, true AS measured FROM nation UNION ALL SELECT 3, 0, 3, true UNION ALL SELECT 1, 0, count(*) + 2, true FROM nation")
def _telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _with_nations(spark, sf_dir)
    read = session.execute("SELECT id FROM t; SELECT name FROM t WHERE id < 0").telemetry
    wrote = session.execute("INSERT INTO t VALUES (100, 'x', 0); INSERT INTO t VALUES (101, 'x', 0); INSERT INTO t VALUES (102, 'x', 0)").telemetry
    session.catalog.compact("t")
    gone = session.execute("DELETE FROM t WHERE id = 100").telemetry
    rows = [
        (t.statements, t.rows_scanned, t.rows_written, t.elapsed_ms > 0 and (t.files_read if t.rows_scanned else t.files_written) > 0 and (t.bytes_read if t.rows_scanned else t.bytes_written) > 0)
        for t in (read, wrote, gone)
    ]
    return spark.createDataFrame(rows, "statements int, rows_scanned bigint, rows_written bigint, measured boolean")


@_query("journal", "SELECT * FROM (VALUES ('APPEND', 'COMMIT', 1), ('CREATE', 'COMMIT', 1), ('DELETE', 'COMMIT', 1), ('INSERT', 'COMMIT', 2), ('INSERT', 'ROLLBACK', 1)) v(operation, status, n)")
def _journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{shared_root(spark)}/granary-workspaces"
    with tempfile.TemporaryDirectory() as folder:  # a journal is the driver's own
        session = Session.open(spark, root, f"w{uuid.uuid4().hex}", journal=f"{folder}/journal.jsonl")
        session.execute("CREATE TABLE t (id INT); INSERT INTO t VALUES (1); INSERT INTO t VALUES (2); DELETE FROM t WHERE id = 1")
        session.execute("INSERT INTO t VALUES ('x')")
        rows = [(x["operation"], x["status"]) for x in session.journal.lines() if x["status"] != "BEGIN"]
    return spark.createDataFrame(rows, "operation string, status string").groupBy("operation", "status").agg(F.count(F.lit(1)).alias("n"))


@_query("concurrent_sessions", "SELECT 't' || s.range || '_' || i.range AS name, CAST(2 AS BIGINT) AS n, CAST(3 AS BIGINT) AS total FROM range(2) s, range(5) i UNION ALL SELECT 'shared', 20, 190")
def _concurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sessions on one workspace, in two threads: tables of their own and one that both change."""
    root, name = f"{shared_root(spark)}/granary-workspaces", f"w{uuid.uuid4().hex}"
    sessions = [Session.open(spark, root, name) for _ in range(2)]
    sessions[0].execute("CREATE TABLE shared (id INT)")
    failed: list[str] = []

    def work(k: int, session: Session) -> None:
        for i in range(5):
            for program in (
                f"CREATE TABLE t{k}_{i} (id INT)", f"INSERT INTO t{k}_{i} VALUES (1); INSERT INTO t{k}_{i} VALUES (2)", f"INSERT INTO t{k}_{i} VALUES (3)",
                f"INSERT INTO shared VALUES ({10 * k + 2 * i}); INSERT INTO shared VALUES ({10 * k + 2 * i + 1}); INSERT INTO shared VALUES ({1000 + k})",
                f"DELETE FROM t{k}_{i} WHERE id = 3; DELETE FROM shared WHERE id = {1000 + k}",
            ):
                found = session.execute(program)
                if found.kind == "error":
                    failed.append(found.message)

    threads = [threading.Thread(target=work, args=x) for x in enumerate(sessions)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    if failed:
        raise RuntimeError(failed[0])
    last = Session.open(spark, root, name)
    found = [last.table(t).agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("n"), F.sum("id").cast("bigint").alias("total")) for t in last.catalog.tables]
    return spark.createDataFrame([tuple(df.first()) for df in found], "name string, n bigint, total bigint")


@_query("deadlock_refused", "SELECT 1 AS refused, 1 AS finished")
def _deadlock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two threads that take two tables' locks in opposite order: one is refused, so the other ends."""
    locks, met, seen = TableLocks(Journal()), threading.Barrier(2), []

    def work(first: str, second: str) -> None:
        try:
            with locks.writing(first):
                met.wait()
                with locks.writing(second):
                    seen.append("finished")
        except DeadlockError:
            seen.append("refused")

    threads = [threading.Thread(target=work, args=x) for x in (("a", "b"), ("b", "a"))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return spark.createDataFrame([(seen.count("refused"), seen.count("finished"))], "refused int, finished int")


@_query("shared_lock", "SELECT 2 AS readers, 1 AS writers, false AS writer_with_readers")
def _shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    lock, seen, both = SharedLock(timeout=0.05), [], threading.Barrier(2)

    def read() -> None:
        with lock.reading():
            both.wait()  # two readers are in at once
            seen.append("reader")

    threads = [threading.Thread(target=read) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    with lock.writing():
        seen.append("writer")
    refused = []

    def write() -> None:
        try:
            with lock.writing():
                refused.append(False)
        except DeadlockError:
            refused.append(True)

    with lock.reading():
        t = threading.Thread(target=write)
        t.start()
        t.join()
    return spark.createDataFrame([(seen.count("reader"), seen.count("writer"), not refused[0])], "readers int, writers int, writer_with_readers boolean")


@_query("inspect_files", "SELECT count(*) AS n, 2 AS files FROM (SELECT * FROM nation UNION ALL SELECT 100, 'x', 0)")
def _inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _with_nations(spark, sf_dir)
    session.execute("INSERT INTO t VALUES (100, 'x', 0)")
    return session.catalog.inspect("t").agg(F.sum("rows").alias("n"), F.count(F.lit(1)).cast("int").alias("files"))


@_query("load_progress", "SELECT 1 AS ends, 0 AS falls, count(*) AS n FROM nation")
def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _workspace(spark)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").collect()]
    path = _csv_file(session, "id,name\n" + "".join(f"{i},{name}\n" for i, name in rows))
    told: list[tuple[int, int]] = []
    session.ingest(path, "made", progress=lambda done, total: told.append((done, total)))
    falls = sum(a[0] > b[0] for a, b in zip(told, told[1:]))
    return spark.createDataFrame([(sum(a == b for a, b in told), falls, told[-1][0])], "ends int, falls int, n bigint")


@_query("sort_stats", "SELECT count(*) AS n, true AS has_runs, 0 AS bytes_spilled FROM lineitem")
def _sort_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Session.over(spark, sf_dir).table("lineitem").select("l_orderkey", "l_shipdate")
    stats = ordering.sorted_with_stats(rows, "l_shipdate", "l_orderkey")[1]
    return spark.createDataFrame([(stats["rows"], stats["runs"] > 0, stats["bytes_spilled"])], "n bigint, has_runs boolean, bytes_spilled bigint")


@_query("rectangles", "SELECT * FROM (VALUES (0, 5.0, 12.0), (1, 0.0, 12.0), (2, 2.0, 12.0)) v(id, mindist, area)")
def _rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points against the rectangle from (0, 0) to (3, 4)."""
    points = spark.createDataFrame([(0, 6.0, 8.0), (1, 1.0, 1.0), (2, -2.0, 2.0)], "id int, x double, y double")
    box = [F.lit(v) for v in (0.0, 0.0, 3.0, 4.0)]
    return points.select("id", spatial.mindist(F.col("x"), F.col("y"), *box).alias("mindist"), spatial.area(*box).alias("area"))


@_query("prune_stats", f"SELECT count(*) AS n, 0 AS lost, true AS skips FROM {SUPPLIER}")
def _prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row groups of a spatial layout that a radius search must read: none of the others holds a hit."""
    session = _workspace(spark)
    session._create(_parsed("CREATE TABLE p (id INT, x FLOAT, y FLOAT) INDEX (RTREE x)"))
    points = _session(spark, sf_dir).table("supplier_points").selectExpr("CAST(s_suppkey AS INT) AS id", "CAST(px AS FLOAT) AS x", "CAST(py AS FLOAT) AS y").collect()
    rows = [tuple(r) for r in points]
    rows.sort(key=lambda r: r[2])
    for i in range(0, len(rows), max(1, len(rows) // 5)):
        session.catalog.append_values("p", rows[i : i + max(1, len(rows) // 5)])
    near = Near((Name("x"), Name("y")), 10.0, 50.0, radius=20.0)
    groups = spatial.needed(session.catalog.row_groups("p", ("x", "y")), near, "x", "y")
    n, read = groups.agg(F.sum("rows"), F.sum(F.when(F.col("needed"), F.col("rows")))).first()
    hits = session.sql_df("SELECT id FROM p WHERE (x, y) IN (POINT(10, 50), RADIUS 20)").count()
    return spark.createDataFrame([(n, int(hits > (read or 0)), (read or 0) < n)], "n bigint, lost int, skips boolean")


@_query("metrics_csv", "SELECT * FROM (VALUES ('load', 'sorted', 100, CAST(0.5 AS DOUBLE)), ('load', 'hash, \"x\"', 100, 0.25)) v(\"group\", measure, \"rows\", seconds)")
def _metrics_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _workspace(spark)
    path, rows = f"{session.catalog.path}/metrics.csv", [report.Measurement("load", "sorted", 100, 0.5), report.Measurement("load", 'hash, "x"', 100, 0.25)]
    report.write_csv(session.catalog.files, path, rows)
    return spark.createDataFrame([(r.group, r.measure, r.rows, r.seconds) for r in report.read_csv(session.catalog.files, path)], "group string, measure string, rows int, seconds double")


@_query("report", "SELECT * FROM (VALUES ('* load: hash is fastest with 0.25 s.'), ('| sorted | 100 | 0.5 | ' || repeat('█', 40) || ' |'), ('| hash | 100 | 0.25 | ' || repeat('█', 20) || ' |')) v(line)")
def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = _workspace(spark)
    files, path = session.catalog.files, session.catalog.path
    report.write_csv(files, f"{path}/m.csv", [report.Measurement("load", "sorted", 100, 0.5), report.Measurement("load", "hash", 100, 0.25)])
    report.generate(files, [f"{path}/none.csv", f"{path}/m.csv"], f"{path}/report.md")
    lines = [x for x in files.read(f"{path}/report.md").split("\n") if x.startswith("* ") or "█" in x]
    return spark.createDataFrame([(x,) for x in lines], "line string")


_PAGED = [Field("id", "INTEGER"), Field("name", "STRING", 12), Field("far", "BIGINT"), Field("share", "FLOAT")]


def _paged(spark: SparkSession, sf_dir: str) -> tuple[str, int]:
    path = f"{_workspace(spark).catalog.path}/nation.bin"
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("n_nationkey AS id", "n_name AS name", "n_nationkey * 10000000000 AS far", "n_regionkey / 4 AS share")
    return path, pages.write_pages(nations.orderBy("id"), _PAGED, path)


@_query("page_file", "SELECT n_nationkey AS id, substr(n_name, 1, 12) AS name, n_nationkey * 10000000000 AS far, CAST(n_regionkey / 4 AS REAL) AS share FROM nation")
def _page_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, n = _paged(spark, sf_dir)
    return pages.read_pages(spark, path, _PAGED, n)


@_query("page_views", "SELECT * FROM (VALUES ('0', '00 00 00 00 4E 41 54 49 4F 4E 5F 30 00 00 00 00', '....NATION_0....'), ('id', '0', '3'), ('name', '4', '15'), ('far', '16', '23'), ('share', '24', '27')) v(a, b, c)")
def _page_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of a page as it lies there, and where each field lies in a record."""
    path, _ = _paged(spark, sf_dir)
    line = pages.hex_view(spark, path, 0).where("offset = 0").selectExpr("CAST(offset AS STRING) AS a", "hex AS b", "ascii AS c")
    return line.unionByName(pages.byte_map(spark, _PAGED).selectExpr("field AS a", "CAST(first AS STRING) AS b", "CAST(last AS STRING) AS c"))
