"""The library's registered queries, a key for each operator, and the SQL that each must agree with.

Most queries are statements of the dialect over the driver's tables; the rest call the operators behind statements that
write, on tables too large to pass through literals.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Session
from .operators import constraints as C
from .operators import temporal

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
_STORES: dict[int, str] = {}


def session(spark: SparkSession, sf_dir: str) -> Session:
    """A session over the driver's tables. Its store is one folder for each Spark application, below the shared folder."""
    key = id(spark.sparkContext)
    if key not in _STORES:
        shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        _STORES[key] = f"{shared}/epochsql-store-{spark.sparkContext.applicationId}" if shared else ""
    s = Session(spark, _STORES[key] or None)
    _STORES[key] = s.root
    for t in TABLES:
        s.register_parquet(t, f"{sf_dir}/{t}.parquet")
    return s


def statement(name: str, text: str, oracle: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: session(spark, sf_dir).sql(text)
    if oracle:
        ORACLES[name] = oracle


FLAGSHIP = """
2E5TAR n_name, COUNT(*) AS n_orders, SUM(o_totalprice) AS revenue
MEN customer DA5ELY ENTEDAH orders 3ALA c_custkey = o_custkey DA5ELY ENTEDAH nation 3ALA c_nationkey = n_nationkey
LAMA o_totalprice > 1000.0
MAGMO3A B n_name LAKEN COUNT(*) > 1
RATEB B revenue NAZL, n_name 7ADD 20;
"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = session(spark, sf_dir).sql(FLAGSHIP)
    return df.withColumn("revenue", F.round("revenue", 2))


QUERIES["flagship"] = flagship
ORACLES["flagship"] = """
SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey
JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 1000.0 GROUP BY n_name HAVING count(*) > 1
ORDER BY revenue DESC NULLS LAST, n_name LIMIT 20"""

# -- scans, projections, filters
statement("scan_all", "2E5TAR * MEN nation;", "SELECT * FROM nation")
statement("project_cols", "2E5TAR c_custkey, c_name, c_acctbal MEN customer;", "SELECT c_custkey, c_name, c_acctbal FROM customer")
statement("project_qualified_alias", "SELECT customer.c_custkey AS id, customer.c_acctbal AS balance FROM customer;", "SELECT c_custkey AS id, c_acctbal AS balance FROM customer")
statement("filter_eq_str", "2E5TAR c_custkey, c_acctbal MEN customer LAMA c_mktsegment = 'BUILDING';", "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'")
statement("filter_eq_int", "2E5TAR * MEN supplier LAMA s_nationkey = 7;", "SELECT * FROM supplier WHERE s_nationkey = 7")
statement("filter_eq_decimal_eps", "2E5TAR l_orderkey, l_linenumber, l_discount MEN lineitem LAMA l_discount = 0.05;", "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE abs(l_discount - 0.05) < 0.0001")
statement("filter_range", "2E5TAR o_orderkey, o_totalprice MEN orders LAMA o_totalprice >= 1000.0 WE o_totalprice < 50000.0;", "SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice > 1000.0 OR abs(o_totalprice - 1000.0) < 0.0001) AND o_totalprice < 50000.0")
statement("filter_gt_lt", "2E5TAR p_partkey, p_size MEN part LAMA p_size > 10 WE p_size <= 20;", "SELECT p_partkey, p_size FROM part WHERE p_size > 10 AND p_size <= 20")
statement("filter_in", "2E5TAR n_nationkey, n_name MEN nation LAMA n_regionkey FE (1, 3);", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3)")
statement("filter_in_decimal", "2E5TAR l_orderkey, l_linenumber MEN lineitem LAMA l_tax IN (0.02, 0.04);", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE abs(l_tax - 0.02) < 0.0001 OR abs(l_tax - 0.04) < 0.0001")
statement("filter_bool_left_assoc", "2E5TAR c_custkey MEN customer LAMA c_mktsegment = 'BUILDING' AW c_nationkey = 3 WE c_acctbal > 0.0;", "SELECT c_custkey FROM customer WHERE ((c_mktsegment = 'BUILDING' OR c_nationkey = 3) AND c_acctbal > 0.0)")
statement("filter_parentheses", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR (c_nationkey = 3 AND c_acctbal > 0.0);", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR (c_nationkey = 3 AND c_acctbal > 0.0)")
statement("filter_neq", "SELECT o_orderkey FROM orders WHERE o_orderstatus != 'F';", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
statement("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a_e%';", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a_e%'")
statement("filter_not_between", "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 10 AND 40;", "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 10 AND 40")
statement("filter_is_null", "SELECT event_id FROM events WHERE NOT value IS NULL;", "SELECT event_id FROM events WHERE value IS NOT NULL")
statement("filter_column_vs_column", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > l_tax;", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > l_tax")
statement("filter_timestamp", "SELECT o_orderkey FROM orders WHERE o_orderdate >= '1996-01-01';", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'")
statement("index_point_lookup", "2E5TAR o_orderkey, o_totalprice MEN orders LAMA o_orderkey = 7;", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7")

# -- aggregates
statement("agg_count_star", "2E5TAR COUNT(*) AS n MEN lineitem;", "SELECT count(*) AS n FROM lineitem")
statement("agg_count_col", "2E5TAR 3ADD(value) AS n MEN events;", "SELECT count(value) AS n FROM events")
statement("agg_count_distinct", "SELECT COUNT(DISTINCT o_custkey) AS n FROM orders;", "SELECT count(DISTINCT o_custkey) AS n FROM orders")
statement("agg_sum", "2E5TAR MAG3MO3(p_size) AS total MEN part;", "SELECT sum(p_size)::BIGINT AS total FROM part")
statement("agg_min", "2E5TAR ASGAR(o_totalprice) AS low MEN orders;", "SELECT min(o_totalprice) AS low FROM orders")
statement("agg_max", "2E5TAR AKBAR(o_orderdate) AS last MEN orders;", "SELECT max(o_orderdate) AS last FROM orders")


def _rounded(name: str, text: str, columns: list[str], oracle: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: session(spark, sf_dir).sql(text).withColumns({c: F.round(c, 4) for c in columns})
    ORACLES[name] = oracle


_rounded("agg_avg", "2E5TAR MOTOWASET(p_size) AS mean MEN part;", ["mean"], "SELECT round(avg(p_size), 4) AS mean FROM part")
statement("group_by_one", "2E5TAR c_mktsegment, COUNT(*) AS n MEN customer MAGMO3A B c_mktsegment;", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
_rounded("group_by_multi", "2E5TAR l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS qty MEN lineitem MAGMO3A B l_returnflag, l_linestatus;", ["qty"], "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS qty FROM lineitem GROUP BY l_returnflag, l_linestatus")
statement("group_by_only", "SELECT o_orderpriority FROM orders GROUP BY o_orderpriority;", "SELECT o_orderpriority FROM orders GROUP BY o_orderpriority")
statement("having_count", "2E5TAR o_custkey, COUNT(*) AS n MEN orders MAGMO3A B o_custkey LAKEN COUNT(*) > 12;", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
_rounded("having_avg", "2E5TAR c_nationkey, AVG(c_acctbal) AS mean MEN customer MAGMO3A B c_nationkey ETHA AVG(c_acctbal) > 4500.0;", ["mean"], "SELECT c_nationkey, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY c_nationkey HAVING avg(c_acctbal) > 4500.0")

# -- joins
statement("join_inner", "2E5TAR customer.c_custkey, nation.n_name MEN customer DA5ELY ENTEDAH nation 3ALA customer.c_nationkey = nation.n_nationkey;", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
statement("join_left", "2E5TAR c_custkey, o_orderkey MEN customer SHMAL ENTEDAH orders 3ALA c_custkey = o_custkey;", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
statement("join_right", "2E5TAR s_suppkey, n_name MEN supplier YAMEN ENTEDAH nation 3ALA s_nationkey = n_nationkey;", "SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
statement("join_full", "SELECT s_suppkey, c_custkey FROM supplier FULL OUTER JOIN customer ON s_suppkey = c_custkey;", "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey")
statement("join_cross", "2E5TAR r_name, n_name MEN region TAQATE3 ENTEDAH nation;", "SELECT r_name, n_name FROM region CROSS JOIN nation")
statement("join_theta_lt", "2E5TAR a.n_name AS low, b.n_name AS high MEN nation a ENTEDAH nation b 3ALA a.n_nationkey < b.n_nationkey;", "SELECT a.n_name AS low, b.n_name AS high FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
statement("join_theta_ge", "SELECT r.r_name AS r, n.n_name AS n FROM region r JOIN nation n ON r.r_regionkey >= n.n_regionkey;", "SELECT r_name AS r, n_name AS n FROM region JOIN nation ON r_regionkey >= n_regionkey")
statement("join_theta_neq", "SELECT r.r_name AS r, n.n_name AS n FROM region r JOIN nation n ON r.r_regionkey != n.n_regionkey;", "SELECT r_name AS r, n_name AS n FROM region JOIN nation ON r_regionkey <> n_regionkey")
statement("join_multi_condition", "SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey;", "SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey")
statement("join_multiway", "2E5TAR r_name, COUNT(*) AS n MEN customer ENTEDAH nation 3ALA c_nationkey = n_nationkey ENTEDAH region 3ALA n_regionkey = r_regionkey MAGMO3A B r_name;", "SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
statement("join_self", "SELECT a.s_suppkey AS s1, b.s_suppkey AS s2 FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE a.s_suppkey < b.s_suppkey;", "SELECT a.s_suppkey AS s1, b.s_suppkey AS s2 FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE a.s_suppkey < b.s_suppkey")

# -- order, limit, distinct
statement("order_asc", "2E5TAR n_nationkey, n_name MEN nation RATEB B n_name TALE3;", "SELECT n_nationkey, n_name FROM nation ORDER BY n_name")
statement("order_desc", "2E5TAR n_nationkey, n_name MEN nation RATEB B n_nationkey NAZL;", "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey DESC")
statement("order_multi", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey;", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey")
statement("order_unprojected", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25;", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 25")
statement("limit", "2E5TAR o_orderkey MEN orders RATEB B o_orderkey 7ADD 10;", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10")
statement("limit_offset", "2E5TAR o_orderkey MEN orders RATEB B o_orderkey 7ADD 10 EBDA2MEN 20;", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20")
statement("offset_beyond_end", "SELECT n_name FROM nation ORDER BY n_name LIMIT 10 OFFSET 1000;", "SELECT n_name FROM nation ORDER BY n_name LIMIT 10 OFFSET 1000")
statement("top_k", "2E5TAR o_orderkey, o_totalprice MEN orders RATEB B o_totalprice NAZL, o_orderkey 7ADD 15;", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 15")
statement("distinct", "2E5TAR MOTA3MEZ c_mktsegment MEN customer;", "SELECT DISTINCT c_mktsegment FROM customer")
statement("distinct_multi", "2E5TAR MOTA3MEZ l_returnflag, l_linestatus MEN lineitem RATEB B l_returnflag, l_linestatus NAZL;", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem ORDER BY l_returnflag, l_linestatus DESC")

# -- time travel: events as a change log of users; an error ends a user's row, any other event is its new version
EVENT_COLUMNS = ("event_id", "ts", "user_id", "event_type", "value")
MIDDLE = "2024-01-15 12:00:00"


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(*EVENT_COLUMNS)
    return temporal.log_from_events(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error")


def event_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(*EVENT_COLUMNS)
    return temporal.states_from_events(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error")


def _at(moment: str, later: bool = False):
    ts = F.lit(moment).cast("timestamp_ntz")
    return F.col("_ts") > ts if later else F.col("_ts") <= ts


def _forward(moment: str) -> Query:
    return lambda spark, sf_dir: temporal.forward(event_states(spark, sf_dir), _at(moment)).select("row.*")


def _reverse(moment: str) -> Query:
    def run(spark, sf_dir):
        live = temporal.forward(event_states(spark, sf_dir), F.lit(True))
        return temporal.reverse(live, event_log(spark, sf_dir), _at(moment, later=True)).select("row.*")

    return run


def _auto(moment: str) -> Query:
    def run(spark, sf_dir):
        ts = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("ts") <= F.lit(moment).cast("timestamp_ntz")).alias("before"))
        n = dict(ts.groupBy("before").count().collect())
        way = temporal.choose(n.get(True, 0), n.get(False, 0))
        return (_forward if way == "forward" else _reverse)(moment)(spark, sf_dir)

    return run


def _as_of_sql(moment: str) -> str:
    return f"""SELECT event_id, ts, user_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE ts <= TIMESTAMP '{moment}')
WHERE r = 1 AND event_type <> 'error'"""


for _name, _make, _moment in (("as_of_forward", _forward, MIDDLE), ("as_of_reverse", _reverse, MIDDLE), ("as_of_auto", _auto, "2024-01-25 00:00:00"), ("as_of_before_start", _reverse, "2000-01-01 00:00:00"), ("as_of_future", _forward, "2100-01-01 00:00:00")):
    QUERIES[_name], ORACLES[_name] = _make(_moment), _as_of_sql(_moment)


def recover_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live rows after the changes of RECOVER TO are applied to them."""
    log = event_states(spark, sf_dir)
    now = temporal.forward(log, F.lit(True))
    change = temporal.diff(now, temporal.forward(log, _at(MIDDLE)))
    return now.join(change.select("_rid"), "_rid", "left_anti").select("row.*").unionByName(change.where("_op != 'D'").select("row.*"))


QUERIES["recover_to"], ORACLES["recover_to"] = recover_to, _as_of_sql(MIDDLE)


def row_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.history(event_log(spark, sf_dir)).select("row.event_id", F.col("_from").alias("valid_from"), F.col("_to").alias("valid_to"))


QUERIES["row_history"] = row_history
ORACLES["row_history"] = """SELECT event_id, ts AS valid_from, valid_to FROM (
  SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events) WHERE event_type <> 'error'"""

# -- writes: a table of the store, filled from the driver's tables by INSERT ... SELECT


def _loaded(spark: SparkSession, sf_dir: str) -> Session:
    s = session(spark, sf_dir)
    if "cust" in s.db.tables():
        s.execute("DELETE TABLE cust;")
    s.execute("CREATE TABLE cust (id INT PRIMARY KEY, name STRING(100) NOT NULL, nation INT, balance DECIMAL, segment STRING(40));")
    s.execute("INSERT INTO cust SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer;")
    return s


_CUST = "SELECT c_custkey::INTEGER AS id, c_name AS name, c_nationkey AS nation, {b} AS balance, {s} AS segment FROM customer {w}"


def _write(name: str, statements: list[str], oracle: str, then: str = "SELECT * FROM cust;") -> None:
    def run(spark, sf_dir):
        s = _loaded(spark, sf_dir)
        for x in statements:
            s.execute(x)
        return s.sql(then)

    QUERIES[name], ORACLES[name] = run, oracle


_write("insert_visible", ["EMLA GOWA cust ELKEYAM (1000001, 'New', 3, 5.5, 'NONE');"], _CUST.format(b="c_acctbal", s="c_mktsegment", w="") + " UNION ALL SELECT 1000001, 'New', 3, 5.5, 'NONE'")
_write("update_result", ["3ADEL GOWA cust 5ALY balance = 0.0 LAMA segment = 'BUILDING';"], _CUST.format(b="CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0 ELSE c_acctbal END", s="c_mktsegment", w=""))
_write("delete_result", ["2EMSA7 MEN cust LAMA balance < 0.0;"], _CUST.format(b="c_acctbal", s="c_mktsegment", w="WHERE NOT c_acctbal < 0.0"))
_write("txn_commit", ["2EBDA2;", "UPDATE cust SET segment = 'X' WHERE nation = 3;", "DELETE FROM cust WHERE nation = 4;", "2AKED;"], _CUST.format(b="c_acctbal", s="CASE WHEN c_nationkey = 3 THEN 'X' ELSE c_mktsegment END", w="WHERE c_nationkey <> 4"))
_write("txn_rollback", ["BEGIN;", "UPDATE cust SET segment = 'X' WHERE nation = 3;", "DELETE FROM cust WHERE nation = 4;", "2ERGA3;"], _CUST.format(b="c_acctbal", s="c_mktsegment", w=""))
_write("txn_own_changes", ["BEGIN;", "DELETE FROM cust WHERE nation = 4;"], "SELECT count(*) AS n FROM customer WHERE c_nationkey <> 4", "SELECT COUNT(*) AS n FROM cust;")


def _time_travel(name: str, strategy: str) -> None:
    def run(spark, sf_dir):
        s = _loaded(spark, sf_dir)
        ts = s.db.commits()[s.db.head()]["ts"]
        s.execute("UPDATE cust SET balance = 0.0 WHERE nation = 3;")
        s.execute("DELETE FROM cust WHERE nation = 5;")
        if strategy == "sql":
            return s.sql(f"SELECT * FROM cust AS OF {ts};")
        if strategy == "recover":
            s.execute(f"RECOVER TO {ts};")
            return s.sql("SELECT * FROM cust;")
        if strategy == "checkpoint":
            s.execute("CHECKPOINT;")
            s.execute("DELETE FROM cust WHERE nation = 6;")
            return s.sql(f"SELECT * FROM cust AS OF {ts};")
        return s.db.as_of("cust", ts, strategy).select("row.*")

    QUERIES[name], ORACLES[name] = run, _CUST.format(b="c_acctbal", s="c_mktsegment", w="")


for _s in ("sql", "forward", "reverse", "recover", "checkpoint"):
    _time_travel(f"store_as_of_{_s}" if _s != "recover" else "store_recover", _s)

# -- constraints
QUERIES["fk_violations"] = lambda spark, d: C.orphans(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey"), ["c_custkey"], spark.read.parquet(f"{d}/orders.parquet"), ["o_custkey"])
ORACLES["fk_violations"] = "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)"
QUERIES["pk_duplicates"] = lambda spark, d: C.duplicates(spark.read.parquet(f"{d}/lineitem.parquet"), ["l_orderkey", "l_partkey"])
ORACLES["pk_duplicates"] = "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1"
QUERIES["unique_against_live"] = lambda spark, d: C.already_there(spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("c_custkey")), spark.read.parquet(f"{d}/customer.parquet"), ["c_custkey"])
ORACLES["unique_against_live"] = "SELECT s_suppkey AS c_custkey FROM supplier WHERE s_suppkey IN (SELECT c_custkey FROM customer)"
QUERIES["check_violations"] = lambda spark, d: C.failing(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_acctbal"), F.col("c_acctbal") >= 0)
ORACLES["check_violations"] = "SELECT c_custkey, c_acctbal FROM customer WHERE NOT c_acctbal >= 0"
QUERIES["not_null_violations"] = lambda spark, d: C.not_null(spark.read.parquet(f"{d}/customer.parquet").join(spark.read.parquet(f"{d}/orders.parquet"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey"), ["o_orderkey"])
ORACLES["not_null_violations"] = "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL"
QUERIES["default_fill"] = lambda spark, d: C.fill_defaults(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("status")), {"status": F.lit("none")})
ORACLES["default_fill"] = "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus ELSE 'none' END AS status FROM orders"


def auto_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.lit(None).cast("long").alias("id"), "o_orderkey")
    return C.auto_increment(rows, "id", 100, ["o_orderkey"], f"{session(spark, sf_dir).root}/scratch/{uuid.uuid4().hex}")


QUERIES["auto_increment"] = auto_increment
ORACLES["auto_increment"] = "SELECT 100 + row_number() OVER (ORDER BY o_orderkey) AS id, o_orderkey FROM orders"


def fk_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parent's deletion takes its children along."""
    s = session(spark, sf_dir)
    for t in ("child", "parent"):
        if t in s.db.tables():
            s.execute(f"DELETE TABLE {t};")
    s.execute("CREATE TABLE parent (id INT PRIMARY KEY, name STRING);")
    s.execute("CREATE TABLE child (id INT PRIMARY KEY, p INT, FOREIGN KEY (p) REFERENCES parent (id) ON DELETE CASCADE);")
    s.execute("INSERT INTO parent SELECT r_regionkey, r_name FROM region;")
    s.execute("INSERT INTO child SELECT n_nationkey, n_regionkey FROM nation;")
    s.execute("DELETE FROM parent WHERE id = 2;")
    return s.sql("SELECT * FROM child;")


QUERIES["fk_cascade"], ORACLES["fk_cascade"] = fk_cascade, "SELECT n_nationkey AS id, n_regionkey AS p FROM nation WHERE n_regionkey <> 2"

_write("update_expression", ["UPDATE cust SET balance = balance * 2 - 10, nation = nation + 1 WHERE segment = 'BUILDING';"], _CUST.format(b="CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal * 2 - 10 ELSE c_acctbal END", s="c_mktsegment", w="").replace("c_nationkey AS nation", "CASE WHEN c_mktsegment = 'BUILDING' THEN c_nationkey + 1 ELSE c_nationkey END AS nation"))
_write("update_casts", ["UPDATE cust SET balance = 7, name = 'n' WHERE nation = 3;"], "SELECT c_custkey::INTEGER AS id, CASE WHEN c_nationkey = 3 THEN 'n' ELSE c_name END AS name, c_nationkey AS nation, CASE WHEN c_nationkey = 3 THEN 7.0 ELSE c_acctbal END AS balance, c_mktsegment AS segment FROM customer")
_write("truncate_table", ["TRUNCATE TABLE cust;"], "SELECT 0::BIGINT AS n", "SELECT COUNT(*) AS n FROM cust;")
_write("recover_latest", ["DELETE FROM cust WHERE nation = 3;", "RECOVER TO LATEST;"], _CUST.format(b="c_acctbal", s="c_mktsegment", w="WHERE c_nationkey <> 3"))
_write("alter_add_column", ["ALTER TABLE cust ADD COLUMN grade INT DEFAULT 5;", "UPDATE cust SET grade = grade + nation WHERE nation = 3;"], "SELECT c_custkey::INTEGER AS id, CASE WHEN c_nationkey = 3 THEN 8 ELSE 5 END AS grade FROM customer", "SELECT id, grade FROM cust;")
_write("alter_drop_column", ["ALTER TABLE cust DROP COLUMN balance;"], "SELECT c_custkey::INTEGER AS id, c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer")
_write("alter_rename_column", ["ALTER TABLE cust RENAME COLUMN balance TO money;", "UPDATE cust SET money = 1.5 WHERE nation = 3;"], "SELECT c_custkey::INTEGER AS id, CASE WHEN c_nationkey = 3 THEN 1.5 ELSE c_acctbal END AS money FROM customer", "SELECT id, money FROM cust;")
_write("checkpoint_and_vacuum", ["BEGIN;", "DELETE FROM cust;", "ROLLBACK;", "CHECKPOINT;", "VACUUM cust;", "DELETE FROM cust WHERE nation = 3;"], _CUST.format(b="c_acctbal", s="c_mktsegment", w="WHERE c_nationkey <> 3"))


def create_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session(spark, sf_dir)
    if "rich" in s.db.views():
        s.execute("DROP VIEW rich;")
    s.execute("CREATE VIEW rich AS SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 5000.0;")
    return s.sql("SELECT n_name, COUNT(*) AS n FROM rich JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name;")


QUERIES["create_view"] = create_view
ORACLES["create_view"] = "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000.0 GROUP BY n_name"


def _past(name: str, text: str, oracle: str) -> None:
    """A SELECT over the past of a table that has been changed since; {ts} is the moment before the changes."""

    def run(spark, sf_dir):
        s = _loaded(spark, sf_dir)
        ts = s.db.commits()[s.db.head()]["ts"]
        s.execute("UPDATE cust SET balance = 0.0 WHERE nation = 3;")
        s.execute("DELETE FROM cust WHERE nation = 5;")
        return s.sql(text.format(ts=ts))

    QUERIES[name], ORACLES[name] = run, oracle


_past("as_of_where", "SELECT id, balance FROM cust AS OF {ts} WHERE balance > 100.0 AND nation = 3;", "SELECT c_custkey::INTEGER AS id, c_acctbal AS balance FROM customer WHERE c_acctbal > 100.0 AND c_nationkey = 3")
_past("as_of_join", "SELECT a.id AS id, b.name AS name FROM cust a AS OF {ts} JOIN cust b ON a.id = b.id WHERE a.nation = 5;", "SELECT c_custkey::INTEGER AS id, c_name AS name FROM customer WHERE c_nationkey = 5")
_past("as_of_group", "SELECT nation, COUNT(*) AS n FROM cust AS OF {ts} GROUP BY nation HAVING COUNT(*) > 1;", "SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 1")
statement("select_all_keyword", "2E5TAR KOL r_name MEN region;", "SELECT r_name FROM region")
statement("filter_date_forms", "SELECT o_orderkey FROM orders WHERE o_orderdate < '1996-01-01 00:00:00' AND o_orderdate BETWEEN '1995-06-01' AND '1995-12-31';", "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' AND o_orderdate BETWEEN TIMESTAMP '1995-06-01' AND TIMESTAMP '1995-12-31'")
statement("analyze_table", "ANALYZE TABLE nation;", """SELECT * FROM (VALUES
  ('n_nationkey', (SELECT count(*) FROM nation), (SELECT count(*) - count(n_nationkey) FROM nation), (SELECT count(DISTINCT n_nationkey) FROM nation), (SELECT min(n_nationkey)::VARCHAR FROM nation), (SELECT max(n_nationkey)::VARCHAR FROM nation)),
  ('n_name', (SELECT count(*) FROM nation), (SELECT count(*) - count(n_name) FROM nation), (SELECT count(DISTINCT n_name) FROM nation), (SELECT min(n_name) FROM nation), (SELECT max(n_name) FROM nation)),
  ('n_regionkey', (SELECT count(*) FROM nation), (SELECT count(*) - count(n_regionkey) FROM nation), (SELECT count(DISTINCT n_regionkey) FROM nation), (SELECT min(n_regionkey)::VARCHAR FROM nation), (SELECT max(n_regionkey)::VARCHAR FROM nation))
) t("Column", "Rows", "Nulls", "Distinct", "Min", "Max")""")

# -- catalog: fixed tables in a database of their own, so that nothing else is listed


def _catalog(name: str, text: str, oracle: str) -> None:
    def run(spark, sf_dir):
        s = session(spark, sf_dir)
        s.external.clear()
        if not s.db.files.exists(f"{s.root}/catalog/database.json"):
            s.execute("CREATE DATABASE catalog;")
        s.use("catalog")
        if "item" not in s.db.tables():
            s.execute("CREATE TABLE kind (id INT PRIMARY KEY, name STRING(20) UNIQUE NOT NULL);")
            s.execute("CREATE TABLE item (id INT PRIMARY KEY AUTO_INCREMENT, kind INT REFERENCES kind (id) ON DELETE CASCADE, price DECIMAL DEFAULT 1.5 CHECK (price > 0), made DATE);")
        if "clerk" not in s.users.all():
            s.execute("CREATE USER clerk PASS secret ROLE READONLY;")
        return s.sql(text)

    QUERIES[name], ORACLES[name] = run, oracle


_catalog("describe_table", "WASF item;", """SELECT * FROM (VALUES ('id', 'INTEGER', 'NO', 'PRI', '', 'auto_increment'), ('kind', 'INTEGER', 'YES', '', '', ''), ('price', 'DECIMAL', 'YES', '', '1.5', ''), ('made', 'TIMESTAMP', 'YES', '', '', ''))
t("Column", "Type", "Nullable", "Key", "Default", "Extra")""")
_catalog("show_create_table", "SHOW CREATE TABLE item;", """SELECT 'item' AS "Table", 'CREATE TABLE `item` (' || chr(10) || '  `id` INTEGER NOT NULL AUTO_INCREMENT,' || chr(10) || '  `kind` INTEGER,' || chr(10) || '  `price` DECIMAL DEFAULT 1.5 CHECK (price > 0),' || chr(10)
|| '  `made` TIMESTAMP,' || chr(10) || '  PRIMARY KEY (`id`),' || chr(10) || '  FOREIGN KEY (`kind`) REFERENCES `kind` (`id`) ON DELETE CASCADE ON UPDATE RESTRICT' || chr(10) || ');' AS "Create Table" """)
_catalog("show_tables", "WARENY TABLES;", """SELECT * FROM (VALUES ('item'), ('kind')) t("Tables_in_catalog")""")
_catalog("show_databases", "WARENY DATABASES;", """SELECT * FROM (VALUES ('catalog'), ('main')) t("Database")""")
_catalog("show_users", "WARENY USERS;", """SELECT * FROM (VALUES ('clerk', 'catalog:READONLY'), ('root', '*:SUPERADMIN')) t("Username", "Roles")""")
_catalog("show_status", "WARENY STATUS;", """SELECT * FROM (VALUES ('Current User', 'root'), ('Current Database', 'catalog'), ('Current Role', 'SUPERADMIN'), ('Authenticated', 'Yes')) t("Variable", "Value")""")
_catalog("whoami", "ANAMEEN;", """SELECT 'root' AS "Current User", 'catalog' AS "Current DB", 'SUPERADMIN' AS "Role" """)
