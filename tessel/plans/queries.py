"""One registered query per operator of the engine, with the DuckDB SQL that says what it returns.

Statements run through Engine, so nulls sort as the greatest value and the engine's own functions apply; a query whose
oracle isn't given is the same text in both dialects.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions import concat_skip_null, div_null, int_div_null, mod_null, register_scalar, substring_strict, trim_space
from tessel.operators import delete_rows, insert_rows, relation, update_rows
from tessel.plans.engine import Engine
from tessel.plans.prompt import answer
from tessel.sources import format_table, parse_config

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(name: str, text: str, oracle: str | None = None) -> None:
    words = set(text.replace("(", " ").replace(")", " ").replace(",", " ").split())

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in TABLES:
            if t in words:
                table(spark, sf_dir, t).createOrReplaceTempView(t)
        return Engine(spark).query(text)

    QUERIES[name], ORACLE[name] = run, oracle or text


def _frame(oracle: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE[f.__name__] = f, oracle
        return f

    return add


FLAGSHIP = "flagship_pricing"
_sql(FLAGSHIP, """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_extendedprice), 2) AS p
FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.08 GROUP BY l_returnflag, l_linestatus HAVING count(*) > 1 ORDER BY l_returnflag, l_linestatus""")

# scans, projections, aliases, filters
_sql("scan_all", "SELECT * FROM nation")
_sql("scan_lineitem_columns", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
_sql("project_expr", "SELECT o_orderkey, o_totalprice * 1.1 AS gross FROM orders")
_sql("qualified_alias", "SELECT o.o_orderkey AS k, o.o_custkey c FROM orders AS o WHERE o.o_custkey < 100")
_sql("filter_cmp", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND l_discount <= 0.05 AND l_tax > 0.01 AND l_returnflag = 'R'")
_sql("filter_ne", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority != '1-URGENT'")
_sql("kleene_logic", """SELECT c_custkey, (a AND b) AS both_true, (a OR b) AS any_true, (NOT a) AS not_a FROM (
SELECT c_custkey, CASE WHEN c_nationkey < 8 THEN true WHEN c_nationkey < 16 THEN false END AS a,
CASE WHEN c_acctbal < 2000 THEN true WHEN c_acctbal < 5000 THEN false END AS b FROM customer) AS t""")
_sql("is_null", "SELECT o_orderkey FROM orders WHERE nullif(o_orderpriority, '5-LOW') IS NULL")
_sql("is_not_null", "SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS p FROM orders WHERE nullif(o_orderpriority, '5-LOW') IS NOT NULL")
_sql("select_without_from", "SELECT 1 AS one, 'a' AS letter")

# arithmetic, conditionals, predicates
_sql("arith_mixed", "SELECT p_partkey, p_size + 1 AS a, p_size * 2 - 3 AS b, p_partkey * 2 AS c, p_retailprice * p_size AS d FROM part")
_sql("unary_minus", "SELECT p_partkey, -p_size AS neg, +p_size AS pos, -(p_retailprice) AS negp FROM part")


@_frame("SELECT l_orderkey, l_linenumber, round(l_quantity / nullif(l_tax, 0), 4) AS ratio FROM lineitem")
def div_by_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(div_null(F.col("l_quantity"), F.col("l_tax")), 4).alias("ratio"))


_sql(
    "div_sql",
    "SELECT p_partkey, p_size / nullif(p_size % 4, 0) AS whole, p_size / 4 AS part, p_retailprice / (p_size - p_size) AS none, 100 - p_size * 2 / 8 + 1 AS mixed, p_size % (p_size % 3) AS rest FROM part",
    "SELECT p_partkey, CAST(p_size // nullif(p_size % 4, 0) AS DOUBLE) AS whole, p_size / 4 AS part, CAST(NULL AS DOUBLE) AS none, 100 - p_size * 2 / 8 + 1 AS mixed, p_size % nullif(p_size % 3, 0) AS rest FROM part",
)


_sql(
    "div_nested",
    "SELECT p_partkey, p_retailprice / p_size / 2 / (p_size / 3.0) AS a, abs(p_size) / abs(p_size % 7) AS b, round(sum(p_size) OVER (PARTITION BY p_brand) / p_size, 6) AS c, p_size::double / 7 AS d, array(p_size, 3)[0] / p_size AS e, \"a/b\" AS f FROM part",
    "SELECT p_partkey, p_retailprice / p_size / 2 / (p_size / 3.0) AS a, CAST(abs(p_size) // nullif(abs(p_size % 7), 0) AS DOUBLE) AS b, round(sum(p_size) OVER (PARTITION BY p_brand) / p_size, 6) AS c, p_size::double / 7 AS d, CAST(1 AS DOUBLE) AS e, 'a/b' AS f FROM part",
)
_sql("div_group", "SELECT abs(p_size) / abs(p_size % 4 + 1) AS k, count(*) AS n, max(p_size) / count(*) AS m FROM part GROUP BY abs(p_size) / abs(p_size % 4 + 1)", "SELECT CAST(abs(p_size) // abs(p_size % 4 + 1) AS DOUBLE) AS k, count(*) AS n, max(p_size) / count(*) AS m FROM part GROUP BY 1")


@_frame("SELECT p_partkey, p_size // 3 AS third, p_size // nullif(p_size % 4, 0) AS by_rest FROM part")
def int_div(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", int_div_null(size, F.lit(3)).cast("int").alias("third"), int_div_null(size, size % 4).cast("int").alias("by_rest"))


@_frame("SELECT p_partkey, p_size % 7 AS a, p_size % nullif(p_size % 3, 0) AS b FROM part")
def modulo_infix(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", (size % 7).alias("a"), mod_null(size, size % 3).alias("b"))


_sql("fn_mod", "SELECT p_partkey, mod(p_size, 5) AS a, mod(p_size, 1) AS b, mod(p_size, p_size - p_size) AS c FROM part", "SELECT p_partkey, p_size % 5 AS a, p_size % 1 AS b, CAST(NULL AS INTEGER) AS c FROM part")
_sql("concat_op", "SELECT n_nationkey, n_name || '-' || CAST(n_regionkey AS STRING) AS tag FROM nation", "SELECT n_nationkey, n_name || '-' || CAST(n_regionkey AS VARCHAR) AS tag FROM nation")
_sql("case_multi", "SELECT p_partkey, CASE WHEN p_retailprice >= 1500 THEN 'high' WHEN p_retailprice >= 1100 THEN 'mid' ELSE 'low' END AS band FROM part")
_sql("case_no_else", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' END AS big FROM part")
_sql("in_int", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (1, 2, 3)")
_sql("not_in_int", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN (1, 2, 3)")
_sql("in_string", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
_sql("not_in_null", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (1, NULL)")
_sql("between_int", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20")
_sql("not_between_double", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice NOT BETWEEN 1000 AND 1400")
_sql("like_prefix", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority LIKE '1%'")
_sql("like_backslash", r"SELECT n_nationkey, n_name || '\1' LIKE '%\1' AS a, n_name LIKE '%\\%' AS b, '50%' LIKE '50\%' AS c FROM nation", r"SELECT n_nationkey, true AS a, false AS b, false AS c FROM nation")
_sql("like_underscore", "SELECT n_nationkey, n_name FROM nation WHERE n_name LIKE '_A%'")
_sql("not_like", "SELECT n_nationkey, n_name FROM nation WHERE n_name NOT LIKE '%1%'")
_sql("coalesce_chain", "SELECT o_orderkey, coalesce(nullif(o_orderpriority, '5-LOW'), nullif(o_orderstatus, 'F'), 'none') AS v FROM orders")
_sql("nullif_int", "SELECT p_partkey, nullif(p_size, 5) AS v FROM part")
_sql("cast_try", "SELECT o_orderkey, try_cast(substring(o_orderpriority, 1, 1) AS INT) AS n, try_cast(o_orderpriority AS INT) AS bad FROM orders")

# functions
_sql("fn_length", "SELECT doc_id, length(lang) AS n, length(text) AS characters FROM documents")
_sql("fn_upper_lower", "SELECT n_nationkey, upper(n_name) AS u, lower(n_name) AS l FROM nation")


@_frame("SELECT n_nationkey, n_name AS t FROM nation")
def fn_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit(" \t\n"), F.col("n_name"), F.lit("\r\f\v "))
    return table(spark, sf_dir, "nation").select("n_nationkey", trim_space(padded).alias("t"))


@_frame("SELECT n_nationkey, substring(n_name, 2, 3) AS a, substring(n_name, 3) AS b, CAST(NULL AS VARCHAR) AS c, substring(n_name, 90, 2) AS d FROM nation")
def fn_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("n_name")
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", substring_strict(name, 2, 3).alias("a"), substring_strict(name, 3).alias("b"), substring_strict(name, 0, 2).alias("c"), substring_strict(name, 90, 2).alias("d")
    )


@_frame("SELECT c_custkey, concat(c_mktsegment, nullif(c_nationkey, 3), '!') AS t, CASE WHEN c_nationkey <> 3 THEN CAST(c_nationkey AS VARCHAR) END AS u FROM customer")
def fn_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.nullif(F.col("c_nationkey"), F.lit(3))
    return table(spark, sf_dir, "customer").select("c_custkey", concat_skip_null(F.col("c_mktsegment"), key, F.lit("!")).alias("t"), concat_skip_null(key, F.lit(None).cast("string")).alias("u"))


_sql(
    "fn_concat_sql",
    "SELECT c_custkey, concat(c_mktsegment, nullif(c_nationkey, 3), '!') AS t, concat(nullif(c_nationkey, 3), CAST(NULL AS STRING)) AS u FROM customer",
    "SELECT c_custkey, concat(c_mktsegment, nullif(c_nationkey, 3), '!') AS t, CASE WHEN c_nationkey <> 3 THEN CAST(c_nationkey AS VARCHAR) END AS u FROM customer",
)
_sql("fn_trim_forms", "SELECT n_nationkey, trim(both 'N' from n_name) AS a, trim('  ' || n_name || ' ') AS b FROM nation", "SELECT n_nationkey, trim(n_name, 'N') AS a, n_name AS b FROM nation")
_sql("fn_abs", "SELECT c_custkey, abs(c_acctbal) AS a, abs(c_nationkey - 12) AS b FROM customer")
_sql("fn_round", "SELECT c_custkey, round(c_acctbal) AS a, round(c_acctbal, 1) AS b, round(c_acctbal, -2) AS c FROM customer", "SELECT c_custkey, round(c_acctbal) + 0.0 AS a, round(c_acctbal, 1) + 0.0 AS b, round(c_acctbal, -2) + 0.0 AS c FROM customer")
_sql("fn_ceil_floor", "SELECT c_custkey, ceil(c_acctbal) AS c, floor(c_acctbal) AS f FROM customer", "SELECT c_custkey, CAST(ceil(c_acctbal) AS BIGINT) AS c, CAST(floor(c_acctbal) AS BIGINT) AS f FROM customer")


@_frame("SELECT p_partkey, round(p_retailprice * 0.9, 2) AS reduced FROM part")
def udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_scalar(spark, "reduced_price", "x DOUBLE", "DOUBLE", "round(x * 0.9, 2)")
    return table(spark, sf_dir, "part").selectExpr("p_partkey", "reduced_price(p_retailprice) AS reduced")


# joins
_sql("cross_join", "SELECT r_name, n_name FROM region CROSS JOIN nation")
_sql("comma_join_where", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
_sql("inner_equi", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
_sql("inner_theta", "SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey < n_nationkey")
_sql("left_join", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
_sql("right_join", "SELECT l.toxic, d.doc_id FROM labels l RIGHT JOIN documents d ON d.doc_id = l.doc_id")
_sql("join_three", """SELECT l.l_orderkey, l.l_linenumber, c.c_name FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING'""")
_sql("self_join", "SELECT a.n_name AS first_name, b.n_name AS second_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
_sql("join_group_having", """SELECT n.n_name, count(*) AS n_orders, round(sum(o.o_totalprice), 2) AS revenue FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name HAVING count(*) > 10 ORDER BY n.n_name""")
_sql("join_order_limit", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 20")


@_frame("SELECT r.r_name, count(*) AS n FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name HAVING count(*) > 1")
def relation_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = relation(table(spark, sf_dir, "nation"), "n"), relation(table(spark, sf_dir, "region"), "r")
    return nation.join(region, "n.n_regionkey = r.r_regionkey").group("r_name", n="count(*)", having="n > 1").df


# aggregation
_AGGREGATES = "count(*) AS n, count(l_tax) AS n_tax, count(DISTINCT l_suppkey) AS n_supp, round(sum(l_quantity), 2) AS s, round(avg(l_quantity), 4) AS a, min(l_shipdate) AS lo, max(l_extendedprice) AS hi"
_sql("agg_global", f"SELECT {_AGGREGATES} FROM lineitem")
_sql("agg_empty", "SELECT count(*) AS n, sum(l_quantity) AS s, avg(l_quantity) AS a, min(l_quantity) AS lo, max(l_returnflag) AS hi FROM lineitem WHERE 1 = 0")
_sql("count_distinct", "SELECT count(DISTINCT o_custkey) AS n, count(DISTINCT o_orderstatus) AS m FROM orders")
_sql("sum_distinct", "SELECT sum(DISTINCT p_size) AS s, round(avg(DISTINCT p_size), 4) AS a FROM part", "SELECT CAST(sum(DISTINCT p_size) AS BIGINT) AS s, round(avg(DISTINCT p_size), 4) AS a FROM part")
_sql("min_max_distinct", "SELECT min(DISTINCT p_size) AS lo, max(DISTINCT p_brand) AS hi FROM part")
_sql("sum_int", "SELECT p_brand, sum(p_size) AS s FROM part GROUP BY p_brand", "SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS s FROM part GROUP BY p_brand")
_sql("group_one", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
_sql("group_multi", f"SELECT l_returnflag, l_linestatus, {_AGGREGATES} FROM lineitem GROUP BY l_returnflag, l_linestatus")
_sql("group_null_key", "SELECT nullif(o_orderpriority, '5-LOW') AS k, count(*) AS n FROM orders GROUP BY nullif(o_orderpriority, '5-LOW')")
_sql("group_expr", "SELECT p_size % 5 AS k, count(*) AS n FROM part GROUP BY p_size % 5")
_sql("having_count", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
_sql("having_sum", "SELECT o_custkey, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 1000000")
_sql("agg_arith", "SELECT l_returnflag, round(sum(l_extendedprice) / count(*), 2) AS mean, round(try_divide(sum(l_tax), sum(l_tax) - sum(l_tax)), 2) AS none FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(sum(l_extendedprice) / count(*), 2) AS mean, CAST(NULL AS DOUBLE) AS none FROM lineitem GROUP BY l_returnflag")
_sql("case_in_agg", "SELECT l_returnflag, count(CASE WHEN l_quantity > 25 THEN 1 END) AS big, CASE WHEN count(*) > 100 THEN 'many' ELSE 'few' END AS size FROM lineitem GROUP BY l_returnflag")
_sql("fn_over_group", "SELECT lower(o_orderpriority) AS k, coalesce(sum(nullif(o_custkey, o_custkey)), 0) AS z FROM orders GROUP BY o_orderpriority", "SELECT lower(o_orderpriority) AS k, CAST(coalesce(sum(nullif(o_custkey, o_custkey)), 0) AS BIGINT) AS z FROM orders GROUP BY o_orderpriority")

# order, limit, distinct
_sql("order_limit", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 25")
_sql("order_asc_nulls", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders ORDER BY s, o_orderkey LIMIT 40", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders ORDER BY s NULLS LAST, o_orderkey LIMIT 40")
_sql("order_desc_nulls", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders ORDER BY s DESC, o_orderkey LIMIT 40", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders ORDER BY s DESC NULLS FIRST, o_orderkey LIMIT 40")
_sql("order_alias", "SELECT p_partkey AS k, p_size AS s FROM part ORDER BY s DESC, k LIMIT 10")
_sql("limit_offset", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 20")
_sql("limit_zero", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 0")
_sql("offset_beyond", "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 5 OFFSET 100")
_sql("distinct_one", "SELECT DISTINCT o_orderstatus FROM orders")
_sql("distinct_multi", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
_sql("distinct_null", "SELECT DISTINCT nullif(o_orderpriority, '5-LOW') AS p FROM orders")
_sql("distinct_order_limit", "SELECT DISTINCT p_size FROM part ORDER BY p_size DESC LIMIT 7")
_sql("top_k", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")


def _engine(spark: SparkSession) -> Engine:
    """An engine with an empty warehouse in the folder that the driver and all executors share; one of our own only on a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="tessel-")
    return Engine(spark, f"{shared}/warehouse-{uuid.uuid4().hex}")


# rows changed
@_frame("SELECT * FROM nation UNION ALL SELECT 100, 'ATLANTIS', 2 UNION ALL SELECT 101, NULL, 3")
def dml_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insert_rows(table(spark, sf_dir, "nation"), spark.sql("SELECT * FROM VALUES (2, 100, 'ATLANTIS'), (3, 101, NULL) AS t(n_regionkey, n_nationkey, n_name)"))


@_frame("SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN upper(c_name) ELSE c_name END AS c_name, c_nationkey, CASE WHEN c_nationkey < 5 THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def dml_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return update_rows(table(spark, sf_dir, "customer"), {"c_acctbal": "c_acctbal + 100", "c_name": "upper(c_name)"}, "c_nationkey < 5")


@_frame("SELECT * FROM orders WHERE NOT coalesce(nullif(o_orderpriority, '5-LOW') = '1-URGENT', false)")
def dml_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delete_rows(table(spark, sf_dir, "orders"), "nullif(o_orderpriority, '5-LOW') = '1-URGENT'")


@_frame("SELECT n_nationkey AS id, CASE WHEN n_regionkey = 1 THEN upper(n_name) || '!' ELSE n_name END AS name FROM nation WHERE n_regionkey <> 4 UNION ALL SELECT 100, NULL")
def ddl_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table created, filled, changed and read through statements, in a warehouse of its own."""
    engine = _engine(spark)
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    engine.execute("CREATE TABLE places (id INT NOT NULL, name VARCHAR(30), region INT)")
    engine.execute("INSERT INTO places SELECT n_nationkey, n_name, n_regionkey FROM nation")
    engine.execute("INSERT INTO places (region, id) VALUES (7, 100)")
    engine.execute("UPDATE places SET name = upper(name) || '!' WHERE region = 1")
    engine.execute("DELETE FROM places WHERE region = 4")
    return engine.query("SELECT id, name FROM places")


@_frame("SELECT * FROM (VALUES (1, 'kept', true), (2, 'other', true), (3, 'other', false), (4, 'kept', true)) AS t(step, name, found)")
def catalog_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables listed, looked up by another engine on the same folder, and dropped, once with IF EXISTS of a table that is gone."""
    engine = _engine(spark)
    for name in ("kept", "other"):
        engine.execute(f"CREATE TABLE {name} (id INT)")
    again = Engine(spark, engine.warehouse.root)
    found = [(i, name, again.warehouse.exists(name)) for i, name in enumerate(again.warehouse.tables(), 1)]
    engine.execute("DROP TABLE other")
    engine.execute("DROP TABLE IF EXISTS other")
    found += [(3, "other", again.warehouse.exists("other")), (4, "kept", again.warehouse.tables() == ["kept"])]
    return spark.createDataFrame(found, "step int, name string, found boolean")


@_frame("SELECT id, CAST(id * 2 AS INTEGER) AS v FROM (SELECT CAST(unnest(range(7)) AS INTEGER) AS id) AS t WHERE id <> 3")
def catalog_persisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that one engine wrote and changed, read by another."""
    engine = _engine(spark)
    engine.execute("CREATE TABLE t (id INT NOT NULL, v INT)")
    engine.execute("INSERT INTO t SELECT CAST(id AS INT), CAST(id AS INT) FROM range(7)")
    engine.execute("UPDATE t SET v = v + id")
    engine.execute("DELETE FROM t WHERE id = 3")
    return Engine(spark, engine.warehouse.root).query("SELECT * FROM t")


@_frame("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def pull_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that an iterator over a result gives, one after the other."""
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    result = Engine(spark).query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
    return spark.createDataFrame([tuple(r) for r in result.toLocalIterator()], result.schema)


def _lines(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([*enumerate(text.splitlines(), 1)], "place int, line string")


@_frame("""WITH w AS (SELECT CAST(greatest(6, max(length(r_name))) AS INTEGER) AS n FROM region),
l AS (SELECT 0 AS k, '+------+' || repeat('-', n + 2) || '+' AS line FROM w UNION ALL SELECT 1, '| k    | ' || rpad('r_name', n, ' ') || ' |' FROM w
UNION ALL SELECT 2, '+------+' || repeat('-', n + 2) || '+' FROM w
UNION ALL SELECT 3 + r_regionkey, '| ' || rpad(coalesce(CAST(nullif(r_regionkey, 2) AS VARCHAR), 'NULL'), 4, ' ') || ' | ' || rpad(r_name, n, ' ') || ' |' FROM region, w
UNION ALL SELECT 900, '+------+' || repeat('-', n + 2) || '+' FROM w UNION ALL SELECT 901, '(' || count(*) || ' rows)' FROM region)
SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS place, line FROM l""")
def display_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result as boxed text, by line."""
    table(spark, sf_dir, "region").createOrReplaceTempView("region")
    return _lines(spark, format_table(Engine(spark).query("SELECT nullif(r_regionkey, 2) AS k, r_name FROM region ORDER BY r_regionkey")))


@_frame("SELECT * FROM (VALUES (1, 'CREATE TABLE'), (2, 'INSERT 2'), (3, 'p'), (4, '(2 rows)'), (5, 'ERROR'), (6, 'left')) AS t(place, line)")
def prompt_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the prompt answers to statements and commands: the last line, or the beginning of an error."""
    engine = _engine(spark)
    asked = ("CREATE TABLE p (a INT)", "INSERT INTO p VALUES (7), (8)", "\\dt", "SELECT a FROM p", "SELECT b FROM p", "\\q")
    said = [answer(engine, x) for x in asked]
    known = set(engine.tables()) - {"p"}  # views of the session
    lines = ["left" if x is None else "ERROR" if x.startswith("ERROR") else [y for y in x.splitlines() if y not in known][-1] for x in said]
    return spark.createDataFrame([*enumerate(lines, 1)], "place int, line string")


@_frame("SELECT * FROM (VALUES ('data_directory', './tables'), ('spark.sql.shuffle.partitions', '7'), ('empty', '')) AS t(key, value)")
def config_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "# head\ndata_directory = ./old\n\nspark.sql.shuffle.partitions=7 # tail\ndata_directory = ./tables\nempty =\n"
    return spark.createDataFrame([*parse_config(text).items()], "key string, value string")


_ERRORS = {
    "unknown column": "SELECT nothing FROM nation",
    "unknown table": "SELECT * FROM nowhere",
    "ambiguous column": "SELECT n_name FROM nation a JOIN nation b ON a.n_nationkey = b.n_nationkey",
    "column that isn't grouped": "SELECT n_name, count(*) FROM nation GROUP BY n_regionkey",
    "column in having that isn't grouped": "SELECT count(*) FROM nation GROUP BY n_regionkey HAVING n_name = 'x'",
    "sum of an array": "SELECT sum(array(n_nationkey)) FROM nation",
    "sum of a boolean": "SELECT sum(n_nationkey > 3) FROM nation",
    "predicate that isn't boolean": "SELECT * FROM nation WHERE n_nationkey + 1",
    "none: sum of any number": "SELECT sum(n_nationkey), sum(CAST(n_nationkey AS BIGINT)), avg(CAST(n_nationkey AS FLOAT)) FROM nation",
    "none: joined columns of two names": "SELECT a.n_name, b.n_name FROM nation a JOIN nation b ON a.n_nationkey = b.n_nationkey",
}


@_frame("SELECT * FROM (VALUES " + ", ".join(f"('{k.replace(chr(39), chr(39) * 2)}', {str(not k.startswith('none')).lower()})" for k in _ERRORS) + ") AS t(statement, is_error)")
def statement_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether analysing a statement is an error."""
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    engine, found = Engine(spark), []
    for name, text in _ERRORS.items():
        try:
            engine.query(text).schema  # noqa: B018  analysis
            found.append((name, False))
        except AnalysisException:
            found.append((name, True))
    return spark.createDataFrame(found, "statement string, is_error boolean")
