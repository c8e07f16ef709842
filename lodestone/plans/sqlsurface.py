"""The SQL surface over the star schema: what an external database answers for its callers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ranges as R
from ..sources.tables import load, register
from .registry import query


def same(name: str, covers: str, sql: str, tables: str, spark_sql: str | None = None) -> Callable:
    """A query whose text both engines take; ``spark_sql`` where they differ."""

    def run(spark, sf_dir):
        register(spark, sf_dir, *tables.split())
        return spark.sql(spark_sql or sql)

    return query(name, f"S6 2.16 {covers}", sql)(run)


REVENUE = "l_extendedprice * (1 - l_discount)"
same("sql_pricing_summary", "aggregates", f"SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum({REVENUE}), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '2000-09-02' GROUP BY l_returnflag, l_linestatus", "lineitem")
same("sql_star_join", "inner", f"SELECT n_name, round(sum({REVENUE}), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name", "customer orders lineitem supplier nation region")
same("sql_left_outer", "left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey", "customer orders")
same("sql_right_outer", "right", "SELECT n_name, count(s_suppkey) AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name", "supplier nation")
same("sql_full_outer", "full", "SELECT coalesce(a.k, b.k) AS k, a.n AS orders, b.n AS customers FROM (SELECT o_custkey % 40 AS k, count(*) AS n FROM orders GROUP BY 1) a FULL OUTER JOIN (SELECT c_custkey % 50 AS k, count(*) AS n FROM customer GROUP BY 1) b ON a.k = b.k", "orders customer")
same("sql_cross", "cross", "SELECT r_name, s.n FROM region CROSS JOIN (SELECT count(*) AS n FROM nation) s", "region nation")
same("sql_semi_anti", "semi anti exists", "SELECT 'with' AS kind, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) UNION ALL SELECT 'without', count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)", "customer orders")
same("sql_theta", "theta", "SELECT count(*) AS n FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal", "supplier")
same("sql_grouping_sets", "grouping sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())", "lineitem")
same("sql_cube", "cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", "orders")
same("sql_rollup", "rollup", "SELECT p_brand, p_type, count(*) AS n, grouping(p_type) AS g FROM part GROUP BY ROLLUP (p_brand, p_type)", "part", "SELECT p_brand, p_type, count(*) AS n, cast(grouping(p_type) AS bigint) AS g FROM part GROUP BY ROLLUP (p_brand, p_type)")
same("sql_having", "having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND sum(o_totalprice) > 100000", "orders")
same("sql_filter_clause", "filter", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(DISTINCT o_custkey) FILTER (WHERE o_totalprice > 200000) AS big FROM orders GROUP BY o_orderpriority", "orders")
same("sql_scalar_subquery", "correlated", "SELECT p_partkey FROM part p WHERE p_retailprice > (SELECT avg(q.p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)", "part")
same("sql_set_operations", "union intersect except", "SELECT 'i' AS op, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'e', k FROM (SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'u', k FROM (SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region)", "customer supplier nation region")
same("sql_set_all", "intersect all except all", "SELECT 'e' AS op, k FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) UNION ALL SELECT 'i', k FROM (SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier)", "customer supplier")
same("sql_windows", "rank dense_rank ntile lag lead", "SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, lag(o_orderkey) OVER k AS before, lead(o_orderkey, 2) OVER k AS after, first_value(o_orderkey) OVER k AS first, ntile(4) OVER k AS q FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderstatus), k AS (PARTITION BY o_custkey ORDER BY o_orderkey)", "orders", "SELECT o_orderkey, cast(rank() OVER w AS bigint) AS r, cast(dense_rank() OVER w AS bigint) AS d, lag(o_orderkey) OVER k AS before, lead(o_orderkey, 2) OVER k AS after, first_value(o_orderkey) OVER k AS first, cast(ntile(4) OVER k AS bigint) AS q FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderstatus), k AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
same("sql_frames", "rows and range frames", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS s3, count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 500 PRECEDING AND CURRENT ROW) AS near FROM events", "events")
same("sql_distinct_on_percentiles", "percentile mode", "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY o_orderpriority", "orders", "SELECT o_orderpriority, round(percentile(o_totalprice, 0.5), 4) AS median, round(percentile(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY o_orderpriority")
same("sql_lateral", "lateral", "SELECT r_name, x.n_name FROM region, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_name LIMIT 2) x", "region nation")
same("sql_recursive", "recursive", "WITH RECURSIVE t(n, f) AS (SELECT 1, 1::BIGINT UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t", "region", "WITH RECURSIVE t(n, f) AS (SELECT 1, 1L UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t")
same("sql_pivot", "pivot", "SELECT l_returnflag, round(sum(l_quantity) FILTER (l_linestatus = 'O'), 2) AS o, round(sum(l_quantity) FILTER (l_linestatus = 'F'), 2) AS f FROM lineitem GROUP BY 1", "lineitem", "SELECT l_returnflag, round(O, 2) AS o, round(F, 2) AS f FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem) PIVOT (sum(l_quantity) FOR l_linestatus IN ('O' AS O, 'F' AS F))")
same("sql_unpivot", "unpivot", "SELECT s_suppkey, 'acctbal' AS k, s_acctbal AS v FROM supplier UNION ALL SELECT s_suppkey, 'nation', s_nationkey FROM supplier", "supplier", "SELECT * FROM (SELECT s_suppkey, s_acctbal AS acctbal, cast(s_nationkey AS double) AS nation FROM supplier) UNPIVOT (v FOR k IN (acctbal, nation))")
same("sql_arrays_maps", "array map json regex", "SELECT event_id, regexp_extract(props, '([0-9]+)', 1) AS digits, list_contains(['view', 'click'], event_type) AS watched, len(string_split(props, ':')) AS parts FROM events", "events", "SELECT event_id, regexp_extract(props, '([0-9]+)', 1) AS digits, array_contains(array('view', 'click'), event_type) AS watched, cast(size(split(props, ':')) AS bigint) AS parts FROM events")
same("sql_dates", "date", "SELECT extract(year FROM o_orderdate) AS y, extract(quarter FROM o_orderdate) AS q, count(*) AS n FROM orders GROUP BY 1, 2", "orders", "SELECT cast(extract(year FROM o_orderdate) AS bigint) AS y, cast(extract(quarter FROM o_orderdate) AS bigint) AS q, count(*) AS n FROM orders GROUP BY 1, 2")
same("sql_top_orders", "order limit offset", f"SELECT o_orderkey, round(sum({REVENUE}), 2) AS revenue FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate < DATE '1998-03-15' GROUP BY o_orderkey ORDER BY revenue DESC, o_orderkey LIMIT 10 OFFSET 5", "orders lineitem")
same("sql_in_subquery", "in", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY o_orderpriority", "orders lineitem customer")
same("sql_case_forecast", "case", f"SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {REVENUE} ELSE 0 END) / sum({REVENUE}), 4) AS promo FROM lineitem JOIN part ON l_partkey = p_partkey", "lineitem part")


@query("sql_approximate", "S6 2.16 approximate A12")
def sql_approximate(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return o.groupBy("o_orderstatus").agg(F.approx_count_distinct("o_custkey", 0.01).alias("customers"), F.percentile_approx("o_totalprice", 0.5, 10_000).alias("median"), F.mode("o_orderpriority").alias("priority"))


@query("sql_join_hints", "S6 2.16 physical joins", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def sql_join_hints(spark, sf_dir):
    c, n, o = (load(spark, sf_dir, t) for t in ("customer", "nation", "orders"))
    both = c.join(n.hint("broadcast"), c.c_nationkey == n.n_nationkey).hint("merge")
    return both.join(o.hint("shuffle_hash"), o.o_custkey == c.c_custkey).groupBy("n_name").agg(F.count("*").alias("n"))


@query("sql_as_of", "2.16 as-of", "SELECT e.event_id, p.event_id AS signup_id FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') p ON p.user_id = e.user_id AND p.ts <= e.ts")
def sql_as_of(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    out = R.as_of(e.where("event_type = 'purchase'").select("user_id", "ts", "event_id"), e.where("event_type = 'signup'").select("user_id", "ts", "event_id"), by=["user_id"], on="ts", tie="event_id")
    return out.select("event_id", F.col("right_event_id").alias("signup_id"))


@query("sql_interval_join", "2.16 range", "SELECT b.s_suppkey, count(*) AS n FROM supplier b JOIN customer c ON c_acctbal BETWEEN s_acctbal AND s_acctbal + 25 GROUP BY 1")
def sql_interval_join(spark, sf_dir):
    s, c = load(spark, sf_dir, "supplier"), load(spark, sf_dir, "customer")
    met = R.interval_join(s.select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 25).alias("high")), c.select("c_custkey", F.col("c_acctbal").alias("x")), width=25.0)
    return met.groupBy("s_suppkey").agg(F.count("*").alias("n"))


@query("sql_udf_registry", "U2 U3 U6", "SELECT n_nationkey, length(n_name) * 2 AS twice, x.part AS part FROM nation, LATERAL (SELECT unnest(string_split(n_name, 'A')) AS part) x".replace("x.part AS part", "part"))
def sql_udf_registry(spark, sf_dir):
    from ..functions.registry import register_functions

    register_functions(spark)
    register(spark, sf_dir, "nation")
    return spark.sql("SELECT n_nationkey, cast(twice(length(n_name)) AS bigint) AS twice, part FROM nation, LATERAL split_parts(n_name, 'A')")


@query("sql_dataframe_windows", "W1 2.5", "SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM lineitem")
def sql_dataframe_windows(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice", "l_suppkey").rowsBetween(Window.unboundedPreceding, 0)
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.sum("l_quantity").over(w), 2).alias("running"))
