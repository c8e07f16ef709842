"""Graph and plan queries over derived node and step tables."""

from __future__ import annotations

import contextlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graphs as G
from ..sources.tables import load
from .registry import query

# A supplier leads to two others; step n of a plan of parts needs the steps at a half and a third of it.
_EDGES = "size AS (SELECT count(*) AS n FROM supplier), edges AS (SELECT s_suppkey AS source, (s_suppkey * 2 + 1) % n AS target FROM supplier, size UNION SELECT s_suppkey, (s_suppkey * 3) % n FROM supplier, size WHERE s_acctbal > 0)"


def _edges(spark, sf_dir):
    s = load(spark, sf_dir, "supplier")
    k, n = F.col("s_suppkey"), s.count()
    return s.select(k.alias("source"), ((k * 2 + 1) % n).alias("target")).union(s.where("s_acctbal > 0").select(k, (k * 3) % n)).distinct()


@query("graph_reachable", "G1", f"WITH RECURSIVE {_EDGES}, r(id) AS (SELECT 3::BIGINT UNION SELECT target FROM r JOIN edges ON source = id) SELECT id FROM r")
def graph_reachable(spark, sf_dir):
    return G.reachable(_edges(spark, sf_dir), spark.createDataFrame([(3,)], "id long"))


@query("graph_reachable_sql", "G1 2.16 recursive", f"WITH RECURSIVE {_EDGES}, r(id) AS (SELECT 3::BIGINT UNION SELECT target FROM r JOIN edges ON source = id) SELECT id FROM r")
def graph_reachable_sql(spark, sf_dir):
    """Rounds of a recursive statement of a few steps each, from the nodes that the last one reached in its last step, until there are none."""
    G.cut_lineage(_edges(spark, sf_dir)).createOrReplaceTempView("graph_edges")
    seen = frontier = G.cut_lineage(spark.sql("SELECT 3L AS id"))
    with _all_rows(spark):
        while not frontier.isEmpty():
            frontier.createOrReplaceTempView("graph_frontier")
            seen.createOrReplaceTempView("graph_seen")
            steps = f"WITH RECURSIVE r(id, depth) AS (SELECT id, 0 FROM graph_frontier UNION ALL SELECT target, depth + 1 FROM r JOIN graph_edges ON source = id WHERE depth < {_STEPS}) SELECT id, min(depth) AS depth FROM r GROUP BY id"
            new = G.cut_lineage(spark.sql(f"SELECT * FROM ({steps}) LEFT ANTI JOIN graph_seen USING (id)"))
            seen = seen.union(new.select("id"))
            frontier = new.where(F.col("depth") == _STEPS).select("id")
    return seen


#: Steps of one recursive statement, which follows each path by itself.
_STEPS = 3


@contextlib.contextmanager
def _all_rows(spark):
    """Recursive statements without Spark's limit of rows."""
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@query("graph_duplicates", "G2", "SELECT c_nationkey::BIGINT AS id, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1")
def graph_duplicates(spark, sf_dir):
    return G.duplicate_ids(load(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("id")))


@query("graph_next_nodes", "G3", "SELECT n_nationkey::BIGINT AS id, t::BIGINT AS next FROM (SELECT n_nationkey, n_nationkey % 3 AS k, unnest([n_nationkey + 1, n_nationkey + 2]) AS t FROM nation) WHERE k = 1 OR (k = 0 AND t = n_nationkey + 1) OR (k = 2 AND t = n_nationkey + 2)")
def graph_next_nodes(spark, sf_dir):
    k = F.col("n_nationkey").cast("long")
    kind = F.when(k % 3 == 0, "single").when(k % 3 == 1, "multi").otherwise("conditional")
    nodes = load(spark, sf_dir, "nation").select(k.alias("id"), kind.alias("kind"), F.array(k + 1, k + 2).alias("targets"), F.array(F.lit("no"), F.lit("yes")).alias("conditions"))
    return G.next_nodes(nodes, nodes.select("id", F.lit("yes").alias("choice")))


def _steps(spark, sf_dir):
    k = F.col("p_partkey")
    deps = F.when(k > 1, F.array((k / 2).cast("long"), (k / 3).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return load(spark, sf_dir, "part").select(k.alias("id"), F.array_distinct(deps).alias("deps"), "p_size")


_NEEDS = "needs AS (SELECT p_partkey AS id, unnest([p_partkey // 2, p_partkey // 3]) AS dep FROM part WHERE p_partkey > 1), done AS (SELECT p_partkey AS id FROM part WHERE p_size <= 40)"


# The orders of a customer are a plan in which each needs the one before.  Every fifth customer's first order needs the
# third, every seventh one's last but one needs the last; some orders need what isn't there, and some come twice.
_ORDERS = """o AS (SELECT o_custkey AS plan, o_orderkey AS id, row_number() OVER w AS r, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS next, count(*) OVER (PARTITION BY o_custkey) AS m,
    nth_value(o_orderkey, 3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS third FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
    needs AS (SELECT plan, id, before AS dep FROM o WHERE before IS NOT NULL UNION SELECT plan, id, third FROM o WHERE r = 1 AND plan % 5 = 0 AND third IS NOT NULL
        UNION SELECT plan, id, next FROM o WHERE r = m - 1 AND plan % 7 = 0 UNION SELECT plan, id, -1 - id FROM o WHERE id % 50 = 0)"""


def _orders(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("plan"), F.col("o_orderkey").alias("id"))
    plan = Window.partitionBy("plan")
    inner, whole = plan.orderBy("id"), plan.orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    r, m, third = F.row_number().over(inner), F.count("*").over(plan), F.nth_value("id", 3).over(whole)
    placed = o.select("plan", "id", F.lag("id").over(inner).alias("before"), F.lead("id").over(inner).alias("next"), r.alias("r"), m.alias("m"), third.alias("third"))
    deps = F.array("before", F.when((F.col("r") == 1) & (F.col("plan") % 5 == 0), F.col("third")), F.when((F.col("r") == F.col("m") - 1) & (F.col("plan") % 7 == 0), F.col("next")), F.when(F.col("id") % 50 == 0, -1 - F.col("id")))
    steps = placed.select("plan", "id", F.array_compact(deps).alias("deps"))
    return steps.unionByName(steps.where("id % 97 = 0"))


@query(
    "plan_problems",
    "G4",
    f"""WITH RECURSIVE {_ORDERS}, r(plan, a, b) AS (SELECT plan, id, dep FROM needs WHERE dep >= 0 UNION SELECT r.plan, r.a, n.dep FROM r JOIN needs n ON n.plan = r.plan AND n.id = r.b AND n.dep >= 0),
    on_cycle AS (SELECT r.plan, r.a AS id, min(r.b) AS cycle FROM r JOIN r q ON q.plan = r.plan AND q.a = r.b AND q.b = r.a GROUP BY ALL),
    stuck AS (SELECT DISTINCT r.plan, r.a AS id FROM r JOIN on_cycle c ON c.plan = r.plan AND c.id = r.b)
    SELECT plan, 'duplicate' AS problem, id, NULL::BIGINT AS cycle FROM o WHERE id % 97 = 0 UNION ALL SELECT plan, 'unknown dependency', id, NULL FROM needs WHERE dep < 0
    UNION ALL SELECT s.plan, 'cycle', s.id, c.cycle FROM stuck s LEFT JOIN on_cycle c USING (plan, id)""",
)
def plan_problems(spark, sf_dir):
    """What is wrong with the plans of all customers, found at once."""
    return G.plan_problems(_orders(spark, sf_dir), by=["plan"])


@query("graph_cycles", "G4 G1", f"WITH RECURSIVE {_EDGES}, r(a, b) AS (SELECT source, target FROM edges UNION SELECT a, target FROM r JOIN edges ON source = b) SELECT r.a AS id, min(r.b) AS cycle FROM r JOIN r q ON q.a = r.b AND q.b = r.a GROUP BY 1")
def graph_cycles(spark, sf_dir):
    return G.cycles(_edges(spark, sf_dir).select(F.col("source").alias("id"), F.col("target").alias("dep")))


@query("plan_ready", "G5", f"WITH {_NEEDS} SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT id FROM done) AND p_partkey NOT IN (SELECT id FROM needs WHERE dep NOT IN (SELECT id FROM done))")
def plan_ready(spark, sf_dir):
    s = _steps(spark, sf_dir)
    return G.ready_steps(s, s.where("p_size <= 40").select("id"))


@query("plan_terminal", "G6", f"WITH {_NEEDS} SELECT id FROM done WHERE id NOT IN (SELECT dep FROM needs)")
def plan_terminal(spark, sf_dir):
    s = _steps(spark, sf_dir)
    return G.terminal_steps(s, s.where("p_size <= 40").select("id"))
