"""Graphs and plans of steps as tables."""

from __future__ import annotations

import itertools
import tempfile
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cut_lineage(df: DataFrame) -> DataFrame:
    """A round's rows as a checkpoint in the session's folder; a folder is made here only where none is set, and only for a local master."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lodestone-"))
    return df.checkpoint()


def reachable(edges: DataFrame, start: DataFrame, *, keep: Callable[[DataFrame], DataFrame] | None = None, max_rounds: int = 100) -> DataFrame:
    """``id`` of the nodes on any path from the start nodes; one anti-join for each distance.

    ``edges`` has ``source, target``; ``keep`` cuts a round's lineage (a checkpoint or a written table).
    """
    keep = keep or cut_lineage
    frontier = keep(start.select("id").distinct())
    seen = frontier
    for _ in range(max_rounds):
        frontier = keep(frontier.join(edges, frontier["id"] == edges["source"]).select(F.col("target").alias("id")).distinct().join(seen, "id", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise RuntimeError("the graph is deeper than max_rounds")


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def next_nodes(nodes: DataFrame, choices: DataFrame) -> DataFrame:
    """``id, next``: a node's single target, all of its several targets, or the target of the chosen condition.

    ``nodes`` has ``id, kind`` (single, multi, conditional), ``targets`` and ``conditions`` (parallel arrays).
    """
    each = nodes.select("id", "kind", F.posexplode("targets").alias("k", "next"), "conditions")
    each = each.withColumn("condition", F.try_element_at("conditions", F.col("k") + 1)).join(choices, "id", "left")
    return each.where((F.col("kind") == "multi") | ((F.col("kind") == "single") & (F.col("k") == 0)) | ((F.col("kind") == "conditional") & (F.col("condition") == F.col("choice")))).select("id", "next")


def _peeled(edges: DataFrame, by: list[str], keep: Callable[[DataFrame], DataFrame], *, both: bool) -> DataFrame:
    """``by, id, dep`` without the edges to nodes that need nothing and, with ``both``, those of nodes that nothing needs, in rounds."""
    left = keep(edges)
    n = left.count()
    while n:
        fewer = left.join(left.select(*by, F.col("id").alias("dep")).distinct(), [*by, "dep"], "left_semi")
        if both:
            fewer = fewer.join(left.select(*by, F.col("dep").alias("id")).distinct(), [*by, "id"], "left_semi")
        fewer = keep(fewer.select(*by, "id", "dep"))
        m = fewer.count()
        if m == n:
            break
        left, n = fewer, m
    return left


def _coloured(edges: DataFrame, by: list[str], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``by, id, colour``: the greatest node that a node needs, itself included; only risen colours are sent on."""
    ends = edges.select(*by, "id").union(edges.select(*by, "dep")).distinct()
    seen = keep(ends.withColumn("colour", F.col("id")))
    risen = seen
    while not risen.isEmpty():
        sent = edges.join(risen.withColumnRenamed("id", "dep"), [*by, "dep"]).groupBy(*by, "id").agg(F.max("colour").alias("sent"))
        risen = keep(sent.join(seen, [*by, "id"]).where("sent > colour").select(*by, "id", F.col("sent").alias("colour")))
        seen = keep(seen.unionByName(risen).groupBy(*by, "id").agg(F.max("colour").alias("colour")))
    return seen


def _around_pivot(left: DataFrame, by: list[str], keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The component of each graph's busiest node, and the edges that are left.

    It has the nodes that are reached from that node both along the edges and against them.  Other components lie
    within the nodes that are reached one way alone, or not at all, so edges between those kinds go.
    """
    ways = keep(left.select(*by, F.lit(1).alias("way"), F.col("id").alias("a"), F.col("dep").alias("b")).union(left.select(*by, F.lit(2), "dep", "id")))
    degrees = ways.groupBy(*by, "a").agg((F.count_if(F.col("way") == 1) * F.count_if(F.col("way") == 2)).alias("n"))
    pivots = degrees.groupBy(*by).agg(F.max_by("a", F.struct("n", "a")).alias("id"))
    seen = frontier = keep(pivots.select(*by, F.explode(F.array(F.lit(1), F.lit(2))).alias("way"), "id"))
    while not frontier.isEmpty():
        after = ways.join(frontier.withColumnRenamed("id", "a"), [*by, "way", "a"]).select(*by, "way", F.col("b").alias("id")).distinct()
        frontier = keep(after.join(seen, [*by, "way", "id"], "left_anti"))
        seen = seen.unionByName(frontier)
    kinds = keep(seen.groupBy(*by, "id").agg(F.sum("way").alias("kind")))
    ends = kinds.select(*by, F.col("id").alias("dep"), F.col("kind").alias("other"))
    kind, other = (F.coalesce(c, F.lit(0)) for c in ("kind", "other"))
    rest = left.join(kinds, [*by, "id"], "left").join(ends, [*by, "dep"], "left").where((kind == other) & (kind != 3))
    return kinds.where("kind = 3").select(*by, "id", F.lit(0).alias("colour")), rest.select(*by, "id", "dep")


def _by_colours(left: DataFrame, by: list[str], keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """One component for each colour, and the edges that are left.

    Each node takes the greatest node that it needs by any path as its colour.  Those of a colour that its greatest
    node needs in turn, by paths of the colour, are a component.  The rest, without edges between colours, goes round again.
    """
    within = [*by, "colour"]
    colours = _coloured(left, by, keep)
    ends = colours.withColumnRenamed("id", "dep")
    same = keep(left.join(colours, [*by, "id"]).join(ends, [*by, "dep", "colour"]).select(*within, "id", "dep"))
    members = frontier = keep(same.where("id = colour").select(*within, "id").distinct())
    while not frontier.isEmpty():
        after = same.join(frontier, [*within, "id"]).select(*within, F.col("dep").alias("id")).distinct()
        frontier = keep(after.join(members, [*within, "id"], "left_anti"))
        members = keep(members.unionByName(frontier))
    gone = members.select(*by, "id")
    rest = same.join(gone, [*by, "id"], "left_anti").join(gone.withColumnRenamed("id", "dep"), [*by, "dep"], "left_anti")
    return members.select(*by, "id", "colour"), rest.select(*by, "id", "dep")


def _large_cycles(edges: DataFrame, by: list[str], keep: Callable[[DataFrame], DataFrame], search: Callable[[DataFrame], DataFrame], small: int) -> DataFrame:
    """``by, id, cycle`` of the components of several nodes, in rounds.

    Most graphs have one component that is far larger than the others, so that is looked for first; many that are left are then
    found at once by colours, in turns.  What is left of a graph is searched by one task as soon as it has at most ``small`` edges.
    """
    found = edges.select(*by, "id", F.col("id").alias("cycle")).where("false")
    left = edges
    for taken in itertools.cycle((_around_pivot, _by_colours)):
        left = _peeled(left, by, keep, both=True)
        large = keep(left.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > small).select(*by))
        few = search(left.join(large, by, "left_anti")).where("cycle is not null")
        found = keep(found.unionByName(few.select(*by, "id", "cycle")))
        left = keep(left.join(large, by, "left_semi").select(*by, "id", "dep"))
        if left.isEmpty():
            return found
        members, left = taken(left, by, keep)
        least = members.groupBy(*by, "colour").agg(F.min("id").alias("cycle"), F.count("*").alias("n")).where("n > 1")
        told = members.join(least, [*by, "colour"])
        found = keep(found.unionByName(told.select(*by, "id", "cycle")))
    return found


def stuck_nodes(ids: list, deps: list) -> dict:
    """``{node: smallest node of its cycles, or None behind them}`` for the nodes on or behind cycles, by one depth-first search."""
    needs: dict = {}
    for i, d in zip(ids, deps, strict=True):
        needs.setdefault(i, []).append(d)
    told, order, low, done = {}, {}, {}, set()
    for start in needs:
        if start in order:
            continue
        order[start] = low[start] = len(order)
        open_nodes, path = [start], [(start, iter(needs[start]))]
        while path:
            node, rest = path[-1]
            for d in rest:
                if d not in order:
                    order[d] = low[d] = len(order)
                    open_nodes.append(d)
                    path.append((d, iter(needs.get(d, ()))))
                    break
                if d not in done:
                    low[node] = min(low[node], order[d])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[node])
                if low[node] == order[node]:
                    # A component is closed after all that it needs.
                    members = [open_nodes.pop()]
                    while members[-1] != node:
                        members.append(open_nodes.pop())
                    done.update(members)
                    if len(members) > 1 or node in needs.get(node, ()):
                        least = min(members)
                        told |= dict.fromkeys(members, least)
                    elif any(d in told for d in needs.get(node, ())):
                        told[node] = None
    return told


def stuck(edges: DataFrame, *, by: Sequence[str] = (), small: int = 100_000, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``by, id, cycle``: nodes on cycles, with the smallest node of their strongly connected component, and with null those behind cycles.

    ``edges`` has ``id, dep`` (a node and one that it needs) and the columns ``by`` of the graph that they belong to, so
    that many graphs are searched at once.  Repeated edges count once, edges with a null take no part, a node that
    needs itself is on a cycle.  A graph of at most ``small`` edges is searched by the task that has it.  In larger ones all
    nodes take part in rounds, whose number grows with the longest path, and no graph is gathered; ``keep`` cuts a
    round's lineage, a checkpoint unless another way is given.
    """
    keep = keep or cut_lineage
    known = edges.select(*by, "id", "dep").dropna().distinct()
    groups = [*by] or ["_graph"]
    known = keep(known if by else known.withColumn("_graph", F.lit(0)))
    large = keep(known.groupBy(*groups).agg(F.count("*").alias("n")).where(F.col("n") > small).select(*groups))
    schema = T.StructType([*(known.schema[g] for g in groups), known.schema["id"], T.StructField("cycle", known.schema["id"].dataType)])

    def search(graph: pa.Table) -> pa.Table:
        told = stuck_nodes(graph.column("id").to_pylist(), graph.column("dep").to_pylist())
        same = [pa.chunked_array([pa.repeat(graph.column(g)[0], len(told))]) for g in groups]
        kind = graph.column("id").type
        return pa.table([*same, pa.array(list(told), kind), pa.array(list(told.values()), kind)], names=[*groups, "id", "cycle"])

    searched = lambda rows: rows.select(*groups, "id", "dep").groupBy(*groups).applyInArrow(search, schema)
    if large.isEmpty():
        return searched(known).select(*by, "id", "cycle")
    rest = searched(known.join(large, groups, "left_anti"))
    wide = keep(known.join(large, groups, "left_semi").select(*groups, "id", "dep"))
    held = _peeled(wide, groups, keep, both=False)
    own = held.where("id = dep").select(*groups, "id", F.col("id").alias("cycle"))
    named = own.unionByName(_large_cycles(held.where("id <> dep"), groups, keep, searched, small)).groupBy(*groups, "id").agg(F.min("cycle").alias("cycle"))
    return rest.unionByName(held.select(*groups, "id").distinct().join(named, [*groups, "id"], "left").select(*groups, "id", "cycle")).select(*by, "id", "cycle")


def cycles(edges: DataFrame, *, by: Sequence[str] = (), small: int = 100_000, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``by, id, cycle`` of ``stuck`` for the nodes on cycles alone."""
    return stuck(edges, by=by, small=small, keep=keep).where("cycle is not null")


def plan_problems(steps: DataFrame, *, by: Sequence[str] = (), small: int = 100_000, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``by, problem, id, cycle``: empty plans, repeated ids, unknown dependencies and steps on or behind cycles.

    ``steps`` has ``id``, ``deps`` (array) and the columns ``by`` of the plan; without ``by`` there is one plan, which may be
    empty.  ``cycle`` is the smallest step of the cycles that a step is on, null for one that is only behind them.
    """
    by = [*by]
    kind = dict(steps.dtypes)["id"]
    ids = steps.select(*by, F.col("id").alias("dep")).distinct()
    needs = steps.select(*by, "id", F.explode("deps").alias("dep")).distinct()
    none = F.lit(None).cast(kind).alias("cycle")
    out = steps.groupBy(*by, "id").agg(F.count("*").alias("n")).where("n > 1").select(*by, F.lit("duplicate").alias("problem"), "id", none)
    out = out.unionByName(needs.join(ids, [*by, "dep"], "left_anti").select(*by, F.lit("unknown dependency").alias("problem"), "id", none).distinct())
    held = stuck(needs.join(ids, [*by, "dep"], "left_semi"), by=by, small=small, keep=keep)
    out = out.unionByName(held.select(*by, F.lit("cycle").alias("problem"), "id", "cycle"))
    if not by and steps.isEmpty():
        out = out.unionByName(steps.sparkSession.createDataFrame([("empty", None, None)], f"problem string, id {kind}, cycle {kind}"))
    return out


def ready_steps(steps: DataFrame, done: DataFrame) -> DataFrame:
    """Steps that aren't done and whose dependencies all are."""
    waiting = steps.join(done, "id", "left_anti")
    open_deps = waiting.select("id", F.explode("deps").alias("dep")).join(done.withColumnRenamed("id", "dep"), "dep", "left_anti").select("id").distinct()
    return waiting.join(open_deps, "id", "left_anti").select("id")


def terminal_steps(steps: DataFrame, done: DataFrame) -> DataFrame:
    """Done steps that no step depends on; if there are none, all done steps."""
    needed = steps.select(F.explode("deps").alias("id")).distinct()
    ended = steps.select("id").join(done, "id", "left_semi")
    last = ended.join(needed, "id", "left_anti")
    return ended if last.isEmpty() else last
