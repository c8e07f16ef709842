"""Cycles of many graphs at once, against a closure of each."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import graphs as G


def brute_force(edges):
    """``{(graph, node): smallest node of its component}`` for nodes on cycles, by the closure of each graph."""
    told = {}
    for g in {e[0] for e in edges}:
        nodes = sorted({x for e in edges if e[0] == g for x in e[1:]})
        at = {x: k for k, x in enumerate(nodes)}
        reach = np.zeros((len(nodes), len(nodes)), bool)
        for e in edges:
            if e[0] == g:
                reach[at[e[1]], at[e[2]]] = True
        for k in range(len(nodes)):
            reach |= np.outer(reach[:, k], reach[k])
        both = reach & reach.T
        told |= {(g, x): nodes[int(np.argmax(both[k]))] for k, x in enumerate(nodes) if both[k].any()}
    return told


def found(spark, edges, kind="long", small=100_000):
    df = spark.createDataFrame(edges, f"g int, id {kind}, dep {kind}")
    rows = G.cycles(df, by=["g"], small=small).collect()
    got = {(r.g, r.id): r.cycle for r in rows}
    assert len(got) == len(rows)
    return got


# Graphs up to so many edges in their task: all, some, none.
@pytest.mark.parametrize("small", [100, 25, 0])
def test_cycles_equal_closures(spark, small):
    rng = np.random.default_rng(1)
    edges = [(g, *map(int, rng.integers(0, 25, 2))) for g, n in enumerate((10, 22, 28, 40, 90)) for _ in range(n)]
    want = brute_force(edges)
    assert len(set(want.values())) > 3
    assert found(spark, edges, small=small) == want


@pytest.mark.parametrize("small", [100, 0])
def test_cycles_behind_cycles(spark, small):
    """Components in a chain, whose greatest nodes come first and last; one node that needs itself; repeated edges; nulls."""
    rings = [(1, 5, 6), (1, 6, 5), (1, 6, 9), (1, 9, 8), (1, 8, 9), (1, 8, 1), (1, 1, 2), (1, 2, 3), (1, 3, 1), (1, 3, 50), (1, 40, 5), (1, 77, 77), (1, 77, 5)]
    assert found(spark, [*rings, *rings, (1, None, 5), (1, 5, None), (None, 1, 2), (None, 2, 1)], small=small) == brute_force(rings)


def test_cycles_of_words(spark):
    edges = [(1, "b", "a"), (1, "a", "b"), (1, "c", "a"), (2, "a", "b"), (2, "b", "c")]
    assert found(spark, edges, "string") == {(1, "a"): "a", (1, "b"): "a"}
    assert found(spark, []) == {}


def test_long_chain_in_a_task():
    n = 200_000
    assert G.stuck_nodes(list(range(n)), list(range(1, n + 1))) == {}
    assert G.stuck_nodes([*range(n), n], [*range(1, n + 1), n - 1]) == {k: None for k in range(n - 1)} | {n - 1: n - 1, n: n - 1}


@pytest.mark.parametrize("small", [100, 0])
def test_problems_of_many_plans(spark, small):
    steps = [(1, "a", ["b"]), (1, "b", ["a"]), (1, "c", ["a"]), (2, "a", ["b"]), (2, "b", ["x"]), (2, "d", []), (2, "d", []), (3, "a", ["a"])]
    got = G.plan_problems(spark.createDataFrame(steps, "plan int, id string, deps array<string>"), by=["plan"], small=small)
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "cycle", "a", "a"), (1, "cycle", "b", "a"), (1, "cycle", "c", None), (2, "duplicate", "d", None), (2, "unknown dependency", "b", None), (3, "cycle", "a", "a")]


def test_one_large_component_with_small_ones_around(spark):
    """A ring of 60 with cords, rings that it needs and that need it, and a tail; cut by its pivot and by colours."""
    ring = [(1, k, (k + 1) % 60) for k in range(60)] + [(1, k, k * 7 % 60) for k in range(1, 60, 4)]
    small = [(1, 100 + 3 * r + k, 100 + 3 * r + (k + 1) % 3) for r in range(8) for k in range(3)]
    bridges = [(1, 5, 100), (1, 103, 6), (1, 100, 106), (1, 900, 901), (1, 901, 0)]
    edges = [*ring, *small, *bridges, *((2, a + 1, b + 1) for _, a, b in ring)]
    want = brute_force(edges)
    for limit in (0, 10, 30):
        assert found(spark, edges, small=limit) == want


def test_cycles_take_few_rounds(spark):
    """One component of 2,000 nodes with short paths and 100 rings behind it: rounds follow the paths, not the components."""
    edges = [(1, k, (2 * k + 1) % 2001) for k in range(2001)] + [(1, k, 3 * k % 2001) for k in range(2001)]
    edges += [(1, 5000 + 2 * k, 5001 + 2 * k) for k in range(100)] + [(1, 5001 + 2 * k, 5000 + 2 * k) for k in range(100)]
    kept = []

    def keep(df):
        kept.append(1)
        return G.cut_lineage(df)

    rows = G.cycles(spark.createDataFrame(edges, "g int, id long, dep long"), by=["g"], small=1000, keep=keep).collect()
    assert len(rows) > 2000 and len(kept) < 45


def test_recursive_statement_reaches_whatever_the_depth(spark, tmp_path):
    """Each supplier leads to one other, and the start's line is longer than 14 steps."""
    from lodestone.plans import graph as plan

    n = 1001
    spark.range(1, n + 1).select(F.col("id").alias("s_suppkey"), F.lit(-1.0).alias("s_acctbal")).write.parquet(f"{tmp_path}/supplier.parquet")
    want, at = {3}, 3
    while at and (at := (2 * at + 1) % n) not in want:
        want.add(at)
    assert len(want) > 15
    assert sorted(r[0] for r in plan.graph_reachable_sql(spark, str(tmp_path)).collect()) == sorted(want)
