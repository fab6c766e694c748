"""Lineage traversals: what a round carries along, and results that do not depend on how hops are grouped."""

import pytest

from plumbline.operators import lineage as L


@pytest.fixture
def written(monkeypatch):
    """(optimized plan, rows) of every table a traversal writes."""
    seen, checkpoint = [], L.checkpoint

    def record(df):
        out = checkpoint(df)
        seen.append((df._jdf.queryExecution().optimizedPlan().toString(), out.count()))
        return out

    monkeypatch.setattr(L, "checkpoint", record)
    return seen


def _edges(spark, pairs):
    return spark.createDataFrame([(u, d, None) for u, d in pairs], "upstream string, downstream string, referenced_columns array<string>")


def test_paths_grow_along_edges_of_their_target_only(spark, written):
    edges = _edges(spark, [("s", "h"), *[("h", f"t{i}") for i in range(5)], ("s", "t0")])
    pairs = spark.createDataFrame([("s", f"t{i}") for i in range(5)], "source string, target string")
    paths = {(r["target"], r["rank"]): r["path"] for r in L.all_paths(edges, pairs, 3).collect()}
    assert paths == {("t0", 1): ["s", "t0"], ("t0", 2): ["s", "h", "t0"], **{(f"t{i}", 1): ["s", "h", f"t{i}"] for i in range(1, 5)}}
    growing = [line for plan, _ in written if "array_contains" in plan for line in plan.splitlines() if "Join Inner" in line]
    assert growing and all("target" in line for line in growing)


def test_origins_hold_one_row_per_system_and_asset(spark, written):
    names = [f"a{i:02}" for i in range(20)]
    nodes = spark.createDataFrame([(n, "erp" if n == "a00" else None) for n in names], "asset string, source_system string")
    seeds = spark.createDataFrame([*[(n, n) for n in names], ("lost", "zz"), (None, None)], "seed string, asset string")
    found = {r["seed"]: r["systems"] for r in L.origin_systems(_edges(spark, zip(names, names[1:])), nodes, seeds).collect()}
    assert found == {**{n: ["erp"] for n in names}, "lost": [], None: []}
    assert sum(rows for plan, rows in written if "seed" in plan) <= len(names)


def test_reach_without_paths_and_by_single_hops(spark, monkeypatch):
    pairs = [("r", "a"), ("r", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "b"), ("r", "f"), ("x", None), (None, "g")]
    edges = _edges(spark, pairs)
    seeds = spark.createDataFrame([("r", "r"), ("c", "c"), ("x", "x")], "seed string, asset string")
    several = {tuple(map(str, r)) for r in L.reach(edges, seeds).collect()}
    monkeypatch.setattr(L, "SMALL_GRAPH", 0)
    single = {tuple(map(str, r)) for r in L.reach(edges, seeds).collect()}
    assert several == single and ("r", "d", "3", "['r', 'a', 'c', 'd']") in single
    bare = L.reach(edges, seeds, paths=False)
    assert bare.columns == ["seed", "asset", "depth"]
    assert {tuple(map(str, r)) for r in bare.collect()} == {r[:3] for r in single}
