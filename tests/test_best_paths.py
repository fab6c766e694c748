"""The best paths between assets against all simple paths, whichever end they grow from, with and without cycles."""

import random

import pytest

from plumbline.operators import lineage as L


def simple_paths(pairs, source, target):
    found, growing = [], [[source]]
    while growing:
        growing = [[*p, d] for p in growing for u, d in sorted(set(pairs)) if u == p[-1] and d not in p]
        found += [p for p in growing if p[-1] == target]
        growing = [p for p in growing if p[-1] != target]
    return sorted(found, key=lambda p: (len(p), p))


@pytest.mark.parametrize(("ends", "cycles", "limits"), [(("a", "hij"), False, (2, 50)), (("abc", "j"), False, (2,)), (("ab", "j"), True, (3,))])
def test_like_all_simple_paths(spark, ends, cycles, limits):
    pick = random.Random(5)
    nodes = "abcdefghij"
    pairs = [p for p in ((pick.choice(nodes), pick.choice(nodes)) for _ in range(30)) if p[0] < p[1] or cycles and p[0] != p[1] and pick.random() < 0.4]
    edges = spark.createDataFrame([*pairs, *pairs[:5], (None, "j"), ("a", None)], "upstream string, downstream string")
    asked = spark.createDataFrame([(s, t) for s in ends[0] for t in ends[1]] + [("a", "a"), (None, "j")], "source string, target string")
    for limit in limits:
        got = {(r["source"], r["target"], r["rank"]): r["path"] for r in L.all_paths(edges, asked, limit).collect()}
        assert got == {(s, t, i): p for s in ends[0] for t in ends[1] for i, p in enumerate(simple_paths(pairs, s, t)[:limit], 1)}


def test_partial_paths_are_no_more_than_the_limit(spark, monkeypatch):
    written, checkpoint = [], L.checkpoint

    def record(df):
        out = checkpoint(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(L, "checkpoint", record)
    layers = [["s"], *[[f"{k}{i}" for i in range(4)] for k in "abcd"], ["t"]]
    edges = spark.createDataFrame([(u, d) for a, b in zip(layers, layers[1:]) for u in a for d in b], "upstream string, downstream string")
    asked = spark.createDataFrame([("s", "t")], "source string, target string")
    assert L.all_paths(edges, asked, 2).count() == 2
    assert max(written) <= edges.count()  # 256 paths in all
