import random
import re
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plumbline.operators import impact as B
from plumbline.operators import lineage as L
from plumbline.operators import priority as P
from plumbline.operators import profile as pr
from plumbline.plans import commerce_catalog as C


def ts(text):
    return datetime.fromisoformat(text)


@pytest.fixture(scope="module")
def sample(spark):
    rows = [(1, "a@x", "web", Decimal("10.0"), ts("2026-09-30 20:00")), (2, None, "web", Decimal("20.0"), ts("2026-09-30 21:00")),
            (3, "c@x", "app", None, ts("2026-09-29 08:00")), (4, "d@x", "web", Decimal("30.0"), ts("2026-10-02 08:00"))]
    return spark.createDataFrame(rows, "id int, email string, channel string, amount decimal(10,1), loaded_at timestamp_ntz")


TARGET = pr.Target("sample", ("id", "email", "channel", "amount", "not_there"), frozenset({"email"}), "loaded_at", 6)


def test_column_profiles(sample):
    rows = {r["column_name"]: r for r in pr.column_profiles(sample, TARGET).collect()}
    assert set(rows) == {"id", "email", "channel", "amount"}
    assert rows["id"]["uniqueness"] == 1.0 and rows["id"]["top_values"] == []
    assert (rows["email"]["null_count"], rows["email"]["null_rate"]) == (1, 0.25)
    assert rows["email"]["min_value"] is None and rows["email"]["sample_values"] == []
    assert [(t["value"], t["count"]) for t in rows["channel"]["top_values"]] == [("web", 3), ("app", 1)]
    amount = rows["amount"]
    assert (amount["mean_value"], amount["median_value"], amount["min_value"], amount["max_value"]) == (20, 20, "10.0", "30.0")


def test_freshness_ignores_later_rows(sample):
    (row,) = pr.asset_profile(sample, TARGET, "2026-09-30 23:59:59").collect()
    assert (row["row_count"], row["column_count"], row["freshness_lag_hours"], row["freshness_status"]) == (4, 4, 3.0, "fresh")


def test_missing_tables_are_reported(spark, sample):
    profiles, skipped = pr.profile_assets(spark, {"sample": sample}, [TARGET, pr.Target("gone", ("a",))], "2026-09-30 00:00:00")
    assert profiles.count() == 1 and list(skipped) == ["gone"]


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [5.0, -3.0, 1e300], [7.0] * 9 + [1.0], [float(i * i) for i in range(999)]])
def test_exact_medians(spark, values):
    import statistics
    df = spark.createDataFrame([(v, int(min(v, 1e9))) for v in values], "d double, i bigint")
    got = pr.exact_medians(df, ["d", "i"])
    assert got["d"] == statistics.median(values)
    assert got["i"] == statistics.median([int(min(v, 1e9)) for v in values])


NODES = [  # asset, type, layer, criticality, domain, owner, audience, financial, customer facing, system
    ("raw_a", "source", "raw", "critical", "shop", "Platform", None, False, False, "Shop"),
    ("stg_a", "model", "staging", "critical", "shop", "Shop", None, False, False, None),
    ("int_camp", "model", "intermediate", "low", "growth", "Growth", None, False, False, None),
    ("camp_report", "model", "mart", "low", "growth", "Growth", None, False, False, None),
    ("fct_a", "model", "mart", "critical", "shop", "Shop", None, True, False, None),
    ("fin_close", "model", "mart", "critical", "finance", "Finance", None, True, False, None),
    ("kpis", "model", "mart", "critical", "executive", "Finance", None, False, False, None),
    ("board", "exposure", "exposure", "critical", "executive", "Finance", "executive", False, False, None),
    ("ltv", "model", "mart", "high", "customer", "Customer", None, False, False, None),
    ("console", "exposure", "exposure", "high", "customer", "Care", None, False, True, None),
    ("raw_t", "source", "raw", "low", "help", "Platform", None, False, False, "Desk"),
    ("stg_t", "model", "staging", "low", "help", "Care", None, False, False, None),
    ("mix", "model", "mart", "low", "help", "Care", None, False, False, None),
]
EDGES = [
    ("raw_a", "stg_a", None), ("stg_a", "int_camp", ["campaign", "id"]), ("int_camp", "camp_report", None),
    ("stg_a", "fct_a", ["id", "customer", "total"]), ("fct_a", "fin_close", None), ("fin_close", "kpis", None),
    ("kpis", "board", None), ("fct_a", "ltv", None), ("ltv", "console", None), ("raw_t", "stg_t", None),
    ("stg_t", "mix", ["id", "channel"]),
]


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame(NODES, "asset string, asset_type string, layer string, criticality string, domain string, "
                                         "owner string, audience string, is_financial boolean, is_customer_facing boolean, "
                                         "source_system string")
    return nodes, spark.createDataFrame(EDGES, C.EDGE_SCHEMA)


def reached(spark, edges, asset, columns=None, down=True):
    seeds = spark.createDataFrame([(asset, asset, columns)], "seed string, asset string, columns array<string>")
    return {r["asset"]: r["depth"] for r in L.reach(edges, seeds if columns else seeds.drop("columns"), down).collect()}


def test_depths_and_pruning(spark, graph):
    _, edges = graph
    down = reached(spark, edges, "stg_a")
    assert (down["fct_a"], down["board"], down["console"]) == (1, 4, 3)
    assert reached(spark, edges, "fct_a", down=False) == {"stg_a": 1, "raw_a": 2}
    assert set(reached(spark, edges, "stg_a", ["campaign"])) == {"int_camp", "camp_report"}
    assert "int_camp" not in reached(spark, edges, "stg_a", ["total"])
    assert "stg_a" in reached(spark, edges, "raw_a", ["anything"])
    assert [r["asset"] for r in L.direct(edges, "stg_a").orderBy("asset").collect()] == ["fct_a", "int_camp"]


def test_paths_and_neighbourhood(spark, graph):
    nodes, edges = graph
    (row,) = L.shortest_path(edges, "raw_a", "board").collect()
    assert row["path"] == ["raw_a", "stg_a", "fct_a", "fin_close", "kpis", "board"]
    assert L.shortest_path(edges, "raw_t", "board").count() == 0
    pairs = spark.createDataFrame([("stg_a", "console"), ("stg_a", "stg_a")], "source string, target string")
    assert [r["path"] for r in L.all_paths(edges, pairs).collect()] == [["stg_a", "fct_a", "ltv", "console"]]
    keep, inside = L.neighbourhood(edges, "fct_a", 1, 1)
    assert {r["asset"] for r in keep.collect()} == {"stg_a", "fct_a", "fin_close", "ltv"} and inside.count() == 3
    (longest,) = L.longest_chain(edges).collect()
    assert (longest["length"], longest["path"][0], longest["path"][-1]) == (5, "raw_a", "board")


def test_cycles_and_dangling_edges(spark, graph):
    nodes, edges = graph
    assert L.assert_acyclic(edges) == 5
    loop = spark.createDataFrame([("a", "b", None), ("b", "a", None)], C.EDGE_SCHEMA)
    with pytest.raises(L.CycleError):
        L.assert_acyclic(loop)
    assert L.clean_edges(nodes, loop).count() == 0


def report(spark, graph, asset, columns):
    nodes, edges = graph
    defects = spark.createDataFrame([("d", asset, columns)], "seed string, asset string, columns array<string>")
    impacted = B.impacted_assets(edges, nodes, defects)
    return defects, impacted, B.impact_summary(edges, nodes, defects, impacted)


def test_impact(spark, graph):
    _, _, summary = report(spark, graph, "stg_a", ["total"])
    (s,) = summary.collect()
    assert s["financial"] and s["executive"] and s["customer_facing"]
    assert (s["hops_to_executive"], s["max_depth"], s["teams"][0]) == (3, 4, "Shop")
    (s,) = report(spark, graph, "stg_a", ["campaign"])[2].collect()
    assert s["unaffected_consumers"] == ["fct_a"] and s["teams"] == ["Shop", "Growth"] and not s["financial"]
    (s,) = report(spark, graph, "mix", [])[2].collect()
    assert s["downstream_count"] == 0 and s["hops_to_executive"] is None


def test_terms_and_sources(spark, graph):
    nodes, edges = graph
    defects, impacted, _ = report(spark, graph, "stg_a", ["customer"])
    terms = spark.createDataFrame([("n", "Net", "approved"), ("c", "Customer", "approved"), ("o", "Total", "approved"),
                                   ("x", "Old", "deprecated")], "term_key string, term string, status string")
    links = spark.createDataFrame([("n", "fct_a", None), ("c", "stg_a", "customer"), ("o", "stg_a", "total"),
                                   ("x", "fct_a", None)], "term_key string, asset string, column_name string")
    (row,) = B.touched_terms(defects, impacted, terms, links).collect()
    assert row["terms"] == ["Customer", "Net"]
    (row,) = B.source_systems(edges, nodes, defects).collect()
    assert row["systems"] == ["Shop"]


def scored(spark, graph, severity, failed, scanned, asset, columns, critical):
    _, _, summary = report(spark, graph, asset, columns)
    facts = spark.createDataFrame([("d", severity, failed, scanned, critical)],
                                  "seed string, severity string, failed bigint, scanned bigint, "
                                  "critical_columns array<struct<column_name:string,category:string>>")
    (row,) = P.score(facts.join(summary, "seed")).collect()
    return row


def test_small_important_defect_outranks_large_one(spark, graph):
    small = scored(spark, graph, "critical", 3, 22_000, "stg_a", [], [("id", "identifier")])
    large = scored(spark, graph, "low", 5_000, 12_000, "mix", ["channel"], [])
    assert small["priority_score"] > large["priority_score"] + 40
    assert small["priority_band"] in ("P1", "P2") and large["priority_band"] == "P4"
    assert large["pts_affected_volume"] > small["pts_affected_volume"]
    assert (large["impact_score"], large["impact_level"]) == (0, "none")
    assert sum(P.MAX_POINTS.values()) == 100
    near = scored(spark, graph, "low", 1, 10, "fin_close", [], [])
    far = scored(spark, graph, "low", 1, 10, "raw_a", [], [])
    assert near["pts_executive_or_customer_facing"] == 9 > far["pts_executive_or_customer_facing"] >= 5


def test_commerce_graph(spark):
    assert (len(C.assets()), len(C.dependencies()), len(C.columns())) == (44, 56, 389)
    assert L.longest_chain(C.edge_frame(spark)).first()["length"] == 11


def test_medians_of_odd_numbers(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1.0, 1.0, nan, -1.7e308, 5e-324, Decimal("9" * 38), Decimal("0." + "0" * 17 + "1")),
            (2.0, 2.0, nan, 0.0, 0.0, Decimal("-" + "9" * 38), Decimal("0." + "0" * 17 + "3")),
            (nan, inf, 1.0, 1.7e308, 1e-323, Decimal(1), Decimal("0." + "0" * 17 + "2")),
            (None, -inf, -inf, None, None, Decimal(2), None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f decimal(38,0), g decimal(38,18)")
    got = pr.exact_medians(df, df.columns)
    assert (got["a"], got["b"], got["d"], got["e"], got["f"]) == (2.0, 1.5, 0.0, 5e-324, 1.5)
    assert got["c"] != got["c"] and abs(got["g"] - 2e-18) < 1e-30


def test_words_of_any_alphabet(spark):
    edges = spark.createDataFrame([("up", "down")], "upstream string, downstream string")
    columns = spark.createDataFrame([("up", "r", 1), ("up", "für", 2), ("up", "日本", 3)], "asset string, column_name string, ordinal int")
    texts = spark.createDataFrame([("down", "gut für alle, 日本")], "asset string, text string")
    assert L.column_references(edges, columns, texts).collect()[0].referenced_columns == ["für", "日本"]


def test_word_references_meet_all_texts_with_all_assets(spark):
    pick = random.Random(4)
    words = [f"w{int(pick.paretovariate(0.7))}" for _ in range(60)] + ["für", "日本", "a_b"]
    columns = [(f"A{i}", w, k) for i in range(40) for k, w in enumerate(pick.choices(words, k=pick.randrange(1, 9)))]
    # "id" is owned by all assets and said by all texts.
    columns += [(f"A{i}", "id", 99) for i in range(40)] + [("A0", None, 3)]
    texts = [(f"T{i}", " ".join([*pick.choices(words, k=pick.randrange(9)), "id, id"])) for i in range(120)] + [("T0", "w1 für"), ("none", None), ("none", None), ("empty", "")]
    want = {}
    for asset, text in texts:
        for a in {c[0] for c in columns}:
            said = set(re.findall(r"\w+", text or ""))
            own = {}
            for c in columns:
                if c[0] == a and c[1] in said:
                    own[c[1]] = min(own.get(c[1], 99), c[2])
            if own:
                want.setdefault((a, asset), {}).update(own)
    want = {k: [w for _, w in sorted((n, w) for w, n in v.items())] for k, v in want.items()} | {(None, "none"): None}
    offered = spark.createDataFrame(columns, "asset string, column_name string, ordinal int")
    given = spark.createDataFrame(texts, "asset string, text string")
    # Split words and split index rows give the same as whole ones.
    for hot, postings in ((100_000, 1024), (7, 3)):
        rows = L.word_references(offered, given, hot, postings).collect()
        assert {(r.upstream, r.downstream): r.referenced_columns for r in rows} == want and len(rows) == len(want)
    assert max(len(r.owners) for r in L.word_index(offered, 3).collect()) == 3


def test_medians_by_both_ways(spark, monkeypatch):
    import statistics
    rng = random.Random(8)
    rows = [(rng.gauss(0, 1), rng.randrange(3), rng.randrange(10**15) * 10**3, None if rng.random() < 0.9 else rng.random(), 5.0 if i % 3 else rng.random() * 10, None)
            for i in range(20_001)]
    df = spark.createDataFrame(rows, "a double, b int, c bigint, d double, e double, f double").repartition(7)
    want = {name: statistics.median([float(r[k]) for r in rows if r[k] is not None]) for k, name in enumerate("abcde")} | {"f": None}
    assert pr.exact_medians(df, df.columns) == want
    # Brackets too full for one task are narrowed by histograms, brackets that miss the ranks as well.
    monkeypatch.setattr(pr, "_PICKED", 1)
    assert pr.exact_medians(df, df.columns) == want
    assert pr._pick(df.select(F.col("a")), [("a", 20_001, 5.0, 6.0)]) == {}
