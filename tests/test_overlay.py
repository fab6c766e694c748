"""Cases over shared context against loading every case on its own."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.operators import overlay as V
from plumbline.operators.quality import rule_counts
from plumbline.operators.rules import Rule, RuleError

NOW = "2026-06-30 00:00:00"
SCHEMAS = {"people": "id string, status string, since timestamp_ntz", "sales": "sale string, buyer string, amount int, at timestamp_ntz",
           "lines": "sale string, pos int, part int"}
KEYS = {"people": ["id"], "sales": ["sale"]}
RULES = [
    Rule("status", "invalid_category", "accepted_values", "people", "low", ("status",), {"column": "status", "values": ["a", "b"]}),
    Rule("one_person", "duplicate_identifier", "unique", "people", "low", ("id",)),
    Rule("one_sale", "duplicate_identifier", "unique", "sales", "low", ("sale",)),
    Rule("buyer_exists", "broken_relationship", "relationship", "sales", "low", ("buyer",), {"column": "buyer", "to_asset": "people", "to_column": "id"}),
    Rule("after_join", "chronology", "chronology", "sales", "low", (),
         {"later_column": "at", "earlier_column": "since", "reference_asset": "people", "join": {"buyer": "id"}}),
    Rule("status_b_pays", "business_rule", "join_condition", "sales", "low", ("amount",),
         {"reference_asset": "people", "join": {"buyer": "id"}, "invalid_when": "r.status = 'b' AND p.amount < 3"}),
    Rule("parts_add_up", "reconciliation", "aggregate_reconciliation", "sales", "low", ("amount",),
         {"child_asset": "lines", "join": {"sale": "sale"}, "primary_expression": "p.amount", "child_aggregate": "sum(c.part)"}),
    Rule("free_has_lines", "business_rule", "row_condition", "sales", "low", ("amount",),
         {"invalid_when": "amount = 0 AND NOT EXISTS (SELECT 1 FROM {ref:lines} l WHERE l.sale = p.sale)"}),
    Rule("positive", "invalid_numeric", "range", "sales", "low", ("amount",), {"column": "amount", "min": 0}, where="buyer IS NOT NULL"),
]


def rows_of(pick, scale):
    start = datetime(2026, 1, 1)

    def day():
        return start + timedelta(days=pick.randrange(20))

    people = [(pick.choice([None, *"PQRSTUV"]), pick.choice("aaabx"), day()) for _ in range(pick.randrange(scale))]
    sales = [(pick.choice([None, "s1", "s2", "s3", "s4", "s5", "s6"]), pick.choice([None, *"PQRSTUV"]), pick.choice([-1, 0, 2, 5, 5]), day())
             for _ in range(pick.randrange(scale))]
    lines = [(pick.choice([None, "s1", "s2", "s3", "s4", "s5", "s6"]), k, pick.choice([0, 2, 3, 5])) for k in range(pick.randrange(scale))]
    return {"people": people, "sales": sales, "lines": lines}


def test_like_one_load_per_case(spark):
    pick = random.Random(11)
    shared = rows_of(pick, 7)
    # The context itself has a defect that some cases replace and most do not.
    shared["people"].append(("W", "broken", datetime(2026, 1, 1)))
    cases = {f"c{i}": rows_of(pick, 4) for i in range(9)}
    cases["c0"]["people"].append(("W", "a", datetime(2026, 1, 1)))
    cases["c3"]["people"] += [("W", "a", datetime(2026, 1, 1)), ("W", "a", datetime(2026, 1, 1))]
    cases["none"] = {"people": [], "sales": [], "lines": []}
    own = {t: spark.createDataFrame([(c, *r) for c, rows in cases.items() for r in rows[t]], f"case_id string, {s}") for t, s in SCHEMAS.items()}
    context = {t: spark.createDataFrame(shared[t], s) for t, s in SCHEMAS.items()}
    labels = spark.createDataFrame([(c, "valid", None) for c in cases], "case_id string, expected string, defect_category string")
    totals, differences = V.failing_with_context(own, context, KEYS, RULES, NOW)
    counts = {case: {r.rule_key: r.failed for r in totals.collect()} for case in cases}
    for r in differences.collect():
        counts[r.case_id][r.rule_key] += r.failed
    got = {r.case_id: list(r.triggered_rules) for r in V.predict_with_context(own, context, KEYS, RULES, labels, NOW).collect()}
    place = {"people": 0, "sales": 0}
    loaded = {}
    for case, rows in cases.items():
        for t in SCHEMAS:
            brought = {r[place[t]] for r in rows[t]} - {None} if t in KEYS else set()
            kept = [r for r in shared[t] if t not in KEYS or r[place[t]] not in brought]
            loaded.setdefault(t, []).extend((case, *r) for r in kept + rows[t])
    want = {}
    for case in cases:
        tables = {t: spark.createDataFrame([r[1:] for r in loaded[t] if r[0] == case], s) for t, s in SCHEMAS.items()}
        want[case] = {r.rule_key: r.failed for r in rule_counts(spark, tables, RULES, NOW).collect()}
    assert counts == want
    assert got == {case: sorted(k for k, n in v.items() if n) for case, v in want.items()}
    assert "status" in got["none"] and len({tuple(v.values()) for v in want.values()}) >= 6


def test_context_of_other_assets_only(spark):
    own = {"sales": spark.createDataFrame([("c", "s1", "P", 5, datetime(2026, 2, 1)), ("d", "s1", "Q", 5, datetime(2026, 2, 1))], "case_id string, " + SCHEMAS["sales"])}
    shared = {"people": spark.createDataFrame([("P", "a", datetime(2026, 1, 1))], SCHEMAS["people"]), "lines": spark.createDataFrame([], SCHEMAS["lines"])}
    totals, differences = V.failing_with_context(own, shared, KEYS, RULES, NOW)
    assert totals.filter("failed > 0").count() == 0
    assert {(r.case_id, r.rule_key) for r in differences.filter("failed > 0").collect()} == {("d", "buyer_exists")}
    with pytest.raises(RuleError):
        V.reference(Rule("x", "business_rule", "row_condition", "sales", "low", (), {"invalid_when": "NOT EXISTS (SELECT 1 FROM {ref:lines} l WHERE l.part > p.amount)"}))
    assert differences.select(F.count("*")).first()[0] >= 1


def test_rules_on_own_assets_need_no_context(spark, monkeypatch):
    """Rules on assets that are not both brought and shared are judged once, without differences."""
    judged, differences = [], V._set_differences
    monkeypatch.setattr(V, "_set_differences", lambda rule, *more: judged.append(rule.key) or differences(rule, *more))
    at = datetime(2026, 2, 1)
    own = {"sales": spark.createDataFrame([("c", "s1", "P", 5, at), ("d", "s1", "Q", 5, at), ("d", "s1", "P", 2, at)], "case_id string, " + SCHEMAS["sales"]),
           "lines": spark.createDataFrame([("c", "s1", 1, 5), ("d", "s1", 1, 5)], "case_id string, " + SCHEMAS["lines"])}
    shared = {"people": spark.createDataFrame([("P", "a", datetime(2026, 1, 1)), ("P", "b", datetime(2026, 3, 1))], SCHEMAS["people"])}
    totals, found = V.failing_with_context(own, shared, KEYS, RULES, NOW)
    assert {r.rule_key: r.failed for r in totals.collect()} == {**{r.key: 0 for r in RULES}, "one_person": 2}
    assert {(r.case_id, r.rule_key): r.failed for r in found.collect()} == {
        ("c", "after_join"): 1, ("d", "after_join"): 1, ("d", "buyer_exists"): 1, ("d", "one_sale"): 2, ("d", "parts_add_up"): 1, ("d", "status_b_pays"): 1}
    assert judged == ["one_person"]
