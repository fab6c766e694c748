"""Rules that look up the same key meet its partners once; copies by day are one aggregate per key."""

import re
from datetime import date, datetime

from plumbline.operators import quality as Q
from plumbline.operators.rules import Rule

KEY = {"order_id": "order_id"}
RULES = [
    Rule("known", "broken_relationship", "relationship", "pay", "high", ("order_id",),
         {"column": "order_id", "to_asset": "ord", "to_column": "order_id"}),
    Rule("after", "chronology", "chronology", "pay", "high", ("at",),
         {"later_column": "at", "reference_asset": "ord", "join": KEY, "earlier_column": "at"}),
    Rule("currency", "financial_consistency", "join_condition", "pay", "high", ("currency",),
         {"reference_asset": "ord", "join": KEY, "compare": ("currency", "different", "currency"), "context_columns": ["currency"]}),
    Rule("owner", "business_rule", "join_condition", "pay", "high", ("owner",),
         {"reference_asset": "ord", "join": KEY, "compare": ("owner", "distinct", "owner"), "context_columns": ["owner"]}),
    Rule("refunded", "financial_consistency", "aggregate_reconciliation", "pay", "high", ("amount",),
         {"child_asset": "ref", "join": KEY, "child_where": "c.good", "primary_expression": "p.amount",
          "child_aggregate": "sum(c.amount)", "comparison": "child_lte_primary", "tolerance": 0.01}),
]


def _at(day):
    return None if day is None else datetime(2024, 1, day, 12)


def _tables(spark):
    orders = [("a", _at(2), "X", "c1"), ("a", _at(3), "Y", "c1"), ("b", None, None, None), ("b", _at(1), "X", "c2"), (None, _at(9), "X", "c3")]
    pays = [("a", _at(2), "X", "c1", 5), ("a", _at(4), "Y", None, 1), ("b", _at(1), "X", "c2", 9), ("b", None, "Y", None, 2),
            ("z", _at(1), "X", "c1", 1), (None, _at(1), "X", "c1", 1), ("z", _at(1), "X", "c1", 1)] + [("a", _at(1), "X", "c1", 3)] * 40
    refs = [("a", 3, True), ("a", 1, True), ("a", 99, False), ("b", 50, None), (None, 7, True), ("b", None, True)]
    return {
        "pay": spark.createDataFrame([(*p[:4], p[4], _at(1 + i % 3)) for i, p in enumerate(pays)],
                                     "order_id string, at timestamp_ntz, currency string, owner string, amount int, loaded_at timestamp_ntz"),
        "ord": spark.createDataFrame(orders, "order_id string, at timestamp_ntz, currency string, owner string"),
        "ref": spark.createDataFrame(refs, "order_id string, amount int, good boolean"),
    }


def _joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_rules_on_one_key_share_one_lookup(spark):
    tables = _tables(spark)
    counts = Q.rule_counts(spark, tables, RULES, "2024-02-01 00:00:00")
    got = {r.rule_key: r.failed for r in counts.collect()}
    # The failing rows of a rule are found one by one, by another plan.
    assert got == {r.key: Q.failing_rows(tables, r, "2024-02-01 00:00:00").count() for r in RULES}
    assert got == {"known": 2, "after": 41, "currency": 43, "owner": 3, "refunded": 41}
    assert _joins(counts) == 2  # orders and refunds, each once


def test_lookups_by_day_and_by_case(spark):
    tables = _tables(spark)
    found = {(r.rule_key, r.as_of.day): r.failed for r in Q.backfill(spark, tables, RULES, date(2024, 1, 3), 3).collect()}
    for rule in RULES:
        for day in (1, 2, 3):
            assert found[rule.key, day] == Q.failing_rows(tables, rule, f"2024-01-0{day} 23:59:59", True).count()
    cased = {k: df.selectExpr("*", "'k1' AS case_id").union(df.selectExpr("*", "'k2' AS case_id")) for k, df in tables.items()}
    by_case = {(r.case_id, r.rule_key): r.failed for r in Q.failing_by_case(cased, RULES, "2024-02-01 00:00:00").collect()}
    whole = {r.key: Q.failing_rows(tables, r, "2024-02-01 00:00:00").count() for r in RULES}
    assert by_case == {(c, k): n for c in ("k1", "k2") for k, n in whole.items()}


def test_a_rule_that_cannot_be_planned_leaves_its_group_alone(spark):
    bad = Rule("bad", "chronology", "chronology", "pay", "high", ("at",),
               {"later_column": "at", "reference_asset": "ord", "join": KEY, "earlier_column": "missing"})
    got = {r.rule_key: (r.failed, r.error is None) for r in Q.rule_counts(spark, _tables(spark), [*RULES, bad], "2024-02-01 00:00:00").collect()}
    assert got.pop("bad") == (0, False)
    assert got == {"known": (2, True), "after": (41, True), "currency": (43, True), "owner": (3, True), "refunded": (41, True)}


def test_only_keys_with_copies_are_followed_by_day(spark):
    rows = [("a", 1), ("b", 1), ("b", 1), ("c", 1), ("c", 3), ("d", 2), ("d", 3), ("d", 3), (None, 1), (None, 1)] + [("hot", 2)] * 30
    table = spark.createDataFrame([(k, _at(d)) for k, d in rows], "k string, loaded_at timestamp_ntz")
    rule = Rule("u", "duplicate_identifier", "unique", "t", "high", ("k",))
    out = Q.backfill(spark, {"t": table}, [rule], date(2024, 1, 3), 3)
    assert {(r.as_of.day, r.scanned, r.failed) for r in out.collect()} == {(1, 6, 2), (2, 37, 32), (3, 40, 37)}
    # Keys without copies never reach the window.
    plan = out._jdf.queryExecution().analyzed().toString()
    assert re.search(r"Filter \(_n#\d+L? > ", plan)
