"""Every rule type on hand-made rows with known failing counts."""

import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest

from plumbline.operators import quality as Q
from plumbline.operators.quality import failing_rows, rule_counts
from plumbline.operators.rules import Rule, problems, select_ruleset
from plumbline.plans.rulebook import commerce_rules
from plumbline.sources.schemas import STAGING

AS_OF = "2026-09-30 23:59:59"


def ts(text):
    return datetime.fromisoformat(text)


@pytest.fixture(scope="module")
def tables(spark):
    def late(x):
        return ts(x) if x else None
    orders = [
        ("O1", "C1", "delivered", 40, "2026-09-01 10:00", "2026-09-01 11:00"),
        ("O2", "C2", "delivered", 25, "2026-09-02 10:00", "2026-09-02 11:00"),
        ("O2", "C2", "delivered", 25, "2026-09-02 10:00", "2026-09-29 11:00"),
        ("O3", "C9", "in_transit", 10, "2026-10-04 10:00", "2026-09-30 11:00"),
        (None, "C1", "delivered", -5, "2026-09-03 10:00", "2026-09-03 11:00"),
    ]
    return {
        "orders": spark.createDataFrame(
            [(a, b, c, Decimal(d), late(e), late(f)) for a, b, c, d, e, f in orders],
            "order_id string, customer_id string, order_status string, total_amount decimal(12,2), "
            "ordered_at timestamp_ntz, loaded_at timestamp_ntz"),
        "customers": spark.createDataFrame([("C1",), ("C2",)], "customer_id string"),
        "payments": spark.createDataFrame(
            [("P1", "O1", "C1", Decimal(40), ts("2026-09-01 10:05")), ("P2", "O2", "C1", Decimal(25), ts("2026-09-01 09:00"))],
            "payment_id string, order_id string, customer_id string, amount decimal(12,2), processed_at timestamp_ntz"),
        "refunds": spark.createDataFrame(
            [("R1", "P1", Decimal(30)), ("R2", "P1", Decimal(15)), ("R3", "P2", Decimal(5))],
            "refund_id string, payment_id string, refund_amount decimal(12,2)"),
    }


def rule(kind, asset="orders", columns=(), where=None, **params):
    return Rule(f"{kind}_{len(params)}_{bool(where)}", "business_rule", kind, asset, "high", tuple(columns), params, where)


MISMATCH = rule("join_condition", "payments", reference_asset="orders", join={"order_id": "order_id"},
                invalid_when="p.customer_id IS DISTINCT FROM r.customer_id", context_columns=["customer_id"])
CASES = [
    (rule("not_null", columns=["order_id"]), 1),
    (rule("unique", columns=["order_id"]), 2),
    (rule("relationship", column="customer_id", to_asset="customers", to_column="customer_id"), 1),
    (rule("accepted_values", column="order_status", values=["delivered", "cancelled"]), 1),
    (rule("range", column="total_amount", min=0), 1),
    (rule("range", where="order_status = 'delivered'", column="total_amount", min=0, min_exclusive=True), 1),
    (rule("not_future", column="ordered_at"), 1),
    (rule("not_future", column="ordered_at", tolerance_minutes=60 * 24 * 5), 0),
    (rule("chronology", "payments", later_column="processed_at", earlier_column="ordered_at", reference_asset="orders",
          join={"order_id": "order_id"}), 1),
    (rule("row_condition", invalid_when="p.order_status = 'in_transit' AND p.ordered_at > {reference_ts}"), 1),
    (rule("row_condition", invalid_when="NOT EXISTS (SELECT 1 FROM {ref:customers} c WHERE c.customer_id = p.customer_id)"), 1),
    (MISMATCH, 1),
    (rule("aggregate_reconciliation", "payments", child_asset="refunds", join={"payment_id": "payment_id"},
          primary_expression="p.amount", child_aggregate="sum(c.refund_amount)", comparison="child_lte_primary"), 1),
]


def test_every_type_finds_the_bad_rows(spark, tables):
    from dataclasses import replace
    rules = [replace(r, key=f"r{i}") for i, (r, _) in enumerate(CASES)]
    found = {r["rule_key"]: r["failed"] for r in Q.rule_counts(spark, tables, rules, AS_OF).collect()}
    assert found == {f"r{i}": n for i, (_, n) in enumerate(CASES)}


@pytest.mark.parametrize("index", range(len(CASES)))
def test_failing_rows_match_the_count(tables, index):
    rule_, expected = CASES[index]
    assert Q.failing_rows(tables, rule_, AS_OF).count() == expected


def test_samples_carry_context(tables):
    (row,) = Q.failing_rows(tables, MISMATCH, AS_OF).collect()
    assert (row["payment_id"], row["customer_id"], row["reference_customer_id"]) == ("P2", "C1", "C2")
    assert len(Q.samples(tables, CASES[1][0], AS_OF, size=1).collect()) == 1


def test_scope_limits_scanned_rows(spark, tables):
    r = rule("not_null", columns=["customer_id"], where="order_status = 'delivered'")
    (row,) = Q.with_status(Q.rule_counts(spark, tables, [r], AS_OF)).collect()
    assert (row["status"], row["scanned"], row["failed"]) == ("pass", 4, 0)


def test_load_cutoff(spark, tables):
    (row,) = Q.rule_counts(spark, tables, [CASES[1][0]], "2026-09-20 23:59:59", True).collect()
    assert (row["scanned"], row["failed"]) == (3, 0)


def test_broken_rules_are_isolated(spark, tables):
    ghosts = rule("relationship", column="customer_id", to_asset="ghosts", to_column="id")
    lost = rule("not_null", columns=["nope"])
    rules = [Rule("a", *[getattr(ghosts, f) for f in ("category", "type", "asset", "severity", "columns", "params")]),
             Rule("b", *[getattr(lost, f) for f in ("category", "type", "asset", "severity", "columns", "params")]),
             CASES[0][0]]
    rows = {r["rule_key"]: r for r in Q.run_rules(spark, tables, rules, AS_OF).collect()}
    assert rows["a"]["status"] == rows["b"]["status"] == "error" and "ghosts" in rows["a"]["error"]
    assert rows[CASES[0][0].key]["failed"] == 1


def test_run_time_errors_hit_only_their_rule(spark, tables):
    bad = Rule("bad_cast", "business_rule", "row_condition", "orders", "low", (), {
        "invalid_when": "CAST(order_status AS INT) > 1"})
    rows = {r["rule_key"]: r["status"] for r in Q.run_rules(spark, tables, [bad, CASES[0][0]], AS_OF).collect()}
    assert rows == {"bad_cast": "error", CASES[0][0].key: "fail"}


def test_backfill_equals_single_runs(spark, tables):
    from dataclasses import replace
    rules = [replace(r, key=f"r{i}") for i, (r, _) in enumerate(CASES)]
    runs = Q.backfill(spark, tables, rules, date(2026, 9, 30), 4).collect()
    assert len(runs) == 4 * len(rules)
    for day in Q.backfill_days(date(2026, 9, 30), 4):
        single = {r["rule_key"]: (r["scanned"], r["failed"])
                  for r in Q.rule_counts(spark, tables, rules, day, True).collect()}
        replayed = {r["rule_key"]: (r["scanned"], r["failed"]) for r in runs if r["as_of"] == day}
        assert replayed == single
    with pytest.raises(ValueError):
        Q.backfill_days(date(2026, 9, 30), 91)


def test_one_key_with_most_rows(spark):
    """A key that holds nearly all rows on both sides is counted exactly and never paired row by row."""
    n = 20_000
    left = spark.range(n).selectExpr("'K' AS k", "id % 3 AS v", "TIMESTAMP_NTZ '2026-01-01 00:00:00' AS at")
    right = spark.range(n).selectExpr("'K' AS k", "id % 2 AS v", "TIMESTAMP_NTZ '2026-01-02 00:00:00' AS at")
    tables = {"l": left, "r": right}
    join = {"k": "k"}
    rules = [
        Rule("join", "business_rule", "join_condition", "l", "low", ("v",), {
            "reference_asset": "r", "join": join, "invalid_when": "p.v > r.v + 1"}),
        Rule("time", "chronology", "chronology", "l", "low", ("at",), {
            "reference_asset": "r", "join": join, "later_column": "at", "earlier_column": "at"}),
        Rule("dup", "duplicate_identifier", "unique", "l", "low", ("k",)),
    ]
    got = {r["rule_key"]: r["failed"] for r in Q.rule_counts(spark, tables, rules, AS_OF).collect()}
    assert got == {"join": sum(1 for i in range(n) if i % 3 == 2), "time": n, "dup": n}
    assert Q.failing_rows(tables, rules[0], AS_OF).count() == got["join"]


def test_rulebook_totals_and_references():
    rules = commerce_rules()
    assert len(rules) == 56
    assert len(select_ruleset(rules, "baseline")) == 53 and len(select_ruleset(rules, "improved")) == 54
    assert problems(rules, {n: set(s.names) for n, s in STAGING.items()}) == []
    broken = [Rule("x", "chronology", "not_null", "nowhere", "high", ("c",)), Rule(
        "x", "oops", "what", "stg_orders", "huge", ("ghost",), supersedes="y")]
    text = " ".join(problems(broken, {"stg_orders": {"order_id"}}))
    for part in ("duplicate rule key", "unknown asset 'nowhere'", "unknown type", "unknown category", "unknown severity",
                 "supersedes unknown", "unknown column"):
        assert part in text


def test_comparisons_by_extremes_equal_pairs(spark):
    """A comparison with all partners of a key is decided by their extremes, as the free condition decides it by pairs."""
    rng = random.Random(12)
    values = [None, "1.00", "1.01", "2.00", "2.50", "9.99"]

    def rows(n):
        # A third of both sides has one key.
        return [(rng.choice(["hot", "a", "b", "c", None]) if rng.random() < 0.67 else "hot", None if (v := rng.choice(values)) is None else Decimal(v)) for _ in range(n)]

    schema = "k string, v decimal(12,2)"
    tables = {"left": spark.createDataFrame(rows(400), schema), "right": spark.createDataFrame(rows(400) + [("lone", None), ("same", Decimal("2.00"))], schema)}
    tables["left"] = tables["left"].unionByName(spark.createDataFrame([("lone", Decimal("1.00")), ("lone", None), ("same", Decimal("2.00")), ("same", None), ("same", Decimal("2.01"))], schema))
    free = {"above": "p.v > r.v + 0.01", "below": "p.v < r.v - 0.01", "different": "p.v <> r.v", "distinct": "p.v IS DISTINCT FROM r.v"}

    def rule(key, **how):
        return Rule(key, "business_rule", "join_condition", "left", "low", ("v",), {"reference_asset": "right", "join": {"k": "k"}, **how})

    rules = [rule(f"{k}_pairs", invalid_when=text) for k, text in free.items()] + [rule(f"{k}_extremes", compare=("v", k, "v", "0.01")) for k in free]
    found = {r["rule_key"]: r["failed"] for r in rule_counts(spark, tables, rules, "2026-01-01").collect()}
    assert all(found[f"{k}_pairs"] == found[f"{k}_extremes"] > 0 for k in free), found
    plan = rule_counts(spark, tables, [rules[-1]], "2026-01-01")._jdf.queryExecution().toString()
    assert "LeftSemi" not in plan
    shown = [sorted(map(tuple, failing_rows(tables, r, "2026-01-01").collect()), key=str) for r in (rules[0], rules[4])]
    assert shown[0] == shown[1]


def test_moving_rules_are_counted_off_when_they_pass(spark):
    """Times in the future pass when the runs reach them; fixed bounds never do. Every day equals a run of its own."""
    rng = random.Random(5)
    start = ts("2026-09-20 00:00:00")
    rows = [(rng.choice([None, start + timedelta(hours=rng.randrange(-40, 400))]), rng.choice([None, "a", "b"]),
             start + timedelta(hours=rng.randrange(-30, 300), microseconds=rng.choice([0, 1, 999_999]))) for _ in range(400)]
    rows += [(start + timedelta(days=3, hours=23, minutes=59, seconds=59), "a", start), (start + timedelta(days=3, hours=23, minutes=59, seconds=59, microseconds=1), "a", start)]
    tables = {"t": spark.createDataFrame(rows, "at timestamp_ntz, kind string, loaded_at timestamp_ntz")}
    rules = [
        Rule("future", "invalid_date", "not_future", "t", "low", ("at",), {"column": "at", "tolerance_minutes": 90}),
        Rule("scoped", "invalid_date", "not_future", "t", "low", ("at",), {"column": "at"}, where="kind = 'a'"),
        Rule("bounded", "invalid_date", "range", "t", "low", ("at",), {"column": "at", "min": "2026-09-20", "max_reference": True}),
        Rule("open", "invalid_date", "range", "t", "low", ("at",), {"column": "at", "max_reference": True}),
        Rule("free", "invalid_date", "row_condition", "t", "low", ("at",), {"invalid_when": "p.at > {reference_ts} AND p.kind = 'b'"}),
    ]
    got = {(r["as_of"], r["rule_key"]): (r["scanned"], r["failed"]) for r in Q.backfill(spark, tables, rules, date(2026, 9, 29), 9).collect()}
    want = {(day, r["rule_key"]): (r["scanned"], r["failed"]) for day in Q.backfill_days(date(2026, 9, 29), 9)
            for r in rule_counts(spark, tables, rules, day, True).collect()}
    assert got == want and len({v for (_, k), v in got.items() if k == "future"}) > 5
