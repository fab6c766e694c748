import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.functions.scalars import whole_months
from plumbline.operators import evaluation as E
from plumbline.operators import issues as I
from plumbline.operators import quality as Q
from plumbline.operators.rules import rules_frame, select_ruleset
from plumbline.plans.rulebook import commerce_rules
from plumbline.plans.staging import enforce, stage
from plumbline.sources.schemas import STAGING
from plumbline.sources.tables import upsert

CONTEXT = {
    "stg_customers": [{"customer_id": f"C{i}", "email": f"c{i}@x", "customer_status": "active",
                       "signed_up_at": "2025-01-01 09:00:00"} for i in (1, 2)],
    "stg_products": [{"product_id": "P1", "category": "beans", "list_price": 20}],
}


def order(oid, total=20.0, customer="C1", **more):
    return {"order_id": oid, "customer_id": customer, "order_status": "delivered", "currency": "USD", "subtotal_amount": total,
            "discount_amount": 0, "shipping_amount": 0, "tax_amount": 0, "total_amount": total,
            "ordered_at": "2026-06-02 10:00:00", **more}


def payment(pid, oid, amount=20.0, customer="C1", at="2026-06-02 10:01:00", **more):
    return {"payment_id": pid, "order_id": oid, "customer_id": customer, "payment_status": "succeeded", "amount": amount,
            "currency": "USD", "processed_at": at, **more}


def refund(rid, pid, amount):
    return {"refund_id": rid, "payment_id": pid, "refund_amount": amount, "refunded_at": "2026-06-10 10:00:00"}


def case(orders=(), payments=(), refunds=(), **more):
    return {"stg_orders": list(orders), "stg_payments": list(payments), "stg_refunds": list(refunds), **more}


CASES = {
    "EV-001": (case([order("A")], [payment("a", "A")]), None),
    "EV-002": (case([order("A"), order("A")], [payment("a", "A")]), "duplicate_identifier"),
    "EV-003": (case([order("A", customer="C9")], [payment("a", "A", customer="C9")]), "broken_relationship"),
    "EV-004": (case([order("A")], [payment("a", "A", 12.0), payment("b", "A", 8.0)]), None),
    "EV-005": (case([order("A")], [payment("a", "A", at="2026-06-02 10:00:00")]), None),
    "EV-006": (case([order("A")], [payment("a", "A", at="2026-06-02 09:00:00")]), "chronology"),
    "EV-007": (case([order("A")], [payment("a", "A")], [refund("r", "a", 12), refund("s", "a", 8)]), None),
    "EV-008": (case([order("A", total_amount=21.0)], [payment("a", "A", 21.0)]), "reconciliation"),
    "EV-009": (case([order("A", ordered_at="2026-06-30 23:58:59")],
                    [payment("a", "A", at="2026-06-30 23:59:30")]), None),
    "EV-010": (case([order("A")], [payment("a", "A", customer="C2")]), "business_rule"),
    "EV-011": (case([order("A")], [payment("a", "A")], [refund("r", "a", 12), refund("s", "a", 11)]), "financial_consistency"),
    "EV-012": (case([order("A", 0.0)], [payment("a", "A", 0.0)]), None),
    "EV-013": (case([order("A")], [payment("a", "A", 0.0)]), "invalid_numeric"),
}


@pytest.fixture(scope="module")
def predictions(spark):
    tables = E.load_records(spark, STAGING, {k: v[0] for k, v in CASES.items()}, CONTEXT)
    labels = spark.createDataFrame([(k, "defective" if c else "valid", c) for k, (_, c) in CASES.items()],
                                   "case_id string, expected string, defect_category string")
    assert E.label_problems(labels).count() == 0
    rules = commerce_rules()
    return {r: E.predict(tables, select_ruleset(rules, r), labels, "2026-06-30 23:59:59").cache()
            for r in ("baseline", "improved")}


def test_cases_are_isolated_and_measured(spark, predictions):
    wrong = {r["case_id"]: r["outcome"] for r in predictions["baseline"].filter("outcome IN ('FN', 'FP')").collect()}
    assert wrong == {"EV-010": "FN", "EV-011": "FN", "EV-012": "FP"}
    assert predictions["improved"].filter("outcome IN ('FN', 'FP')").count() == 0
    (m,) = E.confusion(predictions["baseline"]).collect()
    assert (m["tp"], m["fn"], m["fp"], m["tn"]) == (5, 2, 1, 5)
    assert (m["accuracy"], m["recall"], m["f1_score"]) == (0.7692, 0.7143, 0.7692)
    fixes = {r["case_id"]: r["fixes"] for r in E.error_fixes(
        predictions["baseline"], predictions["improved"], rules_frame(spark, commerce_rules())).collect()}
    assert fixes == {"EV-010": ["payments_customer_matches_order"], "EV-012": ["payments_succeeded_amount_valid"],
                     "EV-011": ["refunds_cumulative_not_exceeding_payment"]}
    assert E.regressions(predictions["baseline"], predictions["improved"]).count() == 0


def test_degenerate_matrices(spark):
    only = spark.createDataFrame([("a", "TN")], "case_id string, outcome string")
    (m,) = E.confusion(only).collect()
    assert (m["accuracy"], m["precision"], m["recall"], m["f1_score"], m["specificity"]) == (1.0, None, None, None, 1.0)


def test_suites_are_checked(spark):
    with pytest.raises(ValueError, match="unknown table"):
        E.load_records(spark, STAGING, {"X": {"nope": [{}]}})
    with pytest.raises(ValueError, match="unknown columns"):
        E.load_records(spark, STAGING, {"X": {"stg_orders": [{"colour": 1}]}})


def test_suite_hash_ignores_order(spark):
    rows = [(f"c{i}", i) for i in range(50)]
    def hashed(order):
        return E.suite_hash(E.content_hash(spark.createDataFrame(order, "case_id string, v int"), "case_id")).first()[0]
    assert hashed(rows) == hashed(rows[::-1]) != hashed([*rows[:-1], ("c49", 0)])


def brute_force(events):
    """The lifecycle, one event at a time."""
    status, affected, log = None, None, []
    for kind, wish, failed in events:
        before = status
        if kind == "fail":
            name = "created" if status is None else "reopened" if status == "resolved" else (
                "redetected" if affected != failed else None)
            status, affected = (status if status in I.UNRESOLVED else "open"), failed
        elif kind == "pass":
            name = "auto_resolved" if status in I.UNRESOLVED else None
            status = "resolved" if name else status
        else:
            name = "status_change" if status is not None and wish in I.TRANSITIONS[status] else None
            status = wish if name else status
        if name:
            log.append((name, before, status))
    return status, log


def test_lifecycle_against_brute_force(spark):
    rng = random.Random(7)
    start, outcomes, actions, expected = datetime(2026, 1, 1), [], [], {}
    for r in range(40):
        events = []
        for i in range(12):
            at = start + timedelta(days=i)
            failed = rng.choice([0, 0, 3, 5])
            events.append(("fail" if failed else "pass", None, failed))
            outcomes.append((f"r{r}", i, at, "fail" if failed else "pass", 10, failed))
            if rng.random() < 0.5:
                wish = rng.choice(I.STATUSES)
                events.append(("action", wish, None))
                actions.append((f"r{r}", at + timedelta(hours=1), "action", wish, "x", None))
            if rng.random() < 0.2:  # an error between runs says nothing
                outcomes.append((f"r{r}", 100 + i, at + timedelta(hours=2), "error", 0, 0))
        expected[f"r{r}"] = brute_force(events)
    folded = I.fold(
        spark.createDataFrame(outcomes, "rule_key string, run_id int, as_of timestamp_ntz, status string, scanned int, failed int"),
        spark.createDataFrame(actions, "rule_key string, at timestamp_ntz, kind string, status string, actor string, note string"))
    state = {r["rule_key"]: r["status"] for r in I.current(folded).collect()}
    log = {k: [] for k in expected}
    for e in I.events(folded).orderBy("rule_key", "seq").collect():
        log[e["rule_key"]].append((e["event_type"], e["from_status"], e["to_status"]))
    assert {k: (state.get(k), log[k]) for k in expected} == expected


def test_whole_months(spark):
    pairs = [("2024-01-31", "2024-02-29", 0), ("2024-01-31", "2024-03-31", 2), ("2024-02-29", "2024-01-31", 0),
             ("2024-03-15", "2024-01-16", -1), ("2024-03-15", "2024-01-15", -2), ("2023-11-30", "2024-11-29", 11)]
    df = spark.createDataFrame(pairs, "a string, b string, want int").select(
        whole_months(F.col("a").cast("date"), F.col("b").cast("date")).alias("got"), "want")
    assert all(r["got"] == r["want"] for r in df.collect())


def test_staging_contract(spark):
    raw = spark.createDataFrame([("R", "P", 1.005, "why", None, None)],
                                "refund_id string, payment_id string, refund_amount double, refund_reason string, "
                                "refunded_at timestamp_ntz, _loaded_at timestamp_ntz")
    assert stage("refunds", raw).schema["refund_amount"].dataType.simpleString() == "decimal(12,2)"
    with pytest.raises(ValueError, match="missing columns"):
        enforce(raw, "stg_refunds")


def test_upsert_keeps_lost_rows_inactive(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string")
    rows = {r["k"]: (r["v"], r["is_active"]) for r in upsert(old, new, ["k"]).collect()}
    assert rows == {1: ("a", False), 2: ("B", True), 3: ("c", True)}
    assert upsert(old, new, ["k"], keep_missing=False).count() == 2


def test_a_long_failure_is_one_step(spark):
    """Runs without an action between them are folded once, and say the same as one by one."""
    start = datetime(2026, 1, 1)
    counts = [4] * 300 + [6] * 300 + [0] * 5 + [2] * 10
    outcomes = [("r", i, start + timedelta(days=i), "fail" if n else "pass", 10, n) for i, n in enumerate(counts)]
    schema = "rule_key string, run_id int, as_of timestamp_ntz, status string, scanned int, failed int"
    results = spark.createDataFrame(outcomes, schema)
    log = I.fold(results)
    assert [(e["event_type"], e["run_id"]) for e in I.events(log).orderBy("seq").collect()] == [
        ("created", 0), ("redetected", 300), ("auto_resolved", 600), ("reopened", 605)]
    (issue,) = I.current(log).collect()
    assert (issue["status"], issue["occurrences"], issue["affected_records"], issue["resolved_at"]) == ("open", 610, 2, None)
    spells = I.failing_spells(results).orderBy("first_run").collect()
    assert [(x["first_run"], x["runs"], x["peak"], x["ended_at"]) for x in spells] == [
        (0, 600, 6, start + timedelta(days=600)), (605, 10, 2, None)]


def test_triage_is_checked(spark):
    at = datetime(2026, 1, 1)
    rows = [("a", at, "action", "accepted", "  ann ", None), ("a", at, "action", "gone", "ann", None), ("a", at, "comment", None, "ann", " x " * 2000),
            ("a", at, "comment", None, "ann", "  "), ("a", at, "comment", None, "  ", "x"), ("a", at, "call", None, "ann", "x"), ("a", at, "comment", None, None, "x")]
    valid, invalid = I.triage(spark.createDataFrame(rows, "rule_key string, at timestamp_ntz, kind string, status string, actor string, note string"))
    kept = valid.collect()
    assert [r["actor"] for r in kept] == ["ann", "ann"] and {len(r["note"]) for r in kept if r["note"]} == {2000}
    assert sorted(r["problem"] for r in invalid.collect()) == ["empty comment", "no actor", "no actor", "unknown kind", "unknown status"]


def test_detail_pages_are_bounded(spark):
    at = datetime(2026, 1, 1)
    results = spark.createDataFrame([("r", i, at + timedelta(days=i), "fail", 100, 5 + i) for i in range(30)] + [("q", 0, at, "fail", 9, 1)],
                                    "rule_key string, run_id int, as_of timestamp_ntz, status string, scanned int, failed int")
    notes = spark.createDataFrame([("r", at + timedelta(days=i, hours=1), "comment", None, "ann", f"n{i}") for i in range(12)],
                                  "rule_key string, at timestamp_ntz, kind string, status string, actor string, note string")
    log = I.fold(results, notes)
    impacted = spark.createDataFrame([("r", f"a{i:02d}", "model", "mart", "high", "T", 1 + i // 10, True, ["s"]) for i in range(25)],
                                     "seed string, asset string, asset_type string, layer string, criticality string, owner string, depth int, "
                                     "is_critical boolean, path array<string>")
    contacts = spark.createDataFrame([("r", "T", False), ("r", "B", True)], "rule_key string, owner string, owns_broken_asset boolean")
    pages = {}
    for page in (1, 2):
        pages[page] = {r["rule_key"]: r for r in I.details(I.current(log), log, results, impacted, contacts, page, 10).collect()}
    one, two = pages[1]["r"], pages[2]["r"]
    assert [x["asset"] for x in one["impacts"] + two["impacts"]] == [f"a{i:02d}" for i in range(20)] and one["n_impacts"] == two["n_impacts"] == 25
    assert [x["note"] for x in one["comments"] + two["comments"]] == [f"n{i}" for i in range(11, -1, -1)]
    assert [x["failed"] for x in one["history"]] == list(range(34, 24, -1)) and one["n_history"] == 30 and one["n_events"] == 42
    assert [x["owner"] for x in one["contacts"]] == ["B", "T"] and two["contacts"] == []
    assert list(one["allowed_transitions"]) == ["accepted", "investigating", "resolved"]
    assert pages[1]["q"]["impacts"] == [] and pages[1]["q"]["n_comments"] == 0


def test_repaired_rows_do_not_fail_again(spark):
    at = datetime(2026, 1, 1)
    counts = {"a": [5, 7, 7, 9, 9, 12], "b": [3, 3, 3, 3, 3, 3], "c": [0, 0, 4, 2, 2, 6]}
    results = spark.createDataFrame([(k, at + timedelta(days=i), 100, n, None) for k, v in counts.items() for i, n in enumerate(v)],
                                    "rule_key string, as_of timestamp_ntz, scanned bigint, failed bigint, error string")
    repairs = spark.createDataFrame([("a", at + timedelta(days=1, hours=6)), ("a", at + timedelta(days=4, hours=1)), ("c", at + timedelta(days=2, hours=6)),
                                     ("x", at), ("b", at - timedelta(days=1))], "rule_key string, at timestamp_ntz")
    left = {}
    for r in Q.after_repairs(results, repairs).orderBy("rule_key", "as_of").collect():
        left.setdefault(r["rule_key"], []).append((r["failed"], r["status"]))
    assert {k: [n for n, _ in v] for k, v in left.items()} == {"a": [5, 7, 0, 2, 2, 3], "b": [3] * 6, "c": [0, 0, 4, 0, 0, 2]}
    assert all((n > 0) == (s == "fail") for v in left.values() for n, s in v)
