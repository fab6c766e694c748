"""Queries: rule types, runs, samples, as-of and back-fill."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from plumbline.operators import quality as Q
from plumbline.operators.rules import Rule, select_ruleset
from plumbline.plans.model_sql import with_models
from plumbline.sources.driver_tables import CUTOFF
from plumbline.suite import rule_sql as S
from plumbline.suite.common import Bed, plain

RULES = list(S.RULES.values())
QUERIES = {}
ORACLE = {}

_LAST_DAY = date(2001, 8, 1)
_DAYS = 14


def _report(df):
    return df.select("rule_key", "scanned", "failed", "status", F.round("failure_rate", 6).alias("failure_rate"))


def _run(keys, as_of=CUTOFF, loaded=False):
    chosen = [S.RULES[k] for k in keys]
    return lambda spark, folder: _report(Q.with_status(
        Q.rule_counts(spark, Bed(spark, folder).staging, chosen, as_of, loaded)))


def _of_type(kind, keep=lambda r: True):
    return [r.key for r in RULES if r.type == kind and keep(r)]


_same_row = lambda r: not r.params.get("reference_asset")

for _name, _keys in {
    "q1_not_null": _of_type("not_null"),
    "q2_unique": _of_type("unique"),
    "q3_relationship": _of_type("relationship"),
    "q4_accepted_values": _of_type("accepted_values"),
    "q5_range": _of_type("range"),
    "q6_not_future": _of_type("not_future"),
    "q7a_chronology_same_row": _of_type("chronology", _same_row),
    "q7b_chronology_across_assets": _of_type("chronology", lambda r: not _same_row(r)),
    "q8_row_condition": _of_type("row_condition"),
    "q9_join_condition": _of_type("join_condition"),
    "q10_aggregate_reconciliation": _of_type("aggregate_reconciliation"),
    "q11_run_improved_ruleset": [r.key for r in select_ruleset(RULES, "improved")],
    "q11_run_all_rules": [r.key for r in RULES],
}.items():
    QUERIES[_name] = _run(_keys)
    ORACLE[_name] = S.results_sql(_keys)

QUERIES["q14_run_as_of"] = _run([r.key for r in RULES], "1999-06-30 23:59:59", True)
ORACLE["q14_run_as_of"] = S.results_sql([r.key for r in RULES], "1999-06-30 23:59:59", True)


def _backfill(spark, folder):
    runs = Q.backfill(spark, Bed(spark, folder).staging, select_ruleset(RULES, "improved"), _LAST_DAY, _DAYS)
    return plain(runs.select("rule_key", "as_of", "scanned", "failed", "status",
                             F.round("failure_rate", 6).alias("failure_rate")))


QUERIES["q15_backfill_14_days"] = _backfill
ORACLE["q15_backfill_14_days"] = with_models(
    f"SELECT CAST(as_of AS VARCHAR) AS as_of, {S.RESULT_COLUMNS} FROM (" + "\nUNION ALL ".join(
        S.counts_sql([r.key for r in select_ruleset(RULES, "improved")], str(c), True, f", TIMESTAMP '{c}' AS as_of")
        for c in Q.backfill_days(_LAST_DAY, _DAYS)) + ") AS x")


# Samples: first five failing rows per rule by the first column.
_FIRST = {"stg_orders": "order_id", "stg_payments": "payment_id", "stg_refunds": "refund_id",
          "stg_subscriptions": "subscription_id", "stg_tickets": "ticket_id", "stg_customers": "customer_id",
          "stg_order_items": "order_item_id"}
_SAMPLED = ["orders_order_id_not_null", "orders_order_id_unique", "orders_customer_exists",
            "payments_after_order", "payments_customer_matches_order", "refunds_cumulative_not_exceeding_payment",
            "tickets_csat_in_range", "order_items_line_amount_formula", "payments_succeeded_amount_valid"]


def _samples(spark, folder):
    tables = Bed(spark, folder).staging
    frames = []
    for key in _SAMPLED:
        rule = S.RULES[key]
        rows = Q.samples(tables, rule, CUTOFF)
        frames.append(rows.select("rule_key", F.get_json_object("row", f"$.{_FIRST[rule.asset]}").alias("first_value")))
    return Q._union(frames)


QUERIES["q12_failing_samples"] = _samples
ORACLE["q12_failing_samples"] = with_models("\nUNION ALL ".join(
    f"(SELECT '{k}' AS rule_key, v AS first_value FROM ("
    f"{S.failing_sql(k, 'p.' + _FIRST[S.RULES[k].asset] + ' AS v')}) AS x ORDER BY v NULLS LAST LIMIT 5)"
    for k in _SAMPLED))


def _rulesets(spark, folder):
    """Superseded rules next to their successors."""
    from plumbline.operators.rules import rules_frame
    tables = Bed(spark, folder).staging
    catalogue = rules_frame(spark, RULES)
    counts = Q.rule_counts(spark, tables, [r for r in RULES if r.supersedes or "improved" not in r.rulesets], CUTOFF)
    known = catalogue.join(counts, "rule_key")
    new = known.filter(F.array_contains("rulesets", "improved") & F.col("supersedes").isNotNull())
    old = known.select(F.col("rule_key").alias("supersedes"), F.col("failed").alias("baseline_failed"))
    return new.join(old, "supersedes").select(
        "rule_key", "supersedes", F.col("failed").alias("improved_failed"), "baseline_failed")


QUERIES["q13_superseded_rules"] = _rulesets
ORACLE["q13_superseded_rules"] = with_models(
    "SELECT n.rule_key, m.old AS supersedes, n.failed AS improved_failed, o.failed AS baseline_failed FROM ("
    + S.counts_sql(["payments_succeeded_amount_valid", "refunds_cumulative_not_exceeding_payment"]) + ") AS n JOIN ("
    "VALUES ('payments_succeeded_amount_valid', 'payments_succeeded_amount_positive'), "
    "('refunds_cumulative_not_exceeding_payment', 'refunds_not_exceeding_payment')) AS m(new, old) "
    "ON m.new = n.rule_key JOIN ("
    + S.counts_sql(["payments_succeeded_amount_positive", "refunds_not_exceeding_payment"])
    + ") AS o ON o.rule_key = m.old")


_BROKEN = [
    Rule("ghost_parent", "broken_relationship", "relationship", "stg_orders", "low",
         params={"column": "customer_id", "to_asset": "ghosts", "to_column": "id"}),
    Rule("ghost_column", "missing_identifier", "not_null", "stg_orders", "low", ("no_such_column",)),
]
_NEIGHBOURS = ["orders_order_id_not_null", "orders_order_id_unique", "orders_status_accepted_values"]


def _isolated(spark, folder):
    rules = [*_BROKEN, *[S.RULES[k] for k in _NEIGHBOURS]]
    return Q.with_status(Q.rule_counts(spark, Bed(spark, folder).staging, rules, CUTOFF)).select(
        "rule_key", "scanned", "failed", "status")


QUERIES["q16_error_isolation"] = _isolated
ORACLE["q16_error_isolation"] = with_models(
    "SELECT rule_key, scanned, failed, CASE WHEN failed > 0 THEN 'fail' ELSE 'pass' END AS status FROM ("
    + S.counts_sql(_NEIGHBOURS) + ") AS x UNION ALL SELECT 'ghost_parent', 0, 0, 'error' "
    "UNION ALL SELECT 'ghost_column', 0, 0, 'error'")


def _failing_join(spark, folder):
    rows = Q.failing_rows(Bed(spark, folder).staging, S.RULES["payments_customer_matches_order"], CUTOFF)
    return rows.select("payment_id", "order_id", "customer_id", "reference_customer_id")


QUERIES["q18_failing_rows_with_context"] = _failing_join
ORACLE["q18_failing_rows_with_context"] = with_models(
    "SELECT p.payment_id, p.order_id, p.customer_id, (SELECT MIN(o.customer_id) FROM stg_orders AS o "
    "WHERE o.order_id = p.order_id AND o.customer_id IS DISTINCT FROM p.customer_id) AS reference_customer_id "
    "FROM stg_payments AS p WHERE " + S.predicate("payments_customer_matches_order"))


def _failing_total(spark, folder):
    rows = Q.failing_rows(Bed(spark, folder).staging, S.RULES["refunds_cumulative_not_exceeding_payment"], CUTOFF)
    return plain(rows.select("payment_id", "amount", "reconciled_value"))


QUERIES["q18_failing_rows_reconciled"] = _failing_total
ORACLE["q18_failing_rows_reconciled"] = with_models(
    "SELECT p.payment_id, CAST(p.amount AS DOUBLE) AS amount, CAST(a.v AS DOUBLE) AS reconciled_value "
    "FROM stg_payments AS p JOIN (SELECT payment_id, SUM(refund_amount) AS v FROM stg_refunds GROUP BY 1) AS a "
    "USING (payment_id) WHERE a.v - p.amount > 0.01")


def _failing_copies(spark, folder):
    rows = Q.failing_rows(Bed(spark, folder).staging, S.RULES["order_items_order_item_id_unique"], CUTOFF)
    return plain(rows.select("order_item_id", "product_id", "quantity", "duplicate_count"))


QUERIES["q18_failing_rows_duplicates"] = _failing_copies
ORACLE["q18_failing_rows_duplicates"] = with_models(
    "SELECT p.order_item_id, p.product_id, CAST(p.quantity AS BIGINT) AS quantity, a.n AS duplicate_count "
    "FROM stg_order_items AS p JOIN (SELECT order_item_id, COUNT(*) AS n FROM stg_order_items GROUP BY 1 "
    "HAVING n > 1) AS a USING (order_item_id)")
