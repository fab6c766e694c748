"""Each commerce rule as a plain SQL predicate over its asset, written independently of the rule engine.

``{P}`` is the asset as the run sees it, ``{now}`` the cutoff.
"""

from __future__ import annotations

from plumbline.plans.model_sql import with_models
from plumbline.plans.rulebook import commerce_rules
from plumbline.sources.driver_tables import CUTOFF, TRADING_START

_PREDICATES: dict[str, str] = {}

for _table, _column in (
    ("orders", "order_id"), ("orders", "customer_id"), ("order_items", "order_id"), ("payments", "payment_id"),
    ("payments", "order_id"), ("customers", "customer_id"), ("customers", "email"), ("subscriptions", "customer_id"),
):
    _PREDICATES[f"{_table}_{_column}_not_null"] = f"p.{_column} IS NULL"

for _table, _column in (
    ("orders", "order_id"), ("payments", "payment_id"), ("customers", "customer_id"),
    ("subscriptions", "subscription_id"), ("refunds", "refund_id"), ("order_items", "order_item_id"),
):
    _PREDICATES[f"{_table}_{_column}_unique"] = (
        f"p.{_column} IN (SELECT q.{_column} FROM {{P}} AS q GROUP BY q.{_column} HAVING COUNT(*) >= 2)")

for _rule, _column, _parent in (
    ("orders_customer", "customer_id", "customers"), ("order_items_order", "order_id", "orders"),
    ("order_items_product", "product_id", "products"), ("payments_order", "order_id", "orders"),
    ("payments_customer", "customer_id", "customers"), ("refunds_payment", "payment_id", "payments"),
    ("subscriptions_customer", "customer_id", "customers"), ("tickets_customer", "customer_id", "customers"),
    ("orders_campaign", "campaign_id", "campaigns"), ("orders_subscription", "subscription_id", "subscriptions"),
):
    _PREDICATES[f"{_rule}_exists"] = (
        f"p.{_column} NOT IN (SELECT {_column} FROM stg_{_parent} WHERE {_column} IS NOT NULL)")

for _table, _column in (("orders", "ordered_at"), ("payments", "processed_at"), ("refunds", "refunded_at")):
    _PREDICATES[f"{_table}_{_column}_not_future"] = f"p.{_column} > {{now}}"

_PREDICATES |= {
    "customers_signup_after_launch": f"p.signed_up_at < TIMESTAMP '{TRADING_START}' OR p.signed_up_at > {{now}}",
    "payments_after_order":
        "EXISTS (FROM stg_orders AS o WHERE o.order_id = p.order_id AND o.ordered_at > p.processed_at)",
    "refunds_after_payment":
        "EXISTS (FROM stg_payments AS o WHERE o.payment_id = p.payment_id AND o.processed_at > p.refunded_at)",
    "subscriptions_end_after_start": "p.started_on > p.ended_on",
    "tickets_solved_after_opened": "p.opened_at > p.solved_at",
    "orders_status_accepted_values":
        "p.order_status NOT IN ('cancelled', 'delivered', 'placed', 'returned', 'shipped')",
    "orders_currency_accepted_values": "p.currency NOT IN ('CAD', 'GBP', 'USD')",
    "payments_status_accepted_values": "p.payment_status NOT IN ('failed', 'pending', 'succeeded')",
    "subscriptions_status_accepted_values": "p.subscription_status NOT IN ('active', 'cancelled', 'paused')",
    "customers_status_accepted_values": "p.customer_status NOT IN ('active', 'churned', 'inactive')",
    "tickets_channel_accepted_values": "p.channel NOT IN ('chat', 'email', 'phone', 'social')",
    "subscriptions_active_not_ended": "p.subscription_status = 'active' AND p.ended_on < CAST({now} AS DATE)",
    "subscriptions_cancelled_has_end_date": "p.subscription_status = 'cancelled' AND p.ended_on IS NULL",
    "tickets_solved_has_solved_at": "p.solved_at IS NULL AND p.ticket_status IN ('closed', 'solved')",
    "order_items_quantity_positive": "NOT (p.quantity >= 1)",
    "payments_succeeded_amount_positive": "p.amount <= 0",
    "payments_succeeded_amount_valid":
        "p.amount < 0 OR (p.amount = 0 AND NOT EXISTS (FROM stg_orders AS o WHERE o.order_id = p.order_id "
        "AND o.total_amount = 0))",
    "orders_total_non_negative": "p.total_amount < 0",
    "refunds_amount_positive": "p.refund_amount <= 0",
    "tickets_csat_in_range": "p.csat_score NOT BETWEEN 1 AND 5",
    "orders_total_formula":
        "abs(p.subtotal_amount - p.discount_amount + p.shipping_amount + p.tax_amount - p.total_amount) > 0.01",
    "order_items_line_amount_formula": "abs(p.quantity * p.unit_price - p.line_amount) > 0.01",
    "orders_discount_not_exceeding_subtotal": "p.discount_amount < 0 OR p.discount_amount - p.subtotal_amount > 0.01",
    "orders_subtotal_matches_items":
        "EXISTS (FROM (SELECT order_id, SUM(line_amount) AS v FROM stg_order_items GROUP BY order_id) AS a "
        "WHERE a.order_id = p.order_id AND abs(a.v - p.subtotal_amount) > 0.01)",
    "orders_paid_amount_matches_total":
        "EXISTS (FROM (SELECT order_id, SUM(amount) AS v FROM stg_payments WHERE payment_status = 'succeeded' "
        "GROUP BY order_id) AS a WHERE a.order_id = p.order_id AND abs(a.v - p.total_amount) > 0.01)",
    "refunds_not_exceeding_payment":
        "EXISTS (FROM stg_payments AS o WHERE o.payment_id = p.payment_id AND p.refund_amount - o.amount > 0.01)",
    "refunds_cumulative_not_exceeding_payment":
        "EXISTS (FROM (SELECT payment_id, SUM(refund_amount) AS v FROM stg_refunds GROUP BY payment_id) AS a "
        "WHERE a.payment_id = p.payment_id AND a.v - p.amount > 0.01)",
    "payments_currency_matches_order":
        "EXISTS (FROM stg_orders AS o WHERE o.order_id = p.order_id AND o.currency <> p.currency)",
    "payments_customer_matches_order":
        "EXISTS (FROM stg_orders AS o WHERE o.order_id = p.order_id "
        "AND o.customer_id IS DISTINCT FROM p.customer_id)",
}

_SCOPES = {
    "payments_succeeded_amount_positive": "p.payment_status = 'succeeded'",
    "payments_succeeded_amount_valid": "p.payment_status = 'succeeded'",
}

RULES = {r.key: r for r in commerce_rules(TRADING_START)}
assert set(RULES) == set(_PREDICATES), set(RULES) ^ set(_PREDICATES)


def asset_as_of(asset: str, as_of: str, loaded: bool) -> str:
    return f"(SELECT * FROM {asset} WHERE loaded_at <= TIMESTAMP '{as_of}')" if loaded else asset


def predicate(key: str, as_of: str = CUTOFF, loaded: bool = False) -> str:
    primary = asset_as_of(RULES[key].asset, as_of, loaded)
    return _PREDICATES[key].replace("{P}", primary).replace("{now}", f"TIMESTAMP '{as_of}'")


def scope(key: str) -> str:
    return _SCOPES.get(key, "TRUE")


def count_sql(key: str, as_of: str = CUTOFF, loaded: bool = False, extra: str = "") -> str:
    primary = asset_as_of(RULES[key].asset, as_of, loaded)
    return (f"SELECT '{key}' AS rule_key{extra}, COUNT(*) AS scanned, "
            f"COUNT(CASE WHEN {predicate(key, as_of, loaded)} THEN 1 END) AS failed "
            f"FROM {primary} AS p WHERE {scope(key)}")


def counts_sql(keys, as_of: str = CUTOFF, loaded: bool = False, extra: str = "") -> str:
    return "\nUNION ALL ".join(count_sql(k, as_of, loaded, extra) for k in keys)


RESULT_COLUMNS = (
    "rule_key, scanned, failed, CASE WHEN failed > 0 THEN 'fail' ELSE 'pass' END AS status, "
    "CASE WHEN scanned > 0 THEN round(CAST(failed AS DOUBLE) / scanned, 6) ELSE 0.0 END AS failure_rate")


def results_sql(keys, as_of: str = CUTOFF, loaded: bool = False) -> str:
    return with_models(f"SELECT {RESULT_COLUMNS} FROM ({counts_sql(keys, as_of, loaded)}) AS x")


def failing_sql(key: str, columns: str) -> str:
    return f"SELECT {columns} FROM {RULES[key].asset} AS p WHERE {scope(key)} AND ({predicate(key)})"
