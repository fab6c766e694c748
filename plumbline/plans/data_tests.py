"""Data tests on staging and marts: failures per test, all at warning level."""

from __future__ import annotations

from plumbline.operators.rules import Rule

# Which models are tested for what.
_UNIQUE_AND_FILLED = (
    ("stg_customers", "customer_id"), ("stg_products", "product_id"), ("stg_orders", "order_id"),
    ("stg_order_items", "order_item_id"), ("stg_payments", "payment_id"), ("stg_refunds", "refund_id"),
    ("stg_subscriptions", "subscription_id"), ("stg_tickets", "ticket_id"), ("stg_campaigns", "campaign_id"),
    ("dim_customers", "customer_id"), ("dim_products", "product_id"), ("fct_orders", "order_id"),
    ("fct_payments", "payment_id"), ("fct_subscriptions", "subscription_id"),
)
_UNIQUE = (("customer_lifetime_value", "customer_id"), ("customer_health_scores", "customer_id"),
           ("campaign_performance", "campaign_id"))
_FILLED = (("stg_orders", "customer_id"), ("stg_order_items", "order_id"), ("stg_payments", "order_id"))
_RELATED = (
    ("stg_orders", "customer_id", "stg_customers"), ("stg_order_items", "product_id", "stg_products"),
    ("stg_refunds", "payment_id", "stg_payments"), ("stg_subscriptions", "customer_id", "stg_customers"),
    ("fct_orders", "customer_id", "dim_customers"),
)
_ACCEPTED = (
    ("stg_customers", "customer_status", ("active", "inactive", "churned")),
    ("stg_orders", "order_status", ("placed", "shipped", "delivered", "cancelled", "returned")),
    ("stg_payments", "payment_status", ("succeeded", "failed", "pending")),
)


def data_tests() -> list[Rule]:
    """The tests as rules, so they share the rule engine."""
    tests = []
    for model, column in (*_UNIQUE_AND_FILLED, *_UNIQUE):
        tests.append(Rule(f"unique_{model}_{column}", "duplicate_identifier", "unique", model, "low", (column,)))
    for model, column in (*_UNIQUE_AND_FILLED, *_FILLED):
        tests.append(Rule(f"not_null_{model}_{column}", "missing_identifier", "not_null", model, "low", (column,)))
    for model, column, parent in _RELATED:
        tests.append(Rule(f"relationships_{model}_{column}", "broken_relationship", "relationship", model, "low",
                          (column,), {"column": column, "to_asset": parent, "to_column": column}))
    for model, column, values in _ACCEPTED:
        tests.append(Rule(f"accepted_values_{model}_{column}", "invalid_category", "accepted_values", model, "low",
                          (column,), {"column": column, "values": values}))
    tests.append(Rule("order_total_formula", "reconciliation", "row_condition", "stg_orders", "low", ("total_amount",), {
        "invalid_when": "abs(total_amount - (subtotal_amount - discount_amount + shipping_amount + tax_amount)) > 0.01"}))
    return tests
