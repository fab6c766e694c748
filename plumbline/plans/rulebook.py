"""The commerce rulebook: 56 rules over the staging layer."""

from __future__ import annotations

from plumbline.operators.rules import Rule

_BOTH = ("baseline", "improved")


def _staged(table: str) -> str:
    return f"stg_{table}"


def commerce_rules(trading_start: str = "2023-06-01") -> list[Rule]:
    """All rules of both rulesets. ``trading_start`` is the earliest valid signup date."""
    rules: list[Rule] = []

    # Severity of a missing value per table and column.
    for table, column, severity in (
        ("orders", "order_id", "critical"), ("orders", "customer_id", "critical"),
        ("order_items", "order_id", "high"), ("payments", "payment_id", "critical"),
        ("payments", "order_id", "high"), ("customers", "customer_id", "critical"), ("customers", "email", "low"),
        ("subscriptions", "customer_id", "high"),
    ):
        rules.append(Rule(f"{table}_{column}_not_null", "missing_identifier", "not_null", _staged(table), severity,
                          (column,), title=f"{table} have {column}"))

    # Severity of a duplicated key per table.
    for table, column, severity in (
        ("orders", "order_id", "critical"), ("payments", "payment_id", "critical"),
        ("customers", "customer_id", "critical"), ("subscriptions", "subscription_id", "high"),
        ("refunds", "refund_id", "high"), ("order_items", "order_item_id", "medium"),
    ):
        rules.append(Rule(f"{table}_{column}_unique", "duplicate_identifier", "unique", _staged(table), severity,
                          (column,), title=f"{column} is unique in {table}"))

    # Foreign keys (table, short name, column, parent table, severity).
    for table, short, column, parent, severity in (
        ("orders", "customer", "customer_id", "customers", "critical"),
        ("order_items", "order", "order_id", "orders", "high"),
        ("order_items", "product", "product_id", "products", "medium"),
        ("payments", "order", "order_id", "orders", "high"),
        ("payments", "customer", "customer_id", "customers", "high"),
        ("refunds", "payment", "payment_id", "payments", "critical"),
        ("subscriptions", "customer", "customer_id", "customers", "high"),
        ("tickets", "customer", "customer_id", "customers", "medium"),
        ("orders", "campaign", "campaign_id", "campaigns", "low"),
        ("orders", "subscription", "subscription_id", "subscriptions", "medium"),
    ):
        rules.append(Rule(
            f"{table}_{short}_exists", "broken_relationship", "relationship", _staged(table), severity, (column,),
            {"column": column, "to_asset": _staged(parent), "to_column": column},
            title=f"{column} of {table} is known"))

    # Timestamps that must not lie after the cutoff.
    for table, column, severity in (
        ("orders", "ordered_at", "high"), ("payments", "processed_at", "high"), ("refunds", "refunded_at", "medium"),
    ):
        rules.append(Rule(f"{table}_{column}_not_future", "invalid_date", "not_future", _staged(table), severity,
                          (column,), {"column": column}, title=f"{column} is not in the future"))
    rules.append(Rule("customers_signup_after_launch", "invalid_date", "range", "stg_customers", "medium",
                      ("signed_up_at",), {"column": "signed_up_at", "min": trading_start, "max_reference": True},
                      title="Signup lies within trading history"))

    # Orderings in time.
    rules += [
        Rule("payments_after_order", "chronology", "chronology", "stg_payments", "high", ("processed_at",),
             {"later_column": "processed_at", "reference_asset": "stg_orders", "join": {"order_id": "order_id"},
              "earlier_column": "ordered_at"}, title="Payment follows its order"),
        Rule("refunds_after_payment", "chronology", "chronology", "stg_refunds", "high", ("refunded_at",),
             {"later_column": "refunded_at", "reference_asset": "stg_payments", "join": {"payment_id": "payment_id"},
              "earlier_column": "processed_at"}, title="Refund follows its payment"),
        Rule("subscriptions_end_after_start", "chronology", "chronology", "stg_subscriptions", "high",
             ("ended_on", "started_on"), {"later_column": "ended_on", "earlier_column": "started_on"},
             title="Subscription ends after its start"),
        Rule("tickets_solved_after_opened", "chronology", "chronology", "stg_tickets", "low",
             ("solved_at", "opened_at"), {"later_column": "solved_at", "earlier_column": "opened_at"},
             title="Ticket is solved after opening"),
    ]

    # Closed value lists.
    for key, table, column, severity, values in (
        ("orders_status", "orders", "order_status", "high",
         ("placed", "shipped", "delivered", "cancelled", "returned")),
        ("orders_currency", "orders", "currency", "high", ("USD", "CAD", "GBP")),
        ("payments_status", "payments", "payment_status", "critical", ("succeeded", "failed", "pending")),
        ("subscriptions_status", "subscriptions", "subscription_status", "high", ("active", "paused", "cancelled")),
        ("customers_status", "customers", "customer_status", "medium", ("active", "inactive", "churned")),
        ("tickets_channel", "tickets", "channel", "low", ("email", "chat", "phone", "social")),
    ):
        rules.append(Rule(f"{key}_accepted_values", "invalid_category", "accepted_values", _staged(table), severity,
                          (column,), {"column": column, "values": values}, title=f"{column} of {table} is known"))

    # Predicates that mark a single row as bad.
    rules += [
        Rule("subscriptions_active_not_ended", "inconsistent_status", "row_condition", "stg_subscriptions", "high",
             ("subscription_status", "ended_on"),
             {"invalid_when": "subscription_status = 'active' AND ended_on < {reference_ts}::date"},
             title="Active subscription is still running"),
        Rule("subscriptions_cancelled_has_end_date", "inconsistent_status", "row_condition", "stg_subscriptions",
             "medium", ("subscription_status", "ended_on"),
             {"invalid_when": "subscription_status = 'cancelled' AND ended_on IS NULL"},
             title="Cancelled subscription has an end"),
        Rule("tickets_solved_has_solved_at", "inconsistent_status", "row_condition", "stg_tickets", "low",
             ("ticket_status", "solved_at"),
             {"invalid_when": "ticket_status IN ('solved', 'closed') AND solved_at IS NULL"},
             title="Solved ticket has a solution time"),
        Rule("order_items_quantity_positive", "invalid_numeric", "range", "stg_order_items", "high", ("quantity",),
             {"column": "quantity", "min": 1}, title="Quantity is positive"),
        Rule("payments_succeeded_amount_positive", "invalid_numeric", "range", "stg_payments", "high", ("amount",),
             {"column": "amount", "min": 0, "min_exclusive": True}, where="payment_status = 'succeeded'",
             rulesets=("baseline",), title="Captured amount is positive"),
        Rule("payments_succeeded_amount_valid", "invalid_numeric", "row_condition", "stg_payments", "high",
             ("amount",),
             {"invalid_when": "amount < 0 OR (amount = 0 AND NOT EXISTS (SELECT 1 FROM {ref:stg_orders} o "
                              "WHERE o.order_id = p.order_id AND o.total_amount = 0))"},
             where="payment_status = 'succeeded'", rulesets=("improved",),
             supersedes="payments_succeeded_amount_positive",
             rationale="A capture of nothing is right for an order that costs nothing (case EV-012).",
             title="Captured amount fits its order"),
        Rule("orders_total_non_negative", "invalid_numeric", "range", "stg_orders", "high", ("total_amount",),
             {"column": "total_amount", "min": 0}, title="Order total is not negative"),
        Rule("refunds_amount_positive", "invalid_numeric", "range", "stg_refunds", "high", ("refund_amount",),
             {"column": "refund_amount", "min": 0, "min_exclusive": True}, title="Refund is positive"),
        Rule("tickets_csat_in_range", "invalid_numeric", "range", "stg_tickets", "low", ("csat_score",),
             {"column": "csat_score", "min": 1, "max": 5}, title="Satisfaction score is 1 to 5"),
        Rule("orders_total_formula", "reconciliation", "row_condition", "stg_orders", "critical",
             ("total_amount", "subtotal_amount", "discount_amount", "shipping_amount", "tax_amount"),
             {"invalid_when": "abs(total_amount - (subtotal_amount - discount_amount + shipping_amount + tax_amount))"
                              " > 0.01"}, title="Order total adds up"),
        Rule("order_items_line_amount_formula", "reconciliation", "row_condition", "stg_order_items", "high",
             ("line_amount", "quantity", "unit_price"),
             {"invalid_when": "abs(line_amount - quantity * unit_price) > 0.01"}, title="Line amount adds up"),
        Rule("orders_discount_not_exceeding_subtotal", "business_rule", "row_condition", "stg_orders", "high",
             ("discount_amount", "subtotal_amount"),
             {"invalid_when": "discount_amount > subtotal_amount + 0.01 OR discount_amount < 0"},
             title="Discount fits the subtotal"),
    ]

    # Comparisons with another table.
    rules += [
        Rule("orders_subtotal_matches_items", "reconciliation", "aggregate_reconciliation", "stg_orders", "critical",
             ("subtotal_amount",),
             {"child_asset": "stg_order_items", "join": {"order_id": "order_id"},
              "primary_expression": "p.subtotal_amount", "child_aggregate": "sum(c.line_amount)",
              "comparison": "equal", "tolerance": 0.01}, title="Subtotal equals its lines"),
        Rule("orders_paid_amount_matches_total", "reconciliation", "aggregate_reconciliation", "stg_orders",
             "critical", ("total_amount",),
             {"child_asset": "stg_payments", "join": {"order_id": "order_id"},
              "child_where": "c.payment_status = 'succeeded'", "primary_expression": "p.total_amount",
              "child_aggregate": "sum(c.amount)", "comparison": "equal", "tolerance": 0.01},
             title="Captured cash equals the order total"),
        Rule("refunds_not_exceeding_payment", "financial_consistency", "join_condition", "stg_refunds", "critical",
             ("refund_amount",),
             {"reference_asset": "stg_payments", "join": {"payment_id": "payment_id"},
              "compare": ("refund_amount", "above", "amount", "0.01"), "context_columns": ["amount", "payment_status"]},
             rulesets=("baseline",), title="Refund fits its payment"),
        Rule("refunds_cumulative_not_exceeding_payment", "financial_consistency", "aggregate_reconciliation",
             "stg_payments", "critical", ("amount",),
             {"child_asset": "stg_refunds", "join": {"payment_id": "payment_id"}, "primary_expression": "p.amount",
              "child_aggregate": "sum(c.refund_amount)", "comparison": "child_lte_primary", "tolerance": 0.01},
             rulesets=("improved",), supersedes="refunds_not_exceeding_payment",
             rationale="Partial refunds can exceed the payment only together (case EV-011).",
             title="All refunds fit their payment"),
        Rule("payments_currency_matches_order", "financial_consistency", "join_condition", "stg_payments", "high",
             ("currency",),
             {"reference_asset": "stg_orders", "join": {"order_id": "order_id"},
              "compare": ("currency", "different", "currency"), "context_columns": ["currency"]},
             title="Payment and order share a currency"),
        Rule("payments_customer_matches_order", "business_rule", "join_condition", "stg_payments", "critical",
             ("customer_id",),
             {"reference_asset": "stg_orders", "join": {"order_id": "order_id"},
              "compare": ("customer_id", "distinct", "customer_id"), "context_columns": ["customer_id"]},
             rulesets=("improved",),
             rationale="Two references can each be known and still disagree (case EV-010).",
             title="Payment and order share a customer"),
    ]
    return rules


def rule_map(rules: list[Rule]) -> dict[str, Rule]:
    return {r.key: r for r in rules}
