"""The same models as ANSI SQL text.

Two uses: the checker runs the text on another engine, and lineage reads it to find which upstream
columns a model mentions. ``{today}`` is the cutoff date.
"""

from __future__ import annotations

import re

from plumbline.sources.driver_tables import ANSI, CUTOFF_DATE, raw_sql
from plumbline.sources.schemas import STAGING


def half_up(numerator: str, denominator: str, scale: int) -> str:
    """Exact quotient of two non-scaled integers-or-cents, rounded half away from zero, as DOUBLE.

    ``numerator`` must already be an integer expression scaled by 10**scale.
    """
    n, d = f"CAST({numerator} AS HUGEINT)", f"CAST({denominator} AS HUGEINT)"
    return (f"(CASE WHEN ({denominator}) <> 0 THEN sign({n}) * ((2 * abs({n}) + {d}) // (2 * {d})) "
            f"/ {10 ** scale}.0 END)")


def per(amount: str, count: str) -> str:
    """Amount in cents divided by a count, at two decimals."""
    return half_up(f"({amount}) * 100", count, 2)


MODELS: dict[str, str] = {}

MODELS["int_payments__with_refunds"] = """
SELECT pay.payment_id, pay.order_id, pay.customer_id, pay.payment_method, pay.payment_status, pay.amount,
       pay.currency, pay.processed_at, COALESCE(back.n, 0) AS refund_count,
       CAST(COALESCE(back.total, 0) AS DECIMAL(12,2)) AS refunded_amount, back.latest AS last_refunded_at,
       CAST(IF(pay.payment_status = 'succeeded', pay.amount, 0) - COALESCE(back.total, 0) AS DECIMAL(12,2)) AS net_amount
FROM stg_payments AS pay
LEFT JOIN (SELECT payment_id, COUNT(*) AS n, SUM(refund_amount) AS total, MAX(refunded_at) AS latest
           FROM stg_refunds GROUP BY ALL) AS back USING (payment_id)"""

MODELS["int_orders__payment_summary"] = """
SELECT order_id,
       SUM(CASE payment_status WHEN 'succeeded' THEN 1 ELSE 0 END) AS successful_payment_count,
       SUM(CASE payment_status WHEN 'failed' THEN 1 ELSE 0 END) AS failed_attempt_count,
       CAST(SUM(CASE payment_status WHEN 'succeeded' THEN amount ELSE 0 END) AS DECIMAL(12,2)) AS amount_paid,
       CAST(SUM(refunded_amount) AS DECIMAL(12,2)) AS amount_refunded,
       MIN(CASE payment_status WHEN 'succeeded' THEN processed_at END) AS first_paid_at,
       MAX(last_refunded_at) AS last_refunded_at
FROM int_payments__with_refunds GROUP BY ALL"""

MODELS["int_orders__item_summary"] = """
SELECT line.order_id, COUNT(*) AS line_count, CAST(SUM(line.quantity) AS BIGINT) AS units,
       CAST(SUM(line.line_amount) AS DECIMAL(12,2)) AS items_subtotal,
       COUNT(DISTINCT prod.category) AS category_count,
       MAX(CASE WHEN prod.category = 'equipment' THEN 1 WHEN prod.category IS NOT NULL THEN 0 END) = 1 AS has_equipment,
       string_agg(DISTINCT prod.category, ', ' ORDER BY prod.category) AS categories
FROM stg_order_items AS line LEFT JOIN stg_products AS prod USING (product_id)
GROUP BY line.order_id"""

MODELS["int_orders__enriched"] = """
SELECT head.order_id, head.customer_id, head.subscription_id, head.campaign_id, head.order_status,
       head.sales_channel, head.currency, head.ordered_at, CAST(head.ordered_at AS DATE) AS order_date,
       head.subtotal_amount, head.discount_amount, head.shipping_amount, head.tax_amount, head.total_amount,
       COALESCE(body.line_count, 0) AS line_count, COALESCE(body.units, 0) AS units, body.categories,
       COALESCE(cash.successful_payment_count, 0) AS successful_payment_count,
       COALESCE(cash.failed_attempt_count, 0) AS failed_attempt_count,
       COALESCE(cash.amount_paid, 0) AS amount_paid, COALESCE(cash.amount_refunded, 0) AS amount_refunded,
       cash.first_paid_at, head.total_amount - COALESCE(cash.amount_paid, 0) AS balance_due,
       head.order_status <> 'cancelled' AND COALESCE(cash.amount_paid, 0) > 0 AS is_revenue_order,
       CAST(IF(head.order_status <> 'cancelled' AND COALESCE(cash.amount_paid, 0) > 0,
               head.total_amount - head.tax_amount - COALESCE(cash.amount_refunded, 0), 0) AS DECIMAL(12,2)) AS net_revenue
FROM stg_orders AS head
LEFT JOIN int_orders__item_summary AS body USING (order_id)
LEFT JOIN int_orders__payment_summary AS cash USING (order_id)"""

MODELS["int_customers__order_history"] = f"""
SELECT customer_id, MIN(ordered_at) AS first_order_at, MAX(ordered_at) AS last_order_at,
       SUM(CAST(is_revenue_order AS INT)) AS order_count,
       SUM(CAST(is_revenue_order AND sales_channel = 'subscription' AS INT)) AS subscription_order_count,
       CAST(SUM(net_revenue) AS DECIMAL(14,2)) AS lifetime_net_revenue,
       CAST(SUM(amount_refunded) AS DECIMAL(14,2)) AS lifetime_refunds,
       {per('SUM(net_revenue)', 'SUM(CAST(is_revenue_order AS INT))')} AS avg_order_value
FROM int_orders__enriched GROUP BY ALL"""

MODELS["int_subscriptions__mrr"] = """
SELECT subscription_id, customer_id, plan_code, subscription_status, billing_interval, monthly_amount, started_on,
       ended_on, subscription_status = 'active' AS is_active,
       CAST(IF(subscription_status = 'active', monthly_amount, 0) AS DECIMAL(10,2)) AS mrr,
       CAST(datesub('month', started_on, LEAST(ended_on, {today})) AS INT) AS tenure_months
FROM stg_subscriptions"""

MODELS["int_customers__support_summary"] = f"""
SELECT customer_id, COUNT(*) AS ticket_count,
       COUNT(CASE WHEN ticket_status IN ('pending', 'open') THEN 1 END) AS open_ticket_count,
       COUNT(CASE WHEN priority IN ('urgent', 'high') THEN 1 END) AS escalated_ticket_count,
       COUNT(CASE WHEN opened_at >= {{today}} - 90 THEN 1 END) AS tickets_last_90d,
       {per('SUM(csat_score)', 'COUNT(csat_score)')} AS avg_csat, MAX(opened_at) AS last_ticket_at
FROM stg_tickets GROUP BY ALL"""

MODELS["int_campaigns__attributed_orders"] = """
SELECT ord.order_id, ord.campaign_id, ord.customer_id, ord.ordered_at, ord.net_revenue,
       ord.ordered_at = past.first_order_at AS is_new_customer_order
FROM (SELECT * FROM int_orders__enriched WHERE is_revenue_order AND campaign_id IS NOT NULL) AS ord
LEFT JOIN int_customers__order_history AS past USING (customer_id)"""

MODELS["dim_customers"] = """
SELECT cust.customer_id, cust.email, cust.first_name, cust.last_name, cust.country_code, cust.acquisition_channel,
       cust.customer_status, cust.signed_up_at, past.first_order_at, past.last_order_at,
       COALESCE(past.order_count, 0) AS order_count,
       COALESCE(past.lifetime_net_revenue, 0) AS lifetime_net_revenue,
       COALESCE(past.lifetime_refunds, 0) AS lifetime_refunds, past.avg_order_value,
       COALESCE(plan.live, 0) AS active_subscription_count, COALESCE(plan.mrr, 0) AS mrr,
       COALESCE(plan.live, 0) > 0 AS is_subscriber,
       datediff('day', CAST(past.last_order_at AS DATE), {today}) AS days_since_last_order
FROM stg_customers AS cust
LEFT JOIN int_customers__order_history AS past USING (customer_id)
LEFT JOIN (SELECT customer_id, SUM(CAST(is_active AS INT)) AS live, SUM(mrr) AS mrr
           FROM int_subscriptions__mrr GROUP BY ALL) AS plan USING (customer_id)"""

MODELS["dim_products"] = """
SELECT prod.product_id, prod.sku, prod.product_name, prod.category, prod.list_price, prod.is_active,
       prod.launched_on, COALESCE(sold.units, 0) AS units_sold, COALESCE(sold.gross, 0) AS gross_sales,
       COALESCE(sold.n, 0) AS order_count
FROM stg_products AS prod
LEFT JOIN (SELECT line.product_id, SUM(line.quantity) AS units, SUM(line.line_amount) AS gross,
                  COUNT(DISTINCT line.order_id) AS n
           FROM stg_order_items AS line
           JOIN (SELECT order_id FROM int_orders__enriched WHERE is_revenue_order) AS ord USING (order_id)
           GROUP BY ALL) AS sold USING (product_id)"""

MODELS["fct_orders"] = """
SELECT ord.order_id, ord.customer_id, ord.subscription_id, ord.campaign_id, ord.order_status, ord.sales_channel,
       ord.currency, ord.ordered_at, ord.order_date, ord.subtotal_amount, ord.discount_amount, ord.shipping_amount,
       ord.tax_amount, ord.total_amount, ord.line_count, ord.units, ord.amount_paid, ord.amount_refunded,
       ord.balance_due, ord.is_revenue_order, ord.net_revenue, who.country_code AS customer_country_code,
       who.acquisition_channel AS customer_acquisition_channel, who.is_subscriber AS customer_is_subscriber
FROM int_orders__enriched AS ord LEFT JOIN dim_customers AS who USING (customer_id)"""

MODELS["fct_payments"] = """
SELECT pay.payment_id, pay.order_id, pay.customer_id, pay.payment_method, pay.payment_status, pay.amount,
       pay.currency, pay.processed_at, pay.refund_count, pay.refunded_amount, pay.net_amount, ord.order_status,
       ord.ordered_at,
       round(date_diff('second', ord.ordered_at, pay.processed_at) / 60.0, 1) AS minutes_from_checkout
FROM int_payments__with_refunds AS pay LEFT JOIN stg_orders AS ord USING (order_id)"""

MODELS["fct_subscriptions"] = """
SELECT con.subscription_id, con.customer_id, con.plan_code, con.subscription_status, con.billing_interval,
       con.monthly_amount, con.started_on, con.ended_on, con.is_active, con.mrr, con.tenure_months,
       who.country_code AS customer_country_code
FROM int_subscriptions__mrr AS con LEFT JOIN dim_customers AS who USING (customer_id)"""

MODELS["fct_daily_revenue"] = f"""
SELECT order_date, currency, COUNT(*) AS orders, CAST(SUM(units) AS BIGINT) AS units,
       CAST(SUM(subtotal_amount) AS DECIMAL(14,2)) AS gross_sales,
       CAST(SUM(discount_amount) AS DECIMAL(14,2)) AS discounts,
       CAST(SUM(amount_refunded) AS DECIMAL(14,2)) AS refunds,
       CAST(SUM(net_revenue) AS DECIMAL(14,2)) AS net_revenue,
       {per('SUM(net_revenue)', 'COUNT(*)')} AS average_order_value
FROM fct_orders WHERE is_revenue_order GROUP BY ALL"""

MODELS["fin_monthly_revenue_close"] = """
SELECT COALESCE(rev.revenue_month, cash.revenue_month) AS revenue_month,
       COALESCE(rev.currency, cash.currency) AS currency, CAST(COALESCE(rev.orders, 0) AS BIGINT) AS orders,
       COALESCE(rev.gross_sales, 0) AS gross_sales, COALESCE(rev.discounts, 0) AS discounts,
       COALESCE(rev.refunds, 0) AS refunds, COALESCE(rev.net_revenue, 0) AS net_revenue,
       COALESCE(cash.collected, 0) AS cash_collected, COALESCE(cash.refunded, 0) AS cash_refunded
FROM (SELECT CAST(date_trunc('month', order_date) AS DATE) AS revenue_month, currency, SUM(orders) AS orders,
             SUM(gross_sales) AS gross_sales, SUM(discounts) AS discounts, SUM(refunds) AS refunds,
             SUM(net_revenue) AS net_revenue
      FROM fct_daily_revenue GROUP BY ALL) AS rev
FULL JOIN (SELECT CAST(date_trunc('month', processed_at) AS DATE) AS revenue_month, currency,
                  SUM(CASE payment_status WHEN 'succeeded' THEN amount END) AS collected,
                  SUM(refunded_amount) AS refunded
           FROM fct_payments GROUP BY ALL) AS cash
  ON (rev.revenue_month, rev.currency) = (cash.revenue_month, cash.currency)"""

MODELS["customer_lifetime_value"] = """
SELECT customer_id, country_code, acquisition_channel, customer_status, is_subscriber, order_count,
       round(months, 1) AS tenure_months, lifetime_net_revenue AS historical_value, monthly_value,
       CAST(outlook AS DECIMAL(12,2)) AS predicted_12m_value,
       CAST(lifetime_net_revenue + outlook AS DECIMAL(14,2)) AS customer_lifetime_value,
       CASE WHEN lifetime_net_revenue + outlook >= 1000 THEN 'platinum'
            WHEN lifetime_net_revenue + outlook >= 400 THEN 'gold'
            WHEN lifetime_net_revenue + outlook >= 150 THEN 'silver' ELSE 'bronze' END AS clv_tier
FROM (SELECT *, GREATEST(monthly_value, mrr) * 12 * keep_rate AS outlook
      FROM (SELECT *, CAST(lifetime_net_revenue / months AS DECIMAL(12,2)) AS monthly_value
            FROM (SELECT *, GREATEST(1, datediff('day', CAST(first_order_at AS DATE), {today}) / 30.4) AS months,
                         CAST(CASE WHEN is_subscriber THEN 0.85 WHEN customer_status = 'active' THEN 0.55
                                   WHEN customer_status = 'inactive' THEN 0.25 ELSE 0.05 END AS DECIMAL(4,2)) AS keep_rate
                  FROM dim_customers WHERE order_count > 0)))"""

MODELS["customer_health_scores"] = """
SELECT customer_id, customer_status, is_subscriber, days_since_last_order, open_ticket_count, avg_csat, clv_tier,
       customer_lifetime_value, recency_points, subscription_points, support_points, value_points,
       LEAST(100, recency_points + subscription_points + support_points + value_points) AS health_score,
       CASE WHEN recency_points + subscription_points + support_points + value_points < 40 THEN 'critical'
            WHEN recency_points + subscription_points + support_points + value_points < 70 THEN 'at_risk'
            ELSE 'healthy' END AS health_band
FROM (SELECT who.customer_id, who.customer_status, who.is_subscriber, who.days_since_last_order,
             COALESCE(help.open_ticket_count, 0) AS open_ticket_count, help.avg_csat, val.clv_tier,
             val.customer_lifetime_value,
             CASE WHEN days_since_last_order > 180 OR days_since_last_order IS NULL THEN 0
                  WHEN days_since_last_order > 90 THEN 15 WHEN days_since_last_order > 30 THEN 30
                  ELSE 40 END AS recency_points,
             IF(who.is_subscriber, 20, 0) AS subscription_points,
             GREATEST(0, 25 - 6 * COALESCE(help.open_ticket_count, 0) - 2 * COALESCE(help.tickets_last_90d, 0)
                         - IF(help.avg_csat < 3, 8, 0)) AS support_points,
             CASE WHEN val.clv_tier = 'platinum' THEN 15 WHEN val.clv_tier = 'gold' THEN 11
                  WHEN val.clv_tier = 'silver' THEN 7 ELSE 3 END AS value_points
      FROM dim_customers AS who
      LEFT JOIN int_customers__support_summary AS help USING (customer_id)
      LEFT JOIN customer_lifetime_value AS val USING (customer_id)
      WHERE who.order_count > 0)"""

MODELS["campaign_performance"] = f"""
SELECT camp.campaign_id, camp.campaign_name, camp.channel, camp.started_on, camp.ended_on, camp.budget_amount,
       COALESCE(won.n, 0) AS attributed_orders, COALESCE(won.revenue, 0) AS attributed_revenue,
       COALESCE(won.fresh, 0) AS new_customers,
       {half_up('COALESCE(won.revenue, 0) * 100 * 100', 'camp.budget_amount * 100', 2)} AS roas,
       {per('camp.budget_amount', 'COALESCE(won.fresh, 0)')} AS customer_acquisition_cost
FROM stg_campaigns AS camp
LEFT JOIN (SELECT campaign_id, COUNT(*) AS n, SUM(net_revenue) AS revenue,
                  SUM(CASE WHEN is_new_customer_order THEN 1 ELSE 0 END) AS fresh
           FROM int_campaigns__attributed_orders GROUP BY ALL) AS won USING (campaign_id)"""

MODELS["rpt_executive_kpis"] = f"""
SELECT rev.revenue_month, CAST(rev.orders AS BIGINT) AS orders, rev.net_revenue, rev.refunds, rev.cash_collected,
       {per('rev.net_revenue', 'rev.orders')} AS average_order_value,
       COALESCE((SELECT COUNT(DISTINCT f.customer_id) FROM fct_orders AS f
                 WHERE f.is_revenue_order AND date_trunc('month', f.order_date) = rev.revenue_month), 0) AS active_customers,
       live.n AS active_subscriptions, COALESCE(live.amount, 0) AS ending_mrr,
       COALESCE(mkt.spend, 0) AS marketing_spend, CAST(COALESCE(mkt.fresh, 0) AS BIGINT) AS campaign_new_customers,
       {per('mkt.spend', 'COALESCE(mkt.fresh, 0)')} AS blended_cac, fit.avg_health_score, fit.share_customers_at_risk
FROM (SELECT revenue_month, SUM(orders) AS orders, SUM(net_revenue) AS net_revenue, SUM(refunds) AS refunds,
             SUM(cash_collected) AS cash_collected
      FROM fin_monthly_revenue_close GROUP BY ALL) AS rev
LEFT JOIN (SELECT m.revenue_month, COUNT(s.subscription_id) AS n, SUM(s.monthly_amount) AS amount
           FROM (SELECT DISTINCT revenue_month FROM fin_monthly_revenue_close) AS m
           LEFT JOIN fct_subscriptions AS s
             ON s.subscription_status <> 'paused' AND s.started_on <= last_day(m.revenue_month)
            AND COALESCE(s.is_active OR s.ended_on > last_day(m.revenue_month), TRUE)
           GROUP BY ALL) AS live USING (revenue_month)
LEFT JOIN (SELECT CAST(date_trunc('month', started_on) AS DATE) AS revenue_month, SUM(budget_amount) AS spend,
                  SUM(new_customers) AS fresh
           FROM campaign_performance GROUP BY ALL) AS mkt USING (revenue_month)
LEFT JOIN (SELECT CAST(date_trunc('month', {{today}}) AS DATE) AS revenue_month,
                  {half_up('SUM(health_score) * 10', 'COUNT(*)', 1)} AS avg_health_score,
                  {half_up("SUM(CAST(health_band <> 'healthy' AS INT)) * 1000", 'COUNT(*)', 3)} AS share_customers_at_risk
           FROM customer_health_scores) AS fit USING (revenue_month)"""

# Staging projections: only the columns that are not plain casts.
_STAGE_EXPRESSION = {
    ("stg_customers", "email"): "lower(trim(email))",
    ("stg_customers", "country_code"): "upper(country_code)",
    ("stg_customers", "signed_up_at"): "signup_at",
    ("stg_products", "list_price"): "unit_price",
    ("stg_orders", "order_status"): "lower(order_status)",
    ("stg_orders", "currency"): "upper(currency)",
    ("stg_payments", "payment_status"): "lower(payment_status)",
    ("stg_payments", "currency"): "upper(currency)",
    ("stg_subscriptions", "subscription_status"): "lower(subscription_status)",
    ("stg_subscriptions", "monthly_amount"):
        "CASE billing_interval WHEN 'biweekly' THEN "
        "(2 * CAST(price_per_cycle * 100 AS BIGINT) * 26 + 12) // 24 / 100.0 ELSE price_per_cycle END",
}


def staging_sql(table: str) -> str:
    columns = []
    for field in STAGING[table]:
        source = "_loaded_at" if field.name == "loaded_at" else field.name
        expression = _STAGE_EXPRESSION.get((table, field.name), source)
        if field.dataType.simpleString().startswith("decimal"):
            expression = f"CAST({expression} AS {field.dataType.simpleString()})"
        columns.append(f"{expression} AS {field.name}")
    return f"SELECT {', '.join(columns)} FROM raw_{table[4:]}"


def _driver_names(text: str) -> str:
    """Adapter SQL with plain driver table names; derived order facts are a CTE."""
    return re.sub(r"\{(\w+)\}", lambda m: "raw_order_facts" if m[1] == "order_facts" else m[1], text)


def ctes() -> dict[str, str]:
    """Every relation a checker query may name, in dependency order."""
    raw = raw_sql(ANSI)
    order = ["order_facts", *[n for n in raw if n != "order_facts"]]
    out = {f"raw_{n}": _driver_names(raw[n]) for n in order}
    out |= {t: staging_sql(t) for t in STAGING}
    out |= {n: t.replace("{today}", f"DATE '{CUTOFF_DATE}'") for n, t in MODELS.items()}
    return out


def with_models(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the CTEs it needs (directly or through other CTEs)."""
    available = ctes() | (extra or {})
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in available:
            if name not in needed and re.search(rf"\b{re.escape(name)}\b", text):
                needed.add(name)
                visit(available[name])

    visit(body)
    parts = [f"{n} AS MATERIALIZED ({available[n]})" for n in available if n in needed]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" + body) if parts else body
