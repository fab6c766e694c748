"""Metadata of the commerce warehouse: teams, systems, assets, critical columns, lineage and glossary."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans.model_columns import MODEL_COLUMNS
from plumbline.plans.model_sql import MODELS, staging_sql
from plumbline.sources.schemas import RAW, STAGING

# Layer order.
LAYERS = ("raw", "staging", "intermediate", "mart", "exposure")

# Owning teams.
TEAMS = {
    "commerce": "Commerce", "payments": "Payments", "finance_analytics": "Finance Analytics",
    "growth_analytics": "Growth Analytics", "customer_experience": "Customer Experience",
    "customer_data": "Customer Data", "platform_engineering": "Platform Engineering",
}

# Name, owner, domain, criticality of raw tables.
_RAW_ASSETS = (
    ("customers", "commerce", "high"), ("products", "commerce", "medium"), ("orders", "commerce", "critical"),
    ("order_items", "commerce", "high"), ("payments", "payments", "critical"), ("refunds", "payments", "critical"),
    ("subscriptions", "subscriptions", "high"), ("tickets", "customer_experience", "medium"),
    ("campaigns", "growth", "medium"),
)

# Name, owner, domain, criticality of models.
_STAGING_ASSETS = (
    ("stg_customers", "customer_data", "customer", "critical"), ("stg_products", "commerce", "commerce", "medium"),
    ("stg_orders", "commerce", "commerce", "critical"), ("stg_order_items", "commerce", "commerce", "high"),
    ("stg_payments", "payments", "payments", "critical"), ("stg_refunds", "payments", "payments", "critical"),
    ("stg_subscriptions", "commerce", "subscriptions", "critical"),
    ("stg_tickets", "customer_experience", "customer_experience", "medium"),
    ("stg_campaigns", "growth_analytics", "growth", "medium"),
)
_INTERMEDIATE_ASSETS = (
    ("int_payments__with_refunds", "payments", "payments", "high"),
    ("int_orders__payment_summary", "payments", "payments", "high"),
    ("int_orders__item_summary", "commerce", "commerce", "medium"),
    ("int_orders__enriched", "commerce", "commerce", "critical"),
    ("int_customers__order_history", "customer_data", "customer", "high"),
    ("int_subscriptions__mrr", "commerce", "subscriptions", "critical"),
    ("int_customers__support_summary", "customer_experience", "customer_experience", "medium"),
    ("int_campaigns__attributed_orders", "growth_analytics", "growth", "medium"),
)
_MART_ASSETS = (
    ("dim_customers", "customer_data", "customer", "critical"), ("dim_products", "commerce", "commerce", "medium"),
    ("fct_orders", "commerce", "commerce", "critical"), ("fct_payments", "payments", "payments", "critical"),
    ("fct_subscriptions", "commerce", "subscriptions", "critical"),
    ("fct_daily_revenue", "finance_analytics", "finance", "critical"),
    ("fin_monthly_revenue_close", "finance_analytics", "finance", "critical"),
    ("customer_lifetime_value", "customer_data", "customer", "high"),
    ("customer_health_scores", "customer_data", "customer", "high"),
    ("campaign_performance", "growth_analytics", "growth", "medium"),
    ("rpt_executive_kpis", "finance_analytics", "executive", "critical"),
)
# Name, owner, criticality, audience, financial reporting, customer facing, inputs.
_EXPOSURES = (
    ("executive_kpi_dashboard", "finance_analytics", "critical", "executive", True, False, ("rpt_executive_kpis",)),
    ("finance_month_end_close", "finance_analytics", "critical", "finance", True, False,
     ("fin_monthly_revenue_close", "fct_payments")),
    ("revenue_forecast_model", "finance_analytics", "high", "finance", True, False, ("fct_daily_revenue",)),
    ("loyalty_tier_sync", "customer_data", "high", "customer_facing", False, True, ("customer_lifetime_value",)),
    ("customer_health_console", "customer_experience", "high", "internal", False, False, ("customer_health_scores",)),
    ("growth_attribution_dashboard", "growth_analytics", "medium", "internal", False, False,
     ("campaign_performance",)),
    ("subscription_retention_dashboard", "commerce", "medium", "internal", False, False, ("fct_subscriptions",)),
)

# Critical columns and their category per asset.
_CRITICAL = {
    "stg_customers": {
        "customer_id": "customer_identifier", "customer_status": "status",
    },
    "stg_products": {
        "product_id": "identifier",
    },
    "stg_orders": {
        "order_id": "identifier", "customer_id": "customer_identifier", "order_status": "status",
        "subtotal_amount": "financial", "discount_amount": "financial", "total_amount": "financial",
        "ordered_at": "temporal",
    },
    "stg_order_items": {
        "order_id": "identifier", "quantity": "financial", "line_amount": "financial",
    },
    "stg_payments": {
        "payment_id": "identifier", "order_id": "identifier", "customer_id": "customer_identifier",
        "payment_status": "status", "amount": "financial", "processed_at": "temporal",
    },
    "stg_refunds": {
        "payment_id": "identifier", "refund_amount": "financial",
    },
    "stg_subscriptions": {
        "subscription_id": "identifier", "customer_id": "customer_identifier", "subscription_status": "status",
        "monthly_amount": "financial", "ended_on": "temporal",
    },
    "stg_tickets": {
        "customer_id": "customer_identifier",
    },
    "stg_campaigns": {
        "budget_amount": "financial",
    },
    "int_payments__with_refunds": {
        "payment_id": "identifier", "order_id": "identifier", "refunded_amount": "financial",
        "net_amount": "financial",
    },
    "int_orders__payment_summary": {
        "amount_paid": "financial",
    },
    "int_orders__enriched": {
        "order_id": "identifier", "customer_id": "customer_identifier", "net_revenue": "financial",
    },
    "int_customers__order_history": {
        "customer_id": "customer_identifier", "lifetime_net_revenue": "financial",
    },
    "int_subscriptions__mrr": {
        "is_active": "status", "mrr": "financial",
    },
    "dim_customers": {
        "customer_id": "customer_identifier", "customer_status": "status", "lifetime_net_revenue": "financial",
    },
    "fct_orders": {
        "order_id": "identifier", "customer_id": "customer_identifier", "total_amount": "financial",
        "net_revenue": "financial", "ordered_at": "temporal",
    },
    "fct_payments": {
        "payment_id": "identifier", "amount": "financial",
    },
    "fct_subscriptions": {
        "subscription_status": "status", "mrr": "financial",
    },
    "fct_daily_revenue": {
        "net_revenue": "financial",
    },
    "fin_monthly_revenue_close": {
        "net_revenue": "financial", "cash_collected": "financial",
    },
    "customer_lifetime_value": {
        "customer_lifetime_value": "financial",
    },
    "rpt_executive_kpis": {
        "net_revenue": "financial", "ending_mrr": "financial",
    },
}

# Personal data per asset.
PII = {"stg_customers": ("email", "first_name", "last_name"), "dim_customers": ("email",)}

# Freshness column and promise in hours.
FRESHNESS = {
    "stg_customers": ("signed_up_at", 48), "stg_orders": ("ordered_at", 24), "stg_payments": ("processed_at", 6),
    "stg_refunds": ("refunded_at", 48), "stg_subscriptions": ("started_on", 72), "stg_tickets": ("opened_at", 24),
    "fct_orders": ("ordered_at", 24), "fct_payments": ("processed_at", 6), "fct_daily_revenue": ("order_date", 30),
}

# Glossary term, domain, owner, status, and what it is linked to.
_TERMS = (
    ("customer", "Customer", "customer", "customer_data", "approved", (
        ("stg_customers", "customer_id"), ("dim_customers", "customer_id"), ("fct_orders", "customer_id"),
        ("stg_payments", "customer_id"),
    )),
    ("customer_status", "Customer Status", "customer", "customer_data", "approved", (
        ("stg_customers", "customer_status"), ("dim_customers", "customer_status"),
    )),
    ("churned_customer", "Churned Customer", "customer", "customer_data", "approved", (
        ("dim_customers", "customer_status"), ("customer_health_scores", None),
    )),
    ("active_subscription", "Active Subscription", "subscriptions", "commerce", "approved", (
        ("stg_subscriptions", "subscription_status"), ("int_subscriptions__mrr", "is_active"),
        ("fct_subscriptions", "subscription_status"),
    )),
    ("monthly_recurring_revenue", "Monthly Recurring Revenue (MRR)", "finance", "finance_analytics", "approved", (
        ("stg_subscriptions", "monthly_amount"), ("int_subscriptions__mrr", "mrr"), ("fct_subscriptions", "mrr"),
        ("rpt_executive_kpis", "ending_mrr"),
    )),
    ("order", "Order", "commerce", "commerce", "approved", (
        ("stg_orders", "order_id"), ("int_orders__enriched", "order_id"), ("fct_orders", "order_id"),
    )),
    ("order_value", "Order Value", "commerce", "commerce", "approved", (
        ("stg_orders", "total_amount"), ("fct_orders", "total_amount"),
    )),
    ("average_order_value", "Average Order Value (AOV)", "finance", "finance_analytics", "approved", (
        ("fct_daily_revenue", "average_order_value"), ("rpt_executive_kpis", "average_order_value"),
    )),
    ("successful_payment", "Successful Payment", "payments", "payments", "approved", (
        ("stg_payments", "payment_status"), ("stg_payments", "amount"), ("fct_payments", "amount"),
        ("int_orders__payment_summary", "amount_paid"),
    )),
    ("refund", "Refund", "payments", "payments", "approved", (
        ("stg_refunds", "refund_amount"), ("int_payments__with_refunds", "refunded_amount"),
        ("fct_daily_revenue", "refunds"),
    )),
    ("gross_revenue", "Gross Sales", "finance", "finance_analytics", "approved", (
        ("fct_daily_revenue", "gross_sales"), ("fin_monthly_revenue_close", "gross_sales"),
    )),
    ("net_revenue", "Net Revenue", "finance", "finance_analytics", "approved", (
        ("int_orders__enriched", "net_revenue"), ("fct_orders", "net_revenue"), ("fct_daily_revenue", "net_revenue"),
        ("fin_monthly_revenue_close", "net_revenue"), ("rpt_executive_kpis", "net_revenue"),
    )),
    ("cash_collected", "Cash Collected", "finance", "finance_analytics", "approved", (
        ("fin_monthly_revenue_close", "cash_collected"), ("rpt_executive_kpis", "cash_collected"),
    )),
    ("customer_lifetime_value", "Customer Lifetime Value (CLV)", "customer", "customer_data", "approved", (
        ("int_customers__order_history", "lifetime_net_revenue"),
        ("customer_lifetime_value", "customer_lifetime_value"), ("customer_lifetime_value", "clv_tier"),
    )),
    ("customer_health_score", "Customer Health Score", "customer_experience", "customer_data", "approved", (
        ("customer_health_scores", "health_score"), ("customer_health_scores", "health_band"),
        ("rpt_executive_kpis", "avg_health_score"),
    )),
    ("acquisition_source", "Acquisition Source", "growth", "growth_analytics", "approved", (
        ("stg_customers", "acquisition_channel"), ("dim_customers", "acquisition_channel"),
        ("fct_orders", "customer_acquisition_channel"),
    )),
    ("campaign_attribution", "Campaign Attribution", "growth", "growth_analytics", "draft", (
        ("int_campaigns__attributed_orders", None), ("campaign_performance", "attributed_revenue"),
    )),
    ("customer_acquisition_cost", "Customer Acquisition Cost (CAC)", "growth", "growth_analytics", "approved", (
        ("campaign_performance", "customer_acquisition_cost"), ("rpt_executive_kpis", "blended_cac"),
    )),
    ("csat", "Customer Satisfaction (CSAT)", "customer_experience", "customer_experience", "approved", (
        ("stg_tickets", "csat_score"), ("int_customers__support_summary", "avg_csat"),
    )),
    ("legacy_customer_tier", "Legacy Customer Tier", "customer", "customer_data", "deprecated", (
        ("customer_lifetime_value", "clv_tier"),
    )),
)


@lru_cache(maxsize=1)
def assets() -> list[tuple]:
    """(asset, asset_type, layer, domain, owner, criticality, audience, financial, customer_facing, source_system)."""
    # One operational system per business domain feeds the raw tables of that domain.
    rows = [(f"raw_{n}", "source", "raw", d, TEAMS["platform_engineering"], c, None, False, False, f"{d} system")
            for n, d, c in _RAW_ASSETS]
    for layer, group in (("staging", _STAGING_ASSETS), ("intermediate", _INTERMEDIATE_ASSETS), ("mart", _MART_ASSETS)):
        rows += [(n, "model", layer, d, TEAMS[o], c, None, d in ("finance", "executive"), False, None)
                 for n, o, d, c in group]
    domain = {r[0]: r[3] for r in rows}
    rows += [(n, "exposure", "exposure", domain[min(inputs)], TEAMS[o], c, audience, fin, facing, None)
             for n, o, c, audience, fin, facing, inputs in _EXPOSURES]
    return rows


@lru_cache(maxsize=1)
def columns() -> list[tuple]:
    """(asset, column_name, ordinal, is_critical, category, contains_pii)."""
    names = {f"raw_{n}": s.names for n, s in RAW.items()} | {n: s.names for n, s in STAGING.items()}
    names |= {n: [c for c, _ in cols] for n, cols in MODEL_COLUMNS.items()}
    rows = []
    for asset, cols in names.items():
        critical = _CRITICAL.get(asset, {})
        rows += [(asset, c, i, c in critical, critical.get(c), c in PII.get(asset, ()))
                 for i, c in enumerate(cols, start=1)]
    return rows


def model_texts() -> dict[str, str]:
    """SQL text of every model, for reading off column references."""
    return {t: staging_sql(t) for t in STAGING} | dict(MODELS)


@lru_cache(maxsize=1)
def dependencies() -> list[tuple[str, str]]:
    """(upstream, downstream) pairs, read from the model texts and the exposures."""
    texts = model_texts()
    known = [r[0] for r in assets()]
    pairs = [(up, down) for down, text in texts.items() for up in known
             if up != down and re.search(rf"(FROM|JOIN) {up}\b", text)]
    pairs += [(up, e[0]) for e in _EXPOSURES for up in e[6]]
    return sorted(set(pairs))


@lru_cache(maxsize=1)
def edges() -> list[tuple[str, str, list[str] | None]]:
    """(upstream, downstream, referenced columns); NULL references for exposures, which have no text."""
    texts = model_texts()
    by_asset: dict[str, list[str]] = {}
    for row in columns():
        by_asset.setdefault(row[0], []).append(row[1])
    out = []
    for up, down in dependencies():
        words = set(re.findall(r"\w+", texts[down])) if down in texts else None
        out.append((up, down, None if words is None else [c for c in by_asset.get(up, []) if c in words]))
    return out


def glossary() -> tuple[list[tuple], list[tuple]]:
    """Terms (key, name, domain, owner, status) and links (key, asset, column or NULL)."""
    terms = [(k, n, d, TEAMS[o], s) for k, n, d, o, s, _ in _TERMS]
    links = [(k, asset, column) for k, _, _, _, _, linked in _TERMS for asset, column in linked]
    return terms, links


ASSET_SCHEMA = ("asset string, asset_type string, layer string, domain string, owner string, criticality string, "
                "audience string, is_financial boolean, is_customer_facing boolean, source_system string")
COLUMN_SCHEMA = ("asset string, column_name string, ordinal int, is_critical boolean, category string, "
                 "contains_pii boolean")
EDGE_SCHEMA = "upstream string, downstream string, referenced_columns array<string>"


def asset_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(assets(), ASSET_SCHEMA)


def column_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(columns(), COLUMN_SCHEMA)


def edge_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(edges(), EDGE_SCHEMA)


def term_frames(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    terms, links = glossary()
    return (spark.createDataFrame(terms, "term_key string, term string, domain string, owner string, status string"),
            spark.createDataFrame(links, "term_key string, asset string, column_name string"))
