"""Raw landing schemas and staging contracts as StructTypes."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp_ntz": T.TimestampNTZType(),
    "decimal(10,2)": T.DecimalType(10, 2), "decimal(12,2)": T.DecimalType(12, 2),
}


def _struct(columns: tuple[tuple[str, str], ...], required: tuple[str, ...] = ()) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind], name not in required) for name, kind in columns])


# Columns and types of the raw landing tables.
_RAW = {
    "customers": (
        ("customer_id", "string"), ("email", "string"), ("first_name", "string"), ("last_name", "string"),
        ("country_code", "string"), ("acquisition_channel", "string"), ("customer_status", "string"),
        ("signup_at", "timestamp_ntz"), ("_loaded_at", "timestamp_ntz"),
    ),
    "products": (
        ("product_id", "string"), ("sku", "string"), ("product_name", "string"), ("category", "string"),
        ("unit_price", "decimal(10,2)"), ("is_active", "boolean"), ("launched_on", "date"),
        ("_loaded_at", "timestamp_ntz"),
    ),
    "orders": (
        ("order_id", "string"), ("customer_id", "string"), ("subscription_id", "string"), ("campaign_id", "string"),
        ("order_status", "string"), ("sales_channel", "string"), ("currency", "string"),
        ("subtotal_amount", "decimal(12,2)"), ("discount_amount", "decimal(12,2)"),
        ("shipping_amount", "decimal(12,2)"), ("tax_amount", "decimal(12,2)"), ("total_amount", "decimal(12,2)"),
        ("ordered_at", "timestamp_ntz"), ("_loaded_at", "timestamp_ntz"),
    ),
    "order_items": (
        ("order_item_id", "string"), ("order_id", "string"), ("product_id", "string"), ("quantity", "int"),
        ("unit_price", "decimal(10,2)"), ("line_amount", "decimal(12,2)"), ("_loaded_at", "timestamp_ntz"),
    ),
    "payments": (
        ("payment_id", "string"), ("order_id", "string"), ("customer_id", "string"), ("payment_method", "string"),
        ("payment_status", "string"), ("amount", "decimal(12,2)"), ("currency", "string"),
        ("processed_at", "timestamp_ntz"), ("_loaded_at", "timestamp_ntz"),
    ),
    "refunds": (
        ("refund_id", "string"), ("payment_id", "string"), ("refund_amount", "decimal(12,2)"),
        ("refund_reason", "string"), ("refunded_at", "timestamp_ntz"), ("_loaded_at", "timestamp_ntz"),
    ),
    "subscriptions": (
        ("subscription_id", "string"), ("customer_id", "string"), ("plan_code", "string"),
        ("subscription_status", "string"), ("billing_interval", "string"), ("price_per_cycle", "decimal(10,2)"),
        ("started_on", "date"), ("ended_on", "date"), ("_loaded_at", "timestamp_ntz"),
    ),
    "tickets": (
        ("ticket_id", "string"), ("customer_id", "string"), ("order_id", "string"), ("channel", "string"),
        ("priority", "string"), ("ticket_status", "string"), ("opened_at", "timestamp_ntz"),
        ("solved_at", "timestamp_ntz"), ("csat_score", "int"), ("_loaded_at", "timestamp_ntz"),
    ),
    "campaigns": (
        ("campaign_id", "string"), ("campaign_name", "string"), ("channel", "string"), ("started_on", "date"),
        ("ended_on", "date"), ("budget_amount", "decimal(12,2)"), ("_loaded_at", "timestamp_ntz"),
    ),
}

# Columns and types of the typed staging layer.
_STAGING = {
    "stg_customers": (
        ("customer_id", "string"), ("email", "string"), ("first_name", "string"), ("last_name", "string"),
        ("country_code", "string"), ("acquisition_channel", "string"), ("customer_status", "string"),
        ("signed_up_at", "timestamp_ntz"), ("loaded_at", "timestamp_ntz"),
    ),
    "stg_products": (
        ("product_id", "string"), ("sku", "string"), ("product_name", "string"), ("category", "string"),
        ("list_price", "decimal(10,2)"), ("is_active", "boolean"), ("launched_on", "date"),
        ("loaded_at", "timestamp_ntz"),
    ),
    "stg_orders": (
        ("order_id", "string"), ("customer_id", "string"), ("subscription_id", "string"), ("campaign_id", "string"),
        ("order_status", "string"), ("sales_channel", "string"), ("currency", "string"),
        ("subtotal_amount", "decimal(12,2)"), ("discount_amount", "decimal(12,2)"),
        ("shipping_amount", "decimal(12,2)"), ("tax_amount", "decimal(12,2)"), ("total_amount", "decimal(12,2)"),
        ("ordered_at", "timestamp_ntz"), ("loaded_at", "timestamp_ntz"),
    ),
    "stg_order_items": (
        ("order_item_id", "string"), ("order_id", "string"), ("product_id", "string"), ("quantity", "int"),
        ("unit_price", "decimal(10,2)"), ("line_amount", "decimal(12,2)"), ("loaded_at", "timestamp_ntz"),
    ),
    "stg_payments": (
        ("payment_id", "string"), ("order_id", "string"), ("customer_id", "string"), ("payment_method", "string"),
        ("payment_status", "string"), ("amount", "decimal(12,2)"), ("currency", "string"),
        ("processed_at", "timestamp_ntz"), ("loaded_at", "timestamp_ntz"),
    ),
    "stg_refunds": (
        ("refund_id", "string"), ("payment_id", "string"), ("refund_amount", "decimal(12,2)"),
        ("refund_reason", "string"), ("refunded_at", "timestamp_ntz"), ("loaded_at", "timestamp_ntz"),
    ),
    "stg_subscriptions": (
        ("subscription_id", "string"), ("customer_id", "string"), ("plan_code", "string"),
        ("subscription_status", "string"), ("billing_interval", "string"), ("price_per_cycle", "decimal(10,2)"),
        ("monthly_amount", "decimal(10,2)"), ("started_on", "date"), ("ended_on", "date"),
        ("loaded_at", "timestamp_ntz"),
    ),
    "stg_tickets": (
        ("ticket_id", "string"), ("customer_id", "string"), ("order_id", "string"), ("channel", "string"),
        ("priority", "string"), ("ticket_status", "string"), ("opened_at", "timestamp_ntz"),
        ("solved_at", "timestamp_ntz"), ("csat_score", "int"), ("loaded_at", "timestamp_ntz"),
    ),
    "stg_campaigns": (
        ("campaign_id", "string"), ("campaign_name", "string"), ("channel", "string"), ("started_on", "date"),
        ("ended_on", "date"), ("budget_amount", "decimal(12,2)"), ("loaded_at", "timestamp_ntz"),
    ),
}

RAW = {name: _struct(columns, ("_loaded_at",)) for name, columns in _RAW.items()}
STAGING = {name: _struct(columns) for name, columns in _STAGING.items()}
