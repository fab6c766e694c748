"""Shape the generic warehouse tables (customer, orders, lineitem, ...) into raw commerce tables.

The derivation plants key-modulus defects, so that every quality rule has passing and failing rows
at every scale. The text is plain SQL that Spark and an ANSI checker read alike; the few places
where dialects differ go through ``Dialect``.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from plumbline.sources.schemas import RAW

CUTOFF = "2001-08-01 23:59:59"
CUTOFF_DATE = "2001-08-01"
TRADING_START = "1994-06-03"


@dataclass(frozen=True)
class Dialect:
    timestamp: str
    add_days: str
    shift_days: str
    series: str

    def ts(self, text: str) -> str:
        return f"{self.timestamp} '{text}'"

    def plus(self, value: str, days: str) -> str:
        """Timestamp plus a computed number of days."""
        return self.shift_days.format(value=value, days=days)

    def upto(self, count: str) -> str:
        """One output row per number from 1 to ``count``."""
        return self.series.format(count=count)

    def date_plus(self, value: str, days: str) -> str:
        return self.add_days.format(value=value, days=days)


SPARK = Dialect("TIMESTAMP_NTZ", "date_add({value}, CAST({days} AS INT))",
                "({value} + make_dt_interval(CAST({days} AS INT)))", "explode(sequence(1, CAST({count} AS INT)))")
ANSI = Dialect("TIMESTAMP", "({value} + CAST({days} AS INT))", "({value} + to_days(CAST({days} AS INT)))",
               "unnest(generate_series(1, CAST({count} AS INT)))")


_UNIT = "floor(l_extendedprice / l_quantity)"


def _order_facts(d: Dialect, more: str = "") -> str:
    """Amounts and dates of every order, before copies of orders are made."""
    return f"""
        SELECT o.o_orderkey AS k, o.o_custkey AS c,
               CAST(coalesce(l.total, 0) + CASE WHEN o.o_orderkey % 61 = 0 THEN 1 ELSE 0 END
                    - CASE WHEN o.o_orderkey % 10 = 0 THEN 100 ELSE 0 END + 12
                    + CASE WHEN o.o_orderkey % 71 = 0 THEN 0.37 ELSE 0 END AS DECIMAL(12,2)) AS total_amount,
               CASE o.o_custkey % 3 WHEN 0 THEN 'usd' WHEN 1 THEN 'cad' ELSE 'gbp' END AS currency,
               {d.plus('o.o_orderdate', 'CASE WHEN o.o_orderkey % 173 = 0 THEN 3650 ELSE 0 END')} AS ordered_at,
               o.o_orderdate + INTERVAL '1' HOUR AS _loaded_at{more}
        FROM {{orders}} o
        LEFT JOIN (SELECT l_orderkey, SUM(CAST({_UNIT} * l_quantity AS DECIMAL(12,2))) AS total
                   FROM {{lineitem}} GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey"""


def raw_sql(d: Dialect) -> dict[str, str]:
    """One SELECT per raw table. ``{name}`` stands for a driver table."""
    unit = _UNIT
    sql: dict[str, str] = {}
    sql["customers"] = f"""
        SELECT 'C' || c_custkey AS customer_id,
               CASE WHEN c_custkey % 37 <> 0
                    THEN ' ' || replace(c_name, '#', '.') || '@Example.com ' END AS email,
               c_name AS first_name, lower(c_mktsegment) AS last_name,
               CASE c_nationkey % 3 WHEN 0 THEN 'us' WHEN 1 THEN 'ca' ELSE 'gb' END AS country_code,
               lower(c_mktsegment) AS acquisition_channel,
               CASE WHEN c_custkey % 101 = 0 THEN 'unknown' WHEN c_acctbal < 0 THEN 'churned'
                    WHEN c_acctbal < 2000 THEN 'inactive' ELSE 'active' END AS customer_status,
               {d.plus(d.ts('1994-06-01 09:00:00'), 'c_custkey % 400')} AS signup_at,
               {d.plus(d.ts('1994-06-01 09:30:00'), 'c_custkey % 400')} AS _loaded_at, c_custkey AS case_key
        FROM {{customer}}"""
    sql["products"] = f"""
        SELECT 'P' || p_partkey AS product_id, p_brand || '-' || p_partkey AS sku, p_name AS product_name,
               CASE WHEN p_partkey % 19 = 0 THEN 'equipment' ELSE lower(p_type) END AS category,
               CAST(p_retailprice AS DECIMAL(10,2)) AS unit_price,
               p_size % 10 <> 0 AS is_active,
               {d.date_plus("DATE '1990-01-01'", 'p_size * 30')} AS launched_on,
               {d.ts('1995-01-01 06:00:00')} AS _loaded_at
        FROM {{part}}"""
    sql["orders"] = f"""
        SELECT CASE WHEN k % 997 <> 0 THEN 'O' || k END AS order_id,
               'C' || (c + CASE WHEN k % 211 = 0 THEN 900000 ELSE 0 END) AS customer_id,
               CASE WHEN k % 701 = 0 THEN 'S' || (c + 900000)
                    WHEN c % 3 = 0 AND k % 5 = 0 THEN 'S' || c END AS subscription_id,
               CASE WHEN k % 4 = 0 THEN 'CMP' || (k % 27) END AS campaign_id,
               CASE WHEN k % 157 = 0 THEN 'in_transit' WHEN k % 23 = 0 THEN 'Cancelled'
                    WHEN st = 'F' THEN 'DELIVERED' WHEN st = 'O' THEN 'placed' ELSE 'Shipped' END AS order_status,
               CASE WHEN c % 3 = 0 AND k % 5 = 0 THEN 'subscription' WHEN k % 2 = 0 THEN 'web'
                    ELSE 'app' END AS sales_channel,
               CASE c % 3 WHEN 0 THEN 'usd' WHEN 1 THEN 'cad' ELSE 'gbp' END AS currency,
               sub AS subtotal_amount, disc AS discount_amount,
               CAST(5 AS DECIMAL(12,2)) AS shipping_amount, CAST(7 AS DECIMAL(12,2)) AS tax_amount,
               CAST(sub - disc + 12 + CASE WHEN k % 71 = 0 THEN 0.37 ELSE 0 END AS DECIMAL(12,2)) AS total_amount,
               {d.plus('dt', 'CASE WHEN k % 173 = 0 THEN 3650 ELSE 0 END')} AS ordered_at,
               CASE WHEN copy_no = 2 THEN dt + INTERVAL '3' HOUR ELSE dt + INTERVAL '1' HOUR END AS _loaded_at, k AS case_key
        FROM (SELECT o.k, o.c, o.st, o.dt, o.copy_no,
                     CAST(coalesce(l.total, 0) + CASE WHEN o.k % 61 = 0 THEN 1 ELSE 0 END AS DECIMAL(12,2)) AS sub,
                     CAST(CASE WHEN o.k % 10 = 0 THEN 100 ELSE 0 END AS DECIMAL(12,2)) AS disc
              FROM (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS st, o_orderdate AS dt,
                           {d.upto('CASE WHEN o_orderkey % 503 = 0 THEN 2 ELSE 1 END')} AS copy_no
                    FROM {{orders}}) o
              LEFT JOIN (SELECT l_orderkey,
                                SUM(CAST({unit} * l_quantity AS DECIMAL(12,2))) AS total
                         FROM {{lineitem}} GROUP BY l_orderkey) l ON l.l_orderkey = o.k) x"""
    sql["order_items"] = f"""
        SELECT l_orderkey || '-' || l_linenumber AS order_item_id,
               CASE WHEN l_orderkey % 811 <> 0 THEN 'O' || l_orderkey END AS order_id,
               CASE WHEN l_partkey % 499 = 0 AND l_orderkey % 3 = 0 THEN 'P' || (l_partkey + 9000000)
                    ELSE 'P' || l_partkey END AS product_id,
               CAST(CASE WHEN l_orderkey % 233 = 0 THEN -l_quantity ELSE l_quantity END AS INT) AS quantity,
               CAST({unit} AS DECIMAL(10,2)) AS unit_price,
               CAST({unit} * l_quantity + CASE WHEN l_orderkey % 89 = 0 THEN 0.5 ELSE 0 END
                    AS DECIMAL(12,2)) AS line_amount,
               l_shipdate + INTERVAL '1' HOUR AS _loaded_at, l_orderkey AS case_key
        FROM {{lineitem}}"""
    # Payments copy the order's own amounts and dates, so they read the raw orders (first copy only).
    sql["payments"] = f"""
        SELECT 'PAY' || k AS payment_id,
               CASE WHEN k % 613 = 0 THEN NULL WHEN k % 617 = 0 THEN 'OX' || k ELSE 'O' || k END AS order_id,
               'C' || (c + CASE WHEN k % 307 = 0 THEN 1 ELSE 0 END) AS customer_id,
               CASE k % 4 WHEN 0 THEN 'card' WHEN 1 THEN 'paypal' WHEN 2 THEN 'apple_pay'
                    ELSE 'gift_card' END AS payment_method,
               CASE WHEN k % 419 = 0 THEN 'complete' WHEN k % 20 = 0 THEN 'failed' WHEN k % 20 = 1 THEN 'Pending'
                    ELSE 'SUCCEEDED' END AS payment_status,
               CAST(CASE WHEN k % 401 = 0 THEN -total_amount ELSE total_amount END AS DECIMAL(12,2)) AS amount,
               CASE WHEN k % 331 = 0 THEN 'eur' ELSE currency END AS currency,
               CASE WHEN k % 131 = 0 THEN ordered_at - INTERVAL '180' MINUTE
                    ELSE ordered_at + INTERVAL '10' MINUTE END AS processed_at,
               CASE WHEN copy_no = 2 THEN _loaded_at + INTERVAL '17' MINUTE
                    ELSE _loaded_at + INTERVAL '10' MINUTE END AS _loaded_at, k AS case_key
        FROM (SELECT k, c, total_amount, currency, ordered_at, _loaded_at,
                     {d.upto('CASE WHEN k % 409 = 0 THEN 2 ELSE 1 END')} AS copy_no
              FROM {{order_facts}}) p"""
    sql["refunds"] = f"""
        SELECT refund_id, payment_id, refund_amount, refund_reason, refunded_at,
               refunded_at + INTERVAL '10' MINUTE AS _loaded_at, case_key
        FROM (SELECT r.k AS case_key, 'RF' || r.k || '-' || r.ln AS refund_id,
                     CASE WHEN r.k % 521 = 0 THEN 'PAYX' || r.k ELSE 'PAY' || r.k END AS payment_id,
                     CAST(r.unit * CASE WHEN r.k % 47 = 0 THEN 60 ELSE 1 END AS DECIMAL(12,2)) AS refund_amount,
                     CASE r.k % 3 WHEN 0 THEN 'order_returned' WHEN 1 THEN 'damaged_in_transit'
                          ELSE 'quality' END AS refund_reason,
                     CASE WHEN r.k % 139 = 0 THEN o.ordered_at - INTERVAL '1' DAY
                          ELSE o.ordered_at + INTERVAL '3' DAY END AS refunded_at
              FROM (SELECT DISTINCT l_orderkey AS k, l_linenumber AS ln, {unit} AS unit FROM {{lineitem}}
                    WHERE l_returnflag = 'R') r
              JOIN {{order_facts}} o ON o.k = r.k
              UNION ALL
              SELECT k, 'RFS' || k || '-' || part_no, 'PAY' || k, CAST(total_amount * 0.6 AS DECIMAL(12,2)),
                     'goodwill', ordered_at + INTERVAL '5' DAY
              FROM (SELECT k, total_amount, ordered_at, {d.upto('2')} AS part_no
                    FROM {{order_facts}} WHERE k % 1009 = 5) s) y"""
    sql["subscriptions"] = f"""
        SELECT 'S' || k AS subscription_id,
               'C' || (k + CASE WHEN k % 399 = 0 THEN 900000 ELSE 0 END) AS customer_id,
               'PLAN-' || (k % 5) AS plan_code,
               CASE WHEN k % 5 = 0 THEN 'Cancelled' WHEN k % 7 = 0 THEN 'paused'
                    WHEN k % 477 = 0 THEN 'lapsed' ELSE 'ACTIVE' END AS subscription_status,
               CASE WHEN k % 2 = 0 THEN 'monthly' ELSE 'biweekly' END AS billing_interval,
               CAST(18 + k % 15 AS DECIMAL(10,2)) AS price_per_cycle,
               start_day AS started_on,
               CASE WHEN NOT ((k % 5 = 0 AND k % 45 <> 0) OR k % 33 = 0) THEN NULL
                    WHEN k % 55 = 0 THEN {d.date_plus('start_day', '-20')}
                    ELSE {d.date_plus('start_day', '200')} END AS ended_on,
               {d.ts('2001-07-01 04:00:00')} AS _loaded_at, k AS case_key
        FROM (SELECT c_custkey AS k, {d.date_plus("DATE '1995-01-01'", 'c_custkey % 2000')} AS start_day
              FROM {{customer}} WHERE c_custkey % 3 = 0) s"""
    # Events are moved back 8220 days so that tickets end just before the cutoff.
    sql["tickets"] = f"""
        SELECT 'T' || k AS ticket_id, 'C' || user_id AS customer_id,
               CASE WHEN k % 2 = 0 THEN 'O' || k END AS order_id,
               CASE event_type WHEN 'view' THEN 'email' WHEN 'click' THEN 'chat' WHEN 'purchase' THEN 'phone'
                    WHEN 'signup' THEN 'social' ELSE 'chat_widget_v2' END AS channel,
               CASE k % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'normal' WHEN 2 THEN 'high' ELSE 'urgent' END AS priority,
               CASE WHEN k % 6 = 0 THEN 'open' ELSE 'solved' END AS ticket_status,
               opened AS opened_at,
               CASE WHEN k % 6 = 0 OR k % 111 = 1 THEN NULL
                    WHEN k % 127 = 0 THEN opened - INTERVAL '60' MINUTE
                    ELSE opened + INTERVAL '90' MINUTE END AS solved_at,
               CAST(CASE WHEN k % 3 = 0 THEN NULL WHEN k % 199 = 1 THEN 7 ELSE 1 + k % 5 END AS INT) AS csat_score,
               opened + INTERVAL '100' MINUTE AS _loaded_at, k AS case_key
        FROM (SELECT event_id AS k, user_id, event_type,
                     date_trunc('second', ts) - INTERVAL '8220' DAY AS opened FROM {{events}}) e"""
    sql["campaigns"] = f"""
        SELECT 'CMP' || n_nationkey AS campaign_id, 'Campaign ' || n_name AS campaign_name,
               CASE n_nationkey % 3 WHEN 0 THEN 'paid_social' WHEN 1 THEN 'email' ELSE 'referral' END AS channel,
               {d.date_plus("DATE '1995-01-01'", 'n_nationkey * 60')} AS started_on,
               {d.date_plus("DATE '1995-01-01'", 'n_nationkey * 60 + 59')} AS ended_on,
               CAST(1000 + 100 * n_nationkey AS DECIMAL(12,2)) AS budget_amount,
               {d.ts('2001-06-01 04:00:00')} AS _loaded_at
        FROM {{nation}}"""
    sql["order_facts"] = _order_facts(d)
    return sql


@lru_cache(maxsize=1)
def _spark_text() -> dict[str, str]:
    """The texts for Spark. The order facts also hold what the orders are made of, so that the lines are added up once."""
    text = raw_sql(SPARK)
    subtotal = "CAST(coalesce(l.total, 0) + CASE WHEN o.o_orderkey % 61 = 0 THEN 1 ELSE 0 END AS DECIMAL(12,2))"
    text["order_facts"] = _order_facts(SPARK, f", o.o_orderstatus AS st, o.o_orderdate AS dt, {subtotal} AS sub")
    head, _ = text["orders"].split("FROM (SELECT o.k, o.c,")
    copies = SPARK.upto("CASE WHEN k % 503 = 0 THEN 2 ELSE 1 END")
    text["orders"] = f"""{head}FROM (SELECT k, c, st, dt, sub, CAST(CASE WHEN k % 10 = 0 THEN 100 ELSE 0 END AS DECIMAL(12,2)) AS disc,
                     {copies} AS copy_no FROM {{order_facts}}) x"""
    return text


def driver_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: What each raw table is made of.
INPUTS = {
    "customers": ("customer",), "products": ("part",), "orders": ("order_facts",),
    "order_items": ("lineitem",), "payments": ("order_facts",), "refunds": ("lineitem", "order_facts"),
    "subscriptions": ("customer",), "tickets": ("events",), "campaigns": ("nation",),
    "order_facts": ("orders", "lineitem"),
}


def raw_table(spark: SparkSession, folder: str, name: str,
              ready: Mapping[str, DataFrame] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One raw commerce table derived from the driver tables, in its declared schema.

    ``ready`` may hold intermediate tables that already exist. ``keep`` names further columns: ``case_key`` is the
    undamaged key of the order, customer or ticket that a row belongs to.
    """
    have = ready or {}
    inputs = {}
    for source in INPUTS[name]:
        if source in have:
            inputs[source] = have[source]
        elif source == "order_facts":
            inputs[source] = raw_table(spark, folder, source)
        else:
            inputs[source] = driver_table(spark, folder, source)
    df = spark.sql(_spark_text()[name], **inputs)
    if name not in RAW:
        return df
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in RAW[name]], *keep)


def raw_tables(spark: SparkSession, folder: str, ready: Mapping[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    return {name: raw_table(spark, folder, name, ready) for name in RAW}
