"""Queries: single relational building blocks over the commerce tables, and data tests on the models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import position, whole_months
from plumbline.operators import quality as Q
from plumbline.plans.data_tests import data_tests
from plumbline.plans.marts import live_subscriptions_by_month
from plumbline.plans.model_sql import with_models
from plumbline.sources.driver_tables import CUTOFF
from plumbline.suite.common import Bed, plain

QUERIES = {}
ORACLE = {}


def _add(name, run, sql):
    QUERIES[name] = lambda s, f: plain(run(Bed(s, f)))
    ORACLE[name] = with_models(sql)


def _rows(alias="n"):
    return F.count(F.lit(1)).alias(alias)


# ------------------------------------------------------------------ data tests

_TESTS = data_tests()


def _test_sql(rule) -> str:
    c = rule.columns[0]
    bad = {
        "unique": f"p.{c} IN (SELECT q.{c} FROM {rule.asset} AS q GROUP BY ALL HAVING COUNT(*) > 1)",
        "not_null": f"p.{c} IS NULL",
        "relationship": f"p.{c} IS NOT NULL AND p.{c} NOT IN (SELECT {c} FROM {rule.params.get('to_asset')} WHERE {c} IS NOT NULL)",
        "accepted_values": f"p.{c} NOT IN ({', '.join(repr(v) for v in rule.params.get('values', ['']))})",
        "row_condition": "abs(p.subtotal_amount + p.shipping_amount + p.tax_amount - p.discount_amount - p.total_amount) > 0.01",
    }[rule.type]
    return f"SELECT '{rule.key}' AS test, COUNT(CASE WHEN {bad} THEN 1 END) AS failures FROM {rule.asset} AS p"


_add("m21_data_tests",
     lambda b: Q.rule_counts(b.spark, b.models_keeping(*{t.asset for t in _TESTS if not t.asset.startswith('stg_')}, 'int_orders__enriched'),
         _TESTS, CUTOFF).select(
         F.col("rule_key").alias("test"), F.col("failed").alias("failures")),
     "\nUNION ALL ".join(_test_sql(t) for t in _TESTS))
_add("m20_order_total_formula",
     lambda b: Q.failing_rows(b.staging, _TESTS[-1], CUTOFF).select("order_id", "subtotal_amount", "total_amount"),
     "SELECT order_id, CAST(subtotal_amount AS DOUBLE) AS subtotal_amount, CAST(total_amount AS DOUBLE) AS total_amount FROM "
     "stg_orders AS p WHERE abs(total_amount - subtotal_amount + discount_amount - 12) > 0.01")

# ------------------------------------------------------------------ filters

_add("f1_scope_filter", lambda b: b.stg("payments").filter("payment_status = 'succeeded'").agg(_rows()),
     "SELECT COUNT(*) AS n FROM stg_payments WHERE payment_status = 'succeeded'")
_add("f2_load_cutoff", lambda b: b.stg("orders").filter(F.col("loaded_at") <= F.expr("TIMESTAMP_NTZ '2000-01-01 00:00:00'"))
     .groupBy("currency").agg(_rows()),
     "SELECT currency, COUNT(*) AS n FROM stg_orders WHERE loaded_at <= TIMESTAMP '2000-01-01' GROUP BY ALL")
_add("f3_null_over_columns", lambda b: b.stg("orders").filter("order_id IS NULL OR campaign_id IS NULL").agg(_rows()),
     "SELECT COUNT(*) AS n FROM stg_orders WHERE order_id IS NULL OR campaign_id IS NULL")
_add("f4_in_and_not_in", lambda b: b.stg("orders").filter(
    F.col("order_status").isin("placed", "shipped") & ~F.col("currency").isin("USD")).groupBy("order_status").agg(_rows()),
     "SELECT order_status, COUNT(*) AS n FROM stg_orders WHERE order_status IN ('placed', 'shipped') AND currency <> 'USD' GROUP BY ALL")
_add("f5_bounds", lambda b: b.stg("tickets").agg(
    F.count_if(F.col("csat_score") > 4).alias("above"), F.count_if(F.col("csat_score") >= 4).alias("from_four"),
    F.count_if(F.col("csat_score") < 2).alias("below"), F.count_if(F.col("csat_score") <= 2).alias("to_two")),
     "SELECT COUNT(*) FILTER (csat_score > 4) AS above, COUNT(*) FILTER (csat_score >= 4) AS from_four, COUNT(*) FILTER "
     "(csat_score < 2) AS below, COUNT(*) FILTER (csat_score <= 2) AS to_two FROM stg_tickets")
_add("f6_is_distinct_from", lambda b: b.stg("orders").filter(
    ~F.col("subscription_id").eqNullSafe(F.concat(F.lit("S"), F.substring("customer_id", 2, 20)))).agg(_rows()),
     "SELECT COUNT(*) AS n FROM stg_orders WHERE subscription_id IS DISTINCT FROM 'S' || substr(customer_id, 2)")
_add("f7_timestamp_tolerance", lambda b: b.stg("tickets").filter(
    F.col("solved_at") > F.col("opened_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(60))).agg(_rows()),
     "SELECT COUNT(*) AS n FROM stg_tickets WHERE solved_at > opened_at + INTERVAL '60' MINUTE")
_add("f10_optional_filters", lambda b: _optional(b.stg("orders"), order_status=["placed"], currency=None).agg(_rows()),
     "SELECT COUNT(*) AS n FROM stg_orders WHERE order_status = 'placed'")
_add("f11_text_search", lambda b: b.stg("products").filter(F.col("product_name").ilike("%RED%")).groupBy("category").agg(_rows()),
     "SELECT category, COUNT(*) AS n FROM stg_products WHERE product_name ILIKE '%RED%' GROUP BY ALL")


def _optional(df, **wanted):
    for column, values in wanted.items():
        if values:
            df = df.filter(F.col(column).isin(*values))
    return df


# ------------------------------------------------------------------ joins

_add("j4_range_join_as_running_count",
     lambda b: live_subscriptions_by_month(
         b.models["fin_monthly_revenue_close"].select("revenue_month").distinct(), b.models["fct_subscriptions"]),
     "SELECT CAST(m.revenue_month AS VARCHAR) AS revenue_month, COUNT(s.subscription_id) AS active_subscriptions, "
     "CAST(COALESCE(SUM(s.monthly_amount), 0) AS DOUBLE) AS ending_mrr FROM (SELECT DISTINCT revenue_month FROM "
     "fin_monthly_revenue_close) AS m LEFT JOIN fct_subscriptions AS s ON s.subscription_status <> 'paused' AND s.started_on <= "
     "last_day(m.revenue_month) AND COALESCE(s.is_active OR s.ended_on > last_day(m.revenue_month), TRUE) GROUP BY m.revenue_month")
_add("j6_not_exists_inside_or",
     lambda b: b.spark.sql("SELECT p.payment_id FROM {p} p WHERE p.amount < 0 OR (p.payment_method = 'card' AND NOT EXISTS "
                           "(SELECT 1 FROM {o} o WHERE o.order_id = p.order_id))", p=b.stg("payments"), o=b.stg("orders")),
     "SELECT payment_id FROM stg_payments WHERE amount < 0 OR (payment_method = 'card' AND (order_id IS NULL OR order_id NOT IN "
     "(SELECT order_id FROM stg_orders WHERE order_id IS NOT NULL)))")
_add("j9_counts_per_row",
     lambda b: b.stg("customers").select("customer_id").join(
         b.stg("tickets").groupBy("customer_id").agg(_rows("tickets"), F.max("opened_at").alias("latest")), "customer_id", "left"
     ).select("customer_id", F.coalesce("tickets", F.lit(0)).alias("tickets"), "latest"),
     "SELECT c.customer_id, (SELECT COUNT(*) FROM stg_tickets AS t WHERE t.customer_id = c.customer_id) AS tickets, (SELECT "
     "CAST(MAX(opened_at) AS VARCHAR) FROM stg_tickets AS t WHERE t.customer_id = c.customer_id) AS latest FROM stg_customers AS c")
_add("j10_dimension_lookup",
     lambda b: b.stg("orders").join(b.stg("campaigns").select("campaign_id", "channel"), "campaign_id").groupBy("channel").agg(_rows()),
     "SELECT channel, COUNT(*) AS n FROM stg_orders JOIN stg_campaigns USING (campaign_id) GROUP BY ALL")

# ------------------------------------------------------------------ aggregates and windows

_add("a2_filtered_aggregates", lambda b: b.stg("payments").groupBy("payment_method").agg(
    F.count_if(F.col("payment_status") == "failed").alias("failed"),
    F.sum(F.when(F.col("payment_status") == "succeeded", F.col("amount"))).alias("captured")),
     "SELECT payment_method, COUNT(*) FILTER (payment_status = 'failed') AS failed, CAST(SUM(amount) FILTER (payment_status = "
     "'succeeded') AS DOUBLE) AS captured FROM stg_payments GROUP BY ALL")
_add("a3_exact_distinct", lambda b: b.stg("orders").groupBy("sales_channel").agg(F.count_distinct("customer_id").alias("buyers")),
     "SELECT sales_channel, COUNT(DISTINCT customer_id) AS buyers FROM stg_orders GROUP BY ALL")
_add("a6_ordered_arrays", lambda b: b.stg("campaigns").groupBy("channel").agg(
    F.array_sort(F.collect_set("campaign_id")).alias("campaigns")),
     "SELECT channel, array_to_string(list(DISTINCT campaign_id ORDER BY campaign_id), ',') AS campaigns FROM stg_campaigns GROUP BY ALL")
_add("a12_cross_tabulation", lambda b: b.stg("tickets").groupBy("channel", "priority").agg(_rows()),
     "SELECT channel, priority, COUNT(*) AS n FROM stg_tickets GROUP BY ALL")
_add("w1_copies_per_key", lambda b: (lambda o: o.join(
    o.groupBy("order_id").agg(_rows("copies")).filter("copies > 1 AND order_id IS NOT NULL"), "order_id").select(
    "order_id", "copies", "loaded_at"))(b.stg("orders")),
     "SELECT order_id, copies, CAST(loaded_at AS VARCHAR) AS loaded_at FROM (SELECT order_id, loaded_at, COUNT(*) OVER "
     "(PARTITION BY order_id) AS copies FROM stg_orders WHERE order_id IS NOT NULL) AS x WHERE copies > 1")
_add("w4_latest_row_per_group", lambda b: b.stg("payments").groupBy("customer_id").agg(
    F.max_by(F.struct("payment_id", "amount"), F.struct("processed_at", "payment_id")).alias("r")).select(
    "customer_id", "r.payment_id", "r.amount"),
     "SELECT customer_id, payment_id, CAST(amount AS DOUBLE) AS amount FROM (SELECT *, row_number() OVER (PARTITION BY customer_id "
     "ORDER BY processed_at DESC, payment_id DESC) AS rn FROM stg_payments) AS x WHERE rn = 1")


def _seventh(b):
    """Monthly revenue against seven months earlier; one row per month."""
    months = b.models["fin_monthly_revenue_close"].groupBy("revenue_month").agg(F.sum("net_revenue").alias("revenue"))
    order = Window.orderBy("revenue_month")
    return months.withColumn("before", F.lag("revenue", 7).over(order))


_add("w3_value_seven_rows_back", _seventh,
     "SELECT CAST(revenue_month AS VARCHAR) AS revenue_month, CAST(revenue AS DOUBLE) AS revenue, CAST(lag(revenue, 7) OVER (ORDER "
     "BY revenue_month) AS DOUBLE) AS before FROM (SELECT revenue_month, SUM(net_revenue) AS revenue FROM "
     "fin_monthly_revenue_close GROUP BY ALL) AS x")

# ------------------------------------------------------------------ sorting, sets and functions

_add("k3_top_rows_nulls_last", lambda b: b.stg("orders").orderBy(
    F.asc_nulls_last("campaign_id"), F.desc("total_amount"), "order_id").limit(20).select("campaign_id", "order_id", "total_amount"),
     "SELECT campaign_id, order_id, CAST(total_amount AS DOUBLE) AS total_amount FROM stg_orders ORDER BY campaign_id NULLS LAST, "
     "total_amount DESC, order_id NULLS FIRST LIMIT 20")
_add("k4_custom_rank", lambda b: b.stg("tickets").groupBy("priority").agg(_rows()).withColumn(
    "place", position(F.col("priority"), ("urgent", "high", "normal", "low"))).orderBy("place"),
     "SELECT priority, COUNT(*) AS n, list_position(['urgent', 'high', 'normal', 'low'], priority) AS place FROM stg_tickets GROUP BY ALL")
_add("k5_top_per_score", lambda b: b.models["customer_lifetime_value"].orderBy(
    F.desc("customer_lifetime_value"), "customer_id").limit(15).select("customer_id", "customer_lifetime_value"),
     "SELECT customer_id, CAST(customer_lifetime_value AS DOUBLE) AS customer_lifetime_value FROM customer_lifetime_value ORDER BY "
     "customer_lifetime_value DESC, customer_id LIMIT 15")
_add("u2_set_difference", lambda b: b.stg("orders").select("customer_id").distinct().join(
    b.stg("customers").select("customer_id"), "customer_id", "left_anti"),
     "SELECT customer_id FROM stg_orders EXCEPT SELECT customer_id FROM stg_customers")
_add("u3_set_intersection", lambda b: b.source("documents").select(
    "doc_id", F.array_sort(F.array_intersect(F.split(F.lower("text"), " "), F.array(F.lit("the"), F.lit("and"), F.lit("les")))).alias(
        "shared")).filter(F.size("shared") > 0),
     "SELECT doc_id, array_to_string(list_sort(list_filter(['the', 'and', 'les'], lambda w: list_contains(string_split(lower(text), ' '), "
     "w))), ',') AS shared FROM documents WHERE len(list_filter(['the', 'and', 'les'], lambda w: list_contains(string_split(lower(text), "
     "' '), w))) > 0")
_add("x1_text_functions", lambda b: b.raw("customers").select(
    "customer_id", F.lower(F.trim("email")).alias("email"), F.upper("country_code").alias("country"),
    F.concat("first_name", F.lit("/"), F.length("last_name").cast("string")).alias("label")),
     "SELECT customer_id, trim(lower(email)) AS email, upper(country_code) AS country, first_name || '/' || length(last_name) AS label "
     "FROM raw_customers")
_add("x2_word_match", lambda b: b.source("documents").filter(F.col("text").rlike(r"\bthe\b")).groupBy("lang").agg(_rows()),
     r"SELECT lang, COUNT(*) AS n FROM documents WHERE regexp_matches(text, '\bthe\b') GROUP BY ALL")
_add("x4_calendar_functions", lambda b: b.stg("subscriptions").select(
    "subscription_id", F.trunc("started_on", "month").alias("month"), F.last_day("started_on").alias("month_end"),
    F.datediff("ended_on", "started_on").alias("days"), whole_months(F.col("started_on"), F.col("ended_on")).alias("months"),
    F.add_months("started_on", 1).alias("next")),
     "SELECT subscription_id, CAST(CAST(date_trunc('month', started_on) AS DATE) AS VARCHAR) AS month, CAST(last_day(started_on) AS "
     "VARCHAR) AS month_end, datediff('day', started_on, ended_on) AS days, datesub('month', started_on, ended_on) AS months, "
     "CAST(CAST(started_on + INTERVAL '1' MONTH AS DATE) AS VARCHAR) AS next FROM stg_subscriptions")
_add("x5_hashes", lambda b: b.source("documents").select(
    "doc_id", F.md5("text").alias("md5"), F.substring(F.sha2("text", 256), 1, 16).alias("sha")),
     "SELECT doc_id, md5(text) AS md5, substr(sha256(text), 1, 16) AS sha FROM documents")
_add("x6_array_functions", lambda b: b.source("part").select("p_partkey", F.split("p_name", " ").alias("w")).select(
    "p_partkey", F.array_contains("w", "red").alias("has_red"), F.array_position("w", "red").alias("place"),
    F.array_join(F.array_remove("w", "red"), "-").alias("rest")),
     "SELECT p_partkey, list_contains(w, 'red') AS has_red, COALESCE(list_position(w, 'red'), 0) AS place, array_to_string(list_filter(w, "
     "lambda x: x <> 'red'), '-') AS rest FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part) AS x")
_add("x7_json_access", lambda b: b.source("events").select(
    "event_id", F.from_json("props", "struct<k:bigint>")["k"].alias("k"), F.get_json_object("props", "$.k").alias("k_text")),
     "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, props->>'$.k' AS k_text FROM events")
