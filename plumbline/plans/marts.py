"""Intermediate models and marts as lazily composed DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.joins import attach
from plumbline.functions.scalars import money, month_start, or_zero, ratio, whole_months
from plumbline.session import checkpoint

_BUILDERS: dict[str, Callable[["Models"], DataFrame]] = {}


def _model(build: Callable[["Models"], DataFrame]):
    _BUILDERS[build.__name__] = build
    return build


class Models:
    """Staging tables plus every model derived from them, built on first use.

    ``keep`` names models that several others read: they are written once to the shared folder instead of
    being derived again by every reader.
    """

    def __init__(self, staging: Mapping[str, DataFrame], cutoff_date: str, keep: Collection[str] = ()) -> None:
        self._staging = staging
        self._keep = frozenset(keep)
        self._built: dict[str, DataFrame] = {}
        self.today = F.lit(cutoff_date).cast("date")

    def __getitem__(self, name: str) -> DataFrame:
        if name in self._staging:
            return self._staging[name]
        if name not in self._built:
            built = _BUILDERS[name](self)
            self._built[name] = checkpoint(built) if name in self._keep else built
        return self._built[name]

    def __contains__(self, name: str) -> bool:
        return name in self._staging or name in _BUILDERS


def _when_sum(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value))


@_model
def int_payments__with_refunds(m: Models) -> DataFrame:
    refunds = m["stg_refunds"].groupBy("payment_id").agg(
        F.count(F.lit(1)).alias("refund_count"),
        F.sum("refund_amount").alias("refunded_amount"),
        F.max("refunded_at").alias("last_refunded_at"),
    )
    captured = F.when(F.col("payment_status") == "succeeded", F.col("amount")).otherwise(0)
    return attach(m["stg_payments"], refunds, ["payment_id"]).select(
        "payment_id", "order_id", "customer_id", "payment_method", "payment_status", "amount", "currency",
        "processed_at",
        or_zero(F.col("refund_count")).alias("refund_count"),
        money(or_zero(F.col("refunded_amount")), 12).alias("refunded_amount"),
        "last_refunded_at",
        money(captured - or_zero(F.col("refunded_amount")), 12).alias("net_amount"),
    )


@_model
def int_orders__payment_summary(m: Models) -> DataFrame:
    paid = F.col("payment_status") == "succeeded"
    return m["int_payments__with_refunds"].groupBy("order_id").agg(
        F.count_if(paid).alias("successful_payment_count"),
        F.count_if(F.col("payment_status") == "failed").alias("failed_attempt_count"),
        money(or_zero(_when_sum(paid, F.col("amount"))), 12).alias("amount_paid"),
        money(or_zero(F.sum("refunded_amount")), 12).alias("amount_refunded"),
        F.min(F.when(paid, F.col("processed_at"))).alias("first_paid_at"),
        F.max("last_refunded_at").alias("last_refunded_at"),
    )


@_model
def int_orders__item_summary(m: Models) -> DataFrame:
    category = m["stg_products"].select("product_id", "category")
    lines = attach(m["stg_order_items"].select("order_id", "product_id", "quantity", "line_amount"),
                   category, ["product_id"])
    # First one row per order and category, so that a huge order is combined before it meets one task.
    mix = lines.groupBy("order_id", "category").agg(
        F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("units"), F.sum("line_amount").alias("amount"))
    return mix.groupBy("order_id").agg(
        F.sum("n").alias("line_count"),
        F.sum("units").alias("units"),
        money(F.sum("amount"), 12).alias("items_subtotal"),
        F.count("category").alias("category_count"),
        F.bool_or(F.col("category") == "equipment").alias("has_equipment"),
        F.expr("listagg(category, ', ') WITHIN GROUP (ORDER BY category)").alias("categories"),
    )


@_model
def int_orders__enriched(m: Models) -> DataFrame:
    items = m["int_orders__item_summary"].select("order_id", "line_count", "units", "categories")
    cash = m["int_orders__payment_summary"].drop("last_refunded_at")
    joined = attach(attach(m["stg_orders"], items, ["order_id"]), cash, ["order_id"])
    paid, refunded = or_zero(F.col("amount_paid")), or_zero(F.col("amount_refunded"))
    earns = (F.col("order_status") != "cancelled") & (paid > 0)
    return joined.select(
        "order_id", "customer_id", "subscription_id", "campaign_id", "order_status", "sales_channel", "currency",
        "ordered_at", F.col("ordered_at").cast("date").alias("order_date"),
        "subtotal_amount", "discount_amount", "shipping_amount", "tax_amount", "total_amount",
        or_zero(F.col("line_count")).alias("line_count"),
        or_zero(F.col("units")).alias("units"),
        "categories",
        or_zero(F.col("successful_payment_count")).alias("successful_payment_count"),
        or_zero(F.col("failed_attempt_count")).alias("failed_attempt_count"),
        money(paid, 12).alias("amount_paid"),
        money(refunded, 12).alias("amount_refunded"),
        "first_paid_at",
        money(F.col("total_amount") - paid, 12).alias("balance_due"),
        earns.alias("is_revenue_order"),
        money(F.when(earns, F.col("total_amount") - F.col("tax_amount") - refunded).otherwise(0), 12)
        .alias("net_revenue"),
    )


@_model
def int_customers__order_history(m: Models) -> DataFrame:
    earning = F.col("is_revenue_order")
    net = F.sum("net_revenue")
    return m["int_orders__enriched"].groupBy("customer_id").agg(
        F.min("ordered_at").alias("first_order_at"),
        F.max("ordered_at").alias("last_order_at"),
        F.count_if(earning).alias("order_count"),
        F.count_if(earning & (F.col("sales_channel") == "subscription")).alias("subscription_order_count"),
        money(net, 14).alias("lifetime_net_revenue"),
        money(F.sum("amount_refunded"), 14).alias("lifetime_refunds"),
        money(ratio(money(net, 18), F.count_if(earning).cast("decimal(12,0)")), 12).alias("avg_order_value"),
    )


@_model
def int_subscriptions__mrr(m: Models) -> DataFrame:
    active = F.col("subscription_status") == "active"
    until = F.least(F.col("ended_on"), m.today)  # NULL end dates are ignored by least()
    return m["stg_subscriptions"].select(
        "subscription_id", "customer_id", "plan_code", "subscription_status", "billing_interval", "monthly_amount",
        "started_on", "ended_on",
        active.alias("is_active"),
        money(F.when(active, F.col("monthly_amount")).otherwise(0), 10).alias("mrr"),
        whole_months(F.col("started_on"), until).cast("int").alias("tenure_months"),
    )


@_model
def int_customers__support_summary(m: Models) -> DataFrame:
    recent = F.col("opened_at") >= F.date_sub(m.today, 90).cast("timestamp_ntz")
    rated = ratio(F.sum("csat_score").cast("decimal(20,0)"), F.count("csat_score").cast("decimal(20,0)"))
    return m["stg_tickets"].groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("ticket_count"),
        F.count_if(F.col("ticket_status").isin("open", "pending")).alias("open_ticket_count"),
        F.count_if(F.col("priority").isin("high", "urgent")).alias("escalated_ticket_count"),
        F.count_if(recent).alias("tickets_last_90d"),
        money(rated, 4).alias("avg_csat"),
        F.max("opened_at").alias("last_ticket_at"),
    )


@_model
def int_campaigns__attributed_orders(m: Models) -> DataFrame:
    orders = m["int_orders__enriched"].filter(F.col("campaign_id").isNotNull() & F.col("is_revenue_order"))
    first = m["int_customers__order_history"].select("customer_id", "first_order_at")
    return attach(orders, first, ["customer_id"]).select(
        "order_id", "campaign_id", "customer_id", "ordered_at", "net_revenue",
        (F.col("ordered_at") == F.col("first_order_at")).alias("is_new_customer_order"),
    )


@_model
def dim_customers(m: Models) -> DataFrame:
    contracts = m["int_subscriptions__mrr"].groupBy("customer_id").agg(
        F.count_if(F.col("is_active")).alias("active_subscription_count"),
        money(F.sum("mrr"), 12).alias("mrr"),
    )
    history = m["int_customers__order_history"]
    joined = attach(attach(m["stg_customers"], history, ["customer_id"]), contracts, ["customer_id"])
    live = or_zero(F.col("active_subscription_count"))
    return joined.select(
        "customer_id", "email", "first_name", "last_name", "country_code", "acquisition_channel",
        "customer_status", "signed_up_at", "first_order_at", "last_order_at",
        or_zero(F.col("order_count")).alias("order_count"),
        money(or_zero(F.col("lifetime_net_revenue")), 14).alias("lifetime_net_revenue"),
        money(or_zero(F.col("lifetime_refunds")), 14).alias("lifetime_refunds"),
        "avg_order_value",
        live.alias("active_subscription_count"),
        money(or_zero(F.col("mrr")), 12).alias("mrr"),
        (live > 0).alias("is_subscriber"),
        F.datediff(m.today, F.col("last_order_at").cast("date")).alias("days_since_last_order"),
    )


@_model
def dim_products(m: Models) -> DataFrame:
    earning = m["int_orders__enriched"].filter("is_revenue_order").select("order_id")
    lines = m["stg_order_items"].filter(F.col("order_id").isNotNull())
    sales = lines.join(earning, "order_id").groupBy("product_id").agg(
        F.sum("quantity").alias("units_sold"),
        money(F.sum("line_amount"), 14).alias("gross_sales"),
        F.countDistinct("order_id").alias("order_count"),
    )
    return attach(m["stg_products"], sales, ["product_id"]).select(
        "product_id", "sku", "product_name", "category", "list_price", "is_active", "launched_on",
        or_zero(F.col("units_sold")).alias("units_sold"),
        money(or_zero(F.col("gross_sales")), 14).alias("gross_sales"),
        or_zero(F.col("order_count")).alias("order_count"),
    )


@_model
def fct_orders(m: Models) -> DataFrame:
    who = m["dim_customers"].select(
        "customer_id",
        F.col("country_code").alias("customer_country_code"),
        F.col("acquisition_channel").alias("customer_acquisition_channel"),
        F.col("is_subscriber").alias("customer_is_subscriber"),
    )
    kept = m["int_orders__enriched"].drop(
        "categories", "successful_payment_count", "failed_attempt_count", "first_paid_at")
    return attach(kept, who, ["customer_id"]).select(
        "order_id", "customer_id", *[c for c in kept.columns if c not in ("order_id", "customer_id")],
        "customer_country_code", "customer_acquisition_channel", "customer_is_subscriber")


@_model
def fct_payments(m: Models) -> DataFrame:
    orders = m["stg_orders"].select("order_id", "order_status", "ordered_at")
    micros = F.expr("timestampdiff(MICROSECOND, ordered_at, processed_at)").cast("decimal(24,0)")
    return attach(m["int_payments__with_refunds"], orders, ["order_id"]).select(
        "payment_id", "order_id", "customer_id", "payment_method", "payment_status", "amount", "currency",
        "processed_at", "refund_count", "refunded_amount", "net_amount", "order_status", "ordered_at",
        F.round(micros / F.lit(60_000_000), 1).cast("decimal(20,1)").alias("minutes_from_checkout"),
    )


@_model
def fct_subscriptions(m: Models) -> DataFrame:
    country = m["dim_customers"].select("customer_id", F.col("country_code").alias("customer_country_code"))
    return attach(m["int_subscriptions__mrr"], country, ["customer_id"]).select(
        *m["int_subscriptions__mrr"].columns, "customer_country_code")


@_model
def fct_daily_revenue(m: Models) -> DataFrame:
    net, orders = F.sum("net_revenue"), F.count(F.lit(1))
    return m["fct_orders"].filter("is_revenue_order").groupBy("order_date", "currency").agg(
        orders.alias("orders"),
        F.sum("units").alias("units"),
        money(F.sum("subtotal_amount"), 14).alias("gross_sales"),
        money(F.sum("discount_amount"), 14).alias("discounts"),
        money(F.sum("amount_refunded"), 14).alias("refunds"),
        money(net, 14).alias("net_revenue"),
        money(money(net, 18) / orders.cast("decimal(12,0)"), 12).alias("average_order_value"),
    )


@_model
def fin_monthly_revenue_close(m: Models) -> DataFrame:
    sums = ["orders", "gross_sales", "discounts", "refunds", "net_revenue"]
    revenue = m["fct_daily_revenue"].groupBy(month_start(F.col("order_date")).alias("revenue_month"), "currency").agg(
        *[F.sum(c).alias(c) for c in sums])
    cash = m["fct_payments"].groupBy(
        month_start(F.col("processed_at").cast("date")).alias("revenue_month"), "currency").agg(
        _when_sum(F.col("payment_status") == "succeeded", F.col("amount")).alias("cash_collected"),
        F.sum("refunded_amount").alias("cash_refunded"))
    both = revenue.join(cash, ["revenue_month", "currency"], "full")
    return both.select(
        "revenue_month", "currency", or_zero(F.col("orders")).alias("orders"),
        *[money(or_zero(F.col(c)), 14).alias(c)
          for c in (*sums[1:], "cash_collected", "cash_refunded")])


@_model
def customer_lifetime_value(m: Models) -> DataFrame:
    days = F.datediff(m.today, F.col("first_order_at").cast("date"))
    tenure = F.greatest(F.lit(1).cast("decimal(20,8)"), (days.cast("decimal(16,8)") / F.lit(30.4).cast("decimal(3,1)"))
                        .cast("decimal(20,8)"))
    # Yearly retention by engagement.
    retention = F.when(F.col("is_subscriber"), 0.85).when(F.col("customer_status") == "active", 0.55).when(
        F.col("customer_status") == "inactive", 0.25).otherwise(0.05)
    valued = m["dim_customers"].filter("order_count > 0").withColumns({
        "tenure": tenure,
        "retention_factor": money(retention, 4),
    }).withColumn("monthly_value", money(F.col("lifetime_net_revenue") / F.col("tenure"), 12))
    outlook = F.greatest(F.col("monthly_value"), F.col("mrr")) * 12 * F.col("retention_factor")
    total = F.col("lifetime_net_revenue") + outlook
    # Tier thresholds.
    tier = F.when(total >= 1000, "platinum").when(total >= 400, "gold").when(total >= 150, "silver").otherwise("bronze")
    return valued.select(
        "customer_id", "country_code", "acquisition_channel", "customer_status", "is_subscriber", "order_count",
        F.round("tenure", 1).cast("decimal(12,1)").alias("tenure_months"),
        F.col("lifetime_net_revenue").alias("historical_value"), "monthly_value",
        money(outlook, 12).alias("predicted_12m_value"),
        money(total, 14).alias("customer_lifetime_value"),
        tier.alias("clv_tier"),
    )


@_model
def customer_health_scores(m: Models) -> DataFrame:
    support = m["int_customers__support_summary"].select(
        "customer_id", "open_ticket_count", "tickets_last_90d", "avg_csat")
    value = m["customer_lifetime_value"].select("customer_id", "clv_tier", "customer_lifetime_value")
    buyers = m["dim_customers"].filter("order_count > 0").select(
        "customer_id", "customer_status", "is_subscriber", "days_since_last_order")
    joined = attach(attach(buyers, support, ["customer_id"]), value, ["customer_id"])
    idle, tickets = F.col("days_since_last_order"), or_zero(F.col("tickets_last_90d"))
    waiting = or_zero(F.col("open_ticket_count"))
    # Points per component and band limits.
    unhappy = F.when(F.col("avg_csat") < 3, 8).otherwise(0)
    points = joined.withColumns({
        "open_ticket_count": waiting,
        "recency_points": F.when(idle <= 30, 40).when(idle <= 90, 30).when(idle <= 180, 15).otherwise(0),
        "subscription_points": F.when(F.col("is_subscriber"), 20).otherwise(0),
        "support_points": F.greatest(F.lit(0), 25 - 6 * waiting - 2 * tickets - unhappy),
        "value_points": F.when(F.col("clv_tier") == "platinum", 15).when(F.col("clv_tier") == "gold", 11).when(
            F.col("clv_tier") == "silver", 7).otherwise(3),
    })
    total = (F.col("recency_points") + F.col("subscription_points") + F.col("support_points")
             + F.col("value_points"))
    return points.select(
        "customer_id", "customer_status", "is_subscriber", "days_since_last_order", "open_ticket_count", "avg_csat",
        "clv_tier", "customer_lifetime_value", "recency_points", "subscription_points", "support_points",
        "value_points",
        F.least(F.lit(100), total).alias("health_score"),
        F.when(total >= 70, "healthy").when(total >= 40, "at_risk").otherwise("critical").alias("health_band"),
    )


@_model
def campaign_performance(m: Models) -> DataFrame:
    credited = m["int_campaigns__attributed_orders"].groupBy("campaign_id").agg(
        F.count(F.lit(1)).alias("attributed_orders"),
        money(F.sum("net_revenue"), 14).alias("attributed_revenue"),
        F.count_if(F.col("is_new_customer_order")).alias("new_customers"),
    )
    revenue = money(or_zero(F.col("attributed_revenue")), 14)
    return attach(m["stg_campaigns"], credited, ["campaign_id"]).select(
        "campaign_id", "campaign_name", "channel", "started_on", "ended_on", "budget_amount",
        or_zero(F.col("attributed_orders")).alias("attributed_orders"),
        revenue.alias("attributed_revenue"),
        or_zero(F.col("new_customers")).alias("new_customers"),
        money(ratio(revenue, F.col("budget_amount")), 14).alias("roas"),
        money(ratio(F.col("budget_amount"), F.col("new_customers").cast("decimal(12,0)")), 12)
        .alias("customer_acquisition_cost"),
    )


def live_subscriptions_by_month(months: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Subscriptions alive at each month's end, without joining months to subscriptions by range.

    A subscription is alive from the month it starts in until the month it ends in (exclusive), or for
    ever when it has no end or is still reported active. Counting +1 and -1 per month and summing up in
    month order gives the same numbers; the summed rows are one per calendar month.
    """
    born = month_start(F.col("started_on"))
    gone = F.when(~F.col("is_active"), month_start(F.col("ended_on")))
    alive = subscriptions.filter((F.col("subscription_status") != "paused") & F.col("started_on").isNotNull())
    changes = alive.select(
        F.explode(F.array(
            F.struct(born.alias("month"), F.lit(1).alias("sign")),
            F.struct(gone.alias("month"), F.lit(-1).alias("sign")),
        )).alias("change"), "monthly_amount", born.alias("born"), gone.alias("gone"),
    ).filter((F.col("gone").isNull() | (F.col("gone") > F.col("born"))) & F.col("change.month").isNotNull())
    deltas = changes.groupBy(F.col("change.month").alias("revenue_month")).agg(
        F.sum("change.sign").alias("opened"),
        F.sum(F.col("change.sign") * F.col("monthly_amount")).alias("amount"))
    timeline = deltas.withColumn("asked", F.lit(False)).unionByName(
        months.select("revenue_month", F.lit(0).cast("bigint").alias("opened"),
                      F.lit(0).cast("decimal(22,2)").alias("amount"), F.lit(True).alias("asked")))
    upto = Window.orderBy("revenue_month").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return timeline.select(
        "revenue_month", "asked",
        F.sum("opened").over(upto).alias("active_subscriptions"),
        money(F.sum("amount").over(upto), 14).alias("ending_mrr"),
    ).filter("asked").drop("asked")


@_model
def rpt_executive_kpis(m: Models) -> DataFrame:
    sums = ["orders", "net_revenue", "refunds", "cash_collected"]
    revenue = m["fin_monthly_revenue_close"].groupBy("revenue_month").agg(*[F.sum(c).alias(c) for c in sums])
    buyers = m["fct_orders"].filter("is_revenue_order").groupBy(
        month_start(F.col("order_date")).alias("revenue_month")).agg(
        F.countDistinct("customer_id").alias("active_customers"))
    recurring = live_subscriptions_by_month(revenue.select("revenue_month"), m["fct_subscriptions"])
    marketing = m["campaign_performance"].groupBy(month_start(F.col("started_on")).alias("revenue_month")).agg(
        F.sum("budget_amount").alias("marketing_spend"), F.sum("new_customers").alias("new_customers"))
    people = F.count(F.lit(1)).cast("decimal(18,0)")
    health = m["customer_health_scores"].agg(
        F.first(month_start(m.today)).alias("revenue_month"),
        money(ratio(F.sum("health_score").cast("decimal(20,0)"), people), 5, 1).alias("avg_health_score"),
        money(ratio(F.count_if(F.col("health_band") != "healthy").cast("decimal(20,0)"), people), 5, 3)
        .alias("share_customers_at_risk"))
    joined = revenue
    for part in (buyers, recurring, marketing, health):
        joined = joined.join(part, "revenue_month", "left")
    return joined.select(
        "revenue_month", "orders",
        *[money(F.col(c), 14).alias(c) for c in sums[1:]],
        money(ratio(money(F.col("net_revenue"), 18), F.col("orders").cast("decimal(12,0)")), 12)
        .alias("average_order_value"),
        or_zero(F.col("active_customers")).alias("active_customers"),
        "active_subscriptions", money(F.col("ending_mrr"), 14).alias("ending_mrr"),
        money(or_zero(F.col("marketing_spend")), 14).alias("marketing_spend"),
        or_zero(F.col("new_customers")).alias("campaign_new_customers"),
        money(ratio(money(F.col("marketing_spend"), 18), F.col("new_customers").cast("decimal(12,0)")), 12)
        .alias("blended_cac"),
        "avg_health_score", "share_customers_at_risk",
    )
