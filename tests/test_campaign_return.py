"""Return on ad spend of a campaign whose revenue is over a million times its budget."""

from decimal import Decimal

from plumbline.plans.marts import Models


def test_return_over_a_million(spark):
    campaigns = spark.sql("SELECT 'c' AS campaign_id, 'n' AS campaign_name, 'email' AS channel, DATE '2000-01-01' AS started_on, "
                          "DATE '2000-02-01' AS ended_on, CAST(1000 AS DECIMAL(12,2)) AS budget_amount")
    models = Models({"stg_campaigns": campaigns}, "2001-08-01")
    models._built["int_campaigns__attributed_orders"] = spark.sql(
        "SELECT 'c' AS campaign_id, CAST(1255547744.50 AS DECIMAL(12,2)) AS net_revenue, true AS is_new_customer_order")
    row = models["campaign_performance"].first()
    assert row["roas"] == Decimal("1255547.74") and row["customer_acquisition_cost"] == Decimal("1000.00")
