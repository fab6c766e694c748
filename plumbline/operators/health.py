"""Health scores and the read models over quality runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import lookup, position
from plumbline.operators.rules import SEVERITIES, SEVERITY_WEIGHT

# Fixed value: failure rate at which a rule's score reaches zero.
FULL_PENALTY_RATE = 0.05


def rule_score(status: Column, rate: Column) -> Column:
    """1 for a pass, NULL for an error, at most one half for a failure."""
    lost = F.least(F.lit(1.0), rate / FULL_PENALTY_RATE)
    return F.when(status == "pass", 1.0).when(status == "fail", F.round(0.5 * (1 - lost), 4))


def severity_weight(severity: Column) -> Column:
    return lookup(severity, SEVERITY_WEIGHT, None).cast("int")


def weighted_health(digits: int) -> Column:
    """Severity-weighted mean of ``rule_score`` on a 0-100 scale; unscored rules do not count."""
    weight = F.when(F.col("rule_score").isNotNull(), F.col("severity_weight"))
    total = F.sum(weight)
    return F.round(F.when(total > 0, 100 * F.sum(F.col("rule_score") * weight) / total), digits)


def scored_results(results: DataFrame, rules: DataFrame) -> DataFrame:
    """Results joined with their (small) rule catalogue and scored."""
    meta = rules.select("rule_key", "rule_name", "asset", "category", "rule_type", "severity", "severity_weight",
                        "columns", "business_impact")
    return results.join(meta, "rule_key").withColumn(
        "rule_score", rule_score(F.col("status"), F.col("failure_rate")))


def run_health(scored: DataFrame, by: tuple[str, ...] = ("run_id", "as_of")) -> DataFrame:
    """Per run: rules executed, failed, in error, and health."""
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rules_executed"),
        F.count_if(F.col("status") == "fail").alias("rules_failed"),
        F.count_if(F.col("status") == "error").alias("rules_errored"),
        weighted_health(2).alias("health"))


def health_trend(runs: DataFrame) -> DataFrame:
    """Runs in time order with the change against the run seven runs earlier."""
    order = Window.orderBy("as_of", "run_id")  # one row per run
    change = F.round(F.col("health") - F.lag("health", 7).over(order), 2)
    return runs.withColumns({"run_number": F.row_number().over(order), "health_change_7": change})


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.agg(F.max_by("run_id", F.struct("as_of", "run_id")).alias("run_id"))


def of_latest_run(scored: DataFrame) -> DataFrame:
    return scored.join(latest_run(scored), "run_id", "left_semi")


def asset_health(scored: DataFrame, nodes: DataFrame) -> DataFrame:
    per_asset = scored.groupBy("asset").agg(
        F.count(F.lit(1)).alias("rules"),
        F.count_if(F.col("status") == "fail").alias("failing_rules"),
        weighted_health(1).alias("health"))
    return per_asset.join(nodes.select("asset", "layer", "owner"), "asset")


def results_table(scored: DataFrame, nodes: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """One run's results with owner and open issue, failures first, then by severity and count."""
    out = scored.join(nodes.select("asset", "layer", "owner"), "asset", "left")
    if issues is not None:
        current = issues.select("rule_key", "issue_key", F.col("last_run_id").alias("run_id"))
        out = out.join(current, ["rule_key", "run_id"], "left")
    return out.orderBy(F.col("status") == "pass", position(F.col("severity"), SEVERITIES), F.desc("failed"), "rule_key")


def category_trend(scored: DataFrame) -> DataFrame:
    return scored.groupBy("as_of", "category").agg(
        F.count_if(F.col("status") == "fail").alias("failing_rules"),
        F.coalesce(F.sum("failed"), F.lit(0)).alias("failing_records"))


def rule_history(scored: DataFrame, rule_key: str) -> DataFrame:
    return scored.filter(F.col("rule_key") == rule_key).select(
        "as_of", "run_id", "status", "scanned", "failed", "failure_rate").orderBy("as_of", "run_id")


def failing_assets(scored_latest: DataFrame, nodes: DataFrame, issues: DataFrame, spells: DataFrame) -> DataFrame:
    """Assets failing in the latest run, with their worst numbers, since when their issues are open and they fail without a break.

    ``spells`` are the failing stretches of the rules; those still going on count.
    """
    open_issues = issues.filter("status <> 'resolved'").select("rule_key", "first_detected_at")
    going_on = spells.filter("ended_at IS NULL").select("rule_key", "started_at", "runs")
    failing = scored_latest.filter("status = 'fail'").join(open_issues, "rule_key", "left").join(going_on, "rule_key", "left")
    return failing.groupBy("asset").agg(
        F.count(F.lit(1)).alias("failing_rules"), F.count("first_detected_at").alias("open_issues"), F.sum("failed").alias("failing_records"),
        weighted_health(1).alias("health"), F.min("first_detected_at").alias("failing_since"),
        F.min("started_at").alias("without_a_break_since"), F.max("runs").alias("failing_runs"),
    ).join(nodes.select("asset", "layer", "owner"), "asset").orderBy(
        F.desc_nulls_last("failing_since"), F.desc("failing_rules"), "asset")


def headline(nodes: DataFrame, columns: DataFrame, scored_latest: DataFrame, issues: DataFrame, trend: DataFrame,
             rules: DataFrame, terms: DataFrame) -> DataFrame:
    """One row of headline numbers; every input is aggregated to a single row first."""
    working = F.col("status").isin("open", "investigating")
    parts = [
        nodes.agg(F.count_if(F.col("asset_type").isin("source", "model")).alias("datasets"),
                  F.count_if(F.col("asset_type") == "exposure").alias("exposures"), F.count_distinct("owner").alias("teams")),
        rules.agg(F.count(F.lit(1)).alias("rules_defined")),
        terms.agg(F.count(F.lit(1)).alias("glossary_terms")),
        columns.agg(F.count(F.lit(1)).alias("columns"), F.count_if("is_critical").alias("critical_fields")),
        scored_latest.agg(F.count(F.lit(1)).alias("rules_executed"),
                          F.count_if(F.col("status") == "fail").alias("rules_failing")),
        issues.agg(F.count_if(working).alias("open_issues"),
                   F.count_if(F.col("status") == "accepted").alias("accepted_issues"),
                   F.count_if(working & (F.col("priority_band") == "P1")).alias("p1_issues"),
                   F.count_if(working & (F.col("severity") == "critical")).alias("critical_issues")),
        trend.agg(F.max_by("health", "run_number").alias("health"),
                  F.max_by("health_change_7", "run_number").alias("health_change_7"),
                  F.max_by(F.round(F.col("health") - F.col("health_change_7"), 2), "run_number").alias("health_7_runs_ago")),
    ]
    # Single-row inputs meet on a constant key.
    keyed = [p.withColumn("_one", F.lit(1)) for p in parts]
    out = keyed[0]
    for part in keyed[1:]:
        out = out.join(part, "_one")
    return out.drop("_one")
