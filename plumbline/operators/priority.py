"""Additive priority scoring as column expressions.

Ten capped factors sum to 100. The defect group looks at the broken rows, the blast-radius group at what
depends on them; the latter alone, scaled to 100, is the impact score. Points are rounded half up on
decimals; a scorer that rounds binary floats can differ in the last digit on exact ties.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import lookup

# Weights of the factors.
MAX_POINTS = {
    "severity": 20, "affected_volume": 8, "affected_rate": 7, "dataset_criticality": 10, "field_criticality": 10,
    "downstream_dependencies": 10, "critical_downstream": 10, "financial_reporting": 8,
    "executive_or_customer_facing": 9, "multi_team": 8,
}
DEFECT = ("severity", "affected_volume", "affected_rate", "dataset_criticality", "field_criticality")
BLAST = ("downstream_dependencies", "critical_downstream", "financial_reporting", "executive_or_customer_facing",
         "multi_team")
SEVERITY_POINTS = {"critical": 20, "high": 14, "medium": 8, "low": 3}
CRITICALITY_POINTS = {"critical": 10, "high": 7, "medium": 4, "low": 1}
SATURATION_RECORDS, SATURATION_RATE, SATURATION_ASSETS = 10_000, 0.05, 25
CRITICAL_FIELD, SENSITIVE_FIELD = 6, 4
SENSITIVE = ("financial", "identifier", "customer_identifier")
PER_CRITICAL_ASSET, PER_EXTRA_TEAM = 0.5, 1.6
EXECUTIVE, FREE_HOPS, HOP_DECAY, EXECUTIVE_MIN, CUSTOMER_FACING = 9, 2, 1, 5, 7
BANDS = ((80, "P1"), (65, "P2"), (45, "P3"), (0, "P4"))
IMPACT_LEVELS = ((75, "severe"), (50, "high"), (25, "moderate"), (1, "low"), (0, "none"))


def _points(name: str, value: Column) -> Column:
    exact = F.least(F.lit(MAX_POINTS[name]), F.greatest(F.lit(0), value)).cast("decimal(20,10)")
    return F.round(exact, 1).cast("decimal(5,1)").alias(f"pts_{name}")


def factor_points() -> list[Column]:
    """One column per factor over: severity, failed, scanned, asset_criticality, critical_columns and the
    impact summary's columns."""
    failed, scanned = F.col("failed"), F.col("scanned")
    rate = F.when(scanned > 0, failed / scanned).otherwise(0.0)
    volume = MAX_POINTS["affected_volume"] * F.least(
        F.lit(1.0), F.log10(failed + 1) / math.log10(SATURATION_RECORDS + 1))
    categories = F.transform("critical_columns", lambda c: c["category"])
    fields = F.when(F.size("critical_columns") > 0, CRITICAL_FIELD).otherwise(0) + F.when(
        F.arrays_overlap(categories, F.array(*[F.lit(c) for c in SENSITIVE])), SENSITIVE_FIELD).otherwise(0)
    extra = F.greatest(F.lit(0), F.col("hops_to_executive") - FREE_HOPS)
    exposed = F.when(F.col("executive"), F.greatest(F.lit(EXECUTIVE_MIN), EXECUTIVE - HOP_DECAY * extra)).when(
        F.col("customer_facing"), CUSTOMER_FACING).otherwise(0)
    downstream = MAX_POINTS["downstream_dependencies"] * F.least(
        F.lit(1.0), F.col("downstream_count") / SATURATION_ASSETS)
    return [
        _points("severity", lookup(F.col("severity"), SEVERITY_POINTS, 0)),
        _points("affected_volume", volume),
        _points("affected_rate", MAX_POINTS["affected_rate"] * F.least(F.lit(1.0), rate / SATURATION_RATE)),
        _points("dataset_criticality", lookup(F.col("asset_criticality"), CRITICALITY_POINTS, 0)),
        _points("field_criticality", fields),
        _points("downstream_dependencies", downstream),
        _points("critical_downstream", PER_CRITICAL_ASSET * F.col("critical_count")),
        _points("financial_reporting", F.when(F.col("financial"), MAX_POINTS["financial_reporting"]).otherwise(0)),
        _points("executive_or_customer_facing", exposed),
        _points("multi_team", PER_EXTRA_TEAM * F.greatest(F.lit(0), F.size("teams") - 1)),
    ]


def _sum(names: tuple[str, ...]) -> Column:
    total = F.lit(0).cast("decimal(6,1)")
    for name in names:
        total = total + F.col(f"pts_{name}")
    return total.cast("decimal(6,1)")


def grade(score: Column, steps: tuple[tuple[int, str], ...]) -> Column:
    out = None
    for limit, name in steps:
        out = F.when(score >= limit, name) if out is None else out.when(score >= limit, name)
    return out


def score(signals: DataFrame) -> DataFrame:
    """Add factor points, priority score and band, and impact score and level."""
    pointed = signals.select("*", *factor_points())
    blast = sum(MAX_POINTS[n] for n in BLAST)
    out = pointed.withColumns({
        "defect_points": _sum(DEFECT),
        "blast_radius_points": _sum(BLAST),
        "priority_score": F.least(F.lit(100).cast("decimal(6,1)"), _sum(DEFECT + BLAST)),
    })
    impact = F.round(F.col("blast_radius_points") * 100 / blast, 1).cast("decimal(6,1)")
    return out.withColumns({
        "priority_band": grade(F.col("priority_score"), BANDS),
        "impact_score": impact,
        "impact_level": grade(impact, IMPACT_LEVELS),
    })


def breakdown(scored: DataFrame, key: str = "seed") -> DataFrame:
    """(key, factor, factor_group, points, max_points): one row per factor."""
    rows = F.array(*[
        F.struct(F.lit(n).alias("factor"), F.lit("defect" if n in DEFECT else "blast_radius").alias("factor_group"),
                 F.col(f"pts_{n}").alias("points"), F.lit(m).alias("max_points"))
        for n, m in MAX_POINTS.items()])
    return scored.select(key, F.explode(rows).alias("f")).select(key, "f.*")


def reasons() -> dict[str, Column]:
    """A short explanation per factor."""
    failed, scanned = F.col("failed").cast("string"), F.col("scanned").cast("string")
    names = F.array_join(F.transform("critical_columns", lambda c: c["column_name"]), ", ")
    return {
        "severity": F.concat(F.lit("severity "), F.col("severity")),
        "affected_volume": F.concat(failed, F.lit(" failing rows")),
        "affected_rate": F.concat(failed, F.lit(" of "), scanned, F.lit(" scanned rows")),
        "dataset_criticality": F.concat(F.lit("dataset is "), F.col("asset_criticality")),
        "field_criticality": F.when(F.size("critical_columns") > 0, F.concat(F.lit("critical columns: "), names))
        .otherwise("no critical column"),
        "downstream_dependencies": F.concat(F.col("downstream_count").cast("string"), F.lit(" dependent assets")),
        "critical_downstream": F.concat(F.col("critical_count").cast("string"), F.lit(" critical consumers")),
        "financial_reporting": F.when(F.col("financial"), "reaches financial reporting").otherwise(
            "no financial reporting"),
        "executive_or_customer_facing": F.when(F.col("executive"), F.concat(
            F.lit("executive reporting in "), F.col("hops_to_executive").cast("string"), F.lit(" hops"))).when(
            F.col("customer_facing"), "customer-facing output").otherwise("no exposed output"),
        "multi_team": F.concat(F.size("teams").cast("string"), F.lit(" teams: "), F.array_join("teams", ", ")),
    }


def top_reasons(n: int = 3) -> Column:
    """Reasons of the n highest factors with points, ties in factor order."""
    said = reasons()
    ranked = F.array_sort(F.array(*[
        F.struct((-F.col(f"pts_{name}")).alias("minus"), F.lit(i).alias("i"), said[name].alias("reason"))
        for i, name in enumerate(MAX_POINTS)]))
    kept = F.filter(F.slice(ranked, 1, n), lambda f: f["minus"] < 0)
    return F.transform(kept, lambda f: f["reason"])


def signals(results: DataFrame, rules: DataFrame, impact: DataFrame, critical: DataFrame) -> DataFrame:
    """Join what the scorer needs: (rule results) x (rule) x (impact summary) x (critical columns)."""
    facts = results.select(F.col("rule_key").alias("seed"), "scanned", "failed")
    rule = rules.select(F.col("rule_key").alias("seed"), "severity", "category")
    return facts.join(rule, "seed").join(impact, "seed").join(critical, "seed")
