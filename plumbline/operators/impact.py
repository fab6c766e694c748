"""Blast radius of defects: which assets, teams, outputs and terms a broken asset reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.lineage import origin_systems, reach, unreferenced_consumers

# A duplicated row reaches every consumer, whatever columns it reads.
ROW_LEVEL_CATEGORIES = ("duplicate_identifier",)
_NO_TEXT = "array<string>"


def defects_of_rules(rules: DataFrame) -> DataFrame:
    """(seed, asset, columns) per rule; row-level categories track no columns."""
    row_level = F.col("category").isin(*ROW_LEVEL_CATEGORIES)
    return rules.select(F.col("rule_key").alias("seed"), "asset",
                        F.when(row_level, F.array().cast(_NO_TEXT)).otherwise(F.col("columns")).alias("columns"))


def impacted_assets(edges: DataFrame, nodes: DataFrame, defects: DataFrame) -> DataFrame:
    """All impacted assets of all defects at once, with depth, path, ownership and flags."""
    flags = nodes.select(
        "asset", "asset_type", "layer", "criticality", "owner",
        F.col("criticality").isin("high", "critical").alias("is_critical"),
        "is_financial", "is_customer_facing",
        (F.coalesce(F.col("audience") == "executive", F.lit(False)) | (F.col("domain") == "executive"))
        .alias("is_executive"))
    return reach(edges, defects).join(flags, "asset").select("seed", *[c for c in (
        "asset", "depth", "path", "asset_type", "layer", "criticality", "owner", "is_critical", "is_financial",
        "is_customer_facing", "is_executive")])


def impact_summary(edges: DataFrame, nodes: DataFrame, defects: DataFrame,
                   impacted: DataFrame | None = None) -> DataFrame:
    """One row per defect: counts, flags, distances, outputs and teams (the broken asset's owner first)."""
    hit = impacted_assets(edges, nodes, defects) if impacted is None else impacted
    names = lambda flag: F.transform(
        F.array_sort(F.collect_list(F.when(flag, F.struct("depth", "asset")))), lambda s: s["asset"])
    totals = hit.groupBy("seed").agg(
        F.count(F.lit(1)).alias("downstream_count"),
        F.count_if(F.col("is_critical")).alias("critical_count"),
        F.count_if(F.col("layer") == "mart").alias("mart_count"),
        F.count_if(F.col("asset_type") == "exposure").alias("exposure_count"),
        F.bool_or("is_financial").alias("financial"),
        F.bool_or("is_customer_facing").alias("customer_facing"),
        F.bool_or("is_executive").alias("executive"),
        F.min(F.when(F.col("is_executive"), F.col("depth"))).alias("hops_to_executive"),
        F.max("depth").alias("max_depth"),
        names(F.col("asset_type") == "exposure").alias("exposures"),
        names(F.col("is_critical")).alias("critical_assets"),
        names(F.col("depth") == 1).alias("direct_consumers"),
        F.array_sort(F.collect_set("owner")).alias("_owners"))
    spared = unreferenced_consumers(edges, defects).groupBy("seed").agg(
        F.array_sort(F.collect_set("asset")).alias("unaffected_consumers"))
    own = nodes.select("asset", F.col("owner").alias("own_team"), F.col("criticality").alias("asset_criticality"))
    joined = defects.join(own, "asset", "left").join(totals, "seed", "left").join(spared, "seed", "left")
    none = F.array().cast(_NO_TEXT)
    first = F.when(F.col("own_team").isNotNull(), F.array("own_team")).otherwise(none)
    teams = F.concat(first, F.array_except(F.coalesce("_owners", none), first))

    def number(name: str):
        return F.coalesce(F.col(name), F.lit(0)).cast("int").alias(name)

    def flag(name: str):
        return F.coalesce(F.col(name), F.lit(False)).alias(name)

    def names_or_none(name: str):
        return F.coalesce(F.col(name), none).alias(name)

    return joined.select(
        "seed", "asset", "columns", "asset_criticality", number("downstream_count"), number("critical_count"),
        number("mart_count"), number("exposure_count"), flag("financial"), flag("customer_facing"), flag("executive"),
        "hops_to_executive", number("max_depth"), names_or_none("direct_consumers"), names_or_none("exposures"),
        names_or_none("critical_assets"), names_or_none("unaffected_consumers"), teams.alias("teams"))


def touched_terms(defects: DataFrame, impacted: DataFrame, terms: DataFrame, links: DataFrame) -> DataFrame:
    """(seed, terms): terms of the asset, of its affected columns, and of every impacted asset.

    Deprecated terms are left out.
    """
    live = links.join(terms.filter("status <> 'deprecated'"), "term_key").select(
        F.col("asset").alias("_asset"), "column_name", "term")
    own = defects.withColumnRenamed("asset", "_asset").join(live, "_asset").filter(
        F.col("column_name").isNull() | (F.size("columns") == 0) | F.array_contains("columns", F.col("column_name"))
    ).select("seed", "term")
    beyond = impacted.select("seed", F.col("asset").alias("_asset")).join(live, "_asset").select("seed", "term")
    named = own.unionByName(beyond).groupBy("seed").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    return defects.select("seed").join(named, "seed", "left").select(
        "seed", F.coalesce("terms", F.array().cast(_NO_TEXT)).alias("terms"))


def related_rules(defects: DataFrame, rules: DataFrame) -> DataFrame:
    """(seed, rules): other and own rules on the broken asset."""
    per_asset = rules.groupBy("asset").agg(F.array_sort(F.collect_list("rule_key")).alias("rules"))
    return defects.join(per_asset, "asset", "left").select("seed", "rules")


def source_systems(edges: DataFrame, nodes: DataFrame, defects: DataFrame) -> DataFrame:
    return origin_systems(edges, nodes, defects)


def critical_elements(defects: DataFrame, columns: DataFrame) -> DataFrame:
    """(seed, critical_columns): critical data elements among the failing columns, in rule order."""
    listed = defects.select("seed", "asset", F.posexplode("columns").alias("pos", "column_name"))
    hits = listed.join(columns.filter("is_critical"), ["asset", "column_name"]).groupBy("seed").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "column_name", "category"))),
                    lambda c: F.struct(c["column_name"].alias("column_name"), c["category"].alias("category")))
        .alias("critical_columns"))
    empty = F.array().cast("array<struct<column_name:string,category:string>>")
    return defects.select("seed").join(hits, "seed", "left").select(
        "seed", F.coalesce("critical_columns", empty).alias("critical_columns"))


def owners_affected(impacted: DataFrame, defects: DataFrame, nodes: DataFrame) -> DataFrame:
    """(seed, owner, owned_assets): teams with the assets they own inside the blast radius."""
    touched = impacted.select("seed", "asset").unionByName(defects.select("seed", "asset"))
    return touched.join(nodes.select("asset", "owner").filter("owner IS NOT NULL"), "asset").groupBy(
        "seed", "owner").agg(F.array_sort(F.collect_set("asset")).alias("owned_assets"))


def issues_upstream(edges: DataFrame, nodes: DataFrame, issues: DataFrame) -> DataFrame:
    """(asset, rule_key, issue_key, source_asset, depth, priority_band): open issues on the ancestors of every asset, by fewest hops.

    Unlike ``inherited_issues`` every ancestor counts, whatever columns the failing rule is about: it is what to look at before an
    asset is trusted. All assets with open issues are followed downstream together.
    """
    open_issues = issues.filter("status <> 'resolved'").select(
        "rule_key", "issue_key", F.col("asset").alias("source_asset"), "priority_band")
    starts = open_issues.select(F.col("source_asset").alias("seed"), F.col("source_asset").alias("asset")).distinct()
    below = reach(edges, starts).join(nodes.select("asset"), "asset", "left_semi").select(F.col("seed").alias("source_asset"), "asset", "depth")
    return below.join(open_issues, "source_asset").select("asset", "rule_key", "issue_key", "source_asset", "depth", "priority_band")


def inherited_issues(impacted: DataFrame, issues: DataFrame) -> DataFrame:
    """(asset, rule_key, source_asset, depth): open issues that reach an asset from upstream."""
    open_issues = issues.filter("status <> 'resolved'").select(
        F.col("rule_key").alias("seed"), F.col("asset").alias("source_asset"))
    return impacted.select("seed", "asset", "depth").join(open_issues, "seed").select(
        "asset", F.col("seed").alias("rule_key"), "source_asset", "depth")
