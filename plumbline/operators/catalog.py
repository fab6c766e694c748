"""Catalogue, glossary and search over metadata tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import lookup, position

# Points per field a search word can match.
FIELD_WEIGHTS = {"name": 10, "column": 6, "glossary": 5, "owner": 4, "domain": 4, "source_system": 4, "description": 2}
_FIELD_ORDER = tuple(FIELD_WEIGHTS)
#: Columns and terms that a reason names at most.
EXAMPLES = 3
# Order of criticality and layers.
CRITICALITY_RANK = {"critical": 3, "high": 2, "medium": 1, "low": 0}
LAYER_ORDER = ("raw", "staging", "intermediate", "mart", "exposure")


def parse_links(terms: DataFrame) -> DataFrame:
    """(term_key, asset, column_name) from terms with a ``links`` array of 'asset' or 'asset.column'."""
    link = terms.select("term_key", F.explode("links").alias("link"))
    parts = F.split("link", r"\.", 2)
    return link.select("term_key", parts[0].alias("asset"),
                       F.nullif(F.try_element_at(parts, F.lit(2)), F.lit("")).alias("column_name"))


def reference_problems(assets: DataFrame, teams: DataFrame, systems: DataFrame, links: DataFrame,
                       columns: DataFrame) -> DataFrame:
    """(subject, problem): owners, source systems and glossary links that do not resolve."""
    owned = assets.filter("owner IS NOT NULL")
    known = teams.select(F.col("team").alias("owner")).distinct()
    system = systems.select("source_system").distinct()
    names = assets.select("asset").distinct()
    columns_known = columns.select("asset", "column_name").distinct()
    linked = links.join(names, "asset", "left_semi").filter("column_name IS NOT NULL")
    subject = F.concat("asset", F.lit("."), "column_name")
    parts = [
        assets.filter("owner IS NULL").select(F.col("asset").alias("subject"), F.lit("missing owner").alias("problem")),
        owned.join(known, "owner", "left_anti").select("asset", F.lit("unknown owner").alias("problem")),
        assets.filter("asset_type = 'source'").join(system, "source_system", "left_anti").select(
            "asset", F.lit("unknown source system").alias("problem")),
        links.join(names, "asset", "left_anti").select("asset", F.lit("unknown linked asset").alias("problem")),
        linked.join(columns_known, ["asset", "column_name"], "left_anti").select(
            subject, F.lit("unknown linked column").alias("problem")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def search_index(assets: DataFrame, columns: DataFrame, terms: DataFrame, links: DataFrame,
                 systems: DataFrame | None = None) -> DataFrame:
    """One row per searchable value: (asset, field, value).

    ``systems`` is (asset, source_system) for assets that inherit their systems from upstream.
    """
    fields = [
        assets.select("asset", F.lit("name").alias("field"), F.col("asset").alias("value")),
        assets.select("asset", F.lit("owner").alias("field"), F.col("owner").alias("value")),
        assets.select("asset", F.lit("domain").alias("field"), F.col("domain").alias("value")),
        assets.select("asset", F.lit("description").alias("field"), F.col("description").alias("value")),
        columns.select("asset", F.lit("column").alias("field"), F.col("column_name").alias("value")),
        links.join(terms.select("term_key", "term"), "term_key").select(
            "asset", F.lit("glossary").alias("field"), F.col("term").alias("value")).distinct(),
    ]
    if systems is not None:
        fields.append(systems.select("asset", F.lit("source_system").alias("field"),
                                     F.col("source_system").alias("value")))
    out = fields[0]
    for field in fields[1:]:
        out = out.unionByName(field)
    return out.filter("value IS NOT NULL")


def tokens(query: str) -> list[str]:
    """The words of a query, in lower case and in order; a word asked for twice counts twice."""
    return re.findall(r"[^\s,]+", query.lower())


def search(index: DataFrame, assets: DataFrame, query: str, **filters: Sequence[str]) -> DataFrame:
    """(asset, score, reasons): assets where every word matches some field.

    A word scores its best field, doubled when it is the asset's exact name. ``filters`` keeps assets whose
    column has one of the given values.
    """
    asked = tokens(query)
    words = list(dict.fromkeys(asked))
    chosen = assets
    for column, wanted in filters.items():
        if wanted:
            chosen = chosen.filter(F.col(column).isin(*wanted))
    rank = lookup(F.col("criticality"), CRITICALITY_RANK, 0)
    if not words:
        hits = chosen.select("asset", "criticality", F.lit(0.0).alias("score"),
                             F.array().cast("array<string>").alias("reasons"))
        return hits.orderBy(rank.desc(), "asset").drop("criticality")
    matched = index.withColumn("word", F.explode(F.array(*[F.lit(w) for w in words]))).filter(
        F.contains(F.lower("value"), F.col("word")))
    weight = lookup(F.col("field"), FIELD_WEIGHTS, 0)
    place = position(F.col("field"), _FIELD_ORDER)
    # First per field, so that an asset with very many columns is combined before it is ranked.
    first = Window.partitionBy("asset", "word", "field").orderBy("value")
    examples = matched.select("asset", "word", "field", "value").distinct().withColumn("n", F.row_number().over(first)).filter(
        F.col("n") <= EXAMPLES)
    per_field = examples.groupBy("asset", "word", "field").agg(
        F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("example"))
    per_word = per_field.groupBy("asset", "word").agg(
        F.max(weight).alias("best"),
        F.max_by(F.struct("field", "example"), F.struct(weight, -place)).alias("hit"))
    detail = F.when(F.col("hit.field").isin("column", "glossary"), F.concat(
        "hit.field", F.lit(": "), "hit.example")).otherwise(
        F.concat(F.replace(F.col("hit.field"), F.lit("_"), F.lit(" ")), F.lit(" matches "), "word"))
    times = lookup(F.col("word"), {w: asked.count(w) for w in words}, 1)
    points = F.col("best") * F.when(F.lower("asset") == F.col("word"), 2).otherwise(1) * times
    scored = per_word.groupBy("asset").agg(
        F.count(F.lit(1)).alias("words"), F.sum(points).cast("double").alias("score"),
        F.array_sort(F.collect_set(detail)).alias("reasons")).filter(F.col("words") == len(words))
    found = scored.join(chosen.select("asset", "criticality"), "asset")
    return found.orderBy(F.desc("score"), rank.desc(), "asset").select("asset", "score", "reasons")


def filter_options(assets: DataFrame, facets: Sequence[str]) -> DataFrame:
    """(facet, value): the distinct values to offer per facet."""
    cells = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).alias("value")) for f in facets])
    return assets.select(F.explode(cells).alias("c")).select("c.*").filter("value IS NOT NULL").distinct()


def glossary_terms(terms: DataFrame, links: DataFrame, query: str = "", domains: Sequence[str] | None = None,
                   statuses: Sequence[str] | None = None) -> DataFrame:
    """Terms matching a text in name or definition, with link, asset and column counts."""
    out = terms
    if query.strip():
        pattern = f"%{query.strip()}%"
        out = out.filter(F.col("term").ilike(pattern) | F.col("definition").ilike(pattern)
                         | F.array_join("synonyms", " ").ilike(pattern))
    if domains:
        out = out.filter(F.col("domain").isin(*domains))
    if statuses:
        out = out.filter(F.col("status").isin(*statuses))
    counts = links.groupBy("term_key").agg(
        F.count(F.lit(1)).alias("link_count"), F.count_distinct("asset").alias("asset_count"),
        F.count("column_name").alias("column_count"))
    counted = out.join(counts, "term_key", "left")
    return counted.select("term_key", "term", "domain", "status", *[
        F.coalesce(c, F.lit(0)).alias(c) for c in ("link_count", "asset_count", "column_count")]).orderBy("term")


def term_links(links: DataFrame, assets: DataFrame, columns: DataFrame, term_key: str) -> DataFrame:
    """Where a term is used, in layer order."""
    used = links.filter(F.col("term_key") == term_key).join(assets.select("asset", "layer"), "asset")
    detail = used.join(columns.select("asset", "column_name", "is_critical"), ["asset", "column_name"], "left")
    return detail.select("asset", "layer", "column_name", "is_critical").orderBy(
        position(F.col("layer"), LAYER_ORDER), "asset", F.asc_nulls_first("column_name"))


def asset_columns(columns: DataFrame, links: DataFrame, terms: DataFrame, profiles: DataFrame) -> DataFrame:
    """Columns of assets with their glossary terms and latest profile."""
    named = links.filter("column_name IS NOT NULL").join(terms.select("term_key", "term"), "term_key").groupBy(
        "asset", "column_name").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    stats = profiles.select("asset", "column_name", "null_rate", "distinct_count", "uniqueness")
    return columns.join(named, ["asset", "column_name"], "left").join(stats, ["asset", "column_name"], "left")


def summary(**tables: DataFrame) -> DataFrame:
    """(item, rows) for each metadata table."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("item"), "rows") for n, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
