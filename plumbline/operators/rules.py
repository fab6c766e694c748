"""Declarative quality rules and the registry of rule types.

A rule type says which rows of the rule's asset are bad. Row types are a Boolean ``Column`` and are fused
into one aggregate per asset. Set types look at other rows or other assets; they first collapse the
asset to the distinct combinations of the columns they need (with multiplicity), so that a key holding
a large share of all rows is combined on the map side before any join.

In free-form predicates ``p`` is the rule's asset, ``r`` the joined asset and ``c`` the child asset.
``{reference_ts}`` is the cutoff and ``{ref:<asset>}`` another asset.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import all_of, any_of

# Severities in rising order with their weights, and the issue categories.
SEVERITY_WEIGHT = {"low": 1, "medium": 2, "high": 3, "critical": 4}
SEVERITIES = ("critical", "high", "medium", "low")
CATEGORIES = (
    "missing_identifier", "duplicate_identifier", "broken_relationship", "invalid_date", "chronology",
    "invalid_category", "inconsistent_status", "invalid_numeric", "reconciliation", "financial_consistency",
    "business_rule",
)
# What a defect of a category means to the people who use the data.
CATEGORY_IMPACT = {
    "missing_identifier": "Rows cannot be tied to anything and drop out of every join.",
    "duplicate_identifier": "Repeated rows count twice in totals, rates and customer numbers.",
    "broken_relationship": "Rows point to something unknown, so breakdowns lose them.",
    "invalid_date": "Rows fall into the wrong period or into none.",
    "chronology": "Events follow each other in an impossible order, so durations turn negative.",
    "invalid_category": "Rows end up in no known group, and filters miss them.",
    "inconsistent_status": "Two facts about the same row contradict each other.",
    "invalid_numeric": "Amounts or quantities cannot be right and distort sums and averages.",
    "reconciliation": "Parts and totals disagree, so reports differ by the level they are read at.",
    "financial_consistency": "Money in two places differs, which puts the close of a period at risk.",
    "business_rule": "Rows break a rule that the business agreed on.",
}


class RuleError(ValueError):
    """A rule that cannot be planned: bad parameters or an unknown asset."""


@dataclass(frozen=True)
class Rule:
    key: str
    category: str
    type: str
    asset: str
    severity: str
    columns: tuple[str, ...] = ()
    params: Mapping[str, Any] = field(default_factory=dict)
    where: str | None = None
    rulesets: tuple[str, ...] = ("baseline", "improved")
    supersedes: str | None = None
    rationale: str | None = None
    title: str | None = None
    impact: str | None = None

    @property
    def name(self) -> str:
        return self.title or self.key.replace("_", " ").capitalize()

    @property
    def business_impact(self) -> str:
        return self.impact or CATEGORY_IMPACT.get(self.category, "")

    def with_columns(self) -> Rule:
        """Fill ``columns`` from the parameters when a rule does not list them."""
        if self.columns:
            return self
        named = [self.params[k] for k in ("column", "later_column", "earlier_column")
                 if k in self.params and not (k == "earlier_column" and self.params.get("reference_asset"))]
        return replace(self, columns=tuple(named))

    def assets(self) -> set[str]:
        """Every asset the rule reads."""
        found = {self.asset}
        found |= {self.params[k] for k in ("to_asset", "reference_asset", "child_asset") if self.params.get(k)}
        for text in (self.where, self.params.get("invalid_when")):
            found |= set(re.findall(r"\{ref:(\w+)\}", text or ""))
        return found

    @property
    def uses_cutoff(self) -> bool:
        """Whether the verdict on a row depends on the cutoff (beyond the load filter)."""
        if self.type == "not_future" or self.params.get("max_reference"):
            return True
        return any("{reference_ts}" in str(t) for t in (self.where, *self.params.values()))


@dataclass(frozen=True)
class Context:
    """What a rule type needs to know besides its own parameters."""

    tables: Mapping[str, DataFrame]
    cutoff: str  # SQL text: a timestamp literal or a column name
    tenants: tuple[str, ...] = ()

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise RuleError(f"unknown asset '{name}'")
        return self.tables[name]

    def shared_tenants(self, df: DataFrame) -> list[str]:
        return [t for t in self.tenants if t in df.columns]

    def predicate(self, text: str) -> Column:
        return F.expr(text.replace("{reference_ts}", self.cutoff))

    @property
    def cutoff_column(self) -> Column:
        return F.expr(self.cutoff)


def mentioned(df: DataFrame, *texts: str | None) -> list[str]:
    """Columns of ``df`` that appear as a whole word in any text."""
    words = {w for text in texts if text for w in re.findall(r"\w+", text)}
    return [c for c in df.columns if c in words]


def _equal(pairs: Iterable[tuple[str, str]], left: str, right: str) -> Column:
    return all_of(F.col(f"{left}.`{a}`") == F.col(f"{right}.`{b}`") for a, b in pairs)


# --------------------------------------------------------------------------- row types

RowCheck = Callable[[Rule, Context], Column]


def _not_null(rule: Rule, ctx: Context) -> Column:
    if not rule.columns:
        raise RuleError(f"{rule.key}: not_null needs columns")
    return any_of(F.col(f"p.`{c}`").isNull() for c in rule.columns)


def _accepted_values(rule: Rule, ctx: Context) -> Column:
    return ~F.col(f"p.`{rule.params['column']}`").isin(*rule.params["values"])


def _literal(value: Any) -> Column:
    return F.lit(Decimal(str(value))) if isinstance(value, float) else F.lit(value)


def _range(rule: Rule, ctx: Context) -> Column:
    p = rule.params
    column = F.col(f"p.`{p['column']}`")

    def bound(value: Any) -> Column:
        # A text bound takes the column's type, so that dates compare as dates.
        if isinstance(value, str):
            kind = ctx.table(rule.asset).schema[p["column"]].dataType
            return F.lit(value).cast(kind)
        return _literal(value)

    broken = []
    if p.get("min") is not None:
        low = bound(p["min"])
        broken.append(column <= low if p.get("min_exclusive") else column < low)
    if p.get("max") is not None:
        high = bound(p["max"])
        broken.append(column >= high if p.get("max_exclusive") else column > high)
    if p.get("max_reference"):
        broken.append(column > ctx.cutoff_column)
    if not broken:
        raise RuleError(f"{rule.key}: range needs min, max or max_reference")
    return any_of(broken)


def passes_from(rule: Rule, ctx: Context) -> tuple[Column, Column | None] | None:
    """``(time, always)`` of a row rule whose verdict changes once as the cutoff moves on, else None.

    A row fails until the cutoff reaches ``time`` (never, if it is NULL), and at any cutoff where ``always`` is true.
    """
    p = rule.params
    if "{reference_ts}" in str(rule.where):
        return None
    if rule.type == "not_future":
        return F.col(f"p.`{p['column']}`").cast("timestamp_ntz") - _minutes(int(p.get("tolerance_minutes", 0))), None
    if rule.type == "range" and p.get("max_reference"):
        fixed = {k: v for k, v in p.items() if k != "max_reference"}
        bounded = any(fixed.get(k) is not None for k in ("min", "max"))
        return F.col(f"p.`{p['column']}`").cast("timestamp_ntz"), _range(replace(rule, params=fixed), ctx) if bounded else None
    return None


def _minutes(value: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(value))


def _not_future(rule: Rule, ctx: Context) -> Column:
    tolerance = int(rule.params.get("tolerance_minutes", 0))
    return F.col(f"p.`{rule.params['column']}`") > ctx.cutoff_column + _minutes(tolerance)


def _too_early(later: Column, earlier: Column, tolerance: int) -> Column:
    if not tolerance:
        return later < earlier
    return later.cast("timestamp_ntz") < earlier.cast("timestamp_ntz") - _minutes(tolerance)


def _chronology_row(rule: Rule, ctx: Context) -> Column:
    p = rule.params
    return _too_early(F.col(f"p.`{p['later_column']}`"), F.col(f"p.`{p['earlier_column']}`"),
                      int(p.get("tolerance_minutes", 0)))


def _row_condition(rule: Rule, ctx: Context) -> Column:
    return ctx.predicate(rule.params["invalid_when"])


# --------------------------------------------------------------------------- set types

@dataclass(frozen=True)
class SetCheck:
    """``needs`` lists the asset's columns; ``failing`` keeps the failing combinations of them.

    ``failing`` gets one row per combination with its count ``n`` and may add context columns when
    ``context`` is true.
    """

    needs: Callable[[Rule, Context, DataFrame], list[str]]
    failing: Callable[[Rule, Context, DataFrame, bool], DataFrame]


def _unique_needs(rule: Rule, ctx: Context, primary: DataFrame) -> list[str]:
    if not rule.columns:
        raise RuleError(f"{rule.key}: unique needs columns")
    return list(rule.columns)


def _unique(rule: Rule, ctx: Context, combos: DataFrame, context: bool) -> DataFrame:
    complete = combos.filter(all_of(F.col(c).isNotNull() for c in rule.columns)).filter("n > 1")
    return complete.withColumn("duplicate_count", F.col("n")) if context else complete


def _relationship(rule: Rule, ctx: Context, combos: DataFrame, context: bool) -> DataFrame:
    p = rule.params
    parent = ctx.table(p["to_asset"])
    tenants = ctx.shared_tenants(parent)
    known = parent.select(*tenants, F.col(p["to_column"]).alias("_known")).filter("_known IS NOT NULL").distinct()
    orphan = combos.alias("p").filter(F.col(f"p.`{p['column']}`").isNotNull())
    on = _equal([(p["column"], "_known"), *[(t, t) for t in tenants]], "p", "k")
    return orphan.join(known.alias("k"), on, "left_anti")


def _join_columns(rule: Rule) -> list[tuple[str, str]]:
    if not rule.params.get("join"):
        raise RuleError(f"{rule.key}: needs a join")
    return list(rule.params["join"].items())


def _keyed(combos: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """NULL keys never match: drop them before the shuffle."""
    return combos.filter(all_of(F.col(a).isNotNull() for a, _ in pairs))


def _chronology_needs(rule: Rule, ctx: Context, primary: DataFrame) -> list[str]:
    return list(dict.fromkeys([*[a for a, _ in _join_columns(rule)], rule.params["later_column"]]))


def _chronology(rule: Rule, ctx: Context, combos: DataFrame, context: bool) -> DataFrame:
    # A row is too early for some reference row exactly when it is too early for the latest one.
    p, pairs = rule.params, _join_columns(rule)
    reference = ctx.table(p["reference_asset"])
    tenants = ctx.shared_tenants(reference)
    shown = f"reference_{p['earlier_column']}"
    keys = [F.col(b).alias(f"_k{i}") for i, (_, b) in enumerate(pairs)]
    latest = reference.groupBy(*tenants, *keys).agg(F.max(p["earlier_column"]).alias(shown))
    on = _equal([*[(a, f"_k{i}") for i, (a, _) in enumerate(pairs)], *[(t, t) for t in tenants]], "p", "r")
    joined = _keyed(combos, pairs).alias("p").join(latest.alias("r"), on)
    bad = joined.filter(_too_early(F.col(f"p.`{p['later_column']}`"), F.col(f"r.{shown}"),
                                   int(p.get("tolerance_minutes", 0))))
    return bad.select("p.*", *([f"r.{shown}"] if context else []))


#: How a row of the asset may differ from a row it joins: text of the condition, and the same against the smallest (``lo``) and
#: largest (``hi``) value of all its partners and whether one of them is NULL (``hole``). ``t`` is the tolerance.
COMPARISONS = {
    "above": ("{own} > r.{theirs} + {t}", "{own} > {a}lo + {t}"),
    "below": ("{own} < r.{theirs} - {t}", "{own} < {a}hi - {t}"),
    "different": ("{own} <> r.{theirs}", "{own} <> {a}lo OR {own} <> {a}hi"),
    "distinct": ("{own} IS DISTINCT FROM r.{theirs}",
                 "CASE WHEN {own} IS NULL THEN {a}lo IS NOT NULL ELSE {a}hole OR {own} <> {a}lo OR {own} <> {a}hi END"),
}


def _comparison(rule: Rule, of_stats: bool, stats: str = "a.") -> str:
    own, kind, theirs, *tolerance = rule.params["compare"]
    if kind not in COMPARISONS:
        raise RuleError(f"{rule.key}: unknown comparison '{kind}'")
    # Doubles would round the bound of a decimal column.
    return COMPARISONS[kind][of_stats].format(own=f"p.{own}", theirs=theirs, a=stats, t=f"CAST({tolerance[0] if tolerance else 0} AS DECIMAL(20,10))")


def _join_predicate(rule: Rule) -> str:
    return _comparison(rule, False) if "compare" in rule.params else rule.params["invalid_when"]


def _join_condition_needs(rule: Rule, ctx: Context, primary: DataFrame) -> list[str]:
    keys = [a for a, _ in _join_columns(rule)]
    return list(dict.fromkeys([*keys, *mentioned(primary, _join_predicate(rule))]))


def _extremes(theirs: Column, mark: str) -> dict[str, Column]:
    return {f"{mark}lo": F.min(theirs), f"{mark}hi": F.max(theirs), f"{mark}hole": F.bool_or(theirs.isNull())}


def _named(columns: Mapping[str, Column]) -> list[Column]:
    return [column.alias(name) for name, column in columns.items()]


def _beside_stats(rule: Rule, ctx: Context, combos: DataFrame) -> DataFrame:
    """Combinations for which some partner makes a comparison true, from the extremes of each key: no pairs within a key."""
    pairs, theirs = _join_columns(rule), F.col(f"`{rule.params['compare'][2]}`")
    partners = ctx.table(rule.params["reference_asset"])
    tenants = ctx.shared_tenants(partners)
    partners = _keyed(partners, [(b, b) for _, b in pairs])
    stats = partners.groupBy(*tenants, *[F.col(f"`{b}`").alias(f"_k{i}") for i, (_, b) in enumerate(pairs)]).agg(*_named(_extremes(theirs, "")))
    on = _equal([*[(a, f"_k{i}") for i, (a, _) in enumerate(pairs)], *[(t, t) for t in tenants]], "p", "a")
    return _keyed(combos, pairs).alias("p").join(stats.alias("a"), on).filter(ctx.predicate(_comparison(rule, True))).select("p.*")


def _join_condition(rule: Rule, ctx: Context, combos: DataFrame, context: bool) -> DataFrame:
    """A comparison is decided by the extremes of each key; a free condition meets the distinct partners of its key."""
    p, pairs = rule.params, _join_columns(rule)
    if "compare" in p:
        combos = _beside_stats(rule, ctx, combos)
        if not context:
            return combos
    reference = ctx.table(p["reference_asset"])
    tenants = ctx.shared_tenants(reference)
    predicate = _join_predicate(rule)
    shown = list(p.get("context_columns") or [b for _, b in pairs]) if context else []
    used = list(dict.fromkeys([*tenants, *[b for _, b in pairs], *mentioned(reference, predicate), *shown]))
    side = _keyed(reference.select(*used), [(b, b) for _, b in pairs]).distinct().alias("r")
    on = _equal([*pairs, *[(t, t) for t in tenants]], "p", "r") & ctx.predicate(predicate)
    left = _keyed(combos, pairs).alias("p")
    if not context:
        return left.join(side, on, "left_semi")
    # One matching reference row per failing combination, the smallest one; aggregated where it is joined.
    hit = F.struct(*[F.col(f"r.`{c}`").alias(f"reference_{c}") for c in shown])
    joined = left.join(side, on).select("p.*", hit.alias("_hit"))
    picked = joined.groupBy(*combos.columns).agg(F.min("_hit").alias("_hit"))
    return picked.select(*combos.columns, "_hit.*")


def _aggregate_needs(rule: Rule, ctx: Context, primary: DataFrame) -> list[str]:
    keys = [a for a, _ in _join_columns(rule)]
    return list(dict.fromkeys([*keys, *mentioned(primary, rule.params["primary_expression"])]))


def _aggregate(rule: Rule, ctx: Context, combos: DataFrame, context: bool) -> DataFrame:
    p, pairs = rule.params, _join_columns(rule)
    child = ctx.table(p["child_asset"]).alias("c")
    tenants = ctx.shared_tenants(child)
    if p.get("child_where"):
        child = child.filter(ctx.predicate(p["child_where"]))
    keys = [F.col(f"c.`{b}`").alias(f"_k{i}") for i, (_, b) in enumerate(pairs)]
    totals = child.groupBy(*[F.col(f"c.`{t}`").alias(t) for t in tenants], *keys).agg(
        ctx.predicate(p["child_aggregate"]).alias("reconciled_value"))
    on = _equal([*[(a, f"_k{i}") for i, (a, _) in enumerate(pairs)], *[(t, t) for t in tenants]], "p", "a")
    joined = _keyed(combos, pairs).alias("p").join(totals.alias("a"), on)
    bad = _off(rule, ctx, F.col("a.reconciled_value"))
    return joined.filter(bad).select("p.*", *(["a.reconciled_value"] if context else []))


def _off(rule: Rule, ctx: Context, total: Column) -> Column:
    own, tolerance = ctx.predicate(rule.params["primary_expression"]), _literal(float(rule.params.get("tolerance", 0.01)))
    if rule.params.get("comparison", "equal") == "equal":
        return F.abs(own - total) > tolerance
    return total > own + tolerance


@dataclass(frozen=True)
class Lookup:
    """A set rule that is decided by the statistics of the partners of a key: one row per key of the other asset.

    ``bad`` is not true for a key without partners, unless that is what the rule looks for.
    """

    pairs: tuple[tuple[str, str], ...]
    asset: str
    where: str | None
    stats: dict[str, Column]
    bad: Column


def lookup(rule: Rule, ctx: Context, mark: str, other: str = "c") -> Lookup | None:
    """The rule as a lookup whose statistics are named with ``mark``; None if it needs its partners one by one.

    ``other`` is the name under which the statistics find the rows of the other asset.
    """
    p = rule.params
    if rule.type == "relationship":
        return Lookup(((p["column"], p["to_column"]),), p["to_asset"], None, {f"{mark}known": F.count(F.lit(1))},
                      F.col(f"{mark}known").isNull())
    if rule.type == "chronology" and p.get("reference_asset"):
        bad = _too_early(F.col(f"p.`{p['later_column']}`"), F.col(f"{mark}time"), int(p.get("tolerance_minutes", 0)))
        return Lookup(tuple(_join_columns(rule)), p["reference_asset"], None, {f"{mark}time": F.max(f"{other}.`{p['earlier_column']}`")}, bad)
    if rule.type == "join_condition" and "compare" in p:
        return Lookup(tuple(_join_columns(rule)), p["reference_asset"], None, _extremes(F.col(f"{other}.`{p['compare'][2]}`"), mark),
                      ctx.predicate(_comparison(rule, True, mark)))
    if rule.type == "aggregate_reconciliation":
        return Lookup(tuple(_join_columns(rule)), p["child_asset"], p.get("child_where"),
                      {f"{mark}total": ctx.predicate(re.sub(r"\bc\.", f"{other}.", p["child_aggregate"]))}, _off(rule, ctx, F.col(f"{mark}total")))
    return None


def beside(rows: DataFrame, lookups: list[Lookup], ctx: Context) -> DataFrame:
    """``rows`` (alias ``p``) with the statistics of all ``lookups``, which share their own key columns.

    Lookups into the same rows of an asset share one aggregate. Rows with a NULL in the key have no partners and are left out.
    """
    sources: dict[tuple, dict[str, Column]] = {}
    for found in lookups:
        sources.setdefault((found.asset, found.where, found.pairs), {}).update(found.stats)
    joined = _keyed(rows, list(lookups[0].pairs)).alias("p")
    for i, ((asset, where, pairs), stats) in enumerate(sources.items()):
        other = ctx.table(asset).alias("c")
        tenants = ctx.shared_tenants(other)
        other = other.filter(all_of([F.col(f"c.`{b}`").isNotNull() for _, b in pairs] + ([ctx.predicate(where)] if where else [])))
        keys = [F.col(f"c.`{b}`").alias(f"_k{k}") for k, (_, b) in enumerate(pairs)]
        side = other.groupBy(*[F.col(f"c.`{t}`").alias(t) for t in tenants], *keys).agg(*_named(stats))
        on = _equal([*[(a, f"_k{k}") for k, (a, _) in enumerate(pairs)], *[(t, t) for t in tenants]], "p", f"a{i}")
        joined = joined.join(side.alias(f"a{i}"), on, "left")
    return joined


_REF = re.compile(r"\{ref:(\w+)\}")


def _subquery_needs(rule: Rule, ctx: Context, primary: DataFrame) -> list[str]:
    return mentioned(primary, rule.params["invalid_when"])


def _subquery(rule: Rule, ctx: Context, combos: DataFrame, context: bool) -> DataFrame:
    """A row condition that looks into another asset (EXISTS and the like)."""
    views: dict[str, DataFrame] = {"_primary": combos}

    def relation(match: re.Match[str]) -> str:
        name = match[1]
        views[name] = ctx.table(name)
        tenants = ctx.shared_tenants(views[name])
        if not tenants:
            return "{" + name + "}"
        own = " AND ".join(f"_t.`{t}` = p.`{t}`" for t in tenants)
        return f"(SELECT _t.* FROM {{{name}}} _t WHERE {own})"

    text = _REF.sub(relation, rule.params["invalid_when"].replace("{reference_ts}", ctx.cutoff))
    return combos.sparkSession.sql(f"SELECT p.* FROM {{_primary}} p WHERE {text}", **views)


def row_check(rule: Rule) -> RowCheck | None:
    """The fusable form of a rule, or None when it is a set rule."""
    if rule.type == "chronology" and not rule.params.get("reference_asset"):
        return _chronology_row
    if rule.type == "row_condition" and not _REF.search(rule.params["invalid_when"]):
        return _row_condition
    return ROW_CHECKS.get(rule.type)


def set_check(rule: Rule) -> SetCheck | None:
    if rule.type == "row_condition":
        return SetCheck(_subquery_needs, _subquery)
    return SET_CHECKS.get(rule.type)


# The two registries are the extension point: add a function under a new type name.
ROW_CHECKS: dict[str, RowCheck] = {
    "not_null": _not_null,
    "accepted_values": _accepted_values,
    "range": _range,
    "not_future": _not_future,
}
SET_CHECKS: dict[str, SetCheck] = {
    "unique": SetCheck(_unique_needs, _unique),
    "relationship": SetCheck(lambda rule, ctx, primary: [rule.params["column"]], _relationship),
    "chronology": SetCheck(_chronology_needs, _chronology),
    "join_condition": SetCheck(_join_condition_needs, _join_condition),
    "aggregate_reconciliation": SetCheck(_aggregate_needs, _aggregate),
}
RULE_TYPES = ("not_null", "unique", "relationship", "accepted_values", "range", "not_future", "chronology",
              "row_condition", "join_condition", "aggregate_reconciliation")


def select_ruleset(rules: Iterable[Rule], ruleset: str | None) -> list[Rule]:
    return [r for r in rules if ruleset is None or ruleset in r.rulesets]


def problems(rules: list[Rule], columns_by_asset: Mapping[str, set[str]]) -> list[str]:
    """References that do not resolve: assets, columns, categories, types, duplicate or dangling keys."""
    found: list[str] = []
    keys = [r.key for r in rules]
    found += [f"duplicate rule key '{k}'" for k in sorted({k for k in keys if keys.count(k) > 1})]
    for r in rules:
        if r.type not in RULE_TYPES and r.type not in ROW_CHECKS and r.type not in SET_CHECKS:
            found.append(f"{r.key}: unknown type '{r.type}'")
        if r.category not in CATEGORIES:
            found.append(f"{r.key}: unknown category '{r.category}'")
        if r.severity not in SEVERITY_WEIGHT:
            found.append(f"{r.key}: unknown severity '{r.severity}'")
        if r.supersedes and r.supersedes not in keys:
            found.append(f"{r.key}: supersedes unknown rule '{r.supersedes}'")
        found += [f"{r.key}: unknown asset '{a}'" for a in sorted(r.assets() - set(columns_by_asset))]
        known = columns_by_asset.get(r.asset)
        if known:
            found += [f"{r.key}: unknown column '{r.asset}.{c}'" for c in r.columns if c not in known]
    return found


def rules_frame(spark, rules: Iterable[Rule]) -> DataFrame:
    """The rules as a small DataFrame, for joins with results."""
    rows = [(r.key, r.name, r.category, r.type, r.asset, r.severity, SEVERITY_WEIGHT[r.severity], list(r.columns),
             list(r.rulesets), r.supersedes, r.rationale, r.business_impact) for r in rules]
    return spark.createDataFrame(
        rows, "rule_key string, rule_name string, category string, rule_type string, asset string, severity string, "
              "severity_weight int, columns array<string>, rulesets array<string>, supersedes string, "
              "rationale string, business_impact string")
