"""Cases over shared context rows that they may replace, judged without a copy of the context per case.

A case sees its own rows, and those shared rows whose key it does not bring itself. Failing shared rows are counted once, for all
cases; each case then has a difference:

- its own rows, against the shared rows they refer to;
- less the failing shared rows that it replaces;
- and, where it brings or replaces rows that others refer to, the rows with these keys judged anew, less what they
  counted for before. Only the keys that a case touches are judged anew, as distinct combinations with counts.

The work follows the rows of the cases and the keys they touch, not cases times context. Rules on assets that no case shares with the
context are judged as among cases without it.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.evaluation import NEGATIVE, POSITIVE, outcome
from plumbline.operators.quality import _combos, _failing_fused, _plan_fused, _union, cutoff_sql, failing_by_case
from plumbline.operators.rules import Context, Rule, RuleError, row_check, set_check
from plumbline.session import checkpoint

_REFERRED = re.compile(r"\{ref:(\w+)\}\s+(?:AS\s+)?(\w+)", re.IGNORECASE)


def reference(rule: Rule) -> tuple[str, tuple[str, ...], tuple[str, ...]]:
    """The asset a set rule looks into, the rule's own columns that name a row's partners there, and their columns."""
    p = rule.params
    if rule.type == "unique":
        return rule.asset, rule.columns, rule.columns
    if rule.type == "relationship":
        return p["to_asset"], (p["column"],), (p["to_column"],)
    if p.get("join"):
        return p.get("reference_asset") or p["child_asset"], tuple(p["join"]), tuple(p["join"].values())
    found = _REFERRED.findall(str(p.get("invalid_when", "")))
    if len(found) == 1:
        asset, alias = found[0]
        pairs = [(own, other) for other, own in re.findall(rf"\b{alias}\.(\w+)\s*=\s*p\.(\w+)", p["invalid_when"])]
        pairs += re.findall(rf"\bp\.(\w+)\s*=\s*{alias}\.(\w+)", p["invalid_when"])
        if pairs:
            return asset, *(tuple(x) for x in zip(*pairs, strict=True))
    raise RuleError(f"{rule.key}: no equality tells which rows of another asset it looks at")


class _Overlay:
    """Own rows, shared rows and replaced shared rows of every asset."""

    def __init__(self, own: Mapping[str, DataFrame], shared: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]], case: str) -> None:
        self.case = case
        self.own, self.shared = dict(own), dict(shared)
        for name, df in shared.items():
            self.own.setdefault(name, df.limit(0).withColumn(case, F.lit(None).cast("string")))
        for name, df in own.items():
            self.shared.setdefault(name, df.drop(case).limit(0))
        self.keys = keys
        self._replaced: dict[str, DataFrame] = {}
        self._touched: dict[tuple, DataFrame] = {}

    def brought(self, asset: str) -> DataFrame:
        """The keys of the rows that each case brings."""
        return self.own[asset].select(self.case, *self.keys[asset]).dropna().distinct()

    def replaced(self, asset: str) -> DataFrame:
        """Shared rows, once for each case that brings their key."""
        if asset not in self._replaced:
            shared = self.shared[asset]
            rows = shared.join(self.brought(asset), list(self.keys[asset])) if asset in self.keys else shared.limit(0).withColumn(
                self.case, F.lit(None).cast("string"))
            self._replaced[asset] = checkpoint(rows.select(self.case, *shared.columns))
        return self._replaced[asset]

    def touched(self, asset: str, theirs: Sequence[str], ours: Sequence[str]) -> DataFrame:
        """(case, keys under our names) where a case brings or replaces rows of the asset."""
        name = (asset, tuple(theirs), tuple(ours))
        if name not in self._touched:
            renamed = [F.col(t).alias(o) for t, o in zip(theirs, ours, strict=True)]
            rows = self.own[asset].select(self.case, *renamed).unionByName(self.replaced(asset).select(self.case, *renamed))
            self._touched[name] = checkpoint(rows.dropna().distinct())
        return self._touched[name]

    def effective(self, asset: str, columns: Sequence[str], touched: DataFrame) -> DataFrame:
        """The rows that each case sees at its touched keys."""
        case = self.case
        mine = self.own[asset].join(touched, [case, *columns], "left_semi")
        seen = self.shared[asset].join(touched, list(columns))
        if asset in self.keys:
            brought = self.brought(asset)
            seen = seen.join(brought.toDF(*brought.columns), [case, *self.keys[asset]], "left_anti")
        return mine.unionByName(seen.select(*mine.columns))


def _signed(rows: DataFrame, case: str, rule: Rule, sign: int) -> DataFrame:
    return rows.groupBy(case).agg((sign * F.sum("n")).alias("failed")).withColumn("rule_key", F.lit(rule.key))


def _set_differences(rule: Rule, o: _Overlay, cutoff: str) -> tuple[DataFrame, list[DataFrame]]:
    """Failing shared rows of a set rule, and the parts of each case's difference."""
    case, check = o.case, set_check(rule)
    asset, ours, theirs = reference(rule)
    plain = Context(o.shared, cutoff)
    shared = _combos(rule, plain, [], None)
    failing = checkpoint(check.failing(rule, plain, shared, False))
    total = failing.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("failed")).withColumn("rule_key", F.lit(rule.key))

    own = _combos(rule, plain, [case], None, o.own[rule.asset])
    gone = _combos(rule, plain, [case], None, o.replaced(rule.asset))
    touched = o.touched(asset, theirs, ours)
    at = [case, *ours]

    def against_shared(rows: DataFrame) -> DataFrame:
        return check.failing(rule, plain, rows.join(touched, at, "left_anti"), False)

    parts = [_signed(against_shared(own), case, rule, 1), _signed(against_shared(gone), case, rule, -1),
             _signed(failing.join(touched, list(ours)), case, rule, -1)]
    columns = own.columns
    anew = own.join(touched, at, "left_semi").select(*columns).unionByName(
        shared.join(touched, list(ours)).select(*columns)).unionByName(
        gone.join(touched, at, "left_semi").select(*[(-F.col("n")).alias("n") if c == "n" else c for c in columns]))
    rest = [c for c in columns if c != "n"]
    anew = checkpoint(anew.groupBy(*rest).agg(F.sum("n").alias("n")).filter("n > 0"))
    seen = o.touched(asset, theirs, theirs)
    tables = {**o.own, asset: o.effective(asset, theirs, seen)} if rule.type != "unique" else o.own
    parts.append(_signed(check.failing(rule, Context(tables, cutoff, (case,)), anew, False), case, rule, 1))
    return total, parts


def failing_with_context(own: Mapping[str, DataFrame], shared: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]],
                         rules: Sequence[Rule], as_of: datetime | str, case: str = "case_id") -> tuple[DataFrame, DataFrame]:
    """``(shared_counts, differences)``: (rule_key, failed) of the context, and (case_id, rule_key, failed) per case.

    ``own`` tables have a case column, ``shared`` ones have not; both may have any asset. ``keys`` name the rows of an asset
    that a case can replace. A case fails a rule if the two add up to more than 0.
    """
    o = _Overlay(own, shared, keys, case)
    cutoff = cutoff_sql(as_of)
    totals, parts = [], []
    for asset in dict.fromkeys(r.asset for r in rules):
        fused = [r for r in rules if r.asset == asset and row_check(r) is not None]
        if fused:
            totals.append(_plan_fused(asset, fused, Context(o.shared, cutoff), [], None).select("rule_key", "failed"))
            parts.append(_failing_fused(asset, fused, Context(o.own, cutoff), [case]))
            if asset in keys:
                gone = _failing_fused(asset, fused, Context({asset: o.replaced(asset)}, cutoff), [case])
                parts.append(gone.select(case, "rule_key", (-F.col("failed")).alias("failed")))
    alone = []
    for rule in rules:
        if row_check(rule) is None:
            seen = reference(rule)[0]
            if rule.asset not in shared and (seen in own) != (seen in shared):
                alone.append(rule)
                continue
            total, differences = _set_differences(rule, o, cutoff)
            totals.append(total.select("rule_key", "failed"))
            parts += [d.select(case, "rule_key", "failed") for d in differences]
    if alone:
        # Neither the rows nor their partners are both of the case and shared: nothing is replaced, nothing fails for all cases.
        found = failing_by_case({**shared, **own}, alone, as_of, case)
        totals.append(found.sparkSession.createDataFrame([(r.key, 0) for r in alone], "rule_key string, failed bigint"))
        parts.append(found)
    differences = _union(parts).filter(F.col(case).isNotNull() & (F.col("failed") != 0)).groupBy(case, "rule_key").agg(F.sum("failed").alias("failed"))
    return _union(totals).groupBy("rule_key").agg(F.max("failed").alias("failed")), differences


def predict_with_context(own: Mapping[str, DataFrame], shared: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]],
                         rules: Sequence[Rule], labels: DataFrame, as_of: datetime | str) -> DataFrame:
    """(case_id, expected, predicted, outcome, triggered_rules, defect_category) as if each case were loaded with its context alone."""
    totals, differences = failing_with_context(own, shared, keys, rules, as_of)
    # One number per failing rule; every case starts from them.
    base = [(r.rule_key, r.failed) for r in totals.filter("failed > 0").collect()]
    counts = differences
    if base:
        every = F.array(*[F.struct(F.lit(k).alias("rule_key"), F.lit(n).cast("bigint").alias("failed")) for k, n in base])
        counts = differences.unionByName(labels.select("case_id", F.explode(every).alias("b")).select("case_id", "b.rule_key", "b.failed"))
    triggered = counts.groupBy("case_id", "rule_key").agg(F.sum("failed").alias("failed")).filter("failed > 0").groupBy("case_id").agg(
        F.array_sort(F.collect_set("rule_key")).alias("triggered_rules"))
    fired: Column = F.coalesce("triggered_rules", F.array().cast("array<string>"))
    predicted = F.when(F.size(fired) > 0, POSITIVE).otherwise(NEGATIVE)
    return labels.join(triggered, "case_id", "left").select(
        "case_id", "expected", predicted.alias("predicted"), outcome(F.col("expected"), predicted).alias("outcome"),
        fired.alias("triggered_rules"), "defect_category")
