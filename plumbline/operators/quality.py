"""Run rules: fused counts, failing rows, samples, as-of runs, back-fill and per-case runs."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date, datetime, time, timedelta
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.joins import count_rows
from plumbline.functions.scalars import all_of
from plumbline.operators.rules import Context, Rule, RuleError, beside, lookup, mentioned, passes_from, row_check, set_check
from plumbline.session import checkpoint

LOAD_COLUMN = "loaded_at"
_RUN = "_run_day"
COUNT_SCHEMA = "rule_key string, scanned bigint, failed bigint, error string"


def cutoff_sql(as_of: datetime | str) -> str:
    return f"TIMESTAMP_NTZ '{as_of}'"


def _scope(rule: Rule, ctx: Context, df: DataFrame, load_column: str | None) -> Column | None:
    """Rows in scope of the rule; the load filter applies to the rule's own asset only."""
    conditions = [ctx.predicate(rule.where)] if rule.where else []
    if load_column and load_column in df.columns:
        conditions.append(F.col(f"p.`{load_column}`") <= ctx.cutoff_column)
    return all_of(conditions)


def _in_scope(rule: Rule, ctx: Context, df: DataFrame, load_column: str | None) -> DataFrame:
    scope = _scope(rule, ctx, df, load_column)
    return df if scope is None else df.filter(scope)


def _plan_fused(asset: str, rules: list[Rule], ctx: Context, by: list[str], load_column: str | None,
                primary: DataFrame | None = None) -> DataFrame:
    """One aggregate over the asset: (by..., rule_key, scanned, failed).

    Row rules get both counts. Set rules only need their scanned rows here; their failed count is NULL.
    """
    df = (ctx.table(asset) if primary is None else primary).alias("p")
    counters, lines = [], []
    for i, rule in enumerate(rules):
        scope, check = _scope(rule, ctx, df, load_column), row_check(rule)
        counters.append((F.count(F.lit(1)) if scope is None else F.count_if(scope)).alias(f"_s{i}"))
        failed = F.lit(None).cast("bigint")
        if check is not None:
            bad = check(rule, ctx)
            counters.append(F.count_if(bad if scope is None else scope & bad).alias(f"_f{i}"))
            failed = F.col(f"_f{i}")
        lines.append(F.struct(F.lit(rule.key).alias("rule_key"), F.col(f"_s{i}").alias("scanned"),
                              failed.alias("failed")))
    totals = df.groupBy(*by).agg(*counters)
    return totals.select(*by, F.explode(F.array(*lines)).alias("line")).select(*by, "line.*")


def _combos(rule: Rule, ctx: Context, by: list[str], load_column: str | None,
            primary: DataFrame | None = None) -> DataFrame:
    df = (ctx.table(rule.asset) if primary is None else primary).alias("p")
    needed = set_check(rule).needs(rule, ctx, df)
    scoped = _in_scope(rule, ctx, df, load_column)
    return count_rows(scoped, list(dict.fromkeys([*by, *needed])))


def _plan_set(rule: Rule, ctx: Context, by: list[str], load_column: str | None,
              primary: DataFrame | None = None) -> DataFrame:
    """Failed rows of one set rule: (by..., rule_key, failed)."""
    failing = set_check(rule).failing(rule, ctx, _combos(rule, ctx, by, load_column, primary), False)
    failed = F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("failed")
    return failing.groupBy(*by).agg(failed).withColumn("rule_key", F.lit(rule.key))


def _plan_lookups(rules: list[Rule], ctx: Context, by: list[str], load_column: str | None,
                  primary: DataFrame | None = None) -> DataFrame:
    """Failed rows of rules of one asset that look up the same own columns in the same rows: (by..., rule_key, failed).

    The rows meet the statistics of their key once for all rules. Rules that need the key alone meet it once per distinct key.
    """
    df = (ctx.table(rules[0].asset) if primary is None else primary).alias("p")
    found = [lookup(rule, ctx, f"_{i}_") for i, rule in enumerate(rules)]
    needed = list(dict.fromkeys([*by, *(c for rule in rules for c in set_check(rule).needs(rule, ctx, df))]))
    scoped = _in_scope(rules[0], ctx, df, load_column)
    if set(needed) <= {*by, *(a for a, _ in found[0].pairs)}:
        rows = count_rows(scoped, needed)
    else:
        rows = scoped.select(*needed, F.lit(1).cast("bigint").alias("n"))
    verdicts = [F.when(f.bad, F.col("p.n")).otherwise(0).alias(f"_f{i}") for i, f in enumerate(found)]
    judged = beside(rows, found, ctx).select(*[F.col(f"p.`{b}`") for b in by], *verdicts)
    totals = judged.groupBy(*by).agg(*[F.coalesce(F.sum(f"_f{i}"), F.lit(0)).cast("bigint").alias(f"_f{i}") for i in range(len(rules))])
    lines = [F.struct(F.lit(r.key).alias("rule_key"), F.col(f"_f{i}").alias("failed")) for i, r in enumerate(rules)]
    return totals.select(*by, F.explode(F.array(*lines)).alias("line")).select(*by, "line.*")


def _set_groups(rules: Iterable[Rule], ctx: Context) -> list[list[Rule]]:
    """Set rules of an asset that can be looked up side by side; the others stand alone."""
    groups: dict[tuple, list[Rule]] = {}
    for rule in rules:
        try:
            found = lookup(rule, ctx, "_")
        except _PLAN_ERRORS:  # shows again where the rule is planned
            found = None
        own = (rule.key,) if found is None else (None, rule.where, *sorted(a for a, _ in found.pairs))
        groups.setdefault(own, []).append(rule)
    return list(groups.values())


def _plan_group(rules: list[Rule], ctx: Context, by: list[str], load_column: str | None, primary: DataFrame | None = None) -> DataFrame:
    if lookup(rules[0], ctx, "_") is None:
        return _plan_set(rules[0], ctx, by, load_column, primary)
    return _plan_lookups(rules, ctx, by, load_column, primary)


def _error_text(exc: Exception) -> str:
    return f"{type(exc).__name__}: {exc}".rstrip()


_PLAN_ERRORS = (PySparkException, RuleError, KeyError)


def _plan_rules(asset: str, rules: list[Rule], ctx: Context, by: list[str], load_column: str | None,
                primary: DataFrame | None = None, counted: Sequence[Rule] = ()) -> tuple[list[DataFrame], dict[str, str]]:
    """Plans for all rules of one asset, and the errors of rules that cannot be planned.

    Building a DataFrame analyses it, so a bad rule shows here and not in the job. Of the rules ``counted`` only the scanned rows
    are counted.
    """
    frames, errors, sets = [], {}, []
    for rule in rules:
        if row_check(rule) is None and rule not in counted:
            if set_check(rule) is None:
                errors[rule.key] = _error_text(RuleError(f"unknown rule type '{rule.type}'"))
            else:
                sets.append(rule)
    for group in _set_groups(sets, ctx):
        try:
            frames.append(_plan_group(group, ctx, by, load_column, primary))
        except _PLAN_ERRORS:
            for rule in group:
                try:
                    frames.append(_plan_set(rule, ctx, by, load_column, primary))
                except _PLAN_ERRORS as exc:
                    errors[rule.key] = _error_text(exc)
    fused = [r for r in rules if r.key not in errors]
    try:
        if fused:
            frames.append(_plan_fused(asset, fused, ctx, by, load_column, primary))
    except _PLAN_ERRORS:
        fine = []
        for rule in fused:
            try:
                _plan_fused(asset, [rule], ctx, by, load_column, primary)
                fine.append(rule)
            except _PLAN_ERRORS as exc:
                errors[rule.key] = _error_text(exc)
        if fine:
            frames.append(_plan_fused(asset, fine, ctx, by, load_column, primary))
    return frames, errors


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _by_asset(rules: Iterable[Rule]) -> dict[str, list[Rule]]:
    grouped: dict[str, list[Rule]] = {}
    for rule in rules:
        grouped.setdefault(rule.asset, []).append(rule)
    return grouped


def rule_counts(spark: SparkSession, tables: Mapping[str, DataFrame], rules: Sequence[Rule], as_of: datetime | str,
                filter_by_load_time: bool = False) -> DataFrame:
    """Scanned and failed rows per rule: (rule_key, scanned, failed, error).

    Row rules share one aggregate per asset; each set rule is one plan over collapsed rows. A rule that
    cannot be planned gives an error row and leaves the others alone.
    """
    ctx = Context(tables, cutoff_sql(as_of))
    load = LOAD_COLUMN if filter_by_load_time else None
    frames, errors = [], {}
    for asset, group in _by_asset(rules).items():
        planned, broken = _plan_rules(asset, group, ctx, [], load)
        frames += planned
        errors |= broken
    counts = spark.createDataFrame([(k, 0, 0, e) for k, e in errors.items()], COUNT_SCHEMA) if errors else None
    if frames:
        merged = _union(frames).groupBy("rule_key").agg(
            F.max("scanned").alias("scanned"), F.max("failed").alias("failed"),
            F.lit(None).cast("string").alias("error"))
        counts = merged if counts is None else merged.unionByName(counts)
    return counts if counts is not None else spark.createDataFrame([], COUNT_SCHEMA)


def with_status(counts: DataFrame) -> DataFrame:
    """Add status and failure rate; any failing row fails the rule."""
    rate = F.when(F.col("scanned") > 0, F.col("failed").cast("double") / F.col("scanned")).otherwise(F.lit(0.0))
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("failed") > 0, "fail").otherwise("pass")
    return counts.withColumns({"status": status, "failure_rate": rate})


def _rule_at_fault(exc: Exception) -> bool:
    """Whether a rule's own expression failed (data, cast or analysis errors), not the cluster."""
    return isinstance(exc, (RuleError, KeyError)) or re.search(r"SQLSTATE: (22|42|0A)", str(exc)) is not None


def run_rules(spark: SparkSession, tables: Mapping[str, DataFrame], rules: Sequence[Rule], as_of: datetime | str,
              filter_by_load_time: bool = False) -> DataFrame:
    """Execute now and return the (one row per rule) results, surviving run-time errors of rules.

    When a job fails by a rule's fault, its rules are split by asset and then in halves, until the rules at fault
    stand alone. Other failures are raised.
    """
    def execute(some: Sequence[Rule]) -> list[tuple]:
        try:
            return [tuple(r) for r in rule_counts(spark, tables, some, as_of, filter_by_load_time)
                    .select("rule_key", "scanned", "failed", "error").collect()]
        except Exception as exc:
            if not _rule_at_fault(exc):
                raise
            if len(some) == 1:
                return [(some[0].key, 0, 0, _error_text(exc))]
        groups = list(_by_asset(some).values())
        parts = groups if len(groups) > 1 else [some[:len(some) // 2], some[len(some) // 2:]]
        return [row for part in parts for row in execute(part)]

    return with_status(spark.createDataFrame(execute(rules) if rules else [], COUNT_SCHEMA))


# --------------------------------------------------------------------------- failing rows

def failing_rows(tables: Mapping[str, DataFrame], rule: Rule, as_of: datetime | str,
                 filter_by_load_time: bool = False) -> DataFrame:
    """The failing rows of a rule's asset, with context columns of joined assets."""
    ctx = Context(tables, cutoff_sql(as_of))
    load = LOAD_COLUMN if filter_by_load_time else None
    primary = ctx.table(rule.asset).alias("p")
    scoped = _in_scope(rule, ctx, primary, load)
    check = row_check(rule)
    if check is not None:
        return scoped.filter(check(rule, ctx))
    bad = set_check(rule).failing(rule, ctx, _combos(rule, ctx, [], load), True).drop("n")
    needed = set_check(rule).needs(rule, ctx, primary)
    # The failing combinations are distinct, so joining them back keeps every copy of a row once.
    on = all_of(F.col(f"p.`{c}`").eqNullSafe(F.col(f"bad.`{c}`")) for c in needed)
    context = [f"bad.`{c}`" for c in bad.columns if c not in needed]
    return scoped.join(bad.alias("bad"), on).select("p.*", *context)


def samples(tables: Mapping[str, DataFrame], rule: Rule, as_of: datetime | str, size: int = 5,
            filter_by_load_time: bool = False) -> DataFrame:
    """The first failing rows by the first column (NULLs last), as JSON: (rule_key, row)."""
    rows = failing_rows(tables, rule, as_of, filter_by_load_time)
    order = [F.col(f"`{c}`").asc_nulls_last() for c in rows.columns]
    return rows.orderBy(*order).limit(size).select(
        F.lit(rule.key).alias("rule_key"), F.to_json(F.struct("*")).alias("row"))


def all_samples(tables: Mapping[str, DataFrame], rules: Sequence[Rule], as_of: datetime | str,
                size: int = 5) -> DataFrame:
    return _union([samples(tables, r, as_of, size) for r in rules])


# --------------------------------------------------------------------------- back-fill

def backfill_days(last: date, days: int) -> list[datetime]:
    """End-of-day cutoffs, oldest first."""
    if not 1 <= days <= 90:
        raise ValueError("back-fill days must be between 1 and 90")
    return [datetime.combine(last - timedelta(days=n), time(23, 59, 59)) for n in range(days - 1, -1, -1)]


def _first_run(first: date, load_column: str) -> Column:
    """The day of the first run that sees a row: the first end-of-day cutoff not before its load time."""
    almost_second = F.expr("INTERVAL '0.999999' SECOND")
    return F.greatest((F.col(load_column) + almost_second).cast("date"), F.lit(first))


def _unique_by_day(rule: Rule, ctx: Context, primary: DataFrame, days: Sequence[date]) -> DataFrame:
    """Change in failing rows per run day: a second copy makes all earlier copies fail as well.

    The days (at most 90) are counters of one aggregate per key, so that only keys with copies go on to the window.
    """
    keys = list(rule.columns)
    df = primary.alias("p")
    if rule.where:
        df = df.filter(ctx.predicate(rule.where))
    counts = df.filter(all_of(F.col(c).isNotNull() for c in keys)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(_RUN) == F.lit(d)).alias(f"_d{i}") for i, d in enumerate(days)])
    lines = F.array(*[F.struct(F.lit(d).alias(_RUN), F.col(f"_d{i}").alias("n")) for i, d in enumerate(days)])
    daily = counts.filter("_n > 1").select(*keys, F.explode(lines).alias("_line")).select(*keys, "_line.*").filter("n > 0")
    upto = Window.partitionBy(*keys).orderBy(_RUN)
    # At most one row per key and day (90 days), however many copies a key has.
    seen = daily.withColumn("_after", F.sum("n").over(upto)).withColumn("_before", F.col("_after") - F.col("n"))

    def failing(count: str) -> Column:
        return F.when(F.col(count) > 1, F.col(count)).otherwise(0)

    return seen.groupBy(_RUN).agg(F.sum(failing("_after") - failing("_before")).alias("failed")).withColumn(
        "rule_key", F.lit(rule.key))


def _flips(rules: list[Rule], ctx: Context, seen: DataFrame, first: date, last: date) -> DataFrame:
    """Change in failing rows per rule and run day for rules whose verdict on a row changes once: +1 when a run first sees a
    failing row, -1 when it passes. Other rows give nothing, so a row costs at most two entries however many days there are."""
    changes = []
    for rule in rules:
        time_, always = passes_from(rule, ctx)
        almost_second = F.expr("INTERVAL '0.999999' SECOND")
        day = F.greatest((time_ + almost_second).cast("date"), F.lit(first))
        until = F.when(always, F.lit(last + timedelta(days=1))).otherwise(day) if always is not None else day
        failing = F.col(_RUN) < until
        if rule.where:
            failing = failing & ctx.predicate(rule.where)
        key = F.lit(rule.key).alias("rule_key")
        changes.append(F.when(failing, F.array(F.struct(key, F.col(_RUN).alias("day"), F.lit(1).alias("n")),
                                               F.struct(key, until.alias("day"), F.lit(-1).alias("n")))))
    events = seen.alias("p").select(F.explode(F.flatten(F.array_compact(F.array(*changes)))).alias("e")).select("e.*")
    return events.filter(F.col("day") <= F.lit(last)).groupBy("rule_key", F.col("day").alias(_RUN)).agg(F.sum("n").alias("failed"))


def backfill(spark: SparkSession, tables: Mapping[str, DataFrame], rules: Sequence[Rule], last: date,
             days: int) -> DataFrame:
    """Counts of every rule for each of the last ``days`` daily runs, in one job.

    Rows are counted once, on the first day a run sees them, and the counts are summed up over the days. A row whose verdict
    changes once, as a time in the future does, is counted off on that day. Only rules with a free predicate on the cutoff
    look at a row on each of its days.
    """
    cutoffs = backfill_days(last, days)
    first = cutoffs[0].date()
    fixed = Context(tables, cutoff_sql(cutoffs[-1]))
    moving = Context(tables, "_as_of")
    errors: dict[str, str] = {}
    changes, levels = [], []
    flipping: set[str] = set()
    for asset, group in _by_asset(rules).items():
        if asset not in tables:
            errors |= {r.key: f"unknown asset '{asset}'" for r in group}
            continue
        base = tables[asset]
        if LOAD_COLUMN in base.columns:
            seen = base.withColumn(_RUN, _first_run(first, LOAD_COLUMN)).filter(F.col(_RUN) <= F.lit(last))
        else:
            seen = base.withColumn(_RUN, F.lit(first))
        still = [r for r in group if not r.uses_cutoff]
        # Duplicates change with every later copy; their scanned rows come from the shared aggregate.
        copies = [r for r in still if r.type == "unique"]
        counted = []
        for rule in copies:
            try:
                changes.append(_unique_by_day(rule, fixed, seen, [c.date() for c in cutoffs]))
                counted.append(rule)
            except _PLAN_ERRORS as exc:
                errors[rule.key] = _error_text(exc)
        planned, broken = _plan_rules(asset, [r for r in still if r not in copies] + counted, fixed, [_RUN], None, seen, counted)
        changes += planned
        errors |= broken
        moved, once = [], []
        for rule in (r for r in group if r.uses_cutoff):
            try:
                if passes_from(rule, fixed) is None:
                    moved.append(rule)
                else:
                    # Building the plan analyses the rule.
                    _flips([rule], fixed, seen, first, last)
                    once.append(rule)
            except _PLAN_ERRORS as exc:
                errors[rule.key] = _error_text(exc)
        if once:
            changes += [_plan_fused(asset, once, fixed, [_RUN], None, seen).drop("failed"), _flips(once, fixed, seen, first, last)]
            flipping |= {r.key for r in once}
        if not moved:
            continue
        needed = list(dict.fromkeys(
            c for r in moved for c in [*[c for c in r.columns if c in base.columns],
                                       *mentioned(base, r.where, *map(str, r.params.values()))]))
        daily = seen.select(*needed, F.explode(F.sequence(F.col(_RUN), F.lit(last))).alias("_day")).withColumn(
            "_as_of", F.col("_day").cast("timestamp_ntz") + F.expr("INTERVAL '86399' SECOND")).withColumnRenamed(
            "_day", _RUN)
        planned, broken = _plan_rules(asset, moved, moving, [_RUN, "_as_of"], None, daily)
        levels += [f.drop("_as_of") for f in planned]
        errors |= broken
    good = [r for r in rules if r.key not in errors]
    grid = spark.createDataFrame(
        [(r.key, c.date(), 0, 0) for r in good for c in cutoffs],
        f"rule_key string, {_RUN} date, scanned bigint, failed bigint")

    def per_day(frames: list[DataFrame]) -> DataFrame:
        wanted = [f.select("rule_key", _RUN,
                           *[F.col(c) if c in f.columns else F.lit(0).cast("bigint").alias(c)
                             for c in ("scanned", "failed")]) for f in frames]
        return _union(wanted).groupBy("rule_key", _RUN).agg(
            F.sum("scanned").cast("bigint").alias("scanned"), F.sum("failed").cast("bigint").alias("failed"))

    moved_keys = [r.key for r in good if r.uses_cutoff and r.key not in flipping]
    running = Window.partitionBy("rule_key").orderBy(_RUN)  # at most 90 rows per rule
    parts = []
    if changes:
        summed = per_day([*changes, grid.filter(~F.col("rule_key").isin(moved_keys))])
        parts.append(summed.withColumns({c: F.sum(c).over(running).cast("bigint") for c in ("scanned", "failed")}))
    if levels:
        parts.append(per_day([*levels, grid.filter(F.col("rule_key").isin(moved_keys))]))
    if errors:
        parts.append(spark.createDataFrame(
            [(k, c.date(), 0, 0, e) for k, e in errors.items() for c in cutoffs],
            f"rule_key string, {_RUN} date, scanned bigint, failed bigint, error string"))
    out = _union(parts)
    if "error" not in out.columns:
        out = out.withColumn("error", F.lit(None).cast("string"))
    as_of = F.col(_RUN).cast("timestamp_ntz") + F.expr("INTERVAL '86399' SECOND")
    return with_status(out.select("rule_key", as_of.alias("as_of"), "scanned", "failed", "error"))


def after_repairs(results: DataFrame, repairs: DataFrame) -> DataFrame:
    """Counts of rules whose bad rows were repaired between runs.

    ``results(rule_key, as_of, scanned, failed, error)`` count all rows loaded by then; ``repairs(rule_key, at)`` say when all
    failing rows known to the rule were corrected. A repaired row does not fail again: from then on the rows that failed in
    the last run up to the repair are taken off. Status and failure rate follow the new counts.
    """
    line = results.select("*", F.lit(0).alias("_turn")).unionByName(
        repairs.select("rule_key", F.col("at").alias("as_of"), F.lit(1).alias("_turn")), allowMissingColumns=True)
    past = Window.partitionBy("rule_key").orderBy("as_of", "_turn").rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col("_turn") == 1, F.coalesce(F.last(F.when(F.col("_turn") == 0, F.col("failed")), True).over(past), F.lit(0)))
    fixed = F.coalesce(F.last("_known", True).over(past), F.lit(0))
    left = line.withColumn("_known", known).withColumn("_fixed", fixed).filter("_turn = 0")
    return with_status(left.select("rule_key", "as_of", "scanned", F.greatest(F.col("failed") - F.col("_fixed"), F.lit(0)).alias("failed"), "error"))


# --------------------------------------------------------------------------- many small cases at once

@dataclass
class _Key:
    """A key within cases: its columns in every asset that has it, and which rows of an asset are looked up by it."""

    columns: dict[str, tuple[str, ...]] = field(default_factory=dict)
    kinds: list = field(default_factory=list)
    members: dict[str, str | None] = field(default_factory=dict)

    def takes(self, columns: Mapping[str, tuple[str, ...]], kinds: list, asset: str, where: str | None) -> bool:
        """Look up the rows ``where`` of an asset as well, unless this key is something else there."""
        if self.columns and (kinds != self.kinds or any(self.columns.get(a, c) != c for a, c in columns.items())
                             or self.members.get(asset, where) != where):
            return False
        self.columns.update(columns)
        self.kinds, self.members[asset] = kinds, where
        return True


def _meets_own_rows(rule: Rule, ctx: Context, case: str) -> bool:
    """Whether a set rule is decided by the count or the statistics of a key among the rows of a case."""
    if rule.type == "unique":
        return True
    found = lookup(rule, ctx, "_")
    if found is None or case not in ctx.table(found.asset).columns or "'" in str(rule.params.get("child_aggregate", "")):
        return False
    mine, other = ctx.table(rule.asset).schema, ctx.table(found.asset).schema
    return all(mine[a].dataType == other[b].dataType for a, b in found.pairs) and (
        found.asset != rule.asset or all(a == b for a, b in found.pairs))


def _plan_within_cases(rules: Sequence[Rule], ctx: Context, case: str) -> DataFrame:
    """Failed rows of set rules that look at rows of the same case only: (case, rule_key, failed).

    The rows of all assets are dealt by case once, side by side. For each key they are sorted once: a window over the rows of an
    asset with the same key has their statistics, and a window over all rows with that key hands them to the rows that are judged.
    """
    keys: list[_Key] = []
    place: list[tuple[int, str]] = []  # of each rule, the key and the asset that is looked up
    carried: dict[str, set[str]] = {}
    flags: dict[tuple[str, str], str] = {}  # predicates on the rows of an asset
    for rule in rules:
        p, primary = rule.params, ctx.table(rule.asset)
        mine = carried.setdefault(rule.asset, set())
        if rule.type == "unique":
            own = tuple(set_check(rule).needs(rule, ctx, primary))
            columns, asset, where = {rule.asset: own}, rule.asset, rule.where
        else:
            found = lookup(rule, ctx, "_")
            own, theirs = (tuple(c) for c in zip(*found.pairs, strict=True))
            columns, asset, where = {rule.asset: own, found.asset: theirs}, found.asset, found.where
            other = ctx.table(asset)
            mine.update(mentioned(primary, p.get("primary_expression"), p.get("later_column"), *p.get("compare", ())[:1]))
            carried.setdefault(asset, set()).update(mentioned(other, p.get("child_aggregate"), p.get("earlier_column"), *p.get("compare", ())[2:3]))
        for name, key in columns.items():
            carried[name].update(key)
        for name, text in ((rule.asset, rule.where), (asset, where)):
            if text:
                flags.setdefault((name, text), f"_w{len(flags)}")
        kinds = [primary.schema[c].dataType for c in own]
        if not any(key.takes(columns, kinds, asset, where) for key in keys):
            keys.append(_Key())
            keys[-1].takes(columns, kinds, asset, where)
        place.append((next(k for k, key in enumerate(keys) if all(key.columns.get(a) == c for a, c in columns.items())
                           and asset in key.members and key.members[asset] == where), asset))

    number = {name: i for i, name in enumerate(carried)}
    case_ = F.col(f"`{case}`")
    rows = []
    for name, wanted in carried.items():
        df = ctx.table(name)
        for (asset, text), mark in flags.items():
            if asset == name:
                # A predicate calls the rows that are judged p and those that are looked up c.
                df = df.alias("c" if re.search(r"\bc\.", text) else "p").withColumn(mark, F.coalesce(ctx.predicate(text), F.lit(False)))
        values = [F.col(f"`{c}`") for c in (*sorted(wanted), *(m for (a, _), m in flags.items() if a == name))]
        rows.append(df.select(case_, F.lit(number[name]).alias("_asset"), F.struct(*values).alias(f"_a{number[name]}")))
    tall = _union(rows).repartition(case_)

    def of(asset: str, column: str) -> Column:
        return F.col(f"_a{number[asset]}.`{column}`")

    for k, key in enumerate(keys):
        names = [f"_k{k}_{j}" for j in range(len(key.kinds))]
        member = F.col("_asset")
        for name, where in key.members.items():
            if where:
                member = F.when((F.col("_asset") == number[name]) & ~of(name, flags[name, where]), -1).otherwise(member)
        tall = tall.withColumns({**{n: F.coalesce(*[of(a, c[j]) for a, c in key.columns.items()]) for j, n in enumerate(names)}, "_member": member})
        alike, same = Window.partitionBy(case_, *names, "_member"), Window.partitionBy(case_, *names)
        stats, handed = {}, {}
        for i, rule in enumerate(rules):
            if place[i][0] != k:
                continue
            if rule.type == "unique":
                stats[f"_{i}_n"] = F.count(F.lit(1)).over(alike)
                continue
            at = number[place[i][1]]
            for name, stat in lookup(rule, ctx, f"_{i}_", f"_a{at}").stats.items():
                stats[f"{name}_"] = stat.over(alike)
                # Rows without a case have no partners.
                handed[name] = F.when(case_.isNotNull(), F.max(F.when(F.col("_member") == at, F.col(f"{name}_"))).over(same))
        tall = tall.select("*", *[c.alias(n) for n, c in stats.items()])
        tall = tall.select("*", *[c.alias(n) for n, c in handed.items()]).drop("_member", *[f"{n}_" for n in handed])
    verdicts = []
    for name in carried:
        tall = tall.withColumn("p", F.col(f"_a{number[name]}"))
        for i, rule in enumerate(rules):
            if rule.asset == name:
                bad = F.col(f"_{i}_n") > 1 if rule.type == "unique" else lookup(rule, ctx, f"_{i}_").bad
                judged = [F.col("_asset") == number[name], *[of(name, c).isNotNull() for c in keys[place[i][0]].columns[name]]]
                if rule.where:
                    judged.append(of(name, flags[name, rule.where]))
                verdicts.append(f"_v{i}")
                tall = tall.withColumn(f"_v{i}", F.when(all_of(judged) & bad, F.lit(rule.key)))
    return _each_failure(tall, [case], [F.col(v) for v in verdicts])


def _each_failure(rows: DataFrame, by: list[str], verdicts: list[Column]) -> DataFrame:
    """(by..., rule_key, failed) of rows with the keys of the rules they fail: only these are counted, and shuffled."""
    failing = rows.select(*[F.col(f"`{b}`") for b in by], F.explode(F.array_compact(F.array(*verdicts))).alias("rule_key"))
    return failing.groupBy(*[F.col(f"`{b}`") for b in by], "rule_key").agg(F.count(F.lit(1)).alias("failed"))


def _failing_fused(asset: str, rules: list[Rule], ctx: Context, by: list[str]) -> DataFrame:
    """Failed rows of the row rules of an asset."""
    df = ctx.table(asset).alias("p")
    bad = [all_of(c for c in (_scope(rule, ctx, df, None), row_check(rule)(rule, ctx)) if c is not None) for rule in rules]
    return _each_failure(df, by, [F.when(b, F.lit(rule.key)) for rule, b in zip(rules, bad, strict=True)])


def _plan_unknown(rules: Sequence[Rule], ctx: Context, case: str) -> list[DataFrame]:
    """Failed rows of relationship rules whose other asset is shared by all cases, one frame (case, rule_key, failed) per rule.

    Keys are looked up once each, whatever cases have them. Those found unknown are written, so that Spark knows how few they are.
    """
    groups: dict[str, list[tuple[Rule, DataFrame]]] = {}
    for rule in rules:
        df = ctx.table(rule.asset).alias("p")
        rows = _in_scope(rule, ctx, df, None).select(F.col(f"p.`{case}`"), F.col(f"p.`{rule.params['column']}`").alias("_key"))
        groups.setdefault(df.schema[rule.params["column"]].dataType.simpleString(), []).append((rule, rows))
    frames = []
    for group in groups.values():
        lost = []
        for rule, rows in group:
            known = ctx.table(rule.params["to_asset"]).select(F.col(f"`{rule.params['to_column']}`").alias("_known")).distinct()
            asked = rows.select("_key").dropna().distinct()
            lost.append(asked.join(known, F.col("_key") == F.col("_known"), "left_anti").withColumn("rule_key", F.lit(rule.key)))
        unknown = checkpoint(_union(lost))
        for rule, rows in group:
            mine = unknown.filter(F.col("rule_key") == rule.key).select("_key")
            frames.append(rows.join(mine, "_key", "left_semi").groupBy(F.col(f"`{case}`")).agg(
                F.count(F.lit(1)).alias("failed")).withColumn("rule_key", F.lit(rule.key)))
    return frames


def failing_by_case(tables: Mapping[str, DataFrame], rules: Sequence[Rule], as_of: datetime | str,
                    case: str = "case_id") -> DataFrame:
    """(case_id, rule_key, failed) for every failing rule of every case, in one job.

    The case is part of every key, so cases do not see each other. A table without the case column is
    shared by all cases; a failing rule on it has a NULL case.
    """
    frames, together, unknown = [], [], []
    cased = Context(tables, cutoff_sql(as_of), (case,))
    for asset, group in _by_asset(rules).items():
        own = [case] if case in tables[asset].columns else []
        ctx = Context(tables, cutoff_sql(as_of), tuple(own))
        fused = [r for r in group if row_check(r) is not None]
        if fused and own:
            frames.append(_failing_fused(asset, fused, ctx, own))
        elif fused:
            frames.append(_plan_fused(asset, fused, ctx, own, None).filter("failed > 0").drop("scanned"))
        for rule in (r for r in group if row_check(r) is None):
            if own and _meets_own_rows(rule, ctx, case):
                together.append(rule)
            elif own and rule.type == "relationship" and case not in ctx.table(rule.params["to_asset"]).columns:
                unknown.append(rule)
            else:
                frames.append(_plan_set(rule, ctx, own, None).filter("failed > 0"))
    if together:
        frames.append(_plan_within_cases(together, cased, case))
    if unknown:
        frames += _plan_unknown(unknown, cased, case)
    found = _union(frames)
    if case not in found.columns:
        found = found.withColumn(case, F.lit(None).cast("string"))
    return found.select(case, "rule_key", "failed")
