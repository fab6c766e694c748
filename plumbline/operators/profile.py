"""Column and freshness profiles.

One scan computes the plain statistics of every column, one shuffle of distinct values serves distinct
counts, common values and examples, and medians are bracketed by a sketch and picked in a second scan, so no column is ever
collected into one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.sources.tables import split_columns

_FANOUT = 4096
#: Accuracy of the quantile sketch (its error is n / accuracy ranks), and the most values that one task ranks.
_SKETCH = 10_000
_PICKED = 1_000_000


@dataclass(frozen=True)
class Target:
    """What to profile in one table."""

    asset: str
    columns: tuple[str, ...]
    pii: frozenset[str] = frozenset()
    freshness_column: str | None = None
    sla_hours: int | None = None


def family(kind: T.DataType) -> str:
    """numeric, temporal, boolean or text."""
    if isinstance(kind, T.NumericType):
        return "numeric"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "temporal"
    return "boolean" if isinstance(kind, T.BooleanType) else "text"


def sla_hours(count: Column, period: Column) -> Column:
    """Whole hours of a (count, period) promise, at least one; NULL when undeclared."""
    # Hours per period.
    factor = F.when(period == "minute", F.lit(1) / 60).when(period == "hour", 1).when(period == "day", 24)
    hours = F.bround(count * factor)
    return F.when(hours.isNotNull(), F.greatest(F.lit(1), hours)).cast("int")


def lag_hours(freshest: Column, cutoff: Column) -> Column:
    micros = F.timestamp_diff("MICROSECOND", freshest.cast("timestamp_ntz"), cutoff)
    return F.round(micros.cast("decimal(20,0)") / 3_600_000_000, 2).cast("double")


def freshness_status(lag: Column, sla: Column) -> Column:
    return F.when(lag.isNull() | sla.isNull(), "unknown").when(lag <= sla, "fresh").otherwise("stale")


def _live(df: DataFrame, target: Target) -> list[str]:
    return split_columns(df, target.columns)[0]


def column_statistics(df: DataFrame, target: Target) -> DataFrame:
    """(column_name, row_count, non_null, min_value, max_value, mean_value, stddev_value) in one scan."""
    aggregates, lines = [F.count(F.lit(1)).alias("row_count")], []
    missing = F.lit(None)
    for i, name in enumerate(_live(df, target)):
        column, kind = F.col(f"`{name}`"), family(df.schema[name].dataType)
        aggregates.append(F.count(column).alias(f"n{i}"))
        shown = kind != "boolean" and name not in target.pii
        if shown:
            aggregates += [F.min(column).cast("string").alias(f"lo{i}"), F.max(column).cast("string").alias(f"hi{i}")]
        if kind == "numeric":
            aggregates += [F.avg(column).cast("double").alias(f"mean{i}"),
                           F.stddev_samp(column).cast("double").alias(f"sd{i}")]
        lines.append(F.struct(
            F.lit(name).alias("column_name"), F.lit(i + 1).alias("ordinal"), F.col("row_count"),
            F.col(f"n{i}").alias("non_null"),
            (F.col(f"lo{i}") if shown else missing.cast("string")).alias("min_value"),
            (F.col(f"hi{i}") if shown else missing.cast("string")).alias("max_value"),
            (F.col(f"mean{i}") if kind == "numeric" else missing.cast("double")).alias("mean_value"),
            (F.col(f"sd{i}") if kind == "numeric" else missing.cast("double")).alias("stddev_value"),
        ))
    return df.agg(*aggregates).select(F.explode(F.array(*lines)).alias("line")).select("line.*")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value, n) for every distinct non-NULL value of every column, as text."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value"))
                      for c in columns])
    return df.select(F.explode(cells).alias("cell")).select("cell.*").filter("value IS NOT NULL").groupBy(
        "column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("distinct_count"), F.sum("n").alias("non_null_values"))


def _first_per_column(counts: DataFrame, order: list[Column], size: int) -> DataFrame:
    # row_number with a bound: Spark keeps at most `size` rows per column and task before the shuffle.
    window = Window.partitionBy("column_name").orderBy(*order)
    return counts.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= size)


def top_values(counts: DataFrame, size: int = 5) -> DataFrame:
    """Most common values per column, ties by value."""
    return _first_per_column(counts, [F.desc("n"), F.asc("value")], size)


def sample_values(counts: DataFrame, size: int = 5) -> DataFrame:
    """Repeatable examples: distinct values in hash order."""
    return _first_per_column(counts, [F.asc(F.md5("value")), F.asc("value")], size)


def exact_medians(df: DataFrame, columns: Iterable[str]) -> dict[str, float | None]:
    """Exact medians (mean of the two middle values, as doubles) without sorting or collecting a column.

    The first scan counts every column and brackets its middle by a mergeable quantile sketch; the second counts what lies
    below the bracket and the few values inside it, and picks the ranks. Both serve all columns. Columns whose bracket
    holds too many values for one task, misses the ranks, or that have NaN (the largest value) or infinities are
    narrowed by histograms instead. Casting to double keeps the order, so the k-th double is the double of the k-th value.
    """
    names = list(columns)
    df = df.select(*[F.col(f"`{n}`").cast("double").alias(n) for n in names])
    around = [0.5 - 2 / _SKETCH, 0.5 + 2 / _SKETCH]
    aggregates = []
    for i, n in enumerate(names):
        c = F.col(f"`{n}`")
        finite = F.when(F.abs(c) < float("inf"), c)
        aggregates += [F.count(c).alias(f"n{i}"), F.count(finite).alias(f"f{i}"), F.percentile_approx(finite, around, _SKETCH).alias(f"q{i}")]
    seen = df.agg(*aggregates).first()
    result: dict[str, float | None] = {n: None for i, n in enumerate(names) if not seen[f"n{i}"]}
    quick = [(n, seen[f"n{i}"], *seen[f"q{i}"]) for i, n in enumerate(names)
             if seen[f"n{i}"] and seen[f"n{i}"] == seen[f"f{i}"] and seen[f"n{i}"] * 6 <= _PICKED * _SKETCH]
    result |= _pick(df, quick)
    return result | _narrow(df, [n for n in names if n not in result])


def _pick(df: DataFrame, brackets: list[tuple[str, int, float, float]]) -> dict[str, float]:
    """Medians of ``(column, non-null values, low, high)`` that lie within their bracket, in one scan."""
    if not brackets:
        return {}
    cells, wanted = [], []
    for j, (name, n, low, high) in enumerate(brackets):
        value = F.col(f"`{name}`")
        # All values below the bracket are one entry without a value.
        cells.append(F.when(value <= high, F.struct(F.lit(j).alias("j"), F.when(value >= low, value).alias("v"))))
        wanted.append(F.array(*[F.lit(r).cast("bigint") for r in sorted({(n - 1) // 2, n // 2})]))
    counts = df.select(F.explode(F.array(*cells)).alias("c")).filter("c IS NOT NULL").groupBy("c.j", "c.v").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("j").orderBy(F.asc_nulls_first("v"))
    ranks = F.filter(F.element_at(F.array(*wanted), F.col("j") + 1), lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))
    hits: dict[int, list[float]] = {}
    for row in counts.withColumn("upto", F.sum("n").over(upto)).withColumn("hits", F.size(ranks)).filter("hits > 0 AND v IS NOT NULL").collect():
        hits.setdefault(row["j"], []).extend([row["v"]] * row["hits"])
    return {name: sum(v / len(hits[j]) for v in hits[j]) for j, (name, n, *_) in enumerate(brackets) if len(hits.get(j, ())) == (1 if n % 2 else 2)}


def _share(value: Column, lo: float, hi: float) -> Column:
    """Where ``value`` lies between ``lo`` (0) and ``hi`` (1), without overflow."""
    low, high = F.lit(lo), F.lit(hi)
    if math.isinf(hi - lo):
        value, low, high = value / 2, low / 2, high / 2
    return (value - low) / (high - low)


def _narrow(df: DataFrame, names: list[str]) -> dict[str, float | None]:
    """Medians by counting the remaining range of a column in 4096 buckets, round by round."""
    if not names:
        return {}
    finite = {}
    for n in names:
        c = F.col(f"`{n}`")
        finite[n] = F.when(F.abs(c) < float("inf"), c)
    aggregates = []
    for i, n in enumerate(names):
        c = F.col(f"`{n}`")
        aggregates += [F.count(finite[n]).alias(f"n{i}"), F.min(finite[n]).alias(f"lo{i}"), F.max(finite[n]).alias(f"hi{i}")]
        aggregates += [F.count_if(c == value).alias(f"{tag}{i}") for tag, value in
                       (("neg", float("-inf")), ("pos", float("inf")), ("nan", float("nan")))]
    bounds = df.agg(*aggregates).first()
    # Wanted ranks: (column, rank among finite values) -> [lowest value, highest value, rows below].
    open_ranks, found, fixed = {}, {}, {}
    for i in range(len(names)):
        n = bounds[f"n{i}"]
        ends = [(bounds[f"{tag}{i}"], value) for tag, value in
                (("neg", float("-inf")), ("pos", float("inf")), ("nan", float("nan")))]
        total = n + sum(k for k, _ in ends)
        for rank in {(total - 1) // 2, total // 2} if total else set():
            if rank < ends[0][0]:
                fixed.setdefault(i, []).append(ends[0][1])
            elif rank < ends[0][0] + n:
                open_ranks[(i, rank - ends[0][0])] = [bounds[f"lo{i}"], bounds[f"hi{i}"], 0]
            else:
                fixed.setdefault(i, []).append(ends[1][1] if rank < ends[0][0] + n + ends[1][0] else ends[2][1])
    while True:
        for key in [k for k, (lo, hi, _) in open_ranks.items() if lo == hi]:
            found[key] = open_ranks.pop(key)[0]
        if not open_ranks:
            break
        keys = list(open_ranks)
        before = {k: tuple(v[:2]) for k, v in open_ranks.items()}
        cells = []
        for j, (i, _) in enumerate(keys):
            lo, hi, _below = open_ranks[keys[j]]
            value = finite[names[i]]
            bucket = F.least(F.floor(_share(value, lo, hi) * _FANOUT), F.lit(_FANOUT - 1)).cast("int")
            cells.append(F.when(value.between(F.lit(lo), F.lit(hi)), F.struct(
                F.lit(j).alias("j"), bucket.alias("bucket"), value.alias("v"))))
        histogram = df.select(F.explode(F.array(*cells)).alias("c")).filter("c IS NOT NULL").groupBy(
            F.col("c.j").alias("j"), F.col("c.bucket").alias("bucket")).agg(
            F.count(F.lit(1)).alias("n"), F.min("c.v").alias("lo"), F.max("c.v").alias("hi"))
        upto = Window.partitionBy("j").orderBy("bucket")  # at most 4096 rows each
        wanted = F.create_map(*[F.lit(x) for j, k in enumerate(keys) for x in (j, k[1] - open_ranks[k][2])])
        chosen = histogram.withColumn("upto", F.sum("n").over(upto)).withColumn("rank", wanted[F.col("j")]).filter(
            (F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
        for row in chosen.collect():  # one row per wanted rank
            key = keys[row["j"]]
            open_ranks[key] = [row["lo"], row["hi"], open_ranks[key][2] + row["upto"] - row["n"]]
        # The lowest and the highest value fall into different buckets, so every range shrinks.
        if any(tuple(v[:2]) == before[k] for k, v in open_ranks.items()):
            raise RuntimeError("a median's range did not shrink")
    medians: dict[str, float | None] = {}
    for i, name in enumerate(names):
        middle = [float(v) for (c, _), v in found.items() if c == i] + fixed.get(i, [])
        medians[name] = sum(m / len(middle) for m in middle) if middle else None
    return medians


def column_profiles(df: DataFrame, target: Target, top_n: int = 5, sample_size: int = 5,
                    medians: bool = True) -> DataFrame:
    """One row per column with counts, rates, range, moments, median, common values and examples."""
    spark = df.sparkSession
    columns = _live(df, target)
    stats = column_statistics(df, target)
    counts = value_counts(df, columns)
    open_counts = counts.filter(~F.col("column_name").isin(*target.pii)) if target.pii else counts
    distinct = distinct_counts(counts).drop("non_null_values")

    def listed(frame: DataFrame, item: Column, name: str) -> DataFrame:
        ranked = F.array_sort(F.collect_list(F.struct("rank", item.alias("item"))))
        return frame.groupBy("column_name").agg(F.transform(ranked, lambda r: r["item"]).alias(name))

    common = listed(top_values(open_counts, top_n), F.struct("value", F.col("n").alias("count")), "top_values")
    examples = listed(sample_values(open_counts, sample_size), F.col("value"), "sample_values")
    numeric = [c for c in columns if family(df.schema[c].dataType) == "numeric"]
    values = exact_medians(df, numeric) if medians and numeric else {}
    middle = spark.createDataFrame(
        [(c, values.get(c)) for c in columns], "column_name string, median_value double")
    joined = stats
    for part in (distinct, common, examples, middle):  # one row per column each
        joined = joined.join(part, "column_name", "left")
    rows, filled = F.col("row_count"), F.col("non_null")
    unique_rate = F.when(filled > 0, F.round(F.coalesce(F.col("distinct_count"), F.lit(0)) / filled, 6)).otherwise(0.0)
    empty_top = F.array().cast("array<struct<value:string,count:bigint>>")
    return joined.select(
        F.lit(target.asset).alias("asset"), "column_name", "ordinal", (rows - filled).alias("null_count"),
        F.when(rows > 0, F.round((rows - filled) / rows, 6)).otherwise(0.0).alias("null_rate"),
        F.coalesce("distinct_count", F.lit(0)).alias("distinct_count"), unique_rate.alias("uniqueness"),
        "min_value", "max_value", "mean_value", "stddev_value", "median_value",
        F.when(F.col("distinct_count") < filled, F.coalesce("top_values", empty_top)).otherwise(empty_top)
        .alias("top_values"),
        F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
    )


def asset_profile(df: DataFrame, target: Target, cutoff: datetime | str) -> DataFrame:
    """Row count, column count and freshness of one asset. Later-dated values do not count as fresh."""
    now = F.expr(f"TIMESTAMP_NTZ '{cutoff}'")
    columns = _live(df, target)
    fresh = target.freshness_column if target.freshness_column in df.columns else None
    newest = F.lit(None).cast("timestamp_ntz")
    if fresh:
        value = F.col(f"`{fresh}`").cast("timestamp_ntz")
        newest = F.max(F.when(value <= now, value))
    totals = df.agg(F.count(F.lit(1)).alias("row_count"), newest.alias("freshest_value"))
    return _with_freshness(totals.select(
        F.lit(target.asset).alias("asset"), "row_count", F.lit(len(columns)).alias("column_count"),
        "freshest_value", F.lit(target.sla_hours).cast("int").alias("sla_hours")), now)


def _with_freshness(df: DataFrame, now: Column) -> DataFrame:
    out = df.withColumn("freshness_lag_hours", lag_hours(F.col("freshest_value"), now))
    return out.withColumn("freshness_status", freshness_status(F.col("freshness_lag_hours"), F.col("sla_hours")))


def profile_history(df: DataFrame, target: Target, cutoffs: Sequence[datetime | str],
                    load_column: str = "loaded_at") -> DataFrame:
    """Row count and freshness as each earlier run would have seen them, in one scan."""
    value = F.col(f"`{target.freshness_column}`").cast("timestamp_ntz") if target.freshness_column else None
    aggregates, lines = [], []
    for i, cutoff in enumerate(cutoffs):
        now = F.expr(f"TIMESTAMP_NTZ '{cutoff}'")
        seen = F.col(load_column) <= now
        aggregates.append(F.count_if(seen).alias(f"n{i}"))
        newest = F.max(F.when(seen & (value <= now), value)) if value is not None else F.lit(None).cast("timestamp_ntz")
        aggregates.append(newest.alias(f"f{i}"))
        lines.append(F.struct(F.lit(i + 1).alias("run_id"), now.alias("as_of"), F.col(f"n{i}").alias("row_count"),
                              F.col(f"f{i}").alias("freshest_value")))
    runs = df.agg(*aggregates).select(F.explode(F.array(*lines)).alias("r")).select(
        F.lit(target.asset).alias("asset"), "r.*", F.lit(target.sla_hours).cast("int").alias("sla_hours"))
    return _with_freshness(runs, F.col("as_of"))


def profile_assets(spark: SparkSession, tables: Mapping[str, DataFrame], targets: Sequence[Target],
                   cutoff: datetime | str) -> tuple[DataFrame, dict[str, str]]:
    """Asset profiles of all targets whose table exists, and the reasons for the skipped ones."""
    frames, skipped = [], {}
    for target in targets:
        if target.asset not in tables:
            skipped[target.asset] = "table does not exist"
            continue
        frames.append(asset_profile(tables[target.asset], target, cutoff))
    if not frames:
        raise ValueError(f"nothing to profile, skipped: {skipped}")
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out, skipped


def latest_per_asset(history: DataFrame, run: str = "run_id") -> DataFrame:
    """The newest profile row of every asset."""
    rest = [c for c in history.columns if c != "asset"]
    newest = history.groupBy("asset").agg(F.max_by(F.struct(*rest), run).alias("_row"))
    return newest.select("asset", *[f"_row.{c}" for c in rest])
