"""Measure a ruleset as a binary detector over labelled cases; "defective" is the positive class."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.quality import failing_by_case
from plumbline.operators.rules import Rule

POSITIVE, NEGATIVE = "defective", "valid"


def load_records(spark: SparkSession, contracts: Mapping[str, T.StructType],
                 cases: Mapping[str, Mapping[str, list[dict[str, Any]]]],
                 context: Mapping[str, list[dict[str, Any]]] | None = None) -> dict[str, DataFrame]:
    """Staging-shaped tables with a ``case_id`` from hand-written records.

    Absent columns are NULL, unknown tables or columns are errors, and every case gets its own copy of
    the shared context rows (suites are written by hand, so both are small).
    """
    tables = {}
    for problem in suite_problems(contracts, cases, context):
        raise ValueError(problem)
    for name, schema in contracts.items():
        rows = []
        for case_id, records in cases.items():
            for row in [*(context or {}).get(name, []), *records.get(name, [])]:
                rows.append((case_id, *[_typed(row.get(f.name), f.dataType) for f in schema]))
        with_case = T.StructType([T.StructField("case_id", T.StringType()), *schema.fields])
        tables[name] = spark.createDataFrame(rows, with_case)
    return tables


def _typed(value: Any, kind: T.DataType) -> Any:
    if value is None:
        return None
    if isinstance(kind, T.DecimalType):
        return Decimal(str(value)).quantize(Decimal(1).scaleb(-kind.scale))
    if isinstance(kind, T.TimestampNTZType):
        return datetime.fromisoformat(value) if isinstance(value, str) else value
    if isinstance(kind, T.DateType):
        return date.fromisoformat(value) if isinstance(value, str) else value
    return value


def suite_problems(contracts: Mapping[str, T.StructType], cases: Mapping[str, Mapping[str, list[dict]]],
                   context: Mapping[str, list[dict]] | None = None) -> list[str]:
    """Unknown tables and columns in a suite's records."""
    found = []
    for where, records in {**({"context": context} if context else {}), **cases}.items():
        for table, rows in records.items():
            if table not in contracts:
                found.append(f"{where}: unknown table '{table}'")
                continue
            unknown = {c for row in rows for c in row} - set(contracts[table].names)
            if unknown:
                found.append(f"{where}: unknown columns {sorted(unknown)} in {table}")
    return found


def label_problems(labels: DataFrame) -> DataFrame:
    """(case_id, problem), one row per kind of problem of a case, over (case_id, expected, defect_category)."""
    expected, category = F.col("expected"), F.col("defect_category")
    problem = F.when(~expected.isin(POSITIVE, NEGATIVE), "unknown label").when(
        (expected == POSITIVE) & category.isNull(), "defective case without a category").when(
        (expected == NEGATIVE) & category.isNotNull(), "valid case with a category")
    repeated = labels.groupBy("case_id").count().filter("count > 1").select("case_id", F.lit("duplicate case id").alias("problem"))
    return labels.select("case_id", problem.alias("problem")).filter("problem IS NOT NULL").distinct().unionByName(repeated)


def outcome(expected: Column, predicted: Column) -> Column:
    return F.when(expected == POSITIVE, F.when(predicted == POSITIVE, "TP").otherwise("FN")).otherwise(
        F.when(predicted == POSITIVE, "FP").otherwise("TN"))


def predict(tables: Mapping[str, DataFrame], rules: Sequence[Rule], labels: DataFrame,
            as_of: datetime | str) -> DataFrame:
    """(case_id, expected, predicted, outcome, triggered_rules, defect_category), all cases in one job."""
    triggered = failing_by_case(tables, rules, as_of).groupBy("case_id").agg(
        F.array_sort(F.collect_set("rule_key")).alias("triggered_rules"))
    joined = labels.join(triggered, "case_id", "left")
    fired = F.coalesce("triggered_rules", F.array().cast("array<string>"))
    predicted = F.when(F.size(fired) > 0, POSITIVE).otherwise(NEGATIVE)
    return joined.select("case_id", "expected", predicted.alias("predicted"),
                         outcome(F.col("expected"), predicted).alias("outcome"), fired.alias("triggered_rules"),
                         "defect_category")


def of_ruleset(predictions: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Predictions of a part of the rules they were made with: rules are judged one by one, so nothing is evaluated again."""
    fired = F.array_intersect("triggered_rules", F.array(*[F.lit(r.key) for r in rules]).cast("array<string>"))
    predicted = F.when(F.size(fired) > 0, POSITIVE).otherwise(NEGATIVE)
    return predictions.select("case_id", "expected", predicted.alias("predicted"), outcome(F.col("expected"), predicted).alias("outcome"),
                              F.array_sort(fired).alias("triggered_rules"), "defect_category")


def confusion(predictions: DataFrame, *by: str) -> DataFrame:
    """Counts and metrics (four digits, NULL on an empty denominator) per group or overall."""
    counts = predictions.groupBy(*by).agg(*[
        F.count_if(F.col("outcome") == o).alias(o.lower()) for o in ("TP", "FN", "FP", "TN")])
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, F.round(part.cast("decimal(20,0)") / whole.cast("decimal(20,0)"), 4)).cast("double")

    f1 = F.when((tp + fp > 0) & (tp + fn > 0), share(2 * tp, 2 * tp + fp + fn))
    return counts.select(
        *by, "tp", "fn", "fp", "tn", (tp + fn + fp + tn).alias("total"),
        share(tp + tn, tp + fn + fp + tn).alias("accuracy"), share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"), f1.alias("f1_score"), share(tn, tn + fp).alias("specificity"))


def content_hash(df: DataFrame, key: str) -> DataFrame:
    """(key, content_hash): 16 hex digits over each row's canonical JSON."""
    fields = sorted(c for c in df.columns)
    return df.select(key, F.substring(F.sha2(F.to_json(F.struct(*fields)), 256), 1, 16).alias("content_hash"))


def suite_hash(hashes: DataFrame, key: str = "case_id", digits: int = 3) -> DataFrame:
    """One hash over all case hashes, independent of row order.

    Cases are hashed in order within the buckets of their first digits, then the buckets' digests in order, so that no
    task sees more than a bucket.
    """
    def digest(first: Column, second: Column) -> Column:
        lines = F.array_sort(F.collect_list(F.concat_ws(":", first, second)))
        return F.sha2(F.array_join(lines, ","), 256)

    buckets = hashes.groupBy(F.substring("content_hash", 1, digits).alias("bucket")).agg(
        digest(F.col(key), F.col("content_hash")).alias("digest"))
    return buckets.agg(F.substring(digest(F.col("bucket"), F.col("digest")), 1, 16).alias("suite_hash"))


def compare_detectors(before: DataFrame, after: DataFrame) -> DataFrame:
    """Cases with both detectors' outcomes side by side."""
    old = before.select("case_id", F.col("outcome").alias("baseline_outcome"),
                        F.col("triggered_rules").alias("baseline_rules"))
    return after.join(old, "case_id", "left")


def error_fixes(before: DataFrame, after: DataFrame, rules: DataFrame) -> DataFrame:
    """Baseline errors, the later verdict, and the rules whose rationale names the case."""
    wrong = before.filter(F.col("outcome").isin("FN", "FP")).select("case_id", F.col("outcome").alias("error"))
    later = after.select("case_id", F.col("outcome").alias("improved_outcome"), "triggered_rules")
    cited = rules.filter("rationale IS NOT NULL").select(
        "rule_key", F.explode(F.regexp_extract_all("rationale", F.lit(r"[A-Z]{2}-\d{3}"), F.lit(0))).alias("case_id"))
    fixes = cited.groupBy("case_id").agg(F.array_sort(F.collect_set("rule_key")).alias("fixes"))
    return wrong.join(later, "case_id", "left").join(fixes, "case_id", "left")


def regressions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Cases that were right before and are wrong now."""
    right = before.filter(F.col("outcome").isin("TP", "TN")).select("case_id")
    return after.filter(F.col("outcome").isin("FN", "FP")).join(right, "case_id", "left_semi")


def latest_runs(runs: DataFrame) -> DataFrame:
    """The latest run per suite and detector."""
    rest = [c for c in runs.columns if c not in ("suite", "detector")]
    newest = runs.groupBy("suite", "detector").agg(F.max_by(F.struct(*rest), "eval_run_id").alias("r"))
    return newest.select("suite", "detector", *[f"r.{c}" for c in rest])


def coverage(truth: DataFrame, counts: DataFrame, rules: DataFrame) -> DataFrame:
    """Expected against found failing rows per injected defect.

    A rule outside the executed ruleset is looked up through the rule that supersedes it.
    """
    successor = rules.filter("supersedes IS NOT NULL").select(
        F.col("supersedes").alias("primary_rule"), F.col("rule_key").alias("_next"))
    ran = counts.select(F.col("rule_key").alias("executed_rule"), "failed")
    executed = counts.select(F.col("rule_key").alias("primary_rule"), F.lit(True).alias("_ran"))
    mapped = truth.join(executed, "primary_rule", "left").join(successor, "primary_rule", "left").withColumn(
        "executed_rule", F.when(F.col("_ran"), F.col("primary_rule")).otherwise(
            F.coalesce("_next", "primary_rule"))).drop("_ran", "_next")
    return mapped.join(ran, "executed_rule", "left").select(
        "defect_type", "primary_rule", "executed_rule", "injected_records", "expected_failing_rows",
        F.coalesce("failed", F.lit(0)).alias("found"),
        (F.coalesce("failed", F.lit(0)) >= F.col("expected_failing_rows")).alias("covered"))
