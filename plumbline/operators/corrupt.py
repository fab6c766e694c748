"""Labelled corruption: plant a known defect and describe what was planted.

Rows are chosen by a predicate over the row, so the choice repeats. Each function returns the changed
table; ``truth`` turns the choice into one ground-truth row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.joins import attach


def pick(key: Column, share: int, offset: int = 0) -> Column:
    """Every ``share``-th row by the key's hash."""
    return F.coalesce(F.pmod(F.xxhash64(key), F.lit(share)) == offset, F.lit(False))


def edit(df: DataFrame, chosen: Column, column: str, value: Column) -> DataFrame:
    """Replace one column on the chosen rows."""
    kind = df.schema[column].dataType
    return df.withColumn(column, F.when(chosen, value.cast(kind)).otherwise(F.col(column)))


def orphan_key(df: DataFrame, chosen: Column, column: str, prefix: str = "LEGACY-") -> DataFrame:
    return edit(df, chosen, column, F.concat(F.lit(prefix), F.col(column)))


def replay(df: DataFrame, chosen: Column, minutes: int = 120, load_column: str = "loaded_at") -> DataFrame:
    """Load the chosen rows a second time, later. One scan: each row is emitted once or twice."""
    copies = F.when(chosen, F.array(F.lit(0), F.lit(minutes))).otherwise(F.array(F.lit(0)))
    late = F.make_dt_interval(F.lit(0), F.lit(0), F.col("_late"))
    return df.select("*", F.explode(copies).alias("_late")).withColumn(
        load_column, F.col(load_column) + late).drop("_late")


def null_out(df: DataFrame, chosen: Column, column: str) -> DataFrame:
    return edit(df, chosen, column, F.lit(None))


def shift_time(df: DataFrame, chosen: Column, column: str, minutes: int, base: str | None = None) -> DataFrame:
    """Move a timestamp, optionally relative to another column of the row."""
    moved = F.col(base or column) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    return edit(df, chosen, column, moved)


def set_value(df: DataFrame, chosen: Column, column: str, value: object) -> DataFrame:
    return edit(df, chosen, column, F.lit(value))


def end_before_start(df: DataFrame, chosen: Column, start: str, end: str, days: int) -> DataFrame:
    return edit(df, chosen, end, F.date_sub(F.col(start), days))


def inflate_above_parent(df: DataFrame, parent: DataFrame, chosen: Column, key: str, column: str,
                         parent_column: str, extra: int) -> DataFrame:
    """Raise a child amount above its parent's."""
    limits = parent.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(parent_column).alias("_limit"))
    joined = attach(df.withColumn("_chosen", chosen), limits, [key])
    value = F.when(F.col("_chosen") & F.col("_limit").isNotNull(), F.col("_limit") + extra).otherwise(F.col(column))
    return joined.withColumn(column, value.cast(df.schema[column].dataType)).select(*df.columns)


def excess_children(child: DataFrame, parent: DataFrame, chosen: Column, build: list[list[Column]]) -> DataFrame:
    """Add several child rows per chosen parent. ``build`` lists the columns of each new row."""
    rows = F.array(*[F.struct(*columns) for columns in build])
    extra = parent.filter(chosen).select(F.explode(rows).alias("r")).select("r.*")
    typed = extra.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in child.schema])
    return child.unionByName(typed)


def repoint_key(df: DataFrame, chosen: Column, column: str, neighbour: Column) -> DataFrame:
    """Point to another valid key, computed from the row."""
    return edit(df, chosen, column, neighbour)


def add_amount(df: DataFrame, chosen: Column, column: str, amount: float) -> DataFrame:
    return edit(df, chosen, column, F.col(column) + F.lit(amount))


def negate(df: DataFrame, chosen: Column, *columns: str) -> DataFrame:
    out = df
    for column in columns:
        out = edit(out, chosen, column, -F.col(column))
    return out


def truth(df: DataFrame, chosen: Column, defect_type: str, table: str, rule: str, key: str,
          rows_per_record: int = 1) -> DataFrame:
    """(defect_type, table_name, primary_rule, record_id): the planted records, one row each."""
    return df.filter(chosen).select(
        F.lit(defect_type).alias("defect_type"), F.lit(table).alias("table_name"), F.lit(rule).alias("primary_rule"),
        F.col(key).alias("record_id"), F.lit(rows_per_record).alias("rows_per_record"))


def truth_summary(records: DataFrame) -> DataFrame:
    """Injected records and expected failing rows per defect. Ids stay in ``records``, which may be large."""
    return records.groupBy("defect_type", "table_name", "primary_rule").agg(
        F.count(F.lit(1)).alias("injected_records"), F.sum("rows_per_record").alias("expected_failing_rows"))


def overlapping_records(records: DataFrame) -> DataFrame:
    """Records that carry more than one defect; an honest truth table has none."""
    return records.groupBy("table_name", "record_id").agg(
        F.count_distinct("defect_type").alias("defects")).filter("defects > 1")
