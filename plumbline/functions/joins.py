"""Lookup joins that stay balanced when the left key is often NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from plumbline.functions.scalars import all_of, any_of

_SPREAD = 997


def attach(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Left-join ``right`` (one row per key) without sending all NULL keys to one task.

    NULL keys never match, so each gets a key of its own from other columns of its row and hashes all over the cluster; only three
    columns are asked, so that no other is read or shuffled for it. Text keys meet the right side as they are, which keeps a right side that
    is grouped by them where it is. Hot non-NULL keys are left to AQE, which splits the skewed left partition.
    """
    rest = [c for c in left.columns if c not in on]
    lost = F.xxhash64(*(rest[:3] or on))
    rights = right.filter(all_of(F.col(k).isNotNull() for k in on))
    if all(df.schema[k].dataType == StringType() for df in (left, right) for k in on):
        lefts = left.select(*on, *rest, *[F.coalesce(F.col(k), lost.cast("string")).alias(f"_at_{k}") for k in on])
        rights = rights.withColumnsRenamed({k: f"_of_{k}" for k in on})
        # Whatever a NULL key is replaced by, it matches nothing.
        meets = all_of([*(F.col(f"_at_{k}") == F.col(f"_of_{k}") for k in on), *(lefts[k].isNotNull() for k in on)])
        return lefts.join(rights, meets, how).drop(*[f"{mark}{k}" for k in on for mark in ("_at_", "_of_")])
    spread = F.when(any_of(F.col(k).isNull() for k in on), F.pmod(lost, F.lit(_SPREAD)) + 1).otherwise(F.lit(0))
    lefts = left.withColumn("_spread", spread.cast("bigint"))
    # Always 0, but not a constant that the optimizer could fold out of the join keys.
    rights = rights.withColumn("_spread", F.pmod(F.xxhash64(*on), F.lit(1)).cast("bigint"))
    return lefts.join(rights, [*on, "_spread"], how).drop("_spread")


def count_rows(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """Collapse rows to distinct key combinations with their multiplicity (map-side combined)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
