"""Reading and writing tables: raw landing, CSV snapshots, run history, upserts and introspection."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import PACKED
from plumbline.sources.schemas import RAW


def write_tables(tables: Mapping[str, DataFrame], folder: str, parallel: int = 2) -> None:
    """Write several independent tables as parquet; the jobs share the cluster."""
    with ThreadPoolExecutor(parallel) as pool:
        list(pool.map(lambda item: item[1].write.mode("overwrite").option("compression", PACKED).parquet(f"{folder}/{item[0]}"), tables.items()))


class RawTables(Mapping[str, DataFrame]):
    """Raw tables in a folder, read with their fixed schema when first asked for."""

    def __init__(self, spark: SparkSession, folder: str, fmt: str) -> None:
        self._reader = spark.read.option("header", True).option("mode", "FAILFAST") if fmt == "csv" else spark.read
        self._folder, self._fmt = folder, fmt
        self._read: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self._reader.schema(RAW[name]).format(self._fmt).load(f"{self._folder}/{name}")
        return self._read[name]

    def __iter__(self) -> Iterator[str]:
        return iter(RAW)

    def __len__(self) -> int:
        return len(RAW)


def read_raw(spark: SparkSession, folder: str, fmt: str = "parquet") -> RawTables:
    """Raw tables with their fixed schema; nothing is inferred."""
    return RawTables(spark, folder, fmt)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table."""
    frames = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
              for name, df in tables.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def table_digests(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, rows, digest): two copies of a table agree in both if they hold the same rows, in any order.

    A row counts as its values in text, a missing one as ``-``; the digest adds up the first 32 bits of the rows' MD5.
    """
    frames = []
    for name, df in tables.items():
        text = F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-")) for c in df.columns])
        part = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
        frames.append(df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(part), F.lit(0)).cast("bigint").alias("digest")).select(
            F.lit(name).alias("table_name"), "rows", "digest"))
    return reduce(DataFrame.unionByName, frames)


def write_csv_snapshot(tables: Mapping[str, DataFrame], folder: str) -> None:
    """One CSV folder with header per table (split into many files when large)."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def write_json(df: DataFrame, folder: str) -> None:
    """Nested rows (ground truth, evaluation results) as JSON lines."""
    df.write.mode("overwrite").json(folder)


def append_run(df: DataFrame, folder: str, run_id: int) -> None:
    """Write one run into a history partitioned by run; a run that is repeated replaces itself."""
    df.write.mode("overwrite").parquet(f"{folder}/run_id={run_id}")


def replace_table(df: DataFrame, folder: str) -> None:
    """Replace the whole table, for edge sets and link tables rebuilt on every ingestion."""
    df.write.mode("overwrite").parquet(folder)


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], keep_missing: bool = True) -> DataFrame:
    """Merge ``new`` into ``old`` by natural key.

    New values win. Rows that disappeared stay with ``is_active`` false (or vanish when
    ``keep_missing`` is off).
    """
    values = [c for c in new.columns if c not in key]
    # Columns that the new rows lack keep their old values.
    rest = [c for c in old.columns if c not in new.columns and c != "is_active"]
    left = old.select(*key, *rest, *[F.col(c).alias(f"_old_{c}") for c in values if c in old.columns])
    fresh = new.withColumn("_new", F.lit(True))
    joined = left.join(fresh, list(key), "full")

    def merged(name: str) -> Column:
        if name not in old.columns:
            return F.col(name)
        return F.when(F.col("_new"), F.col(name)).otherwise(F.col(f"_old_{name}")).alias(name)

    out = joined.select(*key, *[merged(c) for c in values], *rest, F.coalesce("_new", F.lit(False)).alias("is_active"))
    return out if keep_missing else out.filter("is_active")


def split_columns(df: DataFrame, catalogued: Sequence[str]) -> tuple[list[str], list[str]]:
    """Catalogued columns that exist in the table, and those that are missing."""
    have = set(df.columns)
    return [c for c in catalogued if c in have], [c for c in catalogued if c not in have]


def columns_frame(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """(asset, column_name, ordinal, data_type) of live tables."""
    rows = [(name, f.name, i, f.dataType.simpleString())
            for name, df in tables.items() for i, f in enumerate(df.schema, start=1)]
    return spark.createDataFrame(rows, "asset string, column_name string, ordinal int, data_type string")
