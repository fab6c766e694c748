"""Shared pieces of the query suite: table access and engine-neutral output columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.plans.marts import Models
from plumbline.plans.staging import stage_all
from plumbline.session import PACKED, shared_folder, tune
from plumbline.sources.driver_tables import CUTOFF_DATE, INPUTS, driver_table, raw_table
from plumbline.sources.schemas import RAW, STAGING
from plumbline.sources.tables import RawTables, write_tables

# Tables whose rows belong to labelled cases.
CASED = ("orders", "order_items", "payments", "refunds", "customers", "subscriptions", "tickets")

# Folder of the raw tables landed as parquet and the names of those that are, per application and source folder.
_LANDED: dict[tuple[str, str], tuple[str, set[str]]] = {}


def _place(spark: SparkSession, folder: str) -> tuple[str, set[str]]:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _LANDED:
        _LANDED[key] = (shared_folder(spark), set())
    return _LANDED[key]


def landed(spark: SparkSession, folder: str, *names: str) -> str:
    """Derive raw tables (all, if none is named) once per session and keep them as parquet in the shared folder.

    Checks run on loaded tables: without landing, each of the rules would derive its inputs again. A table is landed when it
    is first asked for, so that a query over one table does not wait for the others.
    """
    target, have = _place(spark, folder)
    wanted = [name for name in names or RAW if name not in have]
    facts = "order_facts"
    if facts not in have and any(facts in INPUTS[name] for name in wanted):
        raw_table(spark, folder, facts).write.mode("overwrite").option("compression", PACKED).parquet(f"{target}/{facts}")
        have.add(facts)
    ready = {facts: spark.read.parquet(f"{target}/{facts}")} if facts in have else {}
    # Readers with the fixed schema do not see the key.
    write_tables({name: raw_table(spark, folder, name, ready, ("case_key",) if name in CASED else ()) for name in wanted}, target)
    have.update(wanted)
    return target


class _OnDemand(RawTables):
    """Raw tables that are landed when they are first asked for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        super().__init__(spark, _place(spark, folder)[0], "parquet")
        self._of = spark, folder

    def __getitem__(self, name: str) -> DataFrame:
        if name not in RAW:
            raise KeyError(name)
        landed(*self._of, name)
        return super().__getitem__(name)


def plain(df: DataFrame) -> DataFrame:
    """Column types every engine prints alike: BIGINT, DOUBLE, BOOLEAN and text."""
    columns = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        kind = f.dataType
        if isinstance(kind, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(kind, T.ArrayType):
            c = F.array_join(F.transform(c, lambda v: v.cast("string")), ",", "null")
        columns.append(c.alias(f.name))
    return df.select(*columns)


class Bed:
    """The driver tables seen as raw, staging and modelled commerce tables."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = tune(spark)
        self.folder = folder
        self._staging: dict[str, DataFrame] | None = None
        self._models: Models | None = None

    def source(self, name: str) -> DataFrame:
        return driver_table(self.spark, self.folder, name)

    def derived(self, name: str) -> DataFrame:
        """A raw table as a lazy derivation, without landing it."""
        return raw_table(self.spark, self.folder, name)

    def land(self) -> Bed:
        """Land all raw tables side by side, for queries that read most of them."""
        landed(self.spark, self.folder)
        return self

    def all_raw(self) -> RawTables:
        return _OnDemand(self.spark, self.folder)

    def keyed(self, name: str) -> DataFrame:
        """A raw table with the undamaged key of the case that each row belongs to."""
        return self.spark.read.parquet(f"{landed(self.spark, self.folder, name)}/{name}")

    def raw(self, name: str) -> DataFrame:
        return self.all_raw()[name]

    def stg(self, name: str) -> DataFrame:
        return self.staging[f"stg_{name}"]

    @property
    def staging(self) -> dict[str, DataFrame]:
        if self._staging is None:
            self._staging = stage_all(self.all_raw())
        return self._staging

    def models_keeping(self, *names: str) -> Models:
        """Models of which some are written once because the query reads them several times."""
        return Models(self.staging, CUTOFF_DATE, names)

    @property
    def models(self) -> Models:
        if self._models is None:
            self._models = Models(self.staging, CUTOFF_DATE)
        return self._models


_SQL_KIND = {"integer": "BIGINT", "number": "DOUBLE", "text": "VARCHAR", "boolean": "BOOLEAN"}
_KIND = {"string": "text", "boolean": "boolean", "int": "integer", "bigint": "integer", "double": "number"}


def sql_plain(columns: Iterable[tuple[str, str]]) -> str:
    """Select list casting (name, kind) columns for the checker."""
    return ", ".join(f"CAST({name} AS {_SQL_KIND[kind]}) AS {name}" for name, kind in columns)


def struct_plain(schema: T.StructType) -> str:
    """The same select list derived from a declared schema."""
    def kind(t: T.DataType) -> str:
        text = t.simpleString()
        return "number" if text.startswith("decimal") else _KIND.get(text, "text")
    return sql_plain((f.name, kind(f.dataType)) for f in schema)


def staging_oracle(table: str) -> str:
    from plumbline.plans.model_sql import with_models
    return with_models(f"SELECT {struct_plain(STAGING[table])} FROM {table}")
