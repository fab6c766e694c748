"""Typed staging layer: one projection per raw table, 1:1 so that defects stay visible."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.sources.schemas import STAGING

# Columns whose text is normalised, and columns that get a new name.
_LOWER = {("orders", "order_status"), ("payments", "payment_status"), ("subscriptions", "subscription_status")}
_UPPER = {("customers", "country_code"), ("orders", "currency"), ("payments", "currency")}
_SOURCE_NAME = {("customers", "signed_up_at"): "signup_at", ("products", "list_price"): "unit_price"}


def _monthly_amount():
    """Price per month; a biweekly plan bills 26 times a year."""
    price = F.col("price_per_cycle").cast("decimal(10,2)")
    monthly = F.when(F.col("billing_interval") == "biweekly", price * 26 / 12).otherwise(price)
    return F.round(monthly, 2)


def _column(table: str, name: str):
    if (table, name) == ("subscriptions", "monthly_amount"):
        return _monthly_amount()
    if name == "loaded_at":
        return F.col("_loaded_at")
    source = F.col(_SOURCE_NAME.get((table, name), name))
    if (table, name) == ("customers", "email"):
        return F.lower(F.trim(source))
    if (table, name) in _LOWER:
        return F.lower(source)
    if (table, name) in _UPPER:
        return F.upper(source)
    return source


def stage(table: str, raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Project one raw table onto its staging contract; a missing column or bad type is an error.

    ``keep`` names columns outside the contract that go along.
    """
    contract = STAGING[f"stg_{table}"]
    typed = raw.select(*[_column(table, f.name).cast(f.dataType).alias(f.name) for f in contract], *keep)
    enforce(typed.drop(*keep), f"stg_{table}")
    return typed


def enforce(df: DataFrame, contract: str) -> DataFrame:
    """Check names and types against the declared contract."""
    declared = STAGING[contract]
    have = df.columns
    missing = [f.name for f in declared if f.name not in have]
    extra = [c for c in have if c not in declared.names]
    if missing or extra:
        raise ValueError(f"{contract}: missing columns {missing}, unexpected columns {extra}")
    actual = df.schema
    wrong = [f.name for f in declared if actual[f.name].dataType != f.dataType]
    if wrong:
        raise ValueError(f"{contract}: wrong column types {wrong}")
    return df if have == declared.names else df.select(*declared.names)


class Staging(Mapping[str, DataFrame]):
    """All staging tables, each projected when first asked for."""

    def __init__(self, raw: Mapping[str, DataFrame]) -> None:
        self._raw = raw
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            if name not in STAGING:
                raise KeyError(name)
            self._built[name] = stage(name.removeprefix("stg_"), self._raw[name.removeprefix("stg_")])
        return self._built[name]

    def __contains__(self, name: object) -> bool:
        return name in STAGING

    def __iter__(self) -> Iterator[str]:
        return iter(STAGING)

    def __len__(self) -> int:
        return len(STAGING)


def stage_all(raw: Mapping[str, DataFrame]) -> Staging:
    return Staging(raw)
