"""Queries: raw tables, staging projections, intermediate models and marts."""

from __future__ import annotations

from plumbline.plans.model_columns import MODEL_COLUMNS
from plumbline.plans.model_sql import with_models
from plumbline.sources.schemas import STAGING
from plumbline.suite.common import Bed, plain, sql_plain, staging_oracle

QUERIES = {}
ORACLE = {}


def _register() -> None:
    for i, table in enumerate(STAGING, start=1):
        name = f"t{i}_{table}"
        QUERIES[name] = lambda spark, folder, t=table: plain(Bed(spark, folder).stg(t[4:]))
        ORACLE[name] = staging_oracle(table)
    for i, (model, columns) in enumerate(MODEL_COLUMNS.items(), start=1):
        name = f"m{i}_{model}"
        QUERIES[name] = lambda spark, folder, m=model: plain(Bed(spark, folder).models[m])
        ORACLE[name] = with_models(f"SELECT {sql_plain(columns)} FROM {model}")


_register()
