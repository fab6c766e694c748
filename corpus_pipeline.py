"""A corpus pipeline of the training-data operators: documents in, packed pieces out.

Each stage takes what the one before kept, as Parquet. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.decontaminate import without_items
from plumbline.llm.jaccard import one_of_each
from plumbline.llm.language import UNKNOWN, fit, held_out, predict
from plumbline.llm.lines import without_boilerplate
from plumbline.llm.packing import pack
from plumbline.session import checkpoint, tune

#: A text is rejected if no language has at least this posterior.
LEAST_POSTERIOR = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. Null texts, texts without letters and undecided ones go.

    A missing ``lang`` is filled in; a given one stays as it is.
    """
    tune(spark)
    model = fit(docs.where(~held_out(F.col("doc_id"), 5, 0)))
    named = predict(docs, model, tuple(docs.columns)).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_POSTERIOR))
    return named.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without cross-site boilerplate lines, unless it has no other; ``n_chars`` follows the text."""
    tune(spark)
    return without_boilerplate(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group linked by a Jaccard similarity of 0.8 on 5-word shingles."""
    tune(spark)
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no exact or edited copy of a benchmark item."""
    tune(spark)
    return without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in batches of like length."""
    tune(spark)
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Language model, alignment and components are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return docs
