"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.decontaminate import find_items
from plumbline.llm.divergence import audit, audit_sql
from plumbline.llm.grading import grade_documents
from plumbline.llm.html import extract
from plumbline.llm.jaccard import similar_components
from plumbline.llm.language import identify
from plumbline.llm.lattice import near_vectors
from plumbline.llm.lines import without_boilerplate, without_boilerplate_sql
from plumbline.llm.packing import pack
from plumbline.llm.repeats import repeated_passages
from plumbline.llm.search import search, search_sql
from plumbline.llm.secrets import find_secrets
from plumbline.llm.toxicity import score_documents
from plumbline.session import tune


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{folder}/{name}.parquet")


def op1_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    return extract(_table(spark, folder, "pages"))


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """A toxicity score of every document; one in four documents is held out from learning."""
    return score_documents(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document; one in five documents is held out from learning."""
    return identify(_table(spark, folder, "documents"))


def op4_line_spread(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the lines that stand on ten sites or more."""
    return without_boilerplate(_table(spark, folder, "documents")).select("doc_id", "text", "n_removed")


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents cut into pieces and packed into batches of like length."""
    return pack(_table(spark, folder, "documents"))


def op6_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles have a Jaccard similarity of 0.85 or more."""
    return similar_components(_table(spark, folder, "documents"), size=4, percent=85)


def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document."""
    return find_secrets(_table(spark, folder, "documents"))


def op8_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of 50 words and more that stand in more than one document."""
    return repeated_passages(_table(spark, folder, "documents"))


def op9_benchmark_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items found in documents, as exact or edited copies."""
    return find_items(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op10_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Components of embeddings with a cosine of 0.95 or more."""
    return near_vectors(_table(spark, folder, "embeddings"))


def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Divergence of every pair of sources of a language, and the terms that set a source apart."""
    return audit(_table(spark, folder, "documents"))


def op12_quality(spark: SparkSession, folder: str) -> DataFrame:
    """A quality score of every document; one in three documents is held out from learning."""
    return grade_documents(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best documents for every benchmark item."""
    return search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_main_text, op2_toxicity, op3_language, op4_line_spread, op5_packing, op6_ngram_jaccard, op7_secrets,
        op8_repeated_passages, op9_benchmark_copies, op10_near_vectors, op11_source_divergence,
        op12_quality, op13_ranked_search)}


def oracle_sql() -> dict[str, str]:
    return {"op4_line_spread": without_boilerplate_sql(), "op11_source_divergence": audit_sql(), "op13_ranked_search": search_sql()}
