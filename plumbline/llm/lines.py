"""Cross-site boilerplate lines, by the spread of each line over sites.

Every distinct line gets a HyperLogLog sketch of its sites, merged by aggregation. Lines whose estimate is clearly above
the threshold are boilerplate; those near it get an exact distinct count; the others stay. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import checkpoint

#: Sites on which a line must stand to be boilerplate.
LEAST_SITES = 10
#: Estimates within this share of the threshold (two sites at least) are counted exactly; the sketches' error is 1.6 %.
MARGIN = 0.1
SKETCH_BITS = 12


def _lines(docs: DataFrame, *columns: Column) -> DataFrame:
    return (docs.select(*columns, F.explode(F.split("text", "\n")).alias("raw"))
            .select(*(c for c in docs.select(*columns).columns), F.trim("raw").alias("line")).where("line <> ''")
            .withColumn("line", F.xxhash64("line")))


def spread_lines(docs: DataFrame, least: int = LEAST_SITES) -> DataFrame:
    """``(line)``: hashes of the trimmed lines of ``docs(text, source)`` that stand on at least ``least`` sites.

    A null site counts for none. Blank lines never count.
    """
    lines = _lines(docs, F.col("source"))
    near = max(2, round(MARGIN * least))
    sketched = checkpoint(lines.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("source", SKETCH_BITS)).alias("sites"))
                          .where(F.col("sites") >= least - near))
    close = sketched.where(F.col("sites") < least + near).select("line")
    exact = lines.join(close, "line", "left_semi").groupBy("line").agg(F.count_distinct("source").alias("n")).where(F.col("n") >= least)
    return sketched.where(F.col("sites") >= least + near).select("line").unionByName(exact.select("line"))


def _free(docs: DataFrame, *names: str) -> list[str]:
    """These names, lengthened until no column of ``docs`` has them."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def without_boilerplate(docs: DataFrame, least: int = LEAST_SITES) -> DataFrame:
    """``docs(text, source, ...)`` without boilerplate lines, and ``n_removed``, the number of lines taken out.

    Lines are cut at line feeds and compared without spaces around them. All rows and other columns stay, but a given
    ``n_removed`` is replaced; null and empty texts are unchanged with 0 removed. A text without any line of its own is a
    widely copied page and unchanged too. Equal texts are treated alike, so repeated rows and ids do no harm.
    """
    tid, bad_lines, kept_lines = _free(docs, "_tid", "_bad", "_kept")
    spread = checkpoint(spread_lines(docs, least))
    bad = _lines(docs.select("text"), F.xxhash64("text").alias(tid)).join(spread, "line").groupBy(tid).agg(F.collect_set("line").alias(bad_lines))
    parts = F.split("text", "\n")
    kept = F.when(F.col(bad_lines).isNotNull(), F.filter(parts, lambda x: ~F.array_contains(bad_lines, F.xxhash64(F.trim(x)))))
    cut = docs.withColumn(tid, F.xxhash64("text")).join(bad, tid, "left").withColumn(kept_lines, kept)
    # Null where no line goes, false where no other line is left.
    some = F.coalesce(F.exists(kept_lines, lambda x: F.trim(x) != ""), F.lit(False))
    removed = F.when(some, F.size(parts) - F.size(kept_lines)).otherwise(0).cast("int").alias("n_removed")
    text = F.when(some, F.array_join(kept_lines, "\n")).otherwise(F.col("text")).alias("text")
    return cut.select(*(text if c == "text" else c for c in docs.columns if c != "n_removed"), removed)


def without_boilerplate_sql(least: int = LEAST_SITES) -> str:
    return f"""
WITH lines AS (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents),
spread AS (SELECT trim(line) AS line FROM lines WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT source) >= {least}),
bad AS (SELECT coalesce(list(line), []) AS bad FROM spread),
cut AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts,
               list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(bad, trim(x))) AS kept FROM documents, bad),
put AS (SELECT *, list_aggregate(kept, 'string_agg', chr(10)) AS joined FROM cut),
new AS (SELECT *, text IS NULL OR len(list_filter(kept, lambda x: trim(x) <> '')) = 0 AS whole FROM put)
SELECT doc_id, CASE WHEN whole THEN text ELSE coalesce(joined, '') END AS text,
       CAST(CASE WHEN whole THEN 0 ELSE len(parts) - len(kept) END AS INTEGER) AS n_removed
FROM new"""
