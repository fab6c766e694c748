"""Read transformation-project artifacts (manifest, catalog and run results as JSON) into metadata tables.

Every function takes a DataFrame with one JSON document per row in ``text`` and an optional ``project``
column, so many projects are read in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.profile import sla_hours

_META = "map<string,string>"
_COLUMN = f"struct<name:string,description:string,data_type:string,meta:{_META},config:struct<meta:{_META}>>"
_FRESH = "struct<warn_after:struct<count:double,period:string>>"
_CONFIG = f"struct<meta:{_META},materialized:string,severity:string,freshness:{_FRESH}>"
_NODE = ("struct<resource_type:string,name:string,identifier:string,fqn:array<string>,description:string,"
         "database:string,schema:string,relation_name:string,loaded_at_field:string,tags:array<string>,"
         f"meta:{_META},config:{_CONFIG},freshness:{_FRESH},columns:map<string,{_COLUMN}>,"
         "depends_on:struct<nodes:array<string>>,compiled_code:string,type:string,url:string,"
         "test_metadata:struct<name:string>,column_name:string,attached_node:string>")
MANIFEST = f"struct<sources:map<string,{_NODE}>,nodes:map<string,{_NODE}>,exposures:map<string,{_NODE}>>"
_CATALOG_NODE = "struct<columns:map<string,struct<type:string,`index`:int>>>"
CATALOG = f"struct<nodes:map<string,{_CATALOG_NODE}>,sources:map<string,{_CATALOG_NODE}>>"
RESULTS = ("struct<metadata:struct<generated_at:string>,"
           "results:array<struct<unique_id:string,status:string,failures:bigint>>>")

# What metadata may say.
CRITICALITIES = ("low", "medium", "high", "critical")
CATEGORIES = ("identifier", "customer_identifier", "financial", "status", "temporal")
ALLOWED_KEYS = {
    "source": ("owner", "domain", "criticality", "source_system", "source_object", "contains_pii"),
    "model": ("owner", "domain", "criticality", "primary_key", "freshness_column", "freshness_sla_hours",
              "loaded_at_column", "contains_pii"),
    "exposure": ("owner", "criticality", "audience", "financial_reporting", "customer_facing"),
    "column": ("critical", "cde_category", "critical_reason", "pii"),
}
LAYER_OF_FOLDER = {"staging": "staging", "intermediate": "intermediate", "marts": "mart"}
FINANCIAL_DOMAINS = ("finance", "executive")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON file: (project, text)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("project"), F.col("value").alias("text"))


def _merged(*maps: Column) -> Column:
    """Merge metadata maps; later ones win."""
    def overlay(base: Column, late: Column) -> Column:
        kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(late, k))
        return F.map_concat(kept, late)

    out = F.create_map().cast(_META)
    for m in maps:
        out = overlay(out, F.coalesce(m, F.create_map().cast(_META)))
    return out


def _flag(meta: Column, key: str) -> Column:
    return F.coalesce(meta[key] == "true", F.lit(False))


def _entries(documents: DataFrame, schema: str, field: str) -> DataFrame:
    parsed = documents.select("project", F.from_json("text", schema).alias("doc"))
    return parsed.select("project", F.explode(f"doc.{field}").alias("unique_id", "node"))


def _text(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " "))


def nodes(documents: DataFrame) -> DataFrame:
    """Sources, models and exposures with merged metadata: (project, unique_id, kind, node, meta).

    The three are read from a document together, so that it is parsed once.
    """
    def listed(field: str, kind: str) -> Column:
        entries = F.map_entries(f"doc.{field}")
        if kind == "model":
            entries = F.filter(entries, lambda e: e["value"]["resource_type"] == "model")
        return F.coalesce(F.transform(entries, lambda e: F.struct(
            e["key"].alias("unique_id"), F.lit(kind).alias("kind"), e["value"].alias("node"))), F.array())

    parsed = documents.select("project", F.from_json("text", MANIFEST).alias("doc"))
    every = parsed.select("project", F.explode(F.concat(
        listed("sources", "source"), listed("nodes", "model"), listed("exposures", "exposure"))).alias("entry"))
    return every.select("project", "entry.unique_id", "entry.kind", "entry.node").withColumn(
        "meta", _merged(F.col("node.meta"), F.col("node.config.meta")))


def _layer(kind: Column, fqn: Column) -> Column:
    folder = F.when(F.size(fqn) > 2, fqn[1])
    model = None
    for name, layer in LAYER_OF_FOLDER.items():
        model = F.when(folder == name, layer) if model is None else model.when(folder == name, layer)
    return F.when(kind == "source", "raw").when(kind == "exposure", "exposure").otherwise(model)


def assets(documents: DataFrame) -> DataFrame:
    """One row per asset. An exposure takes the domain of its first input."""
    every = nodes(documents)
    meta, kind = F.col("meta"), F.col("kind")
    fresh = F.coalesce(F.col("node.freshness.warn_after"), F.col("node.config.freshness.warn_after"))
    domain = F.coalesce(meta["domain"], F.when(kind == "source", "platform").when(kind == "model", "unknown"))
    hours = F.when(kind == "source", sla_hours(fresh["count"], fresh["period"])).when(
        kind == "model", meta["freshness_sla_hours"].cast("int"))
    out = every.select(
        "project", "unique_id", F.coalesce("node.identifier", "node.name").alias("asset"), kind.alias("asset_type"),
        _layer(kind, F.col("node.fqn")).alias("layer"), domain.alias("domain"), meta["owner"].alias("owner"),
        F.when(meta["criticality"].isin(*CRITICALITIES), meta["criticality"]).otherwise("medium").alias("criticality"),
        _text(F.col("node.description")).alias("description"),
        F.col("node.config.materialized").alias("materialization"), meta["audience"].alias("audience"),
        _flag(meta, "financial_reporting").alias("_fin"), _flag(meta, "customer_facing").alias("is_customer_facing"),
        _flag(meta, "contains_pii").alias("contains_pii"), hours.alias("freshness_sla_hours"),
        F.coalesce(F.col("node.loaded_at_field"), meta["freshness_column"]).alias("freshness_column"),
        meta["source_system"].alias("source_system"),
        F.coalesce(F.from_json(meta["primary_key"], "array<string>"), F.array().cast("array<string>"))
        .alias("primary_key"),
        F.array_min("node.depends_on.nodes").alias("_first_input"))
    inputs = out.select("project", F.col("unique_id").alias("_first_input"), F.col("domain").alias("_input_domain"))
    joined = out.join(inputs, ["project", "_first_input"], "left")
    is_output = F.col("asset_type") == "exposure"
    final_domain = F.when(is_output, F.coalesce("_input_domain", F.lit("unknown"))).otherwise(F.col("domain"))
    financial = F.when(is_output, F.col("_fin")).when(
        F.col("asset_type") == "model", F.col("domain").isin(*FINANCIAL_DOMAINS)).otherwise(False)
    return joined.withColumns({"domain": final_domain, "is_financial": financial}).drop(
        "_fin", "_first_input", "_input_domain")


def dependencies(documents: DataFrame) -> DataFrame:
    """(project, upstream, downstream, dependency_type) by unique id."""
    every = nodes(documents).filter("kind <> 'source'")
    up = F.explode(F.array_distinct("node.depends_on.nodes")).alias("upstream")
    pairs = every.select("project", up, F.col("unique_id").alias("downstream"), "kind")
    kind = F.when(F.col("kind") == "exposure", "exposure").when(
        F.col("upstream").startswith("source."), "source").otherwise("ref")
    return pairs.select("project", "upstream", "downstream", kind.alias("dependency_type"))


def texts(documents: DataFrame) -> DataFrame:
    """(project, asset, text): the compiled text of each model, NULL when there is none."""
    return nodes(documents).select("project", F.col("unique_id").alias("asset"), F.when(
        F.col("kind") == "model", F.col("node.compiled_code")).alias("text"))


def columns(documents: DataFrame, catalogs: DataFrame | None = None) -> DataFrame:
    """One row per column. A catalogued type wins over the declared one, catalogued order comes first."""
    every = nodes(documents).filter("kind <> 'exposure'")
    declared = every.select("project", "unique_id", F.posexplode_outer(F.map_entries("node.columns")).alias(
        "place", "entry")).filter("entry IS NOT NULL").select(
        "project", "unique_id", "place", F.col("entry.key").alias("column_name"), F.col("entry.value").alias("doc"))
    if catalogs is None:
        both = declared.withColumns({"catalog_type": F.lit(None).cast("string"), "index": F.lit(None).cast("int")})
    else:
        parsed = catalogs.select("project", F.from_json("text", CATALOG).alias("c"))
        seen = parsed.select("project", F.explode("c.nodes").alias("unique_id", "n")).unionByName(
            parsed.select("project", F.explode("c.sources").alias("unique_id", "n")))
        typed = seen.select("project", "unique_id", F.explode("n.columns").alias("column_name", "t")).select(
            "project", "unique_id", "column_name", F.col("t.type").alias("catalog_type"), F.col("t.index").alias("index"))
        known = every.select("project", "unique_id")
        both = declared.join(typed.join(known, ["project", "unique_id"], "left_semi"),
                             ["project", "unique_id", "column_name"], "full")
    order = F.array_sort(F.collect_list(F.struct(
        F.col("index").isNull().alias("late"), "index", "place", "column_name", "catalog_type", "doc_text")))
    # Columns of one asset form one small group; the doc goes along as JSON because maps do not sort.
    listed = both.withColumn("doc_text", F.to_json("doc")).groupBy("project", "unique_id").agg(order.alias("cols"))
    flat = listed.select("project", "unique_id", F.posexplode("cols").alias("pos", "c")).select(
        "project", "unique_id", (F.col("pos") + 1).alias("ordinal"), "c.column_name", "c.catalog_type",
        F.from_json("c.doc_text", _COLUMN).alias("doc"))
    meta = _merged(F.col("doc.meta"), F.col("doc.config.meta"))
    critical = _flag(F.col("meta"), "critical")
    return flat.withColumn("meta", meta).select(
        "project", "unique_id", "column_name", "ordinal",
        F.coalesce("catalog_type", "doc.data_type").alias("data_type"), _text(F.col("doc.description"))
        .alias("description"), critical.alias("is_critical"),
        F.when(critical, F.col("meta")["cde_category"]).alias("category"),
        _flag(F.col("meta"), "pii").alias("contains_pii"), F.map_keys("meta").alias("meta_keys"))


def _unknown(keys: Column, allowed: Column) -> Column:
    """The problem of unknown keys, NULL if there are none."""
    extra = F.array_sort(F.array_except(keys, allowed))
    return F.when(F.size(extra) > 0, F.concat(F.lit("unknown keys "), F.array_join(extra, ",")))


def problems(documents: DataFrame, catalogs: DataFrame | None = None) -> DataFrame:
    """(project, unique_id, problem): unknown metadata keys, bad criticality, category or layer.

    One pass looks for all problems of the nodes, another for all those of their columns.
    """
    every, kind = nodes(documents), F.col("kind")
    allowed = {k: F.array(*map(F.lit, keys)) for k, keys in ALLOWED_KEYS.items()}
    unknown = F.coalesce(*[F.when(kind == k, _unknown(F.map_keys("meta"), keys)) for k, keys in allowed.items() if k != "column"])
    level = F.coalesce(F.col("meta")["criticality"], F.lit("medium"))
    bad_level = F.when(~level.isin(*CRITICALITIES), F.concat(F.lit("bad criticality "), level))
    outside = F.when((kind == "model") & _layer(kind, F.col("node.fqn")).isNull(), "model outside the layer folders")
    of_nodes = every.select("project", "unique_id", F.explode(F.array_compact(F.array(unknown, bad_level, outside))).alias("problem"))
    missing = F.col("category").isNull() | ~F.col("category").isin(*CATEGORIES)
    uncategorised = F.when(F.col("is_critical") & missing, "critical column without a category")
    of_columns = columns(documents, catalogs).select(
        "project", F.concat("unique_id", F.lit("."), "column_name").alias("unique_id"),
        F.explode(F.array_compact(F.array(_unknown(F.col("meta_keys"), allowed["column"]), uncategorised))).alias("problem"))
    return of_nodes.unionByName(of_columns)


def tests(documents: DataFrame, build_results: DataFrame | None = None,
          run_results: DataFrame | None = None) -> DataFrame:
    """Declared tests with their latest outcome; build results come first, run results where a project has none."""
    declared = _entries(documents, MANIFEST, "nodes").filter("node.resource_type = 'test'").select(
        "project", "unique_id", F.coalesce("node.attached_node", F.try_element_at("node.depends_on.nodes", F.lit(1)))
        .alias("attached_to"), F.col("node.column_name").alias("column_name"),
        F.coalesce("node.test_metadata.name", "node.name").alias("test_name"),
        F.lower(F.coalesce("node.config.severity", F.lit("error"))).alias("severity"))

    def outcomes(frame: DataFrame) -> DataFrame:
        parsed = frame.select("project", F.from_json("text", RESULTS).alias("r"))
        return parsed.select("project", F.col("r.metadata.generated_at").alias("executed_at"),
                             F.explode("r.results").alias("x")).filter(
            F.col("x.unique_id").startswith("test.")).select(
            "project", "x.unique_id", "x.status", "x.failures", "executed_at")

    ran = None
    if build_results is not None:
        ran = outcomes(build_results)
    if run_results is not None:
        later = outcomes(run_results)
        ran = later if ran is None else ran.unionByName(
            later.join(ran.select("project").distinct(), "project", "left_anti"))
    if ran is None:
        return declared.selectExpr("*", "CAST(NULL AS STRING) AS status", "CAST(NULL AS BIGINT) AS failures",
                                   "CAST(NULL AS STRING) AS executed_at")
    return declared.join(ran, ["project", "unique_id"], "left")
