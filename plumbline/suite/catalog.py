"""Queries: artifact parsing, catalogue, glossary and search, over documents and metadata that Spark derives
from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import catalog as C
from plumbline.sources import artifacts as A
from plumbline.suite.common import Bed, plain

QUERIES = {}
ORACLE = {}


def _add(name, run, sql=None):
    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = sql


# ------------------------------------------------------------------ project documents

# Fifty customers make one project: each is a raw source and a staging model, ten feed one mart, and one output
# reads the project's first mart.
_DOCUMENTS = """
WITH c AS (SELECT c_custkey AS k, CAST(c_custkey DIV 50 AS STRING) AS p, c_name, c_acctbal FROM {customer}),
entry AS (
  SELECT p, 'sources' AS section, 'source.raw_' || k AS uid, named_struct(
    'resource_type', 'source', 'name', 'raw_' || k, 'identifier', 'raw_' || k, 'fqn', array('project'),
    'description', '  raw   table of ' || c_name || ' ',
    'meta', map('owner', 'team' || (k % 7), 'domain', 'domain' || (k % 4), 'criticality',
                CASE k % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' WHEN 3 THEN 'critical' ELSE 'odd' END),
    'config', named_struct('meta', map('source_system', 'system' || (k % 3), 'contains_pii', CAST(k % 10 = 0 AS STRING)),
                           'materialized', CAST(NULL AS STRING), 'severity', CAST(NULL AS STRING)),
    'freshness', named_struct('warn_after', named_struct('count', CAST(CASE WHEN k % 4 > 0 THEN k % 30 END AS DOUBLE),
                              'period', CASE k % 3 WHEN 0 THEN 'hour' WHEN 1 THEN 'day' ELSE 'minute' END)),
    'columns', map('id', named_struct('name', 'id', 'data_type', 'text', 'meta', map('critical', 'true', 'cde_category',
                                      'identifier')),
                   'balance', named_struct('name', 'balance', 'data_type', 'numeric', 'meta', map('pii', 'true'))),
    'depends_on', named_struct('nodes', CAST(array() AS array<string>)), 'compiled_code', CAST(NULL AS STRING),
    'column_name', CAST(NULL AS STRING), 'attached_node', CAST(NULL AS STRING)) AS node FROM c
  UNION ALL
  SELECT p, 'nodes', 'model.stg_' || k, named_struct(
    'resource_type', 'model', 'name', 'stg_' || k, 'identifier', CAST(NULL AS STRING),
    'fqn', array('project', CASE WHEN k % 41 = 0 THEN 'elsewhere' ELSE 'staging' END, 'stg_' || k),
    'description', 'staged ' || c_name,
    'meta', CASE WHEN k % 23 = 0 THEN map('owner', 'team' || (k % 7), 'colour', 'red') ELSE map('owner', 'team' || (k % 7)) END,
    'config', named_struct('meta', map('domain', CASE WHEN k % 6 = 0 THEN 'finance' ELSE 'sales' END, 'freshness_sla_hours',
                           CAST(k % 48 AS STRING)), 'materialized', 'view', 'severity', CAST(NULL AS STRING)),
    'freshness', CAST(NULL AS struct<warn_after:struct<count:double,period:string>>),
    'columns', map('id', named_struct('name', 'id', 'data_type', 'text', 'meta', map('critical', 'true', 'cde_category',
                                      CASE WHEN k % 29 = 0 THEN 'unheard' ELSE 'identifier' END))),
    'depends_on', named_struct('nodes', array('source.raw_' || k)),
    'compiled_code', CASE WHEN c_acctbal < 0 THEN 'SELECT id FROM raw' ELSE 'SELECT id, balance FROM raw' END,
    'column_name', CAST(NULL AS STRING), 'attached_node', CAST(NULL AS STRING)) FROM c
  UNION ALL
  SELECT p, 'nodes', 'model.mart_' || (k DIV 10), named_struct(
    'resource_type', 'model', 'name', 'mart_' || (k DIV 10), 'identifier', CAST(NULL AS STRING),
    'fqn', array('project', 'marts', 'mart'), 'description', 'mart', 'meta', map('owner', 'team1', 'domain', 'executive'),
    'config', named_struct('meta', map('criticality', 'critical'), 'materialized', 'table', 'severity', CAST(NULL AS STRING)),
    'freshness', CAST(NULL AS struct<warn_after:struct<count:double,period:string>>),
    'columns', CAST(map() AS map<string,struct<name:string,data_type:string,meta:map<string,string>>>),
    'depends_on', named_struct('nodes', collect_list('model.stg_' || k)), 'compiled_code', 'SELECT 1',
    'column_name', CAST(NULL AS STRING), 'attached_node', CAST(NULL AS STRING)) FROM c GROUP BY p, k DIV 10
  UNION ALL
  SELECT p, 'nodes', 'test.unique_' || k, named_struct(
    'resource_type', 'test', 'name', 'unique_' || k, 'identifier', CAST(NULL AS STRING), 'fqn', array('project'),
    'description', '', 'meta', map(), 'config', named_struct('meta', map(), 'materialized', CAST(NULL AS STRING),
    'severity', CASE WHEN k % 2 = 0 THEN 'WARN' ELSE 'ERROR' END),
    'freshness', CAST(NULL AS struct<warn_after:struct<count:double,period:string>>),
    'columns', CAST(map() AS map<string,struct<name:string,data_type:string,meta:map<string,string>>>),
    'depends_on', named_struct('nodes', array('model.stg_' || k)), 'compiled_code', CAST(NULL AS STRING),
    'column_name', 'id', 'attached_node', 'model.stg_' || k) FROM c
  UNION ALL
  SELECT p, 'exposures', 'exposure.out_' || p, named_struct(
    'resource_type', 'exposure', 'name', 'out_' || p, 'identifier', CAST(NULL AS STRING), 'fqn', array('project'),
    'description', 'output', 'meta', map('owner', 'team2', 'audience', 'finance', 'financial_reporting', 'true'),
    'config', named_struct('meta', map(), 'materialized', CAST(NULL AS STRING), 'severity', CAST(NULL AS STRING)),
    'freshness', CAST(NULL AS struct<warn_after:struct<count:double,period:string>>),
    'columns', CAST(map() AS map<string,struct<name:string,data_type:string,meta:map<string,string>>>),
    'depends_on', named_struct('nodes', array('model.mart_' || min(k DIV 10))), 'compiled_code', CAST(NULL AS STRING),
    'column_name', CAST(NULL AS STRING), 'attached_node', CAST(NULL AS STRING)) FROM c GROUP BY p)
SELECT p AS project, to_json(named_struct(
  'sources', map_from_entries(collect_list(CASE WHEN section = 'sources' THEN struct(uid, node) END)),
  'nodes', map_from_entries(collect_list(CASE WHEN section = 'nodes' THEN struct(uid, node) END)),
  'exposures', map_from_entries(collect_list(CASE WHEN section = 'exposures' THEN struct(uid, node) END)))) AS text
FROM entry GROUP BY p"""


def documents(s, f):
    """One manifest per project; a project holds at most 50 customers."""
    return s.sql(_DOCUMENTS, customer=Bed(s, f).source("customer"))


def catalogs(s, f):
    """Catalog documents: warehouse types of the id columns of every second staging model, plus an extra column."""
    return s.sql("""
        SELECT CAST(k DIV 50 AS STRING) AS project, to_json(named_struct('nodes', map_from_entries(collect_list(struct(
          'model.stg_' || k, named_struct('columns', map('id', named_struct('type', 'varchar', 'index', 2),
          'added', named_struct('type', 'date', 'index', 1)))))))) AS text
        FROM (SELECT c_custkey AS k FROM {customer} WHERE c_custkey % 2 = 0) x GROUP BY k DIV 50""",
                 customer=Bed(s, f).source("customer"))


def _results(s, f, where, status):
    return s.sql(f"""
        SELECT CAST(k DIV 50 AS STRING) AS project, to_json(named_struct('metadata', named_struct('generated_at', '{status}'),
          'results', collect_list(named_struct('unique_id', 'test.unique_' || k, 'status', CASE WHEN k % 9 = 0 THEN '{status}'
          ELSE 'pass' END, 'failures', k % 9)))) AS text
        FROM (SELECT c_custkey AS k FROM {{customer}} WHERE {where}) x GROUP BY k DIV 50""",
                 customer=Bed(s, f).source("customer"))


_C = "(SELECT c_custkey AS k, c_custkey // 50 AS p, c_name, c_acctbal FROM customer)"

_add("s5_assets_from_manifests",
     lambda s, f: plain(A.assets(documents(s, f)).select(
         "project", "unique_id", "asset", "asset_type", "layer", "domain", "owner", "criticality", "description",
         "materialization", "is_financial", "contains_pii", "freshness_sla_hours", "source_system")),
     f"SELECT CAST(p AS VARCHAR) AS project, 'source.raw_' || k AS unique_id, 'raw_' || k AS asset, 'source' AS asset_type, "
     f"'raw' AS layer, 'domain' || (k % 4) AS domain, 'team' || (k % 7) AS owner, CASE k % 5 WHEN 0 THEN 'low' WHEN 2 THEN "
     f"'high' WHEN 3 THEN 'critical' ELSE 'medium' END AS criticality, 'raw table of ' || c_name AS description, "
     f"CAST(NULL AS VARCHAR) AS materialization, FALSE AS is_financial, k % 10 = 0 AS contains_pii, CASE WHEN k % 4 > 0 THEN "
     f"CAST(GREATEST(1, CASE k % 3 WHEN 0 THEN k % 30 WHEN 1 THEN 24 * (k % 30) ELSE round_even((k % 30) / 60.0, 0) END) AS "
     f"BIGINT) END AS freshness_sla_hours, 'system' || (k % 3) AS source_system FROM {_C} AS c "
     f"UNION ALL SELECT CAST(p AS VARCHAR), 'model.stg_' || k, 'stg_' || k, 'model', IF(k % 41 = 0, NULL, 'staging'), "
     f"IF(k % 6 = 0, 'finance', 'sales'), 'team' || (k % 7), 'medium', 'staged ' || c_name, 'view', k % 6 = 0, FALSE, k % 48, "
     f"NULL FROM {_C} AS c UNION ALL SELECT DISTINCT CAST(p AS VARCHAR), 'model.mart_' || (k // 10), 'mart_' || (k // 10), "
     f"'model', 'mart', 'executive', 'team1', 'critical', 'mart', 'table', TRUE, FALSE, CAST(NULL AS BIGINT), NULL FROM {_C} AS c "
     f"UNION ALL SELECT DISTINCT CAST(p AS VARCHAR), 'exposure.out_' || p, 'out_' || p, 'exposure', 'exposure', 'executive', "
     f"'team2', 'medium', 'output', NULL, TRUE, FALSE, CAST(NULL AS BIGINT), NULL FROM {_C} AS c")
_add("s5_dependencies_from_manifests",
     lambda s, f: A.dependencies(documents(s, f)),
     f"SELECT CAST(p AS VARCHAR) AS project, 'source.raw_' || k AS upstream, 'model.stg_' || k AS downstream, 'source' AS "
     f"dependency_type FROM {_C} AS c UNION ALL SELECT CAST(p AS VARCHAR), 'model.stg_' || k, 'model.mart_' || (k // 10), 'ref' "
     f"FROM {_C} AS c UNION ALL SELECT CAST(p AS VARCHAR), 'model.mart_' || MIN(k // 10), 'exposure.out_' || p, 'exposure' "
     f"FROM {_C} AS c GROUP BY p")
_add("s6_columns_merged_with_catalog",
     lambda s, f: plain(A.columns(documents(s, f), catalogs(s, f)).drop("description", "meta_keys")),
     f"SELECT CAST(p AS VARCHAR) AS project, unique_id, column_name, ordinal, data_type, is_critical, category, contains_pii FROM ("
     f"SELECT p, 'source.raw_' || k AS unique_id, unnest(['id', 'balance']) AS column_name, unnest([1, 2]) AS ordinal, "
     f"unnest(['text', 'numeric']) AS data_type, unnest([TRUE, FALSE]) AS is_critical, unnest(['identifier', NULL]) AS category, "
     f"unnest([FALSE, TRUE]) AS contains_pii FROM {_C} AS c UNION ALL SELECT p, 'model.stg_' || k, 'id', IF(k % 2 = 0, 2, 1), "
     f"IF(k % 2 = 0, 'varchar', 'text'), TRUE, IF(k % 29 = 0, 'unheard', 'identifier'), FALSE FROM {_C} AS c UNION ALL "
     f"SELECT p, 'model.stg_' || k, 'added', 1, 'date', FALSE, NULL, FALSE FROM {_C} AS c WHERE k % 2 = 0) AS x")
_add("s7_test_outcomes",
     lambda s, f: plain(A.tests(documents(s, f), _results(s, f, "c_custkey DIV 50 % 2 = 0", "fail"),
                                _results(s, f, "c_custkey % 3 > 0", "warn"))),
     f"SELECT CAST(p AS VARCHAR) AS project, 'test.unique_' || k AS unique_id, 'model.stg_' || k AS attached_to, 'id' AS "
     f"column_name, 'unique_' || k AS test_name, IF(k % 2 = 0, 'warn', 'error') AS severity, CASE WHEN p % 2 = 0 THEN IF(k % 9 = "
     f"0, 'fail', 'pass') WHEN k % 3 > 0 THEN 'pass' END AS status, CASE WHEN p % 2 = 0 OR k % 3 > 0 THEN k % 9 END AS failures, "
     f"CASE WHEN p % 2 = 0 THEN 'fail' WHEN k % 3 > 0 THEN 'warn' END AS executed_at FROM {_C} AS c")
_add("c3_metadata_problems",
     lambda s, f: A.problems(documents(s, f)),
     f"SELECT CAST(p AS VARCHAR) AS project, 'source.raw_' || k AS unique_id, 'bad criticality odd' AS problem FROM {_C} AS c WHERE "
     f"k % 5 = 4 UNION ALL SELECT CAST(p AS VARCHAR), 'model.stg_' || k, 'unknown keys colour' FROM {_C} AS c WHERE k % 23 = 0 "
     f"UNION ALL SELECT CAST(p AS VARCHAR), 'model.stg_' || k, 'model outside the layer folders' FROM {_C} AS c WHERE k % 41 = 0 "
     f"UNION ALL SELECT CAST(p AS VARCHAR), 'model.stg_' || k || '.id', 'critical column without a category' FROM {_C} AS c "
     f"WHERE k % 29 = 0")

# ------------------------------------------------------------------ catalogue of parts, glossary of nations


def _parts(s, f):
    """Parts as assets: (assets, columns, terms, links)."""
    part = Bed(s, f).source("part")
    level = F.when(F.col("p_size") % 4 == 0, "critical").when(F.col("p_size") % 4 == 1, "high").when(
        F.col("p_size") % 4 == 2, "medium").otherwise("low")
    assets = part.select(
        F.concat(F.lit("part_"), "p_partkey").alias("asset"), F.lit("model").alias("asset_type"),
        F.when(F.col("p_size") % 2 == 0, "staging").otherwise("mart").alias("layer"), F.lower("p_type").alias("domain"),
        F.col("p_brand").alias("owner"), level.alias("criticality"),
        F.concat("p_name", F.lit(" of size "), "p_size").alias("description"))
    columns = part.select(F.concat(F.lit("part_"), "p_partkey").alias("asset"), F.explode(
        F.split("p_name", " ")).alias("column_name"))
    terms = part.select(F.lower("p_type").alias("term_key"), F.concat(F.lit("Type "), F.initcap("p_type")).alias("term")).distinct()
    links = part.select(F.lower("p_type").alias("term_key"), F.concat(F.lit("part_"), "p_partkey").alias("asset"))
    return assets, columns, terms, links


_P = ("(SELECT 'part_' || p_partkey AS asset, p_brand AS owner, lower(p_type) AS domain, p_name, p_name || ' of size ' || p_size "
      "AS description, 'Type ' || upper(p_type[1]) || lower(p_type[2:]) AS term, IF(p_size % 2 = 0, 'staging', 'mart') AS layer, "
      "CASE p_size % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS criticality FROM part)")


def _index(s, f):
    assets, columns, terms, links = _parts(s, f)
    return C.search_index(assets, columns, terms, links), assets


_add("c6_search_index",
     lambda s, f: _index(s, f)[0].groupBy("field").agg(F.count(F.lit(1)).alias("values"), F.count_distinct("asset").alias("assets")),
     f"SELECT field, COUNT(*) AS values, COUNT(DISTINCT asset) AS assets FROM (SELECT asset, unnest(['name', 'owner', 'domain', "
     f"'description', 'glossary']) AS field FROM {_P} AS p UNION ALL SELECT asset, 'column' FROM (SELECT asset, unnest("
     f"string_split(p_name, ' ')) FROM {_P} AS p) AS q) AS x GROUP BY field")


def _search_sql(words, where="TRUE"):
    best = [f"CASE WHEN contains(lower(asset), '{w}') THEN 10 WHEN len(list_filter(string_split(lower(p_name), ' '), lambda x: "
            f"contains(x, '{w}'))) > 0 THEN 6 WHEN contains(lower(term), '{w}') THEN 5 WHEN contains(lower(owner), '{w}') OR "
            f"contains(domain, '{w}') THEN 4 WHEN contains(lower(description), '{w}') THEN 2 END * IF(lower(asset) = '{w}', 2, 1)"
            for w in words]
    return (f"SELECT asset, CAST({' + '.join(f'b{i}' for i in range(len(words)))} AS DOUBLE) AS score FROM (SELECT asset, "
            + ", ".join(f"{b} AS b{i}" for i, b in enumerate(best)) + f" FROM {_P} AS p WHERE {where}) AS x WHERE "
            + " AND ".join(f"b{i} IS NOT NULL" for i in range(len(words))))


for _name, _query, _filters, _where in (
    ("c7_search_two_words", "red brand#2", {}, "TRUE"),
    ("c7_search_exact_name", "Part_17", {}, "TRUE"),
    ("c7_search_filtered", "widget, size", {"layer": ["mart"], "criticality": ["critical", "high"]},
     "layer = 'mart' AND criticality IN ('critical', 'high')"),
):
    _add(_name, lambda s, f, q=_query, k=_filters: C.search(*_index(s, f), q, **k).select("asset", "score"),
         _search_sql(_query.lower().replace(",", "").split(), _where))
_add("c8_filter_options",
     lambda s, f: C.filter_options(_parts(s, f)[0], ["layer", "domain", "owner", "criticality"]),
     f"SELECT DISTINCT unnest(['layer', 'domain', 'owner', 'criticality']) AS facet, unnest([layer, domain, owner, criticality]) "
     f"AS value FROM {_P} AS p")


def _terms(s, f):
    """Nations as glossary terms, linked to their customers (a whole customer or its segment)."""
    bed = Bed(s, f)
    regions = bed.source("region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    links = bed.source("customer").select(
        F.col("c_nationkey").alias("n_nationkey"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("cust_"), "c_custkey"))
        .otherwise(F.concat(F.lit("cust_"), "c_custkey", F.lit("."), F.lower("c_mktsegment"))).alias("link"))
    terms = bed.source("nation").join(regions, "n_regionkey").select(
        "n_nationkey", F.concat(F.lit("term_"), "n_nationkey").alias("term_key"), F.col("n_name").alias("term"),
        F.lower("r_name").alias("domain"), F.when(F.col("n_nationkey") % 5 == 0, "deprecated").when(
            F.col("n_nationkey") % 5 == 1, "draft").otherwise("approved").alias("status"),
        F.concat(F.lit("buyers in "), "n_name").alias("definition"),
        F.array(F.concat(F.lit("market"), "n_nationkey")).alias("synonyms"))
    rows = terms.select("n_nationkey", "term_key").join(links, "n_nationkey").select("term_key", F.array("link").alias("links"))
    return terms.drop("n_nationkey"), C.parse_links(rows)


_N = ("(SELECT 'term_' || n_nationkey AS term_key, n_name AS term, lower(r_name) AS domain, CASE n_nationkey % 5 WHEN 0 THEN "
      "'deprecated' WHEN 1 THEN 'draft' ELSE 'approved' END AS status, n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey)")
_LINKS = ("(SELECT 'term_' || c_nationkey AS term_key, 'cust_' || c_custkey AS asset, CASE WHEN c_custkey % 3 <> 0 THEN "
          "lower(c_mktsegment) END AS column_name, c_custkey FROM customer)")

_add("c5_glossary_links", lambda s, f: _terms(s, f)[1],
     f"SELECT term_key, asset, column_name FROM {_LINKS} AS l")
_add("c10_glossary_terms",
     lambda s, f: C.glossary_terms(*_terms(s, f)),
     f"SELECT t.term_key, t.term, t.domain, t.status, COUNT(l.asset) AS link_count, COUNT(DISTINCT l.asset) AS asset_count, "
     f"COUNT(l.column_name) AS column_count FROM {_N} AS t LEFT JOIN {_LINKS} AS l USING (term_key) GROUP BY ALL")
_add("c10_glossary_search",
     lambda s, f: C.glossary_terms(*_terms(s, f), query="MARKET1", statuses=["approved", "draft"]),
     f"SELECT t.term_key, t.term, t.domain, t.status, COUNT(l.asset) AS link_count, COUNT(DISTINCT l.asset) AS asset_count, "
     f"COUNT(l.column_name) AS column_count FROM {_N} AS t LEFT JOIN {_LINKS} AS l USING (term_key) WHERE status <> 'deprecated' AND "
     f"('market' || n_nationkey ILIKE '%MARKET1%') GROUP BY ALL")


def _customer_assets(s, f):
    c = Bed(s, f).source("customer").filter("c_custkey % 13 <> 0")
    layer = F.element_at(F.array(*[F.lit(x) for x in C.LAYER_ORDER]), (F.col("c_custkey") % 5 + 1).cast("int"))
    name = F.concat(F.lit("cust_"), "c_custkey").alias("asset")
    assets = c.select(name, layer.alias("layer"), F.when(F.col("c_custkey") % 5 == 0, "source").otherwise("model").alias(
        "asset_type"), F.when(F.col("c_custkey") % 17 > 0, F.concat(F.lit("team"), F.col("c_nationkey"))).alias("owner"),
        F.concat(F.lit("system"), F.col("c_custkey") % 4).alias("source_system"))
    columns = c.filter("c_custkey % 11 <> 0").select(name, F.lower("c_mktsegment").alias("column_name"), (
        F.col("c_acctbal") > 5000).alias("is_critical"))
    return assets, columns


def _term_links(s, f):
    assets, columns = _customer_assets(s, f)
    return C.term_links(_terms(s, f)[1], assets, columns, "term_4")


_add("c11_term_links_by_layer", _term_links,
     f"SELECT l.asset, ['raw', 'staging', 'intermediate', 'mart', 'exposure'][c.c_custkey % 5 + 1] AS layer, l.column_name, CASE "
     f"WHEN l.column_name IS NOT NULL AND c.c_custkey % 11 <> 0 THEN c.c_acctbal > 5000 END AS is_critical FROM {_LINKS} AS l JOIN "
     f"customer AS c ON c.c_custkey = l.c_custkey WHERE l.term_key = 'term_4' AND c.c_custkey % 13 <> 0")


def _references(s, f):
    bed = Bed(s, f)
    assets, columns = _customer_assets(s, f)
    teams = bed.source("nation").filter("n_nationkey % 6 <> 0").select(F.concat(F.lit("team"), "n_nationkey").alias("team"))
    systems = bed.source("supplier").select(F.concat(F.lit("system"), F.col("s_suppkey") % 3).alias("source_system"))
    return C.reference_problems(assets, teams, systems, _terms(s, f)[1], columns)


_add("c4_cross_references", _references,
     f"SELECT 'cust_' || c_custkey AS subject, 'missing owner' AS problem FROM customer WHERE c_custkey % 13 <> 0 AND c_custkey % 17 "
     f"= 0 UNION ALL SELECT 'cust_' || c_custkey, 'unknown owner' FROM customer WHERE c_custkey % 13 <> 0 AND c_custkey % 17 <> 0 AND "
     f"c_nationkey % 6 = 0 UNION ALL SELECT 'cust_' || c_custkey, 'unknown source system' FROM customer WHERE c_custkey % 13 <> 0 AND "
     f"c_custkey % 5 = 0 AND c_custkey % 4 = 3 UNION ALL SELECT asset, 'unknown linked asset' FROM {_LINKS} AS l WHERE c_custkey % 13 "
     f"= 0 UNION ALL SELECT asset || '.' || column_name, 'unknown linked column' FROM {_LINKS} AS l WHERE c_custkey % 13 <> 0 AND "
     f"c_custkey % 11 = 0 AND column_name IS NOT NULL")


def _columns_bundle(s, f):
    """Columns of the order table with glossary terms and the latest profile."""
    from plumbline.operators import profile as P
    from plumbline.plans import commerce_catalog as M
    from plumbline.suite.profiles import target
    terms, links = M.term_frames(s)
    profile = P.column_profiles(Bed(s, f).staging["stg_orders"], target("stg_orders"), medians=False)
    columns = M.column_frame(s).filter("asset = 'stg_orders'")
    return plain(C.asset_columns(columns, links, terms, profile).select("column_name", "terms", "distinct_count"))


def _bundle_sql():
    from plumbline.plans import commerce_catalog as M
    from plumbline.plans.model_sql import with_models
    terms = {t[0]: t[1] for t in M.glossary()[0]}
    named: dict[str, list[str]] = {}
    for key, asset, column in M.glossary()[1]:
        if asset == "stg_orders" and column:
            named.setdefault(column, []).append(terms[key])
    return with_models("\nUNION ALL ".join(
        f"SELECT '{r[1]}' AS column_name, " + (f"'{','.join(sorted(named[r[1]]))}'" if r[1] in named else "CAST(NULL AS VARCHAR)")
        + f" AS terms, COUNT(DISTINCT {r[1]}) AS distinct_count FROM stg_orders" for r in M.columns() if r[0] == "stg_orders"))


_add("c9_asset_column_details", _columns_bundle, _bundle_sql())


def _summary(s, f):
    assets, columns, terms, links = _parts(s, f)
    return C.summary(assets=assets, columns=columns, terms=terms, links=links)


_add("c12_ingestion_summary", _summary,
     f"SELECT 'assets' AS item, COUNT(*) AS rows FROM part UNION ALL SELECT 'columns', COUNT(*) FROM (SELECT unnest(string_split("
     f"p_name, ' ')) FROM part) AS x UNION ALL SELECT 'terms', COUNT(DISTINCT p_type) FROM part UNION ALL SELECT 'links', COUNT(*) FROM part")
