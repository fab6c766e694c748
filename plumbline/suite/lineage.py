"""Queries: lineage over a dependency graph that Spark derives from the driver tables.

Regions feed nations, nations feed customers and suppliers, and both feed orders, so the graph has one node
per key and grows with the data. Edges carry the columns their consumer reads.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import lineage as L
from plumbline.session import checkpoint
from plumbline.suite.common import Bed, plain

QUERIES = {}
ORACLE = {}

_NODES = """
    SELECT 'R' || r_regionkey AS asset, 'source' AS asset_type, 'raw' AS layer, 'critical' AS criticality,
           'team' || r_regionkey AS owner, r_name AS source_system FROM {region}
    UNION ALL SELECT 'N' || n_nationkey, 'model', 'staging', 'high', 'team' || (n_nationkey % 5), NULL FROM {nation}
    UNION ALL SELECT 'S' || s_suppkey, 'model', 'intermediate', 'medium', 'team' || (s_suppkey % 5), NULL FROM {supplier}
    UNION ALL SELECT 'C' || c_custkey, 'model', 'intermediate', 'medium', 'team' || (c_custkey % 5), NULL FROM {customer}
    UNION ALL SELECT 'O' || o_orderkey, 'model', 'mart', CASE WHEN o_orderstatus = 'F' THEN 'critical' ELSE 'low' END,
           'team' || (o_custkey % 5), NULL FROM {orders}"""

_SPARK_EDGES = """
    SELECT 'R' || n_regionkey AS upstream, 'N' || n_nationkey AS downstream,
           CASE WHEN n_nationkey % 2 = 0 THEN array('key', 'name') ELSE array('key') END AS referenced_columns
    FROM {nation}
    UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey, CAST(NULL AS array<string>) FROM {customer}
    UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey,
           CASE WHEN s_acctbal < 2000 THEN array('name') ELSE array('balance', 'name') END FROM {supplier}
    UNION ALL SELECT 'C' || o_custkey, 'O' || o_orderkey, array('key') FROM {orders}
    UNION ALL SELECT 'S' || l_suppkey, 'O' || l_orderkey, array_sort(collect_set(l_returnflag))
    FROM {lineitem} GROUP BY l_suppkey, l_orderkey
    UNION ALL SELECT 'C' || c_custkey, 'X' || c_custkey, CAST(NULL AS array<string>) FROM {customer}"""


class Graph:
    """Nodes and edges from the driver tables; dangling edges are dropped as on load."""

    def __init__(self, spark, folder) -> None:
        bed = Bed(spark, folder)
        tables = {n: bed.source(n) for n in ("region", "nation", "supplier", "customer", "orders", "lineitem")}
        self.spark = bed.spark
        self.nodes = spark.sql(_NODES, **{k: v for k, v in tables.items() if k != "lineitem"})
        self.all_edges = spark.sql(_SPARK_EDGES, **{k: v for k, v in tables.items() if k != "region"})
        self.edges = L.clean_edges(self.nodes, self.all_edges)

    def regions(self, columns=None):
        seeds = self.nodes.filter("layer = 'raw'").select(F.col("asset").alias("seed"), "asset")
        return seeds if columns is None else seeds.withColumn("columns", F.array(*[F.lit(c) for c in columns]))

    def nations(self, columns):
        seeds = self.nodes.filter("layer = 'staging'").select(F.col("asset").alias("seed"), "asset")
        return seeds.withColumn("columns", F.array(*[F.lit(c) for c in columns]))


# The same graph for the checker; lists are DuckDB arrays.
_ANSI_EDGES = (
    _SPARK_EDGES.replace("array('key', 'name')", "['key', 'name']").replace("array('key')", "['key']")
    .replace("array('balance', 'name')", "['balance', 'name']").replace("array('name')", "['name']")
    .replace("CAST(NULL AS array<string>)", "CAST(NULL AS VARCHAR[])")
    .replace("array_sort(collect_set(l_returnflag))", "list_sort(list(DISTINCT l_returnflag))"))
_GRAPH_SQL = "WITH RECURSIVE nodes AS MATERIALIZED ({n}), every AS MATERIALIZED ({e}), edges AS MATERIALIZED (" \
    "SELECT * FROM every WHERE upstream IN (SELECT asset FROM nodes) AND downstream IN (SELECT asset FROM nodes))".format(
        n=_NODES.replace("{", "").replace("}", ""), e=_ANSI_EDGES.replace("{", "").replace("}", ""))


def _walk(first: str = "TRUE", columns: str = "NULL", seeds: str = "layer = 'raw'") -> str:
    """CTE ``walk``: all downstream walks from the seeds (the graph is four levels deep)."""
    return (f"{_GRAPH_SQL}, walk AS (SELECT n.asset AS seed, e.downstream AS asset, 1 AS depth, "
            f"[n.asset, e.downstream] AS path FROM nodes AS n JOIN edges AS e ON e.upstream = n.asset "
            f"WHERE n.{seeds} AND {first} UNION ALL SELECT w.seed, e.downstream, w.depth + 1, "
            f"list_append(w.path, e.downstream) FROM walk AS w JOIN edges AS e ON e.upstream = w.asset)")


def _add(name, run, sql):
    QUERIES[name] = run
    ORACLE[name] = sql


_add("l1_clean_edges",
     lambda s, f: plain(Graph(s, f).edges),
     _GRAPH_SQL + " SELECT upstream, downstream, array_to_string(referenced_columns, ',') AS referenced_columns FROM edges")


def _cycles(spark, folder):
    g = Graph(spark, folder)
    depth = L.assert_acyclic(g.edges)
    return g.edges.agg(F.count(F.lit(1)).alias("edges")).withColumn("longest_chain", F.lit(depth).cast("bigint"))


_add("l2_acyclic_check", _cycles,
     _walk() + " SELECT (SELECT COUNT(*) FROM edges) AS edges, (SELECT MAX(depth) FROM walk) AS longest_chain")

_add("l3_direct_downstream",
     lambda s, f: (lambda g: g.regions().withColumnRenamed("asset", "upstream").join(g.edges, "upstream").select(
         "seed", F.col("downstream").alias("asset")))(Graph(s, f)),
     _GRAPH_SQL + " SELECT upstream AS seed, downstream AS asset FROM edges WHERE upstream LIKE 'R%'")


def _descendants(spark, folder):
    g = Graph(spark, folder)
    return L.reach(g.edges, g.regions(), paths=False).select("seed", "asset")


_add("l4_all_descendants", _descendants, _walk() + " SELECT DISTINCT seed, asset FROM walk")


def _ancestors(spark, folder):
    g = Graph(spark, folder)
    marts = g.nodes.filter("layer = 'mart' AND criticality = 'critical'").select(F.col("asset").alias("seed"), "asset")
    return L.reach(g.edges, marts, downstream=False, paths=False).select("seed", "asset", F.col("depth").cast("bigint").alias("depth"))


_add("l5_upstream_depths", _ancestors,
     _GRAPH_SQL + ", up AS (SELECT n.asset AS seed, e.upstream AS asset, 1 AS depth FROM nodes AS n "
     "JOIN edges AS e ON e.downstream = n.asset WHERE n.layer = 'mart' AND n.criticality = 'critical' "
     "UNION ALL SELECT u.seed, e.upstream, u.depth + 1 FROM up AS u JOIN edges AS e ON e.downstream = u.asset) "
     "SELECT seed, asset, CAST(MIN(depth) AS BIGINT) AS depth FROM up GROUP BY ALL")

_add("l5_downstream_depths",
     lambda s, f: (lambda g: L.reach(g.edges, g.regions(), paths=False).select(
         "seed", "asset", F.col("depth").cast("bigint").alias("depth")))(Graph(s, f)),
     _walk() + " SELECT seed, asset, CAST(MIN(depth) AS BIGINT) AS depth FROM walk GROUP BY ALL")

_add("l6_column_scoped_descendants",
     lambda s, f: (lambda g: L.reach(g.edges, g.regions(["name"]), paths=False).select(
         "seed", "asset", F.col("depth").cast("bigint").alias("depth")))(Graph(s, f)),
     _walk("list_contains(e.referenced_columns, 'name')")
     + " SELECT seed, asset, CAST(MIN(depth) AS BIGINT) AS depth FROM walk GROUP BY ALL")

_add("l7_unreferenced_consumers",
     lambda s, f: (lambda g: L.unreferenced_consumers(g.edges, g.nations(["balance"])))(Graph(s, f)),
     _GRAPH_SQL + " SELECT upstream AS seed, downstream AS asset FROM edges WHERE upstream LIKE 'N%' "
     "AND referenced_columns IS NOT NULL AND NOT list_contains(referenced_columns, 'balance')")

_add("l8_shortest_paths",
     lambda s, f: (lambda g: L.reach(g.edges, g.regions()).select(
         "seed", "asset", F.array_join("path", ">").alias("path")))(Graph(s, f)),
     _walk() + " SELECT seed, asset, array_to_string(path, '>') AS path FROM (SELECT seed, asset, path, row_number() "
     "OVER (PARTITION BY seed, asset ORDER BY depth, path) AS rn FROM walk) AS x WHERE rn = 1")


def _paths(spark, folder):
    g = Graph(spark, folder)
    edges = checkpoint(g.edges.select("upstream", "downstream"))
    targets = g.nodes.filter("layer = 'mart' AND criticality = 'critical'").select(F.col("asset").alias("target"))
    # Each mart with the regions above it: regions go down to what they feed, so rows are one per region and asset.
    below = L.reach(edges, g.regions(), paths=False)
    pairs = below.select(F.col("seed").alias("source"), F.col("asset").alias("target")).join(targets, "target", "left_semi")
    return plain(L.all_paths(edges, pairs, 3).withColumn("path", F.array_join("path", ">")))


_add("l9_all_paths_top3", _paths,
     _walk() + " SELECT source, target, CAST(rn AS BIGINT) AS rank, array_to_string(path, '>') AS path FROM ("
     "SELECT w.seed AS source, w.asset AS target, w.path, row_number() OVER (PARTITION BY w.seed, w.asset "
     "ORDER BY w.depth, w.path) AS rn FROM walk AS w JOIN nodes AS n ON n.asset = w.asset "
     "WHERE n.layer = 'mart' AND n.criticality = 'critical') AS x WHERE rn <= 3")


def _hood(spark, folder):
    g = Graph(spark, folder)
    _, inside = L.neighbourhood(g.edges, "N3", 1, 2)
    return inside.select("upstream", "downstream")


_add("l10_neighbourhood_edges", _hood,
     _GRAPH_SQL + ", keep AS (SELECT 'N3' AS asset UNION SELECT upstream FROM edges WHERE downstream = 'N3' "
     "UNION SELECT downstream FROM edges WHERE upstream = 'N3' UNION SELECT f.downstream FROM edges AS e "
     "JOIN edges AS f ON f.upstream = e.downstream WHERE e.upstream = 'N3') SELECT upstream, downstream FROM edges "
     "WHERE upstream IN (SELECT asset FROM keep) AND downstream IN (SELECT asset FROM keep)")

_add("l11_longest_chain",
     lambda s, f: plain(L.longest_chain(Graph(s, f).edges).withColumn("path", F.array_join("path", ">"))),
     _walk() + " SELECT CAST(depth AS BIGINT) AS length, array_to_string(path, '>') AS path FROM walk "
     "ORDER BY depth DESC, walk.path LIMIT 1")

_add("l11_layer_counts",
     lambda s, f: L.layer_counts(Graph(s, f).nodes),
     _GRAPH_SQL + " SELECT layer, COUNT(*) AS assets FROM nodes GROUP BY layer")


_WORD = r"(?U)\w+"
_WORD_SQL = "regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+')"


def _references(spark, folder):
    """Which words of which benchmark item every document mentions: items as upstream assets, documents as consumer texts."""
    bed = Bed(spark, folder)
    texts = bed.source("documents").select(F.concat(F.lit("D"), "doc_id").alias("asset"), F.lower("text").alias("text"))
    offered = bed.source("benchmark").select(
        F.concat(F.lit("B"), "item_id").alias("asset"),
        F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0))).alias("ordinal", "column_name"))
    return plain(L.word_references(offered, texts))


_add("l12_column_references", _references,
     f"""WITH w AS (SELECT 'B' || item_id AS upstream, c, MIN(pos) AS pos FROM (SELECT item_id, unnest(list) AS c,
                      generate_subscripts(list, 1) AS pos FROM (SELECT item_id, {_WORD_SQL} AS list FROM benchmark)) GROUP BY ALL),
     t AS (SELECT DISTINCT 'D' || doc_id AS downstream, unnest({_WORD_SQL}) AS c FROM documents)
     SELECT upstream, downstream, string_agg(c, ',' ORDER BY pos, c) AS referenced_columns FROM t JOIN w USING (c) GROUP BY ALL
     UNION ALL SELECT DISTINCT NULL, 'D' || doc_id, NULL FROM documents WHERE text IS NULL""")


def _lineage_table(spark, folder):
    g = Graph(spark, folder)
    nodes = g.nodes
    return L.reach(g.edges, g.regions(), paths=False).join(nodes, "asset").select(
        "seed", "asset", F.col("depth").cast("bigint").alias("depth"), "layer", "asset_type", "criticality", "owner")


_add("l13_asset_lineage_table", _lineage_table,
     _walk() + " SELECT w.seed, w.asset, CAST(MIN(w.depth) AS BIGINT) AS depth, n.layer, n.asset_type, n.criticality, "
     "n.owner FROM walk AS w JOIN nodes AS n ON n.asset = w.asset GROUP BY ALL")


def _origins(spark, folder):
    g = Graph(spark, folder)
    marts = g.nodes.filter("layer = 'mart'").select(F.col("asset").alias("seed"), "asset")
    return plain(L.origin_systems(g.edges, g.nodes, marts))


_add("l14_origin_systems", _origins,
     _walk() + ", o AS (SELECT DISTINCT w.asset AS seed, n.source_system FROM walk AS w JOIN nodes AS n "
     "ON n.asset = w.seed) SELECT m.asset AS seed, COALESCE(array_to_string(list(o.source_system ORDER BY "
     "o.source_system), ','), '') AS systems FROM nodes AS m LEFT JOIN o ON o.seed = m.asset WHERE m.layer = 'mart' "
     "GROUP BY m.asset")
