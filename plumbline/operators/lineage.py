"""Lineage over two DataFrames: nodes(asset, ...) and edges(upstream, downstream, referenced_columns).

Traversals advance all seeds together, level by level, and keep one row per seed and node. Small graphs go several
hops per round, large ones a single hop, so that no row is shuffled for hops that lead nowhere; a round ends in a
checkpoint, so plans stay short on deep graphs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import checkpoint

_HOPS_PER_ROUND = 4
#: Edges up to which several hops share a round.
SMALL_GRAPH = 1_000_000


class CycleError(ValueError):
    """The graph has a cycle."""


def clean_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Drop edges with an unknown end."""
    known = nodes.select("asset").distinct()
    out = edges.join(known.withColumnRenamed("asset", "upstream"), "upstream", "left_semi")
    return out.join(known.withColumnRenamed("asset", "downstream"), "downstream", "left_semi").select(*edges.columns)


def assert_acyclic(edges: DataFrame) -> int:
    """Peel off edges that start at a root until none is left; returns the longest chain's length in edges.

    Peeling that stops while edges remain means a cycle.
    """
    rest = checkpoint(edges.select("upstream", "downstream").distinct())
    left, rounds = rest.count(), 0
    while left:
        targets = rest.select(F.col("downstream").alias("upstream")).distinct()
        rest = checkpoint(rest.join(targets, "upstream", "left_semi"))
        now = rest.count()
        if now == left:
            raise CycleError("lineage contains a cycle")
        left, rounds = now, rounds + 1
    return rounds


def direct(edges: DataFrame, asset: str, downstream: bool = True) -> DataFrame:
    near, far = ("upstream", "downstream") if downstream else ("downstream", "upstream")
    return edges.filter(F.col(near) == asset).select(F.col(far).alias("asset")).distinct()


def _oriented(edges: DataFrame, downstream: bool) -> DataFrame:
    near, far = ("upstream", "downstream") if downstream else ("downstream", "upstream")
    return edges.select(F.col(near).alias("_from"), F.col(far).alias("_to"))


def is_referenced(referenced: Column, columns: Column) -> Column:
    """Whether a consumer reads one of the columns; unknown references and no columns count as yes."""
    hit = F.arrays_overlap(referenced, columns)
    return referenced.isNull() | columns.isNull() | (F.size(columns) == 0) | F.coalesce(hit, F.lit(False))


def _grow(found: DataFrame, frontier: DataFrame, step: DataFrame, depth: int, hops_per_round: int, carried: list[str]) -> DataFrame:
    """One round: up to ``hops_per_round`` hops from the frontier, new nodes only."""
    hops, current = [], frontier
    for i in range(1, hops_per_round + 1):
        # An asset without edges of its own leads nowhere: only the others meet the edges.
        current = current.filter("_on").select(F.col("asset").alias("_from"), "seed", *carried).join(step, "_from").select(
            "seed", F.col("_to").alias("asset"), "_on", *[F.concat(c, F.array("_to")).alias(c) for c in carried])
        current = _nearest(current, carried)
        hops.append(current.withColumn("depth", F.lit(depth + i)))
    union = reduce(DataFrame.unionByName, hops)
    if hops_per_round > 1:
        union = union.groupBy("seed", "asset").agg(
            F.max("_on").alias("_on"), *[F.min_by(c, "depth").alias(c) for c in carried], F.min("depth").alias("depth"))
    return checkpoint(union.join(found.select("seed", "asset"), ["seed", "asset"], "left_anti"))


def _nearest(rows: DataFrame, carried: list[str]) -> DataFrame:
    """One row per seed and node reached by the same number of hops: the smallest path in text order wins."""
    return rows.groupBy("seed", "asset").agg(F.max("_on").alias("_on"), *[F.min(c).alias(c) for c in carried])


def reach(edges: DataFrame, seeds: DataFrame, downstream: bool = True, max_depth: int | None = None, paths: bool = True) -> DataFrame:
    """(seed, asset, depth, path): every asset reachable from each seed with its fewest hops and shortest path.

    ``seeds`` has (seed, asset) and may have ``columns``: then the first hop only follows consumers that
    read one of them. Later hops follow every edge, because a defect travels on with the derived rows.
    Without ``paths`` the rows have no path, and no list is carried along, sorted or written.
    """
    # Every hop joins the edges again: derive them once, and mark those whose far end has edges of its own.
    near, far = ("upstream", "downstream") if downstream else ("downstream", "upstream")
    edges = checkpoint(edges)
    goes_on = edges.select(F.col(near).alias(far)).distinct().withColumn("_on", F.lit(True))
    edges = checkpoint(edges.join(goes_on, far, "left").withColumn("_on", F.coalesce("_on", F.lit(False))))
    step = edges.select(F.col(near).alias("_from"), F.col(far).alias("_to"), "_on")
    hops_per_round = _HOPS_PER_ROUND if edges.count() <= SMALL_GRAPH else 1
    carried = ["path"] if paths else []
    if "columns" in seeds.columns and downstream:
        first = seeds.withColumnRenamed("asset", "upstream").join(edges, "upstream").filter(
            is_referenced(F.col("referenced_columns"), F.col("columns"))).select(
            "seed", F.col("downstream").alias("_to"), F.col("upstream").alias("_start"), "_on")
    else:
        first = seeds.withColumnRenamed("asset", "_from").join(step, "_from").select(
            "seed", "_to", F.col("_from").alias("_start"), "_on")
    frontier = _nearest(first.select("seed", F.col("_to").alias("asset"), "_on", F.array("_start", "_to").alias("path")), carried)
    found = frontier = checkpoint(frontier.withColumn("depth", F.lit(1)))
    depth = 1
    while (max_depth is None or depth < max_depth) and not frontier.filter("_on").isEmpty():
        new = _grow(found, frontier, step, depth, hops_per_round, carried)
        if new.isEmpty():
            break
        found = found.unionByName(new)
        depth += hops_per_round
        frontier = new.filter(F.col("depth") == depth)
    starts = seeds.select("seed", "asset").distinct()
    out = found.join(starts, ["seed", "asset"], "left_anti").select("seed", "asset", "depth", *carried)
    return out if max_depth is None else out.filter(F.col("depth") <= max_depth)


def unreferenced_consumers(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, asset): direct consumers known not to read any of the seed's columns."""
    joined = seeds.withColumnRenamed("asset", "upstream").join(edges, "upstream")
    return joined.filter(~is_referenced(F.col("referenced_columns"), F.col("columns"))).select(
        "seed", F.col("downstream").alias("asset"))


def shortest_path(edges: DataFrame, source: str, target: str) -> DataFrame:
    """The shortest path between two assets, the smallest in text order among equals (no row if none)."""
    seeds = edges.sparkSession.createDataFrame([(source, source)], "seed string, asset string")
    return reach(edges, seeds).filter(F.col("asset") == target).select("path")


def all_paths(edges: DataFrame, pairs: DataFrame, limit: int = 20) -> DataFrame:
    """Simple paths for each (source, target) pair, shortest first, equal ones in text order: (source, target, rank, path).

    Paths grow from the ends of which there are fewer, and a node keeps its ``limit`` best for each of them: a path to the next node
    is among the best only if what it prolongs is. That holds as long as no path that is kept meets itself; where one does,
    the graph has a cycle, and every partial path has to be tried.
    """
    pairs = checkpoint(pairs.filter("source <> target").select("source", "target"))
    ends = pairs.agg(F.approx_count_distinct("source").alias("sources"), F.approx_count_distinct("target").alias("targets")).first()
    forward = ends["sources"] <= ends["targets"]
    fixed, tip = ("source", "target") if forward else ("target", "source")
    step = _onward(_oriented(edges, forward), pairs.select(F.col(tip).alias("_to")))
    current = pairs.select(fixed).distinct().select(
        fixed, F.col(fixed).alias(tip), F.lit(0).alias("rank"), F.array(fixed).alias("path"), F.lit(True).alias("_on"), F.lit(False).alias("_again"))
    found, kept = [], current
    while True:
        longer = current.filter("_on").select(fixed, F.col(tip), "path").join(step, F.col(tip) == F.col("_from")).select(
            fixed, F.col("_to").alias(tip), F.concat(*(("path", F.array("_to")) if forward else (F.array("_to"), "path"))).alias("path"), "_on",
            F.array_contains("path", F.col("_to")).alias("_again"))
        # Paths found before are shorter.
        before = kept.groupBy(fixed, tip).agg(F.count(F.lit(1)).alias("_n"))
        nth = F.row_number().over(Window.partitionBy(fixed, tip).orderBy("path"))
        ranked = longer.join(before, [fixed, tip], "left").withColumn("rank", (nth + F.coalesce("_n", F.lit(0))).cast("int"))
        current = checkpoint(ranked.filter(F.col("rank") <= limit).select(fixed, tip, "rank", "path", "_on", "_again"))
        if not current.filter("_again").isEmpty():
            return _all_simple_paths(edges, pairs, limit)
        found.append(current)
        if current.filter("_on").isEmpty():
            break
        kept = kept.unionByName(current)
    return reduce(DataFrame.unionByName, found).select("source", "target", "rank", "path").join(pairs, ["source", "target"], "left_semi")


def _onward(step: DataFrame, asked: DataFrame) -> DataFrame:
    """(_from, _to, _on): the different edges that end at an asked asset or at one with edges of its own (``_on``)."""
    known = step.select(F.col("_from").alias("_to"), F.lit(True).alias("_on")).distinct().unionByName(
        asked.distinct().withColumn("_on", F.lit(False))).groupBy("_to").agg(F.max("_on").alias("_on"))
    return checkpoint(step.join(known, "_to").select("_from", "_to", "_on").distinct())


def _all_simple_paths(edges: DataFrame, pairs: DataFrame, limit: int) -> DataFrame:
    """Paths of ``all_paths`` in any graph: all partial paths grow along edges from which the target can still be reached."""
    edges = checkpoint(edges)
    ends = pairs.select(F.col("target").alias("seed"), F.col("target").alias("asset")).distinct()
    useful = reach(edges, ends, downstream=False, paths=False).select("seed", "asset").unionByName(ends)
    # The edges above each target: a path never meets the other consumers of its last node.
    above = checkpoint(useful.select(F.col("seed").alias("target"), F.col("asset").alias("_to")).distinct().join(
        _oriented(edges, True).distinct(), "_to").select("target", "_from", "_to"))
    growing = pairs.distinct().select("source", "target", F.array("source").alias("path"))
    done = []
    while True:
        tail = F.element_at("path", -1)
        longer = growing.withColumn("_from", tail).join(above, ["target", "_from"]).filter(
            ~F.array_contains("path", F.col("_to")))
        growing = checkpoint(longer.select("source", "target", F.concat("path", F.array("_to")).alias("path")))
        if growing.isEmpty():
            break
        arrived = F.element_at("path", -1) == F.col("target")
        done.append(growing.filter(arrived))
        growing = growing.filter(~arrived)
    if not done:
        return growing.select("source", "target", F.lit(1).alias("rank"), "path")
    ranked = Window.partitionBy("source", "target").orderBy(F.size("path"), "path")
    return reduce(DataFrame.unionByName, done).withColumn("rank", F.row_number().over(ranked)).filter(
        F.col("rank") <= limit).select("source", "target", "rank", "path")


def neighbourhood(edges: DataFrame, asset: str, up: int = 2, down: int = 2) -> tuple[DataFrame, DataFrame]:
    """Assets within the given hops in both directions, and the edges among them."""
    seed = edges.sparkSession.createDataFrame([(asset, asset)], "seed string, asset string")
    near = seed.select("asset")
    if up:
        near = near.unionByName(reach(edges, seed, False, up, False).select("asset"))
    if down:
        near = near.unionByName(reach(edges, seed, True, down, False).select("asset"))
    keep = near.distinct()
    return keep, subgraph(edges, keep)


def subgraph(edges: DataFrame, keep: DataFrame) -> DataFrame:
    names = keep.select("asset").distinct()
    inside = edges.join(names.withColumnRenamed("asset", "upstream"), "upstream", "left_semi")
    return inside.join(names.withColumnRenamed("asset", "downstream"), "downstream", "left_semi").select(*edges.columns)


def longest_chain(edges: DataFrame) -> DataFrame:
    """One longest dependency chain (the smallest in text order): (length, path). The graph must be acyclic."""
    step = checkpoint(_oriented(edges, True).distinct())
    current = step.groupBy(F.col("_to").alias("asset")).agg(F.min(F.array("_from", "_to")).alias("path"))
    last = current = checkpoint(current)
    while not current.isEmpty():
        last = current
        current = checkpoint(current.withColumnRenamed("asset", "_from").join(step, "_from").groupBy(
            F.col("_to").alias("asset")).agg(F.min(F.concat("path", F.array("_to"))).alias("path")))
    return last.agg(F.min("path").alias("path")).select((F.size("path") - 1).alias("length"), "path")


def layer_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("layer").agg(F.count(F.lit(1)).alias("assets"))


def column_references(edges: DataFrame, columns: DataFrame, texts: DataFrame) -> DataFrame:
    """Add ``referenced_columns``: upstream columns that the consumer's text mentions as a whole word.

    ``columns`` is (asset, column_name, ordinal), ``texts`` is (asset, text). A consumer without text gets
    NULL, meaning every column may be read. Words are matched by equality, not by one pattern per column.
    """
    owned = columns.select(F.col("asset").alias("upstream"), "column_name", "ordinal")
    words = texts.filter("text IS NOT NULL").select(
        F.col("asset").alias("downstream"),
        F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?U)\w+"), F.lit(0)))).alias("column_name"))
    # Only words that are column names go on, so an edge never meets all columns of its upstream asset.
    names = words.join(owned.select("column_name").distinct(), "column_name", "left_semi")
    said = edges.select("upstream", "downstream").join(names, "downstream")
    hits = said.join(owned, ["upstream", "column_name"]).groupBy("upstream", "downstream").agg(
        F.transform(F.array_sort(F.collect_set(F.struct("ordinal", "column_name"))),
                    lambda c: c["column_name"]).alias("_hits"))
    known = texts.filter("text IS NOT NULL").select(F.col("asset").alias("downstream"), F.lit(True).alias("_known"))
    base = edges.select("upstream", "downstream").join(known, "downstream", "left").join(
        hits, ["upstream", "downstream"], "left")
    return base.select("upstream", "downstream", F.when(
        F.col("_known"), F.coalesce("_hits", F.array().cast("array<string>"))).alias("referenced_columns"))


#: Texts of a shelf of the index that one join task holds; assets on a shelf, and words of theirs. What is beyond is split.
HOT_WORD = 100_000
POSTINGS = 1024
SHELF_WORDS = 16_384
#: Assets that one task deals to shelves, and rows of texts whose hits one task reads, in expectation.
DEALT = 100_000
TEXTS_READ = 2_000


def text_words(texts: DataFrame) -> DataFrame:
    """(asset, word) of ``texts(asset, text)``: every different whole word of a row."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?U)\w+"), F.lit(0)))
    return texts.filter("text IS NOT NULL").select("asset", F.explode(words).alias("word"))


def _in_order(by: str, *columns: str) -> Column:
    """The group's values of the columns (structs, if several) as an array in the order of another."""
    value = F.struct(*columns) if len(columns) > 1 else F.col(columns[0])
    return F.transform(F.array_sort(F.collect_list(F.struct(by, value.alias("value")))), lambda x: x["value"])


def word_index(columns: DataFrame, postings: int = POSTINGS, shelf_words: int = SHELF_WORDS) -> DataFrame:
    """Inverted index of ``columns(asset, column_name, ordinal)``: (shelf, wide, word, nth, owners).

    Assets stand on shelves, at most ``postings`` of them and less than twice ``shelf_words`` words on each; an asset with more
    words stands in pieces on wide shelves. So no row and no shelf grows with the catalogue. ``nth`` numbers the words of
    a shelf; owners are structs (no, place, upstream, piece): the asset's number there and the word's place among its words.
    """
    own = Window.partitionBy("upstream")
    owned = columns.filter("column_name IS NOT NULL").groupBy(F.col("asset").alias("upstream"), F.col("column_name").alias("word")).agg(
        F.min("ordinal").alias("ordinal"))
    placed = owned.select("upstream", "word", (F.count(F.lit(1)).over(own) > shelf_words).alias("wide"),
                          (F.row_number().over(own.orderBy("ordinal", "word")) - 1).alias("place"))
    pieces = checkpoint(placed.groupBy("upstream", "wide", F.floor(F.col("place") / shelf_words).cast("int").alias("piece")).agg(
        _in_order("place", "word").alias("words")))
    lots = -(-pieces.count() // DEALT) or 1
    row = Window.partitionBy("wide", "lot").orderBy("upstream", "piece")
    nth = F.floor((F.row_number().over(row) - 1) / postings)
    size = F.floor((F.sum(F.size("words")).over(row) - 1) / shelf_words)
    shelf = F.concat_ws("-", "wide", "lot", nth, size)
    stood = pieces.withColumn("lot", F.pmod(F.xxhash64("upstream", "piece"), F.lit(lots))).withColumn("shelf", shelf)
    number = (F.row_number().over(Window.partitionBy("shelf").orderBy("upstream", "piece")) - 1).alias("no")
    spread = stood.select("shelf", "wide", number, "upstream", "piece", "words").select(
        "shelf", "wide", "no", "upstream", "piece", F.posexplode("words").alias("place", "word"))
    lists = spread.groupBy("shelf", "wide", "word").agg(F.collect_list(F.struct("no", "place", "upstream", "piece")).alias("owners"))
    return lists.withColumn("nth", F.row_number().over(Window.partitionBy("shelf").orderBy("word")) - 1)


def _shelves(index: DataFrame) -> DataFrame:
    """(shelf, wide, lists, assets): a row per shelf. Lists hold, by ``nth``, the owners of a word as numbers
    no * 2^32 + place; assets hold, by ``no``, structs (upstream, piece, words)."""
    numbers = F.transform("owners", lambda o: F.shiftleft(o["no"].cast("bigint"), 32) + o["place"])
    lists = index.select("shelf", "nth", numbers.alias("numbers")).groupBy("shelf").agg(_in_order("nth", "numbers").alias("lists"))
    owners = index.select("shelf", "wide", "word", F.inline("owners"))
    assets = owners.groupBy("shelf", "wide", "no", "upstream", "piece").agg(_in_order("place", "word").alias("words")).groupBy(
        "shelf", "wide").agg(_in_order("no", "upstream", "piece", "words").alias("assets"))
    return lists.join(assets, "shelf")


def _read(said: DataFrame, shelves: DataFrame) -> DataFrame:
    """(upstream, piece, downstream, words): the assets on a shelf that a text's words (numbers ``said``) belong to.

    The hits of a text stay in its row: sorted, those of one asset stand side by side and are cut out as its words.
    """
    def asset(hit):
        return F.get("assets", F.shiftright(hit, 32).cast("int"))

    def other(i):
        return F.shiftright(F.get("hits", i), 32) != F.shiftright(F.get("hits", i - 1), 32)

    def cut(start, k):
        own = F.slice("hits", start + 1, F.coalesce(F.get("starts", k + 1), F.size("hits")) - start)
        first = asset(F.get("hits", start))
        return F.struct(first["upstream"].alias("upstream"), first["piece"].alias("piece"), F.transform(
            own, lambda h: F.get(asset(h)["words"], h.bitwiseAND(0xFFFFFFFF).cast("int"))).alias("words"))

    hits = F.sort_array(F.flatten(F.transform("said", lambda nth: F.get("lists", nth))))
    starts = F.filter(F.sequence(F.lit(0), F.size("hits") - 1), lambda i: (i == 0) | other(i))
    met = said.join(shelves, ["shelf", "part"]).select("asset", "assets", hits.alias("hits")).withColumn("starts", starts)
    return met.select(F.col("asset").alias("downstream"), F.inline(F.transform("starts", cut)))


def word_references(columns: DataFrame, texts: DataFrame, hot: int = HOT_WORD, postings: int = POSTINGS,
                    shelf_words: int = SHELF_WORDS) -> DataFrame:
    """(upstream, downstream, referenced_columns) for every asset and text that share a word, columns in their order.

    No pairing is given: texts meet assets through an inverted index. A text goes to every shelf that knows one of its words,
    with the numbers of those words only, and finds its assets there within its own row: neither hits nor pairs are shuffled. A shelf with
    more than ``hot`` texts is copied for as many parts, so that no join task holds all texts of a shelf. Only
    the pieces of an asset with more than ``shelf_words`` words are put together by text. A NULL text may read anything: it has
    one row without upstream and columns.
    """
    index = checkpoint(word_index(columns, postings, shelf_words))
    said = checkpoint(text_words(texts).join(index.select("word", "shelf", "nth"), "word").groupBy("asset", "shelf").agg(
        F.collect_set("nth").alias("said")))
    # Both are written, so that Spark knows their size when it plans the joins.
    parts = checkpoint(said.groupBy("shelf").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / hot).cast("int")))
    tasks = -(-(parts.agg(F.sum("n")).first()[0] or 0) // TEXTS_READ) or 1
    shelves = checkpoint(_shelves(index).join(parts.drop("n"), "shelf").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
    dealt = said.repartition(tasks, "asset", "shelf").join(parts, "shelf").withColumn(
        "part", F.pmod(F.xxhash64("asset"), "parts").cast("int")).drop("n", "parts")
    known = _read(dealt, shelves.filter("NOT wide")).select("upstream", "downstream", F.col("words").alias("referenced_columns"))
    wide = shelves.filter("wide")
    if not wide.isEmpty():
        known = known.unionByName(_read(dealt, wide).groupBy("upstream", "downstream").agg(
            F.flatten(_in_order("piece", "words")).alias("referenced_columns")))
    unknown = texts.filter("text IS NULL").select(
        F.lit(None).cast("string").alias("upstream"), F.col("asset").alias("downstream"), F.lit(None).cast("array<string>").alias("referenced_columns"))
    return known.unionByName(unknown.distinct())


def asset_lineage(edges: DataFrame, nodes: DataFrame, asset: str, downstream: bool = True) -> DataFrame:
    """(asset, depth, layer, asset_type, criticality, owner) of everything up- or downstream."""
    seed = edges.sparkSession.createDataFrame([(asset, asset)], "seed string, asset string")
    return reach(edges, seed, downstream, paths=False).join(nodes, "asset").select(
        "asset", "depth", "layer", "asset_type", "criticality", "owner")


def origin_systems(edges: DataFrame, nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, systems): source systems of the seed and its ancestors.

    Systems go down to everything they feed, so the rows are one per system and asset however many seeds ask.
    """
    starts = seeds.select("seed", "asset")
    fed = nodes.filter("source_system IS NOT NULL").select(F.col("source_system").alias("seed"), "asset").distinct()
    every = reach(edges, fed, paths=False).select("seed", "asset").unionByName(fed).withColumnRenamed("seed", "source_system")
    systems = starts.join(every, "asset").groupBy("seed").agg(F.array_sort(F.collect_set("source_system")).alias("systems"))
    return starts.select("seed").distinct().join(systems, "seed", "left").select(
        "seed", F.coalesce("systems", F.array().cast("array<string>")).alias("systems"))
