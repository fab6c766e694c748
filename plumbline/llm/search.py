"""Ranked lexical search of every item against all documents by dual-tree search.

A document has a coordinate per term, ``(10^9 tf) div (1000 tf + 12 m)`` with m following its length, and an item a weight
per term, its inverse document frequency times its repeats; the score is their product. Items lie in a hierarchy whose
nodes know the largest weight of each term among their items, and so do the documents of a block for their coordinates.
A pair of nodes is bounded by the product of its maxima. If that is below the weakest k-th score of the items under the
node, the whole batch of pairs goes; otherwise both nodes are opened. Everything is 64-bit integer, so no rounding can cost
a result. Each task keeps the k best of each item over its rows, and these are merged by rank.

Items are searched in groups of bounded size, so that what is broadcast does not follow their number; every group is
held against all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import checkpoint

BEST = 20
#: Terms, in expectation and summed over its items, of one group of items.
GROUP_TERMS = 1 << 15
#: Items and documents per leaf, children per node, and cells (documents times terms) of one block.
ITEM_LEAF = 4
DOC_LEAF = 16
FAN = 4
CELLS = 1 << 22


def _folding() -> bytes:
    """A-Z in lower case, other letters, digits and bytes beyond ASCII as they are, the rest white space."""
    keep = {*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1), *range(128, 256)}
    return bytes(b + 32 if ord("A") <= b <= ord("Z") else b if b in keep else 32 for b in range(256))


_FOLDING = _folding()


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order and with repeats."""
    return (text or b"").translate(_FOLDING).split()


def term_weight(documents: int, spread: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * spread + 1)))


def length_factor(n: int, documents: int, words: int) -> int:
    """m of a document of ``n`` terms."""
    return 100 - 25 + (25 * n * documents) // words


@dataclass
class Items:
    """A group of items and the hierarchy over them.

    ``weights[i]`` are the (term, weight) arrays of item i, in the order of the leaves; ``levels[l][j]`` are those of a node,
    with the largest weight of each term; node j has the nodes ``FAN j`` to ``FAN j + FAN - 1`` of the level below, or items.
    """

    place: dict[bytes, int]
    weights: list[tuple[np.ndarray, np.ndarray]]
    keys: list[int]
    documents: int
    words: int
    levels: list[list[tuple[np.ndarray, np.ndarray]]] = field(default_factory=list)

    @classmethod
    def of(cls, counts: list[Counter], spread: dict[bytes, int], documents: int, words: int) -> Items:
        """Items by their term counts. Terms that no document has play no part."""
        held = Counter(t for c in counts for t in c if t in spread)
        # Items that share common terms lie together: these are the coordinates that node maxima cannot tell apart.
        rank = {t: k for k, (t, _) in enumerate(sorted(held.items(), key=lambda x: (-x[1], x[0])))}
        own = [sorted(rank[t] for t in c if t in rank) for c in counts]
        order = sorted(range(len(counts)), key=lambda i: own[i])
        weight = {t: term_weight(documents, spread[t]) for t in rank}
        by_rank = sorted(rank, key=rank.get)
        weights = [(np.array(own[i], dtype=np.int64), np.array([counts[i][by_rank[k]] * weight[by_rank[k]] for k in own[i]], dtype=np.int64)) for i in order]
        items = cls(rank, weights, order, documents, words)
        below, size = weights, ITEM_LEAF
        while below:
            nodes = []
            for start in range(0, len(below), size):
                columns = np.unique(np.concatenate([c for c, _ in below[start:start + size]]))
                most = np.zeros(len(columns), dtype=np.int64)
                for c, w in below[start:start + size]:
                    at = np.searchsorted(columns, c)
                    most[at] = np.maximum(most[at], w)
                nodes.append((columns, most))
            items.levels.append(nodes)
            if len(nodes) == 1:
                break
            below, size = nodes, FAN
        return items

    def weakest(self, kth: np.ndarray) -> list[np.ndarray]:
        """Per level and node, the least k-th score of the items under it."""
        out, size = [], ITEM_LEAF
        for nodes in self.levels:
            kth = np.minimum.reduceat(kth, np.arange(len(nodes)) * size)
            out.append(kth)
            size = FAN
        return out


def doc_levels(values: np.ndarray) -> list[np.ndarray]:
    """Coordinate maxima of the leaves (``DOC_LEAF`` rows each) and of the nodes above them, up to one root."""
    levels, size = [], DOC_LEAF
    below = values
    while True:
        below = np.maximum.reduceat(below, np.arange(0, len(below), size), axis=0)
        levels.append(below)
        if len(below) == 1:
            return levels
        size = FAN


def _children(nodes: np.ndarray, level: int, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(which of ``nodes``, child) for all their children at the level below."""
    below = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
    parent = np.repeat(np.arange(len(nodes)), FAN)
    real = below < sizes[level - 1]
    return parent[real], below[real]


def leaf_pairs(items: Items, docs: list[np.ndarray], kth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(item leaf, document leaf) pairs that may hold one of the best of an item; all other pairs are ruled out by bounds."""
    weakest = items.weakest(kth)
    item_sizes, doc_sizes = [len(x) for x in items.levels], [len(x) for x in docs]
    i_level, d_level = len(items.levels) - 1, len(docs) - 1
    i_nodes, d_nodes = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    while len(i_nodes):
        # Pairs of one item node are bounded together.
        order = np.argsort(i_nodes, kind="stable")
        i_nodes, d_nodes = i_nodes[order], d_nodes[order]
        starts = np.flatnonzero(np.concatenate(([True], i_nodes[1:] != i_nodes[:-1])))
        keep = np.zeros(len(i_nodes), dtype=bool)
        for a, b in zip(starts, np.append(starts[1:], len(i_nodes)), strict=True):
            columns, most = items.levels[i_level][i_nodes[a]]
            bound = docs[d_level][np.ix_(d_nodes[a:b], columns)] @ most
            keep[a:b] = (bound > 0) & (bound >= weakest[i_level][i_nodes[a]])
        i_nodes, d_nodes = i_nodes[keep], d_nodes[keep]
        if not i_level and not d_level:
            break
        # The higher node is opened, both if they stand equally high.
        open_items, open_docs = i_level >= d_level, d_level >= i_level
        if open_items:
            parent, i_nodes = _children(i_nodes, i_level, item_sizes)
            d_nodes = d_nodes[parent]
        if open_docs:
            parent, d_nodes = _children(d_nodes, d_level, doc_sizes)
            i_nodes = i_nodes[parent]
        i_level, d_level = i_level - open_items, d_level - open_docs
    return i_nodes, d_nodes


class Best:
    """The k best documents of each item so far: highest score, then lowest id, ids before none."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.score = [np.zeros(0, dtype=np.int64)] * items
        self.id = [np.zeros(0, dtype=np.int64)] * items
        self.no_id = [np.zeros(0, dtype=bool)] * items
        #: Score of the k-th, 0 while there are fewer.
        self.kth = np.zeros(items, dtype=np.int64)

    def add(self, i: int, score: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        score, ids, no_id = (np.concatenate(x) for x in ((self.score[i], score), (self.id[i], ids), (self.no_id[i], no_id)))
        order = np.lexsort((ids, no_id, -score))[:self.k]
        self.score[i], self.id[i], self.no_id[i] = score[order], ids[order], no_id[order]
        if len(order) == self.k:
            self.kth[i] = self.score[i][-1]


def search_block(items: Items, values: np.ndarray, ids: np.ndarray, no_id: np.ndarray, best: Best) -> int:
    """Bring ``best`` up to date with the documents ``values`` (rows of coordinates); the number of scored pairs."""
    if not len(values) or not len(items.place):
        return 0
    # Documents with the same strongest coordinate lie together.
    order = np.lexsort((values.max(axis=1), values.argmax(axis=1)))
    values, ids, no_id = values[order], ids[order], no_id[order]
    levels = doc_levels(values)
    i_leaves, d_leaves = leaf_pairs(items, levels, best.kth)
    scored = 0
    for leaf in np.unique(i_leaves):
        own = d_leaves[i_leaves == leaf]
        for i in range(leaf * ITEM_LEAF, min((leaf + 1) * ITEM_LEAF, len(items.weights))):
            columns, weight = items.weights[i]
            bound = levels[0][np.ix_(own, columns)] @ weight
            near = own[(bound > 0) & (bound >= best.kth[i])]
            rows = (near[:, None] * DOC_LEAF + np.arange(DOC_LEAF)).ravel()
            rows = rows[rows < len(values)]
            score = values[np.ix_(rows, columns)] @ weight
            scored += len(rows)
            good = (score > 0) & (score >= best.kth[i])
            if good.any():
                best.add(i, score[good], ids[rows[good]], no_id[rows[good]])
    return scored


def coordinates(items: Items, texts: list[bytes | None]) -> np.ndarray:
    """One row of coordinates per text."""
    row, column, times, factor = [], [], [], []
    for r, text in enumerate(texts):
        words = terms_of(text)
        counts = Counter(words)
        own = counts.keys() & items.place.keys()
        if own:
            row += [r] * len(own)
            column += [items.place[t] for t in own]
            times += [counts[t] for t in own]
            factor += [length_factor(len(words), items.documents, items.words)] * len(own)
    values = np.zeros((len(texts), max(1, len(items.place))), dtype=np.int32)
    tf, m = np.array(times, dtype=np.int64), np.array(factor, dtype=np.int64)
    # Below 10^6.
    values[row, column] = 1_000_000_000 * tf // (1000 * tf + 12 * m)
    return values


def _count_spread(docs: DataFrame, vocabulary: frozenset[bytes]) -> tuple[dict[bytes, int], int, int]:
    """Documents per term of the vocabulary, documents with any term, and terms in all documents."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread: Counter = Counter()
        documents = words = 0
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                own = terms_of(text.as_py())
                spread.update(known.value.intersection(own))
                documents += bool(own)
                words += len(own)
        yield pa.RecordBatch.from_arrays([pa.array([*spread, None], pa.binary()), pa.array([*spread.values(), documents], pa.int64()),
                                          pa.array([*[0] * len(spread), words], pa.int64())], names=["term", "docs", "words"])

    rows = (docs.select("text").mapInArrow(run, "term binary, docs long, words long")
            .groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).collect())
    known.unpersist()
    whole = next(((r.docs, r.words) for r in rows if r.term is None), (0, 0))
    return {bytes(r.term): r.docs for r in rows if r.term is not None}, *whole


def _search_group(docs: DataFrame, counts: list[Counter], best: int) -> tuple[DataFrame, Broadcast]:
    """``(item, doc_id, score)``: the best documents of each item, by its place in ``counts``, within each task;
    and what it broadcasts."""
    spread, documents, words = _count_spread(docs, frozenset(t for c in counts for t in c))
    shared = docs.sparkSession.sparkContext.broadcast(Items.of(counts, spread, documents, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        found = Best(len(items.weights), best)
        step = max(DOC_LEAF, CELLS // max(1, len(items.place)))
        held: list[tuple[int | None, bytes | None]] = []

        def search() -> None:
            ids = np.array([0 if i is None else i for i, _ in held], dtype=np.int64)
            search_block(items, coordinates(items, [t for _, t in held]), ids, np.array([i is None for i, _ in held], dtype=bool), found)
            held.clear()

        size = 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                held.append((i, text.as_py()))
                size += len(held[-1][1] or b"")
                if len(held) >= min(step, 1024) or size > 1 << 24:
                    search()
                    size = 0
        if held:
            search()
        n = [len(s) for s in found.score]
        ids = pa.array(np.concatenate([*found.id, np.zeros(0, dtype=np.int64)]), mask=np.concatenate([*found.no_id, np.zeros(0, dtype=bool)]))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(items.keys, dtype=np.int64), n)), ids, pa.array(np.concatenate([*found.score, np.zeros(0, dtype=np.int64)]))],
                                         names=["item", "doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "item long, doc_id long, score long"), shared


def search(docs: DataFrame, items: DataFrame, best: int = BEST, group_terms: int = GROUP_TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``best`` documents of ``docs(doc_id, text)`` for each row of ``items(item_id, text)``.

    Ranks run from 1: highest score, then lowest doc_id, null ids last; scores of 0 are left out. Repeated rows of
    ``docs`` are ranked each on their own. Items that agree in id and text are one; items that share an id (null too) but not
    the text are searched apart. Null texts have no terms. Other columns have no influence.
    """
    spark = docs.sparkSession

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [Counter(terms_of(t.as_py())) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([list(c) for c in own], pa.list_(pa.binary())),
                                              pa.array([list(c.values()) for c in own], pa.list_(pa.int64()))], names=["item_id", "text", "terms", "times"])

    asked = items.select("item_id", "text").distinct()
    schema = T.StructType([*asked.schema, T.StructField("terms", T.ArrayType(T.BinaryType())), T.StructField("times", T.ArrayType(T.LongType()))])
    asked = checkpoint(asked.mapInArrow(counted, schema).where(F.size("terms") > 0))
    groups = -(-(asked.agg(F.sum(F.size("terms")).alias("n")).first().n or 0) // group_terms)
    dealt = asked.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, groups))))
    found = None
    for part in range(groups):
        rows = dealt.where(F.col("part") == part).orderBy("item_id", "text").select("item_id", "terms", "times").collect()
        local, shared = _search_group(docs, [Counter({bytes(t): n for t, n in zip(r.terms, r.times, strict=True)}) for r in rows], best)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
        names = spark.createDataFrame([(k, r.item_id) for k, r in enumerate(rows)], asked.select(F.lit(0).cast("long").alias("item"), "item_id").schema)
        own = checkpoint(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"))
        shared.unpersist()
        found = own if found is None else found.unionByName(own)
    if found is None:
        return asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    return found


def search_sql(best: int = BEST) -> str:
    """The search of ``benchmark`` in ``documents``, every pair with a shared term scored."""
    words = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
    return f"""
    WITH q AS (SELECT row_number() OVER () AS item, item_id, {words} AS words FROM (SELECT DISTINCT item_id, text FROM benchmark)),
    asked AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(words) AS term FROM q) GROUP BY ALL),
    d AS (SELECT row_number() OVER () AS k, doc_id, {words} AS words FROM documents),
    whole AS (SELECT count(*) AS n_docs, sum(len(words))::BIGINT AS n_words FROM d WHERE len(words) > 0),
    tf AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(words) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
    weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term, n_docs),
    factor AS (SELECT k, doc_id, 100 - 25 + (25 * len(words) * n_docs) // n_words AS m FROM d, whole),
    scores AS (SELECT item, item_id, k, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
               FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN factor USING (k) GROUP BY ALL),
    ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
               FROM scores WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {best}
    """
