"""How far the sources of a language differ in their words: an exact, integer audit of every pair of sources.

Per language the terms in at least ``LEAST_DOCS`` documents are kept. A group is a (language, source); its share of a term
is ``p = 1 + floor(10^9 (count + 1) / (N + V))``, and the divergence of p from q is ``floor((p - q)^2 / q)``, summed over all
kept terms for a pair of sources, absent terms included.

Kept terms get ids as they are counted; ids are cut into ranges. A pair task takes the sorted (term id, count) arrays of
two groups over one range, finds the ids in both by galloping the shorter array through the longer, and prices what
overlaps, what only one has, and how many terms the two cover, in both directions; terms that neither has all cost the
same and are added by number at the end. Pair tasks of ``TILE`` by ``TILE`` groups share one co-group, so that an array is
shuffled once per tile of partners and not once per partner. A group of any size is spread over the ranges. Sums fit 64
bits, because the shares of a group add up to 10^9 + 2 V at most.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import checkpoint

SCALE = 1_000_000_000
LEAST_DOCS = 3
TOP = 200
#: Groups on each side of one co-group of pair tasks.
TILE = 32
#: Entries that a task holds before it hands them on.
HELD = 200_000
#: Rows of (group, term), about, in one range of ids.
RANGE = 1 << 18


def _folding() -> bytes:
    """A-Z in lower case, other letters and bytes beyond ASCII as they are, the rest white space."""
    return bytes(b + 32 if ord("A") <= b <= ord("Z") else b if b >= 128 or ord("a") <= b <= ord("z") else 32 for b in range(256))


_FOLDING = _folding()


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences ``n`` and documents ``docs`` per (lang, source, term), summed over parts of the rows."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    entries = 0

    def out() -> pa.RecordBatch:
        group = np.repeat(np.arange(len(held)), [len(n) for n, _ in held.values()])
        names = [pa.array([g[k] for g in held], pa.string()).take(pa.array(group)) for k in (0, 1)]
        terms = pa.array([t for n, _ in held.values() for t in n], pa.binary()).cast(pa.string())
        # Both counters of a group met its terms for the first time in different orders.
        docs = [d[t] for n, d in held.values() for t in n]
        return pa.RecordBatch.from_arrays([*names, terms, pa.array([x for n, _ in held.values() for x in n.values()], pa.int64()), pa.array(docs, pa.int64())],
                                          names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
            words = (text.as_py() or b"").translate(_FOLDING).split()
            times, docs = held.setdefault((lang, source), (Counter(), Counter()))
            entries -= len(times)
            times.update(words)
            docs.update(set(words))
            entries += len(times)
            if entries > HELD:
                yield out()
                held.clear()
                entries = 0
    if entries:
        yield out()


def kept_terms(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """``(lang, source, term, n, lang_n, tid, first)`` of ``docs(lang, source, text)``, one row per group and kept term in it.

    ``lang_n`` counts the term in the whole language; ``tid`` names (lang, term) and rises within a partition; ``first``
    marks one row of each term. Written as a table, so that the ids stay what they are.
    """
    counted = (docs.mapInArrow(_count_terms, "lang string, source string, term string, n long, docs long")
               .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    term = Window.partitionBy("lang", "term")
    kept = counted.select("lang", "source", "term", "n", F.sum("n").over(term).alias("lang_n"), F.sum("docs").over(term).alias("df")).where(F.col("df") >= least)
    rows = kept.withColumn("row", F.monotonically_increasing_id()).withColumn("tid", F.min("row").over(term))
    return checkpoint(rows.select("lang", "source", "term", "n", "lang_n", "tid", (F.col("row") == F.col("tid")).alias("first")))


def share(count: str, total: str) -> Column:
    """``1 + floor(10^9 (count + 1) / total)`` of two columns, by long division: no product exceeds 1000 times the total."""
    rest, parts = f"({count} + 1L)", []
    for step in range(4):
        times = 1000 if step else 1
        parts.append(f"(({rest} * {times}L) div {total}) * {10 ** (9 - 3 * step)}L")
        rest = f"(({rest} * {times}L) % {total})"
    return F.expr("1L + " + " + ".join(parts))


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """The same on an array."""
    rest = counts.astype(np.int64) + 1
    whole, rest = rest // total, rest % total
    for _ in range(3):
        whole, rest = whole * 1000 + rest * 1000 // total, rest * 1000 % total
    return whole + 1


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``floor((p - q)^2 / q)``."""
    return (p - q) * (p - q) // q


@dataclass
class Run:
    """The terms of one group in one range: sorted ids, shares, the share of an absent term, and the distinct shares."""

    ids: np.ndarray
    p: np.ndarray
    absent: np.ndarray
    values: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, counts: np.ndarray, total: int) -> Run:
        order = np.argsort(ids, kind="stable")
        p = shares(counts[order], total)
        return cls(ids[order], p, shares(np.zeros(1, dtype=np.int64), total), *np.unique(p, return_counts=True))


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in both arrays of the values they share; both are sorted and have no repeats.

    A search for rising values starts where the last one ended, so the cost follows the shorter array.
    """
    at = np.searchsorted(long, short)
    hit = np.flatnonzero(at < len(long))
    hit = hit[long[at[hit]] == short[hit]]
    return hit, at[hit]


def merge(a: Run, b: Run) -> tuple[int, int, int]:
    """Prices of ``a`` from ``b`` and of ``b`` from ``a`` over the terms that either has, and the number of these terms."""
    if len(a.ids) <= len(b.ids):
        in_a, in_b = gallop(a.ids, b.ids)
    else:
        in_b, in_a = gallop(b.ids, a.ids)
    pa_, pb = a.p[in_a], b.p[in_b]

    def only(run: Run, both: np.ndarray, other: np.ndarray, back: bool) -> int:
        """Over the terms of one group that the other lacks: all its terms but those in both."""
        def cost(p):
            return price(other, p) if back else price(p, other)

        return int(run.times @ cost(run.values)) - int(cost(both).sum())

    ab = int(price(pa_, pb).sum()) + only(a, pa_, b.absent, False) + only(b, pb, a.absent, True)
    ba = int(price(pb, pa_).sum()) + only(b, pb, a.absent, False) + only(a, pa_, b.absent, True)
    return ab, ba, len(a.ids) + len(b.ids) - len(in_a)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lang, range, place, tid, n)`` rows -> ``(lang, range, place, ids, counts)``, one row per group and range in a part of the rows."""
    held, rows = [], 0

    def out() -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        lang = t.column("lang").combine_chunks().dictionary_encode()
        code, part, place, tid, n = (np.asarray(c) for c in (lang.indices, *(t.column(k) for k in ("range", "place", "tid", "n"))))
        order = np.lexsort((tid, place, part, code))
        code, part, place = code[order], part[order], place[order]
        cut = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (part[1:] != part[:-1]) | (place[1:] != place[:-1]))))
        bounds = pa.array(np.append(cut, len(order)), pa.int32())
        lists = [pa.ListArray.from_arrays(bounds, pa.array(v[order], pa.int64())) for v in (tid, n)]
        return pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(code[cut])), pa.array(part[cut]), pa.array(place[cut], pa.int32()), *lists],
                                          names=["lang", "range", "place", "ids", "counts"])

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= HELD:
            yield out()
            held, rows = [], 0
    if rows:
        yield out()


def _runs(side: pa.Table) -> dict[int, Run]:
    """The arrays of each group of a tile. The row without a place lists the groups and their totals: some have no term here."""
    totals, found = {}, {}
    for place, ids, counts in zip(side.column("place").to_pylist(), side.column("ids"), side.column("counts"), strict=True):
        if place is None:
            totals.update(zip(ids.as_py(), counts.as_py(), strict=True))
        else:
            found.setdefault(place, []).append((np.asarray(ids.values), np.asarray(counts.values)))
    none = (np.zeros(0, dtype=np.int64),) * 2
    return {k: Run.of(*(np.concatenate(x) for x in zip(*found.get(k, [none]), strict=True)), total) for k, total in sorted(totals.items())}


def _pair_tasks(left: pa.Table, right: pa.Table) -> pa.Table:
    """All unordered pairs of a tile, or of one tile with another, over one range of terms."""
    lows = _runs(left)
    highs = _runs(right) if right.num_rows else lows
    rows = [(i, k, *merge(lows[i], highs[k])) for i in lows for k in highs if i < k]
    lang = left.column("lang")[0].as_py()
    columns = [[r[k] for r in rows] for k in range(5)]
    return pa.table([pa.array([lang] * len(rows), pa.string()), *(pa.array(c, pa.int32()) for c in columns[:2]), *(pa.array(c, pa.int64()) for c in columns[2:])],
                    names=["lang", "a", "b", "ab", "ba", "covered"])


def _dealt(parts: DataFrame, low: bool) -> DataFrame:
    """Each row of a tile to every pair of tiles in which its tile is the lower (or the higher) one; a tile meets itself once."""
    partner = F.sequence(F.col("tile"), F.col("tiles") - 1) if low else F.when(F.col("tile") > 0, F.sequence(F.lit(0), F.col("tile") - 1))
    dealt = parts.withColumn("partner", F.explode(partner))
    return dealt.select("lang", "range", F.least("tile", "partner").alias("low"), F.greatest("tile", "partner").alias("high"), "place", "ids", "counts")


def pair_sums(terms: DataFrame, groups: DataFrame, tile: int = TILE, size: int = RANGE) -> DataFrame:
    """``(lang, a, b, ab, ba, covered)`` per pair of places ``a < b`` with kept terms in the language.

    ``terms`` is as of ``kept_terms``; ``groups(lang, source, place, total, groups)`` numbers the groups of a language from
    0 and has their number. ``ab`` prices group a from group b over the ``covered`` terms that either has.
    """
    tiles = F.ceil(F.col("groups") / tile).cast("int").alias("tiles")
    at = F.floor(F.col("place") / tile).cast("int").alias("tile")
    rows = terms.join(groups.select("lang", "source", "place"), ["lang", "source"])
    packed = rows.select("lang", F.floor(F.col("tid") / size).alias("range"), "place", "tid", "n").mapInArrow(
        _pack, "lang string, range long, place int, ids array<long>, counts array<long>")
    number = groups.select("lang", tiles).distinct()
    chunks = packed.join(number, "lang").withColumn("tile", F.floor(F.col("place") / tile).cast("int"))
    roster = (groups.select("lang", at, tiles, "place", "total").groupBy("lang", "tile", "tiles")
              .agg(F.sort_array(F.collect_list(F.struct("place", "total"))).alias("own")))
    ranges = terms.select("lang", F.floor(F.col("tid") / size).alias("range")).distinct()
    listed = ranges.join(roster, "lang").select(
        "lang", "range", F.lit(None).cast("int").alias("place"), F.col("own.place").cast("array<long>").alias("ids"), F.col("own.total").alias("counts"), "tiles", "tile")
    parts = chunks.unionByName(listed)
    keys = ["lang", "range", "low", "high"]
    lows, highs = _dealt(parts, True), _dealt(parts, False)
    # Both sides come from one plan: new names for the columns of one keep them apart.
    sums = (lows.groupBy(*keys).cogroup(highs.toDF(*highs.columns).groupBy(*keys))
            .applyInArrow(_pair_tasks, "lang string, a int, b int, ab long, ba long, covered long"))
    return sums.groupBy("lang", "a", "b").agg(*(F.sum(c).alias(c) for c in ("ab", "ba", "covered")))


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, tile: int = TILE, size: int = RANGE) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` of ``docs(lang, source, text)``.

    Part ``pair`` has a row per group and other source of its language, part ``term`` the ``top`` terms that a group uses more
    than its language. Null columns count as '', repeated rows count again, a group without terms takes part, and in a
    language without kept terms all pairs cost 0. Ranks run from 1, ties in byte order of the item. Other columns have no
    influence.
    """
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    terms = kept_terms(docs, least)
    langs = terms.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("v"), F.sum("n").alias("lang_total"))
    own = terms.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    one = Window.partitionBy("lang")
    # One row per group; everything below joins it by language, and Spark broadcasts it only while it is small.
    groups = checkpoint(docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", (F.row_number().over(one.orderBy("source")) - 1).cast("int").alias("place"), F.count("*").over(one).alias("groups"),
        F.coalesce("v", F.lit(0)).alias("v"), (F.coalesce("own", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("total"),
        (F.coalesce("lang_total", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("lang_total")))

    used = terms.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), share("n", "total").alias("p"), share("lang_n", "lang_total").alias("q"))
    used = used.where("p > q").select("lang", "source", "item", F.expr("((p - q) * (p - q)) div q").alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    used = used.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    sums = pair_sums(terms, groups.where("v > 0"), tile, size)
    a = groups.select("lang", F.col("source").alias("source_a"), F.col("place").alias("a"), F.col("total").alias("total_a"), "v")
    b = groups.select("lang", F.col("source").alias("source_b"), F.col("place").alias("b"), F.col("total").alias("total_b"))
    # As many rows as the result has pairs.
    pairs = a.join(b, "lang").where("a < b").join(sums, ["lang", "a", "b"], "left")
    none = F.lit(0).cast("long")
    pairs = pairs.select("lang", "source_a", "source_b", *(F.coalesce(c, none).alias(c) for c in ("ab", "ba")), (F.col("v") - F.coalesce("covered", none)).alias("absent"),
                         *(F.when(F.col("v") > 0, share("0L", f"total_{k}")).otherwise(1).alias(f"p_{k}") for k in ("a", "b")))
    square = "(p_a - p_b) * (p_a - p_b)"
    both = F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item"), F.expr(f"ab + absent * (({square}) div p_b)").alias("value")),
                   F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"), F.expr(f"ba + absent * (({square}) div p_a)").alias("value")))
    paired = pairs.select("lang", F.explode(both).alias("x")).select("lang", "x.*").withColumn("rank", F.row_number().over(by_value))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return (paired.withColumn("part", F.lit("pair")).select(*columns)
            .unionByName(used.withColumn("part", F.lit("term")).select(*columns)))


def audit_sql() -> str:
    """The audit of ``documents``, every share of every group and term written out."""
    return rf"""
    WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
    seen AS (SELECT row_number() OVER () AS k, * FROM d),
    by_doc AS (SELECT lang, source, k, term, count(*) AS n FROM (SELECT lang, source, k, unnest(words) AS term FROM seen) GROUP BY ALL),
    of_lang AS (SELECT lang, term, sum(n)::BIGINT AS n FROM by_doc GROUP BY ALL HAVING count(*) >= {LEAST_DOCS}),
    of_group AS (SELECT b.lang, b.source, b.term, sum(b.n)::BIGINT AS n FROM by_doc b JOIN of_lang USING (lang, term) GROUP BY ALL),
    langs AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS total FROM of_lang GROUP BY ALL),
    groups AS (SELECT g.lang, g.source, coalesce(v, 0) AS v,
                      coalesce((SELECT sum(o.n) FROM of_group o WHERE o.lang = g.lang AND o.source = g.source), 0)::BIGINT AS total
               FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN langs USING (lang)),
    p AS (SELECT g.lang, g.source, t.term, coalesce(o.n, 0) AS n,
                 1 + (1000000000::HUGEINT * (coalesce(o.n, 0) + 1)) // (g.total + g.v) AS p,
                 1 + (1000000000::HUGEINT * (t.n + 1)) // (l.total + l.v) AS lang_p
          FROM groups g JOIN langs l USING (lang) JOIN of_lang t ON t.lang = g.lang
          LEFT JOIN of_group o ON o.lang = g.lang AND o.source = g.source AND o.term = t.term),
    prices AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
               FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
              FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN prices x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
    terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - lang_p) * (p - lang_p)) // lang_p)::BIGINT AS value
              FROM p WHERE n > 0 AND p > lang_p),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
               FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
    SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
    """
