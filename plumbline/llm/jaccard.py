"""N-gram Jaccard join by parity sketches.

A text's set holds the hashes of its distinct word n-grams. Two sets of sizes a and b with 100 * |A and B| >= p * |A or B|
differ in at most D(a, b) = (100 - p)(a + b) / (100 + p) elements. Each element flips one bit of a sketch, so sketches
of such sets differ in at most D bits; a sketch cut into k > D blocks has k - D equal blocks (pigeonhole). Sizes are
banded, and in each band k is about 1.5 D of the largest sizes.

An empty block is equal in a fixed share of all sets, so only filled blocks give keys. If a set has fewer than k - D empty
blocks, any partner shares a filled one. The few sets that have more are dealt to blocks anew by another hash, and once
more until it holds, and give the keys of every deal: of two linked sets, the one that was done first shares a filled
block of its last deal with the other. Where D is 1 at most (tiny sets), the keys are the set and, for D = 1, the set
without each of its elements. So a key is shared by sets with equal elements only, at any size of the corpus.

1. One scan writes, for each text, its size and a short sketch. Another sends the block keys, packed by hash bucket. A
   set that a task has seen before sends no keys again, so copies are combined before the shuffle. (Two scans cost less
   than keeping the keys of one scan on disk.)
2. Each bucket is sorted and keys of two or more sets stay. A linked pair has k - D equal blocks, so a set with fewer
   shared keys than that, less its empty blocks, has no partner and goes (this removes texts that only share a passage).
3. Each key's smallest set is its hub. Pairs (set, hub) pass the Hamming bound of the short sketches, then the exact
   comparison of the texts' sets. A second round takes another hub for each key, for sets still apart from it.
   Only keys that lie in several components, and sets with enough such keys (as in 2), go on.
4. Keys whose sets still belong to different components are compared completely, in blocks of bounded size: first by
   Hamming distance, and what passes is verified. Keys that hold the same component lie together, so that a pair which
   shares many keys is sent once. So no link between different components is lost, and no pairs
   within a component are made.

Bounds: a task holds one bucket (buckets follow spark.sql.shuffle.partitions), two blocks of sets, or a slice of texts.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import components
from plumbline.llm.words import grams, mix, slices
from plumbline.session import checkpoint

SIZE = 5
PERCENT = 80
BAND_RATIO = 1.6
#: Bits of one block of a sketch; only the odd ones are ever listed.
BLOCK_BITS = 1 << 20
BLOCK_MEMBERS = 512
SKETCH_BITS = 4
#: Pairs that a task remembers so as not to send them again for another key.
PAIRS_KEPT = 200_000
#: Comparisons and rows, about, of one part of the keys that hold the same component.
PART_PAIRS = 1 << 23
PART_ROWS = 20_000
CACHE_TEXTS = 64

_U = np.uint64
_DEAL = _U(0xD1B54A32D192ED03)


def _bands() -> np.ndarray:
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, int(edges[-1] * BAND_RATIO)))
    return np.array(edges, dtype=np.int64)


EDGES = _bands()


def differing(a: int, b: int, percent: int) -> int:
    """The most elements in which linked sets of sizes a and b differ."""
    return (100 - percent) * (a + b) // (100 + percent)


def gram_sets(words, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each row; a row of fewer words is one n-gram, one without words empty."""
    runs = grams(words.hashes, size)
    for first, last in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if last - first >= size:
            yield np.unique(runs[first:last - size + 1])
        elif last > first:
            yield mix(grams(words.hashes[first:last], last - first) + _U(last - first))
        else:
            yield np.zeros(0, dtype=np.uint64)


def sketch(elements: np.ndarray) -> bytes:
    """Parity sketch of at least four bits per element; its length is a power of two."""
    bits = max(64, 1 << int(SKETCH_BITS * len(elements) - 1).bit_length())
    places = (elements >> _U(7)) & _U(bits - 1)
    odd = np.bincount(places.astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def hamming(left: bytes, right: bytes) -> int:
    """Differing bits; the longer sketch is folded to the shorter, which keeps it a parity sketch."""
    a, b, n, m = int.from_bytes(left, "little"), int.from_bytes(right, "little"), 8 * len(left), 8 * len(right)
    while n > m:
        n //= 2
        a = (a >> n) ^ (a & ((1 << n) - 1))
    while m > n:
        m //= 2
        b = (b >> m) ^ (b & ((1 << m) - 1))
    return (a ^ b).bit_count()


def block_keys(elements: np.ndarray, percent: int) -> list[tuple[int, int, np.ndarray]]:
    """(band, least number of keys that a partner shares, keys) for the one or two bands of a set."""
    n = len(elements)
    band = int(np.searchsorted(EDGES, n, side="right")) - 1
    most = 100 * n // percent
    out = []
    for j in [band] + ([band + 1] if most >= EDGES[band + 1] else []):
        top = int(EDGES[j + 1]) - 1
        worst = differing(top, top, percent)
        if worst <= 1:
            whole = elements.sum(dtype=np.uint64).reshape(1)
            cores = np.concatenate((whole, whole - elements)) if worst else whole
            out.append((j, 1, mix(cores + mix(np.array([j << 40], dtype=np.uint64)))))
            continue
        k = worst + (worst + 1) // 2 + 2
        spare = k - differing(n, min(most, top), percent)
        deals: list[np.ndarray] = []
        while True:
            dealt = mix(elements + _U(len(deals)) * _DEAL) if deals else elements
            place, times = np.unique((dealt >> _U(32)) % _U(k) * _U(BLOCK_BITS) + (dealt & _U(BLOCK_BITS - 1)), return_counts=True)
            place = place[times & 1 == 1]
            block = place // _U(BLOCK_BITS)
            first = np.flatnonzero(np.diff(block, prepend=_U(k)))
            total = np.add.reduceat(mix(place + _U(j << 50)), first) if len(first) else place
            deals.append(mix(total + mix(block[first] + _U(j << 40) + _U(len(deals) << 52))))
            if k - len(first) < spare:
                break
        out.append((j, spare - (k - len(deals[0])) if len(deals) == 1 else 1, np.concatenate(deals)))
    return out


_ROW = "doc_id long, tid long, n int, cls long, sketch binary"
_PACKED = "bucket int, keys binary, at binary, sets binary, needs binary, bands binary"
_PACKED_SCHEMA = pa.schema([("bucket", pa.int32()), *((name, pa.binary()) for name in ("keys", "at", "sets", "needs", "bands"))])


def _name(elements: np.ndarray) -> int:
    """A hash of a set."""
    return int(mix(elements.sum(dtype=np.uint64).reshape(1) + _U(len(elements)))[0].view(np.int64))


def _rows(size: int):
    """Size, name and sketch of each text's set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, classes, sketches = [], [], []
            for _, _, words in slices(batch.column(2)):
                for elements in gram_sets(words, size):
                    sizes.append(len(elements))
                    classes.append(_name(elements))
                    sketches.append(sketch(elements) if len(elements) else b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(classes, pa.int64()), pa.array(sketches, pa.binary())],
                names=["doc_id", "tid", "n", "cls", "sketch"])
    return run


def _keys(size: int, percent: int, buckets: int):
    """Block keys packed per bucket, once for each set that a task sees."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, words in slices(batch.column(0)):
                keys, at, sets, needs, bands = [], [], [], [], []
                for elements in gram_sets(words, size):
                    cls = _name(elements)
                    if len(elements) and cls not in seen:
                        seen.add(cls)
                        for band, need, own in block_keys(elements, percent):
                            keys.append(own)
                            at.append(np.full(len(own), len(sets), dtype=np.uint32))
                            sets.append(cls)
                            needs.append(need)
                            bands.append(band)
                if keys:
                    yield _packed(buckets, np.concatenate(keys), np.concatenate(at), np.array(sets, dtype=np.int64),
                                  np.array(needs, dtype=np.int32), np.array(bands, dtype=np.int32))
    return run


def _packed(buckets, keys, at, sets, needs, bands) -> pa.RecordBatch:
    bucket = ((keys >> _U(33)) % _U(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket, keys, at = bucket[order], keys[order], at[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    out = {f.name: [] for f in _PACKED_SCHEMA}
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=True):
        used, where = np.unique(at[a:b], return_inverse=True)
        narrow = np.uint16 if len(used) <= 1 << 16 else np.uint32
        out["bucket"].append(int(bucket[a]))
        out["keys"].append(keys[a:b].tobytes())
        out["at"].append(where.astype(narrow).tobytes())
        out["sets"].append(sets[used].tobytes())
        # A smaller need only lets more sets pass.
        out["needs"].append(np.minimum(needs[used], 65535).astype(np.uint16).tobytes())
        out["bands"].append(bands[used].astype(np.uint8).tobytes())
    return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _PACKED_SCHEMA], schema=_PACKED_SCHEMA)


_MEMBER = "key long, cls long, need int, band int"


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of all keys with two or more sets, in one bucket or several."""
    parts: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        for keys, at, sets, needs, bands in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            where = np.frombuffer(at, np.uint16 if 4 * len(at) == len(keys) else np.uint32)
            parts.append((np.frombuffer(keys, np.uint64), np.frombuffer(sets, np.int64)[where],
                          np.frombuffer(needs, np.uint16).astype(np.int32)[where], np.frombuffer(bands, np.uint8).astype(np.int32)[where]))
    if not parts:
        return
    key, cls, need, band = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = key[1:] == key[:-1]
    often = np.zeros(len(key), dtype=bool)
    often[1:] |= same
    often[:-1] |= same
    order, key = order[often], key[often]
    cls, need, band = cls[order], need[order], band[order]
    order = np.lexsort((cls, key))
    key, cls, need, band = key[order], cls[order], need[order], band[order]
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
    key, cls, need, band = key[fresh], cls[fresh], need[fresh], band[fresh]
    same = key[1:] == key[:-1]
    often = np.zeros(len(key), dtype=bool)
    often[1:] |= same
    often[:-1] |= same
    key, cls, need, band = key[often], cls[often], need[often], band[often]
    for a in range(0, len(key), 100_000):
        b = a + 100_000
        yield pa.RecordBatch.from_arrays([pa.array(key[a:b].view(np.int64)), pa.array(cls[a:b]), pa.array(need[a:b]),
                                          pa.array(band[a:b])], names=["key", "cls", "need", "band"])


def _near(percent: int):
    """Pairs whose sketches differ in no more bits than linked sets may."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, sa, sb = (c.to_pylist() for c in batch.columns)
            keep = [100 * min(x, y) >= percent * max(x, y) and hamming(p, q) <= differing(x, y, percent)
                    for x, y, p, q in zip(na, nb, sa, sb, strict=True)]
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])
    return run


def _verified(size: int, percent: int):
    """Pairs whose sets are similar enough, from the whole texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: OrderedDict[int, np.ndarray] = OrderedDict()

        def elements(cls: int, text: pa.Array) -> np.ndarray:
            if cls in cache:
                cache.move_to_end(cls)
            else:
                cache[cls] = next(gram_sets(next(slices(text))[2], size))
                if len(cache) > CACHE_TEXTS:
                    cache.popitem(last=False)
            return cache[cls]

        for batch in batches:
            keep = []
            for i, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                x, y = elements(a, batch.column(2).slice(i, 1)), elements(b, batch.column(3).slice(i, 1))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])
    return run


def _unlike(percent: int):
    """Pairs of sets of one key that lie in different components and pass the Hamming bound, from two blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members = None, []
        sent: set[tuple[int, int]] = set()

        def pairs() -> pa.RecordBatch:
            found = set()
            if len(sent) > PAIRS_KEPT:
                sent.clear()
            by_root: dict[int, list] = {}
            for member in members:
                by_root.setdefault(member[2], []).append(member)
            before: list = []
            # The largest component comes first, so that its sets meet the others only.
            for own in sorted(by_root.values(), key=len, reverse=True):
                for block, cls, _, n, bits in own:
                    for other, cls2, _, n2, bits2 in before:
                        pair = (cls, cls2) if cls < cls2 else (cls2, cls)
                        if (pair not in sent and (block != other or group[1] == group[2])
                                and 100 * min(n, n2) >= percent * max(n, n2)
                                and hamming(bits, bits2) <= differing(n, n2, percent)):
                            found.add(pair)
                before += own
            sent.update(found)
            a, b = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for key, low, high, *member in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, low, high) != group:
                    if len(members) > 1:
                        yield pairs()
                    group, members = (key, low, high), []
                members.append(tuple(member))
        if len(members) > 1:
            yield pairs()
    return run


def _links(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    left, right = (texts.select(F.col("cls").alias(x), F.col("text").alias(f"text_{x}")) for x in ("a", "b"))
    return (pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
            .mapInArrow(_verified(size, percent), "a long, b long"))


def _placed(members: DataFrame, roots: DataFrame) -> DataFrame:
    found = roots.select(F.col("node").alias("cls"), "root")
    return members.join(found, "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def _apart(placed: DataFrame) -> DataFrame:
    """Members of keys that lie in several components, of sets with enough such keys to have a partner elsewhere."""
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    held = checkpoint(placed.join(mixed, "key", "left_semi"))
    able = held.groupBy("cls", "band").agg(F.count("*").alias("shared"), F.first("need").alias("need")).where("shared >= need")
    return checkpoint(held.join(able.select("cls", "band"), ["cls", "band"], "left_semi"))


def _star(placed: DataFrame, order: Column, classes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between the sets of each key and its hub, the first in ``order``, where the two lie in different components."""
    hubs = placed.groupBy("key").agg(F.min(F.struct(order.alias("order"), F.col("cls").alias("hub"), F.col("root").alias("at"))).alias("first"))
    pairs = (placed.join(hubs, "key").where("root <> first.at")
             .select(F.least("cls", "first.hub").alias("a"), F.greatest("cls", "first.hub").alias("b")).distinct())
    left, right = (classes.select(F.col("cls").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
                   for x in ("a", "b"))
    near = (pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb")
            .mapInArrow(_near(percent), "a long, b long"))
    return checkpoint(_links(near, texts, size, percent))


def _components(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``(doc_id, tid, n, component)`` of every row; ``tid`` is a hash of the text."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    mine = docs.select("doc_id", F.xxhash64("text").alias("tid"), "text")
    rows = checkpoint(mine.mapInArrow(_rows(size), _ROW))
    packed = mine.where("doc_id is not null").select("text").mapInArrow(_keys(size, percent, buckets), _PACKED)
    members = checkpoint(packed.repartitionById(buckets, F.col("bucket")).drop("bucket").mapInArrow(_shared, _MEMBER))
    able = members.groupBy("cls", "band").agg(F.count("*").alias("shared"), F.first("need").alias("need")).where("shared >= need")
    members = checkpoint(members.join(able.select("cls", "band"), ["cls", "band"], "left_semi").select("key", "cls", "band", "need"))

    wanted = members.select("cls").distinct()
    classes = (rows.where("n > 0 and doc_id is not null").groupBy("cls", "n", "sketch")
               .agg(F.min(F.struct("doc_id", "tid")).alias("first")).join(wanted, "cls", "left_semi"))
    classes = checkpoint(classes.select("cls", "n", "sketch", "first.doc_id", "first.tid"))
    texts = checkpoint(mine.join(classes.select("cls", "doc_id", "tid"), ["doc_id", "tid"]).select("cls", "text"))

    links = _star(members.withColumn("root", F.col("cls")), F.col("cls"), classes, texts, size, percent)
    placed = _apart(_placed(members, components(links)))
    more = _star(placed, F.xxhash64("key", "cls"), classes, texts, size, percent)
    links = links.unionByName(more)
    roots = components(links)
    placed = _apart(_placed(placed.drop("root"), roots))
    mixed = (placed.groupBy("key", "root").agg(F.count("*").alias("own")).groupBy("key")
             .agg(F.sum("own").alias("size"), F.max("own").alias("most"), F.min("root").alias("cluster"), F.max("root").alias("last"))
             .where("cluster <> last").select("key", "cluster", "size", "most", F.ceil(F.col("size") / BLOCK_MEMBERS).cast("int").alias("blocks")))
    # Keys of one component hold the same pairs over and over: they go to one task, or to a few by the number of comparisons.
    share = F.col("size") * (F.col("size") - F.col("most")) / PART_PAIRS + F.col("size") * F.col("blocks") / PART_ROWS
    parts = mixed.groupBy("cluster").agg(F.ceil(F.sum(share)).alias("parts"))
    spread = (placed.join(mixed.join(parts, "cluster"), "key").join(classes.select("cls", "n", "sketch"), "cls")
              .withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "cls",
                      "root", "n", "sketch", "cluster", "parts"))
    dealt = spread.withColumn("part", F.pmod(F.xxhash64("key", "low", "high"), F.col("parts"))).repartition("cluster", "part")
    rest = (dealt.sortWithinPartitions("cluster", "part", "key", "low", "high").select("key", "low", "high", "block", "cls", "root", "n", "sketch")
            .mapInArrow(_unlike(percent), "a long, b long").distinct())
    more = checkpoint(_links(rest, texts, size, percent))
    roots = components(links.unionByName(more)) if not more.isEmpty() else roots

    named = (rows.where("n > 0 and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("least"))
             .join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls")))
    smallest = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(smallest, "root").select("cls", "component")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return rows.join(named, "cls", "left").select("doc_id", "tid", "n", component.cast("long").alias("component"))


def similar_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per row of ``docs(doc_id, text)``.

    Null and empty texts and texts without words have an empty set and link with nothing; fewer than ``size`` words
    are one shingle. A null ``doc_id`` takes no part: its component is null. Rows that repeat a ``doc_id`` are linked
    by their own texts and reported once each. Ties do not matter: a component's name is its smallest ``doc_id``.
    Other columns of ``docs`` are ignored.
    """
    return (_components(docs, size, percent)
            .select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id")))


def one_of_each(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)`` that name their group, all columns kept.

    Rows that repeat both id and text are one row; rows of empty texts and of null ids all stay.
    """
    first = (_components(docs, size, percent).where("doc_id = component")
             .groupBy("doc_id", F.col("tid").alias("_tid")).agg(F.first("component").alias("_component")))
    marked = docs.withColumn("_tid", F.xxhash64("text"))
    return (marked.join(first, ["doc_id", "_tid"]).dropDuplicates(["doc_id", "_tid"]).select(*docs.columns)
            .unionByName(docs.where("doc_id is null")))
