"""Near duplicates of embeddings by E8 lattice hashing.

Each table projects a unit vector to eight random directions, scales it, and takes the nearest point of the lattice E8 as
its cell. A vector stands in its own cell and asks in the nearest other cells as well. Vectors that meet in a cell are
compared by cosine in double precision. Scale and number of tables follow from the number of vectors, so that cells
stay small, and from the recall wanted at the threshold itself, which is estimated from random pairs.

A pair is counted in the first table and cell where it meets, so links are counted without listing pairs: tasks return
sums per vector and a spanning forest of the links. Equal vectors are compared once. Cells of more than ``BLOCK``
rows are cut into blocks, and each pair of blocks is a group of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import components
from plumbline.llm.words import mix
from plumbline.session import checkpoint

THRESHOLD = 0.95
RECALL = 0.98
PROBES = 3
#: Vectors per cell, about, that unrelated data would have.
CELL = 64
BLOCK = 1024

_U = np.uint64


def nearest(points: np.ndarray) -> np.ndarray:
    """Twice the nearest E8 lattice point of each row of eight numbers."""
    def even(y: np.ndarray) -> np.ndarray:
        near = np.rint(y)
        off = y - near
        odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
        worst = np.abs(off[odd]).argmax(axis=1)
        near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
        return near

    whole, half = even(points), even(points - 0.5) + 0.5
    closer = ((points - half) ** 2).sum(axis=1) < ((points - whole) ** 2).sum(axis=1)
    return (2 * np.where(closer[:, None], half, whole)).astype(np.int64)


@lru_cache(1)
def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (1, -1):
                for b in (1, -1):
                    v = [0.0] * 8
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        if bits.bit_count() % 2 == 0:
            out.append([-0.5 if bits >> k & 1 else 0.5 for k in range(8)])
    return np.array(out)


@lru_cache(64)
def _directions(table: int, size: int) -> np.ndarray:
    return np.random.default_rng([table, size, 8]).standard_normal((size, 8))


def cells(units: np.ndarray, table: int, scale: float) -> np.ndarray:
    """Hashes of the own cell and of the nearest other cells of each unit vector (rows x (1 + PROBES))."""
    size = units.shape[1]
    points = units @ _directions(table, size) * scale
    own = nearest(points)
    closest = np.argsort(-(points - own / 2) @ _roots().T, axis=1, kind="stable")[:, :PROBES]
    spots = np.concatenate([own[:, None, :], own[:, None, :] + (2 * _roots()[closest]).astype(np.int64)], axis=1)
    key = np.full(spots.shape[:2], table * 100_003 + size, dtype=np.uint64)
    for k in range(8):
        key = mix(key * _U(0x9E3779B97F4A7C15) + spots[:, :, k].astype(np.uint64))
    return key.view(np.int64)


def plan(vectors: int, threshold: float, recall: float = RECALL) -> tuple[float, int]:
    """(scale, tables) for so many vectors; the chance that a pair at the threshold meets is estimated from 4000 pairs."""
    scale = max(0.5, (max(1, vectors) / CELL) ** 0.125 / math.sqrt(4 * math.pi))
    pick = np.random.default_rng(88)
    a = pick.standard_normal((4000, 8)) * scale
    b = threshold * a + math.sqrt(1 - threshold ** 2) * pick.standard_normal((4000, 8)) * scale
    own_a, own_b = nearest(a), nearest(b)

    def reached(points, own, other):
        closest = np.argsort(-(points - own / 2) @ _roots().T, axis=1, kind="stable")[:, :PROBES]
        return ((own[:, None, :] + 2 * _roots()[closest] - other[:, None, :]) == 0).all(axis=2).any(axis=1)

    met = (own_a == own_b).all(axis=1) | reached(a, own_a, own_b) | reached(b, own_b, own_a)
    chance = min(0.999, max(1e-3, float(met.mean())))
    return scale, max(2, math.ceil(math.log(1 - recall) / math.log(1 - chance)))


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.frombuffer(b"".join(column.to_pylist()), np.float64)
    return flat.reshape(len(column), -1)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, cls, vector): vectors as bytes of doubles, null where they cannot be compared."""
    for batch in batches:
        packed, names = [], []
        for v in batch.column(1).to_pylist():
            x = np.array(v if v and None not in v else [], dtype=np.float64)
            good = len(x) and np.isfinite(x).all() and x.any()
            packed.append((x + 0.0).tobytes() if good else None)
            if good:
                words = (x + 0.0).view(np.uint64)
                spin = mix(np.arange(len(x), dtype=np.uint64) + _U(len(x)))
                names.append(int(mix((mix(words) * (spin | _U(1))).sum(dtype=np.uint64).reshape(1))[0].view(np.int64)))
            else:
                names.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.int64()), pa.array(packed, pa.binary())], names=["vec_id", "cls", "vector"])


def _spread(tables: int, scale: float):
    """One row per vector and cell; ``asks`` is false in the own cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column(2).to_pylist()])
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                units = unit(_matrix(part.column(2)))
                for table in range(tables):
                    keys = cells(units, table, scale)
                    for k in range(1 + PROBES):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys[:, k]), pa.array(np.full(len(part), table, np.int32)), pa.array(np.full(len(part), k > 0)), *part.columns],
                            names=["cell", "table", "asks", "cls", "copies", "vector"])
    return run


def _compared(threshold: float, scale: float):
    """Links of the groups of one partition, in order: rows (a, b, null) of a forest, and (a, null, links)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def links() -> Iterator[pa.RecordBatch]:
            block, table, asks, cls, copies = (np.array(x) for x in list(zip(*held, strict=True))[:5])
            vectors = unit(np.frombuffer(b"".join(h[5] for h in held), np.float64).reshape(len(held), -1))
            own = np.flatnonzero(~asks)
            other = np.argsort(asks, kind="stable")
            parents = {int(c): int(c) for c in cls}
            total = dict.fromkeys(parents, 0)
            forest = []

            def find(x: int) -> int:
                while parents[x] != x:
                    parents[x] = x = parents[parents[x]]
                return x

            lowest, highest = group[1], group[2]
            for at in range(0, len(own), 256):
                rows = own[at:at + 256]
                near = (vectors[rows] @ vectors[other].T) >= threshold
                x, y = np.nonzero(near)
                i, j = rows[x], other[y]
                keep = (cls[i] != cls[j]) & ((asks[j]) | (cls[i] < cls[j]))
                if lowest != highest:
                    keep &= block[i] != block[j]
                i, j = i[keep], j[keep]
                if not len(i):
                    continue
                t = int(table[0])
                for u in range(t + 1):
                    used = np.unique(np.concatenate([i, j]))
                    keys = cells(vectors[used], u, scale)
                    a, b = keys[np.searchsorted(used, i)], keys[np.searchsorted(used, j)]
                    same = a[:, 0] == b[:, 0]
                    a_in_b = (b[:, 1:] == a[:, :1]).any(axis=1)
                    b_in_a = (a[:, 1:] == b[:, :1]).any(axis=1)
                    if u < t:
                        fresh = ~(same | a_in_b | b_in_a)
                    else:
                        # In its first table a pair counts in the shared own cell, else in that of the smaller one.
                        fresh = np.where(asks[j], ~same & (~b_in_a | (cls[i] < cls[j])), True)
                    i, j = i[fresh], j[fresh]
                    if not len(i):
                        break
                for a, b, m, n in zip(cls[i].tolist(), cls[j].tolist(), copies[i].tolist(), copies[j].tolist(), strict=True):
                    total[a] += n
                    total[b] += m
                    p, q = find(a), find(b)
                    if p != q:
                        parents[q] = p
                        forest.append((a, b))
            counted = [(c, n) for c, n in total.items() if n]
            a = [x for x, _ in forest] + [c for c, _ in counted]
            b = [y for _, y in forest] + [None] * len(counted)
            n = [None] * len(forest) + [n for _, n in counted]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "links"])

        for batch in batches:
            for cell, low, high, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # Vectors of other sizes never share a cell but by a clash of hashes.
                key = (cell, low, high, len(row[5]))
                if key != group:
                    if len(held) > 1:
                        yield from links()
                    group, held = key, []
                held.append(row)
        if len(held) > 1:
            yield from links()
    return run


def near_vectors(table: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``table(vec_id, embedding)``.

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing, and so do vectors
    of another length. Equal vectors link with each other and with the same others. A null ``vec_id`` has a null
    component and is not kept, but counts as a link of others; rows that repeat a ``vec_id`` are vectors of their own.
    """
    rows = checkpoint(table.select("vec_id", F.col("embedding").cast("array<double>")).mapInArrow(_pack, "vec_id long, cls long, vector binary"))
    kinds = checkpoint(rows.where("cls is not null").groupBy("cls", "vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least")))
    scale, tables = plan(kinds.count(), threshold)
    spread = kinds.select("cls", "copies", "vector").mapInArrow(
        _spread(tables, scale), "cell long, table int, asks boolean, cls long, copies long, vector binary")
    spread = checkpoint(spread)
    sizes = (spread.groupBy("cell").agg(F.count("*").alias("rows"), F.sum(F.when(F.col("asks"), 0).otherwise(1)).alias("own"))
             .where("rows > 1 and own > 0").select("cell", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks")))
    groups = (spread.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("cls", "asks"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("cell", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "table", "asks",
                      "cls", "copies", "vector"))
    found = checkpoint(groups.repartition("cell", "low", "high").sortWithinPartitions("cell", "low", "high", F.length("vector"))
                       .mapInArrow(_compared(threshold, scale), "a long, b long, links long"))
    counts = found.where("links is not null").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    roots = components(found.where("b is not null").select("a", "b"))
    named = (kinds.select("cls", "copies", "least").join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left")
             .withColumn("root", F.coalesce("root", "cls")))
    smallest = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(smallest, "root").join(counts, "cls", "left").select("cls", "component", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    component = F.when(F.col("vec_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "vec_id")).cast("long")
    return (rows.join(named, "cls", "left")
            .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))
