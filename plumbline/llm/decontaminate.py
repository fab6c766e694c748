"""Benchmark decontamination: n-gram seeds, then local alignment.

1. Every word n-gram of an item is a seed, so an edited or partial copy is met by whatever n-grams it has left.
2. One scan of the documents finds seeds, gathers those of one item that lie on neighbouring diagonals, and aligns the
   item's words with the passage around them (Smith-Waterman), unless too few of its words occur there for the score.
3. An item is found in a document if its best alignment reaches ``LEAST_SCORE`` of the score of a full copy.

Items are taken in groups of at most ``GROUP_GRAMS`` n-grams, so what a task or the driver holds is bounded however
large the benchmark; documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from plumbline.llm.words import LETTERS, Words, grams, slices

GRAM = 3
#: Least n-grams of an item for it to be searched: shorter ones say too little.
LEAST_GRAMS = 3
LEAST_SEEDS = 2
LEAST_SCORE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words by which a passage may be longer than its item, on either side, as a share of the item.
MARGIN = 0.3
GROUP_GRAMS = 1_000_000

_TABLE_BITS = 22
_SHIFT = np.uint64(64 - _TABLE_BITS)


@dataclass
class Items:
    """Benchmark items of one group: words of item i are ``words[bounds[i]:bounds[i + 1]]``."""

    ids: list[int | None]
    words: np.ndarray
    bounds: np.ndarray


class Seeds:
    """Looks up n-gram hashes; ``places`` lists (item, position) of the n-gram at each index of ``hashes``."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        self.table[(hashes >> _SHIFT).astype(np.int64)] = True

    def find(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in ``runs``, index of the seed) of all hits."""
        at = np.flatnonzero(self.table[(runs >> _SHIFT).astype(np.int64)])
        if not len(at) or not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        index = np.minimum(np.searchsorted(self.hashes, runs[at]), len(self.hashes) - 1)
        same = self.hashes[index] == runs[at]
        return at[same], index[same]


def _slices(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """Slices of words in lower case, cut at white space and ASCII punctuation."""
    return slices(pc.utf8_lower(column), LETTERS)


def item_grams(items: Items, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, item, position) of every n-gram of every item that has enough of them."""
    runs = grams(items.words, size)
    counts = np.diff(items.bounds)
    item = np.repeat(np.arange(len(items.ids)), counts)
    place = np.arange(len(items.words)) - np.repeat(items.bounds[:-1], counts)
    n = len(runs)
    ok = (place[:n] + size <= counts[item[:n]]) & (counts[item[:n]] - size + 1 >= LEAST_GRAMS)
    return runs[ok], item[:n][ok], place[:n][ok]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """(score, first word, end word) of the best local alignment of ``item`` in ``passage``."""
    width = len(passage)
    steps = np.arange(1, width + 1)
    # Each row keeps scores and, for the way back, where in the passage the best alignment ending there began.
    score, begin = np.zeros(width + 1, dtype=np.int64), np.arange(width + 1)
    best = (0, 0, 0)
    for word in item:
        step = np.where(passage == word, MATCH, MISMATCH)
        over, down = score[:-1] + step, score[1:] + GAP
        top = np.maximum(over, down)
        origin = np.where(over >= down, begin[:-1], begin[1:])
        origin = np.where(top > 0, origin, steps)
        top = np.maximum(top, 0)
        # A gap in the item: the best earlier column of this row, less one per column passed.
        level = (top - GAP * steps) * (width + 1) + (width - steps + 1)
        lead = np.maximum.accumulate(level)
        source = width - lead % (width + 1)
        across = lead // (width + 1) + GAP * steps
        better = across > top
        score = np.concatenate([[0], np.where(better, across, top)])
        begin = np.concatenate([[0], np.where(better, origin[source], origin)])
        k = int(score.argmax())
        if score[k] > best[0]:
            best = (int(score[k]), int(begin[k]), k)
    return best


def _groups(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark in groups of bounded size, each of whole items."""
    ids, words, total = [], [], 0
    for row in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        text = pa.array([row.text], pa.string())
        own = next(_slices(text))[2].hashes
        if words and total + len(own) > GROUP_GRAMS:
            yield Items(ids, np.concatenate(words), np.cumsum([0, *map(len, words)]))
            ids, words, total = [], [], 0
        ids.append(row.item_id)
        words.append(own)
        total += len(own)
    if words:
        yield Items(ids, np.concatenate(words), np.cumsum([0, *map(len, words)]))


@dataclass
class Index:
    """Seeds of one group of items."""

    items: Items
    hashes: np.ndarray
    firsts: np.ndarray
    item: np.ndarray
    place: np.ndarray
    enough: np.ndarray


def build(benchmark: DataFrame, size: int = GRAM) -> Iterator[Index]:
    """The seed indexes of all groups of items."""
    for items in _groups(benchmark):
        hashes, item, place = item_grams(items, size)
        if not len(hashes):
            continue
        order = np.argsort(hashes, kind="stable")
        own, firsts = np.unique(hashes[order], return_index=True)
        yield Index(items, own, np.append(firsts, len(order)), item[order], place[order],
                    np.minimum(LEAST_SEEDS, np.bincount(item, minlength=len(items.ids))))


def passages(index: Index, seeds: Seeds, words: np.ndarray, size: int = GRAM) -> list[tuple[int, float, int, int]]:
    """(item, score, first word, end word) of the items found in one text."""
    at, hit = seeds.find(grams(words, size))
    if len(at) < 1:
        return []
    times = index.firsts[hit + 1] - index.firsts[hit]
    spot = np.repeat(at, times)
    entry = np.repeat(index.firsts[hit] - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
    item, diagonal = index.item[entry], spot - index.place[entry]
    order = np.lexsort((diagonal, item))
    item, diagonal = item[order], diagonal[order]
    lengths = np.diff(index.items.bounds)
    slack = np.maximum(2, (lengths[item] * MARGIN).astype(np.int64))
    new = np.ones(len(item), dtype=bool)
    new[1:] = (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > slack[1:])
    cuts = np.flatnonzero(new)
    found: dict[int, tuple[int, float, int, int]] = {}
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(item)], strict=True):
        i = int(item[a])
        if b - a < index.enough[i]:
            continue
        n, room = int(lengths[i]), int(slack[a])
        own = index.items.words[index.items.bounds[i]:index.items.bounds[i + 1]]
        low, high = max(0, int(diagonal[a]) - room), min(len(words), int(diagonal[b - 1]) + n + room)
        # No alignment matches more of the item's words than occur in the passage.
        if np.isin(own, words[low:high]).sum() < LEAST_SCORE * n:
            continue
        score, first, end = align(own, words[low:high])
        share = score / (MATCH * n)
        if share >= LEAST_SCORE and (i not in found or share > found[i][1]):
            found[i] = (i, share, low + first, low + end)
    return [found[i] for i in sorted(found)]


def find_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, score, first_word, end_word)``: the best alignment of each item found in each document.

    Words are cut at white space and punctuation and compared in lower case. ``score`` is 1 for a full copy. Null and empty texts hold
    nothing; items of fewer than 5 words, null or empty are never found; equal items are each reported; rows
    that repeat a document are reported each. Without items or documents the result is empty.
    """
    schema = "doc_id long, item_id long, score double, first_word int, end_word int"
    cast = docs.sparkSession.sparkContext.broadcast
    out = None
    for index in build(benchmark):
        shared = cast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, seeds = shared.value, Seeds(shared.value.hashes)
            for batch in batches:
                ids, rows = batch.column(0).to_pylist(), []
                for first, _, words in _slices(batch.column(1)):
                    for k, (a, b) in enumerate(zip(words.bounds[:-1], words.bounds[1:], strict=True)):
                        rows += [(ids[first + k], own.items.ids[i], *rest) for i, *rest in passages(own, seeds, words.hashes[a:b])]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
                columns = zip(*rows, strict=True) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                                 names=["doc_id", "item_id", "score", "first_word", "end_word"])

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, all columns kept. Same cases as ``find_items``."""
    cast = docs.sparkSession.sparkContext.broadcast
    place = docs.columns.index("text")
    for index in build(benchmark):
        shared = cast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, seeds = shared.value, Seeds(shared.value.hashes)
            for batch in batches:
                keep = []
                for _, _, words in _slices(batch.column(place)):
                    keep += [not passages(own, seeds, words.hashes[a:b]) for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
