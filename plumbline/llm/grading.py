"""Document quality by histogram gradient-boosted trees over statistics of the text.

A text becomes a fixed row of statistics: shares of kinds of bytes, lengths, shapes and repeats of words, word pairs and
lines. Labelled rows are dealt to ``MEMBERS`` samples of bounded size; a task per sample bins each statistic by its
quantiles and grows trees of least logistic loss from histograms of gradients, so that members are fitted side by side
and the driver sees only finished trees. All trees are flattened into arrays (statistic, threshold, left, right, value)
and walked by numpy for a batch of rows and all trees at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.language import held_out
from plumbline.llm.words import grams, hash_words, inside, slices

#: Boosted forests, each fitted by a task of its own; the score is their mean in log-odds.
MEMBERS = 4
#: Labelled documents of the rarer class that a member must have; with fewer there are fewer members.
LEAST_PER_MEMBER = 100
#: Labelled documents per class and member that are learned from, in expectation.
SAMPLE_PER_CLASS = 5000
TREES = 60
DEPTH = 4
RATE = 0.15
#: Bins of a statistic, at quantiles of the sample.
BINS = 128
#: Shrinks the value of a leaf; a leaf's share of the curvature must reach LEAST_WEIGHT.
RIDGE = 1.0
LEAST_WEIGHT = 1.0
LEAST_GAIN = 1e-6
THRESHOLD = 0.5

_UPPER, _LOWER, _DIGIT, _SPACE, _NEWLINE, _STOP, _QUOTE, _SYMBOL, _WIDE, _REST = range(10)


def _kinds() -> np.ndarray:
    kind = np.full(256, _SYMBOL)
    kind[ord("A"):ord("Z") + 1] = _UPPER
    kind[ord("a"):ord("z") + 1] = _LOWER
    kind[ord("0"):ord("9") + 1] = _DIGIT
    kind[[9, 11, 12, 13, 32]] = _SPACE
    kind[10] = _NEWLINE
    kind[list(b".,;:?!")] = _STOP
    kind[list(b"'\"()-")] = _QUOTE
    kind[0xC0:] = _WIDE
    # The second and later bytes of a character.
    kind[0x80:0xC0] = _REST
    return kind


_KIND = _kinds()
_LINE = np.ones(256, dtype=bool)
_LINE[10] = False

NAMES = (
    "log_chars", "upper", "lower", "digit", "space", "newline", "stop", "quote", "symbol", "wide",
    "log_words", "word_bytes", "word_spread", "short_words", "long_words", "capitals", "initials", "symbol_end", "no_letter",
    "distinct", "most_frequent", "repeats_last", "distinct_pairs", "most_frequent_pair",
    "log_lines", "line_words", "distinct_lines", "most_frequent_line", "words_per_stop", "exclaims")


def _repeats(hashes: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, and times of the commonest one, per row."""
    if not len(hashes):
        return np.zeros(rows), np.zeros(rows)
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (r[1:] != r[:-1]))))
    times = np.diff(np.append(first, len(h)))
    distinct = np.bincount(r[first], minlength=rows).astype(float)
    most = np.zeros(rows)
    np.maximum.at(most, r[first], times)
    return distinct, most


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``NAMES`` per text of a column; null counts as empty, and an empty text has zeros throughout."""
    found = [_slice_statistics(words) for _, _, words in slices(column)]
    return np.concatenate(found) if found else np.zeros((0, len(NAMES)))


def _slice_statistics(words) -> np.ndarray:
    data, offsets, bounds = words.data, words.offsets, words.bounds
    rows = len(offsets) - 1
    of_byte = np.repeat(np.arange(rows), np.diff(offsets))
    kind = _KIND[data]
    kinds = np.bincount(of_byte * 10 + kind, minlength=rows * 10).reshape(rows, 10).astype(float)
    chars = kinds.sum(1) - kinds[:, _REST]
    share = kinds[:, :_REST] / np.maximum(chars, 1)[:, None]

    number = np.diff(bounds).astype(float)
    some = np.maximum(number, 1)
    of_word = np.repeat(np.arange(rows), np.diff(bounds))
    size = (words.ends - words.starts).astype(float)

    def per_word(values: np.ndarray) -> np.ndarray:
        return np.bincount(of_word, weights=values, minlength=rows) / some

    def run(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(mask, out=total[1:])
        return total[words.ends] - total[words.starts]

    small = run((kind == _LOWER) | (kind == _WIDE))
    upper = run(kind == _UPPER)
    first, last = (kind[words.starts], kind[words.ends - 1]) if len(size) else (np.zeros(0), np.zeros(0))
    mean = per_word(size)
    distinct, most = _repeats(words.hashes, of_word, rows)
    again = np.zeros(len(size))
    if len(size) > 1:
        again[1:] = (words.hashes[1:] == words.hashes[:-1]) & (of_word[1:] == of_word[:-1])
    pair = inside(bounds, 2)
    pairs, most_pair = _repeats(grams(words.hashes, 2)[pair], of_word[:-1][pair] if len(of_word) else of_word, rows)
    some_pairs = np.maximum(number - 1, 1)
    lines = hash_words(data, offsets, _LINE)
    of_line = np.repeat(np.arange(rows), np.diff(lines.bounds))
    n_lines = np.diff(lines.bounds).astype(float)
    some_lines = np.maximum(n_lines, 1)
    own_lines, most_line = _repeats(lines.hashes, of_line, rows)
    stops = kinds[:, _STOP]
    exclaims = np.bincount(of_byte, weights=data == ord("!"), minlength=rows)
    return np.column_stack([
        np.log1p(chars), share,
        np.log1p(number), mean, np.sqrt(np.maximum(per_word(size * size) - mean * mean, 0)),
        per_word(size <= 3), per_word(size >= 16), per_word((upper > 1) & (small == 0)), per_word(first == _UPPER),
        per_word(last == _SYMBOL), per_word(small + upper == 0),
        distinct / some, most / some, per_word(again), pairs / some_pairs, most_pair / some_pairs,
        np.log1p(n_lines), number / some_lines, own_lines / some_lines, most_line / some_lines,
        number / (stops + 1), exclaims / np.maximum(chars, 1)])


@dataclass
class Forest:
    """Trees as arrays over all nodes. A leaf points to itself, so every walk may take ``depth`` steps."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def margin(self, x: np.ndarray, depth: int = DEPTH) -> np.ndarray:
        """Log-odds of every row of ``x``: all rows walk down all trees at once."""
        if not len(self.roots):
            return np.full(len(x), self.base)
        node = np.repeat(self.roots[None, :], len(x), axis=0)
        row = np.arange(len(x))[:, None]
        for _ in range(depth):
            node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.base + self.value[node].sum(1)


def quantile_edges(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Inner bounds of the bins of each column: the largest value of each bin but the last."""
    edges = []
    for column in x.T:
        seen = np.sort(column)
        picked = np.unique(seen[(np.arange(1, bins) * len(seen)) // bins]) if len(seen) else seen
        edges.append(picked[picked < seen[-1]] if len(seen) else picked)
    return edges


def best_split(binned: np.ndarray, node: np.ndarray, nodes: int, g: np.ndarray, h: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, feature, bin) of the best cut of each node from histograms; rows of bins up to the bin go left.

    Ties go to the first feature, then the lowest bin. A gain of 0 means that no cut is allowed.
    """
    best = np.zeros(nodes)
    feature, cut = np.zeros(nodes, dtype=np.int64), np.zeros(nodes, dtype=np.int64)
    all_g, all_h = np.bincount(node, g, nodes), np.bincount(node, h, nodes)
    whole = all_g ** 2 / (all_h + RIDGE)
    for f in range(binned.shape[1]):
        place = node * bins + binned[:, f]
        left_g = np.bincount(place, g, nodes * bins).reshape(nodes, bins).cumsum(1)
        left_h = np.bincount(place, h, nodes * bins).reshape(nodes, bins).cumsum(1)
        right_g, right_h = all_g[:, None] - left_g, all_h[:, None] - left_h
        gain = left_g ** 2 / (left_h + RIDGE) + right_g ** 2 / (right_h + RIDGE) - whole[:, None]
        gain[(left_h < LEAST_WEIGHT) | (right_h < LEAST_WEIGHT)] = 0
        at = gain.argmax(1)
        top = gain[np.arange(nodes), at]
        better = top > best + LEAST_GAIN
        best[better], feature[better], cut[better] = top[better], f, at[better]
    return best, feature, cut


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Boost trees on rows ``x`` with labels ``y`` (0 or 1)."""
    weight = weight * (len(y) / weight.sum())
    edges = quantile_edges(x)
    binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    bins = max(len(e) for e in edges) + 1
    share = np.clip((weight @ y) / weight.sum(), 1e-6, 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    margin = np.full(len(y), base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def new_node() -> int:
        k = len(feature)
        feature.append(0), threshold.append(np.inf), left.append(k), right.append(k), value.append(0.0)
        return k

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * p * (1 - p)
        ids = [new_node()]
        roots.append(ids[0])
        node = np.zeros(len(y), dtype=np.int64)
        at = np.full(len(y), ids[0])
        live = np.ones(len(y), dtype=bool)
        for _ in range(depth):
            rows = np.flatnonzero(live)
            if not len(rows):
                break
            gain, by, cut = best_split(binned[rows], node[rows], len(ids), g[rows], h[rows], bins)
            below: list[int] = []
            to = np.full((len(ids), 2), -1)
            for k, own in enumerate(ids):
                if gain[k] > LEAST_GAIN:
                    feature[own], threshold[own] = int(by[k]), float(edges[by[k]][cut[k]])
                    left[own], right[own] = new_node(), new_node()
                    to[k] = len(below), len(below) + 1
                    below += [left[own], right[own]]
            side = (binned[rows, by[node[rows]]] > cut[node[rows]]).astype(int)
            node[rows] = to[node[rows], side]
            live[rows] = node[rows] >= 0
            ids = below
            moved = rows[live[rows]]
            at[moved] = np.array(below, dtype=np.int64)[node[moved]] if below else at[moved]
        total_g, total_h = np.bincount(at, g, len(feature)), np.bincount(at, h, len(feature))
        for k in np.unique(at):
            value[k] = float(-RATE * total_g[k] / (total_h[k] + RIDGE))
        margin += np.array(value)[at]
    return Forest(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(roots), base)


def merge(members: list[Forest]) -> Forest:
    """One forest whose log-odds are the mean of the members'."""
    start = np.cumsum([0, *(len(m.feature) for m in members)])
    return Forest(
        np.concatenate([m.feature for m in members]), np.concatenate([m.threshold for m in members]),
        np.concatenate([m.left + s for m, s in zip(members, start, strict=False)]),
        np.concatenate([m.right + s for m, s in zip(members, start, strict=False)]),
        np.concatenate([m.value for m in members]) / len(members),
        np.concatenate([m.roots + s for m, s in zip(members, start, strict=False)]), float(np.mean([m.base for m in members])))


def _constant(share: float) -> Forest:
    none = np.zeros(0)
    share = min(max(share, 1e-9), 1 - 1e-9)
    return Forest(none, none, none, none, none, none, float(np.log(share / (1 - share))))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE_PER_CLASS, members: int = MEMBERS) -> Forest | None:
    """Learn ``labels(doc_id, <label>)`` from the texts of ``docs(doc_id, text)``.

    Null ids and labels are ignored; a document labelled twice counts as 1 if one label says so, and among rows of one
    id one speaks for all. With one class only, the forest is a constant; None without any label.
    """
    one = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
           .agg((F.max(label) > 0).cast("int").alias("y")))
    counts = {r.y: r.n for r in one.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    if len(counts) < 2:
        return _constant(float(min(counts)))
    members = max(1, min(members, min(counts.values()) // LEAST_PER_MEMBER))
    rate = {y: min(1.0, members * sample / counts[y]) for y in (0, 1)}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(1_000_000))
    drawn = one.where(draw < F.when(F.col("y") == 1, int(1_000_000 * rate[1])).otherwise(int(1_000_000 * rate[0])))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(2))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(NAMES), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat], names=["doc_id", "y", "x"])

    # ``drawn`` has about 2 x members x sample rows of two numbers; one row of statistics per id is shuffled.
    examples = (docs.join(F.broadcast(drawn), "doc_id").select("doc_id", "y", "text")
                .mapInArrow(measure, "doc_id long, y int, x array<double>")
                .groupBy("doc_id").agg(F.max(F.struct("y", "x")).alias("row"))
                .select(F.pmod(F.xxhash64("doc_id", F.lit(43)), F.lit(members)).cast("int").alias("member"), "doc_id", "row.y", "row.x"))

    def member(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by("doc_id")
        y = rows.column("y").to_numpy().astype(float)
        x = np.array(rows.column("x").to_pylist())
        weight = np.where(y == 1, 1 / rate[1], 1 / rate[0])
        m = grow(x, y, weight) if 0 < y.sum() < len(y) else _constant(float(y.mean()))
        one_row = [[rows.column("member")[0].as_py()], [m.feature.tolist()], [m.threshold.tolist()], [m.left.tolist()], [m.right.tolist()],
                   [m.value.tolist()], [m.roots.tolist()], [m.base]]
        return pa.table([pa.array(v, t) for v, t in zip(one_row, kinds, strict=True)], names=names)

    ints, reals = pa.list_(pa.int64()), pa.list_(pa.float64())
    names = ["member", "feature", "threshold", "left", "right", "value", "roots", "base"]
    kinds = [pa.int32(), ints, reals, ints, ints, reals, ints, pa.float64()]
    fitted = examples.groupBy("member").applyInArrow(
        member, "member int, feature array<long>, threshold array<double>, left array<long>, right array<long>, value array<double>, "
                "roots array<long>, base double")
    rows = sorted(fitted.collect(), key=lambda r: r.member)
    forests = [Forest(np.array(r.feature, dtype=np.int64), np.array(r.threshold), np.array(r.left, dtype=np.int64), np.array(r.right, dtype=np.int64),
                      np.array(r.value), np.array(r.roots, dtype=np.int64), r.base) for r in rows if r.roots]
    return merge(forests) if forests else _constant(counts[1] / (counts[0] + counts[1]))


def predict(docs: DataFrame, model: Forest | None, keep: tuple[str, ...] = ("doc_id", "held_out"), threshold: float = THRESHOLD) -> DataFrame:
    """The columns ``keep`` of ``docs(text, ...)`` with ``score`` and ``predicted``. Without a model every score is 0.

    Every row is scored by its whole text alone; null counts as empty. A given ``score`` or ``predicted`` may not be kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Forest | None = shared.value
        for batch in batches:
            x = statistics(batch.column(batch.num_columns - 1))
            score = 1 / (1 + np.exp(-np.clip(m.margin(x), -50, 50))) if m else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=schema.names)

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def grade_documents(docs: DataFrame, labels: DataFrame, parts: int = 3, part: int = 1) -> DataFrame:
    """Fit on the labels outside the held-out part, score every row of ``docs(doc_id, text)``.

    ``(doc_id, held_out, score, predicted)``, one row per row of ``docs``, repeated ids included. A null id counts as held
    out. Other columns of either table have no influence.
    """
    marked = docs.select("doc_id", "text", held_out(F.col("doc_id"), parts, part).alias("held_out"))
    learn = labels.select("doc_id", "quality").where(~held_out(F.col("doc_id"), parts, part))
    return predict(marked, fit(marked.where("not held_out"), learn))
