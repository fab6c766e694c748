"""Toxicity from the nearest labelled examples.

Features are the words of a text, their beginnings, and levels of how often a beginning occurs. From a bounded sample of labelled examples, features
that go with the label (G-test and lift) are kept and weighted by TF-IDF, with document frequencies over all documents. The
examples lie in inverted lists cut into blocks that know their largest weight; a search visits blocks in the order of
their upper bounds and stops when no block can beat the k-th best, so the cosine ranking is exact. Votes weighted by
similarity are calibrated on the examples themselves, each left out of its own vote.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.language import held_out
from plumbline.session import checkpoint

#: Labelled examples per class that the classifier is fitted on, in expectation.
SAMPLE_PER_CLASS = 4000
LEAST_EXAMPLES = 3
#: Chi-square (1 degree of freedom) that a feature must pass; chance gives one in about 10 million.
LEAST_G = 28.0
#: How many times as frequent a feature must be among examples with the label.
LEAST_LIFT = 4.0
#: Lengths of the beginnings of words that are features, and the counts that are features of their own.
PREFIXES = range(4, 9)
#: Letters of the words by which copies among the examples are told.
FAMILY_WORD = 9
LEVELS = (2, 4, 8)
NEIGHBOURS = 25
BLOCK = 32
THRESHOLD = 0.3

_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None, gate: frozenset[str] | None = None) -> Counter:
    """Counts of the features of a whole text; with a gate, only of words that begin with one of its entries.

    A beginning ends in ``*``; ``ab*#4`` is one that occurs four times or more.
    """
    words = Counter(_WORD.findall((text or "").lower()))
    if gate is not None:
        words = Counter({w: n for w, n in words.items() if w[:PREFIXES[0]] in gate})
    starts: Counter = Counter()
    for word, n in words.items():
        for size in PREFIXES:
            if len(word) > size:
                starts[word[:size] + "*"] += n
    for start, n in starts.items():
        words[start] = n
        for level in LEVELS:
            if n >= level:
                words[f"{start}#{level}"] = 1
    return words


def gate_of(names) -> frozenset[str]:
    return frozenset(f.split("*")[0][:PREFIXES[0]] for f in names)


class BlockMaxIndex:
    """Exact top-k cosine over sparse unit vectors."""

    def __init__(self, vectors: list[dict[int, float]]):
        #: Like vectors stand together, so that the bounds of blocks are tight.
        self.order = sorted(range(len(vectors)), key=lambda i: (max(vectors[i], key=lambda f: (vectors[i][f], f), default=-1), sorted(vectors[i].items())))
        lists: dict[int, dict[int, tuple[list[int], list[float]]]] = {}
        for place, i in enumerate(self.order):
            for f, w in vectors[i].items():
                slots, weights = lists.setdefault(f, {}).setdefault(place // BLOCK, ([], []))
                slots.append(place % BLOCK)
                weights.append(w)
        self.blocks = -(-len(vectors) // BLOCK)
        self.lists = {f: {b: (np.array(s), np.array(w)) for b, (s, w) in own.items()} for f, own in lists.items()}
        self.bounds = {f: (np.array(list(own)), np.array([w.max() for _, w in own.values()])) for f, own in self.lists.items()}

    def search(self, query: dict[int, float], k: int, without: int = -1) -> list[tuple[float, int]]:
        """The k best (cosine, vector) with a cosine over zero, best first; ``without`` is left out."""
        bound = np.zeros(self.blocks)
        for f, w in query.items():
            if f in self.bounds:
                blocks, most = self.bounds[f]
                bound[blocks] += w * most
        best: list[tuple[float, int]] = []
        for b in np.lexsort((np.arange(self.blocks), -bound)).tolist():
            if bound[b] <= 0 or len(best) == k and bound[b] <= best[-1][0]:
                break
            scores = np.zeros(BLOCK)
            for f, w in query.items():
                if (own := self.lists.get(f, {}).get(b)) is not None:
                    scores[own[0]] += w * own[1]
            found = [(float(scores[s]), self.order[b * BLOCK + s]) for s in np.flatnonzero(scores).tolist()]
            best = sorted([*best, *(x for x in found if x[1] != without)], key=lambda x: (-x[0], x[1]))[:k]
        return best


@dataclass
class Model:
    index: BlockMaxIndex
    place: dict[str, int]
    idf: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    ids: list
    base: float
    steps: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(0), np.zeros(0)))

    def vector(self, counts: Counter) -> dict[int, float]:
        own = {self.place[f]: (1 + np.log(n)) * self.idf[self.place[f]] for f, n in counts.items() if f in self.place}
        norm = np.sqrt(sum(w * w for w in own.values()))
        return {f: float(w / norm) for f, w in own.items()}

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of the label among the neighbours, weighted by squared cosine and by the sampling of the class."""
        w = np.array([c * c * self.weight[i] for c, i in near])
        return float((w @ self.label[[i for _, i in near]] + 0.02 * self.base) / (w.sum() + 0.02))

    def score(self, near: list[tuple[float, int]]) -> float:
        return float(np.interp(self.vote(near) if near else 0.0, *self.steps)) if len(self.steps[0]) else self.base


def _rising(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best rising steps through (x, y): pooled neighbours, each shrunk a little to the mean."""
    order = np.argsort(x, kind="stable")
    mean = float(w @ y / w.sum())
    pools: list[list[float]] = []
    for i in order.tolist():
        pools.append([x[i] * w[i], y[i] * w[i], w[i]])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([(p[1] + mean) / (p[2] + 1) for p in pools])


def _g_test(docs: DataFrame, with_label: float, without: float) -> DataFrame:
    """Features that go with the label: ``docs(feature, a, b)`` are examples with and without the label that have it."""
    total = with_label + without
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    n = a + b

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    g = 2 * (part(a, n * (with_label / total)) + part(b, n * (without / total))
             + part(with_label - a, (total - n) * (with_label / total)) + part(without - b, (total - n) * (without / total)))
    return docs.where((n >= LEAST_EXAMPLES) & (a * without >= LEAST_LIFT * b * with_label) & (g >= LEAST_G))


def fit(docs: DataFrame, labels: DataFrame, everything: DataFrame, sample: int = SAMPLE_PER_CLASS) -> Model | None:
    """Learn from ``labels(doc_id, toxic)`` of ``docs(doc_id, text)``; document frequencies come from ``everything``.

    ``sample`` bounds the examples of each class; the driver holds their vectors over the chosen features. Null
    labels are ignored; a document labelled twice is toxic if one label says so. None if a class is missing.
    """
    one = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r.n for r in one.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    rate = {y: min(1.0, sample / counts[y]) for y in (0, 1)}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1_000_000))
    drawn = one.where(draw < F.when(F.col("toxic") == 1, int(1_000_000 * rate[1])).otherwise(int(1_000_000 * rate[0])))
    # At most about 2 x sample rows of two numbers.
    examples = docs.join(F.broadcast(drawn), "doc_id").select("doc_id", "toxic", "text")
    # Near copies mostly share the smallest hash of their long words: one example speaks for all of them.
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: F.length(w) >= FAMILY_WORD)
    family = F.coalesce(F.array_min(F.transform(words, lambda w: F.xxhash64(w))), F.xxhash64("text"))
    examples = checkpoint(examples.groupBy("toxic", family.alias("family")).agg(F.min(F.struct("doc_id", "text")).alias("first"))
                          .select("first.doc_id", "toxic", "first.text"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[y].update(features(text).keys())
            names = sorted({*found[0], *found[1]})
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *(pa.array([found[y][f] for f in names], pa.int64()) for y in (1, 0))], names=["feature", "a", "b"])

    have = {r.toxic: r.n for r in examples.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not have.get(0) or not have.get(1):
        return None
    counted = (examples.select("toxic", "text").mapInArrow(pairs, "feature string, a long, b long")
               .groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    names = sorted(r.feature for r in _g_test(counted, have[1], have[0]).collect())
    cast = docs.sparkSession.sparkContext.broadcast
    known = cast((frozenset(names), gate_of(names)))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        rows = 0
        for batch in batches:
            for text in batch.column(0):
                found.update(known.value[0] & features(text.as_py(), known.value[1]).keys())
                rows += 1
        yield pa.RecordBatch.from_arrays([pa.array([*found, ""]), pa.array([*found.values(), rows])], names=["feature", "n"])

    frequency = {r.feature: r.n for r in everything.select("text").mapInArrow(spread, "feature string, n long")
                 .groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    idf = np.array([np.log(1 + frequency.get("", 0) / max(1, frequency.get(f, 0))) for f in names])

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [[(f, n) for f, n in sorted(features(t, known.value[1]).items()) if f in known.value[0]] for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([[f for f, _ in x] for x in own], pa.list_(pa.string())),
                                              pa.array([[n for _, n in x] for x in own], pa.list_(pa.int64()))], names=["doc_id", "toxic", "f", "n"])

    rows = sorted(((Counter(dict(zip(r.f, r.n, strict=True))), int(r.toxic), r.doc_id)
                   for r in examples.mapInArrow(chosen, "doc_id long, toxic int, f array<string>, n array<long>").collect()),
                  key=lambda x: (sorted(x[0].items()), x[1], x[2]))
    label = np.array([y for _, y, _ in rows], dtype=float)
    weight = np.array([1 / rate[y] for _, y, _ in rows])
    model = Model(None, {f: k for k, f in enumerate(names)}, idf, label, weight, [i for *_, i in rows], float(weight @ label / weight.sum()))
    vectors = [model.vector(c) for c, *_ in rows]
    model.index = BlockMaxIndex(vectors)
    votes = np.array([model.vote(near) if (near := model.index.search(v, NEIGHBOURS, i)) else 0.0 for i, v in enumerate(vectors)])
    model.steps = _rising(votes, label, weight)
    return model


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id", "held_out"), threshold: float = THRESHOLD) -> DataFrame:
    """The columns ``keep`` of ``docs(text, ...)`` with score, predicted, the nearest examples and the terms they share.

    A text without any feature (null and empty ones too) gets the share of the label among such examples. Without
    a model every score is 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = (docs.select(*keep).schema.add("score", "double").add("predicted", "integer")
              .add("neighbours", T.ArrayType(T.LongType())).add("terms", T.ArrayType(T.StringType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = shared.value
        names = list(m.place) if m else []
        gate = gate_of(names)
        for batch in batches:
            scores, neighbours, terms = [], [], []
            for text in batch.column(batch.num_columns - 1):
                query = m.vector(features(text.as_py(), gate)) if m else {}
                near = m.index.search(query, NEIGHBOURS) if query else []
                scores.append(min(1.0, max(0.0, m.score(near))) if m else 0.0)
                neighbours.append([m.ids[i] for _, i in near[:3]])
                terms.append([names[f] for f in sorted(query, key=lambda f: (-query[f], f))[:3]])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()),
                 pa.array(neighbours, pa.list_(pa.int64())), pa.array(terms, pa.list_(pa.string()))], names=schema.names)

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, parts: int = 4, part: int = 2) -> DataFrame:
    """Fit on the labels outside the held-out part, score every row of ``docs(doc_id, text)``."""
    marked = docs.select("doc_id", "text", held_out(F.col("doc_id"), parts, part).alias("held_out"))
    learn = labels.select("doc_id", "toxic").where(~held_out(F.col("doc_id"), parts, part))
    return predict(marked, fit(marked.where("not held_out"), learn, marked))
