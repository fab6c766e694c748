"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum over
all its segmentations into pieces (forward algorithm); that of a text is the product over its words, since no piece
crosses a word. The probabilities are learned by expectation maximisation on a bounded sample of labelled documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import checkpoint

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Documents per language that the model is fitted on, in expectation.
SAMPLE_PER_LANGUAGE = 1000
ROUNDS = 4
#: Weight, in pieces, of the distribution over all languages in that of each language.
SMOOTHING = 50.0
#: Longer words are scored in parts of this many letters.
LONGEST_WORD = 40
#: Words whose scores a task keeps, and numbers in these scores (fewer words if there are many languages).
CACHED_WORDS = 400_000
CACHED_SCORES = 16_000_000
#: Characters of text, and words, that are looked at together.
SLICE_CHARS = 400_000
SLICE_WORDS = 5_000
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")
_START = "▁"
_LENGTHS = 64
#: Words of a lower probability in some language are summed in logarithms, which cannot underflow.
_LEAST = 1e-200


def read_pieces(path: str = VOCABULARY) -> list[str]:
    """The lower-case pieces of letters of a sentencepiece vocabulary; its word mark stays in front."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {p for p in map(model.id_to_piece, range(model.get_piece_size()))
             if p == p.lower() and (p == _START or _WORD.fullmatch(p.removeprefix(_START)))}
    return sorted(found | {_START})


def words_of(text: str) -> Counter:
    """Counts of the words (runs of letters, lower case) of a whole text."""
    found = Counter(_WORD.findall(text.lower()))
    for word in [w for w in found if len(w) > LONGEST_WORD]:
        times = found.pop(word)
        for i in range(0, len(word), LONGEST_WORD):
            found[word[i:i + LONGEST_WORD]] += times
    return found


class Lattice:
    """Finds all pieces in words and sums over segmentations."""

    def __init__(self, pieces: list[str]):
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.single = {p for p in pieces if len(p) == 1}
        self.other = len(pieces)
        for i, piece in enumerate(pieces):
            self.automaton.add_word(piece, i * _LENGTHS + len(piece))
        self.automaton.make_automaton()

    def edges(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """(first node, last node, place in the word of the last node, piece) of all pieces, and each word's nodes."""
        line = _START + _START.join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        begins = np.cumsum(lengths) - lengths
        # Matches go straight into the array: a list of them would cost more than finding them.
        found = np.fromiter(chain.from_iterable(self.automaton.iter(line)), np.int64).reshape(-1, 2)
        end, piece, size = found[:, 0] + 1, found[:, 1] // _LENGTHS, found[:, 1] % _LENGTHS
        strange = {c for c in set(line) if c not in self.single}
        if strange:
            at = np.array([i for i, c in enumerate(line) if c in strange], dtype=np.int64)
            end = np.concatenate([end, at + 1])
            piece = np.concatenate([piece, np.full(len(at), self.other)])
            size = np.concatenate([size, np.ones(len(at), dtype=np.int64)])
        word = np.repeat(np.arange(len(words)), lengths)[end - 1]
        return end - size + word, end + word, end - begins[word], piece, begins + np.arange(len(words)), lengths

    def forward(self, words: list[str], theta: np.ndarray, plus=np.add, times=np.multiply, zero=0.0):
        """Probabilities of all prefixes (nodes x languages) and the parts they were made of; theta: pieces x languages.

        With ``np.logaddexp``, ``np.add`` and minus infinity, ``theta`` and the result are logarithms.
        """
        first, last, place, piece, root, lengths = self.edges(words)
        order = np.lexsort((last, place))
        first, last, place, piece = first[order], last[order], place[order], piece[order]
        alpha = np.full((int(lengths.sum()) + len(words), theta.shape[1]), zero)
        alpha[root] = 1.0 if plus is np.add else 0.0
        cuts = np.searchsorted(place, np.arange(1, int(lengths.max()) + 2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b > a:
                heads = np.flatnonzero(np.diff(last[a:b], prepend=-1))
                alpha[last[a:b][heads]] = plus.reduceat(times(alpha[first[a:b]], theta[piece[a:b]]), heads, axis=0)
        return alpha, (first, last, place, piece), root, lengths

    def log_probabilities(self, words: list[str], theta: np.ndarray) -> np.ndarray:
        alpha, _, root, lengths = self.forward(words, theta)
        ends = alpha[root + lengths]
        out = np.log(np.maximum(ends, _LEAST))
        small = np.flatnonzero((ends < _LEAST).any(axis=1))
        if len(small):
            alpha, _, root, lengths = self.forward([words[k] for k in small], np.log(theta), np.logaddexp, np.add, -np.inf)
            out[small] = alpha[root + lengths]
        return out

    def expected(self, words: list[str], times: np.ndarray, theta: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces; times: words x languages."""
        alpha, parts, root, lengths = self.forward(words, theta)
        ends = alpha[root + lengths]
        small = ends < _LEAST
        # Languages without the word count nothing; what a double cannot hold is left to the sums in logarithms.
        alpha[root + lengths] = np.where(small, 1.0, ends)
        beta = self._backward(parts, root, lengths, theta, np.where(small, 0.0, times) / alpha[root + lengths])
        first, last, _, piece = parts
        out = self._by_piece(piece, alpha[first] * theta[piece] * beta[last])
        rest = np.flatnonzero((small & (times > 0)).any(axis=1))
        if len(rest):
            logs = np.log(theta)
            alpha, parts, root, lengths = self.forward([words[k] for k in rest], logs, np.logaddexp, np.add, -np.inf)
            own = np.where(small[rest], times[rest], 0.0)
            ends = np.full(own.shape, -np.inf)
            np.log(own, out=ends, where=own > 0)
            beta = self._backward(parts, root, lengths, logs, ends - alpha[root + lengths], np.logaddexp, np.add, -np.inf)
            first, last, _, piece = parts
            out += self._by_piece(piece, np.exp(alpha[first] + logs[piece] + beta[last]))
        return out

    def _by_piece(self, piece: np.ndarray, weight: np.ndarray) -> np.ndarray:
        out = np.zeros((self.other + 1, weight.shape[1]))
        for k in range(weight.shape[1]):
            out[:, k] = np.bincount(piece, weight[:, k], minlength=self.other + 1)
        return out

    @staticmethod
    def _backward(parts, root, lengths, theta, ends, plus=np.add, times=np.multiply, zero=0.0) -> np.ndarray:
        """Weights of all suffixes (nodes x languages), from those of the words' ends."""
        first, last, _, piece = parts
        beta = np.full((int(lengths.sum()) + len(lengths), theta.shape[1]), zero)
        beta[root + lengths] = ends
        place = first - np.repeat(root, lengths + 1)[first]
        order = np.lexsort((first, place))
        cuts = np.searchsorted(place[order], np.arange(int(lengths.max()) + 1))
        for a, b in zip(cuts[:-1].tolist()[::-1], cuts[1:].tolist()[::-1], strict=True):
            if b > a:
                own = order[a:b]
                heads = np.flatnonzero(np.diff(first[own], prepend=-1))
                beta[first[own][heads]] = plus.reduceat(times(beta[last[own]], theta[piece[own]]), heads, axis=0)
        return beta


@dataclass
class Model:
    languages: list[str]
    pieces: list[str]
    theta: np.ndarray
    prior: np.ndarray


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(True))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for word, times in words_of(text or "").items():
                found[lang, word] += times
        if found:
            langs, words = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(words), pa.array(list(found.values()), pa.int64())],
                                             names=["lang", "word", "times"])


def fit(labelled: DataFrame, vocabulary: str = VOCABULARY, sample: int = SAMPLE_PER_LANGUAGE, rounds: int = ROUNDS) -> Model:
    """Learn from ``labelled(doc_id, text, lang)``; rows without a language are ignored.

    ``sample`` bounds the documents per language that are read word by word; the driver holds the piece
    probabilities (vocabulary x languages) and one count per language.
    """
    known = labelled.where("lang is not null")
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    pieces = read_pieces(vocabulary)
    prior = np.log(np.array([counts[x] for x in languages], dtype=float) / max(1, sum(counts.values())))
    theta = np.full((len(pieces) + 1, len(languages)), 1.0 / (len(pieces) + 1))
    if not languages:
        return Model(languages, pieces, theta, prior)
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(17)), F.lit(1_000_000))
    rate = F.coalesce(*(F.when(F.col("lang") == x, F.lit(int(1_000_000 * min(1.0, sample / counts[x])))) for x in languages))
    words = checkpoint(known.where(draw < rate).select("lang", "text").mapInArrow(_count_words, "lang string, word string, times long")
                       .groupBy("word", "lang").agg(F.sum("times").alias("times")))
    cast = known.sparkSession.sparkContext.broadcast
    shared = cast(pieces)
    for _ in range(rounds):
        now = cast((languages, theta))

        def expectation(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            names, probabilities = now.value
            place = {x: k for k, x in enumerate(names)}
            lattice, total = Lattice(shared.value), np.zeros_like(probabilities)
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE_WORDS):
                    lang, word, times = (c.to_pylist() for c in batch.slice(at, SLICE_WORDS).columns)
                    own = np.zeros((len(word), len(names)))
                    own[np.arange(len(word)), [place[x] for x in lang]] = times
                    total += lattice.expected(word, own, probabilities)
            row, col = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(col), pa.array(total[row, col])], names=["piece", "lang", "n"])

        sums = (words.select("lang", "word", "times").mapInArrow(expectation, "piece long, lang long, n double")
                .groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas())
        seen = np.zeros_like(theta)
        seen[sums.piece, sums.lang] = sums.n
        pooled = (seen.sum(axis=1) + 0.01) / (seen.sum() + 0.01 * len(seen))
        theta = (seen + SMOOTHING * pooled[:, None]) / (seen.sum(axis=0) + SMOOTHING)
        now.unpersist()
    return Model(languages, pieces, theta, prior)


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id", "held_out")) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``lang_pred`` and ``score``, the posterior of the language.

    The text decides alone. ``und`` with score 0 is for null texts, texts without letters, and every text when
    nothing was learned. Ties go to the first language in alphabetical order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        lattice = Lattice(m.pieces) if m.languages else None
        cache: dict[str, int] = {}
        scores = np.empty((min(CACHED_WORDS, CACHED_SCORES // max(1, len(m.languages))), len(m.languages)))
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            langs, best = [], []
            at = 0
            while at < len(texts):
                counts, chars = [], 0
                while at + len(counts) < len(texts) and (not counts or chars < SLICE_CHARS):
                    text = texts[at + len(counts)].as_py() or ""
                    counts.append(words_of(text) if m.languages else {})
                    chars += len(text)
                at += len(counts)
                fresh = list(set().union(*counts).difference(cache))
                if len(cache) + len(fresh) > len(scores):
                    cache, fresh = {}, list(set().union(*counts))
                    if len(fresh) > len(scores):  # one very long text
                        scores = np.empty((len(fresh), len(m.languages)))
                for k in range(0, len(fresh), SLICE_WORDS):
                    part = fresh[k:k + SLICE_WORDS]
                    scores[len(cache):len(cache) + len(part)] = lattice.log_probabilities(part, m.theta)
                    cache.update(zip(part, range(len(cache), len(cache) + len(part)), strict=True))
                for found in counts:
                    if not found:
                        langs.append(UNKNOWN)
                        best.append(0.0)
                        continue
                    own = np.fromiter(map(cache.__getitem__, found), np.int64, len(found))
                    total = np.fromiter(found.values(), float, len(found)) @ scores[own] + m.prior
                    k = int(total.argmax())
                    langs.append(m.languages[k])
                    best.append(float(1 / np.exp(total - total[k]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(best, pa.float64())],
                                             names=[f.name for f in schema])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def identify(docs: DataFrame, vocabulary: str = VOCABULARY, parts: int = 5, part: int = 0) -> DataFrame:
    """Fit on the rows of ``docs(doc_id, text, lang)`` outside the held-out part, predict all rows."""
    marked = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id"), parts, part).alias("held_out"))
    return predict(marked, fit(marked.where("not held_out"), vocabulary))
