"""Secret scan: fixed patterns, and an assignment-aware lexer.

The lexer reads source and configuration syntax as pairs of a name and an expression of literals and other names, keeps
the literals that names stand for (constant propagation), and scores literals by the sensitive words of the names they
reach and by their own shape.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

#: The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "named")

LEAST_SCORE = 0.5
LEAST_LITERAL = 8
_HEAD = 64

_VALUE = r"""(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`|[A-Za-z0-9_$@{(/+][\w$@{}()/+.=~!#%^&*-]*)"""
_PAIR = re.compile(rf"""(?<![\w.$-])(["']?)([A-Za-z_$][\w.-]*+)\1[ \t]*(?::[ \t]*[A-Za-z_][\w\[\]]*[ \t]*=(?!=)|:=|=>|=(?![=>~])|:(?!:))[ \t]*({_VALUE}(?:[ \t]*(?:\+|\.\.?)[ \t]*{_VALUE})*)""")
_PART = re.compile(_VALUE)
_REFERENCE = re.compile(r"\$\{?(?:env\.|var\.|self\.|this\.)?([A-Za-z_][\w.-]*)\}?|([A-Za-z_][\w.]*)(?:\(\))?")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|<.*>|\$?\{.*\}|%.*%|your.*|my.*|some.*|example.*|sample.*|test.*|dummy.*|change.?me.*|replace.*|insert.*|todo.*|none|null|true|false|undefined|"
                          r"redacted.*|placeholder.*|secret|password|token)$")

#: What a word of a name, or two words in a row, say about its value.
_SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "passcode": 0.9, "secret": 1.0, "secrets": 0.9, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "api key": 1.0,
    "private key": 1.0, "access key": 1.0, "secret key": 1.0, "auth key": 1.0, "encryption key": 1.0, "signing key": 1.0, "account key": 0.9,
    "master key": 0.9, "auth": 0.6, "authorization": 0.8, "salt": 0.6, "signature": 0.5, "pin": 0.5}
_HARMLESS = frozenset("max min length len size count limit policy expiry expires expiration ttl timeout url uri path file type name id field label prompt hint "
                      "placeholder regex pattern header format version enabled required reset url public".split())


@dataclass(frozen=True)
class Literal:
    first: int
    end: int
    value: str


def name_score(name: str) -> float:
    """How sensitive a name is, from 0 to 1."""
    words = [w.lower() for w in _WORDS.findall(name)]
    best = max((_SENSITIVE.get(w, 0.0) for w in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]), default=0.0)
    return best * (0.3 if words and words[-1] in _HARMLESS else 1.0)


@dataclass(frozen=True)
class Shape:
    """What the score of a value depends on: counts of its characters, its text if short, else the first and last of it."""

    counts: Counter
    size: int
    head: str
    last: str

    @staticmethod
    def of(value: str) -> Shape:
        return Shape(Counter(value), len(value), value[:_HEAD], value[-1:])

    def __add__(self, other: Shape) -> Shape:
        return Shape(self.counts + other.counts, self.size + other.size, (self.head + other.head)[:_HEAD] if self.size < _HEAD else self.head,
                     other.last or self.last)


def literal_score(value: str | Shape) -> float:
    """How much a literal looks like a generated secret, from 0 to 1."""
    shape = Shape.of(value) if isinstance(value, str) else value
    # The placeholders depend on the beginning, the last character and the set of characters of a longer text.
    text = shape.head if shape.size <= _HEAD else shape.head + "".join(shape.counts) + shape.last
    if shape.size < LEAST_LITERAL or " " in shape.counts or _PLACEHOLDER.match(text):
        return 0.0
    shares = [n / shape.size for n in shape.counts.values()]
    entropy = -sum(x * math.log2(x) for x in shares if x)
    kinds = sum(any(f(c) for c in shape.counts) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in shape.counts)
    return min(1.0, entropy / 3.5) * (1.0 if kinds >= 2 else 0.55)


def pairs(text: str) -> Iterator[tuple[str, list[Literal], Shape]]:
    """(name, distinct literals its value is made of, shape of the value) of all assignments, in order; names stand for what they were given before."""
    known: dict[str, tuple[list[Literal], Shape]] = {}
    for found in _PAIR.finditer(text):
        name, literals, shape = found[2], [], Shape.of("")
        alone = [*_PART.finditer(text, found.start(3), found.end(3))]
        for part in alone:
            value = part[0]
            if value[0] in "\"'`":
                if len(value) > 2:
                    literals.append(Literal(part.start() + 1, part.end() - 1, value[1:-1]))
                    shape += Shape.of(value[1:-1])
                continue
            bare = value.rstrip(";,)")
            reference = _REFERENCE.fullmatch(bare)
            target = reference and (reference[1] or reference[2])
            if target and (target in known or target.rpartition(".")[2] in known):
                own, of = known.get(target) or known[target.rpartition(".")[2]]
                literals += own
                shape += of
            elif len(alone) == 1 and not (reference and (reference[1] or bare.endswith("()"))):
                literals.append(Literal(part.start(), part.start() + len(bare), bare))
                shape += Shape.of(bare)
        if literals:
            # A value may repeat a literal without bound; its spans are at most the literals of the text.
            known[name] = literals, shape = list(dict.fromkeys(literals)), shape
            yield name, literals, shape


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(first, kind, end) of the base kinds, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def named_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Literals that reach a sensitive name and are not within a base span."""
    if "=" not in text and ":" not in text:
        return []
    found = set()
    for name, literals, shape in pairs(text):
        sensitive = name_score(name)
        if sensitive and sensitive * literal_score(shape) >= LEAST_SCORE:
            found.update((x.first, x.end) for x in literals if x.end > x.first)
    return [(a, 3, b) for a, b in sorted(found) if not any(x <= a and b <= y for x, _, y in base)]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find_secrets(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_named)`` of every row of ``docs(doc_id, text)``.

    Spans are ``kind:start:end`` in code points, end exclusive. Null and empty texts have none. Every row is reported,
    repeated ones too; other columns are ignored.
    """
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_named long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [[], [], [], []], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                every = base + named_spans(text, base)
                for k, column in enumerate(counts):
                    column.append(sum(s[1] == k for s in every))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(every))
            kinds = [pa.array(c, pa.int64()) for c in counts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *kinds[:3], pa.array(digests, pa.string()), pa.array(spans, pa.string()), kinds[3]],
                                             names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_named"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
