"""Sparse merges against dense sums, tiles and ranges against a plain audit, bounds of the arithmetic, odd rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm.divergence import SCALE, Run, audit, gallop, merge, share, shares

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(rows, least=3, top=200):
    """The audit by plain loops over every group, term and pair."""
    spread, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        g = lang or "", source or ""
        groups.add(g)
        own = terms_of(text)
        counts[g].update(own)
        spread[g[0]].update(set(own))
    out = []
    for lang in {g[0] for g in groups}:
        kept = {t for t, n in spread[lang].items() if n >= least}
        v = len(kept)
        own = {s: Counter({t: n for t, n in counts[lang, s].items() if t in kept}) for x, s in groups if x == lang}
        whole = sum(own.values(), Counter())

        def p(c, t, v=v):
            return 1 + SCALE * (c[t] + 1) // (sum(c.values()) + v)

        for s, c in own.items():
            pairs = [(sum((p(c, t) - p(d, t)) ** 2 // p(d, t) for t in kept), o) for o, d in own.items() if o != s]
            used = [((p(c, t) - p(whole, t)) ** 2 // p(whole, t), t) for t in c if p(c, t) > p(whole, t)]
            for part, found in (("pair", pairs), ("term", used)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_long_division_is_exact(spark):
    pick = random.Random(2)
    cases = [(0, 1), (0, 7), (6, 7), (9, 10), (10**15 - 1, 10**15), *((pick.randrange(t), t) for t in (pick.randrange(1, 10**15) for _ in range(200)))]
    want = [1 + SCALE * (c + 1) // t for c, t in cases]
    assert [int(shares(np.array([c]), t)[0]) for c, t in cases] == want
    assert [r.p for r in spark.createDataFrame(cases, "c long, t long").coalesce(1).select(share("c", "t").alias("p")).collect()] == want


def test_a_merge_equals_the_dense_sum():
    rng = np.random.default_rng(1)
    for size in (0, 1, 5, 400):
        dense = rng.integers(0, 4, (2, 500)) * (rng.random((2, 500)) < (size / 500, 0.3)[0:2][0])
        dense[1] = rng.integers(0, 50, 500) * (rng.random(500) < 0.4)
        totals = [int(d.sum()) + 500 for d in dense]
        runs = [Run.of((ids := rng.permutation(np.flatnonzero(d))), d[ids], t) for d, t in zip(dense, totals, strict=True)]
        ab, ba, covered = merge(*runs)
        p = [shares(d, t).astype(object) for d, t in zip(dense, totals, strict=True)]
        seen = dense.any(axis=0)
        assert covered == seen.sum()
        assert ab == sum((p[0] - p[1])[seen] ** 2 // p[1][seen]) and ba == sum((p[1] - p[0])[seen] ** 2 // p[0][seen])
        assert merge(runs[1], runs[0]) == (ba, ab, covered)
    left, right = gallop(np.array([3, 9, 40]), np.array([1, 3, 4, 40]))
    assert left.tolist() == [0, 2] and right.tolist() == [1, 3]


def test_tiles_and_ranges_change_nothing(spark):
    pick = random.Random(7)
    words = [f"{a}{b}" for a in "abcdeéß" for b in "xyzñ"]
    # One source holds a third of the rows, and there are more sources than fit two tiles.
    rows = [(pick.choice(["en", "de"]), f"s{0 if pick.random() < .33 else pick.randrange(9)}", " ".join(pick.choices(words, k=pick.randrange(9)))) for _ in range(150)]
    want = plain(rows)
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    for tile, size in ((32, 1 << 18), (2, 16), (1, 50)):
        assert rows_of(audit(docs, tile=tile, size=size)) == want
    assert rows_of(audit(docs, least=1, top=2)) == plain(rows, 1, 2)


def test_odd_rows(spark):
    rows = [
        (None, None, None), (None, "", "one two"), ("", "b", "one"), ("", "c", "ONE two1two"), ("", "c", "one two"),
        # No term is kept here, and a language of one group has no pair.
        ("xx", "a", "rare"), ("xx", "b", ""), ("xx", "c", None), ("yy", "only", "w " * 50_000), ("yy", "only", "w"), ("yy", "only", "w w"),
        # Ties and repeated rows; letters of A-Z only are folded.
        *[("zz", s, "É é aBé Abé ß漢字-x") for s in "ppqqrr"],
    ]
    docs = spark.createDataFrame([(*r, 1, "t") for r in rows], "lang string, source string, text string, n long, term string")
    assert rows_of(audit(docs)) == plain(rows)
    found = audit(docs)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert {r.value for r in found.where("lang = 'xx' and part = 'pair'").collect()} == {0}
    assert audit(docs.limit(0)).collect() == [] and found.where(F.col("lang").isNull()).count() == 0
