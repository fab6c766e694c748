"""The parity-sketch join against all pairs of a small corpus."""

import random

import numpy as np
import pytest

from plumbline.llm.jaccard import block_keys, differing, gram_sets, hamming, similar_components, sketch
from plumbline.llm.words import slices

WORD = __import__("re").compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if 0 < len(words) < size:
        return {tuple(words)}
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}


def expected(rows, size, percent):
    sets = {i: shingles(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Ärger", "naïve", "日本", "x y"]
    passage = [pick.choice(words) for _ in range(60)]
    rows = []
    for family in range(12):
        base = [pick.choice(words) for _ in range(pick.choice([3, 5, 9, 30, 120, 400]))]
        if family % 3 == 0:
            base = base[:60] + passage
        for _ in range(pick.choice([1, 4, 14])):
            copy = [pick.choice(words) if pick.random() < pick.choice([0, .01, .03]) else w for w in base]
            rows.append(pick.choice([" ", "\n", "\t "]).join(copy))
    rows += ["", None, "   ", "one", "ONE", "One two", "one two", "a b c d", "A b C d", " a b\x0bc d "]
    pick.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_like_all_pairs(spark, size, percent):
    rows = corpus(size)
    got = similar_components(spark.createDataFrame(rows, "doc_id long, text string"), size, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected(rows, size, percent)
    assert len(got) == len(rows)


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_components(docs, 4, 85).collect()}
    assert got == expected([tuple(r) for r in docs.collect()], 4, 85)


def test_odd_rows(spark):
    rows = [(None, "a b c d e"), (7, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (9, None), (8, "é" * 300_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component_id int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in similar_components(df).collect()), key=str)
    assert got == sorted([(None, 1, None), (7, 1, 3), (3, 1, 3), (3, 1, 3), (9, 0, 9), (8, 1, 8)], key=str)
    assert similar_components(df.limit(0)).collect() == []


def test_sketches_bound_the_difference():
    import pyarrow as pa
    pick = random.Random(5)
    a = " ".join(str(pick.randrange(10 ** 6)) for _ in range(700))
    b = " ".join(w for w in a.split() if pick.random() < .97)
    x, y = gram_sets(next(slices(pa.array([a, b])))[2], 4)
    apart = len(np.setxor1d(x, y))
    assert hamming(sketch(x), sketch(y)) <= apart
    assert differing(100, 100, 85) == 16


@pytest.mark.parametrize("percent", [80, 85])
def test_linked_sets_share_as_many_keys_as_they_need(percent):
    rng = np.random.default_rng(percent)
    for n in [*range(1, 40), *rng.integers(40, 900, 120).tolist()]:
        for _ in range(12 if n < 40 else 2):
            universe = rng.integers(0, 1 << 63, 2 * n + 2, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 2 * n + 2, dtype=np.uint64)
            less, more = rng.integers(0, n // 4 + 1), rng.integers(0, n // 4 + 1)
            a, b = universe[:n], np.concatenate((universe[less:n], universe[n:n + more]))
            if len(b) and 100 * (n - less) >= percent * (n + more):
                # In some band, what the two share meets the need of both.
                left, right = ({j: (need, set(keys.tolist())) for j, need, keys in block_keys(np.sort(x), percent)} for x in (a, b))
                assert any(len(left[j][1] & right[j][1]) >= max(1, left[j][0], right[j][0]) for j in left.keys() & right.keys()), (n, less, more)


def test_unlike_sets_share_no_keys():
    rng = np.random.default_rng(1)
    for n in (2, 4, 6, 8, 12, 20, 40):
        keys = [keys for _ in range(20_000) for _, _, keys in block_keys(rng.integers(0, 1 << 63, n, dtype=np.uint64), 80)]
        found, times = np.unique(np.concatenate(keys), return_counts=True)
        # An odd bit in a block of its own may coincide by chance, nothing more.
        assert (times > 1).sum() < 0.02 * len(found) and times.max() <= 4
