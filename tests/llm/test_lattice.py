"""Decoding, recall and counts against brute force."""

import numpy as np
import pytest

from plumbline.llm import lattice as L


def test_nearest_lattice_point():
    y = np.random.default_rng(1).standard_normal((3000, 8)) * 2
    own = L.nearest(y) / 2
    roots = L._roots()
    assert len({tuple(r) for r in roots}) == 240 and np.allclose((roots ** 2).sum(axis=1), 2)
    least = ((y - own) ** 2).sum(axis=1)
    assert least.max() <= 1 + 1e-9
    for r in roots:
        assert (((y - own - r) ** 2).sum(axis=1) >= least - 1e-9).all()
    assert ((own * 2).astype(int) % 2 == (own[:, :1] * 2).astype(int) % 2).all() and (own.sum(axis=1) % 2 == 0).all()


def vectors(seed, n=900, size=64):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, size)) + 2 * rng.standard_normal((10, size))[rng.integers(0, 10, n)]
    for k in range(200, n):
        if rng.random() < .7:
            cos = rng.choice([.94, .951, .955, .96, .98, .999])
            a = base[rng.integers(0, 40 if rng.random() < .5 else k)]
            a = a / np.linalg.norm(a)
            b = rng.standard_normal(size)
            b -= (b @ a) * a
            base[k] = (cos * a + np.sqrt(1 - cos * cos) * b / np.linalg.norm(b)) * rng.uniform(.1, 9)
    base[n - 60:n - 30] = base[0]
    return base.astype(np.float32)


def brute(x, threshold):
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    linked = u @ u.T >= threshold
    np.fill_diagonal(linked, False)
    root = list(range(len(u)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in zip(*np.nonzero(np.triu(linked))):
        p, q = sorted((find(a), find(b)))
        root[q] = p
    return linked.sum(axis=1), [find(i) for i in range(len(u))]


@pytest.mark.parametrize("block", [1024, 16])
def test_recall_and_counts(spark, monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK", block)
    x = vectors(3)
    links, roots = brute(x, .95)
    rows = L.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()
    got = {r.vec_id: r for r in rows}
    assert len(rows) == len(x) and all(got[i].n_links <= links[i] for i in range(len(x)))
    assert sum(r.n_links for r in rows) >= .95 * links.sum()
    assert sum(got[i].component_id == roots[i] for i in range(len(x))) >= .97 * len(x)
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)


def test_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = sorted(((r.vec_id, r.embedding) for r in table.collect()))
    links, roots = brute(np.array([v for _, v in data], dtype=np.float32), .95)
    got = {r.vec_id: (r.n_links, r.component_id) for r in L.near_vectors(table).collect()}
    assert got == {i: (int(n), data[k][0]) for (i, _), n, k in zip(data, links, roots)}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0, 2.0]), (2, [2.0, 0.0, 4.0]), (3, [1.0, -0.0, 2.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]),
            (9, [1.0, None]), (10, [1.0, 0.0]), (None, [1.0, 0.0, 2.0]), (12, [1e300, 0.0, 2e300]), (12, [0.0, 1.0, 0.0]), (13, [-1.0, 0.0, -2.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, component_id int")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in L.near_vectors(df).collect()), key=str)
    want = [(1, 4, 1, True), (2, 4, 1, False), (3, 4, 1, False), (None, 4, None, False), (12, 4, 1, False), (12, 0, 12, True), (13, 0, 13, True), (10, 0, 10, True)]
    want += [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9)]
    assert got == sorted(want, key=str)
    assert L.near_vectors(df.limit(0)).collect() == []
