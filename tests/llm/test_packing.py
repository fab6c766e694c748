"""Optimal boundaries against all plans, and batches that hold their budget."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from plumbline.llm.packing import boundaries, pack


def padding(tops, lengths, counts):
    return sum(n * (min(t for t in tops if t >= x) - x) for x, n in zip(lengths, counts))


def test_boundaries_are_optimal():
    pick = random.Random(1)
    for _ in range(150):
        lengths = sorted(pick.sample(range(1, 60), pick.randrange(1, 9)))
        counts = [pick.randrange(1, 50) for _ in lengths]
        k = pick.randrange(1, 6)
        best = min(padding([*c, lengths[-1]], lengths, counts) for r in range(min(k, len(lengths))) for c in combinations(lengths[:-1], r))
        tops = boundaries(lengths, counts, k)
        assert len(tops) <= k and tops == sorted(set(tops)) and tops[-1] == lengths[-1]
        assert padding(tops, lengths, counts) == best
    assert boundaries([], [], 4) == []


def check(rows, lengths, longest, budget):
    whole, batches = {}, {}
    for r in rows:
        whole.setdefault(r.doc_id, []).append(r)
        if r.n_tokens:
            batches.setdefault((r.bucket_tokens, r.batch), []).append(r.n_tokens)
    for doc, n in lengths.items():
        own = sorted(whole[doc], key=lambda r: r.piece)
        assert sum(r.n_tokens for r in own) == n and [r.first_token for r in own] == [k * longest for k in range(len(own))]
        assert all(r.n_tokens <= longest for r in own) and (n > 0 or own[0].batch is None)
    tops = sorted({t for t, _ in batches})
    for (top, _), own in batches.items():
        assert len(own) <= max(1, budget // top) and max(own) <= top and min(own) > max([0, *(t for t in tops if t < top)])
    for top in tops:
        sizes = [len(batches[top, b]) for b in range(sum(t == top for t, _ in batches))]
        assert all(n == max(1, budget // top) for n in sizes[:-1])


def test_real_documents(spark, monkeypatch):
    monkeypatch.setattr("plumbline.llm.packing.SHARD_ROWS", 100)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lengths = {r.doc_id: len(r.text.split()) for r in docs.collect()}
    check(pack(docs, longest=512, buckets=8, budget=4096).collect(), lengths, 512, 4096)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "w " * 100_000), (None, "a b"), (5, "a b c"), (5, "a b c"), (6, "éè")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int")
    got = pack(docs).collect()
    assert sum(r.n_tokens for r in got) == 100_000 + 2 + 6 + 1 and sum(r.n_tokens == 0 for r in got) == 3
    assert pack(docs.limit(0)).collect() == []
    own = pack(docs.select("doc_id", F.lit(None).cast("string").alias("text")), length=F.lit(7)).collect()
    assert {(r.n_tokens, r.bucket_tokens, r.batch) for r in own} == {(7, 7, 0)}
