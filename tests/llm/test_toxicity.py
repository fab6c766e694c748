"""Block-max search against brute force, held-out quality and odd rows."""

import random

from plumbline.llm.toxicity import BlockMaxIndex, score_documents


def test_search_is_exact():
    pick = random.Random(1)

    def vector():
        own = {f: pick.random() for f in pick.sample(range(40), pick.randrange(1, 6))}
        norm = sum(w * w for w in own.values()) ** .5
        return {f: w / norm for f, w in own.items()}

    vectors = [vector() for _ in range(500)] + [{}]
    index = BlockMaxIndex(vectors)
    for _ in range(100):
        q, k, out = vector(), pick.randrange(1, 20), pick.randrange(500)
        brute = sorted((-sum(w * v.get(f, 0) for f, w in q.items()), i) for i, v in enumerate(vectors) if i != out)
        want = [-s for s, _ in brute[:k] if s < 0]
        got = [s for s, _ in index.search(q, k, out)]
        assert len(got) == len(want) and all(abs(a - b) < 1e-9 for a, b in zip(got, want))


def test_held_out_quality(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scored = score_documents(docs, labels)
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert scored.count() == docs.count()
    right = sum(r.predicted == 1 and r.toxic == 1 for r in rows)
    assert right >= 0.9 * sum(r.toxic for r in rows) and right >= 0.9 * sum(r.predicted for r in rows)
    assert all(r.neighbours and r.terms for r in rows if r.predicted)


def test_odd_rows(spark):
    rows = [(i, ("you idiot person" if i % 3 == 0 else "a kind person") + f" w{i}") for i in range(120)]
    odd = [(1000, None), (1001, ""), (1002, "IDIOT " * 20_000), (None, "an idiot"), (1003, "kind"), (1003, "kind")]
    docs = spark.createDataFrame([(*r, 1, True) for r in rows + odd], "doc_id long, text string, toxic int, held_out boolean")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(120)] + [(1003, None, 0), (None, 1, 0), (5, 0, 0)], "doc_id long, toxic int, text int")
    found = {}
    for r in score_documents(docs, labels).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, found.values())) == 126 and len(found[1003]) == 2
    assert found[1002][0].predicted == found[None][0].predicted == 1 and found[None][0].held_out
    assert found[1000][0].predicted == found[1001][0].predicted == found[1003][0].predicted == 0
    assert all(r.score == 0 for r in score_documents(docs, labels.limit(0)).collect())
    assert score_documents(docs.limit(0), labels).collect() == []
