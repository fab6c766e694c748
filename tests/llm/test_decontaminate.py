"""Seeds and alignment against brute force, and planted copies."""

import random

import numpy as np
import pytest

from plumbline.llm import decontaminate as D


def plain(item, passage):
    """Smith-Waterman cell by cell."""
    h = [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i, x in enumerate(item, 1):
        for j, y in enumerate(passage, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (D.MATCH if x == y else D.MISMATCH), h[i - 1][j] + D.GAP, h[i][j - 1] + D.GAP)
    return max(map(max, h))


def test_alignment_scores():
    pick = random.Random(1)
    for _ in range(200):
        a = [pick.randrange(6) for _ in range(pick.randrange(1, 14))]
        b = [pick.randrange(6) for _ in range(pick.randrange(1, 18))]
        score, first, end = D.align(np.array(a), np.array(b))
        assert score == plain(a, b)
        assert score == 0 or plain(a, b[first:end]) == score


@pytest.fixture(scope="module")
def planted(spark):
    pick = random.Random(2)
    common, rare = ["the", "of", "and", "to"], [f"w{i}" for i in range(3000)]

    def prose(n):
        return [pick.choice(common) if pick.random() < .5 else pick.choice(rare) for _ in range(n)]

    items = [prose(pick.randrange(12, 60)) for _ in range(30)]
    docs, truth = [], set()
    for d in range(200):
        text = prose(pick.randrange(20, 400))
        if d % 4 == 0:
            i = pick.randrange(30)
            copy = [w for w in items[i]]
            if d % 8 == 0:
                for _ in range(len(copy) // 8):
                    k = pick.randrange(len(copy))
                    copy[k:k + 1] = pick.choice([[], [pick.choice(rare)], [copy[k], "of"]])
            at = pick.randrange(len(text))
            text[at:at] = [w.upper() for w in copy]
            truth.add((d, i))
        docs.append((d, " ".join(text)))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    return spark.createDataFrame(docs, "doc_id long, text string"), bench, truth


def test_planted_copies(planted):
    docs, bench, truth = planted
    found = {(r.doc_id, r.item_id) for r in D.find_items(docs, bench).collect()}
    assert found == truth
    assert {r.doc_id for r in D.without_items(docs, bench).collect()} == set(range(200)) - {d for d, _ in truth}


def test_groups_of_items(planted, monkeypatch):
    docs, bench, truth = planted
    monkeypatch.setattr(D, "GROUP_GRAMS", 200)
    assert {(r.doc_id, r.item_id) for r in D.find_items(docs, bench).collect()} == truth


def test_odd_rows(spark):
    item = "one two three four five six"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "a b"), (None, item)], "item_id long, text string")
    rows = [(1, item), (1, item), (2, None), (3, ""), (None, "x " * 50_000 + item), (5, "a b one two")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int")
    found = sorted(((r.doc_id, r.item_id, r.score) for r in D.find_items(docs, bench).collect()), key=str)
    assert found == sorted([(d, i, 1.0) for d in (1, 1, None) for i in (1, None)], key=str)
    kept = D.without_items(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 5]
    assert D.find_items(docs, bench.limit(0)).collect() == [] and D.find_items(docs.limit(0), bench).collect() == []


def test_edited_and_partial_copies_alone(spark):
    """Items that the corpus holds only with every 4th or 5th word changed, or only by half, and often; brute force decides."""
    pick = random.Random(5)
    items = [[f"w{pick.randrange(5000)}" for _ in range(50)] for _ in range(9)]
    docs = []
    for i, item in enumerate(items):
        copy = [f"x{pick.randrange(5000)}" if i % 3 < 2 and k % (4 + i % 3) == 3 else w for k, w in enumerate(item)]
        for _ in range(1 + 20 * (i // 3)):
            around = [f"y{pick.randrange(5000)}" for _ in range(60)]
            at = pick.randrange(60)
            docs.append((len(docs), around[:at] + (copy if i % 3 < 2 else copy[:26]) + around[at:]))
    want = {(d, i) for d, text in docs for i, item in enumerate(items) if plain(item, text) >= D.LEAST_SCORE * D.MATCH * len(item)}
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    table = spark.createDataFrame([(d, " ".join(x)) for d, x in docs], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.find_items(table, bench).collect()} == want and len(want) == len(docs)
    assert D.without_items(table, bench).count() == 0
