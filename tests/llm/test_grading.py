"""Statistics against plain Python, splits against exhaustive search, trees against a recursive walk, held-out accuracy, odd rows."""

import math
import random

import numpy as np
import pyarrow as pa

from plumbline.llm.grading import BINS, LEAST_WEIGHT, NAMES, RIDGE, best_split, fit, grade_documents, grow, merge, predict, quantile_edges, statistics
from plumbline.llm.queries import op12_quality

WHITE = " \t\n\v\f\r"


def plain(text):
    """A few of the statistics of one text, character by character."""
    words, word = [], ""
    for c in (text or "") + " ":
        if c in WHITE:
            words += [word] if word else []
            word = ""
        else:
            word += c
    fold = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    lines = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split("\n") if x]
    pairs = list(zip(fold, fold[1:], strict=False))
    n, chars = max(1, len(words)), max(1, len(text or ""))

    def most(x):
        return max(map(x.count, x), default=0)

    return {
        "log_chars": math.log1p(len(text or "")), "upper": sum("A" <= c <= "Z" for c in text or "") / chars,
        "digit": sum("0" <= c <= "9" for c in text or "") / chars, "stop": sum(c in ".,;:?!" for c in text or "") / chars,
        "log_words": math.log1p(len(words)), "word_bytes": sum(len(w.encode()) for w in words) / n,
        "capitals": sum(sum("A" <= c <= "Z" for c in w) > 1 and not any("a" <= c <= "z" or c >= "\x80" for c in w) for w in words) / n,
        "distinct": len(set(fold)) / n, "most_frequent": most(fold) / n,
        "repeats_last": sum(a == b for a, b in pairs) / n, "distinct_pairs": len(set(pairs)) / max(1, len(words) - 1),
        "most_frequent_pair": most(pairs) / max(1, len(words) - 1),
        "log_lines": math.log1p(len(lines)), "distinct_lines": len(set(lines)) / max(1, len(lines)), "most_frequent_line": most(lines) / max(1, len(lines)),
    }


def test_statistics_equal_a_plain_count():
    pick = random.Random(5)
    pieces = ["a", "B", "the", "THE", "é", "ß9", "x!!", "||", " ", "  ", "\n", "\n\n", "\t", ".", "12", "naïve,", "漢字"]
    texts = [None, "", " \n ", "one", "A" * 70_000, *("".join(pick.choices(pieces, k=pick.randrange(1, 80))) for _ in range(300))]
    got = statistics(pa.array(texts, pa.string()))
    for row, text in zip(got, texts, strict=True):
        for name, value in plain(text).items():
            assert abs(row[NAMES.index(name)] - value) < 1e-9, (name, text)
    assert not got[0].any() and not got[1].any()


def test_a_split_is_the_best_of_all():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, (400, 5)).astype(float)
    g, h, node = rng.normal(size=400), rng.random(400), rng.integers(0, 3, 400)
    edges = quantile_edges(x)
    binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    gain, feature, cut = best_split(binned, node, 3, g, h, 12)
    for k in range(3):
        rows, best = node == k, (0.0, 0, 0.0)
        for f in range(5):
            for t in sorted(set(x[:, f]))[:-1]:
                a, b = rows & (x[:, f] <= t), rows & (x[:, f] > t)
                if min(h[a].sum(), h[b].sum()) >= LEAST_WEIGHT:
                    score = g[a].sum() ** 2 / (h[a].sum() + RIDGE) + g[b].sum() ** 2 / (h[b].sum() + RIDGE) - g[rows].sum() ** 2 / (h[rows].sum() + RIDGE)
                    best = max(best, (score, -f, -t))
        assert abs(gain[k] - best[0]) < 1e-9 and feature[k] == -best[1] and edges[feature[k]][cut[k]] == -best[2]


def test_flat_trees_walk_like_nested_ones():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forests = [grow(x[k::2], y[k::2], np.ones(300), 20) for k in range(2)]
    both = merge(forests)

    def walk(forest, row, node):
        if forest.left[node] == node:
            return forest.value[node]
        return walk(forest, row, forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node])

    for row, got in zip(x[:80], both.margin(x[:80]), strict=True):
        want = np.mean([m.base + sum(walk(m, row, r) for r in m.roots) for m in forests])
        assert abs(got - want) < 1e-9
    assert ((both.margin(x) > 0) == y).mean() > 0.97 and BINS > 2


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = op12_quality(spark, folder)
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    assert scored.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert len(rows) > 1000 and sum(r.predicted == r.quality for r in rows) >= 0.99 * len(rows)
    assert sum(r.predicted == 0 for r in rows if r.quality == 0) >= 0.95 * sum(r.quality == 0 for r in rows)


def test_labels_of_the_held_out_part_change_nothing(spark):
    rows = [(i, f"word{i % 7} and more words here {i}" if i % 2 else f"BAD!! {i}!! BAD!!") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    true = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    out = {r.doc_id for r in grade_documents(docs, true).where("held_out").collect()}
    lied = spark.createDataFrame([(i, 1 - i % 2 if i in out else i % 2) for i, _ in rows], "doc_id long, quality int")
    a, b = ({r.doc_id: r.score for r in grade_documents(docs, x).collect()} for x in (true, lied))
    assert a == b and out and all((a[i] >= 0.5) == i % 2 for i in out)


def test_odd_rows(spark):
    rows = [(i, f"a good text of words {i}" if i % 3 else f"JUNK!! {i}!! JUNK!!") for i in range(200)]
    odd = [(1000, None), (1001, ""), (1002, "JUNK!! " * 30_000), (None, "a good text of words"), (1003, "JUNK!! 3!! JUNK!!"), (1003, "JUNK!! 3!! JUNK!!")]
    docs = spark.createDataFrame([(*r, 0, 1.5, "x") for r in rows + odd], "doc_id long, text string, quality int, score double, _text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), "y") for i in range(200)] + [(1003, None, "y"), (None, 0, "y"), (5, 1, "y")], "doc_id long, quality int, text string")
    found = {}
    for r in grade_documents(docs, labels).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, found.values())) == 206 and len(found[1003]) == 2
    assert 0 <= found[1002][0].score <= 1 and found[1003][0].predicted == 0 and found[None][0].predicted == 1 and found[None][0].held_out
    assert found[1000][0].score == found[1001][0].score and 0 <= found[1000][0].score <= 1
    assert all(r.score == 0 and r.predicted == 0 for r in grade_documents(docs, labels.limit(0)).collect())
    assert all(r.score > 0.99 for r in predict(docs, fit(docs, labels.where("quality = 1")), ("doc_id",)).collect())
    assert grade_documents(docs.limit(0), labels).collect() == []
