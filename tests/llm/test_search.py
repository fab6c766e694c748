"""Dual-tree search against scoring every pair, bounds that hold, groups of items, odd rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from plumbline.llm.search import Best, Items, coordinates, doc_levels, leaf_pairs, length_factor, search, search_block, term_weight, terms_of

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, best=20):
    """Every pair scored by the formula."""
    own = [Counter(words_of(t)) for _, t in docs]
    n_docs, n_words = sum(map(bool, own)), sum(sum(c.values()) for c in own)
    spread = Counter(t for c in own for t in c)
    out = []
    for item_id, text in sorted(set(items), key=str):
        scores = []
        for (doc_id, _), c in zip(docs, own, strict=True):
            m = length_factor(sum(c.values()), n_docs, n_words) if c else 0
            s = sum(term_weight(n_docs, spread[t]) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in words_of(text) if t in c)
            if s > 0:
                scores.append((-s, doc_id is None, doc_id or 0))
        out += [(item_id, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:best])]
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_terms():
    for text in ("", "Ab9-c_d ÉÀ é x\nA\tb", "漢字 x²", "a\x7fb\x80c", "don't"):
        assert [t.decode() for t in terms_of(text.encode())] == words_of(text)
    assert terms_of(None) == []


def test_blocks_find_the_best_and_rule_pairs_out():
    pick = random.Random(3)
    topics = [[f"t{k}w{j}" for j in range(30)] for k in range(12)]
    common = [f"c{j}" for j in range(10)]

    def text():
        return " ".join(pick.choices(pick.choice(topics), k=pick.randrange(1, 40)) + pick.choices(common, k=pick.randrange(20)))

    docs = [(i, text()) for i in range(900)]
    items = [Counter(t.encode() for t in words_of(text())) for _ in range(40)] + [Counter()]
    own = [Counter(terms_of(t.encode())) for _, t in docs]
    spread = Counter(t for c in own for t in c)
    group = Items.of(items, spread, len(docs), sum(sum(c.values()) for c in own))
    best, scored = Best(41, 5), 0
    for start in range(0, 900, 150):
        part = docs[start:start + 150]
        values = coordinates(group, [t.encode() for _, t in part])
        levels = doc_levels(values)
        # A pair of leaves that is ruled out holds nothing as good as the k-th.
        pairs = set(zip(*(x.tolist() for x in leaf_pairs(group, levels, best.kth)), strict=True))
        for i, (columns, weight) in enumerate(group.weights):
            exact = values[:, columns] @ weight
            for leaf in range(len(levels[0])):
                if (i // 4, leaf) not in pairs:
                    most = exact[leaf * 16:(leaf + 1) * 16].max()
                    assert most <= 0 or most < best.kth[i]
        scored += search_block(group, values, np.array([i for i, _ in part]), np.zeros(len(part), dtype=bool), best)
    assert scored < 0.6 * 900 * 41
    got = [(group.keys[i], int(d), int(s)) for i in range(41) for d, s in zip(best.id[i], best.score[i], strict=True)]
    want = [(int(k), d, s) for k, _, d, s in plain(docs, [(i, " ".join(t.decode() for t in c.elements())) for i, c in enumerate(items)], 5)]
    assert sorted(got) == sorted(want)


def test_groups_of_items_and_partitions_change_nothing(spark):
    pick = random.Random(9)
    words = [f"w{int(pick.paretovariate(0.6))}" for _ in range(400)]
    docs = [(i, " ".join(pick.choices(words, k=pick.randrange(40)))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(130)]
    items = [(i, " ".join(pick.choices(words, k=pick.randrange(1, 12)))) for i in range(30)] + [(99, docs[7][1])]
    want = plain(docs, items)
    given = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows_of(search(table, given)) == want
    assert rows_of(search(table.repartition(7), given, group_terms=40)) == want
    assert rows_of(search(table, given, best=3)) == plain(docs, items, 3)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "..."), (4, "alpha " * 40_000), (None, "alpha beta"), (5, "ALPHA beta"), (5, "ALPHA beta"), (5, "gamma"), (6, "beta")]
    items = [(1, "Alpha, beta! alpha"), (1, "Alpha, beta! alpha"), (1, "gamma"), (2, None), (3, ""), (None, "beta"), (4, "nowhere"), (5, "nowhere beta")]
    table = spark.createDataFrame([(*r, 7, "x") for r in docs], "doc_id long, text string, score int, item_id string")
    asked = spark.createDataFrame([(*r, 7) for r in items], "item_id long, text string, doc_id int")
    found = search(table, asked)
    assert rows_of(found) == plain(docs, items) and found.columns == ["item_id", "rank", "doc_id", "score"]
    by_rank = defaultdict(list)
    for r in found.collect():
        by_rank[r.item_id].append((r.rank, r.doc_id))
    assert set(by_rank) == {1, 5, None} and by_rank[None][-1][1] is None
    assert search(table.limit(0), asked).collect() == [] and search(table, asked.limit(0)).collect() == []
