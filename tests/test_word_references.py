"""Words of texts meet assets on the shelves of an inverted index: what is written and shuffled, and results however it is cut."""

import random

from pyspark.sql import functions as F

from plumbline.operators import lineage as L

_COLUMNS = "asset string, column_name string, ordinal int"


def _plain(df):
    rows = [(r.upstream, r.downstream, r.referenced_columns and tuple(r.referenced_columns)) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_neither_hits_nor_pairs_are_shuffled(spark, monkeypatch):
    # Every text says every word of every asset: 60 * 40 pairs, 60 * 40 * 10 hits.
    words = [f"w{i}" for i in range(10)]
    columns = spark.createDataFrame([(f"A{i:02}", w, k) for i in range(40) for k, w in enumerate(words)], _COLUMNS)
    texts = spark.createDataFrame([(f"T{i}", " ".join(words)) for i in range(60)] + [("none", None)], "asset string, text string")
    written, checkpoint = [], L.checkpoint

    def record(df):
        out = checkpoint(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(L, "checkpoint", record)
    got = L.word_references(columns, texts)
    # One row for a text, none for a word of a text or for a pair.
    assert max(written) == 60
    plan = got._jdf.queryExecution().executedPlan().toString()
    # Only texts that are NULL are told apart.
    assert plan.count("Exchange hashpartitioning") == 1
    assert _plain(got) == {(f"A{i:02}", f"T{j}", tuple(words)) for i in range(40) for j in range(60)} | {(None, "none", None)}


def test_assets_in_pieces_and_small_shelves_give_the_same(spark):
    pick = random.Random(7)
    words = [f"w{i}" for i in range(30)]
    # NULL is an asset like others, words come twice, two words share an ordinal.
    columns = [(None if i == 3 else f"A{i}", w, k // 2) for i in range(12) for k, w in enumerate(pick.choices(words, k=pick.randrange(1, 25)))]
    texts = [(None if i == 5 else f"T{i % 20}", " ".join(pick.choices([*words, "else"], k=pick.randrange(12)))) for i in range(30)]
    ordinal = {}
    for asset, word, k in columns:
        ordinal.setdefault(asset, {}).setdefault(word, k)
        ordinal[asset][word] = min(ordinal[asset][word], k)
    said = {}
    for asset, text in texts:
        said.setdefault(asset, set()).update(text.split())
    want = {(u, d, tuple(sorted(own.keys() & have, key=lambda w: (own[w], w)))) for u, own in ordinal.items() for d, have in said.items()}
    want = {r for r in want if r[2]}
    offered, given = spark.createDataFrame(columns, _COLUMNS), spark.createDataFrame(texts, "asset string, text string")
    for hot, postings, shelf_words in ((100_000, 1024, 16_384), (4, 2, 3), (100_000, 1024, 5)):
        assert _plain(L.word_references(offered, given, hot, postings, shelf_words)) == want
    index = L.word_index(offered, 1024, 5)
    assert index.filter("wide").count() and index.groupBy("shelf").agg(F.sum(F.size("owners")).alias("n")).agg(F.max("n")).first()[0] < 10


def test_nothing_said_and_nothing_offered(spark):
    columns = spark.createDataFrame([("A", None, 1)], _COLUMNS)
    texts = spark.createDataFrame([("T", "a b"), ("E", ""), (None, None)], "asset string, text string")
    assert _plain(L.word_references(columns, texts)) == {(None, None, None)}
    assert _plain(L.word_references(columns, texts.filter("text = ''"))) == set()
