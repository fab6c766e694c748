"""Segmentation sums against enumeration, and held-out accuracy."""

import numpy as np

from plumbline.llm.language import Lattice, fit, identify, predict, words_of

PIECES = sorted(["▁", "a", "b", "ab", "ba", "▁a", "▁ab", "aba"])


def all_segmentations(word, theta, column):
    if not word:
        return 1.0
    total = sum(theta[i, column] * all_segmentations(word[len(p):], theta, column) for i, p in enumerate(PIECES) if word.startswith(p))
    if word[0] not in PIECES:
        total += theta[len(PIECES), column] * all_segmentations(word[1:], theta, column)
    return total


def test_forward_sums_all_segmentations():
    theta = np.random.default_rng(3).random((len(PIECES) + 1, 2)) / 5
    words = ["a", "abab", "bbaabaab", "xay", "é", "ababab"]
    got = Lattice(PIECES).log_probabilities(words, theta)
    want = [[np.log(all_segmentations("▁" + w, theta, k)) for k in (0, 1)] for w in words]
    assert np.allclose(got, want)


def test_expected_counts_cover_every_letter():
    theta = np.random.default_rng(4).random((len(PIECES) + 1, 2)) / 5
    words, times = ["abab", "xba", "b"], np.array([[2., 0], [1, 3], [0, 5]])
    seen = Lattice(PIECES).expected(words, times, theta)
    sizes = np.array([*map(len, PIECES), 1])
    assert np.allclose(sizes @ seen, [sum(t * (len(w) + 1) for w, t in zip(words, times[:, k])) for k in (0, 1)])


def test_sums_of_tiny_probabilities():
    theta = np.random.default_rng(5).random((len(PIECES) + 1, 2)) / 5
    tiny, plain = theta * [1, 1e-30], ["ababab", "x" * 39, "ab" * 20]
    got = Lattice(PIECES).log_probabilities(plain, tiny)
    assert np.isfinite(got).all() and np.allclose(got[1:, 0], Lattice(PIECES).log_probabilities(plain[1:], theta)[:, 0])
    assert np.isclose(got[1, 1], np.log(tiny[PIECES.index("▁"), 1]) + 39 * np.log(tiny[-1, 1]))
    times = np.array([[2., 0], [0, 3], [1, 4]])
    seen, sizes = Lattice(PIECES).expected(plain, times, tiny), np.array([*map(len, PIECES), 1])
    assert np.allclose(sizes @ seen, [sum(t * (len(w) + 1) for w, t in zip(plain, times[:, k])) for k in (0, 1)])


def test_long_runs_of_two_scripts(spark):
    runs = {"zh": "的一是在不了有和人这中大为上个国我以要他时来用们生到作地于出" * 2, "th": "กขคงจฉชซญฎฏฐฑฒณดตถทธนบปผฝพฟภมยรลวศษสหอฮ"}
    rows = [(i, runs[g][k:k + 40], g) for i in range(30) for k in (0, 3) for g in runs] + [(i, "the of and " * 30_000, "en") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit(docs)
    assert np.isfinite(model.theta).all()
    got = predict(docs, model, ("doc_id", "lang")).collect()
    assert len(got) == len(rows) and all(r.lang == r.lang_pred and 0 <= r.score <= 1 for r in got)
    strange = spark.createDataFrame([(1, "ა" * 40, None)], docs.schema)
    assert all(0 <= r.score <= 1 for r in predict(strange, model, ("doc_id",)).collect())


def test_long_words_are_scored_in_parts():
    assert sum(len(w) * n for w, n in words_of("É" * 1001 + " 12_ ab").items()) == 1003


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and len(held) > 100
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    train = [(i, t, g) for i, (t, g) in enumerate([("der und die", "de"), ("the and of", "en")] * 20)]
    odd = [(100, None, "en"), (101, "", None), (102, "12 %% _", "en"), (None, "the of the", None), (103, "x" * 50_000, "de"), (103, "und die", None)]
    docs = spark.createDataFrame([(*r, "z", 1) for r in train + odd], "doc_id long, text string, lang string, lang_pred string, score int")
    rows = identify(docs).collect()
    found = [(r.doc_id, r.lang_pred) for r in rows if r.doc_id is None or r.doc_id >= 100]
    assert sorted(found, key=str)[:3] == [(100, "und"), (101, "und"), (102, "und")]
    assert (None, "en") in found and (103, "de") in found and len(rows) == 46
    assert identify(docs.limit(0)).collect() == []
    assert [r.lang_pred for r in predict(docs.limit(2), fit(docs.limit(0)), ("doc_id",)).collect()] == ["und", "und"]
