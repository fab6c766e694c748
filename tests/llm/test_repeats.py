"""Repeated passages against all windows of a small corpus."""

import random

import pytest

from plumbline.llm import repeats as R


def expected(rows):
    owners = {}
    for k, (_, text) in enumerate(rows):
        words = (text or "").lower().split()
        for i in range(len(words) - R.LEAST + 1):
            owners.setdefault(tuple(words[i:i + R.LEAST]), set()).add(k)
    out = []
    for k, (doc, text) in enumerate(rows):
        words, spans = (text or "").lower().split(), []
        for i in range(len(words) - R.LEAST + 1):
            if owners[tuple(words[i:i + R.LEAST])] - {k}:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + R.LEAST
                else:
                    spans.append([i, i + R.LEAST])
        if spans:
            out.append((doc, [tuple(s) for s in spans]))
    return sorted(out, key=str)


def corpus(seed):
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(600)]

    def prose(n):
        return [pick.choice(words) for _ in range(n)]

    passages = [prose(n) for n in (49, 50, 51, 55, 70, 73, 90, 300)]
    rows = []
    for _ in range(120):
        text = prose(pick.randrange(0, 200))
        for _ in range(pick.choice([0, 0, 1, 2])):
            own = list(pick.choice(passages))
            if pick.random() < .4:
                own[pick.randrange(len(own))] = "changed"
            at = pick.randrange(len(text) + 1)
            text[at:at] = own
        rows.append(" ".join(text))
    base = prose(150)
    for _ in range(20):
        rows.append(" ".join(pick.choice(words) if pick.random() < .03 else w for w in base))
    rows += [" ".join([*prose(k), *passages[5][:60 - k % 7]]) for k in range(12)]
    rows += [" ".join([*passages[5][k % 5:], *prose(k)]) for k in range(12)]
    rows += [rows[3], rows[3].upper(), None, "", "x " * 400, "y " * 30 + "x " * 60]
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,big", [(1, 5000), (2, 6)])
def test_like_all_windows(spark, monkeypatch, seed, big):
    monkeypatch.setattr(R, "BIG", big)
    rows = corpus(seed)
    got = R.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, [tuple(s) for s in r.spans]) for r in got), key=str) == expected(rows)
    assert all(r.n_repeated == sum(s.end - s.first for s in r.spans) for r in got)


def test_odd_rows(spark):
    text = " ".join(f"t{i}" for i in range(60))
    rows = [(None, text), (1, text), (1, text), (2, None), (3, ""), (4, "é" * 200_000), (5, text.replace("t30", "zz"))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, tid int")
    got = sorted(((r.doc_id, r.n_repeated) for r in R.repeated_passages(df).collect()), key=str)
    assert got == [(1, 60), (1, 60), (None, 60)]
    assert R.repeated_passages(df.limit(0)).collect() == []


def test_suffixes_of_a_shared_passage_are_one_row_per_text():
    """A task that knows suffixes to repeat names each of its texts once, however many suffixes it holds."""
    words = R.hash_words(*R.raw(R.pa.array([" ".join(f"w{i}" for i in range(400))]))).hashes
    at = R.minimisers(words)
    tids = R.np.repeat(R.np.arange(1, 31), len(at))
    packed = R._packed(4, R.np.tile(R.cores(words, at), 30), tids, R.np.tile(at.astype(R.np.int32), 30)).to_pylist()
    names = ("seeds", "tids", "spots", "times")
    known = R.pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in packed if r["bucket"] == -1])
    rows = [r for batch in R._known([known]) for r in batch.to_pylist()]
    assert len(at) > 5 and [r["tid"] for r in rows] == list(range(1, 31))
    assert all(sorted(R.np.frombuffer(r["spots"], R.np.int32).tolist()) == at.tolist() for r in rows)
