"""The stages one by one on the smallest tables, each against a plain version."""

import pytest

import corpus_pipeline as C
from plumbline.session import checkpoint
from test_jaccard import expected

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    junk = spark.createDataFrame([(10 ** 6, None, "en", "s", 0), (10 ** 6 + 1, "123 !!", None, None, 6), (None, docs.first().text, "en", "s", 1)], docs.schema)
    out = [docs.unionByName(junk)]
    for _, stage in C.STAGES:
        out.append(checkpoint(stage(spark, out[-1], FOLDER)))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_language_keeps_all_with_letters(results):
    before, after = rows(results[0]), rows(results[1])
    assert results[1].columns == results[0].columns
    assert set(before) - set(after) == {10 ** 6, 10 ** 6 + 1} and all(after[k] == before[k] for k in after)


def test_line_dedup_takes_lines_only(results):
    before, after = rows(results[1]), rows(results[2])
    sites = {}
    for r in results[1].collect():
        for line in r.text.split("\n"):
            sites.setdefault(line.strip(" "), set()).add(r.source)
    assert before.keys() == after.keys() and results[2].columns == results[0].columns
    for k, r in before.items():
        kept = "\n".join(x for x in r.text.split("\n") if not x.strip(" ") or len(sites[x.strip(" ")]) < 10)
        assert after[k].text == (r.text if len(r.text) - len(kept) > .5 * len(r.text) else kept) and after[k].n_chars == len(after[k].text)


def test_near_duplicates_keep_the_smallest_id(results):
    before, after = rows(results[2]), rows(results[3])
    want = expected([(k, r.text) for k, r in before.items() if k is not None], 5, 80)
    assert set(after) == {k for k, (_, c) in want.items() if k == c} | {None}


def test_decontamination_and_packing(results, spark):
    kept, clean, packed = rows(results[3]), rows(results[4]), results[5].collect()
    assert set(clean) < set(kept)
    items = [r.text.lower().split() for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    for k in kept:
        text = " " + " ".join(kept[k].text.lower().split()) + " "
        if any(" " + " ".join(x) + " " in text for x in items):
            assert k not in clean
    assert {r.doc_id for r in packed} == set(clean)
    assert sum(r.n_tokens for r in packed) == sum(len(r.text.split()) for r in clean.values())


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        docs = checkpoint(stage(spark, docs, FOLDER))
    assert docs.collect() == []


def test_run_is_registered(spark):
    import __spark_entry__ as entry
    names = [n for n in entry.queries() if n.startswith("op")]
    assert entry.queries()["pipeline"] is C.run and sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
