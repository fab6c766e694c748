"""Line spread against a count in plain Python, and the SQL of the query."""

import duckdb

from corpus_pipeline import line_dedup
from plumbline.llm.lines import spread_lines, without_boilerplate, without_boilerplate_sql


def test_boilerplate_goes_and_copies_stay(spark):
    rows = []
    for i in range(60):
        rows.append((i, f"own line {i} with enough words to be the larger part of it\nAll rights reserved. \nrare {i % 15}", f"s{i % 20}", 1))
        rows.append((100 + i, f"a page\ncopied whole {i % 2}\nto all sites", f"s{i % 20}", 1))
    got = {r.doc_id: r for r in without_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string, n_removed int")
                                                    .drop("n_removed"), least=8).collect()}
    assert all(got[i].text == f"own line {i} with enough words to be the larger part of it\nrare {i % 15}" and got[i].n_removed == 1 for i in range(60))
    assert all(got[100 + i].text == f"a page\ncopied whole {i % 2}\nto all sites" and got[100 + i].n_removed == 0 for i in range(60))


def test_threshold_is_exact(spark):
    rows = [(k * 100 + s, f"line on {k}", f"site {s}") for k in range(1, 26) for s in range(k)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for least in (3, 10, 20):
        assert spread_lines(docs, least).count() == 26 - least


def test_like_the_sql(spark):
    folder = "/root/testdata/sf0.01"
    got = without_boilerplate(spark.read.parquet(f"{folder}/documents.parquet")).select("doc_id", "text", "n_removed").collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = db.execute(without_boilerplate_sql()).fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and sum(r.n_removed for r in got) > 50


def test_no_python_in_the_plan(spark):
    plan = without_boilerplate(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_odd_rows(spark):
    rows = [(i, "x\n \n\nfooter  ", f"s{i}") for i in range(12)]
    odd = [(None, None, "s1"), (50, "", None), (50, "footer\nmuch more text than that\n", None), (50, "footer\nmuch more text than that\n", None), (51, "y\n" * 50_000, "s3")]
    docs = spark.createDataFrame([(*r, 9) for r in rows + odd], "doc_id long, text string, source string, sites int")
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in without_boilerplate(docs).collect()), key=str)
    assert len(got) == 17 and (None, None, 0) in got and (50, "", 0) in got
    assert got.count((50, "much more text than that\n", 1)) == 2 and (51, "y\n" * 50_000, 0) in got
    assert without_boilerplate(docs.limit(0)).collect() == []


def test_columns_of_like_names(spark):
    rows = [(i, f"banner\nown {i}", f"s{i}", "t", "b", "k", "n", 77) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _tid string, _bad string, _kept string, line string, n_removed int")
    found = without_boilerplate(docs)
    assert found.columns == docs.columns
    assert {(r.text, r._tid, r._bad, r._kept, r.line, r.n_removed) for r in found.collect()} == {(f"own {i}", "t", "b", "k", "n", 1) for i in range(12)}


def test_pipeline_cleans_short_pages_with_long_banners(spark):
    banner = "A banner that is much longer than the few words of the page below it"
    rows = [(i, f"{banner}\nown {i}", "en", f"s{i}", 1) for i in range(12)] + [(100 + i, f"{banner}\n\n{banner} ", "en", f"s{i}", 1) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in line_dedup(spark, docs, "").collect()}
    assert got == {**{i: (f"own {i}", len(f"own {i}")) for i in range(12)}, **{r[0]: (r[1], len(r[1])) for r in rows[12:]}}
