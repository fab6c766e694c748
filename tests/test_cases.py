"""Rules over cases against each case on its own, and what a case's rows are shuffled for."""

import random
from datetime import datetime, timedelta

from plumbline.operators import quality as Q
from plumbline.operators.rules import Rule

NOW = "2026-06-30 00:00:00"
SCHEMAS = {"sales": "sale string, buyer string, amount decimal(12,2), at timestamp_ntz, state string",
           "lines": "line string, sale string, part decimal(12,2), good boolean", "people": "id string, since timestamp_ntz"}
RULES = [
    Rule("sale_unique", "duplicate_identifier", "unique", "sales", "low", ("sale",)),
    Rule("open_unique", "duplicate_identifier", "unique", "sales", "low", ("sale",), where="state = 'open'"),
    Rule("line_unique", "duplicate_identifier", "unique", "lines", "low", ("line",)),
    Rule("buyer_known", "broken_relationship", "relationship", "sales", "low", ("buyer",), {"column": "buyer", "to_asset": "people", "to_column": "id"}),
    Rule("open_buyer_known", "broken_relationship", "relationship", "sales", "low", ("buyer",), {"column": "buyer", "to_asset": "people", "to_column": "id"},
         where="p.state = 'open'"),
    Rule("sale_known", "broken_relationship", "relationship", "lines", "low", ("sale",), {"column": "sale", "to_asset": "sales", "to_column": "sale"}),
    Rule("after_join", "chronology", "chronology", "sales", "low", (),
         {"later_column": "at", "earlier_column": "since", "reference_asset": "people", "join": {"buyer": "id"}}),
    Rule("parts_add_up", "reconciliation", "aggregate_reconciliation", "sales", "low", ("amount",),
         {"child_asset": "lines", "join": {"sale": "sale"}, "child_where": "c.good", "primary_expression": "p.amount", "child_aggregate": "sum(c.part)"}),
    Rule("few_parts", "reconciliation", "aggregate_reconciliation", "sales", "low", ("amount",),
         {"child_asset": "lines", "join": {"sale": "sale"}, "primary_expression": "p.amount", "child_aggregate": "count(*)", "comparison": "child_lte_primary"},
         where="state = 'open'"),
    Rule("part_fits", "business_rule", "join_condition", "lines", "low", ("part",),
         {"reference_asset": "sales", "join": {"sale": "sale"}, "compare": ("part", "above", "amount", "0.5")}),
    Rule("same_part", "business_rule", "join_condition", "lines", "low", ("part",),
         {"reference_asset": "sales", "join": {"sale": "sale"}, "compare": ("part", "distinct", "amount")}),
    Rule("free_has_lines", "business_rule", "row_condition", "sales", "low", ("amount",),
         {"invalid_when": "amount = 0 AND NOT EXISTS (SELECT 1 FROM {ref:lines} l WHERE l.sale = p.sale)"}),
    Rule("positive", "invalid_numeric", "range", "sales", "low", ("amount",), {"column": "amount", "min": 0}, where="buyer IS NOT NULL"),
    Rule("people_unique", "duplicate_identifier", "unique", "people", "low", ("id",)),
]


def _rows(pick):
    def name(letters):
        return pick.choice([None, *letters, *letters])
    sales = [(name("stu"), name("PQX"), pick.choice([None, -1, 0, 2, 2, 5]), datetime(2026, 1, 1) + timedelta(days=pick.randrange(9)),
              pick.choice(["open", "done", None])) for _ in range(pick.randrange(7))]
    lines = [(name("123456"), name("stuv"), pick.choice([None, 0, 2, 2, 3]), pick.choice([True, True, False, None])) for _ in range(pick.randrange(9))]
    return {"sales": sales, "lines": lines}


def _tables(spark):
    pick = random.Random(3)
    cases = {f"c{i}": _rows(pick) for i in range(25)}
    people = [("P", datetime(2026, 1, 4)), ("P", datetime(2026, 1, 5)), ("Q", None), (None, datetime(2026, 1, 1))]
    number = {"sales": 2, "lines": 2}
    cases = {c: {t: [tuple(float(v) if i == number[t] and v is not None else v for i, v in enumerate(r)) for r in rows] for t, rows in v.items()}
             for c, v in cases.items()}
    def frame(rows, schema):
        loose = schema.replace("decimal(12,2)", "double")
        df = spark.createDataFrame(rows, loose)
        return df.select(*[df[c].cast(k) for c, k in (x.strip().split(" ", 1) for x in schema.replace("12,2", "12;2").split(",")) for k in [k.replace(";", ",")]])
    cased = {t: frame([(c, *r) for c, v in cases.items() for r in v[t]], "case_id string, " + SCHEMAS[t]) for t in ("sales", "lines")}
    return cases, {**cased, "people": frame(people, SCHEMAS["people"])}, frame


def test_like_each_case_on_its_own(spark):
    cases, tables, frame = _tables(spark)
    got = {(r.case_id, r.rule_key): r.failed for r in Q.failing_by_case(tables, RULES, NOW).collect()}
    assert got.pop((None, "people_unique")) == 2
    want = {}
    for case, rows in list(cases.items())[:3]:
        alone = {**{t: frame(rows[t], SCHEMAS[t]) for t in rows}, "people": tables["people"]}
        want |= {(case, r.rule_key): r.failed for r in Q.rule_counts(spark, alone, RULES[:-1], NOW).filter("failed > 0").collect()}
    assert {k: v for k, v in got.items() if k[0] in list(cases)[:3]} == want
    # Every rule shows, against another plan: the case as one more column of every key.
    old = Q._union([Q._plan_set(r, Q.Context(tables, Q.cutoff_sql(NOW), ("case_id",)), ["case_id"], None) for r in RULES[:12]]).filter("failed > 0")
    every = {(r.case_id, r.rule_key): r.failed for r in old.collect()}
    assert {k: v for k, v in got.items() if k[1] != "positive"} == every and len({k for _, k in got}) == 13


def test_rows_without_a_case_have_no_partners(spark):
    tables = {"sales": spark.createDataFrame([(None, "s"), (None, "s"), ("c", "s")], "case_id string, sale string"),
              "lines": spark.createDataFrame([(None, "s"), ("c", "s"), ("d", "s"), ("d", None)], "case_id string, sale string")}
    rules = [r for r in RULES if r.key in ("sale_unique", "sale_known")]
    got = {(r.case_id, r.rule_key): r.failed for r in Q.failing_by_case(tables, rules, NOW).collect()}
    assert got == {(None, "sale_unique"): 2, (None, "sale_known"): 1, ("d", "sale_known"): 1}


def test_rows_of_a_case_are_dealt_once(spark):
    _, tables, _ = _tables(spark)
    own = [r for r in RULES if r.key in ("sale_unique", "line_unique", "sale_known", "parts_add_up", "part_fits", "same_part")]
    plan = Q.failing_by_case(tables, own, NOW)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan
