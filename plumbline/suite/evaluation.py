"""Queries: labelled evaluation over cases, labelled corruption and ground-truth coverage.

A case is an order with its lines, payments and refunds, a customer with its subscriptions, or a ticket. Whether it is
defective follows from the key moduli that the adapter damages. Tables that a kind of case does not hold are
context, shared by all its cases. Every rule of a ruleset is judged.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from plumbline.operators import corrupt as D
from plumbline.operators import evaluation as E
from plumbline.operators import overlay as V
from plumbline.operators import quality as Q
from plumbline.operators.rules import rules_frame, select_ruleset
from plumbline.plans.model_sql import staging_sql, with_models
from plumbline.plans.staging import stage
from plumbline.session import checkpoint, shared_folder
from plumbline.sources import tables as T
from plumbline.sources.driver_tables import CUTOFF, TRADING_START
from plumbline.suite import rule_sql as S
from plumbline.suite.common import Bed, plain

QUERIES = {}
ORACLE = {}

_ALL = list(S.RULES.values())


def _add(name, run, sql=None):
    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = sql


# Kinds of cases: mark of the case id, tables that are cut into cases, and shared context.
_KINDS = (
    ("O", ("stg_orders", "stg_order_items", "stg_payments", "stg_refunds"),
     ("stg_customers", "stg_products", "stg_campaigns", "stg_subscriptions")),
    ("C", ("stg_customers", "stg_subscriptions"), ()),
    ("T", ("stg_tickets",), ("stg_customers",)),
)

# What the adapter plants into the rows of a case, most telling defect first.
_LABELS = {
    "O": """SELECT o_orderkey AS k, CASE
        WHEN o_orderkey % 211 = 0 OR o_orderkey % 701 = 0 OR o_orderkey % 617 = 0 THEN 'broken_relationship'
        WHEN o_orderkey % 4 = 0 AND o_orderkey % 27 IN (25, 26) THEN 'broken_relationship'
        WHEN o_orderkey % 521 = 0 AND r.returned > 0 OR r.strange > 0 THEN 'broken_relationship'
        WHEN o_orderkey % 157 = 0 OR o_orderkey % 419 = 0 THEN 'invalid_category'
        WHEN o_orderkey % 71 = 0 OR o_orderkey % 61 = 0 OR o_orderkey % 89 = 0 AND r.n > 0 THEN 'reconciliation'
        WHEN o_orderkey % 173 = 0 THEN 'invalid_date' WHEN o_orderkey % 131 = 0 THEN 'chronology'
        WHEN o_orderkey % 139 = 0 AND r.returned > 0 THEN 'chronology'
        WHEN o_orderkey % 307 = 0 THEN 'business_rule'
        WHEN o_orderkey % 503 = 0 OR o_orderkey % 409 = 0 THEN 'duplicate_identifier'
        WHEN o_orderkey % 613 = 0 OR o_orderkey % 997 = 0 OR o_orderkey % 811 = 0 AND r.n > 0 THEN 'missing_identifier'
        WHEN o_orderkey % 401 = 0 OR o_orderkey % 233 = 0 AND r.n > 0 THEN 'invalid_numeric'
        WHEN o_orderkey % 331 = 0 OR o_orderkey % 1009 = 5 OR o_orderkey % 47 = 0 AND r.returned > 0 THEN 'financial_consistency'
        WHEN r.n > r.numbers THEN 'duplicate_identifier'
        END AS defect FROM {orders} LEFT JOIN (SELECT l_orderkey, COUNT(*) AS n, COUNT(DISTINCT l_linenumber) AS numbers, COUNT(CASE WHEN l_returnflag = 'R' THEN 1 END) AS returned,
            COUNT(CASE WHEN l_partkey % 499 = 0 AND l_orderkey % 3 = 0 THEN 1 END) AS strange FROM {lineitem} GROUP BY l_orderkey) AS r
        ON r.l_orderkey = o_orderkey""",
    "C": """SELECT c_custkey AS k, CASE
        WHEN c_custkey % 399 = 0 THEN 'broken_relationship'
        WHEN c_custkey % 101 = 0 OR c_custkey % 477 = 0 AND c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 THEN 'invalid_category'
        WHEN c_custkey % 165 = 0 THEN 'chronology'
        WHEN c_custkey % 33 = 0 AND c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 THEN 'inconsistent_status'
        WHEN c_custkey % 45 = 0 AND c_custkey % 33 <> 0 THEN 'inconsistent_status'
        WHEN c_custkey % 37 = 0 THEN 'missing_identifier' END AS defect FROM {customer}""",
    "T": """SELECT event_id AS k, CASE
        WHEN c_custkey IS NULL THEN 'broken_relationship'
        WHEN event_type NOT IN ('view', 'click', 'purchase', 'signup') THEN 'invalid_category'
        WHEN event_id % 6 <> 0 AND event_id % 111 = 1 THEN 'inconsistent_status'
        WHEN event_id % 6 <> 0 AND event_id % 127 = 0 THEN 'chronology'
        WHEN event_id % 3 <> 0 AND event_id % 199 = 1 THEN 'invalid_numeric' END AS defect
        FROM {events} LEFT JOIN {customer} ON c_custkey = user_id""",
}
_LABEL_INPUTS = {"O": ("orders", "lineitem"), "C": ("customer",), "T": ("events", "customer")}
_LABEL_COLUMNS = ("'{kind}' || k AS case_id, defect AS defect_category, CASE WHEN defect IS NULL THEN 'valid' ELSE 'defective' END AS "
                  "expected")


def _chosen(ruleset, kind=None):
    """All rules of a ruleset, or those on tables of one kind of case."""
    own = {name: tables for name, tables, _ in _KINDS}
    return [r for r in select_ruleset(_ALL, ruleset) if kind is None or r.asset in own[kind]]


def _cases(s, f, kind):
    """Tables of one kind of case; the case id is the undamaged key, so it survives defects in the business keys."""
    bed = Bed(s, f)
    _, own, context = next(k for k in _KINDS if k[0] == kind)
    tables = {name: bed.staging[name] for name in context}
    for name in own:
        staged = stage(name[4:], bed.keyed(name[4:]), ("case_key",))
        tables[name] = staged.withColumn("case_id", F.concat(F.lit(kind), "case_key")).drop("case_key")
    return tables


def _labels(s, f):
    bed = Bed(s, f)
    parts = [s.sql(f"SELECT {_LABEL_COLUMNS.format(kind=kind)} FROM ({text}) AS x", **{t: bed.source(t) for t in _LABEL_INPUTS[kind]})
             for kind, text in _LABELS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _predictions(s, f, ruleset):
    """All cases of all kinds, each kind in one job."""
    Bed(s, f).land()
    labels = checkpoint(_labels(s, f))
    parts = [E.predict(_cases(s, f, kind), _chosen(ruleset, kind), labels.filter(F.col("case_id").startswith(kind)), CUTOFF)
             for kind, _, _ in _KINDS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _case_views() -> list[str]:
    out = []
    for kind, own, _ in _KINDS:
        for name in own:
            text = staging_sql(name)
            out.append(f"k_{kind}_{name[4:]} AS MATERIALIZED (SELECT '{kind}' || case_key AS case_id, {text.removeprefix('SELECT ')})")
    return out


def _case_sql(ruleset: str) -> str:
    """CTEs giving one row per failing (case, rule); every subquery over tables of the case stays inside it."""
    lines = []
    for kind, own, _ in _KINDS:
        view = {name: f"k_{kind}_{name[4:]}" for name in own}
        for r in _chosen(ruleset, kind):
            text = S.predicate(r.key)
            for asset, cased in view.items():
                text = text.replace(f"FROM {asset} AS o WHERE", f"FROM {cased} AS o WHERE o.case_id = p.case_id AND")
            if r.type == "unique":
                col = r.columns[0]
                text = (f"(p.case_id, p.{col}) IN (SELECT (q.case_id, q.{col}) FROM {view[r.asset]} AS q WHERE q.{col} IS NOT "
                        f"NULL GROUP BY ALL HAVING COUNT(*) > 1)")
            if r.type == "relationship" and r.params["to_asset"] in view:
                col, parent = r.params["column"], view[r.params["to_asset"]]
                text = f"p.{col} IS NOT NULL AND NOT EXISTS (FROM {parent} AS o WHERE o.case_id = p.case_id AND o.{col} = p.{col})"
            if r.type == "aggregate_reconciliation":
                text = text.replace("(SELECT ", "(SELECT case_id, ").replace("GROUP BY ", "GROUP BY case_id, ")
                text = text.replace("AS a WHERE", "AS a WHERE a.case_id = p.case_id AND")
                for asset, cased in view.items():
                    text = text.replace(f"FROM {asset} ", f"FROM {cased} ")
            lines.append(f"SELECT DISTINCT p.case_id, '{r.key}' AS rule_key FROM {view[r.asset]} AS p WHERE {S.scope(r.key)} AND ({text})")
    labels = " UNION ALL ".join(f"SELECT {_LABEL_COLUMNS.format(kind=kind)} FROM ({re.sub('[{}]', '', text)}) AS x" for kind, text in _LABELS.items())
    return ", ".join([
        *_case_views(),
        "fired AS MATERIALIZED (SELECT case_id, array_to_string(list(rule_key ORDER BY rule_key), ',') AS rules FROM ("
        + "\nUNION ALL ".join(lines) + ") AS x GROUP BY case_id)",
        f"labels AS ({labels})",
        "predicted AS MATERIALIZED (SELECT l.case_id, l.expected, CASE WHEN f.rules IS NULL THEN 'valid' ELSE 'defective' END "
        "AS predicted, CASE WHEN l.expected = 'defective' THEN IF(f.rules IS NULL, 'FN', 'TP') ELSE IF(f.rules IS NULL, "
        "'TN', 'FP') END AS outcome, COALESCE(f.rules, '') AS triggered_rules, l.defect_category FROM labels AS l LEFT JOIN "
        "fired AS f USING (case_id))"])


def _eval_sql(body: str, ruleset: str = "improved") -> str:
    text = with_models(f"@@ {_case_sql(ruleset)}")
    head, inner = text.split("@@ ", 1)
    return head.rstrip() + ",\n" + inner + "\n" + body


for _set in ("baseline", "improved"):
    _add(f"e1_predictions_{_set}", lambda s, f, r=_set: plain(_predictions(s, f, r)),
         _eval_sql("SELECT * FROM predicted", _set))
    _share = "CASE WHEN {d} > 0 THEN round(CAST({n} AS DOUBLE) / {d}, 4) END AS {a}"
    _add(f"e3_confusion_{_set}", lambda s, f, r=_set: plain(E.confusion(_predictions(s, f, r))), _eval_sql(
        "SELECT tp, fn, fp, tn, tp + fn + fp + tn AS total, " + ", ".join(
            _share.format(n=n, d=d, a=a) for n, d, a in (
                ("(tp + tn)", "(tp + fn + fp + tn)", "accuracy"), ("tp", "(tp + fp)", "precision"),
                ("tp", "(tp + fn)", "recall"), ("(2 * tp)", "(2 * tp + fp + fn)", "f1_score"),
                ("tn", "(tn + fp)", "specificity")))
        + " FROM (SELECT COUNT(*) FILTER (outcome = 'TP') AS tp, COUNT(*) FILTER (outcome = 'FN') AS fn, COUNT(*) FILTER ("
          "outcome = 'FP') AS fp, COUNT(*) FILTER (outcome = 'TN') AS tn FROM predicted) AS x", _set))

_add("e2_outcomes_by_category",
     lambda s, f: plain(_predictions(s, f, "improved").groupBy("defect_category", "outcome").agg(
         F.count(F.lit(1)).alias("cases"))),
     _eval_sql("SELECT defect_category, outcome, COUNT(*) AS cases FROM predicted GROUP BY ALL"))


def _label_problems(s, f):
    """Every 100th label is spoiled on purpose; the validation must find exactly those."""
    labels = _labels(s, f)
    n = F.substring("case_id", 2, 20).cast("bigint") % 100
    spoiled = labels.withColumn("defect_category", F.when(n == 0, "business_rule").otherwise(
        F.col("defect_category"))).withColumn("expected", F.when(n == 0, "valid").when(n == 1, "maybe").otherwise(
            F.col("expected")))
    return E.label_problems(spoiled.unionByName(spoiled.filter(F.substring("case_id", 2, 20).cast("bigint") % 997 == 2)))


_KEYS = ("(SELECT 'O' || o_orderkey AS case_id, o_orderkey AS k FROM orders UNION ALL SELECT 'C' || c_custkey, c_custkey FROM customer "
         "UNION ALL SELECT 'T' || event_id, event_id FROM events) AS x")
_add("e4_suite_validation", _label_problems,
     f"SELECT case_id, 'duplicate case id' AS problem FROM {_KEYS} WHERE k % 997 = 2 UNION ALL "
     f"SELECT case_id, CASE WHEN k % 100 = 1 THEN 'unknown label' ELSE 'valid case with a category' END FROM {_KEYS} WHERE k % 100 IN (0, 1)")


def _hashes(s, f):
    return E.content_hash(_labels(s, f), "case_id")


_add("e5_case_hashes", _hashes, _eval_sql(
    "SELECT case_id, substr(sha256('{\"case_id\":\"' || case_id || '\"' || CASE WHEN defect_category IS NOT NULL THEN "
    "',\"defect_category\":\"' || defect_category || '\"' ELSE '' END || ',\"expected\":\"' || expected || '\"}'), 1, 16) "
    "AS content_hash FROM labels"))
_CASE_HASHES = ORACLE["e5_case_hashes"].rsplit("\nSELECT case_id", 1)
_add("e5_suite_hash", lambda s, f: E.suite_hash(_hashes(s, f)), _CASE_HASHES[0] + (
    ", hashes AS (SELECT case_id" + _CASE_HASHES[1] + "), lines AS (SELECT substr(content_hash, 1, 3) AS bucket, case_id || ':' || "
    "content_hash AS line FROM hashes), digests AS (SELECT bucket, sha256(string_agg(line, ',' ORDER BY line)) AS digest FROM lines "
    "GROUP BY bucket) SELECT substr(sha256(string_agg(bucket || ':' || digest, ',' ORDER BY bucket)), 1, 16) AS suite_hash FROM digests"))


def _compared(s, f):
    """Predictions of both rulesets from one evaluation of all rules."""
    every = checkpoint(_predictions(s, f, None))
    return tuple(E.of_ruleset(every, select_ruleset(_ALL, ruleset)) for ruleset in ("baseline", "improved"))


def _side_by_side(s, f):
    before, after = _compared(s, f)
    return plain(E.compare_detectors(before, after).filter("outcome <> baseline_outcome").select(
        "case_id", "outcome", "baseline_outcome", "triggered_rules"))


def _two_sql(body: str) -> str:
    """Both rulesets in one statement: the baseline's CTEs get another name."""
    second = _case_sql("baseline").split("fired AS MATERIALIZED ", 1)[1]
    second = "fired0 AS MATERIALIZED " + second.replace("labels AS (", "labels0 AS (").replace(
        "predicted AS MATERIALIZED", "predicted0 AS MATERIALIZED").replace("FROM labels AS l LEFT JOIN fired AS f",
                                                                           "FROM labels0 AS l LEFT JOIN fired0 AS f")
    text = with_models(f"@@ {_case_sql('improved')}, {second}")
    head, inner = text.split("@@ ", 1)
    return head.rstrip() + ",\n" + inner + "\n" + body


_add("e7_detectors_side_by_side", _side_by_side, _two_sql(
    "SELECT a.case_id, a.outcome, b.outcome AS baseline_outcome, a.triggered_rules FROM predicted AS a JOIN predicted0 AS b "
    "USING (case_id) WHERE a.outcome <> b.outcome"))


def _fixes(s, f):
    before, after = _compared(s, f)
    return plain(E.error_fixes(before, after, rules_frame(s, _ALL)).select("case_id", "error", "improved_outcome", "triggered_rules"))


_add("e6_baseline_errors_after_improvement", _fixes, _two_sql(
    "SELECT b.case_id, b.outcome AS error, a.outcome AS improved_outcome, a.triggered_rules FROM predicted0 AS b JOIN "
    "predicted AS a USING (case_id) WHERE b.outcome IN ('FN', 'FP')"))
# Going back from the improved to the baseline ruleset loses cases, so this pair has regressions.
_add("e10_regressions_of_a_rollback",
     lambda s, f: (lambda p: plain(E.regressions(p[1], p[0]).select("case_id", "outcome")))(_compared(s, f)),
     _two_sql("SELECT b.case_id, b.outcome FROM predicted AS a JOIN predicted0 AS b USING (case_id) WHERE b.outcome IN "
              "('FN', 'FP') AND a.outcome IN ('TP', 'TN')"))
_add("e10_regressions",
     lambda s, f: (lambda p: plain(E.regressions(*p).select("case_id", "outcome")))(_compared(s, f)),
     _two_sql("SELECT a.case_id, a.outcome FROM predicted AS a JOIN predicted0 AS b USING (case_id) WHERE a.outcome IN "
              "('FN', 'FP') AND b.outcome IN ('TP', 'TN')"))


def _eval_runs(s, f):
    """Three evaluation runs appended to one table; the latest per detector is kept. All rules are judged once for both detectors."""
    folder = shared_folder(s)
    predictions = dict(zip(("baseline", "improved"), _compared(s, f), strict=True))
    for run_id, detector in ((1, "baseline"), (2, "improved"), (3, "improved")):
        matrix = E.confusion(predictions[detector]).select(F.lit("orders").alias("suite"), F.lit(detector).alias(
            "detector"), F.lit(run_id).alias("eval_run_id"), "tp", "fn", "fp", "tn")
        T.append_run(matrix, folder, run_id)
    return plain(E.latest_runs(s.read.parquet(folder).drop("run_id")))


_add("e8_latest_evaluation_runs", _eval_runs, _two_sql(
    "SELECT 'orders' AS suite, d AS detector, i AS eval_run_id, COUNT(*) FILTER (outcome = 'TP') AS tp, COUNT(*) FILTER ("
    "outcome = 'FN') AS fn, COUNT(*) FILTER (outcome = 'FP') AS fp, COUNT(*) FILTER (outcome = 'TN') AS tn FROM (SELECT "
    "'baseline' AS d, 1 AS i, outcome FROM predicted0 UNION ALL SELECT 'improved', 3, outcome FROM predicted) AS x GROUP BY ALL"))


def _result_json(s, f):
    folder = shared_folder(s)
    T.write_json(_predictions(s, f, "improved"), folder)
    return plain(s.read.schema("case_id string, outcome string, triggered_rules array<string>").json(folder))


_add("s13_evaluation_json_roundtrip", _result_json,
     _eval_sql("SELECT case_id, outcome, triggered_rules FROM predicted"))
_add("s8_cases_with_shared_context",
     lambda s, f: (lambda t, labels: labels.filter("case_id LIKE 'O%'").join(
         t["stg_payments"].groupBy("case_id").agg(F.count(F.lit(1)).alias("payments")), "case_id", "left").join(
         t["stg_order_items"].groupBy("case_id").agg(F.count(F.lit(1)).alias("items")), "case_id", "left").select(
         "case_id", "expected", F.coalesce("payments", F.lit(0)).alias("payments"), F.coalesce("items", F.lit(0)).alias("items")))(
         _cases(s, f, "O"), _labels(s, f)),
     _eval_sql("SELECT l.case_id, l.expected, COALESCE(p.n, 0) AS payments, COALESCE(i.n, 0) AS items FROM labels AS l LEFT JOIN (SELECT "
               "case_id, COUNT(*) AS n FROM k_O_payments GROUP BY 1) AS p USING (case_id) LEFT JOIN (SELECT case_id, COUNT(*) AS n FROM "
               "k_O_order_items GROUP BY 1) AS i USING (case_id) WHERE l.case_id LIKE 'O%'"))

# Order cases over a curated context of customers with one defective row. A third of the cases bring a repaired row of their own
# customer (some of whom the context lacks), a fifth replace the defective row, the others are all touched by it.
_CLEAN = (f"email IS NOT NULL AND customer_id IS NOT NULL AND customer_status IN ('active', 'inactive', 'churned') AND NOT COALESCE(signed_up_at < "
          f"{{ts}} '{TRADING_START}' OR signed_up_at > {{ts}} '{CUTOFF}', FALSE)")
_CONTEXT_ASSETS = ("stg_orders", "stg_order_items", "stg_payments", "stg_refunds", "stg_customers")


def _context_rules():
    return [r for r in select_ruleset(_ALL, "improved") if r.asset in _CONTEXT_ASSETS]


def _overlay(s, f):
    own = _cases(s, f, "O")
    shared = {name: own.pop(name) for name in ("stg_customers", "stg_products", "stg_campaigns", "stg_subscriptions")}
    labels = checkpoint(_labels(s, f).filter("case_id LIKE 'O%'"))
    customers = shared["stg_customers"].filter(_CLEAN.format(ts="TIMESTAMP_NTZ"))
    once = customers.groupBy("customer_id").count().filter("count = 1").select("customer_id")
    clean = checkpoint(customers.join(once, "customer_id", "left_semi").select(*shared["stg_customers"].columns))
    broken = clean.agg(F.min("customer_id").alias("_first"))
    shared["stg_customers"] = clean.join(broken, clean["customer_id"] == broken["_first"], "left").withColumn(
        "customer_status", F.when(F.col("_first").isNotNull(), "unknown").otherwise(F.col("customer_status"))).drop("_first")
    k = F.substring("case_id", 2, 20).cast("bigint")
    brought = own["stg_orders"].filter(k % 3 == 0).select("case_id", "customer_id").dropna().unionByName(
        labels.filter(k % 5 == 1).select("case_id", F.lit(1).alias("one")).join(broken.select(F.lit(1).alias("one"), F.col("_first").alias("customer_id")), "one")
        .select("case_id", "customer_id")).distinct()
    fixed = {"email": F.lit("repaired"), "customer_status": F.lit("active"), "signed_up_at": F.lit(TRADING_START).cast("timestamp_ntz")}
    own["stg_customers"] = brought.select("case_id", *[
        F.col(c.name) if c.name == "customer_id" else fixed.get(c.name, F.lit(None)).cast(c.dataType).alias(c.name) for c in clean.schema])
    return V.predict_with_context(own, shared, {"stg_customers": ["customer_id"]}, _context_rules(), labels, CUTOFF)


def _overlay_sql() -> str:
    start, fired = _case_sql("improved").split("fired AS MATERIALIZED ", 1)
    lines = [x for x in fired.split("FROM (", 1)[1].rsplit(") AS x GROUP BY case_id), labels AS", 1)[0].split("\nUNION ALL ") if "'k_" not in x]
    own = {r.key: r for r in _context_rules() if r.asset != "stg_customers"}
    kept = []
    for line in lines:
        key = re.search(r"'(\w+)' AS rule_key", line)[1]
        if key in own:
            missing = "p.customer_id NOT IN (SELECT customer_id FROM stg_customers WHERE customer_id IS NOT NULL)"
            line = line.replace(missing, "p.customer_id NOT IN (SELECT customer_id FROM clean) AND NOT EXISTS (FROM brought AS o WHERE o.case_id = "
                                         "p.case_id AND o.customer_id = p.customer_id)")
            assert "stg_customers" not in line
            kept.append(line)
    assert len(kept) == len(own)
    labels = "labels AS" + _case_sql("improved").rsplit(", labels AS", 1)[1].split(", predicted AS", 1)[0]
    text = with_models("@@ " + ", ".join([
        start.rstrip().rstrip(","), labels,
        f"clean AS MATERIALIZED (SELECT * FROM stg_customers WHERE {_CLEAN.format(ts='TIMESTAMP')} QUALIFY COUNT(*) OVER (PARTITION BY customer_id) = 1)",
        "brought AS MATERIALIZED (SELECT case_id, customer_id FROM k_O_orders WHERE customer_id IS NOT NULL AND CAST(substr(case_id, 2) AS BIGINT) % 3 = 0 "
        "UNION SELECT case_id, (SELECT MIN(customer_id) FROM clean) FROM labels WHERE case_id LIKE 'O%' AND CAST(substr(case_id, 2) AS BIGINT) % 5 = 1)",
        "lines AS (" + "\nUNION ALL ".join(kept) + " UNION ALL SELECT l.case_id, 'customers_status_accepted_values' FROM labels AS l WHERE l.case_id LIKE 'O%' "
        "AND NOT EXISTS (FROM brought AS o WHERE o.case_id = l.case_id AND o.customer_id = (SELECT MIN(customer_id) FROM clean)))",
        "fired AS MATERIALIZED (SELECT case_id, array_to_string(list(DISTINCT rule_key ORDER BY rule_key), ',') AS rules FROM lines GROUP BY case_id)"]))
    head, inner = text.split("@@ ", 1)
    return head.rstrip() + ",\n" + inner + (
        " SELECT l.case_id, l.expected, IF(f.rules IS NULL, 'valid', 'defective') AS predicted, CASE WHEN l.expected = 'defective' THEN IF(f.rules IS NULL, "
        "'FN', 'TP') ELSE IF(f.rules IS NULL, 'TN', 'FP') END AS outcome, COALESCE(f.rules, '') AS triggered_rules, l.defect_category FROM labels AS l "
        "LEFT JOIN fired AS f USING (case_id) WHERE l.case_id LIKE 'O%'")


_add("e1_overridden_context", lambda s, f: plain(_overlay(s, f)), _overlay_sql())

# ------------------------------------------------------------------ corruption

# Clean copies of three tables: the planted rows of the adapter are filtered out, then new defects go in.
_K = "CAST(regexp_extract({c}, '([0-9]+)', 1) AS BIGINT)"
_KS = lambda c: F.regexp_extract(c, r"([0-9]+)", 1).cast("bigint")


def _orders(s, f):
    return Bed(s, f).staging["stg_orders"].filter("order_id IS NOT NULL")


_pick = lambda: _KS("order_id") % 97 == 3
_OK = f"{_K.format(c='order_id')} % 97 = 3"


def _order_case(name, change, columns, sql_columns):
    def run(s, f):
        return plain(change(_orders(s, f)).select("order_id", *columns))
    _add(name, run, with_models(f"SELECT order_id, {sql_columns} FROM stg_orders WHERE order_id IS NOT NULL"))


_order_case("d1_orphan_foreign_key", lambda df: D.orphan_key(df, _pick(), "customer_id"), ["customer_id"],
            f"IF({_OK}, 'LEGACY-' || customer_id, customer_id) AS customer_id")
_order_case("d3_null_a_column", lambda df: D.null_out(df, _pick(), "currency"), ["currency"],
            f"IF({_OK}, NULL, currency) AS currency")
_order_case("d4_shift_a_timestamp", lambda df: D.shift_time(df, _pick(), "ordered_at", 525600), ["ordered_at"],
            f"CAST(IF({_OK}, ordered_at + INTERVAL '365' DAY, ordered_at) AS VARCHAR) AS ordered_at")
_order_case("d5_replace_a_category", lambda df: D.set_value(df, _pick(), "order_status", "in_transit"), ["order_status"],
            f"IF({_OK}, 'in_transit', order_status) AS order_status")
_order_case("d10_edit_without_parent", lambda df: D.add_amount(df, _pick(), "tax_amount", 0.37), ["tax_amount"],
            f"CAST(tax_amount AS DOUBLE) + IF({_OK}, 0.37, 0) AS tax_amount")
_order_case("d9_repoint_a_key", lambda df: D.repoint_key(df, _pick(), "customer_id", F.concat(
    F.lit("C"), (_KS("customer_id") + 1) % 100)), ["customer_id"],
    f"IF({_OK}, 'C' || (({_K.format(c='customer_id')} + 1) % 100), customer_id) AS customer_id")
_add("d2_replay_rows",
     lambda s, f: plain(D.replay(_orders(s, f), _pick()).select("order_id", "loaded_at")),
     with_models(f"SELECT order_id, CAST(loaded_at AS VARCHAR) AS loaded_at FROM stg_orders WHERE order_id IS NOT NULL UNION "
                 f"ALL SELECT order_id, CAST(loaded_at + INTERVAL '2' HOUR AS VARCHAR) FROM stg_orders WHERE {_OK}"))
_add("d6_end_before_start",
     lambda s, f: plain(D.end_before_start(Bed(s, f).staging["stg_subscriptions"], _KS("subscription_id") % 11 == 1,
                                           "started_on", "ended_on", 14).select("subscription_id", "ended_on")),
     with_models(f"SELECT subscription_id, CAST(IF({_K.format(c='subscription_id')} % 11 = 1, started_on - 14, ended_on) AS "
                 f"VARCHAR) AS ended_on FROM stg_subscriptions"))
_add("d7_inflate_above_parent",
     lambda s, f: (lambda st: plain(D.inflate_above_parent(
         st["stg_refunds"], st["stg_payments"], _KS("payment_id") % 13 == 1, "payment_id", "refund_amount", "amount", 15)
         .select("refund_id", "refund_amount")))(Bed(s, f).staging),
     with_models(f"SELECT r.refund_id, CAST(IF({_K.format(c='r.payment_id')} % 13 = 1 AND p.top IS NOT NULL, p.top + 15, "
                 f"r.refund_amount) AS DOUBLE) AS refund_amount FROM stg_refunds AS r LEFT JOIN (SELECT payment_id, MAX(amount) "
                 f"AS top FROM stg_payments GROUP BY 1) AS p USING (payment_id)"))


def _excess(s, f):
    st = Bed(s, f).staging
    rows = [[F.concat(F.lit(f"RX{i}-"), "payment_id").alias("refund_id"), F.col("payment_id"),
             (F.col("amount") * F.lit(0.6)).alias("refund_amount"), F.lit("goodwill").alias("refund_reason"),
             F.col("processed_at").alias("refunded_at"), F.col("loaded_at")] for i in (1, 2)]
    return plain(D.excess_children(st["stg_refunds"], st["stg_payments"], _KS("payment_id") % 101 == 7, rows).groupBy(
        "payment_id").agg(F.count(F.lit(1)).alias("refunds"), F.sum("refund_amount").alias("refunded")))


_add("d8_children_exceed_parent", _excess, with_models(
    f"SELECT payment_id, COUNT(*) AS refunds, CAST(SUM(a) AS DOUBLE) AS refunded FROM (SELECT payment_id, refund_amount AS a "
    f"FROM stg_refunds UNION ALL SELECT payment_id, CAST(amount * 0.6 AS DECIMAL(12,2)) FROM stg_payments, (VALUES (1), (2)) "
    f"AS v(i) WHERE {_K.format(c='payment_id')} % 101 = 7) AS x GROUP BY payment_id"))
_add("d11_negate_amounts",
     lambda s, f: plain(D.negate(Bed(s, f).staging["stg_order_items"], F.coalesce(
         _KS("order_id") % 89 == 5, F.lit(False)), "quantity", "line_amount").select(
         "order_item_id", "product_id", "quantity", "line_amount")),
     with_models(f"SELECT order_item_id, product_id, CAST(IF({_K.format(c='order_id')} % 89 = 5, -quantity, quantity) AS BIGINT) "
                 f"AS quantity, CAST(IF({_K.format(c='order_id')} % 89 = 5, -line_amount, line_amount) AS DOUBLE) AS line_amount "
                 f"FROM stg_order_items"))


def _planted(s, f):
    """Plant four kinds of defects into clean orders and describe them."""
    orders = _orders(s, f)
    spots = {"orphaned_order_customer": ("orders_customer_exists", 3, 1), "invalid_order_status": (
        "orders_status_accepted_values", 4, 1), "future_order_date": ("orders_ordered_at_not_future", 5, 1),
        "duplicate_order_id": ("orders_order_id_unique", 6, 2)}
    at = {kind: _KS("order_id") % 97 == n for kind, (_, n, _r) in spots.items()}
    records = None
    for kind, (rule, _, rows) in spots.items():
        one = D.truth(orders.dropDuplicates(["order_id"]), at[kind], kind, "stg_orders", rule, "order_id", rows)
        records = one if records is None else records.unionByName(one)
    bad = D.orphan_key(orders, at["orphaned_order_customer"], "customer_id")
    bad = D.set_value(bad, at["invalid_order_status"], "order_status", "in_transit")
    bad = D.shift_time(bad, at["future_order_date"], "ordered_at", 60 * 24 * 3650)
    return D.replay(bad, at["duplicate_order_id"]), checkpoint(records)


_TRUTH = ("SELECT CASE k % 97 WHEN 3 THEN 'orphaned_order_customer' WHEN 4 THEN 'invalid_order_status' WHEN 5 THEN "
          "'future_order_date' ELSE 'duplicate_order_id' END AS defect_type, COUNT(*) AS n, IF(k % 97 = 6, 2, 1) AS per FROM "
          f"(SELECT DISTINCT {_K.format(c='order_id')} AS k FROM stg_orders WHERE order_id IS NOT NULL) AS x WHERE k % 97 "
          "BETWEEN 3 AND 6 GROUP BY ALL")
_RULE_OF = ("CASE defect_type WHEN 'orphaned_order_customer' THEN 'orders_customer_exists' WHEN 'invalid_order_status' THEN "
            "'orders_status_accepted_values' WHEN 'future_order_date' THEN 'orders_ordered_at_not_future' ELSE "
            "'orders_order_id_unique' END")
_add("d12_ground_truth", lambda s, f: plain(D.truth_summary(_planted(s, f)[1])), with_models(
    f"SELECT defect_type, 'stg_orders' AS table_name, {_RULE_OF} AS primary_rule, n AS injected_records, n * per AS "
    f"expected_failing_rows FROM ({_TRUTH}) AS t"))
_PLANTED = (f"planted AS (SELECT DISTINCT order_id AS record_id, CASE k % 97 WHEN 3 THEN 'orphaned_order_customer' WHEN 4 THEN 'invalid_order_status' WHEN 5 "
            f"THEN 'future_order_date' ELSE 'duplicate_order_id' END AS defect_type FROM (SELECT order_id, {_K.format(c='order_id')} AS k FROM stg_orders "
            "WHERE order_id IS NOT NULL) AS x WHERE k % 97 BETWEEN 3 AND 6)")


def _with_planted(body: str, *extra: str) -> str:
    text = with_models("@@ " + ", ".join([_PLANTED, *extra]))
    head, inner = text.split("@@ ", 1)
    return head.rstrip() + ",\n" + inner + " " + body


_add("d12_no_overlap", lambda s, f: D.overlapping_records(_planted(s, f)[1]).agg(F.count(F.lit(1)).alias("overlaps")),
     _with_planted("SELECT COUNT(*) AS overlaps FROM (SELECT record_id FROM planted GROUP BY 1 HAVING COUNT(DISTINCT defect_type) > 1) AS x"))


def _manifest(s, f):
    """Summary and records written as JSON and read again: one line per defect and per planted record, so that no line grows."""
    folder = shared_folder(s)
    records = _planted(s, f)[1]
    columns = rules_frame(s, _ALL).select(F.col("rule_key").alias("primary_rule"), "columns")
    T.write_json(D.truth_summary(records).join(columns, "primary_rule"), f"{folder}/defects")
    T.write_json(records.select("defect_type", "record_id"), f"{folder}/records")
    schema = "defect_type string, primary_rule string, injected_records bigint, expected_failing_rows bigint, columns array<string>"
    named = s.read.schema("defect_type string, record_id string").json(f"{folder}/records")
    return plain(s.read.schema(schema).json(f"{folder}/defects").join(named, "defect_type"))


_COLUMNS_OF = "CASE primary_rule " + " ".join(
    f"WHEN '{k}' THEN '{','.join(S.RULES[k].columns)}'" for k in ("orders_customer_exists", "orders_status_accepted_values", "orders_ordered_at_not_future",
                                                                 "orders_order_id_unique")) + " END"
_add("s3_ground_truth_manifest", _manifest, _with_planted(
    f"SELECT t.defect_type, t.primary_rule, t.injected_records, t.expected_failing_rows, {_COLUMNS_OF} AS columns, p.record_id FROM (SELECT defect_type, "
    f"{_RULE_OF} AS primary_rule, n AS injected_records, n * per AS expected_failing_rows FROM ({_TRUTH}) AS y) AS t JOIN planted AS p USING (defect_type)"))


def _coverage(s, f):
    bad, records = _planted(s, f)
    tables = {**dict(Bed(s, f).staging), "stg_orders": bad}
    rules = [S.RULES[k] for k in ("orders_customer_exists", "orders_status_accepted_values", "orders_ordered_at_not_future",
                                  "orders_order_id_unique")]
    counts = Q.rule_counts(s, tables, rules, CUTOFF)
    return plain(E.coverage(D.truth_summary(records), counts, rules_frame(s, _ALL)).select(
        "defect_type", "executed_rule", "injected_records", "expected_failing_rows", "found", "covered"))


def _coverage_sql() -> str:
    k = _K.format(c="order_id")
    changed = {"customer_id": f"IF({k} % 97 = 3, 'LEGACY-' || customer_id, customer_id)", "order_status": f"IF({k} % 97 = 4, 'in_transit', order_status)",
               "ordered_at": f"IF({k} % 97 = 5, ordered_at + INTERVAL '3650' DAY, ordered_at)"}
    spoiled = "SELECT * REPLACE (" + ", ".join(f"{v} AS {c}" for c, v in changed.items()) + ") FROM stg_orders WHERE order_id IS NOT NULL"
    bad = f"bad AS MATERIALIZED ({spoiled} UNION ALL SELECT * FROM stg_orders WHERE order_id IS NOT NULL AND {k} % 97 = 6)"
    found = "found AS (" + " UNION ALL ".join(
        f"SELECT '{key}' AS executed_rule, COUNT(*) AS found FROM bad AS p WHERE " + S.predicate(key).replace("FROM stg_orders AS q", "FROM bad AS q")
        for key in ("orders_customer_exists", "orders_status_accepted_values", "orders_ordered_at_not_future", "orders_order_id_unique")) + ")"
    return _with_planted(
        "SELECT t.defect_type, t.executed_rule, t.injected_records, t.expected_failing_rows, f.found, f.found >= t.expected_failing_rows AS covered FROM ("
        f"SELECT defect_type, {_RULE_OF} AS executed_rule, n AS injected_records, n * per AS expected_failing_rows FROM ({_TRUTH}) AS y) AS t JOIN found AS f "
        "USING (executed_rule)", bad, found)


_add("e9_ground_truth_coverage", _coverage, _coverage_sql())
