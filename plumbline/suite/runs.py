"""Queries over quality runs: health, impact, priority and issues.

The run history is one back-fill of daily runs over the landed tables, appended to a run table once per
session, as a scheduler would. Between runs the owners repair what fails: each rule's known failing rows are corrected after
the runs that ``_REPAIRED_AFTER`` gives for its severity.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import health as H
from plumbline.operators import impact as B
from plumbline.operators import issues as I
from plumbline.operators import priority as P
from plumbline.operators import quality as Q
from plumbline.operators.rules import SEVERITY_WEIGHT, rules_frame, select_ruleset
from plumbline.plans import commerce_catalog as C
from plumbline.plans.model_sql import ctes, with_models
from plumbline.session import checkpoint, shared_folder
from plumbline.suite import rule_sql as S
from plumbline.suite.common import Bed, plain

QUERIES = {}
ORACLE = {}

RULES = select_ruleset(list(S.RULES.values()), "improved")
_LAST, _DAYS = date(2001, 8, 1), 10
_HISTORY: dict[tuple[str, str], str] = {}
_REPAIRED_AFTER = {"critical": (4,), "high": (), "medium": (5, 8), "low": (6,)}


def _repairs(spark) -> DataFrame:
    """(rule_key, at): six hours after a run, all rows it found are corrected."""
    days = Q.backfill_days(_LAST, _DAYS)
    return spark.createDataFrame([(r.key, days[run - 1] + timedelta(hours=6)) for r in RULES for run in _REPAIRED_AFTER[r.severity]],
                                 "rule_key string, at timestamp_ntz")


def history(spark, folder) -> DataFrame:
    """(run_id, as_of, rule_key, scanned, failed, status, failure_rate) of ten daily runs."""
    bed = Bed(spark, folder)
    key = (spark.sparkContext.applicationId, folder)
    if key not in _HISTORY:
        runs = Q.after_repairs(Q.backfill(spark, bed.land().staging, RULES, _LAST, _DAYS), _repairs(spark))
        first = F.lit(_LAST - timedelta(days=_DAYS))
        target = shared_folder(spark)
        runs.withColumn("run_id", F.datediff(F.col("as_of").cast("date"), first).cast("bigint")).write.partitionBy(
            "run_id").parquet(target)
        _HISTORY[key] = target
    schema = ("rule_key string, as_of timestamp_ntz, scanned bigint, failed bigint, error string, status string, "
              "failure_rate double, run_id bigint")
    return spark.read.schema(schema).parquet(_HISTORY[key])


class Runs:
    """Run history with the metadata it joins to."""

    def __init__(self, spark, folder) -> None:
        self.spark, self.folder = spark, folder
        self.history = history(spark, folder)
        self.rules = rules_frame(spark, RULES)
        self.nodes = C.asset_frame(spark)
        self.columns = C.column_frame(spark)
        self.scored = H.scored_results(self.history, self.rules)
        self._impacted = self._of_issues = None

    @property
    def latest(self) -> DataFrame:
        return H.of_latest_run(self.scored)

    @property
    def actions(self) -> DataFrame:
        """Triage by rule key length: some investigate, some accept, some close; later all reopen."""
        size = F.length("rule_key") % 3
        runs = self.history.filter("run_id IN (3, 5, 6, 8)")
        wanted = F.when(F.col("run_id") == 8, "open").when(
            (F.col("run_id") == 3) & (size == 0), "investigating").when(
            (F.col("run_id") == 5) & (size == 1), "accepted").when((F.col("run_id") == 6) & (size == 2), "resolved")
        return runs.select("rule_key", (F.col("as_of") + F.expr("INTERVAL '12' HOUR")).alias("at"),
                           F.lit("action").alias("kind"), wanted.alias("status"), F.lit("desk").alias("actor"),
                           F.lit(None).cast("string").alias("note")).filter("status IS NOT NULL")

    @property
    def comments(self) -> DataFrame:
        """What the desk noted after three runs; some notes are blank and some lack a name."""
        size = F.length("rule_key")
        return self.history.filter("run_id IN (2, 6, 9)").select(
            "rule_key", (F.col("as_of") + F.expr("INTERVAL '13' HOUR")).alias("at"), F.lit("comment").alias("kind"),
            F.lit(None).cast("string").alias("status"), F.when(size % 7 == 0, " ").otherwise("  desk ").alias("actor"),
            F.when(size % 5 == 0, "   ").otherwise(F.format_string(" %d rows fail after run %d ", "failed", "run_id")).alias("note"))

    def triaged(self) -> tuple[DataFrame, DataFrame]:
        """Valid and invalid entries of the desk."""
        return I.triage(self.actions.unionByName(self.comments))

    @property
    def last_failing(self) -> DataFrame:
        """Each rule's last failing result: what its issue is about, whether or not it passes by now."""
        rest = [c for c in self.scored.columns if c != "rule_key"]
        last = self.scored.filter("status = 'fail'").groupBy("rule_key").agg(F.max_by(F.struct(*rest), "run_id").alias("r"))
        return last.select("rule_key", *[f"r.{c}" for c in rest])

    def _defects(self, failing: DataFrame) -> DataFrame:
        return checkpoint(B.defects_of_rules(self.rules.join(failing.select("rule_key"), "rule_key", "left_semi")))

    @property
    def defects(self) -> DataFrame:
        return self._defects(self.latest.filter("status = 'fail'"))

    def _impact(self, failing: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        defects, edges = self._defects(failing), C.edge_frame(self.spark)
        impacted = checkpoint(B.impacted_assets(edges, self.nodes, defects))
        return defects, impacted, B.impact_summary(edges, self.nodes, defects, impacted)

    def impact(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(defects, impacted, summary) of all rules failing in the latest run."""
        if self._impacted is None:
            self._impacted = self._impact(self.latest.filter("status = 'fail'"))
        return self._impacted

    def _scores(self, results: DataFrame, summary: DataFrame) -> DataFrame:
        critical = B.critical_elements(B.defects_of_rules(self.rules).select(
            "seed", "asset").join(self.rules.select(F.col("rule_key").alias("seed"), "columns"), "seed"), self.columns)
        return P.score(P.signals(results, self.rules, summary, critical))

    def priorities(self) -> DataFrame:
        return self._scores(self.latest, self.impact()[2])

    def issue_impact(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(defects, impacted, summary) of every rule that has an issue."""
        if self._of_issues is None:
            self._of_issues = self._impact(self.last_failing)
        return self._of_issues

    def issues(self, log: DataFrame | None = None) -> DataFrame:
        """Issues with ownership, and the priority and impact of their last failure."""
        scores = self._scores(self.last_failing, self.issue_impact()[2]).select(
            F.col("seed").alias("rule_key"), "priority_score", "priority_band", "impact_score")
        described = I.describe(I.current(I.fold(self.history) if log is None else log), self.rules, self.issue_impact()[2])
        critical = B.critical_elements(self.rules.select(F.col("rule_key").alias("seed"), "asset", "columns"), self.columns).select(
            F.col("seed").alias("rule_key"), F.transform("critical_columns", lambda c: c["column_name"]).alias("critical_columns"))
        owner = self.nodes.select("asset", "owner", "layer", F.col("criticality").alias("business_criticality"))
        return described.join(owner, "asset").join(scores, "rule_key", "left").join(critical, "rule_key", "left")


# ------------------------------------------------------------------ SQL pieces

def _text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def _values(name: str, columns: str, rows: list[str]) -> str:
    return f"{name}({columns}) AS (VALUES {', '.join(rows)})"


def _list(values) -> str:
    return "CAST(NULL AS VARCHAR[])" if values is None else \
        "CAST([" + ", ".join(_text(v) for v in values) + "] AS VARCHAR[])"


def _meta_ctes() -> list[str]:
    critical = {(r[0], r[1]): r[4] for r in C.columns() if r[3]}
    rules = [
        f"({_text(r.key)}, {_text(r.asset)}, {_text(r.category)}, {_text(r.severity)}, {SEVERITY_WEIGHT[r.severity]}, "
        f"{_list(() if r.category in B.ROW_LEVEL_CATEGORIES else r.columns)}, "
        f"{_list([critical[(r.asset, c)] for c in r.columns if (r.asset, c) in critical])})" for r in RULES]
    nodes = [f"({_text(a[0])}, {_text(a[1])}, {_text(a[2])}, {_text(a[3])}, {_text(a[4])}, {_text(a[5])}, "
             f"{a[6] == 'executive' or a[3] == 'executive'}, {a[7]}, {a[8]}, {_text(a[9])})" for a in C.assets()]
    edges = [f"({_text(u)}, {_text(d)}, {_list(c)})" for u, d, c in C.edges()]
    return [
        _values("rule_meta", "rule_key, asset, category, severity, weight, tracked, cde", rules),
        _values("nodes", "asset, asset_type, layer, domain, owner, criticality, executive, financial, facing, system",
                nodes),
        _values("edges", "up, down, refs", edges),
    ]


def _counts_sql(runs) -> str:
    cutoffs = Q.backfill_days(_LAST, _DAYS)
    return "\nUNION ALL ".join(
        S.counts_sql([r.key for r in RULES], str(cutoffs[i - 1]), True, f", {i} AS run_id, TIMESTAMP '{cutoffs[i - 1]}' AS as_of") for i in runs)


# Rows known to a repair are taken off all later runs.
_REPAIR = "CASE m.severity " + " ".join(
    f"WHEN '{severity}' THEN CASE " + " ".join(f"WHEN c.run_id > {d} THEN {d}" for d in sorted(days, reverse=True)) + " END"
    for severity, days in _REPAIRED_AFTER.items() if days) + " END"
_RUNS = ("runs AS MATERIALIZED (SELECT c.rule_key, c.scanned, GREATEST(0, c.failed - COALESCE(b.failed, 0)) AS failed, c.run_id, c.as_of "
         f"FROM counted AS c JOIN rule_meta AS m USING (rule_key) LEFT JOIN counted AS b ON b.rule_key = c.rule_key AND b.run_id = {_REPAIR})")
_SCORED = ("scored AS MATERIALIZED (SELECT h.*, m.asset, m.category, m.severity, m.weight, "
           "CASE WHEN h.failed > 0 THEN 'fail' ELSE 'pass' END AS status, "
           "CASE WHEN h.failed = 0 THEN 1.0 ELSE round(0.5 * (1 - LEAST(1.0, CAST(h.failed AS DOUBLE) / h.scanned "
           "/ 0.05)), 4) END AS score FROM runs AS h JOIN rule_meta AS m USING (rule_key){latest})")


def _sql(body: str, *extra: str, whole: bool = False) -> str:
    """Query over ``scored`` (all runs when ``whole``, else the latest)."""
    needed = sorted({_DAYS, *(d for days in _REPAIRED_AFTER.values() for d in days)})
    source = _counts_sql(range(1, _DAYS + 1) if whole else needed)
    base = with_models("@@", {})
    text = with_models(f"@@ {source}")
    head, inner = text.split("@@ ", 1)
    prefix = head.rstrip() + ",\n" if head.strip() else "WITH RECURSIVE "
    assert base == "@@" and ctes()
    latest = "" if whole else f" WHERE h.run_id = {_DAYS}"
    parts = [f"counted AS MATERIALIZED ({inner})", *_meta_ctes(), _RUNS, _SCORED.replace("{latest}", latest), *extra]
    return prefix + ",\n".join(parts) + "\n" + body


def _add(name, run, sql=None):
    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = sql


_HEALTH = "round(100 * SUM(score * weight) / SUM(weight), {d})"

# ------------------------------------------------------------------ health

_add("h1_rule_scores",
     lambda s, f: plain(Runs(s, f).latest.select("rule_key", "status", "failed", "rule_score", "severity_weight")),
     _sql("SELECT rule_key, status, failed, CAST(score AS DOUBLE) AS rule_score, CAST(weight AS BIGINT) AS "
          "severity_weight FROM scored"))
_add("h3_run_health",
     lambda s, f: plain(H.run_health(Runs(s, f).scored)),
     _sql("SELECT run_id, CAST(as_of AS VARCHAR) AS as_of, COUNT(*) AS rules_executed, COUNT(*) FILTER (status = "
          "'fail') AS rules_failed, 0 AS rules_errored, " + _HEALTH.format(d=2) + " AS health FROM scored GROUP BY ALL",
          whole=True))
_add("h4_asset_health",
     lambda s, f: (lambda r: plain(H.asset_health(r.latest, r.nodes)))(Runs(s, f)),
     _sql("SELECT asset, n.layer, n.owner, COUNT(*) AS rules, COUNT(*) FILTER (status = 'fail') AS failing_rules, "
          + _HEALTH.format(d=1) + " AS health FROM scored JOIN nodes AS n USING (asset) GROUP BY asset, n.layer, n.owner"))
_add("h6_category_trend",
     lambda s, f: plain(H.category_trend(Runs(s, f).scored)),
     _sql("SELECT CAST(as_of AS VARCHAR) AS as_of, category, COUNT(*) FILTER (status = 'fail') AS failing_rules, "
          "CAST(SUM(failed) AS BIGINT) AS failing_records FROM scored GROUP BY ALL", whole=True))
_add("h7_rule_history",
     lambda s, f: plain(H.rule_history(Runs(s, f).scored, "tickets_channel_accepted_values").withColumn(
         "failure_rate", F.round("failure_rate", 6))),
     _sql("SELECT CAST(as_of AS VARCHAR) AS as_of, run_id, status, scanned, failed, CASE WHEN scanned > 0 THEN "
          "round(CAST(failed AS DOUBLE) / scanned, 6) ELSE 0.0 END AS failure_rate FROM scored "
          "WHERE rule_key = 'tickets_channel_accepted_values'", whole=True))
_add("h8_health_trend",
     lambda s, f: plain(H.health_trend(H.run_health(Runs(s, f).scored)).select(
         "run_id", "run_number", "health", "health_change_7")),
     _sql("SELECT run_id, row_number() OVER (ORDER BY as_of, run_id) AS run_number, health, round(health - "
          "lag(health, 7) OVER (ORDER BY as_of, run_id), 2) AS health_change_7 FROM (SELECT run_id, as_of, "
          + _HEALTH.format(d=2) + " AS health FROM scored GROUP BY ALL) AS x", whole=True))
_add("h12_rule_catalogue_with_counts",
     lambda s, f: (lambda r: plain(r.latest.select("rule_key", "scanned", "status").join(r.rules, "rule_key").select(
         "rule_key", "rule_name", "asset", "category", "rule_type", "severity", "columns", "rulesets", "supersedes", "rationale", "business_impact",
         "scanned", "status")))(Runs(s, f)),
     _sql("SELECT rule_key, t.rule_name, asset, category, t.rule_type, severity, t.cols AS columns, t.rulesets, t.supersedes, t.rationale, "
          "t.business_impact, scanned, status FROM scored JOIN (VALUES "
          + ", ".join("(" + ", ".join(map(_text, (r.key, r.name, r.type, ",".join(r.columns), ",".join(r.rulesets), r.supersedes, r.rationale,
                                                   r.business_impact))) + ")" for r in RULES)
          + ") AS t(rule_key, rule_name, rule_type, cols, rulesets, supersedes, rationale, business_impact) USING (rule_key)"))

# ------------------------------------------------------------------ issues

# The fold as a recursion over each rule's ordered runs, actions and comments.
_LINE = ("line AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY rule_key ORDER BY moment, turn) AS seq FROM ("
         "SELECT rule_key, as_of AS moment, 0 AS turn, run_id, CASE WHEN failed > 0 THEN 'fail' ELSE 'pass' END AS kind, "
         "NULL AS wish, failed, scanned, 'engine' AS actor, NULL AS note FROM scored{actions}) AS x)")
_ACTIONS = (" UNION ALL SELECT * FROM (SELECT rule_key, as_of + INTERVAL '12' HOUR, 1, NULL, 'action', "
            "CASE WHEN run_id = 8 THEN 'open' WHEN run_id = 3 AND length(rule_key) % 3 = 0 THEN 'investigating' "
            "WHEN run_id = 5 AND length(rule_key) % 3 = 1 THEN 'accepted' "
            "WHEN run_id = 6 AND length(rule_key) % 3 = 2 THEN 'resolved' END AS wish, NULL, NULL, 'desk', NULL FROM scored) AS y "
            "WHERE wish IS NOT NULL UNION ALL SELECT rule_key, as_of + INTERVAL '13' HOUR, 1, NULL, 'comment', NULL, NULL, NULL, 'desk', "
            "failed || ' rows fail after run ' || run_id FROM scored WHERE run_id IN (2, 6, 9) AND length(rule_key) % 7 <> 0 AND "
            "length(rule_key) % 5 <> 0")
_FOLD = """folded AS (SELECT rule_key, 0 AS seq, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS BIGINT) AS affected,
  CAST(NULL AS VARCHAR) AS before, CAST(NULL AS VARCHAR) AS event FROM rule_meta
UNION ALL SELECT f.rule_key, l.seq,
  CASE WHEN l.kind = 'fail' THEN CASE WHEN f.status IS NULL OR f.status = 'resolved' THEN 'open' ELSE f.status END
       WHEN l.kind = 'pass' THEN CASE WHEN f.status IS NULL THEN NULL ELSE 'resolved' END
       WHEN l.kind = 'comment' THEN f.status
       WHEN (f.status = 'open' AND l.wish <> 'open') OR (f.status = 'investigating' AND l.wish <> 'investigating')
         OR (f.status = 'accepted' AND l.wish IN ('open', 'resolved')) OR (f.status = 'resolved' AND l.wish = 'open')
       THEN l.wish ELSE f.status END,
  CASE WHEN l.kind = 'fail' THEN l.failed ELSE f.affected END, f.status,
  CASE WHEN l.kind = 'fail' THEN CASE WHEN f.status IS NULL THEN 'created' WHEN f.status = 'resolved' THEN 'reopened'
            WHEN f.affected <> l.failed THEN 'redetected' ELSE 'seen' END
       WHEN l.kind = 'pass' THEN CASE WHEN f.status IN ('open', 'investigating', 'accepted') THEN 'auto_resolved' END
       WHEN f.status IS NULL THEN 'rejected' WHEN l.kind = 'comment' THEN 'comment' WHEN f.status = l.wish THEN 'skipped'
       WHEN f.status = 'accepted' AND l.wish = 'investigating' THEN 'rejected'
       WHEN f.status = 'resolved' AND l.wish <> 'open' THEN 'rejected' ELSE 'status_change' END
FROM folded AS f JOIN line AS l ON l.rule_key = f.rule_key AND l.seq = f.seq + 1)"""


def _issue_sql(body: str, actions: bool = False) -> str:
    return _sql(body, _LINE.replace("{actions}", _ACTIONS if actions else ""), _FOLD, whole=True)


_EVENTS = ("SELECT f.rule_key, f.event AS event_type, f.before AS from_status, f.status AS to_status, "
           "CAST(l.moment AS VARCHAR) AS \"at\", l.run_id FROM folded AS f JOIN line AS l ON l.rule_key = f.rule_key AND "
           "l.seq = f.seq WHERE f.event NOT IN ('seen', 'skipped', 'rejected')")


def _log(r: Runs, actions: bool = True) -> DataFrame:
    """The issue log of the history, written once: state, events and pages all read it."""
    return checkpoint(I.fold(r.history, r.triaged()[0] if actions else None))


def _events(actions: bool):
    def run(s, f):
        r = Runs(s, f)
        return plain(I.events(I.fold(r.history, r.triaged()[0] if actions else None)).select(
            "rule_key", "event_type", "from_status", "to_status", "at", "run_id"))
    return run


_add("i1_issue_events", _events(False), _issue_sql(_EVENTS))
_add("i6_triage_events", _events(True), _issue_sql(_EVENTS, True))
_add("i6_rejected_actions",
     lambda s, f: (lambda r: plain(I.rejected_actions(I.fold(r.history, r.triaged()[0])).drop("actor")))(Runs(s, f)),
     _issue_sql("SELECT f.rule_key, CAST(l.moment AS VARCHAR) AS \"at\", f.before AS from_status, l.wish AS to_status "
                "FROM folded AS f JOIN line AS l ON l.rule_key = f.rule_key AND l.seq = f.seq "
                "WHERE f.event = 'rejected'", True))
_add("i7_comments_and_log",
     lambda s, f: (lambda r: plain(I.events(I.fold(r.history, r.triaged()[0]))))(Runs(s, f)),
     _issue_sql("SELECT f.rule_key, CAST(f.seq AS BIGINT) AS seq, CAST(l.moment AS VARCHAR) AS \"at\", l.run_id, f.event AS event_type, "
                "f.before AS from_status, f.status AS to_status, l.actor, l.note FROM folded AS f JOIN line AS l ON l.rule_key = f.rule_key "
                "AND l.seq = f.seq WHERE f.event NOT IN ('seen', 'skipped', 'rejected')", True))
_add("i7_invalid_entries",
     lambda s, f: plain(Runs(s, f).triaged()[1].select("rule_key", "at", "kind", "problem")),
     _sql("SELECT rule_key, CAST(as_of + INTERVAL '13' HOUR AS VARCHAR) AS \"at\", 'comment' AS kind, CASE WHEN length(rule_key) % 7 = 0 THEN "
          "'no actor' ELSE 'empty comment' END AS problem FROM scored WHERE run_id IN (2, 6, 9) AND (length(rule_key) % 7 = 0 OR "
          "length(rule_key) % 5 = 0)", whole=True))
_ISLANDS = ("islands AS (SELECT *, SUM(fresh) OVER (PARTITION BY rule_key ORDER BY run_id) AS island FROM (SELECT *, CASE WHEN lag(status) OVER w "
            "IS NOT DISTINCT FROM status THEN 0 ELSE 1 END AS fresh, lead(as_of) OVER w AS after FROM scored WINDOW w AS (PARTITION BY rule_key "
            "ORDER BY run_id)) AS x), spells AS (SELECT rule_key, MIN(as_of) AS started_at, MIN(run_id) AS first_run, MAX(as_of) AS "
            "last_failed_at, arg_max(after, run_id) AS closed, COUNT(*) AS runs, MAX(failed) AS peak, MAX(run_id) AS last_run FROM islands WHERE "
            f"status = 'fail' GROUP BY rule_key, island), failing AS (SELECT *, CASE WHEN last_run < {_DAYS} THEN closed END AS ended_at FROM spells)")
_add("i1_failing_spells",
     lambda s, f: plain(I.failing_spells(Runs(s, f).history)),
     _sql("SELECT rule_key, CAST(started_at AS VARCHAR) AS started_at, first_run, CAST(last_failed_at AS VARCHAR) AS last_failed_at, "
          "CAST(ended_at AS VARCHAR) AS ended_at, runs, peak FROM failing", _ISLANDS, whole=True))

_STATE = ("state AS (SELECT f.rule_key, arg_max(f.status, f.seq) AS status, "
          "MIN(CASE WHEN f.event IN ('created') THEN l.moment END) AS first_detected_at, "
          "MAX(CASE WHEN l.kind = 'fail' THEN l.moment END) AS last_detected_at, "
          "COUNT(CASE WHEN l.kind = 'fail' THEN 1 END) AS occurrences, "
          "arg_max(l.failed, l.seq) FILTER (l.kind = 'fail') AS affected_records, "
          "arg_max(CASE WHEN f.event = 'auto_resolved' OR f.event = 'status_change' AND f.status = 'resolved' THEN l.moment END, f.seq) FILTER "
          "(f.event = 'auto_resolved' OR f.event = 'status_change' AND f.status = 'resolved') AS closed_at, "
          "arg_max(l.scanned, l.seq) FILTER (l.kind = 'fail') AS records_scanned "
          "FROM folded AS f JOIN line AS l ON l.rule_key = f.rule_key AND l.seq = f.seq GROUP BY f.rule_key "
          "HAVING arg_max(f.status, f.seq) IS NOT NULL), "
          "numbered AS (SELECT *, printf('DQ-%04d', row_number() OVER (ORDER BY first_detected_at, rule_key)) AS "
          "issue_key FROM state)")
_add("i2_issue_state",
     lambda s, f: plain(I.current(I.fold(Runs(s, f).history)).select(
         "issue_key", "rule_key", "status", "first_detected_at", "last_detected_at", "occurrences",
         "affected_records", "resolved_at")),
     _sql("SELECT issue_key, rule_key, status, CAST(first_detected_at AS VARCHAR) AS first_detected_at, "
          "CAST(last_detected_at AS VARCHAR) AS last_detected_at, occurrences, affected_records, "
          "CASE WHEN status = 'resolved' THEN CAST(closed_at AS VARCHAR) END AS resolved_at FROM numbered",
          _LINE.replace("{actions}", ""), _FOLD, _STATE, whole=True))

# ------------------------------------------------------------------ impact and priority

_BLAST = ("seeds AS (SELECT rule_key AS seed, asset, m.tracked FROM scored JOIN rule_meta AS m USING (rule_key, asset) "
          "WHERE status = 'fail' AND run_id = " + str(_DAYS) + "), "
          "walk AS (SELECT s.seed, e.down AS asset, 1 AS depth, [s.asset, e.down] AS path FROM seeds AS s JOIN edges AS e "
          "ON e.up = s.asset WHERE e.refs IS NULL OR len(s.tracked) = 0 OR list_has_any(e.refs, s.tracked) "
          "UNION ALL SELECT w.seed, e.down, w.depth + 1, list_append(w.path, e.down) FROM walk AS w JOIN edges AS e "
          "ON e.up = w.asset), hit AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed, "
          "asset ORDER BY depth, path) AS rn FROM walk) AS x JOIN nodes USING (asset) WHERE rn = 1)")
_SUMMARY = ("summed AS MATERIALIZED (SELECT s.seed, s.asset, COUNT(h.asset) AS downstream_count, "
            "COUNT(CASE WHEN h.criticality IN ('high', 'critical') THEN 1 END) AS critical_count, "
            "COUNT(CASE WHEN h.layer = 'mart' THEN 1 END) AS mart_count, "
            "COUNT(CASE WHEN h.asset_type = 'exposure' THEN 1 END) AS exposure_count, "
            "COALESCE(bool_or(h.financial), FALSE) AS financial, COALESCE(bool_or(h.facing), FALSE) AS customer_facing, "
            "COALESCE(bool_or(h.executive), FALSE) AS executive, MIN(CASE WHEN h.executive THEN h.depth END) AS hops, "
            "COALESCE(MAX(h.depth), 0) AS max_depth, list(DISTINCT h.owner ORDER BY h.owner) AS owners "
            "FROM seeds AS s LEFT JOIN hit AS h ON h.seed = s.seed GROUP BY s.seed, s.asset)")


def _impacted(s, f):
    _, impacted, _ = Runs(s, f).impact()
    return plain(impacted.withColumn("path", F.array_join("path", ">")))


_add("b1_blast_radius", _impacted,
     _sql("SELECT seed, asset, CAST(depth AS BIGINT) AS depth, array_to_string(path, '>') AS path, asset_type, layer, "
          "criticality, owner, criticality IN ('high', 'critical') AS is_critical, financial AS is_financial, "
          "facing AS is_customer_facing, executive AS is_executive FROM hit", _BLAST))
_add("b2_impact_summary",
     lambda s, f: plain(Runs(s, f).impact()[2].select(
         "seed", "asset", "downstream_count", "critical_count", "mart_count", "exposure_count", "financial",
         "customer_facing", "executive", "hops_to_executive", "max_depth")),
     _sql("SELECT seed, asset, downstream_count, critical_count, mart_count, exposure_count, financial, "
          "customer_facing, executive, CAST(hops AS BIGINT) AS hops_to_executive, CAST(max_depth AS BIGINT) AS max_depth "
          "FROM summed", _BLAST, _SUMMARY))
_TEAMS = ("array_to_string(list_concat([n.owner], list_filter(list_filter(x.owners, lambda o: o IS NOT NULL), "
          "lambda o: o <> n.owner)), ',')")
_add("b3_teams_affected",
     lambda s, f: plain(Runs(s, f).impact()[2].select("seed", "teams")),
     _sql(f"SELECT x.seed, {_TEAMS} AS teams FROM summed AS x JOIN nodes AS n ON n.asset = x.asset", _BLAST, _SUMMARY))


def _terms(s, f):
    r = Runs(s, f)
    defects, impacted, _ = r.impact()
    return plain(B.touched_terms(defects, impacted, *C.term_frames(s)))


_add("b4_glossary_terms", _terms, _sql(
    "SELECT s.seed, COALESCE(array_to_string(list(DISTINCT t.term ORDER BY t.term), ','), '') AS terms FROM seeds AS s "
    "LEFT JOIN (SELECT s.seed, l.term FROM seeds AS s JOIN links AS l ON l.asset = s.asset AND (l.col IS NULL OR "
    "len(s.tracked) = 0 OR list_contains(s.tracked, l.col)) UNION SELECT h.seed, l.term FROM hit AS h JOIN links AS l "
    "ON l.asset = h.asset) AS t ON t.seed = s.seed GROUP BY s.seed", _BLAST,
    _values("links", "term, asset, col", [
        f"({_text(t[1])}, {_text(a)}, {_text(c)})" for k, a, c in C.glossary()[1]
        for t in C.glossary()[0] if t[0] == k and t[4] != "deprecated"])))


def _related(s, f):
    r = Runs(s, f)
    return plain(B.related_rules(r.defects, r.rules))


_add("b5_related_rules", _related, _sql(
    "SELECT s.seed, array_to_string(list(m.rule_key ORDER BY m.rule_key), ',') AS rules FROM seeds AS s JOIN rule_meta "
    "AS m ON m.asset = s.asset GROUP BY s.seed", _BLAST))


def _sources(s, f):
    r = Runs(s, f)
    return plain(B.source_systems(C.edge_frame(s), r.nodes, r.defects))


_add("b5_upstream_systems", _sources, _sql(
    "SELECT seed, COALESCE(array_to_string(list(DISTINCT n.system ORDER BY n.system) FILTER (n.system IS NOT NULL), ','),"
    " '') AS systems FROM up JOIN nodes AS n USING (asset) GROUP BY seed", _BLAST,
    "up AS (SELECT seed, asset FROM seeds UNION SELECT u.seed, e.up FROM up AS u JOIN edges AS e ON e.down = u.asset)"))


def _owners(s, f):
    r = Runs(s, f)
    defects, impacted, _ = r.impact()
    return plain(B.owners_affected(impacted, defects, r.nodes))


_add("b6_owners_with_assets", _owners, _sql(
    "SELECT seed, n.owner, array_to_string(list(DISTINCT asset ORDER BY asset), ',') AS owned_assets FROM ("
    "SELECT seed, asset FROM hit UNION ALL SELECT seed, asset FROM seeds) AS x JOIN nodes AS n USING (asset) "
    "GROUP BY seed, n.owner", _BLAST))
_add("b7_row_level_defects",
     lambda s, f: (lambda r: plain(r.impact()[2].join(
         r.rules.filter("category = 'duplicate_identifier'").select(F.col("rule_key").alias("seed")), "seed")
         .select("seed", "downstream_count")))(Runs(s, f)),
     _sql("SELECT x.seed, x.downstream_count FROM summed AS x JOIN rule_meta AS m ON m.rule_key = x.seed "
          "WHERE m.category = 'duplicate_identifier'", _BLAST, _SUMMARY))


def _critical(s, f):
    r = Runs(s, f)
    seeds = r.latest.filter("status = 'fail'").select(F.col("rule_key").alias("seed"), "asset", "columns")
    return plain(B.critical_elements(seeds, r.columns).select(
        "seed", F.transform("critical_columns", lambda c: c["category"]).alias("categories")))


_add("b8_critical_elements", _critical, _sql(
    "SELECT rule_key AS seed, array_to_string(m.cde, ',') AS categories FROM scored JOIN rule_meta AS m "
    "USING (rule_key) WHERE status = 'fail'"))

_POINTS = {
    "severity": "CASE sc.severity WHEN 'critical' THEN 20 WHEN 'high' THEN 14 WHEN 'medium' THEN 8 ELSE 3 END",
    "affected_volume": "8 * LEAST(1.0, log10(sc.failed + 1) / log10(10001))",
    "affected_rate": "7 * LEAST(1.0, CAST(sc.failed AS DOUBLE) / sc.scanned / 0.05)",
    "dataset_criticality": "CASE n.criticality WHEN 'critical' THEN 10 WHEN 'high' THEN 7 WHEN 'medium' THEN 4 ELSE 1 END",
    "field_criticality": "IF(len(m.cde) > 0, 6, 0) + IF(list_has_any(m.cde, ['financial', 'identifier', "
                         "'customer_identifier']), 4, 0)",
    "downstream_dependencies": "10 * LEAST(1.0, x.downstream_count / 25.0)",
    "critical_downstream": "LEAST(10, 0.5 * x.critical_count)",
    "financial_reporting": "IF(x.financial, 8, 0)",
    "executive_or_customer_facing":
        "CASE WHEN x.executive THEN GREATEST(5, 9 - GREATEST(0, x.hops - 2)) WHEN x.customer_facing THEN 7 ELSE 0 END",
    "multi_team": "LEAST(8, 1.6 * GREATEST(0, len(list_filter(list_filter(x.owners, lambda o: o IS NOT NULL), "
                  "lambda o: o <> n.owner))))",
}
_SCORES = ("pts AS MATERIALIZED (SELECT sc.rule_key AS seed, sc.failed, x.asset, "
           + ", ".join(f"round(CAST({e} AS DOUBLE), 1) AS {k}" for k, e in _POINTS.items())
           + " FROM scored AS sc JOIN rule_meta AS m USING (rule_key) JOIN summed AS x ON x.seed = sc.rule_key "
             "JOIN nodes AS n ON n.asset = x.asset WHERE sc.run_id = " + str(_DAYS) + "), "
           "prio AS MATERIALIZED (SELECT *, round(LEAST(100, " + " + ".join(_POINTS) + "), 1) AS priority_score, round("
           + " + ".join(P.BLAST) + ", 1) AS blast, round(" + " + ".join(P.DEFECT) + ", 1) AS defect FROM pts)")
_BAND = ("CASE WHEN priority_score >= 80 THEN 'P1' WHEN priority_score >= 65 THEN 'P2' WHEN priority_score >= 45 "
         "THEN 'P3' ELSE 'P4' END")


def _priority_sql(body: str) -> str:
    return _sql(body, _BLAST, _SUMMARY, _SCORES)


_add("r11_priority_scores",
     lambda s, f: plain(Runs(s, f).priorities().select(
         "seed", *[F.col(f"pts_{k}").alias(k) for k in _POINTS], "priority_score", "priority_band")),
     _priority_sql("SELECT seed, " + ", ".join(_POINTS) + f", priority_score, {_BAND} AS priority_band FROM prio"))
_add("r12_impact_scores",
     lambda s, f: plain(Runs(s, f).priorities().select("seed", "blast_radius_points", "impact_score", "impact_level")),
     _priority_sql(
         "SELECT seed, blast AS blast_radius_points, round(blast * 100 / 45, 1) AS impact_score, CASE WHEN "
         "round(blast * 100 / 45, 1) >= 75 THEN 'severe' WHEN round(blast * 100 / 45, 1) >= 50 THEN 'high' WHEN "
         "round(blast * 100 / 45, 1) >= 25 THEN 'moderate' WHEN round(blast * 100 / 45, 1) >= 1 THEN 'low' ELSE 'none' "
         "END AS impact_level FROM prio"))
_add("r13_breakdown",
     lambda s, f: plain(P.breakdown(Runs(s, f).priorities())),
     _priority_sql("\nUNION ALL ".join(
         f"SELECT seed, '{k}' AS factor, '{'defect' if k in P.DEFECT else 'blast_radius'}' AS factor_group, {k} AS "
         f"points, {m} AS max_points FROM prio" for k, m in P.MAX_POINTS.items())))
_add("r13_group_points",
     lambda s, f: plain(Runs(s, f).priorities().select("seed", "defect_points", "blast_radius_points")),
     _priority_sql("SELECT seed, defect AS defect_points, blast AS blast_radius_points FROM prio"))
_REASONS = {
    "severity": "'severity ' || sc.severity",
    "affected_volume": "sc.failed || ' failing rows'",
    "affected_rate": "sc.failed || ' of ' || sc.scanned || ' scanned rows'",
    "dataset_criticality": "'dataset is ' || n.criticality",
    "field_criticality": "IF(len(c.names) > 0, 'critical columns: ' || array_to_string(c.names, ', '), 'no critical column')",
    "downstream_dependencies": "x.downstream_count || ' dependent assets'",
    "critical_downstream": "x.critical_count || ' critical consumers'",
    "financial_reporting": "IF(x.financial, 'reaches financial reporting', 'no financial reporting')",
    "executive_or_customer_facing": "CASE WHEN x.executive THEN 'executive reporting in ' || x.hops || ' hops' WHEN x.customer_facing "
                                    "THEN 'customer-facing output' ELSE 'no exposed output' END",
    "multi_team": "len(t.teams) || ' teams: ' || array_to_string(t.teams, ', ')",
}


def _reasons_sql() -> str:
    critical = {(r[0], r[1]) for r in C.columns() if r[3]}
    names = _values("rule_cde", "rule_key, names", [
        f"({_text(r.key)}, {_list([c for c in r.columns if (r.asset, c) in critical])})" for r in RULES])
    teams = ("rule_teams AS (SELECT x.seed, list_concat(list_filter([n.owner], lambda o: o IS NOT NULL), list_filter(x.owners, lambda o: "
             "o IS NOT NULL AND o IS DISTINCT FROM n.owner)) AS teams FROM summed AS x JOIN nodes AS n ON n.asset = x.asset)")
    said = ", ".join(f"{{'minus': -p.{k}, 'i': {i}, 'reason': {_REASONS[k]}}}" for i, k in enumerate(P.MAX_POINTS))
    return _sql(
        "SELECT seed, array_to_string(list_transform(list_filter(list_sort(r)[1:3], lambda f: f.minus < 0), lambda f: f.reason), ' | ') "
        f"AS reasons FROM (SELECT p.seed, [{said}] AS r FROM prio AS p JOIN scored AS sc ON sc.rule_key = p.seed AND sc.run_id = {_DAYS} "
        "JOIN summed AS x ON x.seed = p.seed JOIN nodes AS n ON n.asset = x.asset JOIN rule_cde AS c ON c.rule_key = p.seed JOIN "
        "rule_teams AS t ON t.seed = p.seed) AS y", _BLAST, _SUMMARY, _SCORES, names, teams)


_add("r13_top_reasons",
     lambda s, f: (lambda p: p.select("seed", F.array_join(P.top_reasons(3), " | ").alias("reasons")))(
         Runs(s, f).priorities()), _reasons_sql())


def _what_if(s, f):
    """Priority if every row an asset holds in the latest run failed its first critical column."""
    r = Runs(s, f)
    defects, _, summary = r.impact()
    critical = B.critical_elements(defects.select("seed", "asset").join(
        r.rules.select(F.col("rule_key").alias("seed"), "columns"), "seed"), r.columns)
    worst = r.latest.withColumn("failed", F.col("scanned"))
    return plain(P.score(P.signals(worst, r.rules, summary, critical)).select("seed", "priority_score"))


_add("r14_what_if_all_rows_fail", _what_if, _sql(
    "SELECT seed, priority_score FROM prio", _BLAST, _SUMMARY,
    _SCORES.replace("FROM scored AS sc", "FROM (SELECT * REPLACE (scanned AS failed) FROM scored) AS sc")))
_add("r16_volume_versus_priority",
     lambda s, f: I.rank_correlation(Runs(s, f).priorities(), "failed", "priority_score").select(
         F.round("rank_correlation", 6).alias("rank_correlation")),
     _priority_sql(
         "SELECT round(corr(a, b), 6) AS rank_correlation FROM (SELECT rank() OVER (ORDER BY failed) + (COUNT(*) OVER "
         "(PARTITION BY failed) - 1) / 2.0 AS a, rank() OVER (ORDER BY priority_score) + (COUNT(*) OVER (PARTITION BY "
         "priority_score) - 1) / 2.0 AS b FROM prio) AS x"))

_ISSUES = ("issue AS MATERIALIZED (SELECT n.*, m.asset, m.category, m.severity, d.owner, d.layer, d.criticality AS business_criticality, "
           "p.priority_score, " + _BAND + " AS priority_band, round(p.blast * 100 / 45, 1) AS impact_score, x.downstream_count, "
           "COALESCE((SELECT list(h.asset ORDER BY h.depth, h.asset) FROM hit AS h WHERE h.seed = n.rule_key AND h.asset_type = 'exposure'), []) "
           "AS exposures FROM numbered AS n JOIN rule_meta AS m USING (rule_key) JOIN nodes AS d ON d.asset = m.asset LEFT JOIN prio AS p ON "
           "p.seed = n.rule_key LEFT JOIN summed AS x ON x.seed = n.rule_key)")


#: Issues are about the last failing result of their rules.
_LAST_FAIL = ("lastfail AS MATERIALIZED (SELECT * FROM scored WHERE status = 'fail' QUALIFY row_number() OVER (PARTITION BY rule_key ORDER BY "
              "run_id DESC) = 1)")
_LATEST_SEEDS = f"FROM scored JOIN rule_meta AS m USING (rule_key, asset) WHERE status = 'fail' AND run_id = {_DAYS}"
_LATEST_SCORES = ("FROM scored AS sc JOIN", f" WHERE sc.run_id = {_DAYS})")
assert _LATEST_SEEDS in _BLAST and all(x in _SCORES for x in _LATEST_SCORES)
_ISSUE_BLAST = _LAST_FAIL + ", " + _BLAST.replace(_LATEST_SEEDS, "FROM lastfail JOIN rule_meta AS m USING (rule_key, asset)")
_ISSUE_SCORES = _SCORES.replace(_LATEST_SCORES[0], "FROM lastfail AS sc JOIN").replace(_LATEST_SCORES[1], ")")


def _issues_sql(body: str, *extra: str, actions: bool = False) -> str:
    return _sql(body, _LINE.replace("{actions}", _ACTIONS if actions else ""), _FOLD, _STATE, _ISSUE_BLAST, _SUMMARY, _ISSUE_SCORES, _ISSUES, *extra, whole=True)


_TITLES = _values("titles", "rule_key, rule_name, rule_type, columns, business_impact", [
    f"({_text(r.key)}, {_text(r.name)}, {_text(r.type)}, {_text(','.join(r.columns))}, {_text(r.business_impact)})" for r in RULES])
_TITLE = "t.rule_name || ' - ' || format('{:,}', i.affected_records) || ' failing rows in ' || i.asset AS title"
_RATE = "round(CAST(i.affected_records AS DOUBLE) / i.records_scanned, 6) AS affected_rate"


def _critical_names() -> str:
    critical = {(r[0], r[1]) for r in C.columns() if r[3]}
    return _values("rule_cde", "rule_key, critical_columns", [
        f"({_text(r.key)}, {_text(','.join(c for c in r.columns if (r.asset, c) in critical))})" for r in RULES])


_QUEUE = ("issue_key", "rule_key", "title", "status", "severity", "business_criticality", "priority_band", "priority_score", "affected_records",
          "affected_rate", "records_scanned", "asset", "layer", "owner", "category", "critical_columns", "downstream_count", "impact_score",
          "exposures", "first_detected_at", "last_detected_at", "occurrences")


def _queue(s, f, **filters):
    r = Runs(s, f)
    return plain(I.queue(r.issues(_log(r)), **filters).select(*_QUEUE))


def _queue_sql(where: str) -> str:
    special = {"title": _TITLE, "affected_rate": _RATE, "critical_columns": "c.critical_columns", "exposures": "array_to_string(i.exposures, ',') AS exposures",
               "first_detected_at": "CAST(i.first_detected_at AS VARCHAR) AS first_detected_at",
               "last_detected_at": "CAST(i.last_detected_at AS VARCHAR) AS last_detected_at"}
    return _issues_sql("SELECT " + ", ".join(special.get(c, f"i.{c}") for c in _QUEUE) + " FROM issue AS i JOIN titles AS t USING (rule_key) JOIN "
                       "rule_cde AS c USING (rule_key)" + where, _TITLES, _critical_names(), actions=True)


_add("i8_issue_queue", _queue, _queue_sql(""))
_add("i8_issue_queue_filtered",
     lambda s, f: _queue(s, f, statuses=["open", "investigating"], bands=["P2", "P3"], owners=["Commerce", "Payments", "Customer Experience"],
                         assets=["stg_orders", "stg_payments", "stg_tickets"]),
     _queue_sql(" WHERE i.owner IN ('Commerce', 'Payments', 'Customer Experience') AND i.status IN ('open', 'investigating') AND "
                "i.priority_band IN ('P2', 'P3') AND i.asset IN ('stg_orders', 'stg_payments', 'stg_tickets')"))


def _described(s, f):
    return plain(Runs(s, f).issues().select("issue_key", "title", "affected_rate", "description", "business_impact"))


_add("i4_issue_titles", _described, _issues_sql(
    f"SELECT i.issue_key, {_TITLE}, {_RATE}, format('{{:,}}', i.affected_records) || ' of ' || format('{{:,}}', i.records_scanned) || "
    "' rows fail. ' || i.downstream_count || ' assets depend on them, reaching ' || CASE WHEN len(i.exposures) > 0 THEN "
    "array_to_string(i.exposures, ', ') ELSE 'no business output' END || '.' AS description, t.business_impact FROM issue AS i JOIN titles AS t "
    "USING (rule_key)", _TITLES))

def _results(s, f):
    """Results of the latest run with ownership and the issue each failure belongs to."""
    r = Runs(s, f)
    issues = checkpoint(r.issues())
    about = issues.select("rule_key", "critical_columns", "downstream_count", "priority_band")
    table = H.results_table(r.latest, r.nodes, issues).join(about, "rule_key", "left")
    return plain(table.select(
        "rule_key", "rule_name", "asset", "layer", "owner", "category", "severity", "status", "scanned", "failed",
        F.round("failure_rate", 6).alias("failure_rate"), "rule_score", "issue_key", "critical_columns", "downstream_count", "priority_band"))


_add("h5_results_table", _results, _issues_sql(
    "SELECT s.rule_key, t.rule_name, s.asset, n.layer, n.owner, s.category, s.severity, s.status, s.scanned, s.failed, CASE WHEN s.scanned > 0 THEN "
    "round(CAST(s.failed AS DOUBLE) / s.scanned, 6) ELSE 0.0 END AS failure_rate, CAST(s.score AS DOUBLE) AS rule_score, CASE WHEN i.last_detected_at = "
    "s.as_of THEN i.issue_key END AS issue_key, CASE WHEN i.issue_key IS NOT NULL THEN c.critical_columns END AS critical_columns, i.downstream_count, "
    f"i.priority_band FROM scored AS s JOIN nodes AS n USING (asset) JOIN titles AS t USING (rule_key) JOIN rule_cde AS c USING (rule_key) LEFT JOIN issue "
    f"AS i ON i.rule_key = s.rule_key WHERE s.run_id = {_DAYS}", _TITLES, _critical_names()))


def _issues_above(s, f):
    r = Runs(s, f)
    return plain(B.issues_upstream(C.edge_frame(s), r.nodes, r.issues()))


_add("b6_open_issues_upstream", _issues_above, _issues_sql(
    "SELECT u.start AS asset, i.rule_key, i.issue_key, i.asset AS source_asset, MIN(u.depth) AS depth, i.priority_band FROM above AS u JOIN issue AS i ON "
    "i.asset = u.asset WHERE i.status <> 'resolved' GROUP BY ALL",
    "above AS (SELECT down AS start, up AS asset, 1 AS depth FROM edges UNION ALL SELECT a.start, e.up, a.depth + 1 FROM above AS a JOIN edges AS e ON "
    "e.down = a.asset)"))

#: Entries of one page of an issue's lists.
_PAGE = 6


def _lines(name: str, *fields: str):
    """Entries of a list as text lines."""
    def line(x):
        return F.concat_ws("/", *[F.coalesce(x[c].cast("string"), F.lit("-")) for c in fields])
    return F.array_join(F.transform(name, line), " | ").alias(name)


def _detail_pages(s, f):
    r = Runs(s, f)
    log, issues = _log(r), None
    issues = checkpoint(r.issues(log))
    _, impacted, _ = r.issue_impact()
    pages = I.details(issues, log, r.history, impacted, I.contacts(impacted, issues, r.nodes), size=_PAGE)
    return plain(pages.select(
        "issue_key", "rule_key", "rule_name", "rule_type", "columns", "status", "asset", "owner", "priority_score", "resolved_at",
        "allowed_transitions", _lines("impacts", "asset", "layer", "owner", "depth", "is_critical"),
        _lines("events", "event_type", "from_status", "to_status", "actor", "note", "run_id"), _lines("comments", "at", "actor", "note"),
        _lines("history", "as_of", "status", "failed", "scanned"), _lines("contacts", "owner", "owns_broken_asset"),
        "n_impacts", "n_events", "n_comments", "n_history", "n_contacts"))


def _page_sql(name: str, source: str, order: str, *fields: str) -> str:
    line = " || '/' || ".join(f"COALESCE(CAST({c} AS VARCHAR), '-')" for c in fields)
    return (f"{name} AS (SELECT rule_key, string_agg(line, ' | ' ORDER BY n) FILTER (n <= {_PAGE}) AS {name}, COUNT(*) AS n_{name} FROM (SELECT "
            f"rule_key, {line} AS line, row_number() OVER (PARTITION BY rule_key ORDER BY {order}) AS n FROM {source}) AS x GROUP BY rule_key)")


_LOGGED = ("logged AS (SELECT f.rule_key, f.seq, f.event AS event_type, f.before AS from_status, f.status AS to_status, l.actor, l.note, l.run_id, "
           "l.moment FROM folded AS f JOIN line AS l ON l.rule_key = f.rule_key AND l.seq = f.seq WHERE f.event NOT IN ('seen', 'skipped', "
           "'rejected'))")
_CONTACTS = ("people AS (SELECT i.rule_key, h.owner, h.owner = i.owner AS owns FROM hit AS h JOIN issue AS i ON i.rule_key = h.seed WHERE h.owner IS "
             "NOT NULL UNION SELECT rule_key, owner, TRUE FROM issue)")
_MOVES = "CASE i.status " + " ".join(f"WHEN '{k}' THEN '{','.join(sorted(v))}'" for k, v in I.TRANSITIONS.items()) + " END AS allowed_transitions"
_add("i9_issue_details", _detail_pages, _issues_sql(
    f"SELECT i.issue_key, i.rule_key, t.rule_name, t.rule_type, t.columns, i.status, i.asset, i.owner, i.priority_score, CASE WHEN i.status = 'resolved' "
    f"THEN CAST(i.closed_at AS VARCHAR) END AS resolved_at, {_MOVES}, " + ", ".join(
        f"COALESCE({n}, '') AS {n}, COALESCE(n_{n}, 0) AS n_{n}" for n in ("impacts", "events", "comments", "history", "contacts"))
    + " FROM issue AS i JOIN titles AS t USING (rule_key)" + "".join(
        f" LEFT JOIN {n} USING (rule_key)" for n in ("impacts", "events", "comments", "history", "contacts")),
    _TITLES, _LOGGED, _CONTACTS,
    _page_sql("impacts", "(SELECT seed AS rule_key, *, criticality IN ('high', 'critical') AS is_critical FROM hit)", "depth, asset",
              "asset", "layer", "owner", "depth", "is_critical"),
    _page_sql("events", "logged", "seq", "event_type", "from_status", "to_status", "actor", "note", "run_id"),
    _page_sql("comments", "(SELECT * FROM logged WHERE event_type = 'comment')", "seq DESC", "moment", "actor", "note"),
    _page_sql("history", "scored", "run_id DESC", "as_of", "status", "failed", "scanned"),
    _page_sql("contacts", "people", "owns DESC, owner", "owner", "owns"), actions=True))


def _inherited(s, f):
    r = Runs(s, f)
    return plain(B.inherited_issues(r.issue_impact()[1], r.issues()))


_add("i10_inherited_issues", _inherited, _issues_sql(
    "SELECT h.asset, i.rule_key, i.asset AS source_asset, CAST(h.depth AS BIGINT) AS depth FROM hit AS h JOIN issue AS i "
    "ON i.rule_key = h.seed WHERE i.status <> 'resolved'"))
_add("i5_impacted_assets_per_issue",
     lambda s, f: (lambda r: plain(r.issue_impact()[1].select(
         F.col("seed").alias("rule_key"), "asset", "depth", "is_critical").join(
         I.current(I.fold(r.history)).select("rule_key", "issue_key"), "rule_key")))(Runs(s, f)),
     _issues_sql("SELECT i.rule_key, i.issue_key, h.asset, CAST(h.depth AS BIGINT) AS depth, h.criticality IN ('high', "
                 "'critical') AS is_critical FROM hit AS h JOIN issue AS i ON i.rule_key = h.seed"))


def _contacts(s, f):
    r = Runs(s, f)
    found = I.current(I.fold(r.history)).join(r.rules.select("rule_key", "asset"), "rule_key")
    return I.contacts(r.issue_impact()[1], found, r.nodes)


_add("u1_issue_contacts", _contacts, _issues_sql(
    "SELECT i.rule_key, h.owner, h.owner = i.owner AS owns_broken_asset FROM hit AS h JOIN issue AS i ON i.rule_key = "
    "h.seed WHERE h.owner IS NOT NULL UNION SELECT rule_key, owner, TRUE FROM issue"))
_add("i11_issue_distribution",
     lambda s, f: I.distribution(Runs(s, f).issues(), "owner", "priority_band"),
     _issues_sql("SELECT owner, priority_band, COUNT(*) AS issues FROM issue WHERE status <> 'resolved' GROUP BY ALL"))
_add("i11_category_by_severity",
     lambda s, f: I.distribution(Runs(s, f).issues(), "category", "severity"),
     _issues_sql("SELECT category, severity, COUNT(*) AS issues FROM issue WHERE status <> 'resolved' GROUP BY ALL"))


def _headline(s, f):
    r = Runs(s, f)
    return plain(H.headline(r.nodes, r.columns, r.latest, r.issues(), H.health_trend(H.run_health(r.scored)), r.rules, C.term_frames(s)[0]))


_add("h9_headline_numbers", _headline, _issues_sql(
    "SELECT (SELECT COUNT(*) FROM nodes WHERE asset_type IN ('source', 'model')) AS datasets, (SELECT COUNT(*) FROM "
    f"nodes WHERE asset_type = 'exposure') AS exposures, (SELECT COUNT(DISTINCT owner) FROM nodes) AS teams, (SELECT COUNT(*) FROM rule_meta) "
    f"AS rules_defined, {len(C.glossary()[0])} AS glossary_terms, {len(C.columns())} AS columns, {sum(r[3] for r in C.columns())} AS "
    f"critical_fields, (SELECT COUNT(*) FROM scored WHERE run_id = {_DAYS}) AS rules_executed, (SELECT COUNT(*) FROM scored "
    f"WHERE run_id = {_DAYS} AND status = 'fail') AS rules_failing, (SELECT COUNT(*) FROM issue WHERE status IN ('open', "
    "'investigating')) AS open_issues, (SELECT COUNT(*) FROM issue WHERE status = 'accepted') AS accepted_issues, "
    "(SELECT COUNT(*) FROM issue WHERE status IN ('open', 'investigating') AND priority_band = 'P1') AS p1_issues, "
    "(SELECT COUNT(*) FROM issue WHERE status IN ('open', 'investigating') AND severity = 'critical') AS critical_issues, "
    f"t.health, round(t.health - b.health, 2) AS health_change_7, b.health AS health_7_runs_ago FROM (SELECT {_HEALTH.format(d=2)} AS health FROM scored "
    f"WHERE run_id = {_DAYS}) AS t, (SELECT {_HEALTH.format(d=2)} AS health FROM scored WHERE run_id = {_DAYS - 7}) AS b"))


def _failing_assets(s, f):
    r = Runs(s, f)
    return plain(H.failing_assets(r.latest, r.nodes, r.issues(), I.failing_spells(r.history)).select(
        "asset", "layer", "owner", "failing_rules", "open_issues", "failing_records", "health", "failing_since", "without_a_break_since", "failing_runs"))


_add("h10_failing_assets", _failing_assets, _issues_sql(
    "SELECT s.asset, n.layer, n.owner, COUNT(*) AS failing_rules, COUNT(CASE WHEN i.status <> 'resolved' THEN 1 END) AS open_issues, "
    "CAST(SUM(s.failed) AS BIGINT) AS failing_records, "
    "round(100 * SUM(s.score * s.weight) / SUM(s.weight), 1) AS health, CAST(MIN(CASE WHEN i.status <> 'resolved' THEN "
    "i.first_detected_at END) AS VARCHAR) AS failing_since, CAST(MIN(x.started_at) AS VARCHAR) AS without_a_break_since, MAX(x.runs) AS "
    "failing_runs FROM scored AS s JOIN nodes AS n USING (asset) LEFT JOIN issue AS i ON i.rule_key = s.rule_key LEFT JOIN failing AS x ON "
    f"x.rule_key = s.rule_key AND x.ended_at IS NULL WHERE s.run_id = {_DAYS} AND s.status = 'fail' GROUP BY s.asset, n.layer, n.owner", _ISLANDS))
