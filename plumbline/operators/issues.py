"""Issue lifecycle: fold run outcomes and triage actions into issue state, events and detail documents.

At most one issue exists per rule. A failing run opens it (or reopens a resolved one), a passing run resolves
it, and manual actions move it along allowed transitions. Windows cut the history of a rule into islands: runs of equal
outcome without an action in between. Only islands and actions are folded in order; what happens inside an island
follows from the state at its start and the run before, so a rule that fails for years costs one step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Allowed manual transitions.
TRANSITIONS = {
    "open": ("investigating", "accepted", "resolved"),
    "investigating": ("open", "accepted", "resolved"),
    "accepted": ("open", "resolved"),
    "resolved": ("open",),
}
UNRESOLVED = ("open", "investigating", "accepted")
STATUSES = tuple(TRANSITIONS)

#: Longest actor and note that are kept.
ACTOR_LENGTH, NOTE_LENGTH = 80, 2000

_MOVE = "struct<step:bigint,before:string,event:string,after:string>"
_STATE = f"struct<status:string,moves:array<{_MOVE}>>"
_ORDER = ("at", "turn", "run_id", "kind", "wish", "actor", "note")


def allowed_moves(status: Column) -> Column:
    """The manual moves open to an issue, in text order."""
    out = F.array().cast("array<string>")
    for source, targets in TRANSITIONS.items():
        out = F.when(status == source, F.array(*[F.lit(t) for t in sorted(targets)])).otherwise(out)
    return out


def triage(actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid, invalid)`` of ``actions(rule_key, at, kind, status, actor, note)``.

    Actor and note lose outer blanks and what exceeds their length. An action needs an actor and a known status, a comment an
    actor and a note; invalid ones get a ``problem``.
    """
    def text(column: str, length: int) -> Column:
        return F.nullif(F.substring(F.trim(F.coalesce(column, F.lit(""))), 1, length), F.lit(""))

    clean = actions.withColumns({"actor": text("actor", ACTOR_LENGTH), "note": text("note", NOTE_LENGTH)})
    known = F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))
    problem = F.when(F.col("actor").isNull(), "no actor").when((F.col("kind") == "comment") & F.col("note").isNull(), "empty comment").when(
        (F.col("kind") == "action") & ~known, "unknown status").when(~F.col("kind").isin("action", "comment"), "unknown kind")
    judged = clean.withColumn("problem", problem)
    return judged.filter("problem IS NULL").drop("problem"), judged.filter("problem IS NOT NULL")


def _step(state: Column, item: Column) -> Column:
    """The state after one island or action."""
    status, kind, wish = state["status"], item["kind"], item["wish"]
    tracked = F.coalesce(status.isin(*UNRESOLVED), F.lit(False))
    moved = F.coalesce(F.array_contains(allowed_moves(status), wish), F.lit(False))
    event = (
        F.when((kind == "fail") & status.isNull(), "created").when((kind == "fail") & (status == "resolved"), "reopened")
        .when(kind == "fail", "seen").when((kind == "pass") & tracked, "auto_resolved")
        .when(kind.isin("action", "comment") & status.isNull(), "rejected").when(kind == "comment", "comment")
        .when((kind == "action") & (wish == status), "skipped").when((kind == "action") & moved, "status_change")
        .when(kind == "action", "rejected"))
    after = F.when(event.isin("created", "reopened"), "open").when(event == "auto_resolved", "resolved").when(
        event == "status_change", wish).otherwise(status)
    move = F.struct(item["step"].alias("step"), status.alias("before"), event.alias("event"), after.alias("after")).cast(_MOVE)
    return F.struct(after.alias("status"), F.concat(state["moves"], F.array(move)).alias("moves")).cast(_STATE)


def fold(outcomes: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """The log, one row per run or action that touched an issue.

    (rule_key, seq, at, run_id, event_type, from_status, to_status, actor, note, affected, scanned, status), ``status`` being
    that of the issue afterwards. ``outcomes`` is (rule_key, run_id, as_of, status, scanned, failed); errors say nothing and are
    dropped. ``actions`` is (rule_key, at, kind, status, actor, note), kind being 'action' or 'comment'. Event types besides
    those of ``events``: seen (a run as before), skipped (a move to the present status), rejected.
    """
    none = F.lit(None)
    line = outcomes.filter("status <> 'error'").select(
        "rule_key", F.col("as_of").alias("at"), F.lit(0).alias("turn"), F.col("run_id").cast("bigint").alias("run_id"),
        F.col("status").alias("kind"), none.cast("string").alias("wish"), F.lit("engine").alias("actor"),
        none.cast("string").alias("note"), F.col("failed").cast("bigint").alias("failed"), F.col("scanned").cast("bigint").alias("scanned"))
    if actions is not None:
        line = line.unionByName(actions.select(
            "rule_key", "at", F.lit(1).alias("turn"), none.cast("bigint").alias("run_id"), "kind", F.col("status").alias("wish"), "actor",
            "note", none.cast("bigint").alias("failed"), none.cast("bigint").alias("scanned")))
    order = Window.partitionBy("rule_key").orderBy(*_ORDER)
    failing = F.col("kind") == "fail"
    head = F.col("kind").isin("action", "comment") | ~F.lag("kind").over(order).eqNullSafe(F.col("kind"))
    line = line.withColumns({
        "seq": F.row_number().over(order), "head": head,
        "known": F.last(F.when(failing, F.col("failed")), True).over(order.rowsBetween(Window.unboundedPreceding, -1))})
    line = line.withColumn("step", F.sum(F.col("head").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.struct(none.cast("string").alias("status"), F.array().cast(f"array<{_MOVE}>").alias("moves")).cast(_STATE)
    steps = line.filter("head").groupBy("rule_key").agg(F.array_sort(F.collect_list(F.struct("step", "kind", "wish"))).alias("items"))
    moves = steps.select("rule_key", F.explode(F.aggregate("items", start, _step)["moves"]).alias("m")).select("rule_key", "m.*")
    joined = line.join(moves, ["rule_key", "step"])
    event = F.when(F.col("head"), F.col("event")).when(failing, "seen")
    event = F.when((event == "seen") & (F.col("known") != F.col("failed")), "redetected").otherwise(event)
    return joined.withColumn("event_type", event).filter("event_type IS NOT NULL").select(
        "rule_key", "seq", "at", "run_id", "event_type", F.when(F.col("head"), F.col("before")).otherwise(F.col("after")).alias("from_status"),
        F.when(F.col("event_type") == "rejected", F.col("wish")).otherwise(F.col("after")).alias("to_status"),
        "actor", "note", F.col("failed").alias("affected"), "scanned", F.col("after").alias("status"))


_QUIET = ("seen", "skipped", "rejected")
_DETECTED = ("created", "reopened", "redetected", "seen")


def events(log: DataFrame) -> DataFrame:
    """The audit log: one row per event that changed or noted something."""
    return log.filter(~F.col("event_type").isin(*_QUIET)).select(
        "rule_key", "seq", "at", "run_id", "event_type", "from_status", "to_status", "actor", "note")


def rejected_actions(log: DataFrame) -> DataFrame:
    """Triage that did not apply: forbidden moves, and moves and comments on rules without an issue."""
    return log.filter("event_type = 'rejected'").select("rule_key", "at", "from_status", "to_status", "actor")


def current(log: DataFrame) -> DataFrame:
    """One row per issue with its key, detection span, occurrences, latest counts and resolution time."""
    found = F.col("event_type").isin(*_DETECTED)
    closed = F.col("event_type").isin("auto_resolved", "status_change") & (F.col("to_status") == "resolved")

    def at_end(column: str, when: Column, first: bool = False) -> Column:
        pick = F.min_by if first else F.max_by
        return pick(column, F.when(when, F.col("seq")))

    every = F.lit(True)
    out = log.groupBy("rule_key").agg(
        at_end("status", every).alias("status"), at_end("at", found, True).alias("first_detected_at"),
        at_end("run_id", found, True).alias("first_run_id"), at_end("at", found).alias("last_detected_at"),
        at_end("run_id", found).alias("last_run_id"), F.count_if(found).cast("int").alias("occurrences"),
        at_end("affected", found).alias("affected_records"), at_end("scanned", found).alias("records_scanned"),
        at_end("at", closed).alias("_closed")).filter("status IS NOT NULL")
    order = Window.orderBy("first_detected_at", "rule_key")  # one row per rule
    return out.withColumns({
        "resolved_at": F.when(F.col("status") == "resolved", F.col("_closed")),
        "issue_key": F.format_string("DQ-%04d", F.row_number().over(order))}).drop("_closed")


def failing_spells(results: DataFrame) -> DataFrame:
    """Gaps and islands of ``results(rule_key, run_id, as_of, status, failed)``: one row per stretch of failing runs.

    (rule_key, started_at, first_run, last_failed_at, ended_at, runs, peak): ``ended_at`` is the first passing run after it, NULL
    while the rule still fails. Errors neither end nor extend a stretch.
    """
    order = Window.partitionBy("rule_key").orderBy("as_of", "run_id")
    runs = results.filter("status <> 'error'").withColumns({
        "_new": (~F.lag("status").over(order).eqNullSafe(F.col("status"))).cast("int"), "_next": F.lead("as_of").over(order)})
    runs = runs.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.filter("status = 'fail'").groupBy("rule_key", "_island").agg(
        F.min("as_of").alias("started_at"), F.min_by("run_id", "as_of").alias("first_run"), F.max("as_of").alias("last_failed_at"),
        F.max_by("_next", "as_of").alias("ended_at"), F.count(F.lit(1)).alias("runs"), F.max("failed").alias("peak")).drop("_island")


def _page(rows: DataFrame, order: list, name: str, columns: list[str], page: int, size: int) -> DataFrame:
    """(rule_key, <name>, n_<name>): one page of each rule's rows as structs, and how many there are in all."""
    by_rule = Window.partitionBy("rule_key")
    nth = F.row_number().over(by_rule.orderBy(*order))
    held = rows.withColumns({"_n": nth, "_all": F.count(F.lit(1)).over(by_rule)})
    low, high = (page - 1) * size, page * size
    # Only a page is collected; all other rows end in the filter.
    picked = F.sort_array(F.collect_list(F.when((F.col("_n") > low) & (F.col("_n") <= high), F.struct("_n", *columns))))
    shown = F.transform(picked, lambda x: F.struct(*[x[c].alias(c) for c in columns]))
    kept = held.filter((F.col("_n") == 1) | (F.col("_n") > low) & (F.col("_n") <= high))
    return kept.groupBy("rule_key").agg(shown.alias(name), F.max("_all").alias(f"n_{name}"))


def details(issues: DataFrame, log: DataFrame, results: DataFrame, impacted: DataFrame, contacts: DataFrame, page: int = 1,
            size: int = 20) -> DataFrame:
    """The page of an issue: its columns with allowed moves, impacts, events, comments, run history and contacts as arrays.

    Every array holds one page of at most ``size`` entries, and ``n_<array>`` counts them all. Impacts come nearest first, events
    oldest first, comments and runs newest first, contacts with the broken asset's owner first.
    """
    parts = [
        _page(impacted.withColumnRenamed("seed", "rule_key"), ["depth", "asset"], "impacts",
              ["asset", "asset_type", "layer", "criticality", "owner", "depth", "is_critical", "path"], page, size),
        _page(events(log), ["seq"], "events", ["event_type", "from_status", "to_status", "actor", "note", "at", "run_id"], page, size),
        _page(log.filter("event_type = 'comment'"), [F.desc("seq")], "comments", ["at", "actor", "note"], page, size),
        _page(results, [F.desc("as_of"), F.desc("run_id")], "history", ["as_of", "status", "failed", "scanned"], page, size),
        _page(contacts, [F.desc("owns_broken_asset"), "owner"], "contacts", ["owner", "owns_broken_asset"], page, size),
    ]
    out = issues.withColumn("allowed_transitions", allowed_moves(F.col("status")))
    for part in parts:
        name = part.columns[1]
        out = out.join(part, "rule_key", "left").withColumns({
            name: F.coalesce(name, F.array().cast(part.schema[name].dataType)), f"n_{name}": F.coalesce(f"n_{name}", F.lit(0))})
    return out


def describe(issues: DataFrame, rules: DataFrame, impact: DataFrame) -> DataFrame:
    """Add title, description and the impact columns an issue carries."""
    meta = rules.select("rule_key", "rule_name", "rule_type", "columns", "asset", "category", "severity", "business_impact")
    reach = impact.drop("asset", "columns").withColumnRenamed("seed", "rule_key")
    out = issues.join(meta, "rule_key").join(reach, "rule_key", "left")
    share = F.when(F.col("records_scanned") > 0, F.col("affected_records") / F.col("records_scanned")).otherwise(0.0)
    title = F.format_string("%s - %,d failing rows in %s", "rule_name", "affected_records", "asset")
    outputs = F.when(F.size("exposures") > 0, F.array_join("exposures", ", ")).otherwise("no business output")
    text = F.format_string("%,d of %,d rows fail. %d assets depend on them, reaching %s.", "affected_records",
                           "records_scanned", "downstream_count", outputs)
    return out.withColumns({"affected_rate": F.round(share, 6), "title": title, "description": text})


def queue(issues: DataFrame, statuses: list[str] | None = None, bands: list[str] | None = None,
          owners: list[str] | None = None, assets: list[str] | None = None) -> DataFrame:
    """Issues by priority; an absent filter keeps everything."""
    out = issues
    for column, wanted in (("status", statuses), ("priority_band", bands), ("owner", owners), ("asset", assets)):
        if wanted:
            out = out.filter(F.col(column).isin(*wanted))
    return out.orderBy(F.desc("priority_score"), "issue_key")


def contacts(impacted: DataFrame, issues: DataFrame, nodes: DataFrame) -> DataFrame:
    """(rule_key, owner, owns_broken_asset): teams to talk to, the broken asset's owner included."""
    own = issues.select("rule_key", "asset").join(nodes.select("asset", "owner"), "asset").select(
        "rule_key", "owner", F.lit(True).alias("owns_broken_asset"))
    touched = impacted.select(F.col("seed").alias("rule_key"), "owner").join(
        own.select("rule_key", F.col("owner").alias("_own")), "rule_key")
    reached = touched.filter("owner IS NOT NULL").select(
        "rule_key", "owner", (F.col("owner") == F.col("_own")).alias("owns_broken_asset"))
    return reached.union(own).distinct()


def distribution(issues: DataFrame, *by: str) -> DataFrame:
    """Unresolved issues counted by any columns."""
    return issues.filter("status <> 'resolved'").groupBy(*by).agg(F.count(F.lit(1)).alias("issues"))


def rank_correlation(issues: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman correlation: Pearson over average ranks."""
    def ranks(column: str) -> Column:
        low = F.rank().over(Window.orderBy(column))
        ties = F.count(F.lit(1)).over(Window.partitionBy(column))
        return (low + (ties - 1) / 2).cast("double")
    return issues.select(ranks(x).alias("x"), ranks(y).alias("y")).agg(F.corr("x", "y").alias("rank_correlation"))
