"""Queries: profiling and table sources and sinks."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import functions as F

from plumbline.operators import profile as P
from plumbline.plans import commerce_catalog as C
from plumbline.plans.model_sql import staging_sql, with_models
from plumbline.plans.staging import stage_all
from plumbline.session import checkpoint, shared_folder
from plumbline.sources import tables as T
from plumbline.sources.driver_tables import CUTOFF
from plumbline.sources.schemas import RAW, STAGING
from plumbline.suite.common import Bed, plain, staging_oracle

QUERIES = {}
ORACLE = {}


def _add(name, run, sql=None):
    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = sql


def target(asset: str, keep=None) -> P.Target:
    columns = tuple(c for c in STAGING[asset].names if keep is None or c in keep)
    column, hours = C.FRESHNESS.get(asset, (None, None))
    return P.Target(asset, columns, frozenset(C.PII.get(asset, ())), column, hours)


def _kind(asset: str, column: str) -> str:
    return P.family(STAGING[asset][column].dataType)


def _per_column(asset: str, line) -> str:
    return "\nUNION ALL ".join(line(c) for c in STAGING[asset].names)


# ------------------------------------------------------------------ statistics

def _statistics_sql(asset: str) -> str:
    hidden = C.PII.get(asset, ())

    def line(c: str) -> str:
        kind = _kind(asset, c)
        shown = kind != "boolean" and c not in hidden
        low, high = (f"CAST(MIN({c}) AS VARCHAR)", f"CAST(MAX({c}) AS VARCHAR)") if shown else ("NULL", "NULL")
        mean = f"round(CAST(AVG({c}) AS DOUBLE), 4)" if kind == "numeric" else "CAST(NULL AS DOUBLE)"
        spread = f"round(stddev_samp(CAST({c} AS DOUBLE)), 3)" if kind == "numeric" else "CAST(NULL AS DOUBLE)"
        return (f"SELECT '{c}' AS column_name, COUNT(*) AS row_count, COUNT({c}) AS non_null, {low} AS min_value, "
                f"{high} AS max_value, {mean} AS mean_value, {spread} AS stddev_value FROM {asset}")
    return with_models(_per_column(asset, line))


def _statistics(asset: str):
    def run(s, f):
        stats = P.column_statistics(Bed(s, f).staging[asset], target(asset)).drop("ordinal")
        return plain(stats.withColumns({"mean_value": F.round("mean_value", 4),
                                        "stddev_value": F.round("stddev_value", 3)}))
    return run


for _asset in ("stg_orders", "stg_order_items", "stg_customers", "stg_tickets"):
    _add(f"p2_statistics_{_asset}", _statistics(_asset), _statistics_sql(_asset))


def _rates(asset: str):
    def run(s, f):
        profile = P.column_profiles(Bed(s, f).staging[asset], target(asset), medians=False)
        return plain(profile.select("column_name", "null_count", "null_rate", "distinct_count", "uniqueness"))
    return run


for _asset in ("stg_payments", "stg_customers"):
    _add(f"p3_nulls_and_uniqueness_{_asset}", _rates(_asset), with_models(_per_column(
        _asset, lambda c, a=_asset: f"SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS null_count, round((COUNT(*) - "
        f"COUNT({c})) / COUNT(*), 6) AS null_rate, COUNT(DISTINCT {c}) AS distinct_count, CASE WHEN COUNT({c}) > 0 THEN "
        f"round(COUNT(DISTINCT {c}) / COUNT({c}), 6) ELSE 0.0 END AS uniqueness FROM {a}")))

_TOP = ("channel", "priority", "ticket_status", "csat_score", "customer_id")
_add("p4_top_values",
     lambda s, f: plain(P.top_values(P.value_counts(Bed(s, f).staging["stg_tickets"], _TOP), 5)),
     with_models("\nUNION ALL ".join(
         f"SELECT * FROM (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS rank FROM (SELECT '{c}' AS column_name, "
         f"CAST({c} AS VARCHAR) AS value, COUNT(*) AS n FROM stg_tickets WHERE {c} IS NOT NULL GROUP BY 1, 2) AS g) AS x "
         f"WHERE rank <= 5" for c in _TOP)))
_SAMPLED = ("payment_id", "payment_method", "currency", "amount", "processed_at")
_add("p5_sample_values",
     lambda s, f: plain(P.sample_values(P.value_counts(Bed(s, f).staging["stg_payments"], _SAMPLED), 5).drop("n")),
     with_models("\nUNION ALL ".join(
         f"SELECT * FROM (SELECT '{c}' AS column_name, v AS value, row_number() OVER (ORDER BY md5(v), v) AS rank FROM ("
         f"SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM stg_payments WHERE {c} IS NOT NULL) AS d) AS x WHERE rank <= 5"
         for c in _SAMPLED)))


def _medians(s, f):
    bed = Bed(s, f)
    rows = []
    for asset in ("stg_order_items", "stg_orders", "stg_tickets"):
        numeric = [c for c in STAGING[asset].names if _kind(asset, c) == "numeric"]
        rows += [(asset, c, v) for c, v in P.exact_medians(bed.staging[asset], numeric).items()]
    events = P.exact_medians(bed.source("events"), ["value", "event_id"])
    rows += [("events", c, v) for c, v in events.items()]
    return s.createDataFrame(rows, "asset string, column_name string, median_value double")


_add("p2_exact_medians", _medians, with_models("\nUNION ALL ".join(
    f"SELECT '{a}' AS asset, '{c}' AS column_name, CAST(quantile_cont(CAST({c} AS DOUBLE), 0.5) AS DOUBLE) AS median_value FROM {a}"
    for a, cols in [(a, [c for c in STAGING[a].names if _kind(a, c) == "numeric"])
                    for a in ("stg_order_items", "stg_orders", "stg_tickets")] + [("events", ["value", "event_id"])]
    for c in cols)))

_add("p6_personal_data_withheld",
     lambda s, f: plain(P.column_profiles(Bed(s, f).staging["stg_customers"], target("stg_customers"), medians=False).select(
         "column_name", "distinct_count", "min_value", F.size("top_values").alias("top"),
         F.size("sample_values").alias("samples"))),
     with_models(_per_column("stg_customers", lambda c: (
         f"SELECT '{c}' AS column_name, COUNT(DISTINCT {c}) AS distinct_count, "
         + ("CAST(NULL AS VARCHAR) AS min_value, 0 AS top, 0 AS samples" if c in C.PII["stg_customers"] else
            f"CAST(MIN({c}) AS VARCHAR) AS min_value, CASE WHEN COUNT(DISTINCT {c}) < COUNT({c}) THEN LEAST(5, "
            f"COUNT(DISTINCT {c})) ELSE 0 END AS top, LEAST(5, COUNT(DISTINCT {c})) AS samples")
         + " FROM stg_customers"))))

# ------------------------------------------------------------------ freshness

_FRESH = [a for a in STAGING if a in C.FRESHNESS]


def _lag(newest: str, now: str) -> str:
    return (f"CASE WHEN {newest} IS NOT NULL THEN (200 * date_diff('second', {newest}, {now}) + 3600) // 7200 / 100.0 END")


def _fresh_sql(asset: str, now: str, loaded: str = "TRUE") -> str:
    column, hours = C.FRESHNESS.get(asset, ("NULL", None))
    value = f"CAST({column} AS TIMESTAMP)"
    return (f"SELECT '{asset}' AS asset, COUNT(*) FILTER ({loaded}) AS row_count, MAX({value}) FILTER ({loaded} AND "
            f"{value} <= {now}) AS newest, {hours if hours else 'CAST(NULL AS INT)'} AS hours, {now} AS now FROM {asset}")


_STATUS = ("CAST(newest AS VARCHAR) AS freshest_value, CAST({lag} AS DOUBLE) AS freshness_lag_hours, CASE WHEN newest IS "
           "NULL OR hours IS NULL THEN 'unknown' WHEN {lag} <= hours THEN 'fresh' ELSE 'stale' END AS freshness_status"
           ).replace("{lag}", _lag("newest", "now"))
_NOW = f"TIMESTAMP '{CUTOFF}'"


def _freshness(s, f):
    profiles, _ = P.profile_assets(s, Bed(s, f).staging, [target(a) for a in STAGING], CUTOFF)
    return plain(profiles.drop("sla_hours", "column_count"))


_add("p7_freshness", _freshness, with_models(
    f"SELECT asset, row_count, {_STATUS} FROM (" + "\nUNION ALL ".join(_fresh_sql(a, _NOW) for a in STAGING) + ") AS x"))


def _skipping(s, f):
    targets = [target("stg_orders"), P.Target("stg_ghosts", ("id",))]
    profiles, skipped = P.profile_assets(s, Bed(s, f).staging, targets, CUTOFF)
    missing = s.createDataFrame(list(skipped.items()), "asset string, reason string")
    return plain(profiles.select("asset", "row_count", F.lit(None).cast("string").alias("reason")).unionByName(
        missing.select("asset", F.lit(None).cast("bigint").alias("row_count"), "reason")))


_add("p8_missing_table_is_skipped", _skipping, with_models(
    "SELECT 'stg_orders' AS asset, COUNT(*) AS row_count, CAST(NULL AS VARCHAR) AS reason FROM stg_orders UNION ALL "
    "SELECT 'stg_ghosts', NULL, 'table does not exist'"))

_CUTS = [f"{date(2001, 8, 1) - timedelta(days=30 * n)} 23:59:59" for n in (3, 2, 1, 0)]


def _profile_runs(s, f):
    bed = Bed(s, f)
    out = None
    for asset in _FRESH:
        one = P.profile_history(bed.staging[asset], target(asset), _CUTS)
        out = one if out is None else out.unionByName(one)
    return out


_RUNS_SQL = "\nUNION ALL ".join(
    f"SELECT {i} AS run_id, * FROM ({_fresh_sql(a, _T, 'loaded_at <= ' + _T)}) AS y"
    for a in _FRESH for i, _T in enumerate([f"TIMESTAMP '{c}'" for c in _CUTS], start=1))
_add("p12_profile_history", lambda s, f: plain(_profile_runs(s, f).drop("sla_hours", "as_of")),
     with_models(f"SELECT run_id, asset, row_count, {_STATUS} FROM ({_RUNS_SQL}) AS x"))
_add("p10_latest_profile_per_asset",
     lambda s, f: plain(P.latest_per_asset(_profile_runs(s, f)).drop("sla_hours", "as_of")),
     with_models(f"SELECT 4 AS run_id, asset, row_count, {_STATUS} FROM (" + "\nUNION ALL ".join(
         _fresh_sql(a, f"TIMESTAMP '{_CUTS[-1]}'", f"loaded_at <= TIMESTAMP '{_CUTS[-1]}'") for a in _FRESH) + ") AS x"))


def _with_metadata(s, f):
    profile = P.column_profiles(Bed(s, f).staging["stg_orders"], target("stg_orders"), medians=False)
    return plain(profile.join(C.column_frame(s).select("asset", "column_name", "is_critical", "category"),
                              ["asset", "column_name"]).select("column_name", "is_critical", "category", "distinct_count"))


_CDE = {r[1]: r for r in C.columns() if r[0] == "stg_orders"}
_add("p11_column_profiles_with_metadata", _with_metadata, with_models(_per_column("stg_orders", lambda c: (
    f"SELECT '{c}' AS column_name, {_CDE[c][3]} AS is_critical, "
    + (f"'{_CDE[c][4]}'" if _CDE[c][4] else "CAST(NULL AS VARCHAR)") + " AS category, "
    f"COUNT(DISTINCT {c}) AS distinct_count FROM stg_orders"))))


def _persisted(s, f):
    """A whole column profile written to a run table and read back."""
    folder = shared_folder(s)
    profile = P.column_profiles(Bed(s, f).staging["stg_tickets"], target("stg_tickets"))
    T.append_run(profile, folder, 1)
    back = s.read.parquet(folder)
    return plain(back.select("run_id", "column_name", "null_count", "distinct_count", "median_value",
                             F.try_element_at("top_values", F.lit(1))["count"].alias("top_count")))


_add("p9_profile_run_table", _persisted, with_models(_per_column("stg_tickets", lambda c: (
    f"SELECT 1 AS run_id, '{c}' AS column_name, COUNT(*) - COUNT({c}) AS null_count, COUNT(DISTINCT {c}) AS distinct_count, "
    + (f"quantile_cont(CAST({c} AS DOUBLE), 0.5)" if _kind("stg_tickets", c) == "numeric" else "CAST(NULL AS DOUBLE)")
    + f" AS median_value, CASE WHEN COUNT(DISTINCT {c}) < COUNT({c}) THEN (SELECT MAX(n) FROM (SELECT COUNT(*) AS n FROM "
      f"stg_tickets WHERE {c} IS NOT NULL GROUP BY {c}) AS g) END AS top_count FROM stg_tickets"))))
_add("p13_sla_hours",
     lambda s, f: plain(Bed(s, f).source("events").select("event_id", P.sla_hours(
         (F.col("user_id") % 100).cast("double"),
         F.when(F.col("event_type") == "view", "minute").when(F.col("event_type") == "click", "hour").when(
             F.col("event_type") == "error", "day").otherwise("week")).alias("sla_hours"))),
     "SELECT event_id, CAST(CASE event_type WHEN 'view' THEN GREATEST(1, round_even((user_id % 100) / 60.0, 0)) WHEN 'click' "
     "THEN GREATEST(1, user_id % 100) WHEN 'error' THEN GREATEST(1, 24 * (user_id % 100)) END AS BIGINT) AS sla_hours FROM events")

# ------------------------------------------------------------------ sources and sinks

_add("s1_load_raw_tables",
     lambda s, f: T.row_counts(Bed(s, f).land().all_raw()),
     with_models("\nUNION ALL ".join(f"SELECT '{t}' AS table_name, COUNT(*) AS rows FROM raw_{t}" for t in RAW)))


def _raw_cast(field) -> str:
    kind = field.dataType.simpleString()
    return f"CAST({field.name} AS {kind}) AS {field.name}" if kind.startswith("decimal") else field.name


def _digest_sql(tables) -> str:
    """Digests of all rows of some tables: {name: (relation, columns)}."""
    def one(name: str, relation: str, columns) -> str:
        text = ", '|', ".join(f"COALESCE(CAST({c} AS VARCHAR), '-')" for c in columns)
        return (f"SELECT '{name}' AS table_name, COUNT(*) AS rows, CAST(COALESCE(SUM(CAST('0x' || substr(md5(concat({text})), 1, 8) AS BIGINT)), 0) AS "
                f"BIGINT) AS digest FROM {relation}")
    return with_models("\nUNION ALL ".join(one(n, r, c) for n, (r, c) in tables.items()))


def _csv_roundtrip(s, f):
    """All raw tables written as CSV and read again, then staged."""
    folder = shared_folder(s)
    T.write_csv_snapshot(Bed(s, f).land().all_raw(), folder)
    return T.table_digests(stage_all(T.read_raw(s, folder, "csv")))


_add("s2_csv_snapshot_roundtrip", _csv_roundtrip, _digest_sql({
    name: (f"({staging_sql(name)})", schema.names) for name, schema in STAGING.items()}))
_add("s4_raw_schema_landing", lambda s, f: T.table_digests(Bed(s, f).land().all_raw()), _digest_sql({
    name: (f"(SELECT {', '.join(_raw_cast(c) for c in schema)} FROM raw_{name})", schema.names) for name, schema in RAW.items()}))


def _history_sink(s, f):
    """Two runs appended to one table; the reader sees both."""
    folder = shared_folder(s)
    orders = Bed(s, f).staging["stg_orders"]
    for run_id, day in ((1, "2000-01-01"), (2, "2001-01-01")):
        T.append_run(orders.filter(F.col("loaded_at") < F.lit(day).cast("timestamp_ntz")).groupBy("order_status").agg(
            F.count(F.lit(1)).alias("orders")), folder, run_id)
    return plain(s.read.parquet(folder))


_add("s9_append_only_runs", _history_sink, with_models(
    "SELECT 1 AS run_id, order_status, COUNT(*) AS orders FROM stg_orders WHERE loaded_at < TIMESTAMP '2000-01-01' GROUP BY ALL "
    "UNION ALL SELECT 2, order_status, COUNT(*) FROM stg_orders WHERE loaded_at < TIMESTAMP '2001-01-01' GROUP BY ALL"))


def _upsert(s, f):
    """Customers of the first load merged with a later load where some changed and some disappeared."""
    base = Bed(s, f).source("customer").select(
        F.col("c_custkey").alias("customer"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    later = base.filter("customer % 7 <> 0").withColumn("balance", F.when(
        F.col("customer") % 5 == 0, F.lit(0.0)).otherwise(F.col("balance")))
    return T.upsert(base.filter("customer % 3 <> 1"), later, ["customer"])


_add("s10_upsert_with_soft_delete", _upsert,
     "SELECT c_custkey AS customer, c_mktsegment AS segment, CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 5 = 0 THEN 0.0 ELSE "
     "c_acctbal END AS balance, c_custkey % 7 <> 0 AS is_active FROM customer WHERE c_custkey % 7 <> 0 OR c_custkey % 3 <> 1")


def _replace(s, f):
    folder = shared_folder(s)
    links = Bed(s, f).source("orders").select(F.col("o_custkey").alias("upstream"), F.col("o_orderkey").alias("downstream"))
    T.replace_table(links.filter("downstream % 2 = 0"), folder)
    T.replace_table(links.filter("downstream % 2 = 1"), folder)
    return s.read.parquet(folder)


_add("s11_replace_edges", _replace,
     "SELECT o_custkey AS upstream, o_orderkey AS downstream FROM orders WHERE o_orderkey % 2 = 1")


def _introspect(s, f):
    """Catalogued columns against the loaded ones, with the rows each table holds."""
    bed = Bed(s, f)
    live = T.columns_frame(s, bed.staging).select("asset", "column_name", F.lit(True).alias("_live"))
    wanted = C.column_frame(s).filter(F.col("asset").startswith("stg_")).select("asset", "column_name").unionByName(
        s.createDataFrame([("stg_orders", "no_such_column")], "asset string, column_name string"))
    rows = T.row_counts(bed.staging).withColumnRenamed("table_name", "asset")
    return wanted.join(live, ["asset", "column_name"], "left").join(rows, "asset").select(
        "asset", "column_name", F.coalesce("_live", F.lit(False)).alias("present"), "rows")


_add("s12_schema_introspection", _introspect, with_models("\nUNION ALL ".join(
    f"SELECT '{a}' AS asset, unnest([{', '.join(repr(c) for c in s.names)}]) AS column_name, TRUE AS present, (SELECT COUNT(*) "
    f"FROM {a}) AS rows" for a, s in STAGING.items())
    + " UNION ALL SELECT 'stg_orders', 'no_such_column', FALSE, COUNT(*) FROM stg_orders"))


def _contract(s, f):
    """Rows of every table that passed its contract, per declared column."""
    staging = Bed(s, f).staging
    kinds = [(name, x.name, x.dataType.simpleString()) for name, schema in STAGING.items() for x in schema]
    declared = s.createDataFrame(kinds, "table_name string, column_name string, data_type string")
    counts = [df.agg(*[F.count(c).alias(c) for c in df.columns]).select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.col(c).alias("non_null")) for c in df.columns])).alias("x")).select("x.*")
        for name, df in staging.items()]
    return declared.join(reduce(lambda a, b: a.unionByName(b), counts), ["table_name", "column_name"])


_add("t10_staging_contract", _contract, with_models("\nUNION ALL ".join(
    f"SELECT '{name}' AS table_name, '{x.name}' AS column_name, '{x.dataType.simpleString()}' AS data_type, COUNT({x.name}) AS non_null FROM {name}"
    for name, schema in STAGING.items() for x in schema)))
