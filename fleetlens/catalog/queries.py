"""Every operator as a query over the test tables, with its SQL counterpart."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.catalog.oracle import E, GIB, PIECES, L, O, assemble, half_up, sev, threshold_case
from fleetlens.functions.expressions import boundary_diff, cat, number_text, severity_rank, ts_lit, txt
from fleetlens.operators.asof import as_of_join
from fleetlens.operators.latest import latest_cycle, latest_row, nth_cycle
from fleetlens.operators.ranking import order_by_access, order_by_severity, top_k
from fleetlens.operators.reconcile import one_per_key
from fleetlens.plans import alerts as A
from fleetlens.plans import audit as U
from fleetlens.plans import extract_mssql as M
from fleetlens.plans import extract_redshift as X
from fleetlens.plans import measures, reports, retention
from fleetlens.plans.anomaly import cost_anomaly
from fleetlens.plans.cycle import ORDER, Reports, run_cycle
from fleetlens.plans.daily import KEYS as VOLUME, daily_summaries, merged
from fleetlens.plans.distinct import KEYS as SCANNED, STANDARD_ERROR, keep_sketches, merge_sketches, stored_sketches, united
from fleetlens.plans.findings import generate_findings, lock_findings
from fleetlens.plans.forecast import disk_forecast, used_pct
from fleetlens.plans.newest import fold, newest
from fleetlens.plans.retention import apply_compaction, merge_loads
from fleetlens.schemas import TABLES
from fleetlens.sources import ingest, inventory
from fleetlens.sources.fixtures import EVENTS_AS_OF, LINEITEM_AS_OF, ORDERS_AS_OF, Fixtures
from fleetlens.sources.ingest import load_sources, read_evidence
from fleetlens.sources.server_logs import read_logs, stream_logs
from fleetlens.sources.store import SnapshotStore
from fleetlens.streaming.alert_life import alert_table, stream_alerts
from fleetlens.streaming.streams import stream_cycle, stream_dedup

EV, OR, LI = EVENTS_AS_OF, ORDERS_AS_OF, LINEITEM_AS_OF

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Only the types both engines print alike: 64-bit integers and doubles."""
    casts = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "float": "double", "void": "string"}
    return df.select(
        *[
            F.col(c).cast("double" if t.startswith("decimal") else casts[t]).alias(c)
            if t in casts or t.startswith("decimal")
            else F.col(c)
            for c, t in df.dtypes
        ]
    )


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Fixtures], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(build(Fixtures(spark, sf_dir)))

        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = assemble(sql)
        return build

    return register


def simple(name: str, sql: str, build) -> None:
    query(name, sql)(build)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ------------------------------------------------------------------- reports

ag = lambda f: reports.ag_sync_status(f.fx_ag)
lag = lambda f: reports.data_lag(f.fx_data_lag)
backup = lambda f: reports.backup_health(f.fx_backup, OR)
vitals = lambda f: reports.instance_vitals(f.fx_health_metric)
tables = lambda f: reports.table_health(f.fx_table_health)
jobs = lambda f: reports.job_failures(f.fx_job_failure, EV)
forecast = lambda f: disk_forecast(f.fx_disk_usage, OR, lookback=365)
disk = lambda f: reports.disk_forecast_report(forecast(f))
config = lambda f: reports.config_audit(f.fx_config_audit)
people = lambda f: reports.principals(f.fx_security_principal)
access = lambda f: reports.access_control(people(f))
files = lambda f: reports.file_io(f.fx_file_io)

VIEWED: dict[str, Callable[[Fixtures], DataFrame]] = {}
for _name, _view, _build in [
    ("report_ag_sync_status", "v_ag", ag),
    ("report_data_lag", "v_lag", lag),
    ("report_backup_health", "v_backup", backup),
    ("report_instance_vitals", "v_vitals", vitals),
    ("report_server_info", "v_server_info", lambda f: reports.server_info(f.fx_server_info)),
    ("report_config_audit", "v_config", config),
    ("report_principals", "v_principals", people),
    ("report_access_control", "v_access", access),
    ("report_active_queries", "v_activity", lambda f: reports.active_queries(f.fx_query_snapshot)),
    ("report_top_waits", "v_waits", lambda f: reports.top_waits(f.fx_wait_stats)),
    ("report_table_health", "v_tables", tables),
    ("report_top_queries", "v_top_queries", lambda f: reports.top_queries(f.fx_top_queries)),
    ("report_login_activity", "v_logins", lambda f: reports.login_activity(f.fx_login_activity)),
    ("report_spectrum_by_table", "v_spectrum", lambda f: reports.spectrum_by_table(f.fx_spectrum_scan)),
    ("report_index_health", "v_indexes", lambda f: reports.index_health(f.fx_index_health)),
    ("report_file_io", "v_files", files),
    ("report_costly_queries", "v_costly", lambda f: reports.costly_queries(f.fx_query_cost)),
    ("report_wait_delta", "v_wait_delta", lambda f: reports.wait_delta(f.fx_wait_stats)),
    ("report_job_failures", "v_jobs", jobs),
    ("report_failed_logins", "v_failed_logins", lambda f: reports.failed_logins(f.fx_failed_login, EV)),
    ("report_autogrowth_events", "v_autogrowth", lambda f: reports.autogrowth(f.fx_autogrowth, EV)),
    ("report_growth_daily", "v_growth_daily", lambda f: reports.growth_daily(f.fx_object_size)),
    ("report_growth_keys", "v_growth_keys", lambda f: reports.growth_keys(f.fx_object_size)),
    ("report_stale_tables", "v_stale", lambda f: reports.stale_tables(f.fx_object_size, f.fx_table_scan, LI)),
    ("report_disk_forecast", "v_disk", disk),
    ("report_cost_trend", "v_cost_trend", lambda f: reports.cost_trend(f.fx_redshift_cost)),
    ("report_servers", "v_servers", lambda f: reports.servers_report(f.fx_servers, f.fx_collection_log)),
    ("report_app_owners", "fx_app_owners", lambda f: reports.app_owners(f.fx_app_owners)),
    ("forecast_disk_full", "v_forecast", forecast),
]:
    simple(_name, f"SELECT * FROM {_view}", _build)
    VIEWED[_view] = _build

# ----------------------------------------------------------- anomalies, findings


def known_anomalies(f: Fixtures) -> DataFrame:
    """Anomalies two servers have been warned of already: their newest day."""
    newest = f.fx_redshift_cost.groupBy("ServerName", "MetricName").agg(
        F.max(F.to_date("CollectedAt")).alias("ObservedDay")
    )
    return newest.filter(F.col("ServerName").isin("srv3", "srv7"))


@query("detect_cost_anomaly", "SELECT * FROM v_anomalies")
def anomalies(f):
    found = cost_anomaly(
        f.fx_redshift_cost, known_anomalies(f), EV, warn_z=0.5, crit_z=1.0, warn_pct=5.0, crit_pct=20.0
    )
    return rounded(found, "Baseline", "StdDev")


@query(
    "report_cost_anomaly",
    """SELECT ServerName, MetricName, MetricUnit, ObservedDay, round(Value, 3) AS Value, round(Baseline, 3) AS Baseline,
       ZScore, PctAboveBaseline, Severity, DetectedAt FROM v_anomalies
       ORDER BY DetectedAt DESC, PctAboveBaseline DESC NULLS LAST, ServerName, MetricName LIMIT 500""",
)
def _(f):
    return reports.cost_anomaly_report(anomalies(f), EV)


simple("classify_lock_waits", "SELECT * FROM v_lock_findings", lambda f: lock_findings(f.fx_lock_wait))


def prev_findings(f: Fixtures) -> DataFrame:
    old = F.lit("old")
    evening = ts_lit(EV, days=-1)
    closed = F.col("WaiterPid") % 4 == 0
    return f.fx_lock_wait.select(
        cat(txt("RSBlock|"), "ServerName", txt("|"), "WaiterPid", txt("|"), "Relation").alias("FindingKey"),
        F.when(F.col("WaiterPid") % 6 == 0, "MSSQL").otherwise("Redshift").alias("Platform"),
        F.lit("Blocking").alias("Category"), F.lit("WARN").alias("Severity"), "ServerName",
        F.lit("old title").alias("Title"), old.alias("Symptom"), old.alias("RootCause"), old.alias("Recommendation"),
        old.alias("Prevention"), old.alias("Evidence"), F.col("CollectedAt").alias("FirstSeen"),
        evening.alias("LastSeen"), closed.alias("Resolved"), F.when(closed, evening).alias("ResolvedAt"),
    )


@query("generate_findings", "SELECT * FROM v_findings")
def findings(f):
    return generate_findings(f.fx_lock_wait, prev_findings(f), EV)


@query(
    "report_findings",
    f"""SELECT FindingKey, Platform, Category, Severity, ServerName, Title, Symptom, RootCause, Recommendation, Prevention,
        Evidence, FirstSeen, LastSeen, date_diff('minute', FirstSeen, {E}) AS AgeMinutes FROM v_findings WHERE NOT Resolved""",
)
def _(f):
    return reports.findings_report(findings(f), EV)


# --------------------------------------------------------------------- alerts

for _name, _view, _build in [
    ("alerts_disk", "v_a_disk", lambda f: A.disk_alerts(forecast(f))),
    ("alerts_ag", "v_a_ag", lambda f: A.ag_alerts(ag(f))),
    ("alerts_lag", "v_a_lag", lambda f: A.lag_alerts(lag(f))),
    ("alerts_cost", "v_a_cost", lambda f: A.cost_alerts(anomalies(f), EV)),
    ("alerts_backup", "v_a_backup", lambda f: A.backup_alerts(backup(f))),
    ("alerts_job", "v_a_jobs", lambda f: A.job_alerts(jobs(f), EV)),
    ("alerts_vitals", "v_a_vitals", lambda f: A.vitals_alerts(vitals(f))),
    ("alerts_table_health", "v_a_tables", lambda f: A.table_alerts(tables(f))),
    ("alerts_advisor", "v_a_findings", lambda f: A.advisor_alerts(findings(f))),
]:
    simple(_name, f"SELECT * FROM {_view}", _build)


def conditions(f: Fixtures) -> dict[str, DataFrame]:
    return {
        "disk": forecast(f), "ag": ag(f), "lag": lag(f), "cost": anomalies(f), "backup": backup(f), "jobs": jobs(f),
        "vitals": vitals(f), "tables": tables(f), "findings": findings(f),
    }


simple(
    "alert_conditions_one_per_key",
    "SELECT * FROM v_current",
    lambda f: one_per_key(A.current_conditions(EV, **conditions(f)), "AlertKey", "Message"),
)


def prev_alerts(f: Fixtures) -> DataFrame:
    seen = f.fx_health_metric.select(
        cat(txt("Vitals|"), "ServerName", txt("|"), "MetricName").alias("AlertKey"), F.lit("Vitals").alias("Category"),
        "ServerName",
    ).distinct()
    lagging = f.fx_data_lag.select(
        cat(txt("Lag|"), "ServerName", txt("|"), "ObjectName").alias("AlertKey"), F.lit("Lag").alias("Category"),
        "ServerName",
    ).distinct()
    size = F.length("AlertKey")
    evening = ts_lit(EV, days=-1)
    return seen.unionByName(lagging).select(
        "AlertKey", "Category", F.lit("WARN").alias("Severity"), "ServerName", F.lit("old text").alias("Message"),
        ts_lit(EV, days=-3).alias("FirstSeen"), evening.alias("LastSeen"),
        F.when(size % 3 != 0, ts_lit(EV, days=-2)).alias("NotifiedAt"), (size % 4 == 0).alias("Resolved"),
        F.when(size % 4 == 0, evening).alias("ResolvedAt"),
    )


@query("evaluate_alerts", "SELECT * FROM v_alerts")
def alerts(f):
    return A.evaluate_alerts(prev_alerts(f), EV, **conditions(f))


@query("report_active_alerts", "SELECT * FROM v_active")
def active(f):
    return reports.active_alerts(alerts(f), f.fx_app_owners)


@query("notification_outbox", "SELECT * FROM v_outbox")
def outbox(f):
    return A.notification_outbox(alerts(f), f.fx_app_owners)


simple(
    "notification_digest",
    """SELECT count(*) AS Alerts, count(*) FILTER (WHERE Severity = 'CRIT') AS Critical,
       concat('[FleetLens] ', count(*), ' new alert(s)', CASE WHEN count(*) FILTER (WHERE Severity = 'CRIT') > 0
              THEN concat(' (', count(*) FILTER (WHERE Severity = 'CRIT'), ' CRITICAL)') END) AS Subject
       FROM v_outbox HAVING count(*) > 0""",
    lambda f: A.notification_digest(outbox(f)),
)
simple(
    "notification_recipients",
    """SELECT DISTINCT concat(lower(n_name), '@example.test') AS Email FROM nation
       UNION SELECT OwnerEmail FROM v_outbox WHERE OwnerEmail <> ''""",
    lambda f: A.notification_recipients(
        outbox(f), f.nation.select(F.concat(F.lower("n_name"), F.lit("@example.test")).alias("Email"))
    ),
)
simple(
    "mark_notified",
    f"""SELECT AlertKey, Category, Severity, ServerName, Message, FirstSeen, LastSeen,
        CASE WHEN NOT Resolved AND NotifiedAt IS NULL AND Category = 'Lag' THEN {E} ELSE NotifiedAt END AS NotifiedAt,
        Resolved, ResolvedAt FROM v_prev_alerts""",
    lambda f: A.mark_notified(prev_alerts(f), prev_alerts(f).filter("Category = 'Lag'"), EV),
)

# --------------------------------------------------------------------- rollups

_DOMAIN = "(SELECT CASE min(r) WHEN 0 THEN 'CRIT' WHEN 1 THEN 'WARN' WHEN 2 THEN 'OK' END FROM v_ranks k WHERE k.ServerName = s.ServerName AND Domain = '{}')"


@query(
    "report_estate_health",
    f"""SELECT *, CAST(least({", ".join(sev(f'"{d}"') for d in ("Backup", "Disk", "Jobs", "HA", "Perf", "Data"))}) AS BIGINT)
               AS OverallRank,
        CASE OverallRank WHEN 0 THEN 'CRIT' WHEN 1 THEN 'WARN' ELSE 'OK' END AS OverallStatus
        FROM (SELECT s.ServerName, s.Environment, s.Platform, s.FriendlyName,
              coalesce({_DOMAIN.format("Backup")}, 'NA') AS Backup, coalesce({_DOMAIN.format("Disk")}, 'NA') AS Disk,
              CASE WHEN s.Platform <> 'MSSQL' THEN 'NA' ELSE coalesce({_DOMAIN.format("Jobs")}, 'OK') END AS Jobs,
              coalesce({_DOMAIN.format("HA")}, 'NA') AS HA, coalesce({_DOMAIN.format("Perf")}, 'NA') AS Perf,
              coalesce({_DOMAIN.format("Data")}, 'NA') AS Data
              FROM fx_servers s WHERE s.IsActive)""",
)
def estate(f):
    return reports.estate_health(
        f.fx_servers, backup(f), disk(f), jobs(f), ag(f), vitals(f), lag(f), tables(f), as_of=EV
    )


@query("report_overview", "SELECT * FROM v_overview")
def overview(f):
    return reports.overview(
        f.fx_servers, f.fx_app_owners, f.fx_collection_log, ag(f), lag(f), disk(f), backup(f), jobs(f), vitals(f),
        findings(f), config(f), access(f), files(f), EV,
    )


# ------------------------------------------------------------------ primitives

simple(
    "latest_row",
    "SELECT * FROM fx_redshift_cost QUALIFY row_number() OVER (PARTITION BY ServerName, MetricName ORDER BY CollectedAt DESC, SnapshotID DESC) = 1",
    lambda f: latest_row(f.fx_redshift_cost, ["ServerName", "MetricName"], tie="SnapshotID"),
)
simple(
    "latest_row_one_pass",
    "SELECT * FROM fx_query_cost QUALIFY row_number() OVER (PARTITION BY UserName ORDER BY CollectedAt DESC, SnapshotID DESC) = 1",
    lambda f: latest_row(f.fx_query_cost, ["UserName"], tie="SnapshotID"),
)
simple(
    "latest_cycle_from_log",
    """SELECT q.* FROM fx_query_snapshot q JOIN (SELECT ServerName, max(t) AS t FROM
       (SELECT ServerName, CollectedAt AS t FROM fx_query_snapshot UNION ALL
        SELECT ServerName, CAST(date_trunc('hour', RunAt) AS TIMESTAMP) FROM fx_collection_log) GROUP BY 1) n
       ON n.ServerName = q.ServerName AND n.t = q.CollectedAt""",
    lambda f: latest_cycle(
        f.fx_query_snapshot,
        cycles=f.fx_collection_log.select(
            "ServerName",
            F.expr("RunAt - make_dt_interval(0, 0, minute(RunAt), extract(SECOND FROM RunAt))").alias("CollectedAt"),
        ),
    ),
)
simple(
    "second_newest_cycle",
    """SELECT * FROM fx_login_activity QUALIFY dense_rank() OVER (PARTITION BY ServerName ORDER BY CollectedAt DESC) = 2""",
    lambda f: nth_cycle(f.fx_login_activity, n=2),
)
simple(
    "boundary_date_diff",
    f"""SELECT event_id, date_diff('second', ts, {E}) AS Seconds, date_diff('minute', ts, {E}) AS Minutes,
        date_diff('hour', ts, {E}) AS Hours, date_diff('day', ts, {E}) AS Days FROM events""",
    lambda f: f.events.select(
        "event_id",
        *[boundary_diff(u, "ts", ts_lit(EV)).alias(f"{u.title()}s") for u in ("second", "minute", "hour", "day")],
    ),
)
simple(
    "severity_rank_and_text",
    f"""SELECT SnapshotID, CAST({sev("Status")} AS BIGINT) AS Rank, concat(Status, '/', Detail, '/', CurrentValue) AS Label,
        regexp_replace(CAST(CAST(SnapshotID / 8.0 AS DECIMAL(20,3)) AS VARCHAR), '\\.?0+$', '') AS Number
        FROM fx_config_audit""",
    lambda f: f.fx_config_audit.select(
        "SnapshotID",
        severity_rank("Status").alias("Rank"),
        cat("Status", txt("/"), "Detail", txt("/"), "CurrentValue").alias("Label"),
        number_text(F.col("SnapshotID") / 8).alias("Number"),
    ),
)


def placed(ordered: DataFrame) -> DataFrame:
    """An ordered list with the position of each row among those of its server, as listed."""
    listed = ordered.withColumn("_n", F.monotonically_increasing_id())
    position = F.row_number().over(Window.partitionBy("ServerName").orderBy("_n"))
    return listed.withColumn("Position", position).drop("_n")


simple(
    "order_by_severity",
    """SELECT *, row_number() OVER (PARTITION BY ServerName ORDER BY
       CASE Status WHEN 'CRIT' THEN 0 WHEN 'WARN' THEN 1 ELSE 2 END, MetricName, Platform) AS Position FROM v_vitals""",
    lambda f: placed(order_by_severity(vitals(f), "Status", "ServerName", "MetricName", "Platform")),
)
simple(
    "order_by_access",
    """SELECT *, row_number() OVER (PARTITION BY ServerName ORDER BY CASE AccessType WHEN 'Sysadmin' THEN 0 WHEN 'Security admin'
       THEN 1 WHEN 'Elevated' THEN 2 WHEN 'Standard' THEN 3 WHEN 'Connect-only' THEN 4 ELSE 5 END, AccessType) AS Position
       FROM v_access""",
    lambda f: placed(order_by_access(access(f), "AccessType")),
)
simple(
    "top_k_per_server",
    "SELECT * FROM fx_query_cost QUALIFY row_number() OVER (PARTITION BY ServerName ORDER BY EstCostUSD DESC, QueryId) <= 25",
    lambda f: top_k(f.fx_query_cost, 25, F.desc("EstCostUSD"), "QueryId"),
)

# ------------------------------------------------------------ ingest, inventory

simple(
    "ingest_disk_usage",
    f"""SELECT {O} AS CollectedAt, 'MSSQL' AS Platform, ServerName, VolumeName, TotalBytes, UsedBytes,
        TotalBytes - UsedBytes AS FreeBytes, {half_up("100 * UsedBytes", "TotalBytes", 2)} AS UsedPct FROM fx_disk_usage""",
    lambda f: ingest.conform(
        ingest.with_envelope(
            f.fx_disk_usage.select("servername", "volumename", "totalbytes", "usedbytes"), OR, platform="MSSQL"
        ),
        "DiskUsage",
    ),
)

_SERVER_COLUMNS = (
    "ServerName, Platform, Environment, FriendlyName, IsActive, CreatedAt, Host, Port, DatabaseName, AuthType, UserName, HasPassword"
)


@query(
    "register_servers",
    f"""SELECT coalesce(c.ServerName, s.ServerName) AS ServerName, coalesce(c.Platform, s.Platform) AS Platform,
        coalesce(c.Environment, s.Environment) AS Environment, coalesce(c.FriendlyName, s.FriendlyName) AS FriendlyName,
        CASE WHEN c.ServerName IS NOT NULL THEN true ELSE s.IsActive END AS IsActive, coalesce(s.CreatedAt, {O}) AS CreatedAt,
        s.Host, CAST(s.Port AS BIGINT) AS Port, s.DatabaseName,
        CASE WHEN s.ServerName IS NULL THEN 'windows' ELSE s.AuthType END AS AuthType, s.UserName,
        CASE WHEN s.ServerName IS NULL THEN false ELSE s.HasPassword END AS HasPassword
        FROM fx_servers s FULL JOIN fx_contacted c ON c.ServerName = s.ServerName""",
)
def _(f):
    return inventory.register_servers(f.fx_servers, f.fx_contacted, OR).drop("ServerID")


@query(
    "upsert_servers",
    f"""SELECT coalesce(c.ServerName, s.ServerName) AS ServerName,
        CASE WHEN c.ServerName IS NULL THEN s.Platform WHEN c.Platform IN ('MSSQL', 'Redshift') THEN c.Platform
             ELSE 'MSSQL' END AS Platform, coalesce(c.Environment, s.Environment) AS Environment,
        CASE WHEN c.ServerName IS NULL THEN s.FriendlyName ELSE c.FriendlyName END AS FriendlyName,
        CASE WHEN c.ServerName IS NULL THEN s.IsActive ELSE c.IsActive END AS IsActive,
        coalesce(s.CreatedAt, {O}) AS CreatedAt, CASE WHEN c.ServerName IS NULL THEN s.Host ELSE c.Host END AS Host,
        CAST(coalesce(c.Port, s.Port) AS BIGINT) AS Port, s.DatabaseName,
        CASE WHEN c.ServerName IS NULL THEN s.AuthType WHEN c.AuthType IN ('windows', 'sql') THEN c.AuthType
             ELSE 'windows' END AS AuthType, CASE WHEN c.ServerName IS NULL THEN s.UserName ELSE c.UserName END AS UserName,
        coalesce(c.HasPassword, false) OR coalesce(s.HasPassword, false) AS HasPassword
        FROM fx_servers s FULL JOIN fx_server_changes c ON c.ServerName = s.ServerName""",
)
def _(f):
    return inventory.upsert_servers(f.fx_servers, f.fx_server_changes, OR).drop("ServerID")


_OWNER_SET = ["AppName", "Criticality", "PrimaryOwner", "SecondaryOwner", "Team", "Email", "OnCallPhone", "Notes", "UpdatedBy"]
_OWNER_KEY = ["ServerName", "DatabaseName"]


def _owner_step(prev: str, changes: str, cond: str) -> str:
    columns = ", ".join(
        f"CASE WHEN c.AppName IS NULL THEN o.{x} ELSE c.{x} END AS {x}" for x in [*_OWNER_KEY, *_OWNER_SET, "UpdatedAt"]
    )
    return f"SELECT o.AppOwnerID, {columns} FROM {prev} o FULL JOIN {changes} c ON {cond}"


@query(
    "upsert_owners",
    f"""SELECT * EXCLUDE (AppOwnerID) FROM ({_owner_step(
        "(" + _owner_step(
            "fx_app_owners", f'''(SELECT *, {O} AS UpdatedAt FROM (SELECT * REPLACE (coalesce(nullif(DatabaseName, ''),
            '(instance)') AS DatabaseName, CASE WHEN Criticality IN ('Tier1', 'Tier2', 'Tier3') THEN Criticality ELSE 'Tier3'
            END AS Criticality) FROM fx_owner_changes) WHERE AppOwnerID <> 0)''', "c.AppOwnerID = o.AppOwnerID") + ")",
        f'''(SELECT *, {O} AS UpdatedAt FROM (SELECT * REPLACE (coalesce(nullif(DatabaseName, ''), '(instance)')
        AS DatabaseName, CASE WHEN Criticality IN ('Tier1', 'Tier2', 'Tier3') THEN Criticality ELSE 'Tier3' END
        AS Criticality) FROM fx_owner_changes) WHERE AppOwnerID = 0)''',
        "c.ServerName = o.ServerName AND c.DatabaseName = o.DatabaseName AND c.AppName = o.AppName")})""",
)
def _(f):
    return inventory.upsert_owners(f.fx_app_owners, f.fx_owner_changes, OR).drop("AppOwnerID")


simple(
    "delete_owners_by_id",
    "SELECT * FROM fx_app_owners WHERE AppOwnerID NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    lambda f: inventory.delete_by_id(
        f.fx_app_owners,
        f.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("AppOwnerID")),
        "AppOwnerID",
    ),
)
simple(
    "count_deleted_owners",
    """SELECT count(*) AS RowsDeleted FROM fx_app_owners
       WHERE AppOwnerID IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
    lambda f: inventory.rows_deleted(
        f.fx_app_owners,
        f.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("AppOwnerID")),
        "AppOwnerID",
    ),
)
simple(
    "registry_group_members",
    """SELECT server_name AS ServerName FROM raw_registered
       WHERE server_group_id IN (SELECT server_group_id FROM raw_server_groups WHERE name = 'group1')""",
    lambda f: inventory.servers_in_group(f.raw_registered, f.raw_server_groups, "group1"),
)
_TARGETS = """
SELECT '{platform}' AS Platform, ServerName, AuthType, UserName, Source FROM (
  SELECT ServerName, CASE WHEN UserName IS NOT NULL THEN 'sql' ELSE 'windows' END AS AuthType, UserName, 'config' AS Source, 0 AS p
  FROM raw_config_targets
  UNION ALL SELECT ServerName, AuthType, UserName, 'inventory', 2 FROM fx_servers
  WHERE IsActive AND Platform = '{platform}' {more})
QUALIFY row_number() OVER (PARTITION BY ServerName ORDER BY p, UserName) = 1"""
simple(
    "resolve_targets_mssql",
    _TARGETS.format(
        platform="MSSQL",
        more="""UNION ALL SELECT server_name, 'windows', NULL, 'registry', 1 FROM raw_registered
                WHERE server_group_id IN (SELECT server_group_id FROM raw_server_groups WHERE name = 'group1')""",
    ),
    lambda f: inventory.resolve_targets(
        inventory.servers_in_group(f.raw_registered, f.raw_server_groups, "group1"),
        f.raw_config_targets, f.fx_servers, "MSSQL",
    ),
)
simple(
    "resolve_targets_redshift",
    _TARGETS.format(platform="Redshift", more="AND Host IS NOT NULL"),
    lambda f: inventory.resolve_targets(None, f.raw_config_targets, f.fx_servers, "Redshift"),
)

# ------------------------------------------------------- extraction, SQL Server


@query(
    "extract_ag_sync",
    """SELECT s.ServerName, g.name AS AGName, s.database_name AS DatabaseName, r.replica_server_name AS ReplicaServer,
       s.is_primary_replica AS IsPrimary, CASE WHEN s.is_primary_replica THEN 'PRIMARY' ELSE 'SECONDARY' END AS Role,
       s.synchronization_state_desc AS SyncState, s.synchronization_health_desc AS SyncHealth,
       s.log_send_queue_size AS LogSendQueueKB, s.redo_queue_size AS RedoQueueKB, s.last_commit_time AS LastCommitTime,
       s.last_hardened_time AS LastHardenedTime, s.last_redone_time AS LastRedoneTime
       FROM raw_replica_states s JOIN raw_replicas r ON r.ServerName = s.ServerName AND r.replica_id = s.replica_id
       JOIN raw_groups g ON g.ServerName = r.ServerName AND g.group_id = r.group_id""",
)
def ag_evidence(f):
    return M.extract_ag_sync(f.raw_replica_states, f.raw_replicas, f.raw_groups)


simple(
    "extract_ag_lag",
    """WITH rep AS (SELECT s.*, g.name AS ag, r.replica_server_name AS rs FROM raw_replica_states s
         JOIN raw_replicas r ON r.ServerName = s.ServerName AND r.replica_id = s.replica_id
         JOIN raw_groups g ON g.ServerName = r.ServerName AND g.group_id = r.group_id)
       SELECT s.ServerName, concat('AG:', s.database_name, '@', s.rs) AS ObjectName,
       date_diff('second', s.last_commit_time, p.t) AS LagSeconds, 'ag_redo_lag' AS Metric,
       concat('AG=', s.ag, '; RedoQueueKB=', coalesce(s.redo_queue_size, 0)) AS Detail
       FROM rep s JOIN (SELECT ServerName, ag, database_name, max(last_commit_time) AS t FROM rep WHERE is_primary_replica GROUP BY ALL) p
         ON p.ServerName = s.ServerName AND p.ag = s.ag AND p.database_name = s.database_name WHERE NOT s.is_primary_replica""",
    lambda f: M.extract_ag_lag(ag_evidence(f)),
)
simple(
    "extract_disk",
    """SELECT DISTINCT f.ServerName, v.volume_mount_point AS VolumeName, v.total_bytes AS TotalBytes,
       v.total_bytes - v.available_bytes AS UsedBytes
       FROM raw_files f JOIN raw_volume_stats v ON v.ServerName = f.ServerName AND v.database_id = f.database_id AND v.file_id = f.file_id""",
    lambda f: M.extract_disk(f.raw_files, f.raw_volume_stats),
)
simple(
    "extract_db_size",
    """SELECT ServerName, 'database' AS ObjectType, database_name AS ObjectName, CAST(sum(size) * 8192 AS BIGINT) AS SizeBytes
       FROM raw_files WHERE type IN (0, 1) GROUP BY ServerName, database_name""",
    lambda f: M.extract_db_size(f.raw_files),
)
simple(
    "extract_backup",
    """SELECT d.ServerName, d.name AS DatabaseName, d.recovery_model_desc AS RecoveryModel, d.state_desc AS StateDesc,
       max(CASE WHEN b.type = 'D' THEN b.backup_finish_date END) AS LastFullBackup,
       max(CASE WHEN b.type = 'I' THEN b.backup_finish_date END) AS LastDiffBackup,
       max(CASE WHEN b.type = 'L' THEN b.backup_finish_date END) AS LastLogBackup,
       d.last_good_checkdb AS LastGoodCheckDb, d.page_verify_option_desc AS PageVerify, d.is_auto_shrink_on AS IsAutoShrink
       FROM raw_databases d LEFT JOIN raw_backupset b
         ON b.ServerName = d.ServerName AND b.database_name = d.name AND NOT b.is_copy_only AND NOT b.is_snapshot
       WHERE d.name <> 'tempdb' GROUP BY ALL""",
    lambda f: M.extract_backup(f.raw_databases, f.raw_backupset),
)
simple(
    "extract_job_failures",
    """SELECT h.ServerName, j.name AS JobName, h.step_name AS StepName,
       strptime(printf('%08d%06d', h.run_date, h.run_time), '%Y%m%d%H%M%S') AS RunAt, left(h.message, 600) AS Message
       FROM raw_job_history h JOIN raw_jobs j ON j.ServerName = h.ServerName AND j.job_id = h.job_id
       WHERE h.run_status = 0 AND h.step_id > 0
         AND strptime(printf('%08d%06d', h.run_date, h.run_time), '%Y%m%d%H%M%S') > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 24 HOUR""",
    lambda f: M.extract_job_failures(f.raw_job_history, f.raw_jobs, "2024-01-20 00:00:00"),
)
_CPU = """
SELECT ServerName, arg_max(CAST(regexp_extract(record, '<ProcessUtilization>(\\d+)<', 1) AS DOUBLE),
                           CAST(regexp_extract(record, ' time="(\\d+)"', 1) AS BIGINT)) AS cpu_pct
FROM raw_ring_buffer WHERE ring_buffer_type = 'RING_BUFFER_SCHEDULER_MONITOR' AND record LIKE '%<SystemHealth>%' GROUP BY 1"""
simple("extract_cpu_pct", _CPU, lambda f: M.extract_cpu_pct(f.raw_ring_buffer))


def _metric(name: str, value: str, source: str, zero: bool, by: str = "GROUP BY 1") -> str:
    shown = "coalesce(x.v, 0)" if zero else "x.v"
    return f"""SELECT s.ServerName, '{name}' AS MetricName, CAST({shown} AS DOUBLE) AS MetricValue, CAST(NULL AS VARCHAR) AS Detail
FROM fx_servers s LEFT JOIN (SELECT ServerName, {value} AS v FROM {source} {by}) x ON x.ServerName = s.ServerName
{"" if zero else "WHERE x.v IS NOT NULL"}"""


simple(
    "extract_vitals",
    " UNION ALL ".join(
        [
            _metric("page_life_expectancy", "cntr_value", "raw_counters WHERE counter_name = 'Page life expectancy' AND object_name LIKE '%:Buffer Manager%'", False, ""),
            _metric("memory_grants_pending", "cntr_value", "raw_counters WHERE counter_name = 'Memory Grants Pending'", False, ""),
            _metric("user_sessions", "count(*)", "raw_sessions WHERE is_user_process", True),
            _metric("blocked_sessions", "count(*)", "raw_requests WHERE blocking_session_id <> 0", True),
            _metric("uptime_hours", f"date_diff('hour', sqlserver_start_time, {E})", "raw_sys_info", False, ""),
            _metric("cpu_pct", "cpu_pct", f"({_CPU})", True, ""),
            _metric("suspect_pages", "count(*)", "raw_suspect_pages", True),
            _metric("deadlocks_total", "cntr_value", "raw_counters WHERE counter_name = 'Number of Deadlocks/sec' AND instance_name = '_Total'", True, ""),
            _metric("tempdb_used_gb", "sum(user_object_reserved_page_count + internal_object_reserved_page_count + version_store_reserved_page_count + mixed_extent_page_count) * 8 / 1048576", "raw_file_space", True),
            _metric("tempdb_version_store_gb", "sum(version_store_reserved_page_count) * 8 / 1048576", "raw_file_space", True),
            _metric("max_vlf_count", "max(n)", "(SELECT ServerName, database_id, count(*) AS n FROM raw_log_info GROUP BY 1, 2)", True),
        ]
    ),
    lambda f: M.extract_vitals(
        f.fx_servers, EV, f.raw_counters, f.raw_sessions, f.raw_requests, f.raw_sys_info, f.raw_ring_buffer,
        f.raw_suspect_pages, f.raw_file_space, f.raw_log_info,
    ),
)
simple(
    "extract_activity",
    f"""SELECT r.ServerName, r.session_id AS SessionID, r.blocking_session_id AS BlockedBy, r.status AS Status,
        r.wait_type AS WaitType, date_diff('second', r.start_time, {E}) AS DurationSec, r.database_name AS DatabaseName,
        s.login_name AS LoginName, s.host_name AS HostName, left(s.program_name, 160) AS ProgramName, left(t.text, 500) AS QueryText
        FROM raw_requests r JOIN raw_sessions s ON s.ServerName = r.ServerName AND s.session_id = r.session_id
        LEFT JOIN raw_texts t ON t.ServerName = r.ServerName AND t.sql_handle = r.sql_handle
        WHERE s.is_user_process AND (r.blocking_session_id <> 0 OR date_diff('second', r.start_time, {E}) > 60)""",
    lambda f: M.extract_activity(f.raw_requests, f.raw_sessions, f.raw_texts, EV),
)
simple(
    "extract_waits",
    f"""SELECT ServerName, wait_type AS WaitType, wait_time_ms AS WaitTimeMs,
        {half_up("100 * wait_time_ms", "sum(wait_time_ms) OVER (PARTITION BY ServerName)", 1)} AS WaitPct
        FROM raw_wait_stats WHERE wait_type NOT IN ('WAITFOR', 'SLEEP_TASK') AND wait_time_ms > 0
        QUALIFY row_number() OVER (PARTITION BY ServerName ORDER BY wait_time_ms DESC, wait_type) <= 10""",
    lambda f: M.extract_waits(f.raw_wait_stats),
)
simple(
    "extract_top_queries",
    f"""SELECT q.ServerName, t.database_name AS DatabaseName, left(t.text, 500) AS QueryText, execution_count AS ExecCount,
        total_worker_time // 1000 AS TotalCpuMs, total_worker_time // nullif(execution_count, 0) // 1000 AS AvgCpuMs,
        total_elapsed_time // nullif(execution_count, 0) // 1000 AS AvgDurMs,
        total_logical_reads // nullif(execution_count, 0) AS AvgReads, last_execution_time AS LastExec
        FROM raw_query_stats q JOIN raw_statement_texts t ON t.ServerName = q.ServerName AND t.sql_handle = q.sql_handle
        WHERE last_execution_time > {O} - INTERVAL 1 DAY
        QUALIFY row_number() OVER (PARTITION BY q.ServerName ORDER BY total_worker_time DESC, q.sql_handle) <= 10""",
    lambda f: M.extract_top_queries(f.raw_query_stats, f.raw_statement_texts, OR),
)
simple(
    "extract_failed_logins",
    """SELECT ServerName, LogDate AS EventTime, left(LogText, 500) AS Message
       FROM (SELECT * FROM raw_error_log UNION ALL SELECT * FROM raw_error_log_previous)
       WHERE LogText LIKE '%Login failed%' AND LogDate > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 24 HOUR""",
    lambda f: M.extract_failed_logins([f.raw_error_log, f.raw_error_log_previous], "2024-01-20 00:00:00"),
)
simple(
    "extract_logins",
    """SELECT ServerName, login_name AS LoginName, host_name AS HostName, left(program_name, 160) AS ProgramName,
       count(*) AS SessionCount, max(login_time) AS LastLogin FROM raw_sessions WHERE is_user_process GROUP BY 1, 2, 3, 4""",
    lambda f: M.extract_logins(f.raw_sessions),
)

# --------------------------------------------------------- extraction, Redshift

simple(
    "extract_rs_disk",
    """SELECT ServerName, 'cluster' AS VolumeName, CAST(sum(capacity) * 1048576 AS BIGINT) AS TotalBytes,
       CAST(sum(used) * 1048576 AS BIGINT) AS UsedBytes FROM raw_partitions WHERE part_begin = 0 GROUP BY 1""",
    lambda f: X.extract_rs_disk(f.raw_partitions),
)
simple(
    "extract_freshness",
    f"""SELECT i.ServerName, trim(t.name) AS ObjectName, date_diff('second', max(q.endtime), {O}) AS LagSeconds,
        'load_freshness' AS Metric, CAST(NULL AS VARCHAR) AS Detail
        FROM raw_inserts i JOIN raw_rs_queries q ON q.ServerName = i.ServerName AND q.query = i.query
        JOIN raw_rs_tables t ON t.ServerName = i.ServerName AND t.id = i.tbl
        WHERE q.endtime > {O} - INTERVAL 2 DAY GROUP BY i.ServerName, t.name""",
    lambda f: X.extract_freshness(f.raw_inserts, f.raw_rs_queries, f.raw_rs_tables, OR),
)
simple(
    "extract_table_size",
    """SELECT ServerName, 'table' AS ObjectType, concat(trim("schema"), '.', trim("table")) AS ObjectName,
       size * 1048576 AS SizeBytes FROM raw_table_info""",
    lambda f: X.extract_table_size(f.raw_table_info),
)
simple(
    "extract_table_health",
    """SELECT ServerName, concat(trim("schema"), '.', trim("table")) AS TableName, coalesce(unsorted, 0) AS UnsortedPct,
       coalesce(stats_off, 0) AS StatsOffPct, tbl_rows AS TableRows FROM raw_table_info
       WHERE coalesce(unsorted, 0) >= 10 OR coalesce(stats_off, 0) >= 10
       QUALIFY row_number() OVER (PARTITION BY ServerName ORDER BY greatest(coalesce(unsorted, 0), coalesce(stats_off, 0)) DESC,
                                  TableName) <= 100""",
    lambda f: X.extract_table_health(f.raw_table_info),
)
simple(
    "extract_rs_activity",
    """SELECT ServerName, pid AS SessionID, CAST(0 AS BIGINT) AS BlockedBy, trim(status) AS Status,
       CAST(NULL AS VARCHAR) AS WaitType, duration // 1000000 AS DurationSec, trim(db_name) AS DatabaseName,
       trim(user_name) AS LoginName, CAST(NULL AS VARCHAR) AS HostName, CAST(NULL AS VARCHAR) AS ProgramName,
       left(query, 500) AS QueryText FROM raw_recents WHERE trim(status) = 'Running' AND duration > 60000000""",
    lambda f: X.extract_rs_activity(f.raw_recents),
)
simple(
    "extract_rs_vitals",
    " UNION ALL ".join(
        [
            _metric("queued_queries", "count(*)", "raw_wlm WHERE state LIKE 'Queued%'", True),
            _metric("db_connections", "count(*)", "raw_rs_sessions", True),
            _metric("load_errors_24h", "count(*)", f"raw_load_errors WHERE starttime > {E} - INTERVAL 1 DAY", True),
        ]
    ),
    lambda f: X.extract_rs_vitals(f.fx_servers, f.raw_wlm, f.raw_rs_sessions, f.raw_load_errors, EV),
)
simple(
    "extract_table_scan",
    """SELECT s.ServerName, concat(trim(t."schema"), '.', trim(t."table")) AS TableName, max(s.endtime) AS LastScanned
       FROM raw_scans s JOIN raw_table_info t ON t.ServerName = s.ServerName AND t.table_id = s.tbl
       WHERE s.userid > 1 GROUP BY 1, 2""",
    lambda f: X.extract_table_scan(f.raw_scans, f.raw_table_info),
)
simple(
    "extract_spectrum",
    """SELECT ServerName, coalesce(nullif(trim(external_table_name), ''), '(unknown)') AS ExternalTable,
       count(DISTINCT query) AS QueryCount, CAST(sum(s3_scanned_bytes) AS DOUBLE) / 1e12 AS TBScanned
       FROM raw_s3 WHERE starttime > TIMESTAMP '2001-06-01 00:00:00' - INTERVAL 1 DAY GROUP BY 1, 2
       QUALIFY row_number() OVER (PARTITION BY ServerName ORDER BY TBScanned DESC, ExternalTable) <= 50""",
    lambda f: X.extract_spectrum(f.raw_s3, "2001-06-01 00:00:00"),
)
simple(
    "extract_rs_logins",
    """SELECT ServerName, recordtime AS EventTime, left(concat('Failed auth: user=', trim(username), ' from ', trim(remotehost)), 500) AS Message
       FROM raw_connection_log WHERE trim(event) = 'authentication failure'
         AND recordtime > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 1 DAY""",
    lambda f: X.extract_rs_logins(f.raw_connection_log, "2024-01-20 00:00:00"),
)
_COST_DAY = "TIMESTAMP '1999-01-01 00:00:00' - INTERVAL 1 DAY"
simple(
    "extract_query_cost",
    f"""WITH read_bytes AS (
          SELECT ServerName, query, sum(far) AS far, sum(near) AS near FROM (
            SELECT ServerName, query, s3_scanned_bytes AS far, 0 AS near FROM raw_s3 WHERE starttime > {_COST_DAY}
            UNION ALL SELECT ServerName, query, 0, bytes FROM raw_query_scans WHERE starttime > {_COST_DAY} AND userid > 1)
          GROUP BY ALL HAVING sum(far) + sum(near) > 0)
        SELECT ServerName, query AS QueryId,
          (SELECT max(trim(usename)) FROM raw_users u WHERE u.ServerName = q.ServerName AND u.usesysid = q.userid) AS UserName,
          starttime AS StartTime, date_diff('second', starttime, endtime) AS ElapsedSec, {half_up("near", "1048576", 1)} AS ScanMB,
          {half_up("far", "1048576", 1)} AS SpectrumMB, {half_up("far * 5", "1000000000000", 2)} AS EstCostUSD,
          (SELECT left(trim(string_agg(t.text, '' ORDER BY t.sequence)), 500) FROM raw_querytext t
            WHERE t.ServerName = q.ServerName AND t.query = q.query) AS QueryText
        FROM raw_rs_queries q JOIN read_bytes USING (ServerName, query) WHERE starttime > {_COST_DAY} AND userid > 1
        QUALIFY row_number() OVER (PARTITION BY ServerName ORDER BY EstCostUSD DESC, ScanMB DESC, query) <= 200""",
    lambda f: X.extract_query_cost(
        f.raw_s3, f.raw_query_scans, f.raw_rs_queries, f.raw_querytext, f.raw_users, "1999-01-01 00:00:00", n=200
    ),
)
simple(
    "extract_lock_waits",
    f"""WITH waiting AS (
          SELECT ServerName, relation, pid, min({{'since': txn_start, 'who': txn_owner}}) AS me
          FROM raw_transactions WHERE NOT granted GROUP BY ALL HAVING date_diff('minute', min(txn_start), {O}) >= 5
        ), held AS (
          SELECT *, (SELECT min({{'since': h.txn_start, 'pid': h.pid, 'who': h.txn_owner, 'mode': h.lock_mode}}) FROM raw_transactions h
            WHERE h.granted AND h.ServerName = x.ServerName AND h.relation = x.relation AND h.pid <> x.pid) AS it FROM waiting x
        )
        SELECT ServerName, pid AS WaiterPid, trim(me.who) AS WaiterUser,
          coalesce((SELECT max(trim(relname)) FROM raw_classes k WHERE k.ServerName = held.ServerName AND k.oid = held.relation),
                   CAST(relation AS VARCHAR)) AS Relation, date_diff('minute', me.since, {O}) AS WaitMinutes,
          (SELECT left(trim(max(query)), 500) FROM raw_lock_recents r WHERE trim(r.status) = 'Running'
            AND r.ServerName = held.ServerName AND r.pid = held.pid) AS WaiterQuery,
          it.pid AS BlockerPid, trim(it.who) AS BlockerUser, trim(it.mode) AS BlockerLockMode,
          CAST(NOT EXISTS (SELECT 1 FROM raw_inflight i WHERE i.ServerName = held.ServerName AND i.pid = held.it.pid) AS BIGINT)
            AS BlockerIdleInTxn,
          (SELECT left(trim(max(text)), 500) FROM raw_inflight i WHERE i.ServerName = held.ServerName AND i.pid = held.it.pid)
            AS BlockerQuery,
          (SELECT count(*) FROM raw_conflicts c WHERE c.ServerName = held.ServerName AND c.table_id = held.relation
            AND c.xact_start_ts > {O} - INTERVAL 1 DAY) AS ConflictCount24h
        FROM held WHERE it IS NOT NULL""",
    lambda f: X.extract_lock_waits(
        f.raw_transactions, f.raw_classes, f.raw_lock_recents, f.raw_inflight, f.raw_conflicts, OR
    ),
)


def _driver(name: str, value: str, source: str, unit: str, zero: bool = True) -> str:
    shown = "coalesce(x.v, 0)" if zero else "x.v"
    return f"""SELECT s.ServerName, '{name}' AS MetricName, CAST({shown} AS DOUBLE) AS MetricValue, '{unit}' AS MetricUnit
FROM fx_servers s LEFT JOIN (SELECT ServerName, {value} AS v FROM {source} GROUP BY 1) x ON x.ServerName = s.ServerName
{"" if zero else "WHERE x.v IS NOT NULL"}"""


_DRIVER_DAY = "TIMESTAMP '2001-06-01 00:00:00' - INTERVAL 1 DAY"
simple(
    "extract_cost_drivers",
    " UNION ALL ".join(
        [
            _driver("spectrum_tb_1d", half_up("sum(s3_scanned_bytes)", "1000000000000", 4), f"raw_s3 WHERE starttime > {_DRIVER_DAY}", "TB"),
            _driver("bytes_scanned_tb_1d", half_up("sum(scan_size_bytes)", "1000000000000", 4), f"raw_query_history WHERE start_time > {_DRIVER_DAY}", "TB"),
            _driver("storage_gb", half_up("sum(used)", "1024", 1), "raw_partitions WHERE part_begin = 0", "GB", False),
            _driver("serverless_rpu_hours_1d", half_up("sum(charged_seconds * compute_capacity)", "3600", 3), f"raw_serverless WHERE end_time > {_DRIVER_DAY}", "RPU-hr"),
        ]
    ),
    lambda f: X.extract_cost_drivers(
        f.fx_servers, f.raw_s3, f.raw_query_history, f.raw_partitions, "2001-06-01 00:00:00", f.raw_serverless
    ),
)

# ------------------------------------------------------------------------ audit

simple(
    "extract_server_info",
    """SELECT ServerName, max(CASE WHEN Property = 'ProductVersion' THEN Value END) AS ProductVersion,
       max(CASE WHEN Property = 'ProductLevel' THEN Value END) AS ProductLevel, CAST(NULL AS VARCHAR) AS ProductUpdateLevel,
       max(CASE WHEN Property = 'Edition' THEN Value END) AS Edition, CAST(NULL AS VARCHAR) AS ProductMajor,
       CAST(NULL AS VARCHAR) AS HostPlatform, CAST(NULL AS VARCHAR) AS OSVersion,
       CAST(max(CASE WHEN Property = 'IsClustered' THEN Value END) AS BOOLEAN) AS IsClustered,
       CAST(NULL AS BOOLEAN) AS IsHadrEnabled,
       CAST(max(CASE WHEN Property = 'StartTime' THEN Value END) AS TIMESTAMP) AS StartTime,
       CAST(max(CASE WHEN Property = 'CpuCount' THEN Value END) AS BIGINT) AS CpuCount, CAST(NULL AS BIGINT) AS PhysicalMemoryMB
       FROM raw_properties GROUP BY ServerName""",
    lambda f: U.extract_server_info(f.raw_properties),
)
_RULES = ", ".join(
    f"('{item}', '{op}', {bound}, '{severity}', '{why}')" for item, op, bound, severity, why in U.CONFIG_RULES
)
_HOLDS = """CASE Op WHEN '=' THEN CurrentValue = Bound WHEN '<>' THEN CurrentValue <> Bound WHEN '>=' THEN CurrentValue >= Bound
            WHEN '<=' THEN CurrentValue <= Bound WHEN '<' THEN CurrentValue < Bound WHEN '>' THEN CurrentValue > Bound END"""
simple(
    "audit_config",
    f"""SELECT ServerName, s.ConfigItem, CAST(CurrentValue AS VARCHAR) AS CurrentValue,
        CASE WHEN Op = '=' THEN CAST(Bound AS VARCHAR) ELSE concat(Op, ' ', Bound) END AS RecommendedValue,
        CASE WHEN {_HOLDS} THEN 'OK' ELSE Severity END AS Status, CASE WHEN NOT {_HOLDS} THEN Why END AS Detail
        FROM raw_settings s JOIN (VALUES {_RULES}) r(ConfigItem, Op, Bound, Severity, Why) ON r.ConfigItem = s.ConfigItem""",
    lambda f: U.audit_config(f.raw_settings, U.config_rules(f.spark)),
)
_HAS = "EXISTS (SELECT 1 FROM raw_role_members m WHERE m.ServerName = p.ServerName AND m.PrincipalName = p.PrincipalName AND m.RoleName {})"
simple(
    "classify_principals",
    f"""SELECT p.ServerName, p.PrincipalName, p.IsDisabled,
        CASE WHEN p.IsDisabled THEN 'Disabled' WHEN {_HAS.format("= 'sysadmin'")} THEN 'Sysadmin'
             WHEN {_HAS.format("= 'securityadmin'")} THEN 'Security admin' WHEN {_HAS.format("= 'dbcreator'")} THEN 'Elevated'
             WHEN {_HAS.format("<> 'public'")} THEN 'Standard' ELSE 'Connect-only' END AS AccessType,
        (SELECT string_agg(RoleName, ',' ORDER BY RoleName) FROM (SELECT DISTINCT RoleName FROM raw_role_members m
         WHERE m.ServerName = p.ServerName AND m.PrincipalName = p.PrincipalName AND RoleName <> 'public')) AS ServerRoles
        FROM fx_principal p""",
    lambda f: U.classify_principals(f.fx_principal, f.raw_role_members),
)
simple(
    "extract_index_health",
    """SELECT ServerName, DatabaseName, 'missing' AS Kind, ObjectName, CAST(NULL AS VARCHAR) AS IndexName,
       concat('impact ', CAST(trunc(Impact) AS BIGINT)) AS Metric,
       concat('Consider an index on ', ObjectName, ' (', Columns, ')') AS Recommendation
       FROM (SELECT * FROM raw_missing_index WHERE Impact >= 1000 QUALIFY row_number() OVER
             (PARTITION BY ServerName ORDER BY Impact DESC, DatabaseName, ObjectName) <= 50)
       UNION ALL SELECT ServerName, DatabaseName, 'unused', ObjectName, IndexName, concat('reads 0 / writes ', Writes),
       concat('Consider dropping ', IndexName) FROM raw_index_usage WHERE Reads = 0 AND Writes > 0
       UNION ALL SELECT ServerName, DatabaseName, 'fragmented', ObjectName, IndexName,
       concat(CAST(trunc(FragmentationPct) AS BIGINT), '% of ', Pages, ' pages'),
       concat(CASE WHEN FragmentationPct >= 60 THEN 'Rebuild ' ELSE 'Reorganize ' END, IndexName)
       FROM raw_index_physical WHERE FragmentationPct >= 30 AND Pages >= 1000""",
    lambda f: U.extract_index_health(f.raw_missing_index, f.raw_index_usage, f.raw_index_physical),
)
simple(
    "extract_file_io",
    f"""SELECT ServerName, DatabaseName, FileType, {half_up("io_stall_read_ms", "nullif(num_of_reads, 0)", 1)} AS ReadLatencyMs,
        {half_up("io_stall_write_ms", "nullif(num_of_writes, 0)", 1)} AS WriteLatencyMs,
        {half_up("(io_stall_read_ms + io_stall_write_ms)", "nullif(num_of_reads + num_of_writes, 0)", 1)} AS AvgLatencyMs,
        size_on_disk_bytes // 1048576 AS SizeMB, num_of_bytes_read // 1048576 AS TotalReadMB,
        num_of_bytes_written // 1048576 AS TotalWriteMB FROM raw_file_io""",
    lambda f: U.extract_file_io(f.raw_file_io),
)
simple(
    "extract_autogrowth",
    f"""SELECT ServerName, StartTime AS EventTime, DatabaseName, CASE EventClass WHEN 93 THEN 'LOG' ELSE 'ROWS' END AS FileType,
        {half_up("IntegerData", "128", 1)} AS GrowthMB, Duration // 1000 AS DurationMs FROM raw_trace WHERE EventClass IN (92, 93)""",
    lambda f: U.extract_autogrowth(f.raw_trace),
)

# ------------------------------------------------------- retention, compaction

simple(
    "retain_evidence",
    f"SELECT * FROM fx_health_metric WHERE CollectedAt >= {E} - INTERVAL 7 DAY",
    lambda f: retention.retain_rows(f.fx_health_metric, "HealthMetric", EV, days=7),
)
simple(
    "retain_collection_log",
    f"SELECT * FROM fx_collection_log WHERE RunAt >= {E} - INTERVAL 7 DAY",
    lambda f: retention.retain({"CollectionLog": f.fx_collection_log}, EV, days=7)["CollectionLog"],
)
simple(
    "retain_findings",
    f"SELECT * FROM v_prev_findings WHERE NOT Resolved OR ResolvedAt >= {E} - INTERVAL 12 HOUR",
    lambda f: retention.retain_rows(prev_findings(f), "Finding", EV, days=0.5),
)
for _table, _keys in [
    ("fx_autogrowth", "ServerName, EventTime, DatabaseName, FileType"),
    ("fx_failed_login", "ServerName, EventTime, Message"),
    ("fx_job_failure", "ServerName, JobName, StepName, RunAt"),
]:
    _series = {"fx_autogrowth": "AutoGrowth", "fx_failed_login": "FailedLogin", "fx_job_failure": "JobFailure"}[_table]
    simple(
        f"compact_{_table[3:]}",
        f"SELECT * FROM {_table} QUALIFY row_number() OVER (PARTITION BY {_keys} ORDER BY SnapshotID DESC) = 1",
        lambda f, t=_table, s=_series: retention.compact(getattr(f, t), s, "SnapshotID"),
    )
simple(
    "compact_table_scan",
    """SELECT * FROM fx_table_scan QUALIFY row_number() OVER
       (PARTITION BY ServerName, TableName, CAST(LastScanned AS DATE) ORDER BY CollectedAt DESC) = 1""",
    lambda f: retention.compact(f.fx_table_scan, "TableScan"),
)

# --------------------------------------------------------------------- measures

simple(
    "measure_fleet",
    """SELECT (SELECT count(*) FROM v_disk WHERE Severity <> 'OK') AS DisksAtRisk,
       (SELECT max(LagSeconds) / 60 FROM v_lag) AS WorstLagMin,
       (SELECT count(*) FILTER (WHERE Status = 'OK') / nullif(count(*), 0) FROM v_ag) AS AGHealthShare""",
    lambda f: measures.fleet_measures(disk(f), lag(f), ag(f)),
)


def growth(f: Fixtures) -> DataFrame:
    return reports.growth_daily(f.fx_object_size)


_SIZES = f"""
SELECT Platform, ServerName, ObjectName, count(*) AS Points,
       {half_up("arg_max(SizeBytes, CollectedAt)", str(GIB), 3)} AS LastGB,
       round({half_up("arg_max(SizeBytes, CollectedAt)", str(GIB), 3)} - {half_up("arg_min(SizeBytes, CollectedAt)", str(GIB), 3)}, 3) AS ChangeGB
FROM fx_object_size GROUP BY 1, 2, 3"""
simple("measure_growth_summary", _SIZES, lambda f: measures.growth_summary(growth(f)))
simple(
    "growth_series",
    "SELECT Day, SizeGB FROM v_growth_daily WHERE Platform = 'Redshift' AND ServerName = 'srv12' AND ObjectName = 'public.t3'",
    lambda f: measures.growth_series(growth(f), "Redshift", "srv12", "public.t3"),
)
simple(
    "cost_series",
    "SELECT Day, Value, MetricUnit FROM v_cost_trend WHERE ServerName = 'srv2' AND MetricName = 'view'",
    lambda f: measures.cost_series(reports.cost_trend(f.fx_redshift_cost), "srv2", "view"),
)
simple(
    "cost_keys",
    "SELECT DISTINCT ServerName, MetricName, MetricUnit FROM v_cost_trend",
    lambda f: measures.cost_keys(reports.cost_trend(f.fx_redshift_cost)),
)
simple(
    "servers_with_owners",
    """SELECT s.ServerID, s.ServerName, s.Platform, s.IsActive, o.AppName AS FirstApp, o.PrimaryOwner AS FirstOwner,
       coalesce((SELECT nullif(count(*), 0) - 1 FROM fx_app_owners a WHERE a.ServerName = s.ServerName), 0) AS MoreOwners
       FROM fx_servers s LEFT JOIN (SELECT * FROM fx_app_owners QUALIFY row_number() OVER
         (PARTITION BY ServerName ORDER BY Criticality NULLS FIRST, AppName, AppOwnerID) = 1) o ON o.ServerName = s.ServerName""",
    lambda f: measures.servers_with_owners(
        f.fx_servers.select("ServerID", "ServerName", "Platform", "IsActive"), f.fx_app_owners
    ),
)
simple(
    "measure_kpis",
    "SELECT o.*, (SELECT count(*) FROM v_active) AS ActiveAlerts FROM v_overview o",
    lambda f: measures.kpis(overview(f), active(f)),
)

# -------------------------------------------------------------------- streaming


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder where driver and executors both can write: the one the cluster names, or beside the warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("stream_dedup_failed_logins", "SELECT DISTINCT Platform, ServerName, EventTime, Message FROM fx_failed_login")
def _(f):
    """The re-read events as a stream, each passed once."""
    root = scratch(f.spark, "dedup")
    events = f.fx_failed_login.select("Platform", "ServerName", "EventTime", "Message")
    events.repartition(4).write.parquet(f"{root}/landing")
    # one file a trigger: the events meet their repeats in later batches
    stream = f.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/landing")
    unique = stream_dedup(stream, ["Platform", "ServerName", "EventTime", "Message"], delay="60 days")
    writer = unique.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint")
    writer.option("path", f"{root}/out").trigger(availableNow=True).start().awaitTermination()
    return f.spark.read.schema(events.schema).parquet(f"{root}/out")


# ----------------------------------------------------------------------- store


def fresh_store(f: Fixtures, name: str) -> SnapshotStore:
    return SnapshotStore(f.spark, scratch(f.spark, name))


@query(
    "store_append_and_read",
    "SELECT CollectedAt, Platform, ServerName, MetricName, MetricValue, Detail, CAST(CollectedAt AS DATE) AS snapshot_date FROM fx_health_metric",
)
def _(f):
    """Evidence appended in two loads, one of them repeated, read back with its day."""
    store = fresh_store(f, "append")
    rows = f.fx_health_metric.drop("SnapshotID")
    late = F.col("ServerName") > "srv3"
    store.append(rows.filter(late), "HealthMetric", load="b")
    store.append(rows.filter(~late), "HealthMetric", load="a")
    store.append(rows.filter(~late), "HealthMetric", load="a")
    return store.read("HealthMetric")


@query(
    "load_sources_log",
    f"""SELECT {E} AS RunAt, 'fleet' AS Collector, ServerName, 'OK' AS Status, count(*) AS RowsLoaded, 'HealthMetric' AS Message
        FROM fx_health_metric GROUP BY ServerName
        UNION ALL SELECT {E}, 'fleet', 'unreachable', 'ERROR', 0, 'DataLag: no route to source'""",
)
def _(f):
    """The outcome per server of a source that works and one that does not."""

    def broken():
        raise OSError("no route to source")

    store = fresh_store(f, "load")
    sources = {"DataLag": broken, "HealthMetric": lambda: f.fx_health_metric.drop("SnapshotID")}
    load_sources(store, sources, EV, servers={"DataLag": ["unreachable"]})
    return store.read("CollectionLog").drop("snapshot_date")


@query("read_landed_json", "SELECT Platform, ServerName, EventTime, Message FROM fx_failed_login")
def _(f):
    """Evidence landed as JSON lines, read with its schema."""
    path = scratch(f.spark, "landed")
    events = f.fx_failed_login.select("Platform", "ServerName", "EventTime", "Message")
    events.write.json(path)
    return read_evidence(f.spark, "json", path, schema=events.schema)


def land_logs(f: Fixtures, frame: DataFrame, line, name: str) -> str:
    """One line of text per row, in folders by server."""
    path = scratch(f.spark, name)
    lines = frame.select("ServerName", line.alias("value")).repartition("ServerName")
    lines.write.partitionBy("ServerName").text(path)
    return path


def as_log_line() -> Column:
    return F.concat_ws(" ", F.date_format("LogDate", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("Logon      "), F.col("LogText"))


@query("read_landed_error_log", "SELECT ServerName, LogDate, 'Logon' AS Process, LogText FROM raw_error_log")
def _(f):
    """Error logs landed as text, read by splits of their files."""
    return read_logs(f.spark, land_logs(f, f.raw_error_log, as_log_line(), "error-log"), splitBytes=1 << 20)


@query("stream_landed_error_log", "SELECT ServerName, LogDate, 'Logon' AS Process, LogText FROM raw_error_log_previous")
def _(f):
    """Error logs landed as text, as a stream with offsets, started twice over one checkpoint."""
    root, landed = scratch(f.spark, "log-stream"), land_logs(f, f.raw_error_log_previous, as_log_line(), "error-log")
    for _ in range(2):
        stream = stream_logs(f.spark, landed, settleSeconds=0)
        writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint")
        writer.option("path", f"{root}/out").trigger(availableNow=True).start().awaitTermination()
    return f.spark.read.schema(stream.schema).parquet(f"{root}/out")


@query(
    "read_landed_ring_buffer",
    """SELECT ServerName, ring_buffer_type, count(*) AS Records, max(CAST(regexp_extract(record, 'time="([0-9]+)"', 1) AS BIGINT)) AS Newest
       FROM raw_ring_buffer GROUP BY 1, 2""",
)
def _(f):
    """Ring-buffer records landed as XML text: how many of each type and the newest time."""
    record = F.concat(F.lit('<Record type="'), F.col("ring_buffer_type"), F.lit('"'), F.expr("substring(record, 8)"))
    rows = read_logs(f.spark, land_logs(f, f.raw_ring_buffer, record, "ring-buffer"), "ringbuffer")
    newest = F.max(F.regexp_extract("record", 'time="([0-9]+)"', 1).cast("bigint"))
    return rows.groupBy("ServerName", "ring_buffer_type").agg(F.count(F.lit(1)).alias("Records"), newest.alias("Newest"))


STORED_VITALS = """(SELECT * FROM fx_health_metric QUALIFY row_number() OVER (PARTITION BY Platform, ServerName, MetricName
    ORDER BY CollectedAt DESC, MetricValue DESC NULLS LAST, Detail DESC NULLS LAST) = 1)"""
CYCLE_ALERTS = f"""WITH stored AS (
  SELECT *, {threshold_case()} AS Status FROM {STORED_VITALS}
), raised AS (
  {PIECES["v_a_vitals"].replace("v_vitals", "stored")}
), one AS (
  SELECT * FROM raised QUALIFY row_number() OVER
    (PARTITION BY AlertKey ORDER BY CASE Severity WHEN 'CRIT' THEN 0 WHEN 'WARN' THEN 1 ELSE 2 END, Message) = 1
)"""


@query(
    "cycle_alerts",
    f"""{CYCLE_ALERTS} SELECT AlertKey, Category, Severity, ServerName, Message, {E} AS FirstSeen, {E} AS LastSeen,
        CAST(NULL AS TIMESTAMP) AS NotifiedAt, false AS Resolved, CAST(NULL AS TIMESTAMP) AS ResolvedAt FROM one""",
)
def _(f):
    """The alerts a first cycle leaves in a store that holds the vitals."""
    store = fresh_store(f, "cycle")
    store.append(f.fx_health_metric.drop("SnapshotID"), "HealthMetric")
    run_cycle(store, EV)
    return store.read_state("AlertHistory")


@query(
    "stream_cycle_alerts",
    f"{CYCLE_ALERTS} SELECT AlertKey, Severity, ServerName, Message FROM one",
)
def _(f):
    """The open alerts after the vitals arrived as a stream, in two micro-batches."""
    root = scratch(f.spark, "stream")
    f.fx_health_metric.drop("SnapshotID").repartition(2, "MetricName", "ServerName").write.parquet(f"{root}/landing")
    store = SnapshotStore(f.spark, f"{root}/store")
    run = stream_cycle(
        f.spark, {"HealthMetric": f"{root}/landing"}, store, f"{root}/checkpoint", as_of=EV, maxFilesPerTrigger=1
    )
    run.awaitTermination()
    return store.read_state("AlertHistory").filter("NOT Resolved").select("AlertKey", "Severity", "ServerName", "Message")


@query(
    "contract_instance_vitals",
    f"""SELECT Platform, ServerName, MetricName, MetricValue, Detail, CollectedAt, Status, row_number() OVER
        (PARTITION BY ServerName ORDER BY CASE Status WHEN 'CRIT' THEN 0 WHEN 'WARN' THEN 1 ELSE 2 END, MetricName) AS Position
        FROM (SELECT *, {threshold_case()} AS Status FROM {STORED_VITALS}) WHERE Platform = 'MSSQL'""",
)
def _(f):
    """A report of the contract over a store: filtered, and in its order."""
    store = fresh_store(f, "contract")
    store.append(f.fx_health_metric.drop("SnapshotID"), "HealthMetric")
    return placed(Reports(store, EV).report("InstanceVitals", Platform="MSSQL"))


@query(
    "store_compaction",
    """SELECT CollectedAt, ServerName, JobName, StepName, RunAt, Message FROM fx_job_failure QUALIFY row_number() OVER
       (PARTITION BY ServerName, JobName, StepName, RunAt ORDER BY CollectedAt DESC, Message DESC) = 1""",
)
def _(f):
    """Job failures read again on later days, collapsed in the store however far apart."""
    store = fresh_store(f, "compact")
    rows = f.fx_job_failure.select(*TABLES["JobFailure"])
    store.append(rows, "JobFailure")
    store.append(rows.withColumn("CollectedAt", F.col("CollectedAt") - F.expr("INTERVAL 5 DAY")), "JobFailure")
    apply_compaction(store)
    return store.read("JobFailure").drop("snapshot_date")


@query("store_live_rows", "SELECT CollectedAt, Platform, ServerName, MetricName, MetricValue, Detail FROM fx_health_metric")
def _(f):
    """A series after merges, a load that came again after its merge, a late load, and a writer that died before it committed."""
    store = fresh_store(f, "live")
    rows = f.fx_health_metric.drop("SnapshotID")
    part = F.pmod(F.xxhash64("ServerName", "CollectedAt"), F.lit(4))
    for i in range(3):
        store.append(rows.filter(part == i), "HealthMetric", load=f"part-{i}")
    merge_loads(store, EV)
    store.append(rows.filter(part == 1), "HealthMetric", load="part-1")
    died = rows.limit(9).withColumn("snapshot_date", F.to_date("CollectedAt"))
    died.write.partitionBy("snapshot_date").parquet(f"{store.series_path('HealthMetric')}/load=died")
    store.append(rows.filter(part == 3), "HealthMetric")
    merge_loads(store, EV)
    return store.read("HealthMetric").drop("snapshot_date")


def in_loads(f: Fixtures, name: str, rows: DataFrame, table: str) -> SnapshotStore:
    """A store whose newest state was folded between loads: the first folded and merged, one late, one repeated, the last not folded."""
    store = fresh_store(f, name)
    part = F.pmod(F.xxhash64("ServerName", F.to_date("CollectedAt")), F.lit(3))
    for i in (1, 0):
        store.append(rows.filter(part == i), table, load=f"part-{i}")
        fold(store, table)
    merge_loads(store, EV)
    store.append(rows.filter(part == 1), table, load="part-1")
    store.append(rows.filter(part == 2), table)
    return store


@query(
    "newest_state_vitals",
    f"""SELECT Platform, ServerName, MetricName, MetricValue, Detail, CollectedAt, {threshold_case()} AS Status FROM {STORED_VITALS}""",
)
def _(f):
    """The newest vitals from a state folded forward load by load."""
    store = in_loads(f, "newest", f.fx_health_metric.drop("SnapshotID"), "HealthMetric")
    return reports.instance_vitals(newest(store, "HealthMetric"))


@query("newest_state_wait_delta", "SELECT ServerName, WaitType, DeltaMs, CollectedAt, WaitPct FROM v_wait_delta")
def _(f):
    """Counter growth between the two newest cycles, whose times a state keeps."""
    store = in_loads(f, "cycles", f.fx_wait_stats, "WaitStats")
    return reports.wait_delta(newest(store, "WaitStats"))


@query(
    "job_failures_with_vitals",
    """SELECT j.SnapshotID, j.ServerName, j.JobName, j.RunAt, v.s.t AS VitalAt, v.s.v AS VitalValue, v.s.m AS VitalName
       FROM fx_job_failure j LEFT JOIN LATERAL (
         SELECT max({'t': h.CollectedAt, 'v': h.MetricValue, 'm': h.MetricName}) AS s FROM fx_health_metric h
         WHERE h.ServerName = j.ServerName AND h.CollectedAt <= j.RunAt
       ) v ON true""",
)
def _(f):
    """Each failed job with what was said last of its server before it ran."""
    vitals = f.fx_health_metric.select("ServerName", "CollectedAt", F.col("MetricValue").alias("Value"), F.col("MetricName").alias("Name"))
    vitals = vitals.withColumn("At", F.col("CollectedAt"))
    jobs = f.fx_job_failure.select("SnapshotID", "ServerName", "JobName", "RunAt")
    return as_of_join(jobs, vitals, ["ServerName"], values=["At", "Value", "Name"], tie=["Value", "Name"], prefix="Vital")


@query(
    "merged_daily_growth",
    f"""SELECT Platform, ServerName, VolumeName, count(UsedBytes) AS Samples, round(avg(UsedBytes::DOUBLE) / {GIB}, 6) AS MeanGB,
        round(CASE WHEN isfinite(slope) THEN slope END / {GIB}, 6) AS GrowthGBPerDay
        FROM (SELECT *, regr_slope(UsedBytes::DOUBLE, epoch(CollectedAt - {O}) / 86400.0) OVER (PARTITION BY Platform, ServerName, VolumeName) AS slope
              FROM fx_disk_usage WHERE CollectedAt <= {O}) GROUP BY Platform, ServerName, VolumeName, slope""",
)
def _(f):
    """Growth of each volume over its whole history, merged from daily summaries."""
    usage = f.fx_disk_usage.filter(F.col("CollectedAt") <= ts_lit(OR)).withColumn("UsedPct", used_pct())
    volumes = merged(daily_summaries(usage), *VOLUME)
    slope = F.when((F.col("s.n") > 1) & (F.col("s.cxx") > 0), F.col("s.cxy") / F.col("s.cxx"))
    out = volumes.select(*VOLUME, F.col("s.n").cast("long").alias("Samples"), (F.col("s.my") / GIB).alias("MeanGB"), (slope / GIB).alias("GrowthGBPerDay"))
    return rounded(out, "MeanGB", "GrowthGBPerDay")


@query(
    "distinct_queries_by_sketch",
    """SELECT ServerName, coalesce(nullif(trim(external_table_name), ''), '(unknown)') AS ExternalTable, count(DISTINCT query) AS QueryCount,
       CAST(sum(s3_scanned_bytes) AS DOUBLE) / 1e12 AS TBScanned, true AS WithinError
       FROM raw_s3 WHERE starttime IS NOT NULL GROUP BY 1, 2""",
)
def _(f):
    """Distinct queries of all days, counted exactly and held against sketches stored in two loads, one of them repeated, and united."""
    store = fresh_store(f, "sketches")
    even = F.coalesce(F.col("query") % 2 == 0, F.lit(True))
    for load, rows in (("a", f.raw_s3.where(even)), ("b", f.raw_s3.where(~even)), ("a", f.raw_s3.where(even))):
        keep_sketches(store, rows, load)
    merge_sketches(store)
    scans = f.raw_s3.where("starttime IS NOT NULL").withColumn(
        "ExternalTable", F.coalesce(F.nullif(F.trim("external_table_name"), F.lit("")), F.lit("(unknown)"))
    )
    exact = scans.groupBy(*SCANNED).agg(F.countDistinct("query").alias("QueryCount"))
    told = united(stored_sketches(store), *SCANNED).withColumn("_told", F.hll_sketch_estimate("Queries"))
    off = F.abs(F.col("_told") - F.col("QueryCount"))
    return exact.join(told, SCANNED).select(
        *SCANNED, "QueryCount", (F.col("Bytes").cast("double") / F.lit(1e12)).alias("TBScanned"),
        (off <= F.greatest(F.lit(1.0), F.col("QueryCount") * (4 * STANDARD_ERROR))).alias("WithinError"),
    )


WEEKLY = """SELECT date_trunc('week', CollectedAt)::TIMESTAMP AS Tick, concat(ServerName, '|', MetricName) AS AlertKey, MetricName AS Category,
       CASE WHEN max(MetricValue) >= 80 THEN 'CRIT' ELSE 'WARN' END AS Severity, ServerName, concat(count(*), ' rows') AS Message
FROM fx_health_metric GROUP BY 1, MetricName, ServerName HAVING max(MetricValue) >= 40 AND count(*) % 3 > 0"""


@query(
    "alert_life_stream",
    f"""WITH seen AS ({WEEKLY}), weeks AS (
          SELECT Tick, row_number() OVER (ORDER BY Tick) AS i, lead(Tick) OVER (ORDER BY Tick) AS Following
          FROM (SELECT DISTINCT date_trunc('week', CollectedAt)::TIMESTAMP AS Tick FROM fx_health_metric)
        ), runs AS (
          SELECT seen.*, i, Following, i - row_number() OVER (PARTITION BY AlertKey ORDER BY i) AS run FROM seen JOIN weeks USING (Tick)
        )
        SELECT AlertKey, arg_min(Category, i) AS Category, arg_max(Severity, i) AS Severity, arg_min(ServerName, i) AS ServerName,
          arg_max(Message, i) AS Message, min(Tick) AS FirstSeen, max(Tick) AS LastSeen, bool_and(Following IS NOT NULL) AS Resolved,
          CASE WHEN bool_and(Following IS NOT NULL) THEN max(Following) END AS ResolvedAt
        FROM runs GROUP BY AlertKey, run""",
)
def _(f):
    """The alerts that weekly evaluations of the vitals open, refresh and close, as keyed state of a stream."""
    root = scratch(f.spark, "alert-life")
    at = F.date_trunc("week", "CollectedAt").cast("timestamp_ntz")
    rows = f.fx_health_metric.withColumn("At", at)
    worst = rows.groupBy("At", "MetricName", "ServerName").agg(F.max("MetricValue").alias("v"), F.count(F.lit(1)).alias("n"))
    seen = worst.filter("v >= 40 AND n % 3 > 0").select(
        "At", F.concat_ws("|", "ServerName", "MetricName").alias("AlertKey"), F.col("MetricName").alias("Category"),
        F.when(F.col("v") >= 80, "CRIT").otherwise("WARN").alias("Severity"), "ServerName", F.concat("n", F.lit(" rows")).alias("Message"),
    )
    marks = rows.select("At").distinct()
    ends = marks.agg(F.max("At").alias("At"))  # what closed last is told with the batch after
    nothing = [F.lit(None).cast("string").alias(c) for c in ("AlertKey", "Category", "Severity", "ServerName", "Message")]
    found = seen.unionByName(marks.select("At", *nothing)).unionByName(ends.select(F.col("At") + F.expr("INTERVAL 1 SECOND"), *nothing).toDF(*seen.columns))
    weeks = [r[0] for r in found.select("At").distinct().orderBy("At").collect()]  # weeks of the calendar
    for week in weeks:  # one file an evaluation, in their order
        found.filter(F.col("At") == F.lit(week)).coalesce(1).write.mode("append").parquet(f"{root}/landing")
    source = f.spark.readStream.schema(found.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/landing")
    stream_alerts(f.spark, source, f"{root}/out", f"{root}/checkpoint", partitions=4).awaitTermination()
    table = alert_table(f.spark.read.parquet(f"{root}/out"))
    # the last mark closes nothing that the weeks themselves have not closed
    open_ = F.col("ResolvedAt").isNull() | (F.col("ResolvedAt") > F.lit(weeks[-2]))
    return table.select(
        "AlertKey", "Category", "Severity", "ServerName", "Message", "FirstSeen", "LastSeen", (F.col("Resolved") & ~open_).alias("Resolved"),
        F.when(~open_, F.col("ResolvedAt")).alias("ResolvedAt"),
    )


#: report: its rows in SQL, and the keys of its order: - descending, ! by severity, @ by access class, # a number
LISTED = {
    "AGSyncStatus": ("v_ag", ["-Status", "AGName", "DatabaseName"]),
    "DataLag": ("v_lag", ["!Status", "-#LagSeconds"]),
    "DiskForecast": ("v_disk", ["!Severity", "#DaysToFull"]),
    "AppOwners": ("fx_app_owners", ["Criticality", "ServerName", "AppName"]),
    "GrowthKeys": ("v_growth_keys", ["-#GrowthGBPerDay"]),
    "GrowthDaily": ("v_growth_daily", ["Platform", "ServerName", "ObjectName", "Day"]),
    "CostTrend": ("v_cost_trend", ["ServerName", "MetricName", "Day"]),
    "BackupHealth": ("v_backup", ["!Status", "ServerName", "DatabaseName"]),
    "JobFailures": ("v_jobs", ["-RunAt"]),
    "InstanceVitals": ("v_vitals", ["!Status", "ServerName", "MetricName"]),
    "ActiveQueries": ("v_activity", ["!RowStatus", "-#DurationSec"]),
    "TopWaits": ("v_waits", ["ServerName", "-#WaitTimeMs"]),
    "TableHealth": ("v_tables", ["!Status", "-#UnsortedPct"]),
    "TopQueries": ("v_top_queries", ["-#TotalCpuMs"]),
    "ServerInfo": ("v_server_info", ["ServerName"]),
    "ConfigAudit": ("v_config", ["!Status", "ServerName", "ConfigItem"]),
    "AccessControl": ("v_access", ["ServerName", "@AccessType"]),
    "Principals": ("v_principals", ["ServerName", "@AccessType", "PrincipalName"]),
    "IndexHealth": ("v_indexes", ["ServerName", "Kind", "ObjectName"]),
    "FileIOStats": ("v_files", ["!Status", "-#coalesce(ReadLatencyMs, 0) + coalesce(WriteLatencyMs, 0)"]),
    "WaitDelta": ("v_wait_delta", ["ServerName", "-#DeltaMs"]),
    "AutoGrowthEvents": ("v_autogrowth", ["-EventTime"]),
    "FailedLogins": ("v_failed_logins", ["-EventTime"]),
    "LoginActivity": ("v_logins", ["ServerName", "-#SessionCount"]),
    "StaleTables": ("v_stale", ["!Status", "-#SizeGB"]),
    "SpectrumByTable": ("v_spectrum", ["-#TBScanned"]),
    "CostlyQueries": ("v_costly", ["-#EstCostUSD", "-#ScanGB"]),
    "Servers": ("v_servers", ["-IsActive", "Platform", "ServerName"]),
}


def _key_text(keys: list[str]) -> str:
    """The keys of a row as one text, the same in both engines."""
    parts = []
    for key in keys:
        value = key.lstrip("-!@#")
        shown = f"CAST(round(({value}) * 1000) AS BIGINT)" if "#" in key[:2] else f"({value})"
        parts.append(f"coalesce(CAST({shown} AS STRING), '-')")
    return f"concat({", '|', ".join(parts)})" if len(parts) > 1 else parts[0]


def _order_sql(keys: list[str]) -> str:
    ranks = {"!": "CASE {} WHEN 'CRIT' THEN 0 WHEN 'WARN' THEN 1 ELSE 2 END",
             "@": "CASE {} WHEN 'Sysadmin' THEN 0 WHEN 'Security admin' THEN 1 WHEN 'Elevated' THEN 2 WHEN 'Standard' THEN 3 WHEN 'Connect-only' THEN 4 ELSE 5 END"}
    out = []
    for key in keys:
        value = key.lstrip("-!@#")
        out.append(ranks[key[0]].format(value) if key[0] in ranks else f"({value}) {'DESC NULLS LAST' if key[0] == '-' else 'ASC NULLS FIRST'}")
    return ", ".join(out)


@query(
    "contract_orders",
    " UNION ALL ".join(
        f"SELECT '{name}' AS Report, row_number() OVER (ORDER BY {_order_sql(keys)}) AS Position, {_key_text(keys)} AS Keys FROM {view}"
        for name, (view, keys) in LISTED.items()
    ),
)
def _(f):
    """Every report of the contract in its order: what stands at each position, by the keys of the order."""
    out = None
    for name, (view, keys) in LISTED.items():
        listed = Reports(None, EV)
        listed._built[name] = VIEWED[view](f)
        rows = listed.report(name).select(F.lit(name).alias("Report"), F.expr(_key_text(keys)).alias("Keys"), F.monotonically_increasing_id().alias("_n"))
        out = rows if out is None else out.unionByName(rows)
    at = Window.partitionBy("Report").orderBy("_n")
    return out.select("Report", F.row_number().over(at).alias("Position"), "Keys")
