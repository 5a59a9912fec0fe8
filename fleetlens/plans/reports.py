"""The reporting views: plain functions from evidence frames to report frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import constants as K
from fleetlens.functions.expressions import (
    GIB,
    boundary_diff,
    cat,
    gib,
    nullif,
    severity_rank,
    status,
    threshold_status,
    ts_lit,
    txt,
)
from fleetlens.operators.latest import (
    SNAPSHOT_DATE,
    first_per_key,
    last_cycles,
    latest_cycle,
    latest_row,
)
from fleetlens.operators.ranking import total_per_key
from fleetlens.schemas import ROW_KEYS


def _tie(df: DataFrame, *names):
    """Columns that settle equal times: an identity the source supplies, or else every other column in its order."""
    have = df.columns
    if "SnapshotID" in have:
        return [c for c in ("SnapshotID", *names) if c in have]
    return [c for c in have if c not in ("CollectedAt", SNAPSHOT_DATE)]


def _pick(df: DataFrame, *columns) -> DataFrame:
    """Select columns; those an evidence source lacks are NULL text."""
    have = df.columns
    return df.select(
        *[
            (c if c in have else F.lit(None).cast("string").alias(c)) if isinstance(c, str) else c
            for c in columns
        ]
    )


# ---------------------------------------------------------------- latest row


def ag_sync_status(ag: DataFrame) -> DataFrame:
    healthy = F.col("SyncHealth") == "HEALTHY"
    rules = [
        ("OK", healthy & F.col("SyncState").isin("SYNCHRONIZED", "SYNCHRONIZING")),
        ("WARN", F.col("SyncHealth") == "PARTIALLY_HEALTHY"),
    ]
    rows = latest_row(ag, ROW_KEYS["AGSyncStatus"], tie=_tie(ag))
    return _pick(
        rows, "AGName", "DatabaseName", "ReplicaServer", "Role", "SyncState", "SyncHealth",
        "LogSendQueueKB", "RedoQueueKB", "LastCommitTime", "CollectedAt",
        status(rules, "CRIT").alias("Status"),
    )


def data_lag(lag: DataFrame) -> DataFrame:
    seconds = F.col("LagSeconds")
    rules = [("WARN", seconds.isNull()), ("OK", seconds <= 60), ("WARN", seconds <= 900)]
    rows = latest_row(lag, ROW_KEYS["DataLag"], tie=_tie(lag))
    minutes = (seconds.cast("decimal(20,0)") / F.lit(60).cast("decimal(2,0)")).cast("decimal(10,1)")
    return _pick(
        rows, "Platform", "ServerName", "ObjectName", "Metric", "LagSeconds", "Detail", "CollectedAt",
        minutes.alias("LagMinutes"), status(rules, "CRIT").alias("Status"),
    )


def backup_health(backups: DataFrame, as_of) -> DataFrame:
    now = ts_lit(as_of)
    full, log, check = F.col("LastFullBackup"), F.col("LastLogBackup"), F.col("LastGoodCheckDb")
    logged = F.col("RecoveryModel").isin(K.LOGGED_RECOVERY_MODELS)
    log_rules = logged & ~F.col("DatabaseName").isin(K.SYSTEM_DATABASES)
    checked = nullif(check, F.lit(K.NEVER_CHECKED).cast("timestamp_ntz"))
    rules = [
        ("CRIT", F.col("StateDesc") != "ONLINE"),
        ("CRIT", full.isNull() | (full < ts_lit(as_of, days=-7))),
        ("CRIT", log_rules & (log.isNull() | (log < ts_lit(as_of, hours=-6)))),
        ("WARN", full < ts_lit(as_of, days=-2)),
        ("WARN", log_rules & (log < ts_lit(as_of, hours=-1))),
        ("WARN", checked.isNull() | (check < ts_lit(as_of, days=-30))),
        ("WARN", F.col("PageVerify") != "CHECKSUM"),
        ("WARN", F.col("IsAutoShrink")),
    ]
    rows = latest_row(backups, ROW_KEYS["BackupStatus"], tie=_tie(backups))
    return _pick(
        rows, "ServerName", "DatabaseName", "RecoveryModel", "StateDesc", "LastFullBackup", "LastDiffBackup",
        "LastLogBackup", "PageVerify", "IsAutoShrink", checked.alias("LastGoodCheckDb"),
        boundary_diff("hour", full, now).alias("HoursSinceFull"),
        F.when(logged, boundary_diff("minute", log, now)).alias("MinsSinceLog"),
        "CollectedAt", status(rules).alias("Status"),
    )


def instance_vitals(metrics: DataFrame, thresholds=K.VITALS_THRESHOLDS) -> DataFrame:
    rows = latest_row(metrics, ROW_KEYS["HealthMetric"], tie=_tie(metrics))
    return _pick(
        rows, "Platform", "ServerName", "MetricName", "MetricValue", "Detail", "CollectedAt",
        threshold_status("MetricName", "MetricValue", thresholds).alias("Status"),
    )


def server_info(info: DataFrame) -> DataFrame:
    rows = latest_row(info, ROW_KEYS["ServerInfo"], tie=_tie(info))
    patch = cat(
        txt("v"),
        "ProductVersion",
        F.concat(F.lit(" · "), "ProductLevel"),
        F.concat(F.lit("-"), nullif("ProductUpdateLevel", "")),
    )
    return _pick(
        rows, "ServerName", "ProductMajor", "ProductVersion", "ProductLevel", "ProductUpdateLevel", "Edition",
        "HostPlatform", "OSVersion", "IsClustered", "IsHadrEnabled", "StartTime", "CpuCount", "PhysicalMemoryMB",
        "CollectedAt", patch.alias("PatchLevel"),
    )


def config_audit(audit: DataFrame) -> DataFrame:
    rows = latest_row(audit, ROW_KEYS["ConfigAudit"], tie=_tie(audit))
    return _pick(
        rows, "ServerName", "ConfigItem", "CurrentValue", "RecommendedValue", "Status", "Detail", "CollectedAt"
    )


def principals(security: DataFrame) -> DataFrame:
    rows = latest_row(security, ROW_KEYS["SecurityPrincipal"], tie=_tie(security))
    return _pick(
        rows, "ServerName", "PrincipalName", "PrincipalType", "AccessType", "ServerRoles", "IsDisabled",
        "CreateDate", "LastModified", "CollectedAt",
    )


def access_control(principals_report: DataFrame) -> DataFrame:
    n = F.col("Principals")
    rules = [
        ("WARN", (F.col("AccessType") == "Sysadmin") & (n > 5)),
        ("WARN", (F.col("AccessType") == "Security admin") & (n > 3)),
    ]
    return (
        principals_report.groupBy("ServerName", "AccessType")
        .agg(F.count(F.lit(1)).alias("Principals"))
        .withColumn("Status", status(rules))
    )


# -------------------------------------------------------------- latest cycle


def active_queries(snapshots: DataFrame, cycles: DataFrame | None = None) -> DataFrame:
    rules = [("CRIT", F.coalesce("BlockedBy", F.lit(0)) != 0), ("WARN", F.col("DurationSec") >= 600)]
    rows = latest_cycle(snapshots, ["Platform", "ServerName"], cycles=cycles)
    return _pick(
        rows, "Platform", "ServerName", "SessionID", "BlockedBy", "Status", "WaitType", "DurationSec",
        "DatabaseName", "LoginName", "HostName", "ProgramName", "QueryText", "CollectedAt",
        status(rules).alias("RowStatus"),
    )


def top_waits(waits: DataFrame, cycles: DataFrame | None = None) -> DataFrame:
    rows = latest_cycle(waits, cycles=cycles)
    return _pick(rows, "ServerName", "WaitType", "WaitTimeMs", "WaitPct", "CollectedAt")


def table_health(tables: DataFrame, cycles: DataFrame | None = None) -> DataFrame:
    def either(bound):
        return (F.col("UnsortedPct") >= bound) | (F.col("StatsOffPct") >= bound)

    rows = latest_cycle(tables, cycles=cycles)
    return _pick(
        rows, "ServerName", "TableName", "UnsortedPct", "StatsOffPct", "TableRows", "CollectedAt",
        status([("CRIT", either(50)), ("WARN", either(20))]).alias("Status"),
    )


def top_queries(queries: DataFrame, cycles: DataFrame | None = None) -> DataFrame:
    rows = latest_cycle(queries, cycles=cycles)
    return _pick(
        rows, "ServerName", "DatabaseName", "QueryText", "ExecCount", "TotalCpuMs", "AvgCpuMs", "AvgDurMs",
        "AvgReads", "LastExec", "CollectedAt",
    )


def login_activity(logins: DataFrame, cycles: DataFrame | None = None) -> DataFrame:
    rows = latest_cycle(logins, cycles=cycles)
    return _pick(
        rows, "ServerName", "LoginName", "HostName", "ProgramName", "SessionCount", "LastLogin", "CollectedAt"
    )


def spectrum_by_table(scans: DataFrame, cycles: DataFrame | None = None) -> DataFrame:
    # exact bytes again: a double times a price can fall on the wrong side of half a cent
    tb = F.col("TBScanned").cast("decimal(28,12)")
    price = F.lit(str(K.EXTERNAL_SCAN_USD_PER_TB)).cast("decimal(2,1)")
    return _pick(
        latest_cycle(scans, cycles=cycles), "ServerName", "ExternalTable", "QueryCount",
        tb.cast("decimal(12,4)").alias("TBScanned"),
        (tb * price).cast("decimal(12,2)").alias("EstCostUSD"), "CollectedAt",
    )


def index_health(indexes: DataFrame, cycles: DataFrame | None = None) -> DataFrame:
    rules = [("WARN", F.col("Kind").isin("missing", "fragmented"))]
    return _pick(
        latest_cycle(indexes, cycles=cycles), "ServerName", "DatabaseName", "Kind", "ObjectName", "IndexName",
        "Metric", "Recommendation", "CollectedAt", status(rules).alias("Status"),
    )


def file_io(files: DataFrame, cycles: DataFrame | None = None) -> DataFrame:
    def either(bound):
        return (F.col("ReadLatencyMs") >= bound) | (F.col("WriteLatencyMs") >= bound)

    return _pick(
        latest_cycle(files, cycles=cycles), "ServerName", "DatabaseName", "FileType", "ReadLatencyMs",
        "WriteLatencyMs", "AvgLatencyMs", "SizeMB", "TotalReadMB", "TotalWriteMB", "CollectedAt",
        status([("CRIT", either(50)), ("WARN", either(20))]).alias("Status"),
    )


def costly_queries(costs: DataFrame, cycles: DataFrame | None = None) -> DataFrame:
    usd = F.col("EstCostUSD")

    def in_gb(c):
        return (F.col(c).cast("decimal(18,1)") / F.lit(1024).cast("decimal(4,0)")).cast("decimal(14,1)")

    rules = [("CRIT", usd >= 10), ("WARN", (usd >= 1) | (F.col("ScanMB") >= 512000))]
    return _pick(
        latest_cycle(costs, cycles=cycles), "ServerName", "QueryId", "UserName", "StartTime", "ElapsedSec",
        in_gb("ScanMB").alias("ScanGB"), in_gb("SpectrumMB").alias("SpectrumGB"), "EstCostUSD", "QueryText",
        "CollectedAt", status(rules).alias("Status"),
    )


def wait_delta(waits: DataFrame) -> DataFrame:
    """Counter growth between the two newest cycles; see :func:`counter_delta`."""
    return counter_delta(waits, "WaitType", "WaitTimeMs").withColumnsRenamed({"Delta": "DeltaMs", "Pct": "WaitPct"})


def counter_delta(counters: DataFrame, name: str, value: str, server: str = "ServerName") -> DataFrame:
    """Growth of a cumulative counter per server between its two newest cycles.

    A counter that fell (a restart) or was not seen before counts in full.
    ``Pct`` is the share of the server's positive growth; rows without growth
    are left out.
    """
    ts = "CollectedAt"
    rows = last_cycles(counters.select(server, ts, name, value), [server], ts)
    before = F.max(F.when(F.col("CycleNo") == 2, F.col(value))).over(Window.partitionBy(server, name))
    grown = (
        rows.withColumn("_before", before)
        .filter(F.col("CycleNo") == 1)
        .withColumn(
            "Delta",
            F.when(F.col("_before").isNull() | (F.col(value) < F.col("_before")), F.col(value)).otherwise(
                F.col(value) - F.col("_before")
            ),
        )
        .filter("Delta > 0")
        .select(server, name, "Delta", ts)
    )
    shared = total_per_key(grown, "Delta", [server])
    pct = (F.col("Delta").cast("decimal(24,0)") * 100 / F.col("_total").cast("decimal(20,0)")).cast("decimal(5,1)")
    return shared.withColumn("Pct", pct).drop("_total")


# ------------------------------------------------------- events read many times


def job_failures(failures: DataFrame, as_of) -> DataFrame:
    return (
        failures.filter(F.col("RunAt").between(ts_lit(as_of, days=-7), ts_lit(as_of)))
        .groupBy("ServerName", "JobName", "StepName", "RunAt")
        .agg(F.max("Message").alias("Message"), F.max("CollectedAt").alias("LastSeen"))
    )


def failed_logins(logins: DataFrame, as_of) -> DataFrame:
    return (
        logins.filter(F.col("EventTime").between(ts_lit(as_of, days=-7), ts_lit(as_of)))
        .groupBy("Platform", "ServerName", "EventTime", "Message")
        .agg(F.max("CollectedAt").alias("LastSeen"))
    )


def autogrowth(events: DataFrame, as_of) -> DataFrame:
    return (
        events.filter(F.col("EventTime").between(ts_lit(as_of, days=-7), ts_lit(as_of)))
        .groupBy("ServerName", "EventTime", "DatabaseName", "FileType")
        .agg(F.max("GrowthMB").alias("GrowthMB"), F.max("DurationMs").alias("DurationMs"))
        .withColumn("Status", status([("WARN", F.col("DurationMs") >= 1000)]))
    )


# --------------------------------------------------------------------- growth


def growth_daily(sizes: DataFrame) -> DataFrame:
    """The last size of each object on each day."""
    keys = ["Platform", "ServerName", "ObjectName", "Day"]
    # hash aggregate first (numbers only); the type of the object is settled on what is left
    daily = (
        sizes.withColumn("Day", F.to_date("CollectedAt"))
        .groupBy(*keys, "ObjectType")
        .agg(F.max("CollectedAt").alias("_at"), F.max_by("SizeBytes", "CollectedAt").alias("SizeBytes"))
    )
    rows = first_per_key(daily, keys, F.desc("_at"), F.desc("ObjectType"))
    return rows.select(
        "Platform", "ServerName", "ObjectType", "ObjectName", "Day", gib("SizeBytes", 18, 3).alias("SizeGB")
    )


def growth_keys(sizes: DataFrame) -> DataFrame:
    """Newest against oldest size of each object."""
    keys = ["Platform", "ServerName", "ObjectName"]
    per_type = sizes.groupBy(*keys, "ObjectType").agg(
        F.max("CollectedAt").alias("_to"),
        F.max_by("SizeBytes", "CollectedAt").alias("_new"),
        F.min("CollectedAt").alias("_from"),
        F.min_by("SizeBytes", "CollectedAt").alias("_old"),
    )
    rows = per_type.groupBy(*keys).agg(
        F.max_by(F.struct("ObjectType", "_new"), F.struct("_to", "ObjectType")).alias("n"),
        F.min_by("_old", F.struct("_from", "ObjectType")).alias("_old"),
        F.max("_to").alias("_to"),
        F.min("_from").alias("_from"),
    )
    days = boundary_diff("day", "_from", "_to")
    delta = F.col("n._new") - F.col("_old")
    per_day = (
        F.when(days > 0, (delta.cast("decimal(20,0)") / F.lit(GIB).cast("decimal(10,0)")) / days.cast("decimal(6,0)"))
        .otherwise(F.lit(0).cast("decimal(1,0)"))
        .cast("decimal(18,3)")
    )
    return rows.select(
        "Platform", "ServerName", F.col("n.ObjectType").alias("ObjectType"), "ObjectName",
        gib("n._new", 18, 2).alias("CurrentGB"), gib(delta, 18, 2).alias("DeltaGB"),
        days.alias("WindowDays"), per_day.alias("GrowthGBPerDay"),
    )




def stale_tables(sizes: DataFrame, scans: DataFrame, as_of) -> DataFrame:
    """Tables that occupy storage but are not read."""
    now = ts_lit(as_of)
    tables = (
        sizes.filter((F.col("Platform") == "Redshift") & (F.col("ObjectType") == "table"))
        .groupBy("ServerName", F.col("ObjectName").alias("TableName"))
        .agg(F.max_by("SizeBytes", "CollectedAt").alias("_size"), F.min("CollectedAt").alias("_first"))
    )
    last = scans.groupBy("ServerName", "TableName").agg(F.max("LastScanned").alias("LastScanned"))
    rows = tables.join(last, ["ServerName", "TableName"], "left")
    idle, watched = boundary_diff("day", "LastScanned", now), boundary_diff("day", "_first", now)
    never = F.col("LastScanned").isNull()
    rules = [("OK", never & (watched < 7)), ("CRIT", never), ("CRIT", idle >= 60), ("WARN", idle >= 30)]
    usd = F.col("_size").cast("decimal(20,0)") * F.lit(str(K.STORAGE_USD_PER_GB_MONTH)).cast("decimal(4,3)")
    return rows.select(
        "ServerName", "TableName", gib("_size", 12, 1).alias("SizeGB"), "LastScanned",
        idle.alias("DaysSinceScan"), watched.alias("MonitoredDays"),
        (usd / F.lit(GIB).cast("decimal(10,0)")).cast("decimal(12,2)").alias("EstMonthlyUSD"),
        status(rules).alias("Status"),
    )


# ---------------------------------------------------------- cost, forecast, state


def disk_forecast_report(forecast: DataFrame) -> DataFrame:
    return forecast.select(
        "Platform", "ServerName", "VolumeName", gib("TotalBytes", 12, 1).alias("TotalGB"),
        gib("UsedBytes", 12, 1).alias("UsedGB"), gib(F.col("TotalBytes") - F.col("UsedBytes"), 12, 1).alias("FreeGB"),
        "UsedPct", gib("GrowthBytesPerDay", 12, 2).alias("GrowthGBPerDay"), "DaysToFull", "ProjectedFullDate",
        "RecommendedAddGB", "Severity", "ComputedAt",
    )


def cost_trend(costs: DataFrame) -> DataFrame:
    """Daily peak of each cost driver."""
    return (
        costs.groupBy("ServerName", "MetricName", "MetricUnit", F.to_date("CollectedAt").alias("Day"))
        .agg(F.max("MetricValue").alias("Value"))
        .withColumn("Value", F.col("Value").cast("decimal(18,3)"))
    )


def cost_anomaly_report(anomalies: DataFrame, as_of, newest: int = 500) -> DataFrame:
    """Anomalies of the last 30 days, the newest 500."""
    cut = F.date_sub(F.to_date(ts_lit(as_of)), 30)
    return (
        anomalies.filter(F.col("ObservedDay") >= cut)
        .orderBy(F.desc("DetectedAt"), F.desc_nulls_last("PctAboveBaseline"), "ServerName", "MetricName", "ObservedDay")
        .limit(newest)
        .select(
            "ServerName", "MetricName", "MetricUnit", "ObservedDay", F.col("Value").cast("decimal(18,3)").alias("Value"),
            F.col("Baseline").cast("decimal(18,3)").alias("Baseline"), "ZScore", "PctAboveBaseline", "Severity",
            "DetectedAt",
        )
    )


def findings_report(findings: DataFrame, as_of) -> DataFrame:
    age = boundary_diff("minute", "FirstSeen", ts_lit(as_of))
    return findings.filter(~F.col("Resolved")).drop("Resolved", "ResolvedAt").withColumn("AgeMinutes", age)


# ------------------------------------------------------------------- inventory


def app_owners(owners: DataFrame) -> DataFrame:
    return _pick(
        owners, "AppOwnerID", "ServerName", "DatabaseName", "AppName", "Criticality", "PrimaryOwner",
        "SecondaryOwner", "Team", "Email", "OnCallPhone", "Notes", "UpdatedBy", "UpdatedAt",
    )


def servers_report(servers: DataFrame, log: DataFrame) -> DataFrame:
    """Inventory with the outcome of each server's last collection."""
    # of one run a failure counts, whatever else worked
    failed = F.coalesce(F.col("Status") != "OK", F.lit(True))
    tie = ["LogID"] if "LogID" in log.columns else ["_failed", "Collector", "Message"]
    named = log.filter("ServerName IS NOT NULL").withColumn("_failed", failed)
    last = latest_row(named, ["ServerName"], ts="RunAt", tie=tie).select(
        "ServerName",
        F.col("RunAt").alias("LastCollectedAt"),
        F.col("Status").alias("LastStatus"),
        F.col("Message").alias("LastMessage"),
    )
    rows = servers.join(last, ["ServerName"], "left")
    return _pick(
        rows, "ServerID", "ServerName", "Platform", "Environment", "FriendlyName", "IsActive", "CreatedAt", "Host",
        "Port", "DatabaseName", "AuthType", "UserName", "HasPassword", "LastCollectedAt", "LastStatus", "LastMessage",
    )


def first_owner(owners: DataFrame) -> DataFrame:
    """Per server the owner of its most critical application."""
    order = [F.asc_nulls_first("Criticality")] + (["AppOwnerID"] if "AppOwnerID" in owners.columns else ["AppName"])
    return first_per_key(owners, ["ServerName"], *order)


def active_alerts(alerts: DataFrame, owners: DataFrame) -> DataFrame:
    """Open alerts routed to the owner of the server's most critical application."""
    who = first_owner(owners).select(
        "ServerName", F.col("PrimaryOwner").alias("Owner"), F.col("Email").alias("OwnerEmail")
    )
    rows = alerts.filter(~F.col("Resolved")).join(who, ["ServerName"], "left")
    return rows.select(
        "AlertKey", "Category", "Severity", "ServerName", "Message", "FirstSeen", "LastSeen", "NotifiedAt", "Owner",
        "OwnerEmail",
    )


# ---------------------------------------------------------------------- rollups


def estate_health(
    servers: DataFrame,
    backup: DataFrame,
    disk: DataFrame,
    jobs: DataFrame,
    ag: DataFrame,
    vitals: DataFrame,
    lag: DataFrame,
    tables: DataFrame,
    as_of,
    as_written: bool = False,
) -> DataFrame:
    """One row per active server, one worst-of status per domain, and the overall worst.

    A domain without rows is ``NA``; with ``as_written`` it is ``OK`` (the
    overall rank is the same either way). Jobs apply to SQL Server only.
    """

    def domain(df, name, rank, server="ServerName"):
        return df.select(F.col(server).alias("ServerName"), F.lit(name).alias("Domain"), rank.alias("Rank"))

    stacked = domain(backup, "Backup", severity_rank("Status"))
    for part in (
        domain(disk, "Disk", severity_rank("Severity")),
        domain(jobs.filter(F.col("RunAt") >= ts_lit(as_of, hours=-24)), "Jobs", F.lit(1)),
        domain(ag, "HA", severity_rank("Status"), "ReplicaServer"),
        domain(vitals, "Perf", severity_rank("Status")),
        domain(lag, "Data", severity_rank("Status")),
        domain(tables, "Data", severity_rank("Status")),
    ):
        stacked = stacked.unionByName(part)
    worst = stacked.groupBy("ServerName").pivot("Domain", K.DOMAINS).agg(F.min("Rank"))
    # one row per server on both sides
    rows = servers.filter("IsActive").join(worst, "ServerName", "left")

    no_rows = "OK" if as_written else "NA"

    def shown(name):
        rank = F.col(name)
        text = F.when(rank == 0, "CRIT").when(rank == 1, "WARN").when(rank.isNotNull(), "OK")
        if name == "Jobs":
            return F.when(F.col("Platform") != "MSSQL", "NA").otherwise(F.coalesce(text, F.lit("OK")))
        return F.coalesce(text, F.lit(no_rows))

    out = rows.select(
        "ServerName", "Environment", "Platform", "FriendlyName", *[shown(d).alias(d) for d in K.DOMAINS]
    ).withColumn("OverallRank", F.least(*[severity_rank(d) for d in K.DOMAINS]))
    return out.withColumn(
        "OverallStatus", F.when(F.col("OverallRank") == 0, "CRIT").when(F.col("OverallRank") == 1, "WARN").otherwise("OK")
    )


def overview(
    servers: DataFrame,
    owners: DataFrame,
    log: DataFrame,
    ag: DataFrame,
    lag: DataFrame,
    disk: DataFrame,
    backup: DataFrame,
    jobs: DataFrame,
    vitals: DataFrame,
    findings: DataFrame,
    config: DataFrame,
    access: DataFrame,
    files: DataFrame,
    as_of,
) -> DataFrame:
    """The one-row header: 17 figures, each input read once.

    The single-row aggregates are stacked and folded, not cross joined.
    """
    active = servers.filter("IsActive")
    unowned = active.join(owners.select("ServerName").distinct(), "ServerName", "left_anti")
    bad = F.col("Status").isin("WARN", "CRIT")

    def n(cond):
        return F.count_if(cond).alias

    parts = [
        active.agg(
            F.count(F.lit(1)).alias("Servers"),
            F.count_if(F.col("Platform") == "MSSQL").alias("MSSQLServers"),
            F.count_if(F.col("Platform") == "Redshift").alias("RedshiftClusters"),
        ),
        ag.agg(F.count(F.lit(1)).alias("AGDatabases"), n(F.col("Status") != "OK")("AGUnhealthy")),
        lag.agg(n(F.col("Status") == "CRIT")("LagObjectsCrit")),
        disk.agg(n(F.col("Severity") == "CRIT")("DisksCrit"), n(F.col("Severity") == "WARN")("DisksWarn")),
        backup.agg(n(F.col("Status") != "OK")("BackupsAtRisk")),
        jobs.agg(n(F.col("RunAt") >= ts_lit(as_of, hours=-24))("JobFailures24h")),
        vitals.filter(F.col("MetricName") == "blocked_sessions").agg(
            F.coalesce(F.sum("MetricValue"), F.lit(0.0)).alias("BlockedSessions")
        ),
        findings.agg(n(~F.col("Resolved"))("OpenFindings")),
        config.agg(n(bad)("ConfigWarnings")),
        access.filter(F.col("AccessType") == "Sysadmin").agg(
            F.coalesce(F.sum("Principals"), F.lit(0)).alias("Sysadmins")
        ),
        files.agg(n(bad)("HighLatencyFiles")),
        unowned.agg(F.count(F.lit(1)).alias("AppsWithoutOwner")),
        log.filter(F.col("Status") == "OK").agg(F.max("RunAt").alias("LastCollection")),
    ]
    names = [c for p in parts for c in p.columns]
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in names])
