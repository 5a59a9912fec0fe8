"""Telemetry-shaped projections of the TPC-H-like test tables.

Each adapter is one SELECT in the SQL subset Spark and DuckDB share; a dialect
fills in what they spell differently. ``{name}`` refers to a test table or to
another adapter.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: evaluation times, one per family of adapters (events, orders, lineitem)
EVENTS_AS_OF = "2024-01-30 23:59:59"
ORDERS_AS_OF = "2001-08-02 00:00:00"
LINEITEM_AS_OF = "2001-11-05 00:00:00"

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations"]


class SparkDialect:
    def second(self, c):
        return f"({c} - make_dt_interval(0, 0, 0, extract(SECOND FROM {c}) % 1))"

    def hour(self, c):
        return f"({c} - make_dt_interval(0, 0, minute({c}), extract(SECOND FROM {c})))"

    def day(self, c):
        return f"CAST(CAST({c} AS DATE) AS TIMESTAMP_NTZ)"

    def each(self, *values):
        return f"explode(array({', '.join(map(str, values))}))"

    def ts(self, text):
        return f"TIMESTAMP_NTZ '{text}'"

    def name(self, identifier):
        return f"`{identifier}`"


class DuckDialect:
    def second(self, c):
        return f"CAST(date_trunc('second', {c}) AS TIMESTAMP)"

    def hour(self, c):
        return f"CAST(date_trunc('hour', {c}) AS TIMESTAMP)"

    def day(self, c):
        return f"CAST(date_trunc('day', {c}) AS TIMESTAMP)"

    def each(self, *values):
        return f"unnest([{', '.join(map(str, values))}])"

    def ts(self, text):
        return f"TIMESTAMP '{text}'"

    def name(self, identifier):
        return f'"{identifier}"'


SPARK, DUCK = SparkDialect(), DuckDialect()


def srv(expr: str) -> str:
    return f"concat('srv', {expr})"


def adapters(d) -> dict[str, str]:
    """Adapter name -> SELECT in dialect ``d``."""
    at = d.second("ts")
    # half of the users sit on instances, clusters are the servers divisible by four
    instance, cluster = srv("user_id % 50"), srv("user_id % 10 * 4")
    by_order, by_query = srv("o_orderkey % 10 * 4"), srv("l_orderkey % 10 * 4")
    by_table = srv("l_partkey % 10 * 4")
    quantity = "CAST(l_quantity AS BIGINT)"
    price = "CAST(round(o_totalprice * 100) AS BIGINT)"
    return {
        # ------------------------------------------------------------ inventory
        "fx_servers": f"""
SELECT s_suppkey AS ServerID, {srv("s_suppkey")} AS ServerName,
       CASE WHEN s_suppkey % 4 = 0 THEN 'Redshift' ELSE 'MSSQL' END AS Platform,
       CASE s_nationkey % 3 WHEN 0 THEN 'PROD' WHEN 1 THEN 'UAT' ELSE 'DEV' END AS Environment,
       s_name AS FriendlyName, s_acctbal > 0 AS IsActive, {d.ts("2001-01-01 00:00:00")} AS CreatedAt,
       CASE WHEN s_suppkey % 8 = 0 THEN concat('host', s_suppkey) END AS Host, CAST(5439 AS INT) AS Port,
       CAST(NULL AS VARCHAR(10)) AS DatabaseName,
       CASE WHEN s_suppkey % 5 = 0 THEN 'sql' ELSE 'windows' END AS AuthType,
       CASE WHEN s_suppkey % 5 = 0 THEN concat('login', s_suppkey) END AS UserName,
       s_nationkey % 2 = 0 AS HasPassword
FROM {{supplier}}""",
        "fx_app_owners": f"""
SELECT c_custkey AS AppOwnerID,
       concat(CASE WHEN c_custkey % 60 % 7 = 3 THEN 'old' ELSE 'srv' END, c_custkey % 60) AS ServerName,
       CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('db', c_nationkey) END AS DatabaseName, c_name AS AppName,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'Tier1' WHEN 'AUTOMOBILE' THEN 'Tier2' WHEN 'MACHINERY' THEN 'Tier3'
            ELSE 'Other' END AS Criticality,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('owner', c_custkey % 11) END AS PrimaryOwner,
       CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE concat('owner', c_custkey % 13) END AS SecondaryOwner,
       c_mktsegment AS Team,
       CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE concat('o', c_custkey % 11, '@example.test') END AS Email,
       concat('+', c_custkey) AS OnCallPhone, CAST(NULL AS VARCHAR(10)) AS Notes, 'seed' AS UpdatedBy,
       {d.ts("2001-01-01 00:00:00")} AS UpdatedAt
FROM {{customer}}""",
        "fx_owner_changes": """
SELECT CASE c_custkey % 3 WHEN 0 THEN c_custkey ELSE 0 END AS AppOwnerID,
       concat(CASE WHEN c_custkey % 60 % 7 = 3 THEN 'old' ELSE 'srv' END, c_custkey % 60) AS ServerName,
       CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('db', c_nationkey) END AS DatabaseName,
       CASE c_custkey % 3 WHEN 2 THEN concat('new ', c_name) ELSE c_name END AS AppName,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'Tier2' WHEN 'MACHINERY' THEN 'Tier1' ELSE 'Gold' END AS Criticality,
       concat('person', c_custkey % 17) AS PrimaryOwner, CAST(NULL AS VARCHAR(10)) AS SecondaryOwner,
       c_mktsegment AS Team, concat('p', c_custkey % 17, '@example.test') AS Email,
       CAST(NULL AS VARCHAR(10)) AS OnCallPhone, 'edited' AS Notes, 'form' AS UpdatedBy
FROM {customer}""",
        "fx_server_changes": f"""
SELECT concat(CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE 'srv' END, s_suppkey) AS ServerName,
       CASE s_suppkey % 4 WHEN 0 THEN 'Redshift' WHEN 1 THEN 'Oracle' ELSE 'MSSQL' END AS Platform,
       'UAT' AS Environment, CASE WHEN s_suppkey % 2 = 0 THEN concat('edited ', s_name) END AS FriendlyName,
       s_acctbal > 5000 AS IsActive, concat('h', s_suppkey) AS Host, CAST(1433 AS INT) AS Port,
       CASE s_suppkey % 3 WHEN 1 THEN 'sql' WHEN 2 THEN 'kerberos' ELSE 'windows' END AS AuthType,
       concat('u', s_suppkey) AS UserName, s_suppkey % 7 = 0 AS HasPassword
FROM {{supplier}}""",
        "fx_contacted": """
SELECT concat(CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE 'srv' END, s_suppkey) AS ServerName,
       CASE WHEN s_suppkey % 4 = 0 THEN 'Redshift' ELSE 'MSSQL' END AS Platform, 'PROD' AS Environment,
       CASE WHEN s_suppkey % 2 = 0 THEN concat('contact ', s_suppkey) END AS FriendlyName
FROM {supplier}""",
        "raw_config_targets": """
SELECT concat('srv', s_suppkey * 2) AS ServerName,
       CASE WHEN s_suppkey % 3 = 0 THEN concat('cfg', s_suppkey) END AS UserName
FROM {supplier}""",
        "raw_registered": """
SELECT concat('srv', s_suppkey * 3) AS server_name, s_nationkey AS server_group_id FROM {supplier}""",
        "raw_server_groups": """
SELECT n_nationkey AS server_group_id, concat('group', n_regionkey) AS name FROM {nation}""",
        "fx_collection_log": f"""
SELECT event_id AS LogID, {at} AS RunAt, 'collector' AS Collector, {instance} AS ServerName,
       CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'OK' END AS Status,
       CAST(floor(value) AS BIGINT) AS RowsLoaded, props AS Message
FROM {{events}}""",
        # ------------------------------------------------------------- evidence
        "fx_health_metric": f"""
SELECT event_id AS SnapshotID, {at} AS CollectedAt,
       CASE WHEN (user_id % 50) % 4 = 0 THEN 'Redshift' ELSE 'MSSQL' END AS Platform, {instance} AS ServerName,
       CASE event_type WHEN 'click' THEN 'cpu_pct' WHEN 'view' THEN 'page_life_expectancy'
            WHEN 'signup' THEN 'memory_grants_pending' WHEN 'purchase' THEN 'blocked_sessions'
            ELSE CASE WHEN user_id % 2 = 0 THEN 'load_errors_24h' ELSE 'max_vlf_count' END END AS MetricName,
       CAST(CASE event_type WHEN 'view' THEN floor(value * 5) WHEN 'signup' THEN floor(value / 10)
            WHEN 'purchase' THEN floor(value / 10) WHEN 'error' THEN floor(value * 25) ELSE floor(value) END AS DOUBLE)
            AS MetricValue, props AS Detail
FROM {{events}}""",
        "fx_data_lag": f"""
SELECT event_id AS SnapshotID, {at} AS CollectedAt,
       CASE WHEN event_type = 'view' THEN 'Redshift' ELSE 'MSSQL' END AS Platform, {instance} AS ServerName,
       concat('obj', user_id) AS ObjectName,
       CASE WHEN event_type = 'view' THEN 'load_freshness' ELSE 'ag_redo_lag' END AS Metric,
       CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST(floor(value * 20) AS BIGINT) END AS LagSeconds, props AS Detail
FROM {{events}}""",
        "fx_ag": f"""
SELECT event_id AS SnapshotID, {at} AS CollectedAt, concat('ag', user_id % 5) AS AGName,
       concat('db', user_id % 20) AS DatabaseName, {instance} AS ReplicaServer,
       CASE WHEN event_type = 'click' THEN 'PRIMARY' ELSE 'SECONDARY' END AS Role,
       CASE event_id % 3 WHEN 0 THEN 'SYNCHRONIZED' WHEN 1 THEN 'SYNCHRONIZING' ELSE 'NOT SYNCHRONIZING' END AS SyncState,
       CASE event_id % 5 WHEN 0 THEN 'NOT_HEALTHY' WHEN 1 THEN 'PARTIALLY_HEALTHY' WHEN 2 THEN NULL ELSE 'HEALTHY' END
            AS SyncHealth,
       CAST(floor(value * 2) AS BIGINT) AS LogSendQueueKB, CAST(floor(value) AS BIGINT) AS RedoQueueKB,
       {at} AS LastCommitTime
FROM {{events}}""",
        "fx_query_snapshot": f"""
SELECT event_id AS SnapshotID, {d.hour("ts")} AS CollectedAt, 'MSSQL' AS Platform, {instance} AS ServerName,
       event_id AS SessionID, CASE event_type WHEN 'error' THEN user_id WHEN 'click' THEN 0 END AS BlockedBy,
       'running' AS Status, upper(event_type) AS WaitType, CAST(floor(value * 20) AS BIGINT) AS DurationSec,
       concat('db', user_id % 20) AS DatabaseName, concat('u', user_id) AS LoginName,
       concat('host', user_id % 9) AS HostName, event_type AS ProgramName, props AS QueryText
FROM {{events}}""",
        "fx_wait_stats": f"""
SELECT CollectedAt, ServerName, WaitType, run % 20000 AS WaitTimeMs,
       CAST(CAST(run % 1000 AS DOUBLE) / 10 AS DECIMAL(5,1)) AS WaitPct
FROM (SELECT CollectedAt, ServerName, WaitType,
             CAST(sum(v) OVER (PARTITION BY ServerName, WaitType ORDER BY CollectedAt ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run
      FROM (SELECT {d.day("ts")} AS CollectedAt, {srv("user_id % 10")} AS ServerName, event_type AS WaitType,
                   sum(CAST(floor(value * 10) AS BIGINT)) AS v FROM {{events}} GROUP BY 1, 2, 3) a) b""",
        "fx_job_failure": f"""
SELECT event_id * 6 + step * 3 + rerun AS SnapshotID, seen + rerun * INTERVAL '15' MINUTE AS CollectedAt, ServerName,
       concat('job', user_id % 7) AS JobName,
       CASE WHEN step = 1 AND event_id % 5 = 0 THEN NULL ELSE concat('step', step) END AS StepName, seen AS RunAt,
       concat('failed ', rerun, ' ', props) AS Message
FROM (SELECT event_id, user_id, props, seen, ServerName, step, {d.each(0, 1, 2)} AS rerun
      FROM (SELECT event_id, user_id, props, {at} AS seen, {instance} AS ServerName, {d.each(0, 1)} AS step
            FROM {{events}} WHERE event_type = 'error') a) b""",
        "fx_failed_login": f"""
SELECT event_id * 2 + rerun AS SnapshotID, seen + rerun * INTERVAL '15' MINUTE AS CollectedAt, 'MSSQL' AS Platform,
       ServerName, seen AS EventTime, concat('Login failed for user u', user_id) AS Message
FROM (SELECT event_id, user_id, {at} AS seen, {instance} AS ServerName, {d.each(0, 1)} AS rerun
      FROM {{events}}) a""",
        "fx_autogrowth": f"""
SELECT event_id * 2 + rerun AS SnapshotID, seen + rerun * INTERVAL '15' MINUTE AS CollectedAt, ServerName,
       seen AS EventTime, concat('db', user_id % 20) AS DatabaseName,
       CASE WHEN event_id % 2 = 0 THEN 'ROWS' ELSE 'LOG' END AS FileType,
       CAST(event_id % 640 AS DOUBLE) / 10 AS GrowthMB, CAST(floor(value * 20) AS BIGINT) AS DurationMs
FROM (SELECT event_id, user_id, value, {at} AS seen, {instance} AS ServerName, {d.each(0, 1)} AS rerun
      FROM {{events}}) a""",
        "fx_redshift_cost": f"""
SELECT event_id AS SnapshotID, {at} AS CollectedAt, {srv("user_id % 10")} AS ServerName, event_type AS MetricName,
       value AS MetricValue, CASE WHEN event_type = 'view' THEN 'GB' ELSE 'TB' END AS MetricUnit FROM {{events}}""",
        "fx_disk_usage": f"""
SELECT u.CollectedAt, 'MSSQL' AS Platform, u.ServerName, u.VolumeName, u.UsedBytes,
       CAST(floor(m.MaxUsed * (1000 + m.k * 6) / 1000) AS BIGINT) AS TotalBytes
FROM (SELECT CollectedAt, ServerName, VolumeName,
             CAST(sum(c) OVER (PARTITION BY ServerName, VolumeName ORDER BY CollectedAt ROWS UNBOUNDED PRECEDING) AS BIGINT)
                  AS UsedBytes
      FROM (SELECT o_orderdate AS CollectedAt, {srv("c_nationkey")} AS ServerName, o_orderstatus AS VolumeName,
                   sum({price}) AS c
            FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey GROUP BY 1, 2, 3) a) u
JOIN (SELECT {srv("c_nationkey")} AS ServerName, o_orderstatus AS VolumeName, max(c_nationkey) % 5 AS k,
             sum({price}) AS MaxUsed
      FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey GROUP BY 1, 2) m
  ON m.ServerName = u.ServerName AND m.VolumeName = u.VolumeName""",
        "fx_object_size": f"""
SELECT CollectedAt, 'Redshift' AS Platform, ServerName, 'table' AS ObjectType, ObjectName,
       CAST(sum(c) OVER (PARTITION BY ServerName, ObjectName ORDER BY CollectedAt ROWS UNBOUNDED PRECEDING) AS BIGINT)
            AS SizeBytes
FROM (SELECT l_shipdate AS CollectedAt, {by_table} AS ServerName, concat('public.t', l_partkey) AS ObjectName,
             sum({quantity}) * 100000000 AS c FROM {{lineitem}} GROUP BY 1, 2, 3) a""",
        "fx_table_scan": f"""
SELECT l_shipdate AS CollectedAt, {by_table} AS ServerName,
       concat(CASE WHEN l_partkey % 9 = 0 THEN 'dropped.t' ELSE 'public.t' END, l_partkey) AS TableName,
       max(l_shipdate) AS LastScanned
FROM {{lineitem}} GROUP BY 1, 2, 3""",
        "fx_backup": f"""
SELECT {d.ts(ORDERS_AS_OF)} AS CollectedAt, {srv("c_nationkey")} AS ServerName,
       CASE WHEN c_custkey % 31 = 0 THEN 'master' ELSE c_name END AS DatabaseName, c_custkey AS SnapshotID,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'SIMPLE' WHEN 'MACHINERY' THEN 'BULK_LOGGED' ELSE 'FULL' END AS RecoveryModel,
       CASE WHEN c_custkey % 50 = 0 THEN 'OFFLINE' ELSE 'ONLINE' END AS StateDesc,
       CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE {d.ts(ORDERS_AS_OF)} - (c_custkey % 211) * INTERVAL '1' HOUR END AS LastFullBackup,
       CASE WHEN c_custkey % 3 = 0 THEN {d.ts(ORDERS_AS_OF)} - (c_custkey % 97) * INTERVAL '1' HOUR END AS LastDiffBackup,
       {d.ts(ORDERS_AS_OF)} - (c_custkey % 499) * INTERVAL '1' MINUTE AS LastLogBackup,
       CASE WHEN c_custkey % 13 = 0 THEN {d.ts("1900-01-01 00:00:00")}
            ELSE {d.ts(ORDERS_AS_OF)} - (c_custkey % 37) * INTERVAL '1' DAY END AS LastGoodCheckDb,
       CASE WHEN c_custkey % 17 = 0 THEN 'TORN_PAGE_DETECTION' WHEN c_custkey % 7 = 0 THEN NULL ELSE 'CHECKSUM' END AS PageVerify,
       c_custkey % 19 = 0 AS IsAutoShrink
FROM {{customer}}""",
        "fx_table_health": f"""
SELECT event_id AS SnapshotID, {d.day("ts")} AS CollectedAt, {cluster} AS ServerName,
       concat('public.t', user_id) AS TableName,
       CASE WHEN event_id % 23 = 0 THEN NULL ELSE CAST(event_id % 700 AS DOUBLE) / 10 END AS UnsortedPct,
       CAST(event_id % 450 AS DOUBLE) / 10 AS StatsOffPct, event_id AS TableRows
FROM {{events}}""",
        "fx_top_queries": f"""
SELECT {d.day("ts")} AS CollectedAt, {instance} AS ServerName, concat('db', user_id % 20) AS DatabaseName,
       props AS QueryText, event_id AS ExecCount, CAST(floor(value * 100) AS BIGINT) AS TotalCpuMs,
       CAST(floor(value) AS BIGINT) AS AvgCpuMs, CAST(floor(value * 2) AS BIGINT) AS AvgDurMs,
       CAST(floor(value * 3) AS BIGINT) AS AvgReads, {at} AS LastExec
FROM {{events}}""",
        "fx_login_activity": f"""
SELECT {d.day("ts")} AS CollectedAt, {instance} AS ServerName, concat('u', user_id) AS LoginName,
       concat('host', user_id % 9) AS HostName, event_type AS ProgramName, count(*) AS SessionCount,
       max({at}) AS LastLogin
FROM {{events}} GROUP BY 1, 2, 3, 4, 5""",
        "fx_spectrum_scan": f"""
SELECT {d.day("ts")} AS CollectedAt, {cluster} AS ServerName, concat('ext', user_id) AS ExternalTable,
       count(*) AS QueryCount, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS DOUBLE) / 1000 AS TBScanned
FROM {{events}} GROUP BY 1, 2, 3""",
        "fx_query_cost": f"""
SELECT event_id AS SnapshotID, {d.day("ts")} AS CollectedAt, {cluster} AS ServerName, event_id AS QueryId,
       concat('u', user_id) AS UserName, {at} AS StartTime, CAST(floor(value * 20) AS BIGINT) AS ElapsedSec,
       CAST(floor(value * 4000) AS DOUBLE) AS ScanMB, CAST(floor(value * 15000) AS DOUBLE) AS SpectrumMB,
       CAST(floor(value * 7) AS DOUBLE) / 100 AS EstCostUSD, props AS QueryText
FROM {{events}}""",
        "fx_lock_wait": f"""
SELECT event_id AS SnapshotID, {d.day("ts")} AS CollectedAt, {cluster} AS ServerName, event_id AS WaiterPid,
       CASE WHEN event_id % 8 = 0 THEN NULL ELSE concat('u', user_id) END AS WaiterUser,
       concat('public.t', user_id % 30) AS Relation, CAST(floor(value) AS BIGINT) AS WaitMinutes,
       CASE event_id % 4 WHEN 0 THEN 'alter table t' WHEN 1 THEN 'VACUUM t' ELSE 'select 1' END AS WaiterQuery,
       event_id + 1 AS BlockerPid, CASE WHEN event_id % 6 = 0 THEN NULL ELSE concat('b', user_id) END AS BlockerUser,
       'AccessExclusive' AS BlockerLockMode,
       CAST(CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS TINYINT) AS BlockerIdleInTxn,
       CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN 'x VACUUM y' ELSE 'update t' END AS BlockerQuery,
       CASE WHEN event_id % 3 = 0 THEN event_id % 9 ELSE NULL END AS ConflictCount24h
FROM {{events}}""",
        "fx_server_info": f"""
SELECT {d.ts(EVENTS_AS_OF)} AS CollectedAt, {srv("s_suppkey % 80")} AS ServerName, s_suppkey AS SnapshotID,
       concat('15.0.', 4000 + s_suppkey, '.2') AS ProductVersion,
       CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'RTM' END AS ProductLevel,
       CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE concat('CU', s_suppkey) END AS ProductUpdateLevel,
       'Enterprise' AS Edition, '15' AS ProductMajor, 'Windows' AS HostPlatform, s_name AS OSVersion,
       s_suppkey % 2 = 0 AS IsClustered, s_suppkey % 3 = 0 AS IsHadrEnabled, {d.ts("2023-12-01 00:00:00")} AS StartTime,
       s_nationkey AS CpuCount, s_suppkey * 1024 AS PhysicalMemoryMB
FROM {{supplier}}""",
        "fx_config_audit": f"""
SELECT event_id AS SnapshotID, {at} AS CollectedAt, {instance} AS ServerName, concat('item ', props) AS ConfigItem,
       CAST(CAST(floor(value) AS BIGINT) AS VARCHAR(20)) AS CurrentValue, '100' AS RecommendedValue,
       CASE WHEN value > 400 THEN 'CRIT' WHEN value > 100 THEN 'WARN' ELSE 'OK' END AS Status, event_type AS Detail
FROM {{events}}""",
        "fx_security_principal": f"""
SELECT o_orderkey AS SnapshotID, o_orderdate AS CollectedAt, {srv("c_nationkey")} AS ServerName,
       c_name AS PrincipalName, 'SQL_LOGIN' AS PrincipalType,
       CASE WHEN o_totalprice > 450000 THEN 'Sysadmin' WHEN o_totalprice > 400000 THEN 'Security admin'
            WHEN o_totalprice > 300000 THEN 'Elevated' WHEN o_totalprice > 100000 THEN 'Standard'
            WHEN o_totalprice > 50000 THEN 'Connect-only' ELSE 'Disabled' END AS AccessType,
       o_orderpriority AS ServerRoles, o_totalprice <= 50000 AS IsDisabled,
       {d.ts("1994-01-01 00:00:00")} AS CreateDate, o_orderdate AS LastModified
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey""",
        "fx_index_health": f"""
SELECT {d.day("ts")} AS CollectedAt, {instance} AS ServerName, concat('db', user_id % 20) AS DatabaseName,
       CASE event_type WHEN 'view' THEN 'missing' WHEN 'click' THEN 'fragmented' ELSE 'unused' END AS Kind,
       concat('t', user_id) AS ObjectName, concat('ix', event_id) AS IndexName, props AS Metric,
       event_type AS Recommendation
FROM {{events}}""",
        "fx_file_io": f"""
SELECT {d.day("ts")} AS CollectedAt, {instance} AS ServerName, concat('db', user_id % 20) AS DatabaseName,
       CASE WHEN event_id % 2 = 0 THEN 'ROWS' ELSE 'LOG' END AS FileType,
       CASE WHEN event_id % 29 = 0 THEN NULL ELSE CAST(floor(value * 2) AS DOUBLE) / 10 END AS ReadLatencyMs,
       CAST(floor(value) AS DOUBLE) / 10 AS WriteLatencyMs, CAST(floor(value) AS DOUBLE) / 10 AS AvgLatencyMs,
       event_id AS SizeMB, user_id AS TotalReadMB, event_id + user_id AS TotalWriteMB
FROM {{events}}""",
        # -------------------------------------------------- raw logs, SQL Server
        "raw_replica_states": f"""
SELECT {instance} AS ServerName, user_id % 50 AS replica_id, concat('db', user_id % 20) AS database_name,
       event_type = 'click' AS is_primary_replica,
       CASE event_id % 3 WHEN 0 THEN 'SYNCHRONIZED' ELSE 'SYNCHRONIZING' END AS synchronization_state_desc,
       CASE event_id % 5 WHEN 0 THEN 'NOT_HEALTHY' ELSE 'HEALTHY' END AS synchronization_health_desc,
       CAST(floor(value * 2) AS BIGINT) AS log_send_queue_size,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS redo_queue_size,
       {at} AS last_commit_time, {at} AS last_hardened_time, {at} AS last_redone_time
FROM {{events}}""",
        "raw_replicas": f"""
SELECT DISTINCT {instance} AS ServerName, user_id % 50 AS replica_id, user_id % 5 AS group_id,
       concat('replica', user_id % 50) AS replica_server_name FROM {{events}}""",
        "raw_groups": f"""
SELECT DISTINCT {instance} AS ServerName, user_id % 5 AS group_id, concat('ag', user_id % 5) AS name FROM {{events}}""",
        "raw_files": f"""
SELECT {srv("l_suppkey % 50")} AS ServerName, l_partkey % 200 AS database_id, l_partkey AS file_id,
       concat('db', l_partkey % 50) AS database_name, l_linenumber % 3 AS type, {quantity} AS size
FROM {{lineitem}}""",
        "raw_volume_stats": f"""
SELECT DISTINCT {srv("l_suppkey % 50")} AS ServerName, l_partkey % 200 AS database_id, l_partkey AS file_id,
       concat('V', l_partkey % 40) AS volume_mount_point, (l_partkey % 40 + 1) * 1000000000 AS total_bytes,
       (l_partkey % 40) * 300000000 AS available_bytes
FROM {{lineitem}}""",
        "raw_databases": f"""
SELECT {srv("c_nationkey")} AS ServerName, CASE WHEN c_custkey % 97 = 5 THEN 'tempdb' ELSE c_name END AS name,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'SIMPLE' ELSE 'FULL' END AS recovery_model_desc, 'ONLINE' AS state_desc,
       {d.ts(ORDERS_AS_OF)} - (c_custkey % 37) * INTERVAL '1' DAY AS last_good_checkdb,
       'CHECKSUM' AS page_verify_option_desc, c_custkey % 19 = 0 AS is_auto_shrink_on
FROM {{customer}}""",
        "raw_backupset": f"""
SELECT {srv("c_nationkey")} AS ServerName, c_name AS database_name,
       CASE o_orderstatus WHEN 'F' THEN 'D' WHEN 'P' THEN 'I' ELSE 'L' END AS type, o_orderdate AS backup_finish_date,
       o_orderpriority = '5-LOW' AS is_copy_only, o_orderpriority = '4-NOT SPECIFIED' AS is_snapshot
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey""",
        "raw_job_history": f"""
SELECT {instance} AS ServerName, user_id % 7 AS job_id, event_id % 3 AS step_id, concat('step', event_id % 3) AS step_name,
       event_id % 2 AS run_status, CAST(year(ts) * 10000 + month(ts) * 100 + day(ts) AS INT) AS run_date,
       CAST(hour(ts) * 10000 + minute(ts) * 100 + CAST(floor(extract(SECOND FROM ts)) AS INT) AS INT) AS run_time,
       props AS message
FROM {{events}}""",
        "raw_jobs": f"""
SELECT DISTINCT {instance} AS ServerName, user_id % 7 AS job_id, concat('job', user_id % 7) AS name FROM {{events}}""",
        "raw_counters": f"""
SELECT {instance} AS ServerName,
       CASE event_type WHEN 'click' THEN 'SQLServer:Buffer Manager' WHEN 'error' THEN 'SQLServer:Buffer Node'
            ELSE 'SQLServer:Locks' END AS object_name,
       CASE event_type WHEN 'click' THEN 'Page life expectancy' WHEN 'error' THEN 'Page life expectancy'
            WHEN 'signup' THEN 'Memory Grants Pending' WHEN 'purchase' THEN 'Number of Deadlocks/sec'
            ELSE 'Batch Requests/sec' END AS counter_name,
       '_Total' AS instance_name, max(CAST(floor(value) AS BIGINT)) AS cntr_value
FROM {{events}} GROUP BY 1, 2, 3, 4""",
        "raw_sessions": f"""
SELECT {instance} AS ServerName, event_id AS session_id, concat('u', user_id) AS login_name,
       concat('host', user_id % 9) AS host_name, event_type AS program_name, event_id % 4 <> 0 AS is_user_process,
       {at} AS login_time FROM {{events}}""",
        "raw_requests": f"""
SELECT {instance} AS ServerName, event_id AS session_id,
       CASE WHEN event_type = 'error' THEN user_id ELSE 0 END AS blocking_session_id, 'running' AS status,
       CASE WHEN event_type = 'view' THEN NULL ELSE upper(event_type) END AS wait_type, {at} AS start_time,
       concat('db', user_id % 20) AS database_name, user_id AS sql_handle FROM {{events}}""",
        "raw_texts": f"""
SELECT {instance} AS ServerName, CASE WHEN user_id % 9 = 0 THEN -1 - user_id ELSE user_id END AS sql_handle,
       max(props) AS text FROM {{events}} GROUP BY 1, 2""",
        "raw_sys_info": f"""
SELECT {srv("s_suppkey")} AS ServerName,
       {d.ts(EVENTS_AS_OF)} - (s_suppkey * 37) * INTERVAL '1' MINUTE AS sqlserver_start_time FROM {{supplier}}""",
        "raw_ring_buffer": f"""
SELECT {instance} AS ServerName,
       CASE WHEN event_id % 5 = 0 THEN 'RING_BUFFER_OOM' ELSE 'RING_BUFFER_SCHEDULER_MONITOR' END AS ring_buffer_type,
       concat('<Record id="', event_id, '" time="', event_id * 1000, '"><SchedulerMonitorEvent><',
              CASE WHEN event_id % 7 = 0 THEN 'Idle' ELSE 'SystemHealth' END, '><ProcessUtilization>', event_id % 101,
              '</ProcessUtilization></', CASE WHEN event_id % 7 = 0 THEN 'Idle' ELSE 'SystemHealth' END,
              '></SchedulerMonitorEvent></Record>') AS record
FROM {{events}}""",
        "raw_suspect_pages": f"""
SELECT {instance} AS ServerName, event_id AS page_id FROM {{events}} WHERE event_type = 'error'""",
        "raw_file_space": f"""
SELECT {srv("l_suppkey")} AS ServerName, {quantity} AS user_object_reserved_page_count,
       {quantity} * 2 AS internal_object_reserved_page_count, {quantity} * 300 AS version_store_reserved_page_count,
       l_partkey AS mixed_extent_page_count FROM {{lineitem}}""",
        "raw_log_info": f"""
SELECT {srv("l_suppkey")} AS ServerName, l_partkey % 20 AS database_id FROM {{lineitem}}""",
        "raw_wait_stats": f"""
SELECT {srv("user_id % 10")} AS ServerName,
       CASE event_type WHEN 'view' THEN 'WAITFOR' WHEN 'signup' THEN 'SLEEP_TASK'
            ELSE concat(upper(event_type), '_', event_id % 13) END AS wait_type,
       CAST(sum(CAST(floor(value * 10) AS BIGINT)) AS BIGINT) AS wait_time_ms
FROM {{events}} GROUP BY 1, 2""",
        "raw_query_stats": f"""
SELECT {srv("l_suppkey")} AS ServerName, l_partkey AS sql_handle,
       CASE WHEN l_partkey % 40 = 0 THEN 0 ELSE count(*) END AS execution_count,
       CAST(sum({quantity}) * 12345 AS BIGINT) AS total_worker_time,
       CAST(sum({quantity}) * 23456 AS BIGINT) AS total_elapsed_time,
       CAST(sum({quantity}) * 7 AS BIGINT) AS total_logical_reads, max(l_shipdate) AS last_execution_time
FROM {{lineitem}} GROUP BY l_suppkey, l_partkey""",
        "raw_statement_texts": f"""
SELECT DISTINCT {srv("l_suppkey")} AS ServerName,
       CASE WHEN l_partkey % 17 = 0 THEN -1 - l_partkey ELSE l_partkey END AS sql_handle,
       concat('db', p_size) AS database_name, concat(p_name, ' ', p_partkey) AS text
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey""",
        "raw_error_log": f"""
SELECT {instance} AS ServerName, {at} AS LogDate,
       CASE WHEN event_type = 'signup' THEN concat('Login failed for user u', user_id) ELSE 'Backup done' END AS LogText
FROM {{events}}""",
        "raw_error_log_previous": f"""
SELECT {instance} AS ServerName, {at} AS LogDate,
       CASE WHEN event_type = 'error' THEN concat('Login failed for user v', user_id) ELSE 'Log rotated' END AS LogText
FROM {{events}}""",
        # ---------------------------------------------------- raw logs, Redshift
        "raw_partitions": f"""
SELECT {srv("l_suppkey % 10 * 4")} AS ServerName, {quantity} * 3 AS capacity, {quantity} AS used,
       l_linenumber - 1 AS part_begin FROM {{lineitem}}""",
        "raw_inserts": f"""
SELECT {by_query} AS ServerName, l_orderkey AS query, l_partkey AS tbl FROM {{lineitem}}""",
        "raw_rs_queries": f"""
SELECT {by_order} AS ServerName, o_orderkey AS query, o_custkey % 50 AS userid, o_orderdate AS starttime,
       o_orderdate + (o_orderkey % 600) * INTERVAL '1' SECOND AS endtime FROM {{orders}}""",
        "raw_rs_tables": f"""
SELECT {srv("c * 4")} AS ServerName, p_partkey AS id, concat('t', p_partkey % 500, '  ') AS name
FROM (SELECT p_partkey, {d.each(*range(10))} AS c FROM {{part}}) a""",
        "raw_table_info": f"""
SELECT {srv("p_partkey % 10 * 4")} AS ServerName, p_partkey AS table_id, 'public  ' AS {d.name("schema")},
       concat(' t', p_partkey, ' ') AS {d.name("table")}, CAST(p_size AS BIGINT) AS size,
       CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_partkey % 100 AS DOUBLE) END AS unsorted,
       CAST(p_partkey % 80 AS DOUBLE) AS stats_off, p_partkey * 10 AS tbl_rows FROM {{part}}""",
        "raw_recents": f"""
SELECT {cluster} AS ServerName, event_id AS pid,
       CASE event_id % 3 WHEN 0 THEN 'Running   ' WHEN 1 THEN 'Running' ELSE 'Done' END AS status,
       CAST(floor(value * 1000000) AS BIGINT) AS duration, concat('db', user_id % 20, '  ') AS db_name,
       concat('u', user_id, ' ') AS user_name, props AS query FROM {{events}}""",
        "raw_wlm": f"""
SELECT {cluster} AS ServerName,
       CASE event_type WHEN 'view' THEN 'QueuedWaiting' WHEN 'click' THEN 'Queued' ELSE 'Running' END AS state
FROM {{events}}""",
        "raw_rs_sessions": f"SELECT {cluster} AS ServerName, event_id AS process FROM {{events}}",
        "raw_load_errors": f"""
SELECT {cluster} AS ServerName, {at} AS starttime FROM {{events}} WHERE event_type = 'error'""",
        "raw_scans": f"""
SELECT {by_table} AS ServerName, l_suppkey % 5 AS userid, l_partkey AS tbl,
       l_shipdate + l_linenumber * INTERVAL '1' MINUTE AS endtime FROM {{lineitem}}""",
        "raw_s3": f"""
SELECT {by_query} AS ServerName, l_orderkey AS query,
       CASE WHEN l_partkey % 30 = 0 THEN '  ' WHEN l_partkey % 31 = 0 THEN NULL
            ELSE concat('ext', l_partkey % 120, ' ') END AS external_table_name,
       {quantity} * 12345678901 AS s3_scanned_bytes, l_shipdate AS starttime FROM {{lineitem}}""",
        "raw_query_scans": f"""
SELECT {by_query} AS ServerName, l_orderkey AS query, l_suppkey % 5 AS userid, {quantity} * 1000000000 AS bytes,
       l_shipdate AS starttime FROM {{lineitem}}""",
        "raw_connection_log": f"""
SELECT {cluster} AS ServerName,
       CASE WHEN event_type = 'error' THEN 'authentication failure  ' ELSE 'initiating session' END AS event,
       {at} AS recordtime, concat(' u', user_id, ' ') AS username, concat('host', user_id % 9) AS remotehost
FROM {{events}}""",
        "raw_querytext": f"""
SELECT {srv("conv_id % 10 * 4")} AS ServerName, conv_id AS query, turn AS sequence, text FROM {{conversations}}""",
        "raw_users": f"""
SELECT DISTINCT {by_order} AS ServerName, o_custkey % 50 AS usesysid, concat('u', o_custkey % 50, ' ') AS usename
FROM {{orders}}""",
        "raw_query_history": f"""
SELECT {by_order} AS ServerName, o_orderdate AS start_time, {price} * 1000 AS scan_size_bytes FROM {{orders}}""",
        "raw_serverless": f"""
SELECT {by_order} AS ServerName, o_orderdate AS end_time, o_custkey AS charged_seconds, o_orderkey % 128 AS compute_capacity
FROM {{orders}}""",
        "raw_transactions": f"""
SELECT {by_table} AS ServerName, l_orderkey * 10 + l_linenumber AS pid, l_partkey AS relation,
       l_linestatus = 'F' AS granted, l_shipdate AS txn_start, concat('u', l_suppkey, ' ') AS txn_owner,
       l_returnflag AS lock_mode FROM {{lineitem}}""",
        "raw_classes": f"""
SELECT {srv("p_partkey % 10 * 4")} AS ServerName, CASE WHEN p_partkey % 11 = 0 THEN -1 - p_partkey ELSE p_partkey END AS oid,
       concat('public.t', p_partkey, ' ') AS relname FROM {{part}}""",
        "raw_lock_recents": f"""
SELECT {by_table} AS ServerName, l_orderkey * 10 + l_linenumber AS pid,
       CASE WHEN l_suppkey % 2 = 0 THEN 'Running ' ELSE 'Done' END AS status, concat(' update t set q = ', l_quantity) AS query
FROM {{lineitem}}""",
        "raw_inflight": f"""
SELECT {by_table} AS ServerName, CASE WHEN l_suppkey % 3 = 0 THEN l_orderkey * 10 + l_linenumber ELSE -1 END AS pid,
       concat('select ', l_suppkey) AS text FROM {{lineitem}}""",
        "raw_conflicts": f"""
SELECT {by_table} AS ServerName, l_partkey AS table_id, l_shipdate AS xact_start_ts
FROM {{lineitem}}""",
        # --------------------------------------------------------- raw logs, audit
        "raw_properties": f"""
SELECT {srv("s_suppkey")} AS ServerName,
       CASE k WHEN 0 THEN 'ProductVersion' WHEN 1 THEN 'ProductLevel' WHEN 2 THEN 'Edition' WHEN 3 THEN 'CpuCount'
            WHEN 4 THEN 'IsClustered' WHEN 5 THEN 'StartTime' ELSE 'Unknown' END AS Property,
       CASE k WHEN 0 THEN concat('15.0.', s_suppkey) WHEN 1 THEN 'RTM' WHEN 2 THEN s_name
            WHEN 3 THEN CAST(s_nationkey AS VARCHAR(10)) WHEN 4 THEN CASE WHEN s_nationkey % 2 = 0 THEN 'true' ELSE 'false' END
            WHEN 5 THEN '2023-12-01 00:00:00' ELSE 'x' END AS Value
FROM (SELECT s_suppkey, s_name, s_nationkey, {d.each(*range(7))} AS k FROM {{supplier}}) a""",
        "raw_settings": f"""
SELECT {srv("p_partkey % 50")} AS ServerName,
       CASE p_brand WHEN 'Brand#1' THEN 'max degree of parallelism' WHEN 'Brand#2' THEN 'cost threshold for parallelism'
            WHEN 'Brand#3' THEN 'max server memory (MB)' WHEN 'Brand#4' THEN 'xp_cmdshell' WHEN 'Brand#5' THEN 'sa enabled'
            WHEN 'Brand#6' THEN 'sysadmin count' WHEN 'Brand#7' THEN 'backup compression default' ELSE p_brand END AS ConfigItem,
       CAST(max(p_size) - 1 AS BIGINT) AS CurrentValue
FROM {{part}} GROUP BY 1, 2""",
        "fx_principal": f"""
SELECT {srv("c_nationkey")} AS ServerName, c_name AS PrincipalName, c_custkey % 10 = 0 AS IsDisabled FROM {{customer}}""",
        "raw_role_members": f"""
SELECT {srv("c_nationkey")} AS ServerName, c_name AS PrincipalName,
       CASE WHEN o_totalprice > 490000 THEN 'sysadmin' WHEN o_totalprice > 470000 THEN 'securityadmin'
            WHEN o_totalprice > 430000 THEN 'dbcreator' WHEN o_totalprice > 380000 THEN 'app_reader' ELSE 'public' END AS RoleName
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey""",
        "raw_missing_index": f"""
SELECT {srv("p_partkey % 10")} AS ServerName, concat('db', p_size % 5) AS DatabaseName, concat('t', p_partkey) AS ObjectName,
       p_retailprice AS Impact, p_type AS Columns FROM {{part}}""",
        "raw_index_usage": f"""
SELECT {srv("p_partkey % 10")} AS ServerName, concat('db', p_size % 5) AS DatabaseName, concat('t', p_partkey) AS ObjectName,
       concat('ix', p_partkey) AS IndexName, CAST(p_size % 10 AS BIGINT) AS Reads, CAST(p_size AS BIGINT) AS Writes FROM {{part}}""",
        "raw_index_physical": f"""
SELECT {srv("p_partkey % 10")} AS ServerName, concat('db', p_size % 5) AS DatabaseName, concat('t', p_partkey) AS ObjectName,
       concat('ix', p_partkey) AS IndexName, CAST(p_partkey % 100 AS DOUBLE) AS FragmentationPct, p_partkey * 2 AS Pages
FROM {{part}}""",
        "raw_file_io": f"""
SELECT {srv("l_suppkey % 50")} AS ServerName, concat('db', l_partkey % 20) AS DatabaseName,
       CASE l_linestatus WHEN 'F' THEN 'ROWS' ELSE 'LOG' END AS FileType,
       CAST(sum(CAST(floor(l_extendedprice / 100) AS BIGINT)) AS BIGINT) AS io_stall_read_ms,
       CAST(sum(CASE WHEN l_partkey % 20 = 0 THEN 0 ELSE {quantity} END) AS BIGINT) AS num_of_reads,
       CAST(sum(CAST(floor(l_extendedprice / 77) AS BIGINT)) AS BIGINT) AS io_stall_write_ms,
       CAST(sum({quantity}) AS BIGINT) AS num_of_writes, CAST(sum({quantity}) * 1000000 AS BIGINT) AS size_on_disk_bytes,
       CAST(sum({quantity}) * 3000000 AS BIGINT) AS num_of_bytes_read,
       CAST(sum({quantity}) * 2000000 AS BIGINT) AS num_of_bytes_written
FROM {{lineitem}} GROUP BY 1, 2, 3""",
        "raw_trace": f"""
SELECT {instance} AS ServerName, {at} AS StartTime, concat('db', user_id % 20) AS DatabaseName,
       CASE event_id % 3 WHEN 0 THEN 92 WHEN 1 THEN 93 ELSE 55 END AS EventClass, event_id % 8192 AS IntegerData,
       CAST(floor(value * 20000) AS BIGINT) AS Duration FROM {{events}}""",
    }


_SPARK_SQL = adapters(SPARK)


class Fixtures:
    """Adapters over one directory of test tables, as Spark frames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in _SPARK_SQL and name not in BASE_TABLES:
            raise AttributeError(name)
        if name not in self._frames:
            self._frames[name] = self._build(name)
        return self._frames[name]

    def _build(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        sql = _SPARK_SQL[name]
        used = {n: getattr(self, n) for n in set(re.findall(r"\{(\w+)\}", sql))}
        return self.spark.sql(sql, **used)
