"""Column layout of the evidence (mon), inventory (cfg) and state tables.

``SnapshotID`` and other surrogate identities are optional: they are used to
settle ties where a source supplies them and are never generated.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Tables with the names, types and order of their columns, as DDL.
LAYOUT: dict[str, str] = {
    "AGSyncStatus": (
        "CollectedAt timestamp_ntz, ServerName string, AGName string, DatabaseName string, ReplicaServer string, "
        "IsPrimary boolean, Role string, SyncState string, SyncHealth string, LogSendQueueKB bigint, "
        "RedoQueueKB bigint, LastCommitTime timestamp_ntz, LastHardenedTime timestamp_ntz, "
        "LastRedoneTime timestamp_ntz"
    ),
    "DataLag": (
        "CollectedAt timestamp_ntz, Platform string, ServerName string, ObjectName string, LagSeconds bigint, "
        "Metric string, Detail string"
    ),
    "DiskUsage": (
        "CollectedAt timestamp_ntz, Platform string, ServerName string, VolumeName string, TotalBytes bigint, "
        "UsedBytes bigint, FreeBytes bigint, UsedPct decimal(5,2)"
    ),
    "ObjectSize": (
        "CollectedAt timestamp_ntz, Platform string, ServerName string, ObjectType string, ObjectName string, "
        "SizeBytes bigint"
    ),
    "BackupStatus": (
        "CollectedAt timestamp_ntz, ServerName string, DatabaseName string, RecoveryModel string, "
        "StateDesc string, LastFullBackup timestamp_ntz, LastDiffBackup timestamp_ntz, "
        "LastLogBackup timestamp_ntz, LastGoodCheckDb timestamp_ntz, PageVerify string, IsAutoShrink boolean"
    ),
    "JobFailure": (
        "CollectedAt timestamp_ntz, ServerName string, JobName string, StepName string, RunAt timestamp_ntz, "
        "Message string"
    ),
    "HealthMetric": (
        "CollectedAt timestamp_ntz, Platform string, ServerName string, MetricName string, MetricValue double, "
        "Detail string"
    ),
    "QuerySnapshot": (
        "CollectedAt timestamp_ntz, Platform string, ServerName string, SessionID bigint, BlockedBy bigint, "
        "Status string, WaitType string, DurationSec bigint, DatabaseName string, LoginName string, "
        "HostName string, ProgramName string, QueryText string"
    ),
    "WaitStats": (
        "CollectedAt timestamp_ntz, ServerName string, WaitType string, WaitTimeMs bigint, WaitPct decimal(5,1)"
    ),
    "TableHealth": (
        "CollectedAt timestamp_ntz, ServerName string, TableName string, UnsortedPct decimal(5,1), "
        "StatsOffPct decimal(5,1), TableRows bigint"
    ),
    "TopQueries": (
        "CollectedAt timestamp_ntz, ServerName string, DatabaseName string, QueryText string, ExecCount bigint, "
        "TotalCpuMs bigint, AvgCpuMs bigint, AvgDurMs bigint, AvgReads bigint, LastExec timestamp_ntz"
    ),
    "FailedLogin": (
        "CollectedAt timestamp_ntz, Platform string, ServerName string, EventTime timestamp_ntz, Message string"
    ),
    "LoginActivity": (
        "CollectedAt timestamp_ntz, ServerName string, LoginName string, HostName string, ProgramName string, "
        "SessionCount bigint, LastLogin timestamp_ntz"
    ),
    "RedshiftCost": (
        "CollectedAt timestamp_ntz, ServerName string, MetricName string, MetricValue double, MetricUnit string"
    ),
    "TableScan": (
        "CollectedAt timestamp_ntz, ServerName string, TableName string, LastScanned timestamp_ntz"
    ),
    "SpectrumScan": (
        "CollectedAt timestamp_ntz, ServerName string, ExternalTable string, QueryCount bigint, TBScanned double"
    ),
    "LockWait": (
        "CollectedAt timestamp_ntz, ServerName string, WaiterPid bigint, WaiterUser string, Relation string, "
        "WaitMinutes bigint, WaiterQuery string, BlockerPid bigint, BlockerUser string, BlockerLockMode string, "
        "BlockerIdleInTxn tinyint, BlockerQuery string, ConflictCount24h bigint"
    ),
    "ServerInfo": (
        "CollectedAt timestamp_ntz, ServerName string, ProductVersion string, ProductLevel string, "
        "ProductUpdateLevel string, Edition string, ProductMajor string, HostPlatform string, OSVersion string, "
        "IsClustered boolean, IsHadrEnabled boolean, StartTime timestamp_ntz, CpuCount int, "
        "PhysicalMemoryMB bigint"
    ),
    "ConfigAudit": (
        "CollectedAt timestamp_ntz, ServerName string, ConfigItem string, CurrentValue string, "
        "RecommendedValue string, Status string, Detail string"
    ),
    "SecurityPrincipal": (
        "CollectedAt timestamp_ntz, ServerName string, PrincipalName string, PrincipalType string, "
        "AccessType string, ServerRoles string, IsDisabled boolean, CreateDate timestamp_ntz, "
        "LastModified timestamp_ntz"
    ),
    "IndexHealth": (
        "CollectedAt timestamp_ntz, ServerName string, DatabaseName string, Kind string, ObjectName string, "
        "IndexName string, Metric string, Recommendation string"
    ),
    "FileIOStats": (
        "CollectedAt timestamp_ntz, ServerName string, DatabaseName string, FileType string, "
        "ReadLatencyMs decimal(10,1), WriteLatencyMs decimal(10,1), AvgLatencyMs decimal(10,1), SizeMB bigint, "
        "TotalReadMB bigint, TotalWriteMB bigint"
    ),
    "AutoGrowth": (
        "CollectedAt timestamp_ntz, ServerName string, EventTime timestamp_ntz, DatabaseName string, "
        "FileType string, GrowthMB decimal(10,1), DurationMs bigint"
    ),
    "QueryCost": (
        "CollectedAt timestamp_ntz, ServerName string, QueryId bigint, UserName string, StartTime timestamp_ntz, "
        "ElapsedSec bigint, ScanMB decimal(18,1), SpectrumMB decimal(18,1), EstCostUSD decimal(12,2), "
        "QueryText string"
    ),
    "DiskForecast": (
        "Platform string, ServerName string, VolumeName string, TotalBytes bigint, UsedBytes bigint, "
        "UsedPct decimal(5,2), GrowthBytesPerDay bigint, DaysToFull int, ProjectedFullDate date, "
        "RecommendedAddGB int, Severity string, ComputedAt timestamp_ntz"
    ),
    "CostAnomaly": (
        "ServerName string, MetricName string, MetricUnit string, ObservedDay date, Value double, Baseline double, "
        "StdDev double, ZScore decimal(10,2), PctAboveBaseline decimal(10,1), Severity string, "
        "DetectedAt timestamp_ntz"
    ),
    "AlertHistory": (
        "AlertKey string, Category string, Severity string, ServerName string, Message string, "
        "FirstSeen timestamp_ntz, LastSeen timestamp_ntz, NotifiedAt timestamp_ntz, Resolved boolean, "
        "ResolvedAt timestamp_ntz"
    ),
    "Finding": (
        "FindingKey string, Platform string, Category string, Severity string, ServerName string, Title string, "
        "Symptom string, RootCause string, Recommendation string, Prevention string, Evidence string, "
        "FirstSeen timestamp_ntz, LastSeen timestamp_ntz, Resolved boolean, ResolvedAt timestamp_ntz"
    ),
    "Servers": (
        "ServerID bigint, ServerName string, Platform string, Environment string, FriendlyName string, "
        "IsActive boolean, CreatedAt timestamp_ntz, Host string, Port int, DatabaseName string, AuthType string, "
        "UserName string, HasPassword boolean"
    ),
    "AppOwners": (
        "AppOwnerID bigint, ServerName string, DatabaseName string, AppName string, Criticality string, "
        "PrimaryOwner string, SecondaryOwner string, Team string, Email string, OnCallPhone string, Notes string, "
        "UpdatedBy string, UpdatedAt timestamp_ntz"
    ),
    "CollectionLog": (
        "RunAt timestamp_ntz, Collector string, ServerName string, Status string, RowsLoaded bigint, "
        "Message string"
    ),
}

#: table -> {column: type}; the order of columns is the stored order
TABLES: dict[str, dict[str, str]] = {
    name: dict(column.split(" ") for column in ddl.split(", ")) for name, ddl in LAYOUT.items()
}

#: columns computed at ingest; a source may not supply them
COMPUTED = {"DiskUsage": ["FreeBytes", "UsedPct"]}

#: append-only series that carry CollectedAt
SERIES = [name for name, cols in TABLES.items() if "CollectedAt" in cols]

#: the partition the latest-row reports use, per table
ROW_KEYS = {
    "AGSyncStatus": ["AGName", "DatabaseName", "ReplicaServer"],
    "DataLag": ["Platform", "ServerName", "ObjectName", "Metric"],
    "BackupStatus": ["ServerName", "DatabaseName"],
    "HealthMetric": ["Platform", "ServerName", "MetricName"],
    "ServerInfo": ["ServerName"],
    "ConfigAudit": ["ServerName", "ConfigItem"],
    "SecurityPrincipal": ["ServerName", "PrincipalName"],
}


def struct(table: str) -> T.StructType:
    ddl = ", ".join(f"{c} {t}" for c, t in TABLES[table].items())
    return T.StructType.fromDDL(ddl)


def empty(spark, table: str):
    return spark.createDataFrame([], struct(table))
