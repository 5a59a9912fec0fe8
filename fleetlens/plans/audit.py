"""Standing-state checks: server facts, configuration, access, indexes, files.

The cut-offs of this module are choices made here; the rules are data and can
be replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.expressions import cat, nullif, status, txt
from fleetlens.operators.ranking import top_k

S = "ServerName"

#: property name -> type, as in the ServerInfo table
SERVER_PROPERTIES = {
    "ProductVersion": "string",
    "ProductLevel": "string",
    "ProductUpdateLevel": "string",
    "Edition": "string",
    "ProductMajor": "string",
    "HostPlatform": "string",
    "OSVersion": "string",
    "IsClustered": "boolean",
    "IsHadrEnabled": "boolean",
    "StartTime": "timestamp_ntz",
    "CpuCount": "int",
    "PhysicalMemoryMB": "bigint",
}


def extract_server_info(properties: DataFrame) -> DataFrame:
    """One row of facts per server from (ServerName, Property, Value)."""
    wide = properties.groupBy(S).pivot("Property", list(SERVER_PROPERTIES)).agg(F.max("Value"))
    return wide.select(S, *[F.col(p).cast(t).alias(p) for p, t in SERVER_PROPERTIES.items()])


#: (item, operator that must hold, recommended value, status if it does not, why it matters)
CONFIG_RULES = [
    ("max degree of parallelism", "<>", 0, "WARN", "Unlimited parallelism lets one query take every core."),
    ("cost threshold for parallelism", ">=", 25, "WARN", "A low threshold sends trivial queries parallel."),
    ("max server memory (MB)", "<", 2147483647, "WARN", "Without a limit the operating system is starved."),
    ("xp_cmdshell", "=", 0, "WARN", "Shell access from SQL widens the attack surface."),
    ("sa enabled", "=", 0, "WARN", "The well-known administrator login invites guessing."),
    ("sa renamed", "=", 1, "WARN", "The well-known administrator name invites guessing."),
    ("sysadmin count", "<=", 5, "WARN", "Few principals should have unlimited rights."),
    ("backup compression default", "=", 1, "WARN", "Uncompressed backups cost time and space."),
    ("optimize for ad hoc workloads", "=", 1, "WARN", "Single-use plans crowd the plan cache."),
]


def config_rules(spark, rules=CONFIG_RULES) -> DataFrame:
    schema = "ConfigItem string, Op string, Bound bigint, Severity string, Why string"
    return spark.createDataFrame(list(rules), schema)


def audit_config(settings: DataFrame, rules: DataFrame) -> DataFrame:
    """Score (ServerName, ConfigItem, CurrentValue) rows against a rule table.

    ``rules`` holds one row per item. Settings without a rule are not reported.
    """
    value, bound = F.col("CurrentValue").cast("bigint"), F.col("Bound")
    holds = F.coalesce(
        F.when(F.col("Op") == "=", value == bound)
        .when(F.col("Op") == "<>", value != bound)
        .when(F.col("Op") == ">=", value >= bound)
        .when(F.col("Op") == "<=", value <= bound)
        .when(F.col("Op") == "<", value < bound)
        .when(F.col("Op") == ">", value > bound),
        F.lit(False),
    )
    return settings.join(rules, ["ConfigItem"], "inner").select(
        S,
        "ConfigItem",
        value.cast("string").alias("CurrentValue"),
        cat(F.when(F.col("Op") != "=", cat("Op", txt(" "))), "Bound").alias("RecommendedValue"),
        F.when(holds, "OK").otherwise(F.col("Severity")).alias("Status"),
        F.when(~holds, F.col("Why")).alias("Detail"),
    )


#: fixed server roles that give more than ordinary access
ELEVATED_ROLES = ["serveradmin", "setupadmin", "processadmin", "diskadmin", "dbcreator", "bulkadmin"]


def classify_principals(principals: DataFrame, role_members: DataFrame) -> DataFrame:
    """Access class and role list of every principal.

    Precedence: disabled, sysadmin, security admin, any other elevated role,
    any other role, none but public.
    """
    keys = [S, "PrincipalName"]
    # roles per principal are few and distinct; duplicates are dropped before they are listed
    roles = (
        role_members.filter(F.col("RoleName") != "public")
        .select(*keys, "RoleName")
        .distinct()
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_set("RoleName")).alias("_roles"))
    )
    rows = principals.join(roles, keys, "left")
    has = F.col("_roles")
    access = status(
        [
            ("Disabled", F.col("IsDisabled")),
            ("Sysadmin", F.array_contains(has, "sysadmin")),
            ("Security admin", F.array_contains(has, "securityadmin")),
            ("Elevated", F.arrays_overlap(has, F.array(*map(F.lit, ELEVATED_ROLES)))),
            ("Standard", F.size(has) > 0),
        ],
        "Connect-only",
    )
    return rows.withColumn("AccessType", access).withColumn("ServerRoles", F.array_join("_roles", ",")).drop("_roles")


def extract_index_health(
    missing: DataFrame,
    usage: DataFrame,
    physical: DataFrame,
    n: int = 50,
    min_impact: float = 1000,
    min_fragmentation: float = 30,
    min_pages: int = 1000,
) -> DataFrame:
    """Missing indexes (the ``n`` of most impact per server), unused and fragmented ones."""

    def shape(df, kind, index, metric, advice):
        return df.select(
            S,
            "DatabaseName",
            F.lit(kind).alias("Kind"),
            "ObjectName",
            index.alias("IndexName"),
            metric.alias("Metric"),
            advice.alias("Recommendation"),
        )

    no_name = F.lit(None).cast("string")
    top = top_k(missing.filter(F.col("Impact") >= min_impact), n, F.desc("Impact"), "DatabaseName", "ObjectName")
    unused = usage.filter((F.col("Reads") == 0) & (F.col("Writes") > 0))
    fragmented = physical.filter((F.col("FragmentationPct") >= min_fragmentation) & (F.col("Pages") >= min_pages))
    parts = [
        shape(
            top, "missing", no_name, cat(txt("impact "), F.col("Impact").cast("bigint")),
            cat(txt("Consider an index on "), "ObjectName", txt(" ("), "Columns", txt(")")),
        ),
        shape(
            unused, "unused", F.col("IndexName"), cat(txt("reads 0 / writes "), "Writes"),
            cat(txt("Consider dropping "), "IndexName"),
        ),
        shape(
            fragmented, "fragmented", F.col("IndexName"),
            cat(F.col("FragmentationPct").cast("bigint"), txt("% of "), "Pages", txt(" pages")),
            cat(F.when(F.col("FragmentationPct") >= 60, "Rebuild ").otherwise("Reorganize "), "IndexName"),
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def extract_file_io(io_stats: DataFrame) -> DataFrame:
    """Milliseconds per read, per write and overall, from stall times and operation counts."""

    def per_op(stall, ops):
        ratio = stall.cast("decimal(20,0)") / nullif(ops, 0).cast("decimal(20,0)")
        return ratio.cast("decimal(10,1)")

    reads, writes = F.col("num_of_reads"), F.col("num_of_writes")
    read_ms, write_ms = F.col("io_stall_read_ms"), F.col("io_stall_write_ms")
    return io_stats.select(
        S,
        "DatabaseName",
        "FileType",
        per_op(read_ms, reads).alias("ReadLatencyMs"),
        per_op(write_ms, writes).alias("WriteLatencyMs"),
        per_op(read_ms + write_ms, reads + writes).alias("AvgLatencyMs"),
        F.expr("size_on_disk_bytes div 1048576").alias("SizeMB"),
        F.expr("num_of_bytes_read div 1048576").alias("TotalReadMB"),
        F.expr("num_of_bytes_written div 1048576").alias("TotalWriteMB"),
    )


#: trace event classes: growth of a data file and of a log file
DATA_GROWTH, LOG_GROWTH = 92, 93


def extract_autogrowth(trace: DataFrame) -> DataFrame:
    """File growth events: pages of 8 KiB and microseconds to MB and milliseconds."""
    rows = trace.filter(F.col("EventClass").isin(DATA_GROWTH, LOG_GROWTH))
    return rows.select(
        S,
        F.col("StartTime").alias("EventTime"),
        "DatabaseName",
        F.when(F.col("EventClass") == LOG_GROWTH, "LOG").otherwise("ROWS").alias("FileType"),
        (F.col("IntegerData").cast("decimal(20,0)") / F.lit(128).cast("decimal(3,0)")).cast("decimal(10,1)").alias("GrowthMB"),
        F.expr("Duration div 1000").alias("DurationMs"),
    )
