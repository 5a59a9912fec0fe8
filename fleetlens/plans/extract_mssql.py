"""SQL Server evidence from landed system tables of many instances.

Every input carries ``ServerName``. Outputs have the columns of the evidence
table they feed, without the envelope (``with_envelope`` adds it).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import constants as K
from fleetlens.functions.expressions import boundary_diff, cat, percent_of, ts_lit, txt
from fleetlens.operators.latest import first_per_key
from fleetlens.operators.ranking import top_k, total_per_key

S = "ServerName"


def _to_utc(ts, source_tz: str):
    """Local server time to UTC, both without a zone."""
    return ts if source_tz == "UTC" else F.convert_timezone(F.lit(source_tz), F.lit("UTC"), ts)


def extract_ag_sync(states: DataFrame, replicas: DataFrame, groups: DataFrame) -> DataFrame:
    """Availability-group replica states with names and role."""
    named = replicas.join(groups.withColumnRenamed("name", "AGName"), [S, "group_id"], "inner")
    named = named.select(S, "replica_id", "AGName", F.col("replica_server_name").alias("ReplicaServer"))
    rows = states.join(named, [S, "replica_id"], "inner")
    return rows.select(
        S,
        "AGName",
        F.col("database_name").alias("DatabaseName"),
        "ReplicaServer",
        F.col("is_primary_replica").alias("IsPrimary"),
        F.when(F.col("is_primary_replica"), "PRIMARY").otherwise("SECONDARY").alias("Role"),
        F.col("synchronization_state_desc").alias("SyncState"),
        F.col("synchronization_health_desc").alias("SyncHealth"),
        F.col("log_send_queue_size").alias("LogSendQueueKB"),
        F.col("redo_queue_size").alias("RedoQueueKB"),
        F.col("last_commit_time").alias("LastCommitTime"),
        F.col("last_hardened_time").alias("LastHardenedTime"),
        F.col("last_redone_time").alias("LastRedoneTime"),
    )


def extract_ag_lag(ag_sync: DataFrame) -> DataFrame:
    """Seconds each secondary is behind the primary of its group and database, as one instance reports both.

    Names of groups repeat across clusters, so rows of different instances are never paired.
    """
    keys = [S, "AGName", "DatabaseName"]
    primary = ag_sync.filter("IsPrimary").groupBy(*keys).agg(F.max("LastCommitTime").alias("_primary"))
    rows = ag_sync.filter(~F.col("IsPrimary")).join(primary, keys, "inner")
    return rows.select(
        S,
        cat(txt("AG:"), "DatabaseName", txt("@"), "ReplicaServer").alias("ObjectName"),
        boundary_diff("second", "LastCommitTime", "_primary").alias("LagSeconds"),
        F.lit("ag_redo_lag").alias("Metric"),
        cat(txt("AG="), "AGName", txt("; RedoQueueKB="), F.coalesce("RedoQueueKB", F.lit(0))).alias("Detail"),
    )


def extract_disk(files: DataFrame, volume_stats: DataFrame) -> DataFrame:
    """The distinct volumes that hold database files."""
    keys = [S, "database_id", "file_id"]
    rows = files.select(*keys).join(volume_stats, keys, "inner")
    return rows.select(
        S,
        F.col("volume_mount_point").alias("VolumeName"),
        F.col("total_bytes").alias("TotalBytes"),
        (F.col("total_bytes") - F.col("available_bytes")).alias("UsedBytes"),
    ).distinct()


def extract_db_size(files: DataFrame) -> DataFrame:
    """Size per database from 8 KiB pages of its data and log files."""
    return (
        files.filter(F.col("type").isin(0, 1))
        .groupBy(S, F.col("database_name").alias("ObjectName"))
        .agg((F.sum(F.col("size").cast("bigint")) * 8192).alias("SizeBytes"))
        .select(S, F.lit("database").alias("ObjectType"), "ObjectName", "SizeBytes")
    )


def extract_backup(databases: DataFrame, backupset: DataFrame, source_tz: str = "UTC") -> DataFrame:
    """Last full, differential and log backup per database.

    Copy-only and snapshot backups do not count. The backup history is reduced
    to one row per database before the join.
    """
    finished = F.col("backup_finish_date")
    last = (
        backupset.filter(~F.col("is_copy_only") & ~F.col("is_snapshot"))
        .groupBy(S, F.col("database_name").alias("name"))
        .agg(
            *[
                F.max(F.when(F.col("type") == kind, finished)).alias(c)
                for kind, c in (("D", "LastFullBackup"), ("I", "LastDiffBackup"), ("L", "LastLogBackup"))
            ]
        )
    )
    rows = databases.filter(F.col("name") != "tempdb").join(last, [S, "name"], "left")
    return rows.select(
        S,
        F.col("name").alias("DatabaseName"),
        F.col("recovery_model_desc").alias("RecoveryModel"),
        F.col("state_desc").alias("StateDesc"),
        *[_to_utc(F.col(c), source_tz).alias(c) for c in ("LastFullBackup", "LastDiffBackup", "LastLogBackup")],
        _to_utc(F.col("last_good_checkdb"), source_tz).alias("LastGoodCheckDb"),
        F.col("page_verify_option_desc").alias("PageVerify"),
        F.col("is_auto_shrink_on").alias("IsAutoShrink"),
    )


def agent_time(run_date, run_time):
    """Integer date yyyymmdd and time hhmmss to a timestamp."""
    return F.to_timestamp_ntz(F.format_string("%08d%06d", F.col(run_date), F.col(run_time)), F.lit("yyyyMMddHHmmss"))


def extract_job_failures(history: DataFrame, jobs: DataFrame, as_of, source_tz: str = "UTC") -> DataFrame:
    """Failed job steps of the last 24 hours."""
    failed = (
        history.filter((F.col("run_status") == 0) & (F.col("step_id") > 0))
        .withColumn("RunAt", _to_utc(agent_time("run_date", "run_time"), source_tz))
        .filter(F.col("RunAt") > ts_lit(as_of, hours=-24))
    )
    rows = failed.join(jobs.select(S, "job_id", F.col("name").alias("JobName")), [S, "job_id"], "inner")
    return rows.select(
        S, "JobName", F.col("step_name").alias("StepName"), "RunAt", F.substring("message", 1, 600).alias("Message")
    )


#: where a ring-buffer record keeps its value, and the time in its opening tag
CPU_PATH = "/Record/SchedulerMonitorEvent/SystemHealth/ProcessUtilization"
RECORD_TIME = r"""<Record\b[^>]*\btime\s*=\s*["'](\d+)"""


def extract_cpu_pct(ring_buffer: DataFrame) -> DataFrame:
    """CPU use of the instance from the newest scheduler record.

    Only the newest record of a server is parsed as XML; the times are read
    from the opening tags.
    """
    records = ring_buffer.filter(
        (F.col("ring_buffer_type") == "RING_BUFFER_SCHEDULER_MONITOR") & F.col("record").contains("<SystemHealth>")
    ).select(S, "record", F.regexp_extract("record", RECORD_TIME, 1).try_cast("bigint").alias("_time"))
    newest = first_per_key(records, [S], F.desc_nulls_last("_time"))
    return newest.select(S, F.xpath_int("record", F.lit(CPU_PATH)).cast("double").alias("cpu_pct"))


def extract_vitals(
    servers: DataFrame,
    as_of,
    counters: DataFrame,
    sessions: DataFrame,
    requests: DataFrame,
    sys_info: DataFrame,
    ring_buffer: DataFrame,
    suspect_pages: DataFrame,
    file_space: DataFrame,
    log_info: DataFrame | None = None,
) -> DataFrame:
    """The scalar vitals of every server, one row per metric.

    One aggregate per input, joined by server, then unpivoted. Counts of
    nothing are 0; a metric without a source (``log_info`` is optional, a
    counter may be missing) is left out.
    """
    counter = F.col("counter_name")
    value = F.col("cntr_value").cast("double")
    ple = (counter == "Page life expectancy") & F.col("object_name").like("%:Buffer Manager%")
    deadlocks = (counter == "Number of Deadlocks/sec") & (F.col("instance_name") == "_Total")
    pages = [
        "user_object_reserved_page_count",
        "internal_object_reserved_page_count",
        "version_store_reserved_page_count",
        "mixed_extent_page_count",
    ]

    def pages_gb(total):
        return (total * 8).cast("double") / F.lit(1048576)

    frames = [
        counters.groupBy(S).agg(
            F.max(F.when(ple, value)).alias("page_life_expectancy"),
            F.max(F.when(counter == "Memory Grants Pending", value)).alias("memory_grants_pending"),
            F.max(F.when(deadlocks, value)).alias("deadlocks_total"),
        ),
        sessions.groupBy(S).agg(F.count_if("is_user_process").alias("user_sessions")),
        requests.groupBy(S).agg(F.count_if(F.col("blocking_session_id") != 0).alias("blocked_sessions")),
        sys_info.groupBy(S).agg(
            boundary_diff("hour", F.max("sqlserver_start_time"), ts_lit(as_of)).alias("uptime_hours")
        ),
        extract_cpu_pct(ring_buffer),
        suspect_pages.groupBy(S).agg(F.count(F.lit(1)).alias("suspect_pages")),
        file_space.groupBy(S).agg(
            pages_gb(F.sum(reduce(lambda a, b: a + b, map(F.col, pages)))).alias("tempdb_used_gb"),
            pages_gb(F.sum(pages[2])).alias("tempdb_version_store_gb"),
        ),
    ]
    metrics = {  # metric -> counts as zero when nothing was found
        "page_life_expectancy": False,
        "memory_grants_pending": False,
        "user_sessions": True,
        "blocked_sessions": True,
        "uptime_hours": False,
        "cpu_pct": True,
        "suspect_pages": True,
        "deadlocks_total": True,
        "tempdb_used_gb": True,
        "tempdb_version_store_gb": True,
    }
    if log_info is not None:
        per_db = log_info.groupBy(S, "database_id").agg(F.count(F.lit(1)).alias("_n"))
        frames.append(per_db.groupBy(S).agg(F.max("_n").alias("max_vlf_count")))
        metrics["max_vlf_count"] = True
    wide = reduce(lambda a, b: a.join(b, S, "left"), frames, servers.select(S).distinct())
    zero = F.lit(0.0)
    as_double = {m: F.col(m).cast("double") for m in metrics}
    wide = wide.select(S, *[(F.coalesce(c, zero) if metrics[m] else c).alias(m) for m, c in as_double.items()])
    long = wide.unpivot(S, list(metrics), "MetricName", "MetricValue").filter("MetricValue IS NOT NULL")
    return long.withColumn("Detail", F.lit(None).cast("string"))


def extract_activity(
    requests: DataFrame, sessions: DataFrame, texts: DataFrame, as_of, source_tz: str = "UTC"
) -> DataFrame:
    """Requests of user sessions that are blocked or run longer than a minute; ``start_time`` is local to ``source_tz``."""
    running = boundary_diff("second", _to_utc(F.col("start_time"), source_tz), ts_lit(as_of))
    picked = requests.withColumn("DurationSec", running).filter(
        (F.col("blocking_session_id") != 0) | (F.col("DurationSec") > 60)
    )
    users = sessions.filter("is_user_process").select(S, "session_id", "login_name", "host_name", "program_name")
    rows = picked.join(users, [S, "session_id"], "inner")
    rows = rows.join(texts.select(S, "sql_handle", "text"), [S, "sql_handle"], "left")
    return rows.select(
        S,
        F.col("session_id").alias("SessionID"),
        F.col("blocking_session_id").alias("BlockedBy"),
        F.col("status").alias("Status"),
        F.col("wait_type").alias("WaitType"),
        "DurationSec",
        F.col("database_name").alias("DatabaseName"),
        F.col("login_name").alias("LoginName"),
        F.col("host_name").alias("HostName"),
        F.substring("program_name", 1, 160).alias("ProgramName"),
        F.substring("text", 1, 500).alias("QueryText"),
    )


def extract_waits(wait_stats: DataFrame, n: int = 10, benign=K.BENIGN_WAITS) -> DataFrame:
    """The ``n`` heaviest waits per server; shares are of all waits that are not benign."""
    waits = wait_stats.filter(~F.col("wait_type").isin(list(benign)) & (F.col("wait_time_ms") > 0)).select(
        S, F.col("wait_type").alias("WaitType"), F.col("wait_time_ms").alias("WaitTimeMs")
    )
    ranked = top_k(total_per_key(waits, "WaitTimeMs"), n, F.desc("WaitTimeMs"), F.asc("WaitType"))
    return ranked.withColumn("WaitPct", percent_of("WaitTimeMs", "_total", 5, 1)).drop("_total")


def extract_top_queries(stats: DataFrame, texts: DataFrame, as_of, n: int = 10, source_tz: str = "UTC") -> DataFrame:
    """The ``n`` statements per server with most CPU among those run in the last day.

    Ranked on numbers and handles alone; texts are fetched for the winners.
    """
    stats = stats.withColumn("last_execution_time", _to_utc(F.col("last_execution_time"), source_tz))
    recent = stats.filter(F.col("last_execution_time") > ts_lit(as_of, days=-1))
    known = recent.join(texts.select(S, "sql_handle"), [S, "sql_handle"], "left_semi")
    top = top_k(known, n, F.desc("total_worker_time"), F.asc("sql_handle"))
    rows = texts.select(S, "sql_handle", "database_name", "text").join(top, [S, "sql_handle"], "inner")

    def per_run(c, then=""):
        return F.expr(f"{c} div nullif(execution_count, 0) {then}")

    return rows.select(
        S,
        F.col("database_name").alias("DatabaseName"),
        F.substring("text", 1, 500).alias("QueryText"),
        F.col("execution_count").alias("ExecCount"),
        F.expr("total_worker_time div 1000").alias("TotalCpuMs"),
        per_run("total_worker_time", "div 1000").alias("AvgCpuMs"),
        per_run("total_elapsed_time", "div 1000").alias("AvgDurMs"),
        per_run("total_logical_reads").alias("AvgReads"),
        F.col("last_execution_time").alias("LastExec"),
    )


def extract_failed_logins(logs, as_of, source_tz: str = "UTC") -> DataFrame:
    """Failed logins of the last 24 hours from the current and the previous error log.

    Leave out a log that cannot be read; it contributes no rows.
    """
    rows = reduce(DataFrame.unionByName, [log.select(S, "LogDate", "LogText") for log in logs])
    rows = rows.withColumn("LogDate", _to_utc(F.col("LogDate"), source_tz))
    rows = rows.filter(F.col("LogText").contains("Login failed") & (F.col("LogDate") > ts_lit(as_of, hours=-24)))
    return rows.select(S, F.col("LogDate").alias("EventTime"), F.substring("LogText", 1, 500).alias("Message"))


def extract_logins(sessions: DataFrame) -> DataFrame:
    """User sessions per login, host and program."""
    return (
        sessions.filter("is_user_process")
        .groupBy(
            S,
            F.col("login_name").alias("LoginName"),
            F.col("host_name").alias("HostName"),
            F.substring("program_name", 1, 160).alias("ProgramName"),
        )
        .agg(F.count(F.lit(1)).alias("SessionCount"), F.max("login_time").alias("LastLogin"))
    )
