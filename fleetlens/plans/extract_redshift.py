"""Redshift evidence from landed system tables of many clusters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import constants as K
from fleetlens.functions.expressions import boundary_diff, nullif, ts_lit
from fleetlens.operators.ranking import top_k

S = "ServerName"
MIB = 1048576


def _null_text(name: str):
    return F.lit(None).cast("string").alias(name)


def table_name():
    """``schema.table`` from blank-padded names."""
    return F.concat(F.trim("schema"), F.lit("."), F.trim("table"))


def _primary(partitions: DataFrame) -> DataFrame:
    """One row per physical partition."""
    return partitions.filter(F.col("part_begin") == 0)


def extract_rs_disk(partitions: DataFrame) -> DataFrame:
    """Capacity and use of each cluster from 1 MiB blocks."""
    return (
        _primary(partitions)
        .groupBy(S)
        .agg(
            (F.sum(F.col("capacity").cast("bigint")) * MIB).alias("TotalBytes"),
            (F.sum(F.col("used").cast("bigint")) * MIB).alias("UsedBytes"),
        )
        .select(S, F.lit("cluster").alias("VolumeName"), "TotalBytes", "UsedBytes")
    )


def extract_freshness(inserts: DataFrame, queries: DataFrame, tables: DataFrame, as_of) -> DataFrame:
    """Seconds since the newest load into each table, loads of the last two days.

    Loads are reduced to one row per table before table names are attached.
    """
    recent = queries.filter(F.col("endtime") > ts_lit(as_of, days=-2)).select(S, "query", "endtime")
    per_table = (
        inserts.select(S, "query", "tbl")
        .distinct()  # a load writes a table in many steps
        .join(recent, [S, "query"], "inner")
        .groupBy(S, F.col("tbl").alias("id"))
        .agg(F.max("endtime").alias("_last"))
    )
    named = per_table.join(tables.select(S, "id", "name").distinct(), [S, "id"], "inner")
    newest = named.groupBy(S, F.trim("name").alias("ObjectName")).agg(F.max("_last").alias("_last"))
    return newest.select(
        S,
        "ObjectName",
        boundary_diff("second", "_last", ts_lit(as_of)).alias("LagSeconds"),
        F.lit("load_freshness").alias("Metric"),
        _null_text("Detail"),
    )


def extract_table_size(table_info: DataFrame) -> DataFrame:
    return table_info.select(
        S,
        F.lit("table").alias("ObjectType"),
        table_name().alias("ObjectName"),
        (F.col("size").cast("bigint") * MIB).alias("SizeBytes"),
    )


def extract_table_health(table_info: DataFrame, n: int = 100, floor: float = 10) -> DataFrame:
    """The ``n`` tables per cluster with most maintenance debt."""
    rows = table_info.select(
        S,
        table_name().alias("TableName"),
        F.coalesce("unsorted", F.lit(0)).alias("UnsortedPct"),
        F.coalesce("stats_off", F.lit(0)).alias("StatsOffPct"),
        F.col("tbl_rows").cast("bigint").alias("TableRows"),
    )
    worst = F.greatest("UnsortedPct", "StatsOffPct")
    return top_k(rows.filter(worst >= floor), n, worst.desc(), F.asc("TableName"))


def extract_rs_activity(recents: DataFrame) -> DataFrame:
    """Queries running longer than a minute (durations are microseconds)."""
    rows = recents.filter((F.rtrim("status") == "Running") & (F.col("duration") > 60_000_000))
    return rows.select(
        S,
        F.col("pid").alias("SessionID"),
        F.lit(0).cast("bigint").alias("BlockedBy"),
        F.trim("status").alias("Status"),
        _null_text("WaitType"),
        F.expr("duration div 1000000").alias("DurationSec"),
        F.trim("db_name").alias("DatabaseName"),
        F.trim("user_name").alias("LoginName"),
        _null_text("HostName"),
        _null_text("ProgramName"),
        F.substring("query", 1, 500).alias("QueryText"),
    )


def extract_rs_vitals(
    servers: DataFrame, wlm: DataFrame, sessions: DataFrame, load_errors: DataFrame, as_of
) -> DataFrame:
    """Queued queries, connections and load errors of the last day, zero where there are none."""
    counted = [
        ("queued_queries", wlm.filter(F.col("state").like("Queued%"))),
        ("db_connections", sessions),
        ("load_errors_24h", load_errors.filter(F.col("starttime") > ts_lit(as_of, days=-1))),
    ]
    rows = [df.groupBy(S).agg(F.count(F.lit(1)).alias(m)) for m, df in counted]
    wide = reduce(lambda a, b: a.join(b, S, "left"), rows, servers.select(S).distinct())
    names = [m for m, _ in counted]
    wide = wide.select(S, *[F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(m) for m in names])
    return wide.unpivot(S, names, "MetricName", "MetricValue").withColumn("Detail", F.lit(None).cast("string"))


def extract_table_scan(scans: DataFrame, table_info: DataFrame) -> DataFrame:
    """When a user query last read each table."""
    last = (
        scans.filter(F.col("userid") > 1)
        .groupBy(S, F.col("tbl").alias("table_id"))
        .agg(F.max("endtime").alias("LastScanned"))
    )
    rows = last.join(table_info.select(S, "table_id", table_name().alias("TableName")), [S, "table_id"], "inner")
    return rows.groupBy(S, "TableName").agg(F.max("LastScanned").alias("LastScanned"))


def extract_spectrum(s3_summary: DataFrame, as_of, n: int = 50) -> DataFrame:
    """External scans of the last day: the ``n`` tables per cluster with most bytes."""
    name = F.coalesce(nullif(F.trim("external_table_name"), ""), F.lit("(unknown)"))
    rows = (
        s3_summary.filter(F.col("starttime") > ts_lit(as_of, days=-1))
        .groupBy(S, name.alias("ExternalTable"))
        .agg(
            F.countDistinct("query").alias("QueryCount"),
            (F.sum("s3_scanned_bytes").cast("double") / F.lit(1e12)).alias("TBScanned"),
        )
    )
    return top_k(rows, n, F.desc("TBScanned"), F.asc("ExternalTable"))


def extract_rs_logins(connection_log: DataFrame, as_of) -> DataFrame:
    """Failed authentications of the last day."""
    rows = connection_log.filter(
        (F.rtrim("event") == "authentication failure") & (F.col("recordtime") > ts_lit(as_of, days=-1))
    )
    text = F.concat(F.lit("Failed auth: user="), F.trim("username"), F.lit(" from "), F.trim("remotehost"))
    return rows.select(S, F.col("recordtime").alias("EventTime"), F.substring(text, 1, 500).alias("Message"))


#: fragments of a query text joined in one step; longer texts are joined in two
FRAGMENTS = 1000


def joined_text(texts: DataFrame) -> DataFrame:
    """Whole query texts from numbered fragments.

    Runs of fragments are joined first, then the runs, so that the fragments
    of one very long text are sorted and joined by many tasks.
    """
    runs = texts.withColumn("_run", F.expr(f"sequence div {FRAGMENTS}")).groupBy(S, "query", "_run")
    part = runs.agg(F.expr("listagg(text, '') WITHIN GROUP (ORDER BY sequence)").alias("_part"))
    return part.groupBy(S, "query").agg(F.expr("listagg(_part, '') WITHIN GROUP (ORDER BY _run)").alias("text"))


def extract_query_cost(
    s3: DataFrame, scans: DataFrame, queries: DataFrame, texts: DataFrame, users: DataFrame, as_of, n: int = 25
) -> DataFrame:
    """The ``n`` most expensive queries per cluster of the last day.

    Scans are reduced to one row per query, queries are ranked on numbers, and
    user names and texts are fetched for the winners only.
    """
    day = F.col("starttime") > ts_lit(as_of, days=-1)
    external = s3.filter(day).groupBy(S, "query").agg(F.sum("s3_scanned_bytes").alias("_s3"))
    local = scans.filter(day & (F.col("userid") > 1)).groupBy(S, "query").agg(F.sum("bytes").alias("_scan"))
    cost = (F.coalesce(F.col("_s3"), F.lit(0)).cast("decimal(20,0)") * F.lit(str(K.EXTERNAL_SCAN_USD_PER_TB)).cast(
        "decimal(2,1)"
    ) / F.lit(10**12).cast("decimal(13,0)")).cast("decimal(12,2)")

    def mib(c):
        amount = F.coalesce(F.col(c), F.lit(0)).cast("decimal(20,0)")
        return (amount / F.lit(MIB).cast("decimal(7,0)")).cast("decimal(18,1)")

    ran = (
        queries.filter(day & (F.col("userid") > 1))
        .select(S, "query", "userid", "starttime", "endtime")
        .join(external, [S, "query"], "left")
        .join(local, [S, "query"], "left")
        .filter("coalesce(_s3, 0) > 0 OR coalesce(_scan, 0) > 0")
        .select(
            S, "query", "userid", F.col("starttime").alias("StartTime"),
            boundary_diff("second", "starttime", "endtime").alias("ElapsedSec"),
            mib("_scan").alias("ScanMB"), mib("_s3").alias("SpectrumMB"), cost.alias("EstCostUSD"),
        )
    )
    top = top_k(ran, n, F.desc("EstCostUSD"), F.desc("ScanMB"), F.asc("query"))
    wanted = texts.join(top.select(S, "query"), [S, "query"], "left_semi")
    rows = top.join(joined_text(wanted), [S, "query"], "left")
    rows = rows.join(users.select(S, F.col("usesysid").alias("userid"), "usename"), [S, "userid"], "left")
    return rows.select(
        S, F.col("query").alias("QueryId"), F.trim("usename").alias("UserName"), "StartTime", "ElapsedSec", "ScanMB",
        "SpectrumMB", "EstCostUSD", F.substring(F.trim("text"), 1, 500).alias("QueryText"),
    )


def extract_lock_waits(
    transactions: DataFrame,
    classes: DataFrame,
    recents: DataFrame,
    inflight: DataFrame,
    conflicts: DataFrame,
    as_of,
    min_minutes: int = 5,
) -> DataFrame:
    """Each waiter with the oldest other session that holds its relation.

    Waiters and holders of a relation are never paired one by one. Per relation
    only the two oldest holding sessions matter: the oldest, and the next one
    for a waiter that is itself the oldest. That is one row per relation, to
    which waiters are joined.
    """
    relation = [S, "relation"]
    trx = transactions.select(S, "pid", "relation", "granted", "txn_start", "txn_owner", "lock_mode")
    per_session = (
        trx.filter("granted")
        .groupBy(*relation, "pid")
        .agg(F.min(F.struct("txn_start", "txn_owner", "lock_mode")).alias("h"))
        .select(*relation, F.struct("h.txn_start", "pid", "h.txn_owner", "h.lock_mode").alias("h"))
    )
    oldest = top_k(per_session, 2, F.asc("h.txn_start"), F.asc("h.pid"), per=relation)
    holders = oldest.groupBy(*relation).agg(F.min("h").alias("first"), F.max("h").alias("second"))
    waiters = (
        trx.filter(~F.col("granted"))
        .groupBy(*relation, "pid")
        .agg(F.min(F.struct("txn_start", "txn_owner")).alias("w"))
        .withColumn("wait_minutes", boundary_diff("minute", F.col("w.txn_start"), ts_lit(as_of)))
        .filter(F.col("wait_minutes") >= min_minutes)
    )
    blocker = F.when(F.col("first.pid") != F.col("pid"), F.col("first")).when(
        F.col("second.pid") != F.col("pid"), F.col("second")
    )
    pairs = waiters.join(holders, relation, "inner").withColumn("b", blocker).filter("b IS NOT NULL")
    pairs = pairs.withColumn("blocker_pid", F.col("b.pid"))

    running = (
        recents.filter(F.rtrim("status") == "Running").groupBy(S, "pid").agg(F.max("query").alias("waiter_sql"))
    )
    active = inflight.groupBy(S, F.col("pid").alias("blocker_pid")).agg(
        F.max("text").alias("blocker_sql"), F.lit(True).alias("_active")
    )
    aborted = (
        conflicts.filter(F.col("xact_start_ts") > ts_lit(as_of, days=-1))
        .groupBy(S, F.col("table_id").alias("relation"))
        .agg(F.count(F.lit(1)).alias("_conflicts"))
    )
    names = classes.select(S, F.col("oid").alias("relation"), "relname")
    pairs = pairs.join(names, relation, "left")
    pairs = pairs.join(running, [S, "pid"], "left")
    pairs = pairs.join(active, [S, "blocker_pid"], "left")
    pairs = pairs.join(aborted, relation, "left")
    return pairs.select(
        S,
        F.col("pid").alias("WaiterPid"),
        F.trim("w.txn_owner").alias("WaiterUser"),
        F.coalesce(F.trim("relname"), F.col("relation").cast("string")).alias("Relation"),
        F.col("wait_minutes").alias("WaitMinutes"),
        F.substring(F.trim("waiter_sql"), 1, 500).alias("WaiterQuery"),
        F.col("blocker_pid").alias("BlockerPid"),
        F.trim("b.txn_owner").alias("BlockerUser"),
        F.trim("b.lock_mode").alias("BlockerLockMode"),
        F.when(F.col("_active").isNull(), 1).otherwise(0).cast("tinyint").alias("BlockerIdleInTxn"),
        F.substring(F.trim("blocker_sql"), 1, 500).alias("BlockerQuery"),
        F.coalesce("_conflicts", F.lit(0)).alias("ConflictCount24h"),
    )


def extract_cost_drivers(
    servers: DataFrame,
    s3: DataFrame,
    query_history: DataFrame,
    partitions: DataFrame,
    as_of,
    serverless: DataFrame | None = None,
) -> DataFrame:
    """The cost drivers of the last day: external TB, scanned TB, stored GB, optionally RPU hours."""
    cut = ts_lit(as_of, days=-1)

    def total(df, value, name, divisor, scale, unit):
        amount = F.sum(value).cast("decimal(28,0)") / F.lit(divisor).cast("decimal(13,0)")
        return df.groupBy(S).agg(amount.cast(f"decimal(20,{scale})").alias(name)), name, unit

    parts = [
        total(s3.filter(F.col("starttime") > cut), F.col("s3_scanned_bytes"), "spectrum_tb_1d", 10**12, 4, "TB"),
        total(
            query_history.filter(F.col("start_time") > cut),
            F.col("scan_size_bytes"), "bytes_scanned_tb_1d", 10**12, 4, "TB",
        ),
        total(_primary(partitions), F.col("used"), "storage_gb", 1024, 1, "GB"),
    ]
    if serverless is not None:
        used = F.col("charged_seconds") * F.col("compute_capacity")
        parts.append(
            total(serverless.filter(F.col("end_time") > cut), used, "serverless_rpu_hours_1d", 3600, 3, "RPU-hr")
        )
    wide = reduce(lambda a, p: a.join(p[0], S, "left"), parts, servers.select(S).distinct())
    units = F.create_map(*[F.lit(x) for _, name, unit in parts for x in (name, unit)])
    # storage without partitions is unknown, scans without rows are zero
    values = [
        (F.col(n) if n == "storage_gb" else F.coalesce(F.col(n), F.lit(0))).cast("double").alias(n) for _, n, _ in parts
    ]
    long = wide.select(S, *values).unpivot(S, [n for _, n, _ in parts], "MetricName", "MetricValue")
    return long.filter("MetricValue IS NOT NULL").withColumn("MetricUnit", units[F.col("MetricName")])
