"""Operators against brute force, including hot keys."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import latest
from fleetlens.operators.ranking import top_k, total_per_key
from fleetlens.operators.reconcile import one_per_key, reconcile
from fleetlens.plans.extract_mssql import extract_activity, extract_ag_lag
from fleetlens.plans.forecast import disk_forecast
from fleetlens.schemas import struct

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def series(spark):
    """A third of all rows belong to one server; times tie; one key is NULL."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        server = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", None])
        rows.append((i, START + timedelta(minutes=15 * rng.randrange(40)), server, f"m{rng.randrange(5)}", rng.random()))
    schema = "SnapshotID bigint, CollectedAt timestamp_ntz, ServerName string, MetricName string, v double"
    return spark.createDataFrame(rows, schema).repartition(6)


@pytest.fixture(scope="module")
def dated(series):
    return series.withColumn(latest.SNAPSHOT_DATE, F.to_date("CollectedAt"))


def brute_latest(rows, keys):
    best = {}
    for r in rows:
        k = tuple(r[c] for c in keys)
        if k not in best or (r.CollectedAt, r.SnapshotID) > (best[k].CollectedAt, best[k].SnapshotID):
            best[k] = r
    return sorted(r.SnapshotID for r in best.values())


def ids(df):
    return sorted(r.SnapshotID for r in df.select("SnapshotID").collect())


def test_latest_row(series, dated):
    keys = ["ServerName", "MetricName"]
    want = brute_latest(series.collect(), keys)
    for df in (series, dated):
        got = latest.latest_row(df, keys, tie="SnapshotID")
        assert got.columns == df.columns
        assert ids(got) == want


def test_latest_cycle(series, dated):
    rows = series.collect()
    newest = {}
    for r in rows:
        newest[r.ServerName] = max(newest.get(r.ServerName, START), r.CollectedAt)
    want = sorted(r.SnapshotID for r in rows if r.CollectedAt == newest[r.ServerName])
    assert ids(latest.latest_cycle(series)) == want
    assert ids(latest.latest_cycle(dated)) == want


@pytest.mark.parametrize("n", [1, 2, 3])
def test_nth_cycle(dated, n):
    rows = dated.collect()
    times = {}
    for r in rows:
        times.setdefault(r.ServerName, set()).add(r.CollectedAt)
    nth = {k: sorted(v, reverse=True)[n - 1] for k, v in times.items()}
    want = sorted(r.SnapshotID for r in rows if r.CollectedAt == nth[r.ServerName])
    assert ids(latest.nth_cycle(dated, n=n)) == want


def test_rows_without_a_time_come_last(spark):
    """A key whose times are all NULL keeps its row; NULL never beats a time."""
    rows = [(1, None, "a"), (2, START, "a"), (3, None, "b")]
    df = spark.createDataFrame(rows, "SnapshotID bigint, CollectedAt timestamp_ntz, ServerName string")
    assert ids(latest.latest_row(df, ["ServerName"], tie="SnapshotID")) == [2, 3]
    assert ids(latest.latest_cycle(df)) == [2, 3]


@pytest.mark.parametrize("threshold", ["64m", "-1", "10485760b"])
def test_any_broadcast_setting_gives_the_same_rows(spark, series, threshold):
    want = ids(latest.latest_cycle(series))
    runs = series.select("ServerName", "CollectedAt")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        assert ids(latest.latest_cycle(series, cycles=runs)) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty_newest_cycle(spark, series):
    runs = spark.createDataFrame([("a", START + timedelta(days=9))], "ServerName string, CollectedAt timestamp_ntz")
    got = {r.ServerName for r in latest.latest_cycle(series, cycles=runs).collect()}
    assert "a" not in got and {"b", "c", "hot"} <= got


def test_top_k_and_totals(series):
    rows = [r for r in series.collect() if r.ServerName]
    named = series.filter("ServerName IS NOT NULL")
    want = []
    for s in {r.ServerName for r in rows}:
        mine = sorted((r for r in rows if r.ServerName == s), key=lambda r: -r.v)
        want += [r.SnapshotID for r in mine[:7]]
    assert ids(top_k(named, 7, F.desc("v"))) == sorted(want)
    totals = {r.ServerName: r._total for r in total_per_key(named.withColumn("n", F.lit(1)), "n").collect()}
    assert totals["hot"] == 1000


# -------------------------------------------------------------------- reconcile


def alert_rows(spark, *rows):
    return spark.createDataFrame(rows, struct("AlertHistory"))


def current_rows(spark, *rows):
    return spark.createDataFrame(rows, "AlertKey string, Category string, Severity string, ServerName string, Message string")


T0, T1 = datetime(2024, 1, 1), datetime(2024, 1, 2)


def test_reconcile_cases(spark):
    prev = alert_rows(
        spark,
        ("stays", "A", "WARN", "s", "old", T0, T0, T0, False, None),
        ("gone", "A", "CRIT", "s", "old", T0, T0, None, False, None),
        ("back", "A", "CRIT", "s", "old", T0, T0, None, True, T0),
        ("closed", "A", "CRIT", "s", "old", T0, T0, None, True, T0),
    )
    cur = current_rows(
        spark,
        ("stays", "B", "CRIT", "x", "new"),
        ("back", "A", "WARN", "s", "again"),
        ("fresh", "A", "WARN", "s", "m2"),
        ("fresh", "A", "CRIT", "s", "m3"),
        ("fresh", "A", "CRIT", "s", "m1"),
    )
    out = reconcile(prev, cur, "AlertKey", T1, ["Severity", "Message"], "Message")
    assert out.columns == prev.columns
    got = sorted(
        (r.AlertKey, r.Category, r.Severity, r.Message, r.FirstSeen, r.LastSeen, r.NotifiedAt, r.Resolved, r.ResolvedAt)
        for r in out.collect()
    )
    assert got == sorted(
        [
            ("stays", "A", "CRIT", "new", T0, T1, T0, False, None),
            ("gone", "A", "CRIT", "old", T0, T0, None, True, T1),
            ("back", "A", "CRIT", "old", T0, T0, None, True, T0),
            ("back", "A", "WARN", "again", T1, T1, None, False, None),
            ("closed", "A", "CRIT", "old", T0, T0, None, True, T0),
            ("fresh", "A", "CRIT", "m1", T1, T1, None, False, None),
        ]
    )
    again = reconcile(out, cur, "AlertKey", T1, ["Severity", "Message"], "Message")
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))
    open_keys = [r.AlertKey for r in out.filter("NOT Resolved").collect()]
    assert len(open_keys) == len(set(open_keys))


def test_reconcile_scope(spark):
    prev = alert_rows(
        spark,
        ("mine", "A", "WARN", "s", "m", T0, T0, None, False, None),
        ("other", "B", "WARN", "s", "m", T0, T0, None, False, None),
        ("none", None, "WARN", "s", "m", T0, T0, None, False, None),
    )
    out = reconcile(prev, current_rows(spark), "AlertKey", T1, [], "Message", scope=F.col("Category") == "A")
    assert {r.AlertKey: r.Resolved for r in out.collect()} == {"mine": True, "other": False, "none": False}


def test_one_per_key(spark):
    cur = current_rows(spark, ("k", "A", "WARN", "s", "a"), ("k", "A", "CRIT", "s", "z"), ("k", "A", "CRIT", "s", "b"))
    assert [r.Message for r in one_per_key(cur, "AlertKey", "Message").collect()] == ["b"]


# -------------------------------------------------------------------- plans


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_pass_read_limits_before_the_shuffle(dated):
    text = plan(latest.latest_row(dated, ["ServerName"], tie="SnapshotID"))
    exchange = text.index("Exchange")
    assert "WindowGroupLimit" in text[exchange:], "the partial limit runs on the map side"


# --------------------------------------------------------------- clusters, zones, replays


def test_lag_pairs_replicas_of_one_instance(spark):
    """Two clusters with one group and database name: each secondary against its own primary."""
    rows = [
        ("c1", "AG1", "App", "r1", True, START, 0), ("c1", "AG1", "App", "r2", False, START - timedelta(seconds=2), 5),
        ("c2", "AG1", "App", "r3", True, START + timedelta(hours=3), 0),
        ("c2", "AG1", "App", "r4", False, START + timedelta(hours=3) - timedelta(seconds=7), 0),
    ]
    schema = (
        "ServerName string, AGName string, DatabaseName string, ReplicaServer string, IsPrimary boolean, "
        "LastCommitTime timestamp_ntz, RedoQueueKB bigint"
    )
    got = {r.ServerName: r.LagSeconds for r in extract_ag_lag(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"c1": 2, "c2": 7}


def test_local_times_of_servers_become_utc(spark):
    """A server five hours behind UTC: its request has run for ninety seconds, not for five hours."""
    local = START - timedelta(hours=5)
    requests = spark.createDataFrame(
        [("s", 1, 0, "running", "x", local - timedelta(seconds=90), "db", 7)],
        "ServerName string, session_id bigint, blocking_session_id bigint, status string, wait_type string, "
        "start_time timestamp_ntz, database_name string, sql_handle bigint",
    )
    sessions = spark.createDataFrame(
        [("s", 1, True, "l", "h", "p")],
        "ServerName string, session_id bigint, is_user_process boolean, login_name string, host_name string, program_name string",
    )
    texts = spark.createDataFrame([("s", 7, "select 1")], "ServerName string, sql_handle bigint, text string")
    got = extract_activity(requests, sessions, texts, START, source_tz="America/Bogota").collect()
    assert [r.DurationSec for r in got] == [90]


def test_forecast_of_a_past_day_does_not_see_later_rows(spark):
    rows = [(START + timedelta(days=d), "MSSQL", "s", "c:", 1000 * 2**30, (100 + d) * 2**30) for d in range(-10, 10)]
    schema = "CollectedAt timestamp_ntz, Platform string, ServerName string, VolumeName string, TotalBytes bigint, UsedBytes bigint"
    got = disk_forecast(spark.createDataFrame(rows, schema), START).first()
    assert got.UsedBytes == 100 * 2**30 and got.DaysToFull == 900


def test_building_a_query_runs_no_job(spark):
    """But the reading of file schemas: stages already run stay the only ones."""
    from fleetlens.catalog.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    tracker = spark.sparkContext.statusTracker()
    for name in ("report_overview", "extract_lock_waits", "extract_query_cost", "audit_config", "report_wait_delta"):
        spark.sparkContext.setJobGroup(f"build-{name}", name)
        QUERIES[name](spark, folder)
        jobs = tracker.getJobIdsForGroup(f"build-{name}")
        stages = [s for j in jobs for s in tracker.getJobInfo(j).stageIds]
        assert all(tracker.getStageInfo(s).numTasks == 1 for s in stages), name
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0
