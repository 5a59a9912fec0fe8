"""Hand-written cases on both sides of every threshold."""

from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fleetlens.plans import audit, reports
from fleetlens.plans import extract_mssql as M
from fleetlens.plans import extract_redshift as X
from fleetlens.plans.alerts import (
    current_conditions,
    evaluate_alerts,
    mark_notified,
    notification_digest,
    notification_outbox,
    notification_recipients,
)
from fleetlens.plans.anomaly import cost_anomaly
from fleetlens.plans.findings import generate_findings, lock_findings
from fleetlens.plans.forecast import disk_forecast
from fleetlens.schemas import TABLES, empty, struct
from fleetlens.sources import inventory

NOW = datetime(2024, 1, 31, 12, 0, 0)


def ago(**k):
    return NOW - timedelta(**k)


def table(spark, name, *rows, **common):
    """A frame of ``name`` from dicts; columns left out are NULL."""
    columns = list(TABLES[name])
    return spark.createDataFrame([tuple({**common, **r}.get(c) for c in columns) for r in rows], struct(name))


def by(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_ag_status(spark):
    cases = [
        ("HEALTHY", "SYNCHRONIZED", "OK"), ("HEALTHY", "SYNCHRONIZING", "OK"), ("HEALTHY", "NOT SYNCHRONIZING", "CRIT"),
        ("PARTIALLY_HEALTHY", "SYNCHRONIZED", "WARN"), ("NOT_HEALTHY", "SYNCHRONIZED", "CRIT"), (None, None, "CRIT"),
    ]
    ag = table(
        spark, "AGSyncStatus",
        *[{"DatabaseName": f"d{i}", "SyncHealth": h, "SyncState": s} for i, (h, s, _) in enumerate(cases)],
        CollectedAt=NOW, AGName="ag", ReplicaServer="r",
    )
    got = by(reports.ag_sync_status(ag), "DatabaseName", "Status")
    assert got == {f"d{i}": want for i, (_, _, want) in enumerate(cases)}


def test_lag_status(spark):
    cases = {None: "WARN", -5: "OK", 0: "OK", 60: "OK", 61: "WARN", 900: "WARN", 901: "CRIT"}
    lag = table(
        spark, "DataLag", *[{"ObjectName": str(s), "LagSeconds": s} for s in cases], CollectedAt=NOW, Platform="MSSQL",
        ServerName="s", Metric="m",
    )
    out = reports.data_lag(lag)
    assert by(out, "ObjectName", "Status") == {str(k): v for k, v in cases.items()}
    assert by(out, "ObjectName", "LagMinutes")["901"] == Decimal("15.0")


def test_backup_rules(spark):
    fresh = {"LastFullBackup": ago(hours=1), "LastLogBackup": ago(minutes=5), "LastGoodCheckDb": ago(days=1),
             "StateDesc": "ONLINE", "RecoveryModel": "FULL", "PageVerify": "CHECKSUM", "IsAutoShrink": False}
    cases = {
        "fresh": ({}, "OK"),
        "offline": ({"StateDesc": "OFFLINE"}, "CRIT"),
        "no_full": ({"LastFullBackup": None}, "CRIT"),
        "full_7d": ({"LastFullBackup": ago(days=7)}, "WARN"),
        "full_over_7d": ({"LastFullBackup": ago(days=7, seconds=1)}, "CRIT"),
        "full_2d": ({"LastFullBackup": ago(days=2)}, "OK"),
        "full_over_2d": ({"LastFullBackup": ago(days=2, seconds=1)}, "WARN"),
        "no_log": ({"LastLogBackup": None}, "CRIT"),
        "no_log_simple": ({"LastLogBackup": None, "RecoveryModel": "SIMPLE"}, "OK"),
        "master": ({"LastLogBackup": None}, "OK"),
        "log_6h": ({"LastLogBackup": ago(hours=6)}, "WARN"),
        "log_over_6h": ({"LastLogBackup": ago(hours=6, seconds=1), "RecoveryModel": "BULK_LOGGED"}, "CRIT"),
        "log_1h": ({"LastLogBackup": ago(hours=1)}, "OK"),
        "log_over_1h": ({"LastLogBackup": ago(hours=1, seconds=1)}, "WARN"),
        "check_30d": ({"LastGoodCheckDb": ago(days=30)}, "OK"),
        "check_over_30d": ({"LastGoodCheckDb": ago(days=30, seconds=1)}, "WARN"),
        "never_checked": ({"LastGoodCheckDb": datetime(1900, 1, 1)}, "WARN"),
        "torn": ({"PageVerify": "TORN_PAGE_DETECTION"}, "WARN"),
        "verify_unknown": ({"PageVerify": None}, "OK"),
        "shrink": ({"IsAutoShrink": True}, "WARN"),
    }
    bk = table(
        spark, "BackupStatus", *[{**fresh, "DatabaseName": n, **c} for n, (c, _) in cases.items()], CollectedAt=NOW,
        ServerName="s",
    )
    out = reports.backup_health(bk, NOW)
    assert by(out, "DatabaseName", "Status") == {n: want for n, (_, want) in cases.items()}
    row = {r.DatabaseName: r for r in out.collect()}
    assert row["never_checked"].LastGoodCheckDb is None
    assert row["no_log_simple"].MinsSinceLog is None and row["fresh"].MinsSinceLog == 5
    assert row["full_2d"].HoursSinceFull == 48


def test_vitals_thresholds(spark):
    cases = [
        ("page_life_expectancy", 99, "CRIT"), ("page_life_expectancy", 100, "WARN"), ("page_life_expectancy", 300, "OK"),
        ("memory_grants_pending", 0, "OK"), ("memory_grants_pending", 1, "WARN"), ("memory_grants_pending", 5, "CRIT"),
        ("blocked_sessions", 0, "OK"), ("blocked_sessions", 4, "WARN"), ("blocked_sessions", 5, "CRIT"),
        ("queued_queries", 1, "WARN"), ("load_errors_24h", 1, "WARN"), ("suspect_pages", 1, "CRIT"),
        ("cpu_pct", 79.9, "OK"), ("cpu_pct", 80, "WARN"), ("cpu_pct", 95, "CRIT"),
        ("tempdb_version_store_gb", 49, "OK"), ("tempdb_version_store_gb", 50, "WARN"),
        ("tempdb_version_store_gb", 150, "CRIT"), ("max_vlf_count", 999, "OK"), ("max_vlf_count", 1000, "WARN"),
        ("max_vlf_count", 10000, "CRIT"), ("uptime_hours", 1, "OK"),
    ]
    hm = table(
        spark, "HealthMetric",
        *[{"ServerName": f"s{i}", "MetricName": m, "MetricValue": float(v)} for i, (m, v, _) in enumerate(cases)],
        CollectedAt=NOW, Platform="MSSQL",
    )
    got = by(reports.instance_vitals(hm), "ServerName", "Status")
    assert got == {f"s{i}": want for i, (_, _, want) in enumerate(cases)}


@pytest.mark.parametrize(
    "report, name, columns, cases, label",
    [
        (reports.table_health, "TableHealth", ("UnsortedPct", "StatsOffPct"),
         {(49.9, 0): "WARN", (50.0, 0): "CRIT", (0, 50.0): "CRIT", (19.9, 19.9): "OK", (20.0, None): "WARN", (None, None): "OK"},
         "TableName"),
        (reports.file_io, "FileIOStats", ("ReadLatencyMs", "WriteLatencyMs"),
         {(49.9, 0): "WARN", (50.0, 0): "CRIT", (0, 50.0): "CRIT", (19.9, 19.9): "OK", (None, 20.0): "WARN", (None, None): "OK"},
         "DatabaseName"),
    ],
)
def test_two_column_thresholds(spark, report, name, columns, cases, label):
    def dec(v):
        return None if v is None else Decimal(str(v))

    rows = [{label: str(k), columns[0]: dec(k[0]), columns[1]: dec(k[1])} for k in cases]
    frame = table(spark, name, *rows, CollectedAt=NOW, ServerName="s")
    assert by(report(frame), label, "Status") == {str(k): v for k, v in cases.items()}


def test_costly_queries(spark):
    rows = [
        {"QueryId": 1, "EstCostUSD": Decimal("10.00"), "ScanMB": Decimal("0.0")},
        {"QueryId": 2, "EstCostUSD": Decimal("9.99"), "ScanMB": Decimal("0.0")},
        {"QueryId": 3, "EstCostUSD": Decimal("0.99"), "ScanMB": Decimal("512000.0")},
        {"QueryId": 4, "EstCostUSD": Decimal("0.99"), "ScanMB": Decimal("511999.9")},
    ]
    got = reports.costly_queries(table(spark, "QueryCost", *rows, CollectedAt=NOW, ServerName="s"))
    assert by(got, "QueryId", "Status") == {1: "CRIT", 2: "WARN", 3: "WARN", 4: "OK"}
    assert by(got, "QueryId", "ScanGB")[3] == Decimal("500.0")


def test_wait_delta(spark):
    def w(name, now, before):
        out = [] if now is None else [{"WaitType": name, "WaitTimeMs": now, "CollectedAt": NOW}]
        return out + ([] if before is None else [{"WaitType": name, "WaitTimeMs": before, "CollectedAt": ago(minutes=15)}])

    rows = w("grew", 100, 40) + w("reset", 30, 90) + w("new", 10, None) + w("same", 5, 5) + w("left", None, 7)
    rows.append({"WaitType": "grew", "WaitTimeMs": 1, "CollectedAt": ago(minutes=30)})
    out = reports.wait_delta(table(spark, "WaitStats", *rows, ServerName="s"))
    assert by(out, "WaitType", "DeltaMs") == {"grew": 60, "reset": 30, "new": 10}
    assert by(out, "WaitType", "WaitPct") == {"grew": Decimal("60.0"), "reset": Decimal("30.0"), "new": Decimal("10.0")}


def test_stale_tables(spark):
    def size(name, first_days):
        return [{"ObjectName": name, "SizeBytes": 2**30, "CollectedAt": ago(days=d)} for d in (first_days, 0)]

    names = {"young": 6, "never": 7, "d29": 90, "d30": 90, "d59": 90, "d60": 90}
    sizes = table(
        spark, "ObjectSize", *[r for n, d in names.items() for r in size(n, d)], Platform="Redshift", ServerName="s",
        ObjectType="table",
    )
    scans = table(
        spark, "TableScan", *[{"TableName": f"d{d}", "LastScanned": ago(days=d)} for d in (29, 30, 59, 60)],
        CollectedAt=NOW, ServerName="s",
    )
    out = reports.stale_tables(sizes, scans, NOW)
    assert by(out, "TableName", "Status") == {
        "young": "OK", "never": "CRIT", "d29": "OK", "d30": "WARN", "d59": "WARN", "d60": "CRIT",
    }
    assert by(out, "TableName", "EstMonthlyUSD")["never"] == Decimal("0.02")


def test_growth_of_an_object_whose_type_changed(spark):
    rows = [
        {"ObjectType": "database", "SizeBytes": 3 * 2**30, "CollectedAt": ago(days=2)},
        {"ObjectType": "table", "SizeBytes": 5 * 2**30, "CollectedAt": NOW},
        {"ObjectType": "database", "SizeBytes": 4 * 2**30, "CollectedAt": ago(hours=2)},
    ]
    sizes = table(spark, "ObjectSize", *rows, Platform="MSSQL", ServerName="s", ObjectName="o")
    daily = {r.Day: (r.ObjectType, r.SizeGB) for r in reports.growth_daily(sizes).collect()}
    assert daily == {date(2024, 1, 29): ("database", Decimal("3.000")), date(2024, 1, 31): ("table", Decimal("5.000"))}
    (k,) = reports.growth_keys(sizes).collect()
    assert (k.ObjectType, k.CurrentGB, k.DeltaGB, k.WindowDays, k.GrowthGBPerDay) == (
        "table", Decimal("5.00"), Decimal("2.00"), 2, Decimal("1.000"),
    )


def test_growth_of_a_single_day_is_zero(spark):
    sizes = table(
        spark, "ObjectSize", {"SizeBytes": 2**30, "CollectedAt": NOW}, Platform="MSSQL", ServerName="s", ObjectName="o",
        ObjectType="database",
    )
    assert reports.growth_keys(sizes).first().GrowthGBPerDay == 0


def test_forecast_edges(spark):
    def volume(name, total, per_day, last=10**12, days=10):
        return [
            {"VolumeName": name, "TotalBytes": total, "UsedBytes": last - per_day * d, "UsedPct": Decimal("50.00"),
             "CollectedAt": ago(days=d)}
            for d in range(days)
        ]

    gb = 10**9
    rows = volume("d14", 10**12 + 14 * gb, gb) + volume("d15", 10**12 + 15 * gb, gb) + volume("d45", 10**12 + 45 * gb, gb)
    rows += volume("d46", 10**12 + 46 * gb, gb) + volume("flat", 2 * 10**12, 0) + volume("shrinks", 2 * 10**12, -gb)
    rows += volume("single", 2 * 10**12, gb, days=1)
    rows += [{**r, "VolumeName": "old", "CollectedAt": r["CollectedAt"] - timedelta(days=60)} for r in volume("x", 10**13, gb)]
    out = disk_forecast(table(spark, "DiskUsage", *rows, Platform="MSSQL", ServerName="s"), NOW)
    got = {r.VolumeName: r for r in out.collect()}
    assert "old" not in got
    assert {k: r.Severity for k, r in got.items()} == {
        "d14": "CRIT", "d15": "WARN", "d45": "WARN", "d46": "OK", "flat": "OK", "shrinks": "OK", "single": "OK",
    }
    assert got["d14"].DaysToFull in (13, 14) and got["d14"].ProjectedFullDate is not None
    assert got["flat"].DaysToFull is None and got["flat"].RecommendedAddGB is None
    assert got["d46"].RecommendedAddGB == 168


def test_forecast_of_almost_no_growth_does_not_fail(spark):
    rows = [
        {"VolumeName": "v", "TotalBytes": 9 * 10**18, "UsedBytes": 10 + (d == 0), "UsedPct": Decimal("0"),
         "CollectedAt": ago(days=d)}
        for d in range(30)
    ]
    (r,) = disk_forecast(table(spark, "DiskUsage", *rows, Platform="MSSQL", ServerName="s"), NOW).collect()
    assert r.DaysToFull is None and r.Severity == "OK"


def costs(spark, values, metric="m"):
    rows = [{"MetricValue": float(v), "CollectedAt": ago(days=d), "MetricName": metric} for d, v in enumerate(values)]
    return table(spark, "RedshiftCost", *rows, ServerName="c", MetricUnit="TB")


@pytest.mark.parametrize(
    "values, want",
    [
        ([150, 100, 100, 100], "WARN"),  # +50 %, no spread
        ([149, 100, 100, 100], None),
        ([200, 100, 100, 100], "CRIT"),  # +100 %
        ([200, 100, 100], None),  # two baseline days
        ([50, 100, 100, 100], None),  # a drop
        ([104, 99, 100, 101], "CRIT"),  # z = 4
        ([102.5, 99, 100, 101], "WARN"),  # z = 2.5
        ([102.4, 99, 100, 101], None),
    ],
)
def test_anomaly_thresholds(spark, values, want):
    got = cost_anomaly(costs(spark, values), None, NOW).collect()
    assert [r.Severity for r in got] == ([] if want is None else [want])


def test_anomaly_is_raised_once(spark):
    found = cost_anomaly(costs(spark, [200, 100, 100, 100]), None, NOW)
    (r,) = found.collect()
    assert (r.ObservedDay, r.Value, r.Baseline, r.StdDev, r.ZScore, r.PctAboveBaseline) == (
        date(2024, 1, 31), 200.0, 100.0, 0.0, None, Decimal("100.0"),
    )
    assert cost_anomaly(costs(spark, [200, 100, 100, 100]), found, NOW).count() == 0


def lock(**k):
    return {"WaiterPid": 1, "Relation": "r", "WaitMinutes": 30, "BlockerPid": 2, "BlockerIdleInTxn": 0,
            "WaiterQuery": "select 1", "BlockerQuery": "update t", **k}


@pytest.mark.parametrize(
    "row, start",
    [
        (lock(BlockerIdleInTxn=1, WaiterQuery="alter table t"), "Blocker PID 2 holds the lock"),
        (lock(WaiterQuery="Drop table t", ConflictCount24h=3), "A DDL statement"),
        (lock(ConflictCount24h=3, WaiterQuery="VACUUM t"), "3 serialization-isolation aborts"),
        (lock(BlockerQuery="x vacuum y"), "A VACUUM / maintenance"),
        (lock(WaiterQuery="vacuum t", BlockerQuery=None), "A VACUUM / maintenance"),
        (lock(WaiterQuery="x VACUUM"), "A long-running transaction"),
        (lock(WaiterQuery=None, BlockerQuery=None), "A long-running transaction"),
    ],
)
def test_lock_patterns(spark, row, start):
    (f,) = lock_findings(table(spark, "LockWait", row, CollectedAt=NOW, ServerName="c")).collect()
    assert f.RootCause.startswith(start)


def test_lock_finding_texts_and_state(spark):
    rows = [lock(WaitMinutes=29, WaiterPid=5), lock(BlockerQuery="q" * 200)]
    locks = table(spark, "LockWait", *rows, CollectedAt=NOW, ServerName="c")
    state = generate_findings(locks, empty(spark, "Finding"), NOW)
    (f,) = state.collect()
    assert f.FindingKey == "RSBlock|c|1|r" and f.Title == "Lock wait 30 min on r (PID 1 blocked by PID 2)"
    assert f.Symptom == "PID 1 (?) has waited 30 min for a lock on r, held by PID 2 (?)."
    assert f.Evidence == (
        "waiter_pid=1 blocker_pid=2 lock_mode=? wait_min=30 idle_in_txn=0 conflicts_24h=0 blocker_sql=\"" + "q" * 120 + '"'
    )
    nothing = table(spark, "LockWait", lock(WaitMinutes=1), CollectedAt=NOW + timedelta(minutes=15), ServerName="c")
    (g,) = generate_findings(nothing, state, NOW + timedelta(minutes=15)).collect()
    assert g.Resolved and g.FirstSeen == NOW
    (r,) = reports.findings_report(state, NOW + timedelta(hours=2)).collect()
    assert r.AgeMinutes == 120


def test_alert_texts(spark):
    jobs = spark.createDataFrame(
        [("s", "j", None, ago(hours=24), "m", NOW), ("s", "j", "x", ago(hours=24, seconds=1), "m", NOW)],
        "ServerName string, JobName string, StepName string, RunAt timestamp_ntz, Message string, LastSeen timestamp_ntz",
    )
    (a,) = current_conditions(NOW, jobs=jobs).collect()
    assert a.AlertKey == "Job|s|j|2024-01-30 12:00" and a.Message == "Agent job failed: j (?) at 2024-01-30 12:00"
    with pytest.raises(ValueError):
        current_conditions(NOW, nonsense=jobs)


def vitals_report(spark, value):
    hm = table(
        spark, "HealthMetric", {"MetricValue": float(value)}, CollectedAt=NOW, Platform="MSSQL", ServerName="s",
        MetricName="cpu_pct",
    )
    return reports.instance_vitals(hm)


def test_alert_life(spark):
    owners = table(
        spark, "AppOwners",
        {"AppOwnerID": 1, "Criticality": "Tier2", "AppName": "b", "PrimaryOwner": "two", "Email": "two@example.test"},
        {"AppOwnerID": 2, "Criticality": "Tier1", "AppName": "a", "PrimaryOwner": "one", "Email": "one@example.test"},
        ServerName="s",
    )
    first = evaluate_alerts(empty(spark, "AlertHistory"), NOW, vitals=vitals_report(spark, 85))
    outbox = notification_outbox(first, owners)
    (row,) = outbox.collect()
    assert (row.Message, row.Owner) == ("s cpu_pct = 85", "one")
    assert notification_digest(outbox).first().Subject == "[FleetLens] 1 new alert(s)"
    sent = mark_notified(first, outbox, NOW)
    assert notification_outbox(sent, owners).count() == 0
    assert notification_digest(notification_outbox(sent, owners)).count() == 0

    later = NOW + timedelta(minutes=15)
    worse = evaluate_alerts(sent, later, vitals=vitals_report(spark, 99))
    assert [(r.Severity, r.NotifiedAt) for r in worse.collect()] == [("CRIT", NOW)]
    again = evaluate_alerts(sent, later, renotify_on_escalation=True, vitals=vitals_report(spark, 99))
    assert again.columns == sent.columns
    assert [(r.Severity, r.NotifiedAt) for r in again.collect()] == [("CRIT", None)]
    assert notification_digest(notification_outbox(again, owners)).first().Subject == "[FleetLens] 1 new alert(s) (1 CRITICAL)"
    to = spark.createDataFrame([("dba@example.test",), ("one@example.test",)], "Email string")
    outbox = notification_outbox(again, owners)
    assert {r.Email for r in notification_recipients(outbox, to).collect()} == {"dba@example.test", "one@example.test"}
    assert {r.Email for r in notification_recipients(outbox, to.limit(1), False).collect()} == {"dba@example.test"}

    cleared = evaluate_alerts(worse, later, vitals=vitals_report(spark, 10))
    assert [r.Resolved for r in cleared.collect()] == [True]


def test_estate_na_and_as_written(spark):
    servers = table(
        spark, "Servers", {"ServerName": "s", "Platform": "MSSQL"}, {"ServerName": "c", "Platform": "Redshift"}, IsActive=True
    )
    def nothing(f, name, *a):
        return f(empty(spark, name), *a)

    parts = [
        nothing(reports.backup_health, "BackupStatus", NOW), reports.disk_forecast_report(empty(spark, "DiskForecast")),
        nothing(reports.job_failures, "JobFailure", NOW), nothing(reports.ag_sync_status, "AGSyncStatus"),
        nothing(reports.instance_vitals, "HealthMetric"), nothing(reports.data_lag, "DataLag"),
        nothing(reports.table_health, "TableHealth"),
    ]
    got = {r.ServerName: r for r in reports.estate_health(servers, *parts, as_of=NOW).collect()}
    assert (got["s"].Backup, got["s"].Jobs, got["c"].Jobs, got["s"].OverallStatus) == ("NA", "OK", "NA", "OK")
    got = {r.ServerName: r for r in reports.estate_health(servers, *parts, as_of=NOW, as_written=True).collect()}
    assert (got["s"].Backup, got["c"].Jobs, got["s"].OverallRank) == ("OK", "NA", 2)


def test_access_control_limits(spark):
    def people(kind, n):
        return [{"PrincipalName": f"{kind}{i}", "AccessType": kind, "ServerName": f"{kind}-{n}"} for i in range(n)]

    rows = people("Sysadmin", 5) + people("Sysadmin", 6) + people("Security admin", 3) + people("Security admin", 4)
    out = reports.access_control(reports.principals(table(spark, "SecurityPrincipal", *rows, CollectedAt=NOW)))
    assert by(out, "ServerName", "Status") == {
        "Sysadmin-5": "OK", "Sysadmin-6": "WARN", "Security admin-3": "OK", "Security admin-4": "WARN",
    }


def test_patch_level(spark):
    rows = [
        {"ServerName": "a", "ProductVersion": "15.0", "ProductLevel": "RTM", "ProductUpdateLevel": "CU18"},
        {"ServerName": "b", "ProductVersion": "15.0", "ProductLevel": None, "ProductUpdateLevel": ""},
    ]
    got = by(reports.server_info(table(spark, "ServerInfo", *rows, CollectedAt=NOW)), "ServerName", "PatchLevel")
    assert got == {"a": "v15.0 · RTM-CU18", "b": "v15.0"}


# --------------------------------------------------------------------- extraction


def test_lock_waits_do_not_pair_a_session_with_itself(spark):
    t = "ServerName string, pid bigint, relation bigint, granted boolean, txn_start timestamp_ntz, txn_owner string, lock_mode string"
    trx = spark.createDataFrame(
        [
            ("c", 1, 9, True, ago(hours=5), "a ", "X"), ("c", 1, 9, False, ago(hours=5), "a ", "S"),
            ("c", 2, 9, True, ago(hours=4), "b", "X"), ("c", 3, 9, False, ago(minutes=5), "w", "S"),
            ("c", 4, 9, False, ago(minutes=4), "late", "S"), ("c", 5, 8, False, ago(hours=1), "alone", "S"),
            ("c", 6, 7, True, ago(hours=1), "self", "X"), ("c", 6, 7, False, ago(hours=1), "self", "S"),
        ], t,
    )
    def frame(ddl):
        return spark.createDataFrame([], ddl)

    out = X.extract_lock_waits(
        trx, frame("ServerName string, oid bigint, relname string"),
        frame("ServerName string, pid bigint, status string, query string"),
        frame("ServerName string, pid bigint, text string"),
        frame("ServerName string, table_id bigint, xact_start_ts timestamp_ntz"), NOW,
    )
    got = sorted((r.WaiterPid, r.BlockerPid, r.WaitMinutes, r.Relation, r.BlockerIdleInTxn) for r in out.collect())
    assert got == [(1, 2, 300, "9", 1), (3, 1, 5, "9", 1)]


def test_lock_waits_against_brute_force(spark):
    """One relation holds most of the rows."""
    import random

    rng = random.Random(3)
    rows = [
        ("c", rng.randrange(60), 1 if i % 3 else rng.randrange(2, 6), rng.random() < 0.5, ago(minutes=rng.randrange(400)), "o", "X")
        for i in range(600)
    ]
    t = "ServerName string, pid bigint, relation bigint, granted boolean, txn_start timestamp_ntz, txn_owner string, lock_mode string"
    want = {}
    for _, wp, rel, g, start, _, _ in rows:
        if not g:
            for _, bp, r2, g2, s2, _, _ in rows:
                if g2 and r2 == rel and bp != wp:
                    k = (wp, rel)
                    want[k] = min(want.get(k, (datetime.max, 0)), (s2, bp))
    first = {}
    for _, wp, rel, g, start, _, _ in rows:
        if not g:
            first[(wp, rel)] = min(first.get((wp, rel), datetime.max), start)
    want = {(wp, str(rel), bp) for (wp, rel), (_, bp) in want.items() if ago(minutes=5) >= first[(wp, rel)]}
    none = {
        "classes": "ServerName string, oid bigint, relname string",
        "recents": "ServerName string, pid bigint, status string, query string",
        "inflight": "ServerName string, pid bigint, text string",
        "conflicts": "ServerName string, table_id bigint, xact_start_ts timestamp_ntz",
    }
    out = X.extract_lock_waits(
        spark.createDataFrame(rows, t), **{k: spark.createDataFrame([], v) for k, v in none.items()}, as_of=NOW
    )
    assert {(r.WaiterPid, r.Relation, r.BlockerPid) for r in out.collect()} == want


def test_whole_text_from_many_fragments(spark):
    n = 3500
    texts = spark.range(n).select(
        F.lit("c").alias("ServerName"), F.lit(1).alias("query"), F.col("id").alias("sequence"),
        F.concat(F.lit("f"), "id", F.lit(" ")).alias("text"),
    ).repartition(5)
    (r,) = X.joined_text(texts).collect()
    assert r.text == "".join(f"f{i} " for i in range(n))


def test_local_times_become_utc(spark):
    h = spark.createDataFrame(
        [("s", 1, 1, "st", 0, 20240131, 60000, "m")],
        "ServerName string, job_id int, step_id int, step_name string, run_status int, run_date int, run_time int, message string",
    )
    jobs = spark.createDataFrame([("s", 1, "j")], "ServerName string, job_id int, name string")
    (r,) = M.extract_job_failures(h, jobs, NOW, source_tz="America/New_York").collect()
    assert r.RunAt == datetime(2024, 1, 31, 11, 0)


def test_optional_vitals_are_left_out(spark):
    def frame(ddl, *rows):
        return spark.createDataFrame(list(rows), ddl)

    servers = frame("ServerName string", ("s",))
    out = M.extract_vitals(
        servers, NOW,
        frame("ServerName string, object_name string, counter_name string, instance_name string, cntr_value bigint"),
        frame("ServerName string, is_user_process boolean"), frame("ServerName string, blocking_session_id bigint"),
        frame("ServerName string, sqlserver_start_time timestamp_ntz"),
        frame("ServerName string, ring_buffer_type string, record string",
              ("s", "RING_BUFFER_SCHEDULER_MONITOR", "<Record id = '1' time = '5'><SchedulerMonitorEvent><SystemHealth>"
               "<ProcessUtilization>42</ProcessUtilization></SystemHealth></SchedulerMonitorEvent></Record>")),
        frame("ServerName string"),
        frame("ServerName string, user_object_reserved_page_count bigint, internal_object_reserved_page_count bigint, "
              "version_store_reserved_page_count bigint, mixed_extent_page_count bigint"),
    )
    assert by(out, "MetricName", "MetricValue") == {
        "user_sessions": 0.0, "blocked_sessions": 0.0, "cpu_pct": 42.0, "suspect_pages": 0.0, "deadlocks_total": 0.0,
        "tempdb_used_gb": 0.0, "tempdb_version_store_gb": 0.0,
    }


def test_config_rules(spark):
    s = spark.createDataFrame(
        [("a", "xp_cmdshell", 0), ("b", "xp_cmdshell", 1), ("a", "cost threshold for parallelism", 24), ("a", "unknown", 1)],
        "ServerName string, ConfigItem string, CurrentValue bigint",
    )
    got = {(r.ServerName, r.ConfigItem): (r.Status, r.RecommendedValue) for r in audit.audit_config(s, audit.config_rules(spark)).collect()}
    assert got == {
        ("a", "xp_cmdshell"): ("OK", "0"), ("b", "xp_cmdshell"): ("WARN", "0"),
        ("a", "cost threshold for parallelism"): ("WARN", ">= 25"),
    }


# ---------------------------------------------------------------------- inventory


def test_owner_upsert_cases(spark):
    dim = table(
        spark, "AppOwners",
        {"AppOwnerID": 1, "ServerName": "s", "DatabaseName": "(instance)", "AppName": "a", "Criticality": "Tier1"},
        {"AppOwnerID": 2, "ServerName": "s", "DatabaseName": "d", "AppName": "b", "Criticality": "Tier1"},
    )
    ch = "AppOwnerID bigint, ServerName string, DatabaseName string, AppName string, Criticality string, Seq int"
    changes = spark.createDataFrame(
        [
            (0, "s", "", "a", "Tier2", 1), (0, "s", "", "a", "Gold", 2), (2, "s", "d2", "renamed", "Tier2", 1),
            (77, "s", "d", "unknown id", "Tier2", 1), (0, "s", "d", "new", None, 1),
        ], ch,
    )
    out = inventory.upsert_owners(dim, changes, NOW, order="Seq")
    got = {(r.ServerName, r.DatabaseName, r.AppName): (r.AppOwnerID, r.Criticality, r.UpdatedAt) for r in out.collect()}
    assert got[("s", "(instance)", "a")] == (1, "Tier3", NOW)
    assert got[("s", "d2", "renamed")] == (2, "Tier2", NOW)
    assert got[("s", "d", "unknown id")][0] == 77 and got[("s", "d", "new")][1] == "Tier3"
    assert got[("s", "d", "new")][0] > 0 and len(got) == 4


def test_server_registration_keeps_the_name(spark):
    dim = table(spark, "Servers", {"ServerID": 1, "ServerName": "s", "FriendlyName": "old", "IsActive": False, "HasPassword": True})
    seen = spark.createDataFrame([("s", "MSSQL", None), ("t", "Redshift", "t")], "ServerName string, Platform string, FriendlyName string")
    got = {r.ServerName: r for r in inventory.register_servers(dim, seen, NOW).collect()}
    assert (got["s"].FriendlyName, got["s"].IsActive, got["s"].HasPassword) == ("old", True, True)
    assert (got["t"].Environment, got["t"].CreatedAt, got["t"].HasPassword) == ("PROD", NOW, False)
