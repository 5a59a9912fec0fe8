"""Ingest, the store, whole cycles and the streaming forms."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fleetlens.operators.latest import SNAPSHOT_DATE, latest_cycle, latest_row
from fleetlens.plans import retention
from fleetlens.plans.cycle import ORDER, Reports, run_cycle
from fleetlens.schemas import SERIES, TABLES, empty, struct
from fleetlens.sources import ingest
from fleetlens.sources.store import SnapshotStore
from fleetlens.streaming.streams import stream_cycle, stream_dedup
from tests.test_reports import table

NOW = datetime(2024, 1, 31, 12, 0, 0)


def ago(**k):
    return NOW - timedelta(**k)


@pytest.fixture
def store(spark, tmp_path):
    return SnapshotStore(spark, str(tmp_path / "store"))


def vitals(spark, *rows, **common):
    base = {"CollectedAt": NOW, "Platform": "MSSQL", "ServerName": "s", "MetricName": "cpu_pct", **common}
    return table(spark, "HealthMetric", *rows, **base)


def test_schemas():
    assert len(TABLES) == 31 and "DiskUsage" in SERIES and "Finding" not in SERIES


def test_conform(spark):
    df = spark.createDataFrame([("c:", 100, 85, "s", NOW)], "volumename string, TOTALBYTES int, UsedBytes int, servername string, collectedat timestamp_ntz")
    out = ingest.conform(df, "DiskUsage")
    assert out.schema == struct("DiskUsage")
    (r,) = out.collect()
    assert (r.FreeBytes, r.UsedPct, r.Platform) == (15, Decimal("85.00"), None)
    for bad in ("Extra", "FreeBytes", "SnapshotID"):
        with pytest.raises(ingest.UnmatchedColumns, match=bad):
            ingest.conform(df.withColumn(bad, F.lit(1)), "DiskUsage")
    (r,) = ingest.conform(df.withColumn("TotalBytes", F.lit(0)), "DiskUsage").collect()
    assert r.UsedPct == 0


def test_append_read_and_repeat(spark, store):
    assert store.read("HealthMetric").count() == 0
    one = vitals(spark, {"MetricValue": 1.0}, {"MetricValue": 2.0, "CollectedAt": ago(days=1)})
    store.append(one, "HealthMetric", load="x")
    store.append(one, "HealthMetric", load="x")  # the same batch again
    store.append(vitals(spark, {"MetricValue": 3.0}), "HealthMetric")
    store.append(empty(spark, "HealthMetric"), "HealthMetric")
    got = store.read("HealthMetric")
    assert sorted(r.MetricValue for r in got.collect()) == [1.0, 2.0, 3.0]
    assert store.days("HealthMetric") == ["2024-01-30", "2024-01-31"]
    assert got.columns == [*TABLES["HealthMetric"], SNAPSHOT_DATE]


def test_state_versions(spark, store):
    assert store.read_state("Finding").count() == 0
    for text in ("a", "b", "c"):
        prev = store.read_state("DiskForecast")
        row = table(spark, "DiskForecast", {"ServerName": text})
        store.write_state(prev.unionByName(row), "DiskForecast")
    assert {r.ServerName for r in store.read_state("DiskForecast").collect()} == {"a", "b", "c"}
    assert len(store.files.children(store.state_path("DiskForecast"))) == 2


def test_unfinished_version_is_ignored(spark, store):
    store.write_state(table(spark, "DiskForecast", {"ServerName": "a"}), "DiskForecast")
    broken = f"{store.state_path('DiskForecast')}/version=00000009"
    table(spark, "DiskForecast", {"ServerName": "half"}).write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false"
    ).parquet(broken)
    assert [r.ServerName for r in store.read_state("DiskForecast").collect()] == ["a"]


def test_load_sources_isolates_failures(spark, store):
    def broken():
        raise RuntimeError("unreachable")

    log = ingest.load_sources(
        store, {"DataLag": broken, "HealthMetric": lambda: vitals(spark, {"MetricValue": 1.0}, {"MetricValue": 2.0})}, NOW
    )
    got = {r.Status: (r.RowsLoaded, r.Message) for r in log.collect()}
    assert got["OK"] == (2, "HealthMetric")
    assert got["ERROR"][0] == 0 and "unreachable" in got["ERROR"][1]
    assert store.read("CollectionLog").count() == 2


def test_read_evidence(spark, tmp_path):
    vitals(spark, {"MetricValue": 1.0}).write.parquet(str(tmp_path / "p"))
    vitals(spark, {"MetricValue": 1.0}).write.option("header", True).csv(str(tmp_path / "c"))
    assert ingest.read_evidence(spark, "parquet", str(tmp_path / "p")).count() == 1
    csv = ingest.read_evidence(spark, "csv", str(tmp_path / "c"), schema=struct("HealthMetric"), header=True)
    assert csv.first().MetricValue == 1.0


def test_retention_drops_days_and_trims_the_boundary(spark, store):
    rows = [{"MetricValue": float(d), "CollectedAt": ago(days=d)} for d in (0, 89, 91, 200)]
    rows += [{"MetricValue": 90.5, "CollectedAt": ago(days=90, hours=1)}, {"MetricValue": 90.0, "CollectedAt": ago(days=90)}]
    store.append(vitals(spark, *rows), "HealthMetric")
    scans = table(spark, "TableScan", {"CollectedAt": ago(days=300), "ServerName": "s", "TableName": "t"})
    store.append(scans, "TableScan")
    store.write_state(
        table(
            spark, "Finding", {"FindingKey": "open", "Resolved": False, "LastSeen": ago(days=200)},
            {"FindingKey": "old", "Resolved": True, "ResolvedAt": ago(days=91)},
            {"FindingKey": "new", "Resolved": True, "ResolvedAt": ago(days=90)},
        ),
        "Finding",
    )
    for _ in range(2):  # a second run changes nothing
        retention.apply_retention(store, NOW)
        assert sorted(r.MetricValue for r in store.read("HealthMetric").collect()) == [0.0, 89.0, 90.0]
        assert {r.FindingKey for r in store.read_state("Finding").collect()} == {"open", "new"}
    assert store.read("TableScan").count() == 1
    kept = retention.retain_rows(vitals(spark, *rows), "HealthMetric", NOW)
    assert sorted(r.MetricValue for r in kept.collect()) == [0.0, 89.0, 90.0]


def test_compaction(spark, store):
    def failure(step, collected, message="m"):
        return {"ServerName": "s", "JobName": "j", "StepName": step, "RunAt": ago(hours=30), "CollectedAt": collected, "Message": message}

    for i, at in enumerate((ago(hours=29), ago(hours=10), NOW)):
        store.append(table(spark, "JobFailure", failure("a", at, f"m{i}"), failure(None, at)), "JobFailure")
    store.append(table(spark, "JobFailure", {**failure("z", ago(days=40)), "RunAt": ago(days=40)}), "JobFailure")
    retention.apply_compaction(store)
    got = {(r.StepName, r.CollectedAt, r.Message) for r in store.read("JobFailure").collect()}
    assert got == {("a", NOW, "m2"), (None, NOW, "m"), ("z", ago(days=40), "m")}
    assert store.read("JobFailure").count() == 3


def fill(spark, store):
    store.append(vitals(spark, {"MetricValue": 99.0}, {"MetricValue": 1.0, "CollectedAt": ago(days=1)}), "HealthMetric")
    lock = {"ServerName": "c", "CollectedAt": NOW, "WaiterPid": 1, "Relation": "r", "WaitMinutes": 45, "BlockerPid": 2,
            "BlockerIdleInTxn": 1}
    store.append(table(spark, "LockWait", lock), "LockWait")
    disk = spark.createDataFrame(
        [(ago(days=d), "MSSQL", "s", "c:", 10**12, 10**12 - (d + 1) * 10**10) for d in range(10)],
        "CollectedAt timestamp_ntz, Platform string, ServerName string, VolumeName string, TotalBytes bigint, UsedBytes bigint",
    )
    store.append(disk, "DiskUsage")
    costs = [{"CollectedAt": ago(days=d), "ServerName": "c", "MetricName": "m", "MetricValue": v, "MetricUnit": "TB"}
             for d, v in enumerate([200.0, 100.0, 100.0, 100.0])]
    store.append(table(spark, "RedshiftCost", *costs), "RedshiftCost")
    servers = [{"ServerID": 1, "ServerName": "s", "Platform": "MSSQL"}, {"ServerID": 2, "ServerName": "c", "Platform": "Redshift"}]
    store.write_state(table(spark, "Servers", *servers, IsActive=True, Environment="PROD"), "Servers")
    store.write_state(
        table(spark, "AppOwners", {"AppOwnerID": 1, "ServerName": "s", "AppName": "a", "Criticality": "Tier1", "PrimaryOwner": "p"}),
        "AppOwners",
    )


def test_cycle_and_contract(spark, store):
    fill(spark, store)
    reports = run_cycle(store, NOW)
    alerts = {r.AlertKey: r for r in store.read_state("AlertHistory").collect()}
    assert set(alerts) == {"Vitals|s|cpu_pct", "Disk|s|c:", "Cost|c|m|2024-01-31", "Advisor|RSBlock|c|1|r"}
    run_cycle(store, NOW + timedelta(minutes=15))
    again = store.read_state("AlertHistory").collect()
    assert {(r.AlertKey, r.FirstSeen) for r in again} == {(k, NOW) for k in alerts}
    assert store.read_state("CostAnomaly").count() == 1

    for name in ORDER:
        reports.report(name).collect()
    assert [(r.ServerName, r.OverallStatus) for r in reports.report("EstateHealth").collect()] == [("s", "CRIT"), ("c", "OK")]
    assert reports.report("ActiveAlerts", Category="Vitals").first().Owner == "p"
    over = reports.report("Overview").first()
    assert (over.Servers, over.DisksCrit, over.OpenFindings, over.AppsWithoutOwner) == (2, 1, 1, 1)
    names = reports.register_views()
    assert spark.sql(f"SELECT count(*) FROM {names[0]}").first()[0] == 1
    with pytest.raises(KeyError):
        Reports(store, NOW).report("nonsense")


def test_rows_of_another_writer_are_seen(spark, store, tmp_path):
    """Nothing is kept between reads: what another process appends shows in the next report."""
    keys = ["Platform", "ServerName", "MetricName"]
    store.append(vitals(spark, {"MetricValue": 1.0, "CollectedAt": ago(hours=1)}), "HealthMetric")
    assert [r.MetricValue for r in latest_row(store.read("HealthMetric"), keys).collect()] == [1.0]
    other = SnapshotStore(spark.newSession(), store.root)
    other.append(vitals(other.spark, {"MetricValue": 99.0}), "HealthMetric")
    assert [r.MetricValue for r in latest_row(store.read("HealthMetric"), keys).collect()] == [99.0]
    assert [r.MetricValue for r in latest_cycle(store.read("HealthMetric")).collect()] == [99.0]


def test_load_that_arrives_during_a_rewrite_is_kept(spark, store):
    store.append(vitals(spark, {"MetricValue": 1.0}), "HealthMetric", load="early")
    day = NOW.date().isoformat()

    def rows(read):
        store.append(vitals(spark, {"MetricValue": 2.0}), "HealthMetric", load="late")
        return read

    store.rewrite_days("HealthMetric", rows, [day])
    assert sorted(r.MetricValue for r in store.read("HealthMetric").collect()) == [1.0, 2.0]


def test_loads_of_closed_days_are_merged(spark, store):
    for d in (0, 1):
        for i in range(3):
            store.append(vitals(spark, {"MetricValue": float(i), "CollectedAt": ago(days=d)}), "HealthMetric")
    retention.merge_loads(store, NOW)
    loads = {d: len(store.loads("HealthMetric", d)) for d in store.days("HealthMetric")}
    assert sorted(loads.values()) == [1, 3] and store.read("HealthMetric").count() == 6


def test_every_anomaly_of_a_day_raises_an_alert(spark, store):
    """The report lists 500; the alerts come from the whole table."""
    costs = [
        {"CollectedAt": ago(days=d), "ServerName": "c", "MetricName": f"m{m}", "MetricValue": 900.0 if d == 0 else 100.0, "MetricUnit": "TB"}
        for m in range(600) for d in range(4)
    ]
    store.append(table(spark, "RedshiftCost", *costs), "RedshiftCost")
    reports = run_cycle(store, NOW)
    assert store.read_state("AlertHistory").filter("Category = 'Cost' AND NOT Resolved").count() == 600
    assert reports.frame("CostAnomaly").count() == 500


def test_collection_log_is_stored_per_server(spark, store):
    fill(spark, store)
    good = vitals(spark, {"MetricValue": 1.0}, {"MetricValue": 2.0, "ServerName": "t"})

    def bad():
        raise OSError("no route")

    log = ingest.load_sources(store, {"HealthMetric": lambda: good, "DataLag": bad}, NOW, servers={"DataLag": ["c"]})
    assert sorted((r.ServerName or "", r.Status, r.RowsLoaded) for r in log.collect()) == [("c", "ERROR", 0), ("s", "OK", 1), ("t", "OK", 1)]
    shown = {r.ServerName: r for r in Reports(store, NOW).report("Servers").collect()}
    assert (shown["s"].LastStatus, shown["c"].LastStatus) == ("OK", "ERROR")
    run_cycle(store, NOW)
    steps = {r.Collector for r in store.read("CollectionLog").collect()}
    assert {"fleet", "forecast", "anomaly"} <= steps


def test_stream_cycle_equals_one_batch(spark, tmp_path):
    landing = str(tmp_path / "landing")
    first = vitals(spark, {"MetricValue": 85.0, "CollectedAt": ago(minutes=15)}).drop("x")
    second = vitals(spark, {"MetricValue": 99.0}, {"MetricValue": 96.0, "ServerName": "t"})
    streamed = SnapshotStore(spark, str(tmp_path / "streamed"))
    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(landing)
        stream_cycle(spark, {"HealthMetric": landing}, streamed, str(tmp_path / "check")).awaitTermination()
    whole = SnapshotStore(spark, str(tmp_path / "whole"))
    whole.append(first.unionByName(second), "HealthMetric")
    run_cycle(whole, NOW)

    def shown(store):
        return sorted((r.AlertKey, r.Severity, r.Message, r.Resolved) for r in store.read_state("AlertHistory").collect())

    assert shown(streamed) == shown(whole)
    assert streamed.read("HealthMetric").count() == 3


def test_stream_dedup_across_batches(spark, tmp_path):
    schema = "ServerName string, EventTime timestamp_ntz, Message string"
    keys = ["ServerName", "EventTime", "Message"]

    def land(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = stream_dedup(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), keys)
        writer = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check"))
        writer.option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()

    land(("s", NOW, "a"), ("s", NOW, "a"), ("s", NOW, "b"))
    land(("s", NOW, "a"), ("s", NOW + timedelta(hours=1), "a"))
    got = sorted((r.EventTime, r.Message) for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).collect())
    assert got == [(NOW, "a"), (NOW, "b"), (NOW + timedelta(hours=1), "a")]
