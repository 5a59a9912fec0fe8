"""Live loads: crashes, readers on their way, replays, several writers, closed state."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetlens.plans import retention
from fleetlens.plans.cycle import run_cycle
from fleetlens.sources import live
from fleetlens.sources.store import SnapshotStore
from fleetlens.streaming.streams import stream_cycle
from tests.test_reports import table

NOW = datetime(2024, 1, 31, 12, 0, 0)


def ago(**k):
    return NOW - timedelta(**k)


@pytest.fixture
def store(spark, tmp_path):
    return SnapshotStore(spark, str(tmp_path / "store"))


def vitals(spark, *values, **common):
    base = {"CollectedAt": ago(days=1), "Platform": "MSSQL", "ServerName": "s", "MetricName": "cpu_pct", **common}
    return table(spark, "HealthMetric", *({"MetricValue": float(v)} for v in values), **base)


def shown(store, name="HealthMetric"):
    return sorted(r.MetricValue for r in store.read(name).collect())


def filled(spark, store):
    for i in range(4):
        store.append(vitals(spark, i), "HealthMetric", load=f"l{i}")


class Crash(Exception):
    pass


@pytest.mark.parametrize("before_commit", [True, False])
def test_a_crash_around_the_commit_of_a_rewrite(spark, store, monkeypatch, before_commit):
    filled(spark, store)
    commit = live.LiveTable.commit

    def crashing(self, change):
        if not before_commit:
            commit(self, change)
        raise Crash

    monkeypatch.setattr(live.LiveTable, "commit", crashing)
    with pytest.raises(Crash):
        retention.merge_loads(store, NOW)
    monkeypatch.setattr(live.LiveTable, "commit", commit)
    assert shown(store) == [0, 1, 2, 3]
    retention.merge_loads(store, NOW)
    retention.apply_compaction(store)
    assert shown(store) == [0, 1, 2, 3]


def test_a_crash_before_an_append_is_committed(spark, store, monkeypatch):
    filled(spark, store)
    monkeypatch.setattr(live.Files, "publish", lambda *a: (_ for _ in ()).throw(Crash()))
    with pytest.raises(Crash):
        store.append(vitals(spark, 9), "HealthMetric", load="l9")
    monkeypatch.undo()
    assert shown(store) == [0, 1, 2, 3]
    store.append(vitals(spark, 9), "HealthMetric", load="l9")
    assert shown(store) == [0, 1, 2, 3, 9]


def test_a_reader_during_rewrite_and_sweep_sees_one_state(spark, store):
    filled(spark, store)
    reading = store.read("HealthMetric")
    retention.merge_loads(store, NOW)
    store.append(vitals(spark, 7), "HealthMetric")
    store.sweep()  # within the grace the files stay
    assert sorted(r.MetricValue for r in reading.collect()) == [0, 1, 2, 3]
    assert shown(store) == [0, 1, 2, 3, 7]
    loads = [n for n in store.files.children(store.series_path("HealthMetric")) if n.startswith("load=")]
    assert len(loads) == 6
    store.grace = 0
    store.sweep()
    loads = [n for n in store.files.children(store.series_path("HealthMetric")) if n.startswith("load=")]
    assert len(loads) == 2 and shown(store) == [0, 1, 2, 3, 7]


def test_a_load_repeated_after_its_merge_counts_once(spark, store):
    filled(spark, store)
    retention.merge_loads(store, NOW)
    store.append(vitals(spark, 2), "HealthMetric", load="l2")
    assert shown(store) == [0, 1, 2, 3]


def test_a_stream_batch_repeated_after_a_merge_counts_once(spark, store, tmp_path):
    landing, check = str(tmp_path / "landing"), tmp_path / "check"
    for value in (1, 2):
        vitals(spark, value).coalesce(1).write.mode("append").parquet(landing)
        stream_cycle(spark, {"HealthMetric": landing}, store, str(check), as_of=NOW).awaitTermination()
    assert len(store.loads("HealthMetric", "2024-01-30")) == 1
    (check / "commits" / "1").unlink()  # the query stopped before it had noted the second batch
    crc = check / "commits" / ".1.crc"
    if crc.exists():
        crc.unlink()
    stream_cycle(spark, {"HealthMetric": landing}, store, str(check), as_of=NOW).awaitTermination()
    assert shown(store) == [1, 2]
    other = str(tmp_path / "other")  # another query has batches of the same numbers
    vitals(spark, 3).coalesce(1).write.parquet(other)
    stream_cycle(spark, {"HealthMetric": other}, store, str(tmp_path / "check2"), as_of=NOW).awaitTermination()
    assert shown(store) == [1, 2, 3]


def test_a_writer_that_was_faster_is_kept(spark, store, monkeypatch):
    """Another append commits between reading the list and publishing the next."""
    filled(spark, store)
    other = SnapshotStore(spark.newSession(), store.root)
    publish, raced = live.Files.publish, []

    def slow(self, text, path):
        if not raced:
            raced.append(path)
            other.append(vitals(other.spark, 8), "HealthMetric")
        return publish(self, text, path)

    monkeypatch.setattr(live.Files, "publish", slow)
    store.append(vitals(spark, 9), "HealthMetric")
    assert shown(store) == [0, 1, 2, 3, 8, 9] and raced


def test_two_rewrites_of_the_same_days(spark, store, monkeypatch):
    filled(spark, store)
    raced = []

    def rows(df):
        if not raced:
            raced.append(1)
            store.rewrite_days("HealthMetric", lambda d: d.filter("MetricValue < 3"), ["2024-01-30"])
        return df.filter("MetricValue > 0")

    store.rewrite_days("HealthMetric", rows, ["2024-01-30"])
    assert shown(store) == [1, 2]


def test_dropped_days_count_at_once_and_go_later(spark, store):
    store.append(vitals(spark, 1, CollectedAt=ago(days=200)), "HealthMetric")
    store.append(vitals(spark, 2), "HealthMetric")
    assert store.drop_days_before("HealthMetric", "2024-01-01") == ["2023-07-15"]
    assert store.drop_days_before("HealthMetric", "2024-01-01") == [] and shown(store) == [2]


def test_old_lists_go(spark, store, monkeypatch):
    monkeypatch.setattr(live, "LISTS_KEPT", 3)
    for i in range(12):
        store.append(vitals(spark, i), "HealthMetric")
    assert len(store.files.children(f"{store.series_path('HealthMetric')}/_live")) <= 5
    assert shown(store) == list(range(12))


def test_closed_alerts_are_written_once(spark, store):
    """A cycle writes the open alerts and those it closes; closed ones stay in the files they are in."""
    store.append(vitals(spark, 99, CollectedAt=ago(hours=1)), "HealthMetric")
    run_cycle(store, ago(minutes=59))
    store.append(vitals(spark, 1, CollectedAt=ago(minutes=30)), "HealthMetric")
    run_cycle(store, ago(minutes=29))
    (closed,) = store.read_state("AlertHistory").collect()
    assert closed.Resolved and store.read_open("AlertHistory").count() == 0
    files = [f.file for f in store.read_state("AlertHistory").select(F.input_file_name().alias("file")).collect()]
    store.append(vitals(spark, 97, CollectedAt=ago(minutes=10)), "HealthMetric")
    run_cycle(store, NOW)
    assert {r.Resolved for r in store.read_state("AlertHistory").collect()} == {True, False}
    later = [r.file for r in store.read_state("AlertHistory").filter("Resolved").select(F.input_file_name().alias("file")).collect()]
    assert later == files
    assert store.read_open("AlertHistory").first().FirstSeen == NOW


def test_closed_findings_age_by_month(spark, store):
    rows = [{"FindingKey": f"k{d}", "Resolved": True, "ResolvedAt": ago(days=d)} for d in (1, 60, 89, 91, 130, 400)]
    store.advance_state(table(spark, "Finding", *rows, {"FindingKey": "open", "Resolved": False}), "Finding")
    for _ in range(2):
        retention.apply_retention(store, NOW)
        assert {r.FindingKey for r in store.read_state("Finding").collect()} == {"k1", "k60", "k89", "open"}
    for i in range(retention.MERGED_FROM + 2):
        store.advance_state(table(spark, "Finding", {"FindingKey": f"m{i}", "Resolved": True, "ResolvedAt": NOW}), "Finding")
    retention.merge_loads(store, NOW)
    assert store.closed_loads("Finding")["closed-2024-01"] == 1
    assert store.read_state("Finding").count() == 3 + retention.MERGED_FROM + 2


def failure(step, collected, happened, message="m"):
    return {"ServerName": "s", "JobName": "j", "StepName": step, "RunAt": happened, "CollectedAt": collected, "Message": message}


def test_compaction_reads_what_is_new(spark, store, monkeypatch):
    """Whatever arrives and is merged or dropped in between, the series holds each event once; days without repeats are not read."""
    kept: dict[tuple, tuple] = {}

    def add(*rows):
        store.append(table(spark, "JobFailure", *rows), "JobFailure")
        for r in rows:
            key = (r["StepName"], r["RunAt"])
            kept[key] = max(kept.get(key, (r["CollectedAt"], r["Message"])), (r["CollectedAt"], r["Message"]))

    def check():
        got = {(r.StepName, r.RunAt): (r.CollectedAt, r.Message) for r in store.read("JobFailure").collect()}
        assert got == kept and store.read("JobFailure").count() == len(kept)

    read = []
    frames = live.LiveTable.frame

    def reading(self, entries=None):
        entries = list(self.live().entries if entries is None else entries)
        if self.path.endswith("series/JobFailure"):
            read.extend(e.part for e in entries)
        return frames(self, entries)

    monkeypatch.setattr(live.LiveTable, "frame", reading)
    for d in range(9, 1, -1):
        add(failure("a", ago(days=d), ago(days=d, hours=1)), failure(None, ago(days=d), ago(days=d, hours=2)))
        retention.apply_compaction(store)
    check()
    read.clear()
    add(failure("a", ago(days=1), ago(days=1, hours=2)), failure("a", ago(days=1), ago(days=5, hours=1), "again"))
    retention.apply_compaction(store)
    assert set(read) == {"2024-01-30", "2024-01-26"}
    check()
    retention.merge_loads(store, NOW)
    add(failure("b", NOW, ago(hours=1)), failure("b", NOW, ago(hours=1)))  # twice in one load
    retention.apply_compaction(store)
    check()
    read.clear()
    retention.apply_compaction(store)
    retention.apply_compaction(store)
    assert not read
    store.drop_days_before("JobFailure", "2024-01-25")
    for key in [k for k, (at, _) in kept.items() if at < ago(days=6, hours=12)]:
        del kept[key]
    old = failure("a", ago(minutes=1), ago(days=8, hours=1))  # its first row is gone
    add(old)
    retention.apply_compaction(store)
    check()


def test_compaction_after_a_crash_before_its_index(spark, store, monkeypatch):
    store.append(table(spark, "JobFailure", failure("a", ago(hours=2), ago(hours=3)), failure("a", ago(hours=1), ago(hours=3))), "JobFailure")
    add = live.LiveTable.add
    monkeypatch.setattr(live.LiveTable, "add", lambda *a, **k: (_ for _ in ()).throw(Crash()))
    with pytest.raises(Crash):
        retention.apply_compaction(store)
    monkeypatch.setattr(live.LiveTable, "add", add)
    store.append(table(spark, "JobFailure", failure("a", NOW, ago(hours=3))), "JobFailure")
    retention.apply_compaction(store)
    assert [r.CollectedAt for r in store.read("JobFailure").collect()] == [NOW]
