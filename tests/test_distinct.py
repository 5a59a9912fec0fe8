"""Sketches of distinct queries against exact counts."""

import random
from datetime import datetime, timedelta

import pytest

from fleetlens.plans.distinct import (
    STANDARD_ERROR,
    daily_sketches,
    drop_sketches_before,
    keep_sketches,
    merge_sketches,
    spectrum_between,
    stored_sketches,
)
from fleetlens.sources.store import SnapshotStore

T0 = datetime(2024, 2, 5, 12, 0, 0)
SCHEMA = "ServerName string, external_table_name string, query bigint, starttime timestamp_ntz, s3_scanned_bytes bigint"


def scans(seed, days, per_day=4_000):
    draw = random.Random(seed)
    rows = []
    for d in days:
        at = T0 - timedelta(days=d)
        rows += [("c1", "big", draw.randrange(9_000), at, 10**9) for _ in range(per_day)]  # many queries on several days
        rows += [("c1", draw.choice([" ", None]), draw.randrange(5), at, 7) for _ in range(20)]
    return rows


def exact(rows, first, last):
    found = {}
    for server, name, query, at, size in rows:
        if at and first <= str(at)[:10] <= last:
            queries, total = found.setdefault((server, (name or "").strip() or "(unknown)"), (set(), [0]))
            queries.add(query)
            total[0] += size or 0
    return {k: (len(q - {None}), t[0]) for k, (q, t) in found.items()}


def held(frame, rows, first, last):
    got = {(r.ServerName, r.ExternalTable): (r.QueryCount, r.TBScanned) for r in spectrum_between(frame, first, last).collect()}
    want = exact(rows, first, last)
    assert set(got) == set(want)
    for key, (count, size) in want.items():
        assert abs(got[key][0] - count) <= max(1, 4 * STANDARD_ERROR * count)
        assert got[key][1] == pytest.approx(size / 1e12)


def test_any_window_of_stored_days_counts_each_query_once(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    first, second = scans(1, range(5, 10)), scans(2, range(0, 5))
    late = scans(3, [7], 500)
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    for load, rows in (("a", first), ("b", second), ("a", first), ("late", late), ("b", second)):
        keep_sketches(store, frame(rows), load)
    rows = first + second + late
    windows = [("2024-01-01", "2024-02-10"), ("2024-01-29", "2024-01-29"), ("2024-01-28", "2024-02-02")]
    for window in windows:
        held(stored_sketches(store, *window), rows, *window)
    before = sorted(map(str, spectrum_between(stored_sketches(store), *windows[0]).collect()))
    assert merge_sketches(store) == ["2024-01"] and merge_sketches(store) == []
    assert sorted(map(str, spectrum_between(stored_sketches(store), *windows[0]).collect())) == before
    assert {f.split("part=")[1][:7] for f in stored_sketches(store, *windows[1]).inputFiles()} == {"2024-01"}
    assert drop_sketches_before(store, "2024-02-03") == ["2024-01"]
    held(stored_sketches(store), [r for r in rows if str(r[3]) >= "2024-02-01"], *windows[0])
    store.grace = 0
    store.sweep()
    held(stored_sketches(store), [r for r in rows if str(r[3]) >= "2024-02-01"], *windows[0])


def test_edges_of_sketches(spark, tmp_path):
    rows = [("c", "t", None, T0, 5), ("c", "t", None, T0, None), ("c", "u", 1, None, 9), ("c", "v", 2, T0, 0), ("c", "v", 2, T0, 0), (None, "v", 2, T0, 1)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS Day")
    got = {(r.ServerName, r.ExternalTable): r.QueryCount for r in spectrum_between(daily_sketches(frame), "2024-02-05", "2024-02-05").collect()}
    assert got == {("c", "t"): 0, ("c", "v"): 1, (None, "v"): 1}
    store = SnapshotStore(spark, str(tmp_path / "empty"))
    assert stored_sketches(store).count() == 0
    keep_sketches(store, frame.limit(0), "none")
    assert spectrum_between(stored_sketches(store), "2024-01-01", "2024-02-01").count() == 0
