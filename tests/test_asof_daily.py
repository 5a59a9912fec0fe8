"""Point-in-time reads and daily summaries against plain Python."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from fleetlens.operators.asof import as_of_join
from fleetlens.plans.cycle import Reports
from fleetlens.plans.daily import KEYS, daily_summaries, keep_daily, merged
from fleetlens.plans.retention import merge_loads
from fleetlens.sources.store import SnapshotStore

T0 = datetime(2024, 1, 31, 12, 0, 0)
EVENTS = "id int, Host string, Metric string, RunAt timestamp_ntz"
SERIES = "ServerName string, Metric string, CollectedAt timestamp_ntz, Value int, Note string"


def looked_up(event, series, within=None):
    _, host, metric, at = event
    fit = [s for s in series if s[0] == host and s[1] == metric and host and metric and at and s[2] and s[2] <= at]
    best = max(fit, key=lambda s: (s[2], s[3] is not None, s[3] or 0, s[4] or ""), default=None)
    if best is None or (within and best[2] < at - within):
        return (None, None, None)
    return best[2:]


def test_equals_a_lookup_per_event(spark):
    draw = random.Random(3)
    when = lambda: draw.choice([None, *[T0 + timedelta(hours=draw.randrange(0, 400)) for _ in range(20)]])
    hosts = ["a", "b", "c", None]
    series = [(draw.choice(hosts), draw.choice("xy"), when(), draw.choice([None, 1, 2, 3]), draw.choice("mno")) for _ in range(150)]
    series += [s for s in series[:20]]
    events = [(i, draw.choice([*hosts, "d"]), draw.choice("xyz"), when()) for i in range(200)]
    events += [(i, "a", "x", T0 - timedelta(days=9)) for i in range(3)] + events[:5]
    keys = {"Host": "ServerName", "Metric": None}
    args = (spark.createDataFrame(events, EVENTS), spark.createDataFrame(series, SERIES), keys)
    for within, delta in ((None, None), ("30 hours", timedelta(hours=30))):
        out = as_of_join(*args, within=within, values=["CollectedAt", "Value", "Note"], prefix="Was", tie=["Value", "Note"])
        assert out.columns == ["id", "Host", "Metric", "RunAt", "WasCollectedAt", "WasValue", "WasNote"]
        got = sorted(map(str, (tuple(r) for r in out.collect())))
        assert got == sorted(str((*e, *looked_up(e, series, delta))) for e in events)
    empty = spark.createDataFrame([], SERIES)
    assert {r.Value for r in as_of_join(args[0], empty, keys, values=["Value"]).collect()} == {None}
    assert as_of_join(args[0].limit(0), args[1], keys, values=["Value"]).count() == 0
    with pytest.raises(ValueError, match="Host"):
        as_of_join(args[0], args[1].withColumnRenamed("Note", "Host"), keys)


def disk(spark, rows):
    return spark.createDataFrame(
        [(at, "MSSQL", "s", v, 10**13, used) for at, v, used in rows],
        "CollectedAt timestamp_ntz, Platform string, ServerName string, VolumeName string, TotalBytes bigint, UsedBytes bigint",
    )


def samples(seed, days, per_day=20):
    draw = random.Random(seed)
    return [
        (T0 - timedelta(days=d, seconds=draw.randrange(40_000)), v, 5 * 10**12 + d * 10**9 * (v == "c:") + draw.randrange(10**8))
        for d in range(days) for v in ("c:", "d:") for _ in range(per_day)
    ]


def test_merged_summaries_give_the_slope_of_all_samples(spark):
    rows = samples(1, 40) + [(T0 - timedelta(days=90), "e:", 7), (T0, "f:", None)]
    from pyspark.sql import functions as F

    out = merged(daily_summaries(disk(spark, rows).withColumn("UsedPct", F.lit(1).cast("decimal(5,2)"))), *KEYS)
    got = {r.VolumeName: r for r in out.collect()}
    for v in ("c:", "d:"):
        x = np.array([(at - T0).total_seconds() / 86400 for at, name, _ in rows if name == v])
        y = np.array([u for _, name, u in rows if name == v], float)
        slope = ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()
        assert got[v].s.cxy / got[v].s.cxx == pytest.approx(slope, rel=1e-9)
        assert got[v].s.n == len(x) and got[v].newest.CollectedAt == max(at for at, name, _ in rows if name == v)
    assert got["e:"].s.n == 1 and got["f:"].s.n == 0


def test_stored_days_are_merged_and_follow_their_loads(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))

    def whole():
        """The forecast from the samples of the same whole days."""
        from pyspark.sql import functions as F

        from fleetlens.plans.daily import forecast_from_daily

        rows = store.read("DiskUsage").drop("snapshot_date").where(F.col("CollectedAt") <= T0)
        return sorted(map(str, forecast_from_daily(daily_summaries(rows), T0, 20).collect()))

    def kept():
        return sorted(map(str, Reports(store, T0).forecast(20).collect()))

    def same():
        a, b = kept(), whole()
        assert a == b and len(a) == 2

    for d in range(0, 30, 10):
        store.append(disk(spark, [s for s in samples(2, 30, 3) if d <= (T0 - s[0]).days < d + 10]), "DiskUsage")
    same()
    keep_daily(store, "2024-01-31")
    same()
    store.append(disk(spark, [(T0 - timedelta(days=4), "c:", 10**12)]), "DiskUsage")  # late
    same()
    merge_loads(store, T0)
    keep_daily(store, "2024-01-31")
    same()
    store.append(disk(spark, [(T0 + timedelta(minutes=5), "c:", 10**12)]), "DiskUsage")  # after as_of
    same()
    store.drop_days_before("DiskUsage", "2024-01-20")
    same()
    keep_daily(store, "2024-01-31")
    same()
    files = Reports(store, T0).forecast(20).inputFiles()
    assert {f.split("snapshot_date=")[1][:10] for f in files if "/series/" in f} == {"2024-01-31"}
