"""Daily summaries of volumes: small sums that merge, so a longer look-back merges days and reads no samples again.

A summary holds, for one volume and day, the number of samples, the means of time and used bytes, and their
co-moments about these means, in double precision. Two summaries merge by the pairwise rule for co-moments, which never subtracts large
sums from each other. The newest sample of the day stands beside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetlens.functions.expressions import boundary_diff, ts_lit
from fleetlens.operators.latest import SNAPSHOT_DATE, since
from fleetlens.plans.forecast import from_slope
from fleetlens.sources.live import Entry, LiveTable

KEYS = ["Platform", "ServerName", "VolumeName"]
#: Times are counted in days from here: near enough for a fraction of a second to keep its digits.
ORIGIN = "2020-01-01 00:00:00"
SUMMARY = (
    "Platform string, ServerName string, VolumeName string, Day date, n long, mx double, my double, cxx double, cxy double, "
    "newest struct<CollectedAt: timestamp_ntz, UsedBytes: bigint, TotalBytes: bigint, UsedPct: decimal(5,2)>"
)


def daily_summaries(usage: DataFrame) -> DataFrame:
    """One row per volume and day: ``n``, ``mx``, ``my``, ``cxx``, ``cxy`` and the ``newest`` sample."""
    x = boundary_diff("second", ts_lit(ORIGIN), "CollectedAt") / F.lit(86400.0)
    timed = usage.where("CollectedAt IS NOT NULL").withColumn("_x", x).withColumn("_y", F.col("UsedBytes").cast("double"))
    both = F.col("_y").isNotNull()
    x, y = F.when(both, F.col("_x")), F.col("_y")
    return timed.groupBy(*KEYS, F.to_date("CollectedAt").alias("Day")).agg(
        F.count(y).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"),
        (F.var_pop(x) * F.count(y)).alias("cxx"), (F.covar_pop(x, y) * F.count(y)).alias("cxy"),
        F.max(F.struct("CollectedAt", "UsedBytes", "TotalBytes", "UsedPct")).alias("newest"),
    )


def _merge(a: Column, b: Column) -> Column:
    """The summary of two disjoint sets of samples from theirs."""
    n = a["n"] + b["n"]
    dx, dy = b["mx"] - a["mx"], b["my"] - a["my"]
    share = b["n"] / n
    both = a["n"] * share
    return F.struct(
        n.alias("n"), (a["mx"] + dx * share).alias("mx"), (a["my"] + dy * share).alias("my"),
        (a["cxx"] + b["cxx"] + dx * dx * both).alias("cxx"), (a["cxy"] + b["cxy"] + dx * dy * both).alias("cxy"),
    )


def merged(summaries: DataFrame, *keys: str) -> DataFrame:
    """One summary per ``keys`` out of several; a volume has as many as the window has days. Summaries without samples count for nothing."""
    parts = F.array_sort(F.filter(F.collect_list(F.struct(
        "Day", F.col("n").cast("double").alias("n"), "mx", "my", "cxx", "cxy")), lambda s: s["n"] > 0))
    start = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "mx", "my", "cxx", "cxy")])
    rows = summaries.groupBy(*keys).agg(parts.alias("_parts"), F.max("newest").alias("newest"))
    return rows.withColumn("s", F.aggregate("_parts", start, _merge)).drop("_parts")


def forecast_from_daily(summaries: DataFrame, as_of, lookback: int = 30, headroom: int = 180, warn: int = 45, crit: int = 14) -> DataFrame:
    """The disk forecast from daily summaries: whole days, those from ``lookback`` days before the day of ``as_of`` up to it.

    The day of ``as_of`` counts with the samples that its summary has. Otherwise as ``disk_forecast``.
    """
    today = F.to_date(ts_lit(as_of))
    recent = summaries.where((F.col("Day") >= F.date_sub(today, lookback)) & (F.col("Day") <= today))
    volumes = merged(recent, *KEYS)
    slope = F.when((F.col("s.n") > 1) & (F.col("s.cxx") > 0), F.col("s.cxy") / F.col("s.cxx"))
    return from_slope(volumes.select(*KEYS, slope.alias("_slope"), "newest.*"), as_of, headroom, warn, crit)


def _table(store) -> LiveTable:
    schema = StructType.fromDDL(SUMMARY)
    return LiveTable(store.spark, store.files, f"{store.root}/daily/DiskUsage", schema, "part")


def _due(store) -> tuple[list[Entry], list[Entry], int]:
    """Stored summaries that still hold, the loads of all other days, and the number of the list this is true of."""
    series, held = store.series("DiskUsage").live(), _table(store).live().entries
    mark = max((int(e.load.split("-")[1]) for e in held), default=0)
    have = {e.part for e in held} - {e.part for e in series.entries if e.since > mark}
    days = {e.part for e in series.entries}
    return [e for e in held if e.part in have & days], [e for e in series.entries if e.part not in have], series.number


def keep_daily(store, closed_before: str) -> None:
    """Bring the stored summaries up to date for the days before ``closed_before`` (yyyy-MM-dd).

    A day is summarised again when a load for it came or its files were rewritten; other days are not read.
    """
    good, due, number = _due(store)
    table, due = _table(store), [e for e in due if e.part < closed_before]
    days = {e.part for e in due} | {e.part for e in good}
    if due:
        rows = store.read("DiskUsage", due).drop(SNAPSHOT_DATE)
        made = daily_summaries(rows).withColumn("part", F.col("Day").cast("string")).repartition("part")
        again = {e.part for e in due}
        table.add(made, f"day-{number}", replacing=lambda part: part in again)
    table.drop(lambda part: part not in days)


def stored_daily(store, as_of, lookback: int = 30) -> DataFrame:
    """Summaries of the days of a look-back: stored ones, and those of all other days from their samples up to ``as_of``."""
    good, due, _ = _due(store)
    today = str(as_of)[:10]
    rows = store.read("DiskUsage", [e for e in due if e.part <= today])
    made = daily_summaries(since(rows, "CollectedAt", F.to_date(ts_lit(as_of, days=-lookback)), ts_lit(as_of)))
    kept = _table(store).frame(e for e in good if e.part < today)
    if any(e.part == today for e in good):  # only the samples up to as_of count of that day
        rows = store.read("DiskUsage", [e for e in store.series("DiskUsage").live().entries if e.part == today])
        made = made.unionByName(daily_summaries(since(rows, "CollectedAt", F.to_date(ts_lit(as_of)), ts_lit(as_of))))
    return made if kept is None else kept.select(*made.columns).unionByName(made)
