"""Days until a volume is full, by least squares over its recent history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.expressions import GIB, boundary_diff, percent_of, status, ts_lit
from fleetlens.operators.latest import since


def disk_forecast(
    usage: DataFrame, as_of, lookback: int = 30, headroom: int = 180, warn: int = 45, crit: int = 14
) -> DataFrame:
    """One row per volume seen within ``lookback`` days.

    Slope and newest values come from a single hash aggregate: every buffer
    has a fixed width and partial results combine before the shuffle. A flat
    or shrinking volume has no growth, no date and severity OK. The result
    replaces the previous forecast as a whole.
    """
    now = ts_lit(as_of)
    recent = since(usage, "CollectedAt", ts_lit(as_of, days=-lookback), now)
    if "UsedPct" not in recent.columns:
        recent = recent.withColumn("UsedPct", used_pct())
    # days relative to as_of: small numbers, so the sums keep their digits
    x = boundary_diff("second", now, "CollectedAt") / F.lit(86400.0)
    volumes = recent.groupBy("Platform", "ServerName", "VolumeName").agg(
        F.regr_slope(F.col("UsedBytes").cast("double"), x).alias("_slope"),
        # one newest row gives all three values; of equal times the fuller volume
        F.max(F.struct("CollectedAt", "UsedBytes", "TotalBytes", "UsedPct")).alias("_last"),
    )
    volumes = volumes.select("*", *[F.col(f"_last.{c}").alias(c) for c in ("TotalBytes", "UsedBytes", "UsedPct")])
    return from_slope(volumes, as_of, headroom, warn, crit)


def from_slope(volumes: DataFrame, as_of, headroom: int = 180, warn: int = 45, crit: int = 14) -> DataFrame:
    """The forecast from the newest sample of each volume and ``_slope``, its growth in bytes a day."""
    now = ts_lit(as_of)
    growing = F.col("_slope") > 0
    free = (F.col("TotalBytes") - F.col("UsedBytes")).cast("double")
    days = F.when(growing, (free / F.col("_slope")).try_cast("int"))
    growth = F.when(growing, F.col("_slope").cast("bigint"))
    add_gb = F.ceil(F.col("GrowthBytesPerDay").cast("decimal(20,0)") * F.lit(headroom) / F.lit(GIB)).try_cast("int")
    return (
        volumes.withColumn("GrowthBytesPerDay", growth)
        .withColumn("DaysToFull", days)
        .select(
            "Platform", "ServerName", "VolumeName", "TotalBytes", "UsedBytes", "UsedPct", "GrowthBytesPerDay",
            "DaysToFull", _date_after(now, "DaysToFull").alias("ProjectedFullDate"),
            add_gb.alias("RecommendedAddGB"),
            status([("CRIT", F.col("DaysToFull") <= crit), ("WARN", F.col("DaysToFull") <= warn)]).alias("Severity"),
            now.alias("ComputedAt"),
        )
    )


#: projections beyond the last date have no date
_LAST_DAY = "9999-12-31"


def _date_after(now, days: str):
    start = F.to_date(now)
    room = F.datediff(F.lit(_LAST_DAY).cast("date"), start)
    return F.when(F.col(days) <= room, F.date_add(start, F.col(days)))


def used_pct():
    """``100 * used / total`` with two decimals, 0 for an empty volume."""
    pct = percent_of("UsedBytes", "TotalBytes", 5, 2)
    return F.when(F.col("TotalBytes") > 0, pct).otherwise(F.lit(0).cast("decimal(5,2)"))
