"""Newest row, newest cycle and n-th newest cycle of an append-only series.

One path at every size: a window whose rank is limited. Spark applies the limit in each map partition before the shuffle, so
of a long history only the newest rows of each partition travel, and rows without a time sort last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.expressions import ts_lit

#: Partition column of the snapshot store: the day of ``CollectedAt``.
SNAPSHOT_DATE = "snapshot_date"


def first_per_key(df: DataFrame, keys, *order) -> DataFrame:
    """One row per key, the first in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def latest_row(df: DataFrame, keys, ts: str = "CollectedAt", tie=()) -> DataFrame:
    """The newest row per key; ``tie`` columns (descending) settle equal times."""
    tie = [tie] if isinstance(tie, str) else list(tie)
    return first_per_key(df, list(keys), F.desc(ts), *[F.desc(c) for c in tie])


def at_cycles(df: DataFrame, cycles: DataFrame, keys=("ServerName",), ts: str = "CollectedAt") -> DataFrame:
    """Rows of ``df`` collected at one of ``cycles`` (keys + ts, one row each)."""
    side = cycles.select(*[F.col(k).alias(f"_n_{k}") for k in keys], F.col(ts).alias("_n_ts"))
    cond = F.col(ts).eqNullSafe(F.col("_n_ts"))
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_n_{k}"))
    return df.join(side, cond, "left_semi")


def latest_cycle(df: DataFrame, keys=("ServerName",), ts: str = "CollectedAt", cycles: DataFrame | None = None) -> DataFrame:
    """All rows of each key's newest collection cycle.

    A collector that finds nothing writes nothing, so by default the last
    non-empty cycle stays the newest. With ``cycles`` (keys + ts of every run,
    from the collection log) an empty newest cycle yields no rows.
    """
    keys = list(keys)
    if cycles is None:
        w = Window.partitionBy(*keys).orderBy(F.desc(ts))
        return df.withColumn("_r", F.rank().over(w)).filter("_r = 1").drop("_r")
    runs = df.select(*keys, ts).unionByName(cycles.select(*keys, ts))
    return at_cycles(df, runs.groupBy(*keys).agg(F.max(ts).alias(ts)), keys, ts)


def last_cycles(df: DataFrame, keys=("ServerName",), ts: str = "CollectedAt", last: int = 2) -> DataFrame:
    """All rows of each key's ``last`` newest cycles, with their ``CycleNo``, 1 = newest."""
    w = Window.partitionBy(*keys).orderBy(F.desc(ts))
    return df.withColumn("CycleNo", F.dense_rank().over(w)).filter(F.col("CycleNo") <= last)


def nth_cycle(df: DataFrame, keys=("ServerName",), ts: str = "CollectedAt", n: int = 1) -> DataFrame:
    """All rows of each key's n-th newest cycle."""
    return last_cycles(df, keys, ts, n).filter(F.col("CycleNo") == n).drop("CycleNo")


def since(df: DataFrame, ts: str, cut, until=None) -> DataFrame:
    """Rows not older than ``cut`` nor newer than ``until``, with the matching partition filter."""
    out = df.filter(F.col(ts) >= cut)
    if until is not None:
        out = out.filter(F.col(ts) <= until)
    if ts == "CollectedAt" and SNAPSHOT_DATE in df.columns:
        out = out.filter(F.col(SNAPSHOT_DATE) >= F.to_date(cut))
        if until is not None:
            out = out.filter(F.col(SNAPSHOT_DATE) <= F.to_date(until))
    return out


def until(df: DataFrame, as_of, ts: str = "CollectedAt") -> DataFrame:
    """Rows not newer than ``as_of`` (None: all), and those without a time, with the matching partition filter."""
    if as_of is None:
        return df
    cut = ts_lit(as_of)
    out = df.filter(F.col(ts).isNull() | (F.col(ts) <= cut))
    if SNAPSHOT_DATE in df.columns:
        out = out.filter(F.col(SNAPSHOT_DATE).isNull() | (F.col(SNAPSHOT_DATE) <= F.to_date(cut)))
    return out
