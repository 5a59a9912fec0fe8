"""Distinct queries per external table from sketches that merge: any window of days, without the rows it was counted from.

A sketch (HyperLogLog, ``2 ** LG_K`` registers) stands for the queries of one cluster, table and day. Sketches of several days, and of
several loads of one day, are united; a query that ran on two days counts once. Counts are estimates with a relative
standard error of ``1.04 / sqrt(2 ** LG_K)``, 1.6 %. ``extract_spectrum`` counts exactly and stays the default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetlens.functions.expressions import nullif
from fleetlens.operators.ranking import top_k
from fleetlens.sources.live import LiveTable

S = "ServerName"
LG_K = 12
STANDARD_ERROR = 1.04 / 2 ** (LG_K / 2)
KEYS = [S, "ExternalTable"]
SKETCH = "ServerName string, ExternalTable string, Day date, Queries binary, Bytes decimal(38,0)"


def daily_sketches(s3_summary: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """One row per cluster, external table and day. Rows without a start time belong to no day; rows without a query count their bytes alone."""
    name = F.coalesce(nullif(F.trim("external_table_name"), ""), F.lit("(unknown)"))
    timed = s3_summary.where("starttime IS NOT NULL")
    return timed.groupBy(S, name.alias("ExternalTable"), F.to_date("starttime").alias("Day")).agg(
        F.hll_sketch_agg(F.col("query").cast("bigint"), lg_k).alias("Queries"),
        F.sum(F.col("s3_scanned_bytes").cast("decimal(20,0)")).cast("decimal(38,0)").alias("Bytes"),
    )


def united(sketches: DataFrame, *keys: str) -> DataFrame:
    """One sketch and sum per ``keys``; united in the map tasks before the shuffle, so a key sends one sketch per task."""
    return sketches.groupBy(*keys).agg(F.hll_union_agg("Queries").alias("Queries"), F.sum("Bytes").cast("decimal(38,0)").alias("Bytes"))


def spectrum_between(sketches: DataFrame, first, last, n: int = 50) -> DataFrame:
    """The ``n`` tables per cluster with most bytes in the days ``first`` to ``last`` (yyyy-MM-dd, both counted); the layout of ``extract_spectrum``."""
    days = sketches.where(F.col("Day").between(F.lit(str(first)).cast("date"), F.lit(str(last)).cast("date")))
    rows = united(days, *KEYS).select(
        *KEYS,
        F.hll_sketch_estimate("Queries").alias("QueryCount"),
        (F.col("Bytes").cast("double") / F.lit(1e12)).alias("TBScanned"),
    )
    return top_k(rows, n, F.desc("TBScanned"), F.asc("ExternalTable"))


def _table(store) -> LiveTable:
    return LiveTable(store.spark, store.files, f"{store.root}/sketches/ExternalScan", StructType.fromDDL(SKETCH), "part")


def keep_sketches(store, s3_summary: DataFrame, load: str | None = None) -> None:
    """Add the sketches of one load of rows, in parts by month. Earlier loads are not read; a ``load`` id that is stored already adds nothing."""
    made = daily_sketches(s3_summary).withColumn("part", F.date_format("Day", "yyyy-MM"))
    _table(store).add(made.repartition("part"), load)


def merge_sketches(store) -> list[str]:
    """Unite the sketches of every day in the months that several loads brought; returns these months. Others are not read."""
    table = _table(store)
    parts = [e.part for e in table.live().entries]
    months = sorted({p for p in parts if parts.count(p) > 1})
    if months:
        table.rewrite(months, lambda rows: united(rows, *KEYS, "Day", "part").select(*table.schema.names, "part").repartition("part"))
    return months


def drop_sketches_before(store, day: str) -> list[str]:
    """Drop the months that end before the month of ``day`` (yyyy-MM-dd) without reading them."""
    return _table(store).drop(lambda part: part < day[:7])


def stored_sketches(store, first: str | None = None, last: str | None = None) -> DataFrame:
    """The stored sketches of the months a window of days touches; files of other months are not opened."""
    table = _table(store)
    rows = table.frame(e for e in table.live().entries if (first or "")[:7] <= e.part <= (last or "9999")[:7])
    return store.spark.createDataFrame([], table.schema) if rows is None else rows.drop("part")
