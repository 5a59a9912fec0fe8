"""Cost spikes: the newest day of each driver against its trailing baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.expressions import ts_lit
from fleetlens.operators.latest import since


def daily_peaks(costs: DataFrame, as_of, window: int = 14) -> DataFrame:
    recent = since(costs, "CollectedAt", ts_lit(as_of, days=-(window + 1)), ts_lit(as_of))
    return recent.groupBy("ServerName", "MetricName", "MetricUnit", F.to_date("CollectedAt").alias("Day")).agg(
        F.max("MetricValue").alias("Val")
    )


def cost_anomaly(
    costs: DataFrame,
    prior: DataFrame | None,
    as_of,
    window: int = 14,
    warn_z: float = 2.5,
    crit_z: float = 4.0,
    warn_pct: float = 50.0,
    crit_pct: float = 100.0,
) -> DataFrame:
    """New anomalies; a (server, metric, day) already in ``prior`` is not raised again.

    The history is reduced to one row per driver and day before the window
    runs, so a window group never exceeds the days of the baseline.
    """
    per_metric = Window.partitionBy("ServerName", "MetricName")
    newest_first = per_metric.orderBy(F.desc("Day"), F.asc_nulls_first("MetricUnit"))
    earlier = F.when(F.col("Day") < F.col("_newest"), F.col("Val"))
    scored = (
        daily_peaks(costs, as_of, window)
        .withColumn("_newest", F.max("Day").over(per_metric))
        .withColumn("_mean", F.avg(earlier).over(per_metric))
        .withColumn("_sd", F.stddev_samp(earlier).over(per_metric))
        .withColumn("_n", F.count(earlier).over(per_metric))
        .withColumn("_r", F.row_number().over(newest_first))
        .filter((F.col("_r") == 1) & (F.col("_n") >= 3) & (F.col("Val") > F.col("_mean")))
        .withColumn("_z", F.when(F.col("_sd") > 0, (F.col("Val") - F.col("_mean")) / F.col("_sd")))
        .withColumn("_pct", F.when(F.col("_mean") > 0, (F.col("Val") - F.col("_mean")) * 100.0 / F.col("_mean")))
    )

    def reaches(z, pct):
        return F.coalesce(F.col("_z") >= z, F.lit(False)) | F.coalesce(F.col("_pct") >= pct, F.lit(False))

    found = scored.filter(reaches(warn_z, warn_pct)).select(
        "ServerName",
        "MetricName",
        "MetricUnit",
        F.col("Day").alias("ObservedDay"),
        F.col("Val").alias("Value"),
        F.col("_mean").alias("Baseline"),
        F.col("_sd").alias("StdDev"),
        F.col("_z").try_cast("decimal(10,2)").alias("ZScore"),
        F.col("_pct").try_cast("decimal(10,1)").alias("PctAboveBaseline"),
        F.when(reaches(crit_z, crit_pct), "CRIT").otherwise("WARN").alias("Severity"),
        ts_lit(as_of).alias("DetectedAt"),
    )
    if prior is None:
        return found
    return found.join(
        prior.select("ServerName", "MetricName", "ObservedDay"), ["ServerName", "MetricName", "ObservedDay"], "left_anti"
    )
