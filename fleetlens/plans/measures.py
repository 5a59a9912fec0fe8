"""Small aggregates the front ends show next to the reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.expressions import nullif
from fleetlens.operators.latest import first_per_key


def fleet_measures(disk: DataFrame, lag: DataFrame, ag: DataFrame) -> DataFrame:
    """One row: disks at risk, worst lag in minutes, share of healthy replicas."""
    parts = [
        disk.agg(F.count_if(F.col("Severity") != "OK").alias("DisksAtRisk")),
        lag.agg((F.max("LagSeconds") / F.lit(60)).alias("WorstLagMin")),
        ag.agg(
            (F.count_if(F.col("Status") == "OK") / nullif(F.count(F.lit(1)), 0)).alias("AGHealthShare")
        ),
    ]
    names = [p.columns[0] for p in parts]
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in names])


def growth_summary(growth_daily: DataFrame) -> DataFrame:
    """Per object: days seen, current size, change from the first day to the last."""
    keys = ["Platform", "ServerName", "ObjectName"]
    return (
        growth_daily.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("Points"),
            F.max_by("SizeGB", "Day").alias("LastGB"),
            F.min_by("SizeGB", "Day").alias("_first"),
        )
        .withColumn("ChangeGB", F.col("LastGB") - F.col("_first"))
        .drop("_first")
    )


def growth_series(growth_daily: DataFrame, platform: str, server: str, name: str) -> DataFrame:
    """The points of one object in order of day."""
    picked = (F.col("Platform") == platform) & (F.col("ServerName") == server) & (F.col("ObjectName") == name)
    return growth_daily.filter(picked).select("Day", "SizeGB").orderBy("Day")


def cost_series(cost_trend: DataFrame, server: str, metric: str) -> DataFrame:
    """The points of one cost driver in order of day."""
    picked = (F.col("ServerName") == server) & (F.col("MetricName") == metric)
    return cost_trend.filter(picked).select("Day", "Value", "MetricUnit").orderBy("Day")


def cost_keys(cost_trend: DataFrame) -> DataFrame:
    """The cost drivers there are."""
    return cost_trend.select("ServerName", "MetricName", "MetricUnit").distinct()


def servers_with_owners(servers: DataFrame, owners: DataFrame) -> DataFrame:
    """Each server with its first owner and the number of further ones."""
    order = [F.asc_nulls_first("Criticality"), "AppName"] + (["AppOwnerID"] if "AppOwnerID" in owners.columns else [])
    first = first_per_key(owners, ["ServerName"], *order).select(
        "ServerName", F.col("AppName").alias("FirstApp"), F.col("PrimaryOwner").alias("FirstOwner")
    )
    counts = owners.groupBy("ServerName").agg(F.count(F.lit(1)).alias("_n"))
    rows = servers.join(first, ["ServerName"], "left")
    rows = rows.join(counts, ["ServerName"], "left")
    return rows.withColumn("MoreOwners", F.coalesce(F.col("_n") - 1, F.lit(0))).drop("_n")


def kpis(overview: DataFrame, active_alerts: DataFrame) -> DataFrame:
    """The overview row plus the number of active alerts."""
    alerts = active_alerts.agg(F.count(F.lit(1)).alias("ActiveAlerts"))
    return overview.withColumn("_one", F.lit(1)).join(alerts.withColumn("_one", F.lit(1)), "_one").drop("_one")
