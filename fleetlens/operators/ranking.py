"""Top-k per key, shares of a total, and the orderings the reports use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.expressions import severity_rank


def top_k(df: DataFrame, n: int, *order, per=("ServerName",)) -> DataFrame:
    """The first ``n`` rows per key. ``order`` should be total.

    The limit is applied in every map partition before the shuffle.
    """
    w = Window.partitionBy(*per).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def total_per_key(df: DataFrame, value: str, per=("ServerName",), name: str = "_total") -> DataFrame:
    """Attach the sum of ``value`` per key, in one pass.

    For frames already reduced to one cycle: a window holds all rows of a key.
    """
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*per)))


#: Access classes in the order reports list them.
ACCESS_ORDER = ["Sysadmin", "Security admin", "Elevated", "Standard", "Connect-only"]


def access_rank(c: str = "AccessType") -> Column:
    rank = F.lit(len(ACCESS_ORDER))
    for i, name in reversed(list(enumerate(ACCESS_ORDER))):
        rank = F.when(F.col(c) == name, i).otherwise(rank)
    return rank


def order_by_severity(df: DataFrame, status: str = "Status", *then) -> DataFrame:
    """CRIT, WARN, the rest; then the given order."""
    return df.orderBy(severity_rank(status), *then)


def order_by_access(df: DataFrame, *then) -> DataFrame:
    return df.orderBy("ServerName", access_rank(), *then)
