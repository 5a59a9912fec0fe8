"""Point-in-time reads: for each of many moments, what a series said last.

One merge instead of a lookup per moment: events and series are put in one sequence per key, and the last value is
carried forward. A key's sequence is cut into days, so that no key is one task: what a day has to say at its end goes,
one row per key and day, through a second carry over days alone, and into each day as its start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of_join(
    events: DataFrame,
    series: DataFrame,
    keys: dict[str, str] | list[str],
    at: str = "RunAt",
    ts: str = "CollectedAt",
    values: list[str] | None = None,
    tie: list[str] | None = None,
    within: str | None = None,
    prefix: str = "",
) -> DataFrame:
    """Every row of ``events`` with the ``values`` (default: all but the keys) of the newest row of ``series`` not after it.

    ``keys`` names the columns that match (event column: series column, if they differ); null keys match nothing. Of equal
    times in the series the greatest by ``tie`` (default: the values) counts. ``within``, an interval such as ``"1 hour"``,
    leaves values older than that out. Events without a time, and those before all of their series, get nulls; each
    event stays one row, repeated ones too. Added columns are named with ``prefix``.
    """
    pairs = dict.fromkeys(keys) if not isinstance(keys, dict) else keys
    pairs = {left: right or left for left, right in pairs.items()}
    values = values or [c for c in series.columns if c not in pairs.values()]
    if clash := {prefix + v for v in values} & set(events.columns):
        raise ValueError(f"columns of both sides: {', '.join(sorted(clash))}; give a prefix")
    named = [f"_k{i}" for i in range(len(pairs))]
    day = F.to_date("_at")

    said = series.select(
        *[F.col(right).alias(name) for name, right in zip(named, pairs.values(), strict=True)], F.col(ts).alias("_at"),
        F.struct(F.col(ts).alias("_t"), *[F.col(c).alias(f"_tie{i}") for i, c in enumerate(tie or values)],
                 *[F.col(v).alias(f"_v{i}") for i, v in enumerate(values)]).alias("_said"),
    )
    known = F.lit(True)
    for name in named:
        known = known & F.col(name).isNotNull()
    said = said.where(known & F.col("_at").isNotNull()).withColumn("_day", day)

    asked = events.select(F.struct(*[F.col(f"`{c}`") for c in events.columns]).alias("_event"))
    asked = asked.select(
        "_event", *[F.col("_event")[left].alias(name) for name, left in zip(named, pairs, strict=True)], F.col("_event")[at].alias("_at")
    ).withColumn("_day", day)
    lost = asked.where(~(known & F.col("_at").isNotNull()) | F.col("_at").isNull())
    asked = asked.where(known & F.col("_at").isNotNull())

    # what each day ends with, carried over the days that follow: one row per key and day of either side
    ends = said.groupBy(*named, "_day").agg(F.max("_said").alias("_end"))
    days = ends.unionByName(asked.select(*named, "_day").distinct(), allowMissingColumns=True)
    days = days.groupBy(*named, "_day").agg(F.max("_end").alias("_end"))
    before = Window.partitionBy(*named).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_start", F.last("_end", ignorenulls=True).over(before)).where("_start IS NOT NULL")

    # within a day: its start, the series and the events in one sequence; at equal times the series comes first
    none = F.lit(None).cast(said.schema["_said"].dataType)
    event = F.lit(None).cast(asked.schema["_event"].dataType)
    sequence = days.select(*named, "_day", F.col("_start._t").alias("_at"), F.col("_start").alias("_said"), event.alias("_event"), F.lit(0).alias("_kind"))
    sequence = sequence.unionByName(said.select(*named, "_day", "_at", "_said", event.alias("_event"), F.lit(0).alias("_kind")))
    sequence = sequence.unionByName(asked.select(*named, "_day", "_at", none.alias("_said"), "_event", F.lit(1).alias("_kind")))
    order = Window.partitionBy(*named, "_day").orderBy("_at", "_kind", "_said").rowsBetween(Window.unboundedPreceding, 0)
    found = sequence.withColumn("_said", F.last("_said", ignorenulls=True).over(order)).where("_kind = 1").select("_event", "_said", "_at")
    if within:
        fresh = F.col("_said._t") >= F.col("_at") - F.expr(f"INTERVAL {within}")
        found = found.withColumn("_said", F.when(fresh, F.col("_said")))
    found = found.select("_event", "_said").unionByName(lost.select("_event", none.alias("_said")))
    added = [F.col(f"_said._v{i}").alias(prefix + v) for i, v in enumerate(values)]
    return found.select(*[F.col("_event")[c].alias(c) for c in events.columns], *added)
