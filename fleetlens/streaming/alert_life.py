"""The life of alerts as keyed streaming state: opened, refreshed and closed as evaluations arrive.

The input is a stream of evaluations: the conditions that hold at a time ``At``, and one row without an AlertKey
for each evaluation, so that one that finds nothing shows too. State is one row per open alert; a timer behind its
newest evaluation closes it once a later evaluation has come without it. What arrives is
touched, and nothing else: an alert that stays quiet costs nothing, and closed alerts leave the state.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fleetlens.functions.expressions import severity_rank
from fleetlens.operators.latest import first_per_key
from fleetlens.schemas import TABLES

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH = datetime(1970, 1, 1)

CONDITION = ["Category", "Severity", "ServerName", "Message"]
STATE = "Category string, Severity string, ServerName string, Message string, First long, Last long"
EVENT = (
    "AlertKey string, Category string, Severity string, ServerName string, Message string, FirstSeen timestamp_ntz, "
    "LastSeen timestamp_ntz, Resolved boolean, ResolvedAt timestamp_ntz"
)
_NAMES = [c.split()[0] for c in EVENT.split(", ")]
_RANK = {"CRIT": 0, "WARN": 1}


def _at(millis: int) -> datetime:
    return EPOCH + timedelta(milliseconds=millis)


class AlertLife(StatefulProcessor):
    """Per AlertKey: the open alert, if there is one. Times are milliseconds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", STATE)

    def close(self) -> None:
        pass

    def _event(self, key: str, alert: tuple, closed: int | None) -> tuple:
        *condition, first, last = alert
        return (key, *condition, _at(first), _at(last), closed is not None, None if closed is None else _at(closed))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (name,) = key
        if name is None:
            return
        seen: dict[int, tuple] = {}
        for frame in rows:
            for at, *condition in frame[["millis", *CONDITION]].itertuples(index=False):
                condition = tuple(None if pd.isna(c) else c for c in condition)
                order = (_RANK.get(condition[1], 2), condition[3] is not None, condition[3] or "")
                if int(at) not in seen or order < seen[int(at)][0]:  # of one evaluation the worst, then the least text
                    seen[int(at)] = (order, condition)
        alert = tuple(self.open.get()) if self.open.exists() else None
        passed = timerValues.getCurrentWatermarkInMs()
        out = []
        for at in sorted(seen):
            category, severity, server, message = seen[at][1]
            if alert and alert[5] >= at:
                continue  # an evaluation that was counted already
            if alert and alert[5] < passed < at:  # an evaluation in between had it no longer
                out.append(self._event(name, alert, passed))
                alert = None
            if alert:
                alert = (alert[0], severity, alert[2], message, alert[4], at)
            else:
                alert = (category, severity, server, message, at, at)
            out.append(self._event(name, alert, None))
        if not out:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.open.update(alert)
        self.handle.registerTimer(alert[5] + 1)
        yield pd.DataFrame(out, columns=_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.open.exists():
            return
        alert = tuple(self.open.get())
        self.open.clear()
        yield pd.DataFrame([self._event(key[0], alert, timerValues.getCurrentWatermarkInMs())], columns=_NAMES)


def alert_events(evaluations: DataFrame) -> DataFrame:
    """Events of alerts from a stream of evaluations (``At``, ``AlertKey``, category, severity, server, message).

    A row per alert and evaluation that has it, and one when it closes: by the first evaluation
    without it, if each micro-batch holds one evaluation; by the newest of the batch, if it holds several. A closing is
    told with the batch after. Rows of an evaluation that an alert has counted change nothing.
    """
    millis = F.timestamp_diff("MILLISECOND", F.lit(EPOCH).cast("timestamp_ntz"), F.col("At"))
    timed = evaluations.withColumn("millis", millis).withColumn("event_time", F.timestamp_millis("millis"))
    timed = timed.select("AlertKey", *CONDITION, "millis", "event_time").withWatermark("event_time", "0 seconds")
    return timed.groupBy("AlertKey").transformWithStateInPandas(AlertLife(), EVENT, "Append", "EventTime")


def evaluation(conditions: DataFrame, as_of) -> DataFrame:
    """The rows of one evaluation: its conditions, and the row that says it took place."""
    spark = conditions.sparkSession
    at = F.lit(as_of).cast("timestamp_ntz").alias("At")
    mark = spark.range(1).select(at, *[F.lit(None).cast("string").alias(c) for c in ["AlertKey", *CONDITION]])
    return conditions.select(at, "AlertKey", *CONDITION).unionByName(mark)


def stream_alerts(
    spark: SparkSession, evaluations: DataFrame, out: str, checkpoint: str, available_now: bool = True, partitions: int | None = None
):
    """Write the events of alerts to Parquet below ``out``.

    The state store is RocksDB, as the timers need it. ``partitions`` is how many parts the state has (default: the
    session's shuffle partitions); a checkpoint keeps the number it began with.
    """
    settings = {PROVIDER: ROCKSDB} | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        writer = alert_events(evaluations).writeStream.format("parquet").outputMode("append")
        writer = writer.option("checkpointLocation", checkpoint).option("path", out)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def alert_table(events: DataFrame) -> DataFrame:
    """The alert table that the events amount to: the newest event of each alert, in the columns of ``AlertHistory``."""
    newest = first_per_key(events, ["AlertKey", "FirstSeen"], F.desc("LastSeen"), F.desc("Resolved"), severity_rank("Severity"))
    columns = TABLES["AlertHistory"]
    return newest.select(*[(F.col(c) if c in newest.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])
