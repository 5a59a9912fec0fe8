"""The polling loop as streams: cycles per micro-batch, and event deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.plans.cycle import run_cycle
from fleetlens.schemas import COMPUTED, struct


def landing_stream(spark: SparkSession, path: str, table: str, **options) -> DataFrame:
    """New Parquet files of one evidence table."""
    computed = COMPUTED.get(table, [])
    schema = struct(table)
    fields = [f for f in schema.fields if f.name not in computed]
    return spark.readStream.schema(type(schema)(fields)).options(**options).parquet(path)


def stream_cycle(
    spark: SparkSession,
    landing: dict[str, str],
    store,
    checkpoint: str,
    as_of=None,
    retention_days: int = 90,
    available_now: bool = True,
    interval: str = "15 minutes",
    **options,
):
    """Append each micro-batch to the store, then run the cycle on it.

    ``landing`` maps evidence tables to directories. Query and batch number are
    the load id, so a batch that is repeated after a failure is stored once, even if its load has been merged
    since, and the state steps give the same result when repeated. ``as_of`` defaults to
    the newest time in the batch. ``options`` go to the landing streams.
    """
    tagged = None
    for table, path in landing.items():
        rows = landing_stream(spark, path, table, **options)
        one = rows.select(F.lit(table).alias("_table"), F.col("CollectedAt"), F.struct(*rows.columns).alias(table))
        tagged = one if tagged is None else tagged.unionByName(one, allowMissingColumns=True)

    def process(batch: DataFrame, number: int) -> None:
        # the id of the query lives in its checkpoint: another query's batch of this number is another load
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "stream"
        batch.persist()  # within the batch alone: its maximum and every table read it
        try:
            newest = batch.agg(F.max("CollectedAt")).first()[0]
            if newest is None:
                return
            for table in landing:
                store.append(batch.filter(F.col("_table") == table).select(f"{table}.*"), table, load=f"batch-{query}-{number}")
        finally:
            batch.unpersist()
        run_cycle(store, as_of or newest, retention_days)

    writer = tagged.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def stream_dedup(events: DataFrame, keys, ts: str = "EventTime", delay: str = "24 hours") -> DataFrame:
    """Let each event through once although every run reads the last day again.

    State is kept only for ``delay`` behind the newest event.
    """
    stamped = events.withColumn("_event_time", F.col(ts).cast("timestamp"))
    return stamped.withWatermark("_event_time", delay).dropDuplicatesWithinWatermark(list(keys)).drop("_event_time")
