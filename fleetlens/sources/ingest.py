"""Reading evidence, stamping it, and fitting it to the stored layout."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.expressions import moment, ts_lit
from fleetlens.operators.latest import SNAPSHOT_DATE
from fleetlens.plans.forecast import used_pct
from fleetlens.schemas import COMPUTED, TABLES, empty


class UnmatchedColumns(ValueError):
    """A source column has no place in the destination table."""


def read_evidence(spark: SparkSession, fmt: str, path: str | None = None, schema=None, **options) -> DataFrame:
    """Read landed evidence in any format Spark knows: parquet, csv, json, orc, jdbc.

    A large table read over jdbc should name ``partitionColumn``,
    ``lowerBound``, ``upperBound`` and ``numPartitions``, or it arrives through
    a single connection.
    """
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path) if path is not None else reader.load()


def with_envelope(df: DataFrame, collected_at, server: str | None = None, platform: str | None = None) -> DataFrame:
    """Stamp the run: CollectedAt, and ServerName and Platform where given."""
    stamps = {"CollectedAt": ts_lit(collected_at)}
    if server is not None:
        stamps["ServerName"] = F.lit(server)
    if platform is not None:
        stamps["Platform"] = F.lit(platform)
    return df.withColumns(stamps)


def with_computed(df: DataFrame, table: str) -> DataFrame:
    """Add the columns derived at ingest."""
    if table == "DiskUsage":
        return df.withColumns({"FreeBytes": F.col("TotalBytes") - F.col("UsedBytes"), "UsedPct": used_pct()})
    return df


def conform(df: DataFrame, table: str) -> DataFrame:
    """Map columns by name, ignoring case; add the missing ones as NULL and the computed ones.

    A column the table does not know, or computes itself, is an error.
    """
    computed = COMPUTED.get(table, [])
    known = {c.lower(): c for c in TABLES[table] if c not in computed}
    unmatched = [c for c in df.columns if c.lower() not in known]
    if unmatched:
        raise UnmatchedColumns(
            f"{table}: no destination for {', '.join(unmatched)}; it has {', '.join(sorted(known.values()))}"
        )
    given = {known[c.lower()]: c for c in df.columns}
    renamed = df.select(
        *[
            (F.col(f"`{given[c]}`") if c in given else F.lit(None)).cast(t).alias(c)
            for c, t in TABLES[table].items()
            if c not in computed
        ]
    )
    return with_computed(renamed, table).select(*[F.col(c).cast(t) for c, t in TABLES[table].items()])


def load_sources(
    store,
    sources: Mapping[str, Callable[[], DataFrame]],
    as_of,
    collector: str = "fleet",
    servers: Mapping[str, list[str]] | None = None,
) -> DataFrame:
    """Append each source to its table and the outcome to the collection log; a failing source is logged and skipped.

    ``sources`` maps table name to a function that returns its frame. A load
    that worked is logged per server with its rows, counted from the files it
    wrote; one that failed is logged for the ``servers`` the source should have
    covered, or once without a name. Returns what was logged.
    """
    spark: SparkSession = store.spark
    logged = empty(spark, "CollectionLog")
    for table, source in sources.items():
        try:
            load = uuid.uuid4().hex
            store.append(source(), table, load=load)
            per_server = store.read_load(table, load).groupBy("ServerName").agg(F.count(F.lit(1)).alias("RowsLoaded"))
            rows = _log_rows(per_server, collector, as_of, "OK", table)
        except Exception as error:  # noqa: BLE001 - one source must not stop the run
            names = [(n, 0) for n in (servers or {}).get(table, [None])]
            failed = spark.createDataFrame(names, "ServerName string, RowsLoaded long")
            rows = _log_rows(failed, collector, as_of, "ERROR", f"{table}: {error}"[:2000])
        logged = logged.unionByName(rows)
    load = uuid.uuid4().hex
    store.append(logged, "CollectionLog", load=load)
    return store.read_load("CollectionLog", load)


def _log_rows(counts: DataFrame, collector: str, as_of, outcome: str, message: str) -> DataFrame:
    """Rows of the collection log from ServerName and RowsLoaded."""
    values = {
        "RunAt": F.lit(moment(as_of)), "Collector": F.lit(collector), "ServerName": F.col("ServerName"),
        "Status": F.lit(outcome), "RowsLoaded": F.col("RowsLoaded"), "Message": F.lit(message),
    }
    return counts.select(*[values[c].cast(t).alias(c) for c, t in TABLES["CollectionLog"].items()])


def log_step(store, result: DataFrame, step: str, as_of) -> None:
    """Log what a step of the cycle computed, per server."""
    counts = result.groupBy("ServerName").agg(F.count(F.lit(1)).alias("RowsLoaded"))
    store.append(_log_rows(counts, step, as_of, "OK", step), "CollectionLog", load=f"{step}-{moment(as_of):%Y%m%dT%H%M%S}")


def partitioned(df: DataFrame) -> DataFrame:
    """Ready to be written: by day, in files of even size, ordered for skipping."""
    time = "CollectedAt" if "CollectedAt" in df.columns else "RunAt"
    dated = df.withColumn(SNAPSHOT_DATE, F.to_date(time))
    return dated.hint("rebalance", SNAPSHOT_DATE).sortWithinPartitions("ServerName", time)
