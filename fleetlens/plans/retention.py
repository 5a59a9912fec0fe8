"""Retention and compaction of the stored history."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetlens.functions.expressions import moment, ts_lit
from fleetlens.operators.latest import SNAPSHOT_DATE, first_per_key
from fleetlens.schemas import SERIES
from fleetlens.sources.live import LiveTable
from fleetlens.sources.store import GROWN, SPLIT

#: never aged: the whole scan history is what tells stale tables from used ones
KEPT_FOREVER = ["TableScan"]
#: loads of a month of closed state that are merged
MERGED_FROM = 32
AGED = [t for t in SERIES if t not in KEPT_FOREVER]

#: one row per real event; each run reads the same day of events again
EVENT_KEYS = {
    "TableScan": ["ServerName", "TableName", "_day"],
    "AutoGrowth": ["ServerName", "EventTime", "DatabaseName", "FileType"],
    "FailedLogin": ["ServerName", "EventTime", "Message"],
    "JobFailure": ["ServerName", "JobName", "StepName", "RunAt"],
}


def retain_rows(df: DataFrame, table: str, as_of, days: int = 90) -> DataFrame:
    """Rows of ``table`` that retention keeps."""
    cut = ts_lit(as_of, days=-days)
    if table == "Finding":
        return df.filter(~F.coalesce(F.col("Resolved") & (F.col("ResolvedAt") < cut), F.lit(False)))
    if table == "CollectionLog":
        return df.filter(F.col("RunAt") >= cut)
    if table in AGED:
        kept = df.filter(F.col("CollectedAt") >= cut)
        return kept.filter(F.col(SNAPSHOT_DATE) >= F.to_date(cut)) if SNAPSHOT_DATE in df.columns else kept
    return df


def retain(tables: dict[str, DataFrame], as_of, days: int = 90) -> dict[str, DataFrame]:
    return {name: retain_rows(df, name, as_of, days) for name, df in tables.items()}


def compact(df: DataFrame, table: str, *tie) -> DataFrame:
    """The newest row per event."""
    keys = EVENT_KEYS[table]
    rows = df.withColumn("_day", F.to_date("LastScanned")) if "_day" in keys else df
    rest = [c for c in ("Message", "GrowthMB", "DurationMs") if c in df.columns and c not in keys]
    order = [F.desc(c) for c in (tie or ("CollectedAt", *rest))]
    return first_per_key(rows, keys, *order).drop("_day")


def apply_retention(store, as_of, days: int = 90) -> None:
    """Age the stored series.

    Whole days, and months of closed findings, go without reading them; only the day and
    the month the cut falls into are rewritten.
    """
    cut = moment(as_of) - timedelta(days=days)
    day = cut.date().isoformat()
    for table in [*AGED, "CollectionLog"]:
        store.drop_days_before(table, day)
        if day in store.days(table) and cut.time() != cut.min.time():
            store.rewrite_days(table, lambda df, t=table: retain_rows(df, t, as_of, days), [day])
    month = f"closed-{day[:7]}"
    store.drop_closed("Finding", lambda part: part < month and part != "closed-never")
    if month in store.closed_parts("Finding"):
        store.rewrite_closed("Finding", [month], lambda df: retain_rows(df, "Finding", as_of, days))


def _events(df: DataFrame, table: str) -> DataFrame:
    """Hash of the event, the day it happened (part of its key), the day it is stored under, and in how many rows."""
    keys = EVENT_KEYS[table]
    rows = df.withColumn("_day", F.to_date("LastScanned")) if "_day" in keys else df
    happened = next(k for k in keys if k in ("EventTime", "RunAt", "_day"))
    rows = rows.select(
        F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys]).alias("h"),
        F.coalesce(F.to_date(happened).cast("string"), F.lit("never")).alias("part"), F.col(SNAPSHOT_DATE).cast("string").alias("day"),
    )
    return rows.groupBy("h", "part", "day").agg(F.count(F.lit(1)).alias("n"))


def _index(store, table: str) -> LiveTable:
    return LiveTable(store.spark, store.files, f"{store.root}/events/{table}", StructType.fromDDL("h long, day string, n long"), "part")


def apply_compaction(store) -> None:
    """Collapse events that were read more than once, however far apart.

    An index tells for each event under which days it is stored, in parts by the day it happened. A run reads the loads since the
    last one, and the index of the days on which their events happened; of the series it reads and
    rewrites only the days that hold an event of these more than once. A 64-bit hash stands for an event: if
    two share one, days are looked at in vain, and nothing is lost, as the rows are told apart by their keys.
    """
    for table in EVENT_KEYS:
        series, index = store.series(table), _index(store, table)
        live, held = series.live(), index.live().entries
        mark = max((int(e.load.split("-")[1]) for e in held), default=0)
        again = {e.part for e in live.entries if e.since > mark and e.load.startswith("rewritten-")}
        tail = [e for e in live.entries if e.since > mark or e.part in again]
        if not tail:
            continue
        found = _events(store.read(table, tail), table)
        happened = {r[0] for r in found.select("part").distinct().collect()}  # days of the calendar
        known = index.frame(e for e in held if e.part in happened)
        if known is not None:
            there = sorted({e.part for e in live.entries} - again)
            found = found.unionByName(known.filter(F.col("day").isin(there)).select(*found.columns))
        events = found.groupBy("h", "part").agg(F.sum("n").alias("n"), F.collect_set("day").alias("days"), F.max("day").alias("day"))
        days = sorted(r[0] for r in events.filter("n > 1").select(F.explode("days")).distinct().collect())  # days of the calendar
        left = events.select("h", "part", "day", F.lit(1).cast("long").alias("n")).repartition("part")
        if days:
            store.rewrite_days(table, lambda df, t=table: compact(df, t), days)
        now = series.live()
        only_ours = all(e.load.startswith("rewritten-") for e in now.entries if e.since > live.number)
        index.add(left, f"events-{now.number if only_ours else live.number}", replacing=lambda part: part in happened)


def merge_loads(store, as_of) -> None:
    """One load instead of many for each day that is over, in every series, and for each month of closed state: fewer
    directories to list. Rows stay as they are."""
    today = moment(as_of).date().isoformat()
    for table in [*SERIES, "CollectionLog"]:
        days = [d for d in store.days(table) if d < today and len(store.loads(table, d)) > 1]
        if days:
            store.rewrite_days(table, lambda df: df, days)
    for table in [*SPLIT, *GROWN]:
        split = store.closed_loads(table)
        store.rewrite_closed(table, [part for part, loads in split.items() if loads > MERGED_FROM], lambda df: df)
