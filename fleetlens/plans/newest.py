"""The newest row per key, and the newest cycles per server, kept up from one cycle to the next.

The state of a series is what :func:`fold` made of all its loads up to a list of the store (the mark). A later
reader adds the loads since the mark and nothing else: the newest is an associative maximum, so days that are folded are not read
again, whatever the length of the history, and a load folded twice changes nothing. Loads may come late: their rows compete by
time like all others. Days that were rewritten since the mark are read again as a whole, and rows of days that are
gone leave the state, so the answer is that of the windows over the whole series at any moment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.expressions import ts_lit
from fleetlens.operators.latest import SNAPSHOT_DATE, at_cycles, first_per_key, latest_row, until
from fleetlens.schemas import ROW_KEYS, TABLES, struct
from fleetlens.sources.live import Entry, LiveTable

#: Cycles per server that are kept: the newest, and the one before for counters.
CYCLES = 2
#: Series of which whole cycles are reported, and who runs a cycle.
CYCLE_KEYS = {
    "QuerySnapshot": ["Platform", "ServerName"],
    **{t: ["ServerName"] for t in ("WaitStats", "TableHealth", "TopQueries", "LoginActivity", "SpectrumScan", "IndexHealth", "FileIOStats", "QueryCost", "LockWait")},
}
PART = "part"


def _order(table: str) -> list[str]:
    """What settles equal times: every other column, as in the reports over a store."""
    return [c for c in TABLES[table] if c != "CollectedAt"]


def _state(store, table: str) -> LiveTable:
    schema = struct(table)
    if table in CYCLE_KEYS:
        schema = type(schema)([f for f in schema.fields if f.name in [*CYCLE_KEYS[table], "CollectedAt"]])
    return LiveTable(store.spark, store.files, f"{store.root}/newest/{table}", schema, PART)


def _reduced(table: str, rows: DataFrame) -> DataFrame:
    if table in ROW_KEYS:
        return latest_row(rows.select(*TABLES[table]), ROW_KEYS[table], tie=_order(table))
    keys = CYCLE_KEYS[table]
    times = rows.select(*keys, "CollectedAt").distinct()
    newest = first_per_key(times, keys, F.desc("CollectedAt"))
    older = _others(times, newest, keys)
    return newest.unionByName(first_per_key(older, keys, F.desc("CollectedAt")))


def _others(times: DataFrame, cycles: DataFrame, keys) -> DataFrame:
    """The rows of ``times`` that are none of ``cycles``."""
    same = cycles.select(*[F.col(k).alias(f"_n_{k}") for k in [*keys, "CollectedAt"]])
    cond = F.lit(True)
    for k in [*keys, "CollectedAt"]:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_n_{k}"))
    return times.join(same, cond, "left_anti")


def _pieces(store, table: str) -> tuple[DataFrame | None, list[Entry], int]:
    """The rows of the state that still count, the loads to add to them, and the number of the list they make whole."""
    series, state = store.series(table).live(), _state(store, table)
    held = state.live()
    mark = int(held.entries[0].load.split("-")[1]) if held.entries else 0
    again = {e.part for e in series.entries if e.since > mark and e.load.startswith("rewritten-")}
    tail = [e for e in series.entries if e.since > mark or e.part in again]
    rows = state.frame(held.entries)
    if rows is not None:
        there = sorted({e.part for e in series.entries} - again)
        day = F.coalesce(F.to_date("CollectedAt").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
        rows = rows.drop(PART).filter(day.isin(there))
    return rows, tail, series.number


def _joined(store, table: str, rows: DataFrame | None, tail: list[Entry]) -> DataFrame:
    columns = TABLES[table] if table in ROW_KEYS else [*CYCLE_KEYS[table], "CollectedAt"]
    added = store.read(table, tail).select(*columns)
    return added if rows is None else rows.select(*columns).unionByName(added)


def fold(store, table: str) -> None:
    """Move the state of a series up to all loads that count now."""
    rows, tail, number = _pieces(store, table)
    if not tail and rows is None:
        return
    reduced = _reduced(table, _joined(store, table, rows, tail)).withColumn(PART, F.lit("all"))
    _state(store, table).add(reduced.coalesce(1) if table in CYCLE_KEYS else reduced, f"fold-{number}", replacing=lambda part: True)


def fold_all(store) -> None:
    for table in [*ROW_KEYS, *CYCLE_KEYS]:
        if store.days(table):
            fold(store, table)


def newest(store, table: str, as_of=None) -> DataFrame:
    """Rows of a series among which are the newest row of each key, or all rows of the newest cycles, at ``as_of``.

    A time before the newest one in the state asks for history that the state has
    replaced: then the whole series up to that time is the answer.
    """
    rows, tail, _ = _pieces(store, table)
    if rows is None or (as_of is not None and not rows.filter(F.col("CollectedAt") > ts_lit(as_of)).isEmpty()):
        return until(store.read(table), as_of)
    found = _joined(store, table, rows, tail)
    if as_of is not None:
        found = until(found, as_of)
    if table in ROW_KEYS:
        return found
    cycles = _reduced(table, found)
    days = {str(r[0]) for r in cycles.select(F.to_date("CollectedAt")).distinct().collect()}  # days of the calendar
    entries = [e for e in store.series(table).live().entries if e.part in days or "None" in days]
    return at_cycles(until(store.read(table, entries), as_of), cycles, CYCLE_KEYS[table])
