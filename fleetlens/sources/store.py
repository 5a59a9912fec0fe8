"""The central store: Parquet on a shared file system.

* Series (``mon``): append-only, in parts by ``snapshot_date``; see ``live`` for how loads count.
* State of open and closed rows (``AlertHistory``, ``Finding``): open rows are replaced each time, closed ones stay
  where they are, in parts by month.
* State that only grows (``CostAnomaly``): in parts by month.
* Other state (``DiskForecast``, ``Servers``, ...): whole versions; the newest complete one counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetlens.operators.latest import SNAPSHOT_DATE
from fleetlens.schemas import TABLES, empty, struct
from fleetlens.sources.ingest import conform, partitioned
from fleetlens.sources.live import Entry, Files, LiveTable

#: State tables whose rows are closed at some time, and whose closed rows are never touched again.
SPLIT = ["AlertHistory", "Finding"]
#: State tables to which rows are only added, and the time that tells a row's month.
GROWN = {"CostAnomaly": "DetectedAt"}
PART, OPEN = "part", "open"


class SnapshotStore:
    """Tables of one fleet below ``root``. Any number of appenders, one process that runs cycles.

    Files that no longer count are deleted by the first ``sweep`` after ``grace`` seconds: longer than a query runs.
    """

    def __init__(self, spark: SparkSession, root: str, versions_kept: int = 2, grace: float = 6 * 3600):
        self.spark, self.root, self.versions_kept, self.grace = spark, root.rstrip("/"), versions_kept, grace
        self.files = Files(spark, self.root)

    # ------------------------------------------------------------------ series

    def series_path(self, table: str) -> str:
        return f"{self.root}/series/{table}"

    def series(self, table: str) -> LiveTable:
        return LiveTable(self.spark, self.files, self.series_path(table), struct(table), SNAPSHOT_DATE, "date")

    def append(self, df: DataFrame, table: str, load: str | None = None) -> None:
        """Append rows. A ``load`` id that is stored already is not stored again, so a retried batch counts once."""
        self.series(table).add(partitioned(conform(df, table)), load)

    def read(self, table: str, entries: list[Entry] | None = None) -> DataFrame:
        """The series with its partition column ``snapshot_date``; of ``entries`` if given."""
        rows = self.series(table).frame(entries)
        if rows is None:
            time = "CollectedAt" if "CollectedAt" in TABLES[table] else "RunAt"
            return empty(self.spark, table).withColumn(SNAPSHOT_DATE, F.to_date(time))
        return rows

    def read_load(self, table: str, load: str) -> DataFrame:
        """The rows of one load, as long as it has not been merged into others."""
        own = [e for e in self.series(table).live().entries if e.load == load]
        return self.read(table, own).select(*TABLES[table])

    def days(self, table: str) -> list[str]:
        return self.series(table).parts()

    def drop_days_before(self, table: str, day: str) -> list[str]:
        """Drop the days before ``day`` (yyyy-MM-dd) without reading them."""
        return self.series(table).drop(lambda d: d < day)

    def loads(self, table: str, day: str) -> list[str]:
        """The loads that count of a day."""
        return [e.load for e in self.series(table).live().entries if e.part == day]

    def rewrite_days(self, table: str, rows: Callable[[DataFrame], DataFrame], days) -> None:
        """Replace the given days by what ``rows`` makes of them; a load that arrives meanwhile stays."""
        self.series(table).rewrite(days, lambda df: partitioned(rows(df).select(*TABLES[table])))

    def sweep(self) -> None:
        """Delete the files that have not counted for a while."""
        for kind in ("newest", "daily", "events", "sketches"):  # what is kept up from the series and raw rows
            for table in self.files.children(f"{self.root}/{kind}"):
                LiveTable(self.spark, self.files, f"{self.root}/{kind}/{table}", StructType(), PART).sweep(self.grace)
        for kind in ("series", "state"):
            for table in self.files.children(f"{self.root}/{kind}"):
                if kind == "series" or table in SPLIT or table in GROWN:
                    (self.series if kind == "series" else self._split)(table).sweep(self.grace)

    # ------------------------------------------------------------------- state

    def state_path(self, table: str) -> str:
        return f"{self.root}/state/{table}"

    def _versions(self, table: str) -> list[int]:
        path = self.state_path(table)
        names = [n for n in self.files.children(path) if n.startswith("version=")]
        return sorted(int(n.split("=")[1]) for n in names if self.files.exists(f"{path}/{n}/_SUCCESS"))

    def _split(self, table: str) -> LiveTable:
        return LiveTable(self.spark, self.files, self.state_path(table), struct(table), PART)

    def _with_part(self, df: DataFrame, table: str) -> DataFrame:
        rows = df.select(*[F.col(c).cast(t) for c, t in TABLES[table].items()])
        if table in GROWN:
            return rows.withColumn(PART, F.coalesce(F.date_format(GROWN[table], "yyyy-MM"), F.lit("never"))).repartition(PART)
        month = F.coalesce(F.date_format("ResolvedAt", "yyyy-MM"), F.lit("never"))
        closed = F.coalesce(F.col("Resolved"), F.lit(False))
        return rows.withColumn(PART, F.when(closed, F.concat(F.lit("closed-"), month)).otherwise(F.lit(OPEN))).repartition(PART)

    def advance_state(self, df: DataFrame, table: str) -> None:
        """Store what an evaluation of the open rows made of them: those still open take the place of
        all open rows, those it closed are added to the closed ones. Both by one commit."""
        self._split(table).add(self._with_part(df, table), replacing=lambda part: part == OPEN)

    def grow_state(self, df: DataFrame, table: str, load: str | None = None) -> None:
        """Add rows to a state table that only grows; a ``load`` id that is stored already adds nothing."""
        self._split(table).add(self._with_part(df, table), load)

    def read_open(self, table: str) -> DataFrame:
        """The open rows of a state table."""
        split = self._split(table)
        rows = split.frame(e for e in split.live().entries if e.part == OPEN)
        return empty(self.spark, table) if rows is None else rows.drop(PART)

    def closed_parts(self, table: str) -> list[str]:
        return [p for p in self._split(table).parts() if p != OPEN]

    def closed_loads(self, table: str) -> dict[str, int]:
        """How many loads each closed part is made of."""
        parts = [e.part for e in self._split(table).live().entries if e.part != OPEN]
        return {p: parts.count(p) for p in set(parts)}

    def rewrite_closed(self, table: str, parts, rows: Callable[[DataFrame], DataFrame]) -> None:
        self._split(table).rewrite(parts, lambda df: self._with_part(rows(df), table))

    def drop_closed(self, table: str, which: Callable[[str], bool]) -> list[str]:
        return self._split(table).drop(lambda part: part != OPEN and which(part))

    def write_state(self, df: DataFrame, table: str) -> int | None:
        """Replace all rows of a state table; returns the number of the version, if the table has versions."""
        if table in SPLIT or table in GROWN:
            self._split(table).add(self._with_part(df, table), replacing=lambda part: True)
            return None
        done = self._versions(table)
        number = (done[-1] if done else 0) + 1
        rows = df.select(*[F.col(c).cast(t) for c, t in TABLES[table].items()])
        rows.write.mode("overwrite").parquet(f"{self.state_path(table)}/version={number:08d}")
        for old in done[: -self.versions_kept + 1 or None] if self.versions_kept > 1 else done:
            self.files.delete(f"{self.state_path(table)}/version={old:08d}")
        return number

    def read_state(self, table: str) -> DataFrame:
        if table in SPLIT or table in GROWN:
            rows = self._split(table).frame()
            return empty(self.spark, table) if rows is None else rows.drop(PART)
        done = self._versions(table)
        if not done:
            return empty(self.spark, table)
        return self.spark.read.schema(struct(table)).parquet(f"{self.state_path(table)}/version={done[-1]:08d}")
