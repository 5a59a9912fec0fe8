"""The collection cycle, and the report contract over a store."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.expressions import severity_rank, ts_lit
from fleetlens.operators.latest import until
from fleetlens.operators.ranking import access_rank
from fleetlens.plans import reports as R
from fleetlens.plans.alerts import evaluate_alerts
from fleetlens.plans.anomaly import cost_anomaly
from fleetlens.plans.daily import forecast_from_daily, keep_daily, stored_daily
from fleetlens.plans.findings import generate_findings
from fleetlens.plans.forecast import disk_forecast
from fleetlens.plans.newest import fold_all, newest
from fleetlens.plans.retention import apply_compaction, apply_retention, merge_loads
from fleetlens.schemas import TABLES
from fleetlens.sources.ingest import log_step


def _by_status(*then, column="Status"):
    return lambda: [severity_rank(column), *[t() if callable(t) else t for t in then]]


def _desc(name):
    return lambda: F.desc_nulls_last(name)


#: report -> the order in which it is listed
ORDER = {
    "Overview": lambda: [],
    "EstateHealth": lambda: ["OverallRank", "ServerName"],
    "AGSyncStatus": lambda: [F.desc("Status"), "AGName", "DatabaseName"],
    "DataLag": _by_status(_desc("LagSeconds")),
    "DiskForecast": _by_status(lambda: F.asc_nulls_first("DaysToFull"), column="Severity"),
    "AppOwners": lambda: ["Criticality", "ServerName", "AppName"],
    "GrowthKeys": lambda: [F.desc("GrowthGBPerDay")],
    "GrowthDaily": lambda: ["Platform", "ServerName", "ObjectName", "Day"],
    "CostAnomaly": lambda: [F.desc("DetectedAt"), F.desc_nulls_last("PctAboveBaseline")],
    "CostTrend": lambda: ["ServerName", "MetricName", "Day"],
    "ActiveAlerts": lambda: [severity_rank("Severity"), F.desc("LastSeen")],
    "BackupHealth": _by_status("ServerName", "DatabaseName"),
    "JobFailures": lambda: [F.desc("RunAt")],
    "InstanceVitals": _by_status("ServerName", "MetricName"),
    "ActiveQueries": _by_status(_desc("DurationSec"), column="RowStatus"),
    "TopWaits": lambda: ["ServerName", F.desc("WaitTimeMs")],
    "TableHealth": _by_status(_desc("UnsortedPct")),
    "TopQueries": lambda: [F.desc_nulls_last("TotalCpuMs")],
    "Findings": _by_status(_desc("AgeMinutes"), column="Severity"),
    "ServerInfo": lambda: ["ServerName"],
    "ConfigAudit": _by_status("ServerName", "ConfigItem"),
    "AccessControl": lambda: ["ServerName", access_rank()],
    "Principals": lambda: ["ServerName", access_rank(), "PrincipalName"],
    "IndexHealth": lambda: ["ServerName", "Kind", "ObjectName"],
    "FileIOStats": _by_status(
        lambda: F.desc(F.coalesce("ReadLatencyMs", F.lit(0)) + F.coalesce("WriteLatencyMs", F.lit(0)))
    ),
    "WaitDelta": lambda: ["ServerName", F.desc("DeltaMs")],
    "AutoGrowthEvents": lambda: [F.desc("EventTime")],
    "FailedLogins": lambda: [F.desc("EventTime")],
    "LoginActivity": lambda: ["ServerName", F.desc("SessionCount")],
    "StaleTables": _by_status(_desc("SizeGB")),
    "SpectrumByTable": lambda: [F.desc_nulls_last("TBScanned")],
    "CostlyQueries": lambda: [F.desc_nulls_last("EstCostUSD"), F.desc_nulls_last("ScanGB")],
    "Servers": lambda: [F.desc("IsActive"), "Platform", "ServerName"],
}


#: Arguments of the reports in SQL, and the column each filters, where a report has it.
FILTERS = {"platform": "Platform", "server": "ServerName", "status": "Status", "severity": "Severity", "category": "Category"}


class Reports:
    """All reports of a store at one point in time, built on demand.

    Rows collected, and events that happened, after ``as_of`` are not seen. State tables (forecast, anomalies,
    alerts, findings, inventory) are those of the last cycle.
    """

    def __init__(self, store, as_of):
        self.store, self.as_of = store, as_of

    def _read(self, table):
        """The series as it was at ``as_of``."""
        return until(self.store.read(table), self.as_of, "CollectedAt" if "CollectedAt" in TABLES[table] else "RunAt")

    def _newest(self, table):
        """What the newest rows or cycles at ``as_of`` are among; from the state that is kept up, where it has them."""
        return newest(self.store, table, self.as_of)

    def _state(self, table):
        return self.store.read_state(table)

    @cached_property
    def _built(self) -> dict[str, DataFrame]:
        return {}

    def frame(self, name: str) -> DataFrame:
        """One report, unordered."""
        if name not in ORDER:
            raise KeyError(f"no report named {name!r}")
        if name not in self._built:
            self._built[name] = getattr(self, f"_{name}")()
        return self._built[name]

    def report(self, name: str, **filters) -> DataFrame:
        """One report as listed: equality filters on columns, then its order."""
        df = self.frame(name)
        for column, value in filters.items():
            df = df.filter(F.col(column) == value)
        order = ORDER[name]()
        return df.orderBy(*order) if order else df

    def forecast(self, lookback: int = 30) -> DataFrame:
        """The disk forecast over any number of whole days, from the summaries of the days."""
        return forecast_from_daily(stored_daily(self.store, self.as_of, lookback), self.as_of, lookback)

    def register_views(self, prefix: str = "rpt_") -> list[str]:
        """Expose every report to SQL as a temporary view."""
        for name in ORDER:
            self.frame(name).createOrReplaceTempView(prefix + name)
        return [prefix + name for name in ORDER]

    def register_functions(self, prefix: str = "report_") -> list[str]:
        """Expose every report to SQL as a table function, in its order and with its filters as named arguments.

        ``SELECT * FROM report_DataLag(server => 'srv1', status => 'CRIT')``; an argument that is left out
        filters nothing.
        """
        spark = self.store.spark
        for name in ORDER:
            listed = self.report(name)
            view = f"{prefix}{name}_listed"
            listed.createOrReplaceTempView(view)
            taken = [(argument, column) for argument, column in FILTERS.items() if column in listed.columns]
            arguments = ", ".join(f"{a} STRING DEFAULT NULL" for a, _ in taken)
            wanted = " AND ".join([*(f"({prefix}{name}.{a} IS NULL OR {view}.{c} = {prefix}{name}.{a})" for a, c in taken), "true"])
            columns = ", ".join(f"`{c}` {t}" for c, t in listed.dtypes)
            spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({arguments}) RETURNS TABLE ({columns}) RETURN
                SELECT * FROM {view} WHERE {wanted}""")
        return [prefix + name for name in ORDER]

    def _AGSyncStatus(self):
        return R.ag_sync_status(self._newest("AGSyncStatus"))

    def _DataLag(self):
        return R.data_lag(self._newest("DataLag"))

    def _DiskForecast(self):
        return R.disk_forecast_report(self._state("DiskForecast"))

    def _AppOwners(self):
        return R.app_owners(self._state("AppOwners"))

    def _GrowthKeys(self):
        return R.growth_keys(self._read("ObjectSize"))

    def _GrowthDaily(self):
        return R.growth_daily(self._read("ObjectSize"))

    def _CostAnomaly(self):
        return R.cost_anomaly_report(self._state("CostAnomaly"), self.as_of)

    def _CostTrend(self):
        return R.cost_trend(self._read("RedshiftCost"))

    def _ActiveAlerts(self):
        return R.active_alerts(self._state("AlertHistory"), self._state("AppOwners"))

    def _BackupHealth(self):
        return R.backup_health(self._newest("BackupStatus"), self.as_of)

    def _JobFailures(self):
        return R.job_failures(self._read("JobFailure"), self.as_of)

    def _InstanceVitals(self):
        return R.instance_vitals(self._newest("HealthMetric"))

    def _ActiveQueries(self):
        return R.active_queries(self._newest("QuerySnapshot"))

    def _TopWaits(self):
        return R.top_waits(self._newest("WaitStats"))

    def _TableHealth(self):
        return R.table_health(self._newest("TableHealth"))

    def _TopQueries(self):
        return R.top_queries(self._newest("TopQueries"))

    def _Findings(self):
        return R.findings_report(self._state("Finding"), self.as_of)

    def _ServerInfo(self):
        return R.server_info(self._newest("ServerInfo"))

    def _ConfigAudit(self):
        return R.config_audit(self._newest("ConfigAudit"))

    def _Principals(self):
        return R.principals(self._newest("SecurityPrincipal"))

    def _AccessControl(self):
        return R.access_control(self.frame("Principals"))

    def _IndexHealth(self):
        return R.index_health(self._newest("IndexHealth"))

    def _FileIOStats(self):
        return R.file_io(self._newest("FileIOStats"))

    def _WaitDelta(self):
        return R.wait_delta(self._newest("WaitStats"))

    def _AutoGrowthEvents(self):
        return R.autogrowth(self._read("AutoGrowth"), self.as_of)

    def _FailedLogins(self):
        return R.failed_logins(self._read("FailedLogin"), self.as_of)

    def _LoginActivity(self):
        return R.login_activity(self._newest("LoginActivity"))

    def _StaleTables(self):
        return R.stale_tables(self._read("ObjectSize"), self._read("TableScan"), self.as_of)

    def _SpectrumByTable(self):
        return R.spectrum_by_table(self._newest("SpectrumScan"))

    def _CostlyQueries(self):
        return R.costly_queries(self._newest("QueryCost"))

    def _Servers(self):
        return R.servers_report(self._state("Servers"), self._read("CollectionLog"))

    def _EstateHealth(self):
        f = self.frame
        return R.estate_health(
            self._state("Servers"), f("BackupHealth"), f("DiskForecast"), f("JobFailures"), f("AGSyncStatus"),
            f("InstanceVitals"), f("DataLag"), f("TableHealth"), self.as_of,
        )

    def _Overview(self):
        f = self.frame
        return R.overview(
            self._state("Servers"), self._state("AppOwners"), self._read("CollectionLog"), f("AGSyncStatus"),
            f("DataLag"), f("DiskForecast"), f("BackupHealth"), f("JobFailures"), f("InstanceVitals"),
            self._state("Finding"), f("ConfigAudit"), f("AccessControl"), f("FileIOStats"), self.as_of,
        )


def run_cycle(store, as_of, retention_days: int = 90) -> Reports:
    """Forecast, anomalies, findings, alerts, retention, in that order.

    Findings come before alerts because critical findings raise alerts. Each
    step reads what the step before has written. Of alerts and findings only the open
    ones are read and replaced; what a cycle closes is added to the closed ones.
    """
    store.write_state(disk_forecast(store.read("DiskUsage"), as_of), "DiskForecast")
    log_step(store, store.read_state("DiskForecast"), "forecast", as_of)

    known = store.read_state("CostAnomaly")
    found = cost_anomaly(store.read("RedshiftCost"), known, as_of)
    store.grow_state(found, "CostAnomaly")
    log_step(store, store.read_state("CostAnomaly").filter(F.col("DetectedAt") == ts_lit(as_of)), "anomaly", as_of)

    store.advance_state(generate_findings(newest(store, "LockWait", as_of), store.read_open("Finding"), as_of), "Finding")

    reports = Reports(store, as_of)
    alerts = evaluate_alerts(
        store.read_open("AlertHistory"),
        as_of,
        disk=store.read_state("DiskForecast"),
        ag=reports.frame("AGSyncStatus"),
        lag=reports.frame("DataLag"),
        cost=store.read_state("CostAnomaly"),  # all of it: the report lists the newest 500
        backup=reports.frame("BackupHealth"),
        jobs=reports.frame("JobFailures"),
        vitals=reports.frame("InstanceVitals"),
        tables=reports.frame("TableHealth"),
        findings=store.read_open("Finding"),
    )
    store.advance_state(alerts, "AlertHistory")

    apply_compaction(store)
    merge_loads(store, as_of)
    apply_retention(store, as_of, retention_days)
    fold_all(store)
    keep_daily(store, str(as_of)[:10])
    store.sweep()
    return Reports(store, as_of)
