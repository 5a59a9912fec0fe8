"""Alert rules over the reports, alert state, and the notification outbox."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.expressions import (
    cat,
    date_lit,
    day_text,
    minute_text,
    number_text,
    or_text,
    ts_lit,
    txt,
)
from fleetlens.operators.ranking import order_by_severity
from fleetlens.operators.reconcile import reconcile
from fleetlens.plans.reports import active_alerts

RAISED = ["WARN", "CRIT"]


def _alerts(rows: DataFrame, category: str, key, severity: Column, message: Column, server="ServerName") -> DataFrame:
    parts = [txt(category)]
    for k in key:
        parts += [txt("|"), k]
    return rows.select(
        cat(*parts).alias("AlertKey"),
        F.lit(category).alias("Category"),
        severity.alias("Severity"),
        F.col(server).alias("ServerName"),
        message.alias("Message"),
    )


def disk_alerts(disk: DataFrame) -> DataFrame:
    text = cat(
        "ServerName", txt(" "), "VolumeName", txt(" at "), "UsedPct", txt("% - full in "), or_text("DaysToFull", "?"),
        txt(" days (add +"), or_text("RecommendedAddGB", "?"), txt(" GB)"),
    )
    rows = disk.filter(F.col("Severity").isin(RAISED))
    return _alerts(rows, "Disk", ["ServerName", "VolumeName"], F.col("Severity"), text)


def ag_alerts(ag: DataFrame) -> DataFrame:
    text = cat(
        txt("AG "), "AGName", txt(" / "), "DatabaseName", txt(" on "), "ReplicaServer", txt(" is "), "SyncState",
        txt(" / "), "SyncHealth",
    )
    rows = ag.filter(F.col("Status").isin(RAISED))
    return _alerts(rows, "AG", ["AGName", "DatabaseName", "ReplicaServer"], F.col("Status"), text, "ReplicaServer")


def lag_alerts(lag: DataFrame) -> DataFrame:
    text = cat("Platform", txt(" "), "ObjectName", txt(" lag = "), or_text("LagSeconds", "?"), txt("s"))
    rows = lag.filter(F.col("Status").isin(RAISED))
    return _alerts(rows, "Lag", ["ServerName", "ObjectName"], F.col("Status"), text)


def cost_alerts(anomalies: DataFrame, as_of) -> DataFrame:
    """Anomalies observed on the day of ``as_of``."""
    text = cat(
        txt("Cost spike: "), "MetricName", txt(" = "), F.col("Value").cast("decimal(18,3)"), txt(" ("),
        "PctAboveBaseline", txt("% over baseline)"),
    )
    rows = anomalies.filter(F.col("ObservedDay") >= date_lit(as_of))
    return _alerts(rows, "Cost", ["ServerName", "MetricName", "ObservedDay"], F.col("Severity"), text)


def backup_alerts(backup: DataFrame) -> DataFrame:
    text = cat(
        "DatabaseName", txt(" ["), "StateDesc", txt("/"), "RecoveryModel", txt("] last full "),
        F.coalesce(minute_text("LastFullBackup"), F.lit("NEVER")), txt(", last log "),
        F.coalesce(minute_text("LastLogBackup"), F.lit("n/a")), txt(", last CHECKDB "),
        F.coalesce(day_text("LastGoodCheckDb"), F.lit("NEVER")),
    )
    rows = backup.filter(F.col("Status").isin(RAISED))
    return _alerts(rows, "Backup", ["ServerName", "DatabaseName"], F.col("Status"), text)


def job_alerts(jobs: DataFrame, as_of) -> DataFrame:
    at = minute_text("RunAt")
    text = cat(txt("Agent job failed: "), "JobName", txt(" ("), or_text("StepName", "?"), txt(") at "), at)
    rows = jobs.filter(F.col("RunAt") >= ts_lit(as_of, hours=-24))
    return _alerts(rows, "Job", ["ServerName", "JobName", at], F.lit("WARN"), text)


def vitals_alerts(vitals: DataFrame) -> DataFrame:
    text = cat("ServerName", txt(" "), "MetricName", txt(" = "), number_text("MetricValue"))
    rows = vitals.filter(F.col("Status").isin(RAISED))
    return _alerts(rows, "Vitals", ["ServerName", "MetricName"], F.col("Status"), text)


def table_alerts(tables: DataFrame) -> DataFrame:
    """Critical maintenance debt only."""
    def pct(c):
        return F.col(c).cast("decimal(5,1)")

    text = cat(
        "TableName", txt(" unsorted="), pct("UnsortedPct"), txt("% stats_off="), pct("StatsOffPct"),
        txt("% - run VACUUM/ANALYZE"),
    )
    rows = tables.filter(F.col("Status") == "CRIT")
    return _alerts(rows, "TableHealth", ["ServerName", "TableName"], F.col("Status"), text)


def advisor_alerts(findings: DataFrame) -> DataFrame:
    """Open critical findings."""
    text = F.substring(cat("Title", txt(" - "), "Recommendation"), 1, 600)
    rows = findings.filter((F.col("Severity") == "CRIT") & ~F.col("Resolved"))
    return _alerts(rows, "Advisor", ["FindingKey"], F.col("Severity"), text)


def current_conditions(as_of, **reports: DataFrame) -> DataFrame:
    """All conditions that hold now. Reports left out contribute nothing.

    Names: disk, ag, lag, cost, backup, jobs, vitals, tables, findings.
    """
    rules = {
        "disk": disk_alerts,
        "ag": ag_alerts,
        "lag": lag_alerts,
        "cost": lambda df: cost_alerts(df, as_of),
        "backup": backup_alerts,
        "jobs": lambda df: job_alerts(df, as_of),
        "vitals": vitals_alerts,
        "tables": table_alerts,
        "findings": advisor_alerts,
    }
    unknown = set(reports) - set(rules)
    if unknown:
        raise ValueError(f"no alert rule for {sorted(unknown)}")
    return reduce(DataFrame.unionByName, [rule(reports[name]) for name, rule in rules.items() if name in reports])


def evaluate_alerts(prev: DataFrame, as_of, renotify_on_escalation: bool = False, **reports: DataFrame) -> DataFrame:
    """The alert table after this evaluation.

    An alert stays notified when it turns from WARN to CRIT unless
    ``renotify_on_escalation`` is set.
    """
    current = current_conditions(as_of, **reports)
    before = prev.withColumn("_was", F.col("Severity")) if renotify_on_escalation else prev
    after = reconcile(before, current, "AlertKey", as_of, ["Severity", "Message"], "Message")
    if not renotify_on_escalation:
        return after
    worse = (F.col("_was") == "WARN") & (F.col("Severity") == "CRIT") & ~F.col("Resolved")
    return after.withColumn("NotifiedAt", F.when(~F.coalesce(worse, F.lit(False)), F.col("NotifiedAt"))).drop("_was")


# ----------------------------------------------------------------- notification


def notification_outbox(alerts: DataFrame, owners: DataFrame) -> DataFrame:
    """Open alerts nobody was told about, most severe first."""
    rows = active_alerts(alerts, owners).filter(F.col("NotifiedAt").isNull())
    return order_by_severity(rows, "Severity", F.asc("AlertKey"))


def notification_digest(outbox: DataFrame, label: str = "FleetLens") -> DataFrame:
    """One row: how many alerts, how many critical, and the subject line. No row if there are none."""
    counts = outbox.agg(
        F.count(F.lit(1)).alias("Alerts"), F.count_if(F.col("Severity") == "CRIT").alias("Critical")
    ).filter("Alerts > 0")
    tail = F.when(F.col("Critical") > 0, cat(txt(" ("), "Critical", txt(" CRITICAL)")))
    return counts.withColumn("Subject", cat(txt(f"[{label}] "), "Alerts", txt(" new alert(s)"), tail))


def notification_recipients(outbox: DataFrame, recipients: DataFrame, route_to_owners: bool = True) -> DataFrame:
    """Distinct addresses: the configured ones and, if asked, the owners'."""
    named = recipients.select(F.col("Email"))
    if route_to_owners:
        named = named.unionByName(outbox.select(F.col("OwnerEmail").alias("Email")))
    return named.filter("Email IS NOT NULL AND Email <> ''").distinct()


def mark_notified(alerts: DataFrame, sent: DataFrame, as_of) -> DataFrame:
    """Stamp the open, un-notified alerts whose key was sent."""
    keys = sent.select(F.col("AlertKey")).distinct().withColumn("_sent", F.lit(True))
    due = ~F.col("Resolved") & F.col("NotifiedAt").isNull() & F.col("_sent").isNotNull()
    return (
        alerts.join(keys, "AlertKey", "left")
        .withColumn("NotifiedAt", F.when(due, ts_lit(as_of)).otherwise(F.col("NotifiedAt")))
        .select(*alerts.columns)
    )
