"""Advice: long lock waits, classified, with cause, remedy and prevention."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import constants as K
from fleetlens.functions.expressions import cat, or_text, status, txt
from fleetlens.operators.latest import latest_cycle, until
from fleetlens.operators.reconcile import reconcile

#: columns an open finding takes over from the newest evaluation
REFRESHED = ["Severity", "Title", "Symptom", "RootCause", "Recommendation", "Prevention", "Evidence"]


def fill(template: str) -> Column:
    """A text with ``{Column}`` filled in; NULL is empty, or ``?`` for ``{Column?}``."""
    parts = []
    for piece in re.split(r"(\{\w+\??\})", template):
        name = re.fullmatch(r"\{(\w+)(\??)\}", piece)
        if name is None:
            parts.append(txt(piece))
        elif name[2]:
            parts.append(or_text(name[1], "?"))
        else:
            parts.append(F.col(name[1]))
    return cat(*parts)


def lock_pattern() -> Column:
    waiter = F.col("WaiterQuery")
    ddl = F.lit(False)
    for verb in K.DDL_PREFIXES:
        ddl = ddl | waiter.ilike(f"{verb}%")
    return status(
        [
            ("IDLE_TXN", F.col("BlockerIdleInTxn") == 1),
            ("DDL", ddl),
            ("CONFLICT", F.col("ConflictCount24h") > 0),
            ("VACUUM", F.coalesce(F.col("BlockerQuery").ilike("%VACUUM%"), F.lit(False)) | waiter.ilike("VACUUM%")),
        ],
        "GENERIC",
    )


def _by_pattern(texts: dict[str, str]) -> Column:
    return status_text([(name, fill(text)) for name, text in texts.items()])


def status_text(choices) -> Column:
    out = None
    for name, value in choices:
        cond = F.col("Pattern") == name
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out


def lock_findings(locks: DataFrame, block_minutes: int = 30, cycles: DataFrame | None = None) -> DataFrame:
    """One finding per waiter and relation of the newest lock-wait cycle."""
    rows = (
        latest_cycle(locks, cycles=cycles)
        .filter(F.coalesce("WaitMinutes", F.lit(0)) >= block_minutes)
        .withColumn("Pattern", lock_pattern())
        .withColumn("Conflicts", F.coalesce("ConflictCount24h", F.lit(0)))
    )
    sql_tail = F.concat(F.lit(' blocker_sql="'), F.substring("BlockerQuery", 1, 120), F.lit('"'))
    return rows.select(
        cat(txt("RSBlock|"), "ServerName", txt("|"), "WaiterPid", txt("|"), "Relation").alias("FindingKey"),
        F.lit("Redshift").alias("Platform"),
        F.lit("Blocking").alias("Category"),
        F.lit("CRIT").alias("Severity"),
        "ServerName",
        fill(K.FINDING_TITLE).alias("Title"),
        fill(K.FINDING_SYMPTOM).alias("Symptom"),
        _by_pattern(K.ROOT_CAUSE).alias("RootCause"),
        _by_pattern(K.RECOMMENDATION).alias("Recommendation"),
        _by_pattern(K.PREVENTION).alias("Prevention"),
        cat(fill(K.FINDING_EVIDENCE), sql_tail).alias("Evidence"),
    )


def generate_findings(
    locks: DataFrame, prev: DataFrame, as_of, block_minutes: int = 30, cycles: DataFrame | None = None
) -> DataFrame:
    """The findings table after this evaluation, from the lock waits up to ``as_of``; only lock findings are resolved by it."""
    current = lock_findings(until(locks, as_of), block_minutes, cycles)
    mine = (F.col("Platform") == "Redshift") & (F.col("Category") == "Blocking")
    return reconcile(prev, current, "FindingKey", as_of, REFRESHED, "Title", scope=mine)
