"""Column expressions shared by every report: clock arithmetic, text, statuses.

All clock arithmetic works on ``timestamp_ntz`` without going through the
session time zone, so results do not depend on where a job runs.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

GIB = 1073741824


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def moment(as_of) -> datetime:
    """The evaluation time as a naive datetime, whole seconds."""
    when = datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    return when.replace(microsecond=0, tzinfo=None)


def ts_lit(as_of, **shift) -> Column:
    """A ``timestamp_ntz`` literal, optionally shifted: ``ts_lit(t, days=-7)``."""
    when = moment(as_of) + timedelta(**shift)
    return F.lit(when.isoformat(sep=" ")).cast("timestamp_ntz")


def date_lit(as_of, **shift) -> Column:
    when = moment(as_of) + timedelta(**shift)
    return F.lit(when.date().isoformat()).cast("date")


def to_second(c) -> Column:
    """Drop the fraction of a second."""
    c = col(c)
    return c - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.extract(F.lit("SECOND"), c) % 1)


def boundary_diff(unit: str, start, end) -> Column:
    """Number of ``unit`` boundaries crossed between two timestamps.

    23:59:59 to 00:00:00 is one day, one hour, one minute and one second,
    unlike ``timestampdiff``, which counts completed units.
    """
    start, end = col(start), col(end)
    diff = F.datediff(end, start).cast("bigint")
    steps = [("hour", 24, F.hour), ("minute", 60, F.minute), ("second", 60, F.second)]
    if unit == "day":
        return diff
    for name, size, part in steps:
        diff = diff * F.lit(size) + (part(end) - part(start))
        if name == unit:
            return diff
    raise ValueError(f"unknown unit {unit!r}")


def cat(*parts) -> Column:
    """Concatenate as text, treating NULL as empty. Plain strings are column names."""
    return F.concat_ws("", *[col(p).cast("string") for p in parts])


def txt(value: str) -> Column:
    return F.lit(value)


def or_text(c, default: str) -> Column:
    """The value as text, or ``default`` when it is NULL."""
    return F.coalesce(col(c).cast("string"), F.lit(default))


def minute_text(c) -> Column:
    """``yyyy-MM-dd HH:mm``."""
    return F.substring(col(c).cast("string"), 1, 16)


def day_text(c) -> Column:
    """``yyyy-MM-dd``."""
    return F.substring(col(c).cast("string"), 1, 10)


def number_text(c) -> Column:
    """A number without trailing zeros: 4200, 86.3, 0.125."""
    plain = col(c).cast("decimal(20,3)").cast("string")
    return F.regexp_replace(plain, r"\.?0+$", "")


def status(rules, default: str = "OK") -> Column:
    """First matching rule wins; a condition that is NULL does not match.

    ``rules`` is a list of ``(status, condition)`` pairs.
    """
    return reduce(
        lambda otherwise, rule: F.when(rule[1], F.lit(rule[0])).otherwise(otherwise),
        reversed(list(rules)),
        F.lit(default),
    )


_COMPARE = {
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
}


def threshold_status(name, value, thresholds, default: str = "OK") -> Column:
    """Status from ``(name, operator, bound, status)`` rows, first match wins."""
    name, value = col(name), col(value)
    return status(
        [(sev, (name == metric) & _COMPARE[op](value, F.lit(bound))) for metric, op, bound, sev in thresholds],
        default,
    )


def severity_rank(c) -> Column:
    """CRIT 0, WARN 1, anything else (also NULL) 2."""
    return F.when(col(c) == "CRIT", 0).when(col(c) == "WARN", 1).otherwise(2)


def rank_status(c) -> Column:
    """Inverse of :func:`severity_rank`."""
    return F.when(col(c) == 0, "CRIT").when(col(c) == 1, "WARN").otherwise("OK")


def gib(c, precision: int, scale: int) -> Column:
    """Bytes to GiB, rounded half up."""
    return (col(c).cast("decimal(20,0)") / F.lit(GIB).cast("decimal(10,0)")).cast(f"decimal({precision},{scale})")


def percent_of(part, whole, precision: int = 5, scale: int = 2) -> Column:
    """``100 * part / whole``; NULL where ``whole`` is zero or NULL."""
    whole = F.when(col(whole) != 0, col(whole))
    ratio = (col(part).cast("decimal(24,0)") * 100) / whole.cast("decimal(20,0)")
    return ratio.try_cast(f"decimal({precision},{scale})")


def nullif(c, value) -> Column:
    return F.nullif(col(c), value if isinstance(value, Column) else F.lit(value))
