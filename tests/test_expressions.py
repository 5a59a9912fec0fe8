from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import expressions as X


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


@pytest.mark.parametrize(
    "unit, a, b, want",
    [
        ("day", "2024-01-01 23:59:59", "2024-01-02 00:00:00", 1),
        ("hour", "2024-01-01 23:59:59", "2024-01-02 00:00:00", 1),
        ("minute", "2024-01-01 23:59:59", "2024-01-02 00:00:00", 1),
        ("second", "2024-01-01 23:59:59", "2024-01-02 00:00:00", 1),
        ("day", "2024-01-01 00:00:00", "2024-01-01 23:59:59", 0),
        ("hour", "2024-01-01 10:00:00", "2024-01-01 10:59:59", 0),
        ("minute", "2024-01-01 10:00:59", "2024-01-01 10:01:00", 1),
        ("second", "2024-01-02 00:00:00", "2024-01-01 00:00:00", -86400),
    ],
)
def test_boundary_diff(spark, unit, a, b, want):
    assert one(spark, X.boundary_diff(unit, X.ts_lit(a), X.ts_lit(b))) == want


def test_boundary_diff_null_and_unknown(spark):
    assert one(spark, X.boundary_diff("day", F.lit(None).cast("timestamp_ntz"), X.ts_lit("2024-01-01"))) is None
    with pytest.raises(ValueError):
        X.boundary_diff("week", "a", "b")


def test_clock_does_not_depend_on_the_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        # 02:30 does not exist there on this day
        assert one(spark, X.ts_lit("2024-03-10 02:30:00")) == datetime(2024, 3, 10, 2, 30)
        gap = X.boundary_diff("second", X.ts_lit("2024-03-10 01:00:00"), X.ts_lit("2024-03-10 03:00:00"))
        assert one(spark, gap) == 7200
        assert one(spark, X.minute_text(X.ts_lit("2024-03-10 02:30:00"))) == "2024-03-10 02:30"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_text(spark):
    assert one(spark, X.cat(X.txt("a"), F.lit(None), F.lit(3))) == "a3"
    assert one(spark, X.or_text(F.lit(None).cast("bigint"), "?")) == "?"
    assert one(spark, X.day_text(X.ts_lit("2024-01-05 06:07:08"))) == "2024-01-05"
    for number, text in [(4200.0, "4200"), (86.3, "86.3"), (0.125, "0.125"), (1e7, "10000000"), (0.0, "0"), (100.0, "100")]:
        assert one(spark, X.number_text(F.lit(number))) == text


def test_first_rule_wins_and_null_does_not_match(spark):
    v = F.lit(None).cast("int")
    assert one(spark, X.status([("CRIT", v > 1), ("WARN", v.isNull())])) == "WARN"
    assert one(spark, X.status([("CRIT", v > 1)])) == "OK"


def test_ranks(spark):
    got = [one(spark, X.severity_rank(F.lit(s))) for s in ("CRIT", "WARN", "OK", None)]
    assert got == [0, 1, 2, 2]


def test_rounding_is_half_up(spark):
    from decimal import Decimal

    assert one(spark, X.percent_of(F.lit(1), F.lit(800), 5, 2)) == Decimal("0.13")
    assert one(spark, X.percent_of(F.lit(1), F.lit(0), 5, 2)) is None
    assert one(spark, X.gib(F.lit(1610612736), 12, 1)) == Decimal("1.5")


def test_second_and_date(spark):
    assert one(spark, X.to_second(F.lit("2024-01-01 00:00:07.179575").cast("timestamp_ntz"))) == datetime(2024, 1, 1, 0, 0, 7)
    assert one(spark, X.date_lit("2024-01-31 10:00:00", days=-1)) == date(2024, 1, 30)
