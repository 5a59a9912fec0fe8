"""Newest state kept up by loads, and reports that do not see the future."""

import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions import constants as K
from fleetlens.operators.latest import latest_cycle, last_cycles, latest_row
from fleetlens.plans import retention
from fleetlens.plans.cycle import ORDER, Reports, run_cycle
from fleetlens.plans.newest import CYCLE_KEYS, _order, fold, newest
from fleetlens.schemas import COMPUTED, ROW_KEYS, SERIES, TABLES, empty, struct
from fleetlens.sources.store import SnapshotStore

NOW = datetime(2024, 1, 31, 12, 0, 0)
#: Values that the rules of the reports look for.
WORDS = {"MetricName": [m for m, *_ in K.VITALS_THRESHOLDS][:3] if not isinstance(K.VITALS_THRESHOLDS, dict) else list(K.VITALS_THRESHOLDS)[:3]}


def ago(**k):
    return NOW - timedelta(**k)


@pytest.fixture
def store(spark, tmp_path):
    return SnapshotStore(spark, str(tmp_path / "store"))


def made(spark, table, times, seed):
    """A row per time and server, its other values drawn; events happen when they are collected."""
    draw = random.Random(f"{table}{seed}")
    rows = []
    for at in times:
        for server in ("a", "b", None):
            row = []
            for f in struct(table).fields:
                kind = f.dataType
                if f.name == "ServerName":
                    value = server
                elif isinstance(kind, T.TimestampNTZType):
                    value = at
                elif isinstance(kind, T.DateType):
                    value = at.date()
                elif isinstance(kind, T.StringType):
                    value = draw.choice(WORDS.get(f.name, ["x", "y"]))
                elif isinstance(kind, T.BooleanType):
                    value = draw.random() < 0.5
                elif isinstance(kind, T.DecimalType):
                    value = Decimal(draw.randrange(9))
                elif isinstance(kind, (T.DoubleType, T.FloatType)):
                    value = float(draw.randrange(100))
                else:
                    value = draw.randrange(100)
                row.append(value)
            rows.append(tuple(row))
    return spark.createDataFrame(rows, struct(table)).drop(*COMPUTED.get(table, []))


def filled(spark, store, times, seed=0, tables=SERIES):
    for table in [*tables, *(["CollectionLog"] if tables is SERIES else [])]:
        store.append(made(spark, table, times, seed), table)


def listed(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def whole(store, table, as_of=None):
    """The answer of the windows over the whole series."""
    rows = store.read(table)
    if as_of is not None:
        rows = rows.filter(F.col("CollectedAt") <= F.lit(as_of))
    if table in ROW_KEYS:
        return listed(latest_row(rows.select(*TABLES[table]), ROW_KEYS[table], tie=_order(table)))
    return listed(last_cycles(rows.select(*TABLES[table]), CYCLE_KEYS[table], last=2))


def kept(store, table, as_of=None):
    rows = newest(store, table, as_of)
    if table in ROW_KEYS:
        return listed(latest_row(rows.select(*TABLES[table]), ROW_KEYS[table], tie=_order(table)))
    return listed(last_cycles(rows.select(*TABLES[table]), CYCLE_KEYS[table], last=2))


@pytest.mark.parametrize("table", ["HealthMetric", "DataLag", "WaitStats", "QuerySnapshot"])
def test_equals_the_windows_whatever_happens(spark, store, table):
    def same():
        assert kept(store, table) == whole(store, table)

    same()
    steps = [
        [ago(days=3), ago(days=2)], [ago(days=1), ago(hours=3)], [ago(days=5)], [ago(days=1, hours=1)], [ago(hours=2)],
    ]
    for i, times in enumerate(steps):
        store.append(made(spark, table, times, i), table, load=f"l{i}")
        same()  # with loads the state has not seen
        if i % 2:
            fold(store, table)
            same()
    store.append(made(spark, table, steps[1], 1), table, load="l1")  # repeated
    same()
    retention.merge_loads(store, NOW)  # days that are folded change their files
    same()
    store.append(made(spark, table, [ago(days=1, minutes=5)], 9), table)  # late, for a merged day
    retention.merge_loads(store, NOW)
    same()
    fold(store, table)
    fold(store, table)
    same()
    retention.apply_retention(store, NOW, days=1)
    same()
    store.drop_days_before(table, "2024-01-31")
    same()
    store.drop_days_before(table, "2024-03-01")
    same()
    assert kept(store, table) == []


def test_folded_days_are_not_read_again(spark, store):
    for d in range(6, 0, -1):
        store.append(made(spark, "HealthMetric", [ago(days=d)], d), "HealthMetric")
    fold(store, "HealthMetric")
    store.append(made(spark, "HealthMetric", [NOW], 0), "HealthMetric")
    files = newest(store, "HealthMetric").inputFiles()
    read = {f.split("/series/HealthMetric/")[1].split("snapshot_date=")[1][:10] for f in files if "/series/" in f}
    assert read == {"2024-01-31"} and any("/newest/" in f for f in files)


def test_history_is_answered_from_the_series(spark, store):
    store.append(made(spark, "HealthMetric", [ago(days=2), ago(days=1), NOW], 0), "HealthMetric")
    fold(store, "HealthMetric")
    for as_of in (ago(days=2), ago(hours=30), ago(hours=1), NOW):
        assert kept(store, "HealthMetric", as_of) == whole(store, "HealthMetric", as_of)


@pytest.fixture(scope="module")
def replayed(spark, tmp_path_factory):
    """All reports at NOW, before and after rows of later times arrived; and the alerts of a cycle at NOW."""
    found = []
    for later in (False, True):
        store = SnapshotStore(spark, str(tmp_path_factory.mktemp("replay") / "store"))
        filled(spark, store, [ago(days=20), ago(days=3), ago(hours=20), NOW])
        if later:
            filled(spark, store, [NOW + timedelta(minutes=1), NOW + timedelta(days=2), NOW + timedelta(days=40)], seed=1)
        reports = Reports(store, NOW)
        rows = {name: listed(reports.report(name)) for name in ORDER}
        run_cycle(store, NOW)
        rows["alerts"] = listed(store.read_state("AlertHistory").drop("ServerName"))
        rows["anomalies"] = listed(store.read_state("CostAnomaly"))
        rows |= {f"{name} again": listed(Reports(store, NOW).report(name)) for name in ORDER}
        found.append(rows)
    return found


@pytest.mark.parametrize("name", [*ORDER, "alerts", "anomalies", *(f"{n} again" for n in ORDER)])
def test_reports_do_not_see_the_future(replayed, name):
    before, after = replayed
    assert before[name] == after[name]


def test_replay_has_rows(replayed):
    bare = {n for n in ORDER if not replayed[0][n]}
    assert bare <= {"DiskForecast", "AppOwners", "CostAnomaly", "ActiveAlerts", "Findings", "Servers", "EstateHealth", "GrowthKeys", "WaitDelta", "StaleTables"}


def test_reports_as_table_functions(spark, store):
    """Every report answers in SQL, in its order and filtered by named arguments."""
    filled(spark, store, [ago(days=1), NOW], tables=["HealthMetric", "DataLag", "FailedLogin"])
    reports = Reports(store, NOW)
    names = reports.register_functions()
    assert len(names) == len(ORDER)
    for name in ("InstanceVitals", "DataLag"):
        want = [tuple(r) for r in reports.report(name).collect()]
        assert [tuple(r) for r in spark.sql(f"SELECT * FROM report_{name}()").collect()] == want and want
    some = spark.sql("SELECT * FROM report_InstanceVitals(server => 'a')").collect()
    assert [tuple(r) for r in some] == [tuple(r) for r in reports.report("InstanceVitals", ServerName="a").collect()]
    status = some[0].Status
    assert {r.Status for r in spark.sql(f"SELECT * FROM report_InstanceVitals(status => '{status}', platform => NULL)").collect()} == {status}
    assert spark.sql("SELECT * FROM report_ServerInfo(server => 'nobody')").count() == 0


def test_empty(spark, store):
    assert newest(store, "HealthMetric").count() == 0 and newest(store, "WaitStats").count() == 0
    store.append(empty(spark, "HealthMetric"), "HealthMetric")
    fold(store, "HealthMetric")
    assert newest(store, "HealthMetric", NOW).count() == 0
    assert date(2024, 1, 1) and latest_cycle
