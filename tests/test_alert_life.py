"""Alerts as streaming state: the same table as batch evaluations give, whatever the batches."""

import random
from datetime import datetime, timedelta

import pytest

from fleetlens.operators.reconcile import reconcile
from fleetlens.schemas import empty
from fleetlens.streaming.alert_life import alert_table, evaluation, stream_alerts

T0 = datetime(2024, 1, 31, 12, 0, 0)
SCHEMA = "AlertKey string, Category string, Severity string, ServerName string, Message string"


def condition(key, severity, message="m"):
    return (key, "Cat", severity, f"server of {key}", message)


def shown(df):
    columns = ["AlertKey", "Category", "Severity", "ServerName", "Message", "FirstSeen", "LastSeen", "Resolved", "ResolvedAt"]
    return sorted(map(str, (tuple(r) for r in df.select(*columns).collect())))


def batched(spark, evaluations):
    table = empty(spark, "AlertHistory")
    for at, rows in evaluations:
        rows = reconcile(table, spark.createDataFrame(rows, SCHEMA), "AlertKey", at, ["Severity", "Message"], "Message").collect()
        table = spark.createDataFrame(rows, table.schema)
    return table


def streamed(spark, tmp_path, evaluations, restart_every):
    landing, out, check = (str(tmp_path / n) for n in ("landing", "out", "check"))
    schema = evaluation(spark.createDataFrame([], SCHEMA), T0).schema
    for i, (at, rows) in enumerate(evaluations):
        evaluation(spark.createDataFrame(rows, SCHEMA), at).coalesce(1).write.mode("append").parquet(landing)
        if i % restart_every == restart_every - 1 or i == len(evaluations) - 1:
            source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landing)
            stream_alerts(spark, source, out, check).awaitTermination()
    return alert_table(spark.read.parquet(out))


@pytest.mark.parametrize("restart_every", [3, 12])
def test_ten_evaluations_equal_batch_reconcile(spark, tmp_path, restart_every):
    draw = random.Random(4)
    evaluations = []
    for i in range(10):
        rows = []
        for k in range(8):
            if draw.random() < 0.6:
                rows += [condition(f"k{k}", draw.choice(["WARN", "CRIT"]), draw.choice("abc")) for _ in range(1 + (k == 7))]
        evaluations.append((T0 + timedelta(minutes=[0, 15, 30, 47, 60, 75, 200, 215, 230, 245][i]), rows))
    evaluations[5] = (evaluations[5][0], [])  # an evaluation that finds nothing closes all
    end = evaluations[-1][0]
    evaluations += [(end + timedelta(minutes=15), []), (end + timedelta(minutes=30), [])]  # the last closings are told with the next batch
    got, want = shown(streamed(spark, tmp_path, evaluations, restart_every)), shown(batched(spark, evaluations))
    assert got == want and len(got) > 15


def test_late_and_repeated_evaluations_change_nothing(spark, tmp_path):
    first = [condition("a", "WARN"), (None, None, None, None, None)]
    evaluations = [(T0, first), (T0, first), (T0 + timedelta(minutes=15), [condition("a", "CRIT", "worse")]), (T0, first)]
    rows = streamed(spark, tmp_path, evaluations, 9).collect()
    assert [(r.AlertKey, r.Severity, r.Message, r.FirstSeen, r.LastSeen, r.Resolved) for r in rows] == [
        ("a", "CRIT", "worse", T0, T0 + timedelta(minutes=15), False)
    ]
