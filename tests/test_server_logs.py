"""Landed logs: splits, filters, offsets, against the entries that were written."""

import io
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetlens.plans.extract_mssql import extract_cpu_pct, extract_failed_logins
from fleetlens.sources import server_logs
from fleetlens.sources.server_logs import PUSHDOWN, STARTS, entries, read_logs, stream_logs

T0 = datetime(2024, 1, 20, 0, 0, 0)


def line(at, text, process="Logon"):
    return f"{at:%Y-%m-%d %H:%M:%S}.{at.microsecond // 10_000:02d} {process:<12}{text}\n"


def land(folder, server, name, text):
    path = folder / f"ServerName={server}"
    path.mkdir(parents=True, exist_ok=True)
    with open(path / name, "a", encoding="utf-8") as f:
        f.write(text)
    return path / name


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_every_entry_lies_in_one_split(block, monkeypatch):
    monkeypatch.setattr(server_logs, "BLOCK", block)
    draw = random.Random(4)
    want = [line(T0 + timedelta(seconds=i), draw.choice(["x", "é" * 90, "a\nb 2024-01-01 00:00:00.00 c\n\n", ""])).encode() for i in range(60)]
    raw = b"head without a time\n" + b"".join(want)
    for size in (1, 13, 50, 700, len(raw)):
        got = [e for a in range(0, len(raw), size) for e in entries(io.BytesIO(raw), STARTS["errorlog"], a, min(a + size, len(raw)), len(raw))]
        assert got == want
    records = [f'<Record id="{i}" type="T"><Recorded>{"v" * draw.randrange(80)}</Recorded></Record>\n'.encode() for i in range(40)]
    raw = b"".join(records)
    for size in (9, 33, len(raw)):
        got = [e for a in range(0, len(raw), size) for e in entries(io.BytesIO(raw), STARTS["ringbuffer"], a, min(a + size, len(raw)), len(raw))]
        assert got == records


def test_error_logs_in_batch_with_and_without_pushdown(spark, tmp_path):
    rows = [(s, T0 + timedelta(minutes=i, milliseconds=10 * i), f"Login failed for 'u{i}'.\n\tmore" if i % 3 else "ok") for s in ("a", "b c", "d%") for i in range(50)]
    for server, at, text in rows:
        land(tmp_path, server.replace("%", "%25").replace(" ", "%20"), "ERRORLOG", line(at, text))
    land(tmp_path, "a", "ERRORLOG.1", "2024-02-31 00:00:00.00 spid1 no such day\n")
    land(tmp_path, "a", "_ignored", line(T0, "not read"))
    want = sorted((*r[:2], "Logon", r[2]) for r in rows)

    def read(**options):
        return read_logs(spark, str(tmp_path), **options)

    got = [tuple(r) for r in read(splitBytes=300).collect()]
    assert sorted(r for r in got if r[1]) == want and [r for r in got if not r[1]] == [("a", None, "spid1", "no such day")]
    bound = T0 + timedelta(minutes=30)
    asked = (F.col("ServerName").isin("a", "b c")) & (F.col("LogDate") > F.lit(bound).cast("timestamp_ntz"))
    plain = sorted(map(tuple, read().where(asked).collect()))
    spark.conf.set(PUSHDOWN, "true")
    try:
        pushed = read().where(asked)
        assert sorted(map(tuple, pushed.collect())) == plain == [r for r in want if r[0] in ("a", "b c") and r[1] > bound]
        assert read().where("ServerName = 'a'").rdd.getNumPartitions() == 2  # the files of one server
        assert read().where("ServerName = 'zz'").count() == 0
        assert read().where("ServerName = 'a' AND LogText = 'ok'").count() == 17
    finally:
        spark.conf.unset(PUSHDOWN)
    found = extract_failed_logins([read()], T0 + timedelta(hours=24, minutes=10))
    assert found.count() == sum("failed" in r[2] and r[1] > T0 + timedelta(minutes=10) for r in rows)
    (tmp_path / "none").mkdir()
    assert read_logs(spark, str(tmp_path / "none")).count() == 0


def test_ring_buffers(spark, tmp_path):
    def record(at, cpu, kind="RING_BUFFER_SCHEDULER_MONITOR"):
        return (
            f'<Record id="1" type="{kind}" time="{at}"><SchedulerMonitorEvent><SystemHealth><ProcessUtilization>{cpu}'
            "</ProcessUtilization></SystemHealth></SchedulerMonitorEvent></Record>"
        )

    land(tmp_path, "a", "ring.xml", record(5, 11) + "\n" + record(9, 77) + record(12, 1, "RING_BUFFER_OOM") + record(20, 5)[:40])
    land(tmp_path, "b", "ring.xml", record(7, 3) + record(6, 4))
    rows = read_logs(spark, str(tmp_path), "ringbuffer", splitBytes=100)
    assert rows.count() == 5  # the one cut off is none
    assert {r.ServerName: r.cpu_pct for r in extract_cpu_pct(rows).collect()} == {"a": 77.0, "b": 3.0}


def test_stream_reads_each_whole_entry_once(spark, tmp_path):
    logs = tmp_path / "logs"
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run(settle=3600):
        stream = stream_logs(spark, str(logs), splitBytes=70, settleSeconds=settle)
        query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out)
        query.trigger(availableNow=True).start().awaitTermination()
        return sorted((r.ServerName, r.LogText) for r in spark.read.schema(stream.schema).parquet(out).collect())

    land(logs, "a", "log", line(T0, "one") + line(T0, "two\nmore") + line(T0, "thr"))
    assert run() == [("a", "one"), ("a", "two\nmore")]  # the last may not be whole yet
    land(logs, "a", "log", "and its end\n" + line(T0, "four"))
    land(logs, "b", "log", line(T0, "x") + line(T0, "y"))
    assert run() == [("a", "one"), ("a", "thr\nand its end"), ("a", "two\nmore"), ("b", "x")]
    every = [("a", "four"), ("a", "one"), ("a", "thr\nand its end"), ("a", "two\nmore"), ("b", "x"), ("b", "y")]
    assert run(settle=0) == every and run(settle=0) == every
