"""Streams against their batch forms."""

import datetime as dt
import uuid

import pytest
from lectern.sources.tables import read
from lectern.streaming import windows
from pyspark.sql import functions as F

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """The events in four files by time."""
    path = str(tmp_path_factory.mktemp("events") / "in")
    e = read(spark, sf, "events")
    e.repartitionByRange(4, "ts").write.parquet(path)
    return path


def ran(df, mode, tmp_path):
    name = "q" + uuid.uuid4().hex
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


@pytest.mark.parametrize("f", [lambda d: windows.fixed_windows(d, "user_id", "1 day", "40 days"), lambda d: windows.sessions(d, "user_id", "4 hours", "40 days")])
def test_windows(spark, sf, folder, tmp_path, f):
    stream = ran(f(windows.read_stream(spark, folder, SCHEMA)), "complete", tmp_path)
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, f(read(spark, sf, "events")).collect()))


def test_latest_status(spark, sf, folder, tmp_path):
    of = lambda d: d.selectExpr("user_id", "ts", "event_id AS id", "event_type AS status")
    got = ran(windows.latest_status(of(windows.read_stream(spark, folder, SCHEMA)), "user_id", "40 days"), "complete", tmp_path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, windows.latest_status(of(read(spark, sf, "events")), "user_id").collect()))


def test_first_in(spark, folder, tmp_path):
    got = ran(windows.first_in(windows.read_stream(spark, folder, SCHEMA).select("ts", "event_type"), ["event_type"], "60 days"), "append", tmp_path)
    assert got.count() == got.select("event_type").distinct().count() > 1


def test_limiter_does_not_record_refusals(spark, tmp_path):
    path = str(tmp_path / "in")
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(seconds=s), 1) for s in (0, 10, 20, 30, 61, 65, 71)] + [(start, 2)]
    spark.createDataFrame(rows, "ts timestamp, user_id long").coalesce(1).write.parquet(path)
    got = ran(windows.limited(windows.read_stream(spark, path, "ts timestamp, user_id bigint"), "user_id", per_minute=2, per_day=4), "append", tmp_path)
    allowed = [r.allowed for r in got.where("user_id = 1").orderBy("ts").collect()]
    assert allowed == [True, True, False, False, True, False, True]
    assert got.where("user_id = 2").first().allowed


def test_late_rows(spark):
    rows = [(dt.datetime(2024, 1, 1, 0, 0, s), dt.datetime(2024, 1, 1)) for s in (5, 10, 11)]
    df = spark.createDataFrame(rows, "ts timestamp, started timestamp")
    assert windows.in_time(df, "started", 10).count() == 2
    assert df.where(F.col("ts").isNull()).count() == 0


def test_first_hit_windows(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [("u", at + dt.timedelta(seconds=s)) for s in (0, 10, 59, 60, 61, 200)] + [("v", at)]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "user_id string, ts timestamp").coalesce(1).write.parquet(path)
    got = ran(windows.first_hit_windows(windows.read_stream(spark, path, "user_id string, ts timestamp"), "user_id", 60, 2), "append", tmp_path)
    of = [(r.n, r.allowed) for r in got.where("user_id = 'u'").orderBy("ts").collect()]
    assert of == [(1, True), (2, True), (3, False), (1, True), (2, True), (1, True)] and got.where("user_id = 'v'").count() == 1


def test_ingestion_states(spark, sf, folder, tmp_path):
    of = lambda d: d.selectExpr("user_id", "ts", "element_at(array('queued', 'extracting', 'ready', 'odd'), CAST(event_id % 4 + 1 AS INT)) AS status")
    got = ran(windows.ingestion_states(of(windows.read_stream(spark, folder, SCHEMA)), "user_id", "40 days"), "complete", tmp_path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, windows.ingestion_states(of(read(spark, sf, "events")), "user_id").collect()))


def gate(rows, requests, tokens, seconds=60):
    """The gate over (seconds, tokens) of one key, plainly."""
    start, n, used, until, out = None, 0, 0, 0, []
    for t, k in sorted(rows):
        if t < until:
            out.append("cooldown")
            continue
        if start is None or t - start >= seconds:
            start, n, used = t, 0, 0
        if (requests and n >= requests) or (tokens and used + k > tokens):
            until = t + max(1, seconds - int(t - start))
            out.append("limit")
        else:
            n, used = n + 1, used + k
            out.append("sent")
    return out


@pytest.mark.parametrize(("requests", "tokens"), [(4, 90)])
def test_gate_with_cooldown(spark, tmp_path, requests, tokens):
    import random

    r = random.Random(requests or 0)
    path, begin = str(tmp_path / "in"), dt.datetime(2024, 1, 1)
    rows = {key: [(at, r.choice((5, 30, 80, 120))) for at in sorted(r.sample(range(600), 60))] for key in range(3)}
    every = sorted((at, key, n) for key, x in rows.items() for at, n in x)
    for part in range(2):  # two files
        mine = [(begin + dt.timedelta(seconds=at), key, n if n != 5 else None) for at, key, n in every if part * 300 <= at < (part + 1) * 300]
        spark.createDataFrame(mine, "ts timestamp, provider long, tokens long").coalesce(1).write.mode("append").parquet(path)
    stream = windows.read_stream(spark, path, "ts timestamp, provider bigint, tokens bigint")
    got = ran(windows.provider_gate(stream, "provider", "tokens", requests, tokens), "append", tmp_path)
    for key, x in rows.items():
        want = gate([(at, 0 if n == 5 else n) for at, n in x], requests, tokens)
        assert [y.decision for y in got.where(f"provider = {key}").orderBy("ts").collect()] == want
        assert {"sent", "limit", "cooldown"} <= set(want)
