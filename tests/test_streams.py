"""Streams against their batch twins: several files, rows out of order, and the end of the log."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from casemeter.streaming import monitors as mon

SCHEMA = "id long, key long, ts timestamp, status string, latency_ms double"
START = dt.datetime(2024, 5, 1)


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """Three files; rows within a file come in any order, as the delay allows."""
    draw, rows, at = random.Random(3), [], START
    for k in range(300):
        at += dt.timedelta(seconds=draw.choice([5, 30, 600, 4000]))
        rows.append((k, draw.randrange(12), at, draw.choice(["ok", "ok", "failed"]), float(draw.randrange(100))))
    folder = str(tmp_path_factory.mktemp("log"))
    for part in range(3):
        some = rows[part * 100 : part * 100 + 100]
        draw.shuffle(some)
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return folder


def drained(spark, log, make, closed=True):
    table = spark.read.schema(SCHEMA).parquet(log)
    marks = mon.EndMarks(spark, table.schema)
    stream = marks.beside(spark.readStream.schema(SCHEMA).parquet(log))
    if not closed:
        return mon.run_available(make(stream), "open")
    last = table.agg(F.max("ts")).first()[0]
    return mon.run_available(make(stream), "closed", marks, time="ts", at=last + dt.timedelta(days=3), rows=[{"id": -1}])


def same(a, b):
    names = [F.round(c, 6).alias(c) if dict(a.dtypes)[c] == "double" else F.col(c) for c in sorted(a.columns)]
    return sorted(map(tuple, a.select(names).collect()), key=repr) == sorted(map(tuple, b.select(names).collect()), key=repr)


def test_windows_are_all_closed(spark, log):
    make = lambda s: mon.status_monitor(s, "ts", "1 hour")
    table = spark.read.schema(SCHEMA).parquet(log)
    history = mon.status_history(table, "ts", "1 hour")
    assert same(drained(spark, log, make), history)
    assert drained(spark, log, make, closed=False).count() < history.count()


def test_first_answers_by_time_whatever_the_order(spark, log):
    columns = ["key", "ts", "id", "status"]
    make = lambda s: mon.first_answers(s.select(columns), "key", "ts", ["id"])
    table = spark.read.schema(SCHEMA).parquet(log).select(columns)
    got = drained(spark, log, make)
    assert got.count() == got.select("key").distinct().count() and same(got.where("key is not null"), mon.first_answer_history(table, "key", ["ts", "id"]))


def test_sessions_are_all_closed(spark, log):
    make = lambda s: mon.episode_sessions(s.where("key is not null or id = -1").select("key", "ts"), "key", "ts", "1 hour")
    table = spark.read.schema(SCHEMA).parquet(log)
    assert same(drained(spark, log, make), mon.episode_session_history(table.select("key", "ts"), "key", "ts", 3600))
