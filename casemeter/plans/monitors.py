"""Streaming monitors on the event log, and their batch twins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..streaming import monitors as mon
from .bindings import LEDGER_SQL, attempt_columns, ledger, table
from .catalog import query
from .requests import _LOG, attempt_log


def event_stream(spark, sf):
    """The event table read as a file stream."""
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _timed(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


#: Marks at the end of the event log: event numbers that no event has, read as a start and as an end of an attempt.
_MARKS = [{"event_id": 26 * 10**15}, {"event_id": 26 * 10**15 + 3}]


def _drained(spark, sf, make, name, *times):
    """Run ``make`` over the event log as a stream, close it two days after the last event, give times as the tables have them."""
    events = table(spark, sf, "events")
    marks = mon.EndMarks(spark, events.schema)
    last = events.agg(F.max("ts")).first()[0]
    out = mon.run_available(make(lambda: marks.beside(event_stream(spark, sf))), name, marks, time="ts", at=(last or dt.datetime(1970, 1, 1)) + dt.timedelta(days=2), rows=_MARKS)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times})


_AGG = """count(*) as n, count(*) filter (status <> 'ok') as failed, round(count(*) filter (status <> 'ok') / count(*), 6) as failure_rate,
  round(quantile_cont(latency_ms, 5e-1), 6) as latency_p50_ms, round(quantile_cont(latency_ms, 95e-2), 6) as latency_p95_ms"""


def _rounded(df):
    return df.withColumns({c: r6(F.col(c)) for c in ("failure_rate", "latency_p50_ms", "latency_p95_ms")})


_HOURS = f"with {LEDGER_SQL} select date_trunc('hour', ts) as window_start, date_trunc('hour', ts) + interval 1 hour as window_end, {_AGG} from ledger group by 1, 2"
_MATCHED = f"""with {_LOG} select s.request_id, s.attempt, s.ts as started, e.ts as ended, coalesce(e.status, 'failed') as status
  from log s left join log e on e.event = 'end' and e.request_id = s.request_id and e.attempt = s.attempt and e.ts >= s.ts and e.ts <= s.ts + interval 5 minute where s.event = 'start'"""
_FIRST = f"with {LEDGER_SQL} select request_id, ts, event_id, status from (select *, row_number() over (partition by request_id order by ts, event_id) as r from ledger) where r = 1"
_SESSIONS = """with o as (select user_id, ts, case when date_diff('microsecond', lag(ts) over w, ts) <= 3600000000 then 0 else 1 end as opened from events window w as (partition by user_id order by ts)),
  s as (select user_id, ts, sum(opened) over (partition by user_id order by ts) as id from o) select user_id, count(*) as steps, min(ts) as first_step, max(ts) as last_step from s group by user_id, id"""


@query("ss1_status_monitor_batch", _HOURS)
def ss1(spark, sf):
    return _rounded(mon.status_history(ledger(spark, sf), "ts", "1 hour"))


@query(
    "ss1_sliding_monitor_batch",
    f"with {LEDGER_SQL}, p as (select *, date_trunc('hour', ts) - to_hours(o) as window_start from ledger, range(0, 2) t(o)) select window_start, window_start + interval 2 hour as window_end, {_AGG} from p group by 1, 2",
)
def ss1b(spark, sf):
    return _rounded(mon.status_history(ledger(spark, sf), "ts", "2 hours", "1 hour"))


@query("ss1_status_monitor_stream", _HOURS)
def ss1s(spark, sf):
    make = lambda log: mon.status_monitor(_timed(attempt_columns(log())), "ts", "1 hour")
    return _rounded(_drained(spark, sf, make, "status", "window_start", "window_end"))


@query("ss2_attempt_matching_batch", _MATCHED)
def ss2(spark, sf):
    return mon.attempt_history(attempt_log(table(spark, sf, "events")), "5 minutes")


@query("ss2_attempt_matching_stream", _MATCHED)
def ss2s(spark, sf):
    def make(log):
        starts, ends = (_timed(attempt_log(log())).where(F.col("event") == e) for e in ("start", "end"))
        return mon.attempt_outcomes(starts, ends, "5 minutes")

    return _drained(spark, sf, make, "attempts", "started", "ended")


@query("ss3_first_answers_batch", _FIRST)
def ss3(spark, sf):
    return mon.first_answer_history(ledger(spark, sf).select("request_id", "ts", "event_id", "status"), "request_id", ["ts", "event_id"])


@query("ss3_first_answers_stream", _FIRST)
def ss3s(spark, sf):
    make = lambda log: mon.first_answers(_timed(attempt_columns(log())).select("request_id", "ts", "event_id", "status"), "request_id", "ts", ["event_id"])
    return _drained(spark, sf, make, "answers", "ts")


@query("ss4_episode_sessions_batch", _SESSIONS)
def ss4(spark, sf):
    return mon.episode_session_history(table(spark, sf, "events").select("user_id", "ts"), "user_id", "ts", 3600)


@query("ss4_episode_sessions_stream", _SESSIONS)
def ss4s(spark, sf):
    make = lambda log: mon.episode_sessions(_timed(log()).select("user_id", "ts"), "user_id", "ts", "1 hour")
    return _drained(spark, sf, make, "sessions", "first_step", "last_step")
