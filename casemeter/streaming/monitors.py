"""Monitors over an append-only attempt log, as streams and as their batch twins.

The streaming functions take and return streaming DataFrames; state is bounded by the
watermark. ``run_available`` drains what a source holds and leaves a table behind; with :class:`EndMarks`
the watermark then passes the last event, so that every window, match, answer and session is closed.
"""

from __future__ import annotations

import datetime as dt
import pickle
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..functions.numeric import ratio
from ..operators.ordering import exact_quantiles
from ..session import shared_folder


def _windowed(df: DataFrame, time: str, width: str, slide: str | None) -> DataFrame:
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return df.withColumn("_w", w)


def _status_aggregates():
    failed = F.count_if(F.col("status") != "ok")
    return [F.count(F.lit(1)).alias("n"), failed.alias("failed"), ratio(failed, F.count(F.lit(1))).alias("failure_rate")]


def status_monitor(log: DataFrame, time: str, width: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Failure rate and latency percentiles per window; records later than the delay are dropped.

    A window's state holds its distinct latencies with their counts, from which the percentiles are exact.
    """
    grouped = _windowed(log.withWatermark(time, delay), time, width, slide).groupBy("_w")
    p = F.percentile("latency_ms", F.array(F.lit(0.5), F.lit(0.95)))
    out = grouped.agg(*_status_aggregates(), p.alias("_p"))
    return out.select(
        F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "n", "failed", "failure_rate",
        F.col("_p")[0].alias("latency_p50_ms"), F.col("_p")[1].alias("latency_p95_ms"),
    )


def status_history(log: DataFrame, time: str, width: str, slide: str | None = None) -> DataFrame:
    """Batch twin of the monitor with exact percentiles."""
    placed = _windowed(log, time, width, slide).withColumns({"window_start": F.col("_w.start"), "window_end": F.col("_w.end")}).drop("_w")
    keys = ["window_start", "window_end"]
    q = exact_quantiles(placed, keys, "latency_ms", [0.5, 0.95])
    pick = lambda x: F.max(F.when(F.col("q") == x, F.col("value")))
    wide = q.groupBy(*keys).agg(pick(0.5).alias("latency_p50_ms"), pick(0.95).alias("latency_p95_ms"))
    return placed.groupBy(*keys).agg(*_status_aggregates()).join(wide, keys, "left")


def _match(starts: DataFrame, ends: DataFrame, timeout: str) -> DataFrame:
    s = starts.select(F.col("request_id").alias("s_request"), F.col("attempt").alias("s_attempt"), F.col("ts").alias("started"))
    e = ends.select(F.col("request_id").alias("e_request"), F.col("attempt").alias("e_attempt"), F.col("ts").alias("ended"), F.col("status").alias("e_status"))
    on = F.expr(f"s_request = e_request and s_attempt = e_attempt and ended >= started and ended <= started + interval {timeout}")
    return s.join(e, on, "left_outer").select(
        F.col("s_request").alias("request_id"), F.col("s_attempt").alias("attempt"), "started", "ended", F.coalesce("e_status", F.lit("failed")).alias("status")
    )


def attempt_outcomes(starts: DataFrame, ends: DataFrame, timeout: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Stream-stream left outer join: a start without an end within the timeout has failed."""
    return _match(starts.withWatermark("ts", delay), ends.withWatermark("ts", delay), timeout)


def attempt_history(log: DataFrame, timeout: str = "1 hour") -> DataFrame:
    """Batch twin of the attempt matching."""
    return _match(log.where("event = 'start'"), log.where("event = 'end'"), timeout)


def first_answers(answers: DataFrame, key: str, time: str, order: Sequence[str], delay: str = "10 minutes") -> DataFrame:
    """First answer per request by (time, ``order``). It is given out once the watermark has passed it, for then no earlier one can come.

    A request's state is its earliest answer so far, and afterwards the mark that it has been answered.
    """
    schema, names = answers.schema, answers.columns
    rank = [time, *order]

    def earliest(request: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (row,) = state.get
            state.update((None,))
            yield pd.DataFrame([pickle.loads(row)], columns=names)
            return
        held = state.get[0] if state.exists else b""
        if held is None:
            return
        best = pickle.loads(held) if held else None
        place = [names.index(c) for c in rank]
        for part in parts:
            row = part.sort_values(rank).iloc[0].tolist()
            if best is None or [row[k] for k in place] < [best[k] for k in place]:
                best = row
        state.update((pickle.dumps(best),))
        state.setTimeoutTimestamp(max(int(pd.Timestamp(best[place[0]]).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))

    keyed = answers.withWatermark(time, delay).groupBy(key)
    return keyed.applyInPandasWithState(earliest, schema, "best binary", "append", GroupStateTimeout.EventTimeTimeout)


def first_answer_history(answers: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Batch twin: the earliest answer per request, by an aggregate so that a hot request collapses map-side."""
    rest = [c for c in answers.columns if c != key]
    return answers.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def episode_sessions(steps: DataFrame, key: str, time: str, gap: str, delay: str = "10 minutes") -> DataFrame:
    """Close an episode after a period without steps."""
    grouped = steps.withWatermark(time, delay).groupBy(key, F.session_window(time, gap).alias("_s"))
    return grouped.agg(F.count(F.lit(1)).alias("steps"), F.min(time).alias("first_step"), F.max(time).alias("last_step")).drop("_s")


def episode_session_history(steps: DataFrame, key: str, time: str, gap_seconds: int) -> DataFrame:
    """Batch twin of the sessions.

    Steps inside one gap-length slot always share a session, so they are first reduced to
    one row per (key, slot) map-side; what a key then holds is bounded by the time range,
    not by its number of steps.
    """
    seconds = F.unix_seconds(F.col(time).cast("timestamp"))
    slots = steps.groupBy(key, F.floor(seconds / gap_seconds).alias("_slot")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(time).alias("_lo"), F.max(time).alias("_hi")
    )
    w = Window.partitionBy(key).orderBy("_slot")
    idle = F.timestamp_diff("MICROSECOND", F.lag("_hi").over(w), F.col("_lo")) > gap_seconds * 1_000_000
    opened = F.coalesce(idle, F.lit(True)).cast("int")
    numbered = slots.withColumn("_new", opened).withColumn("_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "_id").agg(F.sum("_n").alias("steps"), F.min("_lo").alias("first_step"), F.max("_hi").alias("last_step")).drop("_id")


class EndMarks:
    """A second source beside a log. Its rows, written once the log is drained, carry a time past the last event and so move the watermark.

    A mark's own window, match or session stays open and is never given out. Events that come after a mark are late.
    """

    def __init__(self, spark: SparkSession, schema: StructType):
        self.spark, self.schema = spark, schema
        self.folder = f"{shared_folder(spark)}/marks"
        spark.createDataFrame([], schema).write.parquet(self.folder)

    def beside(self, log: DataFrame) -> DataFrame:
        return log.unionByName(self.spark.readStream.schema(self.schema).parquet(self.folder))

    def write(self, time: str, at: dt.datetime, rows: Sequence[dict]) -> None:
        """Add marks at the time ``at`` with the given columns; the others are null."""
        marks = self.spark.createDataFrame([tuple((r | {time: at}).get(c) for c in self.schema.names) for r in rows], self.schema)
        marks.write.mode("append").parquet(self.folder)


def run_available(stream: DataFrame, name: str, close: EndMarks | None = None, **mark: object) -> DataFrame:
    """Drain the available input into a table in the shared folder and read it back.

    With ``close`` the marks are written after that, and a second run with the same state gives out what was still open.
    """
    spark = stream.sparkSession
    root = f"{shared_folder(spark)}/{name}"

    def run() -> None:
        writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{root}/state").option("path", f"{root}/table")
        writer.trigger(availableNow=True).start().awaitTermination()

    run()
    if close is not None:
        close.write(**mark)
        run()
    return spark.read.schema(stream.schema).parquet(f"{root}/table")
