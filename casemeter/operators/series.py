"""Time-series examples, forward windows and naive baselines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .joins import exact_offsets
from .ordering import dense_positions, exact_quantiles

#: The offsets, in hours, that an example needs besides its own hour.
EXAMPLE_OFFSETS = {"lag_1": -1, "lag_24": -24, "lag_168": -168, "target": 1}


def timestamp_of(date: Column, hour: Column) -> Column:
    """Timestamp from a date and an hour of the day."""
    return F.to_timestamp_ntz(date.cast("string"), F.lit("yyyy-MM-dd")) + F.make_dt_interval(hours=hour)


def examples(series: DataFrame, time: str, count: str, now: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """Examples that use what is known at hour ``t`` to predict the count at ``t + 1``.

    Calendar facts belong to the predicted hour; measurements to the current one.
    """
    fields = {"now": [count, *now], **{n: [count] for n in EXAMPLE_OFFSETS}}
    found = exact_offsets(series.select(*keys, time, count, *now), time, fields, EXAMPLE_OFFSETS, keys)
    target = F.col(time) + F.make_dt_interval(hours=F.lit(1))
    return found.withColumns(
        {
            "target_timestamp": target,
            "hour_next": F.hour(target),
            "weekday_next": F.weekday(target),
            "month_next": F.month(target),
            "year_next": F.year(target),
        }
    )


@dataclass(frozen=True)
class WindowPlan:
    """Sizes of forward windows, in rows; ``train_cap=None`` keeps all earlier rows (expanding)."""

    windows: int
    train_cap: int | None
    validation: int
    policy: int
    test: int
    gap: int
    purge: int = 1
    minimum_train: int = 1

    @property
    def protocol(self) -> str:
        return "expanding-forward-window" if self.train_cap is None else "sliding-forward-window"

    def intervals(self, n: int) -> list[tuple[int, str, int, int]]:
        """``(window, partition, first, end)`` positions for ``n`` ordered examples."""
        before = (self.train_cap or self.minimum_train) + self.validation + self.policy + self.gap + 3 * self.purge
        latest = n - self.test
        if latest < before + (self.windows - 1) * self.test:
            raise ValueError("the series is too small for the requested forward windows")
        steps = max(self.windows - 1, 1)
        starts = [before + (latest - before) * i // steps for i in range(self.windows)]
        out = []
        for w, start in enumerate(starts):
            policy_end = start - self.gap - self.purge
            validation_end = policy_end - self.policy - self.purge
            train_end = validation_end - self.validation - self.purge
            train_start = 0 if self.train_cap is None else max(0, train_end - self.train_cap)
            out += [
                (w, "train", train_start, train_end),
                (w, "validation", validation_end - self.validation, validation_end),
                (w, "policy", policy_end - self.policy, policy_end),
                (w, "test", start, start + self.test),
            ]
        return out


def positions(df: DataFrame, time: str) -> DataFrame:
    """Dense position in time order; days are the buckets, so no task sees the whole series."""
    return dense_positions(df, time, bucket=F.to_date(time))


def forward_windows(placed: DataFrame, plan: WindowPlan, n: int | None = None) -> DataFrame:
    """Assign each positioned example to the windows it belongs to (a row may serve several windows)."""
    n = placed.count() if n is None else n
    parts = F.array(
        *[
            F.struct(F.lit(w).alias("window"), F.lit(p).alias("partition"), F.lit(lo).cast("bigint").alias("lo"), F.lit(hi).cast("bigint").alias("hi"))
            for w, p, lo, hi in plan.intervals(n)
        ]
    )
    hit = F.filter(parts, lambda x: (F.col("position") >= x["lo"]) & (F.col("position") < x["hi"]))
    out = placed.select("*", F.explode(hit).alias("_w"))
    return out.select(*placed.columns, F.col("_w.window").alias("window"), F.col("_w.partition").alias("partition"), F.lit(plan.protocol).alias("protocol"))


def embargo(windows: DataFrame, time: str, target_time: str, gap_hours: int) -> DataFrame:
    """Hours between the last policy target and the first test row per window, and whether they suffice."""
    ends = windows.groupBy("window").agg(
        F.max(F.when(F.col("partition") == "policy", F.col(target_time))).alias("last_policy_target"),
        F.min(F.when(F.col("partition") == "test", F.col(time))).alias("first_test"),
    )
    hours = F.timestamp_diff("HOUR", F.col("last_policy_target"), F.col("first_test"))
    return ends.withColumn("hours", hours).withColumn("respected", F.col("hours") >= gap_hours)


def frozen_threshold(reference: DataFrame, target: str, q: float = 0.75) -> DataFrame:
    """One row ``threshold``: the upper neighbour of quantile ``q`` of the reference block."""
    return exact_quantiles(reference, [], target, [q], "higher").select(F.col("value").cast("bigint").alias("threshold"))


def exceeds(value: Column, threshold: DataFrame) -> Column:
    """1 when strictly above the frozen threshold."""
    return (value > threshold.select("threshold").scalar()).cast("int")


def baselines(df: DataFrame, threshold: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Persistence and seasonal rules: a past value compared with the frozen threshold."""
    limit = threshold.select("threshold").scalar()
    return df.withColumns({name: (F.col(c) > limit).cast("int") for name, c in rules.items()})
