"""Attempt-log analytics: attempts, retries, budgets, usage and latency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import count_where, ratio
from .ordering import exact_quantiles, running_totals
from .requests import retry_class


def request_summary(log: DataFrame, request: str = "request_id") -> DataFrame:
    """Starts, ends, retries and the final status of each request.

    ``log`` has ``request, attempt, event ('start'/'end'), status``. Every reducer combines
    map-side, so a request that dominates the log is not gathered in one task.
    """
    start, end = F.col("event") == "start", F.col("event") == "end"
    out = log.groupBy(request).agg(
        F.count_if(start).alias("starts"),
        F.count_if(end).alias("ends"),
        F.max_by(F.when(end, F.col("status")), F.when(end, F.col("attempt"))).alias("final_status"),
    )
    return out.withColumn("retries", F.greatest(F.col("starts") - 1, F.lit(0))).withColumn("final_status", F.coalesce("final_status", F.lit("unfinished")))


def unfinished_attempts(log: DataFrame, request: str = "request_id") -> DataFrame:
    """Attempts that started and never ended."""
    keys = [request, "attempt"]
    starts = log.where("event = 'start'")
    return starts.join(log.where("event = 'end'").select(*keys), keys, "left_anti").select(*keys)


def budget_trail(log: DataFrame, order: str, units: Column, bucket: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Cumulative attempts and units in log order, totalled by ``bucket`` so that no task holds the whole log."""
    counted = log.withColumns({"_one": F.lit(1).cast("bigint"), "_units": units.cast("bigint")})
    cum = running_totals(counted, keys, order, ["_one", "_units"], bucket=bucket)
    return cum.withColumnsRenamed({"cum__one": "attempts_so_far", "cum__units": "units_so_far"}).drop("_one", "_units")


def first_over_budget(trail: DataFrame, order: str, attempt_limit: int, unit_limit: int, keys: Sequence[str] = ()) -> DataFrame:
    """First record past either ceiling; no row when the budget holds."""
    over = trail.where((F.col("attempts_so_far") > attempt_limit) | (F.col("units_so_far") > unit_limit))
    first = F.min_by(F.struct("attempts_so_far", "units_so_far"), order)
    found = over.groupBy(*keys).agg(F.min(order).alias(order), first.alias("_f"))
    return found.where(F.col(order).isNotNull()).select(*keys, order, "_f.*")


def retry_rates(log: DataFrame, keys: Sequence[str], code: str = "code") -> DataFrame:
    """Share of transient and permanent errors."""
    kind = retry_class(F.col(code))
    return log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(kind == "transient").alias("transient"),
        F.count_if(kind == "permanent").alias("permanent"),
        ratio(F.count_if(kind == "transient"), F.count(F.lit(1))).alias("transient_rate"),
    )


def latency_summary(log: DataFrame, keys: Sequence[str], latency: str = "latency_ms") -> DataFrame:
    """Success ratio, and minimum, median and maximum latency of successful calls."""
    ok = F.col("status") == "ok"
    sizes = log.groupBy(*keys).agg(
        ratio(count_where(ok), F.count(F.lit(1))).alias("success_ratio"),
        F.min(F.when(ok, F.col(latency))).alias("min_ms"),
        F.max(F.when(ok, F.col(latency))).alias("max_ms"),
    )
    median = exact_quantiles(log.where(ok), keys, latency, [0.5]).select(*keys, F.col("value").alias("median_ms"))
    return sizes.join(median, list(keys), "left")


def usage(log: DataFrame, keys: Sequence[str], tokens: str, resolved: str) -> DataFrame:
    """Token totals and the distinct resolved models."""
    return log.groupBy(*keys).agg(
        F.sum(tokens).alias("tokens"), F.array_join(F.array_sort(F.collect_set(resolved)), ",").alias("resolved_models")
    )


def model_mismatches(log: DataFrame, keys: Sequence[str], requested: str, resolved: str) -> DataFrame:
    """Calls answered by another model than the one requested."""
    return log.where(~F.col(requested).eqNullSafe(F.col(resolved))).groupBy(*keys, requested, resolved).agg(F.count(F.lit(1)).alias("n"))
