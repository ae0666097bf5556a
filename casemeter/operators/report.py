"""Report tables: long scores, seed means, pivots, ranks, leads and diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def long_scores(wide: DataFrame, dims: Sequence[str], measures: Sequence[str]) -> DataFrame:
    return wide.select(*dims, *[F.col(m).cast("double") for m in measures]).unpivot(list(dims), list(measures), "measure", "value")


def seed_summary(scores: DataFrame, dims: Sequence[str], value: str, single_sd: float | None = 0.0) -> DataFrame:
    """Mean, sample deviation and count over seeds, times 100."""
    sd = F.stddev_samp(100 * F.col(value))
    return scores.groupBy(*dims).agg(
        F.avg(100 * F.col(value)).alias("mean"), F.coalesce(sd, F.lit(single_sd).cast("double")).alias("sd"), F.count(value).alias("n")
    )


def cell(mean: Column, sd: Column, n: Column) -> Column:
    """Published text cell, half-even at one decimal."""
    return F.concat(F.format_number(mean, 1), F.lit(" ± "), F.format_number(sd, 1), F.lit(" (n="), n.cast("string"), F.lit(")"))


def panel(summary: DataFrame, dataset: str, model: str, models: Sequence[str], seeds: int) -> DataFrame:
    """Datasets by models in a fixed order; missing is ``pending``, a cell of too few seeds keeps its numbers and is marked ``INCOMPLETE``."""
    whole = cell(F.col("mean"), F.col("sd"), F.col("n"))
    text = F.when(F.col("n") == seeds, whole).otherwise(F.concat(whole, F.lit(" INCOMPLETE")))
    wide = summary.withColumn("_t", text).groupBy(dataset).pivot(model, list(models)).agg(F.first("_t"))
    return wide.select(dataset, *[F.coalesce(F.col(m), F.lit("pending")).alias(m) for m in models])


def average_rank(scores: DataFrame, dataset: str, model: str, seed: str, value: str, models: int, seeds: int) -> DataFrame:
    """Mean rank over datasets in which every model has every seed; ties share their average rank."""
    means = scores.groupBy(dataset, model).agg(F.avg(value).alias("_v"), F.count_distinct(seed).alias("_s"))
    whole = Window.partitionBy(dataset)
    complete = means.withColumn("_ok", F.count_if(F.col("_s") == seeds).over(whole)).where(F.col("_ok") == models)
    ties = F.count(F.lit(1)).over(Window.partitionBy(dataset, "_v"))
    ranked = complete.withColumn("_r", F.rank().over(whole.orderBy(F.desc("_v"))) + (ties - 1) / 2)
    return ranked.groupBy(model).agg(F.avg("_r").alias("average_rank"), F.count(F.lit(1)).alias("datasets")).orderBy("average_rank", model)


def best_comparators(scores: DataFrame, dataset: str, model: str, value: str, comparators: Sequence[str]) -> DataFrame:
    """Highest comparator value per dataset, with every model that reaches it."""
    pool = scores.where(F.col(model).isin(*comparators))
    top = pool.withColumn("_best", F.max(value).over(Window.partitionBy(dataset))).where(F.col(value) == F.col("_best"))
    return top.groupBy(dataset).agg(F.first("_best").alias("best"), F.array_join(F.array_sort(F.collect_list(model)), ", ").alias("best_models"))


def leads(scores: DataFrame, dataset: str, model: str, value: str, reference: str, comparators: Sequence[str]) -> DataFrame:
    """Lead of the reference over the best comparator, and whether it wins."""
    best = best_comparators(scores, dataset, model, value, comparators)
    own = scores.where(F.col(model) == reference).select(dataset, F.col(value).alias("_v"))
    lead = F.col("_v") - F.col("best")
    return own.join(best, dataset).select(dataset, "best_models", lead.alias("lead"), (lead > 0).alias("wins"))


def largest_lead(table: DataFrame, dataset: str) -> DataFrame:
    return table.where("lead > 0").orderBy(F.desc("lead"), dataset).limit(1)


def diagnostics(df: DataFrame, dims: Sequence[str], trials: DataFrame, thresholds: DataFrame) -> DataFrame:
    """What went wrong in each run: backends with the reasons for falling back, resolved models, failed test and policy rows, retries,
    failed trials out of all, and whether the threshold was tuned.

    ``df`` has ``partition, status, attempts, backend, backend_reason, resolved_model``, ``trials`` an ``error`` per trial, ``thresholds`` a
    ``threshold_status`` per run. A run without trials or thresholds has 0 trials and the status ``not applicable``.
    """
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")
    failed = lambda part: F.count_if((F.col("partition") == part) & (F.col("status") != "ok")).alias(f"failed_{part}_rows")
    rows = df.groupBy(*dims).agg(
        listed("backend").alias("backends"), listed("backend_reason").alias("backend_reasons"), listed("resolved_model").alias("resolved_models"),
        failed("test"), failed("policy"), F.sum(F.col("attempts") - 1).cast("bigint").alias("retries"),
    )
    tried = trials.groupBy(*dims).agg(F.count(F.lit(1)).alias("trials"), F.count_if(F.col("error").isNotNull()).alias("failed_trials"))
    joined = rows.join(tried, list(dims), "left").join(thresholds.select(*dims, "threshold_status"), list(dims), "left")
    return joined.fillna(0, ["trials", "failed_trials"]).fillna("not applicable", ["threshold_status"])


def planned_calls(counts: DataFrame, dataset: str, modes: int, retries: int, limit: int | None = None) -> DataFrame:
    """Upper bound of calls per dataset: test rows, plus policy rows of binary tasks, per mode.

    ``counts`` has ``dataset, classes, test_rows, policy_rows``. A total above ``limit`` is an error.
    """
    calls = (F.col("test_rows") + F.when(F.col("classes") == 2, F.col("policy_rows")).otherwise(0)) * modes
    out = counts.select(dataset, calls.cast("bigint").alias("planned_calls"), (calls * (1 + retries)).cast("bigint").alias("attempt_ceiling"))
    if limit is not None and (out.agg(F.sum("attempt_ceiling")).collect()[0][0] or 0) > limit:
        raise ValueError("the planned calls exceed the budget")
    return out


def prediction_export(df: DataFrame) -> DataFrame:
    return df.select("dataset", "seed", "model", "case_id", F.col("label").alias("actual"), F.col("prediction").alias("predicted"))
