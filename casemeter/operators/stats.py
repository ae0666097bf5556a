"""Paired differences and bootstrap intervals.

A bootstrap sample depends on the values only through how often each is drawn. The weight of a value with count ``c`` in a replicate is a
Poisson draw of mean ``c``, taken from a digest of (seed, group, value, replicate): one rule for every size, the same in
any engine that has SHA-256. The cost is ``replicates x distinct values``, spread over the tasks and summed map-side, however many cases there are. Where
a group draws nothing at all (a few values only), its replicate is its own mean.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import exp

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.keys import digest
from ..session import checkpointed

#: Values are told apart, and named in their draws, by whole multiples of this.
GRID = 1e-9
#: Counts up to which the Poisson distribution is inverted exactly; above, its expansion around the normal one is.
EXACT_COUNTS = 10
#: Draws that one digest holds, of 52 bits each.
_DRAWS = 4
#: The rational approximation of the inverse normal distribution (Acklam), from the highest power down.
_CENTRE = ((-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.38357751867269e2, -3.066479806614716e1, 2.506628277459239e0),
           (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1, 1.0))
_TAIL = ((-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838e0, -2.549732539343734e0, 4.374664141464968e0, 2.938163982698783e0),
         (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996e0, 3.754408661907416e0, 1.0))
_EDGE = 0.02425


def _power_sum(factors: Sequence[float], x: str) -> str:
    out = f"{factors[0]:.16e}"
    for f in factors[1:]:
        out = f"({out}) * {x} + {f:.16e}"
    return f"({out})"


def normal_sql(u: str) -> str:
    """The inverse normal distribution of ``u``, as text that Spark and other engines read alike."""
    rest = lambda r: f"({_power_sum(_TAIL[0], r)} / {_power_sum(_TAIL[1], r)})"
    middle, low, high = f"({u} - 5e-1)", f"sqrt(-2e0 * ln({u}))", f"sqrt(-2e0 * ln(1e0 - {u}))"
    square = f"({middle} * {middle})"
    centre = f"({_power_sum(_CENTRE[0], square)} * {middle} / {_power_sum(_CENTRE[1], square)})"
    return f"(case when {u} < {_EDGE:e} then {rest(low)} when {u} > {1 - _EDGE:e} then -{rest(high)} else {centre} end)"


def large_count_sql(c: str, z: str) -> str:
    """The Poisson draw of mean ``c`` at the normal value ``z``, by the expansion of Cornish and Fisher."""
    return f"greatest(0e0, floor({c} + {z} * sqrt({c}) + ({z} * {z} - 1e0) / 6e0 + ({z} - {z} * {z} * {z}) / (72e0 * sqrt({c})) + 5e-1))"


def poisson_steps(c: int) -> list[float]:
    """The distribution function of the Poisson law of mean ``c``, as far as doubles tell it from 1."""
    term = total = exp(-c)
    out = [total]
    while total + term > total or len(out) <= c:
        term *= c / len(out)
        total += term
        out.append(total)
    return out


def correctness(prediction: str = "prediction", label: str = "label") -> Column:
    """A failed prediction (-1) is wrong, never missing."""
    return (F.col(prediction) == F.col(label)).cast("double")


def paired_difference(pairs: DataFrame) -> DataFrame:
    """Per-case difference of correctness, reference minus comparator."""
    return pairs.withColumn("difference", F.col("correct_a") - F.col("correct_b"))


def seed_average(diffs: DataFrame, keys: Sequence[str], seeds: int) -> DataFrame:
    """Mean difference over seeds; a case that lacks a seed, or whose label differs between seeds, is an error."""
    out = diffs.groupBy(*keys).agg(
        F.avg("difference").alias("difference"), F.count(F.lit(1)).alias("_n"), F.min("label").alias("label"), F.max("label").alias("_hi")
    )
    whole = (F.col("_n") == seeds) & F.col("label").eqNullSafe(F.col("_hi"))
    return out.where(F.assert_true(whole, F.lit("a case lacks a seed or changes its label")).isNull()).drop("_n", "_hi")


def balanced_difference(diffs: DataFrame, scope: Sequence[str], label: str = "label") -> DataFrame:
    """Equal-weight mean of class means, in percentage points."""
    per_class = diffs.groupBy(*scope, label).agg(F.avg("difference").alias("_m"), F.count(F.lit(1)).alias("_n"))
    return per_class.groupBy(*scope).agg((100 * F.avg("_m")).alias("difference_pp"), F.sum("_n").alias("cases"))


def cluster_means(df: DataFrame, scope: Sequence[str], cluster: Column, value: str = "difference") -> DataFrame:
    """One mean per resampling cluster (pair, day, episode or case)."""
    return df.groupBy(*scope, cluster.cast("string").alias("cluster")).agg(F.avg(value).alias("value"), F.count(F.lit(1)).alias("cases"))


def resampling_unit(pair_id: str, day: str, case_id: str) -> Column:
    """Pair where there is one, else the calendar day, else the case itself."""
    return F.coalesce(F.col(pair_id).cast("string"), F.col(day).cast("string"), F.col(case_id).cast("string"))


def value_counts(df: DataFrame, scope: Sequence[str], stratum: str, value: str) -> DataFrame:
    """Distinct values per stratum with their counts: all that an interval needs.

    The cases are read once; the counts are checkpointed because several small jobs follow.
    """
    v = F.col(value).cast("double")
    return checkpointed(df.groupBy(*scope, stratum, F.round(v / GRID).cast("bigint").alias("_k")).agg(F.avg(v).alias("_v"), F.count(F.lit(1)).alias("_c")))


def _drawn() -> Column:
    """The Poisson draw of mean ``_c`` at ``_u`` (normal value ``_z``); how many steps of the distribution ``_u`` has reached where the mean is small."""
    out = F.expr(large_count_sql("_c", "_z"))
    for c in range(EXACT_COUNTS, 0, -1):
        reached = sum((F.when(F.col("_u") >= x, 1.0).otherwise(0.0) for x in poisson_steps(c)), F.lit(0.0))
        out = F.when(F.col("_c") == c, reached).otherwise(out)
    return out


def replicates_of(counts: DataFrame, scope: Sequence[str], stratum: str, replicates: int, seed: int | str) -> DataFrame:
    """Replicate statistics per scope: the equal-weight mean of the stratum means."""
    keys = [*scope, stratum]
    blocks = -(-replicates // _DRAWS)
    slots = counts.sparkSession.sparkContext.defaultParallelism
    # An explicit count: adaptive execution would merge these few rows, and with them all the draws.
    drawn = counts.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(slots, *keys, "_k", "_b")
    name = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in keys], F.col("_k").cast("string"), F.col("_b").cast("string"))
    drawn = drawn.withColumn("_h", digest(name)).withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(_DRAWS - 1)))).withColumn("replicate", F.col("_b") * _DRAWS + F.col("_d") + 1)
    bits = F.conv(F.substring("_h", F.col("_d") * 13 + 1, F.lit(13)), 16, 10).cast("bigint")
    drawn = drawn.where(F.col("replicate") <= replicates).withColumn("_u", (bits + 0.5) / float(1 << 52)).withColumn("_z", F.expr(normal_sql("_u")))
    sums = drawn.withColumn("_w", _drawn()).groupBy(*keys, "replicate").agg(
        F.sum(F.col("_w") * F.col("_v")).alias("_s"), F.sum("_w").alias("_n"), (F.sum(F.col("_c") * F.col("_v")) / F.sum("_c")).alias("_own")
    )
    return sums.groupBy(*scope, "replicate").agg(F.avg(F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")).otherwise(F.col("_own"))).alias("statistic"))


def bootstrap_replicates(df: DataFrame, scope: Sequence[str], stratum: str, value: str, replicates: int, seed: int | str) -> DataFrame:
    return replicates_of(value_counts(df, scope, stratum, value), scope, stratum, replicates, seed)


def interval(replicates: DataFrame, scope: Sequence[str], level: float = 0.95) -> DataFrame:
    """Percentile interval; the replicates of a scope are few thousand numbers."""
    lo, hi = (1 - level) / 2, (1 + level) / 2
    return replicates.groupBy(*scope).agg(F.percentile("statistic", lo).alias("low"), F.percentile("statistic", hi).alias("high"))


def stratified_interval(diffs: DataFrame, scope: Sequence[str], replicates: int, seed: int | str, label: str = "label") -> DataFrame:
    """Balanced difference with a bootstrap interval over cases within classes, in percentage points."""
    counts = value_counts(diffs, scope, label, "difference")
    per_class = counts.groupBy(*scope, label).agg((F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("_m"), F.sum("_c").alias("_n"))
    point = per_class.groupBy(*scope).agg((100 * F.avg("_m")).alias("difference_pp"), F.sum("_n").alias("cases"))
    bounds = interval(replicates_of(counts, scope, label, replicates, seed), scope)
    return point.join(bounds.select(*scope, (100 * F.col("low")).alias("lower_95_pp"), (100 * F.col("high")).alias("upper_95_pp")), list(scope), "left")


def cluster_interval(clusters: DataFrame, scope: Sequence[str], replicates: int, seed: int | str, value: str = "value") -> DataFrame:
    """Mean of cluster means with an interval from resampled clusters."""
    counts = value_counts(clusters.withColumn("_all", F.lit("all")), scope, "_all", value)
    point = counts.groupBy(*scope).agg((F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("estimate"), F.sum("_c").alias("clusters"))
    return point.join(interval(replicates_of(counts, scope, "_all", replicates, seed), scope), list(scope), "left")


def bootstrap_p(replicates: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Two-sided bootstrap p-value of a zero difference."""
    n = F.count(F.lit(1))
    low, high = F.count_if(F.col("statistic") <= 0), F.count_if(F.col("statistic") >= 0)
    return replicates.groupBy(*scope).agg(F.least(F.lit(1.0), 2.0 * (1 + F.least(low, high)) / (1 + n)).alias("p_value"))


def holm(tests: DataFrame, family: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Holm step-down correction over a declared family of comparisons."""
    ranked = Window.partitionBy(*(family or [F.lit(0)])).orderBy("p_value", *order)
    size = F.count(F.lit(1)).over(Window.partitionBy(*(family or [F.lit(0)])))
    scaled = tests.withColumn("_s", F.col("p_value") * (size - F.row_number().over(ranked) + 1))
    return scaled.withColumn("p_holm", F.least(F.lit(1.0), F.max("_s").over(ranked.rowsBetween(Window.unboundedPreceding, 0)))).drop("_s")
