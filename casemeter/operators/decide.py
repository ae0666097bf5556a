"""Decision rules: threshold choice on policy rows and its application."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import is_finite
from ..session import checkpointed, small_table
from .ordering import exact_quantiles

QUANTILES = 101
#: Relative step to the next representable double.
_STEP = 2.0**-52


def just_above(value: Column) -> Column:
    """A value above ``value`` by the smallest representable relative step."""
    return F.when(value == 0, F.lit(1e-300)).otherwise(value + F.abs(value) * F.lit(_STEP))


def threshold_status(policy: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Whether a group can be tuned: finite policy scores and both classes."""
    checked = policy.groupBy(*keys).agg(
        F.bool_and(is_finite(F.col(score))).alias("_finite"), F.min(label).alias("_lo"), F.max(label).alias("_hi")
    )
    status = (
        F.when(~F.col("_finite"), "not tuned: policy scores missing; raw choices retained")
        .when(F.col("_lo") == F.col("_hi"), "not tuned: one class only")
        .otherwise("tuned")
    )
    return checked.select(*keys, status.alias("threshold_status"))


def score_counts(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Positives ``_p`` and negatives ``_n`` per distinct score ``_s``: all that threshold choice needs."""
    return df.groupBy(*keys, F.col(score).cast("double").alias("_s")).agg(
        F.sum(F.col(label).cast("bigint")).alias("_p"), F.sum((1 - F.col(label)).cast("bigint")).alias("_n")
    )


def candidate_grid(counts: DataFrame, keys: Sequence[str], default: float, quantiles: int = QUANTILES) -> DataFrame:
    """Sorted distinct candidates per group: the default, a quantile grid, and one above the maximum."""
    qs = [i / (quantiles - 1) for i in range(quantiles)]
    grid = exact_quantiles(counts.withColumn("_all", F.col("_p") + F.col("_n")), keys, "_s", qs, weight="_all")
    found = grid.groupBy(*keys).agg(F.collect_set("value").alias("_points"), F.max("value").alias("_max"))
    extra = F.array(F.lit(float(default)), just_above(F.col("_max")))
    return found.select(*keys, F.array_sort(F.array_distinct(F.concat("_points", extra))).alias("grid"))


def fixed_grid(keys_table: DataFrame, keys: Sequence[str], points: Sequence[float]) -> DataFrame:
    return keys_table.select(*keys).distinct().withColumn("grid", F.array(*[F.lit(float(p)) for p in points]))


def grid_scores(counts: DataFrame, keys: Sequence[str], grid: DataFrame) -> DataFrame:
    """Balanced accuracy of ``score >= t`` for every candidate of every group.

    Each score is placed once into the candidate grid; what follows works on one count per
    (group, slot), at most a grid length per group.
    """
    grid = small_table(grid)
    placed = counts.join(grid, list(keys))
    slot = F.size(F.filter("grid", lambda t: t <= F.col("_s")))
    slots = placed.groupBy(*keys, slot.alias("slot")).agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    # Slot i holds scores from candidate i up to the next one; slot 0 lies below all candidates.
    empty = grid.select(*keys, F.explode(F.sequence(F.lit(0), F.size("grid"))).alias("slot")).withColumns({"_p": F.lit(0).cast("bigint"), "_n": F.lit(0).cast("bigint")})
    full = slots.unionByName(empty).groupBy(*keys, "slot").agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    group = Window.partitionBy(*keys)
    above = group.orderBy("slot").rowsBetween(0, Window.unboundedFollowing)
    below = group.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    rates = full.select(
        *keys,
        "slot",
        F.try_divide(F.sum("_p").over(above), F.sum("_p").over(group)).alias("_tpr"),
        F.try_divide(F.coalesce(F.sum("_n").over(below), F.lit(0)), F.sum("_n").over(group)).alias("_tnr"),
    )
    named = rates.where("slot > 0").join(grid, list(keys))
    return named.select(*keys, F.element_at("grid", F.col("slot")).alias("threshold"), ((F.col("_tnr") + F.col("_tpr")) / 2).alias("balanced_accuracy"))


def choose_threshold(policy: DataFrame, keys: Sequence[str], label: str, score: str, default: float, quantiles: int = QUANTILES) -> DataFrame:
    """Best candidate by balanced accuracy; ties go to the nearest to the default, then the lowest."""
    counts = checkpointed(score_counts(policy, keys, label, score))
    checked = counts.groupBy(*keys).agg(F.bool_and(is_finite(F.col("_s"))).alias("_ok"), F.sum("_p").alias("_tp"), F.sum("_n").alias("_tn"))
    tuned = checked.where("_ok and _tp > 0 and _tn > 0").select(*keys)
    usable = counts.join(small_table(tuned), list(keys), "left_semi")
    values = grid_scores(usable, keys, candidate_grid(usable, keys, default, quantiles))
    rank = F.struct("balanced_accuracy", (-F.abs(F.col("threshold") - default)).alias("near"), (-F.col("threshold")).alias("low"))
    best = F.max_by(F.struct("threshold", "balanced_accuracy"), rank)
    return values.groupBy(*keys).agg(best.alias("_b"), F.count(F.lit(1)).alias("grid_size")).select(
        *keys, "_b.threshold", F.col("_b.balanced_accuracy").alias("selection_balanced_accuracy"), "grid_size"
    )


def best_grid_point(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First maximum of a fixed grid."""
    best = F.max_by(F.struct("threshold", "balanced_accuracy"), F.struct("balanced_accuracy", (-F.col("threshold")).alias("low")))
    return values.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def apply_threshold(test: DataFrame, keys: Sequence[str], score: str, raw: str, thresholds: DataFrame) -> DataFrame:
    """Add ``adjusted``: thresholded where the score is finite and a threshold exists, else the raw class."""
    joined = test.join(small_table(thresholds.select(*keys, "threshold")), list(keys), "left")
    usable = is_finite(F.col(score)) & F.col("threshold").isNotNull()
    return joined.withColumn("adjusted", F.when(usable, (F.col(score) >= F.col("threshold")).cast("int")).otherwise(F.col(raw)))


def panels(df: DataFrame, raw: str = "raw", adjusted: str = "adjusted") -> DataFrame:
    """Both decision panels in long form, always both."""
    rest = [c for c in df.columns if c not in (raw, adjusted)]
    pair = F.array(*[F.struct(F.lit(name).alias("panel"), F.col(col).alias("prediction")) for name, col in (("raw", raw), ("adjusted", adjusted))])
    return df.select(*rest, F.explode(pair).alias("_p")).select(*rest, "_p.*")
