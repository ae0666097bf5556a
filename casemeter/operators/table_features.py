"""Imputation, scaling and encoding of tabular features, fitted on training rows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..session import small_table
from .clean import MISSING  # noqa: F401  (the sentinel belongs to this vocabulary too)
from .ordering import exact_quantiles


def medians(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row of exact medians; zero for a column without values."""
    long = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_x")) for c in cols])).alias("_s")).select("_s.*")
    found = exact_quantiles(long, ["_c"], "_x", [0.5])
    return found.groupBy().agg(*[F.coalesce(F.max(F.when(F.col("_c") == c, F.col("value"))), F.lit(0.0)).alias(c) for c in cols])


def most_frequent(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row of most frequent categories, the smallest value on ties."""
    long = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("string").alias("_x")) for c in cols])).alias("_s")).select("_s.*")
    counts = long.where(F.col("_x").isNotNull()).groupBy("_c", "_x").agg(F.count(F.lit(1)).alias("_n"))
    best = counts.groupBy("_c").agg(F.min_by("_x", F.struct((-F.col("_n")).alias("a"), F.col("_x").alias("b"))).alias("_x"))
    return best.groupBy().agg(*[F.max(F.when(F.col("_c") == c, F.col("_x"))).alias(c) for c in cols])


def scale_statistics(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row of means and population deviations; a constant column gets deviation one."""
    aggs = []
    for c in cols:
        sd = F.stddev_pop(F.col(c).cast("double"))
        aggs += [F.avg(F.col(c).cast("double")).alias(f"{c}_mean"), F.when(sd == 0, 1.0).otherwise(sd).alias(f"{c}_sd")]
    return train.agg(*aggs)


def standardise(df: DataFrame, cols: Sequence[str], stats: DataFrame) -> DataFrame:
    fitted = stats.select(F.struct(*stats.columns)).scalar()
    return df.withColumns({c: (F.col(c).cast("double") - fitted[f"{c}_mean"]) / fitted[f"{c}_sd"] for c in cols})


def categories(train: DataFrame, col: str) -> list[str]:
    """Sorted training categories on the driver; refuses an unbounded column."""
    rows = train.where(F.col(col).isNotNull()).select(F.col(col).cast("string").alias("v")).distinct().limit(5001).collect()
    if len(rows) > 5000:
        raise ValueError(f"{col} is not a bounded category")
    return sorted(r["v"] for r in rows)


def one_hot(df: DataFrame, col: str, levels: Sequence[str]) -> DataFrame:
    """Indicator columns ``col=level``; an unseen category is all zeros."""
    return df.withColumns({f"{col}={v}": F.coalesce((F.col(col).cast("string") == v).cast("double"), F.lit(0.0)) for v in levels})


def class_weights(train: DataFrame, label: str, groups: Sequence[str] = ()) -> DataFrame:
    """Balanced weight ``n / (k n_c)`` per class."""
    counts = train.groupBy(*groups, label).agg(F.count(F.lit(1)).alias("n_class"))
    whole = Window.partitionBy(*(groups or [F.lit(0)]))
    weight = F.sum("n_class").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("n_class"))
    return counts.withColumn("weight", weight)


def with_class_weights(df: DataFrame, label: str, weights: DataFrame) -> DataFrame:
    return df.join(small_table(weights.select(label, "weight")), label)


def unit_vector(df: DataFrame, vector: str) -> DataFrame:
    """L2-normalise a numeric array; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return df.withColumn("_norm", norm).withColumn(
        vector, F.when(F.col("_norm") == 0, F.transform(vector, lambda x: x.cast("double"))).otherwise(F.transform(vector, lambda x: x.cast("double") / F.col("_norm")))
    ).drop("_norm")
