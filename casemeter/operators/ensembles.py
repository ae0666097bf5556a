"""Baselines and votes expressed as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.probability import top_class


def majority_class(train: DataFrame, label: str, groups: Sequence[str] = ()) -> DataFrame:
    """Most frequent class, the smallest on ties."""
    counts = train.groupBy(*groups, label).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*groups).agg(F.max_by(label, F.struct("_n", (-F.col(label)).alias("low"))).alias("prediction"))


def soft_vote(df: DataFrame, keys: Sequence[str], members: int, classes: int, probabilities: str = "probabilities") -> DataFrame:
    """Equal-weight mean of the class probabilities; a case without every member stays as -1."""
    means = F.array(*[F.avg(F.col(probabilities)[c]) for c in range(classes)])
    out = df.groupBy(*keys).agg(F.count(probabilities).alias("_n"), means.alias("_p"))
    whole = F.col("_n") == members
    return out.select(*keys, F.when(whole, F.col("_p")).alias("probabilities"), F.when(whole, top_class(F.col("_p"))).otherwise(F.lit(-1)).alias("prediction"))


def hard_vote(df: DataFrame, keys: Sequence[str], classes: int, prediction: str = "prediction") -> DataFrame:
    """Most votes, the lowest class on ties; failed predictions do not vote."""
    votes = F.array(*[F.count_if(F.col(prediction) == c) for c in range(classes)])
    return df.groupBy(*keys).agg(votes.alias("votes")).withColumn("prediction", top_class(F.col("votes"))).drop("votes")


def gaussian_fit(train: DataFrame, label: str, vector: str, smoothing: float) -> DataFrame:
    """Per class: log prior, means and smoothed population variances, as arrays by dimension."""
    long = train.select(label, F.posexplode(vector).alias("_i", "_x")).withColumn("_x", F.col("_x").cast("double"))
    widest = long.groupBy("_i").agg(F.var_pop("_x").alias("_v")).agg(F.max("_v")).scalar()
    cells = long.groupBy(label, "_i").agg(F.avg("_x").alias("mean"), F.var_pop("_x").alias("var"), F.count(F.lit(1)).alias("_n"))
    cells = cells.withColumn("var", F.col("var") + F.lit(smoothing) * widest)
    total = train.agg(F.count(F.lit(1))).scalar()
    arrays = cells.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("_i", "mean", "var"))).alias("cells"), F.first("_n").alias("_n"))
    return arrays.select(label, F.log(F.col("_n") / total).alias("prior"), "cells")


def gaussian_predict(df: DataFrame, case_id: str, vector: str, fitted: DataFrame, label: str) -> DataFrame:
    """Most likely class; the fitted classes travel as one array value, so the cases are not shuffled."""
    classes = df.withColumn("_c", fitted.agg(F.sort_array(F.collect_list(F.struct(label, "prior", "cells")))).scalar())
    term = lambda x, c: -0.5 * F.log(F.lit(2 * 3.141592653589793) * c["var"]) - F.pow(x.cast("double") - c["mean"], F.lit(2.0)) / (2 * c["var"])
    joint = F.transform("_c", lambda c: c["prior"] + F.aggregate(F.zip_with(F.col(vector), c["cells"], term), F.lit(0.0), lambda a, x: a + x))
    scored = classes.withColumn("_j", joint)
    best = F.element_at(F.col("_c"), top_class(F.col("_j")) + 1)[label]
    return scored.select(case_id, best.alias("prediction"), F.array_max("_j").alias("log_joint"))
