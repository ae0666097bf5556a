"""Multinomial naive Bayes on sparse rows: the model is a table of log probabilities, the score a join with the weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import ratio
from ..session import small_table


def _entries(rows: DataFrame, *keep: str) -> DataFrame:
    """One row per entry of a sparse vector; a row without entries keeps one with null index."""
    pairs = F.arrays_zip("indices", "values")
    return rows.select(*keep, F.explode_outer(pairs).alias("e")).select(*keep, F.col("e.indices").alias("index"), F.col("e.values").alias("value"))


def fit(rows: DataFrame, label: str, width: int, alpha: float) -> tuple[DataFrame, DataFrame]:
    """(label, index, log_prob) for every class and feature, and (label, log_prior), from one aggregate of the entries."""
    entries = _entries(rows, label)
    mass = entries.where("index is not null").groupBy(label, "index").agg(F.sum("value").alias("mass"))
    classes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = classes.agg(F.sum("n")).scalar()
    prior = classes.select(label, F.log(F.col("n") / total).alias("log_prior"))
    # classes x width rows at most, as many as the model has numbers
    grid = classes.select(label, F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("index"))
    full = grid.join(mass, [label, "index"], "left").select(label, "index", F.coalesce("mass", F.lit(0.0)).alias("mass"))
    sums = full.groupBy(label).agg(F.sum("mass").alias("whole"))
    model = full.join(small_table(sums), label).select(label, "index", F.log((F.col("mass") + alpha) / (F.col("whole") + alpha * width)).alias("log_prob"))
    return model, prior


def joint(rows: DataFrame, doc_id: str, model: DataFrame, prior: DataFrame, label: str = "label", limit: int = 2_000_000) -> DataFrame:
    """(doc_id, label, log_joint). A document's entries lie in one partition, so the sums are nearly done before they are shuffled."""
    found = _entries(rows, doc_id).join(small_table(model, limit), "index")
    sums = found.groupBy(doc_id, label).agg(F.sum(F.col("value") * F.col("log_prob")).alias("_s"))
    every = rows.select(doc_id).crossJoin(small_table(prior))  # one row per class; the classes are few
    return every.join(sums, [doc_id, label], "left").select(doc_id, label, (F.col("log_prior") + F.coalesce("_s", F.lit(0.0))).alias("log_joint"))


def predict(scores: DataFrame, doc_id: str, label: str = "label") -> DataFrame:
    """(doc_id, prediction, log_joint, probability) of the likeliest class, the smallest on ties."""
    best = F.max_by(F.struct(F.col(label).alias("prediction"), "log_joint"), F.struct("log_joint", (-F.col(label)).alias("_l")))
    top = scores.groupBy(doc_id).agg(best.alias("b"), F.array_agg("log_joint").alias("_all"))
    spread = F.aggregate("_all", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("b.log_joint")))
    return top.select(doc_id, "b.prediction", "b.log_joint", ratio(F.lit(1.0), spread).alias("probability"))
