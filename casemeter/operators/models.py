"""Bounded families of Spark ML classifiers: presets, search, refit and uniform scoring."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.base import Estimator, Model
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..session import checkpointed
from . import decide as de, metrics as me
from .table_features import class_weights, with_class_weights

WEIGHT = "_weight"


@dataclass(frozen=True)
class Candidate:
    """One predeclared setting of a family."""

    family: str
    params: Mapping[str, Any]
    balanced: bool = False
    extra: Mapping[str, Any] = field(default_factory=dict)


#: The declared settings of each family.
SETTINGS: dict[str, list[dict[str, Any]]] = {
    "logistic_regression": [{"C": 0.3}, {"C": 3.0}],
    "linear_svm": [{"C": 0.3}, {"C": 3.0}],
    "rbf_svm": [{"C": 0.3}, {"C": 3.0}],
    "decision_tree": [{"maxDepth": 10, "minInstancesPerNode": 3}, {"maxDepth": 30, "minInstancesPerNode": 10}],
    "random_forest": [
        {"maxDepth": 16, "minInstancesPerNode": 2, "featureSubsetStrategy": "sqrt"},
        {"maxDepth": 24, "minInstancesPerNode": 1, "featureSubsetStrategy": "0.15"},
    ],
    "randomised_forest": [
        {"maxDepth": 16, "minInstancesPerNode": 2, "featureSubsetStrategy": "sqrt"},
        {"maxDepth": 24, "minInstancesPerNode": 1, "featureSubsetStrategy": "0.15"},
    ],
    "naive_bayes": [{"smoothing": 0.1}, {"smoothing": 1.0}],
    "gradient_boosting": [
        {"maxDepth": 3, "stepSize": 0.05},
        {"maxDepth": 6, "stepSize": 0.1},
        {"maxDepth": 4, "stepSize": 0.05},
    ],
}


def candidates(family: str, max_trials: int | None = None) -> list[Candidate]:
    """Settings x {unweighted, balanced}, alternating, at most ``max_trials``."""
    out = [Candidate(family, p, balanced) for p in SETTINGS[family] for balanced in (False, True)]
    return out[:max_trials]


def estimator(c: Candidate, classes: int, rows: int, seed: int, trees: int = 20, rounds: int = 20, features: str = "features", label: str = "label") -> Estimator:
    """Spark estimator of a candidate.

    ``C`` follows the sum-of-losses convention, so the regulariser is ``1 / (C n)``. The
    RBF machine is a linear one on the features of :mod:`kernels`. The randomised forest here is a
    forest on all rows with few split points; :mod:`extra_trees` and :mod:`boosting` are builders of their own.
    """
    io = {"featuresCol": features, "labelCol": label}
    weight = {"weightCol": WEIGHT} if c.balanced else {}
    p = dict(c.params)
    if c.family == "logistic_regression":
        return LogisticRegression(regParam=1 / (p["C"] * rows), standardization=False, maxIter=100, **io, **weight)
    if c.family in ("linear_svm", "rbf_svm"):
        svm = LinearSVC(regParam=1 / (p["C"] * rows), standardization=False, maxIter=100, **io, **weight)
        return svm if classes == 2 else OneVsRest(classifier=svm, parallelism=4, **io, **weight)
    if c.family == "decision_tree":
        return DecisionTreeClassifier(seed=seed, **p, **io, **weight)
    if c.family == "random_forest":
        return RandomForestClassifier(numTrees=trees, seed=seed, **p, **io, **weight)
    if c.family == "randomised_forest":
        return RandomForestClassifier(numTrees=trees, seed=seed, subsamplingRate=1.0, bootstrap=False, maxBins=8, **p, **io, **weight)
    if c.family == "naive_bayes":
        return NaiveBayes(modelType=c.extra.get("modelType", "multinomial"), **p, **io, **weight)
    if c.family == "gradient_boosting":
        gbt = GBTClassifier(maxIter=c.extra.get("rounds", rounds), seed=seed, **p, **io, **weight)
        if "validation" in c.extra:
            gbt.setValidationIndicatorCol(c.extra["validation"])
        return gbt if classes == 2 else OneVsRest(classifier=gbt, parallelism=4, **io, **weight)
    raise ValueError(f"unknown family {c.family!r}")


def weighted(df: DataFrame, label: str = "label") -> DataFrame:
    """Add balanced class weights under the weight column."""
    w = class_weights(df, label)
    return with_class_weights(df, label, w).withColumnRenamed("weight", WEIGHT)


def fit(c: Candidate, train: DataFrame, classes: int, seed: int, label: str = "label", features: str = "features", **kw: Any) -> Model:
    data = weighted(train, label) if c.balanced else train
    return estimator(c, classes, train.count(), seed, features=features, label=label, **kw).fit(data)


def score(model: Model, df: DataFrame, classes: int, keep: Sequence[str]) -> DataFrame:
    """Uniform output: raw class, score, probabilities (null for margin models) and the default threshold.

    A one-vs-rest model yields the raw class only; its score is null.
    """
    out = model.transform(df)
    raw = F.col("prediction").cast("int").alias("raw")
    if "probability" in out.columns:
        p = vector_to_array("probability")
        s = (p[1] if classes == 2 else F.array_max(p)).alias("score")
        return out.select(*keep, raw, s, p.alias("probabilities"), F.lit(0.5).alias("default_threshold"))
    none = F.lit(None).cast("array<double>").alias("probabilities")
    margin = vector_to_array("rawPrediction")[1] if "rawPrediction" in out.columns and classes == 2 else F.lit(None).cast("double")
    return out.select(*keep, raw, margin.alias("score"), none, F.lit(0.0).alias("default_threshold"))


def boosting_rounds(model: Model, validation: DataFrame) -> int:
    """Rounds with the lowest validation loss, for the refit."""
    losses = model.evaluateEachIteration(validation)
    return int(np.argmin(losses)) + 1


def early_stopping(c: Candidate, train: DataFrame, validation: DataFrame, seed: int, rounds: int = 20, label: str = "label", features: str = "features") -> tuple[Model, int]:
    """Fit with a validation indicator; returns the model and the round count to refit with."""
    both = train.withColumn("_validation", F.lit(False)).unionByName(validation.withColumn("_validation", F.lit(True)))
    chosen = Candidate(c.family, c.params, c.balanced, {**c.extra, "validation": "_validation", "rounds": rounds})
    model = fit(chosen, both, 2, seed, label=label, features=features)
    return model, boosting_rounds(model, validation)


def _validation_value(scored: DataFrame, classes: int, label: str) -> float | None:
    """Validation balanced accuracy; binary tasks are judged after a provisional threshold."""
    one = checkpointed(scored.withColumn("all_rows", F.lit(1)).drop("probabilities"))
    if classes == 2 and not one.where(F.col("score").isNull()).limit(1).count():
        default = one.select("default_threshold").limit(1).collect()[0][0]
        rows = de.choose_threshold(one, ["all_rows"], label, "score", default).collect()
        return rows[0]["selection_balanced_accuracy"] if rows else None
    table = me.class_table(me.confusion(one, ["all_rows"], label, "raw"), ["all_rows"], classes)
    return me.balanced_accuracy_present(table, ["all_rows"]).collect()[0]["balanced_accuracy"]


TRIALS = "family string, trial int, params map<string,string>, balanced_weights boolean, score double, rounds int, seconds double, error string"


def search(options: Sequence[Candidate], train: DataFrame, validation: DataFrame, classes: int, seed: int, label: str = "label", features: str = "features", **kw: Any) -> tuple[DataFrame, list[Candidate]]:
    """Try every candidate on the cached splits; a failing one is recorded, all failing is an error."""
    train, validation = train.persist(), validation.persist()
    rows = []
    for i, c in enumerate(options):
        started, value, error = time.perf_counter(), None, None
        try:
            model = fit(c, train, classes, seed, label, features, **kw)
            value = _validation_value(score(model, validation, classes, [label]), classes, label)
        except Exception as problem:  # noqa: BLE001  one bad setting must not end the search
            error = f"{type(problem).__name__}: {problem}"
        params = {k: str(v) for k, v in c.params.items()}
        rows.append((c.family, i, params, c.balanced, value, c.extra.get("rounds"), time.perf_counter() - started, error))
    train.unpersist(), validation.unpersist()
    if all(r[4] is None for r in rows):
        raise RuntimeError(f"all candidates failed: {[r[-1] for r in rows][:3]}")
    return train.sparkSession.createDataFrame(rows, TRIALS), list(options)


def select_trial(trials: DataFrame, groups: Sequence[str] = ("family",)) -> DataFrame:
    """Best score per group; the first declared wins ties."""
    best = F.max_by(F.struct("trial", "score"), F.struct("score", (-F.col("trial")).alias("first")))
    return trials.where(F.col("score").isNotNull()).groupBy(*groups).agg(best.alias("_b")).select(*groups, "_b.*")


def leaderboard(trials: DataFrame) -> DataFrame:
    """Ranked trials over all families."""
    from pyspark.sql import Window

    order = Window.orderBy(F.desc_nulls_last("score"), "family", "trial")  # a declared grid: few rows
    return trials.withColumn("place", F.row_number().over(order)).select("place", "family", "trial", "balanced_weights", "score", "error")


def refit(trials: DataFrame, options: Sequence[Candidate], train: DataFrame, validation: DataFrame, classes: int, seed: int, **kw: Any) -> tuple[Candidate, Model]:
    """Fit the selected candidate on training plus validation rows."""
    best = select_trial(trials.withColumn("_all", F.lit(1)), ["_all"]).collect()[0]
    chosen = options[best["trial"]]
    return chosen, fit(chosen, train.unionByName(validation), classes, seed, **kw)


def dense_pipeline(vector: str = "features") -> Pipeline:
    """Scaling fitted on whatever rows ``fit`` is given: training rows for selection, plus validation for the refit."""
    return Pipeline(stages=[StandardScaler(inputCol=vector, outputCol="scaled", withMean=True, withStd=True)])
