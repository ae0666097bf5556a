"""Batch scoring with a pluggable provider; every case yields exactly one record."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

Provider = Callable[[pd.DataFrame], pd.DataFrame]

ANSWER = StructType(
    [
        StructField("prediction", IntegerType()),
        StructField("probabilities", ArrayType(DoubleType())),
        StructField("status", StringType()),
        StructField("reason", StringType()),
    ]
)


def _answer(batch: pd.DataFrame, provider: Provider, key: str) -> pd.DataFrame:
    """One record per row of the batch, whatever the provider returns."""
    blank = pd.DataFrame({key: batch[key].to_numpy(), "prediction": -1, "probabilities": None, "status": "failed", "reason": "no answer"})
    try:
        given = provider(batch)
    except Exception as error:  # noqa: BLE001  a failing provider must not lose the cases
        return blank.assign(reason=f"{type(error).__name__}: {error}")
    given = given.drop_duplicates(key).set_index(key).reindex(batch[key])
    status = given["status"] if "status" in given else pd.Series("ok", index=given.index)
    status = status.where(given["prediction"].notna(), "failed").fillna("ok")
    ok = (status == "ok").to_numpy()
    reason = given["reason"] if "reason" in given else pd.Series([None] * len(given), index=given.index)
    out = blank.assign(
        status=status.to_numpy(),
        prediction=given["prediction"].where(ok, -1).fillna(-1).astype(int).to_numpy(),
        reason=[r if isinstance(r, str) else ("no answer" if s == "failed" else None) for r, s in zip(reason, status)],
    )
    if "probabilities" in given:
        out["probabilities"] = [p if good and p is not None and not isinstance(p, float) else None for p, good in zip(given["probabilities"], ok)]
    return out


def score_requests(requests: DataFrame, provider: Provider, key: str, inputs: Sequence[str], max_batch: int = 1000) -> DataFrame:
    """Score distinct requests in Arrow batches: ``key, prediction, probabilities, status, reason``."""
    schema = StructType([requests.schema[key], *ANSWER.fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), max_batch):
                yield _answer(batch.iloc[start : start + max_batch].reset_index(drop=True), provider, key)

    return requests.select(key, *inputs).mapInPandas(run, schema)


def score_batches(cases: DataFrame, provider: Provider, key: str, inputs: Sequence[str]) -> DataFrame:
    """Score each distinct request once and give the answer to every case that asks it.

    Copies of one request collapse map-side before the provider sees them, however many there are.
    """
    distinct = cases.groupBy(key).agg(*[F.min(c).alias(c) for c in inputs])
    answers = score_requests(distinct, provider, key, inputs)
    return cases.drop(*inputs).join(answers, key, "left")
