"""Paired, resume and snapshot joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import small_table


def exclude(df: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in no excluded set (the union of earlier test sets)."""
    return df.join(excluded.select(key), key, "left_anti")


def keep_members(df: DataFrame, members: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(members.select(*keys), list(keys), "left_semi")


def lookup(df: DataFrame, dictionary: DataFrame, key: str) -> DataFrame:
    """Attach dictionary columns; the dictionary is broadcast after a size check."""
    return df.join(small_table(dictionary), key, "left")


def exact_offsets(df: DataFrame, time: str, fields: Mapping[str, Sequence[str]], offsets: Mapping[str, int], keys: Sequence[str] = ()) -> DataFrame:
    """Rows at hour ``t`` for which every ``t + offset`` exists, with the fields found there.

    Each row is sent to the hours that look at it and one aggregate collects them: a single
    shuffle instead of a self-join per offset. A missing hour drops the example; positions
    are never counted. ``fields`` maps an offset name to the columns wanted from it; output
    columns are ``<column>_<offset name>``.
    """
    named = {"now": 0, **offsets}
    wanted = [c for c in df.columns if c not in keys and c != time]
    hours = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(-k).alias("shift")) for n, k in named.items()]))
    spread = df.withColumn("_o", hours)
    spread = spread.withColumn(time, F.col(time) + F.make_dt_interval(hours=F.col("_o.shift")))
    aggs = [F.max(F.when(F.col("_o.name") == n, F.lit(1))).alias(f"_has_{n}") for n in named]
    aggs += [F.max(F.when(F.col("_o.name") == n, F.col(c))).alias(f"{c}_{n}") for n, cols in fields.items() for c in cols if c in wanted]
    found = spread.groupBy(*keys, time).agg(*aggs)
    complete = sum((F.coalesce(F.col(f"_has_{n}"), F.lit(0)) for n in named), F.lit(0)) == len(named)
    return found.where(complete).drop(*[f"_has_{n}" for n in named])


def paired(df: DataFrame, scope: Sequence[str], case_id: str, model: str, reference: str, comparators: Sequence[str], fields: Mapping[str, Column]) -> DataFrame:
    """Reference and comparators side by side per case, one row per comparator.

    One shuffle on the case serves every comparator (a self-join would need one each).
    Each field appears as ``<field>_a`` (reference) and ``<field>_b`` (comparator);
    ``n_a`` and ``n_b`` count the records, so a case that one side lacks is visible.
    """
    pick = lambda name, expr: F.max(F.when(F.col(model) == name, expr))
    aggs = [F.count_if(F.col(model) == m).alias(f"_n_{i}") for i, m in enumerate([reference, *comparators])]
    aggs += [pick(m, e).alias(f"_{f}_{i}") for i, m in enumerate([reference, *comparators]) for f, e in fields.items()]
    wide = df.groupBy(*scope, case_id).agg(*aggs)
    sides = [
        F.struct(
            F.lit(m).alias("comparator"),
            F.col("_n_0").alias("n_a"),
            F.col(f"_n_{i}").alias("n_b"),
            *[c for f in fields for c in (F.col(f"_{f}_0").alias(f"{f}_a"), F.col(f"_{f}_{i}").alias(f"{f}_b"))],
        )
        for i, m in enumerate(comparators, 1)
    ]
    return wide.select(*scope, case_id, F.explode(F.array(*sides)).alias("_p")).select(*scope, case_id, "_p.*").where("n_a + n_b > 0")


def unpaired(pairs: DataFrame, scope: Sequence[str], case_id: str) -> DataFrame:
    """Cases that only one side covers, or whose labels disagree."""
    bad = (F.col("n_a") != 1) | (F.col("n_b") != 1) | ~F.col("label_a").eqNullSafe(F.col("label_b"))
    return pairs.where(bad).select(*scope, case_id, "comparator", "n_a", "n_b")


def require_paired(pairs: DataFrame) -> DataFrame:
    """``pairs`` as they are; the first case that only one side covers, or whose labels disagree, is an error where it is read."""
    whole = (F.col("n_a") == 1) & (F.col("n_b") == 1) & F.col("label_a").eqNullSafe(F.col("label_b"))
    return pairs.where(F.assert_true(whole, F.concat(F.lit("unpaired case against "), F.col("comparator"))).isNull())


def resume(requests: DataFrame, answers: DataFrame, request_hash: str) -> tuple[DataFrame, DataFrame]:
    """``(answered, pending)``: stored answers joined by request hash, and the distinct rest to score."""
    answered = requests.join(answers.withColumn("_hit", F.lit(True)), request_hash, "left").withColumn("cache_hit", F.col("_hit").isNotNull()).drop("_hit")
    pending = requests.select(request_hash).distinct().join(answers.select(request_hash), request_hash, "left_anti")
    return answered, pending
