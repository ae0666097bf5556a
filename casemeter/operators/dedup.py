"""Conflict removal, priority deduplication and set checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def conflicting_keys(df: DataFrame, key: str, label: str) -> DataFrame:
    """Keys that carry more than one label. Min and max combine map-side, so a hot key is one row per task."""
    return (
        df.groupBy(key)
        .agg(F.min(label).alias("_lo"), F.max(label).alias("_hi"))
        .where(F.col("_lo") != F.col("_hi"))
        .select(key)
    )


def drop_conflicts(df: DataFrame, key: str, label: str) -> DataFrame:
    """Remove every row whose key occurs with more than one label."""
    return df.join(conflicting_keys(df, key, label), key, "left_anti")


def first_by_priority(df: DataFrame, key: str, priority: Sequence[str]) -> DataFrame:
    """One row per key, the smallest by ``priority``.

    An aggregate rather than a window: copies of a hot key collapse map-side, and each
    surviving payload moves through one shuffle.
    """
    rest = [c for c in df.columns if c != key]
    best = F.min_by(F.struct(*rest), F.struct(*priority)).alias("_row")
    return df.groupBy(key).agg(best).select(key, "_row.*").select(*df.columns)


def clean_snapshot(df: DataFrame, key: str, label: str, priority: Sequence[str]) -> DataFrame:
    """Conflict removal and priority deduplication in a single aggregate."""
    rest = [c for c in df.columns if c != key]
    agg = df.groupBy(key).agg(
        F.min(label).alias("_lo"), F.max(label).alias("_hi"), F.min_by(F.struct(*rest), F.struct(*priority)).alias("_row")
    )
    return agg.where(F.col("_lo") == F.col("_hi")).select(key, "_row.*").select(*df.columns)


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts; empty when unique."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def overlaps(df: DataFrame, key: str, partition: str, scope: Sequence[str] = ()) -> DataFrame:
    """Keys present in more than one partition of a scope (one pass, not pairwise intersections)."""
    return (
        df.groupBy(*scope, key)
        .agg(F.min(partition).alias("first_partition"), F.max(partition).alias("last_partition"))
        .where(F.col("first_partition") != F.col("last_partition"))
    )


def signed_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Multiset difference as signed counts: positive only in ``left``, negative only in ``right``."""
    a = left.select(*keys, F.lit(1).alias("_s"))
    b = right.select(*keys, F.lit(-1).alias("_s"))
    return a.unionByName(b).groupBy(*keys).agg(F.sum("_s").alias("excess")).where("excess <> 0")


def one_sided(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys found on one side only, with the side that has them; empty when the sets are equal."""
    a = left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r"))
    b = right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    both = a.unionByName(b).groupBy(*keys).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    side: Column = F.when(F.col("_l") == 1, "left").otherwise("right")
    return both.where(F.col("_l") != F.col("_r")).select(*keys, side.alias("only_in"))
