"""Leakage-safe splits by deterministic draws.

Every split orders the cases of a stratum by ``sha2(seed|case_id)`` and takes rank
intervals of that order. Only class counts (a checked, bounded table) reach the driver;
the cases are assigned by comparing their draw with cut values, a broadcast join and a
filter, so a split shuffles no case-level data and no class ends up in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.keys import draw
from ..session import SMALL_TABLE_ROWS, checkpointed
from .ordering import count_draws, draw_cuts

Counts = dict[tuple, int]
Interval = tuple[tuple, str, int, int]


def class_counts(counted: DataFrame, strata: Sequence[str]) -> Counts:
    """Rows per stratum on the driver, summed from the table of ``count_draws``; refuses an unbounded catalogue. A null class is a class."""
    rows = counted.groupBy(*strata).agg(F.sum("_n").alias("n")).limit(SMALL_TABLE_ROWS + 1).collect()
    if len(rows) > SMALL_TABLE_ROWS:
        raise ValueError("strata are not a bounded catalogue")
    return {tuple(r[c] for c in strata): r["n"] for r in rows}


def _in_order(classes) -> list:
    """Classes from the smallest up, null last."""
    return sorted(classes, key=lambda c: (c is None, c))


def proportional_quota(counts: Mapping, total: int, minimum: int = 0) -> dict:
    """Largest-remainder share of ``total`` with a floor per class, exact in integers.

    Ties go to the smaller class. With ``minimum=1`` the classes lifted to the floor are
    paid for by those furthest above their proportional share.
    """
    n = sum(counts.values())
    if total >= n:
        return dict(counts)
    if total < minimum * len(counts):
        raise ValueError("the cap must cover every class")
    order = _in_order(counts)
    quota = {c: max(minimum, counts[c] * total // n) for c in order}
    over = {c: counts[c] * total - quota[c] * n for c in order}  # (target - quota) * n
    for _ in range(total - sum(quota.values())):
        pick = max((c for c in order if quota[c] < counts[c]), key=lambda c: over[c])
        quota[pick] += 1
        over[pick] -= n
    for _ in range(sum(quota.values()) - total):
        pick = min((c for c in order if quota[c] > minimum), key=lambda c: over[c])
        quota[pick] -= 1
        over[pick] += n
    return quota


def take_intervals(df: DataFrame, strata: Sequence[str], draw_col: str, intervals: Sequence[Interval], counted: DataFrame) -> DataFrame:
    """Rows whose rank by draw lies in an interval ``(stratum, part, lo, hi]``; adds ``partition``."""
    intervals = [i for i in intervals if i[3] > i[2]]
    if len(intervals) > SMALL_TABLE_ROWS:
        raise ValueError("strata are not a bounded catalogue")
    cuts = draw_cuts(df, strata, draw_col, [(*s, r) for s, _, lo, hi in intervals for r in (lo, hi) if r > 0], counted)
    bounds = [(*s, part, cuts[(*s, lo)] if lo else "", cuts[(*s, hi)]) for s, part, lo, hi in intervals]
    schema = StructType([*[df.schema[c] for c in strata], *[StructField(c, StringType()) for c in ("partition", "_after", "_upto")]])
    table = F.broadcast(df.sparkSession.createDataFrame(bounds, schema))
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"t.{c}")) for c in strata]
    within = (F.col(f"d.{draw_col}") > F.col("t._after")) & (F.col(f"d.{draw_col}") <= F.col("t._upto"))
    hit = df.alias("d").join(table.alias("t"), on=[*same, within])
    return hit.select(*[F.col(f"d.{c}") for c in df.columns if c != draw_col], "t.partition")


def _by_group(counts: Counts) -> dict[tuple, dict]:
    """Class counts per group: the last stratum column is the class."""
    groups: dict[tuple, dict] = {}
    for stratum, n in counts.items():
        groups.setdefault(stratum[:-1], {})[stratum[-1]] = n
    return groups


def stratified_parts(counts: Mapping, parts: Sequence[tuple[str, float]], rest: str, caps: Mapping[str, int] | None = None) -> list[tuple]:
    """Rank intervals per class: each part takes its share of what the earlier ones left.

    A part has ``ceil(share * remaining)`` rows, split over classes by largest remainder,
    and is then capped with one case per class kept.
    """
    caps = caps or {}
    remaining, start, out = dict(counts), {c: 0 for c in counts}, []
    for name, share in [*parts, (rest, 1.0)]:
        take = proportional_quota(remaining, ceil(round(share * sum(remaining.values()), 9)))
        kept = proportional_quota({c: q for c, q in take.items() if q}, caps[name], 1) if name in caps else take
        for c in counts:
            out.append((c, name, start[c], start[c] + kept.get(c, 0)))
            start[c] += take[c]
            remaining[c] -= take[c]
    return out


def stratified_split(
    df: DataFrame,
    case_id: str,
    label: str,
    seed: int | str,
    parts: Sequence[tuple[str, float]],
    rest: str = "train",
    groups: Sequence[str] = (),
    caps: Mapping[str, int] | None = None,
) -> DataFrame:
    """Named parts by share, in order, then ``rest``; independent of partitioning and row order."""
    drawn = df.withColumn("_draw", draw(seed, case_id))
    counted = count_draws(drawn, [*groups, label], "_draw")
    counts = class_counts(counted, [*groups, label])
    intervals = [
        ((*g, c), part, lo, hi)
        for g, classes in _by_group(counts).items()
        for c, part, lo, hi in stratified_parts(classes, parts, rest, caps)
    ]
    return take_intervals(drawn, [*groups, label], "_draw", intervals, counted)


def count_split(df: DataFrame, case_id: str, label: str, seed: int | str, parts: Sequence[tuple[str, int]], rest_cap: int, rest: str = "train") -> DataFrame:
    """Stratified parts of absolute size, drawn in turn from what the earlier ones left; the rest is capped."""
    drawn = df.withColumn("_draw", draw(seed, case_id))
    counted = count_draws(drawn, [label], "_draw")
    counts = {c: n for (c,), n in class_counts(counted, [label]).items()}
    start, intervals = dict.fromkeys(counts, 0), []
    for name, size in [*parts, (rest, rest_cap)]:
        quota = proportional_quota({c: n - start[c] for c, n in counts.items() if n > start[c]}, size)
        for c, q in quota.items():
            intervals.append(((c,), name, start[c], start[c] + q))
            start[c] += q
    return take_intervals(drawn, [label], "_draw", intervals, counted)


def stratified_cap(df: DataFrame, case_id: str, label: str, cap: int, seed: int | str, groups: Sequence[str] = ()) -> DataFrame:
    """At most ``cap`` rows per group, proportional by class, every class kept, exactly ``cap`` when larger.

    Case ids are unique; a cut that would separate rows of one id is an error. A null class is a class, the last in order.
    """
    drawn = df.withColumn("_draw", draw(seed, case_id))
    counted = count_draws(drawn, [*groups, label], "_draw")
    return _capped(drawn, [*groups, label], cap, counted, class_counts(counted, [*groups, label]))


def _capped(drawn: DataFrame, strata: Sequence[str], cap: int, counted: DataFrame, counts: Counts) -> DataFrame:
    intervals = [((*g, c), "kept", 0, q) for g, classes in _by_group(counts).items() for c, q in proportional_quota(classes, cap, 1).items()]
    return take_intervals(drawn, strata, "_draw", intervals, counted).drop("partition")


def shared_holdout(
    df: DataFrame, case_id: str, label: str, seed: int | str, cap: int | None = None, excluded: DataFrame | None = None, share: float = 0.2
) -> tuple[DataFrame, DataFrame]:
    """``(pool, test)``: one test set for all training seeds, free of excluded cases; ``cap`` bounds it where a caller wants that."""
    # Several jobs follow; the join is done once.
    allowed = df if excluded is None else checkpointed(df.join(excluded.select(case_id).distinct(), case_id, "left_anti"))
    drawn = allowed.withColumn("_draw", draw(seed, case_id))
    counted = count_draws(drawn, [label], "_draw")
    free = class_counts(counted, [label])
    whole = free if excluded is None else class_counts(df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")), [label])
    size = min(max(len(whole), ceil(round(share * sum(whole.values()), 9))), sum(free.values()))
    test = _capped(drawn, [label], size if cap is None else min(cap, size), counted, free)
    pool = df.join(test.select(case_id), case_id, "left_anti")
    return pool, test


def exemplars(df: DataFrame, case_id: str, label: str, k: int, seed: int | str, groups: Sequence[str] = ()) -> DataFrame:
    """First ``k`` cases of each class by draw; the rank filter is limited map-side before the shuffle."""
    w = Window.partitionBy(*groups, label).orderBy(draw(seed, case_id), case_id)
    return df.withColumn("exemplar", F.row_number().over(w)).where(F.col("exemplar") <= k)


def first_rows(df: DataFrame, groups: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """First ``n`` rows per group (a review sample)."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("review_rank", F.row_number().over(w)).where(F.col("review_rank") <= n)


def group_split(df: DataFrame, group_id: str, seed: int | str, shares: Sequence[tuple[str, int]]) -> DataFrame:
    """All rows of a group in one partition: the draw of the group id modulo the total weight.

    A pure projection: members agree without being brought together.
    """
    total = sum(w for _, w in shares)
    slot = F.conv(F.substring(draw(seed, group_id), 1, 13), 16, 10).cast("bigint") % total
    part, upto = F.lit(None).cast("string"), 0
    for name, weight in reversed(shares):
        part = F.when(slot < total - upto, name).otherwise(part) if upto else F.lit(name)
        upto += weight
    return df.withColumn("partition", part)


def manifest(splits: DataFrame, dims: Sequence[str], label: str = "label") -> DataFrame:
    """Class counts per partition, the published summary of a split."""
    return splits.groupBy(*dims, "partition", label).agg(F.count(F.lit(1)).alias("n"))


def missing_classes(splits: DataFrame, dims: Sequence[str], label: str, classes: int) -> DataFrame:
    """Partitions that lack a class; empty when every class is everywhere."""
    seen = splits.groupBy(*dims, "partition", label).agg(F.count(F.lit(1)).alias("_n"))
    return seen.groupBy(*dims, "partition").agg(F.count(F.lit(1)).alias("classes")).where(F.col("classes") < classes)


def leading_cases(df: DataFrame, position: str, n: int, pair_id: str | None = None) -> DataFrame:
    """First ``n`` cases of a development partition by frozen position; pairs must stay whole."""
    out = df.orderBy(position).limit(n)
    if pair_id is None:
        return out
    odd = out.groupBy(pair_id).agg(F.count(F.lit(1)).alias("n")).where("n <> 2").limit(1).count()
    if odd:
        raise ValueError("a development subset must contain complete pairs")
    return out
