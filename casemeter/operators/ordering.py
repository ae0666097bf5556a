"""Ranks, running totals and quantiles that never put one group into one task.

A window partitioned by the group alone would sort a hot group in a single task. The
operators here first reduce rows to counts (map-side combined). A group of more than ``GROUP_ROWS``
counts is cut into buckets of its order, at marks of its own that a sketch of the group gives; buckets are totalled,
and only (group, bucket) is sorted. The totals are summed in the same way, so neither a
hot group nor a long row of buckets meets in one task. There is one plan for every size.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DateType, LongType, StringType, StructField, StructType, TimestampNTZType, TimestampType

from ..session import checkpointed

#: Leading hex digits of a draw by which a stratum is counted at a time, and rows of a bucket that one task sorts.
DIGITS = 2
SORT_ROWS = 1_000_000
#: Counts of a group that one task sorts; larger groups are cut into buckets.
GROUP_ROWS = 50_000
#: Most buckets of a group, and the accuracy of the sketch that sets their marks (a rank error of about 0.3 %).
BUCKETS, SKETCH = 256, 1000


def _number(df: DataFrame, order: str) -> Column:
    """The order column as a double that rises with it."""
    kind = df.schema[order].dataType
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.unix_micros(F.col(order).cast("timestamp")).cast("double")
    return F.unix_date(order).cast("double") if isinstance(kind, DateType) else F.col(order).cast("double")


def with_order_bucket(hist: DataFrame, keys: Sequence[str], order: str, rows: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Add ``_b``, a monotone bucket of the order within each group: 0 in a group of up to ``rows`` counts.

    Marks steer balance only: any monotone bucket gives the same running totals. Only groups that need marks have a row in the
    table that is joined, at most one for each ``rows`` counts of the input.
    """
    rows = GROUP_ROWS if rows is None else rows
    value = hist.withColumn("_o", _number(hist, order))
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    # NaN, which sorts above every number, and null, which sorts below, are no part of the sketch.
    seen = value.where(F.col("_o").isNotNull() & ~F.isnan("_o")).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.kll_sketch_agg_double("_o", F.lit(SKETCH)).alias("_k"))
    marks = seen.where(F.col("_n") > rows).select(*keys, F.array_distinct(F.kll_sketch_get_quantile_double("_k", shares)).alias("_marks"))
    if keys:
        same = [F.col(f"h.{c}").eqNullSafe(F.col(f"m.{c}")) for c in keys]
        placed = value.alias("h").join(marks.alias("m"), on=same, how="left").select("h.*", "_marks")
    else:
        placed = value.withColumn("_marks", marks.select("_marks").scalar())
    bucket = F.when(F.col("_marks").isNull() | F.col("_o").isNull(), 0).otherwise(F.size(F.filter("_marks", lambda mark: F.col("_o") > mark)))
    return placed.withColumn("_b", bucket).drop("_marks", "_o")


def running_totals(hist: DataFrame, keys: Sequence[str], order: str, sums: Sequence[str], bucket: Column | None = None, rows: int | None = None) -> DataFrame:
    """Inclusive running sums ``cum_<s>`` of one-row-per-(keys, order) counts.

    ``bucket``, a monotone function of the order whose groups fit one task, saves the sketch. Counts that are costly to make should
    be checkpointed by the caller: they are read for the marks, for the totals and for the sums. Groups with null keys are groups.
    """
    own = bucket is None
    keyed = with_order_bucket(hist, keys, order, rows) if own else hist.withColumn("_b", bucket)
    inside = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    totals = keyed.groupBy(*keys, "_b").agg(*[F.sum(s).alias(s) for s in sums])
    if own:  # at most BUCKETS rows a group
        before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(*keys, "_b", *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_off_{s}") for s in sums])
    else:  # as many as the caller's buckets: summed in the same way
        upto = running_totals(checkpointed(totals.withColumnRenamed("_b", "_at")), keys, "_at", sums, rows=rows)
        offsets = upto.select(*keys, F.col("_at").alias("_b"), *[(F.col(f"cum_{s}") - F.col(s)).alias(f"_off_{s}") for s in sums])
    local = keyed.select("*", *[F.sum(s).over(inside).alias(f"_cum_{s}") for s in sums])
    same = [F.col(f"h.{c}").eqNullSafe(F.col(f"m.{c}")) for c in [*keys, "_b"]]
    joined = local.alias("h").join(offsets.alias("m"), on=same)
    return joined.select(*[F.col(f"h.{c}") for c in hist.columns], *[(F.col(f"_cum_{s}") + F.col(f"_off_{s}")).alias(f"cum_{s}") for s in sums])


def quantile_ranks(n: Column, q: Column, method: str) -> tuple[Column, Column, Column]:
    """Zero-based lower rank, upper rank and interpolation weight of quantile ``q``."""
    if method == "linear":
        pos = (n - 1) * q
        return F.floor(pos), F.ceil(pos), pos - F.floor(pos)
    if method == "higher":
        hi = F.ceil((n - 1) * q)
        return hi, hi, F.lit(0.0)
    if method == "element":
        hi = F.least(n - 1, F.floor(n * q))
        return hi, hi, F.lit(0.0)
    raise ValueError(f"unknown quantile method {method!r}")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    qs: Sequence[float],
    method: str = "linear",
    weight: str | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Exact quantiles per group in long form: ``keys, q, value``.

    ``method``: ``linear`` interpolates, ``higher`` takes the upper neighbour, ``element``
    takes the element with index ``min(n-1, floor(q n))``. Null values are ignored.
    """
    hist = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_n"))
    )
    hist = checkpointed(hist)
    cum = running_totals(hist, keys, "_v", ["_n"], rows=rows)

    def wanted(q: Column) -> Column:
        lo, hi, w = quantile_ranks(F.col("_size"), q, method)
        return F.struct(q.alias("q"), lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"), w.cast("double").alias("w"))

    levels = F.expr(f"array({', '.join(f'{float(q)!r}D' for q in qs)})")
    # The wanted ranks are worked out once per group, not per value.
    ranks = hist.groupBy(*keys).agg(F.sum("_n").alias("_size")).select(*keys, F.transform(levels, wanted).alias("_ranks"))
    cum = cum.join(ranks, list(keys)) if keys else cum.withColumn("_ranks", ranks.scalar())
    spans = cum.select(*keys, "_v", "_ranks", (F.col("cum__n") - F.col("_n")).alias("_start"), F.col("cum__n").alias("_end"))
    inside = lambda r: (r >= F.col("_start")) & (r < F.col("_end"))
    hits = spans.select(*keys, "_v", "_start", "_end", F.explode(F.filter("_ranks", lambda s: inside(s["lo"]) | inside(s["hi"]))).alias("_r"))
    covers = lambda f: (F.col(f"_r.{f}") >= F.col("_start")) & (F.col(f"_r.{f}") < F.col("_end"))
    picked = hits.groupBy(*keys, F.col("_r.q").alias("q"), F.col("_r.w").alias("_w")).agg(
        F.max(F.when(covers("lo"), F.col("_v"))).alias("_lo"), F.max(F.when(covers("hi"), F.col("_v"))).alias("_hi")
    )
    value_at = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_w")
    return picked.select(*keys, "q", value_at.alias("value"))


def count_draws(df: DataFrame, strata: Sequence[str], draw: str) -> DataFrame:
    """Rows per (stratum, leading digits of the draw): the one pass that a split counts in, as a checkpointed table ``_b, _n``.

    ``draw`` is a uniform hexadecimal string, so its leading digits cut every stratum, however hot, into even buckets.
    """
    return checkpointed(df.groupBy(*strata, F.substring(draw, 1, DIGITS).alias("_b")).agg(F.count(F.lit(1)).alias("_n")))


def _same(left: str, right: str, cols: Sequence[str]) -> list[Column]:
    """Join conditions in which nulls are equal."""
    return [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in cols] or [F.lit(True)]


def draw_cuts(df: DataFrame, strata: Sequence[str], draw: str, ranks: Iterable[tuple], counted: DataFrame) -> dict[tuple, str]:
    """Draw value found at one-based ranks inside each stratum: ``{(*stratum, rank): cut}``.

    ``counted`` is the table of :func:`count_draws`. Each rank falls in one bucket of its stratum; a bucket of more than ``SORT_ROWS`` rows is counted
    again by its next digits, any other is sorted, so no class is sorted as a whole. Rows of one draw, that is of one case id, on both sides of a
    cut are an error. Nulls are a stratum like others.
    """
    spark, ranks = df.sparkSession, sorted(set(ranks), key=lambda r: [(v is None, v) for v in r])
    fields = [df.schema[c] for c in strata]
    schema = StructType([*fields, StructField("rank", LongType()), StructField("_up", StringType()), StructField("_rest", LongType())])
    cuts: dict[tuple, str] = {}
    open_, digits = [(*r, "", r[-1]) for r in ranks], DIGITS
    while open_:
        wanted = F.broadcast(spark.createDataFrame(open_, schema))  # one row for each class and part
        order = Window.partitionBy(*strata, F.substring("_b", 1, digits - DIGITS)).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
        upto = counted.withColumn("_cum", F.sum("_n").over(order))
        inside = (F.substring("c._b", 1, digits - DIGITS) == F.col("w._up")) & (F.col("w._rest") <= F.col("_cum")) & (F.col("w._rest") > F.col("_cum") - F.col("_n"))
        hit = upto.alias("c").join(wanted.alias("w"), on=[*_same("c", "w", strata), inside])
        found = hit.select(*[F.col(f"w.{c}") for c in strata], "w.rank", F.col("c._b").alias("_up"), (F.col("w._rest") - F.col("_cum") + F.col("_n")).alias("_rest"), "_n").collect()
        small = [tuple(r)[:-1] for r in found if r["_n"] <= SORT_ROWS]
        open_ = [tuple(r)[:-1] for r in found if r["_n"] > SORT_ROWS]
        if small:
            cuts |= _sorted_cuts(df, strata, draw, spark.createDataFrame(small, schema), digits)
        if open_:
            part = F.broadcast(spark.createDataFrame(open_, schema).select(*strata, "_up").distinct())
            rows = df.alias("d").join(part.alias("w"), on=[*_same("d", "w", strata), F.substring(f"d.{draw}", 1, digits) == F.col("w._up")], how="left_semi")
            digits += DIGITS
            counted = checkpointed(rows.groupBy(*strata, F.substring(draw, 1, digits).alias("_b")).agg(F.count(F.lit(1)).alias("_n")))
    return cuts


def _sorted_cuts(df: DataFrame, strata: Sequence[str], draw: str, wanted: DataFrame, digits: int) -> dict[tuple, str]:
    """The draws at places ``_rest`` of the buckets ``_up``."""
    bucketed = df.select(*strata, F.substring(draw, 1, digits).alias("_up"), draw)
    edges = F.broadcast(wanted.select(*strata, "_up").distinct())
    near = bucketed.alias("d").join(edges.alias("w"), on=_same("d", "w", [*strata, "_up"]), how="left_semi")
    spot = Window.partitionBy(*strata, "_up").orderBy(draw)
    placed = near.withColumns({"_rest": F.row_number().over(spot).cast("bigint"), "_next": F.lead(draw).over(spot)})
    hit = placed.alias("d").join(F.broadcast(wanted).alias("w"), on=_same("d", "w", [*strata, "_up", "_rest"]))
    rows = hit.select(*[F.col(f"w.{c}") for c in strata], "w.rank", F.col(f"d.{draw}").alias("_cut"), "_next").collect()
    if any(r["_cut"] == r["_next"] for r in rows):
        raise ValueError("repeated case ids on both sides of a cut")
    return {tuple(r)[:-2]: r["_cut"] for r in rows}


def dense_positions(df: DataFrame, order: str, keys: Sequence[str] = (), bucket: Column | None = None) -> DataFrame:
    """Zero-based dense position ``position`` by a unique order column."""
    cum = running_totals(df.withColumn("_one", F.lit(1)), keys, order, ["_one"], bucket=bucket)
    return cum.withColumn("position", (F.col("cum__one") - 1).cast("bigint")).drop("_one", "cum__one")
