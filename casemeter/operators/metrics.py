"""Metrics that keep failed and unsupported predictions in the denominator.

Class metrics derive from one confusion table: the fact table is reduced map-side to
``groups x classes x (classes + 1)`` counts and everything after that is bounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import probability as pr
from ..functions.numeric import count_where, is_finite, ratio
from .ordering import exact_quantiles, running_totals

#: The response statuses of a prediction record.
STATUSES = ("ok", "failed", "invalid", "unsupported")


def confusion(df: DataFrame, keys: Sequence[str], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Long confusion counts; ``prediction = -1`` is a failure and stays."""
    return df.groupBy(*keys, F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(conf: DataFrame, keys: Sequence[str], classes: int) -> DataFrame:
    """Wide matrix with one column per predicted class and ``failed`` for -1."""
    wide = conf.groupBy(*keys, "label").pivot("prediction", [*range(classes), -1]).agg(F.sum("n"))
    named = [F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(f"predicted_{c}" if c >= 0 else "failed") for c in [*range(classes), -1]]
    return wide.select(*keys, "label", *named)


def class_table(conf: DataFrame, keys: Sequence[str], classes: int) -> DataFrame:
    """Per declared class: true count, predicted count, hits (zeros included)."""
    zero, one = F.lit(0).cast("bigint"), F.col("n")
    entry = lambda c, t, p, h: F.struct(c.cast("int").alias("class"), t.alias("n_true"), p.alias("n_pred"), h.alias("tp"))
    hit = F.when(F.col("label") == F.col("prediction"), one).otherwise(zero)
    parts = conf.select(*keys, F.explode(F.array(entry(F.col("label"), one, zero, hit), entry(F.col("prediction"), zero, one, zero))).alias("_e"))
    declared = conf.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("_c"))
    declared = declared.select(*keys, entry(F.col("_c"), zero, zero, zero).alias("_e"))
    both = parts.unionByName(declared).select(*keys, "_e.*").where(F.col("class") >= 0)
    return both.groupBy(*keys, "class").agg(*[F.sum(c).alias(c) for c in ("n_true", "n_pred", "tp")])


def accuracy(conf: DataFrame, keys: Sequence[str]) -> DataFrame:
    hits = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
    return conf.groupBy(*keys).agg(F.sum("n").alias("n"), ratio(hits, F.sum("n")).alias("accuracy"))


def class_recall(table: DataFrame, keys: Sequence[str], absent: float | None = None) -> DataFrame:
    """Recall per class; an absent class is null (or zero where the earlier protocol wants it)."""
    recall = ratio(F.col("tp"), F.col("n_true"))
    return table.select(*keys, "class", "n_true", F.coalesce(recall, F.lit(absent).cast("double")).alias("recall"))


def balanced_accuracy_present(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean recall over the classes present in the truth."""
    return table.where("n_true > 0").groupBy(*keys).agg(F.avg(ratio(F.col("tp"), F.col("n_true"))).alias("balanced_accuracy"))


def balanced_accuracy_declared(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean recall over the declared classes; null when one has no case."""
    mean = F.avg(ratio(F.col("tp"), F.col("n_true")))
    return table.groupBy(*keys).agg(F.when(F.min("n_true") > 0, mean).alias("balanced_accuracy"))


def macro_f1(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    f1 = F.coalesce(ratio(2 * F.col("tp"), F.col("n_true") + F.col("n_pred")), F.lit(0.0))
    return table.groupBy(*keys).agg(F.avg(f1).alias("macro_f1"))


def predicted_counts(conf: DataFrame, keys: Sequence[str]) -> DataFrame:
    return conf.groupBy(*keys, "prediction").agg(F.sum("n").alias("n"))


def score_table(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score with running totals from below."""
    hist = df.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"), F.sum((1 - F.col(label)).cast("bigint")).alias("neg")
    )
    return running_totals(hist, keys, "score", ["pos", "neg"])


def ranking_metrics(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Exact ROC AUC (ties count half) and step-wise average precision.

    Groups with a missing or non-finite score, or a single class, get null.
    """
    usable = df.groupBy(*keys).agg(
        F.bool_and(is_finite(F.col(score))).alias("_finite"),
        F.sum(F.col(label).cast("bigint")).alias("_p"),
        F.sum((1 - F.col(label)).cast("bigint")).alias("_n"),
    )
    cum = score_table(df.where(is_finite(F.col(score))), keys, label, score).join(usable, list(keys))
    below = F.col("cum_neg") - F.col("neg")
    area = F.sum(F.col("pos") * (below + F.col("neg") / 2.0))
    tp = F.col("_p") - (F.col("cum_pos") - F.col("pos"))
    fp = F.col("_n") - (F.col("cum_neg") - F.col("neg"))
    step = F.sum(F.col("pos") * ratio(tp, tp + fp))
    found = cum.groupBy(*keys).agg(
        F.first("_p").alias("_p"), F.first("_n").alias("_n"), F.first("_finite").alias("_finite"), area.alias("_area"), step.alias("_step")
    )
    ok = F.col("_finite") & (F.col("_p") > 0) & (F.col("_n") > 0)
    return found.select(
        *keys,
        F.when(ok, F.col("_area") / (F.col("_p").cast("double") * F.col("_n"))).alias("roc_auc"),
        F.when(ok, F.col("_step") / F.col("_p")).alias("average_precision"),
    )


def has_probabilities(status: str = "status", probabilities: str = "probabilities") -> Column:
    return (F.col(status) == "ok") & F.col(probabilities).isNotNull()


def probability_metrics(df: DataFrame, keys: Sequence[str], floor: float = pr.LOG_LOSS_FLOOR) -> DataFrame:
    """Brier score and log loss over valid vectors, reported with their coverage."""
    ok = has_probabilities()
    p, label = F.col("probabilities"), F.col("label")
    return df.groupBy(*keys).agg(
        count_where(ok).alias("probability_rows"),
        ratio(count_where(ok), F.count(F.lit(1))).alias("probability_coverage"),
        F.avg(F.when(ok, pr.brier_row(p, label))).alias("brier"),
        F.avg(F.when(ok, pr.log_loss_row(p, label, floor))).alias("log_loss"),
    )


def calibration_error(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected calibration error over ten equal bins of the top-class confidence."""
    valid = df.where(has_probabilities()).select(*keys, "label", pr.confidence(F.col("probabilities")).alias("_c"), pr.top_class(F.col("probabilities")).alias("_t"))
    bins = valid.groupBy(*keys, pr.confidence_bin(F.col("_c")).alias("_b")).agg(
        F.count(F.lit(1)).alias("_n"), F.avg((F.col("_t") == F.col("label")).cast("double")).alias("_acc"), F.avg("_c").alias("_conf")
    )
    return bins.groupBy(*keys).agg((F.sum(F.col("_n") * F.abs(F.col("_acc") - F.col("_conf"))) / F.sum("_n")).alias("ece"))


def status_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per status; unknown statuses are counted, not lost."""
    known = [count_where(F.col("status") == s).alias(s) for s in STATUSES]
    other = F.coalesce(~F.col("status").isin(*STATUSES), F.lit(True))
    return df.groupBy(*keys).agg(*known, F.count_if(other).alias("other"))


def timed(cache_hit: str = "cache_hit", status: str = "status", latency: str = "latency_ms") -> Column:
    """Rows that count for latency: answered by a call, not by the cache, and supported."""
    return ~F.coalesce(F.col(cache_hit), F.lit(False)) & (F.col(status) != "unsupported") & F.col(latency).isNotNull()


def latency_quantiles(df: DataFrame, keys: Sequence[str], qs: Sequence[float] = (0.5, 0.95), latency: str = "latency_ms") -> DataFrame:
    """Exact interpolated latency percentiles, one column per quantile, with the timed rows."""
    rows = df.where(timed(latency=latency))
    long = exact_quantiles(rows, keys, latency, qs)
    wide = long.groupBy(*keys).agg(*[F.max(F.when(F.col("q") == float(q), F.col("value"))).alias(f"latency_p{round(q * 100)}_ms") for q in qs])
    sizes = df.groupBy(*keys).agg(F.count_if(timed(latency=latency)).alias("uncached_timing_rows"))
    return sizes.join(wide, list(keys), "left")


def cache_hits(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(count_where(F.col("cache_hit")).alias("cache_hits"), count_where(F.col("status") != "ok").alias("not_ok_rows"))


def pair_outcomes(df: DataFrame, keys: Sequence[str], pair_id: str = "pair_id", context: Sequence[str] = ("family", "composition")) -> DataFrame:
    """One row per pair: whether both members are right, and what is wrong with the pair itself."""
    hit = (F.col("status") == "ok") & (F.col("prediction") == F.col("label"))
    aggs = [F.count(F.lit(1)).alias("members"), F.bool_and(hit).alias("both_correct"), F.min("label").alias("_lo"), F.max("label").alias("_hi")]
    for c in context:
        aggs += [F.min(c).alias(c), F.min(c).eqNullSafe(F.max(c)).alias(f"_same_{c}")]
    declared = "pair_relation" in df.columns
    if declared:
        aggs += [F.min("pair_relation").alias("_rel_lo"), F.max("pair_relation").alias("_rel_hi")]
    pairs = df.groupBy(*keys, pair_id).agg(*aggs)
    relation = F.when(F.col("_lo") == F.col("_hi"), "preserve").otherwise("flip")
    same = F.lit(True)
    for c in context:
        same = same & F.col(f"_same_{c}")
    problem = F.when(F.col("members") != 2, "pair is not two rows").when(~same, "context differs")
    if declared:
        problem = problem.when((F.col("_rel_lo") != relation) | (F.col("_rel_hi") != relation), "declared relation differs")
    return pairs.select(*keys, pair_id, *context, relation.alias("observed_relation"), "both_correct", problem.alias("problem"))


def pair_metrics(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(F.col("both_correct").cast("double")).alias("both_members_correct"))


def pair_breakdown(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """By family and composition, with subtotals (null composition) and totals (both null)."""
    flags = [F.grouping("family").alias("family_total"), F.grouping("composition").alias("composition_total")]
    rolled = pairs.withColumn("_key", F.struct(*keys)).rollup("_key", "family", "composition").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg(F.col("both_correct").cast("double")).alias("both_members_correct"), *flags
    )
    return rolled.where(F.col("_key").isNotNull()).select("_key.*", "family", "composition", "n_pairs", "both_members_correct")


def validity(df: DataFrame, keys: Sequence[str], classes: int) -> DataFrame:
    """Counts of rows that make a summary invalid: unknown classes and bad distributions."""
    unknown = ~F.coalesce(F.col("label").between(0, classes - 1), F.lit(False))
    bad = has_probabilities() & ~F.coalesce(pr.is_distribution(F.col("probabilities"), classes), F.lit(False))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(unknown).alias("unknown_class"), F.count_if(bad).alias("bad_distribution"))


def require_valid(df: DataFrame, keys: Sequence[str], classes: int) -> DataFrame:
    """Validity table that fails the query when any group is invalid."""
    v = validity(df, keys, classes)
    bad = (F.col("unknown_class") > 0) | (F.col("bad_distribution") > 0)
    return v.withColumn("n", F.when(bad, F.raise_error(F.lit("invalid predictions")).cast("bigint")).otherwise(F.col("n")))


def throughput(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Rows per second between the first and the last record of a group."""
    seconds = F.timestamp_diff("SECOND", F.min(time), F.max(time))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), seconds.alias("seconds"), ratio(F.count(F.lit(1)), seconds).alias("rows_per_second"))


def coverage_curve(df: DataFrame, keys: Sequence[str], confidence: str, wrong: Column) -> DataFrame:
    """Coverage and error when only cases at or above each confidence are answered."""
    hist = df.where(F.col(confidence).isNotNull()).groupBy(*keys, F.col(confidence).cast("double").alias("cutoff")).agg(
        F.count(F.lit(1)).alias("n"), count_where(wrong).alias("errors")
    )
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    answered = hist.groupBy(*keys).agg(F.sum("n").alias("_n"), F.sum("errors").alias("_e"))
    cum = running_totals(hist, keys, "cutoff", ["n", "errors"]).join(answered, list(keys)).join(total, list(keys))
    kept = F.col("_n") - F.col("cum_n") + F.col("n")
    errors = F.col("_e") - F.col("cum_errors") + F.col("errors")
    return cum.select(*keys, "cutoff", ratio(kept, F.col("_all")).alias("coverage"), ratio(errors, kept).alias("error"))


def error_at_coverage(curve: DataFrame, keys: Sequence[str], coverage: float) -> DataFrame:
    """Error at the highest cut-off that still covers the given share."""
    reached = curve.where(F.col("coverage") >= coverage)
    best = F.max_by(F.struct("cutoff", "coverage", "error"), "cutoff")
    return reached.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def coverage_at_error(policy: DataFrame, test: DataFrame, keys: Sequence[str], target: float) -> DataFrame:
    """Cut-off chosen on policy rows (largest coverage within the target), applied to test rows."""
    chosen = policy.where(F.col("error") <= target).groupBy(*keys).agg(F.min("cutoff").alias("chosen"))
    at = test.join(chosen, list(keys)).where(F.col("cutoff") >= F.col("chosen"))
    got = F.min_by(F.struct("coverage", "error"), "cutoff")
    return at.groupBy(*keys, "chosen").agg(got.alias("_g")).select(*keys, "chosen", "_g.*")


def summarise(df: DataFrame, keys: Sequence[str], classes: int, latency: bool = True) -> DataFrame:
    """One row per group with every operational metric."""
    conf = confusion(df, keys)
    table = class_table(conf, keys, classes)
    out = accuracy(conf, keys)
    parts = [balanced_accuracy_declared(table, keys), macro_f1(table, keys), status_counts(df, keys), probability_metrics(df, keys), calibration_error(df, keys)]
    if latency:
        parts.append(latency_quantiles(df, keys))
    for part in parts:
        out = out.join(part, list(keys), "left")
    return out


