"""Metrics over the prediction fact table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..operators import metrics as me
from .bindings import CLASSES, LEDGER_SQL, SCORES_SQL, ledger, pair_predictions, pairs_sql, predictions, predictions_sql, scores
from .catalog import query

KEYS = ["dataset", "seed", "model"]
_P = predictions_sql()
_CLASS = f"""{_P}, groups as (select distinct dataset, seed, model from preds), catalogue as (select dataset, seed, model, cast(c as integer) as class from groups, range(0, 3) t(c)),
  truth as (select dataset, seed, model, label as class, count(*) as n_true, count(*) filter (prediction = label) as tp from preds group by all),
  guess as (select dataset, seed, model, prediction as class, count(*) as n_pred from preds group by all),
  tab as (select c.*, coalesce(n_true, 0) as n_true, coalesce(tp, 0) as tp, coalesce(n_pred, 0) as n_pred from catalogue c left join truth using (dataset, seed, model, class) left join guess using (dataset, seed, model, class))"""


def _table(spark, sf, df=None):
    df = predictions(spark, sf) if df is None else df
    return me.class_table(me.confusion(df, KEYS), KEYS, CLASSES)


def _rounded(df, *cols):
    return df.withColumns({c: r6(F.col(c)) for c in cols})


@query("me1_accuracy", f"with {_P} select dataset, seed, model, count(*) as n, round(avg(case when prediction = label then 1e0 else 0e0 end), 6) as accuracy from preds group by 1, 2, 3")
def me1(spark, sf):
    return _rounded(me.accuracy(me.confusion(predictions(spark, sf), KEYS), KEYS), "accuracy")


@query("me2_balanced_accuracy_present", f"with {_CLASS} select dataset, seed, model, round(avg(tp / n_true) filter (n_true > 0), 6) as balanced_accuracy from tab group by 1, 2, 3")
def me2(spark, sf):
    return _rounded(me.balanced_accuracy_present(_table(spark, sf), KEYS), "balanced_accuracy")


_ABSENT = "not (dataset = 'O' and label = 1)"


@query(
    "me3_balanced_accuracy_declared",
    f"""with {_P}, t as (select dataset, seed, model, label, avg(case when prediction = label then 1e0 else 0e0 end) as recall from preds where {_ABSENT} group by 1, 2, 3, 4)
        select dataset, seed, model, case when count(*) = 3 then round(avg(recall), 6) end as balanced_accuracy from t group by 1, 2, 3""",
)
def me3(spark, sf):
    # Dataset O without class 1: a declared class without cases makes the value null.
    return _rounded(me.balanced_accuracy_declared(_table(spark, sf, predictions(spark, sf).where(_ABSENT)), KEYS), "balanced_accuracy")


@query("me4_macro_f1", f"with {_CLASS} select dataset, seed, model, round(avg(case when n_true + n_pred = 0 then 0 else 2e0 * tp / (n_true + n_pred) end), 6) as macro_f1 from tab group by 1, 2, 3")
def me4(spark, sf):
    return _rounded(me.macro_f1(_table(spark, sf), KEYS), "macro_f1")


@query("me5_class_recall", f"with {_CLASS} select dataset, seed, model, class, n_true, round(case when n_true > 0 then tp / n_true end, 6) as recall from tab")
def me5(spark, sf):
    return _rounded(me.class_recall(_table(spark, sf), KEYS), "recall")


@query(
    "me6_confusion_matrix",
    f"""with {_P} select dataset, seed, model, label, count(*) filter (prediction = 0) as predicted_0, count(*) filter (prediction = 1) as predicted_1,
        count(*) filter (prediction = 2) as predicted_2, count(*) filter (prediction = -1) as failed from preds group by 1, 2, 3, 4""",
)
def me6(spark, sf):
    return me.confusion_matrix(me.confusion(predictions(spark, sf), KEYS), KEYS, CLASSES)


@query("me6_confusion_long", f"with {_P} select dataset, seed, model, label, prediction, count(*) as n from preds group by all")
def me6b(spark, sf):
    return me.confusion(predictions(spark, sf), KEYS)


@query("me7_predicted_counts", f"with {_P} select dataset, seed, model, prediction, count(*) as n from preds group by all")
def me7(spark, sf):
    return me.predicted_counts(me.confusion(predictions(spark, sf), KEYS), KEYS)


_RANK = f"""{SCORES_SQL}, g as (select dataset, model, bool_and(score is not null) as finite, sum(y) as p, count(*) - sum(y) as nn from scores group by 1, 2),
  h as (select dataset, model, score, sum(y) as pos, count(*) - sum(y) as neg from scores where score is not null group by 1, 2, 3),
  c as (select *, sum(neg) over (partition by dataset, model order by score) - neg as below, sum(pos) over (partition by dataset, model order by score desc) as tp,
        sum(neg) over (partition by dataset, model order by score desc) as fp from h)"""


@query(
    "me8_roc_auc",
    f"with {_RANK} select dataset, model, round(case when finite then sum(pos * (below + neg / 2e0)) / (p * nn) end, 6) as roc_auc from c join g using (dataset, model) group by dataset, model, finite, p, nn",
)
def me8(spark, sf):
    return _rounded(me.ranking_metrics(scores(spark, sf), ["dataset", "model"], "y", "score").drop("average_precision"), "roc_auc")


@query(
    "me9_average_precision",
    f"with {_RANK} select dataset, model, round(case when finite then sum(pos * tp / (tp + fp)) / p end, 6) as average_precision from c join g using (dataset, model) group by dataset, model, finite, p",
)
def me9(spark, sf):
    return _rounded(me.ranking_metrics(scores(spark, sf), ["dataset", "model"], "y", "score").drop("roc_auc"), "average_precision")


_VALID = f"{_P}, v as (select * from probs where status = 'ok' and probabilities is not null)"


@query(
    "me10_brier",
    f"""with {_VALID} select dataset, seed, model, round(avg(pow(probabilities[1] - cast(label = 0 as integer), 2) + pow(probabilities[2] - cast(label = 1 as integer), 2) + pow(probabilities[3] - cast(label = 2 as integer), 2)), 6) as brier from v group by 1, 2, 3""",
)
def me10(spark, sf):
    return _rounded(me.probability_metrics(predictions(spark, sf), KEYS).select(*KEYS, "brier"), "brier")


@query("me11_log_loss", f"with {_VALID} select dataset, seed, model, round(avg(-ln(least(greatest(probabilities[label + 1], 1e-15), 1e0))), 6) as log_loss from v group by 1, 2, 3")
def me11(spark, sf):
    return _rounded(me.probability_metrics(predictions(spark, sf), KEYS).select(*KEYS, "log_loss"), "log_loss")


@query(
    "me12_calibration_error",
    f"""with {_VALID}, t as (select dataset, seed, model, label, list_max(probabilities) as conf, list_position(probabilities, list_max(probabilities)) - 1 as guess from v),
      b as (select dataset, seed, model, (select count(*) from range(1, 10) e(i) where conf >= i * 1e-1) as bin, guess, label, conf from t),
      s as (select dataset, seed, model, bin, count(*) as n, avg(case when guess = label then 1e0 else 0e0 end) as acc, avg(conf) as mc from b group by 1, 2, 3, 4)
      select dataset, seed, model, round(sum(n * abs(acc - mc)) / sum(n), 6) as ece from s group by 1, 2, 3""",
)
def me12(spark, sf):
    return _rounded(me.calibration_error(predictions(spark, sf), KEYS), "ece")


@query(
    "me13_status_counts",
    f"""with {_P} select dataset, seed, model, count(*) filter (status = 'ok') as ok, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'invalid') as invalid,
        count(*) filter (status = 'unsupported') as unsupported, cast(0 as bigint) as other from preds group by 1, 2, 3""",
)
def me13(spark, sf):
    return me.status_counts(predictions(spark, sf), KEYS)


@query(
    "me14_probability_coverage",
    f"with {_P} select dataset, seed, model, count(*) filter (status = 'ok' and top is not null) as probability_rows, round(count(*) filter (status = 'ok' and top is not null) / count(*), 6) as probability_coverage from preds group by 1, 2, 3",
)
def me14(spark, sf):
    return _rounded(me.probability_metrics(predictions(spark, sf), KEYS).drop("brier", "log_loss"), "probability_coverage")


_TIMED = "not cache_hit and status <> 'unsupported'"


@query(
    "me15_latency_quantiles",
    f"""with {_P} select dataset, seed, model, count(*) filter ({_TIMED}) as uncached_timing_rows, round(quantile_cont(latency_ms, 5e-1) filter ({_TIMED}), 6) as latency_p50_ms,
        round(quantile_cont(latency_ms, 95e-2) filter ({_TIMED}), 6) as latency_p95_ms from preds group by 1, 2, 3""",
)
def me15(spark, sf):
    return _rounded(me.latency_quantiles(predictions(spark, sf), KEYS), "latency_p50_ms", "latency_p95_ms")


@query("me16_cache_hits", f"with {_P} select dataset, seed, model, count(*) filter (cache_hit) as cache_hits, count(*) filter (status <> 'ok') as not_ok_rows from preds group by 1, 2, 3")
def me16(spark, sf):
    return me.cache_hits(predictions(spark, sf), KEYS)


_PAIRS = f"{pairs_sql()}, po as (select dataset0, seed, model, pair_id, family, composition, bool_and(status = 'ok' and prediction = label) as both_correct, count(*) as members, case when min(label) = max(label) then 'preserve' else 'flip' end as observed_relation from (select *, 'pairs' as dataset0 from pair_preds) group by all)"
_PKEYS = ["seed", "model"]


def _pairs(spark, sf):
    return me.pair_outcomes(pair_predictions(spark, sf), _PKEYS)


@query("me17_pair_outcomes", f"with {_PAIRS} select seed, model, pair_id, family, composition, observed_relation, both_correct, case when members <> 2 then 'pair is not two rows' end as problem from po")
def me17a(spark, sf):
    return _pairs(spark, sf)


@query("me17_both_members_correct", f"with {_PAIRS} select seed, model, count(*) as n_pairs, round(avg(case when both_correct then 1e0 else 0e0 end), 6) as both_members_correct from po group by 1, 2")
def me17(spark, sf):
    return _rounded(me.pair_metrics(_pairs(spark, sf), _PKEYS), "both_members_correct")


@query(
    "me18_pair_breakdown",
    f"with {_PAIRS} select seed, model, family, composition, count(*) as n_pairs, round(avg(case when both_correct then 1e0 else 0e0 end), 6) as both_members_correct from po group by grouping sets ((seed, model, family, composition), (seed, model, family), (seed, model))",
)
def me18(spark, sf):
    return _rounded(me.pair_breakdown(_pairs(spark, sf), _PKEYS), "both_members_correct")


@query("me19_validity", f"with {_P} select dataset, seed, model, count(*) as n, count(*) filter (label not in (0, 1, 2)) as unknown_class, cast(0 as bigint) as bad_distribution from preds group by 1, 2, 3")
def me19(spark, sf):
    return me.require_valid(predictions(spark, sf), KEYS, CLASSES)


@query(
    "me20_throughput",
    f"with {LEDGER_SQL}, t as (select event_type, count(*) as n, date_diff('microsecond', min(ts), max(ts)) // 1000000 as seconds from ledger group by 1) select event_type, n, seconds, round(n / seconds, 6) as rows_per_second from t",
)
def me20(spark, sf):
    return _rounded(me.throughput(ledger(spark, sf), ["event_type"], "ts"), "rows_per_second")


_CURVE = f"""{_P}, part as (select *, case when supp % 2 = 0 then 'policy' else 'test' end as partition from preds),
  tot as (select dataset, model, partition, count(*) as total from part group by 1, 2, 3),
  h as (select dataset, model, partition, top as cutoff, count(*) as n, count(*) filter (prediction <> label) as e from part where top is not null group by 1, 2, 3, 4),
  cv as (select h.*, total, sum(n) over w as kept, sum(e) over w as errors from h join tot using (dataset, model, partition) window w as (partition by dataset, model, partition order by cutoff desc)),
  curve as (select dataset, model, partition, cutoff, kept / total as coverage, errors / kept as error from cv)"""
_CKEYS = ["dataset", "model", "partition"]


def _curve(spark, sf):
    p = predictions(spark, sf).withColumn("partition", F.expr("case when supp % 2 = 0 then 'policy' else 'test' end"))
    return me.coverage_curve(p, _CKEYS, "top", F.col("prediction") != F.col("label"))


@query(
    "me21_error_at_coverage",
    f"with {_CURVE} select dataset, model, partition, round(max(cutoff), 6) as cutoff, round(min(coverage), 6) as coverage, round(arg_max(error, cutoff), 6) as error from curve where coverage >= 3e-1 group by 1, 2, 3",
)
def me21a(spark, sf):
    return _rounded(me.error_at_coverage(_curve(spark, sf), _CKEYS, 0.3), "cutoff", "coverage", "error")


@query(
    "me21_coverage_at_error",
    f"""with {_CURVE}, ch as (select dataset, model, min(cutoff) as chosen from curve where partition = 'policy' and error <= 3e-1 group by 1, 2)
        select dataset, model, round(chosen, 6) as chosen, round(arg_min(coverage, cutoff), 6) as coverage, round(arg_min(error, cutoff), 6) as error
        from curve join ch using (dataset, model) where partition = 'test' and cutoff >= chosen group by dataset, model, chosen""",
)
def me21b(spark, sf):
    curve = _curve(spark, sf)
    split = lambda p: curve.where(F.col("partition") == p).drop("partition")
    return _rounded(me.coverage_at_error(split("policy"), split("test"), ["dataset", "model"], 0.3), "chosen", "coverage", "error")
