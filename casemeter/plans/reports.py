"""Report tables over the score table by dataset, seed and model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..operators import decide as de, metrics as me, report as rp
from ..sources.panels import panel_gaps
from .bindings import SCORES_SQL, SEEDS, predictions, predictions_sql, scores
from .catalog import query

MODELS = ["alpha", "beta", "gamma", "delta"]
_DS = "dataset || '-' || cast(supp % 4 as varchar)"
_GAP = "not (model = 'gamma' and dataset = 'O' and supp % 4 = 1 and seed = 2029) and not (model = 'beta' and dataset = 'F' and supp % 4 = 2)"
_SC = f"""{predictions_sql(SEEDS)}, part8 as (select *, {_DS} as ds from preds where {_GAP}),
  sc as (select ds as dataset, seed, model, avg(case when prediction = label then 1e0 else 0e0 end) as accuracy from part8 group by 1, 2, 3),
  smr as (select dataset, model, avg(100 * accuracy) as mean, coalesce(stddev_samp(100 * accuracy), 0) as sd, count(*) as n from sc group by 1, 2)"""
KEYS = ["dataset", "seed", "model"]


def _facts(spark, sf):
    named = F.concat_ws("-", "dataset", (F.col("supp") % 4).cast("string"))
    return predictions(spark, sf, SEEDS).where(_GAP).withColumn("dataset", named)


def score_table(spark, sf):
    return me.accuracy(me.confusion(_facts(spark, sf), KEYS), KEYS).select(*KEYS, "accuracy")


def _summary(spark, sf):
    return rp.seed_summary(score_table(spark, sf), ["dataset", "model"], "accuracy")


def _means(spark, sf):
    return _summary(spark, sf).where(F.col("n") == 3).select("dataset", "model", F.round("mean", 1).alias("score"))


@query(
    "rp1_long_scores",
    f"""with {_SC}, rec as (select ds as dataset, seed, model, label, avg(case when prediction = label then 1e0 else 0e0 end) as r from part8 group by 1, 2, 3, 4)
        select dataset, seed, model, 'accuracy' as measure, round(accuracy, 6) as value from sc
        union all select dataset, seed, model, 'balanced_accuracy', round(avg(r), 6) from rec group by 1, 2, 3""",
)
def rp1(spark, sf):
    conf = me.confusion(_facts(spark, sf), KEYS)
    wide = me.accuracy(conf, KEYS).join(me.balanced_accuracy_present(me.class_table(conf, KEYS, 3), KEYS), KEYS)
    return rp.long_scores(wide, KEYS, ["accuracy", "balanced_accuracy"]).withColumn("value", r6(F.col("value")))


@query("rp2_seed_summary", f"with {_SC} select dataset, model, round(mean, 6) as mean, round(sd, 6) as sd, n from smr")
def rp2(spark, sf):
    return _summary(spark, sf).withColumns({"mean": r6(F.col("mean")), "sd": r6(F.col("sd"))})


_CELL = "printf('%.1f', mean) || ' ± ' || printf('%.1f', sd) || ' (n=' || n || ')'"
_PANEL = f"{_SC}, txt as (select dataset, model, {_CELL} || case when n = 3 then '' else ' INCOMPLETE' end as t from smr)"
_PIVOT = ", ".join(f"coalesce(max(t) filter (model = '{m}'), 'pending') as {m}" for m in MODELS)


@query("rp3_score_panel", f"with {_PANEL} select dataset, {_PIVOT} from txt group by 1")
def rp3(spark, sf):
    return rp.panel(_summary(spark, sf), "dataset", "model", MODELS, 3)


@query("rp4_cell_text", f"with {_SC} select dataset, model, {_CELL} as display from smr")
def rp4(spark, sf):
    return _summary(spark, sf).select("dataset", "model", rp.cell(F.col("mean"), F.col("sd"), F.col("n")).alias("display"))


@query(
    "rp5_average_rank",
    f"""with {_SC}, m as (select dataset, model, avg(accuracy) as v, count(distinct seed) as s from sc group by 1, 2),
        c as (select * from m where dataset in (select dataset from m group by 1 having count(*) filter (s = 3) = 3)),
        r as (select dataset, model, rank() over (partition by dataset order by v desc) + (count(*) over (partition by dataset, v) - 1) / 2 as rk from c)
        select model, round(avg(rk), 6) as average_rank, count(*) as datasets from r group by 1""",
)
def rp5(spark, sf):
    return rp.average_rank(score_table(spark, sf), "dataset", "model", "seed", "accuracy", 3, 3).withColumn("average_rank", r6(F.col("average_rank")))


_BEST = f"""{_SC}, ms as (select dataset, model, round(mean, 1) as score from smr where n = 3),
  mx as (select dataset, max(score) as best from ms where model in ('alpha', 'beta') group by 1),
  bc as (select mx.dataset, best, string_agg(model, ', ' order by model) as best_models from mx join ms on ms.dataset = mx.dataset and score = best and model in ('alpha', 'beta') group by 1, 2),
  ld as (select ms.dataset, best_models, score - best as lead from ms join bc on bc.dataset = ms.dataset where model = 'gamma')"""


@query("rp6_best_comparators", f"with {_BEST} select * from bc")
def rp6(spark, sf):
    return rp.best_comparators(_means(spark, sf), "dataset", "model", "score", ["alpha", "beta"])


@query("rp7_leads", f"with {_BEST} select dataset, best_models, round(lead, 6) as lead, lead > 0 as wins from ld")
def rp7(spark, sf):
    return rp.leads(_means(spark, sf), "dataset", "model", "score", "gamma", ["alpha", "beta"]).withColumn("lead", r6(F.col("lead")))


@query("rp7_largest_lead", f"with {_BEST} select dataset, best_models, round(lead, 6) as lead, true as wins from ld where lead > 0 order by ld.lead desc, dataset limit 1")
def rp7b(spark, sf):
    table = rp.leads(_means(spark, sf), "dataset", "model", "score", "gamma", ["alpha", "beta"])
    return rp.largest_lead(table, "dataset").withColumn("lead", r6(F.col("lead")))


@query(
    "rp8_filtered_scores",
    f"with {_SC} select dataset, model, round(mean, 6) as mean from smr where dataset like 'F-%' and model <> 'beta'",
)
def rp8(spark, sf):
    kept = _summary(spark, sf).where(F.col("dataset").startswith("F-") & (F.col("model") != "beta"))
    return kept.select("dataset", "model", r6(F.col("mean")).alias("mean"))


_BACKEND = "case when supp % 2 = 0 then 'cpu' else 'gpu' end"
_REASON = "case when supp % 2 = 0 and part % 7 = 0 then 'no device' when supp % 2 = 0 then 'small input' end"
_PARTS = "case when part % 5 = 0 then 'policy' else 'test' end"


@query(
    "rp9_run_diagnostics",
    f"""with {predictions_sql()}, p as (select *, {_PARTS} as partition, {_BACKEND} as backend, {_REASON} as reason, model || '-v' || cast(line % 2 as varchar) as resolved from preds),
        t as (select dataset, seed, model, line, count(*) filter (status = 'failed' and supp % 3 = 0) as bad from preds group by 1, 2, 3, 4),
        f as (select dataset, seed, model, count(*) as trials, count(*) filter (bad > 0) as failed_trials from t group by 1, 2, 3),
        s as (select dataset, seed, model, case when bool_or(top is null) then 'not tuned: policy scores missing; raw choices retained' when min(label % 2) = max(label % 2) then 'not tuned: one class only' else 'tuned' end as threshold_status
          from p where partition = 'policy' and not (model = 'gamma' and top is null) group by 1, 2, 3)
        select dataset, seed, model, string_agg(distinct backend, ', ' order by backend) as backends, coalesce(string_agg(distinct reason, ', ' order by reason), '') as backend_reasons, string_agg(distinct resolved, ', ' order by resolved) as resolved_models,
        count(*) filter (partition = 'test' and status <> 'ok') as failed_test_rows, count(*) filter (partition = 'policy' and status <> 'ok') as failed_policy_rows, cast(sum(attempts - 1) as bigint) as retries, trials, failed_trials, threshold_status
        from p join f using (dataset, seed, model) join s using (dataset, seed, model) group by dataset, seed, model, trials, failed_trials, threshold_status""",
)
def rp9(spark, sf):
    p = predictions(spark, sf).withColumns(
        {
            "partition": F.expr(_PARTS), "backend": F.expr(_BACKEND), "backend_reason": F.expr(_REASON),
            "resolved_model": F.concat("model", F.lit("-v"), (F.col("line") % 2).cast("string")),
        }
    )
    bad = F.count_if((F.col("status") == "failed") & (F.col("supp") % 3 == 0))
    trials = p.groupBy(*KEYS, "line").agg(F.when(bad > 0, "failed").alias("error"))
    policy = p.where("partition = 'policy'").select(*KEYS, (F.col("label") % 2).alias("y"), F.array_max("probabilities").alias("score")).where("not (model = 'gamma' and score is null)")
    return rp.diagnostics(p, KEYS, trials, de.threshold_status(policy, KEYS, "y", "score"))


_FLAT = f"""{predictions_sql()}, b as (select dataset, seed, model, count(*) as n, round(avg(case when prediction = label then 1e0 else 0e0 end), 6) as accuracy, count(*) filter (status = 'ok') as ok,
  count(*) filter (status = 'failed') as failed, count(*) filter (status = 'invalid') as invalid, count(*) filter (status = 'unsupported') as unsupported,
  round(avg(case when top is not null then pow((case when label = prediction then 1e0 - top else -top end), 2) + case when label = prediction then pow((1 - top) / 2, 2) * 2 else pow(1 - (1 - top) / 2, 2) + pow((1 - top) / 2, 2) end end), 6) as brier
  from preds group by 1, 2, 3)"""


@query("rp10_flat_summary", f"with {_FLAT} select * from b")
def rp10(spark, sf):
    out = me.summarise(predictions(spark, sf), KEYS, 3, latency=False)
    return out.select(*KEYS, "n", r6(F.col("accuracy")).alias("accuracy"), "ok", "failed", "invalid", "unsupported", r6(F.col("brier")).alias("brier"))


@query(
    "rp11_planned_calls",
    f"""with {SCORES_SQL}, c as (select dataset, count(distinct y) as classes, count(*) filter (partition = 'test') as t, count(*) filter (partition = 'policy') as p from scores where model = 'alpha' group by 1)
        select dataset, cast((t + case when classes = 2 then p else 0 end) * 2 as bigint) as planned_calls, cast((t + case when classes = 2 then p else 0 end) * 6 as bigint) as attempt_ceiling from c""",
)
def rp11(spark, sf):
    s = scores(spark, sf).where("model = 'alpha'")
    counts = s.groupBy("dataset").agg(
        F.count_distinct("y").alias("classes"),
        F.count_if(F.col("partition") == "test").alias("test_rows"),
        F.count_if(F.col("partition") == "policy").alias("policy_rows"),
    )
    return rp.planned_calls(counts, "dataset", modes=2, retries=2)


@query(
    "rp12_median_of_percentiles",
    f"""with {predictions_sql()}, j as (select dataset, supp % 4 as job, model, quantile_cont(latency_ms, 5e-1) as p50 from preds where not cache_hit and status <> 'unsupported' group by 1, 2, 3)
        select model, round(median(p50), 6) as median_p50_ms from j group by 1""",
)
def rp12(spark, sf):
    p = predictions(spark, sf).withColumn("job", F.col("supp") % 4)
    per_job = me.latency_quantiles(p, ["dataset", "job", "model"], [0.5])
    # One number per job: bounded, so the built-in median is enough.
    return per_job.groupBy("model").agg(r6(F.median("latency_p50_ms")).alias("median_p50_ms"))


@query("rp13_prediction_export", f"with {predictions_sql()} select dataset, seed, model, case_id, label as actual, prediction as predicted from preds")
def rp13(spark, sf):
    return rp.prediction_export(predictions(spark, sf))


@query(
    "in8_panel_gaps",
    f"""with {_PANEL}, grid as (select d.dataset, m.model from (select distinct dataset from smr) d, (values ('alpha'), ('beta'), ('gamma'), ('delta')) m(model))
        select g.dataset, g.model, case when t is null then 'pending' else 'INCOMPLETE' end as problem from grid g left join txt on txt.dataset = g.dataset and txt.model = g.model where t is null or t like '% INCOMPLETE'""",
)
def in8(spark, sf):
    wide = rp.panel(_summary(spark, sf), "dataset", "model", MODELS, 3)
    return panel_gaps(wide, "dataset", MODELS, 3)


