"""Threshold choice on the policy partition, applied to the test partition."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..operators import decide as de, metrics as me
from .bindings import SCORES_SQL, scores
from .catalog import query

KEYS = ["dataset", "model"]
_QS = "[" + ", ".join(f"{i}e-2" for i in range(101)) + "]"

_TUNE = f"""{SCORES_SQL}, pol as (select * from scores where partition = 'policy'),
  st as (select dataset, model, case when bool_or(score is null) then 'not tuned: policy scores missing; raw choices retained' when min(y) = max(y) then 'not tuned: one class only' else 'tuned' end as threshold_status from pol group by 1, 2),
  use as (select p.* from pol p join st using (dataset, model) where threshold_status = 'tuned'),
  cand as (select distinct dataset, model, t from (
    select dataset, model, unnest(quantile_cont(score, {_QS})) as t from use group by 1, 2
    union all select distinct dataset, model, 5e-1 from use
    union all select dataset, model, case when max(score) = 0 then 1e-300 else max(score) + abs(max(score)) * 2.220446049250313e-16 end from use group by 1, 2)),
  hist as (select dataset, model, score, count(*) filter (y = 1) as pos, count(*) filter (y = 0) as neg from use group by 1, 2, 3),
  val as (select c.dataset, c.model, t, (sum(case when score >= t then pos else 0 end) / sum(pos) + sum(case when score < t then neg else 0 end) / sum(neg)) / 2 as ba
          from cand c join hist h on h.dataset = c.dataset and h.model = c.model group by 1, 2, 3),
  thr as (select * from (select *, row_number() over (partition by dataset, model order by ba desc, abs(t - 5e-1), t) as r, count(*) over (partition by dataset, model) as grid_size from val) where r = 1),
  app as (select s.dataset, s.model, s.case_id, s.y, s.raw, s.score, case when s.score is not null and thr.t is not null then cast(s.score >= thr.t as integer) else s.raw end as adjusted
          from scores s left join thr on thr.dataset = s.dataset and thr.model = s.model where s.partition = 'test')"""


def _policy(spark, sf):
    return scores(spark, sf).where("partition = 'policy'")


def _thresholds(spark, sf):
    return de.choose_threshold(_policy(spark, sf), KEYS, "y", "score", 0.5)


def applied(spark, sf):
    return de.apply_threshold(scores(spark, sf).where("partition = 'test'"), KEYS, "score", "raw", _thresholds(spark, sf))


@query("de1_threshold_selection", f"with {_TUNE} select dataset, model, round(t, 6) as threshold, round(ba, 6) as selection_balanced_accuracy, grid_size from thr")
def de1(spark, sf):
    t = _thresholds(spark, sf)
    return t.withColumns({c: r6(F.col(c)) for c in ("threshold", "selection_balanced_accuracy")})


@query("de2_apply_threshold", f"with {_TUNE} select dataset, model, case_id, raw, adjusted from app")
def de2(spark, sf):
    return applied(spark, sf).select(*KEYS, "case_id", "raw", "adjusted")


@query("de3_threshold_status", f"with {_TUNE} select * from st")
def de3(spark, sf):
    return de.threshold_status(_policy(spark, sf), KEYS, "y", "score")


@query(
    "de4_decision_panels",
    f"""with {_TUNE}, pan as (select dataset, model, 'raw' as panel, y, raw as prediction from app union all select dataset, model, 'adjusted', y, adjusted from app)
        select dataset, model, panel, round((avg(case when prediction = 1 then 1e0 else 0e0 end) filter (y = 1) + avg(case when prediction = 0 then 1e0 else 0e0 end) filter (y = 0)) / 2, 6) as balanced_accuracy from pan group by 1, 2, 3""",
)
def de4(spark, sf):
    keys = [*KEYS, "panel"]
    long = de.panels(applied(spark, sf))
    table = me.class_table(me.confusion(long, keys, label="y"), keys, 2)
    return me.balanced_accuracy_present(table, keys).withColumn("balanced_accuracy", r6(F.col("balanced_accuracy")))


_GRID = [round(0.05 * i, 2) for i in range(1, 20)]


@query(
    "de5_grid_diagnostic",
    f"""with {SCORES_SQL}, h as (select dataset, model, score, count(*) filter (y = 1) as pos, count(*) filter (y = 0) as neg from scores where partition = 'validation' and score is not null group by 1, 2, 3),
        v as (select dataset, model, t, (sum(case when score >= t then pos else 0 end) / sum(pos) + sum(case when score < t then neg else 0 end) / sum(neg)) / 2 as ba
              from h, (select unnest([{', '.join(f'{g}::double' for g in _GRID)}]) as t) group by 1, 2, 3),
        b as (select * from (select *, row_number() over (partition by dataset, model order by ba desc, t) as r from v) where r = 1)
        select s.dataset, s.model, round(b.t, 6) as threshold, round(ba, 6) as validation_balanced_accuracy, count(*) filter (y = 1 and score >= t) as tp, count(*) filter (y = 1 and score < t) as fn,
          count(*) filter (y = 0 and score < t) as tn, count(*) filter (y = 0 and score >= t) as fp
        from scores s join b on b.dataset = s.dataset and b.model = s.model where partition = 'test' and score is not null group by 1, 2, 3, 4""",
)
def de5(spark, sf):
    s = scores(spark, sf).where("score is not null")
    validation, test = s.where("partition = 'validation'"), s.where("partition = 'test'")
    values = de.grid_scores(de.score_counts(validation, KEYS, "y", "score"), KEYS, de.fixed_grid(validation, KEYS, _GRID))
    best = de.best_grid_point(values, KEYS)
    decided = de.apply_threshold(test, KEYS, "score", "raw", best)
    counts = decided.groupBy(*KEYS).agg(
        F.count_if(F.expr("y = 1 and adjusted = 1")).alias("tp"), F.count_if(F.expr("y = 1 and adjusted = 0")).alias("fn"),
        F.count_if(F.expr("y = 0 and adjusted = 0")).alias("tn"), F.count_if(F.expr("y = 0 and adjusted = 1")).alias("fp"),
    )
    shown = best.select(*KEYS, r6(F.col("threshold")).alias("threshold"), r6(F.col("balanced_accuracy")).alias("validation_balanced_accuracy"))
    return shown.join(counts, KEYS)
