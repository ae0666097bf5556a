"""The whole path on labelled texts: clean, split, score, choose a threshold, evaluate."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import digest
from ..functions.numeric import r6
from ..functions.text import normalise
from ..operators import decide as de, dedup, metrics as me, split as sp
from ..session import checkpointed
from .bindings import TEXTS_SQL, texts
from .catalog import query
from .splits import _SHARE, _counts, _quota, _ranked

_QS = "[" + ", ".join(f"{i}e-2" for i in range(101)) + "]"

_SQL = f"""with {TEXTS_SQL}, nrm as (select doc_id, replace(text, '<br />', ' ') as text, label, official from texts),
  keyed as (select *, sha256(text) as case_id from nrm), ok as (select case_id from keyed group by 1 having count(distinct label) = 1),
  snap as (select * from (select *, row_number() over (partition by case_id order by official, doc_id) as r from keyed where case_id in (select case_id from ok)) where r = 1),
  pool0 as (select 'all' as dataset, case_id, label, length(text) / 4e3 as score from snap),
  {_counts('c0', 'pool0')}, {_quota('h', 'c0', _SHARE.format('2e-1'), 1)}, {_ranked('pool0', 51, name='hold')},
  test as (select case_id, label, score from hold join h_q using (dataset, label) where rn <= quota),
  pool as (select * from pool0 where case_id not in (select case_id from test)),
  {_counts('d0', 'pool')}, {_quota('a', 'd0', _SHARE.format('2e-1'), 0)}, {_ranked('pool', 52)}, pol as (select case_id, label, score from ranked join a_q using (dataset, label) where rn <= quota),
  cand as (select distinct t from (select unnest(quantile_cont(score, {_QS})) as t from pol union all select 5e-1 union all select max(score) * (1 + 2.220446049250313e-16) from pol)),
  val as (select t, (count(*) filter (label = 1 and score >= t) / count(*) filter (label = 1) + count(*) filter (label = 0 and score < t) / count(*) filter (label = 0)) / 2 as ba from cand, pol group by 1),
  thr as (select t from val order by ba desc, abs(t - 5e-1), t limit 1),
  pan as (select 'raw' as panel, label, cast(score >= 5e-1 as integer) as p from test union all select 'adjusted', label, cast(score >= t as integer) from test, thr)
  select panel, count(*) as n, round((avg(p) filter (label = 1) + 1 - avg(p) filter (label = 0)) / 2, 6) as balanced_accuracy from pan group by 1"""


@query("flagship_text_length", _SQL)
def flagship(spark, sf):
    raw = texts(spark, sf).select("doc_id", normalise(F.col("text")).alias("text"), "label", "official")
    snapshot = dedup.clean_snapshot(raw.withColumn("case_id", digest("text")), "case_id", "label", ["official", "doc_id"])
    # The snapshot is what every later stage reads; its lineage ends here.
    cases = checkpointed(snapshot.select("case_id", "label", (F.length("text") / F.lit(4000.0)).alias("score")))
    pool, test = sp.shared_holdout(cases, "case_id", "label", 51)
    parts = sp.stratified_split(pool, "case_id", "label", 52, [("policy", 0.2), ("validation", 0.25)])
    policy = parts.where("partition = 'policy'").withColumn("task", F.lit("quality"))
    thresholds = de.choose_threshold(policy, ["task"], "label", "score", 0.5)
    scored = test.withColumn("task", F.lit("quality")).withColumn("raw", (F.col("score") >= 0.5).cast("int"))
    long = de.panels(de.apply_threshold(scored, ["task"], "score", "raw", thresholds))
    conf = me.confusion(long, ["panel"])
    both = me.accuracy(conf, ["panel"]).select("panel", "n").join(me.balanced_accuracy_present(me.class_table(conf, ["panel"], 2), ["panel"]), "panel")
    return both.withColumn("balanced_accuracy", r6(F.col("balanced_accuracy")))
