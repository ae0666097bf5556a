"""Paired comparisons with bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..operators import episodes as ep, joins, stats as st
from .bindings import SEEDS, STEPS_SQL, pair_predictions, pairs_sql, predictions, predictions_sql, steps
from .catalog import query
from .decisions import _TUNE, applied
from ..operators import decide as de

REFERENCE, COMPARATORS = "gamma", ["alpha", "beta"]


def _fields(label="label"):
    return {"label": F.col(label), "correct": st.correctness(label=label)}


def _diffs(df, scope, label="label"):
    """Pairs with their difference; a case that one side lacks is an error."""
    pairs = joins.paired(df, scope, "case_id", "model", REFERENCE, COMPARATORS, _fields(label))
    whole = joins.require_paired(pairs).withColumnRenamed("label_a", "label")
    return st.paired_difference(whole)


def _diff_sql(source, scope, label="label", extra=""):
    on = " and ".join(f"a.{c} = b.{c}" for c in scope)
    cols = ", ".join(f"a.{c}" for c in scope)
    return f"""dif as (select {cols}, a.case_id, a.{label} as label, b.model as comparator{extra},
      (case when a.prediction = a.{label} then 1e0 else 0e0 end) - (case when b.prediction = b.{label} then 1e0 else 0e0 end) as difference
      from {source} a join {source} b on {on} and a.case_id = b.case_id and a.{label} = b.{label} where a.model = 'gamma' and b.model <> 'gamma')"""


_RAW = f"{predictions_sql()}, {_diff_sql('preds', ['dataset', 'seed'])}"
_PANELS = f"""{_TUNE}, pan as (select dataset, model, case_id, 'raw' as panel, y, raw as prediction from app union all select dataset, model, case_id, 'adjusted', y, adjusted from app),
  {_diff_sql('pan', ['dataset', 'panel'], 'y')}"""


@query("st1_paired_difference", f"with {_PANELS} select dataset, panel, comparator, cast(difference as bigint) as difference, count(*) as n from dif group by 1, 2, 3, 4")
def st1(spark, sf):
    d = _diffs(de.panels(applied(spark, sf)), ["dataset", "panel"], "y")
    return d.groupBy("dataset", "panel", "comparator", F.col("difference").cast("bigint").alias("difference")).agg(F.count(F.lit(1)).alias("n"))


_SEEDED = f"""{predictions_sql(SEEDS)}, {_diff_sql('preds', ['dataset', 'seed'])},
  avgd as (select dataset, comparator, case_id, min(label) as label, avg(difference) as difference from dif group by 1, 2, 3 having count(*) = 3 and min(label) = max(label))"""


@query("st2_seed_average", f"with {_SEEDED} select dataset, comparator, label, round(difference, 6) as difference, count(*) as n from avgd group by 1, 2, 3, 4")
def st2(spark, sf):
    d = _diffs(predictions(spark, sf, SEEDS, by_case=True), ["dataset", "seed"])
    mean = st.seed_average(d, ["dataset", "comparator", "case_id"], len(SEEDS))
    return mean.groupBy("dataset", "comparator", "label", r6(F.col("difference")).alias("difference")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "st3_balanced_difference",
    f"with {_RAW}, pc as (select dataset, comparator, label, avg(difference) as m, count(*) as n from dif group by 1, 2, 3) select dataset, comparator, round(100 * avg(m), 6) as difference_pp, cast(sum(n) as bigint) as cases from pc group by 1, 2",
)
def st3(spark, sf):
    d = st.balanced_difference(_diffs(predictions(spark, sf), ["dataset", "seed"]), ["dataset", "comparator"])
    return d.withColumn("difference_pp", r6(F.col("difference_pp")))


def _boot_sql(source, scope, stratum, value, replicates, seed):
    """Poisson weights from digests: exact steps of the distribution up to ten cases of a value, its expansion above."""
    keys = ", ".join([*scope, stratum])
    parts = ", ".join(f"cast({c} as varchar)" for c in [*scope, stratum])
    group = ", ".join(scope)
    steps = "[" + ", ".join("[" + ", ".join(f"{x:.17e}" for x in st.poisson_steps(c)) + "]" for c in range(1, st.EXACT_COUNTS + 1)) + "]"
    return f"""val as (select {keys}, cast(round({value} / {st.GRID:e}) as bigint) as k, avg({value}) as v, count(*) as c from {source} group by all),
      dig as (select {keys}, v, c, b, sha256(concat_ws('|', '{seed}', {parts}, cast(k as varchar), cast(b as varchar))) as h from val, range(0, {-(-replicates // 4)}) bb(b)),
      drw as (select {keys}, v, c, b * 4 + d + 1 as r, (cast('0x' || substr(h, cast(d * 13 + 1 as bigint), 13) as bigint) + 5e-1) / 4503599627370496e0 as u from dig, range(0, 4) dd(d) where b * 4 + d + 1 <= {replicates}),
      nor as (select *, {st.normal_sql("u")} as z from drw),
      wei as (select *, case when c <= {st.EXACT_COUNTS} then cast(len(list_filter(({steps})[c], lambda x: x <= u)) as double) else {st.large_count_sql("c", "z")} end as w from nor),
      mea as (select {keys}, r, case when sum(w) > 0 then sum(w * v) / sum(w) else sum(c * v) / sum(c) end as m from wei group by {keys}, r),
      rep as (select {group}, r, avg(m) as statistic from mea group by {group}, r),
      itv as (select {group}, quantile_cont(statistic, 25e-3) as low, quantile_cont(statistic, 975e-3) as high from rep group by {group})"""


_PAIRED = f"{pairs_sql()}, pp as (select seed, model, case_id, pair_id, ts, label, prediction from pair_preds), {_diff_sql('pp', ['seed'], extra=', a.pair_id, a.ts')}"


def _pair_diffs(spark, sf):
    p = pair_predictions(spark, sf)
    pairs = joins.paired(p, ["seed", "pair_id", "ts"], "case_id", "model", REFERENCE, COMPARATORS, _fields())
    return st.paired_difference(joins.require_paired(pairs).withColumnRenamed("label_a", "label"))


@query(
    "st4_stratified_bootstrap",
    f"""with {_PAIRED}, {_boot_sql('dif', ['comparator'], 'label', 'difference', 1000, 31)}, pc as (select comparator, label, avg(difference) as m, count(*) as n from dif group by 1, 2)
        select comparator, round(100 * avg(m), 6) as difference_pp, cast(sum(n) as bigint) as cases, round(100 * low, 6) as lower_95_pp, round(100 * high, 6) as upper_95_pp from pc join itv using (comparator) group by comparator, low, high""",
)
def st4(spark, sf):
    out = st.stratified_interval(_pair_diffs(spark, sf), ["comparator"], 1000, 31)
    return out.withColumns({c: r6(F.col(c)) for c in ("difference_pp", "lower_95_pp", "upper_95_pp")})


@query(
    "st4_stratified_bootstrap_all_cases",
    f"""with {_SEEDED}, {_boot_sql('avgd', ['dataset', 'comparator'], 'label', 'difference', 1000, 31)}, pc as (select dataset, comparator, label, avg(difference) as m, count(*) as n from avgd group by 1, 2, 3)
        select dataset, comparator, round(100 * avg(m), 6) as difference_pp, cast(sum(n) as bigint) as cases, round(100 * low, 6) as lower_95_pp, round(100 * high, 6) as upper_95_pp
        from pc join itv using (dataset, comparator) group by dataset, comparator, low, high""",
)
def st4b(spark, sf):
    """Every order line, all seeds averaged; the cost does not grow with the cases."""
    d = _diffs(predictions(spark, sf, SEEDS, by_case=True), ["dataset", "seed"])
    mean = st.seed_average(d, ["dataset", "comparator", "case_id"], len(SEEDS))
    out = st.stratified_interval(mean, ["dataset", "comparator"], 1000, 31)
    return out.withColumns({c: r6(F.col(c)) for c in ("difference_pp", "lower_95_pp", "upper_95_pp")})


def _clusters(spark, sf):
    return st.cluster_means(_pair_diffs(spark, sf), ["comparator"], F.to_date("ts"))


_CLUSTER = f"{_PAIRED}, clu as (select comparator, cast(cast(ts as date) as varchar) as cluster, avg(difference) as value, 'all' as _all from dif group by 1, 2)"


@query(
    "st5_cluster_bootstrap",
    f"""with {_CLUSTER}, {_boot_sql('clu', ['comparator'], '_all', 'value', 4000, 32)}
        select comparator, round(avg(value), 6) as estimate, count(*) as clusters, round(low, 6) as low, round(high, 6) as high from clu join itv using (comparator) group by comparator, low, high""",
)
def st5(spark, sf):
    out = st.cluster_interval(_clusters(spark, sf), ["comparator"], 4000, 32)
    return out.withColumns({c: r6(F.col(c)) for c in ("estimate", "low", "high")})


@query(
    "st6_resampling_unit",
    f"""with {predictions_sql()}, two as (select l_orderkey as pair_key from lineitem group by 1 having count(*) = 2), u as (
        select coalesce(cast(two.pair_key as varchar), case when p.dataset = 'F' then strftime(p.ts, '%Y-%m-%d') end, p.case_id) as unit from preds p left join two using (pair_key) where model = 'alpha')
        select count(distinct unit) as units, count(*) as cases from u""",
)
def st6(spark, sf):
    p = predictions(spark, sf).where("model = 'alpha'")
    whole = p.groupBy("pair_key").agg(F.count(F.lit(1)).alias("_n")).where("_n = 2").select("pair_key", F.col("pair_key").alias("pair_id"))
    marked = p.join(whole, "pair_key", "left").withColumn("day", F.when(F.col("dataset") == "F", F.to_date("ts")))
    units = marked.groupBy(st.resampling_unit("pair_id", "day", "case_id").alias("unit")).agg(F.count(F.lit(1)).alias("cases"))
    return units.agg(F.count(F.lit(1)).alias("units"), F.sum("cases").alias("cases"))


_EP = f"""{STEPS_SQL}, eo as (select condition, model, episode_id, min(correct_terminal) as correct_terminal, coalesce(arg_max(action, step) filter (action in ('refund', 'deny', 'escalate')), 'escalate') as terminal, count(*) as steps from steps group by 1, 2, 3),
  outc as (select *, terminal = correct_terminal as success, (case when terminal = correct_terminal then 1e0 when terminal in ('refund', 'deny') then -2e0 else -25e-2 end) - 5e-2 * (steps - 1) as net_utility from eo),
  edif as (select b.model as comparator, b.measure, a.episode_id, a.value - b.value as value, 'all' as _all from
    (select model, episode_id, unnest(['success', 'utility']) as measure, unnest([case when success then 1e0 else 0e0 end, net_utility]) as value from outc) a
    join (select model, episode_id, unnest(['success', 'utility']) as measure, unnest([case when success then 1e0 else 0e0 end, net_utility]) as value from outc) b
    on a.episode_id = b.episode_id and a.measure = b.measure where a.model = 'gamma' and b.model <> 'gamma')"""


@query(
    "st7_episode_intervals",
    f"""with {_EP}, {_boot_sql('edif', ['comparator', 'measure'], '_all', 'value', 4000, 33)}
        select comparator, measure, round(avg(value), 6) + 0e0 as estimate, count(*) as clusters, round(low, 6) + 0e0 as low, round(high, 6) + 0e0 as high from edif join itv using (comparator, measure) group by comparator, measure, low, high""",
)
def st7(spark, sf):
    outcomes = ep.outcomes(steps(spark, sf), ["condition", "model", "episode_id"], "correct_terminal")
    long = ep.episode_differences(outcomes, ["condition"], "gamma", COMPARATORS)
    out = st.cluster_interval(long, ["comparator", "measure"], 4000, 33)
    return out.withColumns({c: r6(F.col(c)) for c in ("estimate", "low", "high")})


@query("st8_all_comparators", f"with {_RAW} select dataset, seed, comparator, round(avg(difference), 6) + 0e0 as accuracy_difference, count(*) as cases from dif group by 1, 2, 3")
def st8(spark, sf):
    d = _diffs(predictions(spark, sf), ["dataset", "seed"])
    return d.groupBy("dataset", "seed", "comparator").agg(r6(F.avg("difference")).alias("accuracy_difference"), F.count(F.lit(1)).alias("cases"))


@query("st9_empty_interval", f"with {_RAW} select count(*) as clusters, avg(difference) as estimate, quantile_cont(difference, 25e-3) as low, quantile_cont(difference, 975e-3) as high from dif where difference > 1")
def st9(spark, sf):
    d = _diffs(predictions(spark, sf), ["dataset", "seed"]).where("difference > 1")
    none = st.bootstrap_replicates(d.withColumn("_all", F.lit("all")), [], "_all", "difference", 1000, 34)
    low_high = st.interval(none, [])
    sizes = d.agg(F.count(F.lit(1)).alias("clusters"), F.avg("difference").alias("estimate"))
    return sizes.withColumns({"low": low_high.select("low").scalar(), "high": low_high.select("high").scalar()})


@query(
    "st10_holm",
    f"""with {_CLUSTER}, {_boot_sql('clu', ['comparator'], '_all', 'value', 4000, 32)},
        pv as (select comparator, least(1e0, 2e0 * (1 + least(count(*) filter (statistic <= 0), count(*) filter (statistic >= 0))) / (1 + count(*))) as p_value from rep group by 1),
        sc as (select *, p_value * (count(*) over () - row_number() over (order by p_value, comparator) + 1) as s from pv)
        select comparator, round(p_value, 6) as p_value, round(least(1e0, max(s) over (order by p_value, comparator)), 6) as p_holm from sc""",
)
def st10(spark, sf):
    one = _clusters(spark, sf).withColumn("_all", F.lit("all"))
    p = st.bootstrap_p(st.bootstrap_replicates(one, ["comparator"], "_all", "value", 4000, 32), ["comparator"])
    return st.holm(p, [], ["comparator"]).select("comparator", r6(F.col("p_value")).alias("p_value"), r6(F.col("p_holm")).alias("p_holm"))


