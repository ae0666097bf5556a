"""Sampling and splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import split as sp
from .bindings import CASES_SQL, TEXTS_SQL, cases, pair_predictions, pairs_sql, table, texts
from .catalog import query


def _quota(name: str, counts: str, total: str, minimum: int, by: str = "dataset") -> str:
    """CTEs: largest-remainder quota ``name_q(by, label, n, quota)`` of ``total`` over ``counts``."""
    return f"""{name}_b as (select {by}, label, n, least({total}, sum(n) over (partition by {by})) as k, sum(n) over (partition by {by}) as nn from {counts} where n > 0),
    {name}_f as (select *, greatest({minimum}, (n * k) // nn) as fl, n * k - greatest({minimum}, (n * k) // nn) * nn as over from {name}_b),
    {name}_u as (select *, fl + case when row_number() over (partition by {by} order by over desc, label) <= k - sum(fl) over (partition by {by}) then 1 else 0 end as up from {name}_f),
    {name}_r as (select {by}, label, j, row_number() over (partition by {by} order by -over + j * nn, label) as pos, excess from (
        select {by}, label, over, nn, unnest(range(0, cast(greatest(0, least(fl - {minimum}, excess)) as bigint))) as j, excess
        from (select *, cast(sum(fl) over (partition by {by}) - k as bigint) as excess from {name}_f))),
    {name}_d as (select {by}, label, count(*) as down from {name}_r where pos <= excess group by 1, 2),
    {name}_q as (select u.{by}, u.label, u.n, cast(u.up - coalesce(d.down, 0) as bigint) as quota from {name}_u u left join {name}_d d on d.{by} = u.{by} and d.label = u.label)"""


def _counts(name: str, source: str, by: str = "dataset") -> str:
    return f"{name} as (select {by}, label, count(*) as n from {source} group by 1, 2)"


def _shrink(name: str, quota: str, by: str = "dataset") -> str:
    return f"{name} as (select {by}, label, n - quota as n from {quota})"


def _ranked(source: str, seed: int, key: str = "case_id", name: str = "ranked") -> str:
    return f"{name} as (select *, row_number() over (partition by dataset, label order by sha256('{seed}|' || {key})) as rn from {source})"


_SHARE = "cast(ceil(round({0} * sum(n) over (partition by dataset), 9)) as bigint)"

# Three parts: policy 20 %, validation 25 % of the rest, train the remainder, each capped.
_THREE = ", ".join(
    [
        _counts("c0", "pool"), _quota("a", "c0", _SHARE.format("2e-1"), 0), _shrink("c1", "a_q"),
        _quota("b", "c1", _SHARE.format("25e-2"), 0), _shrink("c2", "b_q"),
    ]
)


@query(
    "sp1_stratified_split",
    f"with {CASES_SQL}, pool as (select dataset, case_id, label from cases), {_counts('c0', 'pool')}, {_quota('t', 'c0', _SHARE.format('2e-1'), 0)}, {_ranked('pool', 11)} "
    "select dataset, case_id, label, case when rn <= quota then 'test' else 'train' end as partition from ranked join t_q using (dataset, label)",
)
def sp1(spark, sf):
    c = cases(spark, sf).select("dataset", "case_id", "label")
    return sp.stratified_split(c, "case_id", "label", 11, [("test", 0.2)], groups=["dataset"])


_SKEW = "case when u < 950 then 0 when u < 980 then 1 when u < 995 then 2 else 3 end"


@query(
    "sp2_stratified_cap",
    f"with {CASES_SQL}, pool as (select dataset, case_id, {_SKEW} as label from cases), {_counts('c0', 'pool')}, {_quota('t', 'c0', '60', 1)}, {_ranked('pool', 12)} "
    "select dataset, case_id, label from ranked join t_q using (dataset, label) where rn <= quota",
)
def sp2(spark, sf):
    c = cases(spark, sf).select("dataset", "case_id", F.expr(_SKEW).alias("label"))
    return sp.stratified_cap(c, "case_id", "label", 60, 12, groups=["dataset"])


@query("sp3_official_boundary", f"with {TEXTS_SQL} select doc_id, label, official as partition from texts")
def sp3(spark, sf):
    return texts(spark, sf).select("doc_id", "label", F.col("official").alias("partition"))


@query(
    "sp4_three_way_split",
    f"""with {CASES_SQL}, pool as (select dataset, case_id, label from cases), {_counts('c0', 'pool')},
    {_quota('t', 'c0', _SHARE.format('2e-1'), 0)}, {_shrink('c1', 't_q')}, {_quota('v', 'c1', _SHARE.format('2e-1'), 0)}, {_shrink('c2', 'v_q')},
    {_quota('rc', 'c2', '8000', 1)}, {_ranked('pool', 13)}
    select r.dataset, r.case_id, r.label, case when rn <= t_q.quota then 'test' when rn <= t_q.quota + v_q.quota then 'validation' else 'train' end as partition
    from ranked r join t_q using (dataset, label) join v_q using (dataset, label) join rc_q using (dataset, label)
    where rn <= t_q.quota + v_q.quota + rc_q.quota""",
)
def sp4(spark, sf):
    c = cases(spark, sf).select("dataset", "case_id", "label")
    return sp.stratified_split(c, "case_id", "label", 13, [("test", 0.2), ("validation", 0.2)], groups=["dataset"], caps={"train": 8000})


_PILOT = f"""pool as (select 'all' as dataset, case_id, label from cases), {_counts('c0', 'pool')}, {_quota('p', 'c0', _SHARE.format('2e-1'), 0)}, {_ranked('pool', 14, name='pilot')},
  excluded as (select case_id from pilot join p_q using (dataset, label) where rn <= quota),
  allowed as (select * from pool where case_id not in (select case_id from excluded)), {_counts('d0', 'allowed')},
  {_quota('h', 'd0', 'cast(ceil(round(2e-1 * (select count(*) from pool), 9)) as bigint)', 1)}, {_ranked('allowed', 15, name='hold')},
  held as (select case_id, label from hold join h_q using (dataset, label) where rn <= quota)"""


@query("sp5_shared_holdout", f"with {CASES_SQL}, {_PILOT} select case_id, label from held")
def sp5(spark, sf):
    return _holdout(spark, sf)[1].select("case_id", "label")


def _holdout(spark, sf):
    c = cases(spark, sf).select("case_id", "label")
    pilot = sp.stratified_split(c, "case_id", "label", 14, [("test", 0.2)]).where("partition = 'test'")
    return sp.shared_holdout(c, "case_id", "label", 15, excluded=pilot)


@query(
    "sp6_development_split",
    f"""with {CASES_SQL}, pool as (select dataset, case_id, label from cases where supp % 5 <> 0), {_THREE},
    {_quota('cc', 'c2', '9000', 1)}, {_ranked('pool', 2027)}
    select r.dataset, r.case_id, r.label, case when rn <= a_q.quota then 'policy' when rn <= a_q.quota + b_q.quota then 'validation' else 'train' end as partition
    from ranked r join a_q using (dataset, label) join b_q using (dataset, label) join cc_q using (dataset, label)
    where rn <= a_q.quota + b_q.quota + cc_q.quota""",
)
def sp6(spark, sf):
    pool = cases(spark, sf).where("supp % 5 <> 0").select("dataset", "case_id", "label")
    return sp.stratified_split(pool, "case_id", "label", 2027, [("policy", 0.2), ("validation", 0.25)], groups=["dataset"], caps={"train": 9000})


@query(
    "sp7_group_split",
    f"""with {pairs_sql()}, p as (select pair_id, case_id, cast('0x' || substr(sha256('16|' || cast(pair_id as varchar)), 1, 13) as ubigint) % 100 as slot from pair_preds where model = 'alpha')
        select pair_id, case_id, case when slot < 60 then 'train' when slot < 80 then 'policy' else 'test' end as partition from p""",
)
def sp7(spark, sf):
    pairs = pair_predictions(spark, sf).where("model = 'alpha'").select("pair_id", "case_id")
    return sp.group_split(pairs, "pair_id", 16, [("train", 60), ("policy", 20), ("test", 20)])


@query(
    "sp8_class_exemplars",
    f"""with {CASES_SQL}, r as (select dataset, label, case_id, row_number() over (partition by dataset, label order by sha256('17|' || case_id), case_id) as exemplar from cases where supp % 5 > 1)
        select dataset, label, case_id, exemplar from r where exemplar <= 3""",
)
def sp8(spark, sf):
    train = cases(spark, sf).where("supp % 5 > 1").select("dataset", "label", "case_id")
    return sp.exemplars(train, "case_id", "label", 3, 17, groups=["dataset"])


@query(
    "sp9_review_sample",
    "select * from (select o_orderpriority, o_orderstatus, o_orderkey, row_number() over (partition by o_orderpriority, o_orderstatus order by o_orderkey) as review_rank from orders) where review_rank <= 2",
)
def sp9(spark, sf):
    o = table(spark, sf, "orders").select("o_orderpriority", "o_orderstatus", "o_orderkey")
    return sp.first_rows(o, ["o_orderpriority", "o_orderstatus"], ["o_orderkey"], 2)


_SPLIT = "case supp % 5 when 0 then 'test' when 1 then 'policy' when 2 then 'validation' else 'train' end"


@query("sp10_split_manifest", f"with {CASES_SQL} select dataset, {_SPLIT} as partition, label, count(*) as n from cases group by all")
def sp10(spark, sf):
    return sp.manifest(cases(spark, sf).withColumn("partition", F.expr(_SPLIT)), ["dataset"])


@query(
    "sp10_split_overview",
    f"""with {CASES_SQL}, p as (select dataset, {_SPLIT} as partition from cases)
        select dataset, count(*) filter (partition = 'train') as train, count(*) filter (partition = 'validation') as validation,
          count(*) filter (partition = 'policy') as policy, count(*) filter (partition = 'test') as test from p group by 1""",
)
def sp10b(spark, sf):
    c = cases(spark, sf).withColumn("partition", F.expr(_SPLIT))
    return c.groupBy("dataset").pivot("partition", ["train", "validation", "policy", "test"]).agg(F.count(F.lit(1)))


@query(
    "sp11_missing_classes",
    "select c_nationkey as dataset, cast(c_custkey % 7 as varchar) as partition, count(distinct c_mktsegment) as classes from customer group by 1, 2 having count(distinct c_mktsegment) < 5",
)
def sp11(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("dataset"), (F.col("c_custkey") % 7).cast("string").alias("partition"), F.col("c_mktsegment").alias("label")
    )
    return sp.missing_classes(c, ["dataset"], "label", 5)


@query("sp12_leading_cases", "select o_orderkey, o_orderdate from orders order by o_orderkey limit 50")
def sp12(spark, sf):
    return sp.leading_cases(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey", 50)
