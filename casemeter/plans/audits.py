"""Fingerprints, split verification, recomputation and merging."""

from __future__ import annotations

from functools import reduce

import pyspark
from pyspark.sql import DataFrame, functions as F

from ..functions.keys import digest
from ..operators import audit as au, joins, metrics as me
from .bindings import CASES_SQL, cases, predictions, predictions_sql, table
from .catalog import query

_REC = """sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}')"""


_WORD_SUMS = " || ':' || ".join(f"sum(cast('0x' || substr(d, {at}, {n}) as ubigint))" for at, n in au._WORDS)


def _tree_sql(p, records):
    """{p}l2, {p}l1, {p}l0 (bucket, rows, digest): leaves, parents, root over the record digests ``d`` of ``records``."""
    up = lambda n: f"cast(sum(rows) as bigint) as rows, sha256(string_agg(bucket || ':' || digest, chr(10) order by bucket || ':' || digest)) as digest from {p}l{n}"
    return f"""{p}d as ({records}), {p}l2 as (select substr(d, 1, 2) as bucket, count(*) as rows, sha256(substr(d, 1, 2) || ':' || count(*) || ':' || {_WORD_SUMS}) as digest from {p}d group by 1),
        {p}l1 as (select substr(bucket, 1, 1) as bucket, {up(2)} group by 1), {p}l0 as (select '' as bucket, {up(1)})"""


_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus"]


@query("in1_fingerprint", f"with {_tree_sql('t', f'select {_REC} as d from orders')} select rows, digest as fingerprint from tl0")
def in1(spark, sf):
    return au.fingerprint(table(spark, sf, "orders").select(*_ORDERS))


@query("in1_hash_tree", f"with {_tree_sql('t', f'select {_REC} as d from orders')} select 2 as level, * from tl2 union all select 1, * from tl1 union all select 0, * from tl0")
def in1b(spark, sf):
    return au.hash_tree(table(spark, sf, "orders").select(*_ORDERS))


_OTHER = _REC.replace("o_orderstatus ||", "(case when o_orderkey % 1024 = 3 then 'X' else o_orderstatus end) ||")


@query(
    "in1_located_difference",
    f"""with a as (select {_REC} as d from orders), b as (select {_OTHER} as d from orders), u as (select d, 1 as s from a union all select d, -1 from b), x as (select d from u group by 1 having sum(s) <> 0),
        n as (select substr(d, 1, 2) as bucket, 1 as x, 0 as y from a union all select substr(d, 1, 2), 0, 1 from b)
        select bucket, cast(sum(x) as bigint) as rows_a, cast(sum(y) as bigint) as rows_b from n where bucket in (select substr(d, 1, 2) from x) group by 1""",
)
def in1c(spark, sf):
    """Two copies of the orders that differ in a few rows, compared from the root down."""
    o = table(spark, sf, "orders").select(*_ORDERS)
    other = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 1024 == 3, "X").otherwise(F.col("o_orderstatus")))
    return au.tree_difference(au.hash_tree(o), au.hash_tree(other))


@query(
    "in2_run_mixture",
    f"""with {predictions_sql()}, r as (select dataset, model, line, sha256('{{"config":"' || case when supp = 7 and line = 2 then 'late' else 'frozen' end || '","source":"s1"}}') as run_id from preds)
        select dataset, model, line, min(run_id) as lo, max(run_id) as hi from r group by 1, 2, 3 having min(run_id) <> max(run_id)""",
)
def in2(spark, sf):
    config = F.when((F.col("supp") == 7) & (F.col("line") == 2), "late").otherwise("frozen")
    p = predictions(spark, sf).withColumn("run_id", au.run_identity(config, F.lit("s1")))
    return au.run_mixture(p, ["dataset", "model", "line"])


@query(
    "in3_freeze_difference",
    f"""with a as (select {_REC} as d from orders), b as (select {_REC.replace("o_orderstatus ||", "(case when o_orderkey % 100 = 3 then 'X' else o_orderstatus end) ||")} as d from orders where o_orderkey % 500 <> 0),
        u as (select d, 1 as s from a union all select d, -1 from b) select d as row_digest, cast(sum(s) as bigint) as excess from u group by 1 having sum(s) <> 0""",
)
def in3(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    changed = F.when(F.col("o_orderkey") % 100 == 3, "X").otherwise(F.col("o_orderstatus"))
    return au.table_difference(o, o.where("o_orderkey % 500 <> 0").withColumn("o_orderstatus", changed), o.columns)


_TAMPER = f"""{CASES_SQL}, base as (select case_id, case when supp % 5 = 0 then 'test' else 'train' end as partition, pair_key, part, u from cases),
  spl as (select * from base union all select case_id, 'train', pair_key, part, u from base where partition = 'test' and u = 5 union all select * from base where u = 6),
  marked as (select case when u = 9 then 'x' || substr(case_id, 2) else case_id end as case_id, case_id as true_id, partition, pair_key as pair_id, case when (partition = 'test') <> (part % 41 = 3 and u = 11) then 'test' else 'train' end as official from spl)"""


@query(
    "in4_split_verification",
    f"""with {_TAMPER},
      pc as (select case_id, count(*) as n, min(partition) as lo, max(partition) as hi from marked group by 1),
      pp as (select pair_id, count(*) as n, min(partition) as lo, max(partition) as hi from marked group by 1)
      select 'duplicate row' as rule, case_id as key, cast(n as varchar) as detail from pc where n > 1 and lo = hi
      union all select 'overlapping partitions', case_id, lo || '/' || hi from pc where lo <> hi
      union all select 'case id changed', case_id, true_id from marked where true_id <> case_id
      union all select 'incomplete pair', cast(pair_id as varchar), cast(n as varchar) from pp where n <> 2
      union all select 'pair crosses partitions', cast(pair_id as varchar), lo || '/' || hi from pp where lo <> hi
      union all select 'official boundary crossed', case_id, official from marked where official <> partition""",
)
def in4(spark, sf):
    base = cases(spark, sf).select("case_id", F.when(F.col("supp") % 5 == 0, "test").otherwise("train").alias("partition"), "pair_key", "part", "u")
    again = base.where("partition = 'test' and u = 5").withColumn("partition", F.lit("train"))
    spl = base.unionByName(again).unionByName(base.where("u = 6"))
    crossed = (F.col("part") % 41 == 3) & (F.col("u") == 11)
    marked = spl.select(
        F.when(F.col("u") == 9, F.concat(F.lit("x"), F.substring("case_id", 2, 63))).otherwise(F.col("case_id")).alias("case_id"),
        F.col("case_id").alias("true_id"),
        "partition",
        F.col("pair_key").alias("pair_id"),
        F.when((F.col("partition") == "test") != crossed, "test").otherwise("train").alias("official"),
    )
    return au.split_violations(marked, pair_id="pair_id", official="official", recomputed_id=F.col("true_id"))


@query(
    "in5_summary_recomputation",
    f"""with {predictions_sql()}, rc as (select dataset, seed, model, count(*) as n, avg(case when prediction = label then 1e0 else 0e0 end) as accuracy from preds group by 1, 2, 3)
        select dataset, seed, model, 'accuracy' as measure, round(accuracy + 25e-2, 6) as stored, round(accuracy, 6) as recomputed from rc where model = 'beta'
        union all select dataset, seed, model, 'accuracy', null, round(accuracy, 6) from rc where model = 'gamma' and dataset = 'F'
        union all select dataset, seed, model, 'n', null, n from rc where model = 'gamma' and dataset = 'F'""",
)
def in5(spark, sf):
    keys = ["dataset", "seed", "model"]
    recomputed = me.accuracy(me.confusion(predictions(spark, sf), keys), keys)
    edited = F.when(F.col("model") == "beta", F.col("accuracy") + 0.25).otherwise(F.col("accuracy"))
    stored = recomputed.withColumn("accuracy", edited).where("not (model = 'gamma' and dataset = 'F')")
    found = au.summary_mismatches(stored, recomputed, keys, ["n", "accuracy"])
    return found.withColumns({c: F.round(c, 6) for c in ("stored", "recomputed")})


@query(
    "in6_incomplete_jobs",
    f"""with {predictions_sql()}, f as (select dataset, model, line, count(*) as expected from preds group by 1, 2, 3), g as (select dataset, model, line, count(*) as found from preds where not (model = 'beta' and line = 3 and u < 400) and not (model = 'alpha' and line = 5) group by 1, 2, 3)
        select f.dataset, f.model, f.line, expected, coalesce(found, 0) as found from f left join g on f.dataset = g.dataset and f.model = g.model and f.line = g.line where expected <> coalesce(found, 0)""",
)
def in6(spark, sf):
    p = predictions(spark, sf)
    kept = p.where("not (model = 'beta' and line = 3 and u < 400) and not (model = 'alpha' and line = 5)")
    return au.incomplete_jobs(kept, p, ["dataset", "model", "line"])


_ART = """art as (select 'data/' || o_custkey || '/' || o_orderpriority as path, sha256(o_orderstatus) as checksum, 'run' || cast(o_orderkey % 3 as varchar) as source from orders)"""


def _artefacts(spark, sf):
    return table(spark, sf, "orders").select(
        F.concat_ws("/", F.lit("data"), F.col("o_custkey").cast("string"), "o_orderpriority").alias("path"),
        digest("o_orderstatus").alias("checksum"),
        F.concat(F.lit("run"), (F.col("o_orderkey") % 3).cast("string")).alias("source"),
    )


@query("in7_merge_conflicts", f"with {_ART} select path, count(*) as copies, string_agg(distinct source, ',' order by source) as sources from art group by 1 having count(distinct checksum) > 1")
def in7(spark, sf):
    return au.merge_conflicts(_artefacts(spark, sf))


@query("in7_merge_runs", f"with {_ART}, good as (select path from art group by 1 having count(distinct checksum) = 1) select path, min(checksum) as checksum, min(source) as source from art where path in (select path from good) group by 1")
def in7b(spark, sf):
    art = _artefacts(spark, sf)
    sound = joins.exclude(art, au.merge_conflicts(art), "path")
    return au.merge_runs(sound)


_RUNS = """run as (select r.range as r, case when r.range = 2 then 'late' else 'main' end as study from range(4) r),
  rec as (select r, study, 'orders-' || o_orderstatus as dataset, sha256(string_agg(o_orderkey || ':' || (case when r = 3 and o_orderkey % 4096 = 7 then 'X' else o_orderpriority end), ',' order by o_orderkey)) as fingerprint
    from orders, run where not (r = 1 and o_orderstatus = 'P') group by 1, 2, o_orderstatus)"""


@query(
    "in7_merge_guard",
    f"""with {_RUNS}, own as (select dataset, study, fingerprint from rec where r = 0), g as (select run.r, run.study as s, own.* from run cross join own where run.r > 0),
        j as (select g.r, g.dataset, case when rec.fingerprint is null then 'dataset is missing' when rec.study <> g.study then 'another study' when rec.fingerprint <> g.fingerprint then 'another inventory' end as rule
          from g left join rec on rec.r = g.r and rec.dataset = g.dataset)
        select 'run' || r as source, rule, dataset as detail from j where rule is not null""",
)
def in7c(spark, sf):
    """Four runs over the orders by status: one lacks a dataset, one is of another study, one saw a changed row."""
    orders = table(spark, sf, "orders")
    parts = []
    for r in range(4):
        seen = orders.select("o_orderkey", F.when((F.col("o_orderkey") % 4096 == 7) & F.lit(r == 3), "X").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"), "o_orderstatus")
        seen = seen.where("o_orderstatus <> 'P'") if r == 1 else seen
        digests = seen.select("o_orderstatus", au.row_digest(seen).alias("d")).groupBy("o_orderstatus").agg(
            F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *[F.sum(F.conv(F.substring("d", at, n), 16, 10).cast("decimal(38,0)")).cast("string") for at, n in au._WORDS]), 256).alias("fingerprint")
        )
        parts.append(digests.select(F.lit(f"run{r}").alias("source"), F.lit("late" if r == 2 else "main").alias("study"), F.concat(F.lit("orders-"), "o_orderstatus").alias("dataset"), "fingerprint"))
    return au.study_conflicts(reduce(DataFrame.unionByName, parts))


@query(
    "in9_provenance",
    f"""with {_tree_sql('t', f'select {_REC} as d from orders')} select o_orderkey, o_custkey, o_orderstatus, sha256('{{"config":"frozen","source":"' || digest || '"}}') as run_id,
        '{pyspark.__version__}' as spark_version, digest as source_orders from orders, tl0""",
)
def in9(spark, sf):
    """Every row with the run it came from, the version that read it and the fingerprint of its table."""
    orders = table(spark, sf, "orders").select(*_ORDERS)
    found = au.fingerprint(orders).first()["fingerprint"]
    run = spark.range(1).select(au.run_identity(F.lit("frozen"), F.lit(found))).first()[0]
    return au.with_provenance(orders, run, {"orders": found})


@query(
    "j5_snapshot_match",
    f"""with {predictions_sql()}, p as (select case_id, case when u = 17 then 9 else label end as label, dataset from preds where model = 'alpha' and u <> 18 union all select 'zz' || substr(case_id, 3), label, dataset from preds where model = 'alpha' and u = 19),
        s as (select case_id, label, dataset from cases)
        select coalesce(p.case_id, s.case_id) as case_id, case when p.case_id is null then 'missing prediction' when s.case_id is null then 'unknown case' else 'changed: label' end as problem
        from p full join s on p.case_id = s.case_id where p.case_id is null or s.case_id is null or p.label <> s.label""",
)
def j5(spark, sf):
    snap = cases(spark, sf).select("case_id", "label", "dataset", "u")
    alpha = predictions(spark, sf).where("model = 'alpha'").select("case_id", "label", "dataset", "u")
    edited = alpha.where("u <> 18").withColumn("label", F.when(F.col("u") == 17, 9).otherwise(F.col("label")))
    extra = alpha.where("u = 19").withColumn("case_id", F.concat(F.lit("zz"), F.substring("case_id", 3, 62)))
    return au.snapshot_mismatches(edited.unionByName(extra), snap, ["case_id"], ["label", "dataset"])


