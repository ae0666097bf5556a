"""Deduplication, set operations and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import digest
from ..operators import dedup, joins, requests as rq, split as sp
from .bindings import CASES_SQL, TEXTS_SQL, cases, predictions, predictions_sql, table, texts
from .catalog import query

_KEYED_SQL = "keyed as (select doc_id, text, source, cast(regexp_extract(source, '([0-9]+)', 1) as integer) % 2 as label, case when lang = 'en' then 'test' else 'train' end as official, sha256(text) as k from documents)"


def keyed_documents(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", "text", "source",
        (F.regexp_extract("source", "([0-9]+)", 1).cast("int") % 2).alias("label"),
        F.when(F.col("lang") == "en", "test").otherwise("train").alias("official"),
        digest("text").alias("k"),
    )


@query(
    "dd1_conflict_removal",
    f"with {_KEYED_SQL}, bad as (select k from keyed group by k having count(distinct label) > 1) select doc_id, label from keyed where k not in (select k from bad)",
)
def dd1(spark, sf):
    return dedup.drop_conflicts(keyed_documents(spark, sf), "k", "label").select("doc_id", "label")


@query(
    "dd2_priority_dedup",
    f"with {_KEYED_SQL}, r as (select *, row_number() over (partition by k order by official, doc_id) as rn from keyed) select doc_id, text, official from r where rn = 1",
)
def dd2(spark, sf):
    return dedup.first_by_priority(keyed_documents(spark, sf), "k", ["official", "doc_id"]).select("doc_id", "text", "official")


@query(
    "dd3_duplicate_inputs",
    "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1",
)
def dd3(spark, sf):
    return dedup.duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("dd4_distinct_values", f"with {predictions_sql()} select dataset, model, string_agg(distinct status, ',' order by status) as statuses, count(distinct label) as classes from preds group by 1, 2")
def dd4(spark, sf):
    p = predictions(spark, sf)
    return p.groupBy("dataset", "model").agg(
        F.array_join(F.array_sort(F.collect_set("status")), ",").alias("statuses"), F.size(F.collect_set("label")).cast("bigint").alias("classes")
    )


@query("se1_union_all", "select item_id as id, text, 'benchmark' as origin from benchmark union all select doc_id, text, 'documents' from documents")
def se1(spark, sf):
    a = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text", F.lit("benchmark").alias("origin"))
    b = table(spark, sf, "documents").select("text", F.col("doc_id").alias("id"), F.lit("documents").alias("origin"))
    return a.unionByName(b)


@query("se2_pool_minus_test", f"with {CASES_SQL} select case_id from cases except select case_id from cases where supp % 5 = 0")
def se2(spark, sf):
    c = cases(spark, sf)
    return joins.exclude(c.select("case_id"), c.where("supp % 5 = 0"), "case_id")


@query(
    "se3_partition_overlap",
    f"""with {CASES_SQL}, parts as (select case_id, 'train' as p from cases where u < 500 union all select case_id, 'test' from cases where u >= 498)
        select case_id, 'test' as first_partition, 'train' as last_partition from parts group by 1 having count(distinct p) > 1""",
)
def se3(spark, sf):
    c = cases(spark, sf).select("case_id", "u")
    parts = c.where("u < 500").withColumn("p", F.lit("train")).unionByName(c.where("u >= 498").withColumn("p", F.lit("test")))
    return dedup.overlaps(parts, "case_id", "p")


@query(
    "se4_set_equality",
    """with a as (select distinct l_partkey as k from lineitem where l_discount < 0.02), b as (select distinct l_partkey as k from lineitem where l_tax < 0.02)
       select coalesce(a.k, b.k) as k, case when b.k is null then 'left' else 'right' end as only_in from a full join b on a.k = b.k where a.k is null or b.k is null""",
)
def se4(spark, sf):
    line = table(spark, sf, "lineitem")
    a = line.where("l_discount < 0.02").select(F.col("l_partkey").alias("k"))
    b = line.where("l_tax < 0.02").select(F.col("l_partkey").alias("k"))
    return dedup.one_sided(a, b, ["k"])


@query(
    "j1_exact_offsets",
    """with h as (select user_id, date_trunc('hour', ts) as hour, count(*) as cnt from events group by 1, 2)
       select n.user_id, n.hour, n.cnt as cnt_now, p.cnt as cnt_lag_1, t.cnt as cnt_target
       from h n join h p on p.user_id = n.user_id and p.hour = n.hour - interval 1 hour join h t on t.user_id = n.user_id and t.hour = n.hour + interval 1 hour""",
)
def j1(spark, sf):
    h = table(spark, sf, "events").groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count(F.lit(1)).alias("cnt"))
    return joins.exact_offsets(h, "hour", {"now": ["cnt"], "lag_1": ["cnt"], "target": ["cnt"]}, {"lag_1": -1, "target": 1}, keys=["user_id"])


@query("j2_exclude_ids", f"with {TEXTS_SQL} select doc_id from documents where doc_id not in (select doc_id from texts)")
def j2(spark, sf):
    return joins.exclude(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("j3_keep_members", f"with {TEXTS_SQL} select doc_id, lang from documents where doc_id in (select doc_id from texts where official = 'test')")
def j3(spark, sf):
    return joins.keep_members(table(spark, sf, "documents").select("doc_id", "lang"), texts(spark, sf).where("official = 'test'"), ["doc_id"])


_J4 = f"""{predictions_sql()}, pr as (select a.dataset, a.case_id, a.label, b.model as comparator, cast(a.prediction = a.label as integer) as correct_a, cast(b.prediction = b.label as integer) as correct_b
  from preds a join preds b on a.dataset = b.dataset and a.case_id = b.case_id and a.label = b.label where a.model = 'alpha' and b.model <> 'alpha')"""


def _j4(df):
    fields = {"label": F.col("label"), "correct": (F.col("prediction") == F.col("label")).cast("int")}
    return joins.paired(df, ["dataset", "seed"], "case_id", "model", "alpha", ["beta", "gamma"], fields)


@query("j4_paired_models", f"with {_J4} select dataset, case_id, comparator, label, correct_a, correct_b from pr")
def j4(spark, sf):
    """Every case of both models, side by side; a case that one of them lacks would be an error."""
    pairs = joins.require_paired(_j4(predictions(spark, sf)))
    return pairs.select("dataset", "case_id", "comparator", F.col("label_a").alias("label"), "correct_a", "correct_b")


@query(
    "j4_unpaired_cases",
    f"""with {predictions_sql()}, k as (select dataset, case_id, model, case when model = 'gamma' and u % 97 = 5 then label + 1 else label end as label from preds where not (model = 'beta' and u % 89 = 3)),
        g as (select p.dataset, p.case_id, c.comparator, count(*) filter (model = 'alpha') as n_a, count(*) filter (model = c.comparator) as n_b, max(p.label) filter (model = 'alpha') as x, max(p.label) filter (model = c.comparator) as y
          from k p, (values ('beta'), ('gamma')) c(comparator) group by 1, 2, 3)
        select dataset, case_id, comparator, n_a, n_b from g where n_a <> 1 or n_b <> 1 or x <> y""",
)
def j4u(spark, sf):
    """Cases that a model lacks or labels otherwise, after some were taken away."""
    p = predictions(spark, sf).where("not (model = 'beta' and u % 89 = 3)")
    p = p.withColumn("label", F.when((F.col("model") == "gamma") & (F.col("u") % 97 == 5), F.col("label") + 1).otherwise(F.col("label")))
    return joins.unpaired(_j4(p), ["dataset"], "case_id")


_RESUME_SQL = "reqs as (select event_id, sha256(event_type || '|' || cast(user_id as varchar)) as request_hash, ts from events), answers as (select request_hash, count(*) as answered_times from reqs where ts < timestamp '2024-01-02' group by 1)"


def _resume(spark, sf):
    e = table(spark, sf, "events")
    reqs = e.select("event_id", F.sha2(F.concat_ws("|", "event_type", F.col("user_id").cast("string")), 256).alias("request_hash"), "ts")
    answers = reqs.where(F.col("ts") < F.lit("2024-01-02").cast("timestamp_ntz")).groupBy("request_hash").agg(F.count(F.lit(1)).alias("answered_times"))
    return joins.resume(reqs, answers, "request_hash")


@query("j6_resume_answered", f"with {_RESUME_SQL} select event_id, answered_times, answered_times is not null as cache_hit from reqs left join answers using (request_hash)")
def j6a(spark, sf):
    return _resume(spark, sf)[0].select("event_id", "answered_times", "cache_hit")


@query("j6_resume_pending", f"with {_RESUME_SQL} select distinct request_hash from reqs where request_hash not in (select request_hash from answers)")
def j6b(spark, sf):
    return _resume(spark, sf)[1]


@query(
    "j7_dictionary_lookup",
    "select c_custkey, n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey",
)
def j7(spark, sf):
    places = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    places = places.select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    return joins.lookup(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), places, "c_nationkey").drop("c_nationkey")


@query(
    "j8_few_shot_requests",
    f"""with {TEXTS_SQL}, ranked as (select doc_id, label, row_number() over (partition by label order by sha256('5|' || cast(doc_id as varchar)), doc_id) as r from texts where official = 'train'),
        shots as (select string_agg(cast(label as varchar) || ':' || cast(doc_id as varchar), ',' order by label, r) as shots from ranked where r <= 2)
        select doc_id, shots from texts, shots where official = 'test'""",
)
def j8(spark, sf):
    t = texts(spark, sf)
    shots = sp.exemplars(t.where("official = 'train'"), "doc_id", "label", 2, 5)
    out = rq.with_exemplars(t.where("official = 'test'"), shots, ["label", "exemplar", "doc_id"])
    shown = F.array_join(F.transform("shots", lambda x: F.concat_ws(":", x["label"].cast("string"), x["doc_id"].cast("string"))), ",")
    return out.select("doc_id", shown.alias("shots"))


