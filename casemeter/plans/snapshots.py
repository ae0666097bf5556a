"""Snapshot preparation: reading, cleaning, typing, keys, requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import canonical_json, input_key
from ..functions.numeric import r6
from ..functions.text import normalise
from ..operators import clean, requests as rq
from ..operators.table_features import medians
from ..sources.panels import check_panel, panel_cells
from .bindings import TEXTS_SQL, table, texts
from .catalog import query

REVIEWS = {"R": 2, "N": 1, "A": 0}


@query("io1_read_snapshot", "select l_orderkey, l_linenumber, l_quantity from lineitem")
def io1(spark, sf):
    from ..sources.snapshots import read_snapshot

    schema = "l_orderkey bigint, l_linenumber int, l_quantity double"
    return read_snapshot(spark, f"{sf}/lineitem.parquet", schema)


@query(
    "pr1_map_labels",
    """select l_returnflag, cast(case l_returnflag when 'A' then 0 when 'N' then 1 when 'R' then 2 end as integer) as label, count(*) as n
       from lineitem group by 1, 2""",
)
def pr1(spark, sf):
    catalogue = spark.createDataFrame(sorted(REVIEWS.items()), "name string, id int")
    mapped = clean.map_labels(table(spark, sf, "lineitem").select("l_returnflag"), "l_returnflag", catalogue)
    return mapped.groupBy("l_returnflag", "label").agg(F.count(F.lit(1)).alias("n"))


@query("pr2_boolean_label", "select event_id, case when event_type = 'purchase' then 1 else 0 end as label from events")
def pr2(spark, sf):
    return table(spark, sf, "events").select("event_id", clean.boolean_label(F.col("event_type") == "purchase").alias("label"))


@query("pr3_drop_unavailable", "select o_orderkey, o_custkey, o_orderdate, o_orderpriority from orders")
def pr3(spark, sf):
    kept = clean.drop_unavailable(table(spark, sf, "orders"), ["o_totalprice", "o_orderstatus"])
    clean.guard_features(kept.columns, ["o_totalprice", "o_orderstatus"])
    return kept


@query(
    "pr4_categorical_strings",
    "select p_partkey, cast(p_size as varchar) as p_size, case when p_retailprice > 1200 then 'true' else 'false' end as expensive from part",
)
def pr4(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_size", (F.col("p_retailprice") > 1200).alias("expensive"))
    return clean.categorical_strings(part, ["p_size", "expensive"])


@query(
    "pr5_normalise_text",
    "select page_id, replace(html, '<br />', ' ') as text from pages",
)
def pr5(spark, sf):
    return table(spark, sf, "pages").select("page_id", normalise(F.col("html")).alias("text"))


@query(
    "pr6_row_id",
    "select o_orderkey, sha256(concat_ws(chr(31), o_orderkey, o_custkey)) as _row_id from orders",
)
def pr6(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return clean.with_row_id(orders, ["o_orderkey", "o_custkey"]).drop("o_custkey", "o_orderstatus")


@query("pr7_feature_columns", "select column_name from (values ('text'), ('lang'), ('source'), ('n_chars'), ('toxic')) v(column_name) where exists (select 1 from documents)")
def pr7(spark, sf):
    df = texts(spark, sf).withColumnRenamed("official", "_official").drop("quality")
    names = clean.feature_columns(df, extra=["doc_id"])
    clean.guard_features(names, ["quality"])
    # One row per feature, read off the table itself: no rows, no features.
    return df.select(F.explode(F.array(*[F.lit(c) for c in names])).alias("column_name")).distinct()


@query(
    "pr8_input_key",
    """select event_id, concat_ws(chr(31), coalesce(event_type, '␀'), coalesce(cast(user_id as varchar), '␀'), coalesce(nullif(regexp_extract(props, '[5-9]'), ''), '␀')) as input_key
       from events""",
)
def pr8(spark, sf):
    digit = F.nullif(F.regexp_extract("props", "[5-9]", 0), F.lit(""))
    return table(spark, sf, "events").select("event_id", input_key("event_type", "user_id", digit).alias("input_key"))


_CANON = """'{"o_custkey":' || o_custkey || ',"o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '","o_orderpriority":"' || o_orderpriority || '"}'"""


@query("pr9_canonical_json", f"select o_orderkey, {_CANON} as record from orders")
def pr9(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", canonical_json(o.schema, ["o_orderpriority", "o_custkey", "o_orderdate"]).alias("record"))


@query("pr10_case_id", f"select o_orderkey, sha256({_CANON}) as case_id from orders")
def pr10(spark, sf):
    o = table(spark, sf, "orders")
    return clean.with_case_id(o, ["o_orderpriority", "o_custkey", "o_orderdate"]).select("o_orderkey", "case_id")


CHOICES = [("C0", "keep the order"), ("C1", "review the order"), ("C2", "cancel the order")]
_TASK = "Choose one supplied class."
_REQ_SQL = f"""'{{"state":"' || p_name || '","instructions":"{_TASK}","choices":[' ||
  '{{"id":"C0","description":"keep the order"}},{{"id":"C1","description":"review the order"}},{{"id":"C2","description":"cancel the order"}}]}}'"""


@query("pr11_decision_request", f"select p_partkey, {_REQ_SQL} as request, sha256({_REQ_SQL}) as request_hash from part")
def pr11(spark, sf):
    return rq.with_request(table(spark, sf, "part").select("p_partkey", "p_name"), F.col("p_name"), _TASK, CHOICES).select(
        "p_partkey", "request", "request_hash"
    )


@query(
    "pr12_validate_request",
    """select conv_id, turn, case when length(trim(text)) = 0 then 'empty state'
         when role = text then 'choices not distinct' else 'ok' end as request_status from conversations""",
)
def pr12(spark, sf):
    c = table(spark, sf, "conversations")
    choices = F.array(
        F.struct(F.col("role").alias("id"), F.lit("the role").alias("description")),
        F.struct(F.col("text").alias("id"), F.lit("the text").alias("description")),
    )
    checked = c.select("conv_id", "turn", F.col("text").alias("state"), F.lit(_TASK).alias("instructions"), choices.alias("choices"))
    return checked.select("conv_id", "turn", rq.request_status().alias("request_status"))


@query(
    "pr13_evaluation_context",
    f"with {TEXTS_SQL} select doc_id, label, source as family, lang as composition from texts",
)
def pr13(spark, sf):
    df = texts(spark, sf).withColumnsRenamed({"source": "family", "lang": "composition"})
    model_input, context = rq.separate_context(df, "doc_id", inputs=["text"], context=["label", "family", "composition"])
    del model_input
    return context


@query("pr14_required_columns", "select count(*) as rows_checked, 8 as required from lineitem")
def pr14(spark, sf):
    line = table(spark, sf, "lineitem")
    required = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate"]
    clean.require_columns(line, required)
    return line.agg(F.count(F.lit(1)).alias("rows_checked")).withColumn("required", F.lit(len(required)))


@query(
    "pr15_fill_features",
    """with holes as (select c_custkey, case when c_custkey % 17 = 0 then null else c_acctbal end as amount,
         case when c_custkey % 11 = 0 then null else c_mktsegment end as segment from customer)
       select c_custkey, round(coalesce(amount, (select quantile_cont(amount, 0.5) from holes)), 6) as amount,
         coalesce(segment, '__MISSING__') as segment from holes""",
)
def pr15(spark, sf):
    holes = table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_custkey") % 17 != 0, F.col("c_acctbal")).alias("amount"),
        F.when(F.col("c_custkey") % 11 != 0, F.col("c_mktsegment")).alias("segment"),
    )
    filled = clean.fill_features(holes, ["amount"], ["segment"], medians(holes, ["amount"]))
    return filled.withColumn("amount", r6(F.col("amount")))


@query(
    "pr16_rule_label",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when (l_quantity <= 30 and (l_discount < 0.05 or l_returnflag = 'R')) or l_linestatus = 'O' and l_tax = 0 then 1 else 0 end as label
       from lineitem""",
)
def pr16(spark, sf):
    rule = ((F.col("l_quantity") <= 30) & ((F.col("l_discount") < 0.05) | (F.col("l_returnflag") == "R"))) | (
        (F.col("l_linestatus") == "O") & (F.col("l_tax") == 0)
    )
    return clean.labelled_by_rule(table(spark, sf, "lineitem"), rule).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "label")


@query(
    "pr17_counterfactual_pairs",
    """with b as (select o_orderkey, o_totalprice < 200000 as cheap, o_orderstatus = 'O' as is_open from orders),
       l as (select *, case when cheap and is_open then 1 else 0 end as l0, case when (not cheap) and is_open then 1 else 0 end as l1 from b)
       select o_orderkey, 0 as member, cheap, is_open, l0 as label, case when l0 = l1 then 'preserve' else 'flip' end as pair_relation from l
       union all select o_orderkey, 1, not cheap, is_open, l1, case when l0 = l1 then 'preserve' else 'flip' end from l""",
)
def pr17(spark, sf):
    facts = table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_totalprice") < 200000).alias("cheap"), (F.col("o_orderstatus") == "O").alias("is_open")
    )
    return clean.counterfactual_pairs(facts, ["cheap", "is_open"], {"cheap": ~F.col("cheap")}, lambda f: f["cheap"] & f["is_open"])


@query("pr18_prefixed_text", "select item_id, 'Name the topic.' || chr(10) || text as text from benchmark")
def pr18(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", clean.prefixed("Name the topic.", F.col("text")).alias("text"))


_PANEL_SQL = """with cells as (
  select source as dataset, lang as model, round(avg(n_chars) / 100, 1) as mean, round(coalesce(stddev_samp(n_chars), 0) / 100, 1) as sd, count(*) as n
  from documents group by 1, 2)"""


@query("io11_parse_score_cells", _PANEL_SQL + " select dataset, model, mean, sd, n from cells")
def io11(spark, sf):
    long = panel_cells(_panel(spark, sf), "dataset", ["de", "en", "es", "fr"])
    check_panel(long, expected_n=None)
    return long.select("dataset", "model", "mean", "sd", "n")


def _panel(spark, sf):
    """A published panel: one text cell per (source, language)."""
    stats = (
        table(spark, sf, "documents")
        .groupBy(F.col("source").alias("dataset"))
        .pivot("lang", ["de", "en", "es", "fr"])
        .agg(
            F.concat(
                F.round(F.avg("n_chars") / 100, 1).cast("decimal(12,1)").cast("string"),
                F.lit(" ± "),
                F.round(F.coalesce(F.stddev_samp("n_chars"), F.lit(0.0)) / 100, 1).cast("decimal(12,1)").cast("string"),
                F.lit(" (n="),
                F.count(F.lit(1)).cast("string"),
                F.lit(")"),
            )
        )
    )
    return stats


