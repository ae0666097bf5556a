"""Readers and writers, each checked by a round trip through files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins
from ..session import shared_folder
from ..sources import snapshots as io
from .bindings import predictions, predictions_sql, table
from .catalog import query


@query(
    "io2_read_shards",
    "select 'documents' as _official_split, count(*) as n, cast(sum(length(text)) as bigint) as characters from documents union all select 'benchmark', count(*), cast(sum(length(text)) as bigint) from benchmark",
)
def io2(spark, sf):
    shards = io.read_shards(spark, [f"{sf}/documents.parquet", f"{sf}/benchmark.parquet"], ["documents", "benchmark"], "text string")
    return shards.groupBy("_official_split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("characters"))


@query("io3_read_delimited", "select event_id, event_type, value from events")
def io3(spark, sf):
    path = f"{shared_folder(spark)}/events"
    table(spark, sf, "events").select("event_id", "event_type", "value").write.options(sep=";", header=True).csv(path)
    return io.read_delimited(spark, path, "event_id bigint, event_type string, value double", sep=";")


@query("io3_read_label_text", "select role as label, replace(replace(text, chr(10), ' '), chr(13), ' ') as text from conversations")
def io3b(spark, sf):
    path = f"{shared_folder(spark)}/turns"
    line = F.translate("text", "\n\r", "  ")
    table(spark, sf, "conversations").select(F.concat_ws("\t", "role", line)).write.text(path)
    return io.read_label_text(spark, path)


@query("io4_read_documents", "select r_regionkey as id, r_name as name from region")
def io4(spark, sf):
    path = f"{shared_folder(spark)}/catalogue"
    pretty = F.to_json(F.struct(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")), {"pretty": "true"})
    table(spark, sf, "region").repartitionByRange(5, "r_regionkey").select(pretty).write.text(path)
    return io.read_documents(spark, path, "id int, name string")


_FACT = "case_id string, label int, prediction int, status string, probabilities array<double>"
_SUMMARY = "select dataset, seed, model, status, count(*) as n, cast(sum(prediction) as bigint) as predictions from preds group by 1, 2, 3, 4"


def _stored(spark, sf):
    path = f"{shared_folder(spark)}/predictions"
    io.write_predictions(predictions(spark, sf).select("dataset", "model", "seed", "case_id", "label", "prediction", "status", "probabilities"), path)
    return path


def _totals(df):
    return df.groupBy("dataset", "seed", "model", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("prediction").alias("predictions"))


@query("io5_read_json_lines", f"with {predictions_sql()} {_SUMMARY}")
def io5(spark, sf):
    return _totals(io.read_json_lines(spark, _stored(spark, sf), f"{_FACT}, dataset string, model string, seed int"))


@query("io6_discover_results", f"with {predictions_sql()} {_SUMMARY}")
def io6(spark, sf):
    found = io.discover_results(spark, _stored(spark, sf), _FACT, "*.json*", ["dataset", "model", "seed"])
    plain = lambda c: F.regexp_replace(c, "^[^=]*=", "")
    return _totals(found.withColumns({"dataset": plain("dataset"), "model": plain("model"), "seed": plain("seed").cast("int")}))


@query("io7_write_once", "select o_orderkey, o_orderstatus from orders")
def io7(spark, sf):
    path = f"{shared_folder(spark)}/snapshot"
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    io.write_once(orders, path)
    io.write_once(orders, path)  # the same rows again are accepted, and nothing is written
    return io.read_snapshot(spark, path)


@query("io8_write_predictions", f"with {predictions_sql()} select model, count(*) as n from preds where dataset = 'F' group by 1")
def io8(spark, sf):
    stored = spark.read.schema(f"{_FACT}, dataset string, model string, seed int").json(_stored(spark, sf))
    return stored.where("dataset = 'F'").groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query("io9_write_report", f"with {predictions_sql()} select dataset, seed, model, count(*) as n from preds group by 1, 2, 3")
def io9(spark, sf):
    path = f"{shared_folder(spark)}/report"
    report = predictions(spark, sf).groupBy("dataset", "seed", "model").agg(F.count(F.lit(1)).alias("n"))
    io.write_report(report, path, ["dataset", "seed", "model", "n"])
    return io.read_delimited(spark, path, "dataset string, seed int, model string, n bigint")


@query(
    "io10_resume_store",
    "select doc_id, sha256(text) as request_hash, l.doc_id is not null as cache_hit from documents d left join (select distinct sha256(text) as h, min(doc_id) over (partition by sha256(text)) as doc_id from documents join labels using (doc_id)) l on l.h = sha256(d.text)".replace(
        "select doc_id, sha256(text)", "select d.doc_id, sha256(d.text)"
    ),
)
def io10(spark, sf):
    path = f"{shared_folder(spark)}/answers"
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("request_hash"))
    answered = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id").groupBy("request_hash").agg(F.min("doc_id").alias("answer"))
    answered.write.json(path)
    stored = io.read_json_lines(spark, path, "request_hash string, answer bigint")
    return joins.resume(docs, stored, "request_hash")[0].select("doc_id", "request_hash", "cache_hit")
