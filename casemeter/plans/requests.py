"""Response validation, input audits and the attempt log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..operators import ledger as lg, requests as rq
from ..operators.scoring import score_batches
from .bindings import LEDGER_SQL, ledger, table
from .catalog import query

LABELS = ["C0", "C1", "C2"]

# Response bodies with one defect per residue of the event id. The text is put together
# the same way for both engines.
_BODY = """'{"model":"m' || cast(event_id % 2 as varchar) || '","answers":{"classification":{"choice":"' || case when event_id % 11 = 1 then 'C7' else 'C' || cast(event_id % 3 as varchar) end
  || '","probabilities":{' || case event_id % 11 when 2 then '"C0":0.5,"C1":0.5' when 3 then '"C0":0.2,"C1":0.3,"C2":0.4,"C3":0.1' when 4 then '"C0":true,"C1":0,"C2":0'
  when 5 then '"C0":"0.5","C1":0.25,"C2":0.25' when 6 then '"C0":-0.1,"C1":1.1,"C2":0' when 7 then '"C0":0.1,"C1":0.05,"C2":0.05' when 8 then '"C2":0.501,"C1":0.25,"C0":0.251' when 9 then '"C0":1,"C1":0,"C2":0'
  else '"C0":0.25,"C1":0.5,"C2":0.25' end || '}}}' || case when event_id % 11 = 10 then '' else '}' end"""
_REASON = """case event_id % 11 when 10 then 'not json' when 1 then 'unknown choice' when 2 then 'choices not covered' when 3 then 'choices not covered'
  when 4 then 'invalid value' when 5 then 'invalid value' when 6 then 'invalid value' when 7 then 'sum differs from one' end"""


def _validated(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.expr(_BODY.replace("varchar", "string")).alias("body"))
    return rq.validate_responses(e, "body", LABELS)


@query(
    "sc2_response_validation",
    f"with b as (select event_id, {_REASON} as reason from events) select event_id, case when reason is null then 'ok' else 'invalid' end as status, reason, case when reason is null then cast(event_id % 3 as integer) else -1 end as prediction from b",
)
def sc2(spark, sf):
    return _validated(spark, sf).select("event_id", "status", "reason", "prediction")


@query(
    "sc3_normalised_probabilities",
    f"""with b as (select event_id, json_extract({_BODY}, '$.answers.classification.probabilities') as p from events where {_REASON} is null),
        v as (select event_id, cast(p->>'C0' as double) as a, cast(p->>'C1' as double) as b, cast(p->>'C2' as double) as c from b)
        select event_id, round(a / (a + b + c), 6) as p0, round(b / (a + b + c), 6) as p1, round(c / (a + b + c), 6) as p2, round(a + b + c, 6) as probability_sum from v""",
)
def sc3(spark, sf):
    ok = _validated(spark, sf).where("status = 'ok'")
    return ok.select("event_id", *[r6(F.col("probabilities")[i]).alias(f"p{i}") for i in range(3)], r6(F.col("probability_sum")).alias("probability_sum"))


@query(
    "sc4_input_audit",
    """with w as (select doc_id, len(regexp_extract_all(text, '\\S+')) + 9 as longest_pair, contains(text, 'sherin') as marked from documents)
       select doc_id, longest_pair, case when marked or longest_pair > 300 then 'unsupported' else 'ok' end as status, case when marked then 'reserved marker' when longest_pair > 300 then 'pair too long' end as reason from w""",
)
def sc4(spark, sf):
    choices = rq.choice_array([("C0", "news"), ("C1", "a longer description of reviews")])
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return rq.input_audit(docs, F.col("text"), F.lit("Choose one supplied class"), choices, 300, "sherin").drop("text")


_LOG = """log as (select event_id // 6 as request_id, (event_id // 2) % 3 + 1 as attempt, case when event_id % 2 = 0 then 'start' else 'end' end as event,
  case when event_id % 2 = 1 then (case event_type when 'error' then 'failed' when 'signup' then 'invalid' else 'ok' end) end as status, ts from events where event_id % 26 <> 1)"""


def attempt_log(events):
    """Consecutive events read as start and end of an attempt; some ends are missing."""
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "invalid").otherwise("ok")
    is_end = F.col("event_id") % 2 == 1
    return events.where("event_id % 26 <> 1").select(
        F.expr("event_id div 6").alias("request_id"),
        (F.expr("event_id div 2") % 3 + 1).alias("attempt"),
        F.when(is_end, "end").otherwise("start").alias("event"),
        F.when(is_end, status).alias("status"),
        "ts",
    )


@query(
    "sc5_request_summary",
    f"""with {_LOG} select request_id, count(*) filter (event = 'start') as starts, count(*) filter (event = 'end') as ends,
        coalesce(arg_max(status, attempt) filter (event = 'end'), 'unfinished') as final_status, greatest(count(*) filter (event = 'start') - 1, 0) as retries from log group by 1""",
)
def sc5(spark, sf):
    return lg.request_summary(attempt_log(table(spark, sf, "events")))


@query(
    "sc5_unfinished_attempts",
    f"with {_LOG} select request_id, attempt from log s where event = 'start' and not exists (select 1 from log e where e.event = 'end' and e.request_id = s.request_id and e.attempt = s.attempt)",
)
def sc5b(spark, sf):
    return lg.unfinished_attempts(attempt_log(table(spark, sf, "events")))


_TRAIL = f"{LEDGER_SQL}, tr as (select event_id, ts, count(*) over w as attempts_so_far, cast(sum(strlen(props)) over w as bigint) as units_so_far from ledger window w as (order by event_id))"


def _trail(spark, sf):
    log = ledger(spark, sf).select("event_id", "ts", "props")
    return lg.budget_trail(log, "event_id", F.octet_length("props"), bucket=F.expr("event_id div 1024"))


@query("sc6_budget_trail", f"with {_TRAIL} select event_id, attempts_so_far, units_so_far from tr")
def sc6(spark, sf):
    return _trail(spark, sf).select("event_id", "attempts_so_far", "units_so_far")


@query("sc6_first_over_budget", f"with {_TRAIL} select event_id, attempts_so_far, units_so_far from tr where attempts_so_far > 8000 or units_so_far > 70000 order by event_id limit 1")
def sc6b(spark, sf):
    return lg.first_over_budget(_trail(spark, sf), "event_id", 8000, 70000)


@query("sc7_input_cost", "select doc_id, round(strlen(text) * 25e-2 / 1e6, 9) as cost_usd from documents")
def sc7(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(rq.input_cost(F.col("text"), 0.25), 9).alias("cost_usd"))


@query(
    "sc8_retry_rates",
    f"""with {LEDGER_SQL} select cast(ts as date) as day, count(*) as n, count(*) filter (code in (408, 429, 500, 502, 503, 504)) as transient, count(*) filter (code >= 400 and code not in (408, 429, 500, 502, 503, 504)) as permanent,
        round(count(*) filter (code in (408, 429, 500, 502, 503, 504)) / count(*), 6) as transient_rate from ledger group by 1""",
)
def sc8(spark, sf):
    log = ledger(spark, sf).withColumn("day", F.to_date("ts"))
    return lg.retry_rates(log, ["day"]).withColumn("transient_rate", r6(F.col("transient_rate")))


@query(
    "sc9_latency_summary",
    f"""with {LEDGER_SQL} select event_type, round(count(*) filter (status = 'ok') / count(*), 6) as success_ratio, min(latency_ms) filter (status = 'ok') as min_ms, max(latency_ms) filter (status = 'ok') as max_ms,
        round(median(latency_ms) filter (status = 'ok'), 6) as median_ms from ledger group by 1""",
)
def sc9(spark, sf):
    out = lg.latency_summary(ledger(spark, sf), ["event_type"])
    return out.withColumns({c: r6(F.col(c)) for c in ("success_ratio", "median_ms")})


@query("sc10_usage", f"with {LEDGER_SQL} select request_id % 10 as bucket, cast(sum(tokens) as bigint) as tokens, string_agg(distinct event_type, ',' order by event_type) as resolved_models from ledger group by 1")
def sc10(spark, sf):
    return lg.usage(ledger(spark, sf).withColumn("bucket", F.col("request_id") % 10), ["bucket"], "tokens", "event_type")


@query(
    "sc11_model_mismatches",
    f"with {LEDGER_SQL}, m as (select status, 'm' || cast(event_id % 2 as varchar) as requested, 'm' || cast(case when event_id % 50 = 0 then 2 else event_id % 2 end as varchar) as resolved from ledger) select status, requested, resolved, count(*) as n from m where requested <> resolved group by 1, 2, 3",
)
def sc11(spark, sf):
    even = (F.col("event_id") % 2).cast("string")
    log = ledger(spark, sf).withColumns(
        {
            "requested": F.concat(F.lit("m"), even),
            "resolved": F.concat(F.lit("m"), F.when(F.col("event_id") % 50 == 0, "2").otherwise(even)),
        }
    )
    return lg.model_mismatches(log, ["status"], "requested", "resolved")


def _length_rule(batch):
    """A provider of the fixture kind: decides by text length, and does not take texts with a certain mark."""
    n = batch["state"].str.len()
    choice = (n % 3).astype(int)
    p = [[0.8 if i == c else 0.1 for i in range(3)] for c in choice]
    status = ["unsupported" if "@" in s else "ok" for s in batch["state"]]
    return batch[["request_hash"]].assign(prediction=choice, probabilities=p, status=status)


@query(
    "sc1_batch_scoring",
    """select doc_id, sha256(text) as request_hash, case when contains(text, '@') then 'unsupported' else 'ok' end as status, case when contains(text, '@') then -1 else cast(length(text) % 3 as integer) end as prediction,
       case when contains(text, '@') then null else 8e-1 end as top from documents""",
)
def sc1(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("state"), F.sha2("text", 256).alias("request_hash"))
    out = score_batches(docs, _length_rule, "request_hash", ["state"])
    return out.select("doc_id", "request_hash", "status", "prediction", F.array_max("probabilities").alias("top"))
