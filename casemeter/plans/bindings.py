"""How the generic operators meet the given tables.

The expressions below are written so that Spark and DuckDB read them alike (integer
arithmetic, exponent-form double literals); the operators and their checking SQL share
these inputs and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

MODELS = (("alpha", 1), ("beta", 2), ("gamma", 3))
SEEDS = (2027, 2028, 2029)
CLASSES = 3

_LINE_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_MIX = "(l_orderkey * 31 + l_linenumber * 7 + l_partkey * 17 + l_suppkey * 13) % 1000"
_LABEL = "case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end"
_H = "(u + m * 137 + s * 59 * m) % 1000"
_FAIL = "(part + line * 3 + m * 11 + s) % 40 = 0"
_PRED = (
    f"case when {_FAIL} then -1 when {_H} < 550 + 60 * m then label "
    f"else (label + 1 + ({_H}) % 2) % 3 end"
)
_STATUS = (
    f"case when not ({_FAIL}) then 'ok' when ({_H}) % 3 = 0 then 'failed' "
    f"when ({_H}) % 3 = 1 then 'invalid' else 'unsupported' end"
)
_TOP = f"(4e-1 + (({_H}) % 60) / 1e2)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use every core on a table of few files; a table of many files is left as it is read."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if len(df.inputFiles()) < slots else df


# ---- cases: one row per order line, three classes, two datasets ------------------------

CASES_SQL = f"""cases as (
  select l_linestatus as dataset,
         sha256(concat_ws('|', {_LINE_KEY}, strftime(l_shipdate, '%Y-%m-%d'))) as case_id,
         cast({_LABEL} as integer) as label, l_orderkey as pair_key, l_partkey as part,
         l_suppkey as supp, l_linenumber as line, l_quantity as quantity, l_extendedprice as price,
         l_discount as discount, l_shipdate as ts, {_MIX} as u
  from lineitem)"""


def cases(spark: SparkSession, sf: str) -> DataFrame:
    wanted = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate", "l_returnflag", "l_linestatus"]
    line = spread(table(spark, sf, "lineitem").select(*wanted))
    return line.select(
        F.col("l_linestatus").alias("dataset"),
        F.expr(f"sha2(concat_ws('|', {_LINE_KEY}, date_format(l_shipdate, 'yyyy-MM-dd')), 256)").alias("case_id"),
        F.expr(_LABEL).cast("int").alias("label"),
        F.col("l_orderkey").alias("pair_key"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
        F.col("l_linenumber").alias("line"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_shipdate").alias("ts"),
        F.expr(_MIX).alias("u"),
    )


# ---- predictions: the central fact table ------------------------------------------------


def predictions_sql(seeds: tuple[int, ...] = SEEDS[:1]) -> str:
    model_rows = ", ".join(f"('{n}', {m})" for n, m in MODELS)
    seed_rows = ", ".join(f"({s}, {s - SEEDS[0]})" for s in seeds)
    return f"""{CASES_SQL}, raw_preds as (
  select cases.*, model, m, seed, s from cases, (values {model_rows}) as mm(model, m), (values {seed_rows}) as ss(seed, s)),
preds as (
  select *, cast({_PRED} as integer) as prediction, {_STATUS} as status,
         case when {_STATUS} = 'ok' and ({_H}) % 10 <> 9 then {_TOP} end as top,
         2e1 + (({_H}) * 7 % 500) + quantity as latency_ms, (supp + s) % 20 = 0 as cache_hit,
         1 + ({_H}) % 3 as attempts
  from raw_preds),
probs as (
  select *, case when top is null then null when prediction = 0 then [top, (1 - top) / 2, (1 - top) / 2]
    when prediction = 1 then [(1 - top) / 2, top, (1 - top) / 2]
    else [(1 - top) / 2, (1 - top) / 2, top] end as probabilities from preds)"""


def predictions(spark: SparkSession, sf: str, seeds: tuple[int, ...] = SEEDS[:1], by_case: bool = False) -> DataFrame:
    """Records of all models and seeds. ``by_case`` deals the cases before they multiply, so that what is grouped by case moves no more."""
    runs = F.array(
        *[
            F.struct(F.lit(n).alias("model"), F.lit(m).alias("m"), F.lit(seed).alias("seed"), F.lit(seed - SEEDS[0]).alias("s"))
            for n, m in MODELS
            for seed in seeds
        ]
    )
    base = cases(spark, sf)
    if by_case:
        base = base.repartition("case_id")
    base = base.withColumn("_run", F.explode(runs)).select("*", "_run.*").drop("_run")
    scored = base.withColumns(
        {
            "prediction": F.expr(_PRED).cast("int"),
            "status": F.expr(_STATUS),
            "top": F.expr(f"case when {_STATUS} = 'ok' and ({_H}) % 10 <> 9 then {_TOP} end"),
            "latency_ms": F.expr(f"2e1 + (({_H}) * 7 % 500) + quantity"),
            "cache_hit": F.expr("(supp + s) % 20 = 0"),
            "attempts": F.expr(f"1 + ({_H}) % 3"),
        }
    )
    rest = (1 - F.col("top")) / 2
    vector = F.array(*[F.when(F.col("prediction") == c, F.col("top")).otherwise(rest) for c in range(CLASSES)])
    return scored.withColumn("probabilities", F.when(F.col("top").isNotNull(), vector))


# ---- binary scores with a policy and a test partition -----------------------------------

_SCORE = "((u * 3 + m * 137) % 700 + 120 * y + 40 * m * y) / 1e3"
_PART = "case supp % 5 when 0 then 'policy' when 1 then 'test' when 2 then 'validation' else 'train' end"
_SCORE_MISSING = "m = 3 and part % 97 = 0"

SCORES_SQL = f"""{CASES_SQL}, binary_cases as (
  select dataset, case_id, u, part, {_PART} as partition, cast(case when label = 2 then 1 else 0 end as integer) as y from cases),
scores as (
  select dataset, case_id, y, partition, model, u,
         case when {_SCORE_MISSING} then null else {_SCORE} end as score,
         cast(case when {_SCORE_MISSING} then -1 when {_SCORE} >= 5e-1 then 1 else 0 end as integer) as raw
  from binary_cases, (values {", ".join(f"('{n}', {m})" for n, m in MODELS)}) as mm(model, m))"""


def scores(spark: SparkSession, sf: str) -> DataFrame:
    models = F.array(*[F.struct(F.lit(n).alias("model"), F.lit(m).alias("m")) for n, m in MODELS])
    base = (
        cases(spark, sf)
        .select("dataset", "case_id", "u", "part", F.expr(_PART).alias("partition"), F.expr("case when label = 2 then 1 else 0 end").alias("y"))
        .withColumn("_m", F.explode(models))
        .select("*", "_m.*")
    )
    return base.select(
        "dataset",
        "case_id",
        "y",
        "partition",
        "model",
        "u",
        F.expr(f"case when {_SCORE_MISSING} then null else {_SCORE} end").alias("score"),
        F.expr(f"case when {_SCORE_MISSING} then -1 when {_SCORE} >= 5e-1 then 1 else 0 end").alias("raw"),
    )


# ---- labelled texts ------------------------------------------------------------------------

TEXTS_SQL = """texts as (
  select d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic,
         cast(l.quality as integer) as label, case when d.lang = 'en' then 'test' else 'train' end as official
  from documents d join labels l on d.doc_id = l.doc_id)"""


def texts(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return docs.join(labels, "doc_id").select(
        "doc_id", "text", "lang", "source", "n_chars", "quality", "toxic",
        F.col("quality").cast("int").alias("label"),
        F.when(F.col("lang") == "en", "test").otherwise("train").alias("official"),
    )


# ---- attempt log: events as request attempts ----------------------------------------------

LEDGER_SQL = """ledger as (
  select event_id, user_id as request_id, ts, event_type, value as latency_ms,
         case event_type when 'purchase' then 'ok' when 'view' then 'ok' when 'click' then 'ok' when 'signup' then 'invalid' else 'failed' end as status,
         case when event_type <> 'error' then 200 when event_id % 4 = 0 then 429 when event_id % 4 = 1 then 503 when event_id % 4 = 2 then 401 else 500 end as code,
         cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as tokens, props
  from events)"""


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    return attempt_columns(table(spark, sf, "events"))


def attempt_columns(events: DataFrame) -> DataFrame:
    """Read an event table (batch or stream) as an attempt log."""
    kind = F.col("event_type")
    status = F.when(kind.isin("purchase", "view", "click"), "ok").when(kind == "signup", "invalid").otherwise("failed")
    code = F.when(kind != "error", 200)
    for residue, value in ((0, 429), (1, 503), (2, 401), (3, 500)):
        code = code.when(F.col("event_id") % 4 == residue, value)
    return events.select(
        "event_id", F.col("user_id").alias("request_id"), "ts", "event_type", F.col("value").alias("latency_ms"),
        status.alias("status"), code.alias("code"), F.get_json_object("props", "$.k").cast("bigint").alias("tokens"), "props",
    )


# ---- episodes: conversations as step logs --------------------------------------------------

STEPS_SQL = """steps as (
  select conv_id as episode_id, turn + 1 as step, 'adaptive' as condition, model,
         case when role = 'system' then 'inspect_payment'
              when role = 'user' and (length(text) + m) % 5 <> 0 then 'inspect_delivery'
              when (length(text) * m) % 7 < 4 then 'refund' when (length(text) * m) % 7 < 6 then 'deny' else 'escalate' end as action,
         case when conv_id % 3 = 0 then 'deny' else 'refund' end as correct_terminal,
         2e0 * length(text) + m as latency_ms
  from conversations, (values ('alpha', 1), ('beta', 2), ('gamma', 3)) as mm(model, m))"""


def steps(spark: SparkSession, sf: str) -> DataFrame:
    models = F.array(*[F.struct(F.lit(n).alias("model"), F.lit(m).alias("m")) for n, m in MODELS])
    base = table(spark, sf, "conversations").withColumn("_m", F.explode(models)).select("*", "_m.*")
    size, m, role = F.length("text"), F.col("m"), F.col("role")
    action = (
        F.when(role == "system", "inspect_payment")
        .when((role == "user") & ((size + m) % 5 != 0), "inspect_delivery")
        .when((size * m) % 7 < 4, "refund")
        .when((size * m) % 7 < 6, "deny")
        .otherwise("escalate")
    )
    return base.select(
        F.col("conv_id").alias("episode_id"),
        (F.col("turn") + 1).alias("step"),
        F.lit("adaptive").alias("condition"),
        "model",
        action.alias("action"),
        F.when(F.col("conv_id") % 3 == 0, "deny").otherwise("refund").alias("correct_terminal"),
        (F.lit(2.0) * size + m).alias("latency_ms"),
    )


# ---- hourly series and order pairs ----------------------------------------------------------

HOURLY_SQL = """hourly as (
  select date_trunc('hour', ts) as hour, count(*) as cnt, round(avg(value), 6) as mean_value
  from events group by 1)"""


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "events")
        .groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))
        .agg(F.count(F.lit(1)).alias("cnt"), F.round(F.avg("value"), 6).alias("mean_value"))
    )


def pairs_sql(seeds: tuple[int, ...] = SEEDS[:1]) -> str:
    return f"""{predictions_sql(seeds)}, two as (select l_orderkey as pair_key from lineitem group by 1 having count(*) = 2),
pair_preds as (
  select p.*, p.pair_key as pair_id, o.o_orderpriority as family, o.o_orderstatus as composition, p.label % 2 as plabel
  from preds p join two using (pair_key) join orders o on o.o_orderkey = p.pair_key)"""


def pair_predictions(spark: SparkSession, sf: str, seeds: tuple[int, ...] = SEEDS[:1]) -> DataFrame:
    """Predictions on orders of exactly two lines, the two lines being the pair members."""
    two = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("pair_key")).agg(F.count(F.lit(1)).alias("_n")).where("_n = 2").select("pair_key")
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("pair_key"), F.col("o_orderpriority").alias("family"), F.col("o_orderstatus").alias("composition")
    )
    return predictions(spark, sf, seeds).join(two, "pair_key").join(orders, "pair_key").withColumn("pair_id", F.col("pair_key"))
