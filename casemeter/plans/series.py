"""Time-series features, windows and baselines on the hourly event counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup, series as ts, split as sp
from ..session import checkpointed
from .bindings import HOURLY_SQL, hourly, table
from .catalog import query

_EX = f"""{HOURLY_SQL}, ex as (
  select n.hour, n.cnt as cnt_now, n.mean_value as mean_value_now, a.cnt as cnt_lag_1, b.cnt as cnt_lag_24, c.cnt as cnt_lag_168, t.cnt as cnt_target, t.hour as target_timestamp
  from hourly n join hourly a on a.hour = n.hour - interval 1 hour join hourly b on b.hour = n.hour - interval 24 hour
  join hourly c on c.hour = n.hour - interval 168 hour join hourly t on t.hour = n.hour + interval 1 hour),
pos as (select *, row_number() over (order by hour) - 1 as position from ex)"""

PLAN = ts.WindowPlan(windows=3, train_cap=200, validation=60, policy=40, test=50, gap=24)

_WIN = f"""{_EX}, sz as (select count(*) as n from ex),
starts as (select w, 327 + ((n - 50 - 327) * w) // 2 as start from sz, range(0, 3) t(w)),
bounds as (
  select w as "window", 'test' as partition, start as lo, start + 50 as hi from starts
  union all select w, 'policy', start - 65, start - 25 from starts
  union all select w, 'validation', start - 126, start - 66 from starts
  union all select w, 'train', greatest(0, start - 327), start - 127 from starts),
win as (select p.*, b."window", b.partition from pos p join bounds b on p.position >= b.lo and p.position < b.hi),
thr as (select cnt_target as threshold from (select cnt_target, row_number() over (order by cnt_target) - 1 as i, count(*) over () as n from win where "window" = 0 and partition = 'train') where i = ceil((n - 1) * 75e-2))"""


def _examples(spark, sf):
    return ts.examples(hourly(spark, sf), "hour", "cnt", ["mean_value"])


def _windows(spark, sf):
    return ts.forward_windows(ts.positions(_examples(spark, sf), "hour"), PLAN)


def _threshold(spark, sf, windows=None):
    windows = _windows(spark, sf) if windows is None else windows
    return ts.frozen_threshold(windows.where("window = 0 and partition = 'train'"), "cnt_target")


@query(
    "ts1_timestamp",
    "select event_id, date_trunc('hour', ts) as hour_start from events",
)
def ts1(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.to_date("ts").alias("day"), F.hour("ts").alias("hr"))
    return e.select("event_id", ts.timestamp_of(F.col("day"), F.col("hr")).alias("hour_start"))


@query("ts2_unique_timestamps", "select ts, count(*) as n from (select date_trunc('second', ts) as ts from events) group by 1 having count(*) > 1")
def ts2(spark, sf):
    e = table(spark, sf, "events").select(F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"))
    return dedup.duplicates(e, ["ts"])


@query(
    "ts3_point_in_time_features",
    f"""with {_EX} select hour, target_timestamp, cast(extract('hour' from target_timestamp) as integer) as hour_next, cast(extract('isodow' from target_timestamp) - 1 as integer) as weekday_next,
        cast(extract('month' from target_timestamp) as integer) as month_next, cast(extract('year' from target_timestamp) as integer) as year_next,
        mean_value_now, cnt_now, cnt_lag_1, cnt_lag_24, cnt_lag_168, cnt_target from ex""",
)
def ts3(spark, sf):
    return _examples(spark, sf)


@query("ts4_frozen_threshold", f"with {_WIN} select p.hour, cast(threshold as bigint) as threshold, case when cnt_target > threshold then 1 else 0 end as label from pos p, thr")
def ts4(spark, sf):
    ex = _examples(spark, sf)
    thr = _threshold(spark, sf)
    return ex.select("hour", thr.select("threshold").scalar().alias("threshold"), ts.exceeds(F.col("cnt_target"), thr).alias("label"))


_RULES = {"persistence": "cnt_now", "seasonal": "cnt_lag_168"}


@query("ts5_persistence_baseline", f"with {_WIN} select hour, case when cnt_now > threshold then 1 else 0 end as persistence from pos, thr")
def ts5(spark, sf):
    return ts.baselines(_examples(spark, sf), _threshold(spark, sf), {"persistence": "cnt_now"}).select("hour", "persistence")


@query("ts6_seasonal_baseline", f"with {_WIN} select hour, case when cnt_lag_168 > threshold then 1 else 0 end as seasonal from pos, thr")
def ts6(spark, sf):
    return ts.baselines(_examples(spark, sf), _threshold(spark, sf), {"seasonal": "cnt_lag_168"}).select("hour", "seasonal")


@query("ts7_day_blocks", "select cast(ts as date) as day, count(*) as n from events group by 1")
def ts7(spark, sf):
    return table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("sp13_forward_windows", f"with {_WIN} select \"window\", partition, 'sliding-forward-window' as protocol, position, hour from win")
def sp13(spark, sf):
    return _windows(spark, sf).select("window", "partition", "protocol", "position", "hour")


@query(
    "sp14_embargo",
    f"""with {_WIN}, e as (select "window", max(target_timestamp) filter (partition = 'policy') as last_policy_target, min(hour) filter (partition = 'test') as first_test from win group by 1)
        select *, date_diff('hour', last_policy_target, first_test) as hours, date_diff('hour', last_policy_target, first_test) >= 24 as respected from e""",
)
def sp14(spark, sf):
    return ts.embargo(_windows(spark, sf), "hour", "target_timestamp", 24)


def _count_sql(name, source, size, seed):
    """One stratified draw of ``size`` rows by largest remainder; leaves ``name_rest``."""
    return f"""{name}_n as (select label, count(*) as n, sum(count(*)) over () as nn from {source} group by 1),
    {name}_f as (select label, n, (n * {size}) // nn as fl, (n * {size}) % nn as rem from {name}_n),
    {name}_q as (select label, fl + case when row_number() over (order by rem desc, label) <= {size} - sum(fl) over () then 1 else 0 end as quota from {name}_f),
    {name}_r as (select s.*, row_number() over (partition by label order by sha256('{seed}|' || cast(hour as varchar))) as rn from {source} s),
    {name}_part as (select r.hour, r.label from {name}_r r join {name}_q using (label) where rn <= quota),
    {name}_rest as (select r.hour, r.label from {name}_r r join {name}_q using (label) where rn > quota)"""


@query(
    "sp15_random_holdout",
    f"""with {_WIN}, lab as (select hour, case when cnt_target > threshold then 1 else 0 end as label from pos, thr),
    {_count_sql('a', 'lab', 60, 21)}, {_count_sql('b', 'a_rest', 40, 21)}, {_count_sql('c', 'b_rest', 50, 21)}, {_count_sql('d', 'c_rest', 200, 21)}
    select hour, label, 'test' as partition, 'random-holdout-diagnostic' as protocol from a_part union all select hour, label, 'policy', 'random-holdout-diagnostic' from b_part
    union all select hour, label, 'validation', 'random-holdout-diagnostic' from c_part union all select hour, label, 'train', 'random-holdout-diagnostic' from d_part""",
)
def sp15(spark, sf):
    ex = _examples(spark, sf)
    # The labelled examples are read by several jobs of the split, so their lineage ends here.
    labelled = checkpointed(ex.select("hour", ts.exceeds(F.col("cnt_target"), _threshold(spark, sf)).alias("label")))
    parts = sp.count_split(labelled, "hour", "label", 21, [("test", 60), ("policy", 40), ("validation", 50)], 200)
    return parts.withColumn("protocol", F.lit("random-holdout-diagnostic"))
