"""Episode analytics over conversation step logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..operators import episodes as ep
from .bindings import STEPS_SQL, steps
from .catalog import query

_OUT = f"""{STEPS_SQL}, eo as (select condition, model, episode_id, min(correct_terminal) as correct_terminal, coalesce(arg_max(action, step) filter (action in ('refund', 'deny', 'escalate')), 'escalate') as terminal,
  count(*) as steps, sum(latency_ms) as latency_ms from steps group by 1, 2, 3),
  outc as (select *, terminal = correct_terminal as success, terminal in ('refund', 'deny') and terminal <> correct_terminal as critical_error, terminal = 'escalate' as escalated,
    (case when terminal = correct_terminal then 1e0 when terminal in ('refund', 'deny') then -2e0 else -25e-2 end) - 5e-2 * (steps - 1) as net_utility from eo)"""
_KEYS = ["condition", "model"]


def _outcomes(spark, sf):
    return ep.outcomes(steps(spark, sf), [*_KEYS, "episode_id"], "correct_terminal")


@query("ep1_episode_outcome", f"with {_OUT} select condition, model, episode_id, terminal, correct_terminal, steps, success, critical_error, escalated from outc")
def ep1(spark, sf):
    return _outcomes(spark, sf).drop("net_utility", "latency_ms")


@query("ep2_net_utility", f"with {_OUT} select condition, model, episode_id, round(net_utility, 6) + 0e0 as net_utility from outc")
def ep2(spark, sf):
    return _outcomes(spark, sf).select(*_KEYS, "episode_id", r6(F.col("net_utility")).alias("net_utility"))


@query(
    "ep3_episode_summary",
    f"""with {_OUT} select condition, model, count(*) as n_episodes, round(avg(cast(success as integer)), 6) as success_rate, round(avg(net_utility), 6) as mean_net_utility, round(avg(cast(critical_error as integer)), 6) as critical_error_rate,
        round(avg(cast(escalated as integer)), 6) as escalation_rate, round(avg(steps), 6) as mean_steps, count(*) filter (terminal = 'refund') as terminal_refund, count(*) filter (terminal = 'deny') as terminal_deny, count(*) filter (terminal = 'escalate') as terminal_escalate
        from outc group by 1, 2""",
)
def ep3(spark, sf):
    out = ep.summary(_outcomes(spark, sf), _KEYS)
    return out.withColumns({c: r6(F.col(c)) for c in ("success_rate", "mean_net_utility", "critical_error_rate", "escalation_rate", "mean_steps")})


@query(
    "ep4_episode_latency",
    f"""with {_OUT}, r as (select condition, model, latency_ms, row_number() over (partition by condition, model order by latency_ms) - 1 as i, count(*) over (partition by condition, model) as n from outc)
        select condition, model, max(latency_ms) filter (i = n // 2) as episode_latency_p50_ms, max(latency_ms) filter (i = least(n - 1, cast(floor(n * 95e-2) as bigint))) as episode_latency_p95_ms from r group by 1, 2""",
)
def ep4(spark, sf):
    return ep.latency(_outcomes(spark, sf), _KEYS)
