"""Boosted and extremely randomised trees of several classes on the vectors, each repeated split by split in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boosting as bo, extra_trees as xt
from ..session import checkpointed
from .catalog import query
from .modelling import vectors

CLASSES, DIMS, BINS = 3, 64, 32
#: Parameters that SQL repeats: rounds of two levels, three trees of three.
ROUNDS, STOP, DEPTH, RATE, PENALTY, MIN_ROWS = 2, 5, 2, 0.1, 1.0, 5
TREES, LEVELS, TRIED, SEED = 3, 3, 8, 7

_SLOT = "cast('0x' || substr(sha256('41|' || cast(vec_id as varchar)), 1, 13) as ubigint) % 10"
_ROWS = f"""vecs as (select vec_id, cast(label % {CLASSES} as integer) as label, embedding, case when {_SLOT} < 6 then 'train' when {_SLOT} < 8 then 'validation' else 'test' end as partition from embeddings),
  x as (select vec_id, label, partition, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as f from vecs),
  xt as (select * from x where partition = 'train'), rg as (select f, min(x) as lo, max(x) as hi from xt group by f)"""


def _rows(spark, sf):
    v = vectors(spark, sf).select("vec_id", (F.col("label") % CLASSES).cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("features"), "partition")
    return checkpointed(v)


# ---- boosting -----------------------------------------------------------------------------


def _tree_sql(r):
    """Nodes of round ``r``, one tree a class, from the scores ``s{r}`` (vec_id, c, s)."""
    unit = bo._UNIT
    out = [
        f"""p{r} as (select vec_id, c, exp(s - m) / sum(exp(s - m)) over (partition by vec_id) as p from (select *, max(s) over (partition by vec_id) as m from s{r})),
        g{r} as (select p.vec_id, c, cast(floor((cast(label = c as integer) - p) * {unit!r} + 5e-1) as bigint) as g, cast(floor(p * (1 - p) * {unit!r} + 5e-1) as bigint) as h from p{r} p join vecs using (vec_id)),
        n{r}_0 as (select vec_id, c, g, h, 0 as node, true as open, partition = 'train' as own from g{r} join vecs using (vec_id))"""
    ]
    for level in range(DEPTH):
        out.append(
            f"""h{r}_{level} as (select c, node, f, bin, sum(g) as g, sum(h) as h, count(*) as n from n{r}_{level} join xb using (vec_id) where open and own group by all),
            l{r}_{level} as (select c, node, f, bin, sum(g) over a as gl, sum(h) over a as hl, sum(n) over a as nl, sum(g) over b as gt, sum(h) over b as ht, sum(n) over b as nt from h{r}_{level}
              window a as (partition by c, node, f order by bin), b as (partition by c, node, f)),
            q{r}_{level} as (select c, node, f, bin, nt, round((gl * gl::double / (hl + {PENALTY * unit!r}) + (gt - gl) * (gt - gl)::double / (ht - hl + {PENALTY * unit!r}) - gt * gt::double / (ht + {PENALTY * unit!r})) / {unit!r}, 6) as gain
              from l{r}_{level} where nl >= {MIN_ROWS} and nt - nl >= {MIN_ROWS}),
            b{r}_{level} as (select * from (select *, row_number() over (partition by c, node order by gain desc, f, bin) as k from q{r}_{level}) where k = 1 and gain > 1e-6),
            n{r}_{level + 1} as (select n.vec_id, n.c, g, h, case when b.f is null then n.node else 2 * n.node + 1 + cast(x.bin > b.bin as integer) end as node, b.f is not null as open, own
              from n{r}_{level} n left join b{r}_{level} b on n.open and b.c = n.c and b.node = n.node left join xb x on x.vec_id = n.vec_id and x.f = b.f)"""
        )
    levels = ["select c, 0 as node, sum(g) as g, sum(h) as h, count(*) as n from n{r}_0 where own group by 1".format(r=r)]
    for level in range(DEPTH):
        low = (1 << (level + 1)) - 1
        levels.append(f"select c, node, sum(g) as g, sum(h) as h, count(*) as n from n{r}_{level + 1} where own and node >= {low} group by 1, 2")
    cuts = " union all ".join(f"select c, node, f, bin, gain from b{r}_{level}" for level in range(DEPTH))
    out.append(
        f"""v{r} as ({' union all '.join(levels)}), c{r} as ({cuts}),
        t{r} as (select {r} as round, v.c, v.node, coalesce(f, -1) as feature, coalesce(bin, 0) as split, coalesce(gain, 0) as gain, {RATE} * g / (h + {PENALTY * unit!r}) as value, n from v{r} v left join c{r} using (c, node)),
        s{r + 1} as (select vec_id, c, s + value as s from s{r} join n{r}_{DEPTH} using (vec_id, c) join t{r} using (c, node))"""
    )
    return ", ".join(out)


def _boost_sql(rounds):
    return f"""with {_ROWS},
  cell as (select vec_id, f, partition, case when hi > lo then least({bo.CELLS - 1}, greatest(0, cast(floor((x - lo) / (hi - lo) * {bo.CELLS}) as bigint))) else 0 end as cell from x join rg using (f)),
  cnt as (select rg.f, g.range as cell, count(c.vec_id) as k from rg cross join range({bo.CELLS}) g left join cell c on c.f = rg.f and c.cell = g.range and c.partition = 'train' group by 1, 2),
  cum as (select f, cell, cast(sum(k) over (partition by f order by cell) - k as bigint) as before, cast(sum(k) over (partition by f) as bigint) as n from cnt),
  xb as (select vec_id, f, 1 + before * {BINS} // n as bin from cell join cum using (f, cell)),
  pri as (select label as c, ln(count(*) / sum(count(*)) over ()) as prior from vecs where partition = 'train' group by 1),
  s0 as (select vec_id, c, prior as s from vecs cross join pri), {", ".join(_tree_sql(r) for r in range(rounds))}"""


def _prob_sql(r):
    return f"select vec_id, c, exp(s - m) / sum(exp(s - m)) over (partition by vec_id) as p from (select *, max(s) over (partition by vec_id) as m from s{r})"


def _boosted(spark, sf):
    rows = _rows(spark, sf)
    return rows, bo.fit(rows.where("partition = 'train'"), "features", "label", CLASSES, DIMS, ROUNDS, DEPTH, RATE, PENALTY, MIN_ROWS, BINS)


_NODES = " union all ".join(f"select * from t{r}" for r in range(ROUNDS))


@query("ml9_boosted_trees", f"{_boost_sql(ROUNDS)} select round, c as class, node, feature, split, gain, round(value, 6) + 0e0 as value, n as rows from ({_NODES})")
def ml9t(spark, sf):
    """Every node of the first rounds: split, gain and value."""
    return _boosted(spark, sf)[1].frame(spark).withColumn("value", F.round("value", 6) + F.lit(0.0))


@query(
    "ml9_gradient_boosting",
    f"""{_boost_sql(ROUNDS)}, pr as ({_prob_sql(ROUNDS)}), w as (select vec_id, {", ".join(f"round(max(p) filter (c = {c}), 6) as p{c}" for c in range(CLASSES))} from pr group by 1)
        select vec_id, label, p0, p1, p2 from w join vecs using (vec_id) where partition = 'test'""",
)
def ml9(spark, sf):
    """Class probabilities of the test rows."""
    rows, model = _boosted(spark, sf)
    out = bo.predict(model, rows.where("partition = 'test'"), "features", ["vec_id", "label"])
    return out.select("vec_id", "label", *[F.round(F.get("probabilities", F.lit(c)), 6).alias(f"p{c}") for c in range(CLASSES)])


_LOSS = " union all ".join(f"select {r} as round, round(avg(-ln(p)), 6) as loss from ({_prob_sql(r)}) join vecs using (vec_id) where c = label and partition = 'validation'" for r in range(STOP + 1))


@query("ml10_early_stopping", f"{_boost_sql(STOP)} select round, loss, round = (select arg_min(round, (loss, round)) from ({_LOSS})) as chosen from ({_LOSS})")
def ml10(spark, sf):
    """Validation loss after each round, and the rounds that are kept."""
    rows = _rows(spark, sf).where("partition <> 'test'").withColumn("held", F.col("partition") == "validation")
    model = bo.fit(rows, "features", "label", CLASSES, DIMS, STOP, DEPTH, RATE, PENALTY, MIN_ROWS, BINS, held="held", patience=STOP + 1)
    kept = [(r, round(x, 6), r == len(model.rounds)) for r, x in enumerate(model.losses)]
    return spark.createDataFrame(kept, "round bigint, loss double, chosen boolean")


# ---- extremely randomised trees ---------------------------------------------------------------


def _forest_sql():
    """Level by level: open nodes with their intervals, the cuts they try, the counts, the best cut, the children."""
    draw = f"sha256('{SEED}|' || tree || '|' || node || '|' || f)"
    gini = lambda n, sq: f"({n} - {sq} / {n}::double)"
    out = [
        f"""tr as (select range as tree from range({TREES})), a0 as (select tree, vec_id, label, 0 as node from tr, vecs where partition = 'train'),
        i0 as (select tree, 0 as node, f, lo, hi from tr, rg)"""
    ]
    for k in range(LEVELS):
        out.append(
            f"""o{k} as (select tree, node from a{k} where node >= {(1 << k) - 1} group by 1, 2 having count(distinct label) > 1 and count(*) >= 2),
            d{k} as (select *, row_number() over (partition by tree, node order by {draw}) as r, lo + cast(cast('0x' || substr({draw}, 1, 13) as bigint) as double) / 4503599627370496e0 * (hi - lo) as cut from i{k} join o{k} using (tree, node)),
            w{k} as (select d.tree, d.node, d.f, d.cut, x.x > d.cut as side, a.label, count(*) as n from d{k} d join a{k} a using (tree, node) join xt x on x.vec_id = a.vec_id and x.f = d.f where r <= {TRIED} group by all),
            y{k} as (select tree, node, f, cut, side, sum(n) as n, sum(n * n) as sq from w{k} group by all),
            z{k} as (select tree, node, f, cut, count(*) as sides, sum({gini('n', 'sq')}) as low, sum(n) as n from y{k} group by all),
            e{k} as (select tree, node, sum(n) as n, sum(n * n) as sq from (select tree, node, label, count(*) as n from a{k} group by all) group by all),
            b{k} as (select tree, node, f, cut, decrease from (select z.*, round(({gini('e.n', 'e.sq')} - low) / e.n, 9) as decrease, row_number() over (partition by tree, node order by round(({gini('e.n', 'e.sq')} - low) / e.n, 9) desc, f) as k
              from z{k} z join e{k} e using (tree, node) where sides = 2) where k = 1 and decrease > 0),
            a{k + 1} as (select a.tree, a.vec_id, a.label, case when b.f is null then a.node else 2 * a.node + 1 + cast(x.x > b.cut as integer) end as node
              from a{k} a left join b{k} b using (tree, node) left join xt x on x.vec_id = a.vec_id and x.f = b.f),
            i{k + 1} as (select i.tree, 2 * i.node + 1 + s.range as node, i.f, case when i.f = b.f and s.range = 1 then b.cut else lo end as lo, case when i.f = b.f and s.range = 0 then b.cut else hi end as hi
              from i{k} i join b{k} b using (tree, node), range(2) s)"""
        )
    cuts = " union all ".join(f"select * from b{k}" for k in range(LEVELS))
    at = " union all ".join(f"select tree, vec_id, label, node from a{k} where node >= {(1 << k) - 1}" for k in range(LEVELS + 1))
    out.append(f"cuts as ({cuts}), rch as ({at}), cl as (select tree, node, [{', '.join(f'count(*) filter (label = {c})' for c in range(CLASSES))}] as counts from rch group by 1, 2)")
    return ", ".join(out)


_FOREST = f"with {_ROWS}, {_forest_sql()}"
_WALK = ", ".join(
    f"""t{k + 1} as (select t.tree, t.vec_id, case when c.f is null then t.node else 2 * t.node + 1 + cast(x.x > c.cut as integer) end as node
      from t{k} t left join cuts c using (tree, node) left join x on x.vec_id = t.vec_id and x.f = c.f)"""
    for k in range(LEVELS)
)


def _forest(spark, sf):
    rows = _rows(spark, sf)
    return rows, xt.fit(rows.where("partition = 'train'"), "features", "label", CLASSES, DIMS, TREES, LEVELS, TRIED, 1, SEED)


@query("ml6_extra_trees_nodes", f"{_FOREST} select cl.tree, cl.node, coalesce(f, -1) as feature, round(coalesce(cut, 0), 9) as cut, coalesce(decrease, 0) as decrease, counts from cl left join cuts using (tree, node)")
def ml6n(spark, sf):
    _, forest = _forest(spark, sf)
    return forest.frame(spark).withColumn("cut", F.round("cut", 9))


@query(
    "ml6_randomised_forest",
    f"""{_FOREST}, t0 as (select tree, vec_id, 0 as node from tr, vecs where partition = 'test'), {_WALK},
        pr as (select vec_id, {", ".join(f"avg(counts[{c + 1}] / list_sum(counts)) as p{c}" for c in range(CLASSES))} from t{LEVELS} join cl using (tree, node) group by 1)
        select vec_id, label, case when round(p0, 12) >= round(p1, 12) and round(p0, 12) >= round(p2, 12) then 0 when round(p1, 12) >= round(p2, 12) then 1 else 2 end as raw, round(p0, 6) as p0, round(p1, 6) as p1, round(p2, 6) as p2
        from pr join vecs using (vec_id)""",
)
def ml6x(spark, sf):
    rows, forest = _forest(spark, sf)
    out = xt.predict(forest, rows.where("partition = 'test'"), "features", ["vec_id", "label"])
    return out.select("vec_id", "label", "raw", *[F.round(F.get("probabilities", F.lit(c)), 6).alias(f"p{c}") for c in range(CLASSES)])
