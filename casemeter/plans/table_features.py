"""Imputation, scaling, encoding and vectors of tabular features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..operators import clean, table_features as tb
from .bindings import CASES_SQL, cases, table
from .catalog import query


@query(
    "fe5_standardise",
    f"""with {CASES_SQL}, s as (select avg(quantity) as mq, stddev_pop(quantity) as sq, avg(price) as mp, stddev_pop(price) as sp from cases where supp % 5 > 1)
        select case_id, round((quantity - mq) / sq, 6) as quantity, round((price - mp) / sp, 6) as price from cases, s""",
)
def fe5(spark, sf):
    c = cases(spark, sf)
    stats = tb.scale_statistics(c.where("supp % 5 > 1"), ["quantity", "price"])
    out = tb.standardise(c, ["quantity", "price"], stats)
    return out.select("case_id", *[r6(F.col(x)).alias(x) for x in ("quantity", "price")])


_HOLES = "holes as (select l_orderkey, case when l_partkey % 17 <> 0 then l_quantity end as quantity, case when l_partkey % 13 <> 0 then l_extendedprice end as price, cast(null as double) as nothing, case when l_suppkey % 7 <> 0 then l_returnflag end as flag, case when l_suppkey % 3 <> 0 then l_linestatus end as state from lineitem)"


def _holes(spark, sf):
    col = F.col
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        F.when(col("l_partkey") % 17 != 0, col("l_quantity")).alias("quantity"),
        F.when(col("l_partkey") % 13 != 0, col("l_extendedprice")).alias("price"),
        F.lit(None).cast("double").alias("nothing"),
        F.when(col("l_suppkey") % 7 != 0, col("l_returnflag")).alias("flag"),
        F.when(col("l_suppkey") % 3 != 0, col("l_linestatus")).alias("state"),
    )


@query("fe7_median_imputation", f"with {_HOLES} select round(quantile_cont(quantity, 5e-1), 6) as quantity, round(quantile_cont(price, 5e-1), 6) as price, 0e0 as nothing from holes")
def fe7(spark, sf):
    m = tb.medians(_holes(spark, sf), ["quantity", "price", "nothing"])
    return m.select(*[r6(F.col(c)).alias(c) for c in m.columns])


@query(
    "fe8_most_frequent",
    f"with {_HOLES} select (select flag from holes where flag is not null group by 1 order by count(*) desc, flag limit 1) as flag, (select state from holes where state is not null group by 1 order by count(*) desc, state limit 1) as state",
)
def fe8(spark, sf):
    return tb.most_frequent(_holes(spark, sf), ["flag", "state"])


@query(
    "fe9_one_hot",
    """select o_orderkey, case when o_orderpriority = '1-URGENT' then 1e0 else 0e0 end as "o_orderpriority=1-URGENT", case when o_orderpriority = '2-HIGH' then 1e0 else 0e0 end as "o_orderpriority=2-HIGH",
       case when o_orderpriority = '3-MEDIUM' then 1e0 else 0e0 end as "o_orderpriority=3-MEDIUM" from orders""",
)
def fe9(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    levels = tb.categories(o.where("o_orderpriority < '4'"), "o_orderpriority")
    return tb.one_hot(o, "o_orderpriority", levels).drop("o_orderpriority")


@query(
    "fe10_column_kinds",
    """select column_name, kind from (values ('c_custkey', 'numeric'), ('c_name', 'categorical'), ('c_nationkey', 'numeric'), ('c_acctbal', 'numeric'), ('c_mktsegment', 'categorical')) v(column_name, kind) where exists (select 1 from customer)""",
)
def fe10(spark, sf):
    c = table(spark, sf, "customer")
    kinds = clean.column_kinds(c, c.columns)
    rows = F.array(*[F.struct(F.lit(n).alias("column_name"), F.lit(k).alias("kind")) for n, k in kinds.items()])
    return c.select(F.explode(rows).alias("_k")).select("_k.*").distinct()


@query(
    "fe12_unit_vectors",
    """with e as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings), n as (select vec_id, sqrt(sum(x * x)) as s from e group by 1)
       select vec_id, i as dimension, round(x / s, 6) as value from e join n using (vec_id)""",
)
def fe12(spark, sf):
    unit = tb.unit_vector(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding")
    long = unit.select("vec_id", F.posexplode("embedding").alias("dimension", "value"))
    return long.select("vec_id", (F.col("dimension") + 1).cast("bigint").alias("dimension"), r6(F.col("value")).alias("value"))
