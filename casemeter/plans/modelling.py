"""Models, search and ensembles on the labelled vectors and texts."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..operators import ensembles as en, inverted_file as fi, kernels as kn, models as mo, neighbours as nb, split as sp, table_features as tb
from ..session import checkpointed
from .bindings import CASES_SQL, cases, predictions, predictions_sql, table
from .catalog import query

_SLOT = "cast('0x' || substr(sha256('41|' || cast(vec_id as varchar)), 1, 13) as ubigint) % 10"
_VEC = f"""vecs as (select vec_id, label, embedding, case when {_SLOT} < 6 then 'train' when {_SLOT} < 8 then 'validation' else 'test' end as partition from embeddings)"""
_NN = f"""{_VEC}, ld as (select vec_id, label, partition, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from vecs),
  dst as (select q.vec_id, t.vec_id as neighbour_id, sqrt(sum((q.x - t.x) * (q.x - t.x))) as distance from ld q join ld t on q.i = t.i where q.partition = 'test' and t.partition = 'train' group by 1, 2),
  nn as (select * from (select *, row_number() over (partition by vec_id order by distance, neighbour_id) as rank from dst) where rank <= 15)"""


def vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    return sp.group_split(e, "vec_id", 41, [("train", 6), ("validation", 2), ("test", 2)])


def _neighbours(spark, sf, k=15):
    v = vectors(spark, sf)
    train = v.where("partition = 'train'").select(F.col("vec_id").alias("neighbour_id"), "embedding", "label")
    return nb.nearest(v.where("partition = 'test'"), train, "vec_id", "neighbour_id", "embedding", k), train


@query("j9_nearest_neighbours", f"with {_NN} select vec_id, neighbour_id, round(distance, 6) as distance, rank from nn")
def j9(spark, sf):
    near, _ = _neighbours(spark, sf)
    return near.select("vec_id", "neighbour_id", r6(F.col("distance")).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


_VOTE = """, w as (select nn.vec_id, v.label, case when max(cast(distance = 0 as integer)) over (partition by nn.vec_id) = 1 then cast(distance = 0 as integer) else 1 / distance end as w from nn join vecs v on v.vec_id = neighbour_id),
  pc as (select vec_id, label, sum(w) as w from w group by 1, 2)"""


def _file(spark, sf):
    v = vectors(spark, sf)
    train = v.where("partition = 'train'").select(F.col("vec_id").alias("neighbour_id"), "embedding")
    return v.where("partition = 'test'"), train, fi.InvertedFile(train, "neighbour_id", "embedding", seed=41)


@query("j9_inverted_file", f"with {_NN} select vec_id, neighbour_id, round(distance, 6) as distance, rank from nn")
def j9f(spark, sf):
    """The same neighbours from an inverted file all of whose cells are probed."""
    test, _, file = _file(spark, sf)
    near = file.search(test, "vec_id", 15, len(file.centres))
    return near.select("vec_id", "neighbour_id", r6(F.col("distance")).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


@query("j9_inverted_recall", f"with {_VEC} select 15 * count(*) as neighbours, true as recalled from vecs where partition = 'test'")
def j9r(spark, sf):
    """Whether three quarters of the cells give nine tenths of the neighbours of these vectors, which form no clusters."""
    test, train, file = _file(spark, sf)
    found = fi.recall(file, test, "vec_id", train, 15, max(1, 3 * len(file.centres) // 4))
    return found.select("neighbours", (F.col("found") >= 0.9 * F.col("neighbours")).alias("recalled"))


@query(
    "ml7_knn_vote",
    f"with {_NN}{_VOTE} select vec_id, label as prediction, round(w / t, 6) as score from (select *, row_number() over (partition by vec_id order by w desc, label) as r, sum(w) over (partition by vec_id) as t from pc) where r = 1",
)
def ml7(spark, sf):
    near, train = _neighbours(spark, sf)
    out = nb.vote(near, train, "vec_id", "neighbour_id", "label")
    return out.withColumn("score", r6(F.col("score")))


@query("ml7_knn_uniform", f"with {_NN}, pc as (select nn.vec_id, v.label, count(*) as w from nn join vecs v on v.vec_id = neighbour_id group by 1, 2) select vec_id, label as prediction, round(w / 15, 6) as score from (select *, row_number() over (partition by vec_id order by w desc, label) as r from pc) where r = 1")
def ml7u(spark, sf):
    near, train = _neighbours(spark, sf)
    return nb.vote(near, train, "vec_id", "neighbour_id", "label", "uniform").withColumn("score", r6(F.col("score")))


for _k in (5, 31):
    _SQL_K = _NN.replace("rank <= 15", f"rank <= {_k}")

    @query(f"ml7_knn_vote_{_k}", f"with {_SQL_K}{_VOTE} select vec_id, label as prediction, round(w / t, 6) as score from (select *, row_number() over (partition by vec_id order by w desc, label) as r, sum(w) over (partition by vec_id) as t from pc) where r = 1")
    def ml7k(spark, sf, k=_k):
        near, train = _neighbours(spark, sf, k)
        return nb.vote(near, train, "vec_id", "neighbour_id", "label").withColumn("score", r6(F.col("score")))


@query(
    "ml8_gaussian_naive_bayes",
    f"""with {_VEC}, ld as (select vec_id, label, partition, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from vecs), tr as (select * from ld where partition = 'train'),
        mx as (select max(v) as v from (select var_pop(x) as v from tr group by i)), g as (select label, i, avg(x) as m, var_pop(x) + 1e-9 * (select v from mx) as var, count(*) as n from tr group by 1, 2),
        j as (select q.vec_id, g.label, ln(max(g.n) / (select count(*) from vecs where partition = 'train')) + sum(-5e-1 * ln(2 * 3.141592653589793::double * var) - pow(x - m, 2) / (2 * var)) as lj from ld q join g using (i) where partition = 'test' group by 1, 2)
        select vec_id, arg_max(label, lj) as prediction, round(max(lj), 4) as log_joint from j group by 1""",
)
def ml8g(spark, sf):
    v = vectors(spark, sf)
    fitted = en.gaussian_fit(v.where("partition = 'train'"), "label", "embedding", 1e-9)
    out = en.gaussian_predict(v.where("partition = 'test'"), "vec_id", "embedding", fitted, "label")
    return out.withColumn("log_joint", F.round("log_joint", 4))


@query("ml11_majority_class", f"with {CASES_SQL}, c as (select dataset, label, count(*) as n from cases group by 1, 2) select dataset, label as prediction from (select *, row_number() over (partition by dataset order by n desc, label) as r from c) where r = 1")
def ml11(spark, sf):
    return en.majority_class(cases(spark, sf), "label", ["dataset"])


@query(
    "ml12_soft_vote",
    f"""with {predictions_sql()}, l as (select dataset, case_id, count(top) as k, avg(probabilities[1]) as p0, avg(probabilities[2]) as p1, avg(probabilities[3]) as p2 from probs group by 1, 2)
        select dataset, case_id, case when k < 3 then -1 when p0 >= p1 and p0 >= p2 then 0 when p1 >= p2 then 1 else 2 end as prediction from l""",
)
def ml12(spark, sf):
    return en.soft_vote(predictions(spark, sf), ["dataset", "case_id"], 3, 3).select("dataset", "case_id", "prediction")


@query(
    "ml13_hard_vote",
    f"""with {predictions_sql()}, v as (select dataset, case_id, count(*) filter (prediction = 0) as a, count(*) filter (prediction = 1) as b, count(*) filter (prediction = 2) as c from preds group by 1, 2)
        select dataset, case_id, case when a >= b and a >= c then 0 when b >= c then 1 else 2 end as prediction from v""",
)
def ml13(spark, sf):
    return en.hard_vote(predictions(spark, sf), ["dataset", "case_id"], 3)


@query("ml14_class_weights", f"with {CASES_SQL}, c as (select dataset, label, count(*) as n_class from cases group by 1, 2) select dataset, label, n_class, round(sum(n_class) over (partition by dataset) / (count(*) over (partition by dataset) * n_class), 6) as weight from c")
def ml14(spark, sf):
    return tb.class_weights(cases(spark, sf), "label", ["dataset"]).withColumn("weight", r6(F.col("weight")))


@query(
    "ml16_trial_selection",
    f"""with {predictions_sql()}, t as (select model as family, cast(line as integer) as trial, round(avg(case when prediction = label then 1e0 else 0e0 end), 2) as score from preds group by 1, 2)
        select family, trial, score from (select *, row_number() over (partition by family order by score desc, trial) as r from t) where r = 1""",
)
def ml16(spark, sf):
    hit = (F.col("prediction") == F.col("label")).cast("double")
    trials = predictions(spark, sf).groupBy(F.col("model").alias("family"), F.col("line").cast("int").alias("trial")).agg(F.round(F.avg(hit), 2).alias("score"))
    return mo.select_trial(trials)


# ---- fitted models: checked by rows here and against NumPy in the tests --------------------


def _splits(spark, sf, binary):
    """Train, validation and test rows with a dense vector."""
    label = (F.col("label") % 2) if binary else F.col("label")
    v = vectors(spark, sf).select("vec_id", label.cast("int").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), "partition")
    v = checkpointed(v)
    return [v.where(F.col("partition") == p).drop("partition") for p in ("train", "validation", "test")]


def _fitted(family, binary, extra=None, params=0):
    def run(spark, sf):
        train, _, test = _splits(spark, sf, binary)
        c = mo.Candidate(family, mo.SETTINGS[family][params], False, extra or {})
        classes = 2 if binary else 10
        model = mo.fit(c, train, classes, 7, trees=10, rounds=5)
        return mo.score(model, test, classes, ["vec_id", "label"])

    return run


query("ml1_logistic_regression")(_fitted("logistic_regression", False))
query("ml2_linear_svm")(_fitted("linear_svm", True))
query("ml4_decision_tree")(_fitted("decision_tree", False))
query("ml5_random_forest")(_fitted("random_forest", False))
query("ml8_gaussian_estimator")(_fitted("naive_bayes", False, {"modelType": "gaussian"}))
query("ml19_uniform_scores")(_fitted("logistic_regression", True, params=1))


LANDMARKS, GAMMA = 300, 0.5
_MARKS = f"""{_VEC}, mark as (select *, row_number() over (order by sha256('7|' || cast(vec_id as varchar)), vec_id) as place from vecs where partition = 'train'),
  lm as (select * from mark where place <= {LANDMARKS})"""
_SQUARE = "list_sum(list_transform(range(1, 65), lambda i: pow(x.embedding[i]::double - y.embedding[i]::double, 2)))"


def _kernel(spark, sf):
    v = vectors(spark, sf).select("vec_id", (F.col("label") % 2).cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"), "partition")
    marks = kn.fit(v.where("partition = 'train'"), "vec_id", "embedding", 64, GAMMA, LANDMARKS, 7)
    return checkpointed(kn.transform(marks, v, "embedding").drop("embedding")), marks


@query("ml3_rbf_svm")
def ml3(spark, sf):
    rows, _ = _kernel(spark, sf)
    rows = rows.withColumn("features", array_to_vector("kernel"))
    model = mo.fit(mo.Candidate("rbf_svm", {"C": 3.0}), rows.where("partition = 'train'"), 2, 7)
    return mo.score(model, rows.where("partition = 'test'"), 2, ["vec_id", "label"])


@query(
    "ml3_landmark_kernel",
    f"""with {_MARKS} select x.vec_id, y.vec_id as landmark_id, round(exp(-{GAMMA} * {_SQUARE}), 4) as kernel from vecs x, lm y where x.partition = 'test' and y.place <= 5""",
)
def ml3k(spark, sf):
    """Inner products of test rows and the first landmarks, which equal the kernel."""
    rows, marks = _kernel(spark, sf)
    first = F.broadcast(rows.where(F.col("vec_id").isin(marks.ids[:5])).select(F.col("vec_id").alias("landmark_id"), F.col("kernel").alias("other")))
    pairs = rows.where("partition = 'test'").crossJoin(first)  # five landmarks
    return pairs.select("vec_id", "landmark_id", F.round(kn.kernel_of("kernel", "other"), 4).alias("kernel"))


@query(
    "ml3_kernel_error",
    f"""with {_MARKS} select x.vec_id, y.vec_id as other_id, round(exp(-{GAMMA} * {_SQUARE}), 6) as kernel, true as close
        from vecs x join vecs y on y.vec_id in (x.vec_id + 1, x.vec_id + 2) where x.partition = 'test' and y.partition = 'test'""",
)
def ml3e(spark, sf):
    """Neighbouring test rows: the exact kernel, and whether the features are within 0.1 of it."""
    rows, _ = _kernel(spark, sf)
    test = rows.where("partition = 'test'").join(vectors(spark, sf).select("vec_id", F.col("embedding").alias("v")), "vec_id")
    placed = test.withColumn("next", F.explode(F.array(F.col("vec_id") + 1, F.col("vec_id") + 2)))
    other = test.select(F.col("vec_id").alias("other_id"), F.col("kernel").alias("other"), F.col("v").alias("w"))
    pairs = placed.join(other, F.col("next") == F.col("other_id"))
    square = F.aggregate(F.zip_with("v", "w", lambda a, b: F.pow(a.cast("double") - b.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x)
    exact = F.exp(-F.lit(GAMMA) * square)
    return pairs.select("vec_id", "other_id", F.round(exact, 6).alias("kernel"), (F.abs(kn.kernel_of("kernel", "other") - exact) < 0.1).alias("close"))


def _search(spark, sf):
    train, validation, test = _splits(spark, sf, True)
    options = [*mo.candidates("logistic_regression", 4), *mo.candidates("decision_tree", 2)]
    trials, options = mo.search(options, train, validation, 2, 7)
    return trials, options, train, validation, test


@query("ml15_candidate_search")
def ml15(spark, sf):
    return _search(spark, sf)[0]


@query("ml17_refit")
def ml17(spark, sf):
    trials, options, train, validation, test = _search(spark, sf)
    _, model = mo.refit(trials, options, train, validation, 2, 7)
    return mo.score(model, test, 2, ["vec_id", "label"])


@query("ml18_leaderboard")
def ml18(spark, sf):
    return mo.leaderboard(_search(spark, sf)[0])


_SCALED = """select q.vec_id, '{scope}' as scope, round(max(case when i = 1 then z end), 6) + 0e0 as first, round(sum(z * z), 3) as energy
  from (select l.vec_id, l.i, (l.x - m) / case when s = 0 then 1 else s end as z from ld l join (select i, avg(x) as m, stddev_samp(x) as s from ld where partition in ({fit}) group by 1) using (i) where l.partition = '{of}') q group by 1"""


@query(
    "fe13_fit_scope",
    f"with {_VEC}, ld as (select vec_id, partition, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from vecs) "
    + _SCALED.format(scope="selection", fit="'train'", of="validation") + " union all " + _SCALED.format(scope="final", fit="'train', 'validation'", of="test"),
)
def fe13(spark, sf):
    """Scaling fitted on training rows for selection, on training and validation rows for the final fit."""
    train, validation, test = _splits(spark, sf, False)
    selection = mo.dense_pipeline().fit(train).transform(validation).withColumn("scope", F.lit("selection"))
    final = mo.dense_pipeline().fit(train.unionByName(validation)).transform(test).withColumn("scope", F.lit("final"))
    z = vector_to_array("scaled")
    both = selection.unionByName(final).select("vec_id", "scope", z.alias("z"))
    return both.select("vec_id", "scope", (r6(F.col("z")[0]) + F.lit(0.0)).alias("first"), F.round(F.aggregate("z", F.lit(0.0), lambda a, x: a + x * x), 3).alias("energy"))
