"""Bootstrap forms, neighbours and representations against NumPy."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from casemeter.operators import ensembles as en, models as mo, neighbours as nb, stats as st


@pytest.mark.parametrize("count", [1, 4, 10, 11, 60, 5000, 10**9])
def test_draws_invert_the_poisson_distribution(spark, count):
    """Even steps of u give every draw its share: compare with the distribution function, or with its moments where that is too long."""
    n = 20_000
    u = spark.range(n).select(F.lit(count).alias("_c"), ((F.col("id") + 0.5) / n).alias("_u")).withColumn("_z", F.expr(st.normal_sql("_u")))
    got = np.array([r[0] for r in u.select("_u", st._drawn().alias("w")).orderBy("_u").select("w").collect()])
    if count <= 5000:
        k = np.arange(count + 12 * int(count**0.5) + 20)
        law = np.cumsum(np.exp(k * np.log(count) - count - np.concatenate([[0], np.cumsum(np.log(np.arange(1, len(k))))])))
        want = np.searchsorted(law, (np.arange(n) + 0.5) / n, "right")
        assert np.abs(got - want).max() <= (0 if count <= st.EXACT_COUNTS else 1) and (got != want).mean() < 0.03
    assert got.mean() == pytest.approx(count, rel=1e-3) and got.var() == pytest.approx(count, rel=2e-2)


def test_normal_values_against_known_ones(spark):
    from statistics import NormalDist

    at = [1e-12, 1e-5, 0.02, 0.3, 0.5, 0.7, 0.98, 1 - 1e-9]
    rows = spark.createDataFrame([(x,) for x in at], "u double").selectExpr("u", f"{st.normal_sql('u')} as z").collect()
    assert [r["z"] for r in rows] == pytest.approx([NormalDist().inv_cdf(r["u"]) for r in rows], abs=1e-7, rel=1e-7)


@pytest.mark.parametrize("n, distinct", [(40, 40), (300, 3), (6000, 5)])
def test_intervals_against_resampling(spark, n, distinct):
    rng = np.random.default_rng(n)
    values = rng.choice(rng.normal(size=distinct).round(3), n) if distinct < n else rng.normal(size=n).round(6)
    df = spark.createDataFrame([("s", i % 2, float(v)) for i, v in enumerate(values)], "k string, label int, difference double")
    got = st.stratified_interval(df, ["k"], 2000, 1).first()
    direct = [np.mean([rng.choice(c, len(c)).mean() for c in (values[0::2], values[1::2])]) for _ in range(3000)]
    width = np.std(direct)
    assert got["difference_pp"] == pytest.approx(100 * np.mean([values[0::2].mean(), values[1::2].mean()])) and got["cases"] == n
    assert got["lower_95_pp"] / 100 == pytest.approx(np.quantile(direct, 0.025), abs=0.35 * width)
    assert got["upper_95_pp"] / 100 == pytest.approx(np.quantile(direct, 0.975), abs=0.35 * width)
    again = st.stratified_interval(df.repartition(5), ["k"], 2000, 1).first()
    assert tuple(again)[1:] == pytest.approx(tuple(got)[1:])


def test_copies_of_cases_only_narrow_the_interval(spark):
    """Counts, not rows, carry the weight: a thousand copies of each case make the interval narrower by the root of a thousand."""
    values = [float(v) for v in np.random.default_rng(4).normal(size=30).round(4)]
    few = spark.createDataFrame([("s", v) for v in values], "k string, value double")
    many = few.crossJoin(spark.range(1000)).select("k", "value")
    a, b = (st.cluster_interval(d, ["k"], 1000, 2).first() for d in (few, many))
    assert b["clusters"] == 30_000 and a["estimate"] == pytest.approx(b["estimate"])
    assert (a["high"] - a["low"]) / (b["high"] - b["low"]) == pytest.approx(1000**0.5, rel=0.15)


def test_one_case_and_no_case(spark):
    df = spark.createDataFrame([("s", 2.5)], "k string, value double")
    one = st.cluster_interval(df, ["k"], 200, 1).first()
    assert (one["estimate"], one["low"], one["high"]) == (2.5, 2.5, 2.5)
    assert st.cluster_interval(df.where("value > 3"), ["k"], 200, 1).count() == 0


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "c string, p_value double")
    got = {r["c"]: round(r["p_holm"], 6) for r in st.holm(df, [], ["c"]).collect()}
    assert got == {"a": 0.03, "b": 0.06, "c": 0.06}


@pytest.mark.parametrize("pivots,block", [(1, 4096), (7, 4096), (7, 11)])
def test_neighbours_are_exact(spark, pivots, block):
    rng = np.random.default_rng(2)
    train, queries = rng.normal(size=(120, 6)).round(3), rng.normal(size=(40, 6)).round(3)
    queries[0] = train[5]
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(train)], "t int, v array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "q int, v array<double>")
    got = {(r["q"], r["rank"]): (r["t"], r["distance"]) for r in nb.nearest(q, t, "q", "t", "v", 4, pivots, block).collect()}
    d = np.sqrt(((queries[:, None] - train[None]) ** 2).sum(-1))
    order = np.argsort(d, axis=1, kind="stable")[:, :4]
    assert len(got) == 160
    for i in range(40):
        for r in range(4):
            assert got[i, r + 1][0] == order[i, r] and got[i, r + 1][1] == pytest.approx(d[i, order[i, r]])


def test_hot_cell_of_equal_vectors(spark):
    t = spark.range(90).select(F.col("id").alias("t"), F.array(F.lit(1.0), F.when(F.col("id") < 60, 1.0).otherwise(F.col("id"))).alias("v"))
    q = spark.createDataFrame([(0, [1.0, 1.0])], "q int, v array<double>")
    rows = nb.nearest(q, t, "q", "t", "v", 3, 4, 8).orderBy("rank").collect()
    assert [r["t"] for r in rows] == [0, 1, 2] and all(r["distance"] == 0 for r in rows)


def test_votes(spark):
    near = spark.createDataFrame([(0, 1, 0.0), (0, 2, 0.1), (0, 3, 0.1), (1, 2, 0.5), (1, 1, 1.0)], "q int, t int, distance double")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "t int, label int")
    assert {r["q"]: r["prediction"] for r in nb.vote(near, labels, "q", "t", "label").collect()} == {0: 1, 1: 0}
    df = spark.createDataFrame([("c", 2, [0.5, 0.5]), ("c", 0, [0.5, 0.5]), ("d", -1, None), ("d", 1, [0.1, 0.9])], "c string, prediction int, probabilities array<double>")
    assert {r["c"]: r["prediction"] for r in en.hard_vote(df, ["c"], 3).collect()} == {"c": 0, "d": 1}
    assert {r["c"]: r["prediction"] for r in en.soft_vote(df, ["c"], 2, 2).collect()} == {"c": 0, "d": -1}


def test_search_records_failures(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i % 2), [float(i % 2 + rng.normal(0, 0.3)), float(rng.normal())]) for i in range(120)]
    df = spark.createDataFrame(rows, "label int, v array<double>").select("label", array_to_vector("v").alias("features"))
    bad = mo.Candidate("decision_tree", {"maxDepth": 99})
    good = mo.Candidate("logistic_regression", {"C": 3.0}, True)
    trials, options = mo.search([bad, good], df, df, 2, 1)
    rows = {r["trial"]: r for r in trials.collect()}
    assert rows[0]["error"] and rows[1]["score"] > 0.9
    chosen, model = mo.refit(trials, options, df, df, 2, 1)
    assert chosen is good
    assert mo.score(model, df, 2, ["label"]).where("raw = label").count() > 100
    with pytest.raises(RuntimeError):
        mo.search([bad], df, df, 2, 1)


def test_inverted_file_on_clusters(spark):
    """Few probes find the neighbours of clustered rows; all probes are the exact join; blocks and odd rows change nothing."""
    from casemeter.operators import inverted_file as fi

    rng = np.random.default_rng(7)
    centres = rng.normal(size=(20, 8)) * 6
    train = np.concatenate([c + rng.normal(size=(40, 8)) for c in centres])
    queries = np.concatenate([c + rng.normal(size=(3, 8)) for c in centres])
    queries[0] = train[11]
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(train)] + [(900, None)], "t int, v array<double>").repartition(3)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)] + [(900, None)], "q int, v array<double>")
    file = fi.InvertedFile(t, "t", "v", 20, 1)
    assert file.table().count() == 800 and sum(file.sizes.values()) == 800
    d = np.sqrt(((queries[:, None] - train[None]) ** 2).sum(-1))
    order = np.argsort(d, axis=1, kind="stable")[:, :5]
    got = {(r["q"], r["rank"]): r["t"] for r in file.search(q, "q", 5, 20).collect()}
    assert got == {(i, r + 1): order[i, r] for i in range(60) for r in range(5)}
    few = fi.recall(file, q.where("q < 900"), "q", t.where("t < 900"), 5, 3).first()
    assert few["neighbours"] == 300 and few["found"] >= 0.9 * 300
    one = file.search(q, "q", 5, 1)
    assert one.count() <= 300 and one.where("rank > 5").count() == 0
    file.drop()
    empty = fi.InvertedFile(t.limit(0), "t", "v")
    assert empty.search(q.limit(0), "q", 5, 2).count() == 0
    empty.drop()
