"""Hand-computed metric cases, and recomputation with NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from casemeter.operators import decide as de, metrics as me
from casemeter.operators.ordering import exact_quantiles, running_totals, with_order_bucket

SCHEMA = "case_id string, label int, prediction int, status string, probabilities array<double>, latency_ms double, cache_hit boolean"


def records(spark, rows):
    return spark.createDataFrame([(f"c{i}", *r) for i, r in enumerate(rows)], SCHEMA).withColumn("g", F.lit("g"))


def summary(df, classes=2):
    return me.summarise(df, ["g"], classes).collect()[0]


def drawn_records(seed, n=240, classes=3):
    """Records with failures, absent probabilities and cached answers."""
    draw = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        label, status = int(draw.integers(classes)), str(draw.choice(["ok", "ok", "ok", "failed", "invalid", "unsupported"]))
        p = draw.dirichlet(np.ones(classes)).tolist() if draw.random() < 0.7 else None
        ok = status == "ok"
        rows.append((label, int(draw.integers(classes)) if ok else -1, status, p if ok else None, float(draw.integers(1, 90)) if draw.random() < 0.8 else None, bool(draw.random() < 0.3)))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_summary_against_numpy(spark, seed):
    """Failures count as wrong and as rows; probability metrics see the rows that have probabilities, latencies the answers that were computed."""
    rows = drawn_records(seed)
    s = summary(records(spark, rows), 3)
    label, prediction = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    assert s["accuracy"] == pytest.approx((label == prediction).mean())
    assert s["balanced_accuracy"] == pytest.approx(np.mean([(prediction[label == c] == c).mean() for c in range(3)]))
    known = [k for k, r in enumerate(rows) if r[3] is not None]
    p = np.array([rows[k][3] for k in known])
    assert s["probability_coverage"] == pytest.approx(len(known) / len(rows))
    assert s["brier"] == pytest.approx(((p - np.eye(3)[label[known]]) ** 2).sum(1).mean())
    top, right = p.max(1), p.argmax(1) == label[known]
    slot = np.minimum((top * 10).astype(int), 9)
    assert s["ece"] == pytest.approx(sum(abs(top[slot == b].mean() - right[slot == b].mean()) * (slot == b).sum() for b in set(slot.tolist())) / len(known))
    timed = [r[4] for r in rows if r[4] is not None and not r[5] and r[2] != "unsupported"]
    assert s["uncached_timing_rows"] == len(timed) and s["latency_p50_ms"] == pytest.approx(np.quantile(timed, 0.5)) and s["latency_p95_ms"] == pytest.approx(np.quantile(timed, 0.95))
    for status in ("failed", "invalid", "unsupported"):
        assert s[status] == sum(r[2] == status for r in rows)


def test_a_declared_class_without_rows(spark):
    rows = [r for r in drawn_records(9) if r[0] != 1]
    df = records(spark, rows)
    table = me.class_table(me.confusion(df, ["g"]), ["g"], 3)
    assert summary(df, 3)["balanced_accuracy"] is None
    recall = {r["class"]: r["recall"] for r in me.class_recall(table, ["g"]).collect()}
    zero = {r["class"]: r["recall"] for r in me.class_recall(table, ["g"], 0.0).collect()}
    assert recall[1] is None and zero[1] == 0 and recall[0] == zero[0] == pytest.approx(np.mean([r[1] == 0 for r in rows if r[0] == 0]))


def test_no_row_with_probabilities(spark):
    rows = [(*r[:3], None, *r[4:]) for r in drawn_records(12)]
    s = summary(records(spark, rows), 3)
    assert s["brier"] is None and s["ece"] is None and s["probability_coverage"] == 0 and s["accuracy"] == pytest.approx(np.mean([r[0] == r[1] for r in rows]))


def test_invalid_rows_are_an_error(spark):
    bad = records(spark, [(0, 0, "ok", [0.9, 0.3], 1.0, False)])
    with pytest.raises(Exception, match="invalid predictions"):
        me.require_valid(bad, ["g"], 2).collect()


def pair_rows(spark, rows):
    return spark.createDataFrame(rows, "pair_id string, label int, prediction int, status string, family string, composition string").withColumn("g", F.lit(1))


def test_pairs_against_a_loop(spark):
    draw = np.random.default_rng(21)
    rows, want, broken = [], [], 0
    for k in range(120):
        members = [(f"p{k}", c, int(draw.integers(-1, 2)), "ok", "f", "c") for c in (0, 1)]
        if draw.random() < 0.1:
            members = members[: int(draw.integers(1, 2))]
            broken += 1
        else:
            want.append(all(r[1] == r[2] for r in members))
        rows += members
    outcomes = me.pair_outcomes(pair_rows(spark, rows), ["g"])
    assert outcomes.where("problem = 'pair is not two rows'").count() == broken > 0
    m = me.pair_metrics(outcomes.where("problem is null"), ["g"]).first()
    assert m["n_pairs"] == len(want) and m["both_members_correct"] == pytest.approx(np.mean(want))


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))


def test_ranking_metrics_against_numpy(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.random(400) * 0.6 + 0.3 * y, 2)
    df = spark.createDataFrame([("g", int(a), float(b)) for a, b in zip(y, s)], "g string, y int, s double")
    r = me.ranking_metrics(df, ["g"], "y", "s").collect()[0]
    assert r["roc_auc"] == pytest.approx(brute_auc(y, s))
    ap, tp_before = 0.0, 0
    for t in sorted(set(s), reverse=True):
        kept = s >= t
        tp = int(y[kept].sum())
        ap += (tp - tp_before) / y.sum() * tp / kept.sum()
        tp_before = tp
    assert r["average_precision"] == pytest.approx(ap)


def test_quantiles_with_and_without_buckets_agree_with_numpy(spark):
    values = np.random.default_rng(5).normal(size=3000).round(2)
    df = spark.createDataFrame([("a" if i % 3 else "b", float(v)) for i, v in enumerate(values)], "k string, v double")
    hist = df.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    flat, cut = running_totals(hist, ["k"], "v", ["n"]), running_totals(hist, ["k"], "v", ["n"], rows=20)
    assert sorted(flat.collect()) == sorted(cut.collect())
    for method in ("linear", "higher"):
        for rows in (None, 20):
            got = {(r["k"], r["q"]): r["value"] for r in exact_quantiles(df, ["k"], "v", [0.0, 0.25, 0.95, 1.0], method, rows=rows).collect()}
            for k in "ab":
                part = np.array([v for i, v in enumerate(values) if ("a" if i % 3 else "b") == k])
                for q in (0.0, 0.25, 0.95, 1.0):
                    assert got[k, q] == pytest.approx(np.quantile(part, q, method=method))


def test_running_totals_of_odd_rows(spark):
    rows = [("a", 1.0, 2), ("a", None, 3), ("a", float("nan"), 5), ("a", float("-inf"), 7), (None, 2.0, 11), (None, 1.0, 13), ("c", 0.0, 17)]
    df = spark.createDataFrame(rows, "k string, v double, n long")
    for limit in (None, 1):
        got = {(r["k"], repr(r["v"])): r["cum_n"] for r in running_totals(df, ["k"], "v", ["n"], rows=limit).collect()}
        assert got == {("a", "None"): 3, ("a", "-inf"): 10, ("a", "1.0"): 12, ("a", "nan"): 17, (None, "1.0"): 13, (None, "2.0"): 24, ("c", "0.0"): 17}
        whole = running_totals(df.where("k = 'a' and v = 1 or k = 'c'"), [], "v", ["n"], rows=limit).orderBy("v").collect()
        assert [r["cum_n"] for r in whole] == [17, 19]
    assert running_totals(df.limit(0), ["k"], "v", ["n"]).count() == 0


def test_a_hot_narrow_group_is_cut_by_its_own_marks(spark):
    """One group holds most counts in a thousandth of the range that 5,000 others fill: marks over all values would leave it whole."""
    hot = spark.range(40_000).select(F.lit(0).alias("k"), (500 + F.col("id") / 100_000).alias("v"))
    others = spark.range(10_000).select((1 + F.col("id") % 5000).cast("int").alias("k"), (F.col("id") * 0.1).alias("v"))
    hist = hot.unionByName(others).withColumn("n", F.lit(1).cast("long"))
    sizes = with_order_bucket(hist, ["k"], "v", rows=1000).groupBy("k", "_b").count()
    assert sizes.where("k = 0").count() >= 200 and sizes.agg(F.max("count")).first()[0] < 0.02 * 40_000
    assert sizes.where("k > 0").groupBy("k").count().agg(F.max("count")).first()[0] == 1
    cum = running_totals(hist, ["k"], "v", ["n"], rows=1000)
    assert cum.where("k = 0").agg(F.max("cum_n"), F.count_distinct("cum_n")).first() == (40_000, 40_000)


def test_a_million_bucket_totals_are_summed_in_parts(spark):
    """Every bucket holds one row, so the totals are as many as the rows; they are cut into buckets again."""
    log = spark.range(1_000_000).withColumn("n", F.lit(1).cast("long"))
    cum = running_totals(log, [], "id", ["n"], bucket=F.col("id"), rows=20_000)
    assert cum.where("cum_n <> id + 1").count() == 0 and cum.count() == 1_000_000
    parts = with_order_bucket(log, [], "id", rows=20_000).groupBy("_b").count()
    assert parts.count() > 200 and parts.agg(F.max("count")).first()[0] < 20_000


@pytest.mark.parametrize("seed", range(3))
def test_threshold_against_every_candidate(spark, seed):
    draw = np.random.default_rng(seed)
    y = draw.integers(0, 2, 150)
    s = np.round(np.clip(0.3 * y + draw.normal(0.3, 0.2, 150), 0, 1), 3)
    df = spark.createDataFrame([(1, int(a), float(b)) for a, b in zip(y, s)], "g int, y int, s double")
    t = de.choose_threshold(df, ["g"], "y", "s", 0.5).first()
    grid = sorted({*np.quantile(s, np.arange(101) / 100), 0.5, s.max() * (1 + np.finfo(float).eps)})
    value = lambda c: ((s[y == 1] >= c).mean() + (s[y == 0] < c).mean()) / 2
    best = max(value(c) for c in grid)
    assert t["selection_balanced_accuracy"] == pytest.approx(best) and value(t["threshold"]) == pytest.approx(best)
    assert abs(t["threshold"] - 0.5) == pytest.approx(min(abs(c - 0.5) for c in grid if value(c) > best - 1e-12), abs=1e-9)


def test_threshold_needs_finite_scores_and_both_classes(spark):
    df = spark.createDataFrame([(1, 0, 0.1), (1, 1, None), (2, 1, 0.3), (2, 1, 0.4)], "g int, y int, s double")
    status = {r["g"]: r["threshold_status"] for r in de.threshold_status(df, ["g"], "y", "s").collect()}
    assert status[1].startswith("not tuned: policy") and status[2] == "not tuned: one class only"
    assert de.choose_threshold(df, ["g"], "y", "s", 0.5).count() == 0
    rows = de.apply_threshold(df.withColumn("raw", F.lit(7)), ["g"], "s", "raw", de.choose_threshold(df, ["g"], "y", "s", 0.5)).collect()
    assert {r["adjusted"] for r in rows} == {7}
