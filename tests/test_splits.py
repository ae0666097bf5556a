"""Split invariants over generated class sizes, caps and series."""

import datetime as dt

import pytest
from hypothesis import given, settings, strategies as some
from pyspark.sql import functions as F

from casemeter.operators import audit as au, ordering, series as ts, split as sp


@given(some.dictionaries(some.integers(0, 10**6), some.integers(1, 5000), min_size=1, max_size=120), some.data())
@settings(max_examples=150, deadline=None)
def test_quotas_of_any_classes(table, data):
    """Each quota lies within its class, their sum is the cap, no class moves by a whole case from its share unless the floor forces it."""
    n, k = sum(table.values()), len(table)
    cap = data.draw(some.integers(k, n + 5))
    quota = sp.proportional_quota(table, cap, 1)
    assert sum(quota.values()) == min(n, cap) and quota.keys() == table.keys()
    assert all(1 <= q <= table[c] for c, q in quota.items())
    plain = sp.proportional_quota(table, cap)
    assert sum(plain.values()) == min(n, cap)
    if cap < n:
        assert all(abs(plain[c] - table[c] * cap / n) < 1 for c in table)
        assert all(quota[c] <= max(1, plain[c]) for c in table)
    shuffled = dict(sorted(table.items(), reverse=True))
    assert sp.proportional_quota(shuffled, cap, 1) == quota


@given(some.integers(2, 60))
@settings(max_examples=20, deadline=None)
def test_a_cap_under_the_classes_is_an_error(k):
    with pytest.raises(ValueError):
        sp.proportional_quota(dict.fromkeys(range(k), 3), k - 1, 1)


@given(some.lists(some.integers(1, 400), min_size=1, max_size=12), some.lists(some.floats(0.05, 0.6), min_size=1, max_size=3))
@settings(max_examples=100, deadline=None)
def test_parts_of_any_classes_tile_their_ranks(sizes, shares):
    table = dict(enumerate(sizes))
    named = [(f"part{i}", s) for i, s in enumerate(shares)]
    parts = sp.stratified_parts(table, named, "rest")
    for c, n in table.items():
        mine = [(lo, hi) for d, _, lo, hi in parts if d == c]
        assert mine[0][0] == 0 and mine[-1][1] == n and all(a[1] == b[0] for a, b in zip(mine, mine[1:]))
    left = sum(sizes)
    for name, share in named:
        size = sum(hi - lo for _, part, lo, hi in parts if part == name)
        assert left * share - 1e-6 <= size < left * share + 1 + 1e-6
        left -= size


def cases(spark, counts):
    rows = [(f"{label}-{i}", label) for label, n in enumerate(counts) for i in range(n)]
    return spark.createDataFrame(rows, "case_id string, label int")


def test_cap_is_exact_distinct_and_deterministic(spark):
    df = cases(spark, [2, 5, 11, 187])
    a = sp.stratified_cap(df, "case_id", "label", 40, 9)
    b = sp.stratified_cap(df.repartition(7).orderBy(F.desc("case_id")), "case_id", "label", 40, 9)
    rows = sorted(a.collect())
    assert len(rows) == 40 == len(set(rows)) and rows == sorted(b.collect())
    assert {r["label"] for r in rows} == {0, 1, 2, 3}


@pytest.mark.parametrize("rows", [1, 9, 200])
def test_buckets_counted_again_give_the_same_cuts(spark, monkeypatch, rows):
    """However small the buckets that are sorted, also where digits are counted several times."""
    df = cases(spark, [5, 60, 900])
    parts = [("test", 0.2), ("policy", 0.25)]
    plain = sorted(sp.stratified_split(df, "case_id", "label", 3, parts).collect())
    monkeypatch.setattr(ordering, "SORT_ROWS", rows)
    monkeypatch.setattr(ordering, "DIGITS", 1)
    assert sorted(sp.stratified_split(df, "case_id", "label", 3, parts).collect()) == plain


def test_a_null_class_is_a_class(spark):
    df = cases(spark, [20, 40]).unionByName(spark.createDataFrame([(f"n-{i}", None) for i in range(60)], "case_id string, label int"))
    kept = {r["label"]: r["count"] for r in sp.stratified_cap(df, "case_id", "label", 24, 5).groupBy("label").count().collect()}
    assert kept == {0: 4, 1: 8, None: 12}
    whole = sp.stratified_split(df, "case_id", "label", 2, [("test", 0.5)])
    assert whole.count() == 120 and whole.where("label is null and partition = 'test'").count() == 30
    pool, test = sp.shared_holdout(df, "case_id", "label", 1)
    assert (pool.count(), test.count()) == (96, 24)


def test_repeated_ids_do_not_stretch_a_cap(spark):
    """Copies of an id share its draw: a cap that falls between them is an error, and never exceeded."""
    df = spark.range(40).select((F.col("id") % 20).cast("string").alias("case_id"), F.lit(0).alias("label"))
    assert sp.stratified_cap(df, "case_id", "label", 10, 1).count() == 10
    with pytest.raises(ValueError, match="repeated"):
        sp.stratified_cap(df, "case_id", "label", 11, 1)


def test_many_strata_and_a_hot_one(spark, monkeypatch):
    """3,000 small groups beside one large: the large one's bucket is counted again, the small ones are not."""
    monkeypatch.setattr(ordering, "SORT_ROWS", 50)
    hot = spark.range(20_000).select(F.concat(F.lit("h"), F.col("id")).alias("case_id"), F.lit(0).alias("label"), F.lit(-1).alias("g"))
    cold = spark.range(9_000).select(F.concat(F.lit("c"), F.col("id")).alias("case_id"), (F.col("id") % 3).cast("int").alias("label"), F.expr("cast(id div 9 as int)").alias("g"))
    out = sp.stratified_split(hot.unionByName(cold), "case_id", "label", 7, [("test", 0.25)], groups=["g"])
    sizes = {r["g"]: r["n"] for r in out.where("partition = 'test'").groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert sizes[-1] == 5000 and {n for g, n in sizes.items() if g >= 0} == {3} and out.count() == 29_000


def test_partitions_are_disjoint_and_cover_every_class(spark):
    df = cases(spark, [40, 80, 400])
    pool, test = sp.shared_holdout(df, "case_id", "label", 1, 100)
    parts = sp.stratified_split(pool, "case_id", "label", 2, [("policy", 0.2), ("validation", 0.25)], caps={"train": 150})
    whole = parts.unionByName(test.withColumn("partition", F.lit("test")))
    assert au.split_violations(whole).count() == 0
    assert sp.missing_classes(whole, [], "label", 3).count() == 0
    sizes = {r["partition"]: r["count"] for r in whole.groupBy("partition").count().collect()}
    assert sizes["test"] == 100 and sizes["policy"] == 84 and sizes["train"] == 150


def test_holdout_excludes_earlier_cases(spark):
    df = cases(spark, [50, 50])
    earlier = df.where("case_id like '%1'")
    _, test = sp.shared_holdout(df, "case_id", "label", 1, 100, excluded=earlier)
    assert test.join(earlier, "case_id").count() == 0


def test_groups_stay_together(spark):
    df = spark.range(400).select((F.col("id") / 2).cast("int").cast("string").alias("pair"), F.col("id").cast("string").alias("case_id"))
    out = sp.group_split(df, "pair", 3, [("train", 60), ("policy", 20), ("test", 20)])
    assert out.groupBy("pair").agg(F.count_distinct("partition").alias("n")).where("n > 1").count() == 0
    assert {r[0] for r in out.select("partition").distinct().collect()} == {"train", "policy", "test"}


def test_leading_pairs_must_be_whole(spark):
    df = spark.range(8).select(F.col("id").alias("position"), (F.col("id") / 2).cast("int").alias("pair"))
    assert sp.leading_cases(df, "position", 4, "pair").count() == 4
    with pytest.raises(ValueError):
        sp.leading_cases(df, "position", 3, "pair")


def series(spark, hours, missing=()):
    """An hourly count without some hours; the count tells the hour's number."""
    rows = [(dt.datetime(2023, 3, 5) + dt.timedelta(hours=h), 7 * h % 1009) for h in range(hours) if h not in missing]
    return spark.createDataFrame(rows, "hour timestamp_ntz, cnt long")


def test_examples_look_back_and_ahead_by_hours_not_by_rows(spark):
    missing = {40, 300, 301, 555}
    kept = [h for h in range(700) if all(h - lag not in missing and h - lag >= 0 for lag in (0, 1, 24, 168)) and h + 1 not in missing and h + 1 < 700]
    start = dt.datetime(2023, 3, 5)
    got = {r["hour"]: r for r in ts.examples(series(spark, 700, missing), "hour", "cnt").collect()}
    assert sorted(got) == [start + dt.timedelta(hours=h) for h in kept]
    for h in kept[::37]:
        r = got[start + dt.timedelta(hours=h)]
        assert r["target_timestamp"] == r["hour"] + dt.timedelta(hours=1) and r["cnt_lag_168"] == 7 * (h - 168) % 1009


@given(some.integers(1, 5), some.integers(5, 60), some.integers(3, 40), some.integers(3, 40), some.integers(0, 30), some.integers(0, 400))
@settings(max_examples=150, deadline=None)
def test_windows_of_any_plan(windows, test, policy, validation, gap, more):
    """Partitions follow one another with a row purged between them and the gap before each test block; test blocks do not meet."""
    plan = ts.WindowPlan(windows=windows, train_cap=90, validation=validation, policy=policy, test=test, gap=gap)
    before = gap + policy + validation + 3
    try:
        found = plan.intervals(windows * test + before + more)
    except ValueError:
        return
    tests = []
    for w in range(windows):
        part = {p: (lo, hi) for v, p, lo, hi in found if v == w}
        assert set(part) == {"train", "validation", "policy", "test"} and all(hi > lo for lo, hi in part.values())
        assert part["train"][1] < part["validation"][0] and part["validation"][1] < part["policy"][0] and part["policy"][1] + gap <= part["test"][0]
        assert part["train"][1] - part["train"][0] <= 90
        sizes = {p: hi - lo for p, (lo, hi) in part.items()}
        assert (sizes["validation"], sizes["policy"], sizes["test"]) == (validation, policy, test)
        tests.append(part["test"])
    assert all(a[1] <= b[0] for a, b in zip(sorted(tests), sorted(tests)[1:]))


def test_windows_over_rows_keep_the_embargo_in_time(spark):
    plan = ts.WindowPlan(windows=2, train_cap=150, validation=50, policy=45, test=70, gap=36)
    placed = ts.positions(ts.examples(series(spark, 1100, {500, 900}), "hour", "cnt"), "hour")
    win = ts.forward_windows(placed, plan)
    sizes = {(r["window"], r["partition"]): r["count"] for r in win.groupBy("window", "partition").count().collect()}
    assert sizes == {(w, p): n for w in range(2) for p, n in (("train", 150), ("validation", 50), ("policy", 45), ("test", 70))}
    checked = ts.embargo(win, "hour", "target_timestamp", 36).collect()
    assert len(checked) == 2 and all(r["respected"] for r in checked)
    with pytest.raises(ValueError):
        plan.intervals(200)


def test_expanding_windows_start_at_the_first_row():
    plan = ts.WindowPlan(windows=3, train_cap=None, validation=6, policy=4, test=9, gap=1, minimum_train=15)
    trains = [(lo, hi) for _, p, lo, hi in plan.intervals(120) if p == "train"]
    assert [lo for lo, _ in trains] == [0, 0, 0] and trains == sorted(trains) and len(set(trains)) == 3


def test_tampering_is_found(spark):
    base = [("a", "train", "p"), ("b", "train", "p"), ("c", "test", "q"), ("d", "test", "q")]
    make = lambda rows: spark.createDataFrame(rows, "case_id string, partition string, pair_id string")
    rules = lambda rows: {r["rule"] for r in au.split_violations(make(rows), pair_id="pair_id").collect()}
    assert rules(base) == set()
    assert rules(base + [("a", "test", "p")]) == {"overlapping partitions", "incomplete pair", "pair crosses partitions"}
    assert rules(base[:3]) == {"incomplete pair"}
    with pytest.raises(ValueError):
        au.require_none(au.split_violations(make(base[:3]), pair_id="pair_id"))


def test_seeds_draw_different_cases(spark):
    df = cases(spark, [60, 60])
    a, b = ({r["case_id"] for r in sp.stratified_cap(df, "case_id", "label", 20, s).collect()} for s in (1, 2))
    assert a != b
