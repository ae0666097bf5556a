"""Requests, response bodies, scoring, the attempt log and episodes."""

import json
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from casemeter.operators import audit as au, clean, dedup, episodes as ep, joins, ledger as lg, requests as rq
from casemeter.operators.scoring import score_batches
from casemeter.sources import panels, snapshots as io

LABELS = ["C0", "C1"]


def body(p, choice="C0"):
    return json.dumps({"model": "m", "answers": {"classification": {"choice": choice, "probabilities": p}}})


def share_error(p, labels):
    """What is wrong with a vector, by the rule in words: finite numbers from 0 to 1 for exactly the labels, with a sum of 1."""
    if not isinstance(p, dict) or set(p) != set(labels):
        return "labels"
    if any(isinstance(v, bool) or not isinstance(v, (int, float)) for v in p.values()):
        return "types"
    if any(not math.isfinite(v) or not 0 <= v <= 1 for v in p.values()):
        return "range"
    return None if abs(sum(p.values()) - 1) <= 0.005 else "sum"


def test_vectors_of_any_kind(spark):
    """Random vectors, each with at most one defect drawn from a generator, against the rule in words."""
    draw = random.Random(17)
    rows = []
    for k in range(240):
        a = draw.random()
        p = {"C0": a, "C1": 1 - a}
        match draw.randrange(9):
            case 0: p.pop(draw.choice(LABELS))
            case 1: p[f"C{draw.randrange(2, 9)}"] = draw.random()
            case 2: p[draw.choice(LABELS)] = draw.choice([math.nan, math.inf, -math.inf])
            case 3: p["C0"], p["C1"] = -draw.uniform(0.01, 3), 1 + draw.uniform(0.01, 3)
            case 4: p[draw.choice(LABELS)] = draw.choice([True, False])
            case 5: p = {c: v * draw.uniform(0.05, 0.9) for c, v in p.items()}
            case 6: p["C0"] += draw.uniform(-0.004, 0.004) if 0.01 < a < 0.99 else 0
        rows.append((k, body(p, max(LABELS, key=lambda c: p.get(c, -1) if p.get(c, -1) == p.get(c, -1) else -1)), share_error(p, LABELS)))
    df = spark.createDataFrame([r[:2] for r in rows], "k int, body string")
    got = {r["k"]: r for r in rq.validate_responses(df, "body", LABELS).collect()}
    for k, _, error in rows:
        r = got[k]
        if error:
            assert r["status"] == "invalid" and r["prediction"] == -1 and r["probabilities"] is None, (rows[k], r)
        else:
            assert r["status"] == "ok" and sum(r["probabilities"]) == pytest.approx(1), (rows[k], r)
    assert len({e for _, _, e in rows}) == 5


def test_unknown_choice_and_broken_json(spark):
    df = spark.createDataFrame([(body({"C0": 0.5, "C1": 0.5}, "C9"),), ("{",), ("[]",)], "body string")
    assert [r["status"] for r in rq.validate_responses(df, "body", LABELS).collect()] == ["invalid"] * 3


@pytest.mark.parametrize("classes, digits", [(3, 2), (11, 4), (40, 5)])
def test_rounded_shares_are_scaled_to_one(spark, classes, digits):
    draw = random.Random(classes)
    weights = [draw.random() for _ in range(classes)]
    shares = [round(w / sum(weights), digits) for w in weights]
    labels = [f"C{i}" for i in range(classes)]
    row = rq.validate_responses(spark.createDataFrame([(body(dict(zip(labels, shares))),)], "body string"), "body", labels).first()
    assert row["status"] == "ok" and row["probabilities"] == pytest.approx([x / sum(shares) for x in shares])


def test_choice_order_is_part_of_the_identity(spark):
    df = spark.createDataFrame([("s",)], "state string")
    a = rq.with_request(df, F.col("state"), "i", [("C0", "a"), ("C1", "b")]).first()["request_hash"]
    b = rq.with_request(df, F.col("state"), "i", [("C1", "b"), ("C0", "a")]).first()["request_hash"]
    assert a != b


def test_request_status(spark):
    schema = "state string, instructions string, choices array<struct<id:string,description:string>>"
    rows = [("s", "i", [("a", "x"), ("b", "y")]), (" ", "i", [("a", "x"), ("b", "y")]), ("s", "i", [("a", "x")]), ("s", "i", [("a", "x"), ("a", "y")]), ("s", "i", [("a", "x"), ("b", " ")])]
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(rq.request_status()).collect()]
    assert got == ["ok", "empty state", "too few choices", "choices not distinct", "empty choice"]


def test_every_case_gets_one_record(spark):
    calls = spark.createDataFrame([(i, f"text {i % 3}") for i in range(30)], "id int, state string").withColumn("request_hash", F.sha2("state", 256))

    def provider(batch: pd.DataFrame) -> pd.DataFrame:
        some = batch[batch["state"] != "text 2"]
        return some[["request_hash"]].assign(prediction=1, probabilities=[[0.2, 0.8]] * len(some))

    rows = score_batches(calls, provider, "request_hash", ["state"]).collect()
    assert len(rows) == 30
    assert {r["status"] for r in rows} == {"ok", "failed"} and sum(r["prediction"] == -1 for r in rows) == 10

    def broken(batch):
        raise RuntimeError("down")

    assert {(r["status"], r["reason"]) for r in score_batches(calls, broken, "request_hash", ["state"]).collect()} == {("failed", "RuntimeError: down")}


def test_labels_by_a_rule_on_the_given_orders(spark):
    """A rule with a bound and nested alternatives, against the same rule in Python row by row."""
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_quantity", "l_discount", "l_returnflag", "l_linenumber").limit(400)
    c = F.col
    rule = (c("l_returnflag") == "R") | ((c("l_quantity") >= 25) & ((c("l_discount") > 0.05) | ~c("l_linenumber").isin(1, 4)))
    for r in clean.labelled_by_rule(df, rule).collect():
        want = r["l_returnflag"] == "R" or (r["l_quantity"] >= 25 and (r["l_discount"] > 0.05 or r["l_linenumber"] not in (1, 4)))
        assert r["label"] == int(want)


def test_unmapped_label_is_an_error(spark):
    catalogue = spark.createDataFrame([("a", 0)], "name string, id int")
    df = spark.createDataFrame([("a",), ("z",)], "l string")
    with pytest.raises(Exception, match="unmapped label"):
        clean.map_labels(df, "l", catalogue).collect()


def test_guards(spark):
    df = spark.createDataFrame([(1, 2)], "a int, label int")
    with pytest.raises(ValueError):
        clean.guard_features(["a", "label"], [])
    with pytest.raises(ValueError):
        clean.require_columns(df, ["a", "b"])
    with pytest.raises(ValueError):
        rq.separate_context(df, "a", ["label"], ["label"])


def test_conflicts_and_priority(spark):
    rows = [("k1", 0, "train", 1), ("k1", 1, "test", 2), ("k2", 1, "train", 3), ("k2", 1, "test", 4), ("k2", 1, "test", 5)]
    df = spark.createDataFrame(rows, "k string, label int, split string, id int")
    assert [r["id"] for r in dedup.clean_snapshot(df, "k", "label", ["split", "id"]).collect()] == [4]
    assert {r["id"] for r in dedup.drop_conflicts(df, "k", "label").collect()} == {3, 4, 5}


def test_unpaired_cases_are_found(spark):
    rows = [("d", "a", "c1", 0, 0), ("d", "b", "c1", 0, 1), ("d", "a", "c2", 1, 1), ("d", "a", "c3", 1, 1), ("d", "b", "c3", 0, 1)]
    df = spark.createDataFrame(rows, "ds string, model string, case_id string, label int, prediction int")
    pairs = joins.paired(df, ["ds"], "case_id", "model", "a", ["b"], {"label": F.col("label")})
    assert {r["case_id"] for r in joins.unpaired(pairs, ["ds"], "case_id").collect()} == {"c2", "c3"}


def test_merge_conflict_is_refused(spark):
    art = spark.createDataFrame([("p", "x", "r1"), ("p", "x", "r2"), ("q", "y", "r1")], "path string, checksum string, source string")
    assert au.merge_runs(art).count() == 2
    with pytest.raises(ValueError):
        au.merge_runs(art.union(spark.createDataFrame([("q", "z", "r2")], art.schema)))


def test_write_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")
    path = str(tmp_path / "snapshot")
    io.write_once(df, path)
    io.write_once(df.orderBy(F.desc("i")), path)
    with pytest.raises(ValueError):
        io.write_once(df.withColumn("s", F.lit("c")), path)


def test_damaged_line_is_an_error(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception):
        io.read_json_lines(spark, str(path), "a int").collect()


def test_fingerprint_ignores_order_and_layout(spark):
    df = spark.range(500).withColumn("x", F.col("id") % 7)
    a, b = au.fingerprint(df).first(), au.fingerprint(df.orderBy(F.desc("id")).repartition(9)).first()
    assert a == b and a["rows"] == 500
    assert au.fingerprint(df.withColumn("x", F.when(F.col("id") == 3, 99).otherwise(F.col("x")))).first()["fingerprint"] != a["fingerprint"]


def test_panel_cells(spark):
    df = spark.createDataFrame([("d1", "87.4 ± 0.8 (n=3)", "pending")], "dataset string, a string, b string")
    long = panels.panel_cells(df, "dataset", ["a"]).first()
    assert (long["mean"], long["sd"], long["n"]) == (87.4, 0.8, 3)
    with pytest.raises(Exception, match="malformed cell"):
        panels.panel_cells(df, "dataset", ["b"]).collect()
    assert [(r["model"], r["problem"]) for r in panels.panel_gaps(df, "dataset", ["a", "b"], 3).collect()] == [("b", "pending")]


def test_request_summary(spark):
    rows = [("r", 1, "start", None), ("r", 1, "end", "failed"), ("r", 2, "start", None), ("r", 2, "end", "ok"), ("u", 1, "start", None)]
    log = spark.createDataFrame(rows, "request_id string, attempt int, event string, status string")
    got = {r["request_id"]: (r["retries"], r["final_status"]) for r in lg.request_summary(log).collect()}
    assert got == {"r": (1, "ok"), "u": (0, "unfinished")}
    assert [tuple(r) for r in lg.unfinished_attempts(log).collect()] == [("u", 1)]


def test_episode_outcomes(spark):
    rows = [("e1", 1, "inspect_payment"), ("e1", 2, "inspect_delivery"), ("e1", 3, "refund"), ("e2", 1, "deny"), ("e3", 1, "inspect_payment")]
    log = spark.createDataFrame(rows, "e string, step int, action string").withColumns({"correct": F.lit("refund"), "latency_ms": F.lit(1.0)})
    got = {r["e"]: r for r in ep.outcomes(log, ["e"], "correct").collect()}
    assert got["e1"]["success"] and got["e1"]["steps"] == 3 and got["e1"]["net_utility"] == pytest.approx(0.9)
    assert got["e2"]["critical_error"] and got["e2"]["net_utility"] == -2
    assert got["e3"]["escalated"] and got["e3"]["net_utility"] == -0.25


def test_hash_trees_locate_what_differs(spark):
    draw = random.Random(2)
    rows = [(i, draw.randrange(10**6)) for i in range(2000)]
    make = lambda r: spark.createDataFrame(r, "id int, x int").repartition(draw.randrange(1, 6))
    tree = au.hash_tree(make(rows))
    counts = {r["level"]: (r["n"], r["s"]) for r in tree.groupBy("level").agg(F.count("*").alias("n"), F.sum("rows").alias("s")).collect()}
    assert counts[0] == (1, 2000) and counts[1] == (16, 2000) and counts[2][1] == 2000
    assert au.tree_difference(tree, au.hash_tree(make(rows[::-1]))).count() == 0
    # A changed row touches its old and its new bucket, a repeated one its own: digests count as often as their rows.
    other = [(i, x + 1 if i == 77 else x) for i, x in rows] + [rows[5]]
    digests = lambda r: [d["d"][:2] for d in make(r).select(au.row_digest(make(r)).alias("d")).collect()]
    want = set(digests([rows[77]]) + digests([other[77]]) + digests([rows[5]]))
    found = au.tree_difference(tree, au.hash_tree(make(other))).collect()
    assert {r["bucket"] for r in found} == want and sum(r["rows_b"] - r["rows_a"] for r in found) == 1
    empty = au.hash_tree(make(rows[:1]).limit(0))
    assert empty.where("level = 0 and rows = 0 and bucket = ''").count() == 1 and au.tree_difference(tree, empty).agg(F.sum("rows_a")).first()[0] == 2000


def test_every_bit_of_the_digests_counts(spark):
    """Sums of words see a change in any of the digest's 64 places."""
    assert [p for at, n in au._WORDS for p in range(at, at + n)] == list(range(1, 65))


def test_runs_of_other_studies_or_data_are_refused(spark):
    base = [("a", "s", d, f"f{d}") for d in "xyz"]
    art = spark.createDataFrame([("p", "c", "a"), ("p", "c", "b")], "path string, checksum string, source string")
    runs = lambda more: spark.createDataFrame(base + more, "source string, study string, dataset string, fingerprint string")
    same = [("b", "s", d, f"f{d}") for d in "xyz"]
    assert au.merge_runs(art, runs=runs(same)).count() == 1
    cases = {
        "another study": [("b", "t", d, f"f{d}") for d in "xyz"], "another inventory": [*same[:2], ("b", "s", "z", "other")],
        "dataset is missing": same[:2], "dataset is not in the first run": [*same, ("b", "s", "w", "fw")],
    }
    for rule, more in cases.items():
        assert {r["rule"] for r in au.study_conflicts(runs(more)).collect()} == {rule}
        with pytest.raises(ValueError, match="cannot be merged"):
            au.merge_runs(art, runs=runs(more))


def test_an_unpaired_case_stops_a_comparison(spark):
    draw = random.Random(3)
    rows = [("d", m, f"c{i}", i % 2, draw.randrange(2)) for i in range(40) for m in "ab"]
    schema = "ds string, model string, case_id string, label int, prediction int"
    pair = lambda r: joins.paired(spark.createDataFrame(r, schema), ["ds"], "case_id", "model", "a", ["b"], {"label": F.col("label")})
    assert joins.require_paired(pair(rows)).count() == 40
    for bad in (rows[1:], rows[:-1], [*rows, rows[0]], [*rows[:-1], ("d", "b", "c39", 0, 1)]):
        with pytest.raises(Exception, match="unpaired case against b"):
            joins.require_paired(pair(bad)).collect()
