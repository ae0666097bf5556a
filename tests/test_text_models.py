"""Sparse texts, factors, naive Bayes and tree builders against NumPy, in odd cases and at any partitioning."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from casemeter.operators import boosting as bo, extra_trees as xt, representations as rp, sparse_text as st, svd, text_bayes as nb

TEXTS = ["The cat sat, the cat ran", "a dog ran far", "Cat and dog", "", None, "x y z", "ÉTÉ été cat", "dog " * 300]


def texts(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(rows)], "doc_id int, text string, label int")


def dense(rows, width):
    out = {}
    for r in rows.collect():
        out[r["doc_id"]] = np.zeros(width)
        out[r["doc_id"]][r["indices"]] = r["values"]
    return np.array([out[k] for k in sorted(out)])


def test_vocabulary_and_weights_by_hand(spark):
    terms = st.word_terms(F.col("text"))
    v = st.fit_vocabulary(texts(spark).repartition(3), terms, 6)
    words = [[w for w in (t or "").lower().replace(",", "").split() if len(w) > 1] for t in TEXTS]
    bags = [Counter(w + [" ".join(p) for p in zip(w, w[1:])]) for w in words]
    total = sum(bags, Counter())
    kept = sorted(sorted(total, key=lambda t: (-total[t], t.encode()))[:6], key=str.encode)
    assert v.terms.to_pylist() == kept and v.frequency.tolist() == [total[t] for t in kept]
    df = np.array([sum(t in b for b in bags) for t in kept])
    assert v.documents.tolist() == df.tolist() and v.rows == len(TEXTS)
    want = np.array([[(1 + math.log(b[t])) * (math.log((1 + len(TEXTS)) / (1 + d)) + 1) if b[t] else 0 for t, d in zip(kept, df)] for b in bags])
    norms = np.linalg.norm(want, axis=1, keepdims=True)
    rows = st.encode(texts(spark), [(terms, v)], ["doc_id"])
    assert dense(rows, 6) == pytest.approx(want / np.where(norms > 0, norms, 1))
    counts = dense(st.encode(texts(spark), [(terms, v)], ["doc_id"], counts=True), 6)
    assert counts.tolist() == [[b[t] for t in kept] for b in bags]


def test_blocks_stand_side_by_side(spark):
    blocks = [(t, st.fit_vocabulary(texts(spark), t, 40)) for t in (st.word_terms(F.col("text")), st.char_terms(F.col("text")))]
    both, first = dense(st.encode(texts(spark), blocks, ["doc_id"]), st.width(blocks)), dense(st.encode(texts(spark), blocks[:1], ["doc_id"]), len(blocks[0][1]))
    assert (both[:, : first.shape[1]] == first).all() and len(both) == len(TEXTS)
    energy = (both**2).sum(1).round(9)
    assert set(energy.tolist()) <= {0.0, 1.0, 2.0} and energy[4] == 0
    assert all(r["indices"] == sorted(r["indices"]) for r in st.encode(texts(spark), blocks, ["doc_id"]).collect())


def test_no_term_at_all(spark):
    empty = texts(spark).limit(0)
    terms = st.word_terms(F.col("text"))
    v = st.fit_vocabulary(empty, terms, 10)
    assert len(v) == 0 and dense(st.encode(texts(spark), [(terms, v)], ["doc_id"]), 1).sum() == 0
    with pytest.raises(ValueError):
        st.fit_vocabulary(empty, terms, st.MAX_TERMS + 1)


def sparse(spark, x, parts=3):
    rows = [(i, np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist()) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "doc_id int, indices array<int>, values array<double>").repartition(parts)


@pytest.mark.parametrize("shape, rank", [((300, 700), 12), ((40, 900), 64), ((500, 30), 30), ((6, 5), 3)])
def test_factors_against_numpy(spark, monkeypatch, shape, rank):
    monkeypatch.setattr(svd, "_PIECE", 500)
    draw = np.random.default_rng(shape[0])
    x = draw.normal(size=shape) * (draw.random(shape) < 0.2) * 0.97 ** np.arange(shape[1])
    x[0] = 0
    rows = sparse(spark, x)
    f = svd.fit(rows, shape[1], rank, rounds=8)
    s, vt = np.linalg.svd(x, full_matrices=False)[1:]
    k = min(rank, min(shape) - 1)
    assert len(f.values) == k and f.values == pytest.approx(s[:k], rel=0.02)
    assert f.components.T @ f.components == pytest.approx(np.eye(k), abs=1e-9)
    assert np.abs((f.components[:, :3] * vt[:3].T).sum(0)) == pytest.approx(np.ones(min(3, k)), abs=1e-3)
    got = np.array([r["svd"] for r in svd.project(rows, f.components).orderBy("doc_id").collect()])
    assert got == pytest.approx(x @ f.components)
    assert svd.residuals(rows, f).max() < 0.02
    fitted = svd.centre(svd.project(rows, f.components), "svd", k)
    scaled = np.array([r["z"] for r in svd.scale(svd.project(rows, f.components), "svd", fitted, "z").collect()])
    assert scaled.mean(0) == pytest.approx(np.zeros(k), abs=1e-9) and scaled.std(0) == pytest.approx(np.ones(k))


def test_factor_bound(spark):
    with pytest.raises(ValueError, match="directions"):
        svd.fit(sparse(spark, np.eye(200)), svd.MAX_ENTRIES, 64)


def test_bayes_against_numpy(spark):
    draw = np.random.default_rng(5)
    x = draw.random((60, 20)) * (draw.random((60, 20)) < 0.3)
    y = draw.integers(0, 3, 60)
    x[7] = 0
    rows = sparse(spark, x).join(spark.createDataFrame([(i, int(c)) for i, c in enumerate(y)], "doc_id int, label int"), "doc_id")
    model, prior = nb.fit(rows, "label", 20, 0.5)
    mass = np.array([x[y == c].sum(0) for c in range(3)])
    logs = np.log((mass + 0.5) / (mass.sum(1, keepdims=True) + 0.5 * 20))
    want = x @ logs.T + np.log(np.bincount(y) / 60)
    scores = nb.joint(rows, "doc_id", model, prior)
    got = np.zeros((60, 3))
    for r in scores.collect():
        got[r["doc_id"], r["label"]] = r["log_joint"]
    assert got == pytest.approx(want)
    for r in nb.predict(scores, "doc_id").collect():
        p = np.exp(want[r["doc_id"]] - want[r["doc_id"]].max())
        assert r["prediction"] == want[r["doc_id"]].argmax() and r["probability"] == pytest.approx(p.max() / p.sum())


def test_representations_of_every_family(spark):
    draw = np.random.default_rng(6)
    vocabulary = [f"word{k}" for k in range(60)]
    rows = [" ".join(draw.choice(vocabulary[20 * (i % 2) : 20 * (i % 2) + 40], 30)) for i in range(80)] + [None, ""]
    docs = texts(spark, rows)
    fitted = rp.TextRepresentations(docs.where("doc_id < 60"), "doc_id", "text", "label", 100, 80, 12, 5)
    for family, name in rp.FAMILIES.items():
        got = fitted.for_family(docs, family, ["doc_id", "label"]).orderBy("doc_id").collect()
        assert len(got) == len(rows)
        column = "vector" if name in ("dense", "knn") else "values"
        if column == "vector":
            assert {len(r["vector"]) for r in got} == {fitted.width(name)}
        else:
            assert max(max(r["indices"], default=0) for r in got) < fitted.width(name)
    # Terms that only one class has are the ones that the class tells apart.
    names = np.array(fitted.word_block[1].terms.to_pylist())[fitted.chosen]
    assert all(not any(20 <= int(w[4:]) < 40 for w in n.split()) or " " in n for n in names)
    with pytest.raises(ValueError):
        fitted.transform(docs, "unknown", ["doc_id"])


# ---- trees ------------------------------------------------------------------------------


def blobs(seed, n=900, classes=3, dims=6):
    """Classes told apart by two features together, and four features of noise."""
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, dims))
    y = (x[:, 1] > 0).astype(int) + ((x[:, 1] > 0) & (x[:, 4] > 0.3)).astype(int)
    return x, y % classes


def frame(spark, x, y, parts=3):
    rows = [(i, [float(v) for v in r], int(c), bool(i % 4 == 0)) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id int, v array<double>, y int, held boolean").repartition(parts)


def test_boosting_learns_and_stops(spark):
    x, y = blobs(1)
    model = bo.fit(frame(spark, x, y), "v", "y", 3, 6, rounds=30, depth=2, rate=0.4, held="held", patience=4, refresh=3)
    fresh, truth = blobs(2)
    got = {r["id"]: r for r in bo.predict(model, frame(spark, fresh, truth), "v", ["id"]).collect()}
    right = np.mean([got[i]["raw"] == c for i, c in enumerate(truth)])
    assert right > 0.95 and abs(sum(got[0]["probabilities"]) - 1) < 1e-9
    assert len(model.rounds) == int(np.argmin(model.losses)) and model.losses[0] > 1 > min(model.losses)
    used = {int(t.feature[n]) for trees in model.rounds[:2] for t in trees for n in range(len(t.feature)) if t.feature[n] >= 0}
    assert used <= {1, 4}


def test_boosting_ignores_partitions_and_refreshes(spark):
    x, y = blobs(3, 300)
    a, b = (bo.fit(frame(spark, x, y, p), "v", "y", 3, 6, rounds=4, depth=2, refresh=r).frame(spark).collect() for p, r in ((1, 25), (5, 2)))
    assert a == b


def test_every_split_is_the_best_by_brute_force(spark):
    x, y = blobs(4, 200)
    model = bo.fit(frame(spark, x, y), "v", "y", 3, 6, rounds=3, depth=2, min_rows=7, bins=16)
    bins = model.bins.place(x)
    for r, trees in enumerate(model.rounds):
        p = bo._softmax(bo.Boosted(model.bins, model.prior, 2, model.rounds[:r]).scores(bins))
        for c, tree in enumerate(trees):
            g, h = bo._whole((y == c) - p[:, c]), bo._whole(p[:, c] * (1 - p[:, c]))
            for level in range(2):
                at = tree.nodes(bins, level)
                for n in range((1 << level) - 1, (1 << (level + 1)) - 1):
                    rows = np.flatnonzero(at == n)
                    if not len(rows):
                        continue
                    part = lambda k: g[k].sum() ** 2 / (h[k].sum() + bo._UNIT)
                    best = (0.0, 0, -1)
                    for f in range(6):
                        for s in range(1, 17):
                            left, right = rows[bins[rows, f] <= s], rows[bins[rows, f] > s]
                            if min(len(left), len(right)) >= 7:
                                best = max(best, (round((part(left) + part(right) - part(rows)) / bo._UNIT, 6), -s, -f), key=lambda b: (b[0], b[2], b[1]))
                    assert (tree.gain[n], tree.feature[n], tree.split[n]) == ((best[0], -best[2], -best[1]) if best[0] > 1e-6 else (0, -1, 0))


def test_missing_values_constant_features_and_absent_classes(spark):
    x, y = blobs(5, 200)
    x[::5, 1] = np.nan
    x[:, 3] = 2.0
    rows = frame(spark, x, y).unionByName(spark.createDataFrame([(1000, None, 0, False), (1001, [None] * 6, 1, False)], "id int, v array<double>, y int, held boolean"))
    model = bo.fit(rows, "v", "y", 5, 6, rounds=3, depth=2)
    assert bo.predict(model, rows, "v", ["id"]).where("raw between 0 and 2").count() == 202
    forest = xt.fit(rows, "v", "y", 5, 6, trees=4, depth=3)
    assert xt.predict(forest, rows, "v", ["id"]).where("abs(aggregate(probabilities, 0D, (a, p) -> a + p) - 1) < 1e-9").count() == 202
    with pytest.raises(Exception, match="features"):
        bo.matrix(pa.array([[1.0, 2.0]]), 3)
    with pytest.raises(ValueError):
        bo.fit(rows, "v", "y", 1000, 6000, depth=8)


def test_forest_learns_and_ignores_partitions(spark):
    x, y = blobs(6)
    forest = xt.fit(frame(spark, x, y), "v", "y", 3, 6, trees=30, depth=7, tried=4, min_rows=2, seed=3)
    fresh, truth = blobs(7)
    got = {r["id"]: r["raw"] for r in xt.predict(forest, frame(spark, fresh, truth), "v", ["id"]).collect()}
    assert np.mean([got[i] == c for i, c in enumerate(truth)]) > 0.9
    again = xt.fit(frame(spark, x, y, 7), "v", "y", 3, 6, trees=30, depth=7, tried=4, min_rows=2, seed=3)
    assert again.frame(spark).collect() == forest.frame(spark).collect()
    for tree in forest.trees:
        for n, node in tree.items():
            if node.feature >= 0:
                assert node.low[node.feature] <= node.cut <= node.high[node.feature]
                assert (tree[2 * n + 1].counts + tree[2 * n + 2].counts == node.counts).all() and min(tree[2 * n + 1].counts.sum(), tree[2 * n + 2].counts.sum()) >= 2


# ---- kernels ----------------------------------------------------------------------------


def test_landmarks_reproduce_the_kernel(spark):
    from casemeter.operators import kernels as kn

    x, _ = blobs(8, 120)
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, v array<double>").repartition(4)
    marks = kn.fit(rows, "id", "v", 6, 0.3, 40, 1)
    again = kn.fit(rows.repartition(2), "id", "v", 6, 0.3, 40, 1)
    assert marks.ids == again.ids and len(set(marks.ids)) == 40
    odd = spark.createDataFrame([(500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0])], "id int, v array<double>")
    got = {r["id"]: r["kernel"] for r in kn.transform(marks, rows.unionByName(odd), "v").collect()}
    assert got[500] is None and got[501] is None and len(got) == 122
    z = np.array([got[i] for i in range(120)])
    exact = kn.rbf(x, x, 0.3)
    assert z @ z[marks.ids].T == pytest.approx(exact[:, marks.ids], abs=1e-6)
    # Between other rows the error falls as landmarks are added, and is gone when all rows are.
    errors = []
    for count in (10, 40, 120):
        m = kn.fit(rows, "id", "v", 6, 0.3, count, 1)
        w = kn.rbf(x, m.rows, 0.3) @ m.root
        errors.append(np.abs(w @ w.T - exact).mean())
    assert errors[0] > errors[1] > errors[2] and errors[2] < 1e-6
    with pytest.raises(ValueError):
        kn.fit(rows, "id", "v", 6, 0.3, kn.MAX_LANDMARKS + 1)
    with pytest.raises(ValueError, match="no training row"):
        kn.fit(odd, "id", "v", 6, 0.3)
