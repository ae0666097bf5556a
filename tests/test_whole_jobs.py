"""Readers and queries that must take every row, whatever the layout of the files or the size of a text."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from casemeter.operators import neighbours as nb, sparse_text as st
from casemeter.plans import catalog
from casemeter.sources import snapshots as io

catalog.load_all()


def test_shards_that_are_folders_of_parts(spark, tmp_path):
    spark.range(7).repartition(3).write.parquet(f"{tmp_path}/train-1.parquet")
    spark.range(4).write.parquet(f"{tmp_path}/test.parquet")
    spark.range(2).write.parquet(f"{tmp_path}/other.parquet")
    paths = [f"{tmp_path}/{name}" for name in ("train-1.parquet", "test.parquet/", "other.parquet")]
    read = io.read_shards(spark, paths, ["train", "test"], "id bigint")
    assert {r[0]: r[1] for r in read.groupBy("_official_split").count().collect()} == {"train": 7, "test": 4}
    with pytest.raises(ValueError, match="valid"):
        io.read_shards(spark, paths, ["train", "valid"])


def test_shard_files_in_one_folder(spark, tmp_path):
    (tmp_path / "data").mkdir()
    for name, n in (("train-0", 3), ("train-1", 2), ("test-0", 4), ("a-0", 1), ("b-0", 1), ("c-0", 1)):
        spark.range(n).coalesce(1).write.parquet(f"{tmp_path}/{name}")
        next((tmp_path / name).glob("part-*.parquet")).rename(tmp_path / "data" / f"{name}.parquet")
    read = io.read_shards(spark, [f"{tmp_path}/data"], ["train", "test"])
    assert {r[0]: r[1] for r in read.groupBy("_official_split").count().collect()} == {"train": 5, "test": 4}


def _lines(spark, folder, n):
    """An order-line table of ``n`` lines, each its own case."""
    day = F.lit("1995-06-17").cast("timestamp_ntz")
    rows = spark.range(n).select(
        F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), (F.col("id") * 7).alias("l_partkey"), (F.col("id") * 3).alias("l_suppkey"), F.lit(2.0).alias("l_quantity"),
        F.lit(9.5).alias("l_extendedprice"), F.lit(0.1).alias("l_discount"), day.alias("l_shipdate"), F.substring(F.lit("ANR"), (F.col("id") % 3 + 1).cast("int"), F.lit(1)).alias("l_returnflag"),
        F.lit("F").alias("l_linestatus"),
    )
    rows.write.parquet(f"{folder}/lineitem.parquet")


def test_paired_models_give_every_case(spark, tmp_path):
    _lines(spark, tmp_path, 90)
    rows = catalog.QUERIES["j4_paired_models"](spark, str(tmp_path)).collect()
    assert len(rows) == len({(r["case_id"], r["comparator"]) for r in rows}) == 180


def test_the_word_vocabulary_reads_every_document(spark, tmp_path):
    spark.createDataFrame([(i, f"shared own{i}") for i in range(40)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["term"]: r["documents"] for r in catalog.QUERIES["fe1_word_vocabulary"](spark, str(tmp_path)).collect()}
    assert found["shared"] == 40 and all(found[f"own{i}"] == found[f"shared own{i}"] == 1 for i in range(40))


def test_terms_of_texts_longer_than_a_batch(spark, monkeypatch):
    """Texts that lie across batches, between empty ones, give the terms that each has by itself; batches hold tokens, not texts."""
    monkeypatch.setattr(st, "_TOKENS", 500)
    draw = random.Random(3)
    some = lambda n: " ".join(draw.choice(["alpha", "bêta", "x", "Gamma", "of", "ab-cd"]) for _ in range(n))
    texts = [None, some(12_000), "", some(3), some(25_000), " ", some(700), *[some(40) for _ in range(60)], None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    words = [re.findall(r"\b\w\w+\b", (t or "").lower()) for t in texts]
    bags = [Counter(w + [" ".join(p) for p in zip(w, w[1:])]) for w in words]
    padded = [Counter((t or "").lower().split()) for t in texts]
    grams = [Counter() for _ in texts]
    for bag, own in zip(grams, padded):
        for w, n in own.items():
            p = f" {w} "
            for g in (p[i : i + k] for k in (3, 4, 5) for i in range(len(p) - k + 1)):
                bag[g] += n
    blocks, wants = [], []
    for terms, want in ((st.word_terms(F.col("text")), bags), (st.char_terms(F.col("text")), grams), (F.split(F.lower("text"), " "), [Counter([] if t is None else t.lower().split(" ")) for t in texts])):
        v = st.fit_vocabulary(docs, terms, 1000)
        total = sum(want, Counter())
        assert dict(zip(v.terms.to_pylist(), v.frequency.tolist())) == total
        assert dict(zip(v.terms.to_pylist(), v.documents.tolist())) == Counter(t for b in want for t in b)
        blocks.append((terms, v)), wants.append(want)
    names = [(k, t) for k, (_, v) in enumerate(blocks) for t in v.terms.to_pylist()]
    rows = {r["doc_id"]: r for r in st.encode(docs, blocks, ["doc_id", "text"], counts=True).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        assert rows[i]["text"] == text
        got = {names[p]: n for p, n in zip(rows[i]["indices"], rows[i]["values"])}
        assert got == {(k, t): n for k, want in enumerate(wants) for t, n in want[i].items()}
    largest = st._tokens(docs, [blocks[0][0]], []).mapInArrow(lambda batches: (pa.record_batch({"n": [b.nbytes]}) for b in batches), "n long").agg(F.max("n")).scalar()
    assert spark.range(1).select(largest.alias("n")).first()["n"] < 400_000


def test_runs_hold_whole_texts(monkeypatch):
    monkeypatch.setattr(st, "_TOKENS", 10)
    sizes = [1, 3, 45, 1, 9, 12, 2, 2, 30]
    first = [i == 0 for n in sizes for i in range(n)]
    token = [f"t{i}" for i in range(len(first))]
    table = pa.table({"_first": first, "_block": pa.array([0] * len(first), pa.int32()), "_token": token})
    runs = list(st._texts(iter(table.to_batches(max_chunksize=4))))
    assert [t for r in runs for t in r["_token"].to_pylist()] == token and len(runs) > 1
    assert all(r["_first"][0].as_py() for r in runs)
    assert [sum(part[0][2]) for _, _, part in st._blocks(iter(table.to_batches(max_chunksize=4)), [None])] == [r.num_rows for r in runs]


def test_grams_of_odd_words():
    for words in (["a", "été", "x" * 9, "中文字", "a\u0000b", "𝔘ni"], ["abc"], [], [chr(0x4E00 + i) * 2 for i in range(6000)]):
        code, bounds, names = st._grams(pa.array(words, pa.string()))
        shown = names.to_pylist()
        assert len(set(shown)) == len(shown)
        for k, w in enumerate(words):
            p = f" {w} "
            assert sorted(shown[c] for c in code[bounds[k] : bounds[k + 1]]) == sorted(p[i : i + n] for n in (3, 4, 5) for i in range(len(p) - n + 1))


def test_nearest_by_products_equals_all_differences():
    draw = np.random.default_rng(5)
    b = np.concatenate([draw.normal(size=(300, 16)), np.repeat(draw.normal(size=(1, 16)), 80, 0), 1e8 + draw.normal(size=(40, 16))])
    a = np.concatenate([b[250:330], draw.normal(size=(50, 16)), 1e8 + draw.normal(size=(20, 16))])
    for queries, rows in ((a, b), (a, b[:3]), (a[:0], b), (np.where(a == a[0, 0], np.nan, a), b), (a * 1e160, b * 1e160)):
        for k in (1, 15):
            with np.errstate(all="ignore"):
                d = nb._distances(queries, rows)
                row, column, distance = nb._closest(queries, rows, k)
            best = np.argsort(d, axis=1, kind="stable")[:, :k]
            assert column.tolist() == best.ravel().tolist() and row.tolist() == np.repeat(np.arange(len(queries)), best.shape[1]).tolist()
            assert np.array_equal(distance, np.take_along_axis(d, best, 1).ravel(), equal_nan=True)
    own, allowed = np.arange(len(b)) % 7, draw.random((len(a), 7)) < 0.4
    allowed[0] = False
    row, column, _ = nb._closest(a, b, 9, allowed, own)
    d = np.where(allowed[:, own], nb._distances(a, b), np.inf)
    for i in range(len(a)):
        want = [j for j in np.argsort(d[i], kind="stable")[:9] if np.isfinite(d[i, j])]
        assert column[row == i].tolist() == want


def test_predictions_are_written_compressed_and_found_again(spark, tmp_path):
    rows = spark.createDataFrame([(d, m, 1, f"{d}{m}{i}" * 40) for d in "ab" for m in "xy" for i in range(50)], "dataset string, model string, seed int, case_id string")
    io.write_predictions(rows.repartition(2), f"{tmp_path}/p")
    files = list((tmp_path / "p").rglob("part-*"))
    assert len(files) == 8 and sum(f.stat().st_size for f in files) < 200 * 40
    back = io.discover_results(spark, f"{tmp_path}/p", "case_id string", "*.json*", ["dataset", "model", "seed"])
    assert back.count() == 200 and {r[0] for r in back.select("model").distinct().collect()} == {"model=x", "model=y"}
