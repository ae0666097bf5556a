"""Lattice links, conversation repair and tree search: brute force, enumeration, SQL, and odd rows with their defined results."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from casemeter.llm import fp_search, lattice_links, queries, turn_repair

DATA = "/root/testdata/sf0.001"
TABLES = ("embeddings", "conversations", "documents", "benchmark")


@pytest.mark.parametrize("name", ["op11_lattice_links", "op12_lightest_repair", "op13_fp_search"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.execute(queries.CHECKS[name]).df()
    got = queries.QUERIES[name](spark, DATA).toPandas()
    order = list(want.columns[:2])
    pd.testing.assert_frame_equal(got[list(want.columns)].sort_values(order, ignore_index=True), want.sort_values(order, ignore_index=True), check_dtype=False)


# ---- lattice ----------------------------------------------------------------------------


def test_decode_gives_the_nearest_lattice_point():
    x = np.random.default_rng(3).normal(size=(500, 8)) * 3
    at = lattice_links.decode(x)
    assert ((at * 2 % 1 == 0).all()) and (at.sum(1) % 2 == 0).all() and (((at % 1 == 0).all(1)) | ((at % 1 == 0.5).all(1))).all()
    gap = ((x - at) ** 2).sum(1)
    for step in lattice_links._NEIGHBOURS:
        assert (gap <= ((x - at - step) ** 2).sum(1) + 1e-12).all()
    assert gap.max() <= 1 + 1e-9  # the covering radius of E8


def _pairs(vectors, cosine):
    x = np.array(vectors, float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    return near


def _turned(draw, base, cosine):
    away = draw.normal(size=len(base))
    away -= away @ base * base
    return cosine * base + math.sqrt(1 - cosine**2) * away / np.linalg.norm(away)


def _ball(seed, n=300, copies=200):
    """Vectors with partners at cosines around the threshold, a crowd of close ones, and exact copies."""
    draw = np.random.default_rng(seed)
    base = draw.normal(size=(n, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    near = [_turned(draw, b, c) for b in base[:150] for c in (0.94, 0.951, 0.97)]
    crowd = [_turned(draw, base[-1], 0.99) for _ in range(copies)]
    return [*base, *near, *crowd, *base[:20], *(3 * base[:10])]


def test_links_against_all_pairs(spark):
    vectors = [v.tolist() for v in _ball(1)]
    near = _pairs(vectors, 0.95)
    frame = spark.createDataFrame([(k, v, "a") for k, v in enumerate(vectors)], "vec_id long, embedding array<double>, node string")
    # Small blocks, so that the crowd's cells are cut into many pairs of blocks.
    got = lattice_links.classify(frame, block=32).orderBy("vec_id").collect()
    found, links = np.array([r["n_links"] for r in got]), near.sum(1)
    assert (found <= links).all() and found.sum() >= 0.99 * links.sum()
    crowd = np.arange(750, 950)
    assert (found[crowd] == links[crowd]).all()
    for k in range(len(vectors)):  # components: no wider than by all pairs, and copies always with their first
        assert got[k]["component_id"] <= k and got[k]["kept"] == (got[k]["component_id"] == k)
    assert [got[950 + k]["component_id"] for k in range(20)] == [got[k]["component_id"] for k in range(20)]
    again = lattice_links.classify(frame.repartition(7), block=1024).orderBy("vec_id").collect()
    assert again == got
    assert lattice_links.recall(frame).first()["links"] == sum(near[k].sum() for k in range(0, len(vectors), 50))


def test_odd_vectors(spark):
    a, b = [1.0, 0.0, 0.0], [0.99, 0.01, 0.0]
    rows = [
        (1, a), (2, b), (3, None), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 0.0]), (6, [float("nan"), 1.0, 0.0]), (7, [float("inf"), 0.0, 0.0]), (8, []),
        (9, [1.0, 0.0]), (10, [2.0, 0.0, 0.0]), (10, [2.0, 0.0, 0.0]), (None, a), (11, [-1.0, 0.0, 0.0]), (12, [-0.0, 0.0, 5e-324]), (13, [1e308, 1e308, 0.0]),
        (14, [1e-300, 1e-300, 0.0]), (None, None),
    ]
    frame = spark.createDataFrame([(k, v, 1, "x") for k, v in rows], "vec_id long, embedding array<double>, weight int, digest string")
    got = sorted(map(tuple, lattice_links.classify(frame).collect()), key=repr)
    want = [(1, 4, 1, True), (2, 4, 1, False), (10, 4, 1, False), (10, 4, 1, False), (None, 4, 1, False), (13, 1, 13, True), (14, 1, 13, False), (None, 0, None, True)]
    want += [(k, 0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 11, 12)]
    assert got == sorted(want, key=repr)
    assert lattice_links.classify(frame.limit(0)).count() == 0


# ---- repair -----------------------------------------------------------------------------


def _enumerated(rows):
    """The least (cost, audit) over all derivations with at most three insertions between rows."""

    @lru_cache(None)
    def rest(i, state, inserted):
        ways = [(0, "")] if i == len(rows) and state in (0, 3) else []
        steps = {0: "su", 1: "u", 2: "a", 3: "u"}[state]
        to = lambda r: {"s": 1, "u": 2, "a": 3}[r]
        if inserted < 3:
            ways += [(c + 3, "I" + a) for r in "ua" if r in steps for c, a in [rest(i, to(r), inserted + 1)]]
        if i < len(rows):
            initial, fault = rows[i]
            options = [("D", "", 4)]
            if fault not in "bd":
                options += [("K", initial, 0)] + [("R", r, 3) for r in "ua"]
            for letter, r, cost in options:
                if not r or r in steps:
                    c, a = rest(i + 1, to(r) if r else state, 0)
                    ways.append((c + cost + (3 if fault == "t" and r else 0), letter + a))
        return min(ways, default=(10**9, ""))

    return rest(0, 0, 0)


@pytest.mark.parametrize("piece", [1, 2, 3, 4096])
def test_agenda_against_enumeration(monkeypatch, piece):
    monkeypatch.setattr(turn_repair, "PIECE", piece)
    draw = random.Random(piece)
    for _ in range(1500):
        rows = tuple(draw.choice("suuaax") + draw.choice("---tbd") for _ in range(draw.randrange(9)))
        one = turn_repair.Repair()
        for row in reversed(rows):
            one.add(*row)
        assert one.result() == _enumerated(rows), rows


def test_a_long_conversation_is_repaired_in_pieces(spark):
    n = 20_000
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"line {k}.") for k in range(n)]
    got = turn_repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), damage=False).first()
    body = "\n".join(f"{r}:{t}" for _, _, r, t in rows)
    assert (got["cost"], got["audit"], got["repaired_rows"]) == (0, "K" * n, n)
    assert got["repaired_sha256"] == hashlib.sha256(body.encode()).hexdigest()


def _repaired(rows):
    """The contract, row by row: ``rows`` of one conversation as (conv, turn, role, text)."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
    marks, seen, count = [], set(), Counter()
    for _, role, text in out:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "-"
        seen.add((role, text))
        count[fault] += 1
        marks.append((role[0] if role[:1] in set("sua") else "x") + fault)
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(out, out[1:]))
    turns = {t for t, _, _ in out if t is not None}
    cost, audit = _enumerated(tuple(marks))
    body, k, state = [], 0, "-"
    for letter in audit:
        fresh = "assistant" if state == "u" else "user"
        role, text = ("", "") if letter == "I" else out[k][1:]
        k += letter != "I"
        if letter != "D":
            role = role if letter == "K" else fresh
            state = role[0]
            body.append(f"{role}:{text}")
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, count["b"], count["d"], count["t"], illegal, cost, audit, hashlib.sha256("\n".join(body).encode()).hexdigest()


def test_conversations_with_odd_rows(spark):
    draw = random.Random(9)
    texts = [None, "", " \t\n", "Yes.", "No!", "What?", "open end", "stop. \r\n", "dot. ", "é.", "x" * 200_000 + ".", "Yes."]
    rows = []
    for conv in [None, *range(150)]:
        for _ in range(draw.randrange(1, 8)):
            role = draw.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None, "usher", "User"])
            rows.append((conv, draw.choice([None, -3, 0, 1, 2, 3, 4, 5, 9]), role, draw.choice(texts)))
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, n int, digest string")
    got = turn_repair.repair(frame).collect()
    by = {c: [r for r in rows if r[0] == c] for c in {r[0] for r in rows}}
    assert len(got) == len(by)
    for r in got:
        assert tuple(r)[1:8] + (r["repaired_sha256"],) == _repaired(by[r["conv_id"]]), by[r["conv_id"]]
    assert turn_repair.repair(frame.limit(0)).count() == 0


def test_a_conversation_that_loses_all_rows(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = turn_repair.repair(spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", 0, hashlib.sha256(b"").hexdigest())]


# ---- search -----------------------------------------------------------------------------


def _terms(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def _ranked(docs, items, top):
    tf = [(k, Counter(_terms(t))) for k, t in docs]
    tf = [(k, c) for k, c in tf if c]
    n, total = len(tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    out = []
    for item, text in items:
        w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in set(_terms(text)) if df[t]}
        scored = []
        for k, c in tf:
            m = 50 + 50 * sum(c.values()) * n // total
            score = sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in w if c[t])
            if score > 0:
                scored.append((-score, k is None, k or 0, k))
        out += [(item, r + 1, k, -s) for r, (s, _, _, k) in enumerate(sorted(scored)[:top])]
    return out


@pytest.mark.parametrize("leaf, trie, item_bytes", [(64, 1 << 14, 1 << 20), (2, 16, 1 << 20), (5, 40, 600)])
def test_search_against_every_score(spark, monkeypatch, leaf, trie, item_bytes):
    monkeypatch.setattr(fp_search, "LEAF", leaf)
    monkeypatch.setattr(fp_search, "TRIE", trie)
    draw = random.Random(leaf)
    word = lambda: "w" + str(int(draw.paretovariate(0.6)) % 300)
    docs = [(k, " ".join(word() for _ in range(draw.randrange(1, 60)))) for k in range(400)]
    docs += [(1000 + k, docs[7][1]) for k in range(90)] + [(5, docs[5][1]), (None, docs[7][1]), (401, None), (402, ""), (403, " -- .. "), (404, "W1 w1-É É " * 3000)]
    items = [(k, " ".join(word() for _ in range(12))) for k in range(25)]
    items += [(3, items[3][1]), (50, docs[7][1]), (51, None), (52, ""), (53, "nowhere"), (None, "w1 W1 é É"), (54, docs[404 if len(docs) > 404 else 0][1])]
    schema = "{} long, text string, terms int, rank string, item int"
    d = spark.createDataFrame([(k, t, 1, "x", 2) for k, t in docs], schema.format("doc_id")).repartition(5)
    i = spark.createDataFrame([(k, t, 1, "x", 2) for k, t in items], schema.format("item_id"))
    got = fp_search.search(d, i, 20, item_bytes=item_bytes).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(_ranked(docs, items, 20), key=key)


def test_search_of_empty_tables_and_pruning(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert fp_search.search(docs.limit(0), items).count() == 0 and fp_search.search(docs, items.limit(0)).count() == 0
    assert fp_search.search(docs, items.limit(2).withColumn("text", F.lit("..."))).count() == 0
    work = fp_search.work(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")).first()
    assert 0 < work["scored"] < 0.8 * work["pairs"]
