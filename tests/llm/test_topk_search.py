import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import topk_search as K


def brute(rows, queries, k):
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    q8 = lambda v: [math.floor(256 * float(np.float32(x))) for x in v]
    out = []
    for at, (qi, qv) in queries:
        if qi is None or not ok(qv):
            continue
        scored = sorted((-sum(a * b for a, b in zip(q8(qv), q8(v), strict=True)), i) for j, (i, v) in enumerate(rows) if i is not None and ok(v) and len(v) == len(qv) and j != at)
        out += [(qi, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = [(int(i), rng.normal(size=8).round(2).tolist()) for i in range(400)]
    out += [(1000 + i, out[7][1]) for i in range(30)]  # ties
    out += [(2000, None), (2001, [1.0] * 7 + [None]), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (2004, [1.0] * 3), (2006, [2.0] * 3), (None, [9.0] * 8), (50, [5.0] * 8), (2050, [-1.0] * 8)]
    return out


@pytest.mark.parametrize(("block", "k"), [(2048, 5), (3, 2), (2048, 1000)])
def test_against_brute_force(spark, monkeypatch, rows, block, k):
    monkeypatch.setattr(K, "QUERIES", block)
    monkeypatch.setattr(K, "ROWS", 64)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = K.top_k(df.withColumn("row", F.lit("clash")), F.expr("vec_id % 50 = 0 or vec_id in (2004, 1003)"), k=k).collect()
    asked = [(at, r) for at, r in enumerate(rows) if r[0] is not None and (r[0] % 50 == 0 or r[0] in (2004, 1003))]
    assert sorted(map(tuple, got)) == brute(rows, asked, k)


def test_negative_scores_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 1.0]), (1, [-1.0, -2.0]), (2, [-3.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in K.top_k(df, F.col("vec_id") == 0, k=1).collect()] == [(0, 1, 2, -2 * 65536)]
    assert [tuple(r) for r in K.top_k(df, df.where("vec_id = 0"), k=1).collect()] == [(0, 1, 0, 2 * 65536)]  # a table's rows meet all
    assert K.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0 and K.top_k(df, df.limit(0)).count() == 0


def test_large_components_take_part(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=64) * s).tolist()) for i, s in enumerate([1, 1, 1, 3e4, 5e4, 1e6, 1e9, 1e-9, 1] * 3)] + [(100, [50_000.0] * 64), (101, [1.0] * 64), (102, [-3e7] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = K.top_k(df, F.lit(True), k=4).collect()
    want = [(q, r, v, max(min(s, 2**63 - 1), -(2**63))) for q, r, v, s in brute(rows, list(enumerate(rows)), 4)]
    # scores beyond a long are equal there and go by id
    plain = [w for w in want if abs(w[3]) < 2**63 - 1]
    assert {tuple(r) for r in got if abs(r.score) < 2**63 - 1} >= {w for w in plain if not any(x[0] == w[0] and abs(x[3]) >= 2**63 - 1 for x in want)}
    assert [(r.vec_id, r.score) for r in got if r.query_id == 101 and r["rank"] == 1][0][1] == max(s for q, _, _, s in want if q == 101)


def test_only_listed_and_surviving_pairs_are_added_up():
    rng = np.random.default_rng(1)
    q, x = rng.integers(-99, 99, (20, 64)).astype(float), rng.integers(-99, 99, (1000, 64)).astype(float)
    scores = K._Scores(q, x, np.zeros((20, 1000), bool))
    i, j = scores.listed(5)
    exact = q @ x.T
    assert len(i) <= 20 * 5 * K.SLICES and (scores.resolve(i, j, "listed") == exact[i, j]).all()
    cutoff = np.array([np.sort(exact[a, j[i == a]])[-5] for a in range(20)])
    assert (cutoff <= np.sort(exact, axis=1)[:, -5]).all()
    i, j = scores.above(cutoff / K.SLICES)
    assert len(i) < 20 * 1000 / 5
    best = np.argsort(-exact, axis=1)[:, :5]
    assert all(set(best[a]) <= set(j[i == a]) for a in range(20))
