import math
import os
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from palimpsest.llm import toxicity as X

GROUPS, INSULTS = ["blue", "green"], ["awful", "nasty"]


def corpus(n, seed):
    """Toxic only where an insult and a group are mentioned together; either alone is harmless."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{rng.randint(0, 60)}x".replace("0", "a").replace("1", "b") for _ in range(rng.randint(5, 15))]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words += [rng.choice(INSULTS)] * insult + [rng.choice(GROUPS)] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(insult and group)))
    return rows


@pytest.fixture(scope="module")
def scored(spark):
    rows = corpus(1500, 4)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "awful green"), (9001, None), (9002, "")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, None), (None, 1), (7, 9)], "doc_id long, toxic int")
    model = X.train(docs, labels, epochs=40)
    out = X.score_toxicity(docs.withColumn("held_out", X.fold(F.col("doc_id")) == 0), model)
    return {i: y for i, _, y in rows}, out.collect(), model, (docs, labels)


def test_pairs_of_terms_are_learnt_on_held_out_rows(scored):
    y, rows, _, _ = scored
    held = [r for r in rows if r.held_out and r.doc_id in y]
    right = [r.predicted == y[r.doc_id] for r in held]
    assert len(held) > 200 and np.mean(right) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in held)


def test_rows_and_ranges(scored):
    _, rows, _, _ = scored
    assert len(rows) == 1503 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[9001].score == by[9002].score and by[None].held_out


def test_same_model_from_other_partitions(scored):
    _, _, model, (docs, labels) = scored
    again = X.train(docs.repartition(5), labels.repartition(3), epochs=40)
    assert np.allclose(model.w, again.w) and model.bias == pytest.approx(again.bias)


def test_margin_is_the_pairwise_sum():
    rng = np.random.default_rng(0)
    fm = X.FactorizationMachine(0.3, rng.normal(size=5), rng.normal(size=(5, 3)))
    pairs = sum(fm.v[i] @ fm.v[j] for i, j in ((0, 2), (0, 4), (2, 4)))
    assert fm.margin(np.array([0, 2, 4]), np.array([3, 0])) == pytest.approx([0.3 + fm.w[[0, 2, 4]].sum() + pairs, 0.3])


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = X.train(docs, none)
    assert model is None and X.score_toxicity(docs, model).first().score == 0
    assert X.score_toxicity(docs.limit(0), None).count() == 0


def _hash(term):
    return xxhash.xxh64_intdigest(term.encode(), 7) % 2**20


def brute_score(text, fm):
    """Terms hashed one by one, and a double loop over their pairs."""
    found = set()
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        found |= {_hash(word)} | {_hash(word[:n] + "*") for n in (4, 5, 6) if len(word) > n}
    live = sorted(i for i in found if fm.w[i] or fm.v[i].any())
    z = fm.bias + sum(float(fm.w[i]) for i in live)
    for a, i in enumerate(live):
        for j in live[a + 1 :]:
            z += float(fm.v[i].astype(float) @ fm.v[j].astype(float))
    return 1 / (1 + math.exp(-min(max(z, -30), 30)))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_scores_of_all_documents_by_brute_force(spark):
    from palimpsest.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = X.train(docs.select("doc_id", "text"), labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = queries.op3_toxicity(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert r.score == pytest.approx(brute_score(texts[r.doc_id], model), abs=1e-4) and r.predicted == (r.score >= 0.5)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables here")
def test_held_out_rows_of_the_given_labels(spark):
    from palimpsest.llm import queries

    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    rows = queries.op3_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(labels, "doc_id").collect()
    caught = np.mean([r.predicted for r in rows if r.toxic])
    wrong = np.mean([r.predicted for r in rows if not r.toxic])
    assert len(rows) > 700 and caught > 0.75 and wrong < 0.02


def test_parts_of_a_large_sample(spark, monkeypatch):
    """A sample beyond what the driver holds is read in parts; every term still counts."""
    rows = corpus(600, 8)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    monkeypatch.setattr(X, "HELD_TERMS", 3000)
    out = X.score_toxicity(docs, X.train(docs, labels, epochs=20)).join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in out]) > 0.9


def test_very_long_words_and_texts(spark):
    model = X.FactorizationMachine(0.0, np.ones(1 << 20, np.float32), np.zeros((1 << 20, 2), np.float32))
    cached = X.TextTerms()
    assert len(cached.of("x" * 2_000_000 + " " + "y " * 500_000)) == 5 and list(cached) == ["y"]
    docs = spark.createDataFrame([(1, "x" * 1_000_000), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.score for r in X.score_toxicity(docs, model).collect()}[2] == 0.5
