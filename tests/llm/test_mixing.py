import random

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def brute_targets(sizes, weights, share, cap):
    """Share by weight, cut at the cap, share what is above again, until nothing is."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    t, free, rest = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while free and rest > 1e-9:
        total, extra = sum(w[s] for s in free), 0.0
        for s in list(free):
            t[s] += rest * w[s] / total
            if t[s] >= cap * sizes[s]:
                extra += t[s] - cap * sizes[s]
                t[s] = cap * sizes[s]
                free.discard(s)
        rest = extra
    return t


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 60))), rng.choice(["a"] * 10 + ["b", "c", "d", None])) for i in range(3000)]
    return spark.createDataFrame(rows + [(None, None, "b"), (5000, "", None), (7, "x y", "Z")] * 2, SCHEMA).cache()


def test_targets_and_takes(docs):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == docs.count()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = brute_targets(sizes, (5, 2, 1), 1.5, 2)
    took = dict.fromkeys(sizes, 0)
    for r in rows:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert r.taken == r.copies * r.size <= 2 * r.size
        took[r.source] += r.taken
    for s, t in took.items():
        assert abs(t - want[s]) <= 60


def test_one_read_agrees_and_reruns_agree(docs):
    key = lambda df: sorted(map(repr, df.select("doc_id", "taken").collect()))
    full = key(mixing.mix_sources(docs))
    assert full == key(mixing.mix_sources(docs, carry=["doc_id"])) == key(mixing.mix_sources(docs.repartition(7)))


def test_rows_of_the_mix(docs):
    taken = mixing.mix_sources(docs).agg(F.sum("copies")).first()[0]
    mixed = mixing.mixed_rows(docs.withColumn("size", F.lit("clash")))
    assert mixed.columns == ["doc_id", "text", "source", "size"] and mixed.count() == taken


def test_clashing_columns_and_empty(spark, docs):
    clash = docs.withColumn("size", F.lit("x")).withColumn("taken", F.lit(None).cast("string"))
    assert dict(mixing.mix_sources(clash).dtypes)["size"] == "bigint"
    assert mixing.mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0
    only = mixing.mix_sources(spark.createDataFrame([(1, None, None), (2, "", "a")], SCHEMA)).collect()
    assert [(r.target, r.taken) for r in only] == [(0.0, 0), (0.0, 0)]


@pytest.mark.parametrize("words", ["one", "two words", "a b c d e"])
def test_targets_where_rows_repeat(spark, words):
    """Half of a source is one row, a hundred times; the boundary may fall among its copies."""
    n = len(words.split())
    rows = [(1, words, "a")] * 100 + [(10 + i, "x " * n, "a") for i in range(100)]
    took = mixing.mix_sources(spark.createDataFrame(rows, SCHEMA)).agg(F.sum("taken"), F.first("target")).first()
    assert abs(took[0] - took[1]) <= n
    apart = spark.createDataFrame([(1, words, "a", i) for i in range(200)], SCHEMA + ", in_3 long")
    first = sorted(map(tuple, mixing.mix_sources(apart).select("in_3", "taken").collect()))
    assert first == sorted(map(tuple, mixing.mix_sources(apart.repartition(5)).select("in_3", "taken").collect())) and sum(t for _, t in first) == 300 * n


def test_many_sources_and_split_sources(spark, docs, monkeypatch):
    from palimpsest.llm import joins

    want = sorted(map(repr, mixing.mix_sources(docs).collect()))
    monkeypatch.setattr(mixing, "ONE_TASK", 0)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(joins, "HOT_ROWS", 500)
    assert sorted(map(repr, mixing.mix_sources(docs).collect())) == want
