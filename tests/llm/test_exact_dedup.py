import hashlib
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import exact_dedup

ROWS = [(3, "a  b"), (1, "a\tb"), (2, "a b"), (4, "A b"), (5, None), (6, ""), (6, ""), (7, " x"), (8, " x"), (None, "a b"), (None, "only null"), (None, "only  null"), (9, "z" * 50_000), (10, "z" * 50_000)]


def brute(rows):
    groups = {}
    for i, (d, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append((d is None, d or 0, i))
    out = []
    for t, members in groups.items():
        best = min(members)
        for m in members:
            out.append((rows[m[2]][0], None if best[0] else best[1], len(members), m == best, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def flat(rows):
    """Which of several rows that repeat an id stays is free."""
    return sorted(((r[0], r[1], r[2], r[4]) for r in rows), key=repr), sum(r[3] for r in rows)


@pytest.mark.parametrize("bits", [128, 4])
def test_groups_against_brute_force(spark, bits):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in exact_dedup.exact_groups(df, hash_bits=bits).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert flat(got) == flat(brute(ROWS))
    kept = [r for r in got if r[3]]
    assert len({r[4] for r in kept}) == len(kept)


@pytest.mark.parametrize("bits", [128, 4])
@pytest.mark.parametrize("limit", [500_000, 2, 0])
def test_dedup_keeps_one_row_of_each_text(spark, monkeypatch, bits, limit):
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", limit)
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("h", F.lit("clash")).withColumn("norm", F.lit(1))
    out = exact_dedup.exact_dedup(df, hash_bits=bits)
    assert out.columns == ["doc_id", "text", "h", "norm"]
    want = sorted((r[0], r[4]) for r in brute(ROWS) if r[3] and r[0] is not None)
    rows = [(r.doc_id, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "").encode()).hexdigest()) for r in out.collect()]
    assert sorted(r for r in rows if r[0] is not None) == want
    assert len([r for r in rows if r[0] is None]) == 1


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_groups(df).count() == 0 and exact_dedup.exact_dedup(df).count() == 0


def test_rows_equal_in_id_and_text_that_differ_elsewhere(spark):
    rows = [(1, "a b", "x"), (1, "a  b", "y"), (1, "a b", "z"), (2, "a b", "w"), (None, "c", "p"), (None, "c", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, keep_id string")
    first = sorted(map(repr, exact_dedup.exact_dedup(df).collect()))
    assert len(first) == 2 and all(sorted(map(repr, exact_dedup.exact_dedup(df.repartition(n, F.rand(n))).collect())) == first for n in (2, 3, 5))


def test_many_repeated_classes_split_hot_ones(spark, monkeypatch):
    from palimpsest.llm import joins

    rows = [(i, "hot text") for i in range(50)] + [(100 + i, f"text {i // 2}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(repr, exact_dedup.exact_groups(df).collect()))
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(joins, "HOT_ROWS", 20)
    assert sorted(map(repr, exact_dedup.exact_groups(df).collect())) == want
