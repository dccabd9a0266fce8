import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from palimpsest.llm import simhash as S
from palimpsest.llm.golay import golay_tables


def brute_fingerprint(t):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (rows[i][1] ^ rows[j][1]).bit_count() <= 4:
            parent[root(i)] = root(j)
    out = {}
    for i, (d, _) in enumerate(rows):
        out.setdefault(root(i), []).append(d)
    return [min((d for d in out[root(i)] if d is not None), default=None) for i in range(len(rows))]


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "a b c", "a b c d", "É a B\x0bc d e f", "x y " * 300])
def test_fingerprint(text):
    assert S.fingerprint(text) == brute_fingerprint(text)


def test_code_is_perfect_and_keys_are_complete():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 23, 200).astype(np.int32)
    low, high, errors = golay_tables()
    words = v ^ errors[low[v & 4095] ^ high[v >> 12]]
    assert (low[words & 4095] ^ high[words >> 12] == 0).all() and (np.bitwise_count(words ^ v) <= 3).all()
    for bits in (23, 18):
        for _ in range(200):
            a = rng.integers(0, 1 << bits)
            b = a ^ (1 << rng.integers(0, bits)) ^ (1 << rng.integers(0, bits))
            ka, kb = (set(S.segment_keys(np.array([x], np.int32), bits)[0]) - {-1} for x in (a, b))
            assert ka & kb and len(ka) <= S.KEYS


def test_any_four_errors_share_a_key():
    rng = random.Random(5)
    for _ in range(400):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            b ^= 1 << bit
        rows, keys = S.golay_keys(np.array([a, b], np.uint64).view(np.int64))
        assert set(keys[rows == 0]) & set(keys[rows == 1])


def _fps(n_random, centres, spread, seed):
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n_random)]
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(spread):
            x = c
            for bit in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << bit
            out.append(x)
    return out


def test_links_connect_as_brute_force(spark):
    fps = sorted(set(_fps(200, 6, 40, 2)))
    nodes = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long").repartition(5)
    from palimpsest.llm.components import connected_components

    found = S.links(nodes)
    assert found.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 4).count() == 0
    labels = {r.node: r.label for r in connected_components(found).collect()}
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    want = brute_components(list(zip(signed, fps, strict=True)))
    got = {}
    for s in signed:
        got.setdefault(labels.get(s, s), set()).add(s)
    expected = {}
    for s, c in zip(signed, want, strict=True):
        expected.setdefault(c, set()).add(s)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_long_runs_give_a_spanning_forest():
    fps = np.array(_fps(0, 1, 300, 4), np.uint64).view(np.int64)
    a, b = S.run_links(np.zeros(len(fps), np.int32), fps, 4)
    assert len(a) < len(set(fps.tolist())) and (np.bitwise_count((a ^ b).view(np.uint64)) <= 4).all()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 5) for _ in range(150)) for _ in range(12)]
    out = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base[:6]):
        words = t.split()
        for j in range(3):
            words[rng.randrange(150)] = "zz"
            out.append((100 + 10 * i + j, " ".join(words)))
    return out + [(50, base[0]), (50, base[0]), (60, None), (61, ""), (None, base[1]), (None, "alone"), (77, base[8]), (70, "one two")]


def test_groups_and_dedup(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted(map(repr, ((d, f"{brute_fingerprint(t):016x}", c) for (d, t), c in zip(rows, brute_components([(d, brute_fingerprint(t)) for d, t in rows]), strict=True))))
    assert sorted(map(repr, map(tuple, S.simhash_groups(df).collect()))) == want
    kept = S.simhash_dedup(df.withColumn("h", F.lit("clash")), words=4, bits=4)
    assert kept.columns == ["doc_id", "text", "h"]
    comps = [(c, brute_fingerprint(t)) for (d, t), c in zip(rows, brute_components([(d, brute_fingerprint(t)) for d, t in rows]), strict=True)]
    assert kept.count() == len({c if c is not None else ("null", f) for c, f in comps})
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == {c for c, _ in comps if c is not None}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.simhash_groups(df).count() == 0 and S.simhash_dedup(df).count() == 0 and S.simhash_dedup(df, bits=4).count() == 0
