import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from palimpsest.llm import simhash as S
from palimpsest.llm import strata as N


def brute_kept(rows):
    """Smallest id of each group linked by an exact five-word Jaccard of 0.8 or more."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))})
    group = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] == sets[j] or both / max(len(sets[i] | sets[j]), 1) >= 0.8:
            old, new = group[i], group[j]
            group = [new if g == old else g for g in group]
    least = {}
    for g, (d, _) in zip(group, rows, strict=True):
        least[g] = min(d, least.get(g, d))
    return set(least.values())


def changed(words, rng, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"x{rng.randrange(10**6)}"
    return " ".join(out)


def test_changed_words_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(300)]
        rows.append((len(rows), " ".join(base)))
        rows += [(len(rows) + k, changed(base, rng, n)) for k, n in enumerate((2, 5, 6, 8, 20))]
    centre = [f"c{rng.randrange(3000)}" for _ in range(200)]
    rows += [(len(rows) + k, changed(centre, rng, 1 + k % 5)) for k in range(60)]
    rows += [(900, ""), (901, "one two"), (902, "one two three")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in S.simhash_dedup(df).collect()} == brute_kept(rows)


def test_stage_links_changed_words(spark):
    import corpus_pipeline

    rng = random.Random(4)
    rows = []
    for i in range(20):
        base = [f"w{rng.randrange(3000)}" for _ in range(300)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, changed(base, rng, 5))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()}
    assert kept == brute_kept(rows) == set(range(0, 40, 2))


def test_similar_sets_share_a_key():
    """Sets of up to 128 shingles share one for certain, also at the edge of the similarity."""
    rng = np.random.default_rng(2)
    for n in (1, 2, 4, 5, 9, 10, 36, 40, 80, 128):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            gone = next(g for g in range(n, -1, -1) if (n - g) / (n + g) >= 0.8 or not g)  # as many changed as may be
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 63, gone).astype(np.uint64)]))
            fewer = a[: max(int(np.ceil(0.8 * n)), 1)]
            ka, kb, kc = N.strata_keys([a, b, fewer])
            assert N.jaccard(a, b) >= 0.8 and set(ka) & set(kb) and set(ka) & set(kc)


def test_long_sets_share_keys_and_strangers_none():
    rng = np.random.default_rng(3)
    missed, strange = 0, 0
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, 2000).astype(np.uint64))
        b = np.unique(np.concatenate([a[222:], rng.integers(0, 1 << 63, 222).astype(np.uint64)]))
        ka, kb, kc = N.strata_keys([a, b, rng.integers(0, 1 << 63, 2000).astype(np.uint64)])
        missed += not set(ka) & set(kb)
        strange += bool(set(ka) & set(kc))
    assert missed == strange == 0


def test_long_runs_of_many_groups(spark):
    """One opening makes thousands of candidates of one key; only what is similar as a whole is linked."""
    rng = random.Random(6)
    opening = [f"o{i}" for i in range(30)]
    rows = []
    for g in range(40):
        own = [f"g{g}w{rng.randrange(9999)}" for _ in range(25)]
        rows += [(10 * g + k, " ".join(opening + own[:-1] + [f"z{k}"])) for k in range(3)]
    near = [f"n{rng.randrange(500)}" for _ in range(400)]
    rows += [(1000 + k, changed(near, rng, 2)) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id for r in S.simhash_dedup(df).collect()} == brute_kept(rows)


def test_repeated_rows_that_differ_elsewhere(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (None, "a b c d e f", "z"), (None, None, None), (None, "", "q")], "doc_id long, text string, in_0 string")
    first = sorted(map(tuple, S.simhash_dedup(df).collect()), key=repr)
    assert len(first) == 2 and first == sorted(map(tuple, S.simhash_dedup(df.repartition(3, F.rand(4))).collect()), key=repr)


def test_hot_classes_are_split_beyond_the_broadcast_limit(spark, monkeypatch):
    from palimpsest.llm import joins

    rows = [(i, "same words in every text of this group") for i in range(60)] + [(100 + i, f"other text {i} of its own {i}") for i in range(30)] + [(None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(repr, map(tuple, S.simhash_groups(df).collect()))), sorted(map(repr, map(tuple, S.simhash_dedup(df).collect())))
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(joins, "HOT_ROWS", 20)
    got = sorted(map(repr, map(tuple, S.simhash_groups(df).collect()))), sorted(map(repr, map(tuple, S.simhash_dedup(df).collect())))
    assert got == want
