import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import packing as P

try:
    from palimpsest.llm.queries import tokenizer_path

    PATH = tokenizer_path()
except ModuleNotFoundError:
    PATH = None
needs_tokenizer = pytest.mark.skipif(PATH is None, reason="no vocabulary files here")


def check(counts, capacity):
    """Every piece has a place, bins are full without gaps and overlaps, at most two large pieces to a bin."""
    bins, seen = {}, Counter()
    for length, low, n, first, each, at in P.plan_bins(dict(counts), capacity):
        assert low == seen[length]
        seen[length] += n
        for step in range(n):
            bins.setdefault(first + step // each, []).append((at + step % each * length, length))
    assert seen == Counter({k: v for k, v in counts.items() if v})
    for own in bins.values():
        end = 0
        for at, length in sorted(own):
            assert at == end
            end += length
        assert end <= capacity and sum(3 * n > capacity for _, n in own) <= 2
    assert sorted(bins) == list(range(len(bins)))
    return len(bins)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(0, 40), max_size=20))
def test_plans(counts):
    counts = Counter(counts)
    n = check(counts, 60)
    total = sum(k * v for k, v in counts.items())
    assert n >= -(-total // 60)


def test_plan_is_close_to_the_bound():
    rng = random.Random(1)
    counts = Counter(min(4096, int(rng.lognormvariate(6, 1)) + 1) for _ in range(20_000))
    bound = -(-sum(k * v for k, v in counts.items()) // 4096)
    assert check(counts, 4096) <= 1.01 * bound


TEXTS = [None, "", " ", "Hello, World! it's 3.5", "don't l'été — naïve ÀÉ ß İstanbul Σίσυφος", "a\x1cb c\u00a0d\u3000e", "<|endoftext|> x<|startoftext|>y", "日本語 テキスト한국어", "e\u0301 combining", "𝄞 emoji 😀!!", "word " * 5000, "UPPER lower (x) %%% &&& a-b snake_case 12ab", "x" * 3000]


@needs_tokenizer
def test_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    t, own = Tokenizer.from_file(PATH), P.WordTokens(PATH)
    for text in TEXTS:
        assert np.frombuffer(own.ids(text or ""), "<u4").tolist() == t.encode(text or "", add_special_tokens=False).ids


@needs_tokenizer
def test_cache_can_be_emptied(monkeypatch):
    monkeypatch.setattr(P, "CACHE", 3)
    test_ids_are_the_tokenizers()


@needs_tokenizer
def test_pieces_and_places(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    rows = [(i, x) for i, x in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "no id"), (50, "word " * 4095), (51, "word " * 4096)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "text").repartition(3)
    got = P.pack(df, PATH).collect()
    want = []
    for d, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            own = ids[at : at + 4096]
            want.append((d, n, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r[:5])) for r in got)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        end = 0
        for at, n in sorted(own):
            assert at == end
            end += n
        assert end <= 4096
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // 4096) + 1
    with_ids = P.pack(df.limit(3), PATH, carry_ids=True).collect()
    assert all(len(r.ids) == r.length for r in with_ids)
    assert P.pack(df.limit(0), PATH).count() == 0


def test_other_tokenizers_and_parts(spark, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = {1: "Hello  World, it's\tme", 2: None, 3: "é𝄞 " * 300, 4: " " * 50}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    plain = Tokenizer.from_file(path)
    got = P.pieces(df, path, carry_ids=True, capacity=64).orderBy("doc_id", "piece").collect()
    for d, t in texts.items():
        assert sum([r.ids for r in got if r.doc_id == d], []) == [*plain.encode(t or "", add_special_tokens=False).ids, 1]
    monkeypatch.setattr(P, "PART_ROWS", 7)
    many = spark.createDataFrame([(i, "w " * (i % 5)) for i in range(300)], "doc_id long, text string").withColumn("length", F.lit("x")).withColumn("part", F.lit(0))
    rows = P.pack(many, public_tokenizers.path("word_bpe_49k.json"), capacity=16).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(rows) == 300 and len({(r.doc_id, r.piece) for r in rows}) == 300
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 16


def test_long_chunks_are_not_kept():
    import public_tokenizers

    tokens = P.WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    text = "x" * 300_000 + " short " + "é1" * 1000
    assert tokens.ids(text) == P.PlainTokens(public_tokenizers.path("word_bpe_49k.json")).ids(text) and list(tokens) == ["short"]
