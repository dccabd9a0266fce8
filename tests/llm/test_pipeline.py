import os
import re

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage returned, the documents first."""
    from palimpsest.storage import stage

    out = [spark.read.parquet(f"{DATA}/documents.parquet")]
    for name, step in pipeline.STAGES:
        out.append(stage(step(spark, out[-1], DATA), "test-stage"))
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_filter_and_keep_columns(spark, kept):
    docs, clean, single, near, mixed, packed = kept
    assert all(x.columns == docs.columns for x in (clean, single, near, mixed))
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    gone = ids(docs) - ids(clean)
    assert all(labels.get(d, 1) == 1 for d in gone) and ids(single) <= ids(clean) and ids(near) <= ids(single)


def test_copies_against_brute_force(kept):
    first = {}
    for r in kept[1].collect():
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        first[key] = min(r.doc_id, first.get(key, r.doc_id))
    assert ids(kept[2]) == set(first.values())


def test_near_copies_against_brute_force(kept):
    from test_near_dedup import brute_kept

    assert ids(kept[3]) == brute_kept([(r.doc_id, r.text) for r in kept[2].collect()])


def test_mix_and_packing(kept):
    from palimpsest.llm.mixing import mix_sources

    want = mix_sources(kept[3]).where("copies > 0").select("doc_id", F.col("copies").alias("n"))
    got = kept[4].groupBy("doc_id").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, got.collect()))
    starts = kept[5].where("piece = 0").groupBy("doc_id").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, starts.collect())) == sorted(map(tuple, got.collect()))
    assert kept[5].groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).where("n <> end or n > 4096").count() == 0
