import json

from pyspark.sql import functions as F

from palimpsest import storage
from palimpsest.functions.profiles import KO
from palimpsest.operators import relational as R
from palimpsest.plans import document_schema as D
from palimpsest.sources import files as S
from palimpsest.storage import discard, stage
from palimpsest.streaming import incremental as I


def test_stage(spark):
    df = stage(spark.range(5).withColumn("x", F.lit("a")), "t")
    assert df.count() == 5 and df.columns == ["id", "x"]
    path = df._palimpsest_path
    assert path in storage._WRITTEN
    discard(df)
    assert path not in storage._WRITTEN


def test_text_sections(spark, tmp_path):
    (tmp_path / "doc1.txt").write_text("머리\n1. 수술\n수술을 하게 됩니다\n성명 홍길동\n2. 빈 절\n", encoding="utf-8")
    (tmp_path / "syn2.txt").write_text("x")
    (tmp_path / "bad.txt").write_bytes(b"\xff abc")
    docs = S.scan_texts(spark, str(tmp_path))
    assert {r.doc for r in docs.collect()} == {"doc1", "bad"}
    row = S.sectioned(docs, KO.heading, KO.drop_line).first()
    assert row.doc == "doc1" and row.text == "수술을 하게 됩니다"


def test_outputs_and_corpus(spark, tmp_path):
    for name, out in (("a__P0", "x"), ("b__P1", "y")):
        (tmp_path / f"{name}.json").write_text(json.dumps({"out": out}))
    rows = {(r.doc, r.route, r.out) for r in S.scan_outputs(spark, str(tmp_path), "out string").collect()}
    assert rows == {("a", "P0", "x"), ("b", "P1", "y")}
    corpus = tmp_path / "corpus"
    corpus.mkdir()
    (corpus / "med.json").write_text(json.dumps({"data": [{"ko": "가", "n": 1}, {"ko": "나"}]}), encoding="utf-8")
    (corpus / "x.csv").write_text("﻿ko,en\n다,da\n", encoding="utf-8")
    (corpus / "y.jsonl").write_text('{"ko": "라"}\nbroken\n', encoding="utf-8")
    (corpus / "z.tsv").write_text("ko\ten\n마\tma\n", encoding="utf-8")
    got = S.scan_corpus(spark, str(corpus)).collect()
    assert sorted(r.record["ko"] for r in got) == sorted("가나다라마") and {r.priority for r in got} == {0, 1}
    (corpus / "long.jsonl").write_text("".join(f'{{"n": {i}}}\n' for i in range(5000)), encoding="utf-8")
    long = lambda **limit: [int(r.record["n"]) for r in S.scan_corpus(spark, str(corpus), **limit).where("file like '%long%'").orderBy("row").collect()]
    assert long() == list(range(5000)) and long(limit_per_file=7) == list(range(7))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b" * 400), (1, "a|c")], "i int, t string")
    S.write_csv(df, str(tmp_path / "csv"), order=["i"])
    back = S.scan_table(spark, str(tmp_path / "csv"), schema="i int, t string")
    assert [(r.i, len(r.t)) for r in back.orderBy("i").collect()] == [(1, 3), (2, 300)]
    S.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    assert S.markdown_table(df.orderBy("i")).split("\n")[2] == "| 1 | a\\|c |"
    sheet, key = S.review_sheet(df, F.col("i") == 2, 2, 1, ["t"], ["i"])
    assert sheet.count() == 1 + 1 and "i" not in sheet.columns and key.count() == 2


def test_pages_and_vocabulary(spark, tmp_path):
    (tmp_path / "d.pdf").write_bytes(b"one\x0ctwo")
    pages = S.scan_pages(spark, str(tmp_path), lambda b: b.decode().split("\x0c"))
    assert [(r.doc, r.page, r.text) for r in pages.orderBy("page").collect()] == [("d", 0, "one"), ("d", 1, "two")]
    assert S.page_profile(pages).first().chars == 6
    (tmp_path / "v.csv").write_text("no,word,grade\n1,가다,2급\n", encoding="utf-8")
    assert tuple(S.scan_vocabulary(spark, str(tmp_path / "v.csv")).first()) == ("가다", 2)
    assert {r.extension: r.files for r in S.inventory(spark, str(tmp_path)).collect()} == {"pdf": 1, "csv": 1}


def test_cache_and_refresh(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc long, text string")
    wanted = I.with_stage_hash(docs, "s", "1", "text").drop("text")
    cache = wanted.withColumn("status", F.when(F.col("doc") == 2, "failed").otherwise("ok")).withColumn("out", F.lit("old")).where("doc < 3")
    done = I.refresh(wanted, cache, ["doc"], lambda df: df.withColumn("status", F.lit("ok")).withColumn("out", F.lit("new")))
    assert {r.doc: r.out for r in done.collect()} == {1: "old", 2: "new", 3: "new"}
    newer = I.with_stage_hash(docs, "s", "2", "text").drop("text")
    assert I.stale(newer, cache, ["doc"]).count() == 3


def test_stream_skips_what_is_done(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    spark.createDataFrame([(1,), (2,)], "k long").write.parquet(src)
    run = lambda: I.process_stream(spark.readStream.schema("k long").parquet(src), out, ck, ["k"], lambda df: df.withColumn("v", F.col("k") * 2)).awaitTermination()
    run()
    spark.createDataFrame([(2,), (3,)], "k long").write.mode("append").parquet(src)
    run()
    assert sorted((r.k, r.v) for r in spark.read.parquet(out).collect()) == [(1, 2), (2, 4), (3, 6)]


def test_schema_errors(spark):
    empty = spark.createDataFrame([], D.DOCUMENT)
    assert empty.select(D.validation_errors(strict=True)).count() == 0
    row = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in D.DOCUMENT.fields])
    assert row.select(D.validation_errors().alias("e")).first().e == [f"missing: {c}" for c in D.REQUIRED]


def test_asof_and_interval(spark):
    left = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("b", 3, 1)], "k string, id int, t int")
    right = spark.createDataFrame([("a", 5), ("a", 7)], "k string, b int")
    assert {r.id: r.b for r in R.asof_forward(left, right, ["k"], "t", "b").collect()} == {1: 5, 2: None, 3: None}
    pairs = R.interval_join(left, right.withColumnRenamed("b", "t"), ["k"], "t", "t", 2)
    assert sorted((r.l_id, r.r_t) for r in pairs.collect()) == [(1, 5), (1, 7), (2, 7)]
