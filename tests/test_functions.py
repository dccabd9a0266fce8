import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import perturb as P
from palimpsest.functions import spans as SP
from palimpsest.functions import stats as ST
from palimpsest.functions import text as T
from palimpsest.functions.profiles import KO, LATIN
from palimpsest.operators import mining as MI
from palimpsest.operators import relational as R
from palimpsest.operators import similarity as S


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_sentences_in_korean(spark):
    got = one(spark, T.split_sentences("t", KO, 1), t="수술합니다. 검사 3.5 cm 입니다.  끝! 다음\n줄\n1.\n")
    assert got == ["수술합니다", "검사 3.5 cm 입니다", "끝!", "다음", "줄"]


def test_numbers_in_korean(spark):
    assert one(spark, T.number_units("t", KO), t="1 시간, 2주 3 %") == ["1시간", "2주", "3%"]
    assert one(spark, T.numeric_hallucination(F.lit("3주 5%"), F.lit("3주 1시간"), KO)) == ["1시간"]
    assert one(spark, T.numeric_keep(F.lit("1 시간"), F.lit("1시간"), KO)) == 100.0
    assert one(spark, T.numeric_keep(F.lit("1주"), F.lit("11주"), KO)) == 100.0
    assert one(spark, T.numeric_keep(F.lit("없음"), F.lit("11주"), KO)) is None


def test_blanks_in_korean(spark):
    t = "약 정도 걸립니다 ( ) ____ 성명:"
    assert set(one(spark, T.find_blanks("t", KO), t=t)) == {"missing_number", "empty_bracket", "rule", "empty_field"}
    marked = one(spark, T.mark_blanks("t", KO), t=t)
    assert marked["n"] == 3 and marked["text"].count("[미기재]") == 3


@pytest.mark.parametrize(("word", "closed"), [("값", True), ("가", False), ("a", None)])
def test_final_consonant(spark, word, closed):
    assert one(spark, T.has_final_consonant(F.lit(word))) is closed


def test_korean_words(spark):
    assert one(spark, T.strip_particle(F.lit("환자에게"), KO.particles)) == "환자"
    assert one(spark, T.definition_sentence(F.lit("출혈"), F.lit("피가 나오는 것."))) == "출혈은 피가 나오는 것입니다."
    assert one(spark, T.repair_particle(F.lit("위"), F.lit("을 본다"))) == "위를 본다"
    assert [x["kind"] for x in one(spark, SP.term_occurrences("t", ["관절"], KO), t="고관절 관절이 관절염")] == ["관절"]
    assert [x["s"] for x in one(spark, SP.term_occurrences("t", ["관절"], KO), t="고관절 관절이 관절염")] == [4]
    assert one(spark, T.classify_variant(F.lit("심근경색증"), F.lit("심근경색")))["hint"] == "likely equivalent: 증"
    assert one(spark, S.is_predicate("t", KO), t="수술 후 통증이 있을 수 있습니다.") and not one(spark, S.is_predicate("t", KO), t="해당 없음")
    assert one(spark, S.is_scaffold("t", KO), t="성명 생년월일 병록번호 을 적는 자리 그리고 더 긴 줄")


def test_ngrams_and_chunks(spark):
    assert one(spark, T.char_ngrams("t", 3), t="ab") == ["ab"] and one(spark, T.char_ngrams("t", 3), t=" ") == []
    assert one(spark, R.sliding_chunks(F.array(*map(F.lit, "abc")))) == ["a", "b", "c", "a b", "b c", "a b c"]
    assert one(spark, R.sliding_chunks(F.array().cast("array<string>"))) == ["(empty)"]


def test_spans(spark):
    a = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(e).alias("e")) for s, e in ((0, 3), (2, 5), (3, 6), (0, 2))])
    assert [tuple(x) for x in one(spark, SP.non_overlapping(a))] == [(0, 3), (3, 6)]
    assert one(spark, SP.parenthesis_depth("t", F.lit(6)), t="a(b)(c") == 1
    assert one(spark, SP.parenthesis_depth("t", F.lit(2)), t=")))") == 0


def test_sections(spark):
    lines = "before\n1. First\nbody a\n성명\nbody b\n2. Empty\n3. Last\nend".split("\n")
    got = one(spark, R.forward_fill_sections(F.array(*map(F.lit, lines)), KO.heading, KO.drop_line))
    assert [tuple(x) for x in got] == [("First", "body a body b"), ("Last", "end")]


def test_mask_restores_and_fails_closed(spark):
    t = "약 3주 후 1~2일, 2박 3일 ( ) 그리고 " + " ".join(f"{i}회" for i in range(10, 22))
    m = one(spark, SP.mask("t", KO), t=t)
    assert "3주" not in m["text"] and "2박 3일" in m["map"].values() and "⟦N11⟧" in m["map"]
    df = spark.createDataFrame([(t,)], "t string").withColumn("m", SP.mask("t", KO))
    first = F.regexp_replace(F.col("m.text"), "⟦N1⟧", "")
    row = df.select(SP.restore(F.col("m.text"), F.col("m.map")).alias("back"), SP.audit(first, F.col("m.map")).alias("a"), SP.protect(first, F.col("t"), F.col("m.map")).alias("p"), SP.audit(F.concat("m.text", F.lit("[N 01]⟦N1⟧⟦Z9⟧")), F.col("m.map")).alias("b")).first()
    assert row.back == t and row.p == t and row.a["missing"] == ["⟦N1⟧"] and not row.a["ok"]
    assert row.b["duplicated"] == ["⟦N1⟧"] and row.b["unknown"] == ["⟦Z9⟧"] and row.b["variants"] == ["[N 01]"]


def test_glossary(spark):
    g = {"출혈": "피가 나오는 것", "감염": "균이 들어오는 것"}
    t = "수술 후 출혈이 있습니다. (감염) 감염이 생깁니다.\n출혈 주의"
    df = spark.createDataFrame([(t,)], "t string").withColumn("g", SP.glossary_plan("t", g, KO))
    sentences = {k: f"{k}은 {v}입니다." for k, v in g.items()}
    row = df.select(SP.render_inline("t", F.col("g.plan"), g).alias("i"), SP.check_rendering(F.col("t"), SP.render_inline("t", F.col("g.plan"), g), F.col("g.plan"), g).alias("c"), SP.render_sentences("t", F.col("g.plan"), sentences, r"(?<=[다요음임함])\.\s+|(?<=[.!?])\s+|\n+").alias("s"), F.col("g.skipped.reason").alias("r")).first()
    assert row.i == "수술 후 출혈(피가 나오는 것)이 있습니다. (감염) 감염(균이 들어오는 것)이 생깁니다.\n출혈 주의"
    assert row.c == [] and row.r == ["inside_parenthesis", "not_first_occurrence"]
    assert row.s == "수술 후 출혈이 있습니다. 출혈은 피가 나오는 것입니다. (감염) 감염이 생깁니다.\n감염은 균이 들어오는 것입니다.\n출혈 주의"


def test_clean_output(spark):
    raw = "<think>hm</think>\n물론입니다!\n---\n# 제목\n- **굵게** 본문\n---\n도움이 되었길 바랍니다"
    got = one(spark, T.clean_output("t", T.KO_OPENING, T.KO_CLOSING), t=raw)
    assert got["text"] == "제목\n굵게 본문" and got["removed"] > 0
    assert one(spark, T.clean_output("t", T.KO_OPENING, T.KO_CLOSING), t="물론입니다")["text"] == "물론입니다"


def test_perturbations(spark):
    s = "수술은 약 3주 걸리고 드물게 출혈이 있습니다."
    got = {k: one(spark, v, t=s) for k, v in P.perturbations("t", KO, [["출혈", "감염"]]).items()}
    assert got["NUM_CHANGE"] == s.replace("3주", "10주") and got["UNIT_CHANGE"] == s.replace("3주", "3개월")
    assert got["NEGATE"] == s.replace("있습니다", "없습니다") and got["SEVERITY"] == s.replace("드물게", "흔하게")
    assert got["TERM_SWAP"] == s.replace("출혈", "감염") and got["SIDE"] is None and got["OFF_TOPIC"] in KO.off_topic
    assert one(spark, P.omit_clause("t", KO), t="피가 나며 3일 아프고 곧 낫습니다 정말로") == "피가 나며 곧 낫습니다 정말로"
    assert one(spark, P.omit_term("t", KO.terms), t="매우 긴 문장에 출혈 이 있습니다") == "매우 긴 문장에 이 있습니다"
    assert one(spark, P.truncate("t"), t="x" * 39) is None and one(spark, P.truncate("t"), t="x" * 40) == "x" * 22


@pytest.mark.parametrize("form", ["NFKC", "NFC"])
def test_normalise(spark, form):
    t = "  é ﬁ 　x\r\n\n\n\ny\x07z  "
    want = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t 　]+", " ", re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ", unicodedata.normalize(form, t).replace("\r\n", "\n")))).strip()
    assert one(spark, T.normalise("t", form), t=t) == want


def test_ranks(spark):
    df = spark.createDataFrame([(0.2, True), (0.4, True), (0.4, False), (0.9, False)], "s double, p boolean")
    assert ST.auroc(df, "s", "p").first()["auroc"] == 0.875
    assert ST.auroc(df.withColumn("s", F.lit(1.0)), "s", "p").first()["auroc"] == 0.5
    flat = spark.createDataFrame([(1.0, 2.0)] * 5, "x double, y double")
    assert ST.spearman(flat, "x", "y").first()["spearman"] is None
    assert one(spark, ST.wilson(F.lit(0), F.lit(0))) is None
    twenty = spark.createDataFrame([(float(i),) for i in range(20)], "v double").repartition(3)
    assert ST.order_statistic(twenty, "v", ST.specificity_position(0.95), "tau").first()["tau"] == 1.0
    sweep = ST.threshold_sweep(spark.createDataFrame([(0.9, True), (0.1, False)], "s double, p boolean"), "s", "p", [0.5]).first()
    assert sweep["precision"] == 0 and sweep["f1"] is None
    gate = one(spark, S.gate(F.lit(None).cast("double"), F.lit(0), F.lit(70.0)))
    assert gate["ok"] and gate["reasons"] == []


def test_bootstrap_is_sane_and_repeats(spark):
    df = spark.createDataFrame([(i, float(i % 10)) for i in range(200)], "i long, v double")
    a, b = ST.bootstrap_ci(df, "v", 200).first(), ST.bootstrap_ci(df.repartition(3), "v", 200).first()
    assert a == b and a.low < a["mean"] < a.high and a.high - a.low < 2


def test_topk_fills_and_breaks_ties(spark):
    hyps = spark.createDataFrame([("d", 0, "xyz"), ("d", 1, "abab")], "doc string, hyp_id int, hyp string")
    chunks = spark.createDataFrame([("d", i, t) for i, t in enumerate(["qqq", "abab", "abab", "rrr"])], "doc string, chunk_id int, chunk string")
    got = {(r.hyp_id, r["rank"]): r.chunk_id for r in S.topk_similarity_join(hyps, chunks, k=3).collect()}
    assert got == {(0, 1): 0, (0, 2): 1, (0, 3): 2, (1, 1): 1, (1, 2): 2, (1, 3): 0}
    high = {(r.hyp_id, r["rank"]): r.chunk_id for r in S.topk_similarity_join(hyps, chunks, k=3, ties="highest").collect()}
    assert high == {(0, 1): 3, (0, 2): 2, (0, 3): 1, (1, 1): 2, (1, 2): 1, (1, 3): 3}


def test_keep_unlike(spark):
    items = F.array(*[F.struct(F.lit(c).alias("cand"), F.lit(r).alias("rate")) for c, r in (("ab", 0.5), ("abc", 0.6), ("b", 0.9), ("bc", 0.58))])
    assert [x["cand"] for x in one(spark, R.keep_unlike(items))] == ["abc", "b"]
    assert one(spark, MI.first_allowed(F.array(F.lit("x"), F.lit("y")), ["x"])) == "y"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("ab1(3)周_. ", max_size=30), min_size=1, max_size=8))
def test_invariants(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("m", SP.mask("t", LATIN))
    rows = df.select("t", SP.restore(F.col("m.text"), F.col("m.map")).alias("back"), T.jaccard(T.char_ngrams("t", 2), T.char_ngrams(F.reverse("t"), 2)).alias("j"), SP.pattern_spans(F.col("t"), r"\d+").alias("s")).collect()
    for r in rows:
        assert r.back == r.t and 0 <= r.j <= 1
        assert [(x["s"], x["e"], x["raw"]) for x in r.s] == [(m.start(), m.end(), m[0]) for m in re.finditer(r"[0-9]+", r.t)]
