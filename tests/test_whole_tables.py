"""Queries over whole tables against brute force on small ones."""

import re

import pytest

from compare import connection, differences
from palimpsest.plans import registry

Q = registry.queries()


@pytest.fixture
def tables(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


DOCS = "doc_id long, text string, source string, n_chars long"


def test_late_ids_count(spark, tables):
    texts = {3: "running runner gardens", 700: "Gardening garden gardener gard", 701: "wonder wonderful wond"}
    d = tables("documents", [(i, t, "web", len(t)) for i, t in texts.items()], DOCS)
    want = set()
    for i, t in texts.items():
        tok = re.findall("[A-Za-z]{4,10}", t)
        for w in {w for w in tok if len(w) >= 6}:
            near = {o.lower() for o in tok if (w in o.lower() or o.lower() in w) and o.lower() != w}
            if near:
                want.add((i, w, min(near, key=lambda o: (-len(o), o))))
    assert {tuple(r) for r in Q["longest_variant"](spark, d).collect()} == want
    assert {r.word for r in Q["vocab_longest_prefix_grade"](spark, d).collect()} == {w.lower() for t in texts.values() for w in t.split()}


def test_profile_takes_all_rows(spark, tables):
    d = tables("documents", [(500 + i, f"text number {i}", "source", 1) for i in range(300)], DOCS)
    assert {(r.column, r.n) for r in Q["column_profile"](spark, d).collect()} == {("text", 300), ("source", 300)}


def test_long_texts_and_null_lengths_count(spark, tables):
    sents = [f"Sentence number {i} is here (in brackets)." for i in range(200)]
    d = tables("documents", [(1, " ".join(sents), "web", 9000), (2, " ".join(sents[:2]), "web", None)], DOCS)
    chunks = Q["chunk_window_1_3"](spark, d).collect()
    want = {" ".join(sents[i : i + k]) for k in (1, 2, 3) for i in range(201 - k)}
    assert {r.chunk for r in chunks if r.doc_id == 1} == want and len([r for r in chunks if r.doc_id == 2]) == 3
    assert {tuple(r) for r in Q["bracket_count"](spark, d).collect()} == {(1, 400), (2, 4)}


def test_omission_takes_every_sentence(spark, tables):
    sents = [f"The patient number{i} came in today, and stayed for {i} nights here." for i in range(12)]
    d = tables("documents", [(5, " ".join(sents), "web", 1), (None, " ".join(sents[:5]), "web", 1), (6, " ".join(sents[:3]), "web", 1)], DOCS)
    got = {r.kind: r for r in Q["omission_detection"](spark, d).collect()}
    words = lambda s: set(re.findall(r"\w+", s.lower()))
    want = []
    for n in (12, 5):
        for i in range(n):
            rest = set().union(*(words(x) for k, x in enumerate(sents[:n]) if k != i))
            want.append(len(words(sents[i]) & rest) / len(words(sents[i])))
    assert got["FULL"].n == 17 and abs(got["FULL"].mean - sum(want) / 17) < 1e-9
    assert got["CLAUSE"].n == got["OFF_TOPIC"].n == 20


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    return row[-1]


TURNS = "conv_id long, turn int, role string, text string"


def test_accented_pairs_and_turns_with_digits_count(spark, tables):
    said = [("Où est la clé du café près d'ici ?", "La clé est à la réception."), ("Give 2 mg now.", "Giving 2 mg now."), ("plain words only", "plain words alone")]
    d = tables("conversations", [(i, t, ("user", "assistant")[t], said[i][t]) for i in range(3) for t in (0, 1)], TURNS)
    got = {r.conv_id: r.levenshtein_sim for r in Q["turn_pair_levenshtein"](spark, d).collect()}
    assert set(got) == {0, 1, 2} and all(abs(got[i] - (1 - _levenshtein(a, b) / max(len(a), len(b)))) < 1e-9 for i, (a, b) in enumerate(said))
    changed = {r.conv_id: r.changed for r in Q["number_corruption"](spark, d).collect()}
    assert set(changed) == {0, 1, 2} and changed[1].startswith("Give 7 mg now.")


UNITS = re.compile(r"(?<![\d.])(\d{1,4})\s*(%|days|weeks|months|years|hours|min|mg|ml|cm|kg)")


def _changed(src, out):
    s, o = ([(re.sub(r"\s", "", m[0]), m.start()) for m in UNITS.finditer(t)] for t in (src, out))
    for tok, pos in s:
        if tok in {x for x, _ in o}:
            continue
        found = None
        for kw in re.findall(r"[^\W\d_]{3,}", src[max(0, pos - 35) : pos + 35]):
            for m in re.finditer(re.escape(kw), out):
                near = [x for x, at in o if abs(at - m.start()) <= 60]
                found = found or (near[0] if near else None)
        yield tok, pos, None if found in {x for x, _ in s} else found


def test_changed_numbers_by_all_words_and_places(spark, tables):
    replies = ["for now. " + "filler text " * 20 + "And so", "short", "Take it. " + "so on " * 30 + "give 5 mg for", "Take 77 kg, days later"]
    said = [(("user", "assistant")[t], (f"Question {i}, give 12 ml for it" * (i % 2 + 1), replies[i % 4])[t]) for i in range(30) for t in (0, 1)]
    d = tables("conversations", [(k // 2, k % 2, r, t) for k, (r, t) in enumerate(said)], TURNS)
    want = set()
    for i in range(30):
        src, out = said[2 * i][1] + f" Take 2 mg for {i % 9} days.", said[2 * i + 1][1] + f" Take 2mg for {i % 7} days."
        want |= {(i, 0, *x) for x in _changed(src, out)}
    assert any(x[-1] for x in want) and {tuple(r) for r in Q["numeric_verifier_changed"](spark, d).collect()} == want


def test_terms_run_together_and_repeated_ids_count_as_in_sql(spark, tables):
    texts = ["thethe the", "xthethe thethethes", "andand-theand thesis theme withthe", None, "the (and) forforfored", "xforthe for", "é the éthethe", ""]
    d = tables("documents", [(i // 2 if i < 6 else None, t, "web", 1) for i, t in enumerate(texts * 2)], DOCS)
    assert not differences(Q["term_occurrences"](spark, d), registry.oracle_sql()["term_occurrences"], connection(d))


def test_variants_of_repeated_ids_and_long_texts_without_a_shuffle(spark, tables):
    texts = [(1, "gardening Garden"), (1, "gardeners wondrous"), (2, None), (None, "wonder wonderful"), (None, "wonders"), (3, "Étagères étagère tagère gard"), (4, " ".join(f"word{'abcdefghij'[i % 10]}{'klmno'[i % 5]} sword{'abcdefghij'[i % 10]}" for i in range(3000)))]
    d = tables("documents", [(i, t, "web", 1) for i, t in texts], DOCS)
    assert not differences(Q["longest_variant"](spark, d), registry.oracle_sql()["longest_variant"], connection(d))
    once = tables("documents", [(i, "gardening garden", "web", 1) for i in range(3)], DOCS)
    df = Q["longest_variant"](spark, once)
    assert df.count() == 6 and "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
