import hashlib
import re

from palimpsest.llm import secret_scan as S

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def weak_spans(t):
    base, out = base_spans(t), []
    for m in re.finditer("[A-Z0-9]{16,}", t):
        if re.search("[A-Z]", m[0]) and re.search("[0-9]", m[0]) and not m[0].startswith("AKIA"):
            out.append((m.start(), 3, m.end()))
    out += [(m.start(), 4, m.end()) for m in re.finditer("[A-Za-z0-9+/_-]{32,}", t) if all(re.search(p, m[0]) for p in ("[A-Z]", "[a-z]", "[0-9]"))]
    out += [(m.start(), 5, m.end()) for m in re.finditer(r"""[a-z][a-z0-9+.-]*://[^\s"'<>]+""", t, re.ASCII) if len(m[0]) >= 10]
    return [w for w in out if not any(b[0] < w[2] and w[0] < b[2] for b in base)]


def brute(t):
    base, weak = base_spans(t), weak_spans(t)
    role = "sissse"
    role = {0: "s", 1: "i", 2: "s", 3: "i", 4: "s", 5: "e"}
    kept = [w for w in weak if any((role[w[1]] == "s") != (role[p[1]] == "s") and 0 <= max(p[0] - w[2], w[0] - p[2]) <= S.SCOPE for p in base + weak)]
    say = lambda xs: ",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in sorted(xs))
    return say(base), say(base + kept)


BLOB = "Ab1" * 12
TEXTS = [
    None, "", "nothing here", "password = 'hunter22x' and token:abc", "secret=token:abcdefgh", "API_KEY: x y", "AKIA" + "A" * 16, "AKIAAKIA" + "B" * 12,
    "é𝄞 " + "0123456789abcdef" * 2 + " é password=" + "z" * 9, f"id {'ABCD1234' * 3} key {BLOB} at https://host.example/x", f"lonely {BLOB}", f"{BLOB} " + "x " * 300 + "https://host.example/x",
    "tokEN\"  =  \"abcdefg\"", "x" * 1000 + " https://a.example/path secret=abcdefg " + "y" * 100_000, "password=AKIA" + "C" * 20, f"apikey={'deadbeef' * 4} postgres://u@h/db",
]


def test_against_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[9]), (9, TEXTS[9])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = S.secret_digests(S.scan_secrets(df)).collect()
    want = sorted((repr(i), hashlib.sha256(brute(t or "")[0].encode()).hexdigest(), brute(t or "")[1]) for i, t in rows)
    assert sorted((repr(r.doc_id), r.base_sha256, r.spans) for r in got) == want
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        if i is not None:
            n = [sum(k == j for _, k, _ in base_spans(t or "")) for j in range(3)]
            assert [by[i].n_assign, by[i].n_access, by[i].n_hex] == n


def test_weak_parts_need_each_other(spark):
    df = spark.createDataFrame([(1, TEXTS[10]), (2, TEXTS[9]), (3, TEXTS[11])], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in S.secret_digests(S.scan_secrets(df)).collect()}
    assert spans[1] == "" and "blob:" in spans[2] and "ident:" in spans[2] and "endpoint:" in spans[2] and spans[3] == ""


def test_empty_and_other_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, spans string, rid long")
    assert S.secret_digests(S.scan_secrets(df)).count() == 0
    df = spark.createDataFrame([(1, "password=abcdefg", "x", 2)], "doc_id long, text string, spans string, rid long")
    assert S.secret_digests(S.scan_secrets(df)).first().n_assign == 1


def test_parts_exactly_in_scope_at_a_cell_edge(spark):
    texts = [" " * 160 + "password=" + "z" * 31 + " " * 200 + "ABCD1234" * 3, " " * 159 + "password=" + "z" * 31 + " " * 201 + "ABCD1234" * 3]
    assert S.SCOPE == 200
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in S.secret_digests(S.scan_secrets(df)).collect()}
    assert got == {i: brute(t)[1] for i, t in enumerate(texts)} and "ident:400:" in got[0] and "ident:" not in got[1]


def test_megabytes_of_matches(spark):
    """A text that is nothing but matches: two hundred times the blocks of the fold, in time that grows with its length."""
    n = 100_000
    text = "".join(f"{'deadbeef' * 3}{i % 10} " for i in range(n)) + "z" * 1_000_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = S.scan_secrets(df).select("hex").collect()
    assert len(row.hex) == n and all((s, e) == (26 * i, 26 * i + 25) for i, (s, e) in enumerate(row.hex))


def test_weak_parts_in_base_spans(spark):
    """Many base spans and many weak candidates of one text meet by cells."""
    text = " ".join(f"{'deadbeef' * 4} {BLOB}{i} https://host{i}.example/x" for i in range(300))
    (row,) = S.secret_digests(S.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string"))).collect()
    assert row.spans == brute(text)[1]
