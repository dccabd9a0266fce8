import pytest
from pyspark.sql import functions as F

from palimpsest.llm import line_dedup as L

SITES = [f"s{i}" for i in range(12)]
ROWS = [(i, f"own {i}\n  legal notice \nmenu\r\n\nlast {i}", s) for i, s in enumerate(SITES)]
ROWS += [(100 + i, "twice\ntwice", s) for i, s in enumerate(SITES[:3])] + [(200, None, "s1"), (201, "", "s2"), (202, "legal notice\nmenu", None), (203, "menu", "s0"), (203, "menu", "s0"), (None, "x\nlegal notice", "s3")]
ROWS += [(300 + i, "many\n" * 500 + "tail", "s0") for i in range(3)]


def brute(rows, least):
    sites = {}
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            if s is not None and x.strip(" \t\r"):
                sites.setdefault(x.strip(" \t\r"), set()).add(s)
    bad = {x for x, ss in sites.items() if len(ss) >= least}
    out = []
    for d, t, _ in rows:
        lines = [] if t is None else t.split("\n")
        keep = [x for x in lines if x.strip(" \t\r") not in bad]
        out.append((d, None if t is None else "\n".join(keep), len(lines), len(lines) - len(keep)))
    return sorted(map(repr, out))


@pytest.mark.parametrize("least", [2, 4, 12, 13])
def test_against_brute_force(spark, least):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string").repartition(3)
    got = L.remove_boilerplate(df, least_sites=least).select("doc_id", "text", "n_lines", "n_removed").collect()
    assert sorted(map(repr, map(tuple, got))) == brute(ROWS, least)


def test_shuffled_removals_clashes_and_empty(spark, monkeypatch):
    from palimpsest.llm import joins

    monkeypatch.setattr(L, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(L, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(joins, "HOT_ROWS", 2)
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumn("n_lines", F.lit("x")).withColumn("line", F.lit(1))
    out = L.remove_boilerplate(df)
    assert out.columns == ["doc_id", "text", "source", "n_lines", "line", "n_removed"]
    assert sorted(map(repr, map(tuple, out.select("doc_id", "text", "n_lines", "n_removed").collect()))) == brute(ROWS, 4)
    assert L.remove_boilerplate(df.limit(0)).count() == 0


def test_very_long_text(spark):
    """Two hundred thousand lines, all but one of them boilerplate."""
    many = "menu\n" * 200_000 + "own"
    df = spark.createDataFrame([(1, many, "a"), (2, "menu", "b"), (3, "menu\nx", "c"), (4, "menu", "d")], "doc_id long, text string, source string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in L.remove_boilerplate(df).collect()}
    assert got == {1: ("own", 200_001, 200_000), 2: ("", 1, 1), 3: ("x", 2, 1), 4: ("", 1, 1)}
