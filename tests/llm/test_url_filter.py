from pyspark.sql import functions as F

from palimpsest.llm import url_filter as U
from palimpsest.llm.queries import URL_RULES

URLS = [
    None, "", "no scheme", "http://Example.COM/en/x?q=/es/#f", "http://www.example.com/en/", "http://a.www.example.com/en/y", "http://example.com/en", "http://example.com", "http://notexample.com/en/", "http://x.net/es/", "http://x.net/espana/",
    "http://x.net/fr/a://b", "http://net/fr/", "http://com/", "http://com:80/", "http://u@x.com/", "ftp://x.net?/es/", "://a.com/", "http://.com/", "http://x.com./", "http://É.net/fr/é", "x" * 9000 + "://long.net/es/" + "y" * 9000, "http://a.net\n/fr/", "http:///path",
]


def brute(url, rules, default="allow"):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else None
    host = path = ""
    if rest is not None:
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:cut], rest[cut:]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.host + r.path), len(r.host)), default=None)
    return host, path, best.host + best.path if best else None, best.verdict if best else default


def test_against_brute_force(spark):
    rules = [*URL_RULES, U.Rule("block", "example.com", "/e"), U.Rule("allow", "x.net", ""), U.Rule("block", "x.net", "/es/x/")]
    urls = [*URLS, "http://x.net/es/x/y", "http://x.net/es/x", "http://example.com/ex"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit(1)).repartition(2)
    for some in (URL_RULES, rules):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.filter_urls(df, some).collect()}
        assert got == {i: brute(u, some) for i, u in enumerate(urls)}


def test_default_rules_for_all_and_empty(spark):
    df = spark.createDataFrame([(1, None), (1, "http://a.b/c")], "page_id long, url string")
    assert {r.verdict for r in U.filter_urls(df, [], default="block").collect()} == {"block"}
    assert [r.rule for r in U.filter_urls(df, [U.Rule("block", "")]).collect()] == ["", ""]
    assert U.filter_urls(df.limit(0), URL_RULES).count() == 0


def test_longest_counts_host_and_path_together(spark):
    rules = [U.Rule("block", "example.com", "/a/b/c/d"), U.Rule("allow", "www.example.com", "/"), U.Rule("allow", "w.net", "/ab"), U.Rule("block", "x.w.net", "/")]
    df = spark.createDataFrame([(1, "http://www.example.com/a/b/c/d/e"), (2, "http://www.example.com/a"), (3, "http://x.w.net/abc")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in U.filter_urls(df, rules).collect()}
    assert got == {1: ("example.com/a/b/c/d", "block"), 2: ("www.example.com/", "allow"), 3: ("x.w.net/", "block")}
