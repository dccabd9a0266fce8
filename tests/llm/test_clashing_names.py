"""Input columns with the names that operators make inside come back as they were."""

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import exact_dedup, line_dedup, mixing, simhash, toxicity, url_filter

NAMES = ["__i", "__h", "__n", "__key", "__at", "__own", "__keep_id", "h", "i", "key", "label", "node", "size_", "rid", "n_rows", "in_0", "in_9", "k_h", "repeated", "cut", "rest", "t", "p"]
OPERATORS = {
    "mixing": lambda d: mixing.mix_sources(d),
    "mixed rows": lambda d: mixing.mixed_rows(d),
    "toxicity": lambda d: toxicity.score_toxicity(d, None),
    "lines": lambda d: line_dedup.remove_boilerplate(d, least_sites=2),
    "simhash": lambda d: simhash.simhash_dedup(d),
    "simhash bits": lambda d: simhash.simhash_dedup(d, bits=4),
    "exact": lambda d: exact_dedup.exact_dedup(d),
    "urls": lambda d: url_filter.filter_urls(d, [url_filter.Rule("block", "a.b")], url_col="text"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names(spark, name):
    docs = spark.createDataFrame([(i, f"http://a.b/{i}\nshared line", "xy"[i % 2]) for i in range(6)], "doc_id long, text string, source string")
    docs = docs.select("*", *[F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")).alias(c) for c in NAMES])
    out = OPERATORS[name](docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    rows = out.collect()
    assert rows and all(r[c] == f"{c} of {r.doc_id}" for r in rows for c in NAMES)
