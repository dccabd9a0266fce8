"""Cross-site boilerplate lines: HyperLogLog sketches of sites per line hash, exact counts near the threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import let
from palimpsest.llm.joins import BROADCAST_ROWS, attach, masked
from palimpsest.storage import stage

#: Lines with at least this many distinct sites are boilerplate.
LEAST_SITES = 4
#: log2 of a sketch's registers; the relative error is about 1.04 / sqrt(2**LG_K).
LG_K = 8
#: Estimates within so many standard errors of the threshold are counted exactly.
MARGIN = 5
#: Removals are broadcast up to so many bytes (32 for a text, 4 for each position), else joined by shuffle.
BROADCAST_BYTES = 1 << 26


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _line_key(line: Column) -> Column:
    """128-bit hash of a line without spaces, tabs and returns at its ends; null for a blank line, which is never boilerplate."""
    bare = F.regexp_replace(line, r"^[\x20\t\r]+|[\x20\t\r]+\z", "")
    return F.when(F.length(bare) > 0, F.unhex(F.md5(bare)))


def _flags(positions: Column) -> Column:
    """array<boolean>, true at the positions; looked up by index, so a text of many removals stays linear."""
    step = lambda at, before: F.concat(F.array_repeat(F.lit(False), at - before - 1), F.array(F.lit(True)))
    return let(F.array_sort(positions), lambda xs: F.flatten(F.zip_with(xs, F.concat(F.array(F.lit(-1)), F.slice(xs, F.lit(1), F.size(xs) - 1)), step)))


def _line_keys(docs: DataFrame, text_col: str, site_col: str) -> DataFrame:
    """Staged (key, site, lines): the text's hash, its site, the hash of each of its lines in order; no row for a null text."""
    text = F.col(f"`{text_col}`")
    return stage(docs.where(text.isNotNull()).select(F.unhex(F.md5(text)).alias("key"), F.col(f"`{site_col}`").cast("string").alias("site"), F.transform(lines_of(text), _line_key).alias("lines")), "line-keys")


def _spread(slim: DataFrame, least_sites: int) -> DataFrame:
    """(line, n_rows): boilerplate lines and in how many rows with a site they occur."""
    lines = slim.where("site is not null").select("site", F.explode(F.array_distinct("lines")).alias("line")).where("line is not null")
    estimate = F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K)))
    spread = stage(lines.groupBy("line").agg(F.count("*").alias("n_rows"), estimate.alias("sites")).where(F.col("n_rows") >= least_sites), "line-spread")
    error = MARGIN * 1.04 / 2 ** (LG_K / 2)
    low, high = least_sites * (1 - error) - 1, least_sites * (1 + error) + 1
    near = stage(spread.where(F.col("sites").between(low, high)).select("line", "n_rows"), "line-near")
    few = near.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    # occurrences become one row per line and site before anything is shuffled by line
    pairs = lines.join(F.broadcast(near.select("line")), "line", "left_semi").distinct() if few else lines.distinct().join(near.select("line"), "line", "left_semi")
    exact = pairs.groupBy("line").agg(F.count("*").alias("sites")).where(F.col("sites") >= least_sites)
    return spread.where(F.col("sites") > high).select("line", "n_rows").unionByName(near.join(exact.select("line"), "line", "left_semi"))


def boilerplate_lines(docs: DataFrame, *, text_col: str = "text", site_col: str = "source", least_sites: int = LEAST_SITES) -> DataFrame:
    """Hashes (line) of lines that occur in at least ``least_sites`` distinct non-null sites.

    One sketch per line hash merges by map-side aggregation, so a line in every document sends one sketch per task.
    Lines whose estimate lies within MARGIN standard errors of the threshold get an exact distinct count; above and
    below, the estimate decides.
    """
    return _spread(_line_keys(docs, text_col, site_col), least_sites).select("line")


def remove_boilerplate(docs: DataFrame, *, text_col: str = "text", site_col: str = "source", least_sites: int = LEAST_SITES) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, and n_lines and n_removed (columns of these names are replaced).

    Lines end at a newline; white space at a line's ends does not count for equality; blank lines always stay. A null
    text stays null with n_lines 0, an empty one has one line. Rows with a null site lose boilerplate lines
    but do not count towards them. Every copy of a boilerplate line goes. Lines are hashed once. Removals depend on a text
    alone, so they are found once per distinct text and meet the rows by the text's 128-bit hash: by broadcast up to
    BROADCAST_BYTES, else by shuffle; lines and texts that many rows have are split. Empty in, empty out; column names are free.
    """
    slim = _line_keys(docs, text_col, site_col)
    bad = stage(_spread(slim, least_sites), "line-boilerplate")
    placed = slim.select("key", F.posexplode("lines").alias("at", "line")).where("line is not null")
    found = attach(placed, bad, ["line"], how="left_semi", broadcast_rows=BROADCAST_ROWS).groupBy("key", "at").agg(F.count("*").alias("n"))
    gone = stage(found.groupBy("key").agg(F.collect_list("at").alias("gone"), F.max("n").alias("n_rows")), "line-removals")
    size = gone.agg(F.coalesce(F.sum(32 + 4 * F.size("gone")), F.lit(0))).first()[0]
    rows, names = masked(docs)
    text = F.col(names[text_col])
    met = attach(rows.withColumn("key", F.unhex(F.md5(text))), gone, ["key"], broadcast_rows=0, count=0 if size <= BROADCAST_BYTES else 1)
    left = let(_flags(F.col("gone")), lambda flags: F.filter(lines_of(text), lambda x, i: ~F.coalesce(F.get(flags, i), F.lit(False))))
    clean = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(left, "\n"))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(lines_of(text))).cast("long")
    made = {text_col: clean, "n_lines": n_lines, "n_removed": F.coalesce(F.size("gone"), F.lit(0)).cast("long")}
    kept = [(made[c] if c in made else F.col(names[c])).alias(c) for c in docs.columns]
    return met.select(*kept, *[made[c].alias(c) for c in ("n_lines", "n_removed") if c not in docs.columns])
