"""Relational shapes: ordered counts, islands, forward fill, as-of and interval joins, balanced samples, set folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import let
from palimpsest.storage import stage


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total_order(df: DataFrame, keys: Sequence[str], order: Sequence[Column], weight: str, name: str) -> DataFrame:
    """Running sum of ``weight`` within ``keys`` in ``order``, ``name`` including the row itself.

    Meant for rows already aggregated by value. Without keys the sum would pass through one task, so rows go to ranges of
    the order first; each range sums its own and adds the totals of the ranges before it. The ranges are written once, as
    their bounds may come out differently when they are drawn again (by AQE, or after a lost executor).
    """
    if keys:
        return df.withColumn(name, F.sum(weight).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parted = stage(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    totals = parted.groupBy("__part").agg(F.sum(weight).alias("__sum"))
    base = totals.select("__part", F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    own = F.sum(weight).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return parted.withColumn(name, own).join(F.broadcast(base), "__part").withColumn(name, F.col(name) + F.col("__base")).drop("__part", "__base")


def sentences(docs: DataFrame, array: Column, keep: Sequence[str], name: str = "text", index: str = "sent_id") -> DataFrame:
    """A row per element of an array with its position; no shuffle."""
    return docs.select(*keep, F.posexplode(array).alias(index, name))


def sliding_chunks(array: Column, span: int = 3, empty: str = "(empty)") -> Column:
    """Chunks of 1 to ``span`` neighbours joined by a space, by span then start, each once; a fallback when there are none."""
    none = F.array().cast("array<string>")

    def chunks(xs: Column) -> Column:
        n = F.size(xs)
        of = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.array_join(F.slice(xs, i + 1, F.lit(k)), " "))).otherwise(none)
        return F.when(n > 0, F.array_distinct(F.concat(*[of(k) for k in range(1, span + 1)]))).otherwise(F.array(F.lit(empty)))

    return let(array, chunks)


def islands(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str = "block") -> DataFrame:
    """Numbers runs of equal neighbouring values from 1 within keys."""
    w = Window.partitionBy(*keys).orderBy(order)
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("__change", change).withColumn(name, F.sum("__change").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__change")


def forward_fill_sections(lines: Column, heading: str, drop: str | None = None) -> Column:
    """array<struct<title, body>> of lines under headings, as one fold.

    Lines before the first heading and headings without a body vanish; dropped lines never belong to a body.
    """
    row = "array<struct<title:string,body:string>>"
    start = F.struct(F.lit(None).cast("string").alias("title"), F.lit("").alias("body"), F.array().cast(row).alias("out"))
    closed = lambda a: F.when(a["title"].isNotNull() & (F.trim(a["body"]) != ""), F.array_append(a["out"], F.struct(a["title"].alias("title"), F.trim(a["body"]).alias("body")))).otherwise(a["out"])

    def step(a: Column, x: Column) -> Column:
        goes = x.rlike(drop) if drop else F.lit(False)
        opened = F.struct(F.trim(F.regexp_extract(x, heading, 2)).alias("title"), F.lit("").alias("body"), closed(a).alias("out"))
        grown = F.struct(a["title"].alias("title"), F.when(a["title"].isNotNull() & (F.trim(x) != ""), F.trim(F.concat_ws(" ", a["body"], F.trim(x)))).otherwise(a["body"]).alias("body"), a["out"].alias("out"))
        return F.when(goes, a).when(x.rlike(heading), opened).otherwise(grown)

    return F.aggregate(lines, start, step, closed)


def adjacent_pairs(df: DataFrame, keys: Sequence[str], order: str, kind: str, source: str, target: str, text: str, group: str | None = None) -> DataFrame:
    """Each ``source`` row with the next row if that is a ``target`` of the same group, else with the previous one."""
    w = Window.partitionBy(*keys).orderBy(order)
    same = (lambda shift: shift(group).over(w).eqNullSafe(F.col(group))) if group else (lambda shift: F.lit(True))
    nxt = F.when((F.lead(kind).over(w) == target) & same(F.lead), F.lead(text).over(w))
    prev = F.when((F.lag(kind).over(w) == target) & same(F.lag), F.lag(text).over(w))
    return df.withColumn("other", F.coalesce(nxt, prev)).where((F.col(kind) == source) & F.col("other").isNotNull())


def asof_forward(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, boundary: str, carry: Sequence[str] = ()) -> DataFrame:
    """Each left row with the first right row of its key at or after it (null where there is none).

    One union and one backward fill over the keys: no range join, whatever the number of boundaries.
    """
    cols = [c for c in left.columns if c not in keys]
    l_ = left.select(*keys, F.col(at).alias("__t"), F.lit(0).alias("__side"), F.struct(*cols).alias("__l"), F.lit(None).cast(right.select(F.struct(boundary, *carry)).schema[0].dataType).alias("__r"))
    r_ = right.select(*keys, F.col(boundary).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(l_.schema["__l"].dataType).alias("__l"), F.struct(boundary, *carry).alias("__r"))
    w = Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return l_.unionByName(r_).withColumn("__next", F.first("__r", ignorenulls=True).over(w)).where("__side = 0").select(*keys, "__l.*", *[F.col(f"__next.{c}").alias(c if c not in cols else f"next_{c}") for c in (boundary, *carry)])


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, other: str, width: int) -> DataFrame:
    """Pairs of rows of equal keys at most ``width`` apart, by cells of that width; left columns are named l_, right r_."""
    cell = F.floor(F.col(at) / width)
    a = left.select(*keys, *[F.col(c).alias(f"l_{c}") for c in left.columns if c not in keys], F.explode(F.array(cell - 1, cell, cell + 1)).alias("__cell"))
    b = right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys], F.floor(F.col(other) / width).alias("__cell"))
    return a.join(b, [*keys, "__cell"]).where(F.abs(F.col(f"l_{at}") - F.col(f"r_{other}")) <= width).drop("__cell")


def balanced_sample(df: DataFrame, kind: Sequence[str], group: str, n: int, seed: Column | int = 0, order: Sequence[Column] | None = None) -> DataFrame:
    """Up to ``n`` rows of each kind, taken in turn from its groups in a seeded order."""
    shuffled = list(order) if order is not None else [F.xxhash64(*df.columns, F.lit(seed))]
    within = F.row_number().over(Window.partitionBy(*kind, group).orderBy(*shuffled))
    picked = df.withColumn("__turn", within).where(F.col("__turn") <= n)
    return picked.withColumn("__rank", F.row_number().over(Window.partitionBy(*kind).orderBy("__turn", group))).where(F.col("__rank") <= n).drop("__turn", "__rank")


def per_group_limit(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def seeded_sample(df: DataFrame, n: int, seed: int, key: Sequence[str]) -> DataFrame:
    return df.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(n)


def keep_unlike(items: Column, within: float = 0.15) -> Column:
    """Of array<struct<cand, rate>>: longest, then highest first; one inside a kept one of nearly the same rate is dropped."""
    order = F.array_sort(items, lambda a, b: F.when(F.length(a["cand"]) != F.length(b["cand"]), F.length(b["cand"]) - F.length(a["cand"])).when(a["rate"] != b["rate"], F.when(a["rate"] > b["rate"], -1).otherwise(1)).otherwise(F.when(a["cand"] < b["cand"], -1).when(a["cand"] > b["cand"], 1).otherwise(0)))
    covered = lambda kept, x: F.exists(kept, lambda k: F.contains(k["cand"], x["cand"]) & (k["cand"] != x["cand"]) & (F.abs(k["rate"] - x["rate"]) < within))
    return F.aggregate(order, F.slice(items, 1, 0), lambda kept, x: F.when(covered(kept, x), kept).otherwise(F.array_append(kept, x)))


def longest_prefix(tokens: DataFrame, vocabulary: DataFrame, word: str, entry: str, value: str, least: int = 2) -> DataFrame:
    """``tokens`` with ``value`` of the vocabulary's longest prefix of each word (``least`` characters, or the word itself).

    Each distinct word is looked up once: prefixes explode on distinct words, an equi-join finds entries.
    """
    distinct = tokens.select(word).distinct().where(F.length(word) > 0)
    prefixes = distinct.select(word, F.explode(F.sequence(F.least(F.lit(least), F.length(word)), F.length(word))).alias("__n")).withColumn("__p", F.substring(F.col(word), F.lit(1), F.col("__n")))
    hit = prefixes.join(vocabulary.select(F.col(entry).alias("__p"), F.col(value)), "__p").groupBy(word).agg(F.max_by(value, "__n").alias(value))
    return tokens.join(hit, word, "left")


def anti_todo(grid: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return grid.join(done.select(*keys).distinct(), list(keys), "left_anti")


def latest(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key: that of the highest ``order`` (a later file overwrites)."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("__r")).select(*keys, "__r.*")


def column_profile(df: DataFrame, columns: Sequence[str], letter: str, sample: int | None = 200, least_chars: int = 8, least_rows: int = 5) -> DataFrame:
    """Mean letter share and length per column over its values of at least ``least_chars`` characters: ``sample`` of them by hash, or all."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns]))).where(F.length("v") >= least_chars)
    picked = long if sample is None else per_group_limit(long, ["column"], [F.xxhash64("v"), F.col("v")], sample)
    agg = picked.groupBy("column").agg(F.count("*").alias("n"), F.avg(F.regexp_count("v", F.lit(letter)) / F.length("v")).alias("letter_ratio"), F.avg(F.length("v")).alias("mean_length"))
    return agg.where(F.col("n") >= least_rows)


def spatial_nearest_greedy(boxes: DataFrame, page: str, min_overlap: float = 40.0, max_gap: float = 320.0) -> DataFrame:
    """Foreign boxes paired with the nearest free native box below, one to one, top to bottom on each page.

    ``boxes`` has page, id, kind ('foreign' or 'native'), x0, x1, y0, y1. Each choice depends on those before, so a page is
    one group; a page holds a bounded number of boxes.
    """
    import pandas as pd

    kind = boxes.schema[page].dataType.simpleString()

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        native = pdf[pdf["kind"] == "native"].sort_values(["y0", "x0", "id"]).to_dict("records")
        used, out = set(), []
        for f in pdf[pdf["kind"] == "foreign"].sort_values(["y0", "x0", "id"]).to_dict("records"):
            fits = [(n["y0"] - f["y1"], n["id"]) for n in native if n["id"] not in used and min(f["x1"], n["x1"]) - max(f["x0"], n["x0"]) >= min_overlap and 0 < n["y0"] - f["y1"] <= max_gap]
            if fits:
                gap, best = min(fits)
                used.add(best)
                out.append({page: f[page], "foreign_id": f["id"], "native_id": best, "gap": float(gap)})
        return pd.DataFrame(out, columns=[page, "foreign_id", "native_id", "gap"])

    return boxes.groupBy(page).applyInPandas(pair, f"{page} {kind}, foreign_id long, native_id long, gap double")


def lines_from_words(words: DataFrame, page: str, tolerance: float = 3.0) -> DataFrame:
    """Lines from word boxes (page, x, y, word): rows of one rounded height, words from left to right."""
    line = F.bround(F.col("y") / tolerance)
    rows = words.groupBy(page, line.alias("line")).agg(F.array_sort(F.collect_list(F.struct("x", "word"))).alias("w"))
    return rows.select(page, "line", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("text"))


def reading_order(blocks: DataFrame, page: str) -> DataFrame:
    return blocks.withColumn("position", F.row_number().over(Window.partitionBy(page).orderBy(F.bround("y0"), "x0")))
