"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.joins import attach, masked, unmasked
from palimpsest.operators.relational import total_order
from palimpsest.storage import discard, stage

WORD = r"[^\x20\x09-\x0D]+"
#: Each row has a hash of LEVELS * LEVEL_BITS bits; each level refines one bucket per source into 2**LEVEL_BITS.
LEVEL_BITS, LEVELS = 12, 4
#: Sources up to this many are ranked in one task.
ONE_TASK = 100_000
ADDED = ["size", "source_size", "target", "copies", "taken"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _bits(hexed: Column, bits: int) -> Column:
    return F.conv(F.substring(hexed, 1, bits // 4), 16, 10).cast("long")


def row_hash(id_col: Column, text: Column) -> Column:
    """48 bits of the MD5 of ``id|text``; rows equal in both share it."""
    return _bits(F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))), LEVEL_BITS * LEVELS)


def source_key(source: Column) -> Column:
    """A string without null: empty for a null source."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit(""))


def _running(df: DataFrame, order: list[Column], weight: str, name: str, n: int) -> DataFrame:
    """Running sum including the row itself; beyond ONE_TASK rows in ranges of the order."""
    if n > ONE_TASK:
        return total_order(df, [], order, weight, name)
    return df.withColumn(name, F.sum(weight).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Targets by water filling: ``least(cap * size, level * weight)`` with the one level that spends the budget.

    ``sizes``, a staged table, has a row (key, source_size, ...) per source. Sorting sources by ``cap * size / weight`` gives the
    level in one pass: with the first sources full, the rest share what is left; this quotient rises while the next
    source would be full as well and falls after, so the level is its maximum. This equals sharing by weight,
    cutting at the cap and sharing the excess again until no source is above its cap.
    """
    n, total = sizes.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    ranked = _running(sizes.withColumn("one", F.lit(1).cast("long")), [F.col("key") == "", F.col("key")], "one", "place", n)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("w", w).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    by_ratio = [F.col("most") / F.col("w"), F.col("place")]
    filled = _running(ranked, by_ratio, "most", "spent", n)
    filled = stage(_running(filled, by_ratio, "w", "used", n), "mix-filled")
    all_w = F.lit(float(filled.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]))
    level = filled.agg(F.max((F.lit(float(share)) * F.lit(int(total)) - (F.col("spent") - F.col("most"))) / (all_w - F.col("used") + F.col("w")))).first()[0]
    target = F.least(F.col("most"), F.lit(float(level or 0)) * F.col("w"))
    return filled.select(*sizes.columns, target.alias("target"))


def _refined(slim: DataFrame, state: DataFrame) -> DataFrame:
    """The cell of one hash value in which each source's ``rest`` runs out: prefix, its words (mass) and rows (n), rest before it.

    ``slim``: key, size and hash h. One level per LEVEL_BITS bits; only the boundary bucket of a source goes on.
    """
    state = state.withColumns({"prefix": F.lit(0).cast("long"), "mass": F.lit(0).cast("long"), "n": F.lit(0).cast("long")})
    sources = state.count()
    for level in range(1, LEVELS + 1):
        above, below = LEVEL_BITS * (LEVELS - level + 1), LEVEL_BITS * (LEVELS - level)
        inside = attach(slim, state.select("key", "prefix", "rest", "n_rows"), ["key"], how="inner", count=sources).where(F.shiftright("h", above) == F.col("prefix"))
        cells = inside.groupBy("key", F.shiftright("h", below).alias("cell")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"), F.first("rest").alias("left"))
        upto = F.sum("words").over(Window.partitionBy("key").orderBy("cell"))
        crossing = cells.withColumn("upto", upto).where(F.col("upto") > F.col("left"))
        edge = crossing.groupBy("key").agg(F.min_by(F.struct("cell", "words", "rows", "upto"), "cell").alias("e"))
        kept = [c for c in state.columns if c not in ("prefix", "rest", "mass", "n")]
        refined = stage(
            state.join(edge, "key", "left").select(
                *kept,
                F.coalesce("e.cell", F.shiftleft("prefix", LEVEL_BITS)).alias("prefix"),
                F.coalesce(F.col("rest") - (F.col("e.upto") - F.col("e.words")), "rest").alias("rest"),
                F.coalesce("e.words", F.lit(0).cast("long")).alias("mass"),
                F.coalesce("e.rows", F.lit(0).cast("long")).alias("n"),
            ),
            "mix-state",
        )
        discard(state)
        state = refined
    return state


def _thresholds(slim: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Per source: whole copies of every row, and the cell in which the rest of its target runs out."""
    sizes = stage(slim.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")), "mix-sizes")
    target = source_targets(sizes, weights, share, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = target.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    return _refined(slim, stage(state, "mix-state"))


def _closer(mass: Column, rest: Column) -> Column:
    """Taking a last row of ``mass`` words comes nearer to the target than leaving it."""
    return (mass > 0) & (2 * rest >= mass)


def mix_sources(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, carry: Sequence[str] | None = None
) -> DataFrame:
    """Decide how often each row enters a mix of sources.

    Sources in code point order (null last) take ``weights`` in turn and share ``share`` times all words; no target
    is above ``cap`` times its source's words, what is above goes to the others by weight. A source takes
    ``floor(target / size)`` copies of all its rows; the remaining budget goes to the rows whose 48-bit hash lies
    below a threshold, found from sums of words by (source, hash bucket) with only the bucket on the boundary
    refined further. Rows are never sorted. Rows equal in id and text share their hash; where several of them make up
    the boundary, they are refined in the same way by a hash of all their columns and their place in a written table, so a
    source misses its target by half a row at most, however often rows repeat, and reruns differ at most in which of rows equal in all columns is taken.

    Returns ``docs`` with size, source_size, target, copies and taken (= copies * size); columns of these names
    are replaced. With ``carry``, only those columns are returned and the text is read once. Null text counts as
    empty (size 0); null ids and null sources are ordinary values; a source without words has target 0; an empty table
    gives an empty table. A source of any share of the rows is met by broadcast or split (``attach``).
    """
    kept = list(carry) if carry is not None else docs.columns
    rows, names = masked(docs)
    own = {"key": source_key(F.col(names[source_col])), "size": word_count(F.col(names[text_col])), "h": row_hash(F.col(names[id_col]), F.col(names[text_col]))}
    rows = rows.select(*[names[c] for c in kept], *[v.alias(k) for k, v in own.items()])
    if carry is not None:
        rows = stage(rows, "mix-rows")
        slim = rows.select(*own)
    else:
        slim = stage(rows.select(*own), "mix-slim")
    cuts = _thresholds(slim, weights, share, cap)
    facts = ["key", "source_size", "target", "whole", "n_rows"]
    cuts = stage(cuts.select(*facts, "rest", "n", "prefix", (F.col("prefix") + ((F.col("n") == 1) & _closer(F.col("mass"), F.col("rest"))).cast("long")).alias("cut")), "mix-cuts")
    met = attach(rows, cuts, ["key"], how="inner")
    many = (F.col("n") > 1) & (F.col("h") == F.col("prefix"))
    out = met.where(~many).withColumn("more", (F.col("h") < F.col("cut")).cast("long"))
    if cuts.where("n > 1").limit(1).count():
        edge = stage(met.where(many).drop("n", "prefix", "cut", "h", "rest"), "mix-edge")
        content = F.shiftright(F.xxhash64(*[names[c] for c in kept]), 40).bitwiseAND(F.lit((1 << 24) - 1))
        place = F.shiftright(F.xxhash64(F.monotonically_increasing_id()), 40).bitwiseAND(F.lit((1 << 24) - 1))
        edge = stage(edge.withColumn("h", F.shiftleft(content, 24).bitwiseOR(place)), "mix-edge")
        last = _refined(edge.select("key", "size", "h"), stage(cuts.where("n > 1").select("key", "n_rows", "rest"), "mix-state"))
        last = stage(last.select("key", "n_rows", (F.col("prefix") + _closer(F.col("mass"), F.col("rest")).cast("long")).alias("cut")), "mix-cuts")
        more = attach(edge, last, ["key"], how="inner").withColumn("more", (F.col("h") < F.col("cut")).cast("long"))
        shown = [*[names[c] for c in kept], "size", "source_size", "target", "whole", "more"]
        out = out.select(*shown).unionByName(more.select(*shown))
    copies = F.col("whole") + F.col("more")
    return out.select(
        *[F.col(names[c]).alias(c) for c in kept if c not in ADDED], "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix_sources`` takes it, with the columns of ``docs``."""
    rows, names = masked(docs)
    cols = {f"{k}_col": names[options.pop(f"{k}_col", d)] for k, d in (("id", "doc_id"), ("text", "text"), ("source", "source"))}
    taken = mix_sources(rows, **cols, **options)
    return unmasked(taken.select("*", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("again")), docs)
