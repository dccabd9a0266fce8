"""Exact top-k inner products by a three-phase uniform threshold over slices of the dimensions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.storage import discard, stage

#: Queries of a tile, and vectors scored against them at a time.
QUERIES, ROWS = 2048, 1024
#: The lists of local scores: one per slice of the dimensions.
SLICES = 2
#: Bytes of the vectors of a tile, and least tiles over the vectors.
TILE_BYTES, TILES = 1 << 25, 16
_EXACT = 2.0**53
_LONG = (1 << 63) - 1
#: Pairs whose slices were added up, by phase; for tests on a local session's own thread.
resolved = {"listed": 0, "survivors": 0}


def quantised(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component in double precision, null where the vector is null or holds a null, NaN or infinity.

    Doubles of 2**53 and more are whole already (and beyond the range of floor's result).
    """
    good = embedding.isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    floored = lambda x: F.when(F.abs(x) >= _EXACT, x).otherwise(F.floor(x).cast("double"))
    return F.when(good, F.transform(embedding, lambda x: floored(x.cast("double") * scale)))


def _by_length(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(components, positions, matrix) of a table's vectors (column x), by number of components."""
    lists = table.column("x").combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
    lengths, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for d in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == d)
        yield d, at, flat[starts[at][:, None] + np.arange(d)].reshape(len(at), d)


class _Scores:
    """Partial scores of one block of queries and rows by slice; exact, whatever the size of the components.

    Products stay exact in doubles while they are sure to stay below 2**53. Pairs with a vector of larger components are scored in
    whole numbers of any size, and count as the largest or smallest long where they leave its range.
    """

    def __init__(self, q: np.ndarray, x: np.ndarray, own: np.ndarray) -> None:
        d = q.shape[1]
        most = (_EXACT / max(d, 1)) ** 0.5
        cuts = np.linspace(0, d, SLICES + 1).astype(int)
        self.parts = [q[:, a:b] @ x[:, a:b].T for a, b in zip(cuts, cuts[1:], strict=False)]
        wide_q, wide_x = (np.abs(m).max(axis=1, initial=0) >= most for m in (q, x))
        wide = wide_q[:, None] | wide_x[None, :]
        self.wide = np.nonzero(wide & ~own) if wide.any() else (np.empty(0, int), np.empty(0, int))
        for p in self.parts:
            p[own | wide] = -np.inf
        whole = lambda m, at: {i: [int(c) for c in m[i]] for i in np.unique(at).tolist()}
        qs, xs = whole(q, self.wide[0]), whole(x, self.wide[1])
        pairs = zip(*(i.tolist() for i in self.wide), strict=True)
        self.wide_scores = [max(min(sum(a * b for a, b in zip(qs[i], xs[j], strict=True)), _LONG), -_LONG - 1) for i, j in pairs]

    def listed(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs on the local lists: the k best partial scores of each query in each slice."""
        n = min(k, self.parts[0].shape[1])
        best = np.concatenate([np.argpartition(-p, n - 1, axis=1)[:, :n] for p in self.parts], axis=1)
        best.sort(axis=1)
        new = np.concatenate([np.ones((len(best), 1), bool), best[:, 1:] != best[:, :-1]], axis=1)
        i, c = np.nonzero(new)
        return i, best[i, c]

    def above(self, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of which some slice reaches the query's share of its cutoff."""
        return np.nonzero(np.logical_or.reduce([p >= share[:, None] for p in self.parts]))

    def resolve(self, i: np.ndarray, j: np.ndarray, phase: str) -> np.ndarray:
        resolved[phase] += len(i)
        return sum(p[i, j] for p in self.parts)


def _blocks(v: pa.Table, q: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, _Scores]]:
    """(positions of queries, positions of rows, their scores), ROWS rows at a time, of vectors with as many components."""
    queries = {d: (at, m) for d, at, m in _by_length(q)}
    q_row, v_row = q.column("row").to_numpy(), v.column("row").to_numpy()
    for d, at, x in _by_length(v):
        if d in queries:
            q_at, m = queries[d]
            for low in range(0, len(at), ROWS):
                part = at[low : low + ROWS]
                yield q_at, part, _Scores(m, x[low : low + ROWS], q_row[q_at][:, None] == v_row[part][None, :])


def _bounds(k: int):
    """Phase 1: the k best scores of each query among the pairs on the tile's lists."""

    def made(v: pa.Table, q: pa.Table) -> pa.Table:
        best = np.full((q.num_rows, k), -np.inf)
        for q_at, _, scores in _blocks(v, q):
            i, j = scores.listed(k)
            found, whose = scores.resolve(i, j, "listed"), i
            if scores.wide_scores:
                found = np.concatenate([found, [np.nextafter(float(s), -np.inf) for s in scores.wide_scores]])
                whose = np.concatenate([whose, scores.wide[0]])
            order = np.lexsort((-found, whose))
            found, whose = found[order], whose[order]
            place = np.arange(len(whose)) - np.searchsorted(whose, whose)
            table = np.full((len(q_at), k), -np.inf)
            table[whose[place < k], place[place < k]] = found[place < k]
            best[q_at] = -np.sort(-np.concatenate([best[q_at], table], axis=1), axis=1)[:, :k]
        i, j = np.nonzero(np.isfinite(best))
        return pa.table({"q": q.column("q").take(pa.array(i)), "bound": pa.array(best[i, j])})

    return made


def _entries(k: int):
    """Phases 2 and 3: entries above the cutoff's share, resolved; the tile's k best of each query."""

    def made(v: pa.Table, q: pa.Table) -> pa.Table:
        cutoff = np.array([-np.inf if c is None else c for c in q.column("cutoff").to_pylist()])
        ids = v.column("id").to_numpy()
        qs, vs, ss = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        for q_at, part, scores in _blocks(v, q):
            safe = cutoff[q_at]
            i, j = scores.above(np.where(np.isfinite(safe), safe / SLICES, -np.finfo(float).max))
            total = scores.resolve(i, j, "survivors")
            good = total >= safe[i]
            pairs = [(q_at[i[good]], ids[part[j[good]]], total[good].astype(np.int64))]
            if scores.wide_scores:
                reach = [s >= safe[a] for a, s in zip(scores.wide[0].tolist(), scores.wide_scores, strict=True)]
                pairs.append((q_at[scores.wide[0][reach]], ids[part[scores.wide[1][reach]]], np.array(scores.wide_scores, object)[reach].astype(np.int64)))
            qs, vs, ss = (np.concatenate([own, *more]) for own, more in zip((qs, vs, ss), zip(*pairs, strict=True), strict=True))
            order = np.lexsort((vs, ~ss, qs))  # ~s falls as s rises and, unlike -s, never leaves the range of a long
            qs, vs, ss = qs[order], vs[order], ss[order]
            keep = np.arange(len(qs)) - np.searchsorted(qs, qs) < k
            qs, vs, ss = qs[keep], vs[keep], ss[keep]
        at = pa.array(qs)
        return pa.table({"q": q.column("q").take(at), "query_id": q.column("id").take(at), "vec_id": pa.array(vs), "score": pa.array(ss)})

    return made


def top_k(vectors: DataFrame, queries: Column | DataFrame, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """The ``k`` highest integer inner products of each query: query_id, rank (from 1), vec_id, score.

    ``queries`` is a condition on ``vectors``: each row that fulfils it meets every row but itself, also one that repeats its id. Or it is
    a table of the same shape, whose rows meet every row of ``vectors``. Ties go to the smaller id. Components become
    floor(scale * x). Vectors that are null or hold null, NaN or infinity take no part, null ids neither; vectors of different
    lengths do not meet. A repeated query row is a query of its own, a repeated vector an entry of its own. Scores are exact for
    components of any size; one outside the range of long counts as its end. Empty in, empty out; other columns don't matter.

    Queries and vectors are dealt to tiles, where a bounded number of both meet on an executor; nothing of either passes the driver.
    (1) Each tile keeps a local score list per slice of the dimensions, the k best partial scores of each query, adds up the
    slices of the listed pairs alone and reports its k best as lower bounds; the k-th best of all reports is a safe cutoff. (2) Cutoffs go to
    every tile with the queries. A vector reaches cutoff c only if some slice scores c / SLICES or more, so only the entries
    above that are collected. (3) Their remaining slices are added, and the best k of each tile meet in a window of a few rows
    per query. Stated queries against all rows, in blocks: the work is queries x rows, what moves are the vectors once per QUERIES
    queries, the queries once per tile, and k rows per query and tile.
    """
    def own(df: DataFrame, *more: Column) -> DataFrame:
        return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), quantised(F.col(f"`{vector_col}`"), scale).alias("x"), *more).where("id is not null and x is not null")

    inside = isinstance(queries, Column)
    rows = own(vectors, F.coalesce(queries, F.lit(False)).alias("asked")) if inside else own(vectors)
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "topk-vectors")
    asked = rows.where("asked").select("id", "x", "row") if inside else own(queries).withColumn("row", F.lit(-1).cast("long"))
    asked = stage(asked.withColumn("q", F.monotonically_increasing_id()), "topk-queries")
    n, longest = rows.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    blocks = -(-asked.count() // QUERIES)
    if not n or not blocks:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    tiles = max(-(-n * longest * 8 // TILE_BYTES), TILES)
    dealt = rows.select("id", "x", "row", F.pmod(F.xxhash64("row"), F.lit(tiles)).alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    places = asked.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int"))
    to_tiles = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))).alias("tile")

    def in_tiles(some: DataFrame, made, schema: str) -> DataFrame:
        return dealt.groupBy("tile", "block").cogroup(some.select("*", to_tiles).groupBy("tile", "block")).applyInArrow(made, schema)

    reports = in_tiles(places, _bounds(k), "q long, bound double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("bound").desc()))
    cutoffs = stage(reports.withColumn("n", rank).where(F.col("n") == k).select("q", F.col("bound").alias("cutoff")), "topk-cutoffs")
    told = places.join(cutoffs, "q", "left")
    kept = in_tiles(told, _entries(k), "q long, query_id long, vec_id long, score long")
    last = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id"))
    found = stage(kept.withColumn("rank", last).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "topk-found")
    for used in (rows, asked, cutoffs):
        discard(used)
    return found
