"""SimHash links at a Jaccard similarity: a fingerprint per stratum of a text's shingles, met by Golay codewords, verified exactly.

A fingerprint of a whole text differs in about ten of 64 bits at a Jaccard similarity of 0.8, too many for keys of few errors.
So the pigeonhole goes over strata: shingles are dealt by hash to more strata than two similar texts can have differing
shingles, so one stratum at least is the same in both, and so are the codewords that its fingerprint's segments decode to.
Strata that differ a little often decode to the same codewords as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.components import connected_components
from palimpsest.llm.golay import SEGMENTS, codeword_index
from palimpsest.llm.joins import attach
from palimpsest.storage import discard, stage

WORDS, SIMILARITY = 5, 0.8
#: Numbers of strata: powers of the root of 2.
LADDER = np.unique(np.round(2 ** (np.arange(60) / 2)).astype(np.int64))
#: Strata of a text that give keys. Of longer texts, which have more strata, those count that have LEAST shingles or more;
#: a pair of similarity 0.8 then has no common key with probability below 1e-4.
STRATA, LEAST = 32, 3
#: Sets up to TINY have keys of single shingles; those up to SMALL twice as many strata, as some stay empty.
TINY, SMALL = 16, 63
#: In a long run sets are compared by the elements of their first CARRIED strata: all of them where there are no more strata.
#: Beyond that the share of common elements is an estimate, and SLACK standard deviations below the similarity is still a candidate.
CARRIED, SLACK = 256, 5
#: In runs of one key up to this long every pair is a candidate; longer ones first meet their least member.
SHORT_RUN = 16
#: A node's shingles are attached to at most so many candidate pairs in one task.
FAN = 256
#: Texts described at a time.
SLICE = 256
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 of a text's word shingles; fewer words: the whole sequence; none: empty."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tokens), 42)] if tokens else [], np.uint64)
    joined, n = b" ".join(tokens), len(tokens) - words + 1
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(size + 1) - 1
    starts, digest = ends - size, xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, n))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def differing(n: float, similarity: float) -> int:
    """Two sets of that similarity, the larger of n, differ in no more elements."""
    return int(n * (1 - similarity) / similarity + 1e-9)


def step_of(n: int, similarity: float) -> int:
    """Position in LADDER of the number of strata at which two sets meet, the larger of which has n elements."""
    d = differing(n, similarity)
    return int(np.searchsorted(LADDER, 2 * d + 1 if n <= SMALL else d + 1))


def steps(n: int, similarity: float) -> list[int]:
    """Positions at which a set of n elements has keys: its own, and those of larger sets it may be similar to."""
    most = int(n / similarity + 1e-9)
    if n <= SMALL:
        return sorted({step_of(m, similarity) for m in range(max(n, TINY + 1), most + 1)})
    return list(range(step_of(n, similarity), step_of(most, similarity) + 1))


def single_keys(s: np.ndarray, similarity: float) -> np.ndarray:
    """Of the sorted set, so many first elements that two sets of the similarity have one of them in common."""
    return s[: len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1] if len(s) <= TINY else s[:0]


def strata_of(s: np.ndarray, step: int) -> np.ndarray:
    return ((((s * _SPREAD) >> np.uint64(32)) * np.uint64(LADDER[step])) >> np.uint64(32)).astype(np.int64)


def strata_keys(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[np.ndarray]:
    """Keys of each shingle set: position in LADDER, stratum, and the codewords nearest to the three segments of its fingerprint.

    A single shingle is a stratum at position 0, and its hash the fingerprint.
    """
    owner, which, stratum, hashes = [], [], [], []
    for i, s in enumerate(sets):
        single = single_keys(s, similarity)
        if len(single):
            owner.append(np.full(len(single), i))
            which.append(np.zeros(len(single), np.int64))
            stratum.append(np.arange(len(single)))
            hashes.append(single)
        for step in steps(len(s), similarity) if len(s) else ():
            own = strata_of(s, step)
            used = own < STRATA
            hashes.append(s[used])
            stratum.append(own[used])
            owner.append(np.full(len(hashes[-1]), i))
            which.append(np.full(len(hashes[-1]), step))
    if not owner:
        return [np.empty(0, np.int64)] * len(sets)
    owner, which, stratum, hashes = map(np.concatenate, (owner, which, stratum, hashes))
    group = (owner * len(LADDER) + which) * STRATA + stratum
    order = np.argsort(group, kind="stable")
    group, hashes = group[order], hashes[order]
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    count = np.diff(np.append(starts, len(group)))
    votes = np.add.reduceat(np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), starts, axis=0, dtype=np.int32)
    fps = np.packbits(2 * votes > count[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    found = group[starts]
    which, owner = found // STRATA % len(LADDER), found // STRATA // len(LADDER)
    key = which * STRATA + np.where(which > 0, found % STRATA, 0)
    for at, bits in SEGMENTS:
        key = key << 12 | codeword_index(((fps >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int32))
    keep = (LADDER[which] <= STRATA) | (count >= LEAST)
    key, owner = key[keep], owner[keep]
    return np.split(key, np.searchsorted(owner, np.arange(1, len(sets))))


def described(rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """``rows`` (i, h, t) as (i, h, node, n, keys): node the hash of the shingle set, n its size."""
    kind = rows.schema["i"].dataType.simpleString()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, SLICE):
                part = b.slice(low, SLICE)
                sets = [shingle_set(t.as_py(), words) for t in part.column(2)]
                nodes = [xxhash.xxh64_intdigest(s.tobytes(), 1) - (1 << 63) for s in sets]
                columns = [part.column(0), part.column(1), pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(strata_keys(sets, similarity), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["i", "h", "node", "n", "keys"])

    return rows.select("i", "h", "t").mapInArrow(made, f"i {kind}, h long, node long, n int, keys array<long>")


def _runs(batches: Iterator[pa.RecordBatch], rows: int = 500_000) -> Iterator[list[np.ndarray]]:
    """The columns, in pieces that end where a run of equal keys (first column) ends."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
        if sum(len(x[0]) for x in held) >= rows:
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.searchsorted(whole[0], whole[0][-1]))
            if cut:
                yield [x[:cut] for x in whole]
            held = [[x[cut:] for x in whole]]
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _bounds(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, int)
    long = np.diff(edges) > 1
    return zip(edges[:-1][long].tolist(), edges[1:][long].tolist(), strict=True)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of runs of two or more."""
    for keys, nodes, sizes in _runs(batches):
        same = keys[1:] == keys[:-1]
        keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(nodes[keep]), pa.array(sizes[keep])], names=["key", "node", "n"])


def _ordered(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _first_pairs(similarity: float):
    """All pairs of short runs; each member of a long run with the least."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, nodes, sizes in _runs(batches):
            for s, e in _bounds(keys):
                v, n = nodes[s:e], sizes[s:e]
                i, j = np.triu_indices(e - s, 1) if e - s <= SHORT_RUN else (np.full(e - s - 1, at := int(v.argmin())), np.delete(np.arange(e - s), at))
                ok = np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9
                if ok.any():
                    yield _ordered(v[i][ok], v[j][ok])

    return made


def similar_in_run(sets: list[np.ndarray], apart: np.ndarray, similarity: float, exact: bool) -> Iterator[tuple[int, np.ndarray]]:
    """Similar pairs of different groups (``apart``) among the sets of a run, by (position, positions behind it).

    Where the sets are whole (``exact``) a set is linked only with sets that no earlier link connects it to, so there are fewer links than sets.
    """
    apart = apart.copy()
    sizes = np.array([len(s) for s in sets])
    numbers, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts, mark = np.cumsum(sizes) - sizes, np.zeros(len(numbers), np.int32)
    for i in range(len(sets) - 1):
        other = apart[i + 1 :] != apart[i]
        if not sizes[i] or not other.any():
            continue
        own = flat[starts[i] : starts[i] + sizes[i]]
        mark[own] = 1
        both = np.concatenate([[0], np.cumsum(mark[flat[starts[i + 1] :]])])
        low = starts[i + 1 :] - starts[i + 1]
        both = both[low + sizes[i + 1 :]] - both[low]
        mark[own] = 0
        union = sizes[i] + sizes[i + 1 :] - both
        least = similarity if exact else similarity - SLACK * np.sqrt(similarity * (1 - similarity) / np.maximum(union, 1))
        near = (both >= least * union - 1e-9) & other
        if near.any():
            found = np.flatnonzero(near)
            if exact:
                found = found[np.unique(apart[i + 1 :][found], return_index=True)[1]]
            yield i, i + 1 + found
            if exact:
                apart[np.isin(apart, apart[i + 1 + found])] = apart[i]


def _cross_pairs(similarity: float):
    """Pairs of a long run with different labels that are similar by the elements carried along."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, nodes, labels, carried in _runs(batches, 4096):
            for s, e in _bounds(keys):
                sets = [np.frombuffer(x, np.uint64) for x in carried[s:e]]
                for i, j in similar_in_run(sets, labels[s:e], similarity, bool(LADDER[int(keys[s]) >> 41] <= CARRIED)):
                    yield _ordered(np.full(len(j), nodes[s + i]), nodes[s + j])

    return made


def _carried(rows: DataFrame) -> DataFrame:
    """(key, node, label, shingles) with the shingles of the key's first CARRIED strata."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, SLICE):
                part = b.slice(low, SLICE)
                cut = []
                for key, whole in zip(part.column(0).to_pylist(), part.column(3), strict=True):
                    own = np.frombuffer(whole.as_buffer(), np.uint64)
                    cut.append((own if LADDER[key >> 41] <= CARRIED else own[strata_of(own, key >> 41) < CARRIED]).tobytes())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(cut, pa.binary())], names=["key", "node", "label", "shingles"])

    return rows.select("key", "node", "label", "shingles").mapInArrow(made, "key long, node long, label long, shingles binary")


def _sets(wanted: DataFrame, nodes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Staged (node, shingles) of the nodes in ``wanted``."""
    needed = nodes.join(wanted, "node").select("node", "of_i", F.col("of_h").alias("h"), F.lit(1).alias("n_rows"))
    needed = stage(needed, "near-needed")  # a text has one node, so its hash occurs once
    found = attach(texts, needed, ["h"], how="inner").where(F.col("i").eqNullSafe(F.col("of_i"))).select("node", "t")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, SLICE):
                part = b.slice(low, SLICE)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t.as_py(), words).tobytes() for t in part.column(1)], pa.binary())], names=["node", "shingles"])

    own = stage(found.mapInArrow(made, "node long, shingles binary").dropDuplicates(["node"]), "near-sets")
    discard(needed)
    return own


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose shingle sets have the similarity, compared on the whole sets.

    A node with many partners has its set sent to several tasks, FAN pairs each.
    """
    near = stage(pairs.distinct(), "near-pairs")
    own = _sets(near.select(F.col("a").alias("node")).union(near.select("b")).distinct(), nodes, texts, words)

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [jaccard(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) >= similarity for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    fans = stage(near.groupBy("a").agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > FAN).withColumn("fan", F.ceil(F.col("n_rows") / FAN).cast("int")), "near-fans")
    several = F.coalesce("fan", F.lit(1))
    left = own.withColumnRenamed("node", "a").join(fans, "a", "left").withColumn("part", F.explode(F.sequence(F.lit(0), several - 1)))
    dealt = attach(near, fans, ["a"]).withColumn("part", F.pmod(F.xxhash64("b"), several).cast("int"))
    with_left = dealt.join(left.select("a", "part", F.col("shingles").alias("x")), ["a", "part"])
    both = with_left.join(own.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    links = stage(both.mapInArrow(similar, "a long, b long"), "near-links")
    for used in (near, fans, own):
        discard(used)
    return links


def similar_labels(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(i, h, label) of each row of ``texts`` (i, h, t): rows linked by a Jaccard similarity of shingle sets share a label.

    Equal shingle sets are one node; texts without words are one too. Nodes that share a key are candidates; a long run of
    one key first meets its least member only. What is in different groups after that is compared in the run by its elements,
    and only links that connect groups are written (of sets with more than CARRIED strata: all that may be similar). Every link is verified on the whole sets.
    """
    rows = stage(described(texts, words, similarity), "near-rows")
    order = F.struct(F.col("i").isNull(), "i", "h")
    nodes = stage(rows.groupBy("node").agg(F.min_by(F.struct("i", "h", "n", "keys"), order).alias("r")).select("node", F.col("r.i").alias("of_i"), F.col("r.h").alias("of_h"), "r.n", "r.keys"), "near-nodes")
    by_key = nodes.select(F.explode("keys").alias("key"), "node", "n").repartition("key").sortWithinPartitions("key")
    runs = stage(by_key.mapInArrow(_shared, "key long, node long, n int"), "near-runs")
    met = runs.repartition("key").sortWithinPartitions("key")
    links = _verified(met.mapInArrow(_first_pairs(similarity), "a long, b long"), nodes, texts, words, similarity)
    labels = connected_components(links)
    known = runs.join(labels, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("label"))
    split = known.groupBy("key").agg(F.count("*").alias("rows"), (F.min("label") != F.max("label")).alias("several")).where(F.col("several") & (F.col("rows") > SHORT_RUN)).select("key")
    rest = stage(known.join(split, "key", "left_semi"), "near-rest")
    if rest.limit(1).count():
        own = _sets(rest.select("node").distinct(), nodes, texts, words)
        again = _carried(rest.join(own, "node")).repartition("key").sortWithinPartitions("key")
        more = _verified(again.mapInArrow(_cross_pairs(similarity), "a long, b long"), nodes, texts, words, similarity)
        if more.limit(1).count():
            labels = connected_components(links.union(more))
    labelled = stage(rows.select("i", "h", "node").join(labels, "node", "left").select("i", "h", F.coalesce("label", "node").alias("label")), "near-labels")
    for used in (rows, nodes, runs, rest):
        discard(used)
    return labelled
