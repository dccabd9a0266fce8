"""SimHash near-duplicate classes; candidates by Golay-code fuzzy hashing of fingerprint segments."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.components import connected_components
from palimpsest.llm.golay import SEGMENTS, codeword_index
from palimpsest.llm.joins import attach, bound_batches, masked, unmasked
from palimpsest.llm.strata import similar_labels
from palimpsest.storage import stage

#: No vector has more neighbouring codewords than this: its own, and at most 5 at distance 4.
KEYS = 6


def fingerprint(text: str | None, words: int = 4) -> int:
    """Majority of the XXH64 (seed 42) bits of a text's word shingles; fewer words: the whole sequence; none: 0."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), 42)
    joined, n = b" ".join(tokens), len(tokens) - words + 1
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = ends - np.fromiter(map(len, tokens), np.int64, len(tokens)) - 1
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        some = zip(starts[at : min(at + 65536, n)].tolist(), (ends[at + words - 1 : min(at + 65536, n) + words - 1] - 1).tolist(), strict=True)
        h = np.array([digest(joined[s:e], 42) for s, e in some], np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int((np.uint64(1) << np.flatnonzero(2 * votes > n).astype(np.uint64)).sum(dtype=np.uint64))


def fingerprints(rows: DataFrame, words: int) -> DataFrame:
    """``rows`` (i, h, t) as (i, h, fp), fp the fingerprint's 64 bits as a signed long."""
    kind = rows.schema["i"].dataType.simpleString()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], names=["i", "h", "fp"])

    return rows.mapInArrow(made, f"i {kind}, h long, fp long")


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def segment_keys(v: np.ndarray, bits: int) -> np.ndarray:
    """(n, KEYS) codeword indices of each vector and its neighbours at distance 1, each once, -1 where there are fewer.

    Vectors at distance 2 or less share one: that of the vector between them. Vectors at most 2 from their own
    codeword have 1 key, all others up to 6.
    """
    near = np.concatenate([np.zeros(1, np.int32), np.int32(1) << np.arange(bits, dtype=np.int32)])
    all_ = np.sort(codeword_index(v[:, None].astype(np.int32) ^ near), axis=1)
    new = np.concatenate([np.ones((len(v), 1), bool), all_[:, 1:] != all_[:, :-1]], axis=1)
    out = np.full((len(v), KEYS), -1, np.int32)
    rows, cols = np.nonzero(new)
    out[rows, (np.cumsum(new, axis=1) - 1)[rows, cols]] = all_[rows, cols]
    return out


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``fps``, key): for each pair of segments the pairs of their codeword indices.

    Two fingerprints with at most 4 differing bits share a key: of three segments the two with the fewest errors
    have at most 2 each, as 3 errors in one of them would mean 3 in the worst too.
    """
    u = fps.view(np.uint64)
    each = [segment_keys(((u >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int32), bits) for at, bits in SEGMENTS]
    rows, keys = [], []
    for n, (a, b) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        x, y = each[a][:, :, None], each[b][:, None, :]
        at, i, j = np.nonzero((x >= 0) & (y >= 0))
        rows.append(at)
        keys.append((np.int32(n) << 24) | (each[a][at, i] << 12) | each[b][at, j])
    return np.concatenate(rows), np.concatenate(keys)


def keyed(nodes: DataFrame) -> DataFrame:
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                fps = b.column(0).to_numpy(zero_copy_only=False)
                for at in range(0, len(fps), 2048):
                    rows, keys = golay_keys(fps[at : at + 2048])
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[at : at + 2048][rows])], names=["key", "fp"])

    return nodes.select("fp").mapInArrow(made, "key int, fp long")


#: In runs of one key up to this long every pair is compared and linked; longer ones give a spanning forest.
SHORT_RUN = 16


def spanning_links(fps: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is connected among the fingerprints of a key, one fewer than each component has members.

    Each fingerprint is compared with all that are not yet reached, in one array operation.
    """
    rest, out = np.unique(fps), []
    while len(rest):
        ahead, rest = [rest[0]], rest[1:]
        while ahead and len(rest):
            at = ahead.pop()
            near = np.bitwise_count((rest ^ at).view(np.uint64)) <= bits
            if near.any():
                found, rest = rest[near], rest[~near]
                out.append((np.full(len(found), at), found))
                ahead.extend(found)
    return out


def run_links(keys: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links within runs of equal keys."""
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, int)
    sizes = np.diff(np.append(edges, len(keys)))
    out = [link for at, n in zip(edges[sizes > SHORT_RUN], sizes[sizes > SHORT_RUN], strict=True) for link in spanning_links(fps[at : at + n], bits)]
    left = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SHORT_RUN), sizes))
    for shift in range(1, SHORT_RUN):
        left = left[left + shift < len(keys)]
        left = left[keys[left] == keys[left + shift]]
        if not len(left):
            break
        near = np.bitwise_count((fps[left] ^ fps[left + shift]).view(np.uint64)) <= bits
        out.append((fps[left[near]], fps[left[near] + shift]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def links(nodes: DataFrame, bits: int = 4) -> DataFrame:
    """Links (a, b), a < b, of distinct fingerprints that differ in 1 to ``bits`` (4 at most) bits.

    Fingerprints meet by key in one shuffle and are verified there. All pairs of a short run are linked; of a long run,
    which is a large group of near copies, only as many as connect the same fingerprints, so that links grow with
    the fingerprints and not with the square of a group. The components are those of all links.
    """
    if not 0 <= bits <= 4:
        raise ValueError("two segments with at most 2 errors each are sure for 4 differing bits or fewer")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def told(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            a, b = run_links(keys, fps, bits)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            rows += batch.num_rows
            if rows >= 500_000:
                keys, fps = (np.concatenate(x) for x in zip(*held, strict=True))
                whole = int(np.searchsorted(keys, keys[-1]))  # the last run may go on
                if whole:
                    yield told(keys[:whole], fps[:whole])
                held, rows = [(keys[whole:], fps[whole:])], 0
        if held:
            keys, fps = (np.concatenate(x) for x in zip(*held, strict=True))
            yield told(keys, fps)

    met = keyed(nodes).repartition("key").sortWithinPartitions("key")
    return met.mapInArrow(made, "a long, b long").distinct()


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bound_batches(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").alias("i"), text_hash(text).alias("h"), text.alias("t"))


def _components(texts: DataFrame, words: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """Staged rows (i, h, fp), and the fingerprints that several rows have or that are linked (fp, label, component_id, n_rows)."""
    rows = stage(fingerprints(texts, words), "simhash-rows")
    nodes = stage(rows.groupBy("fp").agg(F.min("i").alias("least"), F.count("*").alias("n_rows")), "simhash-nodes")
    labels = connected_components(links(nodes, bits))
    linked = stage(nodes.join(labels.withColumnRenamed("node", "fp"), "fp"), "simhash-linked")
    least = stage(linked.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("n_rows")), "simhash-least")
    known = attach(linked, least, ["label"], how="inner").select("fp", "label", "component_id", "n_rows")
    alone = nodes.where("n_rows > 1").join(labels.withColumnRenamed("node", "fp"), "fp", "left_anti")
    return rows, stage(known.unionByName(alone.select("fp", F.col("fp").alias("label"), F.col("least").alias("component_id"), "n_rows")), "simhash-ids")


def simhash_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Words are split at ASCII white space after lower-casing A-Z; shingles of ``words`` words count with repeats; a
    text of fewer words is one shingle, one without words (null, empty) has fingerprint zero and is linked like any
    other. Links join fingerprints with at most ``bits`` differing bits. Equal fingerprints are one node, however
    many rows have them; candidates meet by Golay keys and each is verified. A component of null ids only has
    component_id null; a null id never stands before an id. Empty in, empty out; other columns don't matter.
    """
    rows, ids = _components(_texts(docs, id_col, text_col), words, bits)
    found = attach(rows, ids, ["fp"])
    return found.select(F.col("i").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("label").isNull(), F.col("i")).otherwise(F.col("component_id")).alias("component_id"))


def simhash_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, bits: int | None = None, similarity: float = 0.8) -> DataFrame:
    """``docs`` (all its columns) with one row of each group of near copies: that of the smallest id, of these the smallest text hash.

    Texts are linked by a Jaccard similarity of word shingles of ``similarity`` or more (see ``strata``), or, with ``bits``, by
    fingerprints that differ in at most so many bits, as in ``simhash_groups``. Null ids come last, null text counts as empty and
    all texts without words are one group. Only ids of rows that go meet ``docs`` again. Of rows that repeat the same id and
    text the one stays whose other columns hash least, so reruns agree. Empty in, empty out; column names are free.
    """
    texts = _texts(docs, id_col, text_col)
    if bits is None:
        return keep_first(docs, similar_labels(texts, words, similarity), id_col, text_col)
    rows, ids = _components(texts, words, bits)
    return keep_first(docs, attach(rows, ids, ["fp"]).select("i", "h", F.coalesce("label", "fp").alias("label")), id_col, text_col)


def keep_first(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with the first row of each label; ``labelled``: label, id i and text hash h of every row.

    Rows are aggregated before they meet, by (label, i, h) and by label; no join is on the label.
    """
    pairs = stage(labelled.groupBy("i", "h", "label").agg(F.count("*").alias("n")), "first-pairs")
    order = F.struct(F.col("i").isNull().alias("z"), F.col("i").alias("i"), F.col("h").alias("h"))
    first = pairs.groupBy("label").agg(F.min(order).alias("f")).select(F.col("f.i").alias("fi"), F.col("f.h").alias("fh")).distinct()
    judged = pairs.join(first, F.col("i").eqNullSafe(F.col("fi")) & (F.col("h") == F.col("fh")), "left")
    stays = F.col("fh").isNotNull()
    moved = stage(judged.where(~stays | (F.col("n") > 1)).groupBy("i", "h").agg(F.max(stays).alias("stays"), F.sum("n").alias("n_rows")), "first-moved")
    rows, names = masked(docs)
    i, text = (F.col(names[c]) for c in (id_col, text_col))
    # a null id joins by a flag beside a null-free stand-in, so that the joins stay equi-joins on plain columns
    keyed = rows.withColumns({"k_null": i.isNull(), "k_h": text_hash(text), "k_i": F.coalesce(F.xxhash64(i), F.lit(0))})
    small = moved.select(F.col("i").isNull().alias("k_null"), F.col("h").alias("k_h"), F.coalesce(F.xxhash64("i"), F.lit(0)).alias("k_i"), "stays", "n_rows")
    small = stage(small.groupBy("k_null", "k_h", "k_i").agg(F.max("stays").alias("stays"), F.sum("n_rows").alias("n_rows")), "first-moved")
    met = attach(keyed, small, ["k_null", "k_h", "k_i"])
    alone = unmasked(met.where("stays is null"), docs)
    repeated = met.where("stays").groupBy("k_null", "k_h", "k_i").agg(F.min_by(F.struct(*names.values()), F.xxhash64(*names.values())).alias("r")).select("r.*")
    return alone.unionByName(unmasked(repeated, docs))
