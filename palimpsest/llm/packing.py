"""Packing token sequences: large items in pairs by greedy matching, small ones by best fit into what is left."""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from palimpsest.llm.joins import bound_batches
from palimpsest.storage import stage

CAPACITY = 4096
#: Pieces of one length are numbered within parts of about so many, so that a length which most pieces have is no single task;
#: up to LEAST_PARTS parts are smaller.
PART_ROWS, LEAST_PARTS, SMALL_PART = 200_000, 64, 64
#: Chunks (of up to CACHED_LENGTH characters) whose tokens a worker keeps; when full, it starts anew.
CACHE, CACHED_LENGTH = 250_000, 64
#: How a tokenizer must normalise and split for WordTokens: lower-cased, and cut at white space whatever stands around it. Fixed values.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_at_spaces(path: str) -> bool:
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    first = ((told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    marks = any(c.isspace() for t in told.get("added_tokens") or () for c in t["content"])
    return (told.get("normalizer") or {}).get("normalizers") == NORMALIZERS and first.get("pattern") == {"Regex": SPLIT} and first.get("behavior") == "Removed" and not marks


class PlainTokens:
    """Little-endian 32-bit ids of whole texts by any tokenizer."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class WordTokens(dict):
    """Little-endian 32-bit ids of a chunk without white space; chunks met before cost a lookup.

    White space always ends a token here, so a text's ids are its chunks' ids in a row. A chunk of plain Latin
    letters with ASCII marks behind it goes straight to the vocabulary's merges; any other goes through the whole
    tokenizer.
    """

    def __init__(self, path: str) -> None:
        import re

        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.plain = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?%$&*()\-]*)").fullmatch
        self.small: dict[str, bytes] = {}
        #: The printable stand-ins of byte-level vocabularies: visible Latin-1 characters stand for themselves, other bytes for 256 and up.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.bytes = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in set(shown))}

    def merged(self, word: str) -> bytes:
        if (got := self.small.get(word)) is None:
            units = word if word.isascii() else word.encode().decode("latin-1").translate(self.bytes)
            got = np.array([t.id for t in self.merges.tokenize(units)], "<u4").tobytes()
            if len(self.small) >= CACHE:
                self.small.clear()
            if len(word) <= CACHED_LENGTH:
                self.small[word] = got
        return got

    def __missing__(self, chunk: str) -> bytes:
        m = self.plain(chunk)
        if m:
            got = self.merged(m[1].lower()) + (self.merged(m[2]) if m[2] else b"")
        else:
            got = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) >= CACHE:
            self.clear()
        if len(chunk) <= CACHED_LENGTH:
            self[chunk] = got
        return got

    def ids(self, text: str) -> bytes:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # str.split() takes these as white space, the tokenizer doesn't
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, text.split()))


def pieces(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = CAPACITY, carry_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and ``end_id``, cut only where longer than ``capacity``."""
    kind = docs.schema[id_col].dataType.simpleString()
    bound_batches(docs.sparkSession)
    tokens_of = WordTokens if splits_at_spaces(tokenizer_path) else PlainTokens
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(tokenizer_path)
        for b in batches:
            for low in range(0, b.num_rows, 256):
                part = b.slice(low, 256)
                owner, piece, start, length, crc, ids = [], [], [], [], [], []
                for row, t in enumerate(part.column(1)):
                    whole = tokens.ids(t.as_py() or "") + end
                    for n, at in enumerate(range(0, len(whole), 4 * capacity)):
                        own = whole[at : at + 4 * capacity]
                        owner.append(row)
                        piece.append(n)
                        start.append(at // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                        if carry_ids:
                            ids.append(np.frombuffer(own, "<u4").astype(np.int32))
                columns = [part.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if carry_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * carry_ids
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(cut, schema)


class _Gaps:
    """Runs of bins by the room they have left: gap -> list of (first bin, bins)."""

    def __init__(self) -> None:
        self.keys: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def add(self, gap: int, first: int, n: int) -> None:
        if n > 0 and gap > 0:
            if gap not in self.runs:
                bisect.insort(self.keys, gap)
                self.runs[gap] = []
            self.runs[gap].append((first, n))

    def take(self, least: int) -> tuple[int, int, int] | None:
        """A run of bins with the smallest gap that is at least ``least``."""
        i = bisect.bisect_left(self.keys, least)
        if i == len(self.keys):
            return None
        gap = self.keys[i]
        first, n = self.runs[gap].pop()
        if not self.runs[gap]:
            del self.runs[gap]
            del self.keys[i]
        return gap, first, n


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Where pieces go, by length: (length, first rank, ranks, first bin, pieces a bin, offset in the bin).

    Ranks number the pieces of one length from 0. Lengths above a third of the capacity are matched greedily, the
    longest with the longest that fits beside it, at most two to a bin. All others, longest first, go by best fit
    into the smallest gap that holds them, and a bin is filled on while the same length fits. Work and result depend
    on how many lengths there are (``capacity`` at most), not on how many pieces.
    """
    out: list[tuple[int, int, int, int, int, int]] = []
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    gaps, bins = _Gaps(), 0
    large = sorted(n for n in left if 3 * n > capacity)

    def put(length: int, n: int, first: int, each: int, offset: int) -> None:
        out.append((length, used[length], n, first, each, offset))
        used[length] += n
        left[length] -= n

    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        i = bisect.bisect_right(large, capacity - a) - 1
        while i >= 0 and (not left[large[i]] or large[i] == a and left[a] < 2):
            i -= 1
        if i < 0:
            n = left[a]
            put(a, n, bins, 1, 0)
            gaps.add(capacity - a, bins, n)
        else:
            b = large[i]
            n = left[a] // 2 if a == b else min(left[a], left[b])
            put(a, n, bins, 1, 0)
            put(b, n, bins, 1, a)
            gaps.add(capacity - a - b, bins, n)
        bins += n
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[s]:
            found = gaps.take(s)
            if found is None:
                each = capacity // s
                found = (capacity, bins, -(-left[s] // each))
                bins += found[2]
            gap, first, n = found
            each = gap // s
            full = min(n, left[s] // each)
            if full:
                put(s, full * each, first, each, capacity - gap)
                gaps.add(gap - each * s, first, full)
            if full < n:
                rest = min(left[s], each)
                if rest:
                    put(s, rest, first + full, rest, capacity - gap)
                    gaps.add(gap - rest * s, first + full, 1)
                gaps.add(gap, first + full + (rest > 0), n - full - (rest > 0))
    return out


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (a stable table of ``pieces``) with sequence_id and offset.

    The driver gets one count per length. Each piece's rank among those of its length is its rank in a part of about PART_ROWS
    of them plus the parts before, so no length is sorted in one task. A part's ranks are a range; only the runs of the plan that
    meet this range are compared with its pieces. What is broadcast grows with lengths * LEAST_PARTS, plan and pieces / PART_ROWS.
    """
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    runs = [tuple(map(int, r)) for r in plan_bins(counts, capacity)]
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("length", "low", "n", "bin", "each", "at")])
    plan = stage(spark.createDataFrame(runs, schema), "pack-plan")
    shares = spark.createDataFrame([(int(k), max(-(-int(n) // PART_ROWS), min(LEAST_PARTS, -(-int(n) // SMALL_PART)))) for k, n in counts.items()], "length long, parts long")
    parted = cut.join(F.broadcast(shares), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("parts"))).drop("parts")
    sizes = parted.groupBy("length", "part").agg(F.count("*").alias("own"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "part", "own", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base"))
    p, b = plan.alias("p"), base.alias("b")
    meets = (F.col("b.length") == F.col("p.length")) & (F.col("p.low") < F.col("b.base") + F.col("b.own")) & (F.col("p.low") + F.col("p.n") > F.col("b.base"))
    cells = stage(b.join(F.broadcast(p), meets).select("b.length", "b.part", "b.base", "p.low", "p.n", "p.bin", "p.each", "p.at"), "pack-cells")
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = parted.withColumn("place", F.row_number().over(inside) - 1)
    rank = F.col("place") + F.col("base")
    placed = ranked.join(F.broadcast(cells), ["length", "part"]).where((rank >= F.col("low")) & (rank < F.col("low") + F.col("n")))
    step = rank - F.col("low")
    return placed.select(
        *cut.columns,
        (F.col("bin") + F.floor(step / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + step % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = CAPACITY, carry_ids: bool = False) -> DataFrame:
    """Documents as pieces of sequences of at most ``capacity`` tokens, in as few sequences as the method finds.

    Per piece: doc_id, piece (from 0), start, length, ids_crc32 (unsigned, over little-endian unsigned 32-bit ids),
    sequence_id, offset (gapless from 0) and, with ``carry_ids``, the ids. Null text counts as empty: a piece of the
    end id alone. Repeated rows and null ids are packed like others, other columns don't matter. An empty table gives an empty
    table. Any tokenizer file will do; one that cuts at white space is fed word by word.
    """
    cut = stage(pieces(docs, tokenizer_path, id_col=id_col, text_col=text_col, end_id=end_id, capacity=capacity, carry_ids=carry_ids), "pack-pieces")
    return place(cut, capacity)
