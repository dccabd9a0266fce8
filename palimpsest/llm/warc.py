"""WARC archives: written from pages, and read back by boundary-chain verification."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.joins import attach, masked
from palimpsest.storage import fresh_path, stage

#: Every record starts so, with a minor version behind it; archives are cut here.
MAGIC = "WARC/1."
VERSIONS = (b"0\r\n", b"1\r\n")
#: Repeated payloads are broadcast up to this many (about 50 bytes each), else joined by shuffle.
BROADCAST_ROWS = 500_000
#: Least and most bytes of the ranges in which archives are read; between them a file has RANGES of them.
LEAST_RANGE, MOST_RANGE, RANGES = 1 << 16, 1 << 26, 8
#: Parts of records with the magic inside meet their records by cells of so many bytes.
CELL = 1 << 20


def base32(hexed: Column) -> Column:
    """Upper-case base32 (RFC 4648) of a hex string of a multiple of 20 bits."""
    digits = F.concat(*[F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)])
    return F.translate(F.upper(digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_roles(rows: DataFrame, *, own: str, payload: Column, least_bytes: int) -> DataFrame:
    """``rows`` (of columns in_0, in_1, ...) with payload, bytes, and refers (null for a response).

    Of records with equal payloads (SHA-256) of at least ``least_bytes`` bytes, the one with the largest id is the
    response. Only payloads that repeat meet the rows again, and a payload of any share of the rows is split.
    """
    rows = rows.withColumn("payload", F.coalesce(payload, F.lit(""))).withColumn("bytes", F.octet_length("payload").cast("long"))
    rows = rows.withColumn("same", F.unhex(F.sha2("payload", 256)))
    groups = rows.where(F.col("bytes") >= least_bytes).groupBy("same").agg(F.count("*").alias("n_rows"), F.max(own).alias("largest"))
    repeated = stage(groups.where("n_rows > 1"), "warc-repeated")
    joined = attach(rows, repeated, ["same"], broadcast_rows=BROADCAST_ROWS)
    return joined.withColumn("refers", F.when(~F.col(own).eqNullSafe(F.col("largest")), F.col("largest")))


def write_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", compression: str = "none", **options) -> None:
    """Write one response or revisit record per row to archives in the folder ``path``, one per task, by Spark's text writer.

    Payloads are the column's UTF-8 bytes; null is empty. A null id gives an empty id, a null url no target. Rows that
    share the largest id and the payload are all responses; other columns don't matter. Archives are plain, so that they can be
    read in ranges; ``compression`` may be any that Spark's text writer has. ``options`` go to the writer (e.g. maxRecordsPerFile).
    """
    masked_pages, names = masked(pages)
    rows = record_roles(masked_pages, own=names[id_col], payload=F.col(names[payload_col]), least_bytes=least_bytes)
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))
    revisit = F.col("refers").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    url = F.regexp_replace(F.col(names[url_col]), r"[\r\n]+", " ")
    header = F.concat(
        F.lit(MAGIC + "1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name(F.col(names[id_col]))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.sha1("payload")))),
        F.when(revisit, F.concat(line("WARC-Refers-To", name(F.col("refers"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    record = F.concat(header, block, F.lit("\r\n\r"))  # the writer ends each with a newline
    rows.select(record.alias("value")).write.options(compression=compression, lineSep="\n", **options).text(path)


_FIELD = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)\r?$", re.M)


def parse_record(chunk: bytes) -> tuple[dict[bytes, bytes], int, int] | None:
    """Fields of what follows the magic, where its block begins and the block's length; None if it is no record's head."""
    if not chunk.startswith(VERSIONS):
        return None
    end = chunk.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {k.lower(): v for k, v in _FIELD.findall(chunk[:end])}
    length = fields.get(b"content-length", b"")
    return (fields, end + 4, int(length)) if length.isdigit() and b"warc-type" in fields else None


def read_payload(block: bytes) -> tuple[bytes, int]:
    """The payload of an HTTP response block and the length its header states."""
    end = block.find(b"\r\n\r\n")
    head = block[:end] if end >= 0 else b""
    stated = next((int(v) for k, v in _FIELD.findall(head) if k.lower() == b"content-length" and v.isdigit()), -1)
    return (block[end + 4 :] if end >= 0 else block), stated


def _record(fields: dict[bytes, bytes], block: bytes | None) -> dict:
    """The row of a record; payload facts only where its block is at hand."""
    kind = fields[b"warc-type"].decode()
    named = lambda k: fields.get(k, b"").decode().removeprefix("<urn:page:").removesuffix(">") or None
    row = {"type": kind, "id": named(b"warc-record-id"), "refers": named(b"warc-refers-to"), "url": fields[b"warc-target-uri"].decode() if b"warc-target-uri" in fields else None, "digest": None, "bytes": None, "intact": None}
    if block is not None:
        stated_digest = fields.get(b"warc-payload-digest", b"").decode().removeprefix("sha1:")
        payload, stated = read_payload(block)
        if kind == "revisit":
            row |= {"digest": stated_digest, "bytes": stated, "intact": True}
        else:
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            row |= {"digest": digest, "bytes": len(payload), "intact": digest == stated_digest}
    return row


RECORD = "type string, id string, refers string, url string, digest string, bytes long, intact boolean"
_TYPES = {"type": pa.string(), "id": pa.string(), "refers": pa.string(), "url": pa.string(), "digest": pa.string(), "bytes": pa.int64(), "intact": pa.bool_()}


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """(file, split, bytes before it in its split, chunk) in reading order."""
    last, at = None, 0
    for b in batches:
        for value, file, split in zip(b.column(0), b.column(1), b.column(2), strict=True):
            where = (file.as_py(), split.as_py())
            if where != last:
                last, at = where, 0
            chunk = value.as_py()
            yield *where, at, chunk
            at += len(chunk) + len(MAGIC)


def chain_intervals(offsets: list[int], after: list[int | None]) -> tuple[list[int], list[int], list[int | None]]:
    """For candidates by rising offset and the offsets of their successors: (in, out, exit) of each.

    Chains merge into trees towards their ends. Candidate c lies on the chain from e exactly if
    ``in[c] <= in[e] < out[c]``. exit is where the chain leaves the range of offsets, None if it breaks before.
    """
    where = {o: i for i, o in enumerate(offsets)}
    top = offsets[-1] if offsets else 0
    parent = [where.get(a) if a is not None else None for a in after]
    size, exits = [1] * len(offsets), [None] * len(offsets)
    for i, p in enumerate(parent):
        if p is not None:
            size[p] += size[i]
    enter, free, cursor = [0] * len(offsets), [0] * len(offsets), 0
    for i in range(len(offsets) - 1, -1, -1):
        p = parent[i]
        if p is None:
            enter[i], cursor = cursor, cursor + size[i]
            exits[i] = after[i] if after[i] is not None and after[i] > top else None
        else:
            enter[i], free[p], exits[i] = free[p], free[p] + size[i], exits[p]
        free[i] = enter[i] + 1
    return enter, [e + s for e, s in zip(enter, size, strict=True)], exits


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split: one row with its bytes, and one per candidate record with its successor and place in its chain."""

    def told(where: tuple[str, int], rows: list[dict], total: int) -> Iterator[pa.RecordBatch]:
        enter, leave, exits = chain_intervals([r["at"] for r in rows], [r["after"] for r in rows])
        for r, i, o, x in zip(rows, enter, leave, exits, strict=True):
            r |= {"in": i, "out": o, "exit": x}
        rows = [*rows, {"total": total}]
        columns = {"file": pa.array([where[0]] * len(rows)), "split": pa.array([where[1]] * len(rows), pa.int64())}
        columns |= {k: pa.array([r.get(k) for r in rows], pa.int64()) for k in ("total", "at", "after", "in", "out", "exit")}
        columns |= {k: pa.array([r.get(k) for r in rows], t) for k, t in _TYPES.items()}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    last, rows, total = None, [], 0
    for file, split, at, chunk in _chunks(batches):
        if (file, split) != last:
            if last:
                yield from told(last, rows, total)
            last, rows = (file, split), []
        total = at + len(chunk) + len(MAGIC)
        found = parse_record(chunk)
        if found:
            fields, begin, length = found
            whole = len(chunk) == begin + length + 4
            rows.append({"at": at - len(MAGIC), "after": at + begin + length + 4} | _record(fields, chunk[begin : begin + length] if whole else None))
    if last:
        yield from told(last, rows, total)


class _Ranges:
    """Archives read in ranges of so many bytes, whatever the session's own split size is.

    A session of its own holds the split size. What it reads goes to the shared folder and comes back to the caller's session.
    """

    def __init__(self, spark: SparkSession, path: str, range_bytes: int | None) -> None:
        self.spark, self.path, self.own = spark, path, spark.newSession()
        for key, value in spark.conf.getAll.items():
            if self.own.conf.isModifiable(key):
                self.own.conf.set(key, value)
        size = range_bytes or min(max(self._longest() // RANGES, LEAST_RANGE), MOST_RANGE)
        for key, value in (("maxPartitionBytes", size), ("openCostInBytes", 1), ("minPartitionNum", 1)):
            self.own.conf.set(f"spark.sql.files.{key}", str(value))

    def _longest(self) -> int:
        """Bytes of the longest file, from the listing that Spark's reader makes."""
        listed = self.spark.read.format("binaryFile").load(self.path).agg(F.max("length")).first()
        return listed[0] or 0

    def archives(self) -> DataFrame:
        return self.own.read.option("lineSep", MAGIC).text(self.path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def here(self, df: DataFrame, name: str) -> DataFrame:
        """A written copy of a table of the caller's session, read in this one."""
        path = fresh_path(self.spark, name)
        df.write.parquet(path)
        return self.own.read.schema(df.schema).parquet(path)


def _reached(candidates: DataFrame, longest: int) -> DataFrame:
    """(file, offset) of the first record on the true chain in each split, by pointer jumping from the files' starts."""
    reached = candidates.where("offset = 0").select("file", "offset")
    jump = candidates.where("exit is not null").select("file", "offset", "exit")
    steps = 1
    while steps < longest:
        jump = stage(jump, "warc-jump")
        reached = stage(reached.union(reached.join(jump, ["file", "offset"]).select("file", F.col("exit").alias("offset"))).distinct(), "warc-reached")
        further = jump.select("file", F.col("offset").alias("exit"), F.col("exit").alias("next"))
        jump = jump.join(further, ["file", "exit"]).select("file", "offset", F.col("next").alias("exit"))
        steps *= 2
    return reached


def read_warc(spark: SparkSession, path: str, *, range_bytes: int | None = None) -> DataFrame:
    """The records of all archives below ``path``: file, offset, type, id, refers, url, digest, bytes, intact.

    Archives are read in ranges (``range_bytes``; by default RANGES of the longest file, LEAST_RANGE to MOST_RANGE bytes) and cut at the magic, wherever it
    stands; each range emits its candidate records with their successors' offsets (in the uncompressed stream) and follows
    chains inside itself. Prefix sums of the ranges' bytes give absolute offsets. Pointer jumping from offset 0 across ranges
    (logarithmic in a file's ranges) finds the one true entry into each range; only records on the chain from it stay, so magic
    inside a payload is never a record. A record in several pieces is put together from them in a second read. ``digest``
    and ``bytes`` of a response are those of the payload as read, ``intact`` whether the digest agrees with the header; of a
    revisit as stated. Versions 1.0 and 1.1 are read. A file that doesn't start with a record raises ValueError; a chain that
    breaks later (cut or damaged file) ends there. Plain and compressed archives are read; a gzip file is one range.
    """
    ranges = _Ranges(spark, path, range_bytes)
    found = ranges.staged(ranges.archives().mapInArrow(_candidates, f"file string, split long, total long, at long, after long, in long, out long, exit long, {RECORD}"), "warc-candidates")
    order = Window.partitionBy("file").orderBy("split")
    totals = found.where("total is not null").select("file", "split", "total")
    base = stage(totals.select("file", "split", F.coalesce(F.sum("total").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")), "warc-splits")
    longest = base.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    shifted = found.where("total is null").join(base, ["file", "split"])
    candidates = shifted.withColumns({"offset": F.col("at") + F.col("base"), "after": F.col("after") + F.col("base"), "exit": F.col("exit") + F.col("base")})
    candidates = stage(candidates.drop("total", "at", "base"), "warc-offsets")
    strange = base.select("file").distinct().join(candidates.where("offset = 0").select("file"), "file", "left_anti").first()
    if strange:
        raise ValueError(f"{strange['file']} doesn't start with a record of a known version")
    entries = candidates.join(_reached(candidates, longest), ["file", "offset"], "left_semi").select("file", "split", F.col("in").alias("entry"))
    true = stage(candidates.join(entries, ["file", "split"]).where("in <= entry and entry < out").drop("entry"), "warc-records")
    whole = true.where("digest is not null")
    fields = ["file", "offset", *_TYPES]
    parted = true.where("digest is null")
    if not parted.limit(1).count():
        return whole.select(*fields)
    return whole.select(*fields).unionByName(_put_together(ranges, base, parted).select(*fields))


def _put_together(ranges: _Ranges, base: DataFrame, parted: DataFrame) -> DataFrame:
    """Records that hold the magic: their chunks from a second read, joined by byte ranges in cells."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, split, at, chunk in _chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([split]), pa.array([at]), pa.array([chunk], pa.binary())], names=["file", "split", "at", "chunk"])

    chunks = ranges.archives().mapInArrow(placed, "file string, split long, at long, chunk binary").join(ranges.here(base, "warc-splits"), ["file", "split"])
    chunks = chunks.select("file", (F.col("at") + F.col("base") - len(MAGIC)).alias("begin"), "chunk").withColumn("cell", F.floor(F.col("begin") / CELL))
    spans = ranges.here(parted.select("file", "offset", "after"), "warc-parted").withColumn("cell", F.explode(F.sequence(F.floor(F.col("offset") / CELL), F.floor((F.col("after") - 1) / CELL))))
    inside = chunks.join(spans, ["file", "cell"]).where("begin >= offset and begin < after")
    rows = inside.groupBy("file", "offset").agg(F.array_sort(F.collect_list(F.struct("begin", "chunk"))).alias("parts"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for parts in b.column(2):
                whole = MAGIC.encode().join(p["chunk"] for p in parts.as_py())
                fields, begin, length = parse_record(whole)
                out.append(_record(fields, whole[begin : begin + length]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([r[k] for r in out], t) for k, t in _TYPES.items())], names=["file", "offset", *_TYPES])

    return ranges.staged(rows.select("file", "offset", "parts").mapInArrow(joined, f"file string, offset long, {RECORD}"), "warc-joined")
