"""Scans and sinks over text, JSON, CSV, TSV and binary files through Spark's readers and writers."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import split_sentences
from palimpsest.operators.relational import forward_fill_sections, latest, per_group_limit, seeded_sample


def _stem(path: Column) -> Column:
    return F.url_decode(F.regexp_extract(F.regexp_replace(path, r"\+", "%2B"), r"([^/]+?)(?:\.[^./]*)?$", 1))


def scan_texts(spark: SparkSession, path: str, *, exclude_prefix: str = "syn") -> DataFrame:
    """(doc, text), a row per file, the file's stem as its key; bytes that are no UTF-8 become U+FFFD."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    rows = files.select(_stem(F.col("path")).alias("doc"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return rows.where(~F.col("doc").startswith(exclude_prefix)) if exclude_prefix else rows


def sectioned(docs: DataFrame, heading: str, drop: str | None = None, min_letters: int = 5, letter: str = "[가-힣]", separator: str = " ") -> DataFrame:
    """(doc, sections, text): a document's sections, and their bodies joined; documents without sections are left out."""
    sections = F.filter(forward_fill_sections(F.split("text", r"\r?\n"), heading, drop), lambda s: F.regexp_count(s["body"], F.lit(letter)) >= min_letters)
    rows = docs.select("doc", sections.alias("sections")).where(F.size("sections") > 0)
    return rows.withColumn("text", F.array_join(F.transform("sections", lambda s: s["body"]), separator))


def scan_outputs(spark: SparkSession, path: str, schema: str, pattern: str = r"^(.+?)__(.+)$") -> DataFrame:
    """JSON outputs named ``{doc}__{route}.json``: schema columns with doc and route from the name; no file, no row."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("__name", _stem(F.col("_metadata.file_path")))
    return rows.select(F.regexp_extract("__name", pattern, 1).alias("doc"), F.regexp_extract("__name", pattern, 2).alias("route"), *[c for c in rows.columns if c not in ("doc", "route", "__name")])


def routes(outputs: DataFrame) -> DataFrame:
    return outputs.select("route").distinct()


def union_latest(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows of all tables by key; a later table overwrites an earlier one. Missing columns are null."""
    every = None
    for n, df in enumerate(frames):
        one = df.withColumn("__file", F.lit(n))
        every = one if every is None else every.unionByName(one, allowMissingColumns=True)
    return latest(every, [key], "__file").drop("__file")


def scan_corpus(spark: SparkSession, path: str, *, limit_per_file: int | None = None, first: str = "med") -> DataFrame:
    """Records of the json, jsonl, csv and tsv files of a folder as (file, priority, row, record map<string,string>).

    Files whose name holds ``first`` have priority 0. A JSON file is an array of records or an object holding one; one that
    cannot be read raises ValueError, a broken line of a jsonl file is left out. ``row`` rises in file order, and
    ``limit_per_file`` keeps the first so many records of each file.
    """
    ordered = "file string, row long, record map<string,string>"

    def read(kind: str) -> DataFrame | None:
        src = spark.read.option("pathGlobFilter", f"*.{kind}").option("recursiveFileLookup", True)
        if kind == "jsonl":
            # ranges of a file by where they begin, lines within a range as they are read
            at = F.struct(F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("line"))
            lines = src.text(path).select(F.col("_metadata.file_path").alias("file"), at.alias("at"), F.from_json("value", "map<string,string>").alias("record"))
            return lines.where("record is not null")
        if kind == "json":
            whole = src.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
            return whole.mapInPandas(_json_records, ordered)
        table = src.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
        sep = "," if kind == "csv" else "\t"
        return table.mapInPandas(lambda it: _csv_records(it, sep), ordered)

    every = None
    for kind in ("json", "jsonl", "csv", "tsv"):
        one = read(kind)
        if kind != "jsonl":
            one = one.select("file", F.struct(F.lit(0).cast("long").alias("range"), F.col("row").alias("line")).alias("at"), "record")
        every = one if every is None else every.unionByName(one)
    rows = every.select("file", F.when(F.contains(F.lower("file"), F.lit(first)), 0).otherwise(1).alias("priority"), F.col("at").alias("row"), "record")
    return rows if limit_per_file is None else per_group_limit(rows, ["file"], [F.col("row")], limit_per_file)


def _json_records(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first list of objects in a JSON file, wherever it is nested."""

    def found(node):
        if isinstance(node, list) and node and isinstance(node[0], dict):
            return node
        for child in node.values() if isinstance(node, dict) else ():
            if got := found(child):
                return got
        return None

    for pdf in parts:
        rows = []
        for file, value in zip(pdf["file"], pdf["value"], strict=True):
            try:
                records = found(json.loads(value.lstrip("﻿"))) or []
            except ValueError as broken:
                raise ValueError(f"{file} is no JSON: {broken}") from broken
            rows += [(file, n, {k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in r.items()}) for n, r in enumerate(records)]
        yield pd.DataFrame(rows, columns=["file", "row", "record"])


def _csv_records(parts: Iterator[pd.DataFrame], sep: str) -> Iterator[pd.DataFrame]:
    import csv
    import io

    for pdf in parts:
        rows = []
        for file, value in zip(pdf["file"], pdf["value"], strict=True):
            rows += [(file, n, {k: v or "" for k, v in r.items() if k}) for n, r in enumerate(csv.DictReader(io.StringIO(value.lstrip("﻿")), delimiter=sep))]
        yield pd.DataFrame(rows, columns=["file", "row", "record"])


def scan_table(spark: SparkSession, path: str, *, sep: str = ",", schema: str | None = None) -> DataFrame:
    """CSV or TSV with a header; a byte order mark at the first name is dropped."""
    reader = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"')
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def scan_vocabulary(spark: SparkSession, path: str, *, word: int = 1, grade: int = 2, sep: str = ",") -> DataFrame:
    """(headword, grade) from the second and third column of a sheet saved as CSV."""
    df = scan_table(spark, path, sep=sep)
    return df.select(F.col(f"`{df.columns[word]}`").alias("headword"), F.regexp_extract(F.col(f"`{df.columns[grade]}`").cast("string"), r"(\d)", 1).cast("int").alias("grade"))


#: bytes of a file -> its pages' texts
PageExtractor = Callable[[bytes], list[str]]


def scan_pages(spark: SparkSession, path: str, extractor: PageExtractor, glob: str = "*.pdf") -> DataFrame:
    """(doc, page, text) of binary documents by a pluggable extractor; files are spread over tasks."""

    def pages(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(d, n, t) for d, c in zip(pdf["doc"], pdf["content"], strict=True) for n, t in enumerate(extractor(c))]
            yield pd.DataFrame(rows, columns=["doc", "page", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(_stem(F.col("path")).alias("doc"), "content").mapInPandas(pages, "doc string, page int, text string")


def html_text(html: Column | str) -> Column:
    """Visible text of HTML: scripts, styles, comments and tags off, block ends to line breaks, common entities decoded."""
    t = F.col(html) if isinstance(html, str) else html
    t = F.regexp_replace(t, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|title|section|article|nav|footer|header)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t\r\f]+", " "), r"[ ]*\n[\n ]*", "\n"))


def page_profile(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc").agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars"), F.avg(F.length("text")).alias("chars_per_page"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes by extension."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.groupBy(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, *, order: Sequence[str] = (), sep: str = ",", text_limit: int = 300) -> None:
    """Sorted rows with strings cut to ``text_limit`` characters, for reading by people."""
    cut = {c: F.substring(c, 1, text_limit) for c, k in df.dtypes if k == "string"}
    out = df.withColumns(cut) if cut else df
    (out.orderBy(*order) if order else out).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def review_sheet(df: DataFrame, flagged: Column, n: int, seed: int, shown: Sequence[str], key: Sequence[str], share: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """A blind sheet and its answer key, both by row number: ``share`` flagged rows and controls, shuffled by hash.

    ``n`` rows at most, so numbering them is no distributed work.
    """
    want = round(n * share)
    picked = seeded_sample(df.where(flagged), want, seed, key).withColumn("group", F.lit("flagged")).unionByName(seeded_sample(df.where(~F.coalesce(flagged, F.lit(False))), n - want, seed, key).withColumn("group", F.lit("control")))
    from pyspark.sql import Window

    numbered = picked.withColumn("no", F.row_number().over(Window.orderBy(F.xxhash64(*key, F.lit(seed + 1)), *key)))
    return numbered.select("no", *shown, F.lit("").alias("judge"), F.lit("").alias("note")), numbered.select("no", *key, "group")


def markdown_table(df: DataFrame, limit: int = 1000) -> str:
    """A small result as a Markdown table."""
    rows = df.limit(limit).collect()
    cell = lambda v: "" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v).replace("|", r"\|")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])


def result_path(out_dir: str, doc_id: str) -> str:
    return f"{out_dir}/{doc_id}.json"


def cache_path(out_dir: str, doc_id: str, stage: str) -> str:
    return f"{out_dir}/.cache/{doc_id}/{stage}.json"


def sentence_table(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select("doc", F.posexplode(split_sentences(text)).alias("sent_id", "text"))
