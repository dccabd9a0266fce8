"""Secret scan with multipart credential linking, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.spans import pattern_spans
from palimpsest.storage import discard, stage

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kinds in the order in which spans of equal start are listed: pattern and least code points (of group 2 for assign).
BASE = {"assign": (ASSIGN, 6), "access": (r"AKIA[A-Z0-9]+", 20), "hex": (r"[0-9a-f]+", 24)}
#: The same matches with the least length in the pattern.
DIRECT = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
#: Weak candidates count only beside a complementary part: an identifier without known prefix, a mixed blob, a service address (scheme of at most 20 characters, so that a run of letters is scanned once).
WEAK = {
    "ident": (r"[A-Z0-9]{16,}", 16),
    "blob": (r"[A-Za-z0-9+/_-]{32,}", 32),
    "endpoint": (r"[a-z][a-z0-9+.-]{0,19}://[^\s\"'<>]+", 10),
}
KINDS = [*BASE, *WEAK]
#: Parts of one credential lie at most so many code points apart.
SCOPE = 200


def _mixed(found: Column) -> Column:
    return found.rlike("[A-Z]") & found.rlike("[a-z]") & found.rlike("[0-9]")


def find_spans(text: Column, kind: str) -> Column:
    """Leftmost non-overlapping matches of a kind as array<struct<s, e>>, code points, end exclusive.

    The least length of access and hex stands in the pattern: a maximal run either has it or holds no match. A failing
    assign match swallows its text, so it is dropped after matching. Texts without a match are scanned once.
    """
    pattern, least = (BASE | WEAK)[kind]
    pattern = DIRECT.get(kind, pattern)
    placed = pattern_spans(text, pattern)
    if kind == "assign":
        placed = F.filter(placed, lambda x: F.length(F.regexp_extract(x["raw"], pattern, 1)) >= least)
    elif kind == "ident":
        placed = F.filter(placed, lambda x: x["raw"].rlike("[A-Z]") & x["raw"].rlike("[0-9]") & ~x["raw"].startswith("AKIA"))
    elif kind == "blob":
        placed = F.filter(placed, lambda x: _mixed(x["raw"]))
    elif kind == "endpoint":
        placed = F.filter(placed, lambda x: x["e"] - x["s"] >= least)
    spans = F.transform(placed, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    some = text.contains("://") & text.rlike(pattern) if kind == "endpoint" else text.rlike(pattern)
    return F.when(some, spans).otherwise(F.array().cast("array<struct<s:int,e:int>>"))


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed in KINDS."""
    order = F.array_sort(spans)
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(order, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _of_kind(kind: str) -> Column:
    return F.transform(F.col(kind), lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e")))


def _parts(rows: DataFrame) -> DataFrame:
    """One row per part of a possible credential: rid, role (i identifier, s secret, e endpoint), k, s, e.

    Rows of documents without complementary roles are not exploded.
    """
    role = {"assign": "s", "hex": "s", "blob": "s", "access": "i", "ident": "i", "endpoint": "e"}
    roles = F.create_map(*[F.lit(x) for k in KINDS for x in (KINDS.index(k), role[k])])
    some = lambda r: sum((F.size(k) for k in KINDS if role[k] == r), F.lit(0)) > 0
    useful = rows.where(some("s") & (some("i") | some("e")))
    every = useful.select("rid", F.explode(F.concat(*[_of_kind(k) for k in KINDS])).alias("x"))
    return every.select("rid", roles[F.col("x.k")].alias("role"), "x.k", "x.s", "x.e")


def _in_cells(parts: DataFrame, scope: int) -> DataFrame:
    return parts.withColumn("cell", F.explode(F.sequence(F.floor(F.col("s") / scope), F.floor((F.col("e") - 1) / scope))))


def _uncovered(parts: DataFrame, scope: int) -> DataFrame:
    """Base parts, and weak ones that lie in no base part; they meet by cells, so a text with many of both has no pairs of all."""
    weak, base = parts.where(F.col("k") >= len(BASE)), parts.where(F.col("k") < len(BASE))
    w, b = _in_cells(weak, scope).alias("w"), _in_cells(base, scope).alias("b")
    meet = (F.col("w.rid") == F.col("b.rid")) & (F.col("w.cell") == F.col("b.cell")) & (F.col("b.s") < F.col("w.e")) & (F.col("w.s") < F.col("b.e"))
    covered = w.join(b, meet, "left_semi").select("rid", "k", "s", "e").distinct()
    return base.unionByName(weak.join(covered, ["rid", "k", "s", "e"], "left_anti").select(*base.columns))


def linked_spans(rows: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak candidates with a complementary part in scope: rid, k, s, e.

    Interval join by cells of ``scope`` code points: a candidate meets the parts that start in its own or a
    neighbouring cell of the same document. A secret goes with an identifier or an endpoint and these with a
    secret. Parts never overlap candidates of which they are the same text. A cell holds few parts, as parts of
    one kind do not overlap, so no list of all pairs arises, however many parts a document has.
    """
    every = stage(_parts(rows), "secret-found")
    parts = stage(_uncovered(every, scope), "secret-parts")
    discard(every)
    weak = parts.where(F.col("k") >= len(BASE))
    cells = F.sequence(F.floor((F.col("s") - scope - 1) / scope), F.floor((F.col("e") + scope) / scope))
    a = weak.withColumn("cell", F.explode(cells)).alias("a")
    first, last = F.floor(F.col("s") / scope), F.floor((F.col("e") - 1) / scope)
    b = parts.withColumn("cell", F.explode(F.array_distinct(F.array(first, last)))).alias("b")
    apart = F.greatest(F.col("b.s") - F.col("a.e"), F.col("a.s") - F.col("b.e"))
    fits = ((F.col("a.role") == "s") != (F.col("b.role") == "s")) & apart.between(0, scope)
    return a.join(b, (F.col("a.rid") == F.col("b.rid")) & (F.col("a.cell") == F.col("b.cell")) & fits, "left_semi").select("rid", "k", "s", "e").distinct()


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Find secrets in whole texts: doc_id, one array of spans per base kind, and spans with the linked weak parts.

    Base kinds (assign, access, hex) are reported wherever they match. Weak candidates (ident, blob, endpoint) are
    reported only when complementary parts co-occur within ``scope`` code points; one that lies in a base span is not.
    Null text counts as empty; each input row gives one output row, repeated rows and null ids too; other columns don't
    matter. Positions are code points, ends exclusive. ``spans`` is an array of (s, k, e), k an index into KINDS. Work and
    memory grow with a text's length, also where a text of megabytes is nothing but matches.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    read = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("t"))
    rows = stage(read.select("doc_id", F.monotonically_increasing_id().alias("rid"), *[find_spans(F.col("t"), k).alias(k) for k in KINDS]), "secret-rows")
    links = linked_spans(rows, scope).groupBy("rid").agg(F.collect_list(F.struct("s", "k", "e")).alias("linked"))
    base = F.concat(*[_of_kind(k) for k in BASE])
    return rows.join(links, "rid", "left").select("doc_id", *BASE, F.array_sort(F.when(F.col("linked").isNotNull(), F.concat(base, "linked")).otherwise(base)).alias("spans"), F.array_sort(base).alias("base"))


def secret_digests(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


_POSITIONS = """
list_transform(range(1, len({m}) + 1), lambda i: {{'s': list_sum(list_transform({g}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform({m}[1:i-1], lambda x: length(x))), 0), 'm': {m}[i]}})
"""


def _sql() -> str:
    """DuckDB: the same spans by other means, in the same stages."""
    quoted = {k: p.replace("'", "''") for k, (p, _) in (BASE | WEAK).items()}
    keep = {
        "assign": f"length(regexp_extract(x.m, '{quoted['assign']}', 1)) >= 6",
        "access": "length(x.m) >= 20", "hex": "length(x.m) >= 24", "endpoint": "length(x.m) >= 10",
        "ident": "regexp_matches(x.m, '[A-Z]') and regexp_matches(x.m, '[0-9]') and not starts_with(x.m, 'AKIA')",
        "blob": "regexp_matches(x.m, '[A-Z]') and regexp_matches(x.m, '[a-z]') and regexp_matches(x.m, '[0-9]')",
    }
    found = ", ".join(f"regexp_extract_all(t, '{quoted[k]}') as m_{k}, string_split_regex(t, '{quoted[k]}') as g_{k}" for k in KINDS)
    each = " union all ".join(
        f"select rid, {i} as k, x.s as s, x.s + length(x.m) as e from (select rid, unnest({_POSITIONS.format(m=f'm_{k}', g=f'g_{k}')}) as x from found where len(m_{k}) > 0) where {keep[k]}" for i, k in enumerate(KINDS)
    )
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    role = "case when k in (0, 2, 4) then 's' when k in (1, 3) then 'i' else 'e' end"
    text = f"string_agg({names}[k + 1] || ':' || s || ':' || e, ',' order by s, k)"
    return f"""
with docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
found as (select rid, {found} from docs),
every as (select rid, k, s::bigint as s, e::bigint as e, {role} as role from ({each})),
base as (select * from every where k < {len(BASE)}),
weak as (select * from every w where k >= {len(BASE)} and not exists (select 1 from base b where b.rid = w.rid and b.s < w.e and w.s < b.e)),
parts as (select * from base union all select * from weak),
kept as (select * from base union all select * from weak w where exists (select 1 from parts p where p.rid = w.rid
  and ((w.role = 's') <> (p.role = 's')) and greatest(p.s - w.e, w.s - p.e) between 0 and {SCOPE})),
listed as (select rid, {text} as spans, {text} filter (where k < {len(BASE)}) as base,
  count(*) filter (where k = 0) as n_assign, count(*) filter (where k = 1) as n_access, count(*) filter (where k = 2) as n_hex from kept group by rid)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from docs left join listed using (rid)
"""


SQL = _sql()
