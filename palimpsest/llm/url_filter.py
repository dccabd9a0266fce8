"""URL filter: a broadcast trie over reversed host labels and path segments with longest-match precedence."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.joins import masked

#: The rule set is read on the driver and broadcast; more rules than this need another way and are refused.
MAX_RULES = 1_000_000


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str  # this host and its subdomains; empty: every host
    path: str = ""  # the url's path starts with it


class Trie:
    """Nodes are dicts: host labels from the right, then under the key ``/`` whole path segments.

    A rule ends at its last whole segment and keeps the rest of its path as a prefix for the next one. Of the rules that fit
    the longest wins, host and path counted together; of rules of equal length the one with the longer host, and of equal
    rules the later entry.
    """

    def __init__(self, rules: Iterable[Rule]) -> None:
        self.root: dict = {}
        for n, rule in enumerate(rules):
            if n >= MAX_RULES:
                raise ValueError(f"more than {MAX_RULES} rules")
            if rule.verdict not in ("allow", "block"):
                raise ValueError(f"unknown verdict {rule.verdict!r}")
            node = self.root
            for label in reversed(rule.host.lower().split(".")) if rule.host else ():
                node = node.setdefault(("h", label), {})
            *whole, rest = rule.path.split("/")
            for segment in whole:
                node = node.setdefault(("p", segment), {})
            node.setdefault("rules", {})[rest] = (rule.host.lower() + rule.path, rule.verdict)

    @staticmethod
    def _in_path(node: dict, segments: list[str]) -> tuple[str, str] | None:
        """The longest rule below a host's node that the path starts with."""
        best = None  # rules further down are longer, as they share host and segments
        for segment in segments[:-1]:
            best = Trie._longest(node, segment) or best
            node = node.get(("p", segment))
            if node is None:
                return best
        return Trie._longest(node, segments[-1]) or best

    @staticmethod
    def _longest(node: dict, segment: str) -> tuple[str, str] | None:
        fits = [(len(rest), found) for rest, found in node.get("rules", {}).items() if segment.startswith(rest)]
        return max(fits)[1] if fits else None

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        segments = path.split("/")
        node, best = self.root, self._in_path(self.root, segments)
        for label in reversed(host.split(".")) if host else ():
            node = node.get(("h", label))
            if node is None:
                break
            found = self._in_path(node, segments)
            if found and (best is None or len(found[0]) >= len(best[0])):
                best = found
        return best or (None, None)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def filter_urls(rows: DataFrame, rules: Iterable[Rule], *, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``rows`` with host, path, rule (host and path of the deciding rule, else null) and verdict.

    Columns of these names are replaced. A null url and one without ``://`` have host and path empty and are judged
    by rules for every host only, else by ``default``. Hosts are compared by whole labels; ports and user parts are
    taken as they stand. The trie is broadcast; MAX_RULES bounds it. No shuffle takes place.
    """
    held = rows.sparkSession.sparkContext.broadcast(Trie(rules))
    added = ["host", "path", "rule", "verdict"]
    kept = [c for c in rows.columns if c not in added]
    inner, names = masked(rows)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = held.value
        for b in batches:
            hosts, paths = b.column(b.num_columns - 2), b.column(b.num_columns - 1)
            found = [trie.match(h, p) for h, p in zip(hosts.to_pylist(), paths.to_pylist(), strict=True)]
            made = [hosts, paths, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] or default for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 2)), *made], names=[*b.schema.names[:-2], *added])

    read = inner.select(*[names[c] for c in kept], host_of(F.col(names[url_col])).alias("h"), path_of(F.col(names[url_col])).alias("p"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields[:-2]), "host string, path string, rule string, verdict string"])
    return read.mapInArrow(judged, schema).toDF(*kept, *added)
