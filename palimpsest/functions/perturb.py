"""Corruptions of known-good sentences, to test whether a metric notices them. Choices follow a hash, not a random stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.profiles import LATIN, LangProfile
from palimpsest.functions.text import repair_particle, split_sentences


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _first_number(t: Column, p: LangProfile, change) -> Column:
    """The text with its first number unit (number, unit) rewritten; null where it has none."""
    t = _c(t)
    whole = F.regexp_extract(t, p.number_unit, 0)
    at = F.position(whole, t)
    number, unit = F.regexp_extract(t, p.number_unit, 1), F.regexp_extract(t, p.number_unit, 2)
    gap = F.substring(whole, F.length(number) + 1, F.length(whole) - F.length(number) - F.length(unit))
    return F.when(t.rlike(p.number_unit), F.concat(F.left(t, at - 1), change(number, gap, unit), F.substr(t, at + F.length(whole))))


def change_number(t: Column, p: LangProfile = LATIN) -> Column:
    """The first number becomes three times itself and one."""
    return _first_number(t, p, lambda n, gap, u: F.concat((n.cast("long") * 3 + 1).cast("string"), gap, u))


def change_unit(t: Column, p: LangProfile = LATIN) -> Column:
    units = F.create_map(*[F.lit(x) for kv in p.unit_map.items() for x in kv])
    return _first_number(t, p, lambda n, gap, u: F.concat(n, gap, units[u]))


def apply_rule(t: Column, kind: str, p: LangProfile = LATIN) -> Column:
    """The first rule of a kind (NEGATE, SIDE, SEVERITY) whose left side occurs, applied once; null where none does."""
    t = _c(t)
    out = None
    for _, a, b in (r for r in p.swaps if r[0] == kind):
        at = F.position(F.lit(a), t)
        changed = F.concat(F.left(t, at - 1), F.lit(b), F.substr(t, at + len(a)))
        out = F.when(at > 0, changed) if out is None else out.when(at > 0, changed)
    return out if out is not None else F.lit(None).cast("string")


def swap_term(t: Column, groups: Sequence[Sequence[str]], seed: int = 0, p: LangProfile = LATIN) -> Column:
    """The first listed term found becomes another of its group; in Korean the particle behind it is repaired."""
    t = _c(t)
    out = None
    for group in groups:
        for a in sorted(group, key=len, reverse=True):
            others = [x for x in group if x != a and a not in x]
            if others:
                at = F.position(F.lit(a), t)
                pick = F.element_at(F.array(*map(F.lit, others)), F.pmod(F.xxhash64(t, F.lit(seed)), F.lit(len(others))).cast("int") + 1)
                head, tail = F.concat(F.left(t, at - 1), pick), F.substr(t, at + len(a))
                changed = repair_particle(head, tail) if p.name == "ko" else F.concat(head, tail)
                out = F.when(at > 0, changed) if out is None else out.when(at > 0, changed)
    return out if out is not None else F.lit(None).cast("string")


def _choice(t: Column, options: Sequence[str], seed: int) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), F.pmod(F.xxhash64(_c(t), F.lit(seed)), F.lit(len(options))).cast("int") + 1)


def perturbations(t: Column, p: LangProfile = LATIN, groups: Sequence[Sequence[str]] = (), seed: int = 0) -> dict[str, Column]:
    """kind -> corrupted text, null where a sentence is not eligible for the kind; drop those equal to ``t``."""
    t = _c(t)
    return {
        "TERM_SWAP": swap_term(t, groups, seed, p),
        "NUM_CHANGE": change_number(t, p),
        "UNIT_CHANGE": change_unit(t, p),
        "NEGATE": apply_rule(t, "NEGATE", p),
        "SIDE": apply_rule(t, "SIDE", p),
        "SEVERITY": apply_rule(t, "SEVERITY", p),
        "FABRICATE": F.concat(t, F.lit(" "), _choice(t, p.fabrications, seed)),
        "OFF_TOPIC": _choice(t, p.off_topic, seed),
    }


def omit_sentence(sents: Column, index: Column, least: int = 4) -> Column:
    return F.when(F.size(sents) >= least, F.filter(sents, lambda _, i: i != index))


def omit_clause(s: Column, p: LangProfile = LATIN, least: int = 10) -> Column:
    """A sentence without one clause: the first that holds a number, else one chosen by hash; null if too little is left."""
    parts = F.filter(F.split(_c(s), p.clause), lambda x: F.trim(x) != "")
    numbered = F.array_position(F.transform(parts, lambda x: x.rlike(r"\d")), F.lit(True)).cast("int")
    drop = F.when(numbered > 0, numbered - 1).otherwise(F.pmod(F.xxhash64(_c(s)), F.greatest(F.size(parts), F.lit(1))).cast("int"))
    kept = F.trim(F.array_join(F.filter(parts, lambda _, i: i != drop), " "))
    return F.when((F.size(parts) >= 2) & (F.length(kept) >= least), kept)


def omit_term(s: Column, terms: Sequence[str], least: int = 10) -> Column:
    """A sentence without its longest listed term; null if it has none or too little is left."""
    s = _c(s)
    out = None
    for x in sorted(terms, key=len, reverse=True):
        kept = F.trim(F.replace(F.replace(s, F.lit(x), F.lit("")), F.lit("  "), F.lit(" ")))
        hit = F.contains(s, F.lit(x))
        out = F.when(hit, kept) if out is None else out.when(hit, kept)
    return F.when(F.length(out) >= least, out)


def truncate(t: Column, share: float = 0.55, from_length: int = 40, least: int = 15) -> Column:
    t = _c(t)
    cut = F.regexp_replace(F.left(t, F.floor(F.length(t) * share).cast("int")), r"\s+\z", "")
    return F.when((F.length(t) >= from_length) & (F.length(cut) >= least), cut)


def eligible(t: Column, p: LangProfile = LATIN, groups: Sequence[Sequence[str]] = ()) -> Column:
    made = perturbations(t, p, groups)
    return F.array_compact(F.array(*[F.when(v.isNotNull(), k) for k, v in made.items()]))


def sentences_without(t: Column, index: Column, p: LangProfile = LATIN) -> Column:
    return omit_sentence(split_sentences(t, p), index)
