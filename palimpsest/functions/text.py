"""String, set and number expressions over columns; nothing here shuffles or leaves the JVM but ``normalise``."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from palimpsest.functions.profiles import LATIN, LangProfile


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` evaluated once: what a lambda refers to outside itself is otherwise computed per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(t: Column) -> Column:
    """Without white space (Unicode) at both ends."""
    return F.regexp_replace(_c(t), r"(?U)^\s+|\s+\z", "")


def squeeze(t: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(_c(t), r"\s+", " "))


@F.pandas_udf(StringType())
def _nfkc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(StringType())
def _nfc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def normalise(t: Column, form: str = "NFKC") -> Column:
    """NFKC (or NFC, which keeps tone marks apart), control characters and line ends cleaned, blanks squeezed, stripped.

    Unicode forms have no built-in; texts that are plain ASCII, where both forms change nothing, stay in the JVM.
    """
    t = _c(t)
    formed = F.when(t.rlike(r"\A\p{ASCII}*\z"), t).otherwise({"NFKC": _nfkc, "NFC": _nfc}[form](F.when(~t.rlike(r"\A\p{ASCII}*\z"), t)))
    t = F.regexp_replace(F.regexp_replace(formed, r"\r\n?", "\n"), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t\x{a0}\x{3000}]+", " "), r"\n{3,}", "\n\n")
    return strip(t)


def split_sentences(t: Column, p: LangProfile = LATIN, min_length: int | None = None) -> Column:
    """Array of sentences: boundaries of the profile or line breaks; bare enumerators and short pieces are dropped."""
    t = _c(t)
    for pattern, put in p.boundaries:
        t = F.regexp_replace(t, pattern, put)
    least = p.min_sentence if min_length is None else min_length
    parts = F.transform(F.split(t, r"\n+"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\f]+", " ")))
    return F.filter(parts, lambda x: (F.length(x) >= max(least, 1)) & ~x.rlike(p.enumerator))


def words(t: Column) -> Column:
    return F.filter(F.split(_c(t), r"\s+"), lambda w: w != "")


def char_ngrams(t: Column, n: int) -> Column:
    """Set of character n-grams without white space; a shorter text is its own gram, an empty one has none."""
    def grams(bare: Column) -> Column:
        every = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(bare) - n + 1, F.lit(1))), lambda i: F.substring(bare, i, F.lit(n))))
        return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(every)

    return let(F.regexp_replace(_c(t), r"\s+", ""), grams)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(_c(a), _c(b)))
    return both / F.greatest(F.size(_c(a)) + F.size(_c(b)) - both, F.lit(1))


def number_units(t: Column, p: LangProfile = LATIN) -> Column:
    """Numbers with their unit, spaces between removed, in order, repeats kept."""
    t, pattern = _c(t), F.lit(p.number_unit)
    return F.zip_with(F.regexp_extract_all(t, pattern, F.lit(1)), F.regexp_extract_all(t, pattern, F.lit(2)), lambda a, b: F.concat(a, b))


def without_spaces(t: Column) -> Column:
    return F.regexp_replace(_c(t), r"\s+", "")


def numeric_keep(src: Column, out: Column, p: LangProfile = LATIN) -> Column:
    """Per cent of the source's distinct number units found in the output as substrings, spaces apart; null if none."""
    nums = F.array_distinct(number_units(src, p))
    kept = let(without_spaces(out), lambda flat: F.size(F.filter(nums, lambda x: F.contains(flat, x))))
    return F.when(F.size(nums) > 0, 100.0 * kept / F.size(nums))


def numeric_hallucination(src: Column, out: Column, p: LangProfile = LATIN) -> Column:
    """Sorted distinct number units of the output that the source lacks."""
    return F.array_sort(F.array_except(number_units(out, p), number_units(src, p)))


def find_blanks(t: Column, p: LangProfile = LATIN) -> Column:
    """Map kind -> matches, kinds without matches left out."""
    every = F.map_from_arrays(F.array(*map(F.lit, p.blanks)), F.array(*[F.regexp_extract_all(_c(t), F.lit(x), F.lit(0)) for x in p.blanks.values()]))
    return F.map_filter(every, lambda _, v: F.size(v) > 0)


def mark_blanks(t: Column, p: LangProfile = LATIN, token: str = "[미기재]") -> Column:
    """Empty brackets and rules replaced by ``token``, and the token put where the profile misses a number; (text, n)."""
    t, n = _c(t), F.lit(0)
    for kind in ("empty_bracket", "rule"):
        n = n + F.regexp_count(t, F.lit(p.blanks[kind]))
        t = F.regexp_replace(t, p.blanks[kind], token.replace("[", r"\[").replace("]", r"\]"))
    if p.name == "ko":
        missing = r"약\s+(?=정도|가량|이내|이상|이하|동안|쯤)"
        n = n + F.regexp_count(t, F.lit(missing))
        t = F.regexp_replace(t, missing, f"약 {token} ")
    return F.struct(t.alias("text"), n.alias("n"))


def count_matches(t: Column, patterns: dict[str, str]) -> Column:
    """Struct of match counts by name (extraction loss, keyword profiles)."""
    return F.struct(*[F.regexp_count(_c(t), F.lit(x)).alias(k) for k, x in patterns.items()])


def letters(t: Column, p: LangProfile = LATIN) -> Column:
    return F.regexp_count(_c(t), F.lit(p.letter))


#: Characters of each script.
SCRIPTS = {"ko": "[가-힣]", "han": "[\\x{4e00}-\\x{9fff}]", "lat": "[A-Za-z\\x{aa}\\x{b5}\\x{ba}\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{24f}\\x{1ea0}-\\x{1ef9}]"}


def script_counts(t: Column) -> Column:
    return count_matches(t, SCRIPTS)


def detect_script(t: Column, target: str) -> Column:
    """'ko', ``target`` or 'other': at least 30 % Hangul, 30 % Han for zh, 50 % Latin for en and vi; under 3 letters other."""
    n = {k: F.regexp_count(_c(t), F.lit(x)) for k, x in SCRIPTS.items()}
    total = n["ko"] + n["han"] + n["lat"]
    hit = F.when(total < 3, "other").when(n["ko"] / total >= 0.30, "ko")
    if target == "zh":
        hit = hit.when(n["han"] / total >= 0.30, target)
    elif target in ("en", "vi"):
        hit = hit.when(n["lat"] / total >= 0.50, target)
    return hit.otherwise("other")


def letter_ratio(t: Column, p: LangProfile = LATIN) -> Column:
    return letters(t, p) / F.greatest(F.length(_c(t)), F.lit(1))


def strip_particle(w: Column, particles: Sequence[str]) -> Column:
    """Without the longest particle at the end, if more than one character is left."""
    longest = "|".join(sorted(particles, key=len, reverse=True))
    return F.regexp_replace(_c(w), f"(?<=..)(?:{longest})$", "")


def stem_tolerant_in(word: Column, text: Column, cut: int = 3, least: int = 3) -> Column:
    """Whether the word, or what is left after cutting up to ``cut`` characters (``least`` stay), is in the text."""
    w, flat = without_spaces(word), without_spaces(text)
    return F.exists(F.array(*[F.lit(i) for i in range(cut + 1)]), lambda i: ((i == 0) | (F.length(w) - i >= least)) & F.contains(flat, F.substring(w, F.lit(1), F.length(w) - i)))


def stem_english(w: Column) -> Column:
    """Lower case; -ectomy, -ology and -itis stay; -ies to -y, then -es and -s off (not -ss) from longer words."""
    w = F.lower(_c(w))
    return (
        F.when(w.rlike("(ectomy|ology|itis)$"), w)
        .when((F.length(w) > 5) & w.endswith("ies"), F.concat(F.substring(w, F.lit(1), F.length(w) - 3), F.lit("y")))
        .when((F.length(w) > 4) & w.endswith("es"), F.substring(w, F.lit(1), F.length(w) - 2))
        .when((F.length(w) > 4) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, F.lit(1), F.length(w) - 1))
        .otherwise(w)
    )


def candidate_tokens(t: Column, lang: str, stop: Sequence[str] = ()) -> Column:
    """Distinct translation candidates: stemmed words (en), Han 2- to 4-grams (zh), Han and Katakana runs (ja)."""
    t = _c(t)
    if lang == "en":
        stems = F.transform(F.regexp_extract_all(t, F.lit(r"([A-Za-z][A-Za-z\-]{3,})"), F.lit(1)), stem_english)
        return F.array_distinct(F.filter(stems, lambda w: (F.length(w) >= 4) & ~w.isin(*stop) if stop else F.length(w) >= 4))
    if lang == "zh":
        runs = F.regexp_extract_all(t, F.lit(r"[\x{4e00}-\x{9fff}]+"), F.lit(0))
        grams = [F.flatten(F.transform(runs, lambda r, n=n: F.when(F.length(r) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - n + 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(n)))).otherwise(F.array().cast("array<string>")))) for n in (2, 3, 4)]
        return F.array_distinct(F.concat(*grams))
    return F.array_distinct(F.concat(F.regexp_extract_all(t, F.lit(r"[\x{4e00}-\x{9fff}]{2,6}"), F.lit(0)), F.regexp_extract_all(t, F.lit(r"[\x{30a0}-\x{30ff}]{3,10}"), F.lit(0))))


def parenthetical_glosses(t: Column, word: str = "[가-힣]{2,12}") -> Column:
    """array<struct<term, gloss>> of ``term (gloss)``."""
    pattern = F.lit(rf"({word})\s*[（(]\s*([^)）]{{2,40}})\s*[)）]")
    return F.arrays_zip(F.regexp_extract_all(_c(t), pattern, F.lit(1)).alias("term"), F.transform(F.regexp_extract_all(_c(t), pattern, F.lit(2)), F.trim).alias("gloss"))


def explanation_of(t: Column, term: Column) -> Column:
    """What stands in brackets right behind a term, else null."""
    got = F.regexp_extract(_c(t), F.concat(F.lit(r"\Q"), _c(term), F.lit(r"\E\s*[（(]\s*([^)）]{1,80}?)\s*[)）]")), 1)
    return F.when(got != "", got)


def ungrounded_parentheses(out: Column, src: Column, least: float = 0.5) -> Column:
    """Bracketed texts of the output of whose words less than ``least`` occur in the source."""
    inside = F.regexp_extract_all(_c(out), F.lit(r"[（(]([^)）]{2,80})[)）]"), F.lit(1))
    share = lambda x: F.size(F.filter(words(x), lambda w: F.contains(_c(src), w))) / F.greatest(F.size(words(x)), F.lit(1))
    return F.filter(inside, lambda x: share(x) < least)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    a, b = squeeze(a), squeeze(b)
    return F.when((a == "") & (b == ""), 1.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def edit_metrics(src: Column, out: Column, p: LangProfile = LATIN) -> dict[str, Column]:
    """Compression, exact copies, split ratio, added and deleted words in per cent, trigram copy."""
    src, out = _c(src), _c(out)
    ks, oo = F.transform(split_sentences(src, p), squeeze), F.transform(split_sentences(out, p), squeeze)
    kw, ow = words(src), words(out)
    share = lambda xs, ys: let(ys, lambda y: 100.0 * F.size(F.filter(xs, lambda w: ~F.array_contains(y, w))) / F.greatest(F.size(xs), F.lit(1)))
    return {
        "compression": F.length(squeeze(out)) / F.greatest(F.length(squeeze(src)), F.lit(1)),
        "exact_copies": let(ks, lambda k: 100.0 * F.size(F.filter(oo, lambda s: F.array_contains(k, s))) / F.greatest(F.size(oo), F.lit(1))),
        "split_ratio": F.size(oo) / F.greatest(F.size(ks), F.lit(1)),
        "added_pct": share(ow, kw),
        "deleted_pct": share(kw, ow),
        "copy_jaccard3": jaccard(char_ngrams(src, 3), char_ngrams(out, 3)),
    }


def count_of(t: Column, term: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return F.regexp_count(_c(t), F.lit(rf"\Q{term}\E"))


def readability(t: Column, p: LangProfile = LATIN, long: int = 25) -> Column:
    """Struct of nine features over the sentences of a text; all 0 without sentences. Name it before taking fields, so that it is computed once."""
    def features(sents: Column, per: Column, joined: Column) -> Column:
        n, total = F.size(sents), F.greatest(F.aggregate(per, F.lit(0), lambda a, x: a + x), F.lit(1))
        per_word = lambda pattern: 100.0 * F.regexp_count(joined, F.lit(pattern)) / total
        made = {
            "sent_len": total / n,
            "long_ratio": F.size(F.filter(per, lambda x: x > long)) / n,
            "clause": F.regexp_count(joined, F.lit(p.connective)) / n,
            "nominal": per_word(p.nominal),
            "passive": per_word(p.passive),
            "term": 100.0 * sum((count_of(joined, x) for x in p.terms), F.lit(0)) / total,
            "hanja": per_word(p.suffix_word),
            "paren": 100.0 * F.regexp_count(joined, F.lit(r"[()\[\]{}（）〔〕:：·／/※▶►▲■□○●◦-]")) / F.greatest(F.length(joined), F.lit(1)),
            "formal": per_word(p.formal),
        }
        return F.struct(*[F.when(n > 0, v).otherwise(F.lit(0.0)).alias(k) for k, v in made.items()])

    return _over_sentences(t, p, features)


def _over_sentences(t: Column, p: LangProfile, body: Callable[[Column, Column, Column], Column]) -> Column:
    """``body`` over a text's sentences, their word counts and the sentences joined, each computed once."""
    return let(split_sentences(t, p), lambda s: let(F.transform(s, lambda x: F.size(words(x))), lambda per: let(F.array_join(s, " "), lambda joined: body(s, per, joined))))


#: metric -> the direction in which a text is simpler; info: no direction.
SIMPLICITY_DIRECTION = {
    "n_sentences": "info", "chars_per_sent": "lower", "words_per_sent": "lower", "long_sent_ratio": "lower", "hanja_ratio": "lower", "medterm_ratio": "lower",
    "term_explain": "higher", "term_explain_rate": "higher", "length_change": "info", "sent_split_ratio": "higher", "copy_similarity": "info",
}


def simplicity(t: Column, src: Column | None = None, p: LangProfile = LATIN) -> Column:
    """Struct of simplicity metrics of a text, with a source also those against it; null where there are no sentences."""
    t = _c(t)
    terms = F.array(*map(F.lit, p.terms))

    def metrics(sents: Column, per: Column, joined: Column) -> Column:
        n, total = F.size(sents), F.greatest(F.aggregate(per, F.lit(0), lambda a, x: a + x), F.lit(1))
        told = lambda g: F.exists(terms, lambda x: F.contains(g["term"], x)) & (F.regexp_count(g["gloss"], F.lit(p.letter)) >= 3) & (F.length(g["gloss"]) >= 4)
        explained = F.size(F.array_distinct(F.transform(F.filter(parenthetical_glosses(joined, p.letter + "{2,10}"), told), lambda g: g["term"])))
        present = F.size(F.filter(terms, lambda x: F.contains(joined, x)))
        out = {
            "n_sentences": n,
            "chars_per_sent": F.aggregate(F.transform(sents, F.length), F.lit(0), lambda a, x: a + x) / n,
            "words_per_sent": total / n,
            "long_sent_ratio": 100.0 * F.size(F.filter(per, lambda x: x > 25)) / n,
            "hanja_ratio": 100.0 * F.regexp_count(joined, F.lit(p.suffix_word)) / total,
            "medterm_ratio": 100.0 * sum((count_of(joined, x) for x in p.terms), F.lit(0)) / total,
            "term_explain": explained,
            "term_explain_rate": F.when(present > 0, 100.0 * explained / present),
        }
        if src is not None:
            before = F.size(split_sentences(src, p))
            out |= {
                "length_change": 100.0 * (F.length(t) - F.length(_c(src))) / F.greatest(F.length(_c(src)), F.lit(1)),
                "sent_split_ratio": F.when(before > 0, n / before),
                "copy_similarity": jaccard(char_ngrams(src, 3), char_ngrams(t, 3)),
            }
        return F.struct(*[F.when(n > 0, v).alias(k) for k, v in out.items()])

    return _over_sentences(t, p, metrics)


# The published readability formula and its levels.
INDEX_CONST, INDEX_VOCABULARY, INDEX_WORDS = 61.994, -0.261, -1.045
INDEX_LEVELS = ((45.0, "쉬움"), (35.0, "보통"))
INDEX_HARD = "어려움"


def index_value(mid_vocabulary: Column, words_per_sentence: Column) -> Column:
    return F.lit(INDEX_CONST) + INDEX_VOCABULARY * _c(mid_vocabulary) + INDEX_WORDS * _c(words_per_sentence)


def index_level(index: Column) -> Column:
    index = _c(index)
    level = F.when(index.isNull(), F.lit(None).cast("string"))
    for low, name in INDEX_LEVELS:
        level = level.when(index >= low, name)
    return level.otherwise(INDEX_HARD)


#: Marks at the start of lines, code ticks and emphasis.
MARKDOWN = ((r"^\s*#{1,6}\s*", ""), (r"^\s*[-*•▪◦]\s+", ""), (r"^\s*>\s?", ""), (r"`+", ""), (r"\*\*(.+?)\*\*", "$1"), (r"(?<!\*)\*(?!\*)(.+?)(?<!\*)\*(?!\*)", "$1"))


def _without_markdown(line: Column) -> Column:
    for pattern, put in MARKDOWN:
        line = F.regexp_replace(line, pattern, put)
    return line


def clean_output(raw: Column, opening: Sequence[str], closing: Sequence[str]) -> Column:
    """Model output without thinking, opening and closing chatter, rules and markdown; (text, removed).

    Reverts to the raw text where nothing, or less than 15 % of more than 100 characters, would be left.
    """
    rule = r"^\s*([-*=_]{3,}|─{3,})\s*$"
    hit = lambda x, pats: F.lit(False) if not pats else x.rlike("|".join(f"(?:{q})" for q in pats))
    t = F.regexp_replace(F.coalesce(_c(raw), F.lit("")), r"(?s)<think>.*?</think>", "")
    t = F.regexp_replace(t, r"(?s)^.*</think>", "")
    base = strip(t)
    lines = F.transform(F.split(t, "\n"), lambda x: F.regexp_replace(x, r"(?U)\s+\z", ""))
    first_rule = F.array_position(F.transform(F.slice(lines, 1, 6), lambda x: x.rlike(rule)), F.lit(True)).cast("int")
    head = F.array_join(F.slice(lines, F.lit(1), F.greatest(first_rule - 1, F.lit(0))), " ")
    lines = F.when((first_rule > 0) & hit(head, opening), F.slice(lines, first_rule + 1, F.greatest(F.size(lines) - first_rule, F.lit(0)))).otherwise(lines)

    def trimmed(lines: Column, pats: Sequence[str]) -> Column:
        return let(lines, lambda xs: rest(xs, pats))

    def rest(xs: Column, pats: Sequence[str]) -> Column:
        """Lines from the first that is neither blank, nor a rule, nor chatter with a line behind it."""
        goes = lambda x, i: (strip(x) == "") | x.rlike(rule) | (hit(strip(x), pats) & (i < F.size(xs) - 1))
        keep = F.array_position(F.transform(xs, lambda x, i: ~goes(x, i)), F.lit(True)).cast("int")
        return F.when(keep > 0, F.slice(xs, F.greatest(keep, F.lit(1)), F.size(xs))).otherwise(F.array().cast("array<string>"))

    lines = F.reverse(trimmed(F.reverse(trimmed(lines, opening)), closing))
    lines = F.filter(lines, lambda x: ~x.rlike(rule))
    lines = F.transform(lines, _without_markdown)
    res = strip(F.array_join(F.filter(F.transform(lines, strip), lambda x: x != ""), "\n"))
    bad = (res == "") | ((F.length(base) > 100) & (F.length(res) < 0.15 * F.length(base)))
    return F.struct(F.when(bad, base).otherwise(res).alias("text"), F.when(bad, 0).otherwise(F.length(base) - F.length(res)).alias("removed"))


# Chatter patterns at the start and end of model outputs.
KO_OPENING = (
    r"^물론입니다", r"^알겠습니다", r"^네[,.]?\s*$",
    r"아래(는|와\s*같이).{0,40}(작성|정리|변환|다시\s*(썼|쓴|쓰))",
    r"다음은.{0,40}(쉬운|다시\s*(쓴|작성)|변환|바꾼)",
    r"원문(의|에).{0,30}(유지|바탕).{0,20}(작성|다시)",
    r"^다시\s*(정리|작성)(해|한)", r"원문에\s*있는\s*모든",
)
KO_CLOSING = (
    r"필요하시?면.{0,20}(말씀|알려|문의|주세요)",
    r"도움이\s*되(었|시|길|기를)", r"추가.{0,10}(궁금|질문|문의)",
    r"더\s*(자세한|궁금).{0,20}(설명|안내|점).{0,20}(필요|원하|있으)",
    r"드릴\s*수\s*있", r"말씀해\s*주세요", r"참고하시(기|어)",
)


def has_final_consonant(t: Column) -> Column:
    """Whether the last character is a Hangul syllable with a final consonant; null if it is no syllable."""
    last = F.right(_c(t), F.lit(1))
    code = F.conv(F.hex(F.encode(last, "UTF-16BE")), 16, 10).cast("int") - 0xAC00
    return F.when(last.rlike("[가-힣]"), code % 28 != 0)


def definition_sentence(term: Column, explanation: Column, prefix: str = "") -> Column:
    particle = F.when(F.coalesce(has_final_consonant(term), F.lit(False)), "은").otherwise("는")
    head = prefix.strip() + " " if prefix.strip() else ""
    return F.concat(F.lit(head), _c(term), particle, F.lit(" "), F.regexp_replace(strip(explanation), r"\.+$", ""), F.lit("입니다."))


# Particle pairs after a final consonant and after a vowel.
PARTICLE_PAIRS = (("이", "가"), ("을", "를"), ("은", "는"), ("과", "와"), ("으로", "로"), ("이었", "였"), ("아", "야"))


def repair_particle(before: Column, after: Column) -> Column:
    """``before`` and ``after`` joined, with the particle that starts ``after`` fitted to the end of ``before``."""
    b, rest = has_final_consonant(before), _c(after)
    fixed = F.when(b.isNull(), rest)
    for closed, open_ in PARTICLE_PAIRS:
        cut = lambda x: F.substr(rest, F.lit(len(x) + 1))
        fixed = fixed.when(rest.startswith(closed) & ~b, F.concat(F.lit(open_), cut(closed))).when(rest.startswith(open_) & b, F.concat(F.lit(closed), cut(open_)))
    return F.concat(_c(before), fixed.otherwise(rest))


def lemma_variants(headword: Column) -> Column:
    """Dictionary headword to its variants: alternatives at slashes, digits and hyphens removed."""
    parts = F.transform(F.split(_c(headword), "/"), lambda x: F.trim(F.regexp_replace(x, r"[\d\-]", "")))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def classify_variant(term: Column, variant: Column) -> Column:
    """(kind, hint) of how a variant differs from its term; hints are for a person to decide."""
    t, v = _c(term), _c(variant)
    extra = F.regexp_replace(v, F.concat(F.lit(r"^(.*?)\Q"), t, F.lit(r"\E")), F.lit("$1"))
    dropped = F.regexp_replace(t, F.concat(F.lit(r"^(.*?)\Q"), v, F.lit(r"\E")), F.lit("$1"))
    no = F.coalesce(v, F.lit("")) == ""
    kind = F.when(no, "none").when(F.contains(v, t), F.when(v.startswith(extra), "prefix_added").otherwise("suffix_added")).when(F.contains(t, v), "suffix_dropped").otherwise("other")
    likely = dropped.isin("증", "술", "염", "성", "적")
    hint = F.when(no, "").when(F.contains(v, t), F.concat(F.lit("review: "), extra)).when(F.contains(t, v), F.concat(F.when(likely, "likely equivalent: ").otherwise("review: "), dropped)).otherwise("review")
    return F.struct(kind.alias("kind"), hint.alias("hint"))


def salvage_json(t: Column, ddl: str) -> Column:
    """The first balanced-looking JSON object in a reply, parsed; null where it doesn't parse."""
    return F.from_json(F.regexp_extract(_c(t), r"(?s)(\{.*\})", 1), ddl, {"mode": "PERMISSIVE"})


def equal_slices(t: Column, n: int) -> Column:
    """``n`` slices of equal length, the last one longer."""
    t = _c(t)
    step = F.greatest(F.floor(F.length(t) / n), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substring(t, i * step + 1, F.when(i == n - 1, F.length(t)).otherwise(step)))


def keyword_counts(t: Column, domains: dict[str, Sequence[str]]) -> Column:
    return F.create_map(*[x for k, ws in domains.items() for x in (F.lit(k), sum((count_of(t, w) for w in ws), F.lit(0)))])


def slug(t: Column) -> Column:
    return F.regexp_replace(_c(t), r"[^A-Za-z0-9._-]+", "_")


def word_set(t: Column, pattern: str = r"[\p{L}\p{N}]+") -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(_c(t)), F.lit(pattern), F.lit(0)))


def alnum(t: Column) -> Column:
    return F.regexp_replace(F.lower(_c(t)), r"[^\p{L}\p{N}]+", "")


def input_hash(*parts: Column) -> Column:
    """12 hex digits of the SHA-256 over NUL-separated parts; a stage's output feeds the next one's hash."""
    return F.left(F.sha2(F.concat(*[x for p in parts for x in (F.coalesce(_c(p).cast("string"), F.lit("")), F.lit("\0"))]), 256), F.lit(12))


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(_c(x), digits)
