"""String functions as Spark columns. Everything here stays in the JVM."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinweave import settings

#: Every Unicode space and the four separators below the blank, spelled out: a class of plain ranges is matched much
#: faster than ``\\s`` under (?U).
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
SPACE = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def strip(text: Column) -> Column:
    """Drop leading and trailing Unicode white space (``trim`` alone knows only the blank)."""
    return F.btrim(text, F.lit(SPACES))


def squeeze(text: Column) -> Column:
    """Collapse each run of white space to one blank."""
    return F.regexp_replace(text, f"{SPACE}+", " ")


def blank_to_null(text: Column) -> Column:
    """NULL for NULL, empty and white-space-only text."""
    return F.when(strip(text) != "", text)


@lru_cache(maxsize=None)
def _folding(form: str) -> tuple[str, str, str, str]:
    """Derive the character tables of a Unicode decomposition form.

    Returns (from, to) strings for ``translate``, the characters that expand to several ones,
    and those expansions as a JSON object. ``NFD`` drops combining marks; ``NFKD`` keeps ASCII only.
    """
    source, target, dropped, expanding = [], [], [], {}
    for point in range(0x80, 0x30000):  # no character beyond has a decomposition
        if 0xAC00 <= point <= 0xD7A3 or 0xD800 <= point <= 0xDFFF:
            continue  # Hangul is decomposed arithmetically; surrogates are not characters
        char = chr(point)
        parts = unicodedata.normalize(form, char)
        if form == "NFD":
            parts = "".join(c for c in parts if unicodedata.category(c) != "Mn")
        else:
            if parts == char:
                continue  # stays non-ASCII, removed in bulk afterwards
            parts = "".join(c for c in parts if ord(c) < 0x80)
            if not parts:
                continue
        if parts == char:
            continue
        if len(parts) == 1:
            source.append(char)
            target.append(parts)
        elif not parts:
            dropped.append(char)
        else:
            expanding[char] = parts
    return "".join(source + dropped), "".join(target), "".join(expanding), json.dumps(expanding)


def _expand(text: Column, form: str) -> Column:
    """Replace the characters that decompose into several ones; other text passes untouched."""
    _, _, chars, mapping = _folding(form)
    if not chars:
        return text
    table = F.from_json(F.lit(mapping), "map<string,string>")
    spelled = F.concat_ws("", F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)))
    return F.when(text.rlike("[" + chars + "]"), spelled).otherwise(text)


def _utf16(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def _split_hangul(text: Column) -> Column:
    """Hangul syllables to conjoining letters, by the arithmetic of the Unicode standard."""

    def letters(char: Column) -> Column:
        index = F.ascii(char).cast("long") - 0xAC00
        tail = index % 28
        spelled = F.concat(
            _utf16(F.lit(0x1100) + F.floor(index / 588)),
            _utf16(F.lit(0x1161) + F.floor((index % 588) / 28)),
            F.when(tail > 0, _utf16(F.lit(0x11A7) + tail)).otherwise(""),
        )
        return F.when(char.rlike("^[\\uAC00-\\uD7A3]"), spelled).otherwise(char)

    return F.when(
        text.rlike("[\\uAC00-\\uD7A3]"), F.concat_ws("", F.transform(F.split(text, ""), letters))
    ).otherwise(text)


def strip_accents(text: Column) -> Column:
    """Canonical decomposition without the combining marks."""
    source, target, _, _ = _folding("NFD")
    folded = _split_hangul(_expand(text, "NFD"))
    return F.when(text.rlike("[^\\x00-\\x7F]"), F.translate(folded, source, target)).otherwise(text)


def name_key(name: Column) -> Column:
    """Comparison key of a person name: ASCII letters and digits joined by single hyphens."""
    source, target, _, _ = _folding("NFKD")
    folded = F.regexp_replace(F.translate(_expand(name, "NFKD"), source, target), "[^\\x00-\\x7F]", "")
    plain = F.when(name.rlike("[^\\x00-\\x7F]"), folded).otherwise(name)
    return F.regexp_replace(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def normalize(name: Column) -> Column:
    """Canonical form of a capability name: lower case, no accents, no punctuation, single blanks."""
    plain = F.translate(strip_accents(F.lower(strip(name))), "-_", "  ")
    return strip(squeeze(F.regexp_replace(plain, f"[^\\p{{L}}\\p{{N}}_{SPACE[1:-1]}]", "")))


def capability_id(name: Column) -> Column:
    """Slug of a capability name."""
    return F.replace(normalize(name), F.lit(" "), F.lit("_"))


def is_generic(name: Column, terms: list[str] | None = None) -> Column:
    """True where the name, or each of its words, is a stop term."""
    stop = F.array(*[F.lit(t) for t in (settings.GENERIC_TERMS if terms is None else terms)])
    if terms is not None:
        stop = F.transform(stop, normalize)
    normal = normalize(name)
    words = F.filter(F.split(normal, " "), lambda w: w != "")
    return F.array_contains(stop, normal) | (
        (F.size(words) > 0) & F.forall(words, lambda w: F.array_contains(stop, w))
    )


def capability_kind(kind: Column) -> Column:
    """Upper-cased kind, UNKNOWN when it is not one of the fixed kinds."""
    upper = F.upper(kind)
    return F.when(upper.isin(settings.CAPABILITY_KINDS), upper).otherwise("UNKNOWN")


def is_abbreviation(normal: Column) -> Column:
    """Short single-token names need a higher similarity before they merge."""
    text = strip(normal)
    return (F.length(text) <= settings.ABBREVIATION_MAX_LENGTH) & ~F.contains(text, F.lit(" "))


def slug(text: Column) -> Column:
    """Trimmed, lower-cased text with underscores for white space."""
    return F.regexp_replace(F.lower(strip(text)), f"{SPACE}+", "_")


def person_match_key(name: Column) -> Column:
    """Key under which equal full names count as one homonym group."""
    return squeeze(F.replace(F.lower(strip(name)), F.lit("ß"), F.lit("ss")))


def display_name(person_id: Column) -> Column:
    """Hyphens to blanks and title case, where every letter run starts upper; placeholders stay as they are."""
    runs = F.regexp_extract_all(F.replace(person_id, F.lit("-"), F.lit(" ")), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    titled = F.concat_ws("", F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))))
    return F.when(is_placeholder(person_id), person_id).otherwise(titled)


def is_placeholder(person_id: Column) -> Column:
    return F.startswith(person_id, F.lit(settings.PLACEHOLDER_PREFIX))


def parse_year(value: Column) -> Column:
    """All digits, or the first four characters when those are digits."""
    head = F.substring(value, 1, 4)
    return F.when(value.rlike(r"^\p{Nd}+$"), value.try_cast("int")).when(
        head.rlike(r"^\p{Nd}{4}$"), head.try_cast("int")
    )


def last_segment(value: Column) -> Column:
    """Last path segment of an identifier URL."""
    text = F.regexp_replace(strip(value), "/+$", "")
    return F.when(value != "", F.element_at(F.split(text, "/"), -1))


def clean_domain_label(label: Column) -> Column:
    """Last path segment without its trailing bracketed code."""
    tail = strip(F.element_at(F.split(label, "/"), -1))
    bracketed = tail.endswith("]") & F.contains(tail, F.lit("["))
    return F.when(bracketed, strip(F.regexp_replace(tail, r"\[[^\[]*$", ""))).otherwise(tail)


def is_valid_date(value: Column) -> Column:
    """A year or a full ISO calendar date, with at most one trailing Z."""
    text = F.regexp_replace(strip(value), "Z$", "")
    day = r"^\d{4}-\d{2}-\d{2}$"
    # Pattern and calendar are tested separately: the parser alone accepts shorter forms.
    return text.rlike(r"^\d{4}$") | (text.rlike(day) & F.try_to_date(F.when(text.rlike(day), text), "yyyy-MM-dd").isNotNull())


def is_valid_language(value: Column) -> Column:
    text = strip(value)
    base = F.element_at(F.split(F.lower(text), "-"), 1)
    return text.rlike(settings.LANGUAGE_PATTERN) & base.isin(settings.LANGUAGE_CODES)


def query_keywords(query: Column) -> Column:
    """Three-, two- and one-word phrases of a free-text query, stop words removed, first thirty."""
    cleaned = F.regexp_replace(F.lower(query), f"[^\\p{{L}}\\p{{N}}_\\-{SPACE[1:-1]}]", " ")
    stop = F.array(*[F.lit(w) for w in settings.QUERY_STOPWORDS])
    tokens = F.filter(
        F.split(squeeze(cleaned), " "),
        lambda t: (F.length(t) >= settings.QUERY_MIN_TOKEN_LENGTH) & ~F.array_contains(stop, t),
    )

    def phrases(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(tokens) - (size - 1))
        return F.when(
            F.size(tokens) >= size,
            F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(size)), " ")),
        ).otherwise(F.array().cast("array<string>"))

    every = F.array_distinct(F.concat(phrases(3), phrases(2), phrases(1)))
    return F.slice(every, 1, settings.QUERY_MAX_KEYWORDS)


def cited_ids(text: Column) -> Column:
    """Distinct bracketed identifiers in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(settings.CITATION_PATTERN), F.lit(1)))


def short_title(text: Column) -> Column:
    """At most eighty characters."""
    return F.when(F.length(text) <= 80, text).otherwise(F.concat(F.substring(text, 1, 77), F.lit("...")))


def comma_list(text: Column) -> Column:
    """Comma-separated values, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(text, ","), strip), lambda x: x != "")


def evidence_in_text(evidence: Column, title: Column, abstract: Column, keywords: Column) -> Column:
    """Whether the quoted evidence occurs, ignoring case, in the publication text."""
    whole = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit("")),
                                F.coalesce(F.array_join(keywords, " "), F.lit(""))))
    return F.contains(whole, strip(F.lower(evidence)))


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the pipe-joined parts; NULL parts count as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256)
