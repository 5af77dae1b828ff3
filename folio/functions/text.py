"""Text functions on Columns. Word rules differ by operator on purpose; don't share one for all."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Composed Latin letters in small, their plain letters, and marks that may follow a letter (they go).
ACCENTED = "".join(c for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if c == c.lower() and "a" <= unicodedata.normalize("NFD", c)[0] <= "z" and unicodedata.decomposition(c))
PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in ACCENTED)
MARKS = "".join(map(chr, range(0x300, 0x370)))


def fold(text: Column) -> Column:
    """Lower case without accents, composed or as marks of their own; ``ß``, ``ø``, ``ł`` and ``æ`` stay."""
    return F.translate(F.lower(text), ACCENTED + MARKS, PLAIN)


def title_words(text: Column) -> Column:
    """Distinct runs of letters and digits of the folded text."""
    return F.array_distinct(F.filter(F.split(fold(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def tokens(text: Column) -> Column:
    """Search tokens in order: folded runs of letters, digits and private characters."""
    return F.filter(F.split(fold(text), r"[^\p{L}\p{N}\p{Co}]+"), lambda w: w != "")


#: Words that alignment passes over.
STOPWORDS = (
    "a an and are as at be been but by can does for from has have if in into is it its may must no not of on or other shall should so such than that the their then there these this those to was were which will with"
).split()


def alignment_words(text: Column) -> Column:
    """Lower-case words of more than one character, with inner hyphens, without stop words."""
    parts = F.transform(F.split(F.lower(text), r"[^\p{L}\p{N}-]+"), lambda w: F.regexp_replace(w, "^-+|-+$", ""))
    return F.filter(parts, lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS))


def frequency_words(text: Column) -> Column:
    """Runs of letters and digits with inner hyphens and apostrophes, lower-case ones only."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+(?:[-'][\p{L}\p{N}]+)*"), F.lit(0)), lambda w: w == F.lower(w))


def content_words(text: Column) -> Column:
    """Lower-case runs of letters, digits and ``._-`` that start with a letter or digit."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}][\p{L}\p{N}._-]*"), F.lit(0))


def squeezed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(text), r"[^a-z0-9]+", "-"), "^-+|-+$", "")


def sentences(text: Column) -> Column:
    """Sentences: an end mark and its closers, white space, then a capital, digit or opener."""
    kept = F.regexp_replace(text, r"\b(e\.g|i\.e|Sec|cf|vs|Fig)\.", "$1\u0001")
    cut = F.regexp_replace(squeezed(kept), r"([.!?][\"')\]]*) (?=[\p{Lu}\p{N}\"'(\[])", "$1\n")
    return F.filter(F.split(F.regexp_replace(cut, "\u0001", "."), "\n"), lambda s: s != "")


#: Requirement words, pairs before their first words.
REQUIREMENT_WORDS = ("MUST NOT", "MUST", "REQUIRED", "SHALL NOT", "SHALL", "SHOULD NOT", "SHOULD", "NOT RECOMMENDED", "RECOMMENDED", "MAY", "OPTIONAL")


def keywords(text: Column, words=REQUIREMENT_WORDS) -> Column:
    """The requirement words of a text in order, case and all."""
    return F.regexp_extract_all(text, F.lit(r"\b(?:" + "|".join(words) + r")\b"), F.lit(0))


def opening(text: Column, scan: int = 400, limit: int = 160) -> Column:
    """The text's start, cut after a word before ``limit`` characters, with an ellipsis if cut."""
    whole = squeezed(F.substring(text, 1, scan))
    head = F.regexp_extract(F.substring(whole, 1, limit), r"^(.*)\s", 1)
    return F.when(F.length(whole) <= limit, whole).otherwise(F.concat(F.when(head == "", F.substring(whole, 1, limit)).otherwise(head), F.lit("…")))


def diff_tokens(text: Column) -> Column:
    """Words and white space runs in order, each white space run as one token."""
    return F.regexp_extract_all(text, F.lit(r"\s+|\S+"), F.lit(0))


def document_id(label: Column) -> Column:
    """(series, number) of ``RFC 9110``, ``bcp14`` or a bare number (an RFC); null if it is none."""
    series = F.upper(F.regexp_extract(label, r"(?i)^\s*(RFC|STD|BCP|FYI)?[ -]?0*(\d+)\s*$", 1))
    number = F.regexp_extract(label, r"(?i)^\s*(RFC|STD|BCP|FYI)?[ -]?0*(\d+)\s*$", 2)
    return F.when(number != "", F.struct(F.when(series == "", "RFC").otherwise(series).alias("series"), number.try_cast("int").alias("number")))


def series_order(series: Column) -> Column:
    return F.array_position(F.array(F.lit("RFC"), F.lit("STD"), F.lit("BCP"), F.lit("FYI")), series)


def section_anchor(number: Column) -> Column:
    """``4.2`` as ``section-4.2``, ``A.1`` as ``appendix-A.1``."""
    return F.when(number.rlike(r"^\d"), F.concat(F.lit("section-"), number)).when(number.rlike(r"^[A-Z](\.|$)"), F.concat(F.lit("appendix-"), number))


def place_name(number: Column) -> Column:
    return F.when(number.rlike(r"^\d"), F.concat(F.lit("Section "), number)).when(number.rlike(r"^[A-Z](\.|$)"), F.concat(F.lit("Appendix "), number))


def link_target(url: Column) -> Column:
    """The document id of a link to one: a path or host part like ``rfc9110`` or ``rfc9110.html``."""
    found = F.regexp_extract(F.lower(url), r"(?:^|[/=:])(rfc|std|bcp|fyi)-?0*(\d+)(?:\.\w+)?(?:[/?#]|$)", 0)
    return F.when(found != "", document_id(F.regexp_replace(found, r"^[/=:]|\.\w+(?=[/?#]|$)|[/?#]$", "")))


def version_key(version: Column) -> Column:
    """``2026.10.2`` as an array of numbers, which compares as versions do."""
    return F.transform(F.split(version, r"\."), lambda x: x.try_cast("int"))


def expanded(line: Column, width: int = 8) -> Column:
    """Tabs of a line as spaces up to the next column that ``width`` divides."""
    fill = lambda done: (F.lit(width) - F.length(done) % width).cast("int")
    parts = F.split(line, "\t", -1)
    whole = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.element_at(parts, 1), lambda done, part: F.concat(done, F.repeat(F.lit(" "), fill(done)), part))
    return F.when(line.isNotNull(), whole)


def starts_with_any_case(column: Column, text: str) -> Column:
    """Prefix match without regard to case, in which ``%`` and ``_`` mean themselves."""
    return F.lower(column).startswith(text.lower())
