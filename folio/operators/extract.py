"""Extractors from text: requirements, abbreviations, defined terms, links, word runs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import REQUIREMENT_WORDS, keywords, sentences


def requirements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words=REQUIREMENT_WORDS) -> DataFrame:
    """(id, pos, sentence, found): sentences with requirement words, in order."""
    s = docs.select(F.col(id_col), F.posexplode(sentences(F.col(text_col))).alias("pos", "sentence"))
    return s.withColumn("found", keywords(F.col("sentence"), words)).where(F.size("found") > 0)


_SHORT = re.compile(r"\(([A-Za-z][A-Za-z0-9/-]{1,9})\)")


def _words_before(text: str, end: int, most: int) -> str:
    """The last ``most`` words before ``end``, joined by spaces; nothing before them is looked at."""
    words: list[str] = []
    while end > 0 and len(words) < most:
        while end > 0 and text[end - 1].isspace():
            end -= 1
        start = end
        while start > 0 and not text[start - 1].isspace():
            start -= 1
        if start < end:
            words.append(text[start:end])
        end = start
    return " ".join(reversed(words))


def _long_form(short: str, text: str) -> str | None:
    """Where every letter of the short form is found in order, from the right, the first at a word's start."""
    letters, at = [c for c in short.lower() if c.isalnum()], len(text)
    for i, c in enumerate(reversed(letters)):
        at -= 1
        last = i == len(letters) - 1
        while at >= 0 and not (text[at].lower() == c and (not last or at == 0 or not text[at - 1].isalnum())):
            at -= 1
        if at < 0:
            return None
    return text[at:]


def expansions_of(text: str | None) -> list[dict[str, str]]:
    """Abbreviations in parentheses behind their expansions, in at most min(n + 5, 2n) words before them for n letters."""
    out = []
    for m in _SHORT.finditer(text or ""):
        if sum(c.isupper() for c in m[1]) < 2:
            continue
        n = sum(c.isalnum() for c in m[1])
        full = _long_form(m[1], _words_before(text, m.start(), min(n + 5, 2 * n)))
        if full and len(full) > len(m[1]):
            out.append({"short": m[1], "long": full})
    return out


def _expansions(texts: pd.Series) -> pd.Series:
    return texts.map(expansions_of)


def expansions():
    """The function of a text column: its abbreviations with their expansions, in order."""
    return F.pandas_udf(_expansions, "array<struct<short:string,long:string>>")


def abbreviations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, short, long): the first expansion of each short form; one in capitals gives way to a later one in mixed case."""
    rows = docs.select(id_col, F.posexplode(expansions()(F.col(text_col))).alias("pos", "e")).select(id_col, "pos", "e.short", "e.long")
    shouted = F.col("long") == F.upper("long")
    w = Window.partitionBy(id_col, "short").orderBy(shouted, "pos")
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").select(id_col, "short", "long")


def abbreviation_totals(found: DataFrame, id_col: str = "doc_id", limit: int = 200) -> DataFrame:
    """(short, docs, expansions): documents with a short form and its distinct expansions, most used first."""
    norm = F.lower(F.regexp_replace("long", r"[\s-]+", " "))
    return found.groupBy("short").agg(F.count_distinct(id_col).alias("docs"), F.count_distinct(norm).alias("expansions")).orderBy(F.desc("docs"), "short").limit(limit)


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href, text): the links of a page in order."""
    found = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)">([^<]*)</a>'), F.lit(0))
    links = pages.select("page_id", F.posexplode(found).alias("pos", "a"))
    return links.select("page_id", "pos", F.regexp_extract("a", r'href="([^"]*)"', 1).alias("href"), F.regexp_extract("a", r">([^<]*)</a>", 1).alias("text"))


def page_sections(pages: DataFrame) -> DataFrame:
    """(page_id, title, heading, n_paragraphs, n_items): a page's shape."""
    count = lambda tag: F.size(F.regexp_extract_all("html", F.lit(tag), F.lit(0)))
    part = lambda tag: F.regexp_extract("html", rf"(?s)<{tag}>(.*?)</{tag}>", 1)
    return pages.select("page_id", part("title").alias("title"), part("h1").alias("heading"), count("<p>").alias("n_paragraphs"), count("<li>").alias("n_items"))


def definitions(lines: DataFrame, sign: str = r":") -> DataFrame:
    """(doc_id, pos, term, meaning): lines of the form ``Term: meaning``."""
    pattern = rf"^\s*(\S[^:]{{0,60}}?){sign}\s+(\S.*)$"
    return lines.select("doc_id", "pos", F.regexp_extract("line", pattern, 1).alias("term"), F.regexp_extract("line", pattern, 2).alias("meaning")).where("term != ''")


def relocated(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """``quotes(quote_id, doc_id, quote, at)`` found again: exact, moved (one place), ambiguous (several) or detached."""
    text = docs.select("doc_id", "text")
    n = F.when(F.col("quote") == "", 0).otherwise((F.length("text") - F.length(F.replace(F.col("text"), F.col("quote"), F.lit("")))) / F.length("quote"))
    here = F.expr("substring(text, at + 1, length(quote))") == F.col("quote")
    state = F.when(F.col("text").isNull(), "detached").when(here, "exact").when(n == 1, "moved").when(n > 1, "ambiguous").otherwise("detached")
    return quotes.join(text, "doc_id", "left").select("quote_id", "doc_id", state.alias("state"))
