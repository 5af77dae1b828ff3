"""Spans of texts: the leftmost-longest choice, terms of a dictionary, links in running text."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def leftmost_longest(spans: DataFrame, id_col: str, start: str = "start", end: str = "end") -> DataFrame:
    """Of ``spans(id, start, end, ...)`` those that stay when texts are read from the left: the first, of those that start together the longest, then the first behind its end.

    Equal spans all stay. A span's fate hangs on the one before it that stayed, so a text's spans are read in
    order by one task, which holds one number of them; texts are dealt over the tasks.
    """
    ordered = spans.repartition(id_col).sortWithinPartitions(F.asc_nulls_first(id_col), F.asc(start), F.desc(end))

    def run(batches):
        text, kept, reach = None, None, -1
        first = True
        for batch in batches:
            keep = []
            for i, a, b in zip(*(batch.column(c).to_pylist() for c in (id_col, start, end))):
                if first or i != text:
                    text, kept, reach, first = i, None, -1, False
                stays = a >= reach or (a, b) == kept
                if stays:
                    kept, reach = (a, b), b
                keep.append(stays)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return ordered.mapInArrow(run, spans.schema)


def words_of(text):
    """Lower-case runs of letters and digits, with single hyphens inside."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*"), F.lit(0))


#: Terms up to which a dictionary is sent to the texts; beyond, places and terms are dealt by their first word.
SENT_TERMS = 100_000


def dictionary_hits(texts: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, key, n_words): every place where a text has a term of ``terms(key, term)``, of any number of words.

    Places meet the terms by their first word; what follows is compared in the row, so no text is held against all
    terms. A dictionary of at most ``SENT_TERMS`` is sent to the texts, so that only hits leave their tasks. A term
    without words is none.
    """
    known = terms.select("key", words_of(F.col("term")).alias("term")).where(F.size("term") > 0).distinct().withColumn("first", F.element_at("term", 1))
    most, n = known.agg(F.max(F.size("term")), F.count(F.lit(1))).first()
    if most is None:
        return texts.select(id_col, F.lit(0).alias("pos"), F.lit(None).cast(terms.schema["key"].dataType).alias("key"), F.lit(0).alias("n_words")).where("false")
    held = texts.select(id_col, words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    places = held.select(id_col, "w", F.posexplode("w").alias("pos", "first")).select(id_col, "pos", "first", F.slice("w", F.col("pos") + 1, most).alias("next"))
    met = places.join(F.broadcast(known) if n <= SENT_TERMS else known, "first").where(F.slice("next", F.lit(1), F.size("term")) == F.col("term"))
    return met.select(id_col, "pos", "key", F.size("term").alias("n_words"))


def glossed(texts: DataFrame, terms: DataFrame, id_col: str, text_col: str, skip: DataFrame | None = None) -> DataFrame:
    """(id, pos, key, n_words): where each text first uses each of ``terms(key, term)``: whole words, the longest at a place.

    A text is read from the left, and a use is passed over whole: a shorter term inside it, or one that begins in
    it, is no use, also where the longer one was used before or is in ``skip(id, key)``.
    """
    hits = dictionary_hits(texts, terms, id_col, text_col).withColumn("end", F.col("pos") + F.col("n_words"))
    used = leftmost_longest(hits, id_col, "pos", "end")
    if skip is not None:
        used = used.join(skip, [id_col, "key"], "left_anti")
    return used.groupBy(id_col, "key").agg(F.min(F.struct("pos", "n_words")).alias("f")).select(id_col, "f.pos", "key", "f.n_words")


_NUMBERS = r"\d+(?:\.\d+)*"
_AND = r"(?:\s*,\s*(?:and\s+)?|\s+and\s+)"
_SECTION_OF = re.compile(rf"\bSections?\s+(?P<sections>(?:[A-Z]|{_NUMBERS})(?:\.\d+)*(?:{_AND}{_NUMBERS})*)\s+of\s+(?:\[(?P<tag>[A-Za-z0-9][^\[\]\n]*)\]|RFC-?\s?(?P<number>\d+)(?P<suffix>\w*)(?P<name>\.[A-Z])?)")
_LABEL = re.compile(r"\[(?P<tag>[A-Za-z0-9][A-Za-z0-9.\-_ ]*)\]")
_NUMBER = re.compile(r"\bRFC[\s\-]?(?P<number>\d+)\b(?!\.[A-Z])")
_LIST = re.compile(rf"\bRFCs\s+\d{{1,5}}(?:{_AND}\d{{1,5}})*")
_SECTION = re.compile(rf"\bSections?\s+(?P<section>{_NUMBERS})\b")
_URL = re.compile(r"https?://[^\s<>\"]+")


def mentions(text: str) -> list[tuple[int, int, str, str | None, str | None]]:
    """(start, end, rule, document, section) of what in a text may be a link, overlaps and all."""
    out, cited = [], []
    for m in _SECTION_OF.finditer(text):
        cited.append(m.span())  # its words name no section of the text itself, whether or not they lead anywhere
        if m["suffix"] or m["name"]:
            continue
        document = m["tag"] or m["number"]
        numbers = list(re.finditer(rf"[A-Z](?:\.\d+)*|{_NUMBERS}", m["sections"]))
        if len(numbers) == 1:
            out.append((*m.span(), "section-of", document, m["sections"]))
        else:
            at = m.start("sections")
            out += [(at + n.start(), at + n.end(), "section-of", document, n[0]) for n in numbers]
    for m in _LABEL.finditer(text):
        out.append((*m.span(), "label", m["tag"], None))
    for m in _NUMBER.finditer(text):
        out.append((*m.span(), "number", m["number"], None))
    for m in _LIST.finditer(text):
        out += [(m.start() + n.start(), m.start() + n.end(), "number", n[0], None) for n in re.finditer(r"\d{1,5}", m[0])]
    for m in _SECTION.finditer(text):
        if not any(a < m.end() and m.start() < b for a, b in cited[-64:] if b > m.start()):
            out.append((*m.span(), "section", None, m["section"]))
    for m in _URL.finditer(text):
        out.append((m.start(), m.start() + len(m[0].rstrip(".,;:!?)]}'")), "url", m[0].rstrip(".,;:!?)]}'"), None))
    return out


def link_spans(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, start, end, rule, text, document, section): citations in running text, none over another: the leftmost, of those the longest.

    Rules: sections of a document, each of a list by itself; a bracketed label; document numbers, each of a list by
    itself; a section of the text's own; an address without the signs that end a sentence. ``RFC822.SIZE`` is a name, and
    sections of ``RFC 2223bis`` lead nowhere, nor to a section of the text. Texts without the literals of any rule are
    not sent to Python. Places count characters from 0.
    """
    text = F.col(text_col)
    gated = texts.where(text.contains("RFC") | text.contains("Section") | text.contains("[") | text.contains("http")).select(id_col, F.col(text_col).cast("string").alias(text_col))

    def run(batches):
        for batch in batches:
            rows = [(i, *m[:3], t[m[0] : m[1]], *m[3:]) for i, t in zip(batch.column(id_col).to_pylist(), batch.column(text_col).to_pylist()) for m in mentions(t)]
            if rows:
                kinds = (batch.schema.field(id_col).type, pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[id_col, "start", "end", "rule", "text", "document", "section"])

    kind = texts.schema[id_col].dataType.simpleString()
    return leftmost_longest(gated.mapInArrow(run, f"`{id_col}` {kind}, start int, end int, rule string, text string, document string, section string"), id_col)
