"""Rules on a document's text and records: headers, bibliographies, captions, terms, glosses, views and exports."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import keywords
from ..sources.tables import dealt

# --- fields of a text -----------------------------------------------------------------------


def header_numbers(docs: DataFrame, field: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, number, ord): the documents that a header line like ``Obsoletes: 12, 34`` names, in order."""
    listed = F.regexp_extract(text_col, rf"(?im)^\s*{field}\s*:\s*(\d+(?:\s*,\s*\d+)*)", 1)
    numbers = F.filter(F.transform(F.split(listed, r"\s*,\s*"), lambda x: x.try_cast("int")), lambda x: x.isNotNull())
    return docs.select(id_col, F.posexplode(numbers).alias("ord", "number"))


def bibliography(lines: DataFrame) -> DataFrame:
    """(doc_id, ord, label, entry, number): entries that start with ``[label]``, with the lines that follow them.

    An entry ends at a blank line or the next label. ``number`` is the document it is, if it says ``RFC n``.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    label = F.regexp_extract("line", r"^\s*\[([A-Za-z0-9][^\]]*)\]\s+\S", 1)
    starts, blank = label != "", F.trim("line") == ""
    marked = lines.withColumn("label", label).withColumn("ord", F.sum(starts.cast("int")).over(w)).withColumn("gap", F.sum((blank | starts).cast("int")).over(w))
    first = marked.where("label != ''").select("doc_id", "ord", "label", F.col("gap").alias("own_gap"))
    inside = marked.drop("label").where(F.trim("line") != "").join(first, ["doc_id", "ord"]).where("gap = own_gap")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: F.trim(F.regexp_replace(x["line"], r"\s+", " "))), " ")
    entries = inside.groupBy("doc_id", "ord", "label").agg(F.regexp_replace(text, r"^\[[^\]]*\]\s+", "").alias("entry"))
    return entries.withColumn("number", F.regexp_extract("entry", r"\bRFC\s*(\d+)", 1).try_cast("int"))


def captions(lines: DataFrame) -> DataFrame:
    """(doc_id, pos, kind, number, caption) of lines like ``Figure 3: A title``."""
    pattern = r"^\s*(Figure|Table)\s+(\d+)\s*(?:[:.]\s*(.*?))?\s*$"
    part = lambda i: F.regexp_extract("line", pattern, i)
    return lines.select("doc_id", "pos", F.lower(part(1)).alias("kind"), part(2).try_cast("int").alias("number"), part(3).alias("caption")).where("kind != ''")


def errata_sections(field: Column) -> Column:
    """The sections that an erratum's section field lists; those of another document (``of RFC n``) don't count, words are none."""
    own = F.regexp_replace(field, r"(?i)(?:sections?\s+)?[\dA-Z]+(?:\.\d+)*\s+of\s+RFC\s*\d+", " ")
    return F.array_distinct(F.regexp_extract_all(own, F.lit(r"(?<![\w.])((?:\d+|[A-Z])(?:\.\d+)*)(?![\w]|\.\d)"), F.lit(1)))


def is_boilerplate(text: Column, cites_rule: Column) -> Column:
    """Text that only says how keywords are meant: five of them or more, or the rule is cited and they are interpreted or quoted."""
    found = F.array_distinct(keywords(text))
    quoted = F.exists(found, lambda k: F.contains(text, F.concat(F.lit('"'), k, F.lit('"'))))
    return (F.size(found) >= 5) | (cites_rule & (F.contains(text, F.lit("interpreted")) | quoted))


def term_spellings(term: Column) -> Column:
    """The spellings of a defined term: parts of a list, what a parenthesis gives, without quotes and citations."""
    bare = F.regexp_replace(F.regexp_replace(term, r"\[[^\]]*\]", " "), "[\"'“”‘’]", "")
    inner = F.regexp_extract_all(bare, F.lit(r"\(([^)]*)\)"), F.lit(1))
    outer = F.split(F.regexp_replace(bare, r"\([^)]*\)", " "), r"\s*(?:,|/|\bor\b|\band\b)\s*")
    return F.array_distinct(F.filter(F.transform(F.concat(outer, inner), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != ""))


def glossary(lines: DataFrame) -> DataFrame:
    """(doc_id, pos, short, long) of lines like ``TLS: Transport Layer Security`` whose words' first letters are the short form."""
    short = F.regexp_extract("line", r"^\s*([A-Z][A-Z0-9]{1,9})\s*[:\-–]\s+(\S.*)$", 1)
    full = F.trim(F.regexp_extract("line", r"^\s*([A-Z][A-Z0-9]{1,9})\s*[:\-–]\s+(\S.*)$", 2))
    letters = F.upper(F.array_join(F.transform(F.filter(F.split(full, r"[\s-]+"), lambda w: w != ""), lambda w: F.substring(w, 1, 1)), ""))
    return lines.select("doc_id", "pos", short.alias("short"), full.alias("long"), letters.alias("letters")).where("short != '' and letters = short").drop("letters")


def citing_windows(texts: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, start, window): the sentence around each of ``spans(id, start, end)``, without the citation itself."""
    met = spans.join(texts.select(id_col, F.col(text_col).alias("__t")), id_col)
    before = F.regexp_extract(F.expr("substring(__t, 1, start)"), r"(?s)([^.!?]*)$", 1)
    after = F.regexp_extract(F.expr("substring(__t, end + 1)"), r"(?s)^([^.!?]*[.!?]?)", 1)
    return met.select(id_col, "start", F.trim(F.regexp_replace(F.concat(before, after), r"\s+", " ")).alias("window"))


#: Kinds of artwork, and the types that count as each.
ARTWORK = {"grammar": ("abnf", "bnf", "ebnf"), "code": ("c", "c++", "java", "javascript", "python", "go", "rust", "asn.1", "yang", "xml", "json", "cbor"), "drawing": ("ascii-art", "svg", "binary-art"), "message": ("http-message", "call-flow", "hex-dump")}


def artwork_kind(declared: Column) -> Column:
    """What a declared artwork type counts as; null for none that is known."""
    low, out = F.lower(F.trim(declared)), F.lit(None).cast("string")
    for kind, types in ARTWORK.items():
        out = F.when(low.isin(list(types)), kind).otherwise(out)
    return out


# --- records --------------------------------------------------------------------------------


def due(checks: DataFrame, now: datetime, every: timedelta = timedelta(hours=24), forget: timedelta = timedelta(days=7)) -> DataFrame:
    """``checks(key, checked_at, etag)`` with ``is_due``, and ``etag`` null where it is too old to be asked with.

    Ages count to the microsecond; ``now`` without a zone is of the session's.
    """
    at = F.lit(now.isoformat(sep=" ")).cast("timestamp")
    age = F.unix_micros(at) - F.unix_micros(F.col("checked_at").cast("timestamp"))
    micros = lambda d: F.lit(d // timedelta(microseconds=1)).cast("long")
    return checks.withColumn("is_due", F.coalesce(age >= micros(every), F.lit(True))).withColumn("etag", F.when(age < micros(forget), F.col("etag")))


def usage(files: DataFrame, tier: str = "tier") -> DataFrame:
    """(tier, n, bytes): files and bytes of each tier."""
    return files.groupBy(tier).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


def published(records: DataFrame, rows: int | None = None) -> DataFrame:
    """(number, relation, draft, revision, ord): the view that others read of ``records(draft, revision, obsoletes, updates)``.

    One row for each document that a draft would replace or update, by number, then relation, draft. ``rows``: about
    how many there are, if that is known. Equal rows meet in the order that numbers them; no task keeps a table of them.
    """
    def named(column: str):
        numbers = F.coalesce(F.col(column), F.array().cast("array<long>"))
        return F.transform(numbers, lambda n: F.struct(n.alias("number"), F.lit(column).alias("relation")))

    each = [named("obsoletes"), named("updates")]
    named_ = records.select("draft", "revision", F.explode(F.concat(*each)).alias("e")).select("e.number", "e.relation", "draft", "revision")
    if rows is not None:
        named_ = dealt(named_, rows, "number")
    w = Window.partitionBy("number").orderBy("relation", "draft", "revision")
    own = F.struct("relation", "draft", "revision")
    again = F.lag(own).over(w).eqNullSafe(own)
    return named_.withColumn("ord", F.dense_rank().over(w)).withColumn("__again", again).where("not __again").drop("__again")


def missing_keys(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """(key): distinct keys of ``wanted`` that ``have`` lacks; null and empty ones are none."""
    return wanted.select("key").where("key is not null and key != ''").distinct().join(have.select("key").distinct(), "key", "left_anti")


def retained(indexed: DataFrame, bodies: DataFrame) -> DataFrame:
    """(doc, state) of ``indexed(doc, retained, written)`` against ``bodies(doc, written)``: retained, current, stale or gone."""
    both = indexed.join(bodies.select("doc", F.col("written").alias("__w")), "doc", "left")
    state = F.when(F.col("retained"), "retained").when(F.col("__w").isNull(), "gone").when(F.col("__w") > F.col("written"), "stale").otherwise("current")
    return both.select("doc", state.alias("state"))


def exported(annotations: DataFrame) -> DataFrame:
    """(doc, text): a document's annotations as Markdown, by place: ``annotations(doc, pos, quote, note)``."""
    item = F.concat(F.lit("> "), F.coalesce("quote", F.lit("")), F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit("\n\n"), F.col("note"))).otherwise(""))
    listed = F.array_sort(F.collect_list(F.struct("pos", item.alias("t"))))
    return annotations.groupBy("doc").agg(F.array_join(F.transform(listed, lambda x: x["t"]), "\n\n").alias("text"))


def as_json(rows: DataFrame) -> DataFrame:
    """(json): rows as JSON with keys in order, so that reports can be compared line by line."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("json"))
