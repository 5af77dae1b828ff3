"""Defined terms: definition lists of sections whose titles name terms, and primary index entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import nesting
from .documents import term_spellings


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def passes_terms_on(title: Column) -> Column:
    """A title that names terms for its subsections too.

    It holds terminology, glossary or terms, opens with conventions and definitions (or acronyms), or lists
    definitions as an item of its own.
    """
    words = _words(title)
    conventions = (F.slice(words, 1, 2) == F.array(F.lit("conventions"), F.lit("and"))) & F.get(words, F.lit(2)).isin("definitions", "acronyms")
    items = F.filter(F.split(F.lower(title), r",| and "), lambda i: F.trim(i) != "")
    own = F.exists(items, lambda i: F.regexp_replace(i, r"[^\p{L}]+", "").isin("definitions", "anddefinitions"))
    out = F.arrays_overlap(words, F.array(F.lit("terminology"), F.lit("glossary"), F.lit("terms"))) | F.coalesce(conventions, F.lit(False)) | ((F.size(items) > 1) & own)
    return F.coalesce(out, F.lit(False))


def names_terms(title: Column) -> Column:
    """A title of a section whose own lists define terms."""
    return F.coalesce(F.get(_words(title), F.lit(0)) == "definitions", F.lit(False)) | passes_terms_on(title)


def term_sections(sections: DataFrame, id_col: str) -> DataFrame:
    """Those of ``sections(id, pos, depth, title, ...)`` that define terms, by their title or by that of one above them."""
    told = nesting.below(sections, id_col, "pos", "depth", passes_terms_on(F.col("title")))
    return told.where(F.col("below") | names_terms(F.col("title"))).drop("below")


def listed(found: DataFrame, id_col: str) -> DataFrame:
    """(id, pos, section, term, meaning) of the definition lists among ``nesting.nodes``, but not of lists inside a definition.

    A term's meaning is the next definition of its list: its own text, or that of its first block with any.
    """
    elements = found.where("kind = 'element'").select(id_col, "pos", "tag", "depth", "parent", "section")
    rows = nesting.below(elements, id_col, "pos", "depth", F.col("tag") == "dd").where("tag in ('dt', 'dd') and not below")
    back = Window.partitionBy(id_col, "parent").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    terms = rows.withColumn("dd", F.last(F.when(F.col("tag") == "dd", F.col("pos")), True).over(back)).where("tag = 'dt'")
    texts = nesting.blocks(found, id_col).select(id_col, "pos", "text").where("text != ''")
    inner = elements.select(id_col, "pos", F.col("parent").alias("dd")).join(texts.hint("merge"), [id_col, "pos"]).groupBy(id_col, "dd").agg(F.min_by("text", "pos").alias("inner"))
    own = texts.select(id_col, F.col("pos").alias("dd"), F.col("text").alias("own"))
    met = terms.join(texts.withColumnRenamed("text", "term").hint("merge"), [id_col, "pos"]).join(own.hint("merge"), [id_col, "dd"], "left").join(inner.hint("merge"), [id_col, "dd"], "left")
    return met.select(id_col, "pos", "section", "term", F.coalesce("own", "inner", F.lit("")).alias("meaning"))


def indexed(found: DataFrame, id_col: str) -> DataFrame:
    """(id, pos, section, term, meaning) of primary index entries; the meaning is the block they stand in, none outside of one."""
    own = found.where("tag = 'iref' and attributes['primary'] = 'true'").select(id_col, "pos", "section", "block", F.trim(F.col("attributes")["item"]).alias("term"))
    texts = nesting.blocks(found, id_col).select(id_col, F.col("pos").alias("block"), F.col("text").alias("meaning"))
    return own.where("term != ''").join(texts.hint("merge"), [id_col, "block"], "left").select(id_col, "pos", "section", "term", F.coalesce("meaning", F.lit("")).alias("meaning"))


def defined_terms(found: DataFrame, id_col: str) -> DataFrame:
    """(id, term, anchor, meaning) of documents in XML as ``nesting.nodes``.

    Of a spelling's definitions the first counts, index entries before lists; one without meaning gives way to any
    with one, and a term with none is dropped. A term that is a list in a definition list has each item as a
    spelling; an index entry's commas belong to its name.
    """
    sections = nesting.sections(found, id_col)
    read = term_sections(sections, id_col).select(id_col, F.col("pos").alias("section"))
    bare = F.regexp_replace("term", r"\s*[:\-–—]+\s*$", "")
    lists = listed(found, id_col).join(read.hint("merge"), [id_col, "section"], "left_semi").select(id_col, "section", "pos", F.lit(1).alias("source"), F.explode(term_spellings(bare)).alias("term"), "meaning")
    entries = indexed(found, id_col).select(id_col, "section", "pos", F.lit(0).alias("source"), "term", "meaning")
    first = lists.unionByName(entries).where("meaning != ''").groupBy(id_col, "term").agg(F.min(F.struct("source", "pos", "section", "meaning")).alias("d"))
    anchors = sections.select(id_col, F.col("pos").alias("section"), "anchor")
    return first.select(id_col, "term", "d.section", "d.meaning").join(anchors.hint("merge"), [id_col, "section"], "left").select(id_col, "term", "anchor", "meaning")
