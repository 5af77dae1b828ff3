"""A document's sections as rows: places, runs, lookups, outlines, headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that announce a section's number, and those of them that name an appendix.
ANNOUNCING = ("section", "sec", "§", "appendix", "annex", "chapter", "clause")
APPENDIX = ("appendix", "annex")


def relative_position(sections: DataFrame) -> DataFrame:
    """``sections(doc, pos, ...)`` with ``share``: 0 for the first of a document, 1 for its last."""
    return sections.withColumn("share", F.percent_rank().over(Window.partitionBy("doc").orderBy("pos")))


def runs(rows: DataFrame, value: str) -> DataFrame:
    """(doc, run, value, first, n): neighbours of ``rows(doc, pos, value)`` with one value together, in order.

    A run ends where the next begins, so a task reads a document's rows in one order and keeps no table of runs.
    """
    every = Window.partitionBy("doc")
    w = every.orderBy("pos")
    starts = ~F.lag(value).over(w).eqNullSafe(F.col(value)) | (F.row_number().over(w) == 1)
    told = rows.select("doc", "pos", value, starts.alias("__s"), F.row_number().over(w).alias("__nth"), F.count(F.lit(1)).over(every).alias("__all"), F.count("pos").over(every).alias("__placed"), F.min("pos").over(every).alias("__least"))
    n = F.coalesce(F.lead("__nth").over(w), F.col("__all") + 1) - F.col("__nth")
    runs_ = told.where("__s").withColumn("n", n).withColumn("run", F.row_number().over(w).cast("long"))
    # rows without a place come first: their run has one if it goes on behind them
    first = F.when(F.col("pos").isNotNull(), F.col("pos")).when(F.col("__nth") + F.col("n") - 1 > F.col("__all") - F.col("__placed"), F.col("__least"))
    return runs_.select("doc", "run", value, first.alias("first"), "n")


def lookup(sections: DataFrame, asked: str) -> DataFrame:
    """The sections of each document that ``asked`` names: ``sections(doc, pos, number, anchor, title, is_appendix)``.

    The one whose number it is, however announced; else the one whose anchor it is; else all whose title has
    its words; nothing asked lists all. An appendix word prefers an appendix, and with a number like a
    section's finds nothing else. Which of these applies is found for each document by its own sections.
    """
    words = asked.lower().replace("§", "§ ").split()
    if not words:
        return sections
    said = [w.strip(".") for w in words]
    n = next((i for i, w in enumerate(said) if w not in ANNOUNCING), len(said))
    number = " ".join(words[n:]).strip(".")
    appendix = any(w in APPENDIX for w in said[:n])
    by_number = (F.lower("number") == number) if number else F.lit(False)
    if appendix and number[:1].isdigit():
        by_number = by_number & F.col("is_appendix")
    anchored = F.col("anchor") == asked.strip()
    titled = F.lit(True)
    for w in words:
        titled = titled & F.contains(F.lower("title"), F.lit(w))
    # the smallest order of a document wins; of numbers and anchors the first one alone
    order = F.when(by_number & (F.col("is_appendix") == F.lit(appendix)), 0).when(by_number, 1).when(anchored, 2).when(titled, 3)
    found = sections.withColumn("__order", order).where("__order is not null")
    w = Window.partitionBy("doc")
    best = found.withColumn("__best", F.min("__order").over(w)).where("__order = __best").withColumn("__nth", F.row_number().over(w.orderBy("pos")))
    return best.where("__order = 3 or __nth = 1").drop("__order", "__best", "__nth")


def outline(sections: DataFrame, asked: str, context: bool = True) -> DataFrame:
    """(doc, pos, is_match): sections of ``sections(doc, pos, number, title)`` that match, and what they are below.

    A title matches that has the text, a number that starts with it. Sections above a match are listed as
    context, found by the numbers above its own: one row a level and match, then one join.
    """
    low = asked.lower().strip()
    match = F.contains(F.lower("title"), F.lit(low)) | F.lower("number").startswith(low)
    found = sections.where(match).select("doc", "pos", F.lit(True).alias("is_match"))
    if not context:
        return found
    parts = F.split("number", r"\.")
    above = sections.where(match & F.col("number").isNotNull()).select("doc", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda k: F.array_join(F.slice(parts, 1, k), "."))).alias("number")).distinct()
    both = found.unionByName(sections.join(above, ["doc", "number"], "left_semi").select("doc", "pos", F.lit(False).alias("is_match")))
    return both.groupBy("doc", "pos").agg(F.max("is_match").alias("is_match"))


def anchor_set(sections: DataFrame, blocks: DataFrame, entries: DataFrame) -> DataFrame:
    """(doc, anchor): every anchor of a document, of whichever table."""
    return sections.select("doc", "anchor").unionByName(blocks.select("doc", "anchor")).unionByName(entries.select("doc", "anchor")).where("anchor is not null").distinct()


def merged_headers(documents: DataFrame, catalogue: DataFrame, taken: tuple[str, ...]) -> DataFrame:
    """``documents(number, stated, ...)`` with the columns ``taken`` as the catalogue has them, and ``note``.

    The catalogue's values replace the document's, null ones too. A document that states another number
    than its file's gets a note; one that the catalogue lacks goes.
    """
    kept = [c for c in documents.columns if c not in taken]
    note = F.when(F.col("stated") != F.col("number"), F.concat(F.lit("states "), F.col("stated").cast("string")))
    return documents.select(*kept).join(catalogue.select("number", *taken), "number").withColumn("note", note)


def document_report(lines: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_blank, n_chars, longest, n_headings): one row a document."""
    blank = F.trim("line") == ""
    return lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(blank).alias("n_blank"), F.sum(F.length("line")).alias("n_chars"), F.max(F.length("line")).alias("longest"),
        F.count_if(F.col("line").rlike(r"^\d+(\.\d+)*\.?\s+\S")).alias("n_headings"),
    )


def furthest(states: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """(key, stage): of each key's states the one furthest in ``order``; unknown ones don't count."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("state"))
    return states.where(place > 0).groupBy(key).agg(F.max(place).alias("p")).select(key, F.element_at(F.array(*map(F.lit, order)), F.col("p").cast("int")).alias("stage"))


def leaders(people: DataFrame, group: str, role: str = "chair") -> DataFrame:
    """(group, n, names): who has a role in each group, by name."""
    return people.where(F.col("role") == role).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("name")).alias("names"))
