"""Metadata search: weighted relevance, number queries, counts over filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import document_id, fold, title_words

#: Points a term earns, by where it is found.
NUMBER, NUMBER_PREFIX = 100, 40
TITLE, TITLE_WORD, TITLE_PART = 90, 60, 45
KEYWORD, KEYWORD_PART = 50, 30
GROUP, AUTHOR_PART, ABSTRACT_PART = 55, 35, 15
PHRASE, OBSOLETE, STANDARD = 50, -10, 5


def _optional(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def scored(catalogue: DataFrame, query: str, standards: tuple[str, ...] = ()) -> DataFrame:
    """Rows on which every term of ``query`` is found, with ``score``; all rows by number without terms.

    Columns: number and title; keywords, group, authors, abstract and is_obsolete where present.
    A term's points are the best of its places, an abstract counting only where nothing else does.
    """
    terms = query.lower().split()
    if not terms:
        return catalogue.withColumn("score", F.col("number").cast("long"))
    number, title = F.col("number").cast("string"), fold(F.col("title"))
    words = title_words(F.col("title"))
    keywords = F.transform(_optional(catalogue, "keywords", "array<string>"), fold)
    group, authors = fold(_optional(catalogue, "group", "string")), F.transform(_optional(catalogue, "authors", "array<string>"), fold)
    abstract = fold(_optional(catalogue, "abstract", "string"))

    def points(term: str) -> Column:
        t = F.lit(term)
        best = F.greatest(
            F.when(number == t, NUMBER).when(number.startswith(term), NUMBER_PREFIX).otherwise(0),
            F.when(title == t, TITLE).when(F.array_contains(words, t), TITLE_WORD).when(F.contains(title, t), TITLE_PART).otherwise(0),
            F.when(F.array_contains(keywords, t), KEYWORD).when(F.exists(keywords, lambda k: F.contains(k, t)), KEYWORD_PART).otherwise(0),
            F.when(group == t, GROUP).otherwise(0),
            F.when(F.exists(authors, lambda a: F.contains(a, t)), AUTHOR_PART).otherwise(0),
        )
        return F.when(best > 0, best).when(F.contains(abstract, t), ABSTRACT_PART).otherwise(0)

    each = [points(t) for t in terms]
    bonus = F.lit(0)
    if len(terms) > 1:
        bonus = bonus + F.when(F.contains(title, F.lit(" ".join(terms))), PHRASE).otherwise(0)
    if "is_obsolete" in catalogue.columns:
        bonus = bonus + F.when(F.col("is_obsolete"), OBSOLETE).otherwise(0)
    if standards:
        bonus = bonus + F.when(F.col("status").isin(list(standards)), STANDARD).otherwise(0)
    found = catalogue.withColumn("points", F.array(*each)).where(F.forall("points", lambda p: p > 0))
    return found.withColumn("score", (F.aggregate("points", F.lit(0), lambda a, p: a + p) + bonus).cast("long")).drop("points")


def top(found: DataFrame, limit: int = 100) -> DataFrame:
    """The best rows: score, then number, both descending."""
    return found.orderBy(F.desc("score"), F.desc("number")).limit(limit)


def by_number(catalogue: DataFrame, digits: str, limit: int = 100) -> DataFrame:
    """Documents whose number starts with ``digits``: the exact one, then the newest."""
    text = F.col("number").cast("string")
    return catalogue.where(text.startswith(digits)).withColumn("exact", text == digits).orderBy(F.desc("exact"), F.desc("number")).limit(limit)


def looked_up(queries: DataFrame, catalogue: DataFrame, series: DataFrame) -> DataFrame:
    """(query, how, pos, number): the documents that each of ``queries(query)`` names.

    A number in any spelling names that document alone (``document``), a series its members that the catalogue has,
    in their order (``series``, of ``series(series, id, members)``). Anything else, a number that nothing has included,
    is for a search (``words``): one row without a number.
    """
    asked = queries.distinct().withColumn("id", document_id(F.col("query")))
    known = catalogue.select("number").distinct()
    is_number = F.col("id.series") == "RFC"
    met = asked.join(known, is_number & (F.col("id.number") == F.col("number")), "left")
    held = series.select(F.col("series").alias("__series"), F.col("id").alias("__id"), "members")
    met = met.join(held, (F.col("id.series") == F.col("__series")) & (F.col("id.number") == F.col("__id")), "left")
    how = F.when(F.col("number").isNotNull(), "document").when(F.col("members").isNotNull(), "series").otherwise("words")
    told = met.withColumn("how", how)
    alone = told.where("how != 'series'").select("query", "how", F.lit(0).alias("pos"), "number")
    members = told.where("how = 'series'").select("query", "how", F.posexplode("members").alias("pos", "member"))
    return alone.unionByName(members.join(known, F.col("member") == F.col("number")).select("query", "how", "pos", "number"))


def group_counts(catalogue: DataFrame, last: str | None = None) -> DataFrame:
    """Rows by group, most first, then by name; the group ``last`` comes at the end whatever its count."""
    counts = catalogue.where("`group` is not null").groupBy(fold(F.col("group")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("name") == F.lit(last or ""), F.desc("n"), "name")


def filter_counts(catalogue: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows in all and by each value of each column, in one pass: dimension, value, n."""
    pairs = [F.struct(F.lit("all").alias("dimension"), F.lit("").alias("value"))]
    pairs += [F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns]
    return catalogue.select(F.explode(F.array(*pairs)).alias("g")).where("g.value is not null").groupBy("g.dimension", "g.value").agg(F.count(F.lit(1)).alias("n"))


def group_card(catalogue: DataFrame) -> DataFrame:
    """By group: documents, obsolete ones, first and last year."""
    return catalogue.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_obsolete").alias("n_obsolete"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
