"""Alignment of sections between revisions: weighted words, cosine, best matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import alignment_words

KEEP, FLOOR = 0.3, 0.1


def term_vectors(sections: DataFrame) -> DataFrame:
    """(pair, side, sec, term, w): unit tf-idf vectors of ``sections(pair, side, sec, body)``.

    A pair is two documents; idf is ln(1 + n / df) over the sections of both.
    """
    terms = sections.select("pair", "side", "sec", F.explode(alignment_words(F.col("body"))).alias("term")).groupBy("pair", "side", "sec", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = terms.groupBy("pair", "term").agg(F.count(F.lit(1)).alias("df"))
    n = sections.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    weighed = terms.join(df, ["pair", "term"]).join(n, "pair").select("pair", "side", "sec", "term", (F.col("tf") * F.ln(1 + F.col("n") / F.col("df"))).alias("w"))
    norms = weighed.groupBy("pair", "side", "sec").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighed.join(norms, ["pair", "side", "sec"]).select("pair", "side", "sec", "term", (F.col("w") / F.col("norm")).alias("w"))


def candidates(sections: DataFrame, title: float = 0.4) -> DataFrame:
    """(pair, old, new, score): sections that share a term, scored by title words and prose.

    ``sections(pair, side ('old' or 'new'), sec, pos, title, body)``. Prose below the floor makes
    a score of 0; without titles on both sides the prose is all. Pairs come from equal terms only,
    never from all sections by all.
    """
    v = term_vectors(sections)
    old, new = v.where("side = 'old'"), v.where("side = 'new'")
    dots = (
        old.select("pair", F.col("sec").alias("old"), "term", F.col("w").alias("w1"))
        .join(new.select("pair", F.col("sec").alias("new"), "term", F.col("w").alias("w2")), ["pair", "term"])
        .groupBy("pair", "old", "new")
        .agg(F.sum(F.col("w1") * F.col("w2")).alias("prose"))
    )
    names = sections.select("pair", "side", "sec", "pos", F.array_distinct(alignment_words(F.coalesce("title", F.lit("")))).alias("words"))
    o = names.where("side = 'old'").select("pair", F.col("sec").alias("old"), F.col("words").alias("t1"), F.col("pos").alias("p1"))
    n = names.where("side = 'new'").select("pair", F.col("sec").alias("new"), F.col("words").alias("t2"), F.col("pos").alias("p2"))
    both = dots.join(o, ["pair", "old"]).join(n, ["pair", "new"])
    union = F.size(F.array_union("t1", "t2"))
    jaccard = F.when(union > 0, F.size(F.array_intersect("t1", "t2")) / union)
    score = F.when(F.col("prose") < FLOOR, 0.0).when(jaccard.isNull(), F.col("prose")).otherwise(title * jaccard + (1 - title) * F.col("prose"))
    return both.withColumn("score", score).withColumn("rank", F.col("score") - 1e-6 * F.abs(F.col("p1") - F.col("p2"))).select("pair", "old", "new", "prose", "score", "rank")


def aligned(found: DataFrame, keep: float = KEEP) -> DataFrame:
    """Candidates of at least ``keep`` that are the best of either side."""
    of_old = Window.partitionBy("pair", "old").orderBy(F.desc("rank"), "new")
    of_new = Window.partitionBy("pair", "new").orderBy(F.desc("rank"), "old")
    ranked = found.where(F.col("score") >= keep).withColumn("a", F.row_number().over(of_old)).withColumn("b", F.row_number().over(of_new))
    return ranked.where("a = 1 or b = 1").select("pair", "old", "new", "score")


def home_edge(found: DataFrame) -> DataFrame:
    """The best edge of each section over all pairs it is in; the first pair wins a tie."""
    w = Window.partitionBy("old").orderBy(F.desc("rank"), "pair")
    return found.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def similarity(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``jaccard`` of the alignment words of two text columns."""
    x, y = F.array_distinct(alignment_words(F.col(a))), F.array_distinct(alignment_words(F.col(b)))
    union = F.size(F.array_union(x, y))
    return pairs.withColumn("jaccard", F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(F.lit(0.0)))
