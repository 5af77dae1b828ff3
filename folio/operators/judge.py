"""Scores against judgments: precision and recall, ranks, judgment sets, comparisons of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_words


def bag_match(found: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tp, fp, fn): multisets held against each other, key by key."""
    f = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("f"))
    e = expected.groupBy(*keys).agg(F.count(F.lit(1)).alias("e"))
    both = f.join(e, keys, "full").withColumns({"f": F.coalesce("f", F.lit(0)), "e": F.coalesce("e", F.lit(0))})
    tp = F.least("f", "e")
    return both.select(*keys, tp.alias("tp"), (F.col("f") - tp).alias("fp"), (F.col("e") - tp).alias("fn"))


def precision_recall(matched: DataFrame, by: list[str]) -> DataFrame:
    """Sums of tp, fp and fn with precision and recall; null where there is nothing to divide by."""
    sums = matched.groupBy(*by).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    ratio = lambda d: F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col(d)).cast("double"))
    return sums.withColumn("precision", ratio("fp")).withColumn("recall", ratio("fn"))


def mean_reciprocal_rank(ranked: DataFrame, at: int = 10) -> DataFrame:
    """One row: queries, mean of 1/rank (0 where nothing is found), share within ``at``. ``ranked(query, rank)``."""
    rank = F.col("rank").cast("double")
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(1 / rank, F.lit(0.0))).alias("mrr"), F.avg(F.coalesce((rank <= at).cast("double"), F.lit(0.0))).alias("share_in_top"))


def judgment_set(candidates: DataFrame, text: str, guards: dict[str, Column], least_words: int = 8) -> DataFrame:
    """``candidates`` with ``dropped``: the first guard that refuses each, ``short``, ``repeated``, or null if it stays.

    Repeats have the same first 120 characters of their sorted content words; the one of the
    smallest id stays. ``candidates(id, ...)``.
    """
    words = content_words(F.col(text))
    reason = F.lit(None).cast("string")
    for name, refuses in reversed(guards.items()):
        reason = F.when(refuses, F.lit(name)).otherwise(reason)
    reason = F.coalesce(reason, F.when(F.size(words) < least_words, F.lit("short")))
    key = F.substring(F.concat_ws(" ", F.array_sort(words)), 1, 120)
    marked = candidates.withColumn("dropped", reason).withColumn("near", key)
    # only candidates that stay so far meet by key, and of a key only its smallest id moves on
    first = marked.where("dropped is null").groupBy("near").agg(F.min("id").alias("__first"))
    near = F.when(F.col("dropped").isNull(), F.col("near"))
    met = marked.withColumn("near", near).join(first, "near", "left")
    return met.withColumn("dropped", F.when(F.col("dropped").isNull() & (F.col("id") != F.col("__first")), "repeated").otherwise(F.col("dropped"))).drop("near", "__first")


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 11) -> DataFrame:
    """``n`` rows in a hashed order: the same on any cluster."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def regressions(before: DataFrame, after: DataFrame, key: str, ok: str) -> DataFrame:
    """(key, change): keys that stopped or started being ok; keys of one report only are none."""
    both = before.select(key, F.col(ok).alias("was")).join(after.select(key, F.col(ok).alias("now")), key)
    return both.where("was != now").select(key, F.when(F.col("was"), "stopped").otherwise("started").alias("change"))


def may_publish(previous: DataFrame, following: DataFrame, least: int = 10) -> bool:
    """False if a table of at least ``least`` rows would shrink below half."""
    n = previous.count()
    return n < least or 2 * following.count() >= n


def cause_counts(rows: DataFrame, causes: str) -> DataFrame:
    """(cause, n, n_only): rows for each cause, and rows for which it is the only one."""
    return rows.select(F.explode(F.array_distinct(causes)).alias("cause"), (F.size(F.array_distinct(causes)) == 1).alias("only")).groupBy("cause").agg(F.count(F.lit(1)).alias("n"), F.count_if("only").alias("n_only"))


def reciprocal_ranks(items: DataFrame, docs: DataFrame, is_answer: Column, k: int = 50, rare: int = 12, share: float = 0.05) -> DataFrame:
    """(query, rank): the rank, by shared words, of the first of the ``k`` best documents that ``is_answer`` holds for; null without.

    ``items(query, w, wanted)`` and ``docs(doc_id, w, text)`` with distinct words ``w``. An item is looked up by
    its ``rare`` rarest words, none of them in more than ``share`` of the documents, so that no common word joins
    all with all. An item's best documents are kept by a partial aggregation.
    """
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    words = items.select("query", F.explode("w").alias("word"))
    held = docs.select("doc_id", F.explode("w").alias("word")).join(words.select("word").distinct(), "word", "left_semi")
    df = held.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    # one row of one number
    rarest = words.join(df, "word").join(F.broadcast(n)).where(F.col("df") <= F.greatest(F.lit(1), F.col("n") * share))
    asked = rarest.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("df", "word"))), 1, rare).alias("r")).select("query", F.explode("r.word").alias("word"))
    shared = asked.join(held, "word").groupBy("query", "doc_id").agg(F.count(F.lit(1)).alias("shared"))
    found = best_of(shared, k).join(items.select("query", "wanted"), "query").join(docs.select("doc_id", "text"), "doc_id").where(is_answer).groupBy("query").agg(F.min("rank").alias("rank"))
    return items.select("query").join(found, "query", "left")


def best_of(scored: DataFrame, k: int) -> DataFrame:
    """(query, doc_id, rank): the ``k`` documents of each query with the most shared words, then the smallest id.

    First in parts of each query's documents, then over the parts' best: no task has all documents of a query.
    """
    order = [F.desc("shared"), F.asc("doc_id")]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(16))
    some = scored.withColumn("part", part).withColumn("nth", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).where(F.col("nth") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k).select("query", "doc_id", "rank")


def worst_first(scores: DataFrame, key: str = "doc") -> DataFrame:
    """``scores(key, fp, fn)`` with errors, the most first, then by key."""
    return scores.withColumn("errors", F.col("fp") + F.col("fn")).orderBy(F.desc("errors"), key)
