"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic). Each dimension has target shares of the tokens
to keep; where a value has fewer tokens than its share, it keeps what it has and the others share the
rest. Raking scales the cells' weights to each dimension's targets in turn, never over what a cell
has, until the largest residual is small. Documents are then sampled, each by its cell's calibrated
probability and its own hashed number, so that a result can be repeated on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, decided, row_key

DIMENSIONS = ("source", "lang", "topic")
#: Columns of what raking reached.
MET = tuple(f"{d}_{what}" for d in DIMENSIONS for what in ("target", "share"))
#: Targets are the tokens' own shares raised to this power and scaled: below 1, small groups gain.
TEMPERATURE = 0.7
#: Expected part of all tokens that is kept.
BUDGET = 0.8
#: Rounds of raking at most, rounds between written tables, and the residual (a share of the kept tokens) that ends it.
ROUNDS, ROUNDS_A_TABLE, RESIDUAL = 24, 4, 1e-3


def topic_of(text: Column) -> Column:
    """A document's topic by form: numbers, lists, long, short or plain prose. Null is an empty text."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    lines = F.length(t) - F.length(F.translate(t, "\n", "")) + 1
    digits = n - F.length(F.translate(t, "0123456789", ""))
    return (
        F.when(n == 0, "empty")
        .when(digits * 20 > n, "numbers")
        .when(lines * 60 > n, "lists")
        .when(n < 600, "short")
        .when(n > 6000, "long")
        .otherwise("prose")
    )


def tokens_of(text: Column) -> Column:
    """A document's tokens as runs other than white space, at least one."""
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+"))).cast("double")


def feasible_targets(cells: DataFrame, dim: str, budget: float, scratch: Scratch, temperature: float = TEMPERATURE, shares: DataFrame | None = None) -> DataFrame:
    """(key, target): the tokens that each value of ``dim`` should keep; they add up to the budget.

    ``shares(key, target)`` or else the tempered own ones; values that ``shares`` lacks have their own
    share of the tokens. Where a share is more than a value has, the value keeps all it has and what is
    left goes to the others in proportion: a least factor that fills the budget is found by its fixed
    point, a few sums of one row each.
    """
    own = cells.groupBy(F.col(dim).alias("key")).agg(F.sum("tokens").alias("own"))
    if shares is None:
        own = own.withColumn("share", F.pow("own", F.lit(temperature)))
    else:
        given = shares.select(F.col("key").alias("__key"), F.col("target").alias("share"))
        whole = cells.agg(F.sum("tokens").alias("w")).first()["w"] or 1.0
        own = own.join(given, F.col("key").eqNullSafe(F.col("__key")), "left").select("key", "own", F.coalesce("share", F.col("own") / whole).alias("share"))
    own = scratch.save(own, f"own-{dim}")
    total = own.agg(F.sum("own").alias("o"), F.sum("share").alias("s")).first()
    aim = (total["o"] or 0.0) * budget
    factor = aim / total["s"] if total["s"] else 0.0
    while True:
        full = F.col("own") <= F.col("share") * factor
        r = own.agg(F.sum(F.when(full, F.col("own")).otherwise(0.0)).alias("held"), F.sum(F.when(full, 0.0).otherwise(F.col("share"))).alias("open")).first()
        if not r["open"] or (new := (aim - r["held"]) / r["open"]) <= factor * (1 + 1e-12):
            return own.select("key", F.least("own", F.col("share") * factor).alias("target"))
        factor = new


def raked(cells: DataFrame, scratch: Scratch, targets: dict[str, DataFrame], budget: float = BUDGET, rounds: int = ROUNDS, residual: float = RESIDUAL) -> DataFrame:
    """``cells(source, lang, topic, tokens)`` with ``weight``, the tokens to keep of each.

    ``targets`` has each dimension's (key, target) in tokens. A step scales the cells of each value to
    its target by one window sum, and caps them at what they have; a capped value is scaled again by
    the next round. Every few rounds the table is written and the residual looked at; raking goes on
    until it is small, or for ``rounds``. Each dimension's target and share of the kept tokens come with
    the cells as ``<dimension>_target`` and ``<dimension>_share``, so what was not met can be seen; both
    are null where nothing is kept.
    """
    live = cells.withColumn("weight", F.col("tokens") * budget)
    for dim in DIMENSIONS:
        aims = targets[dim].select(F.col("key").alias("__key"), F.col("target").alias(f"__{dim}"))
        live = live.join(aims, F.col(dim).eqNullSafe(F.col("__key")), "left").drop("__key")
    live = scratch.save(live, "rake0")
    for turn in range(0, rounds, ROUNDS_A_TABLE):
        for _ in range(min(ROUNDS_A_TABLE, rounds - turn)):
            for dim in DIMENSIONS:
                s = F.sum("weight").over(Window.partitionBy(dim))
                live = live.withColumn("weight", F.least("tokens", F.when(s > 0, F.col("weight") * F.col(f"__{dim}") / s).otherwise(0.0)))
        live = scratch.save(live, f"rake{turn + ROUNDS_A_TABLE}")
        worst = reached(live).agg(F.max("residual").alias("r")).first()["r"]
        if worst is None or worst <= residual:
            break
    # one row of one number
    live = live.join(F.broadcast(live.agg(F.sum("weight").alias("__whole"))))
    part = lambda c: F.try_divide(c, F.col("__whole"))
    met = [c for d in DIMENSIONS for c in (part(F.col(f"__{d}")).alias(f"{d}_target"), part(F.sum("weight").over(Window.partitionBy(d))).alias(f"{d}_share"))]
    return live.select(*DIMENSIONS, "tokens", "weight", *met)


def reached(live: DataFrame) -> DataFrame:
    """(dimension, value, target, share, residual) of raked cells with their targets: shares of the kept tokens."""
    aims = [F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value"), F.col(f"__{d}").alias("aim")) for d in DIMENSIONS]
    sums = live.select(F.explode(F.array(*aims)).alias("a"), "weight").groupBy("a.dimension", "a.value").agg(F.max("a.aim").alias("aim"), F.sum("weight").alias("kept"))
    whole = live.agg(F.sum("weight").alias("whole"))
    # one row of one number
    share = lambda c: F.try_divide(F.col(c), F.col("whole"))
    return sums.join(F.broadcast(whole)).select("dimension", "value", share("aim").alias("target"), share("kept").alias("share"), F.abs(share("aim") - share("kept")).alias("residual"))


def mixed(
    docs: DataFrame,
    targets: dict[str, DataFrame] | None = None,
    budget: float = BUDGET,
    temperature: float = TEMPERATURE,
    seed: int = 7,
    rounds: int = ROUNDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    topic: Column | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, lang, topic, tokens, probability, sampled, each dimension's
    target and share of the kept tokens as raking left them (for the row's own source, language and
    topic: ``source_target``, ``source_share`` and so on), row_key.

    ``targets`` may give a dimension's (key, target) shares. Nulls in source, language or text are
    groups of their own (an empty text has one token). A document is sampled if its hashed id and text
    fall under its cell's probability, so equal rows go or stay together and others don't. With one
    cell, all have the budget's probability. An empty table gives no rows. Other columns play no
    part. Values whose target is more than they have are kept whole, and the others make up for them.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    text = F.col(f"`{text_col}`").cast("string")
    own_id = F.col(f"`{id_col}`").cast("long")
    rows = docs.select(
        own_id.alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        (topic_of(text) if topic is None else topic.cast("string")).alias("topic"),
        tokens_of(text).alias("tokens"),
        row_key(own_id, text, F.col("source"), F.col("lang")).alias("row_key"),
        F.xxhash64(own_id, text, F.lit(seed)).alias("draw"),
    )
    rows = scratch.save(rows, "rows")
    cells = scratch.save(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    aims = {dim: scratch.save(feasible_targets(cells, dim, budget, scratch, temperature, (targets or {}).get(dim)), f"target-{dim}") for dim in DIMENSIONS}
    weights = raked(cells, scratch, aims, budget, rounds)
    chances = weights.select(*(F.col(d).alias(f"__{d}") for d in DIMENSIONS), F.least(F.lit(1.0), F.col("weight") / F.col("tokens")).alias("probability"), *MET)
    same = [F.col(d).eqNullSafe(F.col(f"__{d}")) for d in DIMENSIONS]
    part = F.shiftrightunsigned("draw", 11).cast("double") / float(1 << 53)
    return rows.join(chances, same).select("doc_id", *DIMENSIONS, F.col("tokens").cast("long").alias("tokens"), "probability", (part < F.col("probability")).alias("sampled"), *MET, "row_key")


def sampled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with all its columns, only those rows that the mixture samples."""
    left = mixed(docs, id_col=id_col, text_col=text_col, **how).where("not sampled").select("doc_id", "row_key").distinct()
    left = Scratch(docs.sparkSession, "mix-stage").save(left.select("doc_id", "row_key", F.lit(False).alias("keep"), F.lit(1).alias("n")), "left")
    key = row_key(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"), F.col("source"), F.col("lang"))
    return decided(docs, left, id_col, key)


def op3_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_key")
