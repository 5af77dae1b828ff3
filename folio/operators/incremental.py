"""Incremental work in batches: plans, baselines and their events, scans that carry over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plan(held: DataFrame, wanted: DataFrame, key: str, version: str) -> DataFrame:
    """(key, action): add, remove, replace or keep, from what is held and what is wanted."""
    both = held.select(key, F.col(version).alias("h"), F.lit(True).alias("in_h")).join(wanted.select(key, F.col(version).alias("w"), F.lit(True).alias("in_w")), key, "full")
    action = F.when(F.col("in_h").isNull(), "add").when(F.col("in_w").isNull(), "remove").when(F.col("h").eqNullSafe(F.col("w")), "keep").otherwise("replace")
    return both.select(key, action.alias("action"))


def baseline_events(before: DataFrame, after: DataFrame, key: str, sets: list[str]) -> DataFrame:
    """(key, kind, item): what each set of a key has gained; keys without a baseline give no events.

    A null set in ``after`` is a source that was missing, and gives none.
    """
    both = before.select(key, *[F.col(s).alias(f"{s}_0") for s in sets]).join(after.select(key, *sets), key)

    def gained(name: str):
        none = F.array().cast(after.schema[name].dataType)
        new = F.coalesce(F.array_except(name, F.coalesce(f"{name}_0", none)), none)
        return F.transform(new, lambda x: F.struct(F.lit(name).alias("kind"), x.cast("string").alias("item")))

    news = [gained(s) for s in sets]
    return both.select(key, F.explode(F.concat(*news)).alias("e")).select(key, "e.kind", "e.item")


def carried(listed: DataFrame, readings: DataFrame, previous: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, origin): each listed key with its new reading, else what it had; unlisted ones go."""
    new = readings.select(key, F.col(value).alias("new"))
    old = previous.select(key, F.col(value).alias("old"))
    out = listed.select(key).join(new, key, "left").join(old, key, "left")
    return out.select(key, F.coalesce("new", "old").alias(value), F.when(F.col("new").isNotNull(), "read").when(F.col("old").isNotNull(), "carried").otherwise("none").alias("origin"))


def verified(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, failure): missing, extra, size or hash, of ``(path, bytes, sha256)`` tables."""
    m = manifest.select("path", F.col("bytes").alias("b1"), F.col("sha256").alias("h1"))
    f = files.select("path", F.col("bytes").alias("b2"), F.col("sha256").alias("h2"))
    failure = F.when(F.col("h2").isNull(), "missing").when(F.col("h1").isNull(), "extra").when(F.col("b1") != F.col("b2"), "size").when(F.col("h1") != F.col("h2"), "hash")
    return m.join(f, "path", "full").select("path", failure.alias("failure")).where("failure is not null")
