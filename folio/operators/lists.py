"""Library lists: ordered lookups, unions where the first source wins, orders, evictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold
from ..sources.tables import cut


def series_rows(series: DataFrame, catalogue: DataFrame, id_col: str, title_col: str) -> DataFrame:
    """A row for each series: its members that the catalogue has, in the series' order, and the newest."""
    members = series.select("id", "name", F.posexplode("members").alias("pos", "member"))
    known = catalogue.select(F.col(id_col).alias("member"), F.col(title_col).alias("title"))
    listed = F.array_sort(F.collect_list(F.struct("pos", "member", "title")))
    return members.join(known, "member").groupBy("id", "name").agg(listed.alias("m"), F.max("member").alias("newest")).select("id", "name", F.transform("m", lambda x: x["title"]).alias("titles"), F.size("m").alias("n"), "newest")


def in_given_order(ids: DataFrame, catalogue: DataFrame, key: str) -> DataFrame:
    """Rows of ``ids(pos, key)`` that the catalogue has, each with its pos; misses go."""
    return ids.join(catalogue, key)


def narrowed(rows: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """``rows`` whose key is allowed, with the rank they had."""
    return rows.join(allowed.select(key).distinct(), key, "left_semi")


def union_first(sources: list[DataFrame], key: str, order: str) -> DataFrame:
    """Union of ``sources(key, order, ...)``: for each key the row of the first source that has it.

    The result has ``source`` (from 0); within one source the smallest ``order`` wins.
    """
    tagged = [df.withColumn("source", F.lit(i)) for i, df in enumerate(sources)]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    columns = [c for c in out.columns if c != key]
    return out.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct("source", order)).alias("best")).select(key, "best.*")


def latest(rows: DataFrame, keys: list[str], newest: list[Column]) -> DataFrame:
    """The row of each key with the largest ``newest``, a unique one at the end; rows are combined before they move."""
    columns = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*columns), F.struct(*newest))
    return rows.groupBy(*keys).agg(best.alias("best")).select(*keys, "best.*")


def newest_first(rows: DataFrame, number: str = "number") -> DataFrame:
    """``rows(year, month, day, number)`` with ``rank`` from 1, the newest first.

    By date, in which a missing month or day comes before any other, then by number. One sort.
    """
    date = [F.col(c).desc_nulls_last() for c in ("year", "month", "day")]
    return placed(rows, [*date, F.desc(number)])


def oldest_first(rows: DataFrame, number: str = "number") -> DataFrame:
    """The same order turned round."""
    return placed(rows, [*(F.col(c).asc_nulls_first() for c in ("year", "month", "day")), F.asc(number)])


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with their place in one order, ranked part by part: parts are ranges of the order, so no task has all rows.

    A part's first rank comes from the counts of the parts before it, one number a part.
    """
    dealt = cut(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    # a row a part
    return dealt.withColumn("__w", within).join(F.broadcast(before), "__part").withColumn("rank", F.col("__before") + F.col("__w")).drop("__part", "__w", "__before")


def at_best_hit(hits: DataFrame, series: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(rank, id, series): hits in order, each series right after its first member that is a hit.

    ``hits(id, rank)``, ``series(series, member)``; of the hits themselves only those in ``allowed(id)``.
    Ranks are new, from 1, by the hit's rank, the hit before its series, then the series' id.
    """
    own = hits if allowed is None else hits.join(allowed.select("id").distinct(), "id", "left_semi")
    found = series.join(hits.withColumnRenamed("id", "member"), "member").groupBy("series").agg(F.min("rank").alias("rank"))
    both = own.select("rank", F.col("id"), F.lit(None).cast(series.schema["series"].dataType).alias("series")).unionByName(found.select("rank", F.lit(None).cast(hits.schema["id"].dataType).alias("id"), "series"))
    return placed(both.withColumnRenamed("rank", "hit"), [F.asc("hit"), F.asc_nulls_first("series")]).select("rank", "id", "series")


def quick_open(exact: DataFrame, registry: DataFrame, hits: DataFrame, limit: int = 8) -> DataFrame:
    """The exact answer, then registries, then hits that neither names: at most ``limit``, with their rank. Each ``(id, ord)``."""
    every = union_first([exact, registry, hits], "id", "ord")
    order = [F.asc("source"), F.asc("ord"), F.asc("id")]
    return every.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("rank", "id", "source")


def pinned(sources: list[DataFrame], open_: DataFrame, members: DataFrame, key: str = "id") -> DataFrame:
    """Ids that must stay: all of ``sources(id)`` and of ``open_``, where a series stands for its ``members(id, member)``."""
    named = sources[0].select(key)
    for df in sources[1:]:
        named = named.unionByName(df.select(key))
    inside = named.join(members, key, "left").select(F.coalesce("member", key).alias(key))
    return inside.unionByName(open_.select(key)).distinct()


def last_read(rows: DataFrame, read: DataFrame, key: str) -> DataFrame:
    """``rows(key, pos)`` with ``read_at`` from ``read(key, read_at)`` and rank: read ones newest first, unread last in their order."""
    return placed(rows.join(read, key, "left"), [F.col("read_at").desc_nulls_last(), F.asc("pos")])


def year_sections(rows: DataFrame) -> DataFrame:
    """``rows(year, pos)`` grouped by year: n, and the place of the year's first row, which orders the groups."""
    return rows.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))


def victims(sizes: DataFrame, bound: int, owner: str = "owner") -> DataFrame:
    """What to evict for each owner: oldest first, by (opened, id), until what is left fits ``bound``.

    ``sizes(owner, id, opened, bytes, pinned)``. Pinned ones stay but count. An item goes if what was
    removed before it leaves the total over the bound.
    """
    w = Window.partitionBy(owner)
    running = w.orderBy("opened", "id").rowsBetween(Window.unboundedPreceding, -1)
    totals = sizes.withColumn("total", F.sum("bytes").over(w)).where("not pinned")
    before = F.coalesce(F.sum("bytes").over(running), F.lit(0))
    return totals.withColumn("gone", before).where(F.col("total") - F.col("gone") > bound).select(owner, "id", "bytes")


def hiding(rows: DataFrame, options: dict[str, Column]) -> DataFrame:
    """Why a list is empty: rows in all, rows shown, and for each option the rows shown without it."""
    every = F.lit(True)
    for keep in options.values():
        every = every & keep
    aggs = [F.count(F.lit(1)).alias("n_all"), F.count_if(every).alias("n_shown")]
    for name in options:
        rest = F.lit(True)
        for other, keep in options.items():
            if other != name:
                rest = rest & keep
        aggs.append(F.count_if(rest).alias(f"without_{name}"))
    return rows.agg(*aggs)


def renumbered(items: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``position`` from 0 in each group's order."""
    return items.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)


def index_groups(rows: DataFrame, title: str, key: str = "number") -> DataFrame:
    """``label``, the title's first letter A to Z or ``#``, and ``rank``: letters first, then by folded title, then by key."""
    first = F.upper(F.substring(fold(F.col(title)), 1, 1))
    labelled = rows.withColumn("label", F.when(first.rlike("^[A-Z]$"), first).otherwise("#"))
    return placed(labelled.withColumn("__title", fold(F.col(title))), [F.asc(F.col("label") == "#"), F.asc("label"), F.asc("__title"), F.asc(key)]).drop("__title")
