"""Differences between revisions: words of two texts, sections of two documents."""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut, dealt

_TOKEN = re.compile(r"\s+|\S+")
#: Bits of one pass's table; longer pairs are halved first.
TABLE_BITS = 1 << 28


def _rows(x: list[int], y: list[int], keep: bool) -> list[int] | int:
    """Bit rows of the longest common subsequence of x's heads with y: a 0 at place j where it grows there."""
    where: dict[int, int] = {}
    for j, v in enumerate(y):
        where[v] = where.get(v, 0) | 1 << j
    every = (1 << len(y)) - 1
    row, rows = every, []
    for v in x:
        hit = row & where.get(v, 0)
        row = ((row + hit) | (row - hit)) & every
        if keep:
            rows.append(row)
    return rows if keep else row


def _pairs(x: list[int], y: list[int], i: int, j: int) -> list[tuple[int, int]]:
    """Places of one longest common subsequence, from (i, j) on."""
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    n, m = len(x) - tail, len(y) - tail
    out = [(i + k, j + k) for k in range(head)]
    x1, y1 = x[head:n], y[head:m]
    if x1 and y1:
        if len(x1) > 1 and len(x1) * len(y1) > TABLE_BITS:
            middle = len(x1) // 2
            down, up = _rows(x1[:middle], y1, False), _rows(x1[middle:][::-1], y1[::-1], False)
            grows_down = [0]
            for k in range(len(y1)):
                grows_down.append(grows_down[-1] + (not down >> k & 1))
            grows_up = [0]
            for k in range(len(y1)):
                grows_up.append(grows_up[-1] + (not up >> k & 1))
            split = max(range(len(y1) + 1), key=lambda k: grows_down[k] + grows_up[len(y1) - k])
            out += _pairs(x1[:middle], y1[:split], i + head, j + head) + _pairs(x1[middle:], y1[split:], i + head + middle, j + head + split)
        else:
            rows, found = _rows(x1, y1, True), []
            a, b = len(x1), len(y1)
            size = b - (rows[-1]).bit_count()
            while size:  # up while the row above has as many, then left to where the row grows
                if a > 1 and b - (rows[a - 2] & ((1 << b) - 1)).bit_count() == size:
                    a -= 1
                elif rows[a - 1] >> (b - 1) & 1:
                    b -= 1
                else:
                    a, b, size = a - 1, b - 1, size - 1
                    found.append((i + head + a, j + head + b))
            out += reversed(found)
    return out + [(i + n + k, j + m + k) for k in range(tail)]


def runs_of(old: str | None, new: str | None) -> list[dict[str, str]]:
    """Runs of kept, removed and added words; white space kept between two changes goes with them."""
    x, y = _TOKEN.findall(old or ""), _TOKEN.findall(new or "")
    ids: dict[str, int] = {}
    key = lambda t: ids.setdefault(" " if t.isspace() else t, len(ids))
    both = [*_pairs([key(t) for t in x], [key(t) for t in y], 0, 0), (len(x), len(y))]
    out: list[dict[str, str]] = []
    stretch: list[list[str]] = []  # of one stretch of changes: removed, added, kept between

    def close() -> None:
        gone, come = "".join(s[0] for s in stretch), "".join(s[1] for s in stretch)
        if gone.strip() and come.strip():
            out.extend(({"kind": "removed", "text": gone}, {"kind": "added", "text": come}))
        else:
            for s in stretch:
                if s[2]:
                    out.append({"kind": "same", "text": s[1]})
                else:
                    out.extend({"kind": k, "text": t} for k, t in (("removed", s[0]), ("added", s[1])) if t)
        stretch.clear()

    i = j = 0
    kept: list[str] = []

    def keep() -> None:
        """What was kept so far: into the stretch if it is white space between changes, else a run of its own."""
        text = "".join(kept)
        if stretch and text.isspace():
            stretch.append([text, text, "kept"])
        elif text:
            close()
            out.append({"kind": "same", "text": text})
        kept.clear()

    for a, b in both:
        if a > i or b > j:
            keep()
            stretch.append(["".join(x[i:a]), "".join(y[j:b]), ""])
        if a < len(x) or b < len(y):
            kept.append(y[b])
        i, j = a + 1, b + 1
    text = "".join(kept)
    close()
    if text:
        out.append({"kind": "same", "text": text})
    return out


def _word_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([runs_of(a, b) for a, b in zip(old, new)])


def word_diff():
    """The function of two text columns: runs of kept, removed and added words by a longest common subsequence.

    A run of white space is one token, equal to any other. Without removed runs the new text comes out,
    without added ones the old one but for kept white space, which is the new text's.
    """
    return F.pandas_udf(_word_diff, "array<struct<kind:string,text:string>>")


def revisions(turns: DataFrame) -> DataFrame:
    """(doc, revision, old, new): each revision beside the one before."""
    w = Window.partitionBy("doc").orderBy("revision")
    return turns.withColumn("old", F.lag("text").over(w)).where("old is not null").select("doc", "revision", "old", F.col("text").alias("new"))


def diff_counts(pairs: DataFrame) -> DataFrame:
    """(doc, revision, same, removed, added): characters of each kind."""
    d = pairs.withColumn("d", word_diff()("old", "new"))
    size = lambda kind: F.aggregate(F.filter("d", lambda x: x["kind"] == kind), F.lit(0), lambda n, x: n + F.length(x["text"]))
    return d.select("doc", "revision", size("same").alias("same"), size("removed").alias("removed"), size("added").alias("added"))


def longest_increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing run of ``values``; of equal ones that whose last values are least."""
    tails: list[int] = []
    least: list[int] = []
    before = [-1] * len(values)
    for at, v in enumerate(values):
        k = bisect_left(least, v)
        before[at] = tails[k - 1] if k else -1
        tails[k : k + 1], least[k : k + 1] = [at], [v]
    out, at = [], tails[-1] if tails else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def _left_out(orders: pd.Series) -> pd.Series:
    """For each document's places in the older order, by the newer one: which are outside its longest run in order; null stays null."""

    def of(values) -> list[bool] | None:
        if values is None:
            return None
        kept = set(longest_increasing(list(values)))
        return [i not in kept for i in range(len(values))]

    return orders.map(of)


def best_first(pairs: DataFrame) -> DataFrame:
    """(doc, a, b) of ``pairs(doc, a, b, rank)``, one to one: the pairs that stay when they are taken from the greatest rank down.

    Equal ranks go by a, then b. A round takes every pair that comes first for both its sides, and drops what touches
    it; such pairs are taken by the order from the top too, so the rounds end with the same pairs. A round is a written
    table, and rounds are few: each takes at least the best pair that is left of every document.
    """
    order = [F.desc("rank"), F.asc("a"), F.asc("b")]
    first = lambda side: F.row_number().over(Window.partitionBy("doc", side).orderBy(*order))
    left, taken = cut(pairs.where("doc is not null and rank is not null").groupBy("doc", "a", "b").agg(F.max("rank").alias("rank"))), None
    while not left.isEmpty():
        now = cut(left.withColumn("x", first("a")).withColumn("y", first("b")).where("x = 1 and y = 1").select("doc", "a", "b"))
        left = cut(left.join(now, ["doc", "a"], "left_anti").join(now, ["doc", "b"], "left_anti"))
        taken = now if taken is None else taken.unionByName(now)
    return left.select("doc", "a", "b") if taken is None else taken


def paired(old: DataFrame, new: DataFrame, aligned: DataFrame | None = None) -> DataFrame:
    """(doc, a, b): sections of the older document with their newer ones, one to one.

    By anchor and title; of what is left by ``aligned(doc, a, b, rank)``, the best pair first (see best_first); then
    by title alone where it is the only one on both sides; then by anchor. ``(doc, anchor, title, ...)``.
    """
    o = old.select("doc", F.col("anchor").alias("a"), F.coalesce("title", F.lit("")).alias("t1"))
    n = new.select("doc", F.col("anchor").alias("b"), F.coalesce("title", F.lit("")).alias("t2"))
    # each step's pairs are written, as the next reads them twice
    out = cut(o.join(n, (o["doc"] == n["doc"]) & (F.col("a") == F.col("b")) & (F.col("t1") == F.col("t2"))).select(o["doc"], "a", "b"))

    def rest():
        return o.join(out, ["doc", "a"], "left_anti"), n.join(out, ["doc", "b"], "left_anti")

    if aligned is not None:
        left, right = rest()
        both = aligned.join(left.select("doc", "a"), ["doc", "a"], "left_semi").join(right.select("doc", "b"), ["doc", "b"], "left_semi")
        out = out.unionByName(best_first(both.select("doc", "a", "b", "rank")))
    left, right = rest()
    single = lambda df, t, key: df.where(f"{t} != ''").groupBy("doc", F.col(t).alias("t")).agg(F.count(F.lit(1)).alias("m"), F.min(key).alias(key)).where("m = 1").drop("m")
    out = out.unionByName(cut(single(left, "t1", "a").join(single(right, "t2", "b"), ["doc", "t"]).select("doc", "a", "b")))
    left, right = rest()
    return out.unionByName(cut(left.select("doc", "a").join(right.select("doc", F.col("b"), F.col("b").alias("a")), ["doc", "a"]).select("doc", "a", "b")))


def section_changes(old: DataFrame, new: DataFrame, aligned: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """(doc, old_anchor, anchor, change, moved): added, removed, changed or same sections, and whether they moved.

    ``(doc, anchor, pos, body)`` on both sides, title where there are titles; see paired for which meet. Without
    titles and ``aligned`` that is one full join by anchor, and each side is read once. A section is moved if it is
    outside the longest run of pairs that keeps the older order. Python gets the places of a document's sections
    only where its order changed. ``rows``: about how many sections a side has, if that is known.
    """
    deal = lambda df, *keys: df.repartition(*keys) if rows is None else dealt(df, rows, *keys)

    def side(df, anchor, pos, body, own):
        return df.select("doc", F.col("anchor").alias(anchor), F.col("pos").alias(pos), F.sha2("body", 256).alias(body), F.lit(True).alias(own))

    if aligned is None and "title" not in old.columns and "title" not in new.columns:
        left, right = (deal(df.withColumn("k", F.col(k)), "doc", "k") for df, k in ((side(old, "a", "p1", "h1", "o"), "a"), (side(new, "b", "p2", "h2", "n"), "b")))
        every = left.join(right, ["doc", "k"], "full")
    else:
        # each side is written, as the steps of paired read it again and again
        old, new = (cut(df if "title" in df.columns else df.withColumn("title", F.lit(None).cast("string"))) for df in (old, new))
        every = side(old, "a", "p1", "h1", "o").join(paired(old, new, aligned), ["doc", "a"], "left").join(side(new, "b", "p2", "h2", "n"), ["doc", "b"], "full")
    met = F.col("o") & F.col("n")
    change = F.when(F.col("n").isNull(), "removed").when(F.col("o").isNull(), "added").when(F.col("h1").eqNullSafe(F.col("h2")), "same").otherwise("changed")
    place = lambda *order: F.row_number().over(Window.partitionBy("doc", "met").orderBy(*order))
    ranked = deal(every.withColumn("met", F.coalesce(met, F.lit(False))).withColumn("change", change), "doc").withColumn("r1", place("p1", "a")).withColumn("r2", place("p2", "b"))
    # a section of no document stands by itself
    alone = F.when(F.col("doc").isNull(), F.xxhash64("a", "b"))
    listed = ranked.groupBy("doc", alone.alias("alone")).agg(F.collect_list(F.struct("a", "b", "change", "met", "r1", "r2")).alias("s"))
    pairs = F.filter("s", lambda x: x["met"])
    orders = F.when(F.exists(pairs, lambda x: x["r1"] != x["r2"]), F.transform(F.array_sort(F.transform(pairs, lambda x: F.struct(x["r2"].alias("r2"), x["r1"].alias("r1")))), lambda x: x["r1"]))
    each = listed.withColumn("m", F.pandas_udf(_left_out, "array<boolean>")(orders)).select("doc", "m", F.explode("s").alias("s"))
    moved = F.coalesce(F.col("s.met") & F.get("m", F.col("s.r2") - 1), F.lit(False))
    return each.select("doc", F.col("s.a").alias("old_anchor"), F.col("s.b").alias("anchor"), "s.change", moved.alias("moved"))
