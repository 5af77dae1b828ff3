"""Search filters as a value: what a query narrows by, and the Column that it means.

Filters are built in Python (``Filters(status=..., years=...)``) rather than parsed from a
string; Catalyst orders and pushes the conjunction.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold

#: Status groups and the statuses in them.
STATUSES = {
    "std": ("INTERNET STANDARD", "DRAFT STANDARD", "PROPOSED STANDARD"),
    "internet-standard": ("INTERNET STANDARD",),
    "bcp": ("BEST CURRENT PRACTICE",),
    "info": ("INFORMATIONAL",),
    "exp": ("EXPERIMENTAL",),
    "historic": ("HISTORIC",),
}

@dataclass(frozen=True)
class Filters:
    """Conjunction of what is given; an empty or missing value doesn't narrow.

    ``years`` is a pair in either order; ``after`` and ``before`` are (year, month or None), after
    includes its month and before excludes it; ``within`` is (days, today) and keeps what may be as
    new as that, taking missing months and days as the last.
    """

    status: tuple[str, ...] = ()
    stream: tuple[str, ...] = ()
    group: tuple[str, ...] = ()
    author: str | None = None
    years: tuple[int, int] | None = None
    after: tuple[int, int | None] | None = None
    before: tuple[int, int | None] | None = None
    within: tuple[int, date] | None = None
    has_xml: bool = False
    current: bool = False
    columns: dict[str, str] = field(default_factory=dict)

    def unknown(self, catalogue: DataFrame) -> tuple[str, ...]:
        """Which of the values asked for nothing can have: names of statuses that stand for none, and what the catalogue lacks.

        One look at the catalogue's distinct values, as many as were asked for at most. A status by one of the names that
        stand for several is known even where the catalogue has none of them.
        """
        out: list[str] = []
        for name, values, plain in (("status", [s for s in self.status if s not in STATUSES], F.col), ("stream", list(self.stream), lambda c: F.lower(F.col(c))), ("group", list(self.group), lambda c: fold(F.col(c)))):
            if values:
                asked = {v: v if name == "status" else v.lower() for v in values}
                own = catalogue.select(plain(self.columns.get(name, name)).alias("v"))
                have = {r["v"] for r in own.where(F.col("v").isin(list(asked.values()))).distinct().collect()}
                out += [v for v, held in asked.items() if held not in have]
        return tuple(out)

    def narrowed(self, catalogue: DataFrame) -> DataFrame:
        """``catalogue`` narrowed; anything unknown asked for leaves nothing, rather than everything."""
        return catalogue.where(F.lit(False) if self.unknown(catalogue) else self.predicate())

    def _col(self, name: str) -> Column:
        return F.col(self.columns.get(name, name))

    def predicate(self) -> Column:
        year, month, day = self._col("year"), self._col("month"), self._col("day")
        out = F.lit(True)
        if self.status:
            wanted = [s for g in self.status for s in STATUSES.get(g, (g,))]
            out = out & self._col("status").isin(wanted)
        if self.stream:
            out = out & F.lower(self._col("stream")).isin([s.lower() for s in self.stream])
        if self.group:
            out = out & fold(self._col("group")).isin([g.lower() for g in self.group])
        if self.author:
            out = out & author_matches(self._col("author"), self.author)
        if self.years:
            out = out & year.between(min(self.years), max(self.years))
        if self.after:
            out = out & since(year, month, self.after)
        if self.before:
            out = out & ~since(year, month, self.before)
        if self.within:
            days, today = self.within
            first = today - timedelta(days=days)
            last = F.coalesce(year, F.lit(0)) * 10_000 + F.coalesce(month, F.lit(12)) * 100 + F.coalesce(day, F.lit(31))
            out = out & (last >= first.year * 10_000 + first.month * 100 + first.day)
        if self.has_xml:
            out = out & F.array_contains(self._col("formats"), "XML")
        if self.current:
            out = out & ~self._col("is_obsolete")
        return out


def since(year: Column, month: Column, bound: tuple[int, int | None]) -> Column:
    """On or after a bound: by year where it has no month, else a missing month counts as January."""
    if bound[1] is None:
        return year >= bound[0]
    return (year > bound[0]) | ((year == bound[0]) & (F.coalesce(month, F.lit(1)) >= bound[1]))


def author_matches(author: Column, wanted: str) -> Column:
    """Surname contains the query's last words; a leading initial must be among the author's."""
    words = wanted.lower().split()
    name = fold(author)
    if len(words) > 1 and (len(words[0].rstrip(".")) == 1):
        return name.rlike(rf"(^|[ .]){words[0][0]}[. ]") & F.contains(name, F.lit(" ".join(words[1:])))
    return F.contains(name, F.lit(" ".join(words)))
