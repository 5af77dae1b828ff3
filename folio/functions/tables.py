"""Table functions for SQL: word runs of two texts, expansions of a text, the longest run in order of a table argument.

``register(spark)`` makes them callable by name:

    SELECT * FROM word_runs('a b', 'a c')
    SELECT d.id, e.* FROM docs d, LATERAL expansions(d.text) e
    SELECT * FROM longest_run(TABLE(SELECT doc, place FROM t) PARTITION BY doc ORDER BY pos)
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from ..operators.diff import runs_of
from ..operators.extract import expansions_of


class WordRuns:
    """(pos, kind, text): runs of kept, removed and added words between an older and a newer text; null is empty."""

    def eval(self, old: str, new: str):
        for pos, run in enumerate(runs_of(old, new)):
            yield pos, run["kind"], run["text"]


class Expansions:
    """(pos, short, long): the abbreviations that a text expands, in order."""

    def eval(self, text: str):
        for pos, found in enumerate(expansions_of(text)):
            yield pos, found["short"], found["long"]


class LongestRun:
    """(key, nth, kept) for each row of a table argument (key, value): is it in a longest rising run of its partition's values.

    Rows come by PARTITION BY and ORDER BY. Of equal runs it is the one whose last values are least; a null value is in none.
    """

    def __init__(self):
        self.key, self.values = None, []

    def eval(self, row: Row):
        self.key = row[0]
        self.values.append(row[1])

    def terminate(self):
        least, tails, before = [], [], {}
        for at, value in enumerate(self.values):
            if value is None:
                continue
            k = bisect_left(least, value)
            before[at] = tails[k - 1] if k else None
            tails[k : k + 1], least[k : k + 1] = [at], [value]
        kept, at = set(), tails[-1] if tails else None
        while at is not None:
            kept.add(at)
            at = before[at]
        for nth in range(len(self.values)):
            yield self.key, nth, nth in kept


def register(spark: SparkSession) -> None:
    """Registers all of them. Texts go to Python by Arrow; a table argument's rows don't, as each would be a batch of its own."""
    for name, cls, kind, arrow in (
        ("word_runs", WordRuns, "pos int, kind string, text string", True),
        ("expansions", Expansions, "pos int, short string, long string", True),
        ("longest_run", LongestRun, "key long, nth int, kept boolean", False),
    ):
        spark.udtf.register(name, udtf(cls, returnType=kind, useArrow=arrow))
