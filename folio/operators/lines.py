"""Plain text as lines: furniture, blocks, prose guards, samples at the boundary."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeezed


def furniture(lines: DataFrame, least: int = 2) -> DataFrame:
    """(doc_id, line, n): non-blank lines that recur in a document, digits taken as one."""
    key = F.regexp_replace(squeezed(F.col("line")), r"\d+", "#")
    return lines.withColumn("line", key).where("line != ''").groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def blocks(lines: DataFrame, most_lines: int = 8) -> DataFrame:
    """``lines(doc_id, pos, line)`` with ``block``: blank lines end a block, and so does every ``most_lines`` lines."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    blank = F.trim("line") == ""
    runs = lines.withColumn("gap", F.sum(blank.cast("int")).over(w)).where(~blank)
    nth = F.row_number().over(Window.partitionBy("doc_id", "gap").orderBy("pos")) - 1
    return runs.withColumn("block", F.struct("gap", F.floor(nth / most_lines).alias("part"))).drop("gap")


#: Guards in order; a block is prose if none refuses it.
GUARDS = ("too_short", "symbols", "table", "capitals", "no_sentence")


def block_metrics(lines: DataFrame) -> DataFrame:
    """(doc_id, gap, part, ...): what the guards look at, summed over a block's lines."""
    chars = F.length("line")
    letters = chars - F.length(F.regexp_replace("line", r"\p{L}", ""))
    capitals = chars - F.length(F.regexp_replace("line", r"\p{Lu}", ""))
    symbols = chars - F.length(F.translate("line", "$%&*#|", ""))
    return blocks(lines).groupBy("doc_id", F.col("block.gap").alias("gap"), F.col("block.part").alias("part")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(chars).alias("chars"), F.sum(letters).alias("letters"), F.sum(capitals).alias("capitals"), F.sum(symbols).alias("symbols"),
        F.sum(chars - F.length(F.translate("line", "|", ""))).alias("bars"), F.max(F.col("line").rlike(r"[.!?]").cast("int")).alias("stops"),
    )


def refusals(metrics: DataFrame) -> DataFrame:
    """``metrics`` with ``refused``, the guards that refuse the block, in order."""
    checks: dict[str, Column] = {
        "too_short": F.col("chars") < 40,
        "symbols": F.col("symbols") * 20 > F.col("chars"),
        "table": F.col("bars") >= 2 * F.col("n_lines"),
        "capitals": F.col("capitals") * 2 > F.col("letters"),
        "no_sentence": F.col("stops") == 0,
    }
    hits = F.filter(F.array(*[F.when(checks[g], F.lit(g)) for g in GUARDS]), lambda g: g.isNotNull())
    return metrics.withColumn("refused", hits)


def histogram(refused: DataFrame) -> DataFrame:
    """(guard, n, n_sole): blocks that each guard refuses, and those that it alone refuses."""
    return refused.select(F.explode("refused").alias("guard"), (F.size("refused") == 1).alias("sole")).groupBy("guard").agg(F.count(F.lit(1)).alias("n"), F.count_if("sole").alias("n_sole"))


def boundary(refused: DataFrame) -> DataFrame:
    """Blocks that exactly one guard refuses, and only just: by less than a tenth of its measure."""
    only = F.when(F.size("refused") == 1, F.col("refused")[0])
    near = (
        F.when(only == "too_short", F.col("chars") >= 36)
        .when(only == "symbols", F.col("symbols") * 20 < F.col("chars") * 1.1)
        .when(only == "table", F.col("bars") * 10 < 22 * F.col("n_lines"))
        .when(only == "capitals", F.col("capitals") * 20 < F.col("letters") * 11)
        .otherwise(F.lit(False))
    )
    return refused.where(near).withColumn("criterion", only)


def headings(lines: DataFrame) -> DataFrame:
    """Numbered headings: doc_id, pos, number, depth, title; each with the heading above it, by number."""
    found = F.regexp_extract("line", r"^((?:\d+|[A-Z])(?:\.\d+)*)\.?\s+(\S.*)$", 1)
    title = F.regexp_extract("line", r"^((?:\d+|[A-Z])(?:\.\d+)*)\.?\s+(\S.*)$", 2)
    h = lines.select("doc_id", "pos", found.alias("number"), title.alias("title")).where("number != '' and not title rlike '[.]{4}'")
    parent = F.regexp_extract("number", r"^(.*)\.[^.]+$", 1)
    return h.withColumn("depth", F.size(F.split("number", r"\."))).withColumn("parent", F.when(parent != "", parent))


def subtree(sections: DataFrame, number: str) -> DataFrame:
    """A section and all below it."""
    return sections.where((F.col("number") == number) | F.col("number").startswith(number + "."))


def unique_anchors(sections: DataFrame) -> DataFrame:
    """``anchor`` made unique in its document, in the order of ``pos``: one that is taken gets the first free of ``-2``, ``-3`` ...

    Names of one family (an anchor without its numbers at the end) can take each other's place, others
    can't. Where a family has one spelling, its rows are counted by a window; where it has several
    (``a``, ``a``, ``a-2``), they are walked in order, a document's family at a time. Null stays null.
    """
    columns = sections.columns
    root = F.regexp_replace("anchor", r"(-[0-9]+)+$", "")
    family = Window.partitionBy("doc_id", "__root")
    rows = sections.withColumn("__root", root).withColumn("__mixed", F.min("anchor").over(family) != F.max("anchor").over(family))
    nth = F.row_number().over(Window.partitionBy("doc_id", "__root").orderBy("pos"))
    alone = rows.where("__mixed is null or not __mixed").withColumn("nth", nth)
    alone = alone.withColumn("anchor", F.when(F.col("nth") > 1, F.concat("anchor", F.lit("-"), "nth")).otherwise(F.col("anchor"))).select(columns)

    def walked(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, following, out = set(), {}, []
        pdf = pdf.sort_values("pos")
        for anchor in pdf["anchor"]:
            name, n = anchor, following.get(anchor, 2)
            while name in taken:
                name, n = f"{anchor}-{n}", n + 1
            # a name once taken stays so, thus the search of the next goes on from here
            following[anchor] = n
            taken.add(name)
            out.append(name)
        return pdf.assign(anchor=out)[columns]

    mixed = rows.where("__mixed").groupBy("doc_id", "__root").applyInPandas(walked, sections.schema)
    return alone.unionByName(mixed)
