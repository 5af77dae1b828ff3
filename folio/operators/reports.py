"""Reports of the prose guards that are kept by part of the corpus and merge to the whole's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lines import GUARDS

#: Near misses that a report keeps as its sample; its counts are of all.
SAMPLE = 2000

#: A report's rows: a count by measure and key, or one near miss of the sample (``n`` is 1).
REPORT = "measure string, key string, n bigint, doc_id bigint, gap bigint, block bigint"

#: Signs that a block without a sentence is no prose; where all but one agree, that one dissents.
TELLS = {"bars": "bars >= 2", "symbols": "symbols > 0", "capitals": "capitals * 4 > letters"}


def dissenting(tells: dict[str, str]) -> Column:
    """The one of three or more tells (SQL conditions) that says otherwise than all others, or null."""
    yes = F.filter(F.array(*[F.when(F.expr(t), F.lit(k)) for k, t in tells.items()]), lambda k: k.isNotNull())
    no = F.filter(F.array(*[F.when(~F.expr(t), F.lit(k)) for k, t in tells.items()]), lambda k: k.isNotNull())
    return F.when(F.size(yes) == 1, yes[0]).when(F.size(no) == 1, no[0])


def partials(refused: DataFrame, part: Column, tells: dict[str, str] = TELLS, gate: str = "no_sentence", sample: int = SAMPLE) -> DataFrame:
    """(part, measure, key, n, doc_id, gap, block): one report a part of ``refused(doc_id, gap, part, refused, ...)``.

    ``part`` is a function of doc_id, so a document is in one report. Measures: documents, blocks, prose, near_misses
    (one guard refuses), guard and sole by guard, dissent by tell among blocks that ``gate`` refuses, and sample: the
    first ``sample`` near misses by document and place. A table without rows has no reports.
    """
    told = refused.select("doc_id", "gap", F.col("part").alias("block"), "refused", part.alias("part"), F.when(F.array_contains("refused", gate), dissenting(tells)).alias("dissent"))
    near = F.size("refused") == 1
    counts = {("blocks", ""): F.lit(True), ("prose", ""): F.size("refused") == 0, ("near_misses", ""): near}
    counts |= {("guard", g): F.array_contains("refused", g) for g in GUARDS}
    counts |= {("sole", g): near & F.array_contains("refused", g) for g in GUARDS}
    counts |= {("dissent", k): F.col("dissent") == k for k in tells}
    by_doc = told.groupBy("part", "doc_id").agg(*[F.count_if(c).alias(f"c{i}") for i, c in enumerate(counts.values())])
    by_part = by_doc.groupBy("part").agg(F.count(F.lit(1)).alias("documents"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(counts))])
    held = [("documents", "", F.col("documents"))] + [(m, k, F.col(f"c{i}")) for i, (m, k) in enumerate(counts)]
    rows = by_part.select("part", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.lit(k).alias("key"), n.alias("n")) for m, k, n in held])).alias("r")).where("r.n > 0")
    nowhere = [F.lit(None).cast("bigint").alias(c) for c in ("doc_id", "gap", "block")]
    nth = F.row_number().over(Window.partitionBy("part").orderBy("doc_id", "gap", "block"))
    shown = told.where(near).withColumn("nth", nth).where(F.col("nth") <= sample)
    shown = shown.select("part", F.lit("sample").alias("measure"), F.col("refused")[0].alias("key"), F.lit(1).cast("bigint").alias("n"), *[F.col(c).cast("bigint").alias(c) for c in ("doc_id", "gap", "block")])
    return rows.select("part", "r.measure", "r.key", "r.n", *nowhere).unionByName(shown)


def merged(reports: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One report of all parts of ``reports``, the same as one pass over their documents makes, in rows of ``REPORT``."""
    columns = [c.split()[0] for c in REPORT.split(", ")]
    counts = reports.where("measure != 'sample'").groupBy("measure", "key").agg(F.sum("n").alias("n"))
    shown = reports.where("measure = 'sample'").select(columns).orderBy("doc_id", "gap", "block").limit(sample)
    return counts.select(*columns[:3], *[F.lit(None).cast("bigint").alias(c) for c in columns[3:]]).unionByName(shown)


def store(reports: DataFrame, path: str) -> None:
    """Writes the reports of these parts below ``path``, in place of those that the same parts had; other parts stay."""
    reports.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def stored(spark, path: str, part_type: str = "bigint") -> DataFrame:
    return spark.read.schema(f"{REPORT}, part {part_type}").parquet(path)


def growth(before: DataFrame, after: DataFrame) -> DataFrame:
    """(measure, key, before, after) where two merged reports differ in a count; a missing one is 0."""
    of = lambda r, name: r.where("measure != 'sample'").select("measure", "key", F.col("n").alias(name))
    both = of(before, "before").join(of(after, "after"), ["measure", "key"], "full").na.fill(0, ["before", "after"])
    return both.where("before != after")
