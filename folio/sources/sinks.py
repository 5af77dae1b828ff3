"""Sinks: tables by document, text formats as columns, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition: str | None = None, sort: list[str] | None = None) -> None:
    """Parquet, sorted within files, so that lookups skip row groups; one commit."""
    out = df.sortWithinPartitions(*sort) if sort else df
    writer = out.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Replaces only the partitions that ``df`` has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def citation_text(number: Column, title: Column, authors: Column, year: Column) -> Column:
    """``A. Author, "Title", RFC n, year.``"""
    return F.concat(authors, F.lit(', "'), title, F.lit('", RFC '), number.cast("string"), F.lit(", "), year.cast("string"), F.lit("."))


def bibtex(number: Column, title: Column, authors: Column, year: Column) -> Column:
    n = number.cast("string")
    return F.concat(F.lit("@misc{rfc"), n, F.lit(", author={"), authors, F.lit("}, title={"), title, F.lit("}, number="), n, F.lit(", year="), year.cast("string"), F.lit("}"))


def markdown(title: Column, body: Column) -> Column:
    return F.concat(F.lit("# "), title, F.lit("\n\n"), body, F.lit("\n"))


def html(title: Column, body: Column) -> Column:
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit("<h1>"), escape(title), F.lit("</h1>\n<p>"), F.regexp_replace(escape(body), r"\n\s*\n", "</p>\n<p>"), F.lit("</p>\n"))


def csv_line(*columns: Column) -> Column:
    """One line of CSV: quoted where it must be."""
    quoted = lambda c: F.when(c.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    return F.concat_ws(",", *[quoted(c.cast("string")) for c in columns])


def manifest(docs: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """(path, bytes, sha256) of each document."""
    return docs.select(F.col(path_col).cast("string").alias("path"), F.octet_length(text_col).alias("bytes"), F.sha2(text_col, 256).alias("sha256"))
