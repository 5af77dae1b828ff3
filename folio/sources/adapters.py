"""The driver's tables in the shapes the operators take. Every adapter is a projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How line flags stand for kinds of reference.
KINDS = {"N": "normative", "A": "informative", "R": "unknown"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark, sf_dir) -> DataFrame:
    """A catalogue: number, title, keywords, group, status, pages."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("number"), F.col("p_name").alias("title"), F.array("p_type").alias("keywords"), F.col("p_brand").alias("group"), F.col("p_type").alias("status"), F.col("p_size").alias("page_count")
    )


def orders(spark, sf_dir) -> DataFrame:
    """A dated catalogue: number, year, month, day, status, stream."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("number"), F.col("o_custkey").alias("owner"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.dayofmonth("o_orderdate").alias("day"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("stream")
    )


def owned_orders(spark, sf_dir) -> DataFrame:
    """``orders`` with the owner's group and name."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"), F.col("c_mktsegment").alias("group"), F.col("c_name").alias("author"))
    return orders(spark, sf_dir).join(c, "owner")


def citations(spark, sf_dir) -> DataFrame:
    """citing, cited, place, kind."""
    kind = F.when(F.col("l_returnflag") == "N", "normative").when(F.col("l_returnflag") == "A", "informative").otherwise("unknown")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("citing"), F.col("l_partkey").alias("cited"), F.col("l_linenumber").alias("place"), kind.alias("kind"))


def series(spark, sf_dir) -> DataFrame:
    """Series with ordered members: regions and their nations."""
    members = F.array_sort(F.collect_list("n_nationkey")).alias("members")
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(members)
    return table(spark, sf_dir, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.coalesce("members", F.array().cast("array<int>")).alias("members"))


def lines(spark, sf_dir) -> DataFrame:
    """doc_id, pos (from 0) and line of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def events(spark, sf_dir) -> DataFrame:
    """Reader's data: event_id, ts (timestamp), user_id, event_type, value."""
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def turns(spark, sf_dir) -> DataFrame:
    """Revisions: doc (conversation), revision (turn), text."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("revision"), "role", "text")
