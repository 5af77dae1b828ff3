"""URL filter: rules on host and path, else a logistic regression on hashed character n-grams.

Everything is a DataFrame or SQL expression. The labelled table is small by contract (its size is
a checked parameter): it becomes one row, of each URL's n-grams and of each n-gram's URLs, and gradient
descent is one expression over it. The weights are a literal of fixed size in the scoring expression.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled_urls import LABELLED

SLOTS = 8192
#: Most labelled URLs; one row holds them all.
MOST_LABELLED = 2_000
STEPS, RATE, DECAY = 40, 80.0, 1e-5
NGRAM = 3

#: Rules (verdict, host, start of the path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"(?s)\A[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1), F.lit(""))


def slots(host: Column, path: Column, n: int = NGRAM, size: int = SLOTS) -> Column:
    """The distinct hashed n-grams of host and path, each with its own marks at both ends."""

    def grams(text: Column, mark: str) -> Column:
        marked = F.concat(F.lit(mark), text, F.lit("$"))
        starts = F.when(F.length(marked) >= n, F.sequence(F.lit(1), F.length(marked) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.substring(marked, i, n), F.lit(mark)), F.lit(size)).cast("int"))

    return F.array_distinct(F.concat(grams(host, "^"), grams(path, ">")))


def trained(labelled: DataFrame, size: int = SLOTS, steps: int = STEPS, rate: float = RATE, decay: float = DECAY, url_col: str = "url", label_col: str = "blocked") -> list[float]:
    """Weights (the last is the bias) of a logistic regression on ``labelled(url, blocked)``.

    Full-batch gradient descent from zero. Rows without url or label play no part; without any
    row all weights are 0. More than MOST_LABELLED rows are an error: the table is small by contract.
    """
    rows = labelled.where(F.col(url_col).isNotNull() & F.col(label_col).isNotNull())
    # the slot after the last is in every URL: the bias
    found = F.concat(slots(host_of(F.col(url_col)), path_of(F.col(url_col)), size=size), F.array(F.lit(size)))
    row = F.struct(found.alias("found"), F.col(label_col).cast("double").alias("y"))
    table = rows.select(row.alias("row")).limit(MOST_LABELLED + 1).agg(F.sort_array(F.collect_list("row")).alias("rows"))
    each = table.select(F.posexplode("rows").alias("r", "row")).select("r", F.explode("row.found").alias("slot")).groupBy("slot").agg(F.sort_array(F.collect_list("r")).alias("of"))
    every = labelled.sparkSession.range(size + 1).select(F.col("id").cast("int").alias("slot")).join(each, "slot", "left").select("slot", F.coalesce("of", F.array().cast("array<int>")).alias("of"))
    lists = every.agg(F.sort_array(F.collect_list(F.struct("slot", "of"))).alias("held")).select(F.col("held.of").alias("lists"))
    # both are one row; written out by the exchange, so that no step of the descent builds them again
    table = table.join(F.broadcast(lists)).repartition(1)
    zero = F.array_repeat(F.lit(0.0), size + 1)
    scale = lambda r: F.lit(1.0) / F.sqrt(F.size(r["found"]))

    def step(w: Column, _: Column) -> Column:
        margin = lambda r: F.aggregate(r["found"], F.lit(0.0), lambda s, i: s + F.element_at(w, i + 1)) * scale(r)
        wrong = F.transform("rows", lambda r: (F.lit(1.0) / (F.lit(1.0) + F.exp(-margin(r))) - r["y"]) * scale(r))
        n = F.greatest(F.size("rows"), F.lit(1))
        # the errors are worked out once a step, not once a slot
        slopes = F.element_at(F.transform(F.array(wrong), lambda e: F.transform("lists", lambda of: F.aggregate(of, F.lit(0.0), lambda g, r: g + F.element_at(e, r + 1)))), 1)
        return F.zip_with(w, slopes, lambda wi, g: wi * (1 - rate * decay) - rate * g / n)

    held = table.select(F.when(F.size("rows") <= MOST_LABELLED, F.aggregate(F.sequence(F.lit(1), F.lit(steps)), zero, step)).alias("w"))
    weights = held.first()["w"]
    if weights is None:
        raise ValueError(f"the labelled table has more than {MOST_LABELLED} rows")
    return weights


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule (verdict, host, path) that fits, as a struct of its text and verdict; else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judged(pages: DataFrame, weights: list[float], rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, score.

    The verdict is that of the longest rule that fits, else block where the model's probability
    (score) is above one half. A null url, or one without ``://``, has empty host and path, no rule,
    and the model's verdict on them. Rows that repeat are judged each; an empty table gives no rows.
    Other columns play no part.
    """
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url")).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # one string that the planner makes an array of once
    w = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    size = len(weights) - 1
    found = slots(F.col("host"), F.col("path"), size=size)
    # the sum over a text's slots, by looking each one up
    scored = rows.withColumn("found", found).withColumn("margin", (F.aggregate("found", F.lit(0.0), lambda s, i: s + F.element_at(w, i + 1)) + F.lit(float(weights[-1]))) / F.sqrt(F.size("found") + 1))
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("margin")))
    with_rule = scored.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    return with_rule.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.when(score > 0.5, "block").otherwise("allow")).alias("verdict"), score.alias("score"))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table as a DataFrame."""
    rows = json.dumps([{"url": u, "blocked": b} for u, b in LABELLED])
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<url:string,blocked:int>>")))


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), trained(labelled_urls(spark)))


RULES_SQL = """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '(?s)^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, name, start) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
f AS (SELECT page_id, max_by(name || start, len(name || start)) AS rule, max_by(verdict, len(name || start)) AS verdict FROM h JOIN r ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY 1)
SELECT h.page_id, host, path, rule, verdict AS ruled FROM h LEFT JOIN f ON f.page_id = h.page_id
"""


def url_rules(spark, sf_dir: str) -> DataFrame:
    """The part of op9 that SQL can say: host, path, and the rule with its verdict."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    fit = pages.withColumn("fit", rule_of(F.col("host"), F.col("path")))
    return fit.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("ruled"))
