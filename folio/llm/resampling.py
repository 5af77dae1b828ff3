"""Importance resampling towards a target distribution, over hashed runs of words.

One scan of each text keeps a ring of running CRC-32 states, one for each of the last n starts;
a word extends each by a space and itself, and every state so reached is a run of words hashed.
What leaves the scan is a document's bucket numbers. Counts by bucket of all documents and of
the target give each bucket a gain, a document weighs the mean gain of its runs, and a draw
without replacement adds a Gumbel number that rests on the document's id alone.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bytes_of, light

#: Most bytes of text whose words are held at once.
SLICE_BYTES = 1 << 20

#: A-Z as a-z; digits, a-z and all bytes of other letters as they are; the rest parts words.
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_in(text: bytes):
    """The words of a text, slice by slice."""
    text, at = text.translate(_FOLDED), 0
    while at < len(text):
        end = text.find(b" ", at + SLICE_BYTES)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def ring_states(slices, n: int):
    """For each slice its number of words and the CRC-32 of every run of 1 to n words that ends in it.

    ``ring`` holds the states of the last n starts, the oldest first; it goes over from slice to slice.
    """
    ring: list[int] = []
    for words in slices:
        states: list[int] = []
        for word in words:
            spaced = b" " + word
            ring = [crc32(spaced, state) for state in ring[1 - n :]] if n > 1 else []
            ring.append(crc32(word))
            states += ring
        yield len(words), states


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def _scan(n: int, buckets: int):
    kind = _kind(buckets)

    def run(batches):
        for batch in batches:
            n_words, held = [], []
            for text in bytes_of(batch.column("text")):
                counts, parts = 0, []
                for words, states in ring_states(words_in(text), n):
                    counts += words
                    parts.append((np.array(states, np.uint32) % np.uint32(buckets)).astype(kind).tobytes())
                n_words.append(counts)
                held.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(held, pa.binary())], names=["doc_id", "n_words", "buckets"])

    return run


def run_buckets(docs: DataFrame, n: int = 1, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, buckets) of every row: the bucket of each run of 1 to ``n`` words of the whole text, repeats too.

    Buckets are packed as little-endian unsigned numbers of 16 bits (32 bits from 65,537 buckets on).
    Words are runs of ASCII letters and digits and of all other characters from 128 on, A-Z as a-z.
    A null or empty text has none.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(light(_scan(n, buckets)), "doc_id long, n_words long, buckets binary")


def bucket_counts(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) over all ``rows(buckets)``; each task sends one row a bucket at most."""
    kind = _kind(buckets)

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for code in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(code, kind), minlength=buckets)
        met = np.flatnonzero(total)
        if len(met):
            yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], names=["bucket", "n"])

    return rows.select("buckets").mapInArrow(light(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) for every bucket: floor(1000 ln) of the target's smoothed share over the source's."""
    every = source.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    both = every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    both = both.select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "st"])
    totals = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))  # one row
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return both.crossJoin(F.broadcast(totals)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weighted(rows: DataFrame, gains: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of ``rows`` of run_buckets: the floored mean gain of a row's runs, 0 without any.

    The gains are as many as there are buckets, a parameter, so they are sent to all tasks.
    """
    kind = _kind(buckets)
    table = np.zeros(buckets, np.int64)
    for bucket, gain in gains.select("bucket", "gain").toPandas().itertuples(index=False):
        table[bucket] = gain
    held = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        gain = held.value
        for batch in batches:
            sizes, weights = [], []
            for code in batch.column("buckets").to_pylist():
                own = np.frombuffer(code, kind)
                sizes.append(len(own))
                weights.append(int(gain[own].sum()) // len(own) if len(own) else 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(sizes, pa.int64()), pa.array(weights, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(light(run), "doc_id long, n_words long, n_features long, weight long")


def drawn(rows: DataFrame, share: int = 10, least_words: int = 20, seed: int = 2024, scratch: Scratch | None = None) -> DataFrame:
    """``rows(doc_id, n_words, n_features, weight)`` with ``score`` and ``rank``.

    The floor(share * N / 100) highest scores of the N rows with at least ``least_words`` words have a
    rank from 1, ties going to the smaller doc_id; all others have none. A score is the weight plus a
    Gumbel number from the hash of ``seed:doc_id``. Parts are ranges of the order, rows that are alike
    dealt too, so no task has all rows; a part's first rank is the number of rows before it.
    """
    scratch = scratch or Scratch(rows.sparkSession, "draw")
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = rows.withColumn("score", F.col("weight") + gumbel)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("__row")]
    able = scored.where(F.col("n_words") >= least_words).withColumn("__row", F.monotonically_increasing_id())
    placed = scratch.save(able.repartitionByRange(*order).sortWithinPartitions(*order).drop("__row").withColumn("__place", F.monotonically_increasing_id()), "placed")
    part, within = F.shiftright("__place", 33), F.col("__place").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r[0], r[1]) for r in placed.groupBy(part.alias("p")).count().collect())  # a row a part
    most, firsts, before = share * sum(n for _, n in sizes) // 100, {}, 0
    for p, n in sizes:
        firsts[p] = before
        before += n
    first = rows.sparkSession.createDataFrame(list(firsts.items()), "__part int, __first long")
    met = placed.withColumn("__part", part.cast("int")).join(F.broadcast(first), "__part", "left")
    rank = F.col("__first") + within + 1
    ranked = met.withColumn("rank", F.when(rank <= most, rank)).select(*scored.columns, "rank")
    return ranked.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, share: int = 10, least_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """Every row of ``docs``: doc_id, n_features, weight, score, and the rank of those drawn towards ``target``.

    A null or empty text has no runs, weight 0, and takes part in no draw as long as ``least_words``
    is above 0. Rows that repeat an id are drawn each; a null id hashes as the empty one and loses
    ties. An empty target gives every bucket the gain of its rarity; an empty table of documents
    gives no rows. Other columns play no part. Texts are read once: the buckets are a written table.
    """
    scratch = Scratch(docs.sparkSession, "resample")
    rows = scratch.save(run_buckets(docs, n, buckets, id_col, text_col), "buckets")
    wanted = run_buckets(target.select(F.lit(0).alias("id"), F.col(f"`{target_text}`").alias("text")), n, buckets, "id")
    gains = scratch.save(bucket_gains(bucket_counts(rows, buckets), bucket_counts(wanted, buckets), buckets), "gains")
    weights = scratch.save(weighted(rows, gains, buckets), "weights")
    return drawn(weights, share, least_words, seed, scratch).select("doc_id", "n_features", "weight", "score", "rank")


OP11_SQL = r"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
), texts AS (
  SELECT row_number() OVER () AS n, doc_id, text, true AS own FROM documents UNION ALL SELECT 0, NULL, text, false FROM benchmark
), words AS (
  SELECT n, doc_id, own, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts
), each AS (SELECT DISTINCT word, hex(encode(word)) AS x FROM words), hashed AS (
  SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, len(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) % 10000 AS bucket
  FROM each, crc_table
), f AS (SELECT n, own, bucket FROM words JOIN hashed USING (word)), counts AS (
  SELECT b AS bucket, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM range(10000) r(b) LEFT JOIN f ON b = bucket GROUP BY b
), gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * ((sum(s) OVER ()) + 10000)::DOUBLE) / ((s + 1)::DOUBLE * ((sum(t) OVER ()) + 10000)::DOUBLE)))::BIGINT AS gain FROM counts
), means AS (SELECT n, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM f JOIN gains USING (bucket) WHERE own GROUP BY n), scored AS (
  SELECT n, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM texts LEFT JOIN means USING (n) WHERE own
), ranked AS (SELECT n, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS able FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= able * 10 // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (n)
"""


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resampled(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
