"""Pieces that several training-data operators share.

Scratch tables are written below ``spark.checkpoint.dir``, which every executor can
read, so that a lost executor costs one task and never the lineage before the table.
"""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1


#: Bytes of a batch that goes to a Python worker or comes from one, where the session doesn't say: long texts come few at a time.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares; on one machine (tests), a temporary one is set where none is."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = held.get() if held.isDefined() else None
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        path = "file://" + tempfile.mkdtemp(prefix="folio-shared-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    jvm, jsc = spark._jvm, spark.sparkContext._jsc
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables of one operator call in the shared folder; gone when the session's Python ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/folio-{name}-{uuid.uuid4().hex}"
        if spark.conf.get(_BATCH_CONF, "64MB") == "64MB":  # the default
            spark.conf.set(_BATCH_CONF, BATCH_BYTES)
        atexit.register(self.clear)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written once and read back: a cut in the lineage."""
        path = self.path(name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Frees a table that no later table is computed from."""
        _remove(self.spark, self.path(name))

    def clear(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                _remove(self.spark, self.root)
        except Exception:  # noqa: BLE001  the session may have ended first
            pass


#: What operators keep in a Python worker from task to task, by operator; each is bounded by its own rule.
CACHES: dict[str, dict] = {}


def tidy(keep: str = "") -> None:
    """Drops what other operators keep in this worker, and gives freed memory back to the system."""
    for name, held in CACHES.items():
        if name != keep:
            held.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def light(run, keep: str = ""):
    """A function of batches that leaves its worker tidy: workers serve the tasks of many operators in turn."""

    def go(batches):
        tidy(keep)
        yield from run(batches)
        tidy(keep)

    return go


def bytes_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 of a string column's values, null as empty, without decoding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


_ODD = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_RANDOM = np.random.default_rng(20240229).integers(0, 2**64, 256, np.uint64)
_LOWERED = _RANDOM[[b + 32 if 65 <= b <= 90 else b for b in range(256)]]
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of _ODD and of its inverse, at least ``n`` of each."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS


def word_hashes(texts: list[bytes], lower: bool = False) -> list[np.ndarray]:
    """64-bit hashes of the words of each text, in order.

    A word is a run of bytes other than white space (space and 9 to 13); ``lower`` takes A-Z as
    a-z. All words are hashed at once, from running sums of a random number a byte times a power
    a place; give texts of a few megabytes together.
    """
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[joined]
    before = np.concatenate([[True], space[:-1]])
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(space & ~before)
    power, inverse = _powers(len(joined) + 1)
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum((_LOWERED if lower else _RANDOM)[joined] * power[: len(joined)], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return np.split(hashes, np.searchsorted(starts, np.cumsum(sizes)[:-1]))


def in_slices(texts: list[bytes], most: int = 1 << 20):
    """(first, texts) of consecutive texts of about ``most`` bytes together; one longer comes alone."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= most or i + 1 == len(texts):
            yield at, texts[at : i + 1]
            at, size = i + 1, 0


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` word hashes, in order (empty if there are fewer).

    Runs are combined by doubling, so a width of 50 takes about eight vector steps.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return hashes[:0]
    out, done, block, size = None, 0, mixed(hashes + np.uint64(width)), 1
    left = width
    while left:
        if left & 1:
            part = block[done : done + n]
            out = part.copy() if out is None else mixed(out * np.uint64(0x9E3779B97F4A7C15) + part)
            done += size
        left >>= 1
        if left:
            block = mixed(block[:-size] * np.uint64(0xD6E8FEB86659FD93) + block[size:])
            size *= 2
    return out


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a shorter text is one shingle, an empty one none."""
    if not len(hashes):
        return hashes
    return np.unique(rolled(hashes, min(width, len(hashes))))


# --- decisions by row ---------------------------------------------------------------------


def row_key(*columns: Column) -> Column:
    """A 64-bit hash of what a decision about a row rests on; held together with the row's id."""
    return F.xxhash64(F.lit(len(columns)), *[F.coalesce(c.cast("string"), F.lit("\0")) for c in columns])


#: Most decisions that are broadcast, of some 40 bytes each; beyond it they and the rows are joined by a shuffle.
BROADCAST_DECISIONS = 300_000


def decided(docs: DataFrame, decisions: DataFrame, id_col: str, key: Column) -> DataFrame:
    """``docs`` with all its columns after ``decisions(doc_id, row_key, keep, n)``, one row a (doc_id, row_key).

    Rows that no decision names stay, all of them. Of the ``n`` rows that a decision names, keep leaves
    one and its opposite none. Ids may be null.
    """
    named = decisions.select(F.col("doc_id").alias("__d_id"), F.col("row_key").alias("__d_key"), F.col("keep").alias("__d_keep"))
    own = F.col(f"`{id_col}`").cast("long")
    if decisions.count() <= BROADCAST_DECISIONS:
        named = F.broadcast(named)
    met = docs.withColumn("__key", key).join(named, (F.col("__key") == F.col("__d_key")) & own.eqNullSafe(F.col("__d_id")), "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if decisions.where("keep and n > 1").isEmpty():
        return met.where(F.coalesce("__d_keep", F.lit(True))).select(columns)
    one = met.where("__d_keep").withColumn("__id", own).dropDuplicates(["__id", "__key"]).select(columns)
    return met.where("__d_keep is null").select(columns).unionByName(one)


# --- pruning rows by a set of ids ---------------------------------------------------------

BLOOM_PROBES = 4
BLOOM_MOST_BITS = 1 << 26  # 8 MB: the size of the broadcast is bounded whatever the ids are


def _bit(id_col: Column, probe: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(id_col, F.lit(probe)), F.lit(bits))


def bloom_of(ids: DataFrame, bits_per_id: int = 12) -> np.ndarray:
    """A Bloom filter over the one column of ``ids`` as an array of 64-bit words, at most 8 MB."""
    key = ids.columns[0]
    n = max(1, ids.count())
    bits = 1 << min(BLOOM_MOST_BITS.bit_length() - 1, max(10, (n * bits_per_id - 1).bit_length()))
    where = F.explode(F.array(*[_bit(F.col(key).cast("long"), i, bits) for i in range(BLOOM_PROBES)]))
    words = (
        ids.where(F.col(key).isNotNull())
        .select(where.alias("b"))
        .groupBy(F.shiftright("b", 6).alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("m"))
        .toArrow()
    )
    out = np.zeros(bits // 64, np.int64)
    out[words["w"].to_numpy()] = words["m"].to_numpy()
    return out


def maybe_in(df: DataFrame, id_col: str, bloom: np.ndarray, inside: bool = True, then=None, schema=None) -> DataFrame:
    """Rows whose id may be among those of the filter (never loses one that is), and rows without id; or all others.

    The probes are computed in the JVM. ``then``, a function of batches whose rows have ``schema``, may
    follow in the same Python worker.
    """
    spark, bits, columns = df.sparkSession, len(bloom) * 64, df.columns
    held = spark.sparkContext.broadcast(bloom)
    probes = df.withColumn("__probes", F.array(*[_bit(F.col(f"`{id_col}`").cast("long"), i, bits) for i in range(BLOOM_PROBES)]))

    def keep(batches):
        words = held.value.view(np.uint64)
        for batch in batches:
            at = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).astype(np.uint64).reshape(-1, BLOOM_PROBES)
            found = ((words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)
            found |= np.asarray(batch.column(columns.index(id_col)).is_null())
            kept = batch.filter(pa.array(found if inside else ~found))
            if kept.num_rows:
                yield kept.select(range(kept.num_columns - 1))

    return probes.mapInArrow(light(keep if then is None else lambda batches: then(keep(batches))), df.schema if schema is None else schema)


# --- components ---------------------------------------------------------------------------


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``: nodes of one component share a root.

    Each round contracts every node into the neighbour (or itself) that comes first in a
    hashed order, which shrinks any graph, paths too, by a constant share a round; the graph
    and the maps are written tables. Nothing is collected but counts.
    """
    a, b = F.col("a"), F.col("b")
    live = scratch.save(edges.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), f"{name}-e0")
    maps: list[DataFrame] = []
    turn = 0
    while not live.isEmpty():
        both = live.select("a", "b").unionAll(live.select(b.alias("a"), a.alias("b")))
        order = F.struct(F.xxhash64(b, F.lit(turn)).alias("h"), b.alias("v"))
        first = both.groupBy("a").agg(F.min(order).alias("m"))
        own = F.struct(F.xxhash64(a, F.lit(turn)).alias("h"), a.alias("v"))
        to = scratch.save(first.select(a.alias("node"), F.least(own, F.col("m"))["v"].alias("to")), f"{name}-m{turn}")
        maps.append(to)
        moved = (
            live.join(to.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
            .join(to.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
            .where("ta != tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
            .distinct()
        )
        turn += 1
        live = scratch.save(moved, f"{name}-e{turn}")
    if not maps:
        return live.select(a.alias("node"), b.alias("root"))
    out = maps[0].select("node", F.col("to").alias("root"))
    for nxt in maps[1:]:
        out = out.join(nxt.select(F.col("node").alias("root"), F.col("to").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return scratch.save(out, f"{name}-out")


def joined_components(roots: DataFrame, edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) after more ``edges(a, b)``: only those between different roots are worked on."""
    of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}"))
    moved = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    more = components(moved, scratch, name)
    new = more.select("node", F.col("node").alias("root")).join(roots.select("node"), "node", "left_anti")
    both = roots.unionByName(new).join(more.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left")
    return scratch.save(both.select("node", F.coalesce("next", "root").alias("root")), f"{name}-joined")
