"""Exact deduplication by an exchange of Golomb-coded fingerprints.

Every partition sorts the fingerprints of its texts and sends each owner (a range of
fingerprints) its distinct ones as a Golomb-Rice code. Owners answer with one bit per
fingerprint: does it occur twice. Only the texts with a set bit (suspects) are shuffled, by
their bytes, so a fingerprint never decides alone.

A group of copies, however large, sends one fingerprint per partition, and its texts meet in
a partial aggregation first, so no task gets them all.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bloom_of, bytes_of, decided, light, maybe_in, row_key

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HASHES_PER_OWNER = 1 << 23  # 64 MB of raw fingerprints in an owner's task


def rice_encode(sorted_distinct: np.ndarray, start: int, span_bits: int) -> bytes:
    """Golomb-Rice code of ascending 64-bit values from ``start`` within 2**span_bits.

    Layout: the remainder width, the quotients in unary, then the remainders, each stream
    packed to bytes; the gap's power-of-two divisor follows the mean gap.
    """
    n = len(sorted_distinct)
    gaps = np.diff(sorted_distinct, prepend=np.uint64(start))
    width = max(0, span_bits - max(0, n - 1).bit_length())
    quotients = (gaps >> np.uint64(width)).astype(np.int64) if width < 64 else np.zeros(n, np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.ones(int(ends[-1]) + 1 if n else 0, np.uint8)
    unary[ends] = 0
    shifts = np.arange(width - 1, -1, -1, dtype=np.uint64)
    # a multiple of eight values at a time, so that every part ends with a whole byte
    parts = [np.packbits(((gaps[at : at + 8192, None] >> shifts[None, :]) & np.uint64(1)).astype(np.uint8).ravel()) for at in range(0, n, 8192)]
    head = np.packbits(unary)
    return bytes([width]) + len(head).to_bytes(8, "little") + head.tobytes() + b"".join(p.tobytes() for p in parts)


def rice_decode(code: bytes, n: int, start: int) -> np.ndarray:
    """The ``n`` values that rice_encode was given."""
    width, size = code[0], int.from_bytes(code[1:9], "little")
    unary = np.unpackbits(np.frombuffer(code, np.uint8, size, 9))
    ends = np.flatnonzero(unary == 0)[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(code, np.uint8, -1, 9 + size))[: n * width].reshape(n, width)
    low = np.zeros(n, np.uint64)
    for column in bits.T:
        low = (low << np.uint64(1)) | column
    gaps = (quotients.astype(np.uint64) << np.uint64(width)) | low if width < 64 else low
    return np.cumsum(gaps, dtype=np.uint64) + np.uint64(start)


SENT = "sender int, owner int, doc_id long, fp long, text_sha256 string, n int, code binary, twice binary"


def _send(owner_bits: int):
    """Per partition: a row for each document, then a message for each owner."""

    def run(batches):
        sender, seen = TaskContext.get().partitionId(), []
        shift = np.uint64(64 - owner_bits)
        for batch in batches:
            digests = [hashlib.sha256(t.lower()).digest() for t in bytes_of(batch.column("text"))]
            fps = np.frombuffer(b"".join(d[:8] for d in digests), ">u8").astype(np.uint64)
            seen.append(fps)
            n = len(fps)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, sender, np.int32)),
                    pa.nulls(n, pa.int32()),
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(fps.view(np.int64)),
                    pa.array([d.hex() for d in digests], pa.string()),
                    pa.nulls(n, pa.int32()),
                    pa.nulls(n, pa.binary()),
                    pa.nulls(n, pa.binary()),
                ],
                names=["sender", "owner", "doc_id", "fp", "text_sha256", "n", "code", "twice"],
            )
        if not seen:
            return
        values, counts = np.unique(np.concatenate(seen), return_counts=True)
        owners = (values >> shift).astype(np.int64) if owner_bits else np.zeros(len(values), np.int64)
        rows = []
        for owner in np.unique(owners):
            mine = owners == owner
            start = int(owner) << int(shift) if owner_bits else 0
            rows.append((int(owner), int(mine.sum()), rice_encode(values[mine], start, 64 - owner_bits), np.packbits(counts[mine] > 1).tobytes()))
        k = len(rows)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(k, sender, np.int32)),
                pa.array([r[0] for r in rows], pa.int32()),
                pa.nulls(k, pa.int64()),
                pa.nulls(k, pa.int64()),
                pa.nulls(k, pa.string()),
                pa.array([r[1] for r in rows], pa.int32()),
                pa.array([r[2] for r in rows], pa.binary()),
                pa.array([r[3] for r in rows], pa.binary()),
            ],
            names=["sender", "owner", "doc_id", "fp", "text_sha256", "n", "code", "twice"],
        )

    return run


def _answer(owner_bits: int):
    """An owner's answer to all its messages: a bit for each fingerprint that occurs twice."""

    def run(key, table):
        owner = key[0].as_py()
        start = owner << (64 - owner_bits) if owner_bits else 0
        ns = table.column("n").to_pylist()
        lists = [rice_decode(c, n, start) for c, n in zip(table.column("code").to_pylist(), ns)]
        own = [np.unpackbits(np.frombuffer(b, np.uint8))[:n].astype(bool) for b, n in zip(table.column("twice").to_pylist(), ns)]
        everything = np.concatenate(lists)
        _, back, counts = np.unique(everything, return_inverse=True, return_counts=True)
        twice = (counts[back] > 1) | np.concatenate(own)
        parts = np.split(twice, np.cumsum(ns)[:-1])
        return pa.table({"sender": table.column("sender"), "owner": table.column("owner"), "bitmap": pa.array([np.packbits(p).tobytes() for p in parts], pa.binary())})

    return run


def _suspects(owner_bits: int):
    """Back at the senders: the fingerprints whose bit is set."""

    def run(batches):
        for batch in batches:
            for sender, owner, n, code, bitmap in zip(*(batch.column(c).to_pylist() for c in ("sender", "owner", "n", "code", "bitmap"))):
                bits = np.unpackbits(np.frombuffer(bitmap, np.uint8))[:n].astype(bool)
                if bits.any():
                    fps = rice_decode(code, n, owner << (64 - owner_bits) if owner_bits else 0)[bits]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), sender, np.int32)), pa.array(fps.view(np.int64))], names=["sender", "fp"])

    return run


def _lowered(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([t.lower() for t in bytes_of(batch.column("text"))], pa.binary())], names=["doc_id", "body"])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashes_per_owner: int = HASHES_PER_OWNER) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; the largest id of a group stays.
    Null text counts as empty, an empty text is a text like any other. A null id never wins
    over another id; a group of null ids only has keep_id null and is kept. Rows that repeat an
    id with an equal text are counted in group_size and flagged alike. An empty table gives no
    rows. Other columns of ``docs``, whatever their names, play no part.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    owner_bits = max(0, (rows.count() // hashes_per_owner).bit_length())
    sent = scratch.save(rows.mapInArrow(light(_send(owner_bits)), SENT), "sent")
    documents, messages = sent.where("owner is null"), sent.where("owner is not null")

    answers = messages.select("sender", "owner", "n", "code", "twice").groupBy("owner").applyInArrow(_answer(owner_bits), "sender int, owner int, bitmap binary")
    suspects = messages.select("sender", "owner", "n", "code").join(answers, ["sender", "owner"]).mapInArrow(_suspects(owner_bits), "sender int, fp long")
    found = documents.select("sender", "fp", "doc_id").join(suspects, ["sender", "fp"]).select("doc_id")
    ids = scratch.save(found, "suspects")

    bodies = maybe_in(rows, "doc_id", bloom_of(ids), then=_lowered, schema="doc_id long, body binary")
    groups = (
        bodies.groupBy("body")
        .agg(F.count(F.lit(1)).alias("size"), F.max("doc_id").alias("keep"))
        .where("size > 1")
        .select(F.sha2("body", 256).alias("text_sha256"), "size", "keep")
    )
    return (
        documents.select("doc_id", "text_sha256")
        .join(groups, "text_sha256", "left")
        .select(
            "doc_id",
            F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
            F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
            F.col("doc_id").eqNullSafe(F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep"))).alias("kept"),
            "text_sha256",
        )
    )


def keep_one_per_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns; of the rows with equal texts, one stays: one with the largest id.

    The decision is by row: equal ids with unlike texts don't touch each other, of equal rows with
    the winning id one stays, and a row without id stays only where its text has no row with one.
    """
    scratch = Scratch(docs.sparkSession, "exact-stage")
    found = exact_duplicates(docs, id_col, text_col).where("group_size > 1").groupBy("doc_id", "text_sha256")
    known = scratch.save(found.agg(F.first("kept").alias("keep"), F.count(F.lit(1)).alias("n")), "groups")
    key = row_key(F.sha2(F.translate(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), UPPER, UPPER.lower()), 256))
    return decided(docs, known.select("doc_id", row_key(F.col("text_sha256")).alias("row_key"), "keep", "n"), id_col, key)


OP7_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents
), g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY body)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.body) AS text_sha256
FROM n JOIN g ON n.body = g.body
"""


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
