"""Nearest neighbours by a block matrix join of quantised vectors.

Queries and candidates are dealt to a grid of tiles. A tile multiplies int8 rows (as float32, in
which these sums of products are exact) and gets every cosine with a bound on its quantisation
error. A pair survives if its cosine may reach the query's fifth best of the tile for sure;
survivors are recomputed from the original vectors in double precision. Heaps merge the tiles.

Each query meets each candidate, so the answer is exact; a tile's memory is bounded by its two
block sizes. Equal vectors count once in a tile, with their smallest ids.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

CANDIDATE_BLOCK = 4096
#: Bytes of a query block's vectors, and its rows at least and at most: the wider it is, the fewer copies of candidates move.
QUERY_BYTES, LEAST_QUERIES, MOST_QUERIES = 16 << 20, 1024, 16_384


def _matrix(column) -> np.ndarray:
    """Rows of a list column as a matrix of doubles."""
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, scales, norms of the rows they stand for, norms of what they miss; of the unit vectors."""
    unit = vectors / _norms(vectors)[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    whole = np.rint(unit / scale[:, None])
    held = whole * scale[:, None]
    return whole.astype(np.int8), scale, np.linalg.norm(held, axis=1), np.linalg.norm(unit - held, axis=1)


def _norms(vectors: np.ndarray) -> np.ndarray:
    """Euclidean norms, safe for very small and very large components."""
    top = np.abs(vectors).max(axis=1)
    return top * np.sqrt(np.square(vectors / top[:, None]).sum(axis=1))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """int8 rows' products; up to 1040 columns a float32 holds them exactly, so more go in parts."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], 1024):
        out += a[:, at : at + 1024].astype(np.float32) @ b[:, at : at + 1024].astype(np.float32).T
    return out


def _tile(k: int):
    def run(key, left, right):
        names = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            q, c = _matrix(left.column("vector")), _matrix(right.column("vector"))
            q_ids, c_ids = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
            by = np.argsort(c_ids, kind="stable")
            c, c_ids = c[by], c_ids[by]
            # of equal vectors the k + 1 smallest ids are enough: one may be the query's own
            _, group = np.unique(np.ascontiguousarray(c + 0.0).view([("", c.dtype)] * c.shape[1]).ravel(), return_inverse=True)
            order = np.argsort(group, kind="stable")
            first = np.r_[True, group[order][1:] != group[order][:-1]]
            nth = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
            keep = np.sort(order[nth <= k])
            c, c_ids = c[keep], c_ids[keep]
            q8, q_scale, q_held, q_miss = quantised(q)
            c8, c_scale, c_held, c_miss = quantised(c)
            q_norm, c_norm = _norms(q), _norms(c)
            for at in range(0, len(q), 256):
                part = slice(at, at + 256)
                near = _products(q8[part], c8) * q_scale[part, None] * c_scale[None, :]
                bound = q_held[part, None] * c_miss[None, :] + q_miss[part, None] * (c_held + c_miss)[None, :] + 1e-9
                near[q_ids[part, None] == c_ids[None, :]] = -np.inf
                sure = near - bound
                if len(c) > k:
                    least = np.partition(sure, len(c) - k, axis=1)[:, len(c) - k]
                else:
                    least = np.full(len(near), -np.inf)
                row, col = np.nonzero((near + bound >= least[:, None]) & (near > -np.inf))
                for step in range(0, len(row), 100_000):
                    r, s = row[step : step + 100_000], col[step : step + 100_000]
                    exact = ((q[part][r] / q_norm[part][r, None]) * (c[s] / c_norm[s, None])).sum(axis=1)
                    got.append((q_ids[part][r], c_ids[s], exact))
        if not got:
            return pa.table({n: pa.array([], t) for n, t in names.items()})
        qs, cs, scores = (np.concatenate(x) for x in zip(*got))
        by = np.lexsort((cs, -scores, qs))
        qs, cs, scores = qs[by], cs[by], scores[by]
        first = np.r_[True, qs[1:] != qs[:-1]]
        nth = np.arange(len(qs)) - np.maximum.accumulate(np.where(first, np.arange(len(qs)), 0))
        best = nth < k
        return pa.table({n: pa.array(x[best], t) for (n, t), x in zip(names.items(), (qs, cs, scores))})

    return run


def _merge(k: int):
    """A heap of the ``k`` best for each query of the partition."""

    def run(batches):
        heaps: dict[int, list] = {}
        for batch in batches:
            for query, vec, score in zip(*(batch.column(n).to_pylist() for n in ("query_id", "vec_id", "score"))):
                heap = heaps.setdefault(query, [])
                (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (score, -vec))
        rows = [(q, i + 1, -v, s) for q, heap in heaps.items() for i, (s, v) in enumerate(sorted(heap, reverse=True))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.float64()))], names=["query_id", "rank", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int | None = None, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """The ``k`` rows of ``vectors`` of largest cosine for each row of ``queries``: query_id, rank, vec_id, score.

    Both tables have ``id_col`` and ``vector_col``; a query never gets the row of its own id. Ties go
    to the smaller id. Null, empty and zero vectors, those with null or non-finite components, of
    another length than most of ``vectors``, or without an id, take no part. Rows that repeat an id
    and a vector count once. Queries without any candidate, and empty tables, give no rows. Other
    columns play no part.
    """
    scratch = Scratch(vectors.sparkSession, "nearest")
    vector = F.col(f"`{vector_col}`").cast("array<double>")

    def usable(df):
        """Rows that take part, once each: a repeated one would fill a tile's places and heaps."""
        v = F.col("vector")
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vector.alias("vector")).where(F.col("vec_id").isNotNull() & v.isNotNull() & fine).distinct()

    candidates = usable(vectors)
    lengths = candidates.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    dim, n = (lengths["d"], lengths["n"]) if lengths else (1, 0)
    candidates = candidates.where(F.size("vector") == dim)
    asked = usable(queries).where(F.size("vector") == dim)
    query_block = query_block or min(MOST_QUERIES, max(LEAST_QUERIES, QUERY_BYTES // (8 * max(1, dim))))
    across = max(1, -(-n // candidate_block))
    down = max(1, -(-asked.count() // query_block))

    def grid(df, own, other):
        """A row of its own block for every block of the other side; the tile is one number."""
        return df.withColumn("mine", F.pmod(F.xxhash64("vec_id"), F.lit(own))).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.lit(other - 1))))

    q = grid(asked, down, across).select((F.col("mine") * across + F.col("theirs")).alias("tile"), "vec_id", "vector")
    c = grid(candidates, across, down).select((F.col("theirs") * across + F.col("mine")).alias("tile_of"), "vec_id", "vector")
    best = q.groupBy("tile").cogroup(c.groupBy("tile_of")).applyInArrow(_tile(k), "query_id long, vec_id long, score double").dropDuplicates(["query_id", "vec_id", "score"])  # an id of several vectors may meet one of equal score twice
    best = scratch.save(best, "best")
    return best.repartition("query_id").mapInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")


OP1_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""


def op1_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))
