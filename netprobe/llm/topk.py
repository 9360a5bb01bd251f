"""Exact top-k inner products by aggregation without random access.

Vectors are held as integers, floor(256 x). Queries meet all rows block against block; in a block, every
component is a list sorted by its value, read from the end that the sign of the query's component
favours. A row's score lies between two bounds: what was read of it, plus for each component not yet
read the list's worst value (below) or the value read last (above). A query stops reading when few rows
are left whose upper bound reaches the k-th lower bound; their scores are then resolved from whole
vectors. Rows outside can't qualify, so the answer is exact, ties included.

The bounds of a whole block are two matrix products a step: the vectors, with what is unread replaced
by the list's worst or last value, times the positive and the negative part of the queries.

Defined results: vectors that are null or hold a null, NaN or infinity take no part, nor do rows without
an id; vectors of different lengths are compared over the components that both have; a repeated row is
a candidate (and a query) of its own, but rows that share the query's id aren't its candidates; ties go
to the smaller id; scores beyond 64 bits become the largest or smallest long; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netprobe.llm.common import materialize, read_table

SCALE, K, EVERY = 256, 5, 50
#: Rows and queries of a block.
ROWS, QUERIES = 4096, 1024
#: Shares of the lists after which bounds are compared.
DEPTHS = (0.25, 0.5, 0.75, 0.875, 0.9375, 1.0)
#: A query's rows are resolved when no more than this share of a block is left (or k rows).
LEFT = 1 / 64
#: Numbers of one matrix of bounds.
_CELLS = 1 << 21
_LONG = np.iinfo(np.int64)


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(256 x); Python's integers where a double is not exact."""
    with np.errstate(over="ignore"):
        out = np.floor(vectors * float(SCALE))
    if out.size and not np.abs(out).max() < 2.0**52:
        return np.array([[int(x) * SCALE if abs(x) >= 2.0**44 else int(np.floor(x * SCALE)) for x in row] for row in vectors.tolist()], object).reshape(vectors.shape)
    return out


def exact_kind(a: np.ndarray, b: np.ndarray) -> type:
    """The narrowest type in which all sums of products of a and b are exact."""
    if not a.size or not b.size:
        return np.float64
    most = 2 * a.shape[1] * int(np.abs(a).max()) * int(np.abs(b).max())
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object


def bounds(parts: np.ndarray, order: np.ndarray, rows: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) scores, queries x rows, when ``depth`` entries of each list are read. ``parts``: the
    queries' positive and negative components side by side."""
    n, d = rows.shape
    kind = parts.dtype
    columns = np.arange(d)
    low, high = np.empty((n, 2 * d), kind), np.empty((n, 2 * d), kind)
    for half, read in enumerate((order[n - depth :], order[:depth])):  # from the largest values down, from the smallest up
        last, worst = (read[0], order[0]) if half == 0 else (read[-1], order[-1])
        own = slice(half * d, half * d + d)
        low[:, own], high[:, own] = rows[worst, columns], rows[last, columns]
        for out in (low, high):
            out[read, columns + half * d] = rows[read, columns]
    out = parts @ low.T, parts @ high.T
    return tuple(np.clip(x, _LONG.min, _LONG.max) for x in out) if kind == object else out


def best_of_block(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int = K, depths: tuple[float, ...] = DEPTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's k best rows of the block, as places in the arguments; ties to the smaller id."""
    kind = exact_kind(queries, rows)
    queries, rows = queries.astype(kind), rows.astype(kind)
    n, found = len(rows), []
    order = np.argsort(rows, axis=0, kind="stable")
    zero = np.zeros(1, kind)[0]
    parts = np.hstack([np.maximum(queries, zero), np.minimum(queries, zero)])
    todo = np.arange(len(queries))
    for share in depths:
        depth, still = min(n, max(1, int(np.ceil(n * share)))), []
        step = max(1, _CELLS // max(1, n))
        for i in range(0, len(todo), step):
            some = todo[i : i + step]
            lower, upper = bounds(parts[some], order, rows, depth)
            own = query_ids[some][:, None] == row_ids[None, :]
            candidates = n - own.sum(axis=1)
            floor = np.where(own, -np.inf, lower) if kind is not object else np.where(own, lower.min() - 1, lower)
            kth = np.partition(floor, n - k, axis=1)[:, n - k] if n > k and kind is not object else np.sort(floor, axis=1)[:, max(0, n - k)]
            reach = ~own & ((upper >= kth[:, None]) | (candidates <= k)[:, None])
            stop = (reach.sum(axis=1) <= max(k, int(n * LEFT))) | (candidates <= k)
            if depth == n:
                stop[:] = True
            q, r = np.nonzero(reach & stop[:, None])
            q = some[q]
            score = np.empty(len(q), kind)  # resolved from whole vectors
            for j in range(0, len(q), _CELLS // 16):
                score[j : j + _CELLS // 16] = (queries[q[j : j + _CELLS // 16]] * rows[r[j : j + _CELLS // 16]]).sum(axis=1)
            score = (np.clip(score, _LONG.min, _LONG.max) if kind is object else score).astype(np.int64)
            ranked = np.lexsort((row_ids[r], ~score, q))
            q, r, score = q[ranked], r[ranked], score[ranked]
            first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
            place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
            found.append((q[place < k], r[place < k], score[place < k]))
            still.append(some[~stop])
        todo = np.concatenate(still) if still else todo[:0]
        if not len(todo):
            break
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists as rows of a matrix; what is missing at a list's end is 0."""
    vectors = vectors.combine_chunks()
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def usable(vector: Column) -> Column:
    """Whether no component is null, NaN or infinite."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def search(rows: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row whose vec_id is divisible by ``every``.

    Rows are dealt evenly into blocks whatever they hold; a task has one block of each, whose best k a
    query are merged by the query's row."""
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    own = own.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).withColumn("_row", F.monotonically_increasing_id())
    own = materialize(own, "topk-rows")
    asked = own.filter(F.col("vec_id") % every == 0)
    n_rows, n_asked = max(1, -(-own.count() // ROWS)), max(1, -(-asked.count() // QUERIES))
    block = lambda n: F.pmod(F.xxhash64("_row"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("_q", block(n_asked)).withColumn("_c", each(n_rows))
    # names of its own: columns that both sides of a cogroup share are pruned from one of them
    right = own.select(F.col("vec_id").alias("other_id"), F.col("embedding").alias("other"), block(n_rows).alias("_c"), each(n_asked).alias("_q"))
    fields = pa.schema([("_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(some: pa.Table, block: pa.Table) -> pa.Table:
        if not len(some) or not len(block):
            return fields.empty_table()
        vectors = some["embedding"], block["other"]
        width = max(int(np.diff(v.combine_chunks().offsets.to_numpy()).max()) for v in vectors)
        q, x = (integers(matrix(v, width)) for v in vectors)
        ids, row_ids = some["vec_id"].to_numpy(), block["other_id"].to_numpy()
        at, to, score = best_of_block(q, ids, x, row_ids, k)
        return pa.Table.from_arrays([pa.array(some["_row"].to_numpy()[at]), pa.array(ids[at]), pa.array(row_ids[to]), pa.array(score)], schema=fields)

    found = left.groupBy("_q", "_c").cogroup(right.groupBy("_q", "_c")).applyInArrow(run, "_row long, query_id long, vec_id long, score long")
    best = W.partitionBy("_row").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH own AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v, row_number() OVER () AS r
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.r, q.vec_id AS query_id, o.vec_id, list_dot_product(q.v, o.v)::BIGINT AS score
    FROM own q JOIN own o ON q.vec_id <> o.vec_id
    WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
