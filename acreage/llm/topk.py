"""Exact nearest rows by inner product: vertical blocks of dimensions with bounds on what is left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acreage.llm.common import Scratch

ROWS, QUERIES, TILE, STEP = 2048, 512, 32, 16
_BLOCKS = pa.schema([("dims", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())])
_TOP = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantise(values: np.ndarray) -> np.ndarray:
    """floor(256 x) of each component, as double."""
    return np.floor(256.0 * values.astype(np.float64)).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Rows of equal length in blocks, dimension by dimension; ids ascend in a block."""
    held: dict[int, list] = {}

    def block(dims: int) -> pa.RecordBatch:
        ids, vectors = zip(*sorted(held.pop(dims), key=lambda x: x[0]))
        return pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                                           pa.array([np.ascontiguousarray(np.array(vectors, np.int64).T).tobytes()], pa.binary())], schema=_BLOCKS)

    for batch in batches:
        for name, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if name is None or vector is None or None in vector:
                continue
            values = np.array(vector, np.float64)
            if np.isfinite(values).all():
                held.setdefault(len(vector), []).append((name, quantise(values)))
                if len(held[len(vector)]) >= rows:
                    yield block(len(vector))
    for dims in list(held):
        yield block(dims)


def best_of(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """The ``k`` best rows of one block for a tile of queries (both dimension by dimension), as (query, id, score).

    Dimensions go in blocks of STEP, those with the most mass first. After each block the Cauchy-Schwarz bound on the rest gives each
    candidate a lowest and a highest possible score; candidates that no query can still need are dropped and the columns are compacted.
    ``floor`` has for each query a score that k rows elsewhere reach.
    """
    dims = len(data)
    order = np.argsort(-((data.astype(np.float64) ** 2).sum(1)), kind="stable")
    # products stay exact in doubles below 2^53; larger values are summed as integers
    exact = dims * float(np.abs(data).max(initial=0)) * float(np.abs(queries).max(initial=0)) < 2**53
    kind = np.float64 if exact else np.int64
    q, c = queries[order].astype(kind), data[order].astype(kind)
    q_left, c_left = ((x.astype(np.float64) ** 2)[::-1].cumsum(0)[::-1] for x in (q, c))
    alive = np.arange(len(ids))
    sums = np.zeros((q.shape[1], len(ids)), kind)
    floor = np.full(q.shape[1], -np.inf) if floor is None else floor
    for start in range(0, dims, STEP):
        sums += q[start:start + STEP].T @ c[start:start + STEP]
        if start + STEP >= dims or len(alive) <= k + 1:
            continue
        rest = np.sqrt(np.outer(q_left[start + STEP], c_left[start + STEP])) * (1 + 1e-9) + 1
        low = sums - rest
        low[query_ids[:, None] == ids[alive]] = -np.inf  # a query's own row backs no bound
        least = np.maximum(floor, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
        needed = (sums + rest >= least[:, None]).any(0)
        if needed.sum() < 0.8 * len(alive):
            alive, sums, c, c_left = alive[needed], sums[:, needed], c[:, needed], c_left[:, needed]
    out = []
    for i, query in enumerate(query_ids):
        good = np.flatnonzero((ids[alive] != query) & (sums[i] >= floor[i]))
        if len(good) > 4 * k:  # ties at the k-th score all stay for the sort below
            score = sums[i, good]
            good = good[score >= np.partition(score, len(score) - k)[len(score) - k]]
        for j in good[np.lexsort((ids[alive][good], -sums[i, good]))][:k]:
            out.append((int(query), int(ids[alive][j]), int(sums[i, j])))
    return out


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    bar: dict[int, list[int]] = {}  # the best scores of a query so far in this task, forgotten when there are many queries
    for batch in batches:
        for row in batch.to_pylist():
            dims = row["dims"]
            ids, query_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["query_ids"], np.int64)
            data = np.frombuffer(row["data"], np.int64).reshape(dims, len(ids))
            queries = np.frombuffer(row["queries"], np.int64).reshape(dims, len(query_ids))
            found = []
            for a in range(0, len(query_ids), TILE):
                names = query_ids[a:a + TILE]
                floor = np.array([bar[n][0] if len(bar.get(n, ())) == k else -np.inf for n in names.tolist()])
                found += best_of(queries[:, a:a + TILE], names, data, ids, k, floor)
            if len(bar) > 100_000:
                bar.clear()
            for query, _, score in found:
                bar[query] = sorted([*bar.get(query, ()), score])[-k:]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], schema=_TOP)


def top_k(vectors: DataFrame, scratch: Scratch, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, the ``k`` rows with the highest integer inner product.

    Components become floor(256 x). Every other row is a candidate; ties go to the smaller id; with fewer rows all are given. Rows with a null id, a null vector or
    a null or non-finite component take no part; a row is compared with rows of the same length; rows that share an id
    are candidates of their own, and as a query the smallest of their vectors asks, not against any of them. Further columns are not read; an empty table gives an empty table.

    Rows are packed into vertical blocks of 2,048. The blocks of queries are sent to each block of candidates (one pair of blocks is one row), which
    gives at most ``k`` rows for a query; those are ranked by query. A task never needs more than one pair of blocks in memory.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"))
    packed = "dims int, ids binary, data binary"
    blocks = scratch.put(rows.mapInArrow(lambda it: _blocks(it, ROWS), packed).withColumn("number", F.monotonically_increasing_id()))
    valid = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    asking = rows.filter((F.col("id") % every == 0) & valid).groupBy("id").agg(F.min("vector").alias("vector")) \
        .mapInArrow(lambda it: _blocks(it, QUERIES), packed).select("dims", F.col("ids").alias("query_ids"), F.col("data").alias("queries"))
    numbers = blocks.groupBy("dims").agg(F.collect_list("number").alias("numbers"))  # one number for 2,048 rows
    dealt = scratch.put(asking).join(numbers, "dims").select("query_ids", "queries", F.explode("numbers").alias("number"))
    pairs = blocks.join(dealt, "number").select("dims", "ids", "data", "query_ids", "queries")
    found = pairs.mapInArrow(lambda it: _search(it, k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
