"""Exact top-k inner products by a three-phase uniform threshold.

The components of the vectors are cut into ``SLICES``; a slice of a block of
candidates is a node that has a part of each inner product.

1. Every block lists its best parts of one slice, each block another slice, and
   the totals of the few rows listed. The k-th best total of all lists is a safe
   cutoff: at least k candidates reach it.
2. The cutoff is broadcast. Blocks go through their slices in order. A pair goes
   on only while what it has so far and the most that the other slices can give
   (the product of the lengths there) reach the cutoff. A slice collects a pair
   if its part is at least cutoff / slices: one that no slice collects stays below.
3. Once few pairs are left, they are resolved exactly one by one. What leaves a
   task are its k best per query of the pairs that reach the cutoff, few in all.

Queries are taken in groups of bounded size, blocks of candidates where they lie.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLICES = 4
#: Bytes of query vectors that are broadcast at a time.
GROUP_BYTES = 1 << 25
#: Candidates and queries that a worker multiplies at a time.
BLOCK, QUERY_BLOCK = 4_096, 256


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and floor(scale * component) of vectors that take part.

    Null ids, null vectors and vectors with null or non-finite components don't.
    """
    v = vectors.selectExpr("cast(vec_id as long) vec_id", "cast(embedding as array<double>) v")
    usable = v.where("vec_id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    return usable.select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))


def _most(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]


def _bounded(a: np.ndarray, b: np.ndarray) -> None:
    if _most(a, b) >= 2**57:
        raise ValueError("components are too large for scores of 64 bits")


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of rows, in floating point where 53 bits are enough."""
    if _most(a, b) < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _blocks(batches):
    """(ids, matrix) of at most BLOCK vectors of one dimension each."""
    for batch in batches:
        ids = batch.column("vec_id").to_numpy()
        column = batch.column("v")
        sizes = column.value_lengths().to_numpy()
        values = column.flatten().to_numpy()
        starts = np.cumsum(sizes) - sizes
        for d in np.unique(sizes):
            own = np.flatnonzero(sizes == d)
            for i in range(0, len(own), BLOCK):
                at = own[i : i + BLOCK]
                yield ids[at], values[starts[at][:, None] + np.arange(d)]


def _slices(d: int) -> list[slice]:
    cuts = np.linspace(0, d, min(SLICES, d) + 1).astype(int)
    return [slice(a, b) for a, b in zip(cuts, cuts[1:])]


#: Share of pairs of a block below which they are taken one by one.
SPARSE = 1 / 16
_NONE = np.iinfo(np.int64).min

PHASE_1 = "query int, score long"
PHASE_3 = "query int, query_id long, vec_id long, score long"


def _pairs(q: np.ndarray, rows: np.ndarray, matrix: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Exact products of pairs (rows of q, rows of matrix), some at a time."""
    out = np.empty(len(rows), np.int64)
    step = max(1, (1 << 20) // max(1, q.shape[1]))
    for i in range(0, len(rows), step):
        out[i : i + step] = (q[rows[i : i + step]] * matrix[at[i : i + step]]).sum(axis=1)
    return out


def _lengths(x: np.ndarray, parts: list[slice]) -> np.ndarray:
    return np.sqrt(np.stack([(x[:, s].astype(np.float64) ** 2).sum(axis=1) for s in parts], axis=1))


def _listed(q: np.ndarray, itself: np.ndarray, matrix: np.ndarray, part: slice, k: int) -> np.ndarray:
    """Totals of the rows whose parts in one slice are each query's k best; _NONE where there are fewer."""
    scores = _product(q[:, part], matrix[:, part])
    scores[itself] = _NONE
    k = min(k, matrix.shape[0])
    at = np.argpartition(scores, matrix.shape[0] - k, axis=1)[:, matrix.shape[0] - k :]
    rows = np.repeat(np.arange(len(q)), k)
    totals = _pairs(q, rows, matrix, at.ravel()).reshape(len(q), k)
    return np.where(np.take_along_axis(itself, at, axis=1), _NONE, totals)


def _reaching(q: np.ndarray, itself: np.ndarray, matrix: np.ndarray, cutoff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of the pairs whose scores reach their query's cutoff."""
    parts = _slices(matrix.shape[1])
    m = len(parts)
    q_len, c_len = _lengths(q, parts), _lengths(matrix, parts)
    share = np.where(cutoff == _NONE, _NONE, -(-cutoff // m))  # some part is at least this
    low = cutoff.astype(np.float64)
    low -= 1e-9 * np.abs(low) + 2  # lengths are rounded
    known = collected = None
    alive = ~itself
    for j, s in enumerate(parts):
        scores = _product(q[:, s], matrix[:, s])
        known = scores if known is None else known + scores
        entry = scores >= share[:, None]
        collected = entry if collected is None else collected | entry
        if j + 1 == m:
            break
        most = q_len[:, j + 1 :] @ c_len[:, j + 1 :].T
        alive &= known + most >= low[:, None]
        if np.count_nonzero(alive) < SPARSE * alive.size:
            rows, at = np.nonzero(alive)
            rest = slice(parts[j + 1].start, None)
            totals = known[rows, at] + _pairs(q[:, rest], rows, matrix[:, rest], at)
            reach = totals >= cutoff[rows]
            return rows[reach], at[reach], totals[reach]
    rows, at = np.nonzero(alive & collected & (known >= cutoff[:, None]))
    return rows, at, known[rows, at]


def _ranked(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of each row's k best scores, ties to the smaller id."""
    by = np.lexsort((ids, -scores, rows))
    first = np.r_[True, rows[by][1:] != rows[by][:-1]] if len(by) else np.empty(0, bool)
    rank = np.arange(len(by)) - np.maximum.accumulate(np.where(first, np.arange(len(by)), 0)) if len(by) else by
    return by[rank < k]


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best pairs of each query id.

    Candidates of a query row are all rows with another vec_id and as many
    components. Repeated rows count each, those of a query too: a pair of rows is
    one of its id's pairs. Queries without a candidate give no rows. Vectors so large that
    parts of a score may pass 57 bits are an error.
    """
    spark = vectors.sparkSession
    own = quantised(vectors, scale)
    queries = own.where(is_query)
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    per_group = max(1, GROUP_BYTES // (8 * (size.d or 1)))
    n_groups = max(1, -(-size.n // per_group))
    results = None
    for g in range(n_groups):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_groups)) == g) if n_groups > 1 else queries
        found = _group(own, rows.collect(), k, spark)  # bounded by GROUP_BYTES
        results = found if results is None else results.unionByName(found)
    # Rows of one query id are of one group; the k best pairs are among the k best of each row.
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = results.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _group(own: DataFrame, rows: list, k: int, spark) -> DataFrame:
    by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for d in {len(r.v) for r in rows}:
        numbers = [i for i, r in enumerate(rows) if len(r.v) == d]
        by_size[d] = np.array(numbers, np.int32), np.array([rows[i].vec_id for i in numbers], np.int64), np.array([rows[i].v for i in numbers], np.int64)
    sent = spark.sparkContext.broadcast(by_size)

    def meetings(batches):
        """Blocks of candidates and blocks of queries of as many components."""
        for n, (ids, matrix) in enumerate(_blocks(batches), TaskContext.get().partitionId()):
            numbers, query_ids, q = sent.value.get(matrix.shape[1], ((), (), ()))
            for a in range(0, len(q), QUERY_BLOCK):
                own_q, own_ids = q[a : a + QUERY_BLOCK], query_ids[a : a + QUERY_BLOCK]
                _bounded(own_q, matrix)
                yield n, ids, matrix, numbers[a : a + QUERY_BLOCK], own_ids, own_q, ids[None, :] == own_ids[:, None]

    def gather(batches):
        """Phase 1: the k best totals that the lists of a task's blocks give each query."""
        held = np.full((len(rows_of), k), _NONE)
        for n, _, matrix, numbers, _, q, itself in meetings(batches):
            parts = _slices(matrix.shape[1])
            both = np.concatenate([held[numbers], _listed(q, itself, matrix, parts[n % len(parts)], k)], axis=1)
            held[numbers] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        known = held != _NONE
        if known.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(held), dtype=np.int32), known.sum(axis=1))), pa.array(held[known])], ["query", "score"])

    rows_of = range(len(rows))
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score")))
    kth = own.mapInArrow(gather, PHASE_1).withColumn("r", rank).where(F.col("r") == k)
    # One row per query of the group: bounded, like the group. Fewer than k listed: no cutoff.
    cutoffs = np.full(len(rows), _NONE)
    for r in kth.select("query", "score").collect():
        cutoffs[r.query] = r.score
    safe = spark.sparkContext.broadcast(cutoffs)

    def resolve(batches):
        """Phases 2 and 3; a task's results are merged before they leave it."""
        held = [np.empty(0, np.int64)] * 4  # query, query_id, vec_id, score
        for _, ids, matrix, numbers, query_ids, q, itself in meetings(batches):
            found, at, scores = _reaching(q, itself, matrix, safe.value[numbers])
            best = _ranked(found, ids[at], scores, k)
            found, at, scores = found[best], at[best], scores[best]
            held = [np.concatenate(pair) for pair in zip(held, (numbers[found].astype(np.int64), query_ids[found], ids[at], scores))]
            if len(held[0]) > 4 * k * len(rows_of):
                keep = _ranked(held[0], held[2], held[3], k)
                held = [x[keep] for x in held]
        keep = _ranked(held[0], held[2], held[3], k)
        if len(keep):
            yield pa.RecordBatch.from_arrays([pa.array(x[keep], t) for x, t in zip(held, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["query", "query_id", "vec_id", "score"])

    return own.mapInArrow(resolve, PHASE_3)
