"""Exact top-k inner-product search with multi-resolution segment statistics.

A vector is cut into segments; for a segment of length l with means and
deviations (m, s), Cauchy-Schwarz gives q.x <= l * (mq*mx + sq*sx), the same as
the lower bound l * ((mq-mx)^2 + (sq-sx)^2) of the squared distance. Summed over
the segments it bounds the whole score from above, the closer the finer the
segments. From coarse to fine, candidates whose bound is below the k-th best
score known so far are dropped; exact scores are computed for the survivors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import arrow_map, only, saved, ship, to_batch

K = 5
#: Rows that are compared with at a time.
ROW_BLOCK = 4096
LEVELS = (4, 16)
#: Bytes of queries that may go to every task; more are dealt in groups of this size.
QUERY_BYTES = 16 << 20
#: Bytes of rows of a task where they are dealt.
PART_BYTES = 32 << 20
_HIT = "qrow long, query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v array<double> of floor(scale * x); rows with a null id, vector or component, or one that isn't finite, take no part."""
    v = only(vectors, vec_id="bigint", embedding="array<double>")
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # floor() of a double gives a long, which saturates; ceil and floor of a large double are itself
    low = F.transform("embedding", lambda x: F.when(F.abs(x) < 1e15, F.floor(x * scale).cast("double")).otherwise(x * scale))
    return v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ok).select("vec_id", low.alias("v"))


def _stats(x: np.ndarray, parts: int) -> np.ndarray:
    """Per segment sqrt(l)*mean and sqrt(l)*deviation, so that a dot product of two rows is the bound."""
    cuts = np.array_split(np.arange(x.shape[1]), parts)
    cols = []
    for c in cuts:
        seg = x[:, c]
        mean = seg.mean(1)
        cols += [math.sqrt(len(c)) * mean, math.sqrt(len(c)) * np.sqrt(np.maximum((seg * seg).mean(1) - mean * mean, 0))]
    return np.stack(cols, 1)


class _Search:
    """Queries of one length, and the k best rows of each so far."""

    def __init__(self, qrow: np.ndarray, qid: np.ndarray, q: np.ndarray, k: int, levels: tuple[int, ...]):
        self.qrow, self.qid, self.q, self.k = qrow, qid, q, k
        self.levels = [p for p in levels if p < q.shape[1]]
        self.stats = [_stats(q, p) for p in self.levels]
        self.norm = np.linalg.norm(q, axis=1)
        self.top: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)
        self.least = np.full(len(q), -np.inf)  # the k-th best score so far: no row below it matters

    def see(self, xid: np.ndarray, x: np.ndarray) -> None:
        """Compares all queries with a block of rows."""
        if not len(x):
            return
        wide = float(np.abs(x).max(initial=0)) * float(np.abs(self.q).max(initial=0)) * max(x.shape[1], 1) >= 2.0**53
        prune = bool(self.levels) and not wide
        xs = [_stats(x, p) for p in self.levels] if prune else []
        slack = 1e-9 * (self.norm * np.linalg.norm(x, axis=1).max() + 1)
        coarse = self.stats[0] @ xs[0].T if prune else None
        for i in range(len(self.q)):
            rows = np.flatnonzero(xid != self.qid[i])
            if prune:
                least = self.least[i]
                for level, (a, b) in enumerate(zip(self.stats, xs, strict=True)):
                    bound = coarse[i, rows] if level == 0 else b[rows] @ a[i]
                    if len(rows) > self.k:
                        seeds = rows[np.argpartition(-bound, self.k - 1)[: self.k]]
                        least = max(least, (x[seeds] @ self.q[i]).min())  # k candidates reach it, so the k-th best does
                    rows = rows[bound + slack[i] >= least]
            if not len(rows):
                continue
            if wide:  # beyond exact doubles: whole numbers, kept within a long
                score = np.array([max(-(1 << 63), min((1 << 63) - 1, sum(int(a) * int(b) for a, b in zip(self.q[i], x[r], strict=True)))) for r in rows], dtype=object).astype(np.int64)
            else:
                score = (x[rows] @ self.q[i]).astype(np.int64)
            self._keep(i, xid[rows], score)

    def _keep(self, i: int, ids: np.ndarray, score: np.ndarray) -> None:
        ids, score = np.concatenate([self.top[i][0], ids]), np.concatenate([self.top[i][1], score])
        on = np.lexsort((ids, ~score))[: self.k]  # ~ falls as the score rises, without overflow
        self.top[i] = ids[on], score[on]
        if len(on) == self.k:
            self.least[i] = float(score[on[-1]])

    def hits(self) -> pa.RecordBatch:
        n = [len(ids) for ids, _ in self.top]
        ids, score = (np.concatenate([t[j] for t in self.top]) for j in (0, 1))
        return to_batch(_HIT, qrow=np.repeat(self.qrow, n), query_id=np.repeat(self.qid, n), vec_id=ids, score=score)


def _by_length(ids: pa.Array, vectors: pa.Array, *more: pa.Array) -> Iterator[tuple]:
    """Ids, matrix (and further columns) of the vectors of each length."""
    if isinstance(vectors, pa.ChunkedArray):
        ids, vectors, *more = (c.combine_chunks() for c in (ids, vectors, *more))
    n = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False)
    values, off = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
    cols = [c.to_numpy(zero_copy_only=False) for c in (ids, *more)]
    for dim in np.unique(n):
        on = np.flatnonzero(n == dim)
        yield int(dim), cols[0][on], values[off[on][:, None] + np.arange(dim)].reshape(len(on), dim).astype(float), *(c[on] for c in cols[1:])


def _scan(searches: dict[int, _Search], ids: pa.Array, vectors: pa.Array) -> None:
    for dim, xid, x in _by_length(ids, vectors):
        for at in range(0, len(xid), ROW_BLOCK):
            if dim in searches:
                searches[dim].see(xid[at : at + ROW_BLOCK], x[at : at + ROW_BLOCK])


def top_k(queries: DataFrame, rows: DataFrame, k: int = K, levels: tuple[int, ...] = LEVELS, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """queries, rows: (vec_id, v array<double> of whole numbers) -> query_id, rank, vec_id, score, exactly.

    Candidates of a query are the rows of the same length with another id (a
    repeated id is a row of its own to others and none to itself; a repeated
    query row gives its own ranks). Ties go to the smaller vec_id. Scores beyond
    2^53 are computed in whole numbers and kept within a long. Empty tables give
    no rows; other columns are left out.

    A task carries each query's k best from one block of rows to the next, and
    returns them; a ranked window merges those of all tasks. Queries of at most
    query_bytes, as measured, go to every task, and rows stay where they are.
    More are cut into groups: each pair of a group and a part of the rows has a
    key of its own and meets in one task.
    """
    own = saved(queries.select("vec_id", "v").withColumn("qrow", F.monotonically_increasing_id()))
    size = own.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("v") * 8 + 24), F.lit(0)).alias("b")).first()
    if size["b"] <= query_bytes:
        t = own.toArrow()
        held = queries.sparkSession.sparkContext.broadcast([(d, *x) for d, *x in _by_length(t.column("vec_id"), t.column("v"), t.column("qrow"))] if t.num_rows else [])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searches = {dim: _Search(qrow, qid, q, k, levels) for dim, qid, q, qrow in held.value}
            for b in _stacked(batches):
                _scan(searches, b.column("vec_id"), b.column("v"))
            yield from (s.hits() for s in searches.values())

        hits = arrow_map(rows.select("vec_id", "v"), run, _HIT)
    else:
        ship(queries.sparkSession)
        groups = math.ceil(size["b"] / query_bytes)
        total = rows.agg(F.coalesce(F.sum(F.size("v") * 8 + 24), F.lit(0)).alias("b")).first()["b"]
        parts = max(1, math.ceil(total / PART_BYTES))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        q = own.withColumn("group", F.pmod(F.xxhash64("qrow"), F.lit(groups)).cast("int")).withColumn("part", every(parts))
        x = rows.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts)).cast("int").alias("part")).withColumn("group", every(groups))

        def meet(key, q: pa.Table, x: pa.Table) -> pa.Table:
            if not q.num_rows or not x.num_rows:
                return to_table()
            searches = {dim: _Search(qrow, qid, m, k, levels) for dim, qid, m, qrow in _by_length(q.column("vec_id"), q.column("v"), q.column("qrow"))}
            _scan(searches, x.column("vec_id"), x.column("v"))
            return pa.Table.from_batches([s.hits() for s in searches.values()])

        def to_table() -> pa.Table:
            return pa.Table.from_batches([to_batch(_HIT, qrow=[], query_id=[], vec_id=[], score=[])])

        hits = q.groupBy("group", "part").cogroup(x.groupBy("group", "part")).applyInArrow(meet, _HIT)
    w = W.partitionBy("qrow").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to some ROW_BLOCK rows: pruning pays per block."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= ROW_BLOCK:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def op1_topk(spark, sf_dir: str) -> DataFrame:
    v = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(v.where("vec_id % 50 = 0"), v)


OP1_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e q, e c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
