"""Operator 9: exact top-k inner products by no-random-access aggregation.

Vectors are quantised to integers and packed into blocks of rows; a block keeps
one list per component, sorted by value. For a query, every list is read
sequentially from its better end. A row that was seen in some lists has a lower
and an upper bound (unread components lie between the list's last value and the
value read last); when no row outside the candidates, seen or unseen, can still
reach the k-th best lower bound, reading stops and the candidates' final scores
are resolved from their vectors. The k best of every block are merged.

The query set is an argument and meets every row in blocks of queries by blocks
of rows. Blocks have a bounded size, so memory does not grow with the input.

Defined results: null vectors, and vectors with a null or non-finite component,
take no part; vectors of different lengths are not compared; rows with a null
id take no part; the row with the query's own id is not a candidate, other rows
of equal vectors are; ties go to the smaller id; repeated rows count as often as
they occur; with fewer than k candidates all are returned; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept_table, python_ready

BLOCK = "block bigint, dim int, ids binary, vectors binary"


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v array<bigint>): floor(scale * x) of the usable vectors."""
    e = F.col("embedding")
    usable = e.isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(
        e, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where(usable & (F.size(e) > 0)).select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.transform(e, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Pack rows into blocks of at most ``size`` vectors of one length, inside each partition."""
    def run(batches):
        import pyarrow as pa

        nth, held = TaskContext.get().partitionId() << 32, {}

        def out(dim):
            nonlocal nth
            ids, vecs = zip(*held.pop(dim))
            nth += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([nth], pa.int64()), pa.array([dim], pa.int32()),
                 pa.array([np.array(ids, "<i8").tobytes()], pa.binary()),
                 pa.array([np.array(vecs, "<i8").tobytes()], pa.binary())], names=["block", "dim", "ids", "vectors"])

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows_ = held.setdefault(len(v), [])
                rows_.append((i, v))
                if len(rows_) == size:
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)

    return rows.mapInArrow(run, BLOCK)


class SortedLists:
    """A block's rows and, per component, the row order by value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable")          # rows x components
        self.values = np.take_along_axis(vectors, self.order, axis=0)

    def top(self, q: np.ndarray, own: int, k: int, floor_: float = -np.inf, step: int = 256):
        """Ids and scores of the k best rows that reach ``floor_``, ties to the smaller id; lists read so far."""
        n, live = len(self.ids), np.flatnonzero(q)
        weight = q[live].astype(np.float64)
        # contribution lists from their better end: descending for positive weights
        lists = np.where(weight > 0, 1, -1)
        best_first = [self.order[::-1, d] if s > 0 else self.order[:, d] for d, s in zip(live, lists)]
        value_first = [(self.values[::-1, d] if s > 0 else self.values[:, d]) * q[d] for d, s in zip(live, lists)]
        worst = np.array([v[-1] for v in value_first], np.float64)
        known, slack_low = np.zeros(n), np.full(n, worst.sum())  # sums of seen parts; least of unseen parts
        seen_front = np.zeros(n)                                 # what seen lists would add at their frontier
        mine = self.ids == own
        depth = 0
        while True:
            end = min(n, depth + step)
            for j in range(len(live)):
                r, v = best_first[j][depth:end], value_first[j][depth:end]
                known[r] += v
                slack_low[r] -= worst[j]
            depth = end
            if depth == n:
                upper = known
                break
            front = np.array([v[depth - 1] for v in value_first], np.float64)
            seen_front[:] = 0
            for j in range(len(live)):
                seen_front[best_first[j][:depth]] += front[j]
            upper = known + front.sum() - seen_front
            lower = np.where(mine, -np.inf, known + slack_low)
            kth = max(floor_, np.partition(lower, n - k)[n - k] if n > k else -np.inf)
            # few enough rows can still qualify: resolve those
            if (upper >= kth).sum() <= max(4 * k, n // 64):
                break
            step *= 2
        if depth == n:
            lower = np.where(mine, -np.inf, known)
        kth = max(floor_, np.partition(lower, n - k)[n - k] if n > k else -np.inf)
        rows = np.flatnonzero((upper >= kth) & ~mine)
        exact = self.vectors[rows] @ q
        pick = np.lexsort((self.ids[rows], -exact))[:k]
        return self.ids[rows][pick], exact[pick], depth

    def top_many(self, queries: np.ndarray, own: np.ndarray, k: int, shares=(0.125, 0.5)):
        """``top`` of every row of ``queries``: the lists are read to the same depth for all of them, and sums over
        what was read are products of matrices. Queries leave when few rows can still qualify; lists are read
        to the end for the others. Yields (place in queries, ids, scores)."""
        n, v = len(self.ids), self.vectors
        # products and their sums must be exact as doubles
        if float(np.abs(v).max()) * float(np.abs(queries).max()) * v.shape[1] >= 2.0 ** 53:
            for i, q in enumerate(queries):
                yield (i, *self.top(q, int(own[i]), k)[:2])
            return
        v = v.astype(np.float64)
        rank = np.empty(v.shape, np.int32)
        np.put_along_axis(rank, self.order, np.arange(n, dtype=np.int32)[:, None], axis=0)
        least, most = self.values[0].astype(np.float64), self.values[-1].astype(np.float64)
        left = np.arange(len(queries))
        for depth in [*(d for d in (int(n * x) for x in shares) if d > 4 * k), n]:
            q = queries[left].astype(np.float64)
            pos, neg = np.maximum(q, 0).T, np.minimum(q, 0).T                  # read from the upper and from the lower end
            if depth == n:
                lower = upper = v @ q.T
            else:
                above, below = rank >= n - depth, rank < depth
                known = np.where(above, v, 0) @ pos + np.where(below, v, 0) @ neg
                # unread components lie between the list's last value and the value read last
                unread = lambda high, low: (~above).astype(np.float64) @ (high[:, None] * pos) + (~below).astype(np.float64) @ (low[:, None] * neg)
                upper = known + unread(self.values[n - depth].astype(np.float64), self.values[depth - 1].astype(np.float64))
                lower = known + unread(least, most)
            lower = np.where(self.ids[:, None] == own[left], -np.inf, lower)
            kth = np.partition(lower, n - k, axis=0)[n - k] if n > k else np.full(len(left), -np.inf)
            can = upper >= kth
            done = np.flatnonzero((can.sum(axis=0) <= max(4 * k, n // 64)) | (depth == n))
            for j in done:
                rows = np.flatnonzero(can[:, j] & (self.ids != own[left[j]]))
                exact = self.vectors[rows] @ queries[left[j]]
                pick = np.lexsort((self.ids[rows], -exact))[:k]
                yield int(left[j]), self.ids[rows][pick], exact[pick]
            left = np.delete(left, done)
            if not len(left):
                return


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, rows_per_block: int = 8192,
          queries_per_block: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best other rows of every query row."""
    spark = vectors.sparkSession
    python_ready(spark)
    ready = quantised(vectors)
    rows = kept_table(blocks(ready, rows_per_block))
    queries = kept_table(blocks(ready.where(is_query), queries_per_block))
    # every query block is sent to every row block: row blocks are dealt over as many
    # numbers as there are blocks, query blocks are copied to each number
    n = max(1, rows.count())
    dealt = rows.withColumn("number", F.pmod(F.xxhash64("block"), F.lit(n).cast("bigint")))
    sent = queries.select(F.explode(F.expr(f"sequence(0L, {n - 1}L)")).alias("number"), "dim",
                          F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    pairs = dealt.join(sent, ["number", "dim"])

    def search(batches):
        import pyarrow as pa

        block, lists = None, None
        for b in batches:
            for r in range(b.num_rows):
                one = {c: b.column(c)[r].as_py() for c in ("block", "dim", "q_ids", "q_vectors")}
                if one["block"] != block:
                    block = one["block"]
                    lists = SortedLists(np.frombuffer(b.column("ids")[r].as_py(), "<i8"),
                                        np.frombuffer(b.column("vectors")[r].as_py(), "<i8").reshape(-1, one["dim"]))
                out = ([], [], [])
                own = np.frombuffer(one["q_ids"], "<i8")
                for i, ids, scores in lists.top_many(np.frombuffer(one["q_vectors"], "<i8").reshape(-1, one["dim"]), own, k):
                    out[0].extend([int(own[i])] * len(ids))
                    out[1].extend(ids.tolist())
                    out[2].extend(scores.tolist())
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out],
                                                 names=["query_id", "vec_id", "score"])

    found = pairs.select("block", "dim", "ids", "vectors", "q_ids", "q_vectors").mapInArrow(
        search, "query_id bigint, vec_id bigint, score bigint")
    return _merged(found, k)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k best per query of all blocks; a query has at most k rows per block."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT) for x in embedding] AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))]) = 0),
pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum([x[1] * x[2] for x in list_zip(a.q, b.q)]) AS BIGINT) AS score
  FROM v a JOIN v b ON len(a.q) = len(b.q) AND a.vec_id <> b.vec_id
  WHERE a.vec_id % 50 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
