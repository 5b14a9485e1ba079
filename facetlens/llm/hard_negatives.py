"""Operator 11: hard negatives for contrastive training, found in STR-packed R-trees.

Usable rows are quantised to integers, range-partitioned by (length, label,
first coordinate) and held as blocks of bounded size. A search task packs its
block into an R-tree by sort-tile-recursive order: along the coordinates of
greatest spread rows are sorted and cut into slabs, slabs into pages; parents
are packed the same way over the centres of their children. A node's bounding
box gives, per coordinate, the interval of q[d] * x[d], and their sums bound the
inner product with an anchor; its labels bound likewise. A best-first queue
opens nodes by upper bound and leaves out boxes that lie outside every score
window, or strictly below the k-th best score of each, so ties survive.

Two passes: first every anchor's best rows of its own label, only in the blocks
that hold the label; then, with a window per positive, the best rows of other
labels. Blocks stay where they are dealt, anchors are sent to them in blocks,
and the few best rows of each block are merged. A block's size follows the
cluster's parallelism between fixed bounds, so memory does not grow.

Defined results: rows with a null id or label, a null or empty vector, or a null
or non-finite component take no part; vectors of different lengths are never
compared; rows with the anchor's own id are neither its positives nor its
negatives; repeated rows count as often as they occur, as anchors too; ties go to
the smaller id; a non-positive positive has a window of its own formula (for a
negative score it is empty); an anchor without positives, or whose windows are
empty, has no rows; an empty table gives an empty result; further columns are
ignored. Scores must fit 64 bits.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept_table, python_ready

BLOCK = "kind int, number int, dim int, labels array<bigint>, ids binary, own binary, vectors binary, extra binary"
PAGE, FANOUT = 32, 16
ANY = 1 << 62                # above any score
LABELS_BROADCAST = 100_000   # rows of (dim, label, first block, last block)


def usable(vectors: DataFrame, is_anchor: Column, scale: int = 256) -> DataFrame:
    """(vec_id, label, dim, anchor, v): floor(scale * x) of the rows that take part."""
    e = F.col("embedding")
    ok = e.isNotNull() & F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~F.exists(
        e, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where(ok & (F.size(e) > 0)).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"),
        F.size(e).alias("dim"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
        F.transform(e, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def packed_ints(v: np.ndarray) -> bytes:
    """Integers in the narrowest of 2, 4 or 8 bytes; ``ints`` finds the width again."""
    most = max(int(v.max(initial=0)), -int(v.min(initial=0)) - 1)
    return v.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8").tobytes()


def ints(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{len(raw) // max(1, n)}").astype(np.int64)


# ---------------------------------------------------------------- the tree

def tiled(points: np.ndarray, page: int) -> np.ndarray:
    """Sort-tile-recursive order of ``points``: consecutive runs of ``page`` are near each other."""
    pages = math.ceil(len(points) / page)
    if pages <= 1:
        return np.arange(len(points))
    dims = np.argsort(-points.var(0), kind="stable")[:max(1, int(math.log2(pages)))]

    def cut(rows, level):
        todo = math.ceil(len(rows) / page)
        if todo <= 1 or level == len(dims):
            return [rows]
        slabs = math.ceil(todo ** (1 / (len(dims) - level)))
        rows = rows[np.argsort(points[rows, dims[level]], kind="stable")]
        step = page * math.ceil(todo / slabs)
        return [x for a in range(0, len(rows), step) for x in cut(rows[a:a + step], level + 1)]

    return np.concatenate(cut(np.arange(len(points)), 0))


def number_type(v: np.ndarray, q_most: int):
    """A float type in which all inner products and bounds are exact, or 64-bit integers."""
    size = (int(np.abs(v).max(initial=0)) + 1) * (q_most + 1) * (v.shape[1] + 1)
    return np.float32 if size < 1 << 24 else np.float64 if size < 1 << 53 else np.int64


class Tree:
    """R-tree over one block; level 0 are pages of rows, the last level is the root."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        # rows of one label stay together, so that most boxes have one label
        by_label = [np.flatnonzero(labels == x) for x in np.unique(labels)]
        order = np.concatenate([rows[tiled(vectors[rows].astype(np.float64), PAGE)] for rows in by_label])
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        at = np.arange(0, len(ids), PAGE)
        first, last = np.minimum.reduceat, np.maximum.reduceat
        lo, hi = first(self.vectors, at), last(self.vectors, at)
        l_lo, l_hi = first(self.labels, at), last(self.labels, at)
        self.levels = [(lo, hi, l_lo, l_hi, None)]
        while len(lo) > 1:
            near = tiled((lo + hi) / 2.0, FANOUT)
            at = np.arange(0, len(near), FANOUT)
            children = [near[a:a + FANOUT].tolist() for a in at]
            lo, hi, l_lo, l_hi = first(lo[near], at), last(hi[near], at), first(l_lo[near], at), last(l_hi[near], at)
            self.levels.append((lo, hi, l_lo, l_hi, children))
        self.kinds: dict = {}

    def typed(self, kind):
        """Pages of rows (the last one filled up with zeros) and boxes as numbers of one type."""
        if kind not in self.kinds:
            n, dim = len(self.levels[0][0]), self.vectors.shape[1]
            pages = np.zeros((n * PAGE, dim), kind)
            pages[:len(self.vectors)] = self.vectors
            self.kinds[kind] = (pages.reshape(n, PAGE, dim),
                                [(x[0].astype(kind), x[1].astype(kind)) for x in self.levels])
        return self.kinds[kind]

    def bounds(self, queries: np.ndarray):
        """Per level the upper and lower bounds (queries x nodes) of the inner product."""
        kind = number_type(self.vectors, int(np.abs(queries).max(initial=0)))
        up, down = np.maximum(queries, 0).astype(kind), np.minimum(queries, 0).astype(kind)
        return kind, [(up @ hi.T + down @ lo.T, up @ lo.T + down @ hi.T) for lo, hi in self.typed(kind)[1]]


class Best:
    """The ``k`` best (score, id) of each score window [low, high]."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, np.arange(k)
        self.need = low.copy()      # strictly below this a row cannot be among the k best
        self.least, self.top = low.min(), high.max()
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))
        scores, ids = scores[order], ids[order]
        at, ends = self.places(scores)
        full = at[:, -1] < ends
        self.need[full] = scores[at[full, -1]]
        self.least = self.need.min()
        kept = np.zeros(len(ids), bool)
        kept[at[at < ends[:, None]]] = True
        self.scores, self.ids = scores[kept], ids[kept]

    def places(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per window the places of its k best among descending scores, and the place where it ends."""
        falling = -scores
        first = np.searchsorted(falling, -self.high, "left")
        return first[:, None] + self.k, np.searchsorted(falling, -self.low, "right")

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window, id and score of all that was found."""
        at, ends = self.places(self.scores)
        window, nth = np.nonzero(at < ends[:, None])
        return window, self.ids[at[window, nth]], self.scores[at[window, nth]]


def search(tree: Tree, kind, bounds, nth: int, q: np.ndarray, own: int, label: int, same: bool, best: Best) -> int:
    """Best-first search for anchor ``nth`` of the block; returns the number of rows scored."""
    value, open_ = [], []
    for (upper, lower), (_, _, l_lo, l_hi, _) in zip(bounds, tree.levels):
        upper, lower = upper[nth], lower[nth]
        ok = ((upper[:, None] >= best.need) & (lower[:, None] <= best.high)).any(1)
        ok &= (l_lo <= label) & (label <= l_hi) if same else (l_lo != label) | (l_hi != label)
        value.append(np.minimum(upper, best.top).tolist())
        open_.append(ok.tolist())
    rows, root, scored, burst = tree.typed(kind)[0], len(tree.levels) - 1, 0, 4
    queue = [(-value[root][0], root, 0)] if open_[root][0] else []
    q = q.astype(kind)
    while queue:
        pages = []
        while queue and len(pages) < burst:
            p, level, node = heapq.heappop(queue)
            if -p < best.least:    # neither this box nor any behind it can qualify
                queue = []
            elif level:
                for n in tree.levels[level][4][node]:
                    if open_[level - 1][n] and value[level - 1][n] >= best.least:
                        heapq.heappush(queue, (-value[level - 1][n], level - 1, n))
            else:
                pages.append(node)
        if pages:
            scores = (rows[pages].reshape(-1, len(q)) @ q).astype(np.int64)
            fit = np.flatnonzero((scores >= best.least) & (scores <= best.top))
            at = np.array(pages)[fit // PAGE] * PAGE + fit % PAGE
            scored += len(scores)
            keep = at < len(tree.ids)
            fit, at = fit[keep], at[keep]
            keep = ((tree.labels[at] == label) == same) & (tree.ids[at] != own)
            if keep.any():
                best.add(scores[fit[keep]], tree.ids[at[keep]])
            burst *= 2
    return scored


# ---------------------------------------------------------------- Spark

def _blocks(rows: DataFrame, size: int, by_label: bool, kind: int) -> DataFrame:
    """Pack rows into blocks of at most ``size`` of one length (and one label), inside each partition."""
    extra = "extra" in rows.columns

    def run(batches):
        import pyarrow as pa

        number, held = TaskContext.get().partitionId(), {}

        def out(key):
            ids, own, labels, vecs, more = zip(*held.pop(key))
            return pa.RecordBatch.from_arrays(
                [pa.array([kind], pa.int32()), pa.array([number], pa.int32()), pa.array([key[0]], pa.int32()),
                 pa.array([sorted(set(labels))], pa.list_(pa.int64())),
                 pa.array([np.array(ids, "<i8").tobytes()], pa.binary()),
                 pa.array([np.array(own, "<i8").tobytes() + np.array(labels, "<i8").tobytes()], pa.binary()),
                 pa.array([packed_ints(np.array(vecs, np.int64))], pa.binary()),
                 pa.array([np.array(more, "<i8").tobytes()], pa.binary())],
                names=[f.split()[0] for f in BLOCK.split(", ")])

        for b in batches:
            for own, i, label, v, *more in zip(*(c.to_pylist() for c in b.columns)):
                key = (len(v), label if by_label else None)
                held.setdefault(key, []).append((i, own, label, v, more[0] if more else []))
                if len(held[key]) == size:
                    yield out(key)
        for key in list(held):
            yield out(key)

    return rows.select("uid", "vec_id", "label", "v", *["extra"] * extra).mapInArrow(run, BLOCK)


def _numbers(block: dict):
    ids = np.frombuffer(block["ids"], "<i8")
    own, labels = np.frombuffer(block["own"], "<i8").reshape(2, -1)
    return ids, own, labels, ints(block["vectors"], len(ids) * block["dim"]).reshape(len(ids), -1)


def _searched(trees: DataFrame, sent: DataFrame, tasks: int, same: bool, k: int) -> DataFrame:
    """Every sent anchor block against the trees of its number; rows first, so that anchors stream past them."""
    def run(batches):
        import pyarrow as pa

        forest, names = [], [f.split()[0] for f in BLOCK.split(", ")]
        for b in batches:
            for r in range(b.num_rows):
                one = dict(zip(names, (c[r].as_py() for c in b.columns)))
                ids, own, labels, vectors = _numbers(one)
                if not one["kind"]:
                    forest.append(Tree(ids, labels, vectors))
                    continue
                there = [(t, *t.bounds(vectors)) for t in forest if t.vectors.shape[1] == one["dim"]]
                extra = np.frombuffer(one["extra"], "<i8").reshape(len(ids), -1)
                out: list[list] = [[], [], [], []]
                for j in range(len(ids)):
                    low, high = extra[j].reshape(2, -1) if extra.shape[1] else (np.array([-ANY]), np.array([ANY]))
                    open_ = np.flatnonzero(low <= high)
                    if not len(open_):
                        continue
                    best = Best(low[open_].copy(), high[open_], k)
                    for t, kind, bounds in there:
                        search(t, kind, bounds, j, vectors[j], ids[j], labels[j], same, best)
                    window, found, scores = best.rows()
                    out[0] += [int(own[j])] * len(found)
                    out[1] += open_[window].tolist()
                    out[2] += found.tolist()
                    out[3] += scores.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
                                                 names=["uid", "nth", "vec_id", "score"])

    both = trees.unionByName(sent).repartitionById(tasks, "number").sortWithinPartitions("kind")
    return both.mapInArrow(run, "uid bigint, nth int, vec_id bigint, score bigint")


def _merged(found: DataFrame, k: int, rank: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("uid", "nth").orderBy(F.desc("score"), "vec_id")
    return found.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50,
                   high: int = 95, scale: int = 256, rows_per_block: int | None = None,
                   anchors_per_block: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For an anchor and each of its ``positives`` best rows of the same label: the
    ``negatives`` best rows of other labels whose score is at least ``low`` and
    at most ``high`` per cent of the positive's.
    """
    spark = vectors.sparkSession
    python_ready(spark)
    rows = usable(vectors, is_anchor, scale).withColumn("uid", F.monotonically_increasing_id())
    total = rows.count()
    size = rows_per_block or min(65_536, max(2_048, math.ceil(total / (2 * spark.sparkContext.defaultParallelism))))
    tasks = max(1, math.ceil(total / size))
    # the last key splits any number of equal rows
    dealt = rows.repartitionByRange(tasks, "dim", "label", F.col("v")[0], "uid")
    trees = kept_table(_blocks(dealt, size, False, 0))
    trees = trees.withColumn("number", (F.col("number") % tasks).cast("int")) if trees.rdd.getNumPartitions() > tasks else trees
    anchors = kept_table(rows.where("anchor").select("uid", "vec_id", "label", "v"))

    asked = _blocks(anchors, anchors_per_block, True, 1).withColumn("label", F.col("labels")[0]).drop("number")
    where = (trees.select("dim", "number", F.explode("labels").alias("label")).groupBy("dim", "label")
             .agg(F.sort_array(F.collect_set("number")).alias("numbers")) if tasks <= 64 else
             trees.select("dim", "number", F.explode("labels").alias("label")).groupBy("dim", "label")
             .agg(F.sequence(F.min("number"), F.max("number")).alias("numbers")))
    where = kept_table(where)
    where = F.broadcast(where) if where.count() <= LABELS_BROADCAST else where
    sent = asked.join(where, ["dim", "label"]).withColumn("number", F.explode("numbers")).select(*trees.columns)
    first = kept_table(_merged(_searched(trees, sent, tasks, True, positives), positives, "rank")
                       .select("uid", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    # whole numbers n with low * p <= 100 * n and 100 * n <= high * p
    one = F.struct("rank", F.expr(f"-{_hundredths(f'-{low}L * positive_score')}").alias("low"),
                   F.expr(_hundredths(f"{high}L * positive_score")).alias("high"))
    windows = first.groupBy("uid").agg(F.sort_array(F.collect_list(one)).alias("w")).select("uid", F.concat(
        F.transform(_padded("w", positives), lambda x: x["low"]), F.transform(_padded("w", positives), lambda x: x["high"])).alias("extra"))
    ask = _blocks(anchors.join(windows, "uid"), anchors_per_block, False, 1)
    sent = ask.drop("number").withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).select(*trees.columns)
    found = _merged(_searched(trees, sent, tasks, False, negatives), negatives, "rank_")
    return (found.withColumn("rank", F.col("nth") + 1).join(first, ["uid", "rank"])
            .join(anchors.select("uid", F.col("vec_id").alias("anchor_id")), "uid")
            .select("anchor_id", "positive_id", F.col("rank_").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))


def _hundredths(x: str) -> str:
    """SQL for floor(x / 100) of whole numbers."""
    return f"(({x} - pmod({x}, 100L)) div 100L)"


def _padded(name: str, n: int) -> Column:
    """The windows of an anchor, filled up to ``n`` with empty ones."""
    none = F.struct(F.lit(0).alias("rank"), F.lit(1).cast("bigint").alias("low"), F.lit(0).cast("bigint").alias("high"))
    return F.slice(F.concat(F.col(name), F.array_repeat(none, n)), 1, n)


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT) for x in embedding] AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))]) = 0),
pairs AS (
  SELECT a.uid, a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_sum([x[1] * x[2] for x in list_zip(a.q, b.q)]) AS BIGINT) AS score
  FROM v a JOIN v b ON len(a.q) = len(b.q) AND a.vec_id <> b.vec_id
  WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT * FROM (SELECT uid, anchor_id, other_id AS positive_id, score AS positive_score,
                        row_number() OVER (PARTITION BY uid ORDER BY score DESC, other_id) AS nth
                 FROM pairs WHERE same) WHERE nth <= 5),
ranked AS (
  SELECT p.anchor_id, p.positive_id, n.other_id AS negative_id, p.positive_score, n.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.uid, p.nth ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank
  FROM positives p JOIN pairs n ON n.uid = p.uid AND NOT n.same
   AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""
