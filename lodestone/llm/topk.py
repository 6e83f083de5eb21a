"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Rows are written once, in ranges of their widest component, and read in blocks; no row is copied
for a query. Queries come in blocks of bounded size, of which each task gets a copy. Two rounds
over the rows:

* Opening: every block scores the heads of its lists (the rows with the largest and the smallest
  components of each dimension). The kth score of a block's heads is a floor under the kth of all
  rows, and each query takes the largest floor that any block found.
* Walk: a block is left out for the queries whose bound, the sum over dimensions of the best that
  the heads of the lists allow, is below their floor. For the others the lists are walked in
  doubling depth; rows that a list shows are scored, the floor rises to the kth score met, and a
  query stops as soon as what the lists show next cannot reach its floor. Where the heads would be
  half of the block the rest is scored at once.

Scores are whole numbers; they are computed as doubles where no sum can pass 2 ** 53 and as longs
otherwise. The blocks' winners meet in a ranked window that Spark cuts to k rows before its shuffle.

Edge cases: vectors that are null or hold null, NaN or infinite components take no part, nor do
rows without an id; shorter vectors count as padded with zeros; ties go to the smaller id; fewer
candidates than k give all of them; empty tables give no rows; rows that repeat an id are
candidates of their own, never partners of a query with that id, and ask once (as the least
vector); very long vectors are rows like others; other columns are never read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import staged

OUT = "query_id long, vec_id long, score long"
NO_FLOOR = -(1 << 62)
#: Rows of a list that the opening reads, and scores that are held at once.
HEADS, HELD = 8, 1 << 22


def whole(vec: Column, scale: int = 1024) -> Column:
    """Components as floor(scale * x), x as double."""
    return F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vec: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vec.isNotNull() & ~F.exists(vec, bad)


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    lengths = np.asarray(lists.value_lengths())
    out = np.zeros((len(lists), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = np.asarray(lists.flatten())
    return out


class Queries:
    """A block of queries, their floors and the best rows met."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int, top: int, floors: np.ndarray | None = None):
        """top: the largest component of any row or query, without its sign."""
        self.ids, self.k = ids, k
        self.kind = np.float64 if float(top) * top * max(rows.shape[1], 1) < 2.0**53 else np.int64
        self.rows = rows.astype(self.kind)
        self.up, self.down = np.maximum(self.rows, 0), np.minimum(self.rows, 0)
        self.floors = np.full(len(ids), NO_FLOOR) if floors is None else floors.copy()
        self.query, self.found, self.scores = (np.zeros(0, np.int64) for _ in range(3))
        self.n_scored = 0

    def _scored(self, ids: np.ndarray, rows: np.ndarray, active: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores of ids x active; a query's own rows have no score) by slices."""
        step = max(1, HELD // max(len(active), 1))
        self.n_scored += len(ids) * len(active)
        for i in range(0, len(ids), step):
            got = (rows[i : i + step] @ self.rows[active].T).astype(np.int64)
            got[ids[i : i + step, None] == self.ids[active]] = NO_FLOOR
            yield ids[i : i + step], got

    def open_with(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """Floors from the kth score of these rows."""
        best = np.full((0, len(self.ids)), NO_FLOOR)
        for _, got in self._scored(ids, rows, np.arange(len(self.ids))):
            both = np.concatenate([best, got])
            best = np.partition(both, len(both) - self.k, axis=0)[-self.k :] if len(both) > self.k else both
        if len(best) == self.k:
            self.floors = np.maximum(self.floors, best.min(axis=0))

    def offer(self, ids: np.ndarray, rows: np.ndarray, active: np.ndarray) -> None:
        """Score rows for the active queries, keep their k best so far and raise their floors."""
        for part, got in self._scored(ids, rows, active):
            r, q = np.nonzero((got >= self.floors[active]) & (got > NO_FLOOR))
            if not len(r):
                continue
            self.query, self.found, self.scores = (np.concatenate(x) for x in ((self.query, active[q]), (self.found, part[r]), (self.scores, got[r, q])))
            order = np.lexsort((self.found, -self.scores, self.query))
            query = self.query[order]
            first = np.flatnonzero(np.diff(query, prepend=-1))
            nth = np.arange(len(query)) - np.repeat(first, np.diff(first, append=len(query)))
            order = order[nth < self.k]
            self.query, self.found, self.scores = self.query[order], self.found[order], self.scores[order]
            full = np.flatnonzero(nth[nth < self.k] == self.k - 1)
            self.floors[self.query[full]] = np.maximum(self.floors[self.query[full]], self.scores[full])

    def bounds(self, active: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
        """No row between least and most scores above this."""
        return (self.up[active] @ most + self.down[active] @ least).astype(np.int64)


def heads(order: np.ndarray, depth: int, until: int) -> np.ndarray:
    """Numbers of the rows from depth to until of any list, from either end."""
    n = order.shape[1]
    return np.unique(np.concatenate([order[:, depth:until], order[:, n - until : n - depth]], axis=1))


def walk(block: Queries, ids: np.ndarray, rows: np.ndarray, first: int = HEADS) -> None:
    """The threshold algorithm over a block of rows: everything that can be among the k best is offered."""
    n, rows = len(ids), rows.astype(block.kind)
    order = np.argsort(-rows.T, axis=1, kind="stable")
    lists = np.take_along_axis(rows.T, order, axis=1)
    left, active, depth, step = np.ones(n, bool), np.arange(len(block.ids)), 0, first
    while len(active) and depth < n:
        active = active[block.bounds(active, lists[:, depth], lists[:, n - 1 - depth]) >= block.floors[active]]
        until = depth + step
        if 4 * len(lists) * until >= n:  # the heads would be half of the block
            until, met = n, left
        else:
            met = np.zeros(n, bool)
            met[heads(order, depth, until)] = True
            met &= left
        if len(active):
            block.offer(ids[met], rows[met], active)
        left = left & ~met
        depth, step = until, 2 * step


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held, n = [], 0
    for b in batches:
        for i in range(0, len(b), size):
            held.append(b.slice(i, size))
            n += len(held[-1])
            if n >= size:
                yield np.concatenate([np.asarray(x.column(0)) for x in held]), np.concatenate([_matrix(x.column(1), dims) for x in held])
                held, n = [], 0
    if n:
        yield np.concatenate([np.asarray(x.column(0)) for x in held]), np.concatenate([_matrix(x.column(1), dims) for x in held])


def _opening(queries: Callable[[], Queries], dims: int, size: int):
    def run(batches):
        block = queries()
        for ids, rows in _blocks(batches, dims, size):
            at = heads(np.argsort(-rows.T, axis=1, kind="stable"), 0, min(HEADS, len(ids))) if dims else np.arange(len(ids))
            block.open_with(ids[at], rows[at].astype(block.kind))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(block.ids))), pa.array(block.floors)], ["q", "floor"])

    return run


def _walking(queries: Callable[[], Queries], dims: int, size: int, scored):
    def run(batches):
        block = queries()
        for ids, rows in _blocks(batches, dims, size):
            if dims:
                walk(block, ids, rows)
            else:
                block.offer(ids, rows.astype(block.kind), np.arange(len(block.ids)))
        if scored is not None:
            scored.add(block.n_scored)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (block.ids[block.query], block.found, block.scores)], ["query_id", "vec_id", "score"])

    return run


def _spread(batches):
    """(d, n, sum, sum of squares, largest without sign) of a partition's components."""
    n = total = square = top = np.zeros(0)
    grown = lambda x, m: np.concatenate([x, np.zeros(max(0, m - len(x)))])
    for b in batches:
        rows = _matrix(b.column(1), int(max(np.asarray(b.column(1).value_lengths()), default=0))).astype(float)
        n, total, square, top = (grown(x, rows.shape[1]) for x in (n, total, square, top))
        m = rows.shape[1]
        n[:m] += len(rows)
        total[:m] += rows.sum(axis=0)
        square[:m] += (rows**2).sum(axis=0)
        top[:m] = np.maximum(top[:m], np.abs(rows).max(axis=0, initial=0))
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.arange(len(n)), n, total, square, top)], ["d", "n", "s", "ss", "top"])


def top_k(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024, block_rows: int = 8192, query_block: int = 16384, scored=None) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for every row where queries holds.

    query_block bounds what is sent to every task: that many vectors. scored: an accumulator that
    gets the number of scores that the walk computed.
    """
    spark = vectors.sparkSession
    rows = vectors.filter(usable(F.col(vec_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), whole(F.col(vec_col), scale).alias("vec"), F.coalesce(queries, F.lit(False)).alias("asks"))
    spread = rows.select("id", "vec").mapInArrow(_spread, "d long, n double, s double, ss double, top double").groupBy("d").agg(F.sum("n"), F.sum("s"), F.sum("ss"), F.max("top")).orderBy("d").collect()  # a row a dimension
    dims, top = len(spread), int(max((r[4] for r in spread), default=0))
    widest = max(range(dims), key=lambda d: spread[d][3] - spread[d][2] ** 2 / max(spread[d][1], 1), default=0)
    n, q = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    ranged = rows.repartitionByRange(max(1, math.ceil(n / block_rows)), F.coalesce(F.get("vec", F.lit(widest)), F.lit(0)), F.xxhash64("id"))
    rows = staged(ranged.sortWithinPartitions(F.coalesce(F.get("vec", F.lit(widest)), F.lit(0))), "vectors")
    n_blocks = max(1, math.ceil(q / query_block))
    asked = staged(rows.filter("asks").groupBy("id").agg(F.min("vec").alias("vec")).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks))), "queries")
    found = None
    for i in range(n_blocks):
        t = asked.filter(F.col("block") == i).select("id", "vec").toArrow()  # about query_block rows
        ids, vecs = np.asarray(t["id"]), _matrix(t["vec"].combine_chunks(), dims)
        sent = spark.sparkContext.broadcast((ids, vecs))
        start = lambda floors=None, sent=sent: Queries(*sent.value, k, top, floors)
        got = rows.select("id", "vec").mapInArrow(_opening(start, dims, block_rows), "q long, floor long").groupBy("q").agg(F.max("floor")).toArrow()
        floors = np.full(len(ids), NO_FLOOR)
        floors[np.asarray(got[0])] = np.asarray(got[1])
        best = rows.select("id", "vec").mapInArrow(_walking(lambda start=start, floors=floors: start(floors), dims, block_rows, scored), OUT)
        best = best if n_blocks == 1 else staged(best, "winners")
        found = best if found is None else found.unionByName(best)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
