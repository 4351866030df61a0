"""Exact top-k by inner product with no random access.

Candidates come in blocks of BLOCK rows. A block keeps, for each dimension, its components sorted: the lists. A query
reads a list from its top where its component is positive and from its bottom where it is negative, all lists to the
same depth, in rounds (DEPTHS, the last of which reads all). What is read of a candidate is added to its partial sum;
so after a round its score has

* a lower bound: the sum, and the list's worst value for each list in which it has not come up yet;
* an upper bound: the sum, and the list's value at this depth for each of these.

A candidate whose upper bound is below the k-th largest lower bound, or below the k-th best score of blocks done before,
is out. A query stops reading at this depth once few enough candidates are left (k, or one in REST of the block); the
lists' rest is then read for these alone, which makes their sums the scores. Nobody is left out on less than these
bounds, so the result is exact; scores are sums of what was read, and there is no other way to them.

The queries of a block of lists advance together: a round adds up the entries that it reads by a matrix product over
them. Bounds over many dimensions stay wide; see the README for how much they prune.

Queries are dealt by hash into blocks of about QUERIES, each broadcast for one pass over the candidates, which are never
shuffled. A task keeps k rows for each query; the best k of all tasks are ranked. A task's memory is bounded by a
block of candidates, a block of queries with k rows each, and the sums of PART queries.

Defined cases: components become floor(scale * x); vectors that are null or hold null or non-finite components take
no part; vectors of other lengths are as if filled up with zeros. Queries are the different vectors of ids divisible by
`every`; a query's candidates are all rows whose vec_id is not its own, null ids included and repeated rows each ranked;
ties go to smaller vec_id, null last. If a vec_id has several vectors, its best k are over all of these. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rivulet.llm.common import checkpoint

SCALE = 64
K = 20
QUERY_EVERY = 20
#: Rows of a block of candidates, queries of a pass, and queries whose sums are held at a time.
BLOCK = 8192
QUERIES = 32_768
PART = 256
#: Shares of the lists read by the end of each round.
DEPTHS = (0.8, 0.9, 1.0)
#: A query reads on for its candidates alone once they are this part of the block.
REST = 16
_PAIRS = 1 << 15


@dataclass
class Trace:
    """What reading did: entries read, entries there were, candidates left after each round (summed over queries)."""

    read: int = 0
    entries: int = 0
    left: list[int] = field(default_factory=list)


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """For each row, the value of its k-th largest score."""
    n = scores.shape[1]
    return np.partition(scores, n - k, axis=1)[:, n - k] if n >= k else np.full(len(scores), -np.inf)


def nra(queries: np.ndarray, candidates: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int, depths: tuple[float, ...] = DEPTHS, trace: Trace | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, candidate, score: all pairs that may be among a query's k best, in no order.

    own: queries by candidates, true where a candidate does not count. floor: scores below it are not wanted. Arrays hold
    integers that are exact in their type.
    """
    n, lists = len(candidates), np.sort(candidates, axis=0)
    positive = np.maximum(queries, 0)
    signed, both = np.hstack((positive, queries - positive)), np.hstack((candidates, candidates))
    least = signed * np.hstack((lists[0], lists[-1]))
    sums, left = np.zeros((len(queries), n), candidates.dtype), ~own
    going, seen, found = np.arange(len(queries)), np.zeros(both.shape, bool), []
    trace = trace or Trace()
    trace.entries += int(np.count_nonzero(queries)) * n
    for depth in depths:
        read = n if depth >= 1 else int(np.ceil(n * depth))
        top, bottom = lists[n - read], lists[read - 1]
        here = np.hstack((candidates >= top, candidates <= bottom))
        new = here & ~seen
        trace.read += int(((signed[going] != 0).sum(0) * new.sum(0)).sum())
        sums[going] += signed[going] @ np.where(new, both, 0).T
        seen, unread = here, (~here).astype(candidates.dtype).T
        most = signed[going] * np.hstack((top, bottom))
        lower = np.where(left[going], sums[going] + least[going] @ unread, -np.inf)
        upper = sums[going] + most @ unread
        left[going] &= upper >= np.maximum(floor[going], _kth(lower, k))[:, None]
        count = left[going].sum(axis=1)
        trace.left.append(int(count.sum()))
        stops = going[count <= max(k, n // REST)] if depth < 1 else going
        query, place = np.nonzero(left[stops])
        query = stops[query]
        scores = sums[query, place]
        if depth < 1:
            trace.read += int((signed[query] != 0).sum() * (1 - depth))
            for lo in range(0, len(query), _PAIRS):
                at = slice(lo, lo + _PAIRS)
                scores[at] += (signed[query[at]] * np.where(seen[place[at]], 0, both[place[at]])).sum(axis=1)
        found.append((query, place, scores))
        going = np.setdiff1d(going, stops)
        if not len(going):
            break
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


@dataclass
class Best:
    """The k best rows of each query so far, by query, score and id (null last)."""

    queries: int
    k: int

    def __post_init__(self):
        self.query, self.id, self.null, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def floor(self, dtype: np.dtype) -> np.ndarray:
        """The k-th score of each query; minus infinity while there are fewer."""
        out = np.full(self.queries, -np.inf, dtype)
        count = np.bincount(self.query, minlength=self.queries)
        full = np.flatnonzero(count == self.k)
        out[full] = self.score[np.cumsum(count)[full] - 1]
        return out

    def add(self, query: np.ndarray, ids: np.ndarray, null: np.ndarray, score: np.ndarray) -> None:
        query, ids, null, score = (np.concatenate(x) for x in ((self.query, query), (self.id, ids), (self.null, null), (self.score, score)))
        order = np.lexsort((ids, null, -score, query))
        query = query[order]
        keep = np.arange(len(query)) - np.searchsorted(query, query) < self.k
        at = order[keep]
        self.query, self.id, self.null, self.score = query[keep], ids[at], null[at], score[at]


def _matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as rows, filled up with zeros; beyond width they meet nothing."""
    sizes = np.asarray(pc.list_value_length(vectors), np.int64)
    values = np.asarray(vectors.flatten(), np.float64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    nth = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((len(sizes), width))
    out[of[nth < width], nth[nth < width]] = values[nth < width]
    return out


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(column.fill_null(0), np.int64), np.asarray(column.is_null())


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Tables of size rows, the last of fewer."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        while n >= size:
            whole = pa.Table.from_batches(held).combine_chunks()
            yield whole.slice(0, size)
            held, n = whole.slice(size).to_batches(), n - size
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def best_of(batches: Iterator[pa.RecordBatch], query_ids: np.ndarray, queries: np.ndarray, k: int, block: int, trace: Trace | None = None) -> Best:
    """The best of a task's candidates (vec_id, v) for each of the queries."""
    best = Best(len(queries), k)
    for rows in _blocks(batches, block):
        c, (ids, null) = _matrix(rows.column(1).combine_chunks(), queries.shape[1]), _ids(rows.column(0).combine_chunks())
        largest = np.abs(queries).sum(1).max(initial=0) * np.abs(c).max(initial=0)
        kind = np.float32 if largest < 2**23 else np.float64 if largest < 2**52 else object
        q, c = (x.astype(kind) if kind is not object else np.frompyfunc(int, 1, 1)(x) for x in (queries, c))
        floor, found = best.floor(kind), []
        for lo in range(0, len(q), PART):
            here = slice(lo, lo + PART)
            query, place, score = nra(q[here], c, (query_ids[here, None] == ids) & ~null, floor[here], k, trace=trace)
            found.append((query + lo, place, score.astype(np.int64)))
        query, place, score = (np.concatenate(x) for x in zip(*found, strict=True))
        best.add(query, ids[place], null[place], score)
    return best


def integers(column: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as doubles; null where the vector takes no part."""
    whole = F.transform(column, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    odd = F.exists(column, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return F.when(column.isNotNull() & ~F.coalesce(odd, F.lit(True)), whole)


def search(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY, scale: int = SCALE, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all rows for each row whose vec_id is divisible by every."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding"), scale).alias("v")).where("v IS NOT NULL")
    asked = rows.where(F.pmod(F.col("vec_id"), F.lit(every)) == 0).distinct()
    passes = -(-asked.count() // queries)
    schema = "query_id long, vec_id long, score long"

    def scan(k_th: int) -> DataFrame:
        mine = asked.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(passes)) == k_th).toArrow().combine_chunks()
        vectors = mine.column("v").combine_chunks()
        order = np.argsort(_ids(mine.column("vec_id").combine_chunks())[0], kind="stable")
        shared = spark.sparkContext.broadcast((_ids(mine.column("vec_id").combine_chunks())[0][order], _matrix(vectors, pc.max(pc.list_value_length(vectors)).as_py())[order]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query_ids, q = shared.value
            best = best_of(batches, query_ids, q, k, block)
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[best.query]), pa.array(best.id, mask=best.null), pa.array(best.score)], names=["query_id", "vec_id", "score"])

        found = rows.mapInArrow(run, schema)
        if passes == 1:
            return found
        found = checkpoint(found)  # the broadcast of one pass at a time
        shared.destroy()
        return found

    scans = [scan(i) for i in range(passes)]
    best = reduce(DataFrame.union, scans) if scans else spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return best.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
