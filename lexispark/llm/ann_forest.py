"""Approximate nearest neighbours by a hash-prefix forest.

Vectors are spread over shards of about ``SHARD``, those of one length in shards of their own.  In a shard each of
``TREES`` trees hashes every vector to a string of ``BITS`` signs of random projections and keeps the strings sorted.  A
query descends in each tree to the strings that share the longest prefix with its own, a range of the sorted array, and
then ascends in all trees at once, one bit at a time, until the ranges hold ``MET`` of the shard's vectors.  A vector
gets a vote for each tree and level where it is met, so that votes add up the lengths of the prefixes shared.  Those of
most votes, ``SCORED`` of the shard but at least ``LEAST`` for each neighbour asked for, are scored exactly, and the best
of all shards are merged.  The largest inner product is made an angle by one more coordinate that gives all vectors the
length of the longest (queries have 0 there).

Queries stream past a shard's forest, so that a task holds one shard and one batch, however many of either there are.

Defined cases: null or zero vectors, and those with null, NaN or infinite components, take no part, nor do rows without
an id; vectors are compared with those of their own length; rows are vectors of their own, also when they share an id or
are equal: each such row with a fitting id is asked, and only itself is no candidate of it; equal scores are ordered by
id; with fewer other vectors than asked for, all of them are found; an empty table gives an empty one; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SHARD, TREES, BITS, SEED = 16_384, 128, 32, 11
#: Shares of a shard that are met in the trees, and scored; least scored for each neighbour asked for.
MET, SCORED, LEAST = 0.95, 0.1, 20
#: Queries that ascend together.
TOGETHER = 64
_RESULT = "query_row long, query_id long, vec_id long, score double"


def valid(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


class Forest:
    """The sorted hash strings of one shard; ``scored`` counts vectors scored, for all queries asked."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, longest: float):
        self.rows, self.ids, self.vectors, self.scored = rows, ids, vectors, 0
        self.planes = np.random.default_rng(SEED).normal(size=(vectors.shape[1] + 1, TREES * BITS))
        scaled = vectors / longest
        strings = self.strings(np.hstack([scaled, np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(1)))[:, None]]))
        self.order = np.argsort(strings, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(strings, self.order, 0).T)
        self.order = np.ascontiguousarray(self.order.T, np.int32)

    def strings(self, x: np.ndarray) -> np.ndarray:
        weight = np.int64(1) << np.arange(BITS, dtype=np.int64)[::-1]
        return np.concatenate([((x[a : a + 1024] @ self.planes > 0).reshape(-1, TREES, BITS) * weight).sum(2) for a in range(0, max(1, len(x)), 1024)])

    def votes(self, queries: np.ndarray, wanted: int) -> np.ndarray:
        """Votes of each vector for each query, from the longest prefixes to where enough vectors are met."""
        strings = self.strings(np.hstack([queries, np.zeros((len(queries), 1))]))
        out = np.zeros((len(queries), len(self.ids)), np.int32)
        waiting = np.arange(len(queries))
        for bits in range(min(BITS, 2 + len(self.ids).bit_length()), -1, -1):
            shift = np.int64(BITS - bits)
            prefix = strings[waiting] >> shift
            lo, hi = np.empty((2, len(waiting), TREES), np.int64)
            for t in range(TREES):
                lo[:, t] = np.searchsorted(self.sorted[t], prefix[:, t] << shift)
                hi[:, t] = np.searchsorted(self.sorted[t], (prefix[:, t] + 1) << shift)
            going = []
            for q, starts, ends in zip(waiting.tolist(), lo.tolist(), hi.tolist(), strict=True):
                met = [self.order[t, a:z] for t, (a, z) in enumerate(zip(starts, ends, strict=True)) if a < z]
                if met:
                    out[q] += np.bincount(np.concatenate(met), minlength=len(self.ids))
                if np.count_nonzero(out[q]) < wanted:
                    going.append(q)
            waiting = np.array(going, np.int64)
            if not going:
                break
        return out

    def search(self, rows: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of the best ``k`` scored; scores are sums in double precision, the same for equal rows."""
        n = len(self.ids)
        most = max(LEAST * k, math.ceil(SCORED * n))
        for a in range(0, len(queries), TOGETHER):
            some = queries[a : a + TOGETHER]
            for own, q, votes in zip(rows[a : a + TOGETHER], some, self.votes(some, min(n, max(most, math.ceil(MET * n)))), strict=True):
                met = np.flatnonzero(votes)
                if len(met) > most:
                    met = met[np.argsort(-votes[met], kind="stable")[:most]]
                met = met[self.rows[met] != own]
                self.scored += len(met)
                rough = self.vectors[met] @ q
                if len(met) > k:
                    least = np.partition(rough, -k)[-k]
                    met = met[rough >= least - 1e-9 * max(1.0, abs(least))]
                score = (self.vectors[met] * q).sum(1)
                best = np.lexsort((self.ids[met], -score))[:k]
                yield self.ids[met[best]], score[best]


def _search_shards(rows: DataFrame, k: int) -> DataFrame:
    """(query_row, query_id, vec_id, score) by shard; rows come by shard, vectors before queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, forest, parts = None, None, []
        for batch in batches:
            shards, asked = np.array(batch.column("shard")), np.array(batch.column("query").to_pylist(), bool)
            ids, numbers, longest = (np.array(batch.column(c)) for c in ("vec_id", "row", "longest"))
            values, ends = np.array(batch.column("vector").flatten(), np.float64), np.cumsum([0, *(len(v) for v in batch.column("vector"))])
            for s in np.unique(shards):
                at = np.flatnonzero(shards == s)  # rows of a shard lie together and are of one length
                vectors = values[ends[at[0]] : ends[at[-1] + 1]].reshape(len(at), -1)
                if s != shard:
                    shard, forest, parts = s, None, []
                known = ~asked[at]
                if known.any():
                    parts.append((numbers[at[known]], ids[at[known]], vectors[known]))
                here = at[~known]
                if not len(here):
                    continue
                if forest is None and parts:
                    forest, parts = Forest(*(np.concatenate(p) for p in zip(*parts, strict=True)), longest[at[0]]), []
                if forest is not None:
                    found = list(forest.search(numbers[here], vectors[~known], k))
                    size = [len(f[0]) for f in found]
                    arrays = [np.repeat(numbers[here], size), np.repeat(ids[here], size), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])]
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["query_row", "query_id", "vec_id", "score"])

    return rows.mapInArrow(run, _RESULT)


def search(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each vector whose id is divisible by ``every``.

    ``vectors`` has vec_id and embedding.
    """
    rows = vectors.where(F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.where(valid(F.col("vector"))).withColumns({"width": F.size("vector"), "row": F.monotonically_increasing_id()})
    known = cut(rows, "vectors")
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    shards, plan = 0, []  # as many rows as there are lengths of vectors
    for w in known.groupBy("width").agg(F.count("*").alias("n"), F.max(square).alias("square")).orderBy("width").collect():
        plan.append((w.width, shards, math.ceil(w.n / SHARD), math.sqrt(w.square) * (1 + 1e-12)))
        shards += plan[-1][2]
    if not plan:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    placed = known.join(F.broadcast(known.sparkSession.createDataFrame(plan, "width int, first int, shards int, longest double")), "width")
    columns = ["vec_id", "row", "vector", "longest"]
    index = placed.select((F.col("first") + F.pmod(F.xxhash64("row"), F.col("shards"))).cast("int").alias("shard"), F.lit(False).alias("query"), *columns)
    asked = placed.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("shards") - 1)).alias("shard"), F.lit(True).alias("query"), *columns)
    both = index.unionByName(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "query")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return _search_shards(both, k).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
