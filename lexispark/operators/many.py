"""Scores of many queries over postings ordered by document: products of a few thousand documents by a pack of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

#: Queries that are scored together, postings taken together, and bytes of packs in a broadcast.
TOGETHER, POSTINGS, PIECE = 256, 1 << 18, 8_000_000
#: Most cells (a posting or a document, by queries) of a product at once.
CELLS = 1 << 22


def packs(queries: DataFrame) -> list[Broadcast[list[bytes]]]:
    """``queries`` (qid, clauses, found: array of code and times) in packs of TOGETHER, some in each broadcast.

    The driver holds one broadcast's packs at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, TOGETHER):
                some, out = batch.slice(i, TOGETHER), pa.BufferOutputStream()
                with pa.ipc.new_stream(out, some.schema) as stream:
                    stream.write_batch(some)
                yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], ["pack"])

    out, some, context = [], [], queries.sparkSession.sparkContext
    for row in queries.coalesce(1 if queries.limit(TOGETHER + 1).count() <= TOGETHER else 1 << 30).mapInArrow(run, "pack binary").toLocalIterator():
        some.append(bytes(row.pack))
        if sum(map(len, some)) >= PIECE:
            out.append(context.broadcast(some))
            some = []
    return out + [context.broadcast(some)] * bool(some)


class Pack:
    """Some queries: ``codes`` are the terms of any of them; ``times`` has their counts in each, by term and query."""

    def __init__(self, packed: bytes):
        batch = pa.ipc.open_stream(packed).read_next_batch()
        self.qids, self.clauses = batch.column("qid"), np.asarray(batch.column("clauses"), np.float64)
        found = batch.column("found")
        code, times = (np.asarray(found.flatten().field(f)) for f in ("code", "times"))
        query = np.repeat(np.arange(batch.num_rows), np.asarray(found.value_lengths()))
        self.codes, at = np.unique(code, return_inverse=True)
        self.times = np.zeros((len(self.codes), batch.num_rows))
        self.times[at, query] = times

    def best(self, doc: np.ndarray, code: np.ndarray, part: np.ndarray, k: int, every: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, doc, score) with the ``k`` best of each query among whole documents, whose postings are ordered by document."""
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        own = np.flatnonzero(self.codes[at] == code)
        out = []
        if len(own):
            doc, at, part = doc[own], at[own], part[own].astype(np.float64)
            first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            wide = max(1, CELLS // self.times.shape[1])
            a = 0
            while a < len(first):  # some documents; one of more terms than that alone
                z = max(a + 1, int(np.searchsorted(first, first[a] + wide, "right")) - 1)
                z = len(first) if len(doc) - first[a] <= wide else z
                here = slice(first[a], first[z] if z < len(first) else len(doc))
                starts = first[a:z] - first[a]
                times = self.times[at[here]]
                matched = np.add.reduceat(times, starts)
                times *= part[here, None]
                scores = np.add.reduceat(times, starts).astype(np.float32)
                hit = matched == self.clauses if every else matched > 0
                out.append(_top(np.where(hit, scores, -np.inf).astype(np.float32), doc[first[a:z]], k))
                a = z
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))


def _top(scores: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, doc, score) of the ``k`` best documents of each column, and any that equal the last of these."""
    least = np.partition(scores, len(docs) - k, 0)[len(docs) - k] if len(docs) > k else np.full(scores.shape[1], -np.inf, np.float32)
    at, query = np.nonzero((scores >= least) & (scores > -np.inf))
    return query, docs[at], scores[at, query]


def cut(query: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each query; of equal ones the smaller documents."""
    by = np.lexsort((doc, -score, query))
    query, doc, score = query[by], doc[by], score[by]
    kept = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[kept], doc[kept], score[kept]


def best(postings: DataFrame, packs: list[Broadcast[list[bytes]]], k: int, every: bool, schema: str) -> DataFrame:
    """(qid, nth, doc, score): the ``k`` best of each task for each query; ``nth`` is the query's number.

    ``postings`` (doc, code, part) are ordered by document within partitions.  With ``every`` a document has to have all
    clauses of a query.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # of each pack the best so far
        for doc, code, part in _whole(batches):
            nth = 0
            for piece in packs:
                for packed in piece.value:
                    pack, found = Pack(packed), None
                    found = pack.best(doc, code, part, k, every)
                    if nth < len(held):
                        found = tuple(np.concatenate(x) for x in zip(held[nth], found, strict=True))
                        held[nth] = cut(*found, k)
                    else:
                        held.append(cut(*found, k))
                    nth += 1
        first, nth = 0, 0
        for piece in packs if held else ():
            for packed in piece.value:
                qids, (query, doc, score) = Pack(packed).qids, held[nth]
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(query)), pa.array(query + first), pa.array(doc), pa.array(score)], ["qid", "nth", "doc", "score"])
                first, nth = first + len(qids), nth + 1

    return postings.mapInArrow(run, schema)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc, code, part) of about POSTINGS postings at a time, none of whose documents go on later."""
    kept: list[tuple[np.ndarray, ...]] = []
    n = 0
    for batch in batches:
        kept.append(tuple(np.asarray(batch.column(c)) for c in ("doc", "code", "part")))
        n += batch.num_rows
        if n >= POSTINGS:
            doc, code, part = (np.concatenate(x) for x in zip(*kept, strict=True))
            z = int(np.searchsorted(doc, doc[-1]))  # the last document may go on
            if z:
                yield doc[:z], code[:z], part[:z]
            kept, n = [(doc[z:], code[z:], part[z:])], len(doc) - z
    if n:
        yield tuple(np.concatenate(x) for x in zip(*kept, strict=True))
