"""The tables of an index: documents, postings, terms, statistics."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import average_length, idf, length_norm, norm_inverse, quantized_length, tokenize

#: A corpus of less than this for each core is spread over the cores before its texts are read.
SPREAD_BYTES = 128 << 20
#: Tokens whose postings a worker makes at once, and postings in a packed chunk.
TOGETHER, CHUNK = 1 << 20, 1 << 20
#: Of so many pieces or more every so manyth posting is a sample for the ranges of a written index.
SAMPLED, STRIDE = 64, 100
#: Postings in a range, and so many at least where there are fewer ranges than cores.
RANGE, SMALL = 1_500_000, 50_000
#: Into how many ranges of documents the postings of a term with more than FREQUENT are cut to number them.
RANGES, FREQUENT = 256, 500_000


class Index:
    """Tables as read from a folder, or as plans over ``forward``: then each is made at its first use."""

    def __init__(
        self,
        docs: DataFrame | None = None,
        postings: DataFrame | None = None,
        terms: DataFrame | None = None,
        stats: DataFrame | None = None,
        has_positions: bool = False,
        path: str | None = None,
        forward: DataFrame | None = None,
    ):
        self.has_positions, self.path, self.forward = has_positions, path, forward
        given = {"docs": docs, "postings": postings, "terms": terms, "stats": stats}
        self.__dict__.update({name: table for name, table in given.items() if table is not None})

    @staticmethod
    def columns(table: str, positions: bool) -> list[str]:
        return {
            "docs": ["doc", "key", "dl", "dlq", "norm", "norm_inverse"],
            "postings": ["term", "doc", "tf", "norm"] + ["positions"] * positions,
            "terms": ["term", "df", "max_tf", "min_norm", "idf"],
            "stats": ["n_docs", "n_terms", "total_tokens", "avgdl"],
        }[table]

    @cached_property
    def counted(self) -> tuple[int, int, float]:
        """Documents, tokens, average length: one row, read once."""
        table = self.stats if self.forward is None else statistics(self.forward)
        return tuple(table.select("n_docs", "total_tokens", "avgdl").first() or (0, 0, 0.0))

    @cached_property
    def docs(self) -> DataFrame:
        return with_norms(self.forward.select("doc", "key", "dl"), F.lit(self.counted[2]).cast("float")).select(*Index.columns("docs", False))

    @cached_property
    def postings(self) -> DataFrame:
        return _flat(self.forward, self.has_positions).select(*Index.columns("postings", self.has_positions))

    @cached_property
    def terms(self) -> DataFrame:
        return dictionary(self.postings, self.counted[0])

    @cached_property
    def stats(self) -> DataFrame:
        return collection(self.terms, self.counted)


def tokenized(docs: DataFrame) -> DataFrame:
    """(doc, key, tokens, dl) of the documents that have tokens.

    ``docs`` has doc, key and text, or tokens of the caller's own, which are taken as they are.  A null or empty key is
    an error; so is, of the caller's tokens, a document without any or a null or empty token.  Texts without tokens are
    left out.
    """
    own = "tokens" in docs.columns
    if own:
        rows = docs.select("doc", "key", "tokens")
    else:  # asked of the text: a condition on the tokens would make them twice
        rows = docs.where(F.col("text").rlike(r"[\p{L}\p{Nd}]")).select("doc", "key", tokenize(F.col("text")).alias("tokens"))
    refuse = lambda why: F.raise_error(F.lit(why))
    if own:
        bad = F.exists("tokens", lambda t: t.isNull() | (t == ""))
        checked = F.when(F.col("tokens").isNull() | (F.size("tokens") == 0), refuse("a document has no tokens")).when(bad, refuse("a document has an empty token")).otherwise(F.col("tokens"))
        rows = rows.withColumn("tokens", checked)
    key = F.when(F.col("key").isNull() | (F.col("key") == ""), refuse("a document has no key")).otherwise(F.col("key"))
    return rows.withColumns({"key": key, "dl": F.size("tokens")})


def spread(docs: DataFrame) -> DataFrame:
    """``docs`` over all cores if it is too small to give each a split of its own; a large corpus stays where it lies."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return docs.repartition(cores, "doc") if size < SPREAD_BYTES * cores else docs


def forward(docs: DataFrame, positions: bool) -> DataFrame:
    """(doc, key, dl, packed, sampled): ``packed`` of some documents has the postings of these and of those after them,
    ``sampled`` every so manyth of them without counts.

    Tokens of many documents are numbered, sorted and cut into runs at once; postings stay packed, in chunks of about
    CHUNK, until they are shuffled once, by term.
    """
    rows = tokenized(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _pieces(batch):
                own = [some.column(c) for c in ("doc", "key", "dl")]
                found, rest = _postings(own[0], own[2], some.column("tokens"), positions), [None] * (some.num_rows - 1)
                sampled = _plain(found.select(["term", "doc"]).take(pa.array(np.arange(7, max(8, found.num_rows), STRIDE) % found.num_rows)))
                yield pa.RecordBatch.from_arrays([*own, *(pa.array([_chunks(x), *rest], pa.list_(pa.binary())) for x in (found, sampled))], ["doc", "key", "dl", "packed", "sampled"])

    kept = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("doc", "key", "dl"))
    return rows.mapInArrow(run, f"{kept}, packed array<binary>, sampled array<binary>")


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about TOGETHER tokens, or a single document that has more."""
    ends = np.cumsum(np.asarray(batch.column("dl"), np.int64))
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + TOGETHER, "right")))
        yield batch.slice(first, last - first)
        first = last


def _postings(doc: pa.Array, dl: pa.Array, tokens: pa.ListArray, positions: bool) -> pa.RecordBatch:
    """(term, doc, dl, tf) of lists of tokens, by document and term, perhaps with the places in the list."""
    lengths = np.asarray(dl, np.int64)
    coded = tokens.flatten().dictionary_encode()
    by = np.asarray(pc.sort_indices(coded.dictionary), np.int64)
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    keys = np.repeat(np.arange(len(lengths)) << 32, lengths) | rank[np.asarray(coded.indices)]
    order = np.argsort(keys, kind="stable") if positions else None
    keys = keys[order] if positions else np.sort(keys)
    begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    of, term = pa.array(keys[begins] >> 32), pa.array((keys[begins] & 0xFFFFFFFF).astype(np.int32))
    out = {"term": pa.DictionaryArray.from_arrays(term, coded.dictionary.take(pa.array(by))), "doc": doc.take(of), "dl": dl.take(of), "tf": pa.array(np.diff(np.append(begins, len(keys))))}
    if positions:
        places = np.arange(len(keys)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out["positions"] = pa.ListArray.from_arrays(pa.array(np.append(begins, len(keys)), pa.int32()), pa.array(places[order], pa.int32()))
    return pa.RecordBatch.from_pydict(out)


def _chunks(batch: pa.RecordBatch) -> list[bytes]:
    out = []
    for i in range(0, batch.num_rows, CHUNK):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as stream:
            stream.write_batch(batch.slice(i, CHUNK))
        out.append(sink.getvalue().to_pybytes())
    return out


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks of the last column."""
    for batch in batches:
        for chunks in batch.column(batch.num_columns - 1):
            for chunk in chunks.values if chunks.is_valid else ():
                yield pa.ipc.open_stream(chunk.as_buffer()).read_next_batch()


def _plain(batch: pa.RecordBatch) -> pa.RecordBatch:
    at = batch.schema.get_field_index("term")
    return batch.set_column(at, "term", batch.column(at).dictionary_decode())


def _flat_schema(rows: DataFrame, positions: bool) -> str:
    return f"term string, doc {rows.schema['doc'].dataType.simpleString()}, dl int, tf bigint" + ", positions array<int>" * positions


def _with_norm(postings: DataFrame) -> DataFrame:
    return postings.withColumn("norm", length_norm(F.col("dl")).cast("short"))


def _flat(rows: DataFrame, positions: bool) -> DataFrame:
    """The postings packed in forward ``rows``."""
    return _with_norm(rows.select("packed").where("packed is not null").mapInArrow(lambda batches: map(_plain, _unpacked(batches)), _flat_schema(rows, positions)))


def _parts(batch: pa.RecordBatch, terms: list[str], docs: np.ndarray) -> np.ndarray:
    """Of each posting how many of the bounds (term, doc), in order, are no later."""
    words, code, doc = batch.column("term").dictionary.to_pylist(), np.asarray(batch.column("term").indices), np.asarray(batch.column("doc"))
    least, most = (np.array([cut(terms, w) for w in words], np.int32) for cut in (bisect_left, bisect_right))
    part = least[code]
    for w in np.flatnonzero(most > least):  # terms that are themselves cut, by document
        here = np.flatnonzero(code == w)
        part[here] += np.searchsorted(docs[least[w] : most[w]], doc[here], "right").astype(np.int32)
    return part


def _merged(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches`` as one, sorted by term and document."""
    table = pa.Table.from_batches(batches).unify_dictionaries().combine_chunks()
    term = table.column("term").chunk(0)
    rank = np.empty(len(term.dictionary), np.int32)
    rank[np.asarray(pc.sort_indices(term.dictionary))] = np.arange(len(rank), dtype=np.int32)
    order = np.lexsort((np.asarray(table.column("doc").chunk(0)), rank[np.asarray(term.indices)]))
    for i in range(0, len(order), CHUNK):
        yield from map(_plain, table.take(pa.array(order[i : i + CHUNK])).combine_chunks().to_batches())


def placed(rows: DataFrame, positions: bool, tokens: int) -> DataFrame:
    """The postings of written forward ``rows``, range-partitioned and sorted by term and document.

    The ranges are of about as many postings each, got from a sample of some of the packed pieces; there are ``tokens``
    tokens in all.  What a piece has of a range is shuffled as one packed row.
    """
    every = max(1, tokens // TOGETHER // SAMPLED)
    packed = rows.where("packed is not null")
    taken = rows.where(F.col("sampled").isNotNull() & (F.pmod(F.xxhash64("doc"), F.lit(every)) == 0)).select("sampled")
    sample = taken.mapInArrow(_unpacked, f"term string, doc {rows.schema['doc'].dataType.simpleString()}").toArrow()
    keys = sorted(zip(sample["term"].to_pylist(), sample["doc"].to_pylist(), strict=True))
    postings, cores = len(keys) * STRIDE * every, rows.sparkSession.sparkContext.defaultParallelism
    ranges = max(1, -(-postings // RANGE), min(cores, postings // SMALL))
    bounds = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)})
    terms, docs = [t for t, _ in bounds], np.array([d for _, d in bounds], np.int64)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _unpacked(batches):
            part = _parts(batch, terms, docs)
            batch, part = batch.take(pa.array(by := np.argsort(part, kind="stable"))), part[by]
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            chunks = [_chunks(_narrow(batch.slice(a, z - a))) for a, z in zip(first.tolist(), [*first[1:].tolist(), len(part)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part[first]), pa.array(chunks, pa.list_(pa.binary()))], ["part", "packed"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := list(_unpacked(batches)):
            yield from _merged(held)

    spread = packed.select("packed").mapInArrow(split, "part int, packed array<binary>").repartitionById(len(bounds) + 1, F.col("part"))
    return _with_norm(spread.mapInArrow(merge, _flat_schema(rows, positions)))


def _narrow(batch: pa.RecordBatch) -> pa.RecordBatch:
    """``batch`` with those terms in its dictionary that lie from its first to its last."""
    at = batch.schema.get_field_index("term")
    code, words = np.asarray(batch.column(at).indices), batch.column(at).dictionary
    first = int(code.min())
    return batch.set_column(at, "term", pa.DictionaryArray.from_arrays(pa.array(code - first), words.slice(first, int(code.max()) - first + 1)))


def statistics(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_tokens")).withColumn("avgdl", average_length(F.col("total_tokens"), F.col("n_docs")))


def with_norms(rows: DataFrame, average: Column) -> DataFrame:
    lengths = rows.withColumns({"dlq": quantized_length(F.col("dl")), "norm": length_norm(F.col("dl"))})
    return lengths.withColumn("norm_inverse", norm_inverse(F.col("dlq"), average))


def build_index(docs: DataFrame, positions: bool = False) -> Index:
    """The tables of ``docs`` (doc, key, and text or tokens), as plans; save_index makes them a stored index."""
    return Index(forward=forward(spread(docs), positions), has_positions=positions)


def dictionary(postings: DataFrame, n_docs: int) -> DataFrame:
    found = postings.groupBy("term").agg(F.count("*").alias("df"), F.max("tf").alias("max_tf"), F.min("norm").alias("min_norm"))
    return found.withColumn("idf", idf(F.lit(n_docs), F.col("df")))


def collection(terms: DataFrame, counted: tuple[int, int, float]) -> DataFrame:
    n_docs, total, average = (F.lit(x).cast(t) for x, t in zip(counted, ("long", "long", "float"), strict=True))
    return terms.agg(F.count("*").alias("n_terms")).select(n_docs.alias("n_docs"), "n_terms", total.alias("total_tokens"), average.alias("avgdl"))


def vocabulary(docs: DataFrame, limit: int | None = None) -> DataFrame:
    """(term, first_doc, first_pos) in the order of first appearance; with ``limit`` the first so many terms."""
    places = tokenized(docs).select("doc", F.posexplode("tokens").alias("pos", "term"))
    first = places.groupBy("term").agg(F.min(F.struct("doc", "pos")).alias("first")).select("term", F.col("first.doc").alias("first_doc"), F.col("first.pos").cast("long").alias("first_pos"))
    return first if limit is None else first.orderBy("first_doc", "first_pos").limit(limit)


def _range_of(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are less than the value, by two steps of as many comparisons as their root."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    less = lambda some: F.size(F.filter(some, lambda b: b < value))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    nth = less(F.array(*[F.lit(g[0]) for g in groups]))  # groups whose first bound is less; only the last of them can have others that aren't
    last = F.get(F.array(*[F.array(*[F.lit(g[min(i, len(g) - 1)]) for i in range(step)]) for g in groups]), F.greatest(nth - 1, F.lit(0)))
    return F.least(F.when(nth > 0, (nth - 1) * step + less(last)).otherwise(0), F.lit(len(bounds)))


def numbered(postings: DataFrame) -> DataFrame:
    """``postings`` with ``nth``, the 0-based number of each among its term's, by document.

    For terms with more than FREQUENT postings documents are cut into RANGES ranges of about as many postings each; the
    numbers in a range start after the counts of the ranges before it, so that no task orders all postings of such a
    term.  There are fewer such terms than postings by FREQUENT.
    """
    often = F.broadcast(postings.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") > FREQUENT).select("term", F.lit(True).alias("often")))
    shares = [i / RANGES for i in range(1, RANGES)]
    bounds = sorted({*(postings.join(often, "term", "left_semi").agg(F.percentile_approx("doc", F.array(*map(F.lit, shares)), 10_000).alias("b")).first().b or [])})
    if not bounds:
        return postings.withColumn("nth", F.row_number().over(Window.partitionBy("term").orderBy("doc")) - 1)
    ranged = F.when(F.col("often"), _range_of(F.col("doc"), bounds)).otherwise(-1)
    counts = postings.join(often, "term").withColumn("range", _range_of(F.col("doc"), bounds)).groupBy("term", "range").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("term").orderBy("range")) - F.col("n")).drop("n")
    own = F.row_number().over(Window.partitionBy("term", "range").orderBy("doc")) - 1
    held = postings.join(often, "term", "left").withColumn("range", ranged).drop("often").withColumn("own", own)
    return held.join(F.broadcast(before), ["term", "range"], "left").withColumn("nth", F.coalesce("before", F.lit(0)) + F.col("own")).drop("range", "own", "before")


def impact_frontier(postings: DataFrame, block: int = 128, most: int = 24) -> DataFrame:
    """(term, block, norm, tf): of each block of a term's postings the (tf, norm) that no other beats in both.

    At most ``most`` a block: the last then takes the block's largest tf.
    """
    blocks = numbered(postings.select("term", "doc", "norm", "tf")).select("term", F.floor(F.col("nth") / block).cast("long").alias("block"), "norm", "tf")
    best = blocks.repartition("term", "block").groupBy("term", "block", "norm").agg(F.max("tf").alias("tf"))  # all that follows needs no other shuffle
    up = Window.partitionBy("term", "block").orderBy("norm")
    beaten = F.max("tf").over(up.rowsBetween(Window.unboundedPreceding, -1))
    kept = best.withColumn("before", beaten).where(F.col("before").isNull() | (F.col("tf") > F.col("before"))).drop("before")
    placed = kept.withColumns({"nth": F.row_number().over(up), "top": F.max("tf").over(Window.partitionBy("term", "block"))})
    return placed.where(F.col("nth") <= most).select("term", "block", "norm", F.when(F.col("nth") == most, F.col("top")).otherwise(F.col("tf")).alias("tf"))
