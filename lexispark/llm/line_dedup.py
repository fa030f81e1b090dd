"""Line dedup, DataFrame functions only.

Every line of at least ``min_length`` code points becomes a 128-bit key hash.  The hashes are range-partitioned,
with documents (largest first) and positions as secondary sort, and each range is streamed once: a row whose
document differs from the row before it is the first occurrence of the key in that document.  A key is salted by
document, so that the range of one that fills a third of the corpus is cut into many; the counts of the salts are
added up afterwards.  Keys in too many documents are then looked up from the sorted lines, and what comes back for
a document is a run-length coded keep bitmap, never text.

Defined cases: null or empty text is one empty line; rows are documents by ``doc_id``: rows that share one count once
per key and are kept or dropped together; a null ``doc_id`` counts as one document before all others; a document may
lose every line, its text is then empty; an empty table gives an empty table.  Columns of other names are ignored by
keep_bitmaps and carried by dedup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, cut, join_by_counts, others, spare

#: Into how many ranges a single key can be cut.
SALTS = 64
#: Most documents with bitmaps, and runs in these, that are broadcast.
MAX_BROADCAST_ROWS, MAX_BROADCAST_RUNS = 500_000, 2_000_000
ROW = "__row"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def row_hash(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(F.coalesce(doc_id, F.lit(-1)), doc_id.isNull(), text)


def hashed_lines(docs: DataFrame, min_length: int) -> DataFrame:
    """(h1, h2, salt, doc_id, row, pos) of each long line."""
    lines = docs.select("doc_id", row_hash(F.col("doc_id"), F.col("text")).alias(ROW), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keys = lines.where(F.length("line") >= min_length).withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_length)
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("byte")
    return keys.select(F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2"), salt.alias("salt"), "doc_id", ROW, "pos")


def sorted_lines(hashed: DataFrame) -> DataFrame:
    """(h1, h2, doc_id, row, pos, first) of the hashed lines, range-partitioned and sorted.

    ``first`` is 1 for the first occurrence of a key in a document.  Its window streams over the ranges as they are; it
    would shuffle and sort again over rows that were written and read back.
    """
    ranges = hashed.repartitionByRange("h1", "h2", "salt").sortWithinPartitions("h1", "h2", "salt", F.desc_nulls_last("doc_id"), ROW, "pos")
    stream = Window.partitionBy("h1", "h2", "salt").orderBy(F.desc_nulls_last("doc_id"), ROW, "pos")
    first = (F.row_number().over(stream) == 1) | ~F.col("doc_id").eqNullSafe(F.lag("doc_id").over(stream))
    return ranges.withColumn("first", first.cast("int")).drop("salt")


def common_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, n_docs, n_rows, keep_doc) of the keys found in at least ``min_docs`` documents."""
    counts = lines.groupBy("h1", "h2").agg(F.sum("first").alias("n_docs"), F.count("*").alias("n_rows"), F.max("doc_id").alias("keep_doc"))
    return counts.where(F.col("n_docs") >= min_docs)


def keep_bitmaps(docs: DataFrame, min_length: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, row, n_dropped, keep_runs) of the documents that lose lines.

    ``keep_runs`` lists (start, length) of the runs of ones in the document's keep bitmap, the last one open-ended
    (length null).
    """
    hashed = cut(hashed_lines(docs, min_length), "hashes")  # the ranges are sampled from these, not from the texts again
    lines = cut(sorted_lines(hashed), "lines")
    hot = cut(common_keys(lines, min_docs), "keys")
    dropped = join_by_counts(lines, hot, ["h1", "h2"], "n_rows").where(~F.col("doc_id").eqNullSafe(F.col("keep_doc")))
    per_doc = dropped.groupBy("doc_id", ROW).agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    before, after = lambda i: F.coalesce(F.get("gone", i - 1), F.lit(-1)) + 1, lambda i: F.get("gone", i)
    runs = F.transform(F.sequence(F.lit(0), F.size("gone")), lambda i: F.struct(before(i).alias("start"), (after(i) - before(i)).alias("length")))
    return per_doc.select("doc_id", ROW, F.size("gone").cast("long").alias("n_dropped"), F.filter(runs, lambda r: r.length.isNull() | (r.length > 0)).alias("keep_runs"))


def _deduped(docs: DataFrame, min_length: int, min_docs: int) -> tuple[DataFrame, list[str]]:
    """``docs`` with its lines dropped from text, and three more columns: lines before, lines dropped, runs kept; their names.

    Texts stay where they lie unless the bitmaps are too many to broadcast.
    """
    id_, row, before, dropped, runs = (spare(docs, f"__{name}") for name in ("id", "row", "n_lines", "n_dropped", "keep_runs"))
    found = keep_bitmaps(docs.select("doc_id", "text"), min_length, min_docs)
    bitmaps = cut(found.select(F.coalesce("doc_id", F.lit(-1)).alias(id_), F.col(ROW).alias(row), F.col("n_dropped").alias(dropped), F.col("keep_runs").alias(runs)), "bitmaps")
    held = bitmaps.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size(runs)), F.lit(0)).alias("runs")).first()
    few = held.rows <= MAX_BROADCAST_ROWS and held.runs <= MAX_BROADCAST_RUNS
    rows = docs.withColumns({id_: F.coalesce("doc_id", F.lit(-1)), row: row_hash(F.col("doc_id"), F.col("text"))})
    joined = rows.join(F.broadcast(bitmaps) if few else bitmaps, [id_, row], "left")
    lines = lines_of(F.col("text"))
    kept = F.flatten(F.transform(runs, lambda r: F.slice(lines, r.start + 1, F.coalesce(r.length, F.size(lines)))))
    text = F.when(F.col(runs).isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n"))
    out = joined.withColumns({before: F.size(lines).cast("long"), dropped: F.coalesce(dropped, F.lit(0).cast("long")), "text": text})
    return out.drop(id_, row), [before, dropped, runs]


def dedup_text(docs: DataFrame, min_length: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with its lines dropped from ``text`` and all else as it is."""
    return _deduped(docs, min_length, min_docs)[0].select(*_quoted(docs.columns))


def dedup(docs: DataFrame, min_length: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with its lines dropped from ``text``, and ``n_lines`` (before), ``n_dropped``, ``keep_runs`` in place of any such columns."""
    names = ("n_lines", "n_dropped", "keep_runs")
    out, found = _deduped(docs, min_length, min_docs)
    return out.select(*_quoted(others(docs, names)), *[F.col(f).alias(n) for f, n in zip(found, names, strict=True)])


def _quoted(names: list[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]
