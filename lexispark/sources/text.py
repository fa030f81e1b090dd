"""Corpora and query lists from tab-separated text, and generated ones."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tokenize
from .shared import shared_dir


def number_rows(df: DataFrame, name: str) -> DataFrame:
    """Adds the 0-based number of each row in the order of its partitions; rows stay where they are.

    Only the partitions' counts meet; there are as many as partitions.  A plan with a shuffle is written first, as its
    partitions need not be the same twice; those of a scan are.
    """
    row, part = "__row_of_number_rows", "__part_of_number_rows"
    marked = df.withColumn(row, F.monotonically_increasing_id())  # the partition's number, and 33 bits of the row's in it
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        folder, context = shared_dir(df.sparkSession), df.sparkSession.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(folder)
        marked = marked.checkpoint()
    counts = marked.groupBy(F.shiftright(row, 33).alias(part)).agg(F.count("*").alias("n"))
    before = counts.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias("before"))
    own = marked.withColumn(part, F.shiftright(row, 33)).join(F.broadcast(before.withColumnRenamed("before", f"{part}_before")), part)
    number = F.col(f"{part}_before") + F.col(row).bitwiseAND(F.lit((1 << 33) - 1))
    return own.withColumn(name, number.cast("long")).select(*[c for c in df.columns if c != name], name)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.text(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"no text at {path}") from e


def _cut_at_tab(lines: DataFrame) -> DataFrame:
    at = F.instr("value", "\t")
    return lines.select(
        F.when(at > 0, F.expr("substring(value, 1, instr(value, '\t') - 1)")).alias("id"),
        F.when(at > 0, F.expr("substring(value, instr(value, '\t') + 1)")).otherwise(F.col("value")).alias("text"),
    )


def tsv_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc, key, text) of the lines ``id<TAB>text``, cut at the first tab.

    Lines without tokens are left out.  A line without a tab is all text, and its key is the number of documents
    before it.
    """
    lines = _lines(spark, path).where(F.trim("value") != "")
    found = _cut_at_tab(lines).where(F.size(tokenize(F.col("text"))) > 0)
    return number_rows(found, "doc").select("doc", F.coalesce("id", F.col("doc").cast("string")).alias("key"), "text")


def query_file(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(qid, text) of the lines ``qid<TAB>query`` that have tokens; the first ``limit`` of them."""
    found = _cut_at_tab(_lines(spark, path)).where(F.col("id").isNotNull() & (F.size(tokenize(F.col("text"))) > 0))
    numbered = number_rows(found, "nth")
    kept = numbered if limit is None else numbered.where(F.col("nth") < limit)
    return kept.select(F.col("id").alias("qid"), "text")


def generated_word(rank: int) -> str:
    """A distinct word for each rank: its digits to the base of 26 as letters, the least first."""
    out = chr(97 + rank % 26)
    while rank >= 26:
        rank = rank // 26 - 1
        out += chr(97 + rank % 26)
    return out


def generated_corpus(spark: SparkSession, docs: int, vocabulary: int, shortest: int, longest: int, seed: int) -> DataFrame:
    """(doc, key, tokens) whose terms follow Zipf's law: the term of rank r has a weight of 1 / (r + 1)."""
    total, bounds = sum(1 / (r + 1) for r in range(vocabulary)), []
    for r in range(vocabulary):
        bounds.append((bounds[-1] if bounds else 0.0) + 1 / (r + 1) / total)
    words = F.array(*[F.lit(generated_word(r)) for r in range(vocabulary)])
    ends = F.array(*[F.lit(b) for b in bounds])
    # a hash of (document, position) stands for the random draw, so that a lost task draws the same again
    draw = lambda i: F.pmod(F.xxhash64(F.lit(seed), "doc", i), F.lit(1 << 40)) / float(1 << 40)
    n = F.lit(shortest) + F.pmod(F.xxhash64(F.lit(seed + 1), "doc"), F.lit(longest - shortest + 1)).cast("int")
    pick = lambda i: F.element_at(words, F.least(F.size(F.filter(ends, lambda e: e < draw(i))) + 1, F.lit(vocabulary)))
    rows = spark.range(docs).withColumnRenamed("id", "doc")
    return rows.select("doc", F.concat(F.lit("d"), "doc").alias("key"), F.transform(F.sequence(F.lit(1), n), pick).alias("tokens"))
