"""An index as a folder of Parquet tables with a manifest, written whole and never changed."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import Index, collection, dictionary, placed

FORMAT, VERSION = "lexispark-index", 2
HASH = "__hash_of_row"
TABLES = ("docs", "postings", "terms", "stats")


class IndexFormatError(IOError):
    """What was found is not an index of this version, or isn't whole; the message says what was expected."""


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _sums(table: DataFrame) -> list[Column]:
    """Row count and a hash of all rows that doesn't depend on their order."""
    return [F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*table.columns)), F.lit(0)).alias("sum")]


def checksum(table: DataFrame) -> tuple[int, int]:
    return tuple(table.agg(*_sums(table)).first())


def save_index(index: Index, path: str, row_group_bytes: int = 16 << 20) -> None:
    """Writes the index; it appears under ``path`` only when it is complete.

    Texts are tokenised once, into a table of documents with their postings that is gone at the end; all others come
    from it.  Postings are range-partitioned and sorted by term and document, so that a lookup of some terms reads the
    row groups whose bounds hold them, and a frequent term is spread over many files; the ranges are sampled from that
    table, not from the texts again.  Checksums are taken of the rows as they are written.
    """
    spark = (index.forward or index.postings).sparkSession
    fs, where = _fs(spark, path)
    if fs.exists(where):
        raise FileExistsError(f"{path} exists; an index is written once")
    draft, sums = f"{path}.{uuid.uuid4().hex}.tmp", {}
    if index.forward is not None:
        index.forward.write.parquet(f"{draft}.forward")
        index = Index(forward=spark.read.parquet(f"{draft}.forward"), has_positions=index.has_positions)

    def put(name: str, table: DataFrame) -> DataFrame:
        seen = Observation()
        table = table.select(*Index.columns(name, index.has_positions))
        # the hash is made in generated code; an observation's own expressions are interpreted
        hashed = table.withColumn(HASH, F.xxhash64(*table.columns)).observe(seen, F.count("*").alias("n"), F.coalesce(F.bit_xor(HASH), F.lit(0)).alias("sum")).drop(HASH)
        written = hashed.write.option("parquet.block.size", row_group_bytes).option("parquet.writer.version", "v2").option("compression", "zstd")
        written.parquet(f"{draft}/{name}")
        sums[name] = (seen.get["n"], seen.get["sum"])
        return spark.read.parquet(f"{draft}/{name}")

    put("docs", index.docs)
    ordered = index.postings.repartitionByRange("term", "doc").sortWithinPartitions("term", "doc") if index.forward is None else placed(index.forward, index.has_positions, index.counted[1])
    postings = put("postings", ordered)
    # the dictionary of a new index is got from the postings just written
    terms = dictionary(postings, index.counted[0]) if index.forward is not None else index.terms
    terms = put("terms", terms.repartitionByRange("term").sortWithinPartitions("term"))
    put("stats", collection(terms, index.counted).coalesce(1))
    manifest = {"format": FORMAT, "version": VERSION, "positions": index.has_positions, "tables": {n: {"rows": r, "checksum": s} for n, (r, s) in sums.items()}}
    out = fs.create(_fs(spark, f"{draft}/manifest/part-0.txt")[1])
    out.write(bytearray(json.dumps(manifest), "utf-8"))
    out.close()
    fs.delete(_fs(spark, f"{draft}.forward")[1], True)
    if not fs.rename(_fs(spark, draft)[1], where):
        raise OSError(f"{draft} could not be moved to {path}")


def open_index(spark: SparkSession, path: str) -> Index:
    """Opens an index after a look at its manifest and schemas; verify() reads the rows."""
    fs, where = _fs(spark, path)
    if not fs.exists(where):
        raise FileNotFoundError(f"no index at {path}")
    try:
        manifest = json.loads("\n".join(r.value for r in spark.read.text(f"{path}/manifest").collect()))
    except Exception as e:
        raise IndexFormatError(f"{path} has no readable manifest of {FORMAT}") from e
    if not isinstance(manifest, dict) or manifest.get("format") != FORMAT:
        raise IndexFormatError(f"expected the format {FORMAT}, found {manifest.get('format') if isinstance(manifest, dict) else manifest!r}")
    if manifest.get("version") != VERSION:
        raise IndexFormatError(f"expected version {VERSION}, found {manifest.get('version')}")
    tables = {}
    for name in TABLES:
        if name not in manifest.get("tables", {}):
            raise IndexFormatError(f"the manifest doesn't list the table {name}")
        try:
            tables[name] = spark.read.parquet(f"{path}/{name}")
        except Exception as e:
            raise IndexFormatError(f"the table {name} is missing or damaged") from e
        lacking = {*Index.columns(name, manifest["positions"])} - {*tables[name].columns}
        if lacking:
            raise IndexFormatError(f"the table {name} lacks {sorted(lacking)}")
    return Index(**tables, has_positions=manifest["positions"], path=path)


def verify(spark: SparkSession, path: str) -> None:
    """Reads every row and compares with the manifest."""
    open_index(spark, path)
    manifest = json.loads("\n".join(r.value for r in spark.read.text(f"{path}/manifest").collect()))
    for name in TABLES:
        expected = manifest["tables"][name]
        try:
            rows, found = checksum(spark.read.parquet(f"{path}/{name}"))
        except Exception as e:
            raise IndexFormatError(f"the table {name} can't be read") from e
        if (rows, found) != (expected["rows"], expected["checksum"]):
            raise IndexFormatError(f"{name}: expected {expected['rows']} rows with checksum {expected['checksum']}, found {rows} with {found}")


def size_in_bytes(spark: SparkSession, path: str) -> int:
    fs, where = _fs(spark, path)
    return fs.getContentSummary(where).getLength()
