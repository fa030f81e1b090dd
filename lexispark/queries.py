"""The registered retrieval queries, each with the SQL that computes the same from the raw tables."""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Callable
from contextlib import redirect_stderr, redirect_stdout

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .app import Service, main
from .functions import decoded_length, display, idf, length_norm, normalize_term, quantized_length, tokenize
from .operators import Index, Searcher, build_index
from .operators.tables import impact_frontier, tokenized, vocabulary
from .plans import And, Or, Phrase, Query, Term
from .operators.search import NoPositionsError
from .sources import IndexFormatError, generated_corpus, number_rows, open_index, query_file, save_index, tsv_corpus
from .sources.shared import drop_at_exit, shared_dir
from .sources.store import verify

Run = Callable[[SparkSession, str], DataFrame]
#: (Spark application, table path): its index, opened.
_BUILT: dict[tuple[str, str], Index] = {}


def corpus(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """(doc, key, text) of a prose table."""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if table == "documents":
        doc, text = F.col("doc_id"), "text"
    elif table == "pages":
        doc, text = F.col("page_id"), "html"
    elif table == "benchmark":
        doc, text = F.col("item_id"), "text"
    else:
        doc, text = F.col("conv_id") * 1000 + F.col("turn"), "text"
    return rows.select(doc.alias("doc"), doc.cast("string").alias("key"), F.col(text).alias("text"))


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares, gone when the session ends."""
    return drop_at_exit(spark, f"{shared_dir(spark)}/lexispark-{name}-{uuid.uuid4().hex}")


def stored(spark: SparkSession, sf_dir: str, table: str = "documents") -> Index:
    """The table's index with positions, built, written and opened at its first use in a session."""
    at = (spark.sparkContext.applicationId, f"{sf_dir}/{table}")
    if at not in _BUILT:
        path = work_path(spark, "index")
        save_index(build_index(corpus(spark, sf_dir, table), positions=True), path)
        _BUILT[at] = open_index(spark, path)
    return _BUILT[at]


def searcher(spark: SparkSession, sf_dir: str, table: str = "documents") -> Searcher:
    return Searcher(stored(spark, sf_dir, table))


# -- SQL over the raw tables, from the tokens up


def _base(table: str = "documents", doc: str = "doc_id", text: str = "text") -> str:
    return rf"""
WITH lo AS (SELECT {doc} AS doc, lower(translate(coalesce({text}, ''), 'Σİ', 'σi')) AS x FROM {table}),
ru AS (SELECT doc, x, regexp_extract_all(x, '[\p{{L}}\p{{Nd}}]+') AS runs FROM lo),
tok AS MATERIALIZED (SELECT doc, CASE WHEN coalesce(list_max(list_transform(runs, lambda r: length(r))), 0) > 255 THEN regexp_extract_all(x, '[\p{{L}}\p{{Nd}}]{{1,255}}') ELSE runs END AS tokens FROM ru),
d AS (SELECT doc, tokens, len(tokens) AS dl, length(ltrim(bin(greatest(len(tokens) - 24, 0)), '0')) - 4 AS b FROM tok WHERE len(tokens) > 0),
st AS (SELECT count(*) AS n, sum(dl) AS t, CAST(sum(dl) / CAST(count(*) AS DOUBLE) AS FLOAT) AS avgdl FROM d),
q AS (SELECT doc, dl, CASE WHEN dl < 40 THEN dl ELSE 24 + (((dl - 24) >> b) << b) END AS dlq,
  CASE WHEN dl < 32 THEN dl ELSE 24 + ((((dl - 24) >> b) & 7) | ((b + 1) << 3)) END AS norm FROM d),
dn AS (SELECT doc, dl, dlq, norm, CAST(CAST(1 AS FLOAT) / (CAST(1.2 AS FLOAT) * (CAST(0.25 AS FLOAT) + CAST((CAST(0.75 AS FLOAT) * CAST(dlq AS FLOAT)) / avgdl AS FLOAT))) AS FLOAT) AS ni FROM q, st),
o AS (SELECT doc, unnest(tokens) AS term, unnest(range(len(tokens))) AS pos FROM d),
p AS (SELECT term, doc, count(*) AS tf FROM o GROUP BY term, doc),
tm AS (SELECT term, count(*) AS df, max(tf) AS max_tf, min(norm) AS min_norm, CAST(ln(1.0::DOUBLE + (any_value(n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS FLOAT) AS idf
  FROM p JOIN dn USING (doc), st GROUP BY term)
"""


def _values(terms: tuple[str, ...]) -> str:
    return "c(idx, term) AS (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(terms)) + ")"


_PART = "CAST({w} - CAST({w} / (CAST(1 AS FLOAT) + CAST({tf} AS FLOAT) * ni) AS FLOAT) AS FLOAT)"


def _matches(query: Query) -> str:
    terms = query.terms
    if isinstance(query, Phrase):
        return rf""", {_values(terms)},
w AS (SELECT list_reduce(list(idf ORDER BY idx), lambda a, b: CAST(a + b AS FLOAT)) AS w, count(*) AS found FROM c JOIN tm USING (term)),
occ AS (SELECT doc, pos - idx AS start FROM o JOIN c USING (term) GROUP BY doc, pos - idx HAVING count(*) = {len(terms)}),
s AS (SELECT doc, {_PART.format(w="w", tf="tf")} AS score FROM (SELECT doc, count(*) AS tf FROM occ GROUP BY doc) JOIN dn USING (doc), w WHERE found = {len(terms)})
"""
    having = f"HAVING count(*) = {len(terms)}" if isinstance(query, And) else ""
    return rf""", {_values(terms)},
s AS (SELECT doc, CAST(sum({_PART.format(w="idf", tf="tf")}::DOUBLE) AS FLOAT) AS score FROM p JOIN c USING (term) JOIN tm USING (term) JOIN dn USING (doc) GROUP BY doc {having})
"""


def _top_sql(query: Query, k: int, base: str) -> str:
    return base + _matches(query) + f"SELECT row_number() OVER (ORDER BY score DESC, doc) AS rank, doc, CAST(doc AS VARCHAR) AS key, score FROM s ORDER BY score DESC, doc LIMIT {k}"


def _count_sql(query: Query, base: str) -> str:
    return base + _matches(query) + "SELECT count(*) AS n FROM s"


QUERIES: dict[str, Run] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, run: Run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLE_SQL[name] = sql


_DOCS = _base()
SEARCHES: dict[str, tuple[Query, int]] = {
    "search_term_common": (Term("the"), 10),
    "search_term_rare": (Term("license"), 10),
    "search_term_absent": (Term("manhattan"), 10),
    "search_and2": (And("the", "license"), 10),
    "search_and3": (And("the", "of", "license"), 10),
    "search_and_absent": (And("the", "manhattan"), 10),
    "search_and_order_independent": (And("license", "of", "the"), 10),
    "search_and_duplicate_clause": (And("the", "license", "the"), 10),
    "search_or3": (Or("the", "and", "la"), 10),
    "search_or_with_absent": (Or("manhattan", "project", "license"), 10),
    "search_or_duplicate_clause": (Or("the", "license", "the"), 10),
    "search_one_clause_and": (And("license"), 10),
    "search_phrase2": (Phrase("of", "the"), 10),
    "search_phrase3": (Phrase("of", "the", "and"), 10),
    "search_phrase_repeated": (Phrase("the", "the"), 10),
    "search_phrase_repeated3": (Phrase("the", "the", "the"), 10),
    "search_phrase_reversed": (Phrase("the", "of"), 10),
    "search_phrase_nonadjacent": (Phrase("the", "license"), 10),
    "search_phrase_absent": (Phrase("the", "manhattan"), 10),
    "search_phrase_one_term": (Phrase("license"), 10),
}
for _name, (_query, _k) in SEARCHES.items():
    _add(_name, lambda spark, sf, q=_query, k=_k: searcher(spark, sf).top(q, k), _top_sql(_query, _k, _DOCS))
COUNTS: dict[str, Query] = {
    "count_term": Term("the"),
    "count_term_absent": Term("manhattan"),
    "count_and": And("the", "license"),
    "count_and_duplicate": And("the", "the", "la"),
    "count_or": Or("the", "la", "license"),
    "count_phrase": Phrase("of", "the"),
}
for _name, _query in COUNTS.items():
    _add(_name, lambda spark, sf, q=_query: searcher(spark, sf).count_table(q), _count_sql(_query, _DOCS))
_OR = SEARCHES["search_or3"][0]
_SELECTIVE = Or("license", "apache", "the")
_add("search_or_pruned", lambda spark, sf: searcher(spark, sf).top_pruned(_SELECTIVE, 3), _top_sql(_SELECTIVE, 3, _DOCS))
_add("search_pages", lambda spark, sf: searcher(spark, sf, "pages").top(Or("the", "license", "article"), 10), _top_sql(Or("the", "license", "article"), 10, _base("pages", "page_id", "html")))
_add(
    "search_conversations",
    lambda spark, sf: searcher(spark, sf, "conversations").top(And("the", "of"), 10),
    _top_sql(And("the", "of"), 10, _base("(SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)")),
)


def _exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(corpus(spark, sf_dir)).select(F.col("doc").alias("doc_id"), F.posexplode("tokens").alias("pos", "term")).select("doc_id", F.col("pos").cast("long").alias("pos"), "term")


_add("tokenize_documents", _exploded, _DOCS + "SELECT doc AS doc_id, pos, term FROM o")
_add(
    "normalize_term",
    lambda spark, sf: corpus(spark, sf, "pages").select(F.col("doc").alias("page_id"), normalize_term(F.col("text")).alias("term")),
    r"SELECT page_id, substr(regexp_extract(lower(translate(html, 'Σİ', 'σi')), '[\p{L}\p{Nd}]+'), 1, 255) AS term FROM pages",
)
_add(
    "token_split_255",
    lambda spark, sf: corpus(spark, sf)
    .select(F.col("doc").alias("doc_id"), tokenize(F.concat(F.repeat(F.lit("a"), 600), F.lit(" "), F.repeat(F.lit("é"), F.pmod("doc", F.lit(700)).cast("int")))).alias("t"))
    .select("doc_id", F.size("t").cast("long").alias("tokens"), F.transform("t", F.length).cast("string").alias("lengths")),
    r"""SELECT doc_id, len(t) AS tokens, '[' || array_to_string(list_transform(t, lambda x: length(x)), ', ') || ']' AS lengths FROM (
SELECT doc_id, regexp_extract_all(lower(repeat('a', 600) || ' ' || repeat('é', CAST(doc_id % 700 AS INT))), '[\p{L}\p{Nd}]{1,255}') AS t FROM documents)""",
)
_lengths = lambda *c: lambda spark, sf: stored(spark, sf).docs.select("doc", *[F.col(x).cast("long").alias(x) for x in c])
_add("doc_lengths", _lengths("dl"), _DOCS + "SELECT doc, CAST(dl AS BIGINT) AS dl FROM d")
_add("quantized_lengths", _lengths("dl", "dlq", "norm"), _DOCS + "SELECT doc, CAST(dl AS BIGINT) AS dl, CAST(dlq AS BIGINT) AS dlq, CAST(norm AS BIGINT) AS norm FROM dn")
_add(
    "quantized_lengths_range",
    lambda spark, sf: spark.range(70_001).select(F.col("id").alias("n"), quantized_length(F.col("id")).cast("long").alias("q")),
    "SELECT n, CASE WHEN n < 40 THEN n ELSE 24 + (((n - 24) >> b) << b) END AS q FROM (SELECT n, length(ltrim(bin(greatest(n - 24, 0)), '0')) - 4 AS b FROM range(70001) r(n))",
)
_add("norm_inverse", lambda spark, sf: stored(spark, sf).docs.select("doc", "norm_inverse"), _DOCS + "SELECT doc, ni AS norm_inverse FROM dn")
_add(
    "collection_stats",
    lambda spark, sf: searcher(spark, sf).statistics(),
    _DOCS + "SELECT n AS n_docs, (SELECT count(*) FROM tm) AS n_terms, CAST(t AS BIGINT) AS total_tokens, avgdl, true AS has_positions FROM st",
)
_add(
    "term_stats",
    lambda spark, sf: stored(spark, sf).terms.select("term", "df", "max_tf", F.col("min_norm").cast("long").alias("min_norm")),
    _DOCS + "SELECT term, df, max_tf, CAST(min_norm AS BIGINT) AS min_norm FROM tm",
)
_add("idf_table", lambda spark, sf: stored(spark, sf).terms.select("term", "df", "idf"), _DOCS + "SELECT term, df, idf FROM tm")
_add(
    "idf_function",
    lambda spark, sf: spark.range(1, 5001).select(F.col("id").alias("df"), idf(F.lit(5000), F.col("id")).alias("idf")),
    "SELECT df, CAST(ln(1.0::DOUBLE + (5000 - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS FLOAT) AS idf FROM range(1, 5001) r(df)",
)
_LOOKED_UP = ("the", "license", "apache", "la")
_IN = ", ".join(f"'{t}'" for t in _LOOKED_UP)
_add("postings_filtered", lambda spark, sf: stored(spark, sf).postings.where(F.col("term").isin(*_LOOKED_UP)).select("term", "doc", "tf"), _DOCS + f"SELECT term, doc, tf FROM p WHERE term IN ({_IN})")
_add(
    "positions_filtered",
    lambda spark, sf: stored(spark, sf).postings.where(F.col("term").isin(*_LOOKED_UP)).select("term", "doc", F.array_join("positions", ",").alias("positions")),
    _DOCS + f"SELECT term, doc, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM o WHERE term IN ({_IN}) GROUP BY term, doc",
)
_add(
    "doc_frequency_lookup",
    lambda spark, sf: spark.createDataFrame([(t, searcher(spark, sf).doc_frequency(t)) for t in ("the", "license", "manhattan")], "term string, df long"),
    _DOCS + "SELECT v.term, coalesce(tm.df, 0) AS df FROM (VALUES ('the'), ('license'), ('manhattan')) v(term) LEFT JOIN tm USING (term)",
)
_add(
    "doc_key_lookup",
    lambda spark, sf: spark.createDataFrame([(d, searcher(spark, sf).doc_key(d)) for d in (0, 7, 42)], "doc long, key string"),
    "SELECT doc_id AS doc, CAST(doc_id AS VARCHAR) AS key FROM documents WHERE doc_id IN (0, 7, 42)",
)
_add(
    "vocabulary_first_seen",
    lambda spark, sf: vocabulary(corpus(spark, sf)),
    _DOCS + "SELECT term, doc AS first_doc, pos AS first_pos FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY doc, pos) AS r FROM o) WHERE r = 1",
)
_add(
    "vocabulary_top",
    lambda spark, sf: vocabulary(corpus(spark, sf), 500),
    _DOCS + "SELECT term, doc AS first_doc, pos AS first_pos FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY doc, pos) AS r FROM o) WHERE r = 1 ORDER BY doc, pos LIMIT 500",
)
_add(
    "batch_search_topk",
    lambda spark, sf: searcher(spark, sf).batch(corpus(spark, sf, "benchmark").select(F.col("doc").alias("qid"), "text"), 10),
    _DOCS
    + rf""", qt AS (SELECT item_id AS qid, unnest(regexp_extract_all(lower(translate(text, 'Σİ', 'σi')), '[\p{{L}}\p{{Nd}}]+')) AS term FROM benchmark),
qc AS (SELECT qid, term, count(*) AS times FROM qt GROUP BY qid, term),
s AS (SELECT qid, doc, CAST(sum({_PART.format(w="idf", tf="tf")}::DOUBLE * times) AS FLOAT) AS score FROM p JOIN qc USING (term) JOIN tm USING (term) JOIN dn USING (doc) GROUP BY qid, doc)
SELECT qid, rank, doc, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM s) WHERE rank <= 10""",
)
_add(
    "impact_frontier",
    lambda spark, sf: impact_frontier(stored(spark, sf).postings).select("term", "block", F.col("norm").cast("long").alias("norm"), "tf"),
    _DOCS
    + """, bl AS (SELECT term, (row_number() OVER (PARTITION BY term ORDER BY doc) - 1) // 128 AS block, norm, tf FROM p JOIN dn USING (doc)),
m AS (SELECT term, block, norm, max(tf) AS tf FROM bl GROUP BY term, block, norm),
f AS (SELECT *, max(tf) OVER (PARTITION BY term, block ORDER BY norm ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m),
g AS (SELECT term, block, norm, tf, row_number() OVER (PARTITION BY term, block ORDER BY norm) AS nth, max(tf) OVER (PARTITION BY term, block) AS top FROM f WHERE before IS NULL OR tf > before)
SELECT term, block, CAST(norm AS BIGINT) AS norm, CASE WHEN nth = 24 THEN top ELSE tf END AS tf FROM g WHERE nth <= 24""",
)


def index_roundtrip_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Builds, writes, verifies and opens an index of its own, and searches it."""
    path = work_path(spark, "roundtrip")
    save_index(build_index(corpus(spark, sf_dir)), path)
    verify(spark, path)
    return Searcher(open_index(spark, path)).top(_OR, 10)


_add("index_roundtrip_search", index_roundtrip_search, ORACLE_SQL["search_or3"])


def verify_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of each table of a verified index."""
    index = stored(spark, sf_dir)
    verify(spark, index.path)
    manifest = json.loads(spark.read.text(f"{index.path}/manifest").first().value)
    return spark.createDataFrame([(name, table["rows"]) for name, table in manifest["tables"].items()], "name string, n_rows long")


_add(
    "verify_ok",
    verify_ok,
    _DOCS + "SELECT 'docs' AS name, (SELECT count(*) FROM d) AS n_rows UNION ALL SELECT 'postings', (SELECT count(*) FROM p) UNION ALL SELECT 'terms', (SELECT count(*) FROM tm) UNION ALL SELECT 'stats', 1",
)


def _tabbed(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The benchmark passages as a tab-separated file."""
    path = work_path(spark, name)
    rows = corpus(spark, sf_dir, "benchmark").where(F.size(tokenize(F.col("text"))) > 0)
    rows.select(F.concat("key", F.lit("\t"), F.regexp_replace("text", r"[\r\n]", " "))).write.text(path)
    return path


_ONE_LINE = r"regexp_replace(text, '[\r\n]', ' ', 'g') AS text FROM benchmark"
_add("tsv_scan", lambda spark, sf: tsv_corpus(spark, _tabbed(spark, sf, "tsv")).select("key", "text"), f"SELECT CAST(item_id AS VARCHAR) AS key, {_ONE_LINE}")
_add("query_file_scan", lambda spark, sf: query_file(spark, _tabbed(spark, sf, "queries")), f"SELECT CAST(item_id AS VARCHAR) AS qid, {_ONE_LINE}")
_add(
    "number_rows",
    lambda spark, sf: number_rows(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").orderBy("doc_id"), "nth"),
    "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS nth FROM documents",
)


def caller_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of an index of the caller's own tokens, which keep their case and signs."""
    words = F.filter(F.split("text", " "), lambda w: w != "")
    return build_index(corpus(spark, sf_dir, "benchmark").select("doc", "key", words.alias("tokens"))).terms.select("term", "df", "max_tf")


_add(
    "caller_tokens",
    caller_tokens,
    """SELECT term, count(*) AS df, max(tf) AS max_tf FROM (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(string_split(text, ' ')) AS term FROM benchmark) WHERE term <> '' GROUP BY item_id, term) GROUP BY term""",
)
_add(
    "term_order",
    lambda spark, sf: stored(spark, sf).terms.select("term").orderBy("term").limit(100).select(F.row_number().over(Window.orderBy("term")).cast("long").alias("nth"), "term"),
    _DOCS + "SELECT row_number() OVER (ORDER BY term) AS nth, term FROM tm ORDER BY term LIMIT 100",
)
_add(
    "decoded_lengths",
    lambda spark, sf: spark.range(70_001).select(F.col("id").alias("n"), decoded_length(length_norm(F.col("id").cast("int"))).cast("long").alias("q")),
    ORACLE_SQL["quantized_lengths_range"],
)


def generated_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generated corpus keeps to its limits and is the same each time."""
    one, two = (generated_corpus(spark, 2000, 50, 3, 9, seed=4) for _ in range(2))
    terms = one.select(F.explode("tokens").alias("t"))
    return one.agg(F.count("*").alias("docs"), F.countDistinct("key").alias("keys"), F.min(F.size("tokens")).cast("long").alias("shortest"), F.max(F.size("tokens")).cast("long").alias("longest")).withColumns(
        {"terms": F.lit(terms.distinct().count()), "changed": F.lit(one.exceptAll(two).count())}
    )


_add("generated_lengths", generated_lengths, "SELECT 2000 AS docs, 2000 AS keys, 3 AS shortest, 9 AS longest, 50 AS terms, 0 AS changed")


def _outcome(run: Callable[[], object]) -> str:
    try:
        run()
    except (ValueError, IndexError, OSError, NoPositionsError) as e:
        return type(e).__name__
    return "none"


def _values_sql(rows: list[tuple[str, object]], columns: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(repr(r) for r in rows)}) v({columns})"


def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What wrong queries and wrong use get."""
    s = searcher(spark, sf_dir)
    plain = Searcher(build_index(corpus(spark, sf_dir, "benchmark")))
    tries = {
        "empty term": lambda: Term(""),
        "no clauses": lambda: And(),
        "empty clause": lambda: Or("a", ""),
        "nested clause": lambda: And("a", Or("b")),
        "null clause": lambda: Or(None),
        "empty phrase": lambda: Phrase(),
        "k of zero": lambda: s.top(Term("the"), 0),
        "negative k": lambda: s.top(Or("the", "of"), -1),
        "no query": lambda: s.top(None, 1),
        "unknown kind": lambda: s.top("the", 1),
        "phrase without positions": lambda: plain.top(Phrase("of", "the"), 1),
        "unknown document": lambda: s.doc_key(-1),
        "good query": lambda: s.top(Or("the", "of"), 1),
    }
    return spark.createDataFrame([(name, _outcome(run)) for name, run in tries.items()], "attempt string, error string")


_REFUSED = {"phrase without positions": "NoPositionsError", "unknown document": "IndexError", "good query": "none"}
_add(
    "refusals",
    refusals,
    _values_sql(
        [(a, _REFUSED.get(a, "ValueError")) for a in ("empty term", "no clauses", "empty clause", "nested clause", "null clause", "empty phrase", "k of zero", "negative k", "no query", "unknown kind", *_REFUSED)], "attempt, error"
    ),
)


def format_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What opening damaged indexes gets."""
    manifest = json.loads(spark.read.text(f"{stored(spark, sf_dir).path}/manifest").first().value)
    damaged = {
        "other format": json.dumps(manifest | {"format": "other"}),
        "other version": json.dumps(manifest | {"version": 99}),
        "no table list": json.dumps({k: v for k, v in manifest.items() if k != "tables"}),
        "no tables": json.dumps(manifest),
        "not json": "???",
    }
    out = [("no folder", _outcome(lambda: open_index(spark, work_path(spark, "none"))))]
    for name, text in damaged.items():
        path = work_path(spark, "damaged")
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/manifest")
        out.append((name, _outcome(lambda p=path: open_index(spark, p))))
    return spark.createDataFrame(out, "damage string, error string")


_add("format_errors", format_errors, _values_sql([("no folder", "FileNotFoundError"), *((d, IndexFormatError.__name__) for d in ("other format", "other version", "no table list", "no tables", "not json"))], "damage, error"))


def exact_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = {name: searcher(spark, sf_dir).search(query, 3) for name, query in COUNTS.items()}
    return spark.createDataFrame([(name, f.total, f.exact) for name, f in found.items()], "name string, total long, exact boolean")


_add("exact_totals", exact_totals, " UNION ALL ".join(f"SELECT '{name}' AS name, n AS total, true AS exact FROM ({_count_sql(query, _DOCS)})" for name, query in COUNTS.items()))


def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    service = Service(spark, stored(spark, sf_dir).path, max_k=50)
    asked = [("license", 3, "or"), ("the license", 3, "AND"), ("of the", 2, "phrase"), ("the", 0, "or"), ("the", 51, "or"), ("the", 5, "xor"), (" !!! ??? ", 5, "or")]
    answers = [(q, k, op, *service.search(q, k, op)) for q, k, op in asked] + [("the", 5, "or", *Service(spark, "/nowhere/index").search("the", 5, "or"))]
    return spark.createDataFrame([(q, k, op, status, body.get("totalHits", -1)) for q, k, op, status, body in answers], "q string, k long, op string, status long, total long")


_add(
    "request_validation",
    request_validation,
    f"""SELECT 'license' AS q, 3 AS k, 'or' AS op, 200 AS status, n AS total FROM ({_count_sql(Term("license"), _DOCS)})
UNION ALL SELECT 'the license', 3, 'AND', 200, n FROM ({_count_sql(And("the", "license"), _DOCS)})
UNION ALL SELECT 'of the', 2, 'phrase', 200, n FROM ({_count_sql(Phrase("of", "the"), _DOCS)})
UNION ALL SELECT * FROM (VALUES ('the', 0, 'or', 400, -1), ('the', 51, 'or', 400, -1), ('the', 5, 'xor', 400, -1), (' !!! ??? ', 5, 'or', 400, -1), ('the', 5, 'or', 503, -1)) v""",
)


def search_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The body of an answered request, a row for each hit."""
    _, body = Service(spark, stored(spark, sf_dir).path).search("the LICENSE", 5, "And")
    assert body["returned"] == len(body["hits"]) and body["totalHitsExact"]
    rows = [(body["operator"], body["totalHits"], i, h["id"]) for i, h in enumerate(body["hits"], 1)]
    return spark.createDataFrame(rows, "operator string, total long, rank long, id string")


_LICENSED = And("the", "license")
_add(
    "search_request",
    search_request,
    f"SELECT 'and' AS operator, (SELECT n FROM ({_count_sql(_LICENSED, _DOCS)})) AS total, rank, key AS id FROM ({_top_sql(_LICENSED, 5, _DOCS)})",
)


def service_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    service = Service(spark, stored(spark, sf_dir).path)
    (status, body), (health, _), (gone, _) = service.stats(), service.health(), Service(spark, "/nowhere/index").health()
    return spark.createDataFrame([(status, health, gone, body["documents"], body["terms"], body["tokens"], body["fileBytes"] > 0)], "status long, health long, gone long, documents long, terms long, tokens long, bytes boolean")


_add("service_stats", service_stats, _DOCS + "SELECT 200 AS status, 200 AS health, 503 AS gone, n AS documents, (SELECT count(*) FROM tm) AS terms, CAST(t AS BIGINT) AS tokens, true AS bytes FROM st")


def command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit code and first line of output of commands on an index of the benchmark passages."""
    corpus_file, folder = _tabbed(spark, sf_dir, "corpus"), work_path(spark, "cli")
    commands = [
        ("index", corpus_file, folder, "--positions"), ("stats", folder), ("verify", folder), ("search", folder, "-k", "3", "the", "of"), ("search", folder, "--and", "the", "of"), ("search", folder, "--phrase", "of", "the"),
        (), ("search", folder), ("search", folder, "-k", "x", "the"), ("search", folder, "--and", "--phrase", "the"), ("search", folder, "-k", "0", "the"), ("stats", "/nowhere/index"), ("index", "/nowhere/corpus", f"{folder}-2"),
    ]
    out = []
    for nth, command in enumerate(commands):
        text = io.StringIO()
        with redirect_stdout(text), redirect_stderr(io.StringIO()):
            code = main(list(command), spark)
        out.append((nth, code, text.getvalue().split("\n")[0]))
    return spark.createDataFrame(out, "nth long, code long, line string")


_PASSAGES = _base("benchmark", "item_id")
_hits = lambda query: f"'hits=' || (SELECT n FROM ({_count_sql(query, _PASSAGES)}))"
_add(
    "command_line",
    command_line,
    f"""SELECT 0 AS nth, 0 AS code, 'indexed ' || count(*) || ' documents' AS line FROM benchmark UNION ALL SELECT 1, 0, 'documents=' || count(*) FROM benchmark
UNION ALL SELECT 2, 0, 'ok' UNION ALL SELECT 3, 0, {_hits(Or("the", "of"))} UNION ALL SELECT 4, 0, {_hits(And("the", "of"))} UNION ALL SELECT 5, 0, {_hits(Phrase("of", "the"))}
UNION ALL SELECT * FROM (VALUES (6, 2, ''), (7, 2, ''), (8, 2, ''), (9, 2, ''), (10, 2, ''), (11, 1, ''), (12, 1, '')) v""",
)


def text_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys that a search on the command line prints, line by line."""
    text = io.StringIO()
    with redirect_stdout(text):
        main(["search", stored(spark, sf_dir).path, "-k", "5", "the", "and", "la"], spark)
    lines = text.getvalue().splitlines()[1:]
    return spark.createDataFrame([(i, line.split("\t")[0]) for i, line in enumerate(lines, 1)], "rank long, key string")


_add("text_results", text_results, f"SELECT rank, key FROM ({_top_sql(_OR, 5, _DOCS)})")
_add(
    "shown_lengths",
    lambda spark, sf: stored(spark, sf).docs.select(
        "doc", display.grouped(F.col("dl").cast("long") * 997).alias("grouped"), display.shown_bytes(F.col("dl").cast("long") * 1024).alias("size"), display.score_share(F.col("dl"), F.lit(500.0)).alias("share")
    ),
    _DOCS
    + """SELECT doc, format('{:,}', CAST(dl * 997 AS BIGINT)) AS grouped,
CASE WHEN dl < 10 THEN printf('%.1f KB', CAST(dl AS DOUBLE)) WHEN dl < 1024 THEN printf('%.0f KB', CAST(dl AS DOUBLE)) WHEN dl < 10240 THEN printf('%.1f MB', dl / 1024.0::DOUBLE) ELSE printf('%.0f MB', dl / 1024.0::DOUBLE) END AS size,
greatest(0.02::DOUBLE, least(1.0::DOUBLE, dl / 500.0::DOUBLE)) AS share FROM d""",
)


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    """The flagship query: the ten best of a disjunction, from raw documents."""
    return Searcher(build_index(corpus(spark, sf_dir))).top(_OR, 10)
