"""Searches against a plain float simulation, on fixed and random corpora."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.operators import Searcher, build_index, many, search, tables
from lexispark.operators.search import NoPositionsError
from lexispark.plans import And, Or, Phrase, Term
from lexispark.sources import open_index, save_index
from lexispark.sources.store import verify

f = np.float32


def index_of(spark, docs, positions=True):
    return build_index(spark.createDataFrame([(i, k, t.split() if isinstance(t, str) else t) for i, (k, t) in enumerate(docs)], "doc long, key string, tokens array<string>"), positions)


def quantized(n):
    b = (n - 24).bit_length() - 4
    return n if n < 40 else 24 + ((n - 24) >> b << b)


class Plain:
    def __init__(self, docs):
        self.docs = [t.split() if isinstance(t, str) else t for _, t in docs]
        self.n = len(docs)
        self.average = f(sum(map(len, self.docs)) / self.n)

    def idf(self, t):
        df = sum(t in d for d in self.docs)
        return f(np.log(1 + (self.n - df + 0.5) / (df + 0.5)))

    def part(self, w, tf, d):
        ni = f(1) / (f(1.2) * (f(0.25) + f(0.75) * f(quantized(len(d))) / self.average))
        return f(w - w / (f(1) + f(tf) * ni))

    def search(self, query):
        out = {}
        for i, d in enumerate(self.docs):
            if isinstance(query, Phrase):
                tf = sum(d[p : p + len(query.terms)] == list(query.terms) for p in range(len(d)))
                if tf:
                    out[i] = float(self.part(f(sum(self.idf(t) for t in query.terms)), tf, d))
            else:
                have = [t for t in query.terms if t in d]
                if have and (not isinstance(query, And) or len(have) == len(query.terms)):
                    out[i] = float(f(sum(float(self.part(self.idf(t), d.count(t), d)) for t in have)))
        return out


def check(searcher, plain, query, k):
    expected = plain.search(query)
    found = searcher.search(query, k)
    hits = found.hits.collect()
    assert found.exact and found.total == len(expected) == searcher.count(query)
    assert len(hits) == min(k, len(expected))
    for r in hits:
        assert r.score == pytest.approx(expected[r.doc], rel=1e-6)
    assert [r["rank"] for r in hits] == list(range(1, len(hits) + 1))
    assert [(r.score, -r.doc) for r in hits] == sorted(((r.score, -r.doc) for r in hits), reverse=True)
    if expected and hits:
        assert hits[-1].score >= sorted(expected.values(), reverse=True)[len(hits) - 1] * (1 - 1e-6)


PHRASES = [("a", "the quick brown fox"), ("b", "brown the quick fox"), ("c", "quick brown quick brown")]


def test_phrases(spark):
    s, p = Searcher(index_of(spark, PHRASES)), Plain(PHRASES)
    for q in (Phrase("quick", "brown"), Phrase("brown", "quick"), Phrase("the", "quick", "brown"), Phrase("quick", "absent"), Phrase("fox"), And("quick", "brown"), And("quick", "quick"), Or("fox", "fox", "nope"), Term("nope")):
        check(s, p, q, 10)
    assert [r.key for r in s.top(Phrase("quick", "brown"), 5).collect()] == ["c", "a"]


def test_ties_and_lookups(spark):
    docs = [(f"d{i}", ["common", f"d{i}"]) for i in range(60)]
    s = Searcher(index_of(spark, docs, positions=False))
    assert [r.doc for r in s.top(Term("common"), 7).collect()] == list(range(7))
    assert s.count(Term("common")) == 60 and s.doc_frequency("d3") == 1 and s.doc_frequency("zz") == 0 and s.doc_key(5) == "d5"
    with pytest.raises(IndexError):
        s.doc_key(99)
    with pytest.raises(NoPositionsError):
        s.top(Phrase("common"), 1)
    for bad in (0, -1):
        with pytest.raises(ValueError):
            s.top(Term("common"), bad)
    stats = s.statistics().first()
    assert (stats.n_docs, stats.n_terms, stats.total_tokens, stats.has_positions) == (60, 61, 120, False)


def test_query_validation():
    for make in (lambda: Term(""), lambda: And(), lambda: Or("a", ""), lambda: Phrase(), lambda: And("a", Or("b")), lambda: Or(None), lambda: Phrase("a", Phrase("b"))):
        with pytest.raises(ValueError):
            make()
    assert And(Term("a"), "b").terms == ("a", "b")


def test_random_corpus(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(25)]
    weights = [1 / (i + 1) for i in range(25)]
    docs = [(f"d{i}", rng.choices(words, weights, k=rng.choice([1, 3, 9, 40, 70, 130]))) for i in range(120)]
    index = index_of(spark, docs)
    index = type(index)(**{n: getattr(index, n).cache() for n in ("docs", "postings", "terms", "stats")}, has_positions=True)
    s, p = Searcher(index), Plain(docs)
    for _ in range(12):
        kind = rng.choice((Term, And, Or, Phrase))
        q = Term(rng.choice([*words, "no"])) if kind is Term else kind(*rng.choices([*words[:12], "no"] if kind is Or else words[:12], k=rng.randint(2, 3)))
        check(s, p, q, rng.randint(1, 20))
    q = Or("w20", "w0", "w1")
    assert s.top_pruned(q, 2).collect() == s.top(q, 2).collect()
    batch = s.batch(spark.createDataFrame([(1, "w3 w9 w9"), (2, "w0")], "qid int, text string"), 5).collect()
    one = [(r["rank"], r.doc) for r in s.top(Or("w3", "w9", "w9"), 5).collect()]
    assert sorted((r["rank"], r.doc) for r in batch if r.qid == 1) == one


def test_empty_corpus(spark, tmp_path):
    index = build_index(spark.createDataFrame([(0, "a", "!!"), (1, "b", None)], "doc long, key string, text string"), positions=True)
    s = Searcher(index)
    assert s.top(Term("a"), 3).collect() == [] and s.count(Or("a", "b")) == 0 and s.search(Or("a", "b"), 2).total == 0
    save_index(index, str(tmp_path / "ix"))
    verify(spark, str(tmp_path / "ix"))
    assert Searcher(open_index(spark, str(tmp_path / "ix"))).statistics().first().n_docs == 0


def test_refused_documents(spark):
    for tokens in ([], None, ["a", ""], ["a", None]):
        with pytest.raises(Exception, match="a document has"):
            Searcher(index_of(spark, [("a", ["x"]), ("b", tokens)])).count(Or("x", "y"))
    for key in ("", None):
        with pytest.raises(Exception, match="has no key"):
            index_of(spark, [(key, ["x"])]).docs.collect()


def test_pruned_disjunctions(spark, monkeypatch):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(40)]
    docs = [(f"d{i}", rng.choices(words, [1 / (i + 1) ** 2 for i in range(40)], k=rng.choice([2, 9, 40]))) for i in range(300)]
    s = Searcher(index_of(spark, docs))
    queries = [Or("w9", "w0", "w1"), Or("w20", "w0"), Or("w5", "w5", "w0"), Or("w30", "nope", "w2", "w0"), Or("w0", "w1")]
    full = [s.top(q, 2).collect() for q in queries]
    monkeypatch.setattr(search, "PRUNE_FROM", 0)
    assert [s.top(q, 2).collect() for q in queries] == full


def test_heavy_terms_are_salted(spark, monkeypatch):
    monkeypatch.setattr(search, "LIGHT", 50)
    docs = [(f"d{i}", ["the"] * (1 + i % 3) + [f"w{i % 7}"]) for i in range(90)]
    s = Searcher(index_of(spark, docs, positions=False))
    queries = spark.createDataFrame([(1, "the w3"), (2, "w5"), (3, "the the"), (4, "")], "qid int, text string")
    got = s.batch(queries, 6).collect()
    for q, query in ((1, Or("the", "w3")), (2, Or("w5")), (3, Or("the", "the"))):
        assert sorted((r["rank"], r.doc, r.score) for r in got if r.qid == q) == [(r["rank"], r.doc, r.score) for r in s.top(query, 6).collect()]
    assert {r.qid for r in got} == {1, 2, 3}


def test_frontier_numbers_postings(spark, monkeypatch):
    monkeypatch.setattr(tables, "RANGES", 5)
    docs = [(f"d{i}", ["the"] * (1 + i * 7 % 5) + ["rare"] * (i % 40 == 3)) for i in range(200)]
    postings = index_of(spark, docs, positions=False).postings.cache()
    got = sorted((r.term, r.nth, r.doc) for r in tables.numbered(postings).collect())
    assert [g for g in got if g[0] == "the"] == [("the", i, i) for i in range(200)]
    assert [g for g in got if g[0] == "rare"] == [("rare", i, 40 * i + 3) for i in range(5)]


def test_phrases_make_no_row_of_an_occurrence(spark):
    docs = [(f"d{i}", ["the"] * (1 + i % 5) + ["of", "the"] * (i % 3)) for i in range(60)]
    s, p = Searcher(index_of(spark, docs)), Plain(docs)
    for q in (Phrase("the", "the"), Phrase("the", "the", "the"), Phrase("the", "of", "the"), Phrase("of", "the")):
        check(s, p, q, 8)
        plan = s.matches(q)._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and ("Exchange" in plan.replace("BroadcastExchange", "")) == (len({*q.terms}) > 1)


def test_frontier_cuts_frequent_terms_only(spark, monkeypatch):
    monkeypatch.setattr(tables, "FREQUENT", 50)
    docs = [(f"d{i}", ["the"] * (1 + i * 7 % 5) + ["rare"] * (i % 40 == 3) + ["x"] * (i % 2)) for i in range(200)]
    postings = index_of(spark, docs, positions=False).postings.cache()
    for ranges in (5, 256):
        monkeypatch.setattr(tables, "RANGES", ranges)
        got = sorted((r.term, r.nth, r.doc) for r in tables.numbered(postings).collect())
        assert got == sorted([("the", i, i) for i in range(200)] + [("rare", i, 40 * i + 3) for i in range(5)] + [("x", i, 2 * i + 1) for i in range(100)])


def test_ranges_of_bounds(spark):
    for bounds in ([], [5], [1, 2], [0, 7, 8, 20], list(range(0, 300, 3)), list(range(-50, 206))):
        rows = spark.range(-60, 320).select("id", tables._range_of(F.col("id"), bounds).alias("r")).collect()
        assert all(r.r == sum(b < r.id for b in bounds) for r in rows)


def test_batches_in_packs(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    docs = [(f"d{i}", rng.choices(words, [1 / (i + 1) for i in range(30)], k=rng.choice([1, 5, 30]))) for i in range(150)]
    docs += docs[:40]  # equal documents are ties
    index = index_of(spark, docs, positions=False)
    s = Searcher(type(index)(**{n: getattr(index, n).cache() for n in ("docs", "postings", "terms", "stats")}))
    asked = [(q, " ".join(rng.choices([*words, "no"], k=rng.randint(1, 3)))) for q in range(6)] + [(99, "no")]
    expected = {(q, m): [(r["rank"], r.doc, r.score) for r in s.ranked(s.matches(kind(*t.split())), 7).collect()] for q, t in asked for m, kind in (("or", Or), ("and", And))}
    queries = spark.createDataFrame(asked, "qid int, text string")
    monkeypatch.setattr(many, "TOGETHER", 2)
    for cells, postings in ((1 << 22, 1 << 18), (40, 50)):
        monkeypatch.setattr(many, "CELLS", cells)
        monkeypatch.setattr(many, "POSTINGS", postings)
        for mode in ("or", "and"):
            got = s.batch(queries, 7, mode)
            assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()  # no row is made for a query and a posting
            rows = got.collect()
            for q, _ in asked:
                assert sorted((r["rank"], r.doc, r.score) for r in rows if r.qid == q) == expected[q, mode]


def test_heavy_terms_of_large_batches_are_salted(spark, monkeypatch):
    monkeypatch.setattr(search, "MAX_TERMS", 0)
    test_heavy_terms_are_salted(spark, monkeypatch)
