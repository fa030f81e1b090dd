"""Stored indexes, damaged ones, text sources, command line and requests."""

import json
from pathlib import Path

import pytest

from lexispark.app import Service, main, serve
from lexispark.operators import Searcher, build_index, tables
from lexispark.plans import Or, Term
from lexispark.sources import IndexFormatError, generated_corpus, generated_word, number_rows, open_index, query_file, save_index, tsv_corpus
from lexispark.sources.store import verify

TSV = "alpha-doc\tThe quick brown fox jumps over the lazy dog\n\nbeta-doc\ta quick brown dog outpaces a\tquick fox\n   !!!\ngamma-doc\tlorem ipsum dolor sit amet\nno tab here\n"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("store")
    (folder / "c.tsv").write_text(TSV, encoding="utf-8")
    assert main(["index", str(folder / "c.tsv"), str(folder / "ix"), "--positions"], spark) == 0
    return folder


def test_tsv(spark, stored):
    rows = [(r.doc, r.key, r.text) for r in tsv_corpus(spark, str(stored / "c.tsv")).orderBy("doc").collect()]
    assert [r[:2] for r in rows] == [(0, "alpha-doc"), (1, "beta-doc"), (2, "gamma-doc"), (3, "3")]
    assert rows[1][2] == "a quick brown dog outpaces a\tquick fox" and rows[3][2] == "no tab here"
    assert [r.qid for r in query_file(spark, str(stored / "c.tsv"), 2).collect()] == ["alpha-doc", "beta-doc"]


def test_round_trip(spark, stored):
    index = open_index(spark, str(stored / "ix"))
    again = Searcher(index).top(Or("quick", "fox", "here"), 5).collect()
    fresh = Searcher(build_index(tsv_corpus(spark, str(stored / "c.tsv")), True)).top(Or("quick", "fox", "here"), 5).collect()
    assert again == fresh and again[0].key in ("beta-doc", "3")
    verify(spark, str(stored / "ix"))
    with pytest.raises(FileExistsError):
        save_index(index, str(stored / "ix"))
    with pytest.raises(FileNotFoundError):
        open_index(spark, str(stored / "nothing"))


def test_postings_are_shuffled_packed(spark, tmp_path, monkeypatch):
    for name, value in {"TOGETHER": 300, "CHUNK": 40, "SAMPLED": 5, "STRIDE": 3, "RANGE": 90, "SMALL": 20}.items():
        monkeypatch.setattr(tables, name, value)
    docs = generated_corpus(spark, 200, 60, 1, 30, seed=3).cache()
    placed = tables.placed(tables.forward(docs, True), True, 3000)
    assert "rangepartitioning" not in placed._jdf.queryExecution().executedPlan().toString()  # no second run to sample the rows
    save_index(build_index(docs, True), str(tmp_path / "ix"))
    verify(spark, str(tmp_path / "ix"))
    expected = sorted((t, r.doc, tuple(p for p, x in enumerate(r.tokens) if x == t)) for r in docs.collect() for t in {*r.tokens})
    postings = open_index(spark, str(tmp_path / "ix")).postings
    assert sorted((r.term, r.doc, tuple(r.positions)) for r in postings.collect()) == expected
    assert all(r.tf == len(r.positions) for r in postings.collect())
    files = [[(r.term, r.doc) for r in spark.read.parquet(str(f)).collect()] for f in (tmp_path / "ix" / "postings").glob("*.parquet")]
    held = sorted(f for f in files if f)
    assert len(held) > 4 and sum(held, []) == [e[:2] for e in expected]  # sorted in each file, and file by file


def test_damage(spark, stored, tmp_path):
    import shutil

    for damage in ("format", "version", "table", "rows"):
        path = tmp_path / damage
        shutil.copytree(stored / "ix", path)
        part = next((path / "manifest").glob("part*"))
        for crc in path.rglob(".*.crc"):
            crc.unlink()
        manifest = json.loads(part.read_text())
        if damage == "format":
            part.write_text(json.dumps(manifest | {"format": "other"}))
        elif damage == "version":
            part.write_text(json.dumps(manifest | {"version": 8}))
        elif damage == "table":
            shutil.rmtree(path / "postings")
        else:
            manifest["tables"]["docs"]["checksum"] += 1
            part.write_text(json.dumps(manifest))
        with pytest.raises(IndexFormatError):
            (verify if damage == "rows" else open_index)(spark, str(path))
    open_index(spark, str(tmp_path / "rows"))  # rows are only read by verify


def test_command_line(spark, stored, capsys):
    ix = str(stored / "ix")
    assert main(["search", ix, "-k", "1", "--phrase", "quick", "brown"], spark) == 0
    assert capsys.readouterr().out.splitlines()[0] == "hits=2"
    assert main(["search", ix, "--and", "quick", "lorem"], spark) == 0
    assert capsys.readouterr().out == "hits=0\n"
    assert main(["verify", ix], spark) == 0 and main(["stats", ix], spark) == 0
    for bad in ([], ["search", ix], ["search", ix, "-k"], ["search", ix, "-k", "x", "a"], ["search", ix, "--and", "--phrase", "a"], ["search", ix, "!!!"], ["index", "a", "b", "--what"], ["search", ix, "-k", "0", "a"]):
        assert main(bad, spark) == 2
    assert main(["stats", str(stored / "nowhere")], spark) == 1


def test_requests(spark, stored):
    service = Service(spark, str(stored / "ix"), max_k=50)
    status, body = service.search("Quick", 10)
    assert status == 200 and body["totalHits"] == 2 and body["hits"][0]["id"] == "beta-doc" and body["totalHitsExact"]
    assert service.search("quick lorem", 10, "AND")[1]["totalHits"] == 0
    assert service.search("brown-quick", 10, "phrase")[1]["totalHits"] == 0
    assert [service.search(*a)[0] for a in (("a", 0), ("a", 51), ("a", 5, "xor"), ("  !!! ", 5))] == [400] * 4
    assert service.stats()[1]["documents"] == 4 and service.health()[0] == 200
    missing = Service(spark, str(Path(stored) / "gone"))
    assert missing.search("a", 0)[0] == 503 and "gone" in missing.stats()[1]["error"]


def test_generated(spark):
    assert len({generated_word(r) for r in range(2000)}) == 2000 and generated_word(0) == "a" and generated_word(26) == "aa"
    docs = generated_corpus(spark, 60, 20, 3, 9, seed=1)
    assert docs.collect() == generated_corpus(spark, 60, 20, 3, 9, seed=1).collect()
    rows = docs.collect()
    assert all(3 <= len(r.tokens) <= 9 for r in rows)
    flat = [t for r in rows for t in r.tokens]
    assert flat.count("a") > flat.count("k")
    assert Searcher(build_index(docs)).count(Term("a")) == sum("a" in r.tokens for r in rows)


def test_number_rows(spark):
    lines = spark.range(0, 1000, 1, 7).withColumnRenamed("id", "n")
    for df in (lines, lines.where("n % 3 = 0 or n > 600"), lines.repartitionByRange(5, "n"), lines.limit(0)):
        got = number_rows(df, "nth").orderBy("n").collect()
        assert [r.nth for r in got] == list(range(len(got)))
    plan = number_rows(lines, "nth")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window") == 1 and "hashpartitioning(n" not in plan


def test_http(spark, stored):
    from threading import Thread
    from urllib.error import HTTPError
    from urllib.request import urlopen

    server = serve(Service(spark, str(stored / "ix"), max_k=50), 0)
    Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    body = json.loads(urlopen(f"{at}/search?q=quick+brown&k=1&op=PHRASE").read())
    assert body["operator"] == "phrase" and body["returned"] == 1 and body["totalHits"] == 2
    assert json.loads(urlopen(f"{at}/stats").read())["documents"] == 4 and urlopen(f"{at}/health").status == 200
    for path, status in (("/search?q=a&k=0", 400), ("/search?q=a&k=x", 400), ("/search", 400), ("/other", 404)):
        with pytest.raises(HTTPError) as refused:
            urlopen(at + path)
        assert refused.value.code == status
    server.shutdown()
