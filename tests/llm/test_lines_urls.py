import hashlib

from pyspark.sql import functions as F

from lexispark.llm import line_dedup, url_filter

WS = " \t\n\x0b\x0c\r"
UP = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
LONG = "this is a line that is certainly longer than forty characters"


def brute_lines(rows, least=40, docs=5):
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            key = line.strip(WS).translate(UP)
            if len(key) >= least:
                held.setdefault(key, set()).add(-1 if i is None else i)
    keep = {k: max(v) for k, v in held.items() if len(v) >= docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if keep.get(x.strip(WS).translate(UP), -1 if i is None else i) == (-1 if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def run_lines(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_dropped string")
    got = line_dedup.dedup(df).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("h"))
    return sorted(map(tuple, got.collect()), key=repr)


def test_lines(spark):
    rows = [(i, f"own {i}\n {LONG.upper() if i % 2 else LONG} \t\n{LONG}\nend") for i in range(8)]
    rows += [(20, None), (21, ""), (22, "\n\n"), (23, LONG[:40]), (24, "É" * 40), (25, "é" * 40), (None, f"{LONG}\nnull id"), (30, "\r\n".join([LONG + " crlf"] * 3))]
    rows += [(40 + i, f"{LONG}x\n" * 200 + f"tail {i}") for i in range(5)]  # a line that fills most of the corpus
    rows += [(60, f"{LONG}\nrepeated row"), (60, f"{LONG}\nrepeated row")]
    assert run_lines(spark, rows) == brute_lines(rows)


def test_all_lines_of_a_document_go(spark):
    rows = [(i, LONG) for i in range(6)]
    assert run_lines(spark, rows) == brute_lines(rows)
    assert run_lines(spark, []) == []


def test_bitmap_runs(spark):
    rows = [(i, f"a\n{LONG}\nb\nc\n{LONG}") for i in range(5)]
    got = {r.doc_id: ([tuple(x) for x in r.keep_runs], r.n_dropped) for r in line_dedup.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: ([(0, 1), (2, 2), (5, None)], 2) for i in range(4)}


def test_first_occurrences_stream_over_the_ranges(spark, monkeypatch):
    plans, cut = [], line_dedup.cut
    monkeypatch.setattr(line_dedup, "cut", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df, name))[1])
    line_dedup.keep_bitmaps(spark.createDataFrame([(i, LONG) for i in range(6)], "doc_id long, text string"))
    window = [p for p in plans if "Window" in p]
    assert len(window) == 1 and window[0].count("Exchange") == 1 and "Exchange rangepartitioning" in window[0] and window[0].count("Sort [") == 1


def judged(spark, urls, rules=None):
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    return [tuple(r) for r in url_filter.judge(df, rules).orderBy("page_id").select("host", "path", "rule", "verdict").collect()]


def brute_urls(urls, rules):
    out = []
    for u in urls:
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, after = rest[:n].translate(UP), rest[n:]
            m = min([after.find(c) for c in "?#" if c in after] or [len(after)])
            path = after[:m]
        fits = [(len(h + p), len(h), a, h + p) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        out.append((host, path, best and best[3], best[2] if best else "allow"))
    return out


URLS = [None, "", "no scheme", "http://", "http://Example.ORG", "http://example.org/", "https://a.EXAMPLE.org/es/x?q#f", "http://example.org/en/12", "http://notexample.org/es/", "http://x.com/fr/1", "http://x.com/de/", "http://com/de/a", "http://x.com?/de/", "ftp://b.org#/x", "http://a://b.org/es/", "http://x.com/DE/", "http://" + "a." * 3000 + "com/de/" + "z" * 5000]


def test_urls(spark):
    assert judged(spark, URLS * 2) == brute_urls(URLS * 2, url_filter.RULES)
    assert judged(spark, []) == []
    assert all(v[2:] == (None, "allow") for v in judged(spark, URLS, []))


def test_many_rules(spark):
    rules = [("block" if i % 3 else "allow", f"h{i}.net", f"/{i % 7}") for i in range(400)]
    urls = [f"http://{s}h{i}.net/{(i * j) % 7}x" for i in range(0, 500, 3) for j in (1, 2) for s in ("", "www.")]
    assert judged(spark, urls, rules) == brute_urls(urls, rules)
