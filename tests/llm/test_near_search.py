import random
import re
from collections import Counter

import numpy as np
import pytest

from lexispark.llm import ann_forest, common, minhash, search_wand

UP = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def shingles(text, width=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets), key=repr)


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(12):  # near copies of different nearness, chains among them
        base = [word() for _ in range(rng.choice((30, 80, 200)))]
        texts.append(base)
        for _ in range(rng.randint(1, 6)):
            base = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                base[rng.randrange(len(base))] = word()
            texts.append(base)
    texts += [passage + [word() for _ in range(rng.choice((20, 40, 90)))] for _ in range(40)]  # a shared passage links none
    rows = [" ".join(t) for t in texts] + [None, "", "  \n", "one", "ONE", "one two three", "One two  three\n", "a b c d", "a b c d e", "x y z w v", " ".join(["same"] * 50), "\x1fodd word", "Ä ä Ä ä Ä"]
    rows += ["copies of one text that fills a third of the rows in here"] * 60
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)] + [(3, "another text of the same id"), (3, "another text of the same id"), (None, "copies of one text that fills a third of the rows in here")]


@pytest.mark.parametrize("light", [10_000, 5])
def test_components(spark, monkeypatch, light):
    monkeypatch.setattr(common, "LIGHT", light)
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string")
    got = sorted(map(tuple, minhash.components(df).collect()), key=repr)
    assert got == brute_components(rows)
    stay = minhash.dedup(df)
    assert stay.columns == df.columns
    ids = [r.doc_id for r in stay.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({i for i, _, _, k in got if k and i is not None}) and ids.count(None) == 1


def test_rows_of_one_id_are_one_node(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(30)) for c in "xyz")
    rows = [(5, one), (5, two), (2, one), (7, two), (5, ""), (9, three), (9, None), (9, three + " more"), (8, three), (11, two.upper()), (11, three), (20, "alone"), (20, ""), (21, None), (21, None)]
    for some in (rows, rows[:3]):
        df = spark.createDataFrame(some, "doc_id long, text string")
        judged = minhash.components(df).collect()
        assert sorted(map(tuple, judged), key=repr) == brute_components(some)
        assert sorted(r.doc_id for r in minhash.dedup(df).collect()) == sorted({r.doc_id for r in judged if r.kept})


@pytest.mark.parametrize("most", [1_000_000, 3])
def test_connected(spark, monkeypatch, most):
    names = []
    monkeypatch.setattr(minhash, "cut", lambda df, name="table": names.append(name) or common.cut(df, name))
    monkeypatch.setattr(minhash, "MAX_EDGES", most)
    rng = random.Random(9)
    order = rng.sample(range(-50, 10**12, 10**9), 300)
    edges = [*zip(order[:60], order[1:60]), *((order[100], x) for x in order[101:150]), (order[200], order[201]), (order[201], order[200]), (order[250], order[250])]  # chain, star, pair, loop
    got = minhash.connected(spark.createDataFrame(edges, "a long, b long")).collect()
    expected = {v: min(part) for part in (order[:60], order[100:150], order[200:202], order[250:251]) for v in part}
    assert len(got) == len(expected) and {r.v: r.label for r in got} == expected
    assert (names == ["labels"]) == (most > 3)
    assert minhash.connected(spark.createDataFrame([], "a long, b long")).collect() == []


def test_freed_memory_is_returned():
    def held():
        return int(re.search(r"Pss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read())[1]) // 1024

    def run(batches):
        rows = [bytes(2000 + i % 50) for i in range(150_000)]
        kept.extend(rows[::1000])  # what stays lies between what goes
        yield len(rows)

    kept, before = [], held()
    assert list(common.tidy(run)(iter(()))) == [150_000]
    assert held() < before + 60  # of 300 MB


def test_other_percents(spark):
    rng = random.Random(5)
    words = lambda n: [f"{rng.random()}" for _ in range(n)]
    rows = []
    for _ in range(15):  # 3 of 4 shingles, and 40 of 80
        small, large = words(7), words(43)
        rows += [" ".join(w) for w in (small[:6], small, large + words(20), large + words(20))]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    of = lambda percent: [r.component_id for r in sorted(minhash.components(df, percent=percent).collect())]
    assert of(75) == [i - (i % 4 == 1) for i in range(60)]
    assert of(50) == [i - i % 2 for i in range(60)]
    assert minhash.shape(80) == (40, 6)
    for percent in range(3, 80):
        n, each = minhash.shape(percent)
        assert (1 - (percent / 100) ** each) ** n <= (1 - 0.8**6) ** 40 * 1.001 and n * each <= 512
    for percent in (0, 2, 101):
        with pytest.raises(ValueError):
            minhash.components(df, percent=percent)


def test_components_of_nothing(spark):
    assert minhash.components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = minhash.components(spark.createDataFrame([(1, "just one text of words")], "doc_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(1, 2, 1, True)]


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.8, 0.95):
        both = rng.integers(0, 2**63, int(1000 * share), np.uint64)
        sets = [np.unique(np.concatenate([both, rng.integers(0, 2**63, (1000 - len(both)) // 2, np.uint64)])) for _ in range(2)]
        a, b = minhash.sketches(sets)
        assert abs((a == b).mean() - share) < 0.12
    tiny = minhash.sketches([np.array([7], np.uint64), np.array([7], np.uint64), np.array([8], np.uint64)])
    assert (tiny[0] == tiny[1]).all() and not (tiny[0] == tiny[2]).any() and (tiny < np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def brute_bm25(rows, queries, k):
    docs = [(i, Counter(re.findall(r"[^\W_]+", (t or "").lower()))) for i, t in rows]
    n = sum(bool(w) for _, w in docs)
    average = sum(w.total() for _, w in docs) / max(1, n)
    df = Counter(t for _, w in docs for t in w)
    out = {}
    for q, text in queries:
        words = Counter(re.findall(r"[^\W_]+", (text or "").lower()))
        scored = []
        for i, w in docs:
            long = 1.2 * (0.25 + 0.75 * w.total() / average)
            s = sum(words[t] * np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * w[t] / (w[t] + long) for t in words.keys() & w.keys())
            if s > 0 and i is not None:
                scored.append((-s, i))
        out[q] = sorted(scored)[:k]
    return out


@pytest.mark.parametrize("shard,common", [(32_768, 1 << 18), (40, 30)])
def test_search(spark, monkeypatch, shard, common):
    monkeypatch.setattr(search_wand, "DOCS", shard)
    monkeypatch.setattr(search_wand, "COMMON", common)
    monkeypatch.setattr(search_wand, "BLOCK", 4)
    monkeypatch.setattr(search_wand, "RARE", 1)
    rng = random.Random(6)
    words = ["w%d" % i for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(60)], k=rng.choice((1, 5, 20, 80))))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "!!"), (None, "w1 w2"), (203, rows[5][1]), (204, rows[5][1]), (205, "w3 w7 " * 70_000 + " ".join(f"x{i}" for i in range(20_000)))]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double")
    queries = [(q, rows[q][1]) for q in (0, 5, 20, 40, 77)] + [(900, "w50"), (901, "none at all"), (902, None), (903, rows[5][1]), (205, rows[-1][1])]
    got = search_wand.search(docs, spark.createDataFrame(queries, "query_id long, text string"), 7).collect()
    expected = brute_bm25(rows, queries, 7)
    for q, best in expected.items():
        mine = sorted((r["rank"], r.doc_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, len(best) + 1))
        assert [m[2] for m in mine] == pytest.approx([-s for s, _ in best], rel=1e-9)
        close = {round(-s, 9) for s, _ in best}
        if len(close) == len(best):
            assert [m[1] for m in mine] == [i for _, i in best]
    assert search_wand.search(docs.limit(0), spark.createDataFrame(queries, "query_id long, text string")).count() == 0
    among = {r.query_id for r in search_wand.search_among(docs, 20, 7).collect()}
    assert among == {i for i, t in rows if i is not None and i % 20 == 0 and re.search(r"\w", t or "")}


def test_blocks_are_skipped():
    rng = random.Random(7)
    words = [[f"{c}{i}" for i in range(300)] for c in "abcd"]  # four languages, of which a query meets one
    docs, hashes = search_wand.Gathered(), search_wand.Hasher()
    for i in range(4000):
        length, top, terms, tfs = search_wand.forward(" ".join(rng.choices(words[i % 4], [1 / (j + 1) for j in range(300)], k=rng.choice((20, 60, 200)))), hashes)
        docs.add(i, length, top, b"", b"", terms.tobytes(), search_wand.narrow(tfs))
    shard = search_wand.Shard(docs, 90.0)
    queries = []
    for _ in range(50):
        _, _, terms, _ = search_wand.forward(" ".join(rng.sample(rng.choice(words), 6)), hashes)
        queries.append((terms, np.array([rng.random() for _ in terms])))
    found = shard.search(queries, 5)
    assert shard.skipped > 0.7 * (shard.skipped + shard.read) and shard.skipped + shard.read == 50 * shard.blocks
    for (terms, weights), (ids, scores) in zip(queries, found, strict=True):
        full = np.zeros(shard.n)
        for t, w in zip(terms, weights, strict=True):
            at = np.flatnonzero(shard.terms == t)
            for a in at:
                own = np.flatnonzero(shard.code == a)
                d = np.searchsorted(shard.first, own, "right") - 1
                full[d] += w * shard.tf[own] / (shard.tf[own] + shard.norm[d])
        assert scores == pytest.approx(np.sort(full)[::-1][:5]) and scores.tolist() == sorted(scores, reverse=True) and len({*ids.tolist()}) == 5


def test_results_and_queries_do_not_grow_with_shards(spark, monkeypatch):
    written = {}

    def noted(df, name="table"):
        written[name] = out = common.cut(df, name)
        return out

    monkeypatch.setattr(search_wand, "cut", noted)
    monkeypatch.setattr(search_wand, "DOCS", 5)
    monkeypatch.setattr(search_wand, "TOGETHER", 7)
    monkeypatch.setattr(search_wand, "PIECE", 500)
    rng = random.Random(3)
    words = ["w%d" % i for i in range(200)]
    rows = [(i, " ".join(rng.choices(words, k=30))) for i in range(600)]
    queries = [(i, t) for i, t in rows[:40]] + [(1000 + i, t) for i, t in rows[:10]]  # equal queries among them
    got = search_wand.search(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, text string"), 3).collect()
    for q, best in brute_bm25(rows, queries, 3).items():
        assert [r.doc_id for r in sorted(r for r in got if r.query_id == q)] == [i for _, i in best]
    tasks, _ = search_wand._division(600, 600 * 30, spark.sparkContext.defaultParallelism)
    assert written["found"].count() <= 50 * 3 * tasks < 50 * 3 * 600 / 5 and written["queries"].count() == 40
    assert search_wand._division(10**9, 10**12, 6)[0] == 24


def test_threshold_of_earlier_shards():
    rng = random.Random(4)
    hashes, docs = search_wand.Hasher(), search_wand.Gathered(4)
    text = lambda: search_wand.forward(" ".join(rng.choices([f"w{i}" for i in range(500)], [1 / (j + 1) for j in range(500)], k=rng.choice((20, 60)))), hashes)
    for i in range(2000):
        length, top, terms, tfs = text()
        docs.add(i, length, top, b"", b"", terms.tobytes(), search_wand.narrow(tfs))
        for copy in range(300 * (i == 0)):
            docs.add(9000 - copy, length, top, b"", b"", terms.tobytes(), search_wand.narrow(tfs))
    shard = search_wand.Shard(docs, 40.0)
    assert max(map(len, shard.ids)) <= 108 and [0, 8701, 8702, 8703] in [i[:4] for i in shard.ids]
    queries = [(t, np.ones(len(t))) for _, _, t, _ in (text() for _ in range(30))]
    full = shard.search(queries, 4)
    floor = np.array([s[1] for _, s in full])
    for (ids, scores), (few, high), least in zip(full, shard.search(queries, 4, floor), floor, strict=True):
        keep = scores >= least
        assert (few[: keep.sum()] == ids[keep]).all() and (high[: keep.sum()] == scores[keep]).all()
    read, shard.read = shard.read, 0
    assert read and not any(len(i) for i, _ in shard.search(queries, 4, floor * 100)) and not shard.read


@pytest.mark.parametrize("shard", [32_768, 60, 25])
def test_copies_in_several_shards(spark, monkeypatch, shard):
    monkeypatch.setattr(search_wand, "DOCS", shard)
    rng = random.Random(12)
    words = ["w%d" % i for i in range(400)]
    text = lambda n: " ".join(rng.choices(words, [1 / (j + 1) for j in range(400)], k=n))
    copied = [text(90) for _ in range(6)]
    rows = [(i, copied[i % 12] if i % 12 < 6 else text(90)) for i in range(360)]  # 30 copies of each
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    queries = spark.createDataFrame(list(enumerate(copied)), "query_id long, text string")
    got = search_wand.search(docs, queries, 10).collect()
    for q in range(6):
        mine = sorted((r["rank"], r.doc_id, r.score) for r in got if r.query_id == q)
        assert [m[:2] for m in mine] == [(j + 1, 12 * j + q) for j in range(10)] and len({m[2] for m in mine}) == 1


@pytest.mark.parametrize("shard", [16_384, 300])
def test_neighbours(spark, monkeypatch, shard):
    monkeypatch.setattr(ann_forest, "SHARD", shard)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 16)).astype(np.float32) * rng.uniform(0.5, 2, (900, 1)).astype(np.float32)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    rows[20] = (20, rows[21][1], "x")
    odd = [(1000, None, "x"), (1020, [0.0] * 16, "x"), (1040, [float("nan")] + [1.0] * 15, "x"), (1060, [None] + [1.0] * 15, "x"), (1080, [1.0, 2.0], "x"), (1100, [float("inf")] * 16, "x"), (None, [1.0] * 16, "x"), (5, rows[5][1], "x")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score string")
    got = ann_forest.search(df, 20).toPandas()
    X = np.array([r[1] for r in rows], np.float64)
    hit = total = 0
    for q in range(0, 900, 20):
        mine = got[got.query_id == q].sort_values("rank")
        s = X @ X[q]
        assert len(mine) == 20 and q not in set(mine.vec_id) and mine["rank"].tolist() == list(range(1, 21))
        assert np.allclose(mine.score, s[mine.vec_id]) and list(zip(-mine.score, mine.vec_id)) == sorted(zip(-mine.score, mine.vec_id))
        s[q] = -np.inf
        hit, total = hit + len({*mine.vec_id} & {*np.argsort(-s)[:20]}), total + 20
    assert hit / total >= 0.9 and {*got.query_id} == {*range(0, 900, 20)}


def test_lengths_and_repeated_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [2.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (20, [1.0, 0.0, 0.0]), (21, [0.5, 3.0, 0.0]), (40, [7.0]), (3, [0.0, 0.0])]
    got = ann_forest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    one, two = [(1, 0, 2.0), (2, 1, 1.0), (3, 1, 1.0)], [(1, 0, 2.0), (2, 1, 2.0), (3, 1, 2.0)]
    assert sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == 0) == sorted(one + two)
    assert [tuple(r) for r in got if r.query_id != 0] == [(20, 1, 21, 0.5)]


def test_a_tenth_is_scored():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(100, 32))
    for x in (rng.normal(size=(6000, 32)), centres[rng.integers(0, 100, 6000)] + 0.3 * rng.normal(size=(6000, 32))):
        forest = ann_forest.Forest(np.arange(6000), np.arange(6000), x, np.sqrt((x * x).sum(1).max()) * 1.001)
        found, hit = list(forest.search(np.arange(60), x[:60], 20)), 0
        for q, (ids, _) in enumerate(found):
            s = x @ x[q]
            s[q] = -np.inf
            hit += len({*ids.tolist()} & {*np.argsort(-s)[:20].tolist()})
        assert hit / 1200 >= 0.9 and forest.scored <= 0.1 * 6000 * 60


def test_few_neighbours(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in ann_forest.search(df).orderBy("rank").collect()] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, -1.0)]
    assert ann_forest.search(df.limit(0)).collect() == []
