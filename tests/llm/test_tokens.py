import base64
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from lexispark.llm import bpe, packing, token_counts

RANKS = P.path("byte_bpe_50k.tiktoken")
ODD = ["", " ", "  ", "\n", " \n ", "a\n b", "a \n b", "a  b", "it's we'll 'S", "éßñ 中文 😀😀", "<|endoftext|> x", "x" * 300, " " * 70 + "y", "\u00a0a\u2003 b", "\x1c \x85", "1234 5.6", "Σίγμα\r\n\r\n", "a\n "]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n, seed=1):
    rng = random.Random(seed)
    bits = [" ", " ", "\n", "\t", "ab", "the", "é", "12", "'s", "!", "$$$", "\r\n", "中", "😀", "\u3000", "\x1c", "<|endoftext|>"]
    return ODD + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_encoder_is_the_library(library):
    e = bpe.encoder(RANKS, P.PATTERN)
    for t in texts(1500):
        ids = e.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t), repr(t)
        assert e.decode(ids) == t.encode()


def test_perfect_hash():
    keys = [str(i).encode() for i in range(5000)]
    h = bpe.PerfectHash(keys)
    assert [h.find(k) for k in keys] == list(range(5000)) and h.find(b"none") == -1 and sorted(h.values) == list(range(5000))


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 20)
    e = bpe.Encoder(RANKS, P.PATTERN)
    t = " ".join(f"word{i}" for i in range(200))
    assert e.decode(e.encode(t)) == t.encode() and len(e) <= 20


def test_round_trip(spark, library):
    rows = [(i, t, "x") for i, t in enumerate([None, *texts(60)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in bpe.round_trip(df, RANKS, P.PATTERN).collect()}
    for i, t, _ in rows:
        ids = np.array(library.encode_ordinary(t or ""), "<u4").tobytes()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    back = bpe.decode(bpe.encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in back)
    assert bpe.round_trip(df.limit(0), RANKS, P.PATTERN).count() == 0


def brute_count(scores, word):
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for end in range(1, len(word) + 1):
        best[end] = max(((best[s][0] + scores[word[s:end]], best[s][1] - 1) for s in range(end) if word[s:end] in scores), default=(-math.inf, 0))
    return -best[-1][1]


def test_token_counts(spark):
    c = token_counts.Counter(RANKS, P.PATTERN)
    words = {f"{a}{b}".encode() for a in ("", " ", "un", "Über") for b in ("the", "thereof", "theirs", "zzqx", "éa", "$$$", "x" * 40)}
    assert {w: n for w, n, _ in c.terminals(words)} == {w: brute_count(c.scores, w) for w in words}
    rows = [(i, t) for i, t in enumerate([None, *texts(80)])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in token_counts.count_tokens(df, RANKS, P.PATTERN, together=7).collect():
        parts = c.split(r.text or "")
        assert (r.n_pretokens, r.n_tokens) == (len(parts), sum(brute_count(c.scores, p.encode()) for p in parts))
    assert token_counts.count_tokens(df.limit(0), RANKS, P.PATTERN).count() == 0


def test_packing_tokens_are_the_files_own():
    own, fast = Tokenizer.from_file(P.path("byte_bpe_50k.json")), packing.Tokens(P.path("byte_bpe_50k.json"), P.PATTERN)
    for t in texts(400, seed=2):
        assert fast(t).tolist() == own.encode(t, add_special_tokens=False).ids, repr(t)


def test_cuts():
    assert packing.cuts(1, 4) == [(0, 1)] and packing.cuts(4, 4) == [(0, 4)] and packing.cuts(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_genetic_beats_best_fit():
    rng = random.Random(4)
    size = []
    for _ in range(60):  # triplets that fill a bin exactly
        a, b = rng.randint(380, 490), rng.randint(250, 290)
        size += [a, b, 1000 - a - b]
    first = packing.decreasing(size, 1000, 0, random.Random(1))
    found, generations, least = packing.evolve(size, 1000, [], random.Random(1))
    assert packing.least_bins(size, 1000) == least == 60 <= len(found.bins) <= 62 < len(first.bins) and generations == packing.GENERATIONS
    assert sorted(i for b in found.bins for i in b) == list(range(180))
    assert all(sum(size[i] for i in b) == 1000 - left >= 0 for b, left in zip(found.bins, found.left, strict=True))
    child = packing.crossover(first, packing.decreasing(size, 1000, 0.3, rng), size, rng)
    assert sorted(i for b in child.bins for i in b) == list(range(180)) and all(left >= 0 for left in child.left)


def fewest(size, capacity):
    """The least number of bins, by trying every place for each piece, the largest first."""
    best = len(size)

    def place(i, left):
        nonlocal best
        if len(left) >= best:
            return
        if i == len(size):
            best = len(left)
            return
        for r in {*left}:
            if r >= size[i]:
                place(i + 1, [*left[: (k := left.index(r))], r - size[i], *left[k + 1 :]])
        place(i + 1, [*left, capacity - size[i]])

    size = sorted(size, reverse=True)
    place(0, [])
    return best


def test_small_cases_are_packed_best():
    rng = random.Random(8)
    for _ in range(60):
        size = [rng.randint(5, 60) for _ in range(rng.randint(1, 11))]
        found, generations, least = packing.evolve(size, 100, [], random.Random(2))
        assert generations >= 1 and least <= len(found.bins) == fewest(size, 100)
        assert sorted(i for b in found.bins for i in b) == list(range(len(size))) and all(sum(size[i] for i in b) <= 100 for b in found.bins)


def test_islands_and_report(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 100)
    rng = random.Random(3)
    lengths = [n for _ in range(80) for a, b in [(rng.randint(380, 490), rng.randint(250, 290))] for n in (a, b, 1000 - a - b)]
    items = spark.createDataFrame(list(enumerate(lengths)), "item long, length long")
    rows = packing.report(items, capacity=1000).collect()
    assert sum(r.n_items for r in rows) == 240 and all(r.least <= r.n_bins and r.generations >= 1 for r in rows)
    first = packing.decreasing(lengths, 1000, 0, rng)
    placed = packing.pack(items, 1000).toPandas()
    assert placed.sequence_id.nunique() < len(first.bins) and sorted(placed.item) == list(range(240)) and placed.groupby("sequence_id").length.sum().max() <= 1000


def test_pieces_by_brute_force(spark):
    path, own = P.path("byte_bpe_50k.json"), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(i, t, "x", 1) for i, t in enumerate([None, *texts(40, seed=4), long, "twice", "twice"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, PIECE string, Sequence_Id int")
    expected = []
    for i, t, *_ in rows:
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 0]
        head = len(ids) % 64 or 64
        for k, (a, z) in enumerate([(0, head), *((s, s + 64) for s in range(head, len(ids), 64))]):
            expected.append((i, k, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())))
    got = packing.pack_documents(df, path, P.PATTERN, capacity=64)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert sorted(tuple(r)[:5] for r in got.collect()) == sorted(expected)


def test_clashing_names_long_texts_and_repeated_rows(spark, library):
    long = " ".join(f"w{i} the" for i in range(60_000)) + "x" * 5000
    rows = [(1, long, "a", 1), (1, long, "a", 1), (2, None, "b", 2)]
    df = spark.createDataFrame(rows, "doc_id long, TEXT string, N_Tokens string, Ids_SHA256 int")
    one = bpe.round_trip(df, RANKS, P.PATTERN)
    assert one.columns == ["doc_id", "TEXT", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(r.n_tokens for r in one.collect()) == [0, *[len(library.encode_ordinary(long))] * 2]
    two = token_counts.count_tokens(df, RANKS, P.PATTERN)
    assert two.columns == ["doc_id", "TEXT", "Ids_SHA256", "n_pretokens", "n_tokens"] and len({r.n_tokens for r in two.collect() if r.doc_id == 1}) == 1


def test_pack_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 40)
    rng = random.Random(5)
    rows = [(i, " ".join(["word"] * rng.choice((0, 1, 3, 7, 15, 16, 31, 32, 33, 100)))) for i in range(120)] + [(200, None), (None, "no id"), (7, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = P.path("byte_bpe_50k.json")
    got = packing.pack_documents(df, path, P.PATTERN, capacity=32).toPandas()
    tokens = sum(len(packing.Tokens(path, P.PATTERN)(t)) + 1 for _, t in rows)
    assert got.length.sum() == tokens and got.length.max() <= 32
    bins = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert all((b.offset == b.length.cumsum() - b.length).all() and b.length.sum() <= 32 for _, b in bins)
    assert bins.ngroups <= math.ceil(tokens / 32) + 4
    assert set(got[got.piece > 0].length) == {32}
    whole = packing.sequences(df, path, P.PATTERN, capacity=32).collect()
    assert sum(len(r.ids) for r in whole) == tokens
    assert packing.pack_documents(df.limit(0), path, P.PATTERN).count() == 0
