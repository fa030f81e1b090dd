"""Token counts of a unigram tokenizer, without encoding.

The distinct pre-tokens of a batch are put in a trie, as a sorted list in which neighbours share prefixes.  The forward
score of a prefix (the best sum of piece scores over its segmentations) and the pieces that takes are computed once for
all pre-tokens that begin with it; a pre-token's count is what its terminal node holds.  A document's count is the
sum over its pre-tokens.

Pieces and their order come from a public rank file; a piece's score is its log probability under Zipf's law of its
rank.  Of segmentations with equal scores the one of fewer pieces counts.

Defined cases: null text is empty and has no tokens; equal rows get equal counts; an empty table gives an empty one;
other columns are carried, those named like a result are replaced.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import others

#: Chunks and pre-tokens whose counts a worker remembers.
MEMO = 600_000
_RAGGED = regex.compile(r"\s (?:\s|\Z)")
_BLANK_PAIRS = [" " + c for c in map(chr, range(0x3001)) if c != " " and regex.match(r"\s", c)]
_SHIFT = 32


def zipf(rank: int, n: int) -> float:
    """Log probability of the piece of a rank among ``n``."""
    return -math.log((rank + 1) * (math.log(n) + 0.5772156649015329))


class Counter:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        self.scores = {t: zipf(r, len(ranks)) for t, r in ranks.items()}
        self.pattern = pattern
        self._ready()

    def _ready(self) -> None:
        self.suffixes = {t[i:] for t in self.scores for i in range(len(t))}
        self.split = regex.compile(self.pattern).findall
        self.chunks: dict[str, int] = {}
        self.pretokens: dict[str, int] = {}

    def __reduce__(self):
        return _counter, (self.scores, self.pattern)

    def terminals(self, pretokens: Iterable[bytes]) -> Iterator[tuple[bytes, int, float]]:
        """(pre-token, pieces, score) of distinct pre-tokens, in trie order."""
        scores, suffixes = self.scores, self.suffixes
        best, pieces, before = [0.0], [0], b""
        for word in sorted(pretokens):
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del best[shared + 1 :], pieces[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                top, fewest = -math.inf, 0
                for start in range(end - 1, -1, -1):
                    piece = word[start:end]
                    if piece not in suffixes:
                        break
                    if (s := scores.get(piece)) is not None:
                        s += best[start]
                        if s > top or (s == top and pieces[start] < fewest):
                            top, fewest = s, pieces[start]
                best.append(top)
                pieces.append(fewest + 1)
            before = word
            yield word, pieces[-1], best[-1]

    def learn(self, chunks: set[str]) -> None:
        """Fills the memo for chunks, each a blank and what follows it up to the next."""
        parts = {c: self.split(" " + c) for c in chunks}
        fresh = {p for ps in parts.values() for p in ps} - self.pretokens.keys()
        for word, n, _ in self.terminals(p.encode("utf-8", "surrogatepass") for p in fresh):
            self.pretokens[word.decode("utf-8", "surrogatepass")] = n
        known = self.pretokens
        for c, ps in parts.items():
            self.chunks[c] = (sum(known[p] for p in ps) << _SHIFT) + len(ps)

    def count(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text."""
        if len(self.chunks) + len(self.pretokens) > MEMO:
            self.chunks, self.pretokens = {}, {}
        divided: list[tuple[list[str], list[str]]] = []  # pre-tokens counted as such, chunks
        for text in texts:
            if not text:
                divided.append(([], []))
                continue
            first, *rest = text.split(" ")
            if ("" in rest or any(p in text for p in _BLANK_PAIRS)) and _RAGGED.search(text):
                divided.append((self.split(text), []))
            else:
                divided.append((self.split(first), rest))
        self.learn({c for _, rest in divided for c in rest} - self.chunks.keys())
        fresh = {p for ps, _ in divided for p in ps} - self.pretokens.keys()
        for word, n, _ in self.terminals(p.encode("utf-8", "surrogatepass") for p in fresh):
            self.pretokens[word.decode("utf-8", "surrogatepass")] = n
        out = []
        for ps, rest in divided:
            both = sum(map(self.chunks.__getitem__, rest))
            out.append((len(ps) + (both & ((1 << _SHIFT) - 1)), sum(map(self.pretokens.__getitem__, ps)) + (both >> _SHIFT)))
        return out


def _counter(scores: dict[bytes, float], pattern: str) -> Counter:
    out = Counter.__new__(Counter)
    out.scores, out.pattern = scores, pattern
    out._ready()
    return out


def count_tokens(docs: DataFrame, path: str, pattern: str, together: int = 1000) -> DataFrame:
    """``docs`` with n_pretokens and n_tokens; texts go through the trie ``together`` at a time."""
    names = ["n_pretokens", "n_tokens"]
    kept, at = others(docs, names), [c.lower() for c in docs.columns].index("text")
    shared = docs.sparkSession.sparkContext.broadcast(Counter(path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, together):
                batch = whole.slice(first, together)
                counts = shared.value.count(batch.column(at).to_pylist())
                arrays = [pa.array([c[i] for c in counts], pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *arrays], kept + names)

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + [f"{n} bigint" for n in names])
    return docs.mapInArrow(run, schema)
