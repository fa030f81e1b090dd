"""Quality classifier: random Fourier features of document statistics, ridge by normal equations, isotonic scores.

Statistics of whole texts (no label, language, source or id is among them) are standardised by the labelled rows'
means and spreads, also got from sums over partitions, and sent through ``FEATURES`` cosine features whose inner
products approximate a Gaussian kernel.  Partitions of labelled rows add up their normal equations; the driver solves
them for each of two folds and for both.  The scores that each fold's rows get from the other fold's weights,
counted in ``BINS`` bins, are made monotone by pooling adjacent violators, which gives the calibration.

Defined cases: null text is empty, and scored like any; texts that are equal get equal scores; a label row without a
document or with a null label isn't learned from, repeated ones count repeatedly; without labels every score is 0.5,
with labels of one class it is that class's; a null id is never held out; an empty table gives an empty one; other
columns are carried, those named like a result are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back, others, tidy

FEATURES, RIDGE, BINS, SEED = 384, 1e-3, 2000, 7
#: Most labelled rows that are learned from; beyond, a sample of them by hash of the id.
MAX_LABELLED = 200_000
#: Most partitions whose normal equations are sent to the driver, each of FEATURES squared numbers.
MAX_PARTS = 16

_COMMON = frozenset(
    "the of and to in is that it was for on as with be by at from this are or have not but they which you he she his her an a "
    "der die das und in zu den mit von für auf ist im nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "le la les de des du et un une en que qui dans pour pas au sur est par plus avec ne se ce il elle "
    "el los las del y en un una que por con para es lo se su al como más no si".split()
)
_UPPER, _LOWER = np.arange(65, 91), np.arange(97, 123)
_DIGITS, _STOPS = np.arange(48, 58), np.frombuffer(b".,;:?!", np.uint8)
_QUOTES = np.frombuffer(b"'\"()-", np.uint8)
_ODD = np.array([b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:?!'\"()-"])
NAMES = (
    "log_chars log_words word_length long_words short_words distinct common top upper capital digits stops exclaim odd odd_words "
    "blank lines line_length line_repeats short_lines wide entropy bigram_repeats letters capital_words letterless vowels quotes"
).split()


def statistics(text: str | None) -> list[float]:
    text = text or ""
    words, lines = text.split(), text.split("\n")
    count = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    chars, n, m = max(1, len(text)), max(1, len(words)), len(lines)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    tally: dict[str, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    p = count[count > 0] / max(1, count.sum())
    letters = max(1, count[_UPPER].sum() + count[_LOWER].sum())
    ends = [w[-1] for w in words]
    pairs = len({*zip(words, words[1:])}) if len(words) > 1 else 1  # noqa: B905
    lower = {w: c for w, c in tally.items() if w in _COMMON}
    return [
        math.log1p(len(text)), math.log1p(len(words)), lengths.mean(), (lengths > 14).mean(), (lengths < 3).mean(),
        len(tally) / n, sum(lower.values()) / n, max(tally.values(), default=0) / n, count[_UPPER].sum() / letters,
        sum(map(str.istitle, words)) / n, count[_DIGITS].sum() / chars, count[_STOPS].sum() / n, count[33] / n, count[_ODD].sum() / chars,
        sum(c in "$%&*#@^~|<>{}[]=+_/\\" for c in ends) / n, (count[32] + count[9]) / chars, math.log1p(m), math.log1p(chars / m),
        1 - len({*lines}) / m, sum(len(x) < 20 for x in lines) / m, count[128:].sum() / chars, float(-(p * np.log2(p)).sum()),
        1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0, letters / chars, sum(map(str.isupper, words)) / n,
        sum(not any(map(str.isalpha, w)) for w in words) / n, count[[65, 69, 73, 79, 85, 97, 101, 105, 111, 117]].sum() / letters, count[_QUOTES].sum() / n,
    ]


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.spread)

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.features(x) @ self.weights if len(self.weights) else np.zeros(len(x))
        return np.interp(raw, self.knots, self.values)


def fourier(z: np.ndarray) -> np.ndarray:
    """FEATURES cosine features, and a constant one, of a Gaussian kernel as wide as the root of the statistics."""
    rng = np.random.default_rng(SEED)
    w = rng.normal(size=(len(NAMES), FEATURES)) / math.sqrt(len(NAMES))
    out = math.sqrt(2 / FEATURES) * np.cos(np.clip(z, -6, 6) @ w + rng.uniform(0, 2 * math.pi, FEATURES))
    return np.hstack([out, np.ones((len(z), 1))])


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing function nearest to ``y`` at ascending ``x``, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for a, b, w in zip(x, y, weight, strict=True):
        blocks.append([a * w, b * w, w])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    found = np.array(blocks)
    return found[:, 0] / found[:, 2], found[:, 1] / found[:, 2]


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(batch.column("stats").flatten(), np.float64).reshape(batch.num_rows, len(NAMES))


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., stats array<double>)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = pa.array([statistics(t.as_py()) for t in batch.column(len(keep))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(keep))), stats], [*keep, "stats"])

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep) + "stats array<double>"
    return docs.select(*keep, "text").mapInArrow(tidy(run), schema)


def _sums(rows: DataFrame, columns: list[str], f) -> dict[str, np.ndarray]:
    """Adds up the named arrays that ``f(stats, labels, folds, times)`` gives for the batches of each of few partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = f(_matrix(batch), *(np.array(batch.column(c)) for c in ("label", "fold", "times")))
                total = part if total is None else [a + b for a, b in zip(total, part, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(a, np.float64).tobytes()]) for a in total], columns)

    parts = rows.mapInArrow(tidy(run), ", ".join(f"{c} binary" for c in columns)).toArrow()
    return {c: sum(np.frombuffer(x) for x in parts[c].to_pylist()) if len(parts) else np.zeros(0) for c in columns}


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from ``labels`` (doc_id, label 0 or 1) of rows of ``docs`` (doc_id, text) whose remainder isn't 1.

    The labels learned from, at most about MAX_LABELLED, are broadcast to the documents; only of the texts that have
    one are statistics computed, and these few rows are spread over MAX_PARTS partitions.
    """
    wanted = labels.select("doc_id", "label").where(F.col("label").isin(0, 1) & (remainder(F.col("doc_id")) != 1)).groupBy("doc_id", "label").agg(F.count("*").cast("double").alias("times"))
    wanted = cut(wanted, "labels")
    n = wanted.count()
    if n > MAX_LABELLED:
        wanted = wanted.where(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)) < math.floor(MAX_LABELLED / n * (1 << 30)))
    found = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")
    found = found.select(F.col("label").cast("double").alias("label"), remainder(F.col("doc_id")).cast("double").alias("fold"), "times", "text")
    rows = cut(with_statistics(found, ["label", "fold", "times"]).repartition(MAX_PARTS), "labelled")
    s = _sums(rows, ["n", "sum", "square"], lambda x, y, _, w: [np.array([w.sum(), (w * y).sum()]), w @ x, w @ (x * x)])
    p, d = len(NAMES), FEATURES + 1
    if not len(s["n"]):
        return Model(np.zeros(p), np.ones(p), np.zeros(0), np.zeros(1), np.full(1, 0.5))
    size, ones = s["n"]
    mean = s["sum"] / size
    spread = np.sqrt(np.maximum(s["square"] / size - mean**2, 1e-12))
    model = Model(mean, spread, np.zeros(0), np.zeros(1), np.full(1, ones / size))
    if ones in (0, size):
        return model

    def equations(x: np.ndarray, y: np.ndarray, fold: np.ndarray, times: np.ndarray) -> list[np.ndarray]:
        z = model.features(x)
        weighted = z * times[:, None]
        return [m for k in (0, 2) for m in (weighted[fold == k].T @ z[fold == k], weighted[fold == k].T @ y[fold == k])]

    e = _sums(rows, ["a0", "b0", "a2", "b2"], equations)
    a, b = {k: e[f"a{k}"].reshape(d, d) for k in (0, 2)}, {k: e[f"b{k}"] for k in (0, 2)}
    solve = lambda a, b: np.linalg.solve(a + RIDGE * max(1, np.trace(a) / d) * np.eye(d), b)
    other = {k: solve(a[2 - k], b[2 - k]) for k in (0, 2)}

    def counts(x: np.ndarray, y: np.ndarray, fold: np.ndarray, times: np.ndarray) -> list[np.ndarray]:
        z = model.features(x)
        raw = np.where(fold == 0, z @ other[0], z @ other[2])
        at = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        return [np.bincount(at, times, minlength=BINS), np.bincount(at, times * y, minlength=BINS)]

    c = _sums(rows, ["n", "ones"], counts)
    used = c["n"] > 0
    x = ((np.arange(BINS) + 0.5) / BINS * 2 - 0.5)[used]
    model.knots, model.values = isotonic(x, c["ones"][used] / c["n"][used], c["n"][used])
    model.weights = solve(a[0] + a[2], b[0] + b[2])
    return model


def _scores(model: Model):
    @F.pandas_udf("double")
    def of_text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        give_back()  # of what earlier stages freed in this worker
        for texts in parts:
            yield pd.Series(model.score(np.array([statistics(t) for t in texts], np.float64).reshape(len(texts), len(NAMES))))
            give_back()

    return of_text


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score and predicted, each text read once, where it lies."""
    scored = docs.select(*[F.col(f"`{c}`") for c in others(docs, ("score", "predicted"))], _scores(model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``; ``labels`` is (doc_id, label)."""
    docs = docs.select("doc_id", "text")
    held_out = F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out")
    return score(docs, fit(docs, labels)).select("doc_id", held_out, "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject.  They are scored where they lie, without a shuffle."""
    return docs.where(_scores(fit(docs, labels))("text") >= 0.5)
