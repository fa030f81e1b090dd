"""URL filters: a Bloom filter cascade that answers membership in a rule list exactly, without joins.

The cascade knows every key that the corpus can ask for (its key universe: host suffixes with path prefixes of the
lengths that rules have).  Level 0 encodes the listed keys; level 1 the keys of the universe that pass level 0 by
mistake; level 2 the listed keys that pass level 1; and so on until a level makes no mistakes.  A key is listed if
the first level that refuses it is an odd one.  Level 0 is grown until it lets through at most ``slack`` unlisted keys
a listed one, so that all that follows, and what is broadcast, is bounded by the rule list, whatever the corpus.

Defined cases: a null url, or one without "://", has an empty host and path and no rule; equal urls get equal
verdicts; an empty table gives an empty one; other columns are carried, those named like a result are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

#: (action, host, path)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Bloom:
    """``n`` keys at a false positive rate of about ``rate``; keys are rows of two 64-bit hashes."""

    def __init__(self, keys: np.ndarray, rate: float, level: int):
        self.level = level
        self.hashes = max(1, round(-math.log2(rate)))
        self.bits = max(64, math.ceil(len(keys) * self.hashes / math.log(2)))
        self.words = np.zeros((self.bits + 63) // 64, np.uint64)
        for at in self._places(keys):
            np.bitwise_or.at(self.words, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))

    def _places(self, keys: np.ndarray) -> Iterable[np.ndarray]:
        with np.errstate(over="ignore"):
            a = _mix(keys[:, 0] + np.uint64(0x9E3779B97F4A7C15) * np.uint64(2 * self.level + 1))
            b = _mix(keys[:, 1] + np.uint64(0x9E3779B97F4A7C15) * np.uint64(2 * self.level + 2)) | np.uint64(1)
            for i in range(self.hashes):
                yield (a + np.uint64(i) * b) % np.uint64(self.bits)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self._places(keys):
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def member(levels: list[Bloom], keys: np.ndarray) -> np.ndarray:
    """Whether each key is listed: the number of levels passed before the first refusal is odd."""
    passed, left = np.zeros(len(keys), np.int64), np.arange(len(keys))
    for level in levels:
        left = left[level.holds(keys[left])]
        passed[left] += 1
    return passed % 2 == 1


def _pairs(frame: pd.DataFrame) -> np.ndarray:
    return np.ascontiguousarray(frame[["h1", "h2"]].to_numpy(np.int64)).view(np.uint64).reshape(-1, 2)


def cascade(universe: DataFrame, listed: DataFrame, slack: int = 4) -> list[Bloom]:
    """The levels for ``listed`` against ``universe``, both (h1, h2).

    The list is held by the driver, as every rule list is; of the universe only level 0's mistakes are, at most
    ``slack`` times as many (1,024 at least): else level 0 is made finer first.
    """
    yes = _pairs(listed.toPandas())
    bound, rate = max(1024, slack * len(yes)), 0.5
    known = universe.sparkSession.createDataFrame(listed.toPandas(), listed.schema)
    if len(yes) == 0:
        return []
    while True:
        first = Bloom(yes, rate, 0)

        def mistaken(batches, level=first):
            for frame in batches:
                if len(frame):
                    yield frame[level.holds(np.ascontiguousarray(frame[["h1", "h2"]].to_numpy(np.int64)).view(np.uint64).reshape(-1, 2))]

        wrong = universe.mapInPandas(mistaken, universe.schema).join(F.broadcast(known), ["h1", "h2"], "left_anti").limit(bound + 1).toPandas()
        if len(wrong) <= bound:
            break
        rate /= 16
    levels, inside, outside = [first], yes, _pairs(wrong)
    while len(outside):
        levels.append(Bloom(outside, 0.5, len(levels)))
        inside, outside = outside, inside[levels[-1].holds(inside)]
    return levels


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds host and path."""
    start = F.instr(F.col("url"), "://")
    rest = F.when(start > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(F.col("__rest"), "^[^/?#]*", 0)
    return (
        pages.withColumn("__rest", F.coalesce(rest, F.lit("")))
        .withColumn("__host", host)
        .withColumn("path", F.regexp_extract(F.expr("substring(__rest, length(__host) + 1)"), "^[^?#]*", 0))
        .withColumn("host", F.translate("__host", UPPER, LOWER))
        .drop("__rest", "__host")
    )


def candidates(host: str, path: str, rules: list[tuple[str, str, str]]) -> Column:
    """Array of the keys that rules could have for a host and path, longest first; as few as rules have shapes."""
    shapes = {(h.count(".") + 1, len(p)) for _, h, p in rules}
    labels = F.split(F.col(host), r"\.", -1)
    keys = [
        F.when(
            (F.size(labels) >= n) & (F.length(path) >= m) & (F.col(host) != ""),
            F.struct(F.substring_index(F.col(host), ".", -n).alias("host"), F.substring(F.col(path), 1, m).alias("path")),
        )
        for n, m in sorted(shapes)
    ]
    found = F.filter(F.array(*keys), lambda k: k.isNotNull())
    longest = F.transform(found, lambda k: F.struct((-F.length(k.host) - F.length(k.path)).alias("a"), (-F.length(k.host)).alias("b"), k.host.alias("host"), k.path.alias("path")))
    return F.transform(F.array_sort(longest), lambda k: F.struct(k.host.alias("host"), k.path.alias("path"), *_hashes(k.host, k.path)))


def _hashes(host: Column, path: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), host, path).alias("h1"), F.xxhash64(F.lit(2), host, path).alias("h2")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (of the longest rule that fits, else null) and verdict.

    A url that no rule fits is in no list, which the cascade says for certain, and gets ``default``.
    """
    rules = RULES if rules is None else rules
    spark = pages.sparkSession
    parts = with_parts(pages.drop("host", "path", "rule", "verdict"))
    if not rules:
        return parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    keyed = parts.withColumn("__keys", candidates("host", "path", rules))
    universe = keyed.select(F.explode("__keys").alias("k")).select("k.h1", "k.h2").distinct()
    lists = {}
    for action in ("allow", "block"):
        mine = [(h, p) for a, h, p in rules if a == action]
        if mine:
            listed = spark.createDataFrame(mine, "host string, path string").select(*_hashes(F.col("host"), F.col("path"))).distinct()
            lists[action] = cascade(universe, listed)

    @F.pandas_udf("struct<at int, verdict string>")
    def first_rule(h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
        sizes = np.array([len(x) for x in h1], np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        at, verdict = np.full(len(sizes), -1, np.int64), np.full(len(sizes), default, object)
        if len(owner):
            keys = np.stack([np.concatenate([np.asarray(x, np.int64) for x in h]) for h in (h1, h2)], 1)
            keys = np.ascontiguousarray(keys).view(np.uint64).reshape(-1, 2)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            for action, levels in lists.items():
                for i in np.flatnonzero(member(levels, keys)):
                    if at[owner[i]] < 0 or nth[i] < at[owner[i]]:
                        at[owner[i]], verdict[owner[i]] = nth[i], action
        return pd.DataFrame({"at": at, "verdict": verdict})

    found = keyed.withColumn("__found", first_rule(F.col("__keys.h1"), F.col("__keys.h2")))
    key = F.get("__keys", F.when(F.col("__found.at") >= 0, F.col("__found.at")))
    return found.withColumns({"rule": F.concat(key["host"], key["path"]), "verdict": F.col("__found.verdict")}).drop("__keys", "__found")
