"""Best-fit packing of token sequences by a grouping genetic algorithm.

Documents are encoded and cut to the capacity once; what is packed are lengths.  Pieces are spread by hash over shards
of about ``SHARD`` pieces, so that no task grows with the corpus.  Each shard is packed by several islands.  A
chromosome is a set of bins, its fitness how full they are.  Parents are chosen by tournament; crossover injects whole
well-filled bins of one parent into the other and drops the bins that hold an injected piece a second time; mutation
dissolves badly filled bins.  What is displaced by either is first exchanged against pieces of bins that have room
left, one or two for one or two, where that fills them better, and then put where it fits best, the largest first.
Between epochs every island gets the elite of its neighbour.  At the end the pieces of badly filled bins of all shards
are pooled and packed once more.  A shard stops, after one generation at least, when a lower bound proves that no
packing has fewer bins; ``report`` tells how each ended.

Defined cases: null or empty text is one piece, the end token alone; rows are documents, also when they share a
``doc_id`` or have none; a piece as long as the capacity has a sequence of its own; an empty table gives an empty
one; columns of other names are ignored.
"""

from __future__ import annotations

import json
import math
import random
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import cut, tidy

SHARD, ISLANDS, EPOCHS = 4096, 2, 2
POPULATION, GENERATIONS, TOURNAMENT = 8, 20, 3
#: Displaced pieces for which exchanges are looked for at a time; others are put back by best fit.
EXCHANGED = 200
#: Bins filled to less than this share are pooled across shards and packed again.
LOOSE = 0.98
_SCHEMA = "shard long, island int, item long, length int, bin int, n_bins int, fitness double, generations int, least int"


class Tokens:
    """Ids of a text by a byte-level BPE tokenizer file.

    Its merges are run by the rank encoder, which gives the same ids in a fraction of the time; texts that hold the
    string of one of the file's added tokens go to the file's own library.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            self.source, self.pattern = file.read(), pattern
        self.built = None

    def __reduce__(self):
        return _tokens, (self.source, self.pattern)

    def build(self):
        if self.built is None:
            spec = json.loads(self.source)
            added = {t["content"] for t in spec["added_tokens"]}
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
            byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
            ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
            self.built = (
                tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={}),
                Tokenizer.from_str(self.source),
                added,
            )
        return self.built

    def __call__(self, text: str | None) -> np.ndarray:
        fast, own, added = self.build()
        if any(a in (text or "") for a in added):
            return np.array(own.encode(text, add_special_tokens=False).ids, "<u4")
        return fast.encode_to_numpy(text or "", disallowed_special=()).astype("<u4")


def _tokens(source: str, pattern: str) -> Tokens:
    out = Tokens.__new__(Tokens)
    out.source, out.pattern, out.built = source, pattern, None
    return out


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; only the first may be shorter than the capacity."""
    head = n % capacity or capacity
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


def pieces(docs: DataFrame, path: str, pattern: str, capacity: int = 2048, end: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, item, piece, start, length, ids_crc32[, ids]) of every document; item numbers the pieces anyhow."""
    shared = docs.sparkSession.sparkContext.broadcast(Tokens(path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(shared.value(text), np.uint32(end)).astype("<u4")
                for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                    own = ids[start : start + length]
                    for column, value in zip(out, (doc_id, k, start, length, zlib.crc32(own.tobytes()), own), strict=True):
                        column.append(value)
            types = [batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            n = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in list(zip(out, types, strict=True))[:n]], names[:n])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<bigint>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema).withColumn("item", F.monotonically_increasing_id())


class Packing:
    """Bins by what is left in them: best fit is the lowest set bit of a mask of the remainders in use."""

    def __init__(self, capacity: int):
        self.capacity, self.bins, self.left = capacity, [], []
        self.by_left: dict[int, list[int]] = {}
        self.mask = 0

    def _file(self, b: int) -> None:
        r = self.left[b]
        self.by_left.setdefault(r, []).append(b)
        self.mask |= 1 << r

    def add_bin(self, items: list[int], left: int) -> None:
        self.bins.append(items)
        self.left.append(left)
        self._file(len(self.bins) - 1)

    def best_fit(self, items: list[int], size: list[int]) -> None:
        for i in items:
            s = size[i]
            above = self.mask >> s
            if not above:
                self.add_bin([i], self.capacity - s)
                continue
            r = s + (above & -above).bit_length() - 1
            same = self.by_left[r]
            b = same.pop()
            if not same:
                self.mask ^= 1 << r
            self.bins[b].append(i)
            self.left[b] = r - s
            self._file(b)

    def fitness(self) -> float:
        return sum((1 - r / self.capacity) ** 2 for r in self.left) / max(1, len(self.left))


def decreasing(size: list[int], capacity: int, noise: float, rng: random.Random) -> Packing:
    order = sorted(range(len(size)), key=lambda i: -size[i] * (1 + noise * rng.random()))
    out = Packing(capacity)
    out.best_fit(order, size)
    return out


def put_back(bins: list[list[int]], displaced: list[int], size: list[int], capacity: int, rng: random.Random) -> Packing:
    """The bins with the displaced pieces: exchanges that fill a bin better first, then best fit, the largest first."""
    out = Packing(capacity)
    room = []
    for items in bins:
        left = capacity - sum(size[i] for i in items)
        (room.append((left, items)) if left and displaced else out.add_bin(items, left))
    rng.shuffle(displaced)
    free, rest = sorted(displaced[:EXCHANGED], key=lambda i: size[i]), displaced[EXCHANGED:]
    for left, items in room:
        while left and (found := _exchange(items, left, free, size)):
            given, taken = found
            for i in given:
                items.remove(i)
            free = sorted([i for i in free if i not in taken] + list(given), key=lambda i: size[i])
            items += taken
            left = capacity - sum(size[i] for i in items)
        out.add_bin(items, left)
    out.best_fit(sorted(free + rest, key=lambda i: -size[i]), size)
    return out


def _exchange(items: list[int], left: int, free: list[int], size: list[int]) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
    """Of one or two of ``items`` for one or two of ``free`` (ascending) the exchange that leaves least room, if any helps."""
    lengths = [size[i] for i in free]
    best, most = None, 0
    singles = [(size[i], (i,)) for i in items]
    pairs = [(size[i] + size[j], (i, j)) for k, i in enumerate(items) for j in items[:k]] if len(items) <= 12 else []
    for out, given in (*singles, *pairs):
        at = bisect_right(lengths, out + left) - 1
        if at >= 0 and lengths[at] - out > most:
            best, most = (given, (free[at],)), lengths[at] - out
        lo, hi = 0, len(lengths) - 1
        while lo < hi and most < left:  # two ends towards each other
            gain = lengths[lo] + lengths[hi] - out
            if gain > left:
                hi -= 1
            else:
                if gain > most:
                    best, most = (given, (free[lo], free[hi])), gain
                lo += 1
        if most == left:
            break
    return best


def crossover(a: Packing, b: Packing, size: list[int], rng: random.Random) -> Packing:
    """``a`` with whole well-filled bins of ``b``."""
    full = sorted(range(len(b.bins)), key=lambda k: b.left[k])[: max(1, len(b.bins) * 2 // 3)]
    chosen = rng.sample(full, rng.randint(1, max(1, len(full) // 2)))
    injected = {i for k in chosen for i in b.bins[k]}
    bins, displaced = [[*b.bins[k]] for k in chosen], []
    for items in a.bins:
        if injected.isdisjoint(items):
            bins.append([*items])
        else:
            displaced += [i for i in items if i not in injected]
    return put_back(bins, displaced, size, a.capacity, rng)


def mutated(a: Packing, size: list[int], rng: random.Random) -> Packing:
    """``a`` with some of its bins dissolved, the badly filled ones rather."""
    loose = [k for k, left in enumerate(a.left) if left]
    gone = {*rng.sample(loose, min(len(loose), rng.randint(1, 3 + len(loose) // 10))), rng.randrange(len(a.bins))}
    displaced = [i for k in gone for i in a.bins[k]]
    return put_back([[*items] for k, items in enumerate(a.bins) if k not in gone], displaced, size, a.capacity, rng)


def least_bins(size: list[int], capacity: int) -> int:
    """No packing has fewer bins: pieces above half need one each, and the rest fill at best what those leave."""
    order = np.sort(np.array(size, np.int64))
    total = np.concatenate([[0], np.cumsum(order)])
    big = int((2 * order > capacity).sum())
    small = np.unique(order[2 * order <= capacity])
    lo, hi = np.searchsorted(order, small), np.searchsorted(order, capacity - small, "right")
    return int(max([big, -(-int(total[-1]) // capacity), *(len(order) - hi - (total[lo] - total[hi]) // capacity)]))


def evolve(size: list[int], capacity: int, seeds: list[Packing], rng: random.Random, generations: int = GENERATIONS) -> tuple[Packing, int, int]:
    """The best of a population after some generations, their number, and the least number of bins there can be.

    Each generation has a crossover of two parents chosen by tournament and a mutation of one; the worst go.  It ends,
    after one generation at least, when no packing can have fewer bins; seeds, which earlier generations left, may
    prove that at once.
    """
    population = [*seeds] or [decreasing(size, capacity, 0, rng)]
    fit = lambda p: (-len(p.bins), p.fitness())
    least = least_bins(size, capacity)
    proven = min(len(p.bins) for p in population) <= least
    if seeds and proven:  # which come from a generation
        return max(population, key=fit), 0, least
    many = 2 if proven else POPULATION
    while len(population) < many:
        population.append(decreasing(size, capacity, 0.3 * len(population) / POPULATION, rng))
    ranked = sorted(((fit(p), i, p) for i, p in enumerate(population)), key=lambda x: (x[0], -x[1]), reverse=True)
    born = len(ranked)
    choose = lambda: min(rng.sample(range(len(ranked)), min(TOURNAMENT, len(ranked))))
    for done in range(1, generations + 1):
        a, b = choose(), choose()
        children = [crossover(ranked[a][2], ranked[b if b != a else (a + 1) % len(ranked)][2], size, rng), mutated(ranked[choose()][2], size, rng)]
        for child in children:
            if (f := fit(child)) not in {r[0] for r in ranked}:  # equal fitness is nearly always the same packing
                ranked.append((f, born, child))
                born += 1
        ranked = sorted(ranked, key=lambda x: (x[0], -x[1]), reverse=True)[:POPULATION]
        if len(ranked[0][2].bins) <= least:
            break
    return ranked[0][2], done, least


def _epoch(rows: DataFrame, capacity: int, seed: int) -> DataFrame:
    """Packs each (shard, island); rows have a column ``origin``: null, or the island whose elite ``bin`` is of."""

    def island(key: tuple[int, int], frame: pd.DataFrame) -> pd.DataFrame:
        rng = random.Random(f"{seed} {key}")
        items = frame[["item", "length"]].drop_duplicates("item").sort_values("item")
        size = items["length"].astype(int).tolist()
        known, seeds = items["item"].to_numpy(), []
        for origin in np.unique(frame["origin"].dropna()):
            own = frame[frame["origin"] == origin].sort_values(["bin", "item"])
            place, first = np.searchsorted(known, own["item"]), np.flatnonzero(np.diff(own["bin"], prepend=-1))
            left = capacity - np.add.reduceat(own["length"].to_numpy(np.int64), first)
            elite = Packing(capacity)
            for in_bin, r in zip(np.split(place, first[1:]), left.tolist(), strict=True):
                elite.add_bin(in_bin.tolist(), r)
            seeds.append(elite)
        found, generations, least = evolve(size, capacity, seeds, rng)
        bins = np.empty(len(size), np.int32)
        for b, own in enumerate(found.bins):
            bins[own] = b
        generations += int(frame["generations"].max())
        return pd.DataFrame({"shard": key[0], "island": key[1], "item": items["item"].to_numpy(), "length": size, "bin": bins, "n_bins": len(found.bins), "fitness": found.fitness(), "generations": generations, "least": least})

    return rows.groupBy("shard", "island").applyInPandas(island, _SCHEMA)


def _pack(items: DataFrame, n: int, capacity: int, islands: int, epochs: int, seed: int) -> DataFrame:
    """(shard, item, length, bin) of the best island of each shard."""
    shards = max(1, math.ceil(n / SHARD))
    spread = items.select("item", F.col("length").cast("int").alias("length"), F.pmod(F.xxhash64(F.lit(seed), "item"), F.lit(shards)).alias("shard"))
    none = F.lit(None).cast("int")
    rows = spread.withColumns({"island": F.explode(F.sequence(F.lit(0), F.lit(islands - 1))), "bin": none, "origin": none, "generations": F.lit(0)})
    elites = _epoch(rows, capacity, seed)
    for epoch in range(1, epochs):
        targets = F.array_distinct(F.array("island", (F.col("island") + 1) % islands))
        moved = elites.withColumns({"origin": F.col("island"), "to": F.explode(targets)})  # its own elite and its neighbour's
        elites = _epoch(moved.select("shard", F.col("to").alias("island"), "item", "length", "bin", "origin", "generations"), capacity, seed + epoch)
    best = Window.partitionBy("shard", "item").orderBy("n_bins", F.desc("fitness"), "island")
    return elites.withColumn("nth", F.row_number().over(best)).where("nth = 1").select("shard", "item", "length", "bin", "n_bins", "generations", "least")


def report(items: DataFrame, capacity: int = 2048, islands: int = ISLANDS, epochs: int = EPOCHS, seed: int = 1) -> DataFrame:
    """(shard, n_items, n_bins, least, generations) of the shards of items (item, length): how their packing ended."""
    packed = _pack(items, items.count(), capacity, islands, epochs, seed)
    return packed.groupBy("shard").agg(F.count("*").alias("n_items"), F.first("n_bins").alias("n_bins"), F.first("least").alias("least"), F.first("generations").alias("generations"))


def pack(items: DataFrame, capacity: int = 2048, islands: int = ISLANDS, epochs: int = EPOCHS, seed: int = 1) -> DataFrame:
    """(item, length, sequence_id, offset) of every item, given (item, length); no length may exceed the capacity."""
    full = items.where(F.col("length") == capacity).select("item", F.col("length").cast("int").alias("length"), (-F.col("item") - 1).alias("sequence_id"))
    rest = items.where(F.col("length") < capacity)
    n = rest.count()
    if not n:
        return full.withColumn("offset", F.lit(0).cast("long"))
    once = cut(_pack(rest, n, capacity, islands, epochs, seed), "packed")
    fill = Window.partitionBy("shard", "bin")
    filled = once.withColumn("fill", F.sum("length").over(fill))
    identity = lambda level: F.shiftleft(F.lit(level).cast("long"), 60) + F.shiftleft(F.col("shard"), 24) + F.col("bin")
    tight = filled.where(F.col("fill") >= LOOSE * capacity)
    loose = cut(filled.where(F.col("fill") < LOOSE * capacity).select("item", "length"), "loose")
    placed = full.unionByName(tight.select("item", "length", identity(0).alias("sequence_id")))
    if m := loose.count():
        again = _pack(loose, m, capacity, islands, epochs, seed + 1000)
        placed = placed.unionByName(again.select("item", "length", identity(1).alias("sequence_id")))
    order = Window.partitionBy("sequence_id").orderBy("item").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("offset", F.sum("length").over(order) - F.col("length"))


def pack_documents(docs: DataFrame, path: str, pattern: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    cutting = cut(pieces(docs, path, pattern, capacity, end), "pieces")
    placed = pack(cutting.select("item", "length"), capacity).select("item", "sequence_id", "offset")
    return cutting.join(placed, "item").drop("item")


def sequences(docs: DataFrame, path: str, pattern: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """(sequence_id, ids) of the packed sequences themselves."""
    cutting = cut(pieces(docs, path, pattern, capacity, end, with_ids=True), "pieces")
    placed = pack(cutting.select("item", "length"), capacity).select("item", "sequence_id", "offset")
    parts = cutting.join(placed, "item").groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"))
