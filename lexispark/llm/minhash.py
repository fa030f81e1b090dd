"""MinHash near-dedup: fast similarity sketches, banding, verification on full shingle sets, components.

A sketch is filled in rounds.  In each of the first ``COORDINATES`` rounds every shingle is hashed to one bin and a
value; a bin keeps the least value of the earliest round that reached it; rounds go on until no bin is empty, and past
that many rounds fill bin by bin, so that every coordinate is filled for certain.  ``BANDS`` bands of ``ROWS``
coordinates bring documents together: two of similarity 0.8 share no band with a probability of 5 in a million.  For
less than 80 percent bands are shorter and more (see shape), so that two of just that similarity miss each other no more
often.

Equal sets are one class from the start.  In each bucket one member is compared with all others on their full sets.
Links make components; a bucket whose members aren't all of one component goes on with further members as the one
compared, until each pair in it was compared or is connected.  So pairs are never expanded, and none is left out.

Defined cases: null text is empty; without words a document is linked with nothing; rows that share a ``doc_id`` are one
node, linked through any of their texts, so that they share a component and are kept or not together; a row without ``doc_id`` is linked with nothing and kept; an empty table gives
an empty one; columns of other names are ignored by components and carried by dedup.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_by_counts, tidy, written

BANDS, ROWS = 40, 6
COORDINATES = BANDS * ROWS
#: A sketch has room for the numbers of twice so many rounds and no more; the least percent is what it is enough for.
MOST_COORDINATES, LEAST_PERCENT = 512, 3
#: Members of a bucket that are compared with all others in one later round.
LEADERS = 256
#: Over how many tasks the pairs of one document can be spread.
SALTS = 64
#: Most ids that are broadcast; more are joined by shuffle.
MAX_BROADCAST_IDS = 1_000_000
#: Most edges whose components one task finds in memory.
MAX_EDGES = 1_000_000
#: Bytes of text hashed at a time; a longer document is a slice of its own.
SLICE = 1 << 20

_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(1, 2**63, 256, np.uint64)
_ODD = _RNG.integers(1, 2**63, 64, np.uint64) | np.uint64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_BASE = int(_ODD[0])
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLES = [_powers(_BASE, SLICE), _powers(_INVERSE, SLICE)]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each word of the documents ``data[offsets[i]:offsets[i + 1]]``."""
    data = _FOLD[data]
    inside = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]])
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    up, down = _TABLES if len(data) <= SLICE else (_powers(_BASE, len(data)), _powers(_INVERSE, len(data)))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Ascending hashes of each document's distinct shingles of ``width`` words."""
    words, doc = word_hashes(data, offsets)
    n = len(offsets) - 1
    counts = np.bincount(doc, minlength=n)
    first = np.cumsum(counts) - counts
    whole = max(0, len(words) - width + 1)
    mixed = reduce(np.add, (words[k : k + whole] * _ODD[1 + k] for k in range(width)))
    hashes = mix(mixed)
    out = []
    for i, (a, c) in enumerate(zip(first.tolist(), counts.tolist(), strict=True)):
        if c >= width:
            out.append(np.unique(hashes[a : a + c - width + 1]))
        else:
            short = words[a : a + c] * _ODD[1 : 1 + c]
            out.append(mix(short.sum(dtype=np.uint64, keepdims=True) + _ODD[40:41] * np.uint64(c)) if c else np.zeros(0, np.uint64))
    return out


def sets_of(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The shingle sets of a binary array's documents, slice by slice."""
    texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
        yield from shingle_sets(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], width)
        at = to


def sketches(sets: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """A row of ``coordinates`` values for each set that isn't empty."""
    t, n = coordinates, len(sets)
    out = np.full(n * t, _EMPTY)
    items = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    for i in range(2 * t):
        h = mix(items + np.uint64((2 * i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        spot = (((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)).astype(np.int64) if i < t else np.full(len(h), i - t)
        np.minimum.at(out, owner * t + spot, (np.uint64(i) << np.uint64(54)) | (mix(h) >> np.uint64(10)))
        lacking = (out.reshape(n, t) == _EMPTY).any(1)
        if not lacking[owner].all():
            items, owner = items[lacking[owner]], owner[lacking[owner]]
        if not len(items):
            break
    return out.reshape(n, t)


def shape(percent: int) -> tuple[int, int]:
    """(bands, rows) by which two sets of that similarity share no band as rarely as two of 0.8 in BANDS of ROWS."""
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent must be from {LEAST_PERCENT} to 100, not {percent}")
    if percent >= 80:
        return BANDS, ROWS
    missed = BANDS * math.log1p(-(0.8**ROWS))
    shapes = [(math.ceil(missed / math.log1p(-((percent / 100) ** rows))), rows) for rows in range(1, ROWS + 1)]
    return [s for s in shapes if s[0] * s[1] <= MOST_COORDINATES][-1]


def bands(sketch: np.ndarray, n: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """The bucket of each band of each sketch."""
    grouped = sketch.reshape(len(sketch), n, rows) * _ODD[2 : 2 + rows]
    return mix(grouped.sum(2, dtype=np.uint64) + np.arange(1, n + 1, dtype=np.uint64) * _ODD[50])


def _sketched(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n, s1, s2, bands): size and hash of each set, and buckets of those that can have unequal partners."""
    many, rows = shape(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, every = batch.column("doc_id"), []
            n, s1, s2, keys = [], [], [], []

            def flush():
                big = [k for k, s in enumerate(every) if len(s) and len(s) * (100 - percent) >= percent]  # smaller ones reach it only with equal sets
                found = dict(zip(big, bands(sketches([every[k] for k in big], many * rows), many, rows).view(np.int64) if big else (), strict=True))
                keys.extend(found.get(k) for k in range(len(every)))
                every.clear()

            weight = 0
            for s in sets_of(batch.column("text"), width):
                n.append(len(s))
                s1.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                s2.append(int(mix(s ^ _ODD[60]).sum(dtype=np.uint64).view(np.int64)))
                every.append(s)
                weight += len(s) + 50
                if weight > 200_000:
                    flush()
                    weight = 0
            flush()
            arrays = [ids, pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "s1", "s2", "bands"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(tidy(run), "doc_id long, n long, s1 long, s2 long, bands array<bigint>")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b, linked) of the pairs (a, b), by the full sets of ``texts`` (doc_id, text)."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    heads = salted.select("a", "salt").distinct().join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    tails = salted.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = tails.join(heads, ["a", "salt"]).select("a", "b", "text_a", "text_b").sortWithinPartitions("a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, mine = None, None
        for batch in batches:
            linked = []
            for k, (a, s) in enumerate(zip(batch.column("a").to_pylist(), sets_of(batch.column("text_b"), width), strict=True)):
                text = batch.column("text_a")[k].as_py()
                if head != (a, text):
                    head, mine = (a, text), next(sets_of(pa.array([text], pa.binary()), width))
                small, large = (s, mine) if len(s) < len(mine) else (mine, s)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                inter = int((large[at] == small).sum()) if len(small) else 0
                union = len(s) + len(mine) - inter
                linked.append(inter > 0 and 100 * inter >= percent * union)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return both.mapInArrow(tidy(run), "a long, b long, linked boolean")


def components_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All vertices of the edges (a, b), and the smallest that each reaches."""
    v, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(v))
    while True:
        low, new = np.minimum(label[x], label[y]), label.copy()
        for at in (label[x], label[y]):
            np.minimum.at(new, at, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return v, v[label]
        label = new


def _connected_in_one(edges: DataFrame) -> DataFrame:
    """connected() by one task, for few edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [(np.array(batch.column("a")), np.array(batch.column("b"))) for batch in batches if batch.num_rows]
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in components_of(*map(np.concatenate, zip(*ends, strict=True)))], ["v", "label"])

    return cut(edges.select("a", "b").coalesce(1).mapInArrow(tidy(run), "v long, label long"), "labels")


def connected(edges: DataFrame) -> DataFrame:
    """(v, label): the smallest vertex reachable over the edges (a, b), for every vertex of an edge.

    Each round a vertex takes the least label around it, then its label's label; hot vertices and labels are joined by
    their counts.  Every round is a written table.  Up to MAX_EDGES, one task does it all, which spares the driver dozens
    of plans.
    """
    if [edges.schema[c].dataType.simpleString() for c in "ab"] == ["bigint", "bigint"] and edges.limit(MAX_EDGES + 1).count() <= MAX_EDGES:
        return _connected_in_one(edges)
    ends = cut(edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w"))).distinct(), "ends")
    labels = cut(ends.groupBy("v").agg(F.count("*").alias("degree"), F.least(F.min("w"), F.first("v")).alias("label")), "labels")
    while True:
        around = join_by_counts(ends, labels, ["v"], "degree").groupBy(F.col("w").alias("v")).agg(F.min("label").alias("near"))
        near = cut(labels.join(around, "v").select("v", "degree", F.col("label").alias("was"), F.least("label", "near").alias("label")), "near")
        counts = near.groupBy("label").agg(F.count("*").alias("held"))
        roots = counts.join(near.select(F.col("v").alias("label"), F.col("label").alias("next")), "label")
        jumped = cut(join_by_counts(near, roots, ["label"], "held").select("v", "degree", "was", F.col("next").alias("label")), "labels")
        changed = jumped.where("label <> was").limit(1).count()
        labels = jumped.select("v", "degree", "label")
        if not changed:
            return labels.select("v", "label")


def _few(ids: DataFrame) -> DataFrame:
    """``ids``, broadcast if they are few enough."""
    return F.broadcast(ids) if ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS else ids


def links(reps: DataFrame, docs: DataFrame, width: int, percent: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Labels (v, label) of the linked among ``reps`` (doc_id, n, bands), one row per class, and the verified links."""
    rows = reps.where(F.col("bands").isNotNull()).select("doc_id", "n", F.explode("bands").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.min(F.struct("doc_id", "n")).alias("head"), F.count("*").alias("members")).where("members > 1")
    member = cut(join_by_counts(rows, cut(sizes, "buckets"), ["bucket"], "members").select("bucket", "doc_id", "n", "head"), "members")
    alike = lambda m, n: F.least(m, n) * 100 >= F.greatest(m, n) * percent
    pairs = cut(
        member.where((F.col("doc_id") != F.col("head.doc_id")) & alike(F.col("n"), F.col("head.n"))).select(F.col("head.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct(),
        "pairs",
    )
    ids = _few(cut(member.select("doc_id").distinct(), "ids"))
    texts = cut(docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(ids, "doc_id", "left_semi"), "texts")
    member = member.select("bucket", "doc_id", "n", F.lit(False).alias("done")).unionByName(member.where("doc_id = head.doc_id and n = head.n").select("bucket", "doc_id", "n", F.lit(True).alias("done")))
    member = cut(member.groupBy("bucket", "doc_id", "n").agg(F.max("done").alias("done")).where("not done").drop("done"), "rest")
    verified = _verified(pairs, texts, width, percent)
    paths = [written(verified, "verified")]
    read = verified.sparkSession.read.schema(verified.schema).parquet  # one scan, however many rounds have written
    seen = fresh_seen = read(*paths)
    labels = None
    while True:
        found = seen.where("linked").select("a", "b")
        if fresh_seen is not None and fresh_seen.where("linked").limit(1).count():
            labels = connected(found)
        named = member.withColumn("label", F.col("doc_id")) if labels is None else member.join(labels.withColumnRenamed("v", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
        open_ = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket")
        active = cut(named.join(open_, "bucket", "left_semi"), "active")
        if not active.limit(1).count():
            return labels, found
        parts = active.groupBy("bucket", "label").agg(F.count("*").alias("members"), F.min(F.struct("doc_id", "n")).alias("head"))
        fewest = Window.partitionBy("bucket").orderBy("members", "label")
        heads = cut(parts.withColumn("nth", F.row_number().over(fewest)).where(F.col("nth") <= LEADERS).select("bucket", "head", F.col("label").alias("head_label")), "heads")
        met = active.join(heads, "bucket").where((F.col("label") != F.col("head_label")) & alike(F.col("n"), F.col("head.n")))
        wanted = met.select(F.least("doc_id", "head.doc_id").alias("a"), F.greatest("doc_id", "head.doc_id").alias("b")).distinct()
        fresh = cut(wanted.join(seen.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
        fresh_seen = None
        if fresh.limit(1).count():
            paths.append(written(_verified(fresh, texts, width, percent), "verified"))
            fresh_seen, seen = read(paths[-1]), read(*paths)
        used = heads.select("bucket", "head.doc_id", "head.n")
        member = cut(active.select("bucket", "doc_id", "n").join(used, ["bucket", "doc_id", "n"], "left_anti"), "rest")


def components(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    every = cut(_sketched(docs, width, percent), "sketches")
    linkable = every.where("n > 0 and doc_id is not null")
    classes = cut(linkable.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = linkable.join(classes.select(F.col("rep").alias("doc_id"), "s1", "s2", "n"), ["doc_id", "s1", "s2", "n"], "left_semi")
    labels, linked = links(reps, docs, width, percent)
    repeated = every.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = bool(repeated.limit(1).count())
    if again:
        repeated = _few(cut(repeated, "repeated"))
        held = join_by_counts(linkable, classes, ["s1", "s2", "n"], "copies").join(repeated, "doc_id", "left_semi")
        labels = connected(linked.unionByName(held.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))))
    named = classes.withColumn("component_id", F.col("rep"))
    if labels is not None:
        named = classes.join(labels.withColumnRenamed("v", "rep"), "rep", "left").withColumn("component_id", F.coalesce("label", "rep")).drop("label")
    found = join_by_counts(linkable.select("doc_id", "n", "s1", "s2"), cut(named, "named"), ["s1", "s2", "n"], "copies").select("doc_id", "n", "component_id")
    alone = every.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    if again:
        nodes = cut(found.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("node")), "nodes")
        alone = alone.join(_few(nodes), "doc_id", "left").select("doc_id", "n", F.coalesce("node", "component_id").alias("component_id"))
    out = found.unionByName(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def dedup(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without all but one document of each component; of rows that share an id one stays."""
    judged = cut(components(docs, width, percent), "components")
    gone = judged.where("not kept").select("doc_id").distinct()
    stay = docs.join(_few(cut(gone, "gone")), "doc_id", "left_anti").select(*docs.columns)
    again = cut(judged.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if not again.limit(1).count():
        return stay
    again = _few(again)
    return stay.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(stay.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))
