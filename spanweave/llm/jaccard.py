"""N-gram Jaccard join: MinHash candidates, Bayesian pruning, exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import broadcast_if_small, frugal, materialize, portions, small_batches, text_keys
from .graph import connected_components

#: Words of a shingle and the similarity that links two documents.
WORDS, THRESHOLD = 5, 0.8
#: BANDS x ROWS MinHash values; a pair at 0.8 shares no band with probability (1 - 0.8^6)^50 = 3e-7.
BANDS, ROWS = 50, 6
#: A pair is dropped once its posterior probability of reaching the threshold is below this.
TOLERANCE = 1e-7
#: MinHash values compared at a time.
STEP = 30
#: Documents and shingles of a block; a task compares two blocks at a time.
BLOCK_DOCS, BLOCK_SHINGLES = 256, 1_000_000

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all of them."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n hashes."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for i in range(n):
        out = out * _MULTIPLY + hashes[i : i + len(out)]
    return mix(out)


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of n words, A-Z lower-cased; a shorter text is one run, one without words none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(rolling(word_hashes(words), min(n, len(words))))


@lru_cache(4)
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_501)
    return (rng.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1))[:, None], rng.integers(0, 1 << 32, n, np.uint64).astype(np.uint32)[:, None]


def minhash(items: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    a, b = _permutations(n)
    x = (items ^ (items >> np.uint64(32))).astype(np.uint32)[None, :]
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for at in range(0, x.shape[1], 1024):
        out = np.minimum(out, (x[:, at : at + 1024] * a + b).min(axis=1))
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    out = np.arange(bands, dtype=np.uint64)
    for column in signature[: bands * rows].reshape(bands, rows).T:
        out = mix(out * _MULTIPLY + column.astype(np.uint64))
    return out.view(np.int64)


@lru_cache(None)
def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """Fewest matches among n MinHash values at which P(similarity >= threshold) is at least tolerance.

    With a uniform prior the similarity is Beta(m + 1, n - m + 1) after m matches, and P(Beta >= t) equals
    P(Binomial(n + 1, t) <= m).
    """
    below = 0.0
    for m in range(n + 1):
        below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if below >= tolerance:
            return m
    return n + 1


def close_pairs(sa: np.ndarray, sb: np.ndarray | None, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of signatures that the posterior leaves, within sa (i < j) or between sa and sb: values are compared STEP at a time."""
    right, n = sa if sb is None else sb, BANDS * ROWS
    i, j = np.triu_indices(len(sa), 1) if sb is None else (x.ravel() for x in np.indices((len(sa), len(right))))
    matches = np.zeros(len(i), np.int32)
    for at in range(0, n, STEP):
        for part in range(0, len(i), 200_000):
            p = slice(part, part + 200_000)
            matches[p] += (sa[i[p], at : at + STEP] == right[j[p], at : at + STEP]).sum(axis=1, dtype=np.int32)
        stay = matches >= least_matches(min(n, at + STEP), threshold, tolerance)
        i, j, matches = i[stay], j[stay], matches[stay]
        if not len(i):
            break
    return i, j


def similar_pairs(sets: list[np.ndarray], others: list[np.ndarray] | None, i: np.ndarray, j: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Those of the index pairs with Jaccard >= threshold, within sets or between sets and others."""
    within = others is None
    right = sets if within else others
    if not len(i):
        return i, j
    na, nb = np.array([len(s) for s in sets]), np.array([len(s) for s in right])
    if len(i) <= 64:
        shared = np.array([len(np.intersect1d(sets[a], right[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist())])
    else:
        shared = _shared_counts(sets, right, within, i, j)
    good = shared >= threshold * (na[i] + nb[j] - shared) - 1e-9
    return i[good], j[good]


def _shared_counts(sets: list[np.ndarray], right: list[np.ndarray], within: bool, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact sizes of the pairs' intersections, as products of 0/1 matrices over a few thousand shingles at a time."""
    rows = sets if within else [*sets, *right]
    shift = 0 if within else len(sets)
    used = np.zeros(len(rows), bool)
    used[i] = used[j + shift] = True
    owner = np.concatenate([np.full(len(s), k) for k, s in enumerate(rows) if used[k]])
    values, item = np.unique(np.concatenate([s for k, s in enumerate(rows) if used[k]]), return_inverse=True)
    often = np.bincount(item, minlength=len(values)) > 1
    column = np.cumsum(often) - 1
    keep = often[item]
    owner, item = owner[keep], column[item[keep]]
    order = np.argsort(item, kind="stable")
    owner, item = owner[order], item[order]
    width, total = 4096, int(often.sum())
    shared = np.zeros((len(sets), len(right)), np.float32)
    cuts = np.searchsorted(item, np.arange(0, total + width, width))
    for k in range(len(cuts) - 1):
        dense = np.zeros((len(rows), width), np.float32)
        dense[owner[cuts[k] : cuts[k + 1]], item[cuts[k] : cuts[k + 1]] - k * width] = 1
        shared += dense[: len(sets)] @ dense[shift:].T
    return np.rint(shared[i, j]).astype(np.int64)


def _set_key(items: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, k1, k2, text) to the text's set key, size and bands."""
    for batch in batches:
        for a, b in portions(pc.binary_length(batch.column(3)).to_pylist()):
            part = batch.slice(a, b - a)
            sets = [shingles(t) for t in part.column(3).to_pylist()]
            keys = [band_keys(minhash(s)).tolist() if len(s) else [] for s in sets]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([_set_key(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "k1", "k2", "set_key", "n", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, copies, text) of the candidates to their signatures and shingle sets."""
    for batch in batches:
        for a, b in portions(pc.binary_length(batch.column(2)).to_pylist(), 300_000):
            part = batch.slice(a, b - a)
            sets = [shingles(t) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array([minhash(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rid", "copies", "signature", "items"])


class Cell:
    """Rows of two blocks of a group, or of one: (grp, first, second, by_band, block, rid, signature, ...)."""

    def __init__(self, rows: list[tuple]):
        self.rows, (self.group, first, second, self.by_band) = rows, rows[0][:4]
        self.within = first == second
        self.left = [r for r in rows if r[4] == first]
        self.right = self.left if self.within else [r for r in rows if r[4] == second]

    def pairs(self, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that the posterior leaves. Of a group that is a band's bucket, only those that no earlier band shows too."""
        if not self.left or not self.right:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sa, sb = (np.stack([np.frombuffer(r[6], np.uint32) for r in rows]) for rows in (self.left, self.right))
        i, j = close_pairs(sa, None if self.within else sb, threshold, tolerance)
        if self.by_band and len(i):
            ka, kb = (np.stack([band_keys(x) for x in s]) for s in (sa, sb))
            same = ka[i] == kb[j]
            mine = ka[i, same.argmax(axis=1)] == self.group
            i, j = i[mine], j[mine]
        return i, j


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[Cell]:
    """Rows sorted by (grp, first, second) to cells, one at a time."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[:3] != held[0][:3]:
                yield Cell(held)
                held = []
            held.append(row)
    if held:
        yield Cell(held)


def _prune(threshold: float, tolerance: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells of signatures to the rows that have a pair left there."""
        out, kinds = [], (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int64())
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["grp", "first", "second", "by_band", "block", "rid"])
        for cell in _cells(batches):
            i, j = cell.pairs(threshold, tolerance)
            stay = {cell.left[k][5]: cell.left[k] for k in set(i.tolist())} | {cell.right[k][5]: cell.right[k] for k in set(j.tolist())}
            out += [r[:6] for r in stay.values()]
            if len(out) > 10_000:
                yield flush()
                out = []
        if out:
            yield flush()

    return run


def _verify(threshold: float, tolerance: float):
    def links(cell: Cell) -> list[tuple[int, int, int]]:
        """(rid, links found here, smallest rid linked to here); rows go on with copies and items."""
        i, j = cell.pairs(threshold, tolerance)
        left, right, within = cell.left, cell.right, cell.within
        sets = lambda rows: [np.frombuffer(r[8], np.uint64) for r in rows]
        i, j = similar_pairs(sets(left), None if within else sets(right), i, j, threshold)
        if not len(i):
            return []
        nodes = left if within else [*left, *right]
        j = j if within else j + len(left)
        copies = np.array([r[7] for r in nodes])
        count = np.bincount(i, copies[j], len(nodes)) + np.bincount(j, copies[i], len(nodes))
        root = list(range(len(nodes)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        rid = [r[5] for r in nodes]
        for x, y in zip(i.tolist(), j.tolist()):
            x, y = find(x), find(y)
            if x != y:
                low, high = (x, y) if rid[x] < rid[y] else (y, x)
                root[high] = low
        return [(rid[k], int(count[k]), rid[find(k)]) for k in range(len(nodes)) if count[k]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["rid", "links", "lead"])
        for cell in _cells(batches):
            out += links(cell)
            if len(out) > 10_000:
                yield flush()
                out = []
        if out:
            yield flush()

    return run


def _work(placed: DataFrame, *keys: str) -> DataFrame:
    """(grp, rid, n) to what comparing each group's blocks two by two ships: (grp, docs, blocks, rows shipped)."""
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    return placed.groupBy("grp", *keys).agg(F.count("*").alias("docs"), blocks.alias("blocks")).withColumn("shipped", F.col("docs") * F.col("blocks"))


def candidate_groups(bucketed: DataFrame, sizes: DataFrame) -> DataFrame:
    """(rid, grp, by_band, blocks): the groups within which all pairs of blocks are compared.

    bucketed: (rid, band, lead) of what shares a band; sizes: (rid, n). A connected component of shared bands holds every pair
    once, but unrelated texts may be chained in it; the buckets of its bands hold only what shares one, but a pair up to
    BANDS times. Each component takes the cheaper way, by the rows that its groups' blocks would ship.
    """
    groups = connected_components(bucketed.where("rid <> lead").select(F.col("rid").alias("a"), F.col("lead").alias("b"))).withColumnRenamed("node", "rid")
    whole = materialize(groups.join(sizes, "rid").select(F.col("component").alias("grp"), "rid", "n"), "components")
    work = materialize(_work(whole), "component-work")
    large = work.where("blocks > 1").select(F.col("grp").alias("component"), F.col("shipped").alias("at_once"))
    banded = bucketed.join(whole.select("rid", "n", F.col("grp").alias("component")).join(large, "component"), "rid").select(F.col("band").alias("grp"), "rid", "n", "component")
    banded = materialize(banded, "bands")
    bands = materialize(_work(banded, "component"), "band-work")  # a band is of one component
    split = bands.groupBy("component").agg(F.sum("shipped").alias("by_bands")).join(large, "component").where("by_bands < at_once").select("component")
    split = materialize(split, "split")
    own = whole.join(split, whole["grp"] == split["component"], "left_anti").join(work.select("grp", "blocks"), "grp").select("rid", "grp", F.lit(False).alias("by_band"), "blocks")
    parts = banded.join(split, "component", "left_semi").join(bands.select("grp", "blocks"), "grp").select("rid", "grp", F.lit(True).alias("by_band"), "blocks")
    return own.unionByName(parts)


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE, detail: bool = False) -> DataFrame:
    """One row per input row: (doc_id, class_id, class_size, n_links); with detail also what names the row and its class
    (k1, k2, rid, component).

    Two documents are linked if the Jaccard similarity of their sets of 5-word shingles (A-Z lower-cased) is `threshold`
    or more; n_links counts the linked rows, copies included; class_id is the smallest doc_id that can be reached over links.
    1. Rows with equal shingle sets are one node with a count. 2. MinHash bands; nodes that share a band are candidates, see
    candidate_groups. 3. A group is cut into blocks of bounded size, each pair of blocks is one unit of work, so a group of any
    size spreads over tasks. 4. Units first get signatures alone: MinHash values are compared STEP at a time and a pair is
    dropped when its posterior probability of reaching the threshold falls below `tolerance`. 5. Only what has a pair left
    is sent on with its shingle set, and pairs are verified exactly. Units return sums and a spanning forest, not pairs.
    6. Components of the forest's edges are the classes.

    Counting the links of a group of n texts that are all alike takes n * n comparisons, in n * n / 65536 units.
    Texts that are null, empty or without words have no links. Shorter texts than five words are one shingle. Very long
    texts are read whole. Repeated rows link to each other. Ids may be null or repeated, texts are found again by 128 bits of
    hash; a class of null ids alone has class_id null.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *text_keys(text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = rows.mapInArrow(frugal(_describe), "doc_id long, k1 long, k2 long, set_key binary, n long, bands array<long>").withColumn("rid", F.monotonically_increasing_id())
    base = materialize(base, "shingled")

    texts = base.where("set_key is not null").groupBy("set_key", "k1", "k2").agg(F.min("rid").alias("rid"), F.count("*").alias("same"), F.min("doc_id").alias("least_id"))
    nodes = texts.groupBy("set_key").agg(F.min(F.struct("rid", "k1", "k2", "same")).alias("of"), F.sum("same").alias("copies"), F.min("least_id").alias("least_id"))
    nodes = materialize(nodes.select("set_key", "of.*", "copies", "least_id"), "nodes")
    keyed = base.join(nodes.select("rid"), "rid", "left_semi").select("rid", F.explode("bands").alias("band"))
    buckets = materialize(keyed.groupBy("band").agg(F.min("rid").alias("lead"), F.count("*").alias("n")).where("n > 1").select("band", "lead"), "buckets")
    bucketed = materialize(keyed.join(buckets, "band").select("rid", "band", "lead"), "bucketed")
    groups = materialize(candidate_groups(bucketed, base.select("rid", "n")), "groups")

    members = materialize(nodes.join(bucketed.select("rid").distinct(), "rid").select("rid", "k1", "k2", "same", "copies"), "members")
    one = rows.join(broadcast_if_small(members.where("same = 1"), 60), ["k1", "k2"]).select("rid", "copies", "text")
    more = rows.join(broadcast_if_small(members.where("same > 1"), 60), ["k1", "k2"])
    more = more.groupBy("rid").agg(F.first("copies").alias("copies"), F.first("text").alias("text"))
    sets = materialize(one.unionByName(more).mapInArrow(frugal(_sets), "rid long, copies long, signature binary, items binary"), "sets")

    placed = groups.withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    units = placed.join(sets.select("rid", "signature"), "rid").select("*", other.alias("other"))
    units = units.select("grp", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "by_band", "block", "rid", "signature")
    unit = ["grp", "first", "second"]
    left = units.repartition(*unit).sortWithinPartitions(*unit, "rid").mapInArrow(frugal(_prune(threshold, tolerance)), "grp long, first int, second int, by_band boolean, block int, rid long")
    left = materialize(left, "left")
    again = left.join(sets, "rid").select(*unit, "by_band", "block", "rid", "signature", "copies", "items").repartition(*unit).sortWithinPartitions(*unit, "rid")
    found = materialize(again.mapInArrow(frugal(_verify(threshold, tolerance)), "rid long, links long, lead long"), "links")

    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    classes = connected_components(found.where("rid <> lead").select(F.col("rid").alias("a"), F.col("lead").alias("b"))).withColumnRenamed("node", "rid")
    nodes = nodes.join(links, "rid", "left").join(classes, "rid", "left").select("set_key", F.coalesce("component", "rid").alias("component"), "copies", "least_id", F.coalesce("links", F.lit(0)).alias("links"))
    nodes = materialize(nodes, "classes")
    sums = materialize(nodes.groupBy("component").agg(F.min("least_id").alias("class_id"), F.sum("copies").alias("class_size")), "class-sums")
    known = nodes.join(sums, "component").select("set_key", "component", "class_id", "class_size", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    own = ["k1", "k2", "rid", "component"] if detail else []
    class_id = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return base.join(known, "set_key", "left").select("doc_id", class_id.alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce("n_links", F.lit(0)).alias("n_links"), *own)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class of ngram_jaccard_join, all columns kept: that of the smallest id (nulls last).

    A row is known by its id and 128 bits of hash of its text, so other texts of a repeated id stay; of repeated rows that are
    the class's first, one stays.
    """
    rows = ngram_jaccard_join(docs, id_col, text_col, detail=True).where("class_size > 1").select("component", "doc_id", "k1", "k2", "rid")
    rows = materialize(rows, "near-copies")
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2", "rid")
    best = materialize(rows.groupBy("component").agg(F.min(name).alias("best")), "first-of-class")
    same = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("k1") == F.col("best.k1")) & (F.col("k2") == F.col("best.k2"))
    rows = rows.join(best, "component").select("doc_id", "k1", "k2", same.alias("first"), (F.col("rid") != F.col("best.rid")).alias("again"))
    rows = materialize(rows.where("again").select(F.col("doc_id").alias("gone_id"), F.col("k1").alias("gone_1"), F.col("k2").alias("gone_2"), "first").distinct(), "gone")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), *text_keys(text_col, "_k1", "_k2"))
    named = packed["_id"].eqNullSafe(F.col("gone_id")) & (packed["_k1"] == F.col("gone_1")) & (packed["_k2"] == F.col("gone_2"))
    out = packed.join(broadcast_if_small(rows, 40), named, "left_anti").select("_row")
    again = rows.where("first")
    if again.isEmpty():
        return out.select("_row.*")
    once = packed.join(broadcast_if_small(again, 40), named, "left_semi").dropDuplicates(["_id", "_k1", "_k2"]).select("_row")
    return out.unionByName(once).select("_row.*")
