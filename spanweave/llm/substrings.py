"""Substring deduplication: suffixes in prefix partitions, a suffix tree for each, deep internal nodes as maximal repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import BROADCAST_BYTES, frugal, materialize, portions, text_keys
from .jaccard import mix, rolling, word_hashes

#: Words of a window.
WINDOW = 35
#: Words of an anchor, the run whose repetition any repeated window must contain.
ANCHOR = 8
#: Places of an anchor that make one group, about (each of some 500 bytes); beyond it they are salted over several groups.
GROUP_PLACES = 4096
#: Window starts whose anchors are found at a time, and places whose trees are built at a time.
STARTS, PLACES = 1 << 20, 20_000


def anchors(hashes: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> np.ndarray:
    """Anchor position of each window start: that of the smallest ANCHOR-gram within the window, the first of equal ones.

    Equal windows have their anchor at the same place, as it depends on their words alone. Made in parts, so any length will do.
    """
    span, out = window - anchor + 1, []
    bits = np.uint64((2 * STARTS).bit_length())
    for a in range(0, len(hashes) - window + 1, STARTS):
        part = hashes[a : a + STARTS + window - 1]
        grams = rolling(part, anchor)
        least = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        starts = len(part) - window + 1
        least = np.minimum(least[:starts], least[span - width : span - width + starts])
        out.append((least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64) + a)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def row_hashes(words: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row."""
    out = np.zeros(len(words), np.uint64)
    for column in words.T:
        out = mix(out + column)
    return out


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _anchor_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(k1, k2, text) to the anchors of the texts that have a window."""
        for batch in batches:
            for a, b in portions(pc.binary_length(batch.column(2)).to_pylist()):
                part, rows = batch.slice(a, b - a), []
                for i, text in enumerate(part.column(2).to_pylist()):
                    words = _words(text)
                    if len(words) >= window:
                        h = word_hashes(words)
                        p = np.unique(anchors(h, window))
                        rows.append((i, len(words), p.astype(np.int32), rolling(h, ANCHOR)[p].view(np.int64)))
                if rows:
                    at, n, places, hashes = zip(*rows)
                    ends = pa.array(np.cumsum([0, *map(len, places)]).astype(np.int32))
                    own = part.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(places))), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(hashes)))], names=["k1", "k2", "n_words", "places", "hashes"])

    return run


def _around(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(rid, places, salts, text) to each place of an anchor, with the hashes of the words of all windows that have it.

        Their starts run from lo to hi; the words from lo to the end of the last window. Salts: over how many groups the anchor goes.
        """
        for batch in batches:
            for rid, places, salts, text in zip(*(c.to_pylist() for c in batch.columns)):
                h = word_hashes(_words(text))
                at = anchors(h, window)
                grams = rolling(h, ANCHOR).view(np.int64)
                over = np.zeros(len(h), np.int64)
                over[places] = salts
                first = np.nonzero(np.diff(at, prepend=-1))[0]
                last = np.append(first[1:], len(at)) - 1
                mine = over[at[first]] > 0
                first, last = first[mine], last[mine]
                for a in range(0, len(first), 5000):
                    lo, hi = first[a : a + 5000], last[a : a + 5000]
                    place = at[lo]
                    n = hi - lo + window
                    ends = np.cumsum(n)
                    flat = h[np.repeat(lo - (ends - n), n) + np.arange(int(ends[-1]))]
                    data = pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer((8 * np.concatenate([[0], ends])).astype(np.int32)), pa.py_buffer(flat)])
                    salt = mix(place.astype(np.uint64) + (np.uint64(rid) << np.uint64(24))) % over[place].astype(np.uint64)
                    columns = [grams[place], salt.astype(np.int32), over[place] > 1, np.full(len(lo), rid), place.astype(np.int32), lo.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), data], names=["hash", "salt", "salted", "rid", "place", "lo", "words"])

    return run


def descend(node: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """One level of the trees: each string's node below `node` by its next letter; -1 once a string is alone (a leaf's edge)."""
    out = np.full(len(node), -1, np.int64)
    live = np.nonzero(node >= 0)[0]
    if len(live):
        live = live[np.lexsort((letter[live], node[live]))]
        new = np.empty(len(live), bool)
        new[0] = True
        new[1:] = (node[live[1:]] != node[live[:-1]]) | (letter[live[1:]] != letter[live[:-1]])
        number = np.cumsum(new) - 1
        out[live] = np.where(np.bincount(number)[number] > 1, number, -1)
    return out


def deep_nodes(group: np.ndarray, salt: np.ndarray, place: np.ndarray, lo: np.ndarray, words: np.ndarray, ends: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """[places, offsets]: the internal node of the window's depth that the suffix from `offset` words before the place hangs below.

    -1: none, the suffix is alone there; -2: no window. words[ends[i]:ends[i + 1]] are those of place i from lo[i] on; places
    of a group have the anchor's words in common. A suffix's prefix goes from its start to the end of its anchor; below it
    the tree goes down one word a level. Suffixes of a group share the words right of the anchor, so those levels are made
    once for all offsets, and the words left of it likewise; the node at the window's depth is the pair of both.
    """
    left, right = window - ANCHOR, window
    n, before = np.diff(ends), place - lo
    where = before[:, None] + np.arange(-left, right)
    there = (where >= 0) & (where < n[:, None])
    letter = words[np.where(there, where + ends[:-1, None], 0)]
    root = descend(descend(np.zeros(len(group), np.int64), group), salt)
    lefts, rights = [root], {}
    for o in range(1, left + 1):
        lefts.append(descend(np.where(there[:, left - o], lefts[-1], -1), letter[:, left - o]))
    node = root
    for r in range(right):
        node = descend(np.where(there[:, left + r], node, -1), letter[:, left + r])
        rights[r + 1] = node
    out = np.full((len(group), left + 1), -2, np.int64)
    last = before + window - n  # the smallest offset of a start
    for o in range(left + 1):
        own = (o <= before) & (o >= last)
        out[own, o] = -1
        own = np.nonzero(own & (lefts[o] >= 0) & (rights[window - o] >= 0))[0]
        out[own, o] = descend(lefts[o][own], rights[window - o][own])
    return out


def _trees(window: int):
    left = window - ANCHOR

    def settle(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows).combine_chunks()
        group, salt, salted, rid, place, lo = (table.column(i).to_numpy().astype(np.int64) for i in range(6))
        words = np.frombuffer(b"".join(table.column(6).to_pylist()), np.uint64)
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(table.column(6)).to_numpy() // 8)]).astype(np.int64)
        nodes = deep_nodes(group, salt, place, lo, words, ends, window)
        again = (nodes >= 0)[:, ::-1]  # by start, ascending
        edge = np.diff(np.pad(again.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        (i, a), (_, b) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        yield emit(rid[i], place[i] - left + a, place[i] - left + b, np.zeros(len(i)))
        own = np.nonzero(salted)[0]
        if len(own):
            alone = np.nonzero(nodes[own] == -1)
            stand = [(own[i], np.full(len(i), o)) for o in range(left + 1) for seen, i in [np.unique(nodes[own, o], return_index=True)] for i in [i[seen >= 0]]]
            for state, (i, o) in ((1, (own[alone[0]], alone[1])), (2, tuple(map(np.concatenate, zip(*stand))))):
                at = (ends[i] + place[i] - o - lo[i])[:, None] + np.arange(window)
                k1, k2 = (row_hashes(words[x]).view(np.int64) for x in (at[:, : window // 2], at[:, window // 2 :]))
                yield emit(rid[i], place[i] - o, place[i] - o + 1, np.full(len(i), state), k1, k2)

    def emit(rid, start, stop, state, k1=None, k2=None) -> pa.RecordBatch:
        keys = [pa.nulls(len(rid), pa.int64()) if k is None else pa.array(k) for k in (k1, k2)]
        return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(state.astype(np.int8)), *keys], names=["rid", "from", "to", "state", "k1", "k2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(hash, salt, salted, rid, place, lo, words) sorted by hash and salt to the repeated starts [from, to) of each place.

        Whole groups at a time. State 0: repeated. Of salted groups also: 1, a start that is alone in its group, and 2, one
        that stands for a node, both with 128 bits of hash of the window.
        """
        held, n, end = [], 0, None
        for batch in batches:
            if not len(batch):
                continue
            keys = [batch.column(i).to_numpy() for i in (0, 1)]
            cuts = np.concatenate([[0], np.nonzero((np.diff(keys[0]) != 0) | (np.diff(keys[1]) != 0))[0] + 1, [len(batch)]])
            if n >= PLACES and (keys[0][0], keys[1][0]) != end:
                yield from settle(held)
                held, n = [], 0
            at, end = 0, (keys[0][-1], keys[1][-1])
            while at < len(batch):
                room = max(at + 1, at + PLACES - n)
                cut = int(cuts[np.searchsorted(cuts, min(room, len(batch)))])  # where a group ends
                held.append(batch.slice(at, cut - at))
                n += cut - at
                at = cut
                if n >= PLACES and at < len(batch):
                    yield from settle(held)
                    held, n = [], 0
        if held:
            yield from settle(held)

    return run


def _ranges(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Repeated starts [from, to) of a text to its maximal repeats, the word ranges [start, stop) that they cover."""
        for batch in batches:
            out = []
            for rid, runs in zip(batch.column(0).to_pylist(), batch.column(1)):
                a, b = (runs.values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order] + window - 1)
                new = np.nonzero(np.concatenate([[True], a[1:] > b[:-1]]))[0]
                out.append((rid, a[new].tolist(), b[np.append(new[1:], len(a)) - 1].tolist()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())))], names=["rid", "starts", "stops"])

    return run


def _sized(df: DataFrame, row_bytes: Column, limit: int) -> DataFrame:
    """A broadcast hint if the table's rows, by the given measure, are few enough bytes."""
    total = df.agg(F.sum(row_bytes)).first()[0] or 0
    return F.broadcast(df) if total <= limit else df


def _keyed(docs: DataFrame, text_col: str, *own: Column) -> DataFrame:
    """Texts under their keys: equal texts have equal repeats, whatever their ids."""
    return docs.select(*text_keys(text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *own)


def repeated_ranges(docs: DataFrame, text_col: str = "text", window: int = WINDOW, group_places: int = GROUP_PLACES, limit: int = 2 * BROADCAST_BYTES) -> DataFrame:
    """(k1, k2, starts, stops): the word ranges to remove, one row per distinct text that has some. See drop_repeats.

    limit: bytes of a table that may be broadcast; beyond it both sides are shuffled.
    """
    if not ANCHOR < window:
        raise ValueError(f"a window has more than {ANCHOR} words")
    rows = _keyed(docs, text_col)
    base = rows.mapInArrow(frugal(_anchor_rows(window)), "k1 long, k2 long, n_words long, places array<int>, hashes array<long>")
    base = materialize(base.withColumn("rid", F.monotonically_increasing_id()), "anchors")
    texts = materialize(base.groupBy("k1", "k2").agg(F.min("rid").alias("rid"), F.count("*").alias("copies"), F.min("n_words").alias("n_words")), "texts")

    first = base.join(texts.select("rid"), "rid", "left_semi")
    places = first.select("rid", F.explode(F.arrays_zip("hashes", "places")).alias("a")).select("rid", F.col("a.hashes").alias("hash"), F.col("a.places").alias("place"))
    again = materialize(places.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"), "repeated-anchors")  # written, so that a hot anchor's join can be split
    salts = F.ceil(F.col("n") / group_places).cast("int").alias("salts")
    marks = places.join(again, "hash").groupBy("rid").agg(F.collect_list(F.struct("place", salts)).alias("m"))  # a text's anchors, fewer than its words
    own = ["rid", "k1", "k2", "copies", F.col("m.place").alias("places"), F.col("m.salts").alias("salts")]
    marks = materialize(marks.join(texts, "rid").select(*own), "candidates")
    size = F.size("places") * 8 + 64
    one = rows.join(_sized(marks.where("copies = 1"), size, limit), ["k1", "k2"]).select("rid", "places", "salts", "text")
    more = rows.join(_sized(marks.where("copies > 1"), size, limit), ["k1", "k2"])
    found = one.unionByName(more.groupBy("rid").agg(*[F.first(c).alias(c) for c in ("places", "salts", "text")]))

    around = found.mapInArrow(frugal(_around(window)), "hash long, salt int, salted boolean, rid long, place int, lo int, words binary")
    around = around.repartition("hash", "salt").sortWithinPartitions("hash", "salt")
    trees = materialize(around.mapInArrow(frugal(_trees(window)), "rid long, from int, to int, state tinyint, k1 long, k2 long"), "repeats")
    across = trees.where("state > 0").groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select("k1", "k2")
    across = materialize(across, "across-salts")
    runs = trees.where("state = 0").unionByName(trees.where("state = 1").join(across, ["k1", "k2"]), allowMissingColumns=True).select("rid", "from", "to")
    ranges = runs.groupBy("rid").agg(F.collect_list(F.struct("from", "to")).alias("runs")).mapInArrow(frugal(_ranges(window)), "rid long, starts array<int>, stops array<int>")

    ranges = texts.join(ranges, "rid", "left").where("copies > 1 or starts is not null")
    own = F.col("copies") > 1  # a copied text repeats from its first window to its last
    return ranges.select("k1", "k2", F.when(own, F.array(F.lit(0))).otherwise(F.col("starts")).alias("starts"), F.when(own, F.array(F.col("n_words").cast("int"))).otherwise(F.col("stops")).alias("stops"))


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in portions(pc.binary_length(batch.column(1)).to_pylist()):
            part = batch.slice(a, b - a)
            kept, counts, removed = [], [], []
            for text, starts, stops in zip(*(part.column(i).to_pylist() for i in (1, 2, 3))):
                words = _words(text)
                left = words
                if starts:
                    left, end = [], 0
                    for x, y in zip(starts, stops):
                        left += words[end:x]
                        end = y
                    left += words[end:]
                kept.append(b" ".join(left))
                counts.append(len(words))
                removed.append(len(words) - len(left))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, group_places: int = GROUP_PLACES, limit: int = 2 * BROADCAST_BYTES) -> DataFrame:
    """One row per input row: (doc_id, n_words, n_removed, kept): the words outside any repeated window, joined by one space.

    A window is `window` consecutive words of one document; it is repeated if its words also start anywhere else, in the
    same document too. All windows are judged on the input.
    1. Equal texts are one text with a count; if it is over one, all its windows repeat. 2. A window's anchor is its
    smallest 8-word run; only suffixes whose anchor occurs twice are followed. 3. A suffix's prefix is what goes from its start to
    the end of its anchor, so prefixes vary in length, and suffixes are dealt out by the anchor. The places of each anchor are
    counted; where they are more than `group_places`, they are salted over several groups. 4. Each group is a suffix tree,
    built a word a level from its prefixes; an internal node of the window's depth is a repeat. What is alone in a salted
    group is looked up among the other groups' nodes. 5. Repeated starts become the maximal repeats of their text, which the last scan of the texts leaves out.

    Words are compared by 64 bits of hash each. Null or empty texts have no words and keep the empty text; texts shorter than a
    window stay whole. Very long texts are read whole. Repeated rows are copies, so all windows of both go. Ids may be null
    or repeated: texts are found again by their hash. Other columns of docs are ignored. Empty table, empty result.
    """
    ranges = materialize(repeated_ranges(docs, text_col, window, group_places, limit), "ranges")
    ranges = _sized(ranges, 8 * F.size("starts") + 64, limit)
    joined = _keyed(docs, text_col, F.col(id_col).alias("doc_id")).join(ranges, ["k1", "k2"], "left").select("doc_id", "text", "starts", "stops")
    kind = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(frugal(_drop), f"doc_id {kind}, n_words long, n_removed long, kept string")
