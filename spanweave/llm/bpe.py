"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .common import frugal, portions, small_batches

#: Distinct pieces whose ids a Python worker remembers; beyond it the memory starts anew. Changes no result.
CACHE_PIECES = 200_000
#: Pieces that go through the model at a time.
PIECES = 5_000

# The pattern that the shorter ways below are for; any other takes none of them.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The pattern's parts for texts of ASCII and Latin-1 letters alone, where re agrees with the Unicode classes.
_PLAIN = re.compile(r"[^\x00-\x1b\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]")
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
# White space as Unicode has it; the regex module's \s also takes U+001C to U+001F.
_SPACE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_EDGE = re.compile(rf"[{_SPACE}] |  | [{_SPACE}]|^ | $")


@lru_cache(None)
def _full(pattern: str) -> regex.Pattern:
    return regex.compile(pattern.replace(r"[^\s\p", rf"[^{_SPACE}\p").replace(r"(?!\S)", rf"(?![^{_SPACE}])").replace(r"\s", f"[{_SPACE}]"))


def byte_table() -> dict[int, str]:
    """Each byte's printable character: Latin-1's visible characters stand for themselves, the others follow from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in visible}
    rest = [b for b in range(256) if b not in table]
    return table | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_ranks(ranks_path: str) -> dict[bytes, int]:
    with open(ranks_path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Decoder:
    """The bytes of each id, by way of the characters that stand for them."""

    def __init__(self, ranks: dict[bytes, int]):
        table = byte_table()
        back = {c: b for b, c in table.items()}
        size = max(ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            shown = "".join(map(table.__getitem__, token))
            tokens[rank] = bytes(map(back.__getitem__, shown))  # the byte table, reversed
        self.lengths = np.fromiter(map(len, tokens), np.int64, size)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows' ids in a row, and where each row's bytes end (ends: where its ids end, from 0)."""
        n = self.lengths[ids]
        stop = np.cumsum(n)
        out = self.flat[np.repeat(self.starts[ids] - (stop - n), n) + np.arange(int(n.sum()))]
        return out, np.concatenate([[0], stop])[ends]


class Codec(Decoder):
    """Ranks of byte strings as a tokenizers BPE model: every way to split a token into two tokens is a merge of its rank."""

    def __init__(self, ranks_path: str, pattern: str):
        from tokenizers import Tokenizer, models

        ranks = read_ranks(ranks_path)
        super().__init__(ranks)
        self.usual = pattern == PATTERN
        self.pattern = _full(pattern) if self.usual else regex.compile(pattern)
        self.chars = byte_table()
        self.ascii = {b: c for b, c in self.chars.items() if b < 128}
        shown = {token: "".join(map(self.chars.__getitem__, token)) for token in ranks}
        merges = []
        for token in sorted(ranks, key=ranks.get):
            cuts = [(ranks[token[:i]], ranks[token[i:]], i) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
            merges += [(shown[token[:i]], shown[token[i:]]) for _, _, i in sorted(cuts)]
        self.model = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, cache_capacity=0))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.at = np.zeros(1 << 16, np.int64)
        self.n = np.zeros(1 << 16, np.int64)
        self.ids, self.used = np.zeros(1 << 18, np.int32), 0

    def _split(self, text: str) -> list[str]:
        if not self.usual:
            return [m.group() for m in self.pattern.finditer(text)]
        return (self.pattern if _PLAIN.search(text) else _FAST).findall(text)

    def _chunks(self, text: str) -> list[str]:
        """Parts that begin at single spaces within visible text; no match of the usual pattern crosses such a place. Else its matches."""
        if not self.usual or _EDGE.search(text):
            return self._split(text)
        head, *rest = text.split(" ")
        return [head, *[" " + x for x in rest]] if head or rest else []

    def encode_new(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks in a row and where each one's end, from 0; their pieces go through the model together, each on its own."""
        pieces = [self._split(chunk) for chunk in new] if self.usual else [[chunk] for chunk in new]
        shown = [piece.translate(self.ascii) if piece.isascii() else "".join(map(self.chars.__getitem__, piece.encode())) for own in pieces for piece in own]
        if not shown:
            return np.zeros(0, np.int32), np.zeros(len(new) + 1, np.int64)
        all_ids, all_counts = [], []
        for a in range(0, len(shown), PIECES):
            coded = self.model.encode(shown[a : a + PIECES], is_pretokenized=True, add_special_tokens=False)
            all_ids.append(np.asarray(coded.ids, np.int32))
            all_counts.append(np.bincount(np.asarray(coded.word_ids, np.int64), minlength=len(shown[a : a + PIECES])))
        ids, per_piece = np.concatenate(all_ids), np.concatenate(all_counts)
        ends = np.cumsum(np.concatenate([[0], per_piece]))
        return ids, ends[np.cumsum([0, *map(len, pieces)])]

    def _learn(self, new: list[str]) -> None:
        ids, cuts = self.encode_new(new)
        first = len(self.known)
        for i, chunk in enumerate(new):
            self.known[chunk] = first + i
        while len(self.at) < first + len(new):
            self.at, self.n = np.concatenate([self.at, self.at]), np.concatenate([self.n, self.n])
        while len(self.ids) < self.used + len(ids):
            self.ids = np.concatenate([self.ids, self.ids])
        self.ids[self.used : self.used + len(ids)] = ids
        self.at[first : first + len(new)] = self.used + cuts[:-1]
        self.n[first : first + len(new)] = np.diff(cuts)
        self.used += len(ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids end."""
        if len(self.known) > CACHE_PIECES:
            self._forget()
        chunks = [self._chunks(text) for text in texts]
        new = list(dict.fromkeys(c for own in chunks for c in own if c not in self.known))
        if new:
            self._learn(new)
        where = np.fromiter((self.known[c] for own in chunks for c in own), np.int64, sum(map(len, chunks)))
        n = self.n[where]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(self.at[where] - (ends - n), n) + np.arange(int(n.sum()))]
        text_ends = np.concatenate([[0], ends])[np.cumsum([0, *map(len, chunks)])]
        return ids, text_ends

    def offsets(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters [from, to) that each token touches; a character split over tokens belongs to each of them."""
        data, byte_ends = self.decode(ids, ends)
        leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters begun before each byte
        n = self.lengths[ids]
        stop = np.cumsum(n)
        row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        base = leads[byte_ends[:-1]][row] if len(row) else np.zeros(0, np.int64)
        start = leads[stop - n] - base
        inside = (data[np.minimum(stop - n, max(len(data) - 1, 0))] & 0xC0) == 0x80 if len(data) else np.zeros(0, bool)
        return start - inside, leads[stop] - base


@lru_cache(2)
def codec(ranks_path: str, pattern: str) -> Codec:
    """One for each Python worker."""
    return Codec(ranks_path, pattern)


@lru_cache(2)
def decoder(ranks_path: str) -> Decoder:
    return Decoder(read_ranks(ranks_path))


_IDS = T.ArrayType(T.IntegerType(), False)


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False, decoded: bool = False) -> DataFrame:
    """(id, ids array<int>) of whole texts, in the id column's type; with offsets also starts and ends array<int>, the
    character offsets of each token; with decoded also the bytes that the ids decode to, made in the same pass.

    Each match of the pattern is encoded on its own by the tokenizers library's BPE; equal pieces of a batch are encoded
    once. No special tokens: their strings are ordinary text. Null text counts as empty, an empty text has no ids; very long
    texts need memory for their own ids only. Repeated rows give repeated rows; an empty table gives an empty result.
    ranks_path must be readable where the executors run (a local file of each machine, as an installed package has).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(ranks_path, pattern)
        for batch in batches:
            for a, b in portions(pc.binary_length(batch.column(1)).to_pylist()):
                ids, ends = coder.encode(batch.column(1).slice(a, b - a).to_pylist())
                columns = [batch.column(0).slice(a, b - a), _lists(ids, ends)]
                if offsets:
                    columns += [_lists(x.astype(np.int32), ends) for x in coder.offsets(ids, ends)]
                if decoded:
                    columns.append(_binaries(*coder.decode(ids, ends)))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    small_batches(docs.sparkSession)
    names = ["doc_id", "ids", *["starts", "ends"] * offsets, *["decoded"] * decoded]
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType)] + [T.StructField(n, T.BinaryType() if n == "decoded" else _IDS) for n in names[1:]])
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(frugal(run), schema)


def bpe_decode(coded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids", keep: tuple[str, ...] = (), keep_ids: bool = False) -> DataFrame:
    """(id, *keep, ids if asked, decoded binary): the bytes of the ids. Tokens may split characters, so bytes are put together before
    any reading as UTF-8. Null ids count as none; an id outside the vocabulary fails the job. Empty table, empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = decoder(ranks_path)
        for batch in batches:
            lists = batch.column(1)
            counts = np.diff(lists.offsets.to_numpy()) if len(batch) else np.zeros(0, np.int64)
            for a, b in portions(counts.tolist()):
                part = lists.slice(a, b - a)
                ids = part.flatten().to_numpy(zero_copy_only=False)
                data, cuts = coder.decode(ids, np.concatenate([[0], np.cumsum(counts[a:b])]))
                decoded = _binaries(data, cuts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *[batch.column(2 + i).slice(a, b - a) for i in range(len(keep))], *[part] * keep_ids, decoded], names=names)

    names = ["doc_id", *keep, *["ids"] * keep_ids, "decoded"]
    fields = [T.StructField("doc_id", coded.schema[id_col].dataType), *[coded.schema[c] for c in keep], *[T.StructField("ids", _IDS)] * keep_ids, T.StructField("decoded", T.BinaryType())]
    none = F.array().cast("array<int>")
    return coded.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), none).alias("ids"), *keep).mapInArrow(frugal(run), T.StructType(fields))


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


def _binaries(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
