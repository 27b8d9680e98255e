"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary.

Each task splits its texts with the vocabulary's pattern and looks pieces up in a cache
bounded in bytes. Pieces not in it are encoded together: byte ids in padded matrices, one matrix for
each class of lengths. In every round each row merges its leftmost pair of least rank; pair
ranks come from an open-addressing hash table, the matrix is compacted by one column, and
rows without a mergeable pair leave. Only the vocabulary (of fixed size) is broadcast, and
rows never move between tasks.

Ids travel as `binary`, little-endian unsigned 32-bit, four bytes a token. A null text
encodes as an empty one, null ids decode to no bytes. Texts of any length are encoded whole.
An existing column of the output's name is replaced.
"""

from __future__ import annotations

import base64
import functools
import heapq
import io
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.common import runs_of

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Bytes of pieces and ids that a task keeps, and the longest piece it keeps.
CACHE_BYTES = 16 << 20
CACHED_PIECE = 64
_ENTRY_BYTES = 180
# The longest pieces that go to a matrix: a row of n bytes takes up to n rounds over n columns,
# so beyond this a heap of pairs does the same merges in n log n.
MATRIX_BYTES = 512
# Bytes of text that a round takes, and cells of a matrix: a worker holds some 40 bytes a cell.
ROUND_BYTES = 1 << 19
MATRIX_CELLS = 1 << 18
# Texts of an Arrow batch that are taken out of it at once.
TAKEN_ROWS = 1024
_NONE = np.int32(2**31 - 1)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
# Below U+0250 the classes of the pattern are these ranges, which the faster built-in
# expressions can state; texts with other characters take the pattern as it is.
_LATIN_LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_LATIN_NUMBERS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_LATIN_SPACES = "\t-\r \u0085\u00a0"


def read_ranks(path: str | None = None) -> bytes:
    """The vocabulary file as it is, read by the driver."""
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as file:
        return file.read()


class PairTable:
    """(left id, right id) -> id of the merged token, in an open-addressing table."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = np.uint64(max(4, int(np.ceil(np.log2(len(left) * 4 + 1)))))
        self.mask = np.int64((1 << int(self.bits)) - 1)
        self.keys = np.full(1 << int(self.bits), -1, np.int64)
        self.values = np.full(1 << int(self.bits), _NONE, np.int32)
        keys = left.astype(np.int64) << 32 | right
        slots, waiting = self._slots(keys), np.arange(len(keys))
        while len(waiting):
            free = self.keys[slots[waiting]] == -1
            self.keys[slots[waiting[free]]] = keys[waiting[free]]  # of several, one stays
            won = self.keys[slots[waiting]] == keys[waiting]
            self.values[slots[waiting[won]]] = merged[waiting[won]]
            waiting = waiting[~won]
            slots[waiting] = slots[waiting] + 1 & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * _MULTIPLIER >> np.uint64(64) - self.bits).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        slots = self._slots(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], _NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            slots[open_] = slots[open_] + 1 & self.mask
            found = self.keys[slots[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out.reshape(left.shape)


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """Texts into pieces: the matches of the pattern."""
    import regex

    whole = regex.compile(pattern).findall
    latin = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_LATIN_SPACES}{_LATIN_LETTERS}{_LATIN_NUMBERS}]")
    for name, members in ((r"\p{L}", _LATIN_LETTERS), (r"\p{N}", _LATIN_NUMBERS), (r"\s", _LATIN_SPACES)):
        latin = latin.replace(name, f"[{members}]")
    latin = latin.replace(r"\S", f"[^{_LATIN_SPACES}]")
    if "\\" in latin:  # a class that has no ranges here
        return whole
    quick, other = re.compile(latin).findall, re.compile("[^\0-\u024f]").search
    return lambda text: whole(text) if other(text) else quick(text)


class Vocabulary:
    """Ranks, the table of pairs and the bytes of each id."""

    def __init__(self, ranks_file: bytes, pattern: str):
        # Workers keep a vocabulary as long as they live, so it is built without large detours.
        self.ranks: dict[bytes, int] = {}
        for line in io.BytesIO(ranks_file):
            if parts := line.split():
                self.ranks[base64.b64decode(parts[0])] = int(parts[1])
        self.bytes_of: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        left, right, merged = array("i"), array("i"), array("i")
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
            for i in range(1, len(token)):
                one, other = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if one is not None and other is not None:
                    left.append(one)
                    right.append(other)
                    merged.append(rank)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = PairTable(*(np.frombuffer(column, np.int32) for column in (left, right, merged)))
        self.split = splitter(pattern)
        self.cache: dict[str, bytes] = {}
        self.cached = 0

    def forget(self) -> None:
        """Drop the kept pieces."""
        self.cache.clear()
        self.cached = 0

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        out: list[bytes] = []
        for start, end in runs_of([len(t) for t in texts], ROUND_BYTES):
            pieces = [self.split(text) for text in texts[start:end]]
            missing = list(set().union(*pieces).difference(self.cache))
            codes = self.encode_pieces([p.encode() for p in missing])
            self.cache.update(zip(missing, codes, strict=True))
            out.extend(b"".join(map(self.cache.__getitem__, own)) for own in pieces)
            for piece, code in zip(missing, codes, strict=True):
                if len(piece) > CACHED_PIECE:
                    del self.cache[piece]
                else:
                    self.cached += _ENTRY_BYTES + len(piece) + len(code)
            if self.cached > CACHE_BYTES:
                self.forget()
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece; a piece that is a token is that token."""
        out: list[bytes] = [b""] * len(pieces)
        classes: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            elif len(piece) > MATRIX_BYTES:
                out[i] = self.merge_long(piece)
            else:
                classes.setdefault((len(piece) - 1).bit_length(), []).append(i)
        for bits, members in classes.items():
            width = 1 << bits
            step = max(1, MATRIX_CELLS // width)
            for at in range(0, len(members), step):
                own = members[at : at + step]
                for i, ids in zip(own, self._merge_rows([pieces[i] for i in own], width), strict=True):
                    out[i] = ids
        return out

    def _merge_rows(self, rows: list[bytes], width: int) -> list[bytes]:
        lengths = np.array([len(row) for row in rows], np.int32)
        raw = np.frombuffer(b"".join(row.ljust(width, b"\0") for row in rows), np.uint8).reshape(-1, width)
        ids = self.byte_ids[raw]
        ranks = self.pairs.get(ids[:, :-1], ids[:, 1:])
        ranks[np.arange(width - 1) >= lengths[:, None] - 1] = _NONE
        final, counts, at = ids.copy(), lengths.copy(), np.arange(len(rows))
        while ranks.shape[1]:
            row = np.arange(len(at))
            place = ranks.argmin(1)  # the leftmost of the least
            best = ranks[row, place]
            done = best == _NONE
            if done.any():
                gone = at[done]
                final[gone, : ids.shape[1]], counts[gone] = ids[done], lengths[done]
                at, ids, ranks, place, best, lengths = (x[~done] for x in (at, ids, ranks, place, best, lengths))
                row = row[: len(at)]
                if not len(at):
                    break
            ids[row, place] = best
            lengths = lengths - 1
            keep = np.ones(ids.shape, bool)
            keep[row, place + 1] = False
            ids = ids[keep].reshape(len(at), -1)
            keep = np.ones(ranks.shape, bool)
            keep[row, place] = False
            ranks = ranks[keep].reshape(len(at), -1)
            for side in (place - 1, place):
                own = np.flatnonzero((side >= 0) & (side < ranks.shape[1]))
                at_side = side[own]
                fresh = self.pairs.get(ids[own, at_side], ids[own, at_side + 1])
                fresh[at_side >= lengths[own] - 1] = _NONE
                ranks[own, at_side] = fresh
        final[at, : ids.shape[1]], counts[at] = ids, lengths
        flat = final[np.arange(width) < counts[:, None]].astype("<u4").tobytes()
        ends = (np.cumsum(counts) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def merge_long(self, piece: bytes) -> bytes:
        """The same merges for a piece of any length, by a heap of (rank, place)."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        first = self.pairs.get(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(rank, i) for i, rank in enumerate(first) if rank != _NONE]
        heapq.heapify(heap)
        get, join, known = self.ranks.get, self.bytes_of, first + [int(_NONE)]

        def renew(i: int) -> None:
            rank = None
            if i >= 0 and after[i] < len(ids):
                rank = get(join[ids[i]] + join[ids[after[i]]])
            if i >= 0:
                known[i] = int(_NONE) if rank is None else rank
                if rank is not None:
                    heapq.heappush(heap, (rank, i))

        while heap:
            rank, i = heapq.heappop(heap)
            if ids[i] is None or known[i] != rank:
                continue
            gone = after[i]
            ids[i], ids[gone], known[gone] = rank, None, int(_NONE)
            after[i] = after[gone]
            if after[i] < len(ids):
                before[after[i]] = i
            renew(i)
            renew(before[i])
        return np.array([x for x in ids if x is not None], "<u4").tobytes()

    def decode(self, ids: bytes | None) -> bytes:
        if not ids:
            return b""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def vocabulary(ranks_file: bytes, pattern: str) -> Vocabulary:
    """Built once in each Python worker."""
    return Vocabulary(ranks_file, pattern)


def tokenizer(
    spark: SparkSession, path: str | None = None, pattern: str = public_tokenizers.PATTERN
) -> tuple[Callable, Callable]:
    """(encode, decode) as functions of columns: text to packed ids, packed ids to bytes."""
    ranks = spark.sparkContext.broadcast(read_ranks(path))

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        own = vocabulary(ranks.value, pattern)
        return pa.array(own.encode_batch(["" if t is None else t for t in texts.to_pylist()]), pa.binary())

    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        own = vocabulary(ranks.value, pattern)
        return pa.array([own.decode(x) for x in ids.to_pylist()], pa.binary())

    return encode, decode


def code_texts(docs: DataFrame, text: str = "text", output: str = "coded", path: str | None = None, keep_decoded: bool = True) -> DataFrame:
    """All rows with a struct of the packed ids of `text`, what they decode to (if kept) and
    whether that is the text. Both directions run in one pass over a batch, and a task forgets
    the pieces it has met when its rows end."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    pattern = public_tokenizers.PATTERN
    names = ["ids", *(["decoded"] if keep_decoded else []), "same"]
    kinds = {"ids": "binary", "decoded": "binary", "same": "boolean"}

    @F.arrow_udf(", ".join(f"{n} {kinds[n]}" for n in names))
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = vocabulary(ranks.value, pattern)
        try:
            for batch in batches:
                ids, decoded, same = [], [], []
                for at in range(0, len(batch), TAKEN_ROWS):
                    texts = ["" if t is None else t for t in batch.slice(at, TAKEN_ROWS).to_pylist()]
                    for text, packed in zip(texts, own.encode_batch(texts), strict=True):
                        raw = own.decode(packed)
                        ids.append(packed)
                        same.append(raw == text.encode())
                        if keep_decoded:
                            decoded.append(raw)
                columns = {"ids": pa.array(ids, pa.binary()), "decoded": pa.array(decoded, pa.binary()), "same": pa.array(same, pa.bool_())}
                yield pa.StructArray.from_arrays([columns[n] for n in names], names)
        finally:
            own.forget()
            pa.default_memory_pool().release_unused()

    return docs.withColumn(output, code(F.col(text).cast("string")))


def encode_texts(docs: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """All rows with the packed ids of `text` in column `ids`."""
    encode, _ = tokenizer(docs.sparkSession, path)
    return docs.withColumn(ids, encode(F.col(text).cast("string")))


def decode_ids(docs: DataFrame, ids: str = "ids", output: str = "decoded", path: str | None = None) -> DataFrame:
    """All rows with the bytes that the packed ids stand for in column `output`."""
    _, decode = tokenizer(docs.sparkSession, path)
    return docs.withColumn(output, decode(F.col(ids).cast("binary")))
