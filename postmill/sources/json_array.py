"""JSON arrays of any size, read by as many tasks as a file has splits.

The text reader cuts files at every closing brace, so a file on one line splits like any other.
What a split holds depends on where it starts: outside strings, in one, or behind a backslash in
one, and how deep. A first pass sums each split up for all three starts (where it ends, how the
depth changes, at which depths elements close); folding one such row a split, file by file, tells
how every split starts. A second pass then cuts elements out; an element that crosses splits
leaves a piece in each, which meet under the split where it began.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill import runtime

OUTSIDE, INSIDE, ESCAPED = range(3)
_QUOTE, _BACKSLASH, _SPACE = 34, 92, b" \t\r\n"
_BLOCK = ["file", "block"]


def _table(*marks: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(m) for m in marks]] = True
    return table


_MARKS, _CLOSING = _table('"', "\\", "{", "}", "[", "]"), _table("}", "]")


class Brackets:
    """The brackets of a text outside its strings. What does not depend on the state in which
    the text starts is found once, and only quotes, backslashes and brackets are looked at."""

    def __init__(self, raw: bytes):
        text = np.frombuffer(raw, np.uint8)
        at = np.flatnonzero(_MARKS[text])
        kind = text[at]
        quotes, slashes = at[kind == _QUOTE], at[kind == _BACKSLASH]
        self._at = at[(kind != _QUOTE) & (kind != _BACKSLASH)]
        self._closes = _CLOSING[text[self._at]]
        if len(slashes):
            first = np.r_[True, np.diff(slashes) != 1]
            run = np.maximum.accumulate(np.where(first, slashes, 0))  # where its run begins
            last = np.searchsorted(slashes, quotes) - 1
            behind = (last >= 0) & (slashes[last] == quotes - 1)
            begin = np.where(behind, run[last], quotes)
            ends_behind = slashes[-1] == len(text) - 1
            self._end = int(run[-1]) if ends_behind else len(text)
        else:
            begin, self._end = quotes, len(text)
        self._size = len(text)
        self._quotes, self._escaped = quotes, (quotes - begin) % 2 == 1
        # A backslash before the text turns the first run, or the first byte, around.
        self._first = begin == 0

    def outside(self, state: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(places, whether they close, depth behind each counted from the start, the state
        behind the last byte) of the brackets, if the text starts in a state."""
        escaped = self._escaped ^ self._first if state == ESCAPED else self._escaped
        quotes = self._quotes[~escaped]
        started = state != OUTSIDE
        free = (np.searchsorted(quotes, self._at) + started) % 2 == 0
        places, closes = self._at[free], self._closes[free]
        inside = (len(quotes) + started) % 2 == 1
        behind = (self._size - self._end + (state == ESCAPED and self._end == 0)) % 2 == 1
        end = (ESCAPED if behind else INSIDE) if inside else OUTSIDE
        return places, closes, np.cumsum(1 - 2 * closes.astype(np.int64)), end


def scan(raw: bytes, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(depth after each byte, counted from the start; whether the byte closes a bracket; the
    state behind the last byte) of text that starts in a state."""
    places, closes, _, end = Brackets(raw).outside(state)
    step, closing = np.zeros(len(raw), np.int64), np.zeros(len(raw), bool)
    step[places], closing[places] = 1 - 2 * closes.astype(np.int64), closes
    return np.cumsum(step), closing, end


class Split:
    """The sum of a split for each state that it may start in."""

    def __init__(self) -> None:
        self.now = [OUTSIDE, INSIDE, ESCAPED]
        self.depth = [0, 0, 0]
        self.landings: list[set[int]] = [set(), set(), set()]
        self.size, self.first = 0, 0

    def add(self, raw: bytes) -> None:
        self.size += len(raw)
        self.first = self.first or (raw.lstrip(_SPACE)[:1] or b"\0")[0]
        brackets = Brackets(raw)
        summed = {}
        for state in set(self.now):
            _, closes, depth, end = brackets.outside(state)
            summed[state] = np.unique(depth[closes]), int(depth[-1]) if len(depth) else 0, end
        for start in range(3):
            landings, depth, end = summed[self.now[start]]
            self.landings[start].update((landings + self.depth[start]).tolist())
            self.depth[start] += depth
            self.now[start] = end


_SUMS = pa.schema([
    ("file", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("first", pa.int32()),
    ("ends", pa.list_(pa.int32())), ("depths", pa.list_(pa.int64())), ("landings", pa.list_(pa.list_(pa.int64()))),
])


def _joined(fragments: pa.Array) -> bytes:
    return b"}".join(fragments.to_pylist()) + b"}"


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The rows of each split, in order."""
    files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
    start = 0
    for i in range(1, len(files) + 1):
        if i == len(files) or (files[i], blocks[i]) != (files[start], blocks[start]):
            yield (files[start], blocks[start]), batch.slice(start, i - start)
            start = i


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, split = None, Split()

    def row():
        columns = (*key, split.size, split.first, split.now, split.depth, [sorted(x) for x in split.landings])
        return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(columns, _SUMS, strict=True)], schema=_SUMS)

    for batch in batches:
        for own, rows in _runs(batch):
            if own != key:
                if key:
                    yield row()
                key, split = own, Split()
            split.add(_joined(rows.column("value")))
    if key:
        yield row()


_STARTS_SQL = "file string, block long, state long, depth long, base long, before long, began long"


def _starts(table: pa.Table) -> pa.Table:
    """How each split of one file starts; one row a split."""
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    first = next((r["first"] for r in rows if r["first"]), 0)
    base = int(first == ord("["))  # depth at which elements stand
    state, depth, before, began, out = OUTSIDE, 0, 0, -1, []
    for row in rows:
        out.append({"file": row["file"], "block": row["block"], "state": state, "depth": depth, "base": base, "before": before, "began": began})
        if base - depth in row["landings"][state]:
            began = row["block"]
        state, depth = row["ends"][state], depth + row["depths"][state]
        before += row["size"]
    return pa.Table.from_pylist(out)


_PIECES = pa.schema([("file", pa.string()), ("began", pa.int64()), ("block", pa.int64()), ("whole", pa.bool_()), ("text", pa.binary())])
_PIECES_SQL = "file string, began long, block long, whole boolean, text binary"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements that begin and end in a split (`whole`), and pieces of the others under the
    split in which they begin, -1 for the text before the first element of a file."""
    key, state, depth, open_, began, before = None, OUTSIDE, 0, [], -1, 0
    for batch in batches:
        out = []
        for own, rows in _runs(batch):
            start = rows.slice(0, 1).to_pylist()[0]
            if own != key:
                if key and open_:
                    out.append((key[0], began, key[1], False, b"".join(open_)))
                key, open_ = own, []
                state, depth, began, before = start["state"], start["depth"], start["began"], start["before"]
            raw = _joined(rows.column("value"))
            before += len(raw)
            if before > start["size"]:  # the reader ends the last text of a file without a brace
                raw = raw[:-1]
            if not raw:
                continue
            places, closes, depths, state = Brackets(raw).outside(state)
            at = 0
            for end in (places[closes & (depths + depth == start["base"])] + 1).tolist():
                text, at = raw[at:end], end
                out.append((key[0], began, key[1], began == key[1], b"".join((*open_, text))))
                began, open_ = key[1], []
            if at < len(raw):
                open_.append(raw[at:])
            depth += int(depths[-1]) if len(depths) else 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PIECES, strict=True)], schema=_PIECES)
    if key and open_:
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((key[0], began, key[1], False, b"".join(open_)), _PIECES, strict=True)], schema=_PIECES)


def elements(text: bytes, first: bool) -> list[bytes]:
    """The element that a stretch of an array ends with, and what else stands before it."""
    text = text.strip(_SPACE)
    if first and text.startswith(b"["):
        text = text[1:]
    text = text.lstrip(_SPACE + b",")
    if text.startswith((b"{", b"[")):
        return [text]
    if text.endswith(b"]") and b"[" not in text:
        text = text[:-1].rstrip(_SPACE + b",")
    places = [p for p in (text.find(b"{"), text.find(b"[")) if p >= 0]
    cut = min(places, default=len(text))
    return [t for t in (text[:cut].rstrip(_SPACE + b","), text[cut:]) if t]


@F.arrow_udf(T.ArrayType(T.StringType()))
def _elements(texts: pa.Array, firsts: pa.Array) -> pa.Array:
    found = [
        [e.decode("utf-8", "replace") for e in elements(t.as_py(), f.as_py())] for t, f in zip(texts, firsts, strict=True)
    ]
    return pa.array(found, pa.list_(pa.string()))


def array_elements(spark: SparkSession, path: str, limit_bytes: int = runtime.BROADCAST_BYTES) -> DataFrame:
    """(value) of every element of the JSON arrays at a path, as text. Files that hold objects
    one after the other give these."""
    read = spark.read.option("lineSep", "}").text(path)
    fragments = read.select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("n"),
    )
    sums = fragments.select("value", *_BLOCK).mapInArrow(
        _sums, "file string, block long, size long, first int, ends array<int>, depths array<long>, landings array<array<long>>"
    )
    starts = runtime.cut_lineage(sums.groupBy("file").applyInArrow(_starts, _STARTS_SQL))
    if runtime.fits_broadcast(starts, limit_bytes):
        placed = fragments.join(F.broadcast(starts), _BLOCK)  # rows keep their order
    else:
        placed = fragments.join(starts, _BLOCK).repartition(*_BLOCK).sortWithinPartitions(*_BLOCK, "n")
    pieces = placed.drop("n").mapInArrow(_pieces, _PIECES_SQL)
    pieces = runtime.cut_lineage(pieces)
    crossing = (
        pieces.filter("NOT whole").groupBy("file", "began")
        .agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts"))
        .select(F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["text"])).alias("text"), (F.col("began") < 0).alias("first"))
    )
    whole = pieces.filter("whole").select("text", F.lit(False).alias("first"))
    return whole.union(crossing).select(F.explode(_elements("text", "first")).alias("value"))
