"""Passages that repeat, found by level-wise doubling, and removed but for their first place.

A window is a number of consecutive words of one document. A window of full length can repeat
only if the half windows in it do, so half windows are counted first, and only around those that
occur twice are windows of twice the length named and compared; text without a repeated half
window goes no further. The doubling starts at half the length and ends at it, as longer windows
change nothing in what is removed.

1. Of the half windows inside each full window the one of least hash is picked, the rightmost of
   equal ones. Equal windows pick equal halves at equal places, so no repeat is lost, and about
   one half window in six goes to the count.
2. Names (hashes) of windows travel packed: a source, some megabytes of text, sends each of its
   distinct names once to the name's bucket. Buckets are read as streams that keep one entry a
   name, so a passage that a third of all documents share costs each source one entry. The places
   of names that another source has too go back to their source.
3. Full windows around repeated halves are named with 128 bits and meet in buckets again. A place
   that is not the first of its name, in the order of documents and words, goes back.
4. Every document with such places loses the words they cover; windows are judged on the given
   text, so the loss of one word changes no other window.

Buckets are as many as the bytes of all texts call for. Texts cross the shuffle in the joins that
bring places to their documents, whose hot side Spark can split; a Bloom filter of the documents
that have places, bounded in size, keeps the other texts out of it.

Documents are ordered by id, null ids last; those that share an id by a hash of their texts.
Equal rows of one id are one document and give equal results. Null and empty texts have no words.
Texts of any length are taken whole. Other columns pass unchanged; an existing column of the
output's name is replaced. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.common import fresh, runs_of, written
from postmill.llm.shingles import hashes_of, mix
from postmill.operators.bloom import BloomFilter

WINDOW = 20
# Bytes of text that make a source, and that make a bucket of names.
SOURCE_BYTES = 4 << 20
BUCKET_BYTES = 32 << 20
# Entries a bucket takes in before it sorts them into what it keeps.
MERGED_ENTRIES = 400_000
_STEP, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LAST = 2**63 - 1
_ROWS = pa.schema([
    ("bucket", pa.int32()), ("source", pa.int64()), ("names", pa.binary()), ("places", pa.binary()),
    ("starts", pa.binary()), ("keys", pa.binary()),
])
_ROWS_SQL = "bucket int, source long, names binary, places binary, starts binary, keys binary"


def words_of(text: bytes | None) -> list[bytes]:
    return text.split() if text else []


class Windows:
    """Words of some documents, one after the other, and the names of their windows."""

    def __init__(self, texts: list[bytes | None], window: int):
        words = [words_of(t) for t in texts]
        counts = np.array([len(w) for w in words], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else counts
        # Two halves cover a window; of an odd length they share a word.
        self.window, self.half = window, (window + 1) // 2
        hashes = hashes_of([w for own in words for w in own])
        size = max(0, len(hashes) - self.half + 1)
        half = np.full(size, self.half, np.uint64)
        for i in range(self.half):
            half = mix(half * _STEP + hashes[i : i + size])
        self.half_names = half
        # Starts of full windows: those that end inside their document.
        ends = np.repeat(self.starts + counts, counts)
        self.full = np.flatnonzero(np.arange(len(hashes)) + window <= ends)

    def picked(self) -> np.ndarray:
        """For every full window, the place of its half window of least name, rightmost first."""
        if not len(self.full):
            return self.full
        choices = self.window - self.half + 1
        reach = np.lib.stride_tricks.sliding_window_view(self.half_names, choices)[self.full]
        return self.full + (choices - 1 - reach[:, ::-1].argmin(1))

    def full_names(self, places: np.ndarray) -> np.ndarray:
        """128-bit names of full windows, from the names of their first and last halves."""
        a, b = self.half_names[places], self.half_names[places + self.window - self.half]
        return np.stack((mix(a * _STEP + b), mix(b * _OTHER + mix(a ^ _OTHER))), 1)


def packed_rows(source: int, names: np.ndarray, places: np.ndarray, starts: np.ndarray, keys: np.ndarray, buckets: int, later: bool):
    """What a source sends: a row for each bucket with its distinct names and the first place
    of each, and a row (bucket -1) for itself with the documents and the places of names that
    it holds more than once, the first place among them unless only `later` ones count."""
    order = np.lexsort((places, *names.T[::-1]))
    names, places = names[order], places[order]
    first = np.ones(len(places), bool)
    first[1:] = (names[1:] != names[:-1]).any(1)
    again = ~first
    if not later:
        again[:-1] |= ~first[1:]
    out = [(-1, source, b"", places[again].astype("<u4").tobytes(), starts.astype("<u4").tobytes(), keys.tobytes())]
    names, places = names[first], places[first]
    bucket = (names[:, 0] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for own in np.split(order, cuts) if len(order) else []:
        docs = np.unique(np.searchsorted(starts, places[own], "right") - 1) if later else np.array([], np.int64)
        out.append((
            int(bucket[own[0]]), source, names[own].tobytes(), places[own].astype("<u4").tobytes(),
            starts[docs].astype("<u4").tobytes(), keys[docs].tobytes(),
        ))
    return out


def _sources(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, list]]]:
    """(source, columns) of runs of rows of about SOURCE_BYTES, in the order of their keys."""
    task, n = TaskContext.get().partitionId() if TaskContext.get() else 0, 0
    for batch in batches:
        sizes = [len(t) if t else 0 for t in batch.column("text").to_pylist()]
        for start, end in runs_of(sizes, SOURCE_BYTES):
            own = batch.slice(start, end - start)
            order = np.lexsort((own.column("b").to_numpy(), own.column("a").to_numpy()))
            rows = own.take(pa.array(order)).to_pydict()
            yield task << 32 | n, rows
            n += 1


def _sender(window: int, buckets: int, later: bool):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for source, rows in _sources(batches):
            held = Windows(rows["text"], window)
            picked = held.picked()
            keys = np.array([rows["a"], rows["b"]], np.int64).T.copy()
            if later:
                marked = np.zeros(len(held.half_names) + 1, bool)
                for start, marks in zip(held.starts.tolist(), rows["marks"], strict=True):
                    marked[start + np.frombuffer(marks, "<u4").astype(np.int64)] = True
                places = held.full[marked[picked]]
                names = held.full_names(places)
            else:
                places = np.unique(picked)
                names = held.half_names[places][:, None]
            out = packed_rows(source, names, places, held.starts, keys, buckets, later)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ROWS, strict=True)], schema=_ROWS)

    return send


class Bucket:
    """Entries of one bucket, one kept a name: the first that came, or the least in order."""

    def __init__(self, width: int, later: bool):
        self.width, self.later = width, later
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.n = 0
        # Columns: the parts of the name, order (document's keys, place in it), source, place, told.
        self.kept: np.ndarray | None = None

    def add(self, source: int, names: bytes, places: bytes, starts: bytes, keys: bytes) -> None:
        name = np.frombuffer(names, np.uint64).reshape(-1, self.width)
        place = np.frombuffer(places, "<u4").astype(np.int64)
        entry = np.zeros((len(place), self.width + 6), np.int64)
        entry[:, : self.width] = name.view(np.int64)
        if self.later:
            start = np.frombuffer(starts, "<u4").astype(np.int64)
            doc = np.searchsorted(start, place, "right") - 1
            entry[:, self.width : self.width + 2] = np.frombuffer(keys, np.int64).reshape(-1, 2)[doc]
            entry[:, self.width + 2] = place - start[doc]
        entry[:, self.width + 3], entry[:, self.width + 4] = source, place
        self.waiting.append(entry)
        self.n += len(entry)

    def merge(self) -> Iterator[tuple[int, bytes]]:
        """Takes in what waits; gives (source, places) of entries known to repeat."""
        if not self.n:
            return
        all_ = np.concatenate([*([self.kept] if self.kept is not None else []), *self.waiting])
        self.waiting, self.n = [], 0
        keyed = self.width + (3 if self.later else 0)
        all_ = all_[np.lexsort([all_[:, c] for c in range(keyed - 1, -1, -1)])]
        first = np.ones(len(all_), bool)
        first[1:] = (all_[1:, : self.width] != all_[:-1, : self.width]).any(1)
        tell = ~first
        if self.later:
            lead = all_[np.maximum.accumulate(np.where(first, np.arange(len(all_)), 0))]
            # The same place of the same document, sent twice, is not a later one.
            tell &= (all_[:, self.width : keyed] != lead[:, self.width : keyed]).any(1)
        else:
            tell[:-1] |= ~first[1:]
            tell &= all_[:, -1] == 0
            all_[tell, -1] = 1
        told = all_[tell, self.width + 3 : self.width + 5]
        self.kept = all_[first]
        told = told[np.argsort(told[:, 0], kind="stable")]
        for own in np.split(told, np.flatnonzero(np.diff(told[:, 0])) + 1) if len(told) else []:
            yield int(own[0, 0]), own[:, 1].astype("<u4").tobytes()


def _teller(width: int, later: bool):
    schema = pa.schema([("source", pa.int64()), ("places", pa.binary())])

    def row_batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, bucket = None, Bucket(width, later)
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != number:
                    if found := list(bucket.merge()):
                        yield row_batch(found)
                    number, bucket = row["bucket"], Bucket(width, later)
                bucket.add(row["source"], row["names"], row["places"], row["starts"], row["keys"])
                if bucket.n >= MERGED_ENTRIES and (found := list(bucket.merge())):
                    yield row_batch(found)
        if found := list(bucket.merge()):
            yield row_batch(found)

    return tell


def _by_document(table: pa.Table) -> pa.Table:
    """Places of one source as places in its documents."""
    rows = table.to_pylist()
    own = next(r for r in rows if r["starts"] is not None)
    starts = np.frombuffer(own["starts"], "<u4").astype(np.int64)
    keys = np.frombuffer(own["keys"], np.int64).reshape(-1, 2)
    places = np.unique(np.frombuffer(b"".join(r["places"] for r in rows), "<u4").astype(np.int64))
    # A document without words starts where the next one does and is passed over.
    doc = np.searchsorted(starts, places, "right") - 1
    cuts = np.flatnonzero(np.diff(doc)) + 1
    parts = np.split(np.arange(len(places)), cuts) if len(places) else []
    docs = [int(doc[p[0]]) for p in parts]
    marks = [(places[p] - starts[d]).astype("<u4").tobytes() for p, d in zip(parts, docs, strict=True)]
    return pa.table({
        "a": pa.array(keys[docs, 0] if docs else [], pa.int64()), "b": pa.array(keys[docs, 1] if docs else [], pa.int64()),
        "marks": pa.array(marks, pa.binary()),
    })


def _repeated(texts: DataFrame, window: int, buckets: int, later: bool) -> DataFrame:
    """(a, b, marks) of documents with places whose names repeat; one level of the doubling."""
    sent = written(texts.mapInArrow(_sender(window, buckets, later), _ROWS_SQL))
    dealt = sent.filter("bucket >= 0").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    told = dealt.mapInArrow(_teller(2 if later else 1, later), "source long, places binary")
    none = F.lit(None).cast("binary")
    own = sent.filter("bucket = -1").select("source", "places", "starts", "keys")
    back = own.union(told.select("source", "places", none, none))
    return back.groupBy("source").applyInArrow(_by_document, "a long, b long, marks binary")


def repeated_places(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(a, b, marks) of every document of (a, b, text) with windows that also start earlier:
    the starts of these, counted in words, as packed unsigned 32-bit integers."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    # Equal rows of one document have equal marks, so one of them stands for all.
    halves = _repeated(docs, window, buckets, later=False).groupBy("a", "b").agg(F.max("marks").alias("marks"))
    halves = written(halves)
    wanted = BloomFilter.of(halves, "b", halves.count()).keep(docs, "b")
    open_ = wanted.join(halves, ["a", "b"]).dropDuplicates(["a", "b"]).select("a", "b", "text", "marks")
    return written(_repeated(open_, window, buckets, later=True))


def _cutter(window: int):
    kind = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "n_removed")] + [T.StructField("kept", T.BinaryType())])

    @F.arrow_udf(kind)
    def cut(texts: pa.Array, marks: pa.Array) -> pa.Array:
        out = []
        for text, own in zip(texts, marks, strict=True):
            words = words_of(text.as_py())
            kept = words
            if own.is_valid:
                edges = np.zeros(len(words) + 1, np.int64)
                starts = np.frombuffer(own.as_py(), "<u4").astype(np.int64)
                np.add.at(edges, starts, 1)
                np.add.at(edges, starts + window, -1)
                kept = [words[i] for i in np.flatnonzero(np.cumsum(edges)[:-1] == 0).tolist()]
            out.append((len(words), len(words) - len(kept), b" ".join(kept)))
        columns = zip(*out, strict=True) if out else [[]] * 3
        return pa.StructArray.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)],
            ["n_words", "n_removed", "kept"],
        )

    return cut


def drop_repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", output: str = "cut") -> DataFrame:
    """All rows with a struct (n_words, n_removed, kept): the words of the text, those that
    repeated windows cover, and the others joined by a space, as UTF-8 bytes."""
    if window < 2:
        raise ValueError("a window has two words at least")
    a, b = fresh(docs, "_a"), fresh(docs, "_b")
    own = F.col(text).cast("string").cast("binary")
    keyed = docs.withColumns({
        a: F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)),
        b: F.xxhash64(F.col(doc_id).isNull(), F.coalesce(own, F.lit(b""))),
    })
    marks = repeated_places(keyed.select(F.col(a).alias("a"), F.col(b).alias("b"), own.alias("text")), window)
    held, maybe = fresh(keyed, "_marks"), fresh(keyed, "_maybe")
    asked = BloomFilter.of(marks, "b", marks.count()).marked(keyed, b, maybe)
    named = marks.select(F.col("a").alias(a), F.col("b").alias(b), F.col("marks").alias(held))
    joined = asked.filter(maybe).join(named, [a, b], "left").select(*keyed.columns, held)
    clean = asked.filter(~F.col(maybe)).select(*keyed.columns, F.lit(None).cast("binary").alias(held))
    return joined.union(clean).withColumn(output, _cutter(window)(own, F.col(held))).select(
        *(c for c in docs.columns if c != output), output
    )
