"""Language-model scores from an n-gram trie that is spread over the executors.

The model is a bigram model with absolute discounting, interpolated with a smoothed unigram
model: p(w | v) = (c(v, w) - D) / c(v) + D * n(v) / c(v) * (c(w) + 0.5) / (N + 0.5 (V + 1)),
where n(v) counts distinct successors; after a context that training lacks, the unigram
probability alone. Texts start with a start mark and end with an end token.

Neither corpus nor model is ever in one place. Documents are packed into batches by a hash of
their id. Each batch asks each shard once for every distinct word and bigram that it holds,
and adds how often its training documents hold them. A shard sums the counts up, builds its
part of the trie (contexts, pointers and successors as Elias-Fano levels, quantised
probabilities), maps it from a file and answers every batch: a context is found in its level, and
its successors between its pointer and the next, relative to that range. The batch
then sums its documents' scores. A bigram that a third of all documents hold costs one entry
a batch, so no key is hot; what moves grows with the corpus.

Words are 64-bit hashes, successors of a context their low 40 bits. A null text is an empty
one and consists of the end token; rows are scored one by one, so repeated rows and ids are
no matter. A null id trains like the empty text's. Probabilities are rounded to 1/2048 of a
decimal power; counts, base scores and known tokens are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import partitions, runs_of, text_or_empty, written
from postmill.llm.elias_fano import Trie, dequantise
from postmill.llm.shingles import hashes_of, mix, words_of

DISCOUNT = 0.75
SUCCESSOR_BITS = 40
# White space cannot be part of a word, so these are hashes of no word.
START, END = (int(x) for x in hashes_of([b" start", b" end"]))
_U = np.uint64
_LOW = _U((1 << SUCCESSOR_BITS) - 1)
PACK_BYTES = 4 << 20


def _frame(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(len(a) for a in arrays)], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in (head, *arrays)))


def _unframe(blob: bytes, *types) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8)
    out, at = [], 8 * (n + 1)
    for size, kind in zip(sizes.tolist(), types, strict=True):
        out.append(np.frombuffer(raw, kind, size, at))
        at += size * np.dtype(kind).itemsize
    return out


def _pack(batches: int):
    """Rows (doc_id, trains, batch, text) of a task as compressed runs of texts by batch."""

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            batch = part["batch"].to_numpy()
            order = np.argsort(batch, kind="stable")
            sizes = [len(x) for x in part["text"].to_pylist()]
            for a, b in runs_of([sizes[i] for i in order], PACK_BYTES * 4):
                own = part.take(pa.array(order[a:b]))
                numbers, texts = own["batch"].to_numpy(), own["text"].to_pylist()
                ids, trains = own["doc_id"].to_pylist(), own["trains"].to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
                rows = {"batch": [], "ids": [], "trains": [], "blob": []}
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    lengths = np.array([len(t) for t in texts[x:y]], np.int64)
                    rows["batch"].append(int(numbers[x]))
                    rows["ids"].append(ids[x:y])
                    rows["trains"].append(trains[x:y].tolist())
                    rows["blob"].append(_frame(lengths, np.frombuffer(b"".join(texts[x:y]), np.uint8)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows["batch"], pa.int32()), pa.array(rows["ids"], pa.list_(pa.int64())),
                        pa.array(rows["trains"], pa.list_(pa.bool_())), pa.array(rows["blob"], pa.binary()),
                    ],
                    list(rows),
                )

    return pack


class Batch:
    """The documents of a batch as hashes, with its distinct words and bigrams in the order
    in which shards are asked for them."""

    def __init__(self, packed: pa.Table, shards: int):
        runs = sorted(
            zip(packed["ids"].to_pylist(), packed["trains"].to_pylist(), packed["blob"].to_pylist(), strict=True),
            key=lambda run: run[2],
        )
        self.ids = [i for ids, _, _ in runs for i in ids]
        trains = np.array([t for _, own, _ in runs for t in own], bool)
        end = np.array([END], _U)
        tokens: list[np.ndarray] = []
        for _, _, blob in runs:
            lengths, raw = _unframe(blob, np.int64, np.uint8)
            at, raw = 0, raw.tobytes()
            for n in lengths.tolist():
                tokens += [hashes_of(words_of(raw[at : at + n])), end]
                at += n
        self.lengths = np.array([len(t) + 1 for t in tokens[::2]], np.int64)
        words = np.concatenate(tokens) if tokens else np.zeros(0, _U)
        starts = np.cumsum(self.lengths) - self.lengths
        before = np.roll(words, 1)
        before[starts] = START
        weights = np.repeat(trains, self.lengths).astype(np.int64)
        self.words, self.word_at, self.word_cuts = self._ordered(words, shards)
        self.contexts, at, context_cuts = self._ordered(before, shards)
        key = at.astype(_U) << _U(SUCCESSOR_BITS) | words & _LOW
        self.bigrams, self.bigram_at = np.unique(key, return_inverse=True)
        self.context_of = (self.bigrams >> _U(SUCCESSOR_BITS)).astype(np.int64)
        self.context_cuts = context_cuts
        self.bigram_cuts = np.searchsorted(self.context_of, context_cuts)
        self.starts = starts
        count = lambda at, n: np.bincount(at, weights, n).astype(np.uint32)
        self.word_counts = count(self.word_at, len(self.words))
        self.bigram_counts = count(self.bigram_at, len(self.bigrams))

    @staticmethod
    def _ordered(values: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct values by (shard, value), where each value went, and the shards' cuts."""
        own, at = np.unique(values, return_inverse=True)
        shard = (mix(own) % _U(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        place = np.empty(len(own), np.int64)
        place[order] = np.arange(len(own))
        return own[order], place[at], np.searchsorted(shard[order], np.arange(shards + 1))

    def questions(self) -> Iterator[tuple[int, bytes]]:
        for shard in range(len(self.word_cuts) - 1):
            (w, x), (c, d), (b, e) = (cuts[shard : shard + 2] for cuts in (self.word_cuts, self.context_cuts, self.bigram_cuts))
            if x > w or d > c:
                low = (self.bigrams[b:e] & _LOW).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : SUCCESSOR_BITS // 8]
                yield shard, _frame(
                    self.words[w:x], self.word_counts[w:x], self.contexts[c:d],
                    np.bincount(self.context_of[b:e] - c, minlength=d - c).astype(np.uint32),
                    np.ascontiguousarray(low).ravel(), self.bigram_counts[b:e],
                )


def _ask(shards: int):
    def ask(key: tuple, packed: pa.Table) -> pa.Table:
        rows = list(Batch(packed, shards).questions())
        return pa.table({
            "batch": pa.array([key[0].as_py()] * len(rows), pa.int32()),
            "shard": pa.array([s for s, _ in rows], pa.int32()),
            "payload": pa.array([p for _, p in rows], pa.binary()),
        })

    return ask


def _answer(discount: float):
    def answer(key: tuple, asked: pa.Table) -> pa.Table:
        kinds = (_U, np.uint32, _U, np.uint32, np.uint8, np.uint32)
        batches, payloads = asked["batch"].to_pylist(), asked["payload"].to_pylist()
        asks = [_unframe(x, *kinds) for x in payloads]
        del payloads
        words, at = np.unique(np.concatenate([a[0] for a in asks]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([a[1] for a in asks]), len(words)).astype(np.int64)
        trie = _trie(asks, discount).mapped()
        rows, place = [], 0
        for own, _, contexts, sizes, low, _ in asks:
            known = counts[at[place : place + len(own)]]
            place += len(own)
            places, backoffs = trie.context_codes(contexts)
            codes = trie.codes(places, sizes, _wide(low))
            rows.append(_frame(known, backoffs, codes))
        shard, n = key[0].as_py(), len(rows)
        return pa.table({
            "batch": pa.array([*batches, -1], pa.int32()),
            "shard": pa.array([shard] * (n + 1), pa.int32()),
            "payload": pa.array([*rows, None], pa.binary()),
            "tokens": pa.array([None] * n + [int(counts.sum())], pa.int64()),
            "distinct": pa.array([None] * n + [int((counts > 0).sum())], pa.int64()),
        })

    return answer


def _wide(low: np.ndarray) -> np.ndarray:
    """Packed successors as 64-bit numbers."""
    out = np.zeros((len(low) // (SUCCESSOR_BITS // 8), 8), np.uint8)
    out[:, : SUCCESSOR_BITS // 8] = low.reshape(-1, SUCCESSOR_BITS // 8)
    return out.view("<u8").ravel()


def _trie(asks: list[list[np.ndarray]], discount: float) -> Trie:
    """The trie over the bigrams that the batches' training documents hold."""
    contexts, successors, counts = [], [], []
    for _, _, own, sizes, low, seen in asks:
        trained = seen > 0
        contexts.append(np.repeat(own, sizes)[trained])
        successors.append(_wide(low)[trained])
        counts.append(seen[trained])
    context, successor, count = (np.concatenate(x) for x in (contexts, successors, counts))
    order = np.lexsort((successor, context))
    context, successor, count = context[order], successor[order], count[order].astype(np.float64)
    first = np.flatnonzero(np.r_[True, (context[1:] != context[:-1]) | (successor[1:] != successor[:-1])][: len(context)])
    total = np.add.reduceat(count, first) if len(first) else count
    return Trie.build(context[first], successor[first], total, SUCCESSOR_BITS, discount)


_SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _sum_up(shards: int, tokens: int, distinct: int):
    mass = np.log10(tokens + 0.5 * (distinct + 1))

    def sum_up(key: tuple, packed: pa.Table, answers: pa.Table) -> pa.Table:
        batch = Batch(packed, shards)
        counts = np.zeros(len(batch.words), np.int64)
        backoffs = np.zeros(len(batch.contexts), np.uint16)
        codes = np.zeros(len(batch.bigrams), np.uint16)
        for shard, payload in zip(answers["shard"].to_pylist(), answers["payload"].to_pylist(), strict=True):
            known, own, found = _unframe(payload, np.int64, np.uint16, np.uint16)
            for whole, cuts, part in (
                (counts, batch.word_cuts, known), (backoffs, batch.context_cuts, own), (codes, batch.bigram_cuts, found)
            ):
                whole[cuts[shard] : cuts[shard + 1]] = part
        base = (np.log10(counts + 0.5) - mass)[batch.word_at]
        backoff = np.where(backoffs > 0, 10.0 ** dequantise(backoffs), 1.0)
        direct = np.where(codes > 0, 10.0 ** dequantise(codes), 0.0)
        scores = np.log10(direct[batch.bigram_at] + backoff[batch.context_of][batch.bigram_at] * 10.0**base)
        per_row = lambda x: np.add.reduceat(x, batch.starts) if len(batch.starts) else x
        return pa.table({
            "doc_id": pa.array(batch.ids, pa.int64()),
            "n_tokens": pa.array(batch.lengths),
            "n_known": pa.array(per_row((counts > 0)[batch.word_at].astype(np.int64))),
            "base_score": pa.array(per_row(base)),
            "score": pa.array(per_row(scores)),
        })

    return sum_up


def score(docs: DataFrame, trains: Column, discount: float = DISCOUNT) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of
    (doc_id, text), with the model of the rows for which `trains` holds."""
    spark = docs.sparkSession
    parts = partitions(spark)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(trains, F.lit(False)).alias("trains"),
        F.pmod(F.xxhash64("doc_id", F.octet_length(text_or_empty())), F.lit(parts)).cast("int").alias("batch"),
        text_or_empty().cast("binary").alias("text"),
    )
    packed = rows.mapInArrow(_pack(parts), "batch int, ids array<long>, trains array<boolean>, blob binary")
    asked = packed.groupBy("batch").applyInArrow(_ask(parts), "batch int, shard int, payload binary")
    answers = written(
        asked.groupBy("shard").applyInArrow(
            _answer(discount), "batch int, shard int, payload binary, tokens long, distinct long"
        )
    )
    total = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("v")).first()
    own = answers.filter("batch >= 0").select("batch", "shard", "payload")
    scored = packed.groupBy("batch").cogroup(own.groupBy("batch")).applyInArrow(
        _sum_up(parts, total["n"], total["v"]), _SCORED
    )
    return scored.withColumn("train_tokens", F.lit(total["n"]).cast("long"))
