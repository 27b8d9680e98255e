"""Benchmark decontamination: a BM25 index of test items, searched by every training passage.

Items are the indexed side. Their term weights are BM25 impacts divided by the item's score
for itself, so one threshold serves all items. Every passage of a document is a query:
passages are as long as two strides, a stride is at least the longest item, so each item that
stands in a text stands whole in a passage. A passage reaches the index only if, for some
item, the weights of the item's essential terms in it plus the weight of all other terms
reach the threshold; a passage without that cannot. The index is then walked by block-max
WAND, and items above the threshold are verified on the passage: their question (all but the
last sentence) by runs of five words, their answer (the last sentence) by its words in order.

Items are taken in blocks of at most `BLOCK_ITEMS`, the bound of what is broadcast; document
frequencies and lengths are those of all items. Documents are never shuffled. Result rows are
one for each document and item, whose passage scores best. Nulls and empty texts hold no
passage and empty items match nothing; repeated rows of an id count once, and rows without an
id are found but not named, so only `drop_contaminated` judges them, by keeping them.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.common import fresh, text_or_empty

K1, B = 1.2, 0.75
THRESHOLD = 0.5
QUESTION_OVERLAP, ANSWER_OVERLAP = 0.5, 0.5
BLOCK_ITEMS = 20_000
POSTINGS_BLOCK = 32
# Share of the threshold that the terms outside the essential ones may make up at most.
GATE_REST = 0.6
STRIDE = 64
RUN = 5
_END = 1 << 62

words_of = re.compile(r"\w+").findall
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


@dataclass
class Postings:
    items: list[int]
    weights: list[float]
    limit: float = 0.0
    block_ends: list[int] = field(default_factory=list)
    block_limits: list[float] = field(default_factory=list)

    def close(self) -> None:
        self.limit = max(self.weights)
        for at in range(0, len(self.items), POSTINGS_BLOCK):
            self.block_ends.append(self.items[at : at + POSTINGS_BLOCK][-1])
            self.block_limits.append(max(self.weights[at : at + POSTINGS_BLOCK]))


class ItemIndex:
    """An inverted index of items with the limits that block-max WAND needs."""

    def __init__(self, items: list[tuple[int, str]], frequency: dict[str, int], n_items: int, mean_length: float, threshold: float):
        self.ids = [item for item, _ in items]
        self.words = [words_of((text or "").lower()) for _, text in items]
        self.parts = [split_item(text or "") for _, text in items]
        self.threshold = threshold
        self.postings: dict[str, Postings] = {}
        self.essential: dict[str, list[tuple[int, float]]] = {}
        self.rest: list[float] = []
        for item, words in enumerate(self.words):
            impacts = {}
            for word, n in Counter(words).items():
                df = frequency.get(word, 1)
                idf = np.log(1 + (n_items - df + 0.5) / (df + 0.5))
                impacts[word] = float(idf * n * (K1 + 1) / (n + K1 * (1 - B + B * len(words) / max(mean_length, 1e-9))))
            own = sum(impacts.values())
            rest = 1.0
            for word, impact in sorted(impacts.items(), key=lambda x: (-x[1], x[0])):
                weight = impact / own
                postings = self.postings.setdefault(word, Postings([], []))
                postings.items.append(item)
                postings.weights.append(weight)
                if rest >= threshold * GATE_REST:
                    self.essential.setdefault(word, []).append((item, weight))
                    rest -= weight
            self.rest.append(rest)
        for postings in self.postings.values():
            postings.close()
        self.stride = max([STRIDE, *map(len, self.words)])

    def search(self, terms: set[str]) -> list[tuple[int, float]]:
        """(item, score) of every item whose score reaches the threshold: block-max WAND."""
        cursors = [[0, p] for p in (self.postings[t] for t in terms if t in self.postings)]
        out = []

        def item_at(cursor):
            at, postings = cursor
            return postings.items[at] if at < len(postings.items) else _END

        def move(cursor, item):
            cursor[0] = bisect_left(cursor[1].items, item, cursor[0])

        while True:
            cursors = sorted((c for c in cursors if item_at(c) < _END), key=item_at)
            total, pivot = 0.0, None
            for i, cursor in enumerate(cursors):
                total += cursor[1].limit
                if total >= self.threshold - 1e-9:
                    pivot = item_at(cursor)
                    break
            if pivot is None:
                return out
            last = i
            while last + 1 < len(cursors) and item_at(cursors[last + 1]) == pivot:
                last += 1
            blocks = [(p, bisect_left(p.block_ends, pivot)) for _, p in cursors[: last + 1]]
            limit = sum(p.block_limits[b] for p, b in blocks if b < len(p.block_ends))
            if limit < self.threshold - 1e-9:
                # No item before the nearest block end, or the next cursor, can reach it.
                after = min([p.block_ends[b] + 1 for p, b in blocks if b < len(p.block_ends)], default=_END)
                if last + 1 < len(cursors):
                    after = min(after, item_at(cursors[last + 1]))
                for cursor in cursors[: last + 1]:
                    move(cursor, max(after, pivot + 1))
            elif item_at(cursors[0]) == pivot:
                score = 0.0
                for cursor in cursors[: last + 1]:
                    score += cursor[1].weights[cursor[0]]
                    cursor[0] += 1
                if score >= self.threshold - 1e-9:
                    out.append((pivot, score))
            else:
                for cursor in cursors[: last + 1]:
                    move(cursor, pivot)

    def gated(self, words: list[str]) -> set[int]:
        """Passages in which the essential terms of some item, and all its others, could reach
        the threshold."""
        flags = np.fromiter(map(self.essential.__contains__, words), bool, len(words))
        held: dict[tuple[int, int], dict[str, float]] = {}
        last = max(0, (len(words) - 1) // self.stride - 1)
        for at in np.flatnonzero(flags).tolist():
            word, stretch = words[at], at // self.stride
            for item, weight in self.essential[word]:
                for passage in range(max(0, stretch - 1), min(stretch, last) + 1):
                    held.setdefault((passage, item), {})[word] = weight
        return {p for (p, item), own in held.items() if sum(own.values()) + self.rest[item] >= self.threshold - 1e-9}

    def matches(self, text: str | None) -> list[tuple[int, int, float, float, float]]:
        """(item id, passage, score, question overlap, answer overlap) of verified items."""
        words = words_of((text or "").lower())
        best: dict[int, tuple[int, int, float, float, float]] = {}
        for passage in sorted(self.gated(words)):
            own = words[passage * self.stride : (passage + 2) * self.stride]
            for item, score in self.search(set(own)):
                question, answer = (overlap(part, own, whole) for part, whole in zip(self.parts[item], (True, False), strict=True))
                if question >= QUESTION_OVERLAP and answer >= ANSWER_OVERLAP and score > best.get(item, (0, 0, 0.0))[2]:
                    best[item] = (self.ids[item], passage, score, question, answer)
        return [best[item] for item in sorted(best)]


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer: the last sentence, or the last quarter of an
    item of one sentence."""
    sentences = [words for words in (words_of(s.lower()) for s in _SENTENCE.split(text)) if words]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = sentences[0] if sentences else []
    cut = len(words) - max(1, len(words) // 4)
    return words[:cut], words[cut:]


def overlap(part: list[str], passage: list[str], runs: bool) -> float:
    """Share of the part's runs of words that the passage holds; or of its words, found in
    order. An empty part is held."""
    if not part:
        return 1.0
    if runs:
        size = min(RUN, len(part))
        have = set(zip(*(passage[i:] for i in range(size)), strict=False))
        own = list(zip(*(part[i:] for i in range(size)), strict=False))
        return sum(run in have for run in own) / len(own)
    row = [0] * (len(passage) + 1)  # the longest common subsequence
    for word in part:
        diagonal = 0
        for j, other in enumerate(passage, 1):
            above = row[j]
            row[j] = diagonal + 1 if word == other else max(above, row[j - 1])
            diagonal = above
    return row[-1] / len(part)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _words(texts: pa.Array) -> pa.Array:
    return pa.array([words_of((t or "").lower()) for t in texts.to_pylist()], pa.list_(pa.string()))


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, passage, score, question_overlap, answer_overlap) of every leak of a
    row of (item_id, text) in a row of (doc_id, text)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text")).filter(
        F.trim("text") != ""
    )
    n_items = items.count()
    blocks = -(-n_items // BLOCK_ITEMS) or 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    split = items.select("item_id", "text", _words("text").alias("words"))
    counted = split.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").count()
    mean = split.agg(F.avg(F.size("words"))).first()[0] or 0.0
    out = None
    for block in range(blocks):
        # A block is split off by hash, so its size is near its share of the items.
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        held = own.orderBy("item_id", "text").collect()
        known = counted if blocks == 1 else counted.join(own.select(F.explode(_words("text")).alias("word")).distinct(), "word", "left_semi")
        frequency = {r["word"]: r["count"] for r in known.collect()}
        index = spark.sparkContext.broadcast(
            ItemIndex([(r["item_id"], r["text"]) for r in held], frequency, n_items, float(mean), threshold)
        )
        found = rows.select("doc_id", F.explode(_matcher(index)("text")).alias("m")).select("doc_id", "m.*")
        out = found if out is None else out.union(found)
    best = F.max(F.struct("score", (-F.col("passage")).alias("before"), "question_overlap", "answer_overlap")).alias("best")
    return (
        out.groupBy("doc_id", "item_id").agg(best)
        .select(
            "doc_id", "item_id", (-F.col("best.before")).cast("int").alias("passage"), F.round("best.score", 9).alias("score"),
            "best.question_overlap", "best.answer_overlap",
        )
    )


def _matcher(index):
    kind = pa.struct([
        ("item_id", pa.int64()), ("passage", pa.int32()), ("score", pa.float64()),
        ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()),
    ])
    names = [f.name for f in kind]

    @F.arrow_udf("array<struct<item_id: long, passage: int, score: double, question_overlap: double, answer_overlap: double>>")
    def match(texts: pa.Array) -> pa.Array:
        own = index.value
        return pa.array(
            [[dict(zip(names, m, strict=True)) for m in own.matches(t)] for t in texts.to_pylist()], pa.list_(kind)
        )

    return match


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text holds no item, all columns kept."""
    name = fresh(docs, "_leaked")
    leaked = find(docs, benchmark, threshold).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(leaked, docs["doc_id"] == leaked[name], "left_anti")
