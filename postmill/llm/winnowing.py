"""Winnowing fingerprints of whole texts, and their likeness to edited and following texts.

Hashes of all k-grams of code points come from one prefix sum; every window of `WINDOW`
hashes keeps its least, the rightmost of equal ones, with its position. Two texts that share
a run of `GRAM + WINDOW - 1` code points share a fingerprint hash. A text shorter than a gram
is one gram, the empty text has no fingerprint; a null text is empty.

Comparing each document with the next one in descending id needs no window over the table:
ranges of ids are dealt out, and the first document of a range is sent to the range before as
well. The driver holds range bounds and one id a range. Equal ids are ordered by their text;
null ids come last; the last document is followed by the first, an only one by itself.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import partitions, text_or_empty
from postmill.llm.shingles import mix

GRAM, WINDOW = 16, 33
_BASE = 0x9E3779B97F4A7C15
_LEAST = -(2**63)


@functools.lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    def run(base):
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return run(_BASE), run(pow(_BASE, -1, 2**64))


def gram_hashes(text: str, gram: int = GRAM) -> np.ndarray:
    """A 32-bit hash of every gram, in order."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(points)
    if not n:
        return points
    used = min(gram, n)
    up, down = _powers(max(1 << 14, 1 << n.bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(points * up[:n], out=sums[1:])
    return mix((sums[used:] - sums[: n + 1 - used]) * down[: n + 1 - used]) >> np.uint64(32)


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the fingerprint, by position."""
    hashes = gram_hashes(text, gram)
    n = len(hashes)
    if not n:
        return hashes, hashes
    # The hash above, the position reversed below: the least value is the rightmost least hash.
    low = np.uint64(2**32 - 1)
    values = hashes << np.uint64(32) | low - np.arange(n, dtype=np.uint64)
    width, span, least = min(window, n), 1, values
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: n - width + 1], least[width - span :])
    kept = least[np.concatenate(([True], least[1:] != least[:-1]))]
    return kept >> np.uint64(32), low - (kept & low)


def packed(hashes: np.ndarray, positions: np.ndarray) -> str:
    """Sixteen hex digits an entry: the hash and the position."""
    return np.column_stack((hashes, positions)).astype(">u4").tobytes().hex()


def likeness(one: np.ndarray, two: np.ndarray) -> float:
    """Twice the common distinct hashes over the sum of both; two empty ones are alike."""
    one, two = np.unique(one), np.unique(two)
    if not len(one) + len(two):
        return 1.0
    return 2.0 * len(np.intersect1d(one, two, True)) / (len(one) + len(two))


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by the start of the following one."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


_RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _compare(rows: pa.Table) -> pa.Table:
    ids, texts, extra = (rows[c].to_pylist() for c in ("doc_id", "text", "extra"))
    order = sorted(range(len(ids)), key=lambda i: (extra[i], -(_LEAST if ids[i] is None else ids[i]), texts[i]))
    own = [i for i in order if not extra[i]]
    after = [*own[1:], order[len(own)]] if len(order) > len(own) else [*own[1:], *own[:1]]
    out: dict[str, list] = {field.split()[0]: [] for field in _RESULT.split(", ")}
    prints: dict[int, tuple] = {}
    for i, j in zip(own, after, strict=True):
        if i not in prints:
            prints[i] = winnow(texts[i])
        prints[j] = prints[j] if j in prints else winnow(texts[j])
        changed = edited(texts[i], texts[j])
        new = winnow(changed)
        mine = prints[i]
        row = (
            ids[i], len(texts[i]), hashlib.sha256(changed.encode()).hexdigest(), packed(*mine), packed(*new),
            likeness(mine[0], new[0]), likeness(mine[0], prints[j][0]),
        )
        for column, value in zip(out.values(), row, strict=True):
            column.append(value)
        if i != own[0]:
            del prints[i]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.table({name: pa.array(values, kind) for (name, values), kind in zip(out.items(), types, strict=True)})


def compare_edited(docs: DataFrame) -> DataFrame:
    """One row for every row of (doc_id, text), as the module says."""
    spark = docs.sparkSession
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), place.alias("place"))
    ranges = 4 * partitions(spark)
    found = rows.select(F.percentile_approx("place", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("p")).first()["p"]
    bounds = np.unique(np.array(found or [], np.int64))

    @F.arrow_udf("int")
    def range_of(places: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, places.to_numpy(zero_copy_only=False)).astype(np.int32))

    heads = {r["range"]: r["head"] for r in rows.select(range_of("place").alias("range"), "place").groupBy("range").agg(F.max("place").alias("head")).collect()}
    used = sorted(heads)
    # The first document of a range follows the last one of the range above; the lowest
    # range is followed by the highest.
    before = {heads[r]: used[(i + 1) % len(used)] for i, r in enumerate(used)} if len(used) > 1 else {}
    before = {place: r for place, r in before.items()}

    @F.arrow_udf("array<struct<range: int, extra: boolean>>")
    def ranges_of(places: pa.Array) -> pa.Array:
        own = np.searchsorted(bounds, places.to_numpy(zero_copy_only=False)).tolist()
        out = []
        for r, p in zip(own, places.to_pylist(), strict=True):
            other = before.get(p)
            out.append([(r, False)] if other is None else [(r, False), (other, True)])
        return pa.array(
            [[{"range": r, "extra": e} for r, e in x] for x in out],
            pa.list_(pa.struct([("range", pa.int32()), ("extra", pa.bool_())])),
        )

    dealt = rows.select("doc_id", "text", F.explode(ranges_of("place")).alias("to")).select("doc_id", "text", "to.range", "to.extra")
    return dealt.groupBy("range").applyInArrow(_compare, _RESULT)
