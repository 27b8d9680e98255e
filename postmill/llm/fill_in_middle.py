"""Fill-in-middle transformation with memoized content-defined chunks.

A text is cut into lines, and two draws from a hash of its id choose where prefix, middle and
suffix part. Where a cut falls in the text is found over chunks: a rolling hash of 32 bytes
ends a chunk wherever its low bits are zero, so passages that texts share fall into the same
chunks whatever stands around them. Each chunk has a summary (its code points, the code points
up to the end of each line that ends in it, its first and last bytes, whether it holds a
sentinel). A task keeps the summaries of chunks it has met, looked up by the chunk's whole
content, so equal hashes of unequal chunks are told apart. Summaries combine from left to
right: line counts add up to the document's, a sentinel across a boundary shows in the bytes on
both sides of it, and the chunk whose count reaches a cut locates it.

Only the place of the cuts comes from Python; the texts are cut and joined by built-in
functions and never leave their row. The kept summaries are bounded in bytes and end with the
task's iterator. There is no shuffle.

A null text is an empty one, and an empty text is plain, as is one that holds a sentinel. A
null id is hashed as empty text. Repeated rows give equal results; texts of any length are cut
whole. Other columns pass unchanged; an existing column of the output's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.common import text_or_empty

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_SENTINELS = tuple(s.encode() for s in (PREFIX, SUFFIX, MIDDLE))
# Bytes of the rolling window, of a chunk on average, of the longest chunk kept, of all kept.
WINDOW, CHUNK = 32, 512
KEPT_CHUNK, KEPT_BYTES = 8 * CHUNK, 16 << 20
_SUMMARY_BYTES = 400
_GEAR = np.random.Generator(np.random.PCG64(20240917)).integers(0, 2**32, 256, np.uint32)


def chunk_ends(raw: bytes) -> list[int]:
    """Ends of the chunks of a text, its own end included.

    The hash of the window that ends at a byte is the sum of its bytes' numbers, each shifted
    by its distance; a window of twice the length is two of one length.
    """
    values = _GEAR[np.frombuffer(raw, np.uint8)]
    span = 1
    while span < WINDOW:
        longer = values.copy()
        longer[span:] += values[:-span] << np.uint32(span)
        values, span = longer, 2 * span
    # The high bits depend on all bytes of the window, the low ones on its last bytes alone.
    ends = (np.flatnonzero(values >> np.uint32(32 - CHUNK.bit_length() + 1) == 0) + 1).tolist()
    if not ends or ends[-1] != len(raw):
        ends.append(len(raw))
    return ends


class Summary:
    """What the cuts of any text need to know of one of its chunks."""

    __slots__ = ("chars", "line_ends", "head", "tail", "marked")

    def __init__(self, chunk: bytes):
        raw = np.frombuffer(chunk, np.uint8)
        starts = np.cumsum((raw & 0xC0) != 0x80)
        self.chars = int(starts[-1])
        # A code point that starts in one chunk may end in the next; a line end is one byte.
        self.line_ends = starts[raw == 10].tolist()
        self.head, self.tail = chunk[:2], chunk[-2:]
        self.marked = any(s in chunk for s in _SENTINELS)


class Summaries:
    """Summaries by chunk content, as many as fit the bound."""

    def __init__(self, limit: int = KEPT_BYTES):
        self.kept: dict[bytes, Summary] = {}
        self.limit, self.held, self.hits = limit, 0, 0

    def get(self, chunk: bytes) -> Summary:
        found = self.kept.get(chunk)
        if found is not None:
            self.hits += 1
            return found
        summary = Summary(chunk)
        if len(chunk) <= KEPT_CHUNK:
            size = _SUMMARY_BYTES + len(chunk) + 8 * len(summary.line_ends)
            if self.held + size > self.limit:
                self.kept.clear()
                self.held = 0
            self.kept[chunk] = summary
            self.held += size
        return summary


def locate(raw: bytes, one: int, other: int, summaries: Summaries) -> tuple[int, bool, int, int]:
    """(lines, holds a sentinel, code points before the first cut, and before the second) of a
    text whose cuts come after `one` and `other` modulo (lines + 1) lines."""
    if not raw:
        return 0, False, 0, 0
    parts, start = [], 0
    for end in chunk_ends(raw):
        parts.append(summaries.get(raw[start:end]))
        start = end
    chars, lines, marked, tail = 0, 0, False, b""
    before = []  # (lines, code points) of all earlier chunks
    for part in parts:
        before.append((lines, chars))
        marked = marked or part.marked or any(s in tail + part.head for s in _SENTINELS)
        lines, chars, tail = lines + len(part.line_ends), chars + part.chars, (tail + part.tail)[-2:]
    ended = lines
    lines += raw[-1] != 10
    places = []
    for cut in sorted((one % (lines + 1), other % (lines + 1))):
        if cut == 0 or cut > ended:
            places.append(chars if cut else 0)
            continue
        low, high = 0, len(parts) - 1  # the first chunk after which `cut` lines have ended
        while low < high:
            middle = (low + high) // 2
            if before[middle][0] + len(parts[middle].line_ends) >= cut:
                high = middle
            else:
                low = middle + 1
        ends, held = before[low]
        places.append(held + parts[low].line_ends[cut - ends - 1])
    return lines, marked, places[0], places[1]


_LOCATED = T.StructType(
    [T.StructField("n", T.LongType()), T.StructField("marked", T.BooleanType())]
    + [T.StructField(name, T.LongType()) for name in ("first", "second")]
)


@F.arrow_udf(_LOCATED)
def _located(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    summaries = Summaries()
    for texts, ones, others in batches:
        rows = zip(texts, ones.to_pylist(), others.to_pylist(), strict=True)
        found = [locate(text.as_py(), one, other, summaries) for text, one, other in rows]
        columns = zip(*found, strict=True) if found else [[]] * 4
        types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64())
        yield pa.StructArray.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["n", "marked", "first", "second"]
        )


def transform(
    docs: DataFrame, seed: str = "7", percent: int = 100, suffix_first: int = 50,
    doc_id: str = "doc_id", text: str = "text", output: str = "fim",
) -> DataFrame:
    """All rows with a struct (n, form, prefix_chars, middle_chars, text): lines, `plain`, `psm`
    or `spm`, code points of prefix and middle (null if plain), and the transformed text.

    `percent` of the texts that can be are transformed, `suffix_first` percent of these with
    the suffix in front.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    draw = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
    own = text_or_empty(text)
    cut = _located(own.cast("binary"), draw(0), draw(1))
    rows = docs.withColumn(output, F.struct(cut.alias("cut"), draw(2).alias("kept"), draw(3).alias("order")))
    n, marked, first, second = (F.col(output)["cut"][c] for c in ("n", "marked", "first", "second"))
    plain = (own == "") | marked | (F.col(output)["kept"] % 100 >= percent)
    form = F.when(plain, "plain").when(F.col(output)["order"] % 100 < suffix_first, "spm").otherwise("psm")
    prefix, middle = F.substring(own, F.lit(1), first.cast("int")), F.substring(own, (first + 1).cast("int"), (second - first).cast("int"))
    suffix = F.substring(own, (second + 1).cast("int"), F.char_length(own))
    whole = (
        F.when(form == "plain", own)
        .when(form == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    return rows.withColumn(
        output,
        F.struct(
            n.alias("n"), form.alias("form"), F.when(form != "plain", first).alias("prefix_chars"),
            F.when(form != "plain", second - first).alias("middle_chars"), whole.alias("text"),
        ),
    )


def restore(text: Column, form: Column) -> Column:
    """The text that was transformed. Prefix, middle and suffix hold no sentinel, so each
    stands once in the output."""
    front = F.substring_index(text, MIDDLE, 1)
    middle = F.substring_index(text, MIDDLE, -1)
    psm = F.concat(F.substring_index(F.substring_index(front, SUFFIX, 1), PREFIX, -1), middle, F.substring_index(front, SUFFIX, -1))
    spm = F.concat(F.substring_index(front, PREFIX, -1), middle, F.substring_index(F.substring_index(front, PREFIX, 1), SUFFIX, -1))
    return F.when(form == "plain", text).when(form == "psm", psm).otherwise(spm)
