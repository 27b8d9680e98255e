"""Bloom filters as tables: which rows can have a partner in another table, told at the scan.

A filter is a table (word, bits) of 64-bit words. A key sets four bits in one word, so a test
is one broadcast lookup and one mask, all in generated code. The number of words follows the
number of keys up to `MAX_WORDS`, which bounds the broadcast whatever the size of the data;
beyond that more rows pass that have no partner, and the exact join that follows drops them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A word in a broadcast hash relation takes some 40 bytes, so this many take about 40 MB.
MAX_WORDS = 1 << 20
KEYS_PER_WORD = 5
_BITS = 4
_WORD, _MASK = "_bloom_word", "_bloom_bits"


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words)).cast("int")


def _mask(key: Column) -> Column:
    """Four of 64 bits, from one further hash of six bits each; some may coincide."""
    draw = F.xxhash64(key, F.lit("bits"))
    mask = F.lit(0).cast("long")
    for i in range(_BITS):
        place = F.shiftrightunsigned(draw, 6 * i).bitwiseAND(63).cast("int")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), place)
        mask = mask.bitwiseOR(bit)
    return mask


class BloomFilter:
    """The keys of a table, with false positives and no false negatives. Null keys are none."""

    def __init__(self, table: DataFrame, words: int):
        self.table, self.words = table, words

    @classmethod
    def of(cls, df: DataFrame, key: str, rows: int, max_words: int = MAX_WORDS) -> BloomFilter:
        """A filter over `rows` keys or fewer; words are combined before their shuffle."""
        words = min(max_words, max(1, rows // KEYS_PER_WORD))
        own = F.col(key)
        marked = df.filter(own.isNotNull()).select(_word(own, words).alias(_WORD), _mask(own).alias(_MASK))
        return cls(marked.groupBy(_WORD).agg(F.bit_or(_MASK).alias(_MASK)), words)

    def marked(self, df: DataFrame, key: str, output: str) -> DataFrame:
        """All rows, with whether they can have a partner; nothing is shuffled."""
        own = F.col(key)
        asked = df.withColumns({_WORD: _word(own, self.words), "_bloom_own": _mask(own)})
        held = asked.join(F.broadcast(self.table), _WORD, "left")
        hit = F.col(_MASK).bitwiseAND(F.col("_bloom_own")) == F.col("_bloom_own")
        return held.withColumn(output, own.isNotNull() & F.coalesce(hit, F.lit(False))).select(*df.columns, output)

    def keep(self, df: DataFrame, key: str) -> DataFrame:
        """The rows of `df` that can have a partner, all columns kept."""
        return self.marked(df, key, "_bloom_hit").filter("_bloom_hit").drop("_bloom_hit")
