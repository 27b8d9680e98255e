"""Names of a dictionary found in texts, for a dictionary of any size held as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill import runtime
from postmill.functions.enrichment import words_of
from postmill.operators.bloom import BloomFilter


def _phrases(words: Column, longest: int) -> Column:
    """Distinct runs of one to `longest` neighbouring words, joined by a space."""

    def runs(n: int) -> Column:
        return F.transform(words, lambda _, i: F.array_join(F.slice(words, i + 1, F.lit(n)), " "))

    return F.array_distinct(F.concat(*(runs(n) for n in range(1, longest + 1))))


def technologies_in(
    df: DataFrame, names: DataFrame, text: str = "description", output: str = "technologies_required",
    limit_bytes: int = runtime.BROADCAST_BYTES,
) -> DataFrame:
    """The rows with the sorted names of (name) that their text holds as words, in any case.

    A name of several words is found where these follow each other, whatever stands between. Runs of words meet the
    dictionary by equality: at the scan while it is small, else in a shuffle which only runs
    that pass its Bloom filter reach. A name that has no word is never found; an existing
    column of the output's name is replaced.
    """
    rows = runtime.cut_lineage(df.drop(output).withColumn("_row", F.monotonically_increasing_id()))
    known = names.select("name", words_of(F.col("name")).alias("_words")).filter(F.size("_words") > 0)
    known = known.select("name", F.array_join("_words", " ").alias("_phrase"), F.size("_words").alias("_n")).distinct()
    known, count, longest = runtime.cut_and_count(known, F.max("_n"))
    words = rows.select("_row", words_of(F.col(text)).alias("_words"))
    phrases = words.select("_row", F.explode(_phrases(F.col("_words"), max(1, longest))).alias("_phrase"))
    small = runtime.fits_broadcast(known, limit_bytes)
    if not small:
        phrases = BloomFilter.of(known, "_phrase", count).keep(phrases, "_phrase")
    found = phrases.join(F.broadcast(known) if small else known, "_phrase")
    told = found.groupBy("_row").agg(F.array_sort(F.collect_set("name")).alias(output))
    none = F.array().cast("array<string>")
    return rows.join(told, "_row", "left").withColumn(output, F.coalesce(output, none)).drop("_row")
