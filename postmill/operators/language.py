"""Learning a language profile, and filtering by language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.functions.language import SCALE
from postmill.functions.trigrams import BUCKETS, trigram_buckets


def language_profile(labelled: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, kind, bucket, n, weight) from labelled text.

    Every task counts the trigrams of its texts and sends at most languages x BUCKETS rows,
    however much text one language has; everything after works on that small table.
    """
    labelled = labelled.filter(F.col(lang).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).alias("lang")
    )
    grams = (
        labelled.mapInArrow(_count_trigrams, "lang string, bucket int, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    )
    texts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy("lang"))
    smoothed = total + F.lit(BUCKETS)
    seen = grams.select(
        "lang", F.lit("gram").alias("kind"), "bucket", "n",
        _weight((F.col("n") + 1) / smoothed).alias("weight"),
    )
    unseen = (
        grams.groupBy("lang").agg(F.sum("n").alias("n"))
        .select("lang", F.lit("unseen").alias("kind"), F.lit(-1).alias("bucket"), "n",
                _weight(1 / (F.col("n") + BUCKETS)).alias("weight"))
    )
    prior = texts.select(
        "lang", F.lit("prior").alias("kind"), F.lit(-1).alias("bucket"), "n",
        _weight(F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1)))).alias("weight"),
    )
    return seen.unionByName(unseen).unionByName(prior)


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts become Python objects one by one, so a task holds one of them beside its batch."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for one, lang in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
            if one.is_valid:
                found = np.bincount(trigram_buckets(one.as_py()), minlength=BUCKETS)
                if lang in counts:
                    counts[lang] += found
                else:
                    counts[lang] = found
    for lang, found in counts.items():
        seen = np.flatnonzero(found)
        columns = [pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(found[seen], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "n"])


def _weight(share: Column) -> Column:
    return F.round(F.log(share) * SCALE).cast("int")


def with_language(df: DataFrame, detector, text: str, output: str) -> DataFrame:
    """The rows with the language of a text. A detector either has `detect`, from column to
    column, or `detect_rows`, from (rows, text, output) to rows with one more column, which can
    join, repartition or call whatever it likes."""
    if hasattr(detector, "detect_rows"):
        return detector.detect_rows(df, text, output)
    return df.withColumn(output, detector.detect(F.col(text)))


def language_filter(df: DataFrame, column: str, desired: str) -> DataFrame:
    """Keep rows in the desired language; an empty choice keeps nothing."""
    return df.filter(F.lower(F.col(column)) == F.lit(desired.lower()))
