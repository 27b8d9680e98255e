"""A corpus through toxicity, near-duplicates, decontamination, personal data and encoding."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import bpe, decontamination, near_dedup, personal_data, toxicity
from postmill.llm.common import table, text_or_empty, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Rows of an Arrow batch. A batch stands in the executor and in its Python worker, several times
# over while it grows; of whole texts, Spark's 10,000 rows take hundreds of MB an executor.
ARROW_ROWS = 1024


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity is at least one half go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, output="_toxicity")
    return scored.filter(F.col("_toxicity") < 0.5).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles are at least 0.8 alike, directly or over others,
    the one with the least id stays."""
    return near_dedup.keep_one(docs, width=5, percent=80).select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the names of its kinds; n_chars follows the text."""
    masked = personal_data.mask(docs, personal_data.fit(docs))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text, in place of the text."""
    coded = bpe.code_texts(docs.select("doc_id", text_or_empty().alias("text")), keep_decoded=False)
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("coded.ids") / 4).cast("long").alias("n_tokens"),
        F.col("coded.ids").alias("ids"),
        F.col("coded.same").alias("round_trip"),
    )


def small_batches(stage):
    """The stage, in a session whose Arrow batches hold at most `ARROW_ROWS` rows from then on."""

    @functools.wraps(stage)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
        if rows <= 0 or rows > ARROW_ROWS:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
        return stage(spark, docs, sf_dir)

    return staged


STAGES = [
    ("toxicity", small_batches(drop_toxic)),
    ("near duplicates", small_batches(drop_near_copies)),
    ("decontamination", small_batches(drop_contaminated)),
    ("personal data", small_batches(mask_personal_data)),
    ("encoding", small_batches(encode)),
]
# Fitted trees, loopy messages and the splitting pattern have no SQL form; the tests hold
# each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES):
            docs = written(docs)
    return docs
