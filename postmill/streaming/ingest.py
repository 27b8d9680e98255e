"""Keeping an accepted-postings table up to date from a stream of postings.

    <accepted>/batch_id=<n>      postings that a micro-batch added
    <accepted>.keys              log of their keys, one folder a batch, split into hash buckets

A batch asks only whether its own keys were taken before. It reads keys, never postings, and of
these the buckets that its keys fall into; the others are pruned before the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from postmill import runtime
from postmill.operators.greedy import greedy_dedup
from postmill.operators.joins import ID_KEY, PAIR_KEY, identity_keys
from postmill.sources.snapshot_log import SnapshotLog

BATCH = "batch_id"
BUCKETS = 256
# Key folders that a batch reads at most; more are merged.
MERGE_FOLDERS = 64
_KEYS = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("bucket", T.IntegerType())])
_ID, _PAIR = "_id_digest", "_pair_digest"


class AcceptedKeys:
    """Ids and pairs of everything accepted, as digests in hash buckets."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.log = SnapshotLog(spark, path, _KEYS, partition_by="bucket")
        self.buckets = buckets

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def of(self, rows: DataFrame) -> DataFrame:
        """(key, bucket) of rows with both digests, each once."""
        keys = rows.select(F.explode(F.array(_ID, _PAIR)).alias("key")).distinct()
        return keys.withColumn("bucket", self.bucket(F.col("key")))

    def among(self, wanted: DataFrame, batch: str, limit_bytes: int = runtime.BROADCAST_BYTES) -> DataFrame:
        """(key) of the materialised `wanted` that batches other than this one have taken."""
        touched = [r["bucket"] for r in wanted.select("bucket").distinct().collect()]  # BUCKETS at most
        taken = self.log.read(without=batch).filter(F.col("bucket").isin(touched))
        small = runtime.fits_broadcast(wanted, limit_bytes)
        return taken.join(F.broadcast(wanted) if small else wanted, ["bucket", "key"], "left_semi").select("key").distinct()

    def add(self, rows: DataFrame, batch: str) -> None:
        """The keys of a batch, added once; folders before the last one are merged when many."""
        self.log.append(self.of(rows), batch)
        if self.log.folders() > MERGE_FOLDERS:
            self.log.compact(but_last=1)


def digests() -> dict[str, Column]:
    """128-bit digests of the keys by which postings are the same, after `identity_keys`."""
    title, company = F.col(PAIR_KEY)["t"], F.col(PAIR_KEY)["c"]
    pair = F.concat(F.lit("pair:"), F.octet_length(title).cast("string"), F.lit(":"), title, company)
    return {
        _ID: F.unhex(F.md5(F.concat(F.lit("id:"), F.col(ID_KEY)).cast("binary"))),
        _PAIR: F.unhex(F.md5(pair.cast("binary"))),
    }


def keep_new(
    batch: DataFrame,
    accepted: AcceptedKeys,
    batch_id: str,
    order: list[str],
    limit_bytes: int = runtime.BROADCAST_BYTES,
    hot_min_rows: int = runtime.HOT_MIN_ROWS,
) -> DataFrame:
    """The postings of a batch that stay, with their digests, given what was kept before."""
    keyed, rows = runtime.cut_and_count(batch.withColumns(identity_keys()).withColumns(digests()))
    taken = runtime.cut_lineage(accepted.among(runtime.cut_lineage(accepted.of(keyed)), batch_id, limit_bytes))
    left = keyed
    if not taken.isEmpty():
        for key in (_ID, _PAIR):
            hot = runtime.hot_keys(keyed, key, rows, hot_min_rows)
            if hot is not None and left is not keyed:
                left = runtime.cut_lineage(left)
            left = runtime.split_by_membership(left, taken.withColumnRenamed("key", key), key, hot)
        left = runtime.cut_lineage(left)
    kept = greedy_dedup(left, order, ID_KEY, PAIR_KEY, hot_min_rows)
    return kept.select(*batch.columns, _ID, _PAIR)


def incremental_ingest(
    postings: DataFrame, accepted_path: str, state_path: str, order: list[str], buckets: int = BUCKETS
) -> StreamingQuery:
    """Run over what is available now: each micro-batch adds what is new to the table.

    A batch overwrites its own partition and adds its keys under its own number, which it does
    not ask when it is replayed, so that a failure at any step changes nothing.
    """
    path = accepted_path.rstrip("/")

    def add(batch: DataFrame, batch_id: int) -> None:
        accepted = AcceptedKeys(batch.sparkSession, f"{path}.keys", buckets)
        kept = runtime.cut_lineage(keep_new(batch, accepted, str(batch_id), order))
        kept.drop(_ID, _PAIR).write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")
        accepted.add(kept, str(batch_id))

    return (
        postings.writeStream.foreachBatch(add)
        .option("checkpointLocation", state_path)
        .trigger(availableNow=True)
        .start()
    )
