"""Session helpers: lineage cuts, size checks and skew-aware membership joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keys holding more than 1/HOT_SHARE of all rows are hot, so there are fewer than
# HOT_SHARE of them whatever the size of the data.
HOT_SHARE = 256
HOT_MIN_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the folder named in spark.checkpoint.dir; only local sessions may fall back."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
        configured = tempfile.mkdtemp(prefix="postmill-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder, so loops do not grow the plan."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_and_count(df: DataFrame, *more: Column) -> tuple:
    """(the rows after `cut_lineage`, their number, each further aggregate over them), by one
    job over what was written. Metrics observed during the write would save it, but a plan
    found empty at run time drops them, and whoever asks then waits for ever."""
    cut = cut_lineage(df)
    counted = cut.agg(F.count(F.lit(1)).alias("n0"), *(c.alias(f"n{i}") for i, c in enumerate(more, 1))).first()
    return cut, *(counted[f"n{i}"] or 0 for i in range(len(more) + 1))


def written_table(df: DataFrame, partition_by: str) -> DataFrame:
    """The rows as a table in the checkpoint folder, so that readers of one value of
    `partition_by` open only its files."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replace_path(spark: SparkSession, fresh: str, path: str) -> None:
    """Put a finished folder in the place of another; the old one goes last.

    Some file systems report a failed rename by its result alone, so results are checked,
    and the old folder goes back if the new one cannot take its place.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, old = hadoop.Path(path), hadoop.Path(f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"{path} cannot be moved; the new rows are in {fresh}")
    if not fs.rename(hadoop.Path(fresh), target):
        back = not had or fs.rename(old, target)
        raise OSError(f"{fresh} cannot take the place of {path}" + ("" if back else f", now in {old}"))
    if had:
        fs.delete(old, True)


def replaced_folders(spark: SparkSession, path: str) -> list[str]:
    """Old folders that an interrupted `replace_path` has left behind."""
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.old-*")
    found = old.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(old)
    return sorted(f.getPath().toString() for f in found or [])


def fits_broadcast(df: DataFrame, limit_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure a materialised narrow table against the broadcast limit.

    The width counted per row is its text form plus a fixed overhead for the hash table.
    """
    width = F.lit(64)
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.NumericType, T.BooleanType, T.DatetimeType)):
            width = width + F.lit(16)
        else:
            width = width + F.coalesce(F.octet_length(F.col(field.name).cast("string")), F.lit(0))
    size = df.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("b")).first()["b"]
    return size <= limit_bytes


def hot_keys(df: DataFrame, key: str, rows: int, min_rows: int = HOT_MIN_ROWS) -> DataFrame | None:
    """Keys holding more than 1/HOT_SHARE of `rows`; None when there are none.

    The count is aggregated before its shuffle, so a hot key costs one row per task.
    """
    if rows < min_rows:
        return None
    found = (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > F.lit(rows / HOT_SHARE))
        .select(key)
    )
    found = cut_lineage(found)
    return None if found.isEmpty() else found


def split_by_membership(
    left: DataFrame, keys: DataFrame, key: str, hot: DataFrame | None = None, keep_members: bool = False
) -> DataFrame:
    """Rows of `left` whose key is in `keys` (keep_members) or is not; `keys` is one
    column with one row per key.

    Rows under hot keys never reach the shuffle: the verdict on those keys is a table of
    fewer than HOT_SHARE rows, joined by broadcast. `left` is read twice in that case, so
    pass a checkpointed table.
    """
    how = "left_semi" if keep_members else "left_anti"
    if hot is None:
        return left.join(keys, key, how)
    verdict = hot.join(keys.withColumn("_member", F.lit(True)), key, "left").select(
        key, F.col("_member").isNotNull().alias("_member")
    )
    marked = left.join(F.broadcast(verdict), key, "left")
    decided = marked.filter(F.col("_member") == F.lit(keep_members))
    open_rows = marked.filter(F.col("_member").isNull()).join(keys, key, how)
    return decided.unionByName(open_rows).select(left.columns)


def skew_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None = None) -> DataFrame:
    """Inner join where `right` has one row per key and `left` may have hot keys.

    Rows under hot keys meet their fewer than HOT_SHARE partners by broadcast, if those
    measure small; all others are shuffled.
    """
    if hot is None:
        return left.join(right, key)
    partners = cut_lineage(right.join(F.broadcast(hot), key, "left_semi"))
    if not fits_broadcast(partners):
        return left.join(right, key)
    hot_rows = left.join(F.broadcast(partners), key)
    cold_rows = left.join(F.broadcast(hot), key, "left_anti").join(right, key)
    return hot_rows.unionByName(cold_rows)
