"""Posting snapshots."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from postmill import runtime
from postmill.operators.filters import quarantine_split
from postmill.schema import STORED_SCHEMA, conform
from postmill.sources.json_array import array_elements

_CORRUPT = "_corrupt_record"
_TIMES = ["posted_time", "date_analyzed"]
_NUMBERS = ["experience_years_needed", "salary_offered"]
_PARSING = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
LAYOUTS = ("lines", "array", "parquet")
_TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"

# Fields are read as text and cast one by one, so one odd value never costs a record.
_RAW_SCHEMA = T.StructType(
    [
        T.StructField(f.name, f.dataType if isinstance(f.dataType, T.ArrayType) else T.StringType())
        for f in STORED_SCHEMA.fields
    ]
    + [T.StructField(_CORRUPT, T.StringType())]
)


def snapshot_read(spark: SparkSession, path: str, layout: str = "lines") -> tuple[DataFrame, DataFrame]:
    """(postings, quarantined records) of a snapshot; a missing path is an empty snapshot.

    `layout` is "lines" (one object per line), "parquet" or "array" (JSON arrays, usually
    one per file); files of any of them are split across tasks. Unknown keys are dropped,
    absent keys and nulls take the posting defaults, and records that cannot be read are
    kept apart with a reason.
    A path that an interrupted write has moved away is an error, not an empty snapshot.
    """
    _check_layout(layout)
    try:
        if layout == "parquet":
            stored = spark.read.parquet(path)
            return conform(stored), spark.createDataFrame([], _quarantine_schema())
        if layout == "array":
            raw = parsed_records(array_elements(spark, path))
        else:
            raw = spark.read.schema(_RAW_SCHEMA).options(**_PARSING).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        if left := runtime.replaced_folders(spark, path):
            raise RuntimeError(f"a write to {path} was interrupted; put {left[-1]} back first") from error
        return (
            spark.createDataFrame([], STORED_SCHEMA),
            spark.createDataFrame([], _quarantine_schema()),
        )
    return split_records(raw)


def parsed_records(texts: DataFrame) -> DataFrame:
    """Raw records out of (value), JSON text each; what is no object is corrupt."""
    record = F.from_json(F.when(F.startswith("value", F.lit("{")), F.col("value")), _RAW_SCHEMA, _PARSING)
    parsed = texts.withColumn("_r", record).select("value", "_r.*")
    return parsed.withColumn(
        _CORRUPT, F.when(F.startswith("value", F.lit("{")), F.col(_CORRUPT)).otherwise(F.col("value"))
    ).drop("value")


def _check_layout(layout: str) -> None:
    if layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {', '.join(LAYOUTS)}, not {layout!r}")


def _quarantine_schema() -> T.StructType:
    return T.StructType(_RAW_SCHEMA.fields + [T.StructField("reason", T.StringType())])


def split_records(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw records into typed postings and quarantined records."""

    def readable(name):
        text = F.coalesce(F.col(name), F.lit(""))
        return (text == "") | F.try_to_timestamp(text).isNotNull()

    checks = {"malformed record": F.col(_CORRUPT).isNull()}
    checks |= {f"unreadable {name}": readable(name) for name in _TIMES}
    usable, failing = quarantine_split(raw, checks)
    number = {name: F.col(name).try_cast("int") for name in _NUMBERS}
    # A salary stated as text, or a flag stored as a boolean, comes from board B.
    number["salary_text"] = F.coalesce(
        F.col("salary_text"), F.when(number["salary_offered"].isNull(), F.col("salary_offered"))
    )
    number["easy_apply"] = (
        F.when(F.col("easy_apply") == "true", "Yes").when(F.col("easy_apply") == "false", "No")
        .otherwise(F.col("easy_apply"))
    )
    times = {name: F.when(F.col(name) != "", F.try_to_timestamp(name)) for name in _TIMES}
    return conform(usable.withColumns(number | times)), failing


def snapshot_write(postings: DataFrame, path: str, layout: str = "lines") -> None:
    """Replace the snapshot with all postings.

    The rows usually derive from the snapshot being replaced, so they are written beside
    it and take its place when complete. Each file of layout "array" is one JSON array.
    """
    _check_layout(layout)
    fresh = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    rows = conform(postings)
    options = {"timestampFormat": _TIMESTAMP_FORMAT, "ignoreNullFields": "false"}
    if layout == "parquet":
        rows.write.parquet(fresh)
    elif layout == "array":
        records = rows.select(F.to_json(F.struct("*"), options).alias("value"))
        records.mapInArrow(_as_array, "value string").write.text(fresh)
    else:
        rows.write.options(**options).json(fresh)
    runtime.replace_path(postings.sparkSession, fresh, path)


def _as_array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of a partition as the lines of one JSON array."""
    mark = "["
    for batch in batches:
        lines = []
        for record in batch.column(0).to_pylist():
            lines.append(mark + record)
            mark = ","
        yield pa.RecordBatch.from_pydict({"value": pa.array(lines, pa.string())})
    yield pa.RecordBatch.from_pydict({"value": ["[]" if mark == "[" else "]"]})


def keep_quarantined(failing: DataFrame, path: str, run_id: str) -> DataFrame:
    """Add the unreadable records of a run to the folder beside the snapshot; all so far.

    A run has a folder of its own and overwrites it, so repeating one adds nothing twice.
    """
    folder = f"{path.rstrip('/')}.quarantine"
    failing.write.mode("overwrite").parquet(f"{folder}/run={run_id}")
    stored = T.StructType([*_quarantine_schema().fields, T.StructField("run", T.StringType())])
    return failing.sparkSession.read.schema(stored).parquet(folder).drop("run")
