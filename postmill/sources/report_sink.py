"""Writing the ordered report."""

from __future__ import annotations

from pyspark.sql import DataFrame

_TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def report_sink(report: DataFrame, path: str, layout: str = "csv") -> None:
    """Write a sorted report; file names follow its order."""
    writer = report.write.mode("overwrite")
    if layout == "parquet":
        writer.parquet(path)
    else:
        writer.option("header", True).option("timestampFormat", _TIMESTAMP_FORMAT).csv(path)
