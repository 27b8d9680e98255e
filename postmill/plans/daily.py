"""A whole run: earlier postings in, new ones added, snapshot and report out."""

from __future__ import annotations

import uuid
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.config import BoardASearch
from postmill.operators.report import (
    boards_union,
    column_titles,
    language_flags,
    link_label,
    report_projection,
    report_sort,
)
from postmill.plans.board_a import run_board_a
from postmill.plans.run import Run, quarantine_union
from postmill.sources.report_sink import report_sink
from postmill.sources.snapshot import keep_quarantined, snapshot_read, snapshot_write
from postmill.sources.snapshot_log import SnapshotLog


def run_and_save(
    pages: DataFrame,
    search: BoardASearch,
    as_of: datetime | str,
    detector,
    snapshot_path: str,
    report_path: str,
    analyser=None,
    layout: str = "lines",
    run_id: str | None = None,
) -> Run:
    """Load the snapshot, run board A, save everything kept and write the report.

    With layout "log" the snapshot is a `SnapshotLog`, to which the run adds its postings.
    The other layouts are replaced whole: records that cannot be read move to
    `<snapshot_path>.quarantine` first, and the run gives back all that are there. A run
    that is repeated after a break under its `run_id` adds nothing twice.
    """
    spark, run_id = pages.sparkSession, run_id or uuid.uuid4().hex
    if layout == "log":
        log = SnapshotLog(spark, snapshot_path)
        prior = log.read()
        run = run_board_a(pages, search, as_of, detector, prior, analyser)
        log.append(run.postings.select(prior.columns), run_id)
        write_report(log.read(), report_path)
        return run
    prior, failing = snapshot_read(spark, snapshot_path, layout)
    unreadable = keep_quarantined(failing, snapshot_path, run_id)
    run = run_board_a(pages, search, as_of, detector, prior, analyser)
    everything = boards_union(prior, run.postings.select(prior.columns))
    snapshot_write(everything, snapshot_path, layout)
    saved, _ = snapshot_read(spark, snapshot_path, layout)
    write_report(saved, report_path)
    return replace(run, quarantined=quarantine_union(run.quarantined, unreadable))


def write_report(postings: DataFrame, path: str, layout: str = "csv") -> None:
    """Sorted, titled report; equal dates are ordered by id, title and url."""
    ordered = report_sort(postings, ["job_id", "title", "url"])
    report = report_projection(ordered)
    if layout == "parquet":
        report_sink(report, path, layout)
    else:
        report_sink(column_titles(report), path)


def sorted_report(postings: DataFrame, order: list[str]) -> DataFrame:
    """Report columns, sorted, with a link label and language flags beside them."""
    flagged = language_flags(report_sort(postings, order))
    return flagged.withColumn("link", link_label(F.col("url")))
