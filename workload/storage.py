"""Snapshots and reports written and read back."""

from pyspark.sql import functions as F

from postmill.fixed_values import SOURCE_A
from postmill.plans.daily import write_report
from postmill.sources.snapshot import snapshot_read as read
from postmill.sources.snapshot import snapshot_write as write
from postmill.sources.snapshot_log import SnapshotLog
from workload.registry import SQL_MILLIS, millis, query, scratch, utc
from workload.reports import postings


def _lines(t):
    """Orders as JSON lines; some have defects of each kind."""
    key = F.col("o_orderkey")
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    time = (
        F.when(key % 4 == 0, F.concat(date, F.lit("T10:00:00Z"))).when(key % 4 == 1, F.concat(date, F.lit("T12:00:00+02:00")))
        .when(key % 4 == 2, F.concat(date, F.lit("T10:00:00.250000"))).otherwise(F.concat(date, F.lit("T10:00:00")))
    )
    time = F.when(key % 10 == 7, F.lit("not a date")).otherwise(time)
    record = F.to_json(
        F.struct(
            key.cast("string").alias("job_id"), F.concat(F.lit("é "), "o_orderpriority").alias("title"),
            time.alias("posted_time"), F.array("o_orderstatus").alias("technologies_required"),
            F.col("o_custkey").cast("int").alias("experience_years_needed"),
            F.when(key % 6 == 0, F.lit("10 - 20 YEARLY")).alias("salary_offered"), F.lit(1).alias("unknown_key"),
        )
    )
    broken = F.when(key % 10 == 3, F.concat(F.lit('{"job_id": "'), key, F.lit('", "title": '))).otherwise(record)
    folder = scratch(t.spark)
    t.orders.select(broken.alias("value")).write.text(folder)
    return read(t.spark, folder)


@query(
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS job_id, 'é ' || o_orderpriority AS title, '' AS company,
    {SQL_MILLIS.format("o_orderdate + INTERVAL 10 HOUR + CASE WHEN o_orderkey % 4 = 2 THEN INTERVAL 250 MILLISECOND ELSE INTERVAL 0 HOUR END")}
    AS posted_time, o_orderstatus AS technologies, CAST(o_custkey AS INTEGER) AS years, 0 AS salary,
    CASE WHEN o_orderkey % 6 = 0 THEN '10 - 20 YEARLY' END AS salary_text, 'No' AS easy_apply, '{SOURCE_A}' AS source
    FROM orders WHERE o_orderkey % 10 NOT IN (3, 7)"""
)
def snapshot_read(t):
    good, _ = _lines(t)
    return good.select(
        "job_id", "title", "company", millis(F.col("posted_time")).alias("posted_time"),
        F.array_join("technologies_required", ", ").alias("technologies"),
        F.col("experience_years_needed").alias("years"), F.col("salary_offered").alias("salary"), "salary_text",
        "easy_apply", "source",
    )


@query(
    """SELECT CASE WHEN o_orderkey % 10 = 7 THEN CAST(o_orderkey AS VARCHAR) END AS job_id,
    CASE WHEN o_orderkey % 10 = 3 THEN 'malformed record' ELSE 'unreadable posted_time' END AS reason
    FROM orders WHERE o_orderkey % 10 IN (3, 7)"""
)
def quarantine_split(t):
    _, failing = _lines(t)
    identified = F.when(F.col("reason") != "malformed record", F.col("job_id"))
    return failing.select(identified.alias("job_id"), "reason")


@query(
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS job_id, o_orderpriority || ' jöb' AS title,
    {SQL_MILLIS.format('o_orderdate')} AS posted_time, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END
    AS technologies, CAST(o_custkey AS INTEGER) AS years FROM orders"""
)
def snapshot_write(t):
    folder = scratch(t.spark)
    rows = t.orders.select(
        F.col("o_orderkey").cast("string").alias("job_id"), F.concat("o_orderpriority", F.lit(" jöb")).alias("title"),
        utc("o_orderdate").alias("posted_time"),
        F.when(F.col("o_orderstatus") != "P", F.array("o_orderstatus")).alias("technologies_required"),
        F.col("o_custkey").alias("experience_years_needed"),
    )
    write(rows, folder)
    saved, _ = read(t.spark, folder)
    write(saved, folder)
    return read(t.spark, folder)[0].select(
        "job_id", "title", millis(F.col("posted_time")).alias("posted_time"),
        F.array_join("technologies_required", ", ").alias("technologies"),
        F.col("experience_years_needed").alias("years"),
    )


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS "Job Id", strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS "Posted Time",
    CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'https://x/' || o_orderkey END AS "Url",
    o_orderpriority || ', ' || o_orderstatus AS "Technologies Required" FROM orders"""
)
def report_sink(t):
    folder = scratch(t.spark)
    rows = postings(t)
    rows = rows.withColumns({c: utc(c) for c in ("posted_time", "date_analyzed")})
    write_report(rows, folder)
    return t.spark.read.option("header", True).csv(folder).select("Job Id", "Posted Time", "Url", "Technologies Required")


_SQL_STORED = f"""SELECT CAST(o_orderkey AS VARCHAR) AS job_id, o_orderpriority || ' "}}{{[' AS title,
    {SQL_MILLIS.format('o_orderdate')} AS posted_time, o_orderstatus || ', \\"}}' AS technologies,
    CAST(o_custkey AS INTEGER) AS years FROM orders"""


def _stored(t):
    """Orders as postings, with texts that look like the ends of records."""
    return t.orders.select(
        F.col("o_orderkey").cast("string").alias("job_id"), F.concat("o_orderpriority", F.lit(' "}{[')).alias("title"),
        utc("o_orderdate").alias("posted_time"), F.array("o_orderstatus", F.lit('\\"}')).alias("technologies_required"),
        F.col("o_custkey").alias("experience_years_needed"),
    )


def _shown(postings):
    return postings.select(
        "job_id", "title", millis(F.col("posted_time")).alias("posted_time"),
        F.array_join("technologies_required", ", ").alias("technologies"), F.col("experience_years_needed").alias("years"),
    )


@query(_SQL_STORED)
def snapshot_array(t):
    """JSON arrays, read in as many parts as their files have splits."""
    folder = scratch(t.spark)
    write(_stored(t), folder, "array")
    return _shown(read(t.spark, folder, "array")[0])


@query(_SQL_STORED)
def snapshot_log(t):
    """Orders appended in three runs, one of them twice under its token, and merged at the end."""
    log = SnapshotLog(t.spark, scratch(t.spark))
    for run in (0, 1, 1, 2):
        log.append(_stored(t).filter(F.pmod(F.col("job_id").cast("long"), F.lit(3)) == run), f"run {run}")
        if run == 0:
            log.compact()
    log.compact(but_last=1)
    return _shown(log.read())
