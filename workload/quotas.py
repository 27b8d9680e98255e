"""Quotas, stop rules and run metrics over events: the type is the position, the hour the page."""

from pyspark.sql import functions as F

from postmill.operators import metrics, quota
from workload.registry import query

# Every position has a page for every hour; n counts the events of large value.
_COUNTS = """
counts AS (
    SELECT p.position, CAST(h.page AS INTEGER) AS page, coalesce(c.n, 0) AS n, coalesce(c.events, 0) AS events
    FROM (SELECT DISTINCT event_type AS position FROM events) p
    CROSS JOIN (SELECT unnest(range(0, (SELECT max(date_diff('hour', TIMESTAMP '2024-01-01', ts)) + 1 FROM events))) AS page) h
    LEFT JOIN (SELECT event_type AS position, date_diff('hour', TIMESTAMP '2024-01-01', ts) AS page,
                      count(*) FILTER (value > 60) AS n, count(*) AS events
               FROM events GROUP BY 1, 2) c ON c.position = p.position AND c.page = h.page)
"""
_BEFORE = "coalesce(sum(n) OVER (PARTITION BY position ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"


def counts(t):
    hour = F.timestamp_diff("HOUR", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts")).cast("int")
    per_hour = (
        t.events.withColumn("page", hour).groupBy(F.col("event_type").alias("position"), "page")
        .agg(F.count_if(F.col("value") > 60).alias("n"), F.count(F.lit(1)).alias("events"))
    )
    last = t.events.agg(F.max(hour).alias("m")).first()["m"]
    grid = t.events.select(F.col("event_type").alias("position")).distinct().select(
        "position", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("page")
    )
    return grid.join(per_hour, ["position", "page"], "left").fillna(0, ["n", "events"])


@query(f"WITH {_COUNTS} SELECT position, page, n FROM (SELECT *, {_BEFORE} AS b FROM counts) WHERE b < 40")
def position_quota(t):
    return quota.position_quota(counts(t), 40, block=100).select("position", "page", "n")


@query(
    f"""WITH {_COUNTS}, own AS (SELECT * FROM (SELECT *, {_BEFORE} AS b FROM counts) WHERE b < 40),
    room AS (SELECT position, 130 - coalesce(sum(n) OVER (ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING
             AND 1 PRECEDING), 0) AS room FROM (SELECT position, sum(n) AS n FROM own GROUP BY position))
    SELECT own.position, page, n FROM own JOIN room ON room.position = own.position WHERE b < room"""
)
def total_quota(t):
    return quota.total_quota(counts(t), "position", 40, 130, block=100).select("position", "page", "n")


_EMPTY_STOP = """stops AS (SELECT position, min(page) AS stop FROM (
    SELECT position, page, sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) OVER
        (PARTITION BY position ORDER BY page ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS e FROM counts)
    WHERE e = 5 GROUP BY position)"""


@query(
    f"""WITH {_COUNTS}, {_EMPTY_STOP} SELECT c.position, page, n FROM counts c LEFT JOIN stops s
    ON s.position = c.position WHERE stop IS NULL OR page <= stop"""
)
def empty_run_stop(t):
    return quota.empty_run_stop(counts(t), block=100).select("position", "page", "n")


_FAILED_STOP = """failures AS (SELECT position, min(page) AS fail FROM counts WHERE events > 9 GROUP BY position)"""


@query(
    f"""WITH {_COUNTS}, {_FAILED_STOP} SELECT c.position, page, n FROM counts c LEFT JOIN failures s
    ON s.position = c.position WHERE fail IS NULL OR page < fail"""
)
def failed_page_stop(t):
    return quota.failed_page_stop(counts(t), F.col("events") > 9).select("position", "page", "n")


@query(
    f"""WITH {_COUNTS}, {_EMPTY_STOP}, {_FAILED_STOP},
    own AS (SELECT * FROM (SELECT c.*, {_BEFORE} AS b, stop, fail FROM counts c
        LEFT JOIN stops USING (position) LEFT JOIN failures USING (position))
        WHERE b < 40 AND (stop IS NULL OR page <= stop) AND (fail IS NULL OR page < fail)),
    room AS (SELECT position, 60 - coalesce(sum(n) OVER (ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING
             AND 1 PRECEDING), 0) AS room FROM (SELECT position, sum(n) AS n FROM own GROUP BY position))
    SELECT own.position, page, n FROM own JOIN room ON room.position = own.position WHERE b < room""".replace(
        "PARTITION BY position ORDER BY page ROWS BETWEEN UNBOUNDED", "PARTITION BY c.position ORDER BY page ROWS BETWEEN UNBOUNDED"
    ),
    name="page_stop_rules",
)
def all_rules(t):
    used = quota.pages_used(counts(t), "position", 40, 60, F.col("events") > 9, block=100)
    return used.select("position", "page", "n")


@query(
    f"""WITH {_COUNTS} SELECT position, page, n,
    CAST(sum(n) OVER (PARTITION BY position ORDER BY page) AS BIGINT) AS position_total,
    CAST(sum(n) OVER (ORDER BY position, page) AS BIGINT) AS run_total FROM counts"""
)
def progress_metrics(t):
    return metrics.progress_metrics(counts(t).drop("events"), "position", block=100)


@query("SELECT event_type AS source, CAST(sum(event_id % 1000) AS BIGINT) AS used_tokens FROM events GROUP BY event_type")
def token_accounting(t):
    spent = t.events.select(F.col("event_type").alias("source"), (F.col("event_id") % 1000).alias("token_cost"))
    return metrics.token_accounting(spent)


@query("SELECT count(*) AS n_rows FROM lineitem")
def row_count(t):
    return metrics.row_count(t.lineitem)
