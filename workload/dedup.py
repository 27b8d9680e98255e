"""Greedy de-duplication, in one batch and from a stream."""

from pyspark.sql import functions as F

from postmill.operators.greedy import greedy_dedup
from postmill.streaming.ingest import incremental_ingest as ingest
from workload.registry import query, scratch


def sql_greedy(edges: str) -> str:
    """Rounds as a recursive query over (o, i, p): first on both keys stays."""
    return f"""
    WITH RECURSIVE rounds(o, i, p, kept) AS (
        SELECT o, i, p, false FROM ({edges})
        UNION ALL
        SELECT o, i, p, wins FROM (
            SELECT *, bool_or(wins) OVER (PARTITION BY i) OR bool_or(wins) OVER (PARTITION BY p) AS settled
            FROM (SELECT o, i, p, o = min(o) OVER (PARTITION BY i) AND o = min(o) OVER (PARTITION BY p) AS wins
                  FROM rounds WHERE NOT kept))
        WHERE wins OR NOT settled)
    SELECT o, i, p FROM rounds WHERE kept"""


@query(sql_greedy("SELECT o_orderkey AS o, o_custkey AS i, CAST(o_orderdate AS VARCHAR) AS p FROM orders"))
def greedy_dedup_orders(t):
    edges = t.orders.select(
        F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("i"), F.col("o_orderdate").cast("string").alias("p")
    )
    return greedy_dedup(edges, ["o"], "i", "p")


@query(
    sql_greedy(
        """SELECT l_orderkey * 100 + l_linenumber AS o, min(l_partkey) AS i, min(l_suppkey) AS p FROM lineitem
        GROUP BY l_orderkey, l_linenumber"""
    )
)
def greedy_dedup_lineitem(t):
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("i"), F.min("l_suppkey").alias("p")
    )
    edges = lines.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("o"), "i", "p")
    return greedy_dedup(edges, ["o"], "i", "p")


@query(
    """SELECT event_id AS o, (event_id + 1) // 2 AS i, event_id // 2 AS p FROM (
        SELECT event_id, row_number() OVER (PARTITION BY island ORDER BY event_id) AS place
        FROM (SELECT event_id, event_id - row_number() OVER (ORDER BY event_id) AS island FROM (SELECT DISTINCT event_id FROM events)))
    WHERE place % 2 = 1"""
)
def greedy_dedup_chain(t):
    """Neighbouring events share one key or the other, so all events are one chain of conflicts."""
    key = F.col("event_id")
    edges = t.events.select(key.alias("o"), F.floor((key + 1) / 2).alias("i"), F.floor(key / 2).alias("p")).distinct()
    return greedy_dedup(edges, ["o"], "i", "p")


_EVENTS = "SELECT event_id AS o, user_id AS i, event_type || props AS p FROM events"


@query(sql_greedy(_EVENTS), name="greedy_dedup")
def greedy_dedup_events(t):
    edges = t.events.select(
        F.col("event_id").alias("o"), F.col("user_id").alias("i"), F.concat("event_type", "props").alias("p")
    )
    return greedy_dedup(edges, ["o"], "i", "p")


@query(sql_greedy(_EVENTS))
def incremental_ingest(t):
    """The events arrive as four files, one micro-batch each, and are kept as they come."""
    spark, folder = t.spark, scratch(t.spark)
    postings = t.events.select(
        F.col("event_id").alias("o"), F.col("user_id").cast("string").alias("job_id"),
        F.col("event_type").alias("title"), F.col("props").alias("company"),
    )
    bounds = t.events.agg(F.min("event_id").alias("a"), F.max("event_id").alias("b")).first()
    step = (bounds.b - bounds.a) // 4 + 1
    for part in range(4):
        low = bounds.a + part * step
        share = postings.filter(F.col("o").between(low, low + step - 1))
        share.coalesce(1).write.mode("append").parquet(f"{folder}/arrivals")
    arrivals = spark.readStream.schema(postings.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/arrivals")
    stream = ingest(arrivals, f"{folder}/accepted", f"{folder}/state", ["o"])
    stream.awaitTermination()
    accepted = spark.read.parquet(f"{folder}/accepted")
    return accepted.select(
        "o", F.col("job_id").cast("long").alias("i"), F.concat("title", "company").alias("p")
    )
