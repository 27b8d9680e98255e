"""Report columns over orders taken as postings."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from postmill import fixed_values as fixed
from postmill.operators import report
from postmill.runtime import cut_lineage
from workload.registry import query

SQL_POSTINGS = """(SELECT CAST(o_orderkey AS VARCHAR) AS job_id, o_orderpriority || ' job ' || o_custkey AS title,
    CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'https://x/' || o_orderkey END AS url, 'Co ' || o_custkey AS company,
    o_orderdate AS posted_time, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE TIMESTAMP '2024-01-01' END AS date_analyzed,
    CASE o_orderstatus WHEN 'O' THEN 'EN' WHEN 'F' THEN 'fr' ELSE '' END AS title_lang,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'es' END AS description_lang,
    o_orderpriority || ', ' || o_orderstatus AS technologies_required, o_orderkey AS row_no FROM orders)"""


def postings(t):
    key = F.col("o_orderkey")
    return t.orders.select(
        key.cast("string").alias("job_id"), F.concat("o_orderpriority", F.lit(" job "), "o_custkey").alias("title"),
        F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("https://x/"), key)).alias("url"),
        F.concat(F.lit("Co "), "o_custkey").alias("company"), F.col("o_orderdate").alias("posted_time"),
        F.when(F.col("o_orderstatus") != "P", F.lit("2024-01-01").cast("timestamp_ntz")).alias("date_analyzed"),
        F.when(F.col("o_orderstatus") == "O", "EN").when(F.col("o_orderstatus") == "F", "fr").otherwise("").alias("title_lang"),
        F.when(key % 3 != 0, "es").alias("description_lang"),
        F.array("o_orderpriority", "o_orderstatus").alias("technologies_required"), key.alias("row_no"),
    )


_PRESENT = {"title", "date_analyzed", "posted_time", "technologies_required", "company", "job_id", "title_lang",
            "description_lang", "url"}
_SQL_REPORT = ", ".join(c if c in _PRESENT else f"'' AS {c}" for c in fixed.REPORT_COLUMNS)


@query(f"SELECT {_SQL_REPORT} FROM {SQL_POSTINGS}")
def report_projection(t):
    return report.report_projection(postings(t))


@query("SELECT o_orderkey, o_orderpriority || ', ' || o_orderstatus AS listed FROM orders")
def array_to_text(t):
    values = F.array("o_orderpriority", "o_orderstatus")
    return t.orders.select("o_orderkey", report.array_to_text(values).alias("listed"))


@query(
    f"""SELECT row_no, row_number() OVER (ORDER BY date_analyzed DESC NULLS LAST, posted_time DESC NULLS LAST, row_no)
    AS place FROM {SQL_POSTINGS}"""
)
def report_sort(t):
    """Places are read off the sorted partitions: rows before the partition plus rows in it."""
    ordered = report.report_sort(postings(t), ["row_no"]).select("row_no").withColumns({
        "_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id(),
    })
    ordered = cut_lineage(ordered)
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    placed = ordered.join(F.broadcast(offsets), "_part")
    return placed.select("row_no", (F.col("_offset") + F.col("_id") - F.col("_first") + 1).alias("place"))


@query(
    """SELECT doc_id, array_to_string(list_transform(list_filter(string_split(replace(source, '_', ' '), ' '),
    lambda w: w <> ''), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS shown FROM documents"""
)
def column_titles(t):
    return t.documents.select("doc_id", report.column_title(F.col("source")).alias("shown"))


@query(
    f"""SELECT row_no, coalesce(title_lang <> '' AND lower(title_lang) <> 'en', false) AS title_flag,
    coalesce(description_lang <> '' AND lower(description_lang) <> 'en', false) AS description_flag FROM {SQL_POSTINGS}"""
)
def language_flags(t):
    return report.language_flags(postings(t)).select("row_no", "title_flag", "description_flag")


@query(f"SELECT row_no, CASE WHEN url <> '' THEN 'Link' END AS label, url FROM {SQL_POSTINGS}")
def link_label(t):
    return postings(t).select("row_no", report.link_label(F.col("url")).alias("label"), "url")


@query(
    f"""SELECT 'title' AS column_name, least(greatest(max(length(title)), 5) + 2, 50) AS width FROM {SQL_POSTINGS}
    UNION ALL SELECT 'company', least(greatest(max(length(company)), 7) + 2, 50) FROM {SQL_POSTINGS}
    UNION ALL SELECT 'posted_time', 21 UNION ALL SELECT 'description_lang', 18 UNION ALL SELECT 'url', 10"""
)
def column_width_profile(t):
    table = postings(t).select("title", "company", "posted_time", "description_lang", "url")
    return report.column_width_profile(table).withColumn("width", F.col("width").cast("long"))


@query(
    """SELECT 'A' || o_orderkey AS job_id, 'one' AS source, o_orderpriority AS seniority_level, NULL AS salary_text
    FROM orders UNION ALL SELECT 'B' || p_partkey, 'two', NULL, p_name FROM part"""
)
def boards_union(t):
    one = t.orders.select(
        F.concat(F.lit("A"), "o_orderkey").alias("job_id"), F.lit("one").alias("source"),
        F.col("o_orderpriority").alias("seniority_level"),
    )
    two = t.part.select(
        F.lit("two").alias("source"), F.concat(F.lit("B"), "p_partkey").alias("job_id"), F.col("p_name").alias("salary_text")
    )
    return report.boards_union(one, two)
