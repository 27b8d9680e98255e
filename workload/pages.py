"""Search addresses, stored pages and the joins around them."""

from pyspark.sql import functions as F

from postmill import BoardASearch
from postmill import fixed_values as fixed
from postmill.functions import addresses, codes
from postmill.operators.filters import valid_link_filter
from postmill.operators.joins import anti_join_prior
from postmill.operators.joins import card_detail_join as join_details
from postmill.sources import frontier, page_store
from workload.registry import query, scratch

SQL_ENCODE = "replace(replace(url_encode({}), '%20', '+'), '%7E', '~')"
SEARCH = BoardASearch(location="New York", publish_timespan="Month", easy_apply=False)


@query(
    """SELECT p_partkey, CAST(i - 1 AS INTEGER) AS position_no, string_split(positions, ',')[i] AS position
    FROM (SELECT p_partkey, p_name || ', ' || p_type || ',' || p_brand AS positions FROM part),
    UNNEST([1, 2, 3]) AS u(i)"""
)
def position_split(t):
    positions = F.concat("p_name", F.lit(", "), "p_type", F.lit(","), "p_brand")
    split = frontier.position_split(t.part.select("p_partkey", positions.alias("positions")), F.col("positions"))
    return split.drop("positions")


_PHRASES = "SELECT p_partkey, p_name || ' ~*é/' || p_brand AS position FROM part"


def _phrases(t):
    return t.part.select("p_partkey", F.concat("p_name", F.lit(" ~*é/"), "p_brand").alias("position"))


@query(f"SELECT p_partkey, position, CAST(page AS INTEGER) AS page FROM ({_PHRASES}), range(0, 4) AS r(page)")
def frontier_cross(t):
    return frontier.frontier_cross(_phrases(t), 0, 3)


@query(
    f"""SELECT p_partkey, position, CAST(page AS INTEGER) AS page,
    '{fixed.BOARD_A_SEARCH_URL}?start=' || (page * 10) || '&location=New+York&f_E=4&f_JT=2&f_WT=2&keywords='
    || {SQL_ENCODE.format('position')} || '&f_JIYN=true&f_TPR=r2592000' AS url
    FROM ({_PHRASES}), range(0, 4) AS r(page)"""
)
def search_frontier_a(t):
    return frontier.with_search_url_a(frontier.frontier_cross(_phrases(t), 0, 3), SEARCH)


@query(
    f"""SELECT p_partkey, '{fixed.BOARD_B_BASE_URL}/jobs?q=' || {SQL_ENCODE.format('position')}
    || '&l=Paris&fromage=' || p_size || CASE WHEN p_size % 2 = 0 THEN '{fixed.BOARD_B_REMOTE_SUFFIX}' ELSE '' END
    AS url FROM (SELECT *, p_name || ' ~*é/' || p_brand AS position FROM part)"""
)
def search_frontier_b(t):
    url = addresses.board_b_search_url(
        F.concat("p_name", F.lit(" ~*é/"), "p_brand"), F.lit("Paris"), F.col("p_size"), F.col("p_size") % 2 == 0
    )
    return t.part.select("p_partkey", url.alias("url"))


@query(
    f"""SELECT p_partkey, '{fixed.BOARD_A_DETAIL_URL}' || p_partkey AS path_form,
    '{fixed.BOARD_B_BASE_URL}/viewjob?jk=' || p_partkey AS query_form FROM part"""
)
def detail_url(t):
    key = F.col("p_partkey").cast("string")
    return t.part.select(
        "p_partkey",
        addresses.board_a_detail_url(key).alias("path_form"),
        addresses.board_b_detail_url(key).alias("query_form"),
    )


_NAMES = "['On-site', 'Remote', 'Hybrid', 'Mid-Senior', 'Week', 'None', 'other'][CAST(event_id % 7 AS INT) + 1]"


@query(
    f"""SELECT event_id, name,
    CASE name WHEN 'On-site' THEN 1 WHEN 'Remote' THEN 2 WHEN 'Hybrid' THEN 3 END AS work_mode,
    CASE name WHEN 'Mid-Senior' THEN 4 END AS experience,
    CASE name WHEN 'Week' THEN 'r604800' WHEN 'None' THEN '' END AS timespan
    FROM (SELECT event_id, {_NAMES} AS name FROM events)"""
)
def code_lookup(t):
    names = F.array(*[F.lit(n) for n in ("On-site", "Remote", "Hybrid", "Mid-Senior", "Week", "None", "other")])
    named = t.events.select("event_id", F.get(names, (F.col("event_id") % 7).cast("int")).alias("name"))
    return named.select(
        "*",
        codes.code_lookup(fixed.WORK_MODE_CODES, F.col("name")).alias("work_mode"),
        codes.code_lookup(fixed.EXPERIENCE_CODES, F.col("name")).alias("experience"),
        codes.code_lookup(fixed.TIMESPAN_CODES, F.col("name")).alias("timespan"),
    )


@query(
    """SELECT o_orderpriority, count(*) AS n, CASE o_orderpriority WHEN '1-URGENT' THEN 6 WHEN '2-HIGH' THEN 5
    WHEN '3-MEDIUM' THEN 4 END AS code FROM orders GROUP BY o_orderpriority"""
)
def lookup_join(t):
    names = {"1-URGENT": "Executive", "2-HIGH": "Director", "3-MEDIUM": "Mid-Senior"}
    level = codes.code_lookup(names, F.col("o_orderpriority"))
    counts = t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("code", codes.code_lookup(fixed.EXPERIENCE_CODES, level))


# The frontier asks for every stored page and, for each document, a page that may not exist.
_FRONTIER = """(SELECT url FROM pages UNION ALL SELECT 'https://missing.example/' || doc_id FROM documents)"""


def _frontier(t):
    missing = t.documents.select(F.concat(F.lit("https://missing.example/"), "doc_id").alias("url"))
    return t.pages.select("url").unionByName(missing)


@query(
    f"""SELECT f.url, CAST(length(p.html) AS INTEGER) AS n_chars FROM {_FRONTIER} f LEFT JOIN pages p USING (url)"""
)
def frontier_fetch(t):
    fetched = page_store.frontier_fetch(_frontier(t), t.pages)
    return fetched.select("url", F.length("html").alias("n_chars"))


@query(
    f"""SELECT f.url, CAST(length(p.html) AS INTEGER) AS n_chars FROM {_FRONTIER} f LEFT JOIN pages p USING (url)"""
)
def frontier_fetch_stored(t):
    """A frontier too large to be sent, against pages laid out by address."""
    path = scratch(t.spark)
    page_store.store_pages(t.pages, path, 16)
    fetched = page_store.frontier_fetch(_frontier(t), page_store.open_store(t.spark, path, 16), limit_bytes=0)
    return fetched.select("url", F.length("html").alias("n_chars"))


@query(f"SELECT url FROM {_FRONTIER} f WHERE url NOT IN (SELECT url FROM pages)")
def missing_pages_filtered(t):
    """The same for a frontier too large to be sent: its Bloom filter goes to the pages."""
    return page_store.missing_pages(_frontier(t), t.pages, limit_bytes=0)


@query(f"SELECT url FROM {_FRONTIER} f WHERE url NOT IN (SELECT url FROM pages)")
def missing_pages(t):
    return page_store.missing_pages(_frontier(t), t.pages)


@query("SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)")
def card_detail_join(t):
    return join_details(t.documents.select("doc_id", "source"), t.labels, "doc_id")


_POSTINGS = """(SELECT l_orderkey, l_linenumber, CAST(l_orderkey % 9973 * 7 + l_linenumber AS VARCHAR) AS job_id,
    ' Part ' || l_partkey AS title, 'Supplier ' || l_suppkey || ' ' AS company, l_shipdate FROM lineitem)"""


@query(
    f"""SELECT l_orderkey, l_linenumber, job_id, title, company FROM {_POSTINGS} c
    WHERE l_shipdate >= TIMESTAMP '1995-06-01'
    AND NOT EXISTS (SELECT 1 FROM {_POSTINGS} p WHERE p.l_shipdate < TIMESTAMP '1995-06-01' AND p.job_id = c.job_id)
    AND NOT EXISTS (SELECT 1 FROM {_POSTINGS} p WHERE p.l_shipdate < TIMESTAMP '1995-06-01'
                    AND lower(trim(p.title)) = lower(trim(c.title))
                    AND lower(trim(p.company)) = lower(trim(c.company)))""",
    name="anti_join_prior",
)
def kept_before(t):
    postings = t.lineitem.select(
        "l_orderkey", "l_linenumber", (F.col("l_orderkey") % 9973 * 7 + F.col("l_linenumber")).cast("string").alias("job_id"),
        F.concat(F.lit(" Part "), "l_partkey").alias("title"),
        F.concat(F.lit("Supplier "), "l_suppkey", F.lit(" ")).alias("company"), "l_shipdate",
    )
    start = F.lit("1995-06-01").cast("timestamp_ntz")
    prior = postings.filter(F.col("l_shipdate") < start).withColumn("title", F.upper("title"))
    cards = postings.filter(F.col("l_shipdate") >= start).drop("l_shipdate")
    return anti_join_prior(cards, prior)


@query(
    """SELECT doc_id, url FROM (SELECT doc_id, CASE WHEN source LIKE '%1%' THEN source ELSE '' END AS url
    FROM documents) WHERE url <> ''""",
    name="valid_link_filter",
)
def links(t):
    url = F.when(F.contains("source", F.lit("1")), F.col("source")).otherwise(F.lit(""))
    return valid_link_filter(t.documents.select("doc_id", url.alias("url")))
