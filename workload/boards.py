"""Both boards over page stores derived from the stored pages and from events."""

from pyspark.sql import functions as F

from postmill import BoardASearch, BoardBSearch, StopWordDetector
from postmill import fixed_values as fixed
from postmill.functions import addresses, markup
from postmill.functions.enrichment import rule_analyser
from postmill.operators import cards, embedded
from postmill.operators.greedy import greedy_dedup
from postmill.operators.joins import ID_KEY, PAIR_KEY, identity_keys
from postmill.operators.language import language_filter
from postmill.operators.metrics import token_accounting
from postmill.operators.report import report_projection, report_sort
from postmill.plans.board_a import run_board_a
from postmill.plans.board_b import run_board_b
from postmill.schema import conform
from postmill.sources.frontier import with_search_url_a
from workload.language import sql_stop_word_lang, sql_stop_word_scores
from workload.registry import (
    SQL_MILLIS,
    millis,
    query,
    sql_collapse,
    sql_decode,
    sql_drop_markup,
    sql_element_text,
    sql_text,
    utc,
)

AS_OF = "2024-03-10 12:00:00"
POSITIONS = ["com", "net", "org"]
CARDS_A_PAGE = 40

# One posting per stored page: h1 is the title, the host the company, the number in the
# path the id, the article the description. The top-level domain is the search phrase and
# forty neighbouring pages share a result page.
_SQL_FIELDS = f"""
    SELECT page_id, url, html, host, number, position, CAST(page_id // {CARDS_A_PAGE} AS INTEGER) AS page,
        CAST(row_number() OVER (PARTITION BY position, page_id // {CARDS_A_PAGE} ORDER BY page_id) - 1 AS INTEGER) AS card,
        h1, article, CASE page_id % 5 WHEN 0 THEN page_id || ' hours ago' WHEN 1 THEN (page_id % 60) || ' days ago'
            WHEN 2 THEN '2 weeks ago' WHEN 3 THEN '' ELSE CASE WHEN page_id % 20 = 4 THEN 'yesterday' ELSE '1 day ago' END
            END AS age
    FROM (SELECT page_id, url, html, regexp_extract(url, '^https?://([^/]+)/', 1) AS host,
            regexp_extract(url, '/(\\d+)', 1) AS number, regexp_extract(url, '^https?://[^/]+\\.([a-z]+)/', 1) AS position,
            regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h1,
            regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS article
        FROM pages)"""


def posting_fields(t):
    key = F.col("page_id")
    age = (
        F.when(key % 5 == 0, F.concat(key, F.lit(" hours ago")))
        .when(key % 5 == 1, F.concat(key % 60, F.lit(" days ago"))).when(key % 5 == 2, F.lit("2 weeks ago"))
        .when(key % 5 == 3, F.lit("")).when(key % 20 == 4, F.lit("yesterday")).otherwise(F.lit("1 day ago"))
    )
    return t.pages.select(
        "page_id",
        F.regexp_extract("url", "^https?://([^/]+)/", 1).alias("host"),
        F.regexp_extract("url", r"/(\d+)", 1).alias("number"),
        F.regexp_extract("url", r"^https?://[^/]+\.([a-z]+)/", 1).alias("position"),
        F.floor(key / CARDS_A_PAGE).cast("int").alias("page"),
        F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1).alias("h1"),
        F.regexp_extract("html", "(?s)<article>(.*?)</article>", 1).alias("article"),
        age.alias("age"),
    )


def search_pages_a(t, search):
    """(position, page, url, html) with the cards of forty neighbouring pages."""
    card = F.concat(
        F.lit('<li class="r">\n<div class="base-card relative"><a class="base-card__full-link" href="https://'),
        "host", F.lit("/view/a-job-"), "number", F.lit('?ref=x"><span>see</span></a><div class="i"><h3 class="s__title">'),
        "h1", F.lit('</h3></div><h4 class="s__subtitle"> <a>'), "host",
        F.lit('</a></h4><span class="m__location">'), "position", F.lit('</span><time class="m__listdate">'),
        "age", F.lit("</time></div></li>"),
    )
    grouped = (
        posting_fields(t).groupBy("position", "page")
        .agg(F.array_sort(F.collect_list(F.struct("page_id", card.alias("card")))).alias("cards"))
        .withColumn("html", F.concat(F.lit("<ul>"), F.array_join(F.col("cards.card"), "\n"), F.lit("</ul>")))
    )
    return with_search_url_a(grouped, search).select("position", "page", "url", "html")


def detail_pages_a(t):
    """A detail page per id, with the article of the first posting that has the id."""
    first = posting_fields(t).groupBy("number").agg(
        F.min_by("article", "page_id").alias("article"), F.min_by("position", "page_id").alias("position")
    )
    html = F.concat(
        F.when(F.col("position") == "net", F.lit(f'<icon data-svg-class-name="{fixed.OFFSITE_ICON}"></icon>')).otherwise(""),
        F.lit('<div class="description__text"><section class="show"><div class="m">'), "article",
        F.lit(f'</div></section></div><ul class="{fixed.CRITERIA_LIST_CLASS}"><li><h3 class="{fixed.CRITERIA_LABEL_CLASS}">'
              f'Industries</h3><span class="{fixed.CRITERIA_VALUE_CLASS}">'), "position", F.lit("</span></li></ul>"),
    )
    return first.select(addresses.board_a_detail_url(F.col("number")).alias("url"), html.alias("html"))


@query(
    f"""SELECT position, page, card, 'https://' || host || '/view/a-job-' || number || '?ref=x' AS url,
    {sql_element_text('h1')} AS title, host AS company, age, position AS location FROM ({_SQL_FIELDS})"""
)
def card_explode(t):
    pages = search_pages_a(t, BoardASearch()).drop("url")
    return cards.card_explode(cards.page_cards(pages))


_CAPS = (30, 70)
_SQL_TITLED = f"""SELECT *, {sql_stop_word_lang()} AS title_lang FROM (SELECT *, {sql_stop_word_scores('title')}
    FROM (SELECT *, {sql_element_text('h1')} AS title FROM fields))"""
_SQL_DETAILS = f"""SELECT number, position AS industries, description, {sql_stop_word_lang()} AS description_lang
    FROM (SELECT *, {sql_stop_word_scores('description')} FROM (
        SELECT number, arg_min(position, page_id) AS position,
            {sql_collapse(sql_decode(sql_drop_markup('arg_min(article, page_id)', '')))} AS description
        FROM fields GROUP BY number"""


def _sql_position(k: int, position: str) -> str:
    """The walk over one position as common table expressions."""
    earlier = [f"SELECT * FROM new_{e}" for e in range(k)]
    taken = " UNION ALL ".join(earlier) or "SELECT * FROM candidates WHERE false"
    room = f"{_CAPS[1]} - (SELECT count(*) FROM ({taken}))"
    return f""",
    open_{k} AS (SELECT * FROM candidates c WHERE position = '{position}'
        AND number NOT IN (SELECT number FROM ({taken})) AND pair NOT IN (SELECT pair FROM ({taken}))),
    rounds_{k}(o, number, pair, kept) AS (
        SELECT o, number, pair, false FROM open_{k}
        UNION ALL
        SELECT o, number, pair, wins FROM (
            SELECT *, bool_or(wins) OVER (PARTITION BY number) OR bool_or(wins) OVER (PARTITION BY pair) AS settled
            FROM (SELECT o, number, pair,
                    o = min(o) OVER (PARTITION BY number) AND o = min(o) OVER (PARTITION BY pair) AS wins
                  FROM rounds_{k} WHERE NOT kept))
        WHERE wins OR NOT settled),
    fresh_{k} AS (SELECT * FROM open_{k} WHERE o IN (SELECT o FROM rounds_{k} WHERE kept)),
    counts_{k} AS (
        SELECT g.page, coalesce(f.n, 0) AS n, s.page IS NULL AS failed
        FROM (SELECT unnest(range(0, 1 + (SELECT max(page) + 1 FROM fields))) AS page) g
        LEFT JOIN (SELECT DISTINCT page FROM fields WHERE position = '{position}') s ON s.page = g.page
        LEFT JOIN (SELECT page, count(*) AS n FROM fresh_{k} GROUP BY page) f ON f.page = g.page),
    asked_{k} AS (SELECT * FROM (
            SELECT *, coalesce(max(ends) OVER (ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended
            FROM (SELECT page, n, failed AS fails,
                coalesce(sum(n) OVER (ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                bool_or(failed) OVER (ORDER BY page) AS failed,
                coalesce(bool_or(failed) OVER (ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS failed_before,
                sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) OVER (ORDER BY page ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 5 AS ends
                FROM counts_{k}))
        WHERE NOT failed_before AND NOT ended AND before < least({_CAPS[0]}, {room})),
    used_{k} AS (SELECT page, n FROM asked_{k} WHERE NOT fails),
    new_{k} AS (SELECT * FROM fresh_{k} WHERE page IN (SELECT page FROM used_{k}))"""


def _sql_run_a(stored: str = "true", new: str = "true") -> str:
    """The run as common table expressions; `stored` are numbers with a detail page, `new`
    cards that no earlier run kept."""
    return (
        f"""WITH RECURSIVE fields AS ({_SQL_FIELDS}),
        titled AS (SELECT *, lower(title) || chr(1) || lower(host) AS pair FROM ({_SQL_TITLED})),
        details AS ({_SQL_DETAILS} HAVING {stored}))),
        candidates AS (
            SELECT t.*, d.industries, d.description_lang, page * 1000 + card AS o
            FROM titled t JOIN details d ON d.number = t.number
            WHERE title_lang = 'en' AND description_lang = 'en' AND age <> 'yesterday' AND {new})"""
        + "".join(_sql_position(k, p) for k, p in enumerate(POSITIONS))
    )


_SQL_RUN_A = _sql_run_a()
_SQL_NEW = " UNION ALL ".join(f"SELECT * FROM new_{k}" for k in range(len(POSITIONS)))
_SQL_USED = " UNION ALL ".join(
    f"SELECT '{p}' AS position, page, n, {k} AS position_no FROM used_{k}" for k, p in enumerate(POSITIONS)
)


def _run_a(t, lacking=False, prior=None, analyser=None):
    search = BoardASearch(
        positions=",".join(POSITIONS), desired_language="en", max_jobs_per_position=_CAPS[0], max_jobs=_CAPS[1],
        use_analysis=analyser is not None,
    )
    details = detail_pages_a(t)
    if lacking:
        details = details.filter(F.regexp_extract("url", r"(\d+)$", 1).cast("long") % 4 != 0)
    pages = search_pages_a(t, search).select("url", "html").unionByName(details)
    return run_board_a(pages, search, AS_OF, StopWordDetector(), prior, analyser)


@query(
    f"""{_SQL_RUN_A} SELECT position, page, card, number AS job_id, title, host AS company, title_lang, description_lang,
    'https://' || host || '/view/a-job-' || number || '?ref=x' AS url, industries,
    CASE WHEN industries = 'net' THEN 'No' ELSE 'Yes' END AS easy_apply, '{fixed.SOURCE_A}' AS source,
    {SQL_MILLIS.format(f"(TIMESTAMP '{AS_OF}' - CASE page_id % 5 WHEN 0 THEN to_hours(page_id) WHEN 1 THEN to_days(page_id % 60) WHEN 4 THEN to_days(1) ELSE to_days(0) END)")}
    AS posted_time FROM ({_SQL_NEW})"""
)
def board_a_run(t):
    return _run_a(t).postings.select(
        "position", "page", "card", "job_id", "title", "company", "title_lang", "description_lang", "url", "industries",
        "easy_apply", "source", millis(F.col("posted_time")).alias("posted_time"),
    )


@query(
    f"""{_SQL_RUN_A} SELECT position, CAST(page AS INTEGER) AS page, n,
    CAST(sum(n) OVER (PARTITION BY position ORDER BY page) AS BIGINT) AS position_total,
    CAST(sum(n) OVER (ORDER BY position_no, page) AS BIGINT) AS run_total FROM ({_SQL_USED})"""
)
def board_a_progress(t):
    return _run_a(t).progress.drop("position_no")


_SQL_KEPT = " UNION ALL ".join(f"SELECT {k} AS position_no, * FROM new_{k}" for k in range(len(POSITIONS)))
_SQL_STOPS = " UNION ALL ".join(
    f"SELECT '{p}' AS position, CAST(page AS INTEGER) AS page FROM asked_{k} WHERE fails" for k, p in enumerate(POSITIONS)
)


@query(
    f"""{_sql_run_a("CAST(number AS BIGINT) % 4 <> 0")},
    kept AS ({_SQL_KEPT}), walked AS ({_SQL_USED})
    SELECT position, page, CAST(NULL AS INTEGER) AS card, CAST(NULL AS VARCHAR) AS job_id, 'no search page' AS reason
    FROM ({_SQL_STOPS})
    UNION ALL
    SELECT t.position, t.page, t.card, t.number, 'no detail page' FROM titled t JOIN walked w ON w.position = t.position AND w.page = t.page
    WHERE t.title_lang = 'en' AND t.age <> 'yesterday' AND CAST(t.number AS BIGINT) % 4 = 0
      AND NOT EXISTS (SELECT 1 FROM kept WHERE kept.pair = t.pair
                      AND (kept.position_no, kept.page, kept.card) < (w.position_no, t.page, t.card))"""
)
def board_a_quarantine(t):
    """A quarter of the detail pages is not stored."""
    told = _run_a(t, lacking=True).quarantined.filter(F.col("reason").isin("no search page", "no detail page"))
    return told.select("position", "page", "card", "job_id", "reason")


# Postings of every seventh page were kept before. An analyser that reads plain facts off the
# description stands for a model.
_PRIOR = "page_id % 7 = 0"


def _facts(text):
    words = F.size(F.split(text, " "))
    return F.struct(
        F.when(words % 2 == 0, "even").otherwise("odd").alias("required_studies"),
        F.array(F.substring(text, 1, 3), F.substring(text, -3, 3)).alias("technologies_required"),
        (words % 11).cast("int").alias("experience_years_needed"), F.length(text).alias("salary_offered"), words.alias("token_cost"),
    )


_SQL_WORDS = "CAST(len(string_split(d.description, ' ')) AS INTEGER)"
_SQL_ANALYSED = f"""{_sql_run_a(new=f"t.number NOT IN (SELECT number FROM fields WHERE {_PRIOR}) AND t.pair NOT IN (SELECT pair FROM titled WHERE {_PRIOR})")},
    analysed AS (SELECT n.number AS job_id, {_SQL_WORDS} AS words, d.description FROM ({_SQL_NEW}) n JOIN details d USING (number))"""


def _analysed(t):
    earlier = posting_fields(t).filter("page_id % 7 = 0")
    prior = earlier.select(
        markup.element_text(F.col("h1")).alias("title"), F.col("host").alias("company"), F.col("number").alias("job_id")
    )
    return _run_a(t, prior=prior, analyser=_facts).postings


@query(
    f"""{_SQL_ANALYSED} SELECT job_id, CASE WHEN words % 2 = 0 THEN 'even' ELSE 'odd' END AS required_studies,
    substr(description, 1, 3) || '|' || right(description, 3) AS technologies, words % 11 AS experience_years_needed,
    CAST(length(description) AS INTEGER) AS salary_offered, words AS token_cost FROM analysed"""
)
def board_a_analysed(t):
    return _analysed(t).select(
        "job_id", "required_studies", F.array_join("technologies_required", "|").alias("technologies"),
        "experience_years_needed", "salary_offered", "token_cost",
    )


@query(f"{_SQL_ANALYSED} SELECT '{fixed.SOURCE_A}' AS source, CAST(sum(words) AS BIGINT) AS used_tokens FROM analysed HAVING count(*) > 0")
def board_a_tokens(t):
    return token_accounting(_analysed(t))


# Board B: fifteen neighbouring events are the results of one search page. The title of
# some results holds '};', which cuts the document of their page short.
_B_TITLE = "event_type || ' ' || props || CASE WHEN event_id % 500 = 77 THEN ';' ELSE '' END"
_SQL_RESULTS = f"""(SELECT *, event_id // 15 AS page_no, CAST(event_id % 15 AS INTEGER) AS card, {_B_TITLE} AS title,
    bool_or(event_id % 500 = 77) OVER (PARTITION BY event_id // 15) AS cut FROM events)"""


def _result_pages(t):
    key = F.col("event_id")
    title = F.concat("event_type", F.lit(" "), "props", F.when(key % 500 == 77, ";").otherwise(""))
    result = F.struct(
        title.alias("displayTitle"), F.concat(F.lit("Co "), "user_id").alias("company"), F.lit("Paris").alias("formattedLocation"),
        F.unix_millis(utc("ts")).alias("pubDate"),
        F.when(key % 3 != 0, F.array(F.lit("Full-time"), F.col("event_type"))).alias("jobTypes"),
        F.struct(F.array("event_type", "props").alias("sortedMisMatchingEntityDisplayText")).alias("jobSeekerMatchSummaryModel"),
        F.when(key % 4 == 0, F.struct(key.alias("min"), (key + 10).alias("max"), F.lit("YEARLY").alias("type"))).alias("extractedSalary"),
        F.when(key % 50 != 49, F.concat(F.lit("k"), key)).alias("jobkey"), (key % 2 == 0).alias("indeedApplyEnabled"),
    )
    tiers = F.array(F.struct(F.count(F.lit(1)).alias("jobs")))
    model = F.to_json(F.struct(F.struct(F.struct(
        F.transform(F.array_sort(F.collect_list(F.struct("event_id", result.alias("r")))), lambda x: x["r"]).alias("results"),
        tiers.alias("tierSummaries"),
    ).alias("mosaicProviderJobCardsModel")).alias("metaData")))
    html = F.concat(
        F.lit('<html><script>\nvar a={};window.mosaic.providerData["mosaic-provider-jobcards"]='), model,
        F.lit(';\nwindow.mosaic.providerData["mosaic-provider-jobcards"]={};</script></html>'),
    )
    return t.events.groupBy(F.floor(key / 15).alias("page_no")).agg(html.alias("html"))


@query(f"SELECT page_no, card, title FROM {_SQL_RESULTS} WHERE NOT cut")
def embedded_results(t):
    rows, _ = embedded.embedded_results(embedded.page_results(_result_pages(t)))
    return rows.select("page_no", "card", F.get_json_object("result", "$.displayTitle").alias("title"))


@query(f"SELECT DISTINCT page_no, 'no readable result list' AS reason FROM {_SQL_RESULTS} WHERE cut")
def embedded_results_quarantine(t):
    return embedded.embedded_results(embedded.page_results(_result_pages(t)))[1]


@query(
    f"""SELECT page_no, 0 AS tier_no, '{{"jobs":' || count(*) || '}}' AS tier FROM {_SQL_RESULTS} WHERE NOT cut
    GROUP BY page_no"""
)
def embedded_tiers(t):
    return embedded.embedded_tiers(embedded.page_results(_result_pages(t)))


@query(
    f"""SELECT page_no, card, title, 'Co ' || user_id AS company, 'Paris' AS location,
    {SQL_MILLIS.format("date_trunc('milliseconds', ts)")} AS posted_time,
    CASE WHEN event_id % 3 <> 0 THEN 'Full-time, ' || event_type END AS employment_type,
    event_type || ', ' || props AS technologies,
    CASE WHEN event_id % 4 = 0 THEN event_id || ' - ' || (event_id + 10) || ' YEARLY' END AS salary_text,
    CASE WHEN event_id % 50 <> 49 THEN 'k' || event_id END AS job_id,
    CASE WHEN event_id % 50 <> 49 THEN '{fixed.BOARD_B_BASE_URL}/viewjob?jk=k' || event_id END AS url,
    CASE WHEN event_id % 2 = 0 THEN 'Yes' ELSE 'No' END AS easy_apply, '{fixed.SOURCE_B}' AS source,
    CASE WHEN event_id % 50 = 49 THEN 'no jobkey' END AS reason FROM {_SQL_RESULTS} WHERE NOT cut"""
)
def posting_from_json(t):
    rows, _ = embedded.embedded_results(embedded.page_results(_result_pages(t)))
    postings = embedded.posting_from_json(rows, AS_OF)
    return postings.select(
        "page_no", "card", "title", "company", "location", millis(F.col("posted_time")).alias("posted_time"),
        "employment_type", F.array_join("technologies_required", ", ").alias("technologies"), "salary_text", "job_id",
        "url", "easy_apply", "source", "reason",
    )


def _detail_html(article):
    blob = F.to_json(F.struct(F.struct(F.struct(article.alias("sanitizedJobDescription")).alias("jobInfoModel"))
                              .alias("jobInfoWrapperModel")))
    return F.concat(F.lit("<script>window._initialData="), blob, F.lit(";\nvar more={};</script>"))


@query(f"SELECT page_id, {sql_text('article')} AS description FROM ({_SQL_FIELDS})")
def embedded_detail(t):
    html = _detail_html(F.col("article"))
    return posting_fields(t).select("page_id", embedded.embedded_detail(html).alias("description"))


# Board B over the stored pages: a phrase is a top-level domain with a number, and its
# result page holds the postings of forty neighbouring pages.
_SEARCH_B = BoardBSearch(location="Paris", desired_language="en", use_analysis=True)


def _phrased(t):
    return posting_fields(t).withColumn("phrase", F.concat("position", F.lit(" "), "page"))


def _store_b(t):
    result = F.struct(
        markup.html_to_text(F.col("h1")).alias("displayTitle"), F.col("host").alias("company"), F.lit("Paris").alias("formattedLocation"),
        (F.col("page_id") * 3_600_000).alias("pubDate"),
        F.struct(F.array("position").alias("sortedMisMatchingEntityDisplayText")).alias("jobSeekerMatchSummaryModel"),
        F.concat(F.lit("k"), "page_id").alias("jobkey"), F.lit(True).alias("indeedApplyEnabled"),
    )
    model = F.to_json(F.struct(F.struct(F.struct(
        F.transform(F.array_sort(F.collect_list(F.struct("page_id", result.alias("r")))), lambda x: x["r"]).alias("results"),
        F.array().cast("array<string>").alias("tierSummaries"),
    ).alias("mosaicProviderJobCardsModel")).alias("metaData")))
    fields = _phrased(t)
    url = addresses.board_b_search_url(F.col("phrase"), F.lit("Paris"))
    html = F.concat(F.lit('window.mosaic.providerData["mosaic-provider-jobcards"]='), model, F.lit(";"))
    search = fields.groupBy("phrase").agg(html.alias("html")).select(url.alias("url"), "html")
    details = fields.filter(F.col("page_id") % 9 != 0).select(
        addresses.board_b_detail_url(F.concat(F.lit("k"), "page_id")).alias("url"), _detail_html(F.col("article")).alias("html")
    )
    return search.unionByName(details)


def _run_b(t):
    phrases = _phrased(t).select(F.lit(0).alias("position_no"), F.col("phrase").alias("position")).distinct()
    return run_board_b(_store_b(t), _SEARCH_B, AS_OF, StopWordDetector(), phrases=phrases)


@query(
    f"""SELECT position, job_id, title, company, {SQL_MILLIS.format('posted')} AS posted_time, title_lang,
    {sql_stop_word_lang()} AS description_lang, 'Not specified' AS required_studies_if_en, 'Yes' AS easy_apply
    FROM (SELECT * EXCLUDE (s_de, s_en, s_es, s_fr), {sql_stop_word_scores('description')} FROM (
        SELECT *, {sql_stop_word_lang()} AS title_lang FROM (
            SELECT *, {sql_stop_word_scores('title')} FROM (
                SELECT position || ' ' || page AS position, 'k' || page_id AS job_id, {sql_text('h1')} AS title, host AS company,
                TIMESTAMP '1970-01-01' + to_hours(page_id) AS posted, {sql_text('article')} AS description
                FROM ({_SQL_FIELDS}) WHERE page_id % 9 <> 0))))""",
)
def board_b_run(t):
    postings = _run_b(t).postings
    studies = F.when(F.col("description_lang") == "en", F.col("required_studies")).otherwise(F.lit(fixed.STUDIES_NOT_SPECIFIED))
    return postings.select(
        "position", "job_id", "title", "company", millis(F.col("posted_time")).alias("posted_time"), "title_lang",
        "description_lang", studies.alias("required_studies_if_en"), "easy_apply",
    )


@query(
    f"""SELECT '{fixed.BOARD_B_BASE_URL}/viewjob?jk=k' || page_id AS url, 'no detail page' AS reason FROM pages
    WHERE page_id % 9 = 0"""
)
def board_b_quarantine(t):
    return _run_b(t).quarantined


_SQL_PAGE_POSTINGS = f"""
    WITH RECURSIVE fields AS ({_SQL_FIELDS}),
    scored AS (SELECT *, {sql_stop_word_lang()} AS description_lang FROM (
        SELECT *, {sql_stop_word_scores('description')} FROM (
            SELECT page_id, number, host, position, {sql_text('h1')} AS title, {sql_text('article')} AS description FROM fields))),
    edges AS (SELECT page_id AS o, number AS i, lower(title) || chr(1) || host AS p FROM scored WHERE description_lang = 'en'),
    rounds(o, i, p, kept) AS (
        SELECT o, i, p, false FROM edges
        UNION ALL
        SELECT o, i, p, wins FROM (
            SELECT *, bool_or(wins) OVER (PARTITION BY i) OR bool_or(wins) OVER (PARTITION BY p) AS settled
            FROM (SELECT o, i, p, o = min(o) OVER (PARTITION BY i) AND o = min(o) OVER (PARTITION BY p) AS wins
                  FROM rounds WHERE NOT kept))
        WHERE wins OR NOT settled)"""


@query(
    f"""{_SQL_PAGE_POSTINGS} SELECT title, host AS company, position AS location, number AS job_id, description_lang,
    'Not specified' AS required_studies FROM scored WHERE page_id IN (SELECT o FROM rounds WHERE kept)"""
)
def page_postings_report(t):
    """Stored pages to a sorted report: extract, identify, filter, de-duplicate, enrich."""
    description = markup.html_to_text(F.col("article"))
    found = posting_fields(t).select(
        "page_id", markup.html_to_text(F.col("h1")).alias("title"), F.col("host").alias("company"),
        F.col("position").alias("location"), F.col("number").alias("job_id"), description.alias("description"),
    )
    found = found.withColumn("description_lang", StopWordDetector().detect(F.col("description")))
    english = language_filter(found, "description_lang", "en").withColumn(
        "required_studies", rule_analyser(F.col("description"))["required_studies"]
    )
    kept = greedy_dedup(english.withColumns(identity_keys()), ["page_id"], ID_KEY, PAIR_KEY)
    ordered = report_sort(conform(kept, ["page_id"]), ["page_id"])
    return report_projection(ordered).select(
        "title", "company", "location", "job_id", "description_lang", "required_studies"
    )
