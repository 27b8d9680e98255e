"""Text and attributes out of the stored pages."""

from pyspark.sql import functions as F

from postmill import fixed_values as fixed
from postmill.functions import addresses, markup
from postmill.operators import cards
from workload.registry import query, sql_collapse, sql_decode, sql_drop_markup, sql_element_text, sql_text

SQL_ARTICLE = "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"


@query(f"SELECT page_id, {sql_text('html')} AS text FROM pages")
def html_to_text(t):
    return t.pages.select("page_id", markup.html_to_text(F.col("html")).alias("text"))


@query(
    f"""SELECT page_id, {sql_element_text("regexp_extract(html, '(?s)<div class=.ad.>(.*?)</div>', 1)")} AS ad,
    '' AS absent FROM pages"""
)
def first_text(t):
    html = F.col("html")
    return t.pages.select(
        "page_id", markup.first_text(html, "ad").alias("ad"), markup.first_text(html, "_title").alias("absent")
    )


@query("SELECT page_id, url AS href, '' AS absent FROM pages")
def first_href(t):
    link = F.concat(F.lit('<p class="q"></p><a href="'), F.col("url"), F.lit('" class="k_full-link z">'))
    html = F.concat("html", link, F.lit("more</a>"))
    return t.pages.select(
        "page_id",
        markup.first_href(html, fixed.LINK_CLASS_PART).alias("href"),
        markup.first_href(F.col("html"), fixed.LINK_CLASS_PART).alias("absent"),
    )


@query(
    f"""SELECT page_id, {sql_collapse(sql_decode(sql_drop_markup(SQL_ARTICLE, '')))} AS description FROM pages"""
)
def description_block(t):
    article = F.regexp_extract("html", r"(?s)<article>(.*?)</article>", 1)
    page = F.concat(
        F.lit('<div class="top"><div class="description__text rich"><section class="s">\n<div class="m">'),
        article, F.lit("</div><button>more</button></section></div></div>"), F.col("html"),
    )
    return t.pages.select("page_id", cards.description_block(page).alias("description"))


@query(
    """SELECT page_id, CASE WHEN html LIKE '%</body>%' THEN 'Yes' ELSE 'No' END AS easy_apply FROM pages"""
)
def apply_flag(t):
    icon = F.lit(f'<icon class="i" data-svg-class-name="{fixed.OFFSITE_ICON}"></icon>')
    cut = ~F.contains("html", F.lit("</body>"))
    html = F.when(cut, F.concat("html", icon)).otherwise(F.col("html"))
    return t.pages.select("page_id", cards.apply_flag(html).alias("easy_apply"))


@query(
    """SELECT page_id, split_part(split_part(url, '-', -1), '?', 1) AS from_url,
    regexp_extract(url, '/(\\d+)', 1) AS from_link FROM pages"""
)
def posting_id(t):
    link = F.concat(
        F.lit("https://x/view/a-job-at-"), F.regexp_extract("url", "//([^/]+)/", 1), F.lit("-"),
        F.regexp_extract("url", r"/(\d+)", 1), F.lit("?ref=q&page=1"),
    )
    return t.pages.select(
        "page_id",
        addresses.posting_id(F.col("url")).alias("from_url"),
        addresses.posting_id(link).alias("from_link"),
    )


@query(
    """SELECT o_orderkey,
    CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 5 = 0 THEN 'again ' || o_orderstatus
         ELSE o_orderpriority END AS seniority_level,
    o_orderstatus AS employment_type,
    'C' || o_custkey || ' & co' AS job_function, '' AS industries FROM orders"""
)
def criteria_pivot(t):
    def item(label, value):
        return F.concat(
            F.lit(f'<li class="x"><h3 class="{fixed.CRITERIA_LABEL_CLASS}">\n {label} </h3>'),
            F.lit(f'<span class="y {fixed.CRITERIA_VALUE_CLASS} z">'), value, F.lit(" </span></li>\n"),
        )

    key = F.col("o_orderkey")
    blank = F.lit("")
    html = F.concat(
        F.lit(f'<div><ul class="{fixed.CRITERIA_LIST_CLASS}">'),
        F.when(key % 7 != 0, item("Seniority level", F.col("o_orderpriority"))).otherwise(blank),
        item("Employment type", F.col("o_orderstatus")),
        item("employment type", F.lit("other label")),
        F.concat(F.lit(f'<li><h3 class="{fixed.CRITERIA_LABEL_CLASS}">Industries</h3></li>')),
        F.when((key % 5 == 0) & (key % 7 != 0), item("Seniority level", F.concat(F.lit("again "), "o_orderstatus")))
        .otherwise(blank),
        item("Job function", F.concat(F.lit("C"), F.col("o_custkey"), F.lit(" &amp; <b>co</b>"))),
        F.lit("</ul>"), item("Industries", F.lit("outside the list")), F.lit("</div>"),
    )
    items = t.orders.select("o_orderkey", cards.criteria_items(html).alias("items"))
    return items.select(
        "o_orderkey", *[c.alias(n) for n, c in cards.criteria_pivot(F.col("items")).items()]
    )
