"""Column functions against known rows."""

import html
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from postmill import BoardASearch, BoardBSearch
from postmill import fixed_values as fixed
from postmill.functions import addresses, codes, dates, enrichment, markup
from postmill.operators import cards
from postmill.sources.frontier import position_split, search_frontier_a, search_frontier_b


def values(spark, rows, *columns, names=("x",)):
    df = spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], ", ".join(f"{n} string" for n in names))
    return [tuple(r) if len(r) > 1 else r[0] for r in df.select(*columns).collect()]


HTML_ROWS = [
    ("<p>Hello  World!</p>\n<div>More text</div>", "Hello World! More text"),
    ("a<b>b</b>c", "a b c"),
    ('x<script>var t="</p>";</script>y', "x y"),
    ("&amp;lt;", "&lt;"),
    ("x&amp</p>y", "x& y"),
    ("", ""),
    ("<p>a<!-- <b>no</b> -->b", "a b"),
    ('<a title="1 > 0">x</a>', "x"),
    ("1 < 2", "1 < 2"),
    ("caf&eacute; &#233;&#xe9; &#146; &amp;eacute; &nosuch; &Amacr;", "café éé ’ &eacute; &nosuch; Ā"),
    ("a&nbsp;&nbsp;b\x1cc d", "a b c d"),
    ("<STYLE>p{}</STYLE>x<style>open", "x"),
    ("&#0; &#x110000;", "� �"),
    ("a<template><p>no</p></template>b <ruby>漢<rp>(</rp><rt>kan</rt><rp>)</rp></ruby> <rtl>x</rtl>", "a b 漢 x"),
]


def test_html_to_text(spark):
    got = values(spark, [r[0] for r in HTML_ROWS], markup.html_to_text(F.col("x")))
    assert got == [r[1] for r in HTML_ROWS]


def test_entities_follow_the_standard_table(spark):
    names = sorted(n for n in html.entities.html5 if n.endswith(";"))
    text = " ".join(f"&{n}" for n in names)
    got = values(spark, [text], markup.decode_entities(F.col("x")))[0]
    assert got == html.unescape(text)


CARD = """
<ul><li>
  <div class="base-card relative" data-x="1">
    <a class="base-card__full-link" href="https://x/view/dev-at-co-123?refId=abcd&amp;t=1"><span>Dev</span></a>
    <div><div class="inner">skip</div></div>
    <h3 class="base-search-card__title">
        Dev &amp; Ops <b>now</b> </h3>
    <h4 class='base-search-card__subtitle'><a>Co</a></h4>
    <span class="job-search-card__location">Paris</span>
    <time class="job-search-card__listdate--new" datetime="2024-01-01"> 3 hours ago</time>
  </div>
</li>
<li><!----> <div class="base-card"><h3 class=c_title>No link</h3></div></li>
<li><div class="base-cards"><h3 class="c_title">Not a card</h3></div></li>
</ul><div class="footer_subtitle">F</div>"""


def test_href_forms_and_spaces(spark):
    rows = ['<a class="k_full-link" href=\'a"b\'>', "<a class=k_full-link href=c?d>", '<a href="" class="k_full-link">', "<a>"]
    assert values(spark, rows, markup.first_href(F.col("x"), "_full-link")) == ['a"b', "c?d", "", ""]
    long = ("a" + " " * 3000) * 30
    assert values(spark, [long, "\u00a0 x\n"], markup.strip(F.col("x"))) == [long.strip(), "x"]


def test_cards(spark):
    df = spark.createDataFrame([("u", CARD), ("v", "<p>nothing</p>")], "page string, html string")
    rows = cards.card_explode(cards.page_cards(df)).orderBy("card").collect()
    assert [r.asDict() for r in rows] == [
        {
            "page": "u", "card": 0, "url": "https://x/view/dev-at-co-123?refId=abcd&t=1",
            "title": "Dev & Ops now", "company": "Co", "age": "3 hours ago", "location": "Paris",
        },
        {"page": "u", "card": 1, "url": "", "title": "No link", "company": "", "age": "", "location": ""},
    ]


def item(label, value):
    label = f'<h3 class="description__job-criteria-subheader"> {label} </h3>' if label else ""
    value = f'<span class="description__job-criteria-text x">{value}\n</span>' if value else ""
    return f"<li class='i'>{label}{value}</li>"


DETAIL = (
    '<section class="core description"><div class="description__text"><!----><section data-x="5">\n<div class="m">'
    "One<div>two\n three</div><br>four</div><button>more</button></section></div>"
    '<ul class="description__job-criteria-list">'
    + item("Seniority level", "Director")
    + item("Employment type", "Full-time")
    + item("Job function", "")
    + item("Other", "x")
    + item("Seniority level", "Associate")
    + "</ul></section>"
)


def test_details(spark):
    icon = '<icon class="q" data-svg-class-name="apply-button__offsite-apply-icon-svg"></icon>'
    df = spark.createDataFrame([("1", DETAIL), ("2", icon)], "job_id string, html string")
    one, two = cards.detail_fields(df).orderBy("job_id").collect()
    assert one.asDict() == {
        "job_id": "1", "description": "Onetwo threefour", "easy_apply": "Yes", "seniority_level": "Associate",
        "employment_type": "Full-time", "job_function": "", "industries": "",
    }
    assert (two.description, two.easy_apply, two.seniority_level) == ("", "No", "")


def test_posting_id(spark):
    rows = ["https://x/view/dev-at-co-123?refId=abcd", "https://x/view/dev-at-co-123?refId=ab-cd", "plain"]
    assert values(spark, rows, addresses.posting_id(F.col("x"))) == ["123", "cd", "plain"]


def test_form_encoding(spark):
    assert values(spark, ["C++ dev/é ~*"], addresses.form_encode(F.col("x"))) == ["C%2B%2B+dev%2F%C3%A9+~%2A"]


def test_search_addresses(spark):
    search = BoardASearch(positions="A, B", location="New York", publish_timespan="Day")
    rows = search_frontier_a(spark, search, 0, 1).orderBy("position_no", "page").collect()
    assert [(r.position, r.page) for r in rows] == [("A", 0), ("A", 1), (" B", 0), (" B", 1)]
    assert rows[3].url.split("?")[1] == (
        "start=10&location=New+York&f_E=4&f_JT=2&f_WT=2&f_AL=true&keywords=+B&f_JIYN=true&f_TPR=r86400"
    )
    plain = BoardASearch(positions="", easy_apply=False, less_than_ten_applicants=False, publish_timespan="None")
    url = search_frontier_a(spark, plain).first().url
    assert url.split("?")[1] == "start=0&location=France&f_E=4&f_JT=2&f_WT=2"

    b = BoardBSearch(positions="Python Developer", location="Paris", max_age_days=7)
    url = search_frontier_b(spark, b).first().url
    assert url == fixed.BOARD_B_BASE_URL + "/jobs?q=Python+Developer&l=Paris&fromage=7" + fixed.BOARD_B_REMOTE_SUFFIX
    assert values(spark, ["abc123"], addresses.board_b_detail_url(F.col("x"))) == [
        fixed.BOARD_B_BASE_URL + "/viewjob?jk=abc123"
    ]


def test_search_settings_are_checked():
    for wrong in ({"work_mode": "x"}, {"experience_level": "x"}, {"publish_timespan": "x"}, {"use_analysis": True}):
        with pytest.raises(ValueError):
            BoardASearch(**wrong)
    with pytest.raises(ValueError):
        BoardBSearch(use_analysis=True)


def test_position_split_keeps_spaces(spark):
    df = spark.createDataFrame([("A, B",)], "p string")
    assert [tuple(r)[1:] for r in position_split(df, F.col("p")).collect()] == [(0, "A"), (1, " B")]


def test_code_lookup(spark):
    got = values(spark, ["Remote", "x"], codes.code_lookup(fixed.WORK_MODE_CODES, F.col("x")))
    assert got == [2, None]


def test_relative_age(spark):
    rows = {
        "3 hours ago": datetime(2024, 3, 10, 9),
        "2 days ago": datetime(2024, 3, 8, 12),
        "30+ days ago": datetime(2024, 2, 9, 12),
        "2 weeks ago": datetime(2024, 3, 10, 12),
        "45 minutes ago": datetime(2024, 3, 10, 12),
        "": datetime(2024, 3, 10, 12),
        "today": None,
        "yesterday": None,
        "99999999999999 hours ago": None,
        "2147483647 days ago": None,
        "999999 days ago": None,
    }
    as_of = datetime(2024, 3, 10, 12)
    got = values(spark, list(rows), dates.relative_age(F.col("x"), as_of).cast("timestamp_ntz"))
    assert got == list(rows.values())


def test_dates(spark):
    row = spark.range(1).select(dates.epoch_millis(F.lit(1709600523123)).alias("t")).select(
        F.col("t").cast("string"), dates.date_display(F.col("t"))
    ).first()
    assert tuple(row) == ("2024-03-05 01:02:03.123", "05 of March 2024")


def test_reasoning_strip(spark):
    rows = {
        '<think>x\ny</think>\n{"technologies":["Java"]}': ["Java"],
        '```json\n{{"technologies":["Go"]}}\n```': ["Go"],
        '{"technologies":["A"],"m":{"k":1}}': [],
        "no json": [],
        '{"other":1}': [],
        '{"technologies":"text"}': [],
    }
    assert values(spark, list(rows), enrichment.reasoning_strip(F.col("x"))) == list(rows.values())


def test_parse_response(spark):
    full = '{"required_studies":"MSc","technologies_required":["Go"],"experience_years_needed":3,"salary_offered":10}'
    rows = [full, '{"required_studies":"MSc","experience_years_needed":3}', "bad", '{"required_studies":null}']

    def parse(**flags):
        out = values(spark, rows, enrichment.parse_response(F.col("x"), F.lit(7), **flags))
        return [None if r is None else tuple(r) for r in out]

    assert parse() == [("MSc", ["Go"], 3, 10, 7), None, None, None]
    assert parse(technologies=False, salary=False) == [("MSc", [], 3, 0, 7)] * 2 + [None] * 2


def test_request_text(spark):
    both, none = values(
        spark, ["D"], enrichment.request_text(F.col("x")),
        enrichment.request_text(F.col("x"), technologies=False, salary=False),
    )[0]
    for part in (fixed.REQUEST_TECHNOLOGIES, fixed.REQUEST_SALARY, fixed.REQUEST_DEFAULT_SALARY):
        assert part in both and part not in none
    assert both.startswith(fixed.REQUEST_BASE) and none.endswith("\nD")


def test_rules(spark):
    rows = {
        "5+ years of Java and C++, 3-5 yrs Node.js. Master's or PhD. Salary: 50,000 - 60,000 EUR":
            ("PhD", ["C++", "Java", "Node.js"], 3, 50000),
        "Bachelor. Paid 45k; compensation from 45k. We use .NET, python/Go": ("Bachelor", [".NET", "Go", "Python"], 0, 45000),
        "Nothing here": ("Not specified", [], 0, 0),
        "": ("Not specified", [], 0, 0),
    }
    got = [tuple(r)[:4] for r in values(spark, list(rows), enrichment.rule_analyser(F.col("x")))]
    assert got == list(rows.values())
