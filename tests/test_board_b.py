"""Board B: embedded documents and the run over stored pages."""

from boards import job_html, results_html, store_b
from pyspark.sql import functions as F

from postmill import BoardBSearch, StopWordDetector, fixed_values
from postmill.operators import embedded
from postmill.plans.board_b import run_board_b


def result(**changes):
    full = {
        "displayTitle": "The dev of the team", "company": "Co", "formattedLocation": "Paris", "pubDate": 1709600523123,
        "jobTypes": ["Full-time", "Remote"],
        "jobSeekerMatchSummaryModel": {"sortedMisMatchingEntityDisplayText": ["Java", "Go"]},
        "extractedSalary": {"min": 45000, "max": 50000.5, "type": "YEARLY"}, "jobkey": "k1", "indeedApplyEnabled": True,
    }
    return {k: v for k, v in {**full, **changes}.items() if v is not ...}


def test_posting_from_json(spark):
    results = [
        result(), result(jobTypes=..., extractedSalary=..., indeedApplyEnabled=False), result(company=...),
        result(extractedSalary={"min": 1, "max": 2}), result(jobSeekerMatchSummaryModel={}), result(pubDate="x"),
    ]
    df = spark.createDataFrame([("u", results_html(results, [{"a": 1}, {"b": 2}]))], "url string, html string")
    pages = embedded.page_results(df)
    rows, failing = embedded.embedded_results(pages)
    assert failing.count() == 0
    assert [(r.tier_no, r.tier) for r in embedded.embedded_tiers(pages).collect()] == [(0, '{"a":1}'), (1, '{"b":2}')]
    got = embedded.posting_from_json(rows.drop("url"), "2024-03-10").withColumn("posted", F.col("posted_time").cast("string"))
    got = got.orderBy("card").collect()
    first, second = got[0].asDict(), got[1].asDict()
    assert first["salary_text"] == "45000 - 50000.5 YEARLY" and second["salary_text"] is None
    assert first["employment_type"] == "Full-time, Remote" and second["employment_type"] is None
    assert (first["easy_apply"], second["easy_apply"]) == ("Yes", "No")
    assert first["posted"] == "2024-03-05 01:02:03.123" and first["technologies_required"] == ["Java", "Go"]
    assert first["url"] == fixed_values.BOARD_B_BASE_URL + "/viewjob?jk=k1" and first["source"] == fixed_values.SOURCE_B
    assert [r.reason for r in got] == [
        None, None, "no company", "incomplete salary", "no sortedMisMatchingEntityDisplayText", "no pubDate",
    ]


def test_unreadable_pages(spark):
    good = results_html([result()])
    pages = [
        ("none", "<html></html>"), ("lines", good.replace('"company"', '\n"company"')),
        ("cut", results_html([result(displayTitle="a};b")])), ("good", good),
        ("first wins", good + results_html([result(), result()])),
    ]
    df = embedded.page_results(spark.createDataFrame(pages, "url string, html string"))
    rows, failing = embedded.embedded_results(df)
    assert sorted(r.url for r in failing.collect()) == ["cut", "lines", "none"]
    assert sorted(r.url for r in rows.collect()) == ["first wins", "good"]


def test_embedded_detail(spark):
    pages = [("a", job_html("<p>One &amp;</p><p>two  3</p>")), ("b", "nothing"), ("c", "_initialData={};"), ("d", job_html(""))]
    df = spark.createDataFrame(pages, "url string, html string")
    got = {r.url: r.d for r in df.select("url", embedded.embedded_detail(F.col("html")).alias("d")).collect()}
    assert got == {"a": "One & two 3", "b": None, "c": None, "d": ""}


def test_run(spark):
    search = BoardBSearch(positions="a,b b,c", location="Paris", desired_language="en", use_analysis=True)
    search_pages = {
        0: results_html([result(), result(jobkey="k2", company=...), result(jobkey="k3")]),
        1: results_html([result(), result(jobkey="k4", displayTitle="le poste dans les bureaux")]),
    }
    details = {"k1": job_html("the work of a team, 4 years, Master, Salary 50000"), "k4": job_html("le 3 ans dans les et une 5 years")}
    pages = store_b(spark, search, search_pages, details)
    for hot_min_rows in (10**6, 1):
        run = run_board_b(pages, search, "2024-03-10", StopWordDetector(), hot_min_rows=hot_min_rows)
        rows = run.postings.orderBy("position_no", "card").collect()
        assert [(r.position, r.card, r.job_id, r.title_lang, r.description_lang) for r in rows] == [
            ("a", 0, "k1", "en", "en"), ("b b", 0, "k1", "en", "en"), ("b b", 1, "k4", "fr", "fr"),
        ]
        assert [(r.experience_years_needed, r.required_studies, r.salary_offered) for r in rows] == [
            (4, "Master", 0), (4, "Master", 0), (0, "", 0),
        ]
        assert rows[0].technologies_required == ["Java", "Go"]
        reasons = sorted(r.reason for r in run.quarantined.collect())
        assert reasons == ["no company", "no detail page", "no search page"]
