"""A run over board A against a sequential simulation of the crawl."""

import random
from datetime import datetime, timedelta

import pytest
from boards import store_a
from pyspark.sql import functions as F

from postmill import BoardASearch, StopWordDetector, fixed_values
from postmill.functions.enrichment import rule_analyser
from postmill.plans.board_a import run_board_a

AS_OF = datetime(2024, 3, 10, 12)
POSTING = "title string, company string, job_id string"


def make_store(seed, positions=3, pages=14, cards=5):
    rng = random.Random(seed)
    words = {"en": "the engineer of the {} and the team", "fr": "le développeur {} dans les équipes avec une"}
    search_pages, details = {}, {}
    for position in range(positions):
        for page in range(pages):
            if seed and position == 1 and page == 9:
                continue
            listed = []
            empty = position == 2 and 4 <= page <= 8
            for _ in range(0 if empty else cards):
                job = rng.randrange(90)
                lang = "fr" if rng.random() < 0.2 else "en"
                listed.append({
                    "url": "" if rng.random() < 0.05 else f"https://x/view/dev-{job}?t=1",
                    "job_id": str(job),
                    "title": words[lang].format(rng.randrange(70)),
                    "title_lang": lang,
                    "company": f"Co {rng.randrange(3)}",
                    "location": "Paris",
                    "age": rng.choice(["3 days ago", "today", "5 hours ago", "1 week ago"]),
                })
            search_pages[position, page] = listed
    for job in range(90):
        if rng.random() < 0.85:
            lang = "fr" if rng.random() < 0.15 else "en"
            details[str(job)] = {
                "description": words[lang].format(f"{job % 7} years of Java Salary 4{job}000"),
                "lang": lang,
                "easy_apply": rng.choice(["Yes", "No"]),
                "criteria": {"Industries": f"I{job % 4}"},
            }
    return search_pages, details


def crawl(search, search_pages, details, prior):
    """What a sequential crawl keeps, in order, and which pages it asked for in vain."""
    kept, progress, absent, total = list(prior), [], set(), 0

    def same(a, b):
        pair = lambda x: (x["title"].strip().lower(), x["company"].strip().lower())
        return a["job_id"] == b["job_id"] or pair(a) == pair(b)

    for position in range(len(search.phrases)):
        if total >= search.max_jobs:
            break
        own, empty, page = 0, 0, 0
        while own < search.max_jobs_per_position and total < search.max_jobs:
            if (position, page) not in search_pages:
                absent.add((position, page, None))
                break
            new = 0
            for n, card in enumerate(search_pages[position, page]):
                detail = details.get(card["job_id"])
                if (
                    not card["url"] or any(same(card, k) for k in kept) or card["age"] == "today"
                    or card["title_lang"] != "en"
                ):
                    continue
                if detail is None:
                    absent.add((position, page, n))
                if detail is None or detail["lang"] != "en":
                    continue
                kept.append({**card, "where": (position, page, n)})
                new += 1
            own, total = own + new, total + new
            progress.append((position, page, new, own, total))
            empty = 0 if new else empty + 1
            if empty == 5:
                break
            page += 1
    return kept[len(prior):], progress, absent


@pytest.mark.parametrize(
    "seed, caps, first_pages",
    [(0, (10**6, 10**6), 32), (1, (12, 25), 4)],
)
def test_run_equals_crawl(spark, seed, caps, first_pages):
    search_pages, details = make_store(seed)
    search = BoardASearch(
        positions="a,b c,d", desired_language="EN", max_jobs_per_position=caps[0], max_jobs=caps[1], use_analysis=True
    )
    prior = [{"title": "The engineer of the 5 and the team", "company": "co 1 ", "job_id": "x"},
             {"title": "t", "company": "c", "job_id": "7"}]
    pages = store_a(spark, search, search_pages, details)
    prior_table = spark.createDataFrame([(p["title"], p["company"], p["job_id"]) for p in prior], POSTING)
    run = run_board_a(
        pages, search, AS_OF, StopWordDetector(), prior_table, rule_analyser, first_pages, hot_min_rows=1 if seed else 10**6
    )

    expected, progress, absent = crawl(search, search_pages, details, prior)
    rows = run.postings.orderBy("position_no", "page", "card").collect()
    assert [(r.position_no, r.page, r.card) for r in rows] == [e["where"] for e in expected]
    assert [(r.job_id, r.title, r.company) for r in rows] == [(e["job_id"], e["title"], e["company"]) for e in expected]
    for r, e in zip(rows, expected):
        detail = details[e["job_id"]]
        back = {"3 days ago": timedelta(days=3), "5 hours ago": timedelta(hours=5)}.get(e["age"], timedelta())
        assert (r.easy_apply, r.industries, r.seniority_level) == (detail["easy_apply"], detail["criteria"]["Industries"], "")
        assert (r.title_lang, r.description_lang, r.source) == ("en", "en", fixed_values.SOURCE_A)
        assert r.experience_years_needed == int(e["job_id"]) % 7 and r.technologies_required == ["Java"]
        assert r.salary_offered == int(f"4{e['job_id']}000")
    times = run.postings.select(F.col("posted_time").cast("timestamp_ntz").alias("t"), "position_no", "page", "card")
    got = [r.t for r in times.orderBy("position_no", "page", "card").collect()]
    backs = [{"3 days ago": timedelta(days=3), "5 hours ago": timedelta(hours=5)}.get(e["age"], timedelta()) for e in expected]
    assert got == [AS_OF - b for b in backs]

    table = run.progress.orderBy("position_no", "page").collect()
    assert [(r.position_no, r.page, r.n, r.position_total, r.run_total) for r in table] == progress
    told = run.quarantined.select("position_no", "page", "card", "age", "reason", "url").collect()
    assert {r.age for r in told if r.reason == "age without a number"} == {"today"}
    vain = [(r.position_no, r.page, r.card) for r in told if r.reason in ("no search page", "no detail page")]
    assert set(vain) == absent and len(vain) == len(absent) and all(r.url for r in told)
    assert {r.reason for r in told if r.card is None} == {"no search page"}


def test_no_language_keeps_nothing(spark):
    search_pages, details = make_store(0, positions=1, pages=2)
    search = BoardASearch(positions="a")
    run = run_board_a(store_a(spark, search, search_pages, details), search, AS_OF, StopWordDetector())
    assert run.postings.count() == 0


def test_no_jobs_wanted(spark):
    search_pages, details = make_store(0, positions=1, pages=2)
    search = BoardASearch(positions="a", desired_language="en", max_jobs=0)
    run = run_board_a(store_a(spark, search, search_pages, details), search, AS_OF, StopWordDetector())
    assert run.postings.count() == 0 and run.progress.filter("n > 0").count() == 0


def test_analysis_needs_an_analyser(spark):
    search = BoardASearch(positions="a", desired_language="en", use_analysis=True)
    with pytest.raises(ValueError):
        run_board_a(spark.createDataFrame([], "url string, html string"), search, AS_OF, StopWordDetector())
