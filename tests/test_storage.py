"""Snapshots, reports, the whole daily run and the page store."""

import json
from datetime import datetime

import pytest
from boards import store_a
from pyspark.sql import functions as F
from test_board_a import AS_OF, make_store

from postmill import STORED_SCHEMA, BoardASearch, StopWordDetector
from postmill.fixed_values import SOURCE_A
from postmill.operators.cards import page_cards
from postmill.plans.daily import run_and_save, sorted_report, write_report
from postmill.sources import page_store
from postmill.sources.snapshot import snapshot_read, snapshot_write

RECORDS = [
    {"title": "Full", "url": "u", "company": "c", "location": "l", "posted_time": "2024-03-05T01:02:03Z",
     "seniority_level": "s", "employment_type": "e", "job_function": "f", "industries": "i", "required_studies": "r",
     "technologies_required": ["Go", "C"], "experience_years_needed": 3, "salary_offered": 10, "job_id": "1",
     "title_lang": "en", "description_lang": "fr", "date_analyzed": "2024-03-05T01:02:03.5+02:00", "easy_apply": "Yes",
     "source": "Other"},
    {"job_id": "2"},
    {"job_id": "3", "title": None, "technologies_required": None, "salary_offered": None, "posted_time": None},
    {"job_id": "4", "unknown": 1, "posted_time": "2024-03-05T01:02:03", "date_analyzed": ""},
    {"job_id": "5", "posted_time": "tomorrow"},
    {"job_id": "6", "salary_offered": "10 - 20 YEARLY", "easy_apply": True},
]


def times(df, name):
    return {r.job_id: r.t for r in df.select("job_id", F.col(name).cast("timestamp_ntz").alias("t")).collect()}


def check(good, bad):
    rows = {r.job_id: r for r in good.collect()}
    assert good.schema == STORED_SCHEMA or [f.name for f in good.schema] == STORED_SCHEMA.fieldNames()
    assert sorted(rows) == ["1", "2", "3", "4", "6"]
    assert [r.job_id for r in bad.collect() if r.reason == "unreadable posted_time"] == ["5"]
    assert rows["1"].technologies_required == ["Go", "C"] and rows["1"].source == "Other"
    for key in ("2", "3"):
        r = rows[key]
        assert (r.title, r.technologies_required, r.salary_offered, r.easy_apply, r.source) == ("", [], 0, "No", SOURCE_A)
    assert (rows["6"].salary_offered, rows["6"].salary_text, rows["6"].easy_apply) == (0, "10 - 20 YEARLY", "Yes")
    posted = times(good, "posted_time")
    assert posted == {"1": datetime(2024, 3, 5, 1, 2, 3), "2": None, "3": None, "4": datetime(2024, 3, 5, 1, 2, 3), "6": None}
    assert times(good, "date_analyzed")["1"] == datetime(2024, 3, 4, 23, 2, 3, 500000)


def test_read_lines_and_arrays(spark, tmp_path):
    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "a.json").write_text("\n".join(json.dumps(r) for r in RECORDS) + '\n{"job_id": "7", \n')
    good, bad = snapshot_read(spark, str(lines))
    check(good, bad)
    assert sorted(r.reason for r in bad.collect()) == ["malformed record", "unreadable posted_time"]

    array = tmp_path / "array.json"
    array.write_text(json.dumps(RECORDS, indent=4))
    check(*snapshot_read(spark, str(array), "array"))


def test_missing_and_malformed_snapshots(spark, tmp_path):
    for layout in ("lines", "array", "parquet"):
        good, bad = snapshot_read(spark, str(tmp_path / "none"), layout)
        assert good.count() == 0 and bad.count() == 0 and good.columns == STORED_SCHEMA.fieldNames()
    (tmp_path / "bad.json").write_text('[{"job_id": ')
    good, bad = snapshot_read(spark, str(tmp_path / "bad.json"), "array")
    assert good.count() == 0 and bad.count() == 1


def test_write_over_its_own_source(spark, tmp_path):
    for layout in ("lines", "array", "parquet"):
        path = str(tmp_path / layout)
        source = tmp_path / "source.json"
        source.write_text(json.dumps([r for r in RECORDS if r["job_id"] != "5"], ensure_ascii=False))
        good, _ = snapshot_read(spark, str(source), "array")
        snapshot_write(good, path, layout)
        again, _ = snapshot_read(spark, path, layout)
        snapshot_write(again.withColumn("title", F.concat("title", F.lit("é"))), path, layout)
        final, bad = snapshot_read(spark, path, layout)
        assert bad.count() == 0
        assert {r.job_id: r.title for r in final.collect()} == {"1": "Fullé", "2": "é", "3": "é", "4": "é", "6": "é"}
        assert times(final, "date_analyzed") == times(good, "date_analyzed")


def test_report_order_and_titles(spark, tmp_path):
    rows = [("a", "2024-01-01", "2024-01-05", ["x", "y"]), ("b", "2024-01-02", None, []), ("c", "2024-01-02", "2024-01-01", ["z"]),
            ("d", None, "2024-01-09", ["z"])]
    df = spark.createDataFrame(rows, "job_id string, date_analyzed string, posted_time string, technologies_required array<string>")
    df = df.withColumns({c: F.col(c).cast("timestamp") for c in ("date_analyzed", "posted_time")})
    df = df.withColumns({"title": F.lit("t"), "url": F.lit("u")})
    path = str(tmp_path / "report")
    write_report(df, path)
    back = spark.read.option("header", True).csv(path)
    assert back.columns[:3] == ["Title", "Date Analyzed", "Posted Time"] and back.columns[-1] == "Url"
    lines = [line for f in sorted((tmp_path / "report").glob("part-*.csv")) for line in f.read_text().splitlines()[1:]]
    ids = [line.split(",u")[0].rsplit(",", 5)[0] for line in lines]
    assert [next(i for i in "abcd" if f",{i}," in line) for line in lines] == ["c", "b", "a", "d"], ids
    assert '"x, y"' in "".join(lines)
    marked = sorted_report(df.withColumns({"title_lang": F.lit("FR"), "description_lang": F.lit("EN")}), ["job_id"]).collect()
    assert [(r.job_id, r.link, r.title_flag, r.description_flag) for r in marked] == [(i, "Link", True, False) for i in "cbad"]


def test_daily_run_twice(spark, tmp_path):
    search_pages, details = make_store(3, positions=1, pages=4)
    search = BoardASearch(positions="a", desired_language="en")
    pages = store_a(spark, search, search_pages, details)
    args = (pages, search, AS_OF, StopWordDetector(), str(tmp_path / "snap"), str(tmp_path / "report"))
    first = run_and_save(*args)
    kept = first.postings.count()
    assert kept > 0 and run_and_save(*args).postings.count() == 0
    saved, _ = snapshot_read(spark, str(tmp_path / "snap"))
    assert saved.count() == kept == spark.read.option("header", True).csv(str(tmp_path / "report")).count()


def test_daily_run_keeps_what_it_cannot_read(spark, tmp_path):
    search_pages, details = make_store(3, positions=1, pages=1)
    search = BoardASearch(positions="a", desired_language="en")
    pages = store_a(spark, search, search_pages, details)
    for layout in ("lines", "array"):
        snap = tmp_path / f"snap-{layout}"
        records = [r for r in RECORDS if r["job_id"] in "125"]
        if layout == "lines":
            snap.write_text("\n".join(json.dumps(r) for r in records))
        else:
            snap.write_text(json.dumps(records))
        args = (pages, search, AS_OF, StopWordDetector(), str(snap), str(tmp_path / f"report-{layout}"))
        for _ in range(2):
            run = run_and_save(*args, layout=layout)
            bad = [r.job_id for r in run.quarantined.collect() if r.reason == "unreadable posted_time"]
            saved = [r.job_id for r in snapshot_read(spark, str(snap), layout)[0].select("job_id").collect()]
            assert bad == ["5"] and {"1", "2"} <= set(saved) and len(saved) == len(set(saved))


def test_layouts_and_interrupted_writes(spark, tmp_path):
    empty = spark.createDataFrame([], STORED_SCHEMA)
    with pytest.raises(ValueError):
        snapshot_write(empty, str(tmp_path / "x"), "csv")
    with pytest.raises(ValueError):
        snapshot_read(spark, str(tmp_path / "x"), "csv")
    snapshot_write(empty, str(tmp_path / "none"), "array")
    assert snapshot_read(spark, str(tmp_path / "none"), "array")[0].count() == 0
    (tmp_path / "y.old-1").mkdir()
    with pytest.raises(RuntimeError):
        snapshot_read(spark, str(tmp_path / "y"))


def test_page_store(spark):
    search_pages, details = make_store(3, positions=1, pages=2)
    search = BoardASearch(positions="a")
    pages = store_a(spark, search, search_pages, details)
    frontier = pages.select("url").distinct().unionByName(spark.createDataFrame([("gone",), ("empty",)], "url string"))
    pages = pages.unionByName(spark.createDataFrame([("empty", "")], "url string, html string"))
    assert sorted(r.url for r in page_store.missing_pages(frontier, pages).collect()) == ["empty", "gone"]
    for limit in (10**9, 0):
        fetched = page_store.frontier_fetch(frontier, pages, limit_bytes=limit)
        assert sorted(r.url for r in fetched.filter("html is null").collect()) == ["empty", "gone"]
        assert fetched.select("url").distinct().count() == frontier.count()
    both = [
        sorted((r.url, len(r.cards)) for r in page_store.extract_for(frontier, pages, "url", page_cards, limit).collect())
        for limit in (10**9, 0)
    ]
    assert both[0] == both[1] and len(both[0]) == len({u for u, _ in both[0]})
