"""What the plans must not contain, and what must reach the scan."""

import re

import pytest
from pyspark.sql import functions as F

from postmill import BoardASearch, StopWordDetector
from postmill.functions.markup import html_to_text
from postmill.operators.cards import page_cards
from postmill.operators.filters import posting_predicates
from postmill.operators.quota import pages_used
from postmill.sources.frontier import search_frontier_a
from postmill.sources.page_store import extract_for


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "pages")
    spark.createDataFrame([("u", "<p>x</p>", 1)], "url string, html string, other int").write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("limit_bytes", [10**9, 0])
def test_html_is_never_shuffled(spark, stored, limit_bytes):
    wanted = search_frontier_a(spark, BoardASearch(), 0, 3)
    text = plan(extract_for(wanted, stored.select("url", "html"), "url", page_cards, limit_bytes))
    lines = text.splitlines()
    for n, line in enumerate(lines):
        if "Exchange" in line and "Broadcast" not in line:
            below = next(x for x in lines[n + 1:] if "Project" in x or "Aggregate" in x or "Sort" in x)
            assert "html#" not in re.sub(r"functions=.*|aggregate\(.*|transform\(.*", "", below)
    assert "ReadSchema: struct<url:string,html:string>" in text
    assert ("LeftSemi" in text) == (limit_bytes > 0)


def test_language_of_text_needs_no_shuffle(stored):
    df = stored.select("url", StopWordDetector().detect(html_to_text(F.col("html"))).alias("lang"))
    assert "Exchange" not in plan(df)


def test_predicates_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "postings")
    spark.sql(
        "SELECT timestamp'2024-01-01' AS posted_time, 'Yes' AS easy_apply, 'x' AS location, 'y' AS seniority_level"
    ).write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    df = posting_predicates(
        spark.read.parquet(path), "2024-01-02", max_age_days=3, easy_apply=True, seniority=["y"], locations=["x"]
    )
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan(df)).group(1)
    for part in ("GreaterThanOrEqual(posted_time", "EqualTo(easy_apply", "seniority_level", "location"):
        assert part in pushed
    assert df.count() == 1


def test_quota_windows_stay_within_blocks(spark):
    counts = spark.createDataFrame([(0, "p", 0, 1, False)], "position_no int, position string, page int, n int, failed boolean")
    text = plan(pages_used(counts, "position_no", 5, 5, F.col("failed")))
    assert "NestedLoop" not in text and "Cartesian" not in text
