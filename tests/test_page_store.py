"""Bloom filters, stores laid out by address, and what their plans move."""

import random

import pytest
from pyspark.sql import functions as F

from postmill.operators.bloom import BloomFilter
from postmill.sources import page_store
from plan_reading import exchanged_columns


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    draw = random.Random(3)
    pages = [(f"https://x/{i}", None if i % 11 == 0 else "" if i % 13 == 0 else f"<p>{i}</p>") for i in range(3000)]
    pages += [(None, "<p>no address</p>"), ("https://x/1", "<p>1</p>")]
    wanted = [(n, f"https://x/{draw.randrange(4000)}") for n in range(1500)] + [(5000, None)]
    path = str(tmp_path_factory.mktemp("pages"))
    spark.createDataFrame(pages, "url string, html string").repartition(6).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), spark.createDataFrame(wanted, "n long, url string"), pages, wanted


def test_a_filter_loses_no_key_and_stops_most_others(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    others = spark.range(20_000, 60_000).select(F.concat(F.lit("k"), "id").alias("key"))
    own = BloomFilter.of(keys, "key", 20_000)
    assert own.keep(keys, "key").count() == 20_000
    assert own.keep(others, "key").count() < 0.08 * 40_000
    small = BloomFilter.of(keys, "key", 20_000, max_words=16)  # full, but still without false negatives
    assert small.words == 16 and small.table.count() == 16
    assert small.keep(keys, "key").count() == 20_000
    none = BloomFilter.of(keys.filter("key IS NULL"), "key", 0)
    assert none.keep(others, "key").count() == 0
    nulls = others.withColumn("key", F.lit(None).cast("string"))
    assert own.keep(nulls, "key").count() == 0


def test_a_filter_is_tested_without_a_shuffle(tables):
    pages, wanted, *_ = tables
    kept = BloomFilter.of(wanted, "url", 1500).keep(pages, "url")
    assert kept.columns == ["url", "html"]
    assert not any("html" in columns for columns in exchanged_columns(kept))


@pytest.mark.parametrize("limit_bytes", [10**9, 0])
@pytest.mark.parametrize("laid_out", [False, True])
def test_fetch_equals_a_dictionary(spark, tables, tmp_path, limit_bytes, laid_out):
    pages, wanted, rows, asked = tables
    if laid_out:
        page_store.store_pages(pages, str(tmp_path / "store"), 5)
        pages = page_store.open_store(spark, str(tmp_path / "store"), 5)
    content = {}
    for url, html in rows:
        if html:
            content.setdefault(url, []).append(html)
    content.pop(None)
    want = sorted((n, html or "") for n, url in asked for html in content.get(url, [None]))
    got = page_store.frontier_fetch(wanted, pages, limit_bytes=limit_bytes)
    assert sorted((r.n, r.html or "") for r in got.collect()) == want
    missing = page_store.missing_pages(wanted, pages, limit_bytes=limit_bytes)
    assert sorted(r.n for r in missing.collect()) == sorted(n for n, url in asked if url not in content)


def test_no_html_moves_but_that_of_wanted_pages(spark, tables, tmp_path):
    pages, wanted, *_ = tables
    page_store.store_pages(pages, str(tmp_path / "store"), 5)
    store = page_store.open_store(spark, str(tmp_path / "store"), 5)
    for source, limit_bytes in ((pages, 10**9), (store, 10**9), (store, 0)):
        fetched = page_store.frontier_fetch(wanted, source, limit_bytes=limit_bytes)
        assert not any("html" in columns for columns in exchanged_columns(fetched))
        assert fetched.count() > 1500
    for limit_bytes in (10**9, 0):
        absent = page_store.missing_pages(wanted, pages, limit_bytes=limit_bytes)
        assert not any("html" in columns for columns in exchanged_columns(absent))
    # A plain table is not laid out by address, so the wanted pages, and only they, move.
    kept = page_store.of_wanted(wanted, pages, "url", 0)
    assert kept.count() < 0.6 * pages.count()
    assert kept.join(wanted, "url", "left_anti").count() < 0.1 * pages.count()


def test_extraction_reads_wanted_pages_alone(spark, tables):
    pages, wanted, *_ = tables
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(html):
        read.add(1)
        return html[3:-4]

    extract = lambda df: df.select("url", seen("html").alias("number"))
    got = page_store.extract_for(wanted, pages, "url", extract, limit_bytes=0).collect()
    assert all(r.url.endswith(f"/{r.number}") for r in got) and len(got) > 800
    assert read.value < 0.55 * pages.count()
