"""Stop rules and running totals against a sequential walk."""

import random

import pytest
from pyspark.sql import functions as F

from postmill.operators import metrics, quota

SCHEMA = "position_no int, position string, page int, n int, failed boolean"


def walk(counts, cap, cap_total, run=5):
    """Pages used, as the loop over positions and pages takes them."""
    used, total = [], 0
    for position in sorted({c[0] for c in counts}):
        if total >= cap_total:
            break
        kept, empty = 0, 0
        for _, _, page, n, failed in sorted(c for c in counts if c[0] == position):
            if kept >= cap or total >= cap_total or failed:
                break
            used.append((position, page))
            kept, total = kept + n, total + n
            empty = 0 if n else empty + 1
            if empty == run:
                break
    return used


def counts_of(lists):
    return [
        (p, f"p{p}", page, 0 if n is None else n, n is None)
        for p, values in enumerate(lists) for page, n in enumerate(values)
    ]


def used_pages(spark, counts, cap, cap_total, block):
    df = spark.createDataFrame(counts, SCHEMA)
    used = quota.pages_used(df, "position_no", cap, cap_total, F.col("failed"), block=block)
    return sorted((r.position_no, r.page) for r in used.collect())


@pytest.mark.parametrize(
    "cap, values, pages",
    [
        (5, [3, 3, 4], [0, 1]),
        (100, [2, 0, 0, 0, 0, 0, 9], [0, 1, 2, 3, 4, 5]),
        (100, [0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 7], list(range(10))),
        (0, [4], []),
        (100, [1, None, 2], [0]),
    ],
)
def test_known_rows(spark, cap, values, pages):
    assert used_pages(spark, counts_of([values]), cap, 1000, 4) == [(0, p) for p in pages]


@pytest.mark.parametrize("block", [3, 8, 65536])
def test_random_positions(spark, block):
    rng = random.Random(block)
    for cap, cap_total in ((10**6, 10**6), (20, 900), (25, 120)):
        lists = [
            [rng.choice([0, 0, 0, 1, 3]) if rng.random() > 0.01 else None for _ in range(30)] for _ in range(60)
        ]
        counts = counts_of(lists)
        assert used_pages(spark, counts, cap, cap_total, block) == walk(counts, cap, cap_total)


def test_short_positions(spark):
    rng = random.Random(5)
    lists = [[rng.choice([0, 0, 0, 1, 3]) if rng.random() > 0.01 else None for _ in range(30)] for _ in range(60)]
    counts = counts_of(lists)
    used = quota.short_position_used(spark.createDataFrame(counts, SCHEMA), 20, F.col("failed"))
    assert sorted((r.position_no, r.page) for r in used.collect()) == walk(counts, 20, 10**9)


def test_progress(spark):
    counts = counts_of([[2, 0, 3], [1], [4, 4]])
    df = spark.createDataFrame(counts, SCHEMA)
    rows = metrics.progress_metrics(df, "position_no", block=2).orderBy("position_no", "page").collect()
    assert [(r.position_total, r.run_total) for r in rows] == [(2, 2), (2, 2), (5, 5), (1, 6), (4, 10), (8, 14)]
    same = metrics.progress_metrics(df.drop("position_no"), "position").orderBy("position", "page").collect()
    assert [r.run_total for r in same] == [2, 2, 5, 6, 10, 14]
