"""Greedy de-duplication and the prior anti join against sequential loops."""

import random

import pytest
from pyspark.sql import functions as F

from postmill.operators import greedy
from postmill.operators.components import components
from postmill.operators.greedy import greedy_dedup
from postmill.operators.joins import anti_join_prior


def sequential(edges):
    ids, pairs, kept = set(), set(), []
    for order, i, p in sorted(edges, key=lambda e: e[0]):
        if i not in ids and p not in pairs:
            ids.add(i), pairs.add(p), kept.append(order)
    return kept


def run(spark, edges, **options):
    df = spark.createDataFrame(edges, "o long, i string, p string")
    return sorted(r.o for r in greedy_dedup(df, ["o"], "i", "p", **options).collect())


def test_known_rows(spark):
    edges = [(1, "a", "p"), (2, "a", "q"), (3, "b", "q"), (4, "b", "r"), (5, "c", "p"), (6, "c", "s")]
    assert run(spark, edges) == [1, 3, 6]


@pytest.mark.parametrize("seed", range(3))
def test_random_edges(spark, seed):
    rng = random.Random(seed)
    n = rng.choice([50, 300, 1000])
    keys = rng.choice([5, 40, 200])
    edges = [
        (o, "" if rng.random() < 0.33 else str(rng.randrange(keys)), str(rng.randrange(keys))) for o in range(n)
    ]
    rng.shuffle(edges)
    assert run(spark, edges) == sequential(edges)
    if seed == 0:
        assert run(spark, edges, hot_min_rows=1) == sequential(edges)


def test_composite_order_and_empty_input(spark):
    rows = [(0, 1, "a", "p"), (0, 0, "a", "q"), (1, 0, "b", "q")]
    df = spark.createDataFrame(rows, "page int, card int, i string, p string")
    kept = greedy_dedup(df, ["page", "card"], "i", "p").select("page", "card").collect()
    assert [tuple(r) for r in kept] == [(0, 0)]
    assert greedy_dedup(df.filter("page > 5"), ["page", "card"], "i", "p").count() == 0


def test_null_order_is_an_error(spark):
    df = spark.createDataFrame([(1, "a", "p"), (None, "b", "q")], "o long, i string, p string")
    with pytest.raises(ValueError):
        greedy_dedup(df, ["o"], "i", "p")


@pytest.fixture
def cards_and_prior(spark):
    rng = random.Random(7)

    def posting(n):
        blank = rng.random() < 0.3
        return (n, f"T{rng.randrange(20)} ", "" if blank else f" c{rng.randrange(20)}", "" if blank else str(rng.randrange(60)))

    cards = [posting(n) for n in range(400)]
    prior = [(n, t.upper(), c.upper(), i) for n, t, c, i in (posting(n) for n in range(15))]
    return cards, prior


@pytest.mark.parametrize("hot_min_rows, limit_bytes", [(10**6, 0), (1, 0), (10**6, 10**9)])
def test_anti_join_prior(spark, cards_and_prior, hot_min_rows, limit_bytes):
    cards, prior = cards_and_prior
    schema = "n int, title string, company string, job_id string"
    a, b = spark.createDataFrame(cards, schema), spark.createDataFrame(prior, schema)

    def same(x, y):
        return x[3] == y[3] or (x[1].strip().lower(), x[2].strip().lower()) == (y[1].strip().lower(), y[2].strip().lower())

    expected = [c[0] for c in cards if not any(same(c, p) for p in prior)]
    got = anti_join_prior(a, b, rows=len(cards), hot_min_rows=hot_min_rows, limit_bytes=limit_bytes)
    assert sorted(r.n for r in got.collect()) == expected
    assert 0 < len(expected) < len(cards)


def test_anti_join_plan_has_no_nested_loop(spark):
    schema = "n int, title string, company string, job_id string"
    empty = spark.createDataFrame([], schema)
    plan = anti_join_prior(empty, empty)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_null_keys_compare_as_blank(spark):
    schema = "n int, title string, company string, job_id string"
    cards = spark.createDataFrame([(1, None, None, "a"), (2, "t", "c", None), (3, "t", "d", "b")], schema)
    prior = spark.createDataFrame([(1, "", " ", ""), (2, "x", "y", "z")], schema)
    assert [r.n for r in anti_join_prior(cards, prior).select(F.col("n")).collect()] == [3]


def test_an_order_shared_by_two_rows_is_refused(spark):
    with pytest.raises(ValueError):
        run(spark, [(1, "a", "p"), (1, "a", "q")])


def test_repeated_rows_are_refused(spark):
    for extra in ([(1, "a", "p")], [(1, "a", "q")]):
        with pytest.raises(ValueError):
            run(spark, [(1, "a", "p"), (2, "b", "q"), *extra])
    # Repeats of a row that goes change nothing.
    assert run(spark, [(1, "a", "p"), (2, "a", "q"), (2, "a", "q"), (3, "c", "q")]) == [1, 3]


def chain(n):
    """Each row shares one key with the row before it, so every other row stays."""
    return [(o, f"i{(o + 1) // 2}", f"p{o // 2}") for o in range(n)]


def test_a_long_chain_takes_a_handful_of_jobs(spark):
    edges = chain(10_000)
    spark.sparkContext.setJobGroup("chain", "a chain of conflicts")
    try:
        assert run(spark, edges) == sequential(edges) == list(range(0, 10_000, 2))
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain")) < 25
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_many_long_chains_are_split_into_components(spark):
    rng = random.Random(5)
    edges = []
    for n in range(12):
        edges += [(o * 12 + n, f"{n}{i}", f"{n}{p}") for o, i, p in chain(rng.randrange(50, 90))]
    rng.shuffle(edges)
    assert run(spark, edges, walked_rows=100, rounds=1) == sequential(edges)


@pytest.mark.parametrize("mixed", [False, True])
def test_a_chain_longer_than_a_walk_takes_few_jobs(spark, mixed):
    edges = chain(20_000)
    if mixed:  # the same links, met in an order that leaves no block to itself
        places = list(range(len(edges)))
        random.Random(3).shuffle(places)
        edges = [(places[o], i, p) for o, i, p in edges]
    group = f"longer chain {mixed}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        assert run(spark, edges, walked_rows=1000) == sorted(sequential(edges))
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) < 150
    finally:
        spark.sparkContext.setJobGroup("", "")


@pytest.mark.parametrize("seed", range(2))
def test_a_dense_component_larger_than_a_walk_is_settled_block_by_block(spark, seed):
    rng = random.Random(seed)
    edges = [(o, str(o // 7 + rng.randrange(9)), str(o // 7 + rng.randrange(9))) for o in range(1500)]
    assert run(spark, edges, walked_rows=150, rounds=1) == sequential(edges)


def test_the_first_block_is_settled_and_the_rest_freed_of_its_keys(spark):
    edges = [(o, str(rng), str(o // 3)) for o in range(300) for rng in [o // 2]]
    df = spark.createDataFrame(edges, "_o long, i string, p string").select(
        "_o", F.struct("i").alias("_i"), F.struct("p").alias("_p")
    )
    stay, rest, left = greedy._first_block(df, 300, 100, 10**6)
    got, later = sorted(r[0] for r in stay.collect()), sorted(r[0] for r in rest.select("_o").collect())
    want = sequential(edges)
    assert got and later and left == len(later) and got == want[: len(got)] and got[-1] < later[0]
    assert sequential([edges[o] for o in later]) == want[len(got) :]


@pytest.mark.parametrize("walked_rows, rounds", [(0, 3), (60, 2)])
def test_every_way_to_finish_gives_the_sequential_rows(spark, walked_rows, rounds):
    rng = random.Random(walked_rows)
    edges = [(o, str(rng.randrange(90)), rng.choice([None, *map(str, range(90))])) for o in range(260)]
    assert run(spark, edges, walked_rows=walked_rows, rounds=rounds) == sequential(edges)


def test_components_are_least_reachable_nodes(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 470)] + [(900, 900)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
