"""Crowded buckets of near-duplicate search: every link, few other pairs."""

import itertools
import random

import pytest

from plan_reading import exchanged_columns, python_functions
from postmill.llm import near_dedup


def shingles(text, width):
    words = text.split()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def test_texts_that_share_a_passage_pair_only_where_they_could_be_linked(spark):
    draw = random.Random(1)
    word = lambda: f"w{draw.randrange(10**6)}"
    passage = [word() for _ in range(60)]
    texts = [[word() for _ in range(draw.randrange(40, 90))] + passage for _ in range(150)]
    for _ in range(40):  # near copies of some, close to the bound on either side
        own = list(draw.choice(texts))
        for _ in range(draw.choice([2, 4, 5, 6, 7, 9])):
            own[draw.randrange(len(own))] = word()
        texts.append(own[: len(own) - draw.randrange(12)])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = {i: shingles(t, 2) for i, t in rows}
    want = {
        (x, y) for x, y in itertools.combinations(sorted(sets), 2)
        if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])
    }
    labels = spark.createDataFrame([(min(next(iter(want))), 7777), (max(next(iter(want))), 7777)], "node long, component long")
    joined = next(iter(want))
    docs = spark.createDataFrame(rows, "id long, text string")
    wanted = docs.select("id").checkpoint() if spark.sparkContext.getCheckpointDir() else docs.select("id")
    got = [tuple(sorted(r)) for r in near_dedup._prefix_pairs(wanted, docs, labels, 2, 80).collect()]
    assert want - {joined} <= set(got) and joined not in got and len(got) == len(set(got))
    assert len(want) > 8 and len(got) < 4 * len(want)


@pytest.mark.parametrize("members", [2, 1000])
def test_both_ways_of_a_bucket_find_the_same(spark, monkeypatch, members):
    monkeypatch.setattr(near_dedup, "PAIRED_MEMBERS", members)
    draw = random.Random(2)
    word = lambda: f"w{draw.randrange(10**6)}"
    passage = [word() for _ in range(60)]
    texts = [[word() for _ in range(35)] + passage for _ in range(60)]
    for base in range(20):
        own = list(texts[base])
        for _ in range(draw.choice([1, 4, 8])):
            own[draw.randrange(len(own))] = word()
        texts.append(own)
    sets = [shingles(" ".join(t), 2) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in itertools.combinations(range(len(texts)), 2):
        if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
            a, b = find(x), find(y)
            parent[max(a, b)] = min(a, b)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, 2).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_only_prefixes_of_crowded_texts_are_spread_out(spark, monkeypatch):
    """Near copies of one component share all their shingles, with a few texts besides."""
    draw = random.Random(3)
    word = lambda: f"w{draw.randrange(10**6)}"
    passage = [word() for _ in range(100)]
    texts = [[word() for _ in range(3)] + passage + [word() for _ in range(3)] for _ in range(80)]
    texts += [[word() for _ in range(60)] + passage for _ in range(20)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(40)], "node long, component long")
    spread, write = [], near_dedup.written

    def counted(df):
        out = write(df)
        if "shingle" in out.columns:
            spread.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "written", counted)
    got = {tuple(sorted(r)) for r in near_dedup._prefix_pairs(docs.select("id"), docs, labels, 2, 80).collect()}
    sets = [shingles(" ".join(t), 2) for t in texts]
    links = {
        (x, y) for x, y in itertools.combinations(range(len(texts)), 2)
        if y >= 40 and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])
    }
    assert links and links <= got and all(y >= 40 for _, y in got)
    assert max(spread) < sum(map(len, sets)) / 4


def test_prefixes_are_cut_by_one_python_function_a_stage(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b c d {i}") for i in range(20)], "id long, text string")
    labels = spark.createDataFrame([(0, 0)], "node long, component long")
    called, write = [], near_dedup.written
    monkeypatch.setattr(near_dedup, "written", lambda df: called.append((df.columns, python_functions(df))) or write(df))
    near_dedup._prefix_pairs(docs.select("id"), docs, labels, 2, 80)
    assert [n for columns, n in called if "shingle" in columns] == [1, 0]
    assert max(n for _, n in called) == 1


def test_texts_are_not_shuffled_to_drop_copies(spark, monkeypatch, tmp_path):
    docs = [(1, "a b c d e f g"), (2, "A b c d e f g"), (3, "other words that nobody else has"), (3, "a b"), (None, "x"), (4, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    want = {(i, t) for i, t in docs if i != 2}
    stored = spark.read.parquet(f"{tmp_path}/docs")
    kept = near_dedup.keep_one(stored)
    assert not any("text" in columns for columns in exchanged_columns(kept))
    assert {tuple(r) for r in kept.collect()} == want and kept.count() == len(want)
    monkeypatch.setattr(near_dedup, "fits_broadcast", lambda df: False)
    assert {tuple(r) for r in near_dedup.keep_one(stored).collect()} == want
