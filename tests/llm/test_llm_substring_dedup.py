"""Repeated windows by doubling against a dictionary of all windows."""

import random
from collections import Counter

import numpy as np
import pytest

from postmill.llm import substring_dedup as dedup

SCHEMA = "doc_id long, text string, cut string, marks int, a string"


def reference(rows, window):
    """(words, removed, kept) by (id, text); equal rows of one id are one document."""
    key = {}
    for doc_id, text, *_ in rows:
        key[doc_id, text or ""] = None
    ids = Counter(d for d, _ in key)
    assert max(n for d, n in ids.items() if d is not None) == 1  # the order of others is by hash
    first, out = {}, {}
    for doc_id, text in sorted(key, key=lambda k: (k[0] is None, k[0] or 0)):
        words = text.encode().split()
        gone = np.zeros(len(words), bool)
        for i in range(len(words) - window + 1):
            if first.setdefault(tuple(words[i : i + window]), (doc_id, i)) != (doc_id, i):
                gone[i : i + window] = True
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out[doc_id, text] = (len(words), int(gone.sum()), b" ".join(kept))
    return out


def documents(window):
    draw = random.Random(window)
    word = lambda: f"w{draw.randrange(5000)}"
    passages = [[word() for _ in range(n)] for n in (window - 1, window, window + 1, 3 * window, 200)]
    few = ["yes", "No", "yes,"]
    rows = [(-1, None), (-2, ""), (-3, " \n\t "), (-4, "one"), (-5, "é ü one\x0btwo\x85three")]
    for i in range(60):
        words = [word() for _ in range(draw.randrange(60))]
        for _ in range(draw.choice([0, 1, 1, 2, 3])):
            words += draw.choice(passages) + [word() for _ in range(draw.randrange(6))]
        rows.append((i * 7 % 60, draw.choice([" ", "\n", " \t "]).join(words)))
    rows += [(100 + i, " ".join(passages[3])) for i in range(30)]
    rows += [(200, " ".join(["again"] * (5 * window))), (201, " ".join(["again"] * (window + 3)))]
    rows += [(300 + i, " ".join(draw.choice(few) for _ in range(400))) for i in range(5)]
    rows.append((400, " ".join(word() for _ in range(30_000)) + " " + " ".join(passages[4])))
    rows += [rows[10], rows[10], (None, " ".join(passages[4]))]
    return [(*r, "own", 7, "x") for r in rows]


@pytest.mark.parametrize("window", [20, 7, 2])
def test_kept_words_equal_brute_force(spark, monkeypatch, window):
    monkeypatch.setattr(dedup, "SOURCE_BYTES", 20_000)
    monkeypatch.setattr(dedup, "BUCKET_BYTES", 60_000)
    rows = documents(window)
    want = reference(rows, window)
    got = dedup.drop_repeats(spark.createDataFrame(rows, SCHEMA).repartition(5), window)
    assert set(got.columns) == {"doc_id", "text", "cut", "marks", "a"}
    got = got.collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(r[:2] for r in rows)
    for row in got:
        assert tuple(row["cut"]) == want[row["doc_id"], row["text"] or ""] and row["marks"] == 7
    assert sum(r["cut"]["n_removed"] for r in got) > 1000


def test_ids_shared_by_unequal_texts_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "x", 1, "x"), (1, "front " + text, "x", 1, "x"), (None, text, "x", 1, "x"), (None, "end " + text, "x", 1, "x")]
    got = dedup.drop_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    removed = Counter((r["doc_id"], r["cut"]["n_removed"]) for r in got)
    assert removed == {(1, 0): 1, (1, 40): 1, (None, 40): 2}


def test_small_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert dedup.drop_repeats(empty).count() == 0
    none = spark.createDataFrame([(1, None, "x", 1, "x"), (2, "a b", "x", 1, "x")], SCHEMA)
    assert {r["cut"]["kept"] for r in dedup.drop_repeats(none).collect()} == {b"", b"a b"}
    with pytest.raises(ValueError):
        dedup.drop_repeats(none, window=1)


def test_a_full_window_picks_the_same_half_wherever_it_stands():
    draw = random.Random(3)
    window = [f"w{draw.randrange(6)}" for _ in range(20)]
    seen = set()
    for _ in range(50):
        front = [f"x{draw.randrange(99)}" for _ in range(draw.randrange(30))]
        own = dedup.Windows([" ".join(front + window + ["end"]).encode()], 20)
        seen.add(int(own.picked()[own.full.tolist().index(len(front))]) - len(front))
    assert len(seen) == 1


def test_a_bucket_tells_every_place_but_the_first_in_any_order_of_arrival(monkeypatch):
    draw = random.Random(9)
    entries = [(draw.randrange(40), source, place) for source in range(30) for place in range(10)]
    first = {}
    for name, source, place in entries:
        first[name] = min(first.get(name, (99, 99)), (source, place))
    want = sorted((s, p) for n, s, p in entries if first[n] != (s, p))
    for step in (1, 7, 10**6):
        bucket, got = dedup.Bucket(2, later=True), []
        for source in draw.sample(range(30), 30):
            own = [(n, p) for n, s, p in entries if s == source]
            names = np.array([[n, n * n] for n, _ in own], np.uint64)
            places = np.array([p for _, p in own], "<u4")
            bucket.add(source, names.tobytes(), places.tobytes(), np.array([0], "<u4").tobytes(), np.array([source, 5]).tobytes())
            if bucket.n >= step:
                got += bucket.merge()
        got += bucket.merge()
        assert sorted((s, int(p)) for s, packed in got for p in np.frombuffer(packed, "<u4")) == want


def test_no_text_is_in_the_exchanges_of_names(spark):
    texts = spark.createDataFrame([(1, 2, bytearray(b"a b c"))], "a long, b long, text binary")
    plan = dedup._repeated(texts, 20, 3, later=False)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and not any("text" in line for line in exchanges)
