"""Small tables with nulls, ties, repeats and extra columns, held against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill.llm import (
    components,
    decontamination,
    language_model,
    near_dedup,
    personal_data,
    sharding,
    toxicity,
    url_filter,
    warc,
    winnowing,
)
from postmill.llm.elias_fano import EliasFano, Trie, quantise

DOCS = "doc_id long, text string, a string, key long, label double"


def words(n, seed):
    draw = random.Random(seed)
    return [f"w{draw.randrange(400)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    """Families of near copies, exact copies, repeats, nulls, empties and one long text."""
    rows, draw = [(None, "no id at all", "x", 1, 0.0), (900, None, "x", 1, 0.0), (901, "", "x", 1, 0.0), (902, " \n\t", "x", 1, 0.0), (903, "One", "x", 1, 0.0), (904, "one", "x", 1, 0.0)], random.Random(1)
    for family in range(6):
        base = words(120, family)
        for copy in range(14):
            own = list(base)
            for _ in range(draw.choice([0, 1, 3, 6, 9, 14])):
                own[draw.randrange(len(own))] = f"e{draw.randrange(10**6)}"
            rows.append((family * 20 + copy, " ".join(own), "x", 1, 0.0))
    rows += [rows[10], rows[10], (905, " ".join(words(20_000, 99)), "x", 1, 0.0)]
    return spark.createDataFrame(rows, DOCS)


def test_components_are_least_reachable_nodes(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500), (None, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(spark, corpus, width):
    rows = corpus.collect()
    sets = {}
    for row in rows:
        own = (row["text"] or "").encode().lower().split()
        if row["doc_id"] is not None:
            sets[row["doc_id"]] = {tuple(own[i : i + width]) for i in range(max(1, len(own) - width + 1))} if own else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = near_dedup.near_duplicates(corpus, width).collect()
    assert len(got) == len(rows)
    for row in got:
        if row["doc_id"] is None:
            assert row["component_id"] is None and row["kept"]
        else:
            assert (row["component_id"], row["n_shingles"]) == (find(row["doc_id"]), len(sets[row["doc_id"]]))
            assert row["kept"] == (row["component_id"] == row["doc_id"])
    kept = near_dedup.keep_one(corpus, width)
    assert kept.columns == corpus.columns
    want = [r["doc_id"] for r in rows if r["doc_id"] is None or find(r["doc_id"]) == r["doc_id"]]
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(map(str, want))
    assert near_dedup.near_duplicates(corpus.limit(0), width).count() == 0


def test_pairs_beside_a_hub_lose_no_link(spark):
    draw, rows, labels, sets = random.Random(11), [], [], {}
    for hub in (1000, 2000):
        sets[hub] = set(range(hub, hub + 60))
        common = set(range(hub + 500, hub + 506))  # what most members add
        for group in range(8):
            added = {draw.randrange(10**6, 10**7) for _ in range(draw.choice([4, 9, 14]))}
            left = draw.sample(sorted(sets[hub]), draw.choice([46, 52, 60]))
            for member in range(5):
                own = set(left) | added | (common if draw.random() < 0.8 else set())
                own -= set(draw.sample(sorted(own), draw.choice([0, 2, 5])))
                b = hub + 10 * group + member + 1
                sets[b] = own
                c = len(own & sets[hub])
                novel = np.array(sorted(own - sets[hub]), np.uint64).tobytes()
                rows.append((hub, b, 60, len(own), c, bytearray(novel)))
                if 180 * c >= 80 * (60 + len(own)):
                    labels.append((b, hub))
        labels.append((hub, hub))
    # Two parts of one hub that add nothing to it.
    sets[2901], sets[2902] = set(range(2000, 2040)), set(range(2001, 2041))
    rows += [(2000, b, 60, 40, 40, bytearray()) for b in (2901, 2902)]
    compared = spark.createDataFrame(rows, "a long, b long, n_a long, n_b long, common long, novel binary")
    named = dict(labels)
    got = near_dedup._beside_hubs(compared, spark.createDataFrame(labels, "node long, component long"), 80).collect()
    got = [(min(r), max(r)) for r in got]
    want = set()
    for hub in (1000, 2000):
        for x, y in itertools.combinations(sorted(r[1] for r in rows if r[0] == hub), 2):
            if named.get(x, x) != named.get(y, y) and 180 * len(sets[x] & sets[y]) >= 80 * (len(sets[x]) + len(sets[y])):
                want.add((x, y))
    assert (2901, 2902) in want and len(want) > 20
    assert want <= set(got) and len(got) <= len(set(got)) * 2


def test_elias_fano_finds_what_is_there():
    draw = np.random.default_rng(0)
    for universe, n in ((1 << 20, 4000), (1 << 62, 3000), (64, 64), (9, 0), (1 << 50, 1)):
        values = np.unique(draw.integers(0, universe, n).astype(np.uint64))
        coded = EliasFano.build(values, universe)
        asked = np.concatenate((values, draw.integers(0, universe, 2000).astype(np.uint64)))
        at = {int(v): i for i, v in enumerate(values)}
        assert coded.search(asked).tolist() == [at.get(int(v), -1) for v in asked]
        assert (coded.access(np.arange(len(values))) == values).all()


@pytest.mark.parametrize("mapped", [False, True])
def test_trie_levels_are_followed_by_their_pointers(mapped):
    draw = np.random.default_rng(1)
    names = np.unique(np.concatenate((np.array([0, 2**64 - 1], np.uint64), draw.integers(0, 2**64, 300, np.uint64))))
    words = np.unique(np.concatenate(([0, 2**40 - 1], draw.integers(0, 2**40, 40))).astype(np.uint64))
    pairs = {(int(draw.choice(names[::2])), int(draw.choice(words))): int(draw.integers(1, 9)) for _ in range(2000)}
    context, successor = (np.array(x, np.uint64) for x in zip(*sorted(pairs), strict=True))
    trie = Trie.build(context, successor, np.array([pairs[p] for p in sorted(pairs)], float), 40, 0.75)
    trie = trie.mapped() if mapped else trie
    levels = trie.contexts, trie.pointers, trie.successors
    assert all(isinstance(level, EliasFano) for level in levels) and trie.pointers.size == trie.contexts.size + 1
    places, backoffs = trie.context_codes(names)
    own = sorted({a for a, _ in pairs})
    assert places.tolist() == [own.index(int(n)) if int(n) in own else -1 for n in names]
    got = trie.codes(places, np.full(len(names), len(words)), np.tile(words, len(names))).reshape(len(names), -1)
    for name, backoff, codes in zip(names.tolist(), backoffs, got, strict=True):
        after = {b: n for (a, b), n in pairs.items() if a == name}
        total = sum(after.values())
        assert backoff == (quantise(np.log10(np.array([0.75 * len(after) / total])))[0] if after else 0)
        want = [quantise(np.log10(np.array([(after[w] - 0.75) / total])))[0] if w in after else 0 for w in words.tolist()]
        assert codes.tolist() == want
    # The answer comes from the range between two pointers: without it, nothing is found.
    trie.pointers = EliasFano.build(np.zeros(len(own) + 1, np.uint64), 1)
    assert not trie.codes(places, np.full(len(names), len(words)), np.tile(words, len(names))).any()
    empty = Trie.build(context[:0], successor[:0], np.zeros(0), 40, 0.75).mapped()
    assert empty.context_codes(names)[0].max() == -1 and not empty.codes(np.full(3, -1), np.ones(3, int), words[:3]).any()


def test_language_model_equals_brute_force(spark, corpus):
    trains = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 1
    rows = corpus.collect()
    tokens = [(r["text"] or "").encode().lower().split() + [b"</>"] for r in rows]
    used = [zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 != 1 for r in rows]
    single, pairs = Counter(), Counter()
    for own, trained in zip(tokens, used, strict=True):
        if trained:
            single.update(own)
            pairs.update(zip([b"<>", *own], own, strict=False))
    after, kinds = Counter(), Counter()
    for (a, _), n in pairs.items():
        after[a] += n
        kinds[a] += 1
    total, mass = sum(single.values()), sum(single.values()) + 0.5 * (len(single) + 1)
    want = Counter()
    for row, own in zip(rows, tokens, strict=True):
        base = [math.log10((single[w] + 0.5) / mass) for w in own]
        score = sum(
            math.log10(max(pairs[a, w] - 0.75, 0) / after[a] + 0.75 * kinds[a] / after[a] * 10**p) if after[a] else p
            for a, w, p in zip([b"<>", *own], own, base, strict=False)
        )
        want[row["doc_id"], len(own), sum(single[w] > 0 for w in own), round(sum(base), 6), round(score / len(own), 2)] += 1
    got = language_model.score(corpus, trains).collect()
    assert {r["train_tokens"] for r in got} == {total}
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"] / r["n_tokens"], 2)) for r in got) == want
    assert language_model.score(corpus.limit(0), trains).count() == 0
    assert {r["score"] for r in language_model.score(corpus.limit(1), F.lit(False)).collect()} == {0.0}


def test_toxicity_learns_and_takes_any_row(spark):
    draw = random.Random(4)
    rows = []
    for i in range(400):
        own = words(40, i)
        if i % 4 == 0:
            own[draw.randrange(40)] = draw.choice(["you idiot,", "zorkel!", "st*pid"])
        rows.append((i, " ".join(own), "x", 1, 0.0))
    docs = spark.createDataFrame([*rows, (None, "idiot", "x", 1, 0.0), (1000, None, "x", 1, 0.0), (1001, "", "x", 1, 0.0), rows[0]], DOCS)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    assert "zorkel" in model.lexicon
    got = toxicity.score(docs, model, output="label").collect()
    assert len(got) == docs.count() and all(0 <= r["label"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 400 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum((r["label"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in held) / len(held) > 0.9
    empty = toxicity.fit(docs, labels.limit(0))
    assert {r["label"] for r in toxicity.score(docs, empty, output="label").collect()} == {0.0}
    assert {r["label"] for r in toxicity.score(docs, toxicity.fit(docs, labels.filter("toxic = 1")), output="label").collect()} == {1.0}


def test_url_classes_carry_blocks_but_not_over_allows(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "https://a.example.org/es/1", "<html>"),
        (2, "http://b.example.net/x", link.format("https://a.example.org/es/1")),
        (3, "http://c.example.net/y", '<META http-equiv=refresh content="0; url=http://b.example.net/x#top">'),
        (4, "http://d.example.net/z", link.format("http://x.com/de/3")),
        (5, "http://y.com/fr/3", link.format("http://d.example.net/z/")),
        (6, "http://X.com/de/3", None),
        (7, None, "<link>"), (8, "no scheme", "x"), (9, "", ""), (3, "http://c.example.net/y", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit(1))
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages).collect()}
    assert got == {
        (1, "a.example.org", "/es/1", "example.org/es/", "block"), (2, "b.example.net", "/x", None, "block"),
        (3, "c.example.net", "/y", None, "block"), (4, "d.example.net", "/z", None, "allow"),
        (5, "y.com", "/fr/3", "com/fr/", "allow"), (6, "x.com", "/de/3", "com/de/", "block"),
        (7, "", "", None, "allow"), (8, "", "", None, "allow"), (9, "", "", None, "allow"),
    }
    assert url_filter.judge(pages).count() == 10 and url_filter.judge(pages.limit(0)).count() == 0


def test_revisits_resolve_like_a_sequential_pass(spark):
    draw, rows = random.Random(8), []
    for i in range(300):
        kind = draw.choice(["response", "revisit"])
        tag = draw.choice(['"a"', 'W/"a"', '"b"', None])
        url = draw.choice(["http://x.org/1", "https://www.x.org/1/", "http://x.org/2", "http://y.org/", None, "bad"])
        rows.append((i, kind, url, draw.choice([None, *range(0, 4_000_000, 100_000)]), tag, draw.choice(["m1", "m2", None]), f"d{i}", {"ETag": "e", "Content-Type": kind, "X-N": str(i)} if i % 9 else None))
    records = spark.createDataFrame(rows, "record_id long, record_type string, url string, captured long, etag string, last_modified string, digest string, headers map<string,string>")
    form = lambda u: None if u is None or "://" not in u else re.sub(r"/$", "", re.sub(r"^https?://(www\.)?", "", u))
    got = {r["record_id"]: r for r in warc.resolve(records).collect()}
    assert sorted(got) == [r[0] for r in rows if r[1] == "revisit"]
    for i, kind, url, at, tag, modified, _, headers in rows:
        if kind != "revisit":
            continue
        earlier = [r for r in rows if r[1] == "response" and form(url) and form(r[2]) == form(url) and at is not None and r[3] is not None and (r[3], r[0]) < (at, i)]
        base = max(earlier, key=lambda r: (r[3], r[0]), default=None)
        assert got[i]["base_id"] == (base and base[0])
        if base is None:
            assert got[i]["status"] == "no earlier response"
            continue
        bare = lambda t: t.removeprefix("W/")
        agrees = bare(tag) == bare(base[4]) if tag and base[4] else modified == base[5] if modified and base[5] else None
        assert got[i]["status"] == {None: "no validator", True: "resolved", False: "validator mismatch"}[agrees]
        if agrees:
            own = {k.lower(): v for k, v in (base[7] or {}).items()} | {k.lower(): v for k, v in (headers or {}).items() if k != "Content-Type"}
            assert (got[i]["headers"], got[i]["digest"]) == (own, base[6])
    assert warc.resolve(records.limit(0)).count() == 0


def test_winnowing_keeps_rightmost_least_hashes_and_its_guarantee():
    draw = random.Random(2)
    for n in (0, 1, 15, 16, 17, 48, 49, 300):
        text = "".join(draw.choice("aab é😀") for _ in range(n))
        hashes = winnowing.gram_hashes(text).tolist()
        want = []
        for start in range(max(0, len(hashes) - winnowing.WINDOW) + 1 if hashes else 0):
            own = hashes[start : start + winnowing.WINDOW]
            place = start + max(i for i, h in enumerate(own) if h == min(own))
            if place not in want:
                want.append(place)
        found, places = winnowing.winnow(text)
        assert places.tolist() == want and found.tolist() == [hashes[i] for i in want]
    shared = "".join(draw.choice("abcdefgh ") for _ in range(winnowing.GRAM + winnowing.WINDOW - 1))
    one, two = (winnowing.winnow("".join(draw.choice("xyz") for _ in range(90)) + shared + "q" * n)[0] for n in (5, 70))
    assert set(one.tolist()) & set(two.tolist())


def test_edited_texts_follow_descending_ids(spark, corpus):
    rows = sorted(corpus.collect(), key=lambda r: (-(r["doc_id"] if r["doc_id"] is not None else -(2**63)), r["text"] or ""))
    want = Counter()
    for row, after in zip(rows, [*rows[1:], rows[0]], strict=True):
        own, next_ = row["text"] or "", after["text"] or ""
        cut = len(own) // 3
        changed = own[: len(own) - cut] + next_[:cut]
        prints = [winnowing.winnow(t) for t in (own, changed, next_)]
        want[row["doc_id"], len(own), hashlib.sha256(changed.encode()).hexdigest(), winnowing.packed(*prints[0]), winnowing.packed(*prints[1]), winnowing.likeness(prints[0][0], prints[1][0]), winnowing.likeness(prints[0][0], prints[2][0])] += 1
    assert Counter(map(tuple, winnowing.compare_edited(corpus).collect())) == want
    assert winnowing.compare_edited(corpus.limit(0)).count() == 0
    alone = winnowing.compare_edited(spark.createDataFrame([(4, "abc")], "doc_id long, text string")).first()
    assert alone["near_next"] == 1.0


def test_new_shards_only_take_and_weights_hold(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("slot"))
    moved = sharding.assign(sharding.assign(docs, sharding.EIGHT), sharding.grown(sharding.EIGHT, 8), shard="next")
    assert moved.filter("next <> shard AND next <> 8").count() == 0
    share = {r["next"]: r["count"] for r in moved.groupBy("next").count().collect()}
    assert all(abs(n - 20_000 / 9) < 250 for n in share.values()) and len(share) == 9
    heavier = {**sharding.EIGHT, "region-1": {"rack-0": {4: 3.0, 5: 1.0}, "rack-1": {6: 1.0, 7: 1.0}}}
    changed = sharding.assign(sharding.assign(docs, sharding.EIGHT), heavier, shard="next").filter("next <> shard")
    # Rows move into the region and rack that grew, never between or inside the others.
    assert changed.filter("next < 4").count() == 0 and changed.filter("shard < 4 OR next IN (4, 5)").count() == changed.count()


def test_slots_have_no_gaps(spark, corpus):
    rows = sharding.number(sharding.assign(corpus, sharding.EIGHT)).collect()
    assert len(rows) == corpus.count()
    by = {}
    for row in rows:
        by.setdefault(row["shard"], []).append(row["slot"])
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())
    assert sharding.number(sharding.assign(corpus.limit(0), sharding.EIGHT)).count() == 0


def items_and_passages(seed=11):
    draw = random.Random(seed)
    common = ["the", "of", "and", "to"]
    items = [(i, " ".join(draw.choice([draw.choice(common), f"v{draw.randrange(300)}"]) for _ in range(draw.randrange(8, 50))) + ". It is " + f"answer{i % 7} here.") for i in range(90)]
    return items, common, draw


def test_block_max_wand_retrieves_what_brute_force_does():
    items, common, draw = items_and_passages()
    frequency = Counter(w for _, t in items for w in set(decontamination.words_of(t.lower())))
    mean = sum(len(decontamination.words_of(t)) for _, t in items) / len(items)
    for threshold in (0.2, 0.35, 0.5, 0.8):
        index = decontamination.ItemIndex(items, frequency, len(items), mean, threshold)
        weights = [{} for _ in items]
        for word, postings in index.postings.items():
            for item, weight in zip(postings.items, postings.weights, strict=True):
                weights[item][word] = weight
        for _ in range(120):
            own = [draw.choice([*common, f"v{draw.randrange(300)}"]) for _ in range(60)]
            if draw.random() < 0.6:
                taken = decontamination.words_of(draw.choice(items)[1])
                own[10 : 10 + len(taken)] = taken[: draw.randrange(1, len(taken) + 1)]
            terms = set(own)
            scores = {i: sum(w for t, w in weights[i].items() if t in terms) for i in range(len(items))}
            want = {i for i, s in scores.items() if s >= threshold}
            found = dict(index.search(terms))
            assert set(found) == want and all(abs(found[i] - scores[i]) < 1e-9 for i in found)
            assert not want or index.gated(own)


def test_leaks_are_found_and_others_left(spark):
    items, common, draw = items_and_passages()
    clean = [(i, " ".join(draw.choice([*common, f"u{draw.randrange(900)}"]) for _ in range(300))) for i in range(30)]
    leaked = [(100 + i, f"{clean[i][1]} {items[i][1].upper()} {clean[i + 1][1]}") for i in range(20)]
    rows = [(i, t, "x", 1, 0.0) for i, t in [*clean, *leaked, leaked[0], (None, items[3][1]), (800, None), (801, "")]]
    docs = spark.createDataFrame(rows, DOCS)
    benchmark = spark.createDataFrame([*items, (500, None), (501, " ")], "item_id long, text string")
    found = decontamination.find(docs, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} >= {(100 + i, i) for i in range(20)} | {(None, 3)}
    assert {r["doc_id"] for r in found} == {100 + i for i in range(20)} | {None}
    kept = decontamination.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == 30 + 3
    assert decontamination.find(docs, benchmark.limit(0)).count() == 0
    assert decontamination.find(docs.limit(0), benchmark).count() == 0


def test_items_in_several_blocks_give_the_same(spark, monkeypatch):
    items, _, _ = items_and_passages()
    docs = spark.createDataFrame([(i, t) for i, t in items], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(decontamination.find(docs, benchmark).collect())
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 25)
    assert [(r["doc_id"], r["item_id"]) for r in sorted(decontamination.find(docs, benchmark).collect())] == [(r["doc_id"], r["item_id"]) for r in whole]


PII = [
    "mail a.b@x.example.com, a@b@c.org and @d.org or e@f", "ip 10.0.0.255 256.1.1.1 1.2.3.4.5.6.7.8",
    "card 4539 1488 0343 6467 and 4539148803436468", "call +1 (017) 555-7713 or +12", "x+1-234-567-89012 45391488-0343-6467 1.1.1.1", "", None,
]


def brute_spans(text):
    patterns = [
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
    ]
    out = []
    for kind, pattern in enumerate(patterns):
        for match in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", match.group())
            doubled = [int(d) if i % 2 == 0 else int(d) * 2 - 9 * (int(d) > 4) for i, d in enumerate(reversed(digits))]
            if (
                kind == 0 or kind == 1 and all(int(p) <= 255 for p in match.group().split("."))
                or kind == 2 and 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0 or kind == 3 and 10 <= len(digits) <= 15
            ):
                out.append((match.start(), kind, match.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    draw = random.Random(9)
    texts = [t for t in PII if t] + ["".join(draw.choice("ab.@-+ 0123456789%_()é") for _ in range(draw.randrange(90))) for _ in range(4000)]
    for text in texts:
        assert personal_data.base_spans(text) == brute_spans(text), text


def test_beliefs_are_exact_on_trees():
    draw = np.random.default_rng(1)
    unary, pairs = draw.normal(size=(5, 5)), np.array([(0, 1), (1, 2), (1, 3)])
    tables = draw.normal(size=(3, 5, 5))
    weights = np.zeros((5, 5))
    for y in itertools.product(range(5), repeat=5):
        p = math.exp(sum(unary[i, y[i]] for i in range(5)) + sum(t[y[i], y[j]] for (i, j), t in zip(pairs, tables, strict=True)))
        for i in range(5):
            weights[i, y[i]] += p
    assert np.allclose(personal_data.beliefs(unary, pairs, tables), weights / weights.sum(1, keepdims=True), atol=1e-3)


def test_repeats_of_a_found_token_are_added(spark):
    rows = [(i, f"filler {i} mail user{i}@mail.example.com text ip 10.0.0.{i % 200} and then 10.0.0.{i % 200} again", "x", 1, 0.0) for i in range(60)]
    rows += [(100 + i, t, "x", 1, 0.0) for i, t in enumerate(PII)] + [(None, "x 1.2.3.4", "x", 1, 0.0), rows[0]]
    rows.append((200, "call +1 (017) 555-7713 now " + "filler " * 40 + "number 555-7713 once more", "x", 1, 0.0))
    docs = spark.createDataFrame(rows, DOCS)
    model = personal_data.fit(docs)
    got = personal_data.detect(docs, model, output="label").collect()
    assert len(got) == len(rows)
    for row in got:
        base = [tuple(s) for s in row["label"]["base"]]
        spans = [tuple(s) for s in row["label"]["spans"]]
        assert base == brute_spans(row["text"] or "") and set(base) <= set(spans)
        for start, _, end in set(spans) - set(base):
            assert all(end <= s or e <= start for s, _, e in base)
    assert not any("4539148803436468"[:8] == r["text"][s:e][:8] for r in got for s, k, e in [tuple(x) for x in r["label"]["spans"]] if r["text"] and r["text"][s:e] == "4539148803436468")
    masked = {r["doc_id"]: r["text"] for r in personal_data.mask(docs, model).collect()}
    assert masked[106] is None and masked[105] == "" and "[EMAIL]" in masked[5] and "@" not in masked[5]
    assert personal_data.detect(docs.limit(0), personal_data.fit(docs.limit(0))).count() == 0


def test_the_skip_edge_carries_a_label():
    model = personal_data.potentials({("shape", "9.9", "0"): 5, ("shape", "9.9", "4"): 5, ("skip", "4", "4"): 50, ("skip", "0", "0"): 500, ("chain", "0", "0"): 50})
    unary = np.array([model[0]["9.9"], model[0]["9.9"]])
    unary[0, 4] += personal_data.HELD
    alone = personal_data.beliefs(unary, np.zeros((0, 2), np.int64), np.zeros((0, 5, 5)))
    tied = personal_data.beliefs(unary, np.array([(0, 1)]), model[3][None])
    assert tied[1, 4] > 0.9 > alone[1, 4]
