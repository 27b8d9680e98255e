"""The stages of the corpus pipeline on a toy corpus, each against plain Python on its own input."""

import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from postmill.llm import bpe

COLUMNS = corpus_pipeline.COLUMNS
ITEM = "Which river crosses the old town of Arvel before it meets the sea? The river is called Ombra by everyone there."
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    draw = random.Random(12)
    word = lambda: draw.choice("stone river garden letter window paper summer winter table music story bridge".split()) + str(draw.randrange(60))
    rows, labels = [], []
    for i in range(160):
        words = [word() for _ in range(60)]
        if i % 4 == 0:
            for _ in range(4):
                words[draw.randrange(60)] = draw.choice(["zorkel", "you grunfs!", "STUPID zorkel"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    for i in range(12):  # near copies of clean documents
        words = rows[4 * i + 1][1].split()
        words[draw.randrange(60)] = word()
        rows.append((200 + i, " ".join(words)))
    rows += [(300 + i, " ".join(word() for _ in range(50)) + " " + ITEM + " " + " ".join(word() for _ in range(50))) for i in range(3)]
    rows += [(400, "Write to anna.berg@mail.example or call +49 (30) 1234 5678 from 10.20.30.40 " + rows[1][1][::-1])]
    rows += [(500, None), (501, ""), (None, "a text that has no id and stands for itself alone"), (502, " ".join(word() for _ in range(9000)))]
    folder = str(tmp_path_factory.mktemp("toy"))
    full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    full.append(full[5])
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.fixture(scope="module")
def outputs(spark, tables):
    """(input rows, output rows) of every stage."""
    docs, out = spark.read.parquet(f"{tables}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, tables)
        rows = done.collect()
        out[name] = (docs.collect(), rows, done.columns)
        docs = spark.createDataFrame(rows, done.schema)
    return out


def texts(rows):
    return {(r["doc_id"], r["text"]) for r in rows}


def test_all_but_the_last_stage_give_documents(outputs):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert outputs[name][2] == COLUMNS


def test_toxic_documents_go_and_clean_ones_stay(outputs):
    before, after, _ = outputs["toxicity"]
    toxic = {r["doc_id"] for r in before if r["text"] and ("zorkel" in r["text"] or "grunfs" in r["text"])}
    kept = {r["doc_id"] for r in after}
    assert len(toxic & kept) <= 2 and len({r["doc_id"] for r in before} - toxic - kept) <= 2
    assert texts(after) <= texts(before)


def test_one_of_each_group_of_near_copies_stays(outputs):
    before, after, _ = outputs["near duplicates"]
    sets = {}
    for row in before:
        words = (row["text"] or "").lower().split()
        if row["doc_id"] is not None and words:
            sets[row["doc_id"]] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    least = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            one, two = sorted((least[a], least[b]))
            least = {i: one if of == two else of for i, of in least.items()}
    want = {r["doc_id"] for r in before if r["doc_id"] not in least or least[r["doc_id"]] == r["doc_id"]}
    assert {r["doc_id"] for r in after} == want and len(want) < len({r["doc_id"] for r in before})


def test_documents_with_an_item_go(outputs):
    before, after, _ = outputs["decontamination"]
    assert texts(after) == {(i, t) for i, t in texts(before) if ITEM not in (t or "")}
    assert any(ITEM in (r["text"] or "") for r in before)


def test_personal_data_gives_way_and_other_texts_stay(outputs):
    before, after, _ = outputs["personal data"]
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    told = {r["doc_id"]: r for r in after}
    assert not any(mail.search(r["text"] or "") or "10.20.30.40" in (r["text"] or "") for r in after)
    assert all(r["n_chars"] == len(r["text"] or "") for r in after if r["text"] is not None)
    assert "+49" not in told[400]["text"] and "Write to" in told[400]["text"]
    others = [(i, t) for i, t in texts(before) if i != 400 and t]
    assert sum(told[i]["text"] == t for i, t in others) >= len(others) - 1


def test_ids_are_those_of_the_library(outputs):
    before, after, columns = outputs["encoding"]
    own = bpe.vocabulary(bpe.read_ranks(), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    want = sorted((str(r["doc_id"]), library.encode_ordinary(r["text"] or "")) for r in before)
    got = sorted((str(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist()) for r in after)
    assert got == want and all(r["round_trip"] for r in after)
    assert all(r["n_tokens"] == len(r["ids"]) // 4 for r in after) and columns == ["doc_id", "n_tokens", "ids", "round_trip"]


def test_empty_tables_and_further_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(3)
    wide = docs.selectExpr("*", "1 AS score", "'x' AS _toxicity", "doc_id AS label")
    for name in ("near duplicates", "decontamination"):
        assert STAGES[name](spark, wide, tables).columns == COLUMNS
        assert STAGES[name](spark, docs.limit(0), tables).count() == 0
    assert STAGES["encoding"](spark, docs.limit(0), tables).count() == 0


def test_stages_bound_the_rows_of_an_arrow_batch(spark, tables):
    docs, name = spark.read.parquet(f"{tables}/documents.parquet"), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for given, want in (("10000", str(corpus_pipeline.ARROW_ROWS)), ("0", str(corpus_pipeline.ARROW_ROWS)), ("100", "100")):
            spark.conf.set(name, given)
            STAGES["encoding"](spark, docs, tables)
            assert spark.conf.get(name) == want
    finally:
        spark.conf.set(name, before)
