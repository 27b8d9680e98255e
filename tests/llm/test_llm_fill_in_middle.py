"""Cuts over memoized chunks against cuts over the list of lines."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from postmill.llm import fill_in_middle as fim


def reference(doc_id, text, seed="7", percent=100, suffix_first=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    one, other = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = "".join(lines[:one]), "".join(lines[one:other]), "".join(lines[other:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return len(lines), "plain", None, None, text
    if h[3] % 100 < suffix_first:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    draw = random.Random(5)
    alphabet = "ab é☃𝄞<>PSM\n\r\n "
    passage = "".join(draw.choice("abcdefgh é\n") for _ in range(4000))
    yield from (None, "", "\n", "\n\n\n", "a", "é", "a\n", "<P", "<M>", "x<S>y", "<\nP>", "\r\n\x0b\x85")
    for n in (1, 2, 3, 40, 700, 3000):
        for _ in range(8):
            yield "".join(draw.choice(alphabet) for _ in range(n))
    for _ in range(20):  # a passage that many share, after beginnings of any length
        yield "".join(draw.choice("xyz☃\n") for _ in range(draw.randrange(900))) + passage
    yield "no line ends " * 40_000
    yield "𝄞\n" * 200_000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, text, "own", 3) for i, text in enumerate(texts())]
    rows += [rows[20], rows[20], (None, "no\nid\nat all", "own", 3), (None, None, "own", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, fim string, n int")


@pytest.mark.parametrize("percent, suffix_first", [(100, 50), (40, 0), (70, 100)])
def test_rows_equal_cuts_of_line_lists(docs, percent, suffix_first):
    done = fim.transform(docs, percent=percent, suffix_first=suffix_first)
    assert done.columns == docs.columns
    restored = fim.restore(F.col("fim.text"), F.col("fim.form")).alias("restored")
    for row in done.select("doc_id", "text", "n", "fim", restored).collect():
        assert tuple(row["fim"]) == reference(row["doc_id"], row["text"], "7", percent, suffix_first)
        assert row["restored"] == (row["text"] or "") and row["n"] == 3


def test_empty_table(docs):
    assert fim.transform(docs.limit(0)).count() == 0


def test_shared_chunks_are_summarised_once_and_kept_within_bounds():
    passage = "".join(random.Random(6).choice("abcdef \n") for _ in range(60_000)).encode()
    summaries = fim.Summaries()
    fim.locate(passage, 3, 9, summaries)
    first = len(summaries.kept)
    fim.locate(b"something else in front " * 7 + passage, 3, 9, summaries)
    assert summaries.hits >= 0.95 * first and len(summaries.kept) <= first + 4
    small = fim.Summaries(20_000)
    whole = [fim.locate(passage, a, 7 * a, small) for a in range(1, 40)]
    assert whole == [fim.locate(passage, a, 7 * a, fim.Summaries()) for a in range(1, 40)]
    assert small.held <= 20_000


def test_sentinels_across_chunk_ends_are_seen(monkeypatch):
    monkeypatch.setattr(fim, "chunk_ends", lambda raw: list(range(1, len(raw) + 1)))
    for text, held in (("a<P>b", True), ("a<P b<S", False), ("<<M>", True), ("é\n<S>", True)):
        lines, marked, *_ = fim.locate(text.encode(), 1, 1, fim.Summaries())
        assert marked == held and lines == len(re.findall(r"[^\n]*\n|[^\n]+", text))
