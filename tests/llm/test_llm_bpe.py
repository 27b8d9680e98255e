import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from postmill.llm import bpe


@pytest.fixture(scope="module")
def own():
    return bpe.vocabulary(bpe.read_ranks(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(own):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def ids_of(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_random_texts_encode_as_the_library_does(own, library):
    draw = random.Random(5)
    texts = [
        "".join(chr(draw.choice([draw.randrange(1, 0x250), draw.randrange(32, 127), draw.randrange(0x250, 0x3FFF), draw.choice([9, 10, 28, 32, 0x85, 0xA0, 0x2028, 0x1F600])])) for _ in range(draw.randrange(80)))
        for _ in range(600)
    ]
    for text, packed in zip(texts, own.encode_batch(texts), strict=True):
        assert ids_of(packed) == library.encode_ordinary(text)
        assert own.decode(packed) == text.encode()


def test_long_pieces_take_the_same_merges(own, library):
    draw = random.Random(6)
    for n in (bpe.MATRIX_BYTES - 1, bpe.MATRIX_BYTES, bpe.MATRIX_BYTES + 1, 4000):
        text = "".join(draw.choice("abcdehilnorst") for _ in range(n))
        assert ids_of(own.encode_batch([text])[0]) == library.encode_ordinary(text)
        matrix = own._merge_rows([text.encode()], 1 << (n - 1).bit_length())[0]
        assert matrix == own.merge_long(text.encode())


def test_a_full_cache_is_renewed(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 600)
    monkeypatch.setattr(bpe, "ROUND_BYTES", 4)
    own.forget()
    texts = ["one two three four", "five six seven", "one two", "a" * 300 + " one"]
    assert [ids_of(x) for x in own.encode_batch(texts)] == [library.encode_ordinary(t) for t in texts]
    assert own.cached <= 600 and max(map(len, own.cache)) <= bpe.CACHED_PIECE
    own.forget()
    assert not own.cache and own.cached == 0


def test_rows_with_nulls_empties_repeats_and_taken_names(spark, library):
    rows = [(None, None, 1), (1, "", 2), (2, "Hello, hello!", 3), (2, "Hello, hello!", 3), (3, "x" * 5000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    got = bpe.decode_ids(bpe.encode_texts(docs)).collect()
    assert len(got) == 5
    for row in got:
        assert ids_of(row["ids"]) == library.encode_ordinary(row["text"] or "")
        assert bytes(row["decoded"]) == (row["text"] or "").encode()
    assert bpe.encode_texts(docs.limit(0)).collect() == []
    for keep in (True, False):
        coded = bpe.code_texts(docs, output="ids", keep_decoded=keep).collect()
        assert len(coded) == 5 and all(r["ids"]["same"] for r in coded) and ("decoded" in coded[0]["ids"]) == keep
        assert Counter(bytes(r["ids"]["ids"]) for r in coded) == Counter(bytes(r["ids"]) for r in got)
    assert bpe.code_texts(docs.limit(0)).collect() == []
