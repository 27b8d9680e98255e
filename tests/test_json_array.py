"""Arrays cut by many tasks against a whole-file parser."""

import json
import random
import tracemalloc

import pytest

from postmill.sources import json_array

NASTY = ['{"', '"}', "\\", '\\"', "[", "]", "}", "{", ",", "é", "𝄞", "\n", "\t", "text ", '\\\\"', "}{", "],["]


def records(seed, n):
    draw = random.Random(seed)
    text = lambda: "".join(draw.choice(NASTY) for _ in range(draw.randrange(12)))
    return [
        {"job_id": str(i), "title": text(), text() or "k": draw.choice([None, 1, [text()], {"deep": [{"er": text()}]}])}
        for i in range(n)
    ]


@pytest.fixture
def small_splits(spark):
    kept = {}
    for name, value in (("spark.sql.files.maxPartitionBytes", "97b"), ("spark.sql.files.openCostInBytes", "1b"), ("spark.sql.files.minPartitionNum", "1")):
        kept[name] = spark.conf.get(name, None)
        spark.conf.set(name, value)
    yield
    for name, value in kept.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def read(spark, path, **options):
    return [r.value for r in json_array.array_elements(spark, str(path), **options).collect()]


@pytest.mark.parametrize("indent, limit_bytes", [(None, 10**9), (4, 10**9), (None, 0)])
def test_elements_equal_a_parse_of_the_whole_file(spark, tmp_path, small_splits, indent, limit_bytes):
    rows = records(indent or 0, 60)
    (tmp_path / "a.json").write_text(json.dumps(rows[:40], indent=indent, ensure_ascii=False) + "\n")
    (tmp_path / "b.json").write_text(json.dumps(rows[40:], indent=indent, ensure_ascii=True))
    (tmp_path / "empty.json").write_text(" [ ]\n")
    (tmp_path / "nothing.json").write_text("")
    got = read(spark, tmp_path, limit_bytes=limit_bytes)
    key = lambda r: json.dumps(r, sort_keys=True)
    assert sorted(map(key, map(json.loads, got))) == sorted(map(key, rows))
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 20


def test_one_element_may_cross_many_splits(spark, tmp_path, small_splits):
    rows = [{"a": 1}, {"long": '"}{' * 2000, "more": [{"x": "\\" * 101}] * 30}, {"b": 2}]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    assert sorted(map(len, read(spark, tmp_path))) == sorted(len(json.dumps(r)) for r in rows)


def test_what_is_no_object_comes_out_as_it_stands(spark, tmp_path):
    cases = {
        '[1, "x", {"a": 1}, [2], null]': ['"x"', '1, "x"', "[2]", "null", '{"a": 1}'],
        '[{"a": 1}, {"b": 2': ['{"a": 1}', '{"b": 2'],
        '{"a": {"b": 1}}\n{"c": 2}\n': ['{"a": {"b": 1}}', '{"c": 2}'],
    }
    for n, (text, want) in enumerate(cases.items()):
        (tmp_path / str(n)).mkdir()
        (tmp_path / str(n) / "x.json").write_text(text)
        got = read(spark, tmp_path / str(n))
        assert set(got) <= set(want) and "".join(sorted(got)).count('"a"') == 1


def test_any_cut_of_a_text_gives_the_same_states():
    text = json.dumps(records(7, 6)).encode()
    depth, closing, end = json_array.scan(text, json_array.OUTSIDE)
    assert end == json_array.OUTSIDE and depth[-1] == 0
    for cut in range(1, len(text)):
        one, one_closing, state = json_array.scan(text[:cut], json_array.OUTSIDE)
        two, two_closing, last = json_array.scan(text[cut:], state)
        assert last == end
        assert [*one, *(two + one[-1])] == list(depth) and [*one_closing, *two_closing] == list(closing)


def states_of(raw, state):
    """(places, closing, depths, end) of the brackets outside strings, byte by byte."""
    depth, found = 0, []
    for at, byte in enumerate(raw):
        char = chr(byte)
        if state == json_array.ESCAPED:
            state = json_array.INSIDE
        elif state == json_array.INSIDE:
            state = {"\\": json_array.ESCAPED, '"': json_array.OUTSIDE}.get(char, state)
        elif char == '"':
            state = json_array.INSIDE
        elif char in "{[]}":
            depth += 1 if char in "{[" else -1
            found.append((at, char in "]}", depth))
    return found, state


def test_brackets_equal_a_walk_over_the_bytes():
    draw = random.Random(8)
    for _ in range(3000):
        raw = "".join(draw.choice(['"', "\\", "\\", "{", "}", "[", "]", "a", "é"]) for _ in range(draw.randrange(1, 14))).encode()
        for state in range(3):
            if any("\\" in part for part in outside_parts(raw.decode(), state)):
                continue
            places, closes, depths, end = json_array.Brackets(raw).outside(state)
            found = list(zip(places.tolist(), closes.tolist(), depths.tolist(), strict=True))
            assert (found, end) == states_of(raw, state), raw


def outside_parts(text, state):
    """The stretches outside strings; JSON has no backslash there."""
    part, out = "", []
    for char in text:
        if state == json_array.OUTSIDE:
            part += char
        if state == json_array.ESCAPED:
            state = json_array.INSIDE
        elif state == json_array.INSIDE:
            state = {"\\": json_array.ESCAPED, '"': json_array.OUTSIDE}.get(char, state)
        elif char == '"':
            state = json_array.INSIDE
            out.append(part)
            part = ""
    return [*out, part]


def test_a_split_is_summed_over_its_marks_not_its_bytes():
    raw = json.dumps([{"id": i, "text": "nothing to see here " * 40} for i in range(1000)]).encode()
    split = json_array.Split()
    tracemalloc.start()
    try:
        split.add(raw)
        assert tracemalloc.get_traced_memory()[1] < 4 * len(raw)
    finally:
        tracemalloc.stop()
    assert split.size == len(raw) and split.depth[json_array.OUTSIDE] == 0
