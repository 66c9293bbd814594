"""Files read in ranges give what one row per file gives."""

from __future__ import annotations

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spinlog.sources import export, ranges

ODD = ['a"b', "x\\", 'q\\"', "{", "}", "[", "]", ",", "}{", "\\\\", "é", "漢", "\n", "a}b\\", "{\"k\":1}", " "]


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 2 else 4)
    if kind == 0:
        return "".join(rng.choice(ODD) for _ in range(rng.randrange(6)))
    if kind < 4:
        return rng.choice([0, -1.5, None, True, "plain", ""])
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randrange(3))]
    return {rng.choice(ODD) + str(i): value(rng, depth + 1) for i in range(rng.randrange(4))}


def files(rng) -> dict[str, bytes]:
    made = {}
    for n in range(10):
        rows = [{"ts": "x", **{f"k{i}": value(rng) for i in range(rng.randrange(4))}} for _ in range(rng.randrange(40))]
        text = json.dumps(rows, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        made[f"fine {n}.json"] = text.encode()
    rows = [{"ts": "2024", "n": i, "s": rng.choice(ODD)} for i in range(200)]
    text = json.dumps(rows)
    made |= {k: v.encode() for k, v in {
        "trailing.json": text + " x", "second array.json": text + text, "object.json": '{"rows":' + text + "}", "scalar.json": "17",
        "cut.json": text[:-40], "in a string.json": text[:-1] + ',{"a":"b', "text.json": text[:-1] + ',"not an object"]', "braced.json": text[:-1] + ',"{}"]',
        "braced 2.json": text[:-1] + ', " {"]', "unclosed.json": text[:-1], "closed twice.json": text + "]", "empty array.json": "[]", "blank array.json": " [ \n ] ",
        "comma + 100%25.json": text[:-1] + ",]", "commas.json": text[:-1] + ",,1]", "no comma.json": text[:-1] + " {}]", "blank.json": " \n ",
        "numbers.json": "[1, 2, null, [3]]", "wrong end.json": text[:-1] + "}", "two values.json": '{"a":1},{"a":2}', "brace at end.json": '{"a":{"b":1}}',
        "slash.json": '[{"a":"\\\\"},{"b":"\\""}]', "bad escape.json": '[{"a":1}\\"]', "long.json": json.dumps([{"a": "}" * 900 + '"\\' * 300}, {"b": 1}]),
        "not json.json": "{not valid json", "spaces after.json": text + " \n\t "}.items()}
    return made


def same(a, b):
    key = lambda r: (r[0], -1 if r[1] is None else r[1])
    return sorted(map(tuple, a.collect()), key=key), sorted(map(tuple, b.collect()), key=key)


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    place = tmp_path_factory.mktemp("ranged")
    content = files(random.Random(3))
    for name, data in content.items():
        (place / name).write_bytes(data)
    return place, content


@pytest.mark.parametrize("size", ["400", "3000", "128m"])
def test_ranges_give_what_whole_files_give(spark, made, size):
    place, content = made
    whole = export.whole_file_records(export.file_listing(spark, str(place))).collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        if size == "400":
            splits = ranges._texts(spark, str(place), "*.json").groupBy("source_file").agg(F.countDistinct("start").alias("n"))
            assert splits.where("n > 3").count() > 5
        got, want = same(ranges.records(spark, str(place)), spark.createDataFrame(
            whole, "source_file string, source_index long, payload string, problem string"))
        assert [(r[0], r[1], r[3]) for r in got] == [(r[0], r[1], r[3]) for r in want]
        assert got == want
        hashes = {r.source_file: r.file_hash for r in ranges.file_hashes(spark, str(place)).collect()}
        assert hashes == {name: hashlib.sha256(data).hexdigest() for name, data in content.items()}
        some = ["text.json", "fine 3.json"]
        got, want = same(ranges.records(spark, str(place), only=some), spark.createDataFrame(
            [r for r in whole if r.source_file in some], "source_file string, source_index long, payload string, problem string"))
        assert got == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_small_files_are_read_in_one_pass_and_large_ones_in_two(spark, made, monkeypatch):
    place, content = made
    ranged = []
    count = ranges._summaries
    monkeypatch.setattr(ranges, "_summaries", lambda texts: ranged.append({r[0] for r in texts.select("source_file").collect()}) or count(texts))
    ranges.records(spark, str(place))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        ranges.records(spark, str(place))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert ranged == [set(), {name for name, data in content.items() if len(data) > 3000}]
    assert ranged[1]


def test_a_file_in_one_go_is_cut_as_its_ranges_are():
    rng = random.Random(5)
    texts = [*files(rng).values(), b"", b"[", b"]", b"][", b'"', b"[{}]}", b"[1],[2]", b"\xef\xbb\xbf[{}]", b'[{"a":"\xff"}]', b'[1]"', b"[1]]["]
    texts += [bytes(rng.choice(b'[]{}",\\a \n') for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    texts += [b"[" + t + b"]" for t in texts]
    for text in texts:
        elements, array, balanced, around = ranges._cut_whole(text)
        data = np.frombuffer(text, np.uint8)
        string = (np.cumsum(ranges._quotes(data)) & 1).astype(bool)
        assert array == (text.lstrip(b" \t\r\n")[:1] == b"[")
        assert balanced == (not string[-1:].any() and ranges._deeper(data, string).sum() == 0), text
        cutter = ranges._Cutter(("", 0, 0, 0, True, True, array))
        *pieces, outside = [*cutter.feed([text]), *cutter.finish()]
        assert (elements, around) == ([p[-1] for p in pieces], outside[-1].decode("latin-1")), text
