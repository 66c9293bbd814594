"""License scans: the words that name a license count; coverage against the longest common subsequence."""

from __future__ import annotations

import random
import time

import pytest

from spinlog.llm import license
from spinlog.llm.license import LEAST, NAMES, TEMPLATES, Scanner, align, words_of


@pytest.fixture(scope="module")
def scanner():
    return Scanner(TEMPLATES, LEAST, NAMES)


@pytest.mark.parametrize("text", [
    "Released under the BSD License", "released under the new license", "Licensed under CC BY 3.0",
    "This work is licensed under the GNU General Public License, version 1",
    "This work is licensed under the GNU Lesser General Public License, version 3",
    "Licensed under the Apache License, Version 1.1", "Licensed under CC BY-NC-ND 4.0", "Licensed under CC BY-ND 4.0",
])
def test_other_licenses_are_not_taken(scanner, text):
    assert scanner.scan(text) == [] == scanner.scan(f"{text}. {text} ".strip())


def test_templates_are_found_whole_bent_and_after_look_alikes(scanner):
    for name, text in TEMPLATES.items():
        found = scanner.scan(f"Some words before. {text} And after.")
        assert [(f[0], f[1]) for f in found] == [(name, 1.0)], name
    assert [f[0] for f in scanner.scan("Licensed under CC BY 3.0. Licensed under CC BY 4.0")] == ["CC-BY-4.0"]
    assert [f[0] for f in scanner.scan("This is released under the MIT License, and licensed under CC BY-SA 4.0")] == ["MIT", "CC-BY-SA-4.0"]
    assert [f[0] for f in scanner.scan("Released today under the MIT License")] == ["MIT"]


def common(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
    return row[-1]


def test_alignment_is_a_common_subsequence(scanner):
    rng = random.Random(2)
    for name, text in TEMPLATES.items():
        words = words_of(text)
        for _ in range(20):
            bent = [w for w in words if rng.random() > 0.1]
            for _ in range(3):
                bent.insert(rng.randint(0, len(bent)), rng.choice([*words, "other"]))
            pairs = align(bent, words)
            assert all(bent[i] == words[j] for i, j in pairs)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
            assert len(pairs) <= common(bent, words)
            if bent == words:
                assert len(pairs) == len(words)


def test_many_notices_in_one_text_take_linear_time(scanner):
    def seconds(n: int) -> float:
        begin = time.process_time()
        assert len(scanner.scan("Licensed under CC BY 4.0 . also here . " * n)) == n
        return time.process_time() - begin

    assert seconds(8000) < 6 * max(seconds(2000), 0.05)


def test_names_must_stand_in_their_template(spark):
    with pytest.raises(ValueError, match="not in the template"):
        Scanner({"x": "one two"}, LEAST, {"x": ["three"]})
    docs = spark.createDataFrame([(1, "one two four"), (2, None), (2, ""), (None, "one two")], "doc_id long, text string")
    assert sorted(r["doc_id"] or 0 for r in license.scan(docs, {"x": "one two"}).collect()) == [0, 1]
