"""Cases of the second review: what the operators must not leave out."""

from __future__ import annotations

import random

from spinlog.llm import decontaminate, jaccard, pii, simhash


def five_words(text):
    words = text.lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(11)
    rows = []
    for k in range(60):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(4, 300))] + ["the same line under every text here"] * (k % 2)
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(copy)))
    cuts = [five_words(t) for _, t in rows]
    group = list(range(len(rows)))
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if 9 * len(cuts[i] & cuts[j]) >= 4 * (len(cuts[i]) + len(cuts[j]))]
    for _ in rows:
        for i, j in pairs:
            group[i] = group[j] = min(group[i], group[j])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.near_duplicates(df).collect())) == list(enumerate(group))
    fours = [simhash.fingerprint(t) for _, t in rows]
    assert any((fours[i] ^ fours[j]).bit_count() > 4 for i, j in pairs)  # what four bits leave unlinked


def test_items_in_another_case_go(spark):
    item = "a train leaves the town of Zagreb at 40 km per hour and meets Anna Kovac near Split station"
    rows = [(1, "so " + item.upper()), (2, "so " + item.lower()), (3, "so " + item), (4, "nothing of the kind here"), (None, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, "short")], "item_id long, text string")
    assert {r["doc_id"]: r["kind"] for r in decontaminate.find_any(docs.filter("doc_id > 0"), bench).collect()} == {1: "exact", 2: "exact", 3: "exact"}
    assert {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()} == {4, None}


def test_one_changed_value_loses_no_other_window(spark):
    item = "a train leaves the town of Zagreb at 40 km per hour and after 40 minutes it meets another train near Zagreb station"
    docs = spark.createDataFrame([(1, "so " + item.replace("at 40", "at 72")), (2, "so " + item.replace("near Zagreb", "near Paris")),
                                  (3, "so " + item)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r["doc_id"]: (r["kind"], r["coverage"]) for r in decontaminate.find_any(docs, bench).collect()}
    assert got[1] == ("mixed", 1.0) and got[3] == ("exact", 1.0) and 0.5 < got[2][1] < 1
    assert decontaminate.clean(docs, bench).count() == 0


def test_disguises_do_not_need_a_hint_elsewhere(monkeypatch):
    for text, span in [("write to joe at example.com today", "joe at example.com"), ("host one.one.one.one up", "one.one.one.one"),
                       ("host 192.168.one.five up", "192.168.one.five"), ("host 10.0.0.one up", "10.0.0.one")]:
        (_, begin, end), = pii.all_spans(text)[1]
        assert text[begin:end] == span
    assert pii.all_spans("meet at noon.then go, plus a dot") == ([], [])
    rng = random.Random(12)
    bits = ["joe", " at ", "example", ".com", ".", " dot ", "dot", "@", " ", "[at]", "(dot)", "_at_", "one", "five", "192", "10", "0", "plus ", "+", "-", ", ", "noon.then"]
    made = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(20_000)]
    gated = [pii.all_spans(t) for t in made]
    monkeypatch.setattr(pii, "changeable", lambda text: True)
    assert gated == [pii.all_spans(t) for t in made]
