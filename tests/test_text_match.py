"""Text forms, marks, similarity and the lossless filter before it."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from spinlog.functions import fuzzy, markers, text
from spinlog.functions.blocks import ratios
from spinlog.operators import match


def apply(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[1] for r in df.select("i", fn(F.col("t")).alias("o")).orderBy("i").collect()]


@pytest.mark.parametrize(("raw", "norm"), [
    ("HELLO", "hello"), ("The Beatles", "beatles"), ("  Beyoncé ", "beyonce"), ("Don’t “stop”", "don't \"stop\""),
    ("a   b\t c", "a b c"), (None, ""), ("", ""), ("the the band", "the band"), ("the", "the"), ("Theory", "theory"),
    ("Straße", "strasse"), ("1–2—3−4", "1-2-3-4"), (" x y ", "x y"), ("ﬁ", "fi"), ("ΣΑΣ", "σασ"), ("İ", "i"),
])
def test_normalize(spark, raw, norm):
    assert apply(spark, [raw], text.normalize_text) == [norm]


def test_normalize_twice_changes_nothing(spark):
    rng = random.Random(5)
    letters = "aBé  -(the)ßÅ’ ﬀ"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    words = [w for w in words if not w.lower().strip().startswith("the")]
    once = apply(spark, words, text.normalize_text)
    again = apply(spark, once, text.normalize_text)
    assert [a for a, o in zip(again, once) if not o.startswith("the ")] == [o for o in once if not o.startswith("the ")]


@pytest.mark.parametrize(("title", "base"), [
    ("X - Single Version", "X"), ("X (Remastered 2011)", "X"), ("X [Deluxe]", "X"), ("X (Live) - Remastered", "X"),
    ("(Intro)", "(Intro)"), ("X-Y", "X-Y"), ("A - B - C", "A"), ("A (b) [c] (d) - e", "A"), ("X (a (b))", "X (a (b))"),
    ("", ""), ("Plain", "Plain"), ("A" + " (x)" * 40, "A"),
])
def test_strip_suffixes(spark, title, base):
    assert apply(spark, [title], text.strip_suffixes) == [base]


@pytest.mark.parametrize(("title", "base", "names"), [
    ("Song (feat. A)", "Song", ["A"]), ("Song featuring A and B", "Song", ["A", "B"]), ("Song ft. A, B & C", "Song", ["A", "B", "C"]),
    ("Song", "Song", []), ("Feature film", "Feature film", []), ("Defeat it", "Defeat it", []), ("Song feat Sandy", "Song", ["Sandy"]),
])
def test_featured(spark, title, base, names):
    got = apply(spark, [title], text.featured)[0]
    assert (got.base, got.names) == (base, names)


@pytest.mark.parametrize(("found", "wanted", "mark"), [
    ("song (karaoke version)", "song", "karaoke"), ("song - sped up", "song", "sped up"), ("song (live)", "song", "(live)"),
    ("song - live at home", "song", "live at"), ("song (live)", "song (live)", None), ("song - live from x", "song live", None),
    ("discovery", "song", "cover"), ("alive", "song", None), ("song (live)", "alive", None), ("remix of a cover", "song", "cover"),
    ("plain", "plain", None),
])
def test_markers(spark, found, wanted, mark):
    df = spark.createDataFrame([(found, wanted)], "f string, w string")
    f, w = F.col("f"), F.col("w")
    row = df.select(
        markers.first_marker(f, w), markers.uncalled_for(markers.found_mask(f), markers.excused_mask(w))).first()
    assert tuple(row) == (mark, mark is not None)


def pool(seed: int, size: int) -> list[str]:
    """Short words bent in all ways: letters dropped, added, doubled, swapped, blocks moved."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcde fg") for _ in range(rng.randint(1, 24))) for _ in range(size // 6)]
    words += ["aaaaaaa", "aaaaaa", "abababab", "ab", "ba", "abc", "abcd", "bcd"]
    out = set(words)
    while len(out) < size:
        w = list(rng.choice(words))
        for _ in range(rng.randint(1, 4)):
            if not w:
                break
            at = rng.randrange(len(w))
            kind = rng.randrange(4)
            if kind == 0:
                del w[at]
            elif kind == 1:
                w.insert(at, rng.choice("abcxyz ü"))
            elif kind == 2:
                w[at:at] = w[max(0, at - 2):at]
            else:
                w = w[at:] + w[:at] if rng.random() < 0.2 else w[:at] + w[at:][::-1]
        out.add("".join(w))
    return sorted(out)


def test_signatures_lose_no_similar_pair(spark):
    words = pool(11, 500)
    sig = dict(zip(words, (set(s) for s in apply(spark, words, fuzzy.signatures))))
    similar = 0
    for a in words:
        for b in words:
            if a != b and SequenceMatcher(None, a, b).ratio() >= fuzzy.WEAK_RATIO:
                similar += 1
                assert sig[a] & sig[b], (a, b)
    assert similar > 300


def test_long_texts_keep_the_guarantee(spark):
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefgh ") for _ in range(400))
    bent = [base[:i] + base[i + rng.randint(1, 90):] for i in range(0, 300, 17)]
    words = [base, *bent]
    sig = dict(zip(words, (set(s) for s in apply(spark, words, fuzzy.signatures))))
    for w in bent:
        if SequenceMatcher(None, base, w).ratio() >= fuzzy.WEAK_RATIO:
            assert sig[base] & sig[w]


def test_weak_pairs_equal_brute_force(spark):
    words = [w for w in pool(23, 260) if len(w.strip()) > 1]
    wanted, found = words[::2], words[1::2]
    index = spark.createDataFrame(
        [(f"t{i}", "u", w, None, "2000", "2000", w, w, 0, 0, 0, "a1", "A", "a") for i, w in enumerate(found)],
        "track_id string, uri string, name string, isrc string, release string, year string, title_norm string,"
        "stripped_norm string, title_mask int, album_mask int, artist_pos int, artist_id string, artist_name string, artist_norm string")
    asked = spark.createDataFrame([("a", w, 0, "", "a", 0) for w in wanted],
                                  "artist_norm string, title_norm string, excused_album int, want_year string, artist_key string, excused_title int")
    pairs = match.weak_pairs(asked, index, "artist_norm").select(
        "title_norm", "stripped_norm", fuzzy.fuzzy_ratio(F.col("title_norm"), F.col("stripped_norm")).alias("r"))
    got = {(r[0], r[1]) for r in pairs.where(F.col("r") >= fuzzy.WEAK_RATIO).collect()}
    want = {(a, b) for a in wanted for b in found if SequenceMatcher(None, a, b).ratio() >= fuzzy.WEAK_RATIO}
    assert got == want and want


def test_ratios_of_a_batch_equal_difflib():
    rng = random.Random(5)
    words = [*pool(31, 400), "", "a", "é漢😀", "x" * 250, "ab" * 120, "x" * 199]
    pairs = [(rng.choice(words), rng.choice(words)) for _ in range(20_000)]
    pairs += [(w, w) for w in words] + [("x" * 250, "y" + "x" * 230), ("abcab", "abab"), ("abxab", "abyab")]
    want = [SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    first, second = map(list, zip(*pairs))
    assert ratios(first, second).tolist() == want
    bounded = ratios(first, second, fuzzy.WEAK_RATIO)
    for got, ratio in zip(bounded, want):
        assert got == ratio if ratio >= fuzzy.WEAK_RATIO else got < fuzzy.WEAK_RATIO and got >= ratio
    assert ratios([], []).tolist() == [] and np.isnan(ratios([None, "a"], ["a", None])).all()


def test_a_hot_block_is_cut_into_cells(spark):
    """One artist with a third of all titles, all sharing one rare pair of letters: no cell is large, no pair is lost."""
    rng = random.Random(9)
    words = [f"zq{''.join(rng.choice('abcde') for _ in range(10))}" for _ in range(400)]
    found = [("hot" if i < 200 else f"a{i}", w) for i, w in enumerate(words * 2)]
    index = spark.createDataFrame(
        [(f"t{i}", "u", w, None, "2000", "2000", w, w, 0, 0, 0, a, a, a) for i, (a, w) in enumerate(found)],
        "track_id string, uri string, name string, isrc string, release string, year string, title_norm string,"
        "stripped_norm string, title_mask int, album_mask int, artist_pos int, artist_id string, artist_name string, artist_norm string")
    wanted = sorted({w[:5] + w[6:] for w in words[:200]} | {w[:-1] + "q" for w in words[:200]})
    asked = spark.createDataFrame([("hot", w, 0, "", "hot", 0) for w in wanted],
                                  "artist_norm string, title_norm string, excused_album int, want_year string, artist_key string, excused_title int")
    sides = [asked.select("artist_key", "title_norm").withColumn("signature", F.lit("zq1")),
             index.where("artist_norm = 'hot'").select(F.col("artist_norm").alias("artist_key"), "stripped_norm").withColumn("signature", F.lit("zq1"))]
    cut = match.in_cells(*sides, ["artist_key", "signature"], 20)
    keys = ["artist_key", "signature", "probe_cell", "title_cell"]
    for side in cut:
        sizes = [r["count"] for r in side.groupBy(*keys).count().collect()]
        assert max(sizes) <= 5 * sorted(sizes)[len(sizes) // 2] and max(sizes) < 60 and len(sizes) >= 190
    assert cut[0].join(cut[1], keys).count() == len(wanted) * 200  # every pair in exactly one cell
    ratio = fuzzy.fuzzy_ratio(F.col("title_norm"), F.col("stripped_norm"), fuzzy.WEAK_RATIO)
    for limit in (20, 2000):
        pairs = match.weak_pairs(asked, index, "artist_norm", limit).withColumn("r", ratio)
        got = sorted((r["title_norm"], r["stripped_norm"]) for r in pairs.where(F.col("r") >= fuzzy.WEAK_RATIO).collect())
        want = sorted((a, b) for a in wanted for b in words[:200] if SequenceMatcher(None, a, b).ratio() >= fuzzy.WEAK_RATIO)
        assert got == want and want
