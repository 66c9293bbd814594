"""Filter audit, spelling variants and the backoff model next to DuckDB and plain dictionaries."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest

from spinlog.llm import filter_audit, katz, spelling

SMALL = "/root/testdata/sf0.001"
AWKWARD = [(1, None), (2, ""), (3, "short"), (4, "Word other " * 3000 + "x" * 20_000), (5, "same text"), (5, "same text"),
           (6, "same text"), (None, "same text"), (None, None), (7, " \n\t\x0b "), (8, "Ümlaut 漢字 😀 \x00 a|b ÿÿÿÿÿ"), (9, "ABCDEF ghi")]


def frame(spark, rows):
    """Extra columns have names the operators use themselves."""
    return spark.createDataFrame([(i, t, f"s{(i or 0) % 2}" if i != 3 else None, 7, "k", 1, 0.5) for i, t in rows],
                                 "doc_id long, text string, source string, n long, word string, chunk int, mask double")


# --- filter audit ----------------------------------------------------------------------------


def test_audit_same_as_sql(spark):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 1), (5, 1, None), (None, 1, 1), (8, 0, 1)], "doc_id long, quality int, toxic int")
    for docs, said in ((spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")),
                       (frame(spark, AWKWARD), labels)):
        con = duckdb.connect()
        con.register("documents", docs.select("doc_id", "text", "source").toArrow())
        con.register("labels", said.toArrow())
        cursor = con.execute(filter_audit.ORACLE)
        got = filter_audit.audit(docs, said)
        assert [d[0] for d in cursor.description] == got.columns
        rows = sorted(map(tuple, got.collect()))
        assert rows == sorted(cursor.fetchall())
        assert len(rows) == 600 * docs.selectExpr("coalesce(source, '')").distinct().count()
    assert filter_audit.audit(frame(spark, AWKWARD).limit(0), labels).count() == 0


def test_shapley_adds_up(spark):
    docs, labels = frame(spark, AWKWARD), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = filter_audit.audit(docs, labels).collect()
    for part in {r.part for r in rows}:
        of = [r for r in rows if r.part == part]
        last = {r.filter_order: r.kept for r in of if r.step == 5}
        assert len(set(last.values())) == 1  # the order does not change what stays
        size = docs.filter(f"coalesce(source, '') = '{part}'").count()
        assert sum({r.filter_order[r.step - 1]: r.shapley for r in of}.values()) == 120 * (size - of[0].kept if of[0].step == 5 else size - last[of[0].filter_order])


# --- spelling variants -----------------------------------------------------------------------


def brute_words(rows):
    n = Counter()
    for i, t in rows:
        for m in spelling.RUNS.finditer(t or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in m[0])
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % 97 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def brute_groups(rows):
    n, near, gaps = brute_words(rows), defaultdict(set), defaultdict(list)
    for w in n:
        for i in range(len(w)):
            cut = w[:i] + w[i + 1:]
            gaps[i, cut].append(w)
            if cut in n:
                near[w].add(cut)
                near[cut].add(w)
    for group in gaps.values():
        for a in group:
            near[a].update(b for b in group if b != a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best and n[best] >= 2 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def grouped(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, df.collect()))


def test_spelling_against_all_gaps(spark, monkeypatch):
    monkeypatch.setattr(spelling, "LONG", 16)  # words beyond it take the other way in
    rng = random.Random(1)
    rows = list(AWKWARD)
    for i in range(120):
        made = ["".join(rng.choice("abÿ") for _ in range(rng.randint(4, 7))) for _ in range(150)]
        for size in (15, 16, 17, 18, 24, 31, 32, 33, 48):
            word = ["ab"[j * j % 3 % 2] for j in range(size)]
            if rng.random() < 0.5:
                word[min(rng.choice([0, 7, 8, 9, 15, 16, size // 2, size - 1]), size - 1)] = rng.choice("abc")
            if rng.random() < 0.4:
                word.insert(rng.choice([0, 7, 8, 9, 16, size // 2, size]), rng.choice("abc"))
            made.append("".join(word))
        rows.append((100 + i, " ".join(made)))
    want = brute_groups(rows)
    assert any(len(r[0]) > 16 and r[4] for r in want) and any(r[1] and r[1] != r[2] for r in want)
    assert grouped(spelling.group(frame(spark, rows))) == want


def test_spelling_on_a_table_and_on_nothing(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert grouped(spelling.group(docs)) == brute_groups([(r.doc_id, r.text) for r in docs.collect()])
    assert grouped(spelling.group(frame(spark, AWKWARD).limit(0))) == []
    assert grouped(spelling.group(frame(spark, [(1, "once"), (2, None)]))) == []
    monkeypatch.setattr(spelling, "LONG", 16)
    long = "q" * 300
    rows = [(i, f"{long} {long}z {long} {long}z x{long}") for i in range(1, 9)]
    assert grouped(spelling.group(frame(spark, rows))) == brute_groups(rows)


# --- backoff model ---------------------------------------------------------------------------


def brute_scores(rows):
    def tokens(text):
        return [*(text or "").encode().lower().split(), b""]

    def held(i):
        return i is not None and zlib.crc32(str(i).encode()) % 7 == 2

    c, pairs, after = Counter(), Counter(), Counter()
    for i, t in rows:
        if not held(i):
            words = tokens(t)
            c.update(words)
            pairs.update(zip([None, *words], words, strict=False))
            after.update([None, *words[:-1]])

    def discount(counts):
        n = Counter(counts.values())
        past = 6 * n[6] / n[1] if n[1] else 0
        out = defaultdict(lambda: 1.0)
        for r in range(1, 6):
            d = ((r + 1) * n[r + 1] / (r * n[r]) - past) / (1 - past) if n[1] and n[r] and past != 1 else 0
            out[r] = d if 0 < d < 1 else r / (r + 1)
        return out

    d1, d2 = discount(c), discount(pairs)
    total = sum(c.values()) + (not any(k <= 5 for k in c.values()))
    single = {w: d1[k] * k / total for w, k in c.items()}
    unknown = 1 - math.fsum(single.values())
    follow = defaultdict(dict)
    for (h, w), k in pairs.items():
        follow[h][w] = k
    totals = {h: after[h] + (not any(k <= 5 for k in ks.values())) for h, ks in follow.items()}
    alpha = {h: (1 - math.fsum(d2[k] * k / totals[h] for k in ks.values()))
             / (unknown + math.fsum(p for w, p in single.items() if w not in ks)) for h, ks in follow.items()}

    def p(h, w):
        k = pairs.get((h, w))
        return d2[k] * k / totals[h] if k else alpha.get(h, 1) * single.get(w, unknown)

    for h in [*follow, "never seen"]:
        assert abs(math.fsum(p(h, w) for w in [*single, "never seen"]) - 1) < 1e-9
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        words = tokens(t)
        out.append((i, held(i), len(words), sum(c[w] > 0 for w in words), n,
                    math.fsum(math.log10((c[w] + 1) / (n + v + 1)) for w in words),
                    math.fsum(math.log10(p(h, w)) for h, w in zip([None, *words], words, strict=False))))
    return out


def same(got, want):
    got, want = (sorted(map(tuple, x), key=lambda r: (r[0] is None, r)) for x in (got, want))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


def made_rows():
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("a b c d e Foü\x85 g h i jj".split(" ")) for _ in range(rng.randint(0, 30)))) for i in range(200)]
    return AWKWARD + rows + [(1000 + i, "the same line here " * 3) for i in range(40)]


@pytest.mark.parametrize("limits", [(8 << 20, 1_000_000, 1_500_000), (2000, 40, 200)])
def test_scores_against_dictionaries(spark, monkeypatch, limits):
    for name, value in zip(("CHUNK_BYTES", "PART_WORDS", "PART_PAIRS"), limits, strict=True):
        monkeypatch.setattr(katz, name, value)
    same(katz.score(frame(spark, made_rows())).collect(), brute_scores(made_rows()))


@pytest.mark.parametrize("rows", [[], [(2, "x y")], [(i, "x y z") for i in range(50)], [(i, "x y z") for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2]])
def test_scores_of_little(spark, rows):
    same(katz.score(frame(spark, rows)).collect(), brute_scores(rows))


def test_held_out_texts_are_likelier_than_by_words_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = katz.score(docs).filter("held_out").collect()
    assert len(rows) > 100 and sum(r.score for r in rows) > 0.9 * sum(r.base_score for r in rows)


def test_packing_round_trip():
    import numpy as np

    arrays = [np.array([], np.int64), np.array([-1, 0, 2**62]), np.arange(1000)]
    for a, b in zip(arrays, katz.unpack(katz.pack(*arrays)), strict=True):
        assert (a == b).all()
    assert katz.unpack_words(katz.pack_words([b"", b"a", b"\xff"])) == [b"", b"a", b"\xff"]
    assert pa.types.is_binary(pa.array([katz.pack(np.zeros(3))]).type)
