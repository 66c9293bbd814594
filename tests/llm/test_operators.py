"""Operators of spinlog.llm next to brute force, DuckDB, held-out labels and awkward tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from spinlog.llm import bitplane, decontaminate, license, pii, quality, repeats, sentencepiece_sa, simhash, topk, toxicity
from spinlog.llm.common import components, table
from spinlog.llm.queries import BYTE_BPE, ORACLE, PIECE_BPE, QUERIES

SMALL = "/root/testdata/sf0.001"


def texts(sf=SMALL):
    return duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet' order by 1").fetchall()


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, columns whose names operators use themselves."""
    long_text = "word " * 3000 + "x" * 20_000 + " Licensed under the Apache License, Version 2.0."
    rows = [(1, None), (2, ""), (3, "short"), (4, long_text), (5, long_text), (5, long_text), (None, "no id"), (None, None),
            (6, "mail john (at) example (dot) com or a.b@c.org"), (7, " \n\t "), (8, "Ümlaut 漢字 😀 \x00 <|endoftext|>"),
            (9, "idiot moron scum " * 20), (10, "abc def ghi jkl mno pqr"), (11, "ABC def ghi jkl mno pqr")]
    df = spark.createDataFrame([(i, t, "en", "s", 1, 0.5, 7, 8, 9) for i, t in rows],
                               "doc_id long, text string, lang string, source string, n_chars long, score double, core int, fp int, shard int")
    return df, rows


@pytest.fixture(scope="module")
def nothing(awkward):
    return awkward[0].limit(0)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_token_files_against_the_tokenizer(spark, awkward):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTE_BPE)
    rows = [(r["start"], r["n_tokens"], r["ids_crc32"]) for r in bitplane.token_files(awkward[0], BYTE_BPE).collect()]
    at, want = 0, []
    for _, text in sorted(awkward[1], key=lambda r: (-1 if r[0] is None else r[0], r[1] or "")):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(rows) == sorted(want)


@pytest.mark.parametrize("unit", ["byte", "bit"])
def test_planes_round_trip_across_blocks(spark, tmp_path, unit):
    ids = np.random.default_rng(0).integers(0, 70_000, 999).astype(np.uint32)
    assert (bitplane.unpack(bitplane.pack(ids, unit), len(ids), unit) == ids).all()
    docs = table(spark, SMALL, "documents").limit(40)
    bitplane.write(docs, str(tmp_path / "t"), BYTE_BPE, block_ids=500, unit=unit, shards=3)
    whole = bitplane.read_ids(spark, str(tmp_path / "t"), unit).orderBy("start").collect()
    assert all(len(r["ids"] or b"") == 4 * r["n_tokens"] and zlib.crc32(r["ids"]) == r["ids_crc32"] for r in whole)
    assert [r["start"] for r in whole] == [0, *np.cumsum([r["n_tokens"] for r in whole])[:-1].tolist()]


def test_chunks_encode_like_whole_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTE_BPE)
    rng = random.Random(3)
    made = ["".join(rng.choice("ab cd's  \n\t\ré漢\x85\x1c\xa0 1.,!?") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for text, ids in zip(made, bitplane.encode(pa.array(made), BYTE_BPE), strict=True):
        assert list(ids) == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("name", ["op2_decontaminate", "op8_topk"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    df = QUERIES[name](spark, SMALL)
    cursor = con.execute(ORACLE[name])
    assert [d[0] for d in cursor.description] == df.columns
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(cursor.fetchall(), key=repr)


def test_changed_slots_are_found_and_torn_ones_are_not(spark):
    item = "a train leaves the town of Zagreb at 40 km per hour and after 40 minutes it meets another train near Zagreb station"
    ask = lambda t: t
    docs = spark.createDataFrame([
        (1, "so " + item), (2, "so " + item.replace("40", "72").replace("Zagreb", "Paris")),
        (3, "so " + item.replace("at 40", "at 72")), (4, "nothing of the kind"), (5, None), (6, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, ask(item)), (8, "short"), (9, None), (None, "")], "item_id long, text string")
    found = {r["doc_id"]: r["kind"] for r in decontaminate.find(docs, bench).collect()}
    assert found == {1: "exact", 2: "changed"}


def test_repeats_against_counted_windows(spark, awkward, nothing):
    def check(rows, df):
        bodies = [(t or "").encode() for _, t in rows]
        seen = Counter(b[i:i + 200] for b in bodies for i in range(len(b) - 199))
        want = []
        for (doc_id, _), b in zip(rows, bodies, strict=True):
            gone = np.zeros(len(b), bool)
            for i in range(len(b) - 199):
                if seen[b[i:i + 200]] > 1:
                    gone[i:i + 200] = True
            runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
            want.append((doc_id, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
        assert sorted(map(tuple, repeats.remove(df).collect()), key=repr) == sorted(want, key=repr)

    check(*awkward[::-1])
    check(texts()[:60], table(spark, SMALL, "documents").filter("doc_id < 60"))
    assert repeats.remove(nothing).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(1)
    for n in [*range(1, 30), 200]:
        for top in (2, 5):
            x = rng.integers(1, top, n)
            assert repeats.suffix_array(x).tolist() == sorted(range(n), key=lambda i, x=x: x[i:].tolist())


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark, awkward, nothing):
    rows = [r for r in awkward[1] if r[0] is not None] + texts()[100:]
    df = awkward[0].select("doc_id", "text").filter("doc_id is not null").union(
        table(spark, SMALL, "documents").filter("doc_id >= 100").select("doc_id", "text"))
    prints = [(i, slow_fingerprint(t)) for i, t in rows]
    group = {i: i for i, _ in prints}
    changed = True
    while changed:
        changed = False
        for i, a in prints:
            least = min(group[j] for j, b in prints if (a ^ b).bit_count() <= 4)
            changed |= least < group[i]
            group[i] = min(group[i], least)
    got = simhash.near_duplicates(df).collect()
    assert sorted(map(tuple, got)) == sorted((i, f"{p:016x}", group[i]) for i, p in prints)
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.keep_one(awkward[0])
    assert kept.columns == awkward[0].columns and {1, 3, 4}.issubset({r["doc_id"] for r in kept.collect()})


def test_every_pair_within_four_bits_shares_an_anchor():
    rng = random.Random(5)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for p in rng.sample(range(64), 4):
            b ^= 1 << p
        shared = False
        for half in (0, 32):
            x, y = (np.array([(v >> half) & 0xFFFFFFFF]) for v in (a, b))
            shared |= bool(set(simhash.anchors(x)[1].tolist()) & set(simhash.anchors(y)[1].tolist()))
        assert shared


def test_crowded_anchors_keep_all_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 20)
    rng = random.Random(6)
    fps = {sum(1 << p for p in rng.sample(range(12), rng.randint(0, 6))) for _ in range(300)}
    links = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    assert {r["root"] for r in components(links).collect()} == {min(fps)}


def test_sentencepiece_ids_are_the_models_own(spark, awkward):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    rng = random.Random(7)
    made = ["".join(rng.choice("the ing ab  \n\té漢▁<s>=-") for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["ab" * 3000, None]
    for text, ids in zip(made, sentencepiece_sa.encode(made, sentencepiece_sa.load(PIECE_BPE)), strict=True):
        assert list(ids) == model.encode(text or "")
    got = sentencepiece_sa.encode_documents(awkward[0], PIECE_BPE).collect()
    assert len(got) == len(awkward[1]) and all(r["same"] for r in got)


def test_personal_data(spark, awkward, nothing):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    tests = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": pii.luhn,
             "phone": lambda s: 10 <= sum(c.isdigit() for c in s) <= 15}
    rng = random.Random(8)
    for _ in range(3000):
        text = "".join(rng.choice("ab@..+-1234567890 ()%é") for _ in range(rng.randint(0, 50)))
        want = [(k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, text) if tests[k](m[0])]
        base, everything = pii.all_spans(text)
        assert base == pii.ordered(want) and set(base) <= set(everything)
    for text, span in [("mail john (at) example (dot) com now", "john (at) example (dot) com"), ("１２.３４.５.６", "１２.３４.５.６"),
                       ("ring plus one five five five one two three four five six seven.", "plus one five five five one two three four five six seven"),
                       ("john@exаmple.com", "john@exаmple.com")]:
        (_, begin, end), = pii.all_spans(text)[1]
        assert text[begin:end] == span
    assert pii.all_spans("meet at noon.then go") == ([], [])
    got = by_id(pii.find(awkward[0]))
    assert (got[6]["n_email"], got[6]["n_added"]) == (1, 1) and got[1]["spans"] == ""
    assert pii.redacted("a b@c.org d") == "a <EMAIL> d" and pii.redacted(None) is None
    assert pii.find(nothing).count() == 0


@pytest.mark.parametrize("module, label, parts, held", [(quality, "quality", 4, 2), (toxicity, "toxic", 5, 0)])
def test_classifiers(spark, awkward, nothing, module, label, parts, held):
    sf = "/root/testdata/sf0.01"
    got = by_id(module.score(table(spark, sf, "documents"), table(spark, sf, "labels")))
    pairs = [(got[i]["predicted"], y) for i, y in duckdb.sql(f"select doc_id, {label} from '{sf}/labels.parquet'").fetchall()
             if zlib.crc32(str(i).encode()) % parts == held]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % parts == held) for i, r in got.items())
    assert sum(p == y for p, y in pairs) >= 0.85 * len(pairs)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, 0, 1), (9, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    odd = module.score(awkward[0], labels).collect()
    assert len(odd) == len(awkward[1]) and all(0 <= r["score"] <= 1 for r in odd)
    assert module.score(nothing, labels.limit(0)).count() == 0


def test_top_k_defined_cases(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, []),
            (7, [-1.0, -2.0]), (8, [0.0, 0.0]), (9, [3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0, k=3).collect()]
    assert sorted(got) == [(0, 1, 1, 5 << 20), (0, 2, 2, 5 << 20), (0, 3, 9, 3 << 20)]
    assert topk.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_buckets_are_pruned_without_loss():
    rng = np.random.default_rng(9)
    v = (rng.normal(size=(4000, 8)) * rng.lognormal(size=(4000, 1)) * 300).astype(np.int64)
    ids, q = np.arange(4000), v[::100]
    scores = q @ v.T
    bounds = np.array([np.sort(np.delete(s, i * 100))[-10] for i, s in enumerate(scores)], float)
    found = topk.search(ids[::100], q, ids, v, bounds, 10)
    for i, s in enumerate(scores):
        want = sorted((int(j) for j in ids if j != i * 100), key=lambda j, s=s: (-s[j], j))[:10]
        assert [x for own, x in zip(found[0], found[1], strict=True) if own == i * 100] == want


def test_license_alignment(spark, awkward, nothing):
    scanner = license.Scanner(license.TEMPLATES, 0.8)
    long = license.TEMPLATES["MIT-text"].replace("sell", "vend").replace("merge, ", "") + " and more"
    assert [f[0] for f in scanner.scan(long)] == ["MIT-text"] and scanner.scan(None) == []
    assert [f[0] for f in scanner.scan("Released under the MIT License. Released under the MIT License.")] == ["MIT", "MIT"]
    assert license.longest_increasing([3, 1, 2, 5, 4]) in ([1, 2, 3], [1, 2, 4])
    assert {r["doc_id"]: r["license"] for r in license.scan(awkward[0]).collect()} == {4: "Apache-2.0", 5: "Apache-2.0"}
    assert license.scan(nothing).count() == 0


def test_pipeline(spark, awkward, nothing):
    docs = table(spark, SMALL, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SMALL)
        assert kept.columns == docs.columns, name
        assert stage(spark, nothing, SMALL).count() == 0
        odd = stage(spark, awkward[0], SMALL)
        assert odd.columns == awkward[0].columns and odd.count() <= len(awkward[1])
    out = corpus_pipeline.run(spark, SMALL)
    kept = {r["doc_id"] for r in out.collect()}
    assert 100 < len(kept) < docs.count() and out.filter("not same").count() == 0
    gone = {r["doc_id"] for r in decontaminate.find(docs, table(spark, SMALL, "benchmark")).collect()}
    assert not kept & gone
