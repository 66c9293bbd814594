"""Cases of the third review: rows of one id, odd letters in disguises, many spans in one text."""

from __future__ import annotations

import random
import time

import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from spinlog.llm import bitplane, pii, simhash
from spinlog.llm.queries import BYTE_BPE


def test_unlike_rows_of_one_id_stay(spark):
    one, two = ("alpha beta gamma delta epsilon zeta eta theta " * 4, "one two three four five six seven eight nine ten " * 4)
    rows = [(1, one), (1, two), (1, one), (2, one), (None, two), (None, "a b c d e f g h"), (None, "a b c d e f g h"), (3, None), (4, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _digest string").withColumnRenamed("_digest", "fp")
    for keep in (simhash.keep_one, lambda d: corpus_pipeline.drop_near_duplicates(spark, d, "")):
        kept = keep(docs)
        assert kept.columns == docs.columns
        assert sorted(map(repr, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(repr, [
            (1, one), (1, two), (None, "a b c d e f g h"), (3, None)]))


def test_a_group_of_many_copies_leaves_one(spark):
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(400)]
    docs = spark.createDataFrame([(i, " ".join([*base[:399], f"x{i % 40}"])) for i in range(2000)], "doc_id long, text string")
    ids = {i for i, c in simhash.near_duplicates(docs).select("doc_id", "component_id").collect() if i == c}
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == ids and len(ids) < 5


def test_letters_that_only_case_folding_matches(spark):
    made = [w.replace("s", "\u017f").replace("i", odd) for w in
            ("one 10.0.0.six", "six six seven one", "plus six one", "joe at six.example.com", "10.0.0.five", "1.2.3.six", "a six. 5", "x dot six")
            for odd in ("i", "\u0130", "\u0131")]
    made += [t.replace("k", "\u212a") for t in ("mark at kiosk dot com", "k (at) k [dot] kk")]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    assert pii.find(docs).count() == docs.select(pii.redact(F.col("text"))).count() == len(made)


def test_added_spans_lie_in_no_base_span():
    rng = random.Random(6)
    bits = ["joe@a.com", " ", "joe (at) a dot com", "10.0.0.1", "10.0.0.one", "+1 555 010 0100 22", "4111 1111 1111 1111", "x", "\u0435@b.org", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 25)))
        base, every = pii.all_spans(text)
        new = pii.rewrite(text)
        want = set()
        for kind, begin, end in pii.detect(new.text) if new else ():
            begin, end = new.where(begin)[0], new.where(end - 1)[1]
            if not any(b <= begin and end <= e for _, b, e in base):
                want.add((kind, begin, end))
        assert every == pii.ordered([*base, *want])


def test_ids_are_the_librarys_own(monkeypatch):
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    rng = random.Random(7)
    bits = ["<|endoftext|>", "<|endoftext", "|>", " ", "a", "\n", "word", " cd's", "\u00e9", "\u00a0", "12"]
    made = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(2000)]
    monkeypatch.setattr(bitplane, "KNOWN_CHUNKS", 40)  # many turns of the memory
    monkeypatch.setattr(bitplane, "TEXTS_AT_ONCE", 7)
    monkeypatch.setattr(bitplane, "BYTES_AT_ONCE", 100)
    got = [ids for texts in bitplane.some(pa.array(made)) for ids in bitplane.encode(texts, BYTE_BPE)]
    assert len(got) == len(made)
    for text, ids in zip(made, got, strict=True):
        assert list(ids) == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_files_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bitplane.token_files(docs, BYTE_BPE).count() == 0


def test_many_spans_in_one_text():
    text = "joe@a.com 10.0.0.1 " * 8000 + "\u0435@b.org"
    begin = time.process_time()
    base, every = pii.all_spans(text)
    assert (len(base), len(every)) == (16_000, 16_001) and time.process_time() - begin < 3
