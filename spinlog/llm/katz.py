"""Katz backoff language model: Good-Turing discounted word and word-pair counts, one log probability per text.

Tokens are the words of the lower-cased text (ASCII letters and blanks only) and one end
per text.  A token w after the history h (the token before it, or the start of the text) has

    P(w | h) = d(c(h, w)) c(h, w) / T(h)     if the pair was counted,
               alpha(h) P(w)                 else, if h was counted,
               P(w)                          else.

P(w) is d(c(w)) c(w) / N for counted words; what the discounts leave is the
probability of an unknown word, which is one class.  T(h) is the count of h before a token.
alpha(h) is the mass left over by the pairs of h, divided by the sum of P(w) over all w that do not follow
h, the unknown class included: so the probabilities after each history add up to one.  d(r) is Katz's discount for r up to 5 and 1
above; where counts of counts give none between 0 and 1, it is r / (r + 1).
Where no pair of h (no word) is discounted, T(h) (N) counts one more, which goes to what was not seen.

Texts are read once and kept as chunks of some megabytes: a dictionary of the chunk's words and its tokens as numbers of
that dictionary.  Counts are not sent to texts but to chunks: a chunk sends each of its words once, in packed blocks, to the
task that owns the word, and gets back its number and count; then each of its pairs to the owner
of the pair, and gets back its count.  So a word or pair that every text holds is sent once per chunk.  Pairs
are dealt by their history; a history of many tokens is dealt on by the second word, too, and its sums are added up afterwards.
Owners write the tables of words, pairs and histories, partitioned by part; nothing comes to the driver but counts of counts.

Defined cases: null texts are empty (one end); rows without id are training rows; rows that repeat are scored, and counted, as
often as they stand; without training texts every token is unknown and has probability one.  An empty table gives no row.  Other columns are not read.
"""

from __future__ import annotations

import struct
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinlog.llm.common import save, scratch
from spinlog.llm.sample import fold

CHUNK_BYTES = 8 << 20
CHUNK_DOCS = 50_000
PART_WORDS = 1_000_000  # words, and pairs, that one task owns, as sent by chunks
PART_PAIRS = 1_500_000
DISCOUNTED = 5
END = b""  # no word is empty

_BLOCK = "kind string, chunk long, part int, payload binary, stats array<long>"


# --- packed arrays ---------------------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers as byte planes, compressed; equal high bytes cost next to nothing."""
    planes = [np.ascontiguousarray(a, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays]
    head = struct.pack(f"<{len(arrays) + 1}q", len(arrays), *map(len, arrays))
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(planes))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, = struct.unpack_from("<q", raw)
    at, out = 8 * (n + 1), []
    for size in struct.unpack_from(f"<{n}q", raw, 8):
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * size, at).reshape(8, size).T).view("<i8").ravel())
        at += 8 * size
    return out


def pack_words(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"\n".join(words))


def unpack_words(data: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split(b"\n")


# --- chunks ----------------------------------------------------------------------------------


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def chunks(docs: DataFrame) -> DataFrame:
    """One row per chunk: its words with their training counts, and its texts as numbers of these words."""

    def cut(batches):
        task, made = TaskContext.get().partitionId(), 0
        numbers, held_bytes = _Numbers({END: 0}), 0
        texts, rows = [], []  # numbers of each text; (doc_id, held out)

        def out():
            tokens = np.concatenate(texts)
            sizes = np.array([len(t) for t in texts])
            trained = np.array([not r[1] for r in rows])
            often = np.bincount(tokens, minlength=len(numbers))
            order = np.argsort(-often, kind="stable")  # small numbers for frequent words
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            counts = np.bincount(tokens[np.repeat(trained, sizes)], minlength=len(numbers))[order]
            words = list(numbers)
            ids = [r[0] for r in rows]
            return pa.RecordBatch.from_pylist([{
                "chunk": (task << 33) + made, "n_words": len(words), "n_tokens": len(tokens),
                "words": pack_words([words[i] for i in order.tolist()]), "counts": pack(counts),
                "docs": pack(np.array([i or 0 for i in ids]), np.array([i is None for i in ids]), ~trained, sizes),
                "tokens": pack(rank[tokens])}], schema=schema)

        for batch in batches:
            for doc_id, text, held in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "held")), strict=True):
                words = (text or b"").lower().split()
                words.append(END)
                texts.append(np.fromiter((numbers[w] for w in words), np.int32, len(words)))
                rows.append((doc_id, held))
                held_bytes += len(text or b"")
                if held_bytes >= CHUNK_BYTES or len(rows) >= CHUNK_DOCS:
                    yield out()
                    made += 1
                    numbers, held_bytes = _Numbers({END: 0}), 0
                    texts, rows = [], []
        if rows:
            yield out()

    schema = pa.schema([("chunk", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("words", pa.binary()),
                        ("counts", pa.binary()), ("docs", pa.binary()), ("tokens", pa.binary())])
    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"),
                       F.coalesce(fold("doc_id", 7) == 2, F.lit(False)).alias("held"))
    return save(read.mapInArrow(cut, "chunk long, n_words long, n_tokens long, words binary, counts binary, docs binary, tokens binary"), "chunks")


# --- owners ----------------------------------------------------------------------------------


def _blocks(rows: list[tuple]) -> pa.RecordBatch:
    names = ["kind", "chunk", "part", "payload", "stats"]
    types = [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _rows(batches):
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True)


def _owned(sent: DataFrame, parts: int, own) -> DataFrame:
    """`own(part, chunks, payloads)` yields the blocks that the owner of a part writes; blocks of kind `back` return to chunks."""

    def gathered(batches):
        for part, group in groupby(_rows(batches), key=lambda r: r[0]):
            group = list(group)
            yield from (_blocks([b]) for b in own(part, [r[1] for r in group], [r[2:] for r in group]))

    path = scratch(sent.sparkSession, "owned")
    (sent.repartition(parts, "part").sortWithinPartitions("part", "chunk").mapInArrow(gathered, _BLOCK)
     .write.partitionBy("kind").parquet(path))
    return sent.sparkSession.read.schema(_BLOCK).parquet(path)


def _counts_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == r).sum()) for r in range(1, DISCOUNTED + 2)]


def _word_parts(words: list[bytes], parts: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh32_intdigest(w) for w in words), np.int64, len(words)) % parts


def own_words(cut: DataFrame, parts: int) -> DataFrame:
    def send(batches):
        for chunk, words, counts in _rows(batches):
            words, (counts,) = unpack_words(words), unpack(counts)
            part = _word_parts(words, parts)
            order = np.argsort(part, kind="stable")
            for p, at in zip(*_runs(part[order]), strict=True):
                mine = order[at]
                yield pa.RecordBatch.from_pylist([{
                    "part": p, "chunk": chunk, "words": pack_words([words[i] for i in mine.tolist()]), "counts": pack(counts[mine])}],
                    schema=pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())]))

    def own(part, chunk_ids, payloads):
        numbers = _Numbers()
        local = []
        for words, _ in payloads:
            words = unpack_words(words)
            local.append(np.fromiter((numbers[w] for w in words), np.int64, len(words)))
        counts = np.zeros(len(numbers), np.int64)
        for at, (_, sent) in zip(local, payloads, strict=True):
            counts[at] += unpack(sent)[0]  # a chunk sends a word once
        order = np.argsort(-counts, kind="stable")
        ids = np.empty_like(order)
        ids[order] = np.arange(len(order)) * parts + part + 1
        ids[counts == 0] = 0
        for chunk, at in zip(chunk_ids, local, strict=True):
            yield "back", chunk, part, pack((ids[at] - part - 1) // parts, counts[at]), None
        words = list(numbers)
        known = order[counts[order] > 0]
        if len(known):
            body = pack_words([words[i] for i in known.tolist()])
            yield "table", None, part, struct.pack("<q", len(body)) + body + pack(counts[known]), [
                int(counts.sum()), len(known), *_counts_of_counts(counts)]

    sent = cut.select("chunk", "words", "counts").mapInArrow(send, "part int, chunk long, words binary, counts binary")
    return _owned(sent, parts, own)


def _runs(ordered: np.ndarray) -> tuple[list[int], list[slice]]:
    """The values of a sorted array and where each stands."""
    if not len(ordered):
        return [], []
    heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    ends = np.append(heads[1:], len(ordered))
    return ordered[heads].tolist(), [slice(a, b) for a, b in zip(heads.tolist(), ends.tolist(), strict=True)]


class Resolved:
    """A chunk whose words have their global numbers (0: not counted) and counts."""

    def __init__(self, words: bytes, docs: bytes, tokens: bytes, backs: list[tuple[int, bytes]], parts: int) -> None:
        local = unpack_words(words)
        part = _word_parts(local, parts)
        order = np.argsort(part, kind="stable")
        got = [unpack(payload) for _, payload in backs]
        owner = np.concatenate([np.full(len(g[0]), p) for (p, _), g in zip(backs, got, strict=True)])
        ranks, counts = (np.concatenate([g[i] for g in got]) for i in (0, 1))
        self.ids, self.counts = np.zeros(len(local), np.int64), np.zeros(len(local), np.int64)
        self.counts[order] = counts
        self.ids[order] = np.where(counts > 0, ranks * parts + owner + 1, 0)
        self.end = local.index(END)
        self.doc_ids, self.no_id, self.held, self.sizes = unpack(docs)
        self.tokens, = unpack(tokens)
        before = np.empty_like(self.tokens)  # the history of each token, -1 at the start of a text
        before[1:] = self.tokens[:-1]
        before[np.cumsum(self.sizes) - self.sizes] = -1
        self.before = before

    def pairs(self, parts: int):
        """Distinct pairs whose history and word are counted, in the order they are sent, and which of them each token is (-1: none)."""
        known = (self.counts[self.tokens] > 0) & ((self.before < 0) | (self.counts[self.before] > 0)) & (self.counts[self.end] > 0)
        key = (self.before[known] + 1) * len(self.ids) + self.tokens[known]
        trained = np.repeat(self.held == 0, self.sizes)[known]
        distinct, inverse = np.unique(key, return_inverse=True)
        n = np.bincount(inverse, weights=trained, minlength=len(distinct)).astype(np.int64)
        h, w = distinct // len(self.ids) - 1, distinct % len(self.ids)
        total = np.where(h < 0, self.counts[self.end], self.counts[h])
        history, word = np.where(h < 0, 0, self.ids[h]), self.ids[w]
        salts = np.minimum(total // (PART_PAIRS // 4) + 1, parts)
        part = (history * 2654435761 % 4294967291 + word % salts) % parts
        order = np.lexsort((word, history, part))
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        at = np.full(len(self.tokens), -1)
        at[known] = place[inverse]
        return part[order], history[order], word[order], n[order], self.counts[w][order], at


def _by_chunk(cut: DataFrame, backs: list[DataFrame], run, schema: str) -> DataFrame:
    """`run(chunk, words, docs, tokens, [back blocks of each kind])` yields batches."""
    none, kinds = F.lit(None).cast("binary"), len(backs)
    rows = cut.select("chunk", F.lit(0).alias("step"), F.lit(0).alias("part"), "words", "docs", "tokens", none.alias("payload"))
    for k, back in enumerate(backs, 1):
        rows = rows.union(back.filter("kind = 'back'").select("chunk", F.lit(k), "part", none, none, none, "payload"))

    def gathered(batches):
        for chunk, group in groupby(_rows(batches), key=lambda r: r[0]):
            _, _, _, words, docs, tokens, _ = next(group)
            got = [[] for _ in range(kinds)]
            for row in group:
                got[row[1] - 1].append((row[2], row[6]))
            yield from run(chunk, words, docs, tokens, got)

    return rows.repartition("chunk").sortWithinPartitions("chunk", "step", "part").mapInArrow(gathered, schema)


def own_pairs(cut: DataFrame, words: DataFrame, word_parts: int, parts: int, unigram: np.ndarray, undiscounted: float) -> DataFrame:
    def send(chunk, local, docs, tokens, backs):
        part, history, word, n, count, _ = Resolved(local, docs, tokens, backs[0], word_parts).pairs(parts)
        for p, at in zip(*_runs(part), strict=True):
            payload = pack(np.diff(history[at], prepend=0), word[at], n[at], np.where(n[at] > 0, count[at], 0))
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([chunk]), pa.array([payload])], names=["part", "chunk", "payload"])

    def own(part, chunk_ids, payloads):
        got = [unpack(p) for p, in payloads]
        history = np.concatenate([np.cumsum(g[0]) for g in got])
        word, n, count = (np.concatenate([g[i] for g in got]) for i in (1, 2, 3))
        hs, h = np.unique(history, return_inverse=True)
        ws, w = np.unique(word, return_inverse=True)
        keys, pair = np.unique(h * len(ws) + w, return_inverse=True)
        c = np.bincount(pair, weights=n).astype(np.int64)
        of_word = np.zeros(len(ws), np.int64)
        np.maximum.at(of_word, w, count)
        kh, kw = keys // len(ws), keys % len(ws)
        seen = c > 0
        p1 = _unigram(of_word[kw], unigram, undiscounted)
        by_r = [np.bincount(kh[c == r], minlength=len(hs)) for r in range(1, DISCOUNTED + 1)]
        total = np.bincount(kh, weights=c, minlength=len(hs)).astype(np.int64)
        covered = np.bincount(kh[seen], weights=p1[seen], minlength=len(hs))
        high = (sum(by_r) == 0)[kh]  # no pair of the history, as far as it stands here, is discounted
        answer = np.where(high, -c, c)[pair]
        stops = np.cumsum([len(g[0]) for g in got])
        for chunk, stop, g in zip(chunk_ids, stops.tolist(), got, strict=True):
            yield "back", chunk, part, pack(answer[stop - len(g[0]):stop]), None
        yield "table", None, part, pack(np.diff(hs[kh[seen]], prepend=0), ws[kw[seen]], c[seen]), _counts_of_counts(c)
        yield "sums", None, part, pack(hs, total, *by_r, covered.view(np.int64)), None

    sent = _by_chunk(cut, [words], send, "part int, chunk long, payload binary")
    return _owned(sent, parts, own)


# --- probabilities ---------------------------------------------------------------------------


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """d(0) = 0 to d(5): Katz's discounts from n(1) to n(6)."""
    n = [0, *counts_of_counts]
    k = DISCOUNTED
    out = [0.0]
    for r in range(1, k + 1):
        d = r / (r + 1)
        if n[1] and n[r]:
            past = (k + 1) * n[k + 1] / n[1]
            katz = ((r + 1) * n[r + 1] / (r * n[r]) - past) / (1 - past) if past != 1 else 0
            if 0 < katz < 1:
                d = katz
        out.append(d)
    return np.array(out)


def _discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(counts <= DISCOUNTED, d[np.minimum(counts, DISCOUNTED)], 1.0) * counts


def _unigram(counts: np.ndarray, d: np.ndarray, total: float) -> np.ndarray:
    return _discounted(counts, d) / total


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of `docs`."""
    spark = docs.sparkSession
    cut = chunks(docs)
    sizes = cut.agg(F.sum("n_words"), F.sum("n_tokens")).first()
    word_parts, pair_parts = (1 + (n or 0) // by for n, by in zip(sizes, (PART_WORDS, PART_PAIRS), strict=True))

    words = own_words(cut, word_parts)
    stats = _totals(words, DISCOUNTED + 3)
    n_all, n_words, of_counts = stats[0], stats[1], stats[2:]
    d1 = discounts(of_counts)
    total = float(n_all + (sum(of_counts[:DISCOUNTED]) == 0))
    left = sum((1 - d1[r]) * r * of_counts[r - 1] for r in range(1, DISCOUNTED + 1)) + (total - n_all)
    unknown = left / total

    pairs = own_pairs(cut, words, word_parts, pair_parts, d1, total)
    d2 = discounts(_totals(pairs, DISCOUNTED + 1))
    log_base = float(np.log10(n_all + n_words + 1))

    def evaluate(chunk, local, docs_, tokens, backs):
        c = Resolved(local, docs_, tokens, backs[0], word_parts)
        *_, at = c.pairs(pair_parts)
        got = np.concatenate([unpack(p)[0] for _, p in backs[1]]) if backs[1] else np.zeros(0, np.int64)
        counts = np.append(got, 0)[at]  # of each token's pair; negative: see `own_pairs`
        single = c.counts[c.tokens]
        lower = np.log10(np.where(single > 0, _unigram(single, d1, total), unknown))
        before = np.where(c.before < 0, c.end, c.before)
        of_history = c.counts[before]
        seen = counts != 0
        with np.errstate(divide="ignore", invalid="ignore"):
            upper = np.log10(_discounted(np.abs(counts), d2) / of_history)
        value = np.where(seen, upper, lower)
        starts = np.cumsum(c.sizes) - c.sizes
        n = len(c.sizes)
        yield _scored({
            "kind": ["text"] * n, "chunk": np.full(n, chunk), "at": np.arange(n), "doc_id": pa.array(c.doc_ids, mask=c.no_id > 0),
            "held_out": c.held > 0, "n_tokens": c.sizes, "n_known": np.add.reduceat((single > 0).astype(np.int64), starts),
            "base": np.add.reduceat(np.log10(single + 1), starts) - c.sizes * log_base, "value": np.add.reduceat(value, starts)})
        # What depends on a whole history is asked for once per text and history.
        ask = np.flatnonzero((~seen & (of_history > 0)) | (counts < 0))
        text = np.repeat(np.arange(n), c.sizes)[ask]
        key, which = np.unique(text * (len(c.ids) + 1) + c.before[ask] + 1, return_inverse=True)
        h = key % (len(c.ids) + 1) - 1
        yield _scored({
            "kind": ["asked"] * len(key), "chunk": np.full(len(key), chunk), "at": key // (len(c.ids) + 1),
            "history": np.where(h < 0, 0, c.ids[h]), "backed_off": np.bincount(which, weights=~seen[ask], minlength=len(key)).astype(np.int64),
            "undiscounted": np.bincount(which, weights=seen[ask], minlength=len(key)).astype(np.int64)})

    path = scratch(spark, "scored")
    _by_chunk(cut, [words, pairs], evaluate, _SCORED_DDL).write.partitionBy("kind").parquet(path)
    scored = spark.read.schema(_SCORED_DDL).parquet(path)

    asked = scored.filter("kind = 'asked'").select("chunk", "at", "history", "backed_off", "undiscounted")
    extra = (asked.join(histories(pairs, d2), "history")
             .groupBy("chunk", "at").agg(F.sum(F.col("backed_off") * F.col("log_alpha") + F.col("undiscounted") * F.col("log_shrink")).alias("extra")))
    return scored.filter("kind = 'text'").join(extra, ["chunk", "at"], "left").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), (F.col("value") + F.coalesce("extra", F.lit(0.0))).alias("score"))


def _totals(owned: DataFrame, n: int) -> list[int]:
    sums = owned.filter("kind = 'table'").agg(*[F.sum(F.col("stats")[i]) for i in range(n)]).first()
    return [s or 0 for s in sums]


def histories(pairs: DataFrame, d: np.ndarray) -> DataFrame:
    """history, log_alpha, log_shrink (of the counted pairs, if none of them is discounted)."""
    names = ["history", "total", *[f"n{r}" for r in range(1, DISCOUNTED + 1)], "covered"]

    def opened(batches):
        for payload, in _rows(batches):
            *whole, covered = unpack(payload)
            yield pa.RecordBatch.from_arrays([*map(pa.array, whole), pa.array(covered.view(np.float64))], names=names)

    ddl = ", ".join(f"{c} long" for c in names[:-1]) + ", covered double"
    rows = pairs.filter("kind = 'sums'").select("payload").mapInArrow(opened, ddl)
    added = rows.groupBy("history").agg(*[F.sum(c).alias(c) for c in names[1:]])
    left = sum(((1 - float(d[r])) * r * F.col(f"n{r}") for r in range(1, DISCOUNTED + 1)), F.lit(0.0))
    none = sum((F.col(f"n{r}") for r in range(1, DISCOUNTED + 1)), F.lit(0)) == 0
    left, total = F.when(none, 1.0).otherwise(left), F.col("total") + F.when(none, 1).otherwise(0)
    return added.filter("total > 0").select(
        "history", F.log10(left / total / (1 - F.col("covered"))).alias("log_alpha"), F.log10(F.col("total") / total).alias("log_shrink"))


_SCORED = [("kind", pa.string()), ("chunk", pa.int64()), ("at", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()),
           ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("value", pa.float64()),
           ("history", pa.int64()), ("backed_off", pa.int64()), ("undiscounted", pa.int64())]
_SCORED_DDL = ", ".join(f"{n} {({'int64': 'long', 'bool': 'boolean'}).get(str(t), str(t))}" for n, t in _SCORED)


def _scored(columns: dict) -> pa.RecordBatch:
    n = len(columns["chunk"])
    arrays = [pa.array(columns[c], t) if c in columns and not isinstance(columns[c], pa.Array) else columns.get(c, pa.nulls(n, t)) for c, t in _SCORED]
    return pa.RecordBatch.from_arrays(arrays, schema=pa.schema(_SCORED))
