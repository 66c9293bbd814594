"""Near duplicates of the pipeline: all pairs of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Exact, by prefix filtering.  The shingles of a text are put in one order for all texts; of
two similar sets of sizes n and m each shares a shingle of its first n - ceil(0.8 n) + 1
with that of the other.  How many of these two texts share also bounds their
overlap, so most chance pairs end before their sets are compared.  Shingles that are
frequent in a sample come last in the order; the sample decides about speed only.

Equal sets are folded first.  Neighbours under a shared shingle are compared before all
others; what they connect is not paired again, so a large group of near copies does not make all its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spinlog.llm.common import components, save

WORDS = 5
SEED = 42
SAMPLE_DOCS = 5_000
FREQUENT = 20_000
LEAST = 4  # smaller sets are similar only if they are equal

_FACTORS = np.random.default_rng(SEED).integers(1 << 62, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Distinct hashes of the shingles, ascending; a text with fewer words than a shingle is one shingle."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII blanks only
    codes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if not words:
        return codes
    width = min(WORDS, len(words))
    mixed = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        mixed += codes[k:len(codes) - width + 1 + k] * _FACTORS[k]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _FACTORS[0]
    return np.unique((mixed ^ (mixed >> np.uint64(29))).view(np.int64))


def identity(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63)


def prefix(found: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    n = len(found)
    if n < LEAST:
        return found[:0]
    late = np.zeros(n, bool)
    if len(frequent):
        late = frequent[np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)] == found
    return np.concatenate([found[~late], found[late]])[:n - (4 * n + 4) // 5 + 1]


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    n = docs.count()
    every = max(1, n // SAMPLE_DOCS)

    def cut(batches):
        for batch in batches:
            found = [shingles(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64))], names=["h"])

    counted = (docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text").mapInArrow(cut, "h long")
               .groupBy("h").count().filter("count > 3").orderBy(F.desc("count"), "h").limit(FREQUENT))
    return np.sort(np.array([r["h"] for r in counted.collect()], np.int64))


def sets(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """doc_id, sig, n, prefix: one row per row of `docs`; equal sets have equal `sig`."""

    def cut(batches):
        for batch in batches:
            found = [shingles(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([identity(f) for f in found], pa.int64()), pa.array(map(len, found), pa.int64()),
                 pa.array([prefix(f, frequent) for f in found], pa.list_(pa.int64()))], names=["doc_id", "sig", "n", "prefix"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, sig long, n long, prefix array<long>")


def _groups(batches, columns: list[str], work):
    """Rows come sorted by the first column; `work` gets whole groups of it."""
    held = None
    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy() for c in columns])
        rows = rows if held is None else np.concatenate([held, rows], axis=1)
        cut = int(np.searchsorted(rows[0], rows[0, -1])) if rows.shape[1] else 0
        held = rows[:, cut:]
        if cut:
            yield from work(rows[:, :cut])
    if held is not None and held.shape[1]:
        yield from work(held)


def shared(found: DataFrame) -> DataFrame:
    """key, sig, n, prev: the places of prefixes that several sets share; `prev` is the set before it (its own sig: none)."""

    def neighbours(rows):
        same = rows[0, 1:] == rows[0, :-1]
        after = np.concatenate([[False], same])
        prev = np.where(after, np.concatenate([rows[2, :1], rows[2, :-1]]), rows[2])
        prev_n = np.where(after, np.concatenate([rows[1, :1], rows[1, :-1]]), rows[1])
        keep = after | np.concatenate([same, [False]])
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (rows[0], rows[2], rows[1], prev, prev_n)],
                                         names=["key", "sig", "n", "prev", "prev_n"])

    places = found.select(F.explode("prefix").alias("key"), "n", "sig").distinct()
    return (places.repartition("key").sortWithinPartitions("key", "n", "sig")
            .mapInArrow(lambda b: _groups(b, ["key", "n", "sig"], neighbours), "key long, sig long, n long, prev long, prev_n long"))


def enough(c: Column, n: Column, m: Column) -> Column:
    """Can sets of sizes n and m that share c places of their prefixes be similar?"""
    need = F.floor((4 * (n + m) + 8) / 9)
    spare = F.least(*[1 - F.floor((4 * x + 4) / 5) for x in (n, m)])
    return (4 * F.greatest(n, m) <= 5 * F.least(n, m)) & (c >= spare + need)


def crossing(rows: np.ndarray):
    """Pairs of each key (key, n, sig, root) whose roots differ and whose sizes fit."""
    heads = np.flatnonzero(np.concatenate([[True], rows[0, 1:] != rows[0, :-1], [True]]))
    out, held = [], 0
    for begin, end in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
        _, n, sig, root = rows[:, begin:end]
        if (root == root[0]).all():
            continue
        stops = np.searchsorted(4 * n, 5 * n, "right")
        for i in range(end - begin - 1):
            js = np.arange(i + 1, stops[i])
            js = js[root[js] != root[i]]
            if len(js):
                swap = sig[js] < sig[i]
                a, b = np.where(swap, sig[js], sig[i]), np.where(swap, sig[i], sig[js])
                out.append(np.stack([a, b, np.where(swap, n[js], n[i]), np.where(swap, n[i], n[js])]))
                held += len(js)
            if held > 100_000:
                yield _pairs(out)
                out, held = [], 0
    if out:
        yield _pairs(out)


def _pairs(out: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(out, axis=1)], names=["a", "b", "n", "m"])


def verified(pairs: DataFrame, found: DataFrame, docs: DataFrame) -> DataFrame:
    """The (a, b) of `pairs` (a, b, n, m) with a similarity of 0.8 or more."""
    pairs = save(pairs.groupBy("a", "b", "n", "m").agg(F.count("*").alias("c")).filter(enough(F.col("c"), F.col("n"), F.col("m")))
                 .select("a", "b"), "pairs")
    wanted = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct()
    ids = found.select("doc_id", "sig").join(wanted, "sig", "left_semi").groupBy("sig").agg(F.min("doc_id").alias("doc_id"))

    def cut(batches):
        for batch in batches:
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([identity(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                                             names=["sig", "body"])

    bodies = docs.select(F.col("doc_id").cast("long"), "text").join(ids.select("doc_id"), "doc_id", "left_semi").select("text")
    bodies = save(bodies.mapInArrow(cut, "sig long, body binary").dropDuplicates(["sig"]), "bodies")

    def similar(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                keep.append(9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    return save(pairs.join(bodies.select(F.col("sig").alias("a"), F.col("body").alias("x")), "a")
                .join(bodies.select(F.col("sig").alias("b"), F.col("body").alias("y")), "b")
                .select("a", "b", "x", "y").mapInArrow(similar, "a long, b long"), "links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, component_id of the rows of `docs` with an id: the smallest id of those that links connect."""
    docs = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text")
    found = save(sets(docs, frequent_shingles(docs)), "sets")
    places = save(shared(found), "places")
    near = places.filter("sig <> prev").select(
        F.least("sig", "prev").alias("a"), F.greatest("sig", "prev").alias("b"),
        F.when(F.col("sig") < F.col("prev"), F.col("n")).otherwise(F.col("prev_n")).alias("n"),
        F.when(F.col("sig") < F.col("prev"), F.col("prev_n")).otherwise(F.col("n")).alias("m"))
    first = verified(near, found, docs)
    roots = components(first).withColumnRenamed("node", "sig")
    labelled = places.select("key", "n", "sig").join(roots, "sig", "left").select("key", "n", "sig", F.coalesce("root", "sig").alias("root"))
    rest = (labelled.repartition("key").sortWithinPartitions("key", "n", "sig")
            .mapInArrow(lambda b: _groups(b, ["key", "n", "sig", "root"], crossing), "a long, b long, n long, m long"))
    labels = components(first.union(verified(rest, found, docs))).withColumnRenamed("node", "sig")
    of_sig = found.groupBy("sig").agg(F.min("doc_id").alias("first")).join(labels, "sig", "left").select("sig", "first", F.coalesce("root", "sig").alias("root"))
    of_sig = save(of_sig, "roots")
    ids = of_sig.groupBy("root").agg(F.min("first").alias("component_id"))
    return found.select("doc_id", "sig").join(of_sig.join(ids, "root").select("sig", "component_id"), "sig").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` without near duplicates: of each component the document of the smallest id stays.

    Rows that repeat the id of a document that stays go as well; rows without an id stay and link nothing.
    """
    gone = near_duplicates(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.filter(F.col("doc_id").isNotNull()).join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id"])
    return kept.select(docs.columns).union(docs.filter(F.col("doc_id").isNull()))
