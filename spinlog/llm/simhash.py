"""SimHash fingerprints and their near-duplicate components, by anchor-point covering.

A fingerprint has 64 bits; two are linked if they differ in at most 4.  Of its two
32-bit halves one then differs in at most 2.  The anchors of a half are the words
of a covering code: a perfect [31, 26] Hamming code on 31 bits, the last bit free; every half
lies within radius 1 of an anchor.  Two halves at distance 2 or less have a point
between them at distance 1 of both, so both lie within 2 of the anchor nearest to
that point: each fingerprint is replicated to every anchor within 2 (the radius
plus its part of the threshold; 17 at most per half), and fingerprints are compared where they share an anchor.

Equal fingerprints are folded before they are replicated, so copies cost nothing.
An anchor with many fingerprints is dealt out in pairs of blocks, each of bounded
size.  Where they meet, links are reduced to a tree, so a group never emits all its pairs.

Defined cases: a text with fewer words than a shingle is one shingle; one without words (or null) has the
fingerprint zero, which links like any other.  Rows with a null id get the component of the others like them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinlog.llm.common import components, save

WORDS = 4
DISTANCE = 4
SEED = 42
BLOCK = 1500
SMALL_RUN = 12

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)  # bits of each byte value, lowest first
_POSITIONS = np.arange(1, 32, dtype=np.int64)


def fingerprint(text: str | None, n_words: int = WORDS) -> int:
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= n_words:
        return xxhash.xxh64_intdigest(joined, SEED)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = [0, *(stops[:-n_words] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[b:e], SEED) for b, e in zip(begins, stops[n_words - 1:].tolist(), strict=True)], np.uint64)
    planes = hashes.view(np.uint8).reshape(-1, 8)
    value = 0
    for k in range(8):
        ones = np.bincount(planes[:, k], minlength=256) @ _BITS
        value |= sum(1 << (8 * k + b) for b in range(8) if 2 * ones[b] > len(hashes))
    return value


def fingerprints(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), and the long columns `also`."""

    def hashed(batches):
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64)), *map(batch.column, also)],
                                             names=["doc_id", "fp", *also])

    ddl = ", ".join(f"{c} long" for c in ("doc_id", "fp", *also))
    return docs.select(F.col("doc_id").cast("long"), "text", *also).mapInArrow(hashed, ddl)


def anchors(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for every anchor within 2 of each 32-bit half.

    The syndrome of a 31-bit word is the exclusive or of its set positions (1 to
    31): 0 for words of the code.  Flipping position p changes it by p.
    """
    halves = halves.astype(np.int64)
    syndrome = np.zeros(len(halves), np.int64)
    for p in range(1, 32):
        syndrome ^= ((halves >> (p - 1)) & 1) * p
    rows = np.arange(len(halves))
    one = np.where(syndrome > 0, halves ^ (1 << np.maximum(syndrome - 1, 0)), halves)  # nearest anchor, at 0 or 1
    out_rows, out = [rows, rows], [one, one ^ (1 << 31)]
    partner = _POSITIONS ^ syndrome[:, None]
    pairs = (syndrome[:, None] > 0) & (partner > _POSITIONS)  # both flips inside the word, each pair once
    at, p = np.nonzero(pairs)
    out_rows.append(at)
    out.append(halves[at] ^ (1 << p) ^ (1 << (partner[at, p] - 1)))
    return np.concatenate(out_rows), np.concatenate(out)


def replicate(fps: DataFrame) -> DataFrame:
    """(key, fp): each fingerprint at each of its anchors, for both halves."""

    def keyed(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            bits = fp.view(np.uint64)
            keys, owners = [], []
            for half in (0, 1):
                rows, anchor = anchors(((bits >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.int64))
                keys.append(anchor | (half << 32))
                owners.append(fp[rows])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(owners))], names=["key", "fp"])

    return fps.select("fp").mapInArrow(keyed, "key long, fp long")


def tree(fps: np.ndarray) -> tuple[list[int], list[int]]:
    """Links (parent, child) that connect what is connected among `fps`; every pair is compared, none is stored."""
    waiting = fps.view(np.uint64)
    parents, children = [], []
    while len(waiting):
        queue, waiting = [waiting[0]], waiting[1:]
        while queue and len(waiting):
            at = queue.pop()
            near = np.bitwise_count(waiting ^ at) <= DISTANCE
            if near.any():
                new = waiting[near]
                parents += [int(at.view(np.int64))] * len(new)
                children += new.view(np.int64).tolist()
                queue += list(new)
                waiting = waiting[~near]
    return parents, children


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between different fingerprints that connect exactly what links of `DISTANCE` bits connect."""
    keyed = save(replicate(fps), "anchors")
    crowded = (keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK)
               .select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = (keyed.join(crowded, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
             .select("key", "fp", own.alias("own"), other.alias("other"))
             .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp"))

    def compared(batches):
        held = None
        for batch in batches:
            table = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j", "fp")])
            table = table if held is None else np.concatenate([held, table], axis=1)
            # the last group may go on in the next batch
            same = (table[:3] == table[:3, -1:]).all(axis=0)
            cut = table.shape[1] - int(np.argmin(same[::-1])) if not same.all() else 0
            held = table[:, cut:]
            if cut:
                yield _linked(table[:, :cut])
        if held is not None and held.shape[1]:
            yield _linked(held)

    return (dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
            .mapInArrow(compared, "a long, b long").distinct())


def _linked(table: np.ndarray) -> pa.RecordBatch:
    fps = np.ascontiguousarray(table[3])
    heads = np.flatnonzero(np.concatenate([[True], (table[:3, 1:] != table[:3, :-1]).any(axis=0)]))
    sizes = np.diff(np.append(heads, len(fps)))
    group = np.repeat(np.arange(len(heads)), sizes)
    small = np.repeat(sizes <= SMALL_RUN, sizes)
    a, b = [], []
    bits = fps.view(np.uint64)
    for d in range(1, min(SMALL_RUN, int(sizes.max()))):
        near = small[d:] & (group[d:] == group[:-d]) & (np.bitwise_count(bits[d:] ^ bits[:-d]) <= DISTANCE)
        a.append(fps[:-d][near])
        b.append(fps[d:][near])
    for g in np.flatnonzero(sizes > SMALL_RUN).tolist():
        parents, children = tree(fps[heads[g]:heads[g] + sizes[g]])
        a.append(np.array(parents, np.int64))
        b.append(np.array(children, np.int64))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (a, b)], names=["a", "b"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: one row per row of `docs`."""
    hashed = save(fingerprints(docs), "fingerprints")
    distinct = save(hashed.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    labels = components(links(distinct))
    roots = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = roots.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return hashed.join(of_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` without near duplicates: of each component the row of the smallest id stays.

    Rows are told apart by id and text, so rows of one id whose texts are unlike all stay, each for its component.  A
    row without an id stays only if its component has none with one.  Of rows that repeat id and text one stays.
    """
    digest = F.xxhash64("text")
    hashed = save(fingerprints(docs.select("doc_id", "text", digest.alias("_digest")), "_digest"), "fingerprints")
    labels = components(links(save(hashed.select("fp").distinct(), "distinct")))
    rooted = hashed.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_digest"))
    kept = rooted.groupBy("root").agg(best.alias("best")).select(F.struct("best.doc_id", "best._digest").alias("_row"))
    # Null ids are equal inside a struct, and both steps below share its partitioning.
    row = F.struct(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("_digest"))
    return docs.withColumn("_row", row).join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select(docs.columns)
