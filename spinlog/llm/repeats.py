"""Repeated 200-byte strings, removed by suffix arrays built with a difference cover.

1. Every 200-byte window has an anchor: the leftmost of its 32-byte grams with the least hash.
   Windows with one anchor at similar offsets form a block, and all windows of a
   block contain one core of 116 bytes.  Equal windows have equal cores, so only
   blocks whose core occurs elsewhere go on: a first scan counts hashes of cores, a second makes
   the blocks of texts with repeated ones again.  Nothing is lost: this deals the
   suffixes to partitions by content, as a sample sort would by order.
2. The contexts of such blocks (their windows' bytes) are folded by a 64-bit digest: a context that
   occurs twice has all its windows repeated, and goes on once.
3. Contexts of one core meet in one task, where each is cut to what it has in common
   with its nearest neighbours on both sides of the core.  All suffixes left are sorted by the
   difference-cover algorithm: triples at positions 1 and 2 modulo 3 are sorted
   and named, names are sorted by recursion, the remaining suffixes are sorted by one
   symbol and the name behind it and merged in.  Neighbours in that order with equal 200-byte
   prefixes are repeats.
4. What is repeated returns to its documents, and is cut out there.

A null text counts as empty.  Texts below 200 bytes lose nothing.  A text with a copy is removed
whole; it goes on as one, with their number, for other texts' sake.  Hot cores are rare by construction: equal contexts are one row, and contexts that
share 116 bytes but no 200-byte window differ close to the core on both sides.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinlog.llm.common import save

LENGTH = 200
GRAM = 32
BLOCK = 85
CORE = LENGTH - BLOCK + 1
BATCH_BYTES = 4 << 20
SORT_BYTES = 1 << 20
ENTRIES = 1 << 20
BUCKET_BYTES = 32 << 20

_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)


def blocks(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, start, windows, lead, core hash) of all blocks, `lead` being the bytes before the core; `begins` are the places where documents begin, and the end."""
    none = (np.zeros(0, np.int64),) * 5
    n = len(data)
    if n < LENGTH:
        return none
    grams, width = data.astype(np.uint64), 1
    while width < GRAM:
        grams = grams[:-width] * (_P + np.uint64(2 * width)) + grams[width:]
        width *= 2
    grams = (grams ^ (grams >> np.uint64(29))) * _MIX
    ranked = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_least(ranked, LENGTH - GRAM + 1)
    starts = np.arange(len(least))
    doc = np.searchsorted(begins, starts, "right") - 1
    inside = starts + LENGTH <= begins[doc + 1]
    starts, doc = starts[inside], doc[inside]
    if not len(starts):
        return none
    anchor = (least[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    slot = (anchor - starts) // BLOCK
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (slot[1:] != slot[:-1]) | (doc[1:] != doc[:-1])]))
    core = anchor[new] - slot[new] * BLOCK
    up = np.cumprod(np.full(n, _P, np.uint64))
    down = np.cumprod(np.full(n, _INVERSE, np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * up, dtype=np.uint64)])
    hashes = (total[core + CORE] - total[core]) * down[core]
    hashes ^= hashes >> np.uint64(31)
    return doc[new], starts[new], np.diff(np.append(new, len(starts))), core - starts[new], (hashes * _MIX).view(np.int64)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours: prefix and suffix minima of blocks of that width."""
    out = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:out], ahead[width - 1:width - 1 + out])


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """All suffixes in order; `symbols` are whole numbers from 1 up, the end counts as 0."""
    n = len(symbols)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: symbols[i:].tolist()), np.int64)
    text = np.concatenate([symbols.astype(np.int64), np.zeros(3, np.int64)])
    # A place beyond the end keeps the two samples apart in the recursion.
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    bits = int(text.max()).bit_length()
    if 3 * bits <= 63:
        triple = (text[sample] << (2 * bits)) | (text[sample + 1] << bits) | text[sample + 2]
        order = np.argsort(triple)
        new = np.concatenate([[True], triple[order][1:] != triple[order][:-1]])
    else:
        parts = [text[sample + k] for k in range(3)]
        order = np.lexsort(parts[::-1])
        new = np.concatenate([[True], np.logical_or.reduce([p[order][1:] != p[order][:-1] for p in parts])])
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(new)
    if not new.all():
        order = suffix_array(names)
    sample = sample[order]
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = np.arange(1, len(sample) + 1)
    sample = sample[sample < n]
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(text[rest] * (len(rank) + 1) + rank[rest + 1])]
    # How many sampled suffixes precede each of the rest: all binary searches in step.
    lo, hi = np.zeros(len(rest), np.int64), np.full(len(rest), len(sample), np.int64)
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            break
        mid = (lo[open_] + hi[open_]) >> 1
        s, r = sample[mid], rest[open_]
        one = s % 3 == 1
        first = np.sign(text[s] - text[r])
        after_one = np.sign(rank[s + 1] - rank[r + 1])
        second = np.sign(text[s + 1] - text[r + 1])
        after_two = np.sign(rank[s + 2] - rank[r + 2])
        order = np.where(first != 0, first, np.where(one, after_one, np.where(second != 0, second, after_two)))
        less = order < 0
        lo[open_[less]] = mid[less] + 1
        hi[open_[~less]] = mid[~less]
    out = np.empty(n, np.int64)
    places = lo + np.arange(len(rest))
    out[places] = rest
    free = np.ones(n, bool)
    free[places] = False
    out[free] = sample
    return out


def repeated(contexts: list[bytes]) -> list[np.ndarray]:
    """For each context, whether each of its windows occurs in another place among them."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    begins = np.cumsum(sizes) - sizes
    order = suffix_array(data.astype(np.int64) + 1)
    whole = np.zeros(len(data), bool)
    for b, s in zip(begins.tolist(), sizes.tolist(), strict=True):
        whole[b:b + s - LENGTH + 1] = True
    order = order[whole[order]]  # suffixes that begin a window
    views = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    hit = np.zeros(len(data), bool)
    for k in range(0, len(order) - 1, 20_000):
        left, right = order[k:k + 20_000], order[k + 1:k + 20_001]
        left = left[:len(right)]
        near = np.flatnonzero(data[left + LENGTH - 1] == data[right + LENGTH - 1])
        same = near[(views[left[near]] == views[right[near]]).all(axis=1)]
        hit[left[same]] = hit[right[same]] = True
    return [hit[b:b + s - LENGTH + 1] for b, s in zip(begins.tolist(), sizes.tolist(), strict=True)]


def _batches_of_blocks(batch):
    """(first row, row behind, data, places of documents, blocks) of runs of rows of about BATCH_BYTES."""
    body = batch.column("body")
    size, at = np.array([len(b) for b in body.to_pylist()], np.int64), 0
    while at < len(size):
        stop = max(at + 1, int(np.searchsorted(np.cumsum(size[at:]), BATCH_BYTES, "right")) + at)
        begins = np.concatenate([[0], np.cumsum(size[at:stop])])
        yield at, stop, begins, blocks(np.frombuffer(b"".join(body.slice(at, stop - at).to_pylist()), np.uint8), begins)
        at = stop


def _distinct(core: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs by core, and whether a pair's core has other keys too."""
    order = np.lexsort((key, core))
    core, key = core[order], key[order]
    other = core[1:] != core[:-1]
    new = np.concatenate([[True], other | (key[1:] != key[:-1])])[:len(core)]
    core, key = core[new], key[new]
    beside = core[1:] == core[:-1]
    return core, key, np.concatenate([beside, [False]])[:len(core)] | np.concatenate([[False], beside])[:len(core)]


def _bucket(mixed: np.ndarray, buckets: int) -> np.ndarray:
    return ((mixed >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _packed(bucket: np.ndarray, words: np.ndarray, kind: int) -> pa.RecordBatch:
    """One row per bucket (in ascending order) with its rows of `words` as bytes."""
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])[:len(bucket)])
    width = 8 * words.shape[1]
    offsets = np.append(edges, len(bucket)).astype(np.int32) * np.int32(width)
    data = pa.Array.from_buffers(pa.binary(), len(edges), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(words))])
    return pa.RecordBatch.from_arrays([pa.array(bucket[edges], pa.int32()), pa.array(np.full(len(edges), kind, np.int8)), data],
                                      names=["bucket", "kind", "data"])


SINGLE, KNOWN, HITS = 0, 1, 2


def _core_entries(buckets: int):
    """Core hashes with the key of their text, dealt to buckets by core.

    About ENTRIES of them are folded at a time.  A core that two texts share there, or one text has twice,
    is known to be repeated: it goes on once, and its texts go to buckets by core and text,
    so no bucket grows with the texts that share one core, or with the copies of one text.
    """
    def rows(batches):
        cores, keys, twice, held = [], [], [], 0

        def emit():
            core, key, shared = _distinct(np.concatenate(cores), np.concatenate(keys))
            own = np.unique(np.concatenate(twice))
            known = shared | np.isin(core, own)
            yield _packed(_bucket(core[~known], buckets), np.column_stack([core[~known], key[~known]]), SINGLE)
            once = np.unique(core[known])
            yield _packed(_bucket(once, buckets), once.reshape(-1, 1), KNOWN)
            core, key = core[known], key[known]
            target = _bucket((core ^ (key * _P)) * _MIX, buckets)
            order = np.argsort(target, kind="stable")
            yield _packed(target[order], np.column_stack([core[order], key[order]]), HITS)

        for batch in batches:
            k1 = batch.column("k1").to_numpy().view(np.uint64)
            for at, _, _, (doc, _, _, _, core) in _batches_of_blocks(batch):
                core = core.view(np.uint64)
                order = np.lexsort((core, doc))
                again = (core[order][1:] == core[order][:-1]) & (doc[order][1:] == doc[order][:-1])
                cores.append(core)
                keys.append(k1[doc + at])
                twice.append(core[order][1:][again])
                held += len(core)
                if held >= ENTRIES:
                    yield from emit()
                    cores, keys, twice, held = [], [], [], 0
        if held:
            yield from emit()

    return rows


def _repeated_cores(batches):
    """Rows (k1, core) of cores that occur elsewhere, bucket by bucket (the rows come in order of bucket)."""
    now, held = None, ([], [], [])

    def close():
        single, known, hits = (np.frombuffer(b"".join(h), np.uint64) for h in held)
        for h in held:
            h.clear()
        core, key, shared = _distinct(single[::2], single[1::2])
        keep = shared | np.isin(core, np.unique(known))
        more_core, more_key, _ = _distinct(hits[::2], hits[1::2])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in ((key[keep], more_key), (core[keep], more_core))],
                                          names=["k1", "core"])

    for batch in batches:
        for bucket, kind, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "data")), strict=True):
            if bucket != now and now is not None:
                yield close()
            now = bucket
            held[kind].append(data)
    yield close()


FOUND = pa.struct([("core", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("lead", pa.int32())])


def _found(batches):
    """The blocks of texts whose cores are repeated, made again beside the text."""
    for batch in batches:
        cores = np.unique(batch.column("cores").flatten().to_numpy())
        for at, stop, begins, (doc, start, n, lead, core) in _batches_of_blocks(batch):
            keep = np.isin(core, cores)
            doc = doc[keep]
            values = [core[keep], (start[keep] - begins[doc]).astype(np.int32), n[keep].astype(np.int32), lead[keep].astype(np.int32)]
            found = pa.StructArray.from_arrays([pa.array(v) for v in values], fields=list(FOUND))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(stop - at + 1)).astype(np.int32)), found)
            part = batch.slice(at, stop - at)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("k1", "k2", "docs", "body")), lists],
                                             names=["k1", "k2", "docs", "body", "found"])


def _contexts(with_bytes: bool):
    def rows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                body, found = part.column("body")[0].as_py(), part.column("found").flatten()
                core, start, n, lead = found.flatten()
                begins, ends = start.to_numpy(), start.to_numpy() + n.to_numpy() + (LENGTH - 1)
                contexts = [body[b:e] for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]
                digest = np.array([xxhash.xxh64_intdigest(c) for c in contexts], np.uint64).view(np.int64)
                one = np.zeros(len(contexts), np.int64)
                columns = [core, pa.array(digest)]
                if with_bytes:
                    columns += [lead, pa.array(contexts, pa.binary()), pa.array(one + part.column("docs")[0].as_py())]
                else:
                    columns += [*(pa.array(one + part.column(k)[0].as_py(), t) for k, t in (("k1", pa.int64()), ("k2", pa.int32()))), start]
                yield pa.RecordBatch.from_arrays(columns, names=CONTEXT[with_bytes])

    return rows


CONTEXT = {True: ["core", "digest", "lead", "context", "docs"], False: ["core", "digest", "k1", "k2", "start"]}
RUNS = pa.schema([("core", pa.int64()), ("digest", pa.int64()), ("runs", pa.list_(pa.int32()))])


def _runs(hit: np.ndarray) -> list[int]:
    """Beginnings and ends, by turns, of the runs of windows hit."""
    return np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).tolist()


def trimmed(group: list) -> list:
    """(member, bytes left out before, bytes) of members whose windows may be shared.

    Of each side only what a member shares with its nearest neighbours there can be part of a repeated window.
    """
    reach = []
    for sides in ([g[3][:g[2]][::-1] for g in group], [g[3][g[2] + CORE:] for g in group]):
        order = sorted(range(len(group)), key=sides.__getitem__)
        longest = [0] * len(group)
        for i, j in zip(order, order[1:], strict=False):
            common = _common(sides[i], sides[j])
            longest[i], longest[j] = max(longest[i], common), max(longest[j], common)
        reach.append(longest)
    out = []
    for g, left, right in zip(group, *reach, strict=True):
        if left + CORE + right >= LENGTH:
            out.append((g, g[2] - left, g[3][g[2] - left:g[2] + CORE + right]))
    return out


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo = 0
    while lo < n and a[lo] == b[lo]:
        lo += 1
    return lo


def _sorted_groups(batches):
    """Streams contexts ordered by core; sorts the suffixes of whole cores, about SORT_BYTES at a time."""
    group: list = []
    ready: list = []

    def close() -> None:
        # A context that occurs twice is decided by its count; it still serves the others.
        nonlocal group
        decided.extend(g for g in group if g[4] > 1)
        if len(group) > 1 and any(g[4] < 2 for g in group):
            ready.extend(trimmed(group))
        group = []

    def emit():
        rows = [(g[0], g[1], [0, len(g[3]) - LENGTH + 1]) for g in decided]
        if ready:
            for (g, skipped, _), hit in zip(ready, repeated([c for _, _, c in ready]), strict=True):
                if g[4] < 2 and hit.any():
                    rows.append((g[0], g[1], [r + skipped for r in _runs(hit)]))
        decided.clear()
        ready.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], RUNS.types[k]) for k in range(3)], schema=RUNS)

    decided: list = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("core", "digest", "lead", "context", "docs")), strict=True):
            if group and group[-1][0] != row[0]:
                close()
                if size > SORT_BYTES:
                    yield emit()
                    size = 0
            group.append(row)
            size += len(row[3])
    close()
    yield emit()


def _cut(batches):
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            body = row["body"]
            delta = np.zeros(len(body) + 1, np.int32)
            for piece in row["pieces"]:
                edges = np.array(piece["runs"]).reshape(-1, 2) + piece["start"]
                np.add.at(delta, edges[:, 0], 1)
                np.add.at(delta, edges[:, 1] - 1 + LENGTH, -1)
            gone = np.cumsum(delta[:-1]) > 0
            kept = np.frombuffer(body, np.uint8)[~gone].tobytes()
            rows.append((row["k1"], row["k2"], int(gone.sum()), len(_runs(gone)) // 2, hashlib.sha256(kept).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(CUT.types)], schema=CUT)


CUT = pa.schema([("k1", pa.int64()), ("k2", pa.int32()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def remove(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per row of `docs`.

    A text is known by two hashes of its bytes; the document of the smallest id stands for its copies.
    """
    body = F.coalesce("text", F.lit("")).cast("binary")
    rows = (docs.select(F.col("doc_id").cast("long"), body.alias("body"))
            .withColumns({"k1": F.xxhash64("body"), "k2": F.hash("body")}))
    keyed = rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1 << 63))).filter(F.length("body") >= LENGTH)
    copies = save(keyed.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("docs"),
                                                F.first(F.length("body")).cast("long").alias("n_bytes")), "copies")
    size = copies.agg(F.sum(F.col("docs") * F.col("n_bytes"))).first()[0] or 0
    buckets = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES))
    cores = (keyed.select("k1", "body").mapInArrow(_core_entries(buckets), "bucket int, kind byte, data binary")
             .repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_repeated_cores, "k1 long, core long"))
    wanted = cores.groupBy("k1").agg(F.collect_set("core").alias("cores")).join(copies.drop("n_bytes"), "k1")
    # Only texts that share a core go on, one of equal ones, with their bytes.
    shared = save(keyed.join(wanted, ["doc_id", "k1", "k2"]).select("k1", "k2", "docs", "body", "cores")
                  .mapInArrow(_found, "k1 long, k2 int, docs long, body binary, found array<struct<core:long,start:int,n:int,lead:int>>"), "sharing")
    single = shared.filter("docs = 1")  # a text with a copy is repeated as a whole
    folded = (shared.select("body", "found", "docs")
              .mapInArrow(_contexts(True), "core long, digest long, lead int, context binary, docs long")
              .groupBy("core", "digest").agg(F.first("lead").alias("lead"), F.first("context").alias("context"), F.sum("docs").alias("docs")))
    runs = save(folded.repartition("core").sortWithinPartitions("core")
                .mapInArrow(_sorted_groups, "core long, digest long, runs array<int>"), "runs")
    places = single.select("body", "found", "k1", "k2").mapInArrow(_contexts(False), "core long, digest long, k1 long, k2 int, start int")
    pieces = (places.join(runs, ["core", "digest"]).groupBy("k1", "k2")
              .agg(F.collect_list(F.struct("start", "runs")).alias("pieces")))
    cut = (single.select("k1", "k2", "body").join(pieces, ["k1", "k2"])
           .mapInArrow(_cut, "k1 long, k2 int, n_removed long, n_spans long, kept_sha256 string"))
    gone = copies.filter("docs > 1").select("k1", "k2", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"),
                                            F.sha2(F.lit(b""), 256).alias("kept_sha256"))
    whole = rows.select("doc_id", "k1", "k2", F.length("body").cast("long").alias("n_bytes"), F.sha2("body", 256).alias("sha"))
    return whole.join(cut.unionByName(gone), ["k1", "k2"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
