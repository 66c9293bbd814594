"""Token ids as bit planes: blocks of ids are transposed into planes, each compressed on its own, with an index.

A token folder holds two Parquet tables written by the tasks that encode:

* ``kind=block``: (shard, block, n_ids, width, planes, docs).  A block is up to
  `block_ids` consecutive ids of its shard; `planes` is one zstandard frame per
  byte plane (all lowest bytes first) or bit plane (`unit`), `width` their number.
* ``kind=doc``, the chunk index: (shard, seq, doc_id, local, n_tokens), a
  document's place in its shard.  `docs` of a block names the parts of documents
  in it (seq, doc_id, local start, tokens of the document, part number, ids), so a
  block can be read without any other.

Shards are ranges of doc_id in ascending order, blocks and documents count
upwards in them.  A null text counts as empty; a document is never missing: it has its
end id at least.  Rows with equal doc_id are kept, ordered by their text.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spinlog.llm.common import scratch

BLOCK_IDS = 1 << 16
SHARD_BYTES = 16 << 20
KNOWN_CHUNKS = 500_000
TEXTS_AT_ONCE, BYTES_AT_ONCE = 1500, 16 << 20

DOC_PART = "struct<seq:long,doc_id:long,local:long,n_tokens:long,part:int,parts_end:boolean,ids:int>"
SCHEMA = ("kind string, shard int, block int, n_ids int, width int, planes array<binary>, "
          f"docs array<{DOC_PART}>, seq long, doc_id long, local long, n_tokens long")

PART = pa.struct([("seq", pa.int64()), ("doc_id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()),
                  ("part", pa.int32()), ("parts_end", pa.bool_()), ("ids", pa.int32())])
ARROW = pa.schema([("kind", pa.string()), ("shard", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int32()),
                   ("width", pa.int32()), ("planes", pa.list_(pa.binary())), ("docs", pa.list_(PART)),
                   ("seq", pa.int64()), ("doc_id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64())])

READ = pa.schema([("shard", pa.int32()), ("seq", pa.int64()), ("doc_id", pa.int64()), ("local", pa.int64()),
                  ("n_tokens", pa.int64()), ("part", pa.int32()), ("crc", pa.int64()), ("ids", pa.binary())])

# White space as Unicode has it.  The pre-tokenizer of byte-level BPE never joins
# text across the borders of these chunks, so a chunk's ids do not depend on its
# surroundings.  The same holds for a text cut before each space, unless white
# space stands on both sides of that space (or before it at the end).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")
BLANK = re.compile(f"[{SPACE}]")
BLANKS = "".join(c for c in map(chr, range(0x3001)) if BLANK.match(c))
UNSAFE = f"[{BLANKS}] (?:[{BLANKS}]|$)"

# Letters, digits and marks that every Unicode version classes alike, without the apostrophe: of these
# the pre-tokenizer makes just these parts.
LETTERS = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u0233"
MARKS = r"!-&(-/:-@\[-`{-~"
PLAIN = re.compile(f" ?[{LETTERS}]+| ?[0-9]+| ?[{MARKS}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")
WORD = re.compile(f" ?[{LETTERS}]+")
AT_ONCE = 8

# Byte-level vocabularies write a byte as itself if that prints, and else as the next letter from U+0100 on.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
SYMBOLS = {b: chr(b) if b in _SHOWN else chr(256 + _HIDDEN.index(b)) for b in range(256)}


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = [re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()]
    return tokenizer, "|".join([UNSAFE, *added]), Memory()


class Memory:
    """Ids of chunks in two generations: those met since the last turn, and the ones before, which go with the next."""

    def __init__(self) -> None:
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def turn(self) -> None:
        if len(self.known) > KNOWN_CHUNKS // 2:
            self.older, self.known = self.known, {}

    def missing(self, chunks: list[str]) -> list[str]:
        """Those of `chunks` that neither has; the older ones are taken over."""
        again = {c: self.older[c] for c in chunks if c in self.older}
        self.known.update(again)
        return [c for c in chunks if c not in again]


def encode(texts: pa.Array, tokenizer_path: str) -> list[np.ndarray]:
    """Ids of each text (no nulls).  Distinct words are found by Arrow; each is encoded once as long as it is remembered."""
    tokenizer, whole, memory = _tokenizer(tokenizer_path)
    memory.turn()
    known = memory.known
    unsafe = pc.match_substring_regex(texts, whole).to_numpy(zero_copy_only=False)
    out: list = [None] * len(texts)
    if unsafe.any():
        rows = np.flatnonzero(unsafe).tolist()
        for i, found in zip(rows, tokenizer.encode_batch_fast(texts.filter(pa.array(unsafe)).to_pylist(),
                                                              add_special_tokens=False), strict=True):
            out[i] = np.array(found.ids, "<u4")
    pieces = pc.split_pattern(texts.filter(pa.array(~unsafe)), " ")
    borders = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
    if len(borders) < 2:
        return out
    words = pieces.flatten().dictionary_encode()
    codes = words.indices.to_numpy().astype(np.int64)
    names = words.dictionary.to_numpy(zero_copy_only=False).tolist()
    # The first piece of a text has no space before it.
    firsts, at = np.unique(codes[borders[:-1]], return_inverse=True)
    codes[borders[:-1]] = len(names) + at
    keys = [" " + w for w in names] + [names[k] for k in firsts.tolist()]
    found = list(map(known.get, keys))
    if None in found:
        learn(memory.missing([k for k, i in zip(keys, found, strict=True) if i is None]), tokenizer, known)
        found = [i if i is not None else known[k] for k, i in zip(keys, found, strict=True)]
    table = np.frombuffer(b"".join(found), "<u4")
    lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
    begins = np.cumsum(lengths) - lengths
    sizes = lengths[codes]
    stops = np.cumsum(sizes)
    ids = table[np.repeat(begins[codes] - (stops - sizes), sizes) + np.arange(stops[-1])]
    ends = stops[borders[1:] - 1].tolist()
    for i, begin, end in zip(np.flatnonzero(~unsafe).tolist(), [0, *ends[:-1]], ends, strict=True):
        out[i] = ids[begin:end]
    return out


def some(texts: pa.Array):
    """Runs of texts, bounded in number and, but for one longer text, in bytes."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    begin = held = 0
    for k, size in enumerate(sizes.tolist()):
        if k > begin and (k - begin == TEXTS_AT_ONCE or held + size > BYTES_AT_ONCE):
            yield texts.slice(begin, k - begin)
            begin, held = k, 0
        held += size
    if begin < len(sizes):
        yield texts.slice(begin)


def is_word(chunk: str) -> bool:
    return chunk not in ("", " ") and not BLANK.search(chunk, chunk[0] == " ")


def learn(chunks: list[str], tokenizer, known: dict[str, bytes]) -> None:
    """Adds the ids of `chunks` to `known`.

    A chunk of plain characters only is cut into its parts here, and the tokenizer's
    model gets each new part.  All others go to the whole tokenizer.
    """
    known[""] = b""
    single, joined, rest = [], [], []
    for c in chunks:
        if WORD.fullmatch(c):
            single.append(c)
        else:
            found = PLAIN.findall(c)
            if len("".join(found)) == len(c):
                joined.append((c, found))
            else:
                rest.append(c)
    new = {p for _, ps in joined for p in ps}.difference(single)
    new = [*single, *[p for p in new if p not in known]]
    known.update(zip(new, model_ids(new, tokenizer), strict=True))
    for c, ps in joined:
        known[c] = b"".join([known[p] for p in ps])
    if rest:
        learn_others(rest, tokenizer, known)


def model_ids(parts: list[str], tokenizer) -> list[bytes]:
    """Ids of parts of plain characters, some at a time, with a symbol between them that no merge knows."""
    if not parts:
        return []
    divider, cut = _divider(tokenizer)
    if divider is None:  # a vocabulary that merges every symbol: no short cut
        return [np.array(found.ids, "<u4").tobytes() for found in tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
    words = chr(divider).join(parts).encode().decode("latin-1").translate(SYMBOLS).split(SYMBOLS[divider])
    mark, tokenize = SYMBOLS[divider], tokenizer.model.tokenize
    raw = np.array([t.id for k in range(0, len(words), AT_ONCE) for t in tokenize(mark.join(words[k:k + AT_ONCE]) + mark)], "<u4")
    stops = 4 * np.flatnonzero(raw == cut)
    return list(map(raw.tobytes().__getitem__, map(slice, [0, *(stops[:-1] + 4).tolist()], stops.tolist())))


@lru_cache(maxsize=2)
def _divider(tokenizer) -> tuple[int | None, int]:
    """A control character, none of PLAIN, whose symbol stands in no longer token, and its id."""
    vocabulary = tokenizer.get_vocab()
    longer = set("".join(t for t in vocabulary if len(t) > 1))
    free = [c for c in range(9) if SYMBOLS[c] in vocabulary and SYMBOLS[c] not in longer]
    return (free[0], vocabulary[SYMBOLS[free[0]]]) if free else (None, -1)


def learn_others(chunks: list[str], tokenizer, known: dict[str, bytes]) -> None:
    """Words go to the tokenizer as one text with line ends between them: a line end
    next to other characters is always a token of its own, so the ids can be cut
    there.  Chunks with white space inside are put together from their parts.
    """
    mixed, words = [], []
    for c in chunks:
        (words if is_word(c) else mixed).append(c)
    parts = [CHUNK.findall(c) for c in mixed]
    own = {p for ps in parts for p in ps if p not in known}
    words += [p for p in own.difference(words) if is_word(p)]
    if words:
        ids = np.array(tokenizer.encode_batch_fast(["\n".join([*words, ""])], add_special_tokens=False)[0].ids, "<u4")
        cut = tokenizer.encode("\n", add_special_tokens=False).ids[0]
        raw, stops = ids.tobytes(), (4 * np.flatnonzero(ids == cut)).tolist()
        known.update(zip(words, map(raw.__getitem__, map(slice, [0, *(s + 4 for s in stops[:-1])], stops)), strict=True))
    for p in own:
        if p not in known:
            known[p] = np.array(tokenizer.encode(p, add_special_tokens=False).ids, "<u4").tobytes()
    known.update((c, b"".join([known[p] for p in ps])) for c, ps in zip(mixed, parts, strict=True))


def pack(ids: np.ndarray, unit: str, level: int = 3) -> list[bytes]:
    """Planes of one block, lowest first; as many as its largest id needs."""
    squeeze = zstandard.ZstdCompressor(level=level).compress
    if unit == "byte":
        width = max(1, (int(ids.max(initial=0)).bit_length() + 7) // 8)
        planes = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
        return [squeeze(np.ascontiguousarray(planes[:, k]).tobytes()) for k in range(width)]
    width = max(1, int(ids.max(initial=0)).bit_length())
    return [squeeze(np.packbits((ids >> k) & 1).tobytes()) for k in range(width)]


def unpack(planes: list[bytes], n_ids: int, unit: str) -> np.ndarray:
    expand = zstandard.ZstdDecompressor().decompress
    ids = np.zeros(n_ids, np.uint32)
    for k, plane in enumerate(planes):
        raw = np.frombuffer(expand(plane), np.uint8)
        ids |= raw.astype(np.uint32) << (8 * k) if unit == "byte" else np.unpackbits(raw, count=n_ids).astype(np.uint32) << k
    return ids


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, block_ids: int = BLOCK_IDS,
          unit: str = "byte", shards: int | None = None) -> None:
    """Encodes `docs` (doc_id, text) into the folder `path`.  The texts are shuffled once, before they are encoded."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    if shards is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(spark.sparkContext.defaultParallelism, -(-size // SHARD_BYTES))

    def blocks_of(batches):
        shard = TaskContext.get().partitionId()
        seq = local = block = 0
        waiting: list[np.ndarray] = []
        parts: list[dict] = []
        held = 0

        def block_row():
            nonlocal block, waiting, parts, held
            ids = np.concatenate(waiting)
            planes = pack(ids, unit)
            row = {"kind": "block", "shard": shard, "block": block, "n_ids": len(ids), "width": len(planes),
                   "planes": planes, "docs": parts}
            block, waiting, parts, held = block + 1, [], [], 0
            return row

        for batch in batches:
            ids_of = (ids for texts in some(batch.column("text")) for ids in encode(texts, tokenizer_path))
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), ids_of, strict=True):
                ids = np.append(ids, np.uint32(end_id))
                at = part = 0
                while at < len(ids):
                    take = min(len(ids) - at, block_ids - held)
                    waiting.append(ids[at:at + take])
                    at, held = at + take, held + take
                    parts.append({"seq": seq, "doc_id": doc_id, "local": local, "n_tokens": len(ids), "part": part,
                                  "parts_end": at == len(ids), "ids": take})
                    part += 1
                    if held == block_ids:
                        rows.append(block_row())
                rows.append({"kind": "doc", "shard": shard, "seq": seq, "doc_id": doc_id, "local": local, "n_tokens": len(ids)})
                seq, local = seq + 1, local + len(ids)
            yield pa.RecordBatch.from_pylist(rows, ARROW)
        if held:
            yield pa.RecordBatch.from_pylist([block_row()], ARROW)

    (docs.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions("doc_id", "text")
     .mapInArrow(blocks_of, SCHEMA).write.option("compression", "none").partitionBy("kind").parquet(path))


def read(spark: SparkSession, path: str, unit: str = "byte") -> DataFrame:
    """Documents of a token folder: shard, seq, doc_id, start, n_tokens, ids (little-endian unsigned 32-bit), ids_crc32.

    Each block is unpacked where it is read; only documents that cross a block
    border carry their ids through the shuffle.  `ids` is null for those read whole
    from one block: use `read_ids` for the ids themselves.
    """
    return _assemble(spark, path, unit, keep_ids=False).drop("ids")


def read_ids(spark: SparkSession, path: str, unit: str = "byte") -> DataFrame:
    return _assemble(spark, path, unit, keep_ids=True)


def _assemble(spark: SparkSession, path: str, unit: str, keep_ids: bool) -> DataFrame:
    folder = spark.read.schema(SCHEMA).parquet(path)
    blocks = folder.filter("kind = 'block'").select("shard", "n_ids", "planes", "docs")

    def parts_of(batches):
        for batch in batches:
            for row in batch.to_pylist():
                raw = memoryview(unpack(row["planes"], row["n_ids"], unit).astype("<u4").tobytes())
                at, out = 0, []
                for d in row["docs"]:
                    piece = raw[4 * at:4 * (at + d["ids"])]
                    at += d["ids"]
                    whole = d["part"] == 0 and d["parts_end"]
                    out.append((row["shard"], d["seq"], d["doc_id"], d["local"], d["n_tokens"], d["part"],
                                zlib.crc32(piece) if whole else None, bytes(piece) if keep_ids or not whole else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), READ.types, strict=True)], schema=READ)

    parts = blocks.mapInArrow(parts_of, "shard int, seq long, doc_id long, local long, n_tokens long, part int, crc long, ids binary")
    pieces = F.array_sort(F.collect_list(F.when(F.col("ids").isNotNull(), F.struct("part", "ids"))))
    docs = (parts.groupBy("shard", "seq")
            .agg(F.first("doc_id").alias("doc_id"), F.first("local").alias("local"), F.first("n_tokens").alias("n_tokens"),
                 F.max("crc").alias("crc"), pieces.alias("pieces"))
            .withColumn("ids", F.expr("aggregate(pieces, cast('' as binary), (a, p) -> concat(a, p.ids))"))
            .withColumn("crc", F.coalesce("crc", F.crc32("ids"))))
    return (docs.join(shard_bases(folder), "shard")
            .select("shard", "seq", "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens",
                    F.col("crc").alias("ids_crc32"), "ids"))


def shard_bases(folder: DataFrame) -> DataFrame:
    """Ids in all shards before each: one row per shard, so the running sum is small."""
    from pyspark.sql import Window

    totals = folder.filter("kind = 'doc'").groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2, unit: str = "byte") -> DataFrame:
    """Writes the token folder into the shared scratch folder and reads it back."""
    path = scratch(docs.sparkSession, "tokens")
    write(docs, path, tokenizer_path, end_id, unit=unit)
    return read(docs.sparkSession, path, unit)
