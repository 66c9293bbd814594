"""SentencePiece BPE encoding by suffix-array matching, and decoding.

The distinct units (a run of word marks and what follows it; no piece crosses a
unit's border) of a batch of texts are joined into one text.  Its suffix array is
built by prefix doubling, every piece of the vocabulary is binary-searched in it
for the range of its occurrences, and the occurrences become edges (start, length,
score), sorted by position.  Relaxation then runs over all units at once: in each round every
unit joins the neighbouring pair that has the edge of the best score, leftmost first, until no
edge is left.  That is the order in which BPE merges, so the ids are those of the
model itself.  Symbols without a piece become bytes.

A null or empty text has no ids and decodes to an empty text; decoding gives back
any text (a word mark U+2581 in it comes back as the space it stands for).
"""

from __future__ import annotations

import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
KNOWN_UNITS = 400_000
TEXTS_AT_ONCE = 1500
LONG_UNIT = 64
NEVER = np.int32(2 ** 31 - 1)


class Model:
    """Pieces that may be matched, sorted; their ids and their order of merging."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
        ids = [i for i in range(size) if i not in special]
        scores = np.array([model.get_score(i) for i in ids])
        self.pieces = [model.id_to_piece(i) for i in ids]
        self.ids = np.array(ids, np.int32)
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        self.id_of = dict(zip(self.pieces, ids, strict=True))
        self.byte_id = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = model.unk_id()
        if self.byte_id[0] == self.unknown:
            raise ValueError("the model has no byte pieces")
        self.longest = max(map(len, self.pieces))
        self.lengths = np.array([len(p) for p in self.pieces], np.int32)
        self.codes = np.zeros((len(ids), self.longest), np.int32)
        for row, piece in zip(self.codes, self.pieces, strict=True):
            row[:len(piece)] = np.frombuffer(piece.encode("utf-32-le"), "<i4") + 1
        self.texts: list[bytes | None] = [None] * size
        for i, piece in zip(ids, self.pieces, strict=True):
            self.texts[i] = piece.replace(MARK, " ").encode()
        for b, i in enumerate(self.byte_id):
            self.texts[i] = bytes([b])
        self.known: dict[str, bytes] = {}


_MODELS: dict[str, Model] = {}


def load(path: str) -> Model:
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first `depth` (or more) symbols, by prefix doubling."""
    ahead = np.concatenate([codes, np.zeros(2, codes.dtype)])
    rank, width = (ahead[:-2] << 42) | (ahead[1:-1] << 21) | ahead[2:], 3  # three symbols fit one number
    order = np.argsort(rank)
    while True:
        ordered = rank[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(len(codes), np.int64)
        rank[order] = new
        if width >= depth or new[-1] == len(codes) - 1:
            return order
        behind = np.zeros(len(codes), np.int64)
        behind[:max(0, len(codes) - width)] = rank[width:] + 1
        rank = rank * (len(codes) + 1) + behind
        order = np.argsort(rank)
        width *= 2


def occurrences(codes: np.ndarray, order: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Places of every piece in the suffix array: first, and one past the last, all pieces searched in step."""
    tail = np.concatenate([codes, np.zeros(model.longest, codes.dtype)])
    bounds = []
    for upper in (False, True):
        lo = np.zeros(len(model.pieces), np.int64)
        hi = np.full(len(model.pieces), len(order), np.int64)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            at = order[mid]
            less = np.zeros(len(open_), bool)   # suffix before the piece (or, for the upper bound, not after it)
            equal = np.ones(len(open_), bool)
            piece, length = model.codes[open_], model.lengths[open_]
            for k in range(model.longest):
                inside = equal & (k < length)
                if not inside.any():
                    break
                here = tail[at + k]
                less |= inside & (here < piece[:, k])
                equal &= ~inside | (here == piece[:, k])
            right = less | equal if upper else less
            lo[open_[right]] = mid[right] + 1
            hi[open_[~right]] = mid[~right]
        bounds.append(lo)
    return bounds[0], bounds[1]


def edges(codes: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(key, piece) of all occurrences of two symbols or more; key = position * width + length, ascending."""
    order = suffix_array(codes, model.longest)
    first, last = occurrences(codes, order, model)
    counts = np.where(model.lengths > 1, last - first, 0)
    piece = np.repeat(np.arange(len(counts)), counts)
    offset = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
    position = order[first[piece] + offset]
    key = position * (model.longest + 1) + model.lengths[piece]
    by = np.argsort(key)
    return key[by], piece[by]


def learn(units: list[str], model: Model) -> None:
    """Adds the ids of `units` to what the model knows."""
    text = "\x00".join(units) + "\x00"
    sizes = np.fromiter(map(len, units), np.int64, len(units))
    begins = np.cumsum(sizes + 1) - sizes - 1
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<i4").astype(np.int64) + 1
    codes[begins + sizes] = 0
    key, piece = edges(codes, model)
    width = model.longest + 1
    table = np.full(len(codes) * width, -1, np.int32)
    table[key] = piece
    is_short = sizes <= LONG_UNIT
    start, stop, unit = relax(begins[is_short], sizes[is_short], table, width, model.rank)
    symbols = [(start, stop, np.flatnonzero(is_short)[unit])]
    for u in np.flatnonzero(~is_short).tolist():
        start, stop = relax_long(int(begins[u]), int(sizes[u]), table, width, model.rank)
        symbols.append((start, stop, np.full(len(start), u)))
    start, stop, unit = (np.concatenate(x) for x in zip(*symbols, strict=True))
    whole = stop - start > 1
    ids = np.full(len(start), -1, np.int64)
    ids[whole] = model.ids[table[start[whole] * width + (stop - start)[whole]]]
    single = np.flatnonzero(~whole)
    chars = codes[start[single]] - 1
    values, at = np.unique(chars, return_inverse=True)
    ids[single] = np.array([model.id_of.get(chr(c), -1 - c) for c in values.tolist()], np.int64)[at]
    order = np.lexsort((start, unit))
    ids, unit = ids[order], unit[order]
    cuts = np.searchsorted(unit, np.arange(len(units) + 1)).tolist()
    strange = set(unit[ids < 0].tolist())
    raw = ids.astype("<u4").tobytes()
    for u, name in enumerate(units):
        if u in strange:
            out: list[int] = []
            for i in ids[cuts[u]:cuts[u + 1]].tolist():
                out.extend([i] if i >= 0 else [model.byte_id[b] for b in chr(-1 - i).encode("utf-8", "replace")])
            model.known[name] = np.array(out, "<u4").tobytes()
        else:
            model.known[name] = raw[4 * cuts[u]:4 * cuts[u + 1]]


def relax(begins: np.ndarray, sizes: np.ndarray, table: np.ndarray, width: int, rank: np.ndarray):
    """Symbols (start, stop, unit) left when no neighbouring pair has an edge; one merge per unit and round."""
    unit = np.repeat(np.arange(len(begins)), sizes)
    start = np.arange(len(unit)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begins[unit] if len(unit) else np.zeros(0, np.int64)
    stop = start + 1
    done = []
    while len(start) > 1:
        length = stop[1:] - start[:-1]
        fits = (unit[1:] == unit[:-1]) & (length < width)
        found = np.where(fits, table[start[:-1] * width + np.where(fits, length, 0)], -1)
        cost = np.where(found >= 0, rank[found], NEVER)
        cost = np.append(cost, NEVER)
        heads = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        least = np.minimum.reduceat(cost, heads)
        counts = np.diff(np.append(heads, len(unit)))
        if (least == NEVER).any():  # finished units leave
            over = np.repeat(least == NEVER, counts)
            done.append((start[over], stop[over], unit[over]))
            start, stop, unit, cost = start[~over], stop[~over], unit[~over], cost[~over]
            least, counts = least[least != NEVER], counts[least != NEVER]
            if not len(start):
                break
            heads = np.cumsum(counts) - counts
        wanted = np.where(cost == np.repeat(least, counts), np.arange(len(cost)), len(cost))
        left = np.minimum.reduceat(wanted, heads)
        stop[left] = stop[left + 1]
        keep = np.ones(len(start), bool)
        keep[left + 1] = False
        start, stop, unit = start[keep], stop[keep], unit[keep]
    done.append((start, stop, unit))
    return tuple(np.concatenate(x) for x in zip(*done, strict=True))


def relax_long(begin: int, size: int, table: np.ndarray, width: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for one long unit, with a heap of pairs: its time grows with size * log(size)."""
    stop = list(range(1, size + 1))
    before = list(range(-1, size - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(left: int) -> None:
        if left < 0 or stop[left] >= size:
            return
        end = stop[stop[left]]
        if end - left < width:
            piece = table[(begin + left) * width + end - left]
            if piece >= 0:
                heapq.heappush(heap, (int(rank[piece]), left, end))

    for i in range(size):
        offer(i)
    while heap:
        _, left, end = heapq.heappop(heap)
        middle = stop[left]
        if middle < 0 or middle >= size or stop[middle] != end:
            continue
        stop[left] = end
        stop[middle] = -1
        if end < size:
            before[end] = left
        offer(before[left])
        offer(left)
    starts = [i for i in range(size) if stop[i] >= 0]
    return np.array(starts) + begin, np.array([stop[i] for i in starts]) + begin


def encode(texts: list[str | None], model: Model) -> list[np.ndarray]:
    if len(model.known) > KNOWN_UNITS:
        model.known.clear()
    units = [UNIT.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
    found = [list(map(model.known.get, u)) for u in units]
    new = list({u for us, ids in zip(units, found, strict=True) if None in ids for u, i in zip(us, ids, strict=True) if i is None})
    if new:
        learn(new, model)
        found = [[model.known[u] if i is None else i for u, i in zip(us, ids, strict=True)] for us, ids in zip(units, found, strict=True)]
    return [np.frombuffer(b"".join(f), "<u4") for f in found]


def decode(ids: np.ndarray, model: Model) -> str:
    """The text of `ids`; the space that encoding puts in front is taken off."""
    text = b"".join([model.texts[i] or b"" for i in ids.tolist()])
    return text[text[:1] == b" ":].decode("utf-8", "replace")


OUT = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()),
                 ("n_decoded", pa.int64()), ("decoded", pa.string()), ("same", pa.bool_())])


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, ids (little-endian unsigned 32-bit), n_decoded, decoded, same: one row per row of `docs`.

    `same` says whether the decoded text equals the source.  Row by row: no shuffle.
    """
    def encoded(batches):
        model = load(model_path)
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(k, TEXTS_AT_ONCE)
                texts = part.column("text").to_pylist()
                ids = encode(texts, model)
                back = [decode(i, model) for i in ids]
                raw = [i.tobytes() for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(i) for i in ids], pa.int64()), pa.array(map(zlib.crc32, raw), pa.int64()),
                     pa.array(raw, pa.binary()), pa.array(map(len, back), pa.int64()), pa.array(back, pa.string()),
                     pa.array([b == (t or "") for b, t in zip(back, texts, strict=True)], pa.bool_())], schema=OUT)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        encoded, "doc_id long, n_pieces long, ids_crc32 long, ids binary, n_decoded long, decoded string, same boolean")
