"""The Ratcliff-Obershelp ratio of many pairs of texts at once, in numpy.

The ratio takes the longest block two texts share, then does the same left and right of it.  Here every open
stretch of every pair is searched in one pass: row by row of a table of common-ending lengths, all pairs side by
side.  Of equally long blocks the first in the first text counts, then the first in the second one, as in `difflib`.

Texts of 200 letters or more go to `difflib` itself, which leaves out frequent letters there.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np

LONG = 200  # from here on difflib has rules of its own
CELLS = 1 << 21  # letters of one side held at a time


def ratios(first: list[str | None], second: list[str | None], least: float = 0.0) -> np.ndarray:
    """Ratio per pair, as float64.  NaN where a text is None.

    Pairs that cannot reach `least` may get any upper bound of their ratio below `least` instead.
    """
    out = np.full(len(first), np.nan)
    sizes = np.array([[-1 if a is None else len(a), -1 if b is None else len(b)] for a, b in zip(first, second, strict=True)])
    sizes = sizes.reshape(-1, 2)
    known = (sizes >= 0).all(1)
    total = sizes.sum(1)
    out[known & (total == 0)] = 1.0
    small = known & (total > 0) & (sizes.max(1, initial=0) < LONG)
    matcher = SequenceMatcher(None)
    for i in np.flatnonzero(known & (sizes.max(1, initial=0) >= LONG)):
        matcher.set_seqs(first[i], second[i])
        bound = matcher.real_quick_ratio()
        out[i] = bound if bound < least else matcher.ratio()
    rows = np.flatnonzero(small)
    rows = rows[np.lexsort((sizes[rows, 1], sizes[rows, 0]))]  # texts of like lengths share a table
    step = max(1, CELLS // LONG)
    for k in range(0, len(rows), step):
        some = rows[k:k + step]
        out[some] = _short([first[i] for i in some], [second[i] for i in some], sizes[some], least)
    return out


def _letters(texts: list[str], lengths: np.ndarray, pad: int) -> np.ndarray:
    """One row of code points per text, filled up with `pad`."""
    table = np.full((len(texts), max(1, int(lengths.max(initial=0)))), pad, np.int32)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)
    table[np.arange(table.shape[1]) < lengths[:, None]] = codes
    return table


def _short(first: list[str], second: list[str], sizes: np.ndarray, least: float) -> np.ndarray:
    total = sizes.sum(1)
    bound = 2.0 * sizes.min(1) / total
    a, b = _letters(first, sizes[:, 0], -1), _letters(second, sizes[:, 1], -2)
    open_ = np.flatnonzero(bound >= least)
    if least > 0:
        bound[open_] = 2.0 * _common_letters(a[open_], b[open_]) / total[open_]
        open_ = open_[bound[open_] >= least]
    matched = _matched(a[open_], b[open_], sizes[open_])
    bound[open_] = 2.0 * matched / total[open_]
    return bound


def _common_letters(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Letters shared regardless of order: no block can hold more."""
    both = np.concatenate([a, b], 1)
    side = np.concatenate([np.ones(a.shape, np.int8), -np.ones(b.shape, np.int8)], 1)
    order = np.argsort(both, 1, kind="stable")
    both, side = np.take_along_axis(both, order, 1), np.take_along_axis(side, order, 1)
    real = both >= 0
    # Runs of one letter: the surplus of either side is not shared.
    new = np.ones(both.shape, bool)
    new[:, 1:] = both[:, 1:] != both[:, :-1]
    new = new.ravel()
    if not len(new):
        return np.zeros(len(a), np.int64)
    starts = np.flatnonzero(new)
    surplus = np.abs(np.add.reduceat(np.where(real, side, 0).ravel().astype(np.int64), starts))
    unshared = np.bincount(starts // both.shape[1], surplus, minlength=len(a))
    return (real.sum(1) - unshared.astype(np.int64)) // 2


def _matched(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Letters in matching blocks, per pair."""
    found = np.zeros(len(a), np.int64)
    pair = np.arange(len(a))
    low_a, high_a = np.zeros(len(a), np.int64), sizes[:, 0].astype(np.int64)
    low_b, high_b = np.zeros(len(a), np.int64), sizes[:, 1].astype(np.int64)
    while len(pair):
        at_a, at_b, size = _longest(a, b, pair, low_a, high_a, low_b, high_b)
        hit = size > 0
        pair, at_a, at_b, size = pair[hit], at_a[hit], at_b[hit], size[hit]
        found += np.bincount(pair, size, minlength=len(found)).astype(np.int64)
        pair = np.concatenate([pair, pair])
        low_a, high_a = np.concatenate([low_a[hit], at_a + size]), np.concatenate([at_a, high_a[hit]])
        low_b, high_b = np.concatenate([low_b[hit], at_b + size]), np.concatenate([at_b, high_b[hit]])
        left = (low_a < high_a) & (low_b < high_b)
        pair, low_a, high_a, low_b, high_b = pair[left], low_a[left], high_a[left], low_b[left], high_b[left]
    return found


def _longest(a, b, pair, low_a, high_a, low_b, high_b):
    """Start in either text and length of the first longest common block of every stretch."""
    out_a, out_b, out_size = (np.zeros(len(pair), np.int64) for _ in range(3))
    # Stretches of like lengths go together, so that little of a table is padding.
    wide = np.maximum(high_a - low_a, high_b - low_b)
    order = np.argsort(wide, kind="stable")
    begin = 0
    while begin < len(order):
        width = int(wide[order[begin]])
        end = int(np.searchsorted(wide[order], max(width + 4, width * 5 // 4), "right"))
        rows = order[begin:end]
        begin = end
        sub_a = _cut(a, pair[rows], low_a[rows], high_a[rows], -1)
        sub_b = _cut(b, pair[rows], low_b[rows], high_b[rows], -2)
        best, end_a, end_b = (np.zeros(len(rows), np.int64) for _ in range(3))
        # A column per stretch: numpy then works along the stretches, whatever their length.
        sub_a, sub_b = np.ascontiguousarray(sub_a.T), np.ascontiguousarray(sub_b.T)
        before = np.zeros((len(sub_b) + 1, len(rows)), np.int16)
        for i in range(len(sub_a)):
            now = np.zeros_like(before)
            np.add(before[:-1], 1, out=now[1:])
            now[1:] *= sub_a[i] == sub_b
            longest = now.max(0)
            better = np.flatnonzero(longest > best)
            if len(better):
                best[better], end_a[better] = longest[better], i + 1
                end_b[better] = now[:, better].argmax(0)
            before = now
        out_size[rows] = best
        out_a[rows], out_b[rows] = low_a[rows] + end_a - best, low_b[rows] + end_b - best
    return out_a, out_b, out_size


def _cut(table: np.ndarray, pair: np.ndarray, low: np.ndarray, high: np.ndarray, pad: int) -> np.ndarray:
    places = low[:, None] + np.arange(int((high - low).max(initial=0)))
    inside = places < high[:, None]
    return np.where(inside, table[pair[:, None], np.where(inside, places, 0)], pad)
