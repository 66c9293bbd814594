"""Hashed byte n-grams of a text, as numpy arrays."""

from __future__ import annotations

import numpy as np

STEP, MIX = np.uint32(0x01000193), np.uint32(0x9E3779B1)


def gram_ids(data: np.ndarray, sizes: range, bits: int) -> list[np.ndarray]:
    """One array of buckets per n-gram size, in text order; empty for texts shorter than the size."""
    out, acc = [], data.astype(np.uint32)
    for n in range(2, sizes.stop):
        acc = acc[:-1] * STEP + data[n - 1:] if len(data) >= n else acc[:0]
        if n in sizes:
            out.append(((acc + np.uint32(n)) * MIX) >> np.uint32(32 - bits))
    return out


def padded(text: str | None) -> np.ndarray:
    return np.frombuffer(b" " + (text or "").lower().encode("utf-8", "replace") + b" ", np.uint8)


class Distinct:
    """Keeps the first of equal buckets; the table is reused from text to text and never cleared."""

    def __init__(self, bits: int) -> None:
        self.last = np.zeros(1 << bits, np.int32)

    def __call__(self, buckets: np.ndarray) -> np.ndarray:
        order = np.arange(len(buckets), dtype=np.int32)
        self.last[buckets] = order
        return buckets[self.last[buckets] == order]
