"""Marks of another recording: karaoke, covers, live takes and the like.

A mark found in a catalogue text counts against it unless its root is in the
wanted text.  Both sides become bit masks, so the test is one AND, and rows
with equal masks can be folded together before any join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mark in the catalogue text, root in the wanted text that excuses it.
MARKERS = [
    ("karaoke", "karaoke"),
    ("tribute", "tribute"),
    ("made famous by", "made famous by"),
    ("in the style of", "in the style of"),
    ("originally performed by", "originally performed by"),
    ("sped up", "sped up"),
    ("slowed", "slowed"),
    ("nightcore", "nightcore"),
    ("8d audio", "8d audio"),
    ("instrumental", "instrumental"),
    ("cover", "cover"),
    ("remix", "remix"),
    ("live at", "live"),
    ("live from", "live"),
    ("- live", "live"),
    ("(live)", "live"),
]


def _mask(norm_text: Column, words: list[str]) -> Column:
    bits = [F.when(norm_text.contains(w), 1 << i).otherwise(0) for i, w in enumerate(words)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def found_mask(norm_text: Column) -> Column:
    return _mask(norm_text, [mark for mark, _ in MARKERS])


def excused_mask(norm_wanted: Column) -> Column:
    return _mask(norm_wanted, [root for _, root in MARKERS])


def uncalled_for(found: Column, excused: Column) -> Column:
    return found.bitwiseAND(F.bitwise_not(excused)) != 0


def first_marker(norm_text: Column, norm_wanted: Column) -> Column:
    """The first mark, in the fixed order, that the wanted text does not excuse; else NULL."""
    return F.coalesce(
        *[F.when(norm_text.contains(m) & ~norm_wanted.contains(r), m) for m, r in MARKERS]
    )
