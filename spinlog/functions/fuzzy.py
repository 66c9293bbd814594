"""Title similarity: the Ratcliff-Obershelp ratio, and an exact filter before it.

With M matched characters in texts of length a and b, the ratio is 2M/(a+b).
The matched blocks form a common subsequence, so turning one text into the
other deletes a-M and inserts b-M characters.  A deletion breaks at most two of
the a-1 neighbouring pairs and an insertion at most one, so at least
3M-a-b-1 pairs are shared.  From ratio >= 0.85 follows M >= 17(a+b)/40, which
fixes a least number of shared pairs for each length: below it no partner of
any length can qualify.  If two sets share s elements, then in any common order
the first |A|-s+1 of one and the first |B|-s+1 of the other have one in common.
These `signatures` are equi-join keys: no true match is lost, and texts without
a rare pair in common never meet.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from spinlog.functions.blocks import ratios

WEAK_RATIO = 0.85

# Letters from frequent to rare; any order is exact, this one keeps groups small.
_FREQUENT = " etaoinshrdlcumwfgypbvkjxqz"


def _least_matched(total: Column) -> Column:
    """ceil(17 * total / 40)."""
    return ((total * 17 + 39) / 40).cast("int")


def least_shared_pairs(length: Column) -> Column:
    """The least 3M-T-1 over all partner lengths that can reach the ratio.

    Partners are between 17/23 and 23/17 of the length; 3M-T-1 as a function of
    T moves in steps, so every T is looked at.
    """
    shortest = ((length * 17 + 22) / 23).cast("int")
    longest = (length * 23 / 17).cast("int")
    totals = F.sequence(length + shortest, length + longest)
    return F.array_min(F.transform(totals, lambda t: _least_matched(t) * 3 - t - 1))


def signatures(text: Column) -> Column:
    """Array of join keys of a text; texts that qualify as similar share one."""
    length = F.length(text)
    pairs = F.transform(F.sequence(F.lit(1), length - 1), lambda i: F.substring(text, i, F.lit(2)))
    # The k-th repeat of a pair is an element of its own.
    numbered = F.flatten(
        F.transform(
            F.array_distinct(pairs),
            lambda p: F.transform(
                F.sequence(F.lit(1), F.size(F.filter(pairs, lambda q: q == p))),
                lambda k: F.struct(_rarity(p).alias("r"), p.alias("p"), k.alias("k")),
            ),
        )
    )
    keep = length - 1 - F.greatest(least_shared_pairs(length), F.lit(1)) + 1
    chosen = F.slice(F.sort_array(numbered), 1, F.greatest(keep, F.lit(0)))
    keys = F.transform(chosen, lambda s: F.concat(s["p"], s["k"].cast("string")))
    return F.when(length >= 2, keys).otherwise(F.array().cast("array<string>"))


def _rarity(pair: Column) -> Column:
    """Small for rare pairs: minus the places of its letters in the frequency order."""
    places = [F.instr(F.lit(_FREQUENT), F.substring(pair, n, 1)) for n in (1, 2)]
    commonness = [F.when(p == 0, 0).otherwise(F.lit(len(_FREQUENT) + 1) - p) for p in places]
    return commonness[0] + commonness[1]


def length_fits(a: Column, b: Column) -> Column:
    """2*min/(a+b) is the most the ratio can be."""
    return F.least(a, b) * 40 >= (a + b) * 17


def fuzzy_ratio(wanted: Column, found: Column, least: float = 0.0) -> Column:
    """The ratio per pair, a whole Arrow batch at once.  Where it cannot reach `least`, some value below `least`."""

    @F.pandas_udf(DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(ratios(a.tolist(), b.tolist(), least), index=a.index)

    return ratio(wanted, found)
