"""Comparison forms of artist names and titles, as column expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Typographic quotes and dashes and what they compare as.
TYPOGRAPHIC = {
    "‘": "'",
    "’": "'",
    "“": '"',
    "”": '"',
    "–": "-",
    "—": "-",
    "−": "-",
}

_TYPOGRAPHIC = str.maketrans(TYPOGRAPHIC)

# White space as Unicode sees it, plus the four ASCII separators.
_WS = r"[\s\x1c-\x1f]"
_PLAIN = r"^[\x09-\x0d\x20-\x7e]*\z"
_EDGE_SPACE = rf"(?U)\A{_WS}+|{_WS}+\z"


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, _EDGE_SPACE, "")


def _tidy(text: Column) -> Column:
    """Trim, drop one leading "the ", collapse spaces; `text` is lower case."""
    bare = F.regexp_replace(trim_space(text), rf"(?U)\Athe{_WS}+", "")
    return trim_space(F.regexp_replace(bare, rf"(?U){_WS}+", " "))


def fold_letter(letter: str) -> str:
    """Compatibility decomposition without marks, case-folded.  A text's fold is that of its letters in turn."""
    decomposed = unicodedata.normalize("NFKD", letter.translate(_TYPOGRAPHIC))
    return "".join(c for c in decomposed if not unicodedata.combining(c)).casefold()


_HANGUL = ("\uac00", "\ud7a3")  # syllables are taken apart by rule


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, str, list[str]]:
    """Letters that fold to one, with those; letters that fold to nothing last; letters that fold to several, with those."""
    single, gone, several = {}, [], {}
    for code in range(sys.maxunicode + 1):
        letter = chr(code)
        if 0xD800 <= code < 0xE000 or _HANGUL[0] <= letter <= _HANGUL[1]:
            continue
        folded = fold_letter(letter)
        if not folded:
            gone.append(letter)
        elif len(folded) > 1:
            several[letter] = folded
        elif folded != letter:
            single[letter] = folded
    return "".join([*single, *gone]), "".join(single.values()), "".join(several), list(several.values())


def _ranges(letters: str) -> str:
    """A character class of sorted letters."""
    codes = list(map(ord, letters))
    heads = [c for k, c in enumerate(codes) if k == 0 or codes[k - 1] != c - 1]
    tails = [c for k, c in enumerate(codes) if k == len(codes) - 1 or codes[k + 1] != c + 1]
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(heads, tails, strict=True))


def _hangul(letter: Column) -> Column:
    """A syllable's two or three parts, counted from the first of their kind."""
    number = F.conv(F.hex(F.encode(letter, "UTF-16BE")), 16, 10).cast("int") - ord(_HANGUL[0])
    parts = ["".join(chr(first + k) for k in range(n)) for first, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27))]
    ahead, middle, last = (F.floor(number / 588), F.floor(number % 588 / 28), number % 28)
    return F.concat(F.substring(F.lit(parts[0]), ahead.cast("int") + 1, F.lit(1)), F.substring(F.lit(parts[1]), middle.cast("int") + 1, F.lit(1)),
                    F.when(last == 0, "").otherwise(F.substring(F.lit(parts[2]), last, F.lit(1))))


def _fold_unicode(text: Column) -> Column:
    """`fold_letter` over a text, in the JVM.  Runs without a letter that folds to several are translated at once."""
    letters, single, several, folds = _fold_tables()
    stop = "\x01"
    folded = F.split(F.lit(stop.join(folds)), stop)

    def fold(letter: Column) -> Column:
        return (F.when(letter.between(*_HANGUL), _hangul(letter))
                .otherwise(F.coalesce(F.get(folded, F.instr(F.lit(several), letter) - 1), F.translate(letter, letters, single))))

    strange = f"[{_ranges(several)}{_HANGUL[0]}-{_HANGUL[1]}]"

    def run(part: Column) -> Column:
        one_by_one = F.concat_ws("", F.transform(F.split(part, ""), fold))
        return F.when(part.rlike(strange), one_by_one).otherwise(F.translate(part, letters, single))

    # Most letters of most texts are plain: only the runs between are looked up.
    border = r"(?<=[\x00-\x7f])(?=[^\x00-\x7f])|(?<=[^\x00-\x7f])(?=[\x00-\x7f])"
    return F.concat_ws("", F.transform(
        F.split(text, border), lambda part: F.when(part.rlike(r"\A[\x00-\x7f]*\z"), F.lower(part)).otherwise(run(part))))


def normalize_text(text: Column) -> Column:
    folded = F.when(text.rlike(_PLAIN), F.lower(text)).otherwise(_fold_unicode(text))
    return _tidy(F.coalesce(folded, F.lit("")))


_SUFFIX = (
    rf"(?U){_WS}*\([^()]*\){_WS}*\z"  # a last (...)
    rf"|{_WS}*\[[^\[\]]*\]{_WS}*\z"  # a last [...]
    rf"|{_WS}+-{_WS}+[^-]+\z"  # a last " - ..."
)


def strip_suffixes(title: Column) -> Column:
    """Drop bracketed and dashed endings until none is left; never down to nothing.

    Each round removes at least one of ) ] -, so their count bounds the rounds.
    """
    rounds = F.length(F.regexp_replace(title, r"[^)\]-]", ""))
    bare = F.reduce(
        F.sequence(F.lit(0), rounds), title, lambda t, _: trim_space(F.regexp_replace(t, _SUFFIX, ""))
    )
    return F.coalesce(F.nullif(bare, F.lit("")), title)


_FEATURED = rf"(?Usi)\A(.*?)\(?\b(?:feat\.?|featuring|ft\.?){_WS}+([^()\[\]]+?)\)?{_WS}*\z"


def featured(title: Column) -> Column:
    """struct(base, names): a last "feat. X" taken off, its names split."""
    found = title.rlike(_FEATURED)
    base = F.regexp_replace(F.regexp_extract(title, _FEATURED, 1), rf"(?U){_WS}+\z", "")
    parts = F.split(F.regexp_extract(title, _FEATURED, 2), r"(?U),|&|\band\b")
    names = F.filter(F.transform(parts, trim_space), lambda n: n != "")
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(found, base).otherwise(title).alias("base"),
        F.when(found, names).otherwise(none).alias("names"),
    )


def norm_key(artist: Column, title: Column) -> Column:
    return F.concat(normalize_text(artist), F.lit("|"), normalize_text(title))
