"""Personal data: plain and disguised e-mail addresses, IPv4 addresses, payment cards and phone numbers.

`base_spans` finds what stands in the text as it is.  `spans` adds what is
disguised: transducers rewrite homoglyphs, spelled digits and at/dot words into
plain characters and keep, for each character they put out, the source characters
it came from.  The same detectors run on the rewritten text and their spans are
mapped back.  A found span is added unless a base span already holds all of it.

Offsets count code points, the end is exclusive.  Null and empty texts have no spans.
Work is linear in the text: no detector starts twice in one run of its characters.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# The wanted patterns.  The e-mail one is split at its @ so that a
# long run of letters is not tried from each of its characters.
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("аесорхуіјѕԁһԛԝкмтвнАВЕКМНОРСТХУІЈЅαοινρτκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
                      "aecopxyijsdhqwkmtbhABEKMHOPCTXYIJSaoivptkABEZHIKMNOPTYX", strict=True))
LOOKALIKES |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}  # full-width forms
LOOKALIKES |= {chr(first + d): str(d) for first in (0x660, 0x6F0, 0x966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6)
               for d in range(10)}
LOOKALIKES |= {"․": ".", "。": ".", "‐": "-", "‑": "-", "−": "-", "–": "-", " ": " ", " ": " "}
UNSEEN = "­​‌‍⁠﻿"
STRANGE = re.compile("[" + re.escape("".join(LOOKALIKES)) + UNSEEN + "]")

NUMBERS = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
           "eight": "8", "nine": "9"}
SPELLED = "(?:" + "|".join(NUMBERS) + ")"
RUN = re.compile(rf"\b{SPELLED}\b(?:(?:[ ,]{{1,2}}|-)(?:{SPELLED}|[0-9])\b)+", re.I)
SPELLED_WORD = re.compile(rf"{SPELLED}|[0-9]", re.I)
PLUS = re.compile(rf"\bplus[ -](?={SPELLED}\b|[0-9])", re.I)
BRACKETED_AT = re.compile(r"\s{0,3}(?:\[\s?(?:at|@)\s?\]|\(\s?(?:at|@)\s?\)|\{\s?(?:at|@)\s?\}|<\s?(?:at|@)\s?>|_at_)\s{0,3}", re.I)
BRACKETED_DOT = re.compile(r"\s{0,3}(?:\[\s?(?:dot|\.)\s?\]|\(\s?(?:dot|\.)\s?\)|\{\s?(?:dot|\.)\s?\}|<\s?(?:dot|\.)\s?>|_dot_)\s{0,3}", re.I)
BARE_AT = re.compile(r"(?<=[A-Za-z0-9._%+-])( at |\s@\s?|@\s)(?=[A-Za-z0-9-]{1,63}(?:\s?\.\s?|\s?dot\s?| dot )[A-Za-z0-9])", re.I)
BARE_DOT = re.compile(r"(?<=[A-Za-z0-9])( dot )(?=[A-Za-z0-9])", re.I)
LONE = re.compile(rf"(?<![A-Za-z0-9]){SPELLED}(?=\s?(?:\.|dot )\s?(?:[0-9]|{SPELLED}))|(?<=[0-9.] ){SPELLED}(?![A-Za-z])", re.I)
AFTER_DOT = re.compile(rf"(?<=[0-9]\.){SPELLED}(?![A-Za-z])", re.I)
# What each transducer needs, so that most texts are left at once; PLUS needs its own word.
GATES = [(("@", "at"), BRACKETED_AT), ((".", "dot"), BRACKETED_DOT), (tuple(NUMBERS), RUN), (tuple(NUMBERS), LONE), ((" dot ",), BARE_DOT),
         (tuple(NUMBERS), AFTER_DOT), ((" at ", "@"), BARE_AT), (("plus",), PLUS)]
DOTTED = re.compile(r"[A-Za-z0-9-]+((?:\.[A-Za-z0-9-]+)+)")
# Endings by which a bare "at" before an undisguised dot is told from a missing blank ("at noon.then").
ENDING = re.compile(r"com|org|net|edu|gov|mil|int|info|biz|name|pro|app|dev|xyz|online|site|shop|tech|cloud|email|example|test|invalid|localhost"
                    r"|[a-z]{2}")


class Rewritten:
    """A text with, for each of its characters, where it begins and ends in the source."""

    def __init__(self, text: str) -> None:
        self.text, self.changed = text, []
        # Pieces: place here, place in the source, width of one character in the source (None: as wide as the piece).
        self.at, self.source, self.copied, self.stop = [0], [0], [True], [len(text)]

    def replace(self, pattern: re.Pattern, by) -> None:
        """`by` maps a match to its replacement; all of it stands for all of the match."""
        pieces, out, last, place = [], [], 0, 0
        for m in pattern.finditer(self.text):
            new = by(m)
            if new is None:
                continue
            pieces.append((place, last, m.start(), None))
            out.append(self.text[last:m.start()])
            place += m.start() - last
            pieces.append((place, m.start(), m.end(), new))
            out.append(new)
            place, last = place + len(new), m.end()
        if not pieces:
            return
        pieces.append((place, last, len(self.text), None))
        out.append(self.text[last:])
        at, source, copied, stop = [], [], [], []
        for place, begin, end, new in pieces:
            if new is None:
                k = bisect_right(self.at, begin) - 1
                while begin < end:
                    until = min(end, self.at[k + 1] if k + 1 < len(self.at) else len(self.text))
                    if until > begin:
                        at.append(place)
                        copied.append(self.copied[k])
                        source.append(self.source[k] + (begin - self.at[k] if self.copied[k] else 0))
                        stop.append(self.stop[k])
                        place, begin = place + until - begin, until
                    k += 1
            elif new:
                at.append(place)
                copied.append(False)
                source.append(self.where(begin)[0])
                stop.append(self.where(end - 1)[1])
        self.text, self.at, self.source, self.copied, self.stop = "".join(out), at, source, copied, stop

    def address(self, i: int) -> bool:
        """May the domain at `i` follow a bare "at"?  Plain dots alone need a known ending, in one case."""
        m = DOTTED.match(self.text, i)
        if m is None or not all(self.copied[bisect_right(self.at, k) - 1] for k in range(m.start(1), m.end()) if self.text[k] == "."):
            return True
        last = m[1].rpartition(".")[2]
        return last in (last.lower(), last.upper()) and ENDING.fullmatch(last.lower()) is not None

    def where(self, i: int) -> tuple[int, int]:
        k = bisect_right(self.at, i) - 1
        if self.copied[k]:
            begin = self.source[k] + i - self.at[k]
            return begin, begin + 1
        return self.source[k], self.stop[k]


def changeable(text: str) -> bool:
    """Does a transducer match in `text`?  If none does, none changes it."""
    low = text.lower()
    return any(pattern.search(text) for words, pattern in GATES if any(w in low for w in words))


def rewrite(text: str) -> Rewritten | None:
    """None: there is nothing in `text` that a transducer changes."""
    strange = STRANGE.search(text) is not None
    if not strange and not changeable(text):
        return None
    new = Rewritten(text)
    if strange:
        new.replace(STRANGE, lambda m: LOOKALIKES.get(m[0], ""))
    new.replace(BRACKETED_AT, lambda m: "@")
    new.replace(BRACKETED_DOT, lambda m: ".")
    new.replace(RUN, lambda m: "".join(NUMBERS.get(w.lower(), w) for w in SPELLED_WORD.findall(m[0])))
    new.replace(LONE, lambda m: NUMBERS.get(m[0].lower()))
    new.replace(BARE_DOT, lambda m: ".")
    new.replace(AFTER_DOT, lambda m: NUMBERS.get(m[0].lower()))
    new.replace(BARE_AT, lambda m: "@" if m[0].lower() != " at " or new.address(m.end()) else None)
    new.replace(PLUS, lambda m: "+")
    return None if new.text == text else new


def detect(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end): leftmost non-overlapping matches per kind that pass the kind's test."""
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in LOCAL:
            begin -= 1
        tail = DOMAIN.match(text, at) if begin < at else None
        if tail:
            found.append(("email", begin, tail.end()))
        free = tail.end() if tail else at + 1
        at = text.find("@", free)
    if not DIGIT.search(text):
        return found
    found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p[-4:]) <= 255 and (len(p) < 5 or not p[:-3].strip("0")) for p in m[0].split("."))]
    found += [("card", m.start(), m.end()) for m in CARD.finditer(text) if luhn(m[0])]
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return found


def luhn(text: str) -> bool:
    digits = [int(c) for c in text if "0" <= c <= "9"]
    if not 14 <= len(digits) <= 19:
        return False
    doubled = [d * 2 - 9 * (d > 4) for d in digits[-2::-2]]
    return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def all_spans(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base, base and added), each by start, then kind."""
    if not text:
        return [], []
    base = ordered(detect(text))
    new = rewrite(text)
    if new is None:
        return base, base
    starts, reach = [b for _, b, _ in base], list(accumulate((e for _, _, e in base), max))
    added = set()
    for kind, begin, end in detect(new.text):
        begin, end = new.where(begin)[0], new.where(end - 1)[1]
        before = bisect_right(starts, begin)
        if not before or reach[before - 1] < end:  # no base span holds it
            added.add((kind, begin, end))
    return base, ordered([*base, *added])


def joined(spans) -> str:
    return ",".join(f"{kind}:{begin}:{end}" for kind, begin, end in spans)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added: one row per row of `docs`."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for text in frame["text"]:
                base, everything = all_spans(text)
                kinds = [kind for kind, _, _ in base]
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(),
                             joined(everything), len(everything) - len(base)))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])
            out.insert(0, "doc_id", frame["doc_id"].astype("Int64").to_numpy())
            yield out

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(
        found, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redacted(text: str | None) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by <KIND> of the first of them."""
    if not text:
        return text
    _, spans = all_spans(text)
    if not spans:
        return text
    out, last, until, kind = [], 0, -1, ""
    for name, begin, end in [*spans, ("", len(text) + 1, 0)]:
        if begin < until:
            until = max(until, end)
            continue
        if until >= 0:
            out.append(f"<{kind.upper()}>")
            last = until
        out.append(text[last:begin])
        until, kind = end, name
    return "".join(out)


def redact(text: Column) -> Column:
    def redact_pii(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([redacted(t) for t in texts], dtype=object)

    return F.pandas_udf(redact_pii, "string")(text)
