"""Fuzzy search for short license notices.

A text is reduced to its words (A-Z lower-cased, single spaces). A notice that
may differ by k edits is split into k + 1 pieces: whatever the edits, one piece
stands unchanged (pigeonhole). One pass of an Aho-Corasick automaton over all
pieces of all notices finds these seeds; around each seed lies the only window
where its notice can be, and there the regex library's bounded-error matching
verifies it, counts the edits and gives the span. Matches start and end at
words. Words that tell one licence from another (``EXACT``) must stand as they
are; edits are allowed in the rest of the notice. Base phrases are exact and are
found by their words in a row.

The number of words of a text and the spans cover the whole text. Each window
is as long as its notice and the edits, and is verified once, so the work grows
with the number of seeds, however close together the notices stand. Of
overlapping matches of one notice the one with the fewest edits stays, then the
first; of overlapping matches with different labels those with more edits go.

Defined results: a null or empty text has no words, places or labels and score
0. Rows are independent; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterable, Sequence
from typing import NamedTuple

import regex
from pyspark.sql import DataFrame

from .common import annotate

#: Exact phrases and their labels (fixed values of the contract).
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Short notices in their reduced form and their labels.
NOTICES = (
    ("licensed under cc by nc", "cc-by-nc"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("creative commons attribution", "cc-by"),
    ("licensed under the gnu general public license", "gpl"),
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("licensed under the apache license version", "apache"),
    ("mit license", "mit"),
    ("permission is hereby granted free of charge", "mit"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("released into the public domain", "public-domain"),
    ("all rights reserved", "reserved"),
)

#: Words of a notice that must stand exactly, at its start or its end: an edit in them names another licence.
EXACT = {"licensed under cc by nc": "cc by nc", "licensed under cc by sa": "cc by sa", "mit license": "mit"}

#: Bytes between words become spaces, A-Z become a-z; other bytes stay.
REDUCE = bytes((b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32)
               for b in range(256))


class Span(NamedTuple):
    label: str
    start_word: int
    end_word: int      # exclusive
    edits: int
    score: float
    matched: str


def edits_allowed(notice: str) -> int:
    """About one edit in ten characters, one at least."""
    return max(1, len(notice) // 10)


def pattern(notice: str, k: int, exact: str = "") -> str:
    """The notice with up to ``k`` edits outside of ``exact``, the best match first."""
    plain = lambda t: regex.escape(t, literal_spaces=True)
    fuzzy = lambda t: f"(?:{plain(t)}){{e<={k}}}"
    if not exact:
        body = fuzzy(notice)
    elif notice.startswith(exact + " "):
        body = plain(exact) + " " + fuzzy(notice[len(exact) + 1:])
    elif notice.endswith(" " + exact):
        body = fuzzy(notice[:-len(exact) - 1]) + " " + plain(exact)
    else:
        raise ValueError(f"{exact!r} neither begins nor ends {notice!r}")
    return rf"(?b)(?<![^ ]){body}(?![^ ])"


def pieces(notice: str, k: int) -> list[tuple[int, str]]:
    """``k + 1`` pieces of near-equal length with their offsets."""
    cuts = [len(notice) * i // (k + 1) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


def reduce_text(text: str | None) -> list[str]:
    """Words of a text: maximal runs of a-z, 0-9 and characters beyond ASCII."""
    return text.encode().translate(REDUCE).decode().split(" ") if text else []


def word_starts(joined: str) -> list[int]:
    """Where each word of a reduced text begins."""
    starts, at = [0], -1
    while (at := joined.find(" ", at + 1)) >= 0:
        starts.append(at + 1)
    return starts


def whole_words(joined: str, starts: Sequence[int], a: int, b: int, most: int) -> tuple[int, int]:
    """A window moved out to words; a word longer than ``most`` is left out, it is in no match."""
    at = bisect_right(starts, a) - 1
    if a - starts[at] > most:
        at += 1
    first = starts[at] if at < len(starts) else len(joined)
    last = joined.find(" ", b, b + most)
    if last < 0:
        last = len(joined) if len(joined) <= b + most else max(first, joined.rfind(" ", 0, b))
    return first, last


def best_apart(matches: Iterable[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Matches ``(edits, start, end)`` of one notice that do not overlap, fewest edits
    first, then the first; in order of place. Overlaps are sought in runs of
    matches that touch each other."""
    out: list[tuple[int, int, int]] = []
    ordered = sorted(matches, key=lambda m: m[1:])
    run: list[tuple[int, int, int]] = []

    def settle() -> None:
        kept: list[tuple[int, int]] = []
        for edits, s, e in sorted(run, key=lambda m: (m[0], m[1], m[2])):
            at = bisect_right(kept, (s, e))
            if (at == 0 or kept[at - 1][1] <= s) and (at == len(kept) or e <= kept[at][0]):
                insort(kept, (s, e))
                out.append((edits, s, e))

    reach = -1
    for m in ordered:
        if run and m[1] >= reach:
            settle()
            run = []
        run.append(m)
        reach = max(reach, m[2])
    if run:
        settle()
    return sorted(out, key=lambda m: m[1])


def beaten(spans: Sequence[Span]) -> list[bool]:
    """Which spans overlap one of another label with fewer edits. By start, only
    spans that begin within the longest span's length can reach another."""
    order = sorted(range(len(spans)), key=lambda i: spans[i].start_word)
    longest = max((x.end_word - x.start_word for x in spans), default=0)
    hit = [False] * len(spans)
    for place, i in enumerate(order):
        x = spans[i]
        for step in (-1, 1):
            j = place + step
            while 0 <= j < len(order):
                y = spans[order[j]]
                if y.start_word <= x.start_word - longest or y.start_word >= x.end_word:
                    break
                if y.end_word > x.start_word and y.label != x.label:
                    hit[i] |= y.edits < x.edits
                j += step
    return hit


class Scanner:
    def __init__(self, notices: Sequence[tuple[str, str]] = NOTICES, phrases: Sequence[tuple[str, str]] = PHRASES):
        import ahocorasick
        self.notices, self.phrases = list(notices), list(phrases)
        self.allowed = [edits_allowed(n) for n, _ in self.notices]
        self.verify = [regex.compile(pattern(n, k, EXACT.get(n, ""))) for (n, _), k in zip(self.notices, self.allowed)]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, ((n, _), k) in enumerate(zip(self.notices, self.allowed)):
            for offset, piece in pieces(n, k):
                seeds.setdefault(piece, []).append((i, offset))
        self.seeds = ahocorasick.Automaton()
        for piece, places in seeds.items():
            self.seeds.add_word(piece, (len(piece), places))
        self.seeds.make_automaton()

    def base(self, joined: str, starts: Sequence[int]) -> list[tuple[int, str]]:
        """``(word, label)`` of every place where a phrase's words stand in a row."""
        padded = f" {joined} "
        out = []
        for phrase, label in self.phrases:
            target, at = f" {phrase} ", -1
            while (at := padded.find(target, at + 1)) >= 0:
                out.append((bisect_right(starts, at) - 1, label))
        return out

    def fuzzy(self, joined: str) -> list[Span]:
        """Verified matches, in order of notice and place."""
        return self.spans(joined, word_starts(joined))

    def spans(self, joined: str, starts: Sequence[int]) -> list[Span]:
        windows: dict[int, dict[int, None]] = {}
        for end, (size, places) in self.seeds.iter(joined):
            at = end + 1 - size
            for i, offset in places:
                windows.setdefault(i, {})[at - offset] = None  # where the notice would begin without edits
        out = []
        for i in sorted(windows):
            notice, label = self.notices[i]
            k, n = self.allowed[i], len(notice)
            found = set()
            for begin in windows[i]:
                a, b = whole_words(joined, starts, max(0, begin - k), begin + n + k, n)
                if m := self.verify[i].search(joined, a, b):
                    found.add((sum(m.fuzzy_counts), m.start(), m.end()))
            for edits, s, e in best_apart(found):
                first = bisect_right(starts, s) - 1
                out.append(Span(label, first, bisect_right(starts, e - 1), edits, 1 - edits / n, joined[s:e]))
        return [x for x, hit in zip(out, beaten(out)) if not hit]

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, str]], list[Span]]:
        """Number of words, base places, fuzzy spans."""
        found = [w for w in reduce_text(text) if w]
        joined = " ".join(found)
        starts = word_starts(joined)
        return len(found), self.base(joined, starts), self.spans(joined, starts) if found else []


_LOADED: dict[tuple, Scanner] = {}


def scanner(notices, phrases) -> Scanner:
    key = (tuple(notices), tuple(phrases))
    if key not in _LOADED:
        _LOADED[key] = Scanner(notices, phrases)
    return _LOADED[key]


FIELDS = ("n_words bigint, base array<struct<word:bigint,label:string>>, "
          "spans array<struct<label:string,start_word:bigint,end_word:bigint,edits:bigint,score:double,matched:string>>")


def search(docs: DataFrame, *, notices: Sequence[tuple[str, str]] = NOTICES,
           phrases: Sequence[tuple[str, str]] = PHRASES, text_col: str = "text") -> DataFrame:
    """``row`` (the input row) and struct ``found``: ``n_words``, ``base`` places and fuzzy ``spans``."""
    notices, phrases = tuple(notices), tuple(phrases)

    def kernel(texts):
        found = [scanner(notices, phrases).scan(t) for t in texts]
        return ([n for n, _, _ in found], [[{"word": w, "label": x} for w, x in b] for _, b, _ in found],
                [[s._asdict() for s in spans] for _, _, spans in found])

    return annotate(docs, kernel, FIELDS, text_col, "found")
