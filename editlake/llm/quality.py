"""Quality rules as a short-circuit cascade.

Base metrics are counted for every text. A text that passes the base check goes
through the rules one by one and stops at the first that rejects it. The rules'
order is estimated first: on a bounded sample every rule judges every text, its
time and its rejections are measured, and rules are ordered by rejections per
second. The order changes the cost only: a text is kept when no rule rejects
it, so the verdict is the same for every order and every sample.

``SAMPLE_ROWS`` bounds the sample (hash-free Bernoulli sample, then a limit);
it is used for the order alone, never for a threshold or a verdict.

Defined results: null or empty text has no words and fails the base check.
Rows are independent; an empty table gives an empty result, and an empty
sample keeps the rules as given.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Numbering, annotate, slices, words

SAMPLE_ROWS = 2000
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
DISTINCT_WINDOW = 1000


class Text:
    """One text; what several rules need is made once."""

    def __init__(self, text: str | None, found: list[str] | None = None):
        self.text = text or ""
        if found is not None:
            self.words = found

    @cached_property
    def words(self) -> list[str]:
        return words(self.text)

    @cached_property
    def n(self) -> int:
        return max(1, len(self.words))


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Text], bool]


def _symbols(t: Text) -> bool:
    return sum(map(t.text.count, SYMBOLS)) > 0.1 * t.n


def _exclaims(t: Text) -> bool:
    return t.text.count("!") > 0.5 * t.n


def _shouts(t: Text) -> bool:
    letters = sum(map(str.isalpha, t.text))
    return sum(map(str.isupper, t.text)) > 0.5 * letters if letters else False


def _word_length(t: Text) -> bool:
    return not 2 <= sum(map(len, t.words)) / t.n <= 15


def distinct_share(found: Sequence[str]) -> float:
    """Mean share of distinct words over consecutive windows of ``DISTINCT_WINDOW``
    words that cover the whole text (the last one ends with it). The share over a
    whole text falls with its length; this one does not. A shorter text is one window."""
    n = len(found)
    if n <= DISTINCT_WINDOW:
        return len(set(found)) / max(1, n)
    starts = [*range(0, n - DISTINCT_WINDOW, DISTINCT_WINDOW), n - DISTINCT_WINDOW]
    return sum(len(set(found[a:a + DISTINCT_WINDOW])) for a in starts) / (len(starts) * DISTINCT_WINDOW)


def _few_distinct(t: Text) -> bool:
    return len(t.words) >= 50 and distinct_share(t.words) < 0.1


def _few_letters(t: Text) -> bool:
    return len(t.words) >= 20 and sum(any(map(str.isalpha, w)) for w in t.words) < 0.6 * t.n


def _same_lines(t: Text) -> bool:
    lines = [x for x in t.text.split("\n") if x.strip()]
    return len(lines) >= 4 and len(set(lines)) < 0.5 * len(lines)


def _stutters(t: Text) -> bool:
    w = t.words
    return len(w) >= 20 and sum(map(str.__eq__, w, w[1:])) > 0.3 * len(w)


#: Thresholds sit far from ordinary prose; texts in any alphabet pass.
RULES = (Rule("symbols", _symbols), Rule("exclaims", _exclaims), Rule("shouts", _shouts),
         Rule("word_length", _word_length), Rule("few_distinct", _few_distinct),
         Rule("few_letters", _few_letters), Rule("same_lines", _same_lines), Rule("stutters", _stutters))


def repeated_words(found: Sequence[Sequence[str]]) -> np.ndarray:
    """Per text: words that lie in a ``WINDOW``-word window found twice or more in that text."""
    n_words = np.fromiter(map(len, found), np.int64, len(found))
    total = int(n_words.sum())
    out = np.zeros(len(found), np.int64)
    if total < WINDOW:
        return out
    number = Numbering()
    w = np.fromiter((i for f in found for i in map(number.__getitem__, f)), np.uint64, total)
    doc = np.repeat(np.arange(len(found)), n_words)
    n = total - WINDOW + 1
    inside = np.flatnonzero(doc[:n] == doc[WINDOW - 1:])
    if not len(inside):
        return out
    h = doc[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(WINDOW):
        h = (h ^ w[k:k + n]) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
    h = h[inside]
    order = np.argsort(h, kind="stable")
    equal = h[order[1:]] == h[order[:-1]]
    a, b = inside[order[:-1][equal]], inside[order[1:][equal]]
    true = doc[a] == doc[b]
    for k in range(WINDOW):
        true &= w[a + k] == w[b + k]
    if true.all():
        repeated = np.unique(np.concatenate([a, b]))
    else:  # two windows share a hash: compare the windows themselves
        maybe = np.unique(np.concatenate([a, b]))
        rows = np.stack([doc[maybe].astype(np.uint64), *[w[maybe + k] for k in range(WINDOW)]], 1)
        _, at, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        repeated = maybe[counts[at.ravel()] > 1]
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, repeated, 1)
    np.add.at(edge, repeated + WINDOW, -1)
    covered = np.cumsum(edge[:total]) > 0
    return np.bincount(doc[covered], minlength=len(found)).astype(np.int64)


def duplicate_lines(text: str | None) -> int:
    """Lines with a word that equal an earlier line."""
    if not text or "\n" not in text:
        return 0
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0
    seen: set[str] = set()
    n = 0
    for line in lines:
        if line in seen:
            n += bool(words(line))
        else:
            seen.add(line)
    return n


BASE_FIELDS = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
               "base_failed boolean")


def base_metrics(texts: Sequence[str | None]) -> tuple[list, list[list[str]]]:
    found = [words(t) for t in texts]
    n_words = np.fromiter(map(len, found), np.int64, len(found))
    repeat = repeated_words(found)
    failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)
    return [n_words, [len("".join(f)) for f in found], [sum(map(t.count, SYMBOLS)) if t else 0 for t in texts],
            [duplicate_lines(t) for t in texts], repeat, failed.tolist()], found


def measure(docs: DataFrame, rules: Sequence[Rule] = RULES, *, text_col: str = "text", rows: int = SAMPLE_ROWS,
            seed: int = 7) -> dict[str, tuple[float, float]]:
    """Per rule its mean seconds and its share of rejections on a bounded sample."""
    total = docs.count()
    if not total:
        return {}
    sample = docs.select(F.col(f"`{text_col}`").alias("text"))
    if total > rows:
        sample = sample.sample(min(1.0, 1.2 * rows / total), seed)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [Text(t) for t in part.column("text").to_pylist()]
                for t in texts:
                    t.words  # noqa: B018  shared by all rules; no rule pays for it
                for rule in rules:
                    began = time.perf_counter()
                    hits = sum(map(rule.rejects, texts))
                    took = time.perf_counter() - began
                    yield pa.RecordBatch.from_pylist([{"rule": rule.name, "s": took, "hits": hits, "n": len(texts)}])

    found = sample.mapInArrow(run, "rule string, s double, hits bigint, n bigint").groupBy("rule").agg(
        F.sum("s").alias("s"), F.sum("hits").alias("hits"), F.sum("n").alias("n")).collect()  # one line per rule
    return {r.rule: (r.s / r.n, r.hits / r.n) for r in found}


def ordered(rules: Sequence[Rule], measured: dict[str, tuple[float, float]]) -> list[Rule]:
    """Rules by rejections per second, highest first; ties and unmeasured rules as given."""
    def gain(rule: Rule) -> float:
        cost, share = measured.get(rule.name, (1.0, 0.0))
        return share / max(cost, 1e-9)
    return sorted(rules, key=gain, reverse=True)


def cascade(texts: Sequence[str | None], found: Sequence[list[str]], alive: Sequence[bool],
            rules: Sequence[Rule]) -> list[str | None]:
    """Per text the rule that rejects it (null: none, or not ``alive``). Each rule sees survivors only."""
    rejected: list[str | None] = [None] * len(texts)
    left = [(i, Text(texts[i], found[i])) for i in range(len(texts)) if alive[i]]
    for rule in rules:
        kept = []
        for i, t in left:
            if rule.rejects(t):
                rejected[i] = rule.name
            else:
                kept.append((i, t))
        left = kept
    return rejected


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, *, text_col: str = "text",
          sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``row`` (the input row) and struct ``quality``: base metrics, ``rejected_by`` and ``kept``."""
    order = ordered(rules, measure(docs, rules, text_col=text_col, rows=sample_rows))

    def kernel(texts):
        base, found = base_metrics(texts)
        failed = base[-1]
        by = cascade(texts, found, [not f for f in failed], order)
        return [*base, by, [not f and b is None for f, b in zip(failed, by)]]

    return annotate(docs, kernel, f"{BASE_FIELDS}, rejected_by string, kept boolean", text_col, "quality", 4 << 20)
