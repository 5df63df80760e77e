"""Periodic runs of words, by recompression.

A run is a stretch of words with smallest period q, at least ``least_length``
words and ``least_periods`` periods long, that cannot be made longer.

1. **Grid.** A run of at least 4 periods q (k in general) covers k multiples of
   q in a row, and all of them hold the same word. For every q the words at
   multiples of q are compared with their neighbours on that grid (n/q words,
   so n log n words in all); places with k equal words in a row are the
   candidates. Documents with no candidate have no run.
2. **Grammar.** The documents with candidates are recompressed together, in
   rounds of two halves: maximal blocks of one symbol become one symbol (block
   compression), then, symbols being cut into two classes at random, each pair
   of a symbol of the first and a symbol of the second class becomes one symbol
   (pair compression). Equal symbols stand for equal words, and both halves
   depend on the neighbouring symbols only, so equal stretches are compressed
   alike. A round leaves three quarters of the symbols or less, on average.
   Signs at the documents' borders are unique and never join a pair.
3. **Extension.** How far the words after (before) i and after (before) i + q
   agree is a longest-common-extension query on the grammar: climb while the
   two places can be brought to a parent's edge by comparing one symbol (one
   block), then go down where they differ. That takes one step a level, for all
   candidates of a batch at once, in both directions, and is exact.
4. Of equal stretches only the smallest period stays. As runs have four periods
   or more, a stretch that has periods p < q has p as its smallest period, and
   the candidates of p find it, too.

Defined results: a null text has no words. Null ids, repeated rows and ties are
rows like any others; an empty table gives an empty result. Texts of any length
are searched whole; a text never spans tasks, and its grammar takes about 50
bytes a word while it is searched.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Numbering, annotate, words

LEAST_PERIODS, LEAST_LENGTH = 4, 6
FIELDS = ("n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
ROUNDS = 64   # a text of n words needs about 5 log n


class Level(NamedTuple):
    """A string of symbols, and how the next level's symbols cover it."""
    symbols: np.ndarray
    parent: np.ndarray   # of each place, the place of its symbol on the next level
    first: np.ndarray    # of each place on the next level, its first place here
    last: np.ndarray
    block: bool          # block compression made the next level; else pair compression


def _named(level: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keys: np.ndarray, free: int, block: bool):
    """The next level: symbols at ``starts``; those longer than 1 are named by ``keys``."""
    made = level[starts]
    long = np.flatnonzero(lengths > 1)
    names, number = np.unique(keys, return_inverse=True)
    made[long] = free + number
    parent = np.repeat(np.arange(len(starts), dtype=np.int32), lengths)
    starts = starts.astype(np.int32)
    return made, Level(level, parent, starts, starts + (lengths - 1).astype(np.int32), block), free + len(names)


def grammar(symbols: np.ndarray, seed: int = 1) -> list[Level]:
    """Levels of the run-length grammar, the last one with nothing above it.
    Negative symbols are borders: each occurs once, and none joins a pair."""
    level, free = symbols.astype(np.int64), int(symbols.max(initial=0)) + 1
    rng = np.random.default_rng(seed)
    levels: list[Level] = []
    for _ in range(ROUNDS):
        if len(level) < 2:
            break
        starts = np.flatnonzero(np.concatenate([[True], level[1:] != level[:-1]]))
        if len(starts) < len(level):
            lengths = np.diff(starts, append=len(level))
            long = lengths > 1
            below = level
            level, made, free = _named(below, starts, lengths, below[starts[long]] * (len(below) + 1) + lengths[long], free, True)
            levels.append(made)
        inner = level >= 0
        beside = inner[:-1] & inner[1:]
        if not beside.any():
            break
        odd = np.int64(rng.integers(1 << 30, 1 << 31) * 2 + 1)
        cls = ((level * odd) >> 29) & 1
        up = beside & (cls[:-1] < cls[1:])
        down = beside & (cls[:-1] > cls[1:])
        pair = up if up.sum() >= down.sum() else down
        left = np.flatnonzero(pair)
        if not len(left):
            continue
        keep = np.ones(len(level), bool)
        keep[left + 1] = False
        starts = np.flatnonzero(keep)
        lengths = np.diff(starts, append=len(level))
        below = level
        level, made, free = _named(below, starts, lengths, below[left] * free + below[left + 1], free, False)
        levels.append(made)
    none = np.zeros(0, np.int32)
    return [*levels, Level(level, none, none, none, False)]


def _step(level: Level, i: np.ndarray, j: np.ndarray, forward: bool):
    """Symbols (copies of a block's symbol) that agree from places i and j on,
    within their parents; and whether both then stand at a parent's edge."""
    same = level.symbols[i] == level.symbols[j]
    if not level.block:
        return same.astype(np.int64), same
    a, b = level.parent[i], level.parent[j]
    left = (level.last[a] - i + 1, level.last[b] - j + 1) if forward else (i - level.first[a] + 1, j - level.first[b] + 1)
    return np.where(same, np.minimum(*left), 0), same & (left[0] == left[1])


def extension(levels: Sequence[Level], i: np.ndarray, j: np.ndarray, forward: bool = True) -> np.ndarray:
    """For places i < j: how many words from them on agree (``forward``), or how
    many up to and including them. A border stops every comparison."""
    sign = 1 if forward else -1
    at_i, at_j = i.astype(np.int64), j.astype(np.int64)
    top = len(levels) - 1
    stop = np.full(len(at_i), top)
    live = np.arange(len(at_i))
    for h, level in enumerate(levels[:-1]):
        a, b = at_i[live], at_j[live]
        edge = level.first if forward else level.last
        pa, pb = level.parent[a], level.parent[b]
        ready = (edge[pa] == a) & (edge[pb] == b)
        step, even = _step(level, a, b, forward)
        step[ready] = 0
        a, b = a + sign * step, b + sign * step
        on = ready | even
        at_i[live], at_j[live] = a, b
        stop[live[~on]] = h
        live = live[on]
        at_i[live], at_j[live] = level.parent[at_i[live]], level.parent[at_j[live]]
    symbols = levels[-1].symbols
    while len(live):  # what is left of a document on the last level is short
        live = live[symbols[at_i[live]] == symbols[at_j[live]]]
        at_i[live] += sign
        at_j[live] += sign
    for h in range(top - 1, -1, -1):
        level = levels[h]
        live = np.flatnonzero(stop > h)  # their symbols one level up differ
        edge = level.first if forward else level.last
        a, b = edge[at_i[live]].astype(np.int64), edge[at_j[live]].astype(np.int64)
        step, _ = _step(level, a, b, forward)
        at_i[live], at_j[live] = a + sign * step, b + sign * step
    return (at_i - i) * sign


def grid(symbols: np.ndarray, ends: np.ndarray, periods: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates ``(place, period)``: places g, multiples of q, with equal words at
    g, g + q, ... (``periods`` of them). ``ends`` are the documents' ends, longest
    document first, so the documents that can hold a period are a prefix."""
    sizes = np.diff(ends, prepend=0) - 1  # less the border
    places, found = [], []
    top = int(sizes.max(initial=0)) // periods
    # documents of at least periods * q words, for each q
    holding = np.searchsorted(-sizes, -periods * np.arange(1, top + 1), "right")
    for q in range(1, top + 1):
        line = symbols[:ends[holding[q - 1] - 1]:q]
        equal = line[1:] == line[:-1]
        hit = equal[:len(equal) - periods + 2]
        if periods > 2 and hit.any():
            hit = hit.copy()
            for k in range(1, periods - 1):
                hit &= equal[k:len(equal) - periods + 2 + k]
        at = np.flatnonzero(hit)
        if len(at):
            places.append(at * q)
            found.append(np.full(len(at), q))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(found)


def find_runs(documents: Sequence[Sequence[str]], periods: int = LEAST_PERIODS,
              least_length: int = LEAST_LENGTH) -> dict[int, np.ndarray]:
    """Runs of each document that has any: rows ``start, length, period``."""
    number = Numbering()
    order = sorted(range(len(documents)), key=lambda d: -len(documents[d]))
    coded = [np.fromiter(map(number.__getitem__, documents[d]), np.int64, len(documents[d])) for d in order]

    def joined(some: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(c) + 1 for c in some], np.int64)
        ends = np.cumsum(sizes)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
        out[ends - 1] = -1 - np.arange(len(some))
        inner = np.ones(len(out), bool)
        inner[ends - 1] = False
        if len(some):
            out[inner] = np.concatenate(some)
        return out, ends

    symbols, ends = joined(coded)
    place, period = grid(symbols, ends, periods)
    if not len(place):
        return {}
    having = np.unique(np.searchsorted(ends, place, "right"))
    starts = np.concatenate([[0], ends[:-1]])
    symbols, kept_ends = joined([coded[d] for d in having])
    kept_starts = np.concatenate([[0], kept_ends[:-1]])
    at = np.searchsorted(having, np.searchsorted(ends, place, "right"))
    place = place - starts[having[at]] + kept_starts[at] + 1  # one border before the first document
    levels = grammar(np.concatenate([[-1 - len(having)], symbols]))
    after = extension(levels, place, place + period)
    before = extension(levels, place - 1, place - 1 + period, forward=False)
    start, length = place - before, before + after + period
    enough = length >= np.maximum(least_length, periods * period)
    rows = np.stack([at, start - 1 - kept_starts[at], length, period], 1)[enough]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)  # smallest period of each stretch
    rows = rows[new]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    cut = np.flatnonzero(np.diff(rows[:, 0], prepend=-1))
    return {order[having[part[0, 0]]]: part[:, 1:] for part in np.split(rows, cut[1:])} if len(rows) else {}


def collapsed(document: Sequence[str], runs: np.ndarray | None) -> list[str]:
    """Words that no run contains after its first period."""
    if runs is None:
        return list(document)
    depth = np.zeros(len(document) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return [document[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, *, text_col: str = "text", periods: int = LEAST_PERIODS,
                  least_length: int = LEAST_LENGTH) -> DataFrame:
    """``docs`` as struct ``row`` beside struct ``periodic``: the number of words, the
    runs by start and period, and the text without repeated periods (words joined by one space)."""
    if periods < 4:
        raise ValueError("runs of fewer than four periods need a finer grid")

    def kernel(texts: list[str | None]) -> list[list]:
        split = [words(t) for t in texts]
        runs = find_runs(split, periods, least_length)
        listed = [[{"start": a, "length": n, "period": q} for a, n, q in runs[d].tolist()] if d in runs else []
                  for d in range(len(split))]
        return [[len(w) for w in split], listed, [" ".join(collapsed(w, runs.get(d))) for d, w in enumerate(split)]]

    return annotate(docs, kernel, FIELDS, text_col=text_col, name="periodic")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The longest run (ties: smallest start, then period) and digests of all runs and of the collapsed text."""
    runs = F.col("periodic.runs")
    best = F.array_max(F.transform(runs, lambda r: F.struct(
        r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    line = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return (found.select(F.col(f"row.`{id_col}`").alias("doc_id"), "periodic", best.alias("best"))
            .select("doc_id", F.size("periodic.runs").cast("bigint").alias("n_runs"), (-F.col("best.s")).alias("start"),
                    F.col("best.n").alias("length"), (-F.col("best.p")).alias("period"),
                    F.expr("(1000 * best.n) div -best.p").alias("exponent_milli"),
                    F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
                    F.sha2("periodic.collapsed", 256).alias("collapsed_sha256")))


def with_echoes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Plant periodic tails: with h the crc32 of the decimal id, in texts of n words
    with h % 10 = 0 word i >= a becomes word a + (i - a) % p, where g = h div 10,
    a = g % n and p = 1 + (n - a) div (3 + g % 8). A null id plants nothing."""
    text, h = F.col(f"`{text_col}`"), F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary"))
    w = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    plan = F.struct(w.alias("w"), F.expr("0").alias("z"))
    packed = F.when(h % 10 == 0, plan)
    g = F.floor(h / 10).cast("bigint")
    parts = docs.withColumn("_echo", packed).withColumn("_g", g)
    n = F.size("_echo.w").cast("bigint")
    parts = parts.withColumn("_a", F.when(n > 0, F.col("_g") % n))
    parts = parts.withColumn("_p", F.when(n > 0, F.expr("1 + (cast(size(_echo.w) as bigint) - _a) div (3 + _g % 8)")))
    moved = F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.element_at(
        "_echo.w", (F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")) + 1).cast("int")))
    return (parts.withColumn(text_col, F.when(n > 0, F.array_join(moved, " ")).otherwise(text))
            .drop("_echo", "_g", "_a", "_p"))
