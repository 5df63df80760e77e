"""Encoding many texts through a lookup of their words, in Arrow.

Texts are split and their words numbered by Arrow, so Python sees the different
words of a slice only. Words that are letters with some signs after them are
taken apart there, too; what reaches the lookup are different letter cores,
different tails and the few other words. The bytes of all words are put
together again by Arrow.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

Encode = Callable[[list[str]], list[bytes]]
#: Signs that may follow a word (RE2): ASCII signs but the apostrophe, which splits words in a way of its own.
SIGNS = r"[!-&(-/:-@\[-`{-~]*"
#: How byte-level BPE spells a byte: printable ones as themselves, the others from U+0100 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SPELLING = np.arange(256, dtype="<u4")
_SPELLING[[b for b in range(256) if b not in _PRINTED]] = np.arange(256, 512 - len(_PRINTED))
SPACE = chr(_SPELLING[32])
KEPT = 400_000      # cores kept per worker, and as many of the generation before
LONG = 128          # letters; longer words are not kept


def spelled(text: str, kept: str) -> str:
    """The bytes of a text as byte-level BPE spells them; the characters ``kept`` (ASCII) stay."""
    table = _SPELLING.copy()
    for c in kept:
        table[ord(c)] = ord(c)
    return table[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-32-le")


class Lookup:
    """Bytes of strings, ``kept`` to twice that many of them by last use; ``encode`` makes new ones.

    Names and bytes stay in Arrow: a call finds all its strings at once, and
    Python sees the new ones only."""

    def __init__(self, encode: Encode, kept: int = KEPT):
        self.encode, self.kept = encode, kept
        self.names, self.values = pa.array([], pa.string()), pa.array([], pa.large_binary())
        self.used, self.calls = np.empty(0, np.int64), 0

    def __call__(self, strings: pa.Array) -> pa.Array:
        """Of an array of different strings, the array of their bytes."""
        if self.names.type != strings.type:  # large strings, where Spark is set to them
            self.names = self.names.cast(strings.type)
        found = pc.index_in(strings, value_set=self.names)
        new = found.is_null()
        at = found.fill_null(0).to_numpy().copy()
        missing, values = strings.filter(new), self.values
        self.calls += 1
        if len(missing):
            made = pa.array(self.encode(missing.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
            values = pa.concat_arrays([values, made])
            unseen = new.to_numpy(zero_copy_only=False)
            self.used[at[~unseen]] = self.calls
            at[unseen] = len(self.names) + np.arange(len(missing))
            self._keep(missing, made)
        else:
            self.used[at] = self.calls
        return values.take(pa.array(at))

    def _keep(self, names: pa.Array, made: pa.Array) -> None:
        short = pc.less_equal(pc.utf8_length(names), LONG)
        self.names = pa.concat_arrays([self.names, names.filter(short)])
        self.values = pa.concat_arrays([self.values, made.filter(short)])
        self.used = np.append(self.used, np.full(len(self.names) - len(self.used), self.calls))
        if len(self.names) > 2 * self.kept:
            last = pa.array(np.sort(np.argsort(self.used, kind="stable")[len(self.used) - self.kept:]))
            self.names, self.values = self.names.take(last), self.values.take(last)
            self.used = self.used[last.to_numpy()]


def _numbered(strings: pa.Array, lookup: Lookup) -> pa.Array:
    coded = strings.dictionary_encode()
    return lookup(coded.dictionary).take(coded.indices)


class Words:
    """Bytes of words: ``pattern`` (RE2) takes a word apart into ``core`` and
    ``tail``, which are encoded on their own; other words are encoded whole."""

    def __init__(self, pattern: str, cores: Encode, tails: Encode, others: Encode, lower: bool = False, kept: int = KEPT):
        self.pattern, self.lower = pattern, lower
        self.cores, self.tails, self.others = Lookup(cores, kept), Lookup(tails, kept), Lookup(others, kept)

    def __call__(self, words: pa.Array) -> pa.Array:
        parts = pc.extract_regex(words, self.pattern)
        regular = parts.is_valid().to_numpy(zero_copy_only=False)
        some, rest = pa.array(np.flatnonzero(regular)), pa.array(np.flatnonzero(~regular))
        taken = parts.take(some)
        core = taken.field("core")
        core = _numbered(pc.utf8_lower(core) if self.lower else core, self.cores)
        tail = _numbered(taken.field("tail"), self.tails)
        whole = pc.binary_join_element_wise(core, tail, pa.scalar(b"", pa.large_binary()))
        place = np.empty(len(words), np.int64)
        place[some.to_numpy()] = np.arange(len(some))
        place[rest.to_numpy()] = len(some) + np.arange(len(rest))
        return pa.concat_arrays([whole, self.others(words.take(rest))]).take(pa.array(place))


def spread_out(lists: pa.ListArray, encode: Callable[[pa.Array], pa.Array]) -> tuple[bytes, np.ndarray]:
    """The bytes of all words of all lists one after the other, and where each list ends."""
    coded = lists.flatten().dictionary_encode()
    values = encode(coded.dictionary).take(coded.indices)
    at = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, values.offset * 8)
    data = values.buffers()[2]
    ends = at[lists.offsets.to_numpy()[1:]] - at[0]
    return (data.slice(int(at[0]), int(at[-1] - at[0])).to_pybytes() if data is not None else b""), ends


def with_whole(data: bytes, ends: np.ndarray, whole: dict[int, bytes]) -> tuple[bytes, np.ndarray]:
    """``data`` with the bytes of some lists replaced."""
    if not whole:
        return data, ends
    begins = np.concatenate([[0], ends[:-1]])
    each = [whole.get(i, data[a:b]) for i, (a, b) in enumerate(zip(begins.tolist(), ends.tolist()))]
    return b"".join(each), np.cumsum([len(b) for b in each])
