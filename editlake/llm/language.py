"""Language identification with a linear-chain conditional random field.

Every word of a text is a position of the chain and every language a label.
A word's score is a sum of learned weights of its character n-grams with
boundary marks (those at a boundary are its affixes), and of its entry in a
lexicon of words frequent in the sample; labels of neighbouring words are tied
by learned transitions. Forward-backward gives each word its label marginals,
so code-switched text is labelled word by word; a document's language is the
label with the largest sum of marginals, and its score the share of that sum.

The model is fitted on a bounded sample of labelled rows: at most about
``SAMPLE_PER_LABEL`` rows of a label, and of each row ``SEGMENTS`` runs of
``SEGMENT`` words at hash-random places. Training chains join segments of
different rows, so they hold switches and the transitions are learned.

Prediction covers whole texts. The chain is cut into blocks of ``BLOCK``
words; the transfer matrices of all blocks are made side by side, the blocks'
entry vectors follow from their products, and the marginals inside all blocks
are again made side by side. That is the exact forward-backward result with a
number of NumPy steps that hardly grows with the longest text.

Defined results: a null text, or one without a letter, is ``und`` with score 0.
Words without a letter take part in the chain but carry no weight. Rows with a
null label or id are not learned from. Without labelled rows every text is
``und``. Repeated rows repeat their result; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Numbering, annotate, words

SAMPLE_PER_LABEL = 500
SEGMENTS, SEGMENT, JOINED = 4, 30, 4
HASH_BITS, GRAMS = 17, (1, 2, 3, 4)
EPOCHS, RATE, DECAY = 40, 0.3, 1e-4
BLOCK = 64
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


class Model(NamedTuple):
    labels: list[str]
    grams: np.ndarray             # hashed n-gram weights, one column per label
    lexicon: dict[str, int]
    entries: np.ndarray           # lexicon weights, one column per label
    transitions: np.ndarray       # weight of label j after label i


# --- features ---------------------------------------------------------------

def gram_features(found: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per n-gram length: hash bucket of every n-gram, and the word it belongs to."""
    marked = "".join([f"\x02{w.lower()}\x03" for w in found])
    code = np.frombuffer(marked.encode("utf-32-le"), "<u4").astype(np.uint64)
    word = np.cumsum(code == 2) - 1 if "\x02" not in "".join(found) else None
    if word is None:  # the mark itself stands in a word: count lengths instead
        word = np.repeat(np.arange(len(found)), [len(w.lower()) + 2 for w in found])
    out = []
    h = np.zeros(len(code), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        h = (h[:m] ^ code[n - 1:]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        if n in GRAMS:
            at = np.flatnonzero(word[:m] == word[n - 1:])
            out.append(((h[at] * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - HASH_BITS)).astype(np.int64), word[at]))
    return out


def emissions(found: Sequence[str], grams: np.ndarray, lexicon: dict[str, int], entries: np.ndarray,
              lettered: np.ndarray) -> np.ndarray:
    """Scores of distinct words, one column per label; 0 for words without a letter."""
    out = np.zeros((len(found), grams.shape[1]), np.float32)
    if not len(found):
        return out
    for bucket, word in gram_features(found):
        if not len(word):
            continue
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[starts]] += np.add.reduceat(grams[bucket], starts, axis=0)
    place = np.fromiter((lexicon.get(w.lower(), -1) for w in found), np.int64, len(found))
    known = np.flatnonzero(place >= 0)
    out[known] += entries[place[known]]
    out[~lettered] = 0
    return out


# --- fitting ----------------------------------------------------------------

def fit(segments: Sequence[tuple[str, Sequence[str]]], seed: int = 1) -> Model | None:
    """Maximum likelihood by gradient ascent (AdaGrad) over chains of joined segments."""
    segments = [(label, list(s)) for label, s in segments if len(s)]
    if not segments:
        return None
    labels = sorted({label for label, _ in segments})
    k = len(labels)
    rng = np.random.default_rng(seed)
    segments = [segments[i] for i in rng.permutation(len(segments))]
    number = Numbering()
    width = SEGMENT * JOINED
    chains = -(-len(segments) // JOINED)
    x, y = np.full((chains, width), -1), np.full((chains, width), -1)
    for c in range(chains):
        at = 0
        for label, s in segments[c * JOINED:(c + 1) * JOINED]:
            ids = list(map(number.__getitem__, s[:SEGMENT]))
            x[c, at:at + len(ids)], y[c, at:at + len(ids)] = ids, labels.index(label)
            at += len(ids)
    found = list(number)
    lettered = np.array([LETTER.search(w) is not None for w in found])
    counts = np.bincount(x[x >= 0], minlength=len(found))
    lower = Numbering()
    folded = np.array([lower[w.lower()] for w in found])
    frequent = np.bincount(folded, weights=counts) >= 3
    lexicon = {w: i for i, w in enumerate(w for w, f in zip(lower, frequent) if f)}
    feats = gram_features(found)
    grams, entries = np.zeros((1 << HASH_BITS, k)), np.zeros((max(1, len(lexicon)), k))
    trans = np.zeros((k, k))
    place = np.fromiter((lexicon.get(w.lower(), -1) for w in found), np.int64, len(found))
    known = np.flatnonzero(place >= 0)
    squares = [np.full(p.shape, 1e-6) for p in (grams, entries, trans)]
    mask = x >= 0
    gold = np.zeros((chains, width, k))
    gold[mask] = np.eye(k)[y[mask]]
    pairs = mask[:, 1:] & mask[:, :-1]
    gold_pairs = np.zeros((k, k))
    np.add.at(gold_pairs, (y[:, :-1][pairs], y[:, 1:][pairs]), 1)
    for _ in range(EPOCHS):
        e = emissions(found, grams, lexicon, entries, lettered).astype(float)
        e -= e.max(1, keepdims=True)
        psi = np.ones((chains, width, k))
        psi[mask] = np.exp(e)[x[mask]]
        gamma, expected = _marginals(psi, mask, np.exp(trans - trans.max()))
        diff = np.zeros((len(found), k))
        np.add.at(diff, x[mask], (gold - gamma)[mask])
        diff[~lettered] = 0
        g_grams = np.zeros_like(grams)
        for bucket, word in feats:
            for j in range(k):
                g_grams[:, j] += np.bincount(bucket, weights=diff[word, j], minlength=len(grams))
        g_entries = np.zeros_like(entries)
        np.add.at(g_entries, place[known], diff[known])
        for p, g, s in zip((grams, entries, trans), (g_grams, g_entries, gold_pairs - expected), squares):
            g = g / chains - DECAY * p
            s += g * g
            p += RATE * g / np.sqrt(s)
    return Model(labels, grams.astype(np.float32), lexicon, entries.astype(np.float32), trans)


def _marginals(psi: np.ndarray, mask: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label marginals and summed pair marginals of equally long, end-padded chains."""
    n, width, k = psi.shape
    alpha = np.empty_like(psi)
    v = np.full((n, k), 1.0 / k)
    for t in range(width):
        new = (v @ a) * psi[:, t]
        new /= new.sum(1, keepdims=True)
        v = np.where(mask[:, t, None], new, v)
        alpha[:, t] = v
    gamma = np.zeros_like(psi)
    expected = np.zeros((k, k))
    b = np.ones((n, k))
    for t in range(width - 1, -1, -1):
        g = alpha[:, t] * b
        gamma[:, t] = g / g.sum(1, keepdims=True)
        step = psi[:, t] * b
        if t:
            xi = alpha[:, t - 1, :, None] * a * step[:, None, :]
            xi /= xi.sum((1, 2), keepdims=True)
            expected += xi[mask[:, t]].sum(0)
        new = step @ a.T
        new /= new.sum(1, keepdims=True)
        b = np.where(mask[:, t, None], new, b)
    gamma[~mask] = 0
    return gamma, expected


# --- forward-backward over whole texts ----------------------------------------

def label_mass(chain: np.ndarray, lengths: np.ndarray, psi: np.ndarray, weight: np.ndarray, a: np.ndarray,
               block: int = BLOCK, out: list | None = None) -> np.ndarray:
    """Per text the sum of its words' label marginals times ``weight``.

    ``chain`` holds the word numbers of all texts one after the other, ``psi``
    the exponentiated scores by word number. ``out`` receives the marginals.
    """
    k = psi.shape[1]
    texts = len(lengths)
    blocks = -(-lengths // block)
    first = np.concatenate([[0], np.cumsum(blocks)])
    total = int(first[-1])
    mass = np.zeros((texts, k))
    if not total:
        return mass
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    owner = np.repeat(np.arange(texts), blocks)
    nth = np.arange(total) - first[owner]
    begin = start[owner] + nth * block
    size = np.minimum(block, lengths[owner] - nth * block)
    # longest blocks first: at step t the blocks that still have words are a prefix
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    live = np.searchsorted(-size, -np.arange(block), side="left")  # blocks with more than t words
    a = a.astype(np.float32)
    p = np.broadcast_to(np.eye(k, dtype=np.float32), (total, k, k)).copy()
    word = [chain[begin[:live[t]] + t] for t in range(block)]
    for t in range(block):
        n = live[t]
        step = (p[:n] @ a) * psi[word[t]][:, None, :]
        p[:n] = step / step.sum((1, 2), keepdims=True)
    # blocks of a text in order: entry vectors forward, exit vectors backward
    at = np.empty(total, np.int64)
    at[order] = np.arange(total)  # where a block went
    by_blocks = np.argsort(-blocks, kind="stable")
    many = blocks[by_blocks]
    enter, leave = np.empty((total, k), np.float32), np.empty((total, k), np.float32)
    v, u = np.full((texts, k), 1.0 / k, np.float32), np.full((texts, k), 1.0 / k, np.float32)
    for j in range(int(many[0])):
        n = int(np.searchsorted(-many, -j, side="left"))
        here, back = by_blocks[:n], None
        b = at[first[here] + j]
        enter[b] = v[here]
        new = (v[here][:, None, :] @ p[b])[:, 0]
        v[here] = new / new.sum(1, keepdims=True)
        back = at[first[here + 1] - 1 - j]
        leave[back] = u[here]
        new = (p[back] @ u[here][:, :, None])[:, :, 0]
        u[here] = new / new.sum(1, keepdims=True)
    alpha = []
    v = enter
    for t in range(block):
        n = live[t]
        new = (v[:n] @ a) * psi[word[t]]
        v[:n] = new / new.sum(1, keepdims=True)
        alpha.append(v[:n].copy())
    b, sums = leave, np.zeros((total, k))
    marginals = np.zeros((len(chain), k), np.float32) if out is not None else None
    for t in range(block - 1, -1, -1):
        n = live[t]
        g = alpha[t] * b[:n]
        g /= g.sum(1, keepdims=True)
        sums[:n] += g * weight[word[t]][:, None]
        if marginals is not None:
            marginals[begin[:n] + t] = g
        new = (psi[word[t]] * b[:n]) @ a.T
        b[:n] = new / new.sum(1, keepdims=True)
    np.add.at(mass, owner[order], sums)
    if out is not None:
        out.append(marginals)
    return mass


def predict(texts: Sequence[str | None], model: Model | None) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    if model is None:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    _, _, mass = _label(texts, model)
    total = mass.sum(1)
    best = mass.argmax(1)
    some = total > 0
    share = mass[np.arange(len(texts)), best] / np.where(some, total, 1)
    return ([model.labels[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist())],
            np.clip(np.where(some, share, 0.0), 0, 1).tolist())


def _label(texts: Sequence[str | None], model: Model, out: list | None = None):
    number = Numbering()
    ids = [list(map(number.__getitem__, words(t))) for t in texts]
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    chain = np.fromiter((i for d in ids for i in d), np.int64, int(lengths.sum()))
    del ids
    found = list(number)
    lettered = np.fromiter((LETTER.search(w) is not None for w in found), bool, len(found))
    e = emissions(found, model.grams, model.lexicon, model.entries, lettered)
    psi = np.exp(np.maximum(e - e.max(1, keepdims=True), -30)) if len(found) else e
    a = np.exp(model.transitions - model.transitions.max())
    return chain, lengths, label_mass(chain, lengths, psi, lettered.astype(np.float32), a, out=out)


def label_words(text: str | None, model: Model) -> list[tuple[str, str, float]]:
    """The words of one text, each with its language and that language's marginal."""
    out: list = []
    _label([text], model, out)
    if not out:
        return []
    return [(w, model.labels[int(g.argmax())], float(g.max())) for w, g in zip(words(text), out[0])]


# --- on DataFrames ------------------------------------------------------------

def segments_of(text: str | None, key: int) -> list[list[str]]:
    """``SEGMENTS`` runs of words at places that depend on the row's key only."""
    found = words(text)
    if not found:
        return []
    rng = np.random.default_rng(key & 0xFFFFFFFF)
    starts = rng.integers(0, max(1, len(found) - SEGMENT + 1), SEGMENTS)
    return [found[s:s + SEGMENT] for s in sorted(set(starts.tolist()))]


def learn(docs: DataFrame, learn_from, *, text_col: str = "text", label_col: str = "lang",
          per_label: int = SAMPLE_PER_LABEL, seed: int = 11) -> Model | None:
    """Fit on a bounded sample of the labelled rows for which ``learn_from`` holds."""
    rows = (docs.where(learn_from & F.col(f"`{label_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull())
            .select(F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{text_col}`").alias("text")))
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}  # one line per language
    if not counts:
        return None

    def cut(batches):
        for batch in batches:
            labels, texts = batch.column("label").to_pylist(), batch.column("text").to_pylist()
            made = [(label, s) for label, t in zip(labels, texts) for s in segments_of(t, len(t) * 2654435761)]
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()),
                                              pa.array([m[1] for m in made], pa.list_(pa.string()))], ["label", "words"])

    sample = rows.sampleBy("label", {k: min(1.0, per_label / n) for k, n in counts.items()}, seed)
    found = sample.mapInArrow(cut, "label string, words array<string>").collect()
    return fit(sorted((r.label, list(r.words)) for r in found))


def identify(docs: DataFrame, model: Model | None, *, text_col: str = "text") -> DataFrame:
    """``row`` (the input row) and struct ``language``: ``lang_pred`` and ``score``."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # hashed weights and a bounded lexicon
    k = len(model.labels) if model else 1
    return annotate(docs, lambda texts: predict(texts, held.value), "lang_pred string, score double", text_col,
                    "language", max(1 << 16, (3 << 20) // max(1, k // 4)))


def held_out(id_col: str = "doc_id"):
    """Rows kept from learning: crc32 of the id as text divisible by 5 (a null id: not)."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 5 == 0, F.lit(False))


def may_learn(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 5 != 0, F.lit(False))
