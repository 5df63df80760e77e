"""Brute-force versions and a messy table for the operators' tests."""
import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import tiktoken
import xxhash
from tokenizers import Tokenizer

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")

LONG = "the house by the sea and the ship " * 9000
PROSE = "Licensed under CC BY-NC 4.0. all of the people in the small town went to see the ship come home at night"
ROWS = [
    (1, PROSE, "en", "a", 1), (2, PROSE, "en", "b", 1), (2, PROSE, "en", "b", 1), (3, None, "de", "a", None),
    (4, "", "fr", None, 0), (5, LONG, "en", "b", 3), (None, "ein Haus in der Stadt und das alte Schiff am Meer ist weg", "de", "a", 2),
    (None, None, None, None, None), (7, "x" * 70000, None, "c", 1), (8, "1234 5678 !!", "en", "c", 1),
    (9, "All  rights\treserved\x0b\x0cby　us \x1c\x85 \xa0 ok", None, "é", 1),
    (10, "a\nb c\na\nb c\n\n \nb c", "es", "z\U0001F600", 1),
    (11, PROSE + " again", "en", "a", 1), (12, "licenced undr the apache licence version 2", "en", "￮", 1),
    (13, "###$$$ " * 30, "en", "a", 1), (14, "Straße Ünïcödé Σίσυφος 日本語 テキスト İstanbul ﬁn é", "de", "a", 1),
    (15, "les enfants de la maison sont dans le jardin avec une petite table pour nous", "fr", "a", 1),
    (16, "der Hund und die Katze sind im Garten mit dem Kind und der Frau", "de", "b", 1),
    (17, "les hommes de la ville sont sur le port avec une grande voile pour elle", "fr", "c", 1),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ["row", "out", "size", "copies", "kept", "score", "n_words", "fp", "k", "language", "quality", "found", "bpe", "copy", "_id", "_src", "h"]


def messy(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with the operators' own names."""
    return spark.createDataFrame([(*r, *["!"] * len(CLASH)) for r in ROWS],
                                 SCHEMA + "".join(f", `{c}` string" for c in CLASH)).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


_ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
ENC = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=_ranks, special_tokens={})
TOK = Tokenizer.from_file(WORDS)


def bpe(text):
    ids = ENC.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def word_ids(text):
    ids = (TOK.encode(text, add_special_tokens=False).ids if text else []) + [1]
    return len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())


def base_metrics(text):
    w = WORD.findall(text or "")
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        dup += line in seen and WORD.search(line) is not None
        seen.add(line)
    n = len(w)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered),
            n < 10 or 100 * len(covered) > 20 * n)


def fingerprint(text):
    w = WORD.findall(fold(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, ids):
    """Smallest id reachable from each row over links of at most 4 bits."""
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 4 and label[j] < label[i]:
                    label[i], changed = label[j], True
    low = {}
    for g, i in zip(label, ids):
        low[g] = min((x for x in (low.get(g), i) if x is not None), default=None)
    return [low[g] for g in label]
