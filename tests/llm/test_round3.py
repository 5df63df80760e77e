"""Hard negatives, periodic runs and packing against brute force."""
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute as B
from editlake.llm import hard_negatives, packing, periodic, queries
from editlake.llm.common import new_folder

SF = "/root/testdata/sf0.001"
BYTE = P.path("byte_bpe_50k.json")


# --- packing -----------------------------------------------------------------

_byte = Tokenizer.from_file(BYTE)
_byte.encode_special_tokens = True


def byte_ids(text, end=0):
    return (_byte.encode(text, add_special_tokens=False).ids if text else []) + [end]


def brute_pieces(rows, most=1024):
    out = []
    for doc_id, text in rows:
        ids, at = byte_ids(text), 0
        while at < len(ids):
            n = min(most, 1 << ((len(ids) - at).bit_length() - 1))
            out.append((doc_id, at, n, zlib.crc32(np.array(ids[at:at + n], "<u4").tobytes()), len(ids)))
            at += n
    return out


ODD_TEXTS = ["a  b", "a\n\nb", "a \nb", "x\n", "x ", "\nx", " x", "é 日本語 　z", "it's 12 don't", "<|endoftext|> a", "a\0b",
             "a\1b \1", "word,. ..", "a\x85b", "", None, "ok;. x) it's) 5.", "_a b_", "ⅷ x² y½.", "áb ć.", "İstanbul ﬁn é ß", "\x1fz a"]


def test_encoder_equals_library_on_whole_texts():
    e = packing.ByteEncoder(open(BYTE).read())
    rnd = random.Random(4)
    texts = ODD_TEXTS + ["".join(rnd.choice("ab éÀ日1.,'!?\n \t") for _ in range(rnd.randint(0, 200))) for _ in range(300)]
    texts += [r[1] for r in B.ROWS]
    for _ in range(2):  # the second time from the lookup
        data, ends = e.encode(pa.array(texts, pa.string()), np.array([0], "<u4").tobytes())
        begin = 0
        for t, end in zip(texts, ends.tolist()):
            assert np.frombuffer(data[begin:end], "<u4").tolist() == byte_ids(t), t
            begin = end
    assert e.encode(pa.array([], pa.string()), b"")[0] == b""


def test_packing_messy(spark):
    rows = [(r[0], r[1]) for r in B.ROWS]
    got = packing.pack(B.messy(spark), BYTE, 0).collect()
    key = lambda r: repr(tuple(r))
    assert sorted(key((g.doc_id, g.start, g.length, g.ids_crc32, g.doc_tokens)) for g in got) == sorted(map(key, brute_pieces(rows)))
    assert sorted(g.sequence_id for g in got) == list(range(len(got)))
    assert {g.offset for g in got} == {0}
    by_number = sorted(got, key=lambda g: g.sequence_id)
    assert [g.length for g in by_number] == sorted((g.length for g in got), reverse=True)  # one bucket after the other
    for g in got:
        assert zlib.crc32(g.ids) == g.ids_crc32 and len(g.ids) == 4 * g.length and g.length & (g.length - 1) == 0
    assert packing.pack(B.empty(spark), BYTE, 0).collect() == []
    with pytest.raises(ValueError):
        packing.split_pieces(B.messy(spark), BYTE, 0, max_length=1000)


def test_packing_files_and_query(spark):
    folder = new_folder(spark, "packed")
    packing.write(packing.pack(B.messy(spark), BYTE, 0, max_length=64), folder)
    back = packing.read(spark, folder)
    ids = {}
    for r in back.where("doc_id = 5").collect():
        ids[r.start] = np.frombuffer(r.ids, "<u4").tolist()
    assert sum((ids[k] for k in sorted(ids)), []) == byte_ids(B.LONG)
    assert {r.length for r in packing.read(spark, folder, 32).collect()} == {32}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op13_packing(spark, SF).collect()
    assert sorted(tuple(g)[:5] for g in got) == sorted(brute_pieces([tuple(d) for d in docs]))
    assert len({g.sequence_id for g in got}) == len(got)


# --- periodic runs -----------------------------------------------------------

def brute_runs(w, periods=4, least=6):
    """Every period against every place."""
    found = {}
    coded = np.unique(np.array(w, object), return_inverse=True)[1] if w else np.zeros(0, int)
    for q in range(1, len(w) // periods + 1):
        edge = np.diff(np.concatenate([[0], (coded[q:] == coded[:-q]).astype(np.int8), [0]]))
        for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            if e - s + q >= max(least, periods * q):
                found.setdefault((s, e - s + q), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def echo(doc_id, text):
    w = B.WORD.findall(text or "")
    if doc_id is None:
        return w
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    return w


def brute_periodic(doc_id, text):
    w = echo(doc_id, text)
    runs = brute_runs(w)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = " ".join(x for i, x in enumerate(w) if i not in drop)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept))


def random_words(rnd):
    m, n = rnd.choice([1, 2, 3, 5]), rnd.randint(0, 120)
    w = [rnd.choice("abcdefg"[:m]) for _ in range(n)]
    if rnd.random() < 0.5:
        u = [rnd.choice("abc") for _ in range(rnd.randint(1, 12))] * rnd.randint(1, 9)
        p = rnd.randint(0, len(w))
        w = w[:p] + u + w[p:]
    return w * rnd.randint(1, 5) if rnd.random() < 0.2 else w


def test_runs_against_brute_force():
    rnd = random.Random(5)
    docs = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 7, *(random_words(rnd) for _ in range(800))]
    got = periodic.find_runs(docs)
    for d, w in enumerate(docs):
        assert [tuple(r) for r in got[d].tolist()] == brute_runs(w) if d in got else brute_runs(w) == [], w
    assert sum(map(len, got.values())) > 500 and periodic.find_runs([]) == {}


def test_extensions_on_the_grammar():
    rnd = random.Random(6)
    for _ in range(20):
        w = np.array([-1, *(rnd.choice([[rnd.randint(0, 2) for _ in range(150)], [0] * 90, [0, 1] * 60]) * 2), -2,
                      *[rnd.randint(0, 1) for _ in range(100)], -3])
        levels = periodic.grammar(w, seed=rnd.randint(0, 99))
        assert len(levels[-1].symbols) < len(w) // 3
        i = np.array([rnd.randint(0, len(w) - 2) for _ in range(400)])
        j = np.array([rnd.randint(a + 1, len(w) - 1) for a in i])
        for a, b, after, before in zip(i, j, periodic.extension(levels, i, j), periodic.extension(levels, i, j, False)):
            n = 0
            while b + n < len(w) and w[a + n] == w[b + n]:
                n += 1
            assert n == after
            n = 0
            while a - n >= 0 and w[a - n] == w[b - n]:
                n += 1
            assert n == before


def test_periodic_messy(spark):
    got = periodic.digests(periodic.periodic_runs(periodic.with_echoes(B.messy(spark)))).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(brute_periodic(r[0], r[1])) for r in B.ROWS)
    assert periodic.digests(periodic.periodic_runs(B.empty(spark))).collect() == []
    rows = periodic.periodic_runs(B.messy(spark)).where("row.doc_id = 5").first()
    assert rows.periodic.collapsed == "the house by the sea and the ship" and rows.row.k == "!"
    assert [tuple(r) for r in rows.periodic.runs] == [(0, 72000, 8)]
    with pytest.raises(ValueError):
        periodic.periodic_runs(B.messy(spark), periods=2)


def test_periodic_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op12_periodic(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(brute_periodic(*d) for d in docs)


# --- hard negatives ----------------------------------------------------------

def brute_negatives(rows, each=50, positives=5, negatives=3):
    """rows: (id, label, vector)."""
    ok = [(i, lab, [int(np.floor(256 * float(x))) for x in v]) for i, lab, v in rows
          if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (anchor, lab, a) in enumerate(ok):
        if anchor % each:
            continue
        scored = [(-max(-(2**63 - 1), min(2**63 - 1, sum(x * y for x, y in zip(a, v)))), i, other)
                  for m, (i, other, v) in enumerate(ok) if m != n and len(v) == len(a)]
        for p, positive, _ in sorted(s for s in scored if s[2] == lab)[:positives]:
            inside = sorted(s for s in scored if s[2] != lab and 50 * -p <= 100 * -s[0] <= 95 * -p)[:negatives]
            out += [(anchor, positive, r + 1, i, -p, -s) for r, (s, i, _) in enumerate(inside)]
    return sorted(out)


SCHEMA = "vec_id bigint, label int, embedding array<float>, row string, copies string, rid string, tree string, scores string"


def table(spark, rows):
    return spark.createDataFrame([(i, lab, v, *["!"] * 5) for i, lab, v in rows], SCHEMA).repartition(3)


def clustered(rnd, n, dim=8, ids=None):
    centres = rnd.standard_normal((6, dim))
    return [(int(i), int(rnd.integers(0, 3)), (centres[i % 6] + 0.2 * rnd.standard_normal(dim)).astype(np.float32).tolist())
            for i in (range(n) if ids is None else ids)]


def test_hard_negatives_messy(spark):
    rnd = np.random.default_rng(2)
    rows = clustered(rnd, 400)
    rows += rows[:60] + [rows[100]] * 7                                              # repeated rows, anchors among them
    rows += [(1000 + i, i % 3, rows[0][2]) for i in range(40)]                       # one vector under many ids
    rows += [(50, None, rows[1][2]), (None, 1, rows[2][2]), (150, 1, None), (200, 1, [1.0] * 7 + [None]),
             (250, 2, [float("nan")] * 8), (300, 0, [float("inf")] + [0.0] * 7)]
    rows += [(2000, 1, [1.0, 2.0]), (2001, 1, [1.0, 1.5]), (2002, 2, [0.5, 1.0]), (2050, 1, []), (2051, 1, []), (2052, 2, [])]
    rows += [(2100, 2, [0.0] * 8), (2101, 2, [0.0] * 8), (2102, 0, [0.0] * 8)]
    got = hard_negatives.mine(table(spark, rows), lambda i: i % 50 == 0)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert hard_negatives.mine(table(spark, []), lambda i: i % 50 == 0).collect() == []


def test_hard_negatives_small_cells_and_large_numbers(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    rows = clustered(rnd, 300)
    rows += [(400 + i, i % 2, (1e17 * rnd.standard_normal(8)).astype(np.float32).tolist()) for i in range(9)]
    for name, value in (("CELL_ROWS", 64), ("CELL_ANCHORS", 16), ("BLOCK", 20), ("TREE", 8)):
        monkeypatch.setattr(hard_negatives, name, value)
    got = hard_negatives.mine(table(spark, rows), lambda i: i % 5 == 0)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, 5)


def test_spanning_tree_is_minimal():
    rnd = np.random.default_rng(4)
    x = rnd.standard_normal((40, 5))
    x[7] = x[3]
    order, parent, edge = hard_negatives.spanning_tree(x)
    assert sorted(order) == list(range(40)) and (parent < np.arange(40)).all()
    points = np.vstack([x[order], np.zeros(5)])  # the origin is a point, too
    for k in range(40):
        assert np.isclose(edge[k], np.linalg.norm(points[k] - points[parent[k]]))
    d = np.linalg.norm(points[:, None] - points[None], axis=2)
    joined, total = {40}, 0.0
    while len(joined) < 41:
        w, i = min((d[a, b], b) for a in joined for b in range(41) if b not in joined)
        joined.add(i)
        total += w
    assert np.isclose(edge.sum(), total)


def test_bounds_spare_scores_on_clustered_vectors():
    """On tight clusters most rows fall to the bounds, and what is left is exact."""
    rnd = np.random.default_rng(5)
    centres = np.round(3000 * rnd.standard_normal((20, 16)))
    x = np.vstack([c + np.round(20 * rnd.standard_normal((60, 16))) for c in centres])
    rows = hard_negatives.Rows(pa.table({
        "rid": np.arange(len(x)), "id": np.arange(len(x)), "label": np.arange(len(x)) % 2, "copies": np.ones(len(x), np.int64),
        "vec": [hard_negatives._pack(v) for v in x]}), 16)
    order, parent, edge = hard_negatives.spanning_tree(x[::10])
    scored = 0

    def choose(k, low, high, score):
        nonlocal scored
        truth = x @ x[::10][order][k]
        assert (low <= truth).all() and (truth <= high).all()
        at = np.flatnonzero(high >= 0.9 * (x[::10][order][k] ** 2).sum())
        scored += len(at)
        return at, score(at)

    for k, at, score in hard_negatives.walk(x[::10][order], parent, edge, rows, choose):
        assert (score == x[at] @ x[::10][order][k]).all()
    assert scored < 0.35 * len(x) * len(order)


# --- wavelet: encoder and occurrences ------------------------------------------

def test_word_encoder_equals_library_on_whole_texts():
    from editlake.llm import wavelet
    enc = wavelet.WordEncoder(open(B.WORDS, encoding="utf-8").read())
    assert enc.plain
    rnd = random.Random(9)
    texts = ODD_TEXTS + ["".join(rnd.choice("abÉÀ日1.,'!?\n \t\r\x0b　 \x85") for _ in range(rnd.randint(0, 200))) for _ in range(300)]
    texts += [r[1] for r in B.ROWS] + ["İstanbul ﬁn Straße ǅ \1 \x1c x", "a" * 300 + ".", "A,B. c.,", "  ", "\n"]
    for _ in range(2):
        for t, ids in zip(texts, enc.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == (B.TOK.encode(t, add_special_tokens=False).ids if t else []), t


def test_word_lookup_finds_kept_words_without_python():
    import time

    from editlake.llm.word_lookup import Lookup
    asked = []
    lookup = Lookup(lambda names: [asked.append(n) or n.encode() for n in names], kept=200_000)
    words = pa.array([f"{i * 7919 % 1_000_003:x}word" for i in range(150_000)])
    lookup(words)
    assert len(asked) == len(words)

    def cpu(run):
        best = 9.0
        for _ in range(7):
            t = time.process_time()
            run()
            best = min(best, time.process_time() - t)
        return best

    again = lookup(words)
    assert len(asked) == len(words) and again.equals(words.cast(pa.large_binary()))
    # less than the words as Python strings alone, with which a lookup in a dict begins
    assert cpu(lambda: lookup(words)) < cpu(words.to_pylist)


def test_word_lookup_keeps_the_last_used_and_short_words():
    from editlake.llm.word_lookup import LONG, Lookup
    asked = []
    lookup = Lookup(lambda names: [asked.append(n) or n.encode() for n in names], kept=4)

    def ask(*names, kind=pa.string()):
        asked.clear()
        assert lookup(pa.array(names, kind)).to_pylist() == [n.encode() for n in names]
        assert len(lookup.names) == len(lookup.values) == len(lookup.used) <= 8
        return asked

    assert ask("a", "b", "", "é") == ["a", "b", "", "é"]
    assert ask() == []
    assert ask("c", "a", "d") == ["c", "d"]
    assert ask("e", "f", "a") == ["e", "f"]
    assert ask("g") == ["g"]          # nine names: a, e, f and g stay
    assert ask("g", "f", "e", "a", kind=pa.large_string()) == []
    assert ask("b") == ["b"]
    long = "x" * (LONG + 1)
    assert ask(long, "y" * LONG) == [long, "y" * LONG] == ask(long, "y" * LONG) + ["y" * LONG]
    assert ask(*"0123456789") == list("0123456789")


def test_wavelet_shard_of_several_pieces():
    from editlake.llm import wavelet
    rng = np.random.default_rng(2)
    for n in (wavelet.PIECE, 2 * wavelet.PIECE + 1, 3 * wavelet.PIECE - 5):
        for width, kind in ((9, np.uint16), (17, np.uint32)):
            x = np.minimum(rng.geometric(0.01, n), (1 << width) - 1).astype(kind)
            zeros, planes, ranks = wavelet.build(x, width)
            s = wavelet.Shard(n, width, zeros, planes, ranks)
            assert (s.tokens() == x).all() and s.find(int(x[-1])) == np.flatnonzero(x == x[-1]).tolist()
            at = rng.integers(0, n, 20).tolist()
            assert [s.access(i) for i in at] == x[at].tolist()
            for d in (-1, 1):
                with pytest.raises(ValueError):
                    wavelet.Shard(n, width, [*zeros[:-1], zeros[-1] + d], planes, ranks).tokens()


def test_wavelet_lookup_positions(spark):
    from editlake.llm import wavelet
    folder = new_folder(spark, "wavelet")
    wavelet.write(B.messy(spark), folder, B.WORDS, shard_tokens=500, partitions=3)
    shards = wavelet.read(spark, folder)
    stream = []
    for r in sorted(B.ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        stream += (B.TOK.encode(r[1], add_special_tokens=False).ids if r[1] else []) + [1]
    asked = [1, stream[0], max(set(stream), key=stream.count), 40000]
    want = sorted((t, i) for t in set(asked) for i, x in enumerate(stream) if x == t)
    assert sorted(map(tuple, wavelet.lookup(shards, list(set(asked))).collect())) == want


# --- mixing: the join with the plan --------------------------------------------

def test_mixed_rows_do_not_shuffle_texts(spark, monkeypatch):
    from editlake.llm import mixing
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = mixing.mixed_rows(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and "Exchange" not in plan.replace("BroadcastExchange", "")
    few = sorted(map(repr, mixing.mixed_rows(docs).collect()))
    monkeypatch.setattr(mixing, "FEW_SOURCES", 0)  # the way beyond the size check gives the same rows
    assert sorted(map(repr, mixing.mixed_rows(docs).collect())) == few
    assert sorted(map(repr, mixing.mix(B.messy(spark)).collect()))


# --- neighbours: cells ------------------------------------------------------------

def test_neighbour_cells_stay_bounded_with_one_long_vector(spark, monkeypatch):
    from editlake.llm import neighbours
    rng = np.random.default_rng(8)
    x = rng.standard_normal((900, 6))
    x[17] *= 100  # sends most queries to one range
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    seen, deal = [], neighbours.in_cells
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 16)
    monkeypatch.setattr(neighbours, "ROW_BLOCK", 40)
    monkeypatch.setattr(neighbours, "in_cells", lambda *a: seen.append((a[2], *deal(*a))) or seen[-1][1:])
    got = neighbours.search(df, lambda i: i % 2 == 0, k=4, range_rows=150).collect()
    score = x[::2] @ x.T
    score[np.arange(450), np.arange(0, 900, 2)] = -np.inf
    want = {(2 * q, r + 1): int(i) for q in range(450) for r, i in enumerate(np.lexsort((np.arange(900), -score[q]))[:4])}
    assert {(r.query_id, r.rank): r.vec_id for r in got} == want
    assert len(seen) == 2
    for by, asking, held in seen:
        assert asking.groupBy(*by, "g", "s").count().agg(F.max("count")).first()[0] <= 3 * 16
        assert held.groupBy(*by, "g", "s").count().agg(F.max("count")).first()[0] <= 3 * 40


# --- licences: labels over whole texts, many notices ---------------------------------

def edit_distance(a, b, most):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
        if min(row) > most:
            return most + 1
    return row[-1]


def brute_spans(words):
    """Every stretch of words against every notice; the best that do not overlap, then the labels' contest."""
    from editlake.llm import licenses as L
    out = []
    for notice, label in L.NOTICES:
        k, exact, found = L.edits_allowed(notice), L.EXACT.get(notice, ""), []
        for i in range(len(words)):
            for j in range(i + 1, min(len(words), i + len(notice.split()) + k) + 1):
                text = " ".join(words[i:j])
                if abs(len(text) - len(notice)) <= k:
                    whole, target = text, notice
                    if exact and notice.startswith(exact):
                        if not text.startswith(exact + " "):
                            continue
                        whole, target = text[len(exact) + 1:], notice[len(exact) + 1:]
                    elif exact:
                        if not text.endswith(" " + exact):
                            continue
                        whole, target = text[:-len(exact) - 1], notice[:-len(exact) - 1]
                    d = edit_distance(whole, target, k)
                    if d <= k:
                        found.append((d, i, j))
        kept = []
        for d, i, j in sorted(found):
            if all(j <= a or b <= i for _, a, b in kept):
                kept.append((d, i, j))
        out += [(label, i, j, d, 1 - d / len(notice)) for d, i, j in kept]
    return [x for x in out if not any(y[3] < x[3] and y[0] != x[0] and y[1] < x[2] and x[1] < y[2] for y in out)]


def test_license_labels_and_scores_against_brute_force():
    from editlake.llm import licenses as L
    scan, rnd = L.Scanner(), random.Random(11)
    for n in range(120):
        words = []
        for _ in range(rnd.randint(1, 5)):
            words += [rnd.choice(["the", "by", "kit", "licence", "public", "x" * 90, "permit", "general"]) for _ in range(rnd.randint(0, 5))]
            text = list(rnd.choice(L.NOTICES)[0])
            for _ in range(rnd.randint(0, 2)):
                at = rnd.randrange(len(text))
                text[at:at + rnd.choice((0, 1))] = rnd.choice(("", "q", "e"))
            words += "".join(text).split()
        joined = " ".join(words)
        got, want = scan.scan(joined)[2], brute_spans(words)
        assert {x.label for x in got} == {x[0] for x in want}, joined
        assert max((round(x.score, 9) for x in got), default=0) == max((round(x[4], 9) for x in want), default=0), joined


def test_license_words_that_tell_apart_must_stand():
    from editlake.llm import licenses as L
    scan = L.Scanner()
    labels = lambda t: [(x.label, x.edits) for x in scan.scan(t)[2]]
    assert labels("licensed under cc by nd") == labels("kit license") == labels("permit license") == []
    assert labels("licenced undr CC-BY-NC") == [("cc-by-nc", 2)] and labels("the MIT licence, here") == [("mit", 1)]


def test_licenses_are_linear_in_notices():
    import time

    from editlake.llm import licenses as L
    scan, rnd = L.Scanner(), random.Random(12)
    text = " ".join(rnd.choice(["gnu general publik license", "released into teh public domain", "mit licence"]) for _ in range(6400))
    began = time.process_time()
    assert len(scan.scan(text)[2]) == 6400
    assert time.process_time() - began < 5


def test_language_stage_without_labels_keeps_texts(spark):
    import corpus_pipeline
    docs = B.messy(spark).withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.language_id(spark, docs, "").collect()
    assert sorted(repr(r.doc_id) for r in kept) == sorted(repr(r[0]) for r in B.ROWS if r[1] and any(c.isalpha() for c in r[1]))


def test_language_slices_are_small(spark, monkeypatch):
    from editlake.llm import language
    seen = []
    monkeypatch.setattr(language, "annotate", lambda df, kernel, fields, text_col, name, max_bytes: seen.append(max_bytes) or df)
    language.identify(spark.createDataFrame([("a",)], "text string"), None)
    assert 0 < seen[0] <= 3 << 20


def test_backoff_reads_words_of_all_texts_at_once():
    import time

    import xxhash

    from editlake.llm import backoff
    rnd = random.Random(13)
    signs = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "\0", "A", "Z", "É", "İ", "b", "cd"]
    for _ in range(60):
        texts = [None if rnd.random() < .1 else "".join(rnd.choice(signs) for _ in range(rnd.choice((0, 1, 3, 40)))) for _ in range(rnd.randint(0, 8))]
        h, word, lengths = backoff.read_texts(pa.array(["left out", *texts], pa.string()).slice(1))
        want = [B.WORD.findall(B.fold(t)) for t in texts]
        assert lengths.tolist() == [len(w) for w in want] and (np.diff(h.astype(object)) > 0).all() and h[0] == 0
        assert h[word].tolist() == [xxhash.xxh64_intdigest(w) for found in want for w in found]
        pairs = {}
        for i, w in enumerate(want):
            for a, b in zip([None, *w], w):
                key = xxhash.xxh64_intdigest(b), xxhash.xxh64_intdigest(a) if a is not None else 0, i
                pairs[key] = pairs.get(key, 0) + 1
        b, a, own, n = backoff.pair_counts(word, lengths, len(h))
        assert list(zip(zip(h[b].tolist(), h[a].tolist(), own.tolist()), n.tolist())) == sorted(pairs.items())
    texts = [" ".join(rnd.choice("abcdefgh") * 3 for _ in range(500)) for _ in range(400)]

    def seconds(work):
        began = time.process_time()
        work()
        return time.process_time() - began

    def one_by_one():
        number = {}
        for t in texts:
            [number.setdefault(w, len(number)) for w in t.encode().lower().split()]

    column = pa.array(texts)
    assert min(seconds(lambda: backoff.read_texts(column)) for _ in range(5)) < .8 * min(seconds(one_by_one) for _ in range(5))
