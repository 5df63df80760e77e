"""Operators on texts against brute force, over messy and empty tables."""
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import brute as B
from editlake.llm import (backoff, byte_bpe, edit_counts, language, licenses, mixing, quality, queries, simhash, wavelet)
from editlake.llm.common import new_folder

SF = "/root/testdata/sf0.001"


def test_bpe_messy(spark):
    got = byte_bpe.digests(B.messy(spark), B.RANKS, P.PATTERN).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((r[0], *B.bpe(r[1]))) for r in B.ROWS)
    assert byte_bpe.digests(B.empty(spark), B.RANKS, P.PATTERN).collect() == []
    whole = byte_bpe.encode_documents(B.messy(spark), B.RANKS, P.PATTERN).where("row.doc_id = 14").first()
    assert np.frombuffer(whole.bpe.ids, "<u4").tolist() == B.ENC.encode_ordinary(whole.row.text)


def test_bpe_trees_agree_with_library():
    v = byte_bpe.vocabulary(open(B.RANKS, "rb").read(), P.PATTERN)
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("etaoin thr'sS1é \n\t　日!") for _ in range(rnd.randint(0, 300))) for _ in range(400)]
    texts += ["ab" * 2000, "z" * 1025, " " * 500, "a" * 257]
    for t, (listed, ids) in zip(texts, v.encode(texts)):
        assert listed == ",".join(map(str, B.ENC.encode_ordinary(t)))
        assert v.decode(ids).decode() == t
    piece = b"thandererntheblething"
    assert v.merge_long(piece) == v.merge_rows([piece], 32)[0]


def test_wavelet_shard():
    rng = np.random.default_rng(1)
    for n, width in ((0, 3), (1, 1), (700, 5), (3000, 16)):
        x = rng.integers(0, 1 << width, n).astype(np.uint16)
        if n > 9:
            x[::4] = x[0]
        s = wavelet.Shard(n, width, *wavelet.build(x, width))
        assert (s.tokens() == x).all()
        assert [s.access(i) for i in range(min(n, 50))] == x[:50].tolist()
        for t in [*set(x[:6].tolist()), 0]:
            at = np.flatnonzero(x == t).tolist()
            assert s.find(t) == at and s.count(t) == len(at) and s.rank(t, n // 2) == sum(a < n // 2 for a in at)
        with pytest.raises(IndexError):
            s.access(n)
    with pytest.raises(ValueError):
        wavelet.Shard(9, 1, [9], [b"\0"], [b"\0" * 8])


def test_wavelet_files_messy(spark):
    folder = new_folder(spark, "t")
    wavelet.write(B.messy(spark), folder, B.WORDS, shard_tokens=50, partitions=3)
    shards = wavelet.read(spark, folder)
    got = sorted(wavelet.documents_of(shards).collect(), key=lambda r: r.start)
    want = sorted(B.ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    at = 0
    for r, (doc, text, *_) in zip(got, want, strict=True):
        n, crc = B.word_ids(text)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, at, n, crc)
        at += n
    ends = wavelet.lookup(shards, [1]).count()
    assert ends >= len(B.ROWS)
    folder = new_folder(spark, "t")
    wavelet.write(B.empty(spark), folder, B.WORDS)
    assert wavelet.documents_of(wavelet.read(spark, folder)).collect() == []


def test_word_encoder_equals_library():
    enc = wavelet.WordEncoder(open(B.WORDS, encoding="utf-8").read())
    rnd = random.Random(5)
    parts = ["a", "The", "É", "é.", " ", "  ", "\n", "\x1c", "\x85", "　", "ß,", "日", "'s", "İ", "Σ", "é", "ﬁ", "!?", "가", "K"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    for t, ids in zip(texts, enc.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == B.TOK.encode(t, add_special_tokens=False).ids


def test_quality_messy(spark):
    got = quality.judge(B.messy(spark)).select("row.doc_id", "quality.*").collect()
    want = [(r[0], *B.base_metrics(r[1])) for r in B.ROWS]
    assert sorted(repr(tuple(r)[:7]) for r in got) == sorted(map(repr, want))
    for r in got:
        assert r.kept == (not r.base_failed and r.rejected_by is None)
    assert {r.doc_id: r.kept for r in got}[1]
    assert quality.judge(B.empty(spark)).collect() == []


def test_cascade_verdict_is_the_same_in_any_order():
    texts = [r[1] for r in B.ROWS] + ["SHOUT! " * 40, "word | " * 30, "ab ab\n" * 30]
    found = [quality.words(t) for t in texts]
    want = [any(rule.rejects(quality.Text(t)) for rule in quality.RULES) for t in texts]
    for seed in range(4):
        rules = random.Random(seed).sample(quality.RULES, len(quality.RULES))
        assert [x is not None for x in quality.cascade(texts, found, [True] * len(texts), rules)] == want
    measured = {r.name: (1.0 + i, 0.5) for i, r in enumerate(quality.RULES)}
    assert quality.ordered(quality.RULES, measured) == list(quality.RULES)
    measured["same_lines"] = (0.01, 0.5)
    assert quality.ordered(quality.RULES, measured)[0].name == "same_lines"


def test_few_distinct_does_not_depend_on_length():
    rnd = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    clean = [w for _ in range(200) for w in rnd.sample(vocabulary, 100)]
    poor = [rnd.choice(vocabulary[:60]) for _ in range(20050)]
    rejects = {r.name: r.rejects for r in quality.RULES}["few_distinct"]
    for n in (60, 1000, 1001, 20000):
        assert not rejects(quality.Text(" ".join(clean[:n])))
    assert not rejects(quality.Text(" ".join(clean * 5)))
    for n in (1000, 1001, 1999, 20050):
        assert rejects(quality.Text(" ".join(poor[:n])))
    half = poor[:1500] + [f"x{i}" for i in range(1500)]  # every window counts, the last one too
    assert quality.distinct_share(half) == pytest.approx(sum(len(set(half[a:a + 1000])) for a in (0, 1000, 2000)) / 3000)
    assert quality.distinct_share(half[:1001]) == pytest.approx((len(set(half[:1000])) + len(set(half[1:1001]))) / 2000)


def test_language_messy_and_held_out(spark):
    docs = B.messy(spark)
    model = language.learn(docs, F.lit(True))
    assert set(model.labels) <= {r[2] for r in B.ROWS}
    got = language.identify(docs, model).select("row.*", "language.lang_pred", F.col("language.score").alias("s")).collect()
    for r in got:
        lettered = r.text is not None and language.LETTER.search(r.text) is not None
        assert (r.lang_pred in model.labels) if lettered else (r.lang_pred, r.s) == ("und", 0.0)
        assert 0 <= r.s <= 1
    assert {r.doc_id: r.lang_pred for r in got}[15] == "fr"
    none = language.learn(B.empty(spark), language.may_learn())
    assert none is None and language.identify(B.empty(spark), none).collect() == []
    assert {r.language.lang_pred for r in language.identify(docs, None).collect()} == {"und"}


def test_language_accuracy_on_held_out_rows(spark):
    rows = queries.op1_language(spark, "/root/testdata/sf0.01").where("held_out").select("doc_id", "lang_pred")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = rows.join(truth.where("lang is not null"), "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)


def test_blocked_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    psi, a = np.exp(rng.normal(size=(20, 3))).astype(np.float32), np.exp(rng.normal(size=(3, 3)))
    lengths = np.array([0, 1, 63, 64, 65, 0, 300])
    chain, out = rng.integers(0, 20, lengths.sum()), []
    mass = language.label_mass(chain, lengths, psi, np.ones(20), a, out=out)
    at = 0
    for i, n in enumerate(lengths.tolist()):
        v, b, alpha, gamma = np.full(3, 1 / 3), np.ones(3), [], []
        for w in chain[at:at + n]:
            v = (v @ a) * psi[w]
            v /= v.sum()
            alpha.append(v)
        for t in range(n - 1, -1, -1):
            g = alpha[t] * b
            gamma.append(g / g.sum())
            b = a @ (psi[chain[at + t]] * b)
            b /= b.sum()
        if n:
            np.testing.assert_allclose(out[0][at:at + n], gamma[::-1], atol=1e-4)
            np.testing.assert_allclose(mass[i], np.sum(gamma, 0), rtol=1e-3, atol=1e-3)
        at += n


def test_simhash_messy(spark):
    got = simhash.near_duplicates(B.messy(spark)).collect()
    fps = [B.fingerprint(r[1]) for r in B.ROWS]
    comp = B.components(fps, [r[0] for r in B.ROWS])
    want = [(r[0], f, c) for r, f, c in zip(B.ROWS, fps, comp)]
    assert sorted(repr((r.doc_id, r.fp % (1 << 64), r.component_id)) for r in got) == sorted(map(repr, want))
    assert simhash.near_duplicates(B.empty(spark)).collect() == []
    kept = simhash.representatives(B.messy(spark))
    assert kept.columns == B.messy(spark).columns
    groups = len({(c, f if c is None else 0) for c, f in zip(comp, fps)})
    assert kept.count() == groups and simhash.representatives(B.empty(spark)).collect() == []


def test_vantage_point_shards_find_every_link():
    rng = np.random.default_rng(4)
    points = np.unique(rng.integers(0, 1 << 63, 4000).astype(np.uint64) << np.uint64(1))
    near = points[:900].copy()
    for _ in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, len(near)).astype(np.uint64)
    points = np.unique(np.concatenate([points, near, points[:300] ^ np.uint64(7)]))
    tree = simhash.grow(points[::5], 4)
    groups, homes = simhash.Groups(len(points)), 0
    for _, at, home in simhash.place(tree, points, 4):
        homes += int(home.sum())
        label = simhash.link_shard(points[at], home, 4)
        child = np.flatnonzero(label != np.arange(len(label)))
        groups.link(at[child], at[label[child]])
    assert homes == len(points)
    whole = simhash.Groups(len(points))
    for s in range(0, len(points), 256):
        i, j = np.nonzero(np.bitwise_count(points[s:s + 256, None] ^ points[None, :]) <= 4)
        whole.link(i + s, j)
    assert (whole.label == groups.label).all()


def test_components_of_a_long_chain(spark):
    from editlake.llm.components import connected_components
    edges = spark.range(300).select((F.col("id") * 7 % 301).alias("a"), ((F.col("id") + 1) * 7 % 301).alias("b"))
    got = connected_components(edges.union(spark.createDataFrame([(1000, 1001), (1001, 1002), (1002, 1000)], "a bigint, b bigint")))
    rows = {r.node: r.root for r in got.collect()}
    assert {v for k, v in rows.items() if k < 1000} == {0} and {rows[k] for k in (1000, 1001, 1002)} == {1000}


def test_licenses_messy(spark):
    got = licenses.search(B.messy(spark)).select("row.doc_id", "row.text", "found.*").collect()
    for r in got:
        words = [w for w in B.fold(r.text).translate({c: " " for c in range(128) if not chr(c).isalnum()}).split(" ") if w]
        assert r.n_words == len(words)
        want = sorted((i, x) for p, x in licenses.PHRASES for i in range(len(words)) if words[i:i + len(p.split())] == p.split())
        assert sorted((b.word, b.label) for b in r.base) == want
        for s in r.spans:
            assert " ".join(words[s.start_word:s.end_word]) == s.matched and 0 < s.score <= 1
    assert {s.label for r in got if r.doc_id == 12 for s in r.spans} == {"apache"}
    assert {s.label for r in got if r.doc_id == 1 for s in r.spans} == {"cc-by-nc"}
    assert licenses.search(B.empty(spark)).collect() == []


def test_license_seeds_lose_no_match():
    s, rnd = licenses.Scanner(), random.Random(2)
    for _ in range(150):
        i = rnd.randrange(len(s.notices))
        text = list(s.notices[i][0])
        for _ in range(s.allowed[i]):
            k = rnd.randrange(1, len(text) - 1)
            text[k:k + rnd.choice((0, 1, 1))] = rnd.choice(("", "x", "q"))
        joined = "aa bb " + "".join(text) + " cc"
        direct = s.verify[i].search(joined)
        if direct and "  " not in joined:
            found = s.fuzzy(joined)
            assert any(x.label == s.notices[i][1] or x.edits < sum(direct.fuzzy_counts) for x in found), joined


def test_license_places_of_one_notice_close_together():
    s = licenses.Scanner()
    for words in ("the gnu general publik license gnu general public license text",
                  "gnu general public license gnu general publik license",
                  "gnu general publik license gnu general public license gnu generel publik license gnu general public license"):
        found = sorted((x.start_word, x.matched) for x in s.fuzzy(words) if x.label == "gpl" and x.matched.startswith("gnu"))
        listed = words.removeprefix("the ").removesuffix(" text").split(" ")
        first = words.startswith("the ")
        assert found == [(first + k, " ".join(listed[k:k + 4])) for k in range(0, len(listed), 4)]


def test_edit_counts_follow_full_encoding(spark):
    c = edit_counts.counter(open(B.RANKS, "rb").read(), P.PATTERN)
    rnd = random.Random(8)
    parts = ["a", "th ", "e", " ", "  ", "\n", "!!", "'s", "'", "1", "é", "\x1c", "　"]
    for _ in range(150):
        t = "".join(rnd.choice(parts) for _ in range(rnd.choice((3, 60, 700))))
        tree = edit_counts.PreTokenTree(t, c)
        for _ in range(5):
            a, cut, x = rnd.randint(-2, len(t) + 2), rnd.choice((0, 1, 50)), "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 5)))
            tree.edit(a, a + cut, x)
            s = min(max(0, a), len(t))
            t = t[:s] + x + t[max(s, min(a + cut, len(t))):]
            assert tree.text() == t and tree.n_tokens == len(B.ENC.encode_ordinary(t))
    revised = edit_counts.revisions(B.messy(spark))
    for r in edit_counts.count(revised, B.RANKS, P.PATTERN).collect():
        t = r.row.text or ""
        assert r.counts.n_before == len(B.ENC.encode_ordinary(t))
        for e in r.row.edits:
            s = min(e.start, len(t))
            t = t[:s] + e.text + t[max(s, min(e.stop, len(t))):]
        assert r.counts.n_after == len(B.ENC.encode_ordinary(t)) and r.counts.n_edits == 4
    assert edit_counts.count(edit_counts.revisions(B.empty(spark)), B.RANKS, P.PATTERN).collect() == []
    table = spark.createDataFrame([(1, 2, 0, 1, "b"), (1, 1, 0, 0, "a"), (2, 1, None, None, None)],
                                  "doc_id bigint, seq int, start bigint, stop bigint, text string")
    joined = edit_counts.with_edits(B.messy(spark), table)
    got = {r.row.doc_id: r.counts for r in edit_counts.count(joined, B.RANKS, P.PATTERN).collect()}
    assert got[1].n_edits == 2 and got[1].n_after == len(B.ENC.encode_ordinary("b" + B.PROSE)) and got[4].n_edits == 0


@pytest.mark.parametrize("hot,pairs", [(1000, 1 << 20), (3, 5)])
def test_backoff_messy(spark, hot, pairs):
    got = backoff.score(B.messy(spark), hot_share=hot, bucket_pairs=pairs).collect()
    docs = [(r[0], r[1], B.WORD.findall(B.fold(r[1]))) for r in B.ROWS]
    uni, his, pair = {}, {}, {}
    for _, _, w in docs:
        for a, b in zip([None, *w], w):
            uni[b], his[a], pair[a, b] = uni.get(b, 0) + 1, his.get(a, 0) + 1, pair.get((a, b), 0) + 1
    total = sum(uni.values())
    want = [(d, len(w), sum(np.log(pair[a, b] / his[a]) if pair[a, b] > 1 else np.log(0.4 * uni[b] / total)
                            for a, b in zip([None, *w], w))) for d, _, w in docs]  # a row each, repeated ones too
    key = lambda x: (repr(x[0]), x[1], round(x[2], 4))
    assert sorted((key(r) for r in got)) == sorted(key((d, n, float(s))) for d, n, s in want)
    assert backoff.score(B.empty(spark)).collect() == []


def test_backoff_hot_words_do_not_grow_with_the_table(spark, monkeypatch):
    assert backoff.hot_count(80_000_000) == 80_000 and backoff.hot_count(5 * 10 ** 9) == backoff.hot_count(10 ** 13) == 1 << 21
    seen, made = [], backoff.Hot.__init__
    monkeypatch.setattr(backoff.Hot, "__init__", lambda self, words, pairs: seen.append((words, pairs)) or made(self, words, pairs))
    rows = lambda **k: sorted((repr(r[0]), r[1], round(r[2], 4)) for r in backoff.score(B.messy(spark), **k).collect())
    got = rows(hot_share=1, bucket_pairs=5000)  # no word holds all places; some are in 5,000
    words, pairs = seen[-1]
    assert len(words) > 2 and pairs and all(max(n, p) >= 5000 for _, n, p in words) and min(c for _, _, c in pairs) >= 5000
    assert got == rows()


def test_mixing_messy(spark):
    got = mixing.mix(B.messy(spark)).collect()
    sizes = sorted((repr(r[0]), len(B.WORD.findall(r[1] or ""))) for r in B.ROWS)
    assert sorted((repr(r.doc_id), r.size) for r in got) == sizes
    total = sum(n for _, n in sizes)
    by_source = {(r.source_size, r.target) for r in got}
    assert abs(sum(t for _, t in by_source) - total) < 1e-6 * total + 1 or len(by_source) < len({r[3] for r in B.ROWS})
    assert all(r.target <= 3 * r.source_size and r.taken <= 3 * r.size for r in got)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(B.messy(spark).repartition(5)).collect()))
    rows = mixing.mixed_rows(B.messy(spark))
    assert rows.columns == B.messy(spark).columns and rows.count() == sum(r.copies for r in got)
    assert mixing.mix(B.empty(spark)).collect() == [] and mixing.mixed_rows(B.empty(spark)).collect() == []


def test_mixing_takes_as_many_equal_rows_as_fit(spark):
    words = "w " * 10
    rows = [(7, words, "a")] * 40 + [(i, words, "a") for i in range(100, 160)] + [(i, words, "b") for i in range(200, 300)]
    rows += [(8, words, None)] * 50 + [(9, "", "a")] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    for seed in ("mix", "s1", "s2"):  # the repeated key lies elsewhere in the order
        for weights in ((5, 2, 1), (1, 9, 2), (3, 1, 4)):
            got = mixing.mix(docs, weights=weights, seed=seed).collect()
            assert sorted((r.doc_id, r.size) for r in got) == sorted((r[0], len(r[1].split())) for r in rows)
            taken = {}
            for r in got:  # sources differ in size
                taken[r.source_size, r.target] = taken.get((r.source_size, r.target), 0) + r.taken
            assert len(taken) == 3 and all(abs(n - int(t)) <= 5 for (_, t), n in taken.items())
    one = mixing.mix(docs, weights=(1, 9, 2))
    assert mixing.mixed_rows(docs, weights=(1, 9, 2)).count() == sum(r.copies for r in one.collect())


def test_targets_share_excess(spark):
    sizes = spark.createDataFrame([(("a",), 10), (("b",), 100), (("c",), 1000), ((None,), 5), (("\U0001F600",), 0)],
                                  "_src struct<s:string>, source_size bigint")
    got = {r._src.s: r.target for r in mixing.source_targets(sizes).collect()}
    weight, cap = dict(zip(["a", "b", "c", "\U0001F600", None], [5, 2, 1, 5, 2])), {"a": 30, "b": 300, "c": 3000, None: 15, "\U0001F600": 0}
    full, left, open_ = {}, 1115, set(cap)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] >= cap[s]]
        if not over:
            break
        for s in over:
            full[s] = cap[s]
            left -= cap[s]
            open_.discard(s)
    assert got == pytest.approx(full | share)
