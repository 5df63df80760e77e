"""Neighbours against brute force; the pipeline against its operators' brute force."""
import numpy as np
import pytest

import brute as B
import corpus_pipeline
from editlake.llm import neighbours


def _nearest(rows, k):
    out = {}
    for q, x in rows:
        if q % 20 == 0:
            s = sorted((-sum(np.cumsum(np.multiply(x, y))[-1:]), i) for i, y in rows if i != q)
            out[q] = [(i, -float(v)) for v, i in s[:k]]
    return out


@pytest.mark.parametrize("n,copies,range_rows", [(0, 0, 50), (15, 0, 50), (400, 150, 50), (400, 0, 4096)])
def test_neighbours_equal_brute_force(spark, n, copies, range_rows):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 5)).astype(np.float32)
    x[:copies] = x[:1]
    rows = [(i, x[i].astype(float).tolist()) for i in range(n)]
    odd = [(1000, None), (1001, [0.0] * 5), (1002, [1.0, None, 2.0, 3.0, 4.0]), (1020, [float("nan")] * 5), (1040, [1.0]),
           (1003, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (None, [1.0] * 5)]
    table = spark.createDataFrame(rows + rows[:3] + (odd if n else []), "vec_id bigint, embedding array<float>").selectExpr(
        "*", "1 as id", "2 as vec", "3 as keys").repartition(4)
    got = {}
    for r in sorted(neighbours.search(table, lambda i: i % 20 == 0, range_rows=range_rows).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert got == _nearest(rows, 20)


def test_windows_alone_reach_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    x, ids = np.array([v for _, v in rows], float), np.array([i for i, _ in rows])
    got = {}
    for r in neighbours.search(table, lambda i: i % 20 == 0, exact=False, range_rows=500).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        hits.append(len(got[ids[i]] & set(ids[np.argsort(-s)[:20]].tolist())) / 20)
    assert np.mean(hits) >= 0.9


def test_hilbert_steps_are_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = neighbours.hilbert(grid, 3)
    assert sorted(key.tolist()) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_stages_take_messy_and_empty_tables(spark):
    for docs in (B.messy(spark), B.empty(spark)):
        rows = {tuple(r) for r in docs.collect()}
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns, name
            assert {tuple(r) for r in out.collect()} <= rows, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()


def test_pipeline_keeps_what_brute_force_keeps(spark):
    sf = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.n_tokens for r in got} <= {B.bpe(t)[0] for t in docs.values()}
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == B.bpe(docs[r.doc_id])
        assert not B.base_metrics(docs[r.doc_id])[-1]
    ids = sorted({r.doc_id for r in got})
    fps = [B.fingerprint(docs[i]) for i in ids]
    assert all((a ^ b).bit_count() > 4 for k, a in enumerate(fps) for b in fps[:k])
