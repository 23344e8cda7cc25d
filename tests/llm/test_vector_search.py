from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from rasterloom.llm import vector_search
from rasterloom.llm.vector_search import BLOCK, RERANK, Codebooks, _encode, _search, fit, nearest, op5_nearest_vectors, shortlist


def plain(rows, step=20, k=20):
    """Every pair, in double precision and component order."""
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for i, q in zip(ids, x):
        if i % step == 0:
            s = np.zeros(len(ids))
            for c in range(x.shape[1]):
                s += q[c] * x[:, c]
            out[int(i)] = [(int(ids[j]), float(s[j])) for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
    return out


def test_recall_and_scores(spark):
    d = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    want, got = plain(rows), {}
    for r in op5_nearest_vectors(spark, d).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / (20 * len(want)) >= 0.9
    exact = {(q, i): s for q in want for i, s in want[q]}
    assert all(exact[q, i] == s for q in got for i, s in got[q] if (q, i) in exact)


def test_ties_go_to_smaller_ids(spark):
    same = [1.0, 2.0, 3.0, 4.0]
    rows = [(k, same if k % 2 else [float(k) / 600, 1.0, 0.0, -1.0]) for k in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in nearest(df, rerank=25).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == plain(rows)


def test_shortlist_keeps_first_of_equals():
    e = np.array([[1.0, 5, 5, 5, 5, 0, 9]], np.float32)
    assert sorted(shortlist(e, 3)[0].tolist()) == [1, 2, 6]


def test_beam_is_no_worse_than_greedy():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    books = fit(x, 4, 16)
    err = [float(((x - books.decode(books.encode(x, beam)[0])) ** 2).sum()) for beam in (1, 8)]
    assert err[1] < err[0]
    q = rng.normal(size=(3, 16)).astype(np.float32)
    codes, _ = books.encode(x)
    assert np.allclose(books.estimates(q, codes, np.ones(400, np.float32)), q @ books.decode(codes).T, atol=1e-3)
    assert isinstance(books, Codebooks)


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [inf, 1.0]), (6, [1.0, 2.0, 3.0]), (7, [2.0, 1.0]), (None, [5.0, 5.0]), (8, []), (9, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<float>, score double")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in nearest(df).orderBy("rank").collect()] == [(0, 1, 7, 2.0), (0, 2, 9, 1.0)]
    assert nearest(df.filter("false")).count() == 0
    assert nearest(df.filter("vec_id % 20 <> 0")).count() == 0
    assert nearest(df.filter(F.col("vec_id") == 0)).count() == 0


def test_full_block_is_exact(tmp_path):
    """One block of BLOCK Gaussian vectors, where RERANK is a small share: nothing is missed."""
    x = np.random.default_rng(2).normal(size=(BLOCK, 64)).astype(np.float32)
    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(BLOCK)), pa.array(list(x), pa.list_(pa.float32()))], ["vec_id", "v"])
    pq.write_table(pa.Table.from_batches([rows]).filter(pa.array(np.arange(BLOCK) % 512 == 0)), tmp_path / "q.parquet")
    index = _encode(fit(x[:4096], rounds=3), 64)(rows.slice(k, 1000) for k in range(0, BLOCK, 1000))
    got = {}
    for b in _search(fit(x[:4096], rounds=3), 64, [f"file://{tmp_path}/q.parquet"], 20, RERANK)(index):
        for q, i, s in zip(*(c.to_pylist() for c in b.columns)):
            got.setdefault(q, []).append((i, s))
    assert got == plain(list(enumerate(x)), step=512)


def test_doubles_keep_their_digits(spark):
    rows = [(k, [1.0 + k * 1e-12, 1.0, -1.0]) for k in range(60)] + [(60, [1e200, 0.0, 0.0]), (20, [2.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest(df).filter("query_id = 0").orderBy("rank").collect()
    want = sorted(((sum(a * b for a, b in zip(rows[0][1], v)), i) for i, v in rows if i != 0), key=lambda x: (-x[0], x[1]))[:20]
    assert [(r.score, r.vec_id) for r in got] == want


def test_codes_decide_what_is_scored(tmp_path, monkeypatch):
    """Fewer rows are scored the better the codes are; codes that say nothing leave all of them, and the same result."""
    x = np.random.default_rng(3).normal(size=(4096, 64)).astype(np.float32)
    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(4096)), pa.array(list(x), pa.list_(pa.float32()))], ["vec_id", "v"])
    pq.write_table(pa.Table.from_batches([rows]).filter(pa.array(np.arange(4096) % 64 == 0)), tmp_path / "q.parquet")
    scored, real = [], vector_search.best

    def counted(q, v, who, place, k):
        scored.append(who.size)
        return real(q, v, who, place, k)

    monkeypatch.setattr(vector_search, "best", counted)
    books = fit(x, rounds=3)
    share, results = [], []
    for b in (books, replace(books, words=books.words[:8]), replace(books, words=np.zeros_like(books.words))):
        scored.clear()
        out = [list(zip(*(c.to_pylist() for c in r.columns))) for r in _search(b, 64, [f"file://{tmp_path}/q.parquet"], 20, RERANK)(_encode(b, 64)([rows]))]
        results.append(sorted(sum(out, [])))
        share.append(sum(scored) / (64 * 4095))
    assert results[0] == results[1] == results[2]
    assert share[0] < 0.2 < share[1] and share[2] > 0.99, share


def test_estimates_stay_within_their_bound():
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(500, 24)) * rng.lognormal(size=(500, 1)), rng.normal(size=(40, 24))
    for stages in (1, 12):
        books = fit(x[:200], stages, 16)
        t = next(_encode(books, 24)([pa.RecordBatch.from_arrays([pa.array(np.arange(500)), pa.array(list(x), pa.list_(pa.float64()))], ["vec_id", "v"])]))
        codes = np.frombuffer(b"".join(t["codes"].to_pylist()), np.uint8).reshape(500, -1)
        way = vector_search._directions(q)
        est = books.estimates(way.astype(np.float32), codes, vector_search._scale(t["norm"].to_numpy(), t["short"].to_numpy()))
        assert (np.abs(est - way @ x.T) <= t["rest"].to_numpy()).all()


def test_doubles_beyond_floats(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(c) for c in rng.normal(size=4) * 10.0 ** (150 if k % 3 else -60)]) for k in range(100)]
    got = {}
    with np.errstate(all="raise", under="ignore"):
        for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for i, v in rows[::20]:
        want = []
        for j, w in rows:
            s = 0.0
            for a, b in zip(v, w):
                s += a * b
            want.append((-s, j))
        assert got[i] == [(j, -s) for s, j in sorted(x for x in want if x[1] != i)][:20]
