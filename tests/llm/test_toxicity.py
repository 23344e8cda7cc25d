import random

from pyspark.sql import functions as F

from rasterloom.llm.toxicity import Model, keep_clean, maximal_segments, op2_toxicity, scored, significant, train


def plain_segments(v):
    """The maximum-scoring run, then the same on either side of it."""
    sums = [0.0]
    for x in v:
        sums.append(sums[-1] + x)

    def rec(a, b):
        best = max(((sums[j] - sums[i], -i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
        if best is None or best[0] <= 1e-12:
            return []
        i, j = -best[1], best[2]
        return [*rec(a, i), (i, j), *rec(j, b)]

    return rec(0, len(v))


def test_segments_equal_plain_search():
    rng = random.Random(3)
    for _ in range(1500):
        v = [rng.choice([-1.37, -1.37, rng.uniform(0.1, 5)]) for _ in range(rng.randint(1, 14))]
        at = [i for i, x in enumerate(v) if x != -1.37]
        assert [(a, b) for a, b, _ in maximal_segments(at, [v[i] for i in at], -1.37)] == plain_segments(v)


def test_segments_are_linear():
    n = 200_000
    assert len(maximal_segments(list(range(0, 10 * n, 10)), [1.0] * n, -1.0)) == n


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    found = op2_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out")
    got = {(r.toxic, r.predicted): r["count"] for r in found.groupBy("toxic", "predicted").count().collect()}
    assert got[1, 1] / (got[1, 1] + got.get((1, 0), 0)) > 0.8
    assert got.get((0, 1), 0) / (got[0, 0] + got.get((0, 1), 0)) < 0.02


def test_labels_are_no_input(spark):
    """Held-out labels change nothing."""
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = train(docs, labels), train(docs, turned)
    assert a.scores == b.scores and (a.slope, a.base) == (b.slope, b.base)


def test_defined_cases(spark):
    df = spark.createDataFrame([(1, None, 2), (None, "vile vile", 3), (2, "", 4), (2, "word " * 100_000, 5)], "doc_id long, text string, score int")
    model = Model(scores={"vile": 4.0}, lam=2.0, k=0.01, slope=1.0, base=-3.0, trained=True)
    rows = scored(df, model, *df.columns).collect()
    assert [r[3] >= 0.3 for r in sorted(rows, key=lambda r: r[2])] == [False, True, False, False]
    assert significant(2, [(0, 2, 8.0)], model)
    nothing = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert not train(df, nothing).trained
    kept = keep_clean(df, nothing)
    assert kept.count() == 4 and kept.columns == df.columns
    assert keep_clean(df.filter("false"), nothing).count() == 0


def test_lexicon_without_limit(spark):
    """A lexicon that is joined as a table holds the same tokens and gives the same scores as one that is broadcast."""
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    whole, cut = train(docs, labels), train(docs, labels, limit=48 * 30)
    rest = {r.token: r.s for r in cut.rest.collect()}
    assert whole.rest is None and len(cut.scores) + len(cut.plain) == 30 and rest
    assert {**cut.scores, **rest} == whole.scores
    a, b = ({r.doc_id: r for r in scored(docs, m, "doc_id").collect()} for m in (whole, cut))
    assert set(a) == set(b) and all(abs(a[k].score - b[k].score) < 1e-9 for k in a)
    assert [[x[:2] for x in a[k].passages] for k in a] == [[x[:2] for x in b[k].passages] for k in a]
    assert any(r.passages for r in b.values())


def plain_query(docs, labels):
    """The whole query again, by the docstring alone: counts, shrunken log-odds, segments, extreme values, logistic curve."""
    import math
    import re
    import zlib

    import numpy as np

    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    toxic = {}
    for i, y in labels:
        if i is not None and y in (0, 1) and not held(i):
            toxic[i] = max(toxic.get(i, 0), y)
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    count = [{}, {}]
    for i, t in docs:
        if i in toxic:
            for w in set(cut(t)):
                count[toxic[i]][w] = count[toxic[i]].get(w, 0) + 1
    n0, n1 = (sum(c.values()) for c in count)
    prior = 0.1 * (n0 + n1)
    lexicon, p = {}, {}
    for w in set(count[0]) | set(count[1]):
        y0, y1 = count[0].get(w, 0), count[1].get(w, 0)
        a = 0.1 * (y0 + y1)
        odds = math.log((y1 + a) / (n1 + prior - y1 - a)) - math.log((y0 + a) / (n0 + prior - y0 - a))
        error = math.sqrt(1 / (y1 + a) + 1 / (y0 + a))
        if abs(odds) > 2 * error:
            lexicon[w], p[w] = math.copysign(abs(odds) - 2 * error, odds), (y0 + a) / (n0 + prior)
    rest = max(0.0, 1 - sum(p.values()))
    drift = min(-0.5, -2 * max(0.0, sum(p[w] * s for w, s in lexicon.items())) / max(rest, 1e-9))
    root = lambda x: sum(p[w] * math.exp(x * s) for w, s in lexicon.items()) + rest * math.exp(x * drift) - 1
    low, high = 1e-9, 1.0
    while root(high) < 0:
        high *= 2
    for _ in range(200):
        low, high = ((low + high) / 2, high) if root((low + high) / 2) < 0 else (low, (low + high) / 2)

    def runs(t):
        words = cut(t)
        at = [k for k, w in enumerate(words) if w in lexicon]
        return len(words), [s for *_, s in maximal_segments(at, [lexicon[words[k]] for k in at], drift)]

    found = [(i, *runs(t)) for i, t in docs]
    clean = [(n, max(s, default=0.0)) for i, n, s in found if toxic.get(i) == 0 and n]
    k = min(1.0, max(1e-9, len(clean) / sum(n * math.exp(-high * m) for n, m in clean)))
    evidence = lambda n, s: sum(max(0.0, -math.log(k * n) + high * x) for x in s if k * n * math.exp(-high * x) <= 0.05) if n else 0.0
    x = np.array([evidence(n, s) for i, n, s in found if i in toxic])
    y = np.array([float(toxic[i]) for i, *_ in found if i in toxic])
    scale = max(1.0, float(np.abs(x).mean()))
    w = np.zeros(2)
    a = np.column_stack([x / scale, np.ones_like(x)])
    for _ in range(200):  # the damped maximum, by gradient steps of Newton's size
        q = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w += np.clip(np.linalg.solve(a.T @ (a * (q * (1 - q))[:, None]) + 1e-2 * np.eye(2), a.T @ (y - q) - 1e-2 * w), -4, 4)
    return {i: 1 / (1 + math.exp(-max(-60, min(60, w[1] + max(0.0, w[0] / scale) * evidence(n, s))))) for i, n, s in found}


def test_query_equals_a_plain_version(spark):
    d = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = plain_query(docs, [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{d}/labels.parquet").collect()])
    got = {r.doc_id: r for r in op2_toxicity(spark, d).collect()}
    assert set(got) == set(want) and all(abs(got[i].score - s) < 1e-4 and got[i].predicted == (got[i].score >= 0.3) for i, s in want.items())
    assert len({round(s, 3) for s in want.values()}) > 3


def test_repeated_labels_and_ids(spark):
    docs = spark.createDataFrame([(k, ("vile hate " if k % 5 == 0 else "good day ") * 3 + f"w{k}") for k in range(300)] + [(10, "good day")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(300)], "doc_id long, toxic int")
    twice = labels.unionByName(labels.withColumn("toxic", F.lit(0)))  # the largest counts
    a, b = train(docs, labels), train(docs, twice)
    assert a.scores == b.scores and a.trained and scored(docs, a, "doc_id").filter("doc_id = 10").count() == 2
