import bisect
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from rasterloom.llm import mixing
from rasterloom.llm.mixing import golden, materialise, mix, op10_mix_sources, sized_rows, targets


def plain_targets(sizes):
    """Weights 3, 1, 2; shares of 150 %; one source closed at a time."""
    w = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    closed = set()
    while True:
        left = Fraction(3, 2) * sum(sizes) - sum(2 * sizes[i] for i in closed)
        goal = [Fraction(2 * s) if i in closed else left * w[i] / sum(w[k] for k in range(len(sizes)) if k not in closed) for i, s in enumerate(sizes)]
        over = [i for i in range(len(sizes)) if i not in closed and goal[i] > 2 * sizes[i]]
        if not over:
            return goal
        closed.add(max(over, key=lambda i: goal[i] / sizes[i] if sizes[i] else Fraction(10**9)))


def test_targets():
    for sizes in ([10, 10, 10], [1, 1000, 5], [0, 0, 7, 100], [5], [100, 1, 1, 1, 1, 1000]):
        assert targets(sizes) == plain_targets(sizes)
        assert sum(targets(sizes)) == Fraction(3, 2) * sum(sizes)
    assert targets([]) == []


def test_golden_is_even():
    x = golden(0, 10_000)
    assert all(abs((x < k / 20).mean() - k / 20) < 0.002 for k in range(21))
    assert abs(golden(5000, 10) - x[5000:5010]).max() < 1e-9


def test_query(spark):
    rows = op10_mix_sources(spark, "/root/testdata/sf0.01").collect()
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    by = {}
    for r in rows:
        assert r.size == len(docs[r.doc_id].text.encode().split()) and 0 <= r.taken <= 2 * r.size
        by.setdefault(docs[r.doc_id].source, []).append(r)
    names = sorted(by)
    goal = plain_targets([sum(r.size for r in by[s]) for s in names])
    for s, g in zip(names, goal):
        assert {r.target for r in by[s]} == {float(g)} and {r.source_size for r in by[s]} == {sum(r.size for r in by[s])}
        assert sum(r.taken for r in by[s]) == int(g)
        assert len([r for r in by[s] if r.size and r.taken % r.size]) <= 1  # all but the document at the cut are taken whole
    again = op10_mix_sources(spark, "/root/testdata/sf0.01").repartition(3).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_equals_a_plain_schedule(spark):
    """Slot by slot: each takes its source's next block, pass after pass, until the quota; then what words of each document that is."""
    table = sized_rows(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source", "text"))
    rows, got = table.collect(), {r.uid: r.taken for r in mix(table).collect()}
    bits = (len(rows) // mixing.BUCKET_ROWS).bit_length()
    names = sorted({r.source for r in rows})
    streams = {s: [] for s in names}
    for r in sorted(rows, key=lambda r: ((r.h % 2**64) >> (64 - bits), r.h)):
        streams[r.source] += [r.uid] * r.size
    goal = plain_targets([len(streams[s]) for s in names])
    total, edges = sum(goal), []
    for g in goal:
        edges.append((edges[-1] if edges else 0) + float(g / total))
    quota, at, taken, order = {s: int(g) for s, g in zip(names, goal)}, dict.fromkeys(names, 0), dict.fromkeys((r.uid for r in rows), 0), []

    def turn(s):
        n = min(mixing.BLOCK, len(streams[s]) - at[s] % len(streams[s]), quota[s] - at[s])
        for k in range(at[s], at[s] + n):
            taken[streams[s][k % len(streams[s])]] += 1
        at[s] += n

    for x in golden(0, -(-int(total) // mixing.BLOCK)):
        s = names[min(bisect.bisect_right(edges, x), len(names) - 1)]
        order.append(s)
        if streams[s]:
            turn(s)
    for s in names:
        while at[s] < quota[s]:
            turn(s)
    assert got == taken
    made, goals, _ = mixing._sources(spark, table)
    slots = mixing.schedule(spark, goals, made.filter("quota > 0")).filter(f"slot < {len(order)}").join(made.select("sid", "source"), "sid").collect()
    ranks = dict.fromkeys(names, 0)
    for r in sorted(slots, key=lambda r: r.slot):
        assert order[r.slot] == r.source and r.rank == ranks[r.source]
        ranks[r.source] += 1


def test_copies_that_fill_a_bucket_are_cut(spark, monkeypatch):
    rows = [(k, f"w{k} x", "a") for k in range(60)] + [(7000, "same words here", "a")] * 300 + [(8000, "other", "b")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    want = sorted((r.doc_id, r.taken) for r in mix(sized_rows(df)).collect())
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 4)
    got = mix(sized_rows(df)).collect()
    assert len(got) == 400 and all(0 <= r.taken <= 2 * r.size for r in got)
    for s in "ab":
        assert sum(r.taken for r in got if r.source == s) == sum(t for (i, t) in want if (i == 8000) == (s == "b"))
    assert len([r for r in got if r.taken % r.size]) <= 2
    again = sorted((r.doc_id, r.taken) for r in mix(sized_rows(df.repartition(3))).collect())
    assert again == sorted((r.doc_id, r.taken) for r in got)


def test_too_many_sources_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SOURCES", 2)
    with pytest.raises(ValueError, match="sources"):
        mix(sized_rows(spark.createDataFrame([(k, "a", str(k)) for k in range(3)], "doc_id long, text string, source string")))


def test_defined_cases(spark):
    rows = [(1, "a b c", None, 1), (1, "a b c", None, 1), (None, None, "x", 1), (3, "", "x", 2), (4, "q w", "y", 2), (5, "t " * 300_000, "y", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    out = mix(sized_rows(df)).collect()
    assert len(out) == 6 and all(r.taken <= 2 * r.size for r in out) and sum(r.taken for r in out if r.source == "x") == 0
    made = materialise(df)
    assert made.columns == df.columns
    words = made.groupBy("source").agg(F.sum(F.size(F.filter(F.split("text", " "), lambda w: w != ""))).alias("n"))
    want = {s: sum(r.taken for r in out if r.source == s) for s in ("y", None)}
    assert {r.source: r.n for r in words.collect()} == want
    empty = df.filter("false")
    assert mix(sized_rows(empty)).count() == 0 and materialise(empty).count() == 0
