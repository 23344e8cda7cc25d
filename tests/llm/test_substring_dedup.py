import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm.relative_parse import Index, factors, parsed_without_repeats
from rasterloom.llm.substring_dedup import OP6_SQL, WINDOW, op6_substring_dedup, without_repeats

SCHEMA = "doc_id long, text string, mark int, n int"


def plain(rows):
    """(doc_id, words, removed, kept) by looking at every window."""
    split = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for k in sorted(range(len(split)), key=lambda k: (split[k][0] is not None, split[k][0] or 0)):
        i, w = split[k]
        for s in range(len(w) - WINDOW + 1):
            first.setdefault(tuple(w[s : s + WINDOW]), (i, k, s))
    out = []
    for k, (i, w) in enumerate(split):
        gone = set()
        for s in range(len(w) - WINDOW + 1):
            d, row, at = first[tuple(w[s : s + WINDOW])]
            earlier = (d is None and i is not None) or (d is not None and i is not None and d < i)
            own = next(x for x in range(s + 1) if w[x : x + WINDOW] == w[s : s + WINDOW]) < s
            if earlier or own:
                gone.update(range(s, s + WINDOW))
        out.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return sorted(map(repr, out))


def test_equals_sql(against_sql):
    against_sql(op6_substring_dedup, OP6_SQL)


def shared_passages(seed=4):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(30)]
    passages = [[rng.choice(words) for _ in range(rng.randint(15, 70))] for _ in range(6)]
    rows = []
    for k in range(60):
        text = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a = rng.randint(0, 10)
            text += p[a : len(p) - rng.randint(0, 10)] if rng.random() < 0.7 else [rng.choice(words) for _ in range(rng.randint(1, 30))]
        if rng.random() < 0.1:
            text = ["same"] * rng.randint(15, 60)
        rows.append((k * 3, " \t".join(text)))
    return rows


def test_equals_plain_search_on_shared_passages(spark):
    rows = shared_passages()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(repr(tuple(r)) for r in without_repeats(df).collect()) == plain(rows)


@pytest.mark.parametrize("block", [60, 100_000])
def test_the_parse_against_every_block_agrees(spark, block):
    rows = shared_passages(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(repr(tuple(r)) for r in parsed_without_repeats(df, block).collect()) == plain(rows)


def test_factors_are_greedy():
    words = np.array([1, 2, 3, 4, 9, 1, 2, 5])
    index = Index(words)
    assert list(factors(index, np.array([1, 2, 3, 7, 2, 5, 1, 2, 5, 5]), 100)) == [(0, 3), (3, 1), (4, 2), (6, 3), (9, 1)]
    assert index.longest(words, 5, 5) == 2 and index.longest(words, 0, 0) == 0
    rng = random.Random(0)
    for _ in range(30):
        ref, text = ([rng.randint(0, 2) for _ in range(rng.randint(1, 200))] for _ in "rt")
        index, before = Index(np.array(ref)), rng.randint(0, 200)
        for s in range(0, len(text), 7):
            want = max((next((n for n in range(min(len(ref) - p, len(text) - s)) if ref[p + n] != text[s + n]), min(len(ref) - p, len(text) - s)) for p in range(min(before, len(ref)))), default=0)
            assert index.longest(np.array(text), s, before) == want


def test_defined_cases(spark):
    p = " ".join(f"p{k}" for k in range(25))
    rows = [(None, p, 1, 1), (2, p, 1, 1), (3, None, 1, 1), (4, "", 1, 1), (5, "a\x85b 　 c", 1, 1), (6, p + " tail", 1, 1), (6, "head " + p, 1, 1), (7, "z " * 100_000, 1, 1), (8, "short " + " ".join(p.split()[:19]), 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(repr(tuple(r)) for r in without_repeats(df).collect()) == plain([r[:2] for r in rows])
    few = df.withColumn("text", F.when(df.doc_id == 7, F.lit("z " * 3000)).otherwise(df.text))
    assert sorted(repr(tuple(r)) for r in parsed_without_repeats(few, 40).collect()) == plain([(r.doc_id, r.text) for r in few.collect()])
    again = spark.createDataFrame([(1, p, 1, 1), (1, p, 1, 1)], SCHEMA)  # rows of one doc_id aren't earlier than one another
    assert [r.n_removed for r in without_repeats(again).collect()] == [0, 0]
    assert [r.n_removed for r in parsed_without_repeats(again).collect()] == [0, 0]
    assert without_repeats(df.filter("false")).count() == 0 and parsed_without_repeats(df.filter("false")).count() == 0
