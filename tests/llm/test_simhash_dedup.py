import itertools

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rasterloom.llm.simhash_dedup import RADIUS, fingerprint, forest, keep_one, masks, near_groups

SCHEMA = "doc_id long, text string, fp int"


def plain(rows):
    fps = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        shingles = [b" ".join(w[j : j + 3]) for j in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0)
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= RADIUS:
            up[top(b)] = top(a)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = top(k)
        least[r] = min(x for x in (least.get(r), i) if x is not None) if (least.get(r), i) != (None, None) else None
    return sorted((i or -1, f"{fps[k]:016x}", least[top(k)]) for k, (i, _) in enumerate(rows))


def found(df, **kw):
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return sorted((r[0] or -1, r[1], r[2]) for r in near_groups(df, **kw).select("doc_id", hexed, "component_id").collect())


@pytest.mark.parametrize("step", [1, 4])
def test_masks_cover(step):
    family = masks(step)
    assert len(set(family)) == 2 ** (RADIUS + 1) - 1
    for places in itertools.combinations(range(64), RADIUS):
        d = sum(1 << i for i in places)
        assert any(m & d == 0 for m in family)


@pytest.mark.parametrize("bucket", [4096, 1])
def test_equals_all_pairs(spark, bucket):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    words = rows[0][1].split()
    rows += [(1000 + k, " ".join(words[:k] + ["x"] + words[k + 1 :])) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, bucket=bucket) == plain(rows)


def test_defined_cases(spark):
    rows = [(3, "a b", 1), (1, None, 2), (None, "", 3), (2, "a b", 4), (2, "a b", 5), (7, " \t", 1), (9, "w " * 200_000, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df) == plain([r[:2] for r in rows])
    kept = keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 9]
    assert near_groups(df.filter("false")).count() == 0 and keep_one(df.filter("false")).count() == 0
    assert fingerprint(b"") == 0


def test_forest_connects():
    rng = np.random.default_rng(1)
    fps = np.unique(np.concatenate([np.uint64(5) ^ (np.uint64(1) << rng.integers(0, 8, 60).astype(np.uint64)), rng.integers(0, 2**62, 40).astype(np.uint64)]))
    near = {(int(a), int(b)) for a, b in itertools.combinations(fps.tolist(), 2) if (a ^ b).bit_count() <= RADIUS}

    def classes(edges):
        up = {int(x): int(x) for x in fps}

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            up[max(top(a), top(b))] = min(top(a), top(b))
        return [top(int(x)) for x in fps]

    links = forest(fps)
    assert classes(links) == classes(near) and len(links) < len(fps)
