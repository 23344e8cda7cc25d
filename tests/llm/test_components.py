import random

import pytest
from pyspark.sql import functions as F

from rasterloom.llm import components as c
from rasterloom.llm.simhash_dedup import keep_one


def plain(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        lo, hi = sorted((top(a), top(b)))
        up[hi] = lo
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    return sorted((x, top(x)) for x in up if x not in loops)


def graphs():
    rng = random.Random(3)
    chain = list(range(200))
    rng.shuffle(chain)
    yield []
    yield [(5, 5)]
    yield [*zip(chain, chain[1:]), (3, 3), (1000, 2000), (2000, 1000), (1000, 2000)]
    yield [(-9, k) for k in range(50)] + [(k, 1 << 62) for k in range(100, 150)] + [(-(1 << 63), (1 << 63) - 1)]
    yield [(rng.randrange(300), rng.randrange(300)) for _ in range(150)]


@pytest.mark.parametrize("most", [c.LOCAL, 0])
def test_equals_plain(spark, most, monkeypatch):
    monkeypatch.setattr(c, "LOCAL", most)
    for edges in graphs() if most else list(graphs())[1:4:2]:
        df = spark.createDataFrame(edges, "x long, y long")
        assert sorted(map(tuple, c.components(df, "x", "y").collect())) == plain(edges)


def test_near_dedup_is_light_on_the_driver(spark):
    """Every job and every copy of a plan costs the driver memory, however small the table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.unionByName(docs.withColumns({"doc_id": F.col("doc_id") + 10**6, "text": F.concat("text", F.lit(" x"))}))
    sc = spark.sparkContext
    sc.setJobGroup("near", "near")
    try:
        keep_one(docs).count()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
    tracker = sc.statusTracker()
    jobs = tracker.getJobIdsForGroup("near")
    stages = sum(len(tracker.getJobInfo(j).stageIds) for j in jobs)
    assert 0 < len(jobs) <= 90 and stages <= 160
