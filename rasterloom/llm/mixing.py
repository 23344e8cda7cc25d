"""Mixing sources to target weights by a low-discrepancy schedule.

Sources in code-point order, null last, weigh 3, 1, 2, repeating.  They share SHARE times all words;
a source's target stops at LIMIT times its own words and what is over is shared again by weight.

A source's documents, in the order of a seeded hash, form one stream of words, cut into blocks of
BLOCK words.  Slot i of the schedule holds the golden-ratio point frac((i + 1) * (sqrt(5) - 1) / 2);
cumulative target shares map it to a source, and its rank among that source's slots names the block
it takes: rank r takes block r mod n in pass r div n.  The few turns by which a source falls short of
its quota, floor(target), follow at the end; what lies beyond a quota is cut, in the last block to
the word.  So each source takes exactly its quota and no document exceeds LIMIT copies.

Scale: ranks and offsets are prefix sums in levels (counts of chunks, then windows inside one chunk of
bounded size), so no source, however large, passes through one task; a block joins one slot
a pass.  Only the totals of sources reach the driver; there may be SOURCES of them, a documented bound beyond
which the call fails.

Defined results.  Null text has size 0 and takes 0; rows that repeat doc_id each have their own place
in the stream; an empty table, or one without words, takes nothing; a null source is a source of its
own, the last.  Equal input gives equal output: order comes from hashes of doc_id and text only.
Extra columns are not read by the query; materialise() passes them on unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, getcontext
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WS, documents, fresh, light, small, stored

WEIGHTS, SHARE, LIMIT = (3, 1, 2), Fraction(3, 2), 2
BLOCK, CHUNK, BUCKET_ROWS, SEED, SOURCES = 256, 1 << 16, 512, 7, 1 << 20


def targets(sizes: list[int], share: Fraction = SHARE, limit: int = LIMIT, weights: tuple[int, ...] = WEIGHTS) -> list[Fraction]:
    """Each source's target words, exactly; sizes are in source order."""
    out, open_, left = [Fraction(0)] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while open_:
        total = sum(weights[i % len(weights)] for i in open_)
        over = {i for i in open_ if left * weights[i % len(weights)] / total > limit * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * weights[i % len(weights)] / total
            break
        for i in over:
            out[i] = Fraction(limit * sizes[i])
        left -= sum(out[i] for i in over)
        open_ -= over
    return out


def golden(first: int, n: int) -> np.ndarray:
    """frac((i + 1) * (sqrt(5) - 1) / 2) for n slots from first: split in two factors, so large i lose no digits."""
    getcontext().prec = 60
    phi = (Decimal(5).sqrt() - 1) / 2
    start = float((phi * (first + 1)) % 1)
    return (start + np.arange(n) * float(phi)) % 1.0


def _slots(edges: list[float], n_slots: int):  # noqa: ANN202
    """Chunks of the schedule: (sid, chunk, slot, rank within the chunk)."""

    @light
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner = np.array(edges[1:-1])
        for b in batches:
            for chunk in b.column(0).to_pylist():
                first = chunk * CHUNK
                n = min(CHUNK, n_slots - first)
                sid = np.searchsorted(inner, golden(first, n), side="right")
                order = np.argsort(sid, kind="stable")
                starts = np.searchsorted(sid[order], np.arange(len(edges) - 1))
                rank = np.empty(n, np.int64)
                rank[order] = np.arange(n) - starts[sid[order]]
                yield pa.RecordBatch.from_arrays([pa.array(sid.astype(np.int64)), pa.array(np.full(n, chunk)), pa.array(first + np.arange(n)), pa.array(rank)], ["sid", "chunk", "slot", "r"])

    return run


def _sources(spark: SparkSession, sized: DataFrame) -> tuple[DataFrame, list[Fraction], list[int]]:
    """The table of sources (source, sid, source_size, target, quota, blocks), its targets and sizes.  Totals only reach the driver."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(SOURCES + 1).collect()
    if len(rows) > SOURCES:
        raise ValueError(f"over {SOURCES} sources: weights by rank want a table of groups, not of single hosts")
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    goal = targets([r["n"] for r in rows])
    made = []
    for i, r in enumerate(rows):
        n, quota, blocks = r["n"], int(goal[i]), -(-r["n"] // BLOCK)
        passes, rest = divmod(quota, n) if n else (0, 0)
        made.append((r["source"], i, n, float(goal[i]), quota, blocks, passes * blocks - (-rest // BLOCK)))
    table = spark.createDataFrame(made, "source string, sid long, source_size long, target double, quota long, blocks long, need long")
    return table, goal, [r["n"] for r in rows]


def schedule(spark: SparkSession, goal: list[Fraction], table: DataFrame) -> DataFrame:
    """(sid, slot, rank): the order in which sources take their turns, as many as their quotas need (need, in table)."""
    total = sum(goal)
    if not total:
        return spark.createDataFrame([], "sid long, slot long, rank long")
    edges = [0.0]
    for g in goal:
        edges.append(edges[-1] + float(g / total))
    n_slots = -(-int(total) // BLOCK)
    n_chunks = -(-n_slots // CHUNK)
    chunks = spark.range(n_chunks, numPartitions=min(n_chunks, spark.sparkContext.defaultParallelism * 4))
    # Written, so that the planner knows the slots' size: from the chunks' it would take them for a side to broadcast.
    slots = stored(chunks.mapInArrow(_slots(edges, n_slots), "sid long, chunk long, slot long, r long"), "slots")
    counts = slots.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("n"))
    base = F.sum("n").over(W.partitionBy("sid").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1))
    before = counts.select("sid", "chunk", F.coalesce(base, F.lit(0)).alias("base"))
    ranked = slots.join(before, ["sid", "chunk"]).select("sid", "slot", (F.col("base") + F.col("r")).alias("rank"))
    # What discrepancy leaves short of a need comes at the end, each source's in turn.
    got = table.join(counts.groupBy("sid").agg(F.sum("n").alias("n")), "sid", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    late = got.filter("n < need").select("sid", F.explode(F.sequence("n", F.col("need") - 1)).alias("rank"), "n")
    return ranked.unionByName(late.select("sid", (F.lit(n_slots) + (F.col("rank") - F.col("n")) * len(goal) + F.col("sid")).alias("slot"), "rank"))


def streams(sized: DataFrame, n_rows: int) -> DataFrame:
    """sized with off: how many words of its source come before each row in hash order.  Prefix sums over rows, buckets and ranges of buckets."""
    bits = max(0, (n_rows // BUCKET_ROWS).bit_length())
    cut = sized.withColumn("bucket", F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long"))
    # Rows that repeat share a hash.  A bucket that they fill is cut by hash, and its copies, which are alike, by row.
    full = cut.groupBy("sid", "bucket").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 8 * BUCKET_ROWS)
    parts = F.ceil(F.col("rows") / BUCKET_ROWS).cast("int")
    cut = cut.join(small(full, 24), ["sid", "bucket"], "left").withColumns({"own": F.when(F.col("rows").isNotNull(), F.col("h")).otherwise(0), "part": F.when(F.col("rows").isNotNull(), F.pmod(F.xxhash64("uid"), parts)).otherwise(0)}).drop("rows")
    key = ["sid", "bucket", "own", "part"]
    first = lambda by, *order: F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = cut.groupBy(*key).agg(F.sum("size").alias("n")).withColumn("upper", F.shiftright("bucket", bits // 2))
    above = sums.groupBy("sid", "upper").agg(F.sum("n").alias("n")).select("sid", "upper", first(["sid"], "upper").alias("above"))
    before = sums.select(*key, "upper", first(["sid", "upper"], "bucket", "own", "part").alias("base")).join(above, ["sid", "upper"]).select(*key, (F.col("base") + F.col("above")).alias("base"))
    inner = F.sum("size").over(W.partitionBy(*key).orderBy("h", "doc_id", "mark", "uid").rowsBetween(W.unboundedPreceding, -1))
    return cut.withColumn("inner", F.coalesce(inner, F.lit(0))).join(before, key).withColumn("off", F.col("base") + F.col("inner")).drop("bucket", "own", "part", "base", "inner")


def mix(sized: DataFrame) -> DataFrame:
    """uid, doc_id, source, size, sid, source_size, target, taken for a written table (uid, doc_id, source, size, h, mark)."""
    spark = sized.sparkSession
    table, goal, _ = _sources(spark, sized)
    rows = sized.withColumnRenamed("source", "own").join(small(table, 96), F.col("own").eqNullSafe(F.col("source"))).drop("own")
    placed = streams(rows, sized.count())
    ends = F.sequence(F.expr(f"off div {BLOCK}"), F.expr(f"(off + size - 1) div {BLOCK}"))
    pieces = placed.filter("size > 0").select("uid", "sid", "off", "size", F.explode(ends).alias("block"))
    pieces = pieces.select("uid", "sid", "block", F.greatest(F.lit(0), F.expr(f"off - block * {BLOCK}")).alias("a"), F.least(F.lit(BLOCK), F.expr(f"off + size - block * {BLOCK}")).alias("b"))
    quotas = table.filter("quota > 0")
    turns = schedule(spark, goal, quotas).join(small(quotas, 96), "sid")
    turns = turns.withColumns({"block": F.expr("rank % blocks"), "done": F.expr(f"(rank div blocks) * source_size + (rank % blocks) * {BLOCK}")})
    takes = turns.select("sid", "block", F.least(F.expr("quota - done"), F.expr(f"source_size - block * {BLOCK}"), F.lit(BLOCK)).alias("w")).filter("w > 0")
    taken = pieces.join(takes, ["sid", "block"]).groupBy("uid").agg(F.sum(F.greatest(F.lit(0), F.least(F.col("w"), F.col("b")) - F.col("a"))).alias("taken"))
    return placed.join(taken, "uid", "left").select("uid", "doc_id", "source", "size", "sid", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def sized_rows(docs: DataFrame, *keep: str) -> DataFrame:
    """A written table: uid, doc_id, source, size (words), h (place in the shuffled stream), mark (hash of the text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    mark = F.xxhash64(text)
    out = docs.select(
        *[F.col(f"`{c}`") for c in keep],
        F.monotonically_increasing_id().alias("uid"),
        *[F.col(c) for c in ("doc_id", "source") if c not in keep],
        F.regexp_count(text, F.lit(WS.replace("[", "[^") + "+")).cast("long").alias("size"),
        F.xxhash64(F.lit(SEED), F.col("doc_id"), mark).alias("h"),
        mark.alias("mark"),
    )
    return stored(out, "sized")


def materialise(docs: DataFrame) -> DataFrame:
    """The mix as documents: a row for each pass that takes all of a document, and one with the first words, joined
    by single spaces, for a pass that takes a part.  Columns are those of docs; n_chars, if there, is kept right."""
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"d{i}") for i, c in enumerate(docs.columns)], "doc_id", "source", "text")
    at = {c: f"d{i}" for i, c in enumerate(docs.columns)}
    whole = sized_rows(renamed, *at.values())
    taken = mix(whole.select("uid", "doc_id", "source", "size", "h", "mark")).filter("taken > 0").select("uid", "taken")
    (n, k) = fresh(whole, "take", "pass")
    rows = whole.join(taken.withColumnRenamed("taken", n), "uid").withColumn(k, F.explode(F.sequence(F.lit(1).cast("long"), F.expr(f"({n} + size - 1) div size"))))
    part = F.expr(f"least(size, {n} - ({k} - 1) * size)")
    text = F.col(at["text"])
    words = F.filter(F.split(text, f"{WS}+"), lambda x: x != "")
    cut = F.when(part < F.col("size"), F.array_join(F.slice(words, F.lit(1), part.cast("int")), " ")).otherwise(text)
    cols = {c: F.col(d) for c, d in at.items()} | {"text": cut}
    if "n_chars" in at:
        cols["n_chars"] = F.when(part < F.col("size"), F.length(cut).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(at["n_chars"]))
    return rows.select(*[cols[c].alias(c) for c in docs.columns])


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(sized_rows(documents(spark, sf_dir).select("doc_id", "source", "text"))).select("doc_id", "source", "size", "source_size", "target", "taken")
