"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing.

A fingerprint has 64 bits; two documents link at RADIUS or fewer differing bits.  Each bit position
i gets a nonzero vector m(i) of RADIUS + 1 bits; the table of a nonzero vector v masks the positions
with an odd number of ones in m(i) & v.  Any RADIUS positions are orthogonal to some nonzero v, so
every pair within the radius agrees on the whole mask of some table: no pair is missed.

Copies of a fingerprint are one row from the start, so a text that fills a third of the table costs
one row.  A bucket of over BUCKET fingerprints is split by a second, independent covering family on
the positions left free; what remains there has at most 2 ** (free bits) fingerprints, a bound that
doesn't grow with the input.  Within a bucket only a spanning forest of the links leaves the task,
never all pairs.  Components come from written edge tables, not from the driver.

Defined results.  Null or empty text, and text of white space, has fingerprint zero, linked like any
other.  A null identifier takes a component like any row and is never its representative unless all
identifiers of the component are null.  Repeated rows are listed as often as they come.  An empty
table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, fresh, light, small, stored
from .components import components
from .shingle_join import SHINGLE as NEAR_SHINGLE
from .shingle_join import similar_groups

RADIUS, SHINGLE, BUCKET = 3, 3, 4096
_PIECE = 1 << 17  # shingles turned into bits at once


def _vectors(step: int) -> list[int]:
    """A nonzero vector of RADIUS + 1 bits for each of 64 positions, spread evenly."""
    n = (1 << (RADIUS + 1)) - 1
    return [1 + (i * step + i // n) % n for i in range(64)]


def masks(step: int = 1) -> list[int]:
    """The covering family: one 64-bit mask for each nonzero v."""
    m = _vectors(step)
    return [sum(1 << i for i in range(64) if (m[i] & v).bit_count() & 1) for v in range(1, 1 << (RADIUS + 1))]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a whole text's shingles of so many words."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-shingle].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    set_bits = np.zeros(64, np.int64)
    for k in range(0, len(starts), _PIECE):
        hashes = map(xxhash.xxh64_intdigest, [line[a:b] for a, b in zip(starts[k : k + _PIECE], stops[k : k + _PIECE])], repeat(42))
        bits = np.unpackbits(np.fromiter(hashes, np.dtype("<u8"), len(starts[k : k + _PIECE])).view(np.uint8), bitorder="little")
        set_bits += bits.reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(set_bits * 2 > len(starts), bitorder="little").tobytes(), "little")


def _fingerprints(shingle: int):  # noqa: ANN202
    @light
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            fp = pa.array([signed(fingerprint(t, shingle)) for t in texts], pa.int64())
            mark = pa.array([signed(xxhash.xxh64_intdigest(t, 42)) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), fp, mark], ["doc_id", "fp", "mark"])

    return run


def forest(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that join what is within radius, a spanning forest only.  Breadth first, one row of distances at a time."""
    left, out = fps, []
    while left.size > 1:
        root, front, left = left[0], [left[0]], left[1:]
        while front and left.size:
            near = np.bitwise_count(left ^ front.pop()) <= radius
            if near.any():
                got = left[near]
                out += zip(repeat(int(root)), got.tolist())
                front += list(got)
                left = left[~near]
    return out


@light
def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket columns..., fp), sorted by bucket: the forest of each bucket; buckets may straddle batches."""
    held, key = [], None
    names = ["a", "b"]

    def close() -> list[tuple[int, int]]:
        fps = np.concatenate(held) if held else np.empty(0, np.int64)
        if fps.size == 2:
            return [(int(fps[0]), int(fps[1]))] if int(np.bitwise_count(fps[0] ^ fps[1])) <= RADIUS else []
        return forest(fps)

    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        turn = np.zeros(b.num_rows, bool)
        for c in cols[:-1]:
            turn[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(turn).tolist(), b.num_rows]
        fps, out = cols[-1].view(np.uint64), []
        for lo, hi in zip(cuts, cuts[1:]):
            now = tuple(c[lo] for c in cols[:-1])
            if now != key:
                out += close()
                held, key = [], now
            held.append(fps[lo:hi])
        yield _pairs(out, names)
    yield _pairs(close(), names)


def _pairs(out: list[tuple[int, int]], names: list[str]) -> pa.RecordBatch:
    both = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names)


def _bucket_links(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.repartition(*by).sortWithinPartitions(*by).select(*by, "fp").mapInArrow(_links, "a long, b long")


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between distinct fingerprints, enough to connect all that links connect."""

    def tables(of: list[int], t: str, key: str, also: str = "-1L") -> Column:
        return F.explode(F.array(*[F.struct(F.lit(i).alias(t), F.expr(f"fp & {signed(m)}L & {also}").alias(key)) for i, m in enumerate(of)]))

    rows = fps.select("fp", tables(masks(), "t", "k").alias("x")).select("x.t", "x.k", "fp")
    sizes = rows.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sized = rows.join(sizes, ["t", "k"])
    if sizes.filter(F.col("n") > bucket).isEmpty():
        return _bucket_links(sized, ["t", "k"])
    sized = stored(sized, "buckets")
    free = F.element_at(F.array(*[F.lit(signed(~m & (1 << 64) - 1)) for m in masks()]), F.col("t") + 1)
    deep = sized.filter(F.col("n") > bucket).withColumn("free", free).select("t", "k", "fp", tables(masks(4), "t2", "k2", "free").alias("x")).select("t", "k", "x.t2", "x.k2", "fp")
    return _bucket_links(sized.filter(F.col("n") <= bucket), ["t", "k"]).unionByName(_bucket_links(deep, ["t", "k", "t2", "k2"]))


def near_groups(docs: DataFrame, bucket: int = BUCKET, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, mark (hash of the text), root (least fingerprint of the component), component_id."""
    found = stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints(shingle), "doc_id long, fp long, mark long"), "fingerprints")
    classes = stored(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(links(classes, bucket), "a", "b")
    classes = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = classes.join(least, "root").select("fp", "root", "component_id")
    return found.join(named, "fp").select("doc_id", "fp", "mark", "root", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each group: that of the smallest identifier; columns unchanged.

    Groups here are components of similarity 0.8 of five-word shingle sets.  The covering tables' components
    over five-word fingerprints say which documents to compare first; the exact join does the rest, as
    pairs at that similarity differ in more bits than tables could cover.
    """
    sketched = stored(near_groups(docs, shingle=NEAR_SHINGLE), "sketches")
    groups = stored(similar_groups(docs, sketched), "near-groups")
    firsts = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = firsts.groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("s"))
    key, mark, nth = fresh(docs, "near_id", "near_mark", "near_nth")
    stay = stay.select(F.col("s.doc_id").alias(key), F.col("s.mark").alias(mark))
    out = docs.join(small(stay, 32), docs["doc_id"].cast("long").eqNullSafe(F.col(key)) & (_mark(docs["text"]) == F.col(mark)), "left_semi")
    if not firsts.groupBy("doc_id", "mark").count().filter("count > 1").isEmpty():
        out = out.withColumn(nth, F.row_number().over(W.partitionBy("doc_id", "text").orderBy(F.lit(0)))).filter(F.col(nth) == 1)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def _mark(text: Column) -> Column:
    """The same hash as mark."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
