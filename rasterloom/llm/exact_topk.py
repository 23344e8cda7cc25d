"""Exact top-k by integer inner product, with the threshold algorithm over sorted lists.

Components become floor(256 x).  Candidates are dealt to tasks in blocks of BLOCK rows; a block sorts
its rows once along every dimension.  A query reads all lists side by side, from the top where its own
component is positive and from the bottom where it is negative, in rounds of doubling depth.  A row met
for the first time in any list is scored whole at once (random access).  A row not met yet lies, in
every dimension, at or under the last value read, so the query's inner product with these values bounds
its score; the block is left as soon as that bound is under the k-th score found, a strict comparison
as an equal score could win its tie.  Blocks' best k meet in one ranking: the result depends neither
on blocks nor on cores.

How early a query stops is the data's matter.  Where few dimensions carry the scores, lists are left
after a small share of their rows; on isotropic vectors of many dimensions the bound falls slowly and
a query meets nearly all rows, each still scored once.

Scores are exact: single or double precision is used only where the products' sums provably stay
below 2^24 or 2^53, else Python's integers; a score beyond the range of longs is clamped to it, and so
is a component (Spark's floor does that).

The stated query set meets all rows in blocks: a task holds one block and streams the written query
table past it in pieces.  Nothing goes to the driver but the vectors' length.

Defined results.  Vectors that are null, hold null or non-finite components, or are not of the table's
most common length (the shorter of equals) take no part, nor do rows with a null identifier.  Zero
vectors do.  Ties go to the smaller identifier.  Rows that repeat an identifier are candidates each;
of such query rows the one whose components sort first asks, and none of them is its candidate.  Fewer
candidates than k: all of them.  An empty table, or one without queries, gives no rows.  Extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import light, stored

K, SCALE, BLOCK, PIECE, DEPTH = 5, 256, 1 << 15, 512, 16
LEAST, MOST = -(1 << 63), (1 << 63) - 1
_FOUND = "query_id long, vec_id long, score long"


class SortedLists:
    """Rows of integers in identifier order, with their places by ascending component along each dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.ids, self.rows = ids, rows
        self.places = np.ascontiguousarray(np.argsort(rows, axis=0, kind="stable").T.astype(np.int32))
        self.values = np.take_along_axis(rows.T, self.places, 1)
        self.reach = int(max(abs(int(rows.max())), abs(int(rows.min())))) if rows.size else 0
        self.forms: dict[type, np.ndarray] = {}

    def form(self, q: np.ndarray) -> type:
        """A number type in which every partial sum of q's products is exact."""
        bound = self.reach * sum(abs(int(x)) for x in q)
        return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else object

    def as_type(self, kind: type) -> np.ndarray:
        if kind not in self.forms:
            self.forms[kind] = self.rows.astype(kind)
        return self.forms[kind]

    def top(self, q: np.ndarray, k: int, lo: int = 0, hi: int = 0) -> tuple[np.ndarray, list[int], int]:
        """Places and scores of q's k best rows outside the places lo to hi, the first of equals; and the depth read."""
        n, kind = len(self.ids), self.form(q)
        rows, asked = self.as_type(kind), q.astype(kind)
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        if not up.size + down.size:  # every score is 0: any list will do
            up = np.arange(min(1, len(q)))
        met = np.zeros(n, bool)
        met[lo:hi] = True
        best, score, depth, step = np.empty(0, np.int64), np.empty(0, kind), 0, DEPTH
        while depth < n:
            end = min(n, depth + step)
            now = np.zeros(n, bool)
            if len(q):
                now[self.places[up, n - end : n - depth]] = True
                now[self.places[down, depth:end]] = True
            else:
                now[:] = True
            now &= ~met
            met |= now
            new = np.flatnonzero(now)
            made = rows[new] @ asked
            if kind is object:
                made = np.array([clamped(x) for x in made], object)
            if best.size == k:
                worth = made >= score[-1]
                new, made = new[worth], made[worth]
            best, score = np.concatenate([best, new]), np.concatenate([score, made])
            order = np.lexsort((best, -score))[:k]
            best, score = best[order], score[order]
            depth, step = end, 2 * step
            if best.size == k and int(score[-1]) > self.bound(q, up, down, end):
                break
            if met.all():
                break
        return best, [int(x) for x in score], depth

    def bound(self, q: np.ndarray, up: np.ndarray, down: np.ndarray, depth: int) -> int:
        """No row outside the first depth rows of all lists scores more."""
        last = np.concatenate([self.values[up, len(self.ids) - depth], self.values[down, depth - 1]])
        return clamped(sum(int(a) * int(b) for a, b in zip(np.concatenate([q[up], q[down]]), last)))


def clamped(x: int) -> int:
    return min(max(x, LEAST), MOST)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _queries(uris: list[str], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for uri in uris:
        fs, path = pafs.FileSystem.from_uri(uri)
        with fs.open_input_file(path) as f:
            for b in pq.ParquetFile(f).iter_batches(PIECE, columns=["vec_id", "v"]):
                if b.num_rows:
                    yield b.column(0).to_numpy(), _matrix(b.column(1), dim)


def _search(dim: int, uris: list[str], k: int):  # noqa: ANN202
    def meet(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).sort_by("vec_id").combine_chunks()
        lists = SortedLists(t["vec_id"].to_numpy(), _matrix(t["v"].combine_chunks(), dim))
        for qid, q in _queries(uris, dim):
            lo, hi = np.searchsorted(lists.ids, qid), np.searchsorted(lists.ids, qid, side="right")
            who, ids, scores = [], [], []
            for i in range(len(qid)):
                places, score, _ = lists.top(q[i], k, lo[i], hi[i])
                who.append(np.full(len(places), qid[i]))
                ids.append(lists.ids[places])
                scores += score
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(who), pa.int64()), pa.array(np.concatenate(ids), pa.int64()), pa.array(scores, pa.int64())], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                part = b.slice(at, BLOCK - n)
                held.append(part)
                n, at = n + part.num_rows, at + part.num_rows
                if n == BLOCK:
                    yield from meet(held)
                    held, n = [], 0
        if n:
            yield from meet(held)

    return light(run)


def usable(vectors: DataFrame, scale: int = SCALE) -> tuple[DataFrame, int]:
    """(vec_id, v) of the vectors that take part, v in integers, and their length."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole)
    common = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    dim = common["d"] if common else 0
    return rows.filter(F.size("embedding") == dim).select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale)).alias("v")), dim


def top_k(vectors: DataFrame, queries: str = "vec_id % 50 = 0", k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of vectors (vec_id, embedding) that queries selects."""
    spark = vectors.sparkSession
    rows, dim = usable(vectors)
    rows = stored(rows, "topk-vectors")
    asked = stored(rows.filter(queries).groupBy("vec_id").agg(F.min("v").alias("v")), "topk-queries")
    uris = [u if "://" in u or not u.startswith("file:") else "file://" + u[5:] for u in asked.inputFiles()]
    blocks = max(2 * spark.sparkContext.defaultParallelism, -(-rows.count() // BLOCK))
    found = rows.repartition(blocks).mapInArrow(_search(dim, uris, k), _FOUND)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP13_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
