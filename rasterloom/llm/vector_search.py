"""Nearest neighbours by largest inner product, with additive quantisation.

Fit: STAGES codebooks of CODES full-dimensional vectors, each trained by k-means on what the ones
before left over, on at most SAMPLE vectors (those of the smallest hash; a documented bound).  Index:
every vector is encoded by a beam search that keeps BEAM partial sums a stage, and stored as STAGES
bytes beside its norm, the norm of its approximation and the norm of what the approximation leaves
over.  Search: a query's inner products with all codewords fill a lookup table; a candidate's estimate
is the sum of its STAGES entries times the ratio of the stored norms.  The RERANK best estimates of
each block are scored exactly: inner products in double precision, added in the order of the
components.  Their K-th best is a threshold.  By Cauchy and Schwarz a score exceeds its estimate by at
most the query's norm times the norm left over, so only rows whose estimate is that near the threshold
can reach it: these alone are scored.  So codes decide which rows are scored (codes that say nothing
leave all of them), no row is lost to them, and the result doesn't depend on blocks or cores.  Blocks'
best K meet in one ranking.

The stated query set meets all rows in blocks: each task holds one block of candidates and streams the
written query table past it in pieces, so memory is bounded by block and piece, and nothing is sent
to the driver but the fitting sample.

Defined results.  Vectors that are null, of zero length, zero, holding null or non-finite components,
or not of the table's most common length (the shorter of equals) take no part, nor do rows with a null
identifier.  Ties go to the smaller identifier, and of equal vectors the
smaller identifiers are shortlisted first.  Rows that repeat an identifier are
candidates each; a query's own are all rows of its identifier.  Fewer candidates than K: all of them.
An empty table, or one without queries, gives no rows.  Extra columns are not read.  Components are
brought near 1 by a power of two before they are coded, so doubles beyond the range of floats are
coded too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

STAGES, CODES, BEAM, SAMPLE, ROUNDS, K, RERANK, BLOCK, PIECE = 64, 64, 2, 16_384, 4, 20, 64, 1 << 15, 256
TILE = 1024  # candidates whose estimates are summed at once


@dataclass
class Codebooks:
    """STAGES x CODES x dimension, with what encoding needs."""

    words: np.ndarray

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n x stages) and the norms of their sums."""
        codes = np.concatenate([self._beam(x[at : at + 512].astype(np.float32), beam) for at in range(0, len(x), 512)])
        return codes, np.linalg.norm(self.decode(codes), axis=1)

    def _beam(self, x: np.ndarray, beam: int) -> np.ndarray:
        n = len(x)
        row = np.arange(n)[:, None]
        codes, rest, length = np.zeros((n, 1, 0), np.uint8), x[:, None, :], (x**2).sum(1)[:, None]
        for book in self.words:
            # The squared length of what would be left, for each partial sum and codeword.
            left = (length[:, :, None] + ((book**2).sum(1) - 2 * (rest @ book.T))).reshape(n, -1)
            best = np.empty((n, min(beam, left.shape[1])), np.int64)
            length = np.empty(best.shape, np.float32)
            for k in range(best.shape[1]):
                best[:, k] = left.argmin(1)
                length[:, k] = left[row[:, 0], best[:, k]]
                left[row[:, 0], best[:, k]] = np.inf
            which, code = best // len(book), best % len(book)
            codes = np.concatenate([codes[row, which], code[:, :, None].astype(np.uint8)], axis=2)
            rest = rest[row, which] - book[code]
        return codes[:, 0, :]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(book[codes[:, i]] for i, book in enumerate(self.words))

    def estimates(self, queries: np.ndarray, codes: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """Estimated inner products, queries x candidates, from lookup tables."""
        tables = [np.ascontiguousarray(book @ queries.T) for book in self.words]
        out = np.empty((len(queries), len(codes)), np.float32)
        for at in range(0, len(codes), TILE):
            part = codes[at : at + TILE]
            sums = np.zeros((len(part), len(queries)), np.float32)
            for table, code in zip(tables, part.T):
                sums += table[code]
            out[:, at : at + TILE] = (sums * scale[at : at + TILE, None]).T
        return out

    def slack(self, codes: np.ndarray) -> np.ndarray:
        """What rounding can add to an estimate of a query of length 1, before it is scaled."""
        lengths = np.linalg.norm(self.words.astype(np.float64), axis=2)
        steps = 2 * (self.words.shape[2] + len(self.words) + 4) * np.finfo(np.float32).eps
        return steps * sum(each[codes[:, i]] for i, each in enumerate(lengths))


def fit(sample: np.ndarray, stages: int = STAGES, codes: int = CODES, rounds: int = ROUNDS, seed: int = 5) -> Codebooks:
    """Residual k-means."""
    rng, rest, books = np.random.default_rng(seed), sample.astype(np.float32), []
    for _ in range(stages):
        book = rest[rng.choice(len(rest), codes, replace=len(rest) < codes)].copy()
        for _ in range(rounds):
            nearest = (-2 * (rest @ book.T) + (book**2).sum(-1)).argmin(1)
            sums, counts = np.zeros_like(book), np.bincount(nearest, minlength=codes)
            np.add.at(sums, nearest, rest)
            book = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], book).astype(np.float32)
        nearest = (-2 * (rest @ book.T) + (book**2).sum(-1)).argmin(1)
        books.append(book)
        rest = rest - book[nearest]
    return Codebooks(np.stack(books))


def shortlist(estimates: np.ndarray, n: int) -> np.ndarray:
    """The places of the n largest of each row, the first of equals; columns are in identifier order."""
    if estimates.shape[1] <= n:
        return np.tile(np.arange(estimates.shape[1]), (len(estimates), 1))
    top = np.argpartition(-estimates, n - 1, axis=1)[:, :n]
    edge = np.take_along_axis(estimates, top, 1).min(1)
    for i in np.flatnonzero((estimates >= edge[:, None]).sum(1) > n):
        above = np.flatnonzero(estimates[i] > edge[i])
        top[i] = np.concatenate([above, np.flatnonzero(estimates[i] == edge[i])[: n - above.size]])
    return top


def inner_products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Double-precision sums in component order; queries n x d, candidates n x m x d."""
    out = np.zeros(candidates.shape[:2])
    for i in range(queries.shape[1]):
        out += queries[:, i, None] * candidates[:, :, i]
    return out


def survivors(estimates: np.ndarray, rest: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, place) of all pairs whose score, at most rest over its estimate, could reach the query's least."""
    return np.nonzero(~(estimates + rest < least[:, None]))


def best(q: np.ndarray, v: np.ndarray, who: np.ndarray, place: np.ndarray, k: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Places and scores, added in component order, of each query's k best of the pairs (who, place), the first of equals; pairs are in order."""
    exact = np.zeros(who.size)
    for at in range(0, who.size, 2048):  # what is gathered at once stays in the cache
        part = slice(at, at + 2048)
        left, right, sums = q.take(who[part], 0), v.take(place[part], 0), exact[part]
        left *= right
        for column in np.ascontiguousarray(left.T):
            sums += column
    found, score = [], []
    ends = np.searchsorted(who, np.arange(len(q) + 1))
    for a, b in zip(ends, ends[1:]):
        order = np.argsort(-exact[a:b], kind="stable")[:k]
        found.append(place[a:b][order])
        score.append(exact[a:b][order])
    return found, score


def _scale(norm: np.ndarray, short: np.ndarray) -> np.ndarray:
    """The ratio of the stored norms, 1 where an approximation is too short to say anything."""
    return np.where(short * 4 > norm, norm / np.maximum(short, 1e-300), 1.0).astype(np.float32)


def _directions(q: np.ndarray) -> np.ndarray:
    q = q / np.abs(q).max(1, keepdims=True)
    return q / np.linalg.norm(q, axis=1, keepdims=True)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _encode(books: Codebooks, dim: int, unit: float = 1.0):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1), dim).astype(np.float64) / unit
            codes, _ = books.encode(x)
            near = books.decode(codes).astype(np.float64)
            norms, short = np.linalg.norm(x, axis=1), np.linalg.norm(near, axis=1)
            scale = _scale(norms, short).astype(np.float64)
            rest = np.linalg.norm(x - scale[:, None] * near, axis=1) + scale * books.slack(codes)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms), pa.array(short), pa.array(rest)], ["vec_id", "v", "codes", "norm", "short", "rest"])

    return run


def _pieces(uris: list[str], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for uri in uris:
        fs, path = pafs.FileSystem.from_uri(uri)
        with fs.open_input_file(path) as f:
            for b in pq.ParquetFile(f).iter_batches(PIECE, columns=["vec_id", "v"]):
                if b.num_rows:
                    yield b.column(0).to_numpy(), _matrix(b.column(1), dim).astype(np.float64)


def _search(books: Codebooks, dim: int, uris: list[str], k: int, rerank: int, unit: float = 1.0):  # noqa: ANN202
    def meet(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).sort_by("vec_id").combine_chunks()
        ids, v = t["vec_id"].to_numpy(), _matrix(t["v"].combine_chunks(), dim).astype(np.float64)
        codes = np.frombuffer(b"".join(t["codes"].to_pylist()), np.uint8).reshape(len(ids), -1)
        norm, rest = t["norm"].to_numpy(), t["rest"].to_numpy()
        scale, near = _scale(norm, t["short"].to_numpy()), v / unit
        # Either sum is off by at most d roundings of the norms' product.
        slack = 4 * (dim + 2) * np.finfo(float).eps * float(norm.max()) + 1e-300
        rest = np.nextafter((rest + slack).astype(np.float32), np.float32(np.inf))
        for qid, q in _pieces(uris, dim):
            way = _directions(q)
            est = books.estimates(way.astype(np.float32), codes, scale)
            lo, hi = np.searchsorted(ids, qid), np.searchsorted(ids, qid, side="right")
            for i in np.flatnonzero(lo < hi):
                est[i, lo[i] : hi[i]] = -np.inf
            top = shortlist(est, max(rerank, k))
            known = inner_products(way, near[top])
            known[ids[top] == qid[:, None]] = -np.inf
            least = -np.partition(-known, k - 1, axis=1)[:, k - 1] if known.shape[1] >= k else np.full(len(q), -np.inf)
            least = np.nextafter((least - slack).astype(np.float32), np.float32(-np.inf))
            found, score = [], []
            for at in range(0, len(q), 32):  # bounds the pairs held at once where many rows tie
                who, place = survivors(est[at : at + 32], rest, least[at : at + 32])
                own = (place >= lo[at + who]) & (place < hi[at + who])
                places, scores = best(q[at : at + 32], v, who[~own], place[~own], k)
                found += places
                score += scores
            who = np.repeat(qid, [x.size for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(ids[np.concatenate(found)]), pa.array(np.concatenate(score))], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                if n + part.num_rows > BLOCK:
                    yield from meet(held)
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            yield from meet(held)

    return run


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, v) of the vectors that take part, and their length."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sized = vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0")
    common = sized.groupBy(F.size("embedding").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    dim = common["d"] if common else 1
    kind = "double" if vectors.schema["embedding"].dataType.elementType.simpleString() in ("double", "bigint", "int") else "float"
    rows = sized.filter((F.size("embedding") == dim) & finite & F.exists("embedding", lambda x: x != 0))
    return rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{kind}>").alias("v")), dim


def nearest(vectors: DataFrame, queries: str = "vec_id % 20 = 0", k: int = K, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of vectors (vec_id, embedding) that queries selects."""
    spark = vectors.sparkSession
    rows, dim = usable(vectors)
    rows = stored(rows, "vectors")
    shown = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toPandas()["v"]
    if not len(shown):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = rows.agg(F.max(F.array_max(F.transform("v", F.abs))).alias("top"), F.count(F.lit(1)).alias("n")).first()
    unit = float(2.0 ** np.floor(np.log2(size["top"])))
    books = fit(np.stack(list(shown)).astype(np.float64) / unit)
    asked = stored(rows.filter(queries), "queries")
    uris = [u if "://" in u or not u.startswith("file:") else "file://" + u[5:] for u in asked.inputFiles()]
    n_blocks = max(2 * spark.sparkContext.defaultParallelism, -(-size["n"] // BLOCK))
    index = stored(rows.repartition(n_blocks).mapInArrow(_encode(books, dim, unit), f"vec_id long, {rows.schema['v'].simpleString().replace(':', ' ')}, codes binary, norm double, short double, rest double"), "vector-index")
    found = index.mapInArrow(_search(books, dim, uris, k, rerank, unit), "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
