"""Repeated passages by the long factors of a relative Lempel-Ziv parse, found from anchors.

The parse itself, documents against every block's suffix array, is in relative_parse and is what this
module is tested against; its work is documents times blocks, which no linear budget holds.  Here the
same long factors are found by joins whose work is linear in the text.

Every document is both text and reference.  Of each window of WINDOW words, the GRAM-word sequence of
least hash (the leftmost of equals) is its anchor; equal windows have equal anchors, and a document
has about one anchor in eight words.  A reference block is the SPAN words around an anchor, all that
windows with that anchor could hold.

Parsing: an anchor whose whole block also stands in an earlier document, or earlier in its own, lies
within a factor: all windows around it repeat.  Factors end where blocks differ.  At these boundaries
(the first holder of a block whose anchor has other blocks too) single windows are compared: their
hashes meet those of all other boundary windows of that anchor.  Windows with equal anchors in
differing blocks are thus all checked, so exactly the windows that start earlier elsewhere are
found.  Blocks are compared by 128 bits of hash and windows by 128, words by 64 each.

Skew: anchors and windows are counted with map-side combining (least holder and number), and what
joins afterwards are single rows against one row an anchor, so Spark may split a hot anchor's side.
Spans gather as sets by document, bounded by the document itself however often its row comes.

Order: a window is earlier if its doc_id is smaller, or in the same row if its start is.  Defined results.
Null text has no words; texts under WINDOW words lose none; a null doc_id comes before all others;
rows that share a doc_id are not earlier than one another.  An empty table gives no rows.  Extra
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, documents, stored

WINDOW, GRAM = 20, 5
REACH = WINDOW - GRAM  # words of a block on either side of its anchor
SPAN = GRAM + 2 * REACH
_U = np.uint64
_ODD = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) ^ (i * 0xD6E8FEB86659FD93)) & (1 << 64) - 1 | 1 for i in range(1, 3 * SPAN)], _U)
_EDGE = _U(0x5851F42D4C957F2D)
FIRST_ID = -(1 << 63)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(32))


def _weighed(words: np.ndarray, starts: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    """A hash of n words from each start: a sum with odd weights, mixed."""
    out = np.zeros(starts.size, _U)
    for k in range(n):
        out += words[starts + k] * weights[k]
    return _mixed(out)


def word_hashes(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), _U, len(words))


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of each anchor, and for each window the place of its anchor."""
    n = words.size - GRAM + 1
    grams = np.zeros(n, _U)
    for k in range(GRAM):
        grams += words[k : k + n] * _ODD[k]
    grams = _mixed(grams)
    least = np.lib.stride_tricks.sliding_window_view(grams, REACH + 1).argmin(axis=1) + np.arange(n - REACH)
    at = least[np.flatnonzero(np.diff(least, prepend=-1))]
    return grams[at], at, least


def blocks(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hash of the block around each anchor; what lies beyond the document is a word of its own."""
    edge = np.full(REACH, _EDGE)
    return _weighed(np.concatenate([edge, words, edge]), at, SPAN, _ODD[SPAN : 2 * SPAN])


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, mark, text to h, c, doc, mark, pos, n (words), own (the block stands earlier in this document)."""
    names = ["h", "c", "doc", "mark", "pos", "n", "own"]
    for b in batches:
        out: list[tuple] = []
        for doc, mark, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()):
            words = word_hashes(text)
            if words.size < WINDOW:
                continue
            h, at, _ = anchors(words)
            c = blocks(words, at)
            own = np.ones(at.size, bool)
            own[np.unique(c, return_index=True)[1]] = False
            out.append((h.view(np.int64), c.view(np.int64), np.full(at.size, doc, np.int64), np.full(at.size, mark, np.int32), at.astype(np.int32), np.full(at.size, words.size, np.int32), own))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names)


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, mark, text, places (of anchors) to the windows of these anchors: w1, w2, doc, mark, start, own."""
    for b in batches:
        out: list[tuple] = []
        for doc, mark, text, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), b.column(3)):
            words = word_hashes(text)
            starts = np.flatnonzero(np.isin(anchors(words)[2], places.values.to_numpy()))
            w1, w2 = (_weighed(words, starts, WINDOW, _ODD[k * WINDOW : (k + 1) * WINDOW]) for k in (0, 2))
            own = np.ones(starts.size, bool)
            own[np.unique(w1, return_index=True)[1]] = False
            out.append((w1.view(np.int64), w2.view(np.int64), np.full(starts.size, doc, np.int64), np.full(starts.size, mark, np.int32), starts.astype(np.int32), own))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["w1", "w2", "doc", "mark", "start", "own"])


def union_of(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching spans as one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > ends[:-1])
    return starts[new], np.append(ends[:-1][new[1:]], ends[-1])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        both = [union_of(a.values.to_numpy(), e.values.to_numpy()) for a, e in zip(b.column(2), b.column(3))]
        lists = [pa.array([x[i] for x in both], pa.list_(pa.int32())) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], ["doc", "mark", "starts", "ends"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, starts, ends to doc_id, n_words, n_removed, kept (text)."""
    for b in batches:
        counts, gone, kept = [], [], []
        for text, starts, ends in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
            words, removed, at, parts = text.split(), 0, 0, []
            for lo, hi in zip(starts or (), ends or ()):
                parts += words[at:lo]
                removed, at = removed + hi - lo, hi
            counts.append(len(words))
            gone.append(removed)
            kept.append(b" ".join(parts + words[at:]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sums = [hashlib.sha256(x).hexdigest() for x in b.column(3).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sums)], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc.alias("doc"), F.shiftrightunsigned(F.xxhash64(text), 33).cast("int").alias("mark"), text.alias("text"))


def _with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows with their document's spans: broadcast if these are small, by shuffle if not."""
    n = spans.agg(F.count(F.lit(1)), F.sum(F.size("starts"))).first()
    side = F.broadcast(spans) if n[0] * 64 + (n[1] or 0) * 8 <= BROADCAST_BYTES else spans
    return rows.join(side, ["doc", "mark"], "left")


def duplicate_spans(docs: DataFrame) -> DataFrame:
    """doc, mark, starts, ends: the word spans of each document covered by windows that start earlier elsewhere."""
    rows = _rows(docs)
    found = stored(rows.select("doc", "mark", "text").mapInArrow(_anchor_rows, "h long, c long, doc long, mark int, pos int, n int, own boolean"), "anchors")
    # An anchor's holders: how many, the least, and whether all have one block.
    held = found.filter("not own").groupBy("h").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("doc").alias("least"), F.count(F.lit(1)).alias("holders")).filter("holders > 1 or c0 <> c1")
    known = stored(found.filter("not own").join(held.select("h", (F.col("c0") != F.col("c1")).alias("many"), "least"), "h"), "anchors-held")
    many = known.filter("many").drop("least")
    least = many.groupBy("h", "c").agg(F.min("doc").alias("least"))
    many = stored(many.join(least, ["h", "c"]).select("doc", "mark", "pos", "n", (F.col("doc") > F.col("least")).alias("later")), "anchors-many")

    whole = (F.greatest(F.lit(0), F.col("pos") - REACH).alias("start"), F.least("n", F.col("pos") + WINDOW).alias("end"))
    spans = found.filter("own").select("doc", "mark", *whole)
    spans = spans.unionByName(known.filter("not many and doc > least").select("doc", "mark", *whole))
    spans = spans.unionByName(many.filter("later").select("doc", "mark", *whole))

    places = stored(many.filter("not later").groupBy("doc", "mark").agg(F.collect_set("pos").alias("places")), "boundaries")
    edge = stored(rows.join(places, ["doc", "mark"]).select("doc", "mark", "text", "places").mapInArrow(_window_rows, "w1 long, w2 long, doc long, mark int, start int, own boolean"), "windows")
    first = edge.filter("not own").groupBy("w1", "w2").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("holders")).filter("holders > 1")
    later = edge.filter("not own").join(first, ["w1", "w2"]).filter("doc > least").select("doc", "mark", "start").unionByName(edge.filter("own").select("doc", "mark", "start"))
    spans = spans.unionByName(later.select("doc", "mark", "start", (F.col("start") + WINDOW).alias("end")))
    gathered = spans.groupBy("doc", "mark").agg(F.collect_set(F.struct("start", "end")).alias("s")).select("doc", "mark", F.col("s.start").alias("starts"), F.col("s.end").alias("ends"))
    return stored(gathered.mapInArrow(_merged, "doc long, mark int, starts array<int>, ends array<int>"), "spans")


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by single spaces) for every row of docs (doc_id, text)."""
    rows = _with_spans(_rows(docs), duplicate_spans(docs))
    return rows.select("doc_id", "text", "starts", "ends").mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept string")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir)).mapInArrow(_hashed, "doc_id long, n_words long, n_removed long, kept_sha256 string")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM s),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS nth FROM k) WHERE nth > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM r),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
q AS (SELECT p.doc_id, count(*) FILTER (g.j IS NOT NULL) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p.j) FILTER (g.j IS NULL), '') AS kept
      FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.j = g.j GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN q USING (doc_id)
"""
