"""Relative Lempel-Ziv parsing, word by word, against every indexed reference block.

The documents in order, doc_id first, are cut into blocks of BLOCK words.  A block's index is the
suffix array of its words.  A document is parsed against each block that begins before it: from its
first word on, the longest run of words that occurs in the block, earlier than where it stands, is a
factor, and the next factor begins behind it.  Factors of WINDOW words and more are duplicate spans.
Windows that cross a factor's end may repeat elsewhere, so each start there is looked up by itself.

This is the method in full, exact by words and without a hash.  Its work is documents times blocks, so
it can't meet a linear budget: substring_dedup's anchors are the way at scale, and tests hold the two
against each other.  A task parses a bounded slice of documents against one block; the pairs of
slices and blocks are written rows, spread over the cluster.

Defined results: as substring_dedup's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored
from .substring_dedup import FIRST_ID, WINDOW, _kept, _merged

BLOCK = 1 << 18


class Index:
    """The suffix array of a text of numbered words, by doubling; END closes it and is less than any word."""

    END = -1

    def __init__(self, words: np.ndarray) -> None:
        self.words = np.append(words, self.END)
        rank, step = self.words - self.words.min(), 1
        while True:
            after = np.zeros_like(rank)
            after[:-step] = rank[step:] + 1
            order = np.lexsort((after, rank))
            new = np.append(0, ((np.diff(rank[order]) != 0) | (np.diff(after[order]) != 0)).cumsum())
            rank = np.empty_like(new)
            rank[order] = new
            if new[-1] == len(new) - 1 or step >= len(self.words):
                break
            step *= 2
        self.places = order

    def longest(self, text: np.ndarray, start: int, before: int) -> int:
        """How many words of text from start on occur here at a place before `before`."""
        lo, hi, n = 0, len(self.places), 0
        while start + n < len(text):
            at = np.minimum(self.places[lo:hi] + n, len(self.words) - 1) if hi - lo < 64 else None
            word = text[start + n]
            if at is None:
                low, high = self._narrow(lo, hi, n, word)
            else:
                firsts = self.words[at]
                low, high = lo + int(np.searchsorted(firsts, word)), lo + int(np.searchsorted(firsts, word, "right"))
            if low == high or self.places[low:high].min() >= before:
                break
            lo, hi, n = low, high, n + 1
            if hi - lo == 1:
                ahead = self.words[self.places[lo] + n : -1][: len(text) - start - n]
                same = ahead == text[start + n : start + n + len(ahead)]
                return n + (len(same) if same.all() else int(same.argmin()))
        return n

    def _narrow(self, lo: int, hi: int, n: int, word: int) -> tuple[int, int]:
        """Where the n-th words of the suffixes lo .. hi, in order, equal word."""
        ends = []
        for right in (False, True):
            a, b = lo, hi
            while a < b:
                mid = (a + b) // 2
                w = self.words[min(self.places[mid] + n, len(self.words) - 1)]
                a, b = (mid + 1, b) if w < word or (right and w == word) else (a, mid)
            ends.append(a)
        return ends[0], ends[1]


def factors(index: Index, text: np.ndarray, first: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the greedy parse of text, whose first word stands at place first of the index (or beyond it)."""
    at = 0
    while at < len(text):
        n = index.longest(text, at, first + at)
        yield at, max(1, n)
        at += max(1, n)


def repeated(index: Index, text: np.ndarray, first: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """Spans of text covered by windows that occur earlier: long factors, and the windows that cross a factor's end."""
    out = []
    for start, n in factors(index, text, first):
        if n >= window:
            out.append((start, start + n))
        for s in range(max(start + 1, start + n - window + 1), min(start + n, len(text) - window + 1)):
            if index.longest(text, s, first + s) >= window:
                out.append((s, s + window))
    return out


def _numbered(texts: list[str]) -> list[np.ndarray]:
    known: dict[bytes, int] = {}
    return [np.array([known.setdefault(w, len(known)) for w in t.encode().split()], np.int64) for t in texts]


def _parse(block: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
    """The spans of docs' rows that occur in a block's documents at an earlier place."""
    block = block.sort_values(["doc", "mark", "uid"])
    words = _numbered([*block["text"], *docs["text"]])
    held, asked = words[: len(block)], words[len(block) :]
    # A word that is no word of the text stands behind each document, so that no factor crosses two.
    index = Index(np.concatenate([np.append(w, -2 - k) for k, w in enumerate(held)])) if held else None
    starts = dict(zip(block["uid"], np.cumsum([0, *(len(w) + 1 for w in held[:-1])])))
    firsts: dict[int, int] = {}
    for d, u in zip(block["doc"], block["uid"]):
        firsts.setdefault(d, starts[u])
    size = sum(len(w) + 1 for w in held)
    out = []
    for d, m, u, w in zip(docs["doc"], docs["mark"], docs["uid"], asked):
        if index is None or len(w) < WINDOW:
            continue
        if u in starts:
            spans = [x for x in repeated(index, w, starts[u])]
            if firsts[d] != starts[u]:  # other rows of this doc_id are not earlier
                spans = _own(held, block, d, u, w)
        else:
            spans = _own(held, block, d, u, w) if d in firsts else repeated(index, w, size)
        if spans:
            out.append((d, m, [a for a, _ in spans], [b for _, b in spans]))
    return pd.DataFrame(out, columns=["doc", "mark", "starts", "ends"])


def _own(held: list[np.ndarray], block: pd.DataFrame, d: int, u: int, w: np.ndarray) -> list[tuple[int, int]]:
    """Against a block that has other rows of the same doc_id: these are left out."""
    parts = [np.append(x, -2 - k) for k, (x, e, v) in enumerate(zip(held, block["doc"], block["uid"])) if e < d or v == u]
    ends = np.cumsum([0, *map(len, parts)])
    own = [k for k, (e, v) in enumerate(zip(*(block[c][(block["doc"] < d) | (block["uid"] == u)] for c in ("doc", "uid")))) if v == u]
    return repeated(Index(np.concatenate(parts)), w, int(ends[own[0]]) if own else int(ends[-1])) if parts else []


def parsed_without_repeats(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_removed, kept for every row of docs (doc_id, text), by parsing each document against every block."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID)).alias("doc"), F.shiftrightunsigned(F.xxhash64(text), 33).cast("int").alias("mark"), text.alias("text"))
    rows = stored(rows.withColumn("uid", F.monotonically_increasing_id()), "parse-rows")
    # Blocks of about so many words in document order: lengths are summed by document, then cut.
    sizes = rows.groupBy("doc").agg(F.sum(F.length("text") / 6 + 1).alias("n"))
    cut = stored(sizes.select("doc", F.floor(F.sum("n").over(W.orderBy("doc")) / block).alias("part")), "parse-blocks")
    placed = stored(rows.join(cut, "doc"), "parse-placed")
    parts = cut.agg(F.min(F.struct("doc", "part")), F.max("part")).first()[1] or 0
    asked = placed.withColumn("against", F.explode(F.sequence(F.lit(0).cast("long"), F.col("part"))))
    pairs = asked.withColumn("slice", F.concat_ws("/", "against", "part"))
    whole = placed.withColumn("slice", F.explode(F.transform(F.sequence(F.col("part"), F.lit(parts).cast("long")), lambda p: F.concat_ws("/", F.col("part"), p))))
    found = whole.groupBy("slice").cogroup(pairs.groupBy("slice")).applyInPandas(_parse, "doc long, mark int, starts array<int>, ends array<int>")
    flat = found.select("doc", "mark", F.explode(F.arrays_zip("starts", "ends")).alias("s")).groupBy("doc", "mark").agg(F.collect_set("s").alias("s"))
    spans = flat.select("doc", "mark", F.col("s.starts").alias("starts"), F.col("s.ends").alias("ends")).mapInArrow(_merged, "doc long, mark int, starts array<int>, ends array<int>")
    return rows.join(spans, ["doc", "mark"], "left").select("doc_id", "text", "starts", "ends").mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept string")
