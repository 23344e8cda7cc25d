"""Toxic passages by maximum-scoring segments.

Training.  For each token, the number of toxic and of clean labelled documents that hold it gives a
log-odds ratio under an informative Dirichlet prior (the tokens' overall counts, PRIOR times their
weight) and its standard error.  A token scores what is left of its log-odds after SHRINK standard
errors towards 0; tokens with nothing left are not in the lexicon and score DRIFT, a small negative
number.  Counts cover every labelled training document, and the lexicon holds every token with
something left.  Where it outgrows a broadcast, the model carries what it says of the most frequent
tokens, and the rest is a written table that documents' other tokens are joined with.

Scoring.  A document is one pass of Ruzzo and Tompa's scan, which finds all maximal segments in time
linear in its length; runs of unlisted tokens count as one gap.  A segment of score S in a document
of n tokens has the extreme-value expectation E = K n exp(-lambda S): lambda solves
sum p exp(lambda s) = 1 over the clean background, K is its maximum-likelihood value over the
calibration documents.  Segments of E <= E_MAX are significant.  A document's evidence is the sum of
-ln E over them; a logistic curve fitted on the calibration documents turns it into a score.

Calibration reads a bounded sample: the labelled training documents whose hash falls in the share
that makes CALIBRATION of them on average.  All else covers all rows, and each document is scored over
its whole text.

Defined results.  Null and empty texts have no segment and get the score of no evidence.  Labels
with a null doc_id or toxic are ignored; of repeated labels the largest counts; a doc_id that repeats
in documents is scored and, if labelled, counted each time.  Without training labels of both kinds every
score is 0.  A null doc_id is not held out.  An empty table gives no rows.  Extra columns pass through
scored() unchanged.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, documents, fresh, light, small, stored

PRIOR, SHRINK, DRIFT, TOKEN_BYTES, E_MAX, CALIBRATION, CUT = 0.1, 2.0, -0.5, 48, 0.05, 20_000, 0.3
_TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    drift: float = DRIFT
    lam: float = 1.0
    k: float = 1.0
    slope: float = 1.0
    base: float = -50.0
    trained: bool = False
    #: If the lexicon isn't broadcast: frequent tokens that it doesn't list, and (token, s) of the rarer ones that it does.
    plain: frozenset[str] = frozenset()
    rest: DataFrame | None = None


def maximal_segments(places: list[int], values: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), end exclusive, of a sequence that scores values at
    places and drift elsewhere.  Ruzzo and Tompa's stack, with a gap's sum taken at once.

    Each entry holds start, end, the total before it, the total after it, and the place of the nearest
    earlier entry with a smaller total before it: what lies between needs no second look, so the
    searches are linear in all.
    """
    stack: list[list] = []
    total, at = 0.0, 0
    for p, v in zip(places, values):
        total += drift * (p - at)
        at = p + 1
        before, total = total, total + v
        if v <= 0:
            continue
        start, j = p, len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= before:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= total:
                break
            start, before = stack[j][0], stack[j][2]
            del stack[j:]
            j -= 1
        stack.append([start, p + 1, before, total, j])
    return [(a, b, r - l) for a, b, l, r, _ in stack]


def segments(text: str, model: Model, more: list[dict] | None = None) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of tokens and the maximal segments of a text; more lists its tokens that model.rest scores."""
    words = tokens(text)
    get = model.scores.get
    if more:
        rare = {x["token"]: x["s"] for x in more}
        get = lambda w: model.scores.get(w, rare.get(w))
    listed = [(i, s) for i, s in enumerate(map(get, words)) if s is not None]
    return len(words), maximal_segments([i for i, _ in listed], [s for _, s in listed], model.drift) if listed else []


def significant(n: int, segs: list[tuple[int, int, float]], model: Model) -> list[tuple[int, int, float, float]]:
    """Segments with their expectation, those of at most E_MAX."""
    found = ((a, b, s, math.exp(min(50.0, math.log(model.k * n) - model.lam * s))) for a, b, s in segs)
    return [x for x in found if x[3] <= E_MAX]


def evidence(found: list[tuple[int, int, float, float]]) -> float:
    return sum(-math.log(max(e, 1e-300)) for *_, e in found)


@light
def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) to (token, y1, y0): documents of either kind that hold a token; "" counts the documents."""
    for b in batches:
        kinds = (Counter(), Counter())
        for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            kinds[y].update({*tokens(t or ""), ""})
        words = list({*kinds[0], *kinds[1]})
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([kinds[1][w] for w in words], pa.int64()), pa.array([kinds[0][w] for w in words], pa.int64())], ["token", "y1", "y0"])


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _lambda(probs: np.ndarray, scores: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1; the mean score is negative."""
    low, high = 0.0, 1.0
    value = lambda x: float(probs @ np.exp(np.minimum(x * scores, 700))) - 1
    while value(high) < 0 and high < 1e3:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by ridge-damped Newton steps; x scaled to its mean for steadiness."""
    scale = max(1.0, float(np.abs(x).mean()))
    a = np.column_stack([x / scale, np.ones_like(x)])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2), a.T @ (y - p) - 1e-2 * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0] / scale), float(w[1])


def train(docs: DataFrame, labels: DataFrame, limit: int = BROADCAST_BYTES) -> Model:
    """Fit on labels (doc_id, toxic) outside the held-out quarter and the documents they name; limit bounds what is broadcast."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~is_held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    labelled = docs.select("doc_id", "text").join(small(known, 16), F.col("doc_id") == F.col("label_id"))
    counts = labelled.select("text", "toxic").mapInArrow(_counts, "token string, y1 long, y0 long").groupBy("token").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0"))
    counts = stored(counts, "token-counts")
    model = Model()

    def listed(counts: DataFrame, n1: float, n0: float) -> DataFrame:
        total = n1 + n0
        y1, y0 = F.col("y1"), F.col("y0")
        prior = PRIOR * (y1 + y0)
        odds = F.log((y1 + prior) / (n1 + PRIOR * total - y1 - prior)) - F.log((y0 + prior) / (n0 + PRIOR * total - y0 - prior))
        error = F.sqrt(1 / (y1 + prior) + 1 / (y0 + prior))
        left = F.signum(odds) * (F.abs(odds) - SHRINK * error)
        return counts.select("token", left.alias("s"), (odds / error).alias("z"), ((y0 + prior) / (n0 + PRIOR * total)).alias("p")).filter(F.abs("z") > SHRINK)

    sums = counts.groupBy((F.col("token") == "").alias("docs")).agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0")).collect()
    by = {r["docs"]: r for r in sums}
    if True not in by or not by[True]["y1"] or not by[True]["y0"] or False not in by:
        return model
    n1, n0 = float(by[False]["y1"]), float(by[False]["y0"])
    if not n1 or not n0:
        return model
    words = counts.filter("token <> ''")
    lexicon = listed(words, n1, n0)
    if lexicon.count() * TOKEN_BYTES <= limit:
        rows = lexicon.orderBy(F.abs("z").desc(), "token").collect()
        model.scores = {r["token"]: r["s"] for r in rows}
    else:
        often = stored(words.orderBy((F.col("y1") + F.col("y0")).desc(), "token").limit(limit // TOKEN_BYTES).select("token"), "frequent-tokens")
        said = often.join(lexicon, "token", "left").select("token", "s").collect()
        model.scores = {r["token"]: r["s"] for r in said if r["s"] is not None}
        model.plain = frozenset(r["token"] for r in said if r["s"] is None)
        model.rest = stored(lexicon.join(often, "token", "left_anti").select("token", "s"), "lexicon")
        rows = lexicon.groupBy("s").agg(F.sum("p").alias("p")).orderBy("s").collect()  # as many as there are different pairs of counts
    scores, probs = np.array([r["s"] for r in rows]), np.array([r["p"] for r in rows])
    rest = max(0.0, 1.0 - float(probs.sum()))
    # The walk must drift down over clean text.
    if len(rows):
        model.drift = min(DRIFT, -2 * max(0.0, float(probs @ scores)) / max(rest, 1e-9))
        model.lam = _lambda(np.append(probs, rest), np.append(scores, model.drift)) if (scores > 0).any() else 1.0

    # A share of the labels by hash, chosen before any text is read.
    share = min(1.0, CALIBRATION / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64("label_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    shown = docs.select("doc_id", "text").join(small(chosen, 16), F.col("doc_id") == F.col("label_id")).select(F.col("text").cast("string").alias("t"), F.col("toxic"))
    shown = stored(_with_rare(shown, model), "calibration")
    best = [tuple(r) for r in shown.mapInArrow(_summed(model, lambda n, segs: max((s for *_, s in segs), default=0.0)), "n long, x double, toxic int").collect()]
    clean = [(n, m) for n, m, y in best if not y and n]
    weight = sum(n * math.exp(-model.lam * m) for n, m in clean)
    model.k = min(1.0, max(1e-9, len(clean) / weight)) if weight else 1.0
    bare = replace(model, rest=None)
    raw = [tuple(r) for r in shown.mapInArrow(_summed(model, lambda n, segs: evidence(significant(n, segs, bare)) if n else 0.0), "n long, x double, toxic int").collect()]
    x = np.array([e for _, e, _ in raw])
    y = np.array([float(y) for *_, y in raw])
    if y.any() and not y.all():
        model.slope, model.base = _logistic(x, y)
        model.slope = max(model.slope, 0.0)
        model.trained = True
    return model


def _unlisted(known: Model):  # noqa: ANN202
    """(row, t) to (row, token): the tokens of each text that the model itself says nothing of."""

    @light
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = [w for w in {*tokens(t or "")} if w not in known.scores and w not in known.plain]
                for k in range(0, len(words), 10_000):
                    part = words[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(part), pa.int64()), pa.array(part, pa.string())], ["row", "token"])

    return run


def _with_rare(rows: DataFrame, model: Model) -> DataFrame:
    """rows (t and others) as t, more, others: more has the tokens of t that model.rest scores."""
    others, kind = rows.columns[1:], "array<struct<token: string, s: double>>"
    if model.rest is None:
        return rows.select("t", F.lit(None).cast(kind).alias("more"), *others)
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "toxicity-rows")
    asked = rows.select("row", "t").mapInArrow(_unlisted(replace(model, rest=None)), "row long, token string")
    more = asked.join(model.rest, "token").groupBy("row").agg(F.collect_list(F.struct("token", "s")).alias("more"))
    return rows.join(more, "row", "left").select("t", "more", *others)


def _summed(model: Model, value: Callable[[int, list[tuple[int, int, float]]], float]):  # noqa: ANN202
    """(t, more, toxic) to (n, x, toxic): the number of tokens and what value makes of the segments."""
    model = replace(model, rest=None)

    @light
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [segments(t or "", model, more) for t, more in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in got], pa.int64()), pa.array([value(*x) for x in got], pa.float64()), b.column(2).cast(pa.int32())], ["n", "x", "toxic"])

    return run


def _score(model: Model):  # noqa: ANN202
    model = replace(model, rest=None)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())]))

    @light
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores, found = [], []
            for t, more in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n, segs = segments(t or "", model, more)
                sig = significant(n, segs, model) if segs else []
                x = model.base + model.slope * evidence(sig)
                scores.append(1 / (1 + math.exp(-max(-60.0, min(60.0, x)))) if model.trained else 0.0)
                found.append([{"start": a, "end": e, "score": s, "e_value": v} for a, e, s, v in sig])
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(scores, pa.float64()), pa.array(found, spans)], [*b.schema.names[2:], "score", "passages"])

    return run


def scored(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns keep of docs, then score and passages (token spans with their expectations)."""
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(F.col("text").cast("string").alias("t"), *[F.col(f"`{c}`").alias(k) for c, k in zip(keep, names)])
    kinds = ", ".join(f"{k} {docs.schema[c].dataType.simpleString()}" for c, k in zip(keep, names))
    span = "array<struct<start: long, end: long, score: double, e_value: double>>"
    out = _with_rare(rows, model).mapInArrow(_score(model), f"{kinds}{', ' * bool(kinds)}score double, passages {span}")
    (score, spans) = fresh(docs.select(*[F.col(f"`{c}`") for c in keep]), "score", "passages")
    return out.toDF(*keep, score, spans)


def keep_clean(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """docs without those that score cut or more; columns unchanged."""
    out = scored(docs, train(docs, labels), *docs.columns)
    return out.filter(F.col(out.columns[-2]) < cut).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = scored(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), "doc_id")
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
