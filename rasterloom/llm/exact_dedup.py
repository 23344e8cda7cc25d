"""Exact deduplication by a stateful stream.

Each document's digest goes through a streaming aggregation whose keyed state lives on disk
(RocksDB), never expires, and keeps for each digest the smallest identifier, that row's place (file
and row: the content locator), and a count.  The state is then read as a table.  Digests seen more
than once are hits: their full bytes are read again at their places and compared by grouping on the
whole normalised text, so that a digest collision separates texts (by their SHA-256) instead of
merging them.  The state can be kept for later batches.  Only SQL functions run on the executors.

Skew: copies of one text are combined before every shuffle, so a text that fills a third of the
table reaches the state as one row from each task; the last join carries only ids and digests.

Defined results.  Null text counts as empty; the empty text is a text like any other.  A null
identifier counts as larger than any other; if all identifiers of a group are null, keep_id is null
and one of its rows stays.  A row that repeats both identifier and text is a copy of itself: one
stays.  An empty table gives no rows.  Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, forget, fresh, one_spaced, scratch, small, stored

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no space set aside ahead
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    "spark.sql.streaming.minBatchesToRetain": "2",
}


def sha256(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def stream_state(digests: DataFrame, checkpoint: str) -> None:
    """Feed a streaming (doc_id, digest, file, place) frame into the keyed state at checkpoint; may be called again with more."""
    spark = digests.sparkSession
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "place"))
        kept = digests.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
        query = kept.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state as a table: digest, keep_id, file and place (the content locator), n."""
    state = spark.read.format("statestore").load(checkpoint)
    first, n = (f"value.`{f.name}`" for f in state.schema["value"].dataType.fields)
    return state.select(F.col("key.digest").alias("digest"), F.col(f"{first}.doc_id").alias("keep_id"), F.col(f"{first}.file").alias("file"), F.col(f"{first}.place").alias("place"), F.col(n).alias("n"))


def _as_read(docs: DataFrame) -> bool:
    """Whether docs is a Parquet file or folder just as it is read, so that its texts stand in its files."""
    files = docs.inputFiles()  # names, as any scan lists them on the driver
    if not files or docs.isStreaming:
        return False
    roots = {f.rsplit("/", 1)[0] for f in files} | (set(files) if len(files) == 1 else set())
    if len(roots) > 2:
        return False
    spellings = [x for root in sorted(roots) for x in (root, root.replace(":///", ":/", 1), root.removeprefix("file://"))]
    read = docs.sparkSession.read.schema(docs.schema)
    try:
        return any(docs.sameSemantics(read.parquet(x)) for x in dict.fromkeys(spellings))
    except AnalysisException:
        return False


def _located(docs: DataFrame, texts: str) -> DataFrame:
    """doc_id, text, file, place: where each row's text can be read again.  Rows that aren't a Parquet table as it is read, such as renamed or changed texts, are first written to the folder texts."""
    if not _as_read(docs):
        docs.select("doc_id", F.col("text").cast("string").alias("text")).write.option("compression", "zstd").parquet(texts)
        docs = docs.sparkSession.read.schema("doc_id " + docs.schema["doc_id"].dataType.simpleString() + ", text string").parquet(texts)
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))


def _texts_at(spark: SparkSession, places: DataFrame) -> DataFrame:
    """digest, norm of the written places (digest, file, place): only files that are named are read, and only rows at these places normalised."""
    files = [r["file"] for r in places.select("file").distinct().collect()]  # names of input files, as any scan lists them on the driver
    if not files:
        return places.select("digest", F.lit("").alias("norm")).filter("false")
    there = spark.read.parquet(*files).select("text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    return there.join(small(places, 256), ["file", "place"]).select("digest", one_spaced(F.col("text").cast("string")).alias("norm"))


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, state: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (doc_id, text).

    With state, a folder, the keyed state and the digests stay there, and a later call with the same
    folder judges its docs against all rows seen so far; the files of these must still be there.  Texts
    that don't stand in a Parquet table just as docs has them are written there too.
    """
    spark = docs.sparkSession
    folder = state.rstrip("/") if state else scratch(spark, "dedup")
    seen, checkpoint, batch = f"{folder}/digests", f"{folder}/state", uuid.uuid4().hex[:12]
    rows = _located(docs, f"{folder}/texts-{batch}").select("doc_id", one_spaced(F.col("text")).alias("norm"), "file", "place")
    rows = rows.select("doc_id", digest(F.col("norm")).alias("digest"), "norm", "file", "place")
    table = rows.select("doc_id", "digest", (F.col("digest") if digest is sha256 else sha256(F.col("norm"))).alias("sha"), "file", "place")
    table.write.option("compression", "zstd").parquet(f"{seen}/batch={batch}")
    kept = T.StructType(table.schema.fields + [T.StructField("batch", T.StringType())])
    stream_state(spark.readStream.schema(kept).option("maxBytesPerTrigger", str(64 << 30)).parquet(seen), checkpoint)
    every = spark.read.schema(kept).parquet(seen)
    table = every.filter(F.col("batch") == batch).drop("batch")
    groups = stored(read_state(spark, checkpoint), "dedup-groups")
    if state is None:
        forget(spark, checkpoint)

    # Full bytes on hits, read at their places: one class for each different text under a digest.
    hits = groups.filter("n > 1").select("digest")
    places = stored(every.join(small(hits, 64), "digest", "left_semi").select("digest", "file", "place"), "dedup-places")
    texts = _texts_at(spark, places).groupBy("digest", "norm")
    clashes = stored(texts.agg(F.lit(1).alias("one")).groupBy("digest").count().filter("count > 1").select("digest"), "dedup-clashes")
    out = table.join(groups.select("digest", "keep_id", "n"), "digest")
    if not clashes.isEmpty():
        out = out.join(clashes, "digest", "left_anti")
        apart = every.join(clashes, "digest", "left_semi")
        classes = apart.groupBy("digest", "sha").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id"))["doc_id"].alias("keep_id"), F.count(F.lit(1)).alias("n"))
        out = out.unionByName(apart.filter(F.col("batch") == batch).drop("batch").join(classes, ["digest", "sha"]).select(*out.columns))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    if not every.groupBy("doc_id", "digest").count().filter("count > 1").isEmpty():
        first = F.row_number().over(W.partitionBy("doc_id", "sha").orderBy("file", "place"))
        nth = every.withColumn("nth", first).filter(F.col("batch") == batch).select("file", "place", "nth") if state else None
        out = out.withColumn("nth", first) if nth is None else out.join(nth, ["file", "place"])
        kept = kept & (F.col("nth") == 1)
    return out.select("doc_id", "keep_id", F.col("n").alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_dedup drops, columns unchanged."""
    key, sha = fresh(docs, "dedup_id", "dedup_sha")
    found = exact_dedup(docs)
    stay = found.filter("kept").select(F.col("doc_id").alias(key), F.unhex("text_sha256").alias(sha))
    tagged = docs.withColumn(sha, sha256(one_spaced(F.col("text"))))
    out = tagged.join(small(stay, 64).withColumnRenamed(sha, sha + "_s"), tagged["doc_id"].eqNullSafe(F.col(key)) & (F.col(sha) == F.col(sha + "_s")), "left_semi")
    if not found.groupBy("doc_id", "text_sha256").count().filter("count > 1").isEmpty():
        (nth,) = fresh(docs, "dedup_nth")
        out = out.withColumn(nth, F.row_number().over(W.partitionBy("doc_id", sha).orderBy(F.lit(0)))).filter(F.col(nth) == 1)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP1_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
"""
