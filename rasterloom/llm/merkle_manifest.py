"""Merkle manifest of a dataset: a digest for each row, one root for all rows, a proof for each row.

H is the lowercase hex SHA-256 of its inputs, one after the other.  A row's leaf is H of its fields,
each `-` if null, else its UTF-8 byte count, `:` and the value.  In each source, leaves stand by doc_id;
while several nodes remain, each ARITY consecutive ones (the last run may be shorter, even one) become
their H.  What remains is the source's subroot; subroots, by source, become the root in the same way.

Build, bottom up.  Level l + 1 is a written table of runs: (g, n, idx, kids), where g numbers the
sources, n counts the nodes of level l + 1 in the source, and kids holds the digests of the run's
nodes, in order; a run's own digest is H of them.  Each level groups the one before by idx div ARITY.

Proofs, top down.  A run inherits the proof suffix of its parent: each level's runs join their parents
on (g, idx div ARITY), take their siblings from the parent's kids, put these before the inherited
suffix, and are written with it; so one join a level pushes the suffix down, and the leaves join level
1 last.  The trees of the sources hang under the tree of subroots, whose proofs are the suffixes that
the sources' highest runs inherit.  A proof is an array of (before, after): the digests that stand left
and right of the path's node in its run.

Skew.  A source may hold most rows: rows are numbered by range partitions of (source, doc_id), whose
places are their positions in the partition plus the counts of the source's earlier partitions; no task
holds a source.  All other joins and groups have keys of ARITY rows at most.  Levels shrink by ARITY,
so all of them hold half as many nodes as there are rows, and there are log-many jobs.  Only the
greatest count of a level reaches the driver.

Recovery.  Each level is a written table, so a lost executor costs its tasks.

Defined results.  Null identifiers stand first, and so does the null source, as a source of its own.
Rows that repeat an identifier within a source stand by their leaves; equal leaves are equal rows.
Texts, sources and langs of any length are hashed whole, the empty text as `0:`.  A source of one row
has that row's leaf as its subroot, and one source's subroot is the root; an empty proof is H of
nothing.  An empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, stored

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PROOF = "array<struct<before: binary, after: binary>>"
_MASK = (1 << 33) - 1


def digest(data: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(data.cast("binary"), 256))


def hexed(c: Column) -> Column:
    return F.lower(F.hex(c))


def field(c: Column) -> Column:
    c = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def leaf(text: Column) -> Column:
    """The leaf of a row, with its text as given."""
    return digest(F.concat(*(field(F.col(c)) for c in FIELDS[:-1]), field(text)))


def joined(nodes: Column) -> Column:
    """Digests in a row as one binary value."""
    return F.aggregate(nodes, F.lit(b""), lambda acc, x: F.concat(acc, x))


def node(kids: Column) -> Column:
    return digest(hexed(joined(kids)))


def _ranks(rows: DataFrame, group: str, *order: str) -> tuple[DataFrame, DataFrame]:
    """rows, written in order with `at` and `part`, and the table (group, part, first, before, n): of each group, in each range partition, the first `at`, the rows of earlier partitions, and all rows.

    A row's place in its group is before + at - first.  Beyond a row for each group, the table has one for each partition at most.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    ranged = stored(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "merkle-ranks")
    of_group = W.partitionBy(group)
    starts = ranged.groupBy(group, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("held"))
    starts = starts.withColumn("before", F.coalesce(F.sum("held").over(of_group.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("held").over(of_group))
    return ranged, starts.drop("held")


def _placed(ranged: DataFrame, starts: DataFrame, group: str) -> DataFrame:
    keys = starts.withColumnRenamed(group, "_group").withColumnRenamed("part", "_part")
    same = ranged[group].eqNullSafe(keys["_group"]) & (ranged["part"] == keys["_part"])
    return ranged.join(keys, same).withColumn("idx", F.col("before") + F.col("at") - F.col("first")).drop("_group", "_part", "at", "part", "first", "before")


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with idx, their place from 0 in their group by order, and n, the group's count; no task holds a group."""
    return _placed(*_ranks(rows, group, *order), group)


def runs_of(nodes: DataFrame) -> DataFrame:
    """(g, n, idx, kids) of the next level of nodes (g, n, idx, h), for groups of more than one node."""
    up = F.floor(F.col("idx") / ARITY).cast("long")
    kids = F.transform(F.sort_array(F.collect_list(F.struct("idx", "h"))), lambda x: x["h"])
    return nodes.filter("n > 1").groupBy("g", F.ceil(F.col("n") / ARITY).cast("long").alias("n"), up.alias("up")).agg(kids.alias("kids")).select("g", "n", F.col("up").alias("idx"), "kids")


def build(nodes: DataFrame, most: int, name: str) -> list[DataFrame]:
    """The written levels over nodes (g, n, idx, h), lowest first; most: the greatest n."""
    levels = []
    while most > 1:
        levels.append(stored(runs_of(nodes), f"{name}-{len(levels) + 1}"))
        nodes, most = levels[-1].select("g", "n", "idx", node(F.col("kids")).alias("h")), -(-most // ARITY)
    return levels


def tops(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(g, h): what remains of each group."""
    last = [x.filter("n = 1").select("g", node(F.col("kids")).alias("h")) for x in levels]
    return reduce(DataFrame.unionAll, last, nodes.filter("n = 1").select("g", "h"))


def _below(children: DataFrame, parents: DataFrame) -> DataFrame:
    """children (g, idx, ...) with the proofs that they inherit from parents (g, idx, kids, proof, subroot), their own siblings first."""
    up = parents.select(F.col("g").alias("_g"), F.col("idx").alias("_up"), F.col("kids").alias("_kids"), F.col("proof").alias("_proof"), "subroot")
    at = (F.col("idx") % ARITY).cast("int")
    sides = F.struct(joined(F.slice("_kids", F.lit(1), at)).alias("before"), joined(F.slice("_kids", at + 2, F.lit(ARITY))).alias("after"))
    both = children.join(up, (F.col("g") == F.col("_g")) & (F.floor(F.col("idx") / ARITY).cast("long") == F.col("_up")))
    return both.withColumn("proof", F.concat(F.array(sides), F.col("_proof"))).drop("_g", "_up", "_kids", "_proof")


def _at_top(rows: DataFrame, given: DataFrame) -> DataFrame:
    """rows of groups that end at this level, with the proofs given for their groups (g, proof, subroot)."""
    top = given.select(F.col("g").alias("_g"), "proof", "subroot")
    return rows.filter("n = 1").join(top, F.col("g") == F.col("_g")).drop("_g")


def push(leaves: DataFrame, levels: list[DataFrame], given: DataFrame, name: str) -> DataFrame:
    """leaves (g, n, idx, ...) with proof and subroot; given: (g, proof, subroot) of the groups' highest nodes.

    A group's highest node is the one of the level where its n is 1; lower ones inherit.
    """
    above = None
    for k, level in reversed(list(enumerate(levels))):
        held = _at_top(level, given)
        if above is not None:
            held = held.unionByName(_below(level.filter("n > 1"), above))
        above = stored(held.select("g", "idx", "kids", "proof", "subroot"), f"{name}-{k + 1}")
    lone = _at_top(leaves, given)
    return lone if above is None else lone.unionByName(_below(leaves.filter("n > 1"), above))


def folded(first: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, first, lambda acc, x: digest(hexed(F.concat(x["before"], acc, x["after"]))))


def siblings(proof: Column) -> Column:
    """The proof's digests in one binary value, level by level, left to right."""
    return F.aggregate(proof, F.lit(b""), lambda acc, x: F.concat(acc, x["before"], x["after"]))


def manifest(rows: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns of keep, leaf, subroot, root (bytes) and proof of every row of rows (source, doc_id, leaf, and those of keep)."""
    rows = stored(rows.select("source", "doc_id", "leaf", *keep), "merkle-leaves")
    ranged, starts = _ranks(rows, "source", "doc_id", "leaf")
    starts = stored(starts, "merkle-starts")
    # Sources get numbers in their order; the hot ones join by partition, not by source.
    sources = numbered(starts.select("source", "n").distinct().withColumn("all", F.lit(0)), "all", "source").select(F.col("source").alias("_source"), F.col("idx").alias("g"))
    sources = stored(sources, "merkle-sources")
    starts = starts.join(sources, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    leaves = stored(_placed(ranged, starts, "source").drop("source"), "merkle-level-0")
    most = leaves.agg(F.max("n")).first()[0] or 0
    nodes = leaves.select("g", "n", "idx", F.col("leaf").alias("h"))
    levels = build(nodes, most, "merkle-level")
    n_sources = sources.count()
    subroots = stored(tops(nodes, levels).select(F.lit(0).cast("long").alias("g"), F.lit(n_sources).cast("long").alias("n"), F.col("g").alias("idx"), "h"), "merkle-subroots")
    upper = build(subroots, n_sources, "merkle-upper")
    root = stored(tops(subroots, upper), "merkle-root").first()
    top = tops(subroots, upper).select("g", F.expr(f"CAST(array() AS {_PROOF})").alias("proof"), F.lit(None).cast("binary").alias("subroot"))
    proofs = push(subroots, upper, top, "merkle-upper-proof")
    given = stored(proofs.select(F.col("idx").alias("g"), "proof", F.col("h").alias("subroot")), "merkle-given")
    out = push(leaves, levels, given, "merkle-proof")
    return out.select("doc_id", *keep, "leaf", "subroot", F.lit(root["h"] if root else None).cast("binary").alias("root"), "proof")


def dataset_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof of every row of docs (doc_id, source, lang, n_chars, text)."""
    return manifest(_typed(docs).select("source", "doc_id", leaf(F.col("text")).alias("leaf")))


def _typed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long"), F.col("text").cast("string"))


def verify(docs: DataFrame, manifest: DataFrame, root: bytes) -> DataFrame:
    """doc_id, verified of rows that claim to belong to a manifest's root: each folds its proof from its own leaf.  For doc_ids that are distinct and not null."""
    made = _typed(docs).select("doc_id", leaf(F.col("text")).alias("leaf"))
    kept = manifest.select(F.col("doc_id").alias("_doc_id"), "proof")
    return made.join(kept, F.col("doc_id") == F.col("_doc_id"), "left").select("doc_id", F.coalesce(folded(F.col("leaf"), F.col("proof")) == F.lit(root), F.lit(False)).alias("verified"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All digests, and what tampered texts lead to: rows with an even CRC of doc_id lose their newlines."""
    rows = _typed(documents(spark, sf_dir))
    lost = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    tampered = F.when((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & (F.col("text") != lost), leaf(lost))
    made = manifest(rows.select("source", "doc_id", leaf(F.col("text")).alias("leaf"), tampered.alias("tampered")), "tampered")
    made = made.withColumn("folded", folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return made.select(
        "doc_id", hexed(F.col("leaf")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"),
        F.sha2(hexed(siblings(F.col("proof"))).cast("binary"), 256).alias("proof_sha256"), hexed(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


OP12_SQL = """
WITH RECURSIVE bits(b, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
doc AS (
  SELECT source, doc_id, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text,
    xor(list_reduce(list_prepend(4294967295, [ord(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')]), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 2 = 0 AS cut
  FROM documents, crc_table
), leaves AS (
  SELECT source, doc_id, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || CASE WHEN cut THEN coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-') ELSE coalesce(strlen(text) || ':' || text, '-') END) AS tampered
  FROM doc
), placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM leaves
), level(l, g, n, idx, h) AS (
  SELECT 0, g, n, idx, leaf FROM placed
  UNION ALL SELECT l + 1, g, (n + 2) // 3, idx // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM level WHERE n > 1 GROUP BY l, g, n, idx // 3
), subroots AS (SELECT g, l AS height, h, count(*) OVER () AS n FROM level WHERE n = 1),
upper(l, n, idx, h) AS (
  SELECT 0, n, g, h FROM subroots
  UNION ALL SELECT l + 1, (n + 2) // 3, idx // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM upper WHERE n > 1 GROUP BY l, n, idx // 3
), root AS (SELECT h AS root FROM upper WHERE n = 1),
steps AS (
  SELECT p.g, p.idx, x.l, coalesce(string_agg(x.h, '' ORDER BY x.idx) FILTER (x.idx < p.idx // pow(3, x.l)::BIGINT), '') AS before, coalesce(string_agg(x.h, '' ORDER BY x.idx) FILTER (x.idx > p.idx // pow(3, x.l)::BIGINT), '') AS after
  FROM placed p JOIN level x ON x.g = p.g AND x.n > 1 AND x.idx // 3 = p.idx // pow(3, x.l + 1)::BIGINT
  GROUP BY p.g, p.idx, x.l
  UNION ALL
  SELECT p.g, p.idx, s.height + x.l, coalesce(string_agg(x.h, '' ORDER BY x.idx) FILTER (x.idx < p.g // pow(3, x.l)::BIGINT), ''), coalesce(string_agg(x.h, '' ORDER BY x.idx) FILTER (x.idx > p.g // pow(3, x.l)::BIGINT), '')
  FROM placed p JOIN subroots s ON s.g = p.g JOIN upper x ON x.n > 1 AND x.idx // 3 = p.g // pow(3, x.l + 1)::BIGINT
  GROUP BY p.g, p.idx, s.height, x.l
), fold(g, idx, l, h) AS (
  SELECT g, idx, 0, tampered FROM placed
  UNION ALL SELECT f.g, f.idx, f.l + 1, sha256(s.before || f.h || s.after) FROM fold f JOIN steps s ON s.g = f.g AND s.idx = f.idx AND s.l = f.l
), ends AS (SELECT g, idx, arg_max(h, l) AS folded_root FROM fold GROUP BY g, idx),
proofs AS (SELECT g, idx, sha256(string_agg(before || after, '' ORDER BY l)) AS proof_sha256 FROM steps GROUP BY g, idx)
SELECT p.doc_id, p.leaf, s.h AS subroot, r.root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = r.root AS verified
FROM placed p JOIN subroots s USING (g) CROSS JOIN root r JOIN ends e USING (g, idx) LEFT JOIN proofs q USING (g, idx)"""
