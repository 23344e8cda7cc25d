import hashlib
import random
import zlib

import pytest

from rasterloom.llm import merkle_manifest
from rasterloom.llm.merkle_manifest import OP12_SQL, dataset_manifest, numbered, op12_merkle_manifest, verify

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf int, g string, proof string, idx long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def tree(nodes):
    """The root of a list of digests, and each one's siblings, level by level: (before, after)."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // 3 * 3 : i // 3 * 3 + 3]
            proofs[k].append((run[: i % 3], run[i % 3 + 1 :]))
        nodes = [H(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
        at = [i // 3 for i in at]
    return nodes[0], proofs


def plain(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    of = lambda s: (s is not None, (s or "").encode())
    groups = {}
    for r in sorted(rows, key=lambda r: (of(r[1]), r[0] is not None, r[0] or 0, leaf_of(r))):
        groups.setdefault(r[1], []).append(r)
    trees = {s: tree([leaf_of(r) for r in g]) for s, g in groups.items()}
    if not trees:
        return []
    root, tops = tree([trees[s][0] for s in groups])
    out = []
    for k, (s, g) in enumerate(groups.items()):
        for r, proof in zip(g, trees[s][1]):
            path = proof + tops[k]
            cut = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            h = leaf_of((*r[:4], r[4].replace("\n", ""))) if cut else leaf_of(r)
            for before, after in path:
                h = H(*before, h, *after)
            out.append((r[0], leaf_of(r), trees[s][0], root, H(*(x for b, a in path for x in b + a)), h, h == root))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def same(df, rows):
    assert sorted(map(repr, map(tuple, df.select(COLUMNS).collect()))) == sorted(map(repr, plain(rows)))


def run(spark, monkeypatch, rows):
    df = spark.createDataFrame([(*r, 7, "x", "y", 3) for r in rows], SCHEMA)
    monkeypatch.setattr(merkle_manifest, "documents", lambda s, d: df)
    same(op12_merkle_manifest(spark, ""), rows)


def test_query(spark, against_sql):
    d = "/root/testdata/sf0.01"
    against_sql(op12_merkle_manifest, OP12_SQL, d)
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()
    got = op12_merkle_manifest(spark, d)
    same(got, list(map(tuple, docs)))
    changed = {r.doc_id for r in docs if zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and "\n" in r.text}
    assert changed and {r.doc_id for r in got.filter("NOT verified").collect()} == changed


@pytest.mark.parametrize("sizes", [(1,), (2,), (3,), (4, 1), (28, 3, 27, 1), (1, 1, 1, 1, 1, 1, 1, 1, 1, 1), (82, 9)])
def test_shapes(spark, monkeypatch, sizes):
    rng = random.Random(len(sizes))
    rows = [(rng.randrange(10**6), f"s{k}", "en", j, f"a\nb {j}") for k, n in enumerate(sizes) for j in range(n)]
    run(spark, monkeypatch, rows)


def test_defined_cases(spark, monkeypatch):
    rows = [
        (1, None, None, None, None), (2, "", "", 0, ""), (3, "é", "de", 5, "ü\n–"), (3, "é", "de", 5, "ü\n–"), (3, "é", "de", 5, "other\n"), (None, "é", None, 1, "x\n"), (None, None, None, None, None),
        (4, "z", "en", 2, "long\n" * 200_000), (5, "Z", "en", -2, "\n"), (6, "\U0001f600", "x", 2, "\x00\n"), (7, "￿", "x", 2, "b"),
    ]
    run(spark, monkeypatch, rows)
    run(spark, monkeypatch, [])


def test_numbers_a_group_that_spans_partitions(spark):
    rows = spark.range(5000).selectExpr("id", "IF(id % 3 = 0, NULL, 'hot') AS s", "(id * 7919) % 5003 AS k")
    got = {}
    for r in numbered(rows, "s", "k").collect():
        got.setdefault(r.s, []).append((r.k, r.idx, r.n))
    for s, found in got.items():
        assert [i for _, i, _ in sorted(found)] == list(range(len(found))) and {n for _, _, n in found} == {len(found)}


def test_verifies_rows_against_a_manifest(spark):
    docs = spark.range(40).selectExpr("id AS doc_id", "CAST(id % 3 AS STRING) AS source", "'en' AS lang", "id AS n_chars", "concat('t', id) AS text")
    made = dataset_manifest(docs)
    root = bytes(made.first().root)
    changed = docs.selectExpr("doc_id", "source", "lang", "n_chars", "IF(doc_id = 7, 'other', text) AS text").unionAll(docs.selectExpr("doc_id + 90", "source", "lang", "n_chars", "text").limit(1))
    assert sorted(r.doc_id for r in verify(changed, made, root).filter("NOT verified").collect()) == [7, 90]
