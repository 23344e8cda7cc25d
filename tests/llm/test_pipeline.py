import gc
import shutil
import weakref

import numpy as np

import corpus_pipeline
from rasterloom.llm import exact_dedup, mixing, piece_lattice, shingle_join, simhash_dedup, toxicity

D = "/root/testdata/sf0.001"


def shingles(text):
    w = text.encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns = docs.dtypes
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], D)
        if name != "sentencepiece":
            assert [c for c, _ in out.dtypes] == [c for c, _ in columns]
        seen.append(exact_dedup.stored(out, name))
    raw, clean, exact, near, mixed, _ = seen
    # Each stage against a plain version of its own input.
    model = toxicity.train(raw, spark.read.parquet(f"{D}/labels.parquet"))

    def keeps(t):
        n, segs = toxicity.segments(t, model)
        x = model.base + model.slope * toxicity.evidence(toxicity.significant(n, segs, model))
        return x < -0.8472978603872037  # the score's cut of 0.3, as odds

    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in raw.collect() if keeps(r.text)}
    first = {}
    for r in sorted(clean.collect(), key=lambda r: r.doc_id):
        first.setdefault(" ".join(r.text.encode().decode().split()), r.doc_id)
    assert {r.doc_id for r in exact.collect()} == set(first.values())
    rows = sorted((r.doc_id, r.text) for r in exact.collect())
    grams = [shingles(t) for _, t in rows]
    first_of = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(grams[a] & grams[b]) >= 4 * len(grams[a] | grams[b]):
                first_of = [min(first_of[a], first_of[b]) if f in (first_of[a], first_of[b]) else f for f in first_of]
    assert {r.doc_id for r in near.collect()} == {rows[k][0] for k in set(first_of)}
    sizes = {}
    for r in near.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.encode().split())
    names = sorted(sizes)
    taken = {}
    for r in mixed.collect():
        taken[r.source] = taken.get(r.source, 0) + len(r.text.encode().split())
        assert r.n_chars == len(r.text)
    assert {s: taken.get(s, 0) for s in names} == {s: int(g) for s, g in zip(names, mixing.targets([sizes[s] for s in names]))}
    vocab = piece_lattice.Vocab.load(piece_lattice.default_model())
    last = seen[-1].collect()
    assert len(last) == mixed.count() and all(r.round_trip for r in last)
    assert sum(r.n_pieces for r in last) == sum(len(vocab.encode(r.text)) // 4 for r in mixed.collect())
    assert corpus_pipeline.run(spark, D).count() == len(last)


def run(spark, now):
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        now = exact_dedup.stored(stage(spark, now, D), name)
        outs.append(now)
    return outs


def test_empty_and_null(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    assert [x.count() for x in run(spark, docs.filter("false"))] == [0] * 5
    rows = spark.createDataFrame([(None, None, None, None, None), (1, "a b c", "en", None, 5), (1, "a b c", "en", None, 5), (2, "", "en", "s", 0)], docs.schema)
    _, exact, near, mixed, last = run(spark, rows)
    assert sorted((r.doc_id or -1) for r in exact.collect()) == [1, 2]
    assert sorted((r.doc_id or -1) for r in near.collect()) == [1, 2]
    # The one source with words takes floor(1.5 x 3): the document, and its first word.
    assert sorted((r.doc_id, r.text, r.n_chars) for r in mixed.collect()) == [(1, "a", 1), (1, "a b c", 5)]
    vocab = piece_lattice.Vocab.load(piece_lattice.default_model())
    assert sorted((r.doc_id, vocab.decode(np.array(r.ids, "<u4").tobytes()), r.n_pieces) for r in last.collect()) == [(1, "a", 1), (1, "a b c", 3)]


def test_long_texts_and_extra_columns(spark):
    text = " ".join(f"word{k}" for k in range(30_000))
    names = ("score", "passages", "dedup_id", "near_id", "take", "pass", "uid", "size", "h", "mark", "root", "ids")
    rows = [(1, text, "en", "s", len(text), *names), (2, text + " end", "en", "s", len(text) + 4, *names), (3, text.upper() + " last", "en", None, 1, *names), (4, "alone", "en", "s", 5, *names)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    clean, exact, near, mixed, last = run(spark, df)
    assert all(x.columns == df.columns for x in (clean, exact, near, mixed))
    assert [sorted(r.doc_id for r in x.collect()) for x in (clean, exact, near)] == [[1, 2, 3, 4], [1, 2, 3, 4], [1, 4]]
    assert all(r[5:] == names for r in near.collect())
    assert sum(len(r.text.split()) for r in mixed.collect()) == 30_001 * 3 // 2
    vocab = piece_lattice.Vocab.load(piece_lattice.default_model())
    assert sorted(vocab.decode(np.array(r.ids, "<u4").tobytes()) for r in last.collect()) == sorted(r.text for r in mixed.collect())


def test_workers_drop_the_vocabulary(tmp_path):
    """Workers outlive stages: work of the other stages must not run beside the vocabulary that encoding left."""
    model = toxicity.Model()
    works = [
        toxicity._counts, toxicity._unlisted(model), toxicity._summed(model, lambda n, segs: 0.0), toxicity._score(model),
        simhash_dedup._fingerprints(5), simhash_dedup._links, mixing._slots([0.0, 1.0], 1), shingle_join._spread(4), shingle_join._shared,
        shingle_join._candidates, shingle_join._min_hashes, shingle_join._bucket_links, shingle_join._prefixes, shingle_join._cross, shingle_join._verified,
    ]
    path = str(shutil.copy(piece_lattice.default_model(), tmp_path / "copy.model"))
    left = weakref.ref(piece_lattice.Vocab.load(path))
    list(piece_lattice._encoded(path, False)(iter(())))
    assert left() is piece_lattice.Vocab.load(path)  # kept from task to task
    for work in works:
        left = weakref.ref(piece_lattice.Vocab.load(path))
        list(work(iter(())))
        gc.collect()
        assert left() is None, work
