import random

import numpy as np
import pytest
import sentencepiece

from rasterloom.llm import piece_lattice as pl
from rasterloom.llm.piece_lattice import Vocab, cut, decode_pieces, default_model, encode_pieces, entry_sums, exit_edges, maps, marked, scan, then, times, traced, transfer, words

D = "/root/testdata/sf0.01"
ODD = ["", " ", "  ", " a", "a ", "▁x▁", "a▁ b", "日本語 テスト", "x" * 300, "é\n\t　z", "\U0001f600 ok", "  lead  two   three ", "\0a\0", "a" * 50 + "b", "<s> </s> <unk> <0x41>", "​﻿ a\r\nb", " " * 100]


@pytest.fixture(scope="module")
def vocab():
    return Vocab.load(default_model())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=default_model())


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet(f"{D}/documents.parquet").select("text").collect()]


def listed(ids):
    return np.frombuffer(ids, "<u4").tolist()


def test_equals_the_library(vocab, library, texts):
    every = [t or "" for t in texts] + ODD
    assert [listed(x) for x in vocab.encode_all(every)] == library.encode(every)
    assert [listed(vocab.encode(t)) for t in every[::20]] == library.encode(every[::20])


def test_solve_equals_learn(vocab, texts):
    """The lattice with sums, in one pass over whole texts, without words or memory."""
    for t in [*texts[:60], *ODD]:
        if t:
            z = marked(t[:1500])
            assert vocab.ids_of(z) == vocab.encode(t[:1500])


def test_pieces_fit_as_their_joint_text_merges(vocab):
    rng = random.Random(1)
    common = [p for p, i in vocab.ids.items() if i < 3000]
    for _ in range(20_000):
        a, b = rng.choice(common), rng.choice(common)
        made = vocab.merged(a + b)
        whole = [(vocab.left[vocab.ids[p]], vocab.right[vocab.ids[p]]) for p in (a, b)]
        assert vocab.fits(vocab.ids[a], vocab.ids[b]) == (made == whole), (a, b)


def test_round_trip(vocab, texts):
    for t in [*(x or "" for x in texts[:200]), *ODD]:
        assert vocab.decode(vocab.encode(t)) == t.replace("▁", " ")


def scanned(v, t, size):
    chunks = list(cut(marked(t), v.width, size))
    sums = entry_sums([transfer(v, c) for c in chunks])
    leaves = exit_edges([maps(v, c, x) for c, x in zip(chunks, sums)])
    return b"".join(traced(v, c, x, e) for c, x, e in zip(chunks, sums, leaves))


@pytest.mark.parametrize("size", [5, 37, 400])
def test_scan_equals_the_library(vocab, library, texts, size):
    rng = random.Random(2)
    for i in range(120):
        t = rng.choice(texts)
        a = rng.randint(0, len(t))
        t = t[a : a + rng.randint(1, 2000)]
        t = t.replace(" ", "") if i % 4 == 0 else t.replace("e", "  ▁") if i % 7 == 0 else "".join(rng.choice("aab ") for _ in range(200)) if i % 5 == 0 else t
        if t:
            assert listed(scanned(vocab, t, size)) == library.encode(t)


def unigram(pieces):
    """A hand-made unigram vocabulary."""
    v = Vocab(pieces=list(pieces), scores=list(pieces.values()), ids={p: i for i, p in enumerate(pieces)}, width=max(map(len, pieces)), unknown=-20.0)
    v.table = {p[:k]: -1 for p in pieces for k in range(1, len(p))}
    v.table |= {p: 2 * i + (p in v.table) for i, p in enumerate(pieces)}
    return v


def test_unigram_takes_the_best_sum():
    rng = random.Random(3)
    for _ in range(60):
        pieces = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))): -rng.random() * 9 for _ in range(14)} | {x: -7.0 - k for k, x in enumerate("▁abc")}
        v = unigram(pieces)
        t = "".join(rng.choice("abc") for _ in range(11))

        def best(z, v=v):
            return max((v.scores[v.ids[z[:k]]] + best(z[k:]) for k in range(1, len(z) + 1) if z[:k] in v.ids), default=0.0 if not z else -1e9)

        for size in (3, 5, 100):
            got = listed(scanned(v, t, size))
            assert "".join(v.pieces[i] for i in got) == "▁" + t
            assert abs(sum(v.scores[i] for i in got) - best("▁" + t)) < 1e-9


def test_scans_are_associative():
    rng = np.random.default_rng(0)
    for n in range(1, 12):
        sizes = rng.integers(1, 5, n + 1)
        mats = [rng.normal(size=(sizes[i], sizes[i + 1])) for i in range(n)]
        tables = [rng.integers(0, sizes[i + 1], sizes[i]) for i in range(n)]
        m, f = mats[0], tables[0]
        a, b = scan(mats, times), scan(tables, then)
        for k in range(1, n):
            m, f = times(m, mats[k]), tables[k][f]
            assert np.allclose(a[k], m) and (b[k] == f).all()


def test_giants_take_the_scan(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(60)
    assert sorted(map(tuple, encode_pieces(docs, default_model()).collect())) == sorted(map(tuple, encode_pieces(docs, default_model(), giant=500).collect()))


def test_defined_cases(spark, library):
    df = spark.createDataFrame([(1, None, 1), (None, "", 2), (2, "a b", 3), (2, "a b", 4), (3, "wörd " * 30_000, 5), (4, "z" * 100_000, 6), (5, " ", 7)], "doc_id long, text string, ids int")
    out = encode_pieces(df, default_model())
    rows = out.collect()
    assert len(rows) == 7 and all(r.round_trip for r in rows) and [r.n_pieces for r in rows if r.doc_id in (1, None)] == [0, 0]
    want = sorted(((r.doc_id or -1, library.encode(r.text or "")) for r in df.collect()), key=repr)
    assert sorted(((r.doc_id or -1, r.ids) for r in rows), key=repr) == want
    assert sorted(decode_pieces(out, default_model()).collect(), key=repr) == sorted([(r.doc_id, r.text or "") for r in df.collect()], key=repr)
    assert encode_pieces(df.filter("false"), default_model()).count() == 0
    assert words("▁a▁▁b▁") == ["▁a", "▁▁b", "▁"]
    assert pl.Vocab.load(default_model()) is pl.Vocab.load(default_model())
