import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rasterloom.llm.token_files import END_ID, Encoder, SequenceFile, op8_token_files, read_token_files, write_token_files

MODEL = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, part long"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(MODEL)


def plain(library, rows):
    out, at = [], 0
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, END_ID]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_encoder_equals_library(library):
    rng, e = random.Random(1), Encoder(MODEL)
    parts = [" ", "  ", "\n", "\t", "a", "foo", "it's", "é", "x1", "...", "　", "\xa0", "<|endoftext|>", "日本", " foo", "\r\n", "   ", "hey,", " foo!?", " é.", " b1,", "Z"]
    for _ in range(8000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(e.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_other_tokenizers_are_asked_for_whole_texts():
    e = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    for t in ("Hello there  World", " a b ", "one,two three"):
        assert np.frombuffer(e.encode(t), "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_query(spark, library):
    d = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect()]
    assert sorted(map(tuple, op8_token_files(spark, d).collect())) == plain(library, docs)


def test_files_and_random_access(spark, library):
    docs = [(k, f"text number {k} " * (k % 7)) for k in range(50)]
    manifest = write_token_files(spark.createDataFrame(docs, "doc_id long, text string"), MODEL, seq=16, parts=3)
    stream = np.array([x for _, t in docs for x in [*library.encode(t, add_special_tokens=False).ids, END_ID]])
    at = 0
    for m in sorted(manifest.collect(), key=lambda m: m.part):
        f = SequenceFile(m.name + ".ids.arrow")
        for k in range(-(-m.n_ids // 16)):
            ids, mask = f[k]
            n = min(16, m.n_ids - 16 * k)
            assert len(ids) == 16 and ids[:n].tolist() == stream[at + 16 * k : at + 16 * k + n].tolist()
            assert mask.to_pylist() == [True] * n + [False] * (16 - n) and not ids.flags.owndata
        at += m.n_ids
        f.close()
    assert at == len(stream)


def test_defined_cases(spark, library):
    rows = [(2, None, 1), (None, "x y", 2), (1, "", 3), (3, "long word " * 60_000, 4), (5, "b", 5), (5, "a", 6)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = read_token_files(write_token_files(df, MODEL))
    want = plain(library, [r[:2] for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))])
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
    assert read_token_files(write_token_files(df.filter("false"), MODEL)).count() == 0
