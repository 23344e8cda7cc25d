import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rasterloom.llm import token_alignment as T

A_PATH, B_PATH = T.default_models()
SCHEMA = "doc_id long, text string, n_a string, part long"


class Plain:
    """The contract with the libraries, text by text."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
        self.a.encode_special_tokens = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.a_bytes = lambda i: bytes(letters[c] for c in self.a.id_to_token(i))

    def b_bytes(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()

    def sides(self, text):
        if not text:
            return None
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        x, y = [self.a_bytes(i) for i in a], [self.b_bytes(i) for i in b]
        return (a, b, x, y) if b"".join(x) == b"".join(y) == (" " + text).encode() else None

    @staticmethod
    def spans(parts):
        ends = np.cumsum([len(p) for p in parts]).tolist()
        return list(zip([0, *ends], ends))

    def links(self, sides):
        a, b, x, y = sides
        right = self.spans(y)
        out, first = [], 0
        for i, (lo, hi) in zip(a, self.spans(x)):
            while right[first][1] <= lo:
                first += 1
            k = first
            while k < len(right) and right[k][0] < hi:
                out.append((i, b[k]))
                k += 1
        return out

    def groups(self, sides):
        a, b, x, y = sides
        ea, eb = [e for _, e in self.spans(x)], [e for _, e in self.spans(y)]
        out, i, j = [], 0, 0
        for end in sorted({*ea} & {*eb}):
            p, q = ea.index(end, i) + 1, eb.index(end, j) + 1
            out.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            i, j = p, q
        return out

    def rows(self, docs):
        made = [(d, self.sides(t)) for d, t in docs]
        links = [self.links(s) if s else [] for _, s in made]
        counts = Counter(x for ls in links for x in ls)
        best = {}
        for (_, b), n in counts.items():
            best[b] = max(n, best.get(b, 0))
        out = []
        for (d, s), ls in zip(made, links):
            if s is None:
                out.append((d, 0, 0, 0, 0, 0, 0, ""))
            else:
                g = self.groups(s)
                out.append((d, len(s[0]), len(s[1]), len(g), len(ls), sum(counts[x] == best[x[1]] for x in ls), sum(counts[x] for x in ls), hashlib.sha256(";".join(g).encode()).hexdigest()))
        return sorted(map(repr, out)), counts


@pytest.fixture(scope="module")
def plain():
    return Plain()


def random_texts(n, seed, most=14):
    rng = random.Random(seed)
    parts = [" ", "  ", "\n", "\n\n", "\t", "a", "foo", "it's", "é", "x1", "...", "　", "\xa0", "<|endoftext|>", "<s>", "</s>", "日本", " foo", "\r\n", "   ", "hey,", " foo!?", " é.", " b1,", "Z", "\x00", "\x1c", "²", "½", "×", "<0x41>", " .", ".\nA", "́", "😀", "Ġ", "ƛ", "ǀ", "'s"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_words_give_what_whole_texts_give(plain):
    pair = T.Pair.load(A_PATH, B_PATH)
    assert pair.cuts
    for t in random_texts(6000, 1):
        words = [w for part in T.pieces(t) for w in part]
        assert "".join(words) == " " + t
        a, b, exact = pair.encode(words)
        if t and all(exact):
            assert [i for x in a for i in x] == plain.a.encode(" " + t, add_special_tokens=False).ids, t
            assert [i for x in b for i in x] == plain.b.encode(t), t
            links = pair.links(a, b)
            assert Counter(zip((links.keys & T._LOW).tolist(), (links.keys >> 32).tolist())) == Counter(plain.links(plain.sides(t))), t
            assert ";".join(links.spelled()) == ";".join(plain.groups(plain.sides(t))), t


def test_pieces_of_long_texts(monkeypatch):
    for t in random_texts(300, 2, 60):
        whole = [w for p in T.pieces(t) for w in p]
        monkeypatch.setattr(T, "SLICE", 7)
        assert [w for p in T.pieces(t) for w in p] == whole
        monkeypatch.undo()


def found(df):
    return sorted(map(repr, map(tuple, df.select([x.split()[0] for x in T.ROW.split(", ")]).collect())))


def test_query(spark, plain):
    d = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert found(T.op11_token_alignment(spark, d)) == plain.rows(docs)[0]


def test_counts_in_shards(spark, plain):
    docs = list(enumerate(random_texts(400, 3)))
    manifest = T.pair_counts(spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA).repartition(5), A_PATH, B_PATH, shards=6)
    assert 1 < manifest.count() <= 6
    assert {(r.a_id, r.b_id): r.n for r in T.read_counts(manifest).collect()} == plain.rows(docs)[1]


@pytest.mark.parametrize("limits", [{}, {"REMEMBER": 5, "TAIL": 3, "GROUP": 40}, {"SLICE": 30, "REMEMBER": 5, "TAIL": 2}])
def test_forgetting_and_slices_change_nothing(plain, monkeypatch, tmp_path, limits):
    texts = [None, *random_texts(120, 4, 40), *random_texts(5, 5, 400), "▁ x", "<0x41>", "word " * 300, "x" * 500]
    for k, v in limits.items():
        monkeypatch.setattr(T, k, v)
    pair = T.Pair.load(A_PATH, B_PATH)
    counts = T.KeyCounts(pair)
    for k in range(0, len(texts), 50):
        counts.add_texts(texts[k : k + 50])
    counts.take()
    keys, n = T.counted([k for k, _ in counts.done], [x for _, x in counts.done])
    np.save(tmp_path / "all.npy", np.stack([keys, n]))
    want, pairs = plain.rows(list(enumerate(texts)))
    assert dict(zip(zip((keys & T._LOW).tolist(), (keys >> 32).tolist()), n.tolist())) == pairs
    peaks = np.zeros(pair.b.get_piece_size(), np.int64)
    np.maximum.at(peaks, keys >> 32, n)
    sums, hashes = T.Scores(pair, T.Shards([f"file://{tmp_path}/all.npy"], [int(keys[0])]), peaks).texts(texts)
    assert sorted(repr((k, *map(int, s), h)) for k, (s, h) in enumerate(zip(sums, hashes))) == want


def test_models_without_cuts(plain, monkeypatch, tmp_path):
    pair = T.Pair(A_PATH, B_PATH)
    pair.cuts = False
    counts = T.KeyCounts(pair)
    texts = random_texts(60, 6)
    counts.add_texts(texts)
    counts.take()
    keys, n = T.counted([k for k, _ in counts.done], [x for _, x in counts.done])
    assert dict(zip(zip((keys & T._LOW).tolist(), (keys >> 32).tolist()), n.tolist())) == plain.rows(list(enumerate(texts)))[1]


def test_defined_cases(spark, plain):
    docs = [(1, None), (2, ""), (None, "a b"), (3, "a ▁b"), (4, "<s> <|endoftext|>"), (4, "same"), (4, "same"), (5, "long word, " * 130_000), (6, "y" * 30_000), (7, " "), (8, "\n"), (9, "\x00 \x1f")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA)
    assert found(T.align(df, A_PATH, B_PATH)) == plain.rows(docs)[0]
    assert T.align(df.filter("false"), A_PATH, B_PATH).count() == 0
    assert found(T.align(df.filter("text IS NULL"), A_PATH, B_PATH)) == plain.rows(docs[:1])[0]
