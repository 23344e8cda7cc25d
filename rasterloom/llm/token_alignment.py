"""Alignment of two tokenizers: which tokens of A and of B stand for the same bytes, and how often corpus-wide.

A is a byte-level tokenizer of the tokenizers library and reads a space and the text; B is a
sentencepiece model, reads the text and adds the space.  Where both spell the space and the text, byte
offsets at which A and B tokens both end cut them into groups, and a link is a pair of tokens whose
byte ranges overlap.  A pair of ids is packed as an int64 key, B's id in the high half.

Counts.  Each task counts its texts' keys with np.unique and hands on partial counts, whenever TAIL
words have come that it can't remember, and at its end; a hot pair is one row each time.  The partial counts, a written table, are
range-partitioned by key and sorted; a task sums its runs of equal keys and writes a shard: one .npy
file of keys and counts.  The greatest count of each B id is a row an id, so bounded by B's vocabulary.

Lookup.  Documents are read once more; a task finds the counts of new words' keys with searchsorted in
the shards, memory-mapped where they are local files (elsewhere one shard at a time is read), and adds
up its documents' links.

Words.  No token of A or B crosses the place between a character that isn't white space and a space
after it, nor one between Latin letters and a sentence mark, or beside a newline that stands alone:
texts are cut there, and what a word gives is remembered by the worker: the first REMEMBER words for
good, others until TAIL of them have come.  Words that a tokenizer doesn't spell as they are send their
document through the whole path, which encodes it in one piece.  If A's kind or B's pieces don't
warrant the cuts, every text goes that way.

Recovery.  A task attempt writes a shard of its own name, and the written manifest names only shards of
attempts that succeeded.

Defined results.  Null and empty texts, and texts that A or B doesn't spell exactly (such as ones with
"▁", which B takes for a space), have no tokens: zeros and an empty groups_sha256.  Special tokens'
strings inside texts are plain text.  Long texts are taken in pieces of some SLICE characters, cut
between words; a word of any length is encoded whole.  Every row gives a row, repeated and null identifiers
too, and repeated texts count as often as they stand.  An empty table gives no rows.  Extra columns
are not read.
"""

from __future__ import annotations

import hashlib
import io
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEPT, documents, scratch, stored, trim
from .token_files import _byte_letters

REMEMBER, TAIL, SLICE, GROUP, SHARD_ROWS = 900_000, 80_000, 1 << 20, 1 << 18, 1 << 20
_LATIN, _MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", ".,;:!?"
_SPACE_CUT = re.compile(r"(?<=\S)(?= )")
_WORD = re.compile(rf" ?[{_LATIN}]+(?=[{_MARKS} \n]|\Z)|[{_MARKS}]+(?=[ \n]|\Z)|\n(?=\S)|.+?(?:(?<=\S)(?= )|\Z)", re.DOTALL)
_ACROSS = re.compile(rf"[{_LATIN}][{_MARKS}]|\n|[^\u2581]\u2581")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_LOW = (1 << 32) - 1
_SPACE = "▁"
ROW = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Links:
    """The tokens of texts that stand end to end: links, groups, and where those of each text end."""

    def __init__(self, a: list[list[int]], b: list[list[int]], a_len: np.ndarray, b_len: np.ndarray) -> None:
        """a and b: each text's ids; both sides of a text have equal lengths in bytes."""
        self.a, self.b = (np.fromiter(chain.from_iterable(side), np.int64) for side in (a, b))
        a_end, b_end = np.cumsum(a_len[self.a]), np.cumsum(b_len[self.b])
        n = int(a_end[-1]) if a_end.size else 0
        in_a, in_b = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        in_a[a_end] = in_b[b_end] = True
        ends, self.group_end = np.flatnonzero(in_a | in_b), np.flatnonzero(in_a & in_b)
        # No end lies inside the spans between ends, so each is in one token of either side, and each such pair has one span.
        before_a, before_b = np.cumsum(in_a), np.cumsum(in_b)
        self.keys = self.b[before_b[ends] - in_b[ends]] << 32 | self.a[before_a[ends] - in_a[ends]]
        self.a_at, self.b_at = before_a[self.group_end], before_b[self.group_end]
        text_end = a_end[np.cumsum(np.fromiter(map(len, a), np.int64, len(a))) - 1] if n else np.empty(0, np.int64)
        self.link_stop, self.group_stop = np.searchsorted(ends, text_end, "right"), np.searchsorted(self.group_end, text_end, "right")

    def spelled(self) -> list[str]:
        """Each text's groups as `a1,a2|b1;a3|b2,b3`."""
        a, b = list(map(str, self.a.tolist())), list(map(str, self.b.tolist()))
        out, at, x, y = [], 0, self.a_at.tolist(), self.b_at.tolist()
        i = j = 0
        for stop in self.group_stop.tolist():
            made = []
            for k in range(at, stop):
                made.append(f"{','.join(a[i : x[k]])}|{','.join(b[j : y[k]])}")
                i, j = x[k], y[k]
            out.append(";".join(made))
            at = stop
        return out


class Pair:
    """Both tokenizers."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        letters = {c: b for b, c in _byte_letters().items()}
        entries = [self.a.id_to_token(i) or "" for i in range(max(self.a.get_vocab().values()) + 1)]
        self.a_bytes = [bytes(letters[c] for c in x) if all(c in letters for c in x) else x.encode() for x in entries]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace(_SPACE, " ").encode() for p in pieces]
        self.a_len, self.b_len = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        pre = self.a.pre_tokenizer
        level = type(pre).__name__ == "ByteLevel" and pre.use_regex and not pre.add_prefix_space and self.a.normalizer is None
        self.cuts = level and not any(_ACROSS.search(p) for p in pieces)
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.lead = self.b.encode("\n")  # nothing joins a newline: after it, words stand as inside a text

    @staticmethod
    def load(a_path: str, b_path: str) -> Pair:
        key = f"alignment {a_path} {b_path}"
        if key not in KEPT:
            KEPT[key] = Pair(a_path, b_path)
        return KEPT[key]

    def encode_a(self, words: list[str]) -> list[list[int]]:
        """A's ids of each word."""
        core = self.a.model.tokenize
        out = [[t.id for t in core(w.encode().decode("latin-1").translate(self.letters))] if w.lstrip(" ").isalpha() and w.rfind(" ") < 1 and max(w) < "\u0250" else None for w in words]
        odd = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(odd, self.a.encode_batch([words[k] for k in odd], add_special_tokens=False)):
            out[k] = x.ids
        return out

    def encode(self, words: list[str]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Both sides' ids of words as they stand inside a text, and whether both spell them."""
        n = len(self.lead)
        a, b = self.encode_a(words), [x[n:] for x in self.b.encode(["\n" + w for w in words], num_threads=1)]
        return a, b, self.exact(words, a, b)

    def whole(self, text: str) -> tuple[list[list[int]], list[list[int]], bool]:
        """Both sides' ids of a space and a text, each in one piece."""
        a, b = [self.a.encode(" " + text, add_special_tokens=False).ids], [self.b.encode(text)]
        return a, b, self.exact([" " + text], a, b)[0]

    def exact(self, words: list[str], a: list[list[int]], b: list[list[int]]) -> list[bool]:
        """Whether both sides' bytes are each word's: of all words at once, or else one by one."""
        want = [w.encode() for w in words]
        ends = np.cumsum(np.fromiter(map(len, want), np.int64, len(want)))
        if all(self._joined(side, table, lengths, want, ends) for side, table, lengths in ((a, self.a_bytes, self.a_len), (b, self.b_bytes, self.b_len))):
            return [True] * len(words)
        spell = lambda table, ids: b"".join([table[i] for i in ids])
        return [w == spell(self.a_bytes, x) == spell(self.b_bytes, y) for w, x, y in zip(want, a, b)]

    @staticmethod
    def _joined(side: list[list[int]], table: list[bytes], lengths: np.ndarray, want: list[bytes], ends: np.ndarray) -> bool:
        flat = list(chain.from_iterable(side))
        if not all(side) or b"".join(map(table.__getitem__, flat)) != b"".join(want):
            return False
        stops = np.cumsum(np.fromiter(map(len, side), np.int64, len(side))) - 1
        return np.array_equal(np.cumsum(lengths[flat])[stops], ends)

    def links(self, a: list[list[int]], b: list[list[int]]) -> Links:
        return Links(a, b, self.a_len, self.b_len)


def pieces(text: str) -> Iterator[list[str]]:
    """The words of a space and the text, of some SLICE characters at a time."""
    text, at = " " + text, 0
    while at < len(text):
        stop = len(text)
        if stop - at > SLICE:
            found = _SPACE_CUT.search(text, at + SLICE)
            stop = found.start() if found else stop
        yield _WORD.findall(text, at, stop)
        at = stop


class Words:
    """Numbered words, with what a worker remembers of each beside them."""

    def __init__(self, pair: Pair) -> None:
        self.pair, self.known, self.tail, self.bad = pair, {}, [], set()

    def learn(self, words: list[str]) -> None:
        """Number those that are new."""
        new = list(set(words).difference(self.known, self.bad))
        if not new:
            return
        a, b, exact = self.pair.encode(new)
        if not all(exact):
            if len(self.bad) > TAIL:
                self.bad = set()
            self.bad.update(w for w, ok in zip(new, exact) if not ok)
            a, b, new = ([x for x, ok in zip(side, exact) if ok] for side in (a, b, new))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.tail += new[max(0, REMEMBER - (len(self.known) - len(new))) :]
        if new:
            self.keep(self.pair.links(a, b))

    def keep(self, links: Links) -> None:
        raise NotImplementedError

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def whole(self, text: str) -> Links | None:
        """The links of a text encoded in one piece, or None if a tokenizer doesn't spell it."""
        a, b, exact = self.pair.whole(text)
        return self.pair.links(a, b) if exact else None

    def full(self) -> bool:
        return len(self.tail) > TAIL

    def drop_tail(self) -> int:
        """Forget all but the first words; their count."""
        for w in self.tail:
            del self.known[w]
        self.tail = []
        return len(self.known)

    def spelled(self, text: str) -> bool:
        """Whether both tokenizers spell all words of a text; learns them piece by piece."""
        for part in pieces(text):
            self.make_room()
            self.learn(part)
            if not self.bad.isdisjoint(part):
                return False
        return True

    def make_room(self) -> None:
        raise NotImplementedError

    def groups(self, texts: list[str | None]) -> Iterator[tuple[list[tuple[int, list[str]]], list[int]]]:
        """Numbered texts with their words, all learned, some GROUP characters at a time; and texts that aren't taken by words at once."""
        held, size, apart = [], 0, []
        for k, t in enumerate(texts):
            if not t or _SPACE in t:
                continue
            if len(t) > SLICE or not self.pair.cuts:
                apart.append(k)
                continue
            held.append((k, _WORD.findall(" " + t)))
            size += len(t)
            if size > GROUP:
                yield self._learned(held, apart)
                held, size, apart = [], 0, []
        yield self._learned(held, apart)

    def _learned(self, held: list[tuple[int, list[str]]], apart: list[int]) -> tuple[list[tuple[int, list[str]]], list[int]]:
        self.make_room()
        self.learn(list(chain.from_iterable(w for _, w in held)))
        if self.bad:
            apart = apart + [k for k, w in held if not self.bad.isdisjoint(w)]
            held = [(k, w) for k, w in held if self.bad.isdisjoint(w)]
        return held, apart


def counted(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, with the sums of their counts."""
    both, n = np.concatenate(keys or [np.empty(0, np.int64)]), np.concatenate(counts or [np.empty(0, np.int64)])
    distinct, place = np.unique(both, return_inverse=True)
    sums = np.zeros(distinct.size, np.int64)
    np.add.at(sums, place, n)
    return distinct, sums


class KeyCounts(Words):
    """The keys of words and how often each word stood; counts that are due to be handed on are in done."""

    def __init__(self, pair: Pair) -> None:
        super().__init__(pair)
        self.keys, self.sizes = [], []
        self.start()

    def start(self) -> None:
        self.times, self.more, self.done = np.zeros(len(self.known), np.int64), [], []

    def keep(self, links: Links) -> None:
        self.keys.append(links.keys)
        self.sizes.append(np.diff(links.link_stop, prepend=0))
        self.times = np.concatenate([self.times, np.zeros(links.link_stop.size, np.int64)])

    def make_room(self) -> None:
        if self.full() or sum(k.size for k, _ in self.more) > 10 * TAIL:
            self.take()

    def take(self) -> None:
        """Put the counts so far in done and forget the tail."""
        if self.sizes:
            self.keys, self.sizes = [np.concatenate(self.keys)], [np.concatenate(self.sizes)]
        times = [np.repeat(self.times, self.sizes[0])] if self.sizes else []
        keys, sums = counted([*self.keys, *(k for k, _ in self.more)], [*times, *(n for _, n in self.more)])
        self.done.append((keys[sums > 0], sums[sums > 0]))
        n = self.drop_tail()
        if self.sizes:
            self.sizes = [self.sizes[0][:n]]
            self.keys = [self.keys[0][: int(self.sizes[0].sum())]]
        self.times, self.more = np.zeros(n, np.int64), []

    def add(self, words: list[str]) -> None:
        self.times += np.bincount(self.numbers(words), minlength=self.times.size)

    def add_texts(self, texts: list[str | None]) -> None:
        for held, apart in self.groups(texts):
            self.add(list(chain.from_iterable(w for _, w in held)))
            for k in apart:
                if self.pair.cuts and len(texts[k]) > SLICE and self.spelled(texts[k]):
                    for part in pieces(texts[k]):
                        self.make_room()
                        self.learn(part)  # some may have been forgotten
                        self.add(part)
                elif (links := self.whole(texts[k])) is not None:
                    self.more.append(counted([links.keys], [np.ones(links.keys.size, np.int64)]))
                    self.make_room()


def _count(a_path: str, b_path: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = f"alignment keys {a_path} {b_path}"
        if key not in KEPT:
            KEPT[key] = KeyCounts(Pair.load(a_path, b_path))
        found = KEPT[key]
        found.start()
        for b in batches:
            found.add_texts(b.column(0).to_pylist())
            yield from _taken(found)
            trim()
        found.take()
        yield from _taken(found)

    return run


def _taken(found: KeyCounts) -> Iterator[pa.RecordBatch]:
    while found.done:
        keys, n = found.done.pop()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])


def _write_shards(folder: str):  # noqa: ANN202
    """Sorted (key, n) to a shard of its run-length sums, and its row of the manifest with the greatest count of each B id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keys, sums = [], []
        for b in batches:
            if b.num_rows:
                k, n = counted([b.column(0).to_numpy()], [b.column(1).to_numpy()])
                if keys and keys[-1][-1] == k[0]:  # a run that goes on
                    sums[-1][-1] += n[0]
                    k, n = k[1:], n[1:]
                if k.size:
                    keys.append(k)
                    sums.append(n)
        if not keys:
            return
        task = TaskContext.get()
        name = f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}.npy"
        table = np.stack([np.concatenate(keys), np.concatenate(sums)])
        fs, path = pafs.FileSystem.from_uri(name)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(path) as out:
            np.save(out, table)
        ids, at = np.unique(table[0] >> 32, return_index=True)
        peaks = np.maximum.reduceat(table[1], at)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([int(table[0][0])]), pa.array([table.shape[1]]), pa.array([ids.tolist()], pa.list_(pa.int64())), pa.array([peaks.tolist()], pa.list_(pa.int64()))], ["name", "first", "n", "ids", "peaks"])

    return run


class Shards:
    """Lookup in sorted count shards."""

    def __init__(self, names: list[str], firsts: list[int]) -> None:
        self.names, self.firsts, self.open = names, np.array(firsts, np.int64), {}

    def table(self, k: int) -> np.ndarray:
        """Keys and counts of a shard: a view of the file where it is local, which stays open, else its content."""
        if k in self.open:
            return self.open[k]
        fs, path = pafs.FileSystem.from_uri(self.names[k])
        if isinstance(fs, pafs.LocalFileSystem):
            self.open[k] = np.load(path, mmap_mode="r")
            return self.open[k]
        with fs.open_input_file(path) as f:
            return np.load(io.BytesIO(f.read()))

    def counts(self, keys: np.ndarray) -> np.ndarray:
        distinct, place = np.unique(keys, return_inverse=True)
        found = np.empty(distinct.size, np.int64)
        shard = np.searchsorted(self.firsts, distinct, "right") - 1
        at = np.flatnonzero(np.diff(shard, prepend=-1))
        for lo, hi in zip(at, [*at[1:], distinct.size]):
            table = self.table(int(shard[lo]))
            found[lo:hi] = table[1, np.searchsorted(table[0], distinct[lo:hi])]
        return found[place]


class Scores(Words):
    """What each word adds to its document: n_a, n_b, n_groups, n_links, n_best, count_sum, and its groups."""

    def __init__(self, pair: Pair, shards: Shards, peaks: np.ndarray) -> None:
        super().__init__(pair)
        self.shards, self.peaks = shards, peaks
        self.sums, self.spelling, self.held = np.zeros((0, 6), np.int64), [], []

    def of(self, links: Links) -> np.ndarray:
        counts = self.shards.counts(links.keys)
        best = counts == self.peaks[links.keys >> 32]
        each = lambda at: np.diff(at, prepend=0)
        along = lambda x, stop: each(np.append(0, x)[stop])
        return np.stack([
            along(links.a_at, links.group_stop), along(links.b_at, links.group_stop), each(links.group_stop), each(links.link_stop), along(np.cumsum(best), links.link_stop), along(np.cumsum(counts), links.link_stop),
        ], axis=1)

    def keep(self, links: Links) -> None:
        self.held.append(self.of(links))
        self.spelling += links.spelled()

    def make_room(self) -> None:
        if self.full():
            n = self.drop_tail()
            self.sums, self.spelling = self.table()[:n].copy(), self.spelling[:n]

    def table(self) -> np.ndarray:
        if self.held:
            self.sums, self.held = np.concatenate([self.sums, *self.held]), []
        return self.sums

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, list[str]]:
        """The six sums of each text and the hash of its groups; zeros and nothing where there are no tokens."""
        sums, hashes = np.zeros((len(texts), 6), np.int64), [""] * len(texts)
        for held, apart in self.groups(texts):
            table = self.table()
            for k, words in held:
                at = self.numbers(words)
                sums[k] = table[at].sum(0)
                hashes[k] = hashlib.sha256(";".join(map(self.spelling.__getitem__, at.tolist())).encode()).hexdigest()
            for k in apart:
                if self.pair.cuts and len(texts[k]) > SLICE and self.spelled(texts[k]):
                    sums[k], hashes[k] = self.long(texts[k])
                elif (links := self.whole(texts[k])) is not None:
                    sums[k], hashes[k] = self.of(links)[0], hashlib.sha256(links.spelled()[0].encode()).hexdigest()
        return sums, hashes

    def long(self, text: str) -> tuple[np.ndarray, str]:
        total, sha, mark = np.zeros(6, np.int64), hashlib.sha256(), b""
        for words in pieces(text):
            self.make_room()
            self.learn(words)
            at = self.numbers(words)
            total += self.table()[at].sum(0)
            sha.update(mark + ";".join(map(self.spelling.__getitem__, at.tolist())).encode())
            mark = b";"
        return total, sha.hexdigest()


def _score(a_path: str, b_path: str, names: list[str], firsts: list[int], peaks: np.ndarray):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        KEPT.pop(f"alignment keys {a_path} {b_path}", None)
        key = f"alignment scores {a_path} {b_path}"
        if key not in KEPT or KEPT[key].shards.names != names:
            KEPT[key] = Scores(Pair.load(a_path, b_path), Shards(names, firsts), peaks)
        for b in batches:
            sums, hashes = KEPT[key].texts(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(sums[:, k]) for k in range(6)), pa.array(hashes, pa.string())], [x.split()[0] for x in ROW.split(", ")])
            trim()

    return run


def pair_counts(docs: DataFrame, a_path: str, b_path: str, shards: int | None = None) -> DataFrame:
    """The written manifest of the count shards of docs (text): name, first (key), n (keys), ids and peaks (B ids and their greatest counts)."""
    spark = docs.sparkSession
    partial = stored(docs.select(F.col("text").cast("string")).mapInArrow(_count(a_path, b_path), "key long, n long"), "alignment-partial")
    shards = shards or max(spark.sparkContext.defaultParallelism, -(-partial.count() // SHARD_ROWS))
    folder = scratch(spark, "alignment-shards")
    folder = folder if "://" in folder else f"file://{folder}"
    ranged = partial.repartitionByRange(shards, "key").sortWithinPartitions("key")
    return stored(ranged.mapInArrow(_write_shards(folder), "name string, first long, n long, ids array<long>, peaks array<long>"), "alignment-manifest")


def read_counts(manifest: DataFrame) -> DataFrame:
    """a_id, b_id, n of all pairs, from the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                keys, n = Shards([name], [0]).table(0)
                yield pa.RecordBatch.from_arrays([pa.array(keys & _LOW), pa.array(keys >> 32), pa.array(np.array(n))], ["a_id", "b_id", "n"])

    return manifest.select("name").mapInArrow(run, "a_id long, b_id long, n long")


def align(docs: DataFrame, a_path: str, b_path: str, shards: int | None = None) -> DataFrame:
    """The sums of every row of docs (doc_id, text): see ROW."""
    manifest = pair_counts(docs, a_path, b_path, shards)
    # A row a shard, and a row a B id: bounded by SHARD_ROWS and by the vocabulary.
    index = sorted((r["first"], r["name"]) for r in manifest.select("first", "name").collect())
    rows = manifest.select(F.explode(F.arrays_zip("ids", "peaks")).alias("x")).groupBy("x.ids").agg(F.max("x.peaks").alias("peak")).collect()
    peaks = np.zeros(1 + max((r["ids"] for r in rows), default=0), np.int64)
    for r in rows:
        peaks[r["ids"]] = r["peak"]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_score(a_path, b_path, [n for _, n in index], [k for k, _ in index], peaks), ROW)


def default_models() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir), *default_models())
