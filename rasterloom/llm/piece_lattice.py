"""SentencePiece encoding and decoding over a lattice of pieces, by a max-plus parallel scan.

A text becomes "▁" + text with each space as "▁" (an empty text stays empty).  Its pieces are the path
of the greatest sum through a lattice whose nodes are places between characters and whose edges are
pieces; a character that is no piece is an edge of its own and is spelled in byte pieces.  Pieces and
scores come from the model file, which is never changed or trained.  Two kinds of model are read:

* merge-rank ("bpe") models.  The library merges, again and again, the neighbours whose joint piece
  scores best, leftmost first.  Merges never cross a border of the result, so a merge run restricted to
  some of its neighbouring pieces is the run of these alone.  Hence a row of pieces is the result if and
  only if each two neighbours are the result of their own joint text: if a merge crossed a border, the
  first to do so would, all before it lying inside pieces, also be made in these two alone.  So the state
  of the max-plus automaton is the last piece, a step between fitting neighbours weighs the piece's
  score, any other step minus infinity, and exactly one path to each place is finite: the library's.
  Whether two pieces fit is read off their merge trees (fits()) and remembered.
* unigram models: all neighbours fit and the greatest sum of scores decides.

No piece holds "▁" after another character, so every path has a node before each word: words are
encoded on their own and remembered.  A giant text (over GIANT characters) is cut into chunks at fixed
places, anywhere in a word.  A path passes a cut in one state: the edge that ends at or crosses it.  Then

1. each chunk yields its transfer matrix T[s, t], the best sum from entry edge s to exit edge t;
2. a max-plus prefix scan of a document's matrices (associative, so in log-many rounds) gives the best
   sum of each entry edge of each chunk;
3. each chunk, knowing those, yields a map from exit edge to entry edge along best paths; a suffix
   scan of map composition, associative too, gives every chunk the exit edge of the one best path;
4. each chunk traces its own pieces back from there, independently.

Decoding joins the pieces, byte pieces as bytes, turns "▁" to spaces and drops the first.  As in the
library a "▁" of the text itself counts as a space; every text without one comes back exactly.

Defined results.  Null and empty texts have no pieces and decode to the empty text.  Repeated rows
each get their row, a null identifier too; an empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEPT, documents, stored, trim

GIANT, CHUNK, UNKNOWN, REMEMBER = 1 << 16, 1 << 15, 10.0, 400_000
SLICE = 250  # texts of a batch whose words are held at once
NORMAL, UNK, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
SPACE = "▁"
_LOW = -1e300
_OUTSIDE = -1  # the piece of an unknown character, and what stands before a text
Edge = tuple[int, int]


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message; varints as ints, all else as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = varint() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, data[at : at + n]
        at += n


@dataclass
class Vocab:
    """A model file's pieces, read as a lattice vocabulary."""

    merges: bool = False
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    ids: dict[str, int] = field(default_factory=dict)
    #: Of each piece and each beginning of one: twice its id (_OUTSIDE if it is no piece), plus 1 if longer pieces begin with it.
    table: dict[str, int] = field(default_factory=dict)
    #: The same of ends: plus 1 if longer pieces end with it.
    ends: dict[str, int] = field(default_factory=dict)
    bytes_: list[int] = field(default_factory=lambda: [0] * 256)
    spelled: list[bytes] = field(default_factory=list)
    width: int = 1
    unknown: float = 0.0
    #: Merge models: order of merging (-1: a character), what a piece was merged from, order of each joint piece by left * n + right.
    order: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    joint: dict[int, int] = field(default_factory=dict)
    fit: dict[int, bool] = field(default_factory=dict)
    known: dict[str, bytes] = field(default_factory=dict)  # ids by word, without its "▁"

    @staticmethod
    def load(path: str) -> Vocab:
        if path not in KEPT:
            with open(path, "rb") as f:
                KEPT[path] = Vocab.parse(f.read())
        return KEPT[path]

    @staticmethod
    def parse(data: bytes) -> Vocab:
        v, rows, kind_of_model = Vocab(), [], UNIGRAM
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                rows.append((piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
            elif number == 2:
                kind_of_model = dict(fields(value)).get(3, UNIGRAM)
        if kind_of_model not in (UNIGRAM, BPE):
            raise ValueError(f"model type {kind_of_model} has no lattice")
        v.merges = kind_of_model == BPE
        plain = [s for _, s, kind in rows if kind == NORMAL]
        v.unknown = min(plain) - UNKNOWN
        for i, (piece, score, kind) in enumerate(rows):
            v.pieces.append(piece)
            v.spelled.append(b"" if kind in (UNK, CONTROL) else piece.replace(SPACE, " ").encode())
            v.scores.append(score if kind != USER else len(piece) * max(plain) - 0.1)
            if kind == BYTE:
                v.bytes_[int(piece[3:5], 16)] = i
                v.spelled[-1] = bytes([int(piece[3:5], 16)])
            elif kind in (NORMAL, USER):
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"piece {piece!r} crosses a word")
                if v.merges and kind == USER and len(piece) > 1:
                    raise ValueError(f"piece {piece!r} is cut out before merging")
                v.ids[piece] = i
        for table, parts in ((v.table, (p[:k] for p in v.ids for k in range(1, len(p)))), (v.ends, (p[k:] for p in v.ids for k in range(1, len(p))))):
            table.update(dict.fromkeys(parts, 2 * _OUTSIDE + 1))
            table.update({p: 2 * i + (p in table) for p, i in v.ids.items()})
        v.width = max(map(len, v.ids))
        if v.merges:
            v._trees()
        return v

    def _trees(self) -> None:
        """What each piece is merged from last.  A piece that merging its own text doesn't give is no edge of the lattice."""
        n = len(self.pieces)
        ranked = {s: k for k, s in enumerate(sorted({self.scores[i] for p, i in self.ids.items() if len(p) > 1}, reverse=True))}
        self.order, self.left, self.right = [-1] * n, [-1] * n, [-1] * n
        for p, i in self.ids.items():
            if len(p) > 1:
                self.order[i] = ranked[self.scores[i]]
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    self.joint[a * n + b] = self.order[i]
        for p, i in self.ids.items():
            if len(p) > 1:
                ends = self.merged(p)
                if len(ends) == 1 and self.order[i] >= max(self.order[x] for x in ends[0]):
                    self.left[i], self.right[i] = ends[0]
                elif len(ends) == 1:
                    raise ValueError(f"piece {p!r} is merged from a later one")
                else:
                    for table in (self.table, self.ends):
                        table[p] = 2 * _OUTSIDE + (table[p] & 1)

    def merged(self, z: str) -> list[tuple[int, int]]:
        """Plain merging of a text of known characters: of each piece that results, the ids of the two that made it."""
        now = [(self.ids[c], (_OUTSIDE, _OUTSIDE)) for c in z] if all(c in self.ids for c in z) else [(_OUTSIDE, (_OUTSIDE, _OUTSIDE))] * len(z)
        text, n = list(z), len(self.pieces)
        while len(now) > 1:
            k = min(range(len(now) - 1), key=lambda k: self.joint.get(now[k][0] * n + now[k + 1][0], n))
            if now[k][0] * n + now[k + 1][0] not in self.joint:
                break
            text[k : k + 2] = [text[k] + text[k + 1]]
            now[k : k + 2] = [(self.ids[text[k]], (now[k][0], now[k + 1][0]))]
        return [made for _, made in now]

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the joint text of pieces a and b gives a, b: no merge across their border comes in time.

        Time is walked backwards: whichever of the two border pieces was made later is taken apart
        again (of equals the right one, as leftmost merges come first), and a joint piece must not be
        due before the earliest merge that was undone.
        """
        n = len(self.pieces)
        key = a * n + b
        got = self.fit.get(key)
        if got is None:
            order, joint, due = self.order, self.joint, n
            while True:
                if joint.get(a * n + b, n) < due:
                    got = False
                    break
                if order[a] > order[b]:
                    due, a = min(due, order[a]), self.right[a]
                elif order[b] >= 0:
                    due, b = min(due, order[b] + 1), self.left[b]
                else:
                    got = True
                    break
            if len(self.fit) < 4 * REMEMBER:
                self.fit[key] = got
        return got

    def solve(self, z: str, first: int, n: int, entries: list[tuple[int, int, float]]) -> tuple[list[float], list[int]]:
        """Best sums and starts of the last edge (-1 - k: entry k) of each place of z.  Edges start at first .. n - 1, or are entries (start, end, sum)."""
        table, scores, fit, size, count, free = self.table, self.scores, self.fit, len(z), len(self.pieces), not self.merges
        best, back, last = [_LOW] * (size + 1), [-1] * (size + 1), [_OUTSIDE] * (size + 1)
        for k, (s, e, value) in enumerate(entries):
            if value > best[e]:
                best[e], back[e], last[e] = value, -1 - k, self.ids.get(z[s:e], _OUTSIDE) if s < e else _OUTSIDE
        for i in range(first, n):
            b, a, j = best[i], last[i], i + 1
            if b <= _LOW:
                continue
            got = table.get(z[i])
            if (got is None or got < 0) and b + self.unknown > best[j]:
                best[j], back[j], last[j] = b + self.unknown, i, _OUTSIDE
            while got is not None:
                x = got >> 1
                if x >= 0 and b + scores[x] > best[j]:
                    ok = free or a < 0 or fit.get(a * count + x)
                    if ok is None:
                        ok = self.fits(a, x)
                    if ok:
                        best[j], back[j], last[j] = b + scores[x], i, x
                if not got & 1 or j == size:
                    break
                j += 1
                got = table.get(z[i:j])
        return best, back

    def spell(self, piece: str) -> list[int]:
        """Ids of an edge: its piece, or an unknown character's bytes."""
        got = self.table.get(piece, 2 * _OUTSIDE) >> 1
        return [got] if got >= 0 else [self.bytes_[b] for b in piece.encode()]

    def trace(self, z: str, back: list[int], at: int) -> bytes:
        """Ids of the edges that lead to a place, back to where its path entered, as little-endian 32-bit words."""
        out: list[int] = []
        while back[at] >= 0:
            out += reversed(self.spell(z[back[at] : at]))
            at = back[at]
        return np.array(out[::-1], "<u4").tobytes()

    def learn(self, parts: set[str]) -> None:
        """Remember the ids of "▁" and each of these words."""
        if not self.merges:
            for p in parts:
                self.known[p] = self.ids_of(SPACE + p)
            return
        # A place's one edge depends on what stands before it alone: in sorted order, words share the places of common beginnings.
        get, fit, count = self.ends.get, self.fit, len(self.pieces)
        last, back, strange, before = [_OUTSIDE], [-1], [False], ""
        for part in sorted(parts):
            z = SPACE + part
            same = 0
            for x, y in zip(before, z):
                if x != y:
                    break
                same += 1
            del last[same + 1 :], back[same + 1 :], strange[same + 1 :]
            for j in range(same + 1, len(z) + 1):
                i = j - 1
                got = get(z[i])
                if got is None or got < 0:
                    last.append(_OUTSIDE)
                    back.append(i)
                    strange.append(True)
                    continue
                while True:
                    if got >= 0:
                        a, x = last[i], got >> 1
                        ok = a < 0 or fit.get(a * count + x)
                        if ok is None:
                            ok = self.fits(a, x)
                        if ok:
                            break
                    i -= 1
                    got = get(z[i:j])
                last.append(x)
                back.append(i)
                strange.append(strange[i])
            at, out = len(z), []
            if strange[at]:
                self.known[part] = self.trace(z, back, at)
            else:
                while at:
                    out.append(last[at])
                    at = back[at]
                self.known[part] = struct.pack(f"<{len(out)}I", *out[::-1])
            before = z

    def ids_of(self, z: str) -> bytes:
        return self.trace(z, self.solve(z, 0, len(z), [(0, 0, 0.0)])[1], len(z))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts."""
        split = [[] if not t else t.split(" ") if SPACE not in t and "  " not in t and t[0] != " " != t[-1] else [w[1:] for w in words(marked(t))] for t in texts]
        new = {p for parts in split for p in parts}.difference(self.known)
        if new:
            if len(self.known) + len(new) > REMEMBER:
                self.known.clear()
                new = {p for parts in split for p in parts}
            self.learn(new)
        return [b"".join(map(self.known.__getitem__, parts)) for parts in split]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.spelled.__getitem__, np.frombuffer(ids, "<u4").tolist()))[1:]

    def edges(self, z: str, cut: int) -> list[Edge]:
        """The states at a cut: edges of z that start before it and end there or after, in order."""
        out = []
        for s in range(max(0, cut - self.width), cut):
            for e in range(cut, min(s + self.width, len(z)) + 1):
                if self.table.get(z[s:e], -2) >= 0 or (e == s + 1 and self.table.get(z[s], -2) < 0):
                    out.append((s, e))
        return out


def marked(text: str) -> str:
    """The lattice's string."""
    return SPACE + text.replace(" ", SPACE)


def words(z: str) -> list[str]:
    """Cut before each run of "▁" that follows another character."""
    parts = z.split(SPACE)[1:]
    if "" not in parts:
        return [SPACE + p for p in parts]
    out, run = [], ""
    for p in parts:
        run += SPACE
        if p:
            out.append(run + p)
            run = ""
    return [*out, run] if run else out


# -- the scan over a giant text's chunks


@dataclass
class Chunk:
    """Places first .. end of z belong to the chunk; what z has before and after is there for the edges that cross its cuts."""

    z: str
    first: int
    end: int

    def entries(self, v: Vocab) -> list[Edge]:
        return v.edges(self.z, self.first) if self.first else [(0, 0)]

    def exits(self, v: Vocab) -> list[Edge]:
        return v.edges(self.z, self.end)


def _values(v: Vocab, c: Chunk, best: list[float], back: list[int], entries: list[Edge]) -> np.ndarray:
    """The sums of the exit edges that a solution has."""
    out = np.full(len(c.exits(v)), _LOW)
    for t, (s, e) in enumerate(c.exits(v)):
        start = back[e] if back[e] >= 0 else entries[-1 - back[e]][0]
        if best[e] > _LOW and start == s:
            out[t] = best[e]
    return out


def transfer(v: Vocab, c: Chunk) -> np.ndarray:
    """T[s, t] of a chunk.  Paths from different entries soon run together: beyond that only their sums differ."""
    entries = c.entries(v)
    out = np.full((len(entries), len(c.exits(v))), _LOW)
    step, most = 8 * v.width, c.end - c.first
    for k, edge in enumerate(entries):
        upto = min(step, most)
        while True:
            best, back = v.solve(c.z, c.first, c.first + upto, [(*edge, 0.0)])
            if k and upto < most:
                shift = _met(best, back, whole, c.first + upto, v.width)  # noqa: F821
                if shift is not None:
                    out[k] = np.maximum(out[whole[2]] + shift, _LOW)  # noqa: F821
                    break
                upto = min(4 * upto, most)
                continue
            if upto < most:
                upto = most
                continue
            out[k] = _values(v, c, best, back, [edge])
            if not k or max(best[c.end :]) > _LOW:
                whole = (best, back, k)
            break
    return out


def _met(best: list[float], back: list[int], whole: tuple[list[float], list[int], int], end: int, width: int) -> float | None:
    """How much greater the sums are than another solution's, if the last places before end agree in all else."""
    near = range(end - 2 * width, end + 1)
    alive = [i for i in near if best[i] > _LOW]
    other = [i for i in near if whole[0][i] > _LOW and whole[1][i] >= 0]
    if not alive:
        return _LOW if max(best[end:]) <= _LOW else None
    if [i for i in alive if i < end - width] != [i for i in other if i < end - width] or alive != other or any(back[i] != whole[1][i] for i in alive) or min(back[i] for i in alive) < 0:
        return None
    return best[alive[0]] - whole[0][alive[0]]


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return np.maximum((a[:, :, None] + b[None]).max(axis=1, initial=_LOW), _LOW)


def scan(items: list[np.ndarray], combine: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """All prefix products under an associative combine(earlier, later): pairs first, so log-many rounds."""
    if len(items) == 1:
        return items
    pairs = scan([combine(a, b) for a, b in zip(items[::2], items[1::2])], combine)
    out = [items[0]]
    for k in range(1, len(items)):
        out.append(pairs[k // 2] if k % 2 else combine(pairs[k // 2 - 1], items[k]))
    return out


def then(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Composition of maps, first applied first."""
    return second[first]


def cut(z: str, width: int, size: int | None = None) -> Iterator[Chunk]:
    size = size or CHUNK
    for a in range(0, len(z), size):
        b, low = min(a + size, len(z)), max(0, a - width)
        yield Chunk(z[low : b + width], a - low, b - low)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for uid, text, width in zip(*(c.to_pylist() for c in b.columns)):
            for k, c in enumerate(cut(marked(text), width)):
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (uid, k, c.first, c.end, c.z)], ["uid", "k", "first", "end", "z"])


def maps(v: Vocab, c: Chunk, sums: np.ndarray) -> np.ndarray:
    """The best exit, then the entry of each exit's best path (0 where there is none)."""
    entries = c.entries(v)
    best, back = v.solve(c.z, c.first, c.end, [(*edge, x) for edge, x in zip(entries, sums.tolist())])
    out = []
    for _, at in c.exits(v):
        while back[at] >= 0:
            at = back[at]
        out.append(min(-1 - back[at], len(entries) - 1))
    return np.array([int(_values(v, c, best, back, entries).argmax()), *out], "<i4")


def traced(v: Vocab, c: Chunk, sums: np.ndarray, leaves: int) -> bytes:
    """Ids of the chunk's edges on the best path to an exit."""
    _, back = v.solve(c.z, c.first, c.end, [(*edge, x) for edge, x in zip(c.entries(v), sums.tolist())])
    return v.trace(c.z, back, c.exits(v)[leaves][1])


def _each(model: str, kind: str):  # noqa: ANN202
    """A step that each chunk takes by itself; entry and exit are what the scans told it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocab.load(model)
        for b in batches:
            out = []
            for row in b.to_pylist():
                c = Chunk(row["z"], row["first"], row["end"])
                if kind == "transfer":
                    t = transfer(v, c)
                    out.append(struct.pack("<i", len(t)) + t.tobytes())
                elif kind == "maps":
                    out.append(maps(v, c, np.frombuffer(row["entry"])).tobytes())
                else:
                    out.append(traced(v, c, np.frombuffer(row["entry"]), row["exit"]))
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("k"), pa.array(out, pa.binary())], ["uid", "k", "made"])

    return run


def entry_sums(matrices: list[np.ndarray]) -> list[np.ndarray]:
    return [np.zeros(1), *(x[0] for x in scan(matrices, times)[:-1])]


def exit_edges(made: list[np.ndarray]) -> list[int]:
    """From each chunk's maps(): the best path's exit of each."""
    if len(made) == 1:
        return [int(made[0][0])]
    ahead = scan([x[1:] for x in made[:0:-1]], then)[::-1]
    return [*(int(x[made[-1][0]]) for x in ahead), int(made[-1][0])]


def _entries(g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values("k")
    found = entry_sums([np.frombuffer(x, offset=4).reshape(struct.unpack_from("<i", x)[0], -1) for x in g["made"]])
    return pd.DataFrame({"uid": g["uid"], "k": g["k"], "entry": [x.tobytes() for x in found]})


def _exits(g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values("k")
    return pd.DataFrame({"uid": g["uid"], "k": g["k"], "exit": exit_edges([np.frombuffer(x, "<i4") for x in g["made"]])})


def _joined(g: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"uid": g["uid"].iloc[:1], "ids": [b"".join(g.sort_values("k")["made"])]})


def giant_pieces(giants: DataFrame, model: str) -> DataFrame:
    """uid, ids of giant texts (uid, text), by the scan."""
    width = Vocab.load(model).width
    cuts = stored(giants.select("uid", "text", F.lit(width).alias("w")).mapInArrow(_chunks, "uid long, k long, first long, end long, z string"), "lattice-chunks")
    cuts = cuts.repartition("uid", "k")
    made = "uid long, k long, made binary"
    entry = cuts.mapInArrow(_each(model, "transfer"), made).groupBy("uid").applyInPandas(_entries, "uid long, k long, entry binary")
    known = stored(cuts.join(entry, ["uid", "k"]), "lattice-entries")
    # Written, so that no task holds a second Python worker, which would stay and fill with a vocabulary of its own.
    exits = stored(known.mapInArrow(_each(model, "maps"), made).groupBy("uid").applyInPandas(_exits, "uid long, k long, exit int"), "lattice-exits")
    return stored(known.join(exits, ["uid", "k"]).mapInArrow(_each(model, "trace"), made).groupBy("uid").applyInPandas(_joined, "uid long, ids binary"), "lattice-ids")


def _parted(docs: DataFrame, giant: int) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text) of texts up to giant characters, and the written table (doc_id, text, uid) of longer ones, if any."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    giants = stored(rows.filter(F.length("text") > giant).withColumn("uid", F.monotonically_increasing_id()), "giants")
    return rows.filter(F.coalesce(F.length("text"), F.lit(0)) <= giant), None if giants.isEmpty() else giants


def _giant_rows(giants: DataFrame, model: str) -> DataFrame:
    return giants.join(giant_pieces(giants, model), "uid").select("doc_id", "text", "ids")


PIECES = "doc_id long, ids array<int>, n_pieces long, ids_crc32 long, round_trip boolean"


def _encoded(model: str, known: bool):  # noqa: ANN202
    """The rows of texts that have their ids, or of texts alone, encoded on the way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocab.load(model)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            made = b.column(2).to_pylist() if known else [ids for k in range(0, len(texts), SLICE) for ids in v.encode_all(texts[k : k + SLICE])]
            sums = [zlib.crc32(ids) for ids in made]
            exact = [v.decode_bytes(ids) == text.replace(SPACE, " ").encode() for ids, text in zip(made, texts)]
            counts = np.array([len(x) // 4 for x in made], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(np.frombuffer(b"".join(made), "<i4")))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(counts), pa.array(sums, pa.int64()), pa.array(exact, pa.bool_())], [x.split()[0] for x in PIECES.split(", ")])
            del texts, made, exact, counts, lists
            trim()

    return run


def encode_pieces(docs: DataFrame, model: str, giant: int = GIANT) -> DataFrame:
    """doc_id, ids, n_pieces, ids_crc32 (of the ids as little-endian 32-bit words), round_trip (decoding gives the text back) for every row of docs (doc_id, text)."""
    small, giants = _parted(docs, giant)
    out = small.mapInArrow(_encoded(model, False), PIECES)
    return out if giants is None else out.unionByName(_giant_rows(giants, model).mapInArrow(_encoded(model, True), PIECES))


def _decoded(model: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocab.load(model)
        for b in batches:
            texts = [v.decode(np.array(x or (), "<u4").tobytes()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode_pieces(rows: DataFrame, model: str) -> DataFrame:
    """doc_id, text for rows (doc_id, ids); null ids give the empty text."""
    return rows.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(_decoded(model), "doc_id long, text string")


def op9_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    return encode_pieces(documents(spark, sf_dir), model or default_model())


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
