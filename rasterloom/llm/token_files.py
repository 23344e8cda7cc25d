"""Token ids in Arrow files of equal-length sequences.

Documents are range-partitioned by identifier and sorted; each task encodes its documents, appends
the end id, and packs the ids, document after document, into sequences of SEQ ids.  A file is an
Arrow IPC file of record batches with two fixed-size-list columns: ids (unsigned, 16 bits if the
vocabulary fits, else 32) and mask (one bit an id: set, or clear for the padding after the last id of
the file).  A fixed-size list has no offsets and no padding between rows, so sequence k of a batch of
16-bit ids is bytes [2 k SEQ, 2 (k + 1) SEQ) of one buffer: any sequence is reached without copying or
decoding.  A second file beside it lists its documents (doc_id, start within the file, n_tokens).

Encoding splits a text before each space that follows no white space or precedes none; no pre-token
of a byte-level tokenizer crosses such a place, so pieces can be encoded one by one and remembered.
Texts with other runs of white space at such places, or with a special token's string, are encoded
whole.

Recovery.  A task attempt writes files of its own name, and the manifest, itself a written table,
names only files of attempts that succeeded; a lost executor costs its tasks, not the files.

Defined results.  Null text is empty; an empty text is the end id alone.  Null identifiers come
first; rows of one identifier keep no order of their own: ties are ordered by a hash of the text, then by text.  An empty
table writes no file and gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, scratch, stored

SEQ, BATCH_SEQS, END_ID, REMEMBER = 2048, 64, 2, 1_000_000
_MARKS = ".,;:!?"
_UNSAFE = re.compile(r"\s (?:\s|$)")
_SCHEMA = lambda seq, ids: pa.schema([("ids", pa.list_(ids, seq)), ("mask", pa.list_(pa.bool_(), seq))])
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """A byte-level tokenizer of the tokenizers library with a memory of pieces; results are those of encode(text).

    A piece is what lies between two spaces, together with the space before it.  A piece of Latin
    letters, with sentence marks after it or not, is one pre-token or two: these go to the library's
    merge model at once, without its pre-tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        pre = self.tokenizer.pre_tokenizer
        #: Cutting before spaces holds for a byte-level pre-tokenizer alone, with nothing before or after it.
        self.cuts = type(pre).__name__ == "ByteLevel" and pre.use_regex and not pre.add_prefix_space and self.tokenizer.normalizer is None
        self.known: dict[str, bytes] = {}  # by piece, without its space
        self.marks: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        """The ids of a space and a piece."""
        if piece.isalpha() and max(piece) < "\u0250":
            got = array("I", [t.id for t in self.tokenizer.model.tokenize((" " + piece).encode().decode("latin-1").translate(self.letters))]).tobytes()
        else:
            core = piece.rstrip(_MARKS)
            if core and core != piece and core.isalpha() and max(core) < "\u0250":
                marks = piece[len(core) :]
                if marks not in self.marks and len(self.marks) < REMEMBER:
                    self.marks[marks] = self.whole(marks)
                got = (self.known.get(core) or self.piece(core)) + (self.marks.get(marks) or self.whole(marks))
            else:
                got = self.whole(" " + piece)
        if len(self.known) < REMEMBER:
            self.known[piece] = got
        return got

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit words."""
        if not self.cuts or _UNSAFE.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        first, *rest = text.split(" ")
        ids = list(map(self.known.get, rest))
        if None in ids:
            ids = [self.piece(p) if x is None else x for p, x in zip(rest, ids)]
        return self.whole(first) + b"".join(ids)


def _byte_letters() -> dict[int, str]:
    """The character by which byte-level vocabularies write each byte: itself if it prints, else the next one from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(hidden)) for b in range(256)}


def encoder(path: str) -> Encoder:
    """One for each worker and path."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class SequenceWriter:
    """Packs ids into fixed-length sequences; holds one record batch at most."""

    def __init__(self, sink, seq: int, vocabulary: int = 1 << 32) -> None:  # noqa: ANN001
        self.type = np.uint16 if vocabulary <= 1 << 16 else np.uint32
        self.schema, self.seq, self.held, self.n = _SCHEMA(seq, pa.from_numpy_dtype(self.type)), seq, [], 0
        self.writer = pa.ipc.new_file(sink, self.schema)

    def add(self, ids: bytes) -> None:
        step = 4 * self.seq * BATCH_SEQS
        self.held.append(ids)
        self.n += len(ids)
        if self.n >= step:
            joined = b"".join(self.held)
            whole = len(joined) // step * step
            for k in range(0, whole, step):
                self._write(joined[k : k + step])
            self.held, self.n = [joined[whole:]], len(joined) - whole

    def _write(self, ids: bytes) -> None:
        n = len(ids) // 4
        rows = -(-n // self.seq)
        full, mask = np.zeros(rows * self.seq, self.type), np.zeros(rows * self.seq, bool)
        full[:n], mask[:n] = np.frombuffer(ids, "<u4"), True
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq) for x in (full, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(cols, schema=self.schema))

    def close(self) -> None:
        if self.n:
            self._write(b"".join(self.held))
        self.writer.close()


class SequenceFile:
    """Random access to the sequences of a file.  A local file is memory-mapped and its arrays are views of it."""

    def __init__(self, uri: str) -> None:
        fs, path = pafs.FileSystem.from_uri(uri)
        self.source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.seq = self.reader.schema.field("ids").type.list_size

    def batches(self) -> int:
        return self.reader.num_record_batches

    def __getitem__(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """ids and mask of sequence k, views of the file's buffers."""
        b = self.reader.get_batch(k // BATCH_SEQS)
        ids, mask = (b.column(i).flatten().slice(k % BATCH_SEQS * self.seq, self.seq) for i in (0, 1))
        return ids.to_numpy(zero_copy_only=True), mask

    def stream(self) -> Iterator[np.ndarray]:
        """The ids of each batch in turn, without padding."""
        for i in range(self.batches()):
            b = self.reader.get_batch(i)
            yield b.column(0).flatten().to_numpy(zero_copy_only=True)[: b.column(1).flatten().true_count]

    def close(self) -> None:
        self.source.close()


def _write_files(model: str, folder: str, seq: int, end_id: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, enc, writer = TaskContext.get(), encoder(model), None
        end, at = np.array([end_id], "<u4").tobytes(), 0
        name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                fs, path = pafs.FileSystem.from_uri(name)
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                sink, listing = fs.open_output_stream(path + ".ids.arrow"), fs.open_output_stream(path + ".docs.arrow")
                writer, docs = SequenceWriter(sink, seq, max(end_id + 1, enc.tokenizer.get_vocab_size())), pa.ipc.new_file(listing, _DOCS)
            ids = [enc.encode(t or "") for t in b.column(1).to_pylist()]
            counts = np.array([len(x) // 4 + 1 for x in ids], np.int64)
            for x in ids:
                writer.add(x + end)
            docs.write_batch(pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(at + np.cumsum(counts) - counts), pa.array(counts)], schema=_DOCS))
            at += int(counts.sum())
        if writer is not None:
            writer.close()
            docs.close()
            sink.close()
            listing.close()
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int64()), pa.array([name]), pa.array([at], pa.int64())], ["part", "name", "n_ids"])

    return run


def write_token_files(docs: DataFrame, model: str, seq: int = SEQ, end_id: int = END_ID, parts: int | None = None) -> DataFrame:
    """Write docs (doc_id, text); the manifest: part (in doc_id order), name (of the files, without their endings), n_ids."""
    spark = docs.sparkSession
    folder = scratch(spark, "tokens")
    folder = folder if "://" in folder else f"file://{folder}"
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    spread = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    return stored(spread.mapInArrow(_write_files(model, folder, seq, end_id), "part long, name string, n_ids long"), "token-manifest")


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, base) of files to doc_id, start, n_tokens, ids_crc32 of their documents, from the files alone."""
    for b in batches:
        for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            file = SequenceFile(name + ".ids.arrow")
            fs, path = pafs.FileSystem.from_uri(name)
            with fs.open_input_file(path + ".docs.arrow") as listing:
                reader, stream, held = pa.ipc.open_file(listing), file.stream(), np.empty(0, np.uint16)
                for i in range(reader.num_record_batches):
                    docs, sums = reader.get_batch(i), []
                    for n in docs.column(2).to_pylist():
                        crc = 0
                        while n:
                            if not held.size:
                                held = next(stream)
                            got, held = held[:n], held[n:]
                            crc, n = zlib.crc32(got.astype("<u4"), crc), n - got.size
                        sums.append(crc)
                    starts = pa.array(docs.column(1).to_numpy() + base)
                    yield pa.RecordBatch.from_arrays([docs.column(0), starts, docs.column(2), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
            file.close()


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids before it in all files), n_tokens, ids_crc32.  The manifest has a row a file: its prefix sum is small."""
    spark = manifest.sparkSession
    files = sorted((tuple(r) for r in manifest.collect()))
    bases, at = [], 0
    for _, name, n in files:
        bases.append((name, at))
        at += n
    if not bases:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    rows = spark.createDataFrame(bases, "name string, base long").repartition(min(len(bases), max(1, spark.sparkContext.defaultParallelism * 4)))
    return rows.mapInArrow(_read_files, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("byte_bpe_50k.json")
    return read_token_files(write_token_files(documents(spark, sf_dir), model))
