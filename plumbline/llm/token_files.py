"""Token-id output: flat unsigned integer files with 64-bit document offsets, to be memory-mapped.

``write`` range-partitions the documents by id, encodes each partition in order and writes one set of files
per partition: ``ids-P.bin`` (document ids, int64), ``tokens-P.bin`` (unsigned 16 or 32 bit, by the size of the vocabulary)
and ``lengths-P.bin``.  The partitions' token totals then give the bases (prefix sums over one row per
partition), and ``offsets-P.bin`` gets the global start of each document and the end of the last, int64.  All
numbers are little-endian.  A file is written under a name of its own attempt and renamed, so a task that is run
again, or twice, leaves one whole file.

Words are encoded once per worker: texts are cut only before a single space followed by a letter or a
visible ASCII character and between an ASCII letter and another ASCII character, where the byte-level pattern always
begins a new piece, so the ids of a text are the ids of its pieces one after the other.  Special tokens are those of the tokenizer file, which hold no space: a text that
spells one out gets its id, as in a plain call of the library.

Cases: a null or empty text has only the end id; a null document id sorts first and is stored as the
smallest int64, read back as null; repeated ids stay separate documents, ordered by the hash of their text;
an empty table writes no document and reads back empty.  Other columns are not read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import blocks as B
from plumbline.session import pin

NO_ID = np.iinfo(np.int64).min
#: Bytes that may follow a space at a cut: visible ASCII and two-byte characters from U+00C0 on.
_OPENS = np.zeros(256, bool)
_OPENS[0x21:0x7F] = True
_OPENS[0xC3:0xE0] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_OTHER = ~_LETTER
_OTHER[0x80:] = False

#: Pieces encoded as one text.
JOINED = 512

_workers: dict[str, Encoder] = {}


class Encoder:
    """Encodes blocks of texts with a tokenizer file, each distinct piece once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.memory = B.Memory()
        #: bytes of each token: a byte-level vocabulary writes one character for a byte
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = [token.content.encode() for token in added.values()]
        self.widths = np.zeros(self.vocabulary, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.widths[i] = len(added[i].content.encode()) if i in added else len(token)

    def encode(self, block: B.Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and the number of ids of each text."""
        data = block.data
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(block), np.int64)
        cut = np.zeros(len(data) + 1, bool)
        cut[:-2] = (data[:-1] == 0x20) & _OPENS[data[1:]]
        raw = data.tobytes()
        if not any(token in raw for token in self.added):  # which may hold letters and marks
            cut[1:-1] |= _LETTER[data[:-1]] & _OTHER[data[1:]]
        cut[block.offsets] = True
        starts = np.flatnonzero(cut)
        starts, ends = starts[:-1], starts[1:]
        h = B.span_hashes(data, starts, ends)
        ids, to = self.memory.spread(
            h, lambda first: self._learn([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]))
        per_text = to[np.searchsorted(starts, block.offsets)]
        return ids, np.diff(per_text)

    def _learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number for each piece.

        Pieces that begin with a space at a cut are joined ``JOINED`` at a time, as in a text, and told apart again by the bytes of their
        ids.  The others, and joined texts whose ids do not end where the pieces end, are encoded one by one.
        """
        counts = np.zeros(len(pieces), np.int64)
        opens = [k for k, p in enumerate(pieces) if len(p) > 1 and p[0] == 0x20 and _OPENS[p[1]]]
        alone = sorted(set(range(len(pieces))).difference(opens))
        groups = [opens[k:k + JOINED] for k in range(0, len(opens), JOINED)]
        joined = [b"".join([pieces[k] for k in g]).decode("utf-8", "replace") for g in groups]
        order: list[int] = []
        parts: list[np.ndarray] = []
        for group, got in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(got.ids, np.uint32)
            reached = np.cumsum(self.widths[ids])
            wanted = np.cumsum([len(pieces[k]) for k in group])
            last = np.searchsorted(reached, wanted)
            if len(ids) and reached[-1] == wanted[-1] and (reached[last] == wanted).all():
                counts[group] = np.diff(last + 1, prepend=0)
                order.extend(group)
                parts.append(ids)
            else:
                alone.extend(group)
        for k, got in zip(alone, self.tokenizer.encode_batch_fast(
                [pieces[k].decode("utf-8", "replace") for k in alone], add_special_tokens=False)):
            counts[k] = len(got.ids)
            order.append(k)
            parts.append(np.array(got.ids, np.uint32))
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        place = np.zeros(len(pieces), np.int64)
        place[order] = np.cumsum(counts[order]) - counts[order]
        to = np.cumsum(counts)
        return flat[np.repeat(place - (to - counts), counts) + np.arange(to[-1] if len(to) else 0)], counts


def encoder(path: str) -> Encoder:
    """The encoder of this worker process, kept between tasks."""
    if path not in _workers:
        _workers[path] = Encoder(path)
    return _workers[path]


def _file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    if "://" in folder or folder.startswith("file:"):
        return pafs.FileSystem.from_uri(folder)
    return pafs.LocalFileSystem(), folder


def _put(fs: pafs.FileSystem, path: str, parts: Iterator[bytes]) -> None:
    attempt = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(attempt) as out:
        for part in parts:
            out.write(part)
    fs.move(attempt, path)


def _array(fs: pafs.FileSystem, path: str, kind: str) -> np.ndarray:
    """The file memory-mapped where it is local, else read."""
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    with fs.open_input_file(path) as source:
        return np.frombuffer(source.read(), kind)


def _name(folder: str, kind: str, part: int) -> str:
    return f"{folder}/{kind}-{part:06d}.bin"


def token_kind(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def write(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, parts: int | None = None,
    id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Write all documents in ascending id order; returns the manifest, one row per partition with
    ``part, n_docs, n_tokens, base, kind``.  ``folder`` is one that all executors share."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(folder)
        part = TaskContext.get().partitionId()
        enc = encoder(tokenizer)
        kind = token_kind(enc.vocabulary)
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []

        def tokens() -> Iterator[bytes]:
            for batch in batches:
                ids.append(batch.column(0).cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False))
                for block in B.blocks(batch.column(1)):
                    flat, n = enc.encode(block)
                    ends = np.cumsum(n)
                    lengths.append(n + 1)
                    yield np.insert(flat, ends, end_id).astype(kind).tobytes()

        fs.create_dir(root, recursive=True)
        _put(fs, _name(root, "tokens", part), tokens())
        n = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        _put(fs, _name(root, "ids", part), iter([np.concatenate(ids).astype("<i8").tobytes() if ids else b""]))
        _put(fs, _name(root, "lengths", part), iter([n.astype("<i8").tobytes()]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([part]), pa.array([len(n)]), pa.array([int(n.sum())]), pa.array([kind])],
            names=["part", "n_docs", "n_tokens", "kind"])

    ordered = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    ordered = ordered.repartitionByRange(parts, "_id", F.xxhash64("_text")).sortWithinPartitions(
        "_id", F.xxhash64("_text"))
    # reliable: the files of one run of the stage and its totals must stay together
    written = pin(ordered.mapInArrow(encode, "part long, n_docs long, n_tokens long, kind string"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    manifest = written.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                n = _array(fs, _name(root, "lengths", row["part"]), "<i8")
                starts = row["base"] + np.concatenate([[0], np.cumsum(n)])
                _put(fs, _name(root, "offsets", row["part"]), iter([starts.astype("<i8").tobytes()]))
            yield batch

    columns = "part long, n_docs long, n_tokens long, kind string, base long"
    return pin(manifest.repartition(parts, "part").mapInArrow(offsets, columns))


def read(manifest: DataFrame, folder: str, id: str = "doc_id", with_tokens: bool = False) -> DataFrame:
    """One row per document from the files alone: ``id, start, n_tokens, ids_crc32`` and, if asked, ``tokens``."""
    columns = f"`{id}` long, start long, n_tokens long, ids_crc32 long" + ", tokens array<long>" * with_tokens

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                part = row["part"]
                tokens = _array(fs, _name(root, "tokens", part), row["kind"])
                offsets = _array(fs, _name(root, "offsets", part), "<i8")
                ids = _array(fs, _name(root, "ids", part), "<i8")
                for low in range(0, len(ids), 4096):
                    own = np.array(ids[low:low + 4096])
                    at = np.array(offsets[low:low + len(own) + 1])
                    spans = [tokens[a:b] for a, b in zip(at[:-1] - offsets[0], at[1:] - offsets[0])]
                    out = [
                        pa.array(own, pa.int64(), mask=own == NO_ID), pa.array(at[:-1], pa.int64()),
                        pa.array(np.diff(at), pa.int64()),
                        pa.array([zlib.crc32(np.asarray(s, "<u4").tobytes()) for s in spans], pa.int64())]
                    if with_tokens:
                        out.append(pa.array([np.asarray(s, np.int64) for s in spans], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(
                        out, names=[id, "start", "n_tokens", "ids_crc32", "tokens"][:len(out)])

    return manifest.repartition("part").mapInArrow(scan, columns)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the one the session names in ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
