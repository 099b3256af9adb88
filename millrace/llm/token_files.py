"""Token ids as Arrow files of equal-length sequences.

A data set is a folder of parts.  Part ``p`` holds the documents of one range of the
order, and consists of two Arrow files (the stream format followed by a footer, so any
batch can be reached at once and memory-mapped without copies):

* ``part-p.ids.arrow``: ``ids fixed_size_list<uint16 or uint32>[L]`` and
  ``mask fixed_size_list<bool>[L]``.  All tokens of the part one after the other in rows of
  ``L``; the mask is false only for the padding at the end of the part.  Every batch but
  the last has ``BATCH_ROWS`` rows, so row ``r`` is row ``r % BATCH_ROWS`` of batch
  ``r // BATCH_ROWS``.
* ``part-p.docs.arrow``: ``doc_id, start, n_tokens`` of each document, in order; ``start``
  counts from the beginning of the part.

Parts are written by Spark tasks under a name of their own and moved into place when
complete; the manifest names the parts whose task succeeded, so lost executors and
repeated tasks leave a valid data set.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from .common import col, new_path, only, prepared, shuffle_partitions, slices, written
from .token_counts import special_strings

BATCH_ROWS = 512
CACHE_ENTRIES = 500_000
CACHED_CHARS = 60
MANIFEST = "part int, path string, n_docs bigint, n_tokens bigint"

# The pre-token pattern of byte-level tokenizers, written out for texts that hold
# nothing but ASCII, blanks, line ends and Latin letters.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_PLAIN = re.compile(f"[ -~\\n{_LATIN}]*")
_PRE_TOKEN = re.compile(
    f"'(?:[stmd]|re|ve|ll)| ?[{_LATIN}]+| ?[0-9]+| ?[!-/:-@\\[-`{{-~]+|[ \\n]+(?![^ \\n])|[ \\n]+")

#: fixed values: byte-level models name printable bytes by themselves and all others by characters from U+0100 on
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_NAMES = {b: 0x100 + i for i, b in enumerate(b for b in range(0x100) if b not in _PRINTABLE)}

_ENCODERS: dict[str, "PreTokenIds"] = {}


class PreTokenIds:
    """Little-endian ids of texts, by pre-tokens that the library encodes on first sight.

    Pre-tokens are encoded independently of each other, so the ids of a text are those of its
    pre-tokens.  A worker remembers them in two generations: what a text needs moves to the young
    one, and when that is full the old one is forgotten, so frequent pre-tokens stay and memory is bounded.
    Texts with characters whose class the pattern here does not state, or with the string of
    a special token, are encoded whole by the library.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are what runs side by side
        self.tokenizer = Tokenizer.from_file(path)
        self.specials = special_strings(path)
        self.by_bytes = (
            self.tokenizer.normalizer is None and isinstance(self.tokenizer.pre_tokenizer, ByteLevel)
            and not self.tokenizer.pre_tokenizer.add_prefix_space)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _merged(self, pre_tokens: list[str]) -> list[list[int]]:
        if self.by_bytes:  # nothing but the merges of the model is left to do
            tokenize = self.tokenizer.model.tokenize
            return [[t.id for t in tokenize(p.encode().decode("latin-1").translate(_BYTE_NAMES))] for p in pre_tokens]
        return [e.ids for e in self.tokenizer.encode_batch_fast(pre_tokens, add_special_tokens=False)]

    def _learn(self, pre_tokens: list[str]) -> None:
        unseen = []
        for p in pre_tokens:
            ids = self.old.get(p)
            if ids is None:
                unseen.append(p)
            else:
                self.young[p] = ids
        if unseen:
            found = self._merged(unseen)
            data = np.fromiter(chain.from_iterable(found), self.dtype).tobytes()
            at, size = 0, self.dtype.itemsize
            for p, ids in zip(unseen, found):
                self.young[p] = data[at:at + len(ids) * size]
                at += len(ids) * size

    def of_text(self, text: str) -> bytes:
        if not _PLAIN.fullmatch(text) or any(s in text for s in self.specials):
            return self.encode(text)
        if len(self.young) >= CACHE_ENTRIES // 2:
            self.young, self.old = {}, self.young
        pre_tokens, young = _PRE_TOKEN.findall(text), self.young
        new = [p for p in set(pre_tokens) if p not in young]
        self._learn(new)
        ids = b"".join(map(young.__getitem__, pre_tokens))
        for p in new:
            if len(p) > CACHED_CHARS:
                del young[p]
        return ids


def _encoder(path: str) -> PreTokenIds:
    if path not in _ENCODERS:
        _ENCODERS[path] = PreTokenIds(path)
    return _ENCODERS[path]


class _Sequences:
    """Cuts a run of ids into rows of equal length and writes them batch by batch."""

    def __init__(self, sink, length: int, dtype: np.dtype):
        self.length, self.dtype = length, dtype
        self.schema = pa.schema([
            ("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length)),
        ])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.pending, self.size = [], 0

    def add(self, ids: bytes) -> None:
        self.pending.append(ids)
        self.size += len(ids) // self.dtype.itemsize
        if self.size >= BATCH_ROWS * self.length:
            values = np.frombuffer(b"".join(self.pending), self.dtype)
            step = BATCH_ROWS * self.length
            whole = len(values) // step * step
            for at in range(0, whole, step):
                self._write(values[at:at + step], step)
            self.pending, self.size = [values[whole:].tobytes()], len(values) - whole

    def _write(self, values: np.ndarray, used: int) -> None:
        mask = np.arange(len(values)) < used
        self.writer.write_batch(pa.RecordBatch.from_arrays([
            pa.FixedSizeListArray.from_arrays(pa.array(values), self.length),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length),
        ], schema=self.schema))

    def close(self) -> None:
        values = np.frombuffer(b"".join(self.pending), self.dtype)
        if len(values):
            padded = np.zeros(-(-len(values) // self.length) * self.length, self.dtype)
            padded[:len(values)] = values
            self._write(padded, len(values))
        self.writer.close()


def _file_system(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path[5:])


DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _write_parts(folder: str, tokenizer: str, end_id: int, length: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = task.partitionId()
        encoder = _encoder(tokenizer)
        end = np.array([end_id], encoder.dtype).tobytes()
        fs, root = _file_system(folder)
        own = f"{root}/_writing/{part}-{task.taskAttemptId()}"
        sequences = docs = None
        n_docs = n_tokens = 0
        with_files = []
        for batch in slices(batches, "text"):
            if sequences is None:
                fs.create_dir(own, recursive=True)
                with_files = [fs.open_output_stream(f"{own}/{x}.arrow") for x in ("ids", "docs")]
                sequences = _Sequences(with_files[0], length, encoder.dtype)
                docs = pa.ipc.new_file(with_files[1], DOCS)
            starts, sizes = [], []
            for text in batch.column(1).to_pylist():
                ids = (encoder.of_text(text) if text else b"") + end
                n = len(ids) // encoder.dtype.itemsize
                sequences.add(ids)
                starts.append(n_tokens)
                sizes.append(n)
                n_tokens += n
            n_docs += batch.num_rows
            docs.write_batch(pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=DOCS))
        if sequences is None:
            return
        sequences.close()
        docs.close()
        for file in with_files:
            file.close()
        path = f"part-{part:06d}-{task.taskAttemptId()}"
        for x in ("ids", "docs"):
            fs.move(f"{own}/{x}.arrow", f"{root}/{path}.{x}.arrow")
        fs.delete_dir(own)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([path]), pa.array([n_docs], pa.int64()),
             pa.array([n_tokens], pa.int64())], names=["part", "path", "n_docs", "n_tokens"])

    return write


@dataclass(frozen=True)
class TokenFiles:
    """A written data set: where it is, and its manifest (one row per part)."""

    folder: str
    length: int
    manifest: DataFrame


def write_token_files(
    docs: DataFrame, tokenizer: str, end_id: int, order_by: Sequence[Column], length: int = 2048,
    folder: str | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> TokenFiles:
    """Encode every whole text, append ``end_id``, and write the ids in the order of ``order_by``.

    Null texts count as empty and give the end id alone.  Texts are encoded without begin or
    end tokens of the tokenizer; its special strings inside a text become their ids.  Rows
    that the order does not tell apart stay next to each other.  An empty table gives an
    empty data set.
    """
    spark = prepared(docs.sparkSession)
    folder = folder or new_path(spark, "tokens", listed=False)
    keyed = docs.select(
        col(id_col).cast("bigint").alias("doc_id"), col(text_col).alias("text"),
        *[c.alias(f"_k{i}") for i, c in enumerate(order_by)])
    keys = [F.col(f"_k{i}") for i in range(len(order_by))]
    ordered = (
        keyed.repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    )
    manifest = written(
        ordered.mapInArrow(_write_parts(folder, tokenizer, end_id, length), MANIFEST), "token-manifest")
    with open_text(folder, "_format.json") as file:
        file.write(json.dumps({"length": length, "batch_rows": BATCH_ROWS, "end_id": end_id}).encode())
    return TokenFiles(folder, length, manifest)


def open_text(folder: str, name: str):
    fs, root = _file_system(folder)
    fs.create_dir(root, recursive=True)
    return fs.open_output_stream(f"{root}/{name}")


class PartReader:
    """Random access to one part; memory-mapped where the folder is a local or shared mount."""

    def __init__(self, folder: str, path: str, length: int):
        fs, root = _file_system(folder)
        where = f"{root}/{path}"
        if fs.type_name == "local":
            ids, docs = (pa.memory_map(f"{where}.{x}.arrow") for x in ("ids", "docs"))
        else:
            ids, docs = (fs.open_input_file(f"{where}.{x}.arrow") for x in ("ids", "docs"))
        self.ids, self.docs, self.length = pa.ipc.open_file(ids), pa.ipc.open_file(docs), length
        self._at, self._values = -1, None

    def batch(self, number: int) -> np.ndarray:
        """All ids of one batch as a flat array, without a copy."""
        if number != self._at:
            self._at, self._values = number, self.ids.get_batch(number).column(0).flatten().to_numpy(zero_copy_only=True)
        return self._values

    def sequence(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of one row of equal length."""
        batch = self.ids.get_batch(row // BATCH_ROWS)
        at = row % BATCH_ROWS
        return batch.column(0)[at].values.to_numpy(), batch.column(1)[at].values.to_numpy(zero_copy_only=False)

    def tokens(self, start: int, n: int) -> np.ndarray:
        step = BATCH_ROWS * self.length
        pieces = []
        while n > 0:
            number, inside = divmod(start, step)
            piece = self.batch(number)[inside:inside + n]
            pieces.append(piece)
            start, n = start + len(piece), n - len(piece)
        return pieces[0] if len(pieces) == 1 else np.concatenate(pieces) if pieces else np.zeros(0, "<u4")


def read_documents(files: TokenFiles) -> DataFrame:
    """Read a data set back: ``doc_id, start, n_tokens, ids_crc32``, one row per document.

    ``start`` counts the ids of all documents before; the checksum is over the ids as
    little-endian unsigned 32-bit integers.
    """
    spark = prepared(files.manifest.sparkSession)
    # one row per part: bounded by the partitions of the sort
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.manifest.withColumn("offset", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    folder, length = files.folder, files.length

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = PartReader(folder, path, length)
                for b in range(part.docs.num_record_batches):
                    docs = part.docs.get_batch(b)
                    starts, sizes = docs.column(1).to_numpy(), docs.column(2).to_numpy()
                    crc = [zlib.crc32(part.tokens(s, n).astype("<u4").tobytes()) for s, n in zip(starts, sizes)]
                    yield pa.RecordBatch.from_arrays(
                        [docs.column(0), pa.array(starts + offset), docs.column(2), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = parts.select("path", "offset").repartition(shuffle_partitions(spark))
    return spread.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
