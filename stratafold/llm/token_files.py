"""Token ids as Arrow files: equal-length sequences and masks in fixed-size lists, read without copies at any place.

Documents are put in ascending ``doc_id`` order over range partitions. Every partition encodes its texts, appends the end id to
each, and writes one Arrow file of sequences of ``length`` ids; only a file's last sequence is padded, and the mask marks the
real ids. A row also holds which documents begin in it and where. The position of a document in the whole stream is the total
of the files before its own plus its place there, so nothing is encoded twice and no task sees more than its own part.

Nulls: a null text is an empty one; a null ``doc_id`` comes first. Repeated ids are ordered by their text's hash and keep one
entry each. An empty table gives no rows. Extra columns are ignored. Long texts run over as many sequences as they need.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratafold.llm.common import parts_for
from stratafold.llm.tokens import default_vocabulary, encoder

#: Sequences in a record batch.
BATCH_ROWS = 256
MANIFEST = "file int, path string, sequences long, tokens long, documents long"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path with or without scheme, and the path in it."""
    if path.startswith("file:") or "://" not in path:
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path)


def file_schema(length: int, kind: pa.DataType) -> pa.Schema:
    return pa.schema([
        ("input_ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length)),
        ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int32())),
    ])


class _Writer:
    """Collects ids and writes a record batch whenever ``BATCH_ROWS`` sequences are full."""

    def __init__(self, sink, length: int, kind: np.dtype):
        self.length, self.kind = length, kind
        self.schema = file_schema(length, pa.from_numpy_dtype(kind))
        self.out = pa.ipc.new_file(sink, self.schema)
        self.held, self.held_ids, self.starts = [], 0, []
        self.sequences = self.tokens = self.documents = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.starts.append((doc_id, self.held_ids))
        self.held.append(ids)
        self.held_ids += len(ids)
        self.tokens += len(ids)
        self.documents += 1
        if self.held_ids >= BATCH_ROWS * self.length:
            self._flush(self.held_ids // (BATCH_ROWS * self.length) * BATCH_ROWS)

    def _flush(self, rows: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, self.kind)
        size = rows * self.length
        real = min(size, len(ids))
        filled = np.zeros(size, self.kind)
        filled[:real] = ids[:real]
        mask = np.zeros(size, bool)
        mask[:real] = True
        begun = [(d, s) for d, s in self.starts if s < size]
        limits = np.searchsorted(np.array([s for _, s in begun], np.int64), np.arange(rows + 1) * self.length).astype(np.int32)
        lists = [
            pa.ListArray.from_arrays(limits, pa.array([d for d, _ in begun], pa.int64())),
            pa.ListArray.from_arrays(limits, pa.array([s % self.length for _, s in begun], pa.int32())),
        ]
        fixed = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (filled, mask)]
        for at in range(0, rows, BATCH_ROWS):
            self.out.write_batch(pa.record_batch([x.slice(at, BATCH_ROWS) for x in (*fixed, *lists)], schema=self.schema))
        self.sequences += rows
        rest = ids[real:]
        self.held, self.held_ids = [rest], len(rest)
        self.starts = [(d, s - size) for d, s in self.starts if s >= size]

    def close(self) -> None:
        if self.held_ids:
            self._flush(-(-self.held_ids // self.length))
        self.out.close()


def write_token_files(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = 2, length: int = 2048, plain_specials: bool = False) -> DataFrame:
    """Writes the files when evaluated; one row per file. Store it before use, so that it is evaluated once.

    A file appears under its final name only when it is whole; a repeated task writes the same bytes again.
    """
    vocabulary = vocabulary or default_vocabulary()

    def write(batches):
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        code = encoder(vocabulary, plain_specials)
        store, root = file_system(folder)
        store.create_dir(root, recursive=True)
        final, made = f"{root}/part-{part:06d}.arrow", f"{root}/.part-{part:06d}-{attempt}"
        end = np.array([end_id], code.kind)
        with store.open_output_stream(made) as sink:
            writer = _Writer(sink, length, code.kind)
            for batch in batches:
                for doc_id, ids in zip(batch["doc_id"].to_pylist(), code.encode(batch["text"].to_pylist()), strict=True):
                    writer.add(doc_id, np.concatenate([np.frombuffer(ids, code.kind), end]))
            writer.close()
        if store.get_file_info(final).type == pafs.FileType.File:
            store.delete_file(final)
        store.move(made, final)
        yield pa.RecordBatch.from_pylist([{
            "file": part, "path": f"{folder}/part-{part:06d}.arrow",
            "sequences": writer.sequences, "tokens": writer.tokens, "documents": writer.documents,
        }], schema=pa.schema([("file", pa.int32()), ("path", pa.string()), ("sequences", pa.int64()), ("tokens", pa.int64()), ("documents", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("_h", F.xxhash64("text"))
    return (rows.repartitionByRange(parts_for(rows), "doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
            .mapInArrow(write, MANIFEST))


def with_starts(manifest: DataFrame) -> DataFrame:
    """Adds ``first``: the ids of all files before. One row per file of tens of MB, so a plain window carries it."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


class TokenFile:
    """Random access to the sequences of one file; on a local disk the arrays are views of the mapped file."""

    def __init__(self, path: str):
        store, inner = file_system(path)
        source = pa.memory_map(inner) if isinstance(store, pafs.LocalFileSystem) else store.open_input_file(inner)
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("input_ids").type.list_size
        self.batches = self.file.num_record_batches

    def batch(self, i: int) -> pa.RecordBatch:
        return self.file.get_batch(i)

    def __len__(self) -> int:
        return (self.batches - 1) * BATCH_ROWS + self.batch(self.batches - 1).num_rows if self.batches else 0

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids, without a copy, and mask of sequence ``i``."""
        batch, at = self.batch(i // BATCH_ROWS), i % BATCH_ROWS
        ids, mask = (batch[c].flatten().slice(at * self.length, self.length) for c in ("input_ids", "mask"))
        return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=False)


def documents_of(path: str):
    """``(doc_id, start in the file, number of ids, crc32 of the ids as unsigned 32-bit numbers)`` of each document, batch by batch."""
    file, at, open_doc = TokenFile(path), 0, None
    for b in range(file.batches):
        batch = file.batch(b)
        ids = batch["input_ids"].flatten().to_numpy(zero_copy_only=True)
        real = int(np.count_nonzero(batch["mask"].flatten().to_numpy(zero_copy_only=False)))
        rows = np.repeat(np.arange(batch.num_rows), np.diff(batch["doc_starts"].offsets.to_numpy()))
        starts = (rows * file.length + batch["doc_starts"].flatten().to_numpy()).tolist()
        limits = [0, *starts, real]
        for i, (a, e) in enumerate(zip(limits, limits[1:], strict=False)):
            if i:
                if open_doc is not None:
                    yield tuple(open_doc)
                open_doc = [batch["doc_ids"].flatten()[i - 1].as_py(), at + a, 0, 0]
            if e > a:
                open_doc[2] += e - a
                open_doc[3] = zlib.crc32(ids[a:e].astype("<u4").tobytes(), open_doc[3])
        at += real
    if open_doc is not None:
        yield tuple(open_doc)


def read_documents(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read from the files of a manifest with ``first``."""

    def read(batches):
        for batch in batches:
            for path, first in zip(batch["path"].to_pylist(), batch["first"].to_pylist(), strict=True):
                found = list(documents_of(path))
                columns = list(zip(*found, strict=True)) if found else [[], [], [], []]
                yield pa.record_batch([
                    pa.array(columns[0], pa.int64()), pa.array([first + s for s in columns[1]], pa.int64()),
                    pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64()),
                ], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("file", "path", "first")
    return files.repartition(max(1, manifest.count()), "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
