"""Token ids in files of fixed-width bit-packed blocks.

A file holds, in this order: the blocks, the document table, the block offsets, and a tail of fixed size.

* A block is ``block_ids`` ids (the last one may be shorter), each in ``width`` bits, lowest bit first, padded to whole
  bytes. ``width`` is the least number of bits that holds every id of the vocabulary.
* The document table is two arrays of little-endian 64-bit integers: the doc_ids, then each document's first id
  position in the file. A null doc_id is written as the smallest 64-bit integer.
* The block offsets are little-endian 64-bit integers, one more than there are blocks.
* The tail names the version, width, block size and the counts.

A reader seeks the tail, then unpacks any block by itself with numpy, so any range of ids is reached without reading
what stands before it.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from meterlens.llm.wordmemo import word_encoder
from meterlens.session import cut, shared_dir

MAGIC = b"TOKBITS1"
#: Magic, width, ids per block, ids, documents.
TAIL = "<8sIIQQ"
TAIL_BYTES = struct.calcsize(TAIL)
BLOCK_IDS = 1 << 16
END_ID = 1
NO_ID = -(2**63)


def width_of(vocab_size: int) -> int:
    """Bits of the largest id, one at least."""
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids in ``width`` bits each, lowest bit first, padded with zero bits to whole bytes."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id does not fit {width} bits")
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, count: int, width: int) -> np.ndarray:
    """The ``count`` ids that ``pack`` wrote, as 32-bit integers."""
    if width in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{width // 8}", count=count).astype("<u4")
    bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=count * width, bitorder="little")
    full = np.zeros((count, 32), dtype=np.uint8)
    full[:, :width] = bits.reshape(count, width)
    return np.packbits(full, axis=1, bitorder="little").view("<u4").reshape(-1)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class Writer:
    """Streams documents into one file; holds one block and the document table."""

    def __init__(self, path: str, width: int, block_ids: int = BLOCK_IDS) -> None:
        store, name = _store(path)
        self.out = store.open_output_stream(name)
        self.width, self.block_ids = width, block_ids
        self.waiting: list[np.ndarray] = []
        self.held = self.ids = 0
        self.offsets, self.docs, self.starts = [0], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(NO_ID if doc_id is None else doc_id)
        self.starts.append(self.ids)
        self.ids += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block_ids:
            self._flush(False)

    def _flush(self, all_of_it: bool) -> None:
        ids = np.concatenate([np.zeros(0, dtype="<u4"), *self.waiting])
        whole = len(ids) if all_of_it else len(ids) // self.block_ids * self.block_ids
        for at in range(0, whole, self.block_ids):
            block = pack(ids[at : min(at + self.block_ids, whole)], self.width)
            self.out.write(block)
            self.offsets.append(self.offsets[-1] + len(block))
        self.waiting = [ids[whole:]]
        self.held = len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        for column in (self.docs, self.starts, self.offsets):
            self.out.write(np.array(column, dtype="<i8").tobytes())
        self.out.write(struct.pack(TAIL, MAGIC, self.width, self.block_ids, self.ids, len(self.docs)))
        self.out.close()


class Reader:
    """Random access to one file."""

    def __init__(self, path: str) -> None:
        store, name = _store(path)
        self.file = store.open_input_file(name)
        size = self.file.size()
        magic, self.width, self.block_ids, self.ids, n_docs = struct.unpack(
            TAIL, self._bytes(size - TAIL_BYTES, TAIL_BYTES)
        )
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")
        blocks = -(-self.ids // self.block_ids)
        offsets_at = size - TAIL_BYTES - 8 * (blocks + 1)
        self.offsets = np.frombuffer(self._bytes(offsets_at, 8 * (blocks + 1)), dtype="<i8")
        table = np.frombuffer(self._bytes(offsets_at - 16 * n_docs, 16 * n_docs), dtype="<i8")
        self.docs, self.starts = table[:n_docs], np.append(table[n_docs:], self.ids)

    def _bytes(self, at: int, count: int) -> bytes:
        self.file.seek(at)
        return self.file.read(count)

    def range(self, start: int, stop: int) -> np.ndarray:
        """The ids from position ``start`` to before ``stop``; reads the blocks they lie in, and no others."""
        if start >= stop:
            return np.zeros(0, dtype="<u4")
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        at = int(self.offsets[first])
        data = self._bytes(at, int(self.offsets[last + 1]) - at)
        parts = []
        for b in range(first, last + 1):
            count = min(self.block_ids, self.ids - b * self.block_ids)
            parts.append(unpack(data[int(self.offsets[b]) - at : int(self.offsets[b + 1]) - at], count, self.width))
        ids = np.concatenate(parts)
        return ids[start - first * self.block_ids : stop - first * self.block_ids]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) of each document in file order, a few blocks in memory at a time."""
        at, i = 0, 0
        while i < len(self.docs):
            # as many documents as fill some blocks, one at least
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + 4 * self.block_ids, "right")) - 1)
            at, stop = int(self.starts[i]), int(self.starts[j])
            ids = self.range(at, stop)
            for d in range(i, j):
                doc = int(self.docs[d])
                start = int(self.starts[d])
                yield None if doc == NO_ID else doc, start, ids[start - at : int(self.starts[d + 1]) - at]
            i = j


def write_token_files(
    documents: DataFrame,
    tokenizer_path: str,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    block_ids: int = BLOCK_IDS,
) -> DataFrame:
    """Encode every text, end it with ``end_id``, and write files of ids in ascending doc_id order.

    Returns the manifest, one row per file in order: part, path, n_ids, n_docs and base, the number of ids in all
    files before it. Null texts are empty; null doc_ids come first; rows of equal doc_id are ordered by text hash. A
    task writes to a name of its own and the manifest names the files of the attempts that succeeded, so a lost
    executor leaves unnamed files at worst. An empty table gives an empty manifest.
    """
    spark = documents.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    folder = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"
    store, name = _store(folder)
    store.create_dir(name, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer = word_encoder(tokenizer_path), None
        end = np.array([end_id], dtype="<u4")
        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.tok"
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for doc, ids in zip(some.column(0).to_pylist(), encoder.encode_batch(some.column(1).to_pylist())):
                    writer = writer or Writer(path, width_of(max(encoder.vocab_size, end_id + 1)), block_ids)
                    writer.add(doc, np.concatenate([ids, end]))
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "path": [path], "n_ids": [writer.ids], "n_docs": [len(writer.docs)]}
            )

    rows = documents.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    order = ["doc_id", F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    files = cut(ranged.mapInArrow(run, "part long, path string, n_ids long, n_docs long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every document in the files; ``start`` counts all ids before it."""
    return _read(manifest, "ids array<long>", lambda ids: [ids.astype("<i8")])


def token_digests(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files."""
    return _read(
        manifest,
        "n_tokens long, ids_crc32 long",
        lambda ids: [len(ids), zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())],
    )


def _read(manifest: DataFrame, schema: str, measure) -> DataFrame:
    names = ["doc_id", "start", *[field.split()[0] for field in schema.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for path, base in zip(files.column("path").to_pylist(), files.column("base").to_pylist()):
                rows, held = [], 0
                for doc, start, ids in Reader(path).documents():
                    rows.append((doc, base + start, *measure(ids)))
                    held += len(ids)
                    if held > 1 << 20:
                        yield pa.RecordBatch.from_arrays(_columns(rows), names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays(_columns(rows), names)

    files = max(1, manifest.count())
    return manifest.select("path", "base").repartition(files).mapInArrow(run, f"doc_id long, start long, {schema}")


def _columns(rows: list[tuple]) -> list[pa.Array]:
    kinds = [pa.int64(), pa.int64()]
    out = []
    for n, column in enumerate(zip(*rows)):
        kind = kinds[n] if n < 2 else pa.list_(pa.int64()) if isinstance(column[0], np.ndarray) else pa.int64()
        out.append(pa.array(column, kind))
    return out
