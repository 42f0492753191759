"""Token ids in bit-packed files with block offsets (operator 5).

A file is one byte string: a header, the documents' ids and starts, the blocks' offsets, then blocks of BLOCK_IDS ids,
each id in the fewest bits that hold the vocabulary. Any id range is read by unpacking only the blocks it touches.
Files are stored as rows of a table in the shared folder, so Spark's committer decides which attempt of a task counts;
``export_file`` writes one out under a plain path.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, given_id, on_workers, some_id, stage, trimmed
from .encoding import encoder, slices

MAGIC = b"MWTK"
HEADER = struct.Struct("<4sBxxxIQQ")  # magic, bits an id, ids a block, documents, ids
BLOCK_IDS = 8192
#: A file ends when it holds so many ids.
FILE_IDS = 16_000_000
#: Ranges of doc_id that are put in order apart; the quantiles that cut them keep some 4 x MAX_RANGES values.
DOCS_PER_RANGE = 2048
MAX_RANGES = 16_384


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below ``vocabulary``."""
    return max(1, (max(1, vocabulary) - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as ``bits`` wide fields, least bit first, padded to whole bytes."""
    ids = np.ascontiguousarray(ids, "<u4")
    if bits < 32 and len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs over {bits} bits")
    if bits == 16:
        return ids.astype("<u2").tobytes()
    fields = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(fields.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, count: int, bits: int) -> np.ndarray:
    """The first ``count`` ids of a packed block."""
    if bits == 16:
        return np.frombuffer(data, "<u2", count).astype("<u4")
    fields = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    whole = np.zeros((count, 32), np.uint8)
    whole[:, :bits] = fields
    return np.packbits(whole, axis=1, bitorder="little").view("<u4").reshape(-1)


def packed(ids: np.ndarray, at: np.ndarray, bits: int) -> pa.Array:
    """The ids of each document (from one of ``at`` to the next) packed, as one Arrow array."""
    if bits == 16:
        return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((2 * at).astype("<i4").tobytes()), pa.py_buffer(pack(ids, bits))])
    return pa.array([pack(ids[i:j], bits) for i, j in zip(at, at[1:], strict=False)], pa.binary())


def write_file(doc_ids: list[int], ids: list[np.ndarray], bits: int) -> bytes:
    """One file of the given documents in the given order."""
    starts = np.zeros(len(ids) + 1, "<u8")
    np.cumsum([len(x) for x in ids], out=starts[1:])
    every = np.concatenate(ids) if ids else np.zeros(0, "<u4")
    blocks = [pack(every[i:i + BLOCK_IDS], bits) for i in range(0, len(every), BLOCK_IDS)]
    offsets = np.zeros(len(blocks) + 1, "<u8")
    np.cumsum([len(b) for b in blocks], out=offsets[1:])
    return b"".join([HEADER.pack(MAGIC, bits, BLOCK_IDS, len(ids), len(every)), np.asarray(doc_ids, "<i8").tobytes(), starts.tobytes(), offsets.tobytes(), *blocks])


class TokenFile:
    """Reads a file: documents by place, id ranges by position."""

    def __init__(self, data: bytes):
        magic, self.bits, self.block, n, self.n_ids = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEADER.size
        self.doc_ids = np.frombuffer(data, "<i8", n, at)
        self.starts = np.frombuffer(data, "<u8", n + 1, at + 8 * n).astype(np.int64)
        at += 16 * n + 8
        blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at).astype(np.int64)
        self.data = memoryview(data)[at + 8 * (blocks + 1):]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from position ``start`` to ``stop``, from the blocks that hold them alone."""
        if stop <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        got = [unpack(self.data[self.offsets[b]:self.offsets[b + 1]], min(self.block, self.n_ids - b * self.block), self.bits) for b in range(first, last + 1)]
        return np.concatenate(got)[start - first * self.block:stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def export_file(content: bytes, path: str) -> None:
    """Puts one file under a plain path."""
    with open(path, "wb") as f:
        f.write(content)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int) -> DataFrame:
    """Encodes whole texts and writes them in ascending doc_id order; returns the files: place, part, n_docs, n_ids, content.

    Files follow each other by (place, part). Documents go to ranges of doc_id (cut at approximate quantiles, which
    only balance the work), so one task never holds more than one file. Rows with one doc_id lie side by side. A null
    text is empty and holds the end id alone; rows without doc_id come first, under NO_ID. An empty table gives no file.
    """
    spark = docs.sparkSession
    on_workers(spark)
    bits = bits_for(vocabulary)
    rows = docs.select(some_id().alias("doc_id"), "text")
    n = min(MAX_RANGES, rows.count() // DOCS_PER_RANGE + 1)
    cuts = np.asarray(sorted(set(rows.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n))) if n > 1 else [], np.float64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, n in slices(batch.column(1)):
                part = batch.slice(i, n)
                ids, at = encoder(tokenizer).encode_array(part.column(1), [end_id])
                places = np.searchsorted(cuts, part.column(0).to_numpy(), side="left").astype(np.int32)
                yield pa.record_batch({"place": pa.array(places), "doc_id": part.column(0), "n": pa.array(np.diff(at)), "ids": packed(ids, at, bits)})

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, part, size, keys, held = -1, 0, 0, [], []

        def flush() -> pa.RecordBatch:
            return pa.record_batch({"place": pa.array([place], pa.int32()), "part": pa.array([part], pa.int32()), "n_docs": pa.array([len(keys)], pa.int64()), "n_ids": pa.array([size], pa.int64()), "content": pa.array([write_file(keys, held, bits)], pa.binary())})

        for batch in batches:
            for at, key, count, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if keys and (at != place or size >= FILE_IDS):
                    yield flush()
                    part = part + 1 if at == place else 0
                    size, keys, held = 0, [], []
                place = at
                keys.append(key)
                held.append(unpack(ids, count, bits))
                size += count
        if keys:
            yield flush()

    encoded = rows.mapInArrow(trimmed(encode), "place int, doc_id long, n long, ids binary")
    ordered = encoded.repartition("place").sortWithinPartitions("place", "doc_id", "n", "ids")
    return stage(ordered.mapInArrow(trimmed(write), "place int, part int, n_docs long, n_ids long, content binary"), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (over all files), n_tokens, ids_crc32, place, part."""
    on_workers(files.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, part, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                f = TokenFile(content)
                n = len(f.doc_ids)
                every = memoryview(f.ids(0, f.n_ids).tobytes())
                crcs = [zlib.crc32(every[4 * a:4 * b]) for a, b in zip(f.starts.tolist(), f.starts[1:].tolist(), strict=False)]
                yield pa.record_batch({"place": pa.array([place] * n, pa.int32()), "part": pa.array([part] * n, pa.int32()), "doc_id": pa.array(f.doc_ids), "inside": pa.array(f.starts[:-1]), "n_tokens": pa.array(np.diff(f.starts)), "ids_crc32": pa.array(crcs, pa.int64())})

    before = Window.orderBy("place", "part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file, not document
    offsets = files.select("place", "part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("_base"))
    read_back = files.select("place", "part", "content").mapInArrow(trimmed(read), "place int, part int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return read_back.join(offsets, ["place", "part"]).select(given_id().alias("doc_id"), (F.col("_base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "place", "part")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` through the file format and back."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return read_token_files(write_token_files(documents(spark, sf_dir), path, end_id=1, vocabulary=49_408))
