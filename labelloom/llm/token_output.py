"""Token-id output in patched frame-of-reference blocks.

A table of segments holds the id stream in ascending doc_id order. A segment is a
run of whole documents (about SEGMENT_IDS ids) in one binary payload:

    header   magic "PFB1", n_docs, n_ids, n_blocks (u32 each)
    docs     doc_id i64 x n_docs, 1 byte each (1: doc_id present), n_ids of each document u32
    index    start of each block inside the block area, u32 x (n_blocks + 1)
    blocks   minimum u32, width u8, exceptions u8, 128 values packed at ``width`` bits,
             exception positions u8 x n, exception high parts u32 x n

The width of a block is the bit length at the PERCENTILE of its values above the
minimum; larger values keep their low bits in place and their high bits in the
exception list. The block index allows decoding of single blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelloom.llm.common import map_batches, shared_path
from labelloom.llm.tokens import Encoder, tokenizer_path

BLOCK = 128
PERCENTILE = 0.9
SEGMENT_IDS = 65_536
_MAGIC = b"PFB1"
_SEGMENTS = "shard int, segment int, n_docs int, n_ids long, start_in_shard long, payload binary"


def _ragged(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and turn of every element of lists with so many elements."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)


def _squeeze(values: np.ndarray, w: int) -> np.ndarray:
    """Rows of values below 2**w, w bits each, as rows of bytes: eight values fill w bytes."""
    v = values.astype(np.uint64).reshape(len(values), -1, 8)
    if w > 16:
        bits = np.unpackbits(v.astype("<u4").view(np.uint8).reshape(len(values), -1, 4), axis=2, bitorder="little")
        return np.packbits(bits[:, :, :w].reshape(len(values), -1), axis=1, bitorder="little")
    u = np.uint64
    low, high = (v[:, :, i] | v[:, :, i + 1] << u(w) | v[:, :, i + 2] << u(2 * w) | v[:, :, i + 3] << u(3 * w) for i in (0, 4))
    if w < 16:
        low = low | high << u(4 * w)
        high = high >> u(64 - 4 * w)
    return np.stack([low, high], axis=2).view(np.uint8)[:, :, :w].reshape(len(values), -1)


def _spread(raw: np.ndarray, w: int) -> np.ndarray:
    """Inverse of ``_squeeze``."""
    if w > 16:
        full = np.zeros((len(raw), BLOCK, 32), dtype=np.uint8)
        full[:, :, :w] = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(raw), BLOCK, w)
        return np.packbits(full, axis=2, bitorder="little").view("<u4")[:, :, 0]
    u = np.uint64
    wide = np.zeros((len(raw), BLOCK // 8, 16), dtype=np.uint8)
    wide[:, :, :w] = raw.reshape(len(raw), BLOCK // 8, w)
    wide = wide.view("<u8")
    low, high = wide[:, :, 0], wide[:, :, 1]
    if w < 16:
        high = low >> u(4 * w) | high << u(64 - 4 * w)
    out = np.empty((len(raw), BLOCK // 8, 8), dtype=np.uint32)
    for i in range(4):
        out[:, :, i] = low >> u(i * w) & u((1 << w) - 1)
        out[:, :, i + 4] = high >> u(i * w) & u((1 << w) - 1)
    return out.reshape(len(raw), BLOCK)


def pack_ids(ids: np.ndarray) -> bytes:
    """Blocks of ids: u32 count of blocks, block index, blocks. An empty stream has no block."""
    n = len(ids)
    n_blocks = -(-n // BLOCK)
    if not n_blocks:
        return struct.pack("<II", 0, 0)
    grid = np.empty(n_blocks * BLOCK, dtype=np.uint32)
    grid[:n] = ids
    grid[n:] = ids[-1]
    grid = grid.reshape(n_blocks, BLOCK)
    low = grid.min(axis=1)
    rest = grid - low[:, None]
    # The bit length grows with the value: that of the percentile is the percentile of the bit lengths.
    middle = np.sort(rest, axis=1)[:, int(np.ceil(PERCENTILE * BLOCK)) - 1]
    width = np.frexp(middle.astype(np.float64))[1].astype(np.int64)
    at, position = np.nonzero(rest.astype(np.uint64) >> width[:, None].astype(np.uint64))
    n_over = np.bincount(at, minlength=n_blocks)
    starts = np.r_[0, np.cumsum(6 + width * BLOCK // 8 + 5 * n_over)]
    out = np.zeros(starts[-1], dtype=np.uint8)
    head = starts[:-1]
    out[head[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[head + 4], out[head + 5] = width, n_over
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        out[head[rows][:, None] + 6 + np.arange(BLOCK * w // 8)] = _squeeze(rest[rows] & np.uint32((1 << w) - 1), w)
    tail = head + 6 + width * BLOCK // 8
    turn = _ragged(n_over)[1]
    out[tail[at] + turn] = position
    high = (rest[at, position].astype(np.uint64) >> width[at].astype(np.uint64)).astype("<u4")
    out[((tail + n_over)[at] + 4 * turn)[:, None] + np.arange(4)] = high.view(np.uint8).reshape(-1, 4)
    return struct.pack("<I", n_blocks) + starts.astype("<u4").tobytes() + out.tobytes()


def unpack_ids(data: bytes, n: int) -> np.ndarray:
    """The first ``n`` ids of packed blocks."""
    (n_blocks,) = struct.unpack_from("<I", data)
    raw = np.frombuffer(data, np.uint8)
    head = np.frombuffer(data, "<u4", n_blocks + 1, 4)[:-1].astype(np.int64) + 4 + 4 * (n_blocks + 1)
    low = raw[head[:, None] + np.arange(4)].view("<u4")[:, 0] if n_blocks else np.zeros(0, np.uint32)
    width, n_over = raw[head + 4].astype(np.int64), raw[head + 5].astype(np.int64)
    grid = np.zeros((n_blocks, BLOCK), dtype=np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        grid[rows] = _spread(raw[head[rows][:, None] + 6 + np.arange(BLOCK * w // 8)], w)
    tail = head + 6 + width * BLOCK // 8
    at, turn = _ragged(n_over)
    high = raw[((tail + n_over)[at] + 4 * turn)[:, None] + np.arange(4)].view("<u4").reshape(-1)
    grid[at, raw[tail[at] + turn]] |= high << width[at].astype(np.uint32)
    return (grid + low[:, None]).reshape(-1)[:n]


def pack_segment(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    stream = np.frombuffer(b"".join(ids), dtype="<u4")
    return b"".join([
        _MAGIC, struct.pack("<II", len(doc_ids), len(stream)),
        np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes(),
        np.array([d is not None for d in doc_ids], dtype=np.uint8).tobytes(),
        np.array([len(x) // 4 for x in ids], dtype="<u4").tobytes(),
        pack_ids(stream),
    ])


def unpack_segment(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, id counts and the id stream of one segment."""
    if payload[:4] != _MAGIC:
        raise ValueError("not a token segment")
    n_docs, n_ids = struct.unpack_from("<II", payload, 4)
    doc_ids = np.frombuffer(payload, "<i8", n_docs, 12)
    present = np.frombuffer(payload, np.uint8, n_docs, 12 + 8 * n_docs)
    counts = np.frombuffer(payload, "<u4", n_docs, 12 + 9 * n_docs)
    stream = unpack_ids(payload[12 + 13 * n_docs:], n_ids) if n_ids else np.zeros(0, np.uint32)
    return [int(d) if p else None for d, p in zip(doc_ids, present)], counts, stream


def write_token_segments(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2) -> None:
    """Encode ``text`` of every document, append ``end_id``, and write segments in ascending doc_id order.

    Needs columns doc_id and text; others are ignored. Null doc_ids come first, a null
    text is empty (its ids are the end id alone). Repeated rows stay, ordered by a hash
    of the text. Documents are range partitioned, so shard numbers follow doc_id; a
    document is never cut, so one very long text is one longer segment. An empty table
    gives an empty folder.
    """
    file = tokenizer or tokenizer_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder.shared(file), np.array([end_id], dtype="<u4").tobytes()
        shard, segment, before = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int | None] = []
        ids: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "segment": pa.array([segment], pa.int32()),
                "n_docs": pa.array([len(doc_ids)], pa.int32()), "n_ids": pa.array([held], pa.int64()),
                "start_in_shard": pa.array([before], pa.int64()), "payload": pa.array([pack_segment(doc_ids, ids)], pa.binary())})

        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                for doc_id, got in zip(part.column(0).to_pylist(), encoder.batch(part.column(1).to_pylist())):
                    doc_ids.append(doc_id)
                    ids.append(got + end)
                    held += len(got) // 4 + 1
                    if held >= SEGMENT_IDS:
                        yield flush()
                        segment, before, held = segment + 1, before + held, 0
                        doc_ids.clear()
                        ids.clear()
        if doc_ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("_h"))
    placed = rows.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    map_batches(placed, encode, _SEGMENTS).write.option("compression", "none").parquet(path)


def read_token_segments(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from written segments: doc_id, start, n_tokens, ids_crc32.

    Shard offsets come from the id counts (one row per write task, so the window
    and the broadcast are as small as the list of shards); payloads are decoded where they lie.
    """
    segments = spark.read.schema(_SEGMENTS).parquet(path)
    sizes = segments.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids, counts, stream = unpack_segment(payload.as_py())
                ends = np.cumsum(counts, dtype=np.int64)
                raw = stream.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * (e - c): 4 * e]) for e, c in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(first + ends - counts, pa.int64()),
                    "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    placed = segments.join(F.broadcast(offsets), "shard").select((F.col("_before") + F.col("start_in_shard")).alias("_start"), "payload")
    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write token segments of ``docs`` into the shared folder and return what reading them back gives."""
    path = shared_path(docs.sparkSession, "token-ids")
    write_token_segments(docs, path, tokenizer, end_id)
    return read_token_segments(docs.sparkSession, path)
