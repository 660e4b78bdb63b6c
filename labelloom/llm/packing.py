"""Packing of documents into sequences by minimum bin slack.

Only the number of pieces of each length matters for a packing, and there are at
most ``capacity`` lengths: the plan is made from that histogram. Per bin, the
longest piece left is fixed and a bitset subset-sum over the other lengths finds
the fullest feasible combination; it is removed as often as its counts allow, so the
plan has a few thousand patterns whatever the number of documents. Pieces then find
their place by their number among those of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm.common import map_batches, stored
from labelloom.llm.tokens import Encoder, tokenizer_path

CAPACITY = 2048
END_ID = 0
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, _part int, _seat long"


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths with the largest sum up to ``room``, by subset-sum over a bitset.

    Bit s of the set says that sum s can be reached. Lengths join in descending
    order, counts split into powers of two; the search ends as soon as ``room`` is
    reached exactly.
    """
    reach, mask = 1, (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []  # (set before, length, copies)
    for length in sorted((n for n, c in counts.items() if c > 0 and n <= room), reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left:
            take = min(copies, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left, copies = left - take, copies * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def minimum_bin_slack(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> copies) and how many bins follow each, for all pieces of the histogram."""
    counts = {n: c for n, c in histogram.items() if c > 0}
    plan = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        pattern = fullest(counts, capacity - longest)
        counts[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        bins = min(counts[n] // k for n, k in pattern.items())
        for n, k in pattern.items():
            counts[n] -= bins * k
            if not counts[n]:
                del counts[n]
        plan.append((pattern, bins))
    return plan


def _slots(plan: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """The plan as intervals of piece numbers per length, sorted by (length, first number)."""
    rows, used, sequence = [], {}, 0
    for pattern, bins in plan:
        offset = 0
        for length in sorted(pattern, reverse=True):
            k, first = pattern[length], used.get(length, 0)
            rows.append((length, first, sequence, k, offset))
            used[length], offset = first + bins * k, offset + length * k
        sequence += bins
    rows.sort()
    names = ("length", "first", "sequence", "copies", "offset")
    return dict(zip(names, np.array(rows, dtype=np.int64).reshape(-1, 5).T))


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Token pieces of all documents, none longer than ``capacity``; the first piece of a cut document may be shorter.

    Carries ``_part`` and ``_seat``, the number of the piece among those of its length in its task.
    """
    file = tokenizer or tokenizer_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, part = Encoder.shared(file), np.array([end_id], dtype="<u4").tobytes(), TaskContext.get().partitionId()
        seats: dict[int, int] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                chunk = batch.slice(lo, 200)
                rows = []
                for doc_id, ids in zip(chunk.column(0).to_pylist(), encoder.batch(chunk.column(1).to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    stop = (n - 1) % capacity + 1
                    start = piece = 0
                    while start < n:
                        seat = seats.get(stop - start, 0)
                        seats[stop - start] = seat + 1
                        rows.append((doc_id, piece, start, stop - start, zlib.crc32(ids[4 * start: 4 * stop]), part, seat))
                        start, stop, piece = stop, stop + capacity, piece + 1
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                names = ("doc_id", "piece", "start", "length", "ids_crc32", "_part", "_seat")
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=list(names))

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), encode, _PIECES)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` tokens.

    Needs doc_id and text; other columns are ignored. A null or empty text is its end
    id alone. Repeated rows and null doc_ids are documents of their own. Returns per
    piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. The
    driver sees one count per length (at most ``capacity`` rows); an empty table gives no rows.
    """
    pieces = stored(cut_pieces(docs, capacity, tokenizer, end_id), "pieces")
    counts = pieces.groupBy("_part", "length").agg(F.count("*").alias("_n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    slots = _slots(minimum_bin_slack(histogram, capacity))
    # One row per task and length; a window group has one row per task.
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", "length", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Intervals are ordered by (length, first); one sorted key finds the interval of a piece.
        key = slots["length"] << 44 | slots["first"]
        for batch in batches:
            length, number = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = np.searchsorted(key, length << 44 | number, side="right") - 1
            turn, slot = np.divmod(number - slots["first"][at], slots["copies"][at])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(slots["sequence"][at] + turn), pa.array(slots["offset"][at] + slot * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    numbered = pieces.join(offsets, ["_part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("_seat") + F.col("_before")).alias("_number"))
    return numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
