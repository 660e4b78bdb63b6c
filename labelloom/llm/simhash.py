"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at distance d <= 3 have a common variant: each flips at most half of
the differing bits and they meet in the middle. Distances 1 and 3 join fingerprints of
different parity, so only those of even parity flip two bits; and of three bits two
lie in the same 32-bit half, so only pairs inside a half are needed. That leaves
1 + 64 + 992 variants for even and 1 + 64 for odd fingerprints, with no pair lost.

Variants are shuffled by bucket. The bucket is a linear hash (an XOR of bit codes), so
a fingerprint is sent once to each bucket its variants fall in, and the bucket finds
the flips again from the hash; a bucket holds a bounded share of the variants. A variant
gets at most as many members as its own ball is large, since fingerprints are distinct:
no key can be hot. All members of a variant are linked through one that flips at most one bit.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import components, map_batches, stored, text_bytes

SHINGLE = 3
SEED = 42
RADIUS = 3
# Fingerprints one task turns into bucket lists at a time.
_CHUNK = 8192
_MASK = 0xFFFFFFFFFFFFFFFF


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the XXH64 hashes of all word shingles, as a signed 64-bit number; no words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    clean = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(size + 1) - 1
    starts, k = ends - size, min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(clean[a:b], seed) for a, b in zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 4096):
        part = hashes[lo:lo + 4096].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, text_hash (to find the row again) and fp of each document; whole texts, null is empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, shingle, seed) for t in text_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], names=["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, text_hash long, fp long")


class Ball:
    """Flip patterns of one parity class, grouped by their bucket code."""

    def __init__(self, patterns: list[int], codes: np.ndarray):
        self.flips = np.array(patterns, dtype=np.uint64)
        self.weight = np.array([p.bit_count() for p in patterns], dtype=np.uint8)
        code = linear_code(self.flips, codes)
        order = np.argsort(code, kind="stable")
        self.flips, self.weight, code = self.flips[order], self.weight[order], code[order]
        self.reached = np.unique(code)
        n = len(codes) and 1 << int(codes.max()).bit_length()
        self.first = np.searchsorted(code, np.arange(n))
        self.count = np.searchsorted(code, np.arange(n), side="right") - self.first

    def variants(self, fps: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For fingerprints and the codes their flips must have: index of the fingerprint, variant, weight."""
        count = self.count[code]
        owner = np.repeat(np.arange(len(fps)), count)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.first[code], count)
        return owner, fps[owner] ^ self.flips[at], self.weight[at]


def linear_code(values: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """XOR of the code of every set bit."""
    out = np.zeros(len(values), dtype=np.int64)
    for bit in range(64):
        out ^= np.where(values >> np.uint64(bit) & np.uint64(1), codes[bit], 0)
    return out


def balls(radius: int, bits: int) -> tuple[np.ndarray, Ball, Ball]:
    """Bit codes and the balls of even and odd fingerprints. Of weight two, radius 3 needs pairs inside a half only."""
    if not 0 <= radius <= 3:
        raise ValueError("radius must be 0 to 3")
    step = np.uint64(0x9E3779B97F4A7C15)
    mixed = (np.arange(1, 65, dtype=np.uint64) * step) ^ ((np.arange(1, 65, dtype=np.uint64) * step) >> np.uint64(29))
    codes = ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)).astype(np.int64)
    codes[0] |= 1 << (bits - 1)  # the table is then as long as the bucket range
    ones = [1 << i for i in range(64)]
    even = [0] + (ones if radius >= 1 else [])
    odd = [0] + (ones if radius >= 2 else [])
    if radius == 3:
        even += [1 << i | 1 << j for half in (range(32), range(32, 64)) for i, j in itertools.combinations(half, 2)]
    return codes, Ball(even, codes), Ball(odd, codes)


def _is_odd(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps) % 2 == 1


def link_bucket(bucket: int, fps: np.ndarray, codes: np.ndarray, even: Ball, odd: Ball, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one bucket as a forest: (smallest linked fingerprint, fingerprint)."""
    fps = np.unique(fps)
    flips = linear_code(fps, codes) ^ bucket
    parity = _is_odd(fps)
    parts = []
    for ball, mine in ((even, ~parity), (odd, parity)):
        owner, variant, weight = ball.variants(fps[mine], flips[mine])
        parts.append((fps[mine][owner], variant, weight))
    owner, variant, weight = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(variant, kind="stable")
    owner, variant, weight = owner[order], variant[order], weight[order]
    new = np.r_[True, variant[1:] != variant[:-1]] if len(variant) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    shared = np.bincount(group, minlength=1)[group] > 1 if len(group) else new
    owner, weight, group = owner[shared], weight[shared], group[shared]
    if not len(owner):
        return owner, owner
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    # The hub flips at most half of the radius, the others at most the rest: hub and member are within the radius.
    hub = np.minimum.reduceat(np.where(weight <= radius // 2, owner, np.uint64(_MASK)), first)
    hub = np.repeat(hub, np.diff(np.r_[first, len(owner)]))
    near = (hub != owner) & (np.bitwise_count(hub ^ owner) <= radius)
    links = np.unique(np.stack([hub[near], owner[near]], axis=1), axis=0)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for a, b in links.tolist():
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    ends = [(find(x), x) for x in root]
    tree = np.array([e for e in ends if e[0] != e[1]], dtype=np.uint64).reshape(-1, 2)
    return tree[:, 0], tree[:, 1]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between the fingerprints of column fp (distinct rows) that connect all within ``radius``."""
    n = distinct.count()
    bits = 10 + max(0, math.ceil(math.log2(max(1, n) / 2**22)))  # buckets grow with the table, their size does not

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, even, odd = balls(radius, bits)
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            fps = np.concatenate(held)
            held.clear()
            parity, code = _is_odd(fps), linear_code(fps, codes)
            to, what = [], []
            for ball, mine in ((even, ~parity), (odd, parity)):
                to.append((code[mine][:, None] ^ ball.reached[None, :]).ravel())
                what.append(np.repeat(fps[mine], len(ball.reached)))
            to, what = np.concatenate(to), np.concatenate(what)
            order = np.argsort(to, kind="stable")
            to, what = to[order], what[order].astype("<u8")
            first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            lists = [x.tobytes() for x in np.split(what, first[1:])]
            return pa.RecordBatch.from_arrays([pa.array(to[first], pa.int64()), pa.array(lists, pa.binary())], names=["bucket", "fps"])

        for batch in batches:
            held.append(batch.column(0).to_numpy().view(np.uint64))
            if sum(map(len, held)) >= _CHUNK:
                yield flush()
        if held and sum(map(len, held)):
            yield flush()

    def link(key: tuple, group: pa.Table) -> pa.Table:
        codes, even, odd = balls(radius, bits)
        fps = np.frombuffer(b"".join(group.column("fps").to_pylist()), dtype="<u8").astype(np.uint64)
        a, b = link_bucket(key[0].as_py(), fps, codes, even, odd, radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    sent = distinct.select("fp").mapInArrow(emit, "bucket long, fps binary")
    return sent.groupBy("bucket").applyInArrow(link, "a long, b long").distinct()


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """component_id for every fingerprint: the smallest doc_id of all documents reachable from it."""
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = components(links(distinct.repartition("fp"), radius), name="simhash")
    members = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = members.groupBy("root").agg(F.min("least").alias("component_id"))
    return members.join(smallest, "root").select("fp", "component_id")


def near_duplicate_classes(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    Texts are lower-cased in A-Z and read whole; null and empty texts have fingerprint zero
    and are linked like any other. Null doc_ids keep their row but never name a class (a
    class of them alone has a null component_id); repeated rows each come out. Other columns are ignored.
    """
    prints = stored(fingerprints(docs, shingle, seed), "prints")
    named = prints.join(classes(prints, radius), "fp")
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One document of each class, with all its columns: the smallest doc_id (of equal ones the smallest text hash).

    Rows that repeat a kept (doc_id, text) collapse to one. A class of null doc_ids only keeps one row per fingerprint.
    """
    prints = stored(fingerprints(docs, shingle, seed), "prints")
    named = prints.join(classes(prints, radius).withColumnRenamed("component_id", "_class"), "fp")
    # Null doc_ids sort last, so a class keeps one only if it has nothing else. Classes of null doc_ids are told apart by fp.
    by = [F.col("_class"), F.when(F.col("_class").isNull(), F.col("fp"))]
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))
    kept = named.groupBy(*[c.alias(f"_g{i}") for i, c in enumerate(by)]).agg(F.min(order).alias("_k")).select(
        F.col("_k.doc_id").alias("_id"), F.col("_k.text_hash").alias("_hash"))
    # The row travels as one struct, so that its columns may have any names.
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_doc_id"), F.xxhash64("text").alias("_text_hash"))
    left = keyed.join(kept.distinct(), keyed["_doc_id"].eqNullSafe(kept["_id"]) & (keyed["_text_hash"] == kept["_hash"]), "left_semi")
    return left.dropDuplicates(["_doc_id", "_text_hash"]).select("row.*")
