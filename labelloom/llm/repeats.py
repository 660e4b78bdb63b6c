"""Exact substring dedup over words with prefix-partitioned suffix trees.

A suffix starts at every word and is followed to depth ``depth`` (20 words). It belongs to
the group named by the variable-length prefix that ends with its anchor: the leftmost
of the 6-word strings inside it that has the smallest hash. Equal suffixes have equal
prefixes, so a group holds all of them, and a run of neighbouring suffixes shares its anchor
and travels once. Inside a group the tree is built top-down, one word per level for all
nodes at once; leaves that are alone drop out, and the nodes that reach the full depth
with two or more suffixes are the repeats. Neighbouring repeats form the maximal ones.

Steps, all keyed by cell (a few MB of documents) or by group bucket:

1. cells send their distinct prefixes; a bucket keeps those that two or more cells have;
2. each cell builds its own trees first: of equal suffixes inside a cell only the first goes on,
   so a passage in a third of all documents gives one row per cell, not one per document;
3. the buckets build the trees over what the cells sent, and name all but the first;
4. each cell marks the words its repeats cover.

The text is shuffled once (the steps share that exchange).
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTH = 20
ANCHOR = 6
CELL_BYTES = 6_000_000
_BITS = 40  # of a word's code
_LAST = 2**63 - 1  # order of a null doc_id
_MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 2**64) | 1 for i in range(ANCHOR)], dtype=np.uint64)


def word_codes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in words), dtype=np.uint64, count=len(words)) >> np.uint64(64 - _BITS)


class Cell:
    """Documents of one cell in (doc_id, text) order, as one array of word codes."""

    def __init__(self, group: pa.Table, depth: int):
        ids = [_LAST if d is None else d for d in group.column("doc_id").to_pylist()]
        texts = [b"" if t is None else t for t in group.column("text").cast(pa.binary()).to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.present = [ids[i] != _LAST or group.column("doc_id")[i].is_valid for i in order]
        self.ids = np.array([ids[i] for i in order], dtype=np.int64)
        self.words = [texts[i].split() for i in order]
        self.length = np.array([len(w) for w in self.words], dtype=np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.codes = np.concatenate([word_codes(w) for w in self.words] or [np.zeros(0, np.uint64)])
        self.depth = depth
        self._anchor()

    def _anchor(self) -> None:
        """Runs of windows with one anchor: key, document, first window, windows, place of the anchor after the first window."""
        n, depth = len(self.codes), self.depth
        doc = np.repeat(np.arange(len(self.ids)), self.length)
        start = np.flatnonzero(np.arange(n) + depth <= (self.first + self.length)[doc]) if n else np.zeros(0, np.int64)
        if not len(start):
            self.key = np.zeros(0, np.uint64)
            self.doc = self.at = self.count = self.rel = np.zeros(0, np.int64)
            return
        gram = np.zeros(n - ANCHOR + 1, dtype=np.uint64)
        for j in range(ANCHOR):
            gram += self.codes[j: n - ANCHOR + 1 + j] * _MULTIPLIERS[j]
        gram ^= gram >> np.uint64(31)
        gram *= np.uint64(0xBF58476D1CE4E5B9)
        gram ^= gram >> np.uint64(29)
        least, where = gram[start], start.copy()
        for j in range(1, depth - ANCHOR + 1):
            other = gram[start + j]
            better = other < least
            least = np.where(better, other, least)
            where[better] = start[better] + j
        new = np.r_[True, (where[1:] != where[:-1]) | (doc[start[1:]] != doc[start[:-1]])]
        lead = np.flatnonzero(new)
        self.key, self.doc, self.at = least[lead], doc[start[lead]], start[lead]
        self.count = np.diff(np.r_[lead, len(start)])
        self.rel = where[lead] - start[lead]

    def runs(self, chosen: np.ndarray) -> dict[str, np.ndarray]:
        return {"key": self.key[chosen], "id": self.ids[self.doc[chosen]], "doc": self.doc[chosen], "at": self.at[chosen],
                "start": self.at[chosen] - self.first[self.doc[chosen]], "count": self.count[chosen], "rel": self.rel[chosen]}

    def local_repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """(positions of windows that start earlier in this cell, True per position of codes)."""
        _, back, times = np.unique(self.key, return_inverse=True, return_counts=True)
        runs = self.runs(np.flatnonzero(times[back] > 1))
        run, turn = _windows(runs["count"])
        later = later_windows(self.codes, runs["at"][run] + turn, runs["key"][run], runs["rel"][run] - turn, runs["id"][run], runs["start"][run] + turn, self.depth)
        position = (runs["at"][run] + turn)[later]
        mark = np.zeros(len(self.codes) + 1, dtype=bool)
        mark[position] = True
        return position, mark


def _windows(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run and turn of every window of runs with so many windows."""
    run = np.repeat(np.arange(len(count)), count)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)


def later_windows(codes: np.ndarray, at: np.ndarray, key: np.ndarray, rel: np.ndarray, ids: np.ndarray, start: np.ndarray, depth: int) -> np.ndarray:
    """Which suffixes equal an earlier one over ``depth`` words; built top-down by levels.

    ``at``: place of the suffix in ``codes``; ``key`` and ``rel``: its prefix group.
    Earlier: smaller (ids, start).
    """
    live = np.arange(len(at))
    if not len(live):
        return live
    order = np.lexsort((rel, key))
    live = live[order]
    node = np.cumsum(np.r_[True, (key[live][1:] != key[live][:-1]) | (rel[live][1:] != rel[live][:-1])]) - 1
    live, node = _drop_single(live, node)
    for level in range(depth):
        if not len(live):
            return live
        code = codes[at[live] + level]
        lead = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        size = np.diff(np.r_[lead, len(node)])
        split = np.repeat(np.logical_or.reduceat(code != np.repeat(code[lead], size), lead), size)
        if split.any():  # a branching node: its children replace it
            mine = np.flatnonzero(split)
            order = np.lexsort((code[mine], node[mine]))
            live[mine] = live[mine[order]]
            edge = np.r_[True, node[1:] != node[:-1]]
            sorted_code = code[mine[order]]
            edge[mine[1:]] |= (sorted_code[1:] != sorted_code[:-1])
            node = np.cumsum(edge) - 1
            live, node = _drop_single(live, node)
    if not len(live):
        return live
    order = np.lexsort((start[live], ids[live], node))
    live, node = live[order], node[order]
    lead = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    first = np.repeat(live[lead], np.diff(np.r_[lead, len(node)]))
    return live[(ids[live] != ids[first]) | (start[live] != start[first])]


def _drop_single(live: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lead = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    size = np.diff(np.r_[lead, len(node)])
    keep = np.repeat(size > 1, size)
    return live[keep], node[keep]


def _pack_runs(cell: Cell, runs: dict[str, np.ndarray], depth: int) -> bytes:
    length = runs["count"] + depth - 1
    run, turn = _windows(length)
    codes = cell.codes[runs["at"][run] + turn]
    parts = [runs["key"].astype("<u8"), runs["id"].astype("<i8"), runs["doc"].astype("<u4"), runs["start"].astype("<u4"),
             runs["count"].astype("u1"), runs["rel"].astype("u1"), (codes & np.uint64(0xFFFFFFFF)).astype("<u4"), (codes >> np.uint64(32)).astype("u1")]
    return struct.pack("<II", len(length), len(codes)) + b"".join(p.tobytes() for p in parts)


def _unpack_runs(blob: bytes) -> tuple[dict[str, np.ndarray], np.ndarray]:
    n, m = struct.unpack_from("<II", blob)
    at, out = 8, []
    for kind, count in (("<u8", n), ("<i8", n), ("<u4", n), ("<u4", n), ("u1", n), ("u1", n), ("<u4", m), ("u1", m)):
        out.append(np.frombuffer(blob, kind, count, at))
        at += out[-1].nbytes
    codes = out[6].astype(np.uint64) | out[7].astype(np.uint64) << np.uint64(32)
    names = ("key", "id", "doc", "start", "count", "rel")
    return {k: v.astype(np.uint64 if k == "key" else np.int64) for k, v in zip(names, out)}, codes


def _by_bucket(key: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    lead = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1]]) if len(order) else order
    return [(int(bucket[part[0]]), part) for part in np.split(order, lead[1:])] if len(order) else []


def cover_repeats(docs: DataFrame, depth: int = DEPTH, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, spans of removed words [start, end) and the kept words joined by one blank.

    A word goes if a window of ``depth`` words that covers it also starts earlier: in a smaller
    doc_id, or earlier in the same document. Windows are judged on the input. Needs doc_id and text; other
    columns are ignored. A null or empty text has no words; texts shorter than ``depth`` words are kept. Null
    doc_ids count as one largest doc_id. Rows that repeat a doc_id and text are equally early, so they have equal
    results. An empty table gives no rows. Word codes have 40 bits: two different windows are
    taken as equal only if all their differing words collide.
    """
    if not ANCHOR <= depth <= 200:
        raise ValueError(f"depth must be {ANCHOR} to 200")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = max(1, -(-total // cell_bytes))
    # Null doc_ids spread by their text, the others by doc_id.
    placed = rows.select("doc_id", "text", F.pmod(F.coalesce(F.xxhash64("doc_id"), F.lit(0)) + F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0), F.lit(cells)).alias("cell"))

    def prefixes(key: tuple, group: pa.Table) -> pa.Table:
        own = np.unique(Cell(group, depth).key)
        parts = _by_bucket(own, cells)
        return pa.table({"bucket": pa.array([b for b, _ in parts], pa.int64()), "cell": pa.array([key[0].as_py()] * len(parts), pa.int64()),
                         "keys": pa.array([own[p].astype("<u8").tobytes() for _, p in parts], pa.binary())})

    def shared(key: tuple, group: pa.Table) -> pa.Table:
        lists = [np.frombuffer(k, "<u8") for k in group.column("keys").to_pylist()]
        values, times = np.unique(np.concatenate(lists), return_counts=True)
        values = values[times > 1]
        both = [k[np.isin(k, values)] for k in lists]
        return pa.table({"cell": group.column("cell"), "keys": pa.array([b.tobytes() for b in both], pa.binary())})

    def send(key: tuple, group: pa.Table, keys: pa.Table) -> pa.Table:
        out: list[tuple[int, bytes]] = []
        wanted = np.concatenate([np.frombuffer(k, "<u8") for k in keys.column("keys").to_pylist()] or [np.zeros(0, "<u8")])
        if group.num_rows and len(wanted):
            cell = Cell(group, depth)
            _, known = cell.local_repeats()
            runs = cell.runs(np.flatnonzero(np.isin(cell.key, wanted)))
            run, turn = _windows(runs["count"])
            fresh = ~known[runs["at"][run] + turn]
            run, turn = run[fresh], turn[fresh]
            lead = np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | (turn[1:] != turn[:-1] + 1)]) if len(run) else run
            first, skip = run[lead], turn[lead]
            runs = {k: v[first] for k, v in runs.items()}
            runs |= {"at": runs["at"] + skip, "start": runs["start"] + skip, "rel": runs["rel"] - skip, "count": np.diff(np.r_[lead, len(run)])}
            out = [(b, _pack_runs(cell, {k: v[p] for k, v in runs.items()}, depth)) for b, p in _by_bucket(runs["key"], cells)]
        return pa.table({"bucket": pa.array([b for b, _ in out], pa.int64()), "cell": pa.array([key[0].as_py()] * len(out), pa.int64()),
                         "runs": pa.array([r for _, r in out], pa.binary())})

    def trees(key: tuple, group: pa.Table) -> pa.Table:
        parts = [_unpack_runs(r) for r in group.column("runs").to_pylist()]
        owner = np.repeat(group.column("cell").to_numpy(), [len(p[0]["key"]) for p in parts])
        runs = {k: np.concatenate([p[0][k] for p in parts]) for k in parts[0][0]}
        codes = np.concatenate([p[1] for p in parts])
        length = runs["count"] + depth - 1
        base = np.cumsum(length) - length
        run, turn = _windows(runs["count"])
        later = later_windows(codes, base[run] + turn, runs["key"][run], runs["rel"][run] - turn, runs["id"][run], runs["start"][run] + turn, depth)
        run, turn = run[later], turn[later]
        order = np.argsort(owner[run], kind="stable")
        run, turn = run[order], turn[order]
        lead = np.flatnonzero(np.r_[True, owner[run][1:] != owner[run][:-1]]) if len(run) else run
        found = np.stack([runs["doc"][run], runs["start"][run] + turn], axis=1).astype("<u4")
        return pa.table({"cell": pa.array(owner[run[lead]], pa.int64()),
                         "found": pa.array([x.tobytes() for x in np.split(found, lead[1:])] if len(lead) else [], pa.binary())})

    def remove(key: tuple, group: pa.Table, found: pa.Table) -> pa.Table:
        cell = Cell(group, depth)
        position, _ = cell.local_repeats()
        named = [np.frombuffer(x, "<u4").reshape(-1, 2).astype(np.int64) for x in found.column("found").to_pylist()]
        position = np.concatenate([position, *(cell.first[x[:, 0]] + x[:, 1] for x in named)]).astype(np.int64)
        change = np.zeros(len(cell.codes) + 1, dtype=np.int64)
        np.add.at(change, position, 1)
        np.add.at(change, position + depth, -1)
        gone = np.cumsum(change)[:-1] > 0
        n_removed, spans, kept = [], [], []
        for words, first, length in zip(cell.words, cell.first.tolist(), cell.length.tolist()):
            mask = gone[first: first + length]
            n = int(mask.sum())
            n_removed.append(n)
            if not n:
                spans.append([])
                kept.append(b" ".join(words).decode())
                continue
            edge = np.flatnonzero(np.diff(np.r_[False, mask, False]))
            spans.append([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
            kept.append(b" ".join([w for w, g in zip(words, mask.tolist()) if not g]).decode())
        ids = [int(d) if p else None for d, p in zip(cell.ids, cell.present)]
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(cell.length), "n_removed": pa.array(n_removed, pa.int64()),
                         "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.string())})

    by_cell = placed.groupBy("cell")
    common = by_cell.applyInArrow(prefixes, "bucket long, cell long, keys binary").groupBy("bucket").applyInArrow(shared, "cell long, keys binary")
    sent = by_cell.cogroup(common.groupBy("cell")).applyInArrow(send, "bucket long, cell long, runs binary")
    found = sent.groupBy("bucket").applyInArrow(trees, "cell long, found binary")
    return by_cell.cogroup(found.groupBy("cell")).applyInArrow(
        remove, "doc_id long, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept string")
