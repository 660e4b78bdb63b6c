"""Near copies by ball hashing of word-shingle fingerprints: five words, Jaccard similarity >= 0.8.

Documents with equal shingle sets collapse first. Each distinct set gets several independent partial SimHash
fingerprints, about as many bits wide as the number of sets needs. Two partial fingerprints that differ in at most two bits meet in
the middle: every one emits itself and its variants with one bit flipped, the variants are shuffled, and sets
that share a variant collide. Collisions are first filtered by 64 further fingerprint bits; a pair that is left
is linked only if the exact Jaccard similarity of the two sets is high enough.

A pair at the least similarity differs in 15 % of the bits, so the chance that it collides in one partial fingerprint is known, and
there are so many of them that at most MISS of such pairs collide in none; closer pairs are missed far less.

A variant may be shared by any number of sets, so its group is read as a sorted stream. Up to NEAR members are compared with each
other, further ones with the first HEAD. Of the members whose check bits are near, each is paired with the PARTNERS smallest, so that
copies of one text share hubs and need no pairs among themselves. Where there were more, the members go into a table, and once the classes
are known, all colliding pairs of two classes in it are compared, inside tasks that get blocks of such a group with their sets: no colliding pair
is left out, and none of them is a row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import components, map_batches, stored, text_bytes

SHINGLE = 5
SIMILARITY = 0.8
MISS = 0.05
# Members of a group that are all compared, those that all further ones are compared with, and pairs written per member.
NEAR, HEAD, PARTNERS = 4096, 64, 8
# Of all its pairs a set keeps so many at first, with the smallest others; the rest wait until the classes are known.
FIRST = 8
# A group of a variant has about so many members, as a power of two: more of them need fewer partial fingerprints.
FILL = 4
# Of the 64 check bits a pair at the least similarity differs in 10 on average, with a deviation of 3; unrelated sets in 32.
CHECK_BITS = 16
# Of all bits such a pair differs in 15 %, unrelated sets in 50 %; with 150 bits the deviations are 3 % and 4 %.
ALL_BITS = 0.28
# Partial fingerprints meet if they differ in so many bits.
RADIUS = 2
# Shingles in a block of a crowded group, where a set counts as ROW more: about 2,000 sets at most, and a task holds two blocks.
BLOCK, ROW = 1 << 20, 512
# Bits of a key above the variant, and the flip number that means none.
_TABLE, _FLIP, _NONE = 40, 6, 63
_PAIRS = "a long, b long"


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all word shingles; a shorter text is one shingle, one without words none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    codes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    k = min(shingle, len(words))
    out = np.full(len(words) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[j: len(words) - k + 1 + j]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return np.unique(out)


def layout(n: int, similarity: float = SIMILARITY, miss: float = MISS) -> tuple[int, int]:
    """(bits of a partial fingerprint, number of them) for ``n`` sets."""
    width = min(max(12, math.ceil(math.log2(max(2, n))) - FILL), 38)
    # Two sets of equal size and this Jaccard similarity have this cosine; a bit differs in proportion to the angle.
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    meet = sum(math.comb(width, i) * differ**i * (1 - differ) ** (width - i) for i in range(3))
    return width, max(4, math.ceil(math.log(miss) / math.log(1 - meet)))


def fingerprint_bits(hashes: np.ndarray, words: int) -> np.ndarray:
    """64 * ``words`` majority bits over the shingle hashes; an empty set has zeros."""
    ones = np.zeros(64 * words, dtype=np.int64)
    odd = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    for lo in range(0, len(hashes), 4080):
        mixed = (hashes[lo: lo + 4080, None] + odd) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(27)
        mixed *= np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
        bits = np.unpackbits(mixed.view(np.uint8), axis=1)
        # Columns are added up 255 rows at a time, as far as a byte goes.
        for at in range(0, len(bits), 255):
            ones += bits[at: at + 255].sum(axis=0, dtype=np.uint8)
    return (2 * ones > len(hashes)).astype(np.uint8)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def shingle_nodes(docs: DataFrame, width: int, tables: int, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, node (hash of the shingle set), check bits and partial fingerprints of each document."""
    words = 1 + -(-width * tables // 64)
    powers = 1 << np.arange(width, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, check, prints = [], [], []
            for text in text_bytes(batch.column(2)):
                hashes = shingle_set(text, shingle)
                bits = fingerprint_bits(hashes, words)
                node.append(int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).astype(np.int64)))
                check.append(int(np.packbits(bits[:64]).view("<i8")[0]))
                prints.append((bits[64: 64 + width * tables].reshape(tables, width) @ powers).astype("<i8").tobytes())
            arrays = [batch.column(0), batch.column(1), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array(prints, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_hash", "node", "check", "prints"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, text_hash long, node long, check long, prints binary")


def variants(nodes: DataFrame, width: int, tables: int) -> DataFrame:
    """(key, node, check): every partial fingerprint and its one-bit variants; key holds table, variant and the flipped bit."""
    flips = np.r_[np.int64(0), 1 << np.arange(width, dtype=np.int64)]
    numbers = np.r_[np.int64(_NONE), np.arange(width, dtype=np.int64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                prints = np.frombuffer(b"".join(part.column(2).to_pylist()), "<i8").reshape(-1, tables)
                key = prints[:, :, None] ^ flips | (np.arange(tables, dtype=np.int64) << _TABLE)[:, None]
                key = (key << _FLIP | numbers).reshape(len(prints), -1)
                node, check = (np.repeat(part.column(i).to_numpy(), key.shape[1]) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(node), pa.array(check)], names=["key", "node", "check"])

    return nodes.select("node", "check", "prints").mapInArrow(run, "key long, node long, check long")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    # The count of a signed number is that of its absolute value.
    return np.bitwise_count((a ^ b).view(np.uint64))


def _first_meeting(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the keys of two members of a group: whether this is the one variant of the table at which their pair is taken.

    Equal fingerprints share all variants and others two; the fingerprint itself, or the smaller variant, is taken.
    """
    i, j = x & _NONE, y & _NONE
    high = np.maximum(np.where(i == _NONE, -1, i), np.where(j == _NONE, -1, j))
    return np.where(i == j, i == _NONE, (x >> _FLIP >> np.maximum(high, 0)) & 1 == 0)


def _collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream of (key, node, check) sorted by variant and node to pairs (a < b), and members (key, node) of crowded groups.

    Pairs of a crowded group are marked as full.

    Between chunks only the first members of a group that may go on are held.
    """
    held, count, was_crowded = np.zeros((3, 0), dtype=np.int64), 0, False
    for new in _chunks(batches):
        if held.shape[1] and held[0, 0] >> _FLIP != new[0, 0] >> _FLIP:
            held, count, was_crowded = held[:, :0], 0, False
        old = held.shape[1]
        key, node, check = rows = np.concatenate([held, new], axis=1)
        group = key >> _FLIP
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        length = np.diff(np.r_[first, len(key)])
        start = np.repeat(first, length)
        # Where members are no longer held, the held ones alone reach NEAR; so places up to there are right.
        seat = np.arange(len(key)) - start
        partners, lonely = np.zeros(len(key), dtype=np.int64), np.ones(len(key), dtype=bool)
        left, right, whose = [], [], []
        number = np.repeat(np.arange(len(first)), length)

        def pair(at: np.ndarray, back: np.ndarray) -> None:
            near = (_distance(check[at], check[back]) <= CHECK_BITS) & _first_meeting(key[at], key[back])
            at, back = at[near], back[near]
            lonely[at] = lonely[back] = False
            wanted = partners[at] < PARTNERS
            partners[at] += 1
            left.append(node[back[wanted]])
            right.append(node[at[wanted]])
            whose.append(number[at[wanted]])

        fresh = np.arange(old, len(key))
        inner = fresh[seat[fresh] < NEAR]
        inner = inner[np.argsort(-seat[inner], kind="stable")]
        # The longest step back first: a member meets the smallest ones before the others.
        upto = np.searchsorted(-seat[inner], -np.arange(int(length.max())), side="right")
        for lag in range(min(NEAR, int(length.max())) - 1, 0, -1):
            at = inner[:upto[lag]]
            pair(at, at - lag)
        outer = fresh[seat[fresh] >= NEAR]
        for place in range(HEAD if len(outer) else 0):
            pair(outer, start[outer] + place)
        # Members of a group in which some had more partners, or were not compared with all, are handed on; of one chunk only those with a partner.
        total = length + np.where(first == 0, count - old, 0)
        goes_on = (first == 0) & (old > 0)
        crowded = (np.maximum.reduceat(partners, first) > PARTNERS) | (total > NEAR) | (goes_on & was_crowded)
        many = np.repeat(crowded, length) & (~lonely | np.repeat(goes_on | (total > NEAR), length))
        a, b, full = (np.concatenate([*x, node[:0]]) for x in (left, right, [crowded[g] for g in whose]))
        names, pad, nulls = ["a", "b", "key", "node", "full"], pa.nulls(len(a), pa.int64()), pa.nulls(int(many.sum()), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pad, pad, pa.array(full.astype(bool))], names=names)
        yield pa.RecordBatch.from_arrays([nulls, nulls, pa.array(key[many]), pa.array(node[many]), pa.nulls(len(nulls), pa.bool_())], names=names)
        held, count, was_crowded = rows[:, first[-1]: first[-1] + NEAR], int(total[-1]), bool(crowded[-1])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What ``_collide`` finds as (key, node, full, plain), at most one row per row read: members of crowded groups, and smaller partners of a set.

    The partners that a set has in a chunk are on its first row there, with a null key where no member of a crowded group is the set. Of
    partners in crowded groups only the FIRST smallest are looked at before the group is compared again; the others are not handed on.
    """
    def lists(at: np.ndarray, values: np.ndarray, rows: int) -> pa.Array:
        ends = np.r_[0, np.cumsum(np.bincount(at, minlength=rows))].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values[np.argsort(at, kind="stable")]))

    found = _collide(batches)
    for pairs, members in zip(found, found):
        a, b, full = (pairs.column(name).to_numpy(zero_copy_only=False) for name in ("a", "b", "full"))
        key, node = members.column("key").to_numpy(), members.column("node").to_numpy()
        order = np.lexsort((a, full, b))
        a, b, full = a[order], b[order], full[order]
        once = np.ones(len(a), dtype=bool)
        once[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (full[1:] != full[:-1])
        a, b, full = a[once], b[once], full[once]
        group = np.cumsum(np.r_[False, (b[1:] != b[:-1]) | (full[1:] != full[:-1])]) if len(a) else a
        wanted = ~full | (np.arange(len(a)) - np.searchsorted(group, group) < FIRST)
        a, b, full = a[wanted], b[wanted], full[wanted]
        # Sets that are no members get rows behind them.
        names, whose = np.unique(b, return_inverse=True)
        known, first = np.unique(node, return_index=True)
        at = np.searchsorted(known, names)
        new = ~np.isin(names, known)
        row = np.r_[first, 0][at]
        row[new] = len(node) + np.arange(new.sum())
        rows = len(node) + int(new.sum())
        at = row[whose]
        arrays = [pa.array(np.r_[key, names[new]], mask=np.arange(rows) >= len(key)), pa.array(np.r_[node, names[new]])]
        arrays += [lists(at[part], a[part], rows) for part in (full, ~full)]
        yield pa.RecordBatch.from_arrays(arrays, names=["key", "node", "full", "plain"])


def _chunks(batches: Iterator[pa.RecordBatch], rows: int = 50_000) -> Iterator[np.ndarray]:
    """Columns of several small batches at a time."""
    waiting: list[np.ndarray] = []
    for batch in batches:
        if batch.num_rows:
            waiting.append(np.stack([c.to_numpy() for c in batch.columns]))
        if sum(x.shape[1] for x in waiting) >= rows:
            yield np.concatenate(waiting, axis=1)
            waiting = []
    if waiting:
        yield np.concatenate(waiting, axis=1)


def _near_prints(pairs: DataFrame, nodes: DataFrame, bits: int) -> DataFrame:
    """The pairs whose whole fingerprints differ in at most ALL_BITS of their ``bits``: few unrelated sets are fetched then."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for i in (2, 3))
            far = np.bitwise_count(x ^ y).sum(axis=1) + _distance(batch.column(4).to_numpy(), batch.column(5).to_numpy())
            yield batch.select(["a", "b"]).filter(pa.array(far <= ALL_BITS * bits))

    prints = nodes.select("node", "prints", "check")
    both = pairs.join(prints.toDF("b", "y", "cy"), "b").join(prints.toDF("a", "x", "cx"), "a").select("a", "b", "x", "y", "cx", "cy")
    return map_batches(both, compare, _PAIRS)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes with a Jaccard similarity of at least ``similarity``. Sets travel by b first, which few pairs share."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= similarity for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    both = pairs.select("a", "b").join(sets.toDF("b", "y"), "b").join(sets.toDF("a", "x"), "a").select("a", "b", "x", "y")
    return map_batches(both, compare, _PAIRS)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()


def _sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(node, set) of the wanted nodes, from one document of each."""
    need = wanted.join(nodes.select("node", "first"), "node")
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash"), F.col("text").cast("string").alias("text"))
    rows = texts.join(need, texts["_id"].eqNullSafe(need["first.id"]) & (texts["_hash"] == need["first.hash"])).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, shingle).tobytes() for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["node", "set"])

    return map_batches(rows.dropDuplicates(["node"]), run, "node long, set binary")


def _tile(similarity: float, bits: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Links between the sets of two blocks of a group, or of one: a forest over the classes."""
    def run(where: tuple, table: pa.Table) -> pa.Table:
        group, i, j = (x.as_py() for x in where)
        key, node, check, root, block = (table.column(c).to_numpy() for c in ("key", "node", "check", "root", "block"))
        prints = np.frombuffer(b"".join(table.column("prints").to_pylist()), "<i8").reshape(len(node), -1)
        found = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        size = np.array([len(x) for x in found])
        shingles, code = np.unique(np.concatenate(found), return_inverse=True)
        codes = np.split(code, np.cumsum(size)[:-1])
        # Classes as labels; a link gives two of them one label.
        label = np.unique(root, return_inverse=True)[1]
        mark = np.zeros(len(shingles), dtype=bool)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a, b = [], []
        for k, at in enumerate(left):
            to = right[k + 1:] if i == j else right
            to = to[(label[to] != label[at]) & (np.minimum(size[to], size[at]) / np.maximum(np.maximum(size[to], size[at]), 1) >= similarity)]
            apart = _distance(check[to], check[at])
            near = (apart <= CHECK_BITS) & _first_meeting(key[to], key[at])
            to, apart = to[near], apart[near]
            differ = _distance(prints[to], prints[at])
            # A pair is taken at the first of all tables in which it collides.
            to = to[((differ <= RADIUS).argmax(axis=1) == group >> _TABLE) & (differ.sum(axis=1) + apart <= ALL_BITS * bits)]
            if not len(to):
                continue
            mark[codes[at]] = True
            both = np.array([np.count_nonzero(mark[codes[x]]) for x in to])
            mark[codes[at]] = False
            for x in to[both / (size[to] + size[at] - both) >= similarity]:
                if label[x] != label[at]:
                    label[label == label[x]] = label[at]
                    a.append(min(node[x], node[at]))
                    b.append(max(node[x], node[at]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _met_again(members: DataFrame, roots: DataFrame, nodes: DataFrame, docs: DataFrame, bits: int, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) between classes of crowded groups: all colliding pairs of two classes are compared, inside tasks, and none is a row.

    Only sets of which enough shingles occur in others can be linked to one. What is left of a group is cut into blocks of about BLOCK;
    a task gets two blocks, or one, so a set travels once per group and block of it, and fewer links than sets come out.
    """
    # A group that goes over several chunks may hand on a member twice.
    classed = stored(members.distinct().join(roots, "node", "left").select(
        "key", "node", F.shiftright("key", _FLIP).alias("group"), F.coalesce("root", "node").alias("root")), "crowds")
    several = classed.groupBy("group").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("group")
    sets = stored(_sets(classed.join(several, "group", "left_semi").select("node").distinct(), nodes, docs, shingle), "crowd-sets")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x, "<i8") for x in batch.column(1).to_pylist()]
            node = np.repeat(batch.column(0).to_numpy(), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate([*found, node[:0]]))], names=["node", "shingle"])

    alone = map_batches(sets, spell, "node long, shingle long").groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node")).where(
        "n = 1").groupBy("node").agg(F.count("*").alias("alone"))
    # Quotients, as in the similarity itself: a bound of a quotient is not below it when rounded.
    size = F.greatest(F.length("set") / 8, F.lit(1.0))
    able = sets.join(alone, "node", "left").where((size - F.coalesce("alone", F.lit(0))) / size >= similarity).select("node", "set")
    able = stored(able.join(nodes.select("node", "check", "prints"), "node"), "crowd-nodes")
    # Written, as both sides of the next join read it. Groups with one class by now end there too.
    rows = stored(classed.join(able.select("node", F.length("set").alias("bytes")), "node"), "crowd-members")
    blocks = rows.groupBy("group").agg(F.ceil(F.sum(F.col("bytes") / 8 + ROW) / BLOCK).alias("blocks"), F.min("root").alias("lo"), F.max("root").alias("hi")).where(
        "lo != hi").select("group", "blocks")
    placed = rows.join(blocks, "group").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    tile = F.explode(F.expr("transform(sequence(0L, blocks - 1), x -> struct(least(x, block) AS i, greatest(x, block) AS j))"))
    dealt = placed.select("key", "node", "root", "group", "block", tile.alias("t")).select("key", "node", "root", "group", "block", "t.i", "t.j")
    return dealt.join(able, "node").groupBy("group", "i", "j").applyInArrow(_tile(similarity, bits), _PAIRS)


def near_links(nodes: DataFrame, docs: DataFrame, width: int, tables: int, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root) of all nodes in a class of two or more."""
    rows = variants(nodes, width, tables)
    tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() * tables * (width + 1) // 4_000_000))
    sorted_rows = rows.repartition(tasks, F.shiftright("key", _FLIP)).sortWithinPartitions(F.shiftright("key", _FLIP), "node")
    met = stored(sorted_rows.mapInArrow(_gathered, "key long, node long, full array<long>, plain array<long>"), "collisions")
    bits = 64 + width * tables
    # A variant has at most PARTNERS partners of a member, so a list is as long as a set has variants.
    lists = met.where("size(full) + size(plain) > 0").groupBy(F.col("node").alias("b")).agg(
        F.flatten(F.collect_list("full")).alias("full"), F.flatten(F.collect_list("plain")).alias("plain"))
    smallest = F.slice(F.array_sort(F.array_distinct(F.concat("full", "plain"))), 1, FIRST)
    listed = stored(lists.select("b", smallest.alias("first"), F.array_except("plain", smallest).alias("later")), "partners")
    first = listed.select(F.explode("first").alias("a"), "b")
    pairs = stored(_near_prints(first, nodes, bits), "near-pairs")
    sets = stored(_sets(_ends(pairs), nodes, docs, shingle), "shingle-sets")
    # First one pair per node, with the smallest it met; members of a dense group then share a hub and need no further pairs.
    best = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    star = stored(_verified(best, sets, similarity), "near-stars")
    hub = star.select(F.col("b").alias("node"), F.col("a").alias("hub"))
    rest = pairs.join(best, ["a", "b"], "left_anti").join(hub.toDF("a", "ha"), "a", "left").join(hub.toDF("b", "hb"), "b", "left").where(
        "coalesce(ha, a) != coalesce(hb, b)").select("a", "b")
    edges = stored(star.union(_verified(rest, sets, similarity)), "near-links")
    roots = stored(components(edges, name="near-copies"), "near-classes")
    # What waited and is not one class by now, but for pairs of crowded groups, which are all compared again.
    waiting = listed.where(F.size("later") > 0).join(roots.toDF("b", "rb"), "b", "left").select(
        F.explode("later").alias("a"), "b", "rb").join(roots.toDF("a", "ra"), "a", "left").where(
        "coalesce(ra, a) != coalesce(rb, b)").select("a", "b")
    more = stored(_near_prints(waiting, nodes, bits), "near-pairs")
    late = _verified(more, _sets(_ends(more), nodes, docs, shingle), similarity)
    late = stored(late.union(_met_again(met.where("key is not null").select("key", "node"), roots, nodes, docs, bits, shingle, similarity)), "near-links")
    if late.isEmpty():
        return roots
    return stored(components(edges.union(late), name="near-copies"), "near-classes")


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class of near copies, with all its columns: the smallest doc_id (of equal ones the smallest text hash).

    A class connects all documents reachable by pairs whose word shingles (A-Z lower-cased, whole texts) have a Jaccard similarity of
    at least ``similarity``. Texts without words are one class. A null doc_id is only kept where its class
    has no other. Rows that repeat a kept (doc_id, text) collapse to one. An empty table gives no rows.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    width, tables = layout(docs.count(), similarity)
    nodes = shingle_nodes(docs, width, tables, shingle).groupBy("node", "check", "prints").agg(F.min(order).alias("first"))
    nodes = stored(nodes, "shingle-nodes")
    roots = near_links(nodes, docs, width, tables, shingle, similarity)
    classed = nodes.select("node", "first").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("_k"))
    kept = classed.select(F.col("_k.id").alias("_id"), F.col("_k.hash").alias("_hash"))
    # The row travels as one struct, so that its columns may have any names.
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_doc_id"), F.xxhash64("text").alias("_text_hash"))
    left = keyed.join(kept.distinct(), keyed["_doc_id"].eqNullSafe(kept["_id"]) & (keyed["_text_hash"] == kept["_hash"]), "left_semi")
    return left.dropDuplicates(["_doc_id", "_text_hash"]).select("row.*")
