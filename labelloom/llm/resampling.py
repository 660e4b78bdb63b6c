"""Importance resampling towards a target text by array-scored weights and a distributed radix sort.

Words and word pairs are hashed into buckets. How much likelier a bucket is in the target than
in the corpus is one entry of an array; the mean entry over a document's features is its weight, and a
Gumbel number from its id turns the weight into a score, whose highest values are a draw without replacement.

The order of the scores comes from an LSD radix sort over the digits of the key (score, then doc_id). A pass
counts the digits of every block of rows, prefix sums over (digit, block) give each block its first
place per digit, and a stable counting sort inside the block gives every row its place. Blocks are bounded, and places are dense,
so the next pass deals equal blocks again whatever the keys are.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm.common import map_batches, stored, text_bytes

BUCKETS = 10_000
SEED = 7
LEAST_WORDS = 20
PERCENT = 25
# Words are digits, letters and everything beyond ASCII; A-Z are lower-cased, the rest separates.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in range(0x30, 0x3A) or c in range(0x61, 0x7B) or c > 0x7F else 0x20 for c in range(256))
# Bits of a digit, and rows that one task sorts (as a power of two).
DIGIT_BITS, BLOCK_BITS = 12, 18


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def feature_codes(words: list[bytes]) -> np.ndarray:
    """CRC-32 of every word and of every pair of neighbours, joined by a space."""
    crc = zlib.crc32
    single = list(map(crc, words))
    # The sum of a pair goes on from the sum of its first word.
    pairs = [crc(w, crc(b" ", c)) for w, c in zip(words[1:], single)]
    return np.array(single + pairs, dtype=np.int64)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n over all whole texts (column text; null: none). At most ``buckets`` rows per task and in all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in text_bytes(batch.column(0)):
                total += np.bincount(feature_codes(words_of(text)) % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    rows = map_batches(texts.select(F.col("text").cast("string").alias("text")), run, "bucket long, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """Per bucket: thousandths of the log ratio of target and corpus, one added to every bucket, rounded down."""
    all_raw, all_target = float(sum(raw.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1.0) * all_raw / ((raw.get(b, 0) + 1.0) * all_target))) for b in range(buckets)], dtype=np.int64)


def gumbel(seed: int) -> Column:
    """Thousandths of a Gumbel number from doc_id alone, so that reruns agree; a null doc_id is the empty text."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def scored(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document."""
    # Two tables of at most ``buckets`` rows come to the driver, one array goes to the tasks.
    counts = [{r["bucket"]: r["n"] for r in bucket_counts(t, buckets).collect()} for t in (docs, target)]
    gain = gains(*counts, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, weight = [], [], []
            for text in text_bytes(batch.column(1)):
                words = words_of(text)
                codes = feature_codes(words)
                n_words.append(len(words))
                n_features.append(len(codes))
                weight.append(int(gain[codes % buckets].sum()) // len(codes) if len(codes) else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in (n_words, n_features, weight)]],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    rows = map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_words long, n_features long, weight long")
    return rows.withColumn("score", F.col("weight") + gumbel(seed))


def key_digits(bounds: list[tuple[str, int, int]], digit_bits: int = DIGIT_BITS) -> list[list[tuple[str, int, int, int, int]]]:
    """Digits of a composite key from the least significant: each a list of (column, least value, shift, bits, place in the digit).

    ``bounds`` names the key's columns, the last one first, with their least and greatest value. A column
    gets as many bits as its range needs, and short columns share a digit.
    """
    digits: list[list[tuple[str, int, int, int, int]]] = [[]]
    room = digit_bits
    for name, low, high in bounds:
        left, shift = (high - low).bit_length(), 0
        while left:
            if not room:
                digits.append([])
                room = digit_bits
            take = min(room, left)
            digits[-1].append((name, low, shift, take, digit_bits - room))
            shift, left, room = shift + take, left - take, room - take
    return [d for d in digits if d]


def digit(columns: dict[str, np.ndarray], parts: list[tuple[str, int, int, int, int]], n: int) -> np.ndarray:
    """One digit of the key of ``n`` rows. Differences are taken modulo 2**64, so any range of longs is right."""
    out = np.zeros(n, dtype=np.int64)
    for name, low, shift, bits, place in parts:
        ahead = columns[name].view(np.uint64) - np.uint64(low % 2**64)
        out |= ((ahead >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64) << place
    return out


def radix_sort(rows: DataFrame, key: list[str], digit_bits: int = DIGIT_BITS, block_bits: int = BLOCK_BITS) -> DataFrame:
    """``rows`` with column place: 0, 1, 2 ... in ascending order of the ``key`` columns (long, not null); rows equal there in any order.

    All columns are long and may be null but for the key; ``place`` and ``digit`` are taken names. Every pass is one shuffle by
    block; the counts per (block, digit) are summed by digit, never in one task.
    """
    names = rows.columns
    fixed = stored(rows.withColumn("place", F.monotonically_increasing_id()), "sort-rows")
    ends = fixed.agg(*[f(k).alias(f"{f.__name__}_{k}") for k in key for f in (F.min, F.max)]).first()
    if ends[0] is None:
        return fixed.select(*names, "place")
    digits = key_digits([(k, ends[f"min_{k}"], ends[f"max_{k}"]) for k in reversed(key)], digit_bits) or [[]]
    schema = ", ".join(f"`{c}` long" for c in [*names, "place", "digit"])

    def first_digit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in key}
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digit(values, digits[0], batch.num_rows))], names=[*batch.schema.names, "digit"])

    now = fixed.mapInArrow(first_digit, schema)
    for done in range(len(digits)):
        def counting_sort(left: pa.Table, right: pa.Table) -> pa.Table:
            rows = left.take(pa.array(np.argsort(left.column("place").to_numpy(), kind="stable")))
            own = rows.column("digit").to_numpy()
            first = np.zeros((1 << digit_bits) + 1, dtype=np.int64)
            first[right.column("value").to_numpy()] = right.column("first").to_numpy()
            order = np.argsort(own, kind="stable")
            group = own[order]
            seat = np.arange(len(own)) - np.searchsorted(group, group, side="left")
            place = np.empty(len(own), dtype=np.int64)
            place[order] = first[group] + seat
            after = digits[done + 1] if done + 1 < len(digits) else []
            values = {k: rows.column(k).to_numpy() for k in key}
            out = [rows.column(c) for c in names] + [pa.array(place), pa.array(digit(values, after, len(own)))]
            return pa.table(dict(zip([*names, "place", "digit"], out)))

        blocks = now.withColumn("block", F.shiftright("place", block_bits))
        counts = blocks.groupBy("block", "digit").agg(F.count("*").alias("n"))
        # Digits before this one: at most 2 ** digit_bits rows. Blocks before this one: one row per block and digit.
        smaller = counts.groupBy("digit").agg(F.sum("n").alias("n")).select(
            "digit", (F.sum("n").over(Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
        earlier = F.sum("n").over(Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
        offsets = counts.withColumn("earlier", earlier).join(F.broadcast(smaller), "digit").select(
            F.col("block").alias("b"), F.col("digit").alias("value"), (F.col("before") + F.col("earlier")).alias("first"))
        now = stored(blocks.groupBy("block").cogroup(offsets.groupBy("b")).applyInArrow(counting_sort, schema), "sort-pass")
    return now.select(*names, "place")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null where it is not drawn.

    Of the documents with at least ``least_words`` words, ``percent`` percent (rounded down) are drawn by highest score, ties to the
    smaller doc_id, null ids last; rows equal in both are interchangeable. A null or empty text has no features and weight 0.
    Repeated rows count and may be drawn each. Without target texts all counts there are zero. Other columns are ignored; an
    empty table gives no rows.
    """
    rows = stored(scored(docs, target, buckets, seed), "scored")
    able = rows.where(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    keyed = able.select("doc_id", "n_features", "weight", "score", (-F.col("score")).alias("down"),
                        F.col("doc_id").isNull().cast("long").alias("unnamed"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"))
    placed = radix_sort(keyed, ["down", "unnamed", "id"])
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = placed.select(*columns, F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"))
    return ranked.union(rows.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank")))


def _features_sql(table: str) -> str:
    """Every feature of the texts of a table, with the row it stands in."""
    return f"""SELECT rid, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS feature FROM (
        SELECT rid, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS ws FROM {table})"""


_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ORACLE = rf"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, text FROM documents
), q AS (
    SELECT row_number() OVER () AS rid, text FROM benchmark
), crc AS (
    SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i)) AS entries
), fd AS ({_features_sql('d')}), fq AS ({_features_sql('q')}),
h AS (
    SELECT feature, hex(encode(feature)) AS h FROM (SELECT feature FROM fd UNION SELECT feature FROM fq)
), b AS (
    SELECT feature, xor(list_reduce(list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
           lambda c, x: xor(c >> 8, entries[xor(c & 255, x) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % {BUCKETS} AS bucket
    FROM h, crc
), s AS (SELECT bucket, count(*) AS n FROM fd JOIN b USING (feature) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM fq JOIN b USING (feature) GROUP BY bucket),
g AS (
    SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + {BUCKETS})::DOUBLE
           / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
    FROM s LEFT JOIN t ON s.bucket = t.bucket
), w AS (
    SELECT rid, count(*) AS n_features, sum(gain)::BIGINT AS total FROM fd JOIN b USING (feature) JOIN g USING (bucket) GROUP BY rid
), x AS (
    SELECT d.doc_id, coalesce(n_features, 0)::BIGINT AS n_features, CASE WHEN total IS NULL THEN 0 ELSE floor(total / n_features::DOUBLE)::BIGINT END AS weight,
           ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS u
    FROM d LEFT JOIN w ON d.rid = w.rid
), y AS (
    SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((u + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score, (n_features + 1) // 2 >= {LEAST_WORDS} AS able FROM x
), z AS (
    SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS LAST) AS place, {PERCENT} * count(*) FILTER (able) OVER () // 100 AS drawn FROM y
)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= drawn THEN place END AS rank FROM z
"""
