"""Audit of filter interactions by contractions of contingency tensors.

Which filters a document fails is one of 2 ** 5 outcomes. Counted per part, the outcomes are a
tensor with one axis of length two per filter (0 passes, 1 fails). A statistic of a filter at its place in an order is a
contraction of that tensor with one vector per axis: pass, fail or all. So all orders are
judged from the counts, and no document is filtered twice.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import map_batches, stored, text_bytes

FILTERS = "ABCDE"
_SHAPE = (2,) * len(FILTERS)
_MARKS = re.compile(rb"[#$%&*|]")
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# What a contraction takes along an axis.
_PASS, _FAIL, _ALL = (1, 0), (0, 1), (1, 1)
STATISTICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_outcome(text: bytes, code_points: int) -> int:
    """Bits of the filters A to D that a text fails; filter i has bit i."""
    words = text.split()
    upper = len(text) - len(text.translate(None, _UPPER))
    return (len(words) < 50) | (100 * len(set(words)) < 65 * len(words)) << 1 | (100 * upper > 5 * code_points) << 2 | bool(_MARKS.search(text)) << 3


def outcomes(docs: DataFrame, part: str = "source") -> DataFrame:
    """doc_id, part, failed (bits of A to D) and digest (SHA-256 of the text) of every document; null texts and parts are empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = pc.fill_null(pc.utf8_length(batch.column(2)), 0).to_pylist()
            texts = text_bytes(batch.column(2))
            failed = pa.array([text_outcome(t, n) for t, n in zip(texts, points)], pa.int32())
            digest = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), failed, digest], names=["doc_id", "part", "failed", "digest"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, part string, failed int, digest binary")


def contingency(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """Per part and outcome (bits of A to E): n documents, good ones (quality 1) and toxic ones; at most 32 rows per part."""
    # Rows that agree in everything are one row with a count, so neither a copied row nor a missing id makes a hot key.
    rows = stored(outcomes(docs, part).groupBy("doc_id", "part", "failed", "digest").agg(F.count("*").alias("n")), "outcomes")
    named = rows.where("doc_id is not null")
    # The first copy of a text is found by (text, id), a key that no group of copies shares.
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copies = named.join(first, ["digest", "doc_id"], "left").withColumn("failed", F.col("failed") + F.when(F.col("first"), 0).otherwise(16))
    by_id = copies.groupBy("doc_id", "part", "failed").agg(F.sum("n").alias("n"))
    flags = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    labelled = by_id.join(flags, by_id["doc_id"] == flags["_id"], "left").select(
        "part", "failed", "n", *[(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")])
    zero = F.lit(0).cast("long")
    unnamed = rows.where("doc_id is null").select("part", "failed", "n", zero.alias("good"), zero.alias("toxic"))
    return labelled.union(unnamed).groupBy("part", "failed").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


class Contractions:
    """Axis vectors of every step of every order."""

    def __init__(self) -> None:
        self.orders = ["".join(o) for o in itertools.permutations(FILTERS)]
        self.steps = [(o, i + 1, FILTERS.index(f)) for o in self.orders for i, f in enumerate(o)]
        before = [{FILTERS.index(f) for f in o[:i - 1]} for o, i, _ in self.steps]
        axes = range(len(FILTERS))

        def vectors(choose) -> np.ndarray:
            return np.array([[choose(axis, done, at) for axis in axes] for done, (_, _, at) in zip(before, self.steps)], dtype=np.int64)

        self.kept = vectors(lambda axis, done, at: _PASS if axis in done or axis == at else _ALL)
        self.removed = vectors(lambda axis, done, at: _PASS if axis in done else _FAIL if axis == at else _ALL)
        self.failing = vectors(lambda axis, done, at: _FAIL if axis == at else _ALL)
        self.alone = vectors(lambda axis, done, at: _FAIL if axis == at else _PASS)

    def of(self, tensor: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """One number per step: the tensor contracted with the step's vector along every axis."""
        return np.einsum("abcde,sa,sb,sc,sd,se->s", tensor, *np.moveaxis(vectors, 1, 0), optimize="greedy")

    def table(self, counts: np.ndarray) -> dict[str, np.ndarray]:
        """All statistics from counts[0..2]: all, good and toxic documents by outcome, filter A along the first axis."""
        everyone, good, toxic = counts
        removed = self.of(everyone, self.removed)
        at = np.array([f for _, _, f in self.steps])
        shares = np.zeros(len(FILTERS), dtype=np.int64)
        np.add.at(shares, at, removed)
        return {"kept": self.of(everyone, self.kept), "removed": removed, "redundant": self.of(everyone, self.failing) - removed,
                "unique_fails": self.of(everyone, self.alone), "good_lost": self.of(good, self.removed),
                "toxic_lost": self.of(toxic, self.removed), "shapley": shares[at]}


def tensor(failed: list[int], counts: list[int]) -> np.ndarray:
    flat = np.zeros(2 ** len(FILTERS), dtype=np.int64)
    np.add.at(flat, failed, counts)
    # Bit 0 is the fastest index of the flat array, so the axes come out last filter first.
    return flat.reshape(_SHAPE).transpose()


def filter_interactions(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, filter_order, step and the statistics of every step of all 120 orders.

    Filters on whole texts (null: empty): A under 50 words, B distinct words under 65 %, C capitals over 5 %, D marks, E equal to the
    text of a smaller doc_id anywhere in the table. A null doc_id is never a copy nor the first one, and has no labels. Rows
    with equal doc_id and text are not copies of each other; each counts. Of several labels of a doc_id any 1 counts. A null part is the
    empty string; other columns are ignored. Numbers are long; a part without rows has none, so an empty table gives none.
    """
    counted = contingency(docs, labels, part)
    # At most 32 entries per part.
    cells = counted.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Contractions()
        for batch in batches:
            for name, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                failed = [e["failed"] for e in entries]
                got = plan.table(np.stack([tensor(failed, [e[c] for e in entries]) for c in ("n", "good", "toxic")]))
                keys = [pa.array([name] * len(plan.steps)), pa.array([o for o, _, _ in plan.steps]), pa.array([i for _, i, _ in plan.steps], pa.int32())]
                yield pa.RecordBatch.from_arrays(keys + [pa.array(got[s]) for s in STATISTICS], names=["part", "filter_order", "step", *STATISTICS])

    return map_batches(cells, run, "part string, filter_order string, step int, " + ", ".join(f"{s} long" for s in STATISTICS))


ORACLE = r"""
WITH d AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
    SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), f AS (
    SELECT doc_id, part, len(ws) < 50 AS a, 100 * len(list_distinct(ws)) < 65 * len(ws) AS b,
           100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
           coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) AS e FROM w
), l AS (
    SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), m AS (
    SELECT part, [a, b, c, d, e] AS bits, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
    FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY ALL
), o AS (
    SELECT p || q || r || s || u AS filter_order
    FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v1(p), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v2(q), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v3(r),
         (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v4(s), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v5(u)
    WHERE len(list_distinct([p, q, r, s, u])) = 5
), k AS (
    SELECT filter_order, step::INT AS step, instr('ABCDE', filter_order[step]) AS axis,
           list_transform(range(1, step), lambda i: instr('ABCDE', filter_order[i])) AS earlier
    FROM o, range(1, 6) AS g(step)
), g AS (
    SELECT m.*, k.*, bits[axis] AS fails, len(list_filter(earlier, lambda x: bits[x])) > 0 AS gone,
           len(list_filter(bits, lambda x: x)) = 1 AND bits[axis] AS only_here FROM m, k
), z AS (
    SELECT part, filter_order, step, any_value(axis) AS axis, coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND fails), 0) AS removed,
           coalesce(sum(n) FILTER (gone AND fails), 0) AS redundant, coalesce(sum(n) FILTER (only_here), 0) AS unique_fails,
           coalesce(sum(good) FILTER (NOT gone AND fails), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails), 0) AS toxic_lost
    FROM g GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, axis))::BIGINT AS shapley
FROM z
"""
