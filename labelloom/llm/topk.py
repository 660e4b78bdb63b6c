"""Exact top-k inner products by pivot-table elimination.

Every vector keeps its distances to a few dozen pivots. By the triangle inequality the
largest |d(q, p) - d(c, p)| bounds the distance of query and candidate from below, and with the
norms that bounds their inner product from above. Candidates are evaluated in bound order
until no bound reaches the k-th score any more.

Queries and candidates meet in blocks: a block of queries and a block of candidates are one
unit of work, and each hands on its k best per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm.common import map_batches, stored

PIVOTS = 32
QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 8192


def integer_vectors(vectors: DataFrame, scale: int = 256, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, v) with v = floor(scale * x) per component; rows with null or non-finite parts, or a null id, are left out."""
    x = F.transform(F.col(column), lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(F.col(id_column).isNotNull() & F.col(column).isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col(id_column).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def matrix(rows: list[list[int]], width: int) -> np.ndarray:
    """Vectors as rows of ``width`` integers; shorter ones are filled with zeros."""
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def pivot_distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    v, p = vectors.astype(np.float64), pivots.astype(np.float64)
    square = (v * v).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2 * v @ p.T
    return np.sqrt(np.maximum(square, 0))


def best_in_block(q: np.ndarray, q_pivots: np.ndarray, q_id: int, v: np.ndarray, table: np.ndarray, norms: np.ndarray, ids: np.ndarray,
                  k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and scores of the k best candidates of one query, and how many were evaluated."""
    lower = np.zeros(len(v))
    for p in range(table.shape[0]):
        np.maximum(lower, np.abs(table[p] - q_pivots[p]), out=lower)
    # Rounding slack: squares of distances are exact to about 1e-16 of the norms.
    q_norm = float((q.astype(np.float64) ** 2).sum())
    upper = (q_norm + norms - lower * lower) / 2 + 1e-7 * (1 + q_norm + norms)
    usable = np.flatnonzero(ids != q_id)
    best_ids, best_scores, at, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, max(64, 4 * k)
    # The first step takes the highest bounds; only what may still reach the k-th score is then put in order.
    head = usable if len(usable) <= step else usable[np.argpartition(-upper[usable], step - 1)[:step]]
    seen = 0
    queue = [head]
    rest = np.setdiff1d(usable, head, assume_unique=True)
    while True:
        for part in queue:
            score = v[part] @ q
            seen += len(part)
            all_ids, all_scores = np.r_[best_ids, ids[part]], np.r_[best_scores, score]
            order = np.lexsort((all_ids, -all_scores))[:k]
            best_ids, best_scores = all_ids[order], all_scores[order]
        limit = best_scores[-1] if len(best_scores) == k else -np.inf
        rest = rest[upper[rest] >= limit]
        if at == 0:
            rest = rest[np.argsort(-upper[rest], kind="stable")]
        if not len(rest):
            return best_ids, best_scores, seen
        at += step
        step *= 2
        queue, rest = [rest[:step]], rest[step:]


def top_inner_products(vectors: DataFrame, k: int = 5, every: int = 50, pivots: int = PIVOTS, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best candidates of every row whose vec_id is divisible by ``every``.

    Needs vec_id and embedding; other columns are ignored. Score: inner product of the integer vectors, which must fit
    a long; a query's own vec_id is no candidate; equal scores go to the smaller vec_id. Rows with a null vec_id, null vectors or null or
    non-finite components take no part. Vectors of different length are compared as if filled with zeros. Repeated rows
    are candidates each; a repeated query id asks once, with its smallest vector. An empty table gives no rows.
    Pivots are ``pivots`` rows of the table in hash order (a bounded sample); they change the work, not the result.
    """
    rows = stored(integer_vectors(vectors, scale), "vectors")
    stats = rows.agg(F.count("*"), F.max(F.size("v")), F.sum((F.col("vec_id") % every == 0).cast("long"))).first()
    total, width, asked = stats[0], stats[1] or 0, stats[2] or 0
    chosen = rows.select("vec_id", "v").distinct().orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(pivots).collect()
    points = matrix([r["v"] for r in chosen], width)
    n_candidate, n_query = max(1, -(-total // CANDIDATE_BLOCK)), max(1, -(-asked // QUERY_BLOCK))

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(1).to_pylist(), width)
            d = pivot_distances(v, points)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.astype("<i8").tobytes() for r in v], pa.binary()),
                                              pa.array([r.astype("<f8").tobytes() for r in d], pa.binary())], names=["vec_id", "v", "d"])

    tabled = map_batches(rows, table, "vec_id long, v binary, d binary")
    candidates = tabled.withColumn("cb", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_candidate))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))))
    asking = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = map_batches(asking, table, "vec_id long, v binary, d binary").withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(n_query)).cast("int")).withColumn(
        "cb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_candidate - 1).cast("long"))))

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            def load(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                v = np.frombuffer(b"".join(t.column("v").to_pylist()), "<i8").reshape(t.num_rows, -1)
                return t.column("vec_id").to_numpy(), v, np.frombuffer(b"".join(t.column("d").to_pylist()), "<f8").reshape(t.num_rows, -1)

            ids, v, d = load(right)
            d, norms = np.ascontiguousarray(d.T), (v.astype(np.float64) ** 2).sum(axis=1)
            for q_id, q, qd in zip(*load(left)):
                best, scores, _ = best_in_block(q, qd, q_id, v, d, norms, ids, k)
                out += [(int(q_id), int(i), int(s)) for i, s in zip(best, scores)]
        cols = list(zip(*out)) or [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), cols)})

    found = queries.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb")).applyInArrow(search, "query_id long, vec_id long, score long")
    # At most k rows per query and block of candidates.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
