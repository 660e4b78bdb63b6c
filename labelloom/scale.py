"""Building blocks that keep jobs even when one key holds a large share of the rows.

* ``split_hot``  - separate the few keys whose groups are too large for one task.
* ``ranked``     - exact row numbers inside groups of any size.
* ``cut_to``     - the first rows of each group.
* ``exact_quantile`` - quantiles of groups of any size.
* ``fold_groups`` - array work on many small groups at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from labelloom.session import cut

# Rows of one group that a single task may fold in memory.
GROUP_LIMIT = 4096
# Rows that one task sorts or hashes where an input is dealt out by its size.
TASK_ROWS = 250_000
# First rows that every task may keep for itself; longer lists are cut off a distributed rank.
TOP_ROWS = 100_000
# Hot keys listed on the driver; more than this stay in a table.
LISTED_KEYS = 10_000


def split_hot(
    df: DataFrame, keys: Sequence[str], limit: int = GROUP_LIMIT, probe: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Split ``df`` into rows of groups up to ``limit`` rows and rows of larger groups.

    The sizes come from one map-side combined count over the key columns, of
    ``probe`` when given: a frame that has every row of ``df`` but is cheaper to
    read. The second frame is None when no group is larger, the usual case.
    """
    keys = list(keys)
    big = (df if probe is None else probe).groupBy(*keys).count().where(F.col("count") > limit).select(*keys)
    listed = big.limit(LISTED_KEYS + 1).collect()
    if not listed:
        return df, None
    bounded = len(listed) <= LISTED_KEYS
    dim = df.sparkSession.createDataFrame(listed, big.schema) if bounded else cut(big)
    # Null keys are a group too: equal nulls meet, so a large one is split like any other.
    dim = dim.select(*[F.col(k).alias(f"_hot_{k}") for k in keys])
    dim = F.broadcast(dim) if bounded else dim
    same = [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys]
    return df.join(dim, same, "left_anti"), df.join(dim, same, "left_semi")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a small input one partition per core before heavy per-row work.

    Only a scan with fewer splits than cores is repartitioned; large inputs
    already have more splits and pass through untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def dealt(df: DataFrame, keys: Sequence[str], rows: int = TASK_ROWS) -> DataFrame:
    """``df`` dealt out by ``keys`` to tasks of about ``rows`` rows each, so that their memory does not grow with the input."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(tasks, *keys)


def fold_groups(df: DataFrame, group: Sequence[str], order: Sequence[Column], fold: Callable[[pa.Table, np.ndarray], pa.Table],
                schema: str | StructType, rows: int = 100_000) -> DataFrame:
    """``fold(table, starts)`` over whole groups, as many at a time as about ``rows`` rows hold; groups begin at ``starts``.

    For groups of a bounded size (``split_hot``): a call per group costs more than the work on it. Rows are dealt out by
    group and sorted by ``order`` inside it; a task holds one chunk and the group that goes on behind it.
    """
    group = list(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < rows:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            starts = _group_starts(table, group)
            last = int(starts[-1])
            if last:
                yield from fold(table.slice(0, last), starts[:-1]).to_batches()
            held = table.slice(last).to_batches()
        if sum(b.num_rows for b in held):
            table = pa.Table.from_batches(held).combine_chunks()
            yield from fold(table, _group_starts(table, group)).to_batches()

    return dealt(df, group).sortWithinPartitions(*group, *order).mapInArrow(run, schema)


def _group_starts(table: pa.Table, group: Sequence[str]) -> np.ndarray:
    """Rows at which sorted group columns change; nulls are equal."""
    new = np.ones(table.num_rows, dtype=bool)
    if table.num_rows > 1:
        new[1:] = False
        for name in group:
            a, b = table.column(name).slice(1), table.column(name).slice(0, table.num_rows - 1)
            differ = pc.fill_null(pc.not_equal(a, b), pc.xor(pc.is_null(a), pc.is_null(b)))
            new[1:] |= differ.to_numpy()
    return np.flatnonzero(new)


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Add the 1-based position of each row inside its group, in ``order``.

    A window would sort a whole group in one task. Here the rows are range
    partitioned on (group, order), so a large group spreads over many tasks;
    positions inside a task come from the sorted order, and the per-task group
    counts (at most tasks + groups rows) give the offsets. The sorted rows are
    checkpointed so the positions stay fixed when a task is run again.
    """
    group = list(group)
    by = [F.col(c) for c in group] + list(order)
    placed = cut(
        df.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_seat", F.monotonically_increasing_id())
        .withColumn("_task", F.shiftright("_seat", 33))
    )
    pieces = placed.groupBy(*group, "_task").agg(F.min("_seat").alias("_first"), F.count("*").alias("_n"))
    # One row per task of a group, at most the number of tasks.
    earlier = Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        *group, "_task", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift")
    ) if group else _global_offsets(pieces)
    return (
        placed.join(offsets, [*group, "_task"])
        .withColumn(name, (F.col("_seat") + F.col("_shift")).cast("bigint"))
        .drop("_seat", "_task", "_shift")
    )


def _global_offsets(pieces: DataFrame) -> DataFrame:
    # One row per task in total.
    earlier = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.select(
        "_task", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift")
    )


def first_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group; Spark keeps at most ``n`` per task before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def cut_to(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group, or of all rows; up to TOP_ROWS without a full sort."""
    if n > TOP_ROWS:
        return ranked(df, group, order, "_r").where(F.col("_r") <= n).drop("_r")
    return first_rows(df, group, order, n, "_r").drop("_r") if group else df.orderBy(*order).limit(n)


def running_total(df: DataFrame, group: Sequence[str], order: Sequence[Column], value: str, name: str) -> DataFrame:
    """Running sum of ``value`` inside groups of any size, in ``order``.

    Same layout as ``ranked``: sums inside tasks, then offsets between tasks.
    """
    group = list(group)
    by = [F.col(c) for c in group] + list(order)
    placed = cut(
        df.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_seat", F.monotonically_increasing_id())
        .withColumn("_task", F.shiftright("_seat", 33))
    )
    pieces = placed.groupBy(*group, "_task").agg(F.sum(value).alias("_sum"))
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    earlier = w.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(*group, "_task", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    # A piece is what one range task held, so this window never holds a whole large group.
    inside = Window.partitionBy(*group, "_task").orderBy("_seat").rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.withColumn("_in", F.sum(value).over(inside))
        .join(offsets, [*group, "_task"])
        .withColumn(name, F.col("_in") + F.col("_before"))
        .drop("_seat", "_task", "_in", "_before")
    )


def hash_sums(fields: Sequence[str]) -> list[Column]:
    """Order-free signature of a group as five mergeable aggregates ``_h0.._h4``.

    Two independent 64-bit row hashes are summed in 32-bit halves, next to the
    row count; groups with equal rows have equal sums.
    """
    out = []
    for salt in (0, 1):
        h = F.xxhash64(F.lit(salt), *fields)
        out += [F.sum(F.shiftright(h, 32)), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF)))]
    return [c.alias(f"_h{i}") for i, c in enumerate([*out, F.count("*")])]


# Intervals that a selection cuts a range into at a time.
_CELLS = 4096


def exact_quantile(df: DataFrame, value: str, q: Column, by: Sequence[str] = (), name: str = "quantile") -> DataFrame:
    """Linear-interpolated quantile ``q`` of ``value`` per group; ``q`` may read the group's row count ``n``.

    Selection by refined intervals: the range of a group is cut into equal cells, rows are counted per cell, and only the
    cell that holds the wanted rank is looked at again, between its own least and greatest value. Counts are
    combined before the shuffle and no buffer grows with the number of values; a round leaves about one cell in _CELLS.
    Null and NaN values take no part; a group of nothing else has no row, all rows together have one with null.
    """
    by = list(by)
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*by, F.col(value).cast("double").alias("_v"))
    ends = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).where("n > 0")
    at = (q * (F.col("n") - 1)).alias("_at")
    wanted = cut(ends.select(*by, at, "_lo", "_hi").select(*by, "_at", "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.explode(
        F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("_k")))
    while not (left := wanted.where("_lo < _hi")).isEmpty():
        # At most two intervals per group; halves keep the difference of the ends finite.
        spans = left.select(*by, "_k", "_lo", "_hi", "_below", "_at")
        near = (rows.join(spans, by) if by else rows.crossJoin(F.broadcast(spans))).where("_v >= _lo AND _v <= _hi")
        cell = F.least(F.lit(_CELLS - 1), F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * _CELLS))
        counts = near.groupBy(*by, "_k", "_at", "_below", cell.alias("_cell")).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.col("_below") + F.sum("_n").over(Window.partitionBy(*by, "_k").orderBy("_cell"))
        hit = counts.withColumn("_upto", upto).where((F.col("_upto") > F.col("_k")) & (F.col("_upto") - F.col("_n") <= F.col("_k")))
        found = hit.select(*by, "_at", "_lo", "_hi", (F.col("_upto") - F.col("_n")).alias("_below"), "_k")
        wanted = cut(wanted.where("_lo >= _hi").unionByName(found))
    part = F.first(F.col("_at") - F.floor("_at"))
    return wanted.groupBy(*by).agg((F.min("_lo") + part * (F.max("_lo") - F.min("_lo"))).alias(name))
