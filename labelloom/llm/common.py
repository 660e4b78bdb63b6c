"""Helpers shared by the operators: shared tables, Arrow batches, words, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from labelloom.session import ensure_checkpoint_dir

# Words of every contract: runs without ASCII white space. bytes.split() splits at the same characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
# Rows of one Arrow batch: long texts must not pile up in a Python worker.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, which all executors see."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/labelloom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends, values stay fixed."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` in batches of at most BATCH_ROWS rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def text_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null is the empty text."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """Connected components of an edge list as rows (node, root): root is the smallest node reachable.

    Alternates large-star and small-star steps: each round only lets nodes point at
    smaller neighbours, with a map-side combined minimum and one join on the node,
    until the edges no longer change. Every round is a written table in the shared
    folder. Only counts come to the driver. Self edges give single nodes; null ends
    are no edges.
    """
    # Stored first: the nodes and every round read the edges, which may be costly to find.
    now = stored(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), name)
    nodes = now.select(F.col("u").alias("node")).union(now.select(F.col("v").alias("node"))).distinct()
    now = now.where("u > v")
    before = None
    while True:
        # Large star: every larger neighbour of a node points at the node's smallest neighbour.
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large.where("u > v")
        # Small star: the smaller neighbours of a node, and the node, point at the smallest of them.
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            down.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        now = stored(small, name)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == before:
            break
        before = seen
    # Stable means: every edge points at the root of its component.
    roots = now.groupBy("u").agg(F.min("v").alias("root"))
    return nodes.join(roots, nodes["node"] == roots["u"], "left").select("node", F.coalesce("root", "node").alias("root"))
