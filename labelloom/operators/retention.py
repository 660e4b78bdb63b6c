"""Retention plans and stale listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions.text import byte_size
from labelloom.scale import ranked


def retention_report(objects: DataFrame, now, hours: float, kept_prefix: str, orphan_prefix: str) -> DataFrame:
    """Count and bytes per category with a total row.

    Objects under ``kept_prefix`` older than the cutoff are stale, newer ones
    preserved; everything under ``orphan_prefix`` is orphaned; the rest is not touched.
    """
    key = F.col("key")
    cutoff = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(hours * 3600)} SECONDS")
    category = (
        F.when(key.startswith(orphan_prefix), "orphan")
        .when(key.startswith(kept_prefix), F.when(F.col("modified") < cutoff, "stale").otherwise("preserved")))
    per = objects.withColumn("category", category).where(F.col("category").isNotNull())
    out = per.rollup("category").agg(F.count("*").alias("objects"), F.sum("bytes").alias("bytes"))
    return out.select(F.coalesce("category", F.lit("total")).alias("category"), "objects", "bytes",
                      byte_size(F.col("bytes")).alias("size"))


def keep_latest(dumps: DataFrame, n: int, by: Sequence[str] = (), order: str = "modified", key: str = "key") -> DataFrame:
    """Mark the newest ``n`` dumps of each group as kept."""
    row = ranked(dumps, by, [F.desc(order), F.col(key)], "_r")
    return row.withColumn("kept", F.col("_r") <= n).drop("_r")


def stale_files(listing: DataFrame, manifest: DataFrame, key: str = "key") -> DataFrame:
    """Listed files the manifest does not name."""
    return listing.join(manifest.select(key), key, "left_anti")
