"""Carried state across identity changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reset_changed_identities(state: DataFrame, old: DataFrame, new: DataFrame, values: list[str],
                             key: str = "annotator_id") -> DataFrame:
    """State after a membership change: kept where the identity is the same, zero where it changed or is new, gone where dropped."""
    before = old.select(key, F.col("identity").alias("_before"))
    now = new.select(key, F.col("identity").alias("_now"))
    row = now.join(before, key, "left").join(state, key, "left")
    same = F.col("_now").eqNullSafe(F.col("_before"))
    return row.select(key, same.alias("kept"), *[F.when(same, F.coalesce(v, F.lit(0.0))).otherwise(0.0).alias(v)
                                                 for v in values])
