"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "labelloom", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with AQE, skew-join handling and UTC timestamps.

    On a cluster the master, memory and shuffle partition count come from
    spark-submit; only what the jobs rely on is set here.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a scratch folder; on a
    cluster a machine-local folder would not survive a lost executor, so the
    missing setting is an error there.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if named:
        if not current or not current.startswith(named):
            sc.setCheckpointDir(named)
        return named
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    scratch = tempfile.mkdtemp(prefix="labelloom-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(scratch)
    return scratch


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: one write, lineage ends here."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
