"""Order-free fingerprints and near-duplicate submissions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions import taxonomy as T
from labelloom.operators.prepare import pool_hash
from labelloom.scale import hash_sums

SUBMISSION = ("round_num", "item_id", "annotator_id")
ROW = ("l", "b1", "b2", "b3", "b4")


def submission_fingerprints(anns: DataFrame, group: Sequence[str] = SUBMISSION, who: str = "annotator_id") -> DataFrame:
    """Fingerprint of each submission over (label, box), any order, and how many annotators share it."""
    rows = anns.select(*group, F.lower(F.trim("label")).alias("l"), *[
        F.rint(F.col(c) * 100).cast("bigint").alias(b) for c, b in zip(("x1", "y1", "x2", "y2"), ROW[1:])])
    prints = pool_hash(rows, ROW, group)
    rest = [g for g in group if g != who]
    shared = prints.groupBy(*rest, "fingerprint").agg(F.count("*").alias("copies"), F.min(who).alias("first_annotator"))
    return prints.join(shared, [*rest, "fingerprint"])


def round_fingerprints(prints: DataFrame, by: Sequence[str] = ("round_num", "annotator_id")) -> DataFrame:
    """Fingerprint of everything an annotator submitted in a round."""
    return pool_hash(prints, ["item_id", "fingerprint"], by)


def near_duplicates(anns: DataFrame, threshold: float = 0.95, item: Sequence[str] = ("round_num", "item_id"),
                    pixels: float = 4.0) -> DataFrame:
    """Submissions sharing at least ``threshold`` of their binned rows with an earlier annotator of the item.

    Rows are (canonical label, box in ``pixels``-wide bins) and count as often as
    they occur. Returns the earliest such annotator (lowest id).

    Submissions with equal bins form one class with its lowest annotator, so
    copies cost nothing. Different classes can only reach the threshold with
    1/(1-threshold) - 1 rows or more; those meet through the bins of their prefix
    (the first n - ceil(t n) + 1 rows, rarest bins of the item first, at least one of which two similar
    classes share), and only such candidates are counted in full. A bin that most classes have comes last and
    joins nothing. Of classes that meet, those whose sizes, or whose places of the common bin, leave
    too few rows to share go at once.
    """
    item = list(item)
    smallest = int(threshold / (1 - threshold) + 1e-9)
    cols = ("x1", "y1", "x2", "y2")
    bins = anns.select(*item, "annotator_id", T.canonical_label(F.col("label")).alias("l"), *[
        F.rint(F.col(c) / pixels).cast("bigint").alias(b) for c, b in zip(cols, ROW[1:])])
    sums = bins.groupBy(*item, "annotator_id").agg(*hash_sums(ROW))
    sigs = sums.select(*item, "annotator_id", F.col("_h4").alias("n"), F.concat_ws(
        "-", *[F.col(f"_h{i}").cast("string") for i in range(5)]).alias("sig"))
    classes = sigs.groupBy(*item, "sig", "n").agg(F.min("annotator_id").alias("lead"))
    large = classes.where(F.col("n") >= smallest)
    counts = bins.join(large.select(*item, F.col("lead").alias("annotator_id"), "sig", "n"), [*item, "annotator_id"]).groupBy(
        *item, "sig", "n", *ROW).agg(F.count("*").alias("k"))
    # How many classes of the item have a bin; counted per bin, the order is the same for all classes.
    common = counts.groupBy(*item, *ROW).agg(F.count("*").alias("_f"))
    placed = counts.join(common, [*item, *ROW])
    # Copies of a bin follow each other in the order, so a bin is in the prefix when its first copy is. A window holds one submission.
    order = Window.partitionBy(*item, "sig").orderBy("_f", F.xxhash64(*ROW), *ROW).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seats = placed.withColumn("_r", F.sum("k").over(order) - F.col("k"))
    need = F.ceil(F.round(F.col("n") * threshold, 9))
    prefix = seats.where(F.col("_r") <= F.col("n") - need)
    a = prefix.select(*item, *ROW, F.col("sig").alias("sa"), F.col("n").alias("na"), F.col("_r").alias("ra"))
    b = prefix.select(*item, *ROW, F.col("sig").alias("sb"), F.col("n").alias("nb"), F.col("_r").alias("rb"))
    # Rows before the common bin, and rows from it on, that the two can share at most.
    reach = F.least("ra", "rb") + F.least(F.col("na") - F.col("ra"), F.col("nb") - F.col("rb"))
    pairs = a.join(b, [*item, *ROW]).where(
        (F.col("sa") < F.col("sb")) & (F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9)
        & (reach >= F.greatest("na", "nb") * threshold - 1e-9)).select(*item, "sa", "sb", "na", "nb").distinct()
    ca = counts.select(*item, F.col("sig").alias("sa"), *ROW, F.col("k").alias("ka"))
    cb = counts.select(*item, F.col("sig").alias("sb"), *ROW, F.col("k").alias("kb"))
    shared = pairs.join(ca, [*item, "sa"]).join(cb, [*item, "sb", *ROW]).groupBy(*item, "sa", "sb", "na", "nb").agg(
        F.sum(F.least("ka", "kb")).alias("s"))
    close = shared.where(F.col("s") / F.greatest("na", "nb") >= threshold - 1e-12)
    links = close.select(*item, F.col("sa").alias("sig"), F.col("sb").alias("other")).unionByName(
        close.select(*item, F.col("sb").alias("sig"), F.col("sa").alias("other")))
    leads = classes.select(*item, F.col("sig").alias("other"), "lead")
    nearest = links.join(leads, [*item, "other"]).groupBy(*item, "sig").agg(F.min("lead").alias("near"))
    row = sigs.join(classes.select(*item, "sig", "lead"), [*item, "sig"]).join(nearest, [*item, "sig"], "left")
    first = F.least("lead", F.coalesce("near", "lead"))
    return row.where(first < F.col("annotator_id")).select(*item, "annotator_id", first.alias("earlier_annotator"))
