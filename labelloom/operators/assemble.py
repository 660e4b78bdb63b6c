"""Selected records: one whole record per item, taken over without fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions import geometry as G
from labelloom.functions import taxonomy as T
from labelloom.operators import score as S
from labelloom.operators.match import union_area
from labelloom.operators.validate import validate_selected

METHOD = "vision_model_selection_v1"
RECORD = ("item_id", "annotator_id")


def selected_objects(mine: DataFrame, items: DataFrame, identities: DataFrame, fidelity: DataFrame) -> DataFrame:
    """One accepted object per annotation of a selected record, with its single vote.

    The object id hashes item, annotator and the place of the annotation in its record (in ``seq`` order;
    a record is one submission). Missing confidence counts as 0, a missing area is that of the box, a
    missing weight the area's share of the frame.
    """
    place = F.row_number().over(Window.partitionBy(*RECORD).orderBy("seq")) - 1
    frame = F.greatest(F.lit(1), F.col("width") * F.col("height"))
    own = {c: F.col(c) if c in mine.columns else F.lit(None) for c in ("area", "weight", "confidence")}
    area = F.coalesce(own["area"].cast("double"), G.box_area())
    base = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("avg_fidelity"), F.lit(0.0))))
    row = mine.withColumn("_i", place).join(items.select("item_id", "width", "height"), "item_id").join(
        identities.select("annotator_id", "identity"), "annotator_id", "left").join(
        fidelity.select("annotator_id", "avg_fidelity"), "annotator_id", "left")
    key = F.concat_ws(":", F.col("item_id").cast("string"), F.col("annotator_id").cast("string"), F.col("_i").cast("string"))
    return row.select(
        *RECORD, "seq", F.substring(F.sha2(key, 256), 1, 16).alias("cluster_id"), "label", T.keyword_severity(F.col("label")).alias("severity"),
        F.coalesce(own["confidence"].cast("double"), F.lit(0.0)).alias("confidence"), F.lit(1.0).alias("severity_confidence"), F.lit(1.0).alias("mean_iou"),
        F.coalesce(F.col("identity").cast("string"), F.lit("")).alias("identity"), base.alias("reliability"), F.lit(METHOD).alias("method"),
        *G.BOX, *(["polygon"] if "polygon" in mine.columns else []), area.alias("area"), F.coalesce(own["weight"].cast("double"), area / frame).alias("weight"),
        (area / frame * T.carbon_multiplier(T.canonical_label(F.col("label")))).alias("carbon"))


def assemble_selected(selected: DataFrame, anns: DataFrame, items: DataFrame, identities: DataFrame, fidelity: DataFrame,
                      spectral: DataFrame | None = None, water: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Winning row per selected record, and its objects.

    ``selected``: item_id, annotator_id, policy_accepted; ``fidelity``: annotator_id, avg_fidelity. A row has the composite
    quality as score, the sorted reasons that ask for a review, invalid annotations (which void a record), carbon
    weight, covered area and object count without background, and the contribution {annotator: 1} if it is
    accepted. Records without annotations appear with their reason.
    """
    group = list(RECORD)
    mine = anns.join(selected.select(*group), group, "left_semi")
    audit = S.audit_geometry(mine, group, water)
    checked = validate_selected(mine, items, audit, group, selected)
    measured = mine if "area" in mine.columns else mine.withColumn("area", F.lit(None).cast("double"))
    quality = S.item_quality(measured, audit, fidelity, group, spectral)
    objects = selected_objects(mine, items, identities, fidelity)
    real = objects.where(F.col("label") != T.BACKGROUND)
    sums = real.groupBy(*group).agg(F.bround(F.sum("carbon"), 6).alias("net_weight"), F.count("*").alias("object_count"))
    covered = union_area(real, group)
    frame = F.greatest(F.lit(1), F.col("width") * F.col("height"))
    row = checked.join(items.select("item_id", "width", "height"), "item_id").join(quality, group, "left").join(sums, group, "left").join(covered, group, "left")
    ratio = F.least(F.lit(1.0), F.coalesce("union_area", F.lit(0.0)) / frame)
    accepted = F.col("selection_accepted") & (F.col("invalid") == 0)
    return row.select(
        *group, F.lit(METHOD).alias("method"), F.col("item_quality").alias("score"), "annotations", "invalid", "reason", accepted.alias("accepted"),
        F.coalesce("net_weight", F.lit(0.0)).alias("net_weight"), ratio.alias("coverage"), F.bround(ratio * 100, 2).alias("coverage_pct"),
        F.coalesce("object_count", F.lit(0)).cast("bigint").alias("object_count"),
        F.when(accepted, F.create_map(F.col("annotator_id"), F.lit(1.0))).alias("contributions")), objects
