"""Row and group checks of submissions, selections, rewards and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions import geometry as G
from labelloom.scale import first_rows
from labelloom.operators.reward import hamilton

MAX_POINTS, MAX_ANNOTATIONS, MAX_RECORDS = 256, 512, 8192
MAX_VERTEX_WORK, MAX_AREA_RATIO = 2_000_000, 0.60
BOX_SLACK = 0.5


def _errors(*tests: tuple[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), name) for name, bad in tests]))


def validate_annotations(df: DataFrame) -> DataFrame:
    """Add ``errors``: box, metadata and polygon violations of each annotation."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    poly = F.col("polygon")
    some = poly.isNotNull()
    coords_ok = G.finite(x1) & G.finite(y1) & G.finite(x2) & G.finite(y2)

    def number_bad(name: str) -> Column:
        c = F.col(name)
        return c.isNotNull() & ~(G.finite(c) & (c >= 0))

    points_ok = F.forall(poly, lambda p: G.finite(p["x"]) & G.finite(p["y"]))
    outside = F.exists(poly, lambda p: (p["x"] < x1 - BOX_SLACK) | (p["y"] < y1 - BOX_SLACK)
                       | (p["x"] > x2 + BOX_SLACK) | (p["y"] > y2 + BOX_SLACK))
    fit = some & (F.size(poly) > 3) & (F.size(poly) <= MAX_POINTS) & points_ok
    df = df.withColumn("_cross", G.self_crossing(F.when(fit, poly)))
    return df.withColumn("errors", _errors(
        ("box_not_finite", ~coords_ok),
        ("box_not_positive", coords_ok & ~((x2 > x1) & (y2 > y1))),
        ("bad_area", number_bad("area")),
        ("bad_weight", number_bad("weight")),
        ("bad_confidence", number_bad("confidence") | (F.coalesce("confidence", F.lit(0.0)) > 1.0)),
        ("polygon_too_short", some & (F.size(poly) < 3)),
        ("polygon_too_long", some & (F.size(poly) > MAX_POINTS)),
        ("polygon_not_finite", some & ~points_ok),
        ("polygon_outside_box", some & points_ok & coords_ok & outside),
        ("polygon_without_area", some & (F.size(poly) >= 3) & points_ok & (G.shoelace(poly) <= 0)),
        ("polygon_crosses_itself", F.col("_cross")),
    )).drop("_cross")


def gate_submissions(subs: DataFrame, records: DataFrame, tasks: DataFrame, items: DataFrame):
    """Split submissions into (accepted records with clamped boxes, verdict per submission).

    ``subs``: submission_id, task_id, nonce, batch_id, artifact. ``tasks``:
    task_id, nonce, batch_id. A submission is rejected for an unknown task, a
    different nonce or batch, a missing artifact or an item recorded twice.
    """
    known = tasks.select("task_id", F.col("nonce").alias("t_nonce"), F.col("batch_id").alias("t_batch"),
                         F.lit(True).alias("known"))
    per_record = records.select("submission_id", "record_id", "item_id").distinct()
    twice = per_record.groupBy("submission_id", "item_id").count().where("count > 1").select(
        "submission_id", F.lit(True).alias("twice")).distinct()
    verdict = subs.join(known, "task_id", "left").join(twice, "submission_id", "left").select(
        "submission_id", (
            F.when(F.col("known").isNull(), "unknown_task")
            .when(~F.col("nonce").eqNullSafe(F.col("t_nonce")), "nonce_mismatch")
            .when(~F.col("batch_id").eqNullSafe(F.col("t_batch")), "batch_mismatch")
            .when(F.coalesce("artifact", F.lit("")) == "", "missing_artifact")
            .when(F.col("twice"), "duplicate_record")).alias("reason"))
    good = verdict.where(F.col("reason").isNull()).select("submission_id")
    sized = records.join(good, "submission_id", "left_semi").join(items.select("item_id", "width", "height"), "item_id")
    for axis, side in (("x", "width"), ("y", "height")):
        for end in "12":
            c = F.col(f"{axis}{end}")
            sized = sized.withColumn(f"{axis}{end}", F.greatest(F.lit(0.0), F.least(F.col(side).cast("double"), c)))
    return sized.drop("width", "height"), verdict


def check_limits(
    anns: DataFrame, items: DataFrame, submission: Sequence[str] = ("submission_id",),
    max_annotations: int = MAX_ANNOTATIONS, max_records: int = MAX_RECORDS, max_work: int = MAX_VERTEX_WORK,
    max_ratio: float = MAX_AREA_RATIO,
) -> DataFrame:
    """Size limits per submission; two map-side combined aggregations, no geometry."""
    submission = list(submission)
    points = F.coalesce(F.when(F.col("polygon").isNotNull(), F.size("polygon")), F.lit(0)).cast("bigint")
    sized = anns.join(items.select("item_id", F.greatest(F.lit(1), F.col("width") * F.col("height")).alias("frame")),
                      "item_id")
    per_item = sized.groupBy(*submission, "item_id").agg(
        F.count("*").alias("n"), F.sum(points * points).alias("work"),
        F.max(G.box_area() / F.col("frame")).alias("ratio"))
    return per_item.groupBy(*submission).agg(
        F.count("*").alias("records"), F.max("n").alias("max_annotations"), F.sum("work").alias("vertex_work"),
        F.max("ratio").alias("max_area_ratio")).withColumn("errors", F.array_join(_errors(
            ("too_many_annotations", F.col("max_annotations") > max_annotations),
            ("too_many_records", F.col("records") > max_records),
            ("too_many_vertices", F.col("vertex_work") > max_work),
            ("oversized_box", F.col("max_area_ratio") > max_ratio)), ","))


def clean_detections(df: DataFrame, items: DataFrame, group: Sequence[str] = ("item_id",), keep: int = 512,
                     max_ratio: float = MAX_AREA_RATIO, tie: Sequence[str] = ("annotator_id", "seq")) -> DataFrame:
    """Clamp to the frame, drop degenerate and oversized boxes, keep the most confident ones per group."""
    sized = df.join(items.select("item_id", "width", "height"), "item_id")
    for axis, side in (("x", "width"), ("y", "height")):
        for end in "12":
            sized = sized.withColumn(f"{axis}{end}", F.greatest(
                F.lit(0.0), F.least(F.col(side).cast("double"), F.col(f"{axis}{end}"))))
    frame = F.greatest(F.lit(1), F.col("width") * F.col("height"))
    good = sized.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")) & (G.box_area() / frame < max_ratio))
    order = [F.desc(F.coalesce("confidence", F.lit(1.0))), *[F.col(c) for c in tie]]
    return first_rows(good.drop("width", "height"), group, order, keep)


def exportable(df: DataFrame) -> DataFrame:
    """Accepted public rows."""
    return df.where(~F.col("is_golden") & ~F.col("escalated"))


def golden_leaks(export: DataFrame, items: DataFrame) -> DataFrame:
    """Exported rows of golden items; must be empty."""
    return export.join(items.where(F.col("role") != "public").select("item_id"), "item_id", "left_semi")


def validate_selected(
    anns: DataFrame, items: DataFrame, audit: DataFrame | None = None, group: Sequence[str] = ("item_id", "annotator_id"),
    selected: DataFrame | None = None,
) -> DataFrame:
    """Escalation reasons per selected record.

    Counts geometry and metadata violations (``invalid``) and collects full-frame
    boxes, repeated (label, box, polygon) rows, empty records, a rejected policy
    and a failed audit into a sorted, comma-joined reason list. ``selected``
    lists the records (with ``policy_accepted``), so empty ones appear.
    """
    group = list(group)
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    sized = anns.join(items.select("item_id", "width", "height"), "item_id")
    poly = F.col("polygon")
    off = F.exists(poly, lambda p: ~G.finite(p["x"]) | ~G.finite(p["y"]) | (p["x"] < 0) | (p["y"] < 0)
                   | (p["x"] > F.col("width")) | (p["y"] > F.col("height"))
                   | (p["x"] < x1 - BOX_SLACK) | (p["y"] < y1 - BOX_SLACK)
                   | (p["x"] > x2 + BOX_SLACK) | (p["y"] > y2 + BOX_SLACK))
    bad = (
        (F.trim(F.coalesce("label", F.lit(""))) == "") | ~G.box_ok() | (x1 < 0) | (y1 < 0)
        | (x2 > F.col("width")) | (y2 > F.col("height"))
        | (poly.isNotNull() & ((F.size(poly) < 3) | off))
        | (F.col("confidence").isNotNull() & ~F.col("confidence").between(0, 1)))
    full = (x1 == 0) & (y1 == 0) & (x2 == F.col("width")) & (y2 == F.col("height"))
    # Equal rows collapse in the first aggregation, so a crowd of copies never meets in one task.
    distinct = sized.groupBy(*group, "label", "x1", "y1", "x2", "y2", F.sha2(F.to_json(F.struct("polygon")), 256).alias("_h")).agg(
        F.count("*").alias("k"), F.count_if(F.coalesce(bad, F.lit(True))).alias("bad"),
        F.max(full.cast("int")).alias("full"))
    per = distinct.groupBy(*group).agg(
        F.sum("k").alias("annotations"), F.max("k").alias("copies"),
        F.sum("bad").alias("invalid"), F.max("full").alias("full"))
    base = per.withColumn("policy_accepted", F.lit(True)) if selected is None else selected.join(per, group, "left")
    if audit is not None:
        base = base.join(audit.select(*group, "acceptable", F.col("reason").alias("audit_reason")), group, "left")
    else:
        base = base.withColumn("acceptable", F.lit(True)).withColumn("audit_reason", F.lit(None).cast("string"))
    n = F.coalesce("annotations", F.lit(0))
    reasons = F.array_compact(F.array(
        F.when(~F.col("policy_accepted"), "selection_policy_not_accepted"),
        F.when(F.coalesce("acceptable", F.lit(True)) == F.lit(False),
               F.coalesce("audit_reason", F.lit("geometric_quality_audit_failed"))),
        F.when(n == 0, "empty_annotations_requires_review"),
        F.when(F.col("full") == 1, "full_frame_box_requires_review"),
        F.when(F.col("copies") > 1, "duplicate_annotation_requires_review")))
    joined = F.array_join(F.array_sort(F.array_distinct(reasons)), ",")
    return base.select(*group, n.cast("bigint").alias("annotations"), F.coalesce("invalid", F.lit(0)).cast("bigint").alias(
        "invalid"), F.when(joined != "", joined).alias("reason"), (
            F.col("policy_accepted") & (joined == "")).alias("selection_accepted"))


def eligible_participants(people: DataFrame, stake_limit: float = 4096.0) -> DataFrame:
    """Serving participants that are not permitted validators above the stake limit."""
    return people.where(F.col("serving") & ~(F.col("permit") & (F.col("stake") > stake_limit)))


# Keys an exported row, object and vote must have.
ROOT_KEYS = [
    "image_id", "aggregation_method", "acceptance_thresholds", "reliability_window", "escalation_required",
    "escalation_reason", "validator_version", "audit_hash", "miner_contribution_scores", "objects", "score",
    "chosen_uid", "image_url", "annotated_image_url", "width", "height", "is_golden", "timestamp"]
OBJECT_KEYS = [
    "aggregation_method", "object_cluster_id", "accepted_hazard_class", "accepted_severity", "confidence",
    "severity_confidence", "class_posterior_distribution", "severity_posterior_distribution", "fused_bounding_box",
    "spatial_mean_iou_to_median", "miner_votes", "escalation_reason"]
VOTE_KEYS = [
    "miner_uid", "miner_hotkey", "class_voted", "severity_voted", "confidence", "bounding_box",
    "reliability_weight_at_aggregation"]
WEB_URL = "^https?://"


def audit_hash(row: Column) -> Column:
    """Hash of a JSON row without its own hash field, independent of key order."""
    fields = F.from_json(row, "map<string,string>")
    entries = F.array_sort(F.map_entries(F.map_filter(fields, lambda k, v: k != "audit_hash")))
    return F.sha2(F.array_join(F.transform(entries, lambda e: F.concat(
        F.to_json(F.struct(e["key"].alias("k"))), F.lit(":"), F.coalesce(e["value"], F.lit("null")))), ","), 256)


def check_export_schema(rows: DataFrame, key: str, column: str = "value", url: str = WEB_URL) -> DataFrame:
    """Errors per exported JSON row: missing keys, bad URLs, accepted rows without objects, hash mismatch."""
    def absent(names, have):
        return F.array_except(F.array(*[F.lit(n) for n in names]), have)

    row = rows.select(key, F.col(column).alias("_raw"), F.from_json(column, "map<string,string>").alias("_m"))
    row = row.withColumn("_obj", F.from_json(F.element_at("_m", "objects"), "array<map<string,string>>"))
    votes = F.flatten(F.transform(F.coalesce("_obj", F.array()), lambda o: F.coalesce(
        F.from_json(F.element_at(o, "miner_votes"), "array<map<string,string>>"), F.array())))
    row = row.withColumn("_votes", votes)

    def url_bad(name):
        return ~F.coalesce(F.element_at("_m", name), F.lit("")).rlike(url)

    def every(col, names):
        return F.exists(F.coalesce(F.col(col), F.array()), lambda o: F.size(absent(names, F.map_keys(o))) > 0)

    errors = _errors(
        ("missing_root_keys", F.size(absent(ROOT_KEYS, F.map_keys("_m"))) > 0),
        ("bad_image_url", url_bad("image_url")), ("bad_annotated_image_url", url_bad("annotated_image_url")),
        ("accepted_without_objects", (F.element_at("_m", "escalation_required") == "false")
         & (F.size(F.coalesce("_obj", F.array())) == 0)),
        ("missing_object_keys", every("_obj", OBJECT_KEYS)), ("missing_vote_keys", every("_votes", VOTE_KEYS)),
        ("audit_hash_mismatch", ~F.element_at("_m", "audit_hash").eqNullSafe(audit_hash(F.col("_raw")))))
    return row.select(key, F.explode(errors).alias("error"))


def validate_reward_rows(rows: DataFrame, fidelity: DataFrame, supplied: DataFrame, caps: DataFrame,
                         by: str = "round_num", public: DataFrame | None = None) -> DataFrame:
    """Reward-boundary verdict per round; any bad row voids the whole round.

    ``rows``: selected rows with item, chosen, score, method, flags, vote and
    contribution fields and the object checks already reduced to ``objects_ok``.
    ``supplied``: the expected (item, chosen) provenance. ``caps``: slots per annotator.
    ``public`` (round, public_count): the caps of a round must add up to its public count or to 0, and there must
    not be more selected items; a round it does not list has a count of 0. Rounds without any cap are void.
    Rows over their cap earn nothing (``over_cap``) but do not void the round.
    """
    fid = fidelity.select(by, F.col("annotator_id").alias("chosen"), "fidelity")
    row = rows.join(fid, [by, "chosen"], "left")
    near = F.abs(F.col("score") - F.col("fidelity")) <= F.greatest(
        F.lit(1e-7), 1e-6 * F.greatest(F.abs("score"), F.abs("fidelity")))
    good = (
        (F.col("method") == "vision_model_selection_v1") & F.col("accepted") & ~F.col("is_golden") & ~F.col("escalated")
        & F.col("fidelity").between(0.05, 1.0) & near & (F.col("contributors") == 1) & (F.col("contribution") == 1.0)
        & F.col("objects_ok"))
    per_row = row.withColumn("ok", F.coalesce(good, F.lit(False)))
    rounds = per_row.groupBy(by).agg(F.count("*").alias("rows"), F.count_if(~F.col("ok")).alias("bad_rows"))
    repeated = rows.groupBy(by, "item_id").count().where("count > 1").groupBy(by).agg(F.count("*").alias("repeated"))
    mismatch = provenance_mismatch(
        rows.select(by, "item_id", F.col("chosen").alias("annotator_id")), supplied, [by, "item_id"]).groupBy(by).agg(
        F.count("*").alias("mismatched"))
    used = rows.groupBy(by, F.col("chosen").alias("annotator_id")).agg(F.count("*").alias("used"))
    over = used.join(caps, [by, "annotator_id"], "left").where(
        F.col("used") > F.coalesce("cap", F.lit(0))).groupBy(by).agg(F.count("*").alias("over_cap"))
    total = caps.groupBy(by).agg(F.sum("cap").alias("cap_total"), F.count("*").alias("_capped"))
    out = rounds.join(repeated, by, "left").join(mismatch, by, "left").join(over, by, "left").join(total, by, "left")
    if public is not None:
        out = out.join(public.select(by, "public_count"), by, "left")
    else:
        out = out.withColumn("public_count", F.lit(None).cast("bigint"))
    sound = F.lit(True) if public is None else (
        ((F.col("cap_total") == 0) | (F.col("cap_total") == F.col("public_count"))) & (F.col("rows") <= F.col("public_count")))
    out = out.fillna(0)
    return out.withColumn("caps_sound", (F.col("_capped") > 0) & sound).drop("_capped").withColumn(
        "valid", (F.col("bad_rows") + F.col("repeated") + F.col("mismatched") == 0) & F.col("caps_sound"))


def provenance_mismatch(expected: DataFrame, supplied: DataFrame, key: Sequence[str] = ("item_id",)) -> DataFrame:
    """Rows where the supplied source differs from the expected one, or only one side has the item."""
    key = list(key)
    e = expected.select(*key, F.col("annotator_id").alias("expected"))
    s = supplied.select(*key, F.col("annotator_id").alias("supplied"))
    return e.join(s, key, "full_outer").where(~F.col("expected").eqNullSafe(F.col("supplied")))


def select_pseudo_labels(items: DataFrame, detections: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """Every item with the detections confident enough to serve as labels; others stay unlabelled."""
    sure = detections.where(F.col("confidence") >= min_confidence)
    return items.join(sure, "item_id", "left").withColumn("labelled", F.col("seq").isNotNull())


def complete_items(requested: DataFrame, answers: DataFrame, key: str = "item_id") -> DataFrame:
    """Every requested item with its answer rows; one row of nulls (``answered`` false) for an item without any.

    Answers stay rows, so an item with very many of them is never gathered.
    """
    return requested.join(answers.withColumn("answered", F.lit(True)), key, "left").fillna({"answered": False})


def validate_selection_plan(plan: DataFrame, candidates: DataFrame, slots: DataFrame, images: DataFrame,
                            shares: DataFrame | None = None, minimum: int = 0) -> DataFrame:
    """Contract violations of a selection plan, one row per violation.

    ``plan``: item_id, annotator_id (null = unassigned), quality_accepted (null =
    not boolean). ``candidates``: (item_id, annotator_id) that were submitted.
    ``slots``: annotator_id, cap and claimed_cap. ``images``: item_id. With ``shares`` (annotator_id, share) the caps
    are recomputed here: one slot per image, dealt out by largest remainder with ``minimum`` each; ``slots`` then
    needs only what the plan claims, and an annotator without a share has no slot.
    """
    if shares is not None:
        fair = hamilton(shares, images.select("item_id").distinct().agg(F.count("*").alias("n")), minimum=minimum)
        slots = fair.select("annotator_id", F.col("slots").alias("cap")).join(slots.select("annotator_id", "claimed_cap"), "annotator_id", "full")
    chosen = plan.where(F.col("annotator_id").isNotNull())

    def rows(df: DataFrame, name: str, item=None, who=None) -> DataFrame:
        return df.select(F.lit(name).alias("violation"),
                         (F.lit(None) if item is None else F.col(item)).cast("bigint").alias("item_id"),
                         (F.lit(None) if who is None else F.col(who)).cast("bigint").alias("annotator_id"))

    used = chosen.groupBy("annotator_id").agg(F.count("*").alias("used"))
    return (
        rows(chosen.join(candidates, ["item_id", "annotator_id"], "left_anti"), "unknown_source", "item_id", "annotator_id")
        .unionByName(rows(plan.where(F.col("quality_accepted").isNull()), "decision_not_boolean", "item_id"))
        .unionByName(rows(plan.where(F.col("annotator_id").isNull() & F.col("quality_accepted")),
                          "accepted_without_source", "item_id"))
        .unionByName(rows(plan.groupBy("item_id").count().where("count > 1"), "duplicate_item", "item_id"))
        .unionByName(rows(images.select("item_id").join(plan, "item_id", "left_anti"), "missing_item", "item_id"))
        .unionByName(rows(used.join(slots, "annotator_id", "left").where(
            F.col("used") > F.coalesce("cap", F.lit(0))), "over_cap", None, "annotator_id"))
        .unionByName(rows(slots.where(F.coalesce("cap", F.lit(0)) != F.coalesce("claimed_cap", F.lit(0))), "forged_cap", None, "annotator_id")))
