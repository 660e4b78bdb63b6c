"""Annotator scores: geometry audit, fidelity, peer consensus, confusion counts, reliability."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.config import FidelityConfig
from labelloom.functions import geometry as G
from labelloom.functions import taxonomy as T
from labelloom.operators.match import greedy_match, iou_join
from labelloom.scale import hash_sums, split_hot
from labelloom.session import cut

SUBMISSION = ("round_num", "item_id", "annotator_id")


def outline_quality(df: DataFrame) -> DataFrame:
    """Per annotation: crude-box flag, compactness, convexity and spiky flag."""
    names = df.columns
    out = df.withColumn("_o", G.outline_stats("polygon"))
    o = {c: F.col("_o." + c) for c in ("n", "clean_n", "nx", "ny", "area", "length", "clean_area", "w", "h", "hull")}
    out = out.withColumn("is_box", G.crude_from(o["clean_n"], o["clean_area"], o["w"], o["h"], o["nx"], o["ny"]))
    real = ~F.col("is_box") & (o["n"] >= 3)
    area, length = o["area"], o["length"]
    q = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 4 * F.pi() * area / (length * length)))
    out = out.withColumn("compactness", F.when(real, F.when((area <= 1.0) | (length <= 0.0), 0.0).otherwise(q)))
    out = out.withColumn("convexity", F.when(real, G.convexity(area, o["hull"])))
    spiky = real & F.coalesce(G.spiky(o["n"], F.col("compactness"), F.col("convexity")), F.lit(False))
    return out.select(*names, "is_box", "compactness", "convexity", spiky.alias("is_spiky"))


def _penalty(count: Column, total: Column) -> Column:
    ratio = count / total
    too_many = (ratio > 0.08) | ((total <= 10) & (count >= 2)) | (count >= 5)
    return F.when(count == 0, 1.0).when(too_many, 0.0).otherwise(
        F.greatest(F.lit(0.0), (1.0 - 5.0 * ratio) * (1.0 - 5.0 * ratio)))


def audit_columns() -> list[Column]:
    """Aggregates over ``outline_quality`` rows that the audit verdict needs."""
    return [
        F.count("*").alias("total"),
        F.count_if("is_box").alias("box_count"),
        F.count_if("is_spiky").alias("spiky_count"),
        F.coalesce(F.avg("compactness"), F.lit(0.70)).alias("_q"),
        F.coalesce(F.avg("convexity"), F.lit(0.85)).alias("_c"),
    ]


def audit_verdict(df: DataFrame, water: str | None = None) -> DataFrame:
    """Quality multiplier, acceptance and reason from the audit counts."""
    total = F.col("total")
    box, spiky = F.col("box_count"), F.col("spiky_count")
    wet = F.coalesce(F.col(water), F.lit(0)) if water else F.lit(0)
    box_mult, spiky_mult = _penalty(box, total), _penalty(spiky, total)
    quality = F.bround(box_mult * spiky_mult * F.when(wet > 0, 0.0).otherwise(1.0), 4)

    def share(c):
        return F.format_string("%.1f", c / total * 100)

    # Fixed wording of the reasons.
    reasons = F.concat_ws(
        "; ",
        F.when((box > 0) & (box_mult == 0), F.concat(
            F.lit("box_gaming_detected: excessive_box_polygons ("), box, F.lit("/"), total, F.lit(" boxes, "),
            share(box), F.lit("%)"))),
        F.when((spiky > 0) & (spiky_mult == 0), F.concat(
            F.lit("spiky_erratic_polygons ("), spiky, F.lit("/"), total, F.lit(", "), share(spiky), F.lit("%)"))),
        F.when(wet > 0, F.concat(F.lit("ocean_water_hallucinations ("), wet, F.lit(" stands)"))))
    return (
        df.withColumn("box_ratio", F.bround(box / total, 4)).withColumn("spiky_ratio", F.bround(spiky / total, 4))
        .withColumn("mean_compactness", F.bround("_q", 4)).withColumn("mean_convexity", F.bround("_c", 4))
        .withColumn("quality", quality).withColumn("reason", F.when(reasons != "", reasons))
        .withColumn("acceptable", (F.col("quality") >= 0.70) & F.col("reason").isNull())
        .drop("_q", "_c"))


def audit_geometry(anns: DataFrame, group: Sequence[str] = SUBMISSION, water: DataFrame | None = None) -> DataFrame:
    """Audit of every submission; ``water`` optionally brings ``water_count`` per submission."""
    counts = outline_quality(anns).groupBy(*group).agg(*audit_columns())
    if water is None:
        return audit_verdict(counts)
    return audit_verdict(counts.join(water, list(group), "left"), "water_count")


def score_fidelity(
    anns: DataFrame, golden: DataFrame, items: DataFrame, cfg: FidelityConfig = FidelityConfig(),
    submissions: DataFrame | None = None, group: Sequence[str] = SUBMISSION,
) -> DataFrame:
    """Fidelity of each submission on a golden item.

    ``items``: item_id, width, height, role ('golden' or 'class_only' rows are
    scored) and only_label. ``submissions`` lists the submissions when empty ones
    must appear. With truth boxes: mean IoU and label match over truth (misses
    are 0), penalty m/(m+h), carbon-weight agreement and the audit multiplier.
    On an empty item: 1 for no detections, else 0. With only a label: mean label
    match times m/(m+h), never rewardable.
    """
    group = list(group)
    scored = items.where(F.col("role").isin("golden", "class_only")).select(
        "item_id", "role", (F.greatest(F.lit(1), F.col("width") * F.col("height"))).cast("double").alias("frame"),
        T.canonical_label(F.col("only_label")).alias("only_label"))
    mine = anns.join(scored, "item_id").withColumn("label", T.canonical_label(F.col("label")))
    share = G.box_area() / F.col("frame") * T.carbon_multiplier(F.col("label"))
    match_only = T.label_match(F.col("label"), F.col("only_label"))
    rows = outline_quality(mine) if cfg.audit else mine.select(
        "*", F.lit(False).alias("is_box"), F.lit(False).alias("is_spiky"),
        F.lit(None).cast("double").alias("compactness"), F.lit(None).cast("double").alias("convexity"))
    subs = rows.groupBy(*group).agg(
        *audit_columns(), F.bround(F.sum(share), 6).alias("net_weight"),
        F.avg(match_only).alias("only_avg"), F.sum(match_only).alias("only_hits"))
    if submissions is not None:
        subs = submissions.select(*group).distinct().join(subs, group, "left").fillna(
            {"total": 0, "box_count": 0, "spiky_count": 0, "net_weight": 0.0, "_q": 1.0, "_c": 1.0,
             "only_avg": 0.0, "only_hits": 0.0})
    subs = audit_verdict(subs.withColumn("n", F.col("total")).withColumn(
        "total", F.greatest(F.lit(1), F.col("total"))))

    truth = golden.withColumn("label", T.canonical_label(F.col("label")))
    gt_share = G.box_area() / F.col("frame") * T.carbon_multiplier(F.col("label"))
    gt_stats = truth.join(scored, "item_id").groupBy("item_id").agg(
        F.count("*").alias("gt_count"), F.bround(F.sum(gt_share), 6).alias("gt_weight"))

    matches = label_matches(mine, truth, group, cfg.min_iou, anns)
    hits = matches.groupBy(*group).agg(
        F.count("*").alias("matched"), F.sum("iou").alias("iou_sum"),
        F.sum(T.label_match(F.col("label"), F.col("gt_label"))).alias("label_sum"))

    row = (
        subs.join(scored, "item_id").join(gt_stats, "item_id", "left").join(hits, group, "left")
        .fillna({"gt_count": 0, "gt_weight": 0.0, "matched": 0, "iou_sum": 0.0, "label_sum": 0.0}))
    only = F.col("role") == "class_only"
    empty = ~only & (F.col("gt_count") == 0)
    quiet = F.col("n") == 0
    matched = F.when(only, F.col("only_hits").cast("bigint")).otherwise(F.col("matched"))
    false_pos = F.col("n") - matched
    factor = F.when(only, F.lit(1.0)).otherwise(F.lit(cfg.false_positive_factor))
    penalty = F.when(empty, F.pow(F.lit(cfg.empty_item_penalty), F.col("n"))).otherwise(
        F.when(matched == 0, 0.0).otherwise(matched / (matched + factor * false_pos)))
    n_gt = F.greatest(F.lit(1), F.col("gt_count"))
    agree = F.bround(F.greatest(F.lit(0.0), 1.0 - F.abs(F.col("net_weight") - F.col("gt_weight"))
                                / F.greatest(F.col("gt_weight"), F.lit(0.05))), 6)
    quality = F.col("quality") if cfg.audit else F.lit(1.0)
    accepted = F.col("acceptable") if cfg.audit else F.lit(True)
    out = row.select(
        *group, "role", F.col("n").alias("detections"),
        F.when(only, 1).otherwise(F.col("gt_count")).cast("bigint").alias("gt_count"),
        matched.cast("bigint").alias("matched"), false_pos.cast("bigint").alias("hallucinated"),
        F.when(only, 0.0).when(empty, F.when(quiet, 1.0).otherwise(0.0)).otherwise(F.col("iou_sum") / n_gt).alias("iou"),
        F.when(only, F.col("only_avg")).when(empty, F.when(quiet, 1.0).otherwise(0.0)).otherwise(
            F.col("label_sum") / n_gt).alias("label_match"),
        penalty.alias("penalty"),
        F.when(only, 1.0).when(empty, F.greatest(F.lit(0.0), 1.0 - F.col("net_weight"))).otherwise(agree).alias(
            "weight_agreement"),
        F.when(only | empty, 0.0).otherwise(F.col("gt_weight")).alias("gt_weight"), "net_weight",
        F.when(only | (empty & quiet), 1.0).when(empty, 0.0).otherwise(quality).alias("quality"),
        accepted.alias("_ok"), F.when(~only & ~empty, F.col("reason")).alias("reason"))
    raw = (cfg.iou_weight * F.col("iou") + cfg.label_weight * F.col("label_match")) * F.col("penalty") * (
        0.20 + 0.80 * F.col("weight_agreement")) * F.col("quality")
    is_only = F.col("role") == "class_only"
    is_empty = ~is_only & (F.col("gt_count") == 0)
    out = out.withColumn("fidelity", F.when(is_only, F.col("label_match") * F.col("penalty")).when(
        is_empty, F.col("iou")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))))
    return out.withColumn(
        "rewardable", F.when(is_only, False).when(is_empty, F.col("detections") == 0).otherwise(
            F.col("_ok") & (F.col("fidelity") > 0))).drop("_ok")


def label_matches(anns: DataFrame, truth: DataFrame, group: Sequence[str], min_iou: float = 0.5,
                  probe: DataFrame | None = None) -> DataFrame:
    """Greedy matches with both labels attached."""
    pairs = greedy_match(truth, anns, group, min_iou=min_iou, probe=probe, carry=("a_label", "b_label"))
    return pairs.withColumnsRenamed({"a_label": "label", "b_label": "gt_label"})


def score_consensus(
    anns: DataFrame, group: Sequence[str] = ("round_num", "item_id"), iou_weight: float = 0.6,
    label_weight: float = 0.4, limit: int = 256, probe: DataFrame | None = None,
) -> DataFrame:
    """Agreement of each annotator with the peers on the same item.

    For each peer the best IoU over all box pairs, averaged over peers, and
    whether the annotator's first label is the most common label of those best
    peer boxes (ties: smallest label).

    Items with up to ``limit`` boxes take one shuffle on the item; everything
    after it stays in place. On larger items, annotators with equal label and
    box sets are compared once and weighted by their number, so copies add no
    pairs, and the pair join is spread over tiles.
    """
    group = list(group)
    fields = ["label", *G.BOX]
    boxed = anns.select(*group, "annotator_id", "seq", T.canonical_label(F.col("label")).alias("label"), *G.BOX)
    small, large = split_hot(boxed, group, limit, probe)
    placed = small.repartition(*[F.col(g) for g in group])
    pairs = iou_join(placed.drop("seq"), placed.drop("seq"), group, 0.0,
                     F.col("a_annotator_id") != F.col("b_annotator_id"), None)
    best = pairs.groupBy(*group, F.col("a_annotator_id").alias("annotator_id"), F.col("b_annotator_id").alias("peer")).agg(
        F.min(F.struct((-F.col("iou")).alias("n"), F.col("b_label").alias("label"))).alias("b"))
    votes = best.select(*group, "annotator_id", F.col("b.label").alias("label"), F.lit(1).cast("bigint").alias("w"),
                        (-F.col("b.n")).alias("v"))
    firsts = placed.groupBy(*group, "annotator_id").agg(F.min_by("label", "seq").alias("own_label"))
    rows = [_consensus_rows(firsts, _top_votes(votes, [*group, "annotator_id"]), group, [*group, "annotator_id"],
                            iou_weight, label_weight)]
    if large is not None:
        sums = hash_sums(fields)
        per = large.groupBy(*group, "annotator_id").agg(*sums, F.min_by("label", "seq").alias("own_label"))
        sig = [f"_h{i}" for i in range(len(sums))]
        classes = cut(per.groupBy(*group, *sig).agg(F.count("*").alias("members"), F.min("annotator_id").alias("rep")))
        reps = cut(large.join(classes.select(*group, F.col("rep").alias("annotator_id"), "members"), [*group, "annotator_id"]).select(
            *group, F.col("annotator_id").alias("rep"), "members", *fields).distinct())
        pairs = iou_join(reps, reps, group, 0.0, F.col("a_rep") != F.col("b_rep"))
        best = pairs.groupBy(*group, F.col("a_rep").alias("rep"), F.col("b_rep").alias("peer")).agg(
            F.min(F.struct((-F.col("iou")).alias("n"), F.col("b_label").alias("label"), F.col("b_members").alias("m"))).alias("b"))
        votes = best.select(*group, "rep", F.col("b.label").alias("label"), F.col("b.m").alias("w"),
                            (-F.col("b.n") * F.col("b.m")).alias("v"))
        # The other members of a class overlap its boxes completely.
        selves = reps.where(G.box_ok() & (F.col("members") > 1)).groupBy(*group, "rep").agg(
            F.min("label").alias("label"), (F.max("members") - 1).alias("w")).withColumn("v", F.col("w").cast("double"))
        top = _top_votes(votes.unionByName(selves), [*group, "rep"])
        rows.append(_consensus_rows(per.join(classes, [*group, *sig]), top, group, [*group, "rep"], iou_weight, label_weight))
    return reduce(DataFrame.unionByName, rows)


def _top_votes(votes: DataFrame, key: list[str]) -> DataFrame:
    tally = votes.groupBy(*key, "label").agg(F.sum("w").alias("w"), F.sum("v").alias("v"))
    return tally.groupBy(*key).agg(F.sum("v").alias("iou_sum"), F.min(
        F.struct((-F.col("w")).alias("n"), "label")).getField("label").alias("major"))


def _consensus_rows(per: DataFrame, top: DataFrame, group: list[str], key: list[str], iou_weight: float, label_weight: float):
    crowd = per.groupBy(*group).agg((F.count("*") - 1).alias("peers"))
    row = per.join(top, key, "left").join(crowd, group)
    mean = F.when(F.col("peers") > 0, F.coalesce("iou_sum", F.lit(0.0)) / F.col("peers")).otherwise(0.0)
    agree = F.when(F.col("own_label") == F.col("major"), 1.0).otherwise(0.0)
    return row.select(*group, "annotator_id", "peers", mean.alias("mean_iou"), agree.alias("majority_match"),
                      F.least(F.lit(1.0), iou_weight * mean + label_weight * agree).alias("consensus"))


def fill_missing_golden(scores: DataFrame, expected: DataFrame, items: DataFrame,
                        key: Sequence[str] = SUBMISSION) -> DataFrame:
    """Add an explicit zero for every expected boxed golden item without a score; label-only items are left out."""
    key = list(key)
    boxed = items.where(F.col("role") == "golden").select("item_id")
    absent = expected.select(*key).distinct().join(boxed, "item_id", "left_semi").join(
        scores.select(*key), key, "left_anti")
    zero = absent.select(*key, F.lit(0.0).alias("fidelity"), F.lit(True).alias("missing"))
    return scores.select(*key, F.when(F.col("rewardable"), F.col("fidelity")).otherwise(0.0).alias("fidelity"),
                         F.lit(False).alias("missing")).unionByName(zero)


def annotator_average(scores: DataFrame, fidelity: DataFrame, by: Sequence[str] = ("annotator_id",),
                      event_penalty: float = 0.5) -> DataFrame:
    """Mean fidelity (missing rows are zeros) and the factor ``penalty ^ min(5, hallucinated / truth)``."""
    by = list(by)
    mean = scores.groupBy(*by).agg(
        F.avg("fidelity").alias("avg_fidelity"), F.count("*").alias("scored"), F.count_if("missing").alias("missing"))
    noise = fidelity.groupBy(*by).agg(
        F.sum("hallucinated").alias("hallucinated"), F.sum("gt_count").alias("gt_total"))
    ratio = F.least(F.lit(5.0), F.col("hallucinated") / F.greatest(F.lit(1), F.col("gt_total")))
    return mean.join(noise, by, "left").fillna({"hallucinated": 0, "gt_total": 0}).withColumn(
        "hallucination_multiplier", F.pow(F.lit(event_penalty), ratio))


def confusion_counts(
    anns: DataFrame, golden: DataFrame, items: DataFrame, audit: DataFrame | None = None,
    submissions: DataFrame | None = None, min_iou: float = 0.5, group: Sequence[str] = SUBMISSION,
) -> DataFrame:
    """True/false positives, misses and IoU sums per (round, annotator, label) on golden items.

    Pass ``submissions`` to count only those (empty ones included). A submission
    failing ``audit`` (not acceptable or quality below 0.5) counts all its
    detections as false and all truth as missed. On an empty item an empty
    submission is a background hit, any other a background miss. On a label-only
    item the first matching detection is a hit and other labels are false.
    """
    group = list(group)
    by = [g for g in group if g != "item_id"]
    roles = items.where(F.col("role").isin("golden", "class_only")).select(
        "item_id", "role", T.canonical_label(F.col("only_label")).alias("only_label"))
    subs = (submissions if submissions is not None else anns).select(*group).distinct().join(roles, "item_id")
    if audit is not None:
        bad = audit.where(~F.col("acceptable") | (F.col("quality") < 0.5)).select(*group, F.lit(True).alias("failed"))
        subs = subs.join(bad, group, "left").fillna({"failed": False})
    else:
        subs = subs.withColumn("failed", F.lit(False))
    # Outlines take part when the golden objects have them.
    outline = ["polygon"] if "polygon" in golden.columns and "polygon" in anns.columns else []
    truth = golden.select("item_id", "gt", T.canonical_label(F.col("label")).alias("label"), "x1", "y1", "x2", "y2", *outline)
    has_truth = truth.groupBy("item_id").agg(F.count("*").alias("gt_n"))
    subs = subs.join(has_truth, "item_id", "left").fillna({"gt_n": 0})
    # Detections and matches feed several event lists, and submissions on golden items are few: store them once.
    subs = cut(subs)
    keep = [c for c in ("seq", "label", *G.BOX, *outline) if c not in group]
    mine = cut(anns.select(*group, *keep).withColumn("label", T.canonical_label(F.col("label"))).join(subs, group))
    only = F.col("role") == "class_only"
    zero = F.lit(0.0)

    def events(df, label, tp=zero, fp=zero, fn=zero, iou=zero, n_iou=zero, any_iou=zero, any_n=zero, seen=zero):
        cols = dict(tp=tp, fp=fp, fn=fn, iou_sum=iou, iou_n=n_iou, all_iou=any_iou, all_n=any_n, gt_seen=seen)
        return df.select(*by, label.alias("label"), *[c.cast("double").alias(k) for k, c in cols.items()])

    boxed = mine.where(~only)
    fair = boxed.where(~F.col("failed"))
    pairs = cut(label_matches(fair, truth, group, min_iou))
    same = F.col("label") == F.col("gt_label")
    hit, miss = F.when(same, 1.0).otherwise(0.0), F.when(same, 0.0).otherwise(1.0)
    one = F.lit(1.0)
    parts = [
        events(pairs, F.col("gt_label"), tp=hit, fn=miss, iou=F.when(same, F.col("iou")).otherwise(0.0), n_iou=hit,
               any_iou=F.col("iou"), any_n=one, seen=one),
        events(pairs.where(~same), F.col("label"), fp=one),
        # detections without a match, and every detection of a failed submission
        events(boxed.join(pairs.select(*group, "seq"), [*group, "seq"], "left_anti"), F.col("label"), fp=one),
        # truth without a match, for failed submissions all of it
        events(subs.where(~only).join(truth.select("item_id", "gt", "label"), "item_id")
               .join(pairs.select(*group, "gt"), [*group, "gt"], "left_anti"), F.col("label"), fn=one, seen=one),
    ]
    filled = mine.select(*group).distinct().withColumn("some", F.lit(True))
    bare = subs.where(~only & (F.col("gt_n") == 0)).join(filled, group, "left")
    quiet = F.col("some").isNull()
    parts.append(events(bare, F.lit(T.BACKGROUND), tp=F.when(quiet, 1.0).otherwise(0.0),
                        fn=F.when(quiet, 0.0).otherwise(1.0)))
    lone = mine.where(only)
    fits = T.label_match(F.col("label"), F.col("only_label")) > 0
    picked = lone.groupBy(*group).agg(F.min_by(F.when(fits, F.col("label")), F.when(fits, F.col("seq"))).alias("pick"))
    verdict = subs.where(only).join(picked, group, "left")
    parts += [
        events(verdict.where(F.col("pick").isNotNull()), F.col("pick"), tp=one),
        events(verdict.where(F.col("pick").isNull()), F.col("only_label"), fn=one),
        events(lone.join(picked, group).where(F.col("label") != F.col("pick")), F.col("label"), fp=one),
    ]
    values = ["tp", "fp", "fn", "iou_sum", "iou_n", "all_iou", "all_n", "gt_seen"]
    return reduce(DataFrame.unionByName, parts).groupBy(*by, "label").agg(*[F.sum(v).alias(v) for v in values])


COUNTS = ("tp", "fp", "fn", "iou_sum", "iou_n", "all_iou", "all_n", "gt_seen")


def decayed_counts(counts: DataFrame, asof: int, decay: float = 0.95, round_col: str = "round_num") -> DataFrame:
    """Counts as of a round: each earlier round's share is multiplied by ``decay`` once per later round."""
    age = F.pow(F.lit(decay), F.lit(asof) - F.col(round_col))
    return counts.where(F.col(round_col) <= asof).groupBy("annotator_id", "label").agg(
        *[F.sum(F.col(v) * age).alias(v) for v in COUNTS])


def reliability(counts: DataFrame, by: Sequence[str] = ("annotator_id",), floor: float = 1e-4) -> DataFrame:
    """Voting weight per (annotator, label): F1 * e/(e+5) * (0.5 + 0.5 * mean IoU), at least ``floor``."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = (
        counts.withColumn("precision", F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0))
        .withColumn("recall", F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)))
    p, r = F.col("precision"), F.col("recall")
    out = out.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))
    evidence = tp + fp + fn
    label_iou = F.when(F.col("iou_n") > 0, F.col("iou_sum") / F.col("iou_n")).otherwise(0.0)
    weight = F.greatest(F.lit(floor), F.col("f1") * F.when(evidence > 0, evidence / (evidence + 5.0)).otherwise(0.0)
                        * (0.5 + 0.5 * label_iou))
    return out.select(*by, "label", "tp", "fp", "fn", "precision", "recall", "f1",
                      F.when(F.col("gt_seen") > 0, F.col("iou_n") / F.col("gt_seen")).otherwise(0.0).alias(
                          "label_accuracy"), label_iou.alias("label_iou"), weight.alias("weight"))


def localization(counts: DataFrame, by: Sequence[str] = ("annotator_id",)) -> DataFrame:
    """Mean IoU over all matches of an annotator."""
    return counts.groupBy(*by).agg((F.coalesce(F.try_divide(F.sum("all_iou"), F.sum("all_n")), F.lit(0.0))).alias(
        "localization"))


def item_net_metrics(anns: DataFrame, items: DataFrame, group: Sequence[str] = SUBMISSION) -> DataFrame:
    """Net carbon weight, coverage percent and count per submission; a reported weight of 0 or more wins."""
    sized = anns.join(items.select("item_id", F.greatest(F.lit(1), F.col("width") * F.col("height")).alias("frame")),
                      "item_id")
    area = F.when(F.col("area") > 0, F.col("area")).otherwise(G.box_area())
    mult = T.carbon_multiplier(T.canonical_label(F.col("label")))
    own = F.when(F.col("weight") >= 0, F.col("weight")).otherwise(area / F.col("frame") * mult)
    return sized.groupBy(*group).agg(
        F.bround(F.sum(own), 6).alias("net_weight"),
        F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.sum(area / F.col("frame")))) * 100, 2).alias(
            "coverage_pct"), F.count("*").alias("n_objects"))


def class_breakdown(anns: DataFrame, items: DataFrame, group: Sequence[str] = ("item_id",)) -> DataFrame:
    """Count, area share and carbon weight per carbon class, with the item's dominant class."""
    group = list(group)
    sized = anns.join(items.select("item_id", F.greatest(F.lit(1), F.col("width") * F.col("height")).alias("frame")),
                      "item_id")
    label = T.canonical_label(F.col("label"))
    share = G.box_area() / F.col("frame")
    rows = sized.select(*group, T.carbon_class(label).alias("carbon_class"), share.alias("share"),
                        F.bround(share * T.carbon_multiplier(label), 6).alias("w"))
    per = rows.groupBy(*group, "carbon_class").agg(
        F.count("*").alias("n"), F.bround(F.sum("share"), 6).alias("area_ratio"),
        F.bround(F.sum("w"), 6).alias("carbon_weight"))
    # At most one row per carbon class and item.
    top = per.groupBy(*group).agg(F.min(F.struct((-F.col("carbon_weight")).alias("n"), "carbon_class")).getField(
        "carbon_class").alias("dominant"))
    return per.join(top, group)


_SUMS = ("n", "exg", "b_r", "g_b", "vari", "luma", "luma2", "pb", "pr", "green")
# Image rows of an item that one task takes together.
_BAND = 64


def _span_ends(boxes: DataFrame, key: list[str], outline: str | None) -> DataFrame:
    """Ends of the pixel spans of every box, and of its outline, per image row.

    ``x`` is the first pixel column beyond the end, ``sign`` -1 where a span opens and 1 where it closes. An outline is filled at
    pixel centres: in every row the edges that cross its centre line open and close spans in turn, inside the box.
    """
    whole = boxes.select(*key, *[F.floor(c).cast("int").alias(n) for c, n in zip(("x1", "y1", "x2", "y2"), ("_l", "_t", "_r", "_b"))],
                         *([F.col(outline).alias("_o")] if outline else [])).where("_r > _l AND _b > _t")
    row = F.explode(F.sequence(F.col("_t"), F.col("_b") - 1)).alias("y")
    ends = F.inline(F.array(F.struct(F.col("_l").alias("x"), F.lit(-1).alias("sign")), F.struct(F.col("_r").alias("x"), F.lit(1).alias("sign"))))
    box = whole.select(*key, "_l", "_r", row).select(*key, "y", F.lit(False).alias("inner"), ends)
    if not outline:
        return box
    edges = whole.where(F.size("_o") >= 3).select(*key, "_l", "_t", "_r", "_b", F.explode(F.zip_with(
        "_o", F.concat(F.slice("_o", 2, F.size("_o")), F.slice("_o", 1, 1)), lambda p, q: F.struct(
            p["x"].alias("px"), p["y"].alias("py"), q["x"].alias("qx"), q["y"].alias("qy")))).alias("_e"))
    low, high = F.least("_e.py", "_e.qy"), F.greatest("_e.py", "_e.qy")
    first, last = F.greatest(F.ceil(low - 0.5).cast("int"), F.col("_t")), F.least(F.ceil(high - 0.5).cast("int"), F.col("_b")) - 1
    lines = edges.where(last >= first).withColumn("y", F.explode(F.sequence(first, last)))
    cross = F.expr("_e.px + (y + 0.5D - _e.py) * (_e.qx - _e.px) / (_e.qy - _e.py)")
    column = F.greatest(F.col("_l"), F.least(F.col("_r"), F.ceil(cross - 0.5).cast("int")))
    # One entry per edge that crosses the row.
    rows = lines.select(*key, "y", column.alias("x")).groupBy(*key, "y").agg(F.array_sort(F.collect_list("x")).alias("_x"))
    turns = F.inline(F.transform("_x", lambda x, i: F.struct(x.alias("x"), (i % 2 * 2 - 1).alias("sign"))))
    return box.unionByName(rows.select(*key, "y", F.lit(True).alias("inner"), turns))


def spectral_stats(pixels: DataFrame, boxes: DataFrame, key: Sequence[str] = ("item_id", "seq"),
                   coastal: bool = False, outline: str | None = None, least: int = 50) -> DataFrame:
    """Colour statistics of the pixels inside each box, the water and vegetation tests and a spectral label.

    With ``outline``, the name of a polygon column, the pixels whose centre lies inside the outline
    count where there are more than ``least`` of them (``masked``), else those of the box. ``box_pixels`` counts the box in any case.
    ``coastal`` allows the mangrove label, for verified coastal wetland only.

    Boxes and outlines become spans of image rows. Running sums along each row answer a span by the difference
    of its two ends, so no pixel meets a box: the work is pixels plus spans, spread by (item, band of rows),
    and one item may hold any number of both. A pixel travels with its colours only, the values that are
    summed are made behind the shuffle and the sort, and a box leaves a task with one row per band.
    """
    key = list(key)
    own = [k for k in key if k != "item_id"]
    r, g, b = (F.col(c).cast("double") for c in "rgb")
    # In thousandths, so that sums of byte colours are exact.
    luma = 299 * r + 587 * g + 114 * b
    values = (F.lit(1.0), 2 * g - r - b, b - r, g - b, (g - r) / (g + r - b + 1e-5), luma, luma * luma, b, r, (2 * g - r - b > -5.0).cast("double"))
    ends = _span_ends(boxes, key, outline)
    # The ends of a span at x sum the pixels before x, so they come first: pixels have no sign.
    nothing = [F.lit(None).cast(ends.schema[k].dataType).alias(f"_{k}") for k in (*own, "inner", "sign")]
    at = ends.select("item_id", F.col("y").cast("long"), F.col("x").cast("long"), *[F.col(k).alias(f"_{k}") for k in (*own, "inner", "sign")],
                     *[F.lit(None).cast(pixels.schema[c].dataType).alias(c) for c in "rgb"])
    dots = pixels.select("item_id", F.col("y").cast("long"), F.col("x").cast("long"), *nothing, *"rgb")
    spot = ["item_id", "_band", "y"]
    order = [F.col("x"), F.col("_sign").asc_nulls_last()]
    placed = dots.unionByName(at).withColumn("_band", F.floor(F.col("y") / _BAND)).repartition("item_id", "_band").sortWithinPartitions(*spot, *order)
    along = Window.partitionBy(*spot).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = ["item_id", *[f"_{k}" for k in (*own, "inner", "sign")]]
    valued = placed.select(*kept, "_band", "y", "x", *[F.when(F.col("_sign").isNull(), v).otherwise(0.0).alias(c) for v, c in zip(values, _SUMS)])
    sums = valued.select(*kept, *[F.sum(c).over(along).alias(c) for c in _SUMS]).where("_sign IS NOT NULL")
    per = sums.groupBy(*[F.col("item_id" if k == "item_id" else f"_{k}").alias(k) for k in key]).agg(*[
        F.sum(F.when(F.col("_inner") == inner, F.col("_sign") * F.col(c)).otherwise(0.0)).alias(p + c)
        for p, inner in (("", False), ("_in_", True)) for c in _SUMS])
    masked = F.col("_in_n") > least
    used = {c: F.when(masked, F.col("_in_" + c)).otherwise(F.col(c)) for c in _SUMS}
    n = used["n"]
    mean = {c: used[c] / n for c in _SUMS}
    variance = F.greatest(F.lit(0.0), mean["luma2"] - mean["luma"] * mean["luma"]) / 1e6
    stats = per.where("n > 0").select(
        *key, n.cast("long").alias("n_pixels"), F.col("n").cast("long").alias("box_pixels"), masked.alias("masked"), mean["exg"].alias("mean_exg"),
        mean["b_r"].alias("mean_b_minus_r"), mean["g_b"].alias("moisture"), mean["vari"].alias("vari"), variance.alias("luma_var"),
        mean["pb"].alias("mean_b"), mean["pr"].alias("mean_r"), mean["green"].alias("green_fraction")).join(
        boxes.select(*key, "x1", "y1", "x2", "y2"), key)
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    area, aspect = w * h, w / F.greatest(F.lit(1.0), h)
    long = F.greatest(aspect, 1.0 / F.greatest(F.lit(0.01), aspect))
    e, v = F.col("mean_exg"), F.col("luma_var")
    label = (
        F.when((area > 1100) | ((area > 450) & (e > 25.0) & (v > 200)), "dense_tree")
        .when(((long > 1.9) | (v < 100)) & (area > 100) & (e > 15.0), "field")
        .when((area < 75) | ((area < 150) & (e < 18.0)), "plant").otherwise("ordinary_tree"))
    if coastal:
        label = F.when((F.col("moisture") > 12.0) & (e > 20.0) & (area > 120) & (v > 150), "mangrove").otherwise(label)
    water = ((F.col("mean_b_minus_r") > 20.0) & (e < 0.0)) | (F.col("mean_b") > F.col("mean_r") + 30.0)
    return stats.select(*key, "n_pixels", "box_pixels", "masked", "mean_exg", "mean_b_minus_r", "moisture", "vari", "luma_var",
                        "green_fraction", water.alias("is_water"), label.alias("spectral_label"))


def water_counts(stats: DataFrame, group: Sequence[str] = SUBMISSION, least: int = 5000) -> DataFrame:
    """Per submission the annotations that stand in water, of those whose box has more than ``least`` pixels in the image."""
    wet = stats.where((F.col("box_pixels") > least) & F.col("is_water"))
    return wet.groupBy(*group).agg(F.count("*").alias("water_count"))


def item_quality(anns: DataFrame, audit: DataFrame, fidelity: DataFrame, group: Sequence[str] = SUBMISSION,
                 spectral: DataFrame | None = None) -> DataFrame:
    """Composite quality of a submission.

    (0.35 * annotator fidelity + 0.25 * area-weighted confidence + 0.25 * (0.45 *
    compactness + 0.55 * convexity) + 0.15 * spectral) * audit multiplier.
    ``spectral`` brings ``green_fraction`` per submission; without it the term is 0.90.
    """
    group = list(group)
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(
        F.coalesce("confidence", F.lit(0.0)) == 0, 0.95).otherwise(F.col("confidence"))))
    area = F.greatest(F.lit(1.0), F.when(F.coalesce("area", F.lit(0.0)) == 0, 100.0).otherwise(F.col("area")))
    conf_mean = anns.groupBy(*group).agg((F.sum(conf * area) / F.sum(area)).alias("mean_conf"))
    row = conf_mean.join(audit, group).join(fidelity.select("annotator_id", "avg_fidelity"), "annotator_id", "left")
    if spectral is None:
        row = row.withColumn("_s", F.lit(0.90))
    else:
        row = row.join(spectral, group, "left").withColumn("_s", F.coalesce(
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + 0.5 * F.col("green_fraction"))), F.lit(0.90)))
    base = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("avg_fidelity", F.lit(0.0))))
    shape = 0.45 * F.col("mean_compactness") + 0.55 * F.col("mean_convexity")
    total = (0.35 * base + 0.25 * F.col("mean_conf") + 0.25 * shape + 0.15 * F.col("_s")) * F.col("quality")
    return row.select(*group, "mean_conf", F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4).alias(
        "item_quality"))
