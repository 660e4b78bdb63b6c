"""Label and box fusion: votes, clusters, posteriors, acceptance, item assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.config import STRICT, FusionConfig
from labelloom.functions import geometry as G
from labelloom.functions import taxonomy as T
from labelloom.operators.match import anchor_assign, overlapping_objects, union_area
from labelloom.scale import ranked, split_hot
from labelloom.session import cut

ITEM = ("round_num", "item_id")
EPS = 1e-9
LOWEST = 1e-4


def class_priors(golden: DataFrame, items: DataFrame, alpha: float = 1.1) -> DataFrame:
    """Smoothed label frequencies of the golden set, the background label included."""
    boxed = golden.select(T.canonical_label(F.col("label")).alias("label"))
    only = items.where(F.col("only_label").isNotNull()).select(T.canonical_label(F.col("only_label")).alias("label"))
    counts = boxed.unionByName(only).groupBy("label").agg(F.count("*").alias("n"))
    background = golden.sparkSession.createDataFrame([(T.BACKGROUND, 0)], "label string, n bigint")
    smooth = counts.unionByName(background).groupBy("label").agg((F.sum("n") + alpha).alias("n"))
    total = smooth.agg(F.sum("n").alias("total"))
    return smooth.crossJoin(F.broadcast(total)).select("label", (F.col("n") / F.col("total")).alias("prior"))


def one_vote_per_owner(subs: DataFrame, annotators: DataFrame, scores: DataFrame,
                       item: Sequence[str] = ITEM) -> DataFrame:
    """Of an owner's annotators on an item keep the one with the best average score (ties: lowest id)."""
    known = subs.join(annotators.select("annotator_id", "owner_id"), "annotator_id", "left").join(
        scores.select("annotator_id", "avg_fidelity"), "annotator_id", "left")
    owner = F.coalesce(F.col("owner_id").cast("string"), F.concat(F.lit("id:"), F.col("annotator_id")))
    best = F.min(F.struct((-F.coalesce("avg_fidelity", F.lit(0.0))).alias("n"), "annotator_id"))
    return known.groupBy(*item, owner.alias("_owner")).agg(best.alias("b")).select(
        *item, F.col("b.annotator_id").alias("annotator_id"))


def with_weight(df: DataFrame, rel: DataFrame) -> DataFrame:
    """Attach the voting weight of (annotator, label); unknown pairs get the lowest weight."""
    return df.join(rel.select("annotator_id", "label", "weight"), ["annotator_id", "label"], "left").withColumn(
        "weight", F.greatest(F.lit(LOWEST), F.coalesce("weight", F.lit(LOWEST))))


def cluster_boxes(anns: DataFrame, rel: DataFrame, iou: float = 0.5, item: Sequence[str] = ITEM,
                  probe: DataFrame | None = None) -> DataFrame:
    """Leader clustering per item.

    Boxes by falling reliability of (annotator, label), ties by annotator and
    seq; a box joins the first cluster whose leader it overlaps by ``iou``.
    ``cluster`` is the leader's (annotator, seq) and ``pos`` orders members.
    """
    rows = with_weight(anns.withColumn("label", T.canonical_label(F.col("label"))), rel)
    order = [-F.col("weight"), F.col("annotator_id"), F.col("seq")]
    got = anchor_assign(rows, item, order, iou, probe=probe)
    return got.select(*rows.columns, F.col("_o1").alias("lead_annotator"), F.col("_o2").alias("lead_seq"),
                      (-F.col("_o0")).alias("lead_weight"))


CLUSTER = ("lead_annotator", "lead_seq")


def cluster_votes(clusters: DataFrame, item: Sequence[str] = ITEM) -> DataFrame:
    """One vote per annotator and cluster: the last of an annotator's boxes in cluster order."""
    order = F.struct("weight", (-F.col("seq")).alias("s"))
    fields = ["label", "weight", "x1", "y1", "x2", "y2", "seq"]
    last = clusters.groupBy(*item, *CLUSTER, "annotator_id").agg(
        F.min_by(F.struct(*fields), order).alias("v"), F.max("lead_weight").alias("lead_weight"))
    return last.select(*item, *CLUSTER, "annotator_id", "lead_weight", *[F.col("v." + f).alias(f) for f in fields])


def _terms(weight) -> list:
    """Per vote: weight that the other labels share, log-likelihood of a hit and of a miss.

    The miss still has to be split over K - 1 labels; a vote whose miss
    probability is below the floor keeps the floor and shares nothing.
    """
    r = F.greatest(F.lit(LOWEST), F.least(F.lit(1.0), weight))
    scale = F.greatest(F.lit(LOWEST), weight)
    hit, miss = 0.5 + 0.5 * r, 0.5 - 0.5 * r
    floored = miss < EPS
    return [F.when(floored, 0.0).otherwise(scale).alias("w"), (scale * F.log(hit)).alias("hit"),
            (scale * F.log(F.when(floored, EPS).otherwise(miss))).alias("miss")]


def fuse_labels(
    votes: DataFrame, voters: DataFrame, rel: DataFrame, priors: DataFrame, item: Sequence[str] = ITEM,
    without: str | None = None,
) -> DataFrame:
    """Posterior per cluster and label.

    log p(c) = log prior(c) + sum over annotators of the item of w * ln p(observed | c),
    p = 0.5 + 0.5 r for the observed label, (1 - that) / (K - 1) for others;
    annotators without a box in the cluster observed the background. The
    sum over non-matching votes is the same for every label, so each vote adds
    one row for its own label and its miss term to a per-cluster constant: the
    work follows the votes, not votes times labels times annotators.

    Labels that nobody voted for share one likelihood, so together they weigh the sum of their priors, and the likeliest of
    them is the one with the largest prior. ``posterior`` therefore lists the voted labels and the background only, ``rest``
    is the probability of all others (``full_posterior`` lists them), and a row is as long as its votes
    whatever the size of the vocabulary. The label with the largest prior that is not listed has the first rank
    missing among the listed ones.

    ``without='annotator_id'`` returns leave-one-out posteriors per voting annotator.
    """
    item = list(item)
    cluster = [*item, *CLUSTER]
    terms = _terms(F.col("weight"))
    # Background votes of every annotator of the item, as item sums.
    silent = with_weight(voters.select(*item, "annotator_id").withColumn("label", F.lit(T.BACKGROUND)), rel)
    bg = silent.select(*item, "annotator_id", *terms).withColumnsRenamed(
        {"w": "bg_w", "hit": "bg_hit", "miss": "bg_miss"})
    bg_item = bg.groupBy(*item).agg(
        F.sum("bg_w").alias("bg_w"), F.sum("bg_hit").alias("bg_hit"), F.sum("bg_miss").alias("bg_miss"),
        F.count("*").alias("n_voters"))
    own = votes.join(bg, [*item, "annotator_id"], "left").select(
        *cluster, "annotator_id", "label", *terms, "bg_w", "bg_hit", "bg_miss")
    per_label = own.groupBy(*cluster, "label").agg(
        F.sum("w").alias("w"), F.sum("hit").alias("hit"), F.sum("miss").alias("miss"), F.count("*").alias("n"),
        F.sum("bg_w").alias("own_bg_w"), F.sum("bg_hit").alias("own_bg_hit"), F.sum("bg_miss").alias("own_bg_miss"))
    # Labels by falling prior, ties by name; a row per label of the vocabulary.
    known = ranked(priors.select("label", F.greatest(F.lit(EPS), "prior").alias("prior")), [], [F.desc("prior"), F.col("label")], "place")
    is_bg = F.col("label") == T.BACKGROUND
    totals = known.agg(F.count("*").alias("n_known"), F.coalesce(F.sum("prior"), F.lit(0.0)).alias("sum_known"),
                       F.max(F.when(is_bg, F.col("prior"))).alias("bg_prior"), F.max(F.when(is_bg, F.col("place"))).alias("bg_place"))
    # One array entry per distinct label of the cluster.
    tally = per_label.join(known, "label", "left").groupBy(*cluster).agg(
        F.collect_list(F.struct("label", "w", "hit", "miss", "n", F.coalesce("prior", F.lit(EPS)).alias("prior"), "place")).alias("tally"),
        F.sum("own_bg_w").alias("own_bg_w"), F.sum("own_bg_hit").alias("own_bg_hit"),
        F.sum("own_bg_miss").alias("own_bg_miss")).join(bg_item, item)
    # A single row.
    base = tally.crossJoin(F.broadcast(totals))
    zero = F.lit(0.0)
    if without:
        base = base.join(own.select(*cluster, "annotator_id", F.col("label").alias("out_label"), F.col("w").alias(
            "out_w"), F.col("hit").alias("out_hit"), F.col("miss").alias("out_miss")), cluster)
    silent_bg = F.struct(F.lit(T.BACKGROUND).alias("label"), zero.alias("w"), zero.alias("hit"), zero.alias("miss"), F.lit(0).cast("long").alias("n"),
                         F.coalesce("bg_prior", F.lit(EPS)).alias("prior"), F.col("bg_place").alias("place"))
    listed = F.when(F.exists("tally", lambda v: v["label"] == T.BACKGROUND), F.col("tally")).otherwise(F.concat("tally", F.array(silent_bg)))
    quiet_w = F.col("bg_w") - F.col("own_bg_w")
    quiet_hit, quiet_miss = F.col("bg_hit") - F.col("own_bg_hit"), F.col("bg_miss") - F.col("own_bg_miss")
    all_w = F.aggregate("tally", zero, lambda a, v: a + v["w"]) + quiet_w
    all_miss = F.aggregate("tally", zero, lambda a, v: a + v["miss"]) + quiet_miss
    if without:
        all_w, all_miss = all_w - F.col("out_w"), all_miss - F.col("out_miss")
    places = F.filter(F.transform(F.col("entries"), lambda v: v["place"]), lambda r: r.isNotNull())
    first_gap = F.aggregate(F.array_sort(F.col("places")), F.lit(1).cast("long"), lambda at, r: F.when(r == at, at + 1).otherwise(at))
    base = base.withColumn("entries", listed).withColumn("places", places).select(
        *cluster, *([without, "out_label", "out_w", "out_hit", "out_miss"] if without else []), "tally", "entries", "n_voters",
        quiet_w.alias("quiet_w"), quiet_hit.alias("quiet_hit"), quiet_miss.alias("quiet_miss"), all_w.alias("all_w"), all_miss.alias("all_miss"),
        (F.col("n_known") + F.size("entries") - F.size("places")).alias("n_labels"), (F.col("n_known") - F.size("places")).alias("n_rest"),
        (F.col("sum_known") - F.aggregate("entries", zero, lambda a, v: a + F.when(v["place"].isNotNull(), v["prior"]).otherwise(zero))).alias("rest_prior"),
        first_gap.alias("_gap"))
    spread_of = F.log(F.greatest(F.lit(1), F.col("n_labels") - 1).cast("double"))

    def logit(v):
        back = v["label"] == T.BACKGROUND
        hit_w = v["w"] + F.when(back, F.col("quiet_w")).otherwise(zero)
        gain = v["hit"] - v["miss"] + F.when(back, F.col("quiet_hit") - F.col("quiet_miss")).otherwise(zero)
        if without:
            out = F.col("out_label") == v["label"]
            hit_w = hit_w - F.when(out, F.col("out_w")).otherwise(zero)
            gain = gain - F.when(out, F.col("out_hit") - F.col("out_miss")).otherwise(zero)
        return F.log(F.greatest(F.lit(EPS), v["prior"])) + F.col("all_miss") + gain - (F.col("all_w") - hit_w) * spread_of

    unheard = known.select(F.col("label").alias("_rest_label"), F.col("prior").alias("_rest_top"), F.col("place").alias("_gap"))
    scored = base.join(unheard, "_gap", "left").withColumn("logits", F.transform(F.array_sort("entries"), lambda v: F.struct(
        v["label"].alias("label"), logit(v).alias("logit"))))
    scored = scored.withColumn("_shared", F.when(F.col("n_rest") > 0, F.col("all_miss") - F.col("all_w") * spread_of))
    scored = scored.withColumn("_top", F.greatest(
        F.array_max(F.transform("logits", lambda e: e["logit"])), F.col("_shared") + F.log("_rest_top")))
    scored = scored.withColumn("_exp", F.transform("logits", lambda e: F.struct(
        e["label"].alias("label"), F.exp(e["logit"] - F.col("_top")).alias("p"))))
    scored = scored.withColumn("_each", F.coalesce(F.exp(F.col("_shared") - F.col("_top")), zero))
    total = F.aggregate("_exp", zero, lambda a, e: a + e["p"]) + F.col("_each") * F.greatest(zero, "rest_prior")
    scored = scored.withColumn("_sum", total).withColumn("posterior", F.transform("_exp", lambda e: F.struct(
        e["label"].alias("label"), (e["p"] / F.col("_sum")).alias("p"))))
    scored = scored.withColumn("rest", F.col("_each") * F.greatest(zero, "rest_prior") / F.col("_sum"))
    # Probabilities equal to nine digits are a tie: the smallest label wins.
    runner = F.struct(F.col("_rest_label").alias("label"), (F.col("_each") * F.col("_rest_top") / F.col("_sum")).alias("p"))
    rivals = F.when(F.col("n_rest") > 0, F.concat("posterior", F.array(runner))).otherwise(F.col("posterior"))
    best = F.array_min(F.transform(rivals, lambda e: F.struct(
        (-F.round(e["p"], 9)).alias("n"), e["label"].alias("label"), e["p"].alias("p"))))
    return scored.select(*cluster, *([without] if without else []), "n_voters", "posterior", "tally", "rest", "rest_prior",
                         best["label"].alias("label"), best["p"].alias("confidence"))


def full_posterior(fused: DataFrame, priors: DataFrame, item: Sequence[str] = ITEM) -> DataFrame:
    """A row per cluster and label of the vocabulary or the votes, (cluster, label, p): as many rows as clusters times labels."""
    cluster = [*item, *CLUSTER]
    listed = fused.select(*cluster, F.inline("posterior"))
    named = F.transform("posterior", lambda e: e["label"])
    others = fused.withColumn("_named", named).crossJoin(priors.select("label", F.greatest(F.lit(EPS), "prior").alias("_prior")).withColumnRenamed("label", "_label")).where(
        ~F.array_contains("_named", F.col("_label")))
    return listed.unionByName(others.select(*cluster, F.col("_label").alias("label"), (F.col("rest") * F.col("_prior") / F.col("rest_prior")).alias("p")))


def fuse_boxes(votes: DataFrame, item: Sequence[str] = ITEM) -> DataFrame:
    """Weighted mean box, upper-median box and mean IoU to the median per cluster.

    The median of each side comes from value counts: equal coordinates collapse
    before the shuffle, and the running count runs over distinct values only.
    """
    cluster = [*item, *CLUSTER]
    w = F.greatest(F.lit(LOWEST), F.col("weight"))
    sides = ("x1", "y1", "x2", "y2")
    cold, hot = split_hot(votes, cluster)
    mean = votes.groupBy(*cluster).agg(
        F.count("*").alias("votes"), *[(F.sum(w * F.col(c)) / F.sum(w)).alias("f_" + c) for c in sides])

    def upper(df: DataFrame) -> DataFrame:
        listed = df.groupBy(*cluster).agg(*[F.array_sort(F.collect_list(c)).alias("l_" + c) for c in sides])
        mid = F.floor(F.size("l_x1") / 2).cast("int")
        return listed.select(*cluster, *[F.get("l_" + c, mid).alias("m_" + c) for c in sides])

    median = upper(cold)
    if hot is not None:
        # percentile keeps counts per distinct value, merged across tasks; the upper median is the
        # value at rank floor(n/2), asked for by its exact fraction.
        n = hot.groupBy(*cluster).agg(F.count("*").alias("n"))
        tall = hot.select(*cluster, F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("v"))
                                                        for c in sides])).alias("e"))
        counts = tall.groupBy(*cluster, F.col("e.side").alias("side"), F.col("e.v").alias("v")).agg(
            F.count("*").alias("k"))
        listed = counts.groupBy(*cluster, "side").agg(F.array_sort(F.collect_list(F.struct("v", "k"))).alias("l"))
        pick = F.expr("""aggregate(l, named_struct('c', 0L, 'v', CAST(NULL AS DOUBLE)), (a, e) ->
            IF(a.v IS NULL AND a.c + e.k > n DIV 2, named_struct('c', a.c + e.k, 'v', e.v),
               named_struct('c', a.c + e.k, 'v', a.v)), a -> a.v)""")
        sides_hot = listed.join(n, cluster).withColumn("m", pick)
        median = median.unionByName(sides_hot.groupBy(*cluster).agg(
            *[F.max(F.when(F.col("side") == c, F.col("m"))).alias("m_" + c) for c in sides]))
    boxes = mean.join(median, cluster)
    value = G.iou_of(*[F.col(c) for c in sides], *[F.col("m_" + c) for c in sides])
    spread = votes.join(boxes, cluster).groupBy(*cluster).agg(F.avg(value).alias("mean_iou"))
    return boxes.join(spread, cluster)


def gate_objects(fused: DataFrame, boxes: DataFrame, items: DataFrame, cfg: FusionConfig = STRICT,
                 item: Sequence[str] = ITEM) -> DataFrame:
    """First failed acceptance test of each object, or null when it is accepted."""
    cluster = [*item, *CLUSTER]
    support = F.coalesce(F.get(F.filter("tally", lambda v: v["label"] == F.col("label")), 0)["n"], F.lit(0))
    row = fused.withColumn("support", support).join(boxes, cluster).join(
        items.select("item_id", F.greatest(F.lit(1), F.col("width") * F.col("height")).alias("frame")), "item_id")
    size = F.greatest(F.lit(0.0), F.col("f_x2") - F.col("f_x1")) * F.greatest(F.lit(0.0), F.col("f_y2") - F.col("f_y1"))
    # Fixed wording of the reasons, in test order.
    reason = (
        F.when(F.col("support") < cfg.min_object_votes, "insufficient_object_votes")
        .when(F.col("support") / F.greatest(F.lit(1), F.col("n_voters")) < cfg.min_support_ratio,
              "insufficient_object_support_ratio")
        .when(F.col("confidence") < cfg.accept_confidence, "low_class_confidence")
        .when(F.col("n_voters") < cfg.min_voters, "insufficient_miners_on_image")
        .when(F.col("mean_iou") < cfg.min_mean_iou, "high_spatial_disagreement")
        .when(size / F.col("frame") >= cfg.max_box_ratio, "large_box_requires_review"))
    return row.withColumn("reason", reason)


def contributions(votes: DataFrame, objects: DataFrame, rel: DataFrame, item: Sequence[str] = ITEM) -> DataFrame:
    """Credit per (item, annotator): supporters' weights normalised per accepted object, then per item."""
    cluster = [*item, *CLUSTER]
    accepted = objects.where(F.col("reason").isNull()).select(*cluster, "label")
    backing = with_weight(votes.select(*cluster, "annotator_id", "label").join(accepted, [*cluster, "label"]), rel)
    total = backing.groupBy(*cluster).agg(F.sum("weight").alias("t"))
    per = backing.join(total, cluster).groupBy(*item, "annotator_id").agg(F.sum(F.col("weight") / F.col("t")).alias("c"))
    whole = per.groupBy(*item).agg(F.sum("c").alias("s"))
    return per.join(whole, list(item)).select(*item, "annotator_id", (F.col("c") / F.col("s")).alias("contribution"))


def fuse(
    anns: DataFrame, rel: DataFrame, priors: DataFrame, items: DataFrame, annotators: DataFrame, scores: DataFrame,
    cfg: FusionConfig = STRICT, item: Sequence[str] = ITEM, probe: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Everything between raw public annotations and item results.

    ``probe``: a cheap frame with at least the rows of ``anns``, used to count
    group sizes. The kept votes are checkpointed once, because clusters,
    posteriors and boxes all read them.
    """
    voters = cut(one_vote_per_owner(anns.select(*item, "annotator_id").distinct(), annotators, scores, item))
    kept = anns.join(voters, [*item, "annotator_id"], "left_semi")
    crowd = voters.groupBy(*item).agg(F.count("*").alias("n"))
    enough = crowd.where((F.col("n") >= 2) & (F.col("n") >= cfg.min_voters)).select(*item)
    votes = cut(cluster_votes(cluster_boxes(
        kept.join(enough, list(item), "left_semi"), rel, cfg.cluster_iou, item, probe), item))
    posterior = fuse_labels(votes, voters, rel, priors, item)
    objects = gate_objects(posterior, fuse_boxes(votes, item), items, cfg, item)
    return {"voters": voters, "kept": kept, "crowd": crowd, "votes": votes, "objects": cut(objects)}


def assemble_items(parts: dict[str, DataFrame], rel: DataFrame, scores: DataFrame, items: DataFrame,
                   cfg: FusionConfig = STRICT, item: Sequence[str] = ITEM) -> DataFrame:
    """One row per item: accepted or escalated, with score, chosen annotator, reasons and metrics.

    Any escalated or overlapping object escalates its item. With the fallback on,
    an item without consensus adopts the best single annotator above the minimum reliability.
    """
    item = list(item)
    objects, votes, crowd = parts["objects"], parts["votes"], parts["crowd"]
    keyed = objects.withColumn("cluster_id", F.concat_ws(":", *[F.col(c).cast("string") for c in CLUSTER]))
    # Overlap is tested among objects that were accepted and are not background.
    live = keyed.where(F.col("reason").isNull() & F.col("label").isNotNull()).select(
        *item, "cluster_id", *[F.col("f_" + c).alias(c) for c in ("x1", "y1", "x2", "y2")])
    touching = overlapping_objects(live, "cluster_id", item).withColumn("touches", F.lit(True))
    marked = keyed.join(touching, [*item, "cluster_id"], "left")
    reason = F.coalesce("reason", F.when(F.col("touches"), "overlapping_object_clusters_requires_review"))
    per_item = marked.groupBy(*item).agg(
        F.array_join(F.array_sort(F.collect_set(reason)), ";").alias("reasons"), F.count("*").alias("objects"),
        F.avg("confidence").alias("mean_confidence"))
    credit = contributions(votes, objects, rel, item)
    top = credit.groupBy(*item).agg(
        F.min(F.struct((-F.col("contribution")).alias("n"), "annotator_id")).getField("annotator_id").alias("leader"))
    sole = parts["voters"].groupBy(*item).agg(F.min("annotator_id").alias("first_annotator"))
    row = crowd.join(per_item, item, "left").join(top, item, "left").join(sole, item)
    few = (F.col("n") < 2) | (F.col("n") < cfg.min_voters)
    why = (
        F.when(F.col("n") < 2, "only_one_miner").when(few, "insufficient_miners_on_image")
        .when(F.col("objects").isNull(), "no_clusters").when(F.col("reasons") != "", F.col("reasons")))
    out = row.select(
        *item, F.col("n").alias("voters"), F.coalesce("objects", F.lit(0)).alias("objects"),
        F.when(few, F.col("first_annotator")).otherwise(F.coalesce("leader", F.lit(-1))).alias("chosen"),
        why.alias("reason"), F.when(why.isNull(), F.col("mean_confidence")).otherwise(0.0).alias("score"),
        F.lit("bayesian_dawid_skene_v1").alias("method"))
    if cfg.fallback:
        out = _with_fallback(out, parts, scores, cfg, item)
    area = accepted_metrics(parts, touching, items, item)
    return out.join(area, item, "left").withColumn(
        "coverage_pct", F.when(F.col("reason").isNull() & (F.col("method") == "bayesian_dawid_skene_v1"),
                               F.coalesce("coverage_pct", F.lit(0.0))).otherwise(F.lit(None))).withColumn(
        "escalated", F.col("reason").isNotNull())


def _with_fallback(out: DataFrame, parts: dict[str, DataFrame], scores: DataFrame, cfg: FusionConfig, item: list[str]):
    adopted = fallback_top_annotator(parts["kept"], scores, cfg, item)
    row = out.join(adopted, item, "left")
    use = F.col("reason").isNotNull() & F.col("fallback_annotator").isNotNull()
    return row.select(
        *item, "voters", F.when(use, F.col("fallback_objects")).otherwise(F.col("objects")).alias("objects"),
        F.when(use, F.col("fallback_annotator")).otherwise(F.col("chosen")).alias("chosen"),
        F.when(use, F.lit(None)).otherwise(F.col("reason")).alias("reason"),
        F.when(use, F.col("reliability")).otherwise(F.col("score")).alias("score"),
        F.when(use, "single_miner_fallback_v1").otherwise(F.col("method")).alias("method"))


def fallback_top_annotator(kept: DataFrame, scores: DataFrame, cfg: FusionConfig = STRICT,
                           item: Sequence[str] = ITEM) -> DataFrame:
    """Best annotator of each item by average score (ties: lowest id) when it reaches the minimum reliability."""
    per = kept.groupBy(*item, "annotator_id").agg(F.count("*").alias("n")).join(
        scores.select("annotator_id", "avg_fidelity"), "annotator_id", "left")
    best = per.groupBy(*item).agg(F.min(F.struct(
        (-F.coalesce("avg_fidelity", F.lit(0.0))).alias("n"), "annotator_id", F.col("n").alias("k"))).alias("b"))
    return best.where(-F.col("b.n") >= cfg.fallback_min_reliability).select(
        *item, F.col("b.annotator_id").alias("fallback_annotator"), (-F.col("b.n")).alias("reliability"),
        F.col("b.k").alias("fallback_objects"))


def accepted_metrics(parts: dict[str, DataFrame], touching: DataFrame, items: DataFrame, item: list[str]) -> DataFrame:
    """Union coverage, carbon weight and count of the accepted non-background objects of each item."""
    good = parts["objects"].where(F.col("reason").isNull() & (F.col("label") != T.BACKGROUND)).withColumn(
        "cluster_id", F.concat_ws(":", *[F.col(c).cast("string") for c in CLUSTER])).join(
        touching, [*item, "cluster_id"], "left_anti")
    boxes = good.select(*item, "label", "frame", *[F.col("f_" + c).alias(c) for c in ("x1", "y1", "x2", "y2")])
    weight = F.bround(G.box_area(), 2) / F.col("frame") * T.carbon_multiplier(F.col("label"))
    sums = boxes.groupBy(*item).agg(
        F.bround(F.sum(weight), 6).alias("net_weight"), F.count("*").alias("object_count"),
        F.max("frame").alias("frame"))
    covered = union_area(boxes, item)
    ratio = F.least(F.lit(1.0), F.col("union_area") / F.col("frame"))
    return sums.join(covered, item).select(*item, "net_weight", "object_count", F.bround(ratio * 100, 2).alias(
        "coverage_pct"))


def golden_winners(scores: DataFrame, item: Sequence[str] = ITEM) -> DataFrame:
    """Best annotator of each golden item by fidelity (ties: lowest id)."""
    best = F.min(F.struct((-F.col("fidelity")).alias("n"), "annotator_id"))
    return scores.groupBy(*item).agg(best.alias("b")).select(
        *item, F.col("b.annotator_id").alias("annotator_id"), F.greatest(F.lit(0.0), -F.col("b.n")).alias("score"))
