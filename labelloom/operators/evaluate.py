"""Release evaluation, run health, leaderboards, budgets, diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelloom.functions import geometry as G
from labelloom.functions.text import diagnosis
from labelloom.operators.match import best_match, greedy_match
from labelloom.operators.score import outline_quality
from labelloom.scale import exact_quantile, ranked

PLAIN = lambda c: F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("_"))


def micro_prf(pred: DataFrame, truth: DataFrame, group: Sequence[str] = ("item_id",), min_iou: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and mean IoU over all boxes; matches need the same label."""
    p = pred.withColumn("label", PLAIN(F.col("label")))
    t = truth.withColumn("label", PLAIN(F.col("label")))
    hits = greedy_match(t, p, group, group, min_iou, drive="pred", same_label=True).agg(
        F.count("*").alias("tp"), F.avg("iou").alias("mean_iou"))
    sizes = p.agg(F.count("*").alias("predicted")).crossJoin(t.agg(F.count("*").alias("truth")))
    row = hits.crossJoin(sizes)
    pr = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rc = F.when(F.col("truth") > 0, F.col("tp") / F.col("truth")).otherwise(0.0)
    row = row.withColumn("precision", pr).withColumn("recall", rc)
    total = F.col("precision") + F.col("recall")
    return row.select("tp", (F.col("predicted") - F.col("tp")).alias("fp"), (F.col("truth") - F.col("tp")).alias("fn"),
                      "precision", "recall", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(
                          0.0).alias("f1"), F.coalesce("mean_iou", F.lit(0.0)).alias("mean_iou"))


def class_prf(pred: DataFrame, truth: DataFrame, group: Sequence[str] = ("item_id",), min_iou: float = 0.5) -> DataFrame:
    """Counts and F1 per label; boxes match first and labels are compared afterwards."""
    p = pred.withColumn("label", PLAIN(F.col("label")))
    t = truth.withColumn("label", PLAIN(F.col("label")))
    m = greedy_match(t, p, group, group, min_iou, drive="pred")
    seen = p.select(*group, "seq", "label").join(m.select(*group, "seq", "gt"), [*group, "seq"], "left").join(
        t.select(*group, "gt", F.col("label").alias("gt_label")), [*group, "gt"], "left")
    right = F.col("label") == F.coalesce("gt_label", F.lit(""))
    hits = seen.select("label", right.cast("int").alias("tp"), (~right).cast("int").alias("fp"), F.lit(0).alias("fn"))
    wrong = seen.where(F.col("gt_label").isNotNull() & ~right).select(
        F.col("gt_label").alias("label"), F.lit(0).alias("tp"), F.lit(0).alias("fp"), F.lit(1).alias("fn"))
    missed = t.join(m.select(*group, "gt"), [*group, "gt"], "left_anti").select(
        "label", F.lit(0).alias("tp"), F.lit(0).alias("fp"), F.lit(1).alias("fn"))
    per = hits.unionByName(wrong).unionByName(missed).groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    denom = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return per.withColumn("f1", F.when(denom > 0, 2 * F.col("tp") / denom).otherwise(0.0))


def holdout_verdict(per_class: DataFrame, min_accuracy: float = 0.90, min_f1: float = 0.85) -> DataFrame:
    """Exact-label accuracy over all predictions, lowest label F1 and the gate result."""
    row = per_class.agg(F.sum("tp").alias("_tp"), F.sum(F.col("tp") + F.col("fp")).alias("pairs"), F.min("f1").alias("min_f1"))
    acc = F.when(F.col("pairs") > 0, F.col("_tp") / F.col("pairs")).otherwise(0.0)
    return row.select("pairs", acc.alias("accuracy"), F.coalesce("min_f1", F.lit(0.0)).alias("min_f1")).withColumn(
        "passed", (F.col("accuracy") >= min_accuracy) & (F.col("min_f1") >= min_f1))


def calibration(pred: DataFrame, truth: DataFrame, key: Sequence[str], item: Sequence[str] = ("item_id",),
                min_iou: float = 0.5, min_samples: int = 100, max_gap: float = 0.05) -> DataFrame:
    """Mean reported confidence against label accuracy over predictions that overlap a truth box."""
    t = truth.withColumn("label", PLAIN(F.col("label")))
    near = best_match(pred, t, key, item, min_iou)
    row = pred.withColumn("label", PLAIN(F.col("label"))).join(near, list(key)).agg(
        F.count("*").alias("n"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"),
        F.coalesce(F.avg((F.col("label") == F.col("gt_label")).cast("double")), F.lit(0.0)).alias("accuracy"))
    return row.withColumn("gap", F.abs(F.col("mean_confidence") - F.col("accuracy"))).withColumn(
        "passed", (F.col("n") >= min_samples) & (F.col("gap") <= max_gap))


def pair_rounds(events: DataFrame) -> DataFrame:
    """Durations of rounds: every done event with the last start of its step; negative ones dropped."""
    starts = events.where("event = 'round_start'").groupBy("step").agg(F.max("time").alias("started"))
    done = events.where("event = 'round_done'").select("step", F.col("time").alias("finished"))
    seconds = F.timestamp_diff("MICROSECOND", F.col("started"), F.col("finished")) / 1e6
    return done.join(starts, "step").withColumn("seconds", seconds).where(F.col("seconds") >= 0)


def round_metrics(events: DataFrame) -> DataFrame:
    """One row of run metrics from parsed log events."""
    def n(name: str):
        return F.count_if(F.col("event") == name)

    totals = F.when(F.col("event") == "round_done", F.col("reward_total"))
    base = events.agg(
        n("round_start").alias("round_starts"), n("round_done").alias("round_dones"), n("invalid_response").alias("invalid"),
        n("no_valid").alias("no_valid"), F.coalesce(F.sum("participants"), F.lit(0)).alias("invocations"),
        F.coalesce(F.max("images"), F.lit(0)).alias("max_images"), F.count(totals).alias("totals"),
        F.coalesce(F.stddev_samp(totals), F.lit(0.0)).alias("_sd"), F.coalesce(F.avg(totals), F.lit(0.0)).alias("_mean"),
        n("set_weights_ok").alias("set_weights_ok"), n("set_weights_skip").alias("set_weights_skip"),
        n("connector_error").alias("connector_errors"), n("timeout_error").alias("timeout_errors"))
    pairs = pair_rounds(events)
    times = pairs.agg(F.count("*").alias("durations"), F.avg("seconds").alias("avg_seconds"))
    slow = exact_quantile(pairs, "seconds", F.lit(0.95)).agg(F.max("quantile").alias("p95_seconds"))
    # Single rows on both sides.
    row = base.crossJoin(F.broadcast(times)).crossJoin(F.broadcast(slow))
    ratio = lambda a, b: F.when(F.col(b) > 0, 100.0 * F.col(a) / F.col(b)).otherwise(0.0)
    cv = F.when(F.col("totals") < 2, 0.0).when(F.col("_mean") <= 1e-12, float("inf")).otherwise(F.col("_sd") / F.col("_mean"))
    return row.withColumn("success_pct", ratio("round_dones", "round_starts")).withColumn(
        "invalid_pct", ratio("invalid", "invocations")).withColumn("reward_cv", cv).drop("_sd", "_mean")


# Default gate limits.
GATES = {"min_success_pct": 70.0, "max_invalid_pct": 15.0, "min_invocations": 1, "max_avg_seconds": 1200.0,
         "max_p95_seconds": 1800.0, "min_images": 1, "max_reward_cv": 0.85, "require_set_weights": False,
         "allow_skip": True, "zero_transport_errors": True, "allow_no_rounds": False}


def evaluate_gates(metrics: DataFrame, **limits) -> DataFrame:
    """One row per gate: name, passed, value, threshold."""
    g = {**GATES, **limits}
    c = F.col
    active = (c("round_starts") > 0) | (c("round_dones") > 0)
    skip = F.lit(g["allow_no_rounds"]) & ~active
    slow = (F.coalesce("avg_seconds", F.lit(0.0)) > g["max_avg_seconds"]) | (
        F.coalesce("p95_seconds", F.lit(0.0)) > g["max_p95_seconds"])
    rows = [
        ("dual_flywheel_log_coverage", active | F.lit(g["allow_no_rounds"]), c("round_starts"), ">=1 start or done"),
        ("round_success_pct", F.when(c("round_starts") > 0, c("success_pct") >= g["min_success_pct"]).otherwise(skip),
         c("success_pct"), f">= {g['min_success_pct']}"),
        ("invalid_response_pct", (c("invocations") < g["min_invocations"]) | (c("invalid_pct") <= g["max_invalid_pct"]),
         c("invalid_pct"), f"<= {g['max_invalid_pct']}"),
        ("round_latency", skip | ~slow, c("avg_seconds"), f"avg<={g['max_avg_seconds']}s p95<={g['max_p95_seconds']}s"),
        ("assembly_yield", F.when(c("round_dones") > 0, c("max_images") >= g["min_images"]).otherwise(skip), c("max_images"),
         f">= {g['min_images']}"),
        ("reward_stability_cv", skip | (c("totals") < 2) | (c("reward_cv") <= g["max_reward_cv"]), c("reward_cv"),
         f"<= {g['max_reward_cv']}"),
        ("set_weights_on_chain", F.lit(not g["require_set_weights"]) | (c("set_weights_ok") > 0), c("set_weights_ok"),
         ">= 1 success" if g["require_set_weights"] else "not required"),
        ("no_local_set_weights_skip", F.when(F.lit(g["allow_skip"]) | (c("set_weights_skip") == 0), F.lit(None)).otherwise(False),
         c("set_weights_skip"), "0 skip events"),
        ("transport_health", F.lit(not g["zero_transport_errors"]) | (c("connector_errors") + c("timeout_errors") == 0),
         c("connector_errors") + c("timeout_errors"), "0 / 0" if g["zero_transport_errors"] else "not enforced"),
    ]
    listed = F.array(*[F.struct(F.lit(n).alias("gate"), p.alias("passed"), v.cast("double").alias("value"), F.lit(t).alias(
        "threshold")) for n, p, v, t in rows])
    return metrics.select(F.inline(listed)).where(F.col("passed").isNotNull())


def leaderboard(scores: DataFrame, by: Sequence[str] = ("round",), key: str = "annotator_id", value: str = "score") -> DataFrame:
    """Rank, percentile, gap to the leader and change since the key's previous round (first: 0)."""
    by = list(by)
    stats = scores.groupBy(*by).agg(F.count("*").alias("_n"), F.max(value).alias("_top"))
    row = ranked(scores, by, [F.desc(value), F.col(key)], "rank").join(stats, by)
    # One row per round and key after aggregation, so a key's history is as long as the calendar.
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*by))
    return row.withColumn("_before", before).select(
        *by, key, value, "rank", F.bround((F.col("_n") - F.col("rank") + 1) / F.col("_n") * 100.0, 1).alias("percentile"),
        F.bround(F.col("_top") - F.col(value), 4).alias("gap"),
        F.bround(F.col(value) - F.coalesce("_before", F.col(value)), 4).alias("delta"))


def pick_representatives(scores: DataFrame, by: Sequence[str] = ("annotator_id",), key: str = "item_id",
                         value: str = "fidelity") -> DataFrame:
    """The two lowest and the median row of each group; groups up to three rows whole."""
    by = list(by)
    n = scores.groupBy(*by).agg(F.count("*").alias("_n"))
    row = ranked(scores, by, [F.col(value), F.col(key)], "_r").join(n, by)
    keep = (F.col("_n") <= 3) | (F.col("_r") <= 2) | (F.col("_r") == F.floor(F.col("_n") / 2) + 1)
    return row.where(keep).select(*by, key, value, F.col("_r").alias("position"))


def consecutive_drops(scores: DataFrame, key: str = "annotator_id", order: str = "round", value: str = "score") -> DataFrame:
    """Rounds whose score fell twice in a row, with the round to go back to."""
    w = Window.partitionBy(key).orderBy(order)
    row = scores.select(key, order, value, F.lag(value, 1).over(w).alias("_b"), F.lag(value, 2).over(w).alias("_c"),
                        F.lag(order, 2).over(w).alias("rollback_to"))
    return row.where((F.col(value) < F.col("_b")) & (F.col("_b") < F.col("_c"))).select(key, order, value, "rollback_to")


def classify_outcomes(scores: DataFrame, key: str = "annotator_id", order: str = "round", value: str = "score") -> DataFrame:
    """Improved, regressed or stagnant against the previous round."""
    w = Window.partitionBy(key).orderBy(order)
    delta = F.col(value) - F.lag(value).over(w)
    return scores.withColumn("delta", delta).withColumn("outcome", F.when(F.col("delta") >= 0.01, "IMPROVED").when(
        F.col("delta") < -0.005, "REGRESSED").when(F.col("delta").isNotNull(), "STAGNANT"))


def next_untried(tries: DataFrame, options: Sequence[str], key: str = "annotator_id", option: str = "option") -> DataFrame:
    """First listed option a key has not tried yet, null when all were."""
    seen = tries.groupBy(key).agg(F.collect_set(F.when(F.col(option).isin(list(options)), F.col(option))).alias("_t"))
    return seen.select(key, F.get(F.array_except(F.array(*[F.lit(o) for o in options]), "_t"), 0).alias("next_option"))


def geometry_metrics(anns: DataFrame, golden: DataFrame, items: DataFrame, group: Sequence[str] = ("round_num", "item_id",
                     "annotator_id"), by: Sequence[str] = ("annotator_id",)) -> DataFrame:
    """Diagnostic rates per annotator over its golden submissions, with the rule-based feedback sentence."""
    group, by = list(group), list(by)
    scored = items.where("role = 'golden'").select("item_id", F.greatest(F.lit(1), F.col("width") * F.col("height")).alias("frame"))
    mine = anns.join(scored, "item_id")
    m = greedy_match(golden, mine, group, min_iou=0.30, probe=anns).groupBy(*by).agg(
        F.count("*").alias("matched"), F.sum("iou").alias("iou_sum"))
    outlined = outline_quality(mine).withColumn("_p", F.when(F.size("polygon") >= 3, F.size("polygon")))
    per = outlined.groupBy(*by).agg(
        F.count("*").alias("detections"), F.coalesce(F.avg("_p"), F.lit(4.0)).alias("mean_vertices"),
        F.avg(F.col("is_box").cast("double")).alias("box_ratio"),
        F.avg((G.box_area() / F.col("frame") >= 0.5).cast("double")).alias("oversized_ratio"))
    truth_n = golden.groupBy("item_id").agg(F.count("*").alias("k"))
    truth = mine.select(*group).distinct().join(truth_n, "item_id").groupBy(*by).agg(F.sum("k").alias("truth"))
    row = per.join(truth, by, "left").join(m, by, "left").fillna({"truth": 0, "matched": 0, "iou_sum": 0.0})
    t = F.greatest(F.lit(1), F.col("truth"))
    out = row.select(
        *by, F.bround(F.col("iou_sum") / t, 4).alias("mean_iou"),
        F.bround((F.col("truth") - F.col("matched")) / t, 4).alias("miss_rate"),
        F.bround((F.col("detections") - F.col("matched")) / F.col("detections"), 4).alias("false_rate"),
        F.bround("mean_vertices", 1).alias("mean_vertices"), F.bround("box_ratio", 4).alias("box_ratio"),
        F.bround("oversized_ratio", 4).alias("oversized_ratio"))
    return out.withColumn("feedback", diagnosis(F.col("miss_rate"), F.col("box_ratio"), F.col("false_rate")))


def class_skew(anns: DataFrame, by: Sequence[str] = ("annotator_id",)) -> DataFrame:
    """Detections per annotator and plain label."""
    return anns.groupBy(*by, F.lower(F.trim("label")).alias("label")).agg(F.count("*").alias("n"))


def budget_ledger(calls: DataFrame, max_calls: int, price_per_million: float = 0.15) -> DataFrame:
    """Calls, tokens, breaker state and cost per day and role."""
    per = calls.groupBy(F.to_date("ts").alias("day"), "role").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))
    return per.withColumn("breaker_tripped", F.col("calls") >= max_calls).withColumn(
        "refused", F.greatest(F.lit(0), F.col("calls") - max_calls)).withColumn(
        "cost", F.col("tokens") / 1e6 * price_per_million)


def project_cost(calls: DataFrame, rounds: int, horizon_rounds: int = 2016, price_per_million: float = 0.15) -> DataFrame:
    """Total tokens, their cost and both projected over seven days of rounds."""
    total = calls.agg(F.sum("tokens").alias("tokens"))
    ahead = F.col("tokens") / float(rounds) * horizon_rounds
    return total.select("tokens", (F.col("tokens") / 1e6 * price_per_million).alias("cost"), ahead.alias("projected_tokens"),
                        (ahead / 1e6 * price_per_million).alias("projected_cost"))


def rank_trials(items: DataFrame, trial: str = "trial", detections: str = "detections") -> DataFrame:
    """Trial score 0.6 * coverage + 0.4 * min(1, mean detections / 5) and the best trial (ties: lowest)."""
    per = items.groupBy(trial).agg(F.avg((F.col(detections) > 0).cast("double")).alias("coverage"),
                                   F.avg(detections).alias("mean_detections"))
    scored = per.withColumn("score", 0.6 * F.col("coverage") + 0.4 * F.least(F.lit(1.0), F.col("mean_detections") / 5.0))
    best = scored.agg(F.min(F.struct((-F.round("score", 12)).alias("n"), trial)).getField(trial).alias("_best"))
    return scored.crossJoin(F.broadcast(best)).withColumn("is_best", F.col(trial) == F.col("_best")).drop("_best")


def redundant_attempts(tries: DataFrame, key: str = "annotator_id", option: str = "option") -> DataFrame:
    """Attempts that repeated an earlier option."""
    per = tries.where(F.col(option).isNotNull()).groupBy(key, option).agg(F.count("*").alias("k"))
    return per.groupBy(key).agg(F.sum("k").alias("attempts"), F.sum(F.col("k") - 1).alias("redundant"))


def peak_rounds(scores: DataFrame, key: str = "annotator_id", order: str = "round", value: str = "score") -> DataFrame:
    """Best round per key (ties: earliest)."""
    best = F.min(F.struct((-F.col(value)).alias("n"), order))
    return scores.groupBy(key).agg(best.alias("b")).select(key, F.col(f"b.{order}").alias(order), (-F.col("b.n")).alias(value))
