"""Ledgers, reward composition and weight shaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.config import STRICT_REWARD, IncentiveConfig, RewardConfig
from labelloom.functions.geometry import finite, ramp
from labelloom.scale import exact_quantile, ranked, running_total

U16 = 65535


def adoption_ledger(winners: DataFrame, by: str = "round_num") -> DataFrame:
    """Lifetime and last-round adoption counts, contributions and shares per annotator.

    ``winners``: round, item_id, chosen, verified, is_golden, escalated and
    ``contributions`` (MAP annotator -> share). Only verified public accepted rows count.
    """
    good = winners.where(F.col("verified") & ~F.col("is_golden") & ~F.col("escalated"))
    last = winners.agg(F.max(by).alias("_last"))
    chosen = good.select(by, F.col("chosen").alias("annotator_id"), F.lit(1).alias("n"), F.lit(0.0).alias("c"))
    credit = good.select(by, F.explode("contributions").alias("annotator_id", "c")).select(
        by, "annotator_id", F.lit(0).alias("n"), "c")
    rows = chosen.unionByName(credit).crossJoin(F.broadcast(last))
    recent = F.col(by) == F.col("_last")
    per = rows.groupBy("annotator_id").agg(
        F.sum("n").alias("adoptions"), F.sum("c").alias("contribution"),
        F.sum(F.when(recent, F.col("n")).otherwise(0)).alias("last_adoptions"),
        F.sum(F.when(recent, F.col("c")).otherwise(0.0)).alias("last_contribution"))
    total = per.agg(F.sum("adoptions").alias("_a"), F.sum("last_adoptions").alias("_l"),
                    F.sum("last_contribution").alias("_c"))

    def share(value, whole):
        return F.col(value) / F.when(F.col(whole) == 0, 1.0).otherwise(F.col(whole))

    return per.crossJoin(F.broadcast(total)).select(
        "annotator_id", "adoptions", "contribution", "last_adoptions", "last_contribution",
        share("adoptions", "_a").alias("share"), share("last_adoptions", "_l").alias("last_share"),
        share("last_contribution", "_c").alias("last_contribution_share"))


def compose_rewards(
    annotators: DataFrame, fidelity: DataFrame, localization: DataFrame, ledger: DataFrame, selected: DataFrame,
    public_items: int, cfg: RewardConfig = STRICT_REWARD, adoption_verified: bool = True,
) -> DataFrame:
    """Final reward per annotator: alpha * annotation + (1 - alpha) * max(adoption, selection).

    Annotation is the mean fidelity over rewardable items with truth, reduced by
    false positives on clean items, and 0 without enough qualifying positives.
    ``selected``: valid selected rows per annotator (``rows``, ``cap``, ``task_fidelity``).
    """
    positive = F.col("rewardable") & (F.col("gt_count") > 0)
    qualifies = positive & (F.col("matched") > 0) & (F.col("iou") >= cfg.min_iou) & (
        F.col("label_match") >= cfg.min_label_match) & (F.col("fidelity") >= cfg.min_fidelity)
    per = fidelity.groupBy("annotator_id").agg(
        F.count("*").alias("evidence"), F.count_if(positive).alias("positives"), F.count_if(qualifies).alias("qualifying"),
        F.avg(F.when(positive, F.col("fidelity"))).alias("mean"),
        F.coalesce(F.sum(F.when(F.col("rewardable") & (F.col("gt_count") == 0), F.col("hallucinated"))), F.lit(0)).alias(
            "clean_fp"))
    row = (
        annotators.select("annotator_id").join(per, "annotator_id", "left")
        .join(localization, "annotator_id", "left").join(ledger.select("annotator_id", "last_contribution_share"),
                                                         "annotator_id", "left")
        .join(selected.select("annotator_id", "rows", "cap", "task_fidelity"), "annotator_id", "left")
        .fillna({"evidence": 0, "positives": 0, "qualifying": 0, "clean_fp": 0, "localization": 0.0,
                 "last_contribution_share": 0.0, "rows": 0, "cap": 0, "task_fidelity": 0.0}))
    base = F.coalesce("mean", F.lit(0.0)) * F.when(
        (F.col("clean_fp") > 0) & (F.col("positives") > 0),
        F.col("positives") / (F.col("positives") + F.col("clean_fp"))).otherwise(1.0)
    base = F.when(F.col("qualifying") < cfg.min_positive_items, 0.0).otherwise(base)
    row = row.withColumn("annotation", F.greatest(F.lit(0.0), F.least(F.lit(1.0), base)))
    adopted = (
        (F.col("positives") >= cfg.adoption_min_items) & (F.col("qualifying") >= cfg.adoption_min_items)
        & (F.col("annotation") >= cfg.adoption_min_score) & (F.col("localization") >= cfg.adoption_min_localization)
        & F.lit(adoption_verified))
    allowed = (F.col("task_fidelity") >= 0.05) & (F.col("rows") <= F.col("cap"))
    selection = F.when(allowed, F.col("rows") * ramp(F.col("task_fidelity")) / F.lit(float(max(1, public_items)))).otherwise(0.0)
    row = row.withColumn("adoption", F.when(adopted, F.col("last_contribution_share")).otherwise(0.0)).withColumn(
        "selection", selection if public_items > 0 else F.lit(0.0))
    final = cfg.alpha * F.col("annotation") + (1 - cfg.alpha) * F.greatest("adoption", "selection")
    return row.select("annotator_id", "evidence", "positives", "qualifying", "annotation", "adoption", "selection",
                      F.greatest(F.lit(0.0), F.least(F.lit(1.0), final)).alias("reward"))


def ema(scores: DataFrame, alpha: float, key: str = "annotator_id", order: str = "round", value: str = "reward",
        rounds: DataFrame | None = None, tiny: float = 1e-4) -> DataFrame:
    """Moving average per key over all rounds: alpha * r + (1 - alpha) * s, values under ``tiny`` become 0.

    A round without a row counts as 0 and NaN as 0. Rows are first reduced to one
    per (key, round), so a key's history is as long as the number of rounds,
    whatever the row count. The rounds are numbered once; gaps between a key's
    rows decay in closed form (multiplying by (1 - alpha) and clamping commute:
    once below ``tiny`` the value stays 0).
    """
    clean = F.when(F.col(value).isNull() | F.isnan(value), 0.0).otherwise(F.col(value))
    per = scores.groupBy(key, order).agg(F.sum(clean).alias("_v"))
    # The list of rounds is a calendar: one row per round.
    calendar = (rounds if rounds is not None else per.select(order)).distinct()
    all_rounds = calendar.agg(F.array_sort(F.collect_set(order)).alias("_all"))
    placed = per.crossJoin(F.broadcast(all_rounds)).withColumn("_i", F.array_position("_all", F.col(order)).cast("int"))
    placed = placed.withColumn("_n", F.size("_all"))
    listed = placed.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_h"), F.first("_n").alias("_n"))
    keep = 1.0 - alpha
    fold = f"""aggregate(_h, named_struct('i', 0, 's', 0D), (acc, e) -> named_struct('i', e._i, 's',
        {alpha}D * e._v + {keep}D * IF(acc.s * pow({keep}D, e._i - acc.i - 1) < {tiny}D, 0D,
                                       acc.s * pow({keep}D, e._i - acc.i - 1))),
        acc -> IF(acc.s * pow({keep}D, _n - acc.i) < {tiny}D, 0D, acc.s * pow({keep}D, _n - acc.i)))"""
    return listed.select(key, F.expr(fold).alias("ema"))


def hamilton(shares: DataFrame, slots: DataFrame, by: Sequence[str] = (), key: str = "annotator_id",
             minimum: int = 0) -> DataFrame:
    """Largest-remainder apportionment of ``slots.n`` slots per group by ``share``.

    Every key gets ``minimum`` slots, the rest goes by share: whole parts first,
    leftovers by largest fraction, ties to the lower key.
    """
    by = list(by)
    row = shares.join(slots.select(*by, "n"), by) if by else shares.crossJoin(F.broadcast(slots.select("n")))
    totals = row.groupBy(*by, "n").agg(F.sum("share").alias("_s"), F.count("*").alias("_k"))
    row = row.drop("n").join(totals, by) if by else row.drop("n").crossJoin(F.broadcast(totals))
    free = F.greatest(F.lit(0), F.col("n") - F.lit(minimum) * F.col("_k"))
    exact = F.when(F.col("_s") > 0, F.col("share") / F.col("_s") * free).otherwise(0.0)
    # Shares like 0.1 are not exact in binary; a whole number up to 1e-9 counts as whole.
    row = row.withColumn("_whole", F.floor(exact + 1e-9)).withColumn("_part", F.round(exact - F.col("_whole"), 9)).withColumn(
        "_free", F.when(F.col("_s") > 0, free).otherwise(0))
    row = ranked(row, by, [F.desc("_part"), F.col(key)], "_r")
    used = row.groupBy(*by).agg(F.sum("_whole").alias("_used"))
    row = row.join(used, by) if by else row.crossJoin(F.broadcast(used))
    extra = F.when(F.col("_r") <= F.col("_free") - F.col("_used"), 1).otherwise(0)
    return row.select(*by, key, "share", (F.lit(minimum) + F.col("_whole") + extra).cast("bigint").alias("slots"))


def cap_weights(weights: DataFrame, limit: float, by: Sequence[str] = ("round",), key: str = "annotator_id") -> DataFrame:
    """Weights summing to 1 with none above ``limit`` (up to the 1e-7 guard of the formula).

    All-zero groups and groups where ``limit`` cannot hold get equal weights. The
    cutoff comes from the sorted running sum, so each group is one ranked pass.
    """
    by, guard = list(by), 1e-7
    totals = weights.groupBy(*by).agg(F.sum("weight").alias("_t"), F.count("*").alias("_n"), F.max("weight").alias("_m"))
    row = weights.join(totals, by)
    sane = (F.col("_t") != 0) & (F.col("_n") * limit > 1)
    capped = sane & (F.col("_m") / F.col("_t") > limit)
    work = row.where(capped).withColumn("_e", F.col("weight") / F.col("_t"))
    run = running_total(ranked(work, by, [F.col("_e"), F.col(key)], "_r"), by, [F.col("_r")], "_e", "_cum")
    below = F.col("_e") / ((F.col("_n") - F.col("_r")) * F.col("_e") + F.col("_cum") + guard) < limit
    marks = run.groupBy(*by).agg(F.count_if(below).alias("_k"))
    at = run.join(marks, by).where(F.col("_r") == F.when(F.col("_k") == 0, F.col("_n")).otherwise(F.col("_k"))).select(
        *by, ((limit * F.col("_cum") - guard) / (1 - limit * (F.col("_n") - F.col("_k"))) * F.col("_t")).alias("_cut"))
    row = row.join(at, by, "left").withColumn("_w", F.least("weight", F.coalesce("_cut", "weight")))
    final = row.groupBy(*by).agg(F.sum("_w").alias("_sum"))
    return row.join(final, by).select(
        *by, key, F.when(~sane, 1.0 / F.col("_n")).otherwise(F.col("_w") / F.col("_sum")).alias("weight"))


def process_weights(weights: DataFrame, limit: float, min_count: int, exclude: float = 0.0,
                    by: Sequence[str] = ("round",), key: str = "annotator_id") -> DataFrame:
    """Drop the lowest quantile, apply the minimum-count rules and cap.

    No positive weight, or fewer rows than ``min_count``: equal weights for all.
    Fewer positive weights than ``min_count``: every row gets 1e-5 plus its
    weight. Otherwise weights under the ``exclude`` quantile of positive ones go.
    """
    by = list(by)
    pos = F.col("weight") > 0
    stats = weights.groupBy(*by).agg(F.count("*").alias("_all"), F.count_if(pos).alias("_pos"))
    row = weights.join(stats, by)
    flat = (F.col("_pos") == 0) | (F.col("_all") < min_count)
    thin = ~flat & (F.col("_pos") < min_count)
    usual = row.where(~flat & ~thin & pos)
    if exclude > 0:
        q = F.least(F.lit(exclude), F.greatest(F.lit(0), F.col("n") - min_count) / F.col("n"))
        usual = usual.join(exact_quantile(usual, "weight", q, by, "_low"), by).where(F.col("weight") >= F.col("_low"))
    shaped = usual.select(*by, key, "weight").unionByName(
        row.where(thin).select(*by, key, (F.col("weight") + 1e-5).alias("weight")))
    even = row.where(flat).select(*by, key, (1.0 / F.col("_all")).alias("weight"))
    return cap_weights(shaped, limit, by, key).unionByName(even)


def quantize_weights(weights: DataFrame, by: Sequence[str] = ("round",), key: str = "annotator_id") -> DataFrame:
    """16-bit integer weights relative to the largest of the group, half-even, zeros dropped."""
    top = weights.groupBy(*by).agg(F.max("weight").alias("_m"))
    whole = F.rint(F.col("weight") / F.col("_m") * U16).cast("bigint")
    return weights.join(top, list(by)).where(F.col("_m") > 0).select(*by, key, whole.alias("value")).where("value > 0")


def shape_incentives(scores: DataFrame, cfg: IncentiveConfig = IncentiveConfig(), by: Sequence[str] = ("round",),
                     key: str = "annotator_id", value: str = "score", scale_by_leader: bool = False) -> DataFrame:
    """Floor plus a share of the rest for every score above the cutoff; shares sum to 1 per group.

    Share by score (temperature near 1), by a power of it, or by softmax below
    temperature 0.1. The floor shrinks when all floors together exceed the cap.
    """
    by = list(by)
    s = F.col("_s")
    row = scores.withColumn("_s", F.col(value))
    if scale_by_leader:
        lead = row.groupBy(*by).agg(F.max("_s").alias("_lead"))
        row = row.join(lead, by).withColumn("_s", F.when(F.col("_lead") > 0, s / F.col("_lead")).otherwise(s))
    ok = finite(s) & (s >= max(cfg.min_score, cfg.lowest_cutoff)) & (s > 0)
    row = row.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    good = row.where("_ok")
    top = good.groupBy(*by).agg(F.max("_s").alias("_m"), F.count("*").alias("_n"))
    good = good.join(top, by)
    if not cfg.proportional or cfg.temperature < 0.10:
        raw = F.exp((s - F.col("_m")) / cfg.temperature)
    else:
        t = max(0.5, cfg.temperature)
        raw = s if 0.95 <= t <= 1.05 else F.pow(s / F.col("_m"), max(0.5, min(2.0, 1.0 / t)))
    good = good.withColumn("_raw", raw)
    whole = good.groupBy(*by).agg(F.sum("_raw").alias("_sum"))
    floor = F.when(cfg.floor * F.col("_n") > cfg.max_total_floor, cfg.max_total_floor / F.col("_n")).otherwise(cfg.floor)
    good = good.join(whole, by).withColumn(
        "share", F.greatest(F.lit(0.0), floor + (1.0 - floor * F.col("_n")) * F.col("_raw") / F.col("_sum")))
    total = good.groupBy(*by).agg(F.sum("share").alias("_t"))
    shaped = good.join(total, by).select(*by, key, (F.col("share") / F.col("_t")).alias("share"))
    return shaped.unionByName(row.where("NOT _ok").select(*by, key, F.lit(0.0).alias("share")))
