"""Queries: matching, fidelity, consensus, reliability."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.config import FidelityConfig
from labelloom.functions import geometry as G
from labelloom.functions import taxonomy as T
from labelloom.operators import match as M
from labelloom.operators import score as S
from labelloom.plans import sqltext as Q
from labelloom.plans.registry import query

SUB = list(S.SUBMISSION)
R6 = lambda c: F.round(F.col(c), 6).alias(c)

EDGES = f"""edges AS (SELECT a.round_num, a.item_id, a.annotator_id, g.gt, a.seq, {Q.iou('a', 'g')} AS iou
  FROM annotations a JOIN golden g ON a.item_id = g.item_id
   AND a.x1 < g.x2 AND g.x1 < a.x2 AND a.y1 < g.y2 AND g.y1 < a.y2)"""
EDGES_50 = EDGES + ", edges50 AS (SELECT * FROM edges WHERE iou >= 0.5)"
# The same edges measured by the outlines of both sides, where both have one.
OUTLINE_EDGES = f"""op_a AS (SELECT *, {Q.ANNOTATION_POINTS} AS p FROM annotations), op_g AS (SELECT *, {Q.GOLDEN_POINTS} AS q FROM golden),
op_p AS (SELECT row_number() OVER () AS pid, a.round_num, a.item_id, a.annotator_id, g.gt, a.seq, p, q, {', '.join(f'a.{c} AS a{c}, g.{c} AS b{c}' for c in ('x1', 'y1', 'x2', 'y2'))}
  FROM op_a a JOIN op_g g ON a.item_id = g.item_id AND a.x1 < g.x2 AND g.x1 < a.x2 AND a.y1 < g.y2 AND g.y1 < a.y2),
{Q.outline_overlap('op_i', 'op_p')}, edges AS (SELECT round_num, item_id, annotator_id, gt, seq, iou FROM op_i)"""
BASE = Q.with_tables("annotations", "golden", "items")


def golden_annotations(t):
    """Annotations on scored items; the role filter reaches the item scan."""
    scored = t.items.where(F.col("role") != "public").select("item_id")
    return t.outlined.join(scored, "item_id", "left_semi")


@query("iou_join", f"{BASE}, {EDGES} SELECT round_num, item_id, annotator_id, seq, gt, round(iou, 6) AS iou "
                   "FROM edges WHERE iou >= 0.3")
def iou_join(t):
    pairs = M.iou_join(t.annotations, t.golden, ["item_id"], 0.3)
    return pairs.select(F.col("a_round_num").alias("round_num"), "item_id", F.col("a_annotator_id").alias("annotator_id"),
                        F.col("a_seq").alias("seq"), F.col("b_gt").alias("gt"), R6("iou"))


def _match_query(name, drive, min_iou, same):
    label = f" WHERE {Q.canonical('label')} = {Q.canonical('glabel')}" if same else ""
    edges = f"""cand AS (SELECT a.round_num, a.item_id, a.annotator_id, g.gt, a.seq, a.label, g.label AS glabel,
      {Q.iou('a', 'g')} AS iou FROM annotations a JOIN golden g ON a.item_id = g.item_id
      AND a.x1 < g.x2 AND g.x1 < a.x2 AND a.y1 < g.y2 AND g.y1 < a.y2),
      fit AS (SELECT round_num, item_id, annotator_id, gt, seq, iou FROM cand{label}),
      fits AS (SELECT * FROM fit WHERE iou >= {min_iou})"""
    sql = (f"{BASE}, {edges}, {Q.greedy('m', 'fits', SUB, drive)} "
           "SELECT round_num, item_id, annotator_id, gt, seq, round(iou, 6) AS iou FROM m")

    @query(name, sql)
    def run(t):
        anns, golden = t.annotations, t.golden
        if same:
            anns = anns.withColumn("label", T.canonical_label(F.col("label")))
            golden = golden.withColumn("label", T.canonical_label(F.col("label")))
        got = M.greedy_match(golden, anns, SUB, min_iou=min_iou, drive=drive, same_label=same)
        return got.select(*SUB, "gt", "seq", R6("iou"))


_match_query("greedy_match_truth", "truth", 0.5, False)
_match_query("greedy_match_diagnostic", "truth", 0.3, False)
_match_query("greedy_match_same_label", "pred", 0.5, True)
_match_query("greedy_match_pred", "pred", 0.5, False)


def _outline_match_query(name, min_iou):
    @query(name, f"""{BASE}, {OUTLINE_EDGES}, fits AS (SELECT * FROM edges WHERE iou >= {min_iou}), {Q.greedy('m', 'fits', SUB)}
      SELECT round_num, item_id, annotator_id, gt, seq, round(iou, 6) AS iou FROM m""")
    def run(t):
        got = M.greedy_match(t.golden_outlined, golden_annotations(t), SUB, min_iou=min_iou)
        return got.select(*SUB, "gt", "seq", R6("iou"))


_outline_match_query("greedy_match_outlines", 0.5)
_outline_match_query("greedy_match_outlines_diagnostic", 0.3)


@query("best_match", f"""{BASE}, {EDGES_50} SELECT round_num, item_id, annotator_id, seq,
   arg_max(gt, iou * 1000 - gt / 1000.0) AS gt, round(max(iou), 6) AS iou FROM edges50 GROUP BY ALL""")
def best_match(t):
    return M.best_match(t.annotations, t.golden, [*SUB, "seq"]).select(*SUB, "seq", "gt", R6("iou"))


PEERS = """pair AS (SELECT a.round_num, a.item_id, a.annotator_id, b.annotator_id AS peer
  FROM (SELECT DISTINCT round_num, item_id, annotator_id FROM annotations) a
  JOIN (SELECT DISTINCT round_num, item_id, annotator_id FROM annotations) b
    ON a.round_num = b.round_num AND a.item_id = b.item_id AND a.annotator_id <> b.annotator_id)"""


@query("peer_pairs", f"{Q.with_tables('annotations')}, {PEERS} SELECT round_num, item_id, annotator_id, "
                     "count(*) AS peers FROM pair GROUP BY ALL")
def peer_pairs(t):
    """Peers per submission; counted from the item's annotators, so no pair is built."""
    subs = t.annotations.select(*SUB).distinct()
    crowd = subs.groupBy("round_num", "item_id").agg((F.count("*") - 1).alias("peers")).where("peers > 0")
    return subs.join(crowd, ["round_num", "item_id"])


AUDIT_SQL = f"""{BASE}, mine AS (SELECT a.* FROM annotations a JOIN items i USING (item_id) WHERE i.role <> 'public'),
{Q.audit('audit', 'mine', SUB)}"""


@query("geometry_audit", f"""{Q.with_tables('annotations')}, {Q.audit('audit', 'annotations', SUB)}
 SELECT round_num, item_id, annotator_id, total, box_count, spiky_count, round(box_count / total, 4) AS box_ratio,
   round(spiky_count / total, 4) AS spiky_ratio, round(mq, 2) AS mean_compactness, round(mc, 2) AS mean_convexity,
   quality, acceptable, reason FROM audit""")
def geometry_audit(t):
    got = S.audit_geometry(t.outlined)
    return got.select(*SUB, "total", "box_count", "spiky_count", "box_ratio", "spiky_ratio",
                      F.round("mean_compactness", 2).alias("mean_compactness"),
                      F.round("mean_convexity", 2).alias("mean_convexity"), "quality", "acceptable", "reason")


def fidelity_sql(audit: bool = True) -> str:
    quality = "quality" if audit else "1.0"
    ok = "acceptable" if audit else "true"
    reason = "reason" if audit else "NULL"
    return f"""{AUDIT_SQL}, {EDGES_50}, {Q.greedy('m', 'edges50', SUB)},
lab AS (SELECT a.*, {Q.canonical('a.label')} AS cl, i.role, i.width * i.height AS frame,
  {Q.canonical('i.only_label')} AS ol FROM annotations a JOIN items i USING (item_id) WHERE i.role <> 'public'),
net AS (SELECT round_num, item_id, annotator_id, any_value(role) AS role, count(*) AS n,
  round_even(sum((x2 - x1) * (y2 - y1) / frame * {Q.multiplier('cl')}), 6) AS net_weight,
  avg({Q.match('cl', 'ol')}) AS only_avg, CAST(sum({Q.match('cl', 'ol')}) AS BIGINT) AS only_hits
  FROM lab GROUP BY round_num, item_id, annotator_id),
gts AS (SELECT g.item_id, count(*) AS gt_count,
  round_even(sum((x2 - x1) * (y2 - y1) / (i.width * i.height) * {Q.multiplier('g.label')}), 6) AS gt_weight
  FROM golden g JOIN items i USING (item_id) GROUP BY g.item_id),
hit AS (SELECT m.round_num, m.item_id, m.annotator_id, count(*) AS matched, sum(m.iou) AS iou_sum,
  sum({Q.match('l.cl', 'g.label')}) AS label_sum
  FROM m JOIN lab l USING (round_num, item_id, annotator_id, seq) JOIN golden g ON g.item_id = m.item_id AND g.gt = m.gt
  GROUP BY ALL),
r AS (SELECT n.*, coalesce(gt_count, 0) AS gtc, coalesce(gt_weight, 0) AS gtw, coalesce(h.matched, 0) AS mm,
  coalesce(iou_sum, 0) AS ious, coalesce(label_sum, 0) AS labs, {quality} AS quality0, {ok} AS ok,
  {reason} AS reason0 FROM net n JOIN audit USING (round_num, item_id, annotator_id)
  LEFT JOIN gts USING (item_id) LEFT JOIN hit h USING (round_num, item_id, annotator_id)),
s AS (SELECT *, CASE WHEN role = 'class_only' THEN only_hits ELSE mm END AS matched,
  CASE WHEN role = 'class_only' THEN only_avg WHEN gtc = 0 THEN 0 ELSE labs / gtc END AS label_match,
  CASE WHEN role = 'class_only' OR gtc = 0 THEN 0 ELSE ious / gtc END AS iou,
  CASE WHEN role = 'class_only' THEN 1.0 WHEN gtc = 0 THEN greatest(0.0, 1 - net_weight)
    ELSE round_even(greatest(0.0, 1 - abs(net_weight - gtw) / greatest(gtw, 0.05)), 6) END AS agree FROM r),
u AS (SELECT *, n - matched AS hallucinated, CASE WHEN role <> 'class_only' AND gtc = 0 THEN power(0.5, n)
  WHEN matched = 0 THEN 0.0 ELSE matched / (matched + 1.0 * (n - matched)) END AS penalty FROM s),
fidelity AS (SELECT *, CASE WHEN role = 'class_only' THEN label_match * penalty WHEN gtc = 0 THEN 0.0
   ELSE least(1.0, (0.6 * iou + 0.4 * label_match) * penalty * (0.2 + 0.8 * agree) * quality0) END AS fid,
   CASE WHEN role = 'class_only' THEN 1 ELSE gtc END AS gt_count,
   CASE WHEN role = 'class_only' THEN 1.0 WHEN gtc = 0 THEN 0.0 ELSE quality0 END AS quality FROM u),
scored AS (SELECT *, role <> 'class_only' AND gtc > 0 AND ok AND fid > 0 AS rewardable FROM fidelity)"""


FID_SELECT = """ SELECT round_num, item_id, annotator_id, n AS detections, CAST(gt_count AS BIGINT) AS gt_count,
 CAST(matched AS BIGINT) AS matched, CAST(hallucinated AS BIGINT) AS hallucinated, round(iou, 6) AS iou,
 round(label_match, 6) AS label_match, round(penalty, 6) AS penalty, agree AS weight_agreement, net_weight, quality, round(fid, 5) AS fidelity, rewardable FROM scored"""


def _fid_out(df):
    return df.select(*SUB, "detections", "gt_count", "matched", "hallucinated", R6("iou"), R6("label_match"),
                     R6("penalty"), "weight_agreement", "net_weight", "quality",
                     F.round("fidelity", 5).alias("fidelity"), "rewardable")


@query("fidelity", fidelity_sql() + FID_SELECT)
def fidelity(t):
    return _fid_out(S.score_fidelity(golden_annotations(t), t.golden, t.items))


@query("fidelity_outlines", fidelity_sql().replace(EDGES, OUTLINE_EDGES) + FID_SELECT)
def fidelity_outlines(t):
    return _fid_out(S.score_fidelity(golden_annotations(t), t.golden_outlined, t.items))


@query("fidelity_without_audit", fidelity_sql(False) + FID_SELECT)
def fidelity_without_audit(t):
    return _fid_out(S.score_fidelity(golden_annotations(t), t.golden, t.items, FidelityConfig(audit=False)))


# Submissions with status 'R' count as not delivered; every annotator of a golden item was asked for it.
MISSING_SQL = f"""{fidelity_sql()}, late AS (SELECT DISTINCT round_num, item_id, annotator_id FROM annotations a
   WHERE status <> 'R'),
exp AS (SELECT DISTINCT a.round_num, a.item_id, a.annotator_id FROM annotations a JOIN items i USING (item_id)
   WHERE i.role = 'golden'),
filled AS (SELECT round_num, item_id, annotator_id, CASE WHEN rewardable THEN fid ELSE 0 END AS fidelity, false AS missing
   FROM scored SEMI JOIN late USING (round_num, item_id, annotator_id)
  UNION ALL SELECT round_num, item_id, annotator_id, 0, true FROM exp ANTI JOIN late USING (round_num, item_id, annotator_id))"""


def _filled(t):
    anns = golden_annotations(t)
    arrived = anns.where("status <> 'R'").select(*SUB).distinct()
    scores = S.score_fidelity(anns, t.golden, t.items).join(arrived, SUB, "left_semi")
    return scores, S.fill_missing_golden(scores, anns, t.items)


@query("missing_golden", MISSING_SQL + """ SELECT round_num, item_id, annotator_id, round(fidelity, 5) AS fidelity,
   missing FROM filled""")
def missing_golden(t):
    return _filled(t)[1].select(*SUB, F.round("fidelity", 5).alias("fidelity"), "missing")


@query("annotator_average", MISSING_SQL + """, halluc AS (SELECT annotator_id, CAST(sum(hallucinated) AS BIGINT) AS hallucinated,
   CAST(sum(gt_count) AS BIGINT) AS gt_total FROM scored SEMI JOIN late USING (round_num, item_id, annotator_id) GROUP BY 1)
 SELECT f.annotator_id, round(avg(fidelity), 5) AS avg_fidelity, count(*) AS scored,
   count(*) FILTER (missing) AS missing, coalesce(any_value(hallucinated), 0) AS hallucinated,
   coalesce(any_value(gt_total), 0) AS gt_total,
   round(power(0.5, least(5.0, coalesce(any_value(hallucinated), 0) / greatest(1, coalesce(any_value(gt_total), 0)))), 6)
     AS hallucination_multiplier
 FROM filled f LEFT JOIN halluc USING (annotator_id) GROUP BY 1""")
def annotator_average(t):
    scores, filled = _filled(t)
    return S.annotator_average(filled, scores).select(
        "annotator_id", F.round("avg_fidelity", 5).alias("avg_fidelity"), "scored", "missing", "hallucinated",
        "gt_total", R6("hallucination_multiplier"))


@query("peer_consensus", f"""{Q.with_tables('annotations', 'items')},
 b AS (SELECT a.*, {Q.canonical('label')} AS cl FROM annotations a JOIN items i USING (item_id) WHERE i.role = 'public'),
 subs AS (SELECT round_num, item_id, annotator_id, arg_min(cl, seq) AS own FROM b GROUP BY ALL),
 pr AS (SELECT a.round_num, a.item_id, a.annotator_id, p.annotator_id AS peer, p.cl,
    {Q.iou('a', 'p')} AS iou FROM b a JOIN b p USING (round_num, item_id) WHERE a.annotator_id <> p.annotator_id),
 best AS (SELECT round_num, item_id, annotator_id, peer, max(iou) AS v,
    min({{'n': -iou, 'l': cl}}).l AS l FROM pr GROUP BY ALL),
 votes AS (SELECT round_num, item_id, annotator_id, l, count(*) AS w FROM best WHERE v > 0 GROUP BY ALL),
 top AS (SELECT round_num, item_id, annotator_id, min({{'n': -w, 'l': l}}).l AS major FROM votes GROUP BY ALL),
 m AS (SELECT round_num, item_id, annotator_id, count(*) AS peers, avg(v) AS mean_iou FROM best GROUP BY ALL)
 SELECT s.round_num, s.item_id, s.annotator_id, coalesce(peers, 0) AS peers, round(coalesce(mean_iou, 0), 6) AS mean_iou,
   CASE WHEN own = major THEN 1.0 ELSE 0.0 END::DOUBLE AS majority_match,
   round(least(1.0, 0.6 * coalesce(mean_iou, 0) + 0.4 * CASE WHEN own = major THEN 1 ELSE 0 END), 6) AS consensus
 FROM subs s LEFT JOIN m USING (round_num, item_id, annotator_id) LEFT JOIN top USING (round_num, item_id, annotator_id)""")
def peer_consensus(t):
    public = t.annotations.join(t.items.where("role = 'public'").select("item_id"), "item_id", "left_semi")
    return S.score_consensus(public, probe=t.annotations).select(*SUB, "peers", R6("mean_iou"), "majority_match", R6("consensus"))


COUNTS_SQL = f"""{AUDIT_SQL}, bad AS (SELECT round_num, item_id, annotator_id FROM audit WHERE NOT acceptable OR quality < 0.5),
 lab AS (SELECT a.*, {Q.canonical('a.label')} AS cl, i.role, {Q.canonical('i.only_label')} AS ol FROM annotations a
   JOIN items i USING (item_id) WHERE i.role <> 'public'),
 {EDGES}, fair AS (SELECT * FROM edges ANTI JOIN bad USING (round_num, item_id, annotator_id) WHERE iou >= 0.5),
 {Q.greedy('m', 'fair', SUB)},
 subs AS (SELECT DISTINCT round_num, item_id, annotator_id, role, ol FROM lab),
 mp AS (SELECT m.*, l.cl, g.label AS gl FROM m JOIN lab l USING (round_num, item_id, annotator_id, seq)
   JOIN golden g ON g.item_id = m.item_id AND g.gt = m.gt),
 pick AS (SELECT round_num, item_id, annotator_id, arg_min(cl, seq) FILTER ({Q.match('cl', 'ol')} > 0) AS pk
   FROM lab WHERE role = 'class_only' GROUP BY ALL),
 ev AS (
  SELECT round_num, annotator_id, gl AS label, (cl = gl)::INT AS tp, 0 AS fp, (cl <> gl)::INT AS fn,
    CASE WHEN cl = gl THEN iou ELSE 0 END AS iou_sum, (cl = gl)::INT AS iou_n, iou AS all_iou, 1 AS all_n, 1 AS gt_seen FROM mp
  UNION ALL SELECT round_num, annotator_id, cl, 0, 1, 0, 0, 0, 0, 0, 0 FROM mp WHERE cl <> gl
  UNION ALL SELECT round_num, annotator_id, cl, 0, 1, 0, 0, 0, 0, 0, 0 FROM lab
    ANTI JOIN m USING (round_num, item_id, annotator_id, seq) WHERE role <> 'class_only'
  UNION ALL SELECT round_num, annotator_id, label, 0, 0, 1, 0, 0, 0, 0, 1 FROM (SELECT s.*, g.gt, g.label FROM subs s
    JOIN golden g USING (item_id) WHERE role <> 'class_only') ANTI JOIN m USING (round_num, item_id, annotator_id, gt)
  UNION ALL SELECT round_num, annotator_id, '_background', 0, 0, 1, 0, 0, 0, 0, 0 FROM subs
    ANTI JOIN golden USING (item_id) WHERE role <> 'class_only'
  UNION ALL SELECT round_num, annotator_id, pk, 1, 0, 0, 0, 0, 0, 0, 0 FROM pick WHERE pk IS NOT NULL
  UNION ALL SELECT round_num, annotator_id, ol, 0, 0, 1, 0, 0, 0, 0, 0 FROM subs
    JOIN pick USING (round_num, item_id, annotator_id) WHERE pk IS NULL
  UNION ALL SELECT round_num, annotator_id, cl, 0, 1, 0, 0, 0, 0, 0, 0 FROM lab
    JOIN pick USING (round_num, item_id, annotator_id) WHERE role = 'class_only' AND cl <> pk),
 counts AS (SELECT round_num, annotator_id, label, sum(tp)::DOUBLE AS tp, sum(fp)::DOUBLE AS fp, sum(fn)::DOUBLE AS fn,
   sum(iou_sum)::DOUBLE AS iou_sum, sum(iou_n)::DOUBLE AS iou_n, sum(all_iou)::DOUBLE AS all_iou,
   sum(all_n)::DOUBLE AS all_n, sum(gt_seen)::DOUBLE AS gt_seen FROM ev GROUP BY ALL)"""


def counts(t):
    anns = golden_annotations(t)
    return S.confusion_counts(anns, t.golden, t.items, S.audit_geometry(anns))


@query("confusion_counts", COUNTS_SQL + """ SELECT round_num, annotator_id, label, tp, fp, fn, round(iou_sum, 5) AS iou_sum,
  iou_n, round(all_iou, 5) AS all_iou, all_n, gt_seen FROM counts""")
def confusion_counts(t):
    return counts(t).select("round_num", "annotator_id", "label", "tp", "fp", "fn",
                            F.round("iou_sum", 5).alias("iou_sum"), "iou_n", F.round("all_iou", 5).alias("all_iou"),
                            "all_n", "gt_seen")


@query("confusion_outlines", COUNTS_SQL.replace(EDGES, OUTLINE_EDGES) + """ SELECT round_num, annotator_id, label, tp, fp, fn, round(iou_sum, 5) AS iou_sum,
  iou_n, round(all_iou, 5) AS all_iou, all_n, gt_seen FROM counts""")
def confusion_outlines(t):
    anns = golden_annotations(t)
    got = S.confusion_counts(anns, t.golden_outlined, t.items, S.audit_geometry(anns))
    return got.select("round_num", "annotator_id", "label", "tp", "fp", "fn", F.round("iou_sum", 5).alias("iou_sum"), "iou_n",
                      F.round("all_iou", 5).alias("all_iou"), "all_n", "gt_seen")


LAST_ROUND = 2001
DECAY_SQL = COUNTS_SQL + f""", decayed AS (SELECT annotator_id, label, """ + ", ".join(
    f"sum({c} * power(0.95, {LAST_ROUND} - round_num)) AS {c}" for c in S.COUNTS) + f""" FROM counts
   WHERE round_num <= {LAST_ROUND} GROUP BY ALL),
 pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0
   END AS r FROM decayed),
 ff AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1,
   CASE WHEN iou_n > 0 THEN iou_sum / iou_n ELSE 0 END AS li FROM pr),
 rel AS (SELECT *, greatest(1e-4, f1 * CASE WHEN tp + fp + fn > 0 THEN (tp + fp + fn) / (tp + fp + fn + 5.0) ELSE 0 END
   * (0.5 + 0.5 * li)) AS weight FROM ff)"""


@query("decayed_counts", DECAY_SQL + " SELECT annotator_id, label, " + ", ".join(
    f"round({c}, {6 if c.endswith('iou') or c == 'iou_sum' else 12}) AS {c}" for c in S.COUNTS) + " FROM decayed")
def decayed_counts(t):
    got = S.decayed_counts(counts(t), LAST_ROUND)
    return got.select("annotator_id", "label", *[F.round(c, 6 if c.endswith("iou") or c == "iou_sum" else 12).alias(c) for c in S.COUNTS])


@query("reliability", DECAY_SQL + """ SELECT annotator_id, label, round(p, 6) AS precision, round(r, 6) AS recall,
   round(f1, 6) AS f1, round(li, 6) AS label_iou, round(weight, 6) AS weight FROM rel""")
def reliability(t):
    got = S.reliability(S.decayed_counts(counts(t), LAST_ROUND))
    return got.select("annotator_id", "label", *[R6(c) for c in ("precision", "recall", "f1", "label_iou", "weight")])


@query("localization", DECAY_SQL + """ SELECT annotator_id, round(coalesce(sum(all_iou) / nullif(sum(all_n), 0), 0), 6)
   AS localization FROM decayed GROUP BY 1""")
def localization(t):
    return S.localization(S.decayed_counts(counts(t), LAST_ROUND)).select("annotator_id", R6("localization"))


@query("item_net_metrics", f"""{Q.with_tables('annotations', 'items')},
 a AS (SELECT *, {Q.canonical('label')} AS cl, CASE WHEN seq % 4 = 0 THEN seq % 5000 - 500 END AS area,
   CASE WHEN seq % 6 = 0 THEN (seq % 7) / 10.0 - 0.1 END AS weight FROM annotations),
 b AS (SELECT *, CASE WHEN area > 0 THEN area ELSE (x2 - x1) * (y2 - y1) END AS ar FROM a JOIN items USING (item_id))
 SELECT round_num, item_id, annotator_id, round_even(sum(CASE WHEN weight >= 0 THEN weight
     ELSE ar / (width * height) * {Q.multiplier('cl')} END), 6) AS net_weight,
   round_even(least(1.0, sum(ar / (width * height))) * 100, 2) AS coverage_pct, count(*) AS n_objects FROM b GROUP BY ALL""")
def item_net_metrics(t):
    anns = t.annotations.withColumn("area", F.expr("CASE WHEN seq % 4 = 0 THEN CAST(seq % 5000 - 500 AS DOUBLE) END"))
    anns = anns.withColumn("weight", F.expr("CASE WHEN seq % 6 = 0 THEN (seq % 7) / 10.0D - 0.1D END"))
    got = S.item_net_metrics(anns, t.items)
    return got.select(*SUB, "net_weight", "coverage_pct", "n_objects")


@query("class_breakdown", f"""{Q.with_tables('annotations', 'items')},
 a AS (SELECT item_id, {Q.carbon(Q.canonical('label'))} AS carbon_class, (x2 - x1) * (y2 - y1) / (width * height) AS s,
   {Q.multiplier(Q.canonical('label'))} AS m FROM annotations JOIN items USING (item_id)),
 p AS (SELECT item_id, carbon_class, count(*) AS n, sum(s) AS area, sum(round_even(s * m, 6)) AS w FROM a GROUP BY ALL)
 SELECT item_id, carbon_class, n, round_even(area, 6) AS area_ratio, round_even(w, 6) AS carbon_weight,
   first_value(carbon_class) OVER (PARTITION BY item_id ORDER BY round_even(w, 6) DESC, carbon_class) AS dominant FROM p""")
def class_breakdown(t):
    got = S.class_breakdown(t.annotations, t.items)
    return got.select("item_id", "carbon_class", "n", "area_ratio", "carbon_weight", "dominant")
