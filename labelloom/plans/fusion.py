"""Queries: voting, clustering, label and box fusion, item assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.config import FusionConfig
from labelloom.functions import taxonomy as T
from labelloom.operators import fuse as U
from labelloom.operators import match as M
from labelloom.operators import score as S
from labelloom.plans import sqltext as Q
from labelloom.plans.registry import query
from labelloom.plans.scoring import R6, _filled, MISSING_SQL

# All rounds of an item vote together, so that clusters hold several votes.
ITEM = ["item_id"]
KEY = ["item_id", "lead_annotator", "lead_seq"]
CFG = FusionConfig(min_support_ratio=0.12, accept_confidence=0.60, min_mean_iou=0.75)
CFG_FALLBACK = FusionConfig(min_support_ratio=0.12, accept_confidence=0.60, min_mean_iou=0.75, fallback=True,
                            fallback_min_reliability=0.9)

PRIOR_SQL = f"""prior0 AS (SELECT label, count(*) AS n FROM (SELECT {Q.canonical('label')} AS label FROM golden
   UNION ALL SELECT {Q.canonical('only_label')} FROM items WHERE only_label IS NOT NULL
   UNION ALL SELECT '_background') GROUP BY 1),
 prior1 AS (SELECT label, n + 1.1 - CASE WHEN label = '_background' THEN 1 ELSE 0 END AS n FROM prior0),
 priors AS (SELECT label, n / (SELECT sum(n) FROM prior1) AS prior FROM prior1)"""


@query("class_priors", f"{Q.with_tables('golden', 'items')}, {PRIOR_SQL} SELECT label, round(prior, 6) AS prior FROM priors")
def class_priors(t):
    return U.class_priors(t.golden, t.items).select("label", R6("prior"))


VOTER_SQL = """pub AS (SELECT a.*, i.width * i.height AS frame FROM annotations a JOIN items i USING (item_id)
   WHERE i.role = 'public'),
 subs AS (SELECT DISTINCT item_id, annotator_id FROM pub),
 voters AS (SELECT item_id, annotator_id FROM (SELECT s.*, row_number() OVER (PARTITION BY s.item_id, an.owner_id
   ORDER BY av.avg_fidelity DESC, s.annotator_id) AS rn FROM subs s JOIN annotators an USING (annotator_id)
   JOIN averages av USING (annotator_id)) WHERE rn = 1)"""
BASE = Q.with_tables("annotations", "items", "annotators", "averages", "reliabilities", "golden")


def public(t):
    return t.annotations.join(t.items.where("role = 'public'").select("item_id"), "item_id", "left_semi")


def voters(t):
    return U.one_vote_per_owner(public(t).select("item_id", "annotator_id").distinct(), t.annotators, t.averages, ITEM)


@query("one_vote_per_owner", f"{BASE}, {VOTER_SQL} SELECT * FROM voters")
def one_vote_per_owner(t):
    return voters(t)


CLUSTER_SQL = f"""{BASE}, {VOTER_SQL},
 kept AS (SELECT p.round_num, p.item_id, p.annotator_id, p.seq, {Q.canonical('p.label')} AS label, x1, y1, x2, y2, frame
   FROM pub p SEMI JOIN voters v USING (item_id, annotator_id)),
 wk AS (SELECT k.*, greatest(1e-4, coalesce(r.weight, 1e-4)) AS weight FROM kept k
   LEFT JOIN reliabilities r ON r.annotator_id = k.annotator_id AND r.label = k.label),
 {Q.anchors('cl', 'wk', ITEM, 'weight DESC, annotator_id, seq', 0.5)},
 members AS (SELECT c.*, l.annotator_id AS lead_annotator, l.seq AS lead_seq FROM cl c
   JOIN cl l ON l.item_id = c.item_id AND l.k = c.anchor)"""


def kept(t):
    return public(t).join(voters(t), ["item_id", "annotator_id"], "left_semi")


def clusters(t):
    return U.cluster_boxes(kept(t), t.reliabilities, 0.5, ITEM, t.annotations)


@query("cluster_boxes", f"{CLUSTER_SQL} SELECT item_id, annotator_id, seq, label, weight, lead_annotator, lead_seq FROM members")
def cluster_boxes(t):
    return clusters(t).select("item_id", "annotator_id", "seq", "label", "weight", "lead_annotator", "lead_seq")


VOTE_SQL = f"""{CLUSTER_SQL}, votes AS (SELECT item_id, lead_annotator, lead_seq, annotator_id,
   arg_max({{'label': label, 'weight': weight, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}, k) AS v FROM members GROUP BY ALL),
 vote AS (SELECT item_id, lead_annotator, lead_seq, annotator_id, v.label AS label, v.weight AS weight, v.x1 AS x1,
   v.y1 AS y1, v.x2 AS x2, v.y2 AS y2 FROM votes)"""


@query("cluster_votes", f"{VOTE_SQL} SELECT * FROM vote")
def cluster_votes(t):
    return U.cluster_votes(clusters(t), ITEM).select(*KEY, "annotator_id", "label", "weight", "x1", "y1", "x2", "y2")


def _posterior_sql(skip: bool) -> str:
    out = ", out_id" if skip else ""
    target = ("tgt AS (SELECT DISTINCT item_id, lead_annotator, lead_seq, annotator_id AS out_id FROM vote)" if skip else
              "tgt AS (SELECT DISTINCT item_id, lead_annotator, lead_seq FROM vote)")
    return f"""{VOTE_SQL}, {PRIOR_SQL}, {target},
 labs AS (SELECT item_id, lead_annotator, lead_seq, label FROM vote
   UNION SELECT item_id, lead_annotator, lead_seq, p.label FROM (SELECT DISTINCT item_id, lead_annotator, lead_seq FROM vote)
     CROSS JOIN priors p),
 kk AS (SELECT item_id, lead_annotator, lead_seq, count(*) AS k FROM labs GROUP BY ALL),
 obs AS (SELECT c.*, vo.annotator_id AS aid, coalesce(v.label, '_background') AS seen,
    greatest(1e-4, coalesce(v.weight, r.weight, 1e-4)) AS w
   FROM tgt c JOIN voters vo USING (item_id)
   LEFT JOIN vote v ON v.item_id = c.item_id AND v.lead_annotator = c.lead_annotator AND v.lead_seq = c.lead_seq
     AND v.annotator_id = vo.annotator_id
   LEFT JOIN reliabilities r ON r.annotator_id = vo.annotator_id AND r.label = '_background' AND v.label IS NULL
   {'WHERE vo.annotator_id <> c.out_id' if skip else ''}),
 lp AS (SELECT o.item_id, o.lead_annotator, o.lead_seq{', o.out_id' if skip else ''}, l.label,
   sum(o.w * ln(CASE WHEN o.seen = l.label THEN 0.5 + 0.5 * o.w ELSE (0.5 - 0.5 * o.w) / (kk.k - 1) END)) AS ll
   FROM obs o JOIN labs l USING (item_id, lead_annotator, lead_seq) JOIN kk USING (item_id, lead_annotator, lead_seq)
   GROUP BY ALL),
 lq AS (SELECT lp.*, ll + ln(greatest(1e-9, coalesce(prior, 1e-9))) AS logit FROM lp LEFT JOIN priors USING (label)),
 mx AS (SELECT item_id, lead_annotator, lead_seq{out}, max(logit) AS top FROM lq GROUP BY ALL),
 ex AS (SELECT lq.*, exp(logit - top) AS e FROM lq JOIN mx USING (item_id, lead_annotator, lead_seq{out})),
 post AS (SELECT item_id, lead_annotator, lead_seq{out}, label, e / sum(e) OVER (PARTITION BY item_id, lead_annotator,
   lead_seq{out}) AS p FROM ex),
 best AS (SELECT item_id, lead_annotator, lead_seq{out}, min({{'n': -round(p, 9), 'l': label}}).l AS label, max(p) AS confidence FROM post GROUP BY ALL)"""


POST_SQL = _posterior_sql(False)


def votes_of(t):
    return U.cut(U.cluster_votes(clusters(t), ITEM))


def posterior(t, votes, **kw):
    return U.fuse_labels(votes, voters(t), t.reliabilities, U.class_priors(t.golden, t.items), ITEM, **kw)


@query("label_posterior", f"{POST_SQL} SELECT item_id, lead_annotator, lead_seq, label, round(p, 6) AS p FROM post")
def label_posterior(t):
    rows = U.full_posterior(posterior(t, votes_of(t)), U.class_priors(t.golden, t.items), ITEM)
    return rows.select(*KEY, "label", R6("p"))


@query("fuse_labels", f"{POST_SQL} SELECT item_id, lead_annotator, lead_seq, label, round(confidence, 6) AS confidence FROM best")
def fuse_labels(t):
    return posterior(t, votes_of(t)).select(*KEY, "label", R6("confidence"))


@query("fuse_labels_without", f"""{_posterior_sql(True)} SELECT item_id, lead_annotator, lead_seq, out_id AS annotator_id,
   label, round(confidence, 6) AS confidence FROM best
   WHERE (item_id, out_id) IN (SELECT item_id, annotator_id FROM voters)""")
def fuse_labels_without(t):
    got = posterior(t, votes_of(t), without="annotator_id")
    return got.select(*KEY, "annotator_id", "label", R6("confidence"))


BOX_SQL = f"""{POST_SQL}, mean AS (SELECT item_id, lead_annotator, lead_seq, count(*) AS votes, """ + ", ".join(
    f"sum(weight * {c}) / sum(weight) AS f_{c}, list_sort(list({c}))[(count(*) // 2 + 1)::INT] AS m_{c}"
    for c in ("x1", "y1", "x2", "y2")) + f""" FROM vote GROUP BY ALL),
 mi AS (SELECT v.item_id, v.lead_annotator, v.lead_seq, avg({Q.iou('v', 'm')}) AS mean_iou FROM vote v
   JOIN (SELECT item_id, lead_annotator, lead_seq, m_x1 AS x1, m_y1 AS y1, m_x2 AS x2, m_y2 AS y2 FROM mean) m
   USING (item_id, lead_annotator, lead_seq) GROUP BY ALL),
 boxes AS (SELECT * FROM mean JOIN mi USING (item_id, lead_annotator, lead_seq))"""


@query("fuse_boxes", f"{BOX_SQL} SELECT item_id, lead_annotator, lead_seq, votes, " + ", ".join(
    f"round(f_{c} + 1e-9, 6) AS f_{c}, m_{c}" for c in ("x1", "y1", "x2", "y2")) + ", round(mean_iou, 6) AS mean_iou FROM boxes")
def fuse_boxes(t):
    sides = ("x1", "y1", "x2", "y2")
    return U.fuse_boxes(votes_of(t), ITEM).select(
        *KEY, "votes", *[F.round(F.col("f_" + c) + 1e-9, 6).alias("f_" + c) for c in sides], *["m_" + c for c in sides], R6("mean_iou"))


GATE_SQL = f"""{BOX_SQL}, nv AS (SELECT item_id, count(*) AS n_voters FROM voters GROUP BY 1),
 sup AS (SELECT b.item_id, b.lead_annotator, b.lead_seq, count(v.label) AS support FROM best b
   LEFT JOIN vote v ON v.item_id = b.item_id AND v.lead_annotator = b.lead_annotator AND v.lead_seq = b.lead_seq
    AND v.label = b.label GROUP BY ALL),
 gated AS (SELECT b.*, bx.* EXCLUDE (item_id, lead_annotator, lead_seq), support, n_voters,
  CASE WHEN support < {CFG.min_object_votes} THEN 'insufficient_object_votes'
   WHEN support / n_voters < {CFG.min_support_ratio} THEN 'insufficient_object_support_ratio'
   WHEN confidence < {CFG.accept_confidence} THEN 'low_class_confidence'
   WHEN n_voters < {CFG.min_voters} THEN 'insufficient_miners_on_image'
   WHEN mean_iou < {CFG.min_mean_iou} THEN 'high_spatial_disagreement'
   WHEN (f_x2 - f_x1) * (f_y2 - f_y1) / (1024 * 256) >= {CFG.max_box_ratio} THEN 'large_box_requires_review' END AS reason
  FROM best b JOIN boxes bx USING (item_id, lead_annotator, lead_seq) JOIN sup USING (item_id, lead_annotator, lead_seq)
  JOIN nv USING (item_id))"""


def fused(t, cfg=CFG):
    return U.fuse(public(t), t.reliabilities, U.class_priors(t.golden, t.items), t.items, t.annotators, t.averages,
                  cfg, ITEM, t.annotations)


@query("gate_objects", f"""{GATE_SQL} SELECT item_id, lead_annotator, lead_seq, label, support, n_voters,
   round(confidence, 6) AS confidence, reason FROM gated WHERE n_voters >= 3""")
def gate_objects(t):
    return fused(t)["objects"].select(*KEY, "label", "support", "n_voters", R6("confidence"), "reason")


CREDIT_SQL = f"""{GATE_SQL}, backing AS (SELECT v.item_id, v.annotator_id, v.weight / sum(v.weight) OVER
   (PARTITION BY v.item_id, v.lead_annotator, v.lead_seq) AS c FROM vote v JOIN gated g ON g.item_id = v.item_id
   AND g.lead_annotator = v.lead_annotator AND g.lead_seq = v.lead_seq AND g.label = v.label
   WHERE g.reason IS NULL AND g.n_voters >= 3),
 summed AS (SELECT item_id, annotator_id, sum(c) AS s FROM backing GROUP BY item_id, annotator_id),
 credit AS (SELECT item_id, annotator_id, s / sum(s) OVER (PARTITION BY item_id) AS contribution FROM summed)"""


@query("contributions", f"{CREDIT_SQL} SELECT item_id, annotator_id, round(contribution + 1e-9, 6) AS contribution FROM credit")
def contributions(t):
    parts = fused(t)
    return U.contributions(parts["votes"], parts["objects"], t.reliabilities, ITEM).select(
        "item_id", "annotator_id", F.round(F.col("contribution") + 1e-9, 6).alias("contribution"))


def _items_sql(fallback: bool) -> str:
    tail = f"""SELECT item_id, voters, objects, chosen, reason, round(score, 6) AS score, method, coverage_pct, net_weight
   FROM fin"""
    plain = """fin AS (SELECT * FROM noft)"""
    adopt = """kn AS (SELECT item_id, annotator_id, count(*) AS n FROM kept GROUP BY ALL),
 fb AS (SELECT * FROM (SELECT kn.*, av.avg_fidelity AS rel, row_number() OVER (PARTITION BY item_id ORDER BY avg_fidelity
   DESC, annotator_id) AS rn FROM kn JOIN averages av USING (annotator_id)) WHERE rn = 1 AND rel >= 0.9),
 fin AS (SELECT o.item_id, voters, CASE WHEN use THEN fb.n ELSE objects END AS objects,
   CASE WHEN use THEN fb.annotator_id ELSE chosen END AS chosen, CASE WHEN use THEN NULL ELSE reason END AS reason,
   CASE WHEN use THEN rel ELSE score END AS score, CASE WHEN use THEN 'single_miner_fallback_v1' ELSE method END AS method,
   coverage_pct, net_weight FROM (SELECT noft.*, reason IS NOT NULL AND item_id IN (SELECT item_id FROM fb) AS use FROM noft) o
   LEFT JOIN fb USING (item_id))"""
    return f"""{CREDIT_SQL},
 live AS (SELECT item_id, lead_annotator, lead_seq, label, f_x1 AS x1, f_y1 AS y1, f_x2 AS x2, f_y2 AS y2 FROM gated
   WHERE reason IS NULL AND n_voters >= 3),
 tch AS (SELECT DISTINCT a.item_id, a.lead_annotator, a.lead_seq FROM live a JOIN live b ON a.item_id = b.item_id
   AND (a.lead_annotator <> b.lead_annotator OR a.lead_seq <> b.lead_seq)
   AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2),
 ob AS (SELECT g.*, coalesce(reason, CASE WHEN t.item_id IS NOT NULL THEN 'overlapping_object_clusters_requires_review'
    END) AS why FROM gated g LEFT JOIN tch t USING (item_id, lead_annotator, lead_seq) WHERE n_voters >= 3),
 it AS (SELECT item_id, nullif(string_agg(DISTINCT why, ';' ORDER BY why), '') AS reasons, count(*) AS objects,
   avg(confidence) AS mc FROM ob GROUP BY 1),
 ld AS (SELECT item_id, arg_max(annotator_id, contribution - annotator_id / 1e9) AS leader FROM credit GROUP BY 1),
 fst AS (SELECT item_id, count(*) AS n, min(annotator_id) AS f FROM voters GROUP BY 1),
 good AS (SELECT ob.item_id, label, f_x1 AS x1, f_y1 AS y1, f_x2 AS x2, f_y2 AS y2 FROM ob WHERE why IS NULL
   AND label <> '_background'),
 cov AS (SELECT item_id, round_even(least(1.0, sum((x2 - x1) * (y2 - y1)) / (1024 * 256)) * 100, 2) AS coverage_pct,
   round_even(sum(round_even((x2 - x1) * (y2 - y1), 2) / (1024 * 256) * {Q.multiplier('label')}), 6) AS net_weight
   FROM good GROUP BY 1),
 w AS (SELECT fst.item_id, n AS voters, coalesce(objects, 0) AS objects, CASE WHEN n < 2 OR n < 3 THEN f
   ELSE coalesce(leader, -1) END AS chosen, CASE WHEN n < 2 THEN 'only_one_miner' WHEN n < 3 THEN 'insufficient_miners_on_image'
   WHEN objects IS NULL THEN 'no_clusters' ELSE reasons END AS reason, mc FROM fst LEFT JOIN it USING (item_id)
   LEFT JOIN ld USING (item_id)),
 noft AS (SELECT w.item_id, voters, objects, chosen, reason, CASE WHEN reason IS NULL THEN mc ELSE 0 END AS score,
   'bayesian_dawid_skene_v1' AS method, CASE WHEN reason IS NULL THEN coalesce(coverage_pct, 0.0) END AS coverage_pct,
   net_weight FROM w LEFT JOIN cov USING (item_id)),
 {adopt if fallback else plain} {tail}"""


def _assembled(t, cfg):
    got = U.assemble_items(fused(t, cfg), t.reliabilities, t.averages, t.items, cfg, ITEM)
    return got.select("item_id", "voters", "objects", "chosen", "reason", R6("score"), "method", "coverage_pct", "net_weight")


@query("assemble_items", _items_sql(False))
def assemble_items(t):
    return _assembled(t, CFG)


@query("assemble_items_fallback", _items_sql(True))
def assemble_items_fallback(t):
    return _assembled(t, CFG_FALLBACK)


@query("fallback_top_annotator", f"""{BASE}, {VOTER_SQL}, kn AS (SELECT item_id, annotator_id, count(*) AS n FROM pub
    SEMI JOIN voters USING (item_id, annotator_id) GROUP BY ALL)
  SELECT item_id, annotator_id AS fallback_annotator, rel AS reliability, n AS fallback_objects FROM (SELECT kn.*,
    av.avg_fidelity AS rel, row_number() OVER (PARTITION BY item_id ORDER BY avg_fidelity DESC, annotator_id) AS rn
    FROM kn JOIN averages av USING (annotator_id)) WHERE rn = 1 AND rel >= 0.9""")
def fallback_top_annotator(t):
    return U.fallback_top_annotator(kept(t), t.averages, CFG_FALLBACK, ITEM)


@query("overlapping_objects", f"""{Q.with_tables('annotations')},
  o AS (SELECT DISTINCT round_num, item_id, annotator_id, seq, x1, y1, x2, y2 FROM annotations)
  SELECT DISTINCT a.round_num, a.item_id, a.annotator_id, a.seq FROM o a JOIN o b ON a.round_num = b.round_num
   AND a.item_id = b.item_id AND a.annotator_id = b.annotator_id AND a.seq <> b.seq
   AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2""")
def overlapping_objects(t):
    return M.overlapping_objects(t.annotations, "seq", list(S.SUBMISSION))


@query("golden_winners", MISSING_SQL + """ SELECT item_id, round_num, annotator_id, round(fidelity, 5) AS score FROM (
   SELECT *, row_number() OVER (PARTITION BY round_num, item_id ORDER BY fidelity DESC, annotator_id) AS rn FROM filled)
   WHERE rn = 1""")
def golden_winners(t):
    return U.golden_winners(_filled(t)[1]).select("round_num", "item_id", "annotator_id", F.round("score", 5).alias("score"))


@query("union_area", f"""{Q.with_tables('annotations')},
  xs AS (SELECT DISTINCT item_id, x1 AS x FROM annotations UNION SELECT DISTINCT item_id, x2 FROM annotations),
  slabs AS (SELECT item_id, x AS a, lead(x) OVER (PARTITION BY item_id ORDER BY x) AS b FROM xs),
  cut AS (SELECT DISTINCT s.item_id, s.a, s.b, n.y1, n.y2 FROM slabs s JOIN annotations n ON n.item_id = s.item_id
    AND n.x1 <= s.a AND n.x2 >= s.b WHERE s.b IS NOT NULL),
  runs AS (SELECT *, max(y2) OVER (PARTITION BY item_id, a ORDER BY y1, y2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    AS reach FROM cut)
  SELECT item_id, round(sum((b - a) * greatest(0, y2 - greatest(y1, coalesce(reach, y1)))), 4) AS union_area
  FROM runs GROUP BY item_id""")
def union_area(t):
    return M.union_area(t.annotations, ITEM).select("item_id", F.round("union_area", 4).alias("union_area"))


@query("nms", f"""{Q.with_tables('annotations')},
 {Q.anchors('n', 'annotations', ITEM, 'confidence DESC, annotator_id, seq', 0.45)}
 SELECT item_id, annotator_id, seq, confidence FROM n WHERE anchor = k""")
def nms(t):
    return M.nms(t.annotations, ITEM).select("item_id", "annotator_id", "seq", "confidence")


@query("nms_strict", f"""{Q.with_tables('annotations')},
 {Q.anchors('n', 'annotations', ['item_id'], 'confidence DESC, annotator_id, seq', 0.6, '>')}
 SELECT item_id, annotator_id, seq, confidence FROM n WHERE anchor = k""")
def nms_strict(t):
    return M.nms(t.annotations, ITEM, 0.6, strict=True).select("item_id", "annotator_id", "seq", "confidence")


@query("merge_tiles", f"""{Q.with_tables('annotations')},
 u AS (SELECT item_id, annotator_id, seq, confidence, x1 + 100 * (seq % 2) AS x1, y1 + 20 * (annotator_id % 2) AS y1,
   x2 + 100 * (seq % 2) AS x2, y2 + 20 * (annotator_id % 2) AS y2 FROM annotations WHERE status = 'A'
  UNION ALL SELECT item_id, annotator_id, seq, confidence, x1, y1, x2, y2 FROM annotations WHERE status <> 'A'),
 {Q.anchors('n', 'u', ['item_id'], 'confidence DESC, annotator_id, seq', 0.45)}
 SELECT item_id, annotator_id, seq, x1, y1, x2, y2 FROM n WHERE anchor = k""")
def merge_tiles(t):
    cols = ["item_id", "annotator_id", "seq", "confidence", "x1", "y1", "x2", "y2"]
    tiles = t.annotations.where("status = 'A'").select(
        *cols, (F.col("seq") % 2 * 100).cast("double").alias("tile_x"),
        (F.col("annotator_id") % 2 * 20).cast("double").alias("tile_y"))
    whole = t.annotations.where("status <> 'A'").select(*cols)
    return M.merge_tiles(tiles, whole, ITEM, tie=("annotator_id", "seq")).select(*[c for c in cols if c != "confidence"])
