"""Queries: validity checks, gates, limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.functions import geometry as G
from labelloom.operators import score as S
from labelloom.operators import validate as V
from labelloom.operators.assemble import assemble_selected
from labelloom.operators.reward import hamilton
from labelloom.plans import sqltext as Q
from labelloom.plans.registry import query

SUB = list(S.SUBMISSION)

# Each annotation gets one defect by its key.
KIND = "seq % 13"
DAMAGE = f"""SELECT item_id, annotator_id, seq, label, shape,
  x1, CASE WHEN {KIND} = 1 THEN CAST('NaN' AS DOUBLE) ELSE y1 END AS y1, CASE WHEN {KIND} = 2 THEN x1 ELSE x2 END AS x2, y2,
  CASE WHEN {KIND} = 3 THEN CAST(-1 AS DOUBLE) ELSE CAST(100 AS DOUBLE) END AS area,
  CASE WHEN {KIND} = 4 THEN CAST('Infinity' AS DOUBLE) END AS weight,
  CASE WHEN {KIND} = 5 THEN CAST(1.5 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS confidence, {KIND} AS kind"""


def damaged(t):
    t.outlined.createOrReplaceTempView("_outlined")
    df = t.spark.sql(DAMAGE + ", polygon AS poly FROM _outlined")
    poly = F.col("poly")
    bow = F.when(F.col("kind") == 7, F.array(G.point(F.col("x1"), F.col("y1")), G.point(F.col("x2"), F.col("y2")),
                                             G.point(F.col("x2"), F.col("y1")), G.point(F.col("x1"), F.col("y2"))))
    return df.withColumn("polygon", F.when(F.col("kind") == 6, F.slice(poly, 1, 2)).when(F.col("kind") == 7, bow).when(
        F.col("kind") == 8, F.transform(poly, lambda p: G.point(p["x"] + 10, p["y"]))).when(
        (F.col("kind") == 9) & (F.col("shape") != "star"), F.transform(poly, lambda p: G.point(F.col("x1"), p["y"]))).otherwise(poly))


# Which defect shows as which error: a NaN or collapsed box also spoils the polygon tests that need it.
@query("validate_annotations", f"""{Q.with_tables('annotations')}, d AS (SELECT seq, item_id, annotator_id, shape, {KIND} AS kind
   FROM annotations)
 SELECT item_id, annotator_id, seq, concat_ws(',',
  CASE WHEN kind = 1 THEN 'box_not_finite' END, CASE WHEN kind = 2 THEN 'box_not_positive' END,
  CASE WHEN kind = 3 THEN 'bad_area' END, CASE WHEN kind = 4 THEN 'bad_weight' END, CASE WHEN kind = 5 THEN 'bad_confidence' END,
  CASE WHEN kind = 6 AND shape <> 'none' THEN 'polygon_too_short' END,
  CASE WHEN shape <> 'none' AND kind = 2 THEN 'polygon_outside_box' WHEN kind = 8 AND shape IN ('rect', 'octagon', 'star')
    THEN 'polygon_outside_box' END,
  CASE WHEN (kind = 9 AND shape NOT IN ('none', 'star')) OR kind = 7 THEN 'polygon_without_area' END,
  CASE WHEN kind = 7 OR (kind = 9 AND shape NOT IN ('none', 'star')) THEN 'polygon_crosses_itself' END) AS errors
 FROM d""")
def validate_annotations(t):
    bad = V.validate_annotations(damaged(t))
    return bad.select("item_id", "annotator_id", "seq", F.array_join("errors", ",").alias("errors"))


@query("self_intersections", f"""{Q.with_tables('annotations')} SELECT item_id, annotator_id, seq FROM annotations
   WHERE {KIND} = 7 OR ({KIND} = 9 AND shape NOT IN ('none', 'star'))""")
def self_intersections(t):
    return G.crossing_edges(damaged(t), ["item_id", "annotator_id", "seq"])


# Orders are submissions of customers to tasks; their lines are the records.
SUBS_SQL = """subs AS (SELECT o_orderkey AS submission_id, o_custkey % 60 AS task_id,
   'n' || (o_custkey % 60 + CASE WHEN o_orderkey % 20 = 0 THEN 1 ELSE 0 END) AS nonce,
   CASE WHEN o_orderkey % 33 = 0 THEN 9 ELSE 1 END AS batch_id,
   CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN NULL ELSE 'a' || o_orderkey END AS artifact FROM orders),
 tasks AS (SELECT n_nationkey * 2 + k AS task_id, 'n' || (n_nationkey * 2 + k) AS nonce, 1 AS batch_id FROM nation
   CROSS JOIN (VALUES (0), (1)) v(k)),
 records AS (SELECT l_orderkey AS submission_id, l_linenumber AS record_id, l_partkey % 40 AS item_id FROM lineitem),
 dup AS (SELECT DISTINCT submission_id FROM (SELECT submission_id, item_id FROM (SELECT DISTINCT submission_id, record_id,
   item_id FROM records) GROUP BY ALL HAVING count(*) > 1)),
 verdict AS (SELECT s.submission_id, CASE WHEN t.task_id IS NULL THEN 'unknown_task' WHEN s.nonce <> t.nonce THEN
   'nonce_mismatch' WHEN s.batch_id <> t.batch_id THEN 'batch_mismatch' WHEN artifact IS NULL THEN 'missing_artifact'
   WHEN d.submission_id IS NOT NULL THEN 'duplicate_record' END AS reason FROM subs s LEFT JOIN tasks t USING (task_id)
   LEFT JOIN dup d USING (submission_id))"""


def _submissions(t):
    subs = t.raw("orders").selectExpr(
        "o_orderkey AS submission_id", "o_custkey % 60 AS task_id",
        "concat('n', o_custkey % 60 + CASE WHEN o_orderkey % 20 = 0 THEN 1 ELSE 0 END) AS nonce",
        "CASE WHEN o_orderkey % 33 = 0 THEN 9 ELSE 1 END AS batch_id",
        "CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN NULL ELSE concat('a', o_orderkey) END AS artifact")
    tasks = t.raw("nation").select("n_nationkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).selectExpr(
        "CAST(n_nationkey * 2 + k AS BIGINT) AS task_id", "concat('n', n_nationkey * 2 + k) AS nonce", "1 AS batch_id")
    records = t.raw("lineitem").selectExpr(
        "l_orderkey AS submission_id", "l_linenumber AS record_id", "l_partkey % 40 AS item_id",
        "CAST(l_quantity * 40 AS DOUBLE) - 100D AS x1", "CAST(l_suppkey AS DOUBLE) AS y1",
        "CAST(l_quantity * 40 AS DOUBLE) + 20D AS x2", "CAST(l_suppkey + 50 AS DOUBLE) AS y2")
    return subs, records, tasks


@query("gate_submissions", f"WITH {SUBS_SQL} SELECT * FROM verdict")
def gate_submissions(t):
    subs, records, tasks = _submissions(t)
    return V.gate_submissions(subs, records, tasks, t.items)[1]


@query("gate_records", f"""WITH {SUBS_SQL} SELECT r.l_orderkey AS submission_id, count(*) AS records,
   round(sum(greatest(0, least(1024, l_quantity * 40 - 100))), 2) AS x1_sum,
   round(sum(greatest(0, least(1024, l_quantity * 40 + 20))), 2) AS x2_sum,
   round(sum(greatest(0, least(256, l_suppkey + 50))), 2) AS y2_sum
  FROM lineitem r SEMI JOIN (SELECT submission_id FROM verdict WHERE reason IS NULL) v ON v.submission_id = r.l_orderkey
  GROUP BY 1""")
def gate_records(t):
    subs, records, tasks = _submissions(t)
    good = V.gate_submissions(subs, records, tasks, t.items)[0]
    return good.groupBy("submission_id").agg(
        F.count("*").alias("records"), F.round(F.sum("x1"), 2).alias("x1_sum"), F.round(F.sum("x2"), 2).alias("x2_sum"),
        F.round(F.sum("y2"), 2).alias("y2_sum"))


@query("check_limits", f"""{Q.with_tables('annotations')}, p AS (SELECT *, CASE shape WHEN 'none' THEN 0 WHEN 'rect' THEN 4
   WHEN 'star' THEN 14 ELSE 8 END AS np FROM annotations),
  i AS (SELECT annotator_id, item_id, count(*) AS n, sum(np * np) AS work, max((x2 - x1) * (y2 - y1) / (1024 * 256)) AS ratio
    FROM p GROUP BY ALL),
  s AS (SELECT annotator_id, count(*) AS records, max(n) AS max_annotations, CAST(sum(work) AS BIGINT) AS vertex_work,
    max(ratio) AS mr FROM i GROUP BY ALL)
  SELECT annotator_id, records, max_annotations, vertex_work, round(mr, 6) AS max_area_ratio, concat_ws(',',
    CASE WHEN max_annotations > 3 THEN 'too_many_annotations' END, CASE WHEN records > 520 THEN 'too_many_records' END,
    CASE WHEN vertex_work > 40000 THEN 'too_many_vertices' END, CASE WHEN mr > 0.0161 THEN 'oversized_box' END) AS errors FROM s""")
def check_limits(t):
    got = V.check_limits(t.outlined, t.items, ["annotator_id"], 3, 520, 40000, 0.0161)
    return got.withColumn("max_area_ratio", F.round("max_area_ratio", 6))


@query("clean_detections", f"""{Q.with_tables('annotations')}, m AS (SELECT item_id, annotator_id, seq, confidence,
   least(1024.0, x1 * 2) AS x1, y1, least(1024.0, x2 * 2) AS x2, least(256.0, y2 * 3) AS y2 FROM annotations),
  g AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY confidence DESC, annotator_id, seq) AS rank FROM m
   WHERE x2 > x1 AND y2 > y1 AND (x2 - x1) * (y2 - y1) / (1024 * 256) < 0.11)
  SELECT * FROM g WHERE rank <= 8""")
def clean_detections(t):
    moved = t.annotations.select("item_id", "annotator_id", "seq", "confidence", (F.col("x1") * 2).alias("x1"), "y1",
                                 (F.col("x2") * 2).alias("x2"), (F.col("y2") * 3).alias("y2"))
    return V.clean_detections(moved, t.items, keep=8, max_ratio=0.11)


@query("validate_selected", f"""{Q.with_tables('annotations', 'items')},
  a AS (SELECT round_num, item_id, annotator_id, label, shape, CASE WHEN seq % 31 = 0 THEN 0 ELSE x1 END AS x1,
     CASE WHEN seq % 31 = 0 THEN 0 ELSE y1 END AS y1, CASE WHEN seq % 31 = 0 THEN 1024 ELSE x2 END AS x2,
     CASE WHEN seq % 31 = 0 THEN 256 ELSE y2 END AS y2, CASE WHEN seq % 17 = 0 THEN 2.0 ELSE confidence END AS confidence,
     seq FROM annotations),
  {Q.audit('audit', '(SELECT * FROM annotations)', SUB)},
  g AS (SELECT round_num, item_id, annotator_id, count(*) AS annotations, count(*) FILTER (confidence > 1 OR
      y1 < 0 OR x2 > 1024) AS invalid, max((seq % 31 = 0)::INT) AS fullf FROM a GROUP BY ALL),
  c AS (SELECT round_num, item_id, annotator_id, max(k) AS copies FROM (SELECT round_num, item_id, annotator_id, label, x1, y1, x2,
      y2, CASE WHEN shape = 'none' THEN 'none' ELSE 'f' || shape || CASE WHEN seq % 31 = 0 THEN seq::VARCHAR ELSE '' END END,
      count(*) AS k FROM a GROUP BY ALL) GROUP BY ALL)
  SELECT round_num, item_id, annotator_id, annotations, invalid, nullif(array_to_string(list_sort(list_filter([
     CASE WHEN annotator_id % 9 = 0 THEN 'selection_policy_not_accepted' END, CASE WHEN NOT acceptable THEN coalesce(reason, 'geometric_quality_audit_failed') END,
     CASE WHEN fullf = 1 THEN 'full_frame_box_requires_review' END,
     CASE WHEN copies > 1 THEN 'duplicate_annotation_requires_review' END], lambda v: v IS NOT NULL)), ','), '') AS reason,
   annotator_id % 9 <> 0 AND acceptable AND fullf = 0 AND copies <= 1 AS selection_accepted
  FROM g JOIN c USING (round_num, item_id, annotator_id) JOIN audit USING (round_num, item_id, annotator_id)""")
def validate_selected(t):
    full = F.col("seq") % 31 == 0
    anns = t.outlined.withColumn("confidence", F.when(F.col("seq") % 17 == 0, 2.0).otherwise(F.col("confidence")))
    audit = S.audit_geometry(t.outlined)
    moved = anns.select(
        *SUB, "seq", "label", "polygon", "confidence", *[F.when(full, float(v)).otherwise(F.col(c)).alias(c)
                                                         for c, v in (("x1", 0), ("y1", 0), ("x2", 1024), ("y2", 256))])
    chosen = t.annotations.select(*SUB).distinct().withColumn("policy_accepted", F.col("annotator_id") % 9 != 0)
    return V.validate_selected(moved, t.items, audit, SUB, chosen)


REC = ["item_id", "annotator_id"]
PICKED = f"""{Q.with_tables('annotations', 'items', 'averages')},
  sel AS (SELECT item_id, min(annotator_id) AS annotator_id FROM annotations GROUP BY 1),
  mine AS (SELECT a.*, {Q.canonical('label')} AS cl FROM annotations a JOIN sel USING (item_id, annotator_id))"""


def _picked(t):
    selected = t.annotations.groupBy("item_id").agg(F.min("annotator_id").alias("annotator_id")).withColumn(
        "policy_accepted", F.col("annotator_id") % 9 != 0)
    thirds = t.averages.withColumn("avg_fidelity", F.col("avg_fidelity") / 3)
    people = t.annotators.select("annotator_id", F.col("owner_id").alias("identity"))
    return assemble_selected(selected, t.outlined, t.items, people, thirds)


@query("assemble_selected", f"""{PICKED}, {Q.audit('audit', 'mine', REC)},
  g AS (SELECT item_id, annotator_id, count(*) AS annotations, round_even(sum((x2 - x1) * (y2 - y1) / (width * height) * {Q.multiplier('cl')}), 6) AS net_weight,
     sum(least(1.0, confidence) * 100) / sum(100) AS mconf FROM mine JOIN items USING (item_id) GROUP BY ALL),
  c AS (SELECT item_id, annotator_id, max(k) AS copies FROM (SELECT item_id, annotator_id, label, x1, y1, x2, y2, shape, count(*) AS k FROM mine GROUP BY ALL) GROUP BY ALL),
  xs AS (SELECT DISTINCT item_id, x1 AS x FROM mine UNION SELECT DISTINCT item_id, x2 FROM mine),
  slabs AS (SELECT item_id, x AS a, lead(x) OVER (PARTITION BY item_id ORDER BY x) AS b FROM xs),
  cut AS (SELECT DISTINCT s.item_id, s.a, s.b, n.y1, n.y2 FROM slabs s JOIN mine n ON n.item_id = s.item_id AND n.x1 <= s.a AND n.x2 >= s.b WHERE s.b IS NOT NULL),
  runs AS (SELECT *, max(y2) OVER (PARTITION BY item_id, a ORDER BY y1, y2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM cut),
  u AS (SELECT item_id, sum((b - a) * greatest(0, y2 - greatest(y1, coalesce(reach, y1)))) AS area FROM runs GROUP BY 1),
  r AS (SELECT item_id, annotator_id, annotations, net_weight, round_even((0.35 * avg_fidelity / 3 + 0.25 * mconf + 0.25 * (0.45 * round(mq, 4) + 0.55 * round(mc, 4)) + 0.135) * quality, 4) AS score,
     nullif(array_to_string(list_sort(list_filter([CASE WHEN annotator_id % 9 = 0 THEN 'selection_policy_not_accepted' END,
       CASE WHEN NOT acceptable THEN coalesce(reason, 'geometric_quality_audit_failed') END,
       CASE WHEN copies > 1 THEN 'duplicate_annotation_requires_review' END], lambda v: v IS NOT NULL)), ','), '') AS reason, round_even(least(1, area / (width * height)) * 100, 2) AS coverage_pct
   FROM g JOIN c USING (item_id, annotator_id) JOIN audit USING (item_id, annotator_id) JOIN u USING (item_id) JOIN items USING (item_id) JOIN averages USING (annotator_id))
  SELECT item_id, annotator_id, annotations, net_weight, score, reason, coverage_pct, reason IS NULL AS accepted FROM r""")
def assemble_selected_rows(t):
    return _picked(t)[0].select("item_id", "annotator_id", "annotations", "net_weight", "score", "reason", "coverage_pct", "accepted")


@query("selected_objects", f"""{PICKED}, o AS (SELECT *, row_number() OVER (PARTITION BY item_id, annotator_id ORDER BY seq) - 1 AS i FROM mine)
  SELECT item_id, annotator_id, seq, substr(sha256(item_id || ':' || annotator_id || ':' || i), 1, 16) AS cluster_id, {Q.severity('label')} AS severity,
   (x2 - x1) * (y2 - y1) AS area, round((x2 - x1) * (y2 - y1) / (width * height), 9) AS weight FROM o JOIN items USING (item_id)""")
def selected_objects(t):
    return _picked(t)[1].select("item_id", "annotator_id", "seq", "cluster_id", "severity", "area", F.round("weight", 9).alias("weight"))


# The public flag of an item stands in for the assembled result.
@query("exportable", f"""{Q.with_tables('items')} SELECT item_id FROM items WHERE role = 'public' AND item_id % 7 <> 0""")
def exportable(t):
    rows = t.items.select("item_id", (F.col("role") != "public").alias("is_golden"),
                          (F.col("item_id") % 7 == 0).alias("escalated"))
    return V.exportable(rows).select("item_id")


@query("golden_leaks", f"{Q.with_tables('items')} SELECT item_id FROM items WHERE role <> 'public'")
def golden_leaks(t):
    return V.golden_leaks(t.items.select("item_id"), t.items)


@query("eligible_participants", """SELECT s_suppkey AS annotator_id FROM supplier WHERE s_nationkey % 3 <> 0
   AND NOT (s_nationkey % 2 = 0 AND s_acctbal > 4096)""")
def eligible_participants(t):
    people = t.annotators.select("annotator_id", "stake", (F.col("owner_id") % 3 != 0).alias("serving"),
                                 (F.col("owner_id") % 2 == 0).alias("permit"))
    return V.eligible_participants(people).select("annotator_id")


@query("export_schema_check", """SELECT p_partkey AS item_id, unnest(list_filter([
   CASE WHEN p_partkey % 5 = 1 THEN 'missing_root_keys' END, CASE WHEN p_partkey % 5 = 2 THEN 'bad_image_url' END,
   CASE WHEN p_partkey % 5 = 3 THEN 'accepted_without_objects' END,
   CASE WHEN p_partkey % 7 = 2 AND p_partkey % 5 <> 3 THEN 'missing_object_keys' END,
   CASE WHEN p_partkey % 7 = 4 AND p_partkey % 5 <> 3 THEN 'missing_vote_keys' END,
   CASE WHEN p_partkey % 11 = 6 THEN 'audit_hash_mismatch' END], lambda v: v IS NOT NULL)) AS error FROM part""")
def export_schema_check(t):
    from labelloom.sources.sinks import export_json, export_row

    i = F.col("p_partkey")
    vote = F.struct(*[F.lit("v").alias(k) for k in V.VOTE_KEYS[1:]], F.when(i % 7 != 4, "1").alias(V.VOTE_KEYS[0]))
    obj = F.struct(*[F.lit("o").alias(k) for k in V.OBJECT_KEYS if k not in ("miner_votes", "accepted_severity")],
                   F.when(i % 7 != 2, "low").alias("accepted_severity"), F.array(vote).alias("miner_votes"))
    objects = F.when(i % 5 == 3, F.array().cast("array<string>"))
    root = [F.lit("x").alias(k) for k in V.ROOT_KEYS if k not in (
        "audit_hash", "objects", "image_url", "annotated_image_url", "escalation_required", "timestamp")]
    url = F.concat(F.when(i % 5 == 2, "file:///").otherwise("https://h/"), F.col("p_name"))
    row = F.to_json(F.struct(
        *root, F.when(i % 5 != 1, "t").alias("timestamp"), F.lit(False).alias("escalation_required"), url.alias("image_url"),
        F.lit("https://h/a").alias("annotated_image_url"), F.when(i % 5 != 3, F.array(obj)).alias("objects")))
    # A null objects field is dropped by to_json, so empty ones are written out.
    row = F.when(objects.isNotNull(), F.replace(row, F.lit('{"image_id"'), F.lit('{"objects":[],"image_id"'))).otherwise(row)
    rows = export_row(t.raw("part").select(i.alias("item_id"), row.alias("value")))
    spoiled = F.when(F.col("item_id") % 11 == 6, F.replace("value", F.lit('"score":"x"'), F.lit('"score":"y"')))
    rows = rows.withColumn("value", F.coalesce(spoiled, "value"))
    return V.check_export_schema(export_json(rows), "item_id")


@query("reward_row_gate", """WITH r AS (SELECT DISTINCT year(l_shipdate) AS round_num, l_partkey AS item_id, l_suppkey AS chosen FROM lineitem),
  f AS (SELECT *, (chosen * 17 % 100) / 100.0 AS fid FROM r),
  b AS (SELECT round_num, count(*) AS n, count(*) FILTER (NOT (fid >= 0.05 AND round_num % 2 = 0)) AS bad FROM f GROUP BY 1),
  rep AS (SELECT round_num, count(*) AS repeated FROM (SELECT round_num, item_id FROM f GROUP BY ALL HAVING count(*) > 1) GROUP BY 1),
  mis AS (SELECT round_num, count(*) AS mismatched FROM r LEFT JOIN (SELECT round_num, item_id, chosen AS supplied FROM r WHERE item_id % 50 <> 3) s
     USING (round_num, item_id) WHERE chosen IS DISTINCT FROM supplied GROUP BY 1),
  cap AS (SELECT round_num, chosen, count(*) AS used, count(*) - (chosen % 20 = 1)::INT AS cap FROM r GROUP BY round_num, chosen),
  k AS (SELECT round_num, sum(cap) AS cap_total, count(*) FILTER (used > cap) AS over_cap FROM cap GROUP BY 1)
  SELECT b.round_num, n AS rows, bad AS bad_rows, coalesce(repeated, 0) AS repeated, coalesce(mismatched, 0) AS mismatched, over_cap, CAST(cap_total AS BIGINT) AS cap_total,
   round_num % 3 <> 0 AND over_cap = 0 AS caps_sound, bad = 0 AND repeated IS NULL AND mismatched IS NULL AND round_num % 3 <> 0 AND over_cap = 0 AS valid
  FROM b LEFT JOIN rep USING (round_num) LEFT JOIN mis USING (round_num) JOIN k USING (round_num)""")
def reward_row_gate(t):
    picked = t.raw("lineitem").selectExpr("year(l_shipdate) AS round_num", "l_partkey AS item_id", "l_suppkey AS chosen").distinct()
    rows = picked.selectExpr(
        "*", "(chosen * 17 % 100) / 100.0D AS score", "'vision_model_selection_v1' AS method", "true AS accepted",
        "false AS is_golden", "false AS escalated", "1 AS contributors", "1.0D AS contribution",
        "round_num % 2 = 0 AS objects_ok")
    rounds = picked.groupBy("round_num").agg(F.count("*").alias("public_count"))
    fid = t.averages.withColumnRenamed("avg_fidelity", "fidelity").crossJoin(F.broadcast(rounds.select("round_num")))
    # Some items come without a source, some annotators have one slot too few, and every third round another public count.
    supplied = picked.where("item_id % 50 <> 3").withColumnRenamed("chosen", "annotator_id")
    caps = picked.groupBy("round_num", F.col("chosen").alias("annotator_id")).agg(F.count("*").alias("cap")).withColumn(
        "cap", F.col("cap") - (F.col("annotator_id") % 20 == 1).cast("int"))
    public = rounds.withColumn("public_count", F.col("public_count") + (F.col("round_num") % 3 == 0).cast("int") * 1000)
    return V.validate_reward_rows(rows, fid, supplied, caps, public=public).select(
        "round_num", "rows", "bad_rows", "repeated", "mismatched", "over_cap", "cap_total", "caps_sound", "valid")


@query("provenance_mismatch", """WITH e AS (SELECT p_partkey AS item_id, p_size AS expected FROM part WHERE p_partkey % 4 <> 0),
   s AS (SELECT p_partkey AS item_id, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size + (p_partkey % 6 = 0)::INT END AS supplied
     FROM part WHERE p_partkey % 5 <> 0)
  SELECT coalesce(e.item_id, s.item_id) AS item_id, expected, supplied FROM e FULL JOIN s ON e.item_id = s.item_id
  WHERE expected IS DISTINCT FROM supplied""")
def provenance_mismatch(t):
    part = t.raw("part")
    e = part.where("p_partkey % 4 <> 0").selectExpr("p_partkey AS item_id", "p_size AS annotator_id")
    s = part.where("p_partkey % 5 <> 0").selectExpr(
        "p_partkey AS item_id",
        "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size + CAST(p_partkey % 6 = 0 AS INT) END AS annotator_id")
    return V.provenance_mismatch(e, s)


@query("pseudo_labels", f"""{Q.with_tables('annotations', 'items')}, s AS (SELECT item_id, seq FROM annotations
   WHERE confidence >= 0.98)
  SELECT i.item_id, count(s.seq) AS labels FROM items i LEFT JOIN s USING (item_id) GROUP BY 1""")
def pseudo_labels(t):
    got = V.select_pseudo_labels(t.items.select("item_id"), t.annotations.select("item_id", "seq", "confidence"), 0.98)
    return got.groupBy("item_id").agg(F.count("seq").alias("labels"))


@query("complete_items", f"""{Q.with_tables('annotations', 'items')} SELECT i.item_id, s.annotator_id, s.seq, s.seq IS NOT NULL AS answered FROM items i LEFT JOIN annotations s USING (item_id)""")
def complete_items(t):
    return V.complete_items(t.items.select("item_id"), t.annotations.select("item_id", "annotator_id", "seq"))


@query("selection_plan_contract", """WITH plan AS (SELECT p_partkey AS item_id, CASE WHEN p_partkey % 6 = 0 THEN NULL
      ELSE p_partkey % 50 + CASE WHEN p_partkey % 40 = 1 THEN 1000 ELSE 0 END END AS annotator_id,
      CASE WHEN p_partkey % 25 = 0 THEN NULL ELSE p_partkey % 4 = 0 END AS q FROM part WHERE p_partkey % 30 <> 7),
   share AS (SELECT s_suppkey AS annotator_id, s_suppkey % 7 + 1 AS share FROM supplier),
   exact AS (SELECT *, share / sum(share) OVER () * (SELECT count(*) FROM part) AS e FROM share),
   fair AS (SELECT *, floor(e + 1e-9) AS w, row_number() OVER (ORDER BY round(e - floor(e + 1e-9), 9) DESC, annotator_id) AS rn, (SELECT count(*) FROM part) - sum(floor(e + 1e-9)) OVER () AS spare FROM exact),
   slots AS (SELECT annotator_id, w + (rn <= spare)::INT AS cap, w + (rn <= spare)::INT + (annotator_id % 19 = 0)::INT AS claimed FROM fair),
   v AS (SELECT 'unknown_source' AS violation, item_id, annotator_id FROM plan WHERE annotator_id >= 1000
    UNION ALL SELECT 'decision_not_boolean', item_id, NULL FROM plan WHERE q IS NULL
    UNION ALL SELECT 'accepted_without_source', item_id, NULL FROM plan WHERE annotator_id IS NULL AND q
    UNION ALL SELECT 'missing_item', p_partkey, NULL FROM part WHERE p_partkey % 30 = 7
    UNION ALL SELECT 'over_cap', NULL, u.annotator_id FROM (SELECT annotator_id, count(*) AS used FROM plan
      WHERE annotator_id IS NOT NULL GROUP BY 1) u LEFT JOIN slots USING (annotator_id) WHERE used > coalesce(cap, 0)
    UNION ALL SELECT 'forged_cap', NULL, annotator_id FROM slots WHERE cap <> claimed)
   SELECT * FROM v""")
def selection_plan_contract(t):
    part = t.raw("part")
    plan = part.where("p_partkey % 30 <> 7").selectExpr(
        "p_partkey AS item_id",
        "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_partkey % 50 + CASE WHEN p_partkey % 40 = 1 THEN 1000 ELSE 0 END END AS annotator_id",
        "CASE WHEN p_partkey % 25 = 0 THEN NULL ELSE p_partkey % 4 = 0 END AS quality_accepted")
    candidates = part.selectExpr("p_partkey AS item_id", "p_partkey % 50 AS annotator_id")
    images = part.selectExpr("p_partkey AS item_id")
    shares = t.raw("supplier").selectExpr("s_suppkey AS annotator_id", "s_suppkey % 7 + 1 AS share")
    claimed = hamilton(shares, images.agg(F.count("*").alias("n"))).selectExpr("annotator_id", "slots + CAST(annotator_id % 19 = 0 AS INT) AS claimed_cap")
    return V.validate_selection_plan(plan, candidates, claimed, images, shares)
