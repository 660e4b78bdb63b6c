"""Queries: release evaluation, run health, leaderboards, feedback, retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.functions import text as X
from labelloom.operators import evaluate as E
from labelloom.operators import retention as N
from labelloom.plans import sqltext as Q
from labelloom.plans.registry import query
from labelloom.plans.scoring import EDGES, MISSING_SQL, OUTLINE_EDGES, R6, _filled, golden_annotations
from labelloom.sources.readers import parse_round_log

BASE = Q.with_tables("annotations", "golden", "items")
# Predictions of the release evaluation: annotations on boxed golden items, all rounds together.
PRED = f"""{BASE}, pred AS (SELECT item_id, row(annotator_id, seq) AS seq, replace(lower(trim(label)), ' ', '_') AS label, x1, y1, x2, y2,
   confidence FROM annotations SEMI JOIN (SELECT DISTINCT item_id FROM golden) g USING (item_id)),
  cand AS (SELECT p.item_id, g.gt, p.seq, p.label, g.label AS gl, {Q.iou('p', 'g')} AS iou FROM pred p JOIN golden g ON p.item_id = g.item_id
   AND p.x1 < g.x2 AND g.x1 < p.x2 AND p.y1 < g.y2 AND g.y1 < p.y2)"""


def predictions(t):
    return t.annotations.join(t.golden.select("item_id").distinct(), "item_id", "left_semi").withColumn(
        "seq", F.struct("annotator_id", "seq"))


@query("micro_prf", f"""{PRED}, e AS (SELECT item_id, gt, seq, iou FROM cand WHERE iou >= 0.5 AND label = gl),
  {Q.greedy('m', 'e', ['item_id'], 'pred')},
  s AS (SELECT (SELECT count(*) FROM m) AS tp, (SELECT count(*) FROM pred) AS p, (SELECT count(*) FROM golden) AS g, (SELECT avg(iou) FROM m) AS mi)
  SELECT tp, p - tp AS fp, g - tp AS fn, round(tp / p, 6) AS precision, round(tp / g, 6) AS recall, round(2 * (tp / p) * (tp / g) / (tp / p + tp / g), 6) AS f1,
   round(mi, 6) AS mean_iou FROM s""")
def micro_prf(t):
    got = E.micro_prf(predictions(t), t.golden)
    return got.select("tp", "fp", "fn", *[R6(c) for c in ("precision", "recall", "f1", "mean_iou")])


CLASS_SQL = f"""{PRED}, e AS (SELECT item_id, gt, seq, iou FROM cand WHERE iou >= 0.5), {Q.greedy('m', 'e', ['item_id'], 'pred')},
  seen AS (SELECT p.label, g.label AS gl FROM pred p LEFT JOIN m ON m.item_id = p.item_id AND m.seq = p.seq
    LEFT JOIN golden g ON g.item_id = m.item_id AND g.gt = m.gt),
  ev AS (SELECT label, (label = coalesce(gl, ''))::INT AS tp, (label <> coalesce(gl, ''))::INT AS fp, 0 AS fn FROM seen
   UNION ALL SELECT gl, 0, 0, 1 FROM seen WHERE gl IS NOT NULL AND gl <> label
   UNION ALL SELECT label, 0, 0, 1 FROM golden ANTI JOIN m USING (item_id, gt)),
  per AS (SELECT label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
    2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS f1 FROM ev GROUP BY 1)"""


@query("class_prf", CLASS_SQL + " SELECT label, tp, fp, fn, round(f1, 6) AS f1 FROM per")
def class_prf(t):
    return E.class_prf(predictions(t), t.golden).select("label", "tp", "fp", "fn", R6("f1"))


@query("holdout_verdict", CLASS_SQL + """ SELECT CAST(sum(tp + fp) AS BIGINT) AS pairs, round(sum(tp) / sum(tp + fp), 6) AS accuracy,
   round(min(f1), 6) AS min_f1, sum(tp) / sum(tp + fp) >= 0.9 AND min(f1) >= 0.85 AS passed FROM per""")
def holdout_verdict(t):
    return E.holdout_verdict(E.class_prf(predictions(t), t.golden)).select("pairs", R6("accuracy"), R6("min_f1"), "passed")


@query("calibration", f"""{PRED}, b AS (SELECT item_id, seq, any_value(label) AS label, arg_max(gl, iou * 1000 - gt / 1000.0) AS gl FROM cand WHERE iou >= 0.5
    GROUP BY ALL), j AS (SELECT b.*, p.confidence FROM b JOIN pred p USING (item_id, seq)),
  s AS (SELECT count(*) AS n, avg(confidence) AS mc, avg((label = gl)::INT) AS acc FROM j)
  SELECT n, round(mc, 6) AS mean_confidence, round(acc, 6) AS accuracy, round(abs(mc - acc), 6) AS gap, n >= 100 AND abs(mc - acc) <= 0.05 AS passed FROM s""")
def calibration(t):
    got = E.calibration(predictions(t), t.golden, ["item_id", "seq"])
    return got.select("n", R6("mean_confidence"), R6("accuracy"), R6("gap"), "passed")


# The event table written out as log lines: every event becomes one line of some kind.
LINE = """strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || ' ' || chr(27) || '[34m|' || chr(27) || '[0m ' || CASE event_type
  WHEN 'signup' THEN 'event=dual_flywheel_round_start step=' || (event_id // 5) || ' sampled_uids=[1, 2, ' || user_id || ']'
  WHEN 'purchase' THEN 'event=dual_flywheel_round_done step=' || (event_id // 5) || ' uids=3 winners=2 rewards=[0.5, ' || (user_id % 8) / 8.0 || ']'
  WHEN 'error' THEN 'event=dual_flywheel_invalid_response uid=' || user_id || ' error=late'
  WHEN 'click' THEN 'event=dataset_assembled images=' || user_id % 30 || ' unique_winners=2' ELSE 'noise' END"""


def log_lines(t):
    kind = F.col("event_type")
    step = F.floor(F.col("event_id") / 5).cast("string")
    body = (
        F.when(kind == "signup", F.concat(F.lit("event=dual_flywheel_round_start step="), step, F.lit(" sampled_uids=[1, 2, "),
                                          F.col("user_id"), F.lit("]")))
        .when(kind == "purchase", F.concat(F.lit("event=dual_flywheel_round_done step="), step, F.lit(
            " uids=3 winners=2 rewards=[0.5, "), (F.col("user_id") % 8) / 8.0, F.lit("]")))
        .when(kind == "error", F.concat(F.lit("event=dual_flywheel_invalid_response uid="), F.col("user_id"), F.lit(" error=late")))
        .when(kind == "click", F.concat(F.lit("event=dataset_assembled images="), F.col("user_id") % 30, F.lit(" unique_winners=2")))
        .otherwise("noise"))
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return t.raw("events").select(F.concat(stamp, F.lit(" \x1b[34m|\x1b[0m "), body).alias("value"))


@query("parse_round_log", """SELECT CASE event_type WHEN 'signup' THEN 'round_start' WHEN 'purchase' THEN 'round_done' WHEN 'error' THEN
   'invalid_response' ELSE 'assembled' END AS event, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at_time, CASE WHEN event_type IN ('signup', 'purchase') THEN event_id // 5 END AS step,
   CASE WHEN event_type = 'signup' THEN 3 END AS participants, CASE WHEN event_type = 'click' THEN user_id % 30 END AS images,
   CASE WHEN event_type = 'purchase' THEN round(0.5 + (user_id % 8) / 8.0, 6) END AS reward_total FROM events WHERE event_type <> 'view'""")
def parse_log(t):
    got = parse_round_log(log_lines(t))
    return got.select("event", F.date_format("time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at_time"), "step", "participants", "images", F.round("reward_total", 6).alias("reward_total"))


PAIR_SQL = """WITH st AS (SELECT event_id // 5 AS step, max(ts) AS started FROM events WHERE event_type = 'signup' GROUP BY 1),
  pr AS (SELECT event_id // 5 AS step, (epoch_us(ts) - epoch_us(started)) / 1e6 AS seconds FROM events e JOIN st ON st.step = event_id // 5
   WHERE event_type = 'purchase' AND ts >= started)"""


@query("pair_rounds", PAIR_SQL + " SELECT step, round(seconds, 6) AS seconds FROM pr")
def pair_rounds(t):
    return E.pair_rounds(parse_round_log(log_lines(t))).select("step", R6("seconds"))


METRIC_SQL = PAIR_SQL + """, b AS (SELECT count(*) FILTER (event_type = 'signup') AS round_starts, count(*) FILTER (event_type = 'purchase') AS round_dones,
   count(*) FILTER (event_type = 'error') AS invalid, count(*) FILTER (event_type = 'signup') * 3 AS invocations,
   max(user_id % 30) FILTER (event_type = 'click') AS max_images,
   stddev_samp(0.5 + (user_id % 8) / 8.0) FILTER (event_type = 'purchase') / avg(0.5 + (user_id % 8) / 8.0) FILTER (event_type = 'purchase') AS cv FROM events),
  d AS (SELECT count(*) AS durations, avg(seconds) AS av, quantile_cont(seconds, 0.95) AS p95 FROM pr),
  k AS (SELECT *, 100.0 * round_dones / round_starts AS suc, 100.0 * invalid / invocations AS inv FROM b, d)"""


@query("round_metrics", METRIC_SQL + """ SELECT round_starts, round_dones, invalid, invocations, max_images, durations, round(av, 4) AS avg_seconds,
   round(p95, 4) AS p95_seconds, round(suc, 6) AS success_pct, round(inv, 6) AS invalid_pct, round(cv, 6) AS reward_cv FROM k""")
def round_metrics(t):
    got = E.round_metrics(parse_round_log(log_lines(t)))
    return got.select("round_starts", "round_dones", "invalid", "invocations", "max_images", "durations", F.round("avg_seconds", 4).alias("avg_seconds"),
                      F.round("p95_seconds", 4).alias("p95_seconds"), R6("success_pct"), R6("invalid_pct"), R6("reward_cv"))


@query("evaluate_gates", METRIC_SQL + """ SELECT 'dual_flywheel_log_coverage' AS gate, true AS passed, round_starts::DOUBLE AS value FROM k
  UNION ALL SELECT 'round_success_pct', suc >= 70, round(suc, 4) FROM k UNION ALL SELECT 'invalid_response_pct', inv <= 15, round(inv, 4) FROM k
  UNION ALL SELECT 'round_latency', av <= 1200 AND p95 <= 1800, round(av, 4) FROM k UNION ALL SELECT 'assembly_yield', max_images >= 1, max_images FROM k
  UNION ALL SELECT 'reward_stability_cv', cv <= 0.85, round(cv, 4) FROM k UNION ALL SELECT 'set_weights_on_chain', true, 0
  UNION ALL SELECT 'transport_health', true, 0""")
def evaluate_gates(t):
    got = E.evaluate_gates(E.round_metrics(parse_round_log(log_lines(t))))
    return got.select("gate", "passed", F.round("value", 4).alias("value"))


SCORES = f"{Q.with_tables('round_scores')}, sc AS (SELECT annotator_id, round, reward AS score FROM round_scores)"


def scores(t):
    return t.round_scores.withColumnRenamed("reward", "score")


@query("leaderboard", SCORES + """ SELECT round, annotator_id, row_number() OVER p AS rank, round_even((count(*) OVER (PARTITION BY round) - row_number() OVER p + 1)
    / count(*) OVER (PARTITION BY round) * 100.0, 1) AS percentile, round_even(max(score) OVER (PARTITION BY round) - score, 4) AS gap,
   round_even(score - coalesce(lag(score) OVER (PARTITION BY annotator_id ORDER BY round), score), 4) AS delta
  FROM sc WINDOW p AS (PARTITION BY round ORDER BY score DESC, annotator_id)""")
def leaderboard(t):
    got = E.leaderboard(scores(t))
    return got.select("round", "annotator_id", "rank", "percentile", "gap", "delta")


@query("pick_representatives", MISSING_SQL + """, pos AS (SELECT round_num, annotator_id, item_id, row_number() OVER (PARTITION BY round_num, annotator_id ORDER BY fidelity,
    item_id) AS position, count(*) OVER (PARTITION BY round_num, annotator_id) AS n FROM filled)
  SELECT round_num, annotator_id, item_id, position FROM pos WHERE n <= 3 OR position <= 2 OR position = n // 2 + 1""")
def pick_representatives(t):
    got = E.pick_representatives(_filled(t)[1], ["round_num", "annotator_id"])
    return got.select("round_num", "annotator_id", "item_id", "position")


@query("consecutive_drops", SCORES + """, l AS (SELECT *, lag(score) OVER w AS b, lag(score, 2) OVER w AS c, lag(round, 2) OVER w AS rollback_to FROM sc
   WINDOW w AS (PARTITION BY annotator_id ORDER BY round)) SELECT annotator_id, round, rollback_to FROM l WHERE score < b AND b < c""")
def consecutive_drops(t):
    return E.consecutive_drops(scores(t)).select("annotator_id", "round", "rollback_to")


@query("classify_outcomes", SCORES + """, l AS (SELECT *, score - lag(score) OVER (PARTITION BY annotator_id ORDER BY round) AS d FROM sc)
  SELECT annotator_id, round, CASE WHEN d >= 0.01 THEN 'IMPROVED' WHEN d < -0.005 THEN 'REGRESSED' WHEN d IS NOT NULL THEN 'STAGNANT' END AS outcome FROM l""")
def classify_outcomes(t):
    return E.classify_outcomes(scores(t)).select("annotator_id", "round", "outcome")


@query("next_untried", """WITH o AS (SELECT user_id AS annotator_id, list(DISTINCT event_type) AS t FROM events GROUP BY 1)
  SELECT annotator_id, list_filter(['view', 'click', 'error', 'signup'], lambda v: NOT list_contains(t, v))[1] AS next_option FROM o""")
def next_untried(t):
    tries = t.raw("events").selectExpr("user_id AS annotator_id", "event_type AS option")
    return E.next_untried(tries, ["view", "click", "error", "signup"])


METRICS_SQL = f"""{BASE}, mine AS (SELECT a.* FROM annotations a JOIN items i USING (item_id) WHERE i.role = 'golden'),
  {EDGES}, e30 AS (SELECT * FROM edges WHERE iou >= 0.3), {Q.greedy('m', 'e30', ['round_num', 'item_id', 'annotator_id'])},
  hit AS (SELECT annotator_id, count(*) AS matched, sum(iou) AS s FROM m GROUP BY 1),
  per AS (SELECT annotator_id, count(*) AS n, coalesce(avg(CASE shape WHEN 'rect' THEN 4 WHEN 'octagon' THEN 8 WHEN 'star' THEN 14 END), 4.0) AS mv,
    avg((shape IN ('none', 'rect'))::INT) AS br FROM mine GROUP BY 1),
  tr AS (SELECT annotator_id, CAST(sum(k) AS BIGINT) AS t FROM (SELECT DISTINCT round_num, item_id, annotator_id FROM mine) JOIN
    (SELECT item_id, count(*) AS k FROM golden GROUP BY 1) USING (item_id) GROUP BY 1)
  SELECT annotator_id, round_even(coalesce(s, 0) / greatest(1, t), 4) AS mean_iou, round_even((t - coalesce(matched, 0)) / greatest(1, t), 4) AS miss_rate,
    round_even((n - coalesce(matched, 0)) / n, 4) AS false_rate, round_even(mv, 1) AS mean_vertices, round_even(br, 4) AS box_ratio
  FROM per JOIN tr USING (annotator_id) LEFT JOIN hit USING (annotator_id)"""


@query("geometry_metrics", METRICS_SQL)
def geometry_metrics(t):
    got = E.geometry_metrics(golden_annotations(t), t.golden, t.items)
    return got.select("annotator_id", "mean_iou", "miss_rate", "false_rate", "mean_vertices", "box_ratio")


@query("geometry_metrics_outlines", METRICS_SQL.replace(EDGES, OUTLINE_EDGES))
def geometry_metrics_outlines(t):
    got = E.geometry_metrics(golden_annotations(t), t.golden_outlined, t.items)
    return got.select("annotator_id", "mean_iou", "miss_rate", "false_rate", "mean_vertices", "box_ratio")


@query("class_skew", f"{Q.with_tables('annotations')} SELECT annotator_id, lower(trim(label)) AS label, count(*) AS n FROM annotations GROUP BY 1, 2")
def class_skew(t):
    return E.class_skew(t.annotations)


@query("diagnosis", f"""SELECT s_suppkey AS annotator_id, CASE WHEN m > 0.30 AND b > 0.40 THEN printf('{X.DIAGNOSES['both']}', floor(m * 100)::INT)
    WHEN m > 0.25 THEN printf('{X.DIAGNOSES['misses']}', floor(m * 100)::INT) WHEN b > 0.30 THEN '{X.DIAGNOSES['boxes']}' WHEN f > 0.25 THEN '{X.DIAGNOSES['noise']}'
    ELSE '{X.DIAGNOSES['fine']}' END AS feedback FROM (SELECT s_suppkey, (s_suppkey % 50) / 64.0 AS m, (s_suppkey % 7) / 8.0 AS b, (s_suppkey % 9) / 16.0 AS f FROM supplier)""")
def diagnosis(t):
    i = F.col("annotator_id")
    return t.annotators.select("annotator_id", X.diagnosis((i % 50) / 64.0, (i % 7) / 8.0, (i % 9) / 16.0).alias("feedback"))


@query("budget_ledger", """WITH p AS (SELECT CAST(ts AS DATE) AS day, event_type AS role, count(*) AS calls, CAST(sum(floor(value)) AS BIGINT) AS tokens FROM events GROUP BY ALL)
  SELECT *, calls >= 70 AS breaker_tripped, greatest(0, calls - 70) AS refused, round(tokens / 1e6 * 0.15, 9) AS cost FROM p""")
def budget_ledger(t):
    calls = t.raw("events").selectExpr("ts", "event_type AS role", "CAST(floor(value) AS BIGINT) AS tokens")
    return E.budget_ledger(calls, 70).withColumn("cost", F.round("cost", 9))


@query("project_cost", """WITH s AS (SELECT CAST(sum(floor(value)) AS BIGINT) AS tokens FROM events) SELECT tokens, round(tokens / 1e6 * 0.15, 6) AS cost,
   round(tokens / 27.0 * 2016, 3) AS projected_tokens, round(tokens / 27.0 * 2016 / 1e6 * 0.15, 6) AS projected_cost FROM s""")
def project_cost(t):
    got = E.project_cost(t.raw("events").selectExpr("CAST(floor(value) AS BIGINT) AS tokens"), 27)
    return got.select("tokens", R6("cost"), F.round("projected_tokens", 3).alias("projected_tokens"), R6("projected_cost"))


@query("rank_trials", """WITH p AS (SELECT l_suppkey AS trial, l_partkey, count(*) FILTER (l_quantity > 40) AS d FROM lineitem GROUP BY ALL),
  s AS (SELECT trial, avg((d > 0)::INT) AS coverage, avg(d) AS md FROM p GROUP BY 1), z AS (SELECT *, 0.6 * coverage + 0.4 * least(1.0, md / 5) AS score FROM s)
  SELECT trial, round(coverage, 6) AS coverage, round(md, 6) AS mean_detections, round(score, 6) AS score,
   trial = (SELECT trial FROM z ORDER BY round(score, 12) DESC, trial LIMIT 1) AS is_best FROM z""")
def rank_trials(t):
    per = t.raw("lineitem").groupBy(F.col("l_suppkey").alias("trial"), "l_partkey").agg(F.count_if(F.col("l_quantity") > 40).alias("detections"))
    return E.rank_trials(per).select("trial", R6("coverage"), R6("mean_detections"), R6("score"), "is_best")


@query("redundant_attempts", "SELECT user_id AS annotator_id, count(*) AS attempts, count(*) - count(DISTINCT event_type) AS redundant FROM events GROUP BY 1")
def redundant_attempts(t):
    return E.redundant_attempts(t.raw("events").selectExpr("user_id AS annotator_id", "event_type AS option"))


@query("peak_rounds", SCORES + """ SELECT annotator_id, round, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY annotator_id ORDER BY score DESC, round)
   AS rn FROM sc) WHERE rn = 1""")
def peak_rounds(t):
    return E.peak_rounds(scores(t)).select("annotator_id", "round", R6("score"))


@query("scrub_feedback", r"""WITH a AS (SELECT doc_id, trim(text, ' ') AS t FROM documents),
  b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?i)[a-zA-Z0-9_\-]+\.(?:jpg|jpeg|png|tif|tiff)', '', 'g'), '(?i)\b(?:chip|sample|image|patch)\s*(?:#?\d+|[a-f0-9]{6,})', 'sector', 'g') AS t FROM a),
  c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(t, '\[\s*\d+(?:\.\d+)?\s*,\s*\d+(?:\.\d+)?\s*\]', '', 'g'), '\(\s*\d+(?:\.\d+)?\s*,\s*\d+(?:\.\d+)?\s*\)', '', 'g'), '\s+', ' ', 'g'), ' ') AS t FROM b),
  d AS (SELECT doc_id, regexp_replace(t, '\s+([.,!?;:])', '\1', 'g') AS t FROM c),
  e AS (SELECT doc_id, list_filter(string_split(regexp_replace(t, '([a-zA-Z]{2}[.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda v: v <> '') AS s FROM d),
  f AS (SELECT doc_id, array_to_string(s[1:2], ' ') AS t FROM e),
  g AS (SELECT doc_id, CASE WHEN len(string_split(t, ' ')) > 45 THEN regexp_replace(array_to_string(string_split(t, ' ')[1:45], ' '), '[,;:\-]+$', '') || '.' ELSE t END AS t FROM f)
  SELECT doc_id, CASE WHEN regexp_matches(t, '[.!?]$') THEN t ELSE t || '.' END AS feedback FROM g""")
def scrub_feedback(t):
    return t.raw("documents").select("doc_id", X.scrub(F.col("text")).alias("feedback"))


RET = "'2024-01-30 12:00:00'"


@query("retention_report", f"""WITH o AS (SELECT CASE user_id % 3 WHEN 0 THEN 'kept/' WHEN 1 THEN 'orphan-' ELSE 'other/' END AS pre, CAST(floor(value * 100000) AS BIGINT) AS bytes, ts FROM events),
  c AS (SELECT CASE pre WHEN 'orphan-' THEN 'orphan' WHEN 'kept/' THEN CASE WHEN ts < TIMESTAMP {RET} - INTERVAL 12 HOUR THEN 'stale' ELSE 'preserved' END END AS category, bytes FROM o),
  s AS (SELECT coalesce(category, 'total') AS category, count(*) AS objects, CAST(sum(bytes) AS BIGINT) AS bytes FROM c WHERE category IS NOT NULL GROUP BY ROLLUP (category))
  SELECT *, CASE WHEN bytes < 1048576 THEN printf('%.2f KB', bytes / 1024.0) WHEN bytes < 1073741824 THEN printf('%.2f MB', bytes / 1048576.0) ELSE printf('%.2f GB', bytes / 1073741824.0) END AS size FROM s""")
def retention_report(t):
    objects = t.raw("events").selectExpr(
        "concat(CASE user_id % 3 WHEN 0 THEN 'kept/' WHEN 1 THEN 'orphan-' ELSE 'other/' END, event_id) AS key",
        "CAST(floor(value * 100000) AS BIGINT) AS bytes", "ts AS modified")
    return N.retention_report(objects, RET.strip("'"), 12, "kept/", "orphan-")


@query("keep_latest", """SELECT user_id, event_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 2 AS kept FROM events""")
def keep_latest(t):
    dumps = t.raw("events").selectExpr("user_id", "event_id AS key", "ts AS modified")
    return N.keep_latest(dumps, 2, ["user_id"]).select("user_id", "key", "kept")


@query("stale_files", "SELECT o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT event_id FROM events)")
def stale_files(t):
    listing = t.raw("orders").select(F.col("o_orderkey").alias("key"))
    return N.stale_files(listing, t.raw("events").select(F.col("event_id").alias("key")))
