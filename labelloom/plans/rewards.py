"""Queries: ledgers, rewards, shaping, weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.config import SERVICE_REWARD, IncentiveConfig
from labelloom.functions import geometry as G
from labelloom.operators import reward as R
from labelloom.operators import score as S
from labelloom.operators.state import reset_changed_identities
from labelloom.plans import sqltext as Q
from labelloom.plans.registry import query
from labelloom.plans.scoring import R6, fidelity_sql, golden_annotations

# Winners: one per item and year, from the lines of the item.
WIN_SQL = """win AS (SELECT year(l_shipdate) AS round_num, l_partkey AS item_id, min(l_suppkey) AS chosen, max(l_suppkey) AS other,
   bool_or(l_linenumber = 7) AS verified, l_partkey % 10 = 0 AS is_golden, l_partkey % 6 = 1 AS escalated FROM lineitem
   GROUP BY ALL)"""


def winners(t):
    rows = t.raw("lineitem").groupBy(F.year("l_shipdate").alias("round_num"), F.col("l_partkey").alias("item_id")).agg(
        F.min("l_suppkey").alias("chosen"), F.max("l_suppkey").alias("other"),
        F.bool_or(F.col("l_linenumber") == 7).alias("verified"))
    same = F.col("chosen") == F.col("other")
    shares = F.when(same, F.create_map("chosen", F.lit(1.0))).otherwise(
        F.create_map("chosen", F.lit(0.75), F.when(same, F.lit(-1)).otherwise(F.col("other")), F.lit(0.25)))
    return rows.withColumn("is_golden", F.col("item_id") % 10 == 0).withColumn(
        "escalated", F.col("item_id") % 6 == 1).withColumn("contributions", shares)


LEDGER_SQL = f"""WITH {WIN_SQL}, good AS (SELECT * FROM win WHERE verified AND NOT is_golden AND NOT escalated),
  ev AS (SELECT round_num, chosen AS annotator_id, 1 AS n, 0.0::DOUBLE AS c FROM good
    UNION ALL SELECT round_num, chosen, 0, CASE WHEN chosen = other THEN 1.0 ELSE 0.75 END FROM good
    UNION ALL SELECT round_num, other, 0, 0.25 FROM good WHERE chosen <> other),
  per AS (SELECT annotator_id, CAST(sum(n) AS BIGINT) AS adoptions, sum(c) AS contribution,
    CAST(sum(n) FILTER (round_num = (SELECT max(round_num) FROM win)) AS BIGINT) AS la,
    sum(c) FILTER (round_num = (SELECT max(round_num) FROM win)) AS lc FROM ev GROUP BY 1),
  ledger AS (SELECT annotator_id, adoptions, contribution, coalesce(la, 0) AS last_adoptions, coalesce(lc, 0) AS last_contribution,
   adoptions / (SELECT sum(adoptions) FROM per) AS share, coalesce(la, 0) / (SELECT sum(la) FROM per) AS last_share,
   coalesce(lc, 0) / (SELECT sum(lc) FROM per) AS last_contribution_share FROM per)"""


@query("adoption_ledger", LEDGER_SQL + """ SELECT annotator_id, adoptions, round(contribution, 4) AS contribution, last_adoptions,
   round(last_contribution, 4) AS last_contribution, round(share, 6) AS share, round(last_share, 6) AS last_share,
   round(last_contribution_share, 6) AS last_contribution_share FROM ledger""")
def adoption_ledger(t):
    return R.adoption_ledger(winners(t)).select(
        "annotator_id", "adoptions", F.round("contribution", 4).alias("contribution"), "last_adoptions",
        F.round("last_contribution", 4).alias("last_contribution"), R6("share"), R6("last_share"),
        R6("last_contribution_share"))


@query("compose_rewards", f"""{fidelity_sql()}, {LEDGER_SQL[5:]},
  pf AS (SELECT annotator_id, count(*) AS evidence, count(*) FILTER (rewardable AND gt_count > 0) AS positives,
    count(*) FILTER (rewardable AND gt_count > 0 AND matched > 0 AND fid >= 0.01) AS qualifying,
    avg(fid) FILTER (rewardable AND gt_count > 0) AS mean FROM scored GROUP BY 1),
  averages AS (SELECT s_suppkey AS annotator_id, (s_suppkey * 17 % 100) / 100.0 AS avg_fidelity FROM supplier),
  sel AS (SELECT annotator_id, 3 + annotator_id % 5 AS rows, 6 AS cap, avg_fidelity AS tf FROM averages),
  loc AS (SELECT annotator_id, sum(iou) / sum(1) AS localization FROM m GROUP BY 1),
  j AS (SELECT s_suppkey AS annotator_id, coalesce(evidence, 0) AS evidence, coalesce(positives, 0) AS positives,
    coalesce(qualifying, 0) AS qualifying, CASE WHEN coalesce(qualifying, 0) < 1 THEN 0 ELSE mean END AS annotation,
    CASE WHEN positives >= 3 AND qualifying >= 3 AND mean >= 0.75 AND localization >= 0.75 THEN last_contribution_share
      ELSE 0 END AS adoption,
    CASE WHEN tf >= 0.05 AND rows <= cap THEN rows * CASE WHEN tf <= 0.05 THEN 0 WHEN tf >= 0.2 THEN 1 ELSE (tf - 0.05) / 0.15
      END / 50.0 ELSE 0 END AS selection
   FROM supplier s LEFT JOIN pf ON pf.annotator_id = s_suppkey LEFT JOIN loc ON loc.annotator_id = s_suppkey
   LEFT JOIN ledger l ON l.annotator_id = s_suppkey JOIN sel ON sel.annotator_id = s_suppkey)
  SELECT annotator_id, evidence, positives, qualifying, round(annotation, 5) AS annotation, round(adoption, 6) AS adoption,
    round(selection, 6) AS selection, round(0.7 * annotation + 0.3 * greatest(adoption, selection), 5) AS reward FROM j""")
def compose_rewards(t):
    anns = golden_annotations(t)
    fidelity = S.score_fidelity(anns, t.golden, t.items)
    matches = S.label_matches(anns, t.golden, S.SUBMISSION)
    loc = matches.groupBy("annotator_id").agg(F.avg("iou").alias("localization"))
    selected = t.averages.select("annotator_id", (3 + F.col("annotator_id") % 5).alias("rows"), F.lit(6).alias("cap"),
                                 F.col("avg_fidelity").alias("task_fidelity"))
    got = R.compose_rewards(t.annotators, fidelity, loc, R.adoption_ledger(winners(t)), selected, 50, SERVICE_REWARD)
    return got.select("annotator_id", "evidence", "positives", "qualifying", F.round("annotation", 5).alias("annotation"),
                      R6("adoption"), R6("selection"), F.round("reward", 5).alias("reward"))


@query("ema", f"""{Q.with_tables('round_scores')}, days AS (SELECT DISTINCT round FROM round_scores),
  grid AS (SELECT a.annotator_id, d.round, coalesce(r.reward, 0) AS v FROM (SELECT DISTINCT annotator_id FROM round_scores) a
    CROSS JOIN days d LEFT JOIN round_scores r ON r.annotator_id = a.annotator_id AND r.round = d.round)
  SELECT annotator_id, round(list_reduce(list_prepend(0.0::DOUBLE, list(v::DOUBLE ORDER BY round)), lambda s, v:
    CASE WHEN 0.25 * v + 0.75 * s < 1e-4 THEN 0 ELSE 0.25 * v + 0.75 * s END), 6) AS ema FROM grid GROUP BY 1""")
def ema(t):
    return R.ema(t.round_scores, 0.25).select("annotator_id", R6("ema"))


@query("hamilton", """WITH s AS (SELECT o_custkey % 97 AS annotator_id, year(o_orderdate) AS round, count(*) AS share FROM orders
    GROUP BY ALL), n AS (SELECT round, sum(share) AS total, 27 + round % 9 AS n FROM s GROUP BY round),
  e AS (SELECT s.*, n, share / total * n AS exact FROM s JOIN n USING (round)),
  r AS (SELECT *, floor(exact + 1e-9) AS w, row_number() OVER (PARTITION BY round ORDER BY round(exact - floor(exact + 1e-9), 9)
    DESC, annotator_id) AS rn, n - sum(floor(exact + 1e-9)) OVER (PARTITION BY round) AS left_over FROM e)
  SELECT round, annotator_id, CAST(w + CASE WHEN rn <= left_over THEN 1 ELSE 0 END AS BIGINT) AS slots FROM r""")
def hamilton(t):
    shares = t.raw("orders").groupBy((F.col("o_custkey") % 97).alias("annotator_id"), F.year("o_orderdate").alias("round")).agg(
        F.count("*").alias("share"))
    slots = shares.select("round").distinct().withColumn("n", 27 + F.col("round") % 9)
    return R.hamilton(shares, slots, ["round"]).select("round", "annotator_id", "slots")


WEIGHT_SQL = """w AS (SELECT c_nationkey AS round, c_custkey AS annotator_id, greatest(0.0, c_acctbal) *
   CASE WHEN c_custkey % 50 = 0 THEN 40 ELSE 1 END AS weight FROM customer)"""


def weights(t):
    return t.raw("customer").selectExpr(
        "c_nationkey AS round", "c_custkey AS annotator_id",
        "greatest(0.0D, c_acctbal) * CASE WHEN c_custkey % 50 = 0 THEN 40 ELSE 1 END AS weight")


def _cap_sql(rows: str, limit: float, name: str) -> str:
    return f"""{name}_t AS (SELECT *, sum(weight) OVER p AS t, count(*) OVER p AS n, max(weight) OVER p AS m FROM {rows}
    WINDOW p AS (PARTITION BY round)),
  {name}_e AS (SELECT *, weight / t AS e, sum(weight / t) OVER (PARTITION BY round ORDER BY weight, annotator_id) AS cum,
    row_number() OVER (PARTITION BY round ORDER BY weight, annotator_id) AS r FROM {name}_t WHERE t <> 0 AND n * {limit} > 1 AND m / t > {limit}),
  {name}_k AS (SELECT *, count(*) FILTER (e / ((n - r) * e + cum + 1e-7) < {limit}) OVER (PARTITION BY round) AS k FROM {name}_e),
  {name}_c AS (SELECT round, ({limit} * cum - 1e-7) / (1 - {limit} * (n - k)) * t AS cut FROM {name}_k
    WHERE r = CASE WHEN k = 0 THEN n ELSE k END),
  {name}_w AS (SELECT t.*, least(weight, coalesce(cut, weight)) AS w2 FROM {name}_t t LEFT JOIN {name}_c USING (round)),
  {name} AS (SELECT round, annotator_id, CASE WHEN t = 0 OR n * {limit} <= 1 THEN 1.0 / n ELSE w2 / sum(w2) OVER (PARTITION BY round)
    END AS weight FROM {name}_w)"""


@query("cap_weights", f"""WITH {WEIGHT_SQL}, {_cap_sql('w', 0.06, 'c')} SELECT round, annotator_id, round(weight, 6) AS weight FROM c""")
def cap_weights(t):
    return R.cap_weights(weights(t), 0.06).select("round", "annotator_id", R6("weight"))


@query("process_weights", f"""WITH {WEIGHT_SQL}, st AS (SELECT round, count(*) AS na, count(*) FILTER (weight > 0) AS np FROM w GROUP BY 1),
  o AS (SELECT w.*, row_number() OVER (PARTITION BY round ORDER BY weight) AS r, least(0.1, greatest(0, np - 48) / np) * (np - 1) AS spot
    FROM w JOIN st USING (round) WHERE weight > 0),
  q AS (SELECT round, min(weight) + any_value(spot - floor(spot)) * (max(weight) - min(weight)) AS low FROM o WHERE r IN (floor(spot) + 1, ceil(spot) + 1) GROUP BY round),
  kept AS (SELECT w.* FROM w JOIN st USING (round) JOIN q USING (round) WHERE weight > 0 AND np >= 48 AND na >= 48
     AND weight >= low
    UNION ALL SELECT round, annotator_id, weight + 1e-5 FROM w JOIN st USING (round) WHERE na >= 48 AND np > 0 AND np < 48),
  {_cap_sql('kept', 0.06, 'c')}
  SELECT round, annotator_id, round(weight, 6) AS weight FROM c
  UNION ALL SELECT round, annotator_id, round(1.0 / na, 6) FROM w JOIN st USING (round) WHERE na < 48 OR np = 0""")
def process_weights(t):
    return R.process_weights(weights(t), 0.06, 48, 0.1).select("round", "annotator_id", R6("weight"))


@query("quantize_weights", f"""WITH {WEIGHT_SQL}, m AS (SELECT round, max(weight) AS top FROM w GROUP BY 1)
  SELECT round, annotator_id, CAST(round_even(weight / top * 65535, 0) AS BIGINT) AS value FROM w JOIN m USING (round)
  WHERE round_even(weight / top * 65535, 0) > 0""")
def quantize_weights(t):
    return R.quantize_weights(weights(t))


def _shape_sql(raw: str, leader: bool) -> str:
    first = "score / max(score) OVER (PARTITION BY round)" if leader else "score"
    return f"""{Q.with_tables('round_scores')}, sc AS (SELECT annotator_id, round, reward AS score FROM round_scores),
  s AS (SELECT annotator_id, round, {first} AS s FROM sc),
  g AS (SELECT *, max(s) OVER p AS m, count(*) OVER p AS n FROM s WHERE s >= 0.05 WINDOW p AS (PARTITION BY round)),
  r AS (SELECT *, {raw} AS raw, CASE WHEN 0.08 * n > 0.2 THEN 0.2 / n ELSE 0.08 END AS fl FROM g),
  q AS (SELECT *, fl + (1 - fl * n) * raw / sum(raw) OVER (PARTITION BY round) AS v FROM r)
  SELECT round, annotator_id, round(v / sum(v) OVER (PARTITION BY round), 6) AS share FROM q
  UNION ALL SELECT round, annotator_id, 0 FROM s WHERE NOT s >= 0.05"""


def _shape(t, cfg, leader=False):
    scores = t.round_scores.withColumnRenamed("reward", "score")
    return R.shape_incentives(scores, cfg, scale_by_leader=leader).select("round", "annotator_id", R6("share"))


@query("shape_incentives", _shape_sql("s", False))
def shape_incentives(t):
    return _shape(t, IncentiveConfig())


@query("shape_incentives_power", _shape_sql("power(s / m, 2.0)", True))
def shape_incentives_power(t):
    return _shape(t, IncentiveConfig(temperature=0.5), True)


@query("shape_incentives_softmax", _shape_sql("exp((s - m) / 0.05)", False))
def shape_incentives_softmax(t):
    return _shape(t, IncentiveConfig(temperature=0.05))


@query("eligibility_ramp", """SELECT s_suppkey AS annotator_id, round(CASE WHEN v <= 0.05 THEN 0 WHEN v >= 0.2 THEN 1
   ELSE (v - 0.05) / (0.2 - 0.05) END, 6) AS ramp FROM (SELECT s_suppkey, s_acctbal / 40000.0 AS v FROM supplier)""")
def eligibility_ramp(t):
    return t.annotators.select("annotator_id", F.round(G.ramp(F.col("stake") / 40000.0), 6).alias("ramp"))


@query("reset_identities", """WITH o AS (SELECT s_suppkey AS id, s_nationkey AS k, s_acctbal FROM supplier WHERE s_suppkey % 10 <> 9),
   n AS (SELECT s_suppkey AS id, s_nationkey + (s_suppkey % 7 = 0)::INT AS k FROM supplier WHERE s_suppkey % 10 <> 3)
  SELECT n.id AS annotator_id, coalesce(n.k = o.k, false) AS kept, CASE WHEN n.k = o.k THEN s_acctbal ELSE 0 END AS score
  FROM n LEFT JOIN o USING (id)""")
def reset_identities(t):
    people = t.annotators
    old = people.where("annotator_id % 10 <> 9").selectExpr("annotator_id", "owner_id AS identity")
    new = people.where("annotator_id % 10 <> 3").selectExpr(
        "annotator_id", "owner_id + CAST(annotator_id % 7 = 0 AS INT) AS identity")
    return reset_changed_identities(people.selectExpr("annotator_id", "stake AS score"), old, new, ["score"])
