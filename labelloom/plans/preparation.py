"""Queries: splits, samples, batches, plans, pools, tiles, point clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.functions import taxonomy as T
from labelloom.functions import text as X
from labelloom.operators import dedup as D
from labelloom.operators import match as M
from labelloom.operators import prepare as P
from labelloom.plans import sqltext as Q
from labelloom.plans.registry import query
from labelloom.plans.scoring import R6

BUCKET = "(('0x' || substr(sha256(doc_id || '42'), 1, 8))::BIGINT % 100)"


@query("hash_split", f"""SELECT doc_id, CASE WHEN {BUCKET} < 60 THEN 'train' WHEN {BUCKET} < 80 THEN 'val' ELSE 'inference' END
   AS part FROM documents""")
def hash_split(t):
    return P.hash_split(t.raw("documents").select("doc_id"), "doc_id")


@query("hash_split_two_way", f"SELECT doc_id, CASE WHEN {BUCKET} < 70 THEN 'train' ELSE 'inference' END AS part FROM documents")
def hash_split_two_way(t):
    return P.hash_split(t.raw("documents").select("doc_id"), "doc_id", train=70, val=0)


@query("golden_split", """SELECT page_id, ('0x' || substr(sha256(page_id || ':7'), 1, 8))::BIGINT / 4294967295.0 < 0.25 AS is_golden
   FROM pages""")
def golden_split(t):
    return P.golden_split(t.raw("pages").select("page_id"), "page_id", 0.25, "7")


def _order(seed: str, key: str) -> str:
    return f"sha256('{seed}|' || {key}), {key}"


@query("capped_training_pool", f"""SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY
    {_order('pool', 'doc_id')}) AS r FROM documents WHERE {BUCKET} < 60) WHERE r <= 20""")
def capped_training_pool(t):
    train = P.hash_split(t.raw("documents").select("doc_id", "source"), "doc_id").where("part = 'train'")
    return P.sample_rows(train, "doc_id", 20, "pool", ["source"]).select("source", "doc_id")


@query("holdout_ids", f"SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY {_order('hold', 'doc_id')} LIMIT 150)")
def holdout_ids(t):
    return P.sample_rows(t.raw("documents").select("doc_id"), "doc_id", 150, "hold")


@query("sample_participants", f"""SELECT annotator_id FROM (SELECT s_suppkey AS annotator_id FROM supplier WHERE s_suppkey NOT IN
   (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')) ORDER BY {_order('p', 'annotator_id')} LIMIT 25""")
def sample_participants(t):
    out = t.raw("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("annotator_id"))
    return P.sample_participants(t.annotators.select("annotator_id"), out, 25, "p")


@query("top_participants", f"""SELECT annotator_id FROM (SELECT s_suppkey AS annotator_id FROM supplier WHERE s_acctbal >=
   (SELECT quantile_cont(s_acctbal, 0.9) FROM supplier) AND s_nationkey % 2 = 1) ORDER BY {_order('t', 'annotator_id')} LIMIT 3""")
def top_participants(t):
    people = t.annotators.select("annotator_id", "stake", (F.col("owner_id") % 2 == 1).alias("trusted"))
    return P.top_participants(people, 0.9, 3, "t")


@query("choose_golden_rich", f"""WITH o AS (SELECT l_partkey AS item_id, count(*) AS objects FROM lineitem GROUP BY 1),
  g AS (SELECT item_id FROM o WHERE objects >= 35 ORDER BY {_order('g', 'item_id')} LIMIT 100),
  r AS (SELECT item_id FROM o ANTI JOIN g USING (item_id) ORDER BY {_order('g/raw', 'item_id')} LIMIT 400)
  SELECT item_id, 'golden' AS role FROM g UNION ALL SELECT item_id, 'raw' FROM r""")
def choose_golden_rich(t):
    counts = t.raw("lineitem").groupBy(F.col("l_partkey").alias("item_id")).agg(F.count("*").alias("objects"))
    return P.choose_golden_rich(counts, 100, 400, "g", 35)


@query("stratified_sample", f"""WITH k AS (SELECT count(DISTINCT source) AS k FROM documents),
  r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_order('s', 'doc_id')}) AS r FROM documents),
  f AS (SELECT *, r > greatest(1, 190 // (SELECT k FROM k)) AS late FROM r)
  SELECT doc_id, source FROM f ORDER BY late, {_order('s', 'doc_id')} LIMIT 190""")
def stratified_sample(t):
    return P.stratified_sample(t.raw("documents").select("doc_id", "source"), "doc_id", "source", 190, "s")


@query("inject_golden", f"""{Q.with_tables('items')}, g AS (SELECT item_id FROM items WHERE role = 'golden' ORDER BY
    {_order('q/golden', 'item_id')} LIMIT 12), p AS (SELECT item_id FROM items WHERE role = 'public' ORDER BY
    {_order('q/public', 'item_id')} LIMIT 108), u AS (SELECT item_id FROM g UNION ALL SELECT item_id FROM p)
  SELECT item_id, row_number() OVER (ORDER BY {_order('q/order', 'item_id')}) AS position FROM u""")
def inject_golden(t):
    return P.inject_golden(t.items, 120, 12, "q").select("item_id", "position")


@query("mask_items", f"""WITH plan AS (SELECT p_partkey AS item_id, p_partkey % 40 AS task_id FROM part),
  a AS (SELECT s_suppkey AS annotator_id, s_suppkey % 40 AS task_id FROM supplier)
  SELECT task_id, item_id, annotator_id, sha256('salt|' || annotator_id || '|' || item_id) AS token FROM plan JOIN a USING (task_id)""")
def mask_items(t):
    plan = t.items.select("item_id", (F.col("item_id") % 40).alias("task_id"))
    return P.mask_items(plan, t.annotators.select("annotator_id", (F.col("annotator_id") % 40).alias("task_id")), "salt")


@query("sample_points", """WITH r AS (SELECT n_name AS region, n_nationkey * 5 - 60 AS lon, n_nationkey - 12 AS lat FROM nation),
  p AS (SELECT r.*, unnest(range(50)) AS point FROM r)
  SELECT region, point, round(lon + 4 * ('0x' || substr(sha256('m:' || region || ':' || point || ':lon'), 1, 8))::BIGINT / 4294967295.0, 6) AS lon,
   round(lat + 2 * ('0x' || substr(sha256('m:' || region || ':' || point || ':lat'), 1, 8))::BIGINT / 4294967295.0, 6) AS lat FROM p""")
def sample_points(t):
    regions = t.raw("nation").selectExpr(
        "n_name AS region", "n_nationkey * 5D - 60D AS lon_min", "n_nationkey * 5D - 56D AS lon_max",
        "n_nationkey - 12D AS lat_min", "n_nationkey - 10D AS lat_max")
    return P.sample_points(regions, 50, "m").select("region", "point", R6("lon"), R6("lat"))


@query("dedup_content", "SELECT min(doc_id) AS doc_id, any_value(n_chars) AS n_chars FROM documents GROUP BY sha256(text)")
def dedup_content(t):
    return P.dedup_content(t.raw("documents").select("doc_id", "text", "n_chars"), "doc_id", "text").select("doc_id", "n_chars")


@query("exclude_overlap", """SELECT doc_id FROM documents WHERE doc_id % 4 <> 0 AND sha256(text) NOT IN
   (SELECT sha256(text) FROM documents WHERE doc_id % 4 = 0)""")
def exclude_overlap(t):
    docs = t.raw("documents").select("doc_id", "text", "source")
    return P.exclude_overlap(docs.where("doc_id % 4 <> 0"), docs.where("doc_id % 4 = 0"), "text").select("doc_id")


@query("inventory", """WITH r AS (SELECT sha256(text) AS h, count(*) AS n FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1),
  g AS (SELECT sha256(text) AS h, count(*) AS m FROM documents WHERE doc_id % 3 = 0 GROUP BY 1),
  s AS (SELECT count(n) AS raw_unique, CAST(sum(n - 1) AS BIGINT) AS raw_duplicates, count(m) AS golden_unique,
    CAST(sum(m - 1) AS BIGINT) AS golden_duplicates, count(*) FILTER (n IS NOT NULL AND m IS NOT NULL) AS overlap
    FROM r FULL JOIN g USING (h)), b AS (SELECT *, least((raw_unique - overlap) // 27, golden_unique // 3) AS batches FROM s)
  SELECT *, raw_unique - overlap - batches * 27 AS public_unused, golden_unique - batches * 3 AS golden_unused FROM b""")
def inventory(t):
    docs = t.raw("documents").select("doc_id", "text")
    return P.inventory(docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0"), "text")


@query("make_batches", f"""{Q.with_tables('items')}, r AS (SELECT item_id, CASE WHEN role = 'public' THEN 'public' ELSE 'golden' END AS role,
    row_number() OVER (PARTITION BY role = 'public' ORDER BY item_id) - 1 AS i FROM items),
  b AS (SELECT item_id, role, i // CASE role WHEN 'public' THEN 27 ELSE 3 END + 1 AS batch,
    i % CASE role WHEN 'public' THEN 27 ELSE 3 END + 1 AS slot FROM r),
  c AS (SELECT least(count(*) FILTER (role = 'public') // 27, count(*) FILTER (role <> 'public') // 3) AS cap FROM items)
  SELECT b.* FROM b, c WHERE batch <= cap""")
def make_batches(t):
    return P.make_batches(t.items.where("role = 'public'"), t.items.where("role <> 'public'"), "item_id")


@query("epoch_plan", f"""{Q.with_tables('items')}, c AS (SELECT count(*) AS n, count(*) FILTER (role <> 'public') AS g FROM items),
  tasks AS (SELECT i AS task, least(30, n - (i - 1) * 30) AS size, g FROM (SELECT unnest(range(1, (n + 29) // 30 + 1)) AS i, n, g FROM c)),
  e AS (SELECT *, size * g / sum(size) OVER () AS exact FROM tasks),
  h AS (SELECT *, floor(exact + 1e-9) AS w, row_number() OVER (ORDER BY round(exact - floor(exact + 1e-9), 9) DESC, task) AS rn,
    g - sum(floor(exact + 1e-9)) OVER () AS extra FROM e),
  q AS (SELECT task, size, w + CASE WHEN rn <= extra THEN 1 ELSE 0 END AS gold FROM h),
  z AS (SELECT task, size, gold, sum(gold) OVER (ORDER BY task) AS ge, sum(size - gold) OVER (ORDER BY task) AS pe FROM q),
  o AS (SELECT item_id, role <> 'public' AS is_golden, row_number() OVER (PARTITION BY role <> 'public' ORDER BY
    {_order('e', 'item_id')}) AS r FROM items),
  a AS (SELECT item_id, is_golden, task FROM o JOIN z ON (is_golden AND r > ge - gold AND r <= ge)
    OR (NOT is_golden AND r > pe - (size - gold) AND r <= pe))
  SELECT item_id, is_golden, task, row_number() OVER (PARTITION BY task ORDER BY {_order('e/order', 'item_id')}) AS position FROM a""")
def epoch_plan(t):
    return P.epoch_plan(t.items, "e")


WORDS = [f"('0x' || substr(sha256(v), {1 + 15 * i}, {15 if i < 3 else 15}))::BIGINT" for i in range(4)]


def _print_sql(rows: str, by: str) -> str:
    """Fingerprint over ``rows`` (columns ``by`` and text ``v``)."""
    sums = ", ".join(f"CAST(sum({w}::HUGEINT) AS VARCHAR) AS s{i}" for i, w in enumerate(WORDS))
    keys = f"{by}, " if by else ""
    return (f"(SELECT {keys}rows, sha256(rows || '|' || s0 || '|' || s1 || '|' || s2 || '|' || s3) AS fingerprint FROM "
            f"(SELECT {keys}count(*) AS rows, {sums} FROM {rows} {'GROUP BY ' + by if by else ''}))")


@query("pool_fingerprint", "SELECT * FROM " + _print_sql(
    "(SELECT source, doc_id || '|' || lang || '|' || n_chars AS v FROM documents)", "source"))
def pool_fingerprint(t):
    return P.pool_hash(t.raw("documents"), ["doc_id", "lang", "n_chars"], ["source"])


PRINTS = "p AS " + _print_sql("""(SELECT round_num, item_id, annotator_id, lower(trim(label)) || '|' || CAST(x1 * 100 AS BIGINT) || '|' ||
   CAST(y1 * 100 AS BIGINT) || '|' || CAST(x2 * 100 AS BIGINT) || '|' || CAST(y2 * 100 AS BIGINT) AS v FROM annotations)""",
                              "round_num, item_id, annotator_id")


@query("submission_fingerprints", f"""{Q.with_tables('annotations')}, {PRINTS}
  SELECT *, count(*) OVER w AS copies, min(annotator_id) OVER w AS first_annotator FROM p
  WINDOW w AS (PARTITION BY round_num, item_id, fingerprint)""")
def submission_fingerprints(t):
    return D.submission_fingerprints(t.annotations)


@query("round_fingerprints", f"""{Q.with_tables('annotations')}, {PRINTS}, q AS (SELECT round_num, annotator_id,
    item_id || '|' || fingerprint AS v FROM p) SELECT * FROM {_print_sql('q', 'round_num, annotator_id')}""")
def round_fingerprints(t):
    return D.round_fingerprints(D.submission_fingerprints(t.annotations))


@query("conversation_fingerprints", "SELECT * FROM " + _print_sql(
    "(SELECT conv_id, role || '|' || text AS v FROM conversations)", "conv_id"))
def conversation_fingerprints(t):
    return P.pool_hash(t.raw("conversations"), ["role", "text"], ["conv_id"])


@query("near_duplicates", f"""{Q.with_tables('annotations')}, b AS (SELECT round_num, item_id % 300 AS item_id, annotator_id, {Q.canonical('label')} AS l,
    CAST(round_even(x1 / 64, 0) AS BIGINT) AS b1, CAST(round_even(y1 / 64, 0) AS BIGINT) AS b2,
    CAST(round_even(x2 / 64, 0) AS BIGINT) AS b3, CAST(round_even(y2 / 64, 0) AS BIGINT) AS b4 FROM annotations),
  c AS (SELECT round_num, item_id, annotator_id, l, b1, b2, b3, b4, count(*) AS k FROM b GROUP BY ALL),
  n AS (SELECT round_num, item_id, annotator_id, sum(k) AS n FROM c GROUP BY ALL),
  s AS (SELECT x.round_num, x.item_id, x.annotator_id, y.annotator_id AS prior, sum(least(x.k, y.k)) AS s FROM c x JOIN c y
    USING (round_num, item_id, l, b1, b2, b3, b4) WHERE y.annotator_id < x.annotator_id GROUP BY ALL)
  SELECT s.round_num, s.item_id, s.annotator_id, min(prior) AS earlier_annotator FROM s
   JOIN n a ON a.round_num = s.round_num AND a.item_id = s.item_id AND a.annotator_id = s.annotator_id
   JOIN n p ON p.round_num = s.round_num AND p.item_id = s.item_id AND p.annotator_id = s.prior
  WHERE s.s / greatest(a.n, p.n) >= 0.95 GROUP BY ALL""")
def near_duplicates(t):
    merged = t.annotations.withColumn("item_id", F.col("item_id") % 300)
    return D.near_duplicates(merged, pixels=64.0)


@query("neutral_ids", """SELECT page_id, 'chip_' || substr(sha256(html), 1, 16) || CASE WHEN page_id % 2 = 0 THEN '.jpg' ELSE '.png' END AS chip
   FROM pages""")
def neutral_ids(t):
    suffix = F.when(F.col("page_id") % 2 == 0, ".JPG").otherwise(".tif")
    return t.raw("pages").select("page_id", X.neutral_id(F.col("html"), suffix).alias("chip"))


@query("clean_tiles", f"""{Q.with_tables('pixels')}, s AS (SELECT item_id, avg((r <= 60 AND g <= 60 AND b <= 60)::INT) AS dark,
    avg((r >= 190 AND g >= 190 AND b >= 190)::INT) AS bright FROM pixels GROUP BY 1)
  SELECT item_id, round(dark, 6) AS dark, round(bright, 6) AS bright FROM s WHERE dark < 0.05 AND bright < 0.10""")
def clean_tiles(t):
    return P.filter_clean_tiles(t.pixels, 60, 190).select("item_id", R6("dark"), R6("bright"))


def _biome_sql() -> str:
    def has(words):
        return "(" + " OR ".join(f"contains(b, '{w}')" for w in words) + ")"

    whens = ""
    for words, steps, base in T.BIOME_RULES:
        inner = " ".join(f"WHEN a > {s} THEN '{n}'" for s, n in steps)
        whens += f"WHEN {has(words)} THEN CASE {inner} ELSE '{base}' END "
    return (f"CASE {whens} WHEN {has(T.DRY_BIOMES)} THEN CASE WHEN a < 200 THEN 'Understory Shrub' ELSE 'Dry Forest Tree' END "
            "WHEN a > 2000 THEN 'dense_tree' WHEN a < 150 THEN 'plant' ELSE 'ordinary_tree' END")


BIOMES = ["Zanzibar coastal mosaic", "Scandinavian taiga", "Amazon rain forest", "Sarmatic mixed forest", "Gangetic steppe", "Alpine"]
BIOME_PICK = "CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(BIOMES)) + " END"


@query("infer_class", f"""WITH r AS (SELECT p_partkey AS item_id, lower({BIOME_PICK}) AS b, greatest(0.0, p_size - 5.0) AS x1, least(1024.0, p_size * 3.0)
    AS x2, 0.0 AS y1, least(256.0, p_size * 2.0) AS y2, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice * 2 ELSE 0 END AS area FROM part),
  s AS (SELECT *, CASE WHEN area > 0 THEN area ELSE (x2 - x1) * (y2 - y1) END AS a FROM r WHERE x2 - x1 >= 4 AND y2 - y1 >= 4)
  SELECT item_id, {_biome_sql()} AS label, round_even(a, 2) AS area FROM s""")
def infer_class(t):
    rows = t.raw("part").selectExpr(
        "p_partkey AS item_id", f"{BIOME_PICK} AS biome", "p_size - 5D AS x", "0D AS y", "p_size * 3D - (p_size - 5D) AS w",
        "p_size * 2D AS h", "1024 AS width", "256 AS height", "CASE WHEN p_partkey % 3 = 0 THEN p_retailprice * 2 ELSE 0D END AS area")
    return P.infer_class(rows).select("item_id", "label", "area")


@query("segmentation_points", """SELECT p_partkey AS item_id, CASE WHEN p_size % 5 >= 2 THEN p_size % 5 + 1 END AS points,
   CASE WHEN p_size % 5 >= 2 THEN round((p_size % 5) * 1.5 * (p_size % 5 + 1) , 4) END AS x_sum FROM part""")
def segmentation_points(t):
    flat = F.transform(F.sequence(F.lit(0), (F.col("p_size") % 5) * 2 + 1), lambda i: F.when(i % 2 == 0, i * 1.5).otherwise(i * 2.0))
    got = P.segmentation_to_polygon(t.raw("part").select("p_partkey", flat.alias("segmentation")))
    total = F.aggregate("polygon", F.lit(0.0), lambda a, p: a + p["x"])
    return got.select(F.col("p_partkey").alias("item_id"), F.when(F.col("polygon").isNotNull(), F.size("polygon")).alias("points"),
                      F.round(total, 4).alias("x_sum"))


@query("filter_scenes", """SELECT event_id FROM events WHERE ts >= '2024-01-10' AND ts < '2024-01-20' AND value < 20
   AND user_id % 100 - 50 + 6 >= -10 AND user_id % 100 - 50 <= 20""")
def filter_scenes(t):
    scenes = t.raw("events").selectExpr(
        "event_id", "ts AS acquired", "value AS cloud", "user_id % 100 - 50D AS lon_min", "user_id % 100 - 44D AS lon_max",
        "0D AS lat_min", "5D AS lat_max")
    return P.filter_scenes(scenes, "2024-01-10", "2024-01-20", 20.0, (-10, -5, 20, 10)).select("event_id")


@query("median_composite", """SELECT user_id AS cell, event_type AS band, round(median(value), 6) AS median, count(*) AS scenes FROM events
   GROUP BY ALL""")
def median_composite(t):
    bands = t.raw("events").selectExpr("user_id AS cell", "event_type AS band", "value")
    return P.median_composite(bands).select("cell", "band", R6("median"), "scenes")


def _cases(col: str, table: dict, default: str) -> str:
    keys = (f"WHEN {k!r} THEN '{v}'" if isinstance(k, str) else f"WHEN {k} THEN '{v}'" for k, v in table.items())
    return f"CASE {col} {' '.join(keys)} ELSE '{default}' END"


@query("label_tiles", f"""WITH r AS (SELECT p_partkey AS item_id, (p_partkey % 13) * 10 AS c, CASE WHEN p_partkey % 8 = 0 THEN p_size ELSE 0 END AS loss
   FROM part), l AS (SELECT *, CASE WHEN loss > 0 THEN 'deforestation' ELSE {_cases('c', T.COVER_CODES, 'bare_land')} END AS label FROM r)
  SELECT item_id, label, {_cases('label', T.COVER_SEVERITY, 'low')} AS severity FROM l""")
def label_tiles(t):
    tiles = t.raw("part").selectExpr(
        "p_partkey AS item_id", "(p_partkey % 13) * 10 AS cover", "CASE WHEN p_partkey % 8 = 0 THEN p_size ELSE 0 END AS loss_year")
    return P.label_tiles(tiles).select("item_id", "label", "severity")


CLUSTER_SQL = f"""{Q.with_tables('points')}, d AS (SELECT item_id, x, y, count(*) AS k FROM points GROUP BY ALL),
  e AS (SELECT a.item_id, a.x, a.y, b.x AS qx, b.y AS qy FROM d a JOIN d b ON a.item_id = b.item_id
    AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 22),
  reach AS (SELECT item_id, x, y, qx, qy FROM e UNION SELECT r.item_id, r.x, r.y, e.qx, e.qy FROM reach r JOIN e
    ON e.item_id = r.item_id AND e.x = r.qx AND e.y = r.qy),
  root AS (SELECT item_id, x, y, min({{'x': qx, 'y': qy}}) AS root FROM reach GROUP BY ALL),
  boxes AS (SELECT item_id, greatest(0, floor(min(x) - 8)) AS x1, greatest(0, floor(min(y) - 8)) AS y1,
    least(500, ceil(max(x) + 8)) AS x2, least(500, ceil(max(y) + 8)) AS y2, CAST(sum(k) AS BIGINT) AS n FROM root JOIN d USING (item_id, x, y)
    GROUP BY item_id, root)"""


@query("cluster_points", CLUSTER_SQL + " SELECT *, CASE WHEN n = 1 THEN 'tree' ELSE 'tree_group' END AS label FROM boxes")
def cluster_points(t):
    return P.cluster_points(t.points, 22.0, width=500, height=500)


# One step takes the next box of a pass, starts another pass after one that grew, or goes on with the next unclaimed box.
@query("merge_boxes", f"""{Q.with_tables('annotations')}, b AS (SELECT item_id, list({{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY seq) AS q FROM annotations GROUP BY 1),
  s AS (SELECT item_id, q[1] AS cur, 1 AS n, q[2:] AS todo, q[1:0] AS kept, false AS grew FROM b
   UNION ALL SELECT item_id,
     CASE WHEN len(todo) > 0 THEN CASE WHEN hit THEN {{'x1': least(cur.x1, e.x1), 'y1': least(cur.y1, e.y1), 'x2': greatest(cur.x2, e.x2), 'y2': greatest(cur.y2, e.y2)}} ELSE cur END
       WHEN grew THEN cur ELSE kept[1] END,
     CASE WHEN len(todo) > 0 THEN n + hit::INT WHEN grew THEN n ELSE 1 END,
     CASE WHEN len(todo) > 0 THEN todo[2:] WHEN grew THEN kept ELSE kept[2:] END,
     CASE WHEN len(todo) > 0 THEN CASE WHEN hit THEN kept ELSE list_append(kept, e) END ELSE kept[1:0] END,
     CASE WHEN len(todo) > 0 THEN grew OR hit ELSE false END
   FROM (SELECT *, coalesce({Q.iou('cur', 'e')} > 0.2, false) AS hit FROM (SELECT *, todo[1] AS e FROM s)) WHERE len(todo) > 0 OR grew OR len(kept) > 0)
  SELECT item_id, cur.x1 AS x1, cur.y1 AS y1, cur.x2 AS x2, cur.y2 AS y2, n FROM s WHERE len(todo) = 0 AND NOT grew""")
def merge_boxes(t):
    boxes = t.annotations.select("item_id", "seq", "x1", "y1", "x2", "y2", F.lit(1).alias("n"))
    return M.merge_boxes(boxes, threshold=0.2)


@query("source_union", f"""WITH r AS (SELECT source, doc_id, sha256(text) AS h, CASE source WHEN 'web' THEN 0 ELSE 1 END AS prio FROM documents),
  f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY source, doc_id) AS d FROM r
    WHERE h NOT IN (SELECT sha256(text) FROM benchmark)) WHERE d = 1)
  SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS c FROM f) WHERE c <= 40""")
def source_union(t):
    from labelloom.sources.readers import union_sources

    docs = t.raw("documents").select("source", "doc_id", F.sha2("text", 256).alias("item_hash"))
    golden = t.raw("benchmark").select(F.sha2("text", 256).alias("item_hash"))
    return union_sources(docs, golden, 40).select("source", "doc_id")
