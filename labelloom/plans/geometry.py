"""Queries: geometry and taxonomy expressions, readers and writers over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.functions import geometry as G
from labelloom.functions import taxonomy as T
from labelloom.functions import text as X
from labelloom.operators import match as M
from labelloom.operators import score as S
from labelloom.plans import sqltext as Q
from labelloom.plans.registry import query
from labelloom.plans.scoring import BASE, EDGES, OUTLINE_EDGES, R6, golden_annotations
from labelloom.sources import readers as R
from labelloom.sources import sinks as K

KEY = ["item_id", "annotator_id", "seq"]


@query("polygon_measures", f"""{Q.with_tables('annotations')} SELECT item_id, annotator_id, seq, round(CASE shape WHEN 'octagon' THEN {Q.OCTA_AREA}
   WHEN 'star' THEN {Q.STAR_AREA} ELSE (x2 - x1) * (y2 - y1) END, 4) AS area, round(CASE shape WHEN 'octagon' THEN {Q.OCTA_PERIMETER} WHEN 'star'
   THEN {Q.STAR_PERIMETER} ELSE 2 * (x2 - x1 + y2 - y1) END, 4) AS length, CASE shape WHEN 'octagon' THEN 1.0 WHEN 'star'
   THEN round({Q.STAR_AREA} / {Q.STAR_HULL}, 4) ELSE 1.0 END AS convexity FROM annotations WHERE shape <> 'none'""")
def polygon_measures(t):
    df = t.outlined.where("shape <> 'none'").withColumn("_o", G.outline_stats("polygon"))
    return df.select(*KEY, F.round("_o.area", 4).alias("area"), F.round("_o.length", 4).alias("length"),
                     F.round(G.convexity(F.col("_o.area"), F.col("_o.hull")), 4).alias("convexity"))


@query("crude_boxes", f"""{Q.with_tables('annotations')} SELECT item_id, annotator_id, seq, shape IN ('none', 'rect') AS is_box, shape = 'star' AS is_spiky
   FROM annotations""")
def crude_boxes(t):
    return S.outline_quality(t.outlined).select(*KEY, "is_box", "is_spiky")


@query("shoelace_expressions", f"""{Q.with_tables('annotations')} SELECT item_id, round(sum(CASE shape WHEN 'octagon' THEN {Q.OCTA_AREA} WHEN 'star' THEN {Q.STAR_AREA}
   WHEN 'rect' THEN (x2 - x1) * (y2 - y1) END), 3) AS area, round(sum(CASE shape WHEN 'octagon' THEN {Q.OCTA_PERIMETER} WHEN 'star' THEN {Q.STAR_PERIMETER}
   WHEN 'rect' THEN 2 * (x2 - x1 + y2 - y1) END), 3) AS length, count(*) AS n FROM annotations GROUP BY 1""")
def shoelace_expressions(t):
    outline = F.col("polygon")
    return t.outlined.groupBy("item_id").agg(
        F.round(F.sum(F.when(outline.isNotNull(), G.shoelace(outline))), 3).alias("area"),
        F.round(F.sum(F.when(outline.isNotNull(), G.perimeter(outline))), 3).alias("length"), F.count("*").alias("n"))


@query("raster_iou", f"""{BASE}, {OUTLINE_EDGES} SELECT item_id, annotator_id, seq, gt, round(iou, 6) AS raster_iou FROM op_i
   WHERE {Q.iou("{'x1': ax1, 'y1': ay1, 'x2': ax2, 'y2': ay2}", "{'x1': bx1, 'y1': by1, 'x2': bx2, 'y2': by2}")} >= 0.3""")
def raster_iou(t):
    """Overlap of annotation outlines with those of the truth; of the boxes where one has none."""
    pairs = M.iou_join(t.outlined.withColumnRenamed("polygon", "poly"), t.golden_outlined.withColumnRenamed("polygon", "poly"), ["item_id"], 0.3)
    keep = pairs.select("item_id", F.col("a_annotator_id").alias("annotator_id"), F.col("a_seq").alias("seq"), F.col("b_gt").alias("gt"),
                        "a_poly", "b_poly", *[p + c for p in ("a_", "b_") for c in ("x1", "y1", "x2", "y2")])
    return G.raster_iou(keep).select("item_id", "annotator_id", "seq", "gt", R6("raster_iou"))


def _points_sql(points: str, digits: int) -> str:
    return f"array_to_string(list_transform({points}, lambda q: printf('%.{digits}f,%.{digits}f', q.x, q.y)), ' ')"


def _points(column: str, digits: int):
    return F.array_join(F.transform(column, lambda q: F.format_string(f"%.{digits}f,%.{digits}f", q["x"], q["y"])), " ")


def _mean_sql(axis: str) -> str:
    return f"list_reduce(list_transform(ins, lambda q: q.{axis}), lambda a, b: a + b) / len(ins)"


@query("sanitize_polygons", f"""{Q.with_tables('annotations')}, src AS (SELECT *, list_transform(list_reverse({Q.ANNOTATION_POINTS}), lambda q: {{'x': q.x + 0.001::DOUBLE, 'y': q.y + 0.001::DOUBLE}}) AS pts FROM annotations WHERE shape <> 'none'),
  cl AS (SELECT *, list_transform(pts, lambda q: {{'x': greatest(x1, least(x2, round_even(q.x, 2))), 'y': greatest(y1, least(y2, round_even(q.y, 2)))}}) AS ins FROM src),
  m AS (SELECT *, {_mean_sql('x')} AS mx, {_mean_sql('y')} AS my FROM cl),
  s AS (SELECT *, list_sort(list_transform(range(1, len(ins) + 1), lambda i: {{'t': atan2(ins[i].y - my, ins[i].x - mx), 'i': i, 'x': ins[i].x, 'y': ins[i].y}})) AS p FROM m)
  SELECT item_id, annotator_id, seq, {_points_sql('p', 2)} AS outline FROM s""")
def sanitize_polygons(t):
    # A little off, so that no coordinate is a tie of the rounding.
    moved = F.transform(F.reverse("polygon"), lambda q: G.point(q["x"] + 0.001, q["y"] + 0.001))
    got = G.sanitize_polygons(t.outlined.where("shape <> 'none'").withColumn("polygon", moved), "p")
    return got.select(*KEY, _points("p", 2).alias("outline"))


# Outlines made for annotations without one: a parcel for fields, else a canopy of eight points.
_CANOPY_SQL = """list_transform(range(0, 8), lambda i: {'x': greatest(x1, least(x2, round_even((x1 + x2) / 2 + (x2 - x1) / 2 * (0.94::DOUBLE + 0.04::DOUBLE * sin(i * 1.5::DOUBLE)) * cos(i * (pi() / 4)), 2))),
   'y': greatest(y1, least(y2, round_even((y1 + y2) / 2 + (y2 - y1) / 2 * (0.94::DOUBLE + 0.04::DOUBLE * sin(i * 1.5::DOUBLE)) * sin(i * (pi() / 4)), 2)))})"""
_PARCEL_SQL = "[" + ", ".join(f"{{'x': round_even({x}, 2), 'y': round_even({y}, 2)}}" for x, y in (
    ("x1 + 0.08::DOUBLE * (x2 - x1)", "y1"), ("x2 - 0.08::DOUBLE * (x2 - x1)", "y1"), ("x2", "y1 + 0.12::DOUBLE * (y2 - y1)"), ("x2", "y2 - 0.08::DOUBLE * (y2 - y1)"),
    ("x2 - 0.12::DOUBLE * (x2 - x1)", "y2"), ("x1 + 0.08::DOUBLE * (x2 - x1)", "y2"), ("x1", "y2 - 0.12::DOUBLE * (y2 - y1)"), ("x1", "y1 + 0.08::DOUBLE * (y2 - y1)"))) + "]"


@query("synthetic_outlines", f"""{Q.with_tables('annotations')} SELECT item_id, annotator_id, seq, CASE WHEN label = 'field' THEN {_points_sql(_PARCEL_SQL, 2)}
   ELSE {_points_sql(_CANOPY_SQL, 2)} END AS outline FROM annotations""")
def synthetic_outlines(t):
    """The outline every annotation would get without its own."""
    got = G.sanitize_polygons(t.annotations.withColumn("polygon", F.lit(None).cast(G.POINTS)), "p")
    return got.select(*KEY, _points("p", 2).alias("outline"))


_ELLIPSE_SQL = """list_transform(range(0, 8), lambda i: {'x': round_even((x1 + x2) / 2 + (x2 - x1) / 2 * 0.9::DOUBLE * cos(i * (2 * pi() / 8)), 2),
   'y': round_even((y1 + y2) / 2 + (y2 - y1) / 2 * 0.9::DOUBLE * sin(i * (2 * pi() / 8)), 2)})"""


@query("clean_polygons", f"""{Q.with_tables('annotations')} SELECT item_id, annotator_id, seq, {_points_sql(f"CASE WHEN shape = 'none' THEN {_ELLIPSE_SQL} ELSE {Q.ANNOTATION_POINTS} END", 5)} AS outline FROM annotations""")
def clean_polygons(t):
    doubled = F.concat(F.flatten(F.transform("polygon", lambda p: F.array(p, p))), F.slice("polygon", 1, 1))
    return t.outlined.withColumn("p", G.clean_polygon(doubled)).select(*KEY, _points("p", 5).alias("outline"))


@query("taxonomy", f"""{Q.with_tables('annotations')} SELECT label, {Q.canonical('label')} AS canonical, {Q.carbon(Q.canonical('label'))} AS carbon_class,
   {Q.multiplier(Q.canonical('label'))} AS multiplier, {Q.severity(Q.canonical('label'))} AS severity, count(*) AS n FROM annotations GROUP BY ALL""")
def taxonomy(t):
    return T.with_taxonomy(t.annotations.select("label")).groupBy("label", "canonical", "carbon_class", "multiplier", "severity").agg(
        F.count("*").alias("n"))


WORDS = ["No hard-hat here", "missing vest", "scaffold edge", "Electrical spark", "helmet", "trip_hazard", "", "Oil Palm", "unknown thing", "forest"]
WORD_SQL = "CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(WORDS)) + " END"


@query("keyword_severity", f"SELECT p_partkey AS item_id, {Q.severity('w')} AS severity, {Q.canonical('w')} AS canonical FROM (SELECT p_partkey, {WORD_SQL} || CASE WHEN p_partkey % 4 = 0 THEN ' ' || p_type ELSE '' END AS w FROM part)")
def keyword_severity(t):
    w = F.expr(f"concat({WORD_SQL}, CASE WHEN p_partkey % 4 = 0 THEN concat(' ', p_type) ELSE '' END)")
    return t.raw("part").select(F.col("p_partkey").alias("item_id"), T.keyword_severity(w).alias("severity"), T.canonical_label(w).alias("canonical"))


@query("label_match", f"""{BASE}, c AS (SELECT a.item_id, a.annotator_id, a.seq, g.gt, {Q.match(Q.canonical('a.label'), Q.canonical('g.label'))} AS m FROM annotations a
   JOIN golden g ON g.item_id = a.item_id AND a.x1 < g.x2 AND g.x1 < a.x2 AND a.y1 < g.y2 AND g.y1 < a.y2) SELECT * FROM c""")
def label_match(t):
    pairs = M.iou_join(t.annotations, t.golden, ["item_id"])
    m = T.label_match(T.canonical_label(F.col("a_label")), T.canonical_label(F.col("b_label")))
    return pairs.select("item_id", F.col("a_annotator_id").alias("annotator_id"), F.col("a_seq").alias("seq"), F.col("b_gt").alias("gt"), m.alias("m"))


@query("image_names", r"""SELECT page_id, CASE WHEN regexp_matches(n, '(?i)\.(jpg|jpeg|png|tif|tiff)$') THEN n ELSE n || '.jpg' END AS name FROM (SELECT page_id,
   CASE page_id % 3 WHEN 0 THEN 'climate_' || page_id WHEN 1 THEN 'climate_' || page_id || '.PNG' ELSE 'chip' || page_id END AS n FROM pages)""")
def image_names(t):
    i = F.col("page_id")
    raw = F.when(i % 3 == 0, F.concat(F.lit("a:b/raw_climate_"), i)).when(i % 3 == 1, F.concat(F.lit("golden_climate_"), i, F.lit(".PNG"))).otherwise(
        F.concat(F.lit("s3://x/y/chip"), i))
    return t.raw("pages").select("page_id", X.image_name(raw).alias("name"))


@query("store_locations", r"""SELECT page_id, regexp_extract(url, '^[a-z0-9]+://([^/]+)/?(.*)$', 1) AS bucket, regexp_extract(url, '^[a-z0-9]+://([^/]+)/?(.*)$', 2) AS key FROM pages""")
def store_locations(t):
    return t.raw("pages").select("page_id", X.store_location(F.col("url")).alias("l")).select("page_id", "l.bucket", "l.key")


@query("source_specs", """SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN lang ELSE 'train' END AS split FROM documents""")
def source_specs(t):
    spec = F.concat(F.lit(" "), F.col("source"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("@ "), F.col("lang"))).otherwise(""))
    return t.raw("documents").select("doc_id", X.source_spec(spec).alias("s")).select("doc_id", "s.source", "s.split")


@query("spectral_stats", f"""{Q.with_tables('pixels')}, bx AS (SELECT p_partkey AS item_id, k AS seq, (p_size % 6 + k)::DOUBLE AS x1, (p_size % 5)::DOUBLE AS y1, (p_size % 6 + k + 8)::DOUBLE AS x2,
    (p_size % 5 + 6 + k)::DOUBLE AS y2 FROM part CROSS JOIN (VALUES (0), (1)) v(k)),
  j AS (SELECT b.*, (2 * g - r - b.b)::DOUBLE AS exg, (b.b - r)::DOUBLE AS b_r, (g - b.b)::DOUBLE AS g_b, (g - r) / (g + r - b.b + 1e-5) AS vari, 0.299 * r + 0.587 * g + 0.114 * b.b AS luma, r
   FROM (SELECT p.*, x1, y1, x2, y2, seq FROM pixels p JOIN bx USING (item_id) WHERE x >= x1 AND x < x2 AND y >= y1 AND y < y2) b),
  s AS (SELECT item_id, seq, count(*) AS n_pixels, avg(exg) AS e, avg(b_r) AS br, avg(g_b) AS moisture, var_pop(luma) AS v, avg((exg > -5)::INT) AS gf, any_value((x2 - x1) * (y2 - y1)) AS area FROM j GROUP BY ALL)
  SELECT item_id, seq, n_pixels, round(e, 5) AS mean_exg, round(br, 5) AS mean_b_minus_r, round(moisture, 5) AS moisture, round(v, 2) AS luma_var, round(gf, 5) AS green_fraction,
   (br > 20 AND e < 0) OR br > 30 AS is_water, CASE WHEN area > 1100 OR (area > 450 AND e > 25 AND v > 200) THEN 'dense_tree' WHEN v < 100 AND area > 100 AND e > 15 THEN 'field'
    WHEN area < 75 OR (area < 150 AND e < 18) THEN 'plant' ELSE 'ordinary_tree' END AS spectral_label FROM s""")
def spectral_stats(t):
    boxes = t.raw("part").select("p_partkey", "p_size", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).selectExpr(
        "p_partkey AS item_id", "k AS seq", "CAST(p_size % 6 + k AS DOUBLE) AS x1", "CAST(p_size % 5 AS DOUBLE) AS y1",
        "CAST(p_size % 6 + k + 8 AS DOUBLE) AS x2", "CAST(p_size % 5 + 6 + k AS DOUBLE) AS y2")
    got = S.spectral_stats(t.pixels, boxes)
    return got.select("item_id", "seq", "n_pixels", *[F.round(c, 5).alias(c) for c in ("mean_exg", "mean_b_minus_r", "moisture", "green_fraction")],
                      F.round("luma_var", 2).alias("luma_var"), "is_water", "spectral_label")


# A diamond of 128 pixels and a triangle too small to count, on an item's whole scene of 16 by 16.
SHAPES = {0: ((8, 0), (16, 8), (8, 16), (0, 8)), 1: ((1, 2), (9, 3), (4, 11))}
_POINTS_SQL = "CASE k " + " ".join(f"WHEN {k} THEN [{', '.join(f'{{x: {x}.0::DOUBLE + o, y: {y}.0::DOUBLE}}' for x, y in p)}]" for k, p in SHAPES.items()) + " END"


def inside_sql(points: str, x: str, y: str) -> str:
    """Whether the centre of pixel (x, y) lies inside a list of points: edges that cross its row to the left of it, odd."""
    p, q, n = f"{points}[i]", f"{points}[i % len({points}) + 1]", f"len({points})"
    return f"""len(list_filter(range(1, {n} + 1), lambda i: ({p}.y <= {y} + 0.5) <> ({q}.y <= {y} + 0.5)
      AND {x} + 0.5 >= {p}.x + ({y} + 0.5 - {p}.y) * ({q}.x - {p}.x) / ({q}.y - {p}.y))) % 2 = 1"""


@query("outline_spectral", f"""{Q.with_tables('pixels')}, o AS (SELECT p_partkey AS item_id, k AS seq, {_POINTS_SQL} AS pts FROM (SELECT *, (p_size % 3) / 2.0 AS o FROM part), (VALUES (0), (1)) v(k)),
  j AS (SELECT o.item_id, seq, 2 * g - r - b AS exg, b - r AS b_r, 0.299 * r + 0.587 * g + 0.114 * b AS luma, {inside_sql('pts', 'x', 'y')} AS inner_ FROM pixels JOIN o USING (item_id)),
  c AS (SELECT *, count(*) FILTER (inner_) OVER (PARTITION BY item_id, seq) > 50 AS masked FROM j)
  SELECT item_id, seq, masked, count(*) AS n_pixels, round(avg(exg), 5) AS mean_exg, round(avg(b_r), 5) AS mean_b_minus_r, round(var_pop(luma), 2) AS luma_var, round(avg((exg > -5)::INT), 5) AS green_fraction
  FROM c WHERE inner_ OR NOT masked GROUP BY ALL""")
def outline_spectral(t):
    shift = F.col("p_size") % 3 / 2.0
    shapes = [F.array(*[G.point(F.lit(float(x)) + shift, F.lit(float(y))) for x, y in p]) for p in SHAPES.values()]
    boxes = t.raw("part").select(F.col("p_partkey").alias("item_id"), F.posexplode(F.array(*shapes)).alias("seq", "polygon"), F.lit(0.0).alias("x1"),
                                 F.lit(0.0).alias("y1"), F.lit(16.0).alias("x2"), F.lit(16.0).alias("y2"))
    got = S.spectral_stats(t.pixels, boxes, outline="polygon")
    return got.select("item_id", "seq", "masked", "n_pixels", *[F.round(c, 5).alias(c) for c in ("mean_exg", "mean_b_minus_r", "green_fraction")],
                      F.round("luma_var", 2).alias("luma_var"))


# Scenes of golden items at a sixteenth of their size, 64 by 16 pixels, with annotations at the same scale.
_SCENE = "(item_id * 7 + x * 3 + y) % 120 AS r, (item_id * 5 + x + y * 11) % 160 AS g, (item_id * 13 + x * 2 + y) % 256 AS b"
_SMALL_SQL = """CASE shape WHEN 'rect' THEN [{x: x1, y: y1}, {x: x2, y: y1}, {x: x2, y: y2}, {x: x1, y: y2}]
   WHEN 'octagon' THEN [""" + ", ".join(f"{{x: x1 + (x2 - x1) * {a}::DOUBLE, y: y1 + (y2 - y1) * {b}::DOUBLE}}" for a, b in (
    ("0.3", "0.0"), ("0.7", "0.0"), ("1.0", "0.3"), ("1.0", "0.7"), ("0.7", "1.0"), ("0.3", "1.0"), ("0.0", "0.7"), ("0.0", "0.3"))) + f"""]
   WHEN 'star' THEN list_transform(range(0, {Q.STAR_POINTS}), lambda i: {{x: (x1 + x2) / 2 + (x2 - x1) / 2 * (CASE WHEN i % 2 = 0 THEN 1.0::DOUBLE ELSE {Q.STAR_INNER}::DOUBLE END) * cos(i * {Q.STEP}::DOUBLE),
     y: (y1 + y2) / 2 + (y2 - y1) / 2 * (CASE WHEN i % 2 = 0 THEN 1.0::DOUBLE ELSE {Q.STAR_INNER}::DOUBLE END) * sin(i * {Q.STEP}::DOUBLE)}}) END"""


@query("water_audit", f"""{Q.with_tables('annotations', 'items')}, ga AS (SELECT a.* FROM annotations a JOIN items i USING (item_id) WHERE i.role <> 'public'),
  {Q.audit('audit', 'ga', list(S.SUBMISSION))},
  scene AS (SELECT item_id, x, y, {_SCENE} FROM items, (SELECT unnest(range(64)) AS x), (SELECT unnest(range(16)) AS y) WHERE role <> 'public'),
  small AS (SELECT round_num, item_id, annotator_id, seq, shape, x1 / 16 AS x1, y1 / 16 AS y1, x2 / 16 AS x2, y2 / 16 AS y2 FROM ga),
  pts AS (SELECT *, {_SMALL_SQL} AS p FROM small),
  j AS (SELECT t.round_num, t.item_id, t.annotator_id, t.seq, s.r, s.g, s.b, coalesce({inside_sql('t.p', 's.x', 's.y')}, false) AS inner_ FROM pts t JOIN scene s ON s.item_id = t.item_id
    AND s.x >= floor(x1) AND s.x < floor(x2) AND s.y >= floor(y1) AND s.y < floor(y2)),
  c AS (SELECT *, count(*) FILTER (inner_) OVER (PARTITION BY round_num, item_id, annotator_id, seq) > 6 AS masked, count(*) OVER (PARTITION BY round_num, item_id, annotator_id, seq) AS n FROM j),
  st AS (SELECT round_num, item_id, annotator_id, seq, any_value(n) AS n, (avg(b - r) > 20 AND avg(2 * g - r - b) < 0) OR avg(b) > avg(r) + 30 AS wet FROM c WHERE inner_ OR NOT masked GROUP BY ALL),
  w AS (SELECT round_num, item_id, annotator_id, count(*) AS water FROM st WHERE wet AND n > 8 GROUP BY ALL)
  SELECT round_num, item_id, annotator_id, total, CASE WHEN water > 0 THEN 0.0 ELSE quality END AS quality, acceptable AND water IS NULL AS acceptable,
    CASE WHEN water > 0 THEN concat_ws('; ', reason, 'ocean_water_hallucinations (' || water || ' stands)') ELSE reason END AS reason
  FROM audit LEFT JOIN w USING (round_num, item_id, annotator_id)""")
def water_audit(t):
    anns = golden_annotations(t)
    grid = t.items.where("role <> 'public'").select("item_id", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("x")).select(
        "item_id", "x", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("y"))
    scene = grid.selectExpr("item_id", "x", "y", *_SCENE.replace(", (", "|(").split("|"))
    small = anns.select(*S.SUBMISSION, "seq", *[(F.col(c) / 16).alias(c) for c in G.BOX], F.transform(
        "polygon", lambda p: F.struct((p["x"] / 16).alias("x"), (p["y"] / 16).alias("y"))).alias("polygon"))
    stats = S.spectral_stats(scene, small, (*S.SUBMISSION, "seq"), outline="polygon", least=6)
    got = S.audit_geometry(anns, water=S.water_counts(stats, least=8))
    return got.select(*S.SUBMISSION, "total", "quality", "acceptable", "reason")


@query("item_quality", f"""{Q.with_tables('annotations', 'averages')}, {Q.audit('audit', 'annotations', list(S.SUBMISSION))},
  c AS (SELECT round_num, item_id, annotator_id, sum(least(1.0, confidence) * (seq % 900 + 1)) / sum(seq % 900 + 1) AS mc FROM annotations GROUP BY ALL)
  SELECT round_num, item_id, annotator_id, round_even((0.35 * avg_fidelity / 3 + 0.25 * mc + 0.25 * (0.45 * round(mq, 4) + 0.55 * round(mc_, 4)) + 0.135) * quality, 4) AS item_quality
  FROM c JOIN (SELECT round_num, item_id, annotator_id, mq, mc AS mc_, quality FROM audit) USING (round_num, item_id, annotator_id) JOIN averages USING (annotator_id)""")
def item_quality(t):
    anns = t.outlined.withColumn("area", (F.col("seq") % 900 + 1).cast("double"))
    thirds = t.averages.withColumn("avg_fidelity", F.col("avg_fidelity") / 3)
    return S.item_quality(anns, S.audit_geometry(anns), thirds).select(*S.SUBMISSION, "item_quality")


# ---------------------------------------------------------------- readers and writers

@query("label_payloads", """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_partkey % 200 AS a, l_suppkey % 90 AS b, l_quantity * 20 AS c, l_linenumber * 30 AS d FROM lineitem),
  s AS (SELECT *, c + a <= 1025 AND d + b <= 257 AND c < 1024 AND d < 256 AS sized FROM b),
  x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, a AS x1, b AS y1, least(1024, CASE WHEN sized THEN a + c ELSE c END) AS x2, least(256, CASE WHEN sized THEN b + d ELSE d END) AS y2 FROM s)
  SELECT l_orderkey AS item_id, count(*) AS boxes, CAST(sum(x1) AS BIGINT) AS x1, CAST(sum(x2) AS BIGINT) AS x2, CAST(sum(y2) AS BIGINT) AS y2 FROM x WHERE x2 > x1 AND y2 > y1 GROUP BY 1""")
def label_payloads(t):
    rows = t.raw("lineitem")
    box = F.array(*[F.col(c).cast("double") for c in ("a", "b", "c", "d")])
    base = rows.selectExpr("l_orderkey AS item_id", "l_linenumber", "l_partkey % 200 AS a", "l_suppkey % 90 AS b", "l_quantity * 20 AS c", "l_linenumber * 30 AS d")
    either = F.when(F.col("item_id") % 2 == 0, F.to_json(F.struct(F.array(box).alias("bbox"), F.array(F.lit("Tree Top")).alias("category")))).otherwise(
        F.to_json(F.array(F.struct(box.alias("box"), F.lit("3").alias("category_id")))))
    payload = base.select("item_id", F.lit(1024).alias("width"), F.lit(256).alias("height"), either.alias("payload"))
    got = R.normalize_label_payload(payload, class_names=["a", "b", "c", "d"])
    return got.groupBy("item_id").agg(F.count("*").alias("boxes"), F.sum("x1").alias("x1"), F.sum("x2").alias("x2"), F.sum("y2").alias("y2"))


@query("coco_ingest", """WITH a AS (SELECT l_orderkey AS image_id, l_suppkey % 25 AS cat, l_linenumber = 7 AS crowd, l_partkey % 300 + 0.3 AS x, l_quantity + 0.6 AS y, l_linenumber * 10.0 - 20 AS w, 12.5 AS h FROM lineitem)
  SELECT a.image_id, replace(lower(trim(n_name)), ' ', '_') AS label, count(*) AS n, sum(round_even(x, 0)) AS x1, sum(round_even(y, 0)) AS y1, sum(round_even(x + w, 0)) AS x2, sum(round_even(y + h, 0)) AS y2
  FROM a JOIN nation ON n_nationkey = cat JOIN orders ON o_orderkey = image_id WHERE NOT crowd AND w > 0 GROUP BY ALL""")
def coco_ingest(t):
    images = t.raw("orders").selectExpr("o_orderkey AS id", "1024 AS width", "256 AS height")
    anns = t.raw("lineitem").selectExpr(
        "l_orderkey AS image_id", "CAST(l_suppkey % 25 AS INT) AS category_id", "CAST(l_linenumber = 7 AS INT) AS iscrowd",
        "array(l_partkey % 300 + 0.3D, l_quantity + 0.6D, l_linenumber * 10D - 20D, 12.5D) AS bbox")
    cats = t.raw("nation").selectExpr("n_nationkey AS id", "n_name AS name")
    return R.ingest_coco(images, anns, cats).groupBy("image_id", "label").agg(
        F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("label_manifest", """SELECT p_partkey AS item_id, CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 3 THEN 0 ELSE 1 END AS boxes,
   CASE WHEN p_partkey % 4 IN (0, 3) THEN CASE WHEN p_size % 2 = 0 THEN 'water' ELSE 'intact_forest' END END AS only_label,
   CASE WHEN p_partkey % 4 IN (1, 2) THEN CASE WHEN p_partkey % 4 = 1 THEN 'fire_scar' WHEN p_size % 2 = 0 THEN 'water' ELSE 'intact_forest' END END AS label,
   CASE p_partkey % 4 WHEN 1 THEN 'high' WHEN 2 THEN 'none' END AS severity, CASE p_partkey % 4 WHEN 1 THEN 3 END AS points FROM part""")
def label_manifest(t):
    i = F.col("p_partkey")
    kind = i % 4
    text = (
        F.when(kind == 1, '[{"hazard_class": "fire_scar", "bounding_box": [1, 2, 30.4, 40], "polygon": [[1, 2], [3], [30, 2], [30, 40]]}]')
        .when(kind == 2, '[{"bounding_box": [0, 0, 1024, 256]}, {"bounding_box": [5, 5, 2000, 9]}]')
        .when(kind == 3, '[{"hazard_class": "x", "bounding_box": [1, 2, 3]}]'))
    df = t.raw("part").select(i.alias("item_id"), F.when(F.col("p_size") % 2 == 0, " Water").otherwise("odd").alias("label"),
                              F.lit(1024).alias("width"), F.lit(256).alias("height"), text.alias("annotations"))
    got = R.ingest_label_manifest(df)
    return got.select("item_id", F.when(F.col("gt").isNotNull(), 1).otherwise(0).alias("boxes"), "only_label", "label",
                      F.when(F.col("label").isNotNull(), F.col("severity")).alias("severity"),
                      F.when(F.col("polygon").isNotNull(), F.size("polygon")).alias("points"))


@query("tile_scan", """SELECT p_partkey AS image_id, p_type AS biome, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 2 END AS boxes,
   CASE WHEN p_partkey % 5 <> 0 THEN 2 * p_size + 1.0 END AS x_sum FROM part""")
def tile_scan(t):
    size = F.col("p_size").cast("double")
    entry = lambda d: F.struct(F.array(size + d, F.lit(1.0), F.lit(5.0), F.lit(6.0)).alias("bbox"), F.lit(0.0).alias("area"))
    coco = F.when(F.col("p_partkey") % 5 != 0, F.to_json(F.array(entry(0.0), entry(1.0))))
    tiles = t.raw("part").select(F.col("p_partkey").alias("image_id"), F.lit(1024).alias("width"), F.lit(256).alias("height"),
                                 F.col("p_type").alias("biome_name"), coco.alias("coco_annotations"))
    return R.parse_tiles(tiles).groupBy("image_id", "biome").agg(F.count("seq").cast("int").alias("boxes"), F.sum("x").alias("x_sum"))


@query("latest_records", """SELECT user_id AS item_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE) DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_records(t):
    rows = t.raw("events").selectExpr("user_id AS item_id", "CAST(CAST(ts AS DATE) AS STRING) AS file_name", "event_id AS line", "event_id", "event_type")
    return R.latest_records(rows).select("item_id", "event_id", "event_type")


@query("merge_labels", f"""{BASE} SELECT item_id, count(*) AS labels, count(*) FILTER (origin = 0) AS first_map FROM (SELECT item_id, 0 AS origin FROM golden
   UNION ALL SELECT item_id, 1 FROM annotations) GROUP BY 1""")
def merge_labels(t):
    both = R.merge_labels(t.golden.select("item_id", "label"), t.annotations.select("item_id", "label"))
    return both.groupBy("item_id").agg(F.count("*").alias("labels"), F.count_if(F.col("origin") == 0).alias("first_map"))


@query("parse_answers", """SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE 'tree' END AS label, CASE (conv_id + turn) % 5 WHEN 3 THEN NULL WHEN 4 THEN NULL
   ELSE turn + 10.0 END AS x2 FROM conversations""")
def parse_answers(t):
    kind = (F.col("conv_id") + F.col("turn")) % 5
    body = F.concat(F.lit('[{"hazard_class": "tree", "bounding_box": [1, 2, '), F.col("turn") + 10, F.lit(', 90]}, {"hazard_class": "", "bounding_box": [1]}]'))
    answer = (F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("Sure!\n```json\n"), body, F.lit("\n```\ndone")))
              .when(kind == 2, F.concat(F.lit("I see "), body, F.lit(" here"))).when(kind == 3, F.lit("nothing found")).otherwise(F.lit("[]")))
    rows = t.raw("conversations").select("conv_id", "turn", answer.alias("answer"))
    return R.parse_answers(rows).select("conv_id", "turn", "label", "x2")


@query("split_payloads", """SELECT o_orderkey AS task, o_orderkey % 11 = 0 AS rejected, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE n END AS annotations FROM orders
   JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def split_payloads(t):
    ann = F.struct(F.lit("tree").alias("hazard_class"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(4.0)).alias("bounding_box"))
    lines = t.raw("lineitem").groupBy("l_orderkey").agg(F.collect_list(ann).alias("annotations"))
    record = F.struct(F.lit("i").alias("image_id"), "annotations")
    ok = F.to_json(F.struct(F.col("l_orderkey").cast("string").alias("task_id"), F.array(record).alias("records")))
    bad = F.to_json(F.struct(F.col("l_orderkey").cast("string").alias("task_id"), F.lit("oops").alias("records")))
    text = lines.select("l_orderkey", F.when(F.col("l_orderkey") % 11 == 0, bad).otherwise(ok).alias("value"))
    raw = text.select("l_orderkey", F.from_json("value", R.PAYLOAD, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("p")).select(
        "p.*", F.col("l_orderkey").alias("source_file"))
    rows, rejected = R.split_payloads(raw)
    good = rows.groupBy(F.col("source_file").alias("task")).agg(F.count("seq").alias("annotations")).withColumn("rejected", F.lit(False))
    return good.unionByName(rejected.select(F.col("source_file").alias("task"), F.lit(0).alias("annotations"), F.lit(True).alias("rejected")))


@query("batch_summary", f"""{Q.with_tables('items')}, b AS (SELECT 'd' || (item_id % 3) AS dataset, 'batch_' || (item_id // 60 % 12 + 1) AS batch, item_id, role FROM items),
  m AS (SELECT dataset, batch, count(*) AS public_images, count(*) FILTER (role = 'public' AND item_id % 60 < 40 AND batch <> 'batch_3') AS k FROM b GROUP BY ALL)
  SELECT dataset, batch, CAST(regexp_extract(batch, '(\\d+)$', 1) AS INT) AS number, k > 0 AS labeled, public_images, CASE WHEN k > 0 THEN 'verified' ELSE 'unverified' END AS upload_status FROM m""")
def batch_summary(t):
    items = t.items.selectExpr("concat('d', item_id % 3) AS dataset", "concat('batch_', CAST(item_id DIV 60 % 12 + 1 AS STRING)) AS batch", "item_id", "role")
    done = items.where("role = 'public' AND item_id % 60 < 40 AND batch <> 'batch_3'")
    return K.build_batch_summary(K.build_manifest(items), done)


@query("current_round", f"""{Q.with_tables('items')}, b AS (SELECT 'd' || (item_id % 3) AS dataset, item_id // 60 % 12 + 1 AS number FROM items)
  SELECT dataset, max(number)::INT AS number, 'batch_' || max(number) AS batch FROM b GROUP BY 1""")
def current_round(t):
    items = t.items.selectExpr("concat('d', item_id % 3) AS dataset", "concat('batch_', CAST(item_id DIV 60 % 12 + 1 AS STRING)) AS batch", "item_id", "role")
    summary = K.build_batch_summary(K.build_manifest(items), items)
    return K.current_round(summary).select("dataset", "number", "batch")


@query("batch_manifest", f"""{Q.with_tables('items')} SELECT item_id, 'd' || (item_id % 3) AS dataset, row_number() OVER (PARTITION BY item_id % 3 ORDER BY item_id) AS position FROM items""")
def batch_manifest(t):
    return K.build_manifest(t.items.selectExpr("item_id", "concat('d', item_id % 3) AS dataset"), ["dataset"])


@query("golden_manifest", f"""{Q.with_tables('golden', 'items')} SELECT i.item_id, width, height, only_label AS classification_label, count(g.gt)::INT AS boxes FROM items i LEFT JOIN golden g USING (item_id)
   WHERE role <> 'public' GROUP BY ALL""")
def golden_manifest(t):
    return K.dump_golden(t.golden, t.items).drop("annotations")


@query("latest_receipts", f"""{Q.with_tables('round_scores')} SELECT sha256(CAST(annotator_id AS VARCHAR)) AS identity_hash, max(round) AS round FROM round_scores GROUP BY annotator_id""")
def latest_receipts(t):
    rows = t.round_scores.select(F.col("annotator_id").alias("identity"), "round", "reward")
    return K.latest_receipts(K.receipts(rows)).select("identity_hash", "round")


@query("yolo_labels", f"""{Q.with_tables('annotations')}, n AS (SELECT *, trim(regexp_replace(lower(label), '[\\s_\\-]+', ' ', 'g')) AS name FROM annotations),
  f AS (SELECT name, min({{'i': item_id, 's': seq}}) AS f FROM n GROUP BY 1), c AS (SELECT name, CASE name WHEN 'field' THEN 0 ELSE row_number() OVER (PARTITION BY name = 'field' ORDER BY f, name) END AS cid FROM f)
  SELECT item_id, annotator_id, seq, printf('%d %.6f %.6f %.6f %.6f', cid, (x1 + x2) / 2 / 1024, (y1 + y2) / 2 / 256, (x2 - x1) / 1024, (y2 - y1) / 256) AS line FROM n JOIN c USING (name)""")
def yolo_labels(t):
    return K.to_yolo_labels(t.annotations, t.items, ["Field"])


@query("chat_corpus", f"""{Q.with_tables('golden')} SELECT item_id, count(*)::INT AS labels, '[' || string_agg('{{"hazard_class":"' || label || '","bounding_box":[' || x1 || ',' || y1 || ',' || x2 || ',' || y2 || ']}}', ',' ORDER BY gt) || ']' AS answer
   FROM golden GROUP BY 1""")
def chat_corpus(t):
    return K.to_chat_corpus(t.golden.withColumnRenamed("gt", "seq")).select("item_id", "labels", "answer")
