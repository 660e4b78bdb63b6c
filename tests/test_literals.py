"""Small fixed inputs with known results."""

import pytest
from pyspark.sql import functions as F

from labelloom.config import FidelityConfig, FusionConfig, IncentiveConfig, STRICT
from labelloom.functions import geometry as G
from labelloom.functions import taxonomy as T
from labelloom.functions import text as X
from labelloom.operators import dedup, evaluate, fuse, match, prepare, reward, score, validate

ANN = "round_num int, item_id bigint, annotator_id bigint, seq bigint, label string, x1 double, y1 double, x2 double, y2 double"
ITEMS = "item_id bigint, width int, height int, role string, only_label string"
GOLD = "item_id bigint, gt bigint, label string, x1 double, y1 double, x2 double, y2 double"


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first().v


@pytest.mark.parametrize("b,want", [((0, 0, 10, 10), 1.0), ((20, 20, 30, 30), 0.0), ((5, 5, 15, 15), 25 / 175),
                                    ((5, 5, 5, 9), 0.0), ((0, 0, float("inf"), 9), 0.0), ((0, 0, float("nan"), 9), 0.0)])
def test_iou(spark, b, want):
    cols = [F.lit(float(v)).alias(f"a_{c}") for c, v in zip(G.BOX, (0, 0, 10, 10))]
    cols += [F.lit(float(v)).alias(f"b_{c}") for c, v in zip(G.BOX, b)]
    assert spark.range(1).select(*cols).select(G.iou("a_", "b_").alias("v")).first().v == pytest.approx(want)


def test_labels(spark):
    words = {"Individual Tree": "ordinary_tree", " No-Hardhat ": "missing_hardhat", "": "_background", "Odd Thing": "odd_thing"}
    for raw, want in words.items():
        assert one(spark, T.canonical_label(F.lit(raw))) == want
    assert one(spark, T.carbon_multiplier(F.lit("mangrove"))) == 3.5
    assert one(spark, T.carbon_multiplier(F.lit("odd_thing"))) == 1.0
    assert one(spark, T.keyword_severity(F.lit("missing hardhat"))) == "high"
    assert one(spark, T.label_match(F.lit("dense_tree"), F.lit("mangrove"))) == 1.0


def polygon(spark, pts):
    return spark.createDataFrame([(pts, 0.0, 0.0, 100.0, 100.0)], f"polygon {G.POINTS}, x1 double, y1 double, x2 double, y2 double")


def circle(n, rough=1.0):
    import math

    return [(50 + 50 * (rough if i % 2 else 1) * math.cos(2 * math.pi * i / n), 50 + 50 * (rough if i % 2 else 1) * math.sin(
        2 * math.pi * i / n)) for i in range(n)]


@pytest.mark.parametrize("pts,box,spiky", [
    ([(0, 0), (100, 0), (100, 100), (0, 100)], True, False), (circle(8), False, False), (circle(16), False, False),
    (circle(14, 0.1), False, True), (None, True, False), ([(0, 0), (50, 0), (100, 0), (100, 100), (0, 100), (0, 0)], True, False)])
def test_outline_rules(spark, pts, box, spiky):
    df = polygon(spark, None if pts is None else [(float(a), float(b)) for a, b in pts])
    row = score.outline_quality(df).first()
    assert (row.is_box, row.is_spiky) == (box, spiky)
    assert df.select(G.crude_box(F.col("polygon")).alias("v")).first().v == box
    if pts and not box and not spiky:
        assert row.compactness > 0.70 and row.convexity > 0.95


def test_self_crossing(spark):
    bow = [(0.0, 0.0), (10.0, 10.0), (10.0, 0.0), (0.0, 10.0)]
    assert polygon(spark, bow).select(G.self_crossing("polygon").alias("v")).first().v
    assert not polygon(spark, circle(9)).select(G.self_crossing("polygon").alias("v")).first().v


def test_sanitized_polygon_stays_in_box(spark):
    df = polygon(spark, [(-5.0, 10.0), (120.0, 20.0), (60.0, 130.0), (60.0, 130.0), (float("nan"), 1.0)])
    got = G.sanitize_polygons(df.withColumn("label", F.lit("tree")), "p").first().p
    assert len(got) == 3 and all(0 <= q.x <= 100 and 0 <= q.y <= 100 for q in got)


def test_raster_iou(spark):
    schema = f"a_poly {G.POINTS}, b_poly {G.POINTS}, " + ", ".join(f"{p}{c} double" for p in ("a_", "b_") for c in G.BOX)
    sq = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    tri = [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0)]
    df = spark.createDataFrame([(sq, sq, 0., 0., 10., 10., 0., 0., 10., 10.), (sq, tri, 0., 0., 10., 10., 0., 0., 10., 10.),
                                (None, tri, 0., 0., 10., 10., 5., 0., 15., 10.)], schema)
    got = [r.raster_iou for r in G.raster_iou(df).collect()]
    assert got[0] == 1.0 and 0.4 <= got[1] <= 0.56 and got[2] == pytest.approx(1 / 3)


def fidelity(spark, anns, cfg):
    items = spark.createDataFrame([(1, 200, 200, "golden", None), (2, 160, 160, "golden", None)], ITEMS)
    golden = spark.createDataFrame([(1, 0, "missing_hardhat", 20., 30., 90., 130.), (2, 0, "fall_protection", 10., 20., 60., 90.)], GOLD)
    df = spark.createDataFrame(anns, ANN).withColumn("polygon", F.lit(None).cast(G.POINTS))
    return {(r.item_id, r.annotator_id): r for r in score.score_fidelity(df, golden, items, cfg).collect()}


def test_fidelity_lanes(spark):
    hit = (1, 1, 1, 1, "missing_hardhat", 22., 32., 92., 132.)
    extra = (1, 1, 2, 2, "missing_hardhat", 150., 150., 190., 190.)
    got = fidelity(spark, [hit, (1, 1, 2, 1, *hit[4:]), extra], FidelityConfig(audit=False))
    assert got[1, 1].iou > 0.7 and got[1, 1].label_match == 1.0 and got[1, 1].matched == 1 and got[1, 1].fidelity > 0.6
    assert got[1, 2].penalty == 0.5 and got[1, 2].hallucinated == 1
    soft = fidelity(spark, [hit, (1, 1, 2, 1, *hit[4:]), extra], FidelityConfig(audit=False, false_positive_factor=0.25))
    assert soft[1, 2].penalty == pytest.approx(0.8)
    # a box without an outline fails the audit
    assert fidelity(spark, [hit], FidelityConfig())[1, 1].fidelity == 0.0


def test_reliability_formula(spark):
    counts = spark.createDataFrame([(1, "tree", 4., 1., 1., 3.2, 4., 3.2, 4., 5.)],
                                   "annotator_id int, label string, " + ", ".join(f"{c} double" for c in score.COUNTS))
    row = score.reliability(counts).first()
    assert row.f1 == pytest.approx(0.8) and row.weight == pytest.approx(0.8 * 6 / 11 * 0.9)


def fused(spark, rows, weights, owners=None, cfg=STRICT, width=180):
    ids = sorted({r[0] for r in rows})
    anns = spark.createDataFrame([(1, 1, a, i, label, *map(float, box)) for i, (a, label, box) in enumerate(rows)], ANN)
    rel = spark.createDataFrame([(a, lab, w) for a, by in weights.items() for lab, w in by.items()], "annotator_id bigint, label string, weight double")
    people = spark.createDataFrame([(a, (owners or {}).get(a, a)) for a in ids], "annotator_id bigint, owner_id bigint")
    avg = spark.createDataFrame([(a, 0.9) for a in ids], "annotator_id bigint, avg_fidelity double")
    items = spark.createDataFrame([(1, width, width, "public", None)], ITEMS)
    priors = spark.createDataFrame([("tree_x", 0.3), ("rare", 0.3), ("_background", 0.4)], "label string, prior double")
    parts = fuse.fuse(anns, rel, priors, items, people, avg, cfg, ["item_id"])
    return parts, fuse.assemble_items(parts, rel, avg, items, cfg, ["item_id"]).first(), rel


SAME = (25, 25, 90, 90)


def test_equal_voters_share_credit(spark):
    parts, row, rel = fused(spark, [(a, "tree_x", SAME) for a in (1, 2, 3)], {a: {"tree_x": 0.95} for a in (1, 2, 3)})
    assert not row.escalated and row.chosen == 1 and row.net_weight == pytest.approx(65 * 65 / 180 ** 2, abs=1e-6)
    credit = fuse.contributions(parts["votes"], parts["objects"], rel, ["item_id"]).collect()
    assert [r.contribution for r in credit] == pytest.approx([1 / 3] * 3)


def test_rare_label_accepted(spark):
    parts, row, _ = fused(spark, [(a, "rare", SAME) for a in (1, 2, 3)], {1: {"rare": .99}, 2: {"rare": .35}, 3: {"rare": .35}})
    assert not row.escalated and parts["objects"].first().confidence >= 0.9


def test_escalations(spark):
    w = {a: {"tree_x": 0.95} for a in range(1, 60)}
    assert fused(spark, [(1, "tree_x", SAME), (2, "tree_x", SAME)], w, {1: 7, 2: 7})[1].reason == "only_one_miner"
    assert fused(spark, [(a, "tree_x", (0, 0, 180, 180)) for a in (1, 2, 3)], w)[1].reason == "large_box_requires_review"
    two = [(a, "tree_x", b) for a in range(1, 5) for b in ((20, 20, 100, 100), (70, 20, 150, 100))]
    row = fused(spark, two, w)[1]
    assert row.reason == "overlapping_object_clusters_requires_review" and row.coverage_pct is None
    crowd = [(1, "tree_x", SAME), (2, "tree_x", SAME)] + [(a, "rare", (100, 100, 170, 170)) for a in range(3, 20)]
    assert "insufficient" in fused(spark, crowd, {**w, **{a: {"rare": 1e-4} for a in range(3, 20)}})[1].reason


def test_union_of_two(spark):
    df = spark.createDataFrame([(1, 0., 0., 10., 10.), (1, 5., 0., 15., 10.)], "item_id int, x1 double, y1 double, x2 double, y2 double")
    assert match.union_area(df).first().union_area == 150.0


def shares(spark, values, **cfg):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "round int, annotator_id int, score double")
    got = reward.shape_incentives(df, IncentiveConfig(**cfg)).collect()
    return [r.share for r in sorted(got, key=lambda r: r.annotator_id)]


def test_incentive_cases(spark):
    a = shares(spark, [.35, .28])
    assert .52 < a[0] < .57 and .43 < a[1] < .48
    b = shares(spark, [1] + [.05] * 19, temperature=.01, floor=.1)
    assert b[0] == pytest.approx(.81) and b[1] == pytest.approx(.01)
    assert shares(spark, [0, 0, 0, .415, .0025, .002])[3] == 1.0


@pytest.mark.parametrize("v,want", [(.05, 0), (.10, 1 / 3), (.125, .5), (.20, 1), (.35, 1), (float("nan"), 0)])
def test_ramp(spark, v, want):
    assert one(spark, G.ramp(F.lit(float(v)))) == pytest.approx(want)


def test_ema_cases(spark):
    df = spark.createDataFrame([(1, 1, 1.6), (1, 2, 1.0), (2, 1, 0.8), (2, 2, 0.8), (3, 1, 3e-4)], "annotator_id int, round int, reward double")
    got = {r.annotator_id: r.ema for r in reward.ema(df, 0.25).collect()}
    assert got[1] == pytest.approx(.55) and got[2] == pytest.approx(.35) and got[3] == 0.0


def caps(spark, given, n, minimum=0):
    df = spark.createDataFrame([(k, float(v)) for k, v in given.items()], "annotator_id int, share double")
    slots = spark.createDataFrame([(n,)], "n int")
    return {r.annotator_id: r.slots for r in reward.hamilton(df, slots, minimum=minimum).collect()}


def test_hamilton_cases(spark):
    assert caps(spark, {11: .6, 22: .2, 33: .15, 44: .05}, 27) == {11: 16, 22: 6, 33: 4, 44: 1}
    assert caps(spark, {9: .5, 3: .5}, 1) == {9: 0, 3: 1}
    assert sum(caps(spark, {1: .6, 2: .2, 3: .15, 4: .05}, 31).values()) == 31
    golden = caps(spark, {i: 30 if i < 16 else 5 for i in range(17)}, 38, 2)
    assert len(golden) == 17 and sum(golden.values()) == 38 and min(golden.values()) >= 2


@pytest.mark.parametrize("total,golden,tasks,last", [(600, 60, 20, (30, 3)), (500, 50, 17, (20, 2))])
def test_epoch_cases(spark, total, golden, tasks, last):
    items = spark.range(total).selectExpr("id AS item_id", f"IF(id < {golden}, 'golden', 'public') AS role")
    plan = prepare.epoch_plan(items, "s").groupBy("task").agg(F.count("*").alias("n"), F.count_if("is_golden").alias("g")).collect()
    sizes = {r.task: (r.n, r.g) for r in plan}
    assert len(sizes) == tasks and sizes[tasks] == last and sum(n for n, _ in sizes.values()) == total


def test_copies_and_near_copies(spark):
    rows = [(1, 1, 1, 1, "tree", 100., 100., 300., 300.), (1, 1, 2, 1, "tree", 100., 100., 300., 300.),
            (1, 1, 3, 1, "tree", 101., 101., 301., 301.), (1, 1, 4, 1, "tree", 500., 100., 700., 300.)]
    df = spark.createDataFrame(rows, ANN)
    assert {r.annotator_id: r.copies for r in dedup.submission_fingerprints(df).collect()} == {1: 2, 2: 2, 3: 1, 4: 1}
    assert {r.annotator_id: r.earlier_annotator for r in dedup.near_duplicates(df).collect()} == {2: 1, 3: 1}


def test_feedback_text(spark):
    text = ("Chip 12 in golden_abc.jpg misses crowns at [120, 240] and (45.2, 89.1) of id77. Lower the threshold. Third sentence here.")
    got = one(spark, X.scrub(F.lit(text), F.array(F.lit("id77"))))
    assert not any(s in got for s in ("12", ".jpg", "240", "89.1", "id77", "Third")) and got.endswith(".")
    assert len(one(spark, X.scrub(F.lit("word " * 80))).split()) == 45
    assert one(spark, X.scrub(F.lit(""))) == X.DEFAULT_FEEDBACK


def test_leaderboard_case(spark):
    df = spark.createDataFrame([(1, 1, .8), (1, 2, .5), (2, 1, .7), (2, 2, .9)], "round int, annotator_id int, score double")
    got = {(r["round"], r.annotator_id): r for r in evaluate.leaderboard(df).collect()}
    assert got[1, 1]["rank"] == 1 and got[1, 2]["rank"] == 2 and got[1, 2].percentile == 50.0 and got[1, 1].delta == 0.0
    assert got[2, 1].delta == pytest.approx(-.1) and got[2, 1].gap == pytest.approx(.2)


def test_grid(spark):
    space = {"b": [1, 2, 3], "a": ["x", "y"]}
    full = {(r.a, r.b) for r in prepare.expand_grid(spark, space).collect()}
    assert full == {(a, b) for a in "xy" for b in (1, 2, 3)}
    assert prepare.expand_grid(spark, space, 4).count() == 4


def test_fallback_preset(spark):
    cfg = FusionConfig(fallback=True)
    row = fused(spark, [(1, "tree_x", SAME)], {1: {"tree_x": .9}}, cfg=cfg)[1]
    assert not row.escalated and row.method == "single_miner_fallback_v1" and row.score == pytest.approx(.9)


def test_reward_rows_void_the_round(spark):
    rows = spark.createDataFrame([(1, 10, 5, .8, "vision_model_selection_v1", True, False, False, 1, 1.0, True),
                                  (2, 11, 5, .7, "vision_model_selection_v1", True, False, False, 1, 1.0, True)],
                                 "round_num int, item_id int, chosen int, score double, method string, accepted boolean, is_golden boolean, "
                                 "escalated boolean, contributors int, contribution double, objects_ok boolean")
    fid = spark.createDataFrame([(1, 5, .8), (2, 5, .8)], "round_num int, annotator_id int, fidelity double")
    got = {r.round_num: r.valid for r in validate.validate_reward_rows(
        rows, fid, rows.selectExpr("round_num", "item_id", "chosen AS annotator_id"),
        rows.selectExpr("round_num", "chosen AS annotator_id", "1 AS cap")).collect()}
    assert got == {1: True, 2: False}


def test_spectral_rules(spark):
    def stats(rgb, **kw):
        px = spark.range(400).selectExpr("1 AS item_id", "CAST(id % 20 AS INT) AS x", "CAST(id DIV 20 AS INT) AS y",
                                         f"{rgb[0]} AS r", f"{rgb[1]} + IF(id % 2 = 0, 60, 0) AS g", f"{rgb[2]} AS b")
        box = spark.createDataFrame([(1, 1, 0., 0., 20., 20.)], "item_id int, seq int, x1 double, y1 double, x2 double, y2 double")
        return score.spectral_stats(px, box, **kw).first()

    assert stats((50, 60, 200)).is_water and not stats((40, 140, 50)).is_water
    assert stats((40, 140, 50)).spectral_label == "ordinary_tree"
    assert stats((40, 140, 50), coastal=True).spectral_label == "mangrove"


def test_convexity_of_stars_that_wind_twice(spark):
    """Stars drawn in one stroke turn one way all round but are not convex."""
    import math

    from labelloom.functions import geometry as G

    def star(points, step):
        return [(100 + 50 * math.cos(2 * math.pi * step * k / points), 100 + 50 * math.sin(2 * math.pi * step * k / points)) for k in range(points)]

    def area(p):
        return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1]))) / 2

    shapes = [star(5, 1), star(5, 2), star(7, 2), star(7, 3), star(5, 2)[::-1], star(6, 1) + [star(6, 1)[0]]]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(shapes)], "i int, polygon array<struct<x:double,y:double>>")
    got = {r.i: r for r in rows.select("i", G.outline_stats("polygon").alias("o")).select("i", "o.area", "o.hull").collect()}
    for i, (n, s) in enumerate([(5, shapes[0]), (5, star(5, 1)), (7, star(7, 1)), (7, star(7, 1)), (5, star(5, 1)), (6, star(6, 1))]):
        assert abs(got[i].hull - area(s)) < 1e-6, i
    assert got[1].area / got[1].hull < 0.7


def _drawn_share(a, b, size):
    """IoU of two outlines by testing every pixel centre."""
    def inside(poly, px, py):
        hit = False
        for (ax, ay), (bx, by) in zip(poly, poly[1:] + poly[:1]):
            if (ay > py) != (by > py) and px < ax + (py - ay) * (bx - ax) / (by - ay):
                hit = not hit
        return hit

    masks = [[inside(p, x + 0.5, y + 0.5) for y in range(size) for x in range(size)] for p in (a, b)]
    both, either = sum(map(all, zip(*masks))), sum(map(any, zip(*masks)))
    return both / either if either else 0.0


def test_outline_overlap_counts_pixel_centres(spark):
    import random

    from labelloom.functions import geometry as G

    rng = random.Random(7)
    shapes = [[(rng.uniform(0, 40), rng.uniform(0, 40)) for _ in range(rng.randint(3, 9))] for _ in range(300)]
    pairs = [(i, shapes[i], shapes[-1 - i], 0.0, 0.0, 40.0, 40.0, 0.0, 0.0, 40.0, 40.0) for i in range(150)] + [(200, None, shapes[0], 0.0, 0.0, 2.0, 2.0, 1.0, 0.0, 2.0, 2.0)]
    poly, box = "array<struct<x:double,y:double>>", ", ".join(f"{s}_{c} double" for s in "ab" for c in ("x1", "y1", "x2", "y2"))
    got = {r.i: r.raster_iou for r in G.raster_iou(spark.createDataFrame(pairs, f"i int, a_poly {poly}, b_poly {poly}, {box}")).collect()}
    assert all(abs(got[i] - _drawn_share(shapes[i], shapes[-1 - i], 40)) < 1e-12 for i in range(150))
    assert got[200] == 0.5


def test_matching_by_outlines(spark):
    """Equal boxes with opposite triangles do not match; small overlap of boxes with equal outlines inside does."""
    from labelloom.operators.match import greedy_match

    poly = "array<struct<x:double,y:double>>"
    low, high = [(0.0, 0.0), (40.0, 0.0), (0.0, 40.0)], [(40.0, 40.0), (40.0, 0.0), (0.0, 40.0)]
    spot = [(30.0, 30.0), (38.0, 30.0), (38.0, 38.0), (30.0, 38.0)]
    truth = spark.createDataFrame([(1, 1, 0., 0., 40., 40., low), (2, 1, 0., 0., 40., 40., spot), (3, 1, 0., 0., 40., 40., None)], f"item_id int, gt int, x1 double, y1 double, x2 double, y2 double, polygon {poly}")
    pred = spark.createDataFrame([(1, 7, 1, 0., 0., 40., 40., high), (2, 7, 1, 28., 28., 90., 90., spot), (3, 7, 1, 0., 0., 40., 40., high)], f"item_id int, annotator_id int, seq int, x1 double, y1 double, x2 double, y2 double, polygon {poly}")
    got = {r.item_id: round(r.iou, 3) for r in greedy_match(truth, pred, ["item_id", "annotator_id"]).collect()}
    assert got == {2: 1.0, 3: 1.0}
    assert {r.item_id for r in greedy_match(truth.drop("polygon"), pred, ["item_id", "annotator_id"]).collect()} == {1, 3}
