"""Spatial joins, one-to-one matching, clustering and suppression of boxes."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from labelloom.functions.geometry import box_ok, iou, outline_iou
from labelloom.scale import GROUP_LIMIT, dealt, first_rows, fold_groups, split_hot
from labelloom.session import cut

BOX = ("x1", "y1", "x2", "y2")


def _prefixed(df: DataFrame, prefix: str, on: Sequence[str]) -> DataFrame:
    return df.select(*on, *[F.col(c).alias(prefix + c) for c in df.columns if c not in on])


def iou_join(
    a: DataFrame, b: DataFrame, on: Sequence[str], min_iou: float = 0.0, extra=None,
    limit: int | None = GROUP_LIMIT, probe: DataFrame | None = None,
) -> DataFrame:
    """Pairs of boxes with equal ``on`` keys and IoU of at least ``min_iou`` (above 0 when it is 0).

    Columns of both sides come back with the prefixes ``a_`` and ``b_``. Keys
    with few boxes join on the key with the overlap as join condition; keys with
    many boxes on either side add a size-level grid cell to the join key, so no task
    compares all boxes of a large item. Sizes are counted on ``probe`` (a cheaper
    frame with at least the rows of ``a``) when given; ``limit=None`` says the
    caller has counted already.
    """
    cold, hot = (a, None) if limit is None else split_hot(a, on, limit, _counted(a if probe is None else probe, b, on))
    parts = [_plain_pairs(cold, b, on, extra)]
    if hot is not None:
        parts.append(_grid_pairs(hot, b, on, min_iou, extra) if min_iou > 0 else _cover_pairs(hot, b, on, extra))
    pairs = reduce(DataFrame.unionByName, parts).withColumn("iou", iou("a_", "b_", checked=True))
    return pairs.where(F.col("iou") >= min_iou if min_iou > 0 else F.col("iou") > 0)


def _counted(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """The keys of both sides, for counting."""
    return a.select(*on).union(b.select(*on))


def _overlap():
    return (
        (F.col("a_x1") < F.col("b_x2")) & (F.col("b_x1") < F.col("a_x2"))
        & (F.col("a_y1") < F.col("b_y2")) & (F.col("b_y1") < F.col("a_y2")))


def _condition(extra):
    return _overlap() if extra is None else _overlap() & extra


def _plain_pairs(a: DataFrame, b: DataFrame, on: Sequence[str], extra) -> DataFrame:
    left = _prefixed(a.where(box_ok()), "a_", on)
    right = _prefixed(b.where(box_ok()), "b_", on)
    return left.join(right, list(on)).where(_condition(extra))


def _grid_pairs(a: DataFrame, b: DataFrame, on: Sequence[str], min_iou: float, extra) -> DataFrame:
    """Grid join for IoU >= min_iou > 0.

    A box lives in the cell of its centre on the level whose cells are the
    smallest power of two covering its longer side. Partners can differ by at
    most log2(1/min_iou) levels, because both side ratios are at least min_iou,
    and their centres by at most half the sum of the two cell sizes; ``b`` is
    copied to exactly those cells, at most once each, so pairs stay unique.
    """
    left = _own_cell(_prefixed(a.where(box_ok()), "a_", on), "a_")
    right = _partner_cells(_prefixed(b.where(box_ok()), "b_", on), "b_", min_iou)
    return left.join(right, [*on, "_level", "_cx", "_cy"]).where(_condition(extra)).drop("_level", "_cx", "_cy")


def _centre(p: str, axis: str):
    return (F.col(f"{p}{axis}1") + F.col(f"{p}{axis}2")) / 2


def _own_cell(df: DataFrame, p: str) -> DataFrame:
    size = F.pow(F.lit(2.0), F.col("_level"))
    return (df.withColumn("_level", _level(p)).withColumn("_cx", F.floor(_centre(p, "x") / size))
            .withColumn("_cy", F.floor(_centre(p, "y") / size)))


def _partner_cells(df: DataFrame, p: str, min_iou: float) -> DataFrame:
    """A row for every cell in which a box of IoU >= min_iou may have its own place."""
    steps = math.ceil(math.log2(1.0 / min_iou))
    out = df.withColumn("_own", _level(p)).withColumn("_level", F.explode(F.sequence(F.col("_own") - steps, F.col("_own") + steps)))
    size = F.pow(F.lit(2.0), F.col("_level"))
    reach = (size + F.pow(F.lit(2.0), F.col("_own"))) / 2
    for axis in "xy":
        low, high = (F.floor((_centre(p, axis) + s * reach) / size) for s in (-1, 1))
        out = out.withColumn(f"_c{axis}", F.explode(F.sequence(low, high)))
    return out.drop("_own")


def _level(p: str = ""):
    """The smallest power of two that covers the longer side of a box."""
    side = F.greatest(F.col(p + "x2") - F.col(p + "x1"), F.col(p + "y2") - F.col(p + "y1"))
    return F.ceil(F.log2(side)).cast("int")


def _cover_pairs(a: DataFrame, b: DataFrame, on: Sequence[str], extra) -> DataFrame:
    """Grid join for any overlap of boxes of any size.

    On the level of its own size, or a higher one, a box touches at most four cells. Two boxes meet on the level of the larger
    one: it offers its own cells, the smaller one those it touches there. So a box is copied to at most four cells per
    size level in use, whatever its size; the cell with the corner of the intersection owns the pair.
    """
    # One row per size level: as many as there are powers of two between the smallest and the largest box.
    sizes = a.where(box_ok()).select(_level().alias("n")).union(b.where(box_ok()).select(_level().alias("n"))).distinct()
    levels = F.array(*[F.lit(r["n"]) for r in sizes.orderBy("n").collect()]).cast("array<int>")

    def placed(df: DataFrame, p: str, up: bool) -> DataFrame:
        out = _prefixed(df.where(box_ok()), p, on).withColumn("_own", _level(p))
        out = out.withColumn("_level", F.explode(F.filter(levels, lambda n: n > F.col("_own"))) if up else F.col("_own"))
        size = F.pow(F.lit(2.0), F.col("_level"))
        for axis in "xy":
            out = out.withColumn(f"_c{axis}", F.explode(F.sequence(F.floor(F.col(f"{p}{axis}1") / size), F.floor(F.col(f"{p}{axis}2") / size))))
        return out.drop("_own")

    size = F.pow(F.lit(2.0), F.col("_level"))
    owner = (
        (F.floor(F.greatest("a_x1", "b_x1") / size) == F.col("_cx"))
        & (F.floor(F.greatest("a_y1", "b_y1") / size) == F.col("_cy")))
    cells = [*on, "_level", "_cx", "_cy"]
    every = placed(b, "b_", False).unionByName(placed(b, "b_", True))
    met = placed(a, "a_", False).join(every, cells).unionByName(placed(a, "a_", True).join(placed(b, "b_", False), cells))
    return met.where(owner & _condition(extra)).drop("_level", "_cx", "_cy")


# ---------------------------------------------------------------- one-to-one matching

_FOLD = """aggregate({edges},
  named_struct('d', CAST(NULL AS {d}), 'out', CAST(array() AS ARRAY<STRUCT<d:{d},c:{c},iou:DOUBLE,x:{x}>>)),
  (acc, e) -> IF(acc.d <=> e.d OR exists(acc.out, o -> o.c = e.c), acc,
     named_struct('d', e.d, 'out', concat(acc.out, array(named_struct('d', e.d, 'c', e.c, 'iou', -e.n, 'x', e.x))))),
  acc -> acc.out)"""


def _carrying(edges: DataFrame) -> DataFrame:
    return edges if "x" in edges.columns else edges.withColumn("x", F.lit(0))


def _fold(edges: DataFrame, group: Sequence[str]) -> DataFrame:
    """Walk the candidate pairs of each group in (driver, IoU descending, candidate) order; ids of any type that sorts."""
    edges = _carrying(edges)
    kinds = {k: edges.schema[k].dataType.simpleString() for k in ("d", "c", "x")}
    ordered = edges.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(
        F.col("d"), (-F.col("iou")).alias("n"), F.col("c"), F.col("x")))).alias("_e"))
    return ordered.select(*group, F.inline(F.expr(_FOLD.format(edges="_e", **kinds))))


def _fold_hot(edges: DataFrame, group: Sequence[str], chunk: int = 512) -> DataFrame:
    """Same result for groups of any size.

    A round folds the first ``chunk`` drivers: the k-th needs only its k best candidates,
    since earlier drivers took at most k-1 of them. Then, all over the
    group at once, every driver takes its best candidate if no earlier driver
    overlaps that candidate at all. So the rounds follow the longest chain of overlaps of a
    sparse group, and the chunks of a crowded one. Drivers left without a
    free candidate drop out by themselves; the loop ends when no pair is left.
    """
    group, left, done = list(group), cut(_carrying(edges)), []
    while not left.isEmpty():
        drivers = first_rows(left.select(*group, "d").distinct(), group, [F.col("d")], chunk, "_k")
        best = first_rows(left.join(drivers, [*group, "d"]), [*group, "d"], [F.desc("iou"), F.col("c")], chunk, "_b")
        taken = cut(_fold(best.where(F.col("_b") <= F.col("_k")), group))
        left = cut(
            left.join(drivers, [*group, "d"], "left_anti").join(taken.select(*group, "c"), [*group, "c"], "left_anti"))
        top = left.groupBy(*group, "d").agg(F.min(F.struct((-F.col("iou")).alias("n"), "c", "x")).alias("_t")).select(
            *group, "d", F.col("_t.c").alias("c"), (-F.col("_t.n")).alias("iou"), F.col("_t.x").alias("x"))
        first = left.groupBy(*group, "c").agg(F.min("d").alias("_d"))
        sure = cut(top.join(first, [*group, "c"]).where(F.col("d") == F.col("_d")).select(*group, "d", "c", "iou", "x"))
        done += [taken.select(*group, "d", "c", "iou", "x"), sure]
        left = cut(left.join(sure.select(*group, "d"), [*group, "d"], "left_anti").join(
            sure.select(*group, "c"), [*group, "c"], "left_anti"))
    if not done:
        return _fold(edges.limit(0), group).select(*group, "d", "c", "iou", "x")
    return reduce(DataFrame.unionByName, done)


def greedy_match(
    truth: DataFrame, pred: DataFrame, group: Sequence[str], item: Sequence[str] = ("item_id",),
    min_iou: float = 0.5, drive: str = "truth", same_label: bool = False, limit: int = 512,
    probe: DataFrame | None = None, carry: Sequence[str] = (),
) -> DataFrame:
    """One-to-one matching of predictions to truth boxes inside each group.

    ``drive='truth'``: truth boxes in ``gt`` order each take the best unused
    prediction; ``drive='pred'``: predictions in ``seq`` order each take the best
    unused truth. Ties go to the lower id. ``truth`` has the ``item`` keys and
    ``gt``; ``pred`` has the ``group`` keys (containing ``item``) and ``seq``.
    When both have a ``polygon``, pairs with two outlines are measured by their
    outlines: any overlap of the boxes makes a candidate, since outlines can
    overlap more than their boxes do. Returns (group, gt, seq, iou) and the
    columns named in ``carry``, with the prefix a_ of predictions or b_ of truth.
    """
    item, group = list(item), list(group)
    d, c = ("b_gt", "a_seq") if drive == "truth" else ("a_seq", "b_gt")
    extra = (F.col("a_label") == F.col("b_label")) if same_label else None
    kept = [k for k in group if k not in item]
    drawn = "polygon" in truth.columns and "polygon" in pred.columns

    def edges(p: DataFrame, known: int | None) -> DataFrame:
        pairs = iou_join(p, truth, item, 0.0 if drawn else min_iou, extra, known, probe)
        if drawn:
            pairs = pairs.withColumn("iou", outline_iou(F.col("a_polygon"), F.col("b_polygon"))).where(F.col("iou") >= min_iou)
        return pairs.select(
            *item, *[F.col("a_" + k).alias(k) for k in kept], F.col(d).alias("d"), F.col(c).alias("c"), "iou",
            (F.struct(*carry) if carry else F.lit(0)).alias("x"))

    # An item with few boxes has no large group, so most data needs only this one count.
    few, many = split_hot(pred, item, limit, _counted(pred if probe is None else probe, truth, item))
    result = _fold(edges(few, None), group)
    if many is not None:
        cold, hot = split_hot(many, group, limit)
        result = result.unionByName(_fold(edges(cold, GROUP_LIMIT), group))
        if hot is not None:
            result = result.unionByName(_fold_hot(edges(hot, GROUP_LIMIT), group))
    gt, seq = ("d", "c") if drive == "truth" else ("c", "d")
    return result.select(*group, F.col(gt).alias("gt"), F.col(seq).alias("seq"), "iou", *[F.col(f"x.{k}").alias(k) for k in carry])


def best_match(pred: DataFrame, truth: DataFrame, key: Sequence[str], item: Sequence[str] = ("item_id",),
               min_iou: float = 0.5) -> DataFrame:
    """Best overlapping truth per prediction, not one-to-one; ties go to the lower ``gt``."""
    pairs = iou_join(pred, truth, item, min_iou)
    best = pairs.groupBy(*[F.col("a_" + k).alias(k) if k not in item else F.col(k) for k in key]).agg(
        F.max_by(F.struct("b_gt", "b_label", "iou"), F.struct("iou", (-F.col("b_gt")).alias("g"))).alias("m"))
    return best.select(*key, F.col("m.b_gt").alias("gt"), F.col("m.b_label").alias("gt_label"), F.col("m.iou").alias("iou"))


# ---------------------------------------------------------------- anchors: clustering and suppression

_ANCHOR_FOLD = """aggregate({rows}, CAST(array() AS ARRAY<{kind}>),
  (acc, e) -> IF(exists(acc, o -> {hit}), acc, concat(acc, array({pick}))))"""


def _lambda_iou(o: str, e: str) -> str:
    inter = (f"greatest(0D, least({o}.x2, {e}.x2) - greatest({o}.x1, {e}.x1))"
             f" * greatest(0D, least({o}.y2, {e}.y2) - greatest({o}.y1, {e}.y1))")
    area = "(({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1))"
    return f"(({inter}) / ({area.format(o)} + {area.format(e)} - {inter}))"


def _anchor_lists(df: DataFrame, group: list[str], order: list, threshold: float, strict: bool, columns: list[str]):
    """Per group one sorted array ``_anchors`` of the boxes no earlier anchor covers, with ``columns``."""
    marks = [o.alias(f"o{i}") for i, o in enumerate(order)]
    listed = df.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(*marks, *BOX, *columns))).alias("_r"))
    kind = listed.schema["_r"].dataType.elementType.simpleString()
    hit = f"{_lambda_iou('o', 'e')} {'>' if strict else '>='} {threshold}D"
    return listed.select(*group, F.expr(_ANCHOR_FOLD.format(rows="_r", kind=kind, hit=hit, pick="e")).alias("_anchors"))


def _near_pairs(a: DataFrame, b: DataFrame, group: list[str], threshold: float, strict: bool, extra=None) -> DataFrame:
    """Pairs of boxes that the threshold calls covered, without the IoU."""
    pairs = _grid_pairs(a, b, group, threshold, extra) if threshold > 0 else _cover_pairs(a, b, group, extra)
    value = iou("a_", "b_", checked=True)
    return pairs.where(value > threshold if strict else value >= threshold)


def _first_around(left: DataFrame, group: list[str], threshold: float) -> DataFrame:
    """Boxes that come before all boxes of every cell in which a partner could be: anchors, found without any pair."""
    cells = [*group, "_level", "_cx", "_cy"]
    skinny = left.select(*group, *BOX, "_key")
    least = _own_cell(skinny, "").groupBy(*cells).agg(F.min("_key").alias("_least"))
    around = _partner_cells(skinny, "", threshold).select(*cells, "_key").join(least, cells)
    first = around.groupBy(*group, "_key").agg(F.min("_least").alias("_least")).where(F.col("_key") <= F.col("_least"))
    return left.join(first.select(*group, "_key"), [*group, "_key"], "left_semi")


def _anchors_of_large(hot: DataFrame, group: list[str], order: list, threshold: float, strict: bool, chunk: int) -> DataFrame:
    """Anchors of groups of any size, with all columns and their order as struct ``_key``.

    First the boxes that are first in their whole neighbourhood become anchors and cover theirs, so dense piles shrink before
    any pair is written. The overlaps that are left are edges from earlier to later boxes, and then all boxes without an undecided earlier neighbour
    settle at once, all over the group: separate boxes in one round, others in as many as the longest chain of overlaps. From the
    eighth round on the first ``chunk`` boxes of every group are folded too, so that even one long chain ends.
    """
    names = [f"o{i}" for i in range(len(order))]
    here = [*group, "_key"]
    left = cut(hot.withColumn("_key", F.struct(*[o.alias(n) for o, n in zip(order, names)])))
    found = []
    if threshold > 0:
        sure = cut(_first_around(left, group, threshold))
        found.append(sure)
        hidden = _near_pairs(sure.select(*group, *BOX), left, group, threshold, strict).select(*group, F.col("b__key").alias("_key"))
        left = cut(left.join(hidden, here, "left_anti").join(sure.select(*here), here, "left_anti"))
    slim = left.select(*group, *BOX, "_key")
    edges = cut(_near_pairs(slim, slim, group, threshold, strict, F.col("a__key") < F.col("b__key")).select(
        *group, F.col("a__key").alias("_first"), F.col("b__key").alias("_key")))
    rounds = 0
    while not left.isEmpty():
        rounds += 1
        free = left.join(edges.select(*here), here, "left_anti")
        if rounds >= 8:
            head = first_rows(left, group, [F.col("_key")], chunk, "_k").drop("_k")
            lists = _anchor_lists(head, group, [F.col(f"_key.{n}") for n in names], threshold, strict, [])
            folded = lists.select(*group, F.explode("_anchors").alias("_a")).select(*group, F.struct(*[F.col(f"_a.{n}").alias(n) for n in names]).alias("_key"))
            free = left.join(free.select(*here).union(folded).distinct(), here, "left_semi")
        free = cut(free)
        found.append(free)
        hidden = edges.join(free.select(*group, F.col("_key").alias("_first")), [*group, "_first"], "left_semi").select(*here)
        left = cut(left.join(hidden, here, "left_anti").join(free.select(*here), here, "left_anti"))
        open_keys = left.select(*here)
        edges = cut(edges.join(open_keys, here, "left_semi").join(open_keys.withColumnRenamed("_key", "_first"), [*group, "_first"], "left_semi"))
    return reduce(DataFrame.unionByName, found)


def _hits_of_large(hot: DataFrame, group: list[str], order: list, threshold: float, strict: bool, chunk: int) -> DataFrame:
    """Rows of large groups with ``_hit``: the order of the first anchor that covers them."""
    anchors = cut(_anchors_of_large(hot, group, order, threshold, strict, chunk).select(*group, *BOX, "_key"))
    rows = hot.withColumn("_key", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    pairs = _near_pairs(anchors, rows.select(*group, *BOX, "_key"), group, threshold, strict)
    first = pairs.groupBy(*group, F.col("b__key").alias("_key")).agg(F.min("a__key").alias("_hit"))
    return rows.join(first, [*group, "_key"]).drop("_key")


def _with_hit(df: DataFrame, lists: DataFrame, group: list[str], threshold: float, strict: bool) -> DataFrame:
    """Add ``_hit``: the first anchor of the group's list that covers the row.

    The first one in order is always an earlier box or the row itself, so no
    order test is needed.
    """
    test = f"{_lambda_iou('a', '_b')} {'>' if strict else '>='} {threshold}D"
    boxed = df.withColumn("_b", F.struct(*BOX))
    return boxed.join(lists, group).withColumn("_hit", F.expr(f"get(filter(_anchors, a -> {test}), 0)")).drop("_anchors", "_b")


def anchor_assign(
    df: DataFrame, group: Sequence[str], order: Sequence, threshold: float, strict: bool = False,
    limit: int = 1024, chunk: int = 1024, probe: DataFrame | None = None,
) -> DataFrame:
    """Assign every box to the first anchor of its group that covers it.

    Boxes are taken in ``order`` (ascending expressions forming a total order);
    one that overlaps no earlier anchor by ``threshold`` becomes an anchor. The
    anchors of a group are its suppression survivors and its cluster centres.
    Adds ``is_anchor`` and the anchor's order values ``_o0, _o1, ...``.

    Groups up to ``limit`` rows fold their boxes in one task; larger ones settle
    all over at once (``_anchors_of_large``).
    """
    group, order = list(group), list(order)
    cold, hot = split_hot(df.where(box_ok()), group, limit, probe)
    parts = [_with_hit(cold, _anchor_lists(cold, group, order, threshold, strict, []), group, threshold, strict)]
    if hot is not None:
        parts.append(_hits_of_large(hot, group, order, threshold, strict, chunk))
    n = len(order)
    hits = [part.select(*df.columns, *[F.col(f"_hit.o{i}").alias(f"_o{i}") for i in range(n)]) for part in parts]
    return reduce(DataFrame.unionByName, hits).withColumn("is_anchor", _same([F.col(f"_o{i}") for i in range(n)], order))


def anchors_only(df: DataFrame, group: Sequence[str], order: Sequence, threshold: float, strict: bool = False,
                 limit: int = 1024, chunk: int = 1024, probe: DataFrame | None = None) -> DataFrame:
    """The anchor rows of ``anchor_assign``; small groups need no second look at their rows."""
    group, order = list(group), list(order)
    cold, hot = split_hot(df.where(box_ok()), group, limit, probe)
    rest = [c for c in df.columns if c not in group and c not in BOX]
    lists = _anchor_lists(cold, group, order, threshold, strict, rest)
    parts = [lists.select(*group, F.inline("_anchors")).select(*df.columns)]
    if hot is not None:
        parts.append(_anchors_of_large(hot, group, order, threshold, strict, chunk).select(*df.columns))
    return reduce(DataFrame.unionByName, parts)


def _same(a: list, b: list):
    return reduce(lambda x, y: x & y, [p == q for p, q in zip(a, b)])


def nms(df: DataFrame, group: Sequence[str] = ("item_id",), threshold: float = 0.45, strict: bool = False,
        tie: Sequence[str] = ("annotator_id", "seq"), **kw) -> DataFrame:
    """Non-maximum suppression: boxes by falling confidence, dropping those a kept box covers."""
    order = [-F.col("confidence"), *[F.col(c) for c in tie]]
    return anchors_only(df, group, order, threshold, strict, **kw)


def merge_tiles(tiles: DataFrame, whole: DataFrame, group: Sequence[str] = ("item_id",), threshold: float = 0.45,
                tie: Sequence[str] = ("seq",)) -> DataFrame:
    """Shift tile detections by their tile origin, add the whole-image pass and suppress duplicates."""
    moved = tiles
    for axis in "xy":
        for side in "12":
            moved = moved.withColumn(f"{axis}{side}", F.col(f"{axis}{side}") + F.col(f"tile_{axis}"))
    return nms(moved.drop("tile_x", "tile_y").unionByName(whole), group, threshold, tie=tie)


def overlapping_objects(objects: DataFrame, key: str = "cluster_id", item: Sequence[str] = ("item_id",)) -> DataFrame:
    """Keys of objects that overlap another object of the same item."""
    pairs = iou_join(objects, objects, item, 0.0, F.col(f"a_{key}") != F.col(f"b_{key}"))
    return pairs.select(*item, F.col(f"a_{key}").alias(key)).distinct()


# ---------------------------------------------------------------- transitive merge

def _merge_group(boxes: np.ndarray, counts: np.ndarray, threshold: float) -> list[tuple]:
    """Grow each unclaimed box, in order, by every unclaimed box it overlaps, until nothing changes.

    Boxes lie in the cell of their centre on the level of their size. An envelope asks only the cells where a box of
    that IoU may be, and takes all boxes in order up to the one that makes it grow.
    """
    sides = np.maximum(boxes[:, 2] - boxes[:, 0], boxes[:, 3] - boxes[:, 1])
    area = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
    steps = math.ceil(math.log2(1 / threshold))
    usable = (sides > 0) & np.isfinite(sides)
    level = np.zeros(len(boxes), dtype=np.int64)
    level[usable] = np.ceil(np.log2(sides[usable]))
    size = np.exp2(level)
    cell = np.floor((boxes[:, :2] + boxes[:, 2:]) / 2 / size[:, None])
    cells: dict[int, dict[tuple[float, float], list[int]]] = {}
    for i in np.flatnonzero(usable).tolist():
        cells.setdefault(int(level[i]), {}).setdefault((cell[i, 0], cell[i, 1]), []).append(i)
    grid = {n: {c: np.array(m) for c, m in at.items()} for n, at in cells.items()}
    free, out = np.ones(len(boxes), dtype=bool), []

    def around(cur: np.ndarray) -> np.ndarray:
        side = max(cur[2] - cur[0], cur[3] - cur[1])
        found = []
        if side > 0:
            own = math.ceil(math.log2(side))
            for n in range(own - steps, own + steps + 1):
                at = grid.get(n)
                if not at:
                    continue
                width, reach = 2.0**n, (2.0**n + 2.0**own) / 2
                (ax, bx), (ay, by) = [[math.floor(((cur[k] + cur[k + 2]) / 2 + s * reach) / width) for s in (-1, 1)] for k in (0, 1)]
                ask = ((x, y) for x in range(ax, bx + 1) for y in range(ay, by + 1)) if (bx - ax + 1) * (by - ay + 1) < len(at) else (
                    c for c in at if ax <= c[0] <= bx and ay <= c[1] <= by)
                for c in ask:
                    members = at.get(c)
                    if members is not None and len(members):
                        # Claimed boxes leave their cell for good.
                        at[c] = members = members[free[members]]
                        found.append(members)
        return np.sort(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)

    for i in range(len(boxes)):
        if not free[i]:
            continue
        free[i] = False
        cur, total, last, grew = boxes[i].copy(), int(counts[i]), -1, False
        near = around(cur)
        while True:
            # The rest of this pass, with the envelope as it is now.
            rest = near[(near > last) & free[near]]
            b = boxes[rest]
            inter = np.maximum(0.0, np.minimum(cur[2], b[:, 2]) - np.maximum(cur[0], b[:, 0])) * np.maximum(0.0, np.minimum(cur[3], b[:, 3]) - np.maximum(cur[1], b[:, 1]))
            union = (cur[2] - cur[0]) * (cur[3] - cur[1]) + area[rest] - inter
            hits = rest[(union > 0) & (inter > 0) & (inter / np.where(union > 0, union, 1.0) > threshold)]
            if len(hits):
                h = boxes[hits]
                beyond = np.flatnonzero((h[:, :2] < cur[:2]).any(axis=1) | (h[:, 2:] > cur[2:]).any(axis=1))
                taken = hits[: beyond[0] + 1] if len(beyond) else hits
                free[taken], grew = False, True
                total += int(counts[taken].sum())
                if len(beyond):
                    far = boxes[taken[-1]]
                    cur, last = np.r_[np.minimum(cur[:2], far[:2]), np.maximum(cur[2:], far[2:])], taken[-1]
                    near = around(cur)
                    continue
            if not grew:
                break
            last, grew = -1, False
        out.append((*map(float, cur), total))
    return out


def _merge_groups(boxes: np.ndarray, counts: np.ndarray, starts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_merge_group`` for many groups at once: (group, box, count) of every envelope.

    Groups do not touch each other, so each step takes all of them one step on: the envelope of every group takes the boxes in order up to
    the one that makes it grow, begins another pass after one that grew, or is done and the next free box begins one.
    """
    n = len(boxes)
    sides = np.maximum(boxes[:, 2] - boxes[:, 0], boxes[:, 3] - boxes[:, 1])
    area = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
    usable = (sides > 0) & np.isfinite(sides)
    owner = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))
    free, seed = np.ones(n, dtype=bool), starts.copy()
    cur, total, last, grew = boxes[seed], counts[seed].copy(), np.full(len(starts), -1), np.zeros(len(starts), dtype=bool)
    free[seed] = False
    busy, out = np.ones(len(starts), dtype=bool), []
    # Free boxes of groups that are not done; the others drop out as they go.
    left = np.flatnonzero(free)
    while busy.any():
        left = left[free[left] & busy[owner[left]]]
        g, b = owner[left], boxes[left]
        c = cur[g]
        inter = np.maximum(0.0, np.minimum(c[:, 2], b[:, 2]) - np.maximum(c[:, 0], b[:, 0])) * np.maximum(0.0, np.minimum(c[:, 3], b[:, 3]) - np.maximum(c[:, 1], b[:, 1]))
        union = (c[:, 2] - c[:, 0]) * (c[:, 3] - c[:, 1]) + area[left] - inter
        hit = (left > last[g]) & usable[left] & (union > 0) & (inter > 0) & (inter / np.where(union > 0, union, 1.0) > threshold)
        beyond = np.flatnonzero(hit & ((b[:, :2] < c[:, :2]).any(axis=1) | (b[:, 2:] > c[:, 2:]).any(axis=1)))
        first = beyond[np.flatnonzero(np.r_[True, g[beyond][1:] != g[beyond][:-1]])] if len(beyond) else beyond
        upto = np.full(len(starts), n)
        upto[g[first]] = left[first]
        taken = hit & (left <= upto[g])
        free[left[taken]] = False
        np.add.at(total, g[taken], counts[left[taken]])
        met = np.zeros(len(starts), dtype=bool)
        met[g[taken]] = True
        wider = g[first]
        cur[wider] = np.c_[np.minimum(cur[wider, :2], b[first, :2]), np.maximum(cur[wider, 2:], b[first, 2:])]
        # Done: a pass without a hit. Other passes that came to their end begin again.
        done = np.flatnonzero(busy & ~met & ~grew)
        grew, last = np.zeros(len(starts), dtype=bool), np.full(len(starts), -1)
        last[wider], grew[wider] = left[first], True
        if len(done):
            out.append((done, cur[done], total[done]))
            rest = left[free[left] & np.isin(g, done)]
            heads = rest[np.flatnonzero(np.r_[True, owner[rest][1:] != owner[rest][:-1]])] if len(rest) else rest
            busy[done] = False
            again = owner[heads]
            busy[again] = True
            cur[again], total[again], free[heads] = boxes[heads], counts[heads], False
    groups, found, sums = (np.concatenate([x[k] for x in out]) for k in range(3))
    return groups, found, sums


def merge_boxes(df: DataFrame, group: Sequence[str] = ("item_id",), threshold: float = 0.2, order: str = "seq",
                limit: int = GROUP_LIMIT) -> DataFrame:
    """Merge boxes into growing envelopes; ``n`` counts are summed.

    The result depends on the box order, so each item is one unit of work, near linear in its boxes; a task walks
    through many items in step. Items
    above ``limit`` boxes are first cut into parts that cannot touch: an empty
    vertical or horizontal strip between two runs of boxes also separates their
    envelopes. ``threshold`` must be above 0.
    """
    group = list(group)
    schema = df.select(*group, *BOX, F.col("n").cast("bigint").alias("n")).schema

    def run(rows: DataFrame, keys: list[str]) -> DataFrame:
        def one(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            rows = pdf.sort_values(order)
            merged = pd.DataFrame(_merge_group(rows[list(BOX)].to_numpy(float), rows["n"].to_numpy(), threshold), columns=[*BOX, "n"])
            for g in reversed(group):
                merged.insert(0, g, pdf[g].iloc[0])
            return merged

        return rows.groupBy(*keys).applyInPandas(one, schema)

    def fold(table: pa.Table, starts: np.ndarray) -> pa.Table:
        boxes = np.stack([table.column(c).to_numpy() for c in BOX], axis=1).astype(float)
        owner, found, sums = _merge_groups(boxes, table.column("_n").to_numpy(), starts, threshold)
        heads = table.select(group).take(pa.array(starts[owner]))
        return pa.table([*heads.columns, *[pa.array(found[:, k], from_pandas=True) for k in range(4)], pa.array(sums)], names=[*group, *BOX, "n"])

    cold, hot = split_hot(df, group, limit)
    rows = cold.select(*group, order, *[F.col(c).cast("double").alias(c) for c in BOX], F.coalesce(F.col("n").cast("bigint"), F.lit(0)).alias("_n"))
    plain = StructType([*df.select(*group).schema, *[StructField(c, DoubleType()) for c in BOX], StructField("n", LongType())])
    out = fold_groups(rows, group, [F.col(order).asc_nulls_last(), *BOX], fold, plain).select(*[F.col(f.name).cast(f.dataType) for f in schema])
    if hot is not None:
        out = out.unionByName(run(_strips(_strips(hot, group, "x"), [*group, "_sx"], "y"), [*group, "_sx", "_sy"]))
    return out


def _strips(df: DataFrame, group: list[str], axis: str) -> DataFrame:
    """Number the runs of boxes between empty strips along one axis.

    Works on the distinct intervals, merged per coarse cell before the window, so
    its size follows the extent of the item and not the number of boxes.
    """
    lo, hi = f"{axis}1", f"{axis}2"
    spans = df.groupBy(*group, F.floor(F.col(lo)).alias("_cell")).agg(F.min(lo).alias("_lo"), F.max(hi).alias("_hi"))
    w = Window.partitionBy(*group).orderBy("_cell")
    before = F.max("_hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = spans.withColumn("_new", (F.col("_lo") > F.coalesce(before, F.col("_lo"))).cast("int"))
    runs = starts.withColumn(f"_s{axis}", F.sum("_new").over(w)).select(*group, "_cell", f"_s{axis}")
    return df.withColumn("_cell", F.floor(F.col(lo))).join(runs, [*group, "_cell"]).drop("_cell")


# ---------------------------------------------------------------- union area

_SLAB_X = "array_sort(array_distinct(concat(transform(_b, b -> b.x1), transform(_b, b -> b.x2))))"
_SLAB_AREA = """aggregate(sequence(1, size(_x) - 1), 0D, (acc, i) -> acc + (_x[i] - _x[i - 1]) * (
    aggregate(array_sort(transform(filter(_b, b -> b.x1 <= _x[i - 1] AND b.x2 >= _x[i]),
                                   b -> named_struct('a', b.y1, 'b', b.y2))),
      named_struct('end', CAST(-1e300 AS DOUBLE), 'len', 0D),
      (s, v) -> named_struct('end', greatest(s.end, v.b), 'len', s.len + greatest(0D, v.b - greatest(s.end, v.a))),
      s -> s.len)))"""


def _clip(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rectangles per tile of side ``_t``; equal ones collapse before the shuffle."""
    cells, tile = boxes, F.col("_t")
    for axis in "xy":
        lo, hi = F.col(f"{axis}1"), F.col(f"{axis}2")
        cells = cells.withColumn(f"_c{axis}", F.explode(F.sequence(
            F.floor(lo / tile), F.greatest(F.floor(lo / tile), F.ceil(hi / tile) - 1))))
    return cells.select(
        *keys, "_t", "_cx", "_cy",
        F.greatest("x1", F.col("_cx") * tile).alias("x1"), F.greatest("y1", F.col("_cy") * tile).alias("y1"),
        F.least("x2", (F.col("_cx") + 1) * tile).alias("x2"), F.least("y2", (F.col("_cy") + 1) * tile).alias("y2"),
    ).distinct()


def _full():
    return (F.col("x2") - F.col("x1") >= F.col("_t")) & (F.col("y2") - F.col("y1") >= F.col("_t"))


def _tile_areas(rects: DataFrame, keys: list[str]) -> DataFrame:
    full = _full()
    listed = rects.groupBy(*keys, "_t", "_cx", "_cy").agg(
        F.max(full.cast("int")).alias("_whole"), F.collect_list(F.when(~full, F.struct(*BOX))).alias("_b"))
    area = F.when(F.col("_whole") == 1, F.col("_t") * F.col("_t")).otherwise(
        F.when(F.size("_b") > 0, F.expr(_SLAB_AREA)).otherwise(0.0))
    return listed.withColumn("_x", F.expr(_SLAB_X)).select(*keys, area.alias("_area"))


# Boxes that a tile should hold on average, and most tiles per side that a first cut makes of a group.
_PER_TILE, _SIDE = 32, 8


def _with_tile(boxes: DataFrame, group: list[str]) -> DataFrame:
    """Add ``_t``: a power of two that cuts the extent of the group into about one tile per _PER_TILE boxes, at most _SIDE per side."""
    ends = boxes.groupBy(*group).agg(
        F.count("*").alias("_n"), F.greatest(F.max("x2") - F.min("x1"), F.max("y2") - F.min("y1")).alias("_extent"))
    parts = F.greatest(F.lit(1.0), F.least(F.lit(float(_SIDE)), F.sqrt(F.col("_n") / _PER_TILE)))
    tile = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("_extent") / parts)))
    if not group:
        return boxes.crossJoin(F.broadcast(ends.select(tile.alias("_t"))))
    return boxes.join(ends.select(*group, tile.alias("_t")), group)


def union_area(boxes: DataFrame, group: Sequence[str] = ("item_id",), tile: float | None = None,
               limit: int = 2048) -> DataFrame:
    """Area covered by at least one box of the group; overlaps count once.

    Boxes are clipped to tiles and reduced to distinct rectangles per tile. A
    tile's area is the sum over its x-slabs of the merged y-intervals, computed
    inside the row of the tile; tile areas add up exactly. Tiles follow the extent of the group, so a box
    gives at most some tens of rows however large it is; ``tile`` fixes their side instead. In groups above
    ``limit`` boxes, a tile that still has more distinct rectangles is cut into
    quarter-size tiles, again and again: rectangles filling a tile decide it, so
    crowded tiles empty out.
    """
    group = list(group)
    usable = boxes.where(box_ok()).select(*group, *BOX)
    # Dealt out once by group: extents, tiles and sums of a group then need no further shuffle.
    usable = dealt(usable, group) if group else usable

    def tiled(rows: DataFrame) -> DataFrame:
        return _with_tile(rows, group) if tile is None else rows.withColumn("_t", F.lit(float(tile)))

    cold, hot = split_hot(usable, group, limit)
    parts = [_tile_areas(_clip(tiled(cold), group), group)]
    hot = None if hot is None else tiled(hot)
    cells = [*group, "_t", "_cx", "_cy"]
    while hot is not None:
        rects = cut(_clip(hot, group))
        done = rects.where(_full()).select(*cells).distinct()
        parts.append(done.select(*group, (F.col("_t") * F.col("_t")).alias("_area")))
        open_rects = rects.join(done, cells, "left_anti")
        small, crowded = split_hot(open_rects, cells, limit)
        parts.append(_tile_areas(small, group))
        hot = None if crowded is None else cut(crowded.select(*group, *BOX, (F.col("_t") / 4).alias("_t")))
    areas = reduce(DataFrame.unionByName, parts)
    return areas.groupBy(*group).agg(F.sum("_area").alias("union_area"))
