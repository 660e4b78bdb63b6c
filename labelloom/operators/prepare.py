"""Dataset preparation: splits, samples, batches, plans, point clusters, composites."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from labelloom.functions import geometry as G
from labelloom.functions import taxonomy as T
from labelloom.functions.text import hash_bucket, hash_fraction, hash_order
from labelloom.operators.reward import hamilton
from labelloom.scale import GROUP_LIMIT, cut_to, exact_quantile, first_rows, fold_groups, ranked, running_total, split_hot
from labelloom.session import cut

# ---------------------------------------------------------------- splits and samples


def golden_split(df: DataFrame, key: str, ratio: float, seed: str) -> DataFrame:
    """Golden flag: hash fraction of 'id:seed' under the ratio."""
    return df.withColumn("is_golden", hash_fraction(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed))) < ratio)


def hash_split(df: DataFrame, key: str, seed: int = 42, train: int = 60, val: int = 20) -> DataFrame:
    """Train / validation / inference part from the hash bucket of id+seed; ``val=0`` gives the two-way split."""
    if train + val > 100:
        raise ValueError("train and val exceed 100 percent")
    bucket = hash_bucket(F.concat(F.col(key).cast("string"), F.lit(str(seed))))
    return df.withColumn("part", F.when(bucket < train, "train").when(bucket < train + val, "val").otherwise("inference"))


def sample_rows(df: DataFrame, key: str, n: int, seed: str, group: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows per group in seeded hash order."""
    return cut_to(df, group, [hash_order(seed, F.col(key)), F.col(key)], n)


def sample_participants(people: DataFrame, exclude: DataFrame, n: int, seed: str, key: str = "annotator_id") -> DataFrame:
    """``n`` participants in seeded order without the excluded ones."""
    return sample_rows(people.join(exclude.select(key), key, "left_anti"), key, n, seed)


def top_participants(people: DataFrame, quantile: float, n: int, seed: str) -> DataFrame:
    """``n`` trusted participants with a stake at or above the quantile of all stakes."""
    level = exact_quantile(people, "stake", F.lit(quantile), name="_q")
    rich = people.crossJoin(F.broadcast(level)).where(F.col("stake") >= F.col("_q")).select("annotator_id")
    trusted = people.where("trusted").select("annotator_id")
    return sample_rows(rich.intersect(trusted), "annotator_id", n, seed)


def choose_golden_rich(items: DataFrame, n_golden: int, n_raw: int, seed: str, min_objects: int = 5) -> DataFrame:
    """Golden items from those with many objects, then raw items from all others, in seeded order."""
    rich = items.where(F.col("objects") >= min_objects)
    golden = sample_rows(rich, "item_id", n_golden, seed).select("item_id", F.lit("golden").alias("role"))
    rest = items.join(golden.select("item_id"), "item_id", "left_anti")
    raw = sample_rows(rest, "item_id", n_raw, seed + "/raw").select("item_id", F.lit("raw").alias("role"))
    return golden.unionByName(raw)


def stratified_sample(df: DataFrame, key: str, stratum: str, n: int, seed: str) -> DataFrame:
    """``n`` rows: an equal share per stratum (at least one), topped up from the rest in seeded order.

    Only the first n rows of a stratum can be taken, and tasks keep no more than that before the shuffle.
    """
    order = [hash_order(seed, F.col(key)), F.col(key)]
    strata = df.select(stratum).distinct().agg(F.count("*").alias("_k"))
    row = first_rows(df, [stratum], order, n, "_r").crossJoin(F.broadcast(strata))
    late = (F.col("_r") > F.greatest(F.lit(1), F.floor(F.lit(n) / F.col("_k")))).cast("int")
    return cut_to(row.withColumn("_late", late), [], [F.col("_late"), *order], n).drop("_r", "_k", "_late")


def inject_golden(items: DataFrame, size: int, n_golden: int, seed: str) -> DataFrame:
    """A request of ``size`` items with ``n_golden`` boxed golden items, in seeded order.

    Raises when golden items are asked for and none has boxes.
    """
    if size < 1 or n_golden < 0 or n_golden > size:
        raise ValueError("0 <= golden items <= request size, and at least one item")
    golden = sample_rows(items.where("role = 'golden'"), "item_id", n_golden, seed + "/golden")
    found = golden.count()
    if n_golden and not found:
        raise RuntimeError("no golden item with boxes")
    public = sample_rows(items.where("role = 'public'"), "item_id", size - found, seed + "/public")
    both = golden.unionByName(public)
    return ranked(both, [], [hash_order(seed + "/order", F.col("item_id")), F.col("item_id")], "position")


def mask_items(plan: DataFrame, annotators: DataFrame, salt: str, by: str = "task_id") -> DataFrame:
    """Opaque item id per annotator of the task; the order is the same for all of them."""
    token = F.sha2(F.concat_ws("|", F.lit(salt), F.col("annotator_id").cast("string"), F.col("item_id").cast("string")), 256)
    return plan.join(annotators, by).withColumn("token", token)


def sample_points(regions: DataFrame, n: int, seed: str) -> DataFrame:
    """``n`` seeded uniform points inside the box of each region."""
    rows = regions.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def part(axis: str) -> Column:
        return hash_fraction(F.concat_ws(":", F.lit(seed), F.col("region"), F.col("point").cast("string"), F.lit(axis)))

    return rows.select(
        "region", "point", (F.col("lon_min") + part("lon") * (F.col("lon_max") - F.col("lon_min"))).alias("lon"),
        (F.col("lat_min") + part("lat") * (F.col("lat_max") - F.col("lat_min"))).alias("lat"))


def expand_grid(spark: SparkSession, space: dict[str, list], max_trials: int = 0, seed: str = "42") -> DataFrame:
    """All combinations of the listed values, or a seeded sample of them.

    Row number i is read as a number in mixed base, one digit per parameter, so
    no join is needed.
    """
    names = sorted(space)
    rows = spark.range(math.prod(len(space[n]) for n in names)).withColumnRenamed("id", "trial")
    stride = 1
    for n in reversed(names):
        values = F.array(*[F.lit(v) for v in space[n]])
        rows = rows.withColumn(n, F.get(values, (F.floor(F.col("trial") / stride) % len(space[n])).cast("int")))
        stride *= len(space[n])
    return sample_rows(rows, "trial", max_trials, seed) if max_trials else rows


# ---------------------------------------------------------------- pools and batches


def dedup_content(df: DataFrame, key: str, content: str) -> DataFrame:
    """Rows whose content occurs first (lowest key); the text itself is not shuffled."""
    first = df.select(F.sha2(content, 256).alias("_h"), key).groupBy("_h").agg(F.min(key).alias(key))
    return df.join(first.select(key), key, "left_semi")


def exclude_overlap(raw: DataFrame, golden: DataFrame, content: str) -> DataFrame:
    """Raw rows whose content is not in the golden pool."""
    known = golden.select(F.sha2(content, 256).alias("_h")).distinct()
    return raw.withColumn("_h", F.sha2(content, 256)).join(known, "_h", "left_anti").drop("_h")


def inventory(raw: DataFrame, golden: DataFrame, content: str, public_per: int = 27, golden_per: int = 3) -> DataFrame:
    """Unique, duplicate, overlapping and unused counts of both pools."""
    r = raw.select(F.sha2(content, 256).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    g = golden.select(F.sha2(content, 256).alias("h")).groupBy("h").agg(F.count("*").alias("m"))
    both = r.join(g, "h", "full_outer")
    in_raw, in_gold = F.col("n").isNotNull(), F.col("m").isNotNull()
    sums = both.agg(
        F.count_if(in_raw).alias("raw_unique"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("raw_duplicates"),
        F.count_if(in_gold).alias("golden_unique"), F.coalesce(F.sum(F.col("m") - 1), F.lit(0)).alias("golden_duplicates"),
        F.count_if(in_raw & in_gold).alias("overlap"))
    usable = F.col("raw_unique") - F.col("overlap")
    batches = F.least(F.floor(usable / public_per), F.floor(F.col("golden_unique") / golden_per))
    return sums.withColumn("batches", batches).withColumn(
        "public_unused", usable - batches * public_per).withColumn(
        "golden_unused", F.col("golden_unique") - batches * golden_per)


def make_batches(public: DataFrame, golden: DataFrame, key: str, public_per: int = 27, golden_per: int = 3) -> DataFrame:
    """Complete batches only, no item used twice; leftovers stay out."""
    def placed(df: DataFrame, per: int, role: str) -> DataFrame:
        rows = ranked(df.select(key), [], [F.col(key)], "_r")
        return rows.select(key, F.lit(role).alias("role"), (F.floor((F.col("_r") - 1) / per) + 1).alias("batch"),
                           ((F.col("_r") - 1) % per + 1).alias("slot"))

    p, g = placed(public, public_per, "public"), placed(golden, golden_per, "golden")
    capacity = (
        p.agg(F.floor(F.count("*") / public_per).alias("a")).crossJoin(g.agg(F.floor(F.count("*") / golden_per).alias("b")))
        .select(F.least("a", "b").alias("_cap")))
    return p.unionByName(g).crossJoin(F.broadcast(capacity)).where(F.col("batch") <= F.col("_cap")).drop("_cap")


def epoch_plan(items: DataFrame, seed: str, size: int = 30) -> DataFrame:
    """Every item once, ``size`` per task (the last may be short), golden items shared out by task size."""
    spark = items.sparkSession
    order = [hash_order(seed, F.col("item_id")), F.col("item_id")]
    numbered = ranked(items.select("item_id", (F.col("role") != "public").alias("is_golden")), ["is_golden"], order, "_r")
    counts = items.agg(F.count("*").alias("n"), F.count_if(F.col("role") != "public").alias("g")).first()
    tasks = spark.range(1, -(-counts["n"] // size) + 1).withColumnRenamed("id", "task").withColumn(
        "share", F.least(F.lit(size), F.lit(counts["n"]) - (F.col("task") - 1) * size))
    slots = spark.range(1).select(F.lit(counts["g"]).alias("n"))
    quota = cut(hamilton(tasks, slots, key="task"))
    parts = []
    for golden in (True, False):
        want = F.col("slots") if golden else F.col("share") - F.col("slots")
        run = running_total(quota.withColumn("_want", want), [], [F.col("task")], "_want", "_end")
        seats = run.where("_want > 0").select("task", F.explode(F.sequence(
            F.col("_end") - F.col("_want") + 1, F.col("_end"))).alias("_r"))
        parts.append(numbered.where(F.col("is_golden") == golden).join(seats, "_r").select("item_id", "is_golden", "task"))
    both = parts[0].unionByName(parts[1])
    return ranked(both, ["task"], [hash_order(seed + "/order", F.col("item_id")), F.col("item_id")], "position")


def pool_hash(df: DataFrame, fields: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Order-free fingerprint of a pool.

    Each row's hash is cut into four numbers; their sums and the row count are
    hashed again. Sums merge in any order, so no task ever holds the pool.
    """
    h = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("~")) for f in fields]), 256)
    parts = [F.conv(F.substring("_h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(4)]
    sums = df.withColumn("_h", h).groupBy(*by).agg(
        F.count("*").alias("rows"), *[F.sum(p).cast("string").alias(f"_s{i}") for i, p in enumerate(parts)])
    return sums.select(*by, "rows", F.sha2(F.concat_ws(
        "|", F.col("rows").cast("string"), *[F.col(f"_s{i}") for i in range(4)]), 256).alias("fingerprint"))


# ---------------------------------------------------------------- tiles and scenes


def filter_clean_tiles(pixels: DataFrame, dark: int = 8, bright: int = 248, max_dark: float = 0.05,
                       max_bright: float = 0.10) -> DataFrame:
    """Items whose shares of near-black and near-white pixels stay under the limits."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    black = (r <= dark) & (g <= dark) & (b <= dark)
    white = (r >= bright) & (g >= bright) & (b >= bright)
    return pixels.groupBy("item_id").agg(
        F.avg(black.cast("double")).alias("dark"), F.avg(white.cast("double")).alias("bright")).where(
        (F.col("dark") < max_dark) & (F.col("bright") < max_bright))


def infer_class(df: DataFrame, min_side: float = 4.0) -> DataFrame:
    """Label crowns from biome and area: xywh box clipped to the frame, small ones dropped, zero area replaced."""
    x2, y2 = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    boxed = (
        df.withColumn("x1", F.greatest(F.lit(0.0), F.col("x"))).withColumn("y1", F.greatest(F.lit(0.0), F.col("y")))
        .withColumn("x2", F.least(F.col("width").cast("double"), x2))
        .withColumn("y2", F.least(F.col("height").cast("double"), y2))
        .where((F.col("x2") - F.col("x1") >= min_side) & (F.col("y2") - F.col("y1") >= min_side)))
    area = F.when(F.coalesce("area", F.lit(0.0)) > 0, F.col("area")).otherwise(G.box_area())
    return boxed.withColumn("area", F.bround(area, 2)).withColumn("label", T.biome_label(F.col("biome"), area))


def segmentation_to_polygon(df: DataFrame, flat: str = "segmentation") -> DataFrame:
    """Flat coordinate lists to polygons; lists below three points become null."""
    return df.withColumn("polygon", G.flat_to_points(F.col(flat)))


def filter_scenes(scenes: DataFrame, start: str, end: str, max_cloud: float = 20.0, box=None) -> DataFrame:
    """Scenes in [start, end) under the cloud limit that touch the region; all plain predicates, so they reach the scan."""
    out = scenes.where((F.col("acquired") >= F.lit(start).cast("timestamp")) & (
        F.col("acquired") < F.lit(end).cast("timestamp")) & (F.col("cloud") < max_cloud))
    if box is not None:
        lon1, lat1, lon2, lat2 = box
        out = out.where((F.col("lon_max") >= lon1) & (F.col("lon_min") <= lon2)
                        & (F.col("lat_max") >= lat1) & (F.col("lat_min") <= lat2))
    return out


def median_composite(bands: DataFrame, cell: Sequence[str] = ("cell", "band")) -> DataFrame:
    """Exact median over the scenes of each cell and band."""
    return bands.groupBy(*cell).agg(F.median("value").alias("median"), F.count("*").alias("scenes"))


def label_tiles(tiles: DataFrame) -> DataFrame:
    """Land-cover label per tile; a positive loss year overrides it."""
    label = F.when(F.coalesce("loss_year", F.lit(0)) > 0, "deforestation").otherwise(T.cover_label(F.col("cover")))
    return tiles.withColumn("label", label).withColumn("severity", T.cover_severity(F.col("label")))


# ---------------------------------------------------------------- point clusters


def _components(edges: DataFrame) -> DataFrame:
    """Smallest connected node for every node of an undirected graph (columns u, v), by alternating star steps.

    Each step replaces edges by edges to smaller neighbours and keeps the
    components; it ends when a round changes nothing. Minima are combined before
    every shuffle and the edge set shrinks towards one edge per node.
    """
    cur, mark = cut(edges.select("u", "v").where("u <> v").distinct()), None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))).distinct()
        cur = cut(small)
        seen = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen


def _gaps(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the same order, small ones, with distances up to 2 kept and larger ones cut to 3."""
    distinct, place = np.unique(values, return_inverse=True)
    return np.r_[0, np.cumsum(np.minimum(np.diff(distinct), 3))].astype(np.int64)[place]


def _near_cells(x: np.ndarray, y: np.ndarray, owner: np.ndarray, eps: float) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Cells of many items at once as in ``cluster_points``: smallest connected cell, and x1, y1, x2, y2 and points, of each."""
    side = eps / math.sqrt(2.0)
    cx, cy = _gaps(np.floor(x / side)) + 2, _gaps(np.floor(y / side)) + 2
    high = int(cy.max()) + 3
    key = (owner * (int(cx.max()) + 3) + cx) * high + cy
    order = np.lexsort((y, x, key))
    key, x, y = key[order], x[order], y[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    cells, counts = key[first], np.diff(np.r_[first, len(key)])
    x1, y1 = (np.minimum.reduceat(v, first) for v in (x, y))
    x2, y2 = (np.maximum.reduceat(v, first) for v in (x, y))
    ends = []
    for dx, dy in ((dx, dy) for dx in range(-2, 3) for dy in range(-2, 3) if (dx, dy) > (0, 0)):
        at = np.minimum(np.searchsorted(cells, cells + dx * high + dy), len(cells) - 1)
        u = np.flatnonzero(cells[at] == cells + dx * high + dy)
        ends.append(np.stack([u, at[u]]))
    u, v = np.concatenate(ends, axis=1)
    gap = np.hypot(np.maximum(0.0, np.maximum(x1[v] - x2[u], x1[u] - x2[v])), np.maximum(0.0, np.maximum(y1[v] - y2[u], y1[u] - y2[v])))
    reach = np.hypot(np.maximum(x2[u], x2[v]) - np.minimum(x1[u], x1[v]), np.maximum(y2[u], y2[v]) - np.minimum(y1[u], y1[v]))
    linked = reach <= eps
    # Points meet only where the bounds do not settle a pair of cells, about a million pairs of them at a time.
    unsure = np.flatnonzero((gap <= eps) & ~linked)
    work = np.cumsum(counts[u[unsure]] * counts[v[unsure]])
    for part in np.split(unsure, np.unique(np.searchsorted(work, np.arange(1_000_000, int(work[-1]) if len(work) else 0, 1_000_000)))):
        a, b = counts[u[part]], counts[v[part]]
        pair = np.repeat(np.arange(len(part)), a * b)
        seat = np.arange(len(pair)) - np.repeat(np.cumsum(a * b) - a * b, a * b)
        p, q = first[u[part]][pair] + seat // b[pair], first[v[part]][pair] + seat % b[pair]
        near = np.hypot(x[p] - x[q], y[p] - y[q]) <= eps
        linked[part[pair[near]]] = True
    u, v, root = u[linked], v[linked], np.arange(len(cells))
    while (apart := root[u] != root[v]).any():
        u, v = u[apart], v[apart]
        np.minimum.at(root, np.maximum(root[u], root[v]), np.minimum(root[u], root[v]))
        while not np.array_equal(root, shorter := root[root]):
            root = shorter
    return root, (x1, y1, x2, y2, counts, first, order)


def cluster_points(points: DataFrame, eps: float, item: str = "item_id", margin: float = 8.0,
                   width: int | None = None, height: int | None = None) -> DataFrame:
    """Clusters of points chained by distances up to ``eps``, as padded boxes with a single/group label.

    Cells with a diagonal of ``eps`` are the nodes: all points of a cell are
    connected, so any number of points costs one node with its bounds. Two cells
    join when a pair of their points is near enough. Their bounds settle most
    cell pairs without looking at points; only for the rest are distinct points
    compared, and of those only the ones within ``eps`` of the other cell's bounds.

    Items of up to GROUP_LIMIT points travel once, and a task connects the cells of many of them; the cells of larger ones,
    and points without a place, are joined and connected by star steps.
    """
    fixed = F.col("x").isNotNull() & F.col("y").isNotNull() & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    cold, hot = split_hot(points.select(item, "x", "y"), [item], GROUP_LIMIT)
    small = cold.where(fixed).select(item, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))

    def fold(table: pa.Table, starts: np.ndarray) -> pa.Table:
        owner = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, table.num_rows]))
        root, (x1, y1, x2, y2, counts, first, order) = _near_cells(table.column("x").to_numpy(), table.column("y").to_numpy(), owner, eps)
        by = np.argsort(root, kind="stable")
        at = np.flatnonzero(np.r_[True, root[by][1:] != root[by][:-1]])
        heads = table.column(item).take(pa.array(order[first[by[at]]]))
        ends = [np.minimum.reduceat(v[by], at) for v in (x1, y1)] + [np.maximum.reduceat(v[by], at) for v in (x2, y2)]
        return pa.table([heads, *map(pa.array, ends), pa.array(np.add.reduceat(counts[by], at))], names=[item, "x1", "y1", "x2", "y2", "n"])

    plain = StructType([points.schema[item], *[StructField(c, DoubleType()) for c in ("x1", "y1", "x2", "y2")], StructField("n", LongType())])
    boxes = fold_groups(small, [item], [], fold, plain)
    rest = cold.where(F.coalesce(~fixed, F.lit(True)))
    rest = rest if hot is None else rest.unionByName(hot)
    if not rest.isEmpty():
        boxes = boxes.unionByName(_joined_clusters(rest, eps, item))

    def edge(name: str, sign: int, limit: int | None) -> Column:
        if sign < 0:
            return F.greatest(F.lit(0), F.floor(F.col(name) - margin)).cast("double")
        top = F.ceil(F.col(name) + margin)
        return (top if limit is None else F.least(F.lit(limit), top)).cast("double")

    return boxes.select(
        item, edge("x1", -1, None).alias("x1"), edge("y1", -1, None).alias("y1"),
        edge("x2", 1, width).alias("x2"), edge("y2", 1, height).alias("y2"), "n",
        F.when(F.col("n") == 1, "tree").otherwise("tree_group").alias("label"))


def _joined_clusters(points: DataFrame, eps: float, item: str) -> DataFrame:
    """Bounds and number of points of the clusters of items of any size, by joins of cells."""
    side = eps / math.sqrt(2.0)
    cell = F.struct(F.col(item).alias("i"), F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy"))
    nodes = points.groupBy(cell.alias("node")).agg(
        F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"),
        F.count("*").alias("n"))
    spots = points.select(cell.alias("node"), "x", "y").distinct()
    shifts = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3) if (dx, dy) > (0, 0)]
    moves = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in shifts])
    # Only neighbouring cells that exist are compared.
    near = nodes.select("node", F.explode(moves).alias("m"), *[F.col(c).alias("a_" + c) for c in ("x1", "x2", "y1", "y2")])
    near = near.withColumn("other", F.struct(
        F.col("node.i").alias("i"), (F.col("node.cx") + F.col("m.dx")).alias("cx"),
        (F.col("node.cy") + F.col("m.dy")).alias("cy")))
    pairs = near.join(nodes.select(F.col("node").alias("other"), *[F.col(c).alias("b_" + c) for c in ("x1", "x2", "y1", "y2")]),
                      "other")
    zero = F.lit(0.0)
    gap = F.hypot(F.greatest(zero, F.col("b_x1") - F.col("a_x2"), F.col("a_x1") - F.col("b_x2")),
                  F.greatest(zero, F.col("b_y1") - F.col("a_y2"), F.col("a_y1") - F.col("b_y2")))
    reach = F.hypot(F.greatest("a_x2", "b_x2") - F.least("a_x1", "b_x1"), F.greatest("a_y2", "b_y2") - F.least("a_y1", "b_y1"))
    pairs = pairs.where(gap <= eps).withColumn("sure", reach <= eps)
    sure = pairs.where("sure").select(F.col("node").alias("u"), F.col("other").alias("v"))
    bounds = ("x1", "x2", "y1", "y2")
    open_pairs = pairs.where("NOT sure").select("node", "other", *[p + c for p in ("a_", "b_") for c in bounds])

    def outside(x: str, y: str, p: str) -> Column:
        return F.hypot(F.greatest(zero, F.col(p + "x1") - F.col(x), F.col(x) - F.col(p + "x2")),
                       F.greatest(zero, F.col(p + "y1") - F.col(y), F.col(y) - F.col(p + "y2")))

    left = open_pairs.join(spots.withColumnsRenamed({"x": "ax", "y": "ay"}), "node").where(outside("ax", "ay", "b_") <= eps)
    right = open_pairs.join(spots.withColumnsRenamed({"node": "other", "x": "bx", "y": "by"}), "other").where(
        outside("bx", "by", "a_") <= eps).select("node", "other", "bx", "by")
    met = left.join(right, ["node", "other"])
    close = met.where(F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")) <= eps)
    linked = close.select(F.col("node").alias("u"), F.col("other").alias("v")).distinct()
    roots = _components(sure.unionByName(linked))
    tagged = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    boxes = tagged.groupBy("root").agg(
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
        F.sum("n").alias("n"))
    return boxes.select(F.col("root.i").alias(item), *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")], "n")
