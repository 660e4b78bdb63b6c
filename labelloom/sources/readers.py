"""Readers and normalisers of submissions, labels, logs and model answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions import geometry as G
from labelloom.functions import taxonomy as T
from labelloom.functions.text import strip_ansi
from labelloom.scale import cut_to

ANNOTATION = "struct<hazard_class:string,bounding_box:array<double>,polygon:array<array<double>>,area:double,weight:double,confidence:double>"
RECORD = f"struct<image_id:string,image_url:string,timestamp:string,model_version:string,annotations:array<{ANNOTATION}>>"
PAYLOAD = f"schema_version string, task_id string, batch_id string, round_num bigint, records array<{RECORD}>, _corrupt_record string"


def read_submissions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Submission payloads to (annotation rows, rejected payloads).

    A payload is rejected when it is not JSON or its records are not a list. Empty
    documents keep one row with a null ``seq``.
    """
    raw = spark.read.schema(PAYLOAD).option("columnNameOfCorruptRecord", "_corrupt_record").json(path).select(
        "*", F.col("_metadata.file_path").alias("source_file"))
    return split_payloads(raw)


def split_payloads(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    bad = F.col("_corrupt_record").isNotNull() | F.col("records").isNull()
    # A file is read again for each side instead of being held in memory.
    docs = raw.where(~bad).select("task_id", "batch_id", "round_num", "source_file",
                                  F.posexplode_outer("records").alias("record_id", "r"))
    anns = docs.select("task_id", "batch_id", "round_num", "source_file", "record_id", F.col("r.image_id").alias("item_id"),
                       F.col("r.model_version").alias("model_version"), F.posexplode_outer("r.annotations").alias("seq", "a"))
    box = F.col("a.bounding_box")
    points = F.transform("a.polygon", lambda p: G.point(F.get(p, 0), F.get(p, 1)))
    rows = anns.select(
        "task_id", "batch_id", "round_num", "source_file", "record_id", "item_id", "model_version", F.col("seq").cast("bigint"),
        F.col("a.hazard_class").alias("label"), *[F.get(box, i).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))],
        points.alias("polygon"), *[F.col("a." + c).alias(c) for c in ("area", "weight", "confidence")])
    return rows, raw.where(bad).select("source_file", "_corrupt_record")


def ingest_coco(images: DataFrame, anns: DataFrame, categories: DataFrame) -> DataFrame:
    """Annotation rows of a detection manifest: crowds and empty boxes dropped, xywh to rounded xyxy, names normalised.

    ``images``: id, width, height. ``anns``: image_id, category_id, iscrowd,
    bbox. ``categories``: id, name.
    """
    names = categories.select(
        F.col("id").alias("category_id"), F.replace(F.lower(F.trim("name")), F.lit(" "), F.lit("_")).alias("label"))
    box = [F.get("bbox", i) for i in range(4)]
    good = anns.where((F.coalesce(F.col("iscrowd"), F.lit(0)) == 0) & (F.size("bbox") == 4) & (box[2] > 0) & (box[3] > 0))
    return good.join(names, "category_id").join(images.select(F.col("id").alias("image_id"), "width", "height"), "image_id").select(
        "image_id", "label", F.rint(box[0]).alias("x1"), F.rint(box[1]).alias("y1"), F.rint(box[0] + box[2]).alias("x2"),
        F.rint(box[1] + box[3]).alias("y2"), "width", "height")


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    """``ingest_coco`` of one manifest file."""
    schema = ("images array<struct<id:bigint,file_name:string,width:int,height:int>>, annotations array<struct<image_id:bigint,"
              "category_id:bigint,iscrowd:int,bbox:array<double>>>, categories array<struct<id:bigint,name:string>>")
    doc = spark.read.schema(schema).option("multiLine", "true").json(path)
    parts = [doc.select(F.inline(c)) for c in ("images", "annotations", "categories")]
    return ingest_coco(*parts)


def normalize_label_payload(df: DataFrame, payload: str = "payload", class_names: Sequence[str] = ()) -> DataFrame:
    """Label payloads of two shapes to clipped boxes with label and severity.

    Either ``{"bbox": [[..]], "category": [..]}`` or a list of objects with
    ``bbox`` or ``box`` and ``category``, ``category_id`` or ``label``. A box
    that fits the image when read as x, y, w, h is taken so, else as corners.
    """
    flat = F.from_json(payload, "struct<bbox:array<array<double>>,category:array<string>>")
    listed = F.from_json(payload, "array<struct<bbox:array<double>,box:array<double>,category:string,category_id:string,label:string>>")
    pairs = F.transform(F.arrays_zip(flat["bbox"].alias("b"), flat["category"].alias("c")), lambda z: F.struct(
        z["b"].alias("b"), z["c"].alias("c")))

    def filled(v: Column) -> Column:
        return F.when(v.isNotNull() & ~v.isin("", "0"), v)

    entries = F.transform(listed, lambda e: F.struct(
        F.when(F.size(e["bbox"]) > 0, e["bbox"]).otherwise(e["box"]).alias("b"),
        F.coalesce(filled(e["category"]), filled(e["category_id"]), e["label"], e["category_id"]).alias("c")))
    is_list = F.ltrim(payload).startswith("[")
    rows = df.withColumn("_e", F.when(is_list, entries).otherwise(pairs)).select(
        *[c for c in df.columns if c != payload], F.posexplode("_e").alias("gt", "_e"))
    names = F.array(*[F.lit(n) for n in class_names]).cast("array<string>")
    raw = F.col("_e.c")
    index = F.when(raw.rlike("^[0-9]+$"), raw.cast("int"))
    label = F.coalesce(F.get(names, index), raw, F.lit("hazard"))
    a, b, c, d = (F.get("_e.b", i) for i in range(4))
    w, h = F.col("width"), F.col("height")
    sized = (c + a <= w + 1) & (d + b <= h + 1) & (c < w) & (d < h) & (c >= 0) & (d >= 0) & (c + d > 0)

    def clip(v: Column, limit: Column) -> Column:
        return F.greatest(F.lit(0), F.least(limit, F.rint(v).cast("int")))

    clean = F.replace(F.lower(F.trim(label)), F.lit(" "), F.lit("_"))
    out = rows.where(F.size("_e.b") == 4).select(
        *[c for c in df.columns if c != payload], "gt", F.when(clean == "", "hazard").otherwise(clean).alias("label"),
        clip(a, w).alias("x1"), clip(b, h).alias("y1"), clip(F.when(sized, a + c).otherwise(c), w).alias("x2"),
        clip(F.when(sized, b + d).otherwise(d), h).alias("y2"))
    return out.where("x2 > x1 AND y2 > y1").withColumn("severity", T.keyword_severity(F.col("label")))


def ingest_label_manifest(df: DataFrame, annotations: str = "annotations") -> DataFrame:
    """Explicit, finite, in-image boxes of a label manifest; rows without any stay label-only.

    ``df``: item_id, label (default class), width, height and the JSON list
    ``annotations``. Polygons keep their finite points when three or more remain.
    """
    default = F.lower(F.trim("label"))
    default = F.when(default.isin(list(T.COVER_SEVERITY)), default).otherwise("intact_forest")
    listed = F.from_json(annotations, "array<struct<hazard_class:string,bounding_box:array<double>,polygon:array<array<double>>>>")

    def fits(e):
        box = [F.get(e["bounding_box"], i) for i in range(4)]
        return ((F.size(e["bounding_box"]) == 4) & F.forall(e["bounding_box"], G.finite) & (box[0] >= 0) & (box[1] >= 0)
                & (box[2] <= F.col("width")) & (box[3] <= F.col("height")) & (box[2] > box[0]) & (box[3] > box[1]))

    good = F.coalesce(F.filter(listed, fits), F.array().cast(
        "array<struct<hazard_class:string,bounding_box:array<double>,polygon:array<array<double>>>>"))
    rows = df.select("item_id", default.alias("_d"), good.alias("_g")).select(
        "item_id", "_d", F.when(F.size("_g") == 0, F.col("_d")).alias("only_label"), F.posexplode_outer("_g").alias("gt", "e"))
    name = F.trim("e.hazard_class")
    label = F.when(F.col("e").isNotNull(), F.when(F.coalesce(name, F.lit("")) != "", name).otherwise(F.col("_d")))
    kept = F.filter("e.polygon", lambda p: (F.size(p) >= 2) & G.finite(F.get(p, 0)) & G.finite(F.get(p, 1)))
    points = F.transform(kept, lambda p: G.point(F.get(p, 0), F.get(p, 1)))
    return rows.select("item_id", "gt", "only_label", label.alias("label"), *[
        F.rint(F.get("e.bounding_box", i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))],
        T.cover_severity(label).alias("severity"), F.when(F.size(points) >= 3, points).alias("polygon"))


def scan_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Imagery table with an embedded JSON annotation column; only the named columns are read."""
    tiles = spark.read.parquet(path).select("image_id", "width", "height", "biome_name", "coco_annotations")
    return parse_tiles(tiles)


def parse_tiles(tiles: DataFrame) -> DataFrame:
    listed = F.from_json("coco_annotations", "array<struct<bbox:array<double>,area:double,segmentation:array<array<double>>>>")
    return tiles.select("image_id", "width", "height", F.col("biome_name").alias("biome"), F.posexplode_outer(listed).alias(
        "seq", "e")).select(
        "image_id", "width", "height", "biome", "seq", *[F.get("e.bbox", i).alias(c) for i, c in enumerate("xywh")],
        F.col("e.area").alias("area"), F.get("e.segmentation", 0).alias("segmentation"))


def read_points(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """Point rows (x, y) of CSV files inside the frame; unparsable lines are dropped."""
    rows = spark.read.schema("x double, y double").option("header", "true").option("mode", "DROPMALFORMED").csv(path).select(
        "x", "y", F.col("_metadata.file_name").alias("file_name"))
    return rows.where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height))


# The log events and their patterns.
LOG_TIME = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d+)"
ROUND_START = r"event=dual_flywheel_round_start step=(\d+) sampled_uids=\[([^\]]*)\]"
ROUND_DONE = r"event=dual_flywheel_round_done step=(\d+) uids=(\d+) winners=(\d+) rewards=\[(.*?)\]"
INVALID = r"event=dual_flywheel_invalid_response uid=(\d+) error=(.*)"
NO_VALID = r"event=dual_flywheel_no_valid_uids step=(\d+)"
ASSEMBLED = r"event=dataset_assembled images=(\d+) unique_winners=(\d+)"
OTHER_EVENTS = {
    "set_weights_ok": r"(?i)set_weights on chain successfully!?",
    "set_weights_skip": r"Skipping on-chain set_weights in local dev endpoint",
    "connector_error": r"ClientConnectorError",
    "timeout_error": r"TimeoutError#",
}


def parse_round_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """One row per recognised log event: event, time, step, participants, images and reward total."""
    line = strip_ansi(F.col(column))
    rows = lines.withColumn("_l", line)
    text = F.col("_l")
    time = F.try_to_timestamp(F.nullif(F.regexp_extract(text, LOG_TIME, 1), F.lit("")), F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]"))

    def listed(blob: Column) -> Column:
        return F.filter(F.transform(F.split(blob, ","), F.trim), lambda v: v != "")

    def number(pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).cast("bigint")

    rewards = F.filter(F.transform(listed(F.regexp_extract(text, ROUND_DONE, 4)), lambda v: v.try_cast("double")),
                       lambda v: v.isNotNull())
    timed = {"round_start": ROUND_START, "round_done": ROUND_DONE}
    plain = {"invalid_response": INVALID, "no_valid": NO_VALID, "assembled": ASSEMBLED, **OTHER_EVENTS}
    names = F.array_compact(F.array(
        *[F.when(text.rlike(p) & time.isNotNull(), n) for n, p in timed.items()],
        *[F.when(text.rlike(p), n) for n, p in plain.items()]))
    out = rows.select(F.explode(names).alias("event"), time.alias("time"), "_l")
    is_done = F.col("event") == "round_done"
    return out.select(
        "event", "time",
        F.when(F.col("event") == "round_start", number(ROUND_START, 1)).when(is_done, number(ROUND_DONE, 1)).when(
            F.col("event") == "no_valid", number(NO_VALID, 1)).alias("step"),
        F.when(F.col("event") == "round_start", F.size(listed(F.regexp_extract(text, ROUND_START, 2)))).alias("participants"),
        F.when(F.col("event") == "assembled", number(ASSEMBLED, 1)).alias("images"),
        F.when(is_done & (F.size(rewards) > 0), F.aggregate(rewards, F.lit(0.0), lambda a, v: a + v)).alias("reward_total"))


def read_round_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_round_log(spark.read.text(path))


def latest_records(df: DataFrame, key: str = "item_id", file: str = "file_name", line: str = "line") -> DataFrame:
    """Last record per key by (file, line); one map-side combined maximum per key."""
    rest = [c for c in df.columns if c != key]
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(file, line)).alias("_r"))
    return best.select(key, "_r.*")


def read_step_files(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Latest record per item over all step files."""
    # Splits of one file are numbered by where they start; the id counts lines inside a split.
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    rows = spark.read.schema(schema).json(pattern).select("*", F.col("_metadata.file_name").alias("file_name"), place.alias("line"))
    return latest_records(rows.withColumnRenamed("image_id", "item_id")).drop("file_name", "line")


def union_sources(rows: DataFrame, golden: DataFrame, cap: int, order: Sequence[str] = ("source",), key: str = "doc_id") -> DataFrame:
    """Pool over several sources: content kept by the first source that has it, never golden, at most ``cap`` per source.

    The cap takes the first rows in key order per source.
    """
    free = rows.join(golden.select("item_hash").distinct(), "item_hash", "left_anti")
    first = free.groupBy("item_hash").agg(F.min(F.struct(*order, key)).alias("f"))
    kept = first.select(*[F.col("f." + c).alias(c) for c in [*order, key]], "item_hash")
    return cut_to(kept, ["source"], [F.col(key)], cap)


def read_sources(spark: SparkSession, specs: str, root: str) -> DataFrame:
    """All sources of a comma-separated 'org/name@split' list under ``root``, tagged with source and priority."""
    parts = [s.strip() for s in specs.split(",") if s.strip()]
    frames = []
    for i, spec in enumerate(parts):
        source, _, split = spec.partition("@")
        frames.append(spark.read.parquet(f"{root}/{source}/{split or 'train'}").withColumn("source", F.lit(source)).withColumn(
            "priority", F.lit(i)))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def merge_labels(a: DataFrame, b: DataFrame, key: str = "item_id") -> DataFrame:
    """Label rows of both maps, those of ``a`` before those of ``b``; kept as rows, so no item is collected."""
    return a.withColumn("origin", F.lit(0)).unionByName(b.withColumn("origin", F.lit(1)))


ANSWER = "array<struct<hazard_class:string,bounding_box:array<double>>>"
FENCED = r"(?s)```(?:json)?\s*\n?(.*?)\n?```"
BRACKETED = r"(?s)(\[.*\])"


def parse_answers(df: DataFrame, column: str = "answer") -> DataFrame:
    """Detections in free-text answers: the text as JSON, else its fenced block, else the bracketed part.

    Entries without a class or a four-number box go; rows without detections
    keep one row with a null ``seq``.
    """
    text = F.trim(column)

    def parsed(v: Column) -> Column:
        v = F.trim(v)
        return F.when(v.startswith("["), F.from_json(v, ANSWER))

    got = F.coalesce(parsed(text), parsed(F.regexp_extract(text, FENCED, 1)), parsed(F.regexp_extract(text, BRACKETED, 1)))
    good = F.filter(got, lambda e: (F.coalesce(e["hazard_class"], F.lit("")) != "") & (F.size(e["bounding_box"]) == 4)
                    & F.forall(e["bounding_box"], G.finite)
                    & (F.get(e["bounding_box"], 2) > F.get(e["bounding_box"], 0))
                    & (F.get(e["bounding_box"], 3) > F.get(e["bounding_box"], 1)))
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.posexplode_outer(good).alias("seq", "e")).select(
        *rest, "seq", F.col("e.hazard_class").alias("label"),
        *[F.get("e.bounding_box", i).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])
