"""Writers: dataset export, manifests, receipts, training text."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.operators.validate import audit_hash


def export_row(rows: DataFrame, column: str = "value") -> DataFrame:
    """Append the audit hash to each JSON row."""
    sealed = F.concat(F.expr(f"substring({column}, 1, length({column}) - 1)"), F.lit(',"audit_hash":"'),
                      audit_hash(F.col(column)), F.lit('"}'))
    return rows.withColumn(column, sealed)


def export_json(rows: DataFrame, column: str = "value") -> DataFrame:
    """Rows ready for the text sink."""
    return rows.withColumn(column, F.col(column).cast("string"))


def export_records(items: DataFrame, objects: DataFrame, votes: DataFrame, base_url: str, version: str) -> DataFrame:
    """Nested export rows (root, objects, votes) as JSON with audit hash: (item_id, dataset, batch, value).

    ``items``: one row per accepted item; ``objects`` and ``votes`` carry the
    keys ``item_id`` and ``cluster_id``. Nested lists are sorted, so a row hashes
    the same on every run.
    """
    vote = F.struct(
        F.col("annotator_id").alias("miner_uid"), F.col("identity").alias("miner_hotkey"), F.col("label").alias("class_voted"),
        F.col("severity").alias("severity_voted"), F.col("weight").alias("confidence"), F.array("x1", "y1", "x2", "y2").alias(
            "bounding_box"), F.col("weight").alias("reliability_weight_at_aggregation"))
    # Votes of a cluster are bounded by the voters of an item, objects by the object limit of an item.
    ballots = votes.groupBy("item_id", "cluster_id").agg(F.array_sort(F.collect_list(vote)).alias("miner_votes"))
    one = F.lit(1.0)
    obj = F.struct(
        F.col("cluster_id").alias("object_cluster_id"), F.lit("bayesian_dawid_skene_v1").alias("aggregation_method"),
        F.col("label").alias("accepted_hazard_class"), F.col("severity").alias("accepted_severity"), "confidence",
        one.alias("severity_confidence"), F.map_from_entries("posterior").alias("class_posterior_distribution"),
        F.create_map("severity", one).alias("severity_posterior_distribution"),
        F.array("f_x1", "f_y1", "f_x2", "f_y2").alias("fused_bounding_box"),
        F.col("mean_iou").alias("spatial_mean_iou_to_median"), "miner_votes", F.lit(None).cast("string").alias("escalation_reason"))
    packed = objects.join(ballots, ["item_id", "cluster_id"]).select(
        "item_id", F.col("cluster_id").alias("_c"), F.to_json(obj, {"ignoreNullFields": "false"}).alias("_o")).groupBy("item_id").agg(
        F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_c", "_o"))), lambda e: e["_o"]), ","),
                 F.lit("]")).alias("_objects"))
    root = F.struct(
        F.col("item_id").cast("string").alias("image_id"), F.col("method").alias("aggregation_method"),
        F.col("thresholds").alias("acceptance_thresholds"), F.col("window").alias("reliability_window"),
        F.lit(False).alias("escalation_required"), F.lit(None).cast("string").alias("escalation_reason"),
        F.lit(version).alias("validator_version"), F.col("contributions").alias("miner_contribution_scores"), "score",
        F.col("chosen").alias("chosen_uid"), F.concat(F.lit(base_url + "/images/"), F.col("image_name")).alias("image_url"),
        F.concat(F.lit(base_url + "/annotated-images/"), F.col("image_name")).alias("annotated_image_url"), "width", "height",
        F.lit(False).alias("is_golden"), "timestamp")
    flat = items.join(packed, "item_id").withColumn("_root", F.to_json(root, {"ignoreNullFields": "false"}))
    value = F.concat(F.expr("substring(_root, 1, length(_root) - 1)"), F.lit(',"objects":'), F.col("_objects"), F.lit("}"))
    return export_row(flat.select("item_id", "dataset", "batch", value.alias("value")))


def export_dataset(rows: DataFrame, path: str) -> None:
    """Write export rows as JSON lines, one folder per dataset and batch; a re-run replaces its own folders only."""
    rows.select("dataset", "batch", "value").write.partitionBy("dataset", "batch").option(
        "partitionOverwriteMode", "dynamic").mode("overwrite").text(path)


def build_manifest(items: DataFrame, by: Sequence[str] = ("dataset", "batch")) -> DataFrame:
    """Manifest rows: position of each item inside its batch with a neutral name."""
    from labelloom.scale import ranked

    return ranked(items, list(by), [F.col("item_id")], "position")


def build_receipts(manifest: DataFrame, exported: DataFrame, by: Sequence[str] = ("dataset", "batch")) -> DataFrame:
    """Verified counts per batch."""
    planned = manifest.groupBy(*by).agg(F.count("*").alias("verified_images"))
    labelled = exported.groupBy(*by).agg(F.count("*").alias("verified_annotation_records"))
    return planned.join(labelled, list(by), "left").fillna({"verified_annotation_records": 0}).withColumn(
        "status", F.when(F.col("verified_annotation_records") > 0, "verified").otherwise("unverified"))


def build_batch_summary(manifest: DataFrame, exported: DataFrame) -> DataFrame:
    """Batches of each dataset in numeric order of their suffix, with counts and status."""
    receipts = build_receipts(manifest, exported)
    number = F.regexp_extract("batch", r"_(\d+)$", 1)
    return receipts.select(
        "dataset", "batch", F.when(number == "", 999).otherwise(number.cast("int")).alias("number"),
        (F.col("verified_annotation_records") > 0).alias("labeled"), F.col("verified_images").alias("public_images"),
        F.col("status").alias("upload_status"))


def current_round(summary: DataFrame, order: str = "number") -> DataFrame:
    """Latest batch per dataset."""
    rest = [c for c in summary.columns if c not in ("dataset", order)]
    best = summary.groupBy("dataset").agg(F.max_by(F.struct(*rest), order).alias("r"), F.max(order).alias(order))
    return best.select("dataset", order, "r.*")


def dump_golden(golden: DataFrame, items: DataFrame) -> DataFrame:
    """Golden manifest rows: item, size, label-only class and its boxes as JSON.

    One row per item keeps the manifest distributed; the header (version, count)
    is the separate ``golden_header``.
    """
    boxes = golden.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct(
        "gt", F.col("label").alias("hazard_class"), F.array("x1", "y1", "x2", "y2").alias("bounding_box")))).alias("b"))
    scored = items.where("role <> 'public'").join(boxes, "item_id", "left")
    listed = F.transform(F.coalesce("b", F.array().cast(boxes.schema["b"].dataType)), lambda e: F.struct(
        e["hazard_class"].alias("hazard_class"), e["bounding_box"].alias("bounding_box")))
    return scored.select("item_id", "width", "height", F.col("only_label").alias("classification_label"), F.size(listed).alias(
        "boxes"), F.to_json(F.struct(listed.alias("annotations"))).alias("annotations"))


def golden_header(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.lit("golden_manifest.v1").alias("schema_version"), F.count("*").alias("image_count"))


def receipts(rows: DataFrame, identity: str = "identity", by: str = "round") -> DataFrame:
    """Receipt per identity and round as JSON, keyed by the identity hash."""
    body = [c for c in rows.columns if c not in (identity,)]
    return rows.select(F.sha2(F.col(identity).cast("string"), 256).alias("identity_hash"), F.col(by), F.to_json(F.struct(
        F.lit("agentic.feedback.v1").alias("schema_version"), *sorted(body))).alias("value"))


def latest_receipts(rows: DataFrame, by: str = "round") -> DataFrame:
    return rows.groupBy("identity_hash").agg(F.max_by("value", by).alias("value"), F.max(by).alias(by))


def write_receipts(rows: DataFrame, path: str, by: str = "round") -> None:
    """``round_N`` and ``latest`` folders under the hash of each identity; writing an old round again leaves a newer ``latest``."""
    made = receipts(rows, by=by)
    newest = latest_receipts(made, by)
    if _has_files(made.sparkSession, path):
        stored = made.sparkSession.read.schema("value string, identity_hash string, slot string").text(path, recursiveFileLookup=False)
        known = stored.where("slot LIKE 'round_%'").select("identity_hash", F.substring_index("slot", "_", -1).cast(made.schema[by].dataType).alias("_r"))
        newer = newest.join(known.groupBy("identity_hash").agg(F.max("_r").alias("_r")), "identity_hash", "left")
        newest = newer.where(F.col("_r").isNull() | (F.col(by) >= F.col("_r"))).drop("_r")
    named = made.withColumn("slot", F.concat(F.lit("round_"), F.col(by).cast("string"))).unionByName(
        newest.withColumn("slot", F.lit("latest")))
    named.select("identity_hash", "slot", "value").write.partitionBy("identity_hash", "slot").option(
        "partitionOverwriteMode", "dynamic").mode("overwrite").text(path)


def _has_files(spark, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


_CHUNK = 8 << 20


def digest_files(spark, path: str, pattern: str | None = None) -> DataFrame:
    """SHA-256 of every file under ``path``, of any size: (path, length, sha256).

    Spark lists the files and spreads them over the tasks; a task reads its files in chunks of a few megabytes, so no
    file is ever one value. Works for the file systems that pyarrow opens by address (file, hdfs, s3, gs). Spark lists no empty files.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    listed = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select("path", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for name in batch.column(0).to_pylist():
                # Spark writes file:/a b where addresses have file:///a%20b.
                system, inner = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", quote(name, safe="/:@")))
                digest = hashlib.sha256()
                with system.open_input_stream(inner) as stream:
                    while chunk := stream.read(_CHUNK):
                        digest.update(chunk)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], names=["path", "length", "sha256"])

    # The listing may be a single split; the reading is the work.
    spread = listed.repartition(spark.sparkContext.defaultParallelism * 4, "path")
    return spread.mapInArrow(run, "path string, length bigint, sha256 string")


# ---------------------------------------------------------------- export from a stream

def export_batches(path: str, every: int = 1):
    """``foreachBatch`` function that exports rows (dataset, batch, value) every ``every`` rounds, exactly once.

    Every micro-batch is kept under its number. A round whose number ends a group of ``every`` exports the rows of the whole
    group into a folder of its own and then writes its marker. A batch that runs again, after a failure or from an old
    checkpoint, replaces what it wrote before and nothing else; readers (``read_exports``) take only folders with a marker, so
    an export that broke off does not show. Rows after the last full group wait for it.
    """
    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.select("dataset", "batch", "value").write.mode("overwrite").parquet(f"{path}/kept/round={number}")
        if (number + 1) % every:
            return
        rounds = range(number + 1 - every, number + 1)
        schema = "dataset string, batch string, value string"
        rows = spark.read.schema(schema).parquet(*[f"{path}/kept/round={n}" for n in rounds])
        rows.write.mode("overwrite").partitionBy("dataset", "batch").text(f"{path}/exports/round={number}")
        written = spark.read.schema(schema).parquet(*[f"{path}/kept/round={n}" for n in rounds]).agg(F.count("*").alias("rows"))
        written.coalesce(1).write.mode("overwrite").parquet(f"{path}/markers/round={number}")

    return run


def read_exports(spark, path: str) -> DataFrame:
    """Rows of all finished exports: (round, dataset, batch, value)."""
    done = spark.read.schema("rows bigint, round bigint").parquet(f"{path}/markers").select("round").distinct()
    rows = spark.read.schema("value string, round bigint, dataset string, batch string").text(f"{path}/exports")
    # One row per export.
    return rows.join(F.broadcast(done), "round").select("round", "dataset", "batch", "value")


def class_ids(labels: DataFrame, taxonomy: Sequence[str] = (), order: str = "seq", item: str = "item_id") -> DataFrame:
    """Class id per normalised label: taxonomy order first, then by first appearance (item, seq)."""
    from labelloom.scale import ranked

    name = F.trim(F.regexp_replace(F.lower("label"), r"[\s_\-]+", " "))
    first = labels.groupBy(name.alias("name")).agg(F.min(F.struct(item, order)).alias("_f"))
    fixed = {t.lower().replace("_", " ").replace("-", " "): i for i, t in enumerate(taxonomy)}
    known = F.coalesce(*[F.when(F.col("name") == k, v) for k, v in fixed.items()], F.lit(None).cast("int")) if fixed else F.lit(
        None).cast("int")
    tagged = first.withColumn("_k", known)
    fresh = ranked(tagged.where("_k IS NULL"), [], [F.col("_f"), F.col("name")], "_r")
    return tagged.where("_k IS NOT NULL").select("name", F.col("_k").cast("bigint").alias("class_id")).unionByName(
        fresh.select("name", (F.col("_r") - 1 + len(fixed)).alias("class_id")))


def to_yolo_labels(labels: DataFrame, items: DataFrame, taxonomy: Sequence[str] = ()) -> DataFrame:
    """Detector label lines: class id and centre, width, height relative to the frame; (item_id, seq, line).

    A few classes hold all labels, so a join by name would take them to as many tasks; up to LISTED_KEYS class ids are broadcast.
    """
    from labelloom.scale import LISTED_KEYS

    name = F.trim(F.regexp_replace(F.lower("label"), r"[\s_\-]+", " "))
    ids = class_ids(labels, taxonomy)
    listed = ids.limit(LISTED_KEYS + 1).collect()
    if len(listed) <= LISTED_KEYS:
        ids = F.broadcast(labels.sparkSession.createDataFrame(listed, ids.schema))
    row = labels.withColumn("name", name).join(ids, "name").join(items.select("item_id", "width", "height"), "item_id")
    w, h = F.col("width"), F.col("height")
    return row.select("item_id", "annotator_id", "seq", F.format_string(
        "%d %.6f %.6f %.6f %.6f", F.col("class_id"), *[F.bround(v, 6) for v in (
            (F.col("x1") + F.col("x2")) / 2 / w, (F.col("y1") + F.col("y2")) / 2 / h,
            (F.col("x2") - F.col("x1")) / w, (F.col("y2") - F.col("y1")) / h)]).alias("line"))


# Instruction texts of the fine-tuning rows.
SYSTEM_TEXT = ("You are an object detection model. For each image, return a JSON array of objects with 'hazard_class' (string) "
               "and 'bounding_box' ([x1, y1, x2, y2] in pixel coordinates).")
USER_TEXT = "Detect all hazards in this image."


def to_chat_corpus(labels: DataFrame, key: str = "item_id", url: Column | None = None) -> DataFrame:
    """One fine-tuning conversation per labelled item, the labels as the JSON answer."""
    answer = F.struct("seq", F.col("label").alias("hazard_class"), F.array("x1", "y1", "x2", "y2").alias("bounding_box"))
    per = labels.groupBy(key).agg(F.array_sort(F.collect_list(answer)).alias("_a"))
    text = F.to_json(F.transform("_a", lambda e: F.struct(e["hazard_class"].alias("hazard_class"), e["bounding_box"].alias(
        "bounding_box"))))

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    image = url if url is not None else F.concat(F.lit("item:"), F.col(key).cast("string"))
    user = F.to_json(F.array(F.struct(F.lit("image_url").alias("type"), image.alias("value")),
                             F.struct(F.lit("text").alias("type"), F.lit(USER_TEXT).alias("value"))))
    messages = F.array(message("system", F.lit(SYSTEM_TEXT)), message("user", user), message("assistant", text))
    return per.select(key, F.size("_a").alias("labels"), text.alias("answer"), F.to_json(F.struct(messages.alias("messages"))).alias(
        "value"))
