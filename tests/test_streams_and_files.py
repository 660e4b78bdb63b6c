"""Streams over several batches, and reading and writing files."""

import hashlib
import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from labelloom.operators.validate import check_export_schema, validate_selection_plan
from labelloom.operators.evaluate import evaluate_gates, round_metrics
from labelloom.sources import readers, sinks
from labelloom.streaming import jobs


def test_score_state_over_batches(spark, tmp_path):
    schema = "annotator_id bigint, round int, reward double, reset boolean"
    # The rounds of annotator 1 arrive out of order.
    batches = [[(1, 2, 1.0, False), (2, 1, 1.0, False)], [(1, 1, .4, False)], [(2, 4, .5, False), (1, 4, None, True)]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rounds = jobs.newest(jobs.drain(jobs.score_stream(stream), "t", "update"), ["annotator_id", "round"])
    path = jobs.score_path(rounds).cache()
    got = {(r.annotator_id, r["round"]): r for r in path.collect()}
    assert abs(got[1, 2].ema - (.25 + .75 * .1)) < 1e-9 and abs(got[1, 2].delta - .6) < 1e-9
    assert abs(got[2, 4].ema - (.125 + .75 * .25 * .75 ** 2)) < 1e-9
    # A reset leaves a row of zero, so the old value does not survive an annotator who stays away.
    assert (got[1, 4].ema, got[1, 4].delta) == (0.0, 0.0)
    assert {r.annotator_id: r.ema for r in jobs.ema_asof(path, 9).collect()}[1] == 0.0


def test_averages_as_keyed_state(spark, tmp_path):
    """Out-of-order rounds inside the open ones give what the fold over all rows gives; older ones come out as late and change nothing."""
    schema = "annotator_id bigint, round int, reward double, reset boolean"
    batches = [[(1, 2, 1.0, False), (2, 1, 1.0, False)], [(1, 1, .4, False), (1, 1, .3, False)], [(2, 4, .5, False), (1, 4, None, True), (1, 9, .8, False)],
               [(1, 3, 9.0, False), (1, 8, None, False), (2, 3, .2, False)]]
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = jobs.drain(jobs.score_averages(stream, open_rounds=3), "avg", "update", jobs.ROCKSDB).cache()
    assert [(r.annotator_id, r["round"], r.reward) for r in out.where("late").collect()] == [(1, 3, 9.0)]
    got = jobs.newest(out.where("NOT late").drop("late"), ["annotator_id", "round"]).collect()
    flat = [r for b in batches for r in b if r != (1, 3, 9.0, False)]
    want = jobs.score_path(jobs.score_stream(spark.createDataFrame(flat, schema))).collect()
    assert {(r.annotator_id, r["round"]): (round(r.ema, 12), round(r.delta, 12)) for r in got} == {(r.annotator_id, r["round"]): (round(r.ema, 12), round(r.delta, 12)) for r in want}


def test_rows_behind_are_handed_on(spark):
    t = datetime(2024, 1, 1)
    kept, behind = [], []
    route = jobs.split_behind("ts", "2 hours", lambda df, n: kept.extend(r.h for r in df.collect()), lambda df, n: behind.extend(r.h for r in df.collect()))
    for number, hours in enumerate([[0, 5], [4, 2, 9], [], [8, 6]]):
        route(spark.createDataFrame([(t + timedelta(hours=h), h) for h in hours], "ts timestamp, h int"), number)
    assert sorted(kept) == [0, 4, 5, 8, 9] and sorted(behind) == [2, 6]


def test_exports_of_rounds_happen_once(spark, tmp_path):
    path = str(tmp_path / "out")
    run = sinks.export_batches(path, 2)
    batch = {n: spark.createDataFrame([("d", f"b{n % 2}", f"{n}-{i}") for i in range(n + 1)], "dataset string, batch string, value string") for n in range(5)}
    for n in (0, 1, 1, 2, 3, 3, 4):
        run(batch[n], n)
    # Another run of an exported round with other rows replaces its rows and no others.
    run(batch[1].limit(1), 1)
    got = {(r["round"], r.value) for r in sinks.read_exports(spark, path).collect()}
    assert got == {(1, "0-0"), (1, "1-0")} | {(3, f"{n}-{i}") for n in (2, 3) for i in range(n + 1)}
    assert sinks.read_exports(spark, path).count() == len(got)


def test_digests_of_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "_CHUNK", 1000)
    files = {"a.bin": b"", "b c.bin": bytes(range(256)) * 40, "sub/d.bin": b"x"}
    (tmp_path / "sub").mkdir()
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {(r.length, r.sha256) for r in sinks.digest_files(spark, str(tmp_path)).collect()}
    assert got == {(len(d), hashlib.sha256(d).hexdigest()) for d in files.values() if d}


def test_a_forged_cap_is_recomputed(spark):
    """A plan that claims the same wrong cap everywhere is found, as the caps come from the shares."""
    images = spark.createDataFrame([(i,) for i in range(10)], "item_id bigint")
    plan = spark.createDataFrame([(i, 1 if i < 7 else 2, True) for i in range(10)], "item_id bigint, annotator_id bigint, quality_accepted boolean")
    candidates = plan.select("item_id", "annotator_id")
    slots = spark.createDataFrame([(1, 7, 7), (2, 3, 3)], "annotator_id bigint, cap bigint, claimed_cap bigint")
    shares = spark.createDataFrame([(1, 0.5), (2, 0.5)], "annotator_id bigint, share double")
    assert validate_selection_plan(plan, candidates, slots, images).count() == 0
    got = {(r.violation, r.annotator_id) for r in validate_selection_plan(plan, candidates, slots, images, shares).collect()}
    assert got == {("over_cap", 1), ("forged_cap", 1), ("forged_cap", 2)}


def test_expired_objects(spark, tmp_path):
    start = datetime(2024, 1, 1)
    schema = "key string, bytes bigint, modified timestamp"
    for hours in (0, 1, 5):
        spark.createDataFrame([(f"k{hours}", 10 + hours, start + timedelta(hours=hours))], schema).coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    gone = {r.key for r in jobs.drain(jobs.expire_objects(stream, 2.0), "expire", "append").collect()}
    assert gone == {"k0", "k1"}


def test_late_writes_keep_an_object(spark, tmp_path):
    """A write that arrives out of order within the delay is not dropped."""
    start = datetime(2024, 1, 1)
    schema = "key string, bytes bigint, modified timestamp"
    for key, minutes in (("a", 0), ("b", 170), ("a", 150), ("c", 400), ("d", 401)):
        spark.createDataFrame([(key, minutes, start + timedelta(minutes=minutes))], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    gone = {r.key: r.bytes for r in jobs.drain(jobs.expire_objects(stream, 2.0, "1 hour"), "late", "append").collect()}
    assert gone["a"] == 150 and gone["b"] == 170


def test_old_receipts_leave_the_newer_latest(spark, tmp_path):
    path = str(tmp_path / "r")
    for number in (3, 2):
        sinks.write_receipts(spark.createDataFrame([("h", number, number / 10)], "identity string, round int, score double"), path)
    got = {r.slot: json.loads(r.value)["round"] for r in spark.read.text(path).collect()}
    assert got == {"round_3": 3, "round_2": 2, "latest": 3}


def test_unknown_and_far_answers_come_out(spark):
    t = datetime(2024, 1, 1)
    tasks = spark.createDataFrame([(1, t)], "task_id int, started timestamp")
    answers = spark.createDataFrame([(1, t), (1, t + timedelta(days=30)), (2, t)], "task_id int, arrived timestamp")
    got = sorted((r.task_id, r.known, r.late) for r in jobs.response_window(tasks, answers).collect())
    assert got == [(1, True, False), (1, True, True), (2, False, True)]


def test_deadline_is_exclusive(spark):
    t = datetime(2024, 1, 1)
    tasks = spark.createDataFrame([(1, t)], "task_id int, started timestamp")
    got = jobs.response_window(tasks, spark.createDataFrame(
        [(1, t + timedelta(seconds=599)), (1, t + timedelta(seconds=600))], "task_id int, arrived timestamp"))
    assert [r.late for r in got.orderBy("arrived").collect()] == [False, True]


def test_every_nth():
    seen = []
    run = jobs.every_nth(3, lambda df, n: seen.append(n))
    for n in range(7):
        run(None, n)
    assert seen == [0, 3, 6]


LOG = """2024-05-01 10:00:00.000 \x1b[34mINFO\x1b[0m event=dual_flywheel_round_start step=1 sampled_uids=[1, 2, 3]
2024-05-01 10:01:00.000 INFO event=dataset_assembled images=6 unique_winners=2
2024-05-01 10:02:00.000 INFO event=dual_flywheel_round_done step=1 uids=3 winners=2 rewards=[0.5, 0.5]
2024-05-01 10:10:00.000 INFO event=dual_flywheel_round_start step=2 sampled_uids=[1, 2]
2024-05-01 10:11:00.000 INFO event=dataset_assembled images=4 unique_winners=1
2024-05-01 10:13:00.000 INFO event=dual_flywheel_round_done step=2 uids=2 winners=1 rewards=[0.25, 0.75]
2024-05-01 10:14:00.000 INFO nothing"""


def test_round_log(spark, tmp_path):
    (tmp_path / "v.log").write_text(LOG)
    m = round_metrics(readers.read_round_log(spark, str(tmp_path / "v.log"))).cache()
    row = m.first()
    assert (row.round_starts, row.round_dones, row.success_pct, row.max_images, row.reward_cv) == (2, 2, 100.0, 6, 0.0)
    assert row.avg_seconds == 150.0 and row.invocations == 5
    assert all(r.passed for r in evaluate_gates(m).collect())


def test_submission_files(spark, tmp_path):
    good = {"task_id": "t", "batch_id": "b", "round_num": 3, "records": [
        {"image_id": "i", "annotations": [{"hazard_class": "tree", "bounding_box": [1, 2, 3, 4], "polygon": [[1, 2], [3, 2], [3, 4]]}]},
        {"image_id": "j", "annotations": []}]}
    lines = [json.dumps(good), json.dumps({**good, "records": "no list"}), "{not json"]
    (tmp_path / "s.jsonl").write_text("\n".join(lines))
    rows, bad = readers.read_submissions(spark, str(tmp_path / "s.jsonl"))
    got = rows.collect()
    assert {(r.item_id, r.seq) for r in got} == {("i", 0), ("j", None)} and bad.count() == 2
    assert [r for r in got if r.item_id == "i"][0].polygon[1].x == 3.0


def test_points_and_coco_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text("x,y\n1,2\nfoo,3\n900,5\n")
    assert readers.read_points(spark, str(tmp_path / "p.csv"), 500, 500).count() == 1
    doc = {"images": [{"id": 1, "file_name": "a", "width": 9, "height": 9}], "categories": [{"id": 2, "name": " Big Dog"}],
           "annotations": [{"image_id": 1, "category_id": 2, "iscrowd": 0, "bbox": [0.5, 1.5, 2, 3]},
                           {"image_id": 1, "category_id": 2, "iscrowd": 1, "bbox": [0, 0, 2, 3]}]}
    (tmp_path / "m.json").write_text(json.dumps(doc))
    row = readers.read_coco(spark, str(tmp_path / "m.json")).collect()
    assert len(row) == 1 and (row[0].label, row[0].x1, row[0].y1, row[0].y2) == ("big_dog", 0.0, 2.0, 4.0)


def test_step_files_keep_the_last(spark, tmp_path):
    for step, v in ((1, 1.0), (2, 2.0)):
        (tmp_path / f"step-{step}.jsonl").write_text(json.dumps({"image_id": "a", "score": v}) + "\n")
    got = readers.read_step_files(spark, str(tmp_path / "step-*.jsonl"), "image_id string, score double").collect()
    assert [(r.item_id, r.score) for r in got] == [("a", 2.0)]


def test_export_round_trip(spark, tmp_path):
    items = spark.createDataFrame([(1, "d", "batch_1", "m", "w", 0.9, 5, "a.jpg", 10, 10, "t")],
                                  "item_id int, dataset string, batch string, method string, window string, score double, chosen int, "
                                  "image_name string, width int, height int, timestamp string")
    items = items.withColumn("contributions", F.create_map(F.lit("5"), F.lit(1.0))).withColumn("thresholds", F.create_map(F.lit("c"), F.lit(0.9)))
    objects = spark.createDataFrame([(1, "c0", "tree", "medium", 0.9, [("tree", 0.9)], 1., 1., 5., 5., 1.0)],
                                    "item_id int, cluster_id string, label string, severity string, confidence double, "
                                    "posterior array<struct<label:string,p:double>>, f_x1 double, f_y1 double, f_x2 double, f_y2 double, mean_iou double")
    votes = spark.createDataFrame([(1, "c0", 5, "k", "tree", "medium", 0.5, 1., 1., 5., 5.)],
                                  "item_id int, cluster_id string, annotator_id int, identity string, label string, severity string, "
                                  "weight double, x1 double, y1 double, x2 double, y2 double")
    rows = sinks.export_records(items, objects, votes, "https://h", "1.0")
    path = str(tmp_path / "out")
    for _ in range(2):
        sinks.export_dataset(rows, path)
    back = spark.read.text(path)
    assert back.count() == 1
    doc = json.loads(back.first().value)
    assert doc["objects"][0]["miner_votes"][0]["miner_uid"] == 5 and doc["image_id"] == "1"
    assert check_export_schema(back.withColumn("k", F.lit(1)), "k").collect() == []
    broken = back.withColumn("value", F.replace("value", F.lit('"score":0.9'), F.lit('"score":1.0'))).withColumn("k", F.lit(1))
    assert [r.error for r in check_export_schema(broken, "k").collect()] == ["audit_hash_mismatch"]


def test_receipts_and_digests(spark, tmp_path):
    rows = spark.createDataFrame([("h", 1, .5), ("h", 2, .6)], "identity string, round int, score double")
    sinks.write_receipts(rows, str(tmp_path / "r"))
    got = spark.read.text(str(tmp_path / "r"))
    assert got.count() == 3 and got.where("slot = 'latest'").first().value.endswith('"score":0.6}')
    (tmp_path / "f.bin").write_bytes(b"abc")
    digest = sinks.digest_files(spark, str(tmp_path / "f.bin")).first().sha256
    assert digest == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
