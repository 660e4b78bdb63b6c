"""Steps whose cost must not grow faster than the input: shuffles, groups per task, values computed once."""

import random

import numpy as np
import pytest

from labelloom import scale
from labelloom.functions import geometry as G
from labelloom.operators import match, prepare, score
from labelloom.sources import sinks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def plain_joins(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_clean_polygon_reads_its_polygon_once(spark):
    from pyspark.sql import functions as F

    assert str(G.clean_polygon(F.col("marker"))).count("marker") == 1
    rows = [(0, None), (1, []), (2, [(1.0, 1.0), (1.0, 1.0), None, (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)]), (3, [(1.0, 1.0), (2.0, 1.0)]),
            (4, [(0.0, 0.0), (0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)])]
    df = spark.createDataFrame(rows, f"k int, polygon {G.POINTS}").selectExpr("*", "0D AS x1", "0D AS y1", "10D AS x2", "20D AS y2")
    got = {r.k: [tuple(p) for p in r.c] for r in df.select("k", G.clean_polygon(F.col("polygon")).alias("c")).collect()}
    assert got[4] == [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)]
    assert len(got[0]) == 8 and got[0] == got[1] == got[3] and got[0][0] == (9.5, 10.0)
    # A point behind a missing one is dropped with it, as before.
    assert got[2] == [(1.0, 1.0), (2.0, 2.0)] or len(got[2]) == 8


def test_label_lines_are_not_dealt_by_name(spark, plain_joins):
    labels = spark.createDataFrame([(1, 7, 1, "Field", 0.0, 0.0, 10.0, 10.0), (1, 7, 2, "tree", 0.0, 0.0, 20.0, 10.0), (2, 8, 3, "bush", 0.0, 0.0, 10.0, 10.0)],
                                   "item_id bigint, annotator_id bigint, seq bigint, label string, x1 double, y1 double, x2 double, y2 double")
    items = spark.createDataFrame([(1, 100, 100), (2, 100, 100)], "item_id bigint, width int, height int")
    got = sinks.to_yolo_labels(labels, items, ["Field"])
    assert "BroadcastHashJoin [name" in plan(got) and "hashpartitioning(name" not in plan(got)
    assert [r.line.split()[0] for r in got.orderBy("seq").collect()] == ["0", "1", "2"]


def test_spectral_shuffle_carries_colours_only(spark, plain_joins):
    px = spark.createDataFrame([(1, x, y, x, y, 3) for x in range(4) for y in range(130)], "item_id bigint, x int, y int, r int, g int, b int")
    boxes = spark.createDataFrame([(1, 0, 0.0, 0.0, 3.0, 130.0)], "item_id bigint, seq int, x1 double, y1 double, x2 double, y2 double")
    got = score.spectral_stats(px, boxes)
    text = plan(got)
    assert "hashpartitioning(item_id" in text and "_band" in text
    # The sort before the window is the only one between the shuffle of pixels and the sums.
    assert "587.0" not in text[text.index("REPARTITION_BY_COL"):]
    assert got.first().n_pixels == 390 and got.first().mean_exg == pytest.approx(2 * 64.5 - 1 - 3)


def test_tasks_follow_the_rows(spark):
    assert scale.dealt(spark.range(1000), ["id"], 10).rdd.getNumPartitions() == 100
    boxes = spark.createDataFrame([(i % 3, float(i), 0.0, float(i + 2), 1.0) for i in range(30)], "item_id bigint, x1 double, y1 double, x2 double, y2 double")
    text = plan(match.union_area(boxes))
    assert "REPARTITION_BY_NUM" in text and "hashpartitioning(item_id" in text
    assert {r.item_id: r.union_area for r in match.union_area(boxes).collect()} == {0: 20.0, 1: 20.0, 2: 20.0}


def test_fold_groups_keeps_groups_whole(spark):
    import pyarrow as pa

    def sums(table, starts):
        return pa.table([table.column("k").take(pa.array(starts)), pa.array(np.add.reduceat(table.column("v").to_numpy(), starts))], names=["k", "s"])

    data = [(None if i % 17 == 0 else i % 17, i) for i in range(1000)]
    df = spark.createDataFrame(data, "k int, v bigint")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.k: r.s for r in scale.fold_groups(df, ["k"], ["v"], sums, "k int, s bigint", rows=20).collect()}
        none = scale.fold_groups(df.limit(0), ["k"], ["v"], sums, "k int, s bigint").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {k: sum(v for x, v in data if x == k) for k in {x for x, _ in data}} and none == []


def test_merge_of_many_items_in_step():
    rng = np.random.default_rng(5)
    for threshold in (0.05, 0.2, 0.6):
        sizes = rng.integers(1, 40, 60)
        starts = np.cumsum(sizes) - sizes
        low = rng.integers(0, 60, (sizes.sum(), 2)).astype(float)
        boxes = np.c_[low, low + rng.integers(0, 40, low.shape)]
        boxes[::97] = np.nan
        counts = rng.integers(1, 5, len(boxes))
        owner, found, sums = match._merge_groups(boxes, counts, starts, threshold)
        for i, (a, n) in enumerate(zip(starts, sizes)):
            want = sorted(map(str, match._merge_group(boxes[a:a + n], counts[a:a + n], threshold)))
            assert sorted(str((*map(float, b), int(s))) for b, s in zip(found[owner == i], sums[owner == i])) == want


def test_small_items_cluster_like_large_ones(spark):
    rng = random.Random(9)
    pts = [(k, float(rng.randrange(300)), float(rng.randrange(300)) + rng.choice([0.0, 0.5])) for k in range(12) for _ in range(10 * k + 1)]
    pts += [(None, 5.0, 5.0), (None, 6.0, 6.0), (3, None, 4.0), (3, -1e9, 1e9), (4, 50.0, 50.0), (4, 50.0, 50.0)]
    df = spark.createDataFrame(pts, "item_id bigint, x double, y double")
    whole = prepare._joined_clusters(df, 22.0, "item_id")
    small = prepare.cluster_points(df, 22.0, margin=0.0)
    assert sorted(map(str, (r.n for r in small.collect()))) == sorted(map(str, (r.n for r in whole.collect())))
    assert "ArrowEvalPython" not in plan(small) and "MapInArrow" in plan(small)


def test_averages_read_and_write_their_state_once():
    import pandas as pd

    from labelloom.streaming import jobs

    class Store:
        value, reads, writes = None, 0, 0

        def getValueState(self, *_):
            return self

        def get(self):
            self.reads += 1
            return self.value

        def update(self, value):
            self.writes, self.value = self.writes + 1, value

    store, averages = Store(), jobs._Averages(0.25, 3, None)
    averages.init(store)
    out = [pd.concat(averages.handleInputRows((7,), iter([pd.DataFrame({"round": [n], "reward": [0.8], "reset": [False]})]), None)) for n in (1, 2, 9, 4)]
    assert (store.reads, store.writes) == (4, 4)
    assert out[1].ema.tolist() == pytest.approx([0.2, 0.35]) and out[3].late.tolist() == [True, False]
