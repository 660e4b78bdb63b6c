"""Near copies of the pipeline's stage against all pairs."""

import random

import corpus_pipeline
import pyarrow as pa
import pytest
from conftest import make
from labelloom.llm import nearcopies
from labelloom.llm.nearcopies import jaccard, shingle_set
from pyspark.sql import functions as F


def changed(rng, words, times):
    out = list(words)
    for i in rng.sample(range(len(out)), times):
        out[i] = f"new{rng.getrandbits(40)}"
    return out


def similarity(a, b):
    grams = [{tuple(t.lower().split()[i: i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b)]
    return len(grams[0] & grams[1]) / len(grams[0] | grams[1])


def walk(rows, least=0.8):
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if similarity(rows[i][1], rows[j][1]) >= least:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return sorted(min(rows[i][0] for i in range(len(rows)) if find(i) == r) for r in {find(i) for i in range(len(rows))})


def test_stage_drops_pairs_at_eight_tenths_and_keeps_those_below(spark):
    rng = random.Random(5)
    rows, n = [], 0
    for _ in range(30):
        words = [f"w{rng.randint(0, 3000)}" for _ in range(200)]
        for times in (0, rng.choice([1, 2, 3, 4]), rng.choice([6, 8, 10])):
            rows.append((n, " ".join(changed(rng, words, times)), "s"))
            n += 1
    for i, (_, a, _) in enumerate(rows[::9]):
        assert jaccard(shingle_set(a.encode()), shingle_set(rows[i][1].encode())) == similarity(a, rows[i][1])
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert sorted(r.doc_id for r in stage(spark, make(spark, rows), "").collect()) == walk(rows)


def test_large_groups_that_are_not_one_class(spark):
    rng = random.Random(6)
    common = [f"c{i}" for i in range(120)]
    # A passage in every document, so that bands collide all over; pairs of near copies, and one large class.
    rows = []
    for i in range(0, 80, 2):
        words = common + [f"w{rng.getrandbits(30)}" for _ in range(60)]
        rows += [(i, " ".join(words), "s"), (i + 1, " ".join(changed(rng, words, 2)), "s")]
    big = [f"b{i}" for i in range(150)]
    rows += [(100 + i, " ".join(changed(rng, big, 1)), "s") for i in range(40)]
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert sorted(r.doc_id for r in stage(spark, make(spark, rows), "").collect()) == walk(rows)


def joined(pairs, n):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in pairs:
        a, b = find(i), find(j)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_every_colliding_pair_is_linked(spark):
    """A dense group of near copies, some outside its main class, and documents that share most of their words but are no copies."""
    rng = random.Random(8)
    common = [f"c{i}" for i in range(150)]
    rows = [(i, " ".join(changed(rng, common, rng.choice([1, 2, 4, 7]))), "s") for i in range(150)]
    rows += [(1000 + i, " ".join(common[:130] + [f"x{rng.getrandbits(20)}" for _ in range(45)]), "s") for i in range(60)]
    sets = [nearcopies.shingle_set(t.encode()) for _, t, _ in rows]
    width, tables = 12, 3
    bits = [nearcopies.fingerprint_bits(x, 2)[:64 + width * tables] for x in sets]

    def far(i, j, lo, hi):
        return int((bits[i][lo:hi] != bits[j][lo:hi]).sum())

    meet = {(i, j) for i in range(len(rows)) for j in range(i) if far(i, j, 0, 64) <= nearcopies.CHECK_BITS and far(i, j, 0, 100) <= nearcopies.ALL_BITS * 100
            and any(far(i, j, 64 + t * width, 64 + (t + 1) * width) <= 2 for t in range(tables))}
    want = joined([(i, j) for i, j in meet if jaccard(sets[i], sets[j]) >= 0.8], len(rows))
    docs = make(spark, rows)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    nodes = nearcopies.shingle_nodes(docs, width, tables).groupBy("node", "check", "prints").agg(F.min(order).alias("first")).cache()
    classes = {}
    for r in nearcopies.near_links(nodes, docs, width, tables).join(nodes, "node").select("root", "first.id").collect():
        classes.setdefault(r.root, set()).add(r.id)
    expected = [{rows[i][0] for i, w in enumerate(want) if w == root} for root in set(want)]
    assert sorted(map(sorted, classes.values())) == sorted(sorted(c) for c in expected if len(c) > 1)


@pytest.mark.parametrize("block", [15_000])
def test_pairs_of_a_crowded_group_are_not_rows(spark, monkeypatch, block):
    """Copies of one text that are mostly a little less alike than asked: their pairs are compared in tasks, in blocks of any size."""
    rng = random.Random(11)
    base = [f"c{i}" for i in range(150)]
    rows = [(i, " ".join(changed(rng, base, rng.choice([2, 2, 2, 3]))), "s") for i in range(200)]
    # Two classes that only few of their members link, and texts of their own.
    for i in range(200, 240):
        words = list(base)
        words[20:20 + i % 4 * 6] = [f"d{i % 4}x{j}" for j in range(i % 4 * 6)]
        rows.append((i, " ".join(changed(rng, words, 1)), "s"))
    rows += [(i, " ".join(f"w{rng.getrandbits(30)}" for _ in range(100)), "s") for i in range(240, 260)]
    seen, stored = {}, nearcopies.stored

    def counted(df, name):
        out = stored(df, name)
        seen[name] = max(seen.get(name, 0), out.count())
        return out

    monkeypatch.setattr(nearcopies, "stored", counted)
    monkeypatch.setattr(nearcopies, "BLOCK", block, raising=False)
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert sorted(r.doc_id for r in stage(spark, make(spark, rows), "").collect()) == walk(rows)
    assert seen["near-pairs"] <= nearcopies.FIRST * len(rows)


def run_stream(rows, size, monkeypatch, **limits):
    """_collide over batches of ``size`` rows, each read as a chunk of its own, with smaller limits."""
    chunks = nearcopies._chunks
    monkeypatch.setattr(nearcopies, "_chunks", lambda batches: chunks(batches, 1))
    for name, value in limits.items():
        monkeypatch.setattr(nearcopies, name, value)
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i: i + size])], names=["key", "node", "check"]) for i in range(0, len(rows), size)]
    out = [r for b in nearcopies._collide(iter(batches)) for r in b.to_pylist()]
    monkeypatch.undo()
    return {(r["a"], r["b"]) for r in out if r["a"] is not None}, {(r["key"] >> 6, r["node"]) for r in out if r["key"] is not None}


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
def test_stream_of_collisions(monkeypatch, size):
    """In chunks of any size, each member meets the smallest near ones, and members of crowded groups are all handed on."""
    rng = random.Random(9)
    # Three kinds of check bits, far from each other; nodes of one kind are near.
    kinds = [0, 2**62 - 1, (2**31 - 1) << 32]
    sizes = [3, 9, 1, 60, 30]
    rows = sorted((g << 6 | 63, 1000 * g + i, kinds[rng.randrange(3) if g > 2 else 0]) for g, n in enumerate(sizes) for i in range(n))
    pairs, members = run_stream(rows, size, monkeypatch, NEAR=40, HEAD=4, PARTNERS=5)
    for g, n in enumerate(sizes):
        mine = [(node, check) for key, node, check in rows if key >> 6 == g]
        for seat, (node, check) in enumerate(mine):
            met = [m for m, c in (mine[:seat] if seat < 40 else mine[:4]) if c == check]
            assert sorted(a for a, b in pairs if b == node) == met[:5]
        handed = {node for k, node in members if k == g}
        assert handed == (set() if n <= 6 else {node for node, _ in mine}) or g == 4 and handed <= {node for node, _ in mine}
    # In the last group every kind is crowded as a whole.
    assert len({node for k, node in members if k == 4}) >= 28


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
def test_partners_of_a_set_are_on_its_rows(monkeypatch, size):
    """The pairs and members of the stream of collisions, with no more rows than were read."""
    rng = random.Random(12)
    kinds = [0, 2**62 - 1]
    # The same sets meet in several groups, small and crowded ones.
    rows = sorted((g << 6 | 63, 100 + i, kinds[i % 2]) for g, n in enumerate([2, 50, 6, 30, 1, 40]) for i in rng.sample(range(60), n))
    pairs, members = run_stream(rows, size, monkeypatch)
    chunks = nearcopies._chunks
    monkeypatch.setattr(nearcopies, "_chunks", lambda batches: chunks(batches, 1))
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i: i + size])], names=["key", "node", "check"]) for i in range(0, len(rows), size)]
    out = [r for b in nearcopies._gathered(iter(batches)) for r in b.to_pylist()]
    assert {(r["key"] >> 6, r["node"]) for r in out if r["key"] is not None} == members
    assert {(a, r["node"]) for r in out for a in r["full"] + r["plain"]} <= pairs
    for node in {b for _, b in pairs}:
        got = sorted({a for r in out if r["node"] == node for a in r["full"] + r["plain"]})
        assert got[:nearcopies.FIRST] == sorted(a for a, b in pairs if b == node)[:nearcopies.FIRST]
    if size >= len(rows):
        assert len(out) <= len(rows)


def test_rows_of_crowded_groups_are_made_once(spark, monkeypatch):
    """A set has at most one row per variant among the collisions, and its rows are compared by class in one join only."""
    rng = random.Random(13)
    base = [f"c{i}" for i in range(150)]
    rows = [(i, " ".join(changed(rng, base, rng.choice([2, 3, 4]))), "s") for i in range(250)]
    rows += [(i, " ".join(f"w{rng.getrandbits(30)}" for _ in range(60)), "s") for i in range(250, 260)]
    seen, joins, stored = {}, 0, nearcopies.stored

    def counted(df, name):
        nonlocal joins
        joins += df._jdf.queryExecution().optimizedPlan().toString().count("Join LeftSemi")
        seen[name] = stored(df, name)
        return seen[name]

    monkeypatch.setattr(nearcopies, "stored", counted)
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert sorted(r.doc_id for r in stage(spark, make(spark, rows), "").collect()) == walk(rows)
    width, tables = nearcopies.layout(len(rows))
    assert seen["collisions"].count() <= len(rows) * tables * (width + 1)
    assert joins == 1


def test_empty_texts_nulls_and_no_rows(spark):
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert stage(spark, make(spark, []), "").count() == 0
    rows = [(4, "", "s"), (3, None, "s"), (None, " ", "s"), (None, "a b c", "s"), (None, "A  b C", "t"), (7, "x y", "s"), (7, "x y", "s")]
    got = stage(spark, make(spark, rows), "").collect()
    assert sorted((r.doc_id for r in got), key=str) == [3, 7, None]
