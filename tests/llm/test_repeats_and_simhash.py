"""Substring dedup and SimHash classes against direct walks."""

import random

import numpy as np
import pytest
import xxhash

from conftest import make
from labelloom.llm.common import components
from labelloom.llm.repeats import cover_repeats
from labelloom.llm.simhash import balls, drop_near_duplicates, fingerprint, link_bucket, linear_code, links, near_duplicate_classes

LAST = 2**63 - 1


def walk_repeats(rows, depth):
    """(doc_id, text) -> kept words, by a dictionary of all windows."""
    first = {}
    docs = [(LAST if i is None else i, (t or "").encode().split(), i, t) for i, t, _ in rows]
    for i, w, _, _ in docs:
        for p in range(len(w) - depth + 1):
            k = tuple(w[p: p + depth])
            first[k] = min(first.get(k, (LAST, LAST)), (i, p))
    out = []
    for i, w, doc_id, text in docs:
        gone = set()
        for p in range(len(w) - depth + 1):
            if first[tuple(w[p: p + depth])] < (i, p):
                gone.update(range(p, p + depth))
        out.append((doc_id, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out


def key(row):
    return row[0] is None, row[0] or 0, row[1:]


def found(docs, **options):
    return [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in cover_repeats(docs, **options).collect()]


@pytest.mark.parametrize("depth,cell_bytes", [(20, 6_000_000), (20, 400), (6, 300), (9, 700)])
def test_repeats_equal_a_walk(spark, depth, cell_bytes):
    rng = random.Random(depth + cell_bytes)
    vocabulary = [f"w{i}" for i in range(40)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 45))] for _ in range(6)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 15))]
        rows.append((rng.choice([i, i, 100 - i, None]), rng.choice([" ", "\n", "\t "]).join(words), "s"))
    rows += [(500, " ".join(["same"] * 90), "s"), (501, " ".join(["same"] * 25), "s"), (502, " ".join(["a", "b"] * 30), "s"), rows[3], rows[3]]
    assert sorted(found(make(spark, rows), depth=depth, cell_bytes=cell_bytes), key=key) == sorted(walk_repeats(rows, depth), key=key)


def test_repeats_on_edges(edge_docs, edge_rows):
    assert sorted(found(edge_docs, cell_bytes=100_000), key=key) == sorted(walk_repeats(edge_rows, 20), key=key)


def test_repeats_spans_and_empty(spark):
    assert cover_repeats(make(spark, [])).count() == 0
    words = [f"v{i}" for i in range(30)]
    rows = [(1, " ".join(words), "s"), (2, "x " + " ".join(words[5:]) + " y", "s")]
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in cover_repeats(make(spark, rows)).collect()}
    assert got == {1: [], 2: [(1, 26)]}


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i: i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    for text in ("", "a", "A b", "the Quick brown fox", "x y z " * 50, "Ä Ö ü é ñ"):
        assert fingerprint(text.encode()) & (2**64 - 1) == slow_fingerprint(text)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_links_find_all_and_only_near_pairs(spark, radius):
    rng = random.Random(radius)
    fps = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(4):
            x = base
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    group = {f: f for f in fps}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i:]:
            if (a ^ b).bit_count() <= radius:
                group[find(b)] = find(a)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    edges = links(spark.createDataFrame([(s,) for s in signed], "fp long"), radius)
    got = {r.node % 2**64: r.root % 2**64 for r in components(edges).collect()}
    classes = {}
    for f in fps:
        classes.setdefault(find(f), set()).add(f)
    mine = {}
    for f in fps:
        mine.setdefault(got.get(f, f), set()).add(f)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, mine.values()))


def test_bucket_members_are_within_the_radius():
    codes, even, odd = balls(3, 10)
    fps = np.array([0b1, 0b1110, 0b0, 2**63], dtype=np.uint64)
    for bucket in range(1024):
        a, b = link_bucket(bucket, fps, codes, even, odd, 3)
        assert set(np.r_[a, b].tolist()) <= set(fps.tolist())
    assert linear_code(np.array([3], np.uint64), codes)[0] == codes[0] ^ codes[1]


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60) if i % 10 != 9] + [(rng.randint(70, 99), rng.randint(70, 99)) for _ in range(25)] + [(100, x) for x in range(101, 130)] + [(5, 5), (None, 3), (200, 200)]
    group = {}

    def find(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            group[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in group}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_classes_and_dropping_on_edges(spark, edge_docs, edge_rows):
    got = near_duplicate_classes(edge_docs).collect()
    prints = {i: slow_fingerprint(t) for i, t, _ in edge_rows}
    assert len(got) == len(edge_rows)
    for r in got:
        if r.doc_id is not None:
            assert r.fingerprint == f"{prints[r.doc_id]:016x}"
            near = [i for i, f in prints.items() if i is not None and (f ^ prints[r.doc_id]).bit_count() <= 3]
            assert r.component_id <= min(near)
    kept = drop_near_duplicates(edge_docs)
    assert kept.columns == edge_docs.columns
    rows = kept.collect()
    named = {r.doc_id: r.component_id for r in got}
    ids = [r.doc_id for r in rows if r.doc_id is not None]
    assert sorted(ids) == sorted({c for i, c in named.items() if i is not None})
    assert {r._size for r in rows} == {-2}
    assert near_duplicate_classes(make(spark, [])).count() == 0 and drop_near_duplicates(make(spark, [])).count() == 0
