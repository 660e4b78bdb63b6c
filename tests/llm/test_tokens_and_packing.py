"""Token segments and packing against plain encoding, and exact round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from conftest import make
from labelloom.llm.packing import CAPACITY, fullest, minimum_bin_slack, pack_documents
from labelloom.llm.token_output import pack_ids, pack_segment, token_output, unpack_ids, unpack_segment
from labelloom.llm.tokens import Encoder, tokenizer_path

TOK = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def plain(text, end):
    return np.array([*TOK.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab'st ,.\n\t\r é1２日　\x1c\x85<|endoftext|>", max_size=40), max_size=4))
def test_encoder_equals_library(texts):
    texts.append("".join(texts) + "<|endoftext|> x")
    got = Encoder.shared(tokenizer_path()).batch(texts)
    assert got == [plain(t, 0)[:-1].tobytes() for t in texts]


def test_other_tokenizer_is_encoded_whole():
    path = public_tokenizers.path("word_bpe_49k.json")
    want = Tokenizer.from_file(path).encode("Some words here", add_special_tokens=False).ids
    assert np.frombuffer(Encoder(path).batch(["Some words here"])[0], "<u4").tolist() == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 3) | st.integers(0, 60_000), max_size=700))
def test_blocks_round_trip(ids):
    a = np.array(ids, dtype=np.uint32)
    assert unpack_ids(pack_ids(a), len(a)).tolist() == ids


def test_blocks_use_exceptions_and_index():
    a = np.full(256, 7, dtype=np.uint32)
    a[5], a[200] = 2**31, 2**20
    data = pack_ids(a)
    assert len(data) < 80 and unpack_ids(data, 256).tolist() == a.tolist()
    assert np.frombuffer(data, "<u4", 3, 4).tolist() == [0, 11, 22]


def test_segment_round_trip():
    ids = [np.array(x, dtype="<u4").tobytes() for x in ([1, 2, 3], [], [9])]
    doc_ids, counts, stream = unpack_segment(pack_segment([None, 4, 5], ids))
    assert (doc_ids, counts.tolist(), stream.tolist()) == ([None, 4, 5], [3, 0, 1], [1, 2, 3, 9])
    with pytest.raises(ValueError):
        unpack_segment(b"none")


def test_token_output_on_edges(edge_docs, edge_rows):
    got = token_output(edge_docs).collect()
    assert len(got) == len(edge_rows)
    want = sorted(((i is not None, i or 0), zlib.crc32(plain(t, 2).tobytes()), len(plain(t, 2))) for i, t, _ in edge_rows)
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.ids_crc32, r.n_tokens) for r in got) == want
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_fullest_is_best():
    rng = random.Random(5)
    for _ in range(300):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(0, 5))}
        room = rng.randint(0, 60)
        sums = {0}
        for n, c in counts.items():
            sums |= {s + n * k for s in sums for k in range(c + 1) if s + n * k <= room}
        chosen = fullest(counts, room)
        assert sum(n * k for n, k in chosen.items()) == max(sums)
        assert all(k <= counts[n] for n, k in chosen.items())


def test_plan_uses_every_piece_once():
    histogram = {2048: 5, 2000: 3, 1000: 7, 48: 4, 24: 9, 1: 3}
    plan = minimum_bin_slack(histogram)
    used = {n: sum(p.get(n, 0) * bins for p, bins in plan) for n in histogram}
    assert used == histogram
    assert all(sum(n * k for n, k in p.items()) <= CAPACITY for p, _ in plan)
    assert sum(b for _, b in plan) == -(-sum(n * c for n, c in histogram.items()) // CAPACITY)


def check_packing(got, docs):
    assert sum(r.length for r in got) == sum(len(plain(t, 0)) for _, t, _ in docs)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.piece == 0 or r.length == CAPACITY
    for parts in bins.values():
        parts.sort()
        assert [p[0] for p in parts] == np.cumsum([0, *(p[1] for p in parts)])[:-1].tolist()
        assert sum(p[1] for p in parts) <= CAPACITY
    return len(bins)


def test_packing_on_edges(edge_docs, edge_rows):
    got = pack_documents(edge_docs).collect()
    bins = check_packing(got, edge_rows)
    assert bins == -(-sum(r.length for r in got) // CAPACITY)
    ids = {(i, t): plain(t, 0) for i, t, _ in edge_rows if i in (6, 8)}
    for (i, _), a in ids.items():
        mine = sorted((r.start, r.length, r.ids_crc32) for r in got if r.doc_id == i)
        assert mine[0][1] == len(a) - CAPACITY * (len(mine) - 1)
        assert all(zlib.crc32(a[s: s + n].tobytes()) == c for s, n, c in mine)


def test_empty_tables(spark):
    docs = make(spark, [])
    assert token_output(docs).count() == 0 and pack_documents(docs).count() == 0
