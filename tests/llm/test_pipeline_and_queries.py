"""The pipeline against its stages by hand, the registered queries against their SQL, and the registration itself."""

import os
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from conftest import make  # noqa: E402
from harness import compare, connect  # noqa: E402
from labelloom.llm import pii, toxicity  # noqa: E402
from labelloom.llm.mixing import mix_table  # noqa: E402
from labelloom.llm.packing import minimum_bin_slack  # noqa: E402
from labelloom.llm.queries import ORACLES, QUERIES  # noqa: E402
from test_tokens_and_packing import check_packing, plain  # noqa: E402

PATH = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twin(spark, name):
    ok, note = compare(spark, connect(PATH), name, QUERIES[name], ORACLES[name], PATH)
    assert ok, note


def test_names():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(re.match(rf"op{n}_", x) for x in names) for n in range(1, 14)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixing", "packing"]


def five_word_shingles(text):
    """The set of five-word shingles, A-Z in lower case; a shorter text is one shingle."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_pipeline_by_hand(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    model = toxicity.train_model(docs, spark.read.parquet(f"{PATH}/labels.parquet"))
    score = toxicity.Scorer(model)
    left = [r for r in rows if score([(r.text or "").encode()])[0] < 0.5]
    grams = {r.doc_id: five_word_shingles(r.text or "") for r in left}
    group = {i: i for i in grams}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in grams:
        for b in grams:
            if a < b and 10 * len(grams[a] & grams[b]) >= 8 * len(grams[a] | grams[b]):
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    left = [(r.doc_id, pii.redact(r.text, pii.find_spans(r.text)[1]), r.source) for r in left if find(r.doc_id) == r.doc_id]
    times = {r.doc_id: r.taken // r.size for r in mix_table(make(spark, left)).collect() if r.size}
    mixed = [x for x in left for _ in range(times.get(x[0], 0))]
    got = corpus_pipeline.run(spark, PATH).collect()
    check_packing(got, mixed)
    want = Counter((i, zlib.crc32(a.tobytes())) for i, a in ((i, plain(t, 0)) for i, t, _ in mixed) if len(a) <= 2048)
    assert Counter((r.doc_id, r.ids_crc32) for r in got if r.piece == 0 and (r.doc_id, r.ids_crc32) in want) == want
    bins = len({r.sequence_id for r in got})
    assert bins == sum(n for _, n in minimum_bin_slack(Counter(r.length for r in got))) <= -(-sum(r.length for r in got) // 2048) + 1


def test_stages_keep_columns_on_edges(spark, edge_docs, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now = edge_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == edge_docs.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() > 0
    empty = make(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_queries_read_ids_back(spark):
    lengths = np.array([len(plain(r.text, 2)) for r in sorted(spark.read.parquet(f"{PATH}/documents.parquet").collect(), key=lambda r: r.doc_id)])
    got = sorted(QUERIES["op1_token_output"](spark, PATH).collect(), key=lambda r: r.doc_id)
    assert [r.start for r in got] == (np.cumsum(lengths) - lengths).tolist()
