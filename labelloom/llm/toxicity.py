"""Toxicity by compression distance: a text is toxic if a dictionary of toxic text compresses its windows better.

Two zstandard dictionaries share a trained body of ordinary text; in front of it one holds
what was trained on toxic text, the other what was trained on more ordinary text. The toxic samples are the
words of toxic documents that few ordinary documents have, in their order, since the rest of a toxic document is ordinary. A window
of a few words gains bytes under the toxic dictionary where it repeats toxic strings. Document scores come from the largest
gains, the mean gain and the share of windows over a threshold calibrated on held-back ordinary windows, by logistic regression.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import map_batches, text_bytes

WINDOW = 8
BODY_BYTES, FRONT_BYTES = 32_768, 2_048
# Labelled rows the model is fitted on, at most: toxic, ordinary, and characters of one of them.
TOXIC_ROWS, ORDINARY_ROWS, ROW_CHARS = 3_000, 9_000, 8_000
# A word is toxic if so many times more toxic than ordinary documents have it.
ODDS = 15
FOLDS = 3
# Share of ordinary windows that may reach the threshold.
FALSE_WINDOWS = 0.005


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    threshold: int
    center: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]


def windows(text: bytes) -> list[bytes]:
    """The distinct windows of WINDOW words; lower case in A-Z."""
    words = text.lower().split()
    return list(dict.fromkeys(b" " + b" ".join(words[i: i + WINDOW]) + b" " for i in range(0, len(words), WINDOW)))


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    # Short matches count, and frames carry nothing but the blocks, so that single bytes show.
    params = zstandard.ZstdCompressionParameters(
        window_log=17, chain_log=16, hash_log=16, search_log=4, min_match=4, strategy=zstandard.STRATEGY_LAZY,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False)
    data.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=params)


def train(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary; samples too few to train on are the dictionary themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def gains(text: bytes, toxic: zstandard.ZstdCompressor, ordinary: zstandard.ZstdCompressor) -> np.ndarray:
    """Bytes each window saves under the toxic dictionary."""
    return np.array([len(ordinary.compress(w)) - len(toxic.compress(w)) for w in windows(text)], dtype=np.float64)


def features(gain: np.ndarray, threshold: int) -> list[float]:
    if not len(gain):
        return [0.0] * 5
    top = np.sort(gain)[::-1][:2]
    return [top[0], top.mean(), gain.mean(), (gain >= threshold).mean(), math.log1p(len(gain))]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - center) / scale]
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-4 * len(y) * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (p - y) + 1e-4 * len(y) * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return center, scale, w


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary: different fronts before one body."""
    in_toxic, in_ordinary, contexts = Counter(), Counter(), set()
    # A word counts once per word before it, so that near copies of one toxic text mark none of its ordinary words.
    for t in toxic:
        words = t.lower().split()
        for before, word in zip([b"", *words], words):
            if (pair := hash((before, word))) not in contexts:
                contexts.add(pair)
                in_toxic[word] += 1
    for t in ordinary:
        in_ordinary.update(set(t.lower().split()))
    least = max(2, len(toxic) / 300)
    marked = {w for w, n in in_toxic.items() if n >= least and n / len(toxic) > ODDS * (in_ordinary[w] + 1) / len(ordinary)}
    samples = [b" " + b" ".join(w for w in t.lower().split() if w in marked) + b" " for t in toxic]
    plain = [w for t in ordinary for w in windows(t)]
    half = len(plain) // 2
    body = train(BODY_BYTES, plain[:half])
    return train(FRONT_BYTES, [s for s in samples if len(s) > 2]) + body, train(FRONT_BYTES, plain[half:]) + body


def fit(toxic: list[bytes], ordinary: list[bytes]) -> Model:
    """Dictionaries from all rows; threshold and regression from gains under dictionaries of the other two thirds.

    With fewer than FOLDS rows of a class nothing can be told apart: every score is then near 0, or near 1 if no row is ordinary.
    """
    toxic, ordinary = list(dict.fromkeys(toxic)), list(dict.fromkeys(ordinary))
    if min(len(toxic), len(ordinary)) < FOLDS:
        return Model(b" ", b" ", 1, (0.0,) * 5, (1.0,) * 5, (30.0 if toxic and not ordinary else -30.0,) + (0.0,) * 5)
    seen = []
    for fold in range(FOLDS):
        others = [[t for i, t in enumerate(rows) if i % FOLDS != fold] for rows in (toxic, ordinary)]
        pair = [compressor(d) for d in dictionaries(*others)]
        seen += [(gains(t, *pair), y) for rows, y in ((toxic, 1), (ordinary, 0)) for t in rows[fold::FOLDS]]
    quiet = np.concatenate([g for g, y in seen if not y])
    threshold = max(1, int(np.quantile(quiet, 1 - FALSE_WINDOWS)) + 1) if len(quiet) else 1
    center, scale, weights = _logistic(np.array([features(g, threshold) for g, _ in seen]), np.array([y for _, y in seen], dtype=np.float64))
    return Model(*dictionaries(toxic, ordinary), threshold, tuple(center), tuple(scale), tuple(weights))


def labelled_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[bytes], list[bytes]]:
    """Toxic and ordinary texts to learn from: bounded, in hash order, none with crc32(doc_id) mod 5 = 0.

    Rows without doc_id, label or words are no examples; of several labels of a document the highest counts.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)).groupBy(
        F.col("doc_id").cast("long").alias("_id")).agg((F.max("toxic") > 0).cast("int").alias("_toxic"))
    out = []
    for y, rows in ((1, TOXIC_ROWS), (0, ORDINARY_ROWS)):
        # Twice the rows, since long texts and ids without a document drop out: a bounded list.
        ids = F.broadcast(known.where(F.col("_toxic") == y).orderBy(F.xxhash64("_id"), "_id").limit(2 * rows))
        texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").where(F.length("text").between(1, ROW_CHARS)).join(ids, "_id")
        out.append([r["text"].encode() for r in texts.orderBy(F.xxhash64("_id"), "_id", "text").limit(rows).select("text").collect()])
    return out[0], out[1]


def train_model(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(*labelled_sample(docs, labels))


class Scorer:
    """A fitted model ready to score texts."""

    def __init__(self, model: Model):
        self.pair = compressor(model.toxic), compressor(model.ordinary)
        self.model = model
        self.center, self.scale, self.weights = map(np.array, (model.center, model.scale, model.weights))

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        x = np.array([features(gains(t, *self.pair), self.model.threshold) for t in texts]).reshape(-1, 5)
        z = self.weights[0] + ((x - self.center) / self.scale) @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def toxicity_table(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    The score reads the text only, all of it. Null and empty texts have no window and get the score of zero gains;
    a null doc_id is never held out; repeated rows come out each; other columns are ignored; an empty table gives no rows.
    """
    model = model or train_model(docs, labels)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(text_bytes(batch.column(1))))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = map_batches(rows, run, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """Documents that are not predicted toxic, with their columns."""
    model = model or train_model(docs, labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model)
        for batch in batches:
            yield batch.filter(pa.array(score(text_bytes(batch.column("text"))) < 0.5))

    return map_batches(docs, keep, docs.schema)
