"""Queries of this folder and, where SQL can say it, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm import interactions, mixing, pii, quality, resampling, secret_scan, topk, toxicity, urls
from labelloom.llm.common import table
from labelloom.llm.packing import pack_documents
from labelloom.llm.repeats import cover_repeats
from labelloom.llm.simhash import near_duplicate_classes
from labelloom.llm.token_output import token_output

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_token_output")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))


@query("op2_quality", quality.ORACLE)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_table(table(spark, sf_dir, "documents"))


@query("op3_simhash")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


@query("op4_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


@query("op5_urls")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


@query("op6_pii")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pii.pii_spans(table(spark, sf_dir, "documents"))

    def line(spans: str):
        return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))

    def count(kind: str):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return got.select("doc_id", *map(count, pii.KINDS), F.sha2(F.encode(line("base"), "UTF-8"), 256).alias("base_sha256"), line("spans").alias("spans"))


@query("op7_topk", topk.ORACLE)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(table(spark, sf_dir, "embeddings"))


@query("op8_mixing", mixing.ORACLE)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(table(spark, sf_dir, "documents"))


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_repeats")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = cover_repeats(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


@query("op11_interactions", interactions.ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_secrets", secret_scan.ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_table(table(spark, sf_dir, "documents"))


@query("op13_resampling", resampling.ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
