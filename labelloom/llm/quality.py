"""Quality rules with adaptive thresholds.

Per document a few integer measures are taken. Their distribution per language and source is kept as a
quantile sketch: counts per logarithmic bucket (values below 128 exact, larger ones to 6 leading bits, under 2 %
error). Sketches merge by adding counts, so they build map-side combined, small groups borrow
the sketch of their language or of all documents, and a sketch has a fixed number of buckets whatever the input.
The thresholds are fences around the middle half of each group; documents are then joined with the
fences of their group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm.common import map_batches, stored, text_bytes

SYMBOLS = b"#*$%&|<>"
GRAM = 5
# Documents a group needs for a sketch of its own.
LEAST_DOCS = 30
# Measure -> the narrowest fence, in units of the measure: (below, above); None: no fence on that side.
SPREAD = {"mean_chars": (1500, 3000), "symbol_share": (None, 50), "dup_share": (None, 250), "repeat_share": (None, 100)}
# Fences lie so many times the middle half away from it.
REACH = 3


def repeated_words(words: list[bytes], gram: int = GRAM) -> int:
    """Words inside ``gram``-word windows that the text has twice or more, the first included."""
    n = len(words)
    if n <= gram:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    code, base = ids[: n - gram + 1].copy(), len(number)
    limit = base
    for j in range(1, gram):
        if limit >= 2**62 // base:  # rename before the code would overflow
            _, code = np.unique(code, return_inverse=True)
            limit = len(code)
        code = code * base + ids[j: n - gram + 1 + j]
        limit *= base
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(code), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, np.flatnonzero(twice), 1)
    np.add.at(change, np.flatnonzero(twice) + gram, -1)
    return int((np.cumsum(change)[:n] > 0).sum())


def measures(text: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_lines (with a word) and n_repeat_words."""
    words = text.split()
    # UTF-8 continuation bytes are no code points of their own.
    chars = sum(map(len, words)) - len(text) + len(text.decode("utf-8", "surrogatepass")) if not text.isascii() else sum(map(len, words))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), len(lines), repeated_words(words)


def _measured(docs: DataFrame) -> DataFrame:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(zip(*map(measures, text_bytes(batch.column(3))))) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(g, pa.int64()) for g in got)], names=["doc_id", "lang", "source", *names])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))
    return map_batches(rows, run, "doc_id long, lang string, source string, " + ", ".join(f"{n} long" for n in names))


def _shares() -> dict[str, Column]:
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "mean_chars": F.floor(1000 * F.col("word_chars") / words), "symbol_share": F.floor(1000 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        "dup_share": F.floor(1000 * F.col("n_dup_lines") / lines), "repeat_share": F.floor(1000 * F.col("n_repeat_words") / words)}


def bucket(value: Column) -> Column:
    """Smallest value of the sketch bucket: exact below 128, else the 6 bits after the leading one."""
    step = F.greatest(F.floor(F.log2(F.greatest(value, F.lit(1)) + F.lit(0.5))) - 6, F.lit(0))
    width = F.pow(F.lit(2.0), step).cast("long")
    return F.when(value < 128, value).otherwise(value - value % width).cast("long")


def sketches(measured: DataFrame) -> DataFrame:
    """Counts per (lang, source, measure, bucket) of documents that passed the base rules."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), bucket(F.col(n)).alias("bucket")) for n in SPREAD]))
    return measured.select("lang", "source", each.alias("m")).groupBy("lang", "source", "m.measure", "m.bucket").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Lower and upper quartile of each measure in merged sketches, and the number of documents."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")  # as many rows as a sketch has buckets
    ranked = merged.withColumns({"upto": F.sum("n").over(group.orderBy("bucket")), "docs": F.sum("n").over(group)})
    return ranked.groupBy(*keys, "measure").agg(
        F.min(F.when(4 * F.col("upto") >= F.col("docs"), F.col("bucket"))).alias("low"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("docs"), F.col("bucket"))).alias("high"), F.first("docs").alias("docs"))


def thresholds(sketch: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Fences per (lang, source) and measure: (lang, source, measure, at_least, at_most).

    A group under ``least_docs`` documents takes the sketch of its language, that one the sketch of all.
    """
    own = quartiles(sketch, ["lang", "source"])
    by_lang = quartiles(sketch, ["lang"]).select(F.col("lang").alias("_l"), F.col("measure").alias("_m"), *[F.col(c).alias(f"l_{c}") for c in ("low", "high", "docs")])
    overall = quartiles(sketch, []).select(F.col("measure").alias("_g"), F.col("low").alias("g_low"), F.col("high").alias("g_high"))
    joined = own.join(by_lang, F.expr("lang <=> _l AND measure = _m")).join(overall, F.expr("measure = _g"))

    def pick(c: str) -> Column:
        return F.when(F.col("docs") >= least_docs, F.col(c)).when(F.col("l_docs") >= least_docs, F.col(f"l_{c}")).otherwise(F.col(f"g_{c}"))

    low, high = pick("low"), pick("high")
    below, above = (F.element_at(F.create_map(*[x for n, s in SPREAD.items() for x in (F.lit(n), F.lit(s[i]).cast("long"))]), F.col("measure")) for i in (0, 1))
    return joined.select("lang", "source", "measure",
                         F.when(below.isNotNull(), low - F.greatest(REACH * (high - low), below)).alias("at_least"),
                         F.when(above.isNotNull(), high + F.greatest(REACH * (high - low), above)).alias("at_most"))


def quality_table(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Measures, base verdict and kept flag of every document.

    Base rules fail under 10 words or with more than 20 % repeated words. The others are judged by the fences of their
    language and source (null is a group of its own): mean word length, symbols, duplicate lines and repeated words, each in
    thousandths. A null or empty text has no words and fails. Repeated rows come out each; other columns are
    ignored; an empty table gives no rows.
    """
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    measured = stored(_measured(docs).withColumn("base_failed", base).withColumns(_shares()), "measures")
    fences = thresholds(sketches(measured.where(~F.col("base_failed"))), least_docs)
    # One row per (lang, source); the group column may be hot on the documents' side only.
    wide = fences.groupBy(F.col("lang").alias("_l"), F.col("source").alias("_s")).agg(
        *[F.max(F.when(F.col("measure") == n, F.col(c))).alias(f"_{n}_{c}") for n in SPREAD for c in ("at_least", "at_most")])
    within = F.lit(True)
    for n, (below, above) in SPREAD.items():
        if below is not None:
            within &= bucket(F.col(n)) >= F.col(f"_{n}_at_least")
        if above is not None:
            within &= bucket(F.col(n)) <= F.col(f"_{n}_at_most")
    joined = measured.join(wide, F.expr("lang <=> _l AND source <=> _s"), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~F.col("base_failed") & F.coalesce(within, F.lit(False))).alias("kept"))


def _bucket_sql(x: str) -> str:
    return f"(CASE WHEN {x} < 128 THEN {x} ELSE {x} - {x} % (2.0 ^ greatest(floor(log2(greatest({x}, 1) + 0.5)) - 6, 0))::BIGINT END)::BIGINT"


def _quartile_sql(keys: str) -> str:
    by = f"{keys}, " if keys else ""
    return f"""SELECT {by}measure, min(CASE WHEN 4 * upto >= docs THEN bucket END) AS low, min(CASE WHEN 4 * upto >= 3 * docs THEN bucket END) AS high, any_value(docs) AS docs
    FROM (SELECT *, sum(n) OVER (PARTITION BY {by}measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}measure) AS docs
          FROM (SELECT {by}measure, bucket, count(*) AS n FROM sk GROUP BY ALL)) GROUP BY ALL"""


def _fence_sql(i: int) -> str:
    return " ".join(f"WHEN '{n}' THEN {'NULL' if s[i] is None else s[i]}" for n, s in SPREAD.items())


ORACLE = rf"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents
), w AS (
    SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), g AS (
    SELECT rid, i, list_aggregate(ws[i:i + 4], 'string_agg', ' ') AS gram FROM w, unnest(range(1, len(ws) - 3)) AS u(i)
), h AS (
    SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1
), r AS (
    SELECT rid, count(DISTINCT i + j) AS n FROM h, unnest(range(0, 5)) AS u(j) GROUP BY rid
), b AS (
    SELECT w.rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
           len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
           len(ls)::BIGINT AS n_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
    FROM w LEFT JOIN r ON w.rid = r.rid
), m AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
           1000 * word_chars // greatest(n_words, 1) AS mean_chars, 1000 * n_symbols // greatest(word_chars, 1) AS symbol_share,
           1000 * n_dup_lines // greatest(n_lines, 1) AS dup_share, 1000 * n_repeat_words // greatest(n_words, 1) AS repeat_share FROM b
), p AS (
    UNPIVOT (SELECT rid, lang, source, base_failed, mean_chars, symbol_share, dup_share, repeat_share FROM m)
    ON mean_chars, symbol_share, dup_share, repeat_share INTO NAME measure VALUE val
), sk AS (
    SELECT lang, source, measure, {_bucket_sql('val')} AS bucket FROM p WHERE NOT base_failed
), own AS ({_quartile_sql('lang, source')}), bl AS ({_quartile_sql('lang')}), al AS ({_quartile_sql('')}),
f AS (
    SELECT own.lang, own.source, own.measure,
           CASE WHEN own.docs >= {LEAST_DOCS} THEN own.low WHEN bl.docs >= {LEAST_DOCS} THEN bl.low ELSE al.low END AS low,
           CASE WHEN own.docs >= {LEAST_DOCS} THEN own.high WHEN bl.docs >= {LEAST_DOCS} THEN bl.high ELSE al.high END AS high
    FROM own JOIN bl ON own.lang IS NOT DISTINCT FROM bl.lang AND own.measure = bl.measure JOIN al ON own.measure = al.measure
), e AS (
    SELECT *, CASE measure {_fence_sql(0)} END AS below, CASE measure {_fence_sql(1)} END AS above FROM f
), v AS (
    SELECT p.rid, bool_and((below IS NULL OR {_bucket_sql('val')} >= low - greatest({REACH} * (high - low), below))
                       AND (above IS NULL OR {_bucket_sql('val')} <= high + greatest({REACH} * (high - low), above))) AS inside
    FROM p JOIN e ON p.lang IS NOT DISTINCT FROM e.lang AND p.source IS NOT DISTINCT FROM e.source AND p.measure = e.measure GROUP BY p.rid
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(inside, false) AS kept
FROM m LEFT JOIN v ON m.rid = v.rid
"""
