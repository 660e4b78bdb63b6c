"""Mixing of sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Every document gets an exponential key -ln(u) / weight: small keys are likely for large
quality weights. A source's target is met by complete epochs over all its documents, then
by its documents in key order up to the rest of the budget. The order is never
sorted out: sums per key interval are added up, the interval in which the budget ends is
refined, and in the last one the keys themselves; so no source, however large, is in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm.common import WORD, stored

WEIGHTS = (5, 2, 1)
EPOCHS = 2
# Keys are multiples of 2**-36, cut into intervals of 2**28, then 2**12 of them.
_SCALE, _WIDTHS = 2**36, (2**28, 2**12)


def quality_weight() -> Column:
    """0.05 to 1: ten times the share of junk symbols is taken off, in steps of 0.01."""
    text = F.coalesce(F.col("text"), F.lit(""))
    junk = F.regexp_count(text, F.lit(r"[#*$%&|<>]"))
    share = F.floor(1000 * junk / F.greatest(F.char_length(text), F.lit(1)))
    return F.greatest(F.lit(5), 100 - share) / 100.0


def sampling_key(weight: Column) -> Column:
    """-ln(u) / weight in units of 2**-36; u comes from 52 bits of a hash of doc_id, so reruns agree."""
    digits = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 1) / F.lit(float(2**52))
    return F.floor(-F.log(u) / weight * F.lit(float(_SCALE))).cast("long")


def _sized(docs: DataFrame) -> DataFrame:
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    return docs.withColumns({"_size": words, "_key": sampling_key(quality_weight())})


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, epochs: int = EPOCHS) -> DataFrame:
    """Per source: words, target. Excess over ``epochs`` times the words is shared again by weight until none is above.

    Sources fill up in the order of words per weight, so the full ones are those before the
    first that stays below its share. One row per source goes through the windows.
    """
    sizes = rows.groupBy("_source").agg(F.sum("_size").alias("_words"))
    place = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    sizes = sizes.withColumn("_weight", weight.cast("long"))
    every = Window.partitionBy(F.lit(0))
    before = every.orderBy(F.col("_words") / F.col("_weight"), F.col("_source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    cap = epochs * F.col("_words")
    # Twice the budget and twice the full sources' words are integers, also for half a word.
    rest = percent * F.sum("_words").over(every) - 100 * F.coalesce(F.sum(cap).over(before), F.lit(0))
    open_weight = F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(before), F.lit(0))
    filled = sizes.withColumns({"_rest": rest, "_open": open_weight, "_full": 100 * cap * open_weight <= F.col("_weight") * rest})
    level = F.min(F.when(~F.col("_full"), F.struct(F.col("_words") / F.col("_weight"), F.col("_rest"), F.col("_open")))).over(every)
    filled = filled.withColumn("_level", level)
    share = F.col("_weight") * F.col("_level._rest") / (100.0 * F.col("_level._open"))
    return filled.select("_source", "_words", F.when(F.col("_full"), cap.cast("double")).otherwise(share).alias("_target"))


def mixing_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, epochs: int = EPOCHS) -> tuple[DataFrame, DataFrame]:
    """(documents with _size and _key, sources with _words, _target, _epochs, _cut and _extra: keys up to _cut, and _extra, are taken once more)."""
    rows = stored(_sized(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string").alias("_source")))
                  .select("doc_id", "_source", "_size", "_key"), "mixing")
    goal = source_targets(rows, weights, percent, epochs)
    whole = F.when(F.col("_words") > 0, F.floor(F.col("_target") / F.col("_words"))).otherwise(0).cast("long")
    goal = stored(goal.withColumn("_epochs", whole).withColumn("_left", F.floor(F.col("_target")).cast("long") - whole * F.col("_words")), "targets")
    here, inside = rows.where("_size > 0"), goal.select("_source", "_left", F.lit(0).cast("long").alias("_low"))
    for width, outer in zip((*_WIDTHS, 1), (None, *_WIDTHS)):
        # Only the interval in which the budget of a source ends is looked at more closely.
        near = here.withColumn("_slot", F.expr(f"_key div {width} * {width}")).join(
            inside.withColumnRenamed("_source", "_s"), F.expr("_source <=> _s"))
        if outer:
            near = near.where(F.col("_key").between(F.col("_low"), F.col("_low") + (outer - 1)))
        sums = near.groupBy("_source", "_slot").agg(F.sum("_size").alias("_n"), F.first("_left").alias("_left"))
        upto = F.sum("_n").over(Window.partitionBy("_source").orderBy("_slot"))
        sums = sums.withColumn("_upto", upto).where(F.col("_upto") > F.col("_left"))
        ends = sums.groupBy("_source").agg(F.min(F.struct("_slot", "_upto", "_n", "_left")).alias("_e"))
        inside = ends.select("_source", (F.col("_e._left") - F.col("_e._upto") + F.col("_e._n")).alias("_left"), F.col("_e._slot").alias("_low"), F.col("_e._n").alias("_n"))
        inside = stored(inside, "interval")
    # Keys below the one at which the budget ends are taken. The gap that stays is closed by the one later key
    # whose words come nearest to it, if any comes nearer than none.
    ends = inside.select(F.col("_source").alias("_s"), F.col("_left").alias("_gap"), F.col("_low").alias("_end"))
    later = here.join(ends, F.expr("_source <=> _s")).where("_key >= _end")
    groups = later.groupBy("_source", "_key").agg(F.sum("_size").alias("_n"), F.first("_gap").alias("_gap"))
    best = groups.groupBy("_source").agg(F.min(F.struct(F.abs(F.col("_gap") - F.col("_n")).alias("miss"), F.col("_key").alias("key"), F.col("_gap").alias("gap"))).alias("_b"))
    last = ends.join(best, F.expr("_source <=> _s"), "left").select(
        "_s", "_end", F.when(F.col("_b.miss") < F.col("_b.gap"), F.col("_b.key")).otherwise(-1).alias("_fill"))
    sources = goal.join(last, F.expr("_source <=> _s"), "left").select(
        "_source", "_words", "_target", "_epochs", F.when(F.col("_left") > 0, F.coalesce(F.col("_end") - 1, F.lit(2**62))).otherwise(-1).alias("_cut"),
        F.when(F.col("_left") > 0, F.coalesce("_fill", F.lit(-1))).otherwise(-1).alias("_extra"))
    return rows, stored(sources, "cuts")


def _times() -> Column:
    return F.col("_epochs") + ((F.col("_key") <= F.col("_cut")) | (F.col("_key") == F.col("_extra"))).cast("long")


def mix_table(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, size, source_size, target and taken words of every document.

    A null or empty text has size 0 and takes nothing. Null is a source of its own, the last. Null doc_ids
    share one key; repeated rows have equal keys and are taken or left together. An empty table gives no rows;
    other columns are ignored.
    """
    rows, sources = mixing_plan(docs, weights, percent, epochs)
    joined = rows.join(sources.withColumnRenamed("_source", "_s"), F.expr("_source <=> _s"))
    times = _times()
    return joined.select("doc_id", F.col("_size").alias("size"), F.col("_words").alias("source_size"),
                         F.col("_target").alias("target"), (times * F.col("_size")).alias("taken"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, epochs: int = EPOCHS) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns. Documents without words go."""
    _, sources = mixing_plan(docs, weights, percent, epochs)
    # The row travels as one struct, so that its columns may have any names.
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string").alias("_source"))
    joined = _sized(rows).join(sources.withColumnRenamed("_source", "_s"), F.expr("_source <=> _s")).where("_size > 0")
    return joined.where(_times() > 0).select("row", F.explode(F.sequence(F.lit(1).cast("long"), _times()))).select("row.*")


ORACLE = r"""
WITH d AS (
    SELECT doc_id, source, coalesce(text, '') AS t FROM documents
), r AS (
    SELECT doc_id, source, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           greatest(5, 100 - floor(1000 * len(regexp_extract_all(t, '[#*$%&|<>]')) / greatest(length(t), 1))) / 100.0 AS weight,
           (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 1) / 4503599627370496.0 AS u
    FROM d
), k AS (
    SELECT *, floor(-ln(u) / weight::DOUBLE * 68719476736.0)::BIGINT AS key FROM r
), s AS (
    SELECT source, sum(size)::BIGINT AS words, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM k GROUP BY source
), w AS (
    SELECT *, [5, 2, 1][(place % 3 + 1)::INT] AS weight FROM s
), f AS (
    SELECT *, 150 * sum(words) OVER () - 100 * coalesce(sum(2 * words) OVER p, 0) AS rest,
           sum(weight) OVER () - coalesce(sum(weight) OVER p, 0) AS open
    FROM w WINDOW p AS (ORDER BY words / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (
    SELECT *, 200 * words * open <= weight * rest AS is_full FROM f
), l AS (
    SELECT rest, open FROM g WHERE NOT is_full ORDER BY words / weight::DOUBLE, source NULLS LAST LIMIT 1
), t AS (
    SELECT g.source, g.words, CASE WHEN is_full THEN (2 * words)::DOUBLE
           ELSE (g.weight * l.rest)::DOUBLE / (100.0::DOUBLE * l.open::DOUBLE) END AS target
    FROM g LEFT JOIN l ON true
), e AS (
    SELECT *, CASE WHEN words > 0 THEN floor(target / words)::BIGINT ELSE 0 END AS epochs FROM t
), b AS (
    SELECT *, floor(target)::BIGINT - epochs * words AS room FROM e
), n AS (
    SELECT source, key, sum(size) AS n FROM k WHERE size > 0 GROUP BY source, key
), c AS (
    SELECT n.source, n.key, n.n, b.room, sum(n.n) OVER (PARTITION BY n.source ORDER BY n.key) AS upto
    FROM n JOIN b ON n.source IS NOT DISTINCT FROM b.source
), x AS (
    SELECT source, min(key) - 1 AS last, min(upto - n) AS before FROM c WHERE upto > room GROUP BY source
), z AS (
    SELECT c.source, min_by(CASE WHEN abs(c.room - x.before - n) < c.room - x.before THEN c.key ELSE -1 END, (abs(c.room - x.before - n), c.key)) AS extra
    FROM c JOIN x ON c.source IS NOT DISTINCT FROM x.source WHERE c.key > x.last GROUP BY c.source
), y AS (
    SELECT b.*, CASE WHEN room > 0 THEN coalesce(x.last, 4611686018427387904) ELSE -1 END AS cutoff,
           CASE WHEN room > 0 THEN coalesce(z.extra, -1) ELSE -1 END AS extra
    FROM b LEFT JOIN x ON b.source IS NOT DISTINCT FROM x.source LEFT JOIN z ON b.source IS NOT DISTINCT FROM z.source
)
SELECT k.doc_id, k.size, y.words AS source_size, y.target, (k.size * (y.epochs + CASE WHEN k.key <= y.cutoff OR k.key = y.extra THEN 1 ELSE 0 END))::BIGINT AS taken
FROM k JOIN y ON k.source IS NOT DISTINCT FROM y.source
"""
