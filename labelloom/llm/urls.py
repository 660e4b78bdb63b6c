"""URL filter: rules first, then naive Bayes over segmented host words and path tokens.

Hosts are often several words written together. Each run of letters is split by a unigram Viterbi
search: of all ways to cut it into words, the one with the largest product of word frequencies. Frequencies come from the
visible text and the path tokens of all pages. Host runs are no evidence: each would be a known word of its own
and never be split. The candidate words of a run are looked up by a join, so the vocabulary is never held whole anywhere.

The Bayes model learns from the pages themselves: those with a seed word of a blocked topic are its blocked class, the
others its allowed class. Tokens are hashed into BUCKETS classes, so the model is a table of at most that many rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import map_batches, stored

LONGEST_WORD = 20
BUCKETS = 2**16
# Fixed values: (verdict, host, path prefix) of the rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
# Words of topics to block.
SEEDS = ("ads", "adult", "bet", "bets", "casino", "cheap", "free", "loan", "loans", "lottery", "pills", "poker", "porn", "spam", "track", "viagra", "win", "xxx")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path: empty without a ``://``."""
    at = F.locate("://", url)
    rest = F.when(url.isNull() | (at == 0), F.lit("")).otherwise(F.substring(url, at + 3, F.length(url)))
    bare = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    host = F.regexp_extract(bare, r"(?s)^([^/]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.substring(bare, F.length(host) + 1, F.length(bare))


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
            for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:]))]
    return F.coalesce(*fits)


def viterbi(run: str, known: dict[tuple[int, int], int], total: int) -> list[str]:
    """Words of a run of letters; ``known``: count of the word at (start, length). Unknown stretches cost by their length.

    Of equal splits the one with the longer last word.
    """
    n = len(run)
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    for end in range(1, n + 1):
        for size in range(min(LONGEST_WORD, end), 0, -1):
            count = known.get((end - size, size), 0)
            cost = math.log(count / total) if count else -math.log(total) - 2.5 * size
            if (score := best[end - size] + cost) > best[end] + 1e-12:
                best[end], back[end] = score, end - size
    out = []
    while n:
        out.append(run[back[n]: n])
        n = back[n]
    return out[::-1]


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n): words of the visible text and of the paths of all pages, not of the hosts to be split; seeds count once more."""
    text = F.lower(F.regexp_replace(F.coalesce(F.col("html"), F.lit("")), r"(?s)<[^>]*>", " "))
    words = F.concat(F.regexp_extract_all(text, F.lit(r"([a-z]+)"), 1), F.regexp_extract_all(F.lower("_path"), F.lit(r"([a-z]+)"), 1))
    counted = pages.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    seeds = pages.sparkSession.createDataFrame([(w, 1) for w in SEEDS], "word string, n long")
    return counted.where((F.length("word") > 1) & (F.length("word") <= LONGEST_WORD)).union(seeds).groupBy("word").agg(F.sum("n").alias("n"))


def segment(runs: DataFrame, words: DataFrame) -> DataFrame:
    """(run, parts) for distinct runs of letters."""
    total = words.agg(F.sum("n")).first()[0] or 1
    starts = runs.select("run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("start"))
    pieces = starts.select("run", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), F.length("run") - F.col("start") + 1))).alias("size"))
    pieces = pieces.withColumn("word", F.substring(F.col("run"), F.col("start"), F.col("size")))
    known = pieces.join(words, "word").groupBy("run").agg(F.collect_list(F.struct("start", "size", "n")).alias("known"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [{(k["start"] - 1, k["size"]): k["n"] for k in ks or ()} for ks in batch.column(1).to_pylist()]
            parts = [viterbi(r, k, total) for r, k in zip(batch.column(0).to_pylist(), found)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.list_(pa.string()))], names=["run", "parts"])

    return map_batches(runs.join(known, "run", "left").select("run", "known"), cut, "run string, parts array<string>")


def url_tokens(pages: DataFrame) -> DataFrame:
    """Per distinct (_host, _path): _n pages, and _tokens: segmented host words and path tokens."""
    urls = pages.groupBy("_host", "_path").agg(F.count("*").alias("_n"))
    hosts = urls.select("_host").distinct().select("_host", F.posexplode(F.regexp_extract_all("_host", F.lit(r"([a-z]+)"), 1)).alias("_at", "run"))
    # Stored: both the total and the join read the counts, which cost a pass over all pages.
    cut = segment(hosts.select("run").distinct(), stored(word_counts(pages), "words"))
    named = hosts.join(cut, "run").groupBy("_host").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_at", "parts"))), lambda x: x["parts"])).alias("_words"))
    path = F.regexp_extract_all(F.lower("_path"), F.lit(r"([a-z0-9]+)"), 1)
    return urls.join(named, "_host", "left").select("_host", "_path", "_n", F.concat(F.coalesce("_words", F.array().cast("array<string>")), path).alias("_tokens"))


def bayes(tokens: DataFrame) -> tuple[DataFrame, float]:
    """Log ratios (_bucket, _ratio in millionths) of blocked to allowed tokens, and that of the classes (None without blocked pages)."""
    marked = tokens.withColumn("_bad", F.arrays_overlap("_tokens", F.array(*map(F.lit, SEEDS))))
    pages = marked.groupBy("_bad").agg(F.sum("_n").alias("n"))
    n = {r["_bad"]: r["n"] for r in pages.collect()}
    each = marked.select("_bad", "_n", F.explode("_tokens").alias("_token")).withColumn("_bucket", F.pmod(F.xxhash64("_token"), F.lit(BUCKETS)))
    counts = stored(each.groupBy("_bucket").agg(F.sum(F.when(F.col("_bad"), F.col("_n")).otherwise(0)).alias("b"), F.sum(F.when(F.col("_bad"), 0).otherwise(F.col("_n"))).alias("a")), "tokens")
    sums = counts.agg(F.sum("b"), F.sum("a"), F.count("*")).first()
    b, a, v = (x or 0 for x in sums)
    ratio = F.log((F.col("b") + 1) / F.lit(float(b + v or 1))) - F.log((F.col("a") + 1) / F.lit(float(a + v or 1)))
    prior = math.log((n.get(True, 0) + 1e-9) / (n.get(False, 0) + 1e-9)) if n.get(True) else -math.inf
    return counts.select("_bucket", F.round(ratio * 1e6).cast("long").alias("_ratio")), prior


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score (log odds of blocking, in millionths; null without tokens to judge by).

    Needs page_id, url and html; other columns are ignored. A null url or one without ``://`` has an empty host and path. Where no rule fits, the
    verdict is the model's; without any token or any page of a blocked topic it is allow. Repeated rows come out
    each; an empty table gives no rows.
    """
    host, path = split_url(F.col("url").cast("string"))
    rows = pages.select("page_id", "html", host.alias("_host"), path.alias("_path"))
    tokens = stored(url_tokens(rows), "urls")
    ratios, prior = bayes(tokens)
    # At most BUCKETS rows of two numbers: about a megabyte.
    each = tokens.select("_host", "_path", F.explode("_tokens").alias("_token")).withColumn("_bucket", F.pmod(F.xxhash64("_token"), F.lit(BUCKETS)))
    scored = each.join(F.broadcast(ratios), "_bucket").groupBy("_host", "_path").agg(F.sum("_ratio").alias("_sum"))
    judged = rows.drop("html").join(scored, ["_host", "_path"], "left")
    score = F.col("_sum") + F.lit(round(prior * 1e6) if math.isfinite(prior) else 0)
    model = F.when(F.lit(math.isfinite(prior)) & (F.col("_sum").isNotNull()) & (score > 0), "block").otherwise("allow")
    found = matching_rule(F.col("_host"), F.col("_path"), rules)
    return judged.withColumn("_rule", found).select(
        F.col("page_id").cast("long").alias("page_id"), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), model).alias("verdict"), score.alias("score"))
