"""String column expressions: names, ids, log and feedback text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default and fixed wording of feedback, and the patterns removed from it.
DEFAULT_FEEDBACK = "Canopy annotations submitted; optimize confidence threshold and contour vertex resolution."
FILE_NAME = r"(?iU)[\w\-_]+\.(?:jpg|jpeg|png|tif|tiff)"
ITEM_REFERENCE = r"(?i)\b(?:chip|sample|image|patch)\s*(?:#?\d+|[a-f0-9]{6,})"
SQUARE_PAIR = r"\[\s*\d+(?:\.\d+)?\s*,\s*\d+(?:\.\d+)?\s*\]"
ROUND_PAIR = r"\(\s*\d+(?:\.\d+)?\s*,\s*\d+(?:\.\d+)?\s*\)"
SENTENCE_END = r"(?<=[a-zA-Z]{2}[.!?])\s+"
MAX_SENTENCES, MAX_WORDS = 2, 45
IMAGE_SUFFIX = r"(?i)\.(jpg|jpeg|png|tif|tiff)$"
DIAGNOSES = {
    "both": "Missing %d%% of canopy crowns and producing coarse box-like polygons; "
            "lower detection confidence threshold and increase contour approximation density.",
    "misses": "Missing %d%% of small clustered tree crowns; "
              "lower detection confidence threshold (~0.25) to improve recall in dense sectors.",
    "boxes": "Producing coarse rectangular polygons; refine contour smoothing and increase vertex count to match "
             "natural crowns.",
    "noise": "Elevated false-positive detections on background terrain; increase confidence threshold and filter "
             "low-vegetation regions.",
    "fine": "Polygon contours align well with canopy boundaries; tune NMS IoU threshold and edge smoothing for "
            "marginal gains.",
}


def scrub(text: Column, ids: Column | None = None) -> Column:
    """Feedback without ids, file names, item references or coordinate pairs; two sentences, 45 words at most."""
    out = F.trim(text)
    if ids is not None:
        out = F.aggregate(ids, out, lambda acc, i: F.replace(acc, i, F.lit("")))
    out = F.regexp_replace(out, FILE_NAME, "")
    out = F.regexp_replace(out, ITEM_REFERENCE, "sector")
    out = F.regexp_replace(F.regexp_replace(out, SQUARE_PAIR, ""), ROUND_PAIR, "")
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    out = F.regexp_replace(out, r"\s+([.,!?;:])", "$1")
    sentences = F.filter(F.split(out, SENTENCE_END), lambda s: s != "")
    out = F.array_join(F.slice(sentences, 1, MAX_SENTENCES), " ")
    words = F.split(out, " ")
    cut = F.concat(F.regexp_replace(F.array_join(F.slice(words, 1, MAX_WORDS), " "), "[,;:\\-]+$", ""), F.lit("."))
    out = F.when(F.size(words) > MAX_WORDS, cut).otherwise(out)
    out = F.when(out.rlike(r"[.!?]$"), out).otherwise(F.concat(out, F.lit(".")))
    return F.when(F.coalesce(text, F.lit("")) == "", DEFAULT_FEEDBACK).otherwise(out)


def diagnosis(misses: Column, boxes: Column, noise: Column) -> Column:
    """Rule-based feedback sentence; the first matching rule wins."""
    pct = F.floor(misses * 100).cast("int")
    return (
        F.when((misses > 0.30) & (boxes > 0.40), F.format_string(DIAGNOSES["both"], pct))
        .when(misses > 0.25, F.format_string(DIAGNOSES["misses"], pct))
        .when(boxes > 0.30, DIAGNOSES["boxes"])
        .when(noise > 0.25, DIAGNOSES["noise"])
        .otherwise(DIAGNOSES["fine"]))


def image_name(item: Column) -> Column:
    """File name of an item id: last part after ':' and '/', role prefix dropped, '.jpg' added when no suffix."""
    last = F.element_at(F.split(F.element_at(F.split(item, ":"), -1), "/"), -1)
    bare = F.trim(
        F.when(last.startswith("raw_climate_"), F.substr(last, F.lit(5)))
        .when(last.startswith("golden_climate_"), F.substr(last, F.lit(8))).otherwise(last))
    return F.when(bare.rlike(IMAGE_SUFFIX), bare).otherwise(F.concat(bare, F.lit(".jpg")))


def neutral_id(content: Column, suffix: Column, prefix: str = "chip") -> Column:
    """Unrevealing id from the content hash."""
    kind = F.when(F.lower(suffix).isin(".jpg", ".jpeg"), ".jpg").otherwise(".png")
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(content, 256), 1, 16), kind)


def store_location(uri: Column) -> Column:
    """Struct of bucket and key of an object-store URI."""
    return F.struct(
        F.regexp_extract(uri, r"^[a-z0-9]+://([^/]+)/?(.*)$", 1).alias("bucket"),
        F.regexp_extract(uri, r"^[a-z0-9]+://([^/]+)/?(.*)$", 2).alias("key"))


def source_spec(spec: Column, default_split: str = "train") -> Column:
    """Struct of source and split of 'org/name@split'."""
    parts = F.split(F.trim(spec), "@", 2)
    split = F.trim(F.get(parts, 1))
    return F.struct(F.trim(F.get(parts, 0)).alias("source"), F.when(
        F.coalesce(split, F.lit("")) == "", default_split).otherwise(split).alias("split"))


def byte_size(n: Column) -> Column:
    """Human size in steps of 1024 with two decimals."""
    step = F.lit(5)
    for i in range(4, -1, -1):
        step = F.when(n < 1024.0 ** (i + 1), i).otherwise(step)
    units = F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB", "TB", "PB")])
    return F.trim(F.format_string("%.2f %s", n / F.pow(F.lit(1024.0), step), F.get(units, step)))


def strip_ansi(line: Column) -> Column:
    return F.regexp_replace(line, "\x1b\\[[0-9;]*m", "")


def hash_order(seed: str, *keys: Column) -> Column:
    """Seeded, reproducible order of rows: the hash of seed and key."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in keys]), 256)


def hash_fraction(text: Column) -> Column:
    """First 32 hash bits as a fraction of their maximum."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint") / F.lit(4294967295.0)


def hash_bucket(text: Column, n: int = 100) -> Column:
    """First 32 hash bits modulo ``n``."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint") % n
