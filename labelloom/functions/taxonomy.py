"""Label taxonomy: canonical names, carbon classes, severities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BACKGROUND = "_background"

# --- fixed values -----------------------------------------------------------
# Spaced lower-case label -> canonical label.
ALIASES = {
    "background": "_background",
    "tree": "ordinary_tree",
    "individual tree": "ordinary_tree",
    "single tree": "ordinary_tree",
    "ordinary tree": "ordinary_tree",
    "group of trees": "group_of_trees",
    "tree group": "group_of_trees",
    "dense tree": "dense_tree",
    "mangrove tree": "mangrove",
    "mangrove": "mangrove",
    "mangrove (coastal dense)": "mangrove",
    "mangrove coastal dense": "mangrove",
    "dry forest tree": "ordinary_tree",
    "deciduous broadleaf": "ordinary_tree",
    "mature mixed hardwood": "dense_tree",
    "dense taiga canopy": "dense_tree",
    "scots pine (boreal conifer)": "dense_tree",
    "scots pine boreal conifer": "dense_tree",
    "scots pine": "dense_tree",
    "boreal conifer": "dense_tree",
    "tropical emergent canopy": "dense_tree",
    "tropical broadleaf (dense)": "dense_tree",
    "tropical broadleaf dense": "dense_tree",
    "tropical forest tree": "dense_tree",
    "understory shrub": "plant",
    "restor forestry verified": "ordinary_tree",
    "forest": "intact_forest",
    "intact forest": "intact_forest",
    "degraded forest": "degraded_forest",
    "fire scar": "fire_scar",
    "bare land": "bare_land",
    "crop land": "cropland",
    "oil palm": "oil_palm",
    "hard hat": "hardhat",
    "helmet": "hardhat",
    "no hardhat": "missing_hardhat",
    "missing hard hat": "missing_hardhat",
    "no helmet": "missing_hardhat",
    "missing helmet": "missing_hardhat",
    "fall protection": "fall_protection",
    "trip hazard": "trip_hazard",
}
# Carbon class -> canonical labels it covers (others: ordinary_tree).
CARBON_MEMBERS = {
    "mangrove": ["mangrove", "wetland"],
    "plantation": ["plantation", "eucalyptus", "oil_palm", "rubber", "orchard"],
    "field": ["field", "farm", "agriculture", "crop", "cropland", "parcel"],
    "dense_tree": [
        "conifer", "pine", "spruce", "taiga", "boreal", "fir", "larch", "broadleaf", "tropical", "rainforest",
        "emergent", "hardwood", "dense_tree", "group_of_trees", "intact_forest", "degraded_forest",
    ],
    "plant": ["plant", "shrub", "regrowth", "understory", "brush"],
}
# Carbon class -> weight multiplier.
CARBON_MULTIPLIERS = {
    "mangrove": 3.5, "dense_tree": 1.8, "boreal_conifer": 1.8, "tropical_broadleaf": 1.8,
    "plantation": 1.2, "ordinary_tree": 1.0, "field": 0.7, "plant": 0.4,
}
# Labels that count as the same tree when a label match is scored.
TREE_FAMILY = [
    "ordinary_tree", "dense_tree", "group_of_trees", "tree", "individual_tree", "dry_forest_tree",
    "mature_mixed_hardwood", "deciduous_broadleaf", "mangrove", "boreal_conifer", "tropical_broadleaf",
    "plantation", "intact_forest",
]
# Keyword severity tokens.
MISSING_TOKENS = ["no", "missing", "without", "lack", "absent"]
PROTECTIVE_TOKENS = ["hardhat", "helmet", "vest", "mask", "harness", "goggles", "gloves"]
FALL_TOKENS = ["fall", "edge", "scaffold", "ladder", "height"]
FIRE_TOKENS = ["fire", "spark", "explosion", "electrical", "shock"]
LOW_TOKENS = ["trip", "slip", "spill", "minor"]
# Land-cover label -> severity (others: low).
COVER_SEVERITY = {
    "individual_tree": "none", "group_of_trees": "none", "tree": "none", "intact_forest": "none",
    "degraded_forest": "low", "deforestation": "critical", "regrowth": "low", "plantation": "medium",
    "wetland": "medium", "water": "none", "agriculture": "low", "urban": "medium", "fire_scar": "high",
    "bare_land": "medium", "cloud": "none",
}
# Land-cover raster code -> label (others: bare_land).
COVER_CODES = {
    10: "intact_forest", 20: "regrowth", 30: "bare_land", 40: "agriculture", 50: "urban", 60: "bare_land",
    70: "bare_land", 80: "water", 90: "wetland", 95: "wetland", 100: "bare_land",
}
# Biome keywords and the (threshold -> label) choice by crown area.
BIOME_RULES = [
    (["zanzibar", "coastal", "mangrove", "swamp", "wetland"],
     [(1000.0, "Mangrove (Coastal Dense)")], "Mangrove"),
    (["taiga", "boreal", "scandinavian", "russian", "conifer", "pine", "spruce"],
     [(2500.0, "Dense Taiga Canopy"), (500.0, "Scots Pine (Boreal Conifer)")], "Boreal Conifer"),
    (["rain forest", "rainforest", "sumatran", "amazon", "tropical moist", "bahia"],
     [(3000.0, "Tropical Emergent Canopy"), (800.0, "Tropical Broadleaf (Dense)")], "Tropical Forest Tree"),
    (["deciduous", "mixed", "puget", "sarmatic", "pannonian", "nihonkai"],
     [(1500.0, "Mature Mixed Hardwood")], "Deciduous Broadleaf"),
]
DRY_BIOMES = ["steppe", "dry", "savanna", "scrub", "gangetic"]
# --- end of fixed values ----------------------------------------------------


def _lookup(table: dict) -> Column:
    flat = [F.lit(v) for pair in table.items() for v in pair]
    return F.create_map(*flat)


def canonical_label(raw: Column) -> Column:
    """Trimmed, lower-case label with aliases resolved; empty becomes the background label."""
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(raw, F.lit(""))), r"[\s_\-]+", " "))
    return (
        F.when(spaced == "", F.lit(BACKGROUND))
        .otherwise(F.coalesce(F.element_at(_lookup(ALIASES), spaced), F.replace(spaced, F.lit(" "), F.lit("_"))))
    )


def carbon_class(canonical: Column) -> Column:
    """Carbon class of a canonical label; unknown labels are neutral trees."""
    out = F.lit("ordinary_tree")
    for name, members in CARBON_MEMBERS.items():
        out = F.when(canonical.isin(members), F.lit(name)).otherwise(out)
    return out


def carbon_multiplier(canonical: Column) -> Column:
    """Weight multiplier of a canonical label."""
    out = F.lit(1.0)
    for name, members in CARBON_MEMBERS.items():
        out = F.when(canonical.isin(members), F.lit(CARBON_MULTIPLIERS[name])).otherwise(out)
    return out


def label_match(a: Column, b: Column) -> Column:
    """1.0 for equal canonical labels or two members of the tree family, else 0.0."""
    same_family = a.isin(TREE_FAMILY) & b.isin(TREE_FAMILY)
    return F.when((a == b) | same_family, F.lit(1.0)).otherwise(F.lit(0.0))


def keyword_severity(label: Column) -> Column:
    """Severity tier from label tokens; the first matching rule wins."""
    text = F.trim(F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), r"[^a-z0-9]+", " "))
    tokens = F.split(text, " ")

    def has(words: list[str]) -> Column:
        return F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words]))

    return (
        F.when(text == "", "none")
        .when(has(MISSING_TOKENS) & has(PROTECTIVE_TOKENS), "high")
        .when(has(FALL_TOKENS), "high")
        .when(has(FIRE_TOKENS), "critical")
        .when(has(PROTECTIVE_TOKENS), "medium")
        .when(has(LOW_TOKENS), "low")
        .otherwise("medium")
    )


def cover_severity(label: Column) -> Column:
    """Severity of a land-cover label."""
    return F.coalesce(F.element_at(_lookup(COVER_SEVERITY), F.lower(F.trim(label))), F.lit("low"))


def cover_label(code: Column) -> Column:
    """Label of a land-cover raster code."""
    return F.coalesce(F.element_at(_lookup(COVER_CODES), code.cast("int")), F.lit("bare_land"))


def biome_label(biome: Column, crown_area: Column) -> Column:
    """Label from biome keywords and crown area."""
    text = F.lower(F.coalesce(biome, F.lit("")))

    def mentions(words: list[str]) -> Column:
        return text.rlike("|".join(words))

    out = F.when(crown_area > 2000, "dense_tree").when(crown_area < 150, "plant").otherwise("ordinary_tree")
    out = F.when(
        mentions(DRY_BIOMES), F.when(crown_area < 200, "Understory Shrub").otherwise("Dry Forest Tree")
    ).otherwise(out)
    for words, steps, base in reversed(BIOME_RULES):
        choice = F.lit(base)
        for threshold, label in reversed(steps):
            choice = F.when(crown_area > threshold, label).otherwise(choice)
        out = F.when(mentions(words), choice).otherwise(out)
    return out


def taxonomy_table(spark: SparkSession) -> DataFrame:
    """The alias dimension with carbon class, multiplier and severity per spaced label."""
    rows = [(k, v) for k, v in ALIASES.items()]
    base = spark.createDataFrame(rows, "spaced string, canonical string")
    return base.select(
        "spaced", "canonical", carbon_class(F.col("canonical")).alias("carbon_class"),
        carbon_multiplier(F.col("canonical")).alias("multiplier"),
        keyword_severity(F.col("canonical")).alias("severity"),
    )


def with_taxonomy(df: DataFrame, label: str = "label") -> DataFrame:
    """Dimension-join form of the taxonomy: a broadcast lookup of fixed size with defaults."""
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(label), F.lit(""))), r"[\s_\-]+", " "))
    dim = F.broadcast(taxonomy_table(df.sparkSession))
    known = df.withColumn("spaced", spaced).join(dim, "spaced", "left")
    fallback = F.when(F.col("spaced") == "", F.lit(BACKGROUND)).otherwise(
        F.replace(F.col("spaced"), F.lit(" "), F.lit("_")))
    canonical = F.coalesce(F.col("canonical"), fallback)
    return (
        known.withColumn("canonical", canonical)
        .withColumn("carbon_class", F.coalesce("carbon_class", carbon_class(F.col("canonical"))))
        .withColumn("multiplier", F.coalesce("multiplier", carbon_multiplier(F.col("canonical"))))
        .withColumn("severity", F.coalesce("severity", keyword_severity(F.col("canonical"))))
        .drop("spaced")
    )
