"""Annotation tables derived from the star-schema test tables.

Every table is defined twice with the same integer arithmetic: as a DataFrame
and as SQL text for the second engine. All definitions are narrow projections
of one table, so no job pays a shuffle for them.

``seq`` is the row key of an annotation inside (item, annotator): order, line
and quantity packed into one number.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions.geometry import POINTS
from labelloom.scale import spread

WIDTH, HEIGHT = 1024, 256

ANNOTATION_EXPRS = [
    "year(l_shipdate) AS round_num",
    "l_partkey AS item_id",
    "l_suppkey AS annotator_id",
    "CAST(l_orderkey * 512 + l_linenumber * 64 + CAST(l_quantity AS BIGINT) AS BIGINT) AS seq",
    """CASE (l_partkey + l_linenumber % 4 + CASE WHEN l_discount >= 0.08 THEN 1 ELSE 0 END) % 5
       WHEN 0 THEN 'Individual Tree' WHEN 1 THEN 'dense-tree' WHEN 2 THEN 'mangrove_tree'
       WHEN 3 THEN 'field' ELSE 'Understory Shrub' END AS label""",
    "CAST({bx} AS DOUBLE) AS x1",
    "CAST({by} AS DOUBLE) AS y1",
    "CAST({bx} + 60 + l_partkey % 7 AS DOUBLE) AS x2",
    "CAST({by} + 60 + l_partkey % 5 AS DOUBLE) AS y2",
    """CASE l_orderkey % 16 WHEN 3 THEN 'none' WHEN 7 THEN 'rect' WHEN 11 THEN 'star' ELSE 'octagon' END AS shape""",
    "CAST(0.5 + l_quantity / 100.0 AS DOUBLE) AS confidence",
    "l_returnflag AS status",
    "l_shipdate AS arrived",
]
_BX = ("(20 + 110 * (l_linenumber % 4) + CAST(l_quantity AS BIGINT) % 13 - 6"
       " + CASE WHEN l_tax >= 0.07 THEN 400 ELSE 0 END)")
_BY = "(20 + l_partkey % 40 + l_orderkey % 13 - 6)"
ANNOTATION_EXPRS = [e.format(bx=_BX, by=_BY) for e in ANNOTATION_EXPRS]

GOLDEN_EXPRS = [
    "p_partkey AS item_id",
    "CAST(o AS BIGINT) AS gt",
    """CASE (p_partkey + o) % 5 WHEN 0 THEN 'ordinary_tree' WHEN 1 THEN 'dense_tree' WHEN 2 THEN 'mangrove'
       WHEN 3 THEN 'field' ELSE 'plant' END AS label""",
    "CAST(20 + 110 * o AS DOUBLE) AS x1",
    "CAST(20 + p_partkey % 40 AS DOUBLE) AS y1",
    "CAST(80 + 110 * o + p_partkey % 7 AS DOUBLE) AS x2",
    "CAST(80 + p_partkey % 40 + p_partkey % 5 AS DOUBLE) AS y2",
]
# p_partkey % 10 = 0: golden. Of those, % 100 = 50 have only a label and % 100 = 70 are truly empty.
BOXED = "p_partkey % 10 = 0 AND p_partkey % 100 NOT IN (50, 70)"

ITEM_EXPRS = [
    "p_partkey AS item_id",
    f"{WIDTH} AS width",
    f"{HEIGHT} AS height",
    """CASE WHEN p_partkey % 100 = 50 THEN 'class_only' WHEN p_partkey % 10 = 0 THEN 'golden'
       ELSE 'public' END AS role""",
    """CASE WHEN p_partkey % 100 = 50 THEN CASE p_partkey % 3 WHEN 0 THEN 'mangrove' WHEN 1 THEN 'field'
       ELSE 'tree' END END AS only_label""",
]

# Star outline: outer and inner radius alternate on 14 points.
STAR_POINTS, STAR_INNER = 14, 0.15

SQL = {
    "annotations": f"SELECT {', '.join(ANNOTATION_EXPRS)} FROM lineitem",
    "golden": f"SELECT {', '.join(GOLDEN_EXPRS)} FROM part CROSS JOIN (SELECT unnest([0,1,2,3]) AS o) t WHERE {BOXED}",
    "items": f"SELECT {', '.join(ITEM_EXPRS)} FROM part",
    "annotators": "SELECT s_suppkey AS annotator_id, s_nationkey AS owner_id, s_acctbal AS stake FROM supplier",
    "reliabilities": """SELECT s_suppkey AS annotator_id, l.label,
        CAST(0.2 + ((s_suppkey * 13 + l.k * 29) % 75) / 100.0 AS DOUBLE) AS weight
        FROM supplier CROSS JOIN (VALUES ('ordinary_tree', 0), ('dense_tree', 1), ('mangrove', 2), ('field', 3),
        ('plant', 4)) l(label, k)""",
    "averages": """SELECT s_suppkey AS annotator_id, CAST((s_suppkey * 17 % 100) / 100.0 AS DOUBLE) AS avg_fidelity
        FROM supplier""",
    "round_scores": """SELECT user_id AS annotator_id, CAST(ts AS DATE) AS round,
        least(1.0, greatest(0.0, avg(value) / (64 * pi()))) AS reward FROM events GROUP BY 1, 2""",
    "points": """SELECT l_partkey AS item_id, CAST((l_orderkey * 37) % 500 AS DOUBLE) AS x,
        CAST((l_suppkey * 53) % 500 AS DOUBLE) AS y FROM lineitem""",
    "pixels": """SELECT p_partkey AS item_id, y, x, (p_partkey * 7 + x * 3 + y) % 256 AS r,
        (p_partkey * 5 + x + y * 11) % 256 AS g, (p_partkey * 3 + x * y) % 256 AS b
        FROM part CROSS JOIN (SELECT unnest(range(16)) AS x) CROSS JOIN (SELECT unnest(range(16)) AS y)""",
}


def with_tables(*names: str) -> str:
    """``WITH`` clause defining the named adapter tables for the second engine."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names)


def star(n: int = STAR_POINTS) -> str:
    step = 2 * 3.141592653589793 / n
    return (
        f"transform(sequence(0, {n - 1}), i -> named_struct("
        f"'x', (x1 + x2) / 2 + (x2 - x1) / 2 * if(i % 2 = 0, 1.0D, {STAR_INNER}D) * cos(i * {step}D),"
        f"'y', (y1 + y2) / 2 + (y2 - y1) / 2 * if(i % 2 = 0, 1.0D, {STAR_INNER}D) * sin(i * {step}D)))"
    )


POLYGON = f"""CAST(CASE shape
  WHEN 'none' THEN NULL
  WHEN 'rect' THEN array(named_struct('x', x1, 'y', y1), named_struct('x', x2, 'y', y1),
                         named_struct('x', x2, 'y', y2), named_struct('x', x1, 'y', y2))
  WHEN 'star' THEN {star()}
  ELSE array(named_struct('x', x1 + (x2 - x1) * 0.3D, 'y', y1), named_struct('x', x1 + (x2 - x1) * 0.7D, 'y', y1),
             named_struct('x', x2, 'y', y1 + (y2 - y1) * 0.3D), named_struct('x', x2, 'y', y1 + (y2 - y1) * 0.7D),
             named_struct('x', x1 + (x2 - x1) * 0.7D, 'y', y2), named_struct('x', x1 + (x2 - x1) * 0.3D, 'y', y2),
             named_struct('x', x1, 'y', y1 + (y2 - y1) * 0.7D), named_struct('x', x1, 'y', y1 + (y2 - y1) * 0.3D))
  END AS {POINTS})"""


OCTAGON = f"""CAST(array(named_struct('x', x1 + (x2 - x1) * 0.3D, 'y', y1), named_struct('x', x1 + (x2 - x1) * 0.7D, 'y', y1),
  named_struct('x', x2, 'y', y1 + (y2 - y1) * 0.3D), named_struct('x', x2, 'y', y1 + (y2 - y1) * 0.7D),
  named_struct('x', x1 + (x2 - x1) * 0.7D, 'y', y2), named_struct('x', x1 + (x2 - x1) * 0.3D, 'y', y2),
  named_struct('x', x1, 'y', y1 + (y2 - y1) * 0.7D), named_struct('x', x1, 'y', y1 + (y2 - y1) * 0.3D)) AS {POINTS})"""


class Tables:
    """The test tables of one folder and the annotation tables derived from them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def annotations(self) -> DataFrame:
        return spread(self.raw("lineitem").selectExpr(*ANNOTATION_EXPRS), "item_id")

    @cached_property
    def outlined(self) -> DataFrame:
        """Annotations with their polygon."""
        return self.annotations.withColumn("polygon", F.expr(POLYGON))

    @cached_property
    def golden(self) -> DataFrame:
        boxed = self.raw("part").where(BOXED)
        return boxed.select("p_partkey", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("o")).selectExpr(
            *GOLDEN_EXPRS)

    @cached_property
    def golden_outlined(self) -> DataFrame:
        """Golden objects with an octagon; one in five has only its box."""
        return self.golden.withColumn("polygon", F.expr(f"CASE WHEN (item_id + gt) % 5 = 4 THEN NULL ELSE {OCTAGON} END"))

    @cached_property
    def items(self) -> DataFrame:
        return self.raw("part").selectExpr(*ITEM_EXPRS)

    @cached_property
    def annotators(self) -> DataFrame:
        return self.raw("supplier").selectExpr(
            "s_suppkey AS annotator_id", "s_nationkey AS owner_id", "s_acctbal AS stake")

    @cached_property
    def reliabilities(self) -> DataFrame:
        labels = [("ordinary_tree", 0), ("dense_tree", 1), ("mangrove", 2), ("field", 3), ("plant", 4)]
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.lit(k).alias("k")) for n, k in labels]))
        return self.raw("supplier").select("s_suppkey", each.alias("l")).selectExpr(
            "s_suppkey AS annotator_id", "l.label",
            "CAST(0.2D + ((s_suppkey * 13 + l.k * 29) % 75) / 100.0D AS DOUBLE) AS weight")

    @cached_property
    def averages(self) -> DataFrame:
        return self.raw("supplier").selectExpr(
            "s_suppkey AS annotator_id", "CAST((s_suppkey * 17 % 100) / 100.0D AS DOUBLE) AS avg_fidelity")

    @cached_property
    def round_scores(self) -> DataFrame:
        return self.raw("events").groupBy(F.col("user_id").alias("annotator_id"), F.to_date("ts").alias("round")).agg(
            F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.avg("value") / (64 * F.pi()))).alias("reward"))

    @cached_property
    def points(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "l_partkey AS item_id", "CAST((l_orderkey * 37) % 500 AS DOUBLE) AS x",
            "CAST((l_suppkey * 53) % 500 AS DOUBLE) AS y")

    @cached_property
    def pixels(self) -> DataFrame:
        grid = spread(self.raw("part").select("p_partkey")).select(
            "p_partkey", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("y")).select(
            "p_partkey", "y", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("x"))
        return grid.selectExpr(
            "p_partkey AS item_id", "y", "x", "(p_partkey * 7 + x * 3 + y) % 256 AS r",
            "(p_partkey * 5 + x + y * 11) % 256 AS g", "(p_partkey * 3 + x * y) % 256 AS b")
