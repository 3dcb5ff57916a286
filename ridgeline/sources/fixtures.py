"""Terrain tables derived from the driver's tables, the same in Spark and in SQL.

The DEM is a parabolic canyon across columns with ridges every 40 rows, noise and a few
voids; elevations are whole metres, as survey elevations are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Metres of a pixel of one arc second near 15.6 degrees south.
CELL_Y, CELL_X = 30.722, 29.8
ORIGIN_LAT, ORIGIN_LON = -15.6, -72.0
CELL_DEG = 1 / 3600


@dataclass(frozen=True)
class Grid:
    """Geometry that a scan needs: pixel sizes in metres, rows and columns."""

    cell_y: float
    cell_x: float
    rows: int
    cols: int


def width(spark: SparkSession, sf_dir: str) -> int:
    return math.isqrt(spark.read.parquet(f"{sf_dir}/events.parquet").count())


def grid(spark: SparkSession, sf_dir: str) -> Grid:
    w = width(spark, sf_dir)
    return Grid(CELL_Y, CELL_X, w, w)


def dem(spark: SparkSession, sf_dir: str, regions: int = 1) -> DataFrame:
    """dem(region, r, c, z); region `b` is region `a` with rows and columns swapped."""
    w = width(spark, sf_dir)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("event_id") < w * w)
    r, c = F.expr(f"event_id div {w}"), F.col("event_id") % w
    side = F.expr(f"abs(2 * (event_id % {w}) - {w}) div 2")
    height = 2000 + F.floor(side * side * 20 / w) + 3 * F.abs(r % 40 - 20) + F.floor(F.col("value") / 50)
    z = F.when(F.col("event_id") % 499 == 7, None).otherwise(height.cast("double"))
    one = events.select(F.lit("a").alias("region"), r.cast("int").alias("r"), c.cast("int").alias("c"), z.alias("z"))
    if regions == 1:
        return one
    return one.unionByName(one.select(F.lit("b").alias("region"), F.col("c").alias("r"), F.col("r").alias("c"), "z"))


def road_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = width(spark, sf_dir)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where(F.col("o_orderkey") < w * w)
    return orders.select(F.lit("a").alias("region"), F.expr(f"int(o_orderkey div {w})").alias("r"), (F.col("o_orderkey") % w).cast("int").alias("c"),
                         F.floor(F.col("o_totalprice") / 20).cast("double").alias("dist_m"))


def circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circular zones, one for each supplier, in pixel units: zone_id, zr, zc, radius_m."""
    w = width(spark, sf_dir)
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.col("s_suppkey").cast("int").alias("zone_id"), (F.col("s_suppkey") * 37 % w).cast("int").alias("zr"),
        (F.col("s_suppkey") * 61 % w).cast("int").alias("zc"), (F.abs(F.floor(F.col("s_acctbal") / 100)) + 60).cast("double").alias("radius_m"))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two quadrilaterals, one concave, in shares of the width: zone_id and vertices in order."""
    w = width(spark, sf_dir)
    shares = [(0, [(0.1, 0.1), (0.4, 0.12), (0.38, 0.35), (0.12, 0.3)]), (1, [(0.5, 0.5), (0.9, 0.55), (0.62, 0.62), (0.55, 0.9)])]
    zones = [F.struct(F.lit(k).alias("zone_id"), F.array(*[F.struct(F.lit(x * w + 0.01).alias("x"), F.lit(y * w + 0.01).alias("y")) for x, y in v]).alias("verts"))
             for k, v in shares]
    return spark.range(1).select(F.inline(F.array(*zones)))
