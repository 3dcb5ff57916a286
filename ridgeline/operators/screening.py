"""Screening of ground: gradients, slope and aspect, cuts, exclusion zones, thinning, funnel.

`dem(region, r, c, z)` holds every pixel, z null where nothing is known. Windows run along
columns and along rows, so no task holds more than a line of pixels of one region; filters
come after them, because a filtered neighbour would be a wrong neighbour.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ingest(dem: DataFrame, nodata_below: float = -100.0) -> DataFrame:
    """Elevations below the cutoff (sea, voids) become null."""
    return dem.withColumn("z", F.when(F.col("z") >= nodata_below, F.col("z")))


def baseline_pixels(metres: float, cell: float) -> int:
    return max(1, round(metres / cell))


def smooth(dem: DataFrame, ny: int, nx: int) -> DataFrame:
    """Mean over ny by nx pixels, the border repeated outwards; a void in reach gives null.

    The border pixel stands for all pixels beyond it, so its weight in a window is the number
    of places the window reaches over the edge."""
    def one(df: DataFrame, n: int, across: str, along: str) -> DataFrame:
        if n <= 1:
            return df
        before, after = n // 2, n - 1 - n // 2
        line = Window.partitionBy("region", across).orderBy(along)
        near, all_ = line.rowsBetween(-before, after), line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        first, last = F.first("z").over(all_), F.last("z").over(all_)
        low, high = F.min(along).over(all_), F.max(along).over(all_)
        short_lo = F.greatest(low - F.col(along) + before, F.lit(0))
        short_hi = F.greatest(F.col(along) + after - high, F.lit(0))
        total = F.sum("z").over(near) + F.when(short_lo > 0, short_lo * first).otherwise(0) + F.when(short_hi > 0, short_hi * last).otherwise(0)
        whole = F.count("z").over(near) == F.count(F.lit(1)).over(near)
        return df.withColumn("zs", F.when(whole, total / n)).drop("z").withColumnRenamed("zs", "z")

    return one(one(dem, ny, "c", "r"), nx, "r", "c")


def gradients(dem: DataFrame, cell_y: float, cell_x: float) -> DataFrame:
    """Adds dzdy (southwards) and dzdx (eastwards): central differences, one-sided at the edge."""
    def slope(line: Window, at: str, cell: float) -> Column:
        first, last = F.lag(at).over(line).isNull(), F.lead(at).over(line).isNull()
        before = F.when(first, F.col("z")).otherwise(F.lag("z").over(line))
        after = F.when(last, F.col("z")).otherwise(F.lead("z").over(line))
        return (after - before) / F.when(first & last, None).when(first | last, cell).otherwise(2 * cell)

    down, along = Window.partitionBy("region", "c").orderBy("r"), Window.partitionBy("region", "r").orderBy("c")
    return dem.withColumn("dzdy", slope(down, "r", cell_y)).withColumn("dzdx", slope(along, "c", cell_x))


def gradient_sq() -> Column:
    return F.col("dzdy") * F.col("dzdy") + F.col("dzdx") * F.col("dzdx")


def slope_deg() -> Column:
    return F.degrees(F.atan(F.sqrt(gradient_sq())))


def aspect_deg() -> Column:
    """Downhill, clockwise from north."""
    return F.pmod(F.degrees(F.atan2(-F.col("dzdx"), F.col("dzdy"))), F.lit(360.0))


def slope_band(lo: float | None, hi: float | None) -> Column:
    """Compared as squared gradients, so no arc tangent is taken for each pixel."""
    g2, test = gradient_sq(), gradient_sq().isNotNull()
    if lo is not None and lo > 0:
        test = test & (F.lit(False) if lo >= 90 else g2 >= math.tan(math.radians(lo)) ** 2)
    if hi is not None and hi < 90:
        test = test & (g2 <= math.tan(math.radians(hi)) ** 2)
    return test


def altitude_band(lo: float | None = None, hi: float | None = None) -> Column:
    test = F.col("z").isNotNull()
    if lo is not None:
        test = test & (F.col("z") >= lo)
    return test if hi is None else test & (F.col("z") <= hi)


def aspect_band(aspect: Column, lo: float | None, hi: float | None) -> Column:
    """Wraps through north when lo > hi; off unless both ends are set."""
    if lo is None or hi is None:
        return F.lit(True)
    return (aspect >= lo) | (aspect <= hi) if lo > hi else (aspect >= lo) & (aspect <= hi)


def near_road(pixels: DataFrame, road_dist: DataFrame, max_km: float) -> DataFrame:
    near = road_dist.where(F.col("dist_m") <= max_km * 1000).select("region", "r", "c")
    return pixels.join(near, ["region", "r", "c"], "left_semi")


def outside_circles(pixels: DataFrame, zones: DataFrame, cell_y: float, cell_x: float) -> DataFrame:
    """Keeps pixels at or beyond the radius of every zone (zone_id, zr, zc, radius_m). Each zone
    is laid out as the rows it touches, so the join is on rows, not all against all."""
    reach = F.ceil(F.col("radius_m") / cell_y).cast("int")
    rows = zones.select("zc", "zr", "radius_m", F.explode(F.sequence(F.col("zr") - reach, F.col("zr") + reach)).alias("r"))
    dy, dx = (F.col("r") - F.col("zr")) * cell_y, (F.col("c") - F.col("zc")) * cell_x
    return pixels.alias("p").join(rows.withColumnRenamed("r", "row"), (F.col("r") == F.col("row")) & (
        dy * dy + dx * dx < F.col("radius_m") * F.col("radius_m")), "left_anti")


def outside_polygons(pixels: DataFrame, zones: DataFrame) -> DataFrame:
    """Even-odd rule, y in (low, high] of an edge and x up to the crossing. Edges are laid out as
    the rows they span; a pixel with an odd number of crossings of one zone is inside."""
    n = F.size("verts")
    edges = zones.select("zone_id", F.col("verts"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i")).select(
        "zone_id", F.expr("verts[i]").alias("a"), F.expr("verts[(i + 1) % size(verts)]").alias("b"))
    low, high = F.least("a.y", "b.y"), F.greatest("a.y", "b.y")
    rows = edges.where(low < high).select("zone_id", "a", "b", F.explode(F.sequence(
        F.floor(low).cast("int"), F.ceil(high).cast("int"))).alias("row")).where((F.col("row") > low) & (F.col("row") <= high))
    crossing = rows.select("zone_id", "row", ((F.col("row") - F.col("a.y")) * (F.col("b.x") - F.col("a.x")) / (
        F.col("b.y") - F.col("a.y")) + F.col("a.x")).alias("x"))
    inside = pixels.join(crossing, (F.col("r") == F.col("row")) & (F.col("c") <= F.col("x"))).groupBy(
        "region", "r", "c", "zone_id").count().where("count % 2 = 1").select("region", "r", "c").distinct()
    return pixels.join(inside, ["region", "r", "c"], "left_anti")


def thin(pixels: DataFrame, stride: int, tile: int) -> DataFrame:
    """Every stride-th survivor of each tile, row-major: a thinning of the list, not of the map."""
    w = Window.partitionBy("region", "tile_r", "tile_c").orderBy("r", "c")
    tiled = pixels.withColumn("tile_r", F.expr(f"r div {tile}")).withColumn("tile_c", F.expr(f"c div {tile}"))
    return tiled.withColumn("k", F.row_number().over(w) - 1).where(F.col("k") % stride == 0).drop("k", "tile_r", "tile_c")


def funnel(stages: list[tuple[str, Column]], pixels: DataFrame) -> DataFrame:
    """Counts that pass each stage and all before it, in one pass: pos, stage, n, of_dem, of_prev."""
    tests, passed = [], F.lit(True)
    for k, (_, test) in enumerate(stages):
        passed = passed & F.coalesce(test, F.lit(False))
        tests.append(F.count_if(passed).alias(f"n{k}"))
    counts = pixels.agg(*tests)
    return shares(counts.select(F.posexplode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(f"n{k}").alias("n")) for k, (s, _) in enumerate(stages)]))
                                .alias("pos", "s")).select("pos", "s.stage", "s.n"))


def shares(counts: DataFrame) -> DataFrame:
    """Adds shares of the first and of the previous stage to a funnel (pos, stage, n), a few rows."""
    w = Window.orderBy("pos")
    return counts.select("pos", "stage", "n", (F.col("n") / F.greatest(F.first("n").over(w), F.lit(1))).alias("of_dem"),
                         F.expr("try_divide(n, lag(n) over (order by pos))").alias("of_prev"))
