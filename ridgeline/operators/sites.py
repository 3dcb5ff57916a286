"""From a mask to sites: connected regions, area, lattice capacity, orientation, selection.

Masks and labels go from step to step as runs along rows (region, r, lo, hi), not as pixels: areas, boxes,
centres and capacities are sums over runs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.operators.masks import pixels, runs
from ridgeline.operators.quantiles import long_form, quantiles, wide_form
from ridgeline.sources.tables import stage

SIN_60 = math.sin(math.radians(60))
#: Names of the eight directions from north, clockwise.
DIRECTIONS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


#: Blocks of the map, in rows and columns, within which one task joins runs.
BLOCK_ROWS, BLOCK_COLS = 256, 1024


def label(mask: DataFrame, cols: int, max_rounds: int = 100) -> DataFrame:
    """(region, r, c, first, site_id): the pixels of `label_runs`."""
    return pixels(label_runs(runs(mask), cols, max_rounds), "first", "site_id")


def label_runs(stretches: DataFrame, cols: int, max_rounds: int = 100) -> DataFrame:
    """(region, r, lo, hi, first, site_id) by 4-neighbourhood: disjoint runs, cut at the blocks, with the number
    (row by row) of their region's first pixel; site ids count regions in raster order.

    Runs that touch within a block of the map are joined in one task, which is bounded by the block.
    What touches across a border of blocks is settled by star contraction between the blocks' roots; if
    nothing does, there is no such round. Writes its stages when called."""
    cut = stretches.withColumn("br", F.expr(f"int(r div {BLOCK_ROWS})")).withColumn("bc", F.explode(F.sequence(F.expr(f"int(lo div {BLOCK_COLS})"), F.expr(f"int(hi div {BLOCK_COLS})"))))
    cut = cut.select("region", "br", "bc", "r", F.greatest("lo", F.col("bc") * BLOCK_COLS).alias("lo"), F.least("hi", (F.col("bc") + 1) * BLOCK_COLS - 1).alias("hi"))
    settle = lambda part: _settle(part, cols)
    rows = stage(cut.groupBy("region", "br", "bc").applyInPandas(settle, "region string, bc int, r int, lo int, hi int, root long"), "runs")
    above = rows.where(F.col("r") % BLOCK_ROWS == BLOCK_ROWS - 1)
    below = rows.where(F.col("r") % BLOCK_ROWS == 0).select("region", "bc", (F.col("r") - 1).alias("r"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("root").alias("root2"))
    down = above.join(below, ["region", "bc", "r"]).where("lo <= hi2 and lo2 <= hi")
    west = rows.where(F.col("hi") % BLOCK_COLS == BLOCK_COLS - 1)
    east = rows.where(F.col("lo") % BLOCK_COLS == 0).select("region", "r", (F.col("lo") - 1).alias("hi"), F.col("root").alias("root2"))
    pair = ["region", F.greatest("root", "root2").alias("hi"), F.least("root", "root2").alias("lo")]
    across = down.select(*pair).unionByName(west.join(east, ["region", "r", "hi"]).select(*pair)).where("hi <> lo").distinct()
    tops = _contracted(stage(across, "across"), max_rounds)
    joined = rows.join(tops.select("region", F.col("hi").alias("root"), F.col("lo").alias("top")), ["region", "root"], "left")
    rooted = stage(joined.select("region", "r", "lo", "hi", F.coalesce("top", "root").alias("first")), "rooted")
    named = rooted.join(_numbered(rooted.select("region", "first").distinct(), BLOCK_ROWS * cols), ["region", "first"])
    return named.select("region", "r", "lo", "hi", "first", "site_id")


def _settle(part: pd.DataFrame, cols: int) -> pd.DataFrame:
    """The runs of a block with the smallest run that each reaches within it; a run's number is that of its first pixel."""
    part = part.sort_values(["r", "lo"])
    r, lo, hi = (part[c].to_numpy(np.int64) for c in ("r", "lo", "hi"))
    starts, ends = r * cols + lo, r * cols + hi
    first, last = np.searchsorted(ends, starts + cols), np.searchsorted(starts, ends + cols, side="right")  # those of the next row that overlap
    many = np.maximum(last - first, 0)
    a = np.repeat(np.arange(len(r)), many)
    b = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    same = np.nonzero((r[1:] == r[:-1]) & (lo[1:] == hi[:-1] + 1))[0]  # pieces of one run
    a, b = np.concatenate([a, same]), np.concatenate([b, same + 1])
    root = np.arange(len(r))
    while True:
        least = np.minimum(root[a], root[b])
        after = root.copy()
        for x in (a, b, root[a], root[b]):
            np.minimum.at(after, x, least)
        after = after[after]
        if (after == root).all():
            return pd.DataFrame({"region": part["region"].iloc[0], "bc": part["bc"].iloc[0], "r": r, "lo": lo, "hi": hi, "root": starts[root]})
        root = after


def _contracted(star: DataFrame, max_rounds: int) -> DataFrame:
    """(region, hi, lo): each node of `star(region, hi, lo)` to the smallest it reaches, by alternating
    large and small star until nothing changes."""
    state = None
    if not star.take(1):
        return star
    for _ in range(max_rounds):
        both = star.unionByName(star.select("region", F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("region", "hi").agg(F.least(F.min("lo"), F.col("hi")).alias("m"))
        large = both.join(least, ["region", "hi"]).where("lo > hi").select("region", F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        joined = large.join(large.groupBy("region", "hi").agg(F.min("lo").alias("m")), ["region", "hi"])
        small = joined.select("region", F.col("lo").alias("hi"), F.col("m").alias("lo")).union(joined.select("region", "hi", F.col("m").alias("lo"))).where("hi <> lo").distinct()
        star = stage(small, "star")
        now = star.agg(F.count(F.lit(1)), F.sum(F.col("lo").cast("decimal(30,0)")), F.sum(F.col("hi").cast("decimal(30,0)"))).first()
        if now == state:
            return star
        state = now
    raise RuntimeError("labelling did not settle")


def _numbered(firsts: DataFrame, block: int) -> DataFrame:
    """site_id by order of `first` in each region: the place in a block of rows, and the blocks before."""
    placed = firsts.withColumn("block", F.expr(f"first div {block}L"))
    sizes = placed.groupBy("region", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("region").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("region", "block").orderBy("first"))
    return placed.withColumn("k", within).join(sizes.select("region", "block", before.alias("before")), ["region", "block"]).select(
        "region", "first", (F.col("before") + F.col("k")).cast("int").alias("site_id"))


def areas(labels: DataFrame, px_km2: float) -> DataFrame:
    """Of label runs, as all that follows: pixels of each site are the sum of its runs' lengths."""
    n = F.sum(F.col("hi") - F.col("lo") + 1).cast("long")
    return labels.groupBy("region", "site_id").agg(n.alias("pixels")).withColumn("area_km2", F.col("pixels") * px_km2)


def required_pixels(threshold: int, spacing_km: float, px_km2: float) -> int:
    return int(threshold * spacing_km**2 / px_km2)


def boxes(labels: DataFrame) -> DataFrame:
    """(region, site_id, r0, r1, c0, c1), ends exclusive."""
    return labels.groupBy("region", "site_id").agg(F.min("r").alias("r0"), (F.max("r") + 1).alias("r1"), F.min("lo").alias("c0"), (F.max("hi") + 1).alias("c1"))


def facing(mean_aspect: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, DIRECTIONS)), (F.bround(mean_aspect / 45).cast("int") % 8 + 1).cast("int"))


def orientation(labels: DataFrame, aspects: DataFrame) -> DataFrame:
    """Arithmetic mean of aspect as the results define it (misleading near north), the direction it
    names, and the circular mean beside it."""
    a = F.radians("aspect")
    mean = pixels(labels, "site_id").join(aspects, ["region", "r", "c"]).groupBy("region", "site_id").agg(
        F.avg("aspect").alias("mean_aspect_deg"), F.pmod(F.degrees(F.atan2(F.avg(F.sin(a)), F.avg(F.cos(a)))), F.lit(360.0)).alias("circular_aspect_deg"))
    return mean.withColumn("facing_direction", facing(F.col("mean_aspect_deg")))


def lattice(spans: DataFrame, cell_y: float, cell_x: float, spacing: float, hexagonal: bool) -> DataFrame:
    """Points of a metric lattice over each box of `spans(..., h, w)` in pixels, anchored at its
    corner: adds pr, pc, the pixel of each point within the box."""
    pitch = spacing * SIN_60 if hexagonal else spacing
    last_k = F.greatest(F.ceil(F.col("h") * cell_y / pitch).cast("int") - 1, F.lit(0))
    rows = spans.withColumn("k", F.explode(F.sequence(F.lit(0), last_k))).where(F.col("k") * pitch < F.col("h") * cell_y)
    x0 = F.when(F.col("k") % 2 == 1, 0.5 * spacing).otherwise(0.0) if hexagonal else F.lit(0.0)
    rows = rows.withColumn("x0", x0).withColumn("pr", F.floor(F.col("k") * pitch / cell_y).cast("int"))
    last_j = F.ceil((F.col("w") * cell_x - F.col("x0")) / spacing).cast("int") - 1
    points = rows.where(last_j >= 0).withColumn("j", F.explode(F.sequence(F.lit(0), last_j)))
    x = F.col("x0") + F.col("j") * spacing
    return points.where(x < F.col("w") * cell_x).withColumn("pc", F.floor(x / cell_x).cast("int")).where("pr < h and pc < w").drop("x0", "k", "j")


#: Columns of the map in which runs of a row meet.
MEET_COLS = 1024


def _meeting(stretches: DataFrame) -> DataFrame:
    """Runs with the columns `lo` and `hi` cut at multiples of MEET_COLS, and the number of the stretch as `meet`."""
    each = stretches.withColumn("meet", F.explode(F.sequence(F.expr(f"int(lo div {MEET_COLS})"), F.expr(f"int(hi div {MEET_COLS})"))))
    return each.withColumn("lo", F.greatest("lo", F.col("meet") * MEET_COLS)).withColumn("hi", F.least("hi", (F.col("meet") + 1) * MEET_COLS - 1))


def capacity(labels: DataFrame, mask: DataFrame, factor: int, cell_y: float, cell_x: float, spacing: float, hexagonal: bool = True) -> DataFrame:
    """Detectors that fit each site: lattice points whose full-resolution pixel is in the mask and in
    the site's own up-sampled cells. `labels` are runs of the map decimated by `factor`, `mask` runs of the whole map;
    points are counted, not pixels.

    A lattice is anchored at the corner of its site's box and laid out as rows, not points: each row meets the
    site's runs and the mask's runs of its pixel row, and the points within the stretch that both share are
    counted by arithmetic."""
    pitch = spacing * SIN_60 if hexagonal else spacing
    spans = boxes(labels).select("region", "site_id", (F.col("r0") * factor).alias("r0"), (F.col("c0") * factor).alias("c0"),
                                 ((F.col("r1") - F.col("r0")) * factor).alias("h"), ((F.col("c1") - F.col("c0")) * factor).alias("w"))
    last_k = F.greatest(F.ceil(F.col("h") * cell_y / pitch).cast("int") - 1, F.lit(0))
    rows = spans.withColumn("k", F.explode(F.sequence(F.lit(0), last_k))).where(F.col("k") * pitch < F.col("h") * cell_y)
    rows = rows.withColumn("pr", F.floor(F.col("k") * pitch / cell_y).cast("int")).where("pr < h")
    x0 = F.when(F.col("k") % 2 == 1, 0.5 * spacing).otherwise(0.0) if hexagonal else F.lit(0.0)
    rows = rows.select("region", "site_id", "c0", "w", x0.alias("x0"), (F.col("r0") + F.col("pr")).alias("full_r"), F.expr(f"int((r0 + pr) div {factor})").alias("r"))
    own = labels.select("region", "site_id", "r", (F.col("lo") * factor).alias("lo"), ((F.col("hi") + 1) * factor - 1).alias("hi"))
    # a run of the site in this pixel row, once for each lattice row in it
    wide = _meeting(rows.join(own, ["region", "site_id", "r"])).drop("r").withColumnsRenamed({"lo": "own_lo", "hi": "own_hi"})
    met = wide.join(_meeting(mask.select("region", F.col("r").alias("full_r"), "lo", "hi")), ["region", "full_r", "meet"]).where("own_lo <= hi and lo <= own_hi")

    def points(end: Column) -> Column:
        """Points of the lattice row in the first `end` pixel columns of the box, by the same rounding as a point's own column."""
        column = lambda j: F.floor((F.col("x0") + j * spacing) / cell_x)
        near = F.greatest(F.ceil((end * cell_x - F.col("x0")) / spacing), F.lit(0)).cast("long")
        return near + F.when(column(near) < end, 1).otherwise(0) - F.when((near > 0) & (column(near - 1) >= end), 1).otherwise(0)

    first, end = F.greatest("own_lo", "lo") - F.col("c0"), F.least(F.least("own_hi", "hi") - F.col("c0") + 1, F.col("w"))
    hit = met.groupBy("region", "site_id").agg(F.sum(points(end) - points(first)).cast("long").alias("capacity_exact"))
    return spans.select("region", "site_id").join(hit, ["region", "site_id"], "left").fillna(0, ["capacity_exact"])


def centres(labels: DataFrame, origin_lat: float, origin_lon: float, step_deg: float) -> DataFrame:
    lat, lon = (lambda y: F.round(F.lit(origin_lat) - y * step_deg, 6)), (lambda x: F.round(F.lit(origin_lon) + x * step_deg, 6))
    n = (F.col("hi") - F.col("lo") + 1).cast("long")
    s = labels.groupBy("region", "site_id").agg(
        (F.sum(F.col("r") * n) / F.sum(n)).alias("ar"), (F.sum((F.col("lo") + F.col("hi")) * n) / 2 / F.sum(n)).alias("ac"), F.min("r").alias("r0"), (F.max("r") + 1).alias("r1"),
        F.min("lo").alias("c0"), (F.max("hi") + 1).alias("c1"))
    return s.select("region", "site_id", lat(F.col("ar")).alias("center_lat"), lon(F.col("ac")).alias("center_lon"),
                    F.struct(lat(F.col("r0")).alias("north"), lat(F.col("r1")).alias("south"), lon(F.col("c0")).alias("west"), lon(F.col("c1")).alias("east")).alias("bounds"))


def select_sites(sites: DataFrame, target: int, distributed: bool = True, stop_at_target: bool = False) -> DataFrame:
    """Adds selected, viz_id (number among the selected by capacity) and total_capacity: of all
    selected sites, null in single mode. A region's sites number far less than its pixels."""
    w = Window.partitionBy("region").orderBy(F.desc("capacity_exact"), "site_id")
    before = F.coalesce(F.sum("capacity_exact").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = before < target if distributed and stop_at_target else F.lit(True)
    rows = sites.withColumn("selected", chosen).withColumn("viz_id", F.when(F.col("selected"), F.row_number().over(w)))
    total = F.sum(F.when(F.col("selected"), F.col("capacity_exact"))).over(Window.partitionBy("region"))
    return rows.withColumn("total_capacity", total if distributed else F.lit(None).cast("long"))


def site_observables(labels: DataFrame, accepted: DataFrame, factor: int, columns: list[str]) -> DataFrame:
    """<column>_mean, _p50 and _p90 over the accepted candidates of each site."""
    at = accepted.withColumn("r", F.expr(f"int(r div {factor})")).withColumn("c", F.expr(f"int(c div {factor})"))
    key = ["region", "site_id"]
    rows = stage(at.join(pixels(labels, "site_id"), ["region", "r", "c"]).select(*key, *columns), "site-observables")
    means = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("candidates"), *[F.avg(c).alias(f"{c}_mean") for c in columns])
    found = quantiles(long_form(rows, key, columns), [*key, "name"], [0.5, 0.9])
    named = {f"{c}_p{p}": (c, k) for c in columns for k, p in enumerate((50, 90))}
    order = [x for c in columns for x in (f"{c}_mean", f"{c}_p50", f"{c}_p90")]
    return means.join(wide_form(found, key, named), key, "left").select(*key, "candidates", *order)


def region_stats(sites: DataFrame, need_pixels: int, need_capacity: int, factor: int) -> DataFrame:
    """`sites(region, site_id, pixels, capacity_exact, selected)`, all labelled regions."""
    fits = (F.col("pixels") >= need_pixels)
    return sites.groupBy("region").agg(
        F.count(F.lit(1)).alias("labelled_regions"), F.count_if(fits).alias("passed_area_threshold"),
        F.count_if(fits & (F.col("capacity_exact") >= need_capacity)).alias("passed_capacity_threshold"), F.count_if("selected").alias("selected"),
        (F.coalesce(F.sum(F.when(F.col("selected"), F.col("pixels"))), F.lit(0)) * factor * factor).alias("pixels_in_selected"))
