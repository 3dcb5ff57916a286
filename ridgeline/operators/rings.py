"""Closed outlines of sites: rings of corner points, from label runs.

Every side of a pixel without a neighbour of the same site is an edge that runs clockwise around its pixel. The
edge that follows is the next side of the same pixel, else the side straight on, else the one to the left, so
pixels that meet at a corner only are kept apart, as in labelling. Edges form cycles; pointer doubling
finds the smallest edge of each and every edge's distance to it, in as many rounds as the longest ring has binary
digits. A row is an edge; no ring is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.operators.masks import pixels
from ridgeline.sources.tables import stage

#: Directions of an edge: east, south, west, north, clockwise around its pixel; its start seen from the pixel's corner, and its step.
_SIDES = [(0, -1, 0, 0, 0, 0, 1), (1, 0, 1, 0, 1, 1, 0), (2, 1, 0, 1, 1, 0, -1), (3, 0, -1, 1, 0, -1, 0)]


def edges(labels: DataFrame) -> DataFrame:
    """(region, site_id, d, y, x): directed sides; direction d and start point (y, x) in pixels from the map's corner."""
    cells = pixels(labels, "site_id")
    sides = F.inline(F.array(*[F.struct(F.lit(d).alias("d"), (F.col("r") + dr).alias("nr"), (F.col("c") + dc).alias("nc"), (F.col("r") + sy).alias("y"), (F.col("c") + sx).alias("x"))
                               for d, dr, dc, sy, sx, _, _ in _SIDES]))
    other = cells.withColumnsRenamed({"r": "nr", "c": "nc"})
    return cells.select("region", "site_id", sides).join(other, ["region", "site_id", "nr", "nc"], "left_anti").select("region", "site_id", "d", "y", "x")


def _step(at: int) -> Column:
    return F.element_at(F.array(*[F.lit(s[at]) for s in _SIDES]), F.col("d") + 1)


def rings(labels: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(region, site_id, ring, n, pos, d, y, x): each edge's ring, the ring's number of edges, and the edge's place from 0. A ring is
    named by its smallest edge (4 (y w + x) + d for a map w points wide). Writes its stages when called."""
    key = ["region", "site_id"]
    found = edges(labels)
    wide = labels.agg(F.max("hi")).first()[0]
    width = 2 + (wide or 0)
    name = (4 * (F.col("y").cast("long") * width + F.col("x")) + F.col("d")).alias("edge")
    rows = stage(found.select(*key, "d", "y", "x", name, (F.col("y") + _step(5)).alias("y1"), (F.col("x") + _step(6)).alias("x1")), "edges")
    starts = rows.select(*key, F.col("y").alias("y1"), F.col("x").alias("x1"), F.col("edge").alias("to"), F.col("d").alias("turn"))
    # right (the same pixel), straight on, left; back never
    rank = F.pmod(F.col("d") + 1 - F.col("turn"), F.lit(4))
    after = rows.join(starts, [*key, "y1", "x1"]).groupBy(*key, "edge").agg(F.min_by("to", rank).alias("to"))
    # least: the smallest edge of the first 2^k from here, off: how far on it lies
    state = stage(after.select(*key, "edge", "to", F.col("edge").alias("least"), F.lit(0).cast("long").alias("off")), "ring")
    reach = 1
    for _ in range(max_rounds):
        ahead = state.select(*key, F.col("edge").alias("to"), F.col("to").alias("next"), F.col("least").alias("least2"), (F.col("off") + reach).alias("off2"))
        joined = state.join(ahead, [*key, "to"])
        better = F.col("least2") < F.col("least")
        state = stage(joined.select(*key, "edge", F.col("next").alias("to"), F.when(better, F.col("least2")).otherwise(F.col("least")).alias("least"),
                                    F.when(better, F.col("off2")).otherwise(F.col("off")).alias("off"), better.alias("moved")), "ring")
        reach *= 2
        if not state.where("moved").take(1):
            break
        state = state.drop("moved")
    else:
        raise RuntimeError("rings did not close")
    sizes = state.groupBy(*key, "least").agg(F.count(F.lit(1)).alias("n"))
    placed = state.select(*key, "edge", "least", "off").join(sizes, [*key, "least"]).join(rows, [*key, "edge"])
    return placed.select(*key, F.col("least").alias("ring"), "n", F.pmod(F.col("n") - F.col("off"), F.col("n")).alias("pos"), "d", "y", "x")


def summary(placed: DataFrame) -> DataFrame:
    """(region, site_id, rings, holes, edges, area_px): the signed area of the rings is that of the pixels; a ring around a hole has a negative one."""
    y1, x1 = F.col("y") + _step(5), F.col("x") + _step(6)
    each = placed.groupBy("region", "site_id", "ring").agg(F.sum((F.col("x") * y1 - x1 * F.col("y")).cast("long")).alias("twice"), F.count(F.lit(1)).alias("n"))
    return each.groupBy("region", "site_id").agg(F.count(F.lit(1)).alias("rings"), F.count_if(F.col("twice") < 0).alias("holes"), F.sum("n").alias("edges"),
                                                 (F.sum("twice") / 2).cast("long").alias("area_px"))


def corners(placed: DataFrame, origin_lat: float, origin_lon: float, cell_deg: float) -> DataFrame:
    """(region, site_id, ring, pos, lat, lon): the points where a ring turns, in order; the first closes it again. Partitioned by ring only for `lag`,
    which holds a row at a time."""
    w = Window.partitionBy("region", "site_id", "ring").orderBy("pos")
    last = F.max_by("d", "pos").over(Window.partitionBy("region", "site_id", "ring"))
    turned = placed.withColumn("before", F.coalesce(F.lag("d").over(w), last)).where("before <> d")
    return turned.select("region", "site_id", "ring", "pos", (F.lit(origin_lat) - F.col("y") * cell_deg).alias("lat"), (F.lit(origin_lon) + F.col("x") * cell_deg).alias("lon"))
