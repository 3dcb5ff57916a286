"""Ground under rays, by tiles: what moves is terrain once for each tile in reach and a row for each ray, not a row for each sample.

The DEM is packed into square tiles (arrays of places and floats). Rays are grouped by the tile that they start
in and co-grouped with the terrain in reach; a ray comes back with the list of its samples over known ground, and is
opened to rows where they are used. A group holds the rays of one tile and its surroundings, whatever the size of
the region; where a tile's rays have too many samples, they are dealt out over several groups.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.sources.fixtures import Grid

#: Samples that a group has at most, and those that are placed at once.
GROUP, PART = 1 << 24, 1 << 19
SAMPLE = pa.struct([("k", pa.int32()), ("z", pa.float64()), ("rise", pa.float64())])


def tiles(dem: DataFrame, size: int) -> DataFrame:
    """(region, tr, tc, at array<int>, pixels array<double>): the known pixels of each tile with their
    places in it, row by row; what is not listed is a void or off the map."""
    known = dem.where("z is not null").select("region", F.expr(f"r div {size}").alias("tr"), F.expr(f"c div {size}").alias("tc"), F.struct(
        ((F.col("r") % size) * size + F.col("c") % size).cast("int").alias("at"), F.col("z").cast("double").alias("z")).alias("p"))
    packed = known.groupBy("region", "tr", "tc").agg(F.collect_list("p").alias("p"))
    return packed.select("region", "tr", "tc", F.col("p.at").alias("at"), F.col("p.z").alias("pixels"))


def unpacked(at: np.ndarray, pixels: np.ndarray, size: int) -> np.ndarray:
    z = np.full(size * size, np.nan)
    z[np.asarray(at)] = np.asarray(pixels)
    return z.reshape(size, size)


def tile_size(reach: int, least: int = 32, most: int = 1024) -> int:
    """A power of two, at least two fifths of the reach of a ray in pixels: small enough to give many
    tasks, large enough that a tile of terrain goes to 49 tiles of candidates at most (up to `most`)."""
    size = least
    while size < min(0.4 * reach - 8, most):
        size *= 2
    return size


def _heights(z: np.ndarray, r: np.ndarray, c: np.ndarray, dr: np.ndarray, dc: np.ndarray, grid: Grid, bilinear: bool) -> np.ndarray:
    """The height under each sample (a window `z` whose first pixel is (0, 0), with a rim of one pixel), NaN for unknown;
    `r`, `c` are in the window, `dr`, `dc` what the sample lies from them, NaN off the map."""
    on = ~np.isnan(dr)
    dr, dc = np.where(on, dr, 0), np.where(on, dc, 0)
    h = z[r - dr.astype(np.int64) + 1, c + dc.astype(np.int64) + 1]
    if bilinear:
        fr, fc = r - dr, c + dc
        ri, ci = np.floor(fr).astype(np.int64), np.floor(fc).astype(np.int64)
        u, v, ri, ci = fc - ci, fr - ri, ri + 1, ci + 1
        mixed = (1 - v) * ((1 - u) * z[ri, ci] + u * z[ri, ci + 1]) + v * ((1 - u) * z[ri + 1, ci] + u * z[ri + 1, ci + 1])
        h = np.where(np.isnan(mixed), h, mixed)
    return np.where(on, h, np.nan)


def _samples(z: np.ndarray, r0: int, c0: int, rays: pa.Table, grid: Grid, step: float, start: float, first: int, bilinear: bool) -> pa.ListArray:
    """The known samples of each ray, the rise of each from the known one before (0 for the first)."""
    r, c, last = (rays[n].to_numpy().astype(np.int64) for n in ("r", "c", "last"))
    sin, cos = (rays[n].to_numpy() for n in ("sin", "cos"))
    k = np.arange(first, max(int(last.max()), first) + 1)
    d = start + k * step
    dc, dr = d[None, :] * sin[:, None] / grid.cell_x, d[None, :] * cos[:, None] / grid.cell_y
    lost = np.isnan(dr) | np.isnan(dc) | (k[None, :] > last[:, None])
    dr, dc = np.where(lost, 0, dr), np.where(lost, 0, dc)
    tr, tc = r[:, None] - dr.astype(np.int64), c[:, None] + dc.astype(np.int64)
    dr[lost | (tr < 0) | (tr >= grid.rows) | (tc < 0) | (tc >= grid.cols)] = np.nan
    h = _heights(z, (r - r0)[:, None], (c - c0)[:, None], dr, dc, grid, bilinear)
    known = ~np.isnan(h)
    row, at = np.nonzero(known)
    h, rise = h[known], np.zeros(len(row))
    same = row[1:] == row[:-1]
    rise[1:][same] = ((h[1:] - h[:-1]) / step)[same]
    ends = np.concatenate([[0], np.cumsum(known.sum(axis=1))]).astype(np.int32)
    fields = [pa.array(k[at].astype(np.int32)), pa.array(h), pa.array(rise)]
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, fields=list(SAMPLE)))


def along(rays: DataFrame, dem: DataFrame, grid: Grid, step: float, reach: float, last: Column, per_pixel: int, start: float = 0.0, first: int = 1,
          bilinear: bool = False, size: int | None = None) -> DataFrame:
    """`rays(region, r, c, azimuth, ...)` as rows (..., k, z, rise): sample k = first .. `last` of a ray lies `start` + k * `step`
    metres from its pixel; off the map and over voids there is none. z is of the nearest pixel, or of the four around (then of the nearest
    at the edge or beside a void). `reach` in metres bounds all samples, `per_pixel` the samples of the rays of a pixel."""
    reach_r, reach_c = (math.ceil(reach / cell) + 1 for cell in (grid.cell_y, grid.cell_x))
    size = size or tile_size(max(reach_r, reach_c), 64)
    span_r, span_c = -(-reach_r // size), -(-reach_c // size)
    last_r, last_c = (grid.rows - 1) // size, (grid.cols - 1) // size
    shares = -(-size * size * per_pixel // GROUP)
    near = lambda c, span, end: F.explode(F.sequence(F.greatest(F.col(c) - span, F.lit(0)), F.least(F.col(c) + span, F.lit(end))))
    look = F.radians("azimuth")
    names = rays.columns
    placed = rays.withColumns({"kr": F.expr(f"r div {size}"), "kc": F.expr(f"c div {size}"), "share": F.pmod(F.xxhash64("r", "c", "azimuth"), F.lit(shares)).cast("int"),
                               "sin": F.sin(look), "cos": F.cos(look), "last": last.cast("int")})
    around = tiles(dem, size).withColumn("kr", near("tr", span_r, last_r)).withColumn("kc", near("tc", span_c, last_c)).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    around = around.select(*[F.col(c).alias(f"land_{c}") for c in ("region", "kr", "kc", "share")], "tr", "tc", "at", "pixels")

    def walk(mine: pa.Table, land: pa.Table) -> pa.Table:
        kept = mine.select(names)
        if not len(mine):
            return kept.append_column("profile", pa.array([], pa.list_(SAMPLE)))
        kr, kc = mine["kr"][0].as_py(), mine["kc"][0].as_py()
        a, b = max(kr - span_r, 0), max(kc - span_c, 0)
        z = np.full(((min(kr + span_r, last_r) - a + 1) * size + 2, (min(kc + span_c, last_c) - b + 1) * size + 2), np.nan)
        for tr, tc, at, pixels in zip(land["tr"].to_pylist(), land["tc"].to_pylist(), land["at"], land["pixels"], strict=True):
            top, left = (tr - a) * size + 1, (tc - b) * size + 1
            z[top : top + size, left : left + size] = unpacked(at.values.to_numpy(), pixels.values.to_numpy(), size)
        rows = max(1, PART // max(int(np.max(mine["last"].to_numpy())) - first + 1, 1))
        found = [_samples(z, a * size, b * size, mine.slice(at, rows), grid, step, start, first, bilinear) for at in range(0, len(mine), rows)]
        return kept.append_column("profile", pa.chunked_array(found, pa.list_(SAMPLE)))

    of = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rays.schema)
    walked = placed.groupBy("region", "kr", "kc", "share").cogroup(around.groupBy("land_region", "land_kr", "land_kc", "land_share")).applyInArrow(
        walk, f"{of}, profile array<struct<k: int, z: double, rise: double>>")
    return walked.select(*names, F.inline("profile"))
