"""The arrival scan for many long rays: tiles of candidates meet tiles of terrain.

The join of every sample with every pixel moves a row for each sample. Here the DEM is packed
into square tiles once (an array of floats each); a tile of candidates is co-grouped with the
terrain tiles its rays can reach, and a numpy kernel walks all rays of the tile together. Pyramids of
the highest and lowest ground let a ray pass over stretches that can change nothing but a count. A group holds one candidate tile and its surroundings, whatever the size of
the region: (tile + 2 * reach)^2 floats. Results equal those of the join (tests compare them).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import physics as P
from ridgeline.operators.profiles import tile_size, tiles, unpacked
from ridgeline.operators.scan import OBSERVED, ScanParams
from ridgeline.sources.fixtures import Grid

KIND = "region string, cand_id long, r int, c int, " + ", ".join(f"{o} {'long' if o == 'cells' else 'double'}" for o in OBSERVED) + ", altitude_m double"


#: Samples of a ray that are judged together, and each into how many shorter stretches it falls.
STRETCH, SPLIT = 64, 4


class Heights:
    """A window of terrain with the highest and lowest pixel of its blocks, by levels; a block with a void has no bounds."""

    def __init__(self, z: np.ndarray, grid: Grid, step: float) -> None:
        self.z, self.levels, n = z, {}, STRETCH
        while n > SPLIT:
            size = 1
            while size < (n - 2) * step / min(grid.cell_y, grid.cell_x) + 3:  # rows or columns that n - 1 samples can touch
                size *= 2
            self.levels[n] = (size, *self._bounds(size))
            n //= SPLIT

    def _bounds(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of each four blocks whose first is at (i, j): they hold any box of `size` pixels that begins in it."""
        rows, cols = (-(-n // size) + 1 for n in self.z.shape)
        wide = np.full((rows * size, cols * size), np.nan)
        wide[: self.z.shape[0], : self.z.shape[1]] = self.z
        blocks = wide.reshape(rows, size, cols, size)
        out = []
        for pick, none in ((np.max, np.inf), (np.min, -np.inf)):
            one = pick(blocks, axis=(1, 3))
            one[np.isnan(one)] = none
            four = np.full((rows, cols), none)
            four[:-1, :-1] = pick([one[:-1, :-1], one[1:, :-1], one[:-1, 1:], one[1:, 1:]], axis=0)
            out.append(four)
        return out[0], out[1]


def walk(heights: Heights, r0: int, c0: int, cand: pd.DataFrame, grid: Grid, p: ScanParams, read: list[int] | None = None) -> pd.DataFrame:
    """Observables of all candidates of a tile over a window whose first pixel is (r0, c0).

    A stretch of samples is passed over if the highest and lowest ground near it put all its slopes into one elevation bin that the ray
    has hit before (or below all bins): then it adds its length to the bin's count and nothing else. Its last
    two samples are always taken, as a hit in the last or after it needs the height before. All other stretches are split, at last into single samples.
    A stretch that may hold the ray's horizon is looked at again in the end, if its highest ground still passes the horizon
    found. `read` gets the numbers of samples taken."""
    n, n_az, step, z = len(cand), p.azimuths, p.step_m(grid), heights.z
    row, col = np.repeat(cand["r"].to_numpy(np.int64), n_az), np.repeat(cand["c"].to_numpy(np.int64), n_az)
    azimuth = np.tile(np.array(p.offsets()), n) + (np.repeat(cand["aspect"].to_numpy(float), n_az) if p.use_aspect else 0)
    sin, cos = np.sin(np.radians(azimuth)), np.cos(np.radians(azimuth))
    start = z[row - r0, col - c0]
    edges = np.array([p.edge(b) for b in range(p.bins)])
    first, rise = np.full((p.bins, n * n_az), np.inf), np.zeros((p.bins, n * n_az))
    count = np.zeros((p.bins + 1, n * n_az), dtype=np.int64)
    top, before = np.full(n * n_az, -np.inf), np.full(n * n_az, np.nan)
    highest = np.zeros(n * n_az, dtype=np.int64)  # bins already hit
    last = int(p.max_range / step + 1e-9)

    def place(k: int, rays: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pixels and exact places of sample k, and which are on the map."""
        d = k * step
        fc, fr = d * sin[rays] / grid.cell_x, d * cos[rays] / grid.cell_y
        tc, tr = col[rays] + np.trunc(fc).astype(np.int64), row[rays] - np.trunc(fr).astype(np.int64)
        return tr, tc, row[rays] - fr, col[rays] + fc, (tc >= 0) & (tc < grid.cols) & (tr >= 0) & (tr < grid.rows)

    def seen(k: int, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the rays whose sample k is on the map, the heights there."""
        tr, tc, fr, fc, on = place(k, live)
        live, tc, tr, fc, fr = live[on], tc[on], tr[on], fc[on], fr[on]
        if read is not None:
            read.append(len(live))
        h = z[tr - r0, tc - c0]
        if p.bilinear and len(live):
            ri, ci = np.floor(fr).astype(np.int64), np.floor(fc).astype(np.int64)
            inside = (ri >= 0) & (ri + 1 < grid.rows) & (ci >= 0) & (ci + 1 < grid.cols)
            a, b = ri[inside] - r0, ci[inside] - c0
            u, v = (fc - ci)[inside], (fr - ri)[inside]
            mixed = (1 - v) * ((1 - u) * z[a, b] + u * z[a, b + 1]) + v * ((1 - u) * z[a + 1, b] + u * z[a + 1, b + 1])
            h[inside] = np.where(np.isnan(mixed), h[inside], mixed)
        return live, h

    def sample(k: int, live: np.ndarray) -> np.ndarray:
        """Takes sample k of the rays and returns those still on the map."""
        d = k * step
        live, h = seen(k, live)
        known = ~np.isnan(h)
        at, h = live[known], h[known]
        slope = (h - d * d * (1 / (2 * p.earth_radius)) - start[at]) / d
        top[at] = np.maximum(top[at], slope)
        reached = np.searchsorted(edges, slope, side="right")  # bins whose lower edge is reached
        some = reached > 0
        count[reached[some] - 1, at[some]] += 1  # each ray once
        fresh = reached > highest[at]
        if fresh.any():
            who, upto = at[fresh], reached[fresh]
            up = (h[fresh] - before[who]) / step
            up[np.isnan(up)] = 0
            for b in range(p.bins):
                new = (highest[who] <= b) & (upto > b)
                first[b, who[new]], rise[b, who[new]] = d, up[new]
            highest[who] = upto
        before[at] = h
        return live

    def passed(k: int, size: int, rays: np.ndarray) -> np.ndarray:
        """Which rays need no sample of k .. k + size - 3, and know the next; their counts are added."""
        block, above, below = heights.levels[size]
        _, _, fr, fc, _ = place(k, rays)
        _, _, gr, gc, on = place(k + size - 2, rays)
        i, j = ((np.floor(np.minimum(x, y)).astype(np.int64) - at) // block for x, y, at in ((fr, gr, r0), (fc, gc, c0)))
        on &= (i >= 0) & (j >= 0) & (i < above.shape[0]) & (j < above.shape[1])
        i, j, near, far = np.where(on, i, 0), np.where(on, j, 0), k * step, (k + size - 3) * step
        high, low = above[i, j] - start[rays], below[i, j] - start[rays]
        # slack for the rounding of interpolated heights
        high = np.maximum(high / near, high / far) - near / (2 * p.earth_radius) + 1e-9
        low = np.minimum(low / near, low / far) - far / (2 * p.earth_radius) - 1e-9
        reached = np.searchsorted(edges, high, side="right")
        ok = on & (reached <= highest[rays]) & (reached == np.searchsorted(edges, low, side="right"))
        count[reached[ok & (reached > 0)] - 1, rays[ok & (reached > 0)]] += size - 2
        above_top = ok & (high > top[rays])
        if above_top.any():
            later.append((k, size, rays[above_top], high[above_top]))
        return ok

    def go(k: int, size: int, rays: np.ndarray) -> np.ndarray:
        """Samples k .. k + size - 1."""
        if size > SPLIT and k + size - 1 <= last and len(rays):
            ok = passed(k, size, rays)
            done, rays = sample(k + size - 1, sample(k + size - 2, rays[ok])), rays[~ok]
        else:
            done = rays[:0]
        part = size // SPLIT if size > SPLIT else 1
        for at in range(k, min(k + size, last + 1), part):
            if not len(rays):
                break
            rays = go(at, part, rays) if part > 1 else sample(at, rays)
        return np.concatenate([done, rays])

    later: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    live = np.nonzero(~np.isnan(start))[0]
    for k in range(1, last + 1, STRETCH):
        if not len(live):
            break
        live = go(k, STRETCH, live)
    for k, size, rays, high in later:
        rays = rays[high > top[rays]]
        for at in range(k, k + size - 2) if len(rays) else ():
            on, h = seen(at, rays)
            top[on] = np.fmax(top[on], (h - (at * step) ** 2 * (1 / (2 * p.earth_radius)) - start[on]) / (at * step))
    column = np.cumsum(count[::-1], axis=0)[::-1][: p.bins]  # samples at or above each edge
    theta = np.radians([p.theta(b) for b in range(p.bins)])[:, None]
    ok = accepted(first, rise, column * step / np.cos(theta) * p.rock_density * 0.1, p) & ~np.isnan(start)[None, :]
    best = np.zeros(n)
    if p.frequency_mhz:
        best = clearance(z, r0, c0, row, col, sin, cos, start, first, ok, grid, p).reshape(p.bins, n, n_az).max(axis=(0, 2))
    return summarise(cand, start, azimuth, first, rise, column, top, ok, best, p, step)


def accepted(first: np.ndarray, rise: np.ndarray, depth: np.ndarray, p: ScanParams) -> np.ndarray:
    ok = (first >= p.min_dist) & (first <= p.max_dist) & (depth >= p.min_depth)
    if p.min_target_slope is not None:
        ok &= rise >= math.tan(math.radians(p.min_target_slope))
    if p.max_target_slope is not None and p.max_target_slope < 90:
        ok &= rise <= math.tan(math.radians(p.max_target_slope))
    return ok


def clearance(z: np.ndarray, r0: int, c0: int, row: np.ndarray, col: np.ndarray, sin: np.ndarray, cos: np.ndarray, start: np.ndarray, first: np.ndarray, ok: np.ndarray,
              grid: Grid, p: ScanParams) -> np.ndarray:
    """(bins, rays): the smallest Fresnel ratio along the path of each accepted cell, 0 for others."""
    step = p.step_m(grid)
    near, wavelength = max(step, p.near_field), P.LIGHT_SPEED / (p.frequency_mhz * 1e6)
    bins, rays = np.nonzero(ok)
    end = first[bins, rays] - p.shower_offset
    rise = np.tan(np.radians([p.theta(b) for b in range(p.bins)]))[bins]
    worst = np.full(len(bins), 1e30)
    live = np.nonzero((end > 2 * step) & (near <= end))[0]
    d = near
    while len(live):
        who = rays[live]
        tc, tr = col[who] + np.trunc(d * sin[who] / grid.cell_x).astype(np.int64), row[who] - np.trunc(d * cos[who] / grid.cell_y).astype(np.int64)
        on = (tc >= 0) & (tc < grid.cols) & (tr >= 0) & (tr < grid.rows)
        live, who, tc, tr = live[on], who[on], tc[on], tr[on]
        h = z[tr - r0, tc - c0]
        zone = np.sqrt(wavelength * d * (end[live] - d) / end[live])
        gap = start[who] + p.antenna_height + d * rise[live] - (h - d * d / (2 * p.radio_earth_radius))
        use = ~np.isnan(h) & (zone > 0)
        worst[live[use]] = np.minimum(worst[live[use]], gap[use] / zone[use])
        d += step
        live = live[d <= end[live]]
    found = np.zeros(ok.shape)
    found[bins, rays] = worst
    return np.where(ok, found, -np.inf if ok.any() else 0.0)


def summarise(cand: pd.DataFrame, start: np.ndarray, azimuth: np.ndarray, first: np.ndarray, rise: np.ndarray, column: np.ndarray, top: np.ndarray, ok: np.ndarray,
              clear: np.ndarray, p: ScanParams, step: float) -> pd.DataFrame:
    n, shape = len(cand), (p.bins, len(cand), p.azimuths)
    theta = np.radians([p.theta(b) for b in range(p.bins)])[:, None]
    depth = column * step / np.cos(theta) * p.rock_density * 0.1
    total = lambda x: np.where(ok, x, 0).reshape(shape).sum(axis=(0, 2))
    cells = ok.reshape(shape).sum(axis=(0, 2))
    mean = lambda x: np.divide(total(x), cells, out=np.zeros(n), where=cells > 0)
    omega = np.cos(theta) * math.radians(p.bin_deg) * math.radians(p.span) / p.azimuths + 0 * first.clip(max=1)
    alpha = np.ones_like(omega)
    if p.field:
        d, i = np.radians(p.field)
        look = np.radians(azimuth)[None, :]
        dot = np.sin(look) * np.cos(theta) * math.cos(i) * math.sin(d) + np.cos(look) * np.cos(theta) * math.cos(i) * math.cos(d) - np.sin(theta) * math.sin(i)
        alpha = np.sqrt(np.maximum(0, 1 - dot * dot))
    far = np.where(np.isfinite(first), first, 0) / np.cos(theta)
    base = P.SEA_LEVEL_DENSITY * np.exp(-np.nan_to_num(start) / P.SCALE_HEIGHT)[None, :]
    sine = np.where(np.abs(np.sin(theta)) < 1e-9, np.nan, np.sin(theta))
    gram = np.where(np.isnan(sine), base * far, base * (P.SCALE_HEIGHT / np.nan_to_num(sine, nan=1)) * (1 - np.exp(-far * np.nan_to_num(sine) / P.SCALE_HEIGHT))) * 0.1
    chord = np.where(theta < 0, 2 * p.earth_radius * np.sin(-theta) * 100 * P.CRUST_DENSITY, 0) + 0 * base
    best = top.reshape(n, p.azimuths).max(axis=1)
    z0 = start.reshape(n, p.azimuths)[:, 0]
    return pd.DataFrame({
        "region": cand["region"].to_numpy(), "cand_id": cand["cand_id"].to_numpy(), "r": cand["r"].to_numpy(), "c": cand["c"].to_numpy(), "cells": cells, "solid_angle_sr": total(omega),
        "mean_distance_m": mean(np.where(np.isfinite(first), first, 0)), "max_depth_gcm2": np.where(ok, depth, 0).reshape(shape).max(axis=(0, 2)), "mean_depth_gcm2": mean(depth),
        "horizon_deg": np.where(np.isfinite(best), np.degrees(np.arctan(np.where(np.isfinite(best), best, 0))), 0), "best_clearance_ratio": np.where(np.isfinite(clear), clear, 0.0), "geomag_solid_angle_sr": total(omega * alpha),
        "path_grammage_gcm2": mean(gram), "earth_chord_gcm2": mean(chord), "target_slope_deg": mean(np.degrees(np.arctan(rise))), "altitude_m": [None if np.isnan(x) else x for x in z0]})


def observables(candidates: DataFrame, dem: DataFrame, grid: Grid, p: ScanParams, size: int | None = None) -> DataFrame:
    """As scan.observables. The tile is fitted to the reach of a ray if no size is given."""
    reach_r, reach_c = (math.ceil(p.max_range / cell) + 1 for cell in (grid.cell_y, grid.cell_x))
    size = size or tile_size(max(reach_r, reach_c))
    span_r, span_c = -(-reach_r // size), -(-reach_c // size)
    last_r, last_c = (grid.rows - 1) // size, (grid.cols - 1) // size
    near = lambda c, span, last: F.explode(F.sequence(F.greatest(F.col(c) - span, F.lit(0)), F.least(F.col(c) + span, F.lit(last))))
    packed = tiles(dem, size)
    around = packed.withColumn("kr", near("tr", span_r, last_r)).withColumn("kc", near("tc", span_c, last_c))
    placed = candidates.withColumn("kr", F.expr(f"r div {size}")).withColumn("kc", F.expr(f"c div {size}"))
    used = placed.select("region", "kr", "kc").distinct()
    around = around.join(used, ["region", "kr", "kc"], "left_semi").select(*[F.col(c).alias(f"land_{c}") for c in ("region", "kr", "kc")], "tr", "tc", "at", "pixels")

    def scan(key: tuple, cand: pd.DataFrame, land: pd.DataFrame) -> pd.DataFrame:
        if not len(cand):
            return pd.DataFrame(columns=[c.split(" ")[0] for c in KIND.split(", ")])
        kr, kc = int(cand["kr"].iloc[0]), int(cand["kc"].iloc[0])
        a, b = max(kr - span_r, 0), max(kc - span_c, 0)
        z = np.full(((min(kr + span_r, last_r) - a + 1) * size, (min(kc + span_c, last_c) - b + 1) * size), np.nan)
        for tr, tc, at, pixels in zip(land["tr"], land["tc"], land["at"], land["pixels"], strict=True):
            z[(tr - a) * size : (tr - a + 1) * size, (tc - b) * size : (tc - b + 1) * size] = unpacked(at, pixels, size)
        heights = Heights(z, grid, p.step_m(grid))
        return pd.concat([walk(heights, a * size, b * size, part, grid, p) for part in _parts(cand)])

    return placed.groupBy("region", "kr", "kc").cogroup(around.groupBy("land_region", "land_kr", "land_kc")).applyInPandas(scan, KIND)


def _parts(cand: pd.DataFrame, rows: int = 4096) -> Iterator[pd.DataFrame]:
    for at in range(0, len(cand), rows):
        yield cand.iloc[at : at + rows]
