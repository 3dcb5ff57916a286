"""Morphology on sparse masks by a rectangle, in one shuffle.

A mask is a table of true pixels (region, r, c) or of disjoint runs along rows (region, r, lo, hi), ends
inclusive. It is dealt to tiles of TILE by TILE pixels; pixels near a border go to the neighbours too, as far as
all steps together can reach (the halo), so the result does not depend on the tiles. A task lays out one tile at a time, applies all steps
by running counts along each axis, whatever the size of the element, and gives back runs.

An element of h pixels has h//2 pixels before its centre and h-1-h//2 after it. An erosion keeps
pixels whose whole element is in the mask; a dilation spreads each pixel over its element. The two
are adjoint, so a closing contains its mask (away from the map's edge) and an opening lies within
it, for even sizes too. Outside the map is false in both, so a closing loses ground at the edge.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TILE = 1024
Step = tuple[str, int, int]  # "grow" or "thin", rows, columns


def element_pixels(km: float, cell_m: float) -> int:
    return max(1, int(km * 1000 / cell_m))


def runs(mask: DataFrame, across: str = "r", along: str = "c") -> DataFrame:
    """(region, across, lo, hi): the maximal stretches of true pixels along one axis."""
    w = Window.partitionBy("region", across).orderBy(along)
    keyed = mask.select("region", across, along, (F.col(along) - F.row_number().over(w)).alias("g"))
    return keyed.groupBy("region", across, "g").agg(F.min(along).alias("lo"), F.max(along).alias("hi")).drop("g")


def pixels(stretches: DataFrame, *more: str) -> DataFrame:
    """The pixels (region, r, c) of runs, with the columns `more`."""
    return stretches.select("region", "r", F.explode(F.sequence("lo", "hi")).alias("c"), *more)


def downsampled(stretches: DataFrame, factor: int) -> DataFrame:
    """Runs of the map of every factor-th row and column; pieces that touch stay pieces."""
    lo, hi = F.expr(f"int((lo + {factor - 1}) div {factor})"), F.expr(f"int(hi div {factor})")
    some = stretches.where(F.col("r") % factor == 0)
    return some.select("region", F.expr(f"int(r div {factor})").alias("r"), lo.alias("lo"), hi.alias("hi")).where("lo <= hi")


def count(stretches: DataFrame) -> DataFrame:
    """One row: n, the pixels of runs."""
    return stretches.agg(F.coalesce(F.sum(F.col("hi") - F.col("lo") + 1), F.lit(0)).cast("long").alias("n"))


def _window(grid: np.ndarray, before: int, after: int, axis: int) -> np.ndarray:
    """True pixels from `before` before to `after` after each pixel."""
    n = grid.shape[axis]
    upto = np.concatenate([np.zeros_like(grid.take([0], axis), dtype=np.int32), np.cumsum(grid, axis=axis, dtype=np.int32)], axis=axis)
    at = np.arange(n)
    return upto.take(np.minimum(at + after + 1, n), axis) - upto.take(np.maximum(at - before, 0), axis)


def _step(grid: np.ndarray, step: Step) -> np.ndarray:
    kind, *sizes = step
    for axis, h in enumerate(sizes):
        before, after = h // 2, h - 1 - h // 2
        if h > 1:
            grid = _window(grid, after, before, axis) > 0 if kind == "grow" else _window(grid, before, after, axis) == h
    return grid


def tiled(mask: DataFrame, steps: list[Step], rows: int, cols: int, tile: int = TILE, keep: list[int] | None = None) -> DataFrame:
    """(region, step, r, lo, hi): runs, cut at the tiles, after each step whose number is in `keep` (the last if
    none is named)."""
    keep = [len(steps) - 1] if keep is None else keep
    halo_r, halo_c = sum(h for _, h, _ in steps), sum(w for _, _, w in steps)
    tile = max(tile, 2 * halo_r, 2 * halo_c)  # else most of a tile is halo
    stretches = mask if "lo" in mask.columns else mask.select("region", "r", F.col("c").alias("lo"), F.col("c").alias("hi"))
    reach = lambda lo, hi, halo, n: F.sequence(F.expr(f"int(greatest({lo} - {halo}, 0) div {tile})"), F.expr(f"int(least({hi} + {halo}, {n - 1}) div {tile})"))
    dealt = stretches.select("region", "r", "lo", "hi", F.explode(reach("r", "r", halo_r, rows)).alias("tr")).withColumn("tc", F.explode(reach("lo", "hi", halo_c, cols)))

    def of(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        region, tr, tc = key
        r0, c0 = tr * tile - halo_r, tc * tile - halo_c
        shape = (tile + 2 * halo_r, tile + 2 * halo_c)
        r = part["r"].to_numpy() - r0
        lo, hi = np.maximum(part["lo"].to_numpy() - c0, 0), np.minimum(part["hi"].to_numpy() - c0, shape[1] - 1)
        edges = np.zeros((shape[0], shape[1] + 1), dtype=np.int32)
        np.add.at(edges, (r, lo), 1)
        np.add.at(edges, (r, hi + 1), -1)
        grid = np.cumsum(edges, axis=1)[:, :-1] > 0
        inside = np.ix_(*[(at >= 0) & (at < n) for at, n in ((np.arange(shape[0]) + r0, rows), (np.arange(shape[1]) + c0, cols))])
        on_map = np.zeros(shape, dtype=bool)
        on_map[inside] = True
        out = []
        for k, step in enumerate(steps):
            grid = _step(grid, step) & on_map
            if k in keep:
                own = np.zeros((tile, tile + 2), dtype=np.int8)
                own[:, 1:-1] = grid[halo_r : halo_r + tile, halo_c : halo_c + tile]
                turn = np.diff(own, axis=1)
                (y, x), ends = np.nonzero(turn == 1), np.nonzero(turn == -1)[1]
                out.append(pd.DataFrame({"region": region, "step": k, "r": y + tr * tile, "lo": x + tc * tile, "hi": ends - 1 + tc * tile}))
        return pd.concat(out)

    return dealt.groupBy("region", "tr", "tc").applyInPandas(of, "region string, step int, r int, lo int, hi int")


def _applied(mask: DataFrame, kinds: str, h: int, w: int, rows: int, cols: int) -> DataFrame:
    return pixels(tiled(mask, [(kind, h, w) for kind in kinds.split()], rows, cols))


def dilate(mask: DataFrame, h: int, w: int, rows: int, cols: int) -> DataFrame:
    return _applied(mask, "grow", h, w, rows, cols)


def erode(mask: DataFrame, h: int, w: int, rows: int, cols: int) -> DataFrame:
    return _applied(mask, "thin", h, w, rows, cols)


def close_gaps(mask: DataFrame, h: int, w: int, rows: int, cols: int) -> DataFrame:
    return _applied(mask, "grow thin", h, w, rows, cols)


def prune(mask: DataFrame, h: int, w: int, rows: int, cols: int) -> DataFrame:
    return _applied(mask, "thin grow", h, w, rows, cols)


def cleaned(mask: DataFrame, gap: tuple[int, int], width: tuple[int, int], rows: int, cols: int, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Runs of the mask closed by the element `gap`, and of that opened by `width`, both from one shuffle."""
    both = tiled(mask, [("grow", *gap), ("thin", *gap), ("thin", *width), ("grow", *width)], rows, cols, tile, [1, 3])
    return tuple(both.where(F.col("step") == k).drop("step") for k in (1, 3))


def stride_check(params: DataFrame) -> DataFrame:
    """`params(run, stride, cell_y_m, gap_close_km, spacing_km)`: whether the gap a stride leaves
    outruns the element that closes it."""
    gap = F.col("stride") * F.col("cell_y_m")
    element = F.coalesce("gap_close_km", "spacing_km") * 1000
    return params.select("run", gap.alias("gap_m"), element.alias("element_m"), F.expr("try_divide(stride * cell_y_m, coalesce(gap_close_km, spacing_km) * 1000)").alias("ratio"),
                         ((F.col("stride") > 1) & (gap > element)).alias("outruns"))
