"""The arrival scan: rays from every candidate over a fan of directions, as samples and aggregates.

A ray's samples are rows; the elevation under each is found where tiles of rays meet tiles of terrain (`profiles`). For each
candidate and azimuth one conditional aggregate fills all elevation bins at once: the first hit
of a bin is the smallest distance whose apparent slope reaches the bin's lower edge, the rise
there is the rise of that sample, the column is the number of samples at or above the edge.
All are algebraic and a ray's samples arise in one task, so Spark combines them before the shuffle; no sample is
shuffled or ordered.

`candidates(region, cand_id, r, c, aspect)`; `dem(region, r, c, z)`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import physics as P
from ridgeline.operators.profiles import along
from ridgeline.sources.fixtures import Grid
from ridgeline.sources.tables import stage


@dataclass(frozen=True)
class ScanParams:
    elev_min: float = -20.0
    elev_max: float = 20.0
    bins: int = 8
    azimuths: int = 3
    half_width: float | None = 40.0
    use_aspect: bool = True
    step: float | None = None
    max_range: float = 1800.0
    min_dist: float = 300.0
    max_dist: float = 1500.0
    min_depth: float = 0.0
    min_target_slope: float | None = None
    max_target_slope: float | None = None
    rock_density: float = P.ROCK_DENSITY
    earth_radius: float = P.EARTH_RADIUS
    bilinear: bool = False
    frequency_mhz: float | None = None
    shower_offset: float = 0.0
    antenna_height: float = 2.0
    near_field: float = 100.0
    radio_earth_radius: float = P.RADIO_EARTH_RADIUS
    field: tuple[float, float] | None = None

    @property
    def bin_deg(self) -> float:
        return (self.elev_max - self.elev_min) / self.bins

    def edge(self, b: int) -> float:
        """Tangent of the lower edge of a bin: slopes are compared, no angle is taken for a sample."""
        return math.tan(math.radians(self.elev_min + b * self.bin_deg))

    def theta(self, b: int) -> float:
        return self.elev_min + (b + 0.5) * self.bin_deg

    @property
    def span(self) -> float:
        return 360.0 if self.half_width is None else 2 * self.half_width

    def step_m(self, grid: Grid) -> float:
        return self.step or min(grid.cell_y, grid.cell_x)

    def offsets(self) -> list[float]:
        """A full circle in equal steps from 0, or the centres of equal parts of the arc."""
        n = self.azimuths
        if self.half_width is None:
            return [360.0 * k / n for k in range(n)]
        return [0.0] if n == 1 else [-self.half_width + self.half_width / n * (2 * k + 1) for k in range(n)]

    def available_sky(self) -> float:
        return math.radians(self.span) * (math.sin(math.radians(self.elev_max)) - math.sin(math.radians(self.elev_min)))


def fan(candidates: DataFrame, p: ScanParams) -> DataFrame:
    """Adds az and azimuth, one row for each direction."""
    offset = F.posexplode(F.array(*map(F.lit, p.offsets()))).alias("az", "offset")
    azimuth = F.col("offset") + F.col("aspect") if p.use_aspect else F.col("offset")
    return candidates.select("*", offset).withColumn("azimuth", azimuth).drop("offset")


def with_altitude(candidates: DataFrame, dem: DataFrame) -> DataFrame:
    return candidates.join(dem.withColumnRenamed("z", "z0"), ["region", "r", "c"])


def _on_map(row: str, col: str, grid: Grid) -> Column:
    return F.col(row).between(0, grid.rows - 1) & F.col(col).between(0, grid.cols - 1)


def samples(rays: DataFrame, grid: Grid, p: ScanParams) -> DataFrame:
    """Adds d, fr, fc and the pixel (tr, tc) under each sample; a straight ray never re-enters the map."""
    step = p.step_m(grid)
    steps = steps_of(p, grid)
    look = F.radians("azimuth")
    out = rays.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(steps)))).withColumn("d", F.col("k") * F.lit(step))
    dc, dr = F.col("d") * F.sin(look) / grid.cell_x, F.col("d") * F.cos(look) / grid.cell_y
    out = out.withColumn("tc", F.col("c") + dc.cast("int")).withColumn("tr", F.col("r") - dr.cast("int"))
    return out.withColumn("fc", F.col("c") + dc).withColumn("fr", F.col("r") - dr).where(_on_map("tr", "tc", grid))


def nearest(points: DataFrame, dem: DataFrame) -> DataFrame:
    """Adds the elevation z of pixel (tr, tc); points over voids are dropped."""
    under = dem.where("z is not null").select("region", F.col("r").alias("tr"), F.col("c").alias("tc"), "z")
    return points.join(under, ["region", "tr", "tc"])


def apparent_slope(z: Column, d: Column, z0: Column, radius: float) -> Column:
    return (z - d * d * (1 / (2 * radius)) - z0) / d


def steps_of(p: ScanParams, grid: Grid) -> int:
    return int(p.max_range / p.step_m(grid) + 1e-9)


def seen(candidates: DataFrame, dem: DataFrame, grid: Grid, p: ScanParams) -> DataFrame:
    """Samples with z, slope and rise (from the last known sample; one step whatever the gap)."""
    step, steps = p.step_m(grid), steps_of(p, grid)
    points = along(fan(candidates, p), dem, grid, step, p.max_range, F.lit(steps), p.azimuths * steps, bilinear=p.bilinear).withColumn("d", F.col("k") * F.lit(step))
    return points.withColumn("slope", apparent_slope(F.col("z"), F.col("d"), F.col("z0"), p.earth_radius))


def cells(points: DataFrame, grid: Grid, p: ScanParams) -> DataFrame:
    """One row for each candidate, azimuth and bin: d_hit, rise, depth and the azimuth's horizon slope."""
    slope, aggs = F.col("slope"), [F.max("slope").alias("top")]
    for b in range(p.bins):
        at = slope >= p.edge(b)
        aggs += [F.min(F.when(at, F.col("d"))).alias(f"d{b}"), F.min_by("rise", F.when(at, F.col("d"))).alias(f"s{b}"), F.count_if(at).alias(f"n{b}")]
    rays = points.groupBy("region", "cand_id", "az", "azimuth", "z0").agg(*aggs)
    per_bin = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(p.theta(b)).alias("theta"), F.col(f"d{b}").alias("d_hit"), F.col(f"s{b}").alias("rise"),
                                 (F.col(f"n{b}") * p.step_m(grid) / math.cos(math.radians(p.theta(b))) * p.rock_density * 0.1).alias("depth")) for b in range(p.bins)])
    return rays.select("region", "cand_id", "az", "azimuth", "z0", "top", F.inline(per_bin))


def acceptance(p: ScanParams) -> Column:
    """Within the distance window, deep enough, target slope in its band (tangents)."""
    tan = lambda x: math.tan(math.radians(x))
    test = F.col("d_hit").between(p.min_dist, p.max_dist) & (F.col("depth") >= p.min_depth)
    if p.min_target_slope is not None:
        test = test & (F.col("rise") >= tan(p.min_target_slope))
    if p.max_target_slope is not None and p.max_target_slope < 90:
        test = test & (F.col("rise") <= tan(p.max_target_slope))
    return test


def accepted(per_bin: DataFrame, p: ScanParams) -> DataFrame:
    return per_bin.where(acceptance(p))


def open_cells(rays: DataFrame, per_bin: DataFrame, p: ScanParams) -> DataFrame:
    """Open-sky mode: the bins of each direction that nothing reaches."""
    every = rays.select("region", "cand_id", "az", F.inline(F.array(*[F.struct(F.lit(b).alias("b"), F.lit(p.theta(b)).alias("theta")) for b in range(p.bins)])))
    return every.join(per_bin.where("d_hit is not null"), ["region", "cand_id", "az", "b"], "left_anti")


def solid_angle(theta: Column, p: ScanParams) -> Column:
    return F.cos(F.radians(theta)) * (math.radians(p.bin_deg) * math.radians(p.span) / p.azimuths)


def clearance(hits: DataFrame, candidates: DataFrame, dem: DataFrame, grid: Grid, p: ScanParams) -> DataFrame:
    """Best Fresnel clearance of each candidate: over its accepted cells the largest of the
    smallest ratio along the path. Samples start at the near field, not at one step."""
    step = p.step_m(grid)
    wavelength = P.LIGHT_SPEED / (p.frequency_mhz * 1e6)
    start = max(step, p.near_field)
    path = hits.select("region", "cand_id", "azimuth", "az", "b", "theta", (F.col("d_hit") - p.shower_offset).alias("end"))
    short = F.col("end") <= 2 * step
    path = path.join(candidates.select("region", "cand_id", "r", "c", "z0"), ["region", "cand_id"])
    count = F.greatest(F.floor((F.col("end") - start) / step + 1e-9).cast("int"), F.lit(-1))
    per_pixel = p.azimuths * p.bins * steps_of(p, grid)
    points = along(path.where(~short & (count >= 0)), dem, grid, step, p.max_range + abs(p.shower_offset), count, per_pixel, start, 0)
    points = points.withColumn("d", start + F.col("k") * step).where("d <= end")
    gap = F.col("z0") + p.antenna_height + F.col("d") * F.tan(F.radians("theta")) - (F.col("z") - F.col("d") * F.col("d") / (2 * p.radio_earth_radius))
    r1 = F.sqrt(wavelength * F.col("d") * (F.col("end") - F.col("d")) / F.col("end"))
    worst = points.where(r1 > 0).groupBy("region", "cand_id", "az", "b").agg(F.min(gap / r1).alias("worst"))
    return path.join(worst, ["region", "cand_id", "az", "b"], "left").groupBy("region", "cand_id").agg(
        F.max(F.coalesce("worst", F.lit(1e30))).alias("best_clearance_ratio"))


OBSERVED = ["cells", "solid_angle_sr", "mean_distance_m", "max_depth_gcm2", "mean_depth_gcm2", "horizon_deg", "best_clearance_ratio", "geomag_solid_angle_sr",
            "path_grammage_gcm2", "earth_chord_gcm2", "target_slope_deg"]


def observables(candidates: DataFrame, dem: DataFrame, grid: Grid, p: ScanParams) -> DataFrame:
    """All observables of each candidate; 0 where nothing is accepted."""
    candidates = with_altitude(candidates, dem)
    known = candidates.where("z0 is not null")
    per_bin = cells(seen(known, dem, grid, p), grid, p)
    if p.frequency_mhz:  # two passes read them
        per_bin, known = stage(per_bin, "cells"), stage(known, "known")
    hits = accepted(per_bin, p)
    omega = solid_angle(F.col("theta"), p)
    alpha = P.sin_alpha(F.col("azimuth"), F.col("theta"), P.field_vector(*p.field)) if p.field else F.lit(1.0)
    hit = F.col("hit")
    chord = F.when(F.col("theta") < 0, 2 * p.earth_radius * F.sin(F.radians(-F.col("theta"))) * 100 * P.CRUST_DENSITY).otherwise(0.0)
    when = lambda x: F.when(hit, x)
    found = per_bin.withColumn("hit", F.coalesce(acceptance(p), F.lit(False))).groupBy("region", "cand_id").agg(
        F.count_if(hit).alias("cells"), F.sum(when(omega)).alias("solid_angle_sr"), F.avg(when(F.col("d_hit"))).alias("mean_distance_m"),
        F.max(when(F.col("depth"))).alias("max_depth_gcm2"), F.avg(when(F.col("depth"))).alias("mean_depth_gcm2"), F.degrees(F.atan(F.max("top"))).alias("horizon_deg"),
        F.sum(when(omega * alpha)).alias("geomag_solid_angle_sr"), F.avg(when(P.slant_grammage(F.col("z0"), F.col("theta"), F.col("d_hit")))).alias("path_grammage_gcm2"),
        F.avg(when(chord)).alias("earth_chord_gcm2"), F.avg(when(F.degrees(F.atan("rise")))).alias("target_slope_deg"))
    if p.frequency_mhz:
        found = found.join(clearance(hits, known, dem, grid, p), ["region", "cand_id"], "left")
    else:
        found = found.withColumn("best_clearance_ratio", F.lit(0.0))
    every = candidates.join(found, ["region", "cand_id"], "left")
    return every.select("region", "cand_id", "r", "c", *[F.coalesce(F.col(o), F.lit(0)).cast("long" if o == "cells" else "double").alias(o) for o in OBSERVED],
                        F.col("z0").alias("altitude_m"))
