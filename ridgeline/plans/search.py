"""The whole search: screen, scan, score cut, clean, label, pack, select."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline import stages
from ridgeline.operators import bulk_scan, scan, scores
from ridgeline.operators import explain as X
from ridgeline.operators import masks as K
from ridgeline.operators import screening as S
from ridgeline.operators import sites as G
from ridgeline.plans.arrival import BINS, BX, BY, BZ, FIELD, candidates
from ridgeline.plans.base import query
from ridgeline.sources import fixtures
from ridgeline.sources.fixtures import Grid
from ridgeline.sources.tables import downsample, stage


@dataclass(frozen=True)
class Surroundings:
    """Tables beside the terrain: road_dist(region, r, c, dist_m), circles(zone_id, zr, zc, radius_m) and
    polygons(zone_id, verts), in pixels."""

    road_dist: DataFrame | None = None
    circles: DataFrame | None = None
    polygons: DataFrame | None = None


@dataclass(frozen=True)
class SearchParams:
    min_slope: float = 3.0
    max_slope: float = 25.0
    min_altitude: float | None = None
    max_altitude: float | None = None
    min_aspect: float | None = None
    max_aspect: float | None = None
    max_road_km: float | None = None
    stride: int = 5
    tile: int = 2048
    scan: scan.ScanParams = field(default_factory=scan.ScanParams)
    score: scores.ScoreConfig = field(default_factory=scores.ScoreConfig)
    min_score: float = 0.0
    top_percent: float | None = None
    spacing_km: float = 1.0
    gap_close_km: float | None = None
    min_width_km: float = 2.0
    downsample: int = 4
    hexagonal: bool = True
    distributed: bool = True
    target: int = 10_000
    min_sub_array: int = 500
    stop_at_target: bool = False
    bulk: bool = True
    origin: tuple[float, float] | None = None


#: Observables whose distribution each site reports.
REPORTED = ["solid_angle_sr", "mean_distance_m", "max_depth_gcm2", "horizon_deg", "altitude_m"]


def screened(dem: DataFrame, grid: Grid, p: SearchParams, around: Surroundings) -> tuple[DataFrame, DataFrame]:
    """Ground that passes all cuts, with its aspect, and the counts (pos, stage, n) of the cuts: one pass
    for all that a pixel tells of itself, then the zones."""
    ground = S.gradients(dem, grid.cell_y, grid.cell_x)
    cuts = [(stages.DEM, F.lit(True)), (stages.FINITE, F.col("z").isNotNull()), (stages.SLOPE, S.slope_band(p.min_slope, p.max_slope))]
    if p.min_altitude is not None or p.max_altitude is not None:
        cuts.append((stages.ALTITUDE, S.altitude_band(p.min_altitude, p.max_altitude)))
    if p.min_aspect is not None and p.max_aspect is not None:
        cuts.append((stages.ASPECT, S.aspect_band(S.aspect_deg(), p.min_aspect, p.max_aspect)))
    if p.max_road_km is not None and around.road_dist is not None:
        ground = ground.join(around.road_dist.select("region", "r", "c", "dist_m"), ["region", "r", "c"], "left")
        cuts.append((stages.ROAD, F.col("dist_m") <= p.max_road_km * 1000))
    counts = S.funnel(cuts, ground).select("pos", "stage", "n")
    passed = ground
    for _, test in cuts[1:]:
        passed = passed.where(test)
    passed = passed.select("region", "r", "c", S.aspect_deg().alias("aspect"))
    if around.circles is None and around.polygons is None:
        return passed, counts
    if around.circles is not None:
        passed = S.outside_circles(passed, around.circles, grid.cell_y, grid.cell_x)
    if around.polygons is not None:
        passed = S.outside_polygons(passed, around.polygons)
    passed = stage(passed, "screened")
    return passed, counts.unionByName(_counted(passed, len(cuts), stages.ZONES))


def _counted(rows: DataFrame, pos: int, name: str) -> DataFrame:
    """Rows, or pixels of runs."""
    n = K.count(rows) if "lo" in rows.columns else rows.agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.lit(pos).alias("pos"), F.lit(name).alias("stage"), "n")


def scanned(dem: DataFrame, grid: Grid, p: SearchParams, around: Surroundings = Surroundings()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates kept by the stride, their observables, and the counts of the screen: what no setting of LATE changes."""
    passed, counts = screened(dem, grid, p, around)
    kept = S.thin(passed, p.stride, p.tile)
    kept = stage(kept.select("region", (F.col("r").cast("long") * grid.cols + F.col("c")).alias("cand_id"), "r", "c", "aspect"), "candidates")
    use = bulk_scan.observables if p.bulk else scan.observables
    return kept, stage(use(kept, dem, grid, p.scan), "observables"), stage(counts, "counts")


def search(dem: DataFrame, grid: Grid, p: SearchParams, around: Surroundings = Surroundings()) -> tuple[DataFrame, DataFrame]:
    """Screen, scan and what `packed` makes of them."""
    return packed(dem, grid, p, *scanned(dem, grid, p, around))


def packed(dem: DataFrame, grid: Grid, p: SearchParams, kept: DataFrame, seen: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sites (region, site_id, pixels, area_km2, capacity_exact, mean_aspect_deg, facing_direction,
    center_lat, center_lon, bounds, candidates, <observable>_mean, _p50 and _p90 of REPORTED, selected,
    viz_id, total_capacity) and the funnel (pos, stage, n, of_dem, of_prev) of `dem`."""
    directed = seen.where("cells > 0")
    later = [(stages.STRIDE, kept), (stages.DIRECTIONS, directed)]
    accepted = directed
    if p.min_score > 0 or p.top_percent is not None:
        scored = scores.score(seen, p.score, (p.scan.min_dist, p.scan.max_dist), p.scan.available_sky())
        accepted = stage(scores.cut_score(scored, p.min_score) if p.top_percent is None else scores.cut_percentile(scored, p.top_percent), "accepted")
        later.append((stages.SCORE, accepted))
    element = lambda km: (K.element_pixels(km, grid.cell_y), K.element_pixels(km, grid.cell_x))
    gap = p.spacing_km if p.gap_close_km is None else p.gap_close_km
    mask = accepted.select("region", "r", "c")
    steps = stage(K.tiled(mask, [("grow", *element(gap)), ("thin", *element(gap)), ("thin", *element(p.min_width_km / 2)), ("grow", *element(p.min_width_km / 2))],
                          grid.rows, grid.cols, keep=[1, 3]), "masks")
    closed, clean = steps.where("step = 1"), steps.where("step = 3").drop("step")
    later += [(stages.CLOSED, closed), (stages.PRUNED, clean)]
    f = p.downsample
    px_km2 = grid.cell_y * f / 1000 * grid.cell_x * f / 1000
    labels = stage(G.label_runs(K.downsampled(clean, f), grid.cols), "labels")
    threshold = p.min_sub_array if p.distributed else p.target
    need = G.required_pixels(threshold, p.spacing_km, px_km2)
    large = stage(G.areas(labels, px_km2).where(F.col("pixels") >= need), "large")
    own = stage(labels.join(large.select("region", "site_id"), ["region", "site_id"], "left_semi"), "own")
    fits = G.capacity(own, clean, f, grid.cell_y, grid.cell_x, p.spacing_km * 1000, p.hexagonal).where(F.col("capacity_exact") >= threshold)
    small = S.gradients(downsample(dem, f), grid.cell_y * f, grid.cell_x * f).select("region", "r", "c", S.aspect_deg().alias("aspect"))
    sites, key = large.join(fits, ["region", "site_id"]), ["region", "site_id"]
    sites = sites.join(G.orientation(own, small), key, "left").join(G.centres(own, fixtures.ORIGIN_LAT if p.origin is None else p.origin[0], fixtures.ORIGIN_LON if p.origin is None else p.origin[1],
                                                                               fixtures.CELL_DEG * f), key, "left")
    sites = sites.join(G.site_observables(own, accepted, f, REPORTED), key, "left")
    chosen = stage(G.select_sites(sites, p.target, p.distributed, p.stop_at_target), "sites")
    first = counts.agg(F.max("pos")).first()[0] + 1
    for k, (name, rows) in enumerate(later, start=first):
        counts = counts.unionByName(_counted(rows, k, name))
    total = chosen.where("selected").agg(F.coalesce(F.sum("pixels"), F.lit(0)).alias("n")).select(
        F.lit(first + len(later)).alias("pos"), F.lit(stages.SELECTED).alias("stage"), (F.col("n") * f * f).alias("n"))
    return chosen, S.shares(stage(counts.unionByName(total), "funnel"))


#: Settings that only stages after the scan read.
LATE = ("score", "min_score", "top_percent", "spacing_km", "gap_close_km", "min_width_km", "downsample", "hexagonal", "distributed", "target", "min_sub_array",
        "stop_at_target", "origin")


def changed(base: SearchParams, param: str, value: object) -> SearchParams:
    """`base` with a setting of the search or of its scan."""
    if param in {f.name for f in fields(SearchParams)}:
        return replace(base, **{param: value})
    return replace(base, scan=replace(base.scan, **{param: value}))


def sweep(dem: DataFrame, grid: Grid, base: SearchParams, changes: list[tuple[str, object]], around: Surroundings = Surroundings()) -> DataFrame:
    """A search for the baseline (setting 0) and for each change of one setting: setting_id, param, value
    (text), sites, capacity and area of the selection, kept, accepted, acceptance, and capacity_ratio to
    the baseline (null if that is 0). Settings that share a screen and scan share its tables."""
    settings = [("baseline", None, base)] + [(name, value, changed(base, name, value)) for name, value in changes]
    ground, rows = {}, []
    for k, (name, value, p) in enumerate(settings):
        early = repr(replace(p, **{f: getattr(base, f) for f in LATE}))
        if early not in ground:
            ground[early] = scanned(dem, grid, p, around)
        sites, funnel = packed(dem, grid, p, *ground[early])
        found = sites.where("selected").agg(F.count(F.lit(1)).alias("sites"), F.coalesce(F.sum("capacity_exact"), F.lit(0)).alias("capacity"),
                                            F.coalesce(F.round(F.sum("area_km2"), 6), F.lit(0.0)).alias("area_km2"))
        of = [F.lit(k).alias("setting_id"), F.lit(name).alias("param"), F.lit(None if value is None else str(value)).cast("string").alias("value")]
        account = X.run_summary(funnel.withColumn("run", F.lit(k))).select("kept", "accepted", "acceptance")
        rows.append(found.join(F.broadcast(account)).select(*of, "*"))  # one row each
    return X.relative(stage(reduce(DataFrame.unionByName, rows), "sweep"), "capacity", "capacity_ratio")


FIXTURE = SearchParams(min_slope=12, max_slope=60, max_road_km=9.5, tile=32, scan=scan.ScanParams(step=25.0), spacing_km=0.05, gap_close_km=0.3, min_width_km=0.12, downsample=2, target=100, min_sub_array=3)


def surroundings(spark: SparkSession, sf: str) -> Surroundings:
    return Surroundings(fixtures.road_distance(spark, sf), fixtures.circles(spark, sf), fixtures.polygons(spark, sf))


@query("site_search")
def site_search(spark: SparkSession, sf: str) -> DataFrame:
    return search(fixtures.dem(spark, sf), fixtures.grid(spark, sf), FIXTURE, surroundings(spark, sf))[0]


@query("search_funnel")
def search_funnel(spark: SparkSession, sf: str) -> DataFrame:
    return search(fixtures.dem(spark, sf), fixtures.grid(spark, sf), FIXTURE, surroundings(spark, sf))[1]


@query("search_sweep")
def search_sweep(spark: SparkSession, sf: str) -> DataFrame:
    changes = [("min_width_km", 0.3), ("gap_close_km", 0.0), ("min_sub_array", 30), ("max_slope", 40)]
    return sweep(fixtures.dem(spark, sf), fixtures.grid(spark, sf), FIXTURE, changes, surroundings(spark, sf))


#: Places that observables of a scan are rounded to.
PLACES = {"solid_angle_sr": 8, "mean_distance_m": 4, "max_depth_gcm2": 3, "mean_depth_gcm2": 3, "horizon_deg": 6, "target_slope_deg": 6, "geomag_solid_angle_sr": 8,
          "path_grammage_gcm2": 6, "earth_chord_gcm2": 0}


@query("bulk_scan", f"""with {BINS}, g as (select *, sin(radians(azimuth)) * cos(radians(theta)) * {BX} + cos(radians(azimuth)) * cos(radians(theta)) * {BY} + sin(radians(theta)) * {BZ} as dot from ok),
    o as (select cand_id, count(*) as cells, sum(omega) as solid_angle_sr, avg(d_hit) as mean_distance_m, max(depth) as max_depth_gcm2, avg(depth) as mean_depth_gcm2,
        avg(degrees(atan(rise))) as target_slope_deg, sum(omega * sqrt(greatest(0.0, 1 - dot * dot))) as geomag_solid_angle_sr,
        avg(1.225 * exp(-z0 / 8400.0) * 8400.0 / sin(radians(theta)) * (1 - exp(-d_hit / cos(radians(theta)) * sin(radians(theta)) / 8400.0)) * 0.1) as path_grammage_gcm2,
        avg(case when theta < 0 then 2 * 6371000.0 * sin(radians(-theta)) * 265.0 else 0 end) as earth_chord_gcm2 from g group by cand_id),
    h as (select cand_id, degrees(atan(max(top))) as horizon_deg from tops group by cand_id)
    select 'a' as region, cand_id, coalesce(cells, 0) as cells, {", ".join(f"round(coalesce({c}, 0), {n}) as {c}" for c, n in PLACES.items())}, z0 as altitude_m
    from cand left join o using (cand_id) left join h using (cand_id)""")
def bulk(spark: SparkSession, sf: str) -> DataFrame:
    o = bulk_scan.observables(candidates(spark, sf), fixtures.dem(spark, sf), fixtures.grid(spark, sf), FIELD)
    return o.select("region", "cand_id", "cells", *[F.round(c, n).alias(c) for c, n in PLACES.items()], "altitude_m")
