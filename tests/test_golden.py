"""Whole searches on analytic terrain of 900 by 900 pixels against published results.

The ridge casts rays of 20 km from 115,390 candidates, which takes minutes on two cores: it runs if
RIDGELINE_GOLDEN is set. Fixed values: the published counts, areas and capacities.
"""

import math
import os

import pytest
from pyspark.sql import functions as F

from ridgeline import stages
from ridgeline.functions import physics
from ridgeline.operators import scan, scores
from ridgeline.plans import search
from ridgeline.sources.fixtures import Grid

LAT, LON, N = -15.6, -72.3, 900
CELL_Y, CELL_X = 110.6 / 3.6, 111.32 / 3.6 * math.cos(math.radians(LAT))
#: Columns are scaled at the map's centre, elevations were made at its corner.
CENTRE_X = 111.32 / 3.6 * math.cos(math.radians(LAT - N / 2 / 3600))
GRID = Grid(CELL_Y, CENTRE_X, N, N)


def pixels(spark, z):
    r = F.expr(f"int(id div {N})")
    return spark.range(N * N).select(F.lit("a").alias("region"), r.alias("r"), (F.col("id") % N).cast("int").alias("c"), z.cast("float").cast("double").alias("z"))


def ridge(spark):
    c = (F.col("id") % N).cast("double")
    return pixels(spark, F.lit(500.0) + F.greatest(c - 220, F.lit(0.0)) * 2.0 + 3500.0 * F.exp(-(c - 120) * (c - 120) / (2 * 60.0 * 60.0)))


def canyon(spark):
    from_edge = F.abs((F.col("id") % N) * CELL_X - N * CELL_X / 2) - 500.0
    rise = F.least(F.greatest(from_edge, F.lit(0.0)) * math.tan(math.radians(35.0)), F.lit(1500.0))
    return pixels(spark, F.lit(2000.0) + rise)


WIDE = {"elev_min": -3.0, "elev_max": 3.0, "bins": 12, "azimuths": 9, "half_width": 60.0, "bilinear": True}


def field(spark):
    """Declination as given, inclination of the dipole at the map's centre."""
    half = N / 2 / 3600
    return -6.9, spark.range(1).select(physics.dipole_inclination(F.lit(LAT - half), F.lit(LON + half))).first()[0]


def outcome(sites, funnel):
    chosen = [r for r in sites.collect() if r["selected"]]
    counts = {r["stage"]: r["n"] for r in funnel.collect()}
    return counts, sorted(((round(r["area_km2"], 2), r["capacity_exact"], r["facing_direction"]) for r in chosen), reverse=True)


def test_canyon_with_a_score_cut(spark):
    p = search.SearchParams(min_slope=20, max_slope=60, stride=5, tile=256, target=1000, spacing_km=0.15, min_width_km=0.0, downsample=2, min_sub_array=20, min_score=0.35, score=scores.ScoreConfig(spacing_m=150.0),
                            scan=scan.ScanParams(**WIDE | {"elev_min": -20.0, "elev_max": 20.0}, min_dist=1_000, max_dist=5_000, max_range=5_000, min_target_slope=25, field=field(spark)))
    counts, sites = outcome(*search.search(canyon(spark), GRID, p))
    assert counts == {
        stages.DEM: 810_000, stages.FINITE: 810_000, stages.SLOPE: 129_600, stages.STRIDE: 25_924, stages.DIRECTIONS: 25_924, stages.SCORE: 6_977,
        stages.CLOSED: 32_211, stages.PRUNED: 32_211, stages.SELECTED: 32_088}
    assert sites == [(15.25, 775, "W"), (14.1, 703, "E")]


@pytest.mark.skipif("RIDGELINE_GOLDEN" not in os.environ, reason="takes minutes")
def test_ridge(spark):
    p = search.SearchParams(min_slope=3, max_slope=25, stride=5, tile=256, target=100, spacing_km=1.0, min_width_km=1.0, downsample=2, min_sub_array=20,
                            scan=scan.ScanParams(**WIDE, min_dist=3_000, max_dist=20_000, max_range=20_000, field=field(spark)))
    counts, sites = outcome(*search.search(ridge(spark), GRID, p))
    assert counts == {
        stages.DEM: 810_000, stages.FINITE: 810_000, stages.SLOPE: 576_900, stages.STRIDE: 115_390, stages.DIRECTIONS: 110_707, stages.CLOSED: 520_531,
        stages.PRUNED: 520_531, stages.SELECTED: 520_260}
    assert sites == [(439.15, 512, "W"), (36.6, 47, "E")]
