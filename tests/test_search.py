"""The bulk scan against the join, and a whole search on analytic terrain."""

import math
from dataclasses import replace

from pyspark.sql import functions as F

from ridgeline.operators import bulk_scan, scan
from ridgeline.plans import search
from ridgeline.sources.fixtures import Grid

def ridge(spark, n):
    """A ridge at column 20 and ground that rises east of column 55."""
    c = F.col("id") % n
    z = 500.0 + F.greatest(c - 55, F.lit(0)) * 6.0 + 700.0 * F.exp(-(c - 20) * (c - 20) / (2 * 10.0 * 10.0))
    return spark.range(n * n).select(F.lit("a").alias("region"), F.expr(f"int(id div {n})").alias("r"), c.cast("int").alias("c"), z.alias("z"))


def test_bulk_scan_equals_the_join(spark):
    n = 60
    k = F.col("id")
    z = F.when(k % 97 != 3, 1000.0 + (k * 7919 % 17) + 9.0 * F.abs(k % n - 30))
    dem = spark.range(n * n).select(F.lit("a").alias("region"), F.expr(f"int(id div {n})").alias("r"), (k % n).cast("int").alias("c"), z.alias("z"))
    cand = dem.where("(r * 7 + c) % 11 = 0").select("region", (F.col("r") * n + F.col("c")).cast("long").alias("cand_id"), "r", "c", ((F.col("r") * 37 + F.col("c") * 11) % 360 + 0.3).alias("aspect"))
    grid = Grid(30.7, 29.1, n, n)
    for p in (scan.ScanParams(step=25.0, field=(-6.9, -14.0), min_target_slope=-30.0, max_target_slope=60.0), scan.ScanParams(step=25.0, bilinear=True, half_width=None, azimuths=4)):
        a = {r["cand_id"]: r for r in scan.observables(cand, dem, grid, p).collect()}
        b = {r["cand_id"]: r for r in bulk_scan.observables(cand, dem, grid, p, 16).collect()}
        assert a.keys() == b.keys()
        assert sum(r["cells"] > 0 for r in a.values()) > 50
        for key, row in a.items():
            for col in row.asDict():
                x, y = row[col], b[key][col]
                assert x == y or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9), (key, col, x, y)


def test_rays_pass_over_ground_that_changes_nothing(spark):
    """Samples are saved, and the results are those of all samples."""
    import numpy as np
    import pandas as pd

    n = 300
    grid, c = Grid(30.7, 29.1, n, n), np.arange(n)
    z = np.repeat((500.0 + np.maximum(c - 110, 0) * 4.0 + 2500.0 * np.exp(-((c - 40.0) ** 2) / (2 * 25.0**2)))[None, :], n, 0)
    z += np.sin(np.arange(n))[:, None] * 3
    z[50:52, 70:90] = np.nan
    cand = pd.DataFrame([("a", r * n + x, r, x, 265.0 + r % 9) for r in range(3, n, 23) for x in range(5, n, 13)], columns=["region", "cand_id", "r", "c", "aspect"])
    narrow = scan.ScanParams(elev_min=-3, elev_max=3, bins=12, azimuths=5, half_width=60, max_range=7_000, min_dist=500, max_dist=7_000, bilinear=True)
    wide = scan.ScanParams(elev_min=-20, elev_max=20, bins=8, azimuths=4, half_width=None, max_range=7_000, min_dist=500, max_dist=7_000, step=45.0)
    rolling = 1000.0 + 5 * np.sin(c / 20.0)[None, :] + 5 * np.cos(c / 30.0)[:, None]
    level = scan.ScanParams(elev_min=-17.5, elev_max=22.5, bins=8, azimuths=4, half_width=None, max_range=7_000, min_dist=500, max_dist=7_000)
    for share, ground, p in ((1.0, z, narrow), (1.0, z, wide), (0.8, rolling, level)):
        few, every = [], []
        got = bulk_scan.walk(bulk_scan.Heights(ground, grid, p.step_m(grid)), 0, 0, cand, grid, p, few)
        none = bulk_scan.Heights(ground, grid, p.step_m(grid))
        none.levels = {k: (size, np.full_like(a, np.inf), np.full_like(b, -np.inf)) for k, (size, a, b) in none.levels.items()}
        want = bulk_scan.walk(none, 0, 0, cand, grid, p, every)
        pd.testing.assert_frame_equal(got, want, check_exact=False, rtol=1e-12)
        assert sum(few) < share * sum(every), (sum(few), sum(every))
        assert got["cells"].sum() > 100 or share < 1


def test_search_finds_both_flanks_of_a_valley(spark):
    n = 90
    grid = Grid(30.7, 29.1, n, n)
    p = search.SearchParams(tile=32, stride=3, target=40, min_slope=5, spacing_km=0.15, gap_close_km=0.13, min_width_km=0.13, downsample=2, min_sub_array=5, scan=scan.ScanParams(
        elev_min=-10, elev_max=20, bins=6, azimuths=3, half_width=40, max_range=1_800, min_dist=200, max_dist=1_800, step=25.0, bilinear=True))
    sites, funnel = search.search(ridge(spark, n), grid, p)
    facing = [r["facing_direction"] for r in sites.collect()]
    counts = [r["n"] for r in funnel.orderBy("pos").collect()]
    assert {f[-1] for f in facing} >= {"E", "W"}
    assert counts[0] == n * n and counts[:5] == sorted(counts[:5], reverse=True) and counts[5] >= counts[4] and counts[6] <= counts[5]
    joined, _ = search.search(ridge(spark, n), grid, replace(p, bulk=False))
    key = lambda rows: sorted((r["site_id"], r["pixels"], r["capacity_exact"]) for r in rows)
    assert key(joined.collect()) == key(sites.collect())


def test_stage_names_and_settings_are_those_of_a_search(spark):
    from dataclasses import fields

    from ridgeline import stages
    from ridgeline.operators import explain

    known = {f.name for f in fields(search.SearchParams)} | {"zones"}
    assert {name for names in stages.SETTINGS.values() for name in names} <= known
    n = 40
    p = search.SearchParams(tile=32, stride=2, target=10, min_slope=2, max_slope=60, spacing_km=0.1, gap_close_km=0.1, min_width_km=0.07, downsample=2, min_sub_array=2, min_score=1e-6, max_road_km=1.0,
                            scan=scan.ScanParams(elev_min=-10, elev_max=20, bins=4, azimuths=3, max_range=900, min_dist=100, max_dist=900, step=25.0))
    around = search.Surroundings(
        ridge(spark, n).select("region", "r", "c", (F.col("r") * 40.0).alias("dist_m")), spark.createDataFrame([(0, 5, 12, 150.0)], "zone_id int, zr int, zc int, radius_m double"))
    sites, funnel = search.search(ridge(spark, n), Grid(30.7, 29.1, n, n), p, around)
    rows = [(r["stage"], r["n"]) for r in funnel.orderBy("pos").collect()]
    assert [s for s, _ in rows] == [stages.DEM, stages.FINITE, stages.SLOPE, stages.ROAD, stages.ZONES, stages.STRIDE, stages.DIRECTIONS, stages.SCORE, stages.CLOSED, stages.PRUNED, stages.SELECTED]
    counts = dict(rows)
    assert counts[stages.ZONES] < counts[stages.ROAD] < counts[stages.SLOPE]
    summary = explain.run_summary(funnel.select(F.lit("x").alias("run"), "pos", "stage", "n")).first()
    assert (summary["accepted"], summary["kept"], summary["pruned"]) == (counts[stages.SCORE], counts[stages.STRIDE], counts[stages.PRUNED])
    bound = explain.binding_constraint(funnel.select(F.lit("x").alias("run"), "pos", "stage", "n")).first()
    assert bound["knob"] == " / ".join(stages.SETTINGS[bound["stage"]])
    assert {"center_lat", "bounds", "solid_angle_sr_p50", "candidates"} <= set(sites.columns)


def test_sweep_is_a_search_for_each_setting(spark):
    n = 90
    grid, dem = Grid(30.7, 29.1, n, n), ridge(spark, 90)
    base = search.SearchParams(min_slope=5, max_slope=60, stride=2, tile=32, scan=scan.ScanParams(step=25.0), spacing_km=0.05, gap_close_km=0.2, min_width_km=0.1, downsample=2, target=100, min_sub_array=3)
    changes = [("min_sub_array", 40), ("min_width_km", 0.4), ("max_dist", 400.0)]
    rows = sorted(search.sweep(dem, grid, base, changes).collect(), key=lambda r: r["setting_id"])
    assert [(r["param"], r["value"]) for r in rows] == [("baseline", None)] + [(k, str(v)) for k, v in changes]
    for row, p in zip(rows, [base] + [search.changed(base, k, v) for k, v in changes], strict=True):
        sites, funnel = search.search(dem, grid, p)
        chosen = sites.where("selected").collect()
        stages = {r["stage"]: r["n"] for r in funnel.collect()}
        assert (row["sites"], row["capacity"]) == (len(chosen), sum(r["capacity_exact"] for r in chosen))
        assert math.isclose(row["area_km2"], sum(r["area_km2"] for r in chosen), abs_tol=1e-5)
        assert (row["kept"], row["accepted"]) == (stages["kept by stride"], stages["directions accepted"])
    assert rows[0]["capacity_ratio"] == 1.0
    assert rows[3]["accepted"] != rows[0]["accepted"]
