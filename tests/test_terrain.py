"""Terrain operators on analytic ground and small masks."""

import math

import pytest
from pyspark.sql import functions as F

from ridgeline.functions import scoring
from ridgeline.operators import combine, explain, masks, scores, screening, sites
from ridgeline.sources import tables


def plane(spark, n, slope, aspect, cy=30.0, cx=28.0):
    t, a = math.tan(math.radians(slope)), math.radians(aspect)
    r, c = F.expr(f"int(id div {n})"), (F.col("id") % n).cast("int")
    return spark.range(n * n).select(F.lit("a").alias("region"), r.alias("r"), c.alias("c"), (2000 + t * (r * cy * math.cos(a) - c * cx * math.sin(a))).alias("z"))


@pytest.mark.parametrize(("slope", "aspect"), [(10, 0.5), (25, 135), (40, 290)])
def test_plane_has_its_slope_and_aspect_everywhere(spark, slope, aspect):
    g = screening.gradients(plane(spark, 12, slope, aspect), 30.0, 28.0)
    got = g.select(screening.slope_deg().alias("s"), screening.aspect_deg().alias("a")).agg(*[f(x) for x in "sa" for f in (F.min, F.max)]).first()
    assert got == pytest.approx((slope, slope, aspect, aspect), abs=1e-6)


def test_smoothing_a_plane_keeps_its_inside(spark):
    z = {(r["r"], r["c"]): r["z"] for r in plane(spark, 10, 20, 60).collect()}
    for r in screening.smooth(plane(spark, 10, 20, 60), 3, 3).collect():
        if 0 < r["r"] < 9 and 0 < r["c"] < 9:
            assert r["z"] == pytest.approx(z[r["r"], r["c"]])


def test_thinning_does_not_depend_on_partitions(spark):
    ground = plane(spark, 20, 10, 30)
    once = {(r["r"], r["c"]) for r in screening.thin(ground, 3, 8).collect()}
    again = {(r["r"], r["c"]) for r in screening.thin(ground.repartition(7), 3, 8).collect()}
    assert once == again and len(once) == sum(-(-h * w // 3) for h in (8, 8, 4) for w in (8, 8, 4))


def mask_of(spark, text):
    pixels = [("a", r, c) for r, row in enumerate(text) for c, x in enumerate(row) if x == "#"]
    return spark.createDataFrame(pixels, "region string, r int, c int")


PATTERN = ["##..#.....", "##..#..#..", "......##..", ".###......", ".#.#....#.", ".###......", "..........", "#########.", "........#.", "#.......#."]


def brute(pixels, rows, cols, h, w, grow):
    """An element reaches h // 2 before its centre; a dilation reads where elements that cover a pixel stand."""
    rs, cs = ([(n - 1 - n // 2, n // 2) if grow else (n // 2, n - 1 - n // 2) for n in (h, w)])
    window = lambda r, x: [(r + i, x + j) for i in range(-rs[0], rs[1] + 1) for j in range(-cs[0], cs[1] + 1)]
    test = any if grow else all
    return {(r, x) for r in range(rows) for x in range(cols) if test(p in pixels for p in window(r, x))}


@pytest.mark.parametrize(("h", "w"), [(1, 1), (2, 3), (3, 2), (4, 4)])
def test_morphology_against_brute_force(spark, h, w):
    mask = mask_of(spark, PATTERN)
    pixels = {(r["r"], r["c"]) for r in mask.collect()}
    got = lambda df: {(r["r"], r["c"]) for r in df.collect()}
    grown, thin = got(masks.dilate(mask, h, w, 10, 10)), got(masks.erode(mask, h, w, 10, 10))
    assert grown == brute(pixels, 10, 10, h, w, True) and thin == brute(pixels, 10, 10, h, w, False)
    assert thin <= pixels <= grown


@pytest.mark.parametrize(("h", "w"), [(4, 1), (1, 2), (2, 3), (4, 4), (3, 3)])
def test_a_closing_contains_its_mask_and_an_opening_lies_within_it(spark, h, w):
    mask = mask_of(spark, PATTERN).select("region", (F.col("r") + 10).alias("r"), (F.col("c") + 10).alias("c"))  # away from the edge
    pixels = {(r["r"], r["c"]) for r in mask.collect()}
    got = lambda df: {(r["r"], r["c"]) for r in df.collect()}
    closed, opened = masks.close_gaps(mask, h, w, 40, 40), masks.prune(mask, h, w, 40, 40)
    assert got(opened) <= pixels <= got(closed)
    assert got(masks.close_gaps(closed, h, w, 40, 40)) == got(closed) and got(masks.prune(opened, h, w, 40, 40)) == got(opened)


def test_labels_count_four_neighbour_regions_in_raster_order(spark):
    got = {(r["r"], r["c"]): r["site_id"] for r in sites.label(mask_of(spark, PATTERN), 10).collect()}
    assert got[0, 0] == got[1, 1] == 1 and got[0, 4] == 2 and got[1, 7] == got[2, 6] == 3
    assert got[3, 1] == got[5, 3] == 4 and got[4, 8] == 5 and got[7, 0] == got[9, 8] == 6 and got[9, 0] == 7
    assert sites.label(mask_of(spark, PATTERN).limit(0), 10).count() == 0


def test_capacity_follows_lattice_density(spark):
    n, cell, spacing = 60, 20.0, 100.0
    mask = spark.range(n * n).select(F.lit("a").alias("region"), F.expr(f"int(id div {n})").alias("r"), (F.col("id") % n).cast("int").alias("c"))
    mask = masks.runs(mask)
    labels = mask.withColumn("site_id", F.lit(1))
    for hexagonal, density in ((False, 1.0), (True, 1 / sites.SIN_60)):
        found = sites.capacity(labels, mask, 1, cell, cell, spacing, hexagonal).first()["capacity_exact"]
        assert found == pytest.approx((n * cell / spacing) ** 2 * density, rel=0.1)


def test_selection_stops_at_target_or_takes_all(spark):
    rows = spark.createDataFrame([("a", k, c) for k, c in enumerate([5, 9, 7, 9], start=1)], "region string, site_id int, capacity_exact long")
    take = lambda **kw: {r["site_id"]: (r["selected"], r["viz_id"], r["total_capacity"]) for r in sites.select_sites(rows, 17, **kw).collect()}
    assert take(stop_at_target=True) == {2: (True, 1, 18), 4: (True, 2, 18), 3: (False, None, 18), 1: (False, None, 18)}
    assert all(v == (True, v[1], None) for v in take(distributed=False).values())


def test_polygon_and_circle_exclusion(spark):
    ground = plane(spark, 10, 5, 0)
    square = spark.range(1).select(F.lit(0).alias("zone_id"), F.expr("array(named_struct('x', 2.5, 'y', 2.5), named_struct('x', 6.5, 'y', 2.5), named_struct('x', 6.5, 'y', 5.5), named_struct('x', 2.5, 'y', 5.5))").alias("verts"))
    assert screening.outside_polygons(ground, square).count() == 100 - 4 * 3
    circle = spark.createDataFrame([(0, 5, 5, 45.0)], "zone_id int, zr int, zc int, radius_m double")
    inside = sum(math.hypot((r - 5) * 30, (c - 5) * 28) < 45 for r in range(10) for c in range(10))
    assert screening.outside_circles(ground, circle, 30.0, 28.0).count() == 100 - inside


def test_compose_rejects_what_has_no_meaning():
    with pytest.raises(ValueError):
        scoring.compose({}, "sum")
    with pytest.raises(ValueError):
        scoring.compose({"a": None}, "product", {"a": -1})


def test_absent_components_are_neutral(spark):
    cols = ["cells", "solid_angle_sr", "mean_distance_m", "max_depth_gcm2", "geomag_solid_angle_sr", "path_grammage_gcm2", "earth_chord_gcm2", "altitude_m", "best_clearance_ratio"]
    rows = spark.createDataFrame([(3, 0.1, 5e3, 1e6, 0.1, 0.0, 0.0, 2e3, 0.0), (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 2e3, 0.0)], [*cols])
    got = scores.score(rows, scores.ScoreConfig(), (4e3, 6e3)).orderBy("cells").collect()
    assert got[0]["score"] == 0 and got[1]["score_geomagnetic"] is None and got[1]["score_shower"] is None
    assert got[1]["score"] == pytest.approx(0.1 / (0.1 + 0.05 / 3))


def test_identical_masks_have_jaccard_one(spark):
    masks_ = mask_of(spark, PATTERN).select(F.explode(F.array(F.lit("x"), F.lit("y"))).alias("run"), "r", "c")
    pair = combine.pairwise(combine.membership(masks_, ["x", "y", "z"]), ["x", "y", "z"], 1.0)
    got = {(r["run_a"], r["run_b"]): r["jaccard"] for r in pair.collect()}
    assert got == {("x", "y"): 1.0, ("x", "z"): 0.0, ("y", "z"): 0.0}
    grids = spark.createDataFrame([("a", 5, 5, *[0.0] * 6), ("b", 5, 6, *[0.0] * 6)], "run string, rows int, cols int, t0 double, t1 double, t2 double, t3 double, t4 double, t5 double")
    with pytest.raises(ValueError):
        combine.require_aligned(grids)


def test_a_fatal_stage_binds(spark):
    rows = [(1, 0, "DEM pixels", 100), (1, 1, "slope", 5), (1, 2, "altitude", 0), (1, 3, "road", 0), (2, 0, "DEM pixels", 100), (2, 1, "slope", 60), (2, 2, "kept by stride 5", 12), (2, 3, "directions accepted", 11)]
    got = {r["run"]: (r["stage"], r["fatal"]) for r in explain.binding_constraint(spark.createDataFrame(rows, "run int, pos int, stage string, n long")).collect()}
    assert got == {1: ("altitude", True), 2: ("slope", False)}


def test_crop_and_downsample_number_from_zero(spark):
    ground = plane(spark, 10, 5, 0)
    assert tables.crop(ground, (2, 5), (3, 10)).agg(F.min("r"), F.max("r"), F.min("c"), F.max("c")).first() == (0, 2, 0, 6)
    assert tables.downsample(ground, 4).agg(F.count(F.lit(1)), F.max("r")).first() == (9, 2)
    assert screening.ingest(ground.withColumn("z", F.lit(-500.0))).where("z is null").count() == 100


def test_labels_across_blocks_against_flood_fill(spark, monkeypatch):
    import random

    from ridgeline.operators import sites

    monkeypatch.setattr(sites, "BLOCK_ROWS", 5)
    monkeypatch.setattr(sites, "BLOCK_COLS", 4)
    rng = random.Random(4)
    true = {(r, c) for r in range(23) for c in range(19) if rng.random() < 0.6}
    first = {}
    for start in sorted(true):
        if start not in first:
            todo = [start]
            while todo:
                r, c = todo.pop()
                if (r, c) in true and (r, c) not in first:
                    first[r, c] = start[0] * 19 + start[1]
                    todo += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
    rank = {f: k for k, f in enumerate(sorted(set(first.values())), start=1)}
    got = sites.label(spark.createDataFrame([("a", r, c) for r, c in true], "region string, r int, c int"), 19).collect()
    assert {(x["r"], x["c"]): (x["first"], x["site_id"]) for x in got} == {p: (f, rank[f]) for p, f in first.items()}
    assert sites.label(spark.createDataFrame([], "region string, r int, c int"), 19).count() == 0


def test_crop_by_box_snaps_outward_and_stays_on_the_map(spark):
    dem = plane(spark, 12, 10, 60)
    cut, about = tables.crop_box(dem, -15.0, -72.0, 0.1, 12, 12, (-15.75, -15.25, -71.95, -60.0))
    assert about.select("rows", "cols").first() == (6, 12)
    assert about.select("origin_lat", "origin_lon", "south", "east").first() == pytest.approx((-15.2, -72.0, -15.8, -70.8))
    want = {(r["r"] - 2, r["c"]): r["z"] for r in dem.collect() if 2 <= r["r"] < 8}
    assert {(r["r"], r["c"]): r["z"] for r in cut.collect()} == want
    assert about.select("z_min", "z_max").first() == (min(want.values()), max(want.values()))
    with pytest.raises(ValueError, match="nothing of the box"):
        tables.crop_box(dem, -15.0, -72.0, 0.1, 12, 12, (-20.0, -19.0, -71.9, -71.0))


def test_report_has_a_section_for_what_it_is_given(spark):
    funnels = spark.createDataFrame([(1, 0, "DEM pixels", 1000), (1, 1, "slope", 100), (1, 2, "kept by stride", 50), (1, 3, "directions accepted", 40), (1, 4, "after gap closing", 200)],
                                    "run int, pos int, stage string, n long")
    runs = spark.createDataFrame([(1, None, None, 0.5, 2, 1)], "run int, min_score double, score_percentile double, gap_close_km double, stride int, sites int")
    found = spark.createDataFrame([(1, 7, 2.5, 60, True, {"score_depth_p50": 0.9, "score_distance_p50": 0.2}), (1, 8, 1.0, 10, False, {"score_depth_p50": 0.1})],
                                  "run int, site_id int, area_km2 double, capacity_exact long, is_selected boolean, arrival_scan map<string, double>")
    head = explain.headline(found, spark.createDataFrame([(1, 100)], "run int, target int"))
    stats = spark.createDataFrame([(1, 400, 2)], "run int, labelled int, passed int")
    peaks = spark.createDataFrame([(1, 31.6)], "run int, energy_pev double")
    binding = explain.binding_constraint(funnels)
    steps = explain.next_steps(runs, binding)
    rows = explain.report(head, funnels, binding, steps, runs, stats, found, peaks).orderBy("section_no", "pos").collect()
    assert list(dict.fromkeys(r["section"] for r in rows)) == explain.SECTIONS
    lines = {r["section"]: r["line"] for r in rows}
    assert lines["headline"] == "1 sites of 2.50 km2 hold 60 detectors, 40 short of the target"
    assert lines["regions"] == "2 of 400 regions are large enough (0.5%): the ground is in fragments"
    assert lines["sites"].startswith("site 7") and lines["strengths"] == "site 7 is strong at depth"
    assert "2.50 times" in lines["reading"]
    assert {r["section"] for r in explain.report(head, funnels, binding, steps).collect()} == {"headline", "funnel", "binding", "next"}
