"""Run store, alignment classes, rings and tiles."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ridgeline.operators import combine, masks, rings, sites
from ridgeline.sources import run_store
from ridgeline.sources.run_store import world_text


def saved(spark, store):
    pixels = spark.createDataFrame([("one", r, c) for r in range(6) for c in range(40) if (r + c) % 7] + [("two", 2, 3)], "run string, r int, c int")
    records = spark.createDataFrame(
        [("one", "now", world_text(0.1, -15.0, -72.0), '{"total_capacity": 12}', '{"dem": "x/high.dem"}'), ("two", "now", world_text(0.1, -15.0, -72.0), '{"total_capacity": "N/A"}', "{}"),
         ("empty", "now", "0.1 0 0 -0.1 -72 -15", "{}", "{}")], "run string, prefix string, world string, results string, provenance string")
    run_store.save(store, pixels.repartition(3), records)
    return {tuple(r) for r in pixels.collect()}


def test_a_store_gives_back_what_was_saved_and_refuses_what_is_not_whole(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    want = saved(spark, store)
    found = {r["run"]: r for r in run_store.catalogue(spark, store, ("now",)).collect()}
    assert {k: (r["status"], r["capacity"], r["pixels"]) for k, r in found.items()} == {"one": ("ok", 12, len(want) - 1), "two": ("ok", None, 1), "empty": ("ok", None, 0)}
    got, grids = run_store.open_masks(spark, store, ["one", "two"], ("now",))
    assert {tuple(r) for r in got.select("run", "r", "c").collect()} == want
    combine.require_aligned(grids.selectExpr("*", "6 as rows", "40 as cols"))
    with pytest.raises(ValueError, match="three .not in the store"):
        run_store.open_masks(spark, store, ["one", "three"], ("now",))
    saved(spark, store)  # again: replaced, not doubled
    assert run_store.open_masks(spark, store, ["one"], ("now",))[0].count() == len(want) - 1
    lost = next(Path(tmp_path, "store/masks/run=one").glob("*.parquet"))
    lost.unlink()
    with pytest.raises(ValueError, match="one .mask damaged"):
        run_store.open_masks(spark, store, ["one", "two"], ("now",))
    assert run_store.open_masks(spark, store, ["two"], ("now",))[0].count() == 1
    for part in Path(tmp_path, "store/manifests/run=two").glob("*"):
        part.unlink()
    with pytest.raises(ValueError, match="two .no manifest"):
        run_store.open_masks(spark, store, ["two"], ("now",))


def test_alignment_classes_agree_with_pairs(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([5, 6]), 7, *[0.1 * (t + 1) + rng.choice([0, 0, 0, 8e-10, 1.6e-9, 1e-6]) * (t == 4) for t in range(6)]) for k in range(60)]
    grids = spark.createDataFrame(rows, "run int, rows int, cols int, t0 double, t1 double, t2 double, t3 double, t4 double, t5 double")
    of = {r["run"]: r for r in combine.alignment_classes(grids).collect()}
    pairs = {(r["run_a"], r["run_b"]): r["aligned"] for r in combine.alignment(grids).collect()}
    assert any(not r["uniform"] for r in of.values()) and any(r["uniform"] and r["class_size"] > 1 for r in of.values())
    for (a, b), aligned in pairs.items():
        same = of[a]["class_id"] == of[b]["class_id"]
        assert same or not aligned
        assert aligned or not same or not of[a]["uniform"]
    plan = combine.alignment_classes(grids)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


RING = ["#####.##", "#...#.##", "#.#.##..", "#...#.#.", "#####..#", "......##"]


def test_rings_close_around_sites_and_holes(spark):
    mask = spark.createDataFrame([("a", r, c) for r, row in enumerate(RING) for c, x in enumerate(row) if x == "#"], "region string, r int, c int")
    labels = sites.label_runs(masks.runs(mask), 8).cache()
    placed = rings.rings(labels)
    rows = placed.collect()
    got = {r["site_id"]: (r["rings"], r["holes"], r["area_px"]) for r in rings.summary(placed).collect()}
    size = {r["site_id"]: r["pixels"] for r in sites.areas(labels, 1.0).collect()}
    assert {k: v[2] for k, v in got.items()} == size
    assert sorted(v[:2] for v in got.values()) == [(1, 0), (1, 0), (1, 0), (1, 0), (2, 1)]  # the site at the lower right touches another at a corner only
    step = {0: (0, 1), 1: (1, 0), 2: (0, -1), 3: (-1, 0)}
    of = {}
    for r in rows:
        of.setdefault((r["site_id"], r["ring"]), {})[r["pos"]] = r
    for ring in of.values():
        n = len(ring)
        assert sorted(ring) == list(range(n)) and {r["n"] for r in ring.values()} == {n}
        for k in range(n):
            a, b = ring[k], ring[(k + 1) % n]
            dy, dx = step[a["d"]]
            assert (a["y"] + dy, a["x"] + dx) == (b["y"], b["x"])
    square = rings.corners(placed, 0.0, 0.0, 1.0).where("site_id = 1").groupBy("ring").count().collect()
    assert sorted(r["count"] for r in square) == [4, 8]
    assert rings.rings(labels.where("false")).count() == 0


def test_morphology_does_not_depend_on_the_tiles(spark):
    rng = random.Random(8)
    mask = spark.createDataFrame([("a", r, c) for r in range(70) for c in range(90) if rng.random() < 0.4], "region string, r int, c int")
    got = []
    for tile in (8, 31, 1024):
        pair = masks.cleaned(mask, (4, 3), (3, 2), 70, 90, tile)
        got.append([{(r["r"], r["c"]) for r in masks.pixels(m).collect()} for m in pair])
    assert got[0] == got[1] == got[2] and all(got[0])
    half = masks.downsampled(masks.cleaned(mask, (4, 3), (3, 2), 70, 90, 8)[0], 2)
    assert {(r["r"], r["c"]) for r in masks.pixels(half).collect()} == {(r // 2, c // 2) for r, c in got[0][0] if r % 2 == 0 and c % 2 == 0}
    assert masks.count(half).first()[0] == masks.pixels(half).agg(F.count("*")).first()[0]
