"""Samples found by tiles against the plain join of every sample with its pixel."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ridgeline.operators import profiles, scan
from ridgeline.sources.fixtures import Grid

N = 70
GRID = Grid(30.7, 29.1, N, N)


@pytest.fixture(scope="module")
def ground(spark):
    """Two regions of unlike heights with voids; every 101st pixel is not listed at all."""
    k = F.col("id")
    z = F.when(k % 97 != 3, 1000.0 + (k * 7919 % 17) + 9.0 * F.abs(k % N - 30))
    one = spark.range(N * N).where("id % 101 != 5").select(F.lit("a").alias("region"), F.expr(f"int(id div {N})").alias("r"), (k % N).cast("int").alias("c"), z.alias("z"))
    dem = one.unionByName(one.select(F.lit("b").alias("region"), "r", "c", (3000 - F.col("z")).alias("z")))
    cand = dem.where("(r * 7 + c) % 23 = 0").select("region", (F.col("r") * N + F.col("c")).cast("long").alias("cand_id"), "r", "c", ((F.col("r") * 37 + F.col("c") * 11) % 360 + 0.3).alias("aspect"))
    return dem, scan.with_altitude(cand, dem).where("z0 is not null")


def keyed(df):
    return {(r["region"], r["cand_id"], r["az"], r["d"]): (r["z"], r["rise"]) for r in df.collect()}


def test_samples_are_those_of_the_join(spark, ground):
    dem, cand = ground
    p = scan.ScanParams(step=25.0)
    order = Window.partitionBy("region", "cand_id", "az").orderBy("d")
    joined = scan.nearest(scan.samples(scan.fan(cand, p), GRID, p), dem)
    want = keyed(joined.withColumn("rise", F.coalesce((F.col("z") - F.lag("z").over(order)) / 25.0, F.lit(0.0))))
    assert len(want) > 20_000
    assert keyed(scan.seen(cand, dem, GRID, p)) == want
    rays = scan.fan(cand, p)
    for size in (8, 16):  # rays that pass several tiles
        some = profiles.along(rays, dem, GRID, 25.0, 1800.0, F.lit(72), 3 * 72, size=size)
        assert keyed(some.withColumn("d", F.col("k") * 25.0)) == want


def test_no_sample_is_shuffled(spark, ground):
    dem, cand = ground
    plan = scan.seen(cand, dem, GRID, scan.ScanParams(step=25.0))._jdf.queryExecution().executedPlan().toString()
    after = plan[: plan.index("FlatMapCoGroups")]
    assert "Exchange" not in after and "Join" not in after and "Window" not in after


def test_interpolated_samples(spark, ground):
    """By hand from the four pixels; at the edge and beside voids the nearest."""
    dem, cand = ground
    p = scan.ScanParams(step=25.0, bilinear=True)
    z = {(r["region"], r["r"], r["c"]): r["z"] for r in dem.where("z is not null").collect()}
    found = keyed(scan.seen(cand, dem, GRID, p))
    points = scan.samples(scan.fan(cand, p), GRID, p).collect()
    nearest = seen = 0
    for s in points:
        ri, ci = math.floor(s["fr"]), math.floor(s["fc"])
        around = [z.get((s["region"], ri + a, ci + b)) for a in (0, 1) for b in (0, 1)]
        u, v = s["fc"] - ci, s["fr"] - ri
        want = z.get((s["region"], s["tr"], s["tc"]))
        if None not in around:
            want = (1 - v) * ((1 - u) * around[0] + u * around[1]) + v * ((1 - u) * around[2] + u * around[3])
        elif want is not None:
            nearest += 1
        got = found.get((s["region"], s["cand_id"], s["az"], s["d"]))
        assert (got and got[0]) == want
        seen += got is not None
    assert nearest > 100 and seen == len(found)
