"""Lines of sight over several squares, slabs and bundles, the bound by planes, and how much moves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.operators import sight
from ridgeline.sources.fixtures import Grid

N = 120
GRID = Grid(30.7, 29.1, N, N)


def rough(spark):
    k = F.col("id")
    side = F.abs(k % N - 60)
    z = F.when(k % 97 == 5, None).otherwise((side * side / 20 + 3 * F.abs(F.expr(f"id div {N}") % 40 - 20) + F.pmod(F.xxhash64("id"), F.lit(9))).cast("double"))
    return spark.range(N * N).select(F.lit("a").alias("region"), F.expr(f"int(id div {N})").alias("r"), (k % N).cast("int").alias("c"), z.alias("z"))


def shuffled(spark) -> int:
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def places(spark, n: int):
    """`n` sources in different places."""
    return spark.range(n).select(F.expr(f"int((id * 4) div {N})").alias("zr"), (F.col("id") * 4 % N).cast("int").alias("zc"), (F.col("id") % 9 + 1.0).alias("weight"))


def candidates(spark):
    return rough(spark).where("(r * 7 + c) % 5 = 0").select("region", F.expr(f"bigint(r * {N} + c)").alias("cand_id"), "r", "c")


def test_terrain_and_bits_do_not_multiply(spark):
    """Words of hidden sources used to leave every tile, sources to be joined to each of them, and terrain to move for each pack."""
    got = sight.rfi_exposure(candidates(spark), rough(spark), places(spark, 3000), GRID, 25.0)
    before = shuffled(spark)
    got.write.format("noop").mode("overwrite").save()
    assert 0 < shuffled(spark) - before < 12_000_000  # before: 32 MB, now 8


def test_squares_slabs_and_bundles_give_the_same(spark, monkeypatch):
    def run():
        return {r["cand_id"]: r["rfi_exposure"] for r in sight.rfi_exposure(candidates(spark).where("r % 6 = 1"), rough(spark), places(spark, 700), GRID, 25.0).collect()}

    one = run()
    for name, value in {"SQUARE": 64, "TILE": 32, "SLAB": 192, "PACK": 250, "BUNDLE": 2, "SHARES": 5, "LINES": 1 << 13, "WORDS": sight.WORDS[:3]}.items():
        monkeypatch.setattr(sight, name, value)
    monkeypatch.setattr(sight, "HIDDEN", sight.pa.schema(list(sight.HIDDEN)[: 7 + 3]))
    many = run()
    assert one.keys() == many.keys() and np.allclose([one[k] for k in one], [many[k] for k in one], rtol=1e-12) and max(one.values()) > 0


@pytest.mark.parametrize("block", [8, 16])
def test_no_pixel_lies_above_its_planes(block):
    rng = np.random.default_rng(4)
    z = np.add.outer(np.arange(70) * 7.0, -np.arange(41) * 3.0) + rng.integers(0, 30, (70, 41))
    z[rng.random(z.shape) < 0.2] = np.nan
    z[:20, :20] = np.nan
    by_r, by_c, top = sight.planes(z, 100, 200, block)
    for i in range(top.shape[0]):
        for j in range(top.shape[1]):
            r, c = np.meshgrid(*(np.arange(max(k * block - block // 2, 0), min(k * block + block + block // 2, n)) for k, n in ((i, 70), (j, 41))), indexing="ij")
            for dr, dc in ((0, 0), (0.99, 0), (0, 0.99), (0.99, 0.99)):
                bound = top[i, j] + by_r[i, j] * (100 + r + dr) + by_c[i, j] * (200 + c + dc)
                h = z[r, c]
                assert (np.isnan(h) | (h <= bound + 1e-9)).all()
