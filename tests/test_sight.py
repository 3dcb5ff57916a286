"""Lines of sight by tiles against every sample of every line, and what they move."""

import numpy as np
from pyspark.sql import functions as F

from ridgeline.operators import sight
from ridgeline.sources.fixtures import Grid

N = 150
GRID = Grid(30.7, 29.1, N, N)


def test_hidden_sources_are_those_of_all_samples(spark):
    """Rough ground with voids over several tiles, more sources than a word holds, two of them in one place."""
    rng = np.random.default_rng(3)
    z = np.add.outer(np.abs(np.arange(N) - 70) * 4.0, np.sin(np.arange(N) / 6) * 60) + rng.integers(0, 40, (N, N))
    z[rng.random((N, N)) < 0.01] = np.nan
    dem = spark.createDataFrame([("a", r, c, None if np.isnan(z[r, c]) else float(z[r, c])) for r in range(N) for c in range(N)], "region string, r int, c int, z double")
    cands = [(r * N + c, r, c) for r in range(3, N, 19) for c in range(1, N, 17)]
    sources = [(int(r), int(c), float(w)) for r, c, w in zip(rng.integers(0, N + 5, 150), rng.integers(0, N, 150), rng.integers(1, 9, 150), strict=True)]
    sources += [(*sources[0][:2], 2.0), (cands[5][1], cands[5][2], 4.0)]
    cand = spark.createDataFrame([("a", *x) for x in cands], "region string, cand_id long, r int, c int")
    found = sight.rfi_exposure(cand, dem, spark.createDataFrame(sources, "zr int, zc int, weight double"), GRID, 25.0)
    got = {r["cand_id"]: r["rfi_exposure"] for r in found.collect()}
    blocked = open_ = 0
    for cand_id, r, c in cands:
        want = 0.0
        for zr, zc, weight in sources:
            if zr >= N or np.isnan(z[zr, zc]) or np.isnan(z[r, c]):
                continue
            dist = float(np.hypot((zr - r) * GRID.cell_y, (zc - c) * GRID.cell_x))
            if dist < 1:
                continue
            steps = int(dist / 25.0)
            f = np.arange(1, steps) / max(steps, 1)
            under = z[(r + (zr - r) * f).astype(int), (c + (zc - c) * f).astype(int)]
            hidden = bool((under - (dist * f) ** 2 / (2 * 8500000.0) > z[r, c] + (z[zr, zc] - z[r, c]) * f).any())
            blocked, open_ = blocked + hidden, open_ + (not hidden)
            want += 0.0 if hidden else weight / dist**2
        assert np.isclose(got[cand_id], want, rtol=1e-9), (cand_id, got[cand_id], want)
    assert len(got) == len(cands) and blocked > 500 and open_ > 100


def test_no_line_is_a_row(spark):
    """A candidate's hidden sources travel as words of bits, not as rows of their samples."""
    k = F.col("id")
    dem = spark.range(1600).select(F.lit("a").alias("region"), F.expr("int(id div 40)").alias("r"), (k % 40).cast("int").alias("c"), (k % 7 * 5.0).alias("z"))
    cand = dem.where("r % 9 = 0 and c % 9 = 0").select("region", (F.col("r") * 40 + F.col("c")).cast("long").alias("cand_id"), "r", "c")
    sources = spark.range(40).select(k.cast("int").alias("zr"), ((k * 7) % 40).cast("int").alias("zc"), F.lit(1.0).alias("weight"))
    plan = sight.rfi_exposure(cand, dem, sources, Grid(30.0, 30.0, 40, 40), 25.0)._jdf.queryExecution().executedPlan().toString()
    assert "bit_or" in plan and plan.count("FlatMapCoGroups") >= 1 and "sight-lines" not in plan
