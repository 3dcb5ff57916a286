"""The driver's small tables have hardly a candidate that is accepted within a site; rugged ground has thousands."""

import math

from pyspark.sql import functions as F

from ridgeline import registry
from ridgeline.operators import quantiles

W = 150


def test_site_observables_on_rugged_ground(spark, tmp_path, monkeypatch):
    import duckdb

    monkeypatch.setattr(quantiles, "FEW", 256)  # so that the large site's ranges are refined
    k = F.col("id")
    hills = 130 + 120 * F.sin(2 * math.pi * F.floor(k / W) / 37) * F.cos(2 * math.pi * (k % W) / 41)
    spark.range(W * W).select(k.alias("event_id"), (50 * hills + k * 7919 % 560).alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    answer = con.execute(registry.oracle_sql()["site_observables"])
    names = [d[0] for d in answer.description]
    want = sorted(answer.fetchall())
    found = sorted(tuple(r[c] for c in names) for r in registry.queries()["site_observables"](spark, str(tmp_path)).collect())
    assert max(r[names.index("candidates")] for r in want) > 1000
    assert [r[:2] for r in found] == [r[:2] for r in want]
    for got, due in zip(found, want, strict=True):
        assert all(math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-7) for a, b in zip(got, due, strict=True)), (got, due)
