"""Queries whose result is pairs: equal rows are compared once, and the pairs are dealt out over tasks."""

from pyspark.sql import functions as F

from ridgeline.operators import combine, explain


def test_equal_boxes_meet_by_extent_in_many_tasks(spark):
    """Three extents, two of which overlap, and 40 boxes of each; one box without a side."""
    k = F.col("id")
    boxes = spark.range(120).select(k.alias("name"), F.lit(10.0).alias("south"), F.lit(11.5).alias("north"), (k % 3 * 1.5).alias("west"), (k % 3 * 1.5 + 2 - (k % 3) * 0.5).alias("east"))
    boxes = boxes.unionByName(spark.range(1).select(F.lit(1000).cast("long").alias("name"), F.lit(10.0).alias("south"), F.lit(None).cast("double").alias("north"), F.lit(0.0).alias("west"), F.lit(2.0).alias("east")))
    found = explain.box_overlaps(boxes)
    assert found.rdd.getNumPartitions() >= explain.PAIR_SHARES
    rows = [(r["name_a"], r["name_b"]) for r in found.collect()]
    box = {r["name"]: r for r in boxes.where("north is not null").collect()}
    want = sorted((a, b) for a in box for b in box if a < b and box[a]["west"] < box[b]["east"] and box[b]["west"] < box[a]["east"])
    assert sorted(rows) == want
    assert 3 * 40 * 39 // 2 < len(want) < 120 * 119 // 2


def test_all_pairs_of_grids_are_made_in_many_tasks(spark):
    k = F.col("id")
    grids = spark.range(50).select(k.alias("run"), (k % 2).alias("rows"), F.lit(9).alias("cols"), *[F.lit(0.5).alias(t) for t in combine.TERMS[:-1]], (k % 3 * 1.0).alias("t5")).coalesce(1)
    found = combine.alignment(grids)
    assert found.rdd.getNumPartitions() >= combine.PAIR_SHARES
    rows = {(r["run_a"], r["run_b"]): r["aligned"] for r in found.collect()}
    assert rows == {(a, b): a % 6 == b % 6 for a in range(50) for b in range(a + 1, 50)}
