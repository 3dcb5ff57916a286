"""Queries of scoring (survey 2.D)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import scoring as S
from ridgeline.operators import scan as A
from ridgeline.operators import scores as M
from ridgeline.plans.arrival import BINS, BX, BY, BZ, FIELD, candidates
from ridgeline.plans.base import query
from ridgeline.sources import fixtures

CFG = M.ScoreConfig(shower_m=200.0, decay_energy=10.0, nu_length=2e9, spacing_m=150.0, muon_shielding_km=1.0)
WINDOW = (400.0, 1200.0)
SKY = FIELD.available_sky()


def observed(spark: SparkSession, sf: str) -> DataFrame:
    return A.observables(candidates(spark, sf), fixtures.dem(spark, sf), fixtures.grid(spark, sf), FIELD)


def scored(spark: SparkSession, sf: str, cfg: M.ScoreConfig = CFG) -> DataFrame:
    return M.score(observed(spark, sf), cfg, WINDOW, SKY)


def band_sql(x: str, lo: float, hi: float) -> str:
    q = (hi - lo) / 4
    return f"(case when {x} < {lo} then greatest(0, 1 - ({lo} - {x}) / {q}) when {x} > {hi} then greatest(0, 1 - ({x} - {hi}) / {q}) else 1.0 end)"




SCORED = BINS + f""",
dots as (select *, sin(radians(azimuth)) * cos(radians(theta)) * {BX} + cos(radians(azimuth)) * cos(radians(theta)) * {BY} + sin(radians(theta)) * {BZ} as dot,
    1.225 * exp(-z0 / 8400.0) * 8400.0 / sin(radians(theta)) * (1 - exp(-d_hit / cos(radians(theta)) * sin(radians(theta)) / 8400.0)) * 0.1 as gram,
    case when theta < 0 then 2 * 6371000.0 * sin(radians(-theta)) * 265.0 else 0 end as chord from ok),
agg as (select cand_id, count(*) as cells, sum(omega) as om, avg(d_hit) as dist, max(depth) as depth, sum(omega * sqrt(greatest(0.0, 1 - dot * dot))) as geo, avg(gram) as gram, avg(chord) as chord from dots group by cand_id),
obs as (select cand_id, cand.z0 as alt, coalesce(cells, 0) as cells, coalesce(om, 0) as om, coalesce(dist, 0) as dist, coalesce(depth, 0) as depth, coalesce(geo, 0) as geo, coalesce(gram, 0) as gram, coalesce(chord, 0) as chord
  from cand left join agg using (cand_id)),
flags as (select bool_or(om > 0 and geo / nullif(om, 0) < 0.999) as hg, bool_or(gram > 0) as hs from obs),
parts as (select cand_id, cells, {band_sql('depth', 1e5, 1e7)} as depth, (om / {SKY}) / (om / {SKY} + 0.07602562106303032) as solid_angle, {band_sql('dist', 400, 1200)} as distance,
    case when depth >= 265000 then 1.0 else 0.0 end as muon_shielding, case when hg then case when om > 0 then least(1, geo / om) else 0 end end as geomagnetic,
    case when hs then least(1, gram / 700.0) end as shower, 1 - exp(-greatest(dist - 200, 0) / (10 * 1e6 / 1.77686 * 8.703e-05)) as decay,
    exp(-chord / 2e9) as nu_survival, least(1, 2 * dist * sqrt(2 * 0.00029 * exp(-alt / 8400.0)) / 150) as footprint from obs, flags),
total as (select *, case when cells > 0 then depth * solid_angle * distance * muon_shielding * coalesce(geomagnetic, 1) * coalesce(shower, 1) * decay * nu_survival * footprint else 0 end as score from parts)"""
NAMES = ["depth", "solid_angle", "distance", "muon_shielding", "geomagnetic", "shower", "decay", "nu_survival", "footprint"]


def _simple(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", (F.col("value") - 20).alias("x"))


@query("score_band", f"""with e as (select event_id, value - 20 as x from events) select event_id, round({band_sql('x', 10, 50)}, 8) as quarter,
    round(case when x < 10 then 0.0 when x > 50 then greatest(0, 1 - (x - 50) / 5.0) else 1.0 end, 8) as cliff from e""")
def score_band(spark, sf):
    x = F.col("x")
    return _simple(spark, sf).select("event_id", F.round(S.band(x, 50, 10), 8).alias("quarter"), F.round(S.band(x, 10, 50, 0, 5), 8).alias("cliff"))


@query("score_saturating", "select event_id, round(greatest(value - 20, 0) / (greatest(value - 20, 0) + 12.5), 8) as s from events")
def score_saturating(spark, sf):
    return _simple(spark, sf).select("event_id", F.round(S.saturating(F.col("x"), 12.5), 8).alias("s"))


@query("score_ramp", """select event_id, round(least(1, greatest(0, (value - 20 - 5) / 45)), 8) as up, round(least(1, greatest(0, (value - 20 - 60) / -50)), 8) as down,
    case when value - 20 >= 30 then 1.0 else 0.0 end as step from events""")
def score_ramp(spark, sf):
    x = F.col("x")
    return _simple(spark, sf).select("event_id", F.round(S.ramp(x, 5, 50), 8).alias("up"), F.round(S.ramp(x, 60, 10), 8).alias("down"), S.ramp(x, 30, 30).alias("step"))


@query("score_compose", """with e as (select event_id, least(1, greatest(0, (value - 10) / 50)) as a, (event_id % 10) / 9.0 as b, (event_id % 7) / 5.0 as c from events)
    select event_id, round(a * power(b, 2.0) * least(c, 1), 8) as product, round((a * 2 + b + least(c, 1) * 0.5) / 3.5, 8) as mean, round(least(a, b), 8) as least from e""")
def score_compose(spark, sf):
    k = F.col("event_id")
    e = _simple(spark, sf).withColumns({"a": S.ramp(F.col("x") + 20, 10, 60), "b": (k % 10) / 9, "c": (k % 7) / 5})
    parts = {n: F.col(n) for n in "abc"}
    return e.select("event_id", F.round(S.compose(parts, "product", {"b": 2.0}), 8).alias("product"), F.round(S.compose(parts, "mean", {"a": 2.0, "c": 0.5}), 8).alias("mean"),
                    F.round(S.compose(parts, "min", {"c": 0}), 8).alias("least"))


@query("score_components", f"with {SCORED} select cand_id, cells, {', '.join(f'round({n}, 7) as score_{n}' for n in NAMES)}, round(score, 7) as score from total")
def score_components(spark, sf):
    s = scored(spark, sf)
    return s.select("cand_id", "cells", *[F.round(f"score_{n}", 7).alias(f"score_{n}") for n in NAMES], F.round("score", 7).alias("score"))


@query("score_presence", f"with {SCORED} select hg as has_geomagnetic, hs as has_shower, false as has_clearance from flags")
def score_presence(spark, sf):
    return M.presence(observed(spark, sf))


@query("cut_percentile", f"with {SCORED}, q as (select quantile_cont(score, 0.9) as cut from total where cells > 0) select cand_id, round(score, 7) as score from total, q where cells > 0 and score >= cut")
def cut_percentile(spark, sf):
    return M.cut_percentile(scored(spark, sf), 10).select("cand_id", F.round("score", 7).alias("score"))


@query("cut_min_score", f"with {SCORED} select cand_id, round(score, 7) as score from total where cells > 0 and score >= 0.004")
def cut_min_score(spark, sf):
    return M.cut_score(scored(spark, sf), 0.004).select("cand_id", F.round("score", 7).alias("score"))


@query("score_summary", f"""with {SCORED} select round(avg(score), 7) as score_mean, round(quantile_cont(score, 0.5), 7) as score_p50, round(quantile_cont(score, 0.9), 7) as score_p90, round(max(score), 7) as score_max,
    {', '.join(f'round(quantile_cont({n}, 0.5), 7) as {n}_score_p50' for n in NAMES)} from total where cells > 0""")
def score_summary(spark, sf):
    s = M.summary(scored(spark, sf).where("cells > 0").drop("score_clearance"))
    return s.select(*[F.round(c, 7).alias(c) for c in s.columns])


@query("score_composition", f"""with {SCORED}, long as (select cand_id, score, unnest([{', '.join(repr(n) for n in NAMES)}]) as component, unnest([{', '.join(NAMES)}]) as value from total where cells > 0),
    med as (select component, quantile_cont(value, 0.5) as median, row_number() over (order by quantile_cont(value, 0.5) desc, component) as rank from long where value is not null group by component),
    run as (select rank, component, median, score, case when min(value) over v <= 0 then 0 else exp(sum(ln(case when value > 0 then value end)) over v) end as running
      from long join med using (component) where value is not null window v as (partition by cand_id order by rank))
    select cast(rank as int) as rank, component, round(median, 7) as median, round(quantile_cont(running, 0.5), 7) as running_median, round(avg(case when running >= 0.01 then 1.0 else 0.0 end), 7) as share_above,
      round(max(abs(running - score)), 6) as drift from run group by all""")
def score_composition(spark, sf):
    c = M.composition(scored(spark, sf), 0.01)
    return c.select("rank", "component", *[F.round(x, d).alias(x) for x, d in (("median", 7), ("running_median", 7), ("share_above", 7), ("drift", 6))])


@query("score_histogram", f"with {SCORED} select cast(least(floor(score * 60), 59) as int) as bin, count(*) as n from total where cells > 0 group by 1")
def score_histogram(spark, sf):
    return M.histogram(scored(spark, sf))
