"""Queries of the arrival scan (survey 2.C)."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import physics as P
from ridgeline.operators import scan as A
from ridgeline.operators import screening as S
from ridgeline.operators import sight
from ridgeline.plans.base import CAND, CX, CY, DEM, query
from ridgeline.plans.ground import ground
from ridgeline.sources import fixtures

ST = 25.0  # metres; no multiple of it falls on a pixel edge along the axes within range
SCAN = A.ScanParams(step=ST)
RADIO = replace(SCAN, frequency_mhz=50.0)
FIELD = replace(SCAN, field=(-6.9, -14.0))
TARGET = replace(SCAN, min_target_slope=2.0, max_target_slope=50.0, min_depth=5000.0)


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    w = fixtures.width(spark, sf)
    thin = S.thin(ground(spark, sf).where(S.slope_band(12, 60)), 5, 32)
    return thin.select("region", (F.col("r") * w + F.col("c")).cast("long").alias("cand_id"), "r", "c", "aspect")


def with_z(spark: SparkSession, sf: str) -> DataFrame:
    return A.with_altitude(candidates(spark, sf), fixtures.dem(spark, sf)).where("z0 is not null")


def per_bin(spark: SparkSession, sf: str, p: A.ScanParams = SCAN) -> DataFrame:
    g = fixtures.grid(spark, sf)
    return A.cells(A.seen(with_z(spark, sf), fixtures.dem(spark, sf), g, p), g, p)


FAN = """fan as (select *, aspect + o as azimuth from (select *, unnest([0, 1, 2]) as az, unnest([-26.666666666666668, 0.0, 26.666666666666664]) as o from cand where z0 is not null))"""
STEPS = int(SCAN.max_range / ST + 1e-9)


def rays(z: str = "dem.z", extra: str = "") -> str:
    """SQL of the samples: the pixel below each and its apparent slope and rise."""
    return f"""{CAND}, {FAN},
pts as (select *, c + trunc(d * sin(radians(azimuth)) / {CX}) as tc, r - trunc(d * cos(radians(azimuth)) / {CY}) as tr,
    c + d * sin(radians(azimuth)) / {CX} as fc, r - d * cos(radians(azimuth)) / {CY} as fr
  from (select *, k * {ST} as d from (select *, unnest(range(1, {STEPS + 1})) as k from fan))),
on_map as (select pts.* from pts, w where tc between 0 and w.w - 1 and tr between 0 and w.w - 1){extra},
seen0 as (select p.*, {z} as z from on_map p join dem on dem.r = p.tr and dem.c = p.tc {'' if z == 'dem.z' else 'left join corner k on k.r = floor(p.fr) and k.c = floor(p.fc)'}),
seen as (select *, (z - d*d*(1/(2*6371000.0)) - z0) / d as slope, coalesce((z - lag(z) over (partition by cand_id, az order by d)) / {ST}, 0) as rise from seen0 where z is not null)"""


CORNER = """, corner as (select r, c, z00, z01, z10, z11 from (select r, c, z as z00, lead(z) over h as z01, lead(z) over v as z10 from dem
  window h as (partition by r order by c), v as (partition by c order by r)) a join (select r as rr, c as cc, lead(zr) over (partition by c order by r) as z11
  from (select r, c, lead(z) over (partition by r order by c) as zr from dem)) b on a.r = b.rr and a.c = b.cc
  where z00 is not null and z01 is not null and z10 is not null and z11 is not null)"""
MIXED = "coalesce((1-(p.fr-k.r))*((1-(p.fc-k.c))*k.z00 + (p.fc-k.c)*k.z01) + (p.fr-k.r)*((1-(p.fc-k.c))*k.z10 + (p.fc-k.c)*k.z11), dem.z)"


def bins(base: str) -> str:
    return base + f""",
bin as (select unnest(range(8)) as b),
edges as (select b, -17.5 + 5 * b as theta, tan(radians(-20.0 + 5 * b)) as edge from bin),
tops as (select cand_id, az, any_value(azimuth) as azimuth, any_value(z0) as z0, max(slope) as top from seen group by cand_id, az),
hit as (select cand_id, az, b, min(d) as d_hit, arg_min(rise, d) as rise, count(*) as n from seen join edges on slope >= edge group by cand_id, az, b),
cells as (select t.*, e.b, theta, d_hit, rise, coalesce(n, 0) * {ST} / cos(radians(theta)) * 265.0 as depth
  from tops t cross join edges e left join hit h on h.cand_id = t.cand_id and h.az = t.az and h.b = e.b),
ok as (select *, cos(radians(theta)) * radians(5.0) * radians(80.0) / 3 as omega from cells where d_hit between 300 and 1500)"""


BINS = bins(rays())
KEY = "cand_id, cast(az as int) as az"


@query("azimuth_fan", f"with {CAND}, {FAN} select {KEY}, round(azimuth, 6) as azimuth from fan")
def azimuth_fan(spark, sf):
    return A.fan(with_z(spark, sf), SCAN).select("cand_id", "az", F.round("azimuth", 6).alias("azimuth"))


@query("ray_samples", f"with {rays()} select {KEY}, round(d, 6) as d, cast(tr as int) as tr, cast(tc as int) as tc from on_map")
def ray_samples(spark, sf):
    return A.samples(A.fan(with_z(spark, sf), SCAN), fixtures.grid(spark, sf), SCAN).select("cand_id", "az", F.round("d", 6).alias("d"), "tr", "tc")


@query("sample_bilinear", f"with {rays(MIXED, CORNER)} select {KEY}, round(d, 6) as d, round(z, 5) as z from seen")
def sample_bilinear(spark, sf):
    points = A.seen(with_z(spark, sf), fixtures.dem(spark, sf), fixtures.grid(spark, sf), replace(SCAN, bilinear=True))
    return points.select("cand_id", "az", F.round("d", 6).alias("d"), F.round("z", 5).alias("z"))


@query("apparent_slope", f"with {rays()} select {KEY}, round(d, 6) as d, round(slope, 8) as slope from seen")
def apparent_slope(spark, sf):
    points = A.seen(with_z(spark, sf), fixtures.dem(spark, sf), fixtures.grid(spark, sf), SCAN)
    return points.select("cand_id", "az", F.round("d", 6).alias("d"), F.round("slope", 8).alias("slope"))


@query("first_hit", f"with {BINS} select {KEY}, cast(b as int) as b, round(d_hit, 6) as d_hit from cells where d_hit is not null")
def first_hit(spark, sf):
    return per_bin(spark, sf).where("d_hit is not null").select("cand_id", "az", "b", F.round("d_hit", 6).alias("d_hit"))


@query("target_rise", f"with {BINS} select {KEY}, cast(b as int) as b, round(rise, 6) as rise from cells where d_hit is not null")
def target_rise(spark, sf):
    return per_bin(spark, sf).where("d_hit is not null").select("cand_id", "az", "b", F.round("rise", 6).alias("rise"))


@query("column_depth", f"with {BINS} select {KEY}, cast(b as int) as b, round(depth, 4) as depth from cells")
def column_depth(spark, sf):
    return per_bin(spark, sf).select("cand_id", "az", "b", F.round("depth", 4).alias("depth"))


@query("horizon", f"with {BINS} select cand_id, round(degrees(atan(max(top))), 6) as horizon_deg from tops group by cand_id")
def horizon(spark, sf):
    return per_bin(spark, sf).groupBy("cand_id").agg(F.round(F.degrees(F.atan(F.max("top"))), 6).alias("horizon_deg"))


@query("accepted_cells", f"""with {BINS} select {KEY}, cast(b as int) as b, round(d_hit, 6) as d_hit, round(depth, 4) as depth from ok
    where rise between tan(radians(2.0)) and tan(radians(50.0)) and depth >= 5000""")
def accepted_cells(spark, sf):
    return A.accepted(per_bin(spark, sf), TARGET).select("cand_id", "az", "b", F.round("d_hit", 6).alias("d_hit"), F.round("depth", 4).alias("depth"))


@query("observables", f"""with {BINS}, o as (select cand_id, count(*) as cells, sum(omega) as om, avg(d_hit) as d, max(depth) as mx, avg(depth) as mn, avg(degrees(atan(rise))) as sl from ok group by cand_id),
    h as (select cand_id, degrees(atan(max(top))) as hz from tops group by cand_id)
    select cand_id, coalesce(cells, 0) as cells, round(coalesce(om, 0), 8) as solid_angle_sr, round(coalesce(d, 0), 4) as mean_distance_m, round(coalesce(mx, 0), 3) as max_depth_gcm2,
      round(coalesce(mn, 0), 3) as mean_depth_gcm2, round(coalesce(hz, 0), 6) as horizon_deg, round(coalesce(sl, 0), 6) as target_slope_deg, z0 as altitude_m
    from cand left join o using (cand_id) left join h using (cand_id)""")
def observables(spark, sf):
    o = A.observables(candidates(spark, sf), fixtures.dem(spark, sf), fixtures.grid(spark, sf), SCAN)
    return o.select("cand_id", "cells", F.round("solid_angle_sr", 8).alias("solid_angle_sr"), F.round("mean_distance_m", 4).alias("mean_distance_m"),
                    F.round("max_depth_gcm2", 3).alias("max_depth_gcm2"), F.round("mean_depth_gcm2", 3).alias("mean_depth_gcm2"),
                    F.round("horizon_deg", 6).alias("horizon_deg"), F.round("target_slope_deg", 6).alias("target_slope_deg"), "altitude_m")


BX = math.cos(math.radians(-14)) * math.sin(math.radians(-6.9))
BY = math.cos(math.radians(-14)) * math.cos(math.radians(-6.9))
BZ = -math.sin(math.radians(-14))


@query("geomag_weight", f"""with {BINS}, g as (select *, sin(radians(azimuth)) * cos(radians(theta)) * {BX} + cos(radians(azimuth)) * cos(radians(theta)) * {BY} + sin(radians(theta)) * {BZ} as dot from ok),
    s as (select cand_id, sum(omega * sqrt(greatest(0.0, 1 - dot * dot))) as x from g group by cand_id)
    select cand_id, round(coalesce(x, 0), 8) as geomag_solid_angle_sr from cand left join s using (cand_id)""")
def geomag_weight(spark, sf):
    o = A.observables(candidates(spark, sf), fixtures.dem(spark, sf), fixtures.grid(spark, sf), FIELD)
    return o.select("cand_id", F.round("geomag_solid_angle_sr", 8).alias("geomag_solid_angle_sr"))


@query("path_grammage", f"""with {BINS}, s as (select cand_id, avg(1.225 * exp(-z0 / 8400.0) * 8400.0 / sin(radians(theta)) * (1 - exp(-d_hit / cos(radians(theta)) * sin(radians(theta)) / 8400.0)) * 0.1) as x from ok group by cand_id)
    select cand_id, round(coalesce(x, 0), 6) as path_grammage_gcm2 from cand left join s using (cand_id)""")
def path_grammage(spark, sf):
    o = A.observables(candidates(spark, sf), fixtures.dem(spark, sf), fixtures.grid(spark, sf), SCAN)
    return o.select("cand_id", F.round("path_grammage_gcm2", 6).alias("path_grammage_gcm2"))


@query("earth_chord", f"""with {BINS}, s as (select cand_id, avg(case when theta < 0 then 2 * 6371000.0 * sin(radians(-theta)) * 265.0 else 0 end) as x from ok group by cand_id)
    select cand_id, round(coalesce(x, 0), 0) as earth_chord_gcm2 from cand left join s using (cand_id)""")
def earth_chord(spark, sf):
    o = A.observables(candidates(spark, sf), fixtures.dem(spark, sf), fixtures.grid(spark, sf), SCAN)
    return o.select("cand_id", F.round("earth_chord_gcm2", 0).alias("earth_chord_gcm2"))


@query("open_sky", f"""with {BINS} select cand_id, count(*) as cells, round(sum(cos(radians(theta)) * radians(5.0) * radians(80.0) / 3), 8) as solid_angle_sr
    from fan cross join edges where (cand_id, az, b) not in (select (cand_id, az, b) from hit) group by cand_id""")
def open_sky(spark, sf):
    known = with_z(spark, sf)
    free = A.open_cells(A.fan(known, SCAN), per_bin(spark, sf), SCAN)
    return free.groupBy("cand_id").agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum(A.solid_angle(F.col("theta"), SCAN)), 8).alias("solid_angle_sr"))


WAVE = P.LIGHT_SPEED / 50e6


@query("fresnel_clearance", f"""with {BINS}, path as (select ok.cand_id, az, b, azimuth, theta, d_hit as e, cand.r, cand.c, cand.z0 from ok join cand using (cand_id)),
    p0 as (select *, 100.0 + k * {ST} as d from (select *, unnest(range(0, cast(floor(greatest((e - 100) / {ST} + 1e-9, -1)) as bigint) + 1)) as k from path where e > 2 * {ST})),
    p1 as (select *, c + trunc(d * sin(radians(azimuth)) / {CX}) as tc, r - trunc(d * cos(radians(azimuth)) / {CY}) as tr from p0 where d <= e),
    p2 as (select p1.*, (z0 + 2 + d * tan(radians(theta)) - (z - d * d / (2 * 8500000.0))) as gap, sqrt({WAVE} * d * (e - d) / e) as r1 from p1 join dem on dem.r = tr and dem.c = tc where z is not null),
    worst as (select cand_id, az, b, min(gap / r1) as x from p2 where r1 > 0 group by all),
    best as (select cand_id, max(coalesce(x, 1e30)) as x from path left join worst using (cand_id, az, b) group by cand_id)
    select cand_id, round(coalesce(x, 0), 5) as best_clearance_ratio from cand left join best using (cand_id)""")
def fresnel_clearance(spark, sf):
    o = A.observables(candidates(spark, sf), fixtures.dem(spark, sf), fixtures.grid(spark, sf), RADIO)
    return o.select("cand_id", F.round("best_clearance_ratio", 5).alias("best_clearance_ratio"))


@query("rfi_exposure", f"""with {CAND}, src as (select s_suppkey * 37 % w.w as zr, s_suppkey * 61 % w.w as zc, 1.0 + s_suppkey as weight from supplier, w),
    lit as (select src.*, z as zs from src join dem on r = zr and c = zc where z is not null),
    pair as (select *, sqrt((zr - r) * {CY} * ((zr - r) * {CY}) + (zc - c) * {CX} * ((zc - c) * {CX})) as dist from cand, lit where z0 is not null),
    far as (select *, cast(trunc(dist / {ST}) as bigint) as steps from pair where dist >= 1),
    pt as (select *, k / steps as f from (select *, unnest(range(1, steps)) as k from far)),
    under as (select *, trunc(r + (zr - r) * f) as tr, trunc(c + (zc - c) * f) as tc from pt),
    blocked as (select distinct cand_id, zr, zc from under join dem d on d.r = tr and d.c = tc where d.z - dist * f * (dist * f) / (2 * 8500000.0) > z0 + (zs - z0) * f),
    s as (select cand_id, sum(weight / (dist * dist)) as x from far where (cand_id, zr, zc) not in (select (cand_id, zr, zc) from blocked) group by cand_id)
    select cand_id, round(coalesce(x, 0), 9) as rfi_exposure from cand left join s using (cand_id)""")
def rfi_exposure(spark, sf):
    src = fixtures.circles(spark, sf).select("zr", "zc", (1.0 + F.col("zone_id")).alias("weight"))
    o = sight.rfi_exposure(candidates(spark, sf), fixtures.dem(spark, sf), src, fixtures.grid(spark, sf), ST)
    return o.select("cand_id", F.round("rfi_exposure", 9).alias("rfi_exposure"))
