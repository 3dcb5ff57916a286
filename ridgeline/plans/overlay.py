"""Queries of combination and aperture (survey 2.H and 2.I)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.operators import combine as C
from ridgeline.operators import curves
from ridgeline.operators import screening as S
from ridgeline.operators.sites import SIN_60
from ridgeline.plans import base
from ridgeline.plans.base import DEM, GRAD, query
from ridgeline.plans.ground import DEG, LAT, LON, ground
from ridgeline.sources import fixtures, run_store
from ridgeline.sources.tables import load_curve, scratch_dir

RUNS = ["gentle", "steep", "south"]
AREA = C.pixel_area_km2(DEG, DEG, LAT)
MASKS = GRAD + """, masks as (select 'gentle' as run, r, c from ground where slope between 3 and 25 union all select 'steep', r, c from ground where slope between 15 and 60
    union all select 'south', r, c from ground where aspect between 90 and 270 and slope is not null),
  codes as (select r, c, bit_or(case run when 'gentle' then 1 when 'steep' then 2 else 4 end) as code from masks group by r, c)"""


def masks(spark: SparkSession, sf: str) -> DataFrame:
    g = ground(spark, sf)
    runs = [("gentle", S.slope_band(3, 25)), ("steep", S.slope_band(15, 60)), ("south", S.aspect_band(F.col("aspect"), 90, 270) & F.col("slope").isNotNull())]
    member = F.explode(F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in runs]), lambda x: x.isNotNull()))
    return g.select(member.alias("run"), "r", "c")


def codes(spark: SparkSession, sf: str) -> DataFrame:
    return C.membership(masks(spark, sf), RUNS)


@query("alignment_check", """with g as (select s_suppkey as run, 100 + s_suppkey // 40 as rows, 100 as cols, 0.1 as t0, 0.0 as t1, 0.0 as t2, -0.1 as t3, -72.0 + case when s_suppkey % 3 = 0 then 1e-6 else 1e-12 * s_suppkey end as t4, -15.0 as t5 from supplier)
    select a.run as run_a, b.run as run_b, a.rows = b.rows and abs(a.t4 - b.t4) <= 1e-9 as aligned from g a join g b on a.run < b.run""")
def alignment_check(spark, sf):
    return C.alignment(grids(spark, sf))


def grids(spark: SparkSession, sf: str) -> DataFrame:
    """A grid for each supplier."""
    k = F.col("s_suppkey")
    return spark.read.parquet(f"{sf}/supplier.parquet").select(
        k.alias("run"), (F.lit(100) + F.expr("s_suppkey div 40")).alias("rows"), F.lit(100).alias("cols"), F.lit(0.1).alias("t0"), F.lit(0.0).alias("t1"), F.lit(0.0).alias("t2"), F.lit(-0.1).alias("t3"),
        (-72.0 + F.when(k % 3 == 0, 1e-6).otherwise(1e-12 * k)).alias("t4"), F.lit(-15.0).alias("t5"))


@query("alignment_classes", """with g as (select s_suppkey as run, 100 + s_suppkey // 40 as rows, -72.0 + case when s_suppkey % 3 = 0 then 1e-6 else 1e-12 * s_suppkey end as t4 from supplier),
    v as (select rows, t4, sum(fresh) over (partition by rows order by t4) as g from (select rows, t4, coalesce((t4 - lag(t4) over (partition by rows order by t4) > 1e-9)::int, 0) as fresh from (select distinct rows, t4 from g)))
    select run, min(run) over w as class_id, count(*) over w as class_size, max(t4) over w - min(t4) over w <= 1e-9 as uniform from g join v using (rows, t4) window w as (partition by rows, g)""")
def alignment_classes(spark, sf):
    return C.alignment_classes(grids(spark, sf))


@query("joint_union", f"with {MASKS} select count(*) filter (code & 3 = 3) as joint_pixels, count(*) as union_pixels, round(count(*) filter (code & 3 = 3) * {AREA}, 6) as joint_km2, round(count(*) * {AREA}, 6) as union_km2 from codes")
def joint_union(spark, sf):
    j = C.joint_union(codes(spark, sf), 3, AREA)
    return j.select("joint_pixels", "union_pixels", F.round("joint_km2", 6).alias("joint_km2"), F.round("union_km2", 6).alias("union_km2"))


@query("run_share", f"""with {MASKS} select run, count(*) as pixels, round(count(*) * {AREA}, 6) as area_km2, round(count(*) filter (code = 7) * {AREA}, 6) as joint_km2,
    round(count(*) filter (code = 7) / count(*), 8) as joint_share from masks join codes using (r, c) group by run""")
def run_share(spark, sf):
    s = C.run_shares(codes(spark, sf), RUNS, AREA)
    return s.select("run", "pixels", F.round("area_km2", 6).alias("area_km2"), F.round("joint_km2", 6).alias("joint_km2"), F.round("joint_share", 8).alias("joint_share"))


@query("pairwise_overlap", f"""with {MASKS}, n as (select run, count(*) as n from masks group by run),
    p as (select a.run as run_a, b.run as run_b, count(*) as k from masks a join masks b using (r, c) where (a.run, b.run) in (('gentle', 'steep'), ('gentle', 'south'), ('steep', 'south')) group by all)
    select run_a, run_b, round(k * {AREA}, 6) as overlap_km2, round(k / (x.n + y.n - k), 8) as jaccard, round(k / x.n, 8) as share_a, round(k / y.n, 8) as share_b from p join n x on x.run = run_a join n y on y.run = run_b""")
def pairwise_overlap(spark, sf):
    p = C.pairwise(codes(spark, sf), RUNS, AREA)
    return p.select("run_a", "run_b", F.round("overlap_km2", 6).alias("overlap_km2"), *[F.round(c, 8).alias(c) for c in ("jaccard", "share_a", "share_b")])


@query("membership_bits", f"with {MASKS} select cast(r as int) as r, cast(c as int) as c, cast(code as int) as code from codes")
def membership_bits(spark, sf):
    return codes(spark, sf)


RADII = [0.3, 0.6, 0.9, 1.2, 5.0]
KM_LON = 111.32 * math.cos(math.radians(LAT - 0.01))
CELL_Y, CELL_X = DEG * 110.6 * 1000, DEG * KM_LON * 1000
COLO = MASKS + f""", rad as (select unnest({RADII}) as radius_km),
  away as (select r, c, sqrt(power(({LAT} - (r + 0.5) / 3600 - ({LAT - 0.01})) * 110.6, 2) + power(({LON} + (c + 0.5) / 3600 - ({LON + 0.01})) * {KM_LON}, 2)) as d from masks where run = 'steep'),
  pts as (select cast(floor(k * {50 * SIN_60} / {CELL_Y}) as bigint) as r, cast(floor((case when k % 2 = 1 then 25.0 else 0 end + j * 50.0) / {CELL_X}) as bigint) as c
    from (select k, unnest(range(cast(w.w * {CELL_X} / 50 as bigint) + 2)) as j, w.w from (select unnest(range(cast(w.w * {CELL_Y} / 43 as bigint) + 2)) as k from w), w) x, w
    where k * {50 * SIN_60} < w.w * {CELL_Y} and case when k % 2 = 1 then 25.0 else 0 end + j * 50.0 < w.w * {CELL_X}),
  np as (select r, c, count(*) as points from pts group by r, c),
  colo as (select radius_km, count(away.r) * {CELL_Y * CELL_X / 1e6} as area_km2, cast(coalesce(sum(points), 0) as bigint) as capacity from rad left join away on d <= radius_km left join np on np.r = away.r and np.c = away.c group by radius_km)"""


def colo(spark: SparkSession, sf: str) -> DataFrame:
    n = fixtures.width(spark, sf)
    return C.colocation(masks(spark, sf).where("run = 'steep'"), n, n, (DEG, -DEG, LON, LAT), (LAT - 0.01, LON + 0.01), RADII, 0.05)


@query("colocation", f"with {COLO} select cast(radius_km as double) as radius_km, round(area_km2, 6) as area_km2, capacity from colo")
def colocation(spark, sf):
    return colo(spark, sf).select("radius_km", F.round("area_km2", 6).alias("area_km2"), "capacity")


@query("smallest_radius", f"with {COLO} select cast(min(radius_km) filter (capacity >= 120) as double) as radius_km from colo")
def smallest_radius(spark, sf):
    return C.smallest_radius(colo(spark, sf), 120)


@query("reported_capacity", "select o_orderkey as run, case when o_orderkey % 3 > 0 then cast(floor(o_totalprice) as bigint) end as capacity from orders")
def reported_capacity(spark, sf):
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, "N/A").otherwise(F.floor("o_totalprice").cast("string"))
    return spark.read.parquet(f"{sf}/orders.parquet").select(k.alias("run"), C.reported_capacity(text).alias("capacity"))


AZ, ALT = math.radians(90 - 315), math.radians(45)
LX, LY, LZ = math.cos(AZ) * math.cos(ALT), math.sin(AZ) * math.cos(ALT), math.sin(ALT)


@query("hillshade", f"""with {DEM}, f as (select r, c, coalesce(z, (select quantile_cont(z, 0.5) from dem)) * 1.5 as z, w.w from dem, w),
    n as (select *, lag(z) over v as zn, lead(z) over v as zs, lag(z) over h as zw, lead(z) over h as ze from f window v as (partition by c order by r), h as (partition by r order by c)),
    g as (select r, c, case when r = 0 then zs - z when r = w - 1 then z - zn else (zs - zn) / 2 end as dy, case when c = 0 then ze - z when c = w - 1 then z - zw else (ze - zw) / 2 end as dx from n),
    l as (select r, c, (-dx * {LX} - dy * {LY} + {LZ}) / sqrt(dx * dx + dy * dy + 1) as light from g)
    select cast(r as int) as r, cast(c as int) as c, round((light - min(light) over ()) / (max(light) over () - min(light) over ()), 6) as shade from l""")
def hillshade(spark, sf):
    return C.hillshade(fixtures.dem(spark, sf)).select("r", "c", F.round("shade", 6).alias("shade"))


SITE_SQL = "site as (select s_suppkey as site_id, 1.0 + s_suppkey % 17 as area_km2, 0.05 + (s_suppkey % 11) / 100.0 as omega from supplier)"


def sites(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return spark.read.parquet(f"{sf}/supplier.parquet").select(k.alias("site_id"), (1.0 + k % 17).alias("area_km2"), (0.05 + (k % 11) / 100).alias("solid_angle_sr"))


LENGTH = "(en * (1e6 / 1.77686 * 8.703e-05))"


@query("aperture_curve", f"""with {SITE_SQL}, g as (select k, power(10.0, 4.0 * k / 25) as en from (select unnest(range(26)) as k))
    select cast(k as int) as k, round(en, 5) as energy_pev, round(sum(area_km2 * 1e6 * omega * (exp(-1000.0 / {LENGTH}) - exp(-20000.0 / {LENGTH}))), 0) as total_m2sr from site, g group by k, en""")
def aperture_curve(spark, sf):
    a = curves.aperture(sites(spark, sf), 1000.0, 20000.0)
    return a.groupBy("k", "energy_pev").agg(F.round(F.sum("aperture_m2sr"), 0).alias("total_m2sr")).withColumn("energy_pev", F.round("energy_pev", 5))


@query("peak_energy", f"""with x as (select s_suppkey as id, 100.0 + 50 * s_suppkey as near, 5000.0 + 333 * s_suppkey as far from supplier), g as (select power(10.0, -2 + 7.0 * k / 1999) as en from (select unnest(range(2000)) as k))
    select id, round(log10(arg_max(en, exp(-near / {LENGTH}) - exp(-far / {LENGTH}))), 2) as log_peak from x, g group by id""")
def peak_energy(spark, sf):
    k = F.col("s_suppkey")
    x = spark.read.parquet(f"{sf}/supplier.parquet").select(k.alias("id"), (100.0 + 50 * k).alias("near"), (5000.0 + 333 * k).alias("far"))
    return curves.peak_energy(x).select("id", F.round(F.log10("peak_energy_pev"), 2).alias("log_peak"))


TABLE = "t as (select power(10.0, n_nationkey / 8.0) as energy_pev, 0.01 + (n_nationkey % 7) * 0.5 as value from nation)"


def table(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey")
    return spark.read.parquet(f"{sf}/nation.parquet").select(F.pow(F.lit(10.0), k / 8).alias("energy_pev"), (0.01 + (k % 7) * 0.5).alias("value"))


@query("response_interp", f"""with {TABLE}, e as (select c_custkey as id, power(10.0, (c_custkey % 733) / 200.0 - 0.3003) as en from customer),
    s as (select energy_pev as e0, value as v0, lead(energy_pev) over (order by energy_pev) as e1, lead(value) over (order by energy_pev) as v1 from t)
    select id, round(coalesce(case when en > (select max(energy_pev) from t) then 0 else power(10.0, log10(v0) + (log10(en) - log10(e0)) / (log10(e1) - log10(e0)) * (log10(v1) - log10(v0))) end, 0), 7) as response
    from e asof left join s on e.en >= s.e0""")
def response_interp(spark, sf):
    k = F.col("c_custkey")
    e = spark.read.parquet(f"{sf}/customer.parquet").select(k.alias("id"), F.pow(F.lit(10.0), (k % 733) / 200 - 0.3003).alias("energy_pev"))
    return curves.interpolate(e, table(spark, sf)).select("id", F.round("response", 7).alias("response"))


@query("infer_response", f"""with {TABLE}, m as (select energy_pev as en, value, 12.0 * 1e6 * 0.1 * (exp(-1000.0 / (energy_pev * (1e6 / 1.77686 * 8.703e-05))) - exp(-20000.0 / (energy_pev * (1e6 / 1.77686 * 8.703e-05)))) as model from t),
    u as (select en, value / model as ratio from m where model > 1e-3 * (select max(model) from m)) select round(en, 6) as energy_pev, round(ratio / (select max(ratio) from u), 7) as response from u""")
def infer_response(spark, sf):
    r = curves.infer_response(table(spark, sf), 12.0, 0.1, 1000.0, 20000.0)
    return r.select(F.round("energy_pev", 6).alias("energy_pev"), F.round("response", 7).alias("response"))


HEX = math.sin(math.radians(60))


@query("scale_curve", f"""with a as (select r_name as name, 1000.0 * (r_regionkey + 1) as units, 0.15 + r_regionkey * 0.2 as spacing_km, case when r_regionkey % 2 = 0 then 'hex' else 'square' end as grid_type from region),
    c as (select r_name as name, power(10.0, n_nationkey / 8.0) as energy_pev, 1.0 + n_nationkey as value from nation join region on n_regionkey = r_regionkey)
    select name, round(energy_pev, 6) as energy_pev, round(value * 500.0 * 1.0 * {HEX} / (units * spacing_km * spacing_km * case grid_type when 'hex' then {HEX} else 1 end), 6) as value,
      round(500.0 * 1.0 * {HEX} / (units * spacing_km * spacing_km * case grid_type when 'hex' then {HEX} else 1 end), 8) as scale_factor from c join a using (name)""")
def scale_curve(spark, sf):
    k = F.col("r_regionkey")
    region = spark.read.parquet(f"{sf}/region.parquet")
    arrays = region.select(F.col("r_name").alias("name"), (1000.0 * (k + 1)).alias("units"), (0.15 + k * 0.2).alias("spacing_km"), F.when(k % 2 == 0, "hex").otherwise("square").alias("grid_type"))
    n = F.col("n_nationkey")
    c = spark.read.parquet(f"{sf}/nation.parquet").join(region, F.col("n_regionkey") == k).select(F.col("r_name").alias("name"), F.pow(F.lit(10.0), n / 8).alias("energy_pev"), (1.0 + n).alias("value"))
    s = curves.scale_curve(c, arrays, 500.0, 1.0, "hex")
    return s.select("name", F.round("energy_pev", 6).alias("energy_pev"), F.round("value", 6).alias("value"), F.round("scale_factor", 8).alias("scale_factor"))


@query("curve_load", "select n_nationkey * 1e-6 as energy_pev, n_regionkey * 1.5 as value from nation")
def curve_load(spark, sf):
    """A two-column file with comments, written from the nations and read back."""
    path = scratch_dir(spark, "curve")
    nations = spark.read.parquet(f"{sf}/nation.parquet").select(F.concat_ws(",", F.col("n_nationkey").cast("double"), F.col("n_regionkey") * 1.5).alias("value"))
    nations.unionByName(spark.range(1).select(F.lit("# energy, value").alias("value"))).write.text(path)
    return load_curve(spark, path)


PREFIXES = ("search", "older")
#: Runs of the store: mask, results under this name, georeferencing, elevation file.
WORLD = run_store.world_text(DEG, LAT, LON)
STORED = [("gentle", "gentle", "search", WORLD, "/data/high.dem"), ("steep", "steep", "older", WORLD, "/data/high.dem"), ("south", "south", "search", WORLD, "lost.dem"),
          ("bent", "gentle", "search", WORLD.rsplit("\n", 1)[0], "/data/high.dem"), ("bare", "steep", "other", WORLD, "/data/high.dem")]


def store(spark: SparkSession, sf: str) -> str:
    """The masks of three runs, and two bad records, in a new store."""
    path = scratch_dir(spark, "store")
    named = spark.createDataFrame(STORED, "run string, mask string, prefix string, world string, dem string")
    copies = masks(spark, sf).withColumnRenamed("run", "mask").join(F.broadcast(named.select("run", "mask")), "mask").select("run", "r", "c")
    records = named.select("run", "prefix", "world", F.to_json(F.struct(F.length("run").alias("total_capacity"))).alias("results"), F.to_json(F.struct("dem")).alias("provenance"))
    run_store.save(path, copies, records)
    return path


@query("runs_catalogue", f"""with {MASKS}, n as (select run as mask, count(*) as pixels from masks group by run),
    s(run, mask, prefix, dem, status) as (values ('gentle', 'gentle', 'search', 'b/high.dem', 'ok'), ('steep', 'steep', 'older', 'b/high.dem', 'ok'), ('south', 'south', 'search', null, 'ok'),
      ('bent', 'gentle', 'search', 'b/high.dem', 'not six terms'), ('bare', 'steep', null, null, 'no results'))
    select run, prefix, pixels, case when prefix is not null then length(run) end as capacity, dem, status, case when status = 'ok' then cast({LON} as double) end as west from s join n using (mask)""")
def runs_catalogue(spark, sf):
    dems = spark.createDataFrame([("high.dem", "b/high.dem"), ("high.dem", "c/high.dem"), ("low.dem", "b/low.dem")], "name string, location string")
    found = run_store.catalogue(spark, store(spark, sf), PREFIXES, dems)
    return found.select("run", "prefix", "pixels", "capacity", "dem", "status", F.round(F.col("terms")[4], 6).alias("west"))


@query("stored_overlap", base.SQL["pairwise_overlap"])
def stored_overlap(spark, sf):
    """As pairwise_overlap, of masks that were saved and read again."""
    stored, _ = run_store.open_masks(spark, store(spark, sf), RUNS, PREFIXES)
    p = C.pairwise(C.membership(stored, RUNS), RUNS, AREA)
    return p.select("run_a", "run_b", F.round("overlap_km2", 6).alias("overlap_km2"), *[F.round(c, 8).alias(c) for c in ("jaccard", "share_a", "share_b")])
