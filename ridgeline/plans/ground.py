"""Queries of sources and screening (survey 2.A and 2.B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.operators import combine as C
from ridgeline.operators import screening as S
from ridgeline.operators.quantiles import quantiles
from ridgeline.plans.base import CX, CY, DEM, GRAD, cand, query
from ridgeline.sources import fixtures, tables

LAT, LON, DEG = fixtures.ORIGIN_LAT, fixtures.ORIGIN_LON, 1 / 3600


def ground(spark: SparkSession, sf: str, regions: int = 1) -> DataFrame:
    """The DEM with gradients, slope and aspect."""
    g = S.gradients(fixtures.dem(spark, sf, regions), CY, CX)
    return g.withColumn("slope", S.slope_deg()).withColumn("aspect", S.aspect_deg())


RC = "cast(r as int) as r, cast(c as int) as c"


@query("dem_ingest", f"with {DEM} select 'a' as region, {RC}, case when z - 2200 >= -100 then z - 2200 end as z from dem")
def dem_ingest(spark, sf):
    return S.ingest(fixtures.dem(spark, sf).withColumn("z", F.col("z") - 2200))


@query("grid_geometry", f"""with {DEM}, g as (select max(r) + 1 as rows, max(c) + 1 as cols from dem)
    select 'a' as region, rows, cols, round(1/3600, 12) as cell_deg, round(110.6/3.6, 6) as cell_y_m,
      round(111.32/3.6 * cos(radians({LAT} - rows / 2 / 3600)), 6) as cell_x_m, round({LAT} - rows / 2 / 3600, 9) as center_lat,
      round({LON} + cols / 2 / 3600, 9) as center_lon, 'assumed' as source from g""")
def grid_geometry(spark, sf):
    g = tables.grid_geometry(fixtures.dem(spark, sf), LAT, LON)
    return g.select("region", "rows", "cols", F.round("cell_deg", 12).alias("cell_deg"), F.round("cell_y_m", 6).alias("cell_y_m"),
                    F.round("cell_x_m", 6).alias("cell_x_m"), F.round("center_lat", 9).alias("center_lat"), F.round("center_lon", 9).alias("center_lon"), "source")


@query("origin_check", """with x as (select s_suppkey as run, case when s_suppkey % 3 > 0 then s_acctbal / 200 end as file_lat, case when s_suppkey % 3 > 0 then s_acctbal / 150 end as file_lon,
      case when s_suppkey % 4 > 0 then s_acctbal / 200 + case when s_suppkey % 4 = 1 then 0.0005 else 0.5 end end as given_lat,
      case when s_suppkey % 4 > 0 then s_acctbal / 150 end as given_lon from supplier)
    select run, coalesce(given_lat, file_lat) as lat, coalesce(given_lon, file_lon) as lon,
      case when given_lat is null then case when file_lat is null then 'missing' else 'auto' end
           when file_lat is null then 'supplied' when greatest(abs(file_lat - given_lat), abs(file_lon - given_lon)) > 1e-3 then 'disagrees' else 'agrees' end as status from x""")
def origin_check(spark, sf):
    k, bal = F.col("s_suppkey"), F.col("s_acctbal")
    runs = spark.read.parquet(f"{sf}/supplier.parquet").select(
        k.alias("run"), F.when(k % 3 > 0, bal / 200).alias("file_lat"), F.when(k % 3 > 0, bal / 150).alias("file_lon"),
        F.when(k % 4 > 0, bal / 200 + F.when(k % 4 == 1, 0.0005).otherwise(0.5)).alias("given_lat"), F.when(k % 4 > 0, bal / 150).alias("given_lon"))
    return tables.origin_check(runs).select("run", "lat", "lon", "status")


@query("pixel_latlon", f"with {DEM} select {RC}, round({LAT} - r / 3600, 9) as lat, round({LON} + c / 3600, 9) as lon from dem")
def pixel_latlon(spark, sf):
    p = tables.pixel_latlon(fixtures.dem(spark, sf), LAT, LON, DEG)
    return p.select("r", "c", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@query("crop_window", f"with {DEM} select 'a' as region, cast(r - 5 as int) as r, cast(c - 7 as int) as c, z from dem where r between 5 and 24 and c between 7 and 29")
def crop_window(spark, sf):
    return tables.crop(fixtures.dem(spark, sf), (5, 25), (7, 30))


#: A box over half a pixel's edges; on small tables the map ends before it does.
BOX = (LAT - 24.3 / 3600, LAT - 5.4 / 3600, LON + 7.6 / 3600, LON + 60.2 / 3600)


@query("crop_box", f"""with {DEM}, b as (select cast(greatest(floor(({LAT} - {BOX[1]}) * 3600), 0) as bigint) as r0, least(cast(ceil(({LAT} - {BOX[0]}) * 3600) as bigint), w) as r1,
      cast(greatest(floor(({BOX[2]} - {LON}) * 3600), 0) as bigint) as c0, least(cast(ceil(({BOX[3]} - {LON}) * 3600) as bigint), w) as c1 from w)
    select 'a' as region, r1 - r0 as rows, c1 - c0 as cols, round({LAT} - r0 / 3600, 9) as origin_lat, round({LON} + c0 / 3600, 9) as origin_lon, round({LAT} - r1 / 3600, 9) as south,
      round({LON} + c1 / 3600, 9) as east, min(z) as z_min, max(z) as z_max from dem, b where r >= r0 and r < r1 and c >= c0 and c < c1 group by r0, r1, c0, c1""")
def crop_box(spark, sf):
    w = fixtures.width(spark, sf)
    found = tables.crop_box(fixtures.dem(spark, sf), LAT, LON, DEG, w, w, BOX)[1]
    return found.select("region", "rows", "cols", *[F.round(c, 9).alias(c) for c in ("origin_lat", "origin_lon", "south", "east")], "z_min", "z_max")


@query("map_extent", f"""with {DEM}, g as (select max(r) + 1 as rows, max(c) + 1 as cols from dem)
    select 'a' as region, round({LON} - 0.5 / 3600, 9) as left_, round({LON} + (cols - 0.5) / 3600, 9) as right_, round({LAT} - (rows - 0.5) / 3600, 9) as bottom_, round({LAT} + 0.5 / 3600, 9) as top_ from g""")
def map_extent(spark, sf):
    size = fixtures.dem(spark, sf).groupBy("region").agg((F.max("r") + 1).alias("rows"), (F.max("c") + 1).alias("cols"))
    edges = C.extent(DEG, -DEG, LON, LAT, F.col("rows"), F.col("cols"))
    return size.select("region", *[F.round(F.lit(e) if isinstance(e, float) else e, 9).alias(n) for n, e in zip(("left_", "right_", "bottom_", "top_"), edges, strict=True)])


@query("downsample", f"with {DEM} select 'a' as region, cast(r // 4 as int) as r, cast(c // 4 as int) as c, z from dem where r % 4 = 0 and c % 4 = 0")
def downsample(spark, sf):
    return tables.downsample(fixtures.dem(spark, sf), 4)


def osm_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON element a row from events; a fifth of the ids come again under a second tile."""
    k, v = F.col("event_id"), F.col("value")
    pt = lambda i: F.struct((F.lit(-15.0) - v / 1000 - i * 0.01).alias("lat"), (F.lit(-72.0) + v / 500 + i * 0.01).alias("lon"))
    tags = F.struct(F.when(k % 3 > 0, F.concat(F.lit("n"), k)).alias("name"), F.concat(F.lit("ref"), k % 7).alias("ref"), F.col("event_type").alias("highway"),
                    F.element_at(F.array(*map(F.lit, ("city", "town", "village", "hamlet"))), (k % 4 + 1).cast("int")).alias("place"),
                    F.when(k % 5 == 0, "unknown").otherwise(F.concat((k % 90 + 1).cast("string"), F.lit(","), F.lpad((k % 1000).cast("string"), 3, "0"))).alias("population"))
    n = (k % 4).cast("int")
    elem = F.struct(k.alias("id"), F.when(k % 6 > 0, F.lit(-15.0) - v / 1000).alias("lat"), (F.lit(-72.0) + v / 500).alias("lon"), tags.alias("tags"),
                    F.slice(F.array(*[pt(i) for i in range(4)]), F.lit(1), n).alias("geometry"))
    lines = spark.read.parquet(f"{sf}/events.parquet").select(k.alias("id"), F.to_json(elem).alias("elem"))
    again = lines.where("id % 5 = 0").select("id", F.lit(1).alias("tile"), F.regexp_replace("elem", '"name":"n', '"name":"again').alias("elem"))
    return lines.select("id", F.lit(0).alias("tile"), "elem").unionByName(again)


@query("roads_from_json", """select event_id as id, event_type as class, case when event_id % 3 > 0 then 'n' || event_id else 'ref' || event_id % 7 end as name,
      event_id % 4 as n_pts, round(-72.0 + value / 500, 5) as lon0, round(-15.0 - value / 1000, 5) as lat0 from events where event_id % 4 >= 2""")
def roads_from_json(spark, sf):
    return tables.roads(osm_lines(spark, sf)).select("id", "class", "name", F.size("pts").cast("long").alias("n_pts"), F.expr("pts[0].lon").alias("lon0"), F.expr("pts[0].lat").alias("lat0"))


@query("places_ranked", """select event_id as id, 'n' || event_id as name, ['city', 'town', 'village', 'hamlet'][event_id % 4 + 1] as place,
      case when event_id % 5 > 0 then (event_id % 90 + 1) * 1000 + event_id % 1000 end as population, round(-72.0 + value / 500, 5) as lon, round(-15.0 - value / 1000, 5) as lat,
      cast(event_id % 4 as int) as rank from events where event_id % 6 > 0 and event_id % 3 > 0 order by rank, population desc nulls last, id""")
def places_ranked(spark, sf):
    return tables.places(osm_lines(spark, sf)).orderBy("rank", F.desc_nulls_last("population"), "id")


@query("places_in_box", """with p as (select event_id as id, 'n' || event_id as name, ['city', 'town', 'village', 'hamlet'][event_id % 4 + 1] as place,
      case when event_id % 5 > 0 then (event_id % 90 + 1) * 1000 + event_id % 1000 end as population, round(-72.0 + value / 500, 5) as lon, round(-15.0 - value / 1000, 5) as lat,
      cast(event_id % 4 as int) as rank from events where event_id % 6 > 0 and event_id % 3 > 0)
    select * from p where lat between -15.06 and -15.01 and lon between -71.97 and -71.88""")
def places_in_box(spark, sf):
    return tables.places_inside(tables.places(osm_lines(spark, sf)), -15.06, -15.01, -71.97, -71.88)


@query("bbox_tiles", """with b as (select min(s_acctbal) / 1000 as s, max(s_acctbal) / 1000 as n from supplier),
    i as (select s, n, unnest(range(cast(ceil((n - s - 1e-9) / 1.2) as bigint))) as i from b), j as (select unnest(range(cast(ceil((8.5 - 1e-9) / 1.2) as bigint))) as j)
    select round(s + i * 1.2, 9) as lat_lo, round(least(n, s + (i + 1) * 1.2), 9) as lat_hi, round(-75.0 + j * 1.2, 9) as lon_lo, round(least(-66.5, -75.0 + (j + 1) * 1.2), 9) as lon_hi from i, j""")
def bbox_tiles(spark, sf):
    s, n = spark.read.parquet(f"{sf}/supplier.parquet").agg(F.min("s_acctbal") / 1000, F.max("s_acctbal") / 1000).first()
    t = tables.bbox_tiles(spark, s, n, -75.0, -66.5, 1.2)
    return t.select(*[F.round(c, 9).alias(c) for c in t.columns])


@query("zones_resolve", """with s as (select c_custkey as run, c_mktsegment as seg, c_acctbal as b from customer),
    p as (select n_name as name, lower(n_name) as preset, n_regionkey as k, n_nationkey as n from nation)
    select run, 'circle' as kind, cast(-10 - n as double) as lat, cast(-70 - k as double) as lon, cast(5 + n as double) as radius_km, name
      from s join p on run % 3 = 0 and p.n = run % 25
    union all select run, 'circle', round(b / 100, 4), round(b / 50, 4), 2.5, 'z' || run from s where run % 3 = 1""")
def zones_resolve(spark, sf):
    nations = spark.read.parquet(f"{sf}/nation.parquet")
    presets = nations.select(F.lower("n_name").alias("preset"), F.lit("circle").alias("kind"), (-10.0 - F.col("n_nationkey")).alias("lat"),
                             (-70.0 - F.col("n_regionkey")).alias("lon"), (5.0 + F.col("n_nationkey")).alias("radius_km"), F.col("n_name").alias("name"))
    k = F.col("c_custkey")
    named = nations.select(F.col("n_nationkey").alias("n"), F.col("n_name").alias("preset_name"))
    one = F.array(F.struct(F.lit("circle").alias("kind"), F.round(F.col("c_acctbal") / 100, 4).alias("lat"), F.round(F.col("c_acctbal") / 50, 4).alias("lon"),
                           F.lit(2.5).alias("radius_km"), F.concat(F.lit("z"), k).alias("name")))
    settings = spark.read.parquet(f"{sf}/customer.parquet").join(named, k % 25 == F.col("n")).select(
        k.alias("run"), F.when(k % 3 == 0, F.col("preset_name")).when(k % 3 == 1, F.to_json(one)).otherwise("none").alias("value"))
    return tables.resolve_zones(settings, presets)


@query("settlement_preset", """with p as (select c_mktsegment as preset, -10 - (c_custkey % 97) / 10.0 as lat, -70 - (c_custkey % 53) / 10.0 as lon from customer),
    b as (select r_regionkey as box, -20.0 + 2 * r_regionkey as south, -14.0 + 2 * r_regionkey as north, -75.5 as west, -70.0 as east from region),
    n as (select box, preset, count(*) as n from p join b on lat between south and north and lon between west and east group by all)
    select cast(box as int) as box, n, preset from (select *, row_number() over (partition by box order by n desc, preset) as k from n) where k = 1""")
def settlement_preset(spark, sf):
    k = F.col("c_custkey")
    places = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_mktsegment").alias("preset"), (-10 - (k % 97) / 10).alias("lat"), (-70 - (k % 53) / 10).alias("lon"))
    boxes = spark.read.parquet(f"{sf}/region.parquet").select(F.col("r_regionkey").alias("box"), (-20.0 + 2 * F.col("r_regionkey")).alias("south"),
                                                               (-14.0 + 2 * F.col("r_regionkey")).alias("north"), F.lit(-75.5).alias("west"), F.lit(-70.0).alias("east"))
    return tables.settlement_preset(places, boxes)


@query("dem_digest")
def dem_digest(spark, sf):
    return tables.digest(fixtures.dem(spark, sf), ["r", "c", "z"])


@query("smooth_box", f"""with {DEM}, pad as (select r, c, z from dem union all
      select -k, c, z from dem, (values (1)) v(k) where r = 0 union all select w.w - 1 + k, c, z from dem, w, (values (1)) v(k) where r = w.w - 1),
    v as (select r, c, sum(z) over o / 3 as z, count(z) over o as n from pad window o as (partition by c order by r rows between 1 preceding and 1 following)),
    v1 as (select r, c, case when n = 3 then z end as z from v, w where r between 0 and w.w - 1),
    padc as (select r, c, z from v1 union all select r, -k, z from v1, (values (1), (2)) v(k) where c = 0
      union all select r, w.w - 1 + k, z from v1, w, (values (1), (2)) v(k) where c = w.w - 1),
    h as (select r, c, sum(z) over o / 4 as z, count(z) over o as n from padc window o as (partition by r order by c rows between 2 preceding and 1 following))
    select {RC}, round(case when n = 4 then z end, 6) as z from h, w where c between 0 and w.w - 1""")
def smooth_box(spark, sf):
    return S.smooth(fixtures.dem(spark, sf), S.baseline_pixels(90, CY), S.baseline_pixels(120, CX)).select("r", "c", F.round("z", 6).alias("z"))


@query("gradients", f"with {GRAD} select {RC}, round(dzdy, 6) as dzdy, round(dzdx, 6) as dzdx from grad")
def gradients(spark, sf):
    return ground(spark, sf).select("r", "c", F.round("dzdy", 6).alias("dzdy"), F.round("dzdx", 6).alias("dzdx"))


@query("slope_aspect", f"with {GRAD} select {RC}, round(slope, 6) as slope, round(aspect, 6) as aspect from ground")
def slope_aspect(spark, sf):
    return ground(spark, sf).select("r", "c", F.round("slope", 6).alias("slope"), F.round("aspect", 6).alias("aspect"))


@query("screen_slope", f"with {GRAD} select {RC}, z from ground where slope between 3 and 25")
def screen_slope(spark, sf):
    return ground(spark, sf).where(S.slope_band(3, 25)).select("r", "c", "z")


@query("screen_altitude", f"with {DEM} select {RC}, z from dem where z between 2050 and 2300")
def screen_altitude(spark, sf):
    return fixtures.dem(spark, sf).where(S.altitude_band(2050, 2300)).select("r", "c", "z")


@query("screen_aspect", f"with {GRAD} select {RC}, round(aspect, 6) as aspect from ground where aspect >= 300 or aspect <= 45")
def screen_aspect(spark, sf):
    return ground(spark, sf).where(S.aspect_band(F.col("aspect"), 300, 45)).select("r", "c", F.round("aspect", 6).alias("aspect"))


ROADS = "road as (select o_orderkey // w.w as r, o_orderkey % w.w as c, floor(o_totalprice / 20) as dist_m from orders, w where o_orderkey < w.w * w.w)"
ZONES = "zone as (select s_suppkey as zone_id, s_suppkey * 37 % w.w as zr, s_suppkey * 61 % w.w as zc, abs(floor(s_acctbal / 100)) + 60 as radius_m from supplier, w)"
IN_CIRCLE = f"exists (select 1 from zone where power((r - zr) * {CY}, 2) + power((c - zc) * {CX}, 2) < radius_m * radius_m)"
POLYS = """poly as (select * from (values (0,0,0.1,0.1),(0,1,0.4,0.12),(0,2,0.38,0.35),(0,3,0.12,0.3),(1,0,0.5,0.5),(1,1,0.9,0.55),(1,2,0.62,0.62),(1,3,0.55,0.9)) v(zone_id,i,x,y)),
    edge as (select a.zone_id, a.x * w.w + 0.01 as ax, a.y * w.w + 0.01 as ay, b.x * w.w + 0.01 as bx, b.y * w.w + 0.01 as by_ from poly a join poly b on a.zone_id = b.zone_id and b.i = (a.i + 1) % 4, w),
    crossed as (select r, c, zone_id, count(*) as n from dem, edge where r > least(ay, by_) and r <= greatest(ay, by_) and c <= (r - ay) * (bx - ax) / (by_ - ay) + ax group by all),
    inside as (select distinct r, c from crossed where n % 2 = 1)"""


@query("screen_road", f"with {DEM}, {ROADS} select {RC}, z from dem join road using (r, c) where dist_m <= 6000")
def screen_road(spark, sf):
    return S.near_road(fixtures.dem(spark, sf), fixtures.road_distance(spark, sf), 6.0).select("r", "c", "z")


@query("exclude_circles", f"with {DEM}, {ZONES} select {RC}, z from dem where not {IN_CIRCLE}")
def exclude_circles(spark, sf):
    return S.outside_circles(fixtures.dem(spark, sf), fixtures.circles(spark, sf), CY, CX).select("r", "c", "z")


@query("exclude_polygons", f"with {DEM}, {POLYS} select {RC}, z from dem where (r, c) not in (select (r, c) from inside)")
def exclude_polygons(spark, sf):
    return S.outside_polygons(fixtures.dem(spark, sf), fixtures.polygons(spark, sf)).select("r", "c", "z")


@query("candidate_stride", f"with {cand()} select {RC}, round(aspect, 6) as aspect from cand")
def candidate_stride(spark, sf):
    return S.thin(ground(spark, sf).where(S.slope_band(12, 60)), 5, 32).select("r", "c", F.round("aspect", 6).alias("aspect"))


def screened(spark: SparkSession, sf: str) -> DataFrame:
    """The whole screen, cheap cuts first."""
    g = ground(spark, sf).where(S.slope_band(5, 60) & S.altitude_band(2010, 2600) & S.aspect_band(F.col("aspect"), 250, 120))
    g = S.near_road(g, fixtures.road_distance(spark, sf), 9.0)
    g = S.outside_polygons(S.outside_circles(g, fixtures.circles(spark, sf), CY, CX), fixtures.polygons(spark, sf))
    return S.thin(g, 3, 32)


@query("screen_full", f"""with {GRAD}, {ROADS}, {ZONES}, {POLYS},
    kept as (select r, c, aspect from ground join road using (r, c) where slope between 5 and 60 and z between 2010 and 2600 and (aspect >= 250 or aspect <= 120)
      and dist_m <= 9000 and not {IN_CIRCLE} and (r, c) not in (select (r, c) from inside))
    select {RC}, round(aspect, 6) as aspect from (select *, row_number() over (partition by r // 32, c // 32 order by r, c) - 1 as k from kept) where k % 3 = 0""")
def screen_full(spark, sf):
    return screened(spark, sf).select("r", "c", F.round("aspect", 6).alias("aspect"))


FUNNEL = """select cast(pos as int) as pos, stage, n, n / greatest(first_value(n) over (order by pos), 1) as of_dem, n / nullif(lag(n) over (order by pos), 0) as of_prev from counts"""


@query("funnel", f"""with {GRAD}, {ROADS}, g as (select ground.*, coalesce(dist_m <= 6000, false) as road from ground left join road using (r, c)),
    counts(pos, stage, n) as (select 0, 'DEM pixels', count(*) from g union all select 1, 'finite elevation', count(z) from g
      union all select 2, 'slope', count(*) from g where z is not null and slope between 3 and 25
      union all select 3, 'altitude', count(*) from g where z is not null and slope between 3 and 25 and z between 2050 and 2400
      union all select 4, 'aspect', count(*) from g where z is not null and slope between 3 and 25 and z between 2050 and 2400 and aspect between 45 and 300
      union all select 5, 'road', count(*) from g where z is not null and slope between 3 and 25 and z between 2050 and 2400 and aspect between 45 and 300 and road) {FUNNEL}""")
def funnel(spark, sf):
    near = fixtures.road_distance(spark, sf).where("dist_m <= 6000").select("region", "r", "c", F.lit(True).alias("road"))
    g = ground(spark, sf).join(near, ["region", "r", "c"], "left")
    return S.funnel([("DEM pixels", F.lit(True)), ("finite elevation", F.col("z").isNotNull()), ("slope", S.slope_band(3, 25)), ("altitude", S.altitude_band(2050, 2400)),
                     ("aspect", S.aspect_band(F.col("aspect"), 45, 300)), ("road", F.col("road"))], g)


@query("terrain_profile", f"""with {GRAD}, b as (select 'a' as region, z, slope from ground union all select 'b', z, slope_b from (
      select r, c, z, degrees(atan(sqrt(power(dzdy * {CY} / {CX}, 2) + power(dzdx * {CX} / {CY}, 2)))) as slope_b from grad))
    select region, count(*) as land, round(floor(quantile_disc(slope, 0.5) * 100) / 100, 2) as median_slope, round(avg(case when slope between 3 and 25 then 1.0 else 0 end), 6) as share_gentle,
      round(avg(case when slope between 15 and 60 then 1.0 else 0 end), 6) as share_steep from b where z > 0 and slope is not null group by region""")
def terrain_profile(spark, sf):
    """Median from a histogram of 0.01 degrees: bounded state whatever the number of pixels."""
    g = ground(spark, sf, 2).where("z > 0 and slope is not null")
    bins = g.groupBy("region", F.floor(F.col("slope") * 100).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(S.slope_band(3, 25)).alias("gentle"), F.count_if(S.slope_band(15, 60)).alias("steep"))
    up = bins.withColumn("upto", F.sum("n").over(Window.partitionBy("region").orderBy("bin"))).withColumn("land", F.sum("n").over(Window.partitionBy("region")))
    return up.groupBy("region").agg(F.max("land").alias("land"), F.round(F.min(F.when(F.col("upto") >= F.ceil(F.col("land") / 2), F.col("bin"))) / 100, 2).alias("median_slope"),
                                    F.round(F.sum("gentle") / F.max("land"), 6).alias("share_gentle"), F.round(F.sum("steep") / F.max("land"), 6).alias("share_steep"))


@query("altitude_limits", f"""with {DEM}, q as (select quantile_cont(z, 0.005) as lo, quantile_cont(z, 0.998) as hi, min(z) as least from dem where z is not null)
    select case when least <= 0 then 0.0 else floor(lo / 100) * 100 end as min_altitude, ceil(hi / 100) * 100 as max_altitude from q""")
def altitude_limits(spark, sf):
    z = quantiles(fixtures.dem(spark, sf).select(F.col("z").alias("value")), [], [0.0, 0.005, 0.998])
    return z.select(F.when(F.col("q")[0] <= 0, 0.0).otherwise(F.floor(F.col("q")[1] / 100) * 100).cast("double").alias("min_altitude"),
                    (F.ceil(F.col("q")[2] / 100) * 100).cast("double").alias("max_altitude"))
