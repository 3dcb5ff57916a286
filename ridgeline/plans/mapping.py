"""Queries of morphology and sites (survey 2.F and 2.G)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.operators import masks as K
from ridgeline.operators import rings as R
from ridgeline.operators import scan as A
from ridgeline.operators import screening as S
from ridgeline.operators import sites as G
from ridgeline.plans.arrival import BINS, SCAN, candidates
from ridgeline.plans.base import CX, CY, GRAD, query
from ridgeline.plans.ground import LAT, LON, ground
from ridgeline.sources import fixtures
from ridgeline.sources.tables import downsample, outline, stage

H, W, PH, PW = 4, 3, 3, 2
FACTOR = 2
WITH = "with recursive "
PX_KM2 = CY * FACTOR / 1000 * (CX * FACTOR / 1000)
SPACING = 50.0
RC = "cast(r as int) as r, cast(c as int) as c"


def mask(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted ground: steep pixels, thinned."""
    return S.thin(ground(spark, sf).where(S.slope_band(15, 60)), 3, 32).select("region", "r", "c")


MASK = GRAD + """, mask as (select r, c from (select r, c, row_number() over (partition by r // 32, c // 32 order by r, c) - 1 as k from ground where slope between 15 and 60) where k % 3 = 0)"""


def grow(name: str, src: str, h: int, w: int) -> str:
    return f""", {name}_r as (select distinct r, c from (select unnest(range(r - {h // 2}, r + {h - 1 - h // 2} + 1)) as r, c from {src}), w where r between 0 and w.w - 1),
    {name} as (select distinct r, c from (select r, unnest(range(c - {w // 2}, c + {w - 1 - w // 2} + 1)) as c from {name}_r), w where c between 0 and w.w - 1)"""


def shrink(name: str, src: str, h: int, w: int) -> str:
    return f""", {name}_r as (select r, c from (select r, c, count(*) over (partition by c order by r range between {h // 2} preceding and {h - 1 - h // 2} following) as n from {src}) where n = {h}),
    {name} as (select r, c from (select r, c, count(*) over (partition by r order by c range between {w // 2} preceding and {w - 1 - w // 2} following) as n from {name}_r) where n = {w})"""


GROWN = MASK + grow("grown", "mask", H, W)
CLOSED = GROWN + shrink("closed", "grown", H, W)
PRUNED = CLOSED + shrink("thin", "closed", PH, PW) + grow("pruned", "thin", PH, PW)


@query("dilate", f"with {GROWN} select {RC} from grown")
def dilate(spark, sf):
    n = fixtures.width(spark, sf)
    return K.dilate(mask(spark, sf), H, W, n, n).select("r", "c")


@query("erode", f"with {CLOSED} select {RC} from closed")
def erode(spark, sf):
    n = fixtures.width(spark, sf)
    return K.erode(K.dilate(mask(spark, sf), H, W, n, n), H, W, n, n).select("r", "c")


def cleaned(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Runs of the closed mask and of the pruned one."""
    n = fixtures.width(spark, sf)
    return K.cleaned(mask(spark, sf), (H, W), (PH, PW), n, n)


def pruned(spark: SparkSession, sf: str) -> DataFrame:
    """Runs, written, as labels and capacity both read them."""
    return stage(cleaned(spark, sf)[1], "pruned")


@query("close_gaps", f"with {CLOSED} select {RC} from closed union select {RC} from closed")
def close_gaps(spark, sf):
    n = fixtures.width(spark, sf)
    return K.close_gaps(mask(spark, sf), H, W, n, n).select("r", "c")


@query("prune_tendrils", f"with {PRUNED} select {RC} from pruned")
def prune_tendrils(spark, sf):
    return K.pixels(cleaned(spark, sf)[1]).select("r", "c")


@query("stride_check", """with p as (select s_suppkey as run, s_suppkey % 9 + 1 as stride, 20.0 + s_suppkey % 11 as cell_y_m, case when s_suppkey % 4 = 0 then null else (s_suppkey % 5) * 0.05 end as gap_close_km, 0.1 as spacing_km from supplier)
    select run, stride * cell_y_m as gap_m, coalesce(gap_close_km, spacing_km) * 1000 as element_m, stride * cell_y_m / nullif(coalesce(gap_close_km, spacing_km) * 1000, 0) as ratio,
      stride > 1 and stride * cell_y_m > coalesce(gap_close_km, spacing_km) * 1000 as outruns from p""")
def stride_check(spark, sf):
    k = F.col("s_suppkey")
    p = spark.read.parquet(f"{sf}/supplier.parquet").select(k.alias("run"), (k % 9 + 1).alias("stride"), (20.0 + k % 11).alias("cell_y_m"),
                                                             F.when(k % 4 != 0, (k % 5) * 0.05).alias("gap_close_km"), F.lit(0.1).alias("spacing_km"))
    return K.stride_check(p)


def labels(spark: SparkSession, sf: str, clean: DataFrame | None = None) -> DataFrame:
    """Label runs of the decimated map."""
    n = fixtures.width(spark, sf)
    return G.label_runs(K.downsampled(cleaned(spark, sf)[1] if clean is None else clean, FACTOR), n)


LABELS = PRUNED + f""",
small as (select r // {FACTOR} as r, c // {FACTOR} as c from pruned where r % {FACTOR} = 0 and c % {FACTOR} = 0),
run as (select r, min(c) as lo, max(c) as hi, r * w.w + min(c) as id from (select r, c, c - row_number() over (partition by r order by c) as g from small), w group by r, g, w.w),
link as (select a.id as a, b.id as b from run a join run b on abs(a.r - b.r) = 1 and a.lo <= b.hi and b.lo <= a.hi),
reach as (select id as a, id as b from run union select reach.a, link.b from reach join link on reach.b = link.a),
rooted as (select run.*, root as first from run join (select a, min(b) as root from reach group by a) on a = id),
named as (select *, dense_rank() over (order by first) as site_id from rooted),
label as (select r, unnest(range(lo, hi + 1)) as c, first, site_id from named)"""


@query("label_regions", f"{WITH}{LABELS} select {RC}, first, cast(site_id as int) as site_id from label")
def label_regions(spark, sf):
    return K.pixels(labels(spark, sf), "first", "site_id").select("r", "c", "first", "site_id")


@query("region_area", f"{WITH}{LABELS} select cast(site_id as int) as site_id, count(*) as pixels, round(count(*) * {PX_KM2}, 6) as area_km2 from label group by site_id")
def region_area(spark, sf):
    return G.areas(labels(spark, sf), PX_KM2).select("site_id", "pixels", F.round("area_km2", 6).alias("area_km2"))


NEED = G.required_pixels(5, SPACING / 1000, PX_KM2)


@query("area_threshold", f"{WITH}{LABELS} select cast(site_id as int) as site_id, count(*) as pixels from label group by site_id having count(*) >= {NEED}")
def area_threshold(spark, sf):
    return G.areas(labels(spark, sf), PX_KM2).where(F.col("pixels") >= NEED).select("site_id", "pixels")


@query("region_bbox", f"{WITH}{LABELS} select cast(site_id as int) as site_id, cast(min(r) as int) as r0, cast(max(r) + 1 as int) as r1, cast(min(c) as int) as c0, cast(max(c) + 1 as int) as c1 from label group by site_id")
def region_bbox(spark, sf):
    return G.boxes(labels(spark, sf)).drop("region")


def small_aspect(spark: SparkSession, sf: str) -> DataFrame:
    """Aspect of the decimated terrain."""
    small = S.gradients(downsample(fixtures.dem(spark, sf), FACTOR), CY * FACTOR, CX * FACTOR)
    return small.select("region", "r", "c", S.aspect_deg().alias("aspect"))


SMALL_ASPECT = f""", sdem as (select r // {FACTOR} as r, c // {FACTOR} as c, z, (w.w + {FACTOR - 1}) // {FACTOR} as sw from dem, w where r % {FACTOR} = 0 and c % {FACTOR} = 0),
snear as (select *, lag(z) over v as zn, lead(z) over v as zs, lag(z) over h as zw, lead(z) over h as ze from sdem window v as (partition by c order by r), h as (partition by r order by c)),
sgrad as (select r, c, case when r = 0 then (zs - z) / {CY * FACTOR} when r = sw - 1 then (z - zn) / {CY * FACTOR} else (zs - zn) / (2 * {CY * FACTOR}) end as dy,
  case when c = 0 then (ze - z) / {CX * FACTOR} when c = sw - 1 then (z - zw) / {CX * FACTOR} else (ze - zw) / (2 * {CX * FACTOR}) end as dx from snear),
sasp as (select r, c, ((degrees(atan2(-dx, dy)) % 360) + 360) % 360 as aspect from sgrad)"""


@query("site_facing", f"""{WITH}{LABELS}{SMALL_ASPECT}, m as (select site_id, avg(aspect) as a from label join sasp using (r, c) group by site_id)
    select cast(site_id as int) as site_id, round(a, 4) as mean_aspect_deg, ['N','NE','E','SE','S','SW','W','NW'][cast(round_even(a / 45, 0) as int) % 8 + 1] as facing_direction from m where a is not null""")
def site_facing(spark, sf):
    o = G.orientation(labels(spark, sf), small_aspect(spark, sf)).where("mean_aspect_deg is not null")
    return o.select("site_id", F.round("mean_aspect_deg", 4).alias("mean_aspect_deg"), "facing_direction")


def capacities(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Label runs, written, and the capacity of each site."""
    clean = pruned(spark, sf)
    lab = stage(labels(spark, sf, clean), "labels")
    return lab, G.capacity(lab, clean, FACTOR, CY, CX, SPACING)


PITCH = SPACING * G.SIN_60
CAPS = f""", box as (select site_id, min(r) * {FACTOR} as r0, min(c) * {FACTOR} as c0, (max(r) + 1 - min(r)) * {FACTOR} as h, (max(c) + 1 - min(c)) * {FACTOR} as wd from label group by site_id),
lk as (select *, unnest(range(cast(ceil(h * {CY} / {PITCH}) as bigint) + 1)) as k from box),
lj as (select *, case when k % 2 = 1 then {SPACING / 2} else 0.0 end as x0, unnest(range(cast(ceil(wd * {CX} / {SPACING}) as bigint) + 1)) as j from lk where k * {PITCH} < h * {CY}),
pt as (select site_id, r0 + cast(floor(k * {PITCH} / {CY}) as bigint) as r, c0 + cast(floor((x0 + j * {SPACING}) / {CX}) as bigint) as c, cast(floor(k * {PITCH} / {CY}) as bigint) as pr,
  cast(floor((x0 + j * {SPACING}) / {CX}) as bigint) as pc, h, wd from lj where x0 + j * {SPACING} < wd * {CX}),
cap as (select box.site_id, count(p.site_id) as capacity_exact from box left join (select pt.site_id from pt join label l on l.site_id = pt.site_id and l.r = pt.r // {FACTOR} and l.c = pt.c // {FACTOR}
  join pruned m on m.r = pt.r and m.c = pt.c where pr < h and pc < wd) p on p.site_id = box.site_id group by box.site_id)"""


@query("lattice_capacity", f"{WITH}{LABELS}{CAPS} select cast(site_id as int) as site_id, capacity_exact from cap")
def lattice_capacity(spark, sf):
    return capacities(spark, sf)[1].select("site_id", "capacity_exact")


STEP = FACTOR / 3600


@query("site_centre", f"""{WITH}{LABELS} select cast(site_id as int) as site_id, round({LAT} - avg(r) * {STEP}, 6) as center_lat, round({LON} + avg(c) * {STEP}, 6) as center_lon, round({LAT} - min(r) * {STEP}, 6) as north,
    round({LAT} - (max(r) + 1) * {STEP}, 6) as south, round({LON} + min(c) * {STEP}, 6) as west, round({LON} + (max(c) + 1) * {STEP}, 6) as east from label group by site_id""")
def site_centre(spark, sf):
    return G.centres(labels(spark, sf), LAT, LON, STEP).select("site_id", "center_lat", "center_lon", "bounds.north", "bounds.south", "bounds.west", "bounds.east")


@query("select_sites", f"""{WITH}{LABELS}{CAPS}, o as (select *, coalesce(sum(capacity_exact) over (order by capacity_exact desc, site_id rows between unbounded preceding and 1 preceding), 0) as before,
      row_number() over (order by capacity_exact desc, site_id) as k from cap where capacity_exact >= 5)
    select cast(site_id as int) as site_id, capacity_exact, before < 60 as selected, cast(case when before < 60 then k end as int) as viz_id, cast(sum(case when before < 60 then capacity_exact end) over () as bigint) as total_capacity from o""")
def select_sites(spark, sf):
    return G.select_sites(capacities(spark, sf)[1].where("capacity_exact >= 5"), 60, True, True).drop("region")


#: The scan's clauses after the shared ground clauses.
SCAN_SQL = BINS[len(GRAD):]


@query("site_observables", f"""{WITH}{LABELS}{SCAN_SQL}, o as (select cand_id, avg(d_hit) as d from ok group by cand_id), hz as (select cand_id, degrees(atan(max(top))) as h from tops group by cand_id)
    select cast(site_id as int) as site_id, count(*) as candidates, round(avg(d), 5) as mean_distance_m_mean, round(quantile_cont(d, 0.5), 5) as mean_distance_m_p50, round(quantile_cont(d, 0.9), 5) as mean_distance_m_p90,
      round(avg(h), 5) as horizon_deg_mean, round(quantile_cont(h, 0.5), 5) as horizon_deg_p50, round(quantile_cont(h, 0.9), 5) as horizon_deg_p90
    from o join hz using (cand_id) join cand using (cand_id) join label on label.r = cand.r // {FACTOR} and label.c = cand.c // {FACTOR} group by site_id""")
def site_observables(spark, sf):
    o = A.observables(candidates(spark, sf), fixtures.dem(spark, sf), fixtures.grid(spark, sf), SCAN).where("cells > 0")
    s = G.site_observables(labels(spark, sf), o, FACTOR, ["mean_distance_m", "horizon_deg"])
    return s.select("site_id", "candidates", *[F.round(c, 5).alias(c) for c in s.columns if c[-4:] in ("mean", "_p50", "_p90")])


def site_table(spark: SparkSession, sf: str) -> DataFrame:
    """All labelled regions with pixels, capacity and whether they are selected."""
    lab, caps = capacities(spark, sf)
    caps = stage(caps.join(G.areas(lab, PX_KM2), ["region", "site_id"]), "capacities")
    kept = G.select_sites(caps.where((F.col("pixels") >= NEED) & (F.col("capacity_exact") >= 5)), 60, True, True)
    return caps.join(kept.select("region", "site_id", "selected", "viz_id", "total_capacity"), ["region", "site_id"], "left").fillna(False, ["selected"])


SITES = CAPS + f""", px as (select site_id, count(*) as pixels from label group by site_id),
o as (select site_id, coalesce(sum(capacity_exact) over (order by capacity_exact desc, site_id rows between unbounded preceding and 1 preceding), 0) < 60 as selected
  from cap join px using (site_id) where pixels >= {NEED} and capacity_exact >= 5),
site as (select site_id, pixels, capacity_exact, coalesce(selected, false) as selected from cap join px using (site_id) left join o using (site_id))"""


@query("region_stats", f"""{WITH}{LABELS}{SITES} select count(*) as labelled_regions, count(*) filter (pixels >= {NEED}) as passed_area_threshold,
    count(*) filter (pixels >= {NEED} and capacity_exact >= 5) as passed_capacity_threshold, count(*) filter (selected) as selected, cast(coalesce(sum(pixels) filter (selected), 0) * {FACTOR * FACTOR} as bigint) as pixels_in_selected from site""")
def region_stats(spark, sf):
    return G.region_stats(site_table(spark, sf), NEED, 5, FACTOR).drop("region")


@query("site_outline", f"""{WITH}{LABELS}, side as (select *, unnest(['n','s','w','e']) as side, unnest([-1,1,0,0]) as dr, unnest([0,0,-1,1]) as dc from label)
    select cast(s.site_id as int) as site_id, s.r::int as r, s.c::int as c, side, round({LAT} - (s.r + (side = 's')::int) * {STEP}, 9) as lat0, round({LON} + (s.c + (side = 'e')::int) * {STEP}, 9) as lon0,
      round({LAT} - (s.r + (side <> 'n')::int) * {STEP}, 9) as lat1, round({LON} + (s.c + (side <> 'w')::int) * {STEP}, 9) as lon1
    from side s where not exists (select 1 from label n where n.site_id = s.site_id and n.r = s.r + s.dr and n.c = s.c + s.dc)""")
def site_outline(spark, sf):
    o = outline(K.pixels(labels(spark, sf), "site_id"), LAT, LON, STEP)
    return o.select("site_id", "r", "c", "side", *[F.round(x, 9).alias(x) for x in ("lat0", "lon0", "lat1", "lon1")])


@query("site_rings", f"""{WITH}{LABELS}, px as (select site_id, count(*) as n from label group by site_id),
    pair as (select a.site_id, count(*) as n from label a join label b on a.site_id = b.site_id and ((b.r = a.r + 1 and b.c = a.c) or (b.r = a.r and b.c = a.c + 1)) group by a.site_id),
    quad as (select a.site_id, count(*) as n from label a join label b on b.site_id = a.site_id and b.r = a.r + 1 and b.c = a.c join label c on c.site_id = a.site_id and c.r = a.r and c.c = a.c + 1
      join label d on d.site_id = a.site_id and d.r = a.r + 1 and d.c = a.c + 1 group by a.site_id)
    select cast(px.site_id as int) as site_id, 2 - (px.n - coalesce(pair.n, 0) + coalesce(quad.n, 0)) as rings, 1 - (px.n - coalesce(pair.n, 0) + coalesce(quad.n, 0)) as holes,
      4 * px.n - 2 * coalesce(pair.n, 0) as edges, px.n as area_px from px left join pair using (site_id) left join quad using (site_id)""")
def site_rings(spark, sf):
    """Holes by Euler's formula in the SQL, by traced rings here."""
    return R.summary(R.rings(stage(labels(spark, sf), "labels"))).drop("region")


@query("ring_corners")
def ring_corners(spark, sf):
    return R.corners(R.rings(stage(labels(spark, sf), "labels")), LAT, LON, STEP).drop("region")
