"""Queries of explanation, sweeps and comparison (survey 2.J and 2.K), and of run records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline import stages
from ridgeline.operators import combine as C
from ridgeline.operators import explain as X
from ridgeline.operators import scan as A
from ridgeline.operators.screening import slope_band
from ridgeline.plans.arrival import BINS, SCAN, candidates
from ridgeline.plans.base import GRAD, query
from ridgeline.plans.ground import ground
from ridgeline.plans.overlay import MASKS, RUNS, codes
from ridgeline.sources import fixtures, tables

STAGES = [stages.DEM, stages.FINITE, stages.SLOPE, stages.ALTITUDE, stages.STRIDE, stages.DIRECTIONS, stages.SCORE, stages.CLOSED, stages.PRUNED, stages.SELECTED]
#: Funnels of runs from orders: counts fall at shares that the order's key and price give.
FUNNEL_SQL = f"""st as (select unnest(range(10)) as pos, unnest({STAGES}) as stage),
  funnel as (select o_orderkey as run, pos, stage, case when pos >= 5 and o_orderkey % 11 = 0 then 0 when pos = 7 then 900 + o_orderkey % 700
     else cast(floor(1000000.0 / (1 + pos * (1 + o_orderkey % 5)) / (1 + (o_orderkey * (pos + 3)) % 7)) as bigint) end as n from orders, st)"""


def funnels(spark: SparkSession, sf: str) -> DataFrame:
    k, pos = F.col("run"), F.col("pos")
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("run"), F.posexplode(F.array(*map(F.lit, STAGES))).alias("pos", "stage"))
    n = F.when((pos >= 5) & (k % 11 == 0), 0).when(pos == 7, 900 + k % 700).otherwise(F.floor(1000000.0 / (1 + pos * (1 + k % 5)) / (1 + (k * (pos + 3)) % 7)))
    return rows.withColumn("n", n.cast("long"))


KNOBS = "case stage " + " ".join(f"when '{p}' then '{' / '.join(k)}'" for p, k in stages.SETTINGS.items()) + " end"
SKIPPED = ", ".join(f"'{p}'" for p in stages.NOT_A_CUT)
BINDING = FUNNEL_SQL + f""", step as (select *, lag(n) over (partition by run order by pos) as before from funnel),
  cut as (select *, n / before as kept, n = 0 as fatal from step where before > 0 and stage not in ({SKIPPED})),
  live as (select * from (select *, max(fatal::int) over (partition by run order by pos rows between unbounded preceding and 1 preceding) as dead from cut) where coalesce(dead, 0) = 0),
  binding as (select run, stage, before, n, kept, fatal, {KNOBS} as knob from (select *, row_number() over (partition by run order by (not fatal), kept, pos) as k from live) where k = 1)"""


@query("binding_constraint", f"with {BINDING} select run, stage, before, n, round(kept, 9) as kept, fatal, knob from binding")
def binding_constraint(spark, sf):
    return X.binding_constraint(funnels(spark, sf)).withColumn("kept", F.round("kept", 9))


SITES_SQL = """srec as (select o_custkey as run, o_orderkey as site_id, row_number() over (partition by o_custkey order by o_orderkey) as pos, floor(o_totalprice / 1000) / 100 as area_km2,
    cast(floor(o_totalprice / 500) as bigint) as capacity_exact, case when o_custkey % 3 > 0 then o_orderkey % 3 > 0 end as selected,
    ((o_orderkey * 7) % 100) / 100.0 as s_depth, ((o_orderkey * 13) % 100) / 100.0 as s_distance, ((o_orderkey * 29) % 40 + 60) / 100.0 as s_shower from orders)"""


def site_records(spark: SparkSession, sf: str) -> DataFrame:
    k, run = F.col("o_orderkey"), F.col("o_custkey")
    pairs = {"score_depth_p50": ((k * 7) % 100) / 100, "score_distance_p50": ((k * 13) % 100) / 100, "score_shower_p50": ((k * 29) % 40 + 60) / 100,
             "max_depth_gcm2_p50": k * 10.0, "mean_distance_m_p50": k * 2.0, "score_depth_mean": F.lit(0.01)}
    scan = F.map_from_arrays(F.array(*map(F.lit, pairs)), F.array(*pairs.values()))
    return spark.read.parquet(f"{sf}/orders.parquet").select(
        run.alias("run"), k.alias("site_id"), F.row_number().over(Window.partitionBy(run).orderBy(k)).alias("pos"), (F.floor(F.col("o_totalprice") / 1000) / 100).alias("area_km2"),
        F.floor(F.col("o_totalprice") / 500).cast("long").alias("capacity_exact"), F.when(run % 3 > 0, k % 3 > 0).alias("selected"), scan.alias("arrival_scan"))


def totals(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return spark.read.parquet(f"{sf}/customer.parquet").select(k.alias("run"), F.when(k % 2 == 0, 3).alias("total_sites"))


SPLIT = SITES_SQL + ", split as (select *, case when run % 3 > 0 then selected else run % 2 = 1 or pos <= 3 end as is_selected from srec)"


def split(spark: SparkSession, sf: str) -> DataFrame:
    return X.split_selected(site_records(spark, sf), totals(spark, sf))


@query("selected_split", f"with {SPLIT} select run, site_id, is_selected from split")
def selected_split(spark, sf):
    return split(spark, sf).select("run", "site_id", "is_selected")


@query("closing_inflation", f"with {FUNNEL_SQL}, s as (select *, lag(n) over (partition by run order by pos) as before from funnel) select run, n / nullif(before * (1 + run % 5), 0) as inflation from s where stage = 'after gap closing'")
def closing_inflation(spark, sf):
    strides = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("run"), (1 + F.col("o_orderkey") % 5).alias("stride"))
    return X.closing_inflation(funnels(spark, sf), strides)


LONG = SITES_SQL + """, long as (select run, site_id, unnest(['depth', 'distance', 'shower']) as component, unnest([s_depth, s_distance, s_shower]) as score,
    unnest([site_id * 10.0, site_id * 2.0, null]) as evidence from srec)"""


@query("site_strengths", f"with {LONG} select run, site_id, component, score, evidence from long where score >= 0.75")
def site_strengths(spark, sf):
    return X.strengths(site_records(spark, sf))


WEAK = LONG + ", weak as (select * from (select *, row_number() over (partition by run, site_id order by score, component) as k from long) where k = 1)"


@query("weakest_component", f"with {WEAK} select run, site_id, component, score from weak")
def weakest_component(spark, sf):
    return X.weakest(site_records(spark, sf))


@query("common_weakness", f"""with {WEAK}, n as (select run, component, count(*) as n from weak group by all)
    select run, component, n / total as share from (select *, row_number() over (partition by run order by n desc, component) as k, sum(n) over (partition by run) as total from n) where k = 1""")
def common_weakness(spark, sf):
    return X.common_weakness(site_records(spark, sf))


@query("shared_strengths", f"""with {LONG} select run, component from long where score >= 0.6 group by run, component
    having count(*) = (select count(*) from srec s where s.run = long.run)""")
def shared_strengths(spark, sf):
    return X.shared_strengths(site_records(spark, sf), 0.6)


BANDS_SQL = """bands as (select s_suppkey // 8 as campaign, s_suppkey as run, unnest(['slope', 'altitude', 'aspect']) as band, unnest([s_suppkey % 10 * 1.0, 1000.0 + s_suppkey * 10, (s_suppkey * 53) % 360 * 1.0]) as lo,
    unnest([15.0 + s_suppkey % 20, 3000.0 + s_suppkey * 7, (s_suppkey * 97) % 360 * 1.0]) as hi from supplier)"""
OVERLAP = BANDS_SQL + """, part as (select campaign, run, band, case when band = 'aspect' and lo > hi then 360 - lo + hi else hi - lo end as own, lo as x0, case when band = 'aspect' and lo > hi then 360.0 else hi end as x1 from bands
    union all select campaign, run, band, 360 - lo + hi, 0.0, hi from bands where band = 'aspect' and lo > hi),
  over_ as (select a.run as run_a, b.run as run_b, a.band, sum(greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0)) as width, any_value(least(a.own, b.own)) as narrower from part a join part b on a.campaign = b.campaign and a.band = b.band and a.run < b.run group by all),
  overlap as (select run_a, run_b, band, width, coalesce(width / nullif(narrower, 0), 0) as share_of_narrower from over_)"""


def bands(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    three = F.array(*[F.struct(F.lit(b).alias("band"), lo.cast("double").alias("lo"), hi.cast("double").alias("hi")) for b, lo, hi in (
        ("slope", k % 10, 15 + k % 20), ("altitude", 1000 + k * 10, 3000 + k * 7), ("aspect", (k * 53) % 360, (k * 97) % 360))])
    return spark.read.parquet(f"{sf}/supplier.parquet").select(F.expr("s_suppkey div 8").alias("campaign"), k.alias("run"), F.inline(three))


@query("band_overlap", f"with {OVERLAP} select run_a, run_b, band, round(width, 6) as width, round(share_of_narrower, 9) as share_of_narrower from overlap")
def band_overlap(spark, sf):
    return X.band_overlap(bands(spark, sf)).withColumn("width", F.round("width", 6)).withColumn("share_of_narrower", F.round("share_of_narrower", 9))


def heads(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    targets = spark.read.parquet(f"{sf}/customer.parquet").select(k.alias("run"), (k % 60 * 100 + 500).alias("target"))
    return X.headline(split(spark, sf), targets)


@query("headline", f"""with {SPLIT}, h as (select run, count(*) filter (is_selected) as sites, coalesce(sum(area_km2) filter (is_selected), 0) as area_km2, cast(coalesce(sum(capacity_exact) filter (is_selected), 0) as bigint) as capacity,
      coalesce(sum(area_km2) filter (not is_selected), 0) as reserve_km2 from split group by run),
    l as (select run, site_id as largest_site from (select *, row_number() over (partition by run order by capacity_exact desc, site_id) as k from split where is_selected) where k = 1)
    select r as run, r % 60 * 100 + 500 as target, coalesce(sites, 0) as sites, round(coalesce(area_km2, 0), 2) as area_km2, coalesce(capacity, 0) as capacity, largest_site, round(coalesce(reserve_km2, 0), 2) as reserve_km2,
      greatest(r % 60 * 100 + 500 - coalesce(capacity, 0), 0) as shortfall from (select c_custkey as r from customer) left join h on h.run = r left join l on l.run = r""")
def headline(spark, sf):
    return heads(spark, sf).withColumn("area_km2", F.round("area_km2", 2)).withColumn("reserve_km2", F.round("reserve_km2", 2))


RUN_FACTS = """facts as (select o_orderkey as run, case when o_orderkey % 3 > 0 then 0.35 end as min_score, case when o_orderkey % 4 = 0 then 10.0 end as score_percentile,
    case when o_orderkey % 5 > 0 then (o_orderkey % 2) * 0.5 end as gap_close_km, 1 + o_orderkey % 3 as stride, o_orderkey % 6 as sites from orders)"""


def facts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return spark.read.parquet(f"{sf}/orders.parquet").select(
        k.alias("run"), F.when(k % 3 > 0, 0.35).alias("min_score"), F.when(k % 4 == 0, 10.0).alias("score_percentile"), F.when(k % 5 > 0, (k % 2) * 0.5).alias("gap_close_km"),
        (1 + k % 3).alias("stride"), (k % 6).alias("sites"))


@query("pass_rates", "select s_suppkey as run, (s_suppkey % 7) / nullif(s_suppkey * 11, 0) as pass_rate, coalesce((s_suppkey % 7) / nullif(s_suppkey * 11, 0) < 0.01, false) as fragmented from supplier")
def pass_rates(spark, sf):
    k = F.col("s_suppkey")
    return X.pass_rates(spark.read.parquet(f"{sf}/supplier.parquet").select(k.alias("run"), (k * 11).alias("labelled"), (k % 7).alias("passed")))


@query("assumptions", f"""with {RUN_FACTS} select run, 0 as pos, 'no score cut: any accepted direction makes a candidate count' as assumption from facts where min_score is null and score_percentile is null
    union all select run, 1, 'a percentile cut keeps its share of candidates however good they are' from facts where score_percentile is not null
    union all select run, 2, 'gaps are closed over the detector spacing, which was not measured' from facts where gap_close_km is null
    union all select run, 3, 'one pixel in ' || stride || ' stands for its neighbours' from facts where stride > 1
    union all select run, 4, 'capacity is a lattice over the ground: slope and access between its points are not looked at' from facts""")
def assumptions(spark, sf):
    return X.assumptions(facts(spark, sf))


@query("next_steps", f"""with {BINDING}, {RUN_FACTS}, b as (select facts.*, knob from facts left join binding using (run))
    select run, 0 as pos, 'sweep ' || regexp_extract(knob, '^[^ /,]+') as step from b where knob is not null
    union all select run, 1, 'rank by percentile instead of an absolute score' from b where min_score <> 0 and score_percentile is null
    union all select run, 2, 'run without gap closing' from b where gap_close_km is null or gap_close_km <> 0
    union all select run, 3, 'run with stride 1' from b where stride > 1 union all select run, 4, 'loosen the binding constraint first' from b where sites = 0""")
def next_steps(spark, sf):
    return X.next_steps(facts(spark, sf), X.binding_constraint(funnels(spark, sf)))


RUN_BANDS = [("gentle", "slope", 3.0, 25.0), ("steep", "slope", 15.0, 60.0), ("south", "aspect", 90.0, 270.0), ("gentle", "aspect", 300.0, 100.0), ("steep", "aspect", 0.0, 360.0)]


@query("combination_summary", f"""with {MASKS}, s as (select run, count(*) as pixels, count(*) filter (code = 7) / count(*) as joint_share from masks join codes using (r, c) group by run),
    t(run, band, other, share) as (values ('gentle', 'aspect', 'south', 10 / 160.0), ('steep', 'slope', 'gentle', 10 / 22.0), ('south', 'aspect', 'gentle', 10 / 160.0))
    select run, pixels, round(joint_share, 9) as joint_share, band as tightest_band, other as with_run, cast(round(share, 9) as double) as band_share from s left join t using (run)""")
def combination_summary(spark, sf):
    shares = C.run_shares(codes(spark, sf), RUNS, 1.0)
    table = F.array(*[F.struct(F.lit(0).alias("campaign"), F.lit(r).alias("run"), F.lit(b).alias("band"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for r, b, lo, hi in RUN_BANDS])
    c = X.combination(shares, X.band_overlap(spark.range(1).select(F.inline(table))))
    return c.withColumn("joint_share", F.round("joint_share", 9)).withColumn("band_share", F.round("band_share", 9))


@query("report_lines")
def report_lines(spark, sf):
    """All sections for the runs of the order table; regions and favoured energies come from suppliers and customers."""
    binding, k, c = X.binding_constraint(funnels(spark, sf)), F.col("s_suppkey"), F.col("c_custkey")
    stats = spark.read.parquet(f"{sf}/supplier.parquet").select(k.alias("run"), (k * 11).alias("labelled"), (k % 7).alias("passed"))
    peaks = spark.read.parquet(f"{sf}/customer.parquet").select(c.alias("run"), (F.lit(1.0) + c % 500).alias("energy_pev"))
    return X.report(heads(spark, sf), funnels(spark, sf), binding, X.next_steps(facts(spark, sf), binding), facts(spark, sf), stats, split(spark, sf), peaks)


@query("run_summary", f"""with {FUNNEL_SQL} select run, max(n) filter (pos = 0) as dem_pixels, max(n) filter (pos = 4) as kept, max(n) filter (pos = 6) as accepted, max(n) filter (pos = 8) as pruned,
    max(n) filter (pos = 6) / nullif(max(n) filter (pos = 4), 0) as acceptance from funnel group by run""")
def run_summary(spark, sf):
    return X.run_summary(funnels(spark, sf))


REGION_RUNS = """rr as (select n_name as region, count(*) as dem_pixels, count(*) filter (c_acctbal > 0) as accepted, count(*) filter (c_custkey % 3 = 0) as pruned from customer join nation on c_nationkey = n_nationkey group by 1)"""


@query("region_compare", f"""with {REGION_RUNS}, b as (select accepted / dem_pixels as a, pruned / dem_pixels as p from rr where region = (select min(region) from rr))
    select region, round(accepted / dem_pixels / nullif(a, 0), 9) as accepted_ratio, round(pruned / dem_pixels / nullif(p, 0), 9) as pruned_ratio from rr, b""")
def region_compare(spark, sf):
    runs = spark.read.parquet(f"{sf}/customer.parquet").join(spark.read.parquet(f"{sf}/nation.parquet"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("region")).agg(
        F.count(F.lit(1)).alias("dem_pixels"), F.count_if(F.col("c_acctbal") > 0).alias("accepted"), F.count_if(F.col("c_custkey") % 3 == 0).alias("pruned"))
    first = runs.agg(F.min("region")).first()[0]
    return X.compare_regions(runs, first).select("region", F.round("accepted_ratio", 9).alias("accepted_ratio"), F.round("pruned_ratio", 9).alias("pruned_ratio"))


@query("box_overlap", """with b as (select s_suppkey as name, -20.0 + (s_suppkey * 7 % 50) / 10.0 as south, -20.0 + (s_suppkey * 7 % 50) / 10.0 + 1.5 as north, -80.0 + (s_suppkey * 11 % 70) / 10.0 as west, -80.0 + (s_suppkey * 11 % 70) / 10.0 + 2 as east from supplier),
    p as (select x.name as a, y.name as b, greatest(x.south, y.south) as s, least(x.north, y.north) as n, greatest(x.west, y.west) as w, least(x.east, y.east) as e from b x join b y on x.name < y.name and x.south < y.north and y.south < x.north and x.west < y.east and y.west < x.east)
    select a as name_a, b as name_b, round((n - s) * 110.6 * (e - w) * 111.32 * cos(radians((n + s) / 2)), 5) as overlap_km2 from p""")
def box_overlap(spark, sf):
    k = F.col("s_suppkey")
    south, west = -20.0 + (k * 7 % 50) / 10, -80.0 + (k * 11 % 70) / 10
    b = spark.read.parquet(f"{sf}/supplier.parquet").select(k.alias("name"), south.alias("south"), (south + 1.5).alias("north"), west.alias("west"), (west + 2).alias("east"))
    return X.box_overlaps(b).withColumn("overlap_km2", F.round("overlap_km2", 5))


@query("sampling_control", f"""with {GRAD}, v as (select 1 as stride, 1 as downsample, count(*) * 1.0 as value from ground where slope between 15 and 60 union all
      select 2, 3, count(*) * 9.0 from ground where slope between 15 and 60 and r % 3 = 0 and c % 3 = 0 union all select 4, 5, count(*) * 25.0 from ground where slope between 15 and 60 and r % 5 = 0 and c % 5 = 0)
    select 'a' as region, stride, downsample, round(cast(value as double) / (select cast(value as double) from v where stride = 1), 9) as ratio from v""")
def sampling_control(spark, sf):
    steep = ground(spark, sf).where(slope_band(15, 60))
    settings = F.array(*[F.struct(F.lit(s).alias("stride"), F.lit(d).alias("downsample")) for s, d in ((1, 1), (2, 3), (4, 5))])
    rows = steep.select("region", "r", "c", F.inline(settings)).where("r % downsample = 0 and c % downsample = 0")
    runs = rows.groupBy("region", "stride", "downsample").agg((F.count(F.lit(1)) * F.max(F.col("downsample") * F.col("downsample"))).alias("value"))
    return X.sampling_control(runs).withColumn("ratio", F.round("ratio", 9))


@query("sweep", f"""with {BINS}, o as (select cand_id, coalesce(count(ok.b), 0) as cells, coalesce(sum(omega), 0) as om, coalesce(max(depth), 0) as depth from cand left join ok using (cand_id) group by cand_id),
    s(setting_id, param, value) as (values (0, 'baseline', 0.0), (1, 'cells', 2.0), (2, 'cells', 4.0), (3, 'depth', 100000.0), (4, 'depth', 300000.0), (5, 'solid_angle', 0.1)),
    c as (select setting_id, param, value, count(*) as kept, count(*) filter (case when param = 'cells' then cells >= value else cells >= 1 end and case when param = 'depth' then depth >= value else depth >= 50000 end
      and case when param = 'solid_angle' then om >= value else om >= 0.02 end) as accepted from o, s group by all)
    select cast(setting_id as int) as setting_id, param, cast(value as double) as value, kept, accepted, accepted / kept as acceptance, accepted / (select accepted from c where param = 'baseline') as ratio from c""")
def sweep(spark, sf):
    o = A.observables(candidates(spark, sf), fixtures.dem(spark, sf), fixtures.grid(spark, sf), SCAN)
    rows = [(0, "baseline", 0.0), (1, "cells", 2.0), (2, "cells", 4.0), (3, "depth", 1e5), (4, "depth", 3e5), (5, "solid_angle", 0.1)]
    settings = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("setting_id"), F.lit(p).alias("param"), F.lit(v).alias("value")) for i, p, v in rows])))
    test = lambda c, base: (F.col(c) >= base, F.col(c) >= F.col("value"))
    return X.relative(X.sweep(o, settings, {"cells": test("cells", 1), "depth": test("max_depth_gcm2", 5e4), "solid_angle": test("solid_angle_sr", 0.02)}))


@query("runs_load", """with r as (select o_custkey as dir, case o_orderkey % 3 when 0 then 'current' when 1 then 'legacy' else 'other' end as prefix, max(o_orderkey) as body from orders group by all)
    select dir, prefix, '{"run":' || body || '}' as body from (select *, row_number() over (partition by dir order by prefix) as k from r where prefix <> 'other') where k = 1""")
def runs_load(spark, sf):
    k = F.col("o_orderkey")
    prefix = F.element_at(F.array(F.lit("current"), F.lit("legacy"), F.lit("other")), (k % 3 + 1).cast("int"))
    records = spark.read.parquet(f"{sf}/orders.parquet").groupBy(F.col("o_custkey").alias("dir"), prefix.alias("prefix")).agg(F.to_json(F.struct(F.max(k).alias("run"))).alias("body"))
    return tables.load_runs(records, ("current", "legacy"))


@query("results_json")
def results_json(spark, sf):
    """Results by run as JSON, written and read back."""
    path = tables.scratch_dir(spark, "results")
    sites = split(spark, sf).groupBy("run").agg(F.array_sort(F.collect_list(F.struct("site_id", "area_km2", "capacity_exact", "is_selected"))).alias("sites"))
    heads(spark, sf).drop("sites").join(sites, "run", "left").write.json(path)
    kind = "run long, target long, sites array<struct<site_id: long, area_km2: double, capacity_exact: long, is_selected: boolean>>, capacity long, shortfall long"
    return spark.read.schema(kind).json(path).select("run", "target", F.size("sites").alias("listed"), "capacity", "shortfall")
