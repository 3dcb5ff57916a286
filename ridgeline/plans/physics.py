"""Queries of the physics annotations (survey 2.E), over energies, distances and angles that
come with the rows of the driver's tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.functions import physics as P
from ridgeline.operators import curves, scores
from ridgeline.plans.base import query

#: Row values: energy_pev 0.1 to 1000, distance, angle, altitude.
ROWS = """x as (select event_id as id, power(10.0, (event_id % 401) / 100.0 - 1) as e, 100.0 + (event_id % 997) * 50 as d, (event_id % 181) / 10.0 - 9.05 as th,
    (event_id % 4000) * 1.0 as alt, -30 + (event_id % 61) * 1.0 as lat, -80 + (event_id % 37) * 1.0 as lon, (event_id % 360) * 1.0 as az, 1.0 + event_id % 3000 as g from events)"""
LEN = "(e * (1e6 / 1.77686 * 8.703e-05))"
LINT = "(1 / (6.022e23 * 6.04e-36 * power(e * 1e6, 0.358)))"
BETA = "(6e-07 * power(e / 1000.0, 0.2))"


def rows(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    return spark.read.parquet(f"{sf}/events.parquet").select(
        k.alias("id"), F.pow(F.lit(10.0), (k % 401) / 100 - 1).alias("e"), (100.0 + (k % 997) * 50).alias("d"), ((k % 181) / 10 - 9.05).alias("th"),
        (k % 4000).cast("double").alias("alt"), (-30 + (k % 61)).cast("double").alias("lat"), (-80 + (k % 37)).cast("double").alias("lon"),
        (k % 360).cast("double").alias("az"), (1.0 + k % 3000).alias("g"))


def rounded(df: DataFrame, digits: int, **cols) -> DataFrame:
    """Significant digits rather than places: values span many decades."""
    return df.select("id", *[F.when(F.abs(c) < 1e-290, 0.0).otherwise(F.round(c / F.pow(F.lit(10.0), F.floor(F.log10(F.abs(c)))), digits)).alias(n) for n, c in cols.items()])


def sig(expr: str, name: str, digits: int) -> str:
    return f"case when abs({expr}) < 1e-290 then 0.0 else round(({expr}) / power(10.0, floor(log10(abs({expr})))), {digits}) end as {name}"


def sql(digits: int, **cols: str) -> str:
    return f"with {ROWS} select id, {', '.join(sig(e, n, digits) for n, e in cols.items())} from x"


@query("decay_window", sql(7, length=LEN, energy="d / 8.703e-05 * 1.77686 / 1e6", decays=f"exp(-d / {LEN}) - exp(-(d + 5000) / {LEN})", reach=f"{LEN} + 3000"))
def decay_window(spark, sf):
    e, d = F.col("e"), F.col("d")
    return rounded(rows(spark, sf), 7, length=P.decay_length(e), energy=P.energy_for_decay_length(d), decays=P.decay_probability(d, d + 5000, e), reach=P.decay_length(e) + 3000)


GRID = """grid as (select k, exp(ln(1.0) + (ln(100.0) - ln(1.0)) * k / 95) as en from (select unnest(range(96)) as k)),
  raw as (select k, en, power(en, -1.0) as wt, case when k in (0, 95) then 0.5 else 1 end as tr from grid), norm as (select k, en, wt * tr / (select sum(wt * tr) from raw) as share from raw)"""


@query("decay_spectrum", f"""with {ROWS}, {GRID}, p as (select distinct d from x), f as (select d, sum((1 - exp(-greatest(d - 3000, 0) / (en * (1e6 / 1.77686 * 8.703e-05)))) * share) as p from p, norm group by d)
    select id, round(p, 7) as decay from x join f using (d)""")
def decay_spectrum(spark, sf):
    return rows(spark, sf).select("id", F.round(scores.spectrum_decay(F.col("d"), 1.0, 100.0, (2.0,), 3000.0), 7).alias("decay"))


BASE = "1.225 * exp(-alt / 8400.0)"
RISE = "(d / cos(radians(th)) * sin(radians(th)))"


@query("atmosphere", sql(7, density=BASE, grammage=f"case when abs(sin(radians(th))) < 1e-9 then {BASE} * d / cos(radians(th)) * 0.1 else {BASE} * (8400.0 / sin(radians(th))) * (1 - exp(-{RISE} / 8400.0)) * 0.1 end",
                         maturity="g / 700.0"))
def atmosphere(spark, sf):
    return rounded(rows(spark, sf), 7, density=P.air_density(F.col("alt")), grammage=P.slant_grammage(F.col("alt"), F.col("th"), F.col("d")), maturity=P.shower_maturity(F.col("g")))


TOP = "(700 + 55 * log10(e / 1000.0))"


@query("shower_profile", sql(6, x_max=TOP, size=f"power(g / {TOP}, {TOP} / 70) * exp(({TOP} - g) / 70)"))
def shower_profile(spark, sf):
    return rounded(rows(spark, sf), 6, x_max=P.shower_maximum(F.col("e")), size=P.shower_size(F.col("g"), P.shower_maximum(F.col("e"))))


ENERGIES = "en as (select distinct e from (select power(10.0, (s_suppkey % 13) / 4.0) as e from supplier))"


def energies(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/supplier.parquet").select(F.pow(F.lit(10.0), (F.col("s_suppkey") % 13) / 4).alias("e")).distinct()


@query("grammage_band", f"""with {ENERGIES}, g as (select 1.0 + k * 4999.0 / 3999 as x from (select unnest(range(4000)) as k)),
    s as (select e, x, power(x / {TOP}, {TOP} / 70) * exp(({TOP} - x) / 70) as size from en, g)
    select round(e, 6) as e, round(min(x), 5) as lo, round(max(x), 5) as hi from s where size >= 0.1 group by e""")
def grammage_band(spark, sf):
    b = curves.grammage_edges(energies(spark, sf), 0.1)
    return b.select(F.round("e", 6).alias("e"), F.round("lo", 5).alias("lo"), F.round("hi", 5).alias("hi"))


CHORD = "(case when th >= 0 then 0 else 2 * 6371000.0 * sin(radians(-th)) * 265.0 end)"


@query("nu_survival", sql(6, chord=CHORD, plain=f"exp(-{CHORD} / {LINT})", fed=f"least(1, exp(-{CHORD} / {LINT}) * case when {CHORD} <= 0 then 1 else 1 + {CHORD} / {LINT} * 0.42 * 0.75 end)"))
def nu_survival(spark, sf):
    length = P.interaction_length(F.col("e"))
    return rounded(rows(spark, sf), 6, chord=P.earth_chord(F.col("th")), plain=P.neutrino_survival(F.col("th"), length), fed=P.neutrino_survival(F.col("th"), length, True))


XD = f"({LEN} * 265.0)"


@query("tau_range", sql(6, sigma="6.04e-36 * power(e * 1e6, 0.358)", length=LINT, beta=BETA, reach=f"1 / {BETA} * ln(1 + {XD} * {BETA})",
                        survival=f"exp(-(1 / {BETA} / {XD}) * (exp(least(greatest(d * 100 * {BETA}, 0), 700)) - 1))"))
def tau_range(spark, sf):
    e = F.col("e")
    return rounded(rows(spark, sf), 6, sigma=P.cross_section(e), length=P.interaction_length(e), beta=P.energy_loss(e), reach=P.tau_range(e), survival=P.tau_survival(F.col("d") * 100, e))


EXIT = ENERGIES + """,
xs as (select k as xk, power(10.0, 4 + 5.0 * k / 39) as x from (select unnest(range(40)) as k)),
us as (select e, xk, x, j, case when j = 0 then 0 else exp(ln(greatest(x * 1e-12, 1e-9)) + (ln(x) - ln(greatest(x * 1e-12, 1e-9))) * (j - 1) / 399) end as u from en, xs, (select unnest(range(401)) as j)),
vs as (select *, e * 0.8 as et, 1 / (6.022e23 * 6.04e-36 * power(e * 1e6, 0.358)) as lam from us),
fs as (select e, xk, x, j, u, exp(-(x - u) / lam) / lam * exp(-(1 / (6e-07 * power(et / 1000, 0.2)) / (et * (1e6 / 1.77686 * 8.703e-05) * 265)) * (exp(least(u * (6e-07 * power(et / 1000, 0.2)), 700)) - 1)) as f from vs),
tz as (select e, xk, x, (u - lag(u) over o) * (f + lag(f) over o) / 2 as part from fs window o as (partition by e, xk order by j)),
curve as (select e, xk, any_value(x) as x, sum(part) as p from tz group by e, xk)"""


@query("tau_exit_curve", f"with {EXIT} select round(e, 6) as e, cast(xk as int) as xk, round(log10(x), 6) as log_x, round(log10(p), 4) as log_p from curve")
def tau_exit_curve(spark, sf):
    c = curves.exit_curve(energies(spark, sf), 40, 400)
    return c.select(F.round("e", 6).alias("e"), "xk", F.round(F.log10("x"), 6).alias("log_x"), F.round(F.log10("p"), 4).alias("log_p"))


@query("depth_band", f"""with {EXIT}, pk as (select *, max(p) over (partition by e) as top from curve)
    select round(e, 6) as e, round(log10(arg_max(x, p)), 6) as log_best, round(log10(min(case when p >= 0.5 * top then x end)), 6) as log_lo, round(log10(max(case when p >= 0.5 * top then x end)), 6) as log_hi from pk group by e""")
def depth_band(spark, sf):
    b = curves.depth_band(curves.exit_curve(energies(spark, sf), 40, 400), 0.5)
    return b.select(F.round("e", 6).alias("e"), F.round(F.log10("best"), 6).alias("log_best"), F.round(F.log10("lo"), 6).alias("log_lo"), F.round(F.log10("hi"), 6).alias("log_hi"))


@query("absorption_cutoff", f"""with {EXIT}, pk as (select *, max(p) over (partition by e) as top from curve), hi as (select e, max(x) / 2.65 / 100 / (2 * 6371000.0) as s from pk where p >= 0.5 * top group by e)
    select round(e, 6) as e, case when s < 1 then round(-degrees(asin(case when s < 1 then s end)), 6) end as cutoff_deg from hi""")
def absorption_cutoff(spark, sf):
    b = curves.absorption_cutoff(curves.depth_band(curves.exit_curve(energies(spark, sf), 40, 400), 0.5))
    return b.select(F.round("e", 6).alias("e"), F.round("cutoff_deg", 6).alias("cutoff_deg"))


POLE = f"(sin(radians(lat)) * {math.sin(math.radians(80.7))} + cos(radians(lat)) * {math.cos(math.radians(80.7))} * cos(radians(lon + 72.7)))"


@query("dipole_inclination", f"with {ROWS} select id, round(degrees(asin(greatest(-1, least(1, {POLE})))), 7) as mlat, round(degrees(atan(2 * tan(asin(greatest(-1, least(1, {POLE})))))), 7) as inclination from x")
def dipole_inclination(spark, sf):
    a = (F.col("lat"), F.col("lon"))
    return rows(spark, sf).select("id", F.round(P.geomagnetic_latitude(*a), 7).alias("mlat"), F.round(P.dipole_inclination(*a), 7).alias("inclination"))


@query("declination_grid", f"""with {ROWS}, node as (select -25.0 + 10 * i as lat, -75.0 + 12 * j as lon, -3.0 - i * 0.7 + j * j * 0.4 as dec, i, j from (select unnest(range(5)) as i), (select unnest(range(3)) as j)),
    p as (select id, least(greatest(lat, -25), 15) as lat, least(greatest(lon, -75), -51) as lon from x),
    q as (select *, least(greatest(cast(ceil((lat + 25) / 10) as int) - 1, 0), 3) as i, least(greatest(cast(ceil((lon + 75) / 12) as int) - 1, 0), 1) as j from p)
    select id, round((1-dy)*(1-dx)*a.dec + dy*(1-dx)*b.dec + (1-dy)*dx*c.dec + dy*dx*d.dec, 7) as declination
    from (select *, (lat + 25 - 10 * i) / 10 as dy, (lon + 75 - 12 * j) / 12 as dx from q) q join node a using (i, j) join node b on b.i = q.i + 1 and b.j = q.j
      join node c on c.i = q.i and c.j = q.j + 1 join node d on d.i = q.i + 1 and d.j = q.j + 1""")
def declination_grid(spark, sf):
    nodes = spark.range(15).select((F.col("id") / 3).cast("int").alias("i"), (F.col("id") % 3).cast("int").alias("j")).select(
        (-25.0 + 10 * F.col("i")).alias("lat"), (-75.0 + 12 * F.col("j")).alias("lon"), (-3.0 - F.col("i") * 0.7 + F.col("j") * F.col("j") * 0.4).alias("declination"))
    return curves.declination(rows(spark, sf).select("id", "lat", "lon"), nodes).select("id", F.round("declination", 7).alias("declination"))


F0 = (math.cos(math.radians(-14)) * math.sin(math.radians(-6.9)), math.cos(math.radians(-14)) * math.cos(math.radians(-6.9)), -math.sin(math.radians(-14)))


@query("sin_alpha", f"""with {ROWS}, v as (select id, sin(radians(az)) * cos(radians(th)) * {F0[0]} + cos(radians(az)) * cos(radians(th)) * {F0[1]} + sin(radians(th)) * {F0[2]} as dot from x)
    select id, round(sqrt(greatest(0, 1 - dot * dot)), 7) as sin_alpha from v""")
def sin_alpha(spark, sf):
    given = F.when(F.col("id") < 0, 1.0)  # no survey value: the defaults hold
    field = P.field_vector(F.coalesce(given, F.lit(P.DECLINATION)), F.coalesce(given, F.lit(P.INCLINATION)))
    return rows(spark, sf).select("id", F.round(P.sin_alpha(F.col("az"), F.col("th"), field), 7).alias("sin_alpha"))


@query("footprint", sql(7, n_minus_1="0.00029 * exp(-alt / 8400.0)", angle="sqrt(2 * 0.00029 * exp(-alt / 8400.0))", radius="d * sqrt(2 * 0.00029 * exp(-alt / 8400.0))", sampling="2 * d * sqrt(2 * 0.00029 * exp(-alt / 8400.0)) / 150"))
def footprint(spark, sf):
    a, d = F.col("alt"), F.col("d")
    return rounded(rows(spark, sf), 7, n_minus_1=P.refractivity(a), angle=P.cherenkov_angle(a), radius=P.footprint_radius(a, d), sampling=P.footprint_sampling(150.0, a, d))
