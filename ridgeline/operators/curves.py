"""Curves over energy and depth as grid jobs: exit probability, depth bands, shower bands,
field grids, apertures and responses. Grids are rows, integrals are sums over them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions import physics as P


def log_grid(k: Column, low: float, high: float, n: int) -> Column:
    """The k-th of n values in equal ratios from 10^low to 10^high."""
    return F.pow(F.lit(10.0), low + (high - low) * k / (n - 1))


def grammage_edges(energies: DataFrame, fraction: float = 0.1, samples: int = 4000) -> DataFrame:
    """For each energy e the depths between which the shower has `fraction` of its largest size;
    the maximum itself where it never has."""
    top = P.shower_maximum(F.col("e"))
    x = 1.0 + F.col("k") * (4999.0 / (samples - 1))
    grid = energies.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("x", x).withColumn("top", top)
    inside = F.when(P.shower_size(F.col("x"), F.col("top")) >= fraction, F.col("x"))
    edges = grid.groupBy("e").agg(F.min(inside).alias("lo"), F.max(inside).alias("hi"), F.first("top").alias("top"))
    return edges.select("e", F.coalesce("lo", "top").alias("lo"), F.coalesce("hi", "top").alias("hi"))


def exit_curve(energies: DataFrame, depths: int = 400, samples: int = 2000, low: float = 4.0, high: float = 9.0) -> DataFrame:
    """(e, xk, x, p): the probability that a lepton made within column depth x leaves it, a
    trapezoid over production depths u in equal ratios, and u = 0."""
    x = log_grid(F.col("xk"), low, high, depths)
    start = F.greatest(F.col("x") * 1e-12, F.lit(1e-9))
    u = F.when(F.col("j") == 0, 0.0).otherwise(F.exp(F.ln(start) + (F.ln("x") - F.ln(start)) * (F.col("j") - 1) / (samples - 1)))
    grid = energies.withColumn("xk", F.explode(F.sequence(F.lit(0), F.lit(depths - 1)))).withColumn("x", x)
    grid = grid.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(samples)))).withColumn("u", u)
    made = F.exp(-(F.col("x") - F.col("u")) / P.interaction_length(F.col("e"))) / P.interaction_length(F.col("e"))
    grid = grid.withColumn("f", made * P.tau_survival(F.col("u"), F.col("e") * (1 - P.CC_INELASTICITY)))
    w = Window.partitionBy("e", "xk").orderBy("j")
    part = (F.col("u") - F.lag("u").over(w)) * (F.col("f") + F.lag("f").over(w)) / 2
    return grid.withColumn("part", part).groupBy("e", "xk").agg(F.first("x").alias("x"), F.sum("part").alias("p"))


def depth_band(curve: DataFrame, fraction: float = 0.5) -> DataFrame:
    """(e, best, lo, hi): the depth of the largest exit probability and where it has `fraction` of it."""
    top = curve.withColumn("top", F.max("p").over(Window.partitionBy("e")))
    inside = F.when(F.col("p") >= fraction * F.col("top"), F.col("x"))
    return top.groupBy("e").agg(F.max_by("x", "p").alias("best"), F.min(inside).alias("lo"), F.max(inside).alias("hi"))


def absorption_cutoff(bands: DataFrame, radius: float = P.EARTH_RADIUS, density: float = P.CRUST_DENSITY) -> DataFrame:
    """Adds the elevation below which the chord is deeper than the band; null if no chord is."""
    sine = F.col("hi") / density / 100 / (2 * radius)
    return bands.withColumn("cutoff_deg", F.when(sine < 1, -F.degrees(F.asin(F.least(sine, F.lit(1.0))))))


def declination(sites: DataFrame, nodes: DataFrame) -> DataFrame:
    """Bilinear interpolation of `nodes(lat, lon, declination)`, a full grid, clamped at its edges.
    The axis intervals are small tables joined by range; cell corners are joined by equality."""
    def axis(name: str) -> DataFrame:
        w = Window.orderBy("lo")
        steps = nodes.select(F.col(name).alias("lo")).distinct().withColumn("hi", F.lead("lo").over(w)).withColumn("first", F.min("lo").over(Window.partitionBy()))
        return steps.where("hi is not null").select(F.col("lo").alias(f"{name}0"), F.col("hi").alias(f"{name}1"), (F.col("lo") == F.col("first")).alias(f"{name}_first"))

    ends = nodes.agg(*[f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("low", F.min), ("high", F.max))])
    rows = sites.join(F.broadcast(ends))
    for c in ("lat", "lon"):
        at = F.least(F.greatest(F.col(c), F.col(f"low_{c}")), F.col(f"high_{c}"))
        rows = rows.withColumn(f"{c}_at", at)
        inside = (F.col(f"{c}_at") <= F.col(f"{c}1")) & ((F.col(f"{c}_at") > F.col(f"{c}0")) | (F.col(f"{c}_first") & (F.col(f"{c}_at") == F.col(f"{c}0"))))
        rows = rows.join(F.broadcast(axis(c)), inside)
    y, x = [(F.col(f"{c}_at") - F.col(f"{c}0")) / (F.col(f"{c}1") - F.col(f"{c}0")) for c in ("lat", "lon")]
    value = F.lit(0.0)
    for i in (0, 1):
        for j in (0, 1):
            corner = nodes.select(F.col("lat").alias(f"lat{i}"), F.col("lon").alias(f"lon{j}"), F.col("declination").alias(f"v{i}{j}"))
            rows = rows.join(F.broadcast(corner), [f"lat{i}", f"lon{j}"])
            value = value + F.col(f"v{i}{j}") * (y if i else 1 - y) * (x if j else 1 - x)
    return rows.select(*sites.columns, value.alias("declination"))


def aperture(sites: DataFrame, near: float, far: float, points: int = 26, low: float = 0.0, high: float = 4.0, response: DataFrame | None = None) -> DataFrame:
    """(site_id, k, energy_pev, aperture_m2sr) of `sites(site_id, area_km2, solid_angle_sr)`;
    `response(energy_pev, value)` multiplies by what is interpolated from it."""
    rows = sites.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("energy_pev", log_grid(F.col("k"), low, high, points))
    rows = rows.withColumn("aperture_m2sr", F.col("area_km2") * 1e6 * F.col("solid_angle_sr") * P.decay_probability(near, far, F.col("energy_pev")))
    if response is not None:
        rows = interpolate(rows, response).withColumn("aperture_m2sr", F.col("aperture_m2sr") * F.col("response")).drop("response")
    return rows.select("site_id", "k", "energy_pev", "aperture_m2sr")


def interpolate(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Adds response: log-log interpolation of `table(energy_pev, value)`, 0 outside it. The table's
    intervals are broadcast: a published curve has a few hundred points."""
    w = Window.orderBy("e0")
    spans = table.select(F.col("energy_pev").alias("e0"), F.greatest("value", F.lit(1e-300)).alias("v0")).withColumn("e1", F.lead("e0").over(w)).withColumn("v1", F.lead("v0").over(w))
    last = F.max("e0").over(Window.partitionBy())
    spans = spans.withColumn("last", last)
    hit = (F.col("energy_pev") >= F.col("e0")) & ((F.col("energy_pev") < F.col("e1")) | (F.col("e1").isNull() & (F.col("energy_pev") == F.col("e0"))))
    t = F.when(F.col("e1").isNull(), 0.0).otherwise((F.log10("energy_pev") - F.log10("e0")) / (F.log10("e1") - F.log10("e0")))
    value = F.pow(F.lit(10.0), F.log10("v0") + t * F.coalesce(F.log10("v1") - F.log10("v0"), F.lit(0.0)))
    return rows.join(F.broadcast(spans), hit, "left").withColumn("response", F.coalesce(value, F.lit(0.0))).drop("e0", "e1", "v0", "v1", "last")


def peak_energy(windows: DataFrame, points: int = 2000) -> DataFrame:
    """`windows(id, near, far)` to the energy at which most leptons decay between the distances."""
    grid = windows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("energy_pev", log_grid(F.col("k"), -2.0, 5.0, points))
    return grid.groupBy("id").agg(F.max_by("energy_pev", P.decay_probability(F.col("near"), F.col("far"), F.col("energy_pev"))).alias("peak_energy_pev"))


def infer_response(published: DataFrame, area_km2: float, solid_angle_sr: float, near: float, far: float, least: float = 1e-3) -> DataFrame:
    """`published(energy_pev, value)` over the modelled aperture, where the model is not negligible,
    relative to its largest."""
    model = area_km2 * 1e6 * solid_angle_sr * P.decay_probability(near, far, F.col("energy_pev"))
    whole = Window.partitionBy()  # a published curve
    rows = published.withColumn("model", model).withColumn("top", F.max("model").over(whole)).where(F.col("model") > least * F.col("top"))
    rows = rows.withColumn("ratio", F.col("value") / F.col("model")).withColumn("peak", F.max("ratio").over(whole))
    return rows.select("energy_pev", F.when(F.col("peak") > 0, F.col("ratio") / F.col("peak")).otherwise(F.col("ratio")).alias("response"))


LATTICE = {"hex": math.sin(math.radians(60)), "square": 1.0}


def scale_curve(curves: DataFrame, arrays: DataFrame, units: float, spacing_km: float, grid_type: str) -> DataFrame:
    """`curves(name, energy_pev, value)` scaled from its own array (name, units, spacing_km, grid_type) to ours."""
    density = F.when(F.col("grid_type") == "square", LATTICE["square"]).otherwise(LATTICE["hex"])
    factor = units * spacing_km**2 * LATTICE[grid_type] / (F.col("units") * F.col("spacing_km") * F.col("spacing_km") * density)
    return curves.join(F.broadcast(arrays), "name").select("name", "energy_pev", (F.col("value") * factor).alias("value"), factor.alias("scale_factor"))
