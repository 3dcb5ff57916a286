"""Scoring of candidates from their observables, cuts, summaries and diagnosis."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions import physics as P
from ridgeline.functions import scoring as S
from ridgeline.operators.quantiles import long_form as percentile_rows
from ridgeline.operators.quantiles import quantiles, wide_form
from ridgeline.sources.tables import stage


@dataclass(frozen=True)
class ScoreConfig:
    """None leaves a default in place, or a component out."""

    depth_band: tuple[float, float] = (1e5, 1e7)
    particle: bool = False
    maturity: float = P.X_MAX
    grammage_band: tuple[float, float] = (P.X_MAX, 4 * P.X_MAX)
    nu_length: float | None = None
    spacing_m: float | None = None
    muon_shielding_km: float | None = None
    distance_band: tuple[float, float] | None = None
    decay_energy: float | None = None
    decay_range: tuple[float, float] | None = None
    spectral_index: tuple[float, ...] = (2.0,)
    shower_m: float = 3000.0
    solid_angle_half_sr: float | None = None
    solid_angle_half_fraction: float = 0.07602562106303032
    clearance_full_at: float = 1.0
    composition: str = "product"
    weights: dict[str, float] = field(default_factory=dict)


def presence(observed: DataFrame) -> DataFrame:
    """One row of flags: components that only some runs have anything to say about."""
    ratio = F.col("geomag_solid_angle_sr") / F.col("solid_angle_sr")
    return observed.agg(
        F.coalesce(F.bool_or((F.col("solid_angle_sr") > 0) & (F.when(F.col("solid_angle_sr") > 0, ratio) < 0.999)), F.lit(False)).alias("has_geomagnetic"),
        F.coalesce(F.bool_or(F.col("path_grammage_gcm2") > 0), F.lit(False)).alias("has_shower"),
        F.coalesce(F.bool_or(F.col("best_clearance_ratio") > 0), F.lit(False)).alias("has_clearance"))


def spectrum_decay(distance: Column, low: float, high: float, indices: tuple[float, ...] = (2.0,), shower_m: float = 0.0, samples: int = 96,
                   index_samples: int = 129, acceptance: list[float] | None = None, flux: bool = True) -> Column:
    """Decay probability folded over a power-law spectrum, or over the mean of spectra with
    indices between two values: a trapezoid over a fixed grid of log-spaced energies, whose
    weights are known beforehand, so it is one sum of literals and exponentials."""
    import numpy as np

    if not low < high:
        raise ValueError("the upper energy must exceed the lower")
    ln_e = np.linspace(np.log(low), np.log(high), samples)
    energy = np.exp(ln_e)
    gammas = np.linspace(min(indices), max(indices), index_samples) if len(indices) == 2 and min(indices) < max(indices) else np.array(indices[:1])
    weights = energy[None, :] ** (1 - gammas[:, None]) if flux else np.ones((1, samples))
    if acceptance is not None:
        weights = weights * np.asarray(acceptance)[None, :]
    weights = weights / np.trapezoid(weights, ln_e, axis=-1)[:, None]
    mean = weights[0] if len(weights) == 1 else np.trapezoid(weights, gammas, axis=0) / (gammas[-1] - gammas[0])
    part = np.full(samples, ln_e[1] - ln_e[0])
    part[[0, -1]] /= 2
    grid = F.array(*[F.struct(F.lit(float(w)).alias("w"), F.lit(float(e * 1e6 / P.TAU_MASS_GEV * P.TAU_CTAU_M)).alias("len")) for w, e in zip(mean * part, energy, strict=True)])
    usable = F.greatest(distance - shower_m, F.lit(0.0))
    return S.clip(F.aggregate(grid, F.lit(0.0), lambda total, g: total - F.expm1(-usable / g["len"]) * g["w"]))


def components(cfg: ScoreConfig, distance_window: tuple[float, float] | None = None, available_sky: float | None = None) -> dict[str, Column]:
    """Score columns by component name, of columns of an observables table joined with presence()."""
    omega, depth, distance = F.col("solid_angle_sr"), F.col("max_depth_gcm2"), F.col("mean_distance_m")
    out = {"depth": S.band(depth, *cfg.depth_band)}
    if cfg.solid_angle_half_sr or not available_sky:
        out["solid_angle"] = S.saturating(omega, cfg.solid_angle_half_sr or 0.05 / 3)
    else:
        out["solid_angle"] = S.saturating(omega / available_sky, cfg.solid_angle_half_fraction)
    window = cfg.distance_band or distance_window
    if window:
        out["distance"] = S.band(distance, *window)
    if cfg.muon_shielding_km:
        out["muon_shielding"] = (depth >= P.muon_shielding(cfg.muon_shielding_km)).cast("double")
    ratio = F.when(omega > 0, F.col("geomag_solid_angle_sr") / F.when(omega > 0, omega)).otherwise(0.0)
    out["geomagnetic"] = F.when(F.col("has_geomagnetic"), S.clip(ratio))
    shower = S.band(F.col("path_grammage_gcm2"), *cfg.grammage_band) if cfg.particle else S.ramp(F.col("path_grammage_gcm2"), 0, cfg.maturity)
    out["shower"] = F.when(F.col("has_shower"), shower)
    if cfg.decay_range:
        out["decay"] = spectrum_decay(distance, *cfg.decay_range, cfg.spectral_index, cfg.shower_m)
    elif cfg.decay_energy:
        out["decay"] = 1 - F.exp(-F.greatest(distance - cfg.shower_m, F.lit(0.0)) / P.decay_length(cfg.decay_energy))
    if cfg.nu_length:
        out["nu_survival"] = F.exp(-F.col("earth_chord_gcm2") / cfg.nu_length)
    if cfg.spacing_m:
        out["footprint"] = S.ramp(P.footprint_sampling(cfg.spacing_m, F.col("altitude_m"), distance), 0, 1)
    out["clearance"] = F.when(F.col("has_clearance"), S.ramp(F.col("best_clearance_ratio"), 0, cfg.clearance_full_at))
    return out


def score(observed: DataFrame, cfg: ScoreConfig, distance_window: tuple[float, float] | None = None, available_sky: float | None = None) -> DataFrame:
    """Adds score_<component> (null where a component says nothing in this run) and score."""
    observed = stage(observed, "observed")  # read for the flags, for the scores and by what follows
    rows = observed.join(F.broadcast(presence(observed)))  # one row of flags
    parts = components(cfg, distance_window, available_sky)
    rows = rows.select("*", *[c.alias(f"score_{n}") for n, c in parts.items()])
    # an absent component is neutral: 1 in a product or a minimum, without weight in a mean
    named = {n: F.col(f"score_{n}") for n in parts}
    if cfg.composition == "mean":
        weight = {n: cfg.weights.get(n, 1.0) for n in named}
        top = reduce(lambda a, b: a + b, [F.coalesce(S.clip(c) * weight[n], F.lit(0.0)) for n, c in named.items()])
        base = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), weight[n]).otherwise(0.0) for n, c in named.items()])
        total = top / base
    else:
        total = S.compose({n: F.coalesce(c, F.lit(1.0)) for n, c in named.items()}, cfg.composition, {n: w for n, w in cfg.weights.items() if n in named})
    return rows.withColumn("score", F.when(F.col("cells") > 0, total).otherwise(0.0)).drop("has_geomagnetic", "has_shower", "has_clearance")


def cut_percentile(scored: DataFrame, top_percent: float) -> DataFrame:
    """The best `top_percent` of the candidates that accept anything, by interpolated percentile."""
    viable = stage(scored.where("cells > 0"), "viable")
    cut = quantiles(viable.select(F.col("score").alias("value")), [], [1 - top_percent / 100]).select(F.col("q")[0].alias("cut"))
    return viable.join(F.broadcast(cut)).where("score >= cut").drop("cut")  # one row


def cut_score(scored: DataFrame, least: float) -> DataFrame:
    return scored.where((F.col("cells") > 0) & (F.col("score") >= least))


def names(scored: DataFrame) -> list[str]:
    return [c for c in scored.columns if c.startswith("score_")]


def summary(scored: DataFrame) -> DataFrame:
    """Mean, median, 90th percentile and maximum of the score, and the median of each component."""
    scored = stage(scored, "scored")
    means = scored.agg(F.avg("score").alias("score_mean"), F.max("score").alias("score_max"))
    found = quantiles(percentile_rows(scored, [], ["score", *names(scored)]), ["name"], [0.5, 0.9])
    named = {"score_p50": ("score", 0), "score_p90": ("score", 1)} | {f"{c[6:]}_score_p50": (c, 0) for c in names(scored)}
    both = means.join(F.broadcast(wide_form(found, [], named)))  # one row each
    return both.select("score_mean", "score_p50", "score_p90", "score_max", *list(named)[2:])


def long_form(scored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, component, value): one row for each component that is present."""
    pairs = F.array(*[F.struct(F.lit(c[6:]).alias("component"), F.col(c).alias("value")) for c in names(scored)])
    return scored.select(*keys, F.inline(pairs)).where("value is not null")


def composition(scored: DataFrame, cut: float) -> DataFrame:
    """How the product falls component by component, in order of falling medians: rank, component,
    median, running median, share of candidates above `cut` and drift of the whole product from
    the stored score. The order is a table of as many rows as components, joined by name."""
    parts = stage(long_form(scored.where("cells > 0"), ["cand_id", "score"]), "components")
    medians = quantiles(parts, ["component"], [0.5]).select("component", F.col("q")[0].alias("median"))
    ranked = medians.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("median"), "component")))
    w = Window.partitionBy("cand_id").orderBy("rank")
    run = parts.join(F.broadcast(ranked), "component").withColumn("running", F.when(F.min("value").over(w) <= 0, 0.0).otherwise(
        F.exp(F.sum(F.ln(F.when(F.col("value") > 0, F.col("value")))).over(w))))
    run = stage(run, "running")
    middle = quantiles(run.select("component", F.col("running").alias("value")), ["component"], [0.5]).select("component", F.col("q")[0].alias("running_median"))
    shares = run.groupBy("rank", "component", "median").agg(
        F.avg(F.when(F.col("running") >= cut, 1.0).otherwise(0.0)).alias("share_above"), F.max(F.abs(F.col("running") - F.col("score"))).alias("drift"))
    return shares.join(middle, "component").select("rank", "component", "median", "running_median", "share_above", "drift")


def histogram(scored: DataFrame, bins: int = 60) -> DataFrame:
    return scored.where("cells > 0").groupBy(F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
