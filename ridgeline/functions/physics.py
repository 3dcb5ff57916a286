"""Closed-form shower, lepton and field physics as column functions.

All angles in degrees, energies in PeV, depths in g/cm2, lengths in metres.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Physical constants and published parametrisations.
SEA_LEVEL_DENSITY = 1.225
SCALE_HEIGHT = 8400.0
SEA_LEVEL_REFRACTIVITY = 0.00029
X_MAX = 700.0
X_MAX_ENERGY = 1000.0
ELONGATION = 55.0
PROFILE_LAMBDA = 70.0
EARTH_RADIUS = 6_371_000.0
RADIO_EARTH_RADIUS = 8_500_000.0
CRUST_DENSITY = 2.65
ROCK_DENSITY = 2650.0
TAU_MASS_GEV = 1.77686
TAU_CTAU_M = 8.703e-05
SIGMA_CC = 6.04e-36
SIGMA_CC_INDEX = 0.358
AVOGADRO = 6.022e23
BETA = 6e-07
BETA_ENERGY = 1000.0
BETA_INDEX = 0.2
CC_INELASTICITY = 0.2
NC_TO_CC = 0.42
NC_INELASTICITY = 0.25
POLE_LAT, POLE_LON = 80.7, -72.7
DECLINATION, INCLINATION = -6.9, -14.0
LIGHT_SPEED = 299_792_458.0

Number = Column | float


def lit(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def decay_length(energy: Number) -> Column:
    return lit(energy) * (1e6 / TAU_MASS_GEV * TAU_CTAU_M)


def energy_for_decay_length(distance: Number) -> Column:
    return lit(distance) / TAU_CTAU_M * TAU_MASS_GEV / 1e6


def decay_probability(near: Number, far: Number, energy: Number) -> Column:
    """Share of leptons that decay between two distances."""
    length = decay_length(energy)
    return F.when(length <= 0, 0.0).otherwise(F.exp(-lit(near) / length) - F.exp(-lit(far) / length))


def air_density(altitude: Number) -> Column:
    return SEA_LEVEL_DENSITY * F.exp(-lit(altitude) / SCALE_HEIGHT)


def slant_grammage(altitude: Number, elevation: Number, distance: Number) -> Column:
    """Air along a slanted path in an exponential atmosphere; level paths by density."""
    theta = F.radians(lit(elevation))
    cos, sin = F.cos(theta), F.sin(theta)
    slant = F.when(F.abs(cos) > 1e-12, lit(distance) / cos).otherwise(lit(distance))
    base = air_density(altitude)
    level = base * slant
    rising = base * (SCALE_HEIGHT / F.when(F.abs(sin) < 1e-9, 1.0).otherwise(sin)) * (1 - F.exp(-slant * sin / SCALE_HEIGHT))
    return F.when(lit(distance) <= 0, 0.0).otherwise(F.when(F.abs(sin) < 1e-9, level).otherwise(rising) * 0.1)


def shower_maturity(grammage: Number, x_max: float = X_MAX) -> Column:
    return lit(grammage) / x_max if x_max > 0 else F.lit(0.0)


def shower_maximum(energy: Number) -> Column:
    return X_MAX + ELONGATION * F.log10(lit(energy) / X_MAX_ENERGY)


def shower_size(grammage: Number, x_max: Number) -> Column:
    """Gaisser-Hillas size relative to the maximum."""
    x, top = lit(grammage), lit(x_max)
    return F.when(x > 0, F.pow(x / top, top / PROFILE_LAMBDA) * F.exp((top - x) / PROFILE_LAMBDA)).otherwise(0.0)


def earth_chord_m(elevation: Number, radius: float = EARTH_RADIUS) -> Column:
    return F.when(lit(elevation) >= 0, 0.0).otherwise(2 * radius * F.sin(F.radians(-lit(elevation))))


def earth_chord(elevation: Number, radius: float = EARTH_RADIUS, density: float = CRUST_DENSITY) -> Column:
    return earth_chord_m(elevation, radius) * 100 * density


def nc_regeneration(chord: Column, length: Number, index: float = 2.0) -> Column:
    gain = 1 + chord / lit(length) * NC_TO_CC * (1 - NC_INELASTICITY) ** (index - 1)
    return F.when((lit(length) <= 0) | (chord <= 0), 1.0).otherwise(gain)


def neutrino_survival(elevation: Number, length: Number, regenerate: bool = False, index: float = 2.0) -> Column:
    chord = earth_chord(elevation)
    survival = F.exp(-chord / lit(length))
    if regenerate:
        survival = survival * nc_regeneration(chord, length, index)
    return F.when(lit(length) <= 0, 1.0).otherwise(F.least(survival, F.lit(1.0)))


def muon_shielding(thickness_km: Number, density: float = CRUST_DENSITY) -> Column:
    return lit(thickness_km) * 1000 * 100 * density


def cross_section(energy: Number) -> Column:
    return SIGMA_CC * F.pow(lit(energy) * 1e6, F.lit(SIGMA_CC_INDEX))


def interaction_length(energy: Number) -> Column:
    return 1 / (AVOGADRO * cross_section(energy))


def energy_loss(energy: Number, reference: float = BETA, reference_energy: float = BETA_ENERGY, index: float = BETA_INDEX) -> Column:
    if reference <= 0 or reference_energy <= 0:
        raise ValueError("the energy-loss reference and its energy must be positive")
    return F.lit(reference) if index == 0 else reference * F.pow(lit(energy) / reference_energy, F.lit(index))


def tau_range(energy: Number, beta: Number | None = None, density: float = CRUST_DENSITY) -> Column:
    loss = 1 / (energy_loss(energy) if beta is None else lit(beta))
    return loss * F.log1p(decay_length(energy) * 100 * density / loss)


def tau_survival(depth: Number, energy: Number, beta: Number | None = None, density: float = CRUST_DENSITY) -> Column:
    loss = 1 / (energy_loss(energy) if beta is None else lit(beta))
    decay = decay_length(energy) * 100 * density
    return F.exp(-(loss / decay) * F.expm1(F.least(F.greatest(lit(depth) / loss, F.lit(0.0)), F.lit(700.0))))


def geomagnetic_latitude(lat: Number, lon: Number) -> Column:
    a, p = F.radians(lit(lat)), math.radians(POLE_LAT)
    s = F.sin(a) * math.sin(p) + F.cos(a) * math.cos(p) * F.cos(F.radians(lit(lon) - POLE_LON))
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s))))


def dipole_inclination(lat: Number, lon: Number) -> Column:
    return F.degrees(F.atan(2 * F.tan(F.radians(geomagnetic_latitude(lat, lon)))))


def field_vector(declination: Number, inclination: Number) -> tuple[Column, Column, Column]:
    """East, north, up."""
    d, i = F.radians(lit(declination)), F.radians(lit(inclination))
    return F.cos(i) * F.sin(d), F.cos(i) * F.cos(d), -F.sin(i)


def sin_alpha(azimuth: Number, elevation: Number, field: tuple[Column, Column, Column]) -> Column:
    phi, theta = F.radians(lit(azimuth)), F.radians(lit(elevation))
    dot = F.sin(phi) * F.cos(theta) * field[0] + F.cos(phi) * F.cos(theta) * field[1] + F.sin(theta) * field[2]
    return F.sqrt(F.greatest(F.lit(0.0), 1 - dot * dot))


def refractivity(altitude: Number) -> Column:
    return SEA_LEVEL_REFRACTIVITY * F.exp(-lit(altitude) / SCALE_HEIGHT)


def cherenkov_angle(altitude: Number) -> Column:
    return F.sqrt(2 * refractivity(altitude))


def footprint_radius(altitude: Number, distance: Number) -> Column:
    return lit(distance) * cherenkov_angle(altitude)


def footprint_sampling(spacing: float, altitude: Number, distance: Number) -> Column:
    return 2 * footprint_radius(altitude, distance) / spacing if spacing > 0 else F.lit(0.0)
