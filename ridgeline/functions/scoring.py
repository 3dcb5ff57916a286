"""Score shapes as column functions; every score lies in [0, 1]."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def band(x: Column, lo: float, hi: float, soft_lo: float | None = None, soft_hi: float | None = None) -> Column:
    """1 within [lo, hi], linear flanks of a quarter width unless given; 0 is a cliff."""
    lo, hi = min(lo, hi), max(lo, hi)
    quarter = max(hi - lo, 1e-12) / 4
    soft_lo, soft_hi = (quarter if s is None else float(s) for s in (soft_lo, soft_hi))
    below = clip(1 - (lo - x) / soft_lo) if soft_lo > 0 else F.lit(0.0)
    above = clip(1 - (x - hi) / soft_hi) if soft_hi > 0 else F.lit(0.0)
    return F.when(x < lo, below).when(x > hi, above).otherwise(1.0)


def saturating(x: Column, half: float) -> Column:
    x = F.greatest(x, F.lit(0.0))
    return x / (x + max(float(half), 1e-12))


def ramp(x: Column, zero_at: float, one_at: float) -> Column:
    """Linear in either direction; a step if both ends are equal."""
    if zero_at == one_at:
        return F.when(x >= one_at, 1.0).otherwise(0.0)
    return clip((x - zero_at) / (one_at - zero_at))


def compose(parts: dict[str, Column], mode: str = "product", weights: dict[str, float] | None = None) -> Column:
    """Product (weights are exponents), mean (linear weights) or min; weight 0 leaves a part out."""
    weight = {n: float((weights or {}).get(n, 1.0)) for n in parts}
    if mode not in ("product", "mean", "min"):
        raise ValueError(f"scores cannot be joined by {mode!r}: use product, mean or min")
    if any(w < 0 for w in weight.values()):
        raise ValueError("a weight below zero has no meaning")
    kept = {n: clip(c) for n, c in parts.items() if weight[n] > 0}
    if not kept:
        raise ValueError("nothing to join: all weights are zero")
    if mode == "min":
        return F.least(*kept.values()) if len(kept) > 1 else next(iter(kept.values()))
    if mode == "mean":
        return reduce(lambda a, b: a + b, (c * weight[n] for n, c in kept.items())) / sum(weight.values())
    return clip(reduce(lambda a, b: a * b, (c if weight[n] == 1 else F.pow(c, F.lit(weight[n])) for n, c in kept.items())))
