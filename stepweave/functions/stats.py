"""Guarded arithmetic, smoothed rates and losses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def share(part: Column, whole: Column, empty: float | None = 0.0) -> Column:
    """part / whole, and ``empty`` where whole is zero or null."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(empty))


def clip(x: Column, low: float | Column = 0.0, high: float | Column = 1.0) -> Column:
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    return F.when(x < lo, lo).when(x > hi, hi).otherwise(x)


def harmonic(a: Column, b: Column) -> Column:
    return share(2 * a * b, a + b)


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def logit(p: Column, least: float = 1e-6) -> Column:
    q = clip(p, least, 1 - least)
    return F.log(q / (1 - q))


def beta_rate(hits: Column, trials: Column, alpha: float = 1.0, beta: float = 1.0, z: float = 1.96, floor: float = 0.0, gamma: float = 1.0) -> Column:
    """Beta-smoothed rate as a struct: q, se, low, high, width, weight; all zero without trials."""
    n = trials + alpha + beta
    q = (hits + alpha) / n
    se = F.sqrt(q * (1 - q) / (n + 1))
    low, high = clip(q - z * se), clip(q + z * se)
    weight = clip(F.pow(F.greatest(1 - F.least(high - low, F.lit(1.0)), F.lit(floor)), F.lit(gamma)))
    some = trials > 0
    return F.struct(*(F.when(some, v).otherwise(0.0).alias(k) for k, v in (("q", q), ("se", se), ("low", low), ("high", high), ("width", high - low), ("weight", weight))))


def bce_with_logits(x: Column, y: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def squared_error(p: Column, y: Column) -> Column:
    return (p - y) * (p - y)


def margin_loss(chosen: Column, rejected: Column, margin: float) -> Column:
    return F.greatest(F.lit(float(margin)) - chosen + rejected, F.lit(0.0))


def smooth_label(y: Column, epsilon: float) -> Column:
    return (1 - 2 * epsilon) * y + epsilon


def weighted_mean(value: Column, weight: Column) -> Column:
    """An aggregate; the sum of weights counts as 1e-8 at least."""
    return F.sum(value * weight) / F.greatest(F.sum(weight), F.lit(1e-8))


def calibration_weight(mode: str, y: Column, parseable: Column | None = None, q_weight: Column | None = None, floor: float = 0.1, gamma: float = 1.0) -> Column:
    """Sample weight by mode: factors joined by underscores out of confidence, entropy, parseable, qweight; or none."""
    p = clip(y, 1e-6, 1 - 1e-6)
    entropy = -(p * F.log(p) + (1 - p) * F.log(1 - p)) / F.log(F.lit(2.0))
    factors = {"confidence": 2 * F.abs(y - 0.5), "entropy": 1 - entropy, "parseable": parseable, "qweight": q_weight}
    out = F.lit(1.0)
    for name in [] if mode == "none" else mode.split("_"):
        if factors.get(name) is None:
            raise ValueError(f"no factor {name}")
        out = out * factors[name]
    return F.pow(F.greatest(out, F.lit(floor)), F.lit(gamma)) if mode != "none" else out
