"""Scalar functions with IEEE-754 results where Spark's own return NULL or raise: logarithm, division, sign, clamp, activations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def ieee_log(x: Column) -> Column:
    """ln with -inf at 0 and NaN below it (Spark's is NULL in both)."""
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN)).otherwise(x)


def ieee_div(a: Column, b: Column) -> Column:
    """a / b with signed infinities and NaN for a zero divisor (Spark raises in ANSI mode)."""
    return F.when(b != 0, a / F.nullif(b, F.lit(0.0))).when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF)).when(b.isNotNull() & a.isNotNull(), F.lit(NAN))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def sign(x: Column, zero: int = -1) -> Column:
    """+1 above zero, -1 below; at zero -1 (perceptron) or +1 (support vector machines)."""
    above = x > 0 if zero < 0 else x >= 0
    return F.when(above, F.lit(1)).otherwise(F.lit(-1))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def sigmoid_slope(x: Column) -> Column:
    s = sigmoid(x)
    return s * (F.lit(1.0) - s)


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def relu_slope(x: Column) -> Column:
    """0 at and below zero."""
    return F.when(x <= 0, F.lit(0.0)).otherwise(F.lit(1.0))


def tanh_slope(x: Column) -> Column:
    return F.lit(1.0) - F.tanh(x) * F.tanh(x)


def log_loss(p: Column, y: Column, clip: float = 1e-12) -> Column:
    """-(y ln p + (1 - y) ln(1 - p)) with p clipped to [clip, 1 - clip]."""
    q = clamp(p, clip, 1 - clip)
    return -(y * F.ln(q) + (F.lit(1.0) - y) * F.ln(F.lit(1.0) - q))


def decayed(start: float, end: float, rate: float, t: Column) -> Column:
    """Exponential schedule: max(end, start * exp(-rate * t))."""
    return F.greatest(F.lit(float(end)), F.lit(float(start)) * F.exp(F.lit(-float(rate)) * t))


def decayed_by_factor(start: float, end: float, factor: float, n: Column) -> Column:
    """n multiplicative decays of `start`, each applied only while the value is above `end`."""
    value = F.lit(float(start)) * F.pow(F.lit(float(factor)), n)
    return F.when(value > end, value).otherwise(F.least(F.lit(float(start)), F.greatest(value, F.lit(float(end) * float(factor)))))
