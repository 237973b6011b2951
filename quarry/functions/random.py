"""Counter-based random numbers as Column expressions: a number depends on (seed, stream, counter) alone, the same on any cluster and in any order of rows.

Rounds of multiplication modulo the prime 2**31 - 1 with the halves exchanged between them, in whole numbers below 2**62: the same arithmetic
can be written in any SQL. For sampling, noise and features, not for secrets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The prime, and the multipliers of the rounds, primitive roots of it.
PRIME = 2_147_483_647
ROUNDS = (48_271, 69_621, 16_807, 39_373, 630_360_016)


def draw(counter: Column, seed: int, stream: int = 0) -> Column:
    """A whole number from 0 to PRIME - 1 for each counter (a long; its 62 low bits count). Null for null."""
    counter = counter.cast("long").bitwiseAND(F.lit((1 << 62) - 1))
    high = F.shiftright(counter, 31)
    x = (counter.bitwiseAND(F.lit(PRIME)) + F.lit((seed * 7_919 + stream * 104_729 + 12_345) % PRIME)) % F.lit(PRIME)
    for multiplier in ROUNDS:
        x = ((x + F.lit(1)) * F.lit(multiplier) + high) % F.lit(PRIME)
        x = x.bitwiseXOR(F.shiftright(x, 15)) % F.lit(PRIME)
    return x


def uniform(counter: Column, seed: int, stream: int = 0) -> Column:
    """From 0 (never) to 1 (never)."""
    return (draw(counter, seed, stream) + F.lit(0.5)) / F.lit(float(PRIME))


def normal(counter: Column, seed: int, stream: int = 0) -> Column:
    """Standard normal, by Box and Muller from two streams."""
    return F.sqrt(F.lit(-2.0) * F.ln(uniform(counter, seed, 2 * stream))) * F.cos(F.lit(2 * math.pi) * uniform(counter, seed, 2 * stream + 1))


def discrete(counter: Column, weights: list[float], seed: int, stream: int = 0) -> Column:
    """The place of one of the weights, drawn in proportion to them."""
    if not weights or min(weights) < 0 or sum(weights) <= 0:
        raise ValueError("weights must not be negative, and one must be positive")
    u, total, so_far = uniform(counter, seed, stream), float(sum(weights)), 0.0
    out = F.lit(max(k for k, w in enumerate(weights) if w > 0))
    bounds = []
    for w in weights:
        so_far += w
        bounds.append(so_far / total)
    for k in range(len(weights) - 2, -1, -1):
        out = F.when(u < bounds[k], F.lit(k)).otherwise(out) if weights[k] > 0 else out
    return F.when(u.isNotNull(), out)


def draw_sql(counter: str, seed: int, stream: int = 0) -> str:
    """`draw` of a SQL expression, in the same arithmetic."""
    x = f"((({counter}) & {PRIME}) + {(seed * 7_919 + stream * 104_729 + 12_345) % PRIME}) % {PRIME}"
    for multiplier in ROUNDS:
        x = f"((({x}) + 1) * {multiplier} + (({counter}) >> 31)) % {PRIME}"
        x = f"xor({x}, ({x}) >> 15) % {PRIME}"
    return x
