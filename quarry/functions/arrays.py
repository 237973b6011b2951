"""Vector functions over ARRAY<DOUBLE> columns.

With a known dimension d the expressions are unrolled, which keeps them inside whole-stage code generation; without it they
are higher-order functions. Dimensions that differ give NULL elements in zip_with; `frame.validate` checks them beforehand.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ieee import sigmoid

#: Unrolled expressions are summed in groups of this many terms, each group one expression tree.
UNROLLED = 128


def _sum(terms: list[Column]) -> Column:
    return reduce(add, terms) if terms else F.lit(0.0)


def dot(a: Column, b: Column, d: int | None = None) -> Column:
    if d is not None and d <= UNROLLED:
        return _sum([a[j] * b[j] for j in range(d)])
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def dot_values(a: Column, values: list[float]) -> Column:
    """Dot product with a vector known on the driver."""
    return _sum([a[j] * F.lit(float(v)) for j, v in enumerate(values)])


def squared_distance(a: Column, b: Column, d: int | None = None) -> Column:
    if d is not None and d <= UNROLLED:
        return _sum([(a[j] - b[j]) * (a[j] - b[j]) for j in range(d)])
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def distance(a: Column, b: Column, d: int | None = None) -> Column:
    return F.sqrt(squared_distance(a, b, d))


def norm(a: Column, d: int | None = None) -> Column:
    return F.sqrt(dot(a, a, d))


def cosine(a: Column, b: Column, d: int | None = None) -> Column:
    """Cosine similarity; NULL where either norm is zero."""
    return dot(a, b, d) / F.nullif(norm(a, d) * norm(b, d), F.lit(0.0))


def cosine_reward(a: Column, b: Column, d: int | None = None) -> Column:
    """1 + 9 * sigmoid(20 * (cosine - 0.55)); 1 for a zero vector."""
    return F.coalesce(F.lit(1.0) + F.lit(9.0) * sigmoid(F.lit(20.0) * (cosine(a, b, d) - F.lit(0.55))), F.lit(1.0))


def each(a: Column, f) -> Column:
    return F.transform(a, f)


def both(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, f)


def let(value: Column, f) -> Column:
    """f(value) with the value computed once for each row."""
    return F.transform(F.array(value), f)[0]


def softmax(a: Column, masked_at: float = -1e9, epsilon: float = 1e-10) -> Column:
    """Max-shifted softmax; elements at or below `masked_at` get 0; `epsilon` is added to the denominator."""
    top = F.array_max(F.filter(a, lambda v: v > masked_at))
    powers = let(top, lambda t: F.transform(a, lambda v: F.when(v > masked_at, F.exp(v - t)).otherwise(F.lit(0.0))))
    total = lambda p: F.aggregate(p, F.lit(0.0), lambda s, v: s + v) + F.lit(epsilon)
    return let(powers, lambda p: let(total(p), lambda t: F.transform(p, lambda v: v / t)))


def mask_actions(logits: Column, allowed: Column, masked: float = -1e9) -> Column:
    """The logits with -1e9 where the action isn't allowed."""
    return F.zip_with(logits, allowed, lambda v, ok: F.when(ok, v).otherwise(F.lit(masked)))


def one_hot(label: Column, d: int) -> Column:
    return F.array(*[F.when(label == j, F.lit(1.0)).otherwise(F.lit(0.0)) for j in range(d)])


def argmax(a: Column) -> Column:
    """Index from 0 of the greatest element, the first of equals."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def argmin(a: Column) -> Column:
    return (F.array_position(a, F.array_min(a)) - 1).cast("int")


def pick(a: Column, indices: list[int]) -> Column:
    return F.array(*[a[j] for j in indices])


def put(a: Column, index: Column | int, value: Column | float) -> Column:
    """The array with `value` at `index`, counted from 0; an index outside the array raises an error."""
    at = index if isinstance(index, Column) else F.lit(index)
    new = value if isinstance(value, Column) else F.lit(value)
    outside = F.raise_error(F.concat(F.lit("no element "), at.cast("string"))).cast("array<double>")
    return F.when((at < 0) | (at >= F.size(a)), outside).otherwise(F.transform(a, lambda v, i: F.when(i == at, new).otherwise(v)))


def powers(a: Column, degree: int) -> Column:
    """[a, a**2, ..., a**degree] in blocks by power, without cross terms."""
    blocks = [a]
    for _ in range(degree - 1):
        blocks.append(F.zip_with(blocks[-1], a, lambda x, y: x * y))
    return F.concat(*blocks)


def kernel(name: str, a: Column, b: Column, gamma: float = 1.0, d: int | None = None) -> Column:
    """linear: a.b; poly2 and poly3: (1 + a.b) to that power; rbf: exp(-gamma * squared distance)."""
    if name == "rbf":
        return F.exp(F.lit(-float(gamma)) * squared_distance(a, b, d))
    product = dot(a, b, d)
    if name == "linear":
        return product
    if name in ("poly2", "poly3"):
        base = F.lit(1.0) + product
        return base * base if name == "poly2" else base * base * base
    raise ValueError(f"unknown kernel {name!r}: linear, poly2, poly3 or rbf")


def empty_cells(board: Column) -> Column:
    """Positions from 0 of a board's zero cells: the valid actions."""
    return F.filter(F.transform(board, lambda v, i: F.when(v == 0, i)), lambda i: i.isNotNull())
