"""Symbolic expressions: a small driver-side tree that compiles to Spark columns, so that losses and gradients are evaluated
for all rows at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ieee import ieee_div, ieee_log, sigmoid
from .optim import Optimizer

STEP = 1e-5


def _divide(a: float, b: float) -> float:
    return a / b if b else math.nan if a == 0 or math.isnan(a) else math.copysign(math.inf, a) * math.copysign(1, b)


def _log(x: float) -> float:
    return math.log(x) if x > 0 else -math.inf if x == 0 else math.nan


def _pow(a: float, b: float) -> float:
    with np.errstate(all="ignore"):
        return float(np.power(np.float64(a), np.float64(b)))


def _exp(x: float) -> float:
    return math.exp(x) if x < 709.78 else math.inf


#: name: (value of numbers, column of columns)
FUNCTIONS: dict[str, tuple[Callable, Callable]] = {
    "+": (lambda a, b: a + b, lambda a, b: a + b),
    "-": (lambda a, b: a - b, lambda a, b: a - b),
    "*": (lambda a, b: a * b, lambda a, b: a * b),
    "/": (_divide, ieee_div),
    "^": (_pow, F.pow),
    "exp": (_exp, F.exp),
    "log": (_log, ieee_log),
    "sqrt": (lambda x: math.sqrt(x) if x >= 0 else math.nan, F.sqrt),
    "abs": (abs, F.abs),
    "sigmoid": (lambda x: 1 / (1 + _exp(-x)), sigmoid),
    "max": (lambda *v: max(v), lambda *c: F.greatest(*c) if len(c) > 1 else c[0]),
    "min": (lambda *v: min(v), lambda *c: F.least(*c) if len(c) > 1 else c[0]),
}


@dataclass(frozen=True, eq=False)
class Expr:
    """A number, a variable, or a function of expressions. `a + b`, `a ** b`, `-a` and so on build trees."""

    name: str | None = None
    value: float | None = None
    args: tuple[Expr, ...] = ()

    def __add__(self, other):
        return call("+", self, other)

    def __radd__(self, other):
        return call("+", other, self)

    def __sub__(self, other):
        return call("-", self, other)

    def __rsub__(self, other):
        return call("-", other, self)

    def __mul__(self, other):
        return call("*", self, other)

    def __rmul__(self, other):
        return call("*", other, self)

    def __truediv__(self, other):
        return call("/", self, other)

    def __rtruediv__(self, other):
        return call("/", other, self)

    def __pow__(self, other):
        return call("^", self, other)

    def __neg__(self):
        return call("*", -1.0, self)

    def __str__(self):
        if self.value is not None:
            return f"{self.value:.6f}"
        if not self.args:
            return self.name
        if self.name in "+-*/^":
            return f"({self.args[0]} {self.name} {self.args[1]})"
        return f"{self.name}({', '.join(map(str, self.args))})"

    def variables(self) -> list[str]:
        """Names in order, each once."""
        own = {self.name} if self.value is None and not self.args else set()
        return sorted(own.union(*(a.variables() for a in self.args)))

    def substitute(self, **bindings: Expr | float) -> Expr:
        if self.value is None and not self.args:
            return expr(bindings[self.name]) if self.name in bindings else self
        return Expr(self.name, self.value, tuple(a.substitute(**bindings) for a in self.args))

    def simplify(self) -> Expr:
        """Constant folding from the leaves; nothing algebraic. An unknown function of constants raises ValueError."""
        if not self.args:
            return self
        args = tuple(a.simplify() for a in self.args)
        if all(a.value is not None for a in args):
            if self.name not in FUNCTIONS:
                raise ValueError(f"unknown function {self.name!r}")
            return number(FUNCTIONS[self.name][0](*(a.value for a in args)))
        return Expr(self.name, None, args)

    def evaluate(self, **bindings: float) -> float:
        left = self.substitute(**bindings).simplify()
        if left.value is None:
            raise ValueError(f"unbound: {', '.join(left.variables())}")
        return left.value

    def column(self, columns: Mapping[str, Column] | None = None) -> Column:
        """The expression over a frame's columns; a variable is the column of its name unless `columns` says otherwise."""
        if self.value is not None:
            return F.lit(float(self.value))
        if not self.args:
            return (columns or {}).get(self.name, F.col(self.name))
        if self.name not in FUNCTIONS:
            raise ValueError(f"unknown function {self.name!r}")
        return FUNCTIONS[self.name][1](*(a.column(columns) for a in self.args))

    def central(self, name: str, h: float = STEP) -> Expr:
        """(f(x + h) - f(x - h)) / 2h as an expression."""
        x = var(name)
        return (self.substitute(**{name: x + h}) - self.substitute(**{name: x - h})) / (2 * h)

    def forward(self, name: str, h: float = STEP) -> Expr:
        return (self.substitute(**{name: var(name) + h}) - self) / h

    def gradient(self, h: float = STEP, **at: float) -> dict[str, float]:
        return {n: self.central(n, h).evaluate(**at) for n in sorted(at)}


def number(v: float) -> Expr:
    return Expr(None, float(v))


def var(name: str) -> Expr:
    return Expr(name)


def expr(v: Expr | float) -> Expr:
    return v if isinstance(v, Expr) else number(v)


def call(name: str, *args: Expr | float) -> Expr:
    return Expr(name, None, tuple(map(expr, args)))


def total(terms: list[Expr]) -> Expr:
    return reduce(lambda a, b: a + b, terms) if terms else number(0)


@dataclass(frozen=True)
class SymbolicLoss:
    """A loss for one row, over x0 .. x{d-1}, y and parameters w0 .. w{d-1}, b; and a regulariser of the parameters."""

    sample: Callable[[int], Expr]
    regularizer: Callable[[int], Expr] = lambda d: number(0)


def _score(d: int) -> Expr:
    return total([var(f"w{j}") * var(f"x{j}") for j in range(d)]) + var("b")


def squared_loss(ridge: float = 0.0) -> SymbolicLoss:
    """Half the squared error, and ridge * (sum of w squared + b squared)."""
    return SymbolicLoss(lambda d: 0.5 * (_score(d) - var("y")) ** 2, lambda d: ridge * total([var(f"w{j}") ** 2 for j in range(d)] + [var("b") ** 2]))


def cross_entropy_loss() -> SymbolicLoss:
    def sample(d: int) -> Expr:
        p = call("sigmoid", _score(d))
        return -(var("y") * call("log", p) + (1 - var("y")) * call("log", 1 - p))

    return SymbolicLoss(sample)


def loss_gradient(df: DataFrame, loss: SymbolicLoss, d: int, theta: dict[str, float], h: float = STEP) -> dict[str, float]:
    """Central differences of the mean loss and the regulariser in every parameter: one aggregate over the rows."""
    columns = {f"x{j}": F.col("x")[j] for j in range(d)} | {"y": F.col("y")}
    body, penalty = loss.sample(d), loss.regularizer(d)

    def at(**shift: float) -> Column:
        return F.avg(body.substitute(**(theta | shift)).column(columns))

    row = df.agg(*[((at(**{n: v + h}) - at(**{n: v - h})) / F.lit(2 * h)).alias(n) for n, v in theta.items()]).first()
    rest = {n: (penalty.evaluate(**(theta | {n: v + h})) - penalty.evaluate(**(theta | {n: v - h}))) / (2 * h) for n, v in theta.items()}
    return {n: row[n] + rest[n] for n in theta}


def symbolic_optimize(df: DataFrame, loss: SymbolicLoss, d: int, optimizer: Optimizer, iterations: int) -> dict[str, float]:
    """Parameters from 0 by the optimizer's steps on the mean loss over all rows."""
    names = [f"w{j}" for j in range(d)] + ["b"]
    theta, kept = np.zeros(d + 1), df.persist()
    for _ in range(iterations):
        g = loss_gradient(kept, loss, d, dict(zip(names, theta.tolist(), strict=True)))
        theta = optimizer.step(theta, np.array([g[n] for n in names]))
    kept.unpersist()
    return dict(zip(names, theta.tolist(), strict=True))


def optimize_expr(f: Expr, initial: dict[str, float], optimizer: Optimizer, iterations: int) -> dict[str, float]:
    """Minimises an expression of its variables; stochastic descent has no rows to draw and is refused."""
    if optimizer.kind == "sgd":
        raise ValueError("an expression has no rows for stochastic descent")
    names = sorted(initial)
    theta = np.array([initial[n] for n in names], float)
    for _ in range(iterations):
        g = f.gradient(**dict(zip(names, theta.tolist(), strict=True)))
        theta = optimizer.step(theta, np.array([g[n] for n in names]))
    return dict(zip(names, theta.tolist(), strict=True))
