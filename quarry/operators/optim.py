"""First-order optimizers on driver-side vectors, the simplex method, and projected-gradient quadratic programs.

Gradients come from one aggregate over the rows for each step (`partial_sums`); parameters are a handful of numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frame import positive

KINDS = ("gd", "sgd", "adagrad", "rmsprop", "adam", "adamw")


@dataclass
class Optimizer:
    """One update rule with its state. `step` returns the new parameters; state arrays are created at the first step."""

    kind: str = "gd"
    lr: float = 0.01
    beta1: float = 0.9
    beta2: float = 0.999
    epsilon: float = 1e-8
    rho: float = 0.99
    weight_decay: float = 0.01
    steps: int = 0
    m: np.ndarray | None = field(default=None, repr=False)
    v: np.ndarray | None = field(default=None, repr=False)

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown optimizer {self.kind!r}: one of {', '.join(KINDS)}")
        positive(lr=self.lr)

    def step(self, theta: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        theta, g = np.asarray(theta, float), np.asarray(gradient, float)
        if theta.shape != g.shape:
            raise ValueError("parameters and gradient differ in shape")
        if self.m is None:
            self.m, self.v = np.zeros_like(theta), np.zeros_like(theta)
        self.steps += 1
        match self.kind:
            case "gd" | "sgd":
                return theta - self.lr * g
            case "adagrad":
                self.v = self.v + g * g
                return theta - self.lr * g / (np.sqrt(self.v) + self.epsilon)
            case "rmsprop":
                self.v = self.rho * self.v + (1 - self.rho) * g * g
                return theta - self.lr * g / (np.sqrt(self.v) + self.epsilon)
        if self.kind == "adamw":  # decoupled decay, before the step
            theta = theta * (1 - self.lr * self.weight_decay)
        self.m = self.beta1 * self.m + (1 - self.beta1) * g
        self.v = self.beta2 * self.v + (1 - self.beta2) * g * g
        return theta - self.lr * (self.m / (1 - self.beta1**self.steps)) / (np.sqrt(self.v / (1 - self.beta2**self.steps)) + self.epsilon)

    def state(self) -> dict:
        plain = {k: getattr(self, k) for k in ("kind", "lr", "beta1", "beta2", "epsilon", "rho", "weight_decay", "steps")}
        return plain | {k: None if (a := getattr(self, k)) is None else [list(map(int, a.shape)), a.ravel().tolist()] for k in ("m", "v")}

    @classmethod
    def from_state(cls, state: dict) -> Optimizer:
        arrays = {k: None if state[k] is None else np.array(state[k][1]).reshape(state[k][0]) for k in ("m", "v")}
        return cls(**{k: x for k, x in state.items() if k not in arrays}, **arrays)


def partial_sums(df: DataFrame, each: Callable[[np.ndarray, np.ndarray], np.ndarray], x: str = "x", y: str = "y") -> np.ndarray:
    """Sum over all rows of each(X, y): a vector from each task's rows, added up in the order of partitions.

    The driver gets one vector of fixed length for each task (an all-reduce with a sum).
    """

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                rows = batch.column(0).flatten().to_numpy().astype(float).reshape(batch.num_rows, -1)
                part = np.asarray(each(rows, batch.column(1).to_numpy(zero_copy_only=False).astype(float)), float)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["s"])

    found = df.select(x, y).mapInArrow(run, "s array<double>").collect()
    if not found:
        raise ValueError("no rows")
    return np.sum([r["s"] for r in found], axis=0)


def minimize(gradient: Callable[[np.ndarray], np.ndarray], start: np.ndarray, optimizer: Optimizer, iterations: int) -> np.ndarray:
    if iterations < 1:
        raise ValueError("iterations must be positive")
    theta = np.asarray(start, float)
    for _ in range(iterations):
        theta = optimizer.step(theta, gradient(theta))
    return theta


@dataclass(frozen=True)
class LinearProgram:
    solution: np.ndarray
    objective: float
    optimal: bool
    unbounded: bool
    iterations: int


def solve_linear(c, a, b, maximize: bool = True, max_iter: int = 10_000, tolerance: float = 1e-9) -> LinearProgram:
    """Simplex tableau with Dantzig's rule: optimise c.x with a x <= b, x >= 0; every b must be non-negative."""
    c, a, b = np.asarray(c, float), np.atleast_2d(np.asarray(a, float)), np.asarray(b, float)
    m, n = a.shape
    if c.shape != (n,) or b.shape != (m,):
        raise ValueError("c, a and b don't fit together")
    if (b < -tolerance).any():
        raise ValueError("every right-hand side must be non-negative")
    tableau = np.zeros((m + 1, n + m + 1))
    tableau[:m, :n], tableau[:m, n : n + m], tableau[:m, -1] = a, np.eye(m), b
    tableau[m, :n] = -c if maximize else c
    basis = list(range(n, n + m))
    for it in range(max_iter):
        enter = int(np.argmin(tableau[m, :-1]))
        if tableau[m, enter] >= -tolerance:
            x = np.zeros(n + m)
            x[basis] = tableau[:m, -1]
            return LinearProgram(x[:n], float(c @ x[:n]), True, False, it)
        column = tableau[:m, enter]
        ratios = np.where(column > tolerance, tableau[:m, -1] / np.where(column > tolerance, column, 1), np.inf)
        leave = int(np.argmin(ratios))
        if not np.isfinite(ratios[leave]):
            x = np.zeros(n + m)
            x[basis] = tableau[:m, -1]
            return LinearProgram(x[:n], np.inf if maximize else -np.inf, False, True, it)
        tableau[leave] /= tableau[leave, enter]
        others = np.arange(m + 1) != leave
        tableau[others] -= np.outer(tableau[others, enter], tableau[leave])
        basis[leave] = enter
    raise RuntimeError("the simplex method didn't converge")


@dataclass(frozen=True)
class QuadraticProgram:
    solution: np.ndarray
    objective: float
    converged: bool
    iterations: int


def solve_quadratic(q, c, lower, upper, equality=None, target: float = 0.0, start=None, max_iter: int = 5000, tolerance: float = 1e-6, projections: int = 30, step: float = 0.0) -> QuadraticProgram:
    """Projected gradient for x'Qx / 2 + c.x with bounds and at most one equality; step 1 / (greatest absolute row sum) by default."""
    q, c, lower, upper = (np.asarray(v, float) for v in (q, c, lower, upper))
    n = len(c)
    if q.shape != (n, n) or lower.shape != (n,) or upper.shape != (n,):
        raise ValueError("q, c and the bounds don't fit together")
    if (lower > upper).any():
        raise ValueError("a lower bound is above its upper bound")
    positive(max_iter=max_iter, tolerance=tolerance, projections=projections)
    e = None if equality is None else np.asarray(equality, float)
    square = 0.0 if e is None else float(e @ e)
    if e is not None and (e.shape != (n,) or square <= 1e-18 and abs(target) > tolerance):
        raise ValueError("the equality is infeasible or of another length")

    def feasible(x: np.ndarray) -> np.ndarray:
        for _ in range(projections):
            if square > 1e-18:
                x = x - (e @ x - target) / square * e
            x = np.clip(x, lower, upper)
        return x

    if start is None:
        finite = np.isfinite(lower), np.isfinite(upper)
        low, high = np.where(finite[0], lower, 0.0), np.where(finite[1], upper, 0.0)
        start = np.where(finite[0] & finite[1], (low + high) / 2, low + high)
    x = feasible(np.asarray(start, float))
    eta = step if step > 0 else 1 / widest if (widest := np.abs(q).sum(1).max()) >= 1e-12 else 1.0
    done, it = False, 0
    for it in range(1, max_iter + 1):
        moved = feasible(x - eta * (q @ x + c))
        done = float(((moved - x) ** 2).sum()) <= tolerance * tolerance
        x = moved
        if done:
            break
    return QuadraticProgram(x, float(x @ q @ x / 2 + c @ x), done, it)
