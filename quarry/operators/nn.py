"""Small neural networks: layers on the driver, gradients summed over tasks, one update for each step.

Each task works on its rows as one matrix; a step moves the parameters to the tasks and one gradient vector back from each.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .optim import Optimizer, partial_sums


@dataclass
class Dense:
    w: np.ndarray
    b: np.ndarray

    @classmethod
    def xavier(cls, inputs: int, outputs: int, rng: np.random.Generator) -> Dense:
        limit = np.sqrt(6 / (inputs + outputs))
        return cls(rng.uniform(-limit, limit, (outputs, inputs)), np.zeros(outputs))

    def __str__(self):
        return f"Linear({self.w.shape[1]},{self.w.shape[0]})"


@dataclass(frozen=True)
class Activation:
    kind: str

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return {"relu": lambda: np.maximum(x, 0), "sigmoid": lambda: 1 / (1 + np.exp(-x)), "tanh": lambda: np.tanh(x)}[self.kind]()

    def slope(self, out: np.ndarray) -> np.ndarray:
        """The derivative, from the activation's own output."""
        return {"relu": lambda: (out > 0).astype(float), "sigmoid": lambda: out * (1 - out), "tanh": lambda: 1 - out * out}[self.kind]()

    def __str__(self):
        return {"relu": "ReLU", "sigmoid": "Sigmoid", "tanh": "Tanh"}[self.kind]


def mse_gradient(out: np.ndarray, y: np.ndarray) -> np.ndarray:
    return out - y.reshape(out.shape)


def softmax_gradient(out: np.ndarray, y: np.ndarray) -> np.ndarray:
    e = np.exp(out - out.max(1, keepdims=True))
    return e / (e.sum(1, keepdims=True) + 1e-10) - np.eye(out.shape[1])[y.astype(int)]


def bce_gradient(out: np.ndarray, y: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-out)) - y.reshape(out.shape)


@dataclass
class Sequential:
    """Dense layers with activations between them, a dense layer last.

    A layer of one's own between dense ones needs a call on a matrix, `slope` (the derivative, element by element, from its own
    output) and a text form for the signature; like all that goes to tasks it must be importable there, or defined in the program.
    """

    layers: list[Dense | Activation] = field(default_factory=list)

    def __post_init__(self):
        kinds = [isinstance(layer, Dense) for layer in self.layers]
        if not kinds or kinds != [i % 2 == 0 for i in range(len(kinds))] or not kinds[-1]:
            raise ValueError("layers must alternate dense, activation, ..., dense")
        dense = self.layers[::2]
        if any(a.w.shape[0] != b.w.shape[1] for a, b in zip(dense, dense[1:], strict=False)):
            raise ValueError("layers don't fit together")

    @classmethod
    def build(cls, sizes: list[int], activation: str = "relu", seed: int = 0) -> Sequential:
        rng, layers = np.random.Generator(np.random.PCG64(seed)), []
        for a, b in zip(sizes, sizes[1:], strict=False):
            layers += [Dense.xavier(a, b, rng), Activation(activation)]
        return cls(layers[:-1])

    def forward(self, rows: np.ndarray) -> list[np.ndarray]:
        """Outputs of all layers for a matrix of rows, the input first. Nothing is kept in the model."""
        seen = [rows]
        for layer in self.layers:
            seen.append(seen[-1] @ layer.w.T + layer.b if isinstance(layer, Dense) else layer(seen[-1]))
        return seen

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        return self.forward(rows)[-1]

    def backward(self, seen: list[np.ndarray], upstream: np.ndarray) -> np.ndarray:
        """Gradients of all parameters summed over rows, as one vector in the order of `parameters`."""
        found = []
        for k in reversed(range(len(self.layers))):
            layer = self.layers[k]
            if isinstance(layer, Dense):
                found.append(np.concatenate([(upstream.T @ seen[k]).ravel(), upstream.sum(0)]))
                upstream = upstream @ layer.w
            else:
                upstream = upstream * layer.slope(seen[k + 1])
        return np.concatenate(found[::-1])

    def parameters(self) -> np.ndarray:
        return np.concatenate([np.concatenate([d.w.ravel(), d.b]) for d in self.layers[::2]])

    def with_parameters(self, theta: np.ndarray) -> Sequential:
        if len(theta) != self.parameter_count:
            raise ValueError(f"{len(theta)} parameters for a model of {self.parameter_count}")
        out, at = [], 0
        for layer in self.layers:
            if isinstance(layer, Dense):
                n, m = layer.w.size, layer.b.size
                layer, at = Dense(theta[at : at + n].reshape(layer.w.shape).copy(), theta[at + n : at + n + m].copy()), at + n + m
            out.append(layer)
        return Sequential(out)

    def copy(self) -> Sequential:
        return self.with_parameters(self.parameters())

    @property
    def parameter_count(self) -> int:
        return len(self.parameters())

    @property
    def signature(self) -> str:
        return f"layers={len(self.layers)};params={2 * len(self.layers[::2])};" + "|".join(map(str, self.layers))


Loss = Callable[[np.ndarray, np.ndarray], np.ndarray]
GRADIENTS: dict[str, Loss] = {"mse": mse_gradient, "softmax": softmax_gradient, "bce": bce_gradient}


def network_gradient(df: DataFrame, model: Sequential, loss: str | Loss = "mse") -> tuple[np.ndarray, int]:
    """Gradient summed over the rows of (x, y), and their number; the same however the rows are partitioned (up to rounding).

    `loss`: a name of GRADIENTS, or a function of (outputs, labels) of a matrix of rows that returns each row's slope by its outputs.
    """
    upstream = loss if callable(loss) else GRADIENTS[loss]

    def each(rows: np.ndarray, y: np.ndarray) -> np.ndarray:
        seen = model.forward(rows)
        return np.append(model.backward(seen, upstream(seen[-1], y)), len(rows))

    s = partial_sums(df, each)
    return s[:-1], int(s[-1])


def train_network(df: DataFrame, model: Sequential, optimizer: Optimizer, epochs: int, loss: str | Loss = "mse", batches: int = 1, key: str = "row_id") -> Sequential:
    """Full batches, or `batches` fixed parts of the rows by `key` in turn. Gradients are means over a batch's rows."""
    from .split import strided_shard

    kept = df.persist()
    for _ in range(epochs):
        for b in range(batches):
            g, n = network_gradient(strided_shard(kept, b, batches, key) if batches > 1 else kept, model, loss)
            model = model.with_parameters(optimizer.step(model.parameters(), g / n))
    kept.unpersist()
    return model


def network_scores(df: DataFrame, model: Sequential, x: str = "x") -> DataFrame:
    """Adds `out` ARRAY<DOUBLE>: the network's output for each row, in Arrow batches."""
    shared, names = df.sparkSession.sparkContext.broadcast(model), [n for n in df.columns if n != "out"]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                y = shared.value(batch.column(x).flatten().to_numpy().astype(float).reshape(batch.num_rows, -1))
                at = pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.ListArray.from_arrays(at, pa.array(y.ravel()))], [*names, "out"])

    return df.mapInArrow(run, ", ".join([*(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names), "out array<double>"]))
