"""Operator 10: toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashes of its words, their beginnings (PREFIXES bytes: inflected forms share them), word
pairs and pairs with one or two words between, in DIMS buckets.
FTRL-proximal keeps a learning rate for each coordinate and an L1 term that leaves most weights at exactly 0; the surviving
weights (float32, DIMS of them at most: 4 MB) are broadcast and texts are scored where they lie, without a shuffle.

Fitting takes a bounded sample of labelled rows: about `per_class` of each class and CHARACTERS in all, by a seeded hash of the id,
each weighted by the inverse of its class's sampling rate. All rows are scored, whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import below, map_arrow, widened
from .textvec import SYMBOLS, chunks, mix, word_hashes, words

DIMS = 1 << 20
PREFIXES = (4, 5, 6)
#: Most documents of each class that a model is fitted on, and passes over them.
PER_CLASS, EPOCHS = 5000, 3
#: About the most characters of the sampled texts: some 0.7 features each, of four bytes on the driver.
CHARACTERS = 18_000_000
_gaps = [np.uint64(x | 1) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)]


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts in a chunk (repeats included) and the row of each. Never across texts."""
    starts, ends, first = words(data, offsets, SYMBOLS)
    h, row = word_hashes(data, starts, ends, SYMBOLS), np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
    parts, rows = [h], [row]
    for k in PREFIXES:
        longer = np.flatnonzero(ends - starts > k)
        parts.append(word_hashes(data, starts[longer], starts[longer] + k, SYMBOLS) * np.uint64(2 * k + 1))
        rows.append(row[longer])
    for gap, salt in enumerate(_gaps, 1):
        same = row[gap:] == row[:-gap]
        parts.append(mix(h[:-gap] * salt + h[gap:])[same])
        rows.append(row[gap:][same])
    return (np.concatenate(parts) % np.uint64(DIMS)).astype(np.int32), np.concatenate(rows)


def fit_ftrl(examples: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, alpha: float = 1.0, beta: float = 1.0, l1: float = 3.0, l2: float = 1.0, epochs: int = EPOCHS, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias. Per-coordinate FTRL-proximal; the bias is a coordinate without L1."""
    z, n = np.zeros(DIMS + 1), np.zeros(DIMS + 1)
    order = np.random.Generator(np.random.PCG64(seed))

    def at(i: np.ndarray) -> np.ndarray:
        part, penalty = z[i], np.where(i == DIMS, 0.0, l1)
        return np.where(np.abs(part) <= penalty, 0.0, (np.sign(part) * penalty - part) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for e in order.permutation(len(examples)):
            i = np.append(examples[e], DIMS)
            w = at(i)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = (p - labels[e]) * weights[e]
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - step * w
            n[i] += g * g
    w = at(np.arange(DIMS + 1))
    return w[:-1].astype(np.float32), float(w[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, label: str = "toxic", per_class: int = PER_CLASS, characters: int = CHARACTERS) -> tuple[np.ndarray, float]:
    """A model from (doc_id, text) and (doc_id, label); `allowed` restricts the label rows that may be learnt from.

    Labels other than 0 and 1 and null ids or labels are left out. Without an example of both classes the model is the bias
    alone: the share of the class seen, or one half.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    rows = rows.filter(allowed) if allowed is not None else rows
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return np.zeros(DIMS, np.float32), -4.0 if counts.get(0) else 4.0 if counts.get(1) else 0.0
    rate = {y: min(1.0, per_class / n) for y, n in counts.items()}
    # The sample's rows are about 2 * per_class pairs of numbers: a bounded broadcast; the texts stay where they are.
    pick = lambda: rows.filter(F.when(F.col("y") == 1, below(rate[1], 10, "doc_id")).otherwise(below(rate[0], 11, "doc_id"))).dropDuplicates(["doc_id"])
    size = docs.select("doc_id", F.length("text").alias("size")).join(F.broadcast(pick()), "doc_id").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    rate = {y: r * min(1.0, characters / max(1, size)) for y, r in rate.items()}
    sample = docs.select("doc_id", "text").join(F.broadcast(pick()), "doc_id").select("doc_id", "y", "text")

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for _, _, data, at in chunks(batch.column("text")):
            i, row = features(data, at)
            cut = np.searchsorted(row_sorted := np.sort(row, kind="stable"), np.arange(len(at)))
            order = np.argsort(row, kind="stable")
            found += [np.unique(i[order[a:b]]).astype(np.int32) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            del row_sorted
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "y", "i"])

    got = map_arrow(sample, each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y int, i array<int>").toArrow()
    if got.num_rows == 0:
        return np.zeros(DIMS, np.float32), 0.0
    examples = []  # views of the arrays that came, in the order of the ids
    for lists in got.column("i").chunks:
        flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
        examples += [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    order = pc.sort_indices(got.column("doc_id")).to_numpy()
    y = got.column("y").to_numpy().astype(np.float64)[order]
    weight = np.where(y == 1, 1 / rate[1], 1 / rate[0])
    return fit_ftrl([examples[e] for e in order], y, weight / weight.mean())


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """`docs` with `score` (double, 0 to 1). A null or empty text scores as the bias alone; repeats of a feature count once."""
    kept = docs.drop("score")
    shared, bias = docs.sparkSession.sparkContext.broadcast(model[0]), model[1]

    names_kept = kept.columns

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        w, out = shared.value, np.full(batch.num_rows, bias)
        for lo, hi, data, at in chunks(batch.column("text")):
            i, row = features(data, at)
            hit = np.flatnonzero(w[i])
            once = np.unique(row[hit].astype(np.int64) * DIMS + i[hit])
            out[lo:hi] += np.bincount(once // DIMS, w[once % DIMS], hi - lo)
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names_kept), pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))], [*names_kept, "score"])

    return map_arrow(kept, each, widened(kept, "score double"))
