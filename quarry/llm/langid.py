"""Operator 3: language identification by hierarchical discrimination.

First a linear classifier tells the language families apart, then one-versus-one linear support vector machines tell the
languages of the chosen family apart; a family of one language needs none. Features are hashed byte bigrams and trigrams of the
lower-cased text, non-letters as blanks, as shares of the text's total, scaled by the inverse root of each feature's mean share.

Fitting takes a bounded sample: at most about `per_language` documents of each language by a seeded hash. Scoring gathers
weights (a table of DIMS rows, a column for each classifier) over whole texts, in Arrow batches, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import below, map_arrow, widened
from .textvec import chunks

DIMS = 1 << 14
PER_LANGUAGE = 1000
UNDETERMINED = "und"
#: Families of languages by ISO 639-1 code. Fixed values; a code that isn't here is a family of its own.
FAMILIES = {
    "Germanic": "en de nl sv da no nb nn is af fy lb yi",
    "Romance": "fr es it pt ro ca gl oc la",
    "Slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "Baltic": "lt lv",
    "Celtic": "ga cy gd br",
    "Uralic": "fi et hu",
    "Turkic": "tr az kk uz ky tk tt",
    "Indic": "hi ur bn mr gu pa ne",
    "Iranian": "fa ku ps tg",
    "Semitic": "ar he mt am",
    "Malayic": "id ms",
}
_table = np.full(256, 32, np.uint8)
_table[97:123] = np.arange(97, 123)
_table[65:91] = np.arange(97, 123)
_table[128:] = np.arange(128, 256)


@dataclass
class LanguageModel:
    """Languages, their families, and the weight table: a column for each family, then one for each pair within a family."""

    languages: list[str]
    families: list[list[int]]
    pairs: list[tuple[int, int]]
    weights: np.ndarray
    bias: np.ndarray
    scale: np.ndarray


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of a chunk's bigrams and trigrams, in order of their first byte, and each text's number of bytes ahead.

    Entries 2i and 2i+1 belong to byte i; those that would cross into the next text count as ending in a blank.
    """
    b = _table[data].astype(np.uint32)
    ends = np.zeros(len(b), np.uint8)
    last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    ends[last] = 1
    ahead = np.append(b[1:], np.uint32(32))
    ahead[last] = 32
    then = np.append(ahead[1:], np.uint32(32))
    then[last] = 32
    pair = b << np.uint32(8) | ahead
    found = np.empty(2 * len(b), np.int32)
    found[0::2] = (pair * np.uint32(0x9E3779B1)) >> np.uint32(18)
    found[1::2] = ((pair << np.uint32(8) | then) * np.uint32(0x85EBCA6B) + np.uint32(0x7F4A7C15)) >> np.uint32(18)
    return found, 2 * offsets


def fit_svm(examples: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, c: float = 10.0, epochs: int = 12, seed: int = 1) -> tuple[np.ndarray, float]:
    """A linear L1-loss support vector machine by dual coordinate descent; the bias is one more feature."""
    w, alpha = np.zeros(DIMS + 1), np.zeros(len(y))
    norms = np.array([float(v @ v) + 1 for _, v in examples])
    order = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        moved = 0.0
        for e in order.permutation(len(y)):
            i, v = examples[e]
            g = y[e] * (w[i] @ v + w[-1]) - 1
            new = min(c, max(0.0, alpha[e] - g / norms[e]))
            if (d := new - alpha[e]) != 0:
                alpha[e] = new
                w[i] += d * y[e] * v
                w[-1] += d * y[e]
                moved = max(moved, abs(d))
        if moved < 1e-3 * c:
            break
    return w[:-1], float(w[-1])


def fit_languages(docs: DataFrame, allowed: Column | None = None, per_language: int = PER_LANGUAGE, families: dict[str, str] | None = None) -> LanguageModel | None:
    """A model from the (doc_id, text, lang) rows that `allowed` admits; None without a language to learn."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.filter(allowed) if allowed is not None else rows
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    rate = F.lit(False)
    for lang, n in counts.items():
        rate = F.when(F.col("lang") == lang, below(per_language / n, 3, "doc_id", "lang")).otherwise(rate)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, share = [], []
        for _, _, data, at in chunks(batch.column("text")):
            i, cut = ngrams(data, at)
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                k, n = np.unique(i[a:b], return_counts=True)
                found.append(k)
                share.append((n / max(1, b - a)).astype(np.float32))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(found, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32()))], ["doc_id", "lang", "i", "v"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = map_arrow(rows.filter(rate).select("doc_id", "lang", "text"), each, f"doc_id {kind}, lang string, i array<int>, v array<float>")
    got = sample.toArrow().sort_by([("lang", "ascending"), ("doc_id", "ascending")])
    lists, values = got.column("i").combine_chunks(), got.column("v").combine_chunks()
    at, flat, share = lists.offsets.to_numpy(), lists.values.to_numpy(), values.values.to_numpy().astype(np.float64)
    scale = 1 / np.sqrt(np.bincount(flat, share, DIMS) / max(1, got.num_rows) + 1e-5)
    examples = [(flat[a:b], share[a:b] * scale[flat[a:b]]) for a, b in zip(at[:-1], at[1:], strict=True)]
    number = {name: k for k, name in enumerate(languages)}
    y = np.array([number[name] for name in got.column("lang").to_pylist()], int)
    named = {code: name for name, codes in (families or FAMILIES).items() for code in codes.split()}
    groups: dict[str, list[int]] = {}
    for k, name in enumerate(languages):
        groups.setdefault(named.get(name, f"={name}"), []).append(k)
    members = list(groups.values())
    pairs = [p for m in members for p in combinations(m, 2)]
    columns, bias = [], []
    for m in members if len(members) > 1 else ():
        w, b = fit_svm(examples, np.where(np.isin(y, m), 1.0, -1.0))
        columns.append(w), bias.append(b)
    if len(members) == 1:
        columns.append(np.zeros(DIMS)), bias.append(1.0)
    for a, b_ in pairs:
        chosen = np.flatnonzero((y == a) | (y == b_))
        w, b = fit_svm([examples[e] for e in chosen], np.where(y[chosen] == a, 1.0, -1.0))
        columns.append(w), bias.append(b)
    return LanguageModel(languages, members, pairs, (np.stack(columns, 1) * scale[:, None]).astype(np.float32), np.array(bias), scale)


def _decide(model: LanguageModel, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The language of each row of margins and its score: the family's share times that of its wins."""
    f = len(model.families)
    sure = 1 / (1 + np.exp(-np.clip(2 * margins, -35, 35)))
    share = sure[:, :f] / np.maximum(sure[:, :f].sum(1, keepdims=True), 1e-12)
    family, best, score = margins[:, :f].argmax(1), np.zeros(len(margins), int), np.zeros(len(margins))
    for k, members in enumerate(model.families):
        rows = np.flatnonzero(family == k)
        votes, belief = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
        for j, (a, b) in enumerate(model.pairs):
            if a in members:
                s = sure[rows, f + j]
                x, y = members.index(a), members.index(b)
                votes[:, x] += s >= 0.5
                votes[:, y] += s < 0.5
                belief[:, x] += s
                belief[:, y] += 1 - s
        games = max(1, len(members) - 1)
        won = (votes + belief / (games + 1)).argmax(1) if len(rows) else np.zeros(0, int)
        best[rows] = np.array(members)[won]
        score[rows] = share[rows, k] * (belief[np.arange(len(rows)), won] / games if len(members) > 1 else 1.0)
    return best, np.clip(score, 0, 1)


def predict_languages(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """`docs` with `lang_pred` and `score` from the whole text alone; `und` and 0 for a null text, one without letters, or no model."""
    kept = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    names_kept = kept.columns

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, names, scores = shared.value, [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
        texts = batch.column("text")
        for lo, hi, data, at in chunks(texts) if m is not None else ():
            letters = np.concatenate([[0], np.cumsum((_table[data] >= 97) & (data < 128))])
            full = letters[at[1:]] > letters[at[:-1]]
            for r in np.flatnonzero(~full & (at[1:] > at[:-1])):
                full[r] = any(c.isalpha() for c in texts[lo + int(r)].as_py())
            i, cut = ngrams(data, at)
            sums = np.zeros((hi - lo, m.weights.shape[1]))
            some = np.flatnonzero(np.diff(cut))
            for c in range(m.weights.shape[1]) if len(some) else ():
                sums[some, c] = np.add.reduceat(np.ascontiguousarray(m.weights[:, c])[i], cut[some], dtype=np.float64)
            best, score = _decide(m, sums / np.maximum(1, np.diff(cut))[:, None] + m.bias)
            for r in np.flatnonzero(full):
                names[lo + r], scores[lo + r] = m.languages[best[r]], score[r]
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names_kept), pa.array(names, pa.string()), pa.array(scores)], [*names_kept, "lang_pred", "score"])

    return map_arrow(kept, each, widened(kept, "lang_pred string, score double"))


def held_out() -> Column:
    """A fifth of the documents, by a seeded hash of doc_id; no row of a null id."""
    return F.coalesce(F.when(F.col("doc_id").isNotNull(), F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(5)) == 0), F.lit(False))


def calibrate(docs: DataFrame, model: LanguageModel) -> tuple[float, dict[str, float]]:
    """From labelled documents that weren't learnt from: the score below which no clean one (predicted as labelled) lies, and each
    language's score that nine in ten clean ones reach, from which on a prediction counts as sure. 0 and nothing without clean documents.
    """
    clean = predict_languages(docs.select("text", "lang"), model).filter(F.col("lang") == F.col("lang_pred"))
    rows = clean.groupBy("lang").agg(F.min("score").alias("least"), F.percentile_approx("score", 0.1, 10_000).alias("usual")).collect()
    return min((r["least"] for r in rows), default=0.0), {r["lang"]: r["usual"] for r in rows}
