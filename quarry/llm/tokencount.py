"""Operator 4: token counts by trie-shared dynamic programming over distinct pre-tokens.

A pre-token is a run of non-blank characters with a word mark before it. Its tokens are the best segmentation into vocabulary
pieces by a unigram score; a character that no piece covers falls back to its bytes. Each worker keeps a trie of the distinct pre-tokens
that it has met. A node has the forward entry of its prefix (best score, tokens) and the pieces under way there. A new pre-token
goes down as far as others share its beginning, computes the entries beyond, and hangs its rest with its count as one leaf; a leaf gets
nodes when another pre-token goes that way, so a prefix's entry is computed once more at most, and kept once it is shared.

The public vocabularies have merge ranks, no unigram scores, and tokenizers aren't trained here: scores follow the ranks.

Scale: texts are read once, without a shuffle. Terminal counts are also kept under the pre-tokens' hashes, so that whole chunks
are looked up at once. A trie of over NODES nodes, or over KNOWN counts, is started anew: memory is bounded, results don't change. The
vocabulary (under 1 MB) is broadcast.
"""

from __future__ import annotations

import gc
import math
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, widened
from .textvec import chunks, lookup, word_hashes, words

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
KNOWN = 1 << 22
#: Nodes and leaves of a worker's trie, some 300 bytes each.
NODES = 1 << 18
#: Words are runs of [^\x20\x09-\x0D], case as it is.
WORDS = lookup(" \t\n\v\f\r", lower=False)


@dataclass(frozen=True)
class Unigram:
    """Log scores of pieces and of a fallback byte. `root`: the pieces' own trie, nodes of [branches by character, score or None]."""

    pieces: dict[str, float]
    byte: float
    root: dict[str, list]

    @classmethod
    def of(cls, pieces: list[str]) -> Unigram:
        """Scores by rank: the logarithm of a Zipf-Mandelbrot mass, -ln(rank + 2.7), up to a constant. Bytes rank last."""
        scores: dict[str, float] = {}
        root: dict[str, list] = {}
        for rank, piece in enumerate(pieces):
            scores.setdefault(piece, -math.log(rank + 2.7))
        for piece, score in scores.items():
            node: list = [root, None]
            for c in piece:
                node = node[0].setdefault(c, [{}, None])
            node[1] = score
        return cls(scores, -math.log(len(pieces) + 2.7), root)

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each pre-token, by a trie of their own. Of equal scores the fewest tokens count."""
        trie = Trie(self)
        return [trie.insert(t) for t in texts]


class Trie:
    """Distinct pre-tokens with the forward entry of every prefix.

    A node is [children by character, score, -tokens, pieces under way: (branches, score and -tokens before the piece)]; a leaf is
    (what follows its character, tokens of the pre-token).
    """

    def __init__(self, model: Unigram):
        self.model, self.nodes = model, 1
        self.root: list = [{}, 0.0, 0, ()]

    def insert(self, text: str) -> int:
        """The tokens of `text`, which is in the trie from now on."""
        node = self.root
        for i, c in enumerate(text):
            child = node[0].get(c)
            if child is None:
                _, score, tokens, live = node
                for x in text[i:]:
                    score, tokens, live = self._step(x, score, tokens, live)
                node[0][c] = (text[i + 1 :], -tokens)
                self.nodes += 1
                return -tokens
            if type(child) is tuple:
                rest, count = child
                if len(rest) == len(text) - i - 1 and text.endswith(rest):
                    return count
                child = node[0][c] = [{}, *self._step(c, *node[1:])]
                if rest:
                    child[0][rest[0]] = (rest[1:], count)
                    self.nodes += 1
            node = child
        return -node[2]

    def _step(self, c: str, score: float, tokens: int, live: list) -> tuple[float, int, list]:
        """The entry after one more character: of equal scores the fewest tokens count."""
        n = 1 if c < "\x80" else len(c.encode("utf-8", "surrogatepass"))
        top, least, on = score + n * self.model.byte, tokens - n, []
        found = self.model.root.get(c)
        if found is not None:
            if found[1] is not None and (score + found[1], tokens - 1) > (top, least):
                top, least = score + found[1], tokens - 1
            if found[0]:
                on.append((found[0], score, tokens))
        for branches, before, count in live:
            found = branches.get(c)
            if found is not None:
                if found[1] is not None:
                    reached = before + found[1]
                    if reached > top or reached == top and count - 1 > least:
                        top, least = reached, count - 1
                if found[0]:
                    on.append((found[0], before, count))
        return top, least, on


@cache
def _model(raw: bytes) -> Unigram:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_proto=raw)
    plain = [i for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
    return Unigram.of([m.id_to_piece(i) for i in plain])


class Stored:
    """A worker's trie and its terminal counts by pre-token hash, in sorted arrays; one for each process and vocabulary."""

    def __init__(self, model: Unigram) -> None:
        self.trie = Trie(model)
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def count(self, text: str) -> int:
        if self.trie.nodes > NODES:
            self.trie = Trie(self.trie.model)
        return self.trie.insert(text)

    def get(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.minimum(np.searchsorted(self.keys, h), max(0, len(self.keys) - 1))
        known = self.keys[place] == h if len(self.keys) else np.zeros(len(h), bool)
        return known, self.values[place] if len(self.keys) else np.zeros(len(h), np.int64)

    def put(self, h: np.ndarray, values: np.ndarray) -> None:
        if len(self.keys) + len(h) > KNOWN:
            self.keys, self.values = self.keys[:0], self.values[:0]
        place = np.searchsorted(self.keys, h)
        self.keys, self.values = np.insert(self.keys, place, h), np.insert(self.values, place, values)


_stored: dict[int, Stored] = {}


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """`docs` with n_pretokens and n_tokens of each whole text. A null, empty or blank text has none of either."""
    kept = docs.drop("n_pretokens", "n_tokens")
    names = kept.columns
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = _model(shared.value)
        stored = _stored.get(hash(shared.value)) or _stored.setdefault(hash(shared.value), Stored(model))
        pre, tokens = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        for lo, hi, data, at in chunks(batch.column("text")):
            starts, ends, first = words(data, at, WORDS)
            if not len(starts):
                continue
            distinct, one, which = np.unique(word_hashes(data, starts, ends, WORDS), return_index=True, return_inverse=True)
            known, counts = stored.get(distinct)
            fresh = np.flatnonzero(~known)
            if len(fresh):
                raw = data.tobytes()
                texts = [MARK + raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[one[fresh]].tolist(), ends[one[fresh]].tolist(), strict=True)]
                counts = counts.copy()
                gc.disable()  # the trie has no cycles: the collector would only walk it again and again
                counts[fresh] = [stored.count(t) for t in texts]
                gc.freeze()
                gc.enable()
                stored.put(distinct[fresh], counts[fresh])
            sums = np.concatenate([[0], np.cumsum(counts[which])])
            pre[lo:hi], tokens[lo:hi] = np.diff(first), sums[first[1:]] - sums[first[:-1]]
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(pre), pa.array(tokens)], [*names, "n_pretokens", "n_tokens"])

    return map_arrow(kept, each, widened(kept, "n_pretokens bigint, n_tokens bigint"))
