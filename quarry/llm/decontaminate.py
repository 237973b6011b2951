"""Operator 1: benchmark decontamination by a generalised suffix automaton.

The normalised words of all test items go into one suffix automaton over word numbers. Training words stream through it; the
state after each word gives the longest match that ends there. Where the match is at least `window` words, or is a whole shorter
item, its words are hit. A word or a word pair that no item has would send the automaton back to its root, so only the runs
between such places are walked.

Scale: the automaton is broadcast; its size is bounded by BLOCK_WORDS item words. A benchmark of one block needs one reading of the
documents and no shuffle. A larger one is cut into blocks of one reading each, which keep the hits alone (runs of a few numbers, under a
hash of the row); one more reading joins them to the documents that have any.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KeyFilter, cut, map_arrow, widened
from .textvec import SYMBOLS, chunks, word_hashes, words

WINDOW = 10
#: Item words in a block: its automaton takes some 100 MB.
BLOCK_WORDS = 200_000


class SuffixAutomaton:
    """A generalised suffix automaton of word sequences, with what a match needs to know at each state."""

    def __init__(self, items: list[list[int]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends = []
        for item in items:
            last = 0
            for c in item:
                last = self._extend(last, c)
            ends.append(last)
        owners: list[list[int]] = [[] for _ in self.link]
        for k, item in enumerate(items):
            at = 0
            for c in item:
                at = up = self.next[at][c]
                while up > 0 and (not owners[up] or owners[up][-1] != k):
                    owners[up].append(k)
                    up = self.link[up]
        #: For each state: its ancestor whose strings include that of `window` words; items with that string; whole shorter items.
        self.full = [-1] * len(self.link)
        self.short: list[list[tuple[int, list[int]]]] = [[] for _ in self.link]
        self.owners = {}
        for k, item in enumerate(items):
            if 0 < len(item) < window:
                at = 0
                for c in item:
                    at = self.next[at][c]
                for length, who in self.short[at]:
                    if length == len(item):
                        who.append(k)
                        break
                else:
                    self.short[at].append((len(item), [k]))
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        self.above = [-1] * len(self.link)  # the nearest proper ancestor that has whole short items
        for v in order:
            p = self.link[v]
            self.above[v] = p if self.short[p] else self.above[p]
            if self.length[v] >= window:
                self.full[v] = v if self.length[p] < window else self.full[p]
                if self.full[v] == v:
                    self.owners[v] = owners[v]

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        cur = len(self.link)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        new = len(self.link)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def stream(self, run: list[int]) -> Iterator[tuple[int, int, list[int], int]]:
        """(first word, last word + 1, items, longest match) for every occurrence of a window in `run`."""
        at = length = 0
        for i, c in enumerate(run):
            while at and c not in self.next[at]:
                at = self.link[at]
                length = self.length[at]
            if c not in self.next[at]:
                continue
            at, length = self.next[at][c], length + 1
            if length >= self.window:
                yield i + 1 - self.window, i + 1, self.owners[self.full[at]], length
            for n, who in self.short[at]:
                if n <= length:
                    yield i + 1 - n, i + 1, who, length
            up = self.above[at]
            while up >= 0:
                for n, who in self.short[up]:
                    yield i + 1 - n, i + 1, who, length
                up = self.above[up]


class Block:
    """A block of items, ready to match: word hashes, word pairs, the automaton."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.ids = [i for i, _ in items]
        data, at = next(((d, o) for _, _, d, o in chunks(pa.array([t for _, t in items], pa.string()), 1 << 60)), (np.zeros(0, np.uint8), np.zeros(1, np.int64)))
        starts, ends, first = words(data, at, SYMBOLS)
        self.vocabulary, number = np.unique(word_hashes(data, starts, ends, SYMBOLS), return_inverse=True)
        sequences = [number[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
        self.automaton = SuffixAutomaton(sequences, window)
        self.least = min([window, *(len(s) for s in sequences if s)])
        same = np.repeat(np.arange(len(sequences)), np.diff(first)) if len(number) else np.zeros(0, int)
        pairs = number[:-1] * len(self.vocabulary) + number[1:]
        self.pairs = np.unique(pairs[same[1:] == same[:-1]])
        # a table of one slot for each low hash value finds most words' numbers in one step
        self.bits = max(10, int(4 * len(self.vocabulary)).bit_length())
        low = (self.vocabulary & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        self.known = np.zeros(1 << self.bits, bool)
        self.known[low] = True

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Each word's number, -1 if no item has it."""
        out = np.full(len(h), -1, np.int64)
        if len(self.vocabulary):
            maybe = np.flatnonzero(self.known[(h & np.uint64((1 << self.bits) - 1)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.vocabulary, h[maybe]), len(self.vocabulary) - 1)
            right = self.vocabulary[place] == h[maybe]
            out[maybe[right]] = place[right]
        return out

    def runs(self, number: np.ndarray, row: np.ndarray) -> list[tuple[int, int]]:
        """Runs of words all of whose neighbours are pairs that some item has, at least as long as the shortest window."""
        known = number >= 0
        joined = np.zeros(len(number), bool)  # word i follows word i - 1 in some item
        both = np.flatnonzero(known[1:] & known[:-1] & (row[1:] == row[:-1])) + 1
        if len(both) and len(self.pairs):
            code = number[both - 1] * len(self.vocabulary) + number[both]
            place = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            joined[both[self.pairs[place] == code]] = True
        start = np.flatnonzero(known & ~joined)
        last = np.flatnonzero(known & ~np.append(joined[1:], False)) + 1
        long = last - start >= self.least
        return list(zip(start[long].tolist(), last[long].tolist(), strict=True))


def blocks_of(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of at most `block_words` words (a longer item is a block), read one partition at a time."""
    held, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).toLocalIterator():
        n = len(r["t"] or "") // 2 + 1
        if held and size + n > block_words:
            yield held
            held, size = [], 0
        held.append((r["i"] or "", r["t"] or ""))
        size += n
    yield held


ADDED = ("n_words", "n_hit", "longest", "items", "spans")
RUNS = "items array<string>, runs array<struct<first:bigint,last:bigint,a:bigint,b:bigint,longest:bigint>>"
_runs = pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "last", "a", "b", "longest")]))


def hits(block: Block, texts: pa.Array) -> tuple[list[int], list[list[str]], list[list[dict]]]:
    """For each text its number of words, the items found, and its maximal runs of hit words: their word numbers, bytes and longest match."""
    n_words, found, runs = [], [], []
    for _, _, data, at in chunks(texts):
        starts, ends, index = words(data, at, SYMBOLS)
        row = np.repeat(np.arange(len(index) - 1), np.diff(index))
        number = block.numbers(word_hashes(data, starts, ends, SYMBOLS))
        seen: dict[int, list[tuple[int, int, int]]] = {}
        who: dict[int, set[int]] = {}
        for a, b in block.runs(number, row):
            r = int(row[a])
            for x, y, items, length in block.automaton.stream(number[a:b].tolist()):
                seen.setdefault(r, []).append((a + x, a + y, length))
                who.setdefault(r, set()).update(items)
        n_words += np.diff(index).tolist()
        for r in range(len(index) - 1):
            found.append(sorted({block.ids[j] for j in who.get(r, ())}))
            own = union([{"first": x, "last": y, "longest": n} for x, y, n in seen.get(r, ())])
            runs.append([{"first": int(s["first"] - index[r]), "last": int(s["last"] - index[r]), "a": int(starts[s["first"]] - at[r]), "b": int(ends[s["last"] - 1] - at[r]), "longest": s["longest"]} for s in own])
    return n_words, found, runs


def union(runs: list[dict]) -> list[dict]:
    """Maximal runs of words of several runs; where two meet the longest match counts, and the bytes of both."""
    out: list[dict] = []
    for s in sorted(runs, key=lambda s: s["first"]):
        if out and s["first"] <= out[-1]["last"]:
            if s["last"] > out[-1]["last"]:
                out[-1] |= {"last": s["last"], **({"b": s["b"]} if "b" in s else {})}
            out[-1]["longest"] = max(out[-1]["longest"], s["longest"])
        else:
            out.append(dict(s))
    return out


def match_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """`docs` with n_words, n_hit, longest (words of the longest match), items array<string> and spans array<struct<a,b,longest>>.

    `spans` are maximal runs of hit words as byte ranges of the UTF-8 text, each with its longest match in words. A null text has no
    words; an item without words has no window; null item ids count as ''. Nulls elsewhere and columns of any other name pass unseen.
    """
    df = docs.drop(*ADDED)
    keep = df.columns
    kinds = "n_words bigint, n_hit bigint, longest bigint, items array<string>, spans array<struct<a:bigint,b:bigint,longest:bigint>>"
    schema, span = widened(df, kinds), pa.list_(pa.struct([(n, pa.int64()) for n in ("a", "b", "longest")]))
    share = docs.sparkSession.sparkContext.broadcast

    def result(batch: pa.RecordBatch, n_words: list[int], items: list[list[str]], runs: list[list[dict]]) -> pa.RecordBatch:
        n_hit = [sum(s["last"] - s["first"] for s in own) for own in runs]
        longest = [max((s["longest"] for s in own), default=0) for own in runs]
        spans = [[{n: s[n] for n in ("a", "b", "longest")} for s in own] for own in runs]
        made = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(longest, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, span)]
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), *made], [*keep, *ADDED])

    blocks = blocks_of(benchmark, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        shared = share(Block(first, window))
        return map_arrow(df, lambda batch: result(batch, *hits(shared.value, batch.column("text"))), schema)

    # several blocks: only hits are carried from one reading to the next
    keyed = df.select("text", F.xxhash64("text").alias("text_key")).filter("text is not null")

    def found_in(block) -> DataFrame:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            _, items, runs = hits(block.value, batch.column("text"))
            some = np.flatnonzero([bool(r) for r in runs])
            return pa.RecordBatch.from_arrays([batch.column("text_key").take(pa.array(some)), pa.array([items[i] for i in some], pa.list_(pa.string())), pa.array([runs[i] for i in some], _runs)], ["text_key", "items", "runs"])

        return cut(map_arrow(keyed, each, "text_key bigint, " + RUNS).dropDuplicates(["text_key"]))

    every = None
    for items in chain((first, second), blocks):
        own = found_in(share(Block(items, window)))
        every = own if every is None else every.unionByName(own)
    every = cut(every.groupBy("text_key").agg(F.flatten(F.collect_list("items")).alias("items_"), F.flatten(F.collect_list("runs")).alias("runs_")))
    touched = share(KeyFilter(every.select("text_key")))
    marked = df.withColumn("text_key_", F.xxhash64("text"))

    def count(texts: pa.Array) -> list[int]:
        return [n for _, _, data, at in chunks(texts) for n in np.diff(words(data, at, SYMBOLS)[2]).tolist()]

    def clear(batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = batch.filter(pa.array(~touched.value(batch.column("text_key_").to_numpy())))
        none = [[] for _ in range(batch.num_rows)]
        return result(batch, count(batch.column("text")), none, none)

    def hit(batch: pa.RecordBatch) -> pa.RecordBatch:
        items = [sorted(set(x or ())) for x in batch.column("items_").to_pylist()]
        return result(batch, count(batch.column("text")), items, [union(x or []) for x in batch.column("runs_").to_pylist()])

    some = map_arrow(marked, lambda b: b.filter(pa.array(touched.value(b.column("text_key_").to_numpy()))), marked.schema)
    some = some.join(every, F.col("text_key_") == F.col("text_key"), "left").select(*keep, "items_", "runs_")
    return map_arrow(marked, clear, schema).unionByName(map_arrow(some, hit, schema))


def remove_matches(matched: DataFrame, min_words: int = 1, max_coverage: float = 0.8) -> DataFrame:
    """Documents of `match_benchmark` with the matched spans cut out of `text`; those with more than `max_coverage` of their
    words hit, or whose text is nothing but matches, go. `min_words`: spans whose longest match is shorter stay. Clean texts stay as they are."""
    left = [n for n in matched.columns if n not in ADDED]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            if spans := [s for s in spans if s["longest"] >= min_words]:
                raw, at, parts = texts[i].encode(), 0, []
                for s in spans:
                    parts.append(raw[at : s["a"]])
                    at = s["b"]
                texts[i] = b"".join([*parts, raw[at:]]).decode("utf-8", "replace")
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in left], left)

    kept = matched.filter((F.col("n_hit") == 0) | (F.col("n_hit") <= F.lit(max_coverage) * F.col("n_words")))
    return map_arrow(kept, each, matched.select(*left).schema)


def items_digest(items: pa.Array) -> list[str]:
    """Lowercase hex SHA-256 of each sorted, comma-joined list of item ids."""
    return [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items.to_pylist()]
