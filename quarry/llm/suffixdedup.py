"""Operator 2: removal of repeated byte strings by suffix sorting (deep-shallow).

Every byte covered by a LENGTH-byte string that also starts anywhere else is found, exactly (64-bit hashes stand for equal
strings), without sorting every suffix:

1. Sparse suffixes. Each LENGTH-byte window has an anchor, the ANCHOR-byte string in it with the least hash; equal windows have
   equal anchors at equal offsets. So only suffixes at anchors (one in about 150 bytes) need be compared, and of these only the
   ones whose anchor string stands elsewhere too.
2. Classes. An anchor's context is the union of the windows that it stands for. Contexts that are equal are repeated whole; one of
   each class goes on, if its anchor has other contexts as well.
3. Deep-shallow sorting. The contexts of an anchor string are sorted as suffixes from the anchor on and, reversed, from the
   anchor back: multikey quicksort to a shallow depth, blind tries for groups with longer common prefixes. Joining the classes
   of equal left parts by falling length, each suffix meets its neighbours in right order; common prefixes on both sides that
   add up to LENGTH give the repeated windows.
4. An anchor string of over CAP contexts is split: windows by the half of the offsets they lie in, with the bytes which these
   have in common added to the key, and so on until a part has at most CAP contexts (a part of one offset has one).

A text is read in two ways at once, as bytes (LENGTH of them a window) and as words (PASSAGE of them, by their 64-bit hashes), in the
same passes: a passage of over 50 short words may have fewer than LENGTH bytes.

Scale: texts are read four times, in the third only those that hold a context to be compared, and never shuffled, but for those that
lose bytes. Anchors (8 bytes each) are shuffled once.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KeyFilter, cut, map_arrow
from .neardup import grouped
from .textvec import BLANKS, BYTE_VALUE, buffers, chunks, mix, powers, word_hashes, words

LENGTH, ANCHOR = 400, 100
#: Words of a repeated passage, and of an anchor in it.
PASSAGE, PASSAGE_ANCHOR = 51, 13
CAP = 4096
#: Bytes of the shallow sort past what all suffixes of a group share, and of one comparison in it.
SHALLOW, WORD = 64, 8
PIECE = 1 << 22
_spot = np.uint64((1 << 24) - 1)


class Reading(NamedTuple):
    """How texts are read: symbols of `unit` bytes (1: a byte; 8: a word's hash), in windows of `length`, anchors of `anchor` of them."""

    unit: int
    length: int
    anchor: int

    def symbols(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all texts of a chunk, and where each text's begin."""
        if self.unit == 1:
            return data, offsets
        starts, ends, first = words(data, offsets, BLANKS)
        return word_hashes(data, starts, ends, BLANKS), first


class Anchors:
    """The anchors of all texts in a chunk of symbols: for each, its text, place, and the first and last window that it stands for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
        found = []
        starts, ends = offsets[:-1], offsets[1:]
        if len(data) <= PIECE + length:
            found.append(self._piece(data, starts, ends, np.arange(len(starts)), length, anchor))
        else:  # one long text, in pieces that share no window
            for r in range(len(starts)):
                for a in range(int(starts[r]), max(int(starts[r]) + 1, int(ends[r]) - length + 1), PIECE):
                    b = min(int(ends[r]), a + PIECE + length - 1)
                    row, place, lo, hi, kmer, outer = self._piece(data[a:b], np.array([0]), np.array([b - a]), np.array([r]), length, anchor)
                    found.append((row, place + a, lo + a, hi + a, kmer, outer))
        self.row, self.place, self.lo, self.hi, self.kmer, self.outer = (np.concatenate(x) for x in zip(*found, strict=True))

    @staticmethod
    def _piece(data, starts, ends, rows, length, anchor):
        n, w = len(data), length - anchor + 1
        none = np.zeros(0, np.int64)
        if n < length:
            return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((BYTE_VALUE[data] if data.dtype == np.uint8 else data) * up[:n], out=sums[1:])
        kmers = mix((sums[anchor:] - sums[: n - anchor + 1]) * down[: n - anchor + 1])
        key = (kmers & ~_spot) | np.arange(len(kmers), dtype=np.uint64)
        blocks = -(-len(key) // w)
        padded = np.full(blocks * w, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[: len(key)] = key
        padded = padded.reshape(blocks, w)
        ahead = np.minimum.accumulate(padded, 1).ravel()
        behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
        windows = n - length + 1
        place = (np.minimum(behind[:windows], ahead[w - 1 : w - 1 + windows]) & _spot).astype(np.int64)
        owner = np.repeat(rows, ends - starts)[:windows]
        limit = np.repeat(ends, ends - starts)[:windows]
        valid = np.arange(windows) + length <= limit
        new = np.ones(windows, bool)
        new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], windows) - 1
        ok = valid[first]
        first, last = first[ok], last[ok]
        at = place[first]
        # the context's own hash: the hashes of the anchor-sized strings that it consists of, mixed one after another (a polynomial modulo 2**64 over
        # hundreds of bytes would take some different contexts for equal ones)
        outer, step, end = mix((at - first).astype(np.uint64) * np.uint64(1 << 20) + (last - first).astype(np.uint64)), first, last + length - anchor
        while True:
            outer = mix((outer ^ kmers[step]) * np.uint64(0x9FB21C651E98DF25))
            if (step == end).all():
                break
            step = np.minimum(step + anchor, end)
        return owner[first], at, first, last, kmers[at], outer


def blind_trie(strings: list[bytes], which: list[int], depth: int) -> list[tuple[int, int]]:
    """(string, common prefix with the one before) in order; all strings share their first `depth` bytes.

    A node is (depth, branches by the byte there; -1: the string ends); what lies between depths isn't stored. A leaf is a list of
    equal strings. A string goes down blindly to some leaf, is compared with it once, and is hung in where they differ.
    """

    def byte(s: bytes, d: int) -> int:
        return s[d] if d < len(s) else -1

    root: tuple | list = [which[0]]
    for i in which[1:]:
        s, node = strings[i], root
        while type(node) is tuple:
            node = node[1].get(byte(s, node[0])) or next(iter(node[1].values()))
        other = strings[node[0]]
        same = common(s, other)
        if same == len(s) == len(other):
            node.append(i)
            continue
        parent, edge, node = None, 0, root
        while type(node) is tuple and node[0] < same:
            parent, edge = node, byte(s, node[0])
            node = node[1][edge]
        if type(node) is tuple and node[0] == same:
            node[1][byte(s, same)] = [i]
            continue
        fork = (same, {byte(other, same): node, byte(s, same): [i]})
        if parent is None:
            root = fork
        else:
            parent[1][edge] = fork
    out: list[tuple[int, int]] = []
    stack: list[tuple[tuple | list, int]] = [(root, depth)]
    while stack:
        node, before = stack.pop()
        if type(node) is tuple:
            branches = sorted(node[1], reverse=True)
            stack += [(node[1][c], before if c == branches[-1] else node[0]) for c in branches]
        else:
            out += [(i, before if k == 0 else len(strings[i])) for k, i in enumerate(node)]
    return out


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    differing = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differing.bit_length() + 7) // 8


def deep_shallow(strings: list[bytes], depth: int = 0, shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """The order of the strings and each one's common prefix with the one before (0 for the first).

    All share their first `depth` bytes. Multikey quicksort on WORD-byte keys to `shallow` bytes further on; blind tries beyond.
    """
    order: list[int] = []
    shared: list[int] = []
    stack = [(list(range(len(strings))), depth)]
    while stack:
        which, d = stack.pop()
        if not which:
            continue
        if len(which) == 1 or d >= depth + shallow:
            part = blind_trie(strings, which, d) if len(which) > 1 else [(which[0], 0)]
            if order:
                shared.append(common(strings[order[-1]], strings[part[0][0]]))
            else:
                shared.append(0)
            order += [i for i, _ in part]
            shared += [n for _, n in part[1:]]
            continue
        pivot = strings[which[len(which) // 2]][d : d + WORD]
        less, same, more = [], [], []
        for i in which:
            key = strings[i][d : d + WORD]
            (less if key < pivot else same if key == pivot else more).append(i)
        stack += [(more, d), (same, d + WORD if len(pivot) == WORD else depth + shallow), (less, d)]
    return order, shared


def repeated_offsets(contexts: list[bytes], at: list[int], anchor: int, length: int = LENGTH, unit: int = 1) -> list[list[tuple[int, int]]]:
    """For each context the ranges (least, most) of left offsets whose windows stand in another context too.

    Each context has its anchor of `anchor` symbols at place `at`; a window at offset o begins o symbols before the anchor.
    """
    right = [c[a * unit :] for c, a in zip(contexts, at, strict=True)]
    left = [c[: a * unit][::-1] for c, a in zip(contexts, at, strict=True)]
    order, _ = deep_shallow(right, anchor * unit)
    rank = [0] * len(order)
    for k, i in enumerate(order):
        rank[i] = k
    found: list[list[tuple[int, int]]] = [[] for _ in contexts]
    by_left, equal = deep_shallow(left)
    group = {i: [rank[i]] for i in by_left}  # of a class's first member: the class's right ranks, sorted
    head = list(range(len(contexts)))

    def top(i: int) -> int:
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    for k in sorted(range(1, len(by_left)), key=lambda k: -equal[k]):
        a, b, most = top(by_left[k - 1]), top(by_left[k]), equal[k] // unit
        if len(group[a]) < len(group[b]):
            a, b = b, a
        large, small = group[a], group.pop(b)
        head[b] = a
        for r in small:
            p = bisect_left(large, r)
            for q in (p - 1, p):
                if 0 <= q < len(large):
                    i, j = order[r], order[large[q]]
                    least = max(0, length - common(right[i], right[j]) // unit)
                    if least <= most:
                        found[i].append((least, most))
                        found[j].append((least, most))
        large += small
        large.sort()
    return found


SCHEMA = "key long, outer long, rid long, lo long, hi long, off long, unit long"


def repeated_ranges(docs: DataFrame, readings: list[Reading], cap: int = CAP) -> DataFrame:
    """(rid, unit, a, b): ranges of symbols, overlapping or not, that cover what is repeated; rid is the hash of (doc_id, text)."""
    keyed = docs.select("text", F.xxhash64("doc_id", "text").alias("rid"))
    context = docs.sparkSession.sparkContext
    by_unit = {r.unit: r for r in readings}

    def anchors(texts: pa.Array) -> Iterator[tuple[Reading, int, np.ndarray, np.ndarray, Anchors, np.ndarray]]:
        """For each chunk and reading: its first row, symbols, where texts begin, anchors and their keys (apart for each unit)."""
        for lo, _, data, at in chunks(texts):
            for reading in readings:
                symbols, first = reading.symbols(data, at)
                x = Anchors(symbols, first, reading.length, reading.anchor)
                yield reading, lo, symbols, first, x, (x.kmer * np.uint64(2 * reading.unit - 1)).view(np.int64)

    def kmers(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [key for *_, key in anchors(batch.column("text"))]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], ["key"])

    # cut, so that texts are read once for it, and so that the join below deals both sides anew and can split a frequent key
    often = cut(map_arrow(keyed.select("text"), kmers, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"))
    twice = context.broadcast(KeyFilter(often))

    def rows(batch: pa.RecordBatch, wanted=None, holders=None) -> pa.RecordBatch:
        if holders is not None:
            batch = batch.filter(pa.array(holders.value(batch.column("rid").to_numpy())))
        rid, out, texts = batch.column("rid").to_numpy(), [], []
        for reading, lo, symbols, at, x, key in anchors(batch.column("text")):
            pick = np.flatnonzero(twice.value(key))
            own, base = rid[lo + x.row[pick]], at[:-1][x.row[pick]]
            table = np.stack([key[pick], x.outer[pick].view(np.int64), own, x.lo[pick] - base, x.hi[pick] - base, x.place[pick] - x.lo[pick], np.full(len(pick), reading.unit)])
            if wanted is not None:
                mine = wanted.value(identity(table))
                table, pick = table[:, mine], pick[mine]
                texts += [symbols[a : b + reading.length].tobytes() for a, b in zip(x.lo[pick].tolist(), x.hi[pick].tolist(), strict=True)]
            out.append(table)
        table = np.concatenate(out, 1) if out else np.zeros((7, 0), np.int64)
        names = ["key", "outer", "rid", "lo", "hi", "off", "unit"]
        more = ([pa.array(texts, pa.binary())], ["context"]) if wanted is not None else ([], [])
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in table), *more[0]], [*names, *more[1]])

    placed = cut(map_arrow(keyed, rows, SCHEMA).join(often, "key", "left_semi"))
    whole, reps = classes(placed, ["lo", "hi", "off", "unit"])
    results = [whole]
    reps = cut(reps)
    if not reps.isEmpty():
        hashed = map_arrow(reps.select("key", "outer", "rid", "lo"), lambda b: pa.RecordBatch.from_arrays([pa.array(identity(np.stack([c.to_numpy() for c in b.columns])))], ["id"]), "id long")
        picked, holders = context.broadcast(KeyFilter(hashed)), context.broadcast(KeyFilter(reps.select("rid").distinct()))
        contexts = map_arrow(keyed, lambda b: rows(b, picked, holders), SCHEMA + ", context binary")
        contexts = cut(contexts.join(reps.select("key", "outer", "rid", "lo", "contexts"), ["key", "outer", "rid", "lo"]).dropDuplicates(["key", "outer"]))
        results += compared(contexts, by_unit, cap)
    out = results[0].select("rid", "unit", "lo", "hi")
    for more in results[1:]:
        out = out.unionByName(more.select("rid", "unit", "lo", "hi"))
    length = F.when(F.lit(False), F.lit(0))
    for r in readings:
        length = length.when(F.col("unit") == r.unit, F.lit(r.length))
    return out.select("rid", "unit", F.col("lo").alias("a"), (F.col("hi") + length).alias("b"))


def compared(contexts: DataFrame, by_unit: dict[int, Reading], cap: int) -> list[DataFrame]:
    """Tables of (rid, unit, lo, hi): the first and last of windows that stand in two contexts of one key; keys of over `cap` contexts
    are split by offsets until none is left."""

    def compare(table: pa.Table) -> pa.RecordBatch | None:
        lo, off, reading = table.column("lo").to_pylist(), table.column("off").to_pylist(), by_unit[table.column("unit")[0].as_py()]
        out = []
        for rid, start, a, ranges in zip(table.column("rid").to_pylist(), lo, off, repeated_offsets(table.column("context").to_pylist(), off, reading.anchor, reading.length, reading.unit), strict=True):
            out += [(rid, reading.unit, start + a - most, start + a - least) for least, most in set(ranges)]
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)], ["rid", "unit", "lo", "hi"]) if out else None

    def halve(batch: pa.RecordBatch, size: int) -> pa.RecordBatch:
        """Each context's windows in parts of `size` offsets, the part's common symbols in the key."""
        out, texts = [], []
        for key, rid, lo, hi, off, unit, text in zip(*(batch.column(c).to_pylist() for c in ("key", "rid", "lo", "hi", "off", "unit", "context")), strict=True):
            _, length, anchor = by_unit[unit]
            for part in range((off - (hi - lo)) // size, off // size + 1):
                near, far = part * size, min(part * size + size - 1, length - anchor)
                least, most = max(off - (hi - lo), near), min(off, far)
                # all windows at offsets from `near` to `far` hold the symbols from the start of the nearest to the end of the farthest
                held, union = text[(off - near) * unit : (off - far + length) * unit], text[(off - most) * unit : (off - least + length) * unit]
                keys = [hashlib.blake2b(held, digest_size=8, key=f"{part}:{size}:{key}".encode()), hashlib.blake2b(union, digest_size=8, key=f"{most}:{least}".encode())]
                out.append((*(int.from_bytes(k.digest(), "big", signed=True) for k in keys), rid, lo + off - most, lo + off - least, most, unit))
                texts.append(union)
        columns = [pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 7
        return pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.binary())], ["key", "outer", "rid", "lo", "hi", "off", "unit", "context"])

    results, width = [], 1 << max((r.length - r.anchor).bit_length() for r in by_unit.values())
    while True:
        results.append(grouped(contexts.filter(F.col("contexts") <= cap), "key", compare, "rid long, unit long, lo long, hi long"))
        crowded = contexts.filter(F.col("contexts") > cap)
        if width == 1 or crowded.isEmpty():
            return results
        width //= 2
        parts = cut(map_arrow(crowded.drop("contexts"), lambda b, size=width: halve(b, size), SCHEMA + ", context binary"))
        whole, contexts = classes(parts, ["lo", "hi", "off", "unit", "context"])
        results.append(whole)
        contexts = cut(contexts)


def identity(table: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each column of (key, outer, rid, lo, ...)."""
    h = np.zeros(table.shape[1], np.uint64)
    for c in table[:4]:
        h = mix(h * np.uint64(31) + np.ascontiguousarray(c).view(np.uint64))
    return h.view(np.int64)


def classes(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose context stands elsewhere too; and one row for each context of keys that have several, with their number."""
    kinds = cut(rows.groupBy("key", "outer").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("rid", *columns)).alias("one")))
    whole = rows.join(kinds.filter("copies > 1").select("key", "outer"), ["key", "outer"])
    several = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("contexts")).filter("contexts > 1")
    return whole, kinds.join(several, "key").select("key", "outer", "one.*", "contexts")


def merged(ranges: list[dict] | None, unit: int) -> list[dict]:
    """Maximal runs {a, b} of the ranges of one unit."""
    own: list[dict] = []
    for r in sorted((r for r in ranges or () if r["unit"] == unit), key=lambda r: r["a"]):
        if own and r["a"] <= own[-1]["b"]:
            own[-1]["b"] = max(own[-1]["b"], r["b"])
        else:
            own.append({"a": r["a"], "b": r["b"]})
    return own


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, cap: int = CAP, passage: int = PASSAGE, passage_anchor: int = PASSAGE_ANCHOR) -> DataFrame:
    """doc_id, n_bytes, spans and passages array<struct<a,b>> and kept (binary, what remains) for each row of (doc_id, text).

    Each byte covered by a `length`-byte string that also starts anywhere else, in any text or the same, is removed; `spans` are the
    maximal removed runs. `passages` are the maximal runs of words (in word numbers; words are runs without blanks, A-Z as a-z)
    covered by `passage` words that also stand anywhere else; they are reported, not removed. Strings are judged on the input.
    A null text is empty; texts shorter than a window keep all; repeated rows are copies of each
    other. An empty table gives no rows. Other columns are ignored.
    """
    ranges = repeated_ranges(docs, [Reading(1, length, anchor), Reading(8, passage, passage_anchor)], cap)
    ranges = cut(ranges.groupBy("rid").agg(F.collect_list(F.struct("unit", "a", "b")).alias("ranges")))
    touched = docs.sparkSession.sparkContext.broadcast(KeyFilter(ranges.select("rid")))
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rid"))
    names = ["doc_id", "n_bytes", "spans", "passages", "kept"]
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, spans array<struct<a:long,b:long>>, passages array<struct<a:long,b:long>>, kept binary"
    span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def untouched(batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = batch.filter(pa.array(~touched.value(batch.column("rid").to_numpy())))
        texts = batch.column("text").cast(pa.binary()).fill_null(b"")
        sizes = np.diff(buffers(batch.column("text"))[1]) if batch.num_rows else np.zeros(0, np.int64)
        none = pa.array([[]] * batch.num_rows, span)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), none, none, texts], names)

    def shorten(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans, passages, kept, sizes = [], [], [], []
        for text, found in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("ranges").to_pylist(), strict=True):
            text, own = text or b"", merged(found, 1)
            edges = [0, *(x for r in own for x in (r["a"], r["b"])), len(text)]
            spans.append(own)
            passages.append(merged(found, 8))
            sizes.append(len(text))
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(passages, span), pa.array(kept, pa.binary())], names)

    some = map_arrow(keyed, lambda b: b.filter(pa.array(touched.value(b.column("rid").to_numpy()))), keyed.schema)
    return map_arrow(keyed, untouched, schema).unionByName(map_arrow(some.join(ranges, "rid", "left").select("doc_id", "text", "ranges"), shorten, schema))
