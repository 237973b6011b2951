"""Operator 13: byte-pair encoding of whole texts with a public tokenizer, and decoding, by reuse of content-defined chunks.

1. Chunks. A rolling hash of the last GRAM bytes cuts texts where it is small and smallest nearby, so that equal passages are cut alike
   wherever they stand. A chunk is known by a 128-bit digest of its bytes; what stands in more than one place is shared.
2. Shared chunks are encoded once each, alone, in a table by digest. Digests that make up more than a HEAVY-th of all chunks are at
   most HEAVY many: their encodings, of bounded size, go to all tasks; others meet their documents in a join, none of them hot.
3. Joins are repaired. An encoding of a chunk alone is right but for its ends, where the pre-tokenizer may see other neighbours. So the
   window around each join grows on both sides until both encodings must agree with the whole text's: to a place where the
   pre-tokenizer cuts whatever stands before and behind. The window is encoded anew, and the chunk's ids are cut at these places,
   which have to be token boundaries; a chunk without two such places becomes part of the window. What isn't shared is encoded in the
   same windows, where the document stands.
4. Documents with shared chunks are put together in one sort by document.

Texts themselves are never shuffled, but one copy of each shared chunk; every pass over them reads whole texts. A place where the pre-tokenizer always cuts: behind an ASCII
letter, digit or mark (not an apostrophe), before ASCII of another kind; runs of letters, of digits and of marks never go on there.
The letters from U+00C0 to U+027F count as ASCII ones. Special tokens are cut out first, as the library does.
Within a window the same places part units, whose ids a worker remembers.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import KeyFilter, cut, give_back, widened
from .textvec import BYTE_VALUE, chunks, mix, powers

#: Bytes that a cut depends on; chunks are 2**AVERAGE bytes long in the mean, LEAST at least (but at ends of texts), MOST at most.
GRAM, AVERAGE, LEAST, MOST = 16, 8, 64, 4096
#: A digest of more than a HEAVY-th of all chunks, and more than FEW, is heavy.
HEAVY, FEW = 4096, 16
_KIND = np.zeros(256, np.uint8)  # of ASCII: 1 letters, 2 digits, 3 marks, 4 blanks; 0: anything else
for _c in range(128):
    _KIND[_c] = 1 if chr(_c).isalpha() else 2 if chr(_c).isdigit() else 4 if chr(_c) in "\t\n\v\f\r " else 3 if 33 <= _c < 127 else 0


#: Units whose ids a worker remembers.
REMEMBERED = 1 << 20


class Spelling:
    """Each id's bytes: all that decoding needs."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        # byte-level vocabularies write printable bytes as themselves and the others, in order, as the characters from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
        vocabulary = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.spelled = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.spelled[i] = b"".join(bytes([byte_of[c]]) if c in byte_of else c.encode() for c in token)
        self.lengths = np.array(list(map(len, self.spelled)), np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text that the ids spell; ids beyond the vocabulary are passed over, bytes that aren't UTF-8 become U+FFFD."""
        ids = ids if not len(ids) or ids.max() < len(self.spelled) else ids[ids < len(self.spelled)]
        out = b"".join(map(self.spelled.__getitem__, ids.tolist()))
        try:
            out.decode()
        except UnicodeDecodeError:
            out = out.decode("utf-8", "replace").encode()
        return out


class Tokenizer:
    """A byte-level BPE tokenizer: the library's encoder, called once for each unit (what stands between two firm places) that isn't remembered."""

    def __init__(self, raw: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        spec = json.loads(raw)
        spec.update(truncation=None, padding=None)
        pre, plain = spec["pre_tokenizer"], all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec["added_tokens"])
        if not (spec["normalizer"] is None and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and plain and spec["model"]["type"] == "BPE" and not spec["model"]["dropout"]):
            raise ValueError("only a byte-level BPE tokenizer without normalizer and prefix space, and with plain added tokens, cuts where this operator relies on it")
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile(b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.library = tokenizers.Tokenizer.from_str(json.dumps(spec))
        self.known: dict[bytes, bytes] = {}

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece, encoded alone; a piece holds no special token's string."""
        raw = b"".join(pieces)
        offsets = np.cumsum([0, *map(len, pieces)])
        at = firm(np.frombuffer(raw, np.uint8), offsets)
        ends = at.tolist()
        units = [raw[a:b] for a, b in zip(ends, ends[1:])]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = list(set(units).difference(known))
        for u, e in zip(new, self.library.encode_batch_fast([u.decode() for u in new], add_special_tokens=False), strict=True):
            known[u] = array("I", e.ids).tobytes()
        first = np.searchsorted(at, offsets).tolist()
        return [np.frombuffer(b"".join(map(known.__getitem__, units[a:b])), "<u4") for a, b in zip(first, first[1:])]


@cache
def _tokenizer(raw: bytes) -> Tokenizer:
    return Tokenizer(raw)


@cache
def _spelling(raw: bytes) -> Spelling:
    return Spelling(raw)


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks of the texts begin, and the end of all: ascending places in `data`, every text's begin and end among them."""
    n = len(data)
    bounds = np.unique(offsets)
    if n <= GRAM:
        return bounds
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * up[:n], out=sums[1:])
    key = mix((sums[GRAM:n] - sums[: n - GRAM]) * down[: n - GRAM])  # of the bytes before the places from GRAM to n - 1
    place = np.flatnonzero(key >> np.uint64(64 - AVERAGE) == 0)
    key, place = key[place], place + GRAM
    text = np.searchsorted(offsets, place, "right")
    ok = (place - offsets[text - 1] >= max(GRAM, LEAST)) & (offsets[text] - place >= LEAST) & ((data[place] & 0xC0) != 0x80)
    key, place, text = key[ok], place[ok], text[ok]
    kept, k = np.ones(len(place), bool), 1
    while k < len(place) and (near := (place[k:] - place[:-k] < LEAST) & (text[k:] == text[:-k])).any():
        lower = key[:-k] <= key[k:]  # of equal ones the first
        kept[k:][near & lower] = False
        kept[:-k][near & ~lower] = False
        k += 1
    at = np.union1d(bounds, place[kept])
    gaps = np.diff(at)
    if (gaps > MOST).any():
        more = [np.arange(a + MOST, a + gap, MOST) for a, gap in zip(at[:-1][gaps > MOST], gaps[gaps > MOST], strict=True)]
        more = np.concatenate([m for m in more])
        while (inside := (data[np.minimum(more, n - 1)] & 0xC0) == 0x80).any():
            more = more - inside
        at = np.union1d(at, more)
    return at


def firm(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where the pre-tokenizer always cuts, every text's begin and end among them, ascending."""
    places = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        before, behind = _KIND[data[:-1]], _KIND[data[1:]]
        lead = (data >= 0xC3) & (data <= 0xC9)  # of the letters from U+00C0 to U+027F, but for two signs
        lead[:-1] &= ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
        behind = np.where(lead[1:], 1, behind)
        before[1:] = np.where(lead[:-2], 1, before[1:])
        places[1:-1] = (before > 0) & (before < 4) & (behind > 0) & (before != behind) & (data[:-1] != 39)
    places[offsets] = True
    return np.flatnonzero(places)


class Pieces:
    """Texts of one chunk of a batch as segments between special tokens, cut into chunks with digests."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, tokenizer: Tokenizer):
        self.raw = data.tobytes()
        found = [m.span() for m in tokenizer.specials.finditer(self.raw)] if tokenizer.specials else []
        if found:  # a string across two texts is none
            found = [(a, b) for a, b in found if np.searchsorted(offsets, a, "right") == np.searchsorted(offsets, b - 1, "right")]
        self.specials = dict(found)
        self.bounds = np.union1d(offsets, np.array(found, np.int64).ravel()) if found else np.asarray(offsets)
        self.offsets = offsets
        at = cuts(data, self.bounds) if found else cuts(data, offsets)
        self.starts, self.ends = at[:-1], at[1:]
        self.digests = [hashlib.blake2b(self.raw[a:b], digest_size=16).digest() for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]
        if self.specials:
            self.digests = [b"" if a in self.specials else d for a, d in zip(self.starts.tolist(), self.digests, strict=True)]
        self.text = np.searchsorted(offsets, self.starts, "right") - 1

    def halves(self) -> tuple[np.ndarray, np.ndarray]:
        """The two halves of each digest as integers."""
        return halves([d or bytes(16) for d in self.digests] if self.specials else self.digests)

    def usable(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each chunk the first and last place in it where the pre-tokenizer always cuts."""
        places = firm(data, self.bounds)
        first = places[np.minimum(np.searchsorted(places, self.starts, "left"), len(places) - 1)]
        last = places[np.searchsorted(places, self.ends, "right") - 1]
        return first, last


def _pieces(batch: pa.RecordBatch, tokenizer: Tokenizer) -> Iterator[tuple[int, int, np.ndarray, Pieces]]:
    for lo, hi, data, offsets in chunks(batch.column("text")):
        yield lo, hi, data, Pieces(data, offsets, tokenizer)


def packed(ids: np.ndarray) -> bytes:
    """Ids in little space, as they are shuffled: byte planes of 16 or 32 bits each, compressed."""
    wide = ids.astype("<u2") if not len(ids) or ids.max() < 1 << 16 else ids.astype("<u4")
    planes = np.ascontiguousarray(wide.view(np.uint8).reshape(-1, wide.itemsize).T).tobytes()
    return bytes([wide.itemsize]) + len(planes).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def unpacked(raw: bytes) -> np.ndarray:
    width, size = raw[0], int.from_bytes(raw[1:9], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(raw[9:], size, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(f"<u{width}").ravel().astype("<u4")


def halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), "<i8")
    return both[::2], both[1::2]


def marked(pieces: Pieces, shared: tuple[KeyFilter, KeyFilter]) -> np.ndarray:
    """Which chunks are encoded in the table of shared ones: those that two filters, of either half of the digests, let through."""
    a, b = pieces.halves()
    found = shared[0](a) & shared[1](b)
    return found & np.array([len(d) > 0 for d in pieces.digests], bool) if pieces.specials else found


def named(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def encode_documents(docs: DataFrame, tokenizer: str, digests: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids) for every row of `docs` (doc_id, text); ids are little-endian unsigned 32-bit integers on end.

    With `digests`, in place of ids the SHA-256 of them and of the text that they are decoded to (ids_sha256, decoded_sha256).

    The same as the library's encoding of the whole text without adding special tokens, truncation or padding; special tokens' strings in a text
    are these tokens. A null or empty text has no tokens. Equal rows are each returned; doc_id may repeat or be null. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    with open(tokenizer, "rb") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    _tokenizer(vocabulary.value)  # refuses here what it can't encode

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count: dict[bytes, int] = {}
            for _, _, _, pieces in _pieces(batch, _tokenizer(vocabulary.value)):
                for d in pieces.digests:
                    count[d] = count.get(d, 0) + 1
            count.pop(b"", None)
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(count.values(), pa.int64())], ["digest", "n"])
        give_back()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(h.copy()) for h in halves(batch.column("digest").to_pylist())], ["low", "high"])

    counted = docs.select("text").mapInArrow(digested, "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    shared = cut(counted.filter("n > 1"))
    parts = shared.select("digest").mapInArrow(split, "low long, high long")
    marks = spark.sparkContext.broadcast((KeyFilter(parts.select("low")), KeyFilter(parts.select("high"))))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, bytes] = {}
            for _, _, _, pieces in _pieces(batch, _tokenizer(vocabulary.value)):
                for k in np.flatnonzero(marked(pieces, marks.value)).tolist():
                    if pieces.digests[k] not in found:
                        found[pieces.digests[k]] = pieces.raw[pieces.starts[k] : pieces.ends[k]]
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(found.values(), pa.binary())], ["digest", "chunk"])
        give_back()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _tokenizer(vocabulary.value).encode(batch.column("chunk").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(map(packed, ids), pa.binary())], ["digest", "ids"])
        give_back()

    distinct = docs.select("text").mapInArrow(texts, "digest binary, chunk binary").groupBy("digest").agg(F.max("chunk").alias("chunk"))
    table = cut(distinct.mapInArrow(encoded, "digest binary, ids binary"))
    # occurrences of shared chunks are a lower bound of all chunks: at most HEAVY digests can be above this part of them
    limit = max(FEW, (shared.agg(F.sum("n")).first()[0] or 0) // HEAVY)
    often = shared.filter(F.col("n") > limit).select("digest")
    heavy = spark.sparkContext.broadcast({bytes(r["digest"]): bytes(r["ids"]) for r in table.join(often, "digest").collect()})

    def referred(pieces: Pieces, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunks that are taken from the table or the heavy ones, and the first and last place of what is taken."""
        first, last = pieces.usable(data)
        used = np.flatnonzero(marked(pieces, marks.value) & (first < last) & (first >= pieces.starts) & (last <= pieces.ends))
        return used, first[used], last[used]

    def references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each use of a shared chunk that isn't heavy: digest, document, number in it, first and last byte of the chunk's."""
        for batch in batches:
            columns: list[list] = [[], [], [], [], [], []]
            for lo, hi, data, pieces in _pieces(batch, _tokenizer(vocabulary.value)):
                used, first, last = referred(pieces, data)
                used_light = [k for k, u in enumerate(used.tolist()) if pieces.digests[u] not in heavy.value]
                names = {}
                number: dict[int, int] = {}
                for k in used_light:
                    u, row = int(used[k]), int(pieces.text[used[k]])
                    if row not in names:
                        names[row] = named(pieces.raw[pieces.offsets[row] : pieces.offsets[row + 1]])
                    number[row] = number.get(row, -1) + 1
                    for column, value in zip(columns, (lo + row, names[row], number[row], pieces.digests[u], int(first[k] - pieces.starts[u]), int(last[k] - pieces.starts[u])), strict=True):
                        column.append(value)
            row, name, number_, digest, a, b = columns
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(name, pa.binary()), pa.array(number_, pa.int64()), pa.array(digest, pa.binary()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["doc_id", "name", "number", "digest", "first", "last"])
        give_back()

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coder = _spelling(vocabulary.value)
            parts = [packed(cut_ids(coder, unpacked(i), a, b)) for i, a, b in zip(batch.column("ids").to_pylist(), batch.column("first").to_pylist(), batch.column("last").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("name"), batch.column("number"), pa.array(parts, pa.binary()), pa.nulls(len(parts), pa.binary())], ["doc_id", "name", "number", "ids", "at"])
        give_back()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row (number -1) for each document: the ids of all its windows and heavy chunks, and after how many of them each use of a shared chunk stands."""
        for batch in batches:
            coder, names, ids, at = _tokenizer(vocabulary.value), [], [], []
            for lo, hi, data, pieces in _pieces(batch, coder):
                used, first, last = referred(pieces, data)
                for row, (literal, places) in enumerate(_literals(pieces, used, first, last, coder, _spelling(vocabulary.value), heavy.value)):
                    names.append(named(pieces.raw[pieces.offsets[row] : pieces.offsets[row + 1]]))
                    done = digests and not places
                    ids.append(summary(literal.tobytes(), _spelling(vocabulary.value)) if done else packed(literal))
                    at.append(None if done else np.array(places, "<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.binary()), pa.array([-1] * len(names), pa.int64()), pa.array(ids, pa.binary()), pa.array(at, pa.binary())], ["doc_id", "name", "number", "ids", "at"])
        give_back()

    own = StructType([docs.schema["doc_id"]])
    part = StructType([*own, *StructType.fromDDL("name binary, number long, ids binary, at binary")])
    uses = StructType([*own, *StructType.fromDDL("name binary, number long, digest binary, first long, last long")])
    taken = docs.mapInArrow(references, uses).join(table, "digest").select("doc_id", "name", "number", "ids", "first", "last").mapInArrow(sliced, part)
    parts = docs.mapInArrow(windows, part).unionByName(taken)
    ordered = parts.repartition("doc_id", "name").sortWithinPartitions("doc_id", "name", "number")
    if not digests:
        return ordered.mapInArrow(_assembled, StructType([*own, *StructType.fromDDL("n_tokens long, ids binary")]))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _assembled(batches, lambda ids: summary(ids, _spelling(vocabulary.value))):
            n, *columns = zip(*(x.decode().split() for x in batch.column("ids").to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(int, n), pa.int64()), *(pa.array(c, pa.string()) for c in columns)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return ordered.mapInArrow(hashed, StructType([*own, *StructType.fromDDL("n_tokens long, ids_sha256 string, decoded_sha256 string")]))


def summary(ids: bytes, spelling: Spelling) -> bytes:
    """The number of ids, and the digests of them and of the text that they are decoded to."""
    decoded = spelling.decode(np.frombuffer(ids, "<u4"))
    return f"{len(ids) // 4} {hashlib.sha256(ids).hexdigest()} {hashlib.sha256(decoded).hexdigest()}".encode()


def cut_ids(coder: Spelling, ids: np.ndarray, first: int, last: int) -> np.ndarray:
    """The ids of a chunk's bytes from `first` to `last`, which are token boundaries of it."""
    ends = np.cumsum(coder.lengths[ids])
    a, b = (int(np.searchsorted(ends, x, "right")) for x in (first, last))
    if any(x != (ends[n - 1] if n else 0) for x, n in ((first, a), (last, b))):
        raise AssertionError("a chunk's encoding doesn't agree with the window beside it")
    return ids[a:b]


def _literals(pieces: Pieces, used: np.ndarray, first: np.ndarray, last: np.ndarray, coder: Tokenizer, spelling: Spelling, heavy: dict[bytes, bytes]) -> Iterator[tuple[np.ndarray, list[int]]]:
    """For each text the ids of its windows and heavy chunks on end, and the places of its other shared chunks among them."""
    pending: list[bytes] = []
    layout: list[list] = []  # of each text: a window's number in `pending`, ids that are known, or None for a shared chunk
    by_text = np.searchsorted(pieces.text[used], np.arange(len(pieces.offsets)))

    def window(a: int, b: int, into: list) -> None:
        if a == b:
            return
        if not pieces.specials:
            into.append(len(pending))
            pending.append(pieces.raw[a:b])
            return
        inner = pieces.bounds[(pieces.bounds > a) & (pieces.bounds < b)].tolist()
        for x, y in zip([a, *inner], [*inner, b], strict=True):
            if pieces.specials.get(x) == y:
                into.append(np.array([coder.special[pieces.raw[x:y]]], "<u4"))
            else:
                into.append(len(pending))
                pending.append(pieces.raw[x:y])

    for row in range(len(pieces.offsets) - 1):
        at, into = int(pieces.offsets[row]), []
        for k in range(by_text[row], by_text[row + 1]):
            u = used[k]
            window(at, int(first[k]), into)
            at = int(last[k])
            if pieces.digests[u] in heavy:
                into.append(cut_ids(spelling, unpacked(heavy[pieces.digests[u]]), int(first[k] - pieces.starts[u]), int(last[k] - pieces.starts[u])))
            else:
                into.append(None)
        window(at, int(pieces.offsets[row + 1]), into)
        layout.append(into)
    found = coder.encode(pending)
    for into in layout:
        literal, places, n = [], [], 0
        for x in into:
            if x is None:
                places.append(n)
                continue
            ids = found[x] if isinstance(x, int) else x
            literal.append(ids)
            n += len(ids)
        yield np.concatenate(literal) if literal else np.zeros(0, "<u4"), places


def _assembled(batches: Iterator[pa.RecordBatch], finish: Callable[[bytes], bytes] = bytes) -> Iterator[pa.RecordBatch]:
    """Documents from their rows in order of (doc_id, name, number); equal documents have each row as many times. `finish` is applied to the ids."""
    key, head, copies, parts, kind = None, (), 0, {}, None

    def whole() -> bytes:
        if head[1] is None:  # finished already
            return head[0]
        literal, at = unpacked(head[0]), np.frombuffer(head[1], "<i8").tolist()
        if len(at) != len(parts):
            raise AssertionError("a document's shared chunks aren't all there")
        ids, before = [], 0
        for k, place in enumerate(at):
            ids += [literal[before:place].tobytes(), unpacked(parts[k]).tobytes()]
            before = place
        return finish(b"".join([*ids, literal[before:].tobytes()]))

    def ready(docs: list, made: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(docs, kind), pa.array([len(x) // 4 for x in made], pa.int64()), pa.array(made, pa.binary())], ["doc_id", "n_tokens", "ids"])

    def rows() -> Iterator[tuple]:
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            yield from zip(*(batch.column(c).to_pylist() for c in ("doc_id", "name", "number", "ids", "at")), strict=True)
        yield None, None, 0, None, None  # after the last document

    docs, made, size = [], [], 0
    for doc, name, number, ids, at in rows():
        if (doc, name) != key:
            text = whole() if key else b""
            for _ in range(copies):
                docs.append(key[0])
                made.append(text)
                size += len(text) + 64
                if size > 1 << 21:
                    yield ready(docs, made)
                    docs, made, size = [], [], 0
            key, copies, parts = (doc, name), 0, {}
        if number < 0:
            head, copies = (ids, at), copies + 1
        else:
            parts[number] = ids
    if docs:
        yield ready(docs, made)
    give_back()


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """`encoded` with `decoded`, the text that its `ids` (as encode_documents has them) spell, special tokens included; null ids: null."""
    with open(tokenizer, "rb") as f:
        vocabulary = encoded.sparkSession.sparkContext.broadcast(f.read())
    kept = encoded.drop("decoded")
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coder = _spelling(vocabulary.value)
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [None if i is None else coder.decode(np.frombuffer(i, "<u4")) for i in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(texts, pa.binary()).cast(pa.string())], [*names, "decoded"])
        give_back()

    return kept.mapInArrow(run, widened(kept, "decoded string"))
