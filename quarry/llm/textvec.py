"""Vectorised text primitives over Arrow string buffers: words, word hashes, n-gram hashes.

All functions work on whole texts. A batch is cut into chunks of whole rows (about CHUNK bytes; a longer text is a chunk
of its own), which bounds scratch memory by the chunk or by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19

_rng = np.random.Generator(np.random.PCG64(20240521))
#: A random 64-bit value for each byte, and an odd base of the polynomial hash with its inverse modulo 2**64.
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_powers = {"n": 0, "up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def lookup(separators: str, lower: bool = True) -> np.ndarray:
    """A byte table: 0 for the separator bytes given, the byte itself (A-Z lower-cased) for others."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    table[0] = 255  # a NUL is an ordinary byte unless named below; no UTF-8 text has a byte 255
    for c in separators:
        table[ord(c)] = 0
    return table


#: Words are runs of anything but blanks: [^\x20\x09-\x0D]+, lower-cased.
BLANKS = lookup(" \t\n\v\f\r")
#: Words are runs of digits, letters and non-ASCII characters: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, lower-cased.
SYMBOLS = lookup("".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n at least, modulo 2**64."""
    if _powers["n"] < n:
        n = max(n, CHUNK + 1)
        for name, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
        _powers["n"] = n
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts on end, and the offsets of each; a null is an empty text."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] and texts.buffers()[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) for chunks of whole rows."""
    data, offsets = buffers(texts)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the index of its first word (one more entry at the end)."""
    inside = (table[data] != 0).view(np.int8)
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    start, end = inside.copy(), inside.copy()
    start[1:] &= 1 - inside[:-1]
    end[:-1] &= 1 - inside[1:]
    start[firsts] = inside[firsts]
    lasts = firsts[1:] - 1
    end[lasts] = inside[lasts]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Words of more bytes are hashed one by one, by a cryptographic hash.
LONG_WORD = 64
_SPREAD = np.uint64(0x9FB21C651E98DF25)
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word's normalised bytes, the same wherever the word stands.

    Eight bytes at a time are mixed into what came before, beginning with the length. (A polynomial modulo 2**64 would give equal values to
    whole families of long words, such as a Thue-Morse sequence of two letters and the same with the letters exchanged.)
    """
    own = np.zeros(len(data) + 8, np.uint8)
    own[: len(data)] = table[data]
    eight = np.ndarray(len(data) + 1, "<u8", own, strides=(1,))
    lengths = ends - starts
    out = mix((lengths.astype(np.uint64) + np.uint64(1)) * _SPREAD)
    which, at = np.flatnonzero((lengths > 0) & (lengths <= LONG_WORD)), 0
    while len(which):
        left = lengths[which] - at
        out[which] = mix((out[which] ^ (eight[starts[which] + at] & _TAIL[np.minimum(left, 8)])) * _SPREAD)
        which, at = which[left > 8], at + 8
    for i in np.flatnonzero(lengths > LONG_WORD).tolist():
        out[i] = int.from_bytes(blake2b(own[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def row_of(first: np.ndarray, n: int) -> np.ndarray:
    """The row that each of n items belongs to, from the index of each row's first item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first)) if n else np.zeros(0, np.int64)
