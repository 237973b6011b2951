"""Operator 7: document fingerprints by quartile bucket digests.

A digest counts hashed byte triplets in BUCKETS buckets, and encodes for each bucket in which quartile of all buckets its count
lies (two bits), and the text's length on a log scale. Two digests differ by the sum over buckets of the quartiles' distance
(0, 1, 2 and, for the far ends, 6) plus a bounded length difference; likeness is 1 less that share of what unlike texts differ by.

Scale: a digest needs its own text only (Arrow batches, numpy, no shuffle). `with_next` brings each document together with its
successor by one range partitioning of the texts; the first row of each range is copied to the range before it. Ranges are cut by
bytes, from a sample of keys; a key is the id and the beginning of the text, so that one id on very many rows is cut too.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, below, map_arrow, widened
from .textvec import chunks

BUCKETS = 256
#: Bytes of text in a range; sampled keys for each range, and in all (the driver's share); characters of text in a key.
PART_BYTES, KEYS_A_PART, MOST_KEYS, BEGINNING = 1 << 24, 40, 1_000_000, 64
#: Sum of quartile distances at which likeness is 0. Digests of unrelated texts differ by about BUCKETS on average.
UNLIKE = 1.25 * BUCKETS
#: Most that the lengths may add to the difference, and what each step of the log scale adds.
LENGTH_MOST, LENGTH_STEP = 64, 4
#: Offsets of the bytes that join the newest byte in a triplet, in a window of five.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
_rng = np.random.Generator(np.random.PCG64(7))
_tables = np.stack([[_rng.permutation(256).astype(np.uint8) for _ in range(3)] for _ in TRIPLETS])
_distance = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]], np.float64)


def digest(data: np.ndarray) -> bytes:
    """The digest of a text's bytes: one byte of length, then BUCKETS / 4 of quartiles. Equal texts have equal digests."""
    counts = np.zeros(BUCKETS, np.int64)
    for (a, b), (x, y, z) in zip(TRIPLETS, _tables, strict=True):
        if len(data) > b:
            counts += np.bincount(x[data[b:]] ^ y[data[b - a : -a]] ^ z[data[:-b]], minlength=BUCKETS)
    q1, q2, q3 = np.partition(counts, (BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1))[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    length = min(255, int(np.log(max(1, len(data))) / np.log(1.1)))
    return bytes([length]) + packed.astype(np.uint8).tobytes()


def _codes(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(digests), np.uint8).reshape(len(digests), 1 + BUCKETS // 4)
    return raw[:, 0].astype(np.int64), np.stack([raw[:, 1:] >> s & 3 for s in (0, 2, 4, 6)], 2).reshape(len(digests), BUCKETS)


def likeness(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """0 to 1 for each pair of digests; 1 for equal ones."""
    if not left:
        return np.zeros(0)
    (m, a), (n, b) = _codes(left), _codes(right)
    difference = _distance[a, b].sum(1) + np.minimum(LENGTH_MOST, LENGTH_STEP * np.maximum(0, abs(m - n) - 1))
    return np.maximum(0.0, 1 - difference / UNLIKE)


def fingerprints(docs: DataFrame, column: str = "text") -> DataFrame:
    """`docs` with a `fingerprint` (lowercase hex) of each whole text added. A null is an empty text; texts under five bytes
    have the digest of what triplets they hold, an empty one that of none. No shuffle."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [digest(data[a:b]).hex() for _, _, data, at in chunks(batch.column(column)) for a, b in zip(at[:-1], at[1:], strict=True)]
        keep = [n for n in batch.schema.names if n != "fingerprint"]
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(found, pa.string())], [*keep, "fingerprint"])

    kept = docs.drop("fingerprint")
    return map_arrow(kept, each, widened(kept, "fingerprint string"))


class Ranges:
    """Ranges of keys (0, id, beginning of the text), or (1, beginning) for null ids, which come last; ids of any ordered type."""

    def __init__(self, sample: list[tuple[tuple, int]], parts: int):
        sample = sorted(sample)
        upto = np.cumsum([size + 1 for _, size in sample])
        places = np.searchsorted(upto, [upto[-1] * k / parts for k in range(1, parts)]) if len(sample) else []
        self.bounds = sorted({sample[p][0] for p in places})
        ids = [b[1] for b in self.bounds if b[0] == 0]
        self.ids = np.array(ids, np.int64) if all(type(i) is int for i in ids) else None

    def of(self, keys: pa.RecordBatch) -> np.ndarray:
        """The range of each (id, beginning): the first whose bound isn't below it."""
        ids = keys.column("id")
        if self.ids is None or not pa.types.is_integer(ids.type):
            return np.array([bisect_left(self.bounds, k) for k in key_list(keys)], np.int64)
        values = ids.cast(pa.int64()).fill_null(0).to_numpy()
        out, upper = np.searchsorted(self.ids, values), np.searchsorted(self.ids, values, "right")
        for i in np.flatnonzero((out != upper) | ids.is_null().to_numpy(zero_copy_only=False)).tolist():
            out[i] = bisect_left(self.bounds, key_list(keys.slice(i, 1))[0])
        return out


def key_list(keys: pa.RecordBatch) -> list[tuple]:
    return [(1, t) if i is None else (0, i, t) for i, t in zip(keys.column("id").to_pylist(), keys.column("beginning").to_pylist(), strict=True)]


def with_next(docs: DataFrame, order: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """(id, text, is_copy, part), dealt and sorted so that each row's successor follows it within its part.

    Ascending `order` of any type that Python and Spark sort alike (numbers, strings, dates), nulls last; rows of equal ids stand in the
    order of their texts. Each part ends with a copy (is_copy) of the row that comes after it, that of the last part being the first row of all.
    """
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(order).alias("id"), F.col(text).alias("text"))
    keyed = rows.withColumn("beginning", F.coalesce(F.substring("text", 1, BEGINNING), F.lit("")))
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-size // part_bytes), min(context.defaultParallelism, size >> 20))
    chosen = keyed.filter(below(min(MOST_KEYS, KEYS_A_PART * parts) / max(1, n), 41, "id", "beginning")) if parts > 1 else keyed.limit(0)
    sample = chosen.select("id", "beginning", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).collect()
    ranges = Ranges([(((1, r["beginning"]) if r["id"] is None else (0, r["id"], r["beginning"])), r["size"]) for r in sample], parts)

    def parts_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("beginning"), pa.array(ranges.of(batch), pa.int32())], ["id", "beginning", "part"])

    kind = rows.schema["id"].dataType.simpleString()
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "beginning")).alias("key")
    firsts = sorted(map_arrow(keyed.select("id", "beginning"), parts_of, f"id {kind}, beginning string, part int").groupBy("part").agg(least).collect(), key=lambda r: r["part"])
    # of each part's first key, the part before
    heads = {((1, r["key"]["beginning"]) if r["key"]["none"] else (0, r["key"]["id"], r["key"]["beginning"])): firsts[i - 1]["part"] for i, r in enumerate(firsts)}
    starts = sorted(heads)

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        part = ranges.of(batch)
        first, to = [], []
        for i, k in enumerate(key_list(batch)):
            p = bisect_right(starts, k) - 1
            if p >= 0 and starts[p] == k:
                first.append(i)
                to.append(heads[k])
        taken = pa.array(np.concatenate([np.arange(len(part)), np.array(first, np.int64)]))
        part, copy = np.concatenate([part, np.array(to, np.int64)]), np.repeat([0, 1], [len(part), len(first)])
        return pa.RecordBatch.from_arrays([batch.column("id").take(taken), batch.column("text").take(taken), pa.array(part, pa.int32()), pa.array(copy, pa.int32())], ["id", "text", "part", "is_copy"])

    dealt = map_arrow(keyed, deal, f"id {kind}, text string, part int, is_copy int")
    return dealt.repartitionById(len(ranges.bounds) + 1, "part").sortWithinPartitions("part", "is_copy", F.col("id").isNull(), "id", "text")


def edited(text: str, following: str) -> str:
    """`text` with its last floor(n/4) code points replaced by the first as many (or all) of `following`."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def compare_with_next(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_chars, edited_text, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of (doc_id, text).

    Nulls are empty texts; a single row is its own successor; ids may be of any ordered type, null ids come last; of equal ids the
    texts decide; an empty table gives no rows. Other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        held = None  # (part, id, text, digest) that waits for its successor; the first copy only is a successor
        done_part = None

        def flush(rows):
            if not rows:
                return None
            changed = [edited(t, n) for _, t, _, n, _ in rows]
            raw = [x.encode("utf-8", "surrogatepass") for x in changed]
            after = [digest(np.frombuffer(x, np.uint8)) for x in raw]
            own, following = [r[2] for r in rows], [r[4] for r in rows]
            columns = [pa.array([r[0] for r in rows]), pa.array([len(r[1]) for r in rows], pa.int64()), pa.array(changed, pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in raw]), pa.array([d.hex() for d in own]), pa.array([d.hex() for d in after]), pa.array(likeness(own, after)), pa.array(likeness(own, following))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_text", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch, out = whole.slice(at, BATCH_ROWS), []
                texts = batch.column("text").fill_null("")
                for i, t, part, is_copy in zip(batch.column("id").to_pylist(), texts.to_pylist(), batch.column("part").to_pylist(), batch.column("is_copy").to_pylist(), strict=True):
                    if is_copy and done_part == part:
                        continue
                    own = digest(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8))
                    if held is not None and held[0] == part:
                        out.append((held[1], held[2], held[3], t, own))
                    held = None if is_copy else (part, i, t, own)
                    done_part = part if is_copy else done_part
                if (made := flush(out)) is not None:
                    yield made.cast(pa.schema([made.schema.field(0).with_type(batch.schema.field("id").type), *list(made.schema)[1:]]))

    schema = f"doc_id {kind.simpleString()}, n_chars long, edited_text string, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, part_bytes=part_bytes).mapInArrow(run, schema)
