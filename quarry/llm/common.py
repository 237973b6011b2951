"""What the operators of this package share: cutting lineage, bounded samples, Arrow maps."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows in an Arrow batch; a worker holds one batch at a time, so its memory is about this many texts.
BATCH_ROWS = 1000
_BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the cluster's own; where none is set and all runs in one process (tests), a temporary one.

    A cluster without `spark.checkpoint.dir` is refused: its machines share no folder that could be chosen here.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quarry-"))
    return context.getCheckpointDir()


def bound_batches(spark: SparkSession) -> None:
    """For applications: holds the session's Arrow batches at BATCH_ROWS, unless its owner has chosen a size. No operator does so itself."""
    if spark.conf.get(_BATCHES) == "10000":
        spark.conf.set(_BATCHES, str(BATCH_ROWS))


def cut(df: DataFrame) -> DataFrame:
    """`df`, written once to the shared checkpoint folder. Survives lost executors, unlike a local checkpoint.

    Plans that nothing refers to any more are let go first: a long job's driver would gather them otherwise.
    """
    checkpoint_dir(df.sparkSession)
    gc.collect()
    give_back()
    return df.checkpoint()


def map_arrow(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """mapInArrow over slices of at most `rows` rows, so that a worker's scratch memory doesn't follow Spark's batch size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                if (out := each(batch.slice(at, rows))) is not None:
                    yield out
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns freed memory to the system: Python workers live on between stages, and what they keep adds up."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of an id written as text; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def below(fraction: float, seed: int, *columns: str) -> Column:
    """A predicate true for about `fraction` of the rows: the same rows in every run."""
    size = 1 << 30
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(size)) < F.lit(int(min(1.0, fraction) * size))


def widened(df: DataFrame, ddl: str) -> StructType:
    """`df`'s schema with the columns of `ddl` added; the frame's own schema object stays as it is."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


class KeyFilter:
    """A bitmap of the low bits of many 64-bit keys, of bounded size (at most MOST_BITS): to pass over rows that surely don't matter.

    It lets all keys through that it was made of, and some others; an exact join has to follow. Built by partial
    aggregation in the cluster; the driver gets the bitmap alone.
    """

    MOST_BITS = 1 << 27

    def __init__(self, keys: DataFrame):
        column, page = keys.columns[0], 1 << 15
        wanted = 16 * max(1, keys.count())
        self.bits = min(self.MOST_BITS, max(page, 1 << (wanted - 1).bit_length()))
        place = F.pmod(F.col(column), F.lit(self.bits))
        pages = keys.filter(F.col(column).isNotNull()).select(F.floor(place / page).cast("long").alias("page"), (place % page).alias("bit"))
        raw = np.zeros(self.bits // 8, np.uint8)
        for r in pages.groupBy("page").agg(F.bitmap_construct_agg("bit").alias("map")).collect():
            raw[r["page"] * page // 8 : (r["page"] + 1) * page // 8] = np.frombuffer(r["map"], np.uint8)
        self.raw = raw

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Which of the int64 keys may be among those that the filter was made of."""
        place = keys & np.int64(self.bits - 1)
        return (self.raw[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


#: Edges up to which one task finds the components (16 bytes each), rather than rounds of joins.
SMALL_EDGES = 1 << 20


def _components_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all edges of one task: roots are hooked on smaller ones and paths halved until nothing changes."""
    seen = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    nodes, ends = np.unique(np.concatenate([x for pair in seen for x in pair] or [np.zeros(0, np.int64)]), return_inverse=True)
    cuts = np.cumsum([0, *(len(x) for pair in seen for x in pair)])
    u, v = (np.concatenate([ends[cuts[k] : cuts[k + 1]] for k in range(side, 2 * len(seen), 2)] or [ends]) for side in (0, 1))
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], least)
        np.minimum.at(new, label[v], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "component"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of the (u, v) edges; component is the smallest node reachable.

    Up to SMALL_EDGES edges go to one task. More take alternating large-star and small-star steps, each cut, until nothing changes:
    logarithmically many rounds for the usual graph and as many as it takes for any, no state on the driver but a count and a checksum. Joins are equi-joins on nodes, whose skew
    adaptive execution can split.
    """
    edges = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if edges.count() <= SMALL_EDGES:
        return edges.repartition(1).mapInArrow(_components_of, "node long, component long")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(lowest.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            break
        seen = now
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
