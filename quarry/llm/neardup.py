"""Operator 9: MinHash near-duplicates by an inverted join of signature coordinates, confirmed on full sets.

1. Each text gives its set of word shingles (64-bit hashes) and a signature of COORDINATES minima. Texts of equal sets are one node.
2. Nodes are posted under their coordinate-value pairs. A pair of nodes at the wanted similarity shares at least `matches`
   coordinates (but for a chance of MISS, from the binomial law), so it meets under one of the (COORDINATES - matches + 1) rarest
   values of both: only this prefix is posted, and values that one node alone has are skipped.
3. In each posting list collisions are counted over whole signatures; nodes with enough of them are merged into families.
   A list of over BLOCK nodes is merged whole: families may be too large, never too small.
4. A family of over BLOCK nodes is narrowed first: its nodes are posted under shingles, the family's common ones last, each under so
   many that linked nodes must share one. What stays together is a smaller family; this goes on as long as families get smaller.
5. Links are confirmed within families on full sets, by counting common shingles. A family that stays over BLOCK nodes is cut into
   blocks by distance to its most central node, and pairs of blocks are compared; Jaccard distance being a metric, blocks whose
   distances to the centre differ by more than a link can span are passed over, as are two blocks that are linked to the centre.
6. Components of the confirmed links, by star contraction.

Scale: texts are read twice and never shuffled. Exact copies cost a row each. Signatures are shuffled as (value, node) rows; sets
only of nodes in families. No pairs are emitted: each worker returns a spanning forest of what it confirmed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import KeyFilter, connected_components, cut, give_back, map_arrow
from .textvec import BLANKS, chunks, mix, word_hashes, words

COORDINATES = 32
MISS = 1e-6
BLOCK = 512
#: A shingle of one node in so many of its family is common there.
COMMON = 16
#: Nodes in families up to which their families are broadcast (16 bytes each).
BROADCAST_NODES = 1_000_000
_rng = np.random.Generator(np.random.PCG64(99))
_times = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_plus = _rng.integers(0, 1 << 63, 64, dtype=np.uint64)


def least_matches(similarity: float, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The most coordinates that may be asked of a pair at `similarity`, so that it fails with a chance of `miss` at most."""
    below = 0.0
    for k in range(coordinates + 1):
        below += comb(coordinates, k) * similarity**k * (1 - similarity) ** (coordinates - k)
        if below > miss:
            return max(1, k)
    return coordinates


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts of a chunk, sorted within each text, and where each text's begin.

    A text of fewer words than `size`, but not none, has its whole sequence as its one shingle.
    """
    starts, ends, first = words(data, offsets, BLANKS)
    h = word_hashes(data, starts, ends, BLANKS)
    counts = np.diff(first)
    kinds = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    begin = np.concatenate([[0], np.cumsum(kinds)])
    x = np.empty(begin[-1], np.uint64)
    full = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        full += h[k : k + len(full)] * _times[k]
    full = mix(full)
    for r in np.flatnonzero(kinds):
        a, own = first[r], x[begin[r] : begin[r + 1]]
        if counts[r] >= size:
            own[:] = full[a : a + kinds[r]]
            own.sort()
        else:
            own[:] = mix((h[a : a + counts[r]] * _times[: counts[r]]).sum(keepdims=True) + np.uint64(counts[r]))
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    new[begin[:-1][kinds > 0]] = True
    return x[new], np.concatenate([[0], np.cumsum(new)])[begin]


def sketches(docs: DataFrame, size: int, coordinates: int = COORDINATES) -> DataFrame:
    """doc_id, rkey, node, check, n, sig: a row for each row of (doc_id, text). Empty sets have a null node."""
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rkey"))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, node, check, sig = [], [], [], []
        for lo, hi, data, at in chunks(batch.column("text")):
            x, first = shingle_sets(data, at, size)
            counts = np.diff(first)
            some = np.flatnonzero(counts)
            n.append(counts)
            a, b, s = np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64), np.zeros((hi - lo, coordinates), np.uint64)
            if len(some):
                at_ = first[some]
                a[some] = mix(np.add.reduceat(mix(x ^ np.uint64(0x1234567)), at_) + counts[some].astype(np.uint64))
                b[some] = np.add.reduceat(mix(x ^ np.uint64(0x7654321)), at_)
                for j in range(coordinates):
                    s[some, j] = mix(np.minimum.reduceat((x ^ _plus[j]) * _times[j], at_) + np.uint64(j))
            node.append(a), check.append(b), sig.append(s)
        n = np.concatenate(n)
        flat = np.concatenate(sig).view(np.int64).ravel()
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * coordinates, pa.int32()), pa.array(flat))
        columns = [batch.column("doc_id"), batch.column("rkey"), pa.array(np.concatenate(node).view(np.int64), mask=n == 0), pa.array(np.concatenate(check).view(np.int64)), pa.array(n, pa.int64()), lists]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "rkey", "node", "check", "n", "sig"])

    return map_arrow(rows, each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, rkey long, node long, check long, n long, sig array<long>")


def grouped(df: DataFrame, key: str, each: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """`each` over all rows of a key at once; a partition's keys follow one another, and one key is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b == a:
                    continue
                if held and keys[a] != last and (out := each(pa.Table.from_batches(held))) is not None:
                    yield out
                if keys[a] != last:
                    held = []
                held.append(batch.slice(a, b - a))
                last = keys[a]
        if held and (out := each(pa.Table.from_batches(held))) is not None:
            yield out
        give_back()

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, key).sortWithinPartitions(key).mapInArrow(run, schema)


def forest(linked: Callable[[int], np.ndarray], n: int) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of n nodes, given the neighbours of each; every node is asked for once."""
    fresh = np.ones(n, bool)
    for root in range(n):
        if not fresh[root]:
            continue
        fresh[root], queue = False, [root]
        while queue:
            at = queue.pop()
            found = np.flatnonzero(linked(at) & fresh)
            fresh[found] = False
            queue += found.tolist()
            yield from ((at, int(f)) for f in found)


def edges_of(pairs: Iterator[tuple[int, int]], nodes: np.ndarray) -> pa.RecordBatch | None:
    found = np.array(list(pairs), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(nodes[found[:, 0]]), pa.array(nodes[found[:, 1]])], ["u", "v"]) if len(found) else None


def common_shingles(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections of the sets: incidence of the shingles that several sets have, multiplied in slices."""
    n, owner = len(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.append(True, flat[1:] != flat[:-1])
    number = np.cumsum(new) - 1
    several = np.bincount(number)[number] > 1
    number = np.cumsum(new & several)[several] - 1
    owner, out = owner[several], np.zeros((n, n), np.float32)
    for at in range(0, (number[-1] + 1) if len(number) else 0, columns):
        a, b = np.searchsorted(number, (at, at + columns))
        x = np.zeros((n, columns), np.float32)
        x[owner[a:b], number[a:b] - at] = 1
        out += x @ x.T
    return out


def confirmed(table: pa.Table, percent: int) -> pa.RecordBatch | None:
    """A spanning forest of the confirmed links among the (node, set) rows of a table; repeats of a node count once."""
    nodes, at = np.unique(table.column("node").to_numpy(), return_index=True)
    if len(nodes) < 2:
        return None
    lists = table.column("shingles").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat, cuts = lists.values.to_numpy(), lists.offsets.to_numpy()
    sets = [flat[cuts[i] : cuts[i + 1]] for i in at]
    both, sizes = common_shingles(sets), np.array([len(s) for s in sets])
    return edges_of(forest(lambda i: 100 * both[i].astype(np.int64) >= percent * (sizes[i] + sizes - both[i].astype(np.int64)), len(nodes)), nodes)


def candidate_families(reps: DataFrame, matches: int, coordinates: int = COORDINATES) -> tuple[DataFrame, DataFrame]:
    """(node, component) of nodes whose signatures collide often enough, and (node, central): how common a node's values are."""
    prefix = coordinates - matches + 1
    posted = reps.select("node", F.explode("sig").alias("value"))
    # cut, here and below, so that a join deals both of its sides anew: adaptive execution can then split a frequent value
    often = cut(posted.groupBy("value").agg(F.count(F.lit(1)).alias("often")).filter("often > 1"))
    shared = posted.join(often, "value").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("often", "value"))).alias("values"))
    # values that this node alone has come first in its prefix, and needn't be posted
    shared = shared.withColumn("left", F.lit(prefix - coordinates) + F.size("values")).filter("left > 0")
    shared = cut(shared.select("node", F.slice("values", F.lit(1), F.col("left")).alias("values"), F.aggregate("values", F.lit(0).cast("long"), lambda s, x: s + x["often"]).alias("central")))
    lists = shared.select("node", F.explode("values").alias("x")).select("node", "x.value", "x.often")
    sizes = cut(lists.groupBy("value").agg(F.count(F.lit(1)).alias("posted"), F.min("node").alias("least")).filter("posted > 1"))
    lists = lists.select("node", "value").join(sizes, "value")
    whole = lists.filter(F.col("posted") > BLOCK).select(F.col("node").alias("u"), F.col("least").alias("v"))
    signed = lists.filter(F.col("posted") <= BLOCK).select("node", "value").join(reps.select("node", "sig"), "node")

    def each(table: pa.Table) -> pa.RecordBatch | None:
        nodes = table.column("node").to_numpy()
        lists_ = table.column("sig").combine_chunks()
        lists_ = lists_.chunk(0) if isinstance(lists_, pa.ChunkedArray) else lists_
        sig = lists_.flatten().to_numpy().reshape(len(nodes), -1)
        return edges_of(forest(lambda i: (sig == sig[i]).sum(1) >= matches, len(nodes)), nodes)

    edges = grouped(signed, "value", each, "u long, v long").unionByName(whole)
    return connected_components(edges), shared.select("node", "central")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, rkey, n_shingles, component_id, kept for each row of (doc_id, text).

    Documents whose shingle sets have 100 * intersection >= percent * union are linked; component_id is the smallest
    doc_id reachable. A null, empty or blank text has an empty set, is linked with nothing and keeps its own id. A null id
    gets its component's smallest id, or null; repeated rows share their component. An empty table gives no rows. Other columns
    are ignored. `rkey` is a hash of id and text.
    """
    matches = least_matches(percent / 100)
    rows = cut(sketches(docs, shingle))
    reps = cut(rows.filter("node is not null").groupBy("node", "check").agg(F.min("rkey").alias("rkey"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"), F.first("n").alias("n")))
    families, central = candidate_families(reps.select("node", "sig"), matches)
    families = cut(families.withColumnRenamed("component", "family"))
    suspects = families.join(reps.select("node", "rkey", "n"), "node")
    wanted = KeyFilter(suspects.select("rkey"))
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        maybe = np.flatnonzero(shared.value(batch.column("rkey").to_numpy()))
        if not len(maybe):
            return None
        found, keys = [], batch.column("rkey").take(pa.array(maybe))
        for _, _, data, at in chunks(batch.column("text").take(pa.array(maybe))):
            x, first = shingle_sets(data, at, shingle)
            found += [x[a:b].view(np.int64) for a, b in zip(first[:-1], first[1:], strict=True)]
        return pa.RecordBatch.from_arrays([keys, pa.array(found, pa.list_(pa.int64()))], ["rkey", "shingles"])

    texts = docs.select("text", F.xxhash64("doc_id", "text").alias("rkey"))
    n_suspects = suspects.count()
    small = F.broadcast if n_suspects <= BROADCAST_NODES else (lambda df: df)
    counts = families.groupBy("family").agg(F.count(F.lit(1)).alias("members"))
    members = small(suspects.join(counts, "family").select("rkey", "node", "family", "members"))
    full = map_arrow(texts, sets, "rkey long, shingles array<long>").join(members, "rkey").drop("rkey")
    large = counts.filter(F.col("members") > BLOCK)
    if large.isEmpty():
        links = grouped(full, "family", lambda t: confirmed(t, percent), "u long, v long")
    else:
        full = narrowed(cut(full), percent)
        links = grouped(full.filter(F.col("members") <= BLOCK), "family", lambda t: confirmed(t, percent), "u long, v long")
        rest = cut(full.filter(F.col("members") > BLOCK))
        if not rest.isEmpty():
            links = links.unionByName(large_family_links(rest, central, percent))
    joined = connected_components(links)
    classes = reps.join(joined, "node", "left").select("node", "copies", "least", F.coalesce("component", "node").alias("component"))
    classes = cut(classes)  # so that the join below deals both of its sides anew, and a large component can be split
    ends = classes.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("copies").alias("size")).filter("size > 1")
    ends = cut(ends)
    labels = classes.join(ends, "component").select("node", "component_id")
    out = rows.select("doc_id", "rkey", "node", "n").join(labels, "node", "left")
    own = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "rkey", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def narrowed(full: DataFrame, percent: int) -> DataFrame:
    """(node, family, shingles, members) with families of over BLOCK nodes cut down to what shared shingles can link; nodes alone go.

    Of n shingles two linked sets share so many that they meet in the first n - ceil(percent * n / 100) + 1 of each, in any one order.
    In the order taken a family's common shingles (those of one node in COMMON at least) come last.
    """
    done = full.filter(F.col("members") <= BLOCK)
    left = full.filter(F.col("members") > BLOCK).dropDuplicates(["node"])
    while True:
        left = cut(left)
        before = left.groupBy("family").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if before is None:
            return done
        counts = left.select("family", "members", F.explode("shingles").alias("shingle")).groupBy("family", "shingle").agg(F.count(F.lit(1)).alias("often"), F.first("members").alias("members"))
        common = counts.filter(F.col("often") * COMMON >= F.col("members")).groupBy("family").agg(F.sort_array(F.collect_list(F.struct("often", "shingle")))["shingle"].alias("common"))
        common = cut(common)  # at most COMMON times as many as a set of the family has on average
        few = (common.agg(F.sum(F.size("common"))).first()[0] or 0) <= BROADCAST_NODES
        rare = F.sort_array(F.array_except("shingles", F.coalesce("common", F.array().cast("array<bigint>"))))
        last = F.array_intersect(F.coalesce("common", F.array().cast("array<bigint>")), "shingles")
        n = F.size("shingles")
        first = F.slice(F.concat(rare, last), F.lit(1), n - F.floor((n * percent + 99) / 100).cast("int") + 1)
        posted = cut(left.join(F.broadcast(common) if few else common, "family", "left").select("family", "node", F.explode(first).alias("shingle")))
        lists = cut(posted.groupBy("family", "shingle").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
        parts = connected_components(posted.join(lists, ["family", "shingle"]).select(F.col("node").alias("u"), F.col("least").alias("v")))
        parts = cut(parts.withColumnRenamed("component", "part"))
        sizes = cut(parts.groupBy("part").agg(F.count(F.lit(1)).alias("size")))
        left = cut(left.join(parts, "node").join(sizes, "part").select("node", F.col("part").alias("family"), "shingles", F.col("size").alias("members")))
        done = done.select("node", "family", "shingles", "members").unionByName(left.filter(F.col("members") <= BLOCK))
        left = left.filter(F.col("members") > BLOCK)
        if (left.agg(F.max("members")).first()[0] or 0) >= before:
            return done.unionByName(left)


def large_family_links(full: DataFrame, central: DataFrame, percent: int) -> DataFrame:
    """Spanning links (u, v) of families of over BLOCK nodes, from (node, family, shingles): step 4 of the module's account."""
    reach = 1 - percent / 100
    full = full.dropDuplicates(["node"])
    hubs = full.join(central, "node").groupBy("family").agg(F.max_by(F.struct("node", "shingles"), F.struct("central", "node")).alias("hub"))
    # one set for each family of over BLOCK nodes: at most a share 1/BLOCK of the nodes' sets; cut, so that a join can split a family
    hubs = cut(hubs)
    few = (hubs.agg(F.sum(F.size("hub.shingles"))).first()[0] or 0) <= BROADCAST_NODES
    both = F.size(F.array_intersect("shingles", "hub.shingles"))
    away = 1 - both / (F.size("shingles") + F.size("hub.shingles") - both)
    placed = full.join(F.broadcast(hubs) if few else hubs, "family").select("family", "node", "shingles", F.col("hub.node").alias("hub"), away.alias("away"), (100 * both >= percent * (F.size("shingles") + F.size("hub.shingles") - both)).alias("near"))
    placed = cut(placed.withColumn("ring", F.floor(F.col("away") * 200).cast("int")))
    rings = placed.groupBy("family", "ring").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.partitionBy("family").orderBy("ring").rowsBetween(W.unboundedPreceding, W.currentRow))
    rings = rings.withColumn("shell", F.floor((upto - 1) / BLOCK)).withColumn("cuts", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n")
    rings = cut(rings)  # some 200 rows a family at most
    dealt = placed.join(F.broadcast(rings) if rings.count() <= BROADCAST_NODES else rings, ["family", "ring"]).withColumn("block", F.xxhash64("family", "shell", F.when(F.col("cuts") > 1, F.col("ring")), F.pmod(F.xxhash64("node"), F.col("cuts"))))
    dealt = cut(dealt.select("family", "node", "shingles", "hub", "away", "near", "block"))
    blocks = dealt.groupBy("family", "block").agg(F.min("away").alias("from"), F.max("away").alias("to"), F.min("near").alias("near"))
    a, b = blocks.alias("a"), blocks.alias("b")
    close = (F.col("a.from") - F.col("b.to") <= reach + 1e-9) & (F.col("b.from") - F.col("a.to") <= reach + 1e-9) & ~(F.col("a.near") & F.col("b.near"))
    pairs = a.join(b, (F.col("a.family") == F.col("b.family")) & (F.col("a.block") <= F.col("b.block")) & close)
    pairs = pairs.select(F.xxhash64("a.block", "b.block").alias("pair"), F.array_distinct(F.array("a.block", "b.block")).alias("both"))
    sides = pairs.select("pair", F.explode("both").alias("block"))
    compared = grouped(dealt.select("block", "node", "shingles").join(sides, "block"), "pair", lambda t: confirmed(t, percent), "u long, v long")
    return compared.unionByName(dealt.filter("near").select(F.col("node").alias("u"), F.col("hub").alias("v")))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """`docs` without near-duplicates: of each component the row of the smallest id stays, once if it is repeated; rows without
    shingles all stay."""
    found = cut(near_duplicates(docs, shingle, percent).select("rkey", "kept", (F.col("n_shingles") > 0).alias("full")))
    drop = found.filter(~F.col("kept")).select("rkey").distinct()
    again = found.filter("kept and full").groupBy("rkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("rkey", F.lit(True).alias("again"))
    touched = cut(drop.withColumn("again", F.lit(False)).unionByName(again))
    shared = docs.sparkSession.sparkContext.broadcast(KeyFilter(touched.select("rkey")))
    columns = docs.columns

    def clear(batch: pa.RecordBatch, inside: bool) -> pa.RecordBatch:
        return batch.filter(pa.array(shared.value(batch.column("rkey").to_numpy()) == inside)).select([*columns, "rkey"] if inside else columns)

    keyed = docs.withColumn("rkey", F.xxhash64("doc_id", "text"))
    sure = map_arrow(keyed, lambda b: clear(b, False), docs.schema)
    rest = map_arrow(keyed, lambda b: clear(b, True), keyed.schema).join(touched, "rkey", "left")
    once = rest.filter("again").dropDuplicates(["rkey"])
    return sure.unionByName(rest.filter("again is null").select(*columns)).unionByName(once.select(*columns))
