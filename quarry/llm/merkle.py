"""Operator 12: a Merkle manifest of a dataset, with a proof for every row, by superblocks.

Rows are leaves; those of a group, in order, are hashed FANOUT at a time until one node remains, the group's subroot; the subroots,
in order of their groups, likewise until the root remains. A run is FANOUT consecutive nodes, the last run of a level may be
shorter; a run of one is hashed too, but a lone node stays as it is.

Superblocks: the nodes of a group are cut into buckets of FANOUT**LEVELS by their numbers, and one applyInPandas collapses LEVELS
levels of a bucket. Bucket roots are nodes again, a 4,096th as many, and reduced in the same way: the number of rounds follows from the
largest group. On the way back a bucket gets the proof of its root, one row, puts its own lower proofs before it, and folds them there, so that proofs
are never shuffled row by row.

Numbers come from a range partitioning written to the shared folder: a row's place in its task, and the tasks' counts before it.
A hot group is spread over buckets like any other. No task holds more than a bucket, the driver one number.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

FANOUT, LEVELS = 8, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NODE = "grp string, place long, total long, hash string"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_hash(*values: Column) -> Column:
    """The hash of a row: every value as `-` if null, else its UTF-8 byte count, a colon and itself as text."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def depth(total: int, most: int = LEVELS, fanout: int = FANOUT) -> int:
    """Levels that a superblock of a level of `total` nodes collapses: all until one node remains, at most `most`."""
    n = 0
    while total > 1 and n < most:
        total, n = -(-total // fanout), n + 1
    return n


def collapse(nodes: list[str], levels: int, fanout: int = FANOUT) -> list[list[str]]:
    """All levels from the nodes up: every `fanout` consecutive ones become the hash of their concatenation."""
    out = [nodes]
    for _ in range(levels):
        nodes = [digest("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        out.append(nodes)
    return out


def siblings(tree: list[list[str]], place: int, fanout: int = FANOUT) -> list[tuple[str, str]]:
    """For each level below the top the digests of the run left and right of the node's."""
    out = []
    for nodes in tree[:-1]:
        run = place - place % fanout
        out.append(("".join(nodes[run:place]), "".join(nodes[place + 1 : run + fanout])))
        place //= fanout
    return out


def fold(leaf: str, proof: list[tuple[str, str]]) -> str:
    """The root that a leaf and its proof lead to."""
    for left, right in proof:
        leaf = digest(left + leaf + right)
    return leaf


def _pack(proof: list[tuple[str, str]]) -> str:
    return "/".join(f"{left},{right}" for left, right in proof)


def _unpack(packed: str) -> list[tuple[str, str]]:
    return [tuple(level.split(",")) for level in packed.split("/")] if packed else []


def numbered(df: DataFrame, group: str, *order: str) -> DataFrame:
    """`df` with each row's `place` from 0 in its group by the order, and the group's `total`. The group is a string without nulls.

    Equal rows are dealt by an arbitrary last key, so they don't crowd one task; which of them comes first doesn't matter. The cut
    fixes the tasks that the counts are made of.
    """
    kept = df.columns
    ranged = cut(df.withColumn("any_id", F.monotonically_increasing_id()).repartitionByRange(group, *(F.col(c).asc_nulls_first() for c in order), "any_id").sortWithinPartitions(group, *(F.col(c).asc_nulls_first() for c in order), "any_id").drop("any_id"))
    placed = ranged.withColumn("row_at", F.monotonically_increasing_id()).withColumn("task", F.shiftright("row_at", 33))
    counts = placed.groupBy("task", group).agg(F.min("row_at").alias("first_at"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("n").over(whole.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("task", group, (before - F.col("first_at")).alias("shift"), F.sum("n").over(whole).alias("total"))
    return placed.join(starts, ["task", group]).select(*kept, (F.col("row_at") + F.col("shift")).alias("place"), "total")


def _ascend(nodes: DataFrame, most: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of every round, from the given ones (grp, place, total, hash) up, and the one node left of each group; `most`: the largest total."""
    size = FANOUT**levels

    def reduce(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        grp, bucket, total = key
        top = collapse(rows.sort_values("place")["hash"].tolist(), depth(int(total), levels))[-1]
        return pd.DataFrame({"grp": [grp], "place": [int(bucket)], "total": [-(-int(total) // size)], "hash": top})

    rounds = []
    while True:
        nodes = nodes.withColumn("bucket", F.floor(F.col("place") / size).cast("long"))
        rounds.append(nodes)
        nodes, most = nodes.groupBy("grp", "bucket", "total").applyInPandas(reduce, _NODE), -(-most // size)
        if most <= 1:
            return rounds, cut(nodes)
        nodes = cut(nodes)


def _descend(rounds: list[DataFrame], top: DataFrame, leaves: DataFrame, proofs: bool, levels: int) -> DataFrame:
    """Down the rounds: every node's proof is its lower part within its bucket, then the bucket root's. top: (grp, proof, subroot, root)."""

    def extend(key: tuple, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        tree = collapse(rows["hash"].tolist(), depth(int(rows["total"].iloc[0]), levels) if len(rows) else 0)
        upper = above.iloc[0]
        lower = [siblings(tree, i) for i in range(len(rows))]
        packed = ["/".join(filter(None, [_pack(p), upper["proof"]])) for p in lower]
        return pd.DataFrame({"grp": rows["grp"], "bucket": rows["place"], "proof": packed, "subroot": upper["subroot"], "root": upper["root"]})

    def finish(key: tuple, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        tree = collapse(rows["hash"].tolist(), depth(int(rows["total"].iloc[0]), levels) if len(rows) else 0)
        upper = above.iloc[0]
        rest = _unpack(upper["proof"])
        paths = [siblings(tree, i) + rest for i in range(len(rows))]
        out = {"id": rows["id"], "leaf": rows["hash"], "subroot": upper["subroot"], "root": upper["root"], "proof_sha256": [digest("".join(a + b for a, b in p)) for p in paths], "folded_root": [fold(h, p) for h, p in zip(rows["claimed"], paths, strict=True)]}
        return pd.DataFrame(out | ({"proof": [[{"left": a, "right": b} for a, b in p] for p in paths]} if proofs else {}))

    above = top.withColumn("bucket", F.lit(0).cast("long"))
    for nodes in reversed(rounds[1:]):
        above = cut(nodes.groupBy("grp", "bucket").cogroup(above.groupBy("grp", "bucket")).applyInPandas(extend, "grp string, bucket long, proof string, subroot string, root string"))
    schema = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string" + (", proof array<struct<left:string,right:string>>" if proofs else "")
    return leaves.groupBy("grp", "bucket").cogroup(above.groupBy("grp", "bucket")).applyInPandas(finish, schema)


def merkle_manifest(rows: DataFrame, id: str = "doc_id", group: str = "lang", leaf: str = "leaf", claimed: str = "claimed", proofs: bool = True, levels: int = LEVELS) -> DataFrame:
    """One row for each of `rows`: (id, leaf, subroot, root, proof, proof_sha256, folded_root, verified).

    rows: an id, a group, the row's `leaf` digest, and `claimed`, the digest of what is to be verified against the manifest; other
    columns are ignored. Leaves of a group go by id (nulls first), then digest; equal ones are interchangeable. A null group is a group of its own, the first; groups go by the UTF-8 bytes
    of their text. `proof`, left out unless asked for, lists for each level the digests to the left and right, group levels after the
    row's; `proof_sha256` hashes them on end (a lone row's is the hash of nothing); `folded_root` is what `claimed` and the proof lead to;
    `verified` says whether that is the root. An empty table gives an empty one. A
    task holds FANOUT**`levels` nodes at a time; the result doesn't depend on it.
    """
    kind = rows.schema[id].dataType
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    slim = rows.select(key.alias("grp"), F.col(id).alias("id"), F.col(leaf).alias("hash"), F.col(claimed).alias("claimed"))
    leaves = numbered(slim, "grp", "id", "hash").withColumn("id", F.col("id").cast("string"))
    most = leaves.agg(F.max("total")).first()[0] or 0
    leaf_rounds, subroots = _ascend(leaves, most, levels)
    whole = numbered(subroots.select(F.lit("all").alias("one"), F.col("grp").alias("name"), F.col("hash").alias("node")), "one", "name")
    parts = whole.select(F.col("one").alias("grp"), "place", "total", F.col("node").alias("hash"), F.col("name").alias("id"), F.col("node").alias("claimed"))
    rounds, root = _ascend(parts, parts.agg(F.max("total")).first()[0] or 0, levels)
    top = root.select("grp", F.lit("").alias("proof"), F.lit("").alias("subroot"), F.col("hash").alias("root"))
    found = _descend(rounds, top, rounds[0], True, levels)
    packed = F.array_join(F.transform("proof", lambda p: F.concat(p["left"], F.lit(","), p["right"])), "/")
    upper = cut(found.select(F.col("id").alias("grp"), packed.alias("proof"), F.col("leaf").alias("subroot"), "root"))
    out = _descend(leaf_rounds, upper, leaf_rounds[0], proofs, levels)
    return out.withColumn("id", F.col("id").cast(kind)).withColumn("verified", F.col("folded_root") == F.col("root")).withColumnRenamed("id", id)


def document_leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """(doc_id, lang, leaf, claimed): the digests of documents, and of their copies with lower-cased A-Z in the text where `tampered` holds (not for null)."""
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.when(tampered, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    leaf = leaf_hash(*columns, F.col("text"))
    return docs.select("doc_id", "lang", leaf.alias("leaf"), F.when(changed == F.col("text"), leaf).otherwise(leaf_hash(*columns, changed)).alias("claimed"))
