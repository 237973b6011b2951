"""Operator 5: mixing sources to target weights by Sainte-Lague apportionment. DataFrame functions only.

A corpus of T words is mixed into `shards` shards of equal-token blocks. Targets: the words that each source should give, by
weight, never above `max_epochs` times its own words; what a capped source can't take is shared out again by weight.
Quotas: each shard's blocks go to the sources with the highest quotients target / (2k + 1). Selection: a source's documents stand in a
seeded order, which is cut into blocks of equal words; as many blocks are selected as all shards' quotas ask for, going round the
order again where they exceed the source. Every `shards` blocks in turn go to one shard each, by a seeded rotation: each shard gets
its quota.

Scale: texts are read once, to count words; the (id, source, size, order) rows are cut. Sums go by (source, bucket of
the seeded order), so that a source with a third of all rows is spread over its buckets, each of which is ordered by itself. Plans over
sources hold a row for each source. `mix_documents` shuffles no text: what it takes of a document follows from the document's own
place in the order and the row at which its source's selection ends.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

#: Rows up to which a plan (of sources, or of their buckets) is broadcast: some 100 bytes each.
BROADCAST_ROWS = 100_000


def word_count(text: Column) -> Column:
    """Number of runs of [^\\x20\\x09-\\x0D]; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """Adds `weight` and `target` to (source, source_size): one row for each source.

    Sources by code point, null last, weigh `weights`, repeating. Targets share the sum of all sizes; a target stops at
    `max_epochs` times its source's size and the excess goes to the others by weight until none is above. In closed form: by
    rising cap/weight the capped sources come first; the first one whose cap isn't below what is left, by weight, and all after
    it get that share.
    """
    by_name, by_cap = W.orderBy(F.col("source").isNull(), "source"), W.orderBy("ratio", F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    caps = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("ratio", F.col("cap") / F.col("weight"))
    before, everything = by_cap.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = caps.withColumn("level", level).withColumn("open", F.col("ratio") >= F.col("level"))
    share = F.min(F.when(F.col("open"), F.struct("ratio", F.col("source").isNull().alias("null_last"), "source", "level"))).over(everything)["level"]
    return levels.withColumn("share", share).select("source", "source_size", "weight", F.when(F.col("share").isNull() | (F.col("ratio") < F.col("share")), F.col("cap")).otherwise(F.col("weight") * F.col("share")).alias("target"))


def source_quotas(targets: DataFrame, shards: int, blocks: int) -> DataFrame:
    """Adds `block_tokens`, `quota` (blocks a shard) and `quota_tokens` (words in all shards) to the targets.

    Sainte-Lague with m sources gives source i between share_i * (n - m/2) - 1/2 and share_i * (n + m/2) + 1/2 of a shard's
    n blocks, so quotients between these bounds alone are ranked: m + 3 for each unit of share, whatever n is. Ties go to
    the source first by code point. A source of target 0 gets none.
    """
    everything = W.partitionBy()
    total = F.sum("source_size").over(everything)
    sized = targets.withColumn("total", total).withColumn("m", F.count(F.lit(1)).over(everything))
    sized = sized.withColumn("block_tokens", F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(float(shards * blocks)))).cast("long"))
    sized = sized.withColumn("n", F.round(F.col("total") / (F.col("block_tokens") * shards)).cast("long")).withColumn("part", F.when(F.col("total") > 0, F.col("target") / F.col("total")).otherwise(0.0))
    least = F.greatest(F.lit(0), F.floor(F.col("part") * (F.col("n") - F.col("m") / 2) - 0.5)).cast("long")
    most = F.ceil(F.col("part") * (F.col("n") + F.col("m") / 2) + 0.5).cast("long")
    sized = sized.withColumn("least", F.when(F.col("target") > 0, least).otherwise(0)).withColumn("most", F.when(F.col("target") > 0, most).otherwise(0))
    sized = sized.withColumn("open_seats", F.col("n") - F.sum("least").over(everything))
    quotients = sized.filter("most > least").select("source", "open_seats", "target", F.explode(F.sequence(F.col("least"), F.col("most") - 1)).alias("k"))
    order = W.orderBy((F.col("target") / (2 * F.col("k") + 1)).desc(), F.col("source").isNull(), "source", "k")
    won = quotients.withColumn("seat", F.row_number().over(order)).filter("seat <= open_seats").groupBy(F.col("source").alias("won_source")).agg(F.count(F.lit(1)).alias("won"))
    quotas = sized.join(won, F.col("source").eqNullSafe(F.col("won_source")), "left").withColumn("quota", F.col("least") + F.coalesce("won", F.lit(0)))
    return quotas.select("source", "source_size", "weight", "target", "block_tokens", "quota", (F.col("quota") * F.col("block_tokens") * shards).alias("quota_tokens"))


def _size_and_rank(docs: DataFrame, seed: str) -> tuple[Column, Column]:
    named = F.concat(F.lit(seed + ":"), F.coalesce(docs["doc_id"].cast("string"), F.lit("null")))
    return word_count(docs["text"]), F.md5(named.cast("binary"))


def _placed(docs: DataFrame, weights: tuple[int, ...], max_epochs: int, shards: int, blocks: int, seed: str) -> tuple[DataFrame, DataFrame, bool]:
    """A row for each of docs with its place (`start`) in its source's seeded order, cut; the plan of sources, cut; whether it is small."""
    size, rank = _size_and_rank(docs, seed)
    rows = cut(docs.select("doc_id", "source", size.alias("size"), rank.alias("rank")))
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    largest, n_sources = per_source.agg(F.max("n_rows"), F.count(F.lit(1))).first()
    # about as many buckets as rows in each, for the largest source: neither grows faster than the root of the rows
    digits = max(1, round(math.log((largest or 1) ** 0.5, 16)))
    plan = source_quotas(source_targets(per_source.select("source", "source_size"), weights, max_epochs), shards, blocks)
    take = F.least(F.col("quota_tokens"), F.col("source_size") * max_epochs)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(take / F.col("source_size"))).otherwise(0).cast("long"))
    plan = cut(plan.withColumn("rest", (take - F.col("epochs") * F.col("source_size")).cast("long")))
    rows = rows.withColumn("bucket", F.substring("rank", 1, digits))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)).alias("before"))
    small = n_sources <= BROADCAST_ROWS
    buckets = sums.join(F.broadcast(plan) if small else plan, F.col("b_source").eqNullSafe(F.col("source"))).drop("source")
    each = rows.join(F.broadcast(buckets) if n_sources * 16**digits <= BROADCAST_ROWS else buckets, rows.source.eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
    within = W.partitionBy("source", "bucket").orderBy("rank", F.col("doc_id").isNull(), "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    return each.withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0))), plan, small


def _part() -> Column:
    """Words taken of a placed row in the round of the order that isn't whole."""
    return F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start"))).cast("long")


def _shard(block: Column, shards: int, seed: str) -> Column:
    """The shard of a source's block: among `shards` blocks in turn each shard has one, by a seeded rotation."""
    turn = F.md5(F.concat(F.lit(seed + "/"), F.coalesce("source", F.lit("null")), F.lit("/"), F.floor(block / shards).cast("string")).cast("binary"))
    return F.pmod(block + F.conv(F.substring(turn, 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, shards: int = 16, blocks: int = 65_536, seed: str = "mix-1") -> DataFrame:
    """For each row of (doc_id, text, source, ...): doc_id, size, source, source_size, target, quota_tokens, taken, first_token, block_tokens, first_block, first_shard.

    `taken` is the number of words that the mix takes, repeats counted; `first_token` the place of the document in its
    source's seeded order, in words; `first_block` and `first_shard` where its first taken word goes, null if none is taken (all pieces:
    `shard_blocks`). Nulls: a null text has size 0 and is never taken; a null source is a source of its own; null ids
    are ordered last. Rows alike in id and size are interchangeable. An empty table gives no rows. Other columns of `docs` are
    ignored, whatever their names.
    """
    placed = _placed(docs, weights, max_epochs, shards, blocks, seed)[0]
    taken = (F.col("epochs") * F.col("size") + _part()).cast("long")
    mixed = placed.withColumn("taken", taken).withColumn("first_block", F.when(F.col("taken") > 0, F.floor(F.col("start") / F.col("block_tokens")).cast("long")))
    mixed = mixed.withColumn("first_shard", F.when(F.col("taken") > 0, _shard(F.col("first_block"), shards, seed)))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "quota_tokens", "taken", F.col("start").alias("first_token"), "block_tokens", "first_block", "first_shard")


def shard_blocks(mixed: DataFrame, shards: int = 16, seed: str = "mix-1") -> DataFrame:
    """The mix itself, from `mix_sources` with the same `shards` and `seed`: (shard, source, block, doc_id, round, first, words), a row for
    each piece of a document in a block: `words` words from its `first` (from 0) on, in the `round`-th going through the source.

    Blocks are numbered from 0 within their source, over all rounds. A row that isn't taken gives none.
    """
    rounds = F.sequence(F.lit(0).cast("long"), F.floor((F.col("taken") - 1) / F.col("size")).cast("long"))
    each = mixed.filter("taken > 0").withColumn("round", F.explode(rounds))
    each = each.withColumn("from", F.col("round") * F.col("source_size") + F.col("first_token"))
    each = each.withColumn("to", F.col("from") + F.least(F.col("size"), F.col("taken") - F.col("round") * F.col("size")))
    number = F.sequence(F.floor(F.col("from") / F.col("block_tokens")).cast("long"), F.floor((F.col("to") - 1) / F.col("block_tokens")).cast("long"))
    pieces = each.withColumn("block", F.explode(number))
    start = F.greatest(F.col("from"), F.col("block") * F.col("block_tokens"))
    end = F.least(F.col("to"), (F.col("block") + 1) * F.col("block_tokens"))
    return pieces.select(_shard(F.col("block"), shards, seed).alias("shard"), "source", "block", "doc_id", "round", (start - F.col("from")).alias("first"), (end - start).alias("words"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, shards: int = 16, blocks: int = 65_536, seed: str = "mix-1") -> DataFrame:
    """`docs`, all columns and rows, with `taken` and `n_words` (its size) in place of any of these names; as `mix_sources` takes them.

    Rows alike in id, source and size where a source's selection ends share what is taken of them evenly, rounded down.
    """
    placed, plan, small = _placed(docs, weights, max_epochs, shards, blocks, seed)
    key = lambda rank, size: F.struct(rank.alias("rank"), docs["doc_id"].isNull().alias("none"), docs["doc_id"].alias("id"), size.alias("size"))
    own = placed.select("source", F.struct("rank", F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "size").alias("key"), "size", "start", "rest").filter("size > 0")
    own = cut(own.withColumn("part", _part()))
    edges = own.filter("part < size").groupBy("source").agg(F.min("key").alias("edge")).withColumnRenamed("source", "e_source")
    at = own.join(F.broadcast(edges) if small else edges, F.col("source").eqNullSafe(F.col("e_source")) & F.col("key").eqNullSafe(F.col("edge")))
    at = at.groupBy("e_source", "edge").agg(F.floor(F.sum("part") / F.count(F.lit(1))).cast("long").alias("at_edge"))
    plan = plan.select(F.col("source").alias("p_source"), F.col("epochs").alias("p_epochs")).join(at, F.col("p_source").eqNullSafe(F.col("e_source")), "left")
    plan = plan.select("p_source", "p_epochs", F.col("edge").alias("p_edge"), F.col("at_edge").alias("p_at_edge"))
    size, rank = _size_and_rank(docs, seed)
    keep = [n for n in docs.columns if n not in ("taken", "n_words")]
    mark = docs.select(*(docs[n] for n in keep), size.alias("p_size"), key(rank, size).alias("p_key"))
    mark = mark.join(F.broadcast(plan) if small else plan, F.col("source").eqNullSafe(F.col("p_source")), "left")
    last = F.when(F.col("p_edge").isNull() | (F.col("p_key") < F.col("p_edge")), F.col("p_size")).when(F.col("p_key").eqNullSafe(F.col("p_edge")), F.col("p_at_edge")).otherwise(0)
    return mark.select(*keep, (F.col("p_epochs") * F.col("p_size") + last).cast("long").alias("taken"), F.col("p_size").alias("n_words"))
