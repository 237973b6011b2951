"""Operator 11: how each source's use of words differs from its language and from the language's other sources.

Terms are counted for every (lang, source) group; a lang keeps the terms that stand in at least LEAST_DOCS of its documents. A group or
lang gives each kept term p = 1 + floor(SCALE * (count + 2) / (N + 2 V)) and two of them differ at a term by f = floor((p - q)^2 / (p + q)),
in whole numbers throughout.

* Upper-bound term search (the terms that tell a group from its lang): a group's terms are put into buckets by count, LOG buckets an octave,
  at most 64 * LOG a group. Of a bucket are known its greatest p and the least q of its terms with p > q; f falls as q rises to p, so f of these
  two bounds every term of the bucket. Buckets are evaluated best first, in rounds for all groups at once, each round a batch of
  the next buckets FURTHER times as large as the last; a group stops once the bounds of all unseen buckets are strictly below its k-th value.
* Pairs by postings: a term's posting lists the sources of the lang that have it. For sources a, b of a lang the sum over all kept terms is
  sum over terms of a of f(p, b's p of an absent term), likewise of b, f of two absent ones for all others, and a correction at the terms
  that both have, from their postings. The first three need only how many terms of a group have each count. Sources are
  numbered and cut into tiles of TILE, terms into blocks; a task gets the postings of one block in one pair of tiles and returns sums, so
  that neither a term of all sources nor a lang of many is one group, and no pair of rows is ever emitted.

Counting is the only pass over texts: whole texts, in Arrow batches, tallied in the task before they are shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, give_back

TERMS = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LEAST_DOCS, SCALE, TOP = 10, 1_000_000_000, 10
#: Buckets of counts in an octave; entries tallied in a task before they are passed on; sources in a tile, kept terms in a block.
LOG, TALLY, TILE, BLOCK = 4, 1 << 18, 256, 4096
#: Terms that a group's first round of the search evaluates, and how many times as many each further one.
FIRST, FURTHER = 64 * TOP, 16


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs): occurrences and documents of each term, in parts."""

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in count.items():
            seen, names = docs[lang, source], list(terms)
            columns = [pa.array([value] * len(names), pa.string()) for value in (lang, source)]
            columns += [pa.array(names, pa.binary()).cast(pa.string()), pa.array(terms.values(), pa.int64()), pa.array(map(seen.__getitem__, names), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        count.clear(), docs.clear()

    count: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}
    since = 0
    for batch in batches:
        for text, lang, source in zip(batch.column("text").cast(pa.large_binary()), batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True):
            words = TERMS.findall(text.as_py().lower())  # bytes: only A-Z change
            count.setdefault((lang, source), Counter()).update(words)
            distinct = set(words)
            docs.setdefault((lang, source), Counter()).update(distinct)
            since += len(distinct)
            if since >= TALLY and sum(map(len, count.values())) >= TALLY:
                yield from flush()
                since = 0
    yield from flush()
    give_back()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) for all groups; nulls are ''."""
    texts = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")))
    return texts.mapInArrow(_tallied, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def scaled(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / total), exactly, for totals up to 9 * 10**15: SCALE a thousand at a time by long division."""
    rest, out = count + F.lit(2), F.lit(0).cast("long")
    whole, rest = F.call_function("div", rest, total), rest % total
    for _ in range(3):
        out, rest = out * F.lit(1000) + F.call_function("div", rest * F.lit(1000), total), rest * F.lit(1000) % total
    return whole * F.lit(SCALE) + out + F.lit(1)


def differs(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def scaled_np(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    out, rest = np.zeros(np.broadcast(count, total).shape, np.int64), count + 2
    whole, rest = rest // total, rest % total
    for _ in range(3):
        out, rest = out * 1000 + rest * 1000 // total, rest * 1000 % total
    return whole * SCALE + out + 1


def differs_np(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class Counts:
    """What both parts need: groups (lang, source, total, v), postings of kept terms (lang, source, term, n, q, total)."""

    def __init__(self, docs: DataFrame, least_docs: int = LEAST_DOCS):
        term = Window.partitionBy("lang", "term")  # a term's posting: at most a row a source
        first = F.row_number().over(term.orderBy("source")) == 1
        counted = term_counts(docs).select("lang", "source", "term", "n", F.sum("n").over(term).alias("lang_n"), F.sum("docs").over(term).alias("docs"), first.alias("first"))
        postings = cut(counted.filter(F.col("docs") >= least_docs).drop("docs"))
        langs = postings.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.col("first").cast("long")).alias("v"))
        totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("n"))
        seen = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
        groups = seen.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        v, n = F.coalesce("v", F.lit(0)), F.coalesce("n", F.lit(0))
        number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
        #: total: N + 2 V of the group, lang_total: of the lang; number: the source's in its lang.
        self.groups = cut(groups.select("lang", "source", (n + 2 * v).alias("total"), (F.coalesce("lang_total", F.lit(0)) + 2 * v).alias("lang_total"), v.alias("v"), number.cast("long").alias("number")))
        self.postings = postings


def leading_terms(counts: Counts, top: int = TOP, first: int = FIRST) -> DataFrame:
    """(lang, source, item, q, value, rank): of each group the `top` kept terms that it has more often than its lang, by f, then term."""
    info = counts.groups.select("lang", "source", "total", "lang_total")
    own = counts.postings.join(info, ["lang", "source"])
    q = scaled(F.col("lang_n"), F.col("lang_total"))
    bucket = F.floor(F.log2(F.col("n").cast("double")) * LOG).cast("int")
    terms = own.select("lang", "source", "term", scaled(F.col("n"), F.col("total")).alias("p"), q.alias("q"), bucket.alias("bucket")).filter("p > q")
    best = terms.groupBy("lang", "source", "bucket").agg(F.count(F.lit(1)).alias("terms"), F.max("p").alias("p"), F.min("q").alias("q"))
    best = best.select("lang", "source", "bucket", "terms", differs(F.col("p"), F.col("q")).alias("bound"))
    group = ["lang", "source"]
    order = Window.partitionBy(*group).orderBy(F.col("bound").desc(), "bucket")
    #: before: terms in buckets of higher bounds, at most 64 * LOG rows a group.
    best = cut(best.select("*", F.coalesce(F.sum("terms").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")))
    by_value = Window.partitionBy(*group).orderBy(F.col("value").desc(), F.col("term").asc())
    found, size, done = None, first, 0
    unseen = best.withColumn("kth", F.lit(-1).cast("long"))
    while True:
        batch = unseen.filter((F.col("before") < size) & (F.col("before") >= done) & (F.col("bound") >= F.col("kth")))
        evaluated = terms.join(batch.select(*group, "bucket"), [*group, "bucket"]).select(*group, "term", "q", differs(F.col("p"), F.col("q")).alias("value"))
        ranked = evaluated if found is None else evaluated.unionByName(found.select(*evaluated.columns))
        found = cut(ranked.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top))
        kth = found.filter(F.col("rank") == top).select(*group, F.col("value").alias("kth"))
        unseen = best.filter(F.col("before") >= size).join(kth, group, "left").withColumn("kth", F.coalesce("kth", F.lit(-1)))
        done, size = size, FURTHER * size
        if unseen.filter(F.col("bound") >= F.col("kth")).isEmpty():
            return found.select(*group, F.col("term").alias("item"), "q", "value", "rank")


def source_pairs(counts: Counts, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """(lang, source, item, value, rank): each group against each other source of its lang, f summed over all kept terms; all ranks."""
    groups = counts.groups.withColumn("tile", F.floor(F.col("number") / tile).cast("long"))
    histogram = groups.join(counts.postings.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("terms")), ["lang", "source"])
    parts = groups.groupBy("lang").agg((F.max("tile") + 1).alias("tiles"), F.max("v").alias("most")).join(histogram.groupBy("lang").agg(F.count(F.lit(1)).alias("h")), "lang", "left")
    parts = cut(parts.select("lang", "tiles", F.ceil(F.col("most") / block).cast("int").alias("blocks"), F.greatest(F.ceil(F.coalesce("h", F.lit(0)) / (tile * block)), F.lit(1)).cast("int").alias("shares")))
    # a row meets all tiles of its lang: in the task of its tile and another one, whichever ascends
    tasks = lambda rows, *columns: rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).select("lang", F.least("tile", "other").alias("ti"), F.greatest("tile", "other").alias("tj"), *columns)
    present = groups.select(*(F.col(c).alias(c) for c in groups.columns))  # columns of its own, as it meets rows made of `groups`
    present = present.join(parts, "lang").withColumn("block", F.explode(F.sequence(-F.col("shares"), F.col("blocks") - 1)))
    present = tasks(present, "block", "number", "tile", "total", "v")
    shared = tasks(histogram.join(parts, "lang"), (F.lit(-1) - F.pmod("n", "shares")).cast("int").alias("block"), "number", "n", "terms", F.lit("").alias("term"))
    entries = tasks(counts.postings.join(groups.select("lang", "source", "number", "tile"), ["lang", "source"]).join(parts, "lang"), F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), "number", "n", F.lit(1).cast("long").alias("terms"), "term")
    task = ["lang", "ti", "tj", "block"]
    sums = shared.unionByName(entries).groupBy(*task).cogroup(present.groupBy(*task)).applyInArrow(_tile_sums, "lang string, a long, b long, value long")
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    name = groups.select("lang", "number", "source")
    named = both.join(name.withColumnRenamed("number", "a"), ["lang", "a"]).join(name.select("lang", F.col("number").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc()))
    return named.select("lang", "source", "item", "value", rank.alias("rank"))


def _tile_sums(key: tuple[pa.Scalar, ...], rows: pa.Table, groups: pa.Table) -> pa.Table:
    """(lang, a, b, value) for a < b of two tiles: of negative blocks what follows from the groups' histograms, of others the corrections."""
    lang, ti, tj, block = (k.as_py() for k in key)
    order = np.argsort(groups.column("number").to_numpy())
    number, tile, total = (groups.column(name).to_numpy()[order] for name in ("number", "tile", "total"))
    v, n, terms = int(groups.column("v")[0].as_py()), rows.column("n").to_numpy(), rows.column("terms").to_numpy()
    which = np.searchsorted(number, rows.column("number").to_numpy())
    size, safe = len(number), np.maximum(total, 1)
    value = np.zeros((size, size), np.int64)
    absent = scaled_np(np.zeros(size, np.int64), safe)
    none = differs_np(absent[:, None], absent[None, :])
    p = scaled_np(n, safe[which])
    if v and block < 0:
        for at in range(0, len(n), 4096):  # a group's terms as if the other had none of them
            part = slice(at, at + 4096)
            np.add.at(value, which[part], terms[part, None] * (differs_np(p[part, None], absent[None, :]) - none[which[part]]))
        value = value + value.T + (v * none if block == -1 else 0)
    elif v and len(n):
        term = rows.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
        order = np.argsort(term, kind="stable")
        starts = np.flatnonzero(np.diff(term[order], prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(order)], strict=True):
            if b - a > 1:
                s, ps = which[order[a:b]], p[order[a:b]]
                cross = np.ix_(s, s)
                alone = differs_np(ps[:, None], absent[None, s])
                value[cross] += differs_np(ps[:, None], ps[None, :]) - alone - alone.T + none[cross]
    a, b = np.triu_indices(size, 1)
    kept = (tile[a] == ti) & (tile[b] == tj) & ((block < 0) | (value[a, b] != 0))
    a, b = a[kept], b[kept]
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": number[a], "b": number[b], "value": value[a, b]})


def divergence_audit(docs: DataFrame, top: int = TOP, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` from source_pairs, part `term` from leading_terms.

    `docs` has text, lang and source, nulls are ''; other columns are ignored, repeated rows count each. A lang without kept terms has pairs of
    value 0 and no terms, a lang of one source no pairs, an empty table no rows. Ties go by the UTF-8 bytes of the item.
    """
    counts = Counts(docs.select("text", "lang", "source"), least_docs)
    pairs = source_pairs(counts).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    return pairs.unionByName(leading_terms(counts, top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
