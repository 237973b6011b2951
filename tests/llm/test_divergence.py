"""The audit against a plain count over all terms and pairs; small tiles and blocks, ties, awkward rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm.divergence import Counts, divergence_audit, leading_terms, scaled, scaled_np, source_pairs

from .conftest import AWKWARD

WORDS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def plain(rows, top=10, least=10):
    """rows: (text, lang, source)."""
    by_lang = defaultdict(list)
    for text, lang, source in rows:
        by_lang[lang or ""].append((source or "", WORDS.findall(lower(text))))
    out = []
    for lang, docs in by_lang.items():
        seen = Counter(w for _, ws in docs for w in set(ws))
        kept = sorted((w for w in seen if seen[w] >= least), key=str.encode)
        counts = defaultdict(Counter)
        for source, ws in docs:
            counts[source].update(w for w in ws if seen[w] >= least)
        whole = sum(counts.values(), Counter())
        p = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (c.total() + 2 * len(kept)) for w in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        q = p(whole)
        ps = {s: p(counts[s]) for s in counts}
        for s in counts:
            pairs = [(o, sum(f(ps[s][w], ps[o][w]) for w in kept)) for o in counts if o != s]
            terms = [(w, f(ps[s][w], q[w])) for w in kept if counts[s][w] and ps[s][w] > q[w]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, rank) for rank, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def corpus(n, seed, words=60, sources=7):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}é" for a in "abcdefghij" for b in "uvwxyz"][:words]
    rows = []
    for i in range(n):
        lang, source = rng.choice(["en", "de", None]), rng.choice([None, *map(str, range(sources))])
        pool = vocabulary[len(str(source)) :: 1 + int(source or 0) % 3]
        rows.append((i, " ".join(rng.choice(pool).title() for _ in range(rng.randint(0, 30))), lang, source))
    return rows


@pytest.mark.parametrize(("tile", "block", "first"), [(256, 4096, 40), (2, 3, 1), (3, 1, 5)])
def test_equals_plain_count(make, tile, block, first):
    rows = corpus(260, tile)
    counts = Counts(make(rows))
    pairs = source_pairs(counts, tile, block).select("lang", "source", F.lit("pair"), "item", "value", "rank")
    terms = leading_terms(counts, 10, first).select("lang", "source", F.lit("term"), "item", "value", "rank")
    assert sorted(map(tuple, pairs.unionByName(terms.withColumnRenamed("term", "pair")).collect())) == plain([r[1:] for r in rows])


def test_ties_across_buckets(make):
    """Many terms of equal value: the first ten by bytes; sources without terms take part in pairs."""
    rows = [(i, " ".join(f"w{chr(97 + k)}{'é' if k % 2 else ''}" for k in range(26)), "en", "a") for i in range(12)]
    rows += [(100 + i, "other words stand here", "en", "b") for i in range(11)] + [(200, "!!", "en", "c"), (201, None, "xx", "c"), (202, "x", "xx", "d")]
    assert sorted(map(tuple, divergence_audit(make(rows)).collect())) == plain([r[1:] for r in rows])


def test_awkward_rows_and_empty_tables(make):
    rows = [(i, t, None, None) for i, t in AWKWARD] * 10 + [(None, "twice over", "", "s")]
    assert sorted(map(tuple, divergence_audit(make(rows)).collect())) == plain([r[1:] for r in rows])
    assert divergence_audit(make([])).collect() == []


def test_scaled_is_exact(spark):
    values = [(c, t) for t in (1, 7, 10**9, 8_999_999_999_999_999) for c in {0, 1, t // 3, max(0, t - 2)}]
    got = spark.createDataFrame(values, "c long, t long").select(scaled(F.col("c"), F.col("t"))).collect()
    want = [1 + 10**9 * (c + 2) // t for c, t in values]
    assert [r[0] for r in got] == want
    assert scaled_np(np.array([c for c, _ in values]), np.array([t for _, t in values])).tolist() == want
