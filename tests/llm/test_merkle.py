"""The manifest against a plain tree, tampering, several rounds of superblocks, awkward rows."""

from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from quarry.llm.merkle import collapse, depth, document_leaves, fold, merkle_manifest, siblings

from .conftest import AWKWARD

H = lambda s: sha256(s.encode()).hexdigest()
field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def plain(rows):
    """rows: (doc_id, source, lang, n_chars, text); the manifest by climbing from every leaf."""
    leaf = lambda r, t: H("".join(map(field, (*r[:4], t))))
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    climb = lambda nodes: [nodes] if len(nodes) < 2 else [nodes, *climb([H("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)])]
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: climb([y[2] for y in sorted(by_lang[x], key=lambda y: y[:3])]) for x in langs}
    top = climb([trees[x][-1][0] for x in langs])
    out = []
    for number, x in enumerate(langs):
        for place, (_, _, own, r) in enumerate(sorted(by_lang[x], key=lambda y: y[:3])):
            said = r[4] if r[4] is None or r[0] is None or crc32(str(r[0]).encode()) % 3 else lower(r[4])
            h, proof = leaf(r, said), ""
            for tree, at in ((trees[x], place), (top, number)):
                for nodes in tree[:-1]:
                    run = nodes[at - at % 8 : at - at % 8 + 8]
                    left, right = "".join(run[: at % 8]), "".join(run[at % 8 + 1 :])
                    h, proof, at = H(left + h + right), proof + left + right, at // 8
            out.append((r[0], own, trees[x][-1][0], top[-1][0], H(proof), h, h == top[-1][0]))
    return sorted(out, key=str)


def found(df, levels):
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    got = merkle_manifest(document_leaves(df, tampered), levels=levels)
    rows = got.collect()
    for r in rows:
        pairs = [(p["left"], p["right"]) for p in r["proof"]]
        assert fold(r["leaf"], pairs) == r["root"] and H("".join(a + b for a, b in pairs)) == r["proof_sha256"]
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in rows), key=str)


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_equals_plain_tree(make, levels):
    rows = [(i, f"Text {i} É", None if i % 7 == 0 else "aé-b"[i % 4] if i % 3 else "en", f"s{i % 3}" if i % 5 else None) for i in range(700)]
    rows += [(i, f"Lone {i}", f"l{i}", "s") for i in range(1000, 1030)]
    df = make(rows)
    want = plain([(i, s, lang, len(t), t) for i, t, lang, s in rows])
    assert found(df, levels) == want
    assert any(not r[6] for r in want) and any(r[6] for r in want)


def test_awkward_rows_and_empty_tables(make):
    rows = [(i, t, None, None) for i, t in AWKWARD] * 2 + [(None, None, "", "")]
    want = plain([(i, s, lang, len(t or ""), t) for i, t, lang, s in rows])
    assert found(make(rows), 1) == want
    assert found(make([]), 4) == []
    one = make([(5, "A", "x", None)])
    assert found(one, 4) == plain([(5, None, "x", 1, "A")])


def test_tree_of_any_size():
    for n in (1, 2, 8, 9, 64, 65, 513):
        leaves = [H(str(i)) for i in range(n)]
        tree = collapse(leaves, depth(n, 99))
        assert len(tree[-1]) == 1 and all(fold(leaves[i], siblings(tree, i)) == tree[-1][0] for i in range(n))
        assert n == 1 or fold(H("other"), siblings(tree, 0)) != tree[-1][0]
