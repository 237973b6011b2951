"""Encoding by reused chunks against the library on whole texts, and decoding back."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from quarry.llm import bpe
from quarry.llm.bpe import Tokenizer, cuts, cut_ids, decode_documents, encode_documents, firm, packed, unpacked

from .conftest import AWKWARD

PATH = public_tokenizers.path("byte_bpe_50k.json")
library = Library.from_file(PATH)
library.no_truncation()
library.no_padding()
expected = lambda t: library.encode(t or "", add_special_tokens=False).ids


def found(df):
    rows = decode_documents(encode_documents(df, PATH), PATH).collect()
    return sorted(((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), r["n_tokens"], r["decoded"]) for r in rows), key=str)


def wanted(rows):
    return sorted(((r[0], expected(r[1]), len(expected(r[1])), library.decode(expected(r[1]), skip_special_tokens=False)) for r in rows), key=str)


ALPHABETS = ["ab '", "'srtveml d!", " \n\t\xa0x", "é日本語 。a1", "éßÀ×÷ŉſǅɐʰ\u0301 a'.1", "0123456789 ٣½a", "<|endoftext|> x", "aaaa", "🙂👍‍ a'", "\x00\x01\x7f -"]


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_places_where_the_pretokenizer_always_cuts(data):
    """Cutting a text at any firm places and encoding the parts alone gives the whole's ids."""
    coder = bpe._tokenizer(open(PATH, "rb").read())
    text = "".join(data.draw(st.lists(st.sampled_from([c for a in ALPHABETS for c in a] + ["'re", "'ll", "it's", "  ", "<|", "|>", "word"]), max_size=60)))
    text = text.replace("<|endoftext|>", "")
    raw = np.frombuffer(text.encode(), np.uint8)
    places = firm(raw, np.array([0, len(raw)])).tolist()
    chosen = sorted({0, len(raw), *data.draw(st.lists(st.sampled_from(places)))})
    parts = [text.encode()[a:b] for a, b in zip(chosen, chosen[1:])]
    assert [int(i) for x in coder.encode(parts) for i in x] == expected(text)


def corpus(seed, n):
    rng = random.Random(seed)
    say = lambda k: "".join(rng.choice(rng.choice(ALPHABETS)) for _ in range(k))
    passages = [say(rng.randint(200, 2000)) for _ in range(12)] + ["x" * 9000, "日本語" * 1500, "'" * 3000, " " * 5000, "a" * 70 + " b" * 400]
    texts = ["".join(rng.choice(passages) if rng.random() < 0.6 else say(rng.randint(0, 300)) for _ in range(rng.randint(0, 6))) for _ in range(n)]
    return [(i, t) for i, t in enumerate(texts)] + [(n + i, texts[0]) for i in range(40)]


@pytest.mark.parametrize("few", [16, 1, 10**9])
def test_equals_the_library(spark, make, few, monkeypatch):
    """With heavy chunks, with nearly all heavy, with none."""
    monkeypatch.setattr(bpe, "FEW", few)
    monkeypatch.setattr(bpe, "HEAVY", 10**9 if few == 1 else 4096)
    rows = corpus(few % 97, 120)
    assert found(make(rows).repartition(5)) == wanted(rows)


def test_awkward_rows_and_empty_tables(make):
    rows = AWKWARD * 2 + [(20, "<|endoftext|>"), (21, "a<|endoftext|><|endoftext|> b"), (22, "<|endoftext|" * 40), (23, "<|endo"), (24, "ftext|>"), (None, "<|endoftext|>x" * 300), (None, "<|endoftext|>x" * 300)]
    assert found(make(rows)) == wanted(rows)
    assert found(make([])) == []
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = sorted(map(tuple, encode_documents(make(rows), PATH, digests=True).collect()), key=str)
    assert got == sorted(((i, n, sha(np.array(ids, "<u4").tobytes()), sha(text.encode())) for i, ids, n, text in wanted(rows)), key=str)


def test_chunks_are_the_same_wherever_a_passage_stands():
    rng = np.random.default_rng(3)
    passage = rng.integers(32, 127, 20_000, dtype=np.uint8)
    ends = set()
    for head in (0, 1, 77, 5000):
        data = np.concatenate([rng.integers(32, 127, head, dtype=np.uint8), passage])
        at = cuts(data, np.array([0, len(data)])) - head
        assert (np.diff(at) <= bpe.MOST).all()
        ends.add(tuple(at[at > 300].tolist()))
    assert len(ends) == 1
    both = np.concatenate([passage, passage[:900]])
    alone, beside = cuts(passage, np.array([0, len(passage)])), cuts(both, np.array([0, len(passage), len(both)]))
    assert beside[beside <= len(passage)].tolist() == alone.tolist()


@given(st.lists(st.integers(0, 2**32 - 1)))
def test_packed(ids):
    assert unpacked(packed(np.array(ids, "<u4"))).tolist() == ids


def test_disagreement_is_an_error():
    ids, coder = bpe._tokenizer(open(PATH, "rb").read()).encode([b"word count"])[0], bpe._spelling(open(PATH, "rb").read())
    assert cut_ids(coder, ids, 0, 4).tolist() == expected("word")
    with pytest.raises(AssertionError):
        cut_ids(coder, ids, 2, 10)


def test_refuses_tokenizers_that_cut_otherwise():
    with pytest.raises(ValueError):
        Tokenizer(open(public_tokenizers.path("word_bpe_49k.json"), "rb").read())


def test_decoding_beyond_the_vocabulary(spark):
    coder = bpe._spelling(open(PATH, "rb").read())
    for ids in ([50256, 1, 60000], [127, 128, 255, 198], [], list(range(0, 50257, 97))):
        assert coder.decode(np.array(ids, "<u4")).decode() == library.decode(ids, skip_special_tokens=False)
    df = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert decode_documents(df, PATH).first()["decoded"] is None
