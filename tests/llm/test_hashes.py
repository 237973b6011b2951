"""Words and passages that a polynomial modulo 2**64 can't tell apart: Thue-Morse sequences and their complements."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from quarry.llm.decontaminate import match_benchmark
from quarry.llm.neardup import near_duplicates
from quarry.llm.suffixdedup import remove_repeats
from quarry.llm.textvec import BLANKS, SYMBOLS, word_hashes, words
from quarry.llm.tokencount import count_tokens


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[i.bit_count() % 2] for i in range(n))


def hashes(text, table=BLANKS):
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = words(data, np.array([0, len(data)]), table)
    return word_hashes(data, starts, ends, table).tolist()


@pytest.mark.parametrize("size", [8, 63, 64, 65, 512, 1024, 4096])
def test_words_differ(size):
    a, b = thue_morse(size), thue_morse(size, "b", "a")
    assert len(set(hashes(f"{a} {b} {a} x{b} {a.upper()}"))) == 3
    assert len({h for x, y in itertools.permutations(",<ab!", 2) for h in hashes(thue_morse(size, x, y))}) == 20


@given(st.lists(st.text(st.sampled_from("abcdefghé\x000"), min_size=1, max_size=80), min_size=1, max_size=30))
def test_equal_words_have_equal_hashes_and_others_not(ws):
    found = hashes(" ".join(ws))
    assert [(x == y) for x in found for y in found] == [(x == y) for x in ws for y in ws]


@pytest.mark.parametrize("size", [512, 1024, 4096])
def test_operators_tell_them_apart(make, spark, size):
    a, b = thue_morse(size), thue_morse(size, "b", "a")
    rows = [(1, a), (2, b), (3, f"{a} {b}"), (4, b)]
    got = {r["doc_id"]: r for r in match_benchmark(make(rows), spark.createDataFrame([("A", a), ("AB", f"{a} {b}")], "item_id string, text string")).collect()}
    assert {k: (r["n_hit"], list(r["items"])) for k, r in got.items()} == {1: (1, ["A"]), 2: (0, []), 3: (2, ["A", "AB"]), 4: (0, [])}
    linked = {r["doc_id"]: r["component_id"] for r in near_duplicates(make(rows), shingle=3, percent=85).collect()}
    assert linked == {1: 1, 2: 2, 3: 3, 4: 2}
    tokens = {r["doc_id"]: r["n_tokens"] for r in count_tokens(make(rows)).collect()}
    alone = count_tokens(make([(2, b)])).first()["n_tokens"]
    assert tokens[2] == tokens[4] == alone and tokens[3] == tokens[1] + alone


def brute(texts, length=400):
    raw = [t.encode() for t in texts]
    seen = {}
    for k, t in enumerate(raw):
        for i in range(len(t) - length + 1):
            seen.setdefault(t[i : i + length], []).append((k, i))
    gone = [set() for _ in raw]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                gone[k].update(range(i, i + length))
    return [bytes(c for i, c in enumerate(t) if i not in gone[k]) for k, t in enumerate(raw)]


@pytest.mark.parametrize("size", [512, 1024, 4096])
def test_repeats_of_their_bytes(make, size):
    a, b, rng = thue_morse(size), thue_morse(size, "b", "a"), random.Random(size)
    say = lambda n: "".join(rng.choice("cdefgh ") for _ in range(n))
    head, tail = say(150), say(150)
    texts = [head + a + tail, head + b + tail, say(300) + a[:450], b[:450] + say(200), thue_morse(size, ",", "<"), thue_morse(size, "<", ",")]
    got = {r["doc_id"]: bytes(r["kept"]) for r in remove_repeats(make(list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_passages_of_such_words(make):
    """51 words in Thue-Morse order and its complement: no passage is common."""
    a, b = (" ".join(thue_morse(64, x, y)) for x, y in (("p", "q"), ("q", "p")))
    got = {r["doc_id"]: r["passages"] for r in remove_repeats(make([(1, a), (2, b), (3, a)])).collect()}
    assert sum(s["b"] - s["a"] for s in got[1]) == sum(s["b"] - s["a"] for s in got[3]) == 64
    ws = {i: t.split() for i, t in ((1, a), (2, b), (3, a))}
    windows = {i: {tuple(w[k : k + 51]) for k in range(len(w) - 50)} for i, w in ws.items()}
    assert bool(got[2]) == bool(windows[2] & windows[1])
    assert hashes("é É", SYMBOLS)[0] != hashes("é É", SYMBOLS)[1]
