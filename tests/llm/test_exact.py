"""Operators with exact results: against brute force, on awkward rows, and on empty tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import common as shared_parts
from quarry.llm.common import checkpoint_dir, connected_components
from quarry.llm.chat import MARKS, chat_digests, escape, format_chats, unescape
from quarry.llm.decontaminate import match_benchmark, remove_matches
from quarry.llm.fingerprint import compare_with_next, edited, fingerprints
from quarry.llm.mixing import mix_documents, mix_sources, shard_blocks
from quarry.llm.neardup import keep_one, least_matches, near_duplicates
from quarry.llm.oracle import ORACLE
from quarry.llm.queries import QUERIES
from quarry.llm.suffixdedup import common, deep_shallow, remove_repeats, repeated_offsets

from quarry.llm.tokencount import MARK, Trie, Unigram, count_tokens, _model

from .conftest import AWKWARD

SYMBOLS, BLANKS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"), re.compile(r"[^\x20\x09-\x0D]+")
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        db.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want, got = db.sql(ORACLE[name]).to_arrow_table(), QUERIES[name](spark, sf).toArrow()
    assert set(want.column_names) == set(got.column_names)
    rows = lambda t: sorted(str(r) for r in zip(*(t.column(c).to_pylist() for c in sorted(want.column_names)), strict=True))
    assert rows(got) == rows(want)


def brute_matches(text, items):
    w, hit, found = SYMBOLS.findall(lower(text)), set(), set()
    for name, item in items:
        v = SYMBOLS.findall(lower(item))
        n = min(10, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(name))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [200_000, 30])
def test_decontamination(spark, make, block):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice("abcde") + rng.choice(["", "b", "É"]) for _ in range(n))
    items = [(k, say(rng.choice([0, 1, 3, 9, 10, 11, 25]))) for k in range(12)] + [(90, None), (91, "--"), (92, "A b. a")]
    rows = [(k, f"{say(20)}, {rng.choice(items)[1]} -- {say(15)} {rng.choice(items)[1]}") for k in range(40)] + [(r[0], r[1]) for r in AWKWARD]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = match_benchmark(make(rows), bench, block_words=block).collect()
    want = Counter((i, *map(str, brute_matches(t, items))) for i, t in rows)
    assert Counter((r["doc_id"], str(r["n_words"]), str(r["n_hit"]), str(r["items"])) for r in got) == want
    assert match_benchmark(make(rows[:0]), bench).count() == 0
    assert match_benchmark(make(rows[:3]), bench.limit(0)).filter("n_hit > 0").count() == 0


def test_removal_of_matches(spark, make):
    item = " ".join(f"item{k}" for k in range(14))
    rows = [(1, f"clean start {item}. clean end"), (2, "a clean text stays\nas it is"), (3, item), (4, None)]
    kept = {r["doc_id"]: r["text"] for r in remove_matches(match_benchmark(make(rows), spark.createDataFrame([(1, item)], "item_id long, text string"))).collect()}
    assert kept == {1: "clean start . clean end", 2: rows[1][1], 4: None}


@pytest.mark.parametrize("block", [200_000, 30])
def test_limits_of_removal(spark, make, block):
    """Spans are judged one by one: a long match goes, a short one in the same document stays; coverage decides on whole documents."""
    long, short = " ".join(f"long{k}" for k in range(25)), " ".join(f"short{k}" for k in range(10))
    rows = [(1, f"one {long} two {short} three"), (2, f"four {short} five six seven eight nine ten eleven"), (3, f"{long} end")]
    bench = spark.createDataFrame([(1, long), (2, short)], "item_id long, text string")
    matched = match_benchmark(make(rows), bench, block_words=block)
    assert {r["doc_id"]: [s["longest"] for s in r["spans"]] for r in matched.collect()} == {1: [25, 10], 2: [10], 3: [25]}
    texts = lambda **limits: {r["doc_id"]: r["text"] for r in remove_matches(matched, **limits).collect()}
    assert texts(min_words=20, max_coverage=0.95) == {1: f"one  two {short} three", 2: rows[1][1]}
    assert texts(min_words=26, max_coverage=1.0) == dict(rows)
    assert set(texts(max_coverage=0.6)) == {2}


@given(st.lists(st.binary(max_size=30).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=30), st.sampled_from([8, 16, 64]))
@settings(max_examples=60, deadline=None)
def test_deep_shallow_order(strings, shallow):
    strings = strings + [b"\x01" * 80 + s for s in strings]
    order, shared = deep_shallow(strings, 0, shallow)
    assert [strings[i] for i in order] == sorted(strings)
    assert shared[1:] == [common(strings[a], strings[b]) for a, b in zip(order, order[1:], strict=False)]


def test_offsets_of_equal_contexts():
    text = b"a" * 30 + b"ANCHOR" + b"b" * 30
    assert repeated_offsets([text, text[5:], b"zz" + b"ANCHOR" + b"zz"], [30, 25, 2], 6, 40)[2] == []


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = set()
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone |= set(range(i, i + length))
        out.append((len(b), len(gone), hashlib.sha256(bytes(c for i, c in enumerate(b) if i not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize("cap", [4096, 2])
def test_suffix_dedup(spark, make, cap):
    rng = random.Random(7)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passages = [say(70), say(90), "xy" * 60, say(45)]
    rows = [(k, say(rng.randrange(60)) + rng.choice(passages)[rng.randrange(10) :] + say(rng.randrange(40)) + rng.choice(passages)) for k in range(60)]
    rows += [(r[0], r[1]) for r in AWKWARD if r[0] != 8] + [(99, "z" * 700)]
    got = remove_repeats(make(rows), length=40, anchor=10, cap=cap).collect()
    want = brute_repeats([t for _, t in rows], 40)
    found = Counter((r["doc_id"], r["n_bytes"], sum(s["b"] - s["a"] for s in r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in got)
    assert found == Counter((i, *w) for (i, _), w in zip(rows, want, strict=True))
    assert remove_repeats(make([])).count() == 0


@pytest.mark.parametrize("cap", [4096, 2])
def test_repeated_passages(spark, make, cap):
    """Passages of 51 short words have far fewer bytes than a removed string; equal beginnings of hashes mustn't lengthen them."""
    rng = random.Random(11)
    say = lambda n: " ".join(rng.choice("abcdefghijklm") + rng.choice("nopq") for _ in range(n))
    passages = [say(60), say(51), say(50), "of " * 70]
    rows = [(k, f"{say(rng.randrange(40))} {rng.choice(passages)} {say(rng.randrange(30))} {rng.choice(passages).upper()}") for k in range(50)]
    rows += [(r[0], r[1]) for r in AWKWARD if r[0] != 8]
    split = [BLANKS.findall(lower(t)) for _, t in rows]
    seen = Counter(tuple(w[i : i + 51]) for w in split for i in range(len(w) - 50))
    want = Counter((i, len({p for a in range(len(w) - 50) if seen[tuple(w[a : a + 51])] > 1 for p in range(a, a + 51)})) for (i, _), w in zip(rows, split, strict=True))
    got = remove_repeats(make(rows), cap=cap).collect()
    assert Counter((r["doc_id"], sum(s["b"] - s["a"] for s in r["passages"])) for r in got) == want
    assert sum(bool(r["passages"]) and not r["spans"] for r in got) > 20


def brute_components(rows, size, percent):
    sets = []
    for _, t in rows:
        w = BLANKS.findall(lower(t))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    groups = defaultdict(list)
    for k, x in enumerate(label):
        groups[x].append(rows[k][0])
    return Counter((rows[k][0], len(sets[k]), min((i for i in groups[x] if i is not None), default=None)) for k, x in enumerate(label))


@pytest.mark.parametrize("block", [512, 8])
def test_near_duplicates(spark, make, block, monkeypatch):
    import quarry.llm.neardup as module

    monkeypatch.setattr(module, "BLOCK", block)
    rng = random.Random(3)
    say = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    rows, n = [], 100
    for _ in range(6):
        base = say(80)
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(9999)}"
            rows.append((n, " ".join(copy)))
            n += rng.choice([1, 2])
    rows += [(n + k, " ".join(say(rng.choice([1, 2, 3, 60])))) for k in range(40)] + [(r[0], r[1]) for r in AWKWARD]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(make(rows), 3, 85).collect())
    assert got == brute_components(rows, 3, 85)
    assert near_duplicates(make([])).count() == 0
    kept = keep_one(make(rows), 3, 85)
    assert kept.columns == make(rows).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert set(ids) - {None} == {i for i, _, c in got if i == c and i is not None} and ids.count(6) == 1


def test_pages_of_one_template(spark, make):
    """Pages that share most shingles form one family but no links; a few true copies among them are found."""
    head = " ".join(f"t{k}" for k in range(12))
    rows = [(k, f"{head} a{k} b{k} c{k}") for k in range(1500)] + [(2000 + k, f"{head} a{k} b{k} c{k}") for k in (3, 700)]
    rows += [(3000 + k, " ".join(f"u{j}" for j in range(40)) + f" {k}") for k in range(3)]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(make(rows), 3, 85).collect()}
    assert got == {i: {2003: 3, 2700: 700, 3001: 3000, 3002: 3000}.get(i, i) for i, _ in rows}


def test_matches_asked_for():
    assert least_matches(0.85) == 16 and least_matches(0.8) < 16 and least_matches(1.0) == 32


def test_mixing(spark, make):
    rng = random.Random(1)
    rows = [(k, " ".join(["w"] * rng.randrange(200)), None, rng.choice(["a", "b", "c", "d", None])) for k in range(300)] + [(r[0], r[1] if r[0] != 8 else "long " * 3000, None, "tiny") for r in AWKWARD]
    once, again = (sorted(map(str, mix_sources(make(rows)).collect())) for _ in range(2))
    assert once == again and len(once) == len(rows)
    by = defaultdict(list)
    for r in mix_sources(make(rows)).collect():
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[r["source"]].append(r)
    total = sum(r["size"] for x in by.values() for r in x)
    assert sum(x[0]["target"] for x in by.values()) == pytest.approx(total)
    for x in by.values():
        assert x[0]["target"] <= 3 * x[0]["source_size"] + 1e-6
        assert sum(r["taken"] for r in x) == pytest.approx(x[0]["target"], abs=17)
    assert mix_sources(make([])).count() == 0
    assert [r["taken"] for r in mix_sources(make([(1, None, None, "a"), (2, "", None, None)])).collect()] == [0, 0]


def test_places_in_mix(spark, make):
    """Each document's place is the sum of the sizes ahead of it, in every bucket."""
    got = mix_sources(make([(k, "w " * (1 + k % 7), None, "ab"[k % 2]) for k in range(200)])).collect()
    for source in "ab":
        at = 0
        for r in sorted((r for r in got if r["source"] == source), key=lambda r: hashlib.md5(f"mix-1:{r['doc_id']}".encode()).hexdigest()):
            assert r["first_token"] == at
            at += r["size"]


def test_shards_and_blocks(spark, make):
    """Every shard gets its quota of whole blocks of each source, and the pieces are just the words taken."""
    rng = random.Random(9)
    rows = [(k, "w " * rng.randrange(1, 90), None, rng.choice(["a", "a", "b", None])) for k in range(400)]
    mixed = mix_sources(make(rows), shards=4, blocks=40).collect()
    pieces = shard_blocks(mix_sources(make(rows), shards=4, blocks=40), shards=4).collect()
    by_doc, by_block, by_shard = Counter(), Counter(), defaultdict(set)
    for p in pieces:
        by_doc[p["doc_id"]] += p["words"]
        by_block[p["source"], p["block"]] += p["words"]
        by_shard[p["source"], p["shard"]].add(p["block"])
    assert by_doc == Counter({r["doc_id"]: r["taken"] for r in mixed if r["taken"]})
    size = mixed[0]["block_tokens"]
    for r in mixed:
        quota = r["quota_tokens"] // size // 4
        if r["quota_tokens"] <= 3 * r["source_size"]:
            assert {len(by_shard[r["source"], s]) for s in range(4)} == {quota}
        own = [(p["shard"], p["block"]) for p in pieces if p["doc_id"] == r["doc_id"] and p["round"] == 0]
        assert not own or min(own, key=lambda x: x[1]) == (r["first_shard"], r["first_block"])
    assert max(by_block.values()) == size and sum(n != size for n in by_block.values()) <= 3


def test_mixing_in_place(spark, make):
    """Documents with what is taken of them: as the plan says, with all columns; repeated rows share the end of a selection."""
    rng = random.Random(10)
    rows = [(k, "w " * rng.randrange(60), None, rng.choice(["a", "b", "c", None])) for k in range(300)] + [(None, "no id", None, "b"), (7, None, None, "a")]
    want = Counter((r["doc_id"], r["source"], r["size"], r["taken"]) for r in mix_sources(make(rows)).collect())
    got = mix_documents(make(rows))
    assert got.columns == [*[c for c in make(rows).columns if c != "n_words"], "taken", "n_words"]
    assert Counter((r["doc_id"], r["source"], r["n_words"], r["taken"]) for r in got.collect()) == want
    same = [(1, "w " * 10, None, "a")] * 30 + [(2, "w " * 10, None, "b")] * 50
    planned, taken = Counter(), Counter()
    for r in mix_sources(make(same)).collect():
        planned[r["source"]] += r["taken"]
    for r in mix_documents(make(same)).collect():
        taken[r["source"]] += r["taken"]
    assert all(0 <= planned[s] - taken[s] < 50 for s in "ab")
    assert mix_documents(make([])).count() == 0


def test_fingerprints(spark, make):
    rows = [(r[0], r[1]) for r in AWKWARD] + [(20 + k, " ".join(f"t{k * j % 37}{j}" for j in range(60 + k))) for k in range(30)]
    got = compare_with_next(make(rows)).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    want = Counter()
    for k, (i, t) in enumerate(ordered):
        e = edited(t or "", ordered[(k + 1) % len(ordered)][1] or "")
        want[(i, len(t or ""), hashlib.sha256(e.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    known = defaultdict(set)
    for r in fingerprints(make(rows)).collect():
        known[r["text"] or ""].add(r["fingerprint"])
    assert all(len(v) == 1 for v in known.values())
    for kind in ("string", "decimal(20,2)", "date"):  # ids of other types; ranges cut within one id that many rows have
        more = [(i if k % 2 else 5, f"{k % 7}{t}") for k, (i, t) in enumerate(rows[11:] * 4)]
        typed = spark.createDataFrame([(f"{2000 + i}-01-01" if kind == "date" else f"{i:05d}", t) for i, t in more], "doc_id string, text string").selectExpr(f"CAST(doc_id AS {kind}) AS doc_id", "text")
        ids = [r["doc_id"] for r in typed.collect()]
        turn = sorted(zip(ids, (t for _, t in more)))
        found = Counter((r["doc_id"], r["edited_sha256"]) for r in compare_with_next(typed, part_bytes=900).collect())
        assert found == Counter((i, hashlib.sha256(edited(t, turn[(k + 1) % len(turn)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(turn))
    one = compare_with_next(make([(1, "abcd")])).collect()
    assert [r["edited_text"] for r in one] == ["abca"]
    assert compare_with_next(make([])).count() == 0


@given(st.lists(st.sampled_from([*MARKS, "\\", "|", "\\|", "<", "[", "x", " "]), max_size=12).map("".join))
@settings(max_examples=200, deadline=None)
def test_escape_round_trip(text):
    assert unescape(escape(text)) == text
    assert not any(m in escape(text) for m in MARKS)


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, tokens string"
    rows = [(1, 0, "system", "be <s>brief</s>", ""), (1, 1, "user", None, ""), (1, 2, "assistant", "a\\|b [INST]\n", ""), (1, 3, "assistant", "", ""), (2, 0, "tool", "[ROLE]x[/ROLE]", ""), (2, 1, None, "y", ""), (None, None, "user", "z", ""), (None, None, "user", "z", "")]
    df = spark.createDataFrame(rows, schema)
    got = {r["conv_id"]: r for r in chat_digests(format_chats(df)).collect()}
    for key in (1, 2, None):
        own = [(r[2] or "", r[3] or "") for r in rows if r[0] == key]
        learnt = "".join(t for role, t in own if role == "assistant")
        assert got[key]["n_turns"] == len(own)
        assert got[key]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert (got[key]["loss_chars"], got[key]["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert format_chats(df.limit(0)).count() == 0


def brute_count(model, text):
    """Tokens of the best segmentation of one pre-token, without sharing anything."""
    best = [(0.0, 0)] + [None] * len(text)
    for end in range(1, len(text) + 1):
        n = len(text[end - 1].encode())
        options = [(best[end - 1][0] + n * model.byte, best[end - 1][1] - n)]
        options += [(best[s][0] + model.pieces[text[s:end]], best[s][1] - 1) for s in range(end) if text[s:end] in model.pieces]
        best[end] = max(options)
    return -best[-1][1]


@given(st.lists(st.text("abc", min_size=1, max_size=12), min_size=1, max_size=20, unique=True))
@settings(max_examples=100, deadline=None)
def test_trie_counts(texts):
    model = Unigram.of(["a", "b", "ab", "abc", "bca", "aa", "cab", "abcabc"])
    assert model.counts(texts) == [brute_count(model, t) for t in texts]
    trie = Trie(model)
    assert [trie.insert(t) for t in texts * 2] == [brute_count(model, t) for t in texts] * 2
    assert trie.nodes <= len({t[:k] for t in texts for k in range(len(t) + 1)} | {""})  # each shared prefix once


def test_token_counts(spark, make):
    with open("/opt/tokenizers/piece_bpe_32k.model", "rb") as f:
        model = _model(f.read())
    rows = [(r[0], r[1]) for r in AWKWARD] + [(30, "The quick brown fox, über den \u4e2d\u6587 Zaun! " + "x" * 300), (31, "the THE The")]
    got = Counter((r["doc_id"], r["n_pretokens"], r["n_tokens"]) for r in count_tokens(make(rows)).collect())
    known = {}
    count = lambda w: known.setdefault(w, brute_count(model, MARK + w))
    assert got == Counter((i, len(BLANKS.findall(t or "")), sum(map(count, BLANKS.findall(t or "")))) for i, t in rows)
    assert count_tokens(make([])).count() == 0


def test_shared_folder(spark):
    """Without a stated folder only a session in one process gets one of its own; operators leave the session's settings alone."""

    class Context:
        master, made = "spark://host:7077", None
        getCheckpointDir = lambda self: self.made
        setCheckpointDir = lambda self, d: setattr(self, "made", d)

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(RuntimeError):
        checkpoint_dir(Session)
    Session.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        checkpoint_dir(Session)
    Session.conf = {"spark.checkpoint.dir": "/shared"}
    assert checkpoint_dir(Session) == "/shared"
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    match_benchmark(spark.range(2).selectExpr("id AS doc_id", "'a' AS text"), spark.createDataFrame([(1, "a")], "item_id long, text string")).collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_components_of_a_long_path(spark, monkeypatch):
    """A path takes more rounds than a bushy graph; none is cut short."""
    import quarry.llm.common as module

    monkeypatch.setattr(module, "SMALL_EDGES", 1)
    n = 600
    edges = spark.createDataFrame([((k * 7919) % n, ((k + 1) * 7919) % n) for k in range(n - 1)], "u long, v long")
    assert {r["component"] for r in connected_components(edges).collect()} == {0}


@pytest.mark.parametrize("small", [1 << 20, 0])
def test_components(spark, small, monkeypatch):
    monkeypatch.setattr(shared_parts, "SMALL_EDGES", small)
    rng = random.Random(8)
    edges = [(k, k + 1) for k in range(100, 140)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)] + [(5, 5)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    label.pop(5)
    got = shared_parts.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    own = {x for a, b in edges if a != b for x in (a, b)}
    assert {r["node"]: r["component"] for r in got} == {x: label[x] for x in own} and len(got) == len(own)
    assert shared_parts.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
