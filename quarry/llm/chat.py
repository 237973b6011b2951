"""Operator 8: chat formatting by token-level assembly.

Each turn's text is encoded on its own with a public byte-level vocabulary; the turn's marks are reserved ids above that
vocabulary, spliced between the segments, so that no text can produce a mark. In the text form the marks are their strings, and
such strings (and the escape character) inside a text are escaped, reversibly. The loss mask comes from prefix sums of the
segments' lengths: 1 over the assistant's texts, 0 elsewhere.

Scale: turns are escaped and encoded where they lie; one shuffle by conversation, sorted by turn, then a streaming pass that
holds one conversation at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Strings of the reserved ids, in the order of their ids above the vocabulary. Fixed values.
MARKS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
#: Marks before and after a turn's text; any other role is spelt out: [ROLE]role[/ROLE]text</s>.
TURN = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
#: How the byte-level vocabulary splits text before merging. A fixed value of its public format.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_escapes = re.compile("|".join(map(re.escape, ["\\", *sorted(MARKS, key=len, reverse=True)])))
_unescapes = re.compile(r"\\([\\|])")


def escape(text: str) -> str:
    """`text` without marks: a backslash is doubled, a mark gets backslash-bar after its first character."""
    return _escapes.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\|" + m[0][1:], text)


def unescape(text: str) -> str:
    return _unescapes.sub(lambda m: "\\" if m[1] == "\\" else "", text)


@cache
def _encoding(raw: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
    return tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


def vocabulary(spark: SparkSession, path: str):
    """The vocabulary file's bytes (under 1 MB), broadcast. Read once on the driver: executors need no copy."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def read_back(tokens: list[int], encoding, base: int) -> tuple[str, list[tuple[str, str]]]:
    """The text form of an assembled conversation, and its (role, unescaped text) turns, from its tokens alone."""
    ids = np.asarray(tokens, np.int64)
    cuts = np.flatnonzero(ids >= base)
    whole, turns, role, at = [], [], None, 0
    for c in [*cuts.tolist(), len(ids)]:
        text = encoding.decode_bytes(ids[at:c].tolist()).decode("utf-8", "surrogatepass") if c > at else ""
        whole.append(text)
        if c == len(ids):
            break
        mark = MARKS[ids[c] - base]
        whole.append(mark)
        if mark == "[/ROLE]":
            role = unescape(text)
        elif mark in ("</s>", "[/INST]", "<</SYS>>"):
            turns.append((role if role is not None else {"</s>": "assistant", "[/INST]": "user", "<</SYS>>": "system"}[mark], unescape(text)))
            role = None
        at = c + 1
    return "".join(whole), turns


def format_chats(turns: DataFrame, tokenizer: str = VOCABULARY) -> DataFrame:
    """conv_id, n_turns, tokens array<int>, loss_mask array<byte> for each conversation of (conv_id, turn, role, text).

    Turns stand in order of `turn`, nulls first, ties by role and text; a null role or text is empty; null conv_ids form one
    conversation. Repeated rows are repeated turns. An empty table gives no rows; other columns are ignored.
    """
    vocab = vocabulary(turns.sparkSession, tokenizer)

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoding, base = _encoding(vocab.value)
        ids = {m: base + i for i, m in enumerate(MARKS)}
        texts = encoding.encode_ordinary_batch([escape(t or "") for t in batch.column("text").to_pylist()], num_threads=1)
        roles = batch.column("role").to_pylist()
        tokens, before = [], []
        for role, body in zip(roles, texts, strict=True):
            head = [ids[TURN[role][0]]] if role in TURN else [ids["[ROLE]"], *encoding.encode_ordinary(escape(role or "")), ids["[/ROLE]"]]
            tokens.append(np.array([*head, *body, ids[TURN[role][1]] if role in TURN else ids["</s>"]], np.int32))
            before.append(len(head))
        spans = [len(b) if r == "assistant" else 0 for r, b in zip(roles, texts, strict=True)]
        keep = ["conv_id", "turn", "role", "text_order"]
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(tokens, pa.list_(pa.int32())), pa.array(before, pa.int32()), pa.array(spans, pa.int32())], [*keep, "tokens", "head", "loss"])

    rows = turns.select("conv_id", "turn", "role", "text", F.xxhash64("text").alias("text_order"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    encoded = map_arrow(rows, encode, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text_order long, tokens array<int>, head int, loss int")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, int, int]] = []
        key, started = None, False

        def finish(kind: pa.DataType) -> pa.RecordBatch:
            lengths = np.array([len(t) for t, _, _ in held])
            starts = np.cumsum(lengths) - lengths + [h for _, h, _ in held]
            edges = np.zeros(lengths.sum() + 1, np.int32)
            np.add.at(edges, starts, 1)
            np.add.at(edges, starts + [n for _, _, n in held], -1)
            mask = np.cumsum(edges[:-1]).astype(np.int8)
            return pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([len(held)], pa.int64()), pa.array([np.concatenate([t for t, _, _ in held])], pa.list_(pa.int32())), pa.array([mask], pa.list_(pa.int8()))], ["conv_id", "n_turns", "tokens", "loss_mask"])

        kind = None
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            values, tokens = batch.column("conv_id").to_pylist(), batch.column("tokens")
            flat, at = tokens.values.to_numpy(zero_copy_only=False), tokens.offsets.to_numpy()
            for i, (k, h, n) in enumerate(zip(values, batch.column("head").to_pylist(), batch.column("loss").to_pylist(), strict=True)):
                if started and k != key:
                    yield finish(kind)
                    held.clear()
                key, started = k, True
                held.append((flat[at[i] : at[i + 1]].copy(), h, n))
        if started:
            yield finish(kind)

    dealt = encoded.repartition(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text_order")
    return dealt.mapInArrow(assemble, f"conv_id {kinds['conv_id']}, n_turns long, tokens array<int>, loss_mask array<byte>")


def chat_digests(formatted: DataFrame, tokenizer: str = VOCABULARY) -> DataFrame:
    """The contract's digests, read back from the tokens and masks that `format_chats` returned."""
    vocab = vocabulary(formatted.sparkSession, tokenizer)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoding, base = _encoding(vocab.value)
        out = []
        for tokens, mask in zip(batch.column("tokens"), batch.column("loss_mask"), strict=True):
            ids, on = tokens.values.to_numpy(zero_copy_only=False), mask.values.to_numpy(zero_copy_only=False)
            text, turns = read_back(ids, encoding, base)
            told = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest()
            edges = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
            learnt = "".join(unescape(encoding.decode_bytes(ids[a:b].tolist()).decode("utf-8", "surrogatepass")) for a, b in zip(edges[::2], edges[1::2], strict=True))
            out.append((len(turns), told, len(learnt), hashlib.sha256(learnt.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
        columns = [pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)] if out else None
        return None if columns is None else pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return map_arrow(formatted, each, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long", rows=200)
