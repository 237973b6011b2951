"""Operator 6: secret scans by a character convolutional network, in numpy, beside the stated base patterns.

Base findings (assignments, access keys, hex runs) are the labels. Candidates are all runs of CANDIDATE key characters
at least; a network over each candidate's characters and those around it (embedding, convolution, max
over the candidate and over its surroundings, one dense layer) is trained on labelled candidates, its scores are calibrated on
held-out ones (Platt), and its threshold is the least one from an even chance up that passes no held-out negative, as long as the
stated recall is kept on held-out secrets in a form that no base pattern finds.
Max pooling is associative, so candidates of any length are scored whole: all candidates of a batch stand on end, and the convolution
runs over them in slices.

Scale: training takes a bounded sample of labelled rows (SAMPLE_DOCS documents, FINDINGS candidates, CHARACTERS in all but for the
last one); all texts are scanned where they lie, without a shuffle. The weights are a few thousand numbers. Work is linear in the
text: findings and candidates are merged in order.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import below, cut, map_arrow, widened

#: The base patterns, in the order in which spans of equal start are listed.
KINDS = ("assign", "access", "hex", "cnn")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("passw", "secret", "token", "api")
RUN = re.compile(r"[A-Za-z0-9+/_=.\-]{16,}")
CANDIDATE = 16
AROUND = 24
SAMPLE_DOCS, FINDINGS, CHARACTERS = 20_000, 4_000, 8_000_000
RECALL = 0.98
WIDTH, EMBED, FILTERS, HIDDEN = 5, 8, 40, 24
#: Characters of a training piece, and of a slice of the convolution.
PIECE, SLICE = 64, 1 << 14
#: Fewest training steps, of 64 examples each.
STEPS = 2400
#: Harmless runs of each form that are made for training and threshold, and the most of any form that the threshold lets through.
MADE, FALSE_SHARE = 300, 0.005


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all base findings, leftmost and non-overlapping within each kind, in order."""
    found = []
    if (":" in text or "=" in text) and any(k in (low := text.lower()) for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
        del low
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str) -> list[tuple[int, int]]:
    """All runs of CANDIDATE key characters or more."""
    return [m.span() for m in RUN.finditer(text)]


#: Characters that labelled secrets are spelled anew in.
SPELLINGS = ("0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")


def beyond(own: str) -> str | None:
    """A labelled candidate's secret in a form that no base pattern finds: an assignment's value alone, an access key without its
    prefix, hex digits as capitals. None if too little is left.
    """
    held = ASSIGN.search(own)
    value = held[2] if held else own
    value = HEX.sub(lambda m: m[0].upper(), value.replace("AKIA", ""))
    return value if len(value) >= CANDIDATE and not base_spans(value) else None


class Cover:
    """The union of spans that come in order of their starts, as disjoint ranges: asked for any span in logarithmic time."""

    def __init__(self, spans: list[tuple[int, int, str]]):
        self.starts, self.ends = [], []
        for a, b, _ in spans:
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def holds(self, a: int, b: int) -> bool:
        """Whether all characters of a to b are covered."""
        k = bisect_right(self.starts, a) - 1
        return k >= 0 and self.ends[k] >= b

    def meets(self, a: int, b: int) -> bool:
        """Whether any character of a to b is covered."""
        k = bisect_right(self.starts, b - 1) - 1
        return k >= 0 and self.ends[k] > a


_classes = np.zeros(256, np.int64)  # 0 is padding
for _k, _c in enumerate("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=.-:\"'@ \n#&$%*|,;()[]{}<>?!", 1):
    _classes[ord(_c)] = _k
CLASSES = int(_classes.max()) + 2
_classes[(_classes == 0) & (np.arange(256) > 0)] = CLASSES - 1


def codes(text: str) -> np.ndarray:
    return _classes[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 255)]


_spellings = [codes(x) for x in SPELLINGS]
_ASSIGNED = int(codes("=")[0])


def respelled(text: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A secret's codes in other characters: each of its characters becomes one drawn from one of SPELLINGS, the same everywhere."""
    letters = _spellings[int(rng.integers(len(_spellings)))]
    to = letters[rng.integers(0, len(letters), CLASSES)]
    to[0] = 0
    return to[text]


def varied(text: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A secret's codes as they are (a quarter), spelled anew, or, unless it has a sign of assignment, in another order."""
    kind = rng.random()
    if kind < 0.25:
        return text
    return respelled(text, rng) if kind < 0.65 or (text == _ASSIGNED).any() else rng.permutation(text)


#: Forms of harmless runs: capitals, titles, paths, hosts, identifiers, slugs, numbers, dates, rules of signs.
HARMLESS = ("capitals", "titles", "path", "host", "camel", "snake", "slug", "number", "dated", "rule")
PLAIN_WORDS = ("the", "and", "data", "index", "report", "value", "north", "letter", "school", "version")


def harmless(words: list[str], form: str, rng: np.random.Generator) -> str:
    """A run of CANDIDATE characters or more that looks like no key, made of ordinary words, numbers or signs."""
    draw = lambda *x: x[int(rng.integers(len(x)))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    out, least = "", int(rng.integers(CANDIDATE, 40))
    sign = {"capitals": draw("", "", ".", "-", "_"), "titles": draw("", "-", "."), "path": "/", "host": ".", "camel": "", "snake": "_", "slug": "-"}.get(form)
    if form == "number":
        joint = draw("", "", ".", "-", "/")
        while len(out) < least:
            out += digits(int(rng.integers(2, 9))) + joint
    elif form == "dated":
        while len(out) < least:
            out += f"{digits(4)}-{digits(2)}-{digits(2)}" + draw("T", "_", ".", "/") + draw(*words).lower()[:6] + draw("", ".", "-")
    elif form == "rule":
        part = draw("-", "=", "_", ".", "+", "/", "-=", "._", "+-", "=+")
        out = part * (1 + least // len(part))
    else:
        while len(out) < least:
            word = draw(*words)
            word = word.upper() if form == "capitals" else word.title() if form in ("titles", "camel") else word.lower()
            out += (sign if out else draw("", "/") if form == "path" else "") + word
        out += draw("", "", "s", ".txt", ".html", f"-{digits(2)}", digits(int(rng.integers(1, 5))), ".") if form != "capitals" else draw("", "", ".", "-" + digits(4))
    return out if RUN.fullmatch(out) and not base_spans(out) else "-" * CANDIDATE


@dataclass
class SecretNet:
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    out: np.ndarray
    platt: tuple[float, float] = (1.0, 0.0)
    threshold: float = 1.0

    def pooled(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Max over positions of the rectified convolution of each padded row; where it was taken; the windows."""
        windows = np.lib.stride_tricks.sliding_window_view(self.embed[rows], WIDTH, 1).transpose(0, 1, 3, 2).reshape(len(rows), -1, WIDTH * EMBED)
        reached = windows @ self.filters + self.bias
        place = reached.argmax(1)
        return np.maximum(0, np.take_along_axis(reached, place[:, None], 1)[:, 0]), place, windows

    def pools(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Pooled features of each sequence, of any lengths: as `pooled`, over all of them on end, SLICE characters at a time."""
        sizes = np.array([max(WIDTH, len(x)) for x in sequences])
        flat = np.zeros(sizes.sum() + WIDTH - 1, np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        for at, x in zip(begin.tolist(), sequences):
            flat[at : at + len(x)] = x
        # what a window adds for each of its places and the character there
        tables = [(self.embed @ self.filters[k * EMBED : (k + 1) * EMBED]).astype(np.float32) for k in range(WIDTH)]
        whole = np.ones(begin[-1], bool)  # windows that don't reach into the next sequence
        for k in range(1, WIDTH):
            whole[begin[1:] - k] = False
        best = np.zeros((len(sequences), FILTERS), np.float32)
        owner = np.repeat(np.arange(len(sequences)), sizes)
        for at in range(0, int(begin[-1]), SLICE):
            to = min(int(begin[-1]), at + SLICE)
            reached = tables[0][flat[at:to]]
            for k in range(1, WIDTH):
                reached += tables[k][flat[at + k : to + k]]
            reached[~whole[at:to]] = -np.inf
            own = owner[at:to]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            most = np.maximum.reduceat(reached, first, 0) + self.bias.astype(np.float32)
            best[own[first]] = np.maximum(best[own[first]], most)
        return best

    def raw(self, texts: list[np.ndarray], spans: list[list[tuple[int, int]]]) -> np.ndarray:
        """The uncalibrated scores of all candidates of all texts (as character codes), each text with its spans, in order."""
        own, side, gap = [], [], np.zeros(1, np.int64)
        for text, found in zip(texts, spans, strict=True):
            own += [text[a:b] for a, b in found]
            side += [np.concatenate([text[max(0, a - AROUND) : a], gap, text[b : b + AROUND]]) for a, b in found]
        if not own:
            return np.zeros(0)
        x = np.concatenate([self.pools(own), self.pools(side)], 1)
        return np.maximum(0, x @ self.dense + self.dense_bias) @ self.out[:-1] + self.out[-1]

    def score(self, texts: list[np.ndarray], spans: list[list[tuple[int, int]]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.platt[0] * self.raw(texts, spans) + self.platt[1], -35, 35)))


def _padded(texts: list[np.ndarray], width: int, rng: np.random.Generator | None = None) -> np.ndarray:
    """A row for each text; of one longer than `width` a piece, from a random place."""
    rows = np.zeros((len(texts), width), np.int64)
    for r, c in zip(rows, texts, strict=True):
        at = int(rng.integers(len(c) - width + 1)) if rng is not None and len(c) > width else 0
        r[: len(c)] = c[at : at + width]
    return rows


def platt(raw: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn raw scores into chances: Platt's targets, both labels of equal weight, damped Newton steps."""
    ones, zeros = truth.sum(), (1 - truth).sum()
    goal = np.where(truth == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    even = np.where(truth == 1, 0.5 / max(1, ones), 0.5 / max(1, zeros))
    found = np.array([1.0, 0.0])
    x = np.stack([raw, np.ones(len(raw))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ found, -35, 35)))
        step = np.linalg.solve((x * (even * (p * (1 - p) + 1e-6))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (even * (p - goal)))
        found = found - step * min(1.0, 1.0 / max(1e-9, np.abs(step).max()))
    return float(found[0]), float(found[1])


def train(findings: list[tuple[str, str, int]], epochs: int = 12, seed: int = 5, recall: float = RECALL) -> SecretNet | None:
    """A calibrated network from (candidate, surroundings, label); None unless both labels are there.

    In each epoch, longer candidates give a piece from another random place (the scores of whole candidates are what is calibrated).
    A third of the examples lose their surroundings, a third get another one's, half see only what is nearest, and half lose their end; three quarters of the secrets are spelled
    in other characters or reordered: a key is to be told by its own disorder, not by its place, length or form. The stated recall is asked of
    held-out secrets in forms that no base pattern finds, in the surroundings of other candidates.
    """
    labels = [label for _, _, label in findings]
    if not 0 < sum(labels) < len(labels):
        return None
    rng = np.random.Generator(np.random.PCG64(seed))
    # what no base pattern marks is rarely more than prose: runs of ordinary words, numbers and signs are shown too, as many of each form
    vocabulary = sorted({w for _, side, _ in findings for w in re.findall(r"[A-Za-z]{3,12}", side)} - {"AKIA"}) or list(PLAIN_WORDS)
    sounds = [[*"aeiouy", "ea", "ou", "ie"], [*"bcdfghjklmnpqrstvwxz", "th", "st", "nd", "tr", "ch", "ck", "ss"]]
    spoken = ["".join(sounds[(k + start) % 2][int(rng.integers(len(sounds[(k + start) % 2])))] for k in range(int(rng.integers(3, 9)))) for start in rng.integers(0, 2, 600).tolist()]
    vocabulary += spoken  # words of other languages than the sample's
    sides = [side for _, side, _ in findings]
    findings = findings + [(harmless(vocabulary, form, rng), sides[int(rng.integers(len(sides)))], 0) for form in HARMLESS for _ in range(MADE)]
    y = np.array([label for _, _, label in findings], float)
    net = SecretNet(rng.normal(0, 0.3, (CLASSES, EMBED)), rng.normal(0, 0.2, (WIDTH * EMBED, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.2, (2 * FILTERS, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN + 1))
    parts = [net.embed, net.filters, net.bias, net.dense, net.dense_bias, net.out]
    m, v, t = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    order = rng.permutation(len(findings))
    held, used = order[: max(1, len(order) // 5)], order[max(1, len(order) // 5) :]
    whole, around = [codes(f[0]) for f in findings], _padded([codes(f[1]) for f in findings], 2 * AROUND + 1)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    rounds = max(epochs, -(-STEPS * 64 // len(used)))
    steps = rounds * -(-len(used) // 64)
    for _ in range(rounds):
        own = _padded([varied(w, rng) if y[e] == 1 else w for e, w in enumerate(whole)], PIECE, rng)
        length = np.minimum([len(w) for w in whole], PIECE)
        shorter = own * (np.arange(PIECE) < rng.integers(np.minimum(CANDIDATE, length), length + 1)[:, None])
        for at in range(0, len(used), 64):
            b = rng.permutation(used)[:64]
            kind = rng.integers(0, 3, len(b))[:, None]
            side = np.where(kind == 0, 0, np.where(kind == 1, around[b], around[rng.permutation(used)[: len(b)]]))
            near = np.abs(np.arange(2 * AROUND + 1) - AROUND) <= np.where(rng.random(len(b)) < 0.5, AROUND, rng.integers(0, AROUND, len(b)))[:, None]
            side = side * near
            body = np.where(rng.random(len(b))[:, None] < 0.5, own[b], shorter[b])
            pools = [net.pooled(body), net.pooled(side)]
            x = np.concatenate([p[0] for p in pools], 1)
            h = np.maximum(0, x @ net.dense + net.dense_bias)
            p = 1 / (1 + np.exp(-np.clip(h @ net.out[:-1] + net.out[-1], -35, 35)))
            g = (p - y[b]) * weight[b] / len(b)
            gh = np.outer(g, net.out[:-1]) * (h > 0)
            gx = gh @ net.dense.T
            grads = [np.zeros_like(net.embed), np.zeros_like(net.filters), np.zeros_like(net.bias), x.T @ gh, gh.sum(0), np.append(h.T @ g, g.sum())]
            for (best, place, windows), rows, gp in zip(pools, (body, side), (gx[:, :FILTERS], gx[:, FILTERS:]), strict=True):
                gp = gp * (best > 0)
                taken = windows[np.arange(len(b))[:, None], place]  # example, filter, window
                grads[1] += np.einsum("ef,efw->wf", gp, taken)
                grads[2] += gp.sum(0)
                back = (gp[:, :, None] * net.filters.T[None]).reshape(len(b), FILTERS, WIDTH, EMBED)
                seen = rows[np.arange(len(b))[:, None, None], place[:, :, None] + np.arange(WIDTH)]
                np.add.at(grads[0], seen, back)
            t += 1
            rate = 0.01 * max(0.05, 1 - t / steps)
            for k, (part, grad) in enumerate(zip(parts, grads, strict=True)):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                part -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    texts = [np.concatenate([around[e][:AROUND], whole[e], around[e][AROUND + 1 :]]) for e in held]
    raw, truth = net.raw(texts, [[(AROUND, AROUND + len(whole[e]))] for e in held]), y[held]
    # the scan adds to the base patterns: held-out secrets count in forms outside them too, wherever they stand
    unseen = [codes(v) for e in held if y[e] == 1 and (v := beyond(findings[e][0])) is not None]
    unseen += [respelled(whole[e], rng) for e in held if y[e] == 1 for _ in range(3) if len(whole[e]) >= CANDIDATE]
    for e in held[y[held] == 1]:
        for n in rng.integers(CANDIDATE, 24, 3 * (len(whole[e]) > 24)).tolist():  # pieces too short for the patterns
            at = int(rng.integers(len(whole[e]) - n + 1))
            unseen += [whole[e][at : at + n]] * (not base_spans(findings[e][0][at : at + n]))
    beside = around[rng.choice(held, len(unseen))] if unseen else ()
    alone = net.raw([np.concatenate([r[:AROUND], v, r[AROUND + 1 :]]) for v, r in zip(unseen, beside, strict=True)], [[(AROUND, AROUND + len(v))] for v in unseen])
    net.platt = platt(np.concatenate([raw, alone]), np.concatenate([truth, np.ones(len(alone))]))
    sure = lambda x: 1 / (1 + np.exp(-np.clip(net.platt[0] * x + net.platt[1], -35, 35)))
    wrong, right = sure(raw[truth == 0]), np.sort(sure(alone))
    most = float(right[int((1 - recall) * len(right))]) if len(right) else 1.0
    # more harmless runs than were trained on: of no form may more than the stated share pass, unless the recall would suffer
    fresh = [[codes(harmless(vocabulary, form, rng)) for _ in range(400)] for form in HARMLESS]
    sided = [around[rng.choice(held, 400)] for _ in HARMLESS]
    passed = [sure(net.raw([np.concatenate([r[:AROUND], x, r[AROUND + 1 :]]) for x, r in zip(own, side, strict=True)], [[(AROUND, AROUND + len(x))] for x in own])) for own, side in zip(fresh, sided, strict=True)]
    bound = max(float(np.quantile(p, 1 - FALSE_SHARE)) for p in passed)
    net.threshold = min(most, max(0.5, bound, np.nextafter(wrong.max(), 1) if len(wrong) else 0.5))
    return net


def findings_of(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, findings: int = FINDINGS) -> list[tuple[str, str, int]]:
    """Labelled candidates from about `sample_docs` documents: 1 where a base finding overlaps. At most `findings`, by a hash order, and
    of each label no more after the first CHARACTERS / 2 characters."""
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    n = rows.count()
    if not n:
        return []

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in batch.column("text").to_pylist():
            known = Cover(base_spans(text))
            for a, b in candidates(text):
                label = int(known.meets(a, b))
                left, right = text[max(0, a - AROUND) : a].rjust(AROUND, "\0"), text[b : b + AROUND]
                out.append((text[a:b], left + "\0" + right, label))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.int32())], ["own", "around", "label"])

    found = cut(map_arrow(rows.filter(below(sample_docs / n, 21, "doc_id")), each, "own string, around string, label int").distinct().withColumn("rank", F.xxhash64("own", "around")))
    before = F.sum(F.length("own")).over(W.orderBy("rank", "own").rowsBetween(W.unboundedPreceding, -1))  # over `findings` rows at most
    halves = [found.filter(F.col("label") == k).orderBy("rank", "own").limit(findings // 2).withColumn("before", before).filter(F.coalesce("before", F.lit(0)) < CHARACTERS // 2) for k in (0, 1)]
    return [(r["own"], r["around"], r["label"]) for r in halves[0].unionByName(halves[1]).orderBy("label", "rank", "own", "around").collect()]


def scan_secrets(docs: DataFrame, net: SecretNet | None) -> DataFrame:
    """`docs` with `spans`: array<struct<start,end,kind,score>> in code points, by start, then kind; base findings all stay.

    A null or empty text has none. Every candidate is scored; one that base findings cover wholly is theirs and isn't repeated.
    """
    kept = docs.drop("spans")
    names_kept = kept.columns
    shared = docs.sparkSession.sparkContext.broadcast(net)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        net, texts = shared.value, [t or "" for t in batch.column("text").to_pylist()]
        base = [base_spans(t) for t in texts]
        more = [candidates(t) if net is not None else [] for t in texts]
        some = [k for k, c in enumerate(more) if c]
        scores = iter(net.score([codes(texts[k]) for k in some], [more[k] for k in some]).tolist() if some else ())
        out = []
        for own, cands in zip(base, more, strict=True):
            known = Cover(own)
            found = [(a, b, k, 1.0) for a, b, k in own] + [(a, b, "cnn", s) for (a, b), s in zip(cands, scores) if s >= net.threshold and not known.holds(a, b)]
            found.sort(key=lambda s: (s[0], KINDS.index(s[2])))
            out.append([{"start": a, "end": b, "kind": k, "score": s} for a, b, k, s in found])
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names_kept), pa.array(out, span)], [*names_kept, "spans"])

    return map_arrow(kept, each, widened(kept, "spans array<struct<start:bigint,end:bigint,kind:string,score:double>>"))


def redact(scanned: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The scanned documents with each maximal run of found characters replaced by `mark`; other texts stay as they are."""
    left = [n for n in scanned.columns if n != "spans"]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            if spans:
                parts, at = [], 0
                for s in spans:
                    if s["start"] > at or not parts:
                        parts += [texts[i][at : s["start"]], mark]
                    at = max(at, s["end"])
                texts[i] = "".join([*parts, texts[i][at:]])
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in left], left)

    return map_arrow(scanned, each, scanned.select(*left).schema)


def spans_text(spans: list[dict], kinds: tuple[str, ...] = KINDS) -> str:
    """kind:start:end of the spans, comma-joined."""
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans if s["kind"] in kinds)


def spans_digest(spans: list[dict]) -> str:
    return hashlib.sha256(spans_text(spans, KINDS[:3]).encode()).hexdigest()
