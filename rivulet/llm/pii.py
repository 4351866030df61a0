"""Personal data: exact base spans, and a skip-chain conditional random field that adds what they imply.

Base spans come from fixed patterns for email, ip, card and phone, the leftmost non-overlapping matches of each kind;
those that fail their kind's test are dropped and not tried again. All matching is linear in the text's length.

The field has a node for each token (run of non-space characters) with a digit, an at sign or a plus; other tokens are
of no entity. A node's label is none or a kind. Its potentials: weights of the token's shape; transitions between
nodes that are neighbours in the text; and skip edges between all nodes whose tokens are the same or have the same six
or more digits. A group's skip edges meet in a hub with a label of its own, so their number stays that of its members.
Nodes that base spans cover are observed. Loopy sum-product passes messages along all edges, ROUNDS times, over the
whole document; a node whose probability of some kind is at least CERTAIN, away from base spans, becomes a span
(neighbouring nodes that are parts of one card or phone a single one; whole ones stay apart). So a part of a number that a base span holds elsewhere in the document is
found too.

Weights are fitted here by pseudo-likelihood to the base labels of a bounded sample of documents (SAMPLE, of up to
LONGEST characters); half of the nodes' shapes are hidden at a time, so that neighbours and repetitions get their
weight. Search covers whole texts, however long.

Defined cases: null and empty texts have no spans; offsets are code points, ends exclusive; repeated rows are treated
alike; without documents to learn from, nothing is added; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm import tokens
from rivulet.llm.common import bounded_sample

#: Kinds in their order, and the patterns of the base spans.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# digits before the match would have begun it earlier, so the look-behind drops no match and keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?()[]{}<>\"'|"

SAMPLE = 2000
LONGEST = 32_768
ROUNDS = 12
CERTAIN = 0.8
_LABELS = len(KINDS) + 1
_CUE = np.isin(np.arange(256), list(b"0123456789@+"))

Span = tuple[int, int, int]  # start, kind, end


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """start, kind, end of all base spans, by start and then kind."""
    found: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((start, 0, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def shape(token: str) -> list[float]:
    """The features of a token."""
    core = token.strip(_EDGE)
    digits = "".join(c for c in core if "0" <= c <= "9")
    n = len(digits)
    parts = core.split(".")
    return [
        1.0,
        *(float(lo <= n <= hi) for lo, hi in ((0, 0), (1, 2), (3, 3), (4, 6), (7, 8), (9, 11), (12, 15), (16, 19), (20, 1 << 60))),
        float("@" in core),
        float("." in core),
        float(len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts)),
        float(token.startswith("+")),
        float("(" in token or ")" in token),
        float("-" in core),
        float(n == len(core)),
        float(any(c.isalpha() for c in core)),
        float(12 <= n <= 19 and _luhn(digits)),
    ]


_SHAPES = len(shape("1"))


#: Most digits of a card and a phone.
_MOST = {2: 19, 3: 15}


def _whole(kind: int, text: str) -> bool:
    return (0, kind, len(text)) in base_spans(text)


def _one(kind: int, before: str, after: str) -> bool:
    """Whether neighbours of a kind are parts of one entity: neither is whole by itself, nor do both have too many digits."""
    digits = sum("0" <= c <= "9" for c in before + after)
    return kind in _MOST and digits <= _MOST[kind] and not _whole(kind, before) and not _whole(kind, after)


def _key(token: str) -> str:
    """Tokens of equal keys are linked by skip edges."""
    core = token.strip(_EDGE + "+").lower()
    digits = "".join(c for c in core if "0" <= c <= "9")
    return digits if len(digits) >= 6 and "@" not in core else core


class Nodes:
    """The nodes of a document: place, shape, observed label (-1: none), neighbour links and groups."""

    def __init__(self, text: str, spans: list[Span]):
        self.at, nth = [], []
        for i, m in enumerate(_TOKEN.finditer(text)):
            if any("0" <= c <= "9" or c in "@+" for c in m[0]):
                self.at.append(m.span())
                nth.append(i)
        words = [text[a:b] for a, b in self.at]
        known: dict[str, list[float]] = {}
        self.shapes = np.array([known[w] if w in known else known.setdefault(w, shape(w)) for w in words]).reshape(-1, _SHAPES)
        self.observed = np.full(len(words), -1)
        of_kind = [sorted(s for s in spans if s[1] == kind) for kind in range(len(KINDS))]  # no two of a kind overlap
        nxt = [0] * len(KINDS)
        for i, (a, b) in enumerate(self.at):
            over = []
            for kind, own in enumerate(of_kind):
                while nxt[kind] < len(own) and own[nxt[kind]][2] <= a:
                    nxt[kind] += 1
                if nxt[kind] < len(own) and own[nxt[kind]][0] < b:
                    over.append(own[nxt[kind]])
            if over:
                self.observed[i] = min(over)[1] + 1
        order = np.array(nth, np.int64)
        self.links = np.flatnonzero(np.diff(order) == 1)
        groups = defaultdict(list)
        for i, w in enumerate(words):
            groups[_key(w)].append(i)
        self.groups = [g for k, g in groups.items() if k and len(g) > 1]


class Field:
    """Weights: of shapes (labels by shapes), of transitions (labels by labels), of agreement with a group."""

    def __init__(self, shapes: np.ndarray, moves: np.ndarray, agree: float):
        self.shapes, self.moves, self.agree = shapes, moves, agree

    def marginals(self, nodes: Nodes) -> np.ndarray:
        """Probabilities of labels for each node."""
        n, hubs = len(nodes.at), len(nodes.groups)
        own = np.zeros((n + hubs, _LABELS))
        own[:n] = nodes.shapes @ self.shapes.T
        seen = np.flatnonzero(nodes.observed >= 0)
        own[seen] = -30.0
        own[seen, nodes.observed[seen]] = 0.0
        members = np.array([i for g in nodes.groups for i in g], np.int64)
        hub = np.repeat(np.arange(hubs) + n, [len(g) for g in nodes.groups]).astype(np.int64)
        chain, skip = len(nodes.links), len(members)
        source = np.concatenate((nodes.links, nodes.links + 1, members, hub))
        target = np.concatenate((nodes.links + 1, nodes.links, hub, members))
        back = np.concatenate((np.arange(chain) + chain, np.arange(chain), np.arange(skip) + 2 * chain + skip, np.arange(skip) + 2 * chain))
        potential = np.concatenate((np.repeat(self.moves[None], chain, 0), np.repeat(self.moves.T[None], chain, 0), np.repeat(self.agree * np.eye(_LABELS)[None], 2 * skip, 0)))
        messages, total = np.zeros((len(source), _LABELS)), own.copy()
        for _ in range(ROUNDS if len(source) else 0):
            sent = (total[source] - messages[back])[:, :, None] + potential
            top = sent.max(axis=1, keepdims=True)
            new = (np.log(np.exp(sent - top).sum(axis=1)) + top[:, 0])
            messages = 0.5 * messages + 0.5 * (new - new.max(axis=1, keepdims=True))
            total = own.copy()
            np.add.at(total, target, messages)
        p = np.exp(total[:n] - total[:n].max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def added(self, text: str, spans: list[Span]) -> list[Span]:
        """Spans beyond the base spans."""
        nodes = Nodes(text, spans)
        if (nodes.observed >= 0).all() or not (len(nodes.links) or nodes.groups):
            return []
        p = self.marginals(nodes)
        label = np.where((p.max(axis=1) >= CERTAIN) & (nodes.observed < 0), p.argmax(axis=1), 0)
        out: list[Span] = []
        for i in np.flatnonzero(label):
            a, b = nodes.at[i]
            word = text[a:b]
            start, end = a + len(word) - len(word.lstrip(_EDGE)), b - (len(word) - len(word.rstrip(_EDGE)))
            kind = int(label[i]) - 1
            if out and i and label[i - 1] == label[i] and not text[out[-1][2] : start].strip(_EDGE + " ") and _one(kind, text[out[-1][0] : out[-1][2]], text[start:end]):
                out[-1] = (out[-1][0], kind, int(end))
            elif start < end:
                out.append((int(start), kind, int(end)))
        return out


def fit(texts: list[str], steps: int = 300, seed: int = 0) -> Field | None:
    """Weights by pseudo-likelihood of the base labels; None without nodes."""
    rng = np.random.default_rng(seed)
    shapes, labels, before, after, shared = [], [], [], [], []
    for text in texts:
        nodes = Nodes(text, base_spans(text))
        y = np.maximum(nodes.observed, 0)
        one = np.eye(_LABELS)[y].reshape(-1, _LABELS)
        prev, following, others = np.zeros((3, len(y), _LABELS))
        prev[nodes.links + 1], following[nodes.links] = one[nodes.links], one[nodes.links + 1]
        for g in nodes.groups:
            others[g] = (one[g].sum(0) - one[g]) / (len(g) - 1)
        for into, x in ((shapes, nodes.shapes), (labels, y), (before, prev), (after, following), (shared, others)):
            into.append(x)
    x, y, prev, following, others = (np.concatenate(a) if a else np.zeros((0, 1)) for a in (shapes, labels, before, after, shared))
    if not len(y):
        return None
    w, moves, agree = np.zeros((_LABELS, _SHAPES)), np.zeros((_LABELS, _LABELS)), np.zeros(1)
    velocity = [np.zeros_like(p) for p in (w, moves, agree)]
    target = np.eye(_LABELS)[y.astype(int)]
    linked = (prev.any(1) | following.any(1) | others.any(1))
    for _ in range(steps):
        shown = x * (~linked | (rng.random(len(y)) < 0.5))[:, None]
        shown[:, 0] = x[:, 0]
        logits = shown @ w.T + prev @ moves + following @ moves.T + others * agree
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        d = (p / p.sum(axis=1, keepdims=True) - target) / len(y)
        grads = (d.T @ shown + 1e-4 * w, prev.T @ d + (following.T @ d).T + 1e-4 * moves, (d * others).sum(keepdims=True)[0] + 1e-4 * agree)
        for value, v, g in zip((w, moves, agree), velocity, grads, strict=True):
            v *= 0.9
            v -= g
            value += v
    return Field(w, moves, float(max(agree[0], 0)))


def learn(docs: DataFrame, sample: int = SAMPLE) -> Field | None:
    """docs: doc_id, text."""
    cued = docs.where(F.length("text").between(1, LONGEST) & F.col("text").rlike("[0-9@]"))
    texts = sorted({r["text"] for r in bounded_sample(cued.select("text"), sample, [F.col("text")]).collect()})
    return fit(texts)


def digest(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added for each row."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs))
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            counts, sha, out = np.zeros((n, len(KINDS) + 1), np.int64), [nothing] * n, [""] * n
            texts = batch.column(1)
            for part in tokens.parts(texts):
                cues = np.concatenate(([0], np.cumsum(_CUE[part.data])))
                starts = np.concatenate(([0], part.ends[:-1])).astype(np.int64)
                for i in np.flatnonzero(cues[part.ends] > cues[starts]):
                    row = part.first + int(i)
                    text = texts[row].as_buffer().to_pybytes().decode()
                    base = base_spans(text)
                    more = shared.value.added(text, base) if shared.value else []
                    sha[row], out[row] = hashlib.sha256(digest(base).encode()).hexdigest(), digest(sorted(base + more))
                    for _, kind, _ in base:
                        counts[row, kind] += 1
                    counts[row, -1] = len(more)
            columns = [*(pa.array(counts[:, k]) for k in range(len(KINDS))), pa.array(sha), pa.array(out), pa.array(counts[:, -1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_added long")
