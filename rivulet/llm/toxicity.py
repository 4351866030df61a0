"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained here in numpy.

Words are runs of letters and figures. A word's input is its embedding beside the mean embedding of its characters' trigrams (by hash). Words met fewer than
LEAST times in learning share one embedding, so they are known by their characters only. Windows of WINDOW words start
at every STRIDE-th word of a text, the last one filled up with blank words: all of these overlapping windows are scored.
In a window, two gated recurrent chains of HIDDEN units read forward and backward; attention weighs their states, and
the pooled state gives a logit. A text's logit is the largest of its windows', and a logistic curve fitted to the
learning rows turns it into a score.

Learning. Only texts have labels, so each labelled text stands for the windows that score highest in it at present
(first by the log-odds of its words); texts labelled toxic in which nothing is found are left out. These windows, with
random ones of clean texts among them, are learned by backpropagation through time with Adam, in ROUNDS rounds. Learned
from are at most SAMPLE labelled texts of each class of up to LONGEST characters, equal texts once; scoring covers whole
texts of any length. Held-out rows are never learned from.

For scoring, a part's words are laid out so that each chain step is one matrix product over all windows.

Defined cases: texts without words (null, empty) have score 0, that of no evidence; if there are not both labels to
learn from, every score is 0; repeated rows are scored alike; null labels are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm import tokens
from rivulet.llm.common import bounded_sample, crc_mod

WINDOW = 16
STRIDE = 8
HIDDEN = 8
WORD_SIZE, LEAST, SLOT_BITS = 6, 4, 18
CHAR_BITS, CHAR_SIZE = 12, 6
SAMPLE = 1200
LONGEST = 16_384
#: Rounds of choosing windows; least passes over them and least steps in a round; windows in a step.
ROUNDS, EPOCHS, STEPS, BATCH = 3, 3, 80, 256
THRESHOLD = 0.7

#: Bytes as words are made of them: A-Z in lower case, and blanks for ASCII characters that are no letter or figure.
_PLAIN = np.array([b if chr(c).isalnum() or c > 127 else 32 for c, b in enumerate(tokens.LOWER)], np.uint8)


@dataclass
class Inputs:
    """hashes: of words; grams: buckets of all trigrams in order; at: where each word's start in grams; counts: words by document."""

    hashes: np.ndarray
    grams: np.ndarray
    at: np.ndarray
    counts: np.ndarray


def read(part: tokens.Part) -> Inputs:
    data = _PLAIN[part.data]
    w = tokens.words(data, part.ends)
    # a trigram around each byte of a word, blanks beyond the word's ends
    size = w.ends - w.starts
    at = np.cumsum(size) - size
    of = np.repeat((w.starts - at).astype(np.int32), size) + np.arange(size.sum(), dtype=np.int32)
    b = np.zeros(len(data) + 2, np.uint32)
    b[1:-1] = data
    before, middle, after = b[of], b[1:][of], b[2:][of]
    before[at] = 0
    after[at + size - 1] = 0
    before *= np.uint32(961)
    middle *= np.uint32(31)
    h = (before + middle + after) * np.uint32(2654435761)
    return Inputs(w.hashes, (h >> np.uint32(32 - CHAR_BITS)).astype(np.uint16), at, w.counts)


def joined(several: list[Inputs]) -> Inputs:
    before = np.cumsum([0, *(len(x.grams) for x in several[:-1])])
    return Inputs(*(np.concatenate([getattr(x, k) for x in several]) for k in ("hashes", "grams")), np.concatenate([x.at + n for x, n in zip(several, before, strict=True)]), np.concatenate([x.counts for x in several]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * 0.5) * 0.5 + 0.5


@dataclass
class Network:
    """Parameters by name; rows of gates are reset, update, candidate. Direction f reads forward, b backward."""

    p: dict[str, np.ndarray] = field(default_factory=dict)
    slope: float = 1.0
    shift: float = 0.0
    #: hash of each known word (the first stands for all others), and where a hash's leading bits say to look
    keys: np.ndarray = field(default_factory=lambda: np.zeros(1, np.uint64))
    slots: np.ndarray = field(default_factory=lambda: np.zeros(1 << SLOT_BITS, np.int32))

    @staticmethod
    def random(rng: np.random.Generator, known: np.ndarray) -> Network:
        """known: hashes of words, the most wanted first; of those that share a slot one is known."""
        size, h = WORD_SIZE + CHAR_SIZE, HIDDEN
        slots, keys = np.zeros(1 << SLOT_BITS, np.int32), np.append(np.uint64(0), known)
        slots[(known >> np.uint64(64 - SLOT_BITS)).astype(np.int64)[::-1]] = np.arange(len(known), 0, -1)
        p = {"word": rng.normal(0, 0.1, (len(keys), WORD_SIZE)), "char": rng.normal(0, 0.1, (1 << CHAR_BITS, CHAR_SIZE)), "bias": np.zeros(1)}
        for d in "fb":
            p |= {f"W{d}": rng.normal(0, size**-0.5, (3 * h, size)), f"U{d}": rng.normal(0, h**-0.5, (3 * h, h)), f"c{d}": np.zeros(3 * h)}
            p |= {f"a{d}": rng.normal(0, 0.1, h), f"u{d}": rng.normal(0, h**-0.5, h)}
        return Network(p, keys=keys, slots=slots)

    def words(self, hashes: np.ndarray) -> np.ndarray:
        """Places of words in the embedding, 0 for unknown ones."""
        at = self.slots[(hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
        return np.where(self.keys[at] == hashes, at, 0)

    def vectors(self, x: Inputs) -> np.ndarray:
        """Input of each word, as columns."""
        out = np.empty((WORD_SIZE + CHAR_SIZE, len(x.hashes)), np.float32)
        out[:WORD_SIZE] = self.p["word"].astype(np.float32, copy=False)[self.words(x.hashes)].T
        if len(x.hashes):
            sums = np.add.reduceat(self.p["char"].astype(np.float32, copy=False).take(x.grams, axis=0), x.at, axis=0)
            out[WORD_SIZE:] = (sums / np.diff(np.append(x.at, len(x.grams)))[:, None]).T
        return out

    def single(self) -> Network:
        return Network({k: v.astype(np.float32) for k, v in self.p.items()}, self.slope, self.shift, self.keys, self.slots)

    def logits(self, x: Inputs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """logit, document, first word (in its document) of every window. Documents without words have none."""
        groups = np.maximum(2, -(-x.counts // STRIDE)) * (x.counts > 0)
        start = np.cumsum(groups) - groups
        doc = np.repeat(np.arange(len(x.counts)), x.counts)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(x.counts) - x.counts, x.counts)
        place = start[doc] * STRIDE + nth
        total = int(groups.sum()) * STRIDE
        if not total:
            none = np.zeros(0, np.int64)
            return np.zeros(0, np.float32), none, none
        laid = np.zeros((WORD_SIZE + CHAR_SIZE, total), np.float32)
        laid[:, place] = self.vectors(x)
        real = np.zeros(total, bool)
        real[place] = True
        n = total // STRIDE - 1
        at = lambda a, t: a[..., t : t + n * STRIDE : STRIDE]  # noqa: E731  word t of all windows
        energy, value = np.zeros((2, WINDOW, n), np.float32)
        for d, steps in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
            drive = self.p[f"W{d}"] @ laid + self.p[f"c{d}"][:, None]
            h = np.zeros((HIDDEN, n), np.float32)
            for t in steps:
                v, g = at(drive, t), self.p[f"U{d}"] @ h
                gates = _sigmoid(v[: 2 * HIDDEN] + g[: 2 * HIDDEN])
                new = np.tanh(v[2 * HIDDEN :] + gates[:HIDDEN] * g[2 * HIDDEN :])
                h = new + gates[HIDDEN:] * (h - new)
                energy[t] += self.p[f"a{d}"] @ h
                value[t] += self.p[f"u{d}"] @ h
        for t in range(WINDOW):
            energy[t, ~at(real, t)] = -1e30
        weight = np.exp(energy - energy.max(axis=0))
        logit = (weight * value).sum(0) / weight.sum(0) + self.p["bias"][0]
        owner = np.repeat(np.arange(len(groups)), groups)
        whole = owner[:-1] == owner[1:]  # others would cross into the next document
        first = (np.arange(n) - start[owner[:-1]]) * STRIDE
        return logit[whole], owner[:-1][whole], first[whole]

    def scores(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logit + self.shift, -40, 40)))


def document_logits(net: Network, x: Inputs) -> np.ndarray:
    """The largest logit of each document; minus infinity without words."""
    out = np.full(len(x.counts), -np.inf)
    logit, doc, _ = net.logits(x)
    np.maximum.at(out, doc, logit)
    return out


def _all_logits(net: Network, several: list[Inputs]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """logits() of several parts in turn, documents numbered through."""
    before, out = 0, []
    for x in several:
        logit, doc, first = net.logits(x)
        out.append((logit, doc + before, first))
        before += len(x.counts)
    return tuple(np.concatenate(a) for a in zip(*out, strict=True))


def gradients(net: Network, word: np.ndarray, grams: list[np.ndarray], real: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Loss and its gradients over windows. word, real: WINDOW by windows; grams: trigram buckets of each cell, time first."""
    p, steps, n = net.p, WINDOW, len(y)
    lengths = np.array([len(g) for g in grams])
    flat = np.concatenate(grams) if lengths.sum() else np.zeros(0, np.int64)
    cell = np.repeat(np.arange(steps * n), lengths)
    chars = np.zeros((steps * n, CHAR_SIZE))
    np.add.at(chars, cell, p["char"][flat])
    chars /= np.maximum(lengths, 1)[:, None]
    x = np.concatenate((p["word"][word].reshape(steps * n, -1), chars), axis=1).reshape(steps, n, -1) * real[:, :, None]
    saved, energy, value = {}, np.zeros((steps, n)), np.zeros((steps, n))
    h_size = HIDDEN
    for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
        h, rows = np.zeros((n, h_size)), {}
        for t in order:
            drive, g = x[t] @ p[f"W{d}"].T + p[f"c{d}"], h @ p[f"U{d}"].T
            r, z = np.split(_sigmoid(drive[:, : 2 * h_size] + g[:, : 2 * h_size]), 2, axis=1)
            new = np.tanh(drive[:, 2 * h_size :] + r * g[:, 2 * h_size :])
            rows[t] = h, r, z, new, g[:, 2 * h_size :]
            h = new + z * (h - new)
            rows[t] += (h,)
            energy[t] += h @ p[f"a{d}"]
            value[t] += h @ p[f"u{d}"]
        saved[d] = rows
    energy = np.where(real, energy, -1e30)
    alpha = np.exp(energy - energy.max(axis=0))
    alpha /= alpha.sum(axis=0)
    pooled = (alpha * value).sum(0)
    logit = pooled + p["bias"][0]
    out = _sigmoid(logit)
    loss = float((weight * (np.logaddexp(0, logit) - y * logit)).sum())
    d_logit = weight * (out - y)
    d_value, d_energy = alpha * d_logit, alpha * (value - pooled) * d_logit
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    grads["bias"][0] = d_logit.sum()
    d_x = np.zeros_like(x)
    for d, order in (("f", range(steps - 1, -1, -1)), ("b", range(steps))):
        d_h = np.zeros((n, h_size))
        for t in order:
            before, r, z, new, g_new, h = saved[d][t]
            grads[f"u{d}"] += d_value[t] @ h
            grads[f"a{d}"] += d_energy[t] @ h
            d_h = d_h + np.outer(d_value[t], p[f"u{d}"]) + np.outer(d_energy[t], p[f"a{d}"])
            d_new = d_h * (1 - z) * (1 - new**2)
            d_gates = np.concatenate((d_new * g_new * r * (1 - r), d_h * (before - new) * z * (1 - z)), axis=1)
            d_g, d_drive = np.concatenate((d_gates, d_new * r), axis=1), np.concatenate((d_gates, d_new), axis=1)
            grads[f"U{d}"] += d_g.T @ before
            grads[f"W{d}"] += d_drive.T @ x[t]
            grads[f"c{d}"] += d_drive.sum(0)
            d_x[t] += d_drive @ p[f"W{d}"]
            d_h = d_h * z + d_g @ p[f"U{d}"]
    d_x = (d_x * real[:, :, None]).reshape(steps * n, -1)
    np.add.at(grads["word"], word.ravel(), d_x[:, :WORD_SIZE])
    np.add.at(grads["char"], flat, (d_x[:, WORD_SIZE:] / np.maximum(lengths, 1)[:, None])[cell])
    return loss, grads


def train(texts: list[str], labels: list[int], seed: int = 0) -> Network | None:
    """A network from texts and their labels, 0 or 1; None unless there are both."""
    y = np.array(labels)
    if len(set(labels)) < 2:
        return None
    rng = np.random.default_rng(seed)
    several = [read(part) for part in tokens.parts(pa.array([t.encode() for t in texts], pa.large_binary()))]
    x = joined(several)
    doc = np.repeat(np.arange(len(y)), x.counts)
    head = np.cumsum(x.counts) - x.counts
    gram_end = np.append(x.at, len(x.grams))
    # how much likelier a word is in texts of label 1, at the lower end of its confidence interval; the same word between
    # the same neighbours counts once, so that near copies don't add up
    vocabulary, word = np.unique(x.hashes, return_inverse=True)
    edge = np.zeros(1, np.uint64)
    between = tokens.mixed(np.append(edge, x.hashes[:-1]) + np.uint64(3) * x.hashes + np.uint64(7) * np.append(x.hashes[1:], edge))
    once = [np.unique(between[on], return_index=True)[1] for on in (y[doc] == k for k in (0, 1))]
    held = [np.bincount(word[y[doc] == k][at], minlength=len(vocabulary)) + 0.5 for k, at in enumerate(once)]
    odds = np.log(held[1] / (len(once[1]) + 1)) - np.log(held[0] / (len(once[0]) + 1)) - 2 * np.sqrt(1 / held[0] + 1 / held[1])
    odds = np.clip(odds, 0, 4)
    often = held[0] + held[1]
    known = np.lexsort((vocabulary, -often, -odds))
    net = Network.random(rng, vocabulary[known[often[known] >= LEAST + 1]])
    places = net.words(vocabulary)
    net.p["word"][places[places > 0], 0] = odds[places > 0] / 2
    odds, word = odds[word], places[word]

    def first_logits() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        groups = np.maximum(1, -(-np.maximum(x.counts - STRIDE, 0) // STRIDE)) * (x.counts > 0)
        owner = np.repeat(np.arange(len(y)), groups)
        first = (np.arange(len(owner)) - np.repeat(np.cumsum(groups) - groups, groups)) * STRIDE
        at = head[owner] + first
        return np.array([odds[a : min(a + WINDOW, head[o] + x.counts[o])].max() for a, o in zip(at, owner, strict=True)]), owner, first

    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for turn in range(ROUNDS):
        logit, owner, first = _all_logits(net.single(), several) if turn else first_logits()
        order = np.lexsort((-logit, owner))
        rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        # a text of label 1 without evidence so far may be mislabelled, and teaches nothing
        chosen = order[np.where(y[owner[order]] == 1, (rank < 3) & (logit[order] > 0), rank < 2)]
        other = rng.permutation(np.flatnonzero(y[owner] == 0))[: len(y)]
        chosen = np.unique(np.concatenate((chosen, other)))
        target = y[owner[chosen]].astype(float)
        # both classes weigh the same
        weigh = np.where(target == 1, 0.5 / max(1, (target == 1).sum()), 0.5 / max(1, (target == 0).sum())) * len(target)
        batches = max(1, len(chosen) // BATCH)
        for _ in range(max(EPOCHS, STEPS // batches)):
            for batch in np.array_split(rng.permutation(len(chosen)), batches):
                c, step = chosen[batch], step + 1
                at = head[owner[c]] + first[c] + np.arange(WINDOW)[:, None]
                real = at < head[owner[c]] + x.counts[owner[c]]
                at = np.where(real, at, 0)
                # some clean windows become one word again and again from some place on, as junk texts have it
                again = np.flatnonzero((target[batch] == 0) & (rng.random(len(c)) < 0.25))
                place = np.minimum(np.arange(WINDOW)[:, None], rng.integers(0, WINDOW // 2, len(again)))
                at[:, again], real[:, again] = at[place, again], real[place, again]
                cells = [x.grams[gram_end[a] : gram_end[a + 1]] if r else x.grams[:0] for a, r in zip(at.ravel(), real.ravel(), strict=True)]
                _, grads = gradients(net, word[at], cells, real, target[batch], weigh[batch] / len(batch))
                for k, (m, v) in moments.items():
                    g = grads[k] + 1e-4 * net.p[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    net.p[k] -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    final = np.concatenate([document_logits(net.single(), part) for part in several])
    known = np.isfinite(final)
    net.slope, net.shift = _logistic(final[known], y[known])
    return net.single()


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (0 at least) and shift of the logistic curve that fits y best, by damped Newton steps with a weak prior."""
    w, a = np.array([1.0, 0.0]), np.stack((x, np.ones_like(x)), axis=1)
    for _ in range(100):
        p = _sigmoid(a @ w)
        g = a.T @ (p - y) + 1e-3 * w
        w = w - 0.5 * np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + 1e-3 * np.eye(2), g)
    return max(0.0, float(w[0])), float(w[1])


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, sample: int = SAMPLE) -> Network | None:
    """docs: doc_id, text. labels: doc_id, toxic. The labelled texts are gathered by a join with the bounded sample."""
    marked = labels.select(F.col("doc_id").alias("labelled"), F.col("toxic").cast("int").alias("toxic")).where(learnable & F.col("toxic").isin(0, 1) & F.col("labelled").isNotNull())
    some = bounded_sample(marked, 2 * sample, [F.col("labelled")], F.col("toxic"))
    found = docs.where(F.length("text").between(1, LONGEST)).join(F.broadcast(some), F.col("doc_id") == F.col("labelled")).select("text", "toxic")
    # an id may stand for many texts: of these, a bounded number
    rows = found.dropDuplicates().orderBy(F.xxhash64("text"), "toxic").limit(8 * sample).collect()
    rows.sort(key=lambda r: (r["text"], r["toxic"]))
    texts = {r["text"]: r["toxic"] for r in rows}
    return train(list(texts), list(texts.values()))


def long_logit(net: Network, data: np.ndarray, piece: int) -> float:
    """document_logits() of one document's bytes, about `piece` of them at a time.

    A piece ends after a whole number of strides, and the next one begins with its last stride; so all pieces together
    have the document's windows.
    """
    best, lo, size = -np.inf, 0, len(data)
    step = piece
    while True:
        hi = min(size, lo + step)
        w = tokens.words(_PLAIN[data[lo:hi]], np.array([hi - lo]))
        if hi < size:
            strides = int(np.searchsorted(w.ends, hi - lo)) // STRIDE  # of words that end before the piece does
            if strides < 3:  # long words
                step *= 2
                continue
            hi = lo + int(w.ends[strides * STRIDE - 1])
        if len(w.starts) > STRIDE or not lo:  # else what is left was in the piece before
            best = max(best, float(document_logits(net, read(tokens.Part(0, data[lo:hi], np.array([hi - lo]))))[0]))
        if hi == size:
            return best
        lo, step = lo + int(w.starts[(strides - 1) * STRIDE]), piece


def _score(model: Network | None, column: pa.Array, piece: int = 1 << 18) -> np.ndarray:
    out = np.zeros(len(column))
    if model:
        for part in tokens.parts(column, piece):
            logit = np.array([long_logit(model, part.data, piece)]) if len(part.data) > 2 * piece else document_logits(model, read(part))
            out[part.first : part.first + len(logit)] = np.where(np.isfinite(logit), model.scores(logit), 0.0)
    return out


def score(docs: DataFrame, labels: DataFrame, modulus: int = 3, rest: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; rows whose crc of doc_id leaves rest are not learned from."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, crc_mod(F.col("labelled"), modulus) != rest))
    rows = docs.select("doc_id", (crc_mod(F.col("doc_id"), modulus) == rest).alias("held_out"), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _score(shared.value, batch.column(2))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below threshold, with all their columns. All labels are learned from."""
    model = learn(docs.select("doc_id", F.col("text").cast("string").alias("text")), labels, F.lit(True))
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_score(shared.value, batch.column(place).cast(pa.binary())) < threshold))

    return docs.mapInArrow(run, docs.schema)
