"""Language identification by a byte convolutional network, trained here in numpy.

A text's bytes (A-Z lower-cased) are cut into windows of LENGTH bytes that overlap by the widest filter less one, so
that every filter sees every place of the text in exactly one window; the last window is filled up with zeros. Filters
of two, three and four bytes, as tables of weights by byte, are followed by a maximum over the window, a rectifier and
softmax. A text's prediction is the language with the largest mean of its windows' logits, weighted by their bytes.

For scoring, pairs of neighbouring bytes index summed tables, so a filter of four bytes costs two lookups.

Learning uses a bounded sample of labelled rows (SAMPLE different texts in equal shares for the LANGUAGES languages, a
window of each at a hashed place); scoring covers whole texts. Learning never sees held-out rows.

Defined cases: null texts and texts without a letter are `und` with score 0; if nothing can be learned from, all are;
rows of null lang are scored but not learned from; repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm import tokens
from rivulet.llm.common import bounded_sample, crc_mod

LENGTH = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
#: Most labelled rows that are learned from, and passes over them.
SAMPLE = 3000
#: Most languages that are told apart, those with the most texts.
LANGUAGES = 64
EPOCHS = 6
STEP = LENGTH - max(WIDTHS) + 1
#: Bytes that are scored at a time, also of one text.
PIECE = 1 << 19


def windows(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row of LENGTH bytes for each window, its document, its bytes that belong to no earlier window."""
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    sizes = ends - starts
    count = np.maximum(1, -(-(sizes - (LENGTH - STEP)) // STEP))
    doc = np.repeat(np.arange(len(ends)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    left = sizes[doc] - nth * STEP
    at = (starts[doc] + nth * STEP)[:, None] + np.arange(LENGTH)
    padded = np.append(data, np.uint8(0))
    rows = padded[np.minimum(at, len(data))]
    rows[np.arange(LENGTH) >= left[:, None]] = 0
    return rows, doc, np.clip(left, 0, STEP)


@dataclass
class Network:
    """tables[width][place]: 256 rows of FILTERS weights; bias, out and out_bias end it."""

    languages: list[str]
    tables: dict[int, np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pairs(self) -> dict[int, list[np.ndarray]]:
        """For each width, tables by two bytes, and one by a single byte at the end of an odd width."""
        return {
            w: [(t[k][:, None] + t[k + 1][None]).reshape(65536, FILTERS).astype(np.float32) if k + 1 < w else t[k].astype(np.float32) for k in range(0, w, 2)]
            for w, t in self.tables.items()
        }

    def logits(self, rows: np.ndarray, pairs: dict[int, list[np.ndarray]], most: int = 64) -> np.ndarray:
        out = np.empty((len(rows), len(self.languages)), np.float32)
        for lo in range(0, len(rows), most):
            part = rows[lo : lo + most]
            two = part[:, :-1].astype(np.int64) * 256 + part[:, 1:]
            pooled = []
            for w, tables in pairs.items():
                n = LENGTH - w + 1
                acts = tables[0].take(two[:, :n], axis=0)
                for k, table in enumerate(tables[1:], 1):
                    acts += table.take((two if 2 * k + 1 < w else part)[:, 2 * k : 2 * k + n], axis=0)
                pooled.append(acts.max(axis=1))
            out[lo : lo + most] = np.maximum(np.hstack(pooled) + self.bias, 0) @ self.out + self.out_bias
        return out


def train(rows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = 0) -> Network:
    """rows: a window each; labels: places in languages. Adam on the cross-entropy, in batches of 64."""
    rng = np.random.default_rng(seed)
    n = len(languages)
    net = Network(languages, {w: rng.normal(0, 0.1, (w, 256, FILTERS)) for w in WIDTHS}, np.zeros(FILTERS * len(WIDTHS)), rng.normal(0, 0.3, (FILTERS * len(WIDTHS), n)), np.zeros(n))
    params = [*net.tables.values(), net.bias, net.out, net.out_bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
            x, y, step = rows[batch].astype(np.int64), labels[batch], step + 1
            pooled, places = [], []
            for w, table in net.tables.items():
                acts = sum(table[k][x[:, k : LENGTH - w + 1 + k]] for k in range(w))
                at = acts.argmax(axis=1)
                places.append(at)
                pooled.append(np.take_along_axis(acts, at[:, None], axis=1)[:, 0])
            raw = np.hstack(pooled) + net.bias
            hidden = np.maximum(raw, 0)
            logits = hidden @ net.out + net.out_bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            d = p / p.sum(axis=1, keepdims=True)
            d[np.arange(len(y)), y] -= 1
            d /= len(y)
            d_raw = (d @ net.out.T) * (raw > 0)
            grads = []
            for i, (w, table) in enumerate(net.tables.items()):
                g, own = np.zeros_like(table), d_raw[:, i * FILTERS : (i + 1) * FILTERS]
                for k in range(w):
                    np.add.at(g[k], (x[np.arange(len(y))[:, None], places[i] + k], np.arange(FILTERS)), own)
                grads.append(g)
            for p, g, (m, v) in zip(params, [*grads, d_raw.sum(0), hidden.T @ d, d.sum(0)], moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def predict(net: Network, pairs: dict[int, list[np.ndarray]], column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """place of the language, probability for each text of a binary column."""
    best, score = np.zeros(len(column), np.int64), np.zeros(len(column))

    def sums(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each document, the weighted sum of its windows' logits, and of their weights."""
        rows, doc, weight = windows(tokens.LOWER[data], ends)
        logits = net.logits(rows, pairs)
        return np.stack([np.bincount(doc, weight * x, len(ends)) for x in (*logits.T, np.ones(len(doc)))], axis=1)

    for part in tokens.parts(column, PIECE):
        if len(part.data) > 2 * PIECE:  # one long document: some of its windows at a time
            step, size = PIECE // STEP * STEP, len(part.data)
            starts = range(0, max(1, size - (LENGTH - STEP)), step)
            pieces = (part.data[lo : lo + step + LENGTH - STEP] for lo in starts)
            total = sum(sums(data, np.array([len(data)])) for data in pieces)
        else:
            total = sums(part.data, part.ends)
        mean = total[:, :-1] / np.maximum(total[:, -1:], 1)
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        here = slice(part.first, part.first + len(part.ends))
        best[here], score[here] = mean.argmax(axis=1), (p / p.sum(axis=1, keepdims=True)).max(axis=1)
    return best, score


def learn(docs: DataFrame, learnable: Column, sample: int = SAMPLE) -> Network | None:
    """A network from a bounded sample of the learnable rows; None if none has a language."""
    known = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    size = F.length("text")
    start = F.pmod(F.xxhash64(F.lit("window"), F.col("text")), F.greatest(size - LENGTH, F.lit(1)))
    # every fourth window is cut short, for the network to know short texts too
    length = F.when(F.pmod(F.xxhash64(F.lit("short"), F.col("text")), F.lit(4)) == 0, 40).otherwise(LENGTH)
    cut = known.select("lang", F.xxhash64("text").alias("text_hash"), F.substring("text", (start + 1).cast("int"), length.cast("int")).alias("text"))
    got = bounded_sample(cut, sample, [F.col("text_hash"), F.col("lang")], F.col("lang"), LANGUAGES).select("lang", "text").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["lang"], r["text"]))
    languages = sorted({r["lang"] for r in got})
    cut = [r["text"].encode()[:LENGTH] for r in got]
    rows = np.zeros((len(got), LENGTH), np.uint8)
    for i, b in enumerate(cut):
        rows[i, : len(b)] = tokens.LOWER[np.frombuffer(b, np.uint8)]
    return train(rows, np.array([languages.index(r["lang"]) for r in got]), languages)


def identify(docs: DataFrame, modulus: int = 4, rest: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row; rows whose crc of doc_id leaves rest are not learned from."""
    held_out = crc_mod(F.col("doc_id"), modulus) == rest
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    net = learn(docs, ~held_out)
    rows = docs.select("doc_id", held_out.alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), F.col("text").cast("binary").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        pairs = model.pairs() if model else {}
        names = np.array([*(model.languages if model else ()), "und"], object)
        for batch in batches:
            place, score = predict(model, pairs, batch.column(3)) if model else (np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows))
            known = np.asarray(batch.column(2)) & bool(model)
            columns = [batch.column(0), batch.column(1), pa.array(names[np.where(known, place, -1)], pa.string()), pa.array(np.where(known, score, 0.0))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
