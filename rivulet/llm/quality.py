"""A quality classifier on random Fourier features of document statistics.

One pass over the texts makes FEATURES statistics of each document (shares of kinds of characters, sizes, repeated lines,
words and phrases); everything after works on these. They are standardised by their mean and deviation over all
documents and mapped to RANDOM cosines, whose inner products approximate a Gaussian kernel. Ridge regression of the
labels on the cosines needs only the normal equations, which each partition of the learning rows sums for itself;
the sums are added up in a tree whose nodes have FAN children, and solved on the driver. Isotonic regression on the
learning rows' predictions, counted in BINS bins, turns predictions into probabilities.

All labelled rows but the held-out ones are learned from. Scores do not depend on doc_id, source or lang.

Defined cases: null texts count as empty and get the score that their statistics get; if nothing can be learned from,
every score is 0.5; rows with several labels learn from each, null labels are ignored; repeated rows are scored
alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm import tokens
from rivulet.llm.common import checkpoint, crc_mod

RANDOM = 192
BINS = 2000
RIDGE = 1e-4
THRESHOLD = 0.3
#: A task or the driver adds up the sums of this many partitions or tasks at most.
FAN = 32

#: Kinds of characters whose shares are statistics.
KINDS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'\"", b"!", b"#$%&*@^~=+<>_\\/{}[]", b"|", b"\n", bytes(range(128, 256)))
_KIND = np.zeros(256, np.uint8)
for _k, _of in enumerate(KINDS, 1):
    _KIND[list(_of)] = _k
FEATURES = len(KINDS) + 10
#: Lines as words: the line's end is the only byte that does not join them.
_LINES = np.array([32 if b == 10 else 0 if b in (9, 11, 12, 13, 32) else b for b in range(256)], np.uint8)


def _distinct(doc: np.ndarray, h: np.ndarray, docs: int) -> np.ndarray:
    """How many different hashes each document has."""
    if docs == 1:
        return np.array([len(np.unique(h))])
    # not the mixed number of a document, which is the hash of a word of one byte
    first = np.unique(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True)[1]
    return np.bincount(doc[first], minlength=docs)


def _shares(kind: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many bytes of each kind but 0 each document has, counted some bytes at a time."""
    total = np.zeros((len(ends), len(KINDS) + 1), np.int64)
    for lo in range(0, len(kind), tokens.PIECE):
        some = kind[lo : lo + tokens.PIECE]
        doc_of = np.repeat(np.arange(len(ends)), np.diff(np.clip(ends, lo, lo + len(some)), prepend=lo))
        total += np.bincount(doc_of * (len(KINDS) + 1) + some, minlength=total.size).reshape(total.shape)
    return total[:, 1:]


def statistics(part: tokens.Part) -> np.ndarray:
    """A row of statistics for each document of the part."""
    docs, raw = len(part.ends), part.data
    starts = np.concatenate(([0], part.ends[:-1])).astype(np.int64)
    size = (part.ends - starts).astype(np.float64)
    some = np.maximum(size, 1)
    kind = tokens.mapped(raw, _KIND)
    shares = _shares(kind, part.ends)
    low = tokens.mapped(raw, tokens.LOWER)
    w = tokens.words(low, part.ends)
    count = np.maximum(w.counts, 1)
    length = w.ends - w.starts
    upper = np.concatenate((np.zeros(1, np.int32), np.cumsum(kind == 1, dtype=np.int32)))  # a column holds less than 2 GB
    capitals = upper[w.ends] - upper[w.starts]
    shouted = (capitals >= 2) & (capitals * 2 > length)
    del upper, capitals
    lines = tokens.words(tokens.mapped(low, _LINES), part.ends)
    line_count = np.maximum(lines.counts, 1)
    g, at = tokens.grams(w, 3)
    gram_doc = w.doc[at]
    gram_count = np.bincount(gram_doc, minlength=docs)
    twice = np.zeros(len(w.hashes), bool)
    twice[1:] = (w.hashes[1:] == w.hashes[:-1]) & (w.doc[1:] == w.doc[:-1])
    per_doc = lambda x: np.bincount(w.doc, x, docs)
    return np.column_stack(
        (
            shares / some[:, None],
            np.log1p(size),
            np.log1p(w.counts),
            per_doc(length) / count,
            np.log1p(np.sqrt(np.maximum(per_doc(length.astype(np.float64) ** 2) / count - (per_doc(length) / count) ** 2, 0))),
            per_doc(shouted) / count,
            np.log1p(w.counts / line_count),
            1 - _distinct(lines.doc, lines.hashes, docs) / line_count,
            1 - _distinct(w.doc, w.hashes, docs) / count,
            1 - _distinct(gram_doc, g, docs) / np.maximum(gram_count, 1),
            per_doc(twice) / count,
        )
    )


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [statistics(p) for p in tokens.parts(batch.column(1), 1 << 18)]
        x = np.concatenate(found) if found else np.zeros((0, FEATURES))
        values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), values], names=["doc_id", "x"])


def _rows(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, FEATURES)


class Cosines:
    """Random Fourier features of a Gaussian kernel over standardised statistics."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, size: int = RANDOM, width: float = 4.0, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-12, deviation, 1.0)
        self.w, self.b = rng.normal(0, 1 / width, (len(mean), size)), rng.uniform(0, 2 * np.pi, size)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.sqrt(2 / len(self.b)) * np.cos(np.clip((x - self.mean) / self.deviation, -8, 8) @ self.w + self.b)
        return np.column_stack((z, np.ones(len(x))))


def isotonic(count: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the nondecreasing shares of ones that fit bins in order best."""
    blocks: list[list[float]] = []
    for n, k in zip(count, ones, strict=True):
        blocks.append([n, k, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.repeat([k / n for n, k, _ in blocks], [int(m) for _, _, m in blocks])


def _bin(y: np.ndarray) -> np.ndarray:
    """Bins of predictions from -0.5 to 1.5."""
    return np.clip((y + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int64)


def fit(stats: DataFrame, labels: DataFrame) -> tuple[Cosines, np.ndarray, np.ndarray, np.ndarray] | None:
    """stats: doc_id, x (read several times). labels: doc_id, y. Cosines, weights, bins and their probabilities."""
    spark = stats.sparkSession
    moments = stats.select(*(f(F.col("x")[i]).alias(f"{n}{i}") for i in range(FEATURES) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    # a row for each row of stats, however many labels its doc_id has
    counted = labels.groupBy("doc_id").agg(F.count("y").alias("n"), F.sum("y").alias("ones"))
    marked = checkpoint(stats.join(counted, "doc_id").select("x", "n", "ones"))
    if moments["m0"] is None or marked.isEmpty():
        return None
    cosines = spark.sparkContext.broadcast(Cosines(np.array([moments[f"m{i}"] for i in range(FEATURES)]), np.array([moments[f"s{i}"] for i in range(FEATURES)])))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((RANDOM + 1, RANDOM + 2)), False
        for batch in batches:
            z, n, ones, some = cosines.value(_rows(batch.column(0))), np.asarray(batch.column(1), np.float64), np.asarray(batch.column(2), np.float64), True
            total += z.T @ np.column_stack((z * n[:, None], ones))
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def added(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "sums": pa.array([sum(np.frombuffer(b.as_py()) for b in table.column("sums")).tobytes()], pa.binary())})

    parts = marked.rdd.getNumPartitions()
    tree = marked.select("x", "n", "ones").mapInArrow(sums, "sums binary").withColumn("part", F.spark_partition_id().cast("long"))
    while parts > FAN:
        tree = tree.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part").applyInArrow(added, "part long, sums binary")
        parts = -(-parts // FAN)
    total = sum(np.frombuffer(r["sums"]) for r in tree.select("sums").collect()).reshape(RANDOM + 1, RANDOM + 2)
    n = total[-1, -2]
    weights = np.linalg.solve(total[:, :-1] + RIDGE * n * np.eye(RANDOM + 1), total[:, -1])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _bin(cosines.value(_rows(batch.column(0))) @ weights)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1), batch.column(2)], names=["bin", "n", "ones"])

    bins = sorted(marked.mapInArrow(binned, "bin long, n long, ones long").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).collect())
    share = isotonic(np.array([r["n"] for r in bins], float), np.array([r["ones"] for r in bins], float))
    return cosines.value, weights, np.array([r["bin"] for r in bins]), share


def score(docs: DataFrame, labels: DataFrame, modulus: int = 5, rest: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; rows whose crc of doc_id leaves rest are not learned from."""
    rows = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    stats = checkpoint(rows.mapInArrow(_statistics, f"doc_id {kind}, x array<double>"))
    marked = labels.where((crc_mod(F.col("doc_id"), modulus) != rest) & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("y"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(stats, marked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            s = np.full(batch.num_rows, 0.5)
            if model:
                cosines, weights, bins, share = model
                s = np.clip(np.interp(_bin(cosines(_rows(batch.column(2))) @ weights), bins, share), 0, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held_out = stats.select("doc_id", (crc_mod(F.col("doc_id"), modulus) == rest).alias("held_out"), "x")
    return held_out.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
