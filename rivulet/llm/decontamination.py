"""Benchmark decontamination: SimHash over item-sized windows, a multi-index of Hamming blocks, an exact verdict.

A document is contaminated by a benchmark item of n words if a window of n of its words (all of them, if it has fewer)
has a weighted similarity of 0.8 or more with it: over five-word shingles weighted by their number, the sum of the
smaller weights divided by the sum of the larger. Texts of fewer than five words are one shingle.

1. Windows. Each window of each size that items have gets a 64-bit SimHash of its shingles, from running sums of their
   hash bits. Windows are passed over (`skip`) if fewer of their shingles occur in any item at all than a similar window
   would share with one: this knows no items, misses no similar window, and changes no result but the time.
2. Multi-index. The fingerprint's eight bytes are looked up in eight tables: the items of the window's size in order of
   a byte's value, each also under the values that differ from its byte in two bits at most. Of two fingerprints within
   RADIUS = 23 bits, some byte differs in two bits at most, so all items within the radius are found; the others that
   share an entry go by their full distance. Similarity 0.8 means a cosine of 0.89 and so 9.7 differing bits on average,
   with deviation 2.9: the radius lies more than 4.5 deviations above.
3. Verdict. The exact similarity, from the words themselves, of the window and each item that the index gives.

Different items are held in memory in blocks of about BLOCK_WORDS words, one pass over the documents for each, so what
is broadcast is bounded. The documents are not shuffled.

Defined cases: null and empty texts, and items of no words, match nothing; letters A-Z count as lower case; repeated
rows match each, repeated items once; an empty table of either kind gives an empty result; of equally similar windows the
first counts.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm import tokens

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 23
BLOCK_WORDS = 1_000_000
_WINDOWS = 1 << 13

#: The byte values that differ from 0 in as many bits as a block of fingerprints within the radius may.
_NEAR = np.array([i for i in range(256) if i.bit_count() <= RADIUS // 8], np.uint8)


def shingles(words: list[bytes]) -> Counter:
    """Weights of the shingles of a text's words."""
    if len(words) < SHINGLE:
        return Counter([tuple(words)] if words else [])
    return Counter(tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1))


def similarity(a: Counter, b: Counter) -> float:
    shared = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return shared / (sum(a.values()) + sum(b.values()) - shared) if shared else 0.0


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _simhash(ones: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """The eight bytes of fingerprints: bits set in over half of n hashes. ones: a row of 64 counts each."""
    return np.packbits(ones * 2 > np.reshape(n, (-1, 1)), axis=1, bitorder="little")


@dataclass
class Table:
    """The items of a size: their places, fingerprints, and for each byte the items by value, from starts on."""

    items: np.ndarray
    fps: np.ndarray
    starts: np.ndarray
    entries: np.ndarray

    @staticmethod
    def of(items: np.ndarray, fps: np.ndarray) -> Table:
        """fps: a row of eight bytes for each item."""
        values = (fps.T[:, :, None] ^ _NEAR).reshape(8, -1)
        order = np.argsort(values, axis=1, kind="stable")
        starts = np.array([np.searchsorted(v[o], np.arange(257)) for v, o in zip(values, order, strict=True)])
        return Table(items, np.ascontiguousarray(fps).view(np.uint64).ravel(), starts, order // len(_NEAR))

    def near(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """window, item, distance for all items within RADIUS of a window's fingerprint."""
        pairs = []
        for k in range(8):
            lo, hi = self.starts[k, fps[:, k]], self.starts[k, fps[:, k].astype(np.int64) + 1]
            times = hi - lo
            window = np.repeat(np.arange(len(fps)), times)
            entry = np.arange(len(window)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo, times)
            pairs.append(window * len(self.items) + self.entries[k, entry])
        window, item = np.divmod(np.unique(np.concatenate(pairs)), len(self.items))
        distance = np.bitwise_count(np.ascontiguousarray(fps).view(np.uint64).ravel()[window] ^ self.fps[item])
        at = np.flatnonzero(distance <= RADIUS)
        return window[at], self.items[item[at]], distance[at]


class Index:
    """Items by size and fingerprint byte."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, skip: bool = True):
        self.threshold, self.skip = threshold, skip
        self.ids: list[int] = []
        self.weights: list[Counter] = []
        of_size, hashes = defaultdict(list), defaultdict(list)
        for item_id, text in items:
            data = tokens.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
            w = tokens.words(data, np.array([len(data)]))
            n = len(w.starts)
            if not n:
                continue
            raw = data.tobytes()
            h, _ = tokens.grams(w, min(SHINGLE, n))
            hashes[min(SHINGLE, n)].append(np.unique(h))
            of_size[n].append((len(self.ids), _simhash(_bits(h).sum(0, keepdims=True), len(h))[0]))
            self.ids.append(item_id)
            self.weights.append(shingles([raw[s:e] for s, e in zip(w.starts, w.ends, strict=True)]))
        #: by size of a shingle: the shingles of all items, in order
        self.shingles = {length: np.unique(np.concatenate(h)) for length, h in hashes.items()}
        self.tables = {n: Table.of(np.array([i for i, _ in own]), np.array([fp for _, fp in own], np.uint8)) for n, own in of_size.items()}

    def matches(self, part: tokens.Part) -> list[tuple[int, int, int, int, float, int]]:
        """document (its place in the part), item, first word, words, similarity, distance: the best window of each pair."""
        data = tokens.mapped(part.data, tokens.LOWER)
        w = tokens.words(data, part.ends)
        heads = np.cumsum(w.counts) - w.counts
        best: dict[tuple[int, int], tuple[float, int, int, int]] = {}
        for length, own in self.shingles.items():
            h, at = tokens.grams(w, length)
            if not len(h):
                continue
            place = np.searchsorted(own, h)
            known = own[np.minimum(place, len(own) - 1)] == h
            for size, first, count, fps in self._windows(h, w.doc[at], known, length):
                for k, i, distance in zip(*self.tables[size].near(fps), strict=True):
                    s = int(at[first[k]])
                    e = s + int(count[k]) + length - 1
                    words = [data[a:b].tobytes() for a, b in zip(w.starts[s:e], w.ends[s:e], strict=True)]
                    if (sim := similarity(shingles(words), self.weights[i])) >= self.threshold:
                        doc = int(w.doc[s])
                        now = (sim, -(s - int(heads[doc])), e - s, int(distance))
                        best[doc, i] = max(now, best.get((doc, i), now))
        return [(doc, self.ids[i], -first, n, sim, distance) for (doc, i), (sim, first, n, distance) in sorted(best.items())]

    def _windows(self, h: np.ndarray, doc: np.ndarray, known: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """By item size: first shingle, number of shingles and fingerprint of windows, some at a time.

        h, doc, known: of each shingle, in order; known ones occur in some item.
        """
        sizes = {n: n - length + 1 for n in self.tables if min(SHINGLE, n) == length}
        most = max(sizes.values())
        running = np.concatenate(([0], np.cumsum(known)))
        first_of = np.searchsorted(doc, doc)  # of a shingle's document
        left = np.searchsorted(doc, doc, side="right") - np.arange(len(doc))  # shingles to the document's end
        starts = np.arange(len(h))
        if self.skip:  # nothing known before the longest window's end
            starts = np.flatnonzero(running[np.minimum(starts + most, len(h))] > running[:-1])
        for lo in range(0, len(starts), _WINDOWS):
            here = starts[lo : lo + _WINDOWS]
            sums = _Sums(h, here, most)
            for n, grams in sizes.items():
                count = np.minimum(grams, left[here])
                fits = (count == grams) | (first_of[here] == here)  # a shorter document is one window
                # c shared of count and grams shingles: c / (both - c) >= threshold
                need = np.ceil(self.threshold / (1 + self.threshold) * (count + grams) - 1e-9)
                if self.skip:
                    fits &= running[here + count] - running[here] >= need
                else:
                    fits &= count >= need
                if fits.any():
                    yield n, here[fits], count[fits], sums.fingerprints(here[fits], count[fits])


class _Sums:
    """Running sums of the hash bits of the shingles from starts on, most of each."""

    def __init__(self, h: np.ndarray, starts: np.ndarray, most: int):
        self.lowest = int(starts[0])
        covered = np.zeros(min(int(starts[-1]) + most, len(h)) - self.lowest + 1, np.int32)
        np.add.at(covered, starts - self.lowest, 1)
        np.add.at(covered, np.minimum(starts - self.lowest + most, len(covered) - 1), -1)
        inside = np.cumsum(covered)[:-1] > 0
        self.rank = np.concatenate(([0], np.cumsum(inside)))
        self.ones = np.zeros((self.rank[-1] + 1, 64), np.int32)
        np.cumsum(_bits(h[self.lowest : self.lowest + len(inside)][inside]), axis=0, out=self.ones[1:])

    def fingerprints(self, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        at = first - self.lowest
        return _simhash(self.ones[self.rank[at + count]] - self.ones[self.rank[at]], count)


def _blocks(items: DataFrame) -> Iterator[Index]:
    """Indexes over blocks of the items."""
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    items = items.select("item_id", "text").where(words > 0).distinct()
    n = -(-(items.select(F.sum(words)).first()[0] or 0) // BLOCK_WORDS)
    for k in range(n):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        yield Index([(r["item_id"], r["text"]) for r in block.select("item_id", "text").collect()])


def find(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity, distance for each contaminated document and item.

    items: item_id long, text. start_word counts from 0.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id long, start_word int, n_words int, similarity double, distance int"

    def scan(index: Index) -> DataFrame:
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(part.first + doc, *rest) for part in tokens.parts(batch.column(1)) for doc, *rest in shared.value.matches(part)]
                if found:
                    doc, *rest = zip(*found, strict=True)
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32())
                    columns = [batch.column(0).take(pa.array(doc, pa.int64())), *(pa.array(x, t) for x, t in zip(rest, kinds, strict=True))]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "start_word", "n_words", "similarity", "distance"])

        return rows.mapInArrow(run, schema)

    scans = [scan(index) for index in _blocks(items)]
    return reduce(DataFrame.union, scans) if scans else spark.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that no item contaminates, with all their columns."""
    spark, place = docs.sparkSession, docs.columns.index("text")
    for index in _blocks(items):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for part in tokens.parts(batch.column(place).cast(pa.binary())):
                    keep[[part.first + m[0] for m in shared.value.matches(part)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
