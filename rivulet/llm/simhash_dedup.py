"""SimHash near-duplicates by a segment-popcount embedding.

A text's fingerprint has a bit for each bit that over half of its shingles' XXH64 hashes set. Fingerprints link when
at most RADIUS bits differ. The 64 bits are cut into 32 segments of two, and a fingerprint is mapped to the number of
ones in each: a point of a grid. The Manhattan distance of two points is at most the number of differing bits, so
links join points within RADIUS of each other:

* The segments form five blocks. Two points within distance 2 differ in two blocks at most and so agree in three: each
  point is put in ten cells, one for each choice of three blocks, and points that share no cell need no look.
* Cells of more than CELL points are cut by the next level: another division of the segments into five blocks, of which
  two near points agree in three as well. After three levels, cells fix all but about two segments' counts. Points of
  equal counts may still be many different fingerprints; cells that stay crowded are cut by the same three divisions of
  the fingerprints' bits themselves, which leave a few fingerprints each.
* In a cell, pairs are formed, kept if their Manhattan distance is at most RADIUS (counted in unary codes by one xor), and
  verified by the number of differing bits. So a group of near copies costs its pairs within a few segments, not the
  square of its size.

Only different fingerprints take part, each once with its smallest doc_id, so exact copies never meet in one task. The
components of the links then give each document its class.

Defined cases: a text of no words (null and empty included) has fingerprint zero, linked like any other; one or two
words make one shingle; repeated rows are returned once each; rows of null doc_id belong to their group without naming
it, and component_id is null only if nothing of the group has a doc_id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm import resemblance
from rivulet.llm.common import checkpoint
from rivulet.llm.graph import components

#: Words of a shingle, the seed of XXH64, bits that may differ.
SHINGLE = 3
SEED = 42
RADIUS = 2
#: Most points of a cell that is not cut further.
CELL = 24

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A byte's bits, lowest first, each in a byte of its own.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
_PART = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of UTF-8 text as an unsigned integer."""
    import xxhash

    digest, join = xxhash.xxh64_intdigest, b" ".join
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    grams = zip(*(words[k:] for k in range(shingle)), strict=False) if len(words) >= shingle else [words]
    ones, n = np.zeros(64, np.int64), max(1, len(words) - shingle + 1)
    for at in range(0, n, _PART):  # bounded memory for very long texts
        size = min(_PART, n - at)
        h = np.fromiter((digest(join(gram), SEED) for _, gram in zip(range(size), grams, strict=False)), np.uint64, size)
        lanes = np.add.reduceat(_SPREAD[h.view(np.uint8).reshape(-1, 8)], np.arange(0, size, 255), axis=0)
        ones += lanes.view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        fps = np.fromiter((fingerprint(t.as_buffer().to_pybytes()) if t.is_valid else 0 for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) for each row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _with_wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = next(_fingerprints(iter((batch,))))
        yield pa.RecordBatch.from_arrays([*fps.columns, pa.array(resemblance.wholes(batch.column(1)))], names=["doc_id", "fp", "whole"])


def embed(fp: Column) -> Column:
    """Ones of each two-bit segment in unary: 00, 01, 11. The xor of two codes has as many ones as their distance."""
    low, high = fp.bitwiseAND(F.lit(0x5555555555555555)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(0x5555555555555555))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _masks(block: Callable[[int], int]) -> list[int]:
    """A 64-bit mask for each choice of three of five blocks, signed. block: of each segment."""
    own = [sum(3 << 2 * s for s in range(32) if block(s) == k) for k in range(5)]
    return [(m ^ (1 << 63)) - (1 << 63) for m in (sum(own[i] for i in c) for c in combinations(range(5), 3))]


#: Divisions of the segments into five blocks; two blocks of each have about two segments in common.
DIVISIONS = [_masks(lambda s: s // 7), _masks(lambda s: s % 5), _masks(lambda s: (s // 7 + s) % 5)]


def links(fps: DataFrame, cell_points: int = CELL) -> DataFrame:
    """a, b: all links between different fingerprints that are within RADIUS bits.

    fps: distinct fp; it is read twice.
    """
    cells, found = fps.select("fp", embed(F.col("fp")).alias("p"), F.lit(0).cast("long").alias("cell")), []
    levels = [(code, masks) for code in ("p", "fp") for masks in DIVISIONS]
    for code, masks in levels:
        choices = F.array(*(F.xxhash64(F.col("cell"), F.lit(i), F.col(code).bitwiseAND(F.lit(m))) for i, m in enumerate(masks)))
        cells = cells.select("fp", "p", F.explode(choices).alias("cell"))
        shared = checkpoint(cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"))
        met = checkpoint(cells.join(shared, "cell"))
        last = (code, masks) == levels[-1]
        small = met if last else met.where(F.col("n") <= cell_points)
        l, r = small.alias("l"), small.alias("r")
        pairs = l.join(
            r,
            (F.col("l.cell") == F.col("r.cell"))
            & (F.col("l.fp") < F.col("r.fp"))
            & (F.bit_count(F.col("l.p").bitwiseXOR(F.col("r.p"))) <= RADIUS)
            & (F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= RADIUS),
        )
        found.append(pairs.select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b")))
        cells = met.where(F.col("n") > cell_points).select("fp", "p", "cell")
        if last or cells.isEmpty():
            break
    return reduce(DataFrame.union, found).distinct()


def _named(fps: DataFrame, cell_points: int, more: DataFrame | None = None) -> DataFrame:
    """fp, root (the smallest fingerprint of its component), component_id for each fingerprint. more: further links."""
    groups = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = links(groups.select("fp"), cell_points)
    roots = components(found.union(more) if more else found, "a", "b")
    rooted = checkpoint(groups.join(roots, groups.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    others = rooted.where("root <> fp").groupBy("root").agg(F.min("first").alias("other"))
    whole = checkpoint(rooted.where("root = fp").join(others, "root", "left").select("root", F.least("first", "other").alias("component_id")))
    return checkpoint(rooted.select("fp", "root").join(whole, "root").select("fp", "root", "component_id"))


def classes(fps: DataFrame, cell_points: int = CELL) -> DataFrame:
    """Adds component_id to doc_id, fp; fps is read several times."""
    return fps.join(_named(fps, cell_points).drop("root"), "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of docs."""
    fps = checkpoint(fingerprints(docs, doc_id, text))
    return classes(fps).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each component, one of its smallest doc_id, with all its columns.

    Besides near fingerprints, texts of similarity 0.8 or more over five-word shingles are linked (resemblance.py).
    Rows that share a doc_id belong each to the component of its own text: of those in one component any one stays if the
    doc_id is its smallest. So does one row of a component without doc_ids.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    fps = checkpoint(rows.mapInArrow(_with_wholes, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long, whole long"))
    named = _named(fps, CELL, resemblance.links(docs, fps))
    kept = checkpoint(named.where("component_id IS NOT NULL").select("component_id").distinct())
    repeated = checkpoint(fps.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id"))
    stays = docs.join(kept, docs.doc_id == kept.component_id, "left_semi")

    def one_each(rows: DataFrame) -> DataFrame:
        packed = rows.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
        of = fingerprints(packed, "row").withColumnRenamed("doc_id", "row").join(named, "fp").where(F.col("component_id").eqNullSafe(F.col("row.doc_id")))
        return of.dropDuplicates(["root"]).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))

    if not repeated.isEmpty():
        again = stays.join(repeated, "doc_id", "left_semi")
        stays = stays.join(repeated, "doc_id", "left_anti").union(one_each(again.select(*docs.columns)))
    if not fps.where("doc_id IS NULL").isEmpty():
        stays = stays.union(one_each(docs.where("doc_id IS NULL")))
    return stays
