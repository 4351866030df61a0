"""Links between texts whose five-word shingles have a similarity (Jaccard) of 0.8 or more.

A SimHash of 64 bits puts texts of similarity 0.8 about ten bits apart, too far for a grid of fingerprints. Where texts
are to be held apart by similarity itself, as in a deduplicating stage, these links go beside those of fingerprints.

Each different text keeps the SKETCH smallest hashes of its shingles. Of two texts of similarity s, the KEYS smallest share
none with a probability of about (1 - s) ** KEYS, one in 390,000 at 0.8. Up to PAIRS texts that share a key are compared each
with each, first by their sketches and then, exactly, by their whole sets of shingles. More texts of a key, a crowd, are
connected in two steps:

* The crowd is dealt into groups of about FAN by hash, and each text is compared with its group's pivot; the pivots are
  dealt into groups again, and so on up to one. So no text meets more than about FAN others for a key and level, and as
  groups differ by key, most of a large group of near copies is tied together at a cost in proportion to its size.
* Where a crowd is then of several components, its texts outside the largest are compared with all that are of another.
  Texts whose sketches overlap enough share one of the rarest hashes of their sketches (prefix filtering). Up to PAIRS
  texts that share such a hash are compared each with each, so texts that only have a line in common cost little. Where
  more share one, the same is done with whole sets: similar texts share one of their rarest fifth of shingles, so texts
  of one template that fill over a fifth of it with their own words cost little, too. Texts that more than PAIRS share
  such a shingle with are compared within their crowd, in pairs of blocks of about BLOCK shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rivulet.llm import tokens
from rivulet.llm.common import checkpoint
from rivulet.llm.graph import components

SHINGLE = 5
SIMILARITY = 0.8
KEYS, SKETCH, PAIRS, FAN = 8, 32, 16, 64
#: Pairs whose sketches overlap less are not compared further: five deviations below the similarity asked for.
LEAST_OVERLAP = 0.45
SALTS = 32
#: Shingles of a block of texts of a crowd.
BLOCK = 1 << 19


def _sequences(w: tokens.Words) -> np.ndarray:
    """For each text, a hash of its whole sequence of words."""
    heads = np.cumsum(w.counts) - w.counts
    nth = (np.arange(len(w.hashes)) - np.repeat(heads, w.counts)).astype(np.uint64)
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tokens.mixed(w.hashes + np.uint64(0x9E3779B9) * nth))))
    return tokens.mixed(running[heads + w.counts] - running[heads]).view(np.int64)


def wholes(column: pa.Array) -> np.ndarray:
    """Equal numbers for texts of equal words in equal order."""
    found = [_sequences(tokens.words(tokens.mapped(part.data, tokens.LOWER), part.ends)) for part in tokens.parts(column)]
    return np.concatenate([np.zeros(0, np.int64), *found])


def _sets(column: pa.Array) -> Iterator[tuple[np.ndarray, int]]:
    """For each text, its shingles' hashes in order, each once, and a hash of its whole sequence of words."""
    for part in tokens.parts(column):
        w = tokens.words(tokens.mapped(part.data, tokens.LOWER), part.ends)
        h, at = tokens.grams(w, SHINGLE)
        doc = w.doc[at]
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        once = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])) if len(h) else np.zeros(0, bool)
        h, doc = h[once], doc[once]
        ends = np.searchsorted(doc, np.arange(len(part.ends)), side="right")
        whole = _sequences(w)
        signed = h.view(np.int64)
        for k, (lo, hi) in enumerate(zip(np.concatenate(([0], ends[:-1])), ends, strict=True)):
            # fewer words than a shingle: the sequence itself
            yield (signed[lo:hi] if hi > lo else whole[k : k + 1]), int(whole[k])


def _lists(rows: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, rows)]).astype(np.int32), np.concatenate([*rows, np.zeros(0, np.int64)]))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = list(_sets(batch.column(1)))
        columns = [batch.column(0), pa.array([w for _, w in found], pa.int64()), _lists([s[:SKETCH] for s, _ in found])]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "whole", "sketch"])


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = list(_sets(batch.column(1)))
        yield pa.RecordBatch.from_arrays([pa.array([w for _, w in found], pa.int64()), _lists([s for s, _ in found])], names=["id", "shingles"])


def _matches(group: pa.Table) -> pa.Table:
    """a, b: each text of the rest with one similar text of each other component among the others of its crowd."""
    group = group.combine_chunks()
    ids, root, rest = (np.asarray(group.column(c)) for c in ("id", "root", "rest"))
    lists = group.column("shingles").combine_chunks()
    sizes = np.asarray(lists.value_lengths(), np.int64)
    ends = np.cumsum(sizes)
    known, place = np.unique(np.asarray(lists.flatten()), return_inverse=True)
    others = np.flatnonzero(~rest)
    theirs = place[np.repeat(~rest, sizes)]
    size, first = sizes[others], np.cumsum(sizes[others]) - sizes[others]
    mine, a, b = np.zeros(len(known), np.int32), [], []
    for x in np.flatnonzero(rest) if len(others) else ():
        own = place[ends[x] - sizes[x] : ends[x]]
        mine[own] = 1
        same = np.add.reduceat(mine[theirs], first)
        mine[own] = 0
        near = others[(same >= SIMILARITY * (sizes[x] + size - same)) & (root[others] != root[x])]
        near = near[np.unique(root[near], return_index=True)[1]]
        a.append(np.repeat(ids[x], len(near)))
        b.append(ids[near])
    return pa.table({k: np.concatenate([np.zeros(0, np.int64), *v]) for k, v in (("a", a), ("b", b))})


def _of(df: DataFrame, side: str, what: str) -> DataFrame:
    return df.select(F.col("id").alias(side), F.col(what).alias(f"{what}_{side}"))


def _pairs(rows: DataFrame, key: str, kept: str = "true") -> DataFrame:
    """a, b: the pairs of rows of a key, of which kept is true."""
    l, r = rows.alias("l"), rows.alias("r")
    return l.join(r, (F.col(f"l.{key}") == F.col(f"r.{key}")) & (F.col("l.id") < F.col("r.id")) & F.expr(kept)).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))


class _Texts:
    """Different texts, named by their wholes: id, doc_id (the smallest), sketch."""

    def __init__(self, docs: DataFrame):
        self.binary = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
        named = self.binary.mapInArrow(_sketches, f"doc_id {self.binary.schema['doc_id'].dataType.simpleString()}, whole long, sketch array<long>")
        self.all = checkpoint(named.groupBy(F.col("whole").alias("id")).agg(F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch")))
        self.nameless = not self.all.where("doc_id IS NULL").isEmpty()

    def sets(self, asked: DataFrame) -> DataFrame:
        """id, shingles for the asked ids."""
        which = checkpoint(self.all.join(asked, "id", "left_semi").select("id", "doc_id"))
        rows = self.binary.join(which.select("doc_id").where("doc_id IS NOT NULL").distinct(), "doc_id", "left_semi")
        if self.nameless:
            rows = rows.union(self.binary.where("doc_id IS NULL"))
        return checkpoint(rows.mapInArrow(_whole_sets, "id long, shingles array<long>").join(which, "id", "left_semi").dropDuplicates(["id"]))

    def similar(self, pairs: DataFrame, besides: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """The pairs a, b of enough similarity, and the sets of their texts and of the ids besides."""
        near = pairs.join(_of(self.all, "a", "sketch"), "a").join(_of(self.all, "b", "sketch"), "b")
        shared = F.size(F.array_intersect("sketch_a", "sketch_b")) / F.least(F.size("sketch_a"), F.size("sketch_b"))
        likely = checkpoint(near.where(shared >= LEAST_OVERLAP).select("a", "b"))
        asked = likely.select(F.explode(F.array("a", "b")).alias("id"))
        sets = self.sets((asked.union(besides) if besides else asked).distinct())
        return _exact(likely, sets), sets


def _rarest(hashes: DataFrame, least: float) -> DataFrame:
    """id, root, h, n: of each text's rarest hashes those that n texts have, not all of one root.

    hashes: id, root, size (hashes of the text), h. It is read twice. Two texts that share the part least of the hashes
    of either have one of these in common.
    """
    common = hashes.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    mine = Window.partitionBy("id")
    nth = F.col("size") - F.count("*").over(mine) + F.row_number().over(mine.orderBy("n", "h"))  # hashes of one text come first
    prefix = F.col("size") - F.ceil(F.col("size") * F.lit(least) - 1e-9) + 1
    rare = checkpoint(hashes.join(common, "h").withColumn("nth", nth).where(F.col("nth") <= prefix).select("id", "root", "h"))
    lists = rare.groupBy("h").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h", "n")
    return checkpoint(rare.join(lists, "h"))


def _exact(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b of enough similarity."""
    same = F.size(F.array_intersect("shingles_a", "shingles_b"))
    both = pairs.join(_of(sets, "a", "shingles"), "a").join(_of(sets, "b", "shingles"), "b")
    return checkpoint(both.where(same >= SIMILARITY * (F.size("shingles_a") + F.size("shingles_b") - same)).select("a", "b"))


def _crowded(texts: _Texts, crowds: DataFrame, linked: DataFrame) -> DataFrame | None:
    """a, b: the links that crowds (key, id) lack to be connected as far as their texts are similar; None: no link."""
    roots = components(linked, "a", "b", 2)  # roots that are not yet one only cost comparisons
    rooted = checkpoint(crowds.join(roots, crowds.id == roots.node, "left").select("key", "id", F.coalesce("root", "id").alias("root")))
    parts = rooted.groupBy("key", "root").count().groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("count", "root")).alias("most"))
    several = checkpoint(parts.where("parts > 1").select("key", F.col("most.root").alias("main")))
    if several.isEmpty():
        return None
    # a crowd's texts share its key: in SALTS parts
    salted = several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    split = checkpoint(rooted.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"]).select("key", "id", "root", (F.col("root") != F.col("main")).alias("rest")))
    hashes = split.select("id", "root").distinct().join(texts.all, "id").select("id", "root", F.size("sketch").alias("size"), F.explode("sketch").alias("h"))
    # sketches of similar texts differ in size by no more than the texts do
    shared = _rarest(checkpoint(hashes), LEAST_OVERLAP * SIMILARITY)
    some = checkpoint(shared.where(F.col("n") > PAIRS).select("id", "root").distinct())
    found, sets = texts.similar(_pairs(shared.where(F.col("n") <= PAIRS), "h", "l.root <> r.root").distinct(), some.select("id"))
    if some.isEmpty():
        return found
    whole = sets.join(some, "id").select("id", "root", F.size("shingles").alias("size"), F.explode("shingles").alias("h"))
    closer = _rarest(whole, SIMILARITY)
    found = found.union(_exact(checkpoint(_pairs(closer.where(F.col("n") <= PAIRS), "h", "l.root <> r.root").distinct()), sets))
    many = checkpoint(closer.where(F.col("n") > PAIRS).select("id").distinct())
    if many.isEmpty():
        return found
    sizes = sets.join(many, "id", "left_semi").select("id", F.size("shingles").alias("size"))
    members = checkpoint(split.join(sizes, "id"))
    blocks = members.groupBy("key").agg(F.sum("size").alias("whole"), F.sum(F.when(F.col("rest"), F.col("size"))).alias("part")).where("part IS NOT NULL")
    count = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    dealt = members.join(blocks.select("key", count("whole").alias("across"), count("part").alias("down")), "key")
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = dealt.where("rest").select("key", "id", "root", F.lit(True).alias("rest"), block("down").alias("i"), each("across").alias("j"))
    others = dealt.select("key", "id", "root", F.lit(False).alias("rest"), each("down").alias("i"), block("across").alias("j"))
    return found.union(rest.union(others).join(sets, "id").groupBy("key", "i", "j").applyInArrow(_matches, "a long, b long").distinct())


def _stars(crowds: DataFrame, largest: int) -> DataFrame:
    """a, b: each text of a crowd (key, id, n) with the pivot of its group, level by level. largest: the largest n."""
    members, stars = crowds, []
    while largest > 1:
        groups = F.ceil(F.col("n") / FAN)
        dealt = members.select("key", "id", groups.alias("n"), F.pmod(F.xxhash64("id", "key"), groups).alias("g"))
        pivots = checkpoint(dealt.groupBy("key", "g").agg(F.min(F.struct(F.xxhash64("key", "id"), "id")).getField("id").alias("pivot"), F.first("n").alias("n")))
        met = dealt.join(pivots.drop("n"), ["key", "g"]).where("id <> pivot")
        stars.append(met.select(F.least("pivot", "id").alias("a"), F.greatest("pivot", "id").alias("b")))
        members, largest = pivots.select("key", F.col("pivot").alias("id"), "n"), -(-largest // FAN)
    return reduce(DataFrame.union, stars)


def links(docs: DataFrame, fps: DataFrame) -> DataFrame:
    """a, b: fingerprints of texts of enough similarity. docs: doc_id, text; fps: whole, fp."""
    texts = _Texts(docs)
    keys = texts.all.select("id", F.explode(F.slice("sketch", 1, KEYS)).alias("key"))
    lists = checkpoint(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    met = checkpoint(keys.join(lists, "key"))
    pairs, crowds = _pairs(met.where(F.col("n") <= PAIRS), "key"), met.where(F.col("n") > PAIRS)
    largest = lists.agg(F.max("n")).first()[0] or 0
    if largest <= PAIRS:
        linked, _ = texts.similar(checkpoint(pairs.distinct()))
    else:
        linked, _ = texts.similar(checkpoint(pairs.union(_stars(crowds, largest)).distinct()))
        more = _crowded(texts, crowds.select("key", "id"), linked)
        linked = linked.union(more) if more else linked
    first = fps.groupBy(F.col("whole").alias("id")).agg(F.min("fp").alias("fp"))
    return linked.join(_of(first, "a", "fp"), "a").join(_of(first, "b", "fp"), "b").select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))
