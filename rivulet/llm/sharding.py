"""Sharding by a hierarchical weighted hash tree. Native: DataFrame functions only.

A tree has three levels: region, rack, shard; the weight of a rack or region is the sum of its shards' weights. A
document descends from the root: at each level every child draws -ln(u) / weight, where u in (0, 1) is a hash of
doc_id and the child's name, and the child with the smallest draw takes it. A child wins in proportion to its weight,
and its draw does not depend on its siblings; so if one child's weight grows, rows move into that child only, and
rows move nowhere below nodes whose weights stay. A new shard opens a region of its own: no other subtree's weight
changes, so it takes rows into itself only.

Defined cases: null text has size 1 and crc 0; null doc_id is hashed as the empty text; repeated rows share a shard and
get a slot each; an empty table gives an empty result. Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rivulet.llm.common import HASH_RANGE, hash52, id_text, slices


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(regions: int = 2, racks: int = 2, shards: int = 4) -> tuple[Shard, ...]:
    """Shards of equal weight, numbered from 0 along regions and racks."""
    return tuple(Shard(n // (racks * shards), n // shards % racks, n) for n in range(regions * racks * shards))


def grow(shards: tuple[Shard, ...], weight: float = 1.0) -> tuple[Shard, ...]:
    """One more shard, in a region of its own."""
    return (*shards, Shard(max(s.region for s in shards) + 1, 0, max(s.shard for s in shards) + 1, weight))


def _draw(key: Column, name: str, weight: float) -> Column:
    u = (hash52(key, F.lit(name)) + F.lit(0.5)) / F.lit(float(HASH_RANGE))
    return -F.log(u) / F.lit(float(weight))


def _pick(key: Column, children: dict[str, tuple[float, int]]) -> Column:
    """The number of the child with the smallest draw; children by name: weight, number."""
    draws = [F.struct(_draw(key, name, weight).alias("d"), F.lit(number).alias("n")) for name, (weight, number) in children.items()]
    return draws[0].getField("n") if len(draws) == 1 else F.least(*draws).getField("n")


def descend(df: DataFrame, key: Column, shards: tuple[Shard, ...], out: str) -> DataFrame:
    """Adds the shard that key reaches. A level's draws are made among the children of the node reached only."""
    weights: dict[int, dict[int, dict[int, float]]] = {}
    for s in shards:
        if not (s.weight > 0 and math.isfinite(s.weight)):
            raise ValueError(f"shard {s.shard} has weight {s.weight}")
        weights.setdefault(s.region, {}).setdefault(s.rack, {})[s.shard] = s.weight
    of_region = {r: {f"rack-{r}-{k}": (sum(leaves.values()), k) for k, leaves in racks.items()} for r, racks in weights.items()}
    of_rack = {(r, k): {f"shard-{s}": (w, s) for s, w in leaves.items()} for r, racks in weights.items() for k, leaves in racks.items()}
    region, rack = F.col(f"{out}_region"), F.col(f"{out}_rack")
    top = {f"region-{r}": (sum(sum(leaves.values()) for leaves in racks.values()), r) for r, racks in weights.items()}
    return (
        df.withColumn(f"{out}_region", _pick(key, top))
        .withColumn(f"{out}_rack", F.coalesce(*(F.when(region == r, _pick(key, c)) for r, c in of_region.items())))
        .withColumn(out, F.coalesce(*(F.when((region == r) & (rack == k), _pick(key, c)) for (r, k), c in of_rack.items())))
        .drop(f"{out}_region", f"{out}_rack")
    )


def _slotted(docs: DataFrame, shards: tuple[Shard, ...], *keep: Column) -> DataFrame:
    """keep, doc_id, key, size, text_crc32, shard, slot for each row of docs.

    Slots count a shard's rows from 0 along (hash of doc_id and crc, doc_id, crc). They are made in slices of that hash: a
    count for each slice, running sums of the counts, and ranks within slices, so that no task holds a shard, nor all
    texts of one doc_id.
    """
    n = slices(docs.count())
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    crc = F.crc32(text.cast("binary")).cast("long").alias("text_crc32")

    def placed(df: DataFrame) -> DataFrame:
        hashed = df.withColumns({"key": id_text(F.col("doc_id")), "h": hash52(id_text(F.col("doc_id")), F.col("text_crc32").cast("string"))})
        return descend(hashed, F.col("key"), shards, "shard").withColumn("slice", F.floor(F.col("h") / F.lit(float(HASH_RANGE)) * n).cast("int"))

    counts = placed(docs.select("doc_id", crc)).groupBy("shard", "slice").agg(F.count("*").alias("rows"))
    running = F.sum("rows").over(Window.partitionBy("shard").orderBy("slice")) - F.col("rows")
    before = counts.select("shard", "slice", running.alias("before"))
    rows = placed(docs.select(*keep, "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), crc))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "slice").orderBy("h", "doc_id", "text_crc32")))
    return ranked.join(before, ["shard", "slice"]).withColumns({"slot": (F.col("before") + F.col("rank") - 1).cast("long"), "shard": F.col("shard").cast("int")})


def assign(docs: DataFrame, shards: tuple[Shard, ...], grown: tuple[Shard, ...] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null without a grown tree) for each row of docs."""
    rows = _slotted(docs, shards)
    rows = descend(rows, F.col("key"), grown, "grown_shard") if grown else rows.withColumn("grown_shard", F.lit(None))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", F.col("grown_shard").cast("int").alias("grown_shard"))


def place(docs: DataFrame, shards: tuple[Shard, ...]) -> DataFrame:
    """The columns of docs, and shard and slot (in place of columns of these names)."""
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = _slotted(docs, shards, F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"))
    return rows.select(*(F.col("row").getField(c).alias(c) for c in kept), "shard", "slot")
