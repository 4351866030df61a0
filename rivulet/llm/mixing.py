"""Mixing sources to target weights by systematic sampling.

Sources in code-point order (null last) weigh 1, 2, 3, repeating, and share all words of the corpus by weight; a
source's target stops at max_copies times its size, and the excess is shared anew until none is above (water-filling).
Each document of a source then expects target / size copies. Along the source's documents, ordered by size and then a
hash of doc_id, the expected copies are summed, one random offset is added, and a document is emitted once for each
integer boundary that its part of the sum crosses. Ordered by size, what a source takes misses its target by about the
size of its largest document at most.

The rank of a document in its source is made in slices (source, size, hash slice): a count for each slice, running
sums of the counts over a (source, size) and over a source's sizes, and ranks within slices. So no task holds a source
or the documents of one size, however large.

Defined cases: null text has size 0; sources of no words have target 0 and take nothing; repeated rows count each; an
empty table gives an empty result. Only doc_id, text and source are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rivulet.llm.common import HASH_RANGE, checkpoint, hash52, id_text, slices

#: A word, the cycle of weights, the largest number of copies.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = 3
MAX_COPIES = 3


def targets(sources: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """sources: is_null, src, source_size (a row for each source). Adds target, a double."""
    by_name = Window.orderBy("is_null", "src")
    weighed = sources.withColumn("weight", (F.row_number().over(by_name) - 1) % WEIGHTS + 1)
    cap = (F.col("source_size") * max_copies).cast("double")
    by_ratio = Window.orderBy("ratio", "is_null", "src")
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        weighed.withColumns({"cap": cap, "ratio": cap / F.col("weight")})
        .withColumns(
            {
                "capped_before": F.sum("cap").over(by_ratio) - F.col("cap"),
                "weight_after": F.sum("weight").over(after),
                "total": F.sum("source_size").over(whole),
                "pos": F.row_number().over(by_ratio),
            }
        )
        .withColumn("level", (F.col("total") - F.col("capped_before")) / F.col("weight_after"))
        # the first source in this order that stays under its cap sets the level for all that do
        .withColumn("level", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("pos", "level"))).over(whole).getField("level"))
    )
    return level.select("is_null", "src", "source_size", F.when(F.coalesce(F.col("ratio") <= F.col("level"), F.lit(True)), F.col("cap")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def sizes(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, src, is_null, size and a hash for each row: all that the sampling needs of a document."""
    src = F.col("source").cast("string")
    return docs.select(
        *keep,
        "doc_id",
        F.coalesce(src, F.lit("")).alias("src"),
        src.isNull().alias("is_null"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        hash52(F.lit("mix"), id_text(F.col("doc_id"))).alias("h"),
    )


def copies(sized: DataFrame, n: int, max_copies: int = MAX_COPIES) -> DataFrame:
    """Adds source_size, target and copies to the rows of sizes(), which is read twice. n: the number of rows."""
    cut = slices(n)
    rows = sized.withColumn("slice", F.floor(F.col("h") / F.lit(float(HASH_RANGE)) * cut).cast("int"))
    key = ["is_null", "src"]
    counts = rows.groupBy(*key, "size", "slice").agg(F.count("*").alias("rows"))
    by_size = counts.groupBy(*key, "size").agg(F.sum("rows").alias("rows"))
    running = F.sum("rows").over(Window.partitionBy(*key).orderBy("size")) - F.col("rows")
    size_before = by_size.select(*key, "size", running.alias("size_before"))
    by_source = targets(by_size.groupBy(*key).agg(F.sum(F.col("rows") * F.col("size")).alias("source_size")), max_copies)
    in_size = F.sum("rows").over(Window.partitionBy(*key, "size").orderBy("slice")) - F.col("rows")
    before = (
        counts.withColumn("slice_before", in_size)
        .join(size_before.join(by_source, key), [*key, "size"])
        .select(*key, "size", "slice", (F.col("slice_before") + F.col("size_before")).alias("before"), "source_size", "target")
    )
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key, "size", "slice").orderBy("h", "doc_id")))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit("offset:"), F.when(F.col("is_null"), "0").otherwise(F.concat(F.lit("1"), F.col("src"))))), 1, 3), 16, 10).cast("double") / 4096.0
    at = F.col("before") + F.col("rank")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = F.floor(at * each + offset) - F.floor((at - 1) * each + offset)
    return ranked.join(before, [*key, "size", "slice"]).withColumn("copies", F.least(crossed, F.lit(max_copies)).cast("long"))


def mix(docs: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs."""
    sized = checkpoint(sizes(docs))
    return copies(sized, sized.count(), max_copies).select(
        "doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * F.col("copies")).cast("long").alias("taken")
    )


def take(docs: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """Each row of docs as often as the mix takes it, with all its columns."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "source", "text")
    taken = copies(sizes(packed, "row"), docs.count(), max_copies).where("copies > 0")
    emitted = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return emitted.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
