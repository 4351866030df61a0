"""From raw documents to shards of a training mix, in five stages.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads again as the next
stage's docs. All stages but the last return the columns of documents; each works on all rows that the one before kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rivulet.llm.common import shared_folder, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go."""
    from rivulet.llm.toxicity import drop_toxic

    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document of the smallest id stays."""
    from rivulet.llm.simhash_dedup import drop_near_copies

    return drop_near_copies(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    from rivulet.llm.decontamination import drop_contaminated

    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in no case more than three times."""
    from rivulet.llm.mixing import take

    return take(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard and slot to the columns of documents."""
    from rivulet.llm.sharding import place, tree

    return place(docs, tree())


STAGES = [("toxicity", toxicity), ("near copies", near_copies), ("benchmark passages", benchmark_passages), ("source mix", source_mix), ("shards", shards)]

#: SQL cannot train the network of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What stages write goes to the folder that the cluster shares."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
