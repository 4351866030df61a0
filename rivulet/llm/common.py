"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only where that setting is absent and all runs on this machine (tests, a notebook) a temporary folder is used.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="rivulet-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder.

    A checkpoint keeps the constraints that its plan implies; over the rounds of a loop these multiply, so none are
    inferred here.
    """
    conf, key = df.sparkSession.conf, "spark.sql.constraintPropagation.enabled"
    shared_folder(df.sparkSession)
    before = conf.get(key)
    conf.set(key, "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        conf.set(key, before)


def id_text(doc_id: Column) -> Column:
    """The id as text; null counts as the empty text."""
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def crc_mod(doc_id: Column, n: int) -> Column:
    return F.pmod(F.crc32(id_text(doc_id)), F.lit(n))


def hash52(*parts: Column) -> Column:
    """A 52-bit hash, equal in any SQL engine with md5: the first 13 hex digits of md5(parts joined by ':')."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long")


HASH_RANGE = 1 << 52


def slices(n: int, rows_each: int = 1_000_000, least: int = 64) -> int:
    """How many hash slices a group of rows is cut into, so that no task gets more than about rows_each of one group."""
    return max(least, -(-n // rows_each))


def bounded_sample(df: DataFrame, n: int, key: list[Column], by: Column | None = None, groups: int = 64) -> DataFrame:
    """At most n rows of df, in equal shares for the values of by (the groups most frequent ones, not null); all, if fewer.

    No two rows have an equal key in a group, so repeated rows count once, and key must decide all columns that are
    used. A group's rows with the smallest hashes of key are taken: first, all below a hash that by an estimate of the
    number of different keys leaves half as many again; then the n smallest of these. Reruns agree.
    """
    hashed = df.withColumns({"__by": F.lit(0) if by is None else by, "__at": F.pmod(F.xxhash64(F.lit("sample"), *key), F.lit(1 << 40))})
    about = hashed.where("__by IS NOT NULL").groupBy("__by").agg(F.approx_count_distinct("__at").alias("keys")).orderBy(F.desc("keys"), "__by").limit(groups).collect()
    if not about:
        return df.limit(0)
    each = max(1, n // len(about))
    below = F.coalesce(*(F.when(F.col("__by") == r["__by"], F.lit(int((1 << 40) * min(1, 1.5 * each / max(1, r["keys"]))))) for r in about))
    some = hashed.where(F.col("__at") < below).dropDuplicates(["__by", "__at"])
    nth = F.row_number().over(Window.partitionBy("__by").orderBy("__at"))
    return some.withColumn("__nth", nth).where(F.col("__nth") <= each).drop("__by", "__at", "__nth")
