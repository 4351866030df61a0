"""Listings and requests made from the star-schema tables, in the shape that the operators expect.

An order stands for a filing of its customer: newest first, titled by its status, priority and date. A customer stands
for a request. The same rules are written in SQL for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stock_code, listing_year, pos, title_raw, link_raw, o_orderkey."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    status = F.when(F.col("o_orderstatus") == "F", " Hợp nhất").when(F.col("o_orderstatus") == "P", " Công ty mẹ").otherwise("")
    kind = (
        F.when(F.col("o_orderpriority") == "1-URGENT", " Kiểm toán")
        .when(F.col("o_orderpriority") == "2-HIGH", " Soát xét")
        .when(F.col("o_orderpriority") == "5-LOW", " Nghị quyết")
        .otherwise(F.concat(F.lit(" quý "), F.quarter("o_orderdate").cast("string")))
    )
    year = F.year("o_orderdate")
    newest = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return o.select(
        F.col("o_custkey").cast("string").alias("stock_code"),
        year.alias("listing_year"),
        (F.row_number().over(newest) - 1).alias("pos"),
        F.concat(F.lit("  Báo cáo tài chính"), status, kind, F.lit(" năm "), year.cast("string"), F.date_format("o_orderdate", " dd/MM/yyyy HH:mm")).alias("title_raw"),
        F.concat(F.lit("/doc/"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("link_raw"),
        "o_orderkey",
    )


def requests(spark: SparkSession, sf_dir: str, latest: bool = False) -> DataFrame:
    """c_custkey, request_id, stock_code, year, period, quarter, consolidation_status. latest: all ask for the newest."""
    k = F.col("c_custkey")
    period = F.lit("Mới nhất") if latest else F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "6 tháng").when(k % 5 == 2, "Cả năm").otherwise("Quý")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.concat(F.lit("req_"), k.cast("string")).alias("request_id"),
        k.cast("string").alias("stock_code"),
        (1995 + k % 7).cast("int").alias("year"),
        period.alias("period"),
        (1 + k % 4).cast("int").alias("quarter"),
        F.when(k % 3 == 0, "Hợp nhất").when(k % 3 == 1, "Công ty mẹ").alias("consolidation_status"),
    )


#: The same in SQL, as leading common table expressions.
LISTING_SQL = """
L AS (
  SELECT CAST(o_custkey AS VARCHAR) AS code, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q, o_orderkey,
         CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) - 1 AS INTEGER) AS pos,
         CASE o_orderstatus WHEN 'F' THEN 'Hợp nhất' ELSE 'Công ty mẹ' END AS status, o_orderstatus AS letter,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'Cả năm' WHEN '2-HIGH' THEN '6 tháng' WHEN '5-LOW' THEN NULL ELSE 'Quý' END AS period,
         'Báo cáo tài chính' || CASE o_orderstatus WHEN 'F' THEN ' Hợp nhất' WHEN 'P' THEN ' Công ty mẹ' ELSE '' END ||
         CASE o_orderpriority WHEN '1-URGENT' THEN ' Kiểm toán' WHEN '2-HIGH' THEN ' Soát xét' WHEN '5-LOW' THEN ' Nghị quyết' ELSE ' quý ' || quarter(o_orderdate) END ||
         ' năm ' || year(o_orderdate) AS title,
         'https://finance.vietstock.vn/doc/' || o_orderkey || '.pdf' AS link
  FROM orders)"""
REQUESTS_SQL = """
Q AS (
  SELECT c_custkey, 'req_' || c_custkey AS request_id, CAST(c_custkey AS VARCHAR) AS code, CAST(1995 + c_custkey % 7 AS INTEGER) AS y,
         CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '6 tháng' WHEN 2 THEN 'Cả năm' ELSE 'Quý' END AS period,
         CAST(1 + c_custkey % 4 AS INTEGER) AS q,
         CASE c_custkey % 3 WHEN 0 THEN 'Hợp nhất' WHEN 1 THEN 'Công ty mẹ' END AS status
  FROM customer)"""
