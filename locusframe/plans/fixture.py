"""Genotype calls and companion tables derived from the driver tables, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str, taxa: int = 40, sites: int = 400) -> DataFrame:
    """``taxon, site, a1, a2``: codes 0-3 for A, C, G, T, null for unknown.

    One partial aggregation over lineitem; what is shuffled has a row for each cell and task.
    """
    c = F.col
    h = table(spark, sf_dir, "lineitem").groupBy((c("l_suppkey") % taxa).alias("taxon"), (c("l_partkey") % sites).alias("site")).agg(
        F.sum(c("l_orderkey") * 31 + c("l_linenumber") * 7 + c("l_partkey")).alias("h1"),
        F.sum(c("l_orderkey") * 17 + c("l_linenumber") * 3 + c("l_suppkey")).alias("h2"),
    )
    ref, alt = c("site") % 4, (c("site") + 1 + c("site") % 3) % 4
    known = c("h1") % 10 != 9
    return h.select(
        "taxon", "site",
        F.when(known, F.when(c("h1") % 10 < 6, ref).otherwise(alt)).alias("a1"),
        F.when(known, F.when(c("h2") % 10 < 6, ref).otherwise(alt)).alias("a2"),
    )


def calls3(spark: SparkSession, sf_dir: str, taxa: int = 40, sites: int = 400) -> DataFrame:
    """``calls`` with a third allele and half-missing cells, ``taxon, site, a1, a2, depth``."""
    c = F.col
    h = table(spark, sf_dir, "lineitem").groupBy((c("l_suppkey") % taxa).alias("taxon"), (c("l_partkey") % sites).alias("site")).agg(
        F.sum(c("l_orderkey") * 31 + c("l_linenumber") * 7 + c("l_partkey")).alias("h1"),
        F.sum(c("l_orderkey") * 17 + c("l_linenumber") * 3 + c("l_suppkey")).alias("h2"),
        F.sum(c("l_quantity")).cast("long").alias("q"),
    )
    ref, alt, third = c("site") % 4, (c("site") + 1 + c("site") % 3) % 4, (c("site") + 2) % 6
    known = c("h1") % 10 != 9
    return h.select(
        "taxon", "site",
        F.when(known, F.when(c("h1") % 10 < 6, ref).otherwise(alt)).alias("a1"),
        F.when(known & (c("h2") % 10 != 9), F.when(c("h2") % 10 < 6, ref).when(c("h2") % 10 == 8, third).otherwise(alt)).alias("a2"),
        (c("q") % 60).alias("depth"),
    )


def sites(spark: SparkSession, sf_dir: str, n: int = 400) -> DataFrame:
    """``site, chr, pos`` of the sites of ``calls``."""
    s = F.col("site")
    return table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % n).alias("site")).distinct().select("site", (1 + s % 5).cast("string").alias("chr"), (100 + s * 37).alias("pos"))


def phenotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``taxon, rep, factor, y`` from customers; replicates in order of the customer's key."""
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 40).alias("taxon"), "c_custkey", F.col("c_mktsegment").alias("factor"), F.col("c_acctbal").alias("y"))
    return c.withColumn("rep", F.row_number().over(Window.partitionBy("taxon").orderBy("c_custkey")).cast("long")).select("taxon", "rep", "factor", "y")


# The same tables as common table expressions.
CALLS = """calls AS (
  SELECT taxon, site,
    CASE WHEN h1 % 10 = 9 THEN NULL WHEN h1 % 10 < 6 THEN site % 4 ELSE (site + 1 + site % 3) % 4 END AS a1,
    CASE WHEN h1 % 10 = 9 THEN NULL WHEN h2 % 10 < 6 THEN site % 4 ELSE (site + 1 + site % 3) % 4 END AS a2
  FROM (SELECT l_suppkey % 40 AS taxon, l_partkey % 400 AS site,
          CAST(SUM(l_orderkey*31 + l_linenumber*7 + l_partkey) AS BIGINT) AS h1,
          CAST(SUM(l_orderkey*17 + l_linenumber*3 + l_suppkey) AS BIGINT) AS h2
        FROM lineitem GROUP BY 1, 2) x)"""
CALLS3 = """calls3 AS (
  SELECT taxon, site,
    CASE WHEN h1 % 10 = 9 THEN NULL WHEN h1 % 10 < 6 THEN site % 4 ELSE (site + 1 + site % 3) % 4 END AS a1,
    CASE WHEN h1 % 10 = 9 OR h2 % 10 = 9 THEN NULL WHEN h2 % 10 < 6 THEN site % 4 WHEN h2 % 10 = 8 THEN (site + 2) % 6
         ELSE (site + 1 + site % 3) % 4 END AS a2, q % 60 AS depth
  FROM (SELECT l_suppkey % 40 AS taxon, l_partkey % 400 AS site,
          CAST(SUM(l_orderkey*31 + l_linenumber*7 + l_partkey) AS BIGINT) AS h1,
          CAST(SUM(l_orderkey*17 + l_linenumber*3 + l_suppkey) AS BIGINT) AS h2,
          CAST(SUM(l_quantity) AS BIGINT) AS q
        FROM lineitem GROUP BY 1, 2) x)"""
SITES = """sites AS (SELECT DISTINCT l_partkey % 400 AS site, CAST(1 + (l_partkey % 400) % 5 AS VARCHAR) AS chr, 100 + (l_partkey % 400) * 37 AS pos FROM lineitem)"""
PHENO = """pheno AS (SELECT c_custkey % 40 AS taxon, row_number() OVER (PARTITION BY c_custkey % 40 ORDER BY c_custkey) AS rep,
  c_mktsegment AS factor, c_acctbal AS y FROM customer)"""
