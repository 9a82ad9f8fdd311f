"""Streaming upkeep of allele counts and event windows (2.K).

Allele counts are additive, so a stream of call files is a stateful streaming aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def allele_count_stream(spark: SparkSession, folder: str, schema: str = "taxon long, site long, a1 long, a2 long") -> DataFrame:
    """Running counts ``site, allele, n`` over the parquet call files that arrive in a folder; write in update or complete mode."""
    calls = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(folder)
    alleles = calls.select("site", F.explode(F.array("a1", "a2")).alias("allele")).where("allele IS NOT NULL")
    return alleles.groupBy("site", "allele").agg(F.count("*").alias("n"))


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and value sums of events in tumbling windows; on a stream, state goes once a window is ``late``."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    w = rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")
