"""Batch runs of the streaming operators over the given tables (2.K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusframe.plans import fixture as fx
from locusframe.streaming.allele_stream import event_windows

QUERIES = {
    "k01_event_windows": lambda s, d: event_windows(fx.table(s, d, "events")).select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total")),
}
ORACLES = {
    "k01_event_windows": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
