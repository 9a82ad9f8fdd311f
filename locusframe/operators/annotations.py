"""Annotation multimaps of samples and positions (F12, X16, A26, N report views).

Annotations are ``anno``: a map of names to lists of text. Long rows ``name, key, value``
become maps by two grouped aggregates and go back by two explodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.plans import fixture as fx


def to_maps(rows: DataFrame) -> DataFrame:
    """``name, anno`` of long rows; values of a key once each, sorted."""
    lists = rows.groupBy("name", "key").agg(F.array_sort(F.collect_set("value")).alias("v"))
    return lists.groupBy("name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "v")))).alias("anno"))


def to_rows(taxa: DataFrame) -> DataFrame:
    return taxa.select("name", F.explode("anno").alias("key", "v")).select("name", "key", F.explode("v").alias("value"))


def having(taxa: DataFrame, key: str, value: str) -> DataFrame:
    """samples with a value under a key."""
    return taxa.where(F.coalesce(F.array_contains(F.try_element_at("anno", F.lit(key)), value), F.lit(False)))


def retain(taxa: DataFrame, keys: list[str], inverse: bool = False) -> DataFrame:
    """only the named annotations, or all others."""
    return taxa.withColumn("anno", F.map_filter("anno", lambda k, v: ~k.isin(keys) if inverse else k.isin(keys)))


def all_keys(taxa: DataFrame) -> DataFrame:
    """every annotation name with its number of samples."""
    return taxa.select(F.explode(F.map_keys("anno")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def by_value(taxa: DataFrame, key: str) -> DataFrame:
    """samples of each value of an annotation, as rows ``value, name``."""
    return taxa.select("name", F.explode(F.try_element_at("anno", F.lit(key))).alias("value")).select("value", "name")


def unique_by_value(taxa: DataFrame, key: str) -> DataFrame:
    """``value, name`` where every value has one sample; no row at all where some value has several."""
    pairs = by_value(taxa, key).groupBy("value").agg(F.min("name").alias("name"), F.count("*").alias("n"))
    worst = pairs.agg(F.max("n").alias("worst"))  # one row
    return pairs.crossJoin(F.broadcast(worst)).where("worst = 1").select("value", "name")


def text_of(key: str) -> Column:
    """The values of an annotation in one text."""
    return F.array_join(F.try_element_at("anno", F.lit(key)), ",")


def mean_of(key: str) -> Column:
    """Mean of an annotation's numeric values, null where none is a number."""
    numbers = F.filter(F.transform(F.try_element_at("anno", F.lit(key)), lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    return F.when(F.size(numbers) > 0, F.aggregate(numbers, F.lit(0.0), lambda s, x: s + x) / F.size(numbers))


def report(taxa: DataFrame, keys: list[str]) -> DataFrame:
    """N: a column for each annotation key."""
    return taxa.select("name", *[text_of(k).alias(k) for k in keys])


def tissue_counts(rows: DataFrame) -> DataFrame:
    """Counts of each tissue and sample."""
    return rows.groupBy("tissue", "taxon").agg(F.count("*").alias("n"))


def _taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events")
    return to_maps(e.select((F.col("user_id") % 60).alias("name"), F.col("event_type").alias("key"), F.get_json_object("props", "$.k").alias("value")))


KINDS = ["click", "view", "error"]
QUERIES = {
    "f12_having_annotation": lambda s, d: having(_taxa(s, d), "click", "7").select("name"),
    "f12_all_keys": lambda s, d: all_keys(_taxa(s, d)),
    "f12_retain": lambda s, d: to_rows(retain(_taxa(s, d), ["click", "view"])),
    "f12_remove": lambda s, d: to_rows(retain(_taxa(s, d), ["click", "view"], inverse=True)),
    "f12_by_value": lambda s, d: by_value(_taxa(s, d), "error"),
    "f12_unique_by_value": lambda s, d: unique_by_value(_taxa(s, d).withColumn("anno", F.create_map(F.lit("id"), F.array(F.col("name").cast("string")))), "id"),
    "x16_annotation_text": lambda s, d: report(_taxa(s, d), KINDS),
    "x16_annotation_mean": lambda s, d: _taxa(s, d).select("name", F.round(mean_of("click"), 6).alias("mean_click"), F.size("anno").cast("long").alias("n_keys")),
    "a26_tissue_counts": lambda s, d: tissue_counts(fx.table(s, d, "events").select(F.col("event_type").alias("tissue"), (F.col("user_id") % 40).alias("taxon"))),
}

_A = "a AS (SELECT DISTINCT user_id % 60 AS name, event_type AS key, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL)"
_TEXT = ", ".join(f"(SELECT string_agg(value, ',' ORDER BY value) FROM a WHERE a.name = t.name AND key = '{k}') AS {k}" for k in KINDS)
ORACLES = {
    "f12_having_annotation": f"WITH {_A} SELECT name FROM a WHERE key = 'click' AND value = '7'",
    "f12_all_keys": f"WITH {_A} SELECT key, count(DISTINCT name) AS n FROM a GROUP BY key",
    "f12_retain": f"WITH {_A} SELECT * FROM a WHERE key IN ('click', 'view')",
    "f12_remove": f"WITH {_A} SELECT * FROM a WHERE key NOT IN ('click', 'view')",
    "f12_by_value": f"WITH {_A} SELECT value, name FROM a WHERE key = 'error'",
    "f12_unique_by_value": f"WITH {_A} SELECT DISTINCT CAST(name AS VARCHAR) AS value, name FROM a",
    "x16_annotation_text": f"WITH {_A} SELECT t.name, {_TEXT} FROM (SELECT DISTINCT name FROM a) t",
    "x16_annotation_mean": f"WITH {_A} SELECT name, round(avg(CASE WHEN key = 'click' THEN CAST(value AS DOUBLE) END), 6) AS mean_click, count(DISTINCT key) AS n_keys FROM a GROUP BY name",
    "a26_tissue_counts": "SELECT event_type AS tissue, user_id % 40 AS taxon, count(*) AS n FROM events GROUP BY 1, 2",
}
