"""Differences and neighbours of k-mer codes.

Two k-mers with at most ``cap`` different bases have one of ``cap + 1`` segments in common, wherever the differences are, so pairs come from
equi-joins on segments. In a segment that more than ``wide`` different k-mers share, the other bases are split into ``cap + 1``
pieces again, and a pair has to have one of those in common too, so such a group is not paired off as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.operators.scalars import kmer_distance
from locusframe.plans import fixture as fx
from locusframe.plans.tables import keep_table


def capped_difference(a: Column, b: Column, k: int, cap: int) -> Column:
    """Number of different bases of two codes of k bases, k where there are more than ``cap``."""
    d = kmer_distance(a, b)
    return F.when(d > cap, k).otherwise(d)


def prefix_difference(a: Column, b: Column, k: int, length: int, cap: int) -> Column:
    """Number of different bases among the first ``length`` of k, counted up to ``cap``."""
    cut = lambda c: F.shiftrightunsigned(c, 2 * (k - length))
    return F.least(kmer_distance(cut(a), cut(b)), F.lit(cap))


def _masks(bases: list[int], parts: int) -> list[tuple[int, list[int]]]:
    """The bases dealt into ``parts`` segments: the mask of each and the bases that are not in it."""
    edges = [round(i * len(bases) / parts) for i in range(parts + 1)]
    out = []
    for a, b in zip(edges, edges[1:], strict=False):
        own = bases[a:b]
        out.append((sum(3 << 2 * p for p in own), [p for p in bases if p not in own]))
    return out


def neighbours(kmers: DataFrame, k: int, cap: int, wide: int = 64) -> DataFrame:
    """``a, b, difference`` of all pairs of different codes (column ``code``, of k <= 31 bases) with at most ``cap`` different bases, a < b.

    Repeated codes count once and nulls not at all; ``cap`` of k or more would pair all codes and raises.
    """
    if not 0 < cap < k:
        raise ValueError("cap is from 1 to k - 1")
    codes = keep_table(kmers.select("code").where("code IS NOT NULL").distinct())
    segments = _masks(list(range(k)), cap + 1)
    keys = F.array(*[F.struct(F.lit(i).alias("i"), F.col("code").bitwiseAND(F.lit(m)).alias("s")) for i, (m, _) in enumerate(segments)])
    rows = codes.select("code", F.explode(keys).alias("x")).select("code", "x.i", "x.s")
    sizes = rows.groupBy("i", "s").agg(F.count("*").alias("n")).where("n > 1")
    rows = keep_table(rows.join(sizes, ["i", "s"]))
    none = F.array(F.struct(F.lit(-1).alias("j"), F.lit(0).cast("long").alias("t")))
    again = none
    for i, (_, rest) in enumerate(segments):
        if len(rest) > cap:
            pieces = F.array(*[F.struct(F.lit(j).alias("j"), F.col("code").bitwiseAND(F.lit(m)).alias("t")) for j, (m, _) in enumerate(_masks(rest, cap + 1))])
            again = F.when((F.col("n") > wide) & (F.col("i") == i), pieces).otherwise(again)
    rows = keep_table(rows.select("code", "i", "s", F.explode(again).alias("y")).select("code", "i", "s", "y.j", "y.t"))
    other = rows.withColumnRenamed("code", "b")
    pairs = rows.withColumnRenamed("code", "a").join(other, ["i", "s", "j", "t"]).where("a < b")
    d = kmer_distance(F.col("a"), F.col("b")).cast("long")
    return pairs.select("a", "b", d.alias("difference")).where(F.col("difference") <= cap).distinct()


def _codes(s: SparkSession, d: str) -> DataFrame:
    return fx.table(s, d, "part").select((F.col("p_partkey") * 40503 % 65536).alias("code"))


def _differences(s: SparkSession, d: str) -> DataFrame:
    c, p = F.col("code"), F.lit(27).cast("long")
    return _codes(s, d).distinct().select("code", capped_difference(c, p, 8, 3).cast("long").alias("capped"), prefix_difference(c, p, 8, 5, 2).cast("long").alias("first"))


QUERIES = {"x06_neighbours": lambda s, d: neighbours(_codes(s, d), 8, 2), "x06_differences": _differences}

_D = " + ".join(f"CAST(({{0}} >> {2 * i}) & 3 <> ({{1}} >> {2 * i}) & 3 AS BIGINT)" for i in range(8))
_D5 = " + ".join(f"CAST(({{0}} >> {2 * i}) & 3 <> ({{1}} >> {2 * i}) & 3 AS BIGINT)" for i in range(3, 8))
_C = "c AS (SELECT DISTINCT p_partkey * 40503 % 65536 AS code FROM part)"
ORACLES = {
    "x06_neighbours": f"WITH {_C} SELECT a, b, difference FROM (SELECT x.code AS a, y.code AS b, {_D.format('x.code', 'y.code')} AS difference FROM c x JOIN c y ON x.code < y.code) WHERE difference <= 2",
    "x06_differences": f"WITH {_C} SELECT code, CASE WHEN d > 3 THEN 8 ELSE d END AS capped, least(f, 2) AS first FROM (SELECT code, {_D.format('code', '27')} AS d, {_D5.format('code', '27')} AS f FROM c)",
}
