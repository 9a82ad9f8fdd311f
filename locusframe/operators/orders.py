"""Orders over all rows without a sort in one task: row numbers, seeded permutations, cluster order, merged lists.

Row numbers come from range partitions and their counts. A seeded permutation of 0..n-1 is a Feistel network over
a grid of about sqrt(n) x sqrt(n) numbers: each round adds a hash of one coordinate to the other, which can be undone, so
no two numbers meet; a number that lands beyond n goes through the network again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.operators import sweep
from locusframe.operators.relationship import _CEN, _kin, closest, kinship
from locusframe.plans import fixture as fx
from locusframe.plans.tables import keep_table

ROUNDS = 6
_WALK = 40


def numbered(df: DataFrame, order: list[str], name: str = "no", by: list[str] | None = None) -> DataFrame:
    """``df`` with its place from 0 on by ``order``, within ``by`` where given; rows that tie come in the order of a number that the input gives them."""
    by = by or []
    rows = sweep.dealt(df.withColumn("_tie", F.monotonically_increasing_id()), *by, *order, "_tie")
    return sweep.earlier(rows, by, [*by, *order, "_tie"], **{name: ("count", F.lit(1))}).drop("_tie", sweep.PART)


def shuffled(place: Column, n: Column | int, seed: Column | int) -> Column:
    """Where a permutation of 0..n-1 that ``seed`` gives puts ``place``; null where ``place`` or n is."""
    n = F.lit(n).cast("long") if isinstance(n, int) else n.cast("long")
    seed = F.lit(seed).cast("long") if isinstance(seed, int) else seed.cast("long")
    wide = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    wide = F.when(wide * wide < n, wide + 1).otherwise(wide)
    high = F.ceil(n / wide).cast("long")

    def once(x: Column) -> Column:
        start = F.struct(F.floor(x / wide).cast("long").alias("u"), (x % wide).alias("v"))

        def change(s: Column, i: Column) -> Column:
            u, v = s["u"], s["v"]
            return F.when(i % 2 == 0, F.struct(F.pmod(u + F.pmod(F.xxhash64(seed, i, v), high), high).alias("u"), v.alias("v"))).otherwise(
                F.struct(u.alias("u"), F.pmod(v + F.pmod(F.xxhash64(seed, i, u), wide), wide).alias("v"))
            )

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, change, lambda s: s["u"] * wide + s["v"])

    inside = F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), once(place), lambda x, i: F.when(x < n, x).otherwise(once(x)))
    return F.when(place.isNotNull() & n.isNotNull(), F.when(inside < n, inside).otherwise(F.raise_error(F.lit("a permutation left its numbers"))))


def permute(rows: DataFrame, value: str, key: str, seed: int, within: list[str] | None = None) -> DataFrame:
    """``rows`` with the value permuted among all rows, or among those of a group. Rows are numbered by ``key``, and each takes the value
    of the row that a seeded permutation of the numbers gives; groups have permutations of their own."""
    by = within or []
    at = keep_table(numbered(rows, [key], "_no", by))
    groups = [F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]
    many = at.groupBy(*groups).agg(F.count("*").alias("_n"))
    alike = lambda: reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)], F.lit(True))
    sized = at.join(many, alike()) if by else at.crossJoin(F.broadcast(many))  # without groups: one row
    own = F.xxhash64(F.lit(seed), *by) if by else F.lit(seed)
    wanted = sized.withColumn("_from", shuffled(F.col("_no"), F.col("_n"), own)).drop(value, *[f"_g{i}" for i in range(len(by))])
    given = at.select(*groups, F.col("_no").alias("_at"), F.col(value).alias("_value"))
    moved = wanted.join(given, (F.col("_from") == F.col("_at")) & alike())
    return moved.select(*[F.col("_value").alias(c) if c == value else F.col(c) for c in rows.columns])


def enumerate_order(spark: SparkSession, n: int, kind: str = "ordered", seed: int = 1, low: int = 0, high: int | None = None) -> DataFrame:
    """``place, index``: numbers 0..n-1 in order (``ordered``), permuted (``shuffled``), in turn from the order and the permutation
    (``alternating``: twice as many places), or those from ``low`` to below ``high`` permuted among themselves (``restricted``)."""
    if kind == "restricted":
        high = n if high is None else high
        return spark.range(high - low).select(F.col("id").alias("place"), (low + shuffled(F.col("id"), high - low, seed)).alias("index"))
    p = spark.range(2 * n if kind == "alternating" else n).select(F.col("id").alias("place"))
    mixed = {"ordered": F.col("place"), "shuffled": shuffled(F.col("place"), n, seed)}
    half = F.floor(F.col("place") / 2).cast("long")
    mixed["alternating"] = F.when(F.col("place") % 2 == 0, half).otherwise(shuffled(half, n, seed))
    return p.withColumn("index", mixed[kind])


def cluster_order(m: DataFrame) -> DataFrame:
    """``taxon, cluster, place``: samples of a matrix ``i, j, value`` in an order that keeps nearest neighbours together.

    Samples are taken by the distance to their nearest one, ties by name. Two that are both new begin a cluster, a single new one is
    put at the end of the other's; clusters never merge. So a sample enters by the first pair that it is in, behind the pair's other one if
    that was there before: a forest, whose roots are found by doubling steps towards them. ``cluster`` is its first sample. Samples without a distance
    come last, by name, without a cluster.
    """
    near = closest(m).select(F.struct("distance", "taxon").alias("at"), F.col("taxon").alias("a"), F.col("closest").alias("b"))
    near = keep_table(near)
    ends = near.select("at", F.col("a").alias("v"), F.col("b").alias("u"), F.lit(0).alias("second")).unionByName(near.select("at", F.col("b").alias("v"), F.col("a").alias("u"), F.lit(1).alias("second")))
    first = ends.groupBy("v").agg(F.min(F.struct("at", "second", "u")).alias("e")).select("v", "e.at", "e.second", "e.u")
    first = keep_table(first)
    other = first.select(F.col("v").alias("u"), F.col("at").alias("u_at"))
    up = first.join(other, "u").select("v", "at", "second", F.when(F.col("u_at") < F.col("at"), F.col("u")).when(F.col("second") == 1, F.col("u")).otherwise(F.col("v")).alias("root"))
    up = keep_table(up)  # a root is its own; the second of a first pair hangs on the first
    while True:
        step = up.select(F.col("v").alias("root"), F.col("root").alias("next"))
        now = keep_table(up.join(step, "root").select("v", "at", "second", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        done = not now.where("moved").head(1)
        up = now.drop("moved")
        if done:
            break
    begun = up.select(F.col("v").alias("root"), F.col("at").alias("begun"))
    placed = up.join(begun, "root").select(F.col("v").alias("taxon"), F.col("root").alias("cluster"), "begun", "at", "second")
    names = m.select(F.col("i").alias("taxon")).unionByName(m.select(F.col("j").alias("taxon"))).distinct()
    every = names.join(placed, "taxon", "left").withColumn("late", F.col("cluster").isNull())
    return numbered(every, ["late", "begun", "at", "second", "taxon"], "place").select("taxon", "cluster", "place")


def reorder(m: DataFrame, order: DataFrame) -> DataFrame:
    """The matrix with places for names, in the triangle i >= j."""
    at = order.select("taxon", "place")
    x = m.join(at.select(F.col("taxon").alias("i"), F.col("place").alias("x")), "i").join(at.select(F.col("taxon").alias("j"), F.col("place").alias("y")), "j")
    return x.select(F.greatest("x", "y").alias("i"), F.least("x", "y").alias("j"), "value")


def merged_order(lists: list[DataFrame]) -> DataFrame:
    """``taxon, place``: all samples of several lists (``taxon, seq``), each list's order kept as far as the earlier ones allow.

    The first list stands; of each further one, a sample that is not there yet goes behind the farthest sample that the list has named before
    it, after those already put there by this list, and to the front where it has named none. Only a sample's first place in a list counts.
    """
    once = lambda t: t.groupBy("taxon").agg(F.min("seq").alias("seq"))
    merged = keep_table(numbered(once(lists[0]), ["seq", "taxon"], "place").select("taxon", "place"))
    for t in lists[1:]:
        rows = once(t).join(merged, "taxon", "left").withColumn("_one", F.lit(0))
        rows = sweep.dealt(rows, "seq", "taxon")
        known = sweep.earlier(rows, [], ["seq", "taxon"], anchor=("max", F.col("place")))
        fresh = known.where("place IS NULL").select("taxon", F.coalesce("anchor", F.lit(-1)).alias("anchor"), F.lit(1).alias("new"), "seq")
        none = F.lit(None).cast(dict(fresh.dtypes)["seq"])
        both = merged.select("taxon", F.col("place").alias("anchor"), F.lit(0).alias("new"), none.alias("seq")).unionByName(fresh)
        merged = keep_table(numbered(both, ["anchor", "new", "seq", "taxon"], "place").select("taxon", "place"))
    return merged


def _permutation_facts(s: SparkSession, d: str) -> DataFrame:
    """What shows that shuffled numbers are a permutation, of the orders of each status."""
    o = keep_table(numbered(fx.table(s, d, "orders").select("o_orderstatus", "o_orderkey"), ["o_orderkey"], "no", ["o_orderstatus"]))
    n = o.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    p = o.join(n, "o_orderstatus").withColumn("to", shuffled(F.col("no"), F.col("n"), F.xxhash64("o_orderstatus")))
    return p.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.countDistinct("to").alias("different"), F.min("to").alias("low"), F.max("to").alias("high"), (F.sum((F.col("to") == F.col("no")).cast("long")) * 20 < F.count("*")).alias("moved"))


def _permuted(s: SparkSession, d: str) -> DataFrame:
    o = fx.table(s, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    p = permute(o, "o_totalprice", "o_orderkey", 7)
    kept = p.join(o.select("o_orderkey", F.col("o_totalprice").alias("was")), "o_orderkey")
    return kept.agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("keys"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.round(F.max("o_totalprice"), 2).alias("most"), (F.sum((F.col("was") != F.col("o_totalprice")).cast("long")) * 20 > 19 * F.count("*")).alias("moved"))


def _lists(s: SparkSession, d: str) -> list[DataFrame]:
    c = F.col("c_custkey")
    t = fx.table(s, d, "customer")
    return [t.where(c % 2 == 0).select(c.alias("taxon"), (c * 7919 % 100003).alias("seq")), t.where(c % 3 == 0).select(c.alias("taxon"), (c * 104729 % 100019).alias("seq")), t.where(c % 5 == 0).select(c.alias("taxon"), c.alias("seq"))]


QUERIES = {
    "t07_cluster_order": lambda s, d: cluster_order(keep_table(kinship(fx.calls(s, d)))).withColumn("cluster", F.col("cluster").cast("long")),
    "t09_shuffled": _permutation_facts,
    "m18_global_permutation": _permuted,
    "u02_merged_order": lambda s, d: merged_order(_lists(s, d)),
}

_MERGE = """s{k} AS (SELECT l.taxon, l.seq, m.place, max(m.place) OVER (ORDER BY l.seq, l.taxon ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor FROM l{k} l LEFT JOIN m{p} m ON l.taxon = m.taxon),
m{k} AS (SELECT taxon, row_number() OVER (ORDER BY anchor, new, seq, taxon) - 1 AS place FROM (SELECT taxon, place AS anchor, 0 AS new, NULL AS seq FROM m{p} UNION ALL SELECT taxon, coalesce(anchor, -1), 1, seq FROM s{k} WHERE place IS NULL) t)"""
ORACLES = {
    "t07_cluster_order": f"""WITH RECURSIVE {fx.CALLS}, {_kin('calls', *_CEN)}, two AS (SELECT i, j, value FROM kin WHERE i <> j AND value IS NOT NULL UNION ALL SELECT j, i, value FROM kin WHERE i <> j AND value IS NOT NULL),
near AS (SELECT i AS a, j AS b, value AS d FROM two QUALIFY row_number() OVER (PARTITION BY i ORDER BY value, j) = 1), t AS (SELECT a, b, row_number() OVER (ORDER BY d, a) AS tm FROM near),
ends AS (SELECT tm, a AS v, b AS u, 0 AS second FROM t UNION ALL SELECT tm, b, a, 1 FROM t), f AS (SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY v ORDER BY tm, second, u) = 1),
up AS (SELECT f.v, f.tm, f.second, CASE WHEN o.tm < f.tm OR f.second = 1 THEN f.u END AS parent FROM f JOIN f o ON f.u = o.v),
r AS (SELECT v, v AS root FROM up WHERE parent IS NULL UNION ALL SELECT up.v, r.root FROM up JOIN r ON up.parent = r.v)
SELECT r.v AS taxon, r.root AS cluster, row_number() OVER (ORDER BY b.tm, up.tm, up.second) - 1 AS place FROM r JOIN up ON r.v = up.v JOIN up b ON b.v = r.root""",
    "t09_shuffled": "SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_orderkey) AS different, min(0) AS low, count(*) - 1 AS high, count(*) > 0 AS moved FROM orders GROUP BY 1",
    "m18_global_permutation": "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys, round(sum(CAST(o_totalprice AS DOUBLE)), 2) AS total, round(max(CAST(o_totalprice AS DOUBLE)), 2) AS most, count(*) > 0 AS moved FROM orders",
    "u02_merged_order": f"""WITH l0 AS (SELECT c_custkey AS taxon, c_custkey * 7919 % 100003 AS seq FROM customer WHERE c_custkey % 2 = 0), l1 AS (SELECT c_custkey AS taxon, c_custkey * 104729 % 100019 AS seq FROM customer WHERE c_custkey % 3 = 0),
l2 AS (SELECT c_custkey AS taxon, c_custkey AS seq FROM customer WHERE c_custkey % 5 = 0), m0 AS (SELECT taxon, row_number() OVER (ORDER BY seq, taxon) - 1 AS place FROM l0), {_MERGE.format(k=1, p=0)}, {_MERGE.format(k=2, p=1)} SELECT * FROM m2""",
}
