"""Called sequence of a GVCF over its reference, by a sweep over range partitions.

Records are blocks (of one depth and genotype up to an end) or variants, with bits that mask them (N is called) or
skip them (nothing is called). A position belongs to the record that starts last of those that hold it; blocks
may be longer than any partition. Depths decide a variant: two alleles seen are heterozygous and call N, few
reads of the alternate call N, three and more call it; few reads of the reference call the reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.operators import sweep
from locusframe.operators.joins import merge_intervals
from locusframe.plans import fixture as fx

STATES = ("uncovered", "skipped", "zero", "reference", "block_alternate", "het", "low_reference", "low_alternate", "alternate")
FIELDS = ["start", "ref", "alt", "gt", "ad", "depth", "is_block", "masked", "skipped"]


def flag(records: DataFrame, keys: DataFrame, bit: str) -> DataFrame:
    """flips the bit ``masked`` or ``skipped`` of the records (``chr, start``) that are in ``keys``; each is there once."""
    marked = records.join(keys.select("chr", "start", F.lit(True).alias("_flip")).distinct(), ["chr", "start"], "left")
    return marked.withColumn(bit, F.col(bit) != F.coalesce("_flip", F.lit(False))).select(*records.columns)


def overlay(reference: DataFrame, records: DataFrame) -> DataFrame:
    """``chr, pos, base, called, state, depth`` of every reference position (``chr, pos, base``).

    Records: ``chr, start, end, ref, alt`` (first alternate letters), ``gt``, ``ad`` (depths, the reference's first), ``depth,
    is_block, masked, skipped``. A variant's letters are called at its first position, '' at the others that it holds. ``state`` is one of STATES.
    Missing depths are 0 and missing bits false; a genotype without a number is the reference's.
    """
    found = sweep.covering(reference, records, "start", FIELDS, "r")
    r = lambda c: F.col(f"r.{c}")
    masked, skipped = F.coalesce(r("masked"), F.lit(False)), F.coalesce(r("skipped"), F.lit(False))
    depth = F.coalesce(r("depth"), F.lit(0))
    left = F.coalesce(F.regexp_extract(r("gt"), r"^(\d+)", 1).try_cast("int"), F.lit(0))
    seen = lambda i: F.coalesce(F.get(r("ad"), F.lit(i)), F.lit(0))
    ref, alt = F.coalesce(r("ref"), F.lit("")), F.coalesce(r("alt"), F.lit(""))
    block = F.coalesce(r("is_block"), F.lit(False))
    state = (
        F.when(r("start").isNull(), "uncovered").when(skipped, "skipped")
        .when(block & (masked | (depth == 0)), "zero").when(block & (left == 0), "reference").when(block, "block_alternate")
        .when((seen(0) > 0) & (seen(1) > 0), "het").when(seen(0).isin(1, 2), "low_reference").when(seen(1).isin(1, 2), "low_alternate")
        .when(seen(1) >= 3, "alternate").when(seen(0) >= 3, "reference").otherwise("zero")
    )
    found = found.withColumn("state", state)
    unknown = lambda text: F.repeat(F.lit("N"), F.length(text))
    s = F.col("state")
    letters = (
        F.when(s == "uncovered", "N").when(s == "skipped", "").when(block, F.when(s == "reference", F.col("base")).otherwise("N"))
        .when(F.col("pos") != r("start"), "")
        .when(s.isin("low_reference", "reference"), F.when(masked, unknown(ref)).otherwise(ref))
        .when(s == "alternate", F.when(masked, unknown(alt)).otherwise(alt))
        .when(s == "low_alternate", unknown(alt)).otherwise(unknown(ref))
    )
    return found.select(*reference.columns, letters.alias("called"), "state", F.when(s.isin("uncovered", "skipped"), 0).otherwise(depth).cast("long").alias("depth"))


def counters(called: DataFrame, by: tuple[str, ...] = ("chr",)) -> DataFrame:
    """Of each ``by``: positions, letters called, letters by kind of call, and the sum of depths over positions."""
    letters = lambda *states: F.sum(F.when(F.col("state").isin(*states), F.length("called")).otherwise(0)).cast("long")
    return called.groupBy(*by).agg(
        F.count("*").alias("ref_size"), F.sum(F.length("called")).cast("long").alias("size"), letters("het").alias("het"), letters("alternate").alias("alt"), letters("low_alternate").alias("hom_alt_low"),
        letters("low_reference").alias("hom_ref_low"), letters("uncovered", "zero").alias("zero_coverage"), F.sum("depth").alias("depth"),
    )


def covered_regions(records: DataFrame) -> DataFrame:
    """Runs of positions held by records that are not skipped, adjacent ones as one: ``chr, start, end, n``."""
    return merge_intervals(records.where(~F.coalesce("skipped", F.lit(False))).select("chr", "start", "end"), 1)


def from_records(read: DataFrame) -> DataFrame:
    """Records as ``overlay`` takes them, from ``read_gvcf``: a record with an END is a block; symbolic alternates are none."""
    alts = F.filter(F.split("alt", ","), lambda a: ~a.startswith("<") & (a != "."))
    return read.select(
        "chr", "start", "end", "ref", F.coalesce(F.get(alts, F.lit(0)), F.lit("")).alias("alt"), "gt", "ad", "depth",
        F.try_element_at("info", F.lit("END")).isNotNull().alias("is_block"), F.lit(False).alias("masked"), F.lit(False).alias("skipped"),
    )


def _reference(s: SparkSession, d: str) -> DataFrame:
    o = fx.table(s, d, "orders")
    base = F.element_at(F.array(*[F.lit(x) for x in "ACGT"]), (F.col("o_custkey") % 4 + 1).cast("int"))
    return o.select((1 + F.col("o_orderkey") % 5).cast("string").alias("chr"), F.col("o_orderkey").alias("pos"), base.alias("base"))


def _records(s: SparkSession, d: str) -> DataFrame:
    orders = fx.table(s, d, "orders").where("o_orderkey % 3 = 1")
    o, p = F.col("o_orderkey"), F.col("o_custkey")
    u, q = o * 31 % 997, o * 17 % 50
    block, size = p % 3 != 0, (1 + p % 4).cast("int")
    letters: Column = F.lit("ACGTACGT")
    end = F.when(block, o + q * F.when(u % 20 == 0, 400).otherwise(1)).otherwise(o + size - 1)
    return orders.select(
        (1 + o % 5).cast("string").alias("chr"), o.alias("start"), end.alias("end"), F.substring(letters, (1 + p % 4).cast("int"), size).alias("ref"),
        F.substring(letters, (1 + u % 4).cast("int"), (1 + u % 3).cast("int")).alias("alt"), F.when(p % 7 == 0, "1/1").when(p % 7 == 1, "0|1").otherwise("0/0").alias("gt"),
        F.array((u % 4).cast("int"), (p % 5).cast("int")).alias("ad"), (u % 5).cast("int").alias("depth"), block.alias("is_block"), (p % 11 == 0).alias("masked"), (p % 13 == 0).alias("skipped"),
    )


def _flipped(s: SparkSession, d: str) -> DataFrame:
    r = _records(s, d)
    keys = r.where("start % 9 = 1")
    return flag(flag(r, keys, "masked"), keys.where("start % 2 = 0"), "skipped").select("chr", "start", "masked", "skipped")


QUERIES = {
    "j08_gvcf_overlay": lambda s, d: overlay(_reference(s, d), _records(s, d)),
    "j08_gvcf_counters": lambda s, d: counters(overlay(_reference(s, d), _records(s, d))),
    "f22_flip_bits": _flipped,
    "k16_covered_regions": lambda s, d: covered_regions(_records(s, d)),
}

_REC = """o AS (SELECT o_orderkey AS s, o_custkey AS p, o_orderkey * 31 % 997 AS u, o_orderkey * 17 % 50 AS q FROM orders WHERE o_orderkey % 3 = 1),
rec AS (SELECT CAST(1 + s % 5 AS VARCHAR) AS chr, s, CASE WHEN p % 3 <> 0 THEN s + q * CASE WHEN u % 20 = 0 THEN 400 ELSE 1 END ELSE s + p % 4 END AS e,
 substr('ACGTACGT', 1 + p % 4, 1 + p % 4) AS ref, substr('ACGTACGT', 1 + u % 4, 1 + u % 3) AS alt, CASE WHEN p % 7 = 0 THEN 1 ELSE 0 END AS gl, u % 4 AS rd, p % 5 AS ad,
 u % 5 AS depth, p % 3 <> 0 AS block, p % 11 = 0 AS masked, p % 13 = 0 AS skipped FROM o)"""
_CALLED = f"""WITH {_REC}, ref AS (SELECT CAST(1 + o_orderkey % 5 AS VARCHAR) AS chr, o_orderkey AS pos, substr('ACGT', 1 + o_custkey % 4, 1) AS base FROM orders),
last AS (SELECT ref.chr, pos, base, max(s) AS s FROM ref LEFT JOIN rec ON ref.chr = rec.chr AND pos BETWEEN s AND e GROUP BY 1, 2, 3),
j AS (SELECT l.chr, l.pos, l.base, l.s, ref, alt, depth, masked, block, CASE WHEN l.s IS NULL THEN 'uncovered' WHEN skipped THEN 'skipped' WHEN block AND (masked OR depth = 0) THEN 'zero' WHEN block AND gl = 0 THEN 'reference' WHEN block THEN 'block_alternate'
  WHEN rd > 0 AND ad > 0 THEN 'het' WHEN rd IN (1, 2) THEN 'low_reference' WHEN ad IN (1, 2) THEN 'low_alternate' WHEN ad >= 3 THEN 'alternate' WHEN rd >= 3 THEN 'reference' ELSE 'zero' END AS state
  FROM last l LEFT JOIN rec ON l.chr = rec.chr AND l.s = rec.s),
called AS (SELECT chr, pos, base, CASE WHEN state = 'uncovered' THEN 'N' WHEN state = 'skipped' THEN '' WHEN block THEN CASE WHEN state = 'reference' THEN base ELSE 'N' END WHEN pos <> s THEN ''
  WHEN state IN ('low_reference', 'reference') THEN CASE WHEN masked THEN repeat('N', length(ref)) ELSE ref END WHEN state = 'alternate' THEN CASE WHEN masked THEN repeat('N', length(alt)) ELSE alt END
  WHEN state = 'low_alternate' THEN repeat('N', length(alt)) ELSE repeat('N', length(ref)) END AS called, state, CAST(CASE WHEN state IN ('uncovered', 'skipped') THEN 0 ELSE depth END AS BIGINT) AS depth FROM j)"""
_SUM = "CAST(sum(CASE WHEN state IN ({}) THEN length(called) ELSE 0 END) AS BIGINT)"
ORACLES = {
    "j08_gvcf_overlay": f"{_CALLED} SELECT * FROM called",
    "j08_gvcf_counters": f"""{_CALLED} SELECT chr, count(*) AS ref_size, CAST(sum(length(called)) AS BIGINT) AS size, {_SUM.format("'het'")} AS het, {_SUM.format("'alternate'")} AS alt, {_SUM.format("'low_alternate'")} AS hom_alt_low,
 {_SUM.format("'low_reference'")} AS hom_ref_low, {_SUM.format("'uncovered', 'zero'")} AS zero_coverage, CAST(sum(depth) AS BIGINT) AS depth FROM called GROUP BY chr""",
    "f22_flip_bits": f"WITH {_REC} SELECT chr, s AS start, masked <> (s % 9 = 1) AS masked, skipped <> (s % 9 = 1 AND s % 2 = 0) AS skipped FROM rec",
    "k16_covered_regions": f"""WITH {_REC}, m AS (SELECT chr, s, e, CASE WHEN max(e) OVER w IS NULL OR s > max(e) OVER w + 1 THEN 1 ELSE 0 END AS new FROM rec WHERE NOT skipped WINDOW w AS (PARTITION BY chr ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, sum(new) OVER (PARTITION BY chr ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT chr, min(s) AS "start", max(e) AS "end", count(*) AS n FROM i GROUP BY chr, island""",
}
