"""Allele counts, site, sample and table summaries (A01-A16, F14, F17, U-free).

All are two-phase hash aggregates over ``calls(taxon, site, a1, a2)``; unknown codes are
null and never counted. Ranks of alleles are by count, then by code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from locusframe.functions import codes
from locusframe.plans import fixture as fx


def known_alleles(calls: DataFrame, by: str = "site") -> DataFrame:
    """One row for each known allele of each call."""
    return calls.select(by, F.explode(F.array("a1", "a2")).alias("allele")).where("allele IS NOT NULL")


def allele_counts(calls: DataFrame, most: int | None = None) -> DataFrame:
    """``site, allele, n, total, rk``; with ``most`` only codes below it."""
    ac = known_alleles(calls)
    if most is not None:
        ac = ac.where(F.col("allele") < most)
    ac = ac.groupBy("site", "allele").agg(F.count("*").alias("n"))
    by = Window.partitionBy("site")
    return ac.withColumn("total", F.sum("n").over(by)).withColumn("rk", F.row_number().over(by.orderBy(F.desc("n"), "allele")).cast("long"))


def allele_frequencies(calls: DataFrame, top: int | None = None) -> DataFrame:
    """Frequency of each allele among the known ones, of the ``top`` most frequent."""
    ac = allele_counts(calls)
    if top is not None:
        ac = ac.where(F.col("rk") <= top)
    return ac.select("site", "allele", "n", (F.col("n") / F.col("total")).alias("freq"))


def major_minor(calls: DataFrame) -> DataFrame:
    """First three alleles of each site with counts; a missing rank is null with count 0 and frequency 0."""
    ac = allele_counts(calls)
    pick = lambda k, c: F.max(F.when(F.col("rk") == k, F.col(c)))
    out = ac.groupBy("site").agg(
        pick(1, "allele").alias("major"), pick(2, "allele").alias("minor"), pick(3, "allele").alias("third"),
        F.coalesce(pick(1, "n"), F.lit(0)).alias("major_n"), F.coalesce(pick(2, "n"), F.lit(0)).alias("minor_n"), F.coalesce(pick(3, "n"), F.lit(0)).alias("third_n"), F.max("total").alias("total"),
        F.count("*").alias("n_alleles"),
    )
    shares = {f"{k}_freq": F.col(f"{k}_n") / F.col("total") for k in ("major", "minor", "third")}
    return out.withColumns({**shares, "all_minor": F.col("total") - F.col("major_n")})


def site_record(calls: DataFrame) -> DataFrame:
    """The record of a site: ``call_stats``, the minor allele's frequency (0 without one) and the gametes of all alleles but the major one."""
    m = major_minor(calls).select("site", F.col("minor_freq").alias("maf"), "all_minor")
    return call_stats(calls, "site").join(m, "site", "left").fillna({"maf": 0.0, "all_minor": 0})


def _het() -> Column:
    return codes.is_heterozygous(F.col("a1"), F.col("a2")).cast("long")


def call_stats(calls: DataFrame, by: str) -> DataFrame:
    """For each site or sample: cells, unknown, half-known, heterozygous and homozygous calls, known gametes, shares."""
    gametes = F.col("a1").isNotNull().cast("long") + F.col("a2").isNotNull().cast("long")
    out = calls.groupBy(by).agg(
        F.count("*").alias("cells"), F.sum((gametes == 0).cast("long")).alias("unknown"), F.sum((gametes == 1).cast("long")).alias("half"),
        F.sum(2 - gametes).alias("unknown_gametes"), F.sum(gametes).alias("known_gametes"), F.sum(_het()).alias("het"),
        F.sum(codes.is_homozygous(F.col("a1"), F.col("a2")).cast("long")).alias("hom"),
        F.max((F.coalesce("a1", F.lit(0)).isin(4, 5) | F.coalesce("a2", F.lit(0)).isin(4, 5)).cast("long")).alias("has_indel"),
    )
    known = F.col("cells") - F.col("unknown")
    return out.withColumn("prop_het", F.when(known > 0, F.col("het") / known).otherwise(0.0)).withColumn("prop_known", known / F.col("cells"))


def genotype_counts(calls: DataFrame, by: str | None = None) -> DataFrame:
    """Counts of diploid strings, alleles in code order, of each site or of the table."""
    geno = codes.diploid(F.least("a1", "a2"), F.greatest("a1", "a2"))
    rows = calls.where("a1 IS NOT NULL AND a2 IS NOT NULL").select(*([by] if by else []), geno.alias("genotype"))
    return rows.groupBy(*([by] if by else []), "genotype").agg(F.count("*").alias("n"))


def major_minor_counts(calls: DataFrame) -> DataFrame:
    """A10: sites of each major:minor pair; a site of one allele pairs it with itself."""
    m = major_minor(calls).select(F.concat(codes.letter(F.col("major")), F.lit(":"), codes.letter(F.coalesce("minor", "major"))).alias("pair"))
    return m.groupBy("pair").agg(F.count("*").alias("n"))


def site_summary(calls: DataFrame, n_taxa: int | None = None) -> DataFrame:
    """One row for each site. Proportions are of all gametes of ``n_taxa`` samples (default: the cells present), frequencies of known ones."""
    m = major_minor(calls).select("site", "major", "minor", "major_n", "minor_n", "major_freq", "minor_freq")
    s = call_stats(calls, "site")
    gametes = F.lit(2 * n_taxa) if n_taxa else 2 * F.col("cells")
    return s.join(m, "site", "left").select(
        "site", "cells", codes.letter(F.col("major")).alias("major"), codes.letter(F.col("minor")).alias("minor"),
        F.coalesce("major_n", F.lit(0)).alias("major_n"), F.coalesce("minor_n", F.lit(0)).alias("minor_n"),
        F.coalesce(F.col("major_n") / gametes, F.lit(0.0)).alias("major_prop"), F.coalesce("major_freq", F.lit(0.0)).alias("major_freq"),
        F.coalesce("minor_freq", F.lit(0.0)).alias("minor_freq"), "unknown_gametes", (F.col("unknown_gametes") / gametes).alias("prop_missing"), "het", "prop_het",
    )


def ranked_alleles(calls: DataFrame, first: int = 1, last: int = 6, n_taxa: int | None = None) -> DataFrame:
    """Alleles ``first`` to ``last`` by rank as columns ``allele_k``, ``n_k``, ``prop_k`` (of the gametes of ``n_taxa`` samples, default: of the
    cells present), ``freq_k`` (of known gametes); a missing rank is NA with 0, 0 and 0. One aggregate over the ranks, no pivot."""
    size = calls.groupBy("site").agg((F.lit(2 * n_taxa) if n_taxa else 2 * F.count("*")).alias("gametes"))
    ac = allele_counts(calls)
    at = lambda k, c: F.max(F.when(F.col("rk") == k, c))
    wide = ac.groupBy("site").agg(F.max("total").alias("total"), *[x for k in range(first, last + 1) for x in (at(k, codes.letter(F.col("allele"))).alias(f"allele_{k}"), at(k, F.col("n")).alias(f"n_{k}"))])
    j = size.join(wide, "site", "left")
    columns = []
    for k in range(first, last + 1):
        n = F.coalesce(F.col(f"n_{k}"), F.lit(0))
        columns += [F.coalesce(f"allele_{k}", F.lit("NA")).alias(f"allele_{k}"), n.alias(f"n_{k}"), (n / F.col("gametes")).alias(f"prop_{k}"), F.coalesce(n / F.col("total"), F.lit(0.0)).alias(f"freq_{k}")]
    return j.select("site", *columns)


def taxa_summary(calls: DataFrame) -> DataFrame:
    """One row for each sample."""
    s = call_stats(calls, "taxon")
    return s.select("taxon", "cells", "unknown_gametes", (F.col("unknown_gametes") / (2 * F.col("cells"))).alias("prop_missing"), "het", "prop_het")


def overall_summary(calls: DataFrame) -> DataFrame:
    """Fifteen rows ``stat, value`` of the whole table of samples by sites; a cell without a row is missing.

    A call is missing if both alleles are unknown; heterozygous calls are a share of all cells; a site without a minor
    allele counts as 0 in the mean of minor allele frequencies.
    """
    gametes = F.col("a1").isNotNull().cast("long") + F.col("a2").isNotNull().cast("long")
    t = calls.agg(
        F.countDistinct("taxon").alias("taxa"), F.countDistinct("site").alias("sites"), F.sum((gametes > 0).cast("long")).alias("known"),
        F.sum(gametes).alias("known_gametes"), F.sum(_het()).alias("het"),
    )
    t = t.crossJoin(major_minor(calls).agg(F.sum("minor_freq").alias("maf")))  # one row each
    cells = F.col("taxa") * F.col("sites")
    known, kg = F.coalesce("known", F.lit(0)), F.coalesce("known_gametes", F.lit(0))
    rows = [
        ("taxa", F.col("taxa")), ("sites", F.col("sites")), ("cells", cells), ("known", known), ("prop_known", F.try_divide(known, cells)), ("missing", cells - known),
        ("prop_missing", F.try_divide(cells - known, cells)), ("gametes", 2 * cells), ("known_gametes", kg), ("prop_known_gametes", F.try_divide(kg, 2 * cells)),
        ("missing_gametes", 2 * cells - kg), ("prop_missing_gametes", F.try_divide(2 * cells - kg, 2 * cells)), ("het", F.coalesce("het", F.lit(0))),
        ("prop_het", F.try_divide(F.coalesce("het", F.lit(0)), cells)), ("mean_minor_freq", F.try_divide(F.coalesce("maf", F.lit(0.0)), F.col("sites"))),
    ]
    return t.select(F.explode(F.array(*[F.struct(F.lit(k).alias("stat"), v.cast("double").alias("value")) for k, v in rows])).alias("r")).select("r.*")


def allele_summary(calls: DataFrame) -> DataFrame:
    """Counts of diploid strings over the table (unknown as N), share of all calls and of known ones; then those of
    major:minor pairs over sites, as shares of the sites, without a frequency."""
    known = F.col("a1").isNotNull() & F.col("a2").isNotNull()
    name = F.when(known, codes.diploid(F.least("a1", "a2"), F.greatest("a1", "a2"))).otherwise("N")
    g = calls.groupBy(name.alias("genotype")).agg(F.count("*").alias("n"))
    total = Window.partitionBy()  # a row for each genotype: a few dozen at most
    counts = g.select("genotype", "n", (F.col("n") / F.sum("n").over(total)).alias("prop"), F.when(F.col("genotype") != "N", F.col("n") / F.sum(F.when(F.col("genotype") != "N", F.col("n"))).over(total)).alias("freq"))
    sites = calls.agg(F.countDistinct("site").alias("sites"))
    pairs = major_minor_counts(calls).crossJoin(sites)  # one row
    return counts.unionByName(pairs.select(F.col("pair").alias("genotype"), "n", (F.col("n") / F.col("sites")).alias("prop"), F.lit(None).cast("double").alias("freq")))


def chromosome_summary(sites: DataFrame) -> DataFrame:
    """Sites of each chromosome, first and last position and site."""
    return sites.groupBy("chr").agg(F.count("*").alias("n_sites"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.min_by("site", "pos").alias("first_site"), F.max_by("site", "pos").alias("last_site"))


def depth_totals(cells: DataFrame, by: str) -> DataFrame:
    """Depth sums of each site or sample."""
    return cells.groupBy(by).agg(F.sum("depth").alias("depth"), F.max("depth").alias("max_depth"))


def depth_vectors(cells: DataFrame, by: str, codes_: int = 6) -> DataFrame:
    """Sums of the list ``depth`` (by allele code) of each site or sample, as columns ``d0``, ``d1``, ... ; missing entries add 0."""
    at = lambda k: F.coalesce(F.sum(F.greatest(F.get(F.col("depth"), F.lit(k)), F.lit(0))), F.lit(0))
    return cells.groupBy(by).agg(*[at(k).alias(f"d{k}") for k in range(codes_)])


SCORES = ("depth", "reference_probability", "dosage")


def score_types(cells: DataFrame) -> list[str]:
    """The kinds of scores that a table of cells holds."""
    return [k for k in SCORES if k in cells.columns]


def score_lookup(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """``taxon, site, score, value`` of the wanted cells (``taxon, site``), every kind of score; null where a cell has none."""
    kinds = score_types(cells)
    j = wanted.select("taxon", "site").distinct().join(cells.select("taxon", "site", *[F.col(k).cast("double").alias(k) for k in kinds]), ["taxon", "site"], "left")
    return j.unpivot(["taxon", "site"], kinds, "score", "value")


def polymorphic(calls: DataFrame) -> DataFrame:
    """whether a site has more than one known allele."""
    return calls.groupBy("site").agg((F.coalesce(F.greatest(F.max("a1"), F.max("a2")), F.lit(-1)) > F.coalesce(F.least(F.min("a1"), F.min("a2")), F.lit(-1))).alias("polymorphic"))


def _c(f, source=fx.calls):
    return lambda spark, sf_dir: f(source(spark, sf_dir))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), 6) for n in names})


def _a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the numeric values of an annotation list, null where none is a number."""
    ev = fx.table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").alias("k"))
    return ev.groupBy("user_id").agg(F.round(F.avg(F.try_to_number("k", F.lit("99999")).cast("double")), 6).alias("mean_k"), F.count("k").alias("n"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with depths by code: the depth under the first allele, a seventh's rest under the second."""
    at = lambda k: F.when(F.col("a1") == k, F.col("depth")).otherwise(0) + F.when(F.col("a2") == k, F.col("depth") % 7).otherwise(0)
    return fx.calls3(spark, sf_dir).select("taxon", "site", F.array(*[at(k) for k in range(6)]).alias("depth"))


def _a24(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.calls3(spark, sf_dir)
    cells = c.select("taxon", "site", "depth", ((F.col("depth") % 50) / 50).alias("reference_probability"), ((F.col("a1") == F.col("site") % 4).cast("long") + (F.col("a2") == F.col("site") % 4).cast("long")).alias("dosage"))
    wanted = c.select("taxon", F.expr("(site * 7 + taxon) % 420").alias("site"))  # some of them have no cell
    return _rounded(score_lookup(cells, wanted), "value")


QUERIES = {
    "a07_site_record": _c(lambda c: _rounded(site_record(c), "prop_het", "prop_known", "maf"), fx.calls3),
    "a11_ranked_alleles": _c(lambda c: _rounded(ranked_alleles(c, 1, 4), *[f"{x}_{k}" for k in range(1, 5) for x in ("prop", "freq")]), fx.calls3),
    "a15_depth_vectors_by_site": lambda s, d: depth_vectors(_vectors(s, d), "site"),
    "a15_depth_vectors_by_taxon": lambda s, d: depth_vectors(_vectors(s, d), "taxon"),
    "a24_score_lookup": _a24,
    "a01_allele_counts": _c(lambda c: allele_counts(c), fx.calls3),
    "a02_major_minor": _c(lambda c: _rounded(major_minor(c), "major_freq", "minor_freq", "third_freq"), fx.calls3),
    "a03_alleles_by_frequency": _c(lambda c: allele_counts(c, 6).select("site", "allele", "n", "rk"), fx.calls3),
    "a04_allele_freq": _c(lambda c: _rounded(allele_frequencies(c, 2), "freq"), fx.calls3),
    "a05_heterozygous": _c(lambda c: call_stats(c, "site").select("site", "het", "hom"), fx.calls3),
    "a06_gametes_known": _c(lambda c: call_stats(c, "taxon").select("taxon", "known_gametes", "unknown_gametes", "half"), fx.calls3),
    "a07_site_stats": _c(lambda c: _rounded(call_stats(c, "site"), "prop_het", "prop_known"), fx.calls3),
    "a08_taxon_stats": _c(lambda c: _rounded(call_stats(c, "taxon"), "prop_het", "prop_known"), fx.calls3),
    "a09_genotype_counts": _c(lambda c: genotype_counts(c), fx.calls3),
    "a09_site_genotype_counts": _c(lambda c: genotype_counts(c, "site"), fx.calls3),
    "a10_major_minor_counts": _c(major_minor_counts, fx.calls3),
    "a11_site_summary": _c(lambda c: _rounded(site_summary(c), "major_prop", "major_freq", "minor_freq", "prop_missing", "prop_het")),
    "a12_taxa_summary": _c(lambda c: _rounded(taxa_summary(c), "prop_missing", "prop_het")),
    "a13_overall_summary": _c(lambda c: _rounded(overall_summary(c), "value")),
    "a13_allele_summary": _c(lambda c: _rounded(allele_summary(c), "prop", "freq"), fx.calls3),
    "a14_chromosome_summary": lambda s, d: chromosome_summary(fx.sites(s, d)),
    "a15_depth_by_site": _c(lambda c: depth_totals(c, "site"), fx.calls3),
    "a15_depth_by_taxon": _c(lambda c: depth_totals(c, "taxon"), fx.calls3),
    "a16_average_annotation": _a16,
    "f14_polymorphic": _c(polymorphic),
}

_AC = """ac AS (SELECT site, allele, count(*) AS n FROM (SELECT site, a1 AS allele FROM calls3 UNION ALL SELECT site, a2 FROM calls3) t
  WHERE allele IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY site) AS BIGINT) AS total, row_number() OVER (PARTITION BY site ORDER BY n DESC, allele) AS rk FROM ac)"""
_MM = """m AS (SELECT site, max(CASE WHEN rk=1 THEN allele END) AS major, max(CASE WHEN rk=2 THEN allele END) AS minor, max(CASE WHEN rk=3 THEN allele END) AS third,
  coalesce(max(CASE WHEN rk=1 THEN n END), 0) AS major_n, coalesce(max(CASE WHEN rk=2 THEN n END), 0) AS minor_n, coalesce(max(CASE WHEN rk=3 THEN n END), 0) AS third_n, max(total) AS total, count(*) AS n_alleles FROM r GROUP BY site)"""
_L = "coalesce(['A','C','G','T','+','-','Z'][CAST({} AS INTEGER) + 1], 'N')"


def _stats(by: str) -> str:
    return f"""SELECT *, round(CASE WHEN cells > unknown THEN het / (cells - unknown) ELSE 0 END, 6) AS prop_het, round((cells - unknown) / cells, 6) AS prop_known FROM (
 SELECT {by}, count(*) AS cells, CAST(sum(CASE WHEN a1 IS NULL AND a2 IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unknown,
  CAST(sum(CASE WHEN (a1 IS NULL) <> (a2 IS NULL) THEN 1 ELSE 0 END) AS BIGINT) AS half, 2 * count(*) - count(a1) - count(a2) AS unknown_gametes,
  count(a1) + count(a2) AS known_gametes, CAST(sum(CASE WHEN a1 <> a2 THEN 1 ELSE 0 END) AS BIGINT) AS het, CAST(sum(CASE WHEN a1 = a2 THEN 1 ELSE 0 END) AS BIGINT) AS hom,
  CAST(max(CASE WHEN a1 IN (4,5) OR a2 IN (4,5) THEN 1 ELSE 0 END) AS BIGINT) AS has_indel FROM calls3 GROUP BY {by}) x"""


_W3 = f"WITH {fx.CALLS3}"
_GENO = f"{_L.format('least(a1, a2)')} || {_L.format('greatest(a1, a2)')}"
_VEC = ", ".join(f"CAST(sum(CASE WHEN a1 = {k} THEN depth ELSE 0 END + CASE WHEN a2 = {k} THEN depth % 7 ELSE 0 END) AS BIGINT) AS d{k}" for k in range(6))
ORACLES = {
    "a01_allele_counts": f"{_W3}, {_AC} SELECT site, allele, n, total, rk FROM r",
    "a02_major_minor": f"{_W3}, {_AC}, {_MM} SELECT *, round(major_n / total, 6) AS major_freq, round(minor_n / total, 6) AS minor_freq, round(third_n / total, 6) AS third_freq, total - major_n AS all_minor FROM m",
    "a03_alleles_by_frequency": f"{_W3}, {_AC} SELECT site, allele, n, row_number() OVER (PARTITION BY site ORDER BY n DESC, allele) AS rk FROM ac WHERE allele < 6",
    "a04_allele_freq": f"{_W3}, {_AC} SELECT site, allele, n, round(n / total, 6) AS freq FROM r WHERE rk <= 2",
    "a05_heterozygous": f"{_W3} SELECT site, het, hom FROM ({_stats('site')})",
    "a06_gametes_known": f"{_W3} SELECT taxon, known_gametes, unknown_gametes, half FROM ({_stats('taxon')})",
    "a07_site_stats": f"{_W3} {_stats('site')}",
    "a08_taxon_stats": f"{_W3} {_stats('taxon')}",
    "a09_genotype_counts": f"{_W3} SELECT {_GENO} AS genotype, count(*) AS n FROM calls3 WHERE a1 IS NOT NULL AND a2 IS NOT NULL GROUP BY 1",
    "a09_site_genotype_counts": f"{_W3} SELECT site, {_GENO} AS genotype, count(*) AS n FROM calls3 WHERE a1 IS NOT NULL AND a2 IS NOT NULL GROUP BY 1, 2",
    "a10_major_minor_counts": f"{_W3}, {_AC}, {_MM} SELECT {_L.format('major')} || ':' || {_L.format('coalesce(minor, major)')} AS pair, count(*) AS n FROM m GROUP BY 1",
    "a11_site_summary": f"""WITH {fx.CALLS}, calls3 AS (SELECT * FROM calls), {_AC}, {_MM}, s AS ({_stats('site')})
SELECT s.site, cells, {_L.format('major')} AS major, {_L.format('minor')} AS minor, coalesce(major_n, 0) AS major_n, coalesce(minor_n, 0) AS minor_n,
 round(coalesce(major_n / (2 * cells), 0), 6) AS major_prop, round(coalesce(major_n / total, 0), 6) AS major_freq, round(coalesce(minor_n / total, 0), 6) AS minor_freq,
 unknown_gametes, round(unknown_gametes / (2 * cells), 6) AS prop_missing, het, prop_het FROM s LEFT JOIN m ON s.site = m.site""",
    "a12_taxa_summary": f"WITH {fx.CALLS}, calls3 AS (SELECT * FROM calls) SELECT taxon, cells, unknown_gametes, round(unknown_gametes / (2 * cells), 6) AS prop_missing, het, prop_het FROM ({_stats('taxon')})",
    "a13_overall_summary": f"""WITH {fx.CALLS}, calls3 AS (SELECT * FROM calls), {_AC}, {_MM},
t AS (SELECT count(DISTINCT taxon) AS taxa, count(DISTINCT site) AS sites, count(DISTINCT taxon) * count(DISTINCT site) AS cells, count(*) FILTER (WHERE a1 IS NOT NULL OR a2 IS NOT NULL) AS known, count(a1) + count(a2) AS kg,
 count(*) FILTER (WHERE a1 <> a2) AS het, (SELECT sum(minor_n / total) FROM m) AS maf FROM calls)
SELECT stat, round(CAST(value AS DOUBLE), 6) AS value FROM (SELECT unnest(['taxa', 'sites', 'cells', 'known', 'prop_known', 'missing', 'prop_missing', 'gametes', 'known_gametes', 'prop_known_gametes', 'missing_gametes', 'prop_missing_gametes', 'het', 'prop_het', 'mean_minor_freq']) AS stat,
 unnest([taxa, sites, cells, known, known / cells, cells - known, (cells - known) / cells, 2 * cells, kg, kg / (2 * cells), 2 * cells - kg, (2 * cells - kg) / (2 * cells), het, het / cells, maf / sites]) AS value FROM t) x""",
    "a13_allele_summary": f"""{_W3}, {_AC}, {_MM}, g AS (SELECT CASE WHEN a1 IS NULL OR a2 IS NULL THEN 'N' ELSE {_GENO} END AS genotype, count(*) AS n FROM calls3 GROUP BY 1)
SELECT genotype, n, round(n / sum(n) OVER (), 6) AS prop, CASE WHEN genotype <> 'N' THEN round(n / sum(CASE WHEN genotype <> 'N' THEN n END) OVER (), 6) END AS freq FROM g
UNION ALL SELECT {_L.format('major')} || ':' || {_L.format('coalesce(minor, major)')}, count(*), round(count(*) / (SELECT count(DISTINCT site) FROM calls3), 6), NULL FROM m GROUP BY 1""",
    "a07_site_record": f"""{_W3}, {_AC}, {_MM}, s AS ({_stats('site')}) SELECT s.*, round(coalesce(minor_n / total, 0), 6) AS maf, coalesce(total - major_n, 0) AS all_minor FROM s LEFT JOIN m ON s.site = m.site""",
    "a11_ranked_alleles": f"""{_W3}, {_AC}, g AS (SELECT site, 2 * count(*) AS g FROM calls3 GROUP BY 1) SELECT g.site, """ + ", ".join(
        f"coalesce(max(CASE WHEN rk = {k} THEN {_L.format('allele')} END), 'NA') AS allele_{k}, coalesce(max(CASE WHEN rk = {k} THEN n END), 0) AS n_{k}, round(coalesce(max(CASE WHEN rk = {k} THEN n END), 0) / max(g), 6) AS prop_{k}, round(coalesce(max(CASE WHEN rk = {k} THEN n END) / max(total), 0), 6) AS freq_{k}"
        for k in range(1, 5)
    ) + " FROM g LEFT JOIN r ON g.site = r.site GROUP BY g.site",
    "a15_depth_vectors_by_site": f"{_W3} SELECT site, {_VEC} FROM calls3 GROUP BY site",
    "a15_depth_vectors_by_taxon": f"{_W3} SELECT taxon, {_VEC} FROM calls3 GROUP BY taxon",
    "a24_score_lookup": f"""{_W3}, w AS (SELECT DISTINCT taxon, (site * 7 + taxon) % 420 AS site FROM calls3), j AS (SELECT w.taxon, w.site, depth, a1, a2 FROM w LEFT JOIN calls3 c ON w.taxon = c.taxon AND w.site = c.site)
SELECT taxon, site, 'depth' AS score, CAST(depth AS DOUBLE) AS value FROM j UNION ALL SELECT taxon, site, 'reference_probability', depth % 50 / 50 FROM j
UNION ALL SELECT taxon, site, 'dosage', CASE WHEN a1 IS NOT NULL AND a2 IS NOT NULL THEN CAST(CAST(a1 = site % 4 AS INTEGER) + CAST(a2 = site % 4 AS INTEGER) AS DOUBLE) END FROM j""",
    "a14_chromosome_summary": f"WITH {fx.SITES} SELECT chr, count(*) AS n_sites, min(pos) AS first_pos, max(pos) AS last_pos, arg_min(site, pos) AS first_site, arg_max(site, pos) AS last_site FROM sites GROUP BY chr",
    "a15_depth_by_site": f"{_W3} SELECT site, CAST(sum(depth) AS BIGINT) AS depth, max(depth) AS max_depth FROM calls3 GROUP BY site",
    "a15_depth_by_taxon": f"{_W3} SELECT taxon, CAST(sum(depth) AS BIGINT) AS depth, max(depth) AS max_depth FROM calls3 GROUP BY taxon",
    "a16_average_annotation": "SELECT user_id, round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS mean_k, count(json_extract_string(props, '$.k')) AS n FROM events GROUP BY user_id",
    "f14_polymorphic": f"WITH {fx.CALLS} SELECT site, count(DISTINCT allele) > 1 AS polymorphic FROM (SELECT site, a1 AS allele FROM calls UNION ALL SELECT site, a2 FROM calls) t GROUP BY site",
}
