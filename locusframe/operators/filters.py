"""Site and sample filters, masks, index selection and lookups.

Filter specifications are dataclasses; running one is an aggregate, a predicate and a
semi or anti join back to the calls.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField
from pyspark.sql.window import Window

from locusframe.operators.joins import range_join
from locusframe.operators.summary import allele_counts, call_stats
from locusframe.plans import fixture as fx


@dataclass(frozen=True)
class SiteFilter:
    """F01. Bounds are inclusive; ``positions``: (chr, first, last) closed ranges and ``names``: site names to include or exclude."""

    min_count: int = 0
    min_allele_freq: float = 0.0
    max_allele_freq: float = 1.0
    min_heterozygous: float = 0.0
    max_heterozygous: float = 1.0
    remove_minor_states: bool = False
    remove_indels: bool = False
    positions: tuple = field(default=())
    names: tuple = field(default=())
    include: bool = True

    def __post_init__(self) -> None:
        for name in ("min_allele_freq", "max_allele_freq", "min_heterozygous", "max_heterozygous"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} is a share: {getattr(self, name)}")
        if self.min_count < 0 or self.min_allele_freq > self.max_allele_freq or self.min_heterozygous > self.max_heterozygous:
            raise ValueError("a lower bound is above its upper bound")


@dataclass(frozen=True)
class TaxaFilter:
    """F02."""

    min_known: float = 0.0
    min_heterozygous: float = 0.0
    max_heterozygous: float = 1.0
    taxa: tuple = field(default=())
    include: bool = True


def filter_sites(calls: DataFrame, spec: SiteFilter, sites: DataFrame | None = None, listed: DataFrame | None = None, ranges: DataFrame | None = None, width: int = 1 << 14) -> DataFrame:
    """the calls of the sites that pass; minor states beyond the second allele become unknown where asked.

    ``sites`` (``site, chr, pos`` and maybe ``name``; else names are S<chr>_<pos>) is needed for positions, names, ``listed`` (``chr, pos``
    of a position file) and ``ranges`` (``chr, start, end`` of a BED file). A site in any of those given is included, or excluded.
    """
    s = call_stats(calls, "site")
    ac = allele_counts(calls)
    maf = ac.groupBy("site").agg(F.max(F.when(F.col("rk") == 2, F.col("n") / F.col("total"))).alias("maf"))
    s = s.join(maf, "site", "left").withColumn("maf", F.coalesce("maf", F.lit(0.0)))
    ok = (F.col("cells") - F.col("unknown") >= spec.min_count) & F.col("maf").between(spec.min_allele_freq, spec.max_allele_freq)
    ok = ok & F.col("prop_het").between(spec.min_heterozygous, spec.max_heterozygous)
    if spec.remove_indels:
        ok = ok & (F.col("has_indel") == 0)
    kept = s.where(ok).select("site")
    if spec.positions or spec.names or listed is not None or ranges is not None:
        if sites is None:
            raise ValueError("names, positions and ranges need the sites table")
        inside = F.lit(False)
        for chrom, first, last in spec.positions:
            inside = inside | ((F.col("chr") == chrom) & F.col("pos").between(first, last))
        if spec.names:
            inside = inside | (F.col("name") if "name" in sites.columns else F.concat(F.lit("S"), "chr", F.lit("_"), F.col("pos").cast("string"))).isin(list(spec.names))
        named = sites.where(inside).select("site")
        if listed is not None:
            named = named.unionByName(sites.join(listed.select("chr", "pos"), ["chr", "pos"], "left_semi").select("site"))
        if ranges is not None:
            named = named.unionByName(range_join(sites, ranges.select("chr", "start", "end"), width).select("site"))
        kept = kept.join(named, "site", "left_semi" if spec.include else "left_anti")
    out = calls.join(kept, "site", "left_semi")
    if spec.remove_minor_states:
        two = ac.where("rk <= 2").groupBy("site").agg(F.collect_list("allele").alias("two"))
        out = out.join(two, "site", "left")
        out = out.select(*[F.when(F.array_contains("two", F.col(c)), F.col(c)).alias(c) if c in ("a1", "a2") else F.col(c) for c in calls.columns])
    return out.select(*calls.columns)


def filter_taxa(calls: DataFrame, spec: TaxaFilter) -> DataFrame:
    """the calls of the samples that pass."""
    s = call_stats(calls, "taxon").where((F.col("prop_known") >= spec.min_known) & F.col("prop_het").between(spec.min_heterozygous, spec.max_heterozygous))
    if spec.taxa:
        named = F.col("taxon").isin(list(spec.taxa))
        s = s.where(named if spec.include else ~named)
    return calls.join(s.select("taxon"), "taxon", "left_semi").select(*calls.columns)


def filter_report(spark: SparkSession, spec: SiteFilter | TaxaFilter) -> DataFrame:
    """settings as rows of ``key, value``."""
    return spark.createDataFrame([(k, str(v)) for k, v in asdict(spec).items()], "key string, value string")


def translate(calls: DataFrame, index: DataFrame, axis: str = "site") -> DataFrame:
    """subset and reorder by ``index(new, old)``; old = -1 gives an all-unknown row for every partner present."""
    other = "taxon" if axis == "site" else "site"
    rest = [c for c in calls.columns if c not in (axis, other)]
    hit = index.where("old >= 0").join(calls, F.col("old") == F.col(axis)).select(F.col("new").alias(axis), other, *rest)
    empty = index.where("old < 0").crossJoin(calls.select(other).distinct())  # only for the empty rows asked for
    kinds = dict(calls.dtypes)
    return hit.unionByName(empty.select(F.col("new").alias(axis), other, *[F.lit(0 if c == "depth" else None).cast(kinds[c]).alias(c) for c in rest]))


def compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """one index that does what ``second`` after ``first`` does."""
    f = first.select(F.col("new").alias("mid"), F.col("old").alias("to"))
    return second.join(f, F.col("old") == F.col("mid"), "left").select("new", F.coalesce("to", F.lit(-1)).alias("old"))


def mask(calls: DataFrame, predicate: Column) -> DataFrame:
    """Calls where the predicate holds become unknown, their depth 0."""
    hidden = F.coalesce(predicate, F.lit(False))
    return calls.select(*[F.when(~hidden, F.col(c)).alias(c) if c in ("a1", "a2") else F.when(hidden, 0).otherwise(F.col(c)).alias(c) if c == "depth" else F.col(c) for c in calls.columns])


def mask_keys(calls: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """calls of the listed sites, samples or cells become unknown."""
    flagged = calls.join(keys.select(*on).distinct().withColumn("_masked", F.lit(True)), on, "left")
    return mask(flagged, F.col("_masked")).select(*calls.columns)


def keep(rows: DataFrame, names: DataFrame, on: str = "taxon", inverse: bool = False) -> DataFrame:
    """rows of the named samples, or of all others."""
    return rows.join(names.select(on), on, "left_anti" if inverse else "left_semi").select(*rows.columns)


def role(field_: StructField) -> str:
    """an attribute's role: from the column's metadata, else taxa for ``taxon``, factor for text, data for the rest."""
    return field_.metadata.get("role") or ("taxa" if field_.name == "taxon" else "factor" if field_.dataType.simpleString() == "string" else "data")


def keep_attributes(pheno: DataFrame, which: list[str | int]) -> DataFrame:
    """the named or numbered attributes, in their order; the sample stays in front."""
    names = [pheno.columns[w] if isinstance(w, int) else w for w in which]
    return pheno.select("taxon", *[n for n in names if n != "taxon"])


def change_role(pheno: DataFrame, roles: dict[str, str]) -> DataFrame:
    """attributes with other roles (covariate, data, factor); a factor becomes text, the others numbers."""
    for name, to in roles.items():
        if to not in ("covariate", "data", "factor") or name == "taxon":
            raise ValueError(f"{name} can't become {to}")
        pheno = pheno.withColumn(name, F.col(name).try_cast("string" if to == "factor" else "double")).withMetadata(name, {"role": to})
    return pheno


def sort_attributes(pheno: DataFrame) -> DataFrame:
    """Attributes in the order taxa, factor, covariate, data, then by name."""
    rank = {"taxa": 0, "factor": 1, "covariate": 2, "data": 3}
    return pheno.select(*[f.name for f in sorted(pheno.schema.fields, key=lambda f: (rank[role(f)], f.name))])


def complete_cases(rows: DataFrame) -> DataFrame:
    """rows without a missing value."""
    return rows.na.drop()


def locate(sites: DataFrame, wanted: DataFrame) -> DataFrame:
    """F16: of each ``(chr, pos)``: the first site there, else -(number of smaller positions) - 1.

    One sort of both tables by (chr, pos) with a running count; no join by range.
    """
    marks = sites.select("chr", "pos", F.col("site"), F.lit(0).alias("q")).unionByName(wanted.distinct().select("chr", "pos", F.lit(None).cast(dict(sites.dtypes)["site"]).alias("site"), F.lit(1).alias("q")))
    before = Window.partitionBy("chr").orderBy("pos").rangeBetween(Window.unboundedPreceding, -1)
    here = Window.partitionBy("chr", "pos")
    w = marks.withColumn("below", F.count("site").over(before)).withColumn("at", F.min("site").over(here))
    return w.where("q = 1").select("chr", "pos", F.col("at").alias("site"), F.when(F.col("at").isNull(), -F.col("below") - 1).otherwise(F.col("below")).alias("insertion"))


def order_violations(positions: DataFrame, order: str = "seq") -> DataFrame:
    """rows whose position is below that of the row before, within a chromosome."""
    w = Window.partitionBy("chr").orderBy(order)
    return positions.withColumn("previous", F.lag("pos").over(w)).where("pos < previous")


def as_strings(calls: DataFrame, first: int, last: int) -> DataFrame:
    """one string of IUPAC letters for each sample over sites first..last, in site order; N where there is no cell."""
    from locusframe.functions.codes import iupac

    rows = calls.where(F.col("site").between(first, last)).select("taxon", "site", iupac(F.col("a1"), F.col("a2")).alias("c"))
    have = rows.groupBy("taxon").agg(F.map_from_entries(F.collect_list(F.struct("site", "c"))).alias("m"))
    every = F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))
    return have.select("taxon", F.array_join(F.transform(every, lambda s: F.coalesce(F.try_element_at("m", s), F.lit("N"))), "").alias("calls"))


def trim_read(sequence: Column, quality: Column | None = None, least: int = 20, offset: int = 33) -> Column:
    """a read without its poly-A end; with a quality string, cut before the first base below ``least``."""
    if quality is not None:
        codes = F.transform(F.split(quality, ""), lambda q: F.ascii(q) - offset)
        low = F.array_position(F.transform(F.filter(codes, lambda x: x > -offset), lambda x: x < least), True)
        sequence = F.when(low > 0, F.substring(sequence, F.lit(1), (low - 1).cast("int"))).otherwise(sequence)
    return F.regexp_replace(sequence, "A{6,}$", "")


def top2(depths: Column) -> Column:
    """Indexes of the two largest depths, earlier ones first among equals."""
    ranked = F.array_sort(F.transform(depths, lambda d, i: F.struct((-d).alias("d"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, 2), lambda x: x["i"])


SPEC = SiteFilter(min_count=20, min_allele_freq=0.2, max_heterozygous=0.6)


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("site")
    return fx.sites(spark, sf_dir).where("site % 4 <= 1").select((399 - s).alias("new"), F.when(s % 8 == 0, -1).otherwise(s).alias("old"))


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "part").select((1 + F.col("p_partkey") % 5).cast("string").alias("chr"), (F.col("p_partkey") * 11 % 15000).alias("pos"))


def _beds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    return fx.table(spark, sf_dir, "part").where("p_size = 7").select((1 + p % 5).cast("string").alias("chr"), (p * 13 % 15000).alias("start"), (p * 13 % 15000 + 60).alias("end"))


def _f15(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.calls3(spark, sf_dir)
    indel = F.max(F.coalesce(F.greatest("a1", "a2"), F.lit(0)))
    return c.groupBy("site").agg((indel >= 4).alias("is_indel"), F.max(F.when(F.col("a1").isin(4, 5) | F.col("a2").isin(4, 5), 1).otherwise(0)).cast("long").alias("indel_size"))


QUERIES = {
    "f01_filter_sites": lambda s, d: filter_sites(fx.calls(s, d), SPEC),
    "f01_filter_site_ranges": lambda s, d: filter_sites(fx.calls3(s, d), SiteFilter(remove_indels=True, remove_minor_states=True, positions=(("1", 0, 9000), ("3", 5000, 20000))), fx.sites(s, d)),
    "f01_filter_site_files": lambda s, d: filter_sites(fx.calls(s, d), SiteFilter(names=("S1_100", "S3_174", "S4_211"), include=False), fx.sites(s, d), _wanted(s, d), _beds(s, d)),
    "f10_keep_attributes": lambda s, d: sort_attributes(change_role(keep_attributes(fx.phenotypes(s, d), [3, "rep"]), {"rep": "covariate"})),
    "f02_filter_taxa": lambda s, d: filter_taxa(fx.calls(s, d), TaxaFilter(min_known=0.5, max_heterozygous=0.49)),
    "f04_translate": lambda s, d: translate(fx.calls(s, d), _index(s, d)),
    "f05_translate_depth": lambda s, d: translate(fx.calls3(s, d), _index(s, d)),
    "f06_mask": lambda s, d: mask(fx.calls3(s, d), F.col("a1") != F.col("a2")),
    "f07_mask_sites": lambda s, d: mask_keys(fx.calls(s, d), fx.sites(s, d).where("pos % 3 = 0"), ["site"]),
    "f09_keep_taxa": lambda s, d: keep(fx.phenotypes(s, d), fx.calls(s, d).where("taxon < 25").select("taxon").distinct()),
    "f09_remove_taxa": lambda s, d: keep(fx.phenotypes(s, d), fx.calls(s, d).where("taxon < 25").select("taxon").distinct(), inverse=True),
    "f11_complete_cases": lambda s, d: complete_cases(fx.calls3(s, d)),
    "f15_indels": _f15,
    "f16_locate": lambda s, d: locate(fx.sites(s, d), _wanted(s, d)),
    "f18_as_strings": lambda s, d: as_strings(fx.calls3(s, d), 0, 49),
    "f23_trim": lambda s, d: fx.table(s, d, "part").select("p_partkey", trim_read(F.concat(F.upper("p_name"), F.repeat(F.lit("A"), (F.col("p_partkey") % 12).cast("int")))).alias("trimmed")),
    "f24_order_violations": lambda s, d: order_violations(fx.table(s, d, "part").select((F.col("p_size") % 5).cast("string").alias("chr"), (F.col("p_partkey") * 7919 % 1000).alias("pos"), F.col("p_partkey").alias("seq"))).select("chr", "seq", "pos", "previous"),
    "t01_sorted_positions": lambda s, d: fx.sites(s, d).withColumn("rk", F.row_number().over(Window.partitionBy("chr").orderBy("pos", "site")).cast("long")),
    "t05_top2_depths": lambda s, d: fx.calls3(s, d).select("taxon", "site", top2(F.array(F.col("depth") % 7, F.col("depth") % 5, F.col("depth") % 3)).alias("t")).select("taxon", "site", F.col("t")[0].cast("long").alias("first"), F.col("t")[1].cast("long").alias("second")),
}

_S = "coalesce(['A','C','G','T','+','-','Z'][CAST({} AS INTEGER) + 1], 'N')"
_IUP = f"""CASE WHEN a1 IS NULL AND a2 IS NULL THEN 'N' WHEN a1 IS NULL OR a2 IS NULL THEN {_S.format('coalesce(a1, a2)')} WHEN a1 = a2 THEN {_S.format('a1')}
 WHEN greatest(a1, a2) >= 4 THEN '0' ELSE CASE {_S.format('least(a1,a2)')} || {_S.format('greatest(a1,a2)')} WHEN 'AC' THEN 'M' WHEN 'AG' THEN 'R' WHEN 'AT' THEN 'W' WHEN 'CG' THEN 'S' WHEN 'CT' THEN 'Y' ELSE 'K' END END"""
_IDX = "idx AS (SELECT 399 - site AS new, CASE WHEN site % 8 = 0 THEN -1 ELSE site END AS old FROM sites WHERE site % 4 <= 1)"
ORACLES = {
    "f01_filter_sites": f"""WITH {fx.CALLS}, ac AS (SELECT site, allele, count(*) AS n FROM (SELECT site, a1 AS allele FROM calls UNION ALL SELECT site, a2 FROM calls) t WHERE allele IS NOT NULL GROUP BY 1, 2),
m AS (SELECT site, max(CASE WHEN rk = 2 THEN n / total END) AS maf FROM (SELECT *, sum(n) OVER (PARTITION BY site) AS total, row_number() OVER (PARTITION BY site ORDER BY n DESC, allele) AS rk FROM ac) GROUP BY site),
s AS (SELECT site, count(a1) AS known, avg(CASE WHEN a1 <> a2 THEN 1.0 WHEN a1 = a2 THEN 0.0 END) AS ph FROM calls GROUP BY site)
SELECT c.* FROM calls c WHERE site IN (SELECT s.site FROM s JOIN m ON s.site = m.site WHERE known >= 20 AND maf >= 0.2 AND ph <= 0.6)""",
    "f01_filter_site_ranges": f"""WITH {fx.CALLS3}, {fx.SITES}, ac AS (SELECT site, allele, count(*) AS n FROM (SELECT site, a1 AS allele FROM calls3 UNION ALL SELECT site, a2 FROM calls3) t WHERE allele IS NOT NULL GROUP BY 1, 2),
two AS (SELECT site, allele FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY n DESC, allele) AS rk FROM ac) WHERE rk <= 2),
ok AS (SELECT site FROM calls3 GROUP BY site HAVING max(CASE WHEN a1 IN (4,5) OR a2 IN (4,5) THEN 1 ELSE 0 END) = 0)
SELECT taxon, c.site, CASE WHEN (c.site, a1) IN (SELECT (site, allele) FROM two) THEN a1 END AS a1, CASE WHEN (c.site, a2) IN (SELECT (site, allele) FROM two) THEN a2 END AS a2, depth
FROM calls3 c WHERE c.site IN (SELECT site FROM ok) AND c.site IN (SELECT site FROM sites WHERE (chr = '1' AND pos BETWEEN 0 AND 9000) OR (chr = '3' AND pos BETWEEN 5000 AND 20000))""",
    "f01_filter_site_files": f"""WITH {fx.CALLS}, {fx.SITES}, q AS (SELECT CAST(1 + p_partkey % 5 AS VARCHAR) AS chr, p_partkey * 11 % 15000 AS pos FROM part),
b AS (SELECT CAST(1 + p_partkey % 5 AS VARCHAR) AS chr, p_partkey * 13 % 15000 AS lo FROM part WHERE p_size = 7)
SELECT * FROM calls WHERE site NOT IN (SELECT site FROM sites WHERE 'S' || chr || '_' || pos IN ('S1_100', 'S3_174', 'S4_211') OR EXISTS (SELECT 1 FROM q WHERE q.chr = sites.chr AND q.pos = sites.pos) OR EXISTS (SELECT 1 FROM b WHERE b.chr = sites.chr AND sites.pos BETWEEN lo AND lo + 60))""",
    "f10_keep_attributes": f"WITH {fx.PHENO} SELECT taxon, CAST(rep AS DOUBLE) AS rep, y FROM pheno",
    "f02_filter_taxa": f"WITH {fx.CALLS} SELECT * FROM calls WHERE taxon IN (SELECT taxon FROM calls GROUP BY taxon HAVING count(a1) / count(*) >= 0.5 AND avg(CASE WHEN a1 <> a2 THEN 1.0 WHEN a1 = a2 THEN 0.0 END) <= 0.49)",
    "f04_translate": f"WITH {fx.CALLS}, {fx.SITES}, {_IDX} SELECT new AS site, taxon, a1, a2 FROM idx JOIN calls ON old = site UNION ALL SELECT new, taxon, NULL, NULL FROM idx, (SELECT DISTINCT taxon FROM calls) t WHERE old < 0",
    "f05_translate_depth": f"WITH {fx.CALLS3}, {fx.SITES}, {_IDX} SELECT new AS site, taxon, a1, a2, depth FROM idx JOIN calls3 ON old = site UNION ALL SELECT new, taxon, NULL, NULL, 0 FROM idx, (SELECT DISTINCT taxon FROM calls3) t WHERE old < 0",
    "f06_mask": f"WITH {fx.CALLS3} SELECT taxon, site, CASE WHEN a1 <> a2 THEN NULL ELSE a1 END AS a1, CASE WHEN a1 <> a2 THEN NULL ELSE a2 END AS a2, CASE WHEN a1 <> a2 THEN 0 ELSE depth END AS depth FROM calls3",
    "f07_mask_sites": f"WITH {fx.CALLS} SELECT taxon, site, CASE WHEN (100 + site * 37) % 3 = 0 THEN NULL ELSE a1 END AS a1, CASE WHEN (100 + site * 37) % 3 = 0 THEN NULL ELSE a2 END AS a2 FROM calls",
    "f09_keep_taxa": f"WITH {fx.CALLS}, {fx.PHENO} SELECT * FROM pheno WHERE taxon IN (SELECT taxon FROM calls WHERE taxon < 25)",
    "f09_remove_taxa": f"WITH {fx.CALLS}, {fx.PHENO} SELECT * FROM pheno WHERE taxon NOT IN (SELECT taxon FROM calls WHERE taxon < 25)",
    "f11_complete_cases": f"WITH {fx.CALLS3} SELECT * FROM calls3 WHERE a1 IS NOT NULL AND a2 IS NOT NULL",
    "f15_indels": f"WITH {fx.CALLS3} SELECT site, max(coalesce(greatest(a1, a2), 0)) >= 4 AS is_indel, CAST(max(CASE WHEN a1 IN (4,5) OR a2 IN (4,5) THEN 1 ELSE 0 END) AS BIGINT) AS indel_size FROM calls3 GROUP BY site",
    "f16_locate": f"""WITH {fx.SITES}, q AS (SELECT DISTINCT CAST(1 + p_partkey % 5 AS VARCHAR) AS chr, p_partkey * 11 % 15000 AS pos FROM part)
SELECT q.chr, q.pos, (SELECT min(site) FROM sites s WHERE s.chr = q.chr AND s.pos = q.pos) AS site,
 CASE WHEN EXISTS (SELECT 1 FROM sites s WHERE s.chr = q.chr AND s.pos = q.pos) THEN (SELECT count(*) FROM sites s WHERE s.chr = q.chr AND s.pos < q.pos) ELSE -(SELECT count(*) FROM sites s WHERE s.chr = q.chr AND s.pos < q.pos) - 1 END AS insertion FROM q""",
    "f18_as_strings": f"""WITH {fx.CALLS3}, t AS (SELECT DISTINCT taxon FROM calls3 WHERE site BETWEEN 0 AND 49), g AS (SELECT taxon, unnest(range(0, 50)) AS site FROM t),
c AS (SELECT taxon, site, {_IUP} AS c FROM calls3)
SELECT g.taxon, string_agg(coalesce(c.c, 'N'), '' ORDER BY g.site) AS calls FROM g LEFT JOIN c ON g.taxon = c.taxon AND g.site = c.site GROUP BY g.taxon""",
    "f23_trim": "SELECT p_partkey, regexp_replace(upper(p_name) || repeat('A', CAST(p_partkey % 12 AS INTEGER)), 'A{6,}$', '') AS trimmed FROM part",
    "f24_order_violations": "SELECT chr, seq, pos, previous FROM (SELECT CAST(p_size % 5 AS VARCHAR) AS chr, p_partkey AS seq, p_partkey * 7919 % 1000 AS pos, lag(p_partkey * 7919 % 1000) OVER (PARTITION BY p_size % 5 ORDER BY p_partkey) AS previous FROM part) x WHERE pos < previous",
    "t01_sorted_positions": f"WITH {fx.SITES} SELECT *, row_number() OVER (PARTITION BY chr ORDER BY pos, site) AS rk FROM sites",
    "t05_top2_depths": f"""WITH {fx.CALLS3}, l AS (SELECT taxon, site, unnest([0, 1, 2]) AS i, unnest([depth % 7, depth % 5, depth % 3]) AS v FROM calls3),
r AS (SELECT *, row_number() OVER (PARTITION BY taxon, site ORDER BY v DESC, i) AS rk FROM l)
SELECT taxon, site, CAST(max(CASE WHEN rk = 1 THEN i END) AS BIGINT) AS first, CAST(max(CASE WHEN rk = 2 THEN i END) AS BIGINT) AS second FROM r GROUP BY 1, 2""",
}
