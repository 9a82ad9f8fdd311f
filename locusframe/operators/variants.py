"""Merged variant records: runs of adjacent indel sites as one record with whole alleles.

A site joins the record of the site before it if it is at most one base on and an insertion or gap is its reference or among
its calls. Records are found by runs over range partitions, so a chromosome may be split at any place of it. A sample's
two alleles in a record are its calls' letters in the order of the sites, without gaps and insertions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions import codes
from locusframe.operators import sweep
from locusframe.operators.scalars import chromosome_key
from locusframe.plans import fixture as fx
from locusframe.plans.tables import keep_table, shared_folder


def _letters(code: Column) -> Column:
    """The letters of an allele code in a merged allele: none for an insertion or gap, N for an unknown or undefined one."""
    return F.when(code.isin(4, 5), "").when(code.isNull() | (code > 5), "N").otherwise(codes.letter(code))


def indel_islands(sites: DataFrame) -> DataFrame:
    """Sites (``chr, pos, site, is_indel``) with ``island``, the number of the record of each within its chromosome; ``site`` tells
    sites of one position apart and orders them."""
    order = ["chr", "pos", "site"]
    rows = sweep.earlier(sweep.dealt(sites, *order), ["chr"], order, before=("last", F.col("pos")))
    fresh = F.when(F.col("is_indel") & (F.col("before") + 1 >= F.col("pos")), 0).otherwise(1)
    counted = sweep.earlier(rows.withColumn("_new", fresh), ["chr"], order, island=("sum", F.col("_new")))
    return counted.withColumn("island", F.col("island") + F.col("_new")).select(*sites.columns, "island")


def merged_variants(cells: DataFrame, sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records (``chr, island, start, end, ref, alts, n_sites``) and calls (``taxon, chr, island, g1, g2``).

    ``cells``: ``taxon, site, a1, a2``; ``sites``: ``site, chr, pos, ref`` (a code) and, where it is a column, the texts
    ``known``. ``g1`` and ``g2`` number the alleles, 0 for the reference, null where all sites of the record are unknown; an unknown call or
    absent cell among known ones is an N. Where some allele has no letter, an N stands before all of them and the record starts a
    base earlier (at position 1: after them). Alternates come by frequency, then by letters, then known ones that no sample has.
    """
    known = F.col("known") if "known" in sites.columns else F.array().cast("array<string>")
    indel = cells.groupBy("site").agg(F.max(F.coalesce(F.col("a1").isin(4, 5), F.lit(False)) | F.coalesce(F.col("a2").isin(4, 5), F.lit(False))).alias("_indel"))
    marked = sites.select("site", "chr", "pos", "ref", known.alias("known")).join(indel, "site", "left")
    marked = marked.withColumn("is_indel", F.coalesce("_indel", F.lit(False)) | F.coalesce(F.col("ref").isin(4, 5), F.lit(False))).drop("_indel")
    placed = keep_table(indel_islands(marked))
    key = ["chr", "island"]
    member = F.array_sort(F.collect_list(F.struct("pos", "site", "ref", "known")))  # as long as a run of adjacent indels
    records = placed.groupBy(*key).agg(member.alias("m"))
    records = records.select(*key, F.col("m")[0]["pos"].alias("start"), F.array_join(F.transform("m", lambda x: _letters(x["ref"])), "").alias("ref"), F.transform("m", lambda x: x["site"]).alias("sites"), F.array_distinct(F.flatten(F.transform("m", lambda x: F.coalesce(x["known"], F.array().cast("array<string>"))))).alias("known"))
    calls = cells.join(placed.select("site", *key), "site").groupBy("taxon", *key).agg(F.map_from_entries(F.collect_list(F.struct("site", F.struct(_letters(F.col("a1")).alias("x"), _letters(F.col("a2")).alias("y"))))).alias("c"))
    whole = lambda part: F.array_join(F.transform("sites", lambda i: F.coalesce(F.try_element_at("c", i)[part], F.lit("N"))), "")
    strings = keep_table(calls.join(records.select(*key, "sites"), key).select("taxon", *key, whole("x").alias("x"), whole("y").alias("y")))
    unknown = lambda c: F.col(c).rlike("^N+$")
    seen = strings.select(*key, F.explode(F.array(*[F.when(~unknown(c), F.col(c)) for c in "xy"])).alias("a")).where("a IS NOT NULL").groupBy(*key, "a").agg(F.count("*").alias("n"))
    listed = seen.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "a"))), lambda x: x["a"]).alias("seen"))
    records = records.join(listed, key, "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    records = records.withColumnRenamed("ref", "_bare").withColumnRenamed("start", "_first")
    bare, first = F.col("_bare"), F.col("_first")
    empty = (bare == "") | F.array_contains("seen", "")
    after = empty & (first <= 1)
    padded = lambda a: F.when(after, F.concat(a, F.lit("N"))).when(empty, F.concat(F.lit("N"), a)).otherwise(a)
    start = F.when(empty & ~after, first - 1).otherwise(first)
    alts = F.array_distinct(F.concat(F.transform(F.filter("seen", lambda a: a != bare), padded), F.filter("known", lambda a: a != padded(bare))))
    shaped = records.select(*key, start.alias("start"), (start + F.length(padded(bare)) - 1).alias("end"), padded(bare).alias("ref"), alts.alias("alts"), F.size("sites").cast("long").alias("n_sites"), "_bare", "seen")
    shaped = keep_table(shaped)
    at = lambda c: F.when(~unknown(c), F.when(F.col(c) == F.col("_bare"), 0).otherwise(F.array_position(F.filter("seen", lambda a: a != F.col("_bare")), F.col(c)))).cast("int")
    numbered = strings.join(shaped.select(*key, "_bare", "seen"), key).select("taxon", *key, at("x").alias("g1"), at("y").alias("g2"))
    return shaped.drop("_bare", "seen"), numbered


def write_variants(records: DataFrame, calls: DataFrame, path: str, single: bool = False) -> None:
    """Records and calls as VCF 4.2: INFO holds the number of samples with data and the alternates' frequencies."""
    from locusframe.sources.writers import _taxa, _wide, _write

    key, taxa = ["chr", "island"], _taxa(calls)
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    wide = _wide(calls, key, taxa, F.concat(name("g1"), F.lit("/"), name("g2")), "./.")
    each = calls.select(*key, "taxon", F.explode(F.array("g1", "g2")).alias("g")).where("g IS NOT NULL")
    counts = each.groupBy(*key, "g").agg(F.count("*").alias("n")).groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("g", "n"))).alias("n"), F.sum("n").alias("total"))
    data = calls.where("g1 IS NOT NULL OR g2 IS NOT NULL").groupBy(*key).agg(F.count("*").alias("ns"))
    rows = records.join(wide, key, "left").join(counts, key, "left").join(data, key, "left")
    share = F.transform("alts", lambda a, i: F.format_number(F.coalesce(F.try_element_at("n", i + 1), F.lit(0)) / F.col("total"), 4))
    info = F.concat(F.lit("NS="), F.coalesce("ns", F.lit(0)).cast("string"), F.when((F.size("alts") > 0) & F.col("total").isNotNull(), F.concat(F.lit(";AF="), F.array_join(share, ","))).otherwise(""))
    cells = F.coalesce("cells", F.array(*[F.lit("./.") for _ in taxa]))
    line = F.concat_ws("\t", "chr", F.col("start").cast("string"), F.lit("."), F.when(F.col("ref") == "", "N").otherwise(F.col("ref")), F.when(F.size("alts") > 0, F.array_join("alts", ",")).otherwise("."), F.lit("."), F.lit("PASS"), info, F.lit("GT"), cells)
    header = ["##fileformat=VCFv4.2", '##INFO=<ID=NS,Number=1,Type=Integer,Description="Samples with data">', '##INFO=<ID=AF,Number=A,Type=Float,Description="Allele frequency">', '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">']
    _write(rows, line, [*header, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *taxa])], path, [chromosome_key(F.col("chr")), "start", "island"], single)


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """``taxon, chr, start, ref, alts, info, x, y`` of a VCF with whole alleles: the letters of both calls, null where unknown."""
    from locusframe.sources.readers import _header, lines, normalise_chromosome

    text = lines(spark, path)
    taxa = _header(text, "#CHROM", "VCF").split("\t")[9:]
    c = F.col("c")
    alts = F.when(c[4] == ".", F.array().cast("array<string>")).otherwise(F.split(c[4], ","))
    body = text.where(~F.col("value").startswith("#") & (F.length("value") > 0)).select(F.split("value", "\t").alias("c"))
    rows = body.select(normalise_chromosome(c[0]).alias("chr"), c[1].cast("long").alias("start"), c[3].alias("ref"), alts.alias("alts"), F.str_to_map(c[7], F.lit(";"), F.lit("=")).alias("info"), F.posexplode(F.slice("c", 10, max(1, len(taxa)))).alias("i", "g"))
    gt = F.split(F.split("g", ":")[0], r"[/|]")
    allele = lambda k: F.get(F.concat(F.array("ref"), F.col("alts")), F.get(gt, F.lit(k)).try_cast("int"))
    return rows.select(F.get(F.array(*[F.lit(t) for t in taxa]), F.col("i")).alias("taxon"), "chr", "start", "ref", "alts", "info", allele(0).alias("x"), F.when(F.size(gt) > 1, allele(1)).otherwise(allele(0)).alias("y"))


def _sites(s: SparkSession, d: str) -> DataFrame:
    i = F.col("site")
    pos = 1 + F.floor(i / 5) + 2 * F.floor(i / 35)
    return fx.sites(s, d).select("site", "chr", pos.cast("long").alias("pos"), F.when(i % 11 == 0, 5).otherwise(i % 4).alias("ref"))


def _records(s: SparkSession, d: str) -> DataFrame:
    return merged_variants(fx.calls3(s, d), _sites(s, d))[0].select("chr", "start", "end", "ref", F.array_join("alts", ",").alias("alts"), "n_sites")


def _round_trip(s: SparkSession, d: str) -> DataFrame:
    path = f"{shared_folder(s)}/interchange-{uuid.uuid4().hex}"
    cells = fx.calls3(s, d).withColumn("taxon", F.concat(F.lit("T"), "taxon"))
    write_variants(*merged_variants(cells, _sites(s, d)), path)
    back = read_variants(s, path).where("x IS NOT NULL OR y IS NOT NULL")
    return back.select("taxon", "chr", "start", "ref", "x", "y", F.col("info")["NS"].cast("long").alias("ns"))


QUERIES = {"k19_variant_records": _records, "k19_variant_round_trip": _round_trip}

_LET = "CASE WHEN {0} IN (4, 5) THEN '' WHEN {0} IS NULL OR {0} > 5 THEN 'N' ELSE substr('ACGT', CAST({0} AS INTEGER) + 1, 1) END"
_VAR = f"""WITH {fx.CALLS3}, si AS (SELECT DISTINCT l_partkey % 400 AS site, CAST(1 + (l_partkey % 400) % 5 AS VARCHAR) AS chr, CAST(1 + (l_partkey % 400) // 5 + 2 * ((l_partkey % 400) // 35) AS BIGINT) AS pos, CASE WHEN (l_partkey % 400) % 11 = 0 THEN 5 ELSE (l_partkey % 400) % 4 END AS ref FROM lineitem),
ind AS (SELECT site, max(CASE WHEN a1 IN (4, 5) OR a2 IN (4, 5) THEN 1 ELSE 0 END) AS x FROM calls3 GROUP BY site),
b AS (SELECT si.*, lag(pos) OVER (PARTITION BY chr ORDER BY pos, si.site) AS p, coalesce(x, 0) = 1 OR ref IN (4, 5) AS indel FROM si LEFT JOIN ind ON si.site = ind.site),
isl AS (SELECT *, sum(CASE WHEN indel AND p + 1 >= pos THEN 0 ELSE 1 END) OVER (PARTITION BY chr ORDER BY pos, site ROWS UNBOUNDED PRECEDING) AS island FROM b),
rr AS (SELECT chr, island, min(pos) AS start, string_agg({_LET.format('ref')}, '' ORDER BY pos, site) AS ref, count(*) AS n_sites FROM isl GROUP BY 1, 2),
tx AS (SELECT DISTINCT taxon, chr, island FROM calls3 JOIN isl ON calls3.site = isl.site),
st AS (SELECT tx.taxon, tx.chr, tx.island, string_agg({_LET.format('a1')}, '' ORDER BY pos, isl.site) AS x, string_agg({_LET.format('a2')}, '' ORDER BY pos, isl.site) AS y
  FROM tx JOIN isl ON tx.chr = isl.chr AND tx.island = isl.island LEFT JOIN calls3 c ON c.taxon = tx.taxon AND c.site = isl.site GROUP BY 1, 2, 3),
al AS (SELECT chr, island, a, count(*) AS n FROM (SELECT chr, island, x AS a FROM st UNION ALL SELECT chr, island, y FROM st) t WHERE NOT regexp_matches(a, '^N+$') GROUP BY 1, 2, 3),
em AS (SELECT rr.chr, rr.island, rr.ref = '' OR coalesce(bool_or(a = ''), false) AS empty FROM rr LEFT JOIN al ON rr.chr = al.chr AND rr.island = al.island GROUP BY rr.chr, rr.island, rr.ref),
pad AS (SELECT rr.*, CASE WHEN empty AND start > 1 THEN 'N' ELSE '' END AS pre, CASE WHEN empty AND start <= 1 THEN 'N' ELSE '' END AS post FROM rr JOIN em ON rr.chr = em.chr AND rr.island = em.island)"""
ORACLES = {
    "k19_variant_records": f"""{_VAR} SELECT p.chr, start - length(pre) AS start, start - length(pre) + length(pre || p.ref || post) - 1 AS "end", pre || p.ref || post AS ref,
 coalesce(string_agg(pre || a || post, ',' ORDER BY n DESC, a) FILTER (WHERE a <> p.ref), '') AS alts, n_sites FROM pad p LEFT JOIN al ON p.chr = al.chr AND p.island = al.island GROUP BY p.chr, p.island, start, pre, p.ref, post, n_sites""",
    "k19_variant_round_trip": f"""{_VAR}, ns AS (SELECT chr, island, count(*) AS ns FROM st WHERE NOT regexp_matches(x, '^N+$') OR NOT regexp_matches(y, '^N+$') GROUP BY 1, 2)
SELECT 'T' || taxon AS taxon, st.chr, start - length(pre) AS start, pre || p.ref || post AS ref, CASE WHEN NOT regexp_matches(x, '^N+$') THEN pre || x || post END AS x, CASE WHEN NOT regexp_matches(y, '^N+$') THEN pre || y || post END AS y, ns
FROM st JOIN pad p ON st.chr = p.chr AND st.island = p.island JOIN ns ON ns.chr = st.chr AND ns.island = st.island WHERE NOT regexp_matches(x, '^N+$') OR NOT regexp_matches(y, '^N+$')""",
}
