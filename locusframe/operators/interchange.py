"""Registered round trips through the file formats: the derived calls are written, read again and returned (2.A, 2.B)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.operators.ordination import shared_folder
from locusframe.operators.relationship import _CEN, _kin, kinship
from locusframe.plans import fixture as fx
from locusframe.sources import readers, writers


def _path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/interchange-{uuid.uuid4().hex}"


def _cells(s: SparkSession, d: str) -> DataFrame:
    return fx.calls3(s, d).join(fx.sites(s, d), "site").select(F.concat(F.lit("T"), "taxon").alias("taxon"), "chr", "pos", "a1", "a2")


def _hapmap(s: SparkSession, d: str) -> DataFrame:
    path, cells = _path(s), _cells(s, d)
    writers.write_hapmap(cells, path, diploid=True, single=False)
    back = readers.read_hapmap(s, path)
    return back.where("a1 IS NOT NULL OR a2 IS NOT NULL").select("taxon", "chr", "pos", F.col("a1").cast("long").alias("a1"), F.col("a2").cast("long").alias("a2"))


def _vcf(s: SparkSession, d: str) -> DataFrame:
    path, cells = _path(s), fx.calls(s, d).join(fx.sites(s, d), "site").select(F.concat(F.lit("T"), "taxon").alias("taxon"), "chr", "pos", "a1", "a2")
    writers.write_vcf(cells, path, single=False)
    back = readers.read_vcf(s, path)
    return back.where("a1 IS NOT NULL").select("taxon", "chr", "pos", F.col("a1").cast("long").alias("a1"), F.col("a2").cast("long").alias("a2"))


def _phenotype(s: SparkSession, d: str) -> DataFrame:
    path = _path(s)
    p = fx.phenotypes(s, d).select(F.concat(F.lit("T"), "taxon").alias("taxon"), F.col("rep").cast("double").alias("rep"), "factor", "y")
    writers.write_phenotype(p, path)
    return readers.read_phenotype(s, path)


def _matrix(s: SparkSession, d: str) -> DataFrame:
    path = _path(s)
    writers.write_square_matrix(kinship(fx.calls(s, d)), path)
    m = readers.read_square_matrix(s, path)
    return m.select(F.col("taxon_i").cast("long").alias("i"), F.col("taxon_j").cast("long").alias("j"), F.round("value", 6).alias("value"))


def _table(s: SparkSession, d: str) -> DataFrame:
    path = _path(s)
    fx.table(s, d, "part").select("p_partkey", "p_brand", "p_size").write.option("sep", "\t").option("header", True).csv(path)
    return readers.read_table(s, path).select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_brand", F.col("p_size").cast("int").alias("p_size"))


def _taxa_json(s: SparkSession, d: str) -> DataFrame:
    path, c = _path(s), fx.table(s, d, "customer")
    anno = F.create_map(F.lit("segment"), F.array("c_mktsegment"), F.lit("nation"), F.array(F.col("c_nationkey").cast("string")))
    writers.write_taxa_json(c.select(F.concat(F.lit("C"), "c_custkey").alias("name"), anno.alias("anno")), path)
    return readers.read_taxa_json(s, path).select("name", F.col("anno")["segment"][0].alias("segment"), F.col("anno")["nation"][0].alias("nation"))


def _taxa_table(s: SparkSession, d: str) -> DataFrame:
    path, c = _path(s), fx.table(s, d, "customer")
    anno = F.create_map(F.lit("segment"), F.array("c_mktsegment"), F.lit("nation"), F.array(F.col("c_nationkey").cast("string")))
    writers.write_taxa_table(c.select(F.concat(F.lit("C"), "c_custkey").alias("name"), anno.alias("anno")), path, ["segment", "nation"], single=False)
    return readers.read_taxa_table(s, path).select("name", F.col("anno")["segment"][0].alias("segment"), F.col("anno")["nation"][0].alias("nation"))


def _positions_json(s: SparkSession, d: str) -> DataFrame:
    path = _path(s)
    writers.write_positions_json(fx.sites(s, d), path)
    return readers.read_positions_json(s, path).select("chr", "pos", "snp")


def _lines(rows: DataFrame, *cells: str) -> str:
    """Rows as tab-delimited text without a header."""
    path = _path(rows.sparkSession)
    rows.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in cells]).alias("value")).write.text(path)
    return path


def _bed(s: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    r = fx.table(s, d, "part").select(F.concat(F.lit("chr"), 1 + p % 5).alias("chr"), (p * 13).alias("start"), (p * 13 + F.col("p_size")).alias("end"), F.col("p_brand").alias("name"))
    return readers.read_bed(s, _lines(r, "chr", "start", "end", "name"), closed_shift=False)


def _gff(s: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    r = fx.table(s, d, "part").select((1 + p % 5).alias("chr"), F.lit("src").alias("source"), F.lit("gene").alias("type"), (p * 13).alias("start"), (p * 13 + F.col("p_size")).alias("stop"), F.lit(".").alias("score"), F.lit("+").alias("strand"), F.lit(".").alias("phase"), F.concat(F.lit("ID=g"), p, F.lit(";Parent=b"), p % 7).alias("anno"))
    return readers.read_gff(s, _lines(r, *r.columns)).select("id", "type", "parent_id", "chr", "start", "stop", "strand")


def _chr_pos(s: SparkSession, d: str) -> DataFrame:
    return readers.read_chr_pos(s, _lines(fx.sites(s, d), "chr", "pos"))


def _quality_scores(s: SparkSession, d: str) -> DataFrame:
    path = _path(s)
    fx.sites(s, d).select(F.col("chr").alias("CHROM"), F.col("pos").alias("POS"), (F.col("site") % 97 / 8).alias("QUALITYSCORE")).coalesce(1).write.option("sep", "\t").option("header", True).csv(path)
    return readers.read_quality_scores(s, path)


def _report(s: SparkSession, d: str) -> DataFrame:
    path = _path(s)
    writers.write_table(fx.table(s, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), path)
    return readers.read_table(s, path).select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", F.col("s_nationkey").cast("long").alias("s_nationkey"))


QUERIES = {
    "s01_k01_hapmap": _hapmap, "s03_k02_vcf": _vcf, "s05_k11_phenotype": _phenotype, "s08_k10_square_matrix": _matrix, "s10_table": _table,
    "s11_k13_taxa_json": _taxa_json, "s11_k13_positions_json": _positions_json, "s13_k14_taxa_table": _taxa_table, "s14_bed": _bed, "s17_gff": _gff,
    "s18_chr_pos": _chr_pos, "s18_quality_scores": _quality_scores, "k12_report": _report,
}

ORACLES = {
    "s01_k01_hapmap": f"WITH {fx.CALLS3}, {fx.SITES} SELECT 'T' || taxon AS taxon, chr, pos, a1, a2 FROM calls3 JOIN sites ON calls3.site = sites.site WHERE a1 IS NOT NULL OR a2 IS NOT NULL",
    "s03_k02_vcf": f"WITH {fx.CALLS}, {fx.SITES} SELECT 'T' || taxon AS taxon, chr, pos, a1, a2 FROM calls JOIN sites ON calls.site = sites.site WHERE a1 IS NOT NULL",
    "s05_k11_phenotype": f"WITH {fx.PHENO} SELECT 'T' || taxon AS taxon, CAST(rep AS DOUBLE) AS rep, factor, y FROM pheno",
    "s08_k10_square_matrix": f"WITH {fx.CALLS}, {_kin('calls', *_CEN)} SELECT i, j, round(value, 6) AS value FROM kin",
    "s10_table": "SELECT p_partkey, p_brand, p_size FROM part",
    "s11_k13_taxa_json": "SELECT 'C' || c_custkey AS name, c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation FROM customer",
    "s11_k13_positions_json": f"WITH {fx.SITES} SELECT chr, pos, 'S' || chr || '_' || pos AS snp FROM sites",
    "s13_k14_taxa_table": "SELECT 'C' || c_custkey AS name, c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation FROM customer",
    "s14_bed": """SELECT CAST(1 + p_partkey % 5 AS VARCHAR) AS chr, p_partkey * 13 + 1 AS "start", p_partkey * 13 + p_size AS "end", p_brand AS name FROM part""",
    "s17_gff": "SELECT 'g' || p_partkey AS id, 'gene' AS type, 'b' || (p_partkey % 7) AS parent_id, CAST(1 + p_partkey % 5 AS VARCHAR) AS chr, p_partkey * 13 AS start, p_partkey * 13 + p_size AS stop, '+' AS strand FROM part",
    "s18_chr_pos": f"WITH {fx.SITES} SELECT chr, pos FROM sites",
    "s18_quality_scores": f"WITH {fx.SITES} SELECT chr, pos, site % 97 / 8 AS quality FROM sites",
    "k12_report": "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey FROM supplier",
}
