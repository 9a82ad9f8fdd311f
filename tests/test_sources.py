"""Round trips and reader rules on the five-site micro table (tie, monomorphic, all missing, half missing, indel)."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.operators.filters import SiteFilter
from locusframe.sources import readers as R
from locusframe.sources import writers as W

CELLS = [
    ("T1", "1", 10, 0, 0), ("T2", "1", 10, 0, 1), ("T3", "1", 10, 1, 1), ("T1", "1", 20, 0, 0), ("T2", "1", 20, 0, 0), ("T3", "1", 20, 0, 0),
    ("T1", "1", 30, None, None), ("T2", "1", 30, None, None), ("T3", "1", 30, None, None), ("T1", "2", 5, 0, None), ("T2", "2", 5, 0, 1), ("T3", "2", 5, 2, 2),
    ("T1", "10", 1, 4, 5), ("T2", "10", 1, 5, 5), ("T3", "10", 1, 4, 4),
]


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame(CELLS, "taxon string, chr string, pos long, a1 int, a2 int")


def rows(df, *cols):
    return sorted([tuple(r) for r in df.select(*cols).collect()], key=str)


def text(spark, path):
    return [r["value"] for r in spark.read.text(str(path)).collect()]


def test_hapmap_round_trip_and_order(spark, cells, tmp_path):
    W.write_hapmap(cells, str(tmp_path / "h"), diploid=True)
    out = text(spark, tmp_path / "h")
    assert [x.split("\t")[0] for x in out] == ["rs#", "S1_10", "S1_20", "S1_30", "S2_5", "S10_1"]
    assert out[1].split("\t")[1] == "A/C" and out[3].split("\t")[1] == "NA" and out[3].endswith("NN\tNN\tNN")
    assert rows(R.read_hapmap(spark, str(tmp_path / "h")), "taxon", "chr", "pos", "a1", "a2") == sorted(CELLS, key=str)
    W.write_hapmap(cells, str(tmp_path / "h1"))
    one = {(r[0], r[1], r[2]): r[3:] for r in rows(R.read_hapmap(spark, str(tmp_path / "h1")), "taxon", "chr", "pos", "a1", "a2")}
    assert one["T2", "1", 10] == (0, 1) and one["T1", "2", 5] == (0, 0) and one["T1", "10", 1] == (4, 5)


def test_hapmap_rejects_bad_rows(spark, tmp_path):
    head = "\t".join([*R.HAPMAP_COLUMNS, "T1"])
    fixed = "s\tA/C\tchr1\t5\t+\tNA\tNA\tNA\tNA\tNA\tNA"
    (tmp_path / "a.hmp.txt").write_text(f"{head}\n{fixed}\tA\tC\n")
    (tmp_path / "b.hmp.txt").write_text(f"{head}\n{fixed}\tQ\n")
    for name in ("a", "b"):
        with pytest.raises(Exception, match="columns|illegal"):
            R.read_hapmap(spark, str(tmp_path / f"{name}.hmp.txt")).collect()
    with gzip.open(tmp_path / "c.hmp.txt.gz", "wt") as f:
        f.write(f"##SAMPLE=<ID=T1,pop=x,loc=y>\n##odd\n{head}\n{fixed}\tM\n")
    assert rows(R.read_hapmap(spark, str(tmp_path / "c.hmp.txt.gz")), "taxon", "chr", "pos", "a1", "a2") == [("T1", "1", 5, 0, 1)]
    assert rows(R.read_sample_annotations(spark, str(tmp_path / "c.hmp.txt.gz")), "taxon", "key", "value") == [("T1", "loc", "y"), ("T1", "pop", "x")]
    assert R.sniff(spark, str(tmp_path / "c.hmp.txt.gz")) == "hapmap"


def test_vcf_round_trip(spark, cells, tmp_path):
    W.write_vcf(cells.where("chr <> '10'"), str(tmp_path / "v"))
    back = {(r[0], r[1], r[2]): r[3:] for r in rows(R.read_vcf(spark, str(tmp_path / "v")), "taxon", "chr", "pos", "a1", "a2")}
    assert back["T2", "1", 10] == (0, 1) and back["T3", "2", 5] == (2, 2) and back["T1", "1", 30] == (None, None) and back["T1", "2", 5] == (0, None)
    deep = cells.withColumn("depth", F.array(*[F.lit(x) for x in (3, 1, 0, 0, 2, 2)]))
    W.write_vcf(deep, str(tmp_path / "d"))
    last = text(spark, tmp_path / "d")[-1].split("\t")
    assert last[8] == "GT:AD:DP:GQ:PL" and last[3:5] == ["NI", "N"] and last[9].split(":")[1] == "2,2"


def test_haplotype_vcf(spark, tmp_path):
    (tmp_path / "x.vcf").write_text(
        '##ALT=<ID=h1,Description="A:c1:5-9">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\n'
        "chr1\t1\t.\tA\t<h1>,<h2>\t.\t.\tEND=100\tGT\t1/2\t.\n"
    )
    got = rows(R.read_haplotype_vcf(spark, str(tmp_path / "x.vcf")), "taxon", "pos", "end", "k", "haplotype", "asm_contig", "asm_start", "asm_end")
    assert got == sorted([("S1", 1, 100, 0, "h1", "c1", 5, 9), ("S1", 1, 100, 1, "h2", None, None, None), ("S2", 1, 100, 0, None, None, None, None)], key=str)
    assert R.sniff(spark, str(tmp_path / "x.vcf")) == "haplotype_vcf"


def test_numeric_phenotype_traits(spark, tmp_path):
    (tmp_path / "n").write_text("<Numeric>\n<Marker>\tS1_5\todd\nT1\t0.5\tNA\nT2\t1\t0\n")
    assert rows(R.read_numeric_genotype(spark, str(tmp_path / "n")), "taxon", "marker", "chr", "pos", "value")[0] == ("T1", "S1_5", "1", 5, 0.5)
    (tmp_path / "p").write_text("<Phenotype>\ntaxa\tdata\tcov\tfactor\ntaxon\ty\tq\tenv\nT1\t1.5\tNaN\tE1\nT1\t.\t2\tE2\n")
    p = R.read_phenotype(spark, str(tmp_path / "p"))
    assert rows(p, "taxon", "y", "q", "env") == [("T1", 1.5, None, "E1"), ("T1", None, 2.0, "E2")]
    assert [f.metadata["role"] for f in p.schema.fields] == ["taxa", "data", "covariate", "factor"]
    W.write_phenotype(p, str(tmp_path / "p2"))
    assert rows(R.read_phenotype(spark, str(tmp_path / "p2")), "taxon", "y", "q", "env") == rows(p, "taxon", "y", "q", "env")
    (tmp_path / "t").write_text("<Trait>\tyld\tyld\tht\n<Header name=env>\tE1\tE2\tE1\nT1\t1\t2\t-999\n")
    assert rows(R.read_traits(spark, str(tmp_path / "t")), "taxon", "env", "yld", "ht") == [("T1", "E1", 1.0, None), ("T1", "E2", 2.0, None)]
    W.write_plink_phenotype(p, str(tmp_path / "pp"))
    assert text(spark, tmp_path / "pp")[0] == "FID\tIID\ty\tq"


def test_matrices(spark, tmp_path):
    m = spark.createDataFrame([(0, 0, 1.0), (1, 0, 0.25), (1, 1, 1.5), (2, 0, -0.5), (2, 1, 0.0), (2, 2, 2.0)], "i int, j int, value double")
    W.write_square_matrix(m, str(tmp_path / "m"), {"Matrix_Type": "Centered_IBS"})
    back = R.read_square_matrix(spark, str(tmp_path / "m"))
    assert rows(back, "i", "j", "value") == rows(m, "i", "j", "value")
    assert R.sniff(spark, str(tmp_path / "m")) == "square_matrix"
    tri = np.array([1.0, 0.25, 1.5, -0.5, 0, 2.0], "<f4")
    (tmp_path / "k.grm.bin").write_bytes(tri.tobytes())
    (tmp_path / "k.grm.N.bin").write_bytes(np.full(6, 9, "<f4").tobytes())
    assert rows(R.read_grm_binary(spark, str(tmp_path / "k")), "i", "j", "value", "n") == [(*r, 9) for r in rows(m, "i", "j", "value")]
    W.write_phylip_distance(m, str(tmp_path / "ph"))
    assert text(spark, tmp_path / "ph")[1].split() == ["0", "1.00000", "0.25000", "-0.50000"]
    W.write_darwin(m, str(tmp_path / "dar"))
    assert text(spark, tmp_path / "dar" / "dis")[-1] == "3\t-0.5\t0.0"
    W.write_grm_raw(m, str(tmp_path / "raw"))
    assert text(spark, tmp_path / "raw")[1] == "2\t1\t1\t0.25"


def test_lists_and_annotations(spark, tmp_path):
    taxa = spark.createDataFrame([("T1", {"pop": ["a", "b"]}), ('T"2', {})], "name string, anno map<string,array<string>>")
    W.write_taxa_json(taxa, str(tmp_path / "j"))
    got = {r["name"]: r["anno"] for r in R.read_taxa_json(spark, str(tmp_path / "j")).collect()}
    assert got["T1"] == {"pop": ["a", "b"]} and 'T"2' in got
    W.write_taxa_table(taxa.where("name = 'T1'"), str(tmp_path / "tt"), ["pop", "loc"])
    assert R.read_taxa_table(spark, str(tmp_path / "tt")).first()["anno"] == {"pop": ["a", "b"]}
    sites = spark.createDataFrame([("1", 10, "x", 0.25)], "chr string, pos long, snp string, maf double")
    W.write_positions_json(sites, str(tmp_path / "pj"))
    assert rows(R.read_positions_json(spark, str(tmp_path / "pj")), "chr", "pos", "snp", "maf") == [("1", 10, "x", 0.25)]
    W.write_filter_json(SiteFilter(min_count=3), spark, str(tmp_path / "f"))
    assert R.read_filter_json(spark, str(tmp_path / "f"))["min_count"] == 3
    (tmp_path / "b.bed").write_text("chr1\t0\t10\tg\nchr2\t5\t6\n")
    assert rows(R.read_bed(spark, str(tmp_path / "b.bed")), "chr", "start", "end", "name") == [("1", 1, 11, "g"), ("2", 6, 7, None)]
    (tmp_path / "g.fasta").write_text(">chr1 first one\nACGT\nAC\n>2\nTT\n")
    assert rows(R.read_fasta(spark, str(tmp_path / "g.fasta")), "chr", "description", "seq") == [("1", "first one", "ACGTAC"), ("2", "", "TT")]
    (tmp_path / "x.gff").write_text("##gff\nchr1\ts\tgene\t5\t9\t.\t+\t.\tID=g1\nchr1\ts\tmRNA\t5\t9\t.\t+\t.\tID=m1;Parent=g1\n")
    assert rows(R.read_gff(spark, str(tmp_path / "x.gff")), "id", "type", "parent_id", "start", "stop") == [("g1", "gene", None, 5, 9), ("m1", "mRNA", "g1", 5, 9)]
    (tmp_path / "x.gvcf").write_text("#CHROM\n1\t5\t.\tA\t<NON_REF>\t.\t.\tEND=9;X\tGT:DP:GQ\t0/0:7:30\n1\t12\t.\tAC\tA\t.\t.\t.\tGT\t0/1\n")
    assert rows(R.read_gvcf(spark, str(tmp_path / "x.gvcf")), "start", "end", "gt", "depth", "quality") == [(12, 13, "0/1", None, None), (5, 9, "0/0", 7, 30)]
    (tmp_path / "cp").write_text("chr1 5\n# no\n2\t7\n")
    assert rows(R.read_chr_pos(spark, str(tmp_path / "cp")), "chr", "pos") == [("1", 5), ("2", 7)]


def test_sequence_exports(spark, cells, tmp_path):
    W.write_fasta(cells, str(tmp_path / "f"))
    assert text(spark, tmp_path / "f")[:4] == [">T1", "AANA0", ">T2", "MANM-"]
    W.write_fasta(cells, str(tmp_path / "g"), gaps=False)
    assert text(spark, tmp_path / "g")[3] == "MANM"
    W.write_phylip(cells, str(tmp_path / "p"))
    assert text(spark, tmp_path / "p")[0] == "3 5"
    W.write_clustalw(cells, str(tmp_path / "c"))
    assert text(spark, tmp_path / "c")[0] == "CLUSTAL W"
    W.write_plink(cells, str(tmp_path / "pl"))
    assert text(spark, tmp_path / "pl" / "ped")[0].split("\t")[-3:] == ["0 0", "A 0", "+ D"]
    W.write_delimited(cells, str(tmp_path / "dl"))
    assert text(spark, tmp_path / "dl")[0].split("\t")[-1] == "S10_1"


def test_report_table(spark, tmp_path):
    t = spark.createDataFrame([(1, 0.5), (2, -0.5), (3, 1234567.0), (4, 0.0001), (5, None)], "k int, x double")
    W.write_table(t, str(tmp_path / "t"))
    assert [x.split("\t")[1] for x in text(spark, tmp_path / "t")] == ["x", "0.5", "-5.0E-1", "1.235E6", "1.0E-4", "NaN"]
    assert W.numbered("a/b.hmp.txt", 2, 3) == "a/b2.hmp.txt" and W.numbered("b.txt", 1, 1) == "b.txt"
    assert json.loads("{}") == {}


def test_missing_numbers_by_format(spark, tmp_path):
    (tmp_path / "p").write_text("<Phenotype>\ntaxa\tdata\nTaxa\ty\nA\t-99\nB\tNA\n")
    assert [(r[0], r[1]) for r in R.read_phenotype(spark, str(tmp_path / "p")).orderBy("Taxa").collect()] == [("A", -99.0), ("B", None)]
    (tmp_path / "t").write_text("<Trait>\ty\nA\t-99\nB\t-1\n")
    assert [(r[0], r[1]) for r in R.read_traits(spark, str(tmp_path / "t")).orderBy("taxon").collect()] == [("A", None), ("B", -1.0)]


@pytest.fixture
def many_parts(spark):
    """Writers leave a part file for each shuffle partition, as they do with larger tables."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def parts(path):
    return [p for p in path.iterdir() if p.name.startswith("part-")]


def test_json_lists_of_several_parts(spark, tmp_path, many_parts):
    taxa = spark.range(200).select(F.concat(F.lit('{T",'), "id").alias("name"), F.create_map(F.lit("k"), F.array(F.concat(F.lit("]},"), "id"))).alias("anno"))
    taxa = taxa.unionByName(taxa.where("name LIKE '%7'"))  # repeated items share a line
    W.write_taxa_json(taxa, str(tmp_path / "j"))
    assert len(parts(tmp_path / "j")) > 1
    back = R.read_taxa_json(spark, str(tmp_path / "j"))
    assert rows(back, "name", "anno") == rows(taxa, "name", "anno") and back.count() == 220
    sites = spark.range(200).select((F.col("id") % 3).cast("string").alias("chr"), F.col("id").alias("pos"))
    W.write_positions_json(sites, str(tmp_path / "p"))
    assert len(parts(tmp_path / "p")) > 1 and rows(R.read_positions_json(spark, str(tmp_path / "p")), "chr", "pos") == rows(sites, "chr", "pos")


def test_phenotype_whose_first_part_is_not_the_largest(spark, tmp_path, many_parts):
    """A scan begins with the largest part; with few rows the header lines are in several parts."""
    for n, folder in ((400, "many rows"), (2, "few")):
        pheno = spark.range(n).select(F.format_string("T%04d", "id").alias("taxon"), F.repeat(F.lit("x"), (F.col("id") + 1).cast("int")).alias("factor"), (F.col("id") / 4).alias("y"))
        W.write_phenotype(pheno, str(tmp_path / folder))
        back = R.read_phenotype(spark, str(tmp_path / folder))
        assert len(parts(tmp_path / folder)) > 1 and rows(back, *pheno.columns) == rows(pheno, *pheno.columns)


def test_json_lists_in_other_forms(spark, tmp_path):
    """Objects in one line or over many, one in each file of a folder."""
    items = [{"name": "a", "anno": {"k": ["v", "w"]}}, {"name": "b", "anno": {"k": "x"}}]
    want = [("a", {"k": ["v", "w"]}), ("b", {"k": ["x"]})]
    forms = [json.dumps({"TaxaList": items}), json.dumps({"TaxaList": items}, indent=1), json.dumps({"made": 1, "TaxaList": items}), '{"TaxaList":[\n{"name":"a","anno":{"k":["v",\n"w"]}},\n{"name":"b","anno":{"k":"x"}}\n]}', '{"TaxaList":[\n{"name":"a","anno":{"k":["v","w"]}},\n{"name":"b","anno":{"k":"x"}}\n]}']
    for i, form in enumerate(forms):
        (tmp_path / f"{i}.json").write_text(form)
        assert rows(R.read_taxa_json(spark, str(tmp_path / f"{i}.json")), "name", "anno") == want
    assert len(rows(R.read_taxa_json(spark, str(tmp_path)), "name")) == 2 * len(forms)
