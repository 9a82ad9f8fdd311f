"""Readers of genotype, phenotype, matrix, list and annotation files (S01-S18, S23-S27) as DataFrames.

Headers are read with one small job (``head``), then the body is parsed by column
expressions over the text source, so files split across tasks. gzip files are read by
Spark's codec; they don't split.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions import codes
from locusframe.operators.scalars import decode_snp_name, normalise_chromosome

# Texts that stand for a missing number.
MISSING = ("NaN", "NA", ".", "")
TRAIT_MISSING = (*MISSING, "-99", "-999")  # trait files
HAPMAP_COLUMNS = ("rs#", "alleles", "chrom", "pos", "strand", "assembly#", "center", "protLSID", "assayLSID", "panelLSID", "QCcode")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of plain or gzip text, without a trailing carriage return."""
    return spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value"))


def first_lines(spark: SparkSession, path: str, n: int) -> list[str]:
    """The first ``n`` lines with text, by the order of the files' names: a scan of several files begins with the largest one."""
    found: list[str] = []
    for file in sorted(spark.read.text(path).inputFiles()):
        this = F.col("_metadata.file_path").endswith(re.sub("^[a-zA-Z0-9+.-]+:/+", "", file))  # schemes are written with one slash or three
        text = spark.read.text(path).where(this & (F.length(F.trim("value")) > 0))
        found += [r["value"] for r in text.select(F.regexp_replace("value", "\r$", "").alias("value")).head(n - len(found))]
        if len(found) == n:
            break
    return found


def crawl(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Paths and sizes of the files below a folder whose names match."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "length", "modificationTime")


def _header(text: DataFrame, begins: str, what: str) -> str:
    found = text.where(F.col("value").startswith(begins)).head(1)
    if not found:
        raise ValueError(f"no line that begins with {begins!r}: not a {what} file")
    return found[0]["value"]


def number(text: Column, missing: tuple[str, ...] = MISSING) -> Column:
    """A number, null for the texts of missing values and for anything unparsable."""
    return F.when(~F.trim(text).isin(*missing), F.trim(text).try_cast("double"))


def read_hapmap(spark: SparkSession, path: str) -> DataFrame:
    """``taxon, site, chr, pos, snp, alleles, strand, a1, a2`` of a Hapmap file; one- or two-letter calls by each cell's width.

    A row with another number of columns or an illegal call raises while the query runs.
    """
    text = lines(spark, path)
    taxa = _header(text, "rs#", "Hapmap").split("\t")[len(HAPMAP_COLUMNS) :]
    cell = F.split("value", "\t")
    body = text.where(~F.col("value").startswith("rs#") & ~F.col("value").startswith("##") & (F.length("value") > 0)).select(cell.alias("c"))
    width = len(HAPMAP_COLUMNS) + len(taxa)
    body = body.withColumn("c", F.when(F.size("c") == width, F.col("c")).otherwise(F.raise_error(F.concat(F.lit(f"a Hapmap row needs {width} columns: "), F.array_join(F.slice("c", 1, 4), " ")))))
    names = F.array(*[F.lit(t) for t in taxa])
    rows = body.select(F.col("c")[0].alias("snp"), F.col("c")[1].alias("alleles"), normalise_chromosome(F.col("c")[2]).alias("chr"), F.col("c")[3].cast("long").alias("pos"), F.col("c")[4].alias("strand"), F.posexplode(F.slice("c", len(HAPMAP_COLUMNS) + 1, len(taxa))).alias("i", "g"))
    legal = F.upper("g").rlike(r"^[ACGTNMRWSYKXZ+\-0]$|^[ACGTNXZ+\-]{2}$")
    a1, a2 = codes.call_of(F.when(legal, F.col("g")).otherwise(F.raise_error(F.concat(F.lit("illegal call "), F.col("g")))))
    return rows.select(F.get(names, F.col("i")).alias("taxon"), "chr", "pos", "snp", "alleles", "strand", a1.alias("a1"), a2.alias("a2"))


def read_sample_annotations(spark: SparkSession, path: str) -> DataFrame:
    """``taxon, key, value`` of ``##SAMPLE=<ID=name,key=value,...>`` lines."""
    inner = F.regexp_extract("value", r"^##SAMPLE=<(.*)>$", 1)
    m = lines(spark, path).where(F.col("value").startswith("##SAMPLE=<")).select(F.str_to_map(inner, F.lit(","), F.lit("=")).alias("m"))
    return m.select(F.col("m")["ID"].alias("taxon"), F.explode("m").alias("key", "value")).where("key <> 'ID'")


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """``taxon, chr, pos, snp, ref, alt, info, a1, a2, depth`` of a SNP VCF; ``depth`` is the AD list.

    <INS> and I are +, <DEL> and D are -, * is unknown; of longer alleles the second base counts, - where there is none.
    """
    text = lines(spark, path)
    taxa = _header(text, "#CHROM", "VCF").split("\t")[9:]
    c = F.split("value", "\t")
    body = text.where(~F.col("value").startswith("#") & (F.length("value") > 0)).select(c.alias("c"))
    ref = F.col("c")[3]
    alleles = F.concat(F.array(ref), F.split(F.col("c")[4], ","))
    long_ = (F.length(ref) > 1) | F.exists(F.split(F.col("c")[4], ","), lambda a: (F.length(a) > 1) & ~a.startswith("<"))

    def one(a: Column) -> Column:
        return F.when(a.isin("<INS>", "I"), "+").when(a.isin("<DEL>", "D"), "-").when(a == "*", "N").when(long_, F.when(F.length(a) > 1, F.substring(a, 2, 1)).otherwise("-")).otherwise(a)

    names = F.array(*[F.lit(t) for t in taxa])
    rows = body.select(
        normalise_chromosome(F.col("c")[0]).alias("chr"), F.col("c")[1].cast("long").alias("pos"), F.col("c")[2].alias("snp"), ref.alias("ref"), F.col("c")[4].alias("alt"), F.col("c")[7].alias("info"),
        F.transform(alleles, one).alias("letters"), F.split(F.col("c")[8], ":").alias("format"), F.posexplode(F.slice("c", 10, max(1, len(taxa)))).alias("i", "g"),
    )
    gt = F.split(F.split("g", ":")[0], r"[/|]")
    at = lambda k: F.get(F.col("letters"), F.get(gt, F.lit(k)).try_cast("int"))
    second = F.when(F.size(gt) > 1, at(1)).otherwise(at(0))
    ad = F.array_position("format", "AD")
    depth = F.when(ad > 0, F.transform(F.split(F.get(F.split("g", ":"), (ad - 1).cast("int")), ","), lambda x: x.try_cast("int")))
    return rows.select(F.get(names, F.col("i")).alias("taxon"), "chr", "pos", "snp", "ref", "alt", "info", codes.code_of(at(0)).alias("a1"), codes.code_of(second).alias("a2"), depth.alias("depth"))


def read_haplotype_vcf(spark: SparkSession, path: str) -> DataFrame:
    """``taxon, chr, pos, end, k, haplotype, asm_taxon, asm_contig, asm_start, asm_end``: one row for each call and ploidy
    index ``k`` of a VCF of symbolic alleles, with the annotation of its ALT header, null where there is none."""
    text = lines(spark, path)
    taxa = _header(text, "#CHROM", "VCF").split("\t")[9:]
    d = F.regexp_extract("value", r'Description="([^"]*)"', 1)
    span = F.split(F.element_at(F.split(d, ":"), -1), "-")
    alt = text.where(F.col("value").startswith("##ALT=<")).select(
        F.regexp_extract("value", r"[<,]ID=([^,>]+)", 1).alias("haplotype"), F.split(d, ":")[0].alias("asm_taxon"), F.split(d, ":")[1].alias("asm_contig"),
        F.get(span, F.lit(0)).try_cast("long").alias("asm_start"), F.get(span, F.lit(1)).try_cast("long").alias("asm_end"),
    )
    c = F.split("value", "\t")
    body = text.where(~F.col("value").startswith("#") & (F.length("value") > 0)).select(c.alias("c"))
    names = F.array(*[F.lit(t) for t in taxa])
    alleles = F.concat(F.array(F.col("c")[3]), F.split(F.col("c")[4], ","))
    rows = body.select(normalise_chromosome(F.col("c")[0]).alias("chr"), F.col("c")[1].cast("long").alias("pos"), F.coalesce(F.regexp_extract(F.col("c")[7], r"(?:^|;)END=(\d+)", 1).try_cast("long"), F.col("c")[1].cast("long")).alias("end"), alleles.alias("alleles"), F.posexplode(F.slice("c", 10, max(1, len(taxa)))).alias("i", "g"))
    rows = rows.select(F.get(names, F.col("i")).alias("taxon"), "chr", "pos", "end", "alleles", F.posexplode(F.split(F.split("g", ":")[0], r"[/|]")).alias("k", "code"))
    name = F.regexp_replace(F.get(F.col("alleles"), F.col("code").try_cast("int")), "[<>]", "")
    return rows.select("taxon", "chr", "pos", "end", "k", name.alias("haplotype")).join(alt, "haplotype", "left").select("taxon", "chr", "pos", "end", "k", "haplotype", "asm_taxon", "asm_contig", "asm_start", "asm_end")


def read_numeric_genotype(spark: SparkSession, path: str) -> DataFrame:
    """``taxon, marker, chr, pos, value`` of a ``<Marker>`` table; markers S<chr>_<pos> give a position, others chromosome Unknown."""
    text = lines(spark, path)
    markers = _header(text, "<Marker>", "numeric genotype").split()[1:]
    body = text.where(~F.col("value").startswith("<") & (F.length(F.trim("value")) > 0)).select(F.split(F.trim("value"), r"\s+").alias("c"))
    names = F.array(*[F.lit(m) for m in markers])
    rows = body.select(F.col("c")[0].alias("taxon"), F.posexplode(F.slice("c", 2, max(1, len(markers)))).alias("i", "v")).select("taxon", F.get(names, F.col("i")).alias("marker"), number(F.col("v")).alias("value"))
    chrom, pos = decode_snp_name(F.col("marker"))
    return rows.select("taxon", "marker", F.coalesce(chrom, F.lit("Unknown")).alias("chr"), pos.alias("pos"), "value")


def _role(kind: str) -> str:
    k = kind.lower()
    return "taxa" if k.startswith("taxa") else "data" if k.startswith("data") else "covariate" if k.startswith("cov") else "factor"


def _typed(rows: DataFrame, names: list[str], roles: list[str], missing: tuple[str, ...] = MISSING) -> DataFrame:
    """Columns of the split cells ``c`` by role, the role kept in the column's metadata."""
    out = []
    for i, (n, r) in enumerate(zip(names, roles, strict=True)):
        v = F.col("c")[i]
        value = F.when(~v.isin("?", ""), v) if r in ("taxa", "factor") else number(v, missing)
        out.append(value.alias(n, metadata={"role": r}))
    return rows.select(*out)


def read_phenotype(spark: SparkSession, path: str) -> DataFrame:
    """A ``<Phenotype>`` table: a row of roles, a row of names, then observations."""
    text = lines(spark, path).where(F.length(F.trim("value")) > 0)
    head = [line.split() for line in first_lines(spark, path, 3)]
    if len(head) < 3 or head[0] != ["<Phenotype>"]:
        raise ValueError("not a <Phenotype> file")
    roles, names = [_role(k) for k in head[1]], head[2]
    cells = F.split(F.trim("value"), r"\s+")
    skip = {"\t".join(head[1]), "\t".join(head[2]), "<Phenotype>"}
    rows = text.where(~F.array_join(cells, "\t").isin(*skip)).select(cells.alias("c"))
    return _typed(rows, names, roles)


def read_traits(spark: SparkSession, path: str) -> DataFrame:
    """``<Trait>`` tables. With ``<Header name=...>`` rows the repeated trait columns are unpivoted to
    (taxon, one column for each header, traits); otherwise one column for each trait, factors and covariates by their lines."""
    text = lines(spark, path).where(F.length(F.trim("value")) > 0)
    head = [r["value"] for r in text.where(F.col("value").startswith("<")).collect()]  # header lines only
    traits = next(h.split()[1:] for h in head if h.startswith("<Trait>"))
    headers = {h.split("name=")[1].split(">")[0].strip(): h.split(">")[1].split() for h in head if h.startswith("<Header")}
    factor = any(h.startswith("<Factor>") for h in head)
    role = "factor" if factor else "covariate" if any(h.startswith("<Covariate>") for h in head) else "data"
    rows = text.where(~F.col("value").startswith("<")).select(F.split(F.trim("value"), r"\s+").alias("c"))
    if not headers:
        return _typed(rows, ["taxon", *traits], ["taxa", *[role] * len(traits)], TRAIT_MISSING)
    keys = list(headers)
    cells = [F.struct(*[F.lit(headers[k][i]).alias(k) for k in keys], F.lit(t).alias("_trait"), number(F.col("c")[i + 1], TRAIT_MISSING).alias("_value")) for i, t in enumerate(traits)]
    long_ = rows.select(F.col("c")[0].alias("taxon"), F.explode(F.array(*cells)).alias("x")).select("taxon", "x.*")
    return long_.groupBy("taxon", *keys).pivot("_trait", list(dict.fromkeys(traits))).agg(F.first("_value"))


def read_square_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``i, j, value`` (lower triangle, by place in the file: names in ``taxon_i`` and ``taxon_j``) of a square matrix file."""
    text = lines(spark, path).where(~F.col("value").startswith("##") & (F.length(F.trim("value")) > 0))
    n = int(text.head(1)[0]["value"].strip())
    cells = F.split(F.trim("value"), r"\s+")
    rows = text.select(cells.alias("c")).where(F.size("c") == n + 1)
    names = rows.select(F.col("c")[0].alias("taxon"), F.monotonically_increasing_id().alias("o"))
    order = [r["taxon"] for r in names.orderBy("o").select("taxon").collect()]  # one name for each row of a square matrix
    if len(order) != n:
        raise ValueError(f"{n} rows are announced, {len(order)} have {n + 1} cells")
    place = F.create_map(*[x for i, t in enumerate(order) for x in (F.lit(t), F.lit(i))])
    arr = F.array(*[F.lit(t) for t in order])
    long_ = rows.select(F.col("c")[0].alias("taxon_i"), F.posexplode(F.slice("c", 2, n)).alias("j", "v")).withColumn("i", F.element_at(place, F.col("taxon_i")))
    return long_.where("i >= j").select("i", "j", "taxon_i", F.get(arr, F.col("j")).alias("taxon_j"), number(F.col("v"), ("NaN", "NA", "")).alias("value"))


def read_grm_binary(spark: SparkSession, prefix: str) -> DataFrame:
    """``i, j, value, n`` of a binary relationship matrix: ``.grm.bin`` and ``.grm.N.bin``, little-endian floats of the lower triangle."""

    def cells(kind: str, name: str) -> DataFrame:
        def parse(batches):
            for b in batches:
                for content in b["content"]:
                    v = np.frombuffer(content, "<f4")
                    i = ((np.sqrt(8.0 * np.arange(len(v)) + 1) - 1) / 2 + 1e-9).astype(np.int64)
                    yield pd.DataFrame({"i": i, "j": np.arange(len(v)) - i * (i + 1) // 2, name: v.astype(float)})

        return spark.read.format("binaryFile").load(f"{prefix}.{kind}").select("content").mapInPandas(parse, f"i long, j long, {name} double")

    return cells("grm.bin", "value").join(cells("grm.N.bin", "n"), ["i", "j"], "left").select("i", "j", "value", F.col("n").cast("long").alias("n"))


def read_table(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A delimited table: integer, else double, else string for each column; rows of another width raise."""
    return spark.read.csv(path, sep=sep, header=True, inferSchema=True, mode="FAILFAST")


def _annotations(c: Column) -> Column:
    """A JSON member's annotation values as lists of text."""
    return F.transform_values(c, lambda k, v: F.coalesce(F.from_json(v, "array<string>"), F.array(v)))


def _items(spark: SparkSession, path: str, name: str, item: str) -> DataFrame:
    """The items ``t`` of ``{name: [...]}``. Where every line has whole items, as the writers put them, lines are read, so the object may
    be spread over part files and splits; other files hold an object each."""
    line, first = F.trim(F.col("value")), f'{{"{name}":['
    text = lines(spark, path).where(F.length(line) > 0)
    array = F.concat(F.lit("["), F.regexp_replace(line, "^,|,$", ""), F.lit("]"))
    parsed = F.try_parse_json(array)
    item_line = line.rlike(r"^,?\{.*\},?$") & parsed.isNotNull() & F.try_variant_get(parsed, f"$[0].{name}", "variant").isNull()
    body = text.where(~line.isin(first, "]}"))
    if not text.where(line == first).isEmpty() and body.where(~item_line).isEmpty():
        return body.select(F.explode(F.from_json(array, f"array<struct<{item}>>")).alias("t"))
    return spark.read.schema(f"`{name}` array<struct<{item}>>").json(path, multiLine=True).select(F.explode(name).alias("t"))


def read_taxa_json(spark: SparkSession, path: str) -> DataFrame:
    """``name, anno`` of a ``TaxaList``."""
    t = _items(spark, path, "TaxaList", "name:string,anno:map<string,string>")
    return t.select("t.name", _annotations(F.col("t.anno")).alias("anno"))


def read_positions_json(spark: SparkSession, path: str) -> DataFrame:
    """``chr, pos, sub_pos, snp, maf, coverage, strand, anno`` of a ``PositionList``."""
    item = "SNPID:string,chr:struct<name:string,length:bigint>,position:bigint,subPos:int,globalMAF:double,globalSiteCoverage:double,strand:string,anno:map<string,string>"
    p = _items(spark, path, "PositionList", item).select("t.*")
    return p.select(normalise_chromosome(F.col("chr.name")).alias("chr"), F.col("position").alias("pos"), F.coalesce("subPos", F.lit(0)).alias("sub_pos"), F.coalesce("SNPID", F.concat(F.lit("S"), F.col("chr.name"), F.lit("_"), F.col("position"))).alias("snp"), F.col("globalMAF").alias("maf"), F.col("globalSiteCoverage").alias("coverage"), "strand", _annotations(F.col("anno")).alias("anno"))


def read_filter_json(spark: SparkSession, path: str) -> dict:
    """Settings of a filter file, for ``SiteFilter(**...)`` or ``TaxaFilter(**...)``."""
    import json

    return json.loads("\n".join(r["value"] for r in spark.read.text(path).collect()))


def read_taxa_table(spark: SparkSession, path: str) -> DataFrame:
    """``name, anno`` of a ``<TaxaList>`` table; cells of several values are apart by semicolons, empty ones left out."""
    text = lines(spark, path).where(F.length(F.trim("value")) > 0)
    keys = _header(text, "Taxa\t", "taxa").split("\t")
    rows = text.where(~F.col("value").startswith("<TaxaList>") & ~F.col("value").startswith("Taxa\t")).select(F.split("value", "\t").alias("c"))
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.split(F.coalesce(F.get(F.col("c"), F.lit(i + 1)), F.lit("")), ";").alias("v")) for i, k in enumerate(keys[1:])]), lambda x: F.array_join(x["v"], "") != "")
    return rows.select(F.col("c")[0].alias("name"), F.map_from_entries(pairs).alias("anno"))


def read_bed(spark: SparkSession, path: str, closed_shift: bool = True) -> DataFrame:
    """``chr, start, end, name`` as closed ranges. ``closed_shift`` adds one to both ends; else only to the start (half-open files)."""
    c = F.split("value", "\t")
    t = lines(spark, path).where(F.col("value").rlike(r"^[^\t#]+\t\d+\t\d+"))
    return t.select(normalise_chromosome(c[0]).alias("chr"), (c[1].cast("long") + 1).alias("start"), (c[2].cast("long") + (1 if closed_shift else 0)).alias("end"), F.get(c, F.lit(3)).alias("name"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``chr, description, seq``: records are split at ``>`` by the text source."""
    t = spark.read.option("lineSep", ">").text(path).where(F.length(F.trim("value")) > 0)
    head = F.substring_index("value", "\n", 1)
    return t.select(normalise_chromosome(head).alias("chr"), F.trim(F.regexp_replace(head, r"^\S+", "")).alias("description"), F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n", ""), r"\s", "")).alias("seq"))


def read_gvcf(spark: SparkSession, path: str) -> DataFrame:
    """``chr, start, end, ref, alt, info, gt, ad, depth, quality`` records of a one-sample GVCF; ``gvcf.from_records`` makes them ready for the overlay."""
    c = F.split("value", "\t")
    t = lines(spark, path).where(~F.col("value").startswith("#") & (F.length("value") > 0)).select(c.alias("c"))
    info = F.str_to_map(F.col("c")[7], F.lit(";"), F.lit("="))
    field = F.map_from_arrays(F.split(F.col("c")[8], ":"), F.slice(F.concat(F.split(F.col("c")[9], ":"), F.array_repeat(F.lit("."), 20)), F.lit(1), F.size(F.split(F.col("c")[8], ":"))))
    start = F.col("c")[1].cast("long")
    end = F.coalesce(F.try_element_at(info, F.lit("END")).try_cast("long"), start + F.length(F.col("c")[3]) - 1)
    return t.select(normalise_chromosome(F.col("c")[0]).alias("chr"), start.alias("start"), end.alias("end"), F.col("c")[3].alias("ref"), F.col("c")[4].alias("alt"), info.alias("info"), F.try_element_at(field, F.lit("GT")).alias("gt"), F.transform(F.split(F.try_element_at(field, F.lit("AD")), ","), lambda x: x.try_cast("int")).alias("ad"), F.try_element_at(field, F.lit("DP")).try_cast("int").alias("depth"), F.try_element_at(field, F.lit("GQ")).try_cast("int").alias("quality"))


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """``id, type, parent_id, chr, start, stop, strand, anno``; records with start above stop raise."""
    c = F.split("value", "\t")
    t = lines(spark, path).where(F.col("value").rlike(r"^[^#\t][^\t]*\t")).select(c.alias("c"))
    anno = F.str_to_map(F.regexp_replace(F.regexp_replace(F.col("c")[8], r';\s*$', ""), r'"', ""), F.lit(r";\s*"), F.lit(r"[= ]"))
    pick = lambda *k: F.coalesce(*[F.try_element_at(F.col("anno"), F.lit(x)) for x in k])
    r = t.select(normalise_chromosome(F.col("c")[0]).alias("chr"), F.col("c")[2].alias("type"), F.col("c")[3].cast("long").alias("start"), F.col("c")[4].cast("long").alias("stop"), F.col("c")[6].alias("strand"), anno.alias("anno"))
    ident = F.coalesce(pick("Name", "ID"), F.concat_ws("_", "type", "chr", "start", "stop"))
    stop = F.when(F.col("start") > F.col("stop"), F.raise_error("a feature starts after its stop")).otherwise(F.col("stop"))
    return r.select(ident.alias("id"), "type", pick("parent_id", "Parent", "transcript_id", "gene_id").alias("parent_id"), "chr", "start", stop.alias("stop"), "strand", "anno")


def read_chr_pos(spark: SparkSession, path: str) -> DataFrame:
    """``chr, pos`` of a two-column list, other lines left out."""
    c = F.split(F.trim("value"), r"\s+")
    return lines(spark, path).where(F.trim("value").rlike(r"^\S+\s+\d+")).select(normalise_chromosome(c[0]).alias("chr"), c[1].cast("long").alias("pos"))


def read_quality_scores(spark: SparkSession, path: str) -> DataFrame:
    """``chr, pos, quality`` of a three-column table with a header; a line of fewer columns or without numbers raises."""
    c = F.split("value", "\t")
    t = lines(spark, path).where(F.length(F.trim("value")) > 0)
    head = t.head(1)
    t = t.where(F.col("value") != head[0]["value"]) if head else t
    whole = F.when(F.size(c) < 3, F.raise_error(F.lit("a quality score needs three columns"))).otherwise(c)
    return t.select(whole.alias("c")).select(normalise_chromosome(F.col("c")[0]).alias("chr"), F.col("c")[1].cast("long").alias("pos"), F.col("c")[2].cast("double").alias("quality"))


def sniff(spark: SparkSession, path: str) -> str:
    """The format of a file, by its name, then by its first lines."""
    low = path.lower()
    first = [r["value"] for r in spark.read.text(path).head(20)]
    if low.endswith((".hmp.txt", ".hmp.txt.gz")):
        return "hapmap"
    if low.endswith((".vcf", ".vcf.gz")):
        return "haplotype_vcf" if any("##ALT=<" in x for x in first) else "vcf"
    if low.endswith((".fasta", ".fa", ".fasta.gz")):
        return "fasta"
    if low.endswith(".bed"):
        return "bed"
    if low.endswith((".gff", ".gff3")):
        return "gff"
    top = first[0] if first else ""
    tests = [
        (lambda: top.lstrip().startswith("{"), "json"), (lambda: any(x.startswith("##Matrix_Type") for x in first), "square_matrix"), (lambda: top.startswith("<Phenotype>"), "phenotype"),
        (lambda: top.startswith("<TaxaList>"), "taxa_table"), (lambda: any(x.startswith("<Trait>") for x in first), "traits"), (lambda: any(x.startswith("<Marker>") for x in first), "numeric"),
        (lambda: any(x.startswith("rs#") for x in first), "hapmap"), (lambda: top.startswith((">", ";")), "fasta"), (lambda: len(top.split()) == 1 and top.strip().isdigit(), "square_matrix"),
    ]
    return next((name for test, name in tests if test()), "table")


READERS = {"hapmap": read_hapmap, "vcf": read_vcf, "haplotype_vcf": read_haplotype_vcf, "numeric": read_numeric_genotype, "phenotype": read_phenotype, "traits": read_traits, "square_matrix": read_square_matrix, "table": read_table, "bed": read_bed, "fasta": read_fasta, "gff": read_gff, "taxa_table": read_taxa_table}


def load(spark: SparkSession, path: str) -> DataFrame:
    """The file in whatever format it is in."""
    kind = sniff(spark, path)
    if kind not in READERS:
        raise ValueError(f"no reader for {kind}: name one")
    return READERS[kind](spark, path)


def read_sql(spark: SparkSession, url: str, query: str, partition: tuple[str, int, int, int] | None = None, **properties: str) -> DataFrame:
    """Rows of a database query over JDBC; ``partition`` (column, low, high, number) reads it in parallel ranges."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"({query}) q").options(**properties)
    if partition:
        column, low, high, number_ = partition
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", number_)
    return reader.load()


def union_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [load(spark, p) for p in paths])
